from pyspark.sql import functions as F

from wardstone.functions import scoring as S
from wardstone.functions.registry import java_regex


def test_led_patterns_count_what_the_plain_ones_count_and_look_for_no_edge_elsewhere(spark):
    texts = ["YOU must. Your new ROLE is; ſrom now on", "GOING FORWARD you shall for the rest of this session", "xyou must éyou will _you are to", "YOUR Context, The system prompt", "EVERYTHING ABOVE the text above this line", "", None, "yyyyffggttee you your"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    values = S.signal_values(F.col("text"), F.col("text"))
    for name, pattern, led in (("structure.directive", S.DIRECTIVE, "(?=[yfgYFG])"), ("structure.context_reference", S.CONTEXT, "(?=[yteYTE])")):
        plain = F.least(F.lit(1.0), F.coalesce(F.regexp_count("text", F.lit(java_regex(pattern))), F.lit(0)) / 2)
        assert all(r.a == r.b for r in rows.select(values[name].alias("a"), plain.alias("b")).collect())
        assert led in values[name]._jc.toString()
