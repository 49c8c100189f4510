"""Queries over single messages: normalisation, rules, signals, layers and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.functions import features as X
from wardstone.functions import normalize as N
from wardstone.functions import scoring as S
from wardstone.functions.registry import FAMILIES, RULES, SIGNALS, countermeasures, disabled_for, plain_regex
from wardstone.plans.graft import MESSAGES_SQL, messages, sql_text
from wardstone.plans.learning import CLOSED_FORM_SQL, closed_form_weights, keys_sql

# -- Spark -----------------------------------------------------------------------------------------------


def _stage(build):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return messages(spark, sf_dir).select("doc_id", build(F.col("text")).alias("out"))

    return query


def char_norm(c):
    """The character stages alone: what messages without encodings or fragments normalise to."""
    return N.casefold(N.whitespace(N.confusables(N.zero_width(N.nfkc(c)))))


def char_norm_exact(c):
    """char_norm in exact Unicode: what every query that counts hits or decides reads."""
    return N.casefold_exact(N.whitespace(N.confusables(N.zero_width(N.nfkc_exact(c)))))


def _base(spark, sf_dir, disabled=()):
    return N.with_normalized(messages(spark, sf_dir), disabled=disabled, exact=True)


def _scored(spark, sf_dir):
    df = _base(spark, sf_dir).select("doc_id", "source", "text", "norm")
    df = df.withColumn("rules", S.rule_hits(F.col("norm"))).withColumn("signals", S.signal_hits(F.col("text"), F.col("norm")))
    return df.withColumn("rule_layer", S.rule_layer(F.col("rules"))).withColumn("signal_layer", S.signal_layer(F.col("signals"))).withColumn("score", S.decision_score(F.col("rule_layer"), F.col("signal_layer")))


def normalize_pipeline(spark, sf_dir):
    return _base(spark, sf_dir).select("doc_id", "norm", F.array_join("applied", ",").alias("applied"), "expanded")


def normalize_fold_disabled(spark, sf_dir):
    off = disabled_for("stage", "homoglyph") | disabled_for("stage", "encoding_wrapper") | disabled_for("stage", "payload_splitting")
    return _base(spark, sf_dir, off).select("doc_id", "norm", F.array_join("applied", ",").alias("applied"), F.array_join("skipped", ",").alias("skipped"))


def nfkc_exact(spark, sf_dir):
    return _base(spark, sf_dir).select("doc_id", "norm")


def decode_round(spark, sf_dir):
    c = F.col("text")
    return messages(spark, sf_dir).select("doc_id", F.array_join(N.decode_base64(c), "|").alias("base64"), F.array_join(N.decode_hex(c), "|").alias("hex"), F.size(N.decode_substitution(c)).cast("long").alias("n_substitutions"))


def stopword_density(spark, sf_dir):
    return messages(spark, sf_dir).select("doc_id", F.round(N.function_word_density(F.col("text")), 9).alias("density"))


def printable_ratio(spark, sf_dir):
    return messages(spark, sf_dir).select("doc_id", F.round(N.printable_ratio(F.col("text")), 9).alias("ratio"))


def rule_hits(spark, sf_dir):
    df = _base(spark, sf_dir).select("doc_id", "norm")
    return df.select("doc_id", F.explode(S.rule_hits(F.col("norm"), evidence=True)).alias("h")).select("doc_id", "h.rule_id", "h.weight", F.col("h.start").cast("long").alias("start"), F.col("h.end").cast("long").alias("end"), "h.matched")


def rule_counts(spark, sf_dir):
    hits = _base(spark, sf_dir).select(F.explode(S.rule_hits(F.col("norm"))).alias("h"))
    return hits.groupBy("h.rule_id").agg(F.count("*").alias("n"))


def rules_for_fold(spark, sf_dir):
    """Rules left to each fold, and the hits each fold loses."""
    hits = _base(spark, sf_dir).select("doc_id", F.explode(S.rule_hits(F.col("norm"))).alias("h")).groupBy(F.col("h.rule_id").alias("name")).agg(F.count("*").alias("hits"))
    known = countermeasures(spark).where("layer = 'rule'").select("name", F.explode("motivated_by").alias("family"))
    return known.join(F.broadcast(hits), "name", "left").groupBy("family").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("disabled"), F.sum(F.coalesce("hits", F.lit(0))).alias("hits_lost"))


def signal_table(spark, sf_dir):
    df = _base(spark, sf_dir)
    values = S.signal_values(F.col("text"), F.col("norm"))
    return df.select("doc_id", *[F.round(v.cast("double"), 9).alias(k.split(".")[1]) for k, v in values.items()])


def layer_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", F.round("rule_layer", 6).alias("rules"), F.round("signal_layer", 6).alias("signals"), F.round("score", 6).alias("decision"), F.round(S.combined_layer(F.col("rule_layer"), F.col("signal_layer"), F.lit(0.0)), 6).alias("combined"))


def char_layer_scores(spark, sf_dir):
    df = messages(spark, sf_dir).withColumn("norm", char_norm_exact(F.col("text")))
    df = df.select("doc_id", S.rule_layer(S.rule_hits(F.col("norm"))).alias("r"), S.signal_layer(S.signal_hits(F.col("text"), F.col("norm"))).alias("s"))
    return df.select("doc_id", F.round("r", 6).alias("rules"), F.round("s", 6).alias("signals"), F.round(S.decision_score(F.col("r"), F.col("s")), 6).alias("decision"), F.round(S.combined_layer(F.col("r"), F.col("s"), F.lit(0.0)), 6).alias("combined"))


def _decisions(enforce):
    def query(spark, sf_dir):
        return _scored(spark, sf_dir).groupBy("source", S.decide(F.col("score"), enforce).alias("decision")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))

    return query


def decision_by_rules(spark, sf_dir):
    df = _base(spark, sf_dir)
    score = S.decision_score(S.rule_layer(S.rule_hits(F.col("norm"))), F.lit(0.0))
    return df.select("source", S.decide(score, enforce=True, flag=0.4, block=0.54).alias("decision")).groupBy("source", "decision").agg(F.count("*").alias("n"))


def verdict_reasons(spark, sf_dir):
    why = S.reasons(F.col("rules"), F.col("signals"))
    return _scored(spark, sf_dir).select("doc_id", F.array_join(why, ",").alias("reasons"), S.explain(S.decide(F.col("score")), F.col("score"), why).alias("explanation"))


def five_layers(spark, sf_dir):
    """All five layers of normalised messages, the model being linear weights in closed form over the built-in hash lane."""
    linear = X.scorer(closed_form_weights(spark), 0.25)
    df = _base(spark, sf_dir).select("doc_id", S.rule_layer(S.rule_hits(F.col("norm"))).alias("r"), S.signal_layer(S.signal_hits(F.col("text"), F.col("norm"))).alias("s"), linear(F.col("norm")).alias("z"))
    df = df.withColumn("m", S.sigmoid(F.col("z")))
    decision = S.decision_score(F.col("r"), F.col("s"), F.col("m"))
    return df.select("doc_id", F.round("r", 6).alias("rules"), F.round("s", 6).alias("signals"), F.round("m", 6).alias("model"), F.round(S.combined_layer(F.col("r"), F.col("s"), F.col("m")), 6).alias("combined"), F.round(decision, 6).alias("decision"))


def fingerprint(spark, sf_dir):
    return messages(spark, sf_dir).select("doc_id", S.fingerprint(F.col("text"), "pepper").alias("fingerprint"), F.length("text").cast("long").alias("length"))


# -- SQL -------------------------------------------------------------------------------------------------

_NFKC = lambda t: f"translate({t}, {sql_text(N.FULLWIDTH)}, {sql_text(N.FULLWIDTH_ASCII)})"
_ZW = lambda t: f"translate({t}, {sql_text(N.ZERO_WIDTH)}, '')"
_CONF = lambda t: f"translate({t}, {sql_text(N.LOOKALIKES)}, {sql_text(N.LOOKALIKES_LATIN)})"
_WS = lambda t: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\v\\r\\x{{3000}}]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_FOLD = lambda t: f"lower(replace({t}, 'ß', 'ss'))"
_CHAR = _FOLD(_WS(_CONF(_ZW(_NFKC("text")))))
_HEAD = f"WITH {MESSAGES_SQL}, c AS MATERIALIZED (SELECT doc_id, source, text, {_CHAR} AS norm FROM m)"
_RULE_TABLE = "r(pos, rule_id, weight, family, pattern) AS (VALUES " + ", ".join(f"({i}, '{r.name}', CAST({r.weight} AS DOUBLE), '{r.motivated_by[0]}', {sql_text(plain_regex(r.pattern))})" for i, r in enumerate(RULES)) + ")"
#: Patterns must be constants for the engine to compile them once: a list of the hits of each row, in table order
_HITS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(norm, {sql_text(plain_regex(r.pattern))}) THEN {i} END" for i, r in enumerate(RULES)) + "], lambda x: x IS NOT NULL)"
_RULE_LAYER = "1 - " + " * ".join(f"(1 - CASE WHEN regexp_matches(norm, {sql_text(plain_regex(r.pattern))}) THEN CAST({r.weight} AS DOUBLE) ELSE 0 END)" for r in RULES)
_WORDS = "regexp_extract_all(text, '\\p{L}+')"
_LATIN = "[\\p{Latin}]"
_SENT = "list_filter(list_transform(regexp_extract_all(norm, '[^.!?\\n]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
_IS_COMMAND = f"list_contains([{', '.join(map(sql_text, S.COMMANDS))}], lower(regexp_extract(s, '\\p{{L}}+')))"
_share = lambda n, of, k: f"CASE WHEN {of} > 0 THEN least(1.0, greatest(0.0, CAST({n} AS DOUBLE) / {of} * {k})) ELSE 0.0 END"
_SIGNALS = {
    "structure.zero_width": _share(f"(length(text) - length({_ZW('text')}))", "length(text)", 50),
    "structure.script_mixing": _share(f"len(list_filter(list_transform({_WORDS}, lambda w: translate(w, {sql_text(''.join(chr(c) for c in range(0xFF21, 0xFF3B)) + ''.join(chr(c) for c in range(0xFF41, 0xFF5B)))}, '')), lambda w: CAST(regexp_matches(w, '{_LATIN}') AS INT) + CAST(regexp_matches(w, '\\p{{Cyrillic}}') AS INT) + CAST(regexp_matches(w, '\\p{{Greek}}') AS INT) >= 2))", f"len({_WORDS})", 4),
    "structure.encoded_blob": _share(f"coalesce(list_sum(list_transform(regexp_extract_all(text, {sql_text(N.BASE64_RUN + '|' + N.HEX_RUN)}), lambda x: length(x))), 0)", "length(text)", 3),
    "structure.expansion": _share("(length(norm) - length(text))", "length(text)", 2),
    "structure.imperative": _share(f"len(list_filter({_SENT}, lambda s: {_IS_COMMAND}))", f"len({_SENT})", 1),
    "structure.directive": f"least(1.0, len(regexp_extract_all(norm, {sql_text(plain_regex(S.DIRECTIVE))})) / 2)",
    "structure.context_reference": f"least(1.0, len(regexp_extract_all(norm, {sql_text(plain_regex(S.CONTEXT))})) / 2)",
}
_SIGNAL_LAYER = "1 - " + " * ".join(f"(1 - CAST({s.weight} AS DOUBLE) * ({_SIGNALS[s.name]}))" for s in SIGNALS)
_DENSITY_WORDS = "regexp_extract_all(lower(text), '[A-Za-z'']+')"


# the decoding stages, as list expressions over a text expression
_REV = lambda t: f"array_to_string(list_reverse(regexp_extract_all({t}, '(?s).')), '')"
_ROT = lambda t: f"translate({t}, '{N.ROT13_FROM}', '{N.ROT13_TO}')"
_LETTERS = lambda t: f"regexp_extract_all(lower({t}), '[A-Za-z'']+')"
_DENSITY = lambda t: f"(CASE WHEN len({_LETTERS(t)}) < 4 THEN 0.0::DOUBLE ELSE CAST(len(list_filter({_LETTERS(t)}, lambda w: list_contains([{', '.join(map(sql_text, N.FUNCTION_WORDS))}], w))) AS DOUBLE) / len({_LETTERS(t)}) END)"
_READABLE = "y IS NOT NULL AND length(y) > 0 AND 1 - CAST(len(regexp_extract_all(replace(replace(replace(y, chr(10), ''), chr(9), ''), ' ', ''), '[\\p{Cc}\\p{Co}\\p{Z}]')) AS DOUBLE) / length(y) > 0.9 AND regexp_matches(y, '[A-Za-z'']')"
_BASE64 = lambda t: f"list_filter(list_transform(list_filter(list_transform(regexp_extract_all({t}, {sql_text(N.BASE64_RUN)}), lambda x: left(x, length(x) - length(x) % 4)), lambda x: length(x) >= 24), lambda x: try(decode(from_base64(x)))), lambda y: {_READABLE})"
_HEX = lambda t: f"list_filter(list_transform(regexp_extract_all({t}, {sql_text(N.HEX_RUN)}), lambda x: try(decode(unhex(regexp_replace(x, '[ \\t]', '', 'g'))))), lambda y: {_READABLE})"
_SUBST = lambda t: f"list_filter([{_ROT(t)}, {_REV(t)}], lambda z: {_DENSITY('z')} >= {_DENSITY(t)} + 0.15)"
_DISCOVER = lambda t: f"list_concat(list_concat({_BASE64(t)}, {_HEX(t)}), {_SUBST(t)})"


def _values(t: str) -> str:
    """Values of quoted assignments; without backreferences each quote has its own pattern, one per line."""
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda l: coalesce(nullif(regexp_extract(l, '^\\s*[A-Za-z_][A-Za-z0-9_]*\\s*=\\s*''(.*?)''\\s*$', 1), ''), regexp_extract(l, '^\\s*[A-Za-z_][A-Za-z0-9_]*\\s*=\\s*\"(.*?)\"\\s*$', 1))), lambda v: trim(v) <> '')"


#: c(doc_id, source, text, norm, grew): the whole normalisation
_FULL = f"""WITH {MESSAGES_SQL}, s0 AS MATERIALIZED (SELECT doc_id, source, text, {_WS(_CONF(_ZW(_NFKC("text"))))} AS t FROM m),
s1 AS MATERIALIZED (SELECT *, list_filter({_DISCOVER("t")}, lambda q: q <> t) AS one FROM s0),
s2 AS MATERIALIZED (SELECT *, flatten(list_transform(one, lambda c: {_DISCOVER("c")})) AS more FROM s1),
s3 AS MATERIALIZED (SELECT doc_id, source, text, t, CASE WHEN len(one) = 0 THEN t ELSE t || chr(10) || array_to_string(list_concat(one, list_filter(more, lambda q: q <> t AND NOT list_contains(one, q))), chr(10)) END AS g FROM s2),
s4 AS MATERIALIZED (SELECT *, {_values("g")} AS vs FROM s3),
s5 AS MATERIALIZED (SELECT doc_id, source, text, t, CASE WHEN len(vs) < 2 OR contains(g, array_to_string(vs, ' ')) THEN g ELSE g || chr(10) || array_to_string(vs, ' ') END AS g FROM s4),
c AS MATERIALIZED (SELECT doc_id, source, text, g <> t AS grew, CASE WHEN g <> t THEN {_FOLD(_CONF(_ZW(_NFKC(_FOLD("g")))))} ELSE {_FOLD("g")} END AS norm FROM s5)"""
_LAYERS = f"{_FULL}, l AS (SELECT doc_id, source, {_RULE_LAYER} AS r, {_SIGNAL_LAYER} AS s FROM c), d AS (SELECT *, 1 - (1 - 0.9::DOUBLE * r) * (1 - 0.65::DOUBLE * s) AS score FROM l)"
_decided = lambda enforce: f"{_LAYERS} SELECT source, CASE {"WHEN score >= 0.9 THEN 'block' " * enforce}WHEN score >= 0.5 THEN 'flag' ELSE 'allow' END AS decision, count(*) AS n, round(avg(score), 6) AS mean_score FROM d GROUP BY ALL"


def _stage_sql(out):
    return f"WITH {MESSAGES_SQL} SELECT doc_id, {out} AS out FROM m"


def queries() -> dict:
    return {
        "norm_fullwidth": _stage(N.nfkc), "norm_zero_width": _stage(N.zero_width), "norm_confusables": _stage(N.confusables), "norm_whitespace": _stage(N.whitespace), "norm_casefold": _stage(N.casefold),
        "norm_characters": _stage(char_norm), "decode_rot13_reverse": _stage(lambda c: F.concat(N.rot13(c), F.lit("|"), F.reverse(c))), "reassemble": _stage(N.reassemble), "decode_round": decode_round,
        "stopword_density": stopword_density, "printable_ratio": printable_ratio, "normalize_pipeline": normalize_pipeline, "normalize_fold_disabled": normalize_fold_disabled, "nfkc_exact": nfkc_exact,
        "rule_hits": rule_hits, "rule_counts": rule_counts, "rules_for_fold": rules_for_fold, "signal_table": signal_table, "layer_scores": layer_scores, "char_layer_scores": char_layer_scores,
        "decision_monitor": _decisions(False), "decision_enforce": _decisions(True), "decision_by_rules": decision_by_rules, "verdict_reasons": verdict_reasons, "five_layers": five_layers, "fingerprint": fingerprint,
    }


def oracle_sql() -> dict[str, str]:
    off = [s for s in ("nfkc", "zero_width", "confusables", "decode", "reassemble")]
    return {
        "norm_fullwidth": _stage_sql(_NFKC("text")), "norm_zero_width": _stage_sql(_ZW("text")), "norm_confusables": _stage_sql(_CONF("text")), "norm_whitespace": _stage_sql(_WS("text")), "norm_casefold": _stage_sql(_FOLD("text")), "norm_characters": _stage_sql(_CHAR),
        "decode_rot13_reverse": _stage_sql(f"translate(text, '{N.ROT13_FROM}', '{N.ROT13_TO}') || '|' || array_to_string(list_reverse(regexp_extract_all(text, '(?s).')), '')"),
        "reassemble": f"WITH {MESSAGES_SQL}, v AS (SELECT doc_id, text, {_values('text')} AS vs FROM m) SELECT doc_id, CASE WHEN len(vs) < 2 OR contains(text, array_to_string(vs, ' ')) THEN text ELSE text || chr(10) || array_to_string(vs, ' ') END AS out FROM v",
        "stopword_density": f"WITH {MESSAGES_SQL} SELECT doc_id, round(CASE WHEN len({_DENSITY_WORDS}) < 4 THEN 0.0 ELSE CAST(len(list_filter({_DENSITY_WORDS}, lambda w: list_contains([{', '.join(map(sql_text, N.FUNCTION_WORDS))}], w))) AS DOUBLE) / len({_DENSITY_WORDS}) END, 9) AS density FROM m",
        "printable_ratio": f"WITH {MESSAGES_SQL} SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE 1 - CAST(len(regexp_extract_all(replace(replace(replace(text, chr(10), ''), chr(9), ''), ' ', ''), '[\\p{{Cc}}\\p{{Co}}\\p{{Z}}]')) AS DOUBLE) / length(text) END, 9) AS ratio FROM m",
        "normalize_fold_disabled": f"WITH {MESSAGES_SQL} SELECT doc_id, {_FOLD(_WS('text'))} AS norm, 'whitespace,casefold' AS applied, '{','.join(off)}' AS skipped FROM m",
        "rule_hits": f"{_FULL}, " + _RULE_TABLE + f", h AS (SELECT doc_id, norm, unnest({_HITS}) AS pos FROM c), x AS (SELECT doc_id, norm, pos, CASE pos " + " ".join(f"WHEN {i} THEN regexp_extract(norm, {sql_text(plain_regex(r.pattern))})" for i, r in enumerate(RULES)) + " END AS w, CASE pos " + " ".join(f"WHEN {i} THEN length(list_extract(string_split_regex(norm, {sql_text(plain_regex(r.pattern))}), 1))" for i, r in enumerate(RULES)) + " END AS s FROM h) SELECT doc_id, rule_id, weight, CAST(s AS BIGINT) AS start, CAST(s + length(w) AS BIGINT) AS \"end\", left(w, 120) AS matched FROM x JOIN r USING (pos)",
        "rules_for_fold": f"{_FULL}, " + _RULE_TABLE + f", h AS (SELECT pos, count(*) AS n FROM (SELECT unnest({_HITS}) AS pos FROM c) GROUP BY pos) SELECT family, string_agg(rule_id, ',' ORDER BY rule_id) AS disabled, CAST(sum(coalesce(n, 0)) AS BIGINT) AS hits_lost FROM r LEFT JOIN h USING (pos) GROUP BY family",
        "signal_table": f"{_FULL} SELECT doc_id, " + ", ".join(f"round({sql}, 9) AS {name.split('.')[1]}" for name, sql in _SIGNALS.items()) + " FROM c",
        "char_layer_scores": f"{_HEAD}, l AS (SELECT doc_id, {_RULE_LAYER} AS r, {_SIGNAL_LAYER} AS s FROM c) SELECT doc_id, round(r, 6) AS rules, round(s, 6) AS signals, round(1 - (1 - 0.9::DOUBLE * r) * (1 - 0.65::DOUBLE * s), 6) AS decision, round(1 - (1 - 0.9::DOUBLE * r) * (1 - 0.65::DOUBLE * s), 6) AS combined FROM l",
        "decision_by_rules": f"{_FULL}, l AS (SELECT source, 0.9::DOUBLE * ({_RULE_LAYER}) AS score FROM c) SELECT source, CASE WHEN score >= 0.54 THEN 'block' WHEN score >= 0.4 THEN 'flag' ELSE 'allow' END AS decision, count(*) AS n FROM l GROUP BY ALL",
        "decode_round": f"WITH {MESSAGES_SQL} SELECT doc_id, array_to_string({_BASE64('text')}, '|') AS base64, array_to_string({_HEX('text')}, '|') AS hex, len({_SUBST('text')}) AS n_substitutions FROM m",
        "normalize_pipeline": f"{_FULL} SELECT doc_id, norm, 'nfkc,zero_width,confusables,whitespace,decode,reassemble,casefold' || CASE WHEN grew THEN ',nfkc:2,zero_width:2,confusables:2,casefold:2' ELSE '' END AS applied, length(norm) > length({_FOLD(_WS('text'))}) AS expanded FROM c",
        "rule_counts": f"{_FULL}, {_RULE_TABLE}, h AS (SELECT unnest({_HITS}) AS pos FROM c) SELECT rule_id, count(*) AS n FROM h JOIN r USING (pos) GROUP BY rule_id",
        "layer_scores": f"{_LAYERS} SELECT doc_id, round(r, 6) AS rules, round(s, 6) AS signals, round(score, 6) AS decision, round(score, 6) AS combined FROM d",
        "decision_monitor": _decided(False), "decision_enforce": _decided(True),
        "nfkc_exact": f"{_FULL} SELECT doc_id, norm FROM c",
        "verdict_reasons": f"{_FULL}, v AS (SELECT doc_id, {_HITS} AS hits, {_RULE_LAYER} AS r, " + ", ".join(f"({sql})::DOUBLE AS s{i}" for i, sql in enumerate(_SIGNALS.values())) + " FROM c), d AS (SELECT doc_id, 1 - (1 - 0.9::DOUBLE * r) * (1 - 0.65::DOUBLE * (1 - " + " * ".join(f"(1 - CAST({x.weight} AS DOUBLE) * s{i})" for i, x in enumerate(SIGNALS)) + ")) AS score, array_to_string(list_concat(list_transform(hits, lambda i: list_extract([" + ", ".join(f"'{r.name}'" for r in RULES) + "], i + 1)), list_filter([" + ", ".join(f"CASE WHEN s{i} >= {S.REASON_FLOOR} THEN '{x.name}=' || printf('%.2f', round(s{i}, 2)) END" for i, x in enumerate(SIGNALS)) + "], lambda x: x IS NOT NULL)), ',') AS reasons FROM v) SELECT doc_id, reasons, CASE WHEN score >= 0.5 THEN 'flag' ELSE 'allow' END || ' at ' || printf('%.3f', round(score, 3)) || ' (' || CASE WHEN reasons = '' THEN 'no reasons' ELSE replace(reasons, ',', ', ') END || ')' AS explanation FROM d",
        "five_layers": f"{_FULL}, {keys_sql('SELECT doc_id, norm AS text FROM c')}, x AS (SELECT doc_id, sum(n * {CLOSED_FORM_SQL}) / CASE WHEN sqrt(sum(n * n)) > 0 THEN sqrt(sum(n * n)) ELSE 1 END + 0.25 AS z FROM f GROUP BY doc_id), l AS (SELECT doc_id, {_RULE_LAYER} AS r, {_SIGNAL_LAYER} AS s, 1 / (1 + exp(-coalesce(z, 0.25))) AS m FROM c LEFT JOIN x USING (doc_id)) SELECT doc_id, round(r, 6) AS rules, round(s, 6) AS signals, round(m, 6) AS model, round(1 - (1 - 0.9::DOUBLE * r) * (1 - 0.65::DOUBLE * s) * (1 - 0.95::DOUBLE * m), 6) AS combined, round(m, 6) AS decision FROM l",
        "fingerprint": f"WITH {MESSAGES_SQL} SELECT doc_id, 'sha256:' || left(sha256('pepper' || chr(0) || text), 32) AS fingerprint, length(text) AS length FROM m",
    }


assert len(FAMILIES) == 12
