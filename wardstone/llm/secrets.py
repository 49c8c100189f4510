"""Secret scans with multipart credential linking (DataFrame functions only).

Strong patterns (assignments, access identifiers, long hex runs) are secrets by themselves. Weak parts
(identifier-like, secret-like and endpoint strings) are reported only where a complementary part lies within
one scope: an interval join of parts with parts on cells of the scope's width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstone.llm.common import shared_table

SCOPE = 400  # code points between the starts of parts that belong together

#: kind -> (pattern, fewest characters, group that has them); the first three are the strong kinds, in report order
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    "access": (r"AKIA[A-Z0-9]{12,}", 16, 0),  # maximal runs of 16 characters and more
    "hex": (r"[0-9a-f]{32,}", 32, 0),
    "weak_id": (r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])[A-Z0-9]{20}(?![A-Za-z0-9])", 20, 0),
    "weak_secret": (r"(?<![A-Za-z0-9+/])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])", 40, 0),
    "endpoint": (r"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|jdbc:[a-z]+)://[^\s"'<>]+""", 8, 0),
}
STRONG = ("assign", "access", "hex")
#: What a weak kind needs nearby
COMPLEMENTS = {"weak_id": ("assign", "hex", "weak_secret"), "weak_secret": ("access", "weak_id"), "endpoint": ("assign", "access", "hex")}


def _found(kind: str) -> Column:
    """Array of struct(kind, at, gap, size, value) of one kind's matches; gap is the length of the text since the match before.

    Each expression over the text stands outside the lambda, where it is evaluated once for the text.
    """
    pattern, _, group = PATTERNS[kind]
    text, regex = F.col("text"), F.lit(pattern)
    parts = [F.regexp_extract_all(text, regex, F.lit(0)).alias("match"), F.split(text, pattern, -1).alias("gap")]
    if group:
        parts.append(F.regexp_extract_all(text, regex, F.lit(group)).alias("value"))
    rows = F.transform(F.arrays_zip(*parts), lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.length(m["gap"]).alias("gap"), F.length(m["match"]).alias("size"), F.length(m["value" if group else "match"]).alias("value")))
    rows = F.filter(rows, lambda m: m["size"].isNotNull())  # the text after the last match
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:string,at:int,gap:int,size:int,value:int>>"))


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_hash, kind, start, end) of every reported span; code points, end exclusive, one row per distinct span.

    Matches of a kind are leftmost and do not overlap; those too short for their kind are dropped. Null texts have
    none; rows that repeat an id and a text give their spans once; spans of equal start and end but other kinds all
    count; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    parts = rows.select("doc_id", "text_hash", F.concat(*map(_found, PATTERNS)).alias("found")).where(F.size("found") > 0).dropDuplicates(["doc_id", "text_hash"])
    parts = parts.select("doc_id", "text_hash", F.inline("found"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("doc_id", "text_hash", "kind").orderBy("at"))
    least = F.create_map(*[F.lit(x) for kind, (_, n, _) in PATTERNS.items() for x in (kind, n)])
    spans = parts.withColumn("end", end).where(F.col("value") >= least[F.col("kind")]).select("doc_id", "text_hash", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    spans = shared_table(spans, "spans")
    cell = lambda at: F.floor(at / scope).cast("long")
    cells = F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))).alias("cell")  # those that a span lies in
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"]) & (a["cell"] == b["cell"])

    kinds = F.array(*[F.struct(F.lit(weak).alias("needs"), F.lit(part).alias("kind")) for weak, own in COMPLEMENTS.items() for part in own])
    needs = spans.select("doc_id", "text_hash", F.col("kind").alias("part"), F.col("start").alias("near"), F.explode(kinds).alias("k")).where("part = k.kind").select("doc_id", "text_hash", F.col("k.needs").alias("kind"), "near")
    needs = needs.select("*", F.explode(F.array(*[cell(F.col("near")) + i for i in (-1, 0, 1)])).alias("cell"))
    weak = spans.where(~F.col("kind").isin(*STRONG)).withColumn("cell", cell(F.col("start")))
    linked = weak.join(needs.hint("merge"), same(weak, needs) & (weak["kind"] == needs["kind"]) & (F.abs(weak["start"] - needs["near"]) <= scope), "left_semi").drop("cell")
    linked = shared_table(linked, "linked")
    # what a strong span covers is reported once, by the strong span
    placed = linked.select("*", cells)
    covered = spans.where(F.col("kind").isin(*STRONG)).select("doc_id", "text_hash", F.col("start").alias("s2"), F.col("end").alias("e2"), cells)
    hidden = placed.join(covered.hint("merge"), same(placed, covered) & (placed["start"] < covered["e2"]) & (covered["s2"] < placed["end"]), "left_semi").drop("cell").distinct()
    alike = linked["doc_id"].eqNullSafe(hidden["doc_id"])
    for c in ("text_hash", "kind", "start", "end"):
        alike = alike & (linked[c] == hidden[c])
    shown = linked.join(hidden.hint("merge"), alike, "left_anti")
    return spans.where(F.col("kind").isin(*STRONG)).unionByName(shown)


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans) of every row of docs.

    base and spans list kind:start:end by start, then kind, comma-joined: the strong spans, and all of them.
    A null text is empty; rows that repeat, also with one id and different texts, get their own text's spans.
    Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.create_map(*[F.lit(x) for i, kind in enumerate(PATTERNS) for x in (kind, i)])
    found = secret_spans(docs, scope).groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash")).agg(F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("rank"), "end", "kind"))).alias("found"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    rows = texts.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left")
    count = lambda kind: F.coalesce(F.size(F.filter("found", lambda s: s.kind == kind)), F.lit(0)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    strong = F.filter("found", lambda s: s["rank"] < len(STRONG))
    some = F.col("found").isNotNull()
    return rows.select("doc_id", *[F.when(some, count(k)).otherwise(0).cast("long").alias(f"n_{k}") for k in STRONG], F.when(some, listed(strong)).otherwise("").alias("base"), F.when(some, listed(F.col("found"))).otherwise("").alias("spans"))
