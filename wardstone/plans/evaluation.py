"""Queries over scored rows: intervals, confusion, calibration, overlap, audit and the gate.

Documents with labels stand for the evaluation corpus: toxic ones are attacks, the source is the family and a
fixed function of the id is the score. Events stand for the audit log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.operators import merkle
from wardstone.operators import metrics as M
from wardstone.operators import ranklog as R
from wardstone.operators import samples as P
from wardstone.tables import read_table, shared_path

SCORE = "(doc_id * 7919 % 1000) / 1000.0D"


def _attack():
    return F.col("toxic") == 1


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "labels").where("toxic is not null").join(read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return rows.select("doc_id", "toxic", "lang", F.col("source").alias("family"), F.expr(SCORE).alias("score"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    attack = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return docs.select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("sample_id"), "text", F.when(attack, "attack").otherwise("benign").alias("label"), F.when(attack, F.col("source")).otherwise("").alias("family"), F.when(attack & (F.col("doc_id") % 5 != 0), "").otherwise(F.col("lang")).alias("kind"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def wilson_by_group(spark, sf_dir):
    return _rounded(M.rate_by_group(scored(spark, sf_dir), "family", _attack()))


def bypass_by_group(spark, sf_dir):
    return _rounded(M.rate_by_group(scored(spark, sf_dir).where(_attack()), "family", F.col("score") < 0.5))


def flag_rate_by_group(spark, sf_dir):
    return _rounded(M.rate_by_group(scored(spark, sf_dir).where(~_attack()), "lang", F.col("score") >= 0.5))


def confusion_at_threshold(spark, sf_dir):
    return _rounded(M.rates(scored(spark, sf_dir).groupBy("lang").agg(*M.confusion(_attack(), F.col("score"), 0.5))))


def roc_auc(spark, sf_dir):
    return _rounded(M.roc_auc(scored(spark, sf_dir), _attack(), "score", ("lang",)))


def roc_auc_overall(spark, sf_dir):
    return _rounded(M.roc_auc(scored(spark, sf_dir), _attack(), "score"))


def calibrate_threshold(spark, sf_dir):
    return M.threshold_at_fpr(scored(spark, sf_dir).where(~_attack()), "score", 0.01, ("lang",))


def _logged(spark, sf_dir):
    """The scores' counts, added to a log in seven parts as if by days."""
    path, rows = shared_path(spark, "rank-log"), scored(spark, sf_dir)
    for day in range(7):
        R.add_day(rows.where(F.pmod("doc_id", F.lit(7)) == day), path, str(day), _attack(), "score", ("lang",))
    return R.read_log(spark, path, ("lang",))


def auc_from_log(spark, sf_dir):
    return _rounded(R.auc(_logged(spark, sf_dir), ("lang",)))


def threshold_from_log(spark, sf_dir):
    return R.threshold(_logged(spark, sf_dir), 0.01, ("lang",))


def benign_halves(spark, sf_dir):
    rows = M.with_position(scored(spark, sf_dir).where(~_attack()), "doc_id")
    return rows.groupBy((F.col("position") % 2).alias("half")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.round(F.avg("score"), 9).alias("mean_score"))


def control_stride(spark, sf_dir):
    rows = M.with_position(scored(spark, sf_dir).where(_attack()), "doc_id")
    return rows.where("position % 12 = 0").select("doc_id", "family", "position")


def fold_scores(spark, sf_dir):
    """Every language as a held-out fold: calibrate on the even half of its benign rows, measure on the odd half and its attacks."""
    rows = scored(spark, sf_dir)
    benign = M.with_position(rows.where(~_attack()), "doc_id", ("lang",))
    limit = M.threshold_at_fpr(benign.where("position % 2 = 0"), "score", 0.05, ("lang",))
    measured = benign.where("position % 2 = 1").select("lang", "toxic", "score").unionByName(rows.where(_attack()).select("lang", "toxic", "score"))
    flagged = F.coalesce(F.col("score") > F.col("boundary"), F.lit(True))
    out = measured.join(F.broadcast(limit), "lang").groupBy("lang").agg(F.count_if(_attack() & ~flagged).alias("missed"), F.count_if(_attack()).alias("attacks"), F.count_if(~_attack() & flagged).alias("false_positives"), F.count_if(~_attack()).alias("benign"))
    return _rounded(out.withColumn("i", M.wilson(F.col("missed"), F.col("attacks"))).select("lang", "missed", "attacks", "false_positives", "benign", "i.point", "i.low", "i.high"))


def pooled_bypass(spark, sf_dir):
    """Pooled bypass over families, and the worst of them (the first of equals)."""
    by = scored(spark, sf_dir).where(_attack()).groupBy("family").agg(F.count_if(F.col("score") < 0.5).alias("fn"), F.count("*").alias("n"))
    pooled = by.agg(F.sum("fn").alias("fn"), F.sum("n").alias("n"), F.min(F.struct((-F.col("fn") / F.col("n")).alias("bypass"), "family")).alias("worst"))
    return _rounded(pooled.withColumn("i", M.wilson(F.col("fn"), F.col("n"))).select("fn", "n", "i.point", "i.low", "i.high", F.col("worst.family").alias("worst"), (-F.col("worst.bypass")).alias("worst_bypass")))


def baseline_gate(spark, sf_dir):
    rows = scored(spark, sf_dir)
    per = lambda df: M.rates(df.groupBy("family").agg(*M.confusion(_attack(), F.col("score"), 0.5))).select("family", "bypass", (F.col("false_positive_rate") / 20).alias("false_positive_rate"))
    return _rounded(M.gate(per(rows.where("family <> 'src5'")), per(rows.where("family <> 'src3' and doc_id % 2 = 0"))))


def overlap_semi(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return P.shared_texts(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0")).select("doc_id")


def overlap_anti(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return P.shared_texts(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), keep=False).groupBy("lang").agg(F.count("*").alias("n"))


def corpus_counts(spark, sf_dir):
    return P.counts(samples(spark, sf_dir))


def validate_samples(spark, sf_dir):
    return samples(spark, sf_dir).select(P.error_code().alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def sample_digests(spark, sf_dir):
    return P.line_digests(samples(spark, sf_dir), ("label", "sample_id", "text"))


def digest_leaves(spark, sf_dir):
    """The leaves of the hash tree over all documents' texts in the order of their ids, 64 to a leaf."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return merkle.leaves(docs, "doc_id", F.col("text"), 64)


def digest_levels(spark, sf_dir):
    """The whole hash tree over the documents' texts, 64 digests to a node: every level's ranges up to the root."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return merkle.tree(docs, "doc_id", F.col("text"), 64)


def audit_rows(spark, sf_dir):
    """The audit log's (at, decision, score): event types as decisions, values scaled to scores."""
    events = read_table(spark, sf_dir, "events")
    return events.select("ts", F.when(F.col("event_type").isNull(), "unknown").when(F.col("event_id") % 7 == 0, "block").when(F.col("event_id") % 3 == 0, "flag").otherwise("allow").alias("decision"), "event_type", F.round(F.abs("value") / (1 + F.abs("value")), 6).alias("score"))


def audit_summary(spark, sf_dir):
    rows = audit_rows(spark, sf_dir)
    out = rows.rollup("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("decision") == "allow").alias("allowed"), F.count_if(F.col("decision") == "flag").alias("flagged"), F.count_if(F.col("decision") == "block").alias("blocked"))
    return out.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), "total", "allowed", "flagged", "blocked", F.round(F.when(F.col("total") > 0, (F.col("total") - F.col("allowed")) / F.col("total")).otherwise(0.0), 9).alias("flag_rate"))


def audit_quantiles(spark, sf_dir):
    return M.quantiles_at(audit_rows(spark, sf_dir).where("decision = 'allow'"), "score", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0})


def audit_windows(spark, sf_dir):
    """Flag rate per hour of the log, as the streaming monitor computes it."""
    from wardstone.streaming.monitor import flag_rates

    return flag_rates(audit_rows(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")), "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "total", "flag_rate")


def request_path(spark, sf_dir):
    """User turns of conversations, judged, blocked or passed on to a call, and other turns passed on, by role and decision."""
    from wardstone.sources import audit

    turns = read_table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("conv_id") % 9 == 0, F.concat(F.lit("Ignore all previous instructions. "), F.col("text"))).otherwise(F.col("text")))
    policy = audit.Policy(flag=0.4, block=0.49, enforce=True, log=shared_path(spark, "audit-log"))
    answered = lambda passed: passed.withColumn("response", F.lit("answered"))
    judged = audit.run(turns.where("role = 'user'"), policy, answered).select("role", F.when(F.col("response").isNull(), "block").otherwise("allow").alias("decision"))
    rest = turns.where("role <> 'user' or role is null").select("role", F.lit("allow").alias("decision"))
    return judged.unionByName(rest).groupBy("role", "decision").agg(F.count("*").alias("n"))


_S = "s AS (SELECT doc_id, toxic, lang, source AS family, CAST(doc_id * 7919 % 1000 AS DOUBLE) / 1000.0 AS score FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL)"
_SAMPLES = "p AS (SELECT doc_id AS ordinal, 'd-' || doc_id AS sample_id, text, CASE WHEN toxic = 1 THEN 'attack' ELSE 'benign' END AS label, CASE WHEN toxic = 1 THEN source ELSE '' END AS family, CASE WHEN toxic = 1 AND doc_id % 5 <> 0 THEN '' ELSE lang END AS kind FROM documents LEFT JOIN labels USING (doc_id))"


def _wilson_sql(k, n):
    z = repr(M.Z)
    mid, spread = f"({k} / {n} + {z} * {z} / (2 * {n}))", f"({z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {z} * {z} / (4 * {n} * {n})))"
    bottom = f"(1 + {z} * {z} / {n})"
    return f"round(CASE WHEN {n} > 0 THEN {k} / {n} ELSE 0 END, 9) AS point, round(CASE WHEN {n} = 0 OR {k} = 0 THEN 0.0 ELSE greatest(0.0, ({mid} - {spread}) / {bottom}) END, 9) AS low, round(CASE WHEN {n} = 0 OR {k} = {n} THEN 1.0 ELSE least(1.0, ({mid} + {spread}) / {bottom}) END, 9) AS high"


def _rate_sql(group, hit, where="true"):
    return f"WITH {_S}, g AS (SELECT {group}, count(*) FILTER ({hit}) AS hits, count(*) AS total FROM s WHERE {where} GROUP BY 1) SELECT {group}, hits, total, {_wilson_sql('CAST(hits AS DOUBLE)', 'CAST(total AS DOUBLE)')} FROM g"


def _auc_sql(keys):
    by = f"PARTITION BY {keys} " if keys else ""
    g = f"{keys}, " if keys else ""
    return f"WITH {_S}, r AS (SELECT {g}toxic, rank() OVER ({by}ORDER BY score) + (count(*) OVER (PARTITION BY {g}score) - 1) / 2.0::DOUBLE AS rk FROM s) SELECT {g}round(CASE WHEN count(*) FILTER (toxic = 1) > 0 AND count(*) FILTER (toxic <> 1) > 0 THEN (sum(rk) FILTER (toxic = 1) - count(*) FILTER (toxic = 1) * (count(*) FILTER (toxic = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (toxic = 1) * count(*) FILTER (toxic <> 1)) ELSE 0.0 END, 9) AS auc FROM r" + (f" GROUP BY {keys}" if keys else "")


_CONF = "count(*) FILTER (toxic = 1 AND score >= 0.5) AS tp, count(*) FILTER (toxic = 1 AND score < 0.5) AS fn, count(*) FILTER (toxic <> 1 AND score >= 0.5) AS fp, count(*) FILTER (toxic <> 1 AND score < 0.5) AS tn"
_div = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END"
_AUDIT = "a AS (SELECT ts, event_type, CASE WHEN event_type IS NULL THEN 'unknown' WHEN event_id % 7 = 0 THEN 'block' WHEN event_id % 3 = 0 THEN 'flag' ELSE 'allow' END AS decision, round(abs(value) / (1 + abs(value)), 6) AS score FROM events)"


def queries() -> dict:
    found = (wilson_by_group, bypass_by_group, flag_rate_by_group, confusion_at_threshold, roc_auc, roc_auc_overall, calibrate_threshold, auc_from_log, threshold_from_log, benign_halves, control_stride, fold_scores, pooled_bypass, baseline_gate, overlap_semi, overlap_anti, corpus_counts, validate_samples, sample_digests, digest_leaves, digest_levels, audit_summary, audit_quantiles, audit_windows, request_path)
    return {f.__name__: f for f in found}


_LEAVES = "l0 AS MATERIALIZED (SELECT pos // 64 AS range, min(doc_id) AS first, count(*) AS rows, sha256(string_agg(d, '' ORDER BY pos)) AS digest FROM (SELECT doc_id, sha256(coalesce(text, '')) AS d, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) GROUP BY 1)"


def _fold_sql(i: int) -> str:
    return f"l{i + 1} AS MATERIALIZED (SELECT range // 64 AS range, min(first) AS first, CAST(sum(rows) AS BIGINT) AS rows, sha256(string_agg(digest, '' ORDER BY l{i}.range)) AS digest FROM l{i} GROUP BY l{i}.range // 64)"


_THRESHOLD_SQL = f"WITH {_S}, r AS (SELECT lang, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY lang) AS n FROM s WHERE toxic <> 1) SELECT lang, n, max(score) FILTER (k = floor(0.01 * n) + 1) AS boundary FROM r GROUP BY lang, n"


def oracle_sql() -> dict[str, str]:
    gate = lambda where: f"SELECT family, {_div('fn', 'tp + fn')} AS bypass, ({_div('fp', 'fp + tn')}) / 20 AS fpr FROM (SELECT family, {_CONF} FROM s WHERE {where} GROUP BY family)"
    return {
        "wilson_by_group": _rate_sql("family", "toxic = 1"), "bypass_by_group": _rate_sql("family", "score < 0.5", "toxic = 1"), "flag_rate_by_group": _rate_sql("lang", "score >= 0.5", "toxic <> 1"),
        "confusion_at_threshold": f"WITH {_S}, c AS (SELECT lang, {_CONF} FROM s GROUP BY lang) SELECT *, round({_div('tp', 'tp + fn')}, 9) AS recall, round({_div('fn', 'tp + fn')}, 9) AS bypass, round({_div('fp', 'fp + tn')}, 9) AS false_positive_rate, round({_div('tp', 'tp + fp')}, 9) AS \"precision\" FROM c",
        "roc_auc": _auc_sql("lang"), "roc_auc_overall": _auc_sql(""), "auc_from_log": _auc_sql("lang"), "threshold_from_log": _THRESHOLD_SQL,
        "calibrate_threshold": _THRESHOLD_SQL,
        "benign_halves": f"WITH {_S}, r AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) % 2 AS half FROM s WHERE toxic <> 1) SELECT half, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, round(avg(score), 9) AS mean_score FROM r GROUP BY half",
        "control_stride": f"WITH {_S}, r AS (SELECT doc_id, family, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM s WHERE toxic = 1) SELECT * FROM r WHERE position % 12 = 0",
        "fold_scores": f"WITH {_S}, b AS (SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 2 AS half FROM s WHERE toxic <> 1), k AS (SELECT lang, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY lang) AS n FROM b WHERE half = 0), t AS (SELECT lang, max(score) FILTER (k = floor(0.05 * n) + 1) AS boundary FROM k GROUP BY lang), m AS (SELECT lang, toxic, score FROM b WHERE half = 1 UNION ALL SELECT lang, toxic, score FROM s WHERE toxic = 1), g AS (SELECT lang, count(*) FILTER (toxic = 1 AND NOT coalesce(score > boundary, true)) AS missed, count(*) FILTER (toxic = 1) AS attacks, count(*) FILTER (toxic <> 1 AND coalesce(score > boundary, true)) AS false_positives, count(*) FILTER (toxic <> 1) AS benign FROM m JOIN t USING (lang) GROUP BY lang) SELECT lang, missed, attacks, false_positives, benign, {_wilson_sql('CAST(missed AS DOUBLE)', 'CAST(attacks AS DOUBLE)')} FROM g",
        "pooled_bypass": f"WITH {_S}, f AS (SELECT family, count(*) FILTER (score < 0.5) AS fn, count(*) AS n FROM s WHERE toxic = 1 GROUP BY family), p AS (SELECT CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(n) AS BIGINT) AS n FROM f), w AS (SELECT family AS worst, round(CAST(fn AS DOUBLE) / n, 9) AS worst_bypass FROM f ORDER BY CAST(fn AS DOUBLE) / n DESC, family LIMIT 1) SELECT fn, n, {_wilson_sql('CAST(fn AS DOUBLE)', 'CAST(n AS DOUBLE)')}, worst, worst_bypass FROM p, w",
        "baseline_gate": f"WITH {_S}, f AS ({gate('family <> ' + repr('src5'))}), o AS ({gate('family <> ' + repr('src3') + ' AND doc_id % 2 = 0')}) SELECT coalesce(f.family, o.family) AS family, CASE WHEN o.bypass IS NULL THEN 'unknown' WHEN f.bypass IS NULL THEN 'unmeasured' WHEN f.bypass > o.bypass + 0.05 THEN 'regressed' WHEN f.fpr > 0.03 THEN 'too_many_false_positives' WHEN f.bypass < o.bypass THEN 'improved' ELSE 'ok' END AS verdict, round(f.bypass - o.bypass, 9) AS change FROM f FULL JOIN o USING (family)",
        "overlap_semi": "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)",
        "overlap_anti": "SELECT lang, count(*) AS n FROM documents d WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 2 = 0 AND o.text = d.text) GROUP BY lang",
        "corpus_counts": f"WITH {_SAMPLES} SELECT coalesce(nullif(family, ''), kind) AS name, count(*) AS n FROM p GROUP BY 1",
        "validate_samples": f"WITH {_SAMPLES} SELECT CASE WHEN coalesce(length(text), 0) < 1 THEN 'text_empty' WHEN length(text) > 20000 THEN 'text_long' WHEN NOT regexp_matches(text, '\\S') THEN 'text_blank' WHEN label = 'attack' AND family = '' THEN 'attack_without_family' WHEN label = 'attack' AND kind <> '' THEN 'attack_with_kind' WHEN label = 'benign' AND kind = '' THEN 'benign_without_kind' END AS error, count(*) AS n FROM p GROUP BY 1",
        "digest_leaves": f"WITH {_LEAVES} SELECT range, first, rows, digest FROM l0",
        "digest_levels": f"WITH {_LEAVES}, {_fold_sql(0)}, {_fold_sql(1)}, {_fold_sql(2)}, {_fold_sql(3)} SELECT * FROM ({' UNION ALL '.join(f'SELECT {i} AS level, range, first, rows, digest FROM l{i} WHERE {i} = 0 OR (SELECT count(*) FROM l{max(i - 1, 0)}) > 1' for i in range(5))})",
        "sample_digests": f"WITH {_SAMPLES} SELECT ordinal, sha256(CAST(to_json({{'label': label, 'sample_id': sample_id, 'text': text}}) AS VARCHAR)) AS digest FROM p",
        "audit_summary": f"WITH {_AUDIT}, g AS (SELECT coalesce(event_type, 'all') AS event_type, count(*) AS total, count(*) FILTER (decision = 'allow') AS allowed, count(*) FILTER (decision = 'flag') AS flagged, count(*) FILTER (decision = 'block') AS blocked FROM a GROUP BY ROLLUP (event_type)) SELECT *, round(CASE WHEN total > 0 THEN CAST(total - allowed AS DOUBLE) / total ELSE 0.0 END, 9) AS flag_rate FROM g",
        "audit_quantiles": f"WITH {_AUDIT}, r AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM a WHERE decision = 'allow'), q(name, share) AS (VALUES ('p50', 0.5::DOUBLE), ('p90', 0.9), ('p99', 0.99), ('max', 1.0)) SELECT name, score AS value FROM q JOIN r ON i = least(n - 1, floor(share * (n - 1) + 0.5))",
        "audit_windows": f"WITH {_AUDIT} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS total, round(CAST(count(*) FILTER (decision <> 'allow') AS DOUBLE) / count(*), 9) AS flag_rate FROM a GROUP BY 1",
        "request_path": "SELECT role, CASE WHEN role = 'user' AND conv_id % 9 = 0 THEN 'block' ELSE 'allow' END AS decision, count(*) AS n FROM conversations GROUP BY ALL",
    }
