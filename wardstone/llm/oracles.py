"""DuckDB SQL that the training-data queries are checked against, over the same tables."""

from __future__ import annotations

from wardstone.llm import license, secrets

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: c(a, b): b is reachable from a over links(a, b), which holds each link both ways
_REACHED = "c(a, b) AS (SELECT a, b FROM links UNION SELECT c.a, l.b FROM c JOIN links l ON c.b = l.a)"

OP2 = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND p.norm > 0 AND q.norm > 0 AND len(p.x) = len(q.x) WHERE list_dot_product(p.x, q.x) / (p.norm * q.norm) >= 0.95),
{_REACHED},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), m AS (SELECT a, min(b) AS low FROM c GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id"""

OP7 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(5, len(w)) AS k FROM w WHERE len(w) > 0))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS shared FROM s JOIN s t ON s.g = t.g AND s.doc_id <> t.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
{_REACHED}, m AS (SELECT a, min(b) AS low FROM c GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, w.doc_id <= coalesce(low, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id"""


def _spans(kind: str, pattern: str, keep: str) -> str:
    """(doc_id, kind, start, end) of the matches of a pattern that pass a test of m, the match, and v, its second group."""
    group = 2 if kind == "assign" else 0
    return f"""SELECT doc_id, '{kind}' AS kind, e - length(m) AS s, e FROM (SELECT doc_id, m, v, sum(length(m) + length(g)) OVER (PARTITION BY doc_id ORDER BY i) AS e
  FROM (SELECT doc_id, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(v) AS v, unnest(list_slice(g, 1, len(m))) AS g
        FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS m, regexp_extract_all(text, {pattern}, {group}) AS v, string_split_regex(text, {pattern}) AS g FROM t WHERE regexp_matches(text, {pattern})))) WHERE {keep}"""


_KINDS = {
    "assign": (_quoted(secrets.PATTERNS["assign"][0]), "length(v) >= 8"),
    "access": ("'AKIA[A-Z0-9]+'", "length(m) >= 16"),
    "hex": ("'[0-9a-f]+'", "length(m) >= 32"),
    "weak_id": ("'[A-Za-z0-9]+'", "regexp_full_match(m, '[A-Z0-9]{20}') AND regexp_matches(m, '[0-9]')"),
    "weak_secret": ("'[A-Za-z0-9+/]+'", "length(m) = 40 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')"),
    "endpoint": (_quoted(secrets.PATTERNS["endpoint"][0].replace(r"\s", r"\t\n\x0B\f\r\x20")), "true"),
}
_PARTS = ", ".join(f"('{weak}', '{part}')" for weak, own in secrets.COMPLEMENTS.items() for part in own)
_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(secrets.PATTERNS)) + " END"
_STRONG = ", ".join(map(_quoted, secrets.STRONG))
OP3 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS MATERIALIZED ({" UNION ALL ".join(_spans(k, p, keep) for k, (p, keep) in _KINDS.items())}),
need(weak, part) AS (VALUES {_PARTS}),
linked AS (SELECT DISTINCT w.* FROM x w JOIN need ON w.kind = weak JOIN x p ON p.doc_id = w.doc_id AND p.kind = part AND abs(p.s - w.s) <= {secrets.SCOPE}),
spans AS (SELECT * FROM x WHERE kind IN ({_STRONG}) UNION ALL SELECT * FROM linked l WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = l.doc_id AND x.kind IN ({_STRONG}) AND l.s < x.e AND x.s < l.e)),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.STRONG)},
  string_agg(concat_ws(':', kind, CAST(s AS BIGINT), CAST(e AS BIGINT)), ',' ORDER BY s, {_RANK}) FILTER (kind IN ({_STRONG})) AS base, string_agg(concat_ws(':', kind, CAST(s AS BIGINT), CAST(e AS BIGINT)), ',' ORDER BY s, {_RANK}) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.STRONG)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)"""


def _grams(texts: dict[str, str], k: int) -> str:
    rows = []
    for label, text in texts.items():
        w = text.split()
        rows += [f"('{label}', {len(w) - k + 1}, {t}, {_quoted(' '.join(w[t : t + k]))})" for t in range(len(w) - k + 1)]
    return ", ".join(rows)


_K, _P = license.TEXT_GRAM, license.PHRASE_GRAM
OP9 = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, len(w) AS n, i, array_to_string(list_slice(w, i, i + {_P - 1}), ' ') AS short, array_to_string(list_slice(w, i, i + {_K - 1}), ' ') AS long FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
ph(label, grams, t, gram) AS (VALUES {_grams(license.PHRASES, _P)}), tx(label, grams, t, gram) AS (VALUES {_grams(license.TEXTS, _K)}),
place AS (SELECT doc_id, label, i - 1 - t AS spot FROM p JOIN ph ON short = gram AND i + {_P - 1} <= n GROUP BY doc_id, label, i - 1 - t, grams HAVING count(*) = grams),
b AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word FROM place GROUP BY doc_id),
v AS MATERIALIZED (SELECT doc_id, label, grams, i - 1 AS pos, t, i - 1 - t AS diagonal FROM p JOIN tx ON long = gram AND i + {_K - 1} <= n),
l AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, label ORDER BY diagonal) <= {license.DRIFT} THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT doc_id, label, diagonal FROM v)),
m AS (SELECT doc_id, label, diagonal, sum(new) OVER (PARTITION BY doc_id, label ORDER BY diagonal) AS copy FROM l),
vc AS MATERIALIZED (SELECT v.*, copy FROM v JOIN m USING (doc_id, label, diagonal)),
cp AS (SELECT doc_id, label, copy, count(DISTINCT x) AS words FROM (SELECT doc_id, label, copy, unnest(range(pos, pos + {_K})) AS x FROM vc) GROUP BY ALL),
ct AS (SELECT doc_id, label, copy, count(DISTINCT x) AS words FROM (SELECT doc_id, label, copy, unnest(range(t, t + {_K})) AS x FROM vc) GROUP BY ALL),
c AS (SELECT doc_id, label, least(CAST(any_value(cp.words) AS DOUBLE) / (max(pos) + {_K} - min(pos)), CAST(any_value(ct.words) AS DOUBLE) / (any_value(grams) + {_K - 1})) AS share FROM vc JOIN cp USING (doc_id, label, copy) JOIN ct USING (doc_id, label, copy) GROUP BY doc_id, label, copy),
ok AS (SELECT * FROM c WHERE share >= {license.SHARE}),
bl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM place UNION ALL SELECT doc_id, label FROM ok) GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS share FROM ok GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
  CASE WHEN n_base IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN bl ON bl.doc_id = d.doc_id LEFT JOIN al ON al.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id"""

OP11 = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
v AS MATERIALIZED (SELECT vec_id, label, list_transform(x, lambda y: floor(256 * y)) AS x FROM e WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

OP13 = rf"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
t AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
n AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id),
c AS MATERIALIZED (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
g AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM d, c),
s AS (SELECT item_id, t.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN g USING (term) JOIN t USING (term) JOIN n USING (doc_id), c GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""
