"""MinHash near-dedup by min-max hashing: each permutation gives its minimum and its maximum.

Plan: one pass turns every text into its shingle-set digest, size and band hashes; equal sets fold into one
class, and the classes of a band meet at its smallest id, the hub. Sets of classes that met are read once more,
as hashes. First every class is held against the hub it shares most bands with, in groups of bounded size: a large
group around one text settles there, at a cost in proportion to its size. Only bands that still hold classes of
different components go on: in each of their coarse groups the largest component is the body and the others are
stragglers, and stragglers are held against the body and each other, block by block; body against body never is.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.llm.common import broadcast_if_small, connected_components, discard, fresh, shared_table, text_batches

MISSES = 1e-6  # the most likely share of linked pairs that no band finds
VALUES = 256  # signature values, where the threshold allows
BLOCK_SHINGLES, BLOCK_ROWS = 400_000, 500  # what one verifying task holds from each of its two sides
IDS_SENT = 500_000  # ids of 24 bytes that are sent to the texts; more are joined by a shuffle
WORDS_KEPT = 50_000  # word hashes a worker remembers
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=WORDS_KEPT)
def _word(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs of non-blank characters (ASCII blanks), A-Z lower-cased. Fewer than width words make one
    shingle; null or blank texts make none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_word, words), np.uint64, len(words))
    span = min(width, len(w))
    n = len(w) - span + 1
    h = np.full(n, span, np.uint64)
    for i in range(span):
        h *= _MIX
        h += w[i : i + n]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def banding(percent: int) -> tuple[int, int]:
    """(rows, bands): the longest bands with which a pair at the threshold misses all of them with probability MISSES at most."""
    found = None
    for rows in range(1, 9):
        bands = 1 if percent >= 100 else math.ceil(math.log(MISSES) / math.log1p(-((percent / 100) ** rows)))
        if found is None or rows * bands <= VALUES:
            found = rows, bands
    return found


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def signatures(sets: list[np.ndarray], permutations: int = VALUES // 2) -> np.ndarray:
    """One row per non-empty set; columns 2j and 2j+1 hold the minimum and maximum under permutation j."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), 2 * permutations), np.uint32)
    for j, (a, b) in enumerate(zip(*_permutations(permutations), strict=True)):
        v = joined * a
        v += b
        v >>= np.uint64(32)
        v = v.astype(np.uint32)
        out[:, 2 * j] = np.minimum.reduceat(v, starts)
        out[:, 2 * j + 1] = np.maximum.reduceat(v, starts)
    return out


def band_hashes(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 64-bit hash per signature row and band, different for each band."""
    # values of one permutation's min and max go to different bands, so that a band's values stay independent
    order = np.r_[0 : signature.shape[1] : 2, 1 : signature.shape[1] : 2][: rows * bands]
    parts = signature[:, order].astype(np.uint64).reshape(len(signature), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _MIX, parts.shape[:2]).copy()
    for i in range(rows):
        h = (h ^ parts[:, :, i]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _digests(width: int, percent: int):
    rows, bands = banding(percent)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 256):  # bounded memory whatever the batch
                sets = [shingle_set(t, width) for t in texts[at : at + 256].to_pylist()]
                full = [s for s in sets if len(s)]
                found = iter(band_hashes(signatures(full, -(-rows * bands // 2)), rows, bands).tolist() if full else ())
                yield pa.RecordBatch.from_arrays(
                    [ids[at : at + 256], pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([next(found) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "digest", "n_shingles", "bands"],
                )

    return run


def _sets(width: int):
    """(rep, n, set) of texts (rep, digest, text) whose shingles are the digest's; the set as sorted 64-bit hashes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, width).tobytes() for t in part.column("text").to_pylist()]
                same = pa.array([xxhash.xxh3_128_digest(x) == d for x, d in zip(sets, part.column("digest").to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("digest"), pa.array([len(x) // 8 for x in sets], pa.int64()), pa.array(sets, pa.binary())], ["rep", "digest", "n", "set"]).filter(same)

    return run


def _star(percent: int):
    """Members (side 1) that are linked with their hub (side 0)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["side"] == 1]
        linked = np.zeros(len(own), bool)
        if len(own):
            sizes = own["n"].to_numpy()
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            values = np.frombuffer(b"".join(own["set"]), np.uint64)
            for hub in pdf.loc[pdf["side"] == 0, "set"]:  # one set, unless its id repeats with another text
                hub = np.frombuffer(hub, np.uint64)
                at = np.minimum(np.searchsorted(hub, values), len(hub) - 1)
                common = np.add.reduceat(hub[at] == values, starts, dtype=np.int64)
                linked |= 100 * common >= percent * (sizes + len(hub) - common)
        return own.loc[linked, ["rep", "hub"]].rename(columns={"rep": "src", "hub": "dst"})

    return run


def link_sets(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int, label: np.ndarray | None = None) -> np.ndarray:
    """A label per set: sets joined by chains of pairs with 100 * |a & b| >= percent * |a | b| share one.

    label: where given, sets with one label are joined already. side -1: every pair counts; else only pairs
    between side 0 and side 1. The most central sets go first, so that a group around one text settles after few
    rounds; pairs already joined are not compared.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)]
    values, local = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(local)
    central = np.add.reduceat(common[local], starts[:-1]) / sizes
    label, mark = np.arange(len(sets)) if label is None else label.copy(), np.zeros(len(values), bool)
    for hub in np.lexsort((ids, -central)):
        apart = (label != label[hub]) & (100 * np.minimum(sizes, sizes[hub]) >= percent * np.maximum(sizes, sizes[hub]))
        if side[hub] >= 0:
            apart &= side != side[hub]
        others = np.flatnonzero(apart)
        if not len(others):
            continue
        mark[local[starts[hub] : starts[hub + 1]]] = True
        if 4 * sizes[others].sum() < len(local):
            n = sizes[others]
            begin = np.r_[0, np.cumsum(n)[:-1]]
            at = np.arange(n.sum()) + np.repeat(starts[others] - begin, n)
            both = np.add.reduceat(mark[local[at]], begin, dtype=np.int64)
        else:
            both = np.add.reduceat(mark[local], starts[:-1], dtype=np.int64)[others]
        mark[local[starts[hub] : starts[hub + 1]]] = False
        linked = others[100 * both >= percent * (sizes[others] + sizes[hub] - both)]
        if len(linked):
            joined = np.unique(label[np.r_[hub, linked]])
            label[np.isin(label, joined)] = joined[0]
    return label


def _blocks(percent: int):
    """Links between different components of two blocks (sides 0 and 1) or of one (side -1)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["rep"].to_numpy()
        before = np.unique(pdf["comp"].to_numpy(), return_inverse=True)[1]
        label = link_sets(ids, [np.frombuffer(s, np.uint64) for s in pdf["set"]], pdf["side"].to_numpy(), percent, before)
        # a row for each component that joined another: its smallest id and that of what it joined
        first = pd.Series(ids).groupby(label).transform("min").to_numpy()
        low = pd.Series(ids).groupby(before).transform("min").to_numpy()
        some = (ids == low) & (low != first)
        return pd.DataFrame({"src": low[some], "dst": first[some]})

    return run


def _stragglers(met: DataFrame, star: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(src, dst): the links between components of star, over classes (rep, band, hub) that share a band; None where no band holds two."""
    joined = connected_components(star)
    comp = met.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    comp = shared_table(comp, "labelled")
    still = comp.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("band", "low")
    still = shared_table(comp.join(still, "band").select("rep", "comp", "low").distinct(), "open")
    if still.isEmpty():
        return None
    # components that meet in a band, not classes: a large group is one node, whatever its bands
    coarse = connected_components(still.select(F.col("comp").alias("src"), F.col("low").alias("dst")))
    member = still.select("rep", "comp").distinct().join(coarse.withColumnsRenamed({"node": "comp", "component": "coarse"}), "comp").join(sizes, "rep")
    member = shared_table(member.select("rep", "comp", "coarse", "n"), "member")

    by_comp = member.groupBy("coarse", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    whole = by_comp.groupBy("coarse").agg(F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"), F.max(F.struct("rows", "comp"))["comp"].alias("body"))
    # groups beyond one block; at most one for each BLOCK_ROWS classes
    large = broadcast_if_small(shared_table(whole.where((F.col("rows") > BLOCK_ROWS) | (F.col("shingles") > BLOCK_SHINGLES)).select("coarse", "body"), "large"))
    placed = member.join(large, "coarse", "left")
    role = F.when(F.col("body").isNull(), 2).otherwise((F.col("comp") != F.col("body")).cast("int"))
    step = F.when(F.col("body").isNull(), 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / math.log(100 / min(percent, 99)))).cast("int")
    placed = placed.select("rep", "comp", "coarse", "n", role.alias("role"), step.alias("step"))
    parts = placed.where("role < 2").groupBy("coarse", "role", "step").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts")).where("parts > 1")
    placed = placed.join(broadcast_if_small(shared_table(parts, "parts")), ["coarse", "role", "step"], "left")
    placed = placed.withColumn("block", F.concat_ws("-", "role", "step", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1)).cast("long")).cast("string")))
    placed = shared_table(placed.select("rep", "comp", "coarse", "n", "role", "block"), "placed")

    block = placed.groupBy("coarse", "role", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = block.select("coarse", F.col("role").alias("role2"), F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = block.join(other, "coarse").where(f"block <= block2 and not (role = 0 and role2 = 0) and 100 * high >= {percent} * low2 and 100 * high2 >= {percent} * low")
    side = lambda n, name: F.struct(F.lit(n).alias("side"), F.col(name).alias("block"))
    sides = F.when(F.col("block") == F.col("block2"), F.array(side(-1, "block"))).otherwise(F.array(side(0, "block"), side(1, "block2")))
    sides = pairs.select("coarse", F.col("block").alias("i"), F.col("block2").alias("j"), F.explode(sides).alias("s")).select("coarse", "i", "j", "s.side", "s.block")
    task = placed.join(sides, ["coarse", "block"]).select("rep", "comp", "coarse", "i", "j", "side")
    return task.join(sets.select("rep", "set"), "rep").groupBy("coarse", "i", "j").applyInPandas(_blocks(percent), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Documents whose shingle sets have 100 * intersection >= percent * union are linked; component_id is the
    smallest id reachable by links. Null or blank texts have no shingles and link with nothing; a row with a
    null id links with nothing, has a null component_id and is kept. Repeated rows share a component, each
    returned; an id that repeats with other texts is one document, which links by either. Other columns of docs
    are ignored; an empty table gives no rows.
    """
    own = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    digest = shared_table(own.mapInArrow(_digests(width, percent), "doc_id long, digest binary, n_shingles long, bands array<long>"), "digests")
    classes = digest.where("doc_id is not null and n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = shared_table(classes, "classes")

    banded = classes.select("rep", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("band", "hub")
    met = shared_table(banded.join(hubs, "band"), "met")
    member = shared_table(met.select("rep").distinct().join(classes.select("rep", "digest", "n"), "rep"), "members")
    texts = own.withColumnRenamed("doc_id", "rep").join(broadcast_if_small(member.select("rep", "digest"), IDS_SENT), "rep").select("rep", "digest", "text")
    sets = texts.mapInArrow(_sets(width), "rep long, digest binary, n long, set binary").dropDuplicates(["rep", "digest"])
    sets = shared_table(sets.select("rep", "n", "set"), "sets")
    sizes = shared_table(sets.groupBy("rep").agg(F.max("n").alias("n")), "sizes")

    shared = met.where("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("bands"))
    best = shared.groupBy("rep").agg(F.max(F.struct("bands", (-F.col("hub")).alias("low")))["low"].alias("hub")).select("rep", (-F.col("hub")).alias("hub"))
    best = shared_table(best.join(sizes, "rep"), "best")
    parts = best.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    many = broadcast_if_small(shared_table(parts.where("parts > 1"), "parts"))  # at most one hub for each BLOCK_ROWS classes
    rays = best.select("rep", "hub").join(many, "hub", "left").select("rep", "hub", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1)).cast("long")).alias("part"), F.lit(1).alias("side"))
    centres = parts.select(F.col("hub").alias("rep"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), F.lit(0).alias("side"))
    star = rays.unionByName(centres).join(sets, "rep").groupBy("hub", "part").applyInPandas(_star(percent), "src long, dst long")
    star = shared_table(star, "star")
    rest = _stragglers(met, star, sizes, sets, percent)
    linked = connected_components(star if rest is None else shared_table(star.unionByName(rest), "links"))
    discard(met, member, sets, sizes, best)

    classed = classes.select("digest", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    classed = shared_table(classed, "classed")
    named = digest.select("doc_id", "digest", "n_shingles").join(classed, "digest", "left").withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each component of docs, in all columns: the one with the smallest id.

    Of rows that repeat an id and a text one stays; rows with a null id stay, null and blank texts link with
    nothing and stay. Column names may be any; an empty table gives no rows.
    """
    [own] = fresh(docs, "of")
    found = near_duplicates(docs, percent=percent).where("doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.max("kept").alias("kept"))
    gone = shared_table(found.where("not kept").select(own), "gone")  # the smaller side: ids that go, not those that stay
    same = F.col("doc_id").cast("long") == F.col(own)
    rows = docs.where("doc_id is not null").join(gone, same, "left_anti")
    repeated = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(own)).count().where("count > 1").select(own)
    if not repeated.isEmpty():
        repeated = shared_table(repeated, "repeated")
        rows = rows.join(repeated, same, "left_anti").unionByName(rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return rows.unionByName(docs.where("doc_id is null"))
