"""Token-id output: raw id shards in id order, and a minimal perfect hash index from document keys to them.

A shard is the ids of its documents end to end, little-endian, 16 bits wide where the vocabulary allows, else
32. The index is split into buckets by key hash; a bucket file maps each of its n keys to one of n slots
without gaps, and a slot holds the key's fingerprint, shard, offset and length, so a lookup reads one
displacement and one slot. Files lie in any folder that Spark's executors share; each is written under a
temporary name and moved into place, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardstone.llm.common import broadcast_if_small, shared_table, text_batches

KEYS_PER_BUCKET = 50_000
SHARD_BYTES, LEAST_SHARD = 32 << 20, 1 << 20  # bytes of text in a shard, on average; at least where shards are made for more cores
READ_BYTES = 8 << 20  # that are read from a shard at a time
WORDS_KEPT = 500_000  # encoded words a worker remembers, from task to task
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u4")])
_GOLD = np.uint64(0x9E3779B97F4A7C15)


# -- files -----------------------------------------------------------------------------------------------


def _open(folder: str):
    return pyarrow.fs.FileSystem.from_uri(folder)


def write_file(folder: str, name: str, chunks) -> None:
    """Write a whole file under a temporary name and move it into place; a file that an earlier run of the task left there goes."""
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
    settle(fs, draft, f"{path}/{name}")


def settle(fs, draft: str, final: str) -> None:
    if fs.get_file_info(final).type != pyarrow.fs.FileType.NotFound:
        fs.delete_file(final)
    fs.move(draft, final)


# -- encoding --------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def id_width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class Encoder:
    """Whole texts to packed ids.

    Where the tokenizer's file says that white space separates words and nothing spans it, words between blanks
    encode alone, and the library encodes each distinct word once while it is remembered. Where it also lower-cases,
    composes and splits in the way of SPLIT, words of plain Latin characters go to the library's merge model run by
    run, which skips its bookkeeping of offsets. With any other settings the library encodes whole texts.
    """

    PLAIN = re.compile(r"(?!.*<\|)[\x21-\x26\x28-\x7e\u00a1-\u012f\u0131-\u024f]+")
    RUNS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    #: Settings under which the two short ways are right
    NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }

    def __init__(self, path: str, end_id: int):
        self.tok, self.known, self.runs = tokenizer(path), {}, {}
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:  # a library's own file, installed on every worker
            said = json.load(f)
        strings = [t["content"] for t in said.get("added_tokens", [])]
        self.by_word = said.get("normalizer") == self.NORMAL and said.get("pre_tokenizer") == self.SPLIT and said.get("truncation") is None and all(t.startswith("<|") and not re.search(r"\s", t) for t in strings)
        self.width = id_width(max(self.tok.get_vocab_size(), end_id + 1))
        self.end = np.array([end_id], self.width).tobytes()
        self.code = "H" if self.width == "<u2" else "I"
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = iter(range(256, 512))
        self.letters = {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}  # bytes as the model writes them

    def _run(self, run: str) -> bytes:
        found = self.runs.get(run)
        if found is None:
            if len(self.runs) > WORDS_KEPT // 2:
                self.runs.clear()
            found = self.runs[run] = array(self.code, [t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(self.letters))]).tobytes()
        return found

    def _learn(self, words: set[str]) -> None:
        others = []
        for w in words:
            if self.PLAIN.fullmatch(w):
                self.known[w] = b"".join(map(self._run, self.RUNS.findall(w.lower())))
            else:
                others.append(w)
        for w, e in zip(others, self.tok.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.known[w] = array(self.code, e.ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not self.by_word:
            return array(self.code, self.tok.encode(text or "", add_special_tokens=False).ids).tobytes() + self.end
        words = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        out = []
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            new = set(part).difference(self.known)
            if new:
                if len(self.known) + len(new) > WORDS_KEPT:
                    self.known.clear()
                    new = set(part)
                self._learn(new)
            out.append(b"".join(map(self.known.__getitem__, part)))
        out.append(self.end)
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def _write_shards(folder: str, path: str, end_id: int):
    """Write a partition's ids as one shard while its entries (doc_id, repeat, shard, at, n_tokens) stream on."""

    def run(batches):
        encode, shard = encoder(path, end_id), TaskContext.get().partitionId()
        step, at, last, seen = np.dtype(encode.width).itemsize, 0, None, 0
        fs, root = _open(folder)
        out = None
        for batch in batches:
            for first in range(0, batch.num_rows, 1_000):
                part = batch.slice(first, 1_000)
                ids = part.column(0).to_pylist()
                repeat, size = [], []
                for doc_id, text in zip(ids, part.column(1), strict=True):
                    tokens = encode(text.as_py())
                    seen = seen + 1 if doc_id == last else 0
                    last = doc_id
                    repeat.append(seen)
                    size.append(len(tokens) // step)
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        draft = f"{root}/.shard-{shard:05d}.{uuid.uuid4().hex}"
                        out = fs.open_output_stream(draft)
                    out.write(tokens)
                begin = at + np.r_[0, np.cumsum(size)]
                at = int(begin[-1])
                columns = [pa.array(ids, pa.int64()), pa.array(repeat, pa.int32()), pa.array([shard] * len(ids), pa.int32()), pa.array(begin[:-1], pa.int64()), pa.array(size, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "repeat", "shard", "at", "n_tokens"])
        if out is not None:
            out.close()
            settle(fs, draft, f"{root}/shard-{shard:05d}.bin")

    return run


# -- minimal perfect hash --------------------------------------------------------------------------------


def key_hashes(doc_id: np.ndarray, repeat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three 64-bit hashes of each (id, how many equal ids precede it)."""
    h = doc_id.astype(np.int64).view(np.uint64) * _GOLD ^ (repeat.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    out = []
    for _ in range(3):
        h = _mix(h)
        out.append(h)
        h = h + _GOLD
    return tuple(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _slots(step: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Slot of each key under its group's step: a hash of both, or the slot itself where the step is negative."""
    return np.where(step < 0, -step - 1, (_mix(own + step.astype(np.uint64) * _GOLD) % np.uint64(n)).astype(np.int64))


def build_index(doc_id: np.ndarray, repeat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slot of each key): every key gets a slot of its own among as many slots as keys.

    Keys fall into groups of four on average. Larger groups first, each tries displacements until its keys
    land on free slots; a group of one takes any free slot, stored as a negative displacement.
    """
    a, b, _ = key_hashes(doc_id, repeat)
    n, groups = len(a), max(1, len(a) // 4)
    group = (a % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    begin = np.searchsorted(group[order], np.arange(groups + 1))
    step, free = np.zeros(groups, np.int64), np.ones(n, bool)
    size = np.diff(begin)
    singles = []
    for g in np.argsort(-size, kind="stable"):
        keys = order[begin[g] : begin[g + 1]]
        if len(keys) == 0:
            break
        if len(keys) == 1:
            singles.append(g)
            continue
        tries = np.arange(64, dtype=np.int64)
        while True:
            at = _slots(np.broadcast_to(tries, (len(keys), len(tries))), b[keys][:, None], n)
            ordered = np.sort(at, axis=0)
            good = free[at].all(0) & (ordered[1:] != ordered[:-1]).all(0)
            if good.any():
                k = int(np.argmax(good))
                step[g] = tries[k]
                free[at[:, k]] = False
                break
            tries += 64
            if tries[0] > 64 * n + 4096:
                raise RuntimeError("equal keys in one index bucket")
    left = iter(np.flatnonzero(free).tolist())
    for g in singles:
        step[g] = -next(left) - 1
    return step, _slots(step[group], b, n)


def _bucket_of(doc_id, repeat, buckets: int):
    return F.pmod(F.xxhash64(doc_id, repeat), F.lit(buckets)).cast("int")


def _write_index(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc_id, repeat = pdf["doc_id"].to_numpy(), pdf["repeat"].to_numpy()
        step, slot = build_index(doc_id, repeat)
        table = np.zeros(len(slot), SLOT)
        table["print"][slot] = key_hashes(doc_id, repeat)[2] >> np.uint64(32)
        table["shard"][slot], table["offset"][slot], table["length"][slot] = pdf["shard"], pdf["at"], pdf["n_tokens"]
        bucket = int(pdf["bucket"].iloc[0])
        write_file(folder, f"index-{bucket:05d}.mph", [np.array([len(step), len(slot)], "<u8").tobytes(), step.astype("<i8").tobytes(), table.tobytes()])
        return pd.DataFrame({"bucket": [bucket], "keys": [len(slot)]})

    return run


def bucket_of(doc_id: int, repeat: int, buckets: int) -> int:
    """The bucket of a key, as Spark computes it when the index is written."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", repeat), xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42))
    return (h - (1 << 64) if h >> 63 else h) % buckets


def find(folder: str, buckets: int, doc_id: int, repeat: int = 0) -> np.void | None:
    """The slot (print, shard, offset, length) of one key, from a displacement and a slot of its bucket's file, whatever
    the sizes; None for a key that the index does not hold."""
    fs, path = _open(folder)
    name = f"{path}/index-{bucket_of(doc_id, repeat, buckets):05d}.mph"
    if fs.get_file_info(name).type == pyarrow.fs.FileType.NotFound:
        return None
    a, b, c = key_hashes(np.array([doc_id]), np.array([repeat]))
    with fs.open_input_file(name) as f:
        groups, n = np.frombuffer(f.read_at(16, 0), "<u8")
        step = np.frombuffer(f.read_at(8, 16 + 8 * int(a[0] % groups)), "<i8")
        slot = np.frombuffer(f.read_at(SLOT.itemsize, 16 + 8 * int(groups) + SLOT.itemsize * int(_slots(step, b, int(n))[0])), SLOT)[0]
    return slot if slot["print"] == c[0] >> np.uint64(32) else None


def read_document(folder: str, buckets: int, width: str, doc_id: int, repeat: int = 0) -> np.ndarray | None:
    """The ids of one document, by one lookup and one read; None for a key that the index does not hold."""
    slot = find(folder, buckets, doc_id, repeat)
    if slot is None:
        return None
    fs, path = _open(folder)
    step = np.dtype(width).itemsize
    with fs.open_input_file(f"{path}/shard-{int(slot['shard']):05d}.bin") as f:
        return np.frombuffer(f.read_at(step * int(slot["length"]), step * int(slot["offset"])), width)


def lookup(folder: str, bucket: int, doc_id: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """The slots of many keys of one bucket, from one read of its file; fingerprints that differ mark keys the index does not hold (length 0)."""
    fs, path = _open(folder)
    with fs.open_input_file(f"{path}/index-{bucket:05d}.mph") as f:
        groups, n = np.frombuffer(f.read_at(16, 0), "<u8")
        step = np.frombuffer(f.read_at(8 * int(groups), 16), "<i8")
        table = np.frombuffer(f.read_at(SLOT.itemsize * int(n), 16 + 8 * int(groups)), SLOT)
    a, b, c = key_hashes(doc_id, repeat)
    found = table[_slots(step[(a % groups).astype(np.int64)], b, int(n))].copy()
    found[found["print"] != (c >> np.uint64(32)).astype("<u4")] = 0
    return found


# -- the operator ----------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Encode every text, write shards and index under folder; (shards, buckets) as manifests.

    Documents lie in ascending id order over the shards in order, each closed by end_id. A null text is
    empty; a row with a null id has no key and is left out; rows that repeat an id are all written, and keyed
    by the id and how many precede them. Other columns are ignored. An empty table writes no files. There is a
    shard for every shard_bytes of text, so a task's work does not grow with the table.
    """
    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cores = docs.sparkSession.sparkContext.defaultParallelism  # a small table still has a shard for each, of LEAST_SHARD at least
    parts = max(1, math.ceil(size / shard_bytes), min(cores, size // LEAST_SHARD))
    ranged = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    entries = shared_table(ranged.mapInArrow(_write_shards(folder, path, end_id), "doc_id long, repeat int, shard int, at long, n_tokens long"), "entries")
    shards = entries.groupBy("shard").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("ids"))
    shards = shards.withColumn("base", F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))  # a row per shard file
    shards = shared_table(shards.select("shard", "documents", "ids", F.coalesce("base", F.lit(0)).alias("base")), "shards")
    buckets = max(1, math.ceil(entries.count() / KEYS_PER_BUCKET))
    keyed = entries.withColumn("bucket", _bucket_of("doc_id", "repeat", buckets))
    return shards, shared_table(keyed.groupBy("bucket").applyInPandas(_write_index(folder), "bucket int, keys long"), "buckets")


def _look_up(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = lookup(folder, int(pdf["bucket"].iloc[0]), pdf["doc_id"].to_numpy(), pdf["repeat"].to_numpy())
        return pd.DataFrame({"doc_id": pdf["doc_id"], "repeat": pdf["repeat"], "shard": found["shard"].astype("int32"), "at": found["offset"].astype("int64"), "length": found["length"].astype("int64")})

    return run


def _read_ids(folder: str, width: str):
    step = np.dtype(width).itemsize

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fs, path = _open(folder)
        pdf = pdf.sort_values("at")
        sums, held, begin = [], b"", 0  # bytes of the shard from begin on
        with fs.open_input_file(f"{path}/shard-{int(pdf['shard'].iloc[0]):05d}.bin") as f:
            for at, length in zip((step * pdf["at"]).tolist(), (step * pdf["length"]).tolist(), strict=True):
                if at < begin or at + length > begin + len(held):
                    held, begin = f.read_at(max(length, READ_BYTES), at), at
                ids = np.frombuffer(held[at - begin : at - begin + length], width)
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "repeat": pdf["repeat"], "shard": pdf["shard"], "at": pdf["at"], "n_tokens": pdf["length"], "ids_crc32": sums})

    return run


def read_tokens(keys: DataFrame, folder: str, shards: DataFrame, buckets: DataFrame, width: str) -> DataFrame:
    """(doc_id, repeat, start, n_tokens, ids_crc32) of every key (doc_id, repeat), through the index and from the shards.

    start counts the ids of all documents before. A key that the index does not hold, or with a null, gives no row;
    a key asked for twice gives two; no keys or an empty index give none.
    """
    n = max(1, math.ceil(buckets.agg(F.coalesce(F.sum("keys"), F.lit(0))).first()[0] / KEYS_PER_BUCKET))
    keyed = keys.select("doc_id", "repeat", _bucket_of("doc_id", "repeat", n).alias("bucket")).join(broadcast_if_small(buckets.select("bucket")), "bucket")  # a row per index file
    places = keyed.groupBy("bucket").applyInPandas(_look_up(folder), "doc_id long, repeat int, shard int, at long, length long").where("length > 0")
    read = places.groupBy("shard").applyInPandas(_read_ids(folder, width), "doc_id long, repeat int, shard int, at long, n_tokens long, ids_crc32 long")
    return read.join(shards.select("shard", "base"), "shard").select("doc_id", "repeat", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def document_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, repeat) of every row with an id."""
    counted = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").cast("int").alias("n"))
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("repeat"))
