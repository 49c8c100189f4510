import json
import zlib

import numpy as np
import pyarrow.fs
import pytest

from tests.llm.texts import ODD
from wardstone.llm import catalog, tokenfiles
from wardstone.llm.common import shared_path

PATH = catalog.tokenizer_path("word_bpe_49k.json")
TEXTS = [*ODD, "Don't stop <|endoftext|> now", "ŒUVRE Σίσυφος İstanbul é ½ x y", "a\tb\r\nc  d", "naïve " * 300]


def brute(rows):
    tok = tokenfiles.tokenizer(PATH)
    out, start = [], 0
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")
    folder = shared_path(spark, "tokens")
    shards, buckets = tokenfiles.write_tokens(df, folder, PATH, 1, **kw)
    got = tokenfiles.read_tokens(tokenfiles.document_keys(df), folder, shards, buckets, "<u2").collect()
    return sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), folder


def test_files_give_back_the_library_s_ids(spark):
    rows = [(7 * i - 20, t) for i, t in enumerate(TEXTS * 4)]
    assert run(spark, rows)[0] == brute(rows)


def test_repeats_null_ids_and_empty(spark):
    rows = [(None, "gone"), (4, "same text"), (4, "same text"), (2, None)]
    assert run(spark, rows)[0] == brute(rows)
    assert run(spark, [])[0] == []


def test_small_index_buckets(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "KEYS_PER_BUCKET", 7)
    rows = [(i, f"text {i}") for i in range(60)]
    got, folder = run(spark, rows)
    assert got == brute(rows)
    assert int((tokenfiles.lookup(folder, 0, np.arange(1000, 1400), np.zeros(400, int))["length"] > 0).sum()) <= 1  # fingerprints turn strangers away


def test_shards_follow_the_bytes_and_reads_their_windows(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "READ_BYTES", 64)
    rows = [(i, f"some text number {i} " * (i % 9)) for i in range(120)]
    got, folder = run(spark, rows, shard_bytes=2_000)
    files = pyarrow.fs.FileSystem.from_uri(folder)
    shards = [f for f in files[0].get_file_info(pyarrow.fs.FileSelector(files[1])) if f.base_name.startswith("shard-")]
    assert got == brute(rows) and len(shards) == -(-sum(len(t) for _, t in rows) // 2_000)


def test_keyed_access_reads_one_slot(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "KEYS_PER_BUCKET", 7)
    rows = [(i * 37 - 500, f"text {i}") for i in range(60)] + [(5, "one"), (5, "two")]
    _, folder = run(spark, rows)
    tok = tokenfiles.tokenizer(PATH)
    for i, text in rows[:60]:
        assert tokenfiles.read_document(folder, 9, "<u2", i).tolist() == [*tok.encode(text, add_special_tokens=False).ids, 1]
    both = [tokenfiles.read_document(folder, 9, "<u2", 5, k).tolist() for k in (0, 1)]
    assert sorted(both) == sorted([*tok.encode(t, add_special_tokens=False).ids, 1] for t in ("one", "two"))
    assert all(tokenfiles.read_document(folder, 9, "<u2", i) is None for i in range(10**6, 10**6 + 200))
    keys = spark.createDataFrame([(i, k) for i in (-7, 0, 2**40) for k in (0, 3)], "i long, k int")
    assert all(r.b == tokenfiles.bucket_of(r.i, r.k, 9) for r in keys.withColumn("b", tokenfiles._bucket_of("i", "k", 9)).collect())


def test_a_task_that_runs_again_replaces_its_file(tmp_path):
    for content in (b"first", b"second"):
        tokenfiles.write_file(f"file://{tmp_path}", "shard-00000.bin", [content])
    assert [p.read_bytes() for p in tmp_path.iterdir()] == [b"second"]


def test_other_settings_encode_whole_texts(tmp_path):
    other = catalog.tokenizer_path("byte_bpe_50k.json")
    with open(PATH, encoding="utf-8") as f:
        body = json.load(f)
    body["normalizer"]["normalizers"].pop()  # no lower case
    changed = tmp_path / "changed.json"
    changed.write_text(json.dumps(body))
    for path in (other, str(changed)):
        own, tok = tokenfiles.Encoder(path, 1), tokenfiles.tokenizer(path)
        assert not own.by_word
        for t in TEXTS:
            assert np.frombuffer(own(t), own.width).tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    assert tokenfiles.Encoder(PATH, 1).by_word


@pytest.mark.parametrize("n", [1, 2, 3, 10, 999, 20_000])
def test_perfect_hash_is_minimal(n):
    ids = np.random.default_rng(n).choice(10**12, n, replace=False)
    step, slot = tokenfiles.build_index(ids, np.zeros(n, int))
    assert sorted(slot.tolist()) == list(range(n)) and len(step) == max(1, n // 4)
