import gzip
import json
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from wardstone.operators import merkle
from wardstone.sources import corpora as S
from wardstone.sources import lines as L
from wardstone.sources.parts import MANIFEST, write_parts


def read(spark, path, **kw):
    return [(r.line, r.value) for r in L.read_lines(spark, str(path), **kw).orderBy("line").collect()]


@pytest.mark.parametrize("split", [7, 50, 1000, 1 << 20])
def test_numbers_of_lines_hold_over_any_splits(spark, tmp_path, split):
    rng = random.Random(split)
    text = "\n".join("é" * rng.choice([0, 0, 1, 3, 40, 200]) + str(i) * rng.choice([0, 1]) for i in range(150))
    for tail in ("", "\n", "\n\n"):
        (tmp_path / "a.txt").write_bytes((text + tail).encode())
        want = (text + tail).split("\n")
        want = want[:-1] if want[-1] == "" else want
        assert read(spark, tmp_path / "a.txt", split_bytes=split) == list(enumerate(want, 1))


def test_folders_gzip_members_and_line_ends(spark, tmp_path):
    (tmp_path / "1.txt").write_bytes(b"one\r\ntwo\n")
    (tmp_path / "2.txt.gz").write_bytes(gzip.compress(b"three\nfo") + gzip.compress(b"ur\n") + b"\0" * 9)
    (tmp_path / "3.txt").write_bytes(b"")
    (tmp_path / "4.txt").write_bytes(b"five")
    (tmp_path / "_hidden").write_bytes(b"no")
    assert read(spark, tmp_path) == [(1, "one"), (2, "two"), (3, "three"), (4, "four"), (5, "five")]


def test_bounds_hold_before_anything_is_parsed(spark, tmp_path):
    (tmp_path / "long.txt").write_bytes(b"ok\n" + b"x" * 5000 + b"\nmore\n")
    with pytest.raises(L.TooLarge, match=":2: line_long"):
        read(spark, tmp_path / "long.txt", max_line=4000)
    with pytest.raises(L.TooLarge, match=":2: line_long"):
        read(spark, tmp_path / "long.txt", max_line=4000, split_bytes=64)
    with pytest.raises(L.TooLarge, match="more than 3000 bytes"):
        read(spark, tmp_path / "long.txt", max_bytes=3000)
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"line\n" * 1000)[:-9])
    with pytest.raises(S.SourceError, match="ends too early"):
        S.read_corpus(spark, str(tmp_path / "cut.gz"))
    (tmp_path / "bad.txt").write_bytes(b"fine\n\xff\xfe\n")
    with pytest.raises(S.SourceError, match=":2: not_utf8"):
        S.read_corpus(spark, str(tmp_path / "bad.txt"))


def test_a_bomb_of_one_line_stays_below_64_mb(tmp_path):
    path, code = tmp_path / "bomb.jsonl.gz", "import resource, sys; from wardstone.sources import lines as L; base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; r = L._Reader({'path': sys.argv[1], 'mode': 'count'}); [s] = r.partitions(); [b] = r.read(s); assert b.column('long_at')[0].as_py() == 1; r.count = False; assert sum(x.num_rows for x in r.read(s)) == 1; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base)"
    with gzip.open(path, "wb") as f:
        for _ in range(400):
            f.write(b" " * (1 << 20))
    done = subprocess.run([sys.executable, "-c", code, str(path)], capture_output=True, text=True, timeout=120, cwd=S.__file__.rsplit("/wardstone/", 1)[0])
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 64 * 1024


def samples(spark, n, parts):
    return spark.range(n).repartition(parts).select((F.col("id") * 7 + 3).alias("ordinal"), F.format_string("s-%05d", "id").alias("sample_id"), F.concat(F.lit("text é "), "id").alias("text"), F.lit("benign").alias("label"), F.lit("").alias("family"), F.lit("plain").alias("kind"))


def contents(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir() if not p.name.startswith(".")}


@pytest.mark.parametrize("compressed", [False, True])
def test_parts_are_the_same_bytes_whatever_the_partitions(spark, tmp_path, compressed):
    for name, parts in (("a", 2), ("b", 5)):
        S.write_corpus_folder(samples(spark, 250, parts), str(tmp_path / name), compressed, part_rows=40)
    one = contents(tmp_path / "a")
    assert one == contents(tmp_path / "b") and len(one) == 8
    S.write_corpus_folder(samples(spark, 250, 3), str(tmp_path / "a"), compressed, part_rows=40)
    assert contents(tmp_path / "a") == one
    again = S.read_corpus(spark, str(tmp_path / "a"))
    assert [r.sample_id for r in again.orderBy("ordinal").collect()] == [f"s-{i:05d}" for i in range(250)]
    assert [p["lines"] for p in json.loads(one[MANIFEST])["parts"]] == [40] * 6 + [10]
    S.write_corpus_folder(samples(spark, 30, 3), str(tmp_path / "a"), compressed)
    assert len(contents(tmp_path / "a")) == 2 and S.read_corpus(spark, str(tmp_path / "a")).count() == 30


def test_a_failed_job_leaves_nothing_and_keeps_what_was_there(spark, tmp_path):
    good = spark.range(90).select(F.col("id").alias("ordinal"), F.col("id").cast("string").alias("value"))
    bad = good.withColumn("value", F.when(F.col("ordinal") == 77, F.raise_error(F.lit("boom")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="boom"):
        write_parts(bad, str(tmp_path / "new"), part_rows=10)
    assert not (tmp_path / "new").exists()
    write_parts(good, str(tmp_path / "old"), part_rows=10)
    before = contents(tmp_path / "old")
    with pytest.raises(Exception, match="boom"):
        write_parts(bad, str(tmp_path / "old"), part_rows=10)
    assert contents(tmp_path / "old") == before and len(before) == 10


def test_trees_depend_on_rows_and_order_alone_and_tell_where_they_part(spark):
    df = spark.range(300).select(F.col("id").alias("at"), F.concat(F.lit("t"), "id").alias("line"))
    one, two = (merkle.tree(df.repartition(n), "at", F.col("line"), 8) for n in (2, 5))
    assert merkle.root(one) == merkle.root(two) and merkle.first_difference(one, two) is None
    assert [r["count"] for r in one.groupBy("level").count().orderBy("level").collect()] == [38, 5, 1]
    changed = df.withColumn("line", F.when(F.col("at").isin(100, 203), "x").otherwise(F.col("line")))
    found = merkle.differences(one, merkle.tree(changed, "at", F.col("line"), 8)).orderBy("range").collect()
    assert [(r["range"], r["first"]) for r in found] == [(12, 96), (25, 200)]
    shorter = merkle.first_difference(one, merkle.tree(df.where("at < 250"), "at", F.col("line"), 8))
    assert (shorter["range"], shorter.rows, shorter.other_rows) == (31, 8, 2)
    none = merkle.tree(df.where("false"), "at", F.col("line"))
    assert merkle.root(none) == "sha256:" and merkle.root(none) != merkle.root(one)
