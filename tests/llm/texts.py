"""Small rows with nulls, repeats, long texts and clashing columns, shared by the operators' tests."""

import random
import re


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rows(*texts, start=1):
    return [(i, t, f"clash{i}") for i, t in enumerate(texts, start)]


SCHEMA = "doc_id long, text string, labels string"
ODD = [None, "", " \n\t ", "x", "É É", "the the the", "a" * 5000, " ".join(f"w{i}" for i in range(30_000))]


def frame(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


def prose(seed, n, vocab=200):
    rng = random.Random(seed)
    return " ".join(rng.choice([f"v{i}" for i in range(vocab)]) for _ in range(n))
