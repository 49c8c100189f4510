import sentencepiece

import corpus_pipeline
from tests.llm import test_decontaminate, test_linededup, test_minhash
from tests.llm.test_classifiers import corpus
from tests.llm.texts import prose
from wardstone.llm import catalog, quality
from wardstone.tables import read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    docs, labels = corpus(160)
    texts = [t + "\nthe menu of every page" * (i % 2) for i, t, *_ in docs]
    item = prose(21, 40)
    texts += [texts[7], texts[7] + " tail", texts[8].replace("the", "der", 1), item + " and more of this", "le la les " + item[:60], "", "x", None]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, "the of and to", "en", "s0", 13), (5, texts[5], "en", "s1", len(texts[5]))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "solo item of words"), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return [(1, item), (2, "solo item of words"), (3, None)]


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


def test_each_stage_does_what_brute_force_does_on_its_own_input(spark, tmp_path):
    items = tables(spark, tmp_path)
    docs = read_table(spark, str(tmp_path), "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(docs.collect(), key=key)
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/out-{len(seen)}")
        seen.append(name)
        if len(seen) < len(corpus_pipeline.STAGES):
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        after = docs.collect()
        if name == "quality":
            model = quality.train(read_table(spark, str(tmp_path), "documents"), read_table(spark, str(tmp_path), "labels"))
            score = quality.score_texts([r.text for r in before], model.logits(), float(model.bias[1] - model.bias[0]))
            assert sorted(after, key=key) == [r for r, s in zip(before, score, strict=True) if s >= 0.7] and 0 < len(after) < len(before)
        elif name == "line dedup":
            want = [x[:2] for x in test_linededup.brute([(r.doc_id, r.text, r.source) for r in before], 0.04)]
            assert sorted([(r.doc_id, r.text) for r in after], key=repr) == sorted(want, key=repr) and want != [(r.doc_id, r.text) for r in before]
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
        elif name == "near-dedup":
            comp = test_minhash.brute([(r.doc_id, r.text) for r in before if r.doc_id is not None], 80)
            assert sorted([r.doc_id for r in after if r.doc_id is not None]) == sorted(i for i, (_, c) in comp.items() if c == i)
            assert len(after) < len(before) and sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)
        elif name == "decontamination":
            bad = test_decontaminate.brute([r.text for r in before], items)
            assert sorted(after, key=key) == [r for r, b in zip(before, bad, strict=True) if not b[3]] and len(after) < len(before)
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=catalog.tokenizer_path("piece_bpe_32k.model"))
            want = {r.doc_id: library.encode(r.text or "") for r in before}
            assert {r.doc_id: list(r.ids) for r in after} == want and all(r.round_trip for r in after)
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == docs.count()


def test_stages_take_empty_tables_and_clashing_columns(spark, tmp_path):
    tables(spark, tmp_path)
    docs = read_table(spark, str(tmp_path), "documents")
    odd = docs.selectExpr("*", "'a' as `of`", "1 as hit_id", "2 as side", "3 as __id", "4 as score", "5 as n_lines", "6 as keys", "7 as words")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and {tuple(r)[5:] for r in out.collect()} == {("a", 1, 2, 3, 4, 5, 6, 7)}
        assert stage(spark, odd.limit(0), str(tmp_path)).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), str(tmp_path)).collect() == []
