"""The stages of the pipeline on a small corpus, each against brute force on its own input."""
import random

import numpy as np

import corpus_pipeline
from tests.llm.test_edit_leaks import slow_best
from tests.llm.test_forests import documents
from tests.llm.test_jaccard_regions import brute
from tests.llm.test_text_rules import cut_lines
from strandlake.llm.line_spread import Spread


def corpus(words):
    rows, labels = documents(words, 160)
    rng = random.Random(4)
    items = [(k, " ".join(words(20))) for k in range(6)]
    boilerplate = " ".join(words(60))
    out = []
    for d, text, site, lang in rows:
        if d % 4 and d % 5 == 0:
            text = text + "\n" + boilerplate
        if d % 4 and d % 13 == 0:
            text = text + " " + items[d % 6][1] + " " + " ".join(words(5))
        out.append((d, text, lang, f"site{d % 17}", len(text)))
    for k in range(12):
        d, text, lang, site, n = out[4 * k + 1]
        parts = text.split(" ")
        if k % 2 and len(parts) > 60:
            parts[rng.randrange(len(parts))] = words(1)[0]
        out.append((1000 + k, " ".join(parts), lang, "site3", n))
    return out, labels, items


def test_stages_and_run(spark, words, tmp_path):
    rows, labels, items = corpus(words)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, states = spark.read.parquet(f"{folder}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        states.append(docs.collect())
        assert n == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    quality, lines, unique, clean, packed = states
    good = {d for d, q, _ in labels if q} | {d for d, *_ in rows if d >= 1000}
    assert good <= {r["doc_id"] for r in quality} and len(quality) <= len(good) + 2
    want = {d: (text, cut) for d, text, _, cut in cut_lines([(r["doc_id"], r["source"], r["text"]) for r in quality], Spread())}
    assert {r["doc_id"]: r["text"] for r in lines} == {d: t for d, (t, cut) in want.items() if not cut or t.split()}
    assert any(cut for _, cut in want.values()) and all(r["n_chars"] == len(r["text"]) for r in lines if want[r["doc_id"]][1])
    assert {r["doc_id"] for r in unique} == {d for d, _, c in brute([(r["doc_id"], r["text"]) for r in lines]) if d == c} and len(unique) < len(lines)
    leaks = {r["doc_id"] for r in unique if any(slow_best(r["text"].lower().split(), t.lower().split()) <= 4 for _, t in items)}
    assert leaks and {r["doc_id"] for r in clean} == {r["doc_id"] for r in unique} - leaks
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean}
    assert sum(r["length"] for r in packed) == sum({r["doc_id"]: r["doc_tokens"] for r in packed}.values())
    ran = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, ran)) == sorted(map(str, packed)) and np.all([r["length"] > 0 for r in ran])


def test_empty_and_odd_documents(spark, tmp_path):
    folder = str(tmp_path / "sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, rows in (("none", []), ("odd", [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", "en", "a", 3), (3, "x y", "en", "b", 3), (3, "x y", "en", "b", 3)])):
        docs = spark.createDataFrame(rows, schema)
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.parquet(str(tmp_path / f"{name}{n}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{n}"))
        assert docs.count() == len(rows)
