import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm.filter_audit import NAMES, Rules, audit, counts_of
from strandlake.llm.words import Spans, first_of_equals


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"n_words": len(words), "n_capitals": len(re.findall("[A-Z]", text)), "n_points": len(text),
            "n_symbols": len(re.findall(r"[#$%&*|]", text)), "n_distinct": len(set(words))}


def test_counts_of_one_pass():
    rng = random.Random(1)
    parts = ["a", "B", "é", "漢", "🦆", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "#", "|", " ", "x" * 600, "y" * 600, "abcdefgh", "abcdefghi"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(200)] + ["", None, " ", "a", " a ", "é" * 700_000 + " z"]
    assert counts_of(pa.array(texts), Rules()).to_pylist() == [brute_counts(t) for t in texts]
    assert counts_of(pa.array([], pa.string()), Rules()).to_pylist() == []


def test_table_holds_bytes_against_bytes():
    """Words whose hashes are all equal still stay apart."""
    words = [b"one", b"two", b"one", b"three", b"two", b"three" * 200, b"three" * 200, b"three" * 199 + b"threx"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    spans = Spans(data, ends - np.array([len(w) for w in words]), ends)
    one_text = np.zeros(len(words), np.int64)
    assert first_of_equals(spans, one_text, np.zeros(len(words), np.uint64)).tolist() == [0, 1, 0, 3, 1, 5, 5, 7]
    two_texts = np.array([0, 0, 1, 1, 1, 1, 1, 1])
    assert first_of_equals(spans, two_texts, np.zeros(len(words), np.uint64)).tolist() == [0, 1, 2, 3, 4, 5, 5, 7]


def brute_audit(docs, labels):
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    failed = []
    for i, text, lang in docs:
        c = brute_counts(text)
        bad = {"A": c["n_words"] < 200, "B": 100 * c["n_distinct"] < 50 * c["n_words"], "C": 100 * c["n_capitals"] > 3 * c["n_points"],
               "D": c["n_symbols"] > 0, "E": i is not None and i > first[text or ""]}
        failed.append((lang or "", i, {f for f in NAMES if bad[f]}))
    out, shares = {}, {}
    for part in {p for p, _, _ in failed}:
        for order in map("".join, itertools.permutations(NAMES)):
            left = [(i, f) for p, i, f in failed if p == part]
            for step, letter in enumerate(order, 1):
                gone, left = [x for x in left if letter in x[1]], [x for x in left if letter not in x[1]]
                all_ = [f for p, i, f in failed if p == part and letter in f]
                shares[part, letter] = shares.get((part, letter), 0) + len(gone)
                out[part, order, step] = [len(left), len(gone), len(all_) - len(gone), sum(f == {letter} for f in all_),
                                          sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(frame):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in frame.collect()}


def test_audit_against_brute_force(spark, words):
    rng = random.Random(3)
    docs = []
    for i in range(120):
        text = " ".join(words(rng.choice([0, 5, 150, 210, 260])))
        for change in (lambda t: t + " #", lambda t: t.upper(), lambda t: t + " again" * 300):
            text = change(text) if rng.random() < 0.3 else text
        docs.append((i, text, rng.choice(["en", "fr", "", None])))
    docs += [(200 + i, docs[i % 7][1], "en") for i in range(60)]  # copies, a hot one among them
    docs += [(None, docs[0][1], "en"), (3, docs[3][1], "de"), (3, docs[3][1], "de"), (500, None, None), (501, "", "en"), (None, None, None)]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 200, 2)] + [(4, 1, 1), (4, None, None), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, lang string, fails string, part string")
    said = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    assert result(audit(frame, said)) == brute_audit(docs, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs, labels).count() == 0
    one = result(audit(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), labels))
    assert len(one) == 600 and one["", "BACDE", 2] == (0, 1, 0, 1, 0, 0, 120)


@pytest.mark.parametrize("doc_id", ["string", "int"])
def test_other_types_of_doc_id(spark, doc_id):
    docs = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", None)], "doc_id string, text string").selectExpr(f"cast(doc_id as {doc_id}) as doc_id", "text")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    assert result(audit(docs, labels))["", "EABCD", 1] == (2, 1, 0, 0, 1, 0, 60)
