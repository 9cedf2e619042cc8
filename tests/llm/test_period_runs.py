import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandlake.llm.period_runs import Grammar, find_in, find_runs, runs_of
from strandlake.llm.queries import op13_period_runs


def brute_runs(words):
    """Every maximal stretch by comparing neighbours at each period; the smallest period of a stretch counts."""
    out = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            k = i
            while k + p < len(words) and words[k] == words[k + p]:
                k += 1
            if k > i and k + p - i >= max(6, 4 * p):
                out.setdefault((i, k + p - i), p)
            i = k + 1
    return sorted((s, n, p) for (s, n), p in out.items())


def brute_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(rng):
    """Words with runs inside runs, runs side by side and borders that almost go on."""
    words = []
    for _ in range(rng.randint(0, 8)):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.3:
            unit = unit * rng.randint(2, 6) + [rng.choice("abc")]
        words += (unit * rng.randint(1, 9))[:rng.randint(1, 60)]
    return words


def test_agreement_of_two_places():
    rng = random.Random(1)
    for _ in range(60):
        s = [0, *(ord(w) for _ in range(3) for w in periodic(rng)), 1]
        grammar = Grammar(np.array(s))
        assert len(grammar.levels) < 60
        x, y = np.divmod(np.arange(len(s) ** 2), len(s))
        x, y = x[x < y], y[x < y]
        for step in (1, -1):
            got = grammar.agreement(x, y, step)
            for i, j, n in random.Random(2).sample(list(zip(x.tolist(), y.tolist(), got.tolist())), min(150, len(x))):
                expected = 0
                while 0 <= i and j < len(s) and s[i] == s[j]:
                    i, j, expected = i + step, j + step, expected + 1
                assert n == expected


def test_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        texts = [periodic(rng) for _ in range(rng.randint(0, 12))]
        first = np.cumsum([0, *map(len, texts)])
        got = np.column_stack(runs_of(np.array([ord(w) for t in texts for w in t], np.int64), first)).tolist()
        assert got == [[k, *r] for k, t in enumerate(texts) for r in brute_runs(t)]


def test_texts():
    rng = random.Random(4)
    texts = [rng.choice(["", " ", "\n"]).join(f"{w}{rng.choice([' ', '  ', chr(10), chr(9)])}" for w in periodic(rng)) for _ in range(60)]
    texts += [None, "", " \n", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "x\x1cy " * 6, "é ü " * 4, ("long" * 400 + " ") * 7, "a " * 30_000]
    got = find_in(pa.array(texts)).to_pylist()
    for text, row in zip(texts, got):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = brute_runs(words) if len(words) < 10_000 else [(0, len(words), 1)]
        assert row == {"n_words": len(words), "runs": [{"start": s, "length": n, "period": p} for s, n, p in runs], "collapsed": brute_collapsed(words, runs)}
    assert find_in(pa.array([], pa.string())).to_pylist() == []


def test_many_runs_of_one_long_text(words):
    base = words(4000)
    text = base[:1000] + base[1000:1400] * 5 + ["a"] * 50 + base[1400:1407] * 40 + base[1407:] * 4
    assert [tuple(r.values()) for r in find_in(pa.array([" ".join(text)]))[0].as_py()["runs"]] == brute_runs(text)


def test_find_runs(spark):
    rows = [(1, "b " * 7, "x"), (None, "b " * 7, "x"), (1, "b " * 7, "x"), (2, None, "x"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(docs).collect())
    assert got == [(0, 7, [(0, 7, 1)], "b"), (1, 7, [(0, 7, 1)], "b"), (1, 7, [(0, 7, 1)], "b"), (2, 0, [], ""), (3, 0, [], "")]
    assert find_runs(docs.filter(F.lit(False))).count() == 0


def expected_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(brute_collapsed(words, runs)))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = op13_period_runs(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    expected = sorted(expected_row(r.doc_id, r.text) for r in docs)
    assert sorted(map(tuple, got.collect())) == expected and any(r[1] for r in expected)
