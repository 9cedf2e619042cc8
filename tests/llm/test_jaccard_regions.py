import random
import re

import numpy as np
import pytest

from strandlake.llm import jaccard_regions
from strandlake.llm.components import components
from strandlake.llm.jaccard_regions import Region, Regions, cells_of, link_documents


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    return sorted(((d, len(sets[i]), min((x for x in low[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


def corpus(words, n=60, copies=9, edits=6):
    rng, rows = random.Random(3), []
    for k in range(n):
        base = words(rng.choice([3, 5, 12, 60, 150]))
        for c in range(rng.choice([1, 1, 2, copies])):
            text = list(base)
            for _ in range(rng.randint(0, edits) if c else 0):
                text[rng.randrange(len(text))] = words(1)[0]
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(text).upper() if c == 1 else " ".join(text)))
    rng.shuffle(rows)
    return rows


def run(spark, rows, regions=Regions()):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    return sorted((tuple(r) for r in link_documents(df, regions).collect()), key=str)


def test_components_equal_brute_force(spark, words):
    rows = corpus(words) + [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "one two"), (9005, "ONE  two"), (9006, "one"), (None, "one two"),
                            (None, "alone with no number"), (None, None)]
    assert run(spark, rows) == brute(rows)


def test_large_region_in_blocks(spark, words):
    """Near copies of one text, a chain of texts that drift away from it, and texts that share a passage, in regions too large for a task."""
    base, rows = words(120), []
    for k in range(90):
        text = list(base)
        for _ in range(k % 4):
            text[random.Random(k).randrange(120)] = words(1)[0]
        rows.append((k, " ".join(text)))
    drift = list(base)
    for k in range(40):
        drift[(7 * k) % 120] = words(1)[0]
        rows.append((500 + k, " ".join(drift)))
    rows += [(700 + k, " ".join(base[:40] + words(80))) for k in range(30)]
    assert run(spark, rows, Regions(task_nodes=16, small=8)) == brute(rows)


def counted(monkeypatch, name):
    """Number of calls of a step, which still does its work."""
    calls, step = [], getattr(jaccard_regions, name)
    monkeypatch.setattr(jaccard_regions, name, lambda *a: calls.append(1) or step(*a))
    return calls


def test_template_with_parts_from_a_pool(spark, words, monkeypatch):
    """Pages of one template, with parts of a pool that many hold: neither pivots nor rare shingles part them, pairs of blocks do."""
    rng, rows, calls = random.Random(7), [], counted(monkeypatch, "_by_pairs")
    template, pool = words(60), [words(20) for _ in range(12)]
    for k in range(150):
        text = template + [w for part in rng.sample(pool, 4) for w in part] + words(rng.choice([0, 3, 12]))
        rows.append((k, " ".join(text)))
        if k % 6 == 0:
            text[rng.randrange(len(text))] = words(1)[0]
            rows.append((1000 + k, " ".join(text)))
    assert run(spark, rows, Regions(task_nodes=16, small=8)) == brute(rows)
    assert calls


def test_thousands_of_pages_of_one_template(spark, monkeypatch):
    """3,000 texts at a similarity of about 0.45, a tenth with a near copy: only the copies link, in regions above the real size of a task."""
    rng, calls = random.Random(11), counted(monkeypatch, "rare_cells")
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    template, rows, want = [word() for _ in range(70)], [], {}
    for k in range(3000):
        text = template + [word() for _ in range(42)]
        rows.append((k, " ".join(text)))
        want[k] = k
        if k % 10 == 0:
            rows.append((10_000 + k, " ".join([*text[:-1], word()])))
            want[10_000 + k] = k
    assert {d: c for d, _, c in run(spark, rows)} == want
    assert calls


def test_sets_of_a_task_are_bounded_by_bytes(spark, words):
    rows = corpus(words, n=25)
    assert run(spark, rows, Regions(task_bytes=2_000, small=8)) == brute(rows)


def test_empty_table_and_repeated_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (5, "g h"), (4, "A b c d e f")]) == [(4, 2, 4), (5, 1, 5), (5, 2, 4), (5, 2, 4)]


def test_region_links_all_pairs():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(30):
        base = rng.choice(1 << 40, 50, replace=False)
        for _ in range(rng.integers(1, 8)):
            one = base.copy()
            at = rng.integers(0, 50, rng.integers(0, 7))
            one[at] = rng.integers(1 << 41, 1 << 42, len(at))
            sets.append(np.unique(one).astype(np.uint64))
    region = Region(sets, 80)
    region.join(np.arange(len(sets)), np.empty(0, int), 8)
    want = Region(sets, 80)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                want.link(i, j)
    assert [region.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


@pytest.mark.parametrize("similarity", [0.8, 0.5, 0.2])
def test_cells_are_shared_as_often_as_stated(similarity):
    rng = np.random.default_rng(1)
    hits, pairs, n = 0, 300, 200
    both = round(2 * n * similarity / (1 + similarity))
    for _ in range(pairs):
        all_ = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
        sets = [np.sort(all_[:n]), np.sort(all_[n - both:])]
        cells = cells_of(np.concatenate(sets), np.array([0, n, 2 * n]), 4, 40, 1)
        hits += (cells[0] == cells[1]).mean()
    assert abs(hits / pairs - similarity ** 4) < 0.03
    assert Regions().missed() < 1e-9 and Regions().missed(True) < 1e-9


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(1000, 1040)] + [(7, 7), (1039, 2000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 7 for k in [7, 2000, *range(1000, 1040)]}}
