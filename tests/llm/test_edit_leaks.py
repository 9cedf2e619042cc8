import random

import numpy as np

from strandlake.llm.edit_leaks import Leaks, best_window, drop_leaks, find_leaks
from strandlake.llm.words import word_hashes, pieces
import pyarrow as pa


def hashes(text):
    return word_hashes(next(pieces(pa.array([text])))[1])[0]


def slow_best(text, item):
    """Smallest edit distance of the item to any run of the text, by full tables."""
    best = len(item)
    for a in range(len(text) + 1):
        row = list(range(len(item) + 1))
        for w in text[a:]:
            new = [row[0] + 1]
            for i, v in enumerate(item):
                new.append(min(row[i] + (w != v), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
    return best


def test_best_window_is_exact():
    rng = random.Random(4)
    for _ in range(150):
        text = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        item = [rng.choice("abcd") for _ in range(rng.randint(1, 7))]
        h = {c: np.uint64(ord(c)) for c in "abcd"}
        d, start, end = best_window(np.array([h[c] for c in text], np.uint64), np.array([h[c] for c in item], np.uint64))
        assert d == slow_best(text, item)
        assert 0 <= start <= end <= len(text) and slow_best(text[start:end], item) == d


def test_recall_and_exactness_against_brute_force(spark, words):
    rng, leaks = random.Random(8), Leaks()
    items = [(k, " ".join(words(rng.randint(8, 40)))) for k in range(30)] + [(40, "tiny item"), (41, ""), (42, None), (43, "One Two three FOUR")]
    docs, planted = [], set()
    for k in range(120):
        body = words(60)
        if k % 3:
            n = k % 30
            text = items[n][1].split()
            for _ in range(rng.randint(0, leaks.edits(len(text)))):
                p = rng.randrange(len(text))
                action = rng.random()
                text[p:p + 1] = [words(1)[0]] if action < 0.5 else [] if action < 0.75 else [text[p], words(1)[0]]
            body = body[:30] + text + body[30:]
            planted.add((k, n))
        docs.append((k, (" " if k % 2 else "\n").join(body)))
    docs += [(500, "so a TINY\titem it is"), (501, None), (502, ""), (None, items[3][1]), (503, "zero one two three four five"), (503, "zero one two three four five")]
    want = set()
    for d, text in docs:
        own = [w.lower() for w in (text or "").split()]
        for n, item in items:
            goal = [w.lower() for w in (item or "").split()]
            if goal and slow_best(own, goal) <= leaks.edits(len(goal)) and own:
                want.add((d, n))
    frame = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    item_frame = spark.createDataFrame(items, "item_id long, text string")
    got = find_leaks(frame, item_frame, leaks).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found <= want and len(found) >= 0.95 * len(want)
    assert {(500, 40), (503, 43), (None, 3)} <= found and sum(r["doc_id"] == 503 for r in got) == 2
    for r in got:
        if r["doc_id"] is not None:
            text = next(t for d, t in docs if d == r["doc_id"]).split()
            item = next(t for n, t in items if n == r["item_id"]).split()
            own = [w.lower() for w in text[r["start_word"]:r["end_word"]]]
            assert slow_best(own, [w.lower() for w in item]) == r["distance"] and r["item_words"] == len(item)
    bad = {d for d, _ in found}
    assert sorted(r["doc_id"] for r in drop_leaks(frame, item_frame).collect()) == sorted(d for d, _ in docs if d is not None and d not in bad)
    blocks = find_leaks(frame, item_frame, Leaks(block_items=7)).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))


def test_exact_items_are_always_found(words):
    from strandlake.llm.edit_leaks import Items, _search
    items = [(k, " ".join(words(n))) for k, n in enumerate(list(range(1, 60)) * 2)]
    held = Items([t for _, t in items], Leaks())
    for n, text in items:
        w, f = word_hashes(next(pieces(pa.array([" ".join(words(9)) + " " + text + " " + " ".join(words(9))])))[1])
        assert any(x[1] == n and x[4] == 0 for x in _search(w, f, held)), text


def test_items_are_walked_together_as_each_alone(words):
    from strandlake.llm.edit_leaks import Items, walk_keys
    leaks = Leaks()
    texts = [" ".join(words(n)) for n in [0, 1, 14, 15, 16, 30, 0, 59, 200] * 3] + ["same " * 40]
    held = Items(texts, leaks)
    for table, (keys, owner, anchor, (seen, shift)) in enumerate(held.tables):
        want = []
        for n, text in enumerate(texts):
            own, last, places = walk_keys(hashes(text), table, leaks)
            want += [(int(own[a]), n, a) for a in range(len(own)) if len(own) >= leaks.short_words and last[a] < len(own) - 1 and places[a] >= leaks.samples]
        assert list(zip(keys.tolist(), owner.tolist(), anchor.tolist())) == sorted(want)
        place = (keys >> shift).astype(np.int64)
        assert ((seen[place >> 3] >> (place & 7).astype(np.uint8)) & 1).all()


def test_items_are_kept_between_tasks(words):
    from strandlake.llm.edit_leaks import held_items
    texts = [" ".join(words(20))]
    first = held_items("a", texts, Leaks())
    assert held_items("a", texts, Leaks()) is first and held_items("b", texts, Leaks()) is not first


def test_edited_short_items_are_always_found(words):
    from strandlake.llm.edit_leaks import Items, _search
    rng, leaks = random.Random(12), Leaks()
    texts = [words(n) for n in range(5, 15) for _ in range(12)]
    held = Items([" ".join(t) for t in texts], leaks)
    for n, text in enumerate(texts):
        edited = list(text)
        for _ in range(leaks.edits(len(text))):
            p = rng.randrange(len(edited))
            action = rng.random()
            edited[p:p + 1] = ["other"] if action < 0.5 else [] if action < 0.75 else [edited[p], "other"]
        for lead in (0, 9):
            w, f = word_hashes(next(pieces(pa.array(["before it", " ".join(words(lead) + edited + words(lead))])))[1])
            assert any(x[:2] == (1, n) for x in _search(w, f, held)), (text, edited)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, items).collect() == [] and drop_leaks(docs, items).collect() == []
    assert find_leaks(docs, spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")).collect() == []
