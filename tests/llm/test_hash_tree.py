import zlib
from collections import Counter

from strandlake.llm.hash_tree import assign, even_tree, grown, shard_documents

ROWS = [(k, "x" * (k % 50)) for k in range(4000)] + [(None, None), (7, "ü"), (7, "ü"), (8, ""), (9, "y" * 100_000)]


def places(spark, tree, n=4000):
    return {r["k"]: r["shard"] for r in assign(spark.range(n).select("id", "id").toDF("k", "key"), "key", tree).collect()}


def test_contract(spark):
    df = spark.createDataFrame([(d, t, 5) for d, t in ROWS], "doc_id long, text string, shard int")
    got = shard_documents(df, even_tree(3, 2, 4), grown(even_tree(3, 2, 4))).collect()
    assert len(got) == len(ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in ROWS)
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got) and {r["law"] for r in got} == {"key"}
    for s, n in Counter(r["shard"] for r in got).items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) and 90 < n < 260
    assert {r["shard"] for r in got} == set(range(24)) and 90 < sum(r["grown_shard"] == 24 for r in got) < 260
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1


def test_movement_stays_in_the_changed_subtree(spark):
    tree = even_tree(3, 2, 4)
    before = places(spark, tree)
    heavier = even_tree(3, 2, 4)
    heavier[1][0][9] = 3.0
    after = places(spark, heavier)
    for k in before:
        if before[k] != after[k]:
            assert after[k] in range(8, 16) and (after[k] == 9 or before[k] not in range(8, 12) or after[k] in range(8, 12))
            assert before[k] // 8 == 1 or after[k] // 8 == 1  # never between regions that didn't change
    lighter = even_tree(3, 2, 4)
    lighter[2][1][20] = 0.0
    gone = places(spark, lighter)
    assert 20 not in gone.values()
    assert all(before[k] // 8 == 2 or before[k] == gone[k] for k in before)


def test_shares_follow_weights(spark):
    share = Counter(places(spark, [[{0: 1.0, 1: 3.0}], [{2: 2.0}, {3: 2.0}]], 8000).values())
    assert all(abs(share[s] / 8000 - w / 8) < 0.03 for s, w in {0: 1, 1: 3, 2: 2, 3: 2}.items())


def test_empty_table(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string"), even_tree(1, 1, 2), even_tree(1, 1, 3)).collect() == []
