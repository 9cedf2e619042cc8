"""Steps whose cost per row was mended: the same results by plainer means, and what their plans must not do."""
import random

from pyspark.sql import functions as F

from strandlake.functions import unclipped_end, unclipped_start
from strandlake.functions.naming import base_name
from strandlake.llm import components, filter_audit
from strandlake.operators import alignment, coordinates, duplicates, fragments, pipe, qc
from strandlake.sources.store import materialize

FIELDS = ("sample string, rg_id string, library string, frag string, flags int, contig string, pos long, end long, mapq int, cigar string, "
          "mate_contig string, mate_pos long, tlen long, bases string, quals string, tags map<string,string>")


def plan(df):
    return df._jdf.queryExecution().toString()


def random_reads(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGTNacgtnÄ") for _ in range(rng.choice([0, 1, 7, 30]))) for _ in range(200)] + [None, "NNN", "T"]
    return texts, spark.createDataFrame([(t,) for t in texts], "bases string").repartition(3)


def test_scores_of_batches_as_letter_by_letter(spark):
    rng = random.Random(3)
    quals = ["".join(chr(rng.choice([33, 47, 48, 60, 73, 126, 228, 0x1F600])) for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(300)] + [None, "", "*", None]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(quals)], "i int, quals string").repartition(3)
    got = {r["i"]: r["s"] for r in df.select("i", duplicates.quality_score(F.col("quals")).alias("s")).collect()}
    assert got == {i: None if q is None else sum(ord(c) - 33 for c in q if ord(c) >= 48) for i, q in enumerate(quals)}
    assert df.select(duplicates.quality_score(F.col("quals")).alias("s")).dtypes == [("s", "int")]


def test_clips_of_any_cigar(spark):
    cigars = {"50M": (100, 200), "5S45M": (95, 200), "2H3S10M4S": (95, 204), "10M7H": (100, 207), "*": (100, 200), None: (None, None)}
    rows = spark.createDataFrame([(c,) for c in cigars], "c string").select(
        "c", unclipped_start(F.lit(100), F.col("c")).alias("s"), unclipped_end(F.lit(200), F.col("c")).alias("e")).collect()
    assert {r["c"]: (r["s"], r["e"]) for r in rows} == cigars


def test_marking_reads_few_columns(spark):
    """Rows without bases are marked alike, so a query that only counts needn't store whole reads."""
    pair = lambda f, p, q, quals: [(f, 99, "c", p, quals), (f, 147, "c", q, quals)]
    rows = (pair("a", 10, 50, "IIII") + pair("b", 10, 50, "5555") + pair("d", 11, 50, "5555") + [("e", 0, "c", 10, "IIII"), ("g", 0, "c", 70, "IIII")] * 2
            + [("h", 4, None, None, "IIII"), (None, 4, None, None, None)])
    whole = spark.createDataFrame([("s", "g", "l", f, flags, c, p, p + 3 if p else None, 60, "4M" if p else "*", None, None, 0, "ACGT", q, {})
                                   for f, flags, c, p, q in rows], FIELDS)
    marked = duplicates.mark_duplicates(whole.select(*duplicates.MARKED_BY))
    assert marked.columns == duplicates.MARKED_BY
    kept = ["frag", "flags", "pos"]
    assert sorted(map(str, marked.select(kept).collect())) == sorted(map(str, duplicates.mark_duplicates(whole).select(kept).collect()))
    assert sorted(r["frag"] for r in marked.collect() if r["flags"] & 1024) == ["b", "b", "e", "e", "g"]


def test_n_content_takes_out_only_the_reads_that_hold_n(spark):
    texts, df = random_reads(spark)
    result = qc.qc_n_content(df)
    want = {}
    for i in range(max(len(t) for t in texts if t)):
        column = [t[i] for t in texts if t and len(t) > i]
        want[i + 1] = round(100.0 * column.count("N") / len(column), 6)
    assert {r["cycle"]: r["n_percent"] for r in result.collect()} == want
    assert result.dtypes == [("cycle", "int"), ("n_percent", "double")]
    assert qc.qc_n_content(df.filter("length(bases) = 0 or bases is null")).count() == 0
    assert "Contains(bases" in plan(result)


def test_gc_counts_without_translate(spark):
    texts, df = random_reads(spark)
    result, want = qc.qc_gc_distribution(df), {}
    for t in texts:
        called = None if t is None else sum(c != "N" for c in t)
        percent = 0 if not called else int(100 * sum(c not in "ATN" for c in t) / called)
        want[percent] = want.get(percent, 0) + 1
    assert {r["gc_percent"]: r["reads"] for r in result.collect()} == want
    assert "translate(" not in plan(result) and "translate(" not in plan(qc.qc_basic_stats(df))


def test_lines_go_through_a_command_in_batches(spark):
    texts = [f"line {i} ä" for i in range(500)] + ["", "\t"]
    lines = spark.createDataFrame([(x,) for x in texts], "value string").coalesce(1)
    got = pipe.pipe_text(lines.unionByName(lines.filter("false")), "cat; echo end", ["#head"], batch=7, numbered=True)
    own = [r["value"] for r in got.orderBy("ord").collect() if r["value"] not in ("#head", "end")]
    assert own == texts and got.filter("value = 'end'").first()["ord"] == len(texts) + 1
    assert "MapInArrow" in plan(got) and "MapInPandas" not in plan(got)


def test_mates_are_sorted_by_name_first(spark):
    row = lambda s, f, flags, p, tags: (s, "g", "l", f, flags, "c", p, p + 3, 60, "4M", None, None, 0, "ACGT", "IIII", tags)
    rows = [row(s, "f", flags, p, tags) for s in "ab" for flags, p, tags in [(99, 10, {"MC": "Z:9M", "NM": "i:1"}), (147, 50, None)]] + [row("a", "f", 0, 7, {"MC": "Z:1M"})]
    result = fragments.mate_info(spark.createDataFrame(rows, FIELDS))
    got = sorted((r["sample"], r["flags"], r["mate_pos"], r["tlen"], sorted((r["tags"] or {}).items())) for r in result.collect())
    pair = lambda s: [(s, 99, 50, 44, [("MC", "Z:4M"), ("NM", "i:1")]), (s, 147, 10, -44, [("MC", "Z:4M")])]
    assert got == sorted([("a", 0, None, 0, [("MC", "Z:1M")]), *pair("a"), *pair("b")])
    assert "windowspecdefinition(frag" in plan(result)


def test_base_names_without_a_search(spark):
    names = {"/d/x_1.fq": "x_1.fq", "x.fastq": "x.fastq", "/d/": "", "": "", "a//b": "b", "/d/x\n": "x\n", None: None}
    df = spark.createDataFrame([(n,) for n in names], "path string").select("path", base_name(F.col("path")).alias("name"))
    assert {r["path"]: r["name"] for r in df.collect()} == names
    assert "regexp" not in plan(df)


def test_few_edges_are_worked_on_in_few_tasks(spark, monkeypatch):
    written = []
    keep = lambda df, name="stage": written.append(df.rdd.getNumPartitions()) or materialize(df, name)
    monkeypatch.setattr(components, "materialize", keep)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {tuple(r) for r in components.components(spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {(k, 0) for k in range(51)}
    assert len(written) > 2 and set(written[1:]) == {1}


def test_small_files_of_much_text_are_not_broadcast(spark):
    """Files far below Spark's broadcast limit whose text, once for each salt, is far above it."""
    tiles = spark.range(2_500).select(F.lit("one").alias("contig"), F.col("id").alias("tile"), (F.col("id") * 4096 + 1).alias("start"), F.lit("ACGT" * 1280).alias("bases"))
    stored = materialize(tiles, "tiles")
    rows = spark.range(0, 2_500 * 4096, 4099).select(F.lit("one").alias("contig"), (F.col("id") + 1).alias("pos"))
    found = coordinates.attach_reference(rows, stored, ["pos"], length=3, name="found")
    assert "BroadcastHashJoin" not in plan(found) and "SortMergeJoin" in plan(found)
    assert found.filter(F.col("found") != F.substring(F.lit("ACGTACG"), ((F.col("pos") - 1) % 4).cast("int") + 1, F.lit(3))).isEmpty()
    assert found.count() == rows.count()
    few = coordinates.attach_reference(rows, materialize(tiles.limit(20), "tiles"), ["pos"], name="found")
    assert "BroadcastHashJoin" in plan(few) and "explode" not in plan(few).split("== Physical Plan ==")[1]


def test_labels_in_a_small_file_are_not_broadcast(spark):
    """More doc_ids than may be broadcast, in a file that Spark takes for small."""
    labels = materialize(spark.range(60_000).select(F.format_string("d%09d", "id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")), "labels")
    failed = spark.range(0, 120_000, 7).select(F.format_string("d%09d", "id").alias("doc_id"), F.lit("en").alias("part"))
    known = filter_audit.with_labels(failed, labels)
    assert "BroadcastHashJoin" not in plan(known)
    assert known.groupBy("good", "toxic").count().orderBy("good").collect() == [(0, 0, 8571), (1, 0, 8572)]


def test_seeds_are_not_broadcast(spark):
    """A stored table of few sequences makes many seeds, which Spark takes for as small as the table."""
    sequences = materialize(spark.range(50).select("id", F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40).alias("hex")).select(
        "id", F.translate("hex", "0123456789abcdef", "ACGTACGTACGTACGT").alias("bases")), "sequences")
    index = sequences.select(F.substring("bases", 1, 16).alias("kmer"), F.lit("one").alias("contig"), F.col("id").alias("pos"), F.lit(True).alias("fwd"))
    met = alignment._met(alignment.seed_kmers(sequences, all_offsets=True), index, None, 1_000)
    assert "BroadcastHashJoin" not in plan(met) and "SortMergeJoin" in plan(met)
    hot = alignment.hot_kmers(index, 0).filter("kmer < 'G'")
    both = alignment._met(alignment.seed_kmers(sequences, all_offsets=True), index, hot, 1)
    assert sorted(met.drop("bases").collect()) == sorted(both.select(*met.drop("bases").columns).collect())
