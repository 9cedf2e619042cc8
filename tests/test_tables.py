"""Derived tables, records put together where they are read, and the region store's folders."""
import os

from pyspark.sql import functions as F

from strandlake.operators import duplicates
from strandlake.plans import germline
from strandlake.sources import fastq, lines, store
from workload import formats, genome
from workload import tables as t

LINEITEM = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_linestatus string, l_returnflag string"


def _lineitem(spark):
    rows = [(o, n, o * 31 + n, n * 7, 10.25 * o + n, "OF"[n % 2], "ANR"[o % 3]) for o in range(1, 400) for n in range(1, 5)]
    odd = [(None, 1, 2, 3, 4.5, "O", "A"), (5, None, 2, 3, None, None, "A"), (-70, 1, 2, 3, 4.5, "F", None), (7, 1, None, 3, 4.5, "O", "R"), (8, 2, 3, -900, 1.0, "O", "N")]
    return spark.createDataFrame(rows + rows[:20] + odd, LINEITEM)


def test_reads_and_alignments_are_the_rows_of_the_sql(spark):
    sources = {"lineitem": _lineitem(spark), "orders": spark.createDataFrame([(i,) for i in range(400)], "o_orderkey bigint"),
               "part": spark.createDataFrame([], "p_partkey bigint, p_size int, p_brand string, p_retailprice double"),
               "supplier": spark.createDataFrame([], "s_suppkey bigint"),
               "events": spark.createDataFrame([], "event_id bigint, event_type string, user_id bigint, value double, ts timestamp")}
    for name in ("reads", "alignments"):
        for gapped in (True, False):
            found = t.derived(spark, sources, name, gapped)
            wanted = spark.sql(t._spark_text(name, gapped), **sources).select(*found.columns)
            assert [k for _, k in found.dtypes] == [k for _, k in wanted.dtypes]
            assert found.count() == wanted.count() > 3000
            assert found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()


def test_a_single_row_group_is_dealt_over_the_cores(spark, tmp_path):
    _lineitem(spark).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = t._source(spark, str(tmp_path), "lineitem").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 2 * spark.sparkContext.defaultParallelism


def test_records_across_splits(spark, tmp_path):
    path = tmp_path / "x.fq"
    reads = [(f"r{i}", "ACGT" * (1 + i % 5), "IIII" * (1 + i % 5)) for i in range(3000)]
    path.write_text("".join(f"@{n}\n{b}\n+\n{q}\n" for n, b, q in reads))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3001")
    try:
        found = fastq.read_fastq(spark, str(path), "s")
        assert sorted((r["ord"], r["frag"], r["bases"], r["quals"]) for r in found.collect()) == [(i, *r) for i, r in enumerate(reads)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_lines_are_not_shuffled_to_be_numbered(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a\nb\n")
    plan = lines.numbered_lines(spark, str(tmp_path / "x.txt"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_region_store_has_no_folder_per_bin(spark, tmp_path):
    rows = spark.range(2000).select(F.concat(F.lit("chr"), F.col("id") % 2).alias("contig"), (F.col("id") * 10 + 1).alias("pos"), (F.col("id") * 10 + 40).alias("end"))
    store.write_genomic_parquet(rows, str(tmp_path / "r"), bin_size=16)
    assert len(list(os.walk(tmp_path / "r" / "data"))) == 3
    found = store.read_region(spark, str(tmp_path / "r"), "chr1", 500, 900)
    wanted = rows.filter("contig = 'chr1' and pos <= 900 and `end` >= 500")
    assert found.select(*rows.columns).exceptAll(wanted).isEmpty() and found.count() == wanted.count() > 0


def test_placements_are_alignments_without_letters(spark):
    sources = {"lineitem": _lineitem(spark), "orders": spark.createDataFrame([(i,) for i in range(400)], "o_orderkey bigint"),
               "part": spark.createDataFrame([], "p_partkey bigint, p_size int, p_brand string, p_retailprice double"),
               "supplier": spark.createDataFrame([], "s_suppkey bigint"),
               "events": spark.createDataFrame([], "event_id bigint, event_type string, user_id bigint, value double, ts timestamp")}
    found = t.derived(spark, sources, "placements", True)
    wanted = spark.sql(t._spark_text("alignments", True), **sources).drop("bases", "quals", "truth")
    assert found.dtypes == wanted.select(*found.columns).dtypes and set(found.columns) == set(wanted.columns)
    assert found.count() == wanted.count() > 3000
    assert found.exceptAll(wanted.select(*found.columns)).isEmpty()


def _tables(spark, folder, odd: bool):
    lineitem = _lineitem(spark).distinct().filter("true" if odd else t.PLAIN)
    lineitem.coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(400)], "o_orderkey bigint").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    for name, schema in (("part", "p_partkey bigint, p_size int, p_brand string, p_retailprice double"), ("supplier", "s_suppkey bigint"),
                         ("events", "event_id bigint, event_type string, user_id bigint, value double, ts timestamp")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _written(spark, name):
    """Files below the scratch folder of tables whose name begins with ``name``."""
    root = store.scratch_root(spark).removeprefix("file:")
    return {os.path.join(d, f) for top in os.listdir(root) if top.startswith(name) for d, _, files in os.walk(f"{root}/{top}") for f in files if f.startswith("part-")}


def test_rows_read_once_are_not_stored_and_text_is_compressed(spark, tmp_path):
    sf = _tables(spark, tmp_path, odd=False)
    before = {name: _written(spark, name) for name in ("derived-reads", "derived-alignments", "fastq", "interleaved")}
    found, pairs = formats.fastq_reads(spark, sf), formats.fastq_interleaved(spark, sf)
    assert t.alignments_once(spark, sf).count() > 3000
    new = {name: _written(spark, name) - had for name, had in before.items()}
    assert not new["derived-reads"] and not new["derived-alignments"]
    assert new["fastq"] and new["interleaved"] and all(f.endswith(".gz") for f in new["fastq"] | new["interleaved"])
    reads = t.reads(spark, sf)
    assert sorted(found.collect()) == sorted(reads.select("frag", "mate", "bases", "quals").collect())
    assert pairs.count() == reads.filter("mate = 2").select("frag").count()
    assert sorted(t.alignments_once(spark, sf).drop("tags").collect(), key=str) == sorted(t.alignments(spark, sf).drop("tags").collect(), key=str)


def test_rows_that_follow_the_sql_are_stored(spark, tmp_path):
    sf = _tables(spark, tmp_path, odd=True)
    before = _written(spark, "derived-reads")
    rows = t.streamed(spark, sf, "reads")
    assert _written(spark, "derived-reads") - before
    assert rows.exceptAll(t.reads(spark, sf)).isEmpty() and t.reads(spark, sf).exceptAll(rows).isEmpty()


def test_compressed_parts_are_ingested(spark, tmp_path):
    sf = _tables(spark, tmp_path, odd=False)
    before = _written(spark, "ingest")
    found = formats.incremental_ingest(spark, sf)
    new = _written(spark, "ingest") - before
    assert new and not [f for f in new if f.endswith((".txt", ".snappy.parquet"))]
    assert sorted(found.collect()) == sorted(t.reads(spark, sf).select("frag", "mate", "bases", "quals").collect())


def test_marking_stores_the_columns_that_it_reads(spark, tmp_path):
    sf = _tables(spark, tmp_path, odd=False)
    before = _written(spark, "derived-alignments"), _written(spark, "templates")
    found = genome.duplicate_flags(spark, sf)
    assert not _written(spark, "derived-alignments") - before[0]
    stored = spark.read.parquet(*_written(spark, "templates") - before[1])
    assert "quals" in stored.columns and not {"bases", "tags", "mate_contig"} & {*stored.columns}
    wanted = duplicates.mark_duplicates(t.alignments(spark, sf)).select(*found.columns)
    assert sorted(found.collect(), key=str) == sorted(wanted.collect(), key=str)


def test_spent_stages_are_removed(spark, tmp_path):
    """Only the recalibrated rows, and the stages that were asked for, are left of a run."""
    sf = _tables(spark, tmp_path, odd=False)
    tiles, snps, rows = t.ref_tiles(spark, sf), t.snps(spark, sf), t.alignments(spark, sf)
    before, had = set(os.listdir(store.scratch_root(spark))), list(store._WRITTEN)
    found = germline.finish_alignment(rows, tiles, snps).collect()
    new = set(os.listdir(store.scratch_root(spark))) - before
    assert [name.split("-")[0] for name in new] == ["recalibrated"] and len(store._WRITTEN) == len(had) + 1
    staged = germline.finish_alignment(rows, tiles, snps, intermediate=str(tmp_path / "run"))
    assert {p.name for p in tmp_path.glob("run_*")} == {"run_aligned", "run_sorted", "run_marked"}
    kept = set(os.listdir(store.scratch_root(spark))) - before - new
    assert [name.split("-")[0] for name in kept] == ["recalibrated"]
    assert sorted(map(str, staged.collect())) == sorted(map(str, found)) and len(found) == rows.count()
    order = [(r["contig"] is None, r["contig"] or "", r["pos"] or 0, r["frag"], r["flags"]) for r in found]
    assert order == sorted(order)


def test_scratch_of_a_failed_step_is_removed(spark):
    before = set(os.listdir(store.scratch_root(spark)))
    try:
        with store.scratch_removed(spark):
            store.materialize(spark.range(5), "inner")
            raise KeyError
    except KeyError:
        pass
    assert set(os.listdir(store.scratch_root(spark))) == before
    assert store.materialize(spark.range(5), "outer").count() == 5
