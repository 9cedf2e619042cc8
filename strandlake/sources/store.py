"""Parquet stores: scratch tables, stage outputs and the region-addressable alignment store."""
import atexit
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STORED_AS = "zstd"  # compression of stored tables: letters and qualities take less than half of what snappy needs
BIN = 1 << 20  # bases per bin of the region store
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: list[str] = []  # folder of this process, where no shared one is named
_WRITTEN: list[str] = []  # scratch tables of this process
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())  # of the blocks of ``scratch_removed`` that this thread is in


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a session that runs in this one process gets a folder of its own, removed at exit; a session with
    other machines is refused, because these could not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (master {master})")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="strandlake-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below ``scratch_root``, remembered for ``clear_scratch``."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    for own in _OPEN.get()[-1:]:
        own.append(path)
    return path


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_removed(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that get their path inside go at the end. What goes on from here has to be written inside, to a path from before."""
    own: list[str] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in own:
            _delete(spark, path)
            if path in _WRITTEN:
                _WRITTEN.remove(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove the scratch tables of this process, for the end of a run: frames that read them can't be used any more."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when a write has ended, not when the driver happens to collect garbage.

    What was written is read from its files from then on, so a run of several steps holds the shuffles of one step at a time.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write to the shared scratch folder and read back: later uses neither recompute nor depend on the lineage.

    The plan then knows the true size of the table, which is what decides on broadcasting it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_removed(spark):
        df.write.mode("errorifexists").option("compression", STORED_AS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_stage(df: DataFrame, path: str, enabled: bool = True) -> DataFrame:
    """Optional intermediate output: write Parquet to ``path`` and go on from the written table."""
    if not enabled:
        return df
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").option("compression", STORED_AS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_many(spark: SparkSession, paths) -> DataFrame:
    """Text lines of every file matching a path or glob, with their origin: ``(source_file, value)``."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("source_file"), "value")


def write_genomic_parquet(df: DataFrame, path: str, bin_size: int = BIN) -> None:
    """Store positioned rows (``contig, pos, end``) so that a region read opens only the bins it needs.

    Each contig has a directory, and rows lie in order of bin and position, so the least and greatest values that Parquet keeps tell
    which pages hold a region; a directory per bin would be thousands of files. The range exchange takes a content hash as last
    key, so a pile of rows at one position is split over files. The longest span is kept beside the data: a reader needs it to find rows that start before the region.
    """
    spark = df.sparkSession
    binned = df.withColumn("bin", F.floor(F.col("pos") / bin_size))
    keys = ["contig", "bin", "pos"]
    spread = F.xxhash64(*[c for c in df.columns if not isinstance(df.schema[c].dataType, StructType)
                          and df.schema[c].dataType.typeName() != "map"])
    with shuffles_removed(spark):
        (binned.withColumn("_h", spread).repartitionByRange(*keys, "_h").sortWithinPartitions(*keys, "_h").drop("_h")
         .write.mode("overwrite").option("compression", STORED_AS).partitionBy("contig").parquet(f"{path}/data"))
    stored = spark.read.schema(binned.schema).parquet(f"{path}/data")
    (stored.agg(F.coalesce(F.max(F.col("end") - F.col("pos")), F.lit(0)).alias("max_span"))
     .withColumn("bin_size", F.lit(bin_size)).withColumn("row_schema", F.lit(binned.schema.json()))
     .write.mode("overwrite").parquet(f"{path}/meta"))


def read_region(spark: SparkSession, path: str, contig: str | None = None, lo: int | None = None,
                hi: int | None = None) -> DataFrame:
    """Rows overlapping ``contig:lo-hi`` (inclusive). Only the contig's directory is read, and of it the pages that hold touched bins."""
    meta = spark.read.parquet(f"{path}/meta").first()
    schema = StructType.fromJson(json.loads(meta["row_schema"]))
    stored = spark.read.schema(schema).parquet(f"{path}/data")
    if contig is None:
        return stored.drop("bin")
    return region(stored, contig, lo, hi, meta["max_span"], meta["bin_size"]).drop("bin")


def region(df: DataFrame, contig: str, lo: int | None = None, hi: int | None = None, max_span: int | None = None,
           bin_size: int = BIN) -> DataFrame:
    """Coordinate filter; with a ``bin`` column and ``max_span`` it adds the predicates that prune pages."""
    keep = F.col("contig") == contig
    if hi is not None:
        keep &= F.col("pos") <= hi
    if lo is not None:
        keep &= F.col("end") >= lo
    if "bin" in df.columns and max_span is not None:
        if hi is not None:
            keep &= F.col("bin") <= hi // bin_size
        if lo is not None:
            keep &= (F.col("bin") >= (lo - max_span) // bin_size) & (F.col("pos") >= lo - max_span)
    return df.filter(keep)
