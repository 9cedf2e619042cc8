"""Discovery of sample files in a workspace folder."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.naming import is_mate_file, sample_id


def list_files(spark: SparkSession, workspace: str) -> DataFrame:
    """Paths of the FASTQ files of a folder. Only names are listed; no content is read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.{fq,fastq,ifq}").load(workspace)
            .select("path"))


def manifest(paths: DataFrame) -> DataFrame:
    """``(sample_id, layout, files)`` from a ``path`` column.

    Names are unique in a folder, so a sample has at most seven files there: three extensions and two mates with two
    extensions each.
    """
    path = F.col("path")
    layout = (F.when(is_mate_file(path), "paired").when(path.endswith(".ifq"), "interleaved").otherwise("single"))
    return paths.select(sample_id(path).alias("sample_id"), layout.alias("layout"), "path").groupBy(
        "sample_id", "layout").agg(F.sort_array(F.collect_list("path")).alias("files"))


def discover_samples(spark: SparkSession, workspace: str) -> DataFrame:
    return manifest(list_files(spark, workspace))
