"""From raw documents to packed sequences: quality, line dedup, near duplicates, decontamination, packing.

``STAGES`` holds (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``. Rows with a null text or
doc_id pass through every stage as the operators' docstrings say.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.curve_packing import pack_documents
from strandlake.llm.edit_leaks import drop_leaks
from strandlake.llm.jaccard_regions import keep_one
from strandlake.llm.line_spread import remove_spread_lines
from strandlake.llm.site_bayes import score
from strandlake.sources.store import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior probability of good quality is at least 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, labels).filter("keep").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; ``n_chars`` follows. Documents of which no word is left go."""
    cut = remove_spread_lines(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a shingle similarity of 0.8 or more: the one with the smallest doc_id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edited in up to a fifth of its words."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids, in the order of the Hilbert curve."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join),
          ("benchmark decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None  # a forest and a tokenizer's ids can't be had from SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
