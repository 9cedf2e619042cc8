"""Read quality control: one small table per module."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import PHRED_OFFSET

# Duplication level bins (lower bound, label).
DUPLICATION_LEVELS = [(10_000, ">10k"), (5_000, ">5k"), (1_000, ">1k"), (500, ">500"), (100, ">100"), (50, ">50"), (9, ">10")]


def _cycles(reads: DataFrame) -> DataFrame:
    """One row per base: ``cycle`` 1-based, ``base``, ``q``."""
    return (reads.filter(F.length("bases") > 0)
            .select("bases", "quals", F.explode(F.sequence(F.lit(1), F.length("bases"))).alias("cycle"))
            .select("cycle", F.substring("bases", F.col("cycle"), F.lit(1)).alias("base"),
                    (F.ascii(F.substring("quals", F.col("cycle"), F.lit(1))) - PHRED_OFFSET).alias("q")))


def _without(bases, letters: str):
    """``translate(bases, letters, '')`` by a search per letter; ``translate`` looks every single letter up."""
    left = F.col(bases)
    for letter in letters:
        left = F.replace(left, F.lit(letter), F.lit(""))
    return left


def _gc(bases):
    return F.length(_without(bases, "ATN"))


def qc_basic_stats(reads: DataFrame) -> DataFrame:
    size = F.length("bases")
    return reads.agg(
        F.count(F.lit(1)).alias("reads"), F.sum(size).cast("long").alias("bases"), F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
        F.round(100.0 * F.sum(_gc("bases")) / F.sum(F.length(_without("bases", "N"))), 4).alias("gc_percent"))


def qc_per_base_quality(reads: DataFrame) -> DataFrame:
    """Mean and exact percentiles by cycle. Counts per (cycle, quality) come first, so a cycle is at most 94 rows."""
    counts = _cycles(reads).groupBy("cycle", "q").agg(F.count(F.lit(1)).alias("n"))
    p = lambda x: F.percentile("q", F.lit(x), F.col("n"))
    return counts.groupBy("cycle").agg(
        F.round(F.sum(F.col("q") * F.col("n")) / F.sum("n"), 6).alias("mean"), p(0.5).alias("median"),
        p(0.25).alias("q1"), p(0.75).alias("q3"), p(0.1).alias("p10"), p(0.9).alias("p90"))


def qc_per_read_quality(reads: DataFrame) -> DataFrame:
    total = F.aggregate(F.split("quals", ""), F.lit(0), lambda a, c: a + F.ascii(c)) - PHRED_OFFSET * F.length("quals")
    return (reads.filter(F.length("quals") > 0)
            .groupBy(F.floor(total / F.length("quals")).alias("mean_quality")).agg(F.count(F.lit(1)).alias("reads")))


def qc_per_base_content(reads: DataFrame) -> DataFrame:
    """Percent of A, C, G and T among the called bases of a cycle."""
    share = lambda b: F.round(100.0 * F.count_if(F.col("base") == b) / F.count_if(F.col("base").isin(*"ACGT")), 6)
    return _cycles(reads).groupBy("cycle").agg(*[share(b).alias(f"{b.lower()}_percent") for b in "ACGT"])


def qc_gc_distribution(reads: DataFrame) -> DataFrame:
    called = F.length(_without("bases", "N"))
    gc = F.when(called > 0, F.floor(100 * _gc("bases") / called)).otherwise(F.lit(0))
    return reads.groupBy(gc.cast("long").alias("gc_percent")).agg(F.count(F.lit(1)).alias("reads"))


def qc_n_content(reads: DataFrame) -> DataFrame:
    """Percent of N by cycle. Reads are counted per length and only their Ns are taken out one by one: a cycle has as many bases
    as there are reads of its length or longer, which is a running sum over at most one row per cycle."""
    sizes = reads.filter(F.length("bases") > 0).groupBy(F.length("bases").alias("cycle")).agg(F.count(F.lit(1)).alias("reads"))
    at = F.filter(F.sequence(F.lit(1), F.length("bases")), lambda i: F.substring("bases", i, F.lit(1)) == "N")
    unread = reads.filter(F.contains("bases", F.lit("N"))).select(F.explode(at).alias("cycle")).groupBy("cycle").agg(F.count(F.lit(1)).alias("n"))
    cycles = sizes.agg(F.max("cycle").alias("longest")).filter("longest > 0").select(F.explode(F.sequence(F.lit(1), F.col("longest"))).alias("cycle"))
    longer = Window.orderBy(F.desc("cycle")).rowsBetween(Window.unboundedPreceding, 0)
    counted = cycles.join(sizes, "cycle", "left").withColumn("bases", F.sum(F.coalesce("reads", F.lit(0))).over(longer))
    return counted.join(unread, "cycle", "left").select(
        "cycle", F.round(100.0 * F.coalesce("n", F.lit(0)) / F.col("bases"), 6).alias("n_percent"))


def qc_length_distribution(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.length("bases").alias("length")).agg(F.count(F.lit(1)).alias("reads"))


def _sequence_counts(reads: DataFrame) -> DataFrame:
    """Copies of each sequence; equal sequences are added up before the shuffle."""
    return reads.groupBy("bases").agg(F.count(F.lit(1)).alias("copies"))


def qc_duplication_levels(reads: DataFrame) -> DataFrame:
    level = F.lit(None).cast("string")
    for bound, label in reversed(DUPLICATION_LEVELS):
        level = F.when(F.col("copies") > bound, label).otherwise(level)
    return (_sequence_counts(reads).groupBy(F.coalesce(level, F.col("copies").cast("string")).alias("level"))
            .agg(F.count(F.lit(1)).alias("sequences"), F.sum("copies").alias("reads")))


def qc_overrepresented(reads: DataFrame, top_n: int = 20, min_share: float = 0.001) -> DataFrame:
    """The ``top_n`` most frequent sequences that make up at least ``min_share`` of the reads."""
    total = reads.agg(F.count(F.lit(1)).alias("total"))
    counts = _sequence_counts(reads).crossJoin(F.broadcast(total))  # one row
    return (counts.withColumn("share", F.round(F.col("copies") / F.col("total"), 8))
            .filter(F.col("copies") >= F.col("total") * min_share).orderBy(F.desc("copies"), "bases").limit(top_n)
            .select("bases", "copies", "share"))


def qc_adapter_content(reads: DataFrame, adapters: dict[str, str]) -> DataFrame:
    """Cumulative share of reads in which an adapter has started by a cycle; ``adapters`` is name → sequence."""
    pairs = F.array(*[F.struct(F.lit(n).alias("adapter"), F.lit(s).alias("seq")) for n, s in adapters.items()])
    found = (reads.select("bases", F.explode(pairs).alias("a"))
             .select("a.adapter", F.instr(F.col("bases"), F.col("a.seq")).alias("cycle"))
             .groupBy("adapter", "cycle").agg(F.count(F.lit(1)).alias("n")))
    by_adapter = Window.partitionBy("adapter")
    running = by_adapter.orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    shares = found.select("adapter", "cycle",
                          F.sum(F.when(F.col("cycle") > 0, F.col("n")).otherwise(0)).over(running).alias("seen"),
                          F.sum("n").over(by_adapter).alias("total"))
    return shares.filter("cycle > 0").select("adapter", "cycle", F.round(100.0 * F.col("seen") / F.col("total"), 6).alias("percent"))


MODULES = {
    "basic_stats": qc_basic_stats, "per_base_quality": qc_per_base_quality, "per_read_quality": qc_per_read_quality,
    "per_base_content": qc_per_base_content, "gc_distribution": qc_gc_distribution, "n_content": qc_n_content,
    "length_distribution": qc_length_distribution, "duplication_levels": qc_duplication_levels,
    "overrepresented": qc_overrepresented,
}


def qc_report(reads: DataFrame) -> dict[str, DataFrame]:
    """Every module that needs no further input, by name."""
    return {name: module(reads) for name, module in MODULES.items()}
