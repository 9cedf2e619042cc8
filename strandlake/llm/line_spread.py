"""Line dedup by distinct-site spread: a line that stands on many sites is boilerplate.

Each line hash gets a HyperLogLog sketch of the sites it is seen on; sketches merge by aggregation, so a line on every page
of the corpus costs one small sketch per task. Lines whose estimate is near the limit are counted exactly before the verdict.
A boilerplate line stays in one place (smallest doc_id, first position) and goes everywhere else, so that text which only
exists as copies isn't lost. Everything is built from SQL functions.
"""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.lookup import lookup
from strandlake.sources.store import materialize


@dataclass(frozen=True)
class Spread:
    """Limits of the removal."""
    min_sites: int = 10  # distinct sites from which a line is boilerplate
    log_k: int = 10  # size of a sketch: 2^log_k registers, relative error 1.04 / 2^(log_k / 2)

    @property
    def margin(self) -> float:
        """Relative width of the band that is counted exactly: five standard errors."""
        return 5 * 1.04 / 2 ** (self.log_k / 2)


def _lines(docs: DataFrame, *more: Column) -> DataFrame:
    """One row per line with a word: ``h1, h2`` (128 bits of hash), ``pos`` and ``more``. Lines of white space alone are never boilerplate."""
    exploded = docs.select(*more, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return exploded.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(
        *[c for c in exploded.columns if c != "line"], F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def _site(site: str) -> Column:
    return F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site")


def spread_lines(docs: DataFrame, site: str = "source", spread: Spread = Spread()) -> DataFrame:
    """Boilerplate lines with the place that keeps them: ``h1, h2, keep_doc, keep_pos``. A null site counts as one site."""
    seen = _lines(docs, _site(site), F.col("doc_id"))
    sketched = (seen.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(spread.log_k)).alias("sketch"), F.min(F.struct("doc_id", "pos")).alias("keep"))
                .withColumn("sites", F.hll_sketch_estimate("sketch")).filter(F.col("sites") >= spread.min_sites * (1 - spread.margin))
                .select("h1", "h2", "sites", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.pos").alias("keep_pos")))
    sketched = materialize(sketched, "line-sketches")
    sure = sketched.filter(F.col("sites") > spread.min_sites * (1 + spread.margin)).drop("sites")
    unsure = sketched.filter(F.col("sites") <= spread.min_sites * (1 + spread.margin)).drop("sites")
    if unsure.isEmpty():
        return sure
    rows = lookup(seen.drop("doc_id", "pos"), unsure.select("h1", "h2"), ["h1", "h2"], "site", measure=True)
    exact = rows.groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    return sure.unionByName(unsure.join(exact.filter(F.col("sites") >= spread.min_sites), ["h1", "h2"]).drop("sites"))


def remove_spread_lines(docs: DataFrame, site: str = "source", spread: Spread = Spread()) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and ``n_lines`` and ``n_removed`` (long) beside.

    A null text stays null with no lines; an empty text is one empty line. Lines that are cut leave no line break behind; a
    document may end up empty. Rows that repeat a doc_id are one document: where one of them keeps a line's first place, each keeps
    the line there; all rows without a doc_id are one document in this sense, before all others. Lines of any length count, and a
    very long text is split within its row. Other columns pass through.
    """
    lines = materialize(spread_lines(docs, site, spread), "spread-lines")
    found = lookup(_lines(docs, F.col("doc_id"), F.xxhash64("text").alias("th")), lines, ["h1", "h2"], ["doc_id", "pos"], measure=True)
    cut = found.filter(~(F.col("doc_id").eqNullSafe(F.col("keep_doc")) & (F.col("pos") == F.col("keep_pos"))))
    cuts = cut.groupBy(F.coalesce("doc_id", F.lit(0)).alias("__doc"), F.col("doc_id").isNull().alias("__null"), F.col("th").alias("__th")).agg(F.collect_set("pos").alias("__cut"))
    keyed = docs.select("*", F.coalesce("doc_id", F.lit(0)).alias("__doc"), F.col("doc_id").isNull().alias("__null"), F.xxhash64("text").alias("__th"))
    joined = keyed.join(cuts, ["__doc", "__null", "__th"], "left")
    parts = F.split("text", "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__cut"))
    text = F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.array_join(F.transform(places, lambda i: parts[i]), "\n"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    kept = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*kept, n_lines.alias("n_lines"), F.when(F.col("__cut").isNull(), F.lit(0)).otherwise(F.size("__cut")).cast("long").alias("n_removed"))
