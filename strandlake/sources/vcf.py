"""VCF text: header table, site records with genotypes, and sorted output."""
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators.lookup import lookup
from strandlake.sources.sam import origin, write_sorted_text

# Reserved FORMAT and INFO keys whose Number the specification sets.
RESERVED_NUMBERS = {"AD": "R", "ADF": "R", "ADR": "R", "PL": "G", "GL": "G", "AC": "A", "AF": "A"}
OUTPUT_VERSION = "VCFv4.2"

HEADER_FIELDS = ["kind", "id", "number", "type", "description"]


def parse_header(lines: DataFrame) -> DataFrame:
    """``vcf_header`` rows ``(kind, id, number, type, description, length)``; the first line of a repeated key wins."""
    def field(key, quoted=False):
        pattern = f'[<,]{key}="([^"]*)"' if quoted else f"[<,]{key}=([^,>]*)"
        return F.nullif(F.regexp_extract("value", pattern, 1), F.lit(""))

    rows = (lines.filter(F.col("value").rlike("^##(INFO|FORMAT|FILTER|contig)=<"))
            .select(F.regexp_extract("value", "^##([A-Za-z]+)=", 1).alias("kind"), field("ID").alias("id"),
                    field("Number").alias("number"), field("Type").alias("type"),
                    field("Description", True).alias("description"), field("length").cast("long").alias("length"),
                    F.col("ord")))
    first = Window.partitionBy("kind", "id").orderBy("ord")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def read_vcf_header(spark: SparkSession, paths) -> DataFrame:
    lines = spark.read.text(paths).filter(F.col("value").startswith("##"))
    return parse_header(lines.withColumn("ord", F.monotonically_increasing_id()))


def parse_info(text: Column) -> Column:
    """MAP of INFO entries; a Flag maps to null and ``KEY=`` to the empty string."""
    return F.when(text == ".", F.create_map().cast("map<string,string>")).otherwise(
        F.str_to_map(F.rtrim(text, F.lit(";")), F.lit(";"), F.lit("=")))


def format_info(info: Column) -> Column:
    entries = F.transform(F.map_entries(info), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(
        F.concat(e["key"], F.lit("="), e["value"])))
    return F.when(F.coalesce(F.size(info), F.lit(0)) <= 0, ".").otherwise(F.array_join(entries, ";"))


def parse_vcf(lines: DataFrame) -> DataFrame:
    """Site records from ``(value, sample_names)`` rows; ``sample_names`` is null when the file has no samples."""
    f = F.split("value", "\t")
    rows = lines.withColumn("f", f)
    g = lambda i: F.col("f")[i]
    many = lambda c, sep: F.when(c == ".", F.array().cast("array<string>")).otherwise(F.split(c, sep))
    keys = F.split(F.get("f", F.lit(8)), ":")

    def genotype(text, i):
        values = F.split(text, ":")
        # Trailing FORMAT keys may be left out of a sample column.
        n = F.least(F.size(keys), F.size(values))
        return F.struct(F.get("sample_names", i).alias("sample"),
                        F.map_from_arrays(F.slice(keys, F.lit(1), n), F.slice(values, F.lit(1), n)).alias("fields"))

    samples = F.slice("f", F.lit(10), F.greatest(F.size("f") - 9, F.lit(0)))
    info = parse_info(g(7))
    end = F.coalesce(F.try_element_at(info, F.lit("END")).try_cast("long"), g(1).cast("long") + F.length(g(3)) - 1)
    return rows.filter(F.size("f") >= 8).select(
        g(0).alias("contig"), g(1).cast("long").alias("pos"), end.alias("end"), many(g(2), ";").alias("ids"),
        g(3).alias("ref"), many(g(4), ",").alias("alts"), g(5).try_cast("double").alias("qual"),
        many(g(6), ";").alias("filters"), info.alias("info"),
        F.transform(samples, genotype).alias("genotypes"), keys.alias("format_keys"))


def read_vcf(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """``(variants, vcf_header)``. Sample names come from the column line of the file a record is in."""
    raw = spark.read.text(paths).select("value", origin().alias("source_file"))
    names = raw.filter(F.col("value").startswith("#CHROM\t")).select(
        "source_file", F.slice(F.split("value", "\t"), 10, 1 << 30).alias("sample_names")).dropDuplicates(["source_file"])
    sites = raw.filter(~F.col("value").startswith("#"))
    named = lookup(sites, names, "source_file", salt_on="value", how="left", measure=True)
    return parse_vcf(named).drop("format_keys"), read_vcf_header(spark, paths)


def normalize_header(header: DataFrame) -> DataFrame:
    """Reserved keys get the Number of the current specification, as writers of VCF 4.2 do."""
    fixed = F.create_map(*[F.lit(x) for pair in RESERVED_NUMBERS.items() for x in pair])
    reserved = F.try_element_at(fixed, F.col("id"))
    return header.withColumn("number", F.when(F.col("kind").isin("INFO", "FORMAT") & reserved.isNotNull()
                                              & (F.col("number") == "."), reserved).otherwise(F.col("number")))


def header_text(header: DataFrame) -> DataFrame:
    """``(ord, value)`` lines for a header table."""
    optional = lambda key, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f",{key}="), F.col(c).cast("string"))) \
        .otherwise("")
    described = F.when(F.col("description").isNotNull(),
                       F.concat(F.lit(',Description="'), "description", F.lit('"'))).otherwise("")
    return header.select(
        "ord", F.concat(F.lit("##"), "kind", F.lit("=<ID="), "id", optional("Number", "number"),
                        optional("Type", "type"), described, optional("length", "length"), F.lit(">")).alias("value"))


def vcf_line(samples: list[str]) -> Column:
    """One site as VCF text with genotype columns in the order of ``samples``."""
    joined = lambda c, sep: F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, ".").otherwise(F.array_join(c, sep))
    fixed = [F.col("contig"), F.col("pos").cast("string"), joined("ids", ";"), F.col("ref"), joined("alts", ","),
             F.when(F.col("qual").isNull(), ".").otherwise(F.when(F.round("qual", 2) == F.col("qual"), F.format_string("%.2f", F.col("qual"))).otherwise(F.col("qual").cast("string"))), joined("filters", ";"),
             format_info(F.col("info"))]
    if not samples:
        return F.concat_ws("\t", *fixed)
    all_keys = F.flatten(F.transform("genotypes", lambda g: F.map_keys(g["fields"])))
    keys = F.array_distinct(F.concat(F.filter(all_keys, lambda k: k == "GT"), all_keys))

    def column(name):
        cell = F.filter("genotypes", lambda g: g["sample"] == name)
        fields = F.get(cell, F.lit(0))["fields"]
        values = F.transform(keys, lambda k: F.coalesce(F.try_element_at(fields, k), F.lit(".")))
        return F.when(fields.isNull(), ".").otherwise(F.array_join(values, ":"))

    return F.concat_ws("\t", *fixed, F.array_join(keys, ":"), *[column(s) for s in samples])


def write_vcf(variants: DataFrame, header: DataFrame, path: str, samples: list[str] | None = None) -> None:
    """Coordinate-sorted VCF 4.2 as ordered part files, header first.

    ``samples`` fixes the genotype columns; without it they are the distinct names in the data. The column line lists
    every sample, so that list is header-sized by the format itself.
    """
    spark = variants.sparkSession
    if samples is None:
        rows = variants.select(F.explode("genotypes.sample").alias("sample")).distinct().orderBy("sample").collect()
        samples = [r["sample"] for r in rows]
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"] + (["FORMAT", *samples] if samples else [])
    fixed = lambda part, text: spark.range(1).select(
        F.lit(part).alias("_part"), F.lit(0).cast("long").alias("_idx"), F.lit(text).alias("value"))
    lines = header_text(normalize_header(header)).select(
        F.lit(1).alias("_part"), F.col("ord").cast("long").alias("_idx"), "value")
    head = fixed(0, f"##fileformat={OUTPUT_VERSION}").unionByName(lines).unionByName(fixed(2, "\t".join(columns)))
    contigs = header.filter(F.col("kind") == "contig").select(F.col("id").alias("contig"), F.col("ord").alias("_idx"))
    placed = lookup(variants, contigs, "contig", salt_on=["pos", "ref"], how="left", measure=True)
    body = placed.select(F.lit(3).alias("_part"), F.col("_idx").cast("long").alias("_idx"), F.col("pos").alias("_pos"),
                         F.concat_ws("\t", "contig", "ref", F.array_join("alts", ",")).alias("_frag"),
                         F.lit(0).alias("_mate"), vcf_line(samples).alias("value"))
    write_sorted_text(head, body, path)
