"""Site filters and reshaping of variant records."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# INFO and FORMAT keys with one value per ALT (A), per allele (R) or per genotype (G).
PER_ALLELE_INFO = {"AC": "A", "AF": "A", "MLEAC": "A", "MLEAF": "A", "AD": "R"}
PER_ALLELE_FORMAT = {"AD": "R", "AO": "A", "QA": "A", "PL": "G", "GL": "G"}


def min_qual(variants: DataFrame, quality: float) -> DataFrame:
    """Sites with QUAL of at least ``quality``; a missing QUAL does not pass."""
    return variants.filter(F.col("qual") >= quality)


def filter_sites(variants: DataFrame, predicate: Column) -> DataFrame:
    """Any predicate over site columns, ``info_value`` or genotype arrays."""
    return variants.filter(predicate)


def recode(variants: DataFrame, keep_info: bool = True) -> DataFrame:
    """Records ready to be written again, with or without their INFO entries."""
    return variants if keep_info else variants.withColumn("info", F.create_map().cast("map<string,string>"))


def explode_genotypes(variants: DataFrame) -> DataFrame:
    """Long form, one row per variant and sample, with typed FORMAT fields; absent fields are null."""
    rows = variants.select("contig", "pos", "ref", "alts", F.explode("genotypes").alias("g"))
    raw = lambda key: F.nullif(F.try_element_at(F.col("g.fields"), F.lit(key)), F.lit("."))
    ints = lambda key: F.transform(F.split(raw(key), ","), lambda v: v.try_cast("int"))
    gt = raw("GT")
    return rows.select(
        "contig", "pos", "ref", "alts", F.col("g.sample").alias("sample"),
        F.transform(F.split(gt, "[/|]"), lambda v: v.try_cast("int")).alias("gt"), gt.contains("|").alias("phased"),
        ints("AD").alias("ad"), raw("DP").try_cast("int").alias("dp"), F.split(raw("FT"), ";").alias("ft"),
        raw("GQ").try_cast("int").alias("gq"), ints("PL").alias("pl"), ints("SB").alias("sb"))


def split_alts(variants: DataFrame, info_numbers: dict[str, str] | None = None,
               format_numbers: dict[str, str] | None = None) -> DataFrame:
    """One row per ALT with ``alt`` and ``allele`` (1-based); lists per allele or genotype keep this allele's values.

    In GT this allele becomes 1 and every other allele 0.
    """
    info_numbers = PER_ALLELE_INFO if info_numbers is None else info_numbers
    format_numbers = PER_ALLELE_FORMAT if format_numbers is None else format_numbers
    rows = variants.select(*[c for c in variants.columns if c != "alts"], F.size("alts").alias("_n"),
                           F.posexplode("alts").alias("_i", "alt")).withColumn("allele", F.col("_i") + 1)
    a = F.col("allele")

    def kept(numbers, key, value):
        values = F.split(value, ",")
        pick = lambda *at: F.array_join(F.array(*[F.get(values, i) for i in at]), ",")
        choice = value
        for kind, wanted, expected in (("A", [a - 1], F.col("_n")), ("R", [F.lit(0), a], F.col("_n") + 1),
                                       ("G", [F.lit(0), (a * (a + 1) / 2).cast("int"), (a * (a + 1) / 2 + a).cast("int")],
                                        (F.col("_n") + 1) * (F.col("_n") + 2) / 2)):
            keys = [k for k, v in numbers.items() if v == kind]
            if keys:
                choice = F.when(key.isin(*keys) & (F.size(values) == expected), pick(*wanted)).otherwise(choice)
        return choice

    def recoded(gt):
        digits = F.transform(F.split(gt, "[/|]"), lambda v: F.when(v == ".", ".").when(v == a.cast("string"), "1").otherwise("0"))
        return F.call_function("array_join", digits, F.when(gt.contains("|"), "|").otherwise("/"))

    info = F.map_from_entries(F.transform(F.map_entries("info"), lambda e: F.struct(
        e["key"].alias("key"), kept(info_numbers, e["key"], e["value"]).alias("value"))))
    fields = lambda m: F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(
        e["key"].alias("key"), F.when(e["key"] == "GT", recoded(e["value"])).otherwise(
            kept(format_numbers, e["key"], e["value"])).alias("value"))))
    out = rows.withColumn("info", info)
    if "genotypes" in variants.columns:
        out = out.withColumn("genotypes", F.transform("genotypes", lambda g: F.struct(
            g["sample"].alias("sample"), fields(g["fields"]).alias("fields"))))
    return out.drop("_i", "_n")
