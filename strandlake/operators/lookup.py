"""Many-to-one joins that stay balanced when one key holds a large share of the rows."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000  # a right side is broadcast only after its rows were counted against this
BROADCAST_BYTES = 10 << 20  # and the text in them against this
SALTS = 8


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether there are at most ``max_rows`` rows with ``max_bytes`` of text; counts at most ``max_rows + 1`` rows."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = df.select(sum(texts, F.lit(0)).cast("long").alias("_size")).limit(max_rows + 1)
    rows, held = size.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    return rows <= max_rows and held <= max_bytes


def lookup(left: DataFrame, right: DataFrame, on, salt_on, how: str = "inner", measure: bool = False,
           salts: int = SALTS) -> DataFrame:
    """Join ``left`` to at most one row of ``right`` per key (``how``: inner or left).

    ``measure=True`` counts the right side first and broadcasts it when it is small. Otherwise the join is shuffled on
    the keys plus a salt: ``left`` spreads each key over ``salts`` groups by a hash of ``salt_on`` and ``right`` is
    repeated once per salt, so a hot key never lands in one task. The salt depends on row contents only, so a lost task
    is recomputed to the same rows. A right side that was measured and is too large is never broadcast: Spark would decide
    by the size of compressed files, without the copies. One that wasn't measured adaptive execution may still broadcast.
    """
    on = [on] if isinstance(on, str) else list(on)
    if measure and small_enough(right):
        return left.join(F.broadcast(right), on, how)
    salt_columns = [salt_on] if isinstance(salt_on, str) else list(salt_on)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_columns), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge") if measure else repeated, [*on, "_salt"], how).drop("_salt")


HOT_SHARE = 10_000  # a key is hot from 1/10,000 of the rows on, so there are at most 10,000 hot keys


def join_counted(left: DataFrame, right: DataFrame, counts: DataFrame, key: str, copies: str = "copies") -> DataFrame:
    """Left join to at most one row of ``right`` per key; ``counts (key, copies)`` tells how many left rows a key has.

    Keys with at least 1/10,000 of all rows number at most 10,000, so their rows are broadcast; every other key is
    shuffled and holds too few rows to unbalance a task. Left rows with a hot key are spread over the shuffle under keys of
    their own. ``right`` and ``counts`` should be stored tables: both are read twice.
    """
    total = counts.agg(F.coalesce(F.sum(copies), F.lit(0)).alias("n")).first()["n"]
    hot_keys = F.broadcast(counts.filter(F.col(copies) * HOT_SHARE >= total).select(key))
    rest = [c for c in right.columns if c != key]
    value = F.struct(*rest)
    hot = F.broadcast(hot_keys.join(right.select(key, value.alias("_hot")), key, "left").withColumn("_is_hot", F.lit(True)))
    cold = right.join(hot_keys, key, "left_anti").select(F.col(key).alias("_key"), value.alias("_cold"))
    spread = F.concat(F.lit("#"), F.xxhash64(*left.columns).cast("string"))
    first = left.join(hot, key, "left").withColumn("_key", F.when(F.col("_is_hot"), spread).otherwise(F.col(key)))
    both = first.join(cold, "_key", "left").withColumn("_row", F.coalesce("_hot", "_cold"))
    return both.select(*left.columns, *[F.col(f"_row.{c}").alias(c) for c in rest])
