"""CIGAR arithmetic in native expressions. Positions are 1-based and ends inclusive."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def cigar_ops(cigar: Column) -> Column:
    """ARRAY<STRUCT<len INT, op STRING>>; empty for ``*``."""
    return F.transform(
        F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1)),
        lambda t: F.struct(F.regexp_extract(t, "^([0-9]+)", 1).cast("int").alias("len"),
                           F.right(t, F.lit(1)).alias("op")))


def _span(cigar: Column, ops: str) -> Column:
    """Summed length of the operations named in ``ops``."""
    return F.aggregate(
        F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{ops}]"), F.lit(1)),
        F.lit(0), lambda total, n: total + n.cast("int"))


def ref_span(cigar: Column) -> Column:
    return _span(cigar, "MDN=X")


def read_span(cigar: Column) -> Column:
    return _span(cigar, "MIS=X")


def reference_end(pos: Column, cigar: Column) -> Column:
    return pos + ref_span(cigar) - 1


def _clip(cigar: Column, pattern: str) -> Column:
    """Clipped bases at one end; only a CIGAR that names clips at all is taken apart."""
    clipped = F.aggregate(
        F.regexp_extract_all(F.regexp_extract(cigar, pattern, 0), F.lit("([0-9]+)"), F.lit(1)),
        F.lit(0), lambda total, n: total + n.cast("int"))
    return F.when(cigar.isNull() | cigar.contains("S") | cigar.contains("H"), clipped).otherwise(F.lit(0))


def unclipped_start(pos: Column, cigar: Column) -> Column:
    return pos - _clip(cigar, "^([0-9]+[SH])+")


def unclipped_end(end: Column, cigar: Column) -> Column:
    return end + _clip(cigar, "([0-9]+[SH])+$")


def aligned_blocks(pos: Column, cigar: Column) -> Column:
    """Runs of aligned bases with the operation that follows each.

    ARRAY<STRUCT<ref_start BIGINT, read_start INT, len INT, next_op STRING, next_len INT>>, ``read_start`` is 0-based.
    ``next_op`` is I or D when an insertion or a deletion follows the block directly, else null.
    """
    ops = cigar_ops(cigar)
    start = F.struct(pos.cast("long").alias("ref"), F.lit(0).alias("read"),
                     F.array().cast("array<struct<ref_start:bigint,read_start:int,len:int,idx:int>>").alias("blocks"),
                     F.lit(0).alias("idx"))

    def step(acc, o):
        aligned = o["op"].isin("M", "=", "X")
        block = F.struct(acc["ref"].alias("ref_start"), acc["read"].alias("read_start"), o["len"].alias("len"),
                         acc["idx"].alias("idx"))
        return F.struct(
            (acc["ref"] + F.when(aligned | o["op"].isin("D", "N"), o["len"]).otherwise(0)).alias("ref"),
            (acc["read"] + F.when(aligned | o["op"].isin("I", "S"), o["len"]).otherwise(0)).alias("read"),
            F.when(aligned, F.concat(acc["blocks"], F.array(block))).otherwise(acc["blocks"]).alias("blocks"),
            (acc["idx"] + 1).alias("idx"))

    blocks = F.aggregate(ops, start, step, lambda acc: acc["blocks"])

    def finish(b):
        nxt = F.get(ops, b["idx"] + 1)
        indel = nxt["op"].isin("I", "D")
        return F.struct(b["ref_start"].alias("ref_start"), b["read_start"].alias("read_start"), b["len"].alias("len"),
                        F.when(indel, nxt["op"]).alias("next_op"), F.when(indel, nxt["len"]).alias("next_len"))

    # A read without inner gaps is one block; the general walk is only paid for by the others.
    simple = F.array(F.struct(
        pos.cast("long").alias("ref_start"), F.lit(0).alias("read_start"),
        F.regexp_extract(cigar, "^([0-9]+)", 1).cast("int").alias("len"),
        F.lit(None).cast("string").alias("next_op"), F.lit(None).cast("int").alias("next_len")))
    return F.when(cigar.rlike("^[0-9]+M$"), simple).otherwise(F.transform(blocks, finish))
