"""Accessors for the SAM flag bit set."""
from pyspark.sql import Column
from pyspark.sql import functions as F

# Flag bits of the SAM specification.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED = 0x1, 0x2, 0x4, 0x8
REVERSE, MATE_REVERSE, FIRST, SECOND = 0x10, 0x20, 0x40, 0x80
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x100, 0x200, 0x400, 0x800


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def set_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseOR(F.lit(bit))


def clear_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(~bit))


def is_paired(flags: Column) -> Column:
    return has_flag(flags, PAIRED)


def is_mapped(flags: Column) -> Column:
    return ~has_flag(flags, UNMAPPED)


def is_mate_mapped(flags: Column) -> Column:
    return has_flag(flags, PAIRED) & ~has_flag(flags, MATE_UNMAPPED)


def is_reverse(flags: Column) -> Column:
    return has_flag(flags, REVERSE)


def is_first(flags: Column) -> Column:
    return has_flag(flags, FIRST)


def is_second(flags: Column) -> Column:
    return has_flag(flags, SECOND)


def is_duplicate(flags: Column) -> Column:
    return has_flag(flags, DUPLICATE)


def is_primary(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(SECONDARY | SUPPLEMENTARY)) == 0


def mate_number(flags: Column) -> Column:
    """0 for an unpaired read, 1 and 2 for the reads of a pair."""
    return F.when(~is_paired(flags), 0).when(is_second(flags), 2).otherwise(1)
