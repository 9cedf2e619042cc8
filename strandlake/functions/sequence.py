"""Base strings and Phred+33 quality strings."""
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.flags import is_reverse

# Bases and their complements, upper and lower case.
BASES, COMPLEMENTS = "ACGTNacgtn", "TGCANtgcan"
PHRED_OFFSET = 33


def characters(text: Column) -> Column:
    """Array of single characters; empty for an empty string."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def phred(quals: Column) -> Column:
    return F.transform(characters(quals), lambda c: F.ascii(c) - PHRED_OFFSET)


def to_quals(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.char(v + PHRED_OFFSET)), "")


def revcomp(bases: Column) -> Column:
    return F.reverse(F.translate(bases, BASES, COMPLEMENTS))


def forward_sequence(bases: Column, flags: Column) -> Column:
    """Bases in the order the sequencer produced them."""
    return F.when(is_reverse(flags), revcomp(bases)).otherwise(bases)


def forward_quals(quals: Column, flags: Column) -> Column:
    return F.when(is_reverse(flags), F.reverse(quals)).otherwise(quals)


def flat_letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts in a row, and where each begins."""
    texts = pa.concat_arrays([texts]).cast(pa.large_string())
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    letters = np.frombuffer(data, np.uint8)[starts[0]:starts[-1]] if data is not None else np.empty(0, np.uint8)
    return letters, starts - starts[0]
