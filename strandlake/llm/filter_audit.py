"""How text filters interact: what each of them removes at each place of every order.

One pass of a table-driven machine over the bytes of the texts counts words, capitals, code points and symbols, and hands the
spans of the words to a hash table that holds bytes against bytes, which gives the distinct words. The filters that a document
fails become bits of a number; from then on only counts by part and number are needed, so all orders together cost one row
for each.
"""
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.words import Spans, bytes_of, first_of_equals, pieces
from strandlake.operators.lookup import lookup
from strandlake.sources.store import materialize

SPACES = b"\t\n\v\f\r "
BEGINS, ENDS, CAPITAL, FOLLOWS, SYMBOL = 1, 2, 4, 8, 16  # what the machine says about a byte; FOLLOWS: inside a code point


@dataclass(frozen=True)
class Rules:
    """Limits of the filters A to E."""
    min_words: int = 200  # A: fewer fail
    min_distinct: int = 50  # B: percent of the words
    max_capitals: int = 3  # C: percent of the code points
    symbols: str = "#$%&*|"  # D: a text that holds one fails


NAMES = "ABCDE"


class Machine:
    """States 0 (outside a word) and 1 (inside). ``says[256 * state + byte]`` is the output.

    The state after a byte follows from that byte alone, so the states of a whole array of bytes come from one look-up, and the
    outputs from a second one. In UTF-8 a byte tells by itself whether it continues a code point.
    """

    def __init__(self, symbols: str):
        byte = np.arange(256)
        space = np.isin(byte, list(SPACES))
        self.next = (~space).astype(np.uint16)
        plain = np.where((byte >= 65) & (byte <= 90), CAPITAL, 0) | np.where((byte & 0xC0) == 0x80, FOLLOWS, 0)
        plain |= np.where(np.isin(byte, list(symbols.encode())), SYMBOL, 0)
        self.says = np.concatenate([plain | np.where(space, 0, BEGINS), plain | np.where(space, ENDS, 0)]).astype(np.uint8)

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts (a row per text: words, capitals, code points, symbols), and starts and ends of all words."""
        sizes = np.diff(offsets)
        state = np.zeros(len(data), np.uint16)
        state[1:] = self.next[data[:-1]]
        state[offsets[:-1][sizes > 0]] = 0
        said = self.says[(state << np.uint16(8)) | data]
        place = lambda what: np.flatnonzero(said & np.uint8(what))
        count = lambda where: np.diff(np.searchsorted(where, offsets))
        starts, last = place(BEGINS), offsets[1:][sizes > 0]
        ends = np.sort(np.concatenate([place(ENDS), last[self.next[data[last - 1]] == 1]]), kind="stable")
        return np.stack([count(starts), count(place(CAPITAL)), sizes - count(place(FOLLOWS)), count(place(SYMBOL))], 1), starts, ends


COUNTS = ["n_words", "n_capitals", "n_points", "n_symbols", "n_distinct"]


def counts_of(texts: pa.Array, rules: Rules) -> pa.Array:
    """A struct of ``COUNTS`` for each text; a null counts as an empty text."""
    machine, rows = Machine(rules.symbols), [np.empty((0, 5), np.int64)]
    for _, piece in pieces(texts):
        data, offsets = bytes_of(piece)
        if not len(data):
            rows.append(np.zeros((len(piece), 5), np.int64))
            continue
        counts, starts, ends = machine.run(data, offsets)
        text = np.repeat(np.arange(len(piece)), counts[:, 0])
        own = first_of_equals(Spans(data, starts, ends), text) == np.arange(len(starts))
        rows.append(np.column_stack([counts, np.bincount(text[own], minlength=len(piece))]))
    table = np.concatenate(rows)
    return pa.StructArray.from_arrays([pa.array(table[:, k], pa.int64()) for k in range(5)], COUNTS)


def count_texts(rules: Rules):
    """``counts_of`` as an Arrow function of a column."""
    def run(texts: pa.Array) -> pa.Array:
        return counts_of(texts, rules)
    return F.arrow_udf(run, ", ".join(f"{c} long" for c in COUNTS))


def failures(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The filters that each row of ``docs (doc_id, text, lang, …)`` fails, as bits of ``fails`` (A is 1, B is 2, …): a stored table.

    Returns ``doc_id, part`` (``lang``, null as empty), the counts and ``fails``. E holds a text's SHA-256 against the table:
    a row fails it if an equal text has a smaller doc_id. A row without a doc_id neither fails E nor makes others fail; rows
    that repeat a doc_id with its text don't fail by each other. Null and empty texts are equal, and pass B to D. Without a
    column ``lang`` there is one part, the empty one. Texts are read in pieces of 1 MB; a larger text is held whole.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    own = docs.select("doc_id", part.alias("part"), text.alias("text"))
    n = own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), count_texts(rules)("text").alias("n"))
    stored = materialize(n.select("doc_id", "part", "digest", "n.*"), "counted")
    groups = stored.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    known = lookup(stored, groups, "digest", "doc_id", how="left", measure=True)
    bad = [F.col("n_words") < rules.min_words, 100 * F.col("n_distinct") < rules.min_distinct * F.col("n_words"),
           100 * F.col("n_capitals") > rules.max_capitals * F.col("n_points"), F.col("n_symbols") > 0,
           F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))]
    fails = sum((F.when(b, 1 << k).otherwise(0) for k, b in enumerate(bad)), F.lit(0))
    return known.select("doc_id", "part", *COUNTS, fails.alias("fails"))


def with_labels(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``good`` and ``toxic`` (0 or 1): whether any label of the doc_id says quality 1, toxic 1."""
    said = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return lookup(failed, known, "doc_id", "part", how="left", measure=True).select(*failed.columns, none("good"), none("toxic"))


def interactions(failed: DataFrame, names: str = NAMES) -> DataFrame:
    """What the filters ``names`` (one letter each) remove in each order, from rows ``part, fails, good, toxic``.

    A row per part, order and step: the documents kept after the step, removed in it, failing its filter but removed before
    (``redundant``), failing no other filter (``unique_fails``), removed though good or because toxic, and the filter's share
    over all orders (``shapley``). At most 2^n counts of a part meet; no task sees the rows of a part together.
    """
    n, orders = len(names), list(map("".join, itertools.permutations(names)))
    shares = F.lit("|".join(str(len(orders) // max(k, 1)) for k in range(n + 1)))  # each failing filter is first in as many orders
    counts = failed.groupBy("part", "fails").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    share = F.element_at(F.split(shares, r"\|"), F.bit_count("fails").cast("int") + 1).cast("long")
    entries = counts.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic", share.alias("share"))).alias("e"))
    steps = (entries.select("part", "e", F.explode(F.split(F.lit("|".join(orders)), r"\|")).alias("filter_order"))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
             .withColumn("bit", F.expr(f"shiftleft(1, instr('{names}', substring(filter_order, step, 1)) - 1)"))
             .withColumn("prior", F.expr(f"aggregate(sequence(1, step), 0, (a, k) -> if(k < step, a + shiftleft(1, instr('{names}', substring(filter_order, k, 1)) - 1), a))")))

    def total(column: str, holds: str) -> Column:
        return F.expr(f"aggregate(filter(e, x -> {holds}), 0L, (a, x) -> a + {column})")

    fails, before = "x.fails & bit != 0", "x.fails & prior != 0"
    here = f"{fails} and not {before}"
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), total("x.n", "x.fails & (prior | bit) = 0").alias("kept"), total("x.n", here).alias("removed"),
        total("x.n", f"{fails} and {before}").alias("redundant"), total("x.n", "x.fails = bit").alias("unique_fails"), total("x.good", here).alias("good_lost"),
        total("x.toxic", here).alias("toxic_lost"), total("x.n * x.share", fails).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``interactions`` of the filters A to E over all rows of ``docs``. An empty table gives no rows; other columns are ignored."""
    return interactions(with_labels(failures(docs, rules), labels))
