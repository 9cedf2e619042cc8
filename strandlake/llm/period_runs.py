"""Periodic runs of words: maximal stretches that repeat a period at least four times.

The words of a text become a run-length grammar by recompression: equal neighbours become blocks, then the symbols are dealt to
two sides and each neighbouring left-right pair becomes one symbol, in turn, until no symbol occurs twice. Both rules look at the
symbols alone, so equal stretches are parsed alike but for their borders, and how far two places agree can be read off the levels
of the grammar: up while the symbols agree, down where they part. For each period p the places 0, 3p, 6p, … are candidates (a
harmonic grid, n log n of them): a run of four periods holds one of them together with the place one period on, and agreement
to both sides of the two gives its exact borders.
"""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.words import Spans, first_of_equals, mix, pieces, word_places

CANDIDATES = 400_000  # places of the grid that are looked at together


@dataclass(frozen=True)
class Periods:
    min_length: int = 6  # words
    min_exponent: int = 4  # periods in a run; the grid rests on at least three


@dataclass
class Level:
    """A sequence of the grammar and how it is parsed into the next one."""
    symbols: np.ndarray
    blocks: bool = False  # whether the next level's symbols are blocks of equal symbols here, or pairs
    first: np.ndarray | None = None  # where each symbol of the next level begins here, and the end
    parent: np.ndarray | None = None  # of each place


class Grammar:
    """Levels of recompression of ``symbols``, whose first and last symbols must occur nowhere else."""
    DEALS = 4  # ways to deal the symbols that are tried at each level

    def __init__(self, symbols: np.ndarray):
        self.levels, self.count = [], int(symbols.max()) + 1
        while True:
            level = Level(symbols)
            self.levels.append(level)
            ordered = np.sort(symbols)
            if (ordered[1:] != ordered[:-1]).all():
                return
            symbols = self._next(level)

    def _next(self, level: Level) -> np.ndarray:
        s = level.symbols
        new = np.append(True, s[1:] != s[:-1])
        if not new.all():
            level.blocks = True
            first = np.flatnonzero(new)
            size, out = np.diff(np.append(first, len(s))), s[first].copy()
            many = size > 1
            out[many] = self._name(out[many], size[many])
        else:
            joined = max(self._deals(s), key=np.count_nonzero)  # place k: whether k and k + 1 are a pair
            first = np.flatnonzero(np.append(True, ~joined))
            out, pair = s[first].copy(), np.append(joined, False)[first]
            out[pair] = self._name(s[first[pair]], s[first[pair] + 1])
        level.first = np.append(first, len(s))
        level.parent = np.repeat(np.arange(len(first)), np.diff(level.first))
        return out

    def _deals(self, s: np.ndarray) -> Iterator[np.ndarray]:
        spread = mix(mix(s.astype(np.uint64)) + np.uint64(len(self.levels)))
        for k in range(self.DEALS):
            side = (spread >> np.uint64(k)) & np.uint64(1) == 1
            yield side[:-1] & ~side[1:]
            yield ~side[:-1] & side[1:]

    def _name(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """New symbols, one for each rule (a, b)."""
        rules, number = np.unique((a << 31) | b, return_inverse=True)
        self.count += len(rules)
        return number + self.count - len(rules)

    def agreement(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """For each two different places, on how many symbols they agree, forward (``step`` 1) or backward (-1), their own included."""
        x, y, begin = x.copy(), y.copy(), x
        parted = np.full(len(x), -1)
        edge = (lambda level, k: level.first[k]) if step > 0 else (lambda level, k: level.first[k + 1] - 1)
        there = lambda level, at: np.abs(edge(level, level.parent[at] + step) - at)  # noqa: E731 - symbols from here to the block's end
        open_ = np.arange(len(x))
        for k, level in enumerate(self.levels):
            differ = level.symbols[x[open_]] != level.symbols[y[open_]]
            parted[open_[differ]] = k
            open_ = open_[~differ]
            if not len(open_):
                break
            a, b = x[open_], y[open_]
            off = (edge(level, level.parent[a]) != a) | (edge(level, level.parent[b]) != b)
            if level.blocks:
                left, right = there(level, a[off]), there(level, b[off])
                move = np.minimum(left, right)
                over = np.flatnonzero(off)[left != right]  # one block ends before the other
            else:
                move, over = 1, np.empty(0, np.int64)
            a[off] += step * move
            b[off] += step * move
            parted[open_[over]] = k
            x[open_], y[open_] = a, b
            open_ = np.delete(open_, over)
            x[open_], y[open_] = level.parent[x[open_]], level.parent[y[open_]]
        for k in range(int(parted.max(initial=0)) - 1, -1, -1):
            level, down = self.levels[k], np.flatnonzero(parted > k)
            a, b = edge(level, x[down]), edge(level, y[down])
            same = level.symbols[a] == level.symbols[b]
            move = np.minimum(there(level, a[same]), there(level, b[same])) if level.blocks else 1
            a[same] += step * move
            b[same] += step * move
            x[down], y[down] = a, b
        return np.abs(x - begin)


def _grid(first: np.ndarray, periods: Periods) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (place, period) of all texts, some at a time; ``first``: where each text's words begin."""
    n = np.diff(first)
    most = np.where(n >= periods.min_length, n // periods.min_exponent, 0)
    text = np.repeat(np.arange(len(n)), most)
    p = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    stride = (periods.min_exponent - 1) * p
    count = (n[text] - 1 - p) // stride + 1
    ends = np.cumsum(count)
    at = 0
    while at < len(text):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + CANDIDATES, "right")))
        some = count[at:to]
        nth = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        yield np.repeat(first[:-1][text[at:to]], some) + nth * np.repeat(stride[at:to], some), np.repeat(p[at:to], some)
        at = to


def runs_of(words: np.ndarray, first: np.ndarray, periods: Periods = Periods()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of many texts, by text, start and period: number of the text, start in it, length, period.

    ``words``: numbers of the words of all texts in a row, equal for equal words; ``first``: where each text's words begin.
    """
    n_texts = len(first) - 1
    found = [np.empty((0, 3), np.int64)]
    if len(words):
        ends = int(words.max()) + 1 + np.arange(n_texts + 1)  # a symbol of its own before, between and behind texts
        sequence = np.insert(words, first, ends)
        grammar = Grammar(sequence)
        moved = first + np.arange(n_texts + 1) + 1  # where each text's words begin in the sequence
        for at, p in _grid(first, periods):
            at = at + np.searchsorted(first, at, "right")
            keep = sequence[at] == sequence[at + p]
            at, p = at[keep], p[keep]
            right = grammar.agreement(at, at + p, 1)
            left = grammar.agreement(at, at + p, -1) - 1
            start, length = at - left, left + p + right
            keep = length >= np.maximum(periods.min_length, periods.min_exponent * p)
            found.append(np.unique(np.column_stack([start, length, p])[keep], axis=0))
    rows = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    if len(rows):
        rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))]  # the smallest period of a stretch
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        text = np.searchsorted(moved, rows[:, 0], "right") - 1
        return text, rows[:, 0] - moved[text], rows[:, 1], rows[:, 2]
    none = np.empty(0, np.int64)
    return none, none, none, none


def _piece(texts: pa.Array, periods: Periods) -> pa.Array:
    data, starts, ends, first = word_places(texts)
    spans = Spans(data, starts, ends)
    text, start, length, period = runs_of(first_of_equals(spans, np.zeros(len(starts), np.int64)), first, periods)
    cover = np.zeros(len(starts) + 1, np.int64)  # a word goes if a run holds it behind its first period
    np.add.at(cover, first[text] + start + period, 1)
    np.add.at(cover, first[text] + start + length, -1)
    kept = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
    sizes = spans.sizes[kept] + 1  # with a blank
    stops = np.cumsum(sizes)
    out = np.full(stops[-1] if len(stops) else 0, 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[stops - 1] = False
    out[inside] = data[np.repeat(starts[kept] - (stops - sizes), sizes)[inside] + np.flatnonzero(inside)]
    begin = np.append(0, stops)[np.searchsorted(kept, first)]
    raw = out.tobytes()
    rests = [raw[a:max(a, b - 1)] for a, b in zip(begin.tolist(), begin[1:].tolist())]
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(first))), pa.int32()), runs)
    return pa.StructArray.from_arrays([pa.array(np.diff(first), pa.int64()), lists, pa.array(rests, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])


KIND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
ARROW_KIND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def find_in(texts: pa.Array, periods: Periods = Periods()) -> pa.Array:
    """``n_words, runs, collapsed`` of each text; a null counts as an empty text."""
    rows = [_piece(piece, periods).cast(ARROW_KIND) for _, piece in pieces(texts)]
    return pa.concat_arrays(rows) if rows else pa.array([], ARROW_KIND)


def find_runs(docs: DataFrame, periods: Periods = Periods()) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for all rows of ``docs (doc_id, text, …)``.

    ``runs`` holds every maximal stretch of words with smallest period q that is at least ``min_exponent`` q and ``min_length``
    words long, as (start, length, period) by start, then period. ``collapsed`` are the words, joined by blanks, without those that
    a run holds behind its first q words. A null or empty text, or one of white space, has no words and no runs. Null and repeated
    doc_ids are rows like others; other columns are ignored. Texts are read in pieces of 1 MB; a larger text is held whole, with
    about 150 bytes for each of its words.
    """
    def run(texts: pa.Array) -> pa.Array:
        return find_in(texts, periods)
    found = F.arrow_udf(run, KIND)(F.col("text").cast("string"))
    return docs.select("doc_id", "text").select("doc_id", found.alias("f")).select("doc_id", "f.*")


def longest(runs: str) -> F.Column:
    """The run of the greatest exact length by period; of equal ones the first in ``runs``. Null if there is none."""
    return F.expr(f"aggregate({runs}, cast(null as struct<start: bigint, length: bigint, period: bigint>), "
                  "(b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")


def with_echoes(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``docs`` where every tenth text repeats itself from some word on; other white space is left as it is.

    With h the CRC-32 of the decimal doc_id, g = h div 10 and n words: if h ends in 0 and n > 0, each word i >= a becomes word
    a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8). A null doc_id leaves its text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(F.pmod(h, F.lit(10)) == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    sized = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("*", words.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    placed = sized.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    echo = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[int(a + (i - a) % p)])), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, echo).otherwise(F.col("text")).alias("text"))
