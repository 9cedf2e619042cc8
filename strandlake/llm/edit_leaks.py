"""Benchmark decontamination by edit distance: CGK walks, repeated bit sampling, exact verification.

The CGK walk maps a sequence of words to a longer one: at step j it writes the word it stands on and then stays or moves on
by one, as the j-th random bit of that word says. Two windows that start alike stay aligned, and after an edit their walks
fall back into step, so a small edit distance becomes a small Hamming distance. Each table has a walk of its own and samples
a few of its steps; windows that agree with an item on these are candidates. Every word of a text begins a window, and an
item is walked from each of its words on, so that an edit near the start of an item costs nothing. A window is as long as
the item it is held against. Candidates are verified by the exact word edit distance.
"""
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.words import mix, pieces, word_hashes
from strandlake.operators.lookup import small_enough
from strandlake.sources.store import materialize

SCHEMA = "doc_id long, item_id long, start_word long, end_word long, distance int, item_words int"


@dataclass(frozen=True)
class Leaks:
    """Parameters of the search."""
    similarity: float = 0.8  # 1 - edit distance / words of the item, at least
    steps: tuple[int, ...] = (7, 7, 9, 9, 11, 11, 14, 14)  # of each table's walk
    samples: int = 4  # steps that a table samples
    short_words: int = 15  # items of fewer words are found by exact parts, which miss nothing
    block_items: int = 20_000  # items that are held against the corpus in one pass
    block_chars: int = 20_000_000

    def edits(self, words: int) -> int:
        return int((1 - self.similarity) * words + 1e-9)


def _sampled(table: int, leaks: Leaks) -> list[int]:
    """The first step, the last, and steps spread evenly between, each moved by a fixed random number."""
    last, k = leaks.steps[table] - 1, leaks.samples
    moved = np.random.default_rng(table).integers(-1, 2, k)
    inner = [min(last, max(0, round(i * last / (k - 1)) + int(moved[i]))) for i in range(1, k - 1)]
    return sorted({0, *inner, last})


def walk_keys(words: np.ndarray, table: int, leaks: Leaks, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the window that begins at each word: hash of the sampled steps, last word that these touch, number of words sampled.

    The walk stops at the last word, or at the place ``end`` that is given for each word.
    """
    bits = mix(words ^ np.uint64(0xA5A5A5A5 * (table + 1)))
    at = np.arange(len(words))
    key = np.zeros(len(words), np.uint64)
    places, before = np.zeros(len(words), np.int8), np.full(len(words), -1)
    sampled, end = set(_sampled(table, leaks)), max(len(words) - 1, 0) if end is None else end
    for j in range(leaks.steps[table]):
        if j in sampled:
            key = (key ^ words[at]) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(32)
            places += at != before
            before = at.copy()
        if j < leaks.steps[table] - 1:
            at += ((bits[at] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
            np.minimum(at, end, out=at)
    return mix(key), at, places


class Items:
    """Items of one block: their words and, per table, the sorted keys of their windows. All items are walked at once."""

    def __init__(self, texts: list[str], leaks: Leaks):
        self.leaks, self.words = leaks, []
        walked, parts = [[] for _ in leaks.steps], {}  # parts of short items by their number of words
        for at, piece in pieces(pa.array(texts, pa.large_string())):
            words, first = word_hashes(piece)
            self.words += np.split(words, first[1:-1])
            count = np.diff(first)
            owner, end = np.repeat(np.arange(len(count)), count), np.repeat(first[1:] - 1, count)
            found = np.zeros(len(count), bool)
            for table in range(len(leaks.steps)):
                keys, last, places = walk_keys(words, table, leaks, end)
                # a sample of fewer words says too little
                inside = np.flatnonzero((last < end) & (places >= leaks.samples) & (count[owner] >= leaks.short_words))
                found[owner[inside]] = True
                walked[table].append((keys[inside], at + owner[inside], inside - first[owner[inside]]))
            for n in np.unique(count[~found & (count > 0)]).tolist():
                same = np.flatnonzero(~found & (count == n))
                for part in np.array_split(np.arange(n), leaks.edits(n) + 1):  # edits leave one of them as it is
                    if len(part):
                        keys = _hash_columns(words[first[same] + i] for i in part)
                        parts.setdefault(len(part), []).append((keys, at + same, np.full(len(same), part[0])))
        self.tables = [_sorted(rows) for rows in walked]
        self.parts = {size: _sorted(rows) for size, rows in parts.items()}


def _sorted(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple:
    """Keys in ascending order with their items, the places in these, and the filter of the keys."""
    keys, owner, anchor = (np.concatenate(x) for x in zip(*rows)) if rows else (np.empty(0, t) for t in (np.uint64, np.int64, np.int64))
    order = np.lexsort((anchor, owner, keys))
    keys = keys[order]
    return keys, owner[order].astype(np.int32), anchor[order].astype(np.int32), _filter(keys)


_HELD: dict[str, Items] = {}


def held_items(block: str, texts: list[str], leaks: Leaks) -> Items:
    """The items of a block, built once by each Python worker; the block before it is let go."""
    if block not in _HELD:
        _HELD.clear()
        _HELD[block] = Items(texts, leaks)
    return _HELD[block]


def _hash_columns(columns: Iterable[np.ndarray]) -> np.ndarray:
    key = np.uint64(0)
    for j, words in enumerate(columns):
        key = mix(key ^ words) + np.uint64(j)
    return key


def _run_keys(words: np.ndarray, n: int) -> np.ndarray:
    runs = max(len(words) - n + 1, 0)
    return _hash_columns(words[j:j + runs] for j in range(n))


def _filter(keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """A bitmap over the top bits of the keys, eight places to a byte, about one place in 64 set."""
    bits = max(10, int(np.ceil(np.log2(64 * max(len(keys), 1)))))
    seen = np.zeros(1 << bits, bool)
    shift = np.uint64(64 - bits)
    seen[(keys >> shift).astype(np.int64)] = True
    return np.packbits(seen, bitorder="little"), shift


def _matches(keys: np.ndarray, wanted: np.ndarray, seen: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``keys``, place in ``wanted``) with equal keys; ``wanted`` is sorted and may repeat keys."""
    place = (keys >> shift).astype(np.int64)
    at = np.flatnonzero((seen[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
    low, high = (np.searchsorted(wanted, keys[at], side) for side in ("left", "right"))
    n = high - low
    begin = np.cumsum(n) - n
    return np.repeat(at, n), np.repeat(low - begin, n) + np.arange(n.sum())


def best_window(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Smallest word edit distance between the item and a run of the text: distance, first word, word after the last.

    Of equal distances the run that ends first counts, then the one that starts last.
    """
    n, m = len(item), len(text)
    places = np.arange(m + 1)
    scale = m + 2
    cost = m - places  # distance * scale + (m - first word), as one number, so that starts come along
    for i in range(n):
        step = np.minimum(cost[:-1] + np.where(text == item[i], 0, scale), cost[1:] + scale)
        row = np.concatenate([[cost[0] + scale], step]) - places * scale
        cost = np.minimum.accumulate(row) + places * scale
    end = int(np.argmin(cost // scale))
    return int(cost[end] // scale), m - int(cost[end] % scale), end


def _near(words: np.ndarray, start: np.ndarray, owner: np.ndarray, items: Items) -> np.ndarray:
    """Which candidates hold as many of the item's words, each within the edits of its place, as a match can't do without."""
    near = np.zeros(len(start), bool)
    for n in np.unique(owner).tolist():
        item = items.words[n]
        k, mine = items.leaks.edits(len(item)), np.flatnonzero(owner == n)
        held = np.zeros(len(mine), np.int64)
        for i, word in enumerate(item):
            places = start[mine, None] + np.arange(i - k, i + k + 1)
            held += ((words[np.clip(places, 0, len(words) - 1)] == word) & (places >= 0) & (places < len(words))).any(1)
        near[mine] = held >= len(item) - k
    return near


def _search(words: np.ndarray, first: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """Verified matches: number of the text, number of the item, first word, word after the last, distance."""
    leaks, found = items.leaks, []
    for table, (wanted, owner, anchor, (seen, shift)) in enumerate(items.tables):
        if len(wanted) and len(words):
            at, to = _matches(walk_keys(words, table, leaks)[0], wanted, seen, shift)
            found.append((at, owner[to], at - anchor[to]))
    for size, (wanted, owner, anchor, (seen, shift)) in items.parts.items():
        at, to = _matches(_run_keys(words, size), wanted, seen, shift)
        near = _near(words, at - anchor[to], owner[to], items)
        found.append((at[near], owner[to[near]], (at - anchor[to])[near]))
    if not found:
        return
    at, owner, start = (np.concatenate(x) for x in zip(*found))
    doc = np.searchsorted(first, at, "right") - 1
    rows = np.unique(np.stack([doc, owner, start], 1), axis=0)
    group = None
    for d, n, s in rows.tolist():
        item = items.words[n]
        k = leaks.edits(len(item))
        if group and group[:2] == (d, n) and s <= group[3] + k:  # windows that overlap in all but the allowed edits
            group = (d, n, group[2], s)
            continue
        if group:
            yield from _verify(group, words, first, items)
        group = (d, n, s, s)
    if group:
        yield from _verify(group, words, first, items)


def _verify(group: tuple[int, int, int, int], words: np.ndarray, first: np.ndarray, items: Items):
    d, n, low, high = group
    item = items.words[n]
    k = items.leaks.edits(len(item))
    a, b = max(low - k, first[d]), min(high + len(item) + k, first[d + 1])
    distance, start, end = best_window(words[a:b], item)
    if distance <= k:
        yield d, n, int(a - first[d]) + start, int(a - first[d]) + end, distance


def _blocks(items: DataFrame, leaks: Leaks) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, one block on the driver at a time."""
    block, chars = [], 0
    for row in items.select("item_id", "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        chars += len(row["text"])
        if len(block) >= leaks.block_items or chars >= leaks.block_chars:
            yield block
            block, chars = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, leaks: Leaks = Leaks()) -> DataFrame:
    """Runs of words in ``docs (doc_id, text, …)`` within the edit limit of an item of ``items (item_id, text, …)``.

    One row per document, item and place: ``doc_id, item_id, start_word, end_word`` (exclusive), ``distance`` in words and
    ``item_words``. Items are the query set: the corpus is read once for each block of them, and never shuffled. Null and
    empty texts or items match nothing; a null doc_id or item_id stays null; repeated rows match each; other columns are
    ignored. A text of any length is searched whole, in one task. Items of fewer than ``short_words`` words are looked up by parts, of which the edits leave one as it is, so that
    none of their places is missed.
    """
    spark, out = docs.sparkSession, None
    for block in _blocks(items, leaks):
        shared = spark.sparkContext.broadcast([uuid4().hex, [i for i, _ in block], [t for _, t in block], leaks])

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            name, ids, texts, leaks = shared.value
            held = held_items(name, texts, leaks)
            for batch in batches:
                keys, columns = batch.column(0), [[] for _ in range(6)]
                for base, piece in pieces(batch.column(1)):
                    words, first = word_hashes(piece)
                    for d, n, start, end, distance in _search(words, first, held):
                        for column, x in zip(columns, (keys[base + d].as_py(), ids[n], start, end, distance, len(held.words[n]))):
                            column.append(x)
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def drop_leaks(docs: DataFrame, items: DataFrame, leaks: Leaks = Leaks()) -> DataFrame:
    """``docs`` without the documents that hold an item. Rows with a null doc_id are dropped if any such row holds one."""
    bad = materialize(find_leaks(docs, items, leaks).select(F.col("doc_id").alias("__bad")).distinct(), "leaks")
    return docs.join(F.broadcast(bad) if small_enough(bad) else bad, F.col("doc_id").eqNullSafe(F.col("__bad")), "left_anti")
