"""Words and shingles of many texts at once, as arrays of 64-bit hashes.

A word is a run of bytes other than the six ASCII white-space characters; A-Z count as a-z. These helpers run inside tasks,
on one Arrow batch at a time, and work through it in pieces of a few megabytes, so that memory doesn't follow the batch.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE = 1 << 20  # bytes of text that are worked on at once
LONG_WORD = 512  # bytes from which a word is hashed and compared on its own
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, pa.Array]]:
    """Cut a string array into runs of rows of about ``size`` bytes: first row and slice. Nulls become empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts from ``pieces``, and where each text begins (one number more than texts)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def word_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts from ``pieces``, the places where words begin and end, and where each text's words begin."""
    data, offsets = bytes_of(texts)
    if not len(data):
        none = np.empty(0, np.int64)
        return data, none, none, np.zeros(len(texts) + 1, np.int64)
    space = _SPACE[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0], before[1:], after[-1], after[:-1] = True, space[:-1], True, space[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return data, starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


class Spans:
    """Words as spans of bytes: hashes and comparisons of many of them, eight bytes at a time."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        self.data, self.starts, self.sizes = data, starts, ends - starts

    def _eight(self, which: np.ndarray, at: int) -> np.ndarray:
        """Bytes ``at`` to ``at + 8`` of words that have more than ``at``; zeros beyond the end."""
        left = np.minimum(self.sizes[which] - at, 8).astype(np.uint64)
        return self.eights[self.starts[which] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - left) * np.uint64(8)))

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k]:self.starts[k] + self.sizes[k]].tobytes()

    def hashes(self) -> np.ndarray:
        """64 bits for each word, the same on every machine."""
        out = mix(self.sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        which = np.flatnonzero(self.sizes < LONG_WORD)
        for at in range(0, LONG_WORD, 8):
            which = which[self.sizes[which] > at]
            if not len(which):
                break
            out[which] = mix(out[which] ^ self._eight(which, at)) + np.uint64(0x9E3779B97F4A7C15)
        for k in np.flatnonzero(self.sizes >= LONG_WORD).tolist():
            out[k] = xxhash.xxh3_64_intdigest(self.word(k))
        return mix(out)

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words ``a[k]`` and ``b[k]`` have the same bytes."""
        out = self.sizes[a] == self.sizes[b]
        open_ = np.flatnonzero(out & (self.sizes[a] < LONG_WORD))
        for at in range(0, LONG_WORD, 8):
            open_ = open_[self.sizes[a[open_]] > at]
            if not len(open_):
                break
            same = self._eight(a[open_], at) == self._eight(b[open_], at)
            out[open_[~same]] = False
            open_ = open_[same]
        for k in np.flatnonzero(out & (self.sizes[a] >= LONG_WORD)).tolist():
            out[k] = self.word(a[k]) == self.word(b[k])
        return out


def first_of_equals(spans: Spans, texts: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """For each word the place of the word that stands for all equal ones of its text (``texts``: number of each word's text).

    An open-addressing table into which all words that are still without an answer are put at once: a free slot goes to the
    first of them, whoever finds an equal word of its text there is done, the others go on to the next slot.
    """
    hashes = spans.hashes() if hashes is None else hashes
    hashes = mix(hashes ^ mix(texts.astype(np.uint64)))
    mask = (1 << max(4, int(2 * len(hashes)).bit_length())) - 1
    table, out = np.full(mask + 1, -1, np.int64), np.empty(len(hashes), np.int64)
    waiting, slot = np.arange(len(hashes)), (hashes & np.uint64(mask)).astype(np.int64)
    while len(waiting):
        free = np.flatnonzero(table[slot] < 0)[::-1]  # backwards, so that the first of several wins
        table[slot[free]] = waiting[free]
        owner = table[slot]
        found = owner == waiting
        open_ = np.flatnonzero(~found & (hashes[owner] == hashes[waiting]) & (texts[owner] == texts[waiting]))
        found[open_] = spans.equal(owner[open_], waiting[open_])
        out[waiting[found]] = owner[found]
        waiting, slot = waiting[~found], (slot[~found] + 1) & mask
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z as a-z, and where each text's words begin (one number more than texts). ``texts``: from ``pieces``."""
    data, starts, ends, first = word_places(texts)
    return Spans(LOWER[data], starts, ends).hashes(), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a text, and where each text's begin. A shorter text is one run of its own."""
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(n)])
    total = np.zeros(len(words), np.uint64)
    left = np.zeros(len(words), np.int64)  # words from here to the end of the text, at most k
    if len(words):
        left = np.minimum(np.repeat(first[1:], count) - np.arange(len(words)), k)
    for j in range(k):
        here = words[j:] * mix(np.array([j + 1], np.uint64))[0]
        total[:len(here)] += np.where(left[:len(here)] > j, here, np.uint64(0))
    total = mix(total + left.astype(np.uint64))
    at = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
    return total[at], begin


def distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes without repeats, in ascending order, and where each text's begin."""
    sets = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]
    return np.concatenate(sets) if sets else hashes, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
