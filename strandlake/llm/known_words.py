"""Token ids of words that return: each different word is encoded once, as long as it is remembered."""
from itertools import chain

import numpy as np

from strandlake.llm.words import Spans, first_of_equals


class KnownWords:
    """Words are the same if their bytes are. All is forgotten when too much is known, so memory is bounded.

    Number 0 stands for ``end``, an id that belongs to no word.
    """
    AT_ONCE = 1_000

    def __init__(self, tokenizer, end: int = 0, most_words: int = 300_000):
        self.tokenizer, self.end, self.most_words, self.most_ids = tokenizer, end, most_words, 7 * most_words
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sizes, self.flat = np.ones(1, np.int64), np.array([self.end], np.uint32)  # by number

    def learn(self, words: list[bytes]) -> np.ndarray:
        """Numbers of different words."""
        if len(self.known) > self.most_words or len(self.flat) > self.most_ids:
            self.forget()
        numbers = list(map(self.known.get, words))
        new = [k for k, n in enumerate(numbers) if n is None]
        sizes, flat = [self.sizes], [self.flat]
        for at in range(0, len(new), self.AT_ONCE):
            some = [words[k].decode() for k in new[at:at + self.AT_ONCE]]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        for k, n in zip(new, range(len(self.sizes), len(self.sizes) + len(new))):
            numbers[k] = self.known[words[k]] = n
        self.sizes, self.flat = np.concatenate(sizes), np.concatenate(flat)
        return np.array(numbers, np.int64)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, a span of ``data``."""
        same = first_of_equals(Spans(data, starts, ends), np.zeros(len(starts), np.int64))
        distinct = np.flatnonzero(same == np.arange(len(same)))
        raw, out = data.tobytes(), np.empty(len(same), np.int64)
        out[distinct] = self.learn([raw[a:b] for a, b in zip(starts[distinct].tolist(), ends[distinct].tolist())])
        return out[same]

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and where each word's begin (one number more than words)."""
        n, begin = self.sizes[numbers], np.cumsum(self.sizes) - self.sizes
        stops = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(begin[numbers] - stops[:-1], n) + np.arange(stops[-1])], stops
