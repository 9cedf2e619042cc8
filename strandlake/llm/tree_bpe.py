"""Byte-level BPE of whole texts, and back, with long texts as trees of joined pieces.

A long text is cut at fixed lengths, whatever stands there. The pieces are encoded in parallel; then neighbours are joined,
level by level: what stands around a cut is encoded again, in windows that grow until their first and last parts agree with
both sides. Two facts make the result exact. The splitter of the tokenizer reads from left to right and decides on a word within
``margin`` bytes behind it, so all words of the left piece that end before those are words of the whole, and from the first
place on where both sides begin a word the right piece's are. Within a word (which may be the whole text, if nothing splits it)
a row of tokens is the word's encoding if any two neighbours are the encoding of their own bytes; so a window whose first and
last tokens are those of the two sides can take their place.
"""
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.batches import small_batches
from strandlake.llm.known_words import KnownWords
from strandlake.llm.words import bytes_of, pieces
from strandlake.operators.lookup import lookup
from strandlake.sources.store import scratch_path

ENCODED = 1 << 19  # bytes of short texts, or ids, that are worked on at once
KNOWN = 500_000  # words of short texts that a worker remembers, at about 200 bytes each
_STOP = np.isin(np.arange(256), list(b".,;:!?"))
_CODECS: dict["Coding", "Vocabulary"] = {}  # of this worker


@dataclass(frozen=True)
class Coding:
    tokenizer: str = "byte_bpe_50k.json"  # name of a public tokenizer, or a path
    long_text: int = 32 << 10  # bytes from which a text is cut
    leaf: int = 8 << 10  # bytes of a piece, about

    def path(self) -> str:
        return self.tokenizer if "/" in self.tokenizer else str(public_tokenizers.path(self.tokenizer))


@dataclass
class Node:
    """The encoding of ``data[start:end]``: ids, and which of them begin a word of the splitter."""
    start: int
    end: int
    ids: np.ndarray
    begins: np.ndarray


def _letters() -> list[str]:
    """The character for each byte in byte-level vocabularies: itself where it prints, else the next one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


def _word_borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each byte surely begins a word of the splitter; ``offsets``: where texts begin."""
    padded = np.concatenate([np.zeros(2, np.uint8), data, np.zeros(1, np.uint8)])
    before, lead, after = padded[1:-2], padded[:-3], padded[3:]
    solid = lambda byte: (byte > 32) & (byte < 127)
    alone = (solid(before) | (lead == 0xC3)) & (solid(after) | (after == 0xC3))  # C3 leads the characters U+00C0 to U+00FF
    line = (data == 10) & alone
    letter = ((before | 32) >= ord("a")) & ((before | 32) <= ord("z"))
    out = ((data == 32) & alone) | line | (_STOP[data] & letter)
    out[1:] |= line[:-1]
    out[offsets[:-1][np.diff(offsets) > 0]] = True
    return out


class Vocabulary:
    """The bytes of each id, without the tokenizer."""

    def __init__(self, coding: Coding):
        back = {c: b for b, c in enumerate(_letters())}
        with open(coding.path(), encoding="utf-8") as file:  # read as it is: the tokenizer itself takes far more memory
            parts = json.load(file)
        vocab = parts["model"]["vocab"] | {t["content"]: t["id"] for t in parts["added_tokens"]}
        table = [b""] * (2 + max(vocab.values(), default=-1))  # the last is for ids outside the vocabulary, which have no text
        for token, i in vocab.items():
            table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.sizes = np.array([len(b) for b in table], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def inside(self, ids: np.ndarray) -> np.ndarray:
        """Ids with those outside the vocabulary as the last place of the table."""
        return np.where((ids >= 0) & (ids < len(self.sizes) - 1), ids, len(self.sizes) - 1)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        ids = self.inside(ids)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.first[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Codec(Vocabulary):
    """A byte-level tokenizer without a normalizer."""
    FIRST_WINDOW, FIRST_REACH = 4, 64  # tokens inside a word, bytes to the right of a cut

    def __init__(self, coding: Coding):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer
        super().__init__(coding)
        self.letters = np.array(_letters())
        self.tokenizer = Tokenizer.from_file(coding.path())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = KnownWords(self.tokenizer, most_words=KNOWN)
        self.model, self.splitter = self.tokenizer.model, self.tokenizer.pre_tokenizer
        added = self.tokenizer.get_added_tokens_decoder()
        if self.tokenizer.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{coding.tokenizer}: texts can't be cut for a tokenizer with a normalizer or with tokens that take in what is beside them")
        self.added = {t.content: i for i, t in added.items()}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.margin = 16 + max((len(t.encode()) for t in self.added), default=0)  # two code points behind a word, and an added token

    def encode_short(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts in a row and where each text's begin. ``texts``: from ``pieces``.

        Texts are cut where the splitter surely begins a word: at one blank, at and behind one line end, each between characters that
        are surely no white space, and at a stop behind a letter.
        """
        data, offsets = bytes_of(texts)
        starts = np.flatnonzero(_word_borders(data, offsets))
        ids, stops = self.known.ids(self.known.numbers(data, starts, np.append(starts[1:], len(data))[:len(starts)]))
        return ids.astype(np.int32), stops[np.searchsorted(starts, offsets)]

    def leaf(self, data: bytes, start: int, end: int) -> Node:
        e = self.tokenizer.encode(data[start:end].decode(), add_special_tokens=False)
        words = np.array([-1, *e.word_ids], np.int64)
        return Node(start, end, np.array(e.ids, np.int64), words[1:] != words[:-1])

    def words(self, text: str) -> list[str | int]:
        """Words of the splitter, in the vocabulary's letters (a letter per byte), and ids of added tokens."""
        out = []
        for part in self.added_pattern.split(text) if self.added_pattern else [text]:
            out += [self.added[part]] if part in self.added else [w for w, _ in self.splitter.pre_tokenize_str(part)] if part else []
        return out

    def word_ids(self, word: str) -> np.ndarray:
        return np.array([t.id for t in self.model.tokenize(word)], np.int64)

    def join_word(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of one word from those of its two parts."""
        window = self.FIRST_WINDOW
        while True:
            i, j = max(0, len(left) - window), min(len(right), window)
            middle = self.word_ids("".join(self.letters[self.bytes_of(np.concatenate([left[i:], right[:j]]))].tolist()))
            if (i == 0 or middle[0] == left[i]) and (j == len(right) or middle[-1] == right[j - 1]):
                return np.concatenate([left[:i], middle, right[j:]])
            window *= 2

    def join(self, data: bytes, left: Node, right: Node) -> Node:
        """The encoding of two neighbouring pieces as one text."""
        cut = right.start
        left_at = left.start + np.cumsum(self.sizes[left.ids]) - self.sizes[left.ids]
        right_at = right.start + np.cumsum(self.sizes[right.ids]) - self.sizes[right.ids]
        left_words = np.append(np.flatnonzero(left.begins), len(left.ids))  # places in ids
        right_words = np.append(np.flatnonzero(right.begins), len(right.ids))
        left_starts, right_starts = np.append(left_at, cut)[left_words], np.append(right_at, right.end)[right_words]
        known = max(0, int(np.searchsorted(left_starts[:-1], cut - self.margin, "right")) - 1)  # the last word that surely begins there
        begin, reach = int(left_starts[known]), self.FIRST_REACH
        while True:
            end = min(cut + reach, right.end)
            while end < right.end and data[end] & 0xC0 == 0x80:
                end += 1
            words = self.words(data[begin:end].decode())
            sizes = np.array([len(w) if isinstance(w, str) else int(self.sizes[w]) for w in words], np.int64)
            starts = begin + np.append(0, np.cumsum(sizes))
            sure = starts <= (end if end == right.end else end - self.margin)
            agreed = np.flatnonzero(sure & (starts >= cut) & np.isin(starts, right_starts))
            if len(agreed):
                break
            reach *= 8
        n = int(agreed[0])
        rows = []
        for word, u, v in zip(words[:n], starts[:n].tolist(), starts[1:n + 1].tolist()):
            if isinstance(word, int):
                rows.append(np.array([word], np.int64))
                continue
            k = known + int(np.searchsorted(left_starts[known:], u))
            same_left = k < len(left_starts) - 1 and left_starts[k] == u
            if same_left and left_starts[k + 1] == v:  # a word of the left piece
                rows.append(left.ids[left_words[k]:left_words[k + 1]])
            elif same_left and left_starts[k + 1] == cut and len(right_starts) > 1 and right_starts[1] == v:  # its last and the right piece's first
                rows.append(self.join_word(left.ids[left_words[k]:], right.ids[:right_words[1]]))
            else:
                rows.append(self.word_ids(word))
        rest = right_words[int(np.searchsorted(right_starts, starts[n]))]
        middle = [np.arange(len(r)) == 0 for r in rows]
        return Node(left.start, right.end, np.concatenate([left.ids[:left_words[known]], *rows, right.ids[rest:]]),
                    np.concatenate([left.begins[:left_words[known]], *middle, right.begins[rest:]]))

    def join_all(self, data: bytes, nodes: list[Node]) -> Node:
        """Neighbours are joined to halves of the next level, up to the whole text."""
        while len(nodes) > 1:
            pairs = [self.join(data, *nodes[k:k + 2]) for k in range(0, len(nodes) - 1, 2)]
            nodes = pairs + nodes[len(nodes) - len(nodes) % 2:]
        return nodes[0]


def codec(coding: Coding, kind: type[Vocabulary] = Codec) -> Vocabulary:
    """The codec (or the vocabulary alone) of this worker."""
    known = _CODECS.get(coding)
    if not isinstance(known, kind):
        _CODECS.clear()
        known = _CODECS[coding] = kind(coding)
    return known


def cuts(data: bytes, leaf: int) -> list[int]:
    """Places at about every ``leaf`` bytes, moved to the beginning of a code point."""
    places = [0]
    for at in range(leaf, len(data), leaf):
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        if places[-1] < at < len(data):
            places.append(at)
    return [*places, len(data)]


def _list_array(flat: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, pa.int32()))


def _short(coding: Coding):
    def run(texts: pa.Array) -> pa.Array:
        rows = [_list_array(*codec(coding).encode_short(piece)) for _, piece in pieces(texts, ENCODED)]
        return pa.concat_arrays(rows) if rows else pa.array([], pa.list_(pa.int32()))
    return F.arrow_udf(run, "array<int>")


def _cut(coding: Coding):
    """``(digest, text)`` to ``(digest, leaf, data)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column(0), batch.column(1)):
                data = memoryview(text.as_buffer())
                at = cuts(data, coding.leaf)
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays([pa.array([digest.as_py()] * n, pa.binary()), pa.array(range(n), pa.int32()),
                                                  pa.array([bytes(data[a:b]) for a, b in zip(at, at[1:])], pa.binary())], ["digest", "leaf", "data"])
    return run


def _leaves(coding: Coding):
    """``(digest, leaf, data)`` to the same with ids (4 bytes each) and a byte per id that tells whether it begins a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [codec(coding).leaf(data, 0, len(data)) for data in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.ids.astype("<u4").tobytes() for x in nodes], pa.binary()),
                                              pa.array([x.begins.tobytes() for x in nodes], pa.binary())], ["digest", "leaf", "data", "ids", "begins"])
    return run


def _joined(coding: Coding):
    """All leaves of a text to its ids."""
    def run(key, group):
        rows = group.select(["data", "ids", "begins"]).take(pc.sort_indices(group["leaf"])).to_pydict()
        at = np.cumsum([0, *map(len, rows["data"])]).tolist()
        nodes = [Node(a, b, np.frombuffer(i, "<u4").astype(np.int64), np.frombuffer(w, bool)) for a, b, i, w in zip(at, at[1:], rows["ids"], rows["begins"])]
        ids = codec(coding).join_all(b"".join(rows["data"]), nodes).ids
        return pa.table({"digest": pa.array([key[0].as_py()], pa.binary()), "ids": _list_array(ids, np.array([0, len(ids)]))})
    return run


def encode_texts(docs: DataFrame, coding: Coding = Coding()) -> DataFrame:
    """A stored table ``doc_id, ids`` (array of int) for all rows of ``docs (doc_id, text, …)``: the ids that the tokenizer gives the whole text.

    A null or empty text has no ids. Texts of ``long_text`` bytes or more become rows of their pieces, which are dealt over all
    tasks, once for equal texts; one task then joins the pieces of a text, in memory for a few times that text. Null and
    repeated doc_ids are rows like others; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    is_long = F.octet_length("text") >= max(1, coding.long_text)
    short = rows.filter(~is_long).select("doc_id", _short(coding)("text").alias("ids"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    long = rows.filter(is_long)
    leaves = long.select(digest, "text").mapInArrow(_cut(coding), "digest binary, leaf int, data binary").dropDuplicates(["digest", "leaf"])
    encoded = leaves.mapInArrow(_leaves(coding), "digest binary, leaf int, data binary, ids binary, begins binary")
    whole = encoded.groupBy("digest").applyInArrow(_joined(coding), "digest binary, ids array<int>")
    spark, rows = docs.sparkSession, short.unionByName(lookup(long.select("doc_id", digest), whole, "digest", "doc_id").select("doc_id", "ids"))
    path = scratch_path(spark, "ids")
    with small_batches(spark):
        rows.write.option("compression", "zstd").parquet(path)  # ids take more room than texts otherwise
    return spark.read.schema(rows.schema).parquet(path)


def decode_array(ids: pa.Array, coding: Coding) -> pa.Array:
    """The texts of lists of ids; bytes that aren't UTF-8 become U+FFFD, ids outside the vocabulary nothing."""
    own, texts, at = codec(coding, Vocabulary), [], 0
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    while at < len(ids):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + ENCODED, "right")))
        flat = ids.slice(at, to - at).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        data = own.bytes_of(flat).tobytes()
        stops = np.concatenate([[0], np.cumsum(own.sizes[own.inside(flat)])])[np.concatenate([[0], ends[at:to] - base])].tolist()
        texts += [data[a:b].decode("utf-8", "replace") for a, b in zip(stops, stops[1:])]
        at = to
    return pa.array(texts, pa.string())


def decode_ids(ids: Column, coding: Coding = Coding()) -> Column:
    """The text of an array of ids, special tokens included. A null array, or a null in it, has no text."""
    def run(rows: pa.Array) -> pa.Array:
        return decode_array(rows, coding)
    return F.arrow_udf(run, "string")(F.filter(F.coalesce(ids, F.array().cast("array<int>")), lambda x: x.isNotNull()))
