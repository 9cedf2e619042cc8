"""Packing of token sequences along a space-filling curve.

A document becomes a vector of hashed words, projected to a few dimensions by random signs. The place of that point on a
Hilbert curve is a sort key under which similar documents stand near each other. Documents are sorted by ranges of the key,
tokenized where they stand, and cut at every multiple of the sequence length along the curve: sequences hold neighbours, and
only the last one is padded.
"""
import os
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.batches import small_batches
from strandlake.llm.known_words import KnownWords
from strandlake.llm.words import LOWER, mix, pieces, word_hashes, word_places
from strandlake.operators.lookup import lookup
from strandlake.sources.store import materialize


STOPS = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?]+)([\x20\x09-\x0D]|$)"  # at the end of a word, behind a letter that stays one letter in lower case
ENCODED = 1 << 19  # bytes of text that are encoded at once
_ENCODERS: dict["Packing", "Encoder"] = {}  # of this worker, which runs one task after the other


@dataclass(frozen=True)
class Packing:
    """Parameters of the order and of the sequences."""
    length: int = 4096
    end_id: int = 2  # stands after each document
    tokenizer: str = "word_bpe_49k.json"  # name of a public tokenizer, or a path
    dimensions: int = 4
    bits: int = 8  # of each dimension
    bytes_per_part: int = 24 << 20  # of text, in a task of the sort

    def path(self) -> str:
        return self.tokenizer if "/" in self.tokenizer else str(public_tokenizers.path(self.tokenizer))


def project(words: np.ndarray, first: np.ndarray, packing: Packing) -> np.ndarray:
    """Points in the unit cube: sums of the words' random signs, by the length of the hashed vector, on an even scale."""
    n = np.diff(first)
    out = np.full((len(n), packing.dimensions), 0.5)
    full = np.flatnonzero(n)
    if len(full):
        signs = mix(words ^ np.uint64(0x1234567))
        for d in range(packing.dimensions):
            s = ((signs >> np.uint64(d)) & np.uint64(1)).astype(np.int64) * 2 - 1
            x = np.add.reduceat(s, first[:-1][full]) / np.sqrt(n[full])
            out[full, d] = 1 / (1 + np.exp(-x / 1.5))  # words repeat, so sums spread more than those of independent signs
    return out


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points in the unit cube (rows), with so many bits a dimension.

    The coordinates' bits are turned into the curve's by Skilling's transform, then interleaved.
    """
    x = np.minimum((points * (1 << bits)).astype(np.int64), (1 << bits) - 1).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key


def _curve(packing: Packing):
    """Arrow function of texts: their Hilbert keys."""
    def curve(texts: pa.Array) -> pa.Array:
        keys = [hilbert_key(project(*word_hashes(piece), packing), packing.bits) for _, piece in pieces(texts)]
        return pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64), pa.int64())
    return F.arrow_udf(curve, "long")


def lower_plain(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A-Z as a-z in words of ASCII letters alone, where the tokenizer does the same; not in others (composition comes first there)
    nor in those with ``|``, which may hold a special token."""
    low = LOWER[data]
    changed = np.flatnonzero(low != data)
    word_at = lambda places: np.searchsorted(starts, places, "right") - 1
    special = np.zeros(len(starts) + 1, bool)
    special[word_at(np.flatnonzero((data >= 128) | (data == ord("|"))))] = True
    back = changed[special[word_at(changed)]]
    low[back] = data[back]
    return low


class Encoder:
    """Token ids of many texts.

    The tokenizer splits at white space before anything else, and parts stops from the letter before them, so the ids of a text
    are those of its words and stops in a row.
    """

    def __init__(self, packing: Packing):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(packing.path())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.words = KnownWords(tokenizer, packing.end_id)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with the end id after each text, and where each text's begin. ``texts``: from ``pieces``."""
        data, starts, ends, first = word_places(pc.replace_substring_regex(texts, STOPS, r"\1 \2\3"))
        numbers = self.words.numbers(lower_plain(data, starts), starts, ends)
        first = first + np.arange(len(first))  # an end after each text
        order = np.zeros(first[-1], np.int64)
        inside = np.ones(first[-1], bool)
        inside[first[1:] - 1] = False
        order[inside] = numbers
        ids, stops = self.words.ids(order)
        return ids, stops[first]


def _encode(packing: Packing):
    """Task over rows in curve order: ``(doc_id, text, part, …)`` to ``(doc_id, part, place, ids)``; ``place`` counts a part's ids before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if packing not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[packing] = Encoder(packing)
        encoder, part, place = _ENCODERS[packing], None, 0
        for batch in batches:
            for at, piece in pieces(batch.column("text"), ENCODED):
                ids, first = encoder.encode(piece)
                parts = batch.column("part").slice(at, len(piece)).to_pylist()
                places = []
                for p, n in zip(parts, np.diff(first).tolist()):
                    if p != part:
                        part, place = p, 0
                    places.append(place)
                    place += n
                width = np.dtype("<u4")
                rows = [ids[a:b].astype(width).tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(piece)), pa.array(parts, pa.int32()), pa.array(places, pa.int64()), pa.array(rows, pa.binary())],
                                                 ["doc_id", "part", "place", "ids"])
    return run


def tokens_on_curve(docs: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """A stored table of all documents in curve order: ``doc_id, place`` (ids before it on the whole curve) and ``ids`` (binary, 4 bytes each)."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    parts = max(1, min(size["n"], -(-(size["bytes"] or 0) // packing.bytes_per_part)))
    keyed = texts.withColumn("curve", _curve(packing)("text"))
    # equal keys (copies) are told apart by a hash, so that a large group of copies is spread over ranges
    ranged = keyed.withColumn("spread", F.xxhash64("doc_id")).repartitionByRange(parts, "curve", "spread", "doc_id").sortWithinPartitions("curve", "spread", "doc_id", "text")
    with small_batches(docs.sparkSession):
        stored = materialize(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_encode(packing), "doc_id long, part int, place long, ids binary"), "curve")
    totals = stored.groupBy("part").agg(F.sum(F.octet_length("ids") / 4).cast("long").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("part", before.alias("before"))  # one row for each range of the sort
    placed = lookup(stored, starts, "part", "place", measure=True)
    return placed.select("doc_id", (F.col("before") + F.col("place")).alias("place"), "ids")


def pieces_of(tokens: DataFrame, packing: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """Cut the table of ``tokens_on_curve`` at the ends of sequences: a row per piece, with its ids (binary) on request."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in kinds]
            for doc, place, ids in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                ids, doc = ids.as_buffer(), doc.as_py()
                n, start = ids.size // 4, 0
                while start < n:
                    offset = (place + start) % packing.length
                    length = min(n - start, packing.length - offset)
                    own = ids.slice(4 * start, 4 * length)
                    row = [doc, start, length, crc32(own), n, (place + start) // packing.length, offset]
                    for column, x in zip(columns, row + [own.to_pybytes()] * with_ids):
                        column.append(x)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in schema.split(", ")])

    return tokens.mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, packing: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs (doc_id, text, …)``: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every id of a document, the end id included, lies in one piece; all sequences are full but the last. A null or empty text
    is the end id alone; repeated rows and null doc_ids are packed like others; other columns are ignored.
    """
    return pieces_of(tokens_on_curve(docs, packing), packing, with_ids)
