import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm.queries import op12_tree_bpe
from strandlake.llm.tree_bpe import Coding, Codec, cuts, decode_array, decode_ids, encode_texts
from strandlake.llm.words import pieces

FRAGMENTS = ["<|endoftext|>", "<|endof", "text|>", "'s", "'re", "'", " the", " ", "  ", "\n", " ", "İ", "🦆", "漢字", "aaaa", "ab", "-----", "tion", "ing", "1234"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def tree_ids(codec, text, leaf):
    data = text.encode()
    at = cuts(data, leaf)
    return codec.join_all(data, [codec.leaf(data, a, b) for a, b in zip(at, at[1:])])


def test_joined_pieces_are_the_whole(tokenizer):
    """Pieces of any length, down to one byte, of texts that the splitter parts, hardly parts and doesn't part."""
    rng, codec = random.Random(5), Codec(Coding())
    for _ in range(250):
        pool = rng.choice([FRAGMENTS, FRAGMENTS, "ab", "a", " a", " \n\ta", "-=", "é漢🦆", "abcdefghijklmnopqrstuvwxyz"])
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 120))) * rng.choice([1, 1, 3])
        node, whole = tree_ids(codec, text, rng.choice([1, 3, 7, 16, 50])), tokenizer.encode(text, add_special_tokens=False)
        assert node.ids.tolist() == whole.ids, text
        words = np.array([-1, *whole.word_ids])
        assert node.begins.tolist() == (words[1:] != words[:-1]).tolist(), text


def test_short_texts_of_any_kind(tokenizer):
    rng, codec = random.Random(8), Codec(Coding())
    parts = [*FRAGMENTS, *" \xa0\u2003\x1c\x85éñüÀ.a1", "\u3000", "\u200b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([32, rng.randint(9, 127), rng.randint(0x80, 0x24F), rng.randint(0x2000, 0x206F), rng.randint(0xE000, 0x1FFFF)]))
                      for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for at, piece in pieces(pa.array(texts), 1 << 13):
        ids, first = codec.encode_short(piece)
        for k in range(len(piece)):
            assert ids[first[k]:first[k + 1]].tolist() == tokenizer.encode(texts[at + k], add_special_tokens=False).ids, texts[at + k]


def test_long_words(tokenizer):
    rng = random.Random(6)
    for text in ["a" * 70_001, "ab" * 20_000, " " * 50_000 + "x", "".join(rng.choice("abcdefghij") for _ in range(60_000)), "aé" * 20_000]:
        assert tree_ids(Codec(Coding()), text, 5000).ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_decode_any_ids(tokenizer):
    rng = random.Random(7)
    rows = [[rng.randint(0, 50_300) for _ in range(rng.randint(0, 30))] for _ in range(300)] + [[], [50_256] * 3]
    assert decode_array(pa.array(rows, pa.list_(pa.int32())), Coding()).to_pylist() == [tokenizer.decode(r, skip_special_tokens=False) for r in rows]
    assert decode_array(pa.array([[-1, 60_000, 1 << 30]], pa.list_(pa.int32())), Coding()).to_pylist() == [""]


def test_encode_texts(spark, tokenizer, words):
    """Short and long texts, copies of a long one, nulls, repeated rows, clashing columns."""
    long = [" ".join(words(n)) for n in (900, 1000, 3000)] + ["x" * 5000, "<|endoftext|> a " * 300]
    texts = ["", None, " ", "a <|endoftext|> b", "GELİ, GİT!", "a\x00b", *long] + [long[1]] * 40
    rows = [(i, t, "d") for i, t in enumerate(texts)] + [(None, "null id", "d"), (3, texts[3], "d"), (6, long[0], "d"), (6, long[0], "d"), (None, long[2], "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = encode_texts(docs, Coding(long_text=4000, leaf=500)).withColumn("back", decode_ids(F.col("ids")))
    expected = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _ in rows]
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted([(r.doc_id, r.ids, r.back) for r in got.collect()], key=order) == sorted(expected, key=order)
    assert encode_texts(docs.limit(0)).count() == 0


def test_query(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = {}
    for r in docs:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        expected[r.doc_id] = (len(ids), digest(",".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op12_tree_bpe(spark, folder).collect()} == expected
