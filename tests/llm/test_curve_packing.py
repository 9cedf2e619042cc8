import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from strandlake.llm.curve_packing import Encoder, Packing, hilbert_key, pack_documents, project
from strandlake.llm.words import pieces, word_hashes


def test_hilbert_neighbours_are_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = hilbert_key((cells + 0.5) / (1 << bits), bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def documents(words):
    rng = random.Random(2)
    texts = [" ".join(words(rng.choice([0, 1, 30, 400, 3000]))) for _ in range(60)]
    odd = ["", None, " \n ", "Ünïcode’s  «Words» x y<|endoftext|> <|startoftext|>1234 don't", "\x1cA\x85B́", "word. Word, WORD?! x1. it's. (a). é́. <|endoftext|>. a<|endoftext|>, ...", "don't. word. word", "𝔘 ﻿ ΣΑΣ İ"]
    return list(enumerate(texts + odd + texts[:5])) + [(None, "null id"), (3, "same id")]


def test_pieces_hold_the_tokenizers_ids(spark, words):
    rows = documents(words)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, part int")
    got = pack_documents(df, Packing(bytes_per_part=20_000), with_ids=True).collect()
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = sorted((d is None, d or 0, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in rows)
    whole, sequences = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        at = r["sequence_id"] * 4096 + r["offset"] - r["start"]
        whole.setdefault((r["doc_id"], at, r["doc_tokens"]), []).append((r["start"], ids))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    docs = []
    for (doc, _, n), parts in whole.items():
        ids = np.concatenate([ids for _, ids in sorted(parts, key=lambda p: p[0])])
        assert len(ids) == n
        docs.append((doc is None, doc or 0, tuple(ids.tolist())))
    assert sorted(docs) == want
    full = []
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        full.append(end)
    assert sorted(full)[1:] == [4096] * (len(full) - 1)


def test_ids_of_any_text():
    """Random code points, special tokens, letters that change in lower case, composed and decomposed, and Thue-Morse words."""
    rng, encoder = random.Random(9), Encoder(Packing())
    parts = [*"İIéΣ.,! \n\x1caB1½ª漢한#ß;ΩǅJTHWY", "e\u0301", "\u030c", "\u0307", "\u0331", "'s", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]
    ranges = [(32, 127), (0x80, 0x2FF), (0x300, 0x2FFF), (0x3000, 0xD7FF), (0xE000, 0x1FFFF)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    word, swap = "ab", str.maketrans("ab", "ba")
    for _ in range(9):
        word += word.translate(swap)
    texts += [word, word.translate(swap), f"{word} {word.translate(swap)}"]
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for at, piece in pieces(pa.array(texts), 1 << 14):
        ids, first = encoder.encode(piece)
        for k in range(len(piece)):
            assert ids[first[k]:first[k + 1]].tolist() == [*tokenizer.encode(texts[at + k], add_special_tokens=False).ids, 2], texts[at + k]


def test_similar_documents_stand_together(words):
    base = [words(200) for _ in range(40)]
    near = [w[:190] + words(10) for w in base]
    texts = pa.array([" ".join(w) for w in base + near])
    points = np.concatenate([project(*word_hashes(p), Packing()) for _, p in pieces(texts)])
    place = np.argsort(np.argsort(hilbert_key(points, 8)))
    gap = np.abs(place[:40] - place[40:])
    assert np.median(gap) <= 4


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
