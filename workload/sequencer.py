"""Reads and alignments of fragments, a batch of fragments at a time: the rows of the SQL in ``tables``, without its work per letter.

Letters are looked up as arrays, and the stretches of the genome that fragments of a batch share are derived once.
"""
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa

READ_SCHEMA = "sample string, frag string, mate int, bases string, quals string"
ALIGNMENT_SCHEMA = ("sample string, rg_id string, library string, frag string, flags int, contig string, pos long, `end` long, mapq int, "
                    "cigar string, bases string, quals string")
PLACE_SCHEMA = ALIGNMENT_SCHEMA.removesuffix(", bases string, quals string")
CIGARS = ["50M", "20M1D30M", "25M1I24M", "5S45M", "*"]
SPAN = np.array([49, 50, 48, 44, 0])
CHUNK, CONTIGS, SIZE = 32, 25, 50

_letters = lambda text: np.frombuffer(text.encode(), np.uint8)
BASES, QUALITIES, HEX = _letters("ACGT" * 4), _letters("#+05:>?@ABCDEFGH"), _letters("0123456789abcdef").astype(np.int64)


def _mapping(source: str, target: str) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[_letters(source)] = _letters(target)
    return table


CARRIED, ERROR, COMPLEMENT = _mapping("ACGT", "CGTA"), _mapping("ACGT", "GTAC"), _mapping("ACGTN", "TGCAN")


def _digits(texts: list[bytes]) -> np.ndarray:
    """The 32 hexadecimal digits of each text's MD5, as numbers."""
    raw = np.frombuffer(b"".join([md5(t).digest() for t in texts]), np.uint8).reshape(-1, 16)
    return np.stack([raw >> 4, raw & 15], axis=2).reshape(-1, 32)


def _strings(letters: np.ndarray) -> pa.Array:
    rows, size = letters.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])


def _genome(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of the genome as carried by both haplotypes: ``(haplotype, key, letter)``, and the place of each key."""
    different, place = np.unique(keys, return_inverse=True)
    names = [b"%d" % k for k in different.tolist()]
    plain, v = BASES[_digits(names)], _digits([b"v" + n for n in names])
    at = (HEX[v[:, 1]] * 3 + HEX[v[:, 2]]) % CHUNK
    both = np.stack([plain, plain])
    for hap, site in enumerate(((v[:, 0] == 7) & (v[:, 3] < 8), v[:, 0] == 7)):
        rows = np.flatnonzero(site)
        both[hap, rows, at[rows]] = CARRIED[plain[rows, at[rows]]]
    return both, place.reshape(keys.shape)


def _placed(frags: list[bytes], k: np.ndarray, o1: np.ndarray, gapped: bool) -> dict[str, np.ndarray]:
    """Columns of the reads of fragments but their letters; ``of`` tells which fragment a read is of."""
    h = _digits(frags)
    second = np.flatnonzero(h[:, 0] != 0)
    of = np.concatenate([np.arange(len(frags)), second])
    mate = np.repeat([1, 2], [len(frags), len(second)])
    hm = np.concatenate([h, _digits([frags[i] + b"/2" for i in second.tolist()])])
    g = o1[of] + np.where(mate == 2, 150 + HEX[h[of, 1]] % 4, 0)
    half = h[of, 0] == 1
    unmapped = half & (mate == 2)
    kind = np.zeros(len(of), np.int64)
    if gapped:
        kind[hm[:, 5] == 5] = 3
        kind[(hm[:, 5] == 10) & (hm[:, 6] == 11)] = 1
        kind[(hm[:, 5] == 12) & (hm[:, 6] == 13)] = 2
    return {"of": of, "mate": mate, "single": h[of, 0] == 0, "half": half, "unmapped": unmapped, "h": h, "hm": hm, "g": g, "gaps": kind,
            "kind": np.where(unmapped, 4, kind), "contig": k[of] % CONTIGS, "pos": k[of] // CONTIGS * CHUNK + g + 1}


def _sequenced(frags: list[bytes], k: np.ndarray, o1: np.ndarray, gapped: bool) -> dict[str, np.ndarray]:
    """Columns of the reads of fragments, with bases and qualities."""
    r = _placed(frags, k, o1, gapped)
    of, h, hm, g, kind, unmapped = (r[c] for c in ("of", "h", "hm", "g", "gaps", "unmapped"))
    chunks, place = _genome((k[of] + CONTIGS * (g // CHUNK))[:, None] + CONTIGS * np.arange(3))
    stretch = chunks[np.where(h[of, 7] < 8, 0, 1)[:, None], place].reshape(len(of), 3 * CHUNK)
    w = np.take_along_axis(stretch, (g % CHUNK)[:, None] + np.arange(SIZE + 1), axis=1)
    bases = w[:, :SIZE].copy()
    deleted, inserted, clipped = (kind == i for i in (1, 2, 3))
    bases[deleted, 20:] = w[deleted, 21:]
    bases[inserted, 25], bases[inserted, 26:] = ord("A"), w[inserted, 25:49]
    bases[clipped, :5], bases[clipped, 5:] = w[clipped, :45:-1], w[clipped, :45]
    unread = (hm[:, 8] == 0) & (hm[:, 9] == 0)
    bases[unread, 9] = ord("N")
    wrong = np.flatnonzero((hm[:, 2] == 7) & ~unread)
    e = (HEX[hm[wrong, 3]] * 3 + HEX[hm[wrong, 4]]) % SIZE
    bases[wrong, e] = ERROR[bases[wrong, e]]
    lost = np.flatnonzero(unmapped)
    other = _digits([frags[i] + b"/x" for i in of[lost].tolist()])
    bases[lost] = BASES[np.concatenate([h[of[lost]], other], axis=1)[:, :SIZE]]
    quals = QUALITIES[np.concatenate([hm, hm[:, :SIZE - 32]], axis=1)]
    return r | {"bases": bases, "quals": quals}


def _batches(batches: Iterator[pa.RecordBatch], gapped: bool, columns=_sequenced):
    for batch in batches:
        if batch.num_rows:
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            yield batch, columns(batch.column("frag").cast(pa.binary()).to_pylist(), number("k"), number("o1"), gapped)


def reads(batches: Iterator[pa.RecordBatch], gapped: bool) -> Iterator[pa.RecordBatch]:
    for batch, r in _batches(batches, gapped):
        turned = np.flatnonzero((r["mate"] == 2) & ~r["unmapped"])
        r["bases"][turned], r["quals"][turned] = COMPLEMENT[r["bases"][turned, ::-1]], r["quals"][turned, ::-1]
        of = pa.array(r["of"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("sample").take(of), batch.column("frag").take(of), pa.array(np.where(r["single"], 0, r["mate"]).astype(np.int32)),
             _strings(r["bases"]), _strings(r["quals"])], ["sample", "frag", "mate", "bases", "quals"])


def placements(batches: Iterator[pa.RecordBatch], gapped: bool, columns=_placed) -> Iterator[pa.RecordBatch]:
    """Alignments without their letters."""
    contigs, cigars = pa.array([f"chr{i}" for i in range(CONTIGS)]), pa.array(CIGARS)
    for batch, r in _batches(batches, gapped, columns):
        of, lost = pa.array(r["of"]), r["unmapped"]
        flags = np.select([r["single"], lost, r["half"], r["mate"] == 1], [0, 133, 73, 99], 147)
        mapq = np.select([lost, r["hm"][:, 6] == 3, r["hm"][:, 6] == 4], [0, 20, 255], 60)
        letters = [c for c in ("bases", "quals") if c in r]
        yield pa.RecordBatch.from_arrays(
            [batch.column("sample").take(of), batch.column("rg_id").take(of), batch.column("library").take(of), batch.column("frag").take(of),
             pa.array(flags.astype(np.int32)), contigs.take(pa.array(r["contig"], mask=lost)), pa.array(r["pos"], mask=lost),
             pa.array(r["pos"] + SPAN[r["kind"]], mask=lost), pa.array(mapq.astype(np.int32)), cigars.take(pa.array(r["kind"])),
             *[_strings(r[c]) for c in letters]],
            ["sample", "rg_id", "library", "frag", "flags", "contig", "pos", "end", "mapq", "cigar", *letters])


def alignments(batches: Iterator[pa.RecordBatch], gapped: bool) -> Iterator[pa.RecordBatch]:
    return placements(batches, gapped, _sequenced)
