"""Line spread and divergence against brute force."""
import math
import re

from strandlake.llm.divergence import CLASSES, COMMON_WORDS, N_WORDS, Limits, judge
from strandlake.llm.line_spread import Spread, remove_spread_lines


def cut_lines(rows, spread):
    sites, keep = {}, {}
    for d, site, text in rows:
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            if re.search(r"[^\x20\x09-\x0D]", line):
                sites.setdefault(line, set()).add(site or "")
                place = (d is not None, d or 0, pos)
                keep[line] = min(keep.get(line, place), place)
    out = []
    for d, _, text in rows:
        if text is None:
            out.append((d, None, 0, 0))
            continue
        lines = text.split("\n")
        left = [x for pos, x in enumerate(lines) if len(sites.get(x, ())) < spread.min_sites or keep[x] == (d is not None, d or 0, pos)]
        out.append((d, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def test_line_spread_equals_brute_force(spark, words):
    spread = Spread(min_sites=5, log_k=8)
    common = [" ".join(words(6)) for _ in range(12)]
    rows = []
    for k in range(400):
        lines = [" ".join(words(5)) for _ in range(k % 4)]
        # line j stands on about j sites, so that some are near the limit
        lines += [c for j, c in enumerate(common) if k % 37 < j and k % 3 == 0]
        rows.append((k, f"s{k % 37}", "\n".join(lines)))
    rows += [(900, None, common[5] + "\n\n" + common[5]), (901, "s1", None), (902, "s1", ""), (None, "s2", common[11]), (903, "s3", common[11] + "\r"), (7, "s7", rows[7][2])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, h1 int, pos int")
    got = remove_spread_lines(df, spread=spread)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()), key=str) == cut_lines(rows, spread)


def test_line_spread_of_an_empty_table(spark):
    assert remove_spread_lines(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return words, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def histograms(text, lang):
    words = base_counts(text)[0]
    space = len(text) - sum(map(len, words))
    seen = [sum(c.isupper() for c in text), sum(c in "0123456789" for c in text), sum(c in ".,;:!?'\"()-" for c in text), base_counts(text)[2], space]
    known = COMMON_WORDS.get(lang)
    common = [sum(w.lower() == k for w in words) for k in known] if known else [0] * N_WORDS
    return seen + [max(0, len(text) - sum(seen))], common + [len(words) - sum(common)]


def distance(a, b):
    if not sum(a) or not sum(b):
        return None
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    return math.sqrt(max(0, sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q)) / 2))


def test_divergence_equals_brute_force(spark, words):
    passage = " ".join(words(12))
    rows = [(k, "en" if k % 2 else "de", " ".join(words(60 + k)) + ". The of and der die, " * 3) for k in range(30)]
    rows += [(100, "en", "X" * 400), (101, "en", "a b c d e f g h " * 9), (102, "en", passage + " x " + passage + "\n" + passage), (103, None, "the of " * 40), (104, "xx", "THE OF " * 30),
             (105, "en", None), (106, "de", ""), (107, "fr", " \n\t\n "), (108, "es", "de la\nde la\n\nde la"), (109, "en", "#*$ %&| <> " * 30), (None, "en", "one two"), (101, "en", "a b c d e f g h " * 9),
             (113, "de", " ".join(words(300))), (114, "xx", "q1 " * 2 + " ".join("#%05d" % (k * 7919 % 99_991) for k in range(300))), (115, None, " ".join(words(300))),
             (110, "fr", "\x0b\x1c a\xa0b 𝔘ü Ünï 12 3"), (111, "en", "w" * 200_000), (112, "de", ("a " * 20_000))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, lang string, text string, n_words string")
    refs = {}
    for _, lang, text in rows:
        if lang is not None:
            for k, h in enumerate(histograms(text or "", lang)[:2 if lang in COMMON_WORDS else 1]):
                ref = refs.setdefault((lang, k), [0] * len(h))
                refs[lang, k] = [x + y for x, y in zip(ref, h)]
    lim, want = Limits(), []
    for d, lang, text in rows:
        text = text or ""
        words_, chars, symbols, dups, repeats = base_counts(text)
        failed = len(words_) < 20 or 100 * repeats > 30 * len(words_)
        far = [distance(h, refs[lang, k]) if (lang, k) in refs and guard else None
               for k, (h, guard) in enumerate(zip(histograms(text, lang), (len(text) >= lim.min_chars, len(words_) >= lim.min_common)))]
        kept = not failed and (far[0] is None or far[0] <= lim.class_distance) and (far[1] is None or far[1] <= lim.word_share * distance([0] * N_WORDS + [1], refs[lang, 1]))
        want.append((d, len(words_), chars, symbols, dups, repeats, failed, kept, *[None if x is None else round(x, 9) for x in far]))
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"],
            *[None if x is None else round(x, 9) for x in (r["class_distance"], r["word_distance"])]) for r in judge(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(CLASSES) == 5 and not any(r[7] for r in want if r[0] in (100, 101, 105, 109, 113))
    assert all(r[7] for r in want if r[0] == 115) and [r[8] for r in want if r[0] == 114] != [None]


def test_divergence_of_an_empty_table(spark):
    assert judge(spark.createDataFrame([], "doc_id long, lang string, text string")).collect() == []
