"""Quality rules from the divergence of a document's histograms from those of its language.

Two histograms are taken of each text: the classes of its characters, and the common words of its language. The reference
of a language is the sum of these histograms over all documents in it. A document is rejected where the Jensen-Shannon
distance of either histogram to the reference is above a limit, and the histogram has enough counts to be trusted. The
limit for common words follows from the reference itself: it is a share of the distance that a text without any of them has.
Everything is built from SQL functions; texts are read once and never shuffled.
"""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.lookup import lookup
from strandlake.sources.store import materialize

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
#: Frequent function words by language.
COMMON_WORDS = {
    "en": "the of and to in a is that for was on are with as by be this from at or".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
N_WORDS = 20
CLASSES = ("upper", "digit", "punctuation", "symbol", "space")  # the rest of the characters is the last class


@dataclass(frozen=True)
class Limits:
    """Guards and limits of the rules."""
    min_words: int = 20  # of a document that is kept
    max_repeat_percent: int = 30  # words in repeated windows
    class_distance: float = 0.35  # Jensen-Shannon distance, 0 to 1
    word_share: float = 0.9  # of the distance between the reference and a text without common words
    min_chars: int = 200  # characters from which the class histogram counts
    min_common: int = 100  # words from which the word histogram counts


def _count_in(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _shifted_hash(codes: str, by: int) -> Column:
    """Hash of each element with the one ``by`` places on; the last ``by`` elements have no partner and go."""
    c = F.col(codes)
    n = F.greatest(F.size(c) - by, F.lit(0))
    return F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))


def text_counts(docs: DataFrame) -> DataFrame:
    """Counts and histograms of every row: ``doc_id, lang`` with the base counts, ``classes`` and ``commons`` (arrays of long).

    A null text has no words, lines or characters. Rows with equal doc_ids stay apart; other columns are ignored.
    """
    t = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", "lang", t.alias("t"), F.filter(F.split(t, SPACE + "+", -1), lambda w: w != "").alias("w"))
    base = base.withColumn("g1", F.transform("w", lambda w: F.xxhash64(w)))
    for by in (1, 2, 4):
        base = base.withColumn(f"g{2 * by}", _shifted_hash(f"g{by}", by))
    base = base.withColumn("dup", F.when(F.size(F.array_distinct("g8")) < F.size("g8"), F.col("g8")))
    base = base.withColumn("s", F.sort_array(F.transform("dup", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    s = F.col("s")
    again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)))
    base = base.withColumn("p", F.sort_array(F.transform(again, lambda x: x["i"])))
    p = F.col("p")
    covered = F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0))
    base = base.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    lists = F.create_map(*[x for k, words in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, words)))])
    known = sorted({w for words in COMMON_WORDS.values() for w in words})
    base = base.withColumn("list", F.try_element_at(lists, F.coalesce("lang", F.lit(""))))
    short = F.filter("w", lambda w: F.length(w) <= max(map(len, known)))
    hits = F.filter(F.transform(short, lambda w: F.lower(w)), lambda w: w.isin(known))
    base = base.withColumn("hits", F.concat(F.lit(" "), F.array_join(hits, "  "), F.lit(" ")))
    hits = F.col("hits")
    common = [F.coalesce(((F.length(hits) - F.length(F.replace(hits, F.concat(F.lit(" "), F.col("list")[k], F.lit(" ")), F.lit(""))))
                          / (F.length(F.col("list")[k]) + 2)).cast("long"), F.lit(0).cast("long")) for k in range(N_WORDS)]
    t = F.col("t")
    n_words, length = F.size("w").cast("long"), F.length(t).cast("long")
    word_chars = F.length(F.array_join("w", "")).cast("long")
    n_symbols = _count_in(t, r"[#*$%&|<>]")
    seen = [_count_in(t, r"\p{Lu}").cast("long"), _count_in(t, "[0-9]").cast("long"), _count_in(t, r"""[.,;:!?'"()\-]""").cast("long"),
            n_symbols.cast("long"), length - word_chars]
    counts = base.select("doc_id", "lang", n_words.alias("n_words"), word_chars.alias("word_chars"), n_symbols.cast("long").alias("n_symbols"),
                         (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                         repeated.cast("long").alias("n_repeat_words"), length.alias("n_chars"), F.array(*seen).alias("seen"), F.array(*common).alias("common"))
    rest = lambda total, parts, n: F.greatest(F.col(total) - sum((F.col(parts)[k] for k in range(n)), F.lit(0)), F.lit(0))
    return counts.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars",
                         F.concat("seen", F.array(rest("n_chars", "seen", len(CLASSES)))).alias("classes"),
                         F.concat("common", F.array(rest("n_words", "common", N_WORDS))).alias("commons"))


def references(counts: DataFrame) -> DataFrame:
    """Summed histograms of each language: ``lang, ref_classes, ref_commons`` and ``none_distance``, that of a text without common words.

    Every language has a reference for its characters; the last two are null where no common words are known.
    """
    total = lambda c, n: F.array(*[F.sum(F.col(c)[k]) for k in range(n)])
    listed = F.when(F.col("lang").isin(list(COMMON_WORDS)), total("commons", N_WORDS + 1))
    sums = counts.filter("lang is not null").groupBy("lang").agg(total("classes", len(CLASSES) + 1).alias("ref_classes"), listed.alias("ref_commons"))
    none = F.array(*[F.lit(int(k == N_WORDS)).cast("long") for k in range(N_WORDS + 1)])
    return sums.withColumn("none", none).withColumn("none_distance", js_distance("none", "ref_commons")).drop("none")


def js_distance(a: str, b: str) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms given as arrays of counts; null where one is null or empty."""
    add = lambda c, zero: F.aggregate(c, F.lit(zero).cast("bigint" if isinstance(zero, int) else "double"), lambda total, x: total + x)
    share = lambda c: F.transform(F.col(c), lambda x: x / F.nullif(add(F.col(c), 0).cast("double"), F.lit(0.0)))
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).when(x.isNotNull(), F.lit(0.0))
    both = add(F.zip_with(share(a), share(b), lambda x, y: part(x, y) + part(y, x)), 0.0)
    return F.sqrt(F.when(both < 0, F.lit(0.0)).otherwise(both) / 2)


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``doc_id``, the base counts, both distances, ``base_failed`` and ``kept`` for every row of ``docs (doc_id, text, lang, …)``.

    A distance is null where its guard isn't met, the language is null or a histogram is empty, and that of common words in a
    language without a list of them; the other rules judge such a document. A null or empty text has no words and fails the
    base rules. A text of any length is judged whole. Repeated rows get the same verdict each, an empty table an empty result.
    """
    counts = materialize(text_counts(docs), "divergence")
    pairs = lookup(counts, references(counts), "lang", "doc_id", how="left", measure=True)
    judged = pairs.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))).alias("base_failed"),
        F.when(F.col("n_chars") >= limits.min_chars, js_distance("classes", "ref_classes")).alias("class_distance"),
        F.when(F.col("n_words") >= limits.min_common, js_distance("commons", "ref_commons")).alias("word_distance"), "none_distance")
    near = (F.coalesce(F.col("class_distance") <= limits.class_distance, F.lit(True))
            & F.coalesce(F.col("word_distance") <= limits.word_share * F.col("none_distance"), F.lit(True)))
    return judged.withColumn("kept", ~F.col("base_failed") & near).drop("none_distance")
