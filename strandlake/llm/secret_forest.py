"""Secret scan: candidates by form, false positives removed by a random forest.

Any long run of letters, digits and the signs of base64 is a candidate; most of these are words. The forest looks at the
candidate's length, at its changes between kinds of characters, at how much of it dictionary words cover, at the path of
its document and at the words beside it. It is trained from labelled findings. Everything is built from SQL functions and
Spark's own forest.
"""
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.divergence import COMMON_WORDS
from strandlake.sources.store import materialize

RUN = r"[A-Za-z0-9+/_\-]{16,}"
#: Words that name a secret beside it.
KEY_WORDS = "password passwd pwd passphrase secret token key apikey api_key access_key auth bearer credential private".split()
#: Forms that issuers publish for their keys.
ISSUED = [r"AKIA[0-9A-Z]{16}", r"ghp_[A-Za-z0-9]{36}", r"xox[abprs]-[A-Za-z0-9\-]{10,}", r"sk_live_[A-Za-z0-9]{16,}", r"AIza[A-Za-z0-9_\-]{35}"]
FEATURES = ["length", "digits", "uppers", "signs", "changes", "distinct", "longest_letters", "dictionary", "key_before", "key_in_word", "assigned", "quoted", "key_after", "site", "lang_code"]


@dataclass(frozen=True)
class Forest:
    """Parameters of the forest and of the verdict."""
    train_rows: int = 20_000  # labelled findings that are used, those with the smallest hashes
    trees: int = 24
    depth: int = 6
    least: float = 0.5  # probability from which a finding stays


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: ``doc_id, source, lang, word`` (place among the words), ``value``, ``before``, ``after`` and ``around``.

    ``around`` is the rest of the candidate's own word, with a blank in its place; ``before`` holds the two words before it. Of
    a word with several runs each is a candidate. A null or empty text has none.
    """
    words = docs.select("doc_id", "source", "lang", F.split("text", r"[\x20\x09-\x0D]+", -1).alias("w"))
    w = F.col("w")
    long_words = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), F.when(F.octet_length(x) >= 16, x).alias("x"))), lambda s: s["x"].isNotNull())
    rows = words.select("doc_id", "source", "lang", "w", F.explode(F.filter(long_words, lambda s: s["x"].rlike(RUN))).alias("s"))
    i = F.col("s.i")
    neighbour = lambda k: F.coalesce(F.get(w, i + k), F.lit(""))
    found = rows.select("doc_id", "source", "lang", i.cast("long").alias("word"), F.concat_ws(" ", neighbour(-2), neighbour(-1)).alias("before"), neighbour(1).alias("after"),
                        F.regexp_replace("s.x", RUN, " ").alias("around"), F.posexplode(F.regexp_extract_all("s.x", F.lit(f"({RUN})"), F.lit(1))).alias("run", "value"))
    return found.select("doc_id", "source", "lang", "word", F.col("run").cast("long").alias("run"), "value", "before", "after", "around")


def _cut(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_features(findings: DataFrame) -> DataFrame:
    """Add the forest's inputs as a vector ``features``."""
    v = F.col("value")
    n = F.length(v)
    kinds = r"(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    dictionary = "|".join(sorted({x for words in COMMON_WORDS.values() for x in words if len(x) > 1 and x.isascii()} | set(KEY_WORDS), key=lambda x: (-len(x), x)))
    keys = "(?i)(" + "|".join(KEY_WORDS) + ")"
    flag = lambda c: c.cast("double")
    code = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(64)).cast("double")
    letters = F.array_max(F.transform(F.split(v, "[^A-Za-z]+", -1), lambda x: F.length(x)))
    values = {"length": n, "digits": _cut(v, "[0-9]") / n, "uppers": _cut(v, "[A-Z]") / n, "signs": _cut(v, r"[+/_\-]") / n,
              "changes": (F.size(F.split(v, kinds, -1)) - 1) / n, "distinct": F.size(F.array_distinct(F.split(v, "", -1))) / n, "longest_letters": letters / n,
              "dictionary": _cut(F.lower(v), dictionary) / n, "key_before": flag(F.col("before").rlike(keys)), "key_in_word": flag(F.col("around").rlike(keys)),
              "assigned": flag(F.concat("before", "around").rlike("[=:]")), "quoted": flag(F.col("around").rlike("[\"'`]")), "key_after": flag(F.col("after").rlike(keys)),
              "site": code("source"), "lang_code": code("lang")}
    columns = findings.select("*", *[values[f].cast("double").alias(f"__{f}") for f in FEATURES])
    return VectorAssembler(inputCols=[f"__{f}" for f in FEATURES], outputCol="features").transform(columns).drop(*[f"__{f}" for f in FEATURES])


def label_by_form(findings: DataFrame) -> DataFrame:
    """Labels for findings where no people have given any: issued forms, and hex of either case beside the name of a secret,
    count as secrets.

    A finding is no secret where no name stands before it or in its word (but for one that another value follows), or where a
    common word of three letters or more is a part of it. A named value of any other form (base64, a password) may be a secret
    or not: its label is null.
    """
    v, beside = F.col("value"), F.concat_ws(" ", "before", "around")
    keys = "(?i)(" + "|".join(KEY_WORDS) + ")"
    issued = v.rlike("^(" + "|".join(ISSUED) + ")$")
    named = beside.rlike(keys + r"\W*$|" + keys + r"\W+\s")
    hexed = v.rlike("^[0-9A-Fa-f]{16,}$") & v.rlike("[0-9]")
    parts = F.split(v, r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", -1)
    known = sorted({x for words in COMMON_WORDS.values() for x in words if len(x) > 2 and x.isascii()} | set(KEY_WORDS))
    own = F.concat_ws(" ", F.regexp_replace("before", keys + r"\W+" + RUN, " "), "around")
    worded = F.exists(parts, lambda x: F.lower(x).isin(known))
    label = F.when(issued | (named & hexed), 1.0).when(worded | ~own.rlike(keys), 0.0)
    return findings.withColumn("label", label)


def train(labelled: DataFrame, forest: Forest = Forest()) -> RandomForestClassificationModel | None:
    """Fit on ``labelled`` findings with a ``label``; None if the sample lacks one of the labels."""
    sample = labelled.filter("label is not null").orderBy(F.xxhash64("value", "doc_id", "word"), "value", "doc_id", "word").limit(forest.train_rows)
    rows = materialize(with_features(sample).select("label", "features"), "labelled-findings")
    kinds = rows.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if kinds["lo"] is None or kinds["lo"] == kinds["hi"]:
        return None
    return RandomForestClassifier(numTrees=forest.trees, maxDepth=forest.depth, seed=1, maxBins=64).fit(rows)


def scan(docs: DataFrame, labelled: DataFrame | None = None, forest: Forest = Forest()) -> DataFrame:
    """Findings of ``docs (doc_id, text, source, lang, …)``: ``doc_id, word, run, value, score, is_secret``, false positives included.

    ``labelled``: findings with a ``label``; without it, the findings are labelled by their form. If one of the labels is
    missing, score is null and every finding counts as a secret. Repeated rows give repeated findings; null doc_ids, sources and
    languages are allowed; other columns are ignored.
    """
    found = materialize(candidates(docs), "findings")
    model = train(label_by_form(found) if labelled is None else labelled, forest)
    if model is None:
        return found.select("doc_id", "word", "run", "value", F.lit(None).cast("double").alias("score"), F.lit(True).alias("is_secret"))
    scored = model.transform(with_features(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "word", "run", "value", "score", (F.col("score") >= forest.least).alias("is_secret"))
