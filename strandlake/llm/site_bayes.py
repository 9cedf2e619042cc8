"""Quality of documents by hierarchical empirical Bayes.

A classifier, fitted on a bounded sample of labelled documents, gives each document evidence: its log odds less those of the
training sample. Sites get posteriors from the evidence of all their documents: a host's share of good documents is shrunk
toward the share of the corpus, a path's share toward its host's. How far is estimated from the data (the spread of shares
between sites against the spread that counting alone explains), so sparse sites follow their parent and large ones
themselves. The posterior of a path is the prior of its documents, to which their own evidence is added.
"""
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.lookup import lookup
from strandlake.sources.store import materialize

FEATURES = ["words", "word_length", "distinct", "upper", "digit", "symbol", "shout", "punctuation", "lines"]


@dataclass(frozen=True)
class Bayes:
    """Parameters of the fit and of the decision."""
    train_rows: int = 20_000  # labelled documents that the classifier is fitted on, those with the smallest hashes of their ids
    trees: int = 30
    depth: int = 6
    least: float = 0.3  # posterior probability of good quality from which a document is kept; a wrong rejection loses a clean document
    clip: float = 6.0  # most log odds that a classifier may give


def with_features(docs: DataFrame) -> DataFrame:
    """Add the classifier's inputs, one vector ``features`` computed from ``text`` alone (null: as empty)."""
    t = F.coalesce("text", F.lit(""))
    base = docs.withColumn("__t", t).withColumn("__w", F.filter(F.split("__t", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    n, chars = F.greatest(F.size("__w"), F.lit(1)), F.greatest(F.length("__t"), F.lit(1))
    share = lambda pattern: (F.length("__t") - F.length(F.regexp_replace("__t", pattern, ""))) / chars
    values = {"words": F.log1p(F.size("__w").cast("double")), "word_length": F.length(F.array_join("__w", "")) / n,
              "distinct": F.size(F.array_distinct("__w")) / n, "upper": share(r"\p{Lu}"), "digit": share("[0-9]"), "symbol": share(r"[#*$%&|<>]"),
              "shout": share("!"), "punctuation": share("[.,;:]"), "lines": F.size(F.split("__t", "\n", -1)) / n}
    columns = base.select(*docs.columns, *[values[f].cast("double").alias(f"__{f}") for f in FEATURES])
    return VectorAssembler(inputCols=[f"__{f}" for f in FEATURES], outputCol="features").transform(columns).drop(*[f"__{f}" for f in FEATURES])


@dataclass(frozen=True)
class Classifier:
    """The forest, and the share of good documents that it was fitted on."""
    forest: RandomForestClassificationModel
    prior: float


def fit(docs: DataFrame, labels: DataFrame, bayes: Bayes = Bayes()) -> Classifier | None:
    """Fit on ``labels (doc_id, quality)``; None where the sample lacks good or bad documents. Labels without a document don't count."""
    wanted = labels.filter("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("double").alias("label"))
    sample = wanted.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bayes.train_rows)  # so bounded, it can be broadcast
    rows = materialize(with_features(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")).select("label", "features"), "labelled")
    prior = rows.agg(F.avg("label").alias("p")).first()["p"]
    if prior is None or not 0 < prior < 1:
        return None
    forest = RandomForestClassifier(numTrees=bayes.trees, maxDepth=bayes.depth, seed=1, featureSubsetStrategy="all", maxBins=64).fit(rows)
    return Classifier(forest, prior)


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def with_evidence(docs: DataFrame, classifier: Classifier, bayes: Bayes = Bayes()) -> DataFrame:
    """Add ``evidence``: log odds of the classifier less those of its training sample."""
    scored = classifier.forest.transform(with_features(docs))
    p = vector_to_array("probability")[1]
    edge = 1 / (1 + 2.718281828459045 ** bayes.clip)
    odds = _logit(F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))) - _logit(F.lit(classifier.prior))
    return scored.withColumn("evidence", odds).drop("features", "rawPrediction", "probability", "prediction")


def _strength(groups: DataFrame, center: str) -> float:
    """Documents that the parent's share counts for, by moments of ``groups (n, good, center)``."""
    c = F.least(F.greatest(F.col(center), F.lit(1e-6)), F.lit(1 - 1e-6))
    row = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - c, 2)).alias("spread"),
                     F.sum(c * (1 - c)).alias("counting"), F.sum(F.col("n") * c * (1 - c)).alias("scale")).first()
    if not row["n"]:
        return 1.0
    between = max((row["spread"] - row["counting"]) / row["n"], 1e-9)
    return min(max(row["scale"] / row["n"] / between - 1, 1.0), 10_000.0)


def path_priors(evidence: DataFrame, prior: float, host: str, path: str) -> DataFrame:
    """``(host, path, n, host_share, share)`` of every path in ``evidence``, by their names; null names are names of their own."""
    p = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.lit(prior)))))
    paths = materialize(evidence.groupBy(host, path).agg(F.count("*").alias("n"), F.sum(p).alias("good")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    share = total["good"] / total["n"] if total["n"] else prior
    hosts = paths.groupBy(host).agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("parent", F.lit(float(share)))
    k = _strength(hosts, "parent")
    hosts = hosts.select(F.col(host).alias("__host"), ((F.col("good") + k * share) / (F.col("n") + k)).alias("host_share"))
    joined = materialize(paths.join(hosts, F.col(host).eqNullSafe(F.col("__host"))).drop("__host"), "path-hosts")
    k = _strength(joined, "host_share")
    return joined.select(host, path, "n", "host_share", ((F.col("good") + k * F.col("host_share")) / (F.col("n") + k)).alias("share"))


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", bayes: Bayes = Bayes()) -> DataFrame:
    """``docs`` with ``evidence``, ``prior`` (of the path), ``quality`` (posterior probability) and ``keep`` for every row.

    Null and empty texts are scored like others, null hosts and paths count as sites of their own, repeated rows count each. If
    the labels lack good or bad documents, nothing is known: the three numbers are null and all rows are kept. Columns of
    these names in ``docs`` are replaced; texts aren't shuffled.
    """
    own = [c for c in docs.columns if c not in ("evidence", "prior", "quality", "keep")]
    docs = docs.select(own)
    classifier = fit(docs, labels, bayes)
    if classifier is None:
        none = F.lit(None).cast("double")
        return docs.select(*own, none.alias("evidence"), none.alias("prior"), none.alias("quality"), F.lit(True).alias("keep"))
    sites = path_priors(with_evidence(docs.select("text", host, path), classifier, bayes), classifier.prior, host, path)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    sites = materialize(sites.select(name(host).alias("__host"), name(path).alias("__path"), F.col("share").alias("prior")), "priors")
    rows = with_evidence(docs, classifier, bayes).withColumns({"__host": name(host), "__path": name(path)})
    joined = lookup(rows, sites, ["__host", "__path"], "doc_id", how="left", measure=True)
    quality = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("prior")))))
    return joined.withColumn("quality", quality).select(*own, "evidence", "prior", "quality", (F.col("quality") >= bayes.least).alias("keep"))
