"""Quality by site and secrets: held-out accuracy and the arithmetic of the posteriors."""
import math
import random

from pyspark.sql import functions as F

from strandlake.llm.secret_forest import candidates, label_by_form, scan
from strandlake.llm.site_bayes import Bayes, path_priors, score


def documents(words, n=240):
    rng, rows, labels = random.Random(6), [], []
    for k in range(n):
        good = k % 4 != 0
        text = words(rng.randint(30, 200))
        if not good:
            junk = rng.choice(["caps", "repeat", "signs"])
            text = [w.upper() + "!!" for w in text] if junk == "caps" else [text[0]] * len(text) if junk == "repeat" else [w + rng.choice(["###", "***"]) for w in text]
        rows.append((k, " ".join(w.capitalize() if k % 7 == i % 9 else w for i, w in enumerate(text)) if good else " ".join(text), f"site{k % 5}" if k % 11 else None, "en" if k % 2 else None))
        labels.append((k, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark, words):
    rows, labels = documents(words)
    odd = [(9001, None, "site1", "en"), (9002, "", None, None), (9003, "x" * 300_000, "site1", "en"), (None, rows[1][1], "site9", "xx"), (3, rows[3][1], "site3", "en")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows + odd], "doc_id long, text string, source string, lang string, prior string")
    known = spark.createDataFrame(labels[:120] + [(None, 1, 0), (77777, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = score(docs, known).select("doc_id", "evidence", "prior", "quality", "keep").collect()
    assert len(got) == len(rows) + len(odd)
    verdict = {r["doc_id"]: r["keep"] for r in got if r["doc_id"] is not None}
    wrong = [k for k, good, _ in labels[120:] if verdict[k] != bool(good)]
    assert len(wrong) <= 2 and all(verdict[k] for k, good, _ in labels[120:] if good)
    for r in got:
        assert math.isclose(math.log(r["quality"] / (1 - r["quality"])), r["evidence"] + math.log(r["prior"] / (1 - r["prior"])), abs_tol=1e-6)
    assert score(docs.limit(0), known).collect() == []
    nothing = score(docs, known.limit(0)).collect()
    assert len(nothing) == len(got) and all(r["keep"] and r["quality"] is None for r in nothing)


def test_priors_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"h{h}" if h else None, f"p{p}", rng.gauss(2 if h == 1 else -1, 1)) for h in range(4) for p in range(3) for _ in range([400, 30, 3][p])]
    rows.append(("single", None, -3.0))
    prior = 0.7
    got = {(r["source"], r["lang"]): (r["n"], r["share"]) for r in path_priors(spark.createDataFrame(rows, "source string, lang string, evidence double"), prior, "source", "lang").collect()}
    p = [(h, q, 1 / (1 + math.exp(-(e + math.log(prior / (1 - prior)))))) for h, q, e in rows]

    def strength(groups):
        n = sum(g[0] for g in groups)
        spread = sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups)
        between = max((spread - sum(g[2] * (1 - g[2]) for g in groups)) / n, 1e-9)
        return min(max(sum(g[0] * g[2] * (1 - g[2]) for g in groups) / n / between - 1, 1), 10_000)

    share = sum(x for *_, x in p) / len(p)
    hosts = {h: [x for g, _, x in p if g == h] for h in {h for h, *_ in p}}
    k = strength([(len(v), sum(v), share) for v in hosts.values()])
    host_share = {h: (sum(v) + k * share) / (len(v) + k) for h, v in hosts.items()}
    paths = {(h, q): [x for g, r, x in p if (g, r) == (h, q)] for h, q, _ in p}
    k = strength([(len(v), sum(v), host_share[h]) for (h, _), v in paths.items()])
    assert set(got) == set(paths)
    for key, v in paths.items():
        assert got[key][0] == len(v) and math.isclose(got[key][1], (sum(v) + k * host_share[key[0]]) / (len(v) + k), rel_tol=1e-9)


def test_small_sites_shrink_more(spark):
    rows = [("big", "a", 4.0)] * 300 + [("small", "a", 4.0)] * 2 + [("other", "a", -4.0)] * 300
    got = {r["source"]: r["share"] for r in path_priors(spark.createDataFrame(rows, "source string, lang string, evidence double"), 0.5, "source", "lang").collect()}
    assert got["other"] < got["small"] < got["big"] and Bayes().train_rows == 20_000


def secrets(words):
    rng, rows, want = random.Random(9), [], set()
    token = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    for k in range(300):
        text = words(40)
        text += [rng.choice(["and", "the"]) + "".join(words(3)), token("0123456789", 16), "https://ex/" + "/".join(words(5)), token("abcdefghijklmnop", 18)]
        rng.shuffle(text)
        if k % 3 == 0:
            value = rng.choice([lambda: "AKIA" + token("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: token("0123456789abcdef", 40)])()
            form = rng.choice(["password={}", 'token = "{}"', "secret: {}"])
            text.insert(rng.randrange(len(text)), form.format(value))
            want.add((k, value))
        rows.append((k, (" " if k % 2 else "\n").join(text), f"s{k % 3}", "en"))
    return rows, want


def test_secrets_are_found_from_half_the_labels(spark, words):
    rows, want = secrets(words)
    odd = [(900, None, None, None), (901, "", "s", "en"), (902, "a" * 100_000, "s", "en"), (None, "password=0123456789abcdef0123", "s", None), (3, rows[3][1], "s0", "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id long, text string, source string, lang string, value int")
    labelled = label_by_form(candidates(docs)).filter(F.col("doc_id") % 2 == 0)
    got = scan(docs, labelled).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 2 and r["doc_id"] < 300]
    found = {(r["doc_id"], r["value"]) for r in held if r["is_secret"]}
    goal = {x for x in want if x[0] % 2}
    assert len(goal & found) >= 0.95 * len(goal) and len(found - goal) <= 0.05 * len(goal)
    assert sum(r["doc_id"] == 902 for r in got) == 1 and sum(r["doc_id"] is None for r in got) == 1
    assert len([r for r in got if r["doc_id"] == 3]) == 2 * len({(r["word"], r["run"]) for r in got if r["doc_id"] == 3})
    for r in held[:20]:
        assert r["value"] in rows[r["doc_id"]][1].split("\n" if r["doc_id"] % 2 == 0 else " ")[r["word"]]
    assert scan(docs.limit(0)).collect() == []
    one_kind = scan(docs.filter("doc_id = 902")).collect()
    assert [(r["is_secret"], r["score"]) for r in one_kind] == [(True, None)]


def test_named_values_of_other_forms_are_not_trained_as_negatives(spark, words):
    upper, mixed = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "x7Qm2VtLr9ZbKw4HsN8dYc1uPf6E"
    texts = [f'TOKEN = "{upper}"', f"api_key = {mixed}", f"see {mixed} there", "password: take-the-token-from-header", f"commit {upper.lower()} done"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' as source", "'en' as lang")
    assert [r["label"] for r in label_by_form(candidates(docs)).orderBy("doc_id").collect()] == [1.0, None, 0.0, 0.0, 0.0]
    rows, rng, want = secrets(words)[0], random.Random(3), set()
    for k in range(1, 300, 6):
        value = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghkmnpqrstuvwxyz23456789+/") for _ in range(32))
        rows[k] = (k, rows[k][1] + rng.choice([" password={}", ' token = "{}"', " secret: {}"]).format(value), *rows[k][2:])
        want.add((k, value))
    found = {(r["doc_id"], r["value"]) for r in scan(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect() if r["is_secret"]}
    assert len(want & found) >= 0.95 * len(want)
