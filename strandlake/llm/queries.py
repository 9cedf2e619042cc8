"""One query for each operator, over its whole table with production parameters."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import oracles
from strandlake.llm.curve_packing import pack_documents
from strandlake.llm.divergence import judge
from strandlake.llm.edit_leaks import find_leaks
from strandlake.llm.filter_audit import audit
from strandlake.llm.hash_tree import even_tree, grown, shard_documents
from strandlake.llm.jaccard_regions import link_documents
from strandlake.llm.line_spread import remove_spread_lines
from strandlake.llm.period_runs import find_runs, longest, with_echoes
from strandlake.llm.preference_pairs import completion, echo_pairs, format_pairs, mask
from strandlake.llm.secret_forest import scan
from strandlake.llm.site_bayes import score
from strandlake.llm.tree_bpe import decode_ids, encode_texts
from strandlake.llm.warc import page_records, page_rows, read_warc, write_warc
from strandlake.sources.store import scratch_path

QUERIES = {}
ORACLES = {}


def query(oracle: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(oracles.OP1)
def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with an echo as its last answer: prompt, completions and their masks."""
    pairs = format_pairs(echo_pairs(table(spark, sf_dir, "conversations")))
    return pairs.select("pair_id", "prompt_turns", "prompt", completion("chosen").alias("chosen"), mask("chosen").alias("chosen_mask"),
                        completion("rejected").alias("rejected"), mask("rejected").alias("rejected_mask"))


@query(oracles.OP2)
def op2_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards as 3 regions of 2 racks of 4 shards, and with a 25th."""
    tree = even_tree(3, 2, 4)
    return shard_documents(table(spark, sf_dir, "documents"), tree, grown(tree))


@query(oracles.OP3)
def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on ten sites or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return remove_spread_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


@query()
def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's verdict; trained on findings labelled by their form."""
    return scan(table(spark, sf_dir, "documents"))


@query()
def op5_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives, with revisits of equal payloads, and read back."""
    path = scratch_path(spark, "warc")
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    return page_rows(read_warc(spark, path).filter(F.col("record_type").isin("response", "revisit") & F.col("record_id").startswith("<urn:page:")))


@query()
def op6_edit_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of benchmark items in documents, with up to a fifth of the words edited."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op7_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 4096 ids along the Hilbert curve of document vectors."""
    return pack_documents(table(spark, sf_dir, "documents"))


@query()
def op8_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return score(docs, table(spark, sf_dir, "labels")).select("doc_id", "evidence", "prior", "quality", "keep")


@query(oracles.OP9)
def op9_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the divergence from the language's histograms."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op10_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with a shingle similarity of 0.8 or more."""
    return link_documents(table(spark, sf_dir, "documents"))


@query(oracles.OP11)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at each step of all 120 orders, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op12_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text to ids of a byte-level BPE and back."""
    ids = encode_texts(table(spark, sf_dir, "documents"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2(decode_ids(F.col("ids")), 256).alias("decoded_sha256"))


@query()
def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four periods or more in every text, a tenth of which repeats itself from some word on."""
    found = find_runs(with_echoes(table(spark, sf_dir, "documents"))).withColumn("top", longest("runs"))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
                        F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
