"""Preference pairs: the turns that both conversations share become the prompt, what follows two masked completions.

Everything is built from SQL functions; a conversation is put together in one aggregation. ``token_ids`` adds token ids.
"""
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100  # label of ids that don't count toward the loss


def _open(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"))


def _body(text: Column) -> Column:
    return F.concat(F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def _parts(turns: Column) -> Column:
    """``(text, train)`` of turns: headers never count, the text of the assistant's turns and its end do."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(_open(t["role"]).alias("text"), F.lit(False).alias("train")),
        F.struct(_body(t["text"]).alias("text"), t["role"].eqNullSafe(F.lit("assistant")).alias("train")))))


def format_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair of ``turns (pair_id, side, turn, role, text)`` with ``side`` chosen or rejected.

    Returns ``pair_id, prompt_turns, prompt`` (the longest common prefix of turns with equal role and text, rendered once), and
    ``chosen`` and ``rejected``: arrays of ``(text, train)``, whose texts in a row are the completion and of which only those
    with ``train`` count toward the loss. A side without turns is an empty conversation; a null role or text equals a null one
    and renders as nothing; turns with equal numbers stand in the order of role and text, and repeated rows are turns of their
    own. Rows with another side are ignored; a null pair_id is a pair of its own; other columns are ignored.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    side = lambda name: F.sort_array(F.collect_list(F.when(F.col("side") == name, turn)))
    pairs = turns.filter(F.col("side").isin("chosen", "rejected")).groupBy("pair_id").agg(side("chosen").alias("c"), side("rejected").alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]) & a.isNotNull() & b.isNotNull(), F.lit(False)))
    differ = F.array_position(same, F.lit(False))
    n = F.when(differ > 0, differ - 1).otherwise(F.size("c")).cast("int")
    pairs = pairs.withColumn("n", n)
    rest = lambda c: _parts(F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0))))
    prompt = F.array_join(F.transform(_parts(F.slice("c", F.lit(1), F.col("n"))), lambda p: p["text"]), "")
    return pairs.select("pair_id", F.col("n").cast("long").alias("prompt_turns"), prompt.alias("prompt"), rest("c").alias("chosen"), rest("r").alias("rejected"))


def echo_pairs(conversations: DataFrame) -> DataFrame:
    """Turns of pairs made from single conversations ``(conv_id, turn, role, text)``, for corpora without rated answers.

    Chosen is the conversation up to its last assistant turn; in the rejected one this turn repeats the turn before it instead
    (nothing, if there is none). A conversation without an assistant turn is both sides as it is.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn")))
    ends = rows.groupBy(F.col("conv_id").alias("pair_id")).agg(last.alias("last"), F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    # what stands before the last assistant turn: the largest (turn, role, text) with a smaller number
    kept = F.filter("turns", lambda t: F.col("last").isNull() | (t["turn"] <= F.col("last")))
    before = F.array_max(F.filter("turns", lambda t: t["turn"] < F.col("last")))["text"]
    echo = F.transform(kept, lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"),
                                                F.when(t["turn"].eqNullSafe(F.col("last")) & F.col("last").isNotNull(), F.coalesce(before, F.lit(""))).otherwise(t["text"]).alias("text")))
    sides = ends.select("pair_id", F.explode(F.array(F.struct(F.lit("chosen").alias("side"), kept.alias("turns")), F.struct(F.lit("rejected").alias("side"), echo.alias("turns")))).alias("s"))
    return sides.select("pair_id", F.col("s.side").alias("side"), F.explode("s.turns").alias("t")).select("pair_id", "side", "t.turn", "t.role", "t.text")


def completion(parts: str) -> Column:
    """The text of a completion."""
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def mask(parts: str) -> Column:
    """A digit for each character of the completion: 1 where it counts toward the loss."""
    return F.array_join(F.transform(parts, lambda p: F.repeat(F.when(p["train"], "1").otherwise("0"), F.length(p["text"]))), "")


def token_ids(pairs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``pair_id`` with ``ids`` and ``labels`` of both sides, each the prompt's ids and the completion's; labels of what doesn't count are -100."""
    schema = "pair_id long, " + ", ".join(f"{s}_{c} array<int>" for s in ("chosen", "rejected") for c in ("ids", "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.encode_special_tokens = True
        encode = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        for batch in batches:
            columns, prompts = [batch.column("pair_id")], encode(batch.column("prompt").to_pylist())
            for side in ("chosen", "rejected"):
                ids, labels = [], []
                for prompt, parts in zip(prompts, batch.column(side).to_pylist()):
                    own = encode([p["text"] for p in parts])
                    ids.append(prompt + [i for x in own for i in x])
                    labels.append([IGNORED] * len(prompt) + [i if p["train"] else IGNORED for p, x in zip(parts, own) for i in x])
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return pairs.select(F.col("pair_id").cast("long"), "prompt", "chosen", "rejected").mapInArrow(run, schema)
