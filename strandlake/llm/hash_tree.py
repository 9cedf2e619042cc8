"""Sharding by a weighted hash tree: a row descends region, rack and shard, one weighted draw per level.

A draw gives every child of a node the score ``-ln(u) / weight``, with ``u`` in (0, 1) hashed from the row's key and the
child's path; the smallest score wins, so a child wins in proportion to its weight. Raising the weight of one child can
only lower that child's score: rows move into its subtree and nowhere else, and rows outside of the changed subtrees keep
their places among each other.

Adding a shard therefore puts it below a region and a rack of its own (``grown``): the only weight that changes at the
top is the new one, and every row that moves lands in the new shard.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One region is a list of racks, one rack maps its shards to their weights.
Tree = list[list[dict[int, float]]]

SLOT_ROWS = 50_000  # rows that one slot bucket holds on average


def even_tree(regions: int, racks: int, shards: int) -> Tree:
    """Shards numbered from 0, with the same weight and the same number below every rack."""
    number = iter(range(regions * racks * shards))
    return [[{next(number): 1.0 for _ in range(shards)} for _ in range(racks)] for _ in range(regions)]


def grown(tree: Tree, shards: int = 1, weight: float = 1.0) -> Tree:
    """The tree with further shards, each in a region of its own, so that no existing subtree changes its weight."""
    last = max((s for region in tree for rack in region for s in rack), default=-1)
    return [*tree, *([{last + 1 + i: weight}] for i in range(shards))]


def _children(tree: Tree) -> Column:
    """Map from the path of a node to its children ``(path, weight, shard)``; children without weight are left out."""
    weight = lambda rack: sum(rack.values())
    nodes: dict[str, list[tuple[str, float, int | None]]] = {"": []}
    for r, region in enumerate(tree):
        nodes[""].append((f"{r}", sum(map(weight, region)), None))
        nodes[f"{r}"] = [(f"{r}/{k}", weight(rack), None) for k, rack in enumerate(region)]
        nodes |= {f"{r}/{k}": [(f"{r}/{k}/{s}", w, s) for s, w in rack.items()] for k, rack in enumerate(region)}
    live = {parent: [c for c in children if c[1] > 0] for parent, children in nodes.items()}
    if not live[""]:
        raise ValueError("the tree has no shard with a weight above 0")
    as_struct = lambda path, w, s: F.struct(F.lit(path).alias("path"), F.lit(float(w)).alias("weight"), F.lit(s).cast("int").alias("shard"))
    return F.create_map(*[x for parent, children in live.items() if children for x in (F.lit(parent), F.array(*[as_struct(*c) for c in children]))])


def _draw(children: Column, key: Column, parent: Column) -> Column:
    """The child of ``parent`` with the smallest score."""
    def score(child):
        digits = F.substring(F.md5(F.concat(key, F.lit("/"), child["path"]).cast("binary")), 1, 13)
        return -F.ln((F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)) / child["weight"]
    return F.array_min(F.transform(F.element_at(children, parent), lambda c: F.struct(score(c).alias("score"), c.alias("child"))))["child"]


def assign(df: DataFrame, key: str, tree: Tree, name: str = "shard") -> DataFrame:
    """Add the shard of each row as ``name``. A null key counts as a key of its own. Rows aren't shuffled.

    Only the children of the chosen region and rack are scored, so a row costs as many draws as these have children.
    """
    children, text, node = _children(tree), F.coalesce(F.col(key).cast("string"), F.lit("null")), f"__{name}_node"
    out = df.withColumn(node, _draw(children, text, F.lit("")))
    for _ in ("rack", "shard"):
        out = out.withColumn(node, _draw(children, text, F.col(node)["path"]))
    return out.withColumn(name, F.col(node)["shard"]).drop(node)


def number_slots(df: DataFrame, shard: str, key: str, name: str = "slot", rows: int = SLOT_ROWS) -> DataFrame:
    """Add gapless numbers from 0 within each shard, in the order of the key (nulls first).

    Rows are numbered within ranges of keys that hold about ``rows`` rows each; the count of the rows in earlier ranges
    is added. No task sees a whole shard.
    """
    span = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    width = max(1, (hi - lo + 1) * rows // max(span["n"], 1))
    bucket = F.coalesce(F.floor((F.col(key) - F.lit(lo)) / F.lit(width)), F.lit(-1)).cast("long")
    placed = df.withColumn("__bucket", bucket)
    counts = placed.groupBy(shard, "__bucket").count()
    before = F.sum("count").over(Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(shard).alias("__shard"), F.col("__bucket").alias("__start"), F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(shard, "__bucket").orderBy(F.col(key).asc_nulls_first()))
    numbered = placed.withColumn("__rank", rank)
    joined = numbered.join(starts, (F.col(shard) == F.col("__shard")) & (F.col("__bucket") == F.col("__start")))
    return joined.withColumn(name, F.col("__before") + F.col("__rank") - 1).select(*df.columns, name)


def shard_documents(docs: DataFrame, tree: Tree, more: Tree) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs (doc_id, text, …)``.

    ``size`` is the UTF-8 length plus 8 and ``text_crc32`` the checksum of the UTF-8 bytes; a null text has no bytes (size
    8, checksum 0). The key decides on the shard: equal and null doc_ids share one, repeated rows get a slot each. Other
    columns of ``docs`` are ignored, an empty table gives an empty result. Only numbers are shuffled, never texts.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = assign(assign(rows, "doc_id", tree, "shard"), "doc_id", more, "grown_shard")
    return number_slots(placed, "shard", "doc_id").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
