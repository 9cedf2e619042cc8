"""Exact self-join of documents on the Jaccard distance of their word shingles, as a metric-space join.

Almost all pairs of documents are at distance 1, where a document as pivot tells nothing. The first level therefore takes
single shingles as pivots: a draw puts the pivots in random order, and a document belongs to the cell of the first pivots that
it holds. Draws are repeated until a pair within the threshold shares a cell in one of them but for a probability below
1e-9 (``Regions.missed``). Documents that share cells form regions, which are joined exactly inside a task:

* pivot documents are drawn from the region; a document goes to its nearest pivot, which gives Voronoi regions;
* a document x is replicated to the region of pivot p as well if d(x, p) <= d(x, nearest) + 2 e: by the triangle inequality
  no other region can hold a document within e of x;
* regions are joined recursively; where pivots no longer separate, a document is held against what is left, and those
  within e of it leave with it after they were compared with the window up to 2 e.

A region too large for a task, by its number of sets or their bytes, is first cut by finer draws (more pivots to a cell). What
stays large, as pages of one template that have less in common than a link takes, is cut again by the rarest shingles of each
document: two sets that link share one of them for certain. What even they don't part is dealt into blocks, every block gets
the same few documents as pivots, and what the main pivot holds is one component. If few documents are left over, as in a
mass of near copies, they are replicated to all blocks. If many are, each pair of blocks is joined, so a task never holds
more than two blocks. Exact copies are one node throughout.
"""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.components import components
from strandlake.llm.words import distinct, mix, pieces, shingle_hashes, word_hashes
from strandlake.operators.lookup import lookup, small_enough
from strandlake.sources.store import materialize


@dataclass(frozen=True)
class Regions:
    """Threshold and sizes."""
    shingle: int = 5  # words
    percent: int = 80  # 100 * intersection >= percent * union
    pivots: int = 4  # that name a cell
    draws: int = 40
    fine_pivots: int = 8
    fine_draws: int = 140
    task_nodes: int = 2_000  # nodes of a region that one task joins
    task_bytes: int = 64 << 20  # of their sets
    small: int = 32  # nodes that are compared without pivots

    def missed(self, fine: bool = False) -> float:
        """Probability that a pair at the threshold shares no cell."""
        pivots, draws = (self.fine_pivots, self.fine_draws) if fine else (self.pivots, self.draws)
        return (1 - (self.percent / 100) ** pivots) ** draws

    def blocks(self) -> Column:
        """Tasks that a group of ``n`` nodes with ``bytes`` of sets is dealt over."""
        return F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / self.task_nodes), F.ceil(F.col("bytes") / self.task_bytes)))


def sets_of(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    words, first = word_hashes(texts)
    return distinct(*shingle_hashes(words, first, size))


def set_node(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for each set that only depends on its members; 0 for the empty set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    out = mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))
    return np.where(np.diff(first) > 0, out, np.uint64(0)).view(np.int64)


def cells_of(hashes: np.ndarray, first: np.ndarray, pivots: int, draws: int, seed: int) -> np.ndarray:
    """Cell of every set (rows) in every draw (columns): a hash of the first shingles in ``pivots`` random orders. No set may be empty."""
    random = np.random.default_rng(seed)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, draws), np.uint64)
    if not len(out):
        return out.view(np.int64)
    for d in range(draws):
        cell = np.full(len(out), d + 1 + (seed << 20), np.uint64)
        for _ in range(pivots):
            turn, by = random.integers(0, 1 << 32, 2, np.uint32)
            cell = mix(cell ^ np.minimum.reduceat((low ^ turn) * (by | np.uint32(1)), first[:-1]))
        out[:, d] = cell
    return out.view(np.int64)


def _sketch(regions: Regions):
    """Task that turns ``(doc_id, key, text)`` into ``(doc_id, key, node, n_shingles, cells)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, piece in pieces(batch.column(2)):
                hashes, first = sets_of(piece, regions.shingle)
                n = np.diff(first)
                full = np.flatnonzero(n > 0)
                cells = cells_of(hashes, np.concatenate([first[full], first[-1:]]), regions.pivots, regions.draws, 1)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, regions.draws, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(at, len(piece)) for k in (0, 1)), pa.array(set_node(hashes, first)), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(cells.ravel()))], ["doc_id", "key", "node", "n_shingles", "cells"])
    return run


def _members(regions: Regions):
    """Task that turns ``(node, region, text)`` into ``(node, region, hashes)``; texts that aren't the node's are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, piece in pieces(batch.column(2)):
                hashes, first = sets_of(piece, regions.shingle)
                wanted, own = batch.column(0).slice(at, len(piece)), set_node(hashes, first)
                same = np.flatnonzero(wanted.to_numpy() == own)
                rows = [hashes[first[k]:first[k + 1]].tobytes() for k in same]
                yield pa.RecordBatch.from_arrays([wanted.take(pa.array(same)), batch.column(1).slice(at, len(piece)).take(pa.array(same)), pa.array(rows, pa.binary())],
                                                 ["node", "region", "hashes"])
    return run


class Region:
    """Sets of one region with the links found between them."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.n = percent, np.array([len(s) for s in sets], np.int64)
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.codes, self.width = codes.astype(np.int32), int(codes.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.root = np.arange(len(sets))
        self.epsilon = 1 - percent / 100

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return int(x)

    def link(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        self.root[max(a, b)] = min(a, b)

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of x with each of ``others``."""
        held = np.zeros(self.width, bool)
        held[self.codes[self.first[x]:self.first[x + 1]]] = True
        n = self.n[others]
        begin = np.cumsum(n) - n
        at = np.repeat(self.first[others] - begin, n) + np.arange(n.sum())
        return np.add.reduceat(held[self.codes[at]], begin, dtype=np.int64)

    def distance(self, x: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard distances, and which are within the threshold (in whole numbers)."""
        both = self.common(x, others)
        union = self.n[x] + self.n[others] - both
        return 1 - both / union, 100 * both >= self.percent * union

    def join(self, own: np.ndarray, more: np.ndarray, small: int) -> None:
        """Link all pairs within the threshold of which at least one is in ``own``, the other in ``own`` or ``more``."""
        work = [(own, more)]
        while work:
            own, more = work.pop()
            if not len(own):
                continue
            everyone = np.concatenate([own, more])
            if len(everyone) > small:
                pivots = own[np.linspace(0, len(own) - 1, min(len(own), max(2, int(len(everyone) ** 0.5) // 2))).astype(int)]
                far = np.empty((len(everyone), len(pivots)))
                for k, p in enumerate(pivots):
                    far[:, k], near = self.distance(p, everyone)
                    for x in everyone[near]:
                        self.link(int(p), int(x))
                nearest = far.argmin(1)
                window = far <= far.min(1, keepdims=True) + 2 * self.epsilon + 1e-9
                parts = [(own[nearest[:len(own)] == k], everyone[window[:, k] & ((nearest != k) | (np.arange(len(everyone)) >= len(own)))]) for k in range(len(pivots))]
                if max(len(a) + len(b) for a, b in parts) <= 0.7 * len(everyone):
                    work += parts
                    continue
            self.peel(own, more)

    def peel(self, own: np.ndarray, more: np.ndarray) -> None:
        """Hold one document after the other against what is left of ``own`` and ``more``; those that link to it leave with it."""
        left, mine = np.concatenate([own, more]), np.concatenate([np.ones(len(own), bool), np.zeros(len(more), bool)])
        while mine.any():
            p = int(left[np.flatnonzero(mine)[0]])
            far, near = self.distance(p, left)
            for x in left[near]:
                self.link(p, int(x))
            ball, window = left[near], left[~near & (far <= 2 * self.epsilon + 1e-9)]
            for y in window:  # a pair of the ball and the window
                rest = ball[[self.find(int(x)) != self.find(int(y)) for x in ball]]
                if len(rest):
                    close = self.distance(int(y), rest)[1]
                    for x in rest[close]:
                        self.link(int(y), int(x))
            left, mine = left[~near], mine[~near]


def _link_groups(regions: Regions):
    """Task over rows sorted by group: ``(group, node, part, hashes)`` to ``(group, a, b)``, node and root.

    ``part`` 0 are pivots that every group of a large region holds, 1 documents that are compared with all, 2 documents that are
    replicated from elsewhere and needn't be compared with each other.
    """
    def solve(rows: list[tuple[int, int, bytes]]) -> tuple[list[int], list[int]]:
        rows.sort()
        nodes, sets = [r[1] for r in rows], [np.frombuffer(r[2], np.uint64) for r in rows]
        region = Region(sets, regions.percent)
        part = np.array([r[0] for r in rows])
        region.join(np.flatnonzero(part < 2), np.flatnonzero(part == 2), regions.small)
        return nodes, [nodes[region.find(i)] for i in range(len(nodes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, out = None, [], ([], [], [])

        def done():
            nodes, roots = solve(rows) if rows else ([], [])
            for column, x in zip(out, ([group] * len(nodes), nodes, roots)):
                column.extend(x)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for g, node, part, hashes in zip(*columns):
                if g != group:
                    done()
                    rows = []
                group = g
                rows.append((part, node, hashes))
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["group", "a", "b"])
                out = ([], [], [])
        done()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["group", "a", "b"])
    return run


def _in_groups(rows: DataFrame, regions: Regions) -> DataFrame:
    """Links ``(group, a, b)`` found by joining each group of ``rows (group, node, part, hashes)`` in a task."""
    return rows.select("group", "node", "part", "hashes").repartition("group").sortWithinPartitions("group").mapInArrow(_link_groups(regions), "group long, a long, b long")


def _regions(cells: DataFrame) -> DataFrame:
    """``(node, region)`` of the nodes that share a cell with another one; ``cells (node, cells)``, where nodes may repeat.

    A node links to the smallest node of all its cells, and so do the smallest nodes of each of them: a large group whose
    members share many cells gives about one link a member, not one for each cell.
    """
    rows = cells.select("node", F.explode("cells").alias("cell"))
    shared = materialize(rows.groupBy("cell").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("cell", "low"), "cells")
    seen = rows.join(shared, "cell").groupBy("node").agg(F.min("low").alias("b"), F.collect_set("low").alias("lows"))  # at most one from each draw
    links = seen.select(F.explode(F.array_union("lows", F.array("node"))).alias("a"), "b")
    return components(links).withColumnRenamed("root", "region")


def _measured(members: DataFrame, regions: Regions) -> DataFrame:
    """``(region, n, bytes, blocks)`` of ``members (node, region, hashes)``."""
    sizes = members.groupBy("region").agg(F.count("*").alias("n"), F.sum(F.length("hashes")).alias("bytes"))
    return sizes.withColumn("blocks", regions.blocks())


def _fine_cells(members: DataFrame, regions: Regions) -> DataFrame:
    """``(node, cells)`` with cells of more pivots than those of the first level."""
    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
            cells = cells_of(np.concatenate(sets) if sets else np.empty(0, np.uint64), first, regions.fine_pivots, regions.fine_draws, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(cells), pa.list_(pa.int64()))], ["node", "cells"])

    return members.select("node", "hashes").mapInArrow(fine, "node long, cells array<long>")


def rare_cells(members: DataFrame, regions: Regions) -> DataFrame:
    """``(node, cells)``: of each set, the rarest shingles of its region that it can't do without in a link.

    A link takes ``least = ceil(percent n / 100)`` common shingles, so of any ``n - least + 1`` shingles of a set the other set
    holds one. With one order for all, from rare to frequent, both sets have such a shingle among their first ones. Shingles
    that no other set of the region holds are no cells.
    """
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a set at a time
                held = np.frombuffer(batch.column(2)[at].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column(0)[at], len(held)), pa.repeat(batch.column(1)[at], len(held)), pa.array(held)], ["node", "region", "shingle"])

    rows = members.select("node", "region", "hashes").mapInArrow(listed, "node long, region long, shingle long")
    shared = rows.groupBy("region", "shingle").agg(F.count("*").alias("held")).filter("held > 1")
    n = members.select("node", F.expr("length(hashes) div 8").alias("n"))
    least = F.floor((F.col("n") * regions.percent + 99) / 100)
    wanted = F.col("n") - least + 1 - (F.col("n") - F.col("known"))  # shingles of this set alone come first
    known = rows.join(shared, ["region", "shingle"])
    ranked = known.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("held", "shingle"))).withColumn(
        "known", F.count("*").over(Window.partitionBy("node")))
    first = ranked.join(n, "node").filter(F.col("place") <= wanted)
    return first.groupBy("node").agg(F.collect_list(F.xxhash64("region", "shingle")).alias("cells"))


def _in_blocks(members: DataFrame, regions: Regions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links within blocks of each region and with its pivots; all nodes of regions with more than one block, and those of them
    that the region's main pivot doesn't hold.

    Documents that one pivot holds are in one component. All others still have to meet each document outside of their block.
    """
    sizes = materialize(_measured(members, regions), "block-sizes")
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit(1), "node"), F.ceil(F.col("n") / 8)) == 0)  # about eight to a region
    own = (members.join(sizes, "region").withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")))
           .withColumn("group", F.xxhash64("region", "at")).withColumn("part", F.when(pivot, 0).otherwise(1)))
    many = materialize(own.filter("blocks > 1"), "block-members")
    columns = ["group", "node", "part", "hashes"]
    first = _in_groups(own.filter("blocks = 1").select(*columns).unionByName(many.select(*columns)).unionByName(_to_blocks(many.filter("part = 0"), 0)), regions)
    first = materialize(first, "block-links")
    places = many.select("region", "group", F.col("node").alias("a"))
    pivots = first.join(many.filter("part = 0").select("region", F.col("node").alias("a")).distinct(), "a").select("region", "group", F.col("a").alias("pivot"), "b")
    held = materialize(first.join(places, ["group", "a"]).join(pivots.drop("region"), ["group", "b"]).select("region", "a", "pivot"), "block-held")
    main = held.groupBy("region", "pivot").count().groupBy("region").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("main"))
    kept = lookup(held, main, "region", "a").filter("pivot = main").select(F.col("a").alias("node"))
    return first.select("a", "b"), many, materialize(many.join(kept, "node", "left_anti"), "block-loose")


def _to_blocks(rows: DataFrame, part: int) -> DataFrame:
    """A copy of each row for every other block of its region."""
    others = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: b != F.col("at")))
    return rows.withColumn("to", others).select(F.xxhash64("region", "to").alias("group"), "node", F.lit(part).alias("part"), "hashes")


def _by_pairs(many: DataFrame, loose: DataFrame, regions: Regions) -> DataFrame:
    """Links of ``loose`` nodes with nodes of other blocks, for each pair of blocks that holds a loose one."""
    low, high = F.least("at", "to"), F.greatest("at", "to")
    others = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: b != F.col("at")))

    def met(rows: DataFrame, part: int) -> DataFrame:
        return rows.withColumn("to", others).select(F.xxhash64("region", low, high).alias("group"), "node", F.lit(part).alias("part"), "hashes")

    asked = met(loose, 1)
    rest = met(many.join(loose.select("node"), "node", "left_anti"), 2).join(asked.select("group").distinct(), "group", "left_semi")
    return _in_groups(asked.unionByName(rest), regions).select("a", "b")


def _large_regions(members: DataFrame, regions: Regions) -> DataFrame:
    """Links within regions of ``members (node, region, hashes)`` that no task can hold.

    The steps: finer cells; for what is still too large, cells of rare shingles; blocks; loose documents to all blocks or by pairs of blocks.
    """
    found = members.drop("region").join(materialize(_regions(materialize(_fine_cells(members, regions), "fine-cells")), "fine-regions"), "node")
    crowded = materialize(_measured(found, regions).filter("blocks > 1").select("region"), "crowded-regions")
    if not crowded.isEmpty():
        crowd = materialize(found.join(crowded, "region", "left_semi").select("node", "region", "hashes"), "crowd")
        cut = materialize(_regions(materialize(rare_cells(crowd, regions), "rare-cells")), "rare-regions")
        found = found.select("node", "region", "hashes").join(crowded, "region", "left_anti").unionByName(
            crowd.drop("region").join(cut, "node").select("node", "region", "hashes"))
    links, many, loose = _in_blocks(found, regions)
    if loose.isEmpty():
        return links
    dense = materialize(_measured(loose, regions).filter("blocks > 1").select("region"), "dense-regions")
    few = loose.join(dense, "region", "left_anti")  # at most a block of them, so a task holds two
    reached = many.join(few.select("region").distinct(), "region", "left_semi")
    columns = ["group", "node", "part", "hashes"]
    links = links.unionByName(_in_groups(reached.select(*columns).unionByName(_to_blocks(few, 2)), regions).select("a", "b"))
    return links if dense.isEmpty() else links.unionByName(_by_pairs(many.join(dense, "region", "left_semi"), loose.join(dense, "region", "left_semi"), regions))


def link_documents(docs: DataFrame, regions: Regions = Regions()) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs (doc_id, text, …)``.

    Two documents link when their sets of shingles have a Jaccard similarity of the threshold or more; ``component_id`` is the
    smallest doc_id reachable by links. A null or blank text has an empty set and links with nothing; a text with fewer words
    than a shingle is one shingle. Repeated rows come back once each; a null doc_id is only taken as component_id if no other
    is reachable. Other columns are ignored. A very long text is one set: its shingles are held at once where it is compared, and
    few such sets share a task, as tasks are bounded by the bytes of their sets, too.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), F.col("text").cast("string"))
    sketch = texts.mapInArrow(_sketch(regions), "doc_id long, key long, node long, n_shingles long, cells array<long>")
    sketch = materialize(sketch, "sketches")
    full = sketch.filter("n_shingles > 0")
    region = materialize(_regions(full), "regions")
    named = materialize(full.groupBy("node").agg(F.min("key").alias("key")).join(region, "node"), "named")
    chosen = texts.join(F.broadcast(named) if small_enough(named) else named, "key").select("node", "region", "text")
    members = chosen.mapInArrow(_members(regions), "node long, region long, hashes binary").dropDuplicates(["node"])
    members = materialize(members, "members")
    large = materialize(_measured(members, regions).filter("blocks > 1").select("region"), "large")
    tasks = members if large.isEmpty() else members.join(large, "region", "left_anti")
    links = _in_groups(tasks.select(F.col("region").alias("group"), "node", F.lit(1).alias("part"), "hashes"), regions)
    root = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if not large.isEmpty():
        root = root.unionByName(components(_large_regions(materialize(members.join(large, "region"), "large-members"), regions)))
    classes = materialize(sketch.select("node", "doc_id", "n_shingles").join(root, "node", "left").withColumn("class", F.coalesce("root", "node")), "classes")
    lowest = classes.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("low"))
    joined = lookup(classes, lowest, "class", "doc_id", how="left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, regions: Regions = Regions()) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest doc_id. Rows that share a doc_id stay or go together;
    rows without one stay."""
    links = link_documents(docs, regions)
    gone = materialize(links.filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("__gone")).distinct(), "copies")
    return docs.join(F.broadcast(gone) if small_enough(gone) else gone, F.col("doc_id") == F.col("__gone"), "left_anti")
