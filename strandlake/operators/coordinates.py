"""Reference coordinates: dictionaries, total order, reference bases and depth."""
import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.cigar import aligned_blocks
from strandlake.functions.flags import is_mapped
from strandlake.operators.lookup import lookup
from strandlake.sources.fasta import OVERLAP, TILE

DEPTH_TILE = 16_384


def sequence_dictionary(ref_tiles: DataFrame, tile: int = TILE, digest: bool = True) -> DataFrame:
    """``(contig, length, idx, md5)``; ``md5`` is the checksum of the whole contig.

    The checksum is sequential by nature. Tiles are sorted inside their partition and streamed through the digest one
    Arrow batch at a time, so a task never holds a contig; the SAM specification bounds a contig by 2^31 bases.
    """
    own = ref_tiles.withColumn("own", F.substring("bases", 1, tile))
    rank = "rank" if "rank" in ref_tiles.columns else None
    sizes = own.groupBy("contig").agg(F.sum(F.length("own")).cast("long").alias("length"),
                                      (F.min(rank) if rank else F.lit(0)).alias("rank"))
    sizes = sizes.withColumn("idx", (F.row_number().over(Window.orderBy("rank", "contig")) - 1).cast("int"))
    if not digest:
        return sizes.select("contig", "length", "idx", F.lit(None).cast("string").alias("md5"))

    def stream(batches):
        contig, state = None, None
        for batch in batches:
            for name, bases in zip(batch["contig"], batch["own"]):
                if name != contig:
                    if contig is not None:
                        yield pd.DataFrame({"contig": [contig], "md5": [state.hexdigest()]})
                    contig, state = name, hashlib.md5()
                state.update(bases.upper().encode())
        if contig is not None:
            yield pd.DataFrame({"contig": [contig], "md5": [state.hexdigest()]})

    digests = (own.select("contig", "tile", "own").repartition("contig").sortWithinPartitions("contig", "tile")
               .mapInPandas(stream, "contig string, md5 string"))
    return sizes.join(digests, "contig").select("contig", "length", "idx", "md5")


def replace_sequences(alignments: DataFrame, seq_dict: DataFrame) -> DataFrame:
    """Attach the dictionary's contig order as ``contig_idx``. Unmapped rows keep null."""
    ranks = seq_dict.select("contig", F.col("idx").alias("contig_idx"))
    return lookup(alignments.drop("contig_idx"), ranks, "contig", salt_on=["frag", "flags"], how="left", measure=True)


def unknown_contigs(alignments: DataFrame, seq_dict: DataFrame) -> DataFrame:
    """Contigs used by records but missing in the dictionary, with their number of records."""
    used = alignments.filter(F.col("contig").isNotNull()).groupBy("contig").agg(F.count(F.lit(1)).alias("records"))
    return used.join(seq_dict.select("contig"), "contig", "left_anti")


def sort_key(alignments: DataFrame, seq_dict: DataFrame) -> DataFrame:
    """Adds ``_idx`` and ``_pos``, null for rows that belong at the end."""
    ranked = replace_sequences(alignments, seq_dict)
    return ranked.withColumn("_idx", F.col("contig_idx")).withColumn("_pos", F.col("pos")).drop("contig_idx")


def sort_by_reference_position(alignments: DataFrame, seq_dict: DataFrame) -> DataFrame:
    """Dictionary order, then position; unmapped last. Name and flags break ties, so one deep position is split too."""
    keyed = sort_key(alignments, seq_dict)
    return keyed.orderBy(F.col("_idx").asc_nulls_last(), F.col("_pos").asc_nulls_last(), "frag", "flags").drop("_idx", "_pos")


def attach_reference(rows: DataFrame, ref_tiles: DataFrame, salt_on, pos: str = "pos", length: Column | int = 1,
                     name: str = "ref_base", tile: int = TILE, upper: bool = True, overlap: int = OVERLAP) -> DataFrame:
    """Reference bases ``[pos, pos + length)`` of each row by an equi join on the tile.

    A stretch that runs out of its tile and the overlap, but not out of the contig, is an error: a cut window would pass for
    the whole one. Tiles are as long as ``tile`` and the overlap unless their contig ends in them.
    """
    tiles = ref_tiles.select("contig", F.col("tile").alias("_tile"), F.col("start").alias("_tile_start"), F.col("bases").alias("_tile_bases"))
    joined = lookup(rows.withColumn("_tile", F.floor((F.col(pos) - 1) / tile)), tiles, ["contig", "_tile"], salt_on, "left", measure=True)
    size = length if isinstance(length, Column) else F.lit(length)
    at, held = offset_in_tile(F.col(pos), F.col("_tile_start"), tile), F.octet_length("_tile_bases")
    cut = (at + size - 1 > held) & (held >= tile + overlap)
    bases = F.when(cut, F.raise_error(F.lit(f"a stretch of reference runs out of its tile of {tile} and {overlap} bases"))).otherwise(
        F.substring("_tile_bases", at, size.cast("int")))
    return joined.withColumn(name, F.upper(bases) if upper else bases).drop("_tile", "_tile_start", "_tile_bases")


def offset_in_tile(pos: Column, start: Column, tile: int) -> Column:
    """1-based place of ``pos`` in its tile; an error when the reference was cut into tiles of another size."""
    at = pos - start + 1
    return F.when(start.isNull() | at.between(1, tile), at).otherwise(
        F.raise_error(F.lit(f"the reference is not cut into tiles of {tile} bases"))).cast("int")


def depth_events(alignments: DataFrame, tile: int = DEPTH_TILE, by=("contig",)) -> DataFrame:
    """Depth changes ``(…, tile, at, delta)``. Blocks are cut at tile borders, so each tile adds up on its own."""
    spans = (alignments.filter(is_mapped(F.col("flags")) & F.col("pos").isNotNull())
             .select(*by, F.explode(aligned_blocks(F.col("pos"), F.col("cigar"))).alias("b"))
             .select(*by, (F.col("b.ref_start") - 1).alias("lo"), (F.col("b.ref_start") + F.col("b.len") - 1).alias("hi")))
    cut = (spans.withColumn("tile", F.explode(F.sequence(F.floor(F.col("lo") / tile), F.floor((F.col("hi") - 1) / tile))))
           .withColumn("lo", F.greatest("lo", F.col("tile") * tile))
           .withColumn("hi", F.least("hi", (F.col("tile") + 1) * tile)))
    ends = F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("delta")),
                   F.struct(F.col("hi").alias("at"), F.lit(-1).alias("delta")))
    events = cut.select(*by, "tile", F.explode(ends).alias("e")).select(*by, "tile", "e.at", "e.delta")
    return events.groupBy(*by, "tile", "at").agg(F.sum("delta").alias("delta"))


def coverage_runs(alignments: DataFrame, tile: int = DEPTH_TILE, by=("contig",)) -> DataFrame:
    """Runs of equal depth inside tiles: ``(…, start, end, depth)``, 1-based inclusive, depth above 0.

    Changes are summed per position before the window, so a window holds at most ``tile + 1`` rows at any depth.
    """
    w = Window.partitionBy(*by, "tile").orderBy("at")
    runs = depth_events(alignments, tile, by).select(
        *by, (F.col("at") + 1).alias("start"), F.lead("at").over(w).alias("end"),
        F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("depth"))
    return runs.filter((F.col("depth") > 0) & (F.col("end") >= F.col("start")))


def coverage(alignments: DataFrame, bin_size: int = 1, tile: int = DEPTH_TILE, by=("contig",)) -> DataFrame:
    """``bin_size=1``: depth per covered position; otherwise mean depth per bin of that many positions."""
    runs = coverage_runs(alignments, tile, by)
    if bin_size == 1:
        return runs.select(*by, F.explode(F.sequence("start", "end")).alias("pos"), "depth")
    first, last = F.floor((F.col("start") - 1) / bin_size), F.floor((F.col("end") - 1) / bin_size)
    cut = (runs.withColumn("bin", F.explode(F.sequence(first, last)))
           .withColumn("n", F.least("end", (F.col("bin") + 1) * bin_size)
                       - F.greatest("start", F.col("bin") * bin_size + 1) + 1))
    return cut.groupBy(*by, "bin").agg(F.sum(F.col("depth") * F.col("n")).alias("bases"),
                                       F.max("depth").alias("max_depth")).withColumn(
        "mean_depth", F.col("bases") / bin_size)
