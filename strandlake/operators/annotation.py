"""Variant consequences from gene features by a binned interval join."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import revcomp
from strandlake.operators.coordinates import attach_reference
from strandlake.operators.lookup import lookup
from strandlake.sources.fasta import TILE
from strandlake.sources.store import materialize

BIN = 16_384

# Consequence terms from most to least severe, with their impact.
CONSEQUENCES = [
    ("stop_gained", "HIGH"), ("frameshift_variant", "HIGH"), ("stop_lost", "HIGH"), ("start_lost", "HIGH"),
    ("inframe_insertion", "MODERATE"), ("inframe_deletion", "MODERATE"), ("missense_variant", "MODERATE"),
    ("stop_retained_variant", "LOW"), ("synonymous_variant", "LOW"), ("coding_sequence_variant", "MODIFIER"), ("5_prime_UTR_variant", "MODIFIER"), ("3_prime_UTR_variant", "MODIFIER"),
    ("non_coding_transcript_exon_variant", "MODIFIER"), ("intron_variant", "MODIFIER"),
    ("transcript_variant", "MODIFIER"), ("upstream_gene_variant", "MODIFIER"), ("downstream_gene_variant", "MODIFIER"),
    ("intergenic_variant", "MODIFIER"),
]
# Amino acids of the standard genetic code, by codons in the order of the bases TCAG; * is a stop.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODING_FIELDS = ["cds_position", "protein_position", "amino_acids", "codons"]
CSQ_FORMAT = ("Allele|Consequence|IMPACT|SYMBOL|Gene|Feature_type|Feature|BIOTYPE|EXON|INTRON|HGVSc|HGVSp|cDNA_position|"
              "CDS_position|Protein_position|Amino_acids|Codons|Existing_variation|DISTANCE|STRAND")


def _by_term(position: int) -> Column:
    pairs = [(t, i) for i, (t, _) in enumerate(CONSEQUENCES)] if position == 0 else CONSEQUENCES
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def changed_span(variants: DataFrame) -> DataFrame:
    """Allele rows with the changed bases: a first base shared by REF and ALT is not part of the change.

    Adds ``allele`` (``-`` when nothing is left), ``v_start``, ``v_end`` and ``shift``, the change in length.
    """
    shared = (F.length("ref") != F.length("alt")) & (F.left("ref", F.lit(1)) == F.left("alt", F.lit(1)))
    rest = F.when(shared, F.substring("alt", 2, 1 << 30)).otherwise(F.col("alt"))
    start = F.col("pos") + F.when(shared, 1).otherwise(0)
    return variants.select(
        *variants.columns, F.when(rest == "", "-").otherwise(rest).alias("allele"), start.alias("v_start"),
        F.greatest(start, F.col("pos") + F.length("ref") - 1).alias("v_end"),
        (F.length("alt") - F.length("ref")).alias("shift"))


def _translated(bases: Column) -> Column:
    """Amino acids of whole codons; X for a codon with a base other than A, C, G and T."""
    at = lambda k, i: F.instr(F.lit("TCAG"), F.substring(bases, 3 * k + i, F.lit(1)))
    acid = lambda k: F.when(F.least(at(k, 1), at(k, 2), at(k, 3)) > 0, F.substring(
        F.lit(AMINO_ACIDS), 16 * (at(k, 1) - 1) + 4 * (at(k, 2) - 1) + at(k, 3), F.lit(1))).otherwise("X")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(bases) / 3).cast("int") - 1), acid), "")


def coding_changes(hits: DataFrame, features: DataFrame, ref_tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """What substitutions do to the protein: ``contig, pos, ref, alt, transcript``, a ``term`` and ``CODING_FIELDS``.

    ``hits (contig, pos, ref, alt, transcript)`` are alleles as long as their reference. The coding segments of a transcript are
    spliced in the direction of its strand, and each base of the codons that an allele touches, wherever it lies in the genome,
    is looked up in the reference on its own. Alleles that reach out of the coding segments and codons that the transcript
    doesn't finish give no row. A column ``phase`` of ``features`` tells how many bases the first segment's codon lacks.
    """
    phase = F.col("phase") if "phase" in features.columns else F.lit(0)
    cds = features.filter("feature = 'CDS'").groupBy("contig", "transcript").agg(
        F.max("strand").alias("strand"), F.sort_array(F.collect_list(F.struct("start", "end", F.coalesce(phase, F.lit(0)).cast("int").alias("phase")))).alias("segs"))
    ahead = F.col("strand") == "+"
    order = F.when(ahead, F.col("segs")).otherwise(F.reverse("segs"))
    size = lambda x: x["end"] - x["start"] + 1
    before = lambda i: F.aggregate(F.slice("segs", 1, i), F.lit(0).cast("long"), lambda n, x: n + size(x))
    spliced = (cds.withColumn("segs", order).withColumn("skip", F.col("segs")[0]["phase"])
               .withColumn("total", before(F.size("segs")) - F.col("skip"))
               .withColumn("segs", F.transform("segs", lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), (before(i) - F.col("skip")).alias("before")))))
    found = lookup(hits, spliced, ["contig", "transcript"], ["pos", "alt"])
    place = lambda g: F.try_element_at(F.transform(F.filter("segs", lambda x: g.between(x["start"], x["end"])),  # noqa: E731 - null outside
                                                   lambda x: x["before"] + F.when(ahead, g - x["start"]).otherwise(x["end"] - g)), F.lit(1))
    ends = found.withColumns({"_a": place(F.col("pos")), "_b": place(F.col("pos") + F.length("ref") - 1)})
    lo, hi = F.least("_a", "_b"), F.greatest("_a", "_b")
    touched = ends.withColumns({"lo": lo, "hi": hi}).filter(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("lo") >= 0) & (F.col("hi") - F.col("lo") == F.length("ref") - 1)
                                                          & (3 * F.floor(F.col("hi") / 3) + 3 <= F.col("total")))
    keys = ["contig", "pos", "ref", "alt", "transcript"]
    bases = touched.select(*keys, "strand", "segs", "lo", "hi", F.explode(F.sequence(3 * F.floor(F.col("lo") / 3), 3 * F.floor(F.col("hi") / 3) + 2)).alias("o"))
    held = F.element_at(F.filter("segs", lambda x: (F.col("o") >= x["before"]) & (F.col("o") < x["before"] + size(x))), 1)
    placed = bases.withColumn("_seg", held).withColumn("g", F.when(ahead, F.col("_seg.start") + F.col("o") - F.col("_seg.before")).otherwise(
        F.col("_seg.end") - F.col("o") + F.col("_seg.before"))).drop("segs", "_seg")
    known = attach_reference(placed, ref_tiles, ["pos", "o"], pos="g", name="_base", tile=tile)
    changed = F.col("g").between(F.col("pos"), F.col("pos") + F.length("ref") - 1)
    new = F.when(changed, F.upper(F.substring("alt", (F.col("g") - F.col("pos") + 1).cast("int"), F.lit(1)))).otherwise(F.col("_base"))
    facing = lambda c: F.when(ahead, c).otherwise(revcomp(c))
    shown = lambda c: F.when(changed, F.upper(c)).otherwise(F.lower(c))  # noqa: E731 - a changed base in upper case
    cells = known.withColumns({"_old": shown(facing(F.col("_base"))), "_new": shown(facing(new))})
    codons = cells.groupBy(*keys, "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("o", "_old", "_new"))).alias("c"))
    text = lambda c: F.array_join(F.transform("c", lambda x: x[c]), "")
    read = codons.select(*keys, "lo", "hi", text("_old").alias("old"), text("_new").alias("new")).filter(F.length("old") == 3 * F.floor(F.col("hi") / 3) + 3 - 3 * F.floor(F.col("lo") / 3))
    acids = read.withColumns({"a": _translated(F.upper("old")), "b": _translated(F.upper("new"))})
    a, b = F.col("a"), F.col("b")
    term = (F.when(a.contains("X") | b.contains("X"), "coding_sequence_variant")
            .when(a == b, F.when(a.contains("*"), "stop_retained_variant").otherwise("synonymous_variant"))
            .when((F.col("lo") < 3) & a.startswith("M") & ~b.startswith("M"), "start_lost")
            .when(b.contains("*") & ~a.contains("*"), "stop_gained").when(a.contains("*") & ~b.contains("*"), "stop_lost").otherwise("missense_variant"))
    span = lambda x, y: F.concat_ws("-", x.cast("string"), F.when(x != y, y.cast("string")))
    return acids.select(*keys, term.alias("term"), span(F.col("lo") + 1, F.col("hi") + 1).alias("cds_position"),
                        span(F.floor(F.col("lo") / 3) + 1, F.floor(F.col("hi") / 3) + 1).alias("protein_position"),
                        F.when(a == b, a).otherwise(F.concat_ws("/", a, b)).alias("amino_acids"), F.concat_ws("/", "old", "new").alias("codons"))


def consequences(variants: DataFrame, features: DataFrame, upstream: int = 5000, bin_size: int = BIN, ref_tiles: DataFrame | None = None,
                 tile: int = TILE) -> DataFrame:
    """One row per allele (``contig, pos, ref, alt``) and transcript within ``upstream`` bases, else one intergenic row.

    Both sides are cut into bins and joined on (contig, bin). A pair that shares several bins is kept in the first of
    them only, so no distinct is needed. ``features`` holds transcript rows and, optionally, exon and CDS rows. With the reference
    as ``ref_tiles``, substitutions in coding segments are told apart by what they do to the protein, and ``CODING_FIELDS`` filled.
    """
    alleles = changed_span(variants.select("contig", "pos", "ref", "alt").distinct())
    bins = lambda lo, hi: F.sequence(F.floor(lo / bin_size), F.floor(hi / bin_size))
    v = alleles.withColumn("_bin", F.explode(bins(F.col("v_start"), F.col("v_end")))).withColumn(
        "_vb", F.floor(F.col("v_start") / bin_size))
    shape = features.filter(F.col("feature").isin("exon", "CDS")).groupBy("contig", "transcript").agg(
        F.count_if(F.col("feature") == "exon").alias("exons"), F.min(F.when(F.col("feature") == "CDS", F.col("start"))).alias("cds_start"),
        F.max(F.when(F.col("feature") == "CDS", F.col("end"))).alias("cds_end"))
    window = F.when(F.col("feature") == "transcript", upstream).otherwise(0)
    f = features.filter(F.col("feature").isin("transcript", "exon", "CDS")).join(shape, ["contig", "transcript"], "left")
    f = f.select(
        "contig", "transcript", "feature", F.col("start").alias("f_start"), F.col("end").alias("f_end"), "strand", "gene",
        "gene_id", "biotype", F.coalesce("exons", F.lit(0)).alias("exons"), "cds_start", "cds_end",
        (F.col("start") - window).alias("w_start"), (F.col("end") + window).alias("w_end"))
    f = f.withColumn("_bin", F.explode(bins(F.col("w_start"), F.col("w_end")))).withColumn(
        "_fb", F.floor(F.col("w_start") / bin_size))
    hits = (v.join(f, ["contig", "_bin"])
            .filter((F.col("v_start") <= F.col("w_end")) & (F.col("v_end") >= F.col("w_start"))
                    & (F.col("_bin") == F.greatest("_vb", "_fb"))))
    is_transcript = F.col("feature") == "transcript"
    keys = ["contig", "pos", "ref", "alt", "transcript"]
    about = F.struct("f_start", "f_end", "strand", "gene", "gene_id", "biotype", "exons", "cds_start", "cds_end",
                     "allele", "v_start", "v_end", "shift")
    per_transcript = hits.groupBy(*keys).agg(
        F.max(F.when(is_transcript, about)).alias("t"), F.max(F.col("feature") == "exon").alias("in_exon"),
        F.max(F.col("feature") == "CDS").alias("in_cds")).filter(F.col("t").isNotNull())
    per_transcript = materialize(per_transcript, "near-transcripts")  # read twice: to describe the hits, and to find alleles without one
    t = lambda c: F.col(f"t.{c}")
    forward = t("strand") == "+"
    before, after = t("v_end") < t("f_start"), t("v_start") > t("f_end")
    sided = lambda left, right: F.when(forward, left).otherwise(right)
    term = (F.when(before, sided("upstream_gene_variant", "downstream_gene_variant"))
            .when(after, sided("downstream_gene_variant", "upstream_gene_variant"))
            .when(F.col("in_cds"), F.when(t("shift") % 3 != 0, "frameshift_variant").when(t("shift") > 0, "inframe_insertion")
                  .when(t("shift") < 0, "inframe_deletion").otherwise("coding_sequence_variant"))
            .when(F.col("in_exon"), F.when(t("cds_start").isNull(), "non_coding_transcript_exon_variant")
                  .when(t("v_end") < t("cds_start"), sided("5_prime_UTR_variant", "3_prime_UTR_variant"))
                  .otherwise(sided("3_prime_UTR_variant", "5_prime_UTR_variant")))
            .when(t("exons") > 0, "intron_variant").otherwise("transcript_variant"))
    distance = F.when(before, t("f_start") - t("v_end")).when(after, t("v_start") - t("f_end"))
    near = per_transcript.select(
        "contig", "pos", "ref", "alt", t("allele").alias("allele"), term.alias("consequence"), t("gene").alias("symbol"),
        t("gene_id").alias("gene"), F.lit("Transcript").alias("feature_type"), F.col("transcript").alias("feature"),
        t("biotype").alias("biotype"), distance.alias("distance"), F.when(forward, 1).otherwise(-1).alias("strand"))
    nothing = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    far = alleles.join(per_transcript.select("contig", "pos", "ref", "alt"), ["contig", "pos", "ref", "alt"], "left_anti").select(
        "contig", "pos", "ref", "alt", "allele", F.lit("intergenic_variant").alias("consequence"), nothing("symbol"),
        nothing("gene"), nothing("feature_type"), nothing("feature"), nothing("biotype"), nothing("distance", "long"),
        nothing("strand", "int"))
    both = near.unionByName(far)
    if ref_tiles is not None:
        whole = (F.col("consequence") == "coding_sequence_variant") & (F.length("ref") == F.length("alt"))
        changes = coding_changes(both.filter(whole).select("contig", "pos", "ref", "alt", F.col("feature").alias("transcript")), features, ref_tiles, tile)
        both = both.join(changes.withColumnRenamed("transcript", "feature"), ["contig", "pos", "ref", "alt", "feature"], "left")
        both = both.withColumn("consequence", F.coalesce("term", "consequence")).drop("term")
    return both.withColumn("impact", F.element_at(_by_term(1), F.col("consequence")))


def pick_consequence(csq: DataFrame, per: str = "allele") -> DataFrame:
    """The most severe consequence per allele (or per ``site``); ties by distance, then transcript name.

    A minimum that is combined before the shuffle, so an allele with very many transcripts stays cheap.
    """
    keys = {"allele": ["contig", "pos", "ref", "alt"], "site": ["contig", "pos"]}[per]
    rest = [c for c in csq.columns if c not in keys]
    order = [F.element_at(_by_term(0), F.col("consequence")).alias("_rank"), F.coalesce("distance", F.lit(0)).alias("_distance"),
             F.coalesce("feature", F.lit("")).alias("_feature")]
    best = csq.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def csq_text(coding: bool = False) -> Column:
    """One ``CSQ`` entry: allele, consequence, impact, gene and transcript fields, those of the protein if ``coding``, distance and strand."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    names = ("allele", "consequence", "impact", "symbol", "gene", "feature_type", "feature", "biotype")
    coding_ = [blank(c) if coding else F.lit("") for c in CODING_FIELDS]
    return F.concat_ws("|", *[blank(c) for c in names], *[F.lit("")] * 5, *coding_, F.lit(""), blank("distance"), blank("strand"))


def annotate(variants: DataFrame, features: DataFrame, upstream: int = 5000, pick: bool = False, ref_tiles: DataFrame | None = None,
             tile: int = TILE) -> DataFrame:
    """Variants with a ``CSQ`` entry in INFO. The entry lists the transcripts near a site, as the format requires."""
    keyed = variants.withColumn("_alts", F.array_join("alts", ","))
    alleles = keyed.select("contig", "pos", "ref", "_alts", F.explode("alts").alias("alt")).distinct()
    csq = consequences(alleles, features, upstream, ref_tiles=ref_tiles, tile=tile)
    if pick:
        csq = pick_consequence(csq)
    text = alleles.join(csq.withColumn("text", csq_text(ref_tiles is not None)).select("contig", "pos", "ref", "alt", "text"),
                        ["contig", "pos", "ref", "alt"])
    site = text.groupBy("contig", "pos", "ref", "_alts").agg(F.array_join(F.sort_array(F.collect_list("text")), ",").alias("_csq"))
    out = keyed.join(site, ["contig", "pos", "ref", "_alts"], "left")
    others = F.map_filter("info", lambda k, v: k != "CSQ")
    info = F.map_concat(others, F.create_map(F.lit("CSQ"), F.col("_csq")))
    return out.withColumn("info", F.when(F.col("_csq").isNull(), F.col("info")).otherwise(info)).select(*variants.columns)
