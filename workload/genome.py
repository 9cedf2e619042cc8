"""Alignment, post-processing, calling, annotation, ledger and whole runs."""
from pyspark.sql import functions as F

from strandlake.operators import (alignment, annotation, calling, coordinates, duplicates, filters, fragments, ledger, pileup, pipe,
                                  recalibration)
from strandlake.plans import germline as plans
from strandlake.sources import fastq, store, vcf
from workload import sql as s
from workload import tables as t
from workload.formats import DATED, HEADER_SQL, LEDGER, write_fasta
from workload.registry import query


# --- coordinates -----------------------------------------------------------------------------------------------------

@query("position_order", t.duck("""select n, frag, flags from (select row_number() over (order by contig nulls last, pos nulls last, frag, flags) - 1 as n, frag, flags
  from alignments)"""))
def position_order(spark, sf):
    """Each record with its place in the total order: partition sizes of the sorted output are added up."""
    contigs = coordinates.sequence_dictionary(t.ref_tiles(spark, sf), digest=False)
    rows = coordinates.sort_by_reference_position(t.alignments(spark, sf).select("frag", "flags", "contig", "pos"), contigs)
    stored = store.materialize(rows.withColumn("id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("id", 33)
    sizes = stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    from pyspark.sql import Window
    before = sizes.select("part", F.coalesce(F.sum("rows").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return stored.withColumn("part", part).join(before, "part").select(
        (F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("n"), "frag", "flags")


@query("contig_order", t.duck("""select frag, flags, case when contig = 'chr3' then null else contig_idx end as contig_idx from alignments
  left join (select contig as c, cast(row_number() over (order by contig) - 1 as int) as contig_idx from (select distinct contig from chunks)) on c = contig"""))
def contig_order(spark, sf):
    contigs = coordinates.sequence_dictionary(t.ref_tiles(spark, sf), digest=False).filter("contig <> 'chr3'")
    return coordinates.replace_sequences(t.alignments(spark, sf), contigs).select("frag", "flags", "contig_idx")


@query("unknown_contigs", t.duck("select contig, count(*) as records from alignments where contig in ('chr3', 'chr8') group by 1"))
def unknown_contigs(spark, sf):
    contigs = coordinates.sequence_dictionary(t.ref_tiles(spark, sf), digest=False).filter("contig not in ('chr3', 'chr8')")
    return coordinates.unknown_contigs(t.placements(spark, sf), contigs)


@query("reference_bases", t.duck("""select a.contig, a.pos, a.ref, substr(concat(c.bases, n.bases), cast((a.pos - 1) % 32 + 1 as int), 8) as found from variants a
  join chunks c on c.contig = a.contig and c.chunk = cast(floor((a.pos - 1) / 32) as bigint) join chunks n on n.k = c.k + 25"""))
def reference_bases(spark, sf):
    sites = t.variants(spark, sf).select("contig", "pos", "ref")
    return coordinates.attach_reference(sites, t.ref_tiles(spark, sf), ["pos"], length=8, name="found")


DEPTHS = "select contig, rp as pos, count(*) as depth from cells where rp is not null group by all"


@query("depth_of_coverage", t.duck(f"select contig, count(*) as positions, cast(sum(depth) as bigint) as bases, max(depth) as max_depth, "
                                   f"cast(sum(depth * (pos % 9973)) as bigint) as checksum from ({DEPTHS}) group by contig", more=s.cells("alignments")))
def depth_of_coverage(spark, sf):
    return coordinates.coverage(t.placements(spark, sf), tile=1024).groupBy("contig").agg(
        F.count(F.lit(1)).alias("positions"), F.sum("depth").alias("bases"), F.max("depth").alias("max_depth"),
        F.sum(F.col("depth") * (F.col("pos") % 9973)).alias("checksum"))


@query("depth_by_bin", t.duck(f"select contig, cast(floor((pos - 1) / 500) as bigint) as bin, cast(sum(depth) as bigint) as bases, max(depth) as max_depth, "
                              f"sum(depth) / 500 as mean_depth from ({DEPTHS}) group by all", more=s.cells("alignments")))
def depth_by_bin(spark, sf):
    return coordinates.coverage(t.placements(spark, sf), bin_size=500, tile=1024)


# --- duplicates and qualities ----------------------------------------------------------------------------------------

@query("duplicate_flags", t.duck("select sample, frag, flags, contig, pos from marked", more=s.marked()))
def duplicate_flags(spark, sf):
    return duplicates.mark_duplicates(t.alignments_once(spark, sf).select(*duplicates.MARKED_BY)).select("sample", "frag", "flags", "contig", "pos")


METRICS = """,
counted as (
  select sample, library, count(*) filter (where (flags & 4) = 0 and ((flags & 1) = 0 or (flags & 8) <> 0)) as unpaired_reads,
         count(*) filter (where (flags & 4) = 0 and (flags & 1) <> 0 and (flags & 8) = 0 and (flags & 64) <> 0) as read_pairs,
         count(*) filter (where (flags & 4) <> 0) as unmapped_reads,
         count(*) filter (where (flags & 4) = 0 and ((flags & 1) = 0 or (flags & 8) <> 0) and (flags & 1024) <> 0) as unpaired_duplicates,
         count(*) filter (where (flags & 4) = 0 and (flags & 1) <> 0 and (flags & 8) = 0 and (flags & 64) <> 0 and (flags & 1024) <> 0) as pair_duplicates
  from marked group by all
),
halving as (
  select sample, library, cast(read_pairs as double) as n, cast(read_pairs - pair_duplicates as double) as c,
         cast(read_pairs - pair_duplicates as double) as lo, (read_pairs - pair_duplicates) * 1e6 as hi, 0 as step from counted
  union all
  select sample, library, n, c, case when c / ((lo + hi) / 2) - 1 + exp(-n / ((lo + hi) / 2)) > 0 then (lo + hi) / 2 else lo end,
         case when c / ((lo + hi) / 2) - 1 + exp(-n / ((lo + hi) / 2)) > 0 then hi else (lo + hi) / 2 end, step + 1 from halving where step < 40
)"""


@query("duplicate_metrics", t.duck("""select k.*, round((unpaired_duplicates + 2 * pair_duplicates) / (unpaired_reads + 2 * read_pairs), 6) as duplicate_share,
  case when n > c then cast(round((lo + hi) / 2) as bigint) end as library_size from counted k join halving h on k.sample = h.sample and k.library = h.library and step = 40""",
                                   more=s.marked() + METRICS))
def duplicate_metrics(spark, sf):
    return duplicates.duplicate_metrics(duplicates.mark_duplicates(t.alignments(spark, sf).select(*duplicates.MARKED_BY)))


@query("unknown_site_bases", t.duck("""select a.contig, a.pos, a.ref from variants a where not exists (select 1 from snps s where s.contig = a.contig and s.pos = a.pos)"""))
def unknown_site_bases(spark, sf):
    return recalibration.mask_known_snps(t.variants(spark, sf).select("contig", "pos", "ref"), t.snps(spark, sf))


BASES = s.cells("alignments") + "," + s.covariates()


@query("covariate_table", t.duck("select * from cov", more=BASES))
def covariate_table(spark, sf):
    return recalibration.bqsr_table(t.alignments(spark, sf), t.ref_tiles(spark, sf), t.snps(spark, sf))


@query("recalibrated_qualities", t.duck("select sample, frag, flags, quals from recal", more=BASES + "," + s.recalibrated("alignments")))
def recalibrated_qualities(spark, sf):
    rows = recalibration.recalibrate_qualities(t.alignments(spark, sf), t.ref_tiles(spark, sf), t.snps(spark, sf))
    return rows.select("sample", "frag", "flags", "quals")


# --- calling ---------------------------------------------------------------------------------------------------------

PILED = s.cells("alignments") + "," + s.piled()
MEASURES = ["depth", "forward", "backward", "qual_sum", "mapq_sum", "ln_match", "ln_half", "ln_miss"]


@query("pileup_counts", t.duck("select sample, contig, case when length(allele) > 1 then left(allele, 1) else allele end as kind, count(*) as alleles, "
                               + ", ".join(f"cast(sum({m}) as bigint) as {m}" for m in MEASURES)
                               + ", cast(sum(depth * (pos % 9973)) as bigint) as checksum from piled group by all", more=PILED))
def pileup_counts(spark, sf):
    return pileup.pileup(t.alignments(spark, sf)).groupBy("sample", "contig", F.left("allele", F.lit(1)).alias("kind")).agg(
        F.count(F.lit(1)).alias("alleles"), *[F.sum(m).alias(m) for m in MEASURES],
        F.sum(F.col("depth") * (F.col("pos") % 9973)).alias("checksum"))


CALL_COLUMNS = ["sample", "contig", "pos", "ref", "alt", "qual", "gt", "dp", "ro", "ao", "qr", "qa", "pl", "gq", "saf", "sar", "srf", "srr", "mqm", "mqmr"]


def _text_pl(calls):
    return calls.withColumn("pl", F.array_join(F.transform("pl", lambda v: v.cast("string")), ",")).select(*CALL_COLUMNS)


@query("variant_calls", t.duck("select * from calls", more=PILED + "," + s.calls()))
def variant_calls(spark, sf):
    return _text_pl(calling.call_variants(pileup.pileup(t.alignments(spark, sf)), t.ref_tiles(spark, sf)))


BLOCKS = """,
uncalled as (
  select sample, contig, pos, dp, case when k = 0 then gq else 0 end as gq from judged_sites where not coalesce(k > 0 and a_depth >= 2 and alt_allele is not null, false)
),
quiet as (select *, case when gq < 20 then 0 when gq < 60 then 1 else 2 end as band from uncalled),
edges as (
  select *, case when pos = lag(pos) over w + 1 and band = lag(band) over w then 0 else 1 end as fresh from quiet window w as (partition by sample, contig order by pos)
),
numbered as (select *, sum(fresh) over (partition by sample, contig order by pos) as run from edges)"""


@query("nonvariant_blocks", t.duck("""select sample, contig, min(pos) as start, max(pos) as "end", cast(max(band) as int) as band, min(dp) as min_dp, cast(min(gq) as int) as min_gq
  from numbered group by sample, contig, run""", more=PILED + "," + s.sites() + BLOCKS))
def nonvariant_blocks(spark, sf):
    return calling.gvcf_blocks(pileup.pileup(t.alignments(spark, sf)), t.ref_tiles(spark, sf), block_tile=512)


@query("calls_written", t.duck("select sample, contig, pos, ref, alt, gt, dp, qual from (select *, max(qual) over (partition by contig, pos, ref, alt) as top from calls)"
                               .replace("dp, qual from", "dp, top as qual from"), more=PILED + "," + s.calls()))
def calls_written(spark, sf):
    """Calls written as VCF and read back, a row per genotype."""
    path, tiles = store.scratch_path(spark, "calls"), t.ref_tiles(spark, sf)
    calls = store.materialize(calling.call_variants(pileup.pileup(t.alignments(spark, sf)), tiles), "calls")
    vcf.write_vcf(calling.calls_to_variants(calls), calling.call_header(coordinates.sequence_dictionary(tiles, digest=False)), path)
    rows = vcf.read_vcf(spark, path)[0].select("contig", "pos", "ref", F.col("alts")[0].alias("alt"), "qual", F.explode("genotypes").alias("g"))
    return rows.filter(F.col("g.fields")["GT"] != ".").select(F.col("g.sample").alias("sample"), "contig", "pos", "ref", "alt", F.col("g.fields")["GT"].alias("gt"),
                                                             F.col("g.fields")["DP"].cast("bigint").alias("dp"), "qual")


@query("blocks_written", t.duck("""select sample, contig, min(pos) as start, max(pos) as "end", min(dp) as min_dp, cast(min(gq) as int) as min_gq
  from numbered group by sample, contig, run""", more=PILED + "," + s.sites() + BLOCKS))
def blocks_written(spark, sf):
    """Reference blocks written as VCF with END and MIN_DP, and read back."""
    path, tiles = store.scratch_path(spark, "blocks"), t.ref_tiles(spark, sf)
    blocks = store.materialize(calling.gvcf_blocks(pileup.pileup(t.alignments(spark, sf)), tiles, block_tile=512), "blocks")
    vcf.write_vcf(calling.blocks_to_variants(blocks, tiles), calling.call_header(coordinates.sequence_dictionary(tiles, digest=False)), path)
    rows = vcf.read_vcf(spark, path)[0].select("contig", F.col("pos").alias("start"), "end", F.explode("genotypes").alias("g"))
    cell = lambda k: F.try_element_at(F.col("g.fields"), F.lit(k))
    return rows.filter(cell("GT") == "0/0").select(F.col("g.sample").alias("sample"), "contig", "start", "end", cell("MIN_DP").cast("bigint").alias("min_dp"), cell("GQ").cast("int").alias("min_gq"))


# --- annotation ------------------------------------------------------------------------------------------------------

CSQ_COLUMNS = "contig, pos, ref, alt, allele, consequence, impact, symbol, gene, feature_type, feature, biotype, distance, strand"


def _split(spark, sf):
    return filters.split_alts(t.variants(spark, sf))


@query("consequences", t.duck(f"select {CSQ_COLUMNS} from csq", more=s.consequences(t.UPSTREAM)))
def consequences(spark, sf):
    return annotation.consequences(_split(spark, sf), t.features(spark, sf), t.UPSTREAM).select(*CSQ_COLUMNS.split(", "))


@query("coding_consequences", t.duck("""select contig, pos, ref, alt, transcript, term as consequence, cds_position, protein_position, amino_acids, codons from coding_terms""",
                                     more=s.alleles() + s.coding()))
def coding_consequences(spark, sf):
    """What the substitutions in coding segments do to the protein."""
    rows = annotation.consequences(_split(spark, sf), t.features(spark, sf), t.UPSTREAM, ref_tiles=t.ref_tiles(spark, sf))
    return rows.filter("cds_position is not null").select("contig", "pos", "ref", "alt", F.col("feature").alias("transcript"), "consequence", *annotation.CODING_FIELDS)


@query("picked_consequences", t.duck(f"""select {CSQ_COLUMNS} from (select *, row_number() over (partition by contig, pos, ref, alt
  order by severity, coalesce(distance, 0), feature) as r from csq) where r = 1""", more=s.consequences(t.UPSTREAM)))
def picked_consequences(spark, sf):
    return annotation.pick_consequence(annotation.consequences(_split(spark, sf), t.features(spark, sf), t.UPSTREAM)).select(*CSQ_COLUMNS.split(", "))


@query("annotated_variants", t.duck("""select v.contig, v.pos, v.ref, v.alt as alts, string_agg(concat_ws('|', allele, consequence, impact, coalesce(symbol, ''), coalesce(gene, ''),
    coalesce(feature_type, ''), coalesce(feature, ''), coalesce(biotype, ''), '', '', '', '', '', '', '', '', '', '', coalesce(cast(distance as varchar), ''), coalesce(cast(c.strand as varchar), '')), ','
    order by concat_ws('|', allele, consequence, impact, coalesce(symbol, ''), coalesce(gene, ''), coalesce(feature_type, ''), coalesce(feature, ''))) as csq
  from variants v join csq c on v.contig = c.contig and v.pos = c.pos and v.ref = c.ref and list_contains(string_split(v.alt, ','), c.alt) group by v.pk, v.contig, v.pos, v.ref, v.alt""",
                                    more=s.consequences(t.UPSTREAM)))
def annotated_variants(spark, sf):
    return annotation.annotate(t.variants(spark, sf), t.features(spark, sf), t.UPSTREAM).select(
        "contig", "pos", "ref", F.array_join("alts", ",").alias("alts"), F.element_at("info", "CSQ").alias("csq"))


# --- alignment -------------------------------------------------------------------------------------------------------

@query("kmer_positions", t.duck("""select contig, fwd, count(*) as n, cast(sum(pos) as bigint) as pos_sum, cast(sum((pos % 9973) * ascii(md5(kmer))) as bigint) as checksum
  from (select contig, chunk * 32 + i + 1 as pos, f as kmer, u as fwd from (
    select *, least(f0, r0) as f, unnest(case when f0 = r0 then [true, false] else [f0 < r0] end) as u from (
      select c.contig, c.chunk, i, substr(concat(c.bases, n.bases), cast(i + 1 as int), 16) as f0,
             reverse(translate(substr(concat(c.bases, n.bases), cast(i + 1 as int), 16), 'ACGT', 'TGCA')) as r0
      from chunks c left join chunks n on n.k = c.k + 25 cross join (select unnest(generate_series(0, 31)) as i)) where length(f0) = 16)) group by all"""))
def kmer_positions(spark, sf):
    index = alignment.build_kmer_index(t.ref_tiles(spark, sf))
    return index.groupBy("contig", "fwd").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"), F.sum((F.col("pos") % 9973) * F.ascii(F.md5("kmer"))).alias("checksum"))


PLACED_COLUMNS = ["sample", "frag", "flags", "contig", "pos", "end", "mapq", "cigar", "bases", "quals", "nm"]


@query("read_placements", t.duck("select sample, frag, flags, contig, pos, \"end\", mapq, cigar, bases, quals, nm from placed", gapped=False, more=s.placed()))
def read_placements(spark, sf):
    from strandlake.functions.fields import tag
    tiles = t.ref_tiles(spark, sf)
    index = store.materialize(alignment.build_kmer_index(tiles), "kmer-index")
    rows = alignment.align_seed_extend(t.reads(spark, sf, gapped=False), index, tiles)
    return rows.withColumn("nm", tag(F.col("tags"), "NM", "int")).select(*PLACED_COLUMNS)


@query("mate_fields", t.duck("""select a.sample, a.frag, a.flags, b.contig as mate_contig, b.pos as mate_pos,
  case when (a.flags & 4) = 0 and (b.flags & 4) = 0 then (greatest(a."end", b."end") - least(a.pos, b.pos) + 1) * (case when a.pos < b.pos then 1 else -1 end) else 0 end as tlen,
  case when (b.flags & 4) = 0 then b.cigar end as mc from alignments a left join alignments b on a.sample = b.sample and a.frag = b.frag and a.flags <> b.flags"""))
def mate_fields(spark, sf):
    from strandlake.functions.fields import tag
    return fragments.mate_info(t.alignments(spark, sf)).select(
        "sample", "frag", "flags", "mate_contig", "mate_pos", "tlen", tag(F.col("tags"), "MC").alias("mc"))


# --- ledger ----------------------------------------------------------------------------------------------------------

def _day(df):
    return df.withColumn("execution_date", F.date_format("execution_date", "yyyy-MM-dd HH:mm:ss"))


@query("run_statistics", t.duck("""select task_id, executor_cores, executor_memory, driver_memory, state, count(*) as runs, round(avg(duration), 6) as avg_duration,
  min(duration) as min_duration, max(duration) as max_duration from runs group by all"""))
def run_statistics(spark, sf):
    return ledger.run_stats(t.runs(spark, sf))


@query("latest_runs", t.duck(f"""select task_id, dag_id, {DATED}, executor_cores, executor_memory, driver_memory, duration, state from (
  select *, row_number() over (partition by task_id, dag_id, execution_date order by recorded_at desc) as r from runs) where r = 1"""))
def latest_runs(spark, sf):
    return _day(ledger.latest_runs(t.runs(spark, sf).select(*LEDGER))).drop("recorded_at")


@query("run_collection", t.duck("""select dag_id, task_id, host, executor_cores, executor_memory, duration, state from runs join (values ('yarn', 'yarn-master'), ('k8s', 'k8s://cluster'),
  ('local', 'local[*]')) c(id, host) on id = case when conn_id = 'spark_default' then 'yarn' else conn_id end"""))
def run_collection(spark, sf):
    runs = t.runs(spark, sf).withColumn("execution_date", F.col("recorded_at"))
    hosts = spark.createDataFrame([("yarn", "yarn-master"), ("k8s", "k8s://cluster"), ("local", "local[*]")], "conn_id string, host string")
    submissions = runs.select("task_id", "dag_id", "execution_date", "conn_id", "executor_cores", "executor_memory")
    return ledger.collect_run(submissions, runs, hosts).select("dag_id", "task_id", "host", "executor_cores", "executor_memory", "duration", "state")


# --- pipes -----------------------------------------------------------------------------------------------------------

UNPLACED = r"""awk 'NR % 4 == 1 { n = substr($1, 2); sub(/\/[12]$/, "", n) } NR % 4 == 2 { b = $0 }
      NR % 4 == 0 { printf "%s\t4\t*\t0\t0\t*\t*\t0\t0\t%s\t%s\n", n, b, $0 }'"""


@query("piped_reads", t.duck("select frag, 4 as flags, bases, quals from reads"))
def piped_reads(spark, sf):
    """Fragments through a command that turns every FASTQ record into an unplaced SAM record."""
    return pipe.pipe_reads(fragments.to_fragments(t.reads(spark, sf)), UNPLACED).select("frag", "flags", "bases", "quals")


@query("piped_read_groups", t.duck("select sample, concat('g ', sample) as rg_id, 'l|' as library, frag, bases from reads"))
def piped_read_groups(spark, sf):
    """Sample, read group and library of reads after they went through a command."""
    reads = t.reads(spark, sf).withColumn("rg_id", F.concat(F.lit("g "), "sample")).withColumn("library", F.lit("l|"))
    return pipe.pipe_reads(reads, UNPLACED).select("sample", "rg_id", "library", "frag", "bases")


@query("piped_variants", t.duck("select contig, pos, ref, alt as alts, filter as filters, info from variants where filter = 'PASS'"))
def piped_variants(spark, sf):
    """Sites through a command that keeps the header and the records that passed."""
    from strandlake.sources.vcf import format_info
    from workload.formats import vcf_header
    out = pipe.pipe_variants(t.variants(spark, sf), r"""awk -F '\t' '/^#/ || $7 == "PASS"'""", vcf_header(spark, sf), t.SAMPLES)
    return out.select("contig", "pos", "ref", F.array_join("alts", ",").alias("alts"), F.array_join("filters", ";").alias("filters"),
                      format_info(F.col("info")).alias("info"))


NOTED = r"""awk -F '\t' -v OFS='\t' '/^#CHROM/ { print "##INFO=<ID=CSQ,Number=.,Type=String,Description=\"Consequences\">" }
  /^#/ { print; next } { $8 = ($8 == "." ? "" : $8 ";") "CSQ=" $4 ">" $5; print }'"""


@query("piped_header", t.duck(HEADER_SQL + " union all select 'INFO', 'CSQ', '.', 'String', 'Consequences', null"))
def piped_header(spark, sf):
    """The header after a command that declares a field of its own."""
    from workload.formats import vcf_header
    return pipe.pipe_variants_and_header(t.variants(spark, sf), NOTED, vcf_header(spark, sf), t.SAMPLES)[1].drop("ord")


@query("piped_notes", t.duck("select contig, pos, ref, alt as alts, concat(ref, '>', alt) as note, g1 from variants"))
def piped_notes(spark, sf):
    """The field that a command adds to every site, and the first sample's genotype behind it."""
    from workload.formats import vcf_header
    out = pipe.pipe_variants_and_header(t.variants(spark, sf), NOTED, vcf_header(spark, sf), t.SAMPLES)[0]
    first = F.col("genotypes")[0]["fields"]
    return out.select("contig", "pos", "ref", F.array_join("alts", ",").alias("alts"), F.element_at("info", "CSQ").alias("note"),
                      F.concat_ws(":", *[F.element_at(first, k) for k in ("GT", "AD", "DP", "GQ", "PL")]).alias("g1"))


# --- whole runs ------------------------------------------------------------------------------------------------------

FINISHED = s.marked() + "," + s.cells("marked") + "," + s.covariates() + "," + s.recalibrated("marked")
FINISHED_COLUMNS = ["sample", "frag", "flags", "contig", "pos", "cigar", "bases", "quals"]
FINISHED_SQL = f"select {', '.join(FINISHED_COLUMNS)} from recal"


@query("finished_alignments", t.duck(FINISHED_SQL, more=FINISHED))
def finished_alignments(spark, sf):
    return plans.finish_alignment(t.alignments_once(spark, sf), t.ref_tiles(spark, sf), t.snps(spark, sf),
                                  intermediate=store.scratch_path(spark, "run")).select(*FINISHED_COLUMNS)


def _run(paired: bool) -> str:
    return s.placed(paired) + "," + s.marked("placed") + "," + s.cells("marked") + "," + s.covariates() + "," + s.recalibrated("marked")


def _sampled(spark, sf):
    """Reads under one sample name, as a single file would give them."""
    return t.reads(spark, sf, gapped=False).withColumn("sample", F.lit("S"))


ONE_SAMPLE = "sequenced as (select * replace ('S' as sample) from sequenced_by_sample)"


def _one_sample(select: str, more: str) -> str:
    """The same SQL with every read under sample S."""
    text = t.duck(select, gapped=False, more=more)
    return text.replace("\nsequenced as (\n", "\nsequenced_by_sample as (\n", 1).replace("\nalignments as (\n", f"\n{ONE_SAMPLE},\nalignments as (\n", 1)


@query("single_end_run", _one_sample(FINISHED_SQL, _run(False)))
def single_end_run(spark, sf):
    reads = _sampled(spark, sf)
    single = reads.withColumn("frag", F.concat("frag", F.lit("_"), F.greatest(F.col("mate"), F.lit(1)).cast("string"))).withColumn("mate", F.lit(0))
    path = store.scratch_path(spark, "single")
    fastq.write_fastq(single, path, compression="gzip")
    return plans.align_and_finish(fastq.read_fastq(spark, path, "S"), t.ref_tiles(spark, sf), t.snps(spark, sf)).select(*FINISHED_COLUMNS)


def _pairs_sql(select: str, more: str) -> str:
    """The same with templates of two reads only: a pair file holds no lone reads."""
    return _one_sample(select, more).replace("from sequenced_by_sample)", "from sequenced_by_sample where not single)", 1)


@query("interleaved_run", _pairs_sql(FINISHED_SQL, _run(True)))
def interleaved_run(spark, sf):
    path = store.scratch_path(spark, "pairs")
    fastq.write_interleaved_fastq(fragments.to_fragments(_sampled(spark, sf).filter("mate > 0")), path, compression="gzip")
    rows = fastq.read_interleaved_fastq(spark, path, "S")
    return plans.align_and_finish(rows, t.ref_tiles(spark, sf), t.snps(spark, sf)).select(*FINISHED_COLUMNS)


@query("paired_run", _pairs_sql(FINISHED_SQL, _run(True)))
def paired_run(spark, sf):
    pairs = _sampled(spark, sf).filter("mate > 0").orderBy("frag")
    paths = [store.scratch_path(spark, f"pair_{m}") for m in (1, 2)]
    for mate, path in zip((1, 2), paths):
        fastq.write_fastq(pairs.filter(F.col("mate") == mate), path, compression="gzip")
    rows = fragments.interleave(*[fastq.read_fastq(spark, p, "S") for p in paths])
    return plans.align_and_finish(rows, t.ref_tiles(spark, sf), t.snps(spark, sf)).select(*FINISHED_COLUMNS)


@query("germline_calls", t.duck("select * from calls", gapped=False,
                                more=_run(True).replace("cells as (", "marked_cells as (", 1).replace("from cells c left join snps", "from marked_cells c left join snps", 1)
                                .replace("from cells where (flags & 4) = 0", "from marked_cells where (flags & 4) = 0", 1)
                                + "," + s.cells("recal") + "," + s.piled() + "," + s.calls()))
def germline_calls(spark, sf):
    """Reads to called sites, all samples in one plan."""
    tiles = t.ref_tiles(spark, sf)
    done = plans.align_and_finish(fragments.to_fragments(t.reads(spark, sf, gapped=False)), tiles, t.snps(spark, sf))
    return _text_pl(calling.call_variants(pileup.pileup(done), tiles))
