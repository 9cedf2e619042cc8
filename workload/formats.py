"""Sources and sinks: every query writes the derived rows in a format and reads them back."""
from pyspark.sql import functions as F

from strandlake.functions.fields import info_value
from strandlake.operators import coordinates, fragments, ledger
from strandlake.sources import fasta, fastq, sam, samples, store, vcf
from strandlake.streaming.ingest import ingest_incremental
from workload import tables as t
from workload.registry import query

READ_ROWS = "select sample, frag, mate, bases, quals from reads"


@query("fastq_reads", t.duck("select frag, mate, bases, quals from reads"))
def fastq_reads(spark, sf):
    path = store.scratch_path(spark, "fastq")
    fastq.write_fastq(t.streamed(spark, sf, "reads"), path, compression="gzip")
    return fastq.read_fastq(spark, path, "all").select("frag", "mate", "bases", "quals")


PAIRS = """select a.sample, a.frag, a.bases as bases1, a.quals as quals1, b.bases as bases2, b.quals as quals2
from reads a join reads b on a.sample = b.sample and a.frag = b.frag and a.mate = 1 and b.mate = 2"""


def _pairs(df):
    r = lambda i, c: F.col("reads")[i][c]
    return df.select("sample", "frag", r(0, "bases").alias("bases1"), r(0, "quals").alias("quals1"),
                     r(1, "bases").alias("bases2"), r(1, "quals").alias("quals2"))


@query("fastq_interleaved", t.duck(PAIRS.replace("a.sample, ", "", 1)))
def fastq_interleaved(spark, sf):
    path = store.scratch_path(spark, "interleaved")
    pairs = fragments.to_fragments(t.streamed(spark, sf, "reads").filter("mate > 0"))
    fastq.write_interleaved_fastq(pairs, path, compression="gzip")
    return _pairs(fastq.read_interleaved_fastq(spark, path)).drop("sample")


@query("fragments_loaded", t.duck("select frag, bases, quals from reads"))
def fragments_loaded(spark, sf):
    """The generic loader on SAM text: reads come back in sequencing order."""
    path = store.scratch_path(spark, "fragments") + ".sam"
    contigs = coordinates.sequence_dictionary(t.ref_tiles(spark, sf), digest=False)
    sam.write_sam(t.alignments(spark, sf), contigs, path, compression="gzip")
    return fragments.explode_fragments(fastq.load_fragments(spark, path)).select("frag", "bases", "quals")


def write_fasta(spark, sf, path):
    """The genome as FASTA text: a header per contig, then its 32-base lines in order."""
    chunks = t.table(spark, sf, "chunks")
    head = chunks.select("contig").distinct().select(
        "contig", F.lit(-1).cast("long").alias("chunk"), F.concat(F.lit(">"), "contig", F.lit("\tderived")).alias("value"))
    lines = chunks.select("contig", "chunk", F.col("bases").alias("value")).unionByName(head)
    lines.orderBy("contig", "chunk").select("value").write.mode("overwrite").text(path)


@query("fasta_tiles", t.duck("""select contig, cast(floor((chunk * 32) / 4096) as bigint) as tile,
  cast(floor((chunk * 32) / 4096) * 4096 + 1 as bigint) as start, string_agg(bases, '' order by chunk) as bases from chunks group by all"""))
def fasta_tiles(spark, sf):
    path = store.scratch_path(spark, "fasta")
    write_fasta(spark, sf, path)
    return fasta.read_fasta(spark, path, tile=4096, overlap=1024).select(
        "contig", "tile", "start", F.substring("bases", 1, 4096).alias("bases"))


CONTIGS = """select contig, cast(count(*) * 32 as bigint) as length, cast(row_number() over (order by contig) - 1 as int) as idx,
  md5(string_agg(bases, '' order by chunk)) as md5 from chunks group by contig"""


@query("contig_dictionary", t.duck(CONTIGS))
def contig_dictionary(spark, sf):
    return coordinates.sequence_dictionary(t.ref_tiles(spark, sf))


@query("sam_dictionary", t.duck(CONTIGS))
def sam_dictionary(spark, sf):
    path = store.scratch_path(spark, "dictionary")
    contigs = coordinates.sequence_dictionary(t.ref_tiles(spark, sf))
    sam.write_sam(t.alignments(spark, sf), contigs, path, compression="gzip")
    return sam.read_sequence_dictionary(spark, path)


SAM_ROWS = ["sample", "rg_id", "library", "frag", "flags", "contig", "pos", "end", "mapq", "cigar", "bases", "quals"]


@query("sam_records", t.duck("""select sample, rg_id, library, frag, flags, contig, pos, "end", mapq, cigar, bases, quals from alignments"""))
def sam_records(spark, sf):
    path = store.scratch_path(spark, "sam")
    contigs = coordinates.sequence_dictionary(t.ref_tiles(spark, sf), digest=False)
    sam.write_sam(t.alignments(spark, sf), contigs, path, compression="gzip")
    return sam.read_sam(spark, path).select(*SAM_ROWS)


@query("sam_text", t.duck("""select concat_ws(chr(9), frag, flags, coalesce(contig, '*'), coalesce(pos, 0), mapq, cigar, '*', 0, 0, bases, quals,
  concat('RG:Z:', rg_id)) as line from alignments"""))
def sam_text(spark, sf):
    """Record lines of the written SAM text."""
    path = store.scratch_path(spark, "sam")
    contigs = coordinates.sequence_dictionary(t.ref_tiles(spark, sf), digest=False)
    sam.write_sam(t.alignments(spark, sf), contigs, path, compression="gzip")
    return spark.read.text(path).filter(~F.col("value").startswith("@")).select(F.col("value").alias("line"))


HEADER = [("INFO", "DP", "1", "Integer", "Depth"), ("INFO", "AF", "A", "Float", "Allele frequency"),
          ("INFO", "BRAND", "1", "String", "Brand"), ("INFO", "DB", "0", "Flag", "Known site"),
          ("FORMAT", "GT", "1", "String", "Genotype"), ("FORMAT", "AD", ".", "Integer", "Allelic depths"),
          ("FORMAT", "DP", "1", "Integer", "Depth"), ("FORMAT", "GQ", "1", "Integer", "Quality"),
          ("FORMAT", "PL", "G", "Integer", "Likelihoods"), ("FILTER", "LowQual", None, None, "Low quality")]


def vcf_header(spark, sf):
    """Fixed field declarations and one contig line per contig of the genome."""
    fixed = spark.createDataFrame([(*row, None, i) for i, row in enumerate(HEADER)],
                                  "kind string, id string, number string, type string, description string, length long, ord long")
    contigs = coordinates.sequence_dictionary(t.ref_tiles(spark, sf), digest=False)
    none = F.lit(None).cast("string")
    return fixed.unionByName(contigs.select(
        F.lit("contig").alias("kind"), F.col("contig").alias("id"), none.alias("number"), none.alias("type"), none.alias("description"),
        "length", (F.col("idx") + len(HEADER)).cast("long").alias("ord")))


def written_vcf(spark, sf):
    path = store.scratch_path(spark, "vcf")
    vcf.write_vcf(t.variants(spark, sf), vcf_header(spark, sf), path, t.SAMPLES)
    return path


@query("vcf_sites", t.duck("""select contig, pos, pos + length(ref) - 1 as "end", case when id = '.' then '' else id end as ids, ref, alt as alts,
  try_cast(qual as double) as qual, filter as filters, info, regexp_extract(g1, '^[^:]*') as gt1, g2 as cell2 from variants"""))
def vcf_sites(spark, sf):
    rows, _ = vcf.read_vcf(spark, written_vcf(spark, sf))
    cell = lambda i, key: F.element_at(F.col("genotypes")[i]["fields"], key)
    return rows.select(
        "contig", "pos", "end", F.array_join("ids", ";").alias("ids"), "ref", F.array_join("alts", ",").alias("alts"), "qual",
        F.array_join("filters", ";").alias("filters"), vcf.format_info(F.col("info")).alias("info"), cell(0, "GT").alias("gt1"),
        F.concat_ws(":", *[cell(1, k) for k in ("GT", "AD", "DP", "GQ", "PL")]).alias("cell2"))


HEADER_SQL = ("select * from (values " + ", ".join(
    "(" + ", ".join("null" if v is None else f"'{v}'" for v in (k, i, "R" if i == "AD" else n, ty, d)) + ", null)"
    for k, i, n, ty, d in HEADER) + ") v(kind, id, number, type, description, length)"
    " union all select 'contig', contig, null, null, null, count(*) * 32 from chunks group by contig")


@query("vcf_header_fields", t.duck(HEADER_SQL))
def vcf_header_fields(spark, sf):
    _, header = vcf.read_vcf(spark, written_vcf(spark, sf))
    return header.drop("ord")


@query("vcf_text", t.duck("""select concat_ws(chr(9), contig, pos, id, ref, alt, qual, filter, info, 'GT:AD:DP:GQ:PL', g1, g2) as line from variants"""))
def vcf_text(spark, sf):
    """Record lines of the written VCF text."""
    return spark.read.text(written_vcf(spark, sf)).filter(~F.col("value").startswith("#")).select(F.col("value").alias("line"))


REGION = ("chr7", 500, 9_000)
REGION_SQL = f"""select frag, flags, pos, "end" from alignments where contig = '{REGION[0]}' and pos <= {REGION[2]} and "end" >= {REGION[1]}"""


@query("region_store", t.duck(REGION_SQL))
def region_store(spark, sf):
    path = store.scratch_path(spark, "region")
    store.write_genomic_parquet(t.alignments(spark, sf), path, bin_size=4096)
    return store.read_region(spark, path, *REGION).select("frag", "flags", "pos", "end")


@query("region_filter", t.duck(REGION_SQL))
def region_filter(spark, sf):
    return store.region(t.placements(spark, sf), *REGION).select("frag", "flags", "pos", "end")


FILE_NAMES = """concat('/data/', sample, '/', frag, case when mate = 0 then '.fastq' when substr(md5(frag), 1, 1) < '8' then concat('_', mate, '.fq')
  else concat('_', mate, '.fastq') end)"""


@query("sample_manifest", t.duck(f"""select sample_id, layout, string_agg(path, ',' order by path) as files from (
  select frag as sample_id, case when mate = 0 then 'single' else 'paired' end as layout, {FILE_NAMES} as path from reads) group by all"""))
def sample_manifest(spark, sf):
    """Sample ids and layouts of one file name per read."""
    paths = t.reads(spark, sf).select(F.expr(FILE_NAMES).alias("path"))
    return samples.manifest(paths).select("sample_id", "layout", F.array_join("files", ",").alias("files"))


@query("incremental_ingest", t.duck("select frag, mate, bases, quals from reads"))
def incremental_ingest(spark, sf):
    """Two rounds: half of the files are there at first, the rest arrive later and only they are loaded."""
    work = store.scratch_path(spark, "ingest")
    rows = t.reads(spark, sf)
    for first in (True, False):
        fastq.write_fastq(rows.filter((F.col("mate") == 1) == first), f"{work}/files/{'a' if first else 'b'}", compression="gzip")
        loaded = ingest_incremental(spark, f"{work}/files/*", f"{work}/bronze", f"{work}/checkpoint", pattern="*.txt.gz", files_per_batch=16)
    return loaded.select("frag", "mate", "bases", "quals")


@query("stage_checkpoint", t.duck("select library, count(*) as records, cast(sum(mapq) as bigint) as mapq_sum from alignments group by all"))
def stage_checkpoint(spark, sf):
    staged = store.checkpoint_stage(t.alignments(spark, sf), store.scratch_path(spark, "stage"))
    return staged.groupBy("library").agg(F.count(F.lit(1)).alias("records"), F.sum("mapq").alias("mapq_sum"))


LEDGER = ["task_id", "dag_id", "execution_date", "executor_cores", "executor_memory", "driver_memory", "duration", "state", "recorded_at"]
DATED = "strftime(execution_date, '%Y-%m-%d %H:%M:%S') as execution_date"


@query("ledger_append", t.duck(f"select task_id, dag_id, {DATED}, executor_cores, executor_memory, duration, state from runs"))
def ledger_append(spark, sf):
    path = store.scratch_path(spark, "ledger")
    rows = t.runs(spark, sf)
    for failed in (False, True):
        ledger.append_run_record(spark, path, rows.filter((F.col("state") == "failed") == failed).select(*LEDGER))
    return spark.read.parquet(path).select(
        "task_id", "dag_id", F.date_format("execution_date", "yyyy-MM-dd HH:mm:ss").alias("execution_date"), "executor_cores",
        "executor_memory", "duration", "state")


@query("text_lines_by_file", t.duck("select sample, count(*) as lines, cast(sum(length(bases)) as bigint) as characters from reads group by all"))
def text_lines_by_file(spark, sf):
    """One glob over many files, with the origin of each line."""
    path = store.scratch_path(spark, "text")
    t.reads(spark, sf).select("sample", "bases").write.partitionBy("sample").text(path)
    return store.read_many(spark, f"{path}/*/*.txt").groupBy(
        F.regexp_extract("source_file", "sample=([^/]+)", 1).alias("sample")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("characters"))


@query("info_fields", t.duck("""select contig, pos, ref, alt as alts, size as dp, cast(0.5 as double) as af, brand, case when size % 2 = 0 then true end as db,
  case when size % 5 = 2 then 2 else 1 end as n_af from variants v join (select p_partkey as k, p_size as size, p_brand as brand from part) on pk = k"""))
def info_fields(spark, sf):
    info = F.col("info")
    return t.variants(spark, sf).select(
        "contig", "pos", "ref", F.array_join("alts", ",").alias("alts"), info_value(info, "DP", "Integer").alias("dp"),
        info_value(info, "AF", "Float").alias("af"), info_value(info, "BRAND").alias("brand"), info_value(info, "DB", "Flag").alias("db"),
        F.size(info_value(info, "AF", "Float", first=False)).alias("n_af"))
