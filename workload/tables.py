"""Sequencing tables derived from the given TPC-H-like tables.

The same SQL text runs in Spark and in DuckDB; for reads and alignments Spark works on batches instead, with the same rows. Every table grows with its source: the genome with ``orders`` (32 bases per
order on 25 contigs), reads and alignments with ``lineitem`` (two mates per row), variants with ``part``, gene features with
``supplier`` and run records with ``events``. Depth and density therefore stay the same at every scale factor.
"""
from functools import lru_cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources.fasta import tiles_from_pieces
from strandlake.sources.store import STORED_AS, scratch_path, shuffles_removed
from strandlake.sources.vcf import parse_vcf
from workload import sequencer

SOURCES = ["orders", "lineitem", "part", "supplier", "events"]
READ_LENGTH = 50
UPSTREAM = 300  # contigs are short, so the annotation window is too
SAMPLES = ["P1", "P2"]


def dna(x: str) -> str:
    return f"translate(md5(cast({x} as string)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def div(a: str, b: int) -> str:
    return f"cast(floor(({a}) / {b}) as bigint)"


def digit(h: str, i: int) -> str:
    return f"substr({h}, {i}, 1)"


def _haplotype(d: str, hv: str) -> str:
    """Chunk ``d`` as carried by haplotype ``hap``: one chunk in 16 holds a variant site, half of them homozygous."""
    at = site_offset(hv)
    return (f"case when {digit(hv, 1)} = '7' and (hap = 1 or {digit(hv, 4)} < '8') then concat(left({d}, {at}), "
            f"translate(substr({d}, {at} + 1, 1), 'ACGT', 'CGTA'), substr({d}, {at} + 2)) else {d} end")


def site_offset(hv: str) -> str:
    return f"((ascii({digit(hv, 2)}) * 3 + ascii({digit(hv, 3)})) % 32)"


REVCOMP = "reverse(translate({0}, 'ACGTN', 'TGCAN'))"


def ctes(gapped: bool = True) -> str:
    """Named subqueries; ``{orders}`` and the like are filled in by the engine. ``gapped`` adds indels and clips."""
    if gapped:
        cigar = ("case when substr(hm, 6, 2) = 'ab' then '20M1D30M' when substr(hm, 6, 2) = 'cd' then '25M1I24M' "
                 "when substr(hm, 6, 1) = '5' then '5S45M' else '50M' end")
    else:
        cigar = "'50M'"
    return f"""
chunk_keys as (
  select cast(o_orderkey as bigint) as k from {{orders}}
  union all
  select m + r.i as k from (select max(o_orderkey) as m from {{orders}}) t cross join range(1, 251) as r(i)
),
chunks as (
  select k, concat('chr', k % 25) as contig, {div('k', 25)} as chunk, {dna('k')} as bases, md5(concat('v', k)) as hv
  from chunk_keys
),
snps as (
  select contig, chunk * 32 + {site_offset('hv')} + 1 as pos from chunks where {digit('hv', 1)} = '7'
),
fragment_keys as (
  select concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as frag,
         concat('S_', l_linestatus) as sample, l_returnflag as library, cast(l_orderkey as bigint) as k,
         cast((l_partkey * 7 + l_suppkey) % 8 as bigint) as o1
  from {{lineitem}}
),
hashed as (
  select *, md5(frag) as h, md5(concat(frag, '/2')) as h2, case when {digit('md5(frag)', 8)} < '8' then 0 else 1 end as hap
  from fragment_keys
),
mates as (
  select frag, sample, library, k, h, hap, 1 as mate, o1 as g, h as hm,
         {digit('h', 1)} = '0' as single, {digit('h', 1)} = '1' as half, false as unmapped
  from hashed
  union all
  select frag, sample, library, k, h, hap, 2 as mate, o1 + 150 + ascii({digit('h', 2)}) % 4 as g, h2 as hm,
         false as single, {digit('h', 1)} = '1' as half, {digit('h', 1)} = '1' as unmapped
  from hashed where {digit('h', 1)} <> '0'
),
windows as (
  select frag, sample, library, mate, hm, hap, single, half, unmapped, concat('chr', k % 25) as place,
         {div('k', 25)} * 32 + g + 1 as p, g % 32 as off, {dna(f"k + 25 * {div('g', 32)}")} as d0,
         {dna(f"k + 25 * ({div('g', 32)} + 1)")} as d1, {dna(f"k + 25 * ({div('g', 32)} + 2)")} as d2,
         md5(concat('v', k + 25 * {div('g', 32)})) as v0, md5(concat('v', k + 25 * ({div('g', 32)} + 1))) as v1,
         md5(concat('v', k + 25 * ({div('g', 32)} + 2))) as v2
  from mates
),
carried as (
  select frag, sample, library, mate, hm, single, half, unmapped, place, p, {cigar} as cigar,
         substr(concat({_haplotype('d0', 'v0')}, {_haplotype('d1', 'v1')}, {_haplotype('d2', 'v2')}), cast(off + 1 as int), 51) as w,
         substr(concat(d0, d1, d2), cast(off + 1 as int), 51) as truth
  from windows
),
templates as (
  select *, case cigar when '20M1D30M' then concat(substr(w, 1, 20), substr(w, 22, 30))
                       when '25M1I24M' then concat(substr(w, 1, 25), 'A', substr(w, 26, 24))
                       when '5S45M' then concat(substr(reverse(w), 1, 5), substr(w, 1, 45)) else substr(w, 1, 50) end as t
  from carried
),
erred as (
  select *, (ascii({digit('hm', 4)}) * 3 + ascii({digit('hm', 5)})) % 50 as e from templates
),
sequenced as (
  select frag, sample, library, mate, hm, single, half, unmapped, place, p, cigar, truth,
         case when unmapped then substr(concat({dna('frag')}, {dna("concat(frag, '/x')")}), 1, 50)
              when substr(hm, 9, 2) = '00' then concat(substr(t, 1, 9), 'N', substr(t, 11))
              when {digit('hm', 3)} = '7' then concat(substr(t, 1, e), translate(substr(t, e + 1, 1), 'ACGT', 'GTAC'), substr(t, e + 2))
              else t end as bases,
         translate(concat(hm, substr(hm, 1, 18)), '0123456789abcdef', '#+05:>?@ABCDEFGH') as quals
  from erred
),
alignments as (
  select sample, concat(sample, '_', library) as rg_id, library, frag,
         cast(case when single then 0 when unmapped then 133 when half then 73 when mate = 1 then 99 else 147 end as int) as flags,
         case when unmapped then null else place end as contig, case when unmapped then null else p end as pos,
         case when unmapped then null else p + case cigar when '20M1D30M' then 50 when '25M1I24M' then 48 when '5S45M' then 44 else 49 end end as "end",
         cast(case when unmapped then 0 when {digit('hm', 7)} = '3' then 20 when {digit('hm', 7)} = '4' then 255 else 60 end as int) as mapq,
         case when unmapped then '*' else cigar end as cigar, bases, quals, truth
  from sequenced
),
reads as (
  select sample, frag, cast(case when single then 0 else mate end as int) as mate,
         case when mate = 2 and not unmapped then {REVCOMP.format('bases')} else bases end as bases,
         case when mate = 2 and not unmapped then reverse(quals) else quals end as quals
  from sequenced
),
sites as (
  select p_partkey as pk, concat('chr', p_partkey % 25) as contig, {div('p_partkey', 25)} * 240 + (p_partkey * 13) % 200 + 1 as pos,
         p_size as size, p_brand as brand, cast(round(p_retailprice * 100) as bigint) as cents
  from {{part}}
),
site_bases as (
  select *, substr(concat({dna(f"{div('pos - 1', 32)} * 25 + pk % 25")}, {dna(f"({div('pos - 1', 32)} + 1) * 25 + pk % 25")}),
                   cast((pos - 1) % 32 + 1 as int), 3) as b
  from sites
),
variants as (
  select pk, contig, pos, case when pk % 4 = 0 then concat('rs', pk) else '.' end as id,
         case when size % 5 = 0 then b else left(b, 1) end as ref,
         case size % 5 when 0 then left(b, 1) when 1 then concat(left(b, 1), 'TT')
              when 2 then concat(translate(left(b, 1), 'ACGT', 'CGTA'), ',', translate(left(b, 1), 'ACGT', 'GTAC'))
              else translate(left(b, 1), 'ACGT', 'CGTA') end as alt,
         case when size = 50 then '.' else concat({div('cents', 100)}, '.', lpad(cast(cents % 100 as string), 2, '0')) end as qual,
         case when size % 7 = 0 then 'LowQual' else 'PASS' end as filter,
         concat('DP=', size, case when size % 5 = 2 then ';AF=0.5,0.25' else ';AF=0.5' end, ';BRAND=', brand,
                case when size % 2 = 0 then ';DB' else '' end) as info,
         case when size % 5 = 2 then concat('1/2:', size, ',', pk % 30, ',7:', size + pk % 30 + 7, ':50:90,80,70,60,50,0')
              else concat('0/1:', size, ',', pk % 30, ':', size + pk % 30, ':40:90,0,80') end as g1,
         case when size % 5 = 2 then concat('0/2:', size, ',0,', pk % 9, ':', size + pk % 9, ':30:60,61,62,0,63,64')
              else concat('1|1:0,', pk % 20, ':', pk % 20, ':', pk % 99, ':90,80,0') end as g2
  from site_bases
),
genes as (
  select s_suppkey as sk, concat('chr', s_suppkey % 25) as contig,
         {div('s_suppkey', 25)} * 4800 + (s_suppkey * 97) % 1500 + 1 as gs, 600 + (s_suppkey * 31) % 900 as size
  from {{supplier}}
),
gene_spans as (
  select contig, sk, gs, gs + size - 1 as ge, case when sk % 2 = 0 then '+' else '-' end as strand from genes
),
spans as (
  select *, 'transcript' as feature, gs as s, ge as e from gene_spans
  union all select *, 'exon' as feature, gs as s, gs + 199 as e from gene_spans
  union all select *, 'exon' as feature, ge - 199 as s, ge as e from gene_spans
  union all select *, 'CDS' as feature, gs + 100 as s, gs + 199 as e from gene_spans where sk % 3 <> 0
  union all select *, 'CDS' as feature, ge - 199 as s, ge - 100 as e from gene_spans where sk % 3 <> 0
),
features as (
  select contig, s as start, e as "end", strand, feature, concat('GENE', sk) as gene, concat('ENSG', sk) as gene_id,
         concat('ENST', sk) as transcript, case when sk % 3 <> 0 then 'protein_coding' else 'lncRNA' end as biotype
  from spans
),
runs as (
  select event_id, event_type as task_id, concat('dag', user_id % 5) as dag_id, date_trunc('hour', ts) as execution_date,
         cast(user_id % 8 as int) as executor_cores, concat(user_id % 3 + 1, 'g') as executor_memory, '2g' as driver_memory,
         case user_id % 4 when 0 then 'spark_default' when 1 then 'k8s' else 'local' end as conn_id,
         value as duration, case when event_type = 'error' then 'failed' else 'success' end as state, ts as recorded_at
  from {{events}}
)"""


def duck(select: str, gapped: bool = True, more: str = "") -> str:
    """DuckDB text of a query over the derived tables."""
    text = ctes(gapped).format(**{t: t for t in SOURCES})
    return f"with recursive {text}{',' + more if more else ''}\n{select}"


@lru_cache(maxsize=64)
def _spark_text(name: str, gapped: bool) -> str:
    # Only the subqueries that the wanted one needs; Spark quotes names with backticks.
    return f"with {ctes(gapped)} select * from {name}".replace('"end"', "`end`")


# Key and other columns that the derived tables use.
DEALT = {"orders": ["o_orderkey"],
         "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus", "l_returnflag"]}


def _source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. Splits are cut by bytes and may hold no row group at all, so the tables that are expanded are dealt anew, three
    parts for a core or four for a split, the rows of an order together, as they lie on one stretch of the genome."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if name not in DEALT:
        return df
    parts, (key, *others) = max(3 * spark.sparkContext.defaultParallelism, 4 * df.rdd.getNumPartitions()), DEALT[name]
    known = F.coalesce(F.col(key).cast("long"), F.xxhash64(*others)) if others else F.col(key)
    return df.select(key, *others).repartition(parts, known, *[F.floor(F.col(c) / 8) for c in others if c == "l_linenumber"])


_STORED: dict[tuple, str] = {}


SEQUENCED = {"reads": (sequencer.reads, sequencer.READ_SCHEMA), "alignments": (sequencer.alignments, sequencer.ALIGNMENT_SCHEMA),
             "placements": (sequencer.placements, sequencer.PLACE_SCHEMA)}
PLAIN = "l_orderkey >= 0 and l_partkey >= 0 and l_suppkey >= 0"


def derived(spark: SparkSession, sources: dict[str, DataFrame], name: str, gapped: bool) -> DataFrame:
    """Rows of a derived table. ``truth`` of the alignments is left out, as no query reads it.

    Reads and alignments, by far the largest, are derived by ``sequencer`` from batches of fragments, in a quarter of the time; rows
    with a key that is null or negative by the SQL, whose rules for these are its own.
    """
    select = lambda of: spark.sql(_spark_text("alignments" if name == "placements" else name, gapped), **of)
    if name not in SEQUENCED:
        return select(sources)
    function, schema = SEQUENCED[name]
    keys = spark.sql(_spark_text("fragment_keys", gapped), **sources | {"lineitem": sources["lineitem"].filter(PLAIN)})
    fast = keys.withColumn("rg_id", F.concat("sample", F.lit("_"), "library")).sortWithinPartitions("k").mapInArrow(partial(function, gapped=gapped), schema)
    other = sources["lineitem"].filter(f"not coalesce({PLAIN}, false)")
    return fast if other.isEmpty() else fast.unionByName(select(sources | {"lineitem": other}).select(*fast.columns))


def table(spark: SparkSession, sf: str, name: str, gapped: bool = True) -> DataFrame:
    """A derived table, stored as Parquet in the scratch folder the first time a session asks for it.

    Stored rows are what the operators work on in practice. Left as expressions, the derivation would be repeated inside
    every predicate that the optimizer pushes down to it.
    """
    key = (spark.sparkContext.applicationId, sf, name, gapped)
    if key not in _STORED:
        sources = {t: _source(spark, sf, t) for t in SOURCES}
        path = scratch_path(spark, f"derived-{name}")
        with shuffles_removed(spark):
            derived(spark, sources, name, gapped).write.option("compression", STORED_AS).parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def streamed(spark: SparkSession, sf: str, name: str, gapped: bool = True) -> DataFrame:
    """The rows of reads or alignments for a step that reads them once: not stored, unless they are already or hold rows that
    follow the SQL, whose expressions would be repeated."""
    sources = {t: _source(spark, sf, t) for t in SOURCES}
    if (spark.sparkContext.applicationId, sf, name, gapped) in _STORED or not sources["lineitem"].filter(f"not coalesce({PLAIN}, false)").isEmpty():
        return table(spark, sf, name, gapped)
    return derived(spark, sources, name, gapped)


def ref_tiles(spark, sf, tile: int = 4096, overlap: int = 1024) -> DataFrame:
    """The genome as stored tiles."""
    key = (spark.sparkContext.applicationId, sf, "ref_tiles", tile, overlap)
    if key not in _STORED:
        chunks = table(spark, sf, "chunks").select("contig", (F.col("chunk") * 32).alias("offset"), "bases")
        _STORED[key] = scratch_path(spark, "ref-tiles")
        with shuffles_removed(spark):
            tiles_from_pieces(chunks, tile, overlap).write.option("compression", STORED_AS).parquet(_STORED[key])
    return spark.read.parquet(_STORED[key])


def placements(spark, sf) -> DataFrame:
    """The rows of ``alignments`` for queries that read neither bases nor qualities, which aren't derived then unless they are stored."""
    stored = (spark.sparkContext.applicationId, sf, "alignments", True) in _STORED
    return alignments(spark, sf).drop("bases", "quals") if stored else table(spark, sf, "placements")


def alignments(spark, sf) -> DataFrame:
    return _alignment_columns(table(spark, sf, "alignments"))


def alignments_once(spark, sf) -> DataFrame:
    """The same rows for a step that reads them once."""
    return _alignment_columns(streamed(spark, sf, "alignments"))


def _alignment_columns(rows: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return rows.select(
        "sample", "rg_id", "library", "frag", "flags", "contig", "pos", "end", "mapq", "cigar", nothing.alias("mate_contig"),
        F.lit(None).cast("long").alias("mate_pos"), F.lit(0).cast("long").alias("tlen"), "bases", "quals",
        F.create_map(F.lit("RG"), F.concat(F.lit("Z:"), "rg_id")).alias("tags"))


def reads(spark, sf, gapped: bool = True) -> DataFrame:
    return table(spark, sf, "reads", gapped)


def snps(spark, sf) -> DataFrame:
    return table(spark, sf, "snps")


VCF_TEXT = F"concat_ws('\t', contig, pos, id, ref, alt, qual, filter, info, 'GT:AD:DP:GQ:PL', g1, g2)"


def vcf_lines(spark, sf) -> DataFrame:
    return table(spark, sf, "variants").select(F.expr(VCF_TEXT).alias("value"))


def variants(spark, sf) -> DataFrame:
    names = F.array(*[F.lit(s) for s in SAMPLES])
    return parse_vcf(vcf_lines(spark, sf).withColumn("sample_names", names)).drop("format_keys")


def features(spark, sf) -> DataFrame:
    return table(spark, sf, "features")


def runs(spark, sf) -> DataFrame:
    return table(spark, sf, "runs")
