"""Column functions, quality control, filters and reshaping."""
from pyspark.sql import functions as F

from strandlake.functions import cigar, flags, naming, sequence
from strandlake.functions.fields import tag
from strandlake.functions.variants import variant_class
from strandlake.operators import filters, fragments, qc, readgroups
from strandlake.operators.pileup import usable_for_calling
from strandlake.sources.vcf import format_info
from workload import tables as t
from workload.registry import query


@query("mate_names", t.duck("""select frag, mate, case when mate = 0 then frag else concat(frag, '/', mate) end as name, frag as bare from reads"""))
def mate_names(spark, sf):
    named = t.reads(spark, sf).withColumn("name", naming.mate_suffix(F.col("frag"), F.col("mate")))
    return named.select("frag", "mate", naming.mate_suffix(F.col("name"), F.col("mate")).alias("name"),
                        naming.strip_mate(F.col("name")).alias("bare"))


@query("interleaved_names", t.duck("""select frag, case when mate = 0 then null else concat(frag, '.ifq') end as interleaved, mate > 0 as is_mate,
  frag as sample_id from reads"""))
def interleaved_names(spark, sf):
    end = lambda m: F.concat("frag", F.when(F.col("mate") > 0, F.concat(F.lit("_"), F.lit(m).cast("string"))).otherwise(""), F.lit(".fq"))
    return t.reads(spark, sf).select("frag", naming.interleaved_name(end(2), end(1)).alias("interleaved"),
                                     naming.is_mate_file(end(1)).alias("is_mate"), naming.sample_id(end(1)).alias("sample_id"))


@query("phred_values", t.duck("""select frag, mate, cast(list_sum(list_transform(string_split(quals, ''), lambda c: ascii(c) - 33)) as bigint) as total,
  ascii(quals) - 33 as first_value, quals from reads"""))
def phred_values(spark, sf):
    values = sequence.phred(F.col("quals"))
    return t.reads(spark, sf).select(
        "frag", "mate", F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), values[0].alias("first_value"),
        sequence.to_quals(values).alias("quals"))


@query("forward_reads", t.duck("select r.frag, r.mate, r.bases, r.quals from reads r"))
def forward_reads(spark, sf):
    """Stored records turned back to sequencing order give the reads."""
    rows = t.alignments(spark, sf)
    return rows.select("frag", flags.mate_number(F.col("flags")).alias("mate"),
                       sequence.forward_sequence(F.col("bases"), F.col("flags")).alias("bases"),
                       sequence.forward_quals(F.col("quals"), F.col("flags")).alias("quals"))


@query("cigar_spans", t.duck("""select frag, flags, case cigar when '*' then 0 else "end" - pos + 1 end as ref_span,
  case cigar when '*' then 0 else 50 end as read_span, case cigar when '*' then 0 when '50M' then 1 when '5S45M' then 2 else 3 end as n_ops,
  pos - case cigar when '5S45M' then 5 else 0 end as unclipped_start, "end" as unclipped_end from alignments"""))
def cigar_spans(spark, sf):
    c = F.col("cigar")
    return t.alignments(spark, sf).select(
        "frag", "flags", cigar.ref_span(c).cast("long").alias("ref_span"), cigar.read_span(c).alias("read_span"),
        F.size(cigar.cigar_ops(c)).alias("n_ops"), cigar.unclipped_start(F.col("pos"), c).alias("unclipped_start"),
        cigar.unclipped_end(F.col("end"), c).alias("unclipped_end"))


@query("flag_fields", t.duck("""select frag, flags, (flags & 1) <> 0 as paired, (flags & 4) = 0 as mapped, (flags & 16) <> 0 as reverse,
  (flags & 64) <> 0 as first, (flags & 128) <> 0 as second, cast(flags | 1024 as int) as as_duplicate from alignments"""))
def flag_fields(spark, sf):
    f = F.col("flags")
    return t.alignments(spark, sf).select(
        "frag", "flags", flags.is_paired(f).alias("paired"), flags.is_mapped(f).alias("mapped"), flags.is_reverse(f).alias("reverse"),
        flags.is_first(f).alias("first"), flags.is_second(f).alias("second"), flags.set_flag(f, flags.DUPLICATE).alias("as_duplicate"))


@query("sam_tags", t.duck("select frag, flags, rg_id, library as lb, flags % 7 as nm, cast(null as int) as missing from alignments"))
def sam_tags(spark, sf):
    rows = t.alignments(spark, sf)
    tags = F.map_concat("tags", F.create_map(F.lit("NM"), F.concat(F.lit("i:"), (F.col("flags") % 7).cast("string")),
                                             F.lit("LB"), F.concat(F.lit("Z:"), "library")))
    return rows.select("frag", "flags", tag(tags, "RG").alias("rg_id"), tag(tags, "LB").alias("lb"), tag(tags, "NM", "int").alias("nm"),
                       tag(tags, "XS", "int").alias("missing"))


GENOTYPES = """select contig, pos, ref, alt as alts, s.sample, s.g from variants v, lateral (select 'P1' as sample, g1 as g union all select 'P2', g2) s"""


@query("genotypes_long", t.duck(f"""select contig, pos, ref, alts, sample, concat_ws(',', string_split_regex(gt, '[/|]')[1], string_split_regex(gt, '[/|]')[2]) as gt,
  contains(gt, '|') as phased, string_split(g, ':')[2] as ad, cast(string_split(g, ':')[3] as int) as dp, cast(string_split(g, ':')[4] as int) as gq,
  string_split(g, ':')[5] as pl from (select *, string_split(g, ':')[1] as gt from ({GENOTYPES}))"""))
def genotypes_long(spark, sf):
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return filters.explode_genotypes(t.variants(spark, sf)).select(
        "contig", "pos", "ref", F.array_join("alts", ",").alias("alts"), "sample", joined("gt"), "phased", joined("ad"), "dp", "gq", joined("pl"))


@query("alleles_split", t.duck(f"""select contig, pos, ref, string_split(alts, ',')[a] as alt, cast(a as int) as allele, sample,
  concat(case when string_split_regex(f[1], '[/|]')[1] = cast(a as varchar) then '1' else '0' end, case when contains(f[1], '|') then '|' else '/' end, case when string_split_regex(f[1], '[/|]')[2] = cast(a as varchar) then '1' else '0' end) as gt,
  concat_ws(',', string_split(f[2], ',')[1], string_split(f[2], ',')[a + 1]) as ad,
  concat_ws(',', string_split(f[5], ',')[1], string_split(f[5], ',')[case a when 1 then 2 else 4 end], string_split(f[5], ',')[case a when 1 then 3 else 6 end]) as pl,
  case when length(ref) = 1 and length(string_split(alts, ',')[a]) = 1 then 'snp' when length(ref) = 1 then 'ins' else 'del' end as class,
  case when a = 2 then '0.25' else '0.5' end as af
  from (select *, string_split(g, ':') as f, unnest(generate_series(1, len(string_split(alts, ',')))) as a from ({GENOTYPES}))"""))
def alleles_split(spark, sf):
    rows = filters.split_alts(t.variants(spark, sf)).select(
        "contig", "pos", "ref", "alt", "allele", F.element_at("info", "AF").alias("af"), F.inline("genotypes"))
    field = lambda k: F.element_at("fields", k).alias(k.lower())
    return rows.select("contig", "pos", "ref", "alt", "allele", "sample", field("GT"), field("AD"), field("PL"),
                       variant_class(F.col("ref"), F.col("alt")).alias("class"), "af")


@query("read_groups", t.duck("""select sample, concat('rg_', sample) as rg_id, concat('lib_', sample) as library, 'ILLUMINA' as platform, count(*) as reads
  from reads group by all"""))
def read_groups(spark, sf):
    rows = t.reads(spark, sf)
    groups = rows.groupBy("sample").agg(F.count(F.lit(1)).alias("_")).select(
        "sample", F.concat(F.lit("rg_"), "sample").alias("rg_id"), F.concat(F.lit("lib_"), "sample").alias("library"),
        F.lit("ILLUMINA").alias("platform"))
    return readgroups.assign_read_group(rows, groups=groups).groupBy("sample", "rg_id", "library", "platform").agg(F.count(F.lit(1)).alias("reads"))


@query("recoded_sites", t.duck("""select contig, pos, ref, alt as alts, '.' as info, g1 from variants where try_cast(qual as double) >= 905"""))
def recoded_sites(spark, sf):
    kept = filters.recode(filters.min_qual(t.variants(spark, sf), 905), keep_info=False)
    cell = F.col("genotypes")[0]["fields"]
    return kept.select("contig", "pos", "ref", F.array_join("alts", ",").alias("alts"), format_info(F.col("info")).alias("info"),
                       F.concat_ws(":", *[F.element_at(cell, k) for k in ("GT", "AD", "DP", "GQ", "PL")]).alias("g1"))


@query("min_quality_sites", t.duck("select contig, pos, ref, alt as alts, cast(qual as double) as qual from variants where try_cast(qual as double) >= 950.5"))
def min_quality_sites(spark, sf):
    return filters.min_qual(t.variants(spark, sf), 950.5).select("contig", "pos", "ref", F.array_join("alts", ",").alias("alts"), "qual")


@query("filtered_sites", t.duck("""select contig, pos, ref, alt as alts, cast(regexp_extract(info, 'DP=([0-9]+)', 1) as int) as dp from variants
  where filter = 'PASS' and cast(regexp_extract(info, 'DP=([0-9]+)', 1) as int) between 10 and 30 and info like '%;DB'"""))
def filtered_sites(spark, sf):
    from strandlake.functions.fields import info_value
    dp = info_value(F.col("info"), "DP", "Integer")
    rows = filters.filter_sites(t.variants(spark, sf), F.array_contains("filters", "PASS") & dp.between(10, 30)
                                & info_value(F.col("info"), "DB", "Flag"))
    return rows.select("contig", "pos", "ref", F.array_join("alts", ",").alias("alts"), dp.alias("dp"))


@query("usable_reads", t.duck("""select frag, flags, mapq from alignments where (flags & 4) = 0 and (flags & 1024) = 0 and mapq <> 255
  and ((flags & 1) = 0 or (flags & 8) = 0)"""))
def usable_reads(spark, sf):
    return usable_for_calling(t.alignments(spark, sf)).select("frag", "flags", "mapq")


FRAGMENTS = """select sample, frag, count(*) as n_reads, max(bases) filter (where mate < 2) as bases1, max(bases) filter (where mate = 2) as bases2
  from reads group by all"""


@query("fragments_grouped", t.duck(FRAGMENTS))
def fragments_grouped(spark, sf):
    rows = fragments.to_fragments(t.reads(spark, sf))
    return rows.select("sample", "frag", F.size("reads").cast("long").alias("n_reads"), F.col("reads")[0]["bases"].alias("bases1"),
                       F.get("reads", F.lit(1))["bases"].alias("bases2"))


MATES = """select a.sample, a.frag, a.bases as bases1, b.bases as bases2 from reads a join reads b on a.sample = b.sample and a.frag = b.frag
  and a.mate = 1 and b.mate = 2"""


@query("mate_pairing", t.duck(MATES))
def mate_pairing(spark, sf):
    """Mate files written in one order and paired record by record."""
    from strandlake.sources import fastq, store
    reads = t.reads(spark, sf).filter("mate > 0").orderBy("sample", "frag")
    files = {}
    for mate in (1, 2):
        files[mate] = store.scratch_path(spark, f"mates_{mate}")
        fastq.write_fastq(reads.filter(F.col("mate") == mate), files[mate], compression="gzip")
    sides = [fastq.read_fastq(spark, files[m], "all") for m in (1, 2)]
    rows = fragments.interleave(*sides)
    first = t.reads(spark, sf).filter("mate = 1").select("frag", F.col("sample").alias("own"))
    return rows.join(first, "frag").select(F.col("own").alias("sample"), "frag", F.col("reads")[0]["bases"].alias("bases1"),
                                           F.col("reads")[1]["bases"].alias("bases2"))


@query("cohort_union", t.duck("select sample, library, count(*) as records from alignments group by all"))
def cohort_union(spark, sf):
    rows = t.alignments(spark, sf)
    parts = [rows.filter(F.col("library") == library) for library in ("A", "N", "R")]
    return readgroups.union_samples(parts).groupBy("sample", "library").agg(F.count(F.lit(1)).alias("records"))


CELLS = """select i + 1 as cycle, substr(bases, cast(i + 1 as int), 1) as base, ascii(substr(quals, cast(i + 1 as int), 1)) - 33 as q from reads
  cross join (select unnest(generate_series(0, 49)) as i)"""

query("qc_basic_stats", t.duck("""select count(*) as reads, cast(sum(length(bases)) as bigint) as bases, cast(min(length(bases)) as int) as min_length, cast(max(length(bases)) as int) as max_length,
  round(100.0 * sum(length(translate(bases, 'ATN', ''))) / sum(length(translate(bases, 'N', ''))), 4) as gc_percent from reads"""))(
    lambda spark, sf: qc.qc_basic_stats(t.reads(spark, sf)))

query("qc_per_base_quality", t.duck(f"""select cast(cycle as int) as cycle, round(avg(q), 6) as mean, cast(quantile_cont(q, 0.5) as double) as median,
  cast(quantile_cont(q, 0.25) as double) as q1, cast(quantile_cont(q, 0.75) as double) as q3, cast(quantile_cont(q, 0.1) as double) as p10,
  cast(quantile_cont(q, 0.9) as double) as p90 from ({CELLS}) group by cycle"""))(lambda spark, sf: qc.qc_per_base_quality(t.reads(spark, sf)))

query("qc_per_read_quality", t.duck("""select cast(floor(list_sum(list_transform(string_split(quals, ''), lambda c: ascii(c) - 33)) / length(quals)) as bigint) as mean_quality,
  count(*) as reads from reads group by 1"""))(lambda spark, sf: qc.qc_per_read_quality(t.reads(spark, sf)))

query("qc_per_base_content", t.duck("select cast(cycle as int) as cycle, " + ", ".join(
    f"round(100.0 * count(*) filter (where base = '{b}') / count(*) filter (where base <> 'N'), 6) as {b.lower()}_percent" for b in "ACGT")
    + f" from ({CELLS}) group by cycle"))(lambda spark, sf: qc.qc_per_base_content(t.reads(spark, sf)))

query("qc_gc_distribution", t.duck("""select cast(floor(100 * length(translate(bases, 'ATN', '')) / length(translate(bases, 'N', ''))) as bigint) as gc_percent,
  count(*) as reads from reads group by 1"""))(lambda spark, sf: qc.qc_gc_distribution(t.reads(spark, sf)))

query("qc_n_content", t.duck(f"""select cast(cycle as int) as cycle, round(100.0 * count(*) filter (where base = 'N') / count(*), 6) as n_percent
  from ({CELLS}) group by cycle"""))(lambda spark, sf: qc.qc_n_content(t.reads(spark, sf)))

# Reads of several lengths: cut before the first base that wasn't called.
CALLED = "case when instr(bases, 'N') > 0 then left(bases, instr(bases, 'N') - 1) else bases end"
query("qc_length_distribution", t.duck(f"select cast(length({CALLED}) as int) as length, count(*) as reads from reads group by 1"))(
    lambda spark, sf: qc.qc_length_distribution(t.reads(spark, sf).select(F.expr(CALLED).alias("bases"))))

LEVEL = "case when c > 10000 then '>10k' when c > 5000 then '>5k' when c > 1000 then '>1k' when c > 500 then '>500' when c > 100 then '>100' when c > 50 then '>50' when c > 9 then '>10' else cast(c as varchar) end"
query("qc_duplication_levels", t.duck(f"""select {LEVEL} as level, count(*) as sequences, cast(sum(c) as bigint) as reads
  from (select bases, count(*) as c from reads group by 1) group by 1"""))(lambda spark, sf: qc.qc_duplication_levels(t.reads(spark, sf)))

query("qc_overrepresented", t.duck("""select bases, copies, round(copies / (select count(*) from reads), 8) as share from (
  select bases, count(*) as copies from reads group by 1) where copies >= (select count(*) from reads) * 0.00001 order by copies desc, bases limit 20"""))(
    lambda spark, sf: qc.qc_overrepresented(t.reads(spark, sf), 20, 0.00001))

ADAPTERS = {"first": "ACGTA", "second": "GGGTC", "never": "NNNNNN"}
query("qc_adapter_content", t.duck("select adapter, cast(cycle as int) as cycle, round(100.0 * sum(n) over (partition by adapter order by cycle) / total, 6) as percent from ("
      + " union all ".join(f"select '{n}' as adapter, instr(bases, '{s}') as cycle, count(*) as n, (select count(*) from reads) as total from reads where instr(bases, '{s}') > 0 group by 2"
                           for n, s in ADAPTERS.items()) + ")"))(lambda spark, sf: qc.qc_adapter_content(t.reads(spark, sf), ADAPTERS))
