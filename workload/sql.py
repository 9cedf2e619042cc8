"""DuckDB building blocks: the operators written again as plain SQL over the derived tables."""

# Reads placed where they came from: what an exact seed search must find when every seed is unique.
# A seed is any 16 bases of the read.


def placed(paired: bool = True) -> str:
    """``placed``: the ungapped reads as an aligner returns them, paired or each read on its own."""
    seen = "len(list_filter(generate_series(1, 35), lambda i: substr(bases, i, 16) = substr(truth, i, 16))) > 0"
    name = "frag" if paired else "concat(frag, '_', mate)"
    flags = ("""case when single then (case when hit then 0 else 4 end) else
        1 + (case when mate = 1 then 64 else 128 end) + (case when hit then 0 else 4 end) + (case when mate_hit then 0 else 8 end)
        + (case when hit and mate = 2 then 16 else 0 end) + (case when mate_hit and mate = 1 then 32 else 0 end)
        + (case when hit and mate_hit then 2 else 0 end) end"""
             if paired else "case when not hit then 4 when mate = 2 then 16 else 0 end")
    return f"""
judged as (
  select *, list_sum(list_transform(generate_series(1, 50), lambda i: case when substr(bases, i, 1) <> substr(truth, i, 1) then 1 else 0 end)) as nm
  from sequenced
),
found as (
  select *, (not unmapped) and 50 - 5 * nm >= 25 and {seen} as hit from judged
),
partnered as (
  select f.*, coalesce(o.hit, false) as mate_hit from found f left join found o on f.frag = o.frag and f.sample = o.sample and f.mate <> o.mate
),
placed as (
  select sample, sample as rg_id, sample as library, {name} as frag, mate, cast({flags} as int) as flags,
         case when hit then place end as contig, case when hit then p end as pos, case when hit then p + 49 end as "end",
         cast(case when hit then 60 else 0 end as int) as mapq, case when hit then '50M' else '*' end as cigar,
         case when mate = 2 and not unmapped and not hit then reverse(translate(bases, 'ACGTN', 'TGCAN')) else bases end as bases,
         case when mate = 2 and not unmapped and not hit then reverse(quals) else quals end as quals,
         truth, case when hit then cast(nm as int) end as nm
  from partnered
)"""


def marked(src: str = "alignments") -> str:
    """``marked``: ``src`` with duplicate flags."""
    return f"""
five as (
  select sample, library, frag,
         concat(contig, ':', lpad(cast(case when (flags & 16) <> 0 then "end" when cigar = '5S45M' then pos - 5 else pos end as varchar), 12, '0'),
                ':', (flags & 16) <> 0) as key,
         list_sum(list_transform(string_split(quals, ''), lambda c: case when ascii(c) - 33 >= 15 then ascii(c) - 33 else 0 end)) as score
  from {src} where (flags & 4) = 0
),
ends as (
  select sample, frag, max(library) as library, count(*) as n, min(key) as k1, max(key) as k2, sum(score) as score from five group by all
),
pair_rank as (
  select sample, library, frag, k1, k2, row_number() over (partition by sample, library, k1, k2 order by score desc, frag) as r from ends where n = 2
),
pair_keys as (select sample, library, k1 as k from pair_rank union select sample, library, k2 from pair_rank),
lone_rank as (
  select e.sample, e.frag, p.k is not null as beside_pair,
         row_number() over (partition by e.sample, e.library, e.k1 order by e.score desc, e.frag) as r
  from ends e left join pair_keys p on e.sample = p.sample and e.library = p.library and e.k1 = p.k where e.n = 1
),
copies as (
  select sample, frag from pair_rank where r > 1 union all select sample, frag from lone_rank where beside_pair or r > 1
),
marked as (
  select a.* replace (cast(case when (a.flags & 4) = 0 and c.frag is not null then a.flags | 1024 else a.flags end as int) as flags)
  from {src} a left join copies c on a.sample = c.sample and a.frag = c.frag
)"""


def cells(src: str) -> str:
    """``cells``: one row per read base with its reference position ``rp`` (null for inserted and clipped bases)."""
    return f"""
cells as (
  select sample, rg_id, library, frag, flags, contig, pos, mapq, cigar, bases, truth, i, substr(bases, i + 1, 1) as base,
         ascii(substr(quals, i + 1, 1)) - 33 as q, (flags & 16) <> 0 as rev,
         case when (flags & 4) <> 0 then null when cigar = '20M1D30M' then (case when i < 20 then pos + i else pos + i + 1 end)
              when cigar = '25M1I24M' then (case when i < 25 then pos + i when i > 25 then pos + i - 1 end)
              when cigar = '5S45M' then (case when i >= 5 then pos + i - 5 end) else pos + i end as rp
  from {src} cross join (select unnest(generate_series(0, 49)) as i)
)"""


def covariates() -> str:
    """``cov``: the covariate table of ``cells``."""
    return """
masked as (
  select c.*, substr(truth, cast(rp - c.pos + 1 as int), 1) as ref,
         case when rev then (case when i < 49 then substr(bases, i + 2, 1) end) else (case when i > 0 then substr(bases, i, 1) end) end as prev
  from cells c left join snps s on c.contig = s.contig and c.rp = s.pos
  where rp is not null and s.pos is null and (flags & 1024) = 0 and base <> 'N'
),
cov as (
  select rg_id, q, cast((case when rev then 50 - i else i + 1 end) * (case when (flags & 128) <> 0 then -1 else 1 end) as int) as cycle,
         case when prev is null or prev = 'N' then null when rev then translate(concat(prev, base), 'ACGT', 'TGCA') else concat(prev, base) end as dinuc,
         count(*) as observations, count(*) filter (where base <> ref) as mismatches
  from masked group by all
)"""


def recalibrated(src: str) -> str:
    """``recal``: ``src`` with rewritten qualities, after ``cells`` and ``cov`` of the same rows."""
    rate = lambda parent: f"(sum(mismatches) + 1000 * {parent}) / (sum(observations) + 1000)"
    micro = lambda p: f"cast(round(-10e6 * log10({p})) as int)"
    return f"""
rates as (select rg_id, q, {rate("pow(10, -q / 10.0)")} as p from cov group by rg_id, q),
eb as (select rg_id, q, {micro("p")} as e from rates),
ec as (select c.rg_id, c.q, cycle, {micro(rate("p"))} - {micro("p")} as d from cov c join rates r on c.rg_id = r.rg_id and c.q = r.q group by c.rg_id, c.q, cycle, p),
ed as (select c.rg_id, c.q, dinuc, {micro(rate("p"))} - {micro("p")} as d from cov c join rates r on c.rg_id = r.rg_id and c.q = r.q where dinuc is not null group by c.rg_id, c.q, dinuc, p),
judged_cells as (
  select sample, rg_id, frag, flags, i, q, cast((case when rev then 50 - i else i + 1 end) * (case when (flags & 128) <> 0 then -1 else 1 end) as int) as cycle,
         case when prev is null or prev = 'N' or base = 'N' then null when rev then translate(concat(prev, base), 'ACGT', 'TGCA') else concat(prev, base) end as dinuc
  from (select *, case when rev then (case when i < 49 then substr(bases, i + 2, 1) end) else (case when i > 0 then substr(bases, i, 1) end) end as prev
        from cells where (flags & 4) = 0)
),
renewed as (
  select j.sample, j.frag, j.flags, string_agg(chr(cast(33 + case when b.e is null then j.q else
           greatest(1, least(50, floor((b.e + coalesce(c.d, 0) + coalesce(d.d, 0) + 500000) / 1000000.0))) end as int)), '' order by i) as quals
  from judged_cells j left join eb b on j.rg_id = b.rg_id and j.q = b.q
  left join ec c on j.rg_id = c.rg_id and j.q = c.q and j.cycle = c.cycle
  left join ed d on j.rg_id = d.rg_id and j.q = d.q and j.dinuc = d.dinuc
  group by all
),
recal as (
  select a.* replace (coalesce(r.quals, a.quals) as quals) from {src} a
  left join renewed r on a.sample = r.sample and a.frag = r.frag and a.flags = r.flags
)"""


def piled() -> str:
    """``piled``: the pileup of ``cells``."""
    ln = lambda t: f"cast(sum(floor(ln({t}) * 1000000 + 0.5)) as bigint)"
    return f"""
shown as (
  select sample, contig, rp as pos, q, rev, mapq, least(pow(10, -q / 10.0), 0.75) as e,
         case when cigar = '20M1D30M' and i = 19 then '-1' when cigar = '25M1I24M' and i = 24 then concat('+', substr(bases, 26, 1)) else base end as allele
  from cells
  where rp is not null and (base <> 'N' or cigar = '20M1D30M' and i = 19 or cigar = '25M1I24M' and i = 24) and (flags & 1024) = 0 and mapq <> 255 and ((flags & 1) = 0 or (flags & 8) = 0)
),
piled as (
  select sample, contig, pos, allele, count(*) as depth, count(*) filter (where not rev) as forward, count(*) filter (where rev) as backward,
         cast(sum(q) as bigint) as qual_sum, cast(sum(mapq) as bigint) as mapq_sum,
         {ln('1 - e')} as ln_match, {ln('(1 - e) / 2 + e / 6')} as ln_half, {ln('e / 3')} as ln_miss
  from shown group by all
)"""


def sites() -> str:
    """``judged_sites``: genotype likelihoods, quality and best genotype per position of ``piled``."""
    pl = lambda c: f"cast(floor(-10 * ({c} - greatest(l0, l1, l2)) / (1000000 * ln(10)) + 0.5) as int)"
    return f"""
letters as (
  select contig, chunk * 32 + i + 1 as pos, substr(bases, cast(i + 1 as int), 1) as b,
         substr(concat(bases, (select n.bases from chunks n where n.k = c.k + 25)), cast(i + 1 as int), 2) as bb
  from chunks c cross join (select unnest(generate_series(0, 31)) as i)
),
known as (
  select p.*, l.b as ref_base, l.bb, p.allele = l.b as is_ref,
         row_number() over (partition by sample, p.contig, p.pos order by (p.allele = l.b), qual_sum desc, allele) as r
  from piled p join letters l on p.contig = l.contig and p.pos = l.pos
),
summed as (
  select sample, contig, pos, max(ref_base) as ref_base, max(bb) as bb, cast(sum(depth) as bigint) as dp,
         max(allele) filter (where r = 1 and not is_ref) as alt_allele,
         {', '.join(f"coalesce(sum({c}) filter (where is_ref), 0) as r_{c}, coalesce(sum({c}) filter (where r = 1 and not is_ref), 0) as a_{c}"
                    for c in ('depth', 'qual_sum', 'forward', 'backward', 'mapq_sum', 'ln_match', 'ln_half', 'ln_miss'))},
         sum(ln_miss) as x
  from known group by sample, contig, pos
),
likely as (
  select *, r_ln_match + x - r_ln_miss as l0, r_ln_half + a_ln_half + x - r_ln_miss - a_ln_miss as l1, a_ln_match + x - a_ln_miss as l2 from summed
),
priors as (
  select *, {pl('l0')} as pl0, {pl('l1')} as pl1, {pl('l2')} as pl2,
         l0 / 1e6 + ln(1 - 0.0015) as p0, l1 / 1e6 + ln(0.001) as p1, l2 / 1e6 + ln(0.0005) as p2 from likely
),
judged_sites as (
  select *, least(99, pl0 + pl1 + pl2 - least(pl0, pl1, pl2) - greatest(pl0, pl1, pl2)) as gq,
         case when p0 >= greatest(p1, p2) then 0 when p1 >= p2 then 1 else 2 end as k,
         round(-10 * (p0 - greatest(p0, p1, p2) - ln(exp(p0 - greatest(p0, p1, p2)) + exp(p1 - greatest(p0, p1, p2)) + exp(p2 - greatest(p0, p1, p2)))) / ln(10), 4) as qual
  from priors
)"""


def calls() -> str:
    return sites() + """,
calls as (
  select sample, contig, pos, case when alt_allele = '-1' then bb else ref_base end as ref,
         case when alt_allele = '-1' then ref_base when alt_allele like '+%' then concat(ref_base, substr(alt_allele, 2)) else alt_allele end as alt,
         qual, case when k = 2 then '1/1' else '0/1' end as gt, dp, cast(r_depth as bigint) as ro, cast(a_depth as bigint) as ao,
         cast(r_qual_sum as bigint) as qr, cast(a_qual_sum as bigint) as qa, concat_ws(',', pl0, pl1, pl2) as pl, cast(gq as int) as gq,
         cast(a_forward as bigint) as saf, cast(a_backward as bigint) as sar, cast(r_forward as bigint) as srf, cast(r_backward as bigint) as srr,
         round(a_mapq_sum / a_depth, 4) as mqm, round(case when r_depth > 0 then r_mapq_sum / r_depth else 0 end, 4) as mqmr
  from judged_sites where k > 0 and a_depth >= 2 and alt_allele is not null
)"""


def alleles() -> str:
    """``alleles``: one row per distinct variant allele with its changed span."""
    return """
alleles as (
  select distinct contig, pos, ref, alt from (select contig, pos, ref, unnest(string_split(alt, ',')) as alt from variants)
),
changed as (
  select *, case when length(ref) <> length(alt) and left(ref, 1) = left(alt, 1) then 1 else 0 end as shared from alleles
),
spanned as (
  select *, case when shared = 1 and length(alt) = 1 then '-' when shared = 1 then substr(alt, 2) else alt end as allele,
         pos + shared as vs, greatest(pos + shared, pos + length(ref) - 1) as ve, length(alt) - length(ref) as shift from changed
)"""


def coding() -> str:
    """``coding_terms``: what single-base alleles in coding segments do to the protein."""
    side = lambda c: f"case when strand = '+' then {c} else translate({c}, 'ACGT', 'TGCA') end"
    acid = lambda c: ("substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', cast("
                      + " + ".join(f"{4 ** (2 - i)} * (instr('TCAG', substr(upper({c}), {i + 1}, 1)) - 1)" for i in range(3)) + " + 1 as int), 1)")
    return f""",
letters as (
  select contig, chunk * 32 + i + 1 as pos, substr(bases, cast(i + 1 as int), 1) as b from chunks cross join (select unnest(generate_series(0, 31)) as i)
),
segs as (
  select contig, transcript, strand, start as s, "end" as e, sum("end" - start + 1) over (partition by contig, transcript) as total,
         sum("end" - start + 1) over (partition by contig, transcript order by case when strand = '+' then start else -start end) - ("end" - start + 1) as before
  from features where feature = 'CDS'
),
coded as (
  select v.contig, v.pos, v.ref, v.alt, transcript, strand, total, before + case when strand = '+' then v.pos - s else e - v.pos end as c
  from alleles v join segs g on v.contig = g.contig and v.pos between s and e where length(ref) = 1 and length(alt) = 1
),
codon_bases as (
  select h.*, o, case when g.strand = '+' then s + (c - c % 3 + o) - before else e - (c - c % 3 + o) + before end as gp
  from coded h cross join (select unnest(generate_series(0, 2)) as o) join segs g
    on g.contig = h.contig and g.transcript = h.transcript and c - c % 3 + o >= before and c - c % 3 + o < before + e - s + 1
),
codon_letters as (
  select k.*, {side("l.b")} as r, {side("case when gp = k.pos then alt else l.b end")} as a, gp = k.pos as here
  from codon_bases k join letters l on l.contig = k.contig and l.pos = gp
),
codon_pairs as (
  select contig, pos, ref, alt, transcript, c, string_agg(case when here then r else lower(r) end, '' order by o) as old,
         string_agg(case when here then a else lower(a) end, '' order by o) as new
  from codon_letters where c - c % 3 + 3 <= total group by all having count(*) = 3
),
acids as (select *, {acid("old")} as x, {acid("new")} as y from codon_pairs),
coding_terms as (
  select contig, pos, ref, alt, transcript, case when x = y and x = '*' then 'stop_retained_variant' when x = y then 'synonymous_variant'
           when c < 3 and x = 'M' then 'start_lost' when y = '*' then 'stop_gained' when x = '*' then 'stop_lost' else 'missense_variant' end as term,
         cast(cast(c + 1 as bigint) as varchar) as cds_position, cast(cast((c - c % 3) / 3 + 1 as bigint) as varchar) as protein_position,
         case when x = y then x else concat(x, '/', y) end as amino_acids, concat(old, '/', new) as codons from acids
)"""


def consequences(upstream: int) -> str:
    return alleles() + f""",
shape as (
  select contig, transcript, max(case when feature = 'transcript' then start end) as ts, max(case when feature = 'transcript' then "end" end) as te,
         max(strand) as strand, max(gene) as gene, max(gene_id) as gene_id, max(biotype) as biotype,
         min(case when feature = 'CDS' then start end) as cs, count(*) filter (where feature = 'exon') as exons
  from features group by all
),
near as (
  select v.*, s.* exclude (contig),
         exists (select 1 from features f where f.contig = v.contig and f.transcript = s.transcript and f.feature = 'CDS' and f.start <= ve and f."end" >= vs) as in_cds,
         exists (select 1 from features f where f.contig = v.contig and f.transcript = s.transcript and f.feature = 'exon' and f.start <= ve and f."end" >= vs) as in_exon
  from spanned v join shape s on v.contig = s.contig and vs <= te + {upstream} and ve >= ts - {upstream}
),
termed as (
  select contig, pos, ref, alt, allele,
         case when ve < ts then (case when strand = '+' then 'upstream_gene_variant' else 'downstream_gene_variant' end)
              when vs > te then (case when strand = '+' then 'downstream_gene_variant' else 'upstream_gene_variant' end)
              when in_cds and shift % 3 <> 0 then 'frameshift_variant' when in_cds and shift > 0 then 'inframe_insertion'
              when in_cds and shift < 0 then 'inframe_deletion' when in_cds then 'coding_sequence_variant'
              when in_exon and cs is null then 'non_coding_transcript_exon_variant'
              when in_exon and (ve < cs) = (strand = '+') then '5_prime_UTR_variant' when in_exon then '3_prime_UTR_variant'
              when exons > 0 then 'intron_variant' else 'transcript_variant' end as consequence,
         gene as symbol, gene_id as gene, 'Transcript' as feature_type, transcript as feature, biotype,
         cast(case when ve < ts then ts - ve when vs > te then vs - te end as bigint) as distance, case when strand = '+' then 1 else -1 end as strand
  from near
  union all
  select contig, pos, ref, alt, allele, 'intergenic_variant', null, null, null, null, null, null, null from spanned v
  where not exists (select 1 from near n where n.contig = v.contig and n.pos = v.pos and n.ref = v.ref and n.alt = v.alt)
),
csq as (
  select *, case when consequence = 'frameshift_variant' then 'HIGH' when consequence in ('inframe_insertion', 'inframe_deletion') then 'MODERATE'
                 else 'MODIFIER' end as impact,
         case consequence when 'frameshift_variant' then 0 when 'inframe_insertion' then 1 when 'inframe_deletion' then 2 when 'coding_sequence_variant' then 3
              when '5_prime_UTR_variant' then 4 when '3_prime_UTR_variant' then 5 when 'non_coding_transcript_exon_variant' then 6 when 'intron_variant' then 7
              when 'transcript_variant' then 8 when 'upstream_gene_variant' then 9 when 'downstream_gene_variant' then 10 else 11 end as severity
  from termed
)"""
