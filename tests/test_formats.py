import glob
import gzip
import time

import pytest
from pyspark.sql import functions as F

from strandlake.operators.coordinates import sequence_dictionary, sort_by_reference_position
from strandlake.operators.filters import explode_genotypes, min_qual, split_alts
from strandlake.operators.fragments import interleave
from strandlake.sources import fasta, fastq, sam, samples, store, vcf
from strandlake.streaming.ingest import ingest_incremental


def record(name, bases):
    return f"@{name}\n{bases}\n+\n{'@' * len(bases)}\n"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_fastq_over_many_splits(spark, tmp_path, small_splits):
    """Quality lines start with @, names repeat and the last newline is missing."""
    rows = [(f"r{i % 7}", "ACGTN"[i % 5] * (3 + i % 11)) for i in range(60)]
    (tmp_path / "s.fq").write_text("".join(record(*r) for r in rows).rstrip("\n"))
    assert spark.read.text(str(tmp_path / "s.fq")).rdd.getNumPartitions() > 3
    found = fastq.read_fastq(spark, str(tmp_path / "s.fq")).orderBy("ord").collect()
    assert [(r["frag"], r["bases"]) for r in found] == rows
    assert [r["ord"] for r in found] == list(range(60)) and {r["sample"] for r in found} == {"s"}


def test_truncated_fastq_is_an_error(spark, tmp_path):
    (tmp_path / "t.fq").write_text(record("a", "ACGT") + "@b\nAC\n")
    with pytest.raises(Exception, match="malformed or truncated"):
        fastq.read_fastq(spark, str(tmp_path / "t.fq")).collect()


def test_mate_files(spark, tmp_path):
    (tmp_path / "p_1.fq").write_text(record("x/1", "ACG") + record("y/1", "CCC"))
    (tmp_path / "p_2.fq").write_text(record("x/2", "TTT") + record("y/2", "GGG"))
    (tmp_path / "q.fq").write_text(record("z", "A"))
    sides = [fastq.read_fastq(spark, str(tmp_path / f"p_{i}.fq")) for i in (1, 2)]
    pairs = interleave(*sides)
    assert sorted((r["frag"], r["reads"][0]["bases"], r["reads"][1]["bases"]) for r in pairs.collect()) == [("x", "ACG", "TTT"), ("y", "CCC", "GGG")]
    fastq.write_interleaved_fastq(pairs, str(tmp_path / "out"))
    again = fastq.read_interleaved_fastq(spark, str(tmp_path / "out"), "p")
    assert sorted(map(str, again.collect())) == sorted(map(str, pairs.collect()))
    with pytest.raises(Exception, match="no matching mate"):
        interleave(sides[0], sides[1].filter("ord = 0")).collect()
    for lane, base in (("l1", "A"), ("l2", "C")):
        (tmp_path / f"{lane}_1.fastq").write_text(record(f"{lane}x/1", base) + record(f"{lane}y/1", base * 2))
        (tmp_path / f"{lane}_2.fastq").write_text(record(f"{lane}x/2", base * 3) + record(f"{lane}y/2", base * 4))
    lanes = interleave(*[fastq.read_fastq(spark, [str(tmp_path / f"l{n}_{i}.fastq") for n in (1, 2)], "s") for i in (1, 2)]).collect()
    assert sorted((r["sample"], r["frag"], *[x["bases"] for x in r["reads"]]) for r in lanes) == [
        ("s", "l1x", "A", "AAA"), ("s", "l1y", "AA", "AAAA"), ("s", "l2x", "C", "CCC"), ("s", "l2y", "CC", "CCCC")]
    for file in tmp_path.glob("l?_?.fastq"):
        file.unlink()
    found = {(r["sample_id"], r["layout"], len(r["files"])) for r in samples.discover_samples(spark, str(tmp_path)).collect()}
    assert found == {("p", "paired", 2), ("q", "single", 1)}


def test_parts_of_an_output_are_one_file(spark, tmp_path):
    reads = spark.createDataFrame([(f"r{i:03d}", 0, "ACGT"[i % 4] * 5, "I" * 5) for i in range(50)], "frag string, mate int, bases string, quals string")
    fastq.write_fastq(reads.orderBy("frag").repartitionByRange(4, "frag").sortWithinPartitions("frag"), str(tmp_path / "out"))
    found = fastq.read_fastq(spark, str(tmp_path / "out"), "s").orderBy("ord").collect()
    assert [(r["ord"], r["frag"]) for r in found] == [(i, f"r{i:03d}") for i in range(50)]


def test_supplementary_records_are_not_reads(spark, tmp_path):
    line = lambda flag, bases: "\t".join(["x", str(flag), "one", "5", "60", f"{len(bases)}M", "*", "0", "0", bases, "I" * len(bases)])
    (tmp_path / "a.sam").write_text("\n".join(["@SQ\tSN:one\tLN:100", line(65, "ACGTA"), line(129, "CCGTA"), line(65 + 2048, "ACG"), line(129 + 256, "CCG")]) + "\n")
    row = fastq.load_fragments(spark, str(tmp_path / "a.sam"), "s").collect()
    assert len(row) == 1 and [r["bases"] for r in row[0]["reads"]] == ["ACGTA", "CCGTA"]


def test_fasta_over_many_splits(spark, tmp_path, small_splits, genome):
    text = "".join(f">{name}|x:1-2\tmore text\n" + "".join(seq[i:i + 60] + "\n" for i in range(0, len(seq), 60)) for name, seq in genome.items())
    (tmp_path / "g.fa").write_text(text + ">empty text\n>last\nACGT")
    tiles = fasta.read_fasta(spark, str(tmp_path / "g.fa"), tile=256, overlap=64)
    for r in tiles.collect():
        whole = {**{f"{k}|x:1-2": v for k, v in genome.items()}, "last": "ACGT"}[r["contig"]]
        assert r["bases"] == whole[r["start"] - 1:r["start"] - 1 + 320]
    import hashlib
    contigs = sequence_dictionary(tiles, 256).orderBy("idx").collect()
    assert [(c["contig"], c["length"]) for c in contigs] == [("one|x:1-2", 6000), ("two|x:1-2", len(genome["two"])), ("last", 4)]
    assert contigs[0]["md5"] == hashlib.md5(genome["one"].encode()).hexdigest()


SAM = ["@HD\tVN:1.6\tSO:unsorted", "@SQ\tSN:c:1-9\tLN:51001", "@SQ\tSN:b\tLN:90", "@RG\tID:g\tSM:s\tLB:l\tPL:ILLUMINA\tPU:0",
       "r1\t81\tc:1-9\t32968\t60\t4M\t=\t32795\t-208\tGTAA\t4556\tRG:Z:g\tMD:Z:4\tNM:i:0", "r1\t161\tc:1-9\t32795\t60\t4M\t=\t32968\t208\tCCGC\tEDCC\tRG:Z:g",
       "r2\t77\t*\t0\t0\t*\t*\t0\t0\tAC\tII\tRG:Z:g", "r3\t65\tb\t7\t60\t2M1D2M\tc:1-9\t5\t0\tACGT\tIIII\tRG:Z:g"]


def test_sam_round_trip_in_order(spark, tmp_path):
    (tmp_path / "a.sam").write_text("\n".join(SAM) + "\n")
    rows, contigs = sam.read_sam(spark, str(tmp_path / "a.sam")), sam.read_sequence_dictionary(spark, str(tmp_path / "a.sam"))
    assert [(c["contig"], c["length"], c["idx"]) for c in contigs.collect()] == [("c:1-9", 51001, 0), ("b", 90, 1)]
    first = rows.filter("flags = 65").first()
    assert (first["end"], first["mate_contig"], first["sample"], first["library"]) == (11, "c:1-9", "s", "l")
    assert [r["frag"] for r in sort_by_reference_position(rows, contigs).collect()] == ["r1", "r1", "r3", "r2"]
    sam.write_sam(rows, contigs, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    assert [line.split("\t")[0] for line in text[:4]] == ["@HD", "@SQ", "@SQ", "@RG"]
    assert text[4:] == [SAM[5], SAM[4], SAM[7], SAM[6]]


VCF = """##fileformat=VCFv4.1
##FILTER=<ID=IndelQD,Description="QD < 2.0">
##FORMAT=<ID=AD,Number=.,Type=Integer,Description="Allelic depths, in order">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=GT,Number=2,Type=Float,Description="Again">
##INFO=<ID=AC,Number=A,Type=Integer,Description="Count">
##contig=<ID=1,length=249250621>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tN1\tN2
1\t14397\t.\tCTGT\tC\t139.12\tIndelQD\tAC=2;DB\tGT:AD:DP:FT:GQ:PL\t0/1:16,4:20:rd:99:120,0,827\t0|1:8,2:10:dp;rd:60:60,0,414
1\t63735\trs2\tCCTA\tC,CT\t2994.09\tPASS\tAC=1,7;WGT=\tGT:AD:DP:FT:GQ:PL\t1/2:27,0,3:27:PASS:79:0,79,1425,1,2,3\t./.
1\t752791\t.\tA\tG\t.\tPASS\t.\tGT:AD:DP:FT:GQ:PL:SB\t1/1:0,27:27:PASS:81:1021,81,0:0,1,2,3\t1/1:0,19:19:dp:57:661,57,0
"""


def test_vcf(spark, tmp_path):
    (tmp_path / "v.vcf").write_text(VCF)
    rows, header = vcf.read_vcf(spark, str(tmp_path / "v.vcf"))
    assert header.filter("id = 'GT'").first()["number"] == "1"
    long = {(r["pos"], r["sample"]): r for r in explode_genotypes(rows).collect()}
    first = long[14397, "N1"]
    assert (first["gt"], first["ad"], first["dp"], first["ft"], first["gq"], first["pl"]) == ([0, 1], [16, 4], 20, ["rd"], 99, [120, 0, 827])
    assert long[14397, "N2"]["ft"] == ["dp", "rd"] and long[14397, "N2"]["phased"]
    assert long[752791, "N1"]["sb"] == [0, 1, 2, 3] and long[752791, "N2"]["sb"] is None
    assert [r["pos"] for r in min_qual(rows, 2486).collect()] == [63735]
    alleles = {r["alt"]: r for r in split_alts(rows).filter("pos = 63735").collect()}
    assert alleles["CT"]["info"]["AC"] == "7" and alleles["CT"]["genotypes"][0]["fields"]["PL"] == "0,1,3"
    assert alleles["C"]["genotypes"][0]["fields"]["GT"] == "1/0"
    vcf.write_vcf(rows, header, str(tmp_path / "out"), ["N1", "N2"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    assert text[0] == "##fileformat=VCFv4.2" and '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Allelic depths, in order">' in text
    again, _ = vcf.read_vcf(spark, str(tmp_path / "out"))
    pick = lambda df: sorted((r["pos"], r["ref"], tuple(r["alts"]), r["qual"], str(r["info"])) for r in df.collect())
    assert pick(again) == pick(rows)


def test_region_store(spark, tmp_path):
    rows = spark.range(0, 5000).select(F.concat(F.lit("c"), F.col("id") % 3).alias("contig"), (F.col("id") * 7).alias("pos"),
                                       (F.col("id") * 7 + F.col("id") % 40).alias("end"), F.col("id").cast("string").alias("frag"))
    store.write_genomic_parquet(rows, str(tmp_path / "r"), bin_size=512)
    got = store.read_region(spark, str(tmp_path / "r"), "c1", 1000, 2000)
    want = rows.filter("contig = 'c1' and pos <= 2000 and end >= 1000")
    assert sorted(r["frag"] for r in got.collect()) == sorted(r["frag"] for r in want.collect())
    assert "PartitionFilters: [isnotnull(contig" in got._jdf.queryExecution().toString()


def test_files_are_ingested_once(spark, tmp_path):
    work = tmp_path / "w"
    work.mkdir()
    (work / "a.fq").write_text(record("a", "ACGT"))
    args = (spark, str(work), str(tmp_path / "bronze"), str(tmp_path / "check"))
    assert ingest_incremental(*args).count() == 1
    (work / "b.ifq").write_text(record("b/1", "AC") + record("b/2", "GT"))
    for _ in range(2):
        rows = ingest_incremental(*args).collect()
        assert sorted((r["frag"], r["mate"]) for r in rows) == [("a", 0), ("b", 1), ("b", 2)]


def test_shuffles_of_a_stored_table_are_removed(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for d in env.localDirs() for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}
    before, setting = held(), spark.conf.get(store.SHUFFLE_CLEANUP)
    rows = store.materialize(spark.range(1000).repartition(3, "id"), "cleaned")
    for _ in range(100):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and rows.count() == 1000 and spark.conf.get(store.SHUFFLE_CLEANUP) == setting


def test_compressed_sam_reads_like_plain_text(spark, tmp_path):
    rows = spark.createDataFrame([("s", "g", "l", f"f{i}", 0, "one", 50 - i, 53 - i, 60, "4M", None, None, 0, "ACGT", "IIII", {"RG": "Z:g"}) for i in range(30)],
                                 "sample string, rg_id string, library string, frag string, flags int, contig string, pos long, end long, mapq int, cigar string, "
                                 "mate_contig string, mate_pos long, tlen long, bases string, quals string, tags map<string,string>")
    contigs = spark.createDataFrame([("one", 100, 0, None)], "contig string, length long, idx int, md5 string")
    lines = {}
    for kind in (None, "gzip"):
        path = str(tmp_path / f"out-{kind}")
        sam.write_sam(rows, contigs, path, compression=kind)
        lines[kind] = [line for p in sorted(glob.glob(f"{path}/part-*")) for line in (gzip.open if kind else open)(p, "rt")]
        assert sorted(r["frag"] for r in sam.read_sam(spark, path).filter("sample = 's'").collect()) == sorted(f"f{i}" for i in range(30))
    assert lines[None] == lines["gzip"] and len(lines["gzip"]) == 33
