from pyspark.sql import functions as F

from strandlake.functions import (aligned_blocks, cigar_ops, forward_sequence, info_value, interleaved_name, is_duplicate, phred, read_span,
                                  ref_span, revcomp, sample_id, set_flag, tag, to_quals, unclipped_end, unclipped_start, variant_class)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_sample_ids(spark):
    for path, expected in [("/w/1234.fq", "1234"), ("ch2.fastq", "ch2"), ("/a/chr1.ifq", "chr1"), ("homo_sapiens.fq", "homo_sapiens"),
                           ("ecoli_1.fq", "ecoli"), ("ecoli_2.fastq", "ecoli"), ("/x/y_3.fq", "y_3")]:
        assert one(spark, sample_id(F.lit(path))) == expected


def test_interleaved_names(spark):
    for a, b, expected in [("chr1_1.fq", "chr1_2.fq", "chr1.ifq"), ("chr1_1.fastq", "chr1_2.fastq", "chr1.ifq"), ("chr1.fq", "chr1.fq", None),
                           ("chr1.fastq", "chr1.fq", None), ("chr1_1.fq", "chr_1.fastq", None), ("x_2.fq", "x_1.fq", "x.ifq"), ("x_1.fq", "x_1.fq", None)]:
        assert one(spark, interleaved_name(F.lit(a), F.lit(b))) == expected


def test_qualities_both_ways(spark):
    text = "@DCCCBAAAA@@@@?>===<;;9:99987776554"
    values = one(spark, phred(F.lit(text)))
    assert values == [31, 35, 34, 34, 34, 33, 32, 32, 32, 32, 31, 31, 31, 31, 30, 29, 28, 28, 28, 27, 26, 26, 24, 25, 24, 24, 24, 23, 22, 22, 22,
                      21, 20, 20, 19]
    assert one(spark, to_quals(phred(F.lit(text)))) == text
    assert one(spark, phred(F.lit(""))) == []


def test_sequences(spark):
    assert one(spark, revcomp(F.lit("AACGTN"))) == "NACGTT"
    assert one(spark, forward_sequence(F.lit("AACG"), F.lit(145))) == "CGTT"
    assert one(spark, forward_sequence(F.lit("AACG"), F.lit(97))) == "AACG"


def test_cigar(spark):
    assert [tuple(o) for o in one(spark, cigar_ops(F.lit("20M1D54M")))] == [(20, "M"), (1, "D"), (54, "M")]
    for text, on_ref, on_read in [("20M1D54M", 75, 74), ("37M1I38M", 75, 76), ("5S10M3H", 10, 15), ("*", 0, 0), ("4M100N4M", 108, 8)]:
        assert one(spark, ref_span(F.lit(text))) == on_ref
        assert one(spark, read_span(F.lit(text))) == on_read
    assert one(spark, unclipped_start(F.lit(100), F.lit("2H3S10M"))) == 95
    assert one(spark, unclipped_end(F.lit(100), F.lit("10M4S"))) == 104
    blocks = one(spark, aligned_blocks(F.lit(10), F.lit("2S3M1I2M2D4M")))
    assert [tuple(b) for b in blocks] == [(10, 2, 3, "I", 1), (13, 6, 2, "D", 2), (17, 8, 4, None, None)]


def test_flags_and_tags(spark):
    assert one(spark, is_duplicate(set_flag(F.lit(99), 0x400)))
    tags = F.create_map(F.lit("NM"), F.lit("i:3"), F.lit("RG"), F.lit("Z:a:b"))
    assert one(spark, tag(tags, "NM", "int")) == 3
    assert one(spark, tag(tags, "RG")) == "a:b"
    assert one(spark, tag(tags, "XS", "int")) is None


def test_info_values(spark):
    info = F.str_to_map(F.lit("AC=2,3;DB;WGT="), F.lit(";"), F.lit("="))
    assert one(spark, info_value(info, "AC", "Integer")) == 2
    assert one(spark, info_value(info, "AC", "Integer", first=False)) == [2, 3]
    assert one(spark, info_value(info, "DB", "Flag")) is True
    assert one(spark, info_value(info, "XX", "Flag")) is None
    assert one(spark, info_value(info, "WGT", "Integer")) is None


def test_variant_classes(spark):
    for ref, alt, expected in [("A", "G", "snp"), ("AC", "GT", "mnp"), ("A", "AT", "ins"), ("ATT", "A", "del"), ("ATT", "G", "complex")]:
        assert one(spark, variant_class(F.lit(ref), F.lit(alt))) == expected
