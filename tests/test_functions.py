"""Column functions on worked cases."""

import pytest
from pyspark.sql import functions as F

from locusflow.functions import alleles, cigar, genotype, phred, ranges, vcf_text
from locusflow.sources import shards


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cigar(spark):
    units = cigar.parse_cigar(F.lit("3S5M2D4M1I2M"))
    assert one(spark, cigar.format_cigar(units)) == "3S5M2D4M1I2M"
    assert one(spark, cigar.ref_span(units)) == 13 and one(spark, cigar.read_span(units)) == 15
    assert one(spark, cigar.format_cigar(cigar.trim_cigar(units, F.lit(3), F.lit(6)))) == "2M2D2M"
    assert one(spark, cigar.haplotype_to_ref(cigar.parse_cigar(F.lit("4M2I4M")), F.lit(5), F.lit(100))) == 103
    assert one(spark, cigar.haplotype_to_ref(cigar.parse_cigar(F.lit("4M2I4M")), F.lit(40), F.lit(100))) is None


@pytest.mark.parametrize("bad", ["", "M", "5", "0M", "3Q", "3M4", "M3"])
def test_bad_cigar(spark, bad):
    with pytest.raises(Exception, match="bad CIGAR"):
        one(spark, cigar.parse_cigar(F.lit(bad)))


def test_alleles(spark):
    assert one(spark, alleles.simplify_alleles(F.lit("CAATT"), F.lit("CATT"))).asDict() == {"ref": "CA", "alt": "C"}
    assert one(spark, alleles.simplify_alleles(F.lit("A"), F.lit("T"))).asDict() == {"ref": "A", "alt": "T"}
    assert one(spark, alleles.simplify_ref_alt(F.lit("CAA"), F.lit("CA"))) == "CA->C"
    assert one(spark, alleles.reverse_complement(F.lit("AcgTx-"))) == "-NAcgT"
    snp = alleles.is_snp(F.lit("A"), F.array(F.lit("C"), F.lit("G")))
    assert one(spark, snp) and not one(spark, alleles.is_indel(F.lit("A"), F.array(F.lit("C"))))
    assert one(spark, alleles.splice_alt(F.lit("ACGTACGT"), F.lit(100), F.lit(102), F.lit("GT"), F.lit("G"))) == "ACGACGT"
    assert one(spark, alleles.splice_alt(F.lit("ACGT"), F.lit(100), F.lit(103), F.lit("TT"), F.lit("T"))) is None
    usable = alleles.usable_bases(F.lit("ACGT"), F.array(*(F.lit(q) for q in (30, 5, 30, 30))), F.lit(0), F.lit(3), 10, True)
    assert one(spark, usable).asDict() == {"usable": False, "is_low_quality": False}
    usable = alleles.usable_bases(F.lit("ACGT"), F.array(*(F.lit(q) for q in (9, 5, 9, 30))), F.lit(0), F.lit(3), 10, False)
    assert one(spark, usable).asDict() == {"usable": True, "is_low_quality": True}


def test_genotypes(spark):
    order = one(spark, genotype.genotype_order(F.lit(2)))
    assert [(p.first, p.second) for p in order] == [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)]
    probs = F.array(*(F.lit(p) for p in (0.0, 0.1, 0.1, 0.1, 0.1, 0.6)))
    assert one(spark, genotype.likeliest(probs, F.lit(2))) == [2, 2]
    assert one(spark, genotype.alt_combinations(F.lit(2), True)) == [[0], [1], [0, 1]]
    assert one(spark, genotype.alt_indices(F.array(F.lit("T"), F.lit("G")), F.array(F.lit("G"), F.lit("x")))) == [1]


def test_phred(spark):
    assert one(spark, phred.true_to_phred(F.lit(1.0))) == pytest.approx(99.0309, abs=1e-3)
    assert one(spark, phred.pl_of(F.array(F.lit(0.9), F.lit(0.0999), F.lit(0.0001)))) == [0, 9, 39]
    assert one(spark, phred.error_to_rounded_phred(F.lit(0.001))) == 30
    assert one(spark, phred.normal_cdf(F.lit(1.96))) == pytest.approx(0.975, abs=1e-4)
    assert one(spark, phred.normal_cdf(F.lit(-1.96))) == pytest.approx(0.025, abs=1e-4)


def test_ranges(spark):
    assert ranges.parse_literal("chr20:1,000-2,000") == ("chr20", 999, 2000)
    for bad in ("chr1", "chr1:5", "chr1:0-5", "chr1:9-5", ":1-2"):
        with pytest.raises(ValueError):
            ranges.parse_literal(bad)
    assert ranges.parse_contigs(["a:10", "b:c:5"]) == [(0, "a", 10), (1, "b:c", 5)]
    assert one(spark, ranges.literal_range(F.lit("a:0-5"))) is None


def test_vcf_text(spark):
    for value, text in ((0.0, "0"), (36.25, "36.3"), (40.0, "40"), (39.96, "40")):
        assert one(spark, vcf_text.quality_text(F.lit(value))) == text
    for value, text in ((0.5, "0.5"), (1.0, "1"), (0.3333333, "0.333333"), (0.0, "0")):
        assert one(spark, vcf_text.float_text(F.lit(value))) == text
    gt = lambda *g: F.array(*(F.lit(x) for x in g))
    assert one(spark, vcf_text.genotype_text(gt(0, -1), F.lit(False))) == "0/."
    assert one(spark, vcf_text.genotype_text(gt(1, 2), F.lit(True))) == "1|2"
    head = vcf_text.header_text([(0, "a", 5), (1, "b", 0)], ["s"])
    assert "##contig=<ID=a,length=5>\n##contig=<ID=b>\n#CHROM\tPOS" in head and head.endswith("FORMAT\ts\n")


def test_shards():
    assert shards.shard_name("x@10.gz", 3) == "x-00003-of-00010.gz"
    assert shards.shard_name("x@1234567", 3) == "x-0000003-of-1234567"
    with pytest.raises(ValueError):
        shards.parse_spec("x")


def test_a_tenth_of_the_greatest_is_ten(spark):
    rows = [([6 / 94, 28 / 94, 60 / 94],), (None,), ([1.0, 0.0],), ([],)]
    found = spark.createDataFrame(rows, "probs array<double>").select("probs", phred.pl_of(F.col("probs")).alias("pl")).collect()
    assert {str(r.probs): r.pl for r in found} == {str(rows[0][0]): [10, 3, 0], "None": None, "[1.0, 0.0]": [0, 99], "[]": []}
