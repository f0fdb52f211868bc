"""File formats, by round trips and known vectors."""

import gzip
import io
import struct

import pytest
from pyspark.sql import functions as F

from locusflow.sources import alignments, fasta, tfrecord, vcf


def test_crc_vector():
    assert tfrecord.crc32c(b"123456789") == 0xE3069283
    assert tfrecord.crc32c(b"\0" * 32) == 0x8A9136AA


def test_tfrecords(spark, tmp_path):
    payloads = [b"", b"abc", bytes(range(256)) * 9]
    for name in ("a.tfrecord", "a.tfrecord.gz"):
        tfrecord.write_tfrecords(payloads, str(tmp_path / name))
        got = tfrecord.read_tfrecords(spark, str(tmp_path / name)).orderBy("ordinal").collect()
        assert [bytes(r.payload) for r in got] == payloads
    both = gzip.compress(tfrecord.frame(b"x")) + gzip.compress(tfrecord.frame(b"y"))
    assert list(tfrecord.records_of(both, True)) == [b"x", b"y"]
    whole = tfrecord.frame(b"abcdef")
    for bad in (whole[:-1], whole[:5], whole[:12] + b"X" + whole[13:]):
        with pytest.raises(ValueError):
            list(tfrecord.read_records(io.BytesIO(bad)))


def test_example_message():
    features = {"variant/encoded": b"v", "image/encoded": b"\0" * 300, "alt": b""}
    data = tfrecord.encode_example(features)
    assert tfrecord.decode_example(data) == features
    assert data.index(b"alt") < data.index(b"image") < data.index(b"variant")


def bam_bytes():
    text = b"@HD\tVN:1.6\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    name, cigar, seq, qual = b"read1\0", struct.pack("<2I", 3 << 4, 2 << 4 | 1), bytes([0x12, 0x48, 0x10]), bytes([30, 31, 32, 33, 34])
    tags = b"NMC\1" + b"HPi" + struct.pack("<i", 2) + b"RGZgroup\0"
    body = struct.pack("<iiBBHHHiiii", 0, 99, len(name), 60, 0, 2, 16 | 64, 5, -1, -1, -200) + name + cigar + seq + qual + tags
    return head + struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    path = tmp_path / "one.bam"
    path.write_bytes(alignments.pack_blocks(bam_bytes()))
    (r,) = alignments.read_alignments(spark, str(path)).collect()
    assert (r.contig, r.ref_start, r.ref_end, r.seq, r.bq, r.mapq, r.is_rev, r.tlen, r.name, r.mate, r.hp) == ("chr1", 99, 102, "ACGTA", [30, 31, 32, 33, 34], 60, True, -200, "read1", 1, 2)
    assert [(u.op, u.len) for u in r.cigar] == [("M", 3), ("I", 2)]
    assert alignments.format_of("x.BAM") == "bam"
    with pytest.raises(NotImplementedError):
        alignments.read_alignments(spark, "x.cram")
    with pytest.raises(ValueError):
        alignments.format_of("x.sam")


def test_fasta(spark, tmp_path):
    sequence = "".join("acgt"[(i * i + i // 7) % 4] for i in range(2503))
    lines = "\n".join(sequence[i : i + 60] for i in range(0, len(sequence), 60))
    (tmp_path / "r.fa").write_text(f">one first\n{lines}\n\n>two\nACGT\n")
    chunks = fasta.read_fasta(spark, str(tmp_path / "r.fa")).cache()
    for start, end in ((0, 10), (990, 1015), (2490, 2503), (0, 2503)):
        assert fasta.fetch_range(chunks, "one", start, end) == sequence[start:end].upper()
    assert fasta.fetch_range(chunks, "two", 1, 3) == "CG" and fasta.fetch_range(chunks, "one", 5, 5) == ""
    assert fasta.fetch_range(chunks, "one", 2500, 2600) is None and fasta.fetch_range(chunks, "three", 0, 1) is None
    assert {r.chunk: len(r.bases) for r in chunks.where("contig = 'one'").collect()} == {0: 2000, 1: 1503, 2: 503}


def test_vcf_files(spark, tmp_path):
    rows = [("c", 10 * i, 10 * i + 1, "A", ["C"], 30.0, ["PASS"], [0, 1], 20) for i in range(3000)]
    df = spark.createDataFrame(rows, "contig string, start long, end long, ref string, alts array<string>, qual double, filter array<string>, gt array<int>, gq int")
    contigs = [(0, "c", 40_000)]
    for name in ("a.vcf", "a.vcf.gz"):
        vcf.write_file(df, str(tmp_path / name), contigs, ["s"], keys=("GT", "GQ"))
    text = (tmp_path / "a.vcf").read_bytes()
    assert gzip.decompress((tmp_path / "a.vcf.gz").read_bytes()) == text
    assert text.splitlines()[-1] == b"c\t29991\t.\tA\tC\t30\tPASS\t.\tGT:GQ\t0/1:20"
    index = alignments.unpack_blocks((tmp_path / "a.vcf.gz.tbi").read_bytes())
    assert index[:4] == b"TBI\1" and struct.unpack_from("<i", index, 4) == (1,)
    # the second window's offset points at a line inside it
    windows = struct.unpack("<2Q", index[-16:])
    packed = (tmp_path / "a.vcf.gz").read_bytes()
    line = alignments.unpack_blocks(packed[windows[1] >> 16 :])[windows[1] & 0xFFFF :].split(b"\n")[0]
    assert int(line.split(b"\t")[1]) - 1 == 16390
    vcf.write_parts(df, str(tmp_path / "parts"), contigs, keys=("GT", "GQ"))
    assert vcf.read_records(spark.read.text(str(tmp_path / "parts"))).where(F.col("call") == "0/1:20").count() == 3000
