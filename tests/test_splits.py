"""Splittable sources and sharded sinks: the same rows however files are cut."""

import gzip
import random
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from locusflow.sources import alignments, bam, bgzf, records, tfrecord

CONTIGS = [("chr1", 400_000), ("chr2", 400_000)]
COLUMNS = ["contig", "ref_start", "ref_end", "cigar", "seq", "bq", "mapq", "flag", "is_rev", "tlen", "name", "mate", "hp"]


def some_reads(n, seed=1, longest=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.randint(1, longest)
        start, rev, mate = rng.randint(0, 300_000), rng.random() < 0.5, rng.randint(1, 2)
        cigar, end = [{"op": "S", "len": 1}, {"op": "M", "len": size}, {"op": "D", "len": 3}], start + size + 3
        contig = rng.choice(["chr1", "chr2", None])
        if contig is None:
            start, end = -1, size + 2
        seq = "".join(rng.choices("ACGTN", k=size + 1))
        flag = rng.choice([0, 4, 1024]) | (16 if rev else 0) | (64 if mate == 1 else 128)
        rows.append((contig, start, end, cigar, seq, [rng.randint(0, 60) for _ in seq], rng.randint(0, 60), flag, rev, rng.randint(-500, 500), f"r{i}", mate, rng.randint(0, 2), i))
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """3000 reads as two indexed files of small blocks."""
    path = tmp_path_factory.mktemp("bam")
    reads = spark.createDataFrame(some_reads(3000), bam.READS_TYPE)
    alignments.write_alignments(reads, f"{path}/reads@2.bam", CONTIGS, block_bytes=4000)
    return path


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("split", [7_001, 40_000, 1 << 30])
def test_reads_come_back_however_files_are_cut(spark, folder, split):
    want = rows_of(spark.createDataFrame(some_reads(3000), bam.READS_TYPE))
    assert sorted(p.name for p in folder.iterdir()) == ["reads-00000-of-00002.bam", "reads-00000-of-00002.bam.bai", "reads-00001-of-00002.bam", "reads-00001-of-00002.bam.bai"]
    got = alignments.read_alignments(spark, str(folder), split_bytes=split)
    if split == 7_001:
        assert got.rdd.getNumPartitions() >= 8
    assert rows_of(got) == want
    # the ordinal is unique within a file and follows its order
    ordinals = got.groupBy("read_ordinal", "contig", "name").count().where("count > 1").count()
    assert ordinals == 0


def test_ordinals_do_not_depend_on_the_cut(spark, folder):
    path = str(folder / "reads-00000-of-00002.bam")
    whole = [(r.name, r.read_ordinal) for r in alignments.read_alignments(spark, path).collect()]
    cut = [(r.name, r.read_ordinal) for r in alignments.read_alignments(spark, path, split_bytes=9_000).orderBy("read_ordinal").collect()]
    assert cut == whole


@pytest.mark.parametrize("region", [("chr1", 0, 400_000), ("chr2", 100_000, 100_001), ("chr1", 16_384, 32_768), ("chr2", 299_000, 500_000), ("chr9", 0, 10)])
def test_region_by_index(spark, folder, region):
    contig, lo, hi = region
    want = [r for r in some_reads(3000) if r[0] == contig and r[1] < hi and r[2] > lo]
    for split in (5_000, 1 << 30):
        got = alignments.read_alignments(spark, str(folder), split_bytes=split, region=region)
        assert rows_of(got) == rows_of(spark.createDataFrame(want, bam.READS_TYPE))
    if region == ("chr2", 100_000, 100_001):
        reader = bam.BamReader({"path": str(folder), "contig": contig, "start": str(lo), "end": str(hi)})
        parts = reader.partitions()
        read = sum(p.hi - p.lo for p in parts)
        assert 0 < read < 0.2 * sum(f.stat().st_size for f in folder.iterdir() if f.suffix == ".bam")


def test_records_longer_than_a_split(spark, tmp_path):
    rows = some_reads(20, seed=2, longest=30_000)
    alignments.write_alignments(spark.createDataFrame(rows, bam.READS_TYPE), f"{tmp_path}/long@1.bam", CONTIGS)
    got = alignments.read_alignments(spark, str(tmp_path), split_bytes=2_000)
    assert rows_of(got) == rows_of(spark.createDataFrame(rows, bam.READS_TYPE))


def test_empty_and_bad_files(spark, tmp_path):
    alignments.write_alignments(spark.createDataFrame([], bam.READS_TYPE), f"{tmp_path}/none@3.bam", CONTIGS)
    assert len(list(tmp_path.iterdir())) == 6
    assert alignments.read_alignments(spark, str(tmp_path), split_bytes=50).count() == 0
    (tmp_path / "bad.bam").write_bytes(bgzf.pack_blocks(b"SAM\1"))
    with pytest.raises(Exception, match="not a BAM file"):
        alignments.read_alignments(spark, str(tmp_path / "bad.bam")).count()
    whole = bytes(Path(tmp_path / "none-00000-of-00003.bam").read_bytes())
    row = dict(zip(COLUMNS, some_reads(1)[0], strict=False)) | {"contig": "chr1", "ref_start": 5}
    data = bam.header_bytes(CONTIGS) + bam.encode_record(row, {"chr1": 0, "chr2": 1})
    (tmp_path / "cut.bam").write_bytes(bgzf.pack_blocks(data[:-1]))
    assert whole
    with pytest.raises(Exception, match="cut record"):
        alignments.read_alignments(spark, str(tmp_path / "cut.bam")).count()


def test_a_record_is_not_mistaken(spark, tmp_path):
    """Qualities that hold the bytes of a whole record don't begin one."""
    plain = dict(zip(COLUMNS, some_reads(1, seed=3)[0], strict=False)) | {"contig": "chr1", "ref_start": 7, "cigar": [{"op": "M", "len": 4}], "seq": "ACGT", "bq": [1, 2, 3, 4]}
    inner = bam.encode_record(plain, {"chr1": 0})
    rows = []
    for i in range(200):
        bq = list(inner) + [9] * 300
        rows.append(("chr1", 10 * i, 10 * i + len(bq), [{"op": "M", "len": len(bq)}], "A" * len(bq), bq, 60, 64, False, 0, f"n{i}", 1, 0, i))
    alignments.write_alignments(spark.createDataFrame(rows, bam.READS_TYPE), f"{tmp_path}/in@1.bam", CONTIGS, block_bytes=500)
    got = alignments.read_alignments(spark, str(tmp_path), split_bytes=300)
    assert rows_of(got) == rows_of(spark.createDataFrame(rows, bam.READS_TYPE))


def payloads(n, seed=4):
    rng = random.Random(seed)
    return [rng.randbytes(rng.choice([0, 1, 12, 300, 5000])) for _ in range(n)]


@pytest.mark.parametrize("name", ["part@3", "part@1.tfrecord", "part@4.tfrecord.gz"])
def test_record_shards(spark, tmp_path, name):
    rows = [(i, p) for i, p in enumerate(payloads(500))]
    df = spark.createDataFrame(rows, "i long, payload binary")
    records.write_record_files(df, f"{tmp_path}/{name}", "i")
    spec = name.split("@")
    n = int(spec[1].split(".")[0])
    files = sorted(p.name for p in tmp_path.iterdir())
    assert len(files) == n and all(f"-of-{n:05d}" in f for f in files)
    for split in (1_000, 50_000, 1 << 30):
        got = records.read_record_files(spark, str(tmp_path), split_bytes=split).orderBy("path", "ordinal").collect()
        assert [bytes(r.payload) for r in got] == [p for _, p in rows]


def test_frames_in_a_payload(spark, tmp_path):
    """A file's bytes inside a payload: what is found there isn't followed by a frame where the payload ends."""
    inner = tfrecord.frame(b"x" * 100)
    rows = [inner + bytes([i]) * 50 for i in range(60)]
    records.write_record_files(spark.createDataFrame([(p,) for p in rows], "payload binary"), f"{tmp_path}/a@1")
    got = records.read_record_files(spark, str(tmp_path), split_bytes=90).collect()
    assert sorted(bytes(r.payload) for r in got) == sorted(rows)


def test_frame_starts_agree_with_the_sums():
    data = b"junk" + tfrecord.frame(b"abc") + b"more junk" + tfrecord.frame(b"")
    want = [i for i in range(len(data) - 11) if struct.unpack_from("<I", data, i + 8)[0] == tfrecord.masked_crc(data[i : i + 8])]
    assert records.frame_starts(data).tolist() == want == [4, 4 + 19 + 9]


def test_bad_records(spark, tmp_path):
    whole = tfrecord.frame(b"abcdef") * 3
    for i, bad in enumerate((whole[:-1], whole[:30] + b"?" + whole[31:])):
        (tmp_path / f"bad{i}").write_bytes(bad)
        with pytest.raises(Exception, match="cut record|wrong CRC"):
            records.read_record_files(spark, str(tmp_path / f"bad{i}")).count()
    both = gzip.compress(tfrecord.frame(b"x")) + gzip.compress(tfrecord.frame(b"y"))
    (tmp_path / "two.gz").write_bytes(both)
    assert [bytes(r.payload) for r in records.read_record_files(spark, str(tmp_path / "two.gz")).orderBy("ordinal").collect()] == [b"x", b"y"]


def test_rows_as_examples(spark):
    schema = "name string, n long, small int, ok boolean, share double, raw binary, alts array<string>, ad array<int>, probs array<double>"
    rows = [("a", -5, 7, True, 0.1, b"\0\1", ["C", ""], [0, -1, 3], [0.25, 1e-300]), (None, 1 << 62, None, False, None, b"", [], [], None), ("é", 0, 0, None, -0.0, None, ["x" * 300], None, [])]
    df = spark.createDataFrame(rows, schema)
    back = records.decode_rows(records.encode_rows(df), schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    example = records.encode_rows(spark.createDataFrame([(bytes(12),)], "image binary"))
    assert records.decode_rows(example, "image binary", {"image": 12}).count() == 1
    with pytest.raises(Exception, match="image has not 13 bytes"):
        records.decode_rows(example, "image binary", {"image": 13}).collect()


def test_output_messages(spark):
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    payload = field(1, b"variant") + field(2, field(1, bytes([0, 1]))) + field(3, struct.pack("<3d", 0.5, 0.25, 0.25))
    (r,) = records.decode_outputs(spark.createDataFrame([(payload,)], "payload binary")).collect()
    assert (bytes(r.variant), r.alt_idx, r.probs) == (b"variant", [0, 1], [0.5, 0.25, 0.25])


def test_nothing_is_named_until_all_is_written(spark, tmp_path):
    bad = spark.range(40).select(F.when(F.col("id") == 39, F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.lit(b"x")).alias("payload"))
    with pytest.raises(Exception, match="stop"):
        records.write_record_files(bad, f"{tmp_path}/n@2")
    assert not [p for p in tmp_path.iterdir() if not p.name.startswith("_")]
