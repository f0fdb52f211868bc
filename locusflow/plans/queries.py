"""Queries over the driver's tables, one or more for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles, cigar, fields, genotype, phred, ranges, vcf_text
from ..operators import alt_aligned, assembly, examples, genotyping, images, inference, intervals, methylation, phasing, pileup, shard_phases, small_model
from ..operators import channels as ch
from ..sources import alignments, records
from ..sources.files import list_files
from . import fixtures as fx
from .fixtures import table
from .lineage import scratch, stored
from .stages import Stage, run_stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.allele_facts(fx.reads(spark, sf_dir), fx.reference(spark, sf_dir))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.counted_sites(fx.reads(spark, sf_dir), fx.reference(spark, sf_dir))


@query(f"WITH {fx.READS_SQL} SELECT name, contig, ref_start FROM reads WHERE flag NOT IN (4, 1024) AND mapq >= 20 AND contig = 'chr2' AND ref_end >= 500 AND ref_start < 1500")
def q_read_filter(spark, sf_dir):
    """Flags and mapping quality, then a region."""
    return pileup.region_reads(pileup.passing_reads(fx.reads(spark, sf_dir), 20), "chr2", 500, 1500).select("name", "contig", "ref_start")


@query(f"""WITH {fx.READS_SQL} SELECT name, cigar_text, cigar_text AS formatted, ref_end - ref_start AS ref_bases, read_len AS read_bases,
 CASE cigar_text WHEN '20M' THEN '10M' WHEN '3S17M' THEN '10M' WHEN '8M2D10M' THEN '3M2D5M' ELSE '3M2I7M' END AS trimmed,
 CASE cigar_text WHEN '20M' THEN ref_start + 9 WHEN '3S17M' THEN ref_start + 6 WHEN '8M2D10M' THEN ref_start + 11 ELSE ref_start + 7 END AS ninth FROM reads""")
def q_cigar(spark, sf_dir):
    """Parse, format, spans, trim, positions."""
    r = fx.reads(spark, sf_dir).withColumn("cigar", cigar.parse_cigar(F.col("cigar_text")))
    return r.select(
        "name", "cigar_text", cigar.format_cigar(F.col("cigar")).alias("formatted"), cigar.ref_span(F.col("cigar")).cast("long").alias("ref_bases"), cigar.read_span(F.col("cigar")).alias("read_bases"),
        cigar.format_cigar(cigar.trim_cigar(F.col("cigar"), F.lit(5), F.lit(10))).alias("trimmed"), cigar.haplotype_to_ref(F.col("cigar"), F.lit(9), F.col("ref_start")).alias("ninth"),
    )


_FILE_CONTIGS = [(f"chr{c}", 1 << 28) for c in (1, 2, 3)]


def _bam_folder(spark, sf_dir):
    """All reads as four indexed BAM files in the shared folder, and a size that cuts them into about 64 ranges, of 16 KiB at least."""
    folder = scratch(spark, "bam")
    alignments.write_alignments(fx.reads(spark, sf_dir), f"{folder}/reads@4.bam", _FILE_CONTIGS)
    return folder, max(1 << 14, sum(size for _, size in list_files([folder], (".bam",))) // 64)


_FILE_COLUMNS = "name, contig, ref_start, ref_end, cigar_text, seq, bq, mapq, flag, is_rev, tlen, mate, hp"
_FILE_READS_SQL = f"""{fx.READS_SQL}, spelled AS (SELECT rid, string_agg(base, '' ORDER BY k) AS seq, list(q ORDER BY k) AS bq FROM read_bases GROUP BY rid)
 SELECT {_FILE_COLUMNS} FROM reads JOIN spelled USING (rid)"""


def _file_columns(reads):
    """The flag's bits of strand and mate are columns of their own."""
    plain = F.col("flag").bitwiseAND(F.lit(4 | 1024)).alias("flag")
    return reads.withColumn("cigar_text", cigar.format_cigar(F.col("cigar"))).select(*(plain if c == "flag" else c for c in _FILE_COLUMNS.split(", ")))


@query(f"WITH {_FILE_READS_SQL}")
def q_bam_reads(spark, sf_dir):
    """Reads written as sorted, indexed BAM files and read back in ranges of blocks."""
    folder, split = _bam_folder(spark, sf_dir)
    return _file_columns(alignments.read_alignments(spark, folder, split))


@query(f"WITH {_FILE_READS_SQL} WHERE contig = 'chr2' AND ref_start < 1500 AND ref_end > 500")
def q_bam_region(spark, sf_dir):
    """A region of BAM files, by their indexes."""
    folder, split = _bam_folder(spark, sf_dir)
    return _file_columns(alignments.read_alignments(spark, folder, split, ("chr2", 500, 1500)))


_OUTPUT_ROW = "mid string, contig string, start long, end long, ref string, alts array<string>, dp long, ad array<long>, vaf array<double>, alt_idx array<int>, probs array<double>"


def _record_outputs(spark, sf_dir):
    """Outputs of two models as shards of record files, the small model's for single alternates, read and united."""
    folder, made = scratch(spark, "outputs"), fx.outputs(spark, sf_dir)
    made = made.withColumn("mid", F.when(F.size("alts") == 1, "small").otherwise("cnn"))
    for mid, shards in (("small", 3), ("cnn", 5)):
        records.write_record_files(records.encode_rows(made.where(F.col("mid") == mid)), f"{folder}/{mid}@{shards}.tfrecord")
    return records.decode_rows(records.read_record_files(spark, folder, 1 << 18), _OUTPUT_ROW)


@query(f"""WITH raw AS ({fx._OUTPUTS.format(s="varchar", gen="(SELECT unnest([0, 1, 2]) AS i)")})
 SELECT CASE WHEN multi THEN 'cnn' ELSE 'small' END AS mid, contig, start, e AS "end", ref, CASE WHEN multi THEN [alt1, alt2] ELSE [alt1] END AS alts, (ref_n + n1 + CASE WHEN multi THEN n2 ELSE 0 END)::BIGINT AS dp,
  CASE WHEN multi THEN [ref_n::BIGINT, n1, n2] ELSE [ref_n::BIGINT, n1] END AS ad, CASE WHEN i = 2 THEN [0, 1] ELSE [i] END AS alt_idx, [w0 / (w0 + w1 + w2), w1 / (w0 + w1 + w2), w2 / (w0 + w1 + w2)] AS probs FROM raw""")
def q_record_outputs(spark, sf_dir):
    """Outputs of two models through sharded record files."""
    return _record_outputs(spark, sf_dir).drop("vaf")


@query(f"WITH {fx.FACTS_SQL} SELECT contig, pos, read_key, base, q AS bq FROM aligned")
def q_aligned_bases(spark, sf_dir):
    """Bases at reference positions."""
    good = fx.reads(spark, sf_dir).where("mapq >= 10")
    return pileup.aligned_bases(good).select("contig", "pos", "read_key", "base", "bq")


@query(f"WITH {fx.FACTS_SQL} SELECT contig, pos, ref_base, ref_count, ref_low_count, alt_count, ref_count + ref_low_count + alt_count AS depth FROM counts")
def q_allele_counts(spark, sf_dir):
    """A1, A6, A7, P3, P4, J13."""
    return pileup.total_depth(pileup.allele_counts(_sites(spark, sf_dir)))


@query(f"WITH {fx.FACTS_SQL} SELECT contig, pos, type, bases, n FROM alleles UNION ALL SELECT contig, pos, 1, ref_base, ref_count FROM counts WHERE ref_count > 0")
def q_allele_summary(spark, sf_dir):
    """A2, A3."""
    return pileup.summarize_alleles(_sites(spark, sf_dir))


@query(f"""WITH {fx.FACTS_SQL} SELECT contig, pos // 10 * 10 AS span_start, type, bases, sum(n)::BIGINT AS n FROM alleles GROUP BY ALL
 UNION ALL SELECT contig, pos // 10 * 10, 1, min_by(ref_base, pos), sum(ref_count + ref_low_count)::BIGINT AS n FROM counts GROUP BY contig, pos // 10 * 10 HAVING sum(ref_count + ref_low_count) > 0""")
def q_allele_sum_span(spark, sf_dir):
    """A4: counts over spans, low quality included."""
    return pileup.sum_alleles(_sites(spark, sf_dir), low_quality=True, span=10)


@query(f"WITH {fx.FACTS_SQL} SELECT contig, pos // 10 * 10 AS span_start, sum(alt_count)::BIGINT AS n FROM counts GROUP BY ALL")
def q_total_alleles(spark, sf_dir):
    """A5."""
    return pileup.total_alleles(_sites(spark, sf_dir), span=10)


@query(f'WITH {fx.CANDIDATES_SQL} SELECT contig, start, "end", ref, alts, dp, ad, vaf FROM cands WHERE length(ref) = 1 AND list_max(list_transform(alts, lambda a: length(a))) = 1')
def q_snv_candidates(spark, sf_dir):
    """The flagship; candidates that substitute one base."""
    return pileup.candidates(_sites(spark, sf_dir)).where(alleles.is_snp(F.col("ref"), F.col("alts")))


@query(f'WITH {fx.CANDIDATES_SQL} SELECT contig, start, "end", ref, alts, dp, ad, vaf FROM cands')
def q_candidates(spark, sf_dir):
    """All candidates, with insertions and deletions."""
    return pileup.candidates(_sites(spark, sf_dir))


_SCORES_SQL = f"""{fx.FACTS_SQL},
strong AS (SELECT a.contig, a.pos, a.type, length(a.bases) AS size, a.n FROM alleles a JOIN counts k USING (contig, c, pos)
  WHERE a.n >= 2 AND NOT (a.type = 3 AND length(a.bases) <= 2 AND a.n / (k.ref_count + k.ref_low_count + k.alt_count) < 0.08)),
scores AS (SELECT contig, pos, sum(n)::BIGINT AS score FROM (
  SELECT contig, n, unnest(CASE type WHEN 2 THEN range(pos, pos + 1) WHEN 4 THEN range(pos + 1, pos + size) ELSE range(greatest(pos + 2 - size, 0), pos + size) END) AS pos FROM strong) GROUP BY ALL)"""


@query(f"WITH {_SCORES_SQL} SELECT contig, pos, score FROM scores")
def q_window_scores(spark, sf_dir):
    """A12, P6."""
    return pileup.window_scores(_sites(spark, sf_dir))


_ISLANDS_SQL = f"""{_SCORES_SQL}, runs AS (SELECT contig, pos, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS run FROM scores WHERE score >= 3),
islands AS (SELECT contig, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS n FROM runs GROUP BY contig, run)"""


@query(f'WITH {_ISLANDS_SQL} SELECT contig, start, "end", n FROM islands')
def q_islands(spark, sf_dir):
    """W1."""
    return intervals.islands(pileup.window_scores(_sites(spark, sf_dir)), 3)


_MERGED_SQL = f"""{_ISLANDS_SQL}, padded AS (SELECT contig, greatest(start - 5, 0) AS start, "end" + 5 AS "end" FROM islands),
marked AS (SELECT *, CASE WHEN start > max("end") OVER w THEN 1 ELSE 0 END AS fresh FROM padded WINDOW w AS (PARTITION BY contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM marked),
windows AS (SELECT contig, min(start) AS start, max("end") AS "end" FROM numbered GROUP BY contig, g)"""


def _windows(spark, sf_dir):
    return intervals.merge_intervals(intervals.islands(pileup.window_scores(_sites(spark, sf_dir)), 3), pad=5)


@query(f'WITH {_MERGED_SQL} SELECT contig, start, "end" FROM windows')
def q_merge_windows(spark, sf_dir):
    """W2."""
    return _windows(spark, sf_dir)


@query(f'WITH {_MERGED_SQL} SELECT w.contig, w.start, w."end", count(*) AS n FROM windows w JOIN reads r ON r.contig = w.contig AND r.ref_start < w."end" AND w.start < r.ref_end GROUP BY ALL')
def q_window_reads(spark, sf_dir):
    """Windows and the reads that overlap them."""
    r = fx.reads(spark, sf_dir).select("contig", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"))
    return intervals.interval_join(_windows(spark, sf_dir), r, bin_width=64).groupBy("contig", "start", "end").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {fx.CANDIDATES_SQL} SELECT k.contig, k.start, r.name FROM cands k JOIN reads r ON r.contig = k.contig AND r.ref_start < k."end" + 5 AND k.start - 5 < r.ref_end""")
def q_candidate_reads(spark, sf_dir):
    """Candidates and reads within five bases."""
    r = fx.reads(spark, sf_dir).select("contig", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"), "name")
    return intervals.interval_join(pileup.candidates(_sites(spark, sf_dir)), r, bin_width=64, buffer=5).select("contig", "start", F.col("r_name").alias("name"))


@query(f"""WITH {fx.CANDIDATES_SQL}, points AS (SELECT contig, start AS pos FROM cands)
 SELECT p.contig, p.pos, r.name FROM points p JOIN reads r ON r.contig = p.contig AND r.ref_start <= p.pos AND p.pos < r.ref_end""")
def q_point_in_interval(spark, sf_dir):
    """J3's join: points inside reads."""
    r = fx.reads(spark, sf_dir).select("contig", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"), "name")
    points = pileup.candidates(_sites(spark, sf_dir)).select("contig", F.col("start").alias("pos"))
    return intervals.point_join(points, r, bin_width=64).select("contig", "pos", F.col("r_name").alias("name"))


@query(f"""WITH {fx.CANDIDATES_SQL}, around AS (SELECT contig, c, start AS pos, unnest(range(start - 25, start + 26)) AS p FROM cands)
 SELECT a.contig, a.pos, list(coalesce(CASE WHEN k.ref_count + k.alt_count > 0 THEN k.alt_count * 100 // (k.ref_count + k.alt_count) END, 0)::INT ORDER BY p) AS context
 FROM around a LEFT JOIN counts k ON k.contig = a.contig AND k.pos = a.p GROUP BY a.contig, a.pos""")
def q_vaf_context(spark, sf_dir):
    """A9, J5."""
    at = stored(_sites(spark, sf_dir), "sites")
    return pileup.vaf_context(pileup.allele_counts(at), pileup.candidates(at).select("contig", F.col("start").alias("pos")))


@query(f'WITH {fx.CALLS_SQL} SELECT contig, start, "end", ref, alts, list_transform(probs, lambda p: round(p, 9)) AS probs FROM called')
def q_fuse_outputs(spark, sf_dir):
    """Groups, pruning and fusion."""
    fused = genotyping.fuse_outputs(genotyping.group_outputs(fx.outputs(spark, sf_dir)))
    return fused.select("contig", "start", "end", "ref", "alts", F.transform("probs", lambda p: F.round(p, 9)).alias("probs"))


@query(f'WITH {fx.CALLS_SQL} SELECT contig, start, gt, gq, qual, pl, filter FROM calls')
def q_calls(spark, sf_dir):
    """Calls and filters."""
    return genotyping.call_variants(fx.outputs(spark, sf_dir)).select("contig", "start", "gt", "gq", "qual", "pl", F.col("filter")[0].alias("filter"))


_GT_TEXT = "array_to_string(list_transform(gt, lambda g: CASE WHEN g < 0 THEN '.' ELSE g::VARCHAR END), '/')"
_QUAL_TEXT = "regexp_replace(printf('%.1f', round(qual, 1)), '\\.0$', '')"


@query(f"""WITH {fx.CALLS_SQL} SELECT contig || chr(9) || start + 1 || chr(9) || '.' || chr(9) || ref || chr(9) || array_to_string(alts, ',') || chr(9) || {_QUAL_TEXT} || chr(9) || filter || chr(9) || '.' || chr(9) || 'GT:GQ:DP:AD:MID:PL' || chr(9)
 || {_GT_TEXT} || ':' || gq || ':' || dp || ':' || array_to_string(ad, ',') || ':cnn:' || array_to_string(pl, ',') AS line FROM calls""")
def q_vcf_lines(spark, sf_dir):
    """K4, K6 to K8: record lines."""
    called = genotyping.call_variants(fx.outputs(spark, sf_dir))
    return called.select(vcf_text.record_text(("GT", "GQ", "DP", "AD", "MID", "PL"), set(called.columns)).alias("line"))


def _with_info(outputs):
    """Outputs with a map of fields: sums and shares made of ad and vaf."""
    ad = F.col("ad").cast("array<double>")
    return outputs.withColumn("info", F.create_map(
        F.lit("MD"), F.transform(ad, lambda x, i: x + i + 1), F.lit("NAD"), F.transform(ad, lambda x: 2 * x), F.lit("MF"), F.transform(ad, lambda x: x / 16), F.lit("NAF"), F.transform("vaf", lambda x: x / 2), F.lit("OTHER"), F.array(F.lit(1.0), F.lit(2.0)),
    ))


_FLOATS_TEXT = "array_to_string(list_transform({}, lambda x: regexp_replace(printf('%.6f', x), '\\.?0+$', '')), ',')"


@query(f"""WITH {fx.CALLS_SQL}, own AS (SELECT n.contig, n.start, n.ref, n.alts, list_concat([ref_n], list_concat(CASE WHEN keep1 THEN [n1] ELSE [] END, CASE WHEN keep2 THEN [n2] ELSE [] END)) AS ad,
  list_concat([ref_n + 1], list_concat(CASE WHEN keep1 THEN [n1 + 2] ELSE [] END, CASE WHEN keep2 THEN [n2 + 3] ELSE [] END)) AS md,
  list_concat(CASE WHEN keep1 THEN [n1 / greatest(dp, 1) / 2] ELSE [] END, CASE WHEN keep2 THEN [n2 / greatest(dp, 1) / 2] ELSE [] END) AS naf FROM names n)
 SELECT contig, start, array_to_string(alts, ',') AS alternates, array_to_string(ad, ',') || ':' || array_to_string(list_transform(ad, lambda x: 2 * x), ',') || ':' || {_FLOATS_TEXT.format("naf")} || ':' || array_to_string(md, ',') || ':'
  || {_FLOATS_TEXT.format("list_transform(ad, lambda x: x / 16)")} || ':.' AS fields FROM own""")
def q_field_maps(spark, sf_dir):
    """List fields of calls when alternates are pruned, as text."""
    called = fields.with_fields(genotyping.call_variants(_with_info(fx.outputs(spark, sf_dir))), "MD", "NAD", "MF", "NAF", "PS")
    columns = set(called.columns) - {"ps"}
    return called.select("contig", "start", F.array_join("alts", ",").alias("alternates"), F.concat_ws(":", *(vcf_text.call_field(k, columns) for k in ("AD", "NAD", "NAF", "MD", "MF", "PS"))).alias("fields"))


@query(f"""WITH {fx.CANDIDATES_SQL}, support AS (SELECT k.contig, k.start, k."end", a.bases, a.read_key FROM cands k JOIN (SELECT contig, pos, read_key, a.bases AS bases FROM read_alleles) a ON a.contig = k.contig AND a.pos = k.start AND list_contains(k.alts, a.bases))
 SELECT contig, start, count(DISTINCT bases) FILTER (WHERE length(bases) = "end" - start) AS n_substitutions, count(DISTINCT bases) FILTER (WHERE length(bases) <> "end" - start) AS n_indels, count(*) FILTER (WHERE length(bases) = "end" - start) AS substitution_depth FROM support GROUP BY ALL""")
def q_allele_type_counts(spark, sf_dir):
    """alternates by type, and the depth of substitutions."""
    at, own = _sites(spark, sf_dir), pileup.read_alleles(_facts(spark, sf_dir)).select("contig", F.col("pos").alias("start"), F.col("bases").alias("allele"), "read_key")
    support = pileup.candidates(at).select("contig", "start", "end", "alts").join(own, ["contig", "start"]).where(F.array_contains("alts", F.col("allele")))
    return phasing.allele_type_counts(support).drop("end")


_BLOCKS_SQL = """blocks AS (SELECT 'chr' || (event_id % 3 + 1)::VARCHAR AS contig, event_id * 20 AS start, event_id * 20 + 20 - event_id % 3 AS "end", (10 + event_id % 30)::INT AS min_dp FROM events)"""


def _blocks(spark, sf_dir):
    e = F.col("event_id")
    made = table(spark, sf_dir, "events")
    return made.select(F.concat(F.lit("chr"), (e % 3 + 1).cast("string")).alias("contig"), (e * 20).alias("start"), (e * 20 + 20 - e % 3).alias("end"), (10 + e % 30).cast("int").alias("min_dp"), e.alias("block"))


_SUBTRACT_SQL = f"""{fx.CALLS_SQL}, {_BLOCKS_SQL},
taken AS (SELECT contig, start, max("end") AS "end" FROM calls GROUP BY ALL),
cut AS (SELECT b.contig, b.start, b."end", b.min_dp, v.start AS vs, v."end" AS ve, lag(v."end") OVER w AS prev, lead(v.start) OVER w AS nxt
  FROM blocks b JOIN taken v ON v.contig = b.contig AND v.start < b."end" AND b.start < v."end" WINDOW w AS (PARTITION BY b.contig, b.start ORDER BY v.start)),
rests AS (
  SELECT contig, coalesce(prev, start) AS start, vs AS "end", min_dp FROM cut WHERE coalesce(prev, start) < vs
  UNION ALL SELECT contig, ve, "end", min_dp FROM cut WHERE nxt IS NULL AND ve < "end"
  UNION ALL SELECT contig, start, "end", min_dp FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM taken v WHERE v.contig = b.contig AND v.start < b."end" AND b.start < v."end"))"""


@query(f'WITH {_SUBTRACT_SQL} SELECT contig, start, "end", min_dp FROM rests')
def q_interval_subtract(spark, sf_dir):
    """U3, J9's subtraction."""
    called = genotyping.call_variants(fx.outputs(spark, sf_dir))
    return intervals.subtract_intervals(_blocks(spark, sf_dir), called.select("contig", "start", "end"), bin_width=64).drop("block")


@query(f"""WITH {_SUBTRACT_SQL} SELECT contig || chr(9) || start + 1 || chr(9) || '.' || chr(9) || 'N' || chr(9) || '<*>' || chr(9) || '0' || chr(9) || '.' || chr(9) || 'END=' || "end" || chr(9) || 'GT:GQ:MIN_DP:PL' || chr(9) || '0/0:50:' || min_dp || ':0,30,90' AS line FROM rests
 UNION ALL SELECT contig || chr(9) || start + 1 || chr(9) || '.' || chr(9) || ref || chr(9) || array_to_string(alts, ',') || ',<*>' || chr(9) || {_QUAL_TEXT} || chr(9) || filter || chr(9) || '.' || chr(9) || 'GT:GQ:DP:AD:VAF:MID:PL' || chr(9)
 || {_GT_TEXT} || ':' || gq || ':' || dp || ':' || array_to_string(ad, ',') || ',0:' || array_to_string(list_transform(ad[2:], lambda n: regexp_replace(printf('%.6f', n / greatest(dp, 1)), '\\.?0+$', '')), ',') || ',0:cnn:'
 || CASE WHEN bare THEN '0,0' ELSE array_to_string(list_transform(probs, lambda p: trunc(-10 * (log10(greatest(p, 1.25e-10)) - log10(greatest(list_max(probs), 1.25e-10))))::INT), ',') END
 || repeat(',990', length(alts) + 2) AS line FROM calls""")
def q_gvcf_lines(spark, sf_dir):
    """gVCF records of variants and of what they leave of blocks."""
    called = genotyping.call_variants(fx.outputs(spark, sf_dir))
    blocks = _blocks(spark, sf_dir).drop("block").withColumn("ref", F.lit("N")).withColumn("gt", F.array(F.lit(0), F.lit(0))).withColumn("gq", F.lit(50)).withColumn("gl", F.array(F.lit(0.0), F.lit(-3.0), F.lit(-9.0))).withColumn("qual", F.lit(0.0))
    merged = genotyping.merge_gvcf(called, blocks, bin_width=64)
    merged = merged.withColumn("filter", F.coalesce("filter", F.array().cast("array<string>")))
    return merged.select(vcf_text.gvcf_text(set(merged.columns)).alias("line"))




@query("""WITH v AS (SELECT p_partkey AS k, substring('ACGTTGCA', 1 + (p_partkey % 4)::INT, 1 + (p_partkey % 5)::INT) AS ref, substring('ACGTCGCA', 1 + (p_partkey % 3)::INT, 1 + (p_partkey % 4)::INT) AS alt FROM part),
 s AS (SELECT *, least(length(ref), length(alt)) - 1 AS m FROM v),
 suf AS (SELECT *, coalesce(list_min(list_filter(range(1, m + 1), lambda i: ref[-i:][1:1] <> alt[-i:][1:1])) - 1, m) AS sx FROM s),
 cut AS (SELECT *, substring(ref, 1, length(ref) - sx) AS r, substring(alt, 1, length(alt) - sx) AS a FROM suf),
 pre AS (SELECT *, least(length(r), length(a)) - 1 AS m2 FROM cut),
 px AS (SELECT *, coalesce(list_min(list_filter(range(1, m2 + 1), lambda i: r[i:i] <> a[i:i])) - 1, m2) AS p FROM pre)
 SELECT k, substring(r, p + 1) AS sref, substring(a, p + 1) AS salt, r || '->' || a AS arrow,
  CASE WHEN length(ref) = length(alt) THEN 2 WHEN length(ref) < length(alt) THEN 3 ELSE 4 END AS kind,
  CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 1 WHEN length(ref) > 1 OR length(alt) > 1 THEN 2 ELSE 0 END AS vclass,
  length(alt) > length(ref) AS ins, length(alt) < length(ref) AS del, reverse(translate(ref, 'ACGT', 'TGCA')) AS rc FROM px""")
def q_simplify_alleles(spark, sf_dir):
    """F13, F16, F18 to F20, F22."""
    table(spark, sf_dir, "part").createOrReplaceTempView("lf_part")
    v = spark.sql("SELECT p_partkey AS k, substring('ACGTTGCA', cast(1 + p_partkey % 4 as int), cast(1 + p_partkey % 5 as int)) AS ref, substring('ACGTCGCA', cast(1 + p_partkey % 3 as int), cast(1 + p_partkey % 4 as int)) AS alt FROM lf_part")
    r, a, alts = F.col("ref"), F.col("alt"), F.array("alt")
    s = v.withColumn("s", alleles.simplify_alleles(r, a))
    return s.select(
        "k", F.col("s.ref").alias("sref"), F.col("s.alt").alias("salt"), alleles.simplify_ref_alt(r, a).alias("arrow"), alleles.allele_type(r, a).alias("kind"), alleles.encoded_variant_type(r, alts).alias("vclass"),
        alleles.has_insertion(r, alts).alias("ins"), alleles.has_deletion(r, alts).alias("del"), alleles.reverse_complement(r).alias("rc"),
    )


@query("""WITH n AS (SELECT DISTINCT (p_size % 4 + 1)::INT AS n FROM part) SELECT n, ((n + 1) * (n + 2) // 2)::INT AS genotypes,
 (SELECT list(b * 10 + a ORDER BY b, a) FROM (SELECT unnest(range(0, n.n + 1)) AS b), LATERAL (SELECT unnest(range(0, b + 1)) AS a)) AS pairs, (n + n * (n - 1) // 2)::INT AS combos FROM n""")
def q_genotype_order(spark, sf_dir):
    """F23, F24, G1, G2."""
    n = table(spark, sf_dir, "part").select((F.col("p_size") % 4 + 1).cast("int").alias("n")).distinct()
    pairs = F.transform(genotype.genotype_order(F.col("n")), lambda p: (p["second"] * 10 + p["first"]).cast("long"))
    return n.select("n", genotype.num_genotypes(F.col("n")).alias("genotypes"), pairs.alias("pairs"), F.size(genotype.alt_combinations(F.col("n"), True)).alias("combos"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, least(greatest(l_discount + l_tax, 0.0), 1.0) AS p FROM lineitem)
 SELECT l_orderkey, l_linenumber, round(pow(10, -q / 10), 9) AS perror, round(-10 * log10(1 - least(p, 1 - 1.25e-10)), 6) AS ptrue, round(log10(greatest(p, 1.25e-10)), 6) AS logp,
  abs(round(-10 * log10(greatest(p, 1.25e-10))))::INT AS rounded, round(-10 * log10(1 - greatest(least(p, 1 - 1e-7), 1e-7)), 6) AS small FROM v""")
def q_phred(spark, sf_dir):
    """F25 to F28, F46."""
    p, q = F.least(F.greatest(F.col("l_discount") + F.col("l_tax"), F.lit(0.0)), F.lit(1.0)), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(phred.phred_to_error(q), 9).alias("perror"), F.round(phred.true_to_phred(p), 6).alias("ptrue"), F.round(phred.bounded_log10(p), 6).alias("logp"),
        phred.log10_error_to_rounded_phred(phred.bounded_log10(p)).alias("rounded"), F.round(phred.small_model_quality(p), 6).alias("small"),
    )


@query("""WITH v AS (SELECT o_orderkey AS k, o_custkey AS a, o_custkey + o_orderkey % 50 AS b, o_custkey + 20 AS c, o_custkey + 20 + o_orderkey % 30 AS d FROM orders)
 SELECT k, greatest(least(b, d) - greatest(a, c), 0) AS n, a < d AND c < b AS hit, a <= c AND c < b AS inside, 'c:' || (a + 1) || '-' || b AS literal, b > a AS valid FROM v""")
def q_ranges(spark, sf_dir):
    """F14, S13."""
    k, a = F.col("o_orderkey"), F.col("o_custkey")
    v = table(spark, sf_dir, "orders").select(k.alias("k"), a.alias("a"), (a + k % 50).alias("b"), (a + 20).alias("c"), (a + 20 + k % 30).alias("d"))
    literal = ranges.to_literal(F.lit("c"), F.col("a"), F.col("b"))
    return v.select("k", ranges.overlap_length(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("n"), ranges.overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("hit"), ranges.contains(F.col("a"), F.col("b"), F.col("c")).alias("inside"), literal.alias("literal"), ranges.literal_range(literal).isNotNull().alias("valid"))


@query("SELECT o_orderkey AS k, greatest(o_custkey - 40, 0) AS start, least(o_custkey + 10 + 40, o_custkey + o_orderkey % 70) AS \"end\" FROM orders")
def q_clipped_ranges(spark, sf_dir):
    """ranges widened and clipped to their contig."""
    k, a = F.col("o_orderkey"), F.col("o_custkey")
    start, end = ranges.around(a, a + 10, 40, a + k % 70)
    return table(spark, sf_dir, "orders").select(k.alias("k"), start.alias("start"), end.alias("end"))


@query("""SELECT l_suppkey AS g, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS contig, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_orderkey) END AS start,
 CASE WHEN min(l_returnflag) = max(l_returnflag) THEN max(l_orderkey + l_linenumber) END AS "end" FROM lineitem GROUP BY l_suppkey""")
def q_range_span(spark, sf_dir):
    """F15."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_returnflag").alias("contig"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("end"))
    return intervals.spans(r, "g")


@query(f"""WITH {fx.FACTS_SQL}, sites AS (SELECT contig, c, pos, ref_base AS ref, translate(ref_base, 'ACGT', 'CGTA') AS alt FROM counts),
 seen AS (SELECT s.contig, s.pos AS start, s.ref, s.alt, a.base, a.q, a.mapq, a.is_rev, a.base = s.ref AS r, a.base = s.alt AS t FROM sites s LEFT JOIN aligned a ON a.contig = s.contig AND a.pos = s.pos)
 SELECT contig, start, ref, alt, count(*) FILTER (WHERE r)::INT AS n_ref, count(*) FILTER (WHERE t)::INT AS n_alt, count(base)::INT AS depth,
  coalesce(sum(mapq) FILTER (WHERE r) // nullif(count(*) FILTER (WHERE r), 0), 0)::INT AS mapq_ref, coalesce(sum(q) FILTER (WHERE r) // nullif(count(*) FILTER (WHERE r), 0), 0)::INT AS bq_ref, coalesce(100 * count(*) FILTER (WHERE r AND is_rev) // nullif(count(*) FILTER (WHERE r), 0), 0)::INT AS rev_ref,
  coalesce(sum(mapq) FILTER (WHERE t) // nullif(count(*) FILTER (WHERE t), 0), 0)::INT AS mapq_alt, coalesce(sum(q) FILTER (WHERE t) // nullif(count(*) FILTER (WHERE t), 0), 0)::INT AS bq_alt, coalesce(100 * count(*) FILTER (WHERE t AND is_rev) // nullif(count(*) FILTER (WHERE t), 0), 0)::INT AS rev_alt
 FROM seen GROUP BY ALL""")
def q_read_classes(spark, sf_dir):
    """Reads of the reference and of the alternate at sites."""
    counts = pileup.allele_counts(_sites(spark, sf_dir))
    sites = counts.select("contig", F.col("pos").alias("start"), F.col("ref_base").alias("ref"), F.translate("ref_base", "ACGT", "CGTA").alias("alt"))
    return small_model.classify_reads(sites, fx.reads(spark, sf_dir).where("mapq >= 10"))


_KIND = lambda kind, what: f"coalesce({what} FILTER (WHERE {kind}) // nullif(count(*) FILTER (WHERE {kind}), 0), 0)"


@query(f"""WITH {fx.CANDIDATES_SQL}, seen AS (
  SELECT k.contig, k.start, a.base, a.q, a.mapq, a.is_rev, coalesce(a.base = substring(k.ref, 1, 1), false) AS r, coalesce(a.base = substring(k.alts[1], 1, 1) AND a.base <> substring(k.ref, 1, 1), false) AS t
  FROM cands k LEFT JOIN aligned a ON a.contig = k.contig AND a.pos = k.start),
own AS (SELECT contig, start, count(*) FILTER (WHERE r) AS n_ref, count(*) FILTER (WHERE t) AS n_alt, count(base) AS depth, {_KIND("r", "sum(mapq)")} AS mapq_ref, {_KIND("t", "sum(mapq)")} AS mapq_alt, {_KIND("r", "sum(q)")} AS bq_ref, {_KIND("t", "sum(q)")} AS bq_alt,
  coalesce(100 * count(*) FILTER (WHERE r AND is_rev) // nullif(count(*) FILTER (WHERE r), 0), 0) AS rev_ref, coalesce(100 * count(*) FILTER (WHERE t AND is_rev) // nullif(count(*) FILTER (WHERE t), 0), 0) AS rev_alt FROM seen GROUP BY contig, start),
around AS (SELECT w.contig, w.start, list(coalesce(alt_count * 100 // nullif(ref_count + alt_count, 0), 0) ORDER BY w.p) AS context FROM (SELECT contig, start, unnest(range(start - 25, start + 26)) AS p FROM cands) w LEFT JOIN counts c ON c.contig = w.contig AND c.pos = w.p GROUP BY ALL)
SELECT contig, start, ref, alts, [0] AS alt_idx, list_concat([n_ref, n_alt, n_ref + n_alt, depth, CASE WHEN depth > 0 THEN n_alt * 100 // depth ELSE 0 END, CASE WHEN n_ref + n_alt > 0 THEN n_alt * 100 // (n_ref + n_alt) ELSE 0 END, mapq_ref, mapq_alt, bq_ref, bq_alt, rev_ref, rev_alt,
  (length(ref) = 1 AND length(alts[1]) = 1 AND alts[1] <> ref)::INT, (length(alts[1]) > length(ref))::INT, (length(alts[1]) < length(ref))::INT, greatest(length(alts[1]) - length(ref), 0), greatest(length(ref) - length(alts[1]), 0), (length(alts) > 1)::INT, 0]::FLOAT[], context::FLOAT[]) AS features
FROM cands JOIN own USING (contig, start) JOIN around USING (contig, start)""")
def q_small_model_features(spark, sf_dir):
    """Vectors of 70."""
    at = stored(_sites(spark, sf_dir), "sites")
    sites = pileup.candidates(at).select("contig", "start", "ref", "alts", F.array(F.lit(0)).alias("alt_idx"))
    return small_model.features(sites, fx.reads(spark, sf_dir).where("mapq >= 10"), pileup.allele_counts(at))


_F32 = lambda x: f"CAST({x} AS FLOAT)::DOUBLE"
_PIXEL = lambda x: f"trunc({_F32(f'({_F32(x)}) * 254')})::INT"
_SCALE = lambda v, cap: _PIXEL(f"greatest(least({v}, {cap}), 0) / {cap}.0::DOUBLE")
_PCT = lambda k, n: f"trunc({_F32(f'({_F32(f"{k} / ({n})::DOUBLE")}) * 100')})::INT"


@query(f"""WITH {fx.READS_SQL}, s AS (SELECT name, mapq, is_rev, tlen, hp, cigar_text, read_len, k0.seq, k0.total FROM reads r JOIN (SELECT rid, string_agg(base, '' ORDER BY k) AS seq, sum(q) AS total FROM read_bases GROUP BY rid) k0 USING (rid))
 SELECT name, {_SCALE('mapq', 60)} AS mapping_quality, CASE WHEN is_rev THEN 240 ELSE 70 END AS strand, {_SCALE('abs(tlen)', 1000)} AS insert_size, CASE hp WHEN 1 THEN 254 WHEN 2 THEN 127 ELSE 70 END AS haplotype,
  {_SCALE('total // read_len', 93)} AS mean_quality, {_SCALE(_PCT("CASE cigar_text WHEN '3S17M' THEN 17 WHEN '20M' THEN 20 ELSE 18 END", 'read_len'), 100)} AS identity,
  {_SCALE(_PCT("CASE cigar_text WHEN '3S17M' THEN 17 WHEN '20M' THEN 20 ELSE 18 END", "CASE cigar_text WHEN '3S17M' THEN 17 WHEN '20M' THEN 20 ELSE 19 END"), 100)} AS gap_identity,
  {_SCALE(_PCT("length(regexp_replace(seq, '[^GC]', '', 'g'))", 'length(seq)'), 100)} AS gc FROM s""")
def q_read_channels(spark, sf_dir):
    """Channels of whole reads."""
    c = F.col
    return fx.reads(spark, sf_dir).select(
        "name", ch.mapping_quality(c("mapq")).alias("mapping_quality"), ch.strand(c("is_rev")).alias("strand"), ch.insert_size(c("tlen")).alias("insert_size"), ch.haplotype_tag(c("hp")).alias("haplotype"),
        ch.mean_base_quality(c("bq")).alias("mean_quality"), ch.identity(c("cigar"), F.length("seq")).alias("identity"), ch.gap_compressed_identity(c("cigar")).alias("gap_identity"), ch.gc_content(c("seq")).alias("gc"),
    )


@query(f"""WITH {fx.FACTS_SQL} SELECT contig, pos, read_key, CASE base WHEN 'A' THEN 250 WHEN 'G' THEN 180 WHEN 'T' THEN 100 WHEN 'C' THEN 30 ELSE 0 END AS read_base, {_SCALE('q', 40)} AS base_quality,
 CASE WHEN base = {fx.base('c', 'pos')} THEN 50 ELSE 254 END AS differs, CASE WHEN base = translate({fx.base('c', 'pos')}, 'ACGT', 'CGTA') THEN 254 ELSE 152 END AS supports FROM aligned""")
def q_pileup_pixels(spark, sf_dir):
    """Pixels of aligned bases."""
    bases = pileup.aligned_bases_on_reference(fx.reads(spark, sf_dir).where("mapq >= 10"), fx.reference(spark, sf_dir))
    c = F.col
    return bases.select(
        "contig", "pos", "read_key", ch.read_base(c("base")).alias("read_base"), ch.base_quality(c("bq")).alias("base_quality"), ch.differs_from_ref(c("base"), c("ref_base")).alias("differs"),
        ch.supports_variant(c("base") == F.translate("ref_base", "ACGT", "CGTA")).alias("supports"),
    )


_ALT_SQL = f"""{fx.CANDIDATES_SQL}, haps AS (
  SELECT contig, c, pos AS start, row_number() OVER (PARTITION BY contig, pos ORDER BY type, bases, n) - 1 AS alt_index, CASE WHEN type = 4 THEN length(bases) ELSE 1 END AS taken,
         CASE WHEN type = 4 THEN substring(bases, 1, 1) ELSE bases END AS placed, greatest(pos - 5, 0) AS lo, pos + 6 AS hi FROM passing),
own AS (SELECT contig, pos, read_key, base, 0 AS nth, 0 AS m FROM aligned UNION ALL SELECT contig, ref_start + 7, name || '/' || mate, base, k - 7, 2 FROM read_bases WHERE cigar_text = '8M2I10M' AND k IN (8, 9) AND mapq >= 10),
met AS (SELECT h.*, o.read_key, o.base, CASE WHEN nth > 0 THEN CASE WHEN pos = start AND m = length(placed) - taken THEN pos + nth END
   WHEN pos < start THEN pos WHEN pos - start >= taken THEN pos + length(placed) - taken WHEN pos - start < length(placed) THEN pos END - lo AS col
 FROM haps h JOIN own o ON o.contig = h.contig AND o.pos >= h.lo AND o.pos < h.hi),
lifted AS (SELECT *, CASE WHEN lo + col < start THEN {fx.base('c', 'lo + col')} WHEN lo + col < start + length(placed) THEN substring(placed, (lo + col - start + 1)::INT, 1)
   ELSE {fx.base('c', 'lo + col - length(placed) + taken')} END AS hap_base FROM met WHERE col IS NOT NULL AND col < hi - lo + length(placed) - taken AND lo + 0 <= start AND hi - start >= taken)"""


@query(f"""WITH {_ALT_SQL} SELECT contig, start, alt_index::INT AS alt_index, col, count(*) AS n, sum(CASE base WHEN 'A' THEN 250 WHEN 'G' THEN 180 WHEN 'T' THEN 100 WHEN 'C' THEN 30 ELSE 0 END)::BIGINT AS base_pixels,
 sum(CASE WHEN base = hap_base THEN 50 ELSE 254 END)::BIGINT AS differs_pixels FROM lifted GROUP BY ALL""")
def q_alt_aligned_pixels(spark, sf_dir):
    """Channels 9, 10, 20, 21 over reads lifted to each alternate's haplotype, added up by column."""
    haps = alt_aligned.allele_haplotypes(pileup.candidate_alleles(_sites(spark, sf_dir)), fx.reference(spark, sf_dir), 5)
    at = alt_aligned.pixels(alt_aligned.lifted(fx.reads(spark, sf_dir).where("mapq >= 10"), haps, bin_width=64))
    return at.groupBy("contig", "start", "alt_index", "col").agg(F.count(F.lit(1)).alias("n"), F.sum("base_pixel").alias("base_pixels"), F.sum("differs_pixel").alias("differs_pixels"))


@query()
def q_alt_aligned_images(spark, sf_dir):
    """Images of reads aligned anew to each alternate's haplotype, channels 20 and 9, by digest."""
    opts = images.ImageOptions(width=41, height=30, channels=(20, 9))
    haps = alt_aligned.allele_haplotypes(pileup.candidate_alleles(_sites(spark, sf_dir)), fx.reference(spark, sf_dir), 20)
    c = F.col
    reads = fx.reads(spark, sf_dir).where("mapq >= 10").select(
        "contig", c("ref_start").alias("start"), c("ref_end").alias("end"), "cigar", "seq", "bq", "mapq", "is_rev", "tlen", "hp", "name", "mate", c("rid").alias("ordinal"), F.lit(True).alias("supports"), (c("mate") - 1).alias("number")
    )
    drawn = images.render(alt_aligned.realigned_rows(reads, haps, opts.width, bin_width=64), opts)
    return drawn.select("candidate", F.sha2("image", 256).alias("digest"))


@query(f"""WITH {fx.READS_SQL}, marked AS (SELECT rid, k, base, CASE WHEN base = lag(base) OVER w THEN 0 ELSE 1 END AS fresh FROM read_bases WINDOW w AS (PARTITION BY rid ORDER BY k)),
 runs AS (SELECT rid, k, sum(fresh) OVER (PARTITION BY rid ORDER BY k) AS run FROM marked), w AS (SELECT rid, k, count(*) OVER (PARTITION BY rid, run) AS n FROM runs)
 SELECT 'r' || rid AS name, list(n::INT ORDER BY k) AS weights, list(CASE WHEN n >= 3 THEN 254 ELSE 0 END ORDER BY k) AS runs, list({_SCALE('n', 30)} ORDER BY k) AS weighted FROM w GROUP BY rid""")
def q_homopolymers(spark, sf_dir):
    """W3, C15, C16."""
    w = fx.reads(spark, sf_dir).select("name", ch.homopolymer_weights(F.col("seq")).alias("weights"))
    return w.select("name", "weights", F.transform("weights", ch.is_homopolymer).alias("runs"), F.transform("weights", ch.homopolymer_weighted).alias("weighted"))


@query(f"""WITH v AS (SELECT o_orderkey AS k, (o_orderkey % 101)::INT AS a, (1 + o_custkey % 100)::INT AS b, (o_orderkey % 256)::INT AS m FROM orders)
 SELECT k, CASE WHEN a / 100.0::DOUBLE <= 0.01 THEN 0 ELSE trunc(least(greatest((log10(0.01) - log10(a / 100.0::DOUBLE)) / log10(0.01) * 254, 0), 254))::INT END AS frequency,
  {_SCALE(_PCT('least(a, b)', 'b'), 100)} AS mapped, {_SCALE('a', 60)} AS coverage, {_SCALE('m', 255)} AS methylation, CASE m % 12 WHEN 0 THEN 152 WHEN 1 THEN 254 WHEN 10 THEN 228 WHEN 9 THEN 203 WHEN 8 THEN 177 ELSE 152 END AS fuzzy,
  CASE WHEN m % 2 = 1 THEN 254 ELSE 152 END AS supplementary, {_PIXEL(f"sqrt({_F32('least(a, b) / b::DOUBLE')})")} AS sample_probability FROM v""")
def q_value_channels(spark, sf_dir):
    """C8, C10, C19 to C23."""
    k, c = F.col("o_orderkey"), F.col
    v = table(spark, sf_dir, "orders").select(k.alias("k"), (k % 101).cast("int").alias("a"), (1 + F.col("o_custkey") % 100).cast("int").alias("b"), (k % 256).cast("int").alias("m"))
    return v.select(
        "k", ch.allele_frequency(c("a") / 100.0, 0.01).alias("frequency"), ch.mapping_percent(F.least("a", "b"), c("b")).alias("mapped"), ch.mean_coverage(c("a"), 60).alias("coverage"), ch.methylation(c("m")).alias("methylation"),
        ch.fuzzy_support(c("m") % 12).alias("fuzzy"), ch.supplementary(c("m") % 2 == 1).alias("supplementary"), ch.allele_sample_probability(F.least("a", "b"), c("b")).alias("sample_probability"),
    )


_LEVELS_SQL = """levels AS (SELECT o_custkey % 40 AS site, 'r' || (o_orderkey % 31)::VARCHAR AS read, max((CASE WHEN o_orderkey % 31 % 2 = 0 THEN 200 ELSE 60 END + (o_orderkey * 7) % 50) * (o_orderkey % 9 > 0)::INT)::INT AS level FROM orders GROUP BY ALL),
 phases AS (SELECT 'r' || i::VARCHAR AS read, CASE WHEN i < 20 THEN 1 + i % 2 ELSE 0 END AS phase FROM range(31) t(i)),
 own AS (SELECT l.site, l.read, p.phase AS hap, l.level / 255.0::DOUBLE AS m FROM levels l JOIN phases p USING (read) WHERE l.level > 0 AND p.phase > 0),
 ranked AS (SELECT site, hap, rank() OVER (PARTITION BY site ORDER BY m) + (count(*) OVER (PARTITION BY site, m) - 1) / 2.0 AS r FROM own),
 sums AS (SELECT site, sum(r) FILTER (WHERE hap = 1)::DOUBLE AS s, count(*) FILTER (WHERE hap = 1)::DOUBLE AS a, count(*) FILTER (WHERE hap = 2)::DOUBLE AS b FROM ranked GROUP BY site),
 zs AS (SELECT site, abs((least(s - a * (a + 1) / 2, a * b - (s - a * (a + 1) / 2)) - a * b / 2) / sqrt(a * b * (a + b + 1) / 12)) / sqrt(2.0) AS z, a, b FROM sums),
 ps AS (SELECT site, CASE WHEN a = 0 OR b = 0 THEN -1 ELSE 2 * (1 - (2 - ((((1.061405429 / (1 + 0.3275911 * z) - 1.453152027) / (1 + 0.3275911 * z) + 1.421413741) / (1 + 0.3275911 * z) - 0.284496736) / (1 + 0.3275911 * z) + 0.254829592) / (1 + 0.3275911 * z) * exp(-z * z)) / 2) END AS p FROM zs)"""


def _levels(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    level = (F.when(k % 31 % 2 == 0, 200).otherwise(60) + (k * 7) % 50) * (k % 9 > 0).cast("int")
    levels = table(spark, sf_dir, "orders").groupBy((c % 40).alias("site"), F.concat(F.lit("r"), (k % 31).cast("string")).alias("read")).agg(F.max(level).cast("int").alias("level"))
    i = F.col("id")
    return levels, spark.range(31).select(F.concat(F.lit("r"), i.cast("string")).alias("read"), F.when(i < 20, 1 + i % 2).otherwise(0).cast("int").alias("phase"))


@query(f"WITH {_LEVELS_SQL} SELECT site, round(p, 8) AS p FROM ps")
def q_rank_sum(spark, sf_dir):
    """A24, F49, F50."""
    levels, phases = _levels(spark, sf_dir)
    own = methylation.known_levels(levels).join(phases.where("phase > 0").withColumnRenamed("phase", "hap"), "read")
    return methylation.rank_sums(own).select("site", F.round("p", 8).alias("p"))


_INFORMATIVE_SQL = f"""{_LEVELS_SQL}, info AS (SELECT o.site, avg(m) FILTER (WHERE hap = 1) AS mean_1, avg(m) FILTER (WHERE hap = 2) AS mean_2, min(p) AS p FROM own o JOIN ps USING (site) GROUP BY o.site
 HAVING count(*) FILTER (WHERE hap = 1) >= 2 AND count(*) FILTER (WHERE hap = 2) >= 2 AND count(*) >= 6 AND abs(mean_1 - mean_2) >= 0.25 AND stddev_pop(m) FILTER (WHERE hap = 1) <= 0.2 AND stddev_pop(m) FILTER (WHERE hap = 2) <= 0.2 AND min(p) >= 0 AND min(p) < 0.05)"""


@query(f"WITH {_INFORMATIVE_SQL} SELECT site, round(mean_1, 9) AS mean_1, round(mean_2, 9) AS mean_2, round(p, 8) AS p FROM info")
def q_methyl_sites(spark, sf_dir):
    """P12."""
    return methylation.informative_sites(*_levels(spark, sf_dir)).select("site", F.round("mean_1", 9).alias("mean_1"), F.round("mean_2", 9).alias("mean_2"), F.round("p", 8).alias("p"))


@query(f"""WITH {_INFORMATIVE_SQL}, v AS (SELECT l.read, count(*) FILTER (WHERE abs(l.level / 255.0 - mean_1) < abs(l.level / 255.0 - mean_2)) AS one, count(*) FILTER (WHERE NOT abs(l.level / 255.0 - mean_1) < abs(l.level / 255.0 - mean_2)) AS two
 FROM levels l JOIN phases p USING (read) JOIN info i USING (site) WHERE p.phase = 0 AND l.level > 0 GROUP BY l.read)
 SELECT read, CASE WHEN one > two THEN 1 ELSE 2 END AS vote FROM v WHERE greatest(one, two) >= 3 AND one <> two""")
def q_methyl_votes(spark, sf_dir):
    """A23, F39, J15."""
    levels, phases = _levels(spark, sf_dir)
    return methylation.methylation_votes(levels, phases, methylation.informative_sites(levels, phases))


@query()
def q_methyl_phasing(spark, sf_dir):
    """Rounds of sites and votes."""
    return methylation.phase_by_methylation(*_levels(spark, sf_dir))


_GROUPS_SQL = """rows AS (SELECT (l_suppkey % 3)::INT AS shard, (1 + l_suppkey % 20 // 3)::INT AS region, 'f' || (l_partkey % 60)::VARCHAR AS fragment, max((l_partkey % 2 + 1 + l_suppkey % 2) % 3)::INT AS phase FROM lineitem GROUP BY ALL),
 gs AS (SELECT shard, region, row_number() OVER (ORDER BY region, shard) AS g FROM (SELECT DISTINCT shard, region FROM rows)), n AS (SELECT r.*, g FROM rows r JOIN gs USING (shard, region)),
 margins AS (SELECT b.g, sum(CASE WHEN a.phase = b.phase THEN 1 ELSE -1 END) AS m FROM n a JOIN n b ON b.g = a.g + 1 AND a.fragment = b.fragment WHERE a.phase > 0 AND b.phase > 0 GROUP BY b.g),
 verdicts AS (SELECT gs.*, CASE WHEN abs(coalesce(m, 0)) < 2 THEN 'apart' WHEN m < 0 THEN 'switch' ELSE 'match' END AS verdict FROM gs LEFT JOIN margins USING (g)),
 chains AS (SELECT *, sum((verdict = 'apart')::INT) OVER (ORDER BY g) AS chain FROM verdicts),
 turned AS (SELECT *, sum((verdict = 'switch')::INT) OVER (PARTITION BY chain ORDER BY g) % 2 = 1 AS flip FROM chains)"""


def _group_rows(spark, sf_dir):
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").groupBy((s % 3).cast("int").alias("shard"), F.floor(1 + F.floor(s % 20 / 3)).cast("int").alias("region"), F.concat(F.lit("f"), (p % 60).cast("string")).alias("fragment")).agg(F.max((p % 2 + 1 + s % 2) % 3).cast("int").alias("phase"))


@query(f"WITH {_GROUPS_SQL} SELECT g, shard, region, verdict, flip FROM turned")
def q_phase_groups(spark, sf_dir):
    """J12, W7, A27."""
    return shard_phases.flips(shard_phases.compare_neighbours(_group_rows(spark, sf_dir)))


@query(f"""WITH {_GROUPS_SQL}, fixed AS (SELECT n.fragment, n.g, CASE WHEN flip AND phase > 0 THEN 3 - phase ELSE phase END AS phase FROM n JOIN turned t USING (g)),
 v AS (SELECT fragment, coalesce(min_by(phase, g) FILTER (WHERE phase > 0), 0) AS first_phase, count(*) FILTER (WHERE phase = 1) AS ones, count(*) FILTER (WHERE phase = 2) AS twos FROM fixed GROUP BY fragment)
 SELECT *, CASE WHEN ones > twos THEN 1 WHEN ones < twos THEN 2 ELSE 0 END AS phase, first_phase <> CASE WHEN ones > twos THEN 1 WHEN ones < twos THEN 2 ELSE 0 END AS corrected FROM v""")
def q_phase_merge(spark, sf_dir):
    """A25, A26."""
    return shard_phases.merge_phases(_group_rows(spark, sf_dir))


def _support(spark, sf_dir):
    called = stored(pileup.candidates(_sites(spark, sf_dir)), "candidates")
    bases = pileup.bases_at(phasing.phasable(called).select("contig", F.col("start").alias("pos")), fx.reads(spark, sf_dir).where("mapq >= 10 AND flag NOT IN (4, 1024)"))
    return phasing.phasing_support(called, bases)


@query()
def q_phased_positions(spark, sf_dir):
    """X9 to X13, P11, P13, W5, W6, J10, J11, with W4's phase sets; regions are chains of candidates that reads link."""
    return phasing.phase_sets(phasing.phase_regions(phasing.link_regions(stored(_support(spark, sf_dir), "support"))))


@query()
def q_phased_reads(spark, sf_dir):
    """Phases of reads."""
    return phasing.phase_reads(phasing.link_regions(stored(_support(spark, sf_dir), "support")))


_SUPPORT_SQL = f"""{fx.CANDIDATES_SQL}, support AS (
  SELECT s.contig, s.start, s."end", CASE WHEN base = ref THEN 'REF' ELSE base END AS allele, a.read_key
  FROM cands s JOIN aligned a ON a.contig = s.contig AND a.pos = s.start JOIN reads r ON r.name || '/' || r.mate = a.read_key
  WHERE length(ref) = 1 AND list_max(list_transform(alts, lambda x: length(x))) = 1 AND r.flag NOT IN (4, 1024) AND (base = ref OR list_contains(alts, base)))"""


@query(f"WITH {_SUPPORT_SQL} SELECT contig, start, allele, count(*) AS n, string_agg(read_key, ',' ORDER BY read_key) AS reads FROM support GROUP BY ALL")
def q_phasing_support(spark, sf_dir):
    """What phasing starts from, reads by candidate and allele."""
    listed = F.array_join(F.sort_array(F.collect_list("read_key")), ",")
    return _support(spark, sf_dir).groupBy("contig", "start", "allele").agg(F.count(F.lit(1)).alias("n"), listed.alias("reads"))


@query(f"""WITH {_SUPPORT_SQL}, spans AS (SELECT contig, min(start) AS start, max("end") AS e, false AS site FROM support GROUP BY contig, read_key UNION ALL SELECT DISTINCT contig, start, "end", true FROM support),
marked AS (SELECT *, CASE WHEN start < max(e) OVER w THEN 0 ELSE 1 END AS fresh FROM spans WINDOW w AS (PARTITION BY contig ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS g FROM marked),
named AS (SELECT contig, start, contig || ':' || min(start) OVER (PARTITION BY contig, g) AS region FROM numbered WHERE site)
SELECT contig, start, region, count(*) AS n FROM support JOIN named USING (contig, start) GROUP BY ALL""")
def q_phase_regions(spark, sf_dir):
    """W5's regions: chains of candidates that reads link, with each candidate's reads."""
    return phasing.link_regions(stored(_support(spark, sf_dir), "support")).groupBy("contig", "start", "region").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT p_partkey AS start, substring('ACGT', 1 + (p_partkey % 4)::INT, 1) AS ref, [substring('CGTA', 1 + (p_partkey % 4)::INT, 1), substring('GTAC', 1 + (p_partkey % 4)::INT, 1)] AS alts, p_partkey % 3 AS kind FROM part),
 p AS (SELECT *, CASE WHEN kind = 0 THEN 'REF' ELSE alts[1] END AS phase_1, alts[2] AS phase_2, CASE WHEN start % 7 = 0 THEN start END AS fresh FROM c),
 s AS (SELECT *, coalesce(last_value(fresh IGNORE NULLS) OVER (ORDER BY start), 0)::INT AS set FROM p)
 SELECT start, CASE WHEN kind = 0 THEN [0, 0] ELSE [1, 2] END AS gt, kind <> 0 AS phased, CASE WHEN kind <> 0 THEN set END AS ps FROM s""")
def q_apply_phasing(spark, sf_dir):
    """Phases and phase sets on calls; sites phased against the reference stay as they are."""
    table(spark, sf_dir, "part").createOrReplaceTempView("lf_part")
    c = spark.sql("SELECT 'chr1' AS contig, p_partkey AS start, substring('ACGT', cast(1 + p_partkey % 4 as int), 1) AS ref, array(substring('CGTA', cast(1 + p_partkey % 4 as int), 1), substring('GTAC', cast(1 + p_partkey % 4 as int), 1)) AS alts, array(0, 0) AS gt FROM lf_part")
    p = c.select("contig", "start", F.when(F.col("start") % 3 == 0, phasing.REF).otherwise(F.col("alts")[0]).alias("phase_1"), F.col("alts")[1].alias("phase_2"), (F.col("start") % 7 == 0).alias("is_first"))
    return phasing.apply_phasing(c, phasing.phase_sets(p, "contig")).select("start", "gt", "phased", "ps")


@query("""WITH v AS (SELECT l_orderkey AS k, l_linenumber AS n, repeat('A', 1 + l_partkey % 4) AS a1, repeat('C', 1 + l_suppkey % 4) AS a2, (l_orderkey % 5)::INT AS s FROM lineitem)
 SELECT k, n, CASE s WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN CASE abs(length(a2) - length(a1)) WHEN 1 THEN 10 WHEN 2 THEN 9 ELSE 2 END WHEN 3 THEN 1 ELSE 0 END AS code, [CASE WHEN s > 0 THEN s ELSE 0 END, 0] AS phases FROM v""")
def q_fuzzy_support(spark, sf_dir):
    """support codes; reads carry nothing, the first, the second, both, or another allele."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lf_lineitem")
    v = spark.sql("SELECT l_orderkey AS k, l_linenumber AS n, repeat('A', cast(1 + l_partkey % 4 as int)) AS a1, repeat('C', cast(1 + l_suppkey % 4 as int)) AS a2, cast(l_orderkey % 5 as int) AS s FROM lf_lineitem")
    a1, a2, s = F.col("a1"), F.col("a2"), F.col("s")
    held = F.when(s == 1, F.array(a1)).when(s == 2, F.array(a2)).when(s == 3, F.array(a2, a1)).when(s == 4, F.array(F.lit("G"))).otherwise(F.array().cast("array<string>"))
    return v.select("k", "n", ch.fuzzy_code(held, F.array(a1, a2), a1).alias("code"), genotype.allele_phases(F.array(F.lit(0), s), F.lit(2)).alias("phases"))


@query(f"""WITH {fx.CANDIDATES_SQL} SELECT contig, start, alts[i + 1] AS alt, i::VARCHAR AS indices FROM (SELECT *, unnest(range(0, len(alts))) AS i FROM cands)
 UNION ALL SELECT contig, start, alts[i + 1] || '/' || alts[j + 1], i || ',' || j FROM (SELECT *, unnest(range(i + 1, len(alts))) AS j FROM (SELECT *, unnest(range(0, len(alts))) AS i FROM cands))""")
def q_examples(spark, sf_dir):
    """An example for each alternate of each candidate and each pair of alternates."""
    e = examples.examples(pileup.candidates(_sites(spark, sf_dir)), True)
    return e.select("contig", "start", F.expr("array_join(transform(alt_indices, i -> alts[i]), '/')").alias("alt"), F.expr("array_join(transform(alt_indices, i -> cast(i as string)), ',')").alias("indices"))


@query(f"""WITH {fx.FACTS_SQL},
 placed AS (SELECT *, greatest(ref_start - 3 + rid % 12, ref_start) - ref_start AS lo, ref_start - 3 + rid % 12 + 9 - ref_start AS hi FROM units),
 kept AS (SELECT p.rid, b.k, b.base FROM placed p JOIN read_bases b ON b.rid = p.rid AND b.k >= p.read_off AND b.k < p.read_off + p.len
  WHERE CASE WHEN p.op = 'M' THEN p.ref_off + b.k - p.read_off >= p.lo AND p.ref_off + b.k - p.read_off < p.hi ELSE p.op <> 'D' AND p.ref_off >= p.lo AND p.ref_off <= p.hi END),
 seqs AS (SELECT rid, string_agg(base, '' ORDER BY k) AS seq FROM kept GROUP BY rid),
 ends AS (SELECT *, greatest(ref_start - 3 + rid % 12, ref_start) AS s, least(ref_start - 3 + rid % 12 + 9, ref_end) AS e FROM good)
 SELECT name, contig, s AS start, e - s AS ref_bases, seq, length(seq) AS n_quals, ref_start AS original_start FROM ends JOIN seqs USING (rid) WHERE e - s >= 5""")
def q_trimmed_reads(spark, sf_dir):
    """Reads cut to a range of nine bases each, of which they must cover five."""
    first = F.col("ref_start") - 3 + F.col("rid") % 12
    r = examples.trim_reads(fx.reads(spark, sf_dir).where("mapq >= 10").withColumn("first", first), F.col("first"), F.col("first") + 9, 5)
    return r.select("name", "contig", F.col("ref_start").alias("start"), cigar.ref_span(F.col("cigar")).cast("long").alias("ref_bases"), "seq", F.size("bq").cast("long").alias("n_quals"), "original_start")


@query("""WITH v AS (SELECT p_partkey AS k, 'ACGTTGCAACGTCCGA' AS w, (p_partkey % 9)::BIGINT AS s, substring('ACGTTGCAACGTCCGA', (p_partkey % 9 + 1)::INT, (1 + p_size % 3)::INT) AS ref, substring('GATTACA', 1, (1 + p_size % 4)::INT) AS alt,
  'A' || repeat('C', (1 + p_partkey % 3)::INT) AS d1, 'A' || repeat('G', (1 + p_partkey % 2)::INT) AS d2, p_size % 2 = 0 AS has FROM part),
 x AS (SELECT *, CASE WHEN NOT has THEN 'A' WHEN length(d2) >= length(d1) THEN d2 ELSE d1 END AS r FROM v)
 SELECT k, substring(w, greatest(s - 4, 0) + 1, s - greatest(s - 4, 0)) || alt || substring(w, s + length(ref) + 1, least(s + length(ref) + 4, 12) - s - length(ref)) AS bases, greatest(s - 4, 0) AS hap_start, least(s + length(ref) + 4, 12) AS hap_end,
  substring(w, 1, s) || alt || substring(w, s + length(ref) + 1) AS spliced, r AS variant_ref, alt || substring(r, 2) AS as_substitution, 'A' || substring(r, length(d2) + 1) AS as_deletion, CASE WHEN has THEN length(d1) ELSE -1 END AS size FROM x""")
def q_haplotypes(spark, sf_dir):
    """Haplotypes of variants, and alleles under a reference that the longest deletion extends."""
    table(spark, sf_dir, "part").createOrReplaceTempView("lf_part")
    v = spark.sql("""SELECT p_partkey AS k, 'ACGTTGCAACGTCCGA' AS w, cast(p_partkey % 9 as bigint) AS s, substring('ACGTTGCAACGTCCGA', cast(p_partkey % 9 + 1 as int), cast(1 + p_size % 3 as int)) AS ref, substring('GATTACA', 1, cast(1 + p_size % 4 as int)) AS alt,
      'A' || repeat('C', cast(1 + p_partkey % 3 as int)) AS d1, 'A' || repeat('G', cast(1 + p_partkey % 2 as int)) AS d2, p_size % 2 = 0 AS has FROM lf_part""")
    w, s, ref, alt, d1, d2 = (F.col(c) for c in ("w", "s", "ref", "alt", "d1", "d2"))
    deletion = F.when(F.col("has"), alleles.DELETION).otherwise(alleles.REFERENCE)
    held = F.array(F.struct(F.lit(alleles.SUBSTITUTION).alias("type"), alt.alias("bases")), F.struct(deletion.alias("type"), d1.alias("bases")), F.struct(deletion.alias("type"), d2.alias("bases")))
    made = v.withColumn("h", alleles.flanked_haplotype(w, F.lit(0), s, ref, alt, 4, F.lit(12))).withColumn("variant_ref", alleles.extended_ref(F.lit("A"), held))
    return made.select(
        "k", "h.bases", F.col("h.start").alias("hap_start"), F.col("h.end").alias("hap_end"), alleles.splice_alt(w, F.lit(0), s, ref, alt).alias("spliced"), "variant_ref",
        alleles.variant_alt(F.lit(alleles.SUBSTITUTION), alt, F.col("variant_ref")).alias("as_substitution"), alleles.variant_alt(F.lit(alleles.DELETION), d2, F.col("variant_ref")).alias("as_deletion"), alleles.deletion_size(deletion, d1).alias("size"),
    )


def _image_rows(spark, sf_dir, opts):
    """Candidates' windows and the reads within five bases, the rows of render."""
    cands = pileup.candidates(_sites(spark, sf_dir)).select("contig", "start", (F.col("start") - 20).alias("image_start")).where("image_start >= 0")
    reads = fx.reads(spark, sf_dir).where("mapq >= 10").select("contig", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"), "cigar", "seq", "bq", "mapq", "is_rev", "tlen", "hp", "name", "mate", "rid")
    near = intervals.interval_join(cands.withColumn("end", F.col("start") + 1), reads, bin_width=64, buffer=5)
    windows = pileup.with_reference(cands, fx.reference(spark, sf_dir), "image_start").select(F.col("contig").alias("w_contig"), F.col("start").alias("w_start"), F.substring("ref_after", 1, opts.width).alias("bases"))
    joined = near.join(windows, (F.col("contig") == F.col("w_contig")) & (F.col("start") == F.col("w_start")))
    return joined.select(
        F.concat_ws(":", "contig", F.col("start").cast("string")).alias("candidate"), "image_start", "bases", F.col("start").alias("variant_pos"), F.col("r_rid").alias("ordinal"), F.col("r_start").alias("ref_start"), F.col("r_cigar").alias("cigar"), F.col("r_seq").alias("seq"),
        F.col("r_bq").alias("bq"), F.col("r_mapq").alias("mapq"), F.col("r_is_rev").alias("is_rev"), (F.col("r_rid") % 2 == 0).alias("supports"), F.col("r_tlen").alias("tlen"), F.col("r_hp").alias("hp"), F.col("r_name").alias("name"), (F.col("r_mate") - 1).alias("number"),
    )


@query()
def q_pileup_images(spark, sf_dir):
    """Images of candidates, by digest."""
    opts = images.ImageOptions(width=41, height=30)
    drawn = images.render(_image_rows(spark, sf_dir, opts), opts)
    return drawn.select("candidate", F.length("image").alias("n_bytes"), F.sha2("image", 256).alias("digest"))


#: What the generator picks of n reads for 25 rows, for the numbers that occur.
_PICKS_SQL = ", ".join(f"({n}, {i}, {place})" for n in range(26, 161) for place, i in enumerate(images.shuffled(n, 42)[:25]))


@query(f"""WITH {fx.CANDIDATES_SQL}, picks(n, i, place) AS (VALUES {_PICKS_SQL}),
near AS (SELECT k.contig || ':' || k.start AS candidate, r.* FROM cands k JOIN reads r ON r.contig = k.contig AND r.ref_start < k.start + 6 AND k.start - 5 < r.ref_end WHERE r.mapq >= 10 AND k.start >= 20),
ranked AS (SELECT *, count(*) OVER (PARTITION BY candidate) AS n, row_number() OVER (PARTITION BY candidate ORDER BY rid) - 1 AS i FROM near),
chosen AS (SELECT r.*, coalesce(p.place, r.i) AS place FROM ranked r LEFT JOIN picks p ON p.n = r.n AND p.i = r.i WHERE r.n <= 25 OR p.n IS NOT NULL)
SELECT candidate, name, place::INT AS place, (row_number() OVER (PARTITION BY candidate ORDER BY hp, ref_start, name, mate, place) - 1)::INT AS "row" FROM chosen""")
def q_image_rows(spark, sf_dir):
    """The reads that images have room for, and their rows."""
    chosen = images.chosen_rows(_image_rows(spark, sf_dir, images.ImageOptions(width=41, height=30)).where("length(bases) = 41"), 25)
    return images.row_order(chosen).select("candidate", "name", "place", "row")


@query()
def q_assembled(spark, sf_dir):
    """Variants assembled in whole merged windows with 50 bases around, added to the candidates."""
    at = _sites(spark, sf_dir)
    windows = intervals.merge_intervals(intervals.islands(pileup.window_scores(at), 3), pad=50)
    reads = fx.reads(spark, sf_dir).select("contig", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"), "seq", "bq", "mapq")
    made = assembly.assemble_windows(windows, reads, pileup.reference_windows(windows, fx.reference(spark, sf_dir)), bin_width=64)
    return assembly.add_assembled(pileup.candidates(at).select("contig", "start", "end", "ref", "alts"), made)


def _toy_model():
    """A fixed linear model with a softmax, for tests and benches."""
    import numpy as np

    def predict(x):
        flat = x.reshape(len(x), -1).astype(np.float64)
        z = np.stack([flat[:, k::3].mean(axis=1) for k in range(3)], axis=1)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    return predict


@query()
def q_small_model_calls(spark, sf_dir):
    """Vectors scored, and the gate."""
    at = stored(_sites(spark, sf_dir), "sites")
    sites = pileup.candidates(at).select("contig", "start", "ref", "alts", F.explode(F.transform("alts", lambda a, i: F.array(i))).alias("alt_idx"))
    vectors = small_model.features(sites, fx.reads(spark, sf_dir).where("mapq >= 10"), pileup.allele_counts(at))
    scaled = vectors.withColumn("features", F.transform("features", lambda x: x / 100.0))
    return small_model.gate(inference.predict_features(scaled, _toy_model)).select("contig", "start", "alt_idx", F.round("gq", 6).alias("gq"), "passes")


@query()
def q_ranked_haplotypes(spark, sf_dir):
    """Haplotypes of windows of 60 bases around candidates, ranked by their reads' alignments."""
    windows = pileup.candidates(_sites(spark, sf_dir)).select("contig", F.greatest(F.col("start") - 30, F.lit(0)).alias("start"), (F.col("start") + 30).alias("end"))
    reads = fx.reads(spark, sf_dir).select("contig", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"), "seq", "bq", "mapq")
    return assembly.rank_haplotypes(windows, reads, pileup.reference_windows(windows, fx.reference(spark, sf_dir)), bin_width=64)


def calling_stages(reference, contigs: list[str]) -> list[Stage]:
    """From reads to VCF lines: candidates of counted alleles, vectors of each alternate, outputs, calls in file order."""

    def counted(reads):
        return pileup.counted_sites(pileup.passing_reads(reads), reference)

    def vectors(at, reads):
        called = pileup.candidates(at)
        each = called.select("*", F.explode(F.transform("alts", lambda a, i: F.array(i))).alias("alt_idx"))
        return small_model.features(each, pileup.passing_reads(reads), pileup.allele_counts(at))

    def outputs(examples_):
        scaled = examples_.withColumn("features", F.transform("features", lambda x: x / 100.0))
        return inference.predict_features(scaled, _toy_model).drop("mid")

    def lines(made):
        called = genotyping.call_variants(made)
        ordered = genotyping.in_file_order(called, contigs)
        return ordered.select("contig", "start", vcf_text.record_text(("GT", "GQ", "DP", "AD", "VAF", "PL"), set(called.columns)).alias("line"))

    return [Stage("sites", ("reads",), counted), Stage("vectors", ("sites", "reads"), vectors), Stage("outputs", ("vectors",), outputs, ("toy",)), Stage("lines", ("outputs",), lines, ("GT", "GQ", "DP", "AD", "VAF", "PL"))]


@query()
def q_reads_to_vcf(spark, sf_dir):
    """X19 and the three commands in one resumable run: reads to VCF lines, with the toy model."""
    stages = calling_stages(fx.reference(spark, sf_dir), [name for name, _ in _FILE_CONTIGS])
    return run_stages(spark, scratch(spark, "run"), stages, {"reads": fx.reads(spark, sf_dir)})["lines"]
