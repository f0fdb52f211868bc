"""Read-backed phasing of candidates, and applying it to calls.

A dynamic programme over pairs of alleles: a pair's score is how many reads carry
it on from the pair before. It is sequential along a chain of candidates that reads link, and starts
anew where none does, so it runs for each such chain (link_regions) in one Python group:
the result is that of the whole contig, and a group is as long as reads reach.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import numbered_runs

REF = "REF"
UNCALLED = "UNCALLED_ALLELE"
MIN_REF_READS, MIN_VOTES = 3, 2


@dataclass
class Candidate:
    """start, end, the reads of the reference, and those of each allele."""

    start: int
    end: int
    ref_reads: list[str]
    allele_reads: dict[str, list[str]]
    alts: list[str] = field(default_factory=list)


@dataclass
class Vertex:
    position: int
    bases: str
    reads: set[str]
    firsts: set[str]
    phase: int = 0
    first_in_block: bool = False


@dataclass
class Score:
    value: int
    origin: tuple[int, int] | None
    reads: tuple[set[str], set[str]]


def usable(candidates: list[Candidate]) -> list[Candidate]:
    """Candidates to phase: with two alleles or a supported reference, of one length, and outside the reach of earlier indels."""
    kept, shadow = [], 0
    for c in candidates:
        called = [a for a in c.allele_reads if a != UNCALLED]
        if len(called) <= 1 and len(c.ref_reads) < MIN_REF_READS:
            continue
        if any(c.end <= shadow or len(a) != c.end - c.start for a in called):
            shadow = max(shadow, c.end)
            continue
        kept.append(c)
    return kept


class Phaser:
    """The programme over one region's candidates, sorted by start.

    before, after: the contig has candidates to phase before the region, and after it. The last position of
    a contig isn't begun anew when its scores tell nothing, and the first block isn't marked
    when positions before it have no best pair; other regions' ends are as in the midst of it.
    """

    def __init__(self, candidates: list[Candidate], before: bool = False, after: bool = False):
        self.before, self.after = before, after
        self.vertices: list[Vertex] = []
        self.at: dict[int, list[int]] = {}
        self.edges: dict[int, dict[int, None]] = {}
        self.scores: dict[tuple[int, int], Score] = {}
        self.chain: dict[str, list[int]] = {}
        self.positions = []
        for c in usable(candidates):
            self.positions.append(c.start)
            self.at.setdefault(c.start, [])
            if c.alts == ["."]:
                continue
            if len(c.ref_reads) >= MIN_REF_READS:
                self._vertex(c.start, REF, c.ref_reads)
            for bases in sorted(a for a in c.allele_reads if a != UNCALLED):
                self._vertex(c.start, bases, c.allele_reads[bases])
        rank = {p: i for i, p in enumerate(self.positions)}
        for entries in self.chain.values():
            for a, b in zip(entries, entries[1:]):
                here = rank[self.vertices[b].position]
                if here == 0 or self.positions[here - 1] == self.vertices[a].position:
                    self.edges.setdefault(b, {})[a] = None

    def _vertex(self, position: int, bases: str, reads: list[str]) -> None:
        number = len(self.vertices)
        firsts = {r for r in reads if r not in self.chain}
        self.vertices.append(Vertex(position, bases, set(reads), firsts))
        self.at[position].append(number)
        for r in dict.fromkeys(reads):
            self.chain.setdefault(r, []).append(number)

    def _begin(self, here: list[int]) -> None:
        """Scores without a past: how many reads either allele has."""
        for a in here:
            for b in here:
                self.scores.pop((a, b), None)
        for i, a in enumerate(here):
            for b in here[i:]:
                ra, rb = self.vertices[a].reads, self.vertices[b].reads
                self.scores[a, b] = Score(len(ra) if ra == rb else len(ra) + len(rb), None, (set(ra), set(rb)))

    def _step(self, edge: tuple[int, int], other: tuple[int, int], before: Score) -> Score:
        overlaps = [self.vertices[e[1]].reads & before.reads[k] for k, e in enumerate((edge, other))]
        firsts = [self.vertices[e[1]].firsts for e in (edge, other)]
        value = before.value
        if max(map(len, overlaps)) >= 2:
            value += len(overlaps[0] | overlaps[1]) + len(firsts[0] | firsts[1]) // 2
        return Score(value, (edge[0], other[0]), (overlaps[0] | firsts[0], overlaps[1] | firsts[1]))

    def _bases(self, pair: tuple[int, int]) -> tuple[str, str]:
        return self.vertices[pair[0]].bases, self.vertices[pair[1]].bases

    def _better(self, new: Score, old: Score) -> bool:
        if new.value != old.value:
            return new.value > old.value
        return new.origin is not None and (old.origin is None or self._bases(new.origin) > self._bases(old.origin))

    def run(self) -> Phaser:
        for i, position in enumerate(self.positions):
            here = self.at[position]
            if i == 0 or not any(self.edges.get(v) for v in here):
                self._begin(here)
                continue
            into = [(a, v) for v in here for a in self.edges.setdefault(v, {}) or dict.fromkeys(self.at[self.positions[i - 1]])]
            into = list({self._bases(e): e for e in sorted(into)}.items())
            into = [e for _, e in sorted(into)]
            advanced = False
            for e in into:
                for f in into:
                    before = self.scores.get((e[0], f[0]))
                    if before is None:
                        continue
                    new, key = self._step(e, f, before), (e[1], f[1])
                    advanced = advanced or new.value > before.value
                    if key not in self.scores or self._better(new, self.scores[key]):
                        self.scores[key] = new
            values = [self.scores[e[1], f[1]].value for e in into for f in into if (e[1], f[1]) in self.scores]
            if (self.after or i + 1 < len(self.positions)) and (not advanced or not values or max(values) - min(values) <= 1):
                self._begin(here)
        self._trace()
        return self

    def _top(self, position: int) -> tuple[int, int] | None:
        """The best pair of a position, by bases if equal; None if all pairs are."""
        pairs = [(a, b) for a in self.at[position] for b in self.at[position] if (a, b) in self.scores]
        pairs = [p for p in pairs if self.scores[p].value >= 0]
        if not pairs:
            return None
        best = max(self.scores[p].value for p in pairs)
        if all(self.scores[p].value == best for p in pairs):
            return None
        return max((p for p in pairs if self.scores[p].value == best), key=self._bases)

    def _mark(self, pair: tuple[int, int], first: bool = False) -> None:
        for k, v in enumerate(pair):
            if first:
                self.vertices[v].first_in_block = True
            else:
                self.vertices[v].phase = k + 1 if pair[0] != pair[1] else 0

    def _clear(self, pair: tuple[int, int]) -> None:
        for v in pair:
            self.vertices[v].phase = 0

    def _trace(self) -> None:
        """Phases from the last position back, block by block."""
        i, before, before_score = len(self.positions) - 1, None, None
        while i >= 0:
            pair = self._top(self.positions[i])
            while pair is None:
                i -= 1
                if i < 0:
                    if self.before and before is not None:
                        self._mark(before, first=True)
                    return
                pair = self._top(self.positions[i])
            if before is None:
                before = pair
            else:
                self._mark(before, first=True)
            steps = 0
            while True:
                steps += 1
                self._mark(pair)
                score = self.scores[pair]
                i -= 1
                if pair != before and steps > 1 and score.value == before_score:
                    self._clear(pair)
                    break
                onward = score.origin if score.origin in self.scores else None
                if onward == pair:
                    break
                before, before_score = pair, score.value
                if onward is None:
                    if steps == 1:
                        self._clear(pair)
                    break
                pair = onward
        if before is not None:
            self._mark(before, first=True)

    def read_phases(self, reads: list[str], min_votes: int = MIN_VOTES) -> list[int]:
        out = []
        for r in reads:
            votes = [self.vertices[v].phase for v in self.chain.get(r, ())]
            one, two = votes.count(1), votes.count(2)
            out.append(1 if one > two and one >= min_votes else 2 if two > one and two >= min_votes else 0)
        return out

    def phased(self) -> list[tuple[int, str, str, bool]]:
        """(position, bases of phase 1, of phase 2, first in its block) where both phases have an allele."""
        out = []
        for position in self.positions:
            own = {self.vertices[v].phase: self.vertices[v].bases for v in self.at[position]}
            if 1 in own and 2 in own:
                out.append((position, own[1], own[2], self.vertices[self.at[position][-1]].first_in_block))
        return out


def _candidates(group: pd.DataFrame) -> list[Candidate]:
    """One pass over the rows in order; a candidate of low-quality rows alone is there, without reads."""
    rows = group.sort_values(["start", "end", "allele", "read_key"], kind="stable")
    out: list[Candidate] = []
    for start, end, allele, key, low in zip(*(rows[c].tolist() for c in ("start", "end", "allele", "read_key", "is_low_quality")), strict=True):
        if not out or (out[-1].start, out[-1].end) != (start, end):
            out.append(Candidate(int(start), int(end), [], {}))
        if low or allele is None:
            continue
        own = out[-1].ref_reads if allele == REF else out[-1].allele_reads.setdefault(allele, [])
        own.append(key)
    return out


def link_regions(support: DataFrame) -> DataFrame:
    """support (contig, start, end, allele, read_key, is_low_quality) with region, 'contig:start' of the first candidate of its chain, and before, after: whether the contig has candidates to phase before it and after it.

    A region starts where no read has alleles on both sides and no candidate lies across, so
    neither a link nor an indel's shadow is cut: what reads span and candidates are merged
    as intervals, by a segmented scan.
    """
    span = [F.min("start").alias("start"), F.max("end").alias("end")]
    good = ~F.col("is_low_quality")
    called = F.collect_set(F.when(good & ~F.col("allele").isin(REF, UNCALLED), F.col("allele")))
    sites = support.groupBy("contig", "start", "end").agg(called.alias("called"), F.count_if(good & (F.col("allele") == REF)).alias("refs"))
    kept, odd = (F.size("called") > 1) | (F.col("refs") >= MIN_REF_READS), F.exists("called", lambda a: F.length(a) != F.col("end") - F.col("start"))
    sites = sites.select("contig", "start", "end", F.lit(True).alias("site"), kept.alias("kept"), odd.alias("odd"))
    reach = support.where(good).groupBy("contig", "read_key").agg(*span).select("contig", "start", "end").distinct()
    runs = numbered_runs(sites.unionByName(reach.withColumn("site", F.lit(False)), allowMissingColumns=True), touching=False).where("site")
    # what usable() keeps: a candidate of odd lengths shadows those that end before it does
    earlier = Window.partitionBy("__run").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    shadow = F.max(F.when(F.col("kept") & F.col("odd"), F.col("end"))).over(earlier)
    marked = runs.withColumn("phased", F.col("kept") & ~F.col("odd") & ~F.coalesce(F.col("end") <= shadow, F.lit(False)))
    begins = marked.groupBy("contig", "__run").agg(F.min("start").alias("begin"), F.max("phased").alias("phased"))
    ends = begins.where("phased").groupBy("contig").agg(F.min("begin").alias("low"), F.max("begin").alias("high")).withColumnRenamed("contig", "__c")
    begins = begins.join(ends, F.col("contig") == F.col("__c"), "left")
    region = F.concat_ws(":", "contig", F.col("begin").cast("string")).alias("region")
    begins = begins.select("__run", region, F.coalesce(F.col("low") < F.col("begin"), F.lit(False)).alias("before"), F.coalesce(F.col("high") > F.col("begin"), F.lit(False)).alias("after"))
    return support.join(runs.select("contig", "start", "end", "__run").join(begins, "__run").drop("__run"), ["contig", "start", "end"])


def _phaser(group: pd.DataFrame) -> Phaser:
    ends = [bool(group[c].iloc[0]) if c in group else False for c in ("before", "after")]
    return Phaser(_candidates(group), *ends).run()


def phase_regions(support: DataFrame, region: str = "region") -> DataFrame:
    """Phased positions: region, start, phase_1, phase_2, is_first.

    support: region, start, end, allele (or REF), read_key, is_low_quality, one
    row per read and candidate; low-quality rows take no part.
    """
    kind = support.schema[region].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = _phaser(group).phased()
        return pd.DataFrame([(group[region].iloc[0], *r) for r in rows], columns=[region, "start", "phase_1", "phase_2", "is_first"])

    return support.groupBy(region).applyInPandas(run, f"{region} {kind}, start long, phase_1 string, phase_2 string, is_first boolean")


def phase_reads(support: DataFrame, region: str = "region") -> DataFrame:
    """region, read_key, phase (0, 1 or 2) of every read of support."""
    kind = support.schema[region].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        reads = sorted(set(group["read_key"]))
        phases = _phaser(group).read_phases(reads)
        return pd.DataFrame({region: group[region].iloc[0], "read_key": reads, "phase": phases})

    return support.groupBy(region).applyInPandas(run, f"{region} {kind}, read_key string, phase int")


def vote_phases(alleles: DataFrame, min_votes: int = MIN_VOTES) -> DataFrame:
    """read_key, phase by the majority of a read's phased alleles (read_key, phase), min_votes at least."""
    votes = alleles.groupBy("read_key").agg(F.count_if(F.col("phase") == 1).alias("one"), F.count_if(F.col("phase") == 2).alias("two"))
    one, two = F.col("one"), F.col("two")
    return votes.select("read_key", F.when((one > two) & (one >= min_votes), 1).when((two > one) & (two >= min_votes), 2).otherwise(0).alias("phase"))


def phase_sets(phased: DataFrame, region: str = "region") -> DataFrame:
    """phased with ps: where its block starts."""
    order = Window.partitionBy(region).orderBy("start")
    fresh = F.when(F.col("is_first") | (F.row_number().over(order) == 1), F.col("start"))
    return phased.withColumn("__ps", fresh).withColumn("ps", F.last("__ps", ignorenulls=True).over(order).cast("int")).drop("__ps")


def apply_phasing(called: DataFrame, phased: DataFrame, resolve_ref: bool = False) -> DataFrame:
    """called with gt, phased and ps from phased positions (contig, start, phase_1, phase_2, ps).

    Both phases' bases must be alleles of the variant; the phaser's name for the
    reference is one only with resolve_ref, so reference sites stay unphased by
    default.
    """
    own = phased.select(F.col("contig").alias("__c"), F.col("start").alias("__s"), "phase_1", "phase_2", F.col("ps").alias("__ps"))
    joined = called.join(own, (F.col("contig") == F.col("__c")) & (F.col("start") == F.col("__s")), "left")

    def allele(bases):
        is_ref = bases == F.col("ref")
        if resolve_ref:
            is_ref = is_ref | (bases == REF)
        place = F.array_position("alts", bases).cast("int")
        return F.when(is_ref, 0).when(place > 0, place)

    one, two = allele(F.col("phase_1")), allele(F.col("phase_2"))
    ok = one.isNotNull() & two.isNotNull()
    done = joined.withColumn("__gt", F.when(ok, F.array(one, two)))
    done = done.withColumn("gt", F.coalesce("__gt", "gt")).withColumn("phased", F.col("__gt").isNotNull()).withColumn("ps", F.when(F.col("__gt").isNotNull(), F.col("__ps")))
    return done.drop("__c", "__s", "__ps", "__gt", "phase_1", "phase_2")


def allele_type_counts(support: DataFrame) -> DataFrame:
    """Per candidate (contig, start, end): n_substitutions and n_indels, different alleles of its length and of others, and substitution_depth, the reads of the former.

    support: contig, start, end, allele, read_key; the reference and uncalled alleles don't count.
    """
    named = support.where(~F.col("allele").isin(REF, UNCALLED)).groupBy("contig", "start", "end", "allele").agg(F.count(F.lit(1)).alias("n"))
    whole = F.length("allele") == F.col("end") - F.col("start")
    counts = named.groupBy("contig", "start", "end").agg(F.count_if(whole).alias("n_substitutions"), F.count_if(~whole).alias("n_indels"), F.sum(F.when(whole, F.col("n")).otherwise(0)).alias("substitution_depth"))
    return support.select("contig", "start", "end").distinct().join(counts, ["contig", "start", "end"], "left").na.fill(0, ["n_substitutions", "n_indels", "substitution_depth"])


def phasable(variants: DataFrame) -> DataFrame:
    """Those whose reference and alternates have one base."""
    return variants.where((F.length("ref") == 1) & (F.size("alts") > 0) & F.forall("alts", lambda a: F.length(a) == 1))


def phasing_support(variants: DataFrame, bases: DataFrame) -> DataFrame:
    """Which allele reads support at phasable variants: contig, start, end, allele, read_key, is_low_quality.

    variants whose reference and alternates have one base; bases: contig, pos,
    read_key, base. Reads with another base are left out.
    """
    sites = phasable(variants).select("contig", "start", "end", "ref", "alts")
    at = bases.select(F.col("contig").alias("__c"), F.col("pos").alias("__p"), "read_key", "base")
    joined = sites.join(at, (F.col("contig") == F.col("__c")) & (F.col("start") == F.col("__p")))
    allele = F.when(F.col("base") == F.col("ref"), REF).when(F.array_contains("alts", F.col("base")), F.col("base"))
    return joined.select("contig", "start", "end", allele.alias("allele"), "read_key", F.lit(False).alias("is_low_quality")).where("allele IS NOT NULL")
