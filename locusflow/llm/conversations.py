"""Conversation structure repair: the cheapest edits that give a well-formed conversation.

A conversation's turns, in order, become a sequence whose role initials read
``(s?(ua)+)?``. Each turn is kept (0), given the role that the grammar wants next (1)
or deleted (2; a must for blank and duplicate turns); an empty turn may be inserted
anywhere (5); a truncated turn that stays costs 5 more. Backward over turns and
grammar states the cost to go is computed; a greedy walk forward takes, among
the edits that are tight with it, the one whose initial (D, I, K, R) is least in ASCII. Every
state has one role that may come next but the first, where system may be kept, so
an initial decides the edit and the walk gives the least string of initials.

Scale: turns are first reduced to codes without texts, equal turns of a conversation
counted before they are shuffled. Codes are laid out in range partitions by
(conversation, order), so a conversation that holds a third of all rows is many
partitions' chunks, and a chunk is at most a partition. Chunks of conversations that
cross a border are joined by two scans over one small row a chunk: backward, the
cost matrices of the grammar's states; forward, where each chunk's walk leaves for every
state it is entered by. Only then the edits are made, in all chunks at once, and texts join the turns
that stay. What a result row itself holds (the audit, one character an edit) is the only thing
that is as long as its conversation.

Defined cases: a null role or text is one space (such a role can't be kept, such a text is
blank), an empty role can't be kept; a null conv_id is a conversation; turns come in
the order of turn, nulls first, ties by role and then by the text's MD5; equal rows are duplicates of each
other; a conversation without rows has zeros and the hash of the empty string; an empty table gives
an empty table. Only conv_id, turn, role and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import light, materialise, spread

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Grammar states: nothing yet, after s, after u, after a; the last one may end, and the first.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that comes next by user or assistant, and the role that leads there.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40
#: A turn's code: bits 0-1 its initial (other, s, u, a), bits 2-3 its fault.
OTHER, S, U, A = range(4)
STAYS, CUT_SHORT, MUST_GO = 0, 4, 8
_LEGAL = {(S, U), (U, A), (A, U)}
BLANK, DUPLICATE, SHORT = 1, 2, 3
SPACE = " \t\n\x0b\x0c\r"


def kept_state(state: int, initial: int) -> int | None:
    """The state after a turn of this initial is kept, None where it can't be."""
    if initial == S:
        return SYSTEM if state == START else None
    return NEXT[state] if initial in (U, A) and NEXT[state] == initial else None


#: Edits of a turn by code and state: (initial of the edit, cost, next state), in ASCII order; a code has 12 values.
EDITS: list[list[list[tuple[str, int, int]]]] = []
for _code in range(12):
    _initial, _fault = _code & 3, _code & 12
    _more = TRUNCATED if _fault == CUT_SHORT else 0
    _rows: list[list[tuple[str, int, int]]] = []
    for _state in range(4):
        _found = [("D", DELETE, _state)]
        if _fault != MUST_GO:
            if (_to := kept_state(_state, _initial)) is not None:
                _found.append(("K", KEEP + _more, _to))
            _found.append(("R", REROLE + _more, NEXT[_state]))
        _rows.append(_found)
    EDITS.append(_rows)


def with_insertions(cost: list[int]) -> list[int]:
    """Costs by state once empty turns may be inserted first."""
    user, assistant = min(cost[USER], INSERT + cost[ASSISTANT]), min(cost[ASSISTANT], INSERT + cost[USER])
    return [min(cost[START], INSERT + user), min(cost[SYSTEM], INSERT + user), user, assistant]


#: Costs to go after the last turn.
END = with_insertions([0, FAR, FAR, 0])


def cost_to_go(codes: bytes, times: list[int], after: list[int]) -> list[list[int]]:
    """Least costs by state before each turn, and after the last one (after itself).

    times: how often each turn stands there; all but the first are duplicates.
    """
    costs = [after]
    for code, n in zip(reversed(codes), reversed(times), strict=True):
        more = DELETE * (n - 1)
        after = with_insertions([min(cost + after[to] for _, cost, to in edits) + more for edits in EDITS[code]])
        costs.append(after)
    costs.reverse()
    return costs


def walk(codes: bytes, times: list[int], costs: list[list[int]], state: int, last: bool) -> tuple[list[str], list[tuple[int, str]], int]:
    """Edits from a state: their initials, the turns that stay or come (place or -1, role or '' for its own), the state they lead to.

    last: nothing of the conversation follows, so what it lacks is inserted at the end.
    """
    audit: list[str] = []
    turns: list[tuple[int, str]] = []

    def inserted(state: int) -> int:
        audit.append("I")
        turns.append((-1, ROLE[NEXT[state]]))
        return NEXT[state]

    for i, code in enumerate(codes):
        more, after = DELETE * (times[i] - 1), costs[i + 1]
        while True:
            left = costs[i][state]
            edit = next((e for e in EDITS[code][state] if e[1] + more + after[e[2]] == left), None)
            # I comes before K and R, and behind D
            if (edit is None or edit[0] != "D") and INSERT + costs[i][NEXT[state]] == left:
                state = inserted(state)
                continue
            break
        name, _, to = edit
        audit.append(name)
        if name != "D":
            turns.append((i, ROLE[to] if name == "R" else ""))
        audit.append("D" * (times[i] - 1))
        state = to
    while last and state not in (START, ASSISTANT):
        state = inserted(state)
    return audit, turns, state


def turn_codes(turns: DataFrame) -> DataFrame:
    """Each different turn of a conversation once: conv_id, turn, role, digest, n (copies), code, fault."""
    digest = F.md5("text").alias("digest")
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    flags = F.when(last == "", 0).when(last.isin(".", "!", "?"), 2).otherwise(1)
    rows = turns.select("conv_id", "turn", "role", digest, flags.cast("int").alias("flags"))
    rows = rows.groupBy("conv_id", "turn", "role", "digest", "flags").agg(F.count(F.lit(1)).alias("n"))
    rows = materialise(rows, "conversation-turns")
    # of turns that are equal in role and text the first stays; only repeated ones are joined
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")
    again = rows.where("flags > 0").groupBy(*(F.col(c).alias(f"of_{c}") for c in ("conv_id", "role", "digest"))).agg(first, F.count(F.lit(1)).alias("times")).where("times > 1")
    same = F.col("conv_id").eqNullSafe(F.col("of_conv_id")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest"))
    rows = rows.join(light(materialise(again, "conversation-again")), same, "left")
    repeated = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(F.col("flags") == 0, BLANK).when(repeated, DUPLICATE).when(F.col("flags") == 1, SHORT).otherwise(0)
    initial = F.when(F.col("role").startswith("s"), S).when(F.col("role").startswith("u"), U).when(F.col("role").startswith("a"), A).otherwise(OTHER)
    rows = rows.select("conv_id", "turn", "role", "digest", "n", fault.alias("fault"), initial.alias("initial"))
    kind = F.when(F.col("fault") == SHORT, CUT_SHORT).when(F.col("fault") > 0, MUST_GO).otherwise(STAYS)
    return rows.withColumn("code", (F.col("initial") + kind).cast("int")).drop("initial")


CHUNK = "conv_id long, part int, edge boolean, codes binary, times binary, faults binary, turns array<long>, roles array<string>, digests array<string>"
_CHUNK = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("edge", pa.bool_()), ("codes", pa.binary()), ("times", pa.binary()), ("faults", pa.binary())]
    + [("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("digests", pa.list_(pa.string()))]
)
_FLUSH_TURNS = 1 << 15


def chunks(codes: DataFrame) -> DataFrame:
    """One row for each conversation and range partition: its turns there, in order.

    edge: the partition's first and last conversation, which may come from or go on in another one.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, first = None, True
        held: list[list] = [[], [], [], [], [], []]
        out: list[tuple] = []
        waiting = 0

        def row(edge: bool) -> tuple:
            code, n, fault, turns, roles, digests = held
            return at, part, edge, bytes(code), np.array(n, "<i8").tobytes(), bytes(fault), turns, roles, digests

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _CHUNK, strict=True)], schema=_CHUNK)

        for batch in batches:
            ids, *columns = (batch.column(c).to_pylist() for c in ("conv_id", "code", "n", "fault", "turn", "role", "digest"))
            starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(ids)], strict=True):
                if held[0] and ids[lo] != at:
                    out.append(row(first))
                    waiting += len(held[0])
                    first, held = False, [[], [], [], [], [], []]
                    if waiting >= _FLUSH_TURNS:
                        yield flushed()
                        out, waiting = [], 0
                at = ids[lo]
                for own, column in zip(held, columns, strict=True):
                    own.extend(column[lo:hi])
        if held[0]:
            out.append(row(True))
            yield flushed()

    order = ["conv_id", "turn", "role", "digest"]
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return codes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(gather, CHUNK)


def _times(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<i8").tolist()


def joined_chunks(edges: DataFrame) -> DataFrame:
    """(conv_id, part, entry, after, last) of the chunks at partitions' borders: the state they are entered in, the costs to go after them."""

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Least costs from each state before a chunk to each state after it."""
        for batch in batches:
            costs = []
            for codes, times in zip(batch.column("codes").to_pylist(), batch.column("times").to_pylist(), strict=True):
                to = [cost_to_go(codes, _times(times), [0 if x == y else FAR for x in range(4)])[0] for y in range(4)]
                costs.append([to[y][x] for x in range(4) for y in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(costs, pa.list_(pa.int64()))], names=["conv_id", "part", "costs"])

    def backward(found: pd.DataFrame) -> pd.DataFrame:
        """One conversation's chunks, a row a partition at most."""
        after, out = END, []
        for nth, row in enumerate(found.sort_values("part", ascending=False).itertuples()):
            out.append((row.conv_id, row.part, after, nth == 0))
            after = (np.array(row.costs).reshape(4, 4) + np.array(after)).min(axis=1).tolist()
        return pd.DataFrame(out, columns=["conv_id", "part", "after", "last"])

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The states that a chunk's walk leads to, by the state it is entered in."""
        for batch in batches:
            found = []
            for codes, times, after, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "times", "after", "last")), strict=True):
                costs = cost_to_go(codes, _times(times), after)
                found.append([walk(codes, _times(times), costs, state, last)[2] for state in range(4)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "after", "last")), pa.array(found, pa.list_(pa.int64()))], names=["conv_id", "part", "after", "last", "exits"])

    def forward(found: pd.DataFrame) -> pd.DataFrame:
        found, state, entry = found.sort_values("part"), START, []
        for row in found.itertuples():
            entry.append(state)
            state = int(row.exits[state])
        return found.assign(entry=entry)[["conv_id", "part", "entry", "after", "last"]]

    costs = edges.select("conv_id", "part", "codes", "times").mapInArrow(matrix, "conv_id long, part int, costs array<long>")
    ends = materialise(costs.groupBy("conv_id").applyInPandas(backward, "conv_id long, part int, after array<long>, last boolean"), "conversation-ends")
    met = on_chunk(edges.select("conv_id", "part", "codes", "times"), ends, "inner").mapInArrow(exits, "conv_id long, part int, after array<long>, last boolean, exits array<long>")
    return met.groupBy("conv_id").applyInPandas(forward, "conv_id long, part int, entry int, after array<long>, last boolean")


def on_chunk(gathered: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """gathered joined with a written table of some of its chunks."""
    named = light(found).withColumnRenamed("conv_id", "__lf_of").withColumnRenamed("part", "__lf_part")
    same = (F.col("part") == F.col("__lf_part")) & F.col("conv_id").eqNullSafe(F.col("__lf_of"))
    return gathered.join(named, same, how).drop("__lf_of", "__lf_part")


EDITED = (
    "conv_id long, part int, audit string, cost long, blank long, duplicate long, truncated long, illegal long, first int, final int, "
    "low long, high long, different long, stays array<struct<nth:int,turn:long,own:string,digest:string,role:string>>"
)
_STAYS = pa.list_(pa.struct([("nth", pa.int32()), ("turn", pa.int64()), ("own", pa.string()), ("digest", pa.string()), ("role", pa.string())]))
_EDITED = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("audit", pa.string()), *((c, pa.int64()) for c in ("cost", "blank", "duplicate", "truncated", "illegal"))]
    + [("first", pa.int32()), ("final", pa.int32()), *((c, pa.int64()) for c in ("low", "high", "different")), ("stays", _STAYS)]
)


def edited_chunks(gathered: DataFrame) -> DataFrame:
    """Each chunk's edits from the state that it is entered in, its counts, and the turns that stay (those that come have no digest)."""
    ways = materialise(joined_chunks(gathered.where("edge")), "conversation-ways")

    def edited(row: dict) -> tuple:
        codes, times, faults, turns = row["codes"], _times(row["times"]), row["faults"], row["turns"]
        within = row["entry"] is None
        state, after = (START, END) if within else (row["entry"], row["after"])
        costs = cost_to_go(codes, times, after)
        audit, kept, to = walk(codes, times, costs, state, within or row["last"])
        counts = [0, 0, 0, 0]
        for fault, n in zip(faults, times, strict=True):
            counts[fault] += n if fault == BLANK else 1
            if fault != BLANK:  # copies of a turn are duplicates
                counts[DUPLICATE] += n - 1
        initials = [c & 3 for c in codes]
        # equal initials never follow each other legally
        illegal = sum(times) - len(times) + sum(p not in _LEGAL for p in zip(initials, initials[1:], strict=False))
        known = [t for t in turns if t is not None]
        stays = [(nth, None, None, None, role) if i < 0 else (nth, turns[i], row["roles"][i], row["digests"][i], role or row["roles"][i]) for nth, (i, role) in enumerate(kept)]
        keys = ("nth", "turn", "own", "digest", "role")
        low, high = (known[0], known[-1]) if known else (None, None)
        return row["conv_id"], row["part"], "".join(audit), costs[0][state] - after[to], *counts[1:], illegal, initials[0], initials[-1], low, high, len(set(known)), [dict(zip(keys, x, strict=True)) for x in stays]

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [edited(row) for row in batch.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _EDITED, strict=True)], schema=_EDITED)

    return on_chunk(gathered, ways, "left").mapInArrow(edit, EDITED)


def spaced(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of turns; a null role or text is one space."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *filled)


def repaired_turns(turns: DataFrame, edited: DataFrame) -> DataFrame:
    """(conv_id, part, nth, role, text): the turns of the repaired conversations, in the order of part and nth."""
    stays = edited.select("conv_id", "part", F.explode("stays").alias("s")).select("conv_id", "part", "s.*")
    # a struct is equal to another with nulls in the same places, and one key shuffles both sides
    key = lambda role: F.struct("conv_id", "turn", F.col(role).alias("role"), "digest")
    texts = spaced(turns).withColumn("digest", F.md5("text")).select(key("role").alias("key"), "text")
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    own = stays.where("digest IS NOT NULL").select("conv_id", "part", "nth", F.col("role"), key("own").alias("key"))
    new = stays.where("digest IS NULL").select("conv_id", "part", "nth", "role", F.lit("").alias("text"))
    return own.join(texts, "key").select("conv_id", "part", "nth", "role", "text").unionByName(new)


def conversation_hashes(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the lines role:text, joined by newlines. A hash takes its bytes in order, so a conversation is one stream, of which nothing is held."""
    names = ["conv_id", "repaired_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running = None, None
        for batch in batches:
            done: list[list] = [[], []]
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                line = f"{role}:{text}".encode()
                if running is not None and conv == at:
                    running.update(b"\n" + line)
                    continue
                if running is not None:
                    done[0].append(at)
                    done[1].append(running.hexdigest())
                at, running = conv, hashlib.sha256(line)
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.string())], names=names)
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([running.hexdigest()])], names=names)

    ordered = spread(repaired, "conv_id").sortWithinPartitions("conv_id", "part", "nth")
    return ordered.select("conv_id", "role", "text").mapInArrow(digest, "conv_id long, repaired_sha256 string")


def conversation_counts(edited: DataFrame) -> DataFrame:
    """One row a conversation: gaps, counts of faults, cost, audit; a conversation's chunks are as many as partitions at most."""
    parts = edited.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("part", "first", "final", "low", "high", "audit"))).alias("p"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "different")),
        (F.max("high") - F.min("low") + 1).alias("span"),
    )
    borders = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.struct(a.final.alias("a"), b["first"].alias("b"), (a.high == b.low).alias("same")))
    legal = lambda x: F.concat_ws("", x.a, x.b).isin(*(f"{a}{b}" for a, b in sorted(_LEGAL)))
    split_turns = F.size(F.filter(borders, lambda x: F.coalesce(x.same, F.lit(False))))
    gaps = F.coalesce(F.col("span") - (F.col("different") - split_turns), F.lit(0))
    illegal = F.col("illegal") + F.size(F.filter(borders, lambda x: ~legal(x)))
    audit = F.array_join(F.transform("p", lambda x: x.audit), "")
    return parts.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", illegal.alias("illegal"), "cost", audit.alias("audit"))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The counts, costs and audits of the conversations, and their repaired turns."""
    gathered = materialise(chunks(turn_codes(spaced(turns))), "conversation-chunks")
    edited = materialise(edited_chunks(gathered), "conversation-edits")
    return conversation_counts(edited), repaired_turns(turns, edited)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults, by crc32 of conv_id:turn modulo 20: 0 is dropped, 1 has no text, 2 no end marks, 3 stands twice, 4 is the user's."""
    named = F.concat(*(x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))))
    hit = F.crc32(F.substring(named, F.lit(1), F.length(named) - 1)) % 20
    rows = spaced(conversations).withColumn("hit", hit).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every original conv_id with the counts, cost and audit of its damaged turns' repair, and the repaired turns' hash."""
    counts, repaired = repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").cast("long")).distinct()
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    met = every.join(counts.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left")
    met = met.join(conversation_hashes(repaired).withColumnRenamed("conv_id", "to"), F.col("conv_id").eqNullSafe(F.col("to")), "left")
    return met.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
