"""Repair of conversations' structure at the least cost, by divide and conquer in linear space."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, shuffle_partitions

#: Rows that one task holds of a conversation; longer ones are many chunks.
CHUNK = 4096
#: What a repaired conversation has been before its next row: nothing, only a system row, a user row without a reply, a reply.
NOTHING, SYSTEM, USER, REPLY = range(4)
MOVES = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, REPLY: USER}, "a": {USER: REPLY}}
#: From every state a user row follows, and after it its reply.
NEXT = [USER, USER, REPLY, USER]
DELETE, INSERT, REROLE, UNTRUNCATED = 3, 2, 2, 1
#: What a conversation that may end must add, as a cost: reply after a user row, both after a system row.
ENDS = [0, 2 * INSERT, INSERT, 0]
FAR = 1 << 40

#: A step leads from each state to each: (cost, what puts steps of equal cost in order, none being the beginning of another).
Step = list[list[tuple]]


def row_step(code: str) -> Step:
    """The cheapest edits of one row, inserted rows before it included, the least in ASCII of these. code: the role's initial and
    the fault ("x" must go, "t" truncated, "." none)."""
    initial, fault = code
    step: Step = [[(FAR, "")] * 4 for _ in range(4)]
    for state in range(4):
        at = state
        for inserted in range(3):
            if inserted:
                at = NEXT[at]
            moves = [("D", DELETE, at)]
            if fault != "x":
                more = UNTRUNCATED if fault == "t" else 0
                if at in MOVES.get(initial, {}):
                    moves.append(("K", more, MOVES[initial][at]))
                moves.append(("R", REROLE + more, NEXT[at]))
            for letter, cost, to in moves:
                step[state][to] = min(step[state][to], (cost + INSERT * inserted, "I" * inserted + letter), key=lambda x: (x[0] >= FAR, *x))
    return step


STEPS = {i + f: row_step(i + f) for i in "suao" for f in "xt."}


def forward(steps: Sequence[Step], vector: list[tuple]) -> list[tuple]:
    """(cost, rank) of each state after the steps; rank orders the least audits that lead there. vector: the same before."""
    for step in steps:
        best: list = []
        for to in range(4):
            best.append(min((vector[s][0] + step[s][to][0], vector[s][1], step[s][to][1]) for s in range(4) if vector[s][0] < FAR and step[s][to][0] < FAR) if any(vector[s][0] < FAR and step[s][to][0] < FAR for s in range(4)) else None)
        order = sorted((b[1:], to) for to, b in enumerate(best) if b is not None)
        ranks = {to: k for k, (_, to) in enumerate(order)}
        vector = [(b[0], ranks[to]) if b is not None else (FAR, 0) for to, b in enumerate(best)]
    return vector


def backward(steps: Sequence[Step], costs: list[int]) -> list[int]:
    """The cost from each state through the steps to the end, costs being those from there on."""
    for step in reversed(steps):
        costs = [min(min(step[s][to][0] + costs[to] for to in range(4)), FAR) for s in range(4)]
    return costs


def only(state: int) -> list[tuple]:
    return [(0, 0) if s == state else (FAR, 0) for s in range(4)]


def crossings(steps: Sequence[Step], start: int, costs: list[int]) -> list[int]:
    """The state after each step of the cheapest way, the one with the least audit, from `start` to an end whose costs are given.

    Cost vectors from both sides meet in the middle; of the states where their sum is least, the one reached by the least audit
    is where the way crosses, and both halves are solved in the same way. Of ways of equal cost through the same steps none is
    the beginning of another (both end in a row's own letter), so the least audit to the crossing is part of the least of all.
    """
    if not steps:
        return []
    if len(steps) == 1:
        return [min((c + costs[to], key, to) for to, (c, key) in enumerate(steps[0][start]) if c < FAR)[2]]
    middle = len(steps) // 2
    there, back = forward(steps[:middle], only(start)), backward(steps[middle:], costs)
    state = min((there[s][0] + back[s], there[s][1], s) for s in range(4) if there[s][0] < FAR)[2]
    return crossings(steps[:middle], start, [0 if s == state else FAR for s in range(4)]) + crossings(steps[middle:], state, costs)


def coded(codes: str) -> list[Step]:
    return [STEPS[codes[i : i + 2]] for i in range(0, len(codes), 2)]


def summarised(codes: pd.Series) -> pd.Series:
    """A chunk as one step: 16 costs, 16 ranks, and the number of neighbours that can't follow each other."""

    def one(c: str) -> list[int]:
        vectors = [forward(coded(c), only(s)) for s in range(4)]
        initials = c[::2]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        return [x[0] if x[0] < FAR else -1 for v in vectors for x in v] + [x[1] for v in vectors for x in v] + [illegal]

    return codes.map({c: one(c) for c in codes.unique()})


def crossed(chunks: pd.Series) -> pd.DataFrame:
    """The states that a conversation's chunks begin and end in (4: the conversation's end), and what all edits cost."""
    out = []
    for numbers in chunks:
        steps = [[[(int(n[4 * s + to]) if n[4 * s + to] >= 0 else FAR, int(n[16 + 4 * s + to])) for to in range(4)] for s in range(4)] for n in numbers]
        states = [NOTHING, *crossings(steps, NOTHING, ENDS)]
        cost = sum(step[a][b][0] for step, a, b in zip(steps, states, states[1:])) + ENDS[states[-1]]
        out.append((np.array(states[:-1], np.int32), np.array([*states[1:-1], 4], np.int32), cost))
    return pd.DataFrame(out, columns=["starts", "ends", "cost"])


def solved(codes: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """A chunk's edits in order: letter, which of its rows (null: inserted), and the initial that the row has afterwards."""

    def one(c: str, start: int, end: int) -> list[dict]:
        steps = coded(c)
        states = [start, *crossings(steps, start, ENDS if end == 4 else [0 if s == end else FAR for s in range(4)])]
        edits, at = [], start
        for i, (step, a, b) in enumerate(zip(steps, states, states[1:])):
            for letter in step[a][b][1]:
                if letter == "D":
                    edits.append({"edit": letter, "row": i, "role": None})
                    continue
                role = c[2 * i] if letter == "K" else "a" if at == USER else "u"
                at = MOVES[role][at]
                edits.append({"edit": letter, "row": None if letter == "I" else i, "role": role})
        while end == 4 and ENDS[at]:
            role = "a" if at == USER else "u"
            at = MOVES[role][at]
            edits.append({"edit": "I", "row": None, "role": role})
        return edits

    known: dict = {}
    return pd.Series([known[k] if (k := (c, s, e)) in known else known.setdefault(k, one(*k)) for c, s, e in zip(codes, starts, ends)])


def least_bytes(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)


def placed(rows: DataFrame) -> DataFrame:
    """The rows in order of conversation, turn (null first), role and text, written in ranges; part and at are a row's place. A
    conversation or a repeated row that fills several ranges is cut there."""
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    turns = turns.withColumn("copy", F.monotonically_increasing_id())  # parts equal rows, which may be in any order
    n = shuffle_partitions(rows.sparkSession)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    turns = turns.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("copy")
    number = F.monotonically_increasing_id()
    last = least_bytes(F.col("text"))
    return saved(turns.withColumns({"part": F.spark_partition_id(), "at": number - F.shiftleft(F.spark_partition_id().cast("long"), 33), "blank": last == "", "truncated": ~last.isin(".", "!", "?", "")}), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """A narrow row for each of placed(): conv_id, part, at, turn, initial and the first fault that applies (blank, duplicate:
    role and text were seen earlier in the conversation, truncated: the last character that is no space isn't one of .!?) or
    null. The first of equal rows is found by aggregation and marked by a join of unique numbers, so no text is a hot key."""
    said = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = turns.where("not blank").groupBy("conv_id", said.alias("said")).agg(F.min(F.struct("part", "at")).alias("f")).select("f.*", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    narrow = turns.select("conv_id", "part", "at", "turn", "blank", "truncated", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    return narrow.join(first, ["part", "at"], "left").select("conv_id", "part", "at", "turn", "initial", fault.alias("fault"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) made to read system?, then user and assistant in turns, at the least cost.

    A row may be kept (0), get the role user or assistant (2) or go (3); rows without text that says anything and repeats of an
    earlier role and text must go; a row that ends without a full stop, exclamation or question mark costs 1 more if it stays;
    an empty user or assistant row may be put in anywhere (2). Of the cheapest edits those are taken whose letters (K, R, D, I)
    are the least in ASCII. Rows are ordered by turn (null first), then role and text; null roles and texts are one space; rows
    with a null conv_id are one conversation; repeated rows are rows of their own; other columns are ignored; empty: empty.

    Returns (conversations, repaired):
    - conv_id, gaps (turns missing between the least and greatest, nulls apart), blank, duplicate, truncated (rows by their first
      fault), illegal (neighbours that can't follow each other), cost, audit (the letters in order);
    - conv_id, place (part, chunk, at: in this order), edit, role, text of every row that is left or put in.

    A conversation is cut into chunks of at most CHUNK rows, wherever it is in the sorted ranges. A chunk's least costs from
    each state to each make one step of the conversation, the same divide and conquer finds the states between chunks, and then
    each chunk is solved by itself. Only what the chunks come to (33 numbers each) meets in one task, so a conversation may have
    very many rows; its audit alone is one string.
    """
    turns = placed(rows)
    marked = saved(faults(turns), "turn-faults")
    code = F.concat("initial", F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", "t").otherwise("."))
    count = lambda f: F.sum((F.col("fault") == f).cast("long"))
    chunk = F.expr(f"at div {CHUNK}")
    chunks = marked.groupBy("conv_id", "part", chunk.alias("chunk")).agg(F.min("at").alias("begin"), F.sort_array(F.collect_list(F.struct("at", code.alias("code")))).alias("codes"), *(F.coalesce(count(f), F.lit(0)).alias(f) for f in ("blank", "duplicate", "truncated")))
    chunks = saved(chunks.withColumn("codes", F.concat_ws("", F.transform("codes", lambda x: x.code))).withColumn("step", F.pandas_udf(summarised, "array<int>")("codes")), "chunks")
    sums = ["blank", "duplicate", "truncated"]
    own = F.struct("part", "chunk", "step", F.substring("codes", 1, 1).alias("first"), F.element_at(F.split("codes", ""), F.char_length("codes") - 1).alias("last"))
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("chunks"), *(F.sum(c).alias(c) for c in sums))
    whole = whole.withColumn("way", F.pandas_udf(crossed, "struct<starts:array<int>,ends:array<int>,cost:long>")(F.transform("chunks", lambda c: c.step)))
    borders = F.transform(F.sequence(F.lit(2), F.size("chunks")), lambda i: (~F.concat(F.element_at("chunks", i - 1).last, F.element_at("chunks", i).first).isin("su", "ua", "au")).cast("long"))
    inside = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + F.element_at(c.step, 33))
    at_borders = F.when(F.size("chunks") > 1, F.aggregate(borders, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(0)
    whole = saved(whole.withColumn("illegal", inside + at_borders), "crossings")
    each = whole.select("conv_id", F.explode(F.arrays_zip(F.col("chunks.part").alias("part"), F.col("chunks.chunk").alias("chunk"), F.col("way.starts").alias("start"), F.col("way.ends").alias("end"))).alias("c")).select(F.col("c.part").alias("part"), F.col("c.chunk").alias("chunk"), "c.start", "c.end", same_key("conv_id"))
    keyed = chunks.select("conv_id", "part", "chunk", "begin", "codes", same_key("conv_id")).join(each, ["part", "chunk", "same"]).drop("same")
    edits = saved(keyed.withColumn("edits", F.pandas_udf(solved, "array<struct<edit:string,row:int,role:string>>")("codes", "start", "end")).drop("codes", "start", "end"), "edits")
    audits = edits.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "chunk", F.concat_ws("", F.col("edits.edit")).alias("audit")))).alias("audits"))
    audits = audits.select(same_key("conv_id"), F.concat_ws("", F.col("audits.audit")).alias("audit"))
    turned = marked.groupBy("conv_id", "turn").agg(F.first("part")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    turned = turned.select(same_key("conv_id"), F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"))
    conversations = whole.select("conv_id", *sums, "illegal", F.col("way.cost").alias("cost"), same_key("conv_id")).join(audits, "same").join(turned, "same")
    conversations = conversations.select("conv_id", "gaps", *sums, "illegal", "cost", "audit")
    rest = edits.select("conv_id", "part", "chunk", "begin", F.posexplode("edits").alias("place", "e")).where("e.edit <> 'D'")
    rest = rest.select("conv_id", "part", "chunk", "place", (F.col("begin") + F.col("e.row")).alias("at"), F.col("e.edit").alias("edit"), F.col("e.role").alias("initial"))
    texts = turns.select(F.col("part").alias("_part"), F.col("at").alias("_at"), "role", "text")
    found = rest.where("at is not null").join(texts, (F.col("part") == F.col("_part")) & (F.col("at") == F.col("_at")))
    put = rest.where("at is null").withColumns({"role": F.lit(None).cast("string"), "text": F.lit("")})
    names = ["conv_id", "part", "chunk", "place", "edit", "initial", "role", "text"]
    both = found.select(*names).unionByName(put.select(*names))
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("initial") == "u", "user").otherwise("assistant")
    return conversations, both.select("conv_id", F.struct("part", "chunk", F.col("place").alias("at")).alias("place"), "edit", role.alias("role"), "text")


def same_key(c: str) -> Column:
    """An id as a struct, so that nulls meet."""
    return F.struct(F.col(c)).alias("same")


def digested(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the lines role:text of each conversation, in order. Rows stream through, sorted, so that no
    conversation is held whole."""
    line = F.concat("role", F.lit(":"), "text")
    lines = repaired.select("conv_id", "place", line.alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for batch in batches:
            ids, ends = [], []
            nulls = batch["conv_id"].isna().to_numpy()
            for i, null, text in zip(batch["conv_id"], nulls, batch["line"]):
                now = (None,) if null else (int(i),)
                if now != key:
                    if key is not None:
                        ids.append(key[0])
                        ends.append(digest.hexdigest())
                    key, digest = now, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(text.encode())
            if ids:
                yield pd.DataFrame({"conv_id": pd.array(ids, "Int64"), "repaired_sha256": ends})
        if key is not None:
            yield pd.DataFrame({"conv_id": pd.array([key[0]], "Int64"), "repaired_sha256": [digest.hexdigest()]})

    return lines.mapInPandas(run, "conv_id long, repaired_sha256 string")
