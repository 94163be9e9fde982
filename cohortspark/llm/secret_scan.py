"""Secrets in texts, found by one deterministic automaton of all rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import accepted, compiled, longest
from .common import unused


@dataclass(frozen=True)
class Rule:
    """Matches of head + body, byte patterns, whose body has at least `least` bytes. Only the head's end tells them apart, so a
    rule without a head counts the whole match."""

    kind: str
    head: bytes
    body: bytes
    least: int = 1


#: The first three are fixed values. `[0-9a-f]{24,}` finds just the runs of `[0-9a-f]+` that have 24 characters.
BASE = (
    Rule("assign", rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", rb"[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", b"", rb"AKIA[A-Z0-9]+", 20),
    Rule("hex", b"", rb"[0-9a-f]{24,}", 24),
)
#: Further formats whose makers publish them.
MORE = (
    Rule("forge", b"", rb"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("chat", b"", rb"xox[abprs]-[A-Za-z0-9-]+", 24),
    Rule("cloud", b"", rb"AIza[A-Za-z0-9_-]+", 39),
    Rule("web", b"", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("key", b"", rb"-----BEGIN(?:\x20[A-Z]+)*\x20PRIVATE\x20KEY-----", 20),
)
SPANS = "array<struct<kind:string,start:int,end:int>>"


class Scanner:
    """All rules in one automaton that reads a text's bytes once, from its end: the state at a byte tells which rules have a
    match that begins there. From the first such byte on a match of a rule is followed to its longest end, then from the first
    beyond that end, so what is read twice is only what matched."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = rules
        self.all = compiled([r.head + r.body for r in rules], backwards=True, anywhere=True)
        self.ends = [compiled([r.head + r.body], backwards=False, anywhere=False) for r in rules]
        self.heads = [compiled([r.head], backwards=False, anywhere=False) if r.head else None for r in rules]
        self.steps = [(t.moves.tolist(), h and h.moves.tolist()) for t, h in zip(self.ends, self.heads)]

    def scan(self, joined: np.ndarray, cuts: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) in code points of each text, in order. Text i has bytes cuts[i] to cuts[i + 1] of joined."""
        n = len(cuts) - 1
        reset = self.all.moves.shape[1] - 1
        lengths = np.diff(cuts)
        classes = np.full(len(joined) + n, reset, np.uint8)  # a column that leads to the start parts two texts
        moved = np.ones(len(classes), bool)
        moved[cuts[1:] + np.arange(n)] = False
        classes[moved] = self.all.classes[joined]
        places, bits = accepted(self.all, classes)
        owner = np.searchsorted(cuts[1:] + np.arange(n), places)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        edges = np.flatnonzero(np.diff(owner, prepend=-1, append=n))
        for a, b in zip(edges, edges[1:]):
            i = int(owner[a])
            raw = joined[cuts[i] : cuts[i] + lengths[i]]
            text = raw.tobytes()
            found = []
            for k, rule in enumerate(self.rules):
                end = 0
                for at in (places[a:b][bits[a:b] >> k & 1 != 0] - cuts[i] - i).tolist():
                    if at < end:
                        continue
                    whole, head = self.steps[k]
                    end = longest(self.ends[k], whole, text, at)
                    body = at if head is None else longest(self.heads[k], head, text, at)
                    if end - body >= rule.least:
                        found.append((at, k, end))
            if found:
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                out[i] = [(int(points[at]), k, int(points[end])) for at, k, end in sorted(found)]
        return out


def secret_spans(text: Column, rules: Sequence[Rule] = BASE + MORE) -> Column:
    """The spans of a text column: kind, start and end (code points, end exclusive) by start, then in the rules' order."""
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string()).fill_null("")
        cuts = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        joined = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None and data.size else np.empty(0, np.uint8)
        spans = scanner.scan(joined, cuts - cuts[0])
        fields = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
        return pa.array([[{"kind": kinds[k], "start": a, "end": b} for a, k, b in s] for s in spans], pa.list_(pa.struct(fields)))

    return scan(text)


def scan_secrets(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = BASE + MORE, into: str = "spans") -> DataFrame:
    """docs with the column `into` (or that name with underscores, where docs has it): the secrets in each whole text.

    Matches of a rule are leftmost, longest and don't overlap; those of different rules may. Too short ones are dropped after
    that, as they take up their place. Null and empty texts have none. Rows don't move, other columns stay as they are, repeated
    rows are scanned each, and a text of any length is read in lanes, so its length is no limit. Empty: empty.
    """
    return docs.withColumn(unused(docs, into), secret_spans(F.col(f"`{text}`"), rules))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """A text with its secrets replaced; spans that overlap or touch are one."""
    merged = F.aggregate(
        spans,
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda done, s: F.when((F.size(done) > 0) & (s.start <= F.element_at(done, -1).end), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1).start.alias("start"), F.greatest(F.element_at(done, -1).end, s.end).alias("end"))))).otherwise(
            F.concat(done, F.array(F.struct(s.start.alias("start"), s.end.alias("end"))))
        ),
    )
    start = F.expr("struct(cast('' as string) as said, 0 as upto)")
    walk = F.aggregate(merged, start, lambda a, s: F.struct(F.concat(a.said, F.substring(text, a.upto + 1, s.start - a.upto), F.lit(mark)).alias("said"), s.end.alias("upto")), lambda a: F.concat(a.said, F.substring(text, a.upto + 1, F.lit(1 << 30))))
    return F.when(text.isNotNull(), walk)
