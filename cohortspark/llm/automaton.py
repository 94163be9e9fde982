"""Regular expressions of bytes as minimal deterministic automata: transition arrays, and scans of many texts at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np

#: Bytes of a text scanned as one lane, and bytes beyond its end from which a lane guesses the state that it starts in.
LANE, WARM = 4096, 64


class Automaton:
    """A nondeterministic automaton of byte patterns, whose states are numbers and whose sets of states are bits of integers."""

    def __init__(self) -> None:
        self.free: list[int] = []  # moves without a byte
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append(0)
        self.moves.append([])
        return len(self.free) - 1

    def joined(self, a: int, b: int) -> None:
        self.free[a] |= 1 << b

    def add(self, tree: Sequence, at: int, backwards: bool, either_case: bool = False) -> int:
        """The state that a parsed pattern leads to from `at`, read from its end if backwards."""
        for kind, value in reversed(tree) if backwards else tree:
            if kind is op.LITERAL or kind is op.NOT_LITERAL or kind is op.IN or kind is op.ANY:
                to = self.state()
                self.moves[at].append((characters(kind, value, either_case), to))
                at = to
            elif kind is op.SUBPATTERN:
                _, add, drop, inner = value
                at = self.add(inner, at, backwards, (either_case or bool(add & 2)) and not drop & 2)
            elif kind is op.BRANCH:
                to = self.state()
                for branch in value[1]:
                    self.joined(self.add(branch, at, backwards, either_case), to)
                at = to
            elif kind is op.MAX_REPEAT:
                least, most, inner = value
                for _ in range(least):
                    at = self.add(inner, at, backwards, either_case)
                if most is op.MAXREPEAT:
                    first = self.state()
                    self.joined(at, first)
                    self.joined(self.add(inner, first, backwards, either_case), first)
                    at = first
                else:
                    to = self.state()
                    self.joined(at, to)
                    for _ in range(most - least):
                        at = self.add(inner, at, backwards, either_case)
                        self.joined(at, to)
                    at = to
            else:
                raise ValueError(f"a pattern holds {kind}, which no automaton has")
        return at

    def closure(self, states: int) -> int:
        seen, new = 0, states
        while new:
            seen |= new
            reached = 0
            while new:
                low = new & -new
                reached |= self.free[low.bit_length() - 1]
                new ^= low
            new = reached & ~seen
        return seen


def characters(kind, value, either_case: bool) -> frozenset[int]:
    """The bytes that an element of a pattern stands for."""
    if kind is op.ANY:
        return frozenset(range(256)) - {10}
    out, negated = set(), kind is op.NOT_LITERAL
    for k, v in value if kind is op.IN else [(op.LITERAL, value)]:
        if k is op.NEGATE:
            negated = True
        elif k is op.LITERAL:
            out.add(v)
        elif k is op.RANGE:
            out |= set(range(v[0], v[1] + 1))
        else:
            raise ValueError(f"a class holds {k}; write its bytes")
    if either_case:
        out |= {ord(chr(b).swapcase()) for b in out if chr(b).isascii() and chr(b).isalpha()}
    return frozenset(range(256)) - out if negated else frozenset(out)


@dataclass(frozen=True)
class Table:
    """A minimal deterministic automaton. `classes` maps a byte to its column of `moves`; `accepts` has the bits of the patterns
    that a state accepts; state 0 is the start. The last column, which no byte has, leads back to the start."""

    classes: np.ndarray
    moves: np.ndarray
    accepts: np.ndarray
    dead: int


def compiled(patterns: Sequence[bytes], backwards: bool, anywhere: bool) -> Table:
    """All patterns in one table, by subset construction and minimisation. anywhere: a match may begin at every byte."""
    nfa = Automaton()
    starts, ends = [], {}
    for k, p in enumerate(patterns):
        starts.append(nfa.state())
        ends[nfa.add(parser.parse(p), starts[-1], backwards)] = 1 << k
    sets = list(dict.fromkeys(chars for moves in nfa.moves for chars, _ in moves))
    alike: dict[tuple, int] = {}
    classes = np.array([alike.setdefault(tuple(b in s for s in sets), len(alike)) for b in range(256)], np.uint8)
    one = {c: int(np.flatnonzero(classes == c)[0]) for c in range(len(alike))}
    closed = [nfa.closure(1 << s) for s in range(len(nfa.free))]
    # a state's moves by class of bytes
    steps = [{c: 0 for c in ()} for _ in nfa.free]
    for s, moves in enumerate(nfa.moves):
        for chars, to in moves:
            for c, b in one.items():
                if b in chars:
                    steps[s][c] = steps[s].get(c, 0) | closed[to]
    begin = 0
    for s in starts:
        begin |= closed[s]
    found, rows, k = {begin: 0}, [], 0
    order = [begin]
    while k < len(order):
        row = [begin if anywhere else 0] * len(alike)
        rest = order[k]
        while rest:
            low = rest & -rest
            for c, to in steps[low.bit_length() - 1].items():
                row[c] |= to
            rest ^= low
        for to in row:
            if to not in found:
                found[to] = len(order)
                order.append(to)
        rows.append([found[to] for to in row])
        k += 1
    moves = np.array([[*r, 0] for r in rows], np.int64)
    accepts = np.array([sum(bit for s, bit in ends.items() if x >> s & 1) for x in order], np.int64)
    # states that accept alike and move to like states are one, found by refining the parting until it stays
    parts, n = np.unique(accepts, return_inverse=True)[1].ravel(), 0
    while parts.max() + 1 != n:
        n = parts.max() + 1
        parts = np.unique(np.column_stack([parts, parts[moves]]), axis=0, return_inverse=True)[1].ravel()
    first = np.unique(parts, return_index=True)[1]
    number = np.argsort(np.argsort(first))  # in the order of their first states, so that the start stays 0
    moves, accepts = number[parts[moves[np.sort(first)]]], accepts[np.sort(first)]
    stuck = np.flatnonzero((moves[:, :-1] == np.arange(len(moves))[:, None]).all(1) & (accepts == 0))
    return Table(classes, moves.astype(np.int32), accepts, int(stuck[0]) if len(stuck) and not anywhere else -1)


def accepted(table: Table, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, accepted bits) of all bytes at which the table, reading classes of bytes from the end, is in an accepting state.

    Reads text in lanes side by side. Each lane guesses its first state from the bytes beyond it, and a lane whose guess isn't
    the state that its neighbour ended in is read again, until all agree, so what is found is exact.
    """
    n = len(text)
    lanes = -(-n // LANE)
    if not lanes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width = table.moves.shape[1]
    flat = table.moves.ravel() * width  # states are kept as the offsets of their rows
    accepting = np.repeat(table.accepts != 0, width)
    reset = width - 1
    padded = np.full(lanes * LANE + WARM, reset, np.uint8)
    padded[:n] = text
    grid = padded[: lanes * LANE].reshape(lanes, LANE).T.copy()
    state = np.zeros(lanes, np.int32)
    for j in range(WARM - 1, -1, -1):
        state = flat[state + padded[np.arange(1, lanes + 1) * LANE + j]]
    state[-1] = 0
    began, ended = state, np.zeros(lanes, np.int32)
    again, hits = np.arange(lanes), []
    while len(again):
        state = began[again]
        own = grid[:, again] if len(again) < lanes else grid
        new = []
        for j in range(LANE - 1, -1, -1):
            state = flat[state + own[j]]
            at = np.flatnonzero(accepting[state])
            if len(at):
                new.append((again[at] * LANE + j, state[at]))
        if len(again) < lanes:
            redone = np.isin(np.arange(lanes), again)
            hits = [(p[~redone[p // LANE]], s[~redone[p // LANE]]) for p, s in hits]
        hits += new
        ended[again] = state
        right = np.append(ended[1:], 0)
        again = np.flatnonzero(began != right)
        began = right
    if not hits:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    places, states = (np.concatenate(x) for x in zip(*hits))
    order = np.argsort(places)
    return places[order], table.accepts[states[order] // width]


def longest(table: Table, moves: list[list[int]], text: bytes, at: int) -> int:
    """The end of the longest match that begins at `at`, or -1."""
    state, end = 0, -1
    classes, accepts, dead = table.classes, table.accepts, table.dead
    for i in range(at, len(text)):
        state = moves[state][classes[text[i]]]
        if state == dead:
            break
        if accepts[state]:
            end = i + 1
    return end
