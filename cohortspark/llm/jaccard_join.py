"""Exact Jaccard join of documents over word shingles, as a join in the metric space of sets."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, removed, saved, shuffle_partitions, small, text_batches, unused, written
from .graphs import components
from .shingles import mixed, shingle_sets

#: What a region may hold to be joined in one task: sets, and shingles of all of them.
LEAF_SETS, LEAF_SHINGLES = 4096, 1_000_000
#: Pivots of a region that is split, at least (if it has as many sets) and at most.
FEW_PIVOTS, PIVOTS = 8, 32
#: Shingles of sets that are verified at once.
VERIFIED = 1 << 19
#: Texts that are cut into shingles at once, by characters.
CHUNK = 1 << 19
#: Sets of equal key that are compared in one sweep with those of other keys, sets compared at once where a key has more, and
#: the number beyond which the key is split into cells of so many sets, which are compared two by two.
FEW, BLOCK, CELL = 16, 512, 4096
#: Rows that are compared in one sweep, about.
SWEEP = 20_000
#: The similarity in percent from which classes make the keys.
CLASSES_FROM = 85
#: Sets whose keys a task remembers to have given.
REMEMBERED = 500_000


def tops(steps: int) -> list[int]:
    """The largest size of each level, `steps` levels to an octave; in whole numbers, so that all tasks agree."""
    out = []
    for k in range(40 * steps):
        top = int(2 ** (k / steps)) + 2
        while top**steps >= 1 << k:
            top -= 1
        out.append(top)
    return out


#: Classes want levels close to each other, for a class holds the more hashes the fewer the level's sets can differ in; first
#: hashes don't depend on the level, so octaves do, in which fewer sets lie on a border.
_FINE, _OCTAVES = tops(3), tops(1)


def tops_for(percent: int) -> list[int]:
    return _FINE if percent >= CLASSES_FROM else _OCTAVES


def level_of(size: int, percent: int) -> int:
    return bisect_left(tops_for(percent), size)


def levels(size: int, percent: int) -> list[int]:
    """The levels at which a set meets its partners: from its own to that of the largest one it can have, so that every pair
    meets at the level of the larger set; two at most."""
    top = tops_for(percent)
    return [k for k in range(level_of(size, percent), level_of(100 * size // percent, percent) + 1) if top[k] > top[k - 1]]


def sketch_width(level: int) -> int:
    """Classes of a sketch at a level: about a tenth of the shingles, so that counts of unrelated sets differ enough; 512 at most,
    as every key of a set brings its sketch along."""
    return min(512, max(64, 1 << max(0, level - 3)))


def first_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The smallest of the set's hashes, so many that two sets with a similarity of percent / 100 or more share at least one.
    (If sets of sizes a <= b share c >= percent / 100 * b hashes, all but b - c of the larger's are shared; so the least shared
    one is among the first size - least + 1 of either.)"""
    n = len(shingles)
    return shingles[: n + (-percent * n // 100) + 1]


def class_keys(shingles: np.ndarray, top: int, percent: int, seed: int = 0) -> np.ndarray:
    """The contents of classes into which the hashes are dealt, so many that two sets of at most `top` shingles with a similarity
    of percent / 100 or more have at least one equal.

    Such sets differ in at most d hashes, each of which spoils one class, so of m = d + 1 + spare classes at least spare + 1 are
    equal. A set with at most `spare` empty classes thus has an equal one that isn't empty; only sets with more give keys for
    their empty classes, too. Where d is 0 only equal sets are linked, and one hash tells. Seeds deal differently.
    """
    d = 2 * top * (100 - percent) // (100 + percent)
    if d == 0:
        return shingles[:1]
    spare = 1 + d // 32
    m = d + 1 + spare
    dealt = mixed(shingles + np.uint64(seed)) if seed else shingles
    place = (dealt % np.uint64(m)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    which, first = np.unique(place[order], return_index=True)
    with np.errstate(over="ignore"):
        keys = mixed(np.add.reduceat(mixed(shingles[order]), first) ^ mixed(which.astype(np.uint64)))
        if m - len(which) > spare:
            keys = np.concatenate([keys, mixed(mixed(np.setdiff1d(np.arange(m), which).astype(np.uint64)) + np.uint64(1))])
    return keys


def block_keys(shingles: np.ndarray, percent: int, seed: int = 0) -> list[np.ndarray]:
    """For each of the set's levels keys of which two sets that may be linked share at least one there.

    From CLASSES_FROM percent on a class holds so many hashes that unrelated sets hardly have one in common, however common
    their shingles; below that classes get too small, and the first hashes are fewer and tell more.
    """
    top = tops_for(percent)
    with np.errstate(over="ignore"):
        return [mixed((class_keys(shingles, top[level], percent, seed) if percent >= CLASSES_FROM else first_keys(shingles, percent)) ^ (np.uint64(level) * np.uint64(0xD1B54A32D192ED03))) for level in levels(len(shingles), percent)]


def sketch(shingles: np.ndarray, level: int) -> np.ndarray:
    """Counts of the shingles by hash class, up to 255: the sum of differences of two sketches is at most the number of shingles
    that the sets differ in."""
    counts = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % sketch_width(level), minlength=sketch_width(level))
    return np.minimum(counts, 255).astype(np.uint8)


def fingerprint(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def chunks(texts: list) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < CHUNK):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def with_keys(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node: the set's fingerprint, null for the empty set, and for each of its levels the level,
    keys and sketch) of every whole text. A task gives keys and sketch of equal sets once, as long as it remembers them."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given: set[int] = set()
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            for i, j in chunks(texts):
                sets = list(shingle_sets(texts[i:j], width))
                nodes = [fingerprint(s) if len(s) else None for s in sets]
                parts = []
                for node, s in zip(nodes, sets):
                    new = node is not None and node not in given
                    parts.append([{"level": n, "keys": k.view(np.int64), "sketch": sketch(s, n).tobytes() if percent < CLASSES_FROM else None} for n, k in zip(levels(len(s), percent), block_keys(s, percent))] if new else [])
                    if new:
                        if len(given) > REMEMBERED:
                            given.clear()
                        given.add(node)
                out = pd.DataFrame({"doc_id": batch["doc_id"].iloc[i:j].astype("Int64"), "text_hash": batch["text_hash"].iloc[i:j], "n_shingles": [len(s) for s in sets]})
                out["node"] = pd.array(nodes, "Int64")
                out["parts"] = parts
                yield out

    return hashed(docs).mapInPandas(cut, "doc_id long, text_hash long, n_shingles long, node long, parts array<struct<level: int, keys: array<long>, sketch: binary>>")


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash): what tells a row where ids are null or repeat."""
    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, low: its least node, members) of the keys of keys (node, key) that several nodes have."""
    return keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("_high"), F.count(F.lit(1)).alias("members")).where("low < _high").select("key", "low", "members")


def key_edges(keys: DataFrame) -> DataFrame:
    """Edges (a, b) that join the nodes of each key, as stars."""
    return keys.join(shared_keys(keys), "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()


def keys_again(docs: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """(node, key) of documents (node, region, text): block keys by another seed, which count inside a region only."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            for i, j in chunks(texts):
                keys = [np.concatenate(block_keys(s, percent, seed)) for s in shingle_sets(texts[i:j], width)]
                n = [len(k) for k in keys]
                with np.errstate(over="ignore"):
                    every = mixed(np.concatenate(keys) ^ mixed(np.repeat(batch["region"].to_numpy()[i:j], n).astype(np.int64).view(np.uint64)))
                yield pd.DataFrame({"node": np.repeat(batch["node"].to_numpy()[i:j], n), "key": every.view(np.int64)})

    return docs.select("node", "region", "text").mapInPandas(cut, "node long, key long").repartition(shuffle_partitions(docs.sparkSession), "key")


def close_pairs(size: np.ndarray, sketches: np.ndarray, a: slice, b: slice, percent: int) -> np.ndarray:
    """Which pairs of two runs of sets may be linked by what sizes and sketches say: the only ones that aren't are sets of which
    one is too small for the other, or whose sketches differ by more than linked sets of their sizes can."""
    x, y = sketches[a].astype(np.int16).T, sketches[b].astype(np.int16).T.copy()  # classes first: rows of pairs are added up
    wide = np.int16 if len(y) <= 128 else np.int32  # 128 * 255 fits
    difference = np.stack([np.abs(y - x[:, i : i + 1]).sum(0, dtype=wide) for i in range(x.shape[1])]).astype(np.int64)
    n, m = size[a][:, None], size[b][None, :]
    return (difference <= (100 - percent) * (n + m) // (100 + percent)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def forest(close: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the pairs of `close` join, without rings."""
    out, rows, columns = [], np.ones(len(left), bool), np.ones(len(right), bool)
    for i in range(len(left)):
        if not rows[i]:
            continue
        rows[i], front = False, [i]
        while front:
            reached = np.flatnonzero(close[front].any(0) & columns)
            columns[reached] = False
            out += [(left[i], right[j]) for j in reached]
            back = np.flatnonzero(close[:, reached].any(1) & rows) if len(reached) else []
            rows[back] = False
            out += [(left[i], left[j]) for j in back]
            front = list(back)
    return out


def group_edges(node: np.ndarray, size: np.ndarray, sketches: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that join the sets of one key that may be linked, in blocks along their sizes."""
    order = np.argsort(size, kind="stable")
    node, size, sketches, out = node[order], size[order], sketches[order], []
    for i in range(0, len(node), BLOCK):
        for j in range(i, len(node), BLOCK):
            if 100 * size[min(i + BLOCK, len(node)) - 1] < percent * size[j]:
                break
            a, b = slice(i, i + BLOCK), slice(j, j + BLOCK)
            out += forest(close_pairs(size, sketches, a, b, percent), node[a], node[b])
    return out


def cross_edges(node: np.ndarray, size: np.ndarray, sketches: np.ndarray, first: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that join each set of the `first` with those of the rest that may be linked to it."""
    a, b, out = np.flatnonzero(first), np.flatnonzero(~first), []
    a, b = a[np.argsort(size[a], kind="stable")], b[np.argsort(size[b], kind="stable")]
    for i in range(0, len(a), BLOCK):
        x = a[i : i + BLOCK]
        for j in range(0, len(b), BLOCK):
            y = b[j : j + BLOCK]
            if 100 * size[x[-1]] < percent * size[y[0]]:
                break
            if 100 * size[y[-1]] >= percent * size[x[0]]:
                both = np.concatenate([x, y])
                out += forest(close_pairs(size[both], sketches[both], slice(0, len(x)), slice(len(x), len(both)), percent), node[x], node[y])
    return out


def spanning(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """So many of the edges that they join the same."""
    root: dict[int, int] = {}

    def of(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for a, b in edges:
        x, y = of(a), of(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def large_keys_linked(members: DataFrame, sketches: DataFrame, percent: int, cell: int = CELL) -> DataFrame:
    """The edges of may_be_linked for keys with any number of members (key, level, node), with sketches (node, level, size,
    sketch) of all nodes.

    A key's members are dealt by size into bands, so wide that linked sets are in the same band or in neighbouring ones, and
    bands by hash into cells of about `cell` sets. Every two cells of a band or of neighbouring bands, and every cell with
    itself, are compared in a group of their own: every pair is tested, no task holds more than two cells, and the work grows
    with the square of a band's members.
    """
    rows = members.select("key", "level", "node").distinct().join(sketches, ["node", "level"])
    width = math.log(100 / percent) * (1 + 1e-6)
    rows = saved(rows.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / width).cast("int")), "large-keys")
    bands = checkpointed(rows.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("cells")))
    near = [bands.select("key", (F.col("band") - step).alias("band"), F.col("cells").alias(name)) for step, name in ((-1, "below"), (1, "above"))]
    table = bands.join(near[0], ["key", "band"], "left").join(near[1], ["key", "band"], "left")
    rows = rows.join(small(table), ["key", "band"]).withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))

    def cells(n: Column, one: Callable[[Column], Column]) -> Column:
        return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), one)

    def two(low_band: Column, low: Column, high_band: Column, high: Column, first: Column) -> Column:
        return F.struct(low_band.alias("low_band"), low.alias("low"), high_band.alias("high_band"), high.alias("high"), first.alias("first"))

    band, own = F.col("band"), F.col("cell")
    same = cells(F.col("cells"), lambda k: two(band, F.least(own, k), band, F.greatest(own, k), own <= k))
    above = cells(F.col("above"), lambda k: two(band, own, band + 1, k, F.lit(True)))
    below = cells(F.col("below"), lambda k: two(band - 1, k, band, own, F.lit(False)))
    dealt = rows.select("key", "node", "size", "sketch", F.explode(F.concat(same, above, below)).alias("two")).select("key", "two.*", "node", "size", "sketch")

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        node, size, first = rows["node"].to_numpy(), rows["size"].to_numpy(), rows["first"].to_numpy(bool)
        sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
        own = tuple(rows[["low_band", "low"]].iloc[0]) == tuple(rows[["high_band", "high"]].iloc[0])
        found = group_edges(node, size, sketches, percent) if own else cross_edges(node, size, sketches, first, percent)
        return pd.DataFrame(spanning(found), columns=["a", "b"], dtype="int64")

    return dealt.groupBy("key", "low_band", "low", "high_band", "high").applyInPandas(compared, "a long, b long")


def may_be_linked(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) among members (key, level, node, size, sketch) of the same key and level, so that every two that may be
    linked are joined, directly or over others. Rows are dealt by key and sorted, so a task meets one key after the other and
    holds one key's members, which are to be CELL at most; keys with few members, which most are, are compared many at a time."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            if not len(batch):
                continue
            last = batch["key"].iloc[-1]
            done = batch["key"].ne(last)
            held.append(batch)
            rows += len(batch)
            if rows >= SWEEP:
                every = pd.concat(held)
                open_ = every["key"].eq(last)  # its key may go on in the next batch
                if not open_.all():
                    yield compared(every[~open_])
                    every = every[open_]
                held, rows = [every.drop_duplicates(["key", "level", "node"])], 0
        if held:
            yield compared(pd.concat(held))

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[np.ndarray] = []
        rows = rows.drop_duplicates(["key", "level", "node"])
        for level, part in rows.groupby("level", sort=False):
            part = part.sort_values(["key", "size", "node"])
            key, node, size = part["key"].to_numpy(), part["node"].to_numpy(), part["size"].to_numpy()
            sketches = np.frombuffer(b"".join(part["sketch"]), np.uint8).reshape(len(part), -1)
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.diff(np.append(begin, len(key)))
            few = np.repeat(count <= FEW, count)
            for k in range(1, FEW):
                i = np.flatnonzero(few[: len(key) - k] & (key[: len(key) - k] == key[k:])) if len(key) > k else np.empty(0, int)
                for a in range(0, len(i), 4096):
                    x, y = i[a : a + 4096], i[a : a + 4096] + k
                    d = np.abs(sketches[x].astype(np.int16) - sketches[y]).sum(1, dtype=np.int32)
                    ok = (d <= (100 - percent) * (size[x] + size[y]) // (100 + percent)) & (100 * size[x] >= percent * size[y])
                    out.append(np.stack([node[x[ok]], node[y[ok]]], 1))
            for a, n in zip(begin[count > FEW], count[count > FEW]):
                found = group_edges(node[a : a + n], size[a : a + n], sketches[a : a + n], percent)
                if found:
                    out.append(np.array(found, np.int64))
        pairs = np.unique(np.concatenate([np.empty((0, 2), np.int64), *out]), axis=0)
        return pd.DataFrame(pairs, columns=["a", "b"])

    dealt = members.repartition(shuffle_partitions(members.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInPandas(edges, "a long, b long").distinct()


def with_sets(docs: DataFrame, width: int) -> DataFrame:
    """(region: as text, node, size, shingles) of documents (node, region, text)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            for i, j in chunks(texts):
                sets = list(shingle_sets(texts[i:j], width))
                out = pd.DataFrame({"region": batch["region"].iloc[i:j], "node": batch["node"].iloc[i:j], "size": [len(s) for s in sets]})
                out["shingles"] = [s.view(np.int64) for s in sets]
                yield out

    return docs.select(F.col("region").cast("string").alias("region"), "node", "text").mapInPandas(cut, "region string, node long, size long, shingles array<long>")


def overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of every set with every one of `others` (or of the sets themselves)."""
    own, n = others is None, len(sets)
    every = sets if own else sets + others
    values, at = np.unique(np.concatenate(every), return_inverse=True)
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    shared = np.bincount(at, minlength=len(values)) > 1
    column = (np.cumsum(shared) - 1)[at]
    keep = shared[at]
    owner, column = owner[keep], column[keep]
    out = np.zeros((n, len(every) - n if not own else n), np.float32)
    step = max(1, (1 << 22) // len(every))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(shared.sum()), step):
        i, j = np.searchsorted(column, [a, a + step])
        part = np.zeros((len(every), step), np.float32)
        part[owner[i:j], column[i:j] - a] = 1
        out += part[:n] @ (part if own else part[n:]).T
    return out  # whole numbers below 2**24 are exact


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    n = end - begin
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def joined(sets: list[np.ndarray], percent: int, first: np.ndarray | None = None) -> np.ndarray:
    """For each set the least place among those that links join it with, directly or over others. first: only pairs of one of
    the `first` and one of the rest are compared.

    Shingles count from the rarest here to the commonest. In that order linked sets of sizes a <= b, which share at least
    percent / 100 * b, have one in common among the first b - that + 1 of either: sets that have none aren't compared, nor
    are sets that are joined already. The others are, exactly.
    """
    n, size = len(sets), np.array([len(s) for s in sets])
    label = np.arange(n)
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int32)
    rank[np.argsort(count, kind="stable")] = np.arange(len(values), dtype=np.int32)
    alone = int((count == 1).sum())  # these come first and are in no second set
    code, owner, starts = rank[code.reshape(-1)], np.repeat(np.arange(n, dtype=np.int32), size), np.concatenate(([0], np.cumsum(size)))
    code = code[np.lexsort((code, owner))]
    near = size + (-percent * size // 100) + 1
    entry = np.flatnonzero((np.arange(len(code)) - starts[owner] < near[owner]) & (code >= alone))
    by = np.argsort(code[entry], kind="stable")
    held, met = code[entry][by], owner[entry][by]  # owners of each shingle in order
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    begin = np.searchsorted(held, code[entry])
    own = np.searchsorted(owner[entry], np.arange(n + 1))
    mark = np.zeros(len(values), bool)
    for i in range(n):
        a, b = own[i], own[i + 1]
        c = met[ranges(begin[a:b], place[a:b])]  # those before i
        c = np.unique(c[label[c] != label[i]])
        c = c[(100 * size[c] >= percent * size[i]) & (100 * size[i] >= percent * size[c])]
        if first is not None:
            c = c[first[c] != first[i]]
        if not len(c):
            continue
        mark[code[starts[i] : starts[i + 1]]] = True
        step = 16
        while len(c):
            now, c = c[:step], c[step:]
            inter = np.add.reduceat(mark[code[ranges(starts[now], starts[now + 1])]], np.cumsum(size[now]) - size[now], dtype=np.int64)
            for j in now[100 * inter >= percent * (size[now] + size[i] - inter)]:
                low, high = sorted((label[i], label[j]))
                if low < high:
                    label[label == high] = low
            c = c[label[c] != label[i]]
            step = max(1, min(2 * step, VERIFIED // max(1, int(size[i]))))
        mark[code[starts[i] : starts[i + 1]]] = False
    return label


def leaf_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """All sets of a region joined; what is returned joins each set to the first of its component here. Where rows have a part,
    only pairs of sets of different parts count."""
    node = rows["node"].to_numpy()
    part = rows["part"].to_numpy() if "part" in rows else None
    first = None if part is None or (part == part[0]).all() else part == part[0]
    at = joined([np.asarray(s) for s in rows["shingles"]], percent, first)
    moved = node != node[at]
    return pd.DataFrame({"a": node[moved], "b": node[at[moved]]}, dtype="int64")


def regions_joined(rows: DataFrame, percent: int) -> DataFrame:
    """leaf_links of every region of rows (region, node, shingles), each of which a task can hold. Rows are dealt and sorted by
    region, so a task meets one region after the other and holds a batch and an open region."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            if not len(batch):
                continue
            region = batch["region"].to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(region[1:] != region[:-1]) + 1))
            yield from found(batch, cuts, cuts[1:])
            held = batch.iloc[cuts[-1] :]
        if held is not None:
            yield leaf_links(held, percent)

    def found(batch: pd.DataFrame, begin: np.ndarray, end: np.ndarray) -> Iterator[pd.DataFrame]:
        out = [leaf_links(batch.iloc[a:b], percent) for a, b in zip(begin, end) if b > a + 1]
        if out:
            yield pd.concat(out, ignore_index=True)

    dealt = rows.select("region", "node", "shingles").repartition(shuffle_partitions(rows.sparkSession), "region").sortWithinPartitions("region")
    return dealt.mapInPandas(links, "a long, b long")


def split_region(rows: pd.DataFrame, pivots: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Rows of a part of a region dealt to the pivots' Voronoi regions, boundary rows to every region in reach."""
    sets, points = [np.asarray(s) for s in rows["shingles"]], [np.asarray(s) for s in pivots["shingles"]]
    a, b = np.array([len(s) for s in sets]), np.array([len(s) for s in points])
    inter = overlaps(sets, points)
    distance = 1 - inter / (a[:, None] + b[None, :] - inter)
    reach = distance.min(1, keepdims=True) + 2 * (1 - percent / 100) + 1e-6
    i, j = np.nonzero(distance <= reach)
    out = rows.iloc[i][["region", "node", "size", "shingles"]].reset_index(drop=True)
    out["region"] = out["region"] + "/" + pd.Series(pivots["node"].to_numpy()[j].astype(str))
    out["members"] = rows["members"].iloc[i].to_numpy()
    return out


def within(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other pivots each one would be dealt to, if it were a set of its region and they were the pivots."""
    size, inter = np.array([len(s) for s in sets]), overlaps(sets)
    distance = 1 - inter / (size[:, None] + size[None, :] - inter)
    np.fill_diagonal(distance, np.inf)
    return distance <= distance.min(1, keepdims=True) + 2 * (1 - percent / 100) + 1e-6


def parting(pivots: pd.DataFrame, percent: int) -> float:
    """The share of a region's sets in the largest part that pivots would give, judged by its pivots, which are drawn by hash:
    each is dealt to the others. Too few of them tell nothing."""
    if len(pivots) < 4:
        return 0.0
    sets = [np.asarray(s) for s in pivots["shingles"]]
    return float(within(sets, percent).sum(0).max() / (len(sets) - 1))


def copies(pivots: pd.DataFrame, percent: int) -> float:
    """How many regions a set would enter on average, judged by the pivots as in `parting`."""
    n = len(pivots)
    if n < 4:
        return 1.0
    sets = [np.asarray(s) for s in pivots["shingles"]]
    return n * float(within(sets, percent).sum()) / (n * (n - 1))


def region_links(regions: DataFrame, percent: int, leaf_sets: int = LEAF_SETS, leaf_shingles: int = LEAF_SHINGLES, pivots: int = PIVOTS) -> DataFrame:
    """Links (a, b) that join every two sets of a region (region, node, size, shingles) with the similarity asked for, directly
    or over other sets. They are written level by level, and a finished level's regions are removed.

    A region that fits a task is compared there. A larger one is split: some of its sets become pivots, each set goes to the
    region of its nearest pivot, at distance r, and to that of every pivot within r + 2 e of it, where e is the largest
    distance of a link. By the triangle inequality a linked partner is in the region of the nearer one's pivot, so the
    regions, joined the same way again, find every link. Where that would copy sets more often than it is worth (its sets
    lie within 2 e of many pivots, so the metric can't part them), which its pivots tell before a row is copied to them or
    else the sizes of the parts, its sets are dealt over parts and every two parts are compared in a task of their own:
    exact, in bounded memory, and the only place with work in the square of a region's size.
    """
    spark = regions.sparkSession
    links: list[DataFrame] = []
    regions, path = regions.withColumn("members", F.lit(None).cast("long")), None  # members: of the region it was split from
    while True:
        sizes = regions.groupBy("region").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("elements"), F.max("members").alias("parent"))
        parts = F.ceil(F.greatest(F.col("sets") / leaf_sets, F.col("elements") / leaf_shingles)).cast("int")
        large = checkpointed(sizes.withColumn("parts", parts).where("parts > 1 and sets > 2"))
        if large.isEmpty():
            links.append(saved(regions_joined(regions, percent), "links"))
            break
        marked = regions.drop("members").join(small(large), "region", "left")
        links.append(saved(regions_joined(marked.where("parts is null"), percent), "links"))
        rows = marked.where("parts is not null").withColumn("part", F.pmod(F.xxhash64("node", F.length("region")), F.col("parts")).cast("int"))
        share = F.least(F.lit(1.0), F.least(F.lit(pivots), F.greatest(F.lit(FEW_PIVOTS), 2 * F.col("parts"))) / F.col("sets"))
        points = rows.where(F.pmod(F.xxhash64("region", "node"), F.lit(1 << 30)) < share * (1 << 30))
        least = checkpointed(rows.groupBy("region").agg(F.min("node").alias("node")))  # one at least
        points = points.select("region", "node", "shingles", "parts").unionByName(rows.join(small(least), ["region", "node"], "left_semi").select("region", "node", "shingles", "parts")).dropDuplicates(["region", "node"])
        points = saved(points, "pivots")
        judged = points.groupBy("region").applyInPandas(lambda r: pd.DataFrame({"region": r["region"].iloc[:1], "share": parting(r, percent), "copies": copies(r, percent)}), "region string, share double, copies double")
        close = (F.col("share") > 0.7) | (F.col("sets") > 0.7 * F.col("parent")) | (F.col("copies") > F.greatest(F.lit(1.5), F.col("parts") / 4))
        stuck = checkpointed(judged.join(small(large), "region").where(F.coalesce(close, F.lit(False))).select("region", F.lit(True).alias("stuck")))
        rows = rows.join(small(stuck), "region", "left").withColumn("stuck", F.coalesce("stuck", F.lit(False)))
        twos = rows.where("stuck").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        twos = twos.select("region", "node", "part", "shingles", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
        links.append(saved(twos.groupBy("region", "low", "high").applyInPandas(lambda r: leaf_links(r, percent), "a long, b long"), "links"))
        points = points.join(small(stuck), "region", "left_anti").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        rows = rows.where("not stuck").select("region", "part", "node", "size", "shingles", F.col("sets").alias("members"))
        split = rows.groupBy("region", "part").cogroup(points.groupBy("region", "part")).applyInPandas(lambda r, p: split_region(r, p, percent) if len(r) else r.assign(region="")[["region", "node", "size", "shingles", "members"]], "region string, node long, size long, shingles array<long>, members long")
        done = path
        regions, path = written(split, "regions")
        removed(spark, done)
    removed(spark, path)
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def joined_documents(docs: DataFrame, width: int, percent: int, cell: int, **limits: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, root: the same for documents that links join; null for empty sets); see
    jaccard_components."""
    spark = docs.sparkSession
    keyed, keyed_path = written(with_keys(docs, width, percent), "shingle-keys")
    slim = saved(keyed.drop("parts"), "shingle-sizes")
    part = keyed.select("node", F.col("n_shingles").alias("size"), F.explode("parts").alias("part"))
    keys = part.select("node", F.col("part.level").alias("level"), F.explode("part.keys").alias("key")).repartition(shuffle_partitions(spark), "key")  # one shuffle for both uses
    if percent >= CLASSES_FROM:
        maybe = key_edges(keys)
    else:
        sketches = part.groupBy("node", F.col("part.level").alias("level")).agg(F.first("size").alias("size"), F.first("part.sketch").alias("sketch"))
        sketches = saved(sketches, "sketches")
        members = saved(keys.join(shared_keys(keys).select("key", "members"), "key"), "members")  # without sketches, which large keys get when split
        maybe = may_be_linked(members.where(F.col("members") <= cell).drop("members").join(sketches, ["node", "level"]), percent)
        large = members.where(F.col("members") > cell)
        if not large.isEmpty():
            maybe = maybe.unionByName(large_keys_linked(large, sketches, percent, cell))
    region = components(maybe).select("node", F.col("root").alias("region"))
    removed(spark, keyed_path)

    # one document for each node, before any join: numbers only, so that copies are combined before the shuffle
    one = slim.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("_id"), F.min_by("text_hash", "doc_id").alias("_of_id"), F.min("text_hash").alias("_any"))
    wanted = checkpointed(one.join(region, "node").select("node", "region", "_id", F.coalesce("_of_id", "_any").alias("_hash")))

    def texts(wanted: DataFrame) -> DataFrame:
        rows = hashed(docs)
        rows = rows.join(small(wanted, 200_000), rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["text_hash"] == F.col("_hash"))).select("node", "region", "text")
        return rows.dropDuplicates(["node"])

    crowded = wanted.groupBy("region").count().where(F.col("count") > limits.get("leaf_sets", LEAF_SETS)).select("region")
    crowded = checkpointed(wanted.join(small(checkpointed(crowded)), "region", "left_semi"))
    if percent >= CLASSES_FROM and not crowded.isEmpty():
        again = components(key_edges(keys_again(texts(crowded), width, percent, seed=1))).select("node", F.col("root").alias("region"))
        wanted = checkpointed(wanted.join(crowded.select("node"), "node", "left_anti").unionByName(crowded.drop("region").join(again, "node").select(wanted.columns)))
    sets, sets_path = written(with_sets(texts(wanted), width), "shingle-sets")
    links = region_links(sets, percent, **limits)
    roots = components(links)
    removed(spark, sets_path)
    return slim.join(roots, "node", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("root", "node").alias("root"))


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, cell: int = CELL, **limits: int) -> DataFrame:
    """Documents (doc_id, text) joined where the Jaccard similarity of their shingle sets is percent / 100 or more, exactly.

    Returns a row for each: doc_id, n_shingles (size of its set) and component_id (the smallest doc_id that links reach,
    itself included). Texts without words (or null) have an empty set and are linked with nothing. Repeated rows have equal
    sets and so one component; rows without a doc_id are compared like others, but a null is in no component_id unless all of
    a component are null. Other columns are ignored, and an empty table gives none. Equal sets are told by a 64-bit
    fingerprint.

    1. Equal sets are one node. Nodes that share a block key may be linked; all others can't be (block_keys is exact; between
       unrelated texts all distances are 1, so no pivot could part them). Keys of one node alone end in an aggregation. The
       components of "may be linked" are regions. From CLASSES_FROM percent on those that no task can hold are cut once more
       by keys of another seed inside them; below, where unrelated nodes share keys more often, sizes and sketches rule out
       most of them. Both are exact, too.
    2. Only these regions' sets are built, once for each node. region_links joins them by pivots, Voronoi regions and
       triangle windows, recursively.
    3. Components of the links give each node its root, and each root its smallest doc_id.
    """
    out = joined_documents(docs, width, percent, cell, **limits)
    first = checkpointed(out.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    out = out.join(first, "root", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, width: int = 3, percent: int = 90, cell: int = CELL, **limits: int) -> DataFrame:
    """docs with the first document of each component, by doc_id (null last), then by the hash of its text; all columns stay as
    they are. Documents without words stay, as they are linked with nothing. Of rows that are equal in doc_id and text, one
    stays, the least by all other columns that can be ordered."""
    found = joined_documents(docs, width, percent, cell, **limits)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = found.where("root is not null").groupBy("root").agg(F.min(order).alias("d"), F.count(F.lit(1)).alias("rows"))
    kept_id, kept_hash, rows = (unused(docs, c) for c in ("__kept_id", "__kept_hash", "__rows"))
    kept = checkpointed(first.select(F.col("d.doc_id").alias(kept_id), F.col("d.text_hash").alias(kept_hash), F.col("rows").alias(rows)))
    empty = checkpointed(found.where("root is null").select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash)).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.xxhash64("text") == F.col(kept_hash))
    wordless = docs.join(empty, same, "left_semi")
    sole = docs.join(kept.where(F.col(rows) == 1), same, "left_semi")
    several = docs.join(kept.where(F.col(rows) > 1), same, "left_semi")
    rest = [c for c, t in docs.dtypes if c not in ("doc_id", "text") and "map<" not in t and "variant" not in t]
    place = unused(docs, "__place")
    order = Window.partitionBy("doc_id", "text").orderBy(*[F.col(f"`{c}`") for c in rest] or [F.lit(0)])
    several = several.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return sole.unionByName(several).unionByName(wordless)
