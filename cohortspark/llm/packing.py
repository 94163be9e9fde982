"""Packing of token sequences by best-fit decreasing."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: Tokens of a window.
WINDOW = 1024
#: Documents whose pieces are packed together, about.
GROUP = 4096
#: Words that a task remembers with their ids; beyond that it starts anew.
REMEMBERED = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 stays, the rest moves to 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class WordIds(dict):
    """Ids of a text under a byte-level BPE vocabulary file, as little-endian 32-bit bytes.

    The vocabulary splits a text before every single space between non-space characters, whatever stands around it, so the
    ids of a text are those of such words one after the other. Words come again and again: each is encoded once and then
    looked up. Texts with other white space at a word's edge are encoded whole.

    `ids` gives what the library's `encode(text, add_special_tokens=False)` gives: the strings of the file's added tokens
    become their ids wherever they stand, and the text between them is encoded piece by piece. To `of` they are ordinary text.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, added = file["model"]["vocab"], file["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that look at their surroundings aren't supported")
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if all(c in alphabet for c in token)}
        for t in added:
            ranks.pop(t["content"].encode(), None)
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self.cuts = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.whole(" " + word)
        return ids

    def of(self, text: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        words = text.split(" ")
        if len(words) == 1 or not all(words) or any(w[0].isspace() or w[-1].isspace() for w in words):
            return self.whole(text)
        return self.whole(words[0]) + b"".join(map(self.__getitem__, words[1:]))

    def ids(self, text: str) -> bytes:
        if not any(c in text for c in self.added):
            return self.of(text)
        pieces = self.cuts.split(text)  # text and added tokens in turn
        return b"".join(self.added[p] if i % 2 else self.of(p) for i, p in enumerate(pieces) if p)


def cut_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Pieces of documents (doc_id, text): the ids of each text and then end_id, cut into full windows and one shorter rest.

    Returns doc_id, start (the document's ids before the piece), length, ids_crc32 (of the ids as little-endian unsigned
    32-bit), doc_tokens, repeat (how many equal pieces came before it in its batch of rows), and with keep_ids also ids (array
    of int). Null text is empty: its one piece is end_id alone.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordIds(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = words.ids(text) + end if isinstance(text, str) else end
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, *([np.frombuffer(piece, "<u4").astype("int32")] if keep_ids else [])))
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["repeat"] = out.groupby(["doc_id", "start", "ids_crc32"], dropna=False).cumcount()
            yield out

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids + ", repeat long"
    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree of counts: leaves are capacities 1..window, and an inner node
    holds how many windows are open below it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, sequence: int) -> None:
        self.held[capacity].append(sequence)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, length: int) -> int:
        """The least capacity of an open window that is at least length; 0 if none is."""
        count, i = self.count, length + self.leaves
        if count[i]:
            return length
        while i > 1:
            if not i & 1 and count[i + 1]:  # the subtree right of here holds the next larger capacities
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return 0

    def take(self, capacity: int) -> int:
        i = capacity + self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.held[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length (1..window): longest first, each into the open window with the least room for it."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened, windows = 0, OpenWindows(window)
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        room = windows.tightest(n) if n < window else 0
        if room:
            k = windows.take(room)
        else:
            k, room, opened = opened, window, opened + 1
        sequence[i], offset[i] = k, window - room
        if room > n:
            windows.put(room - n, k)
    return sequence, offset


def pack_pieces(pieces: DataFrame, groups: int, window: int = WINDOW) -> DataFrame:
    """pieces (start, length, ids_crc32, doc_tokens, doc_id and repeat, further columns stay) with sequence_id and offset, less
    repeat.

    Pieces are dealt over `groups` by a hash of where they come from and packed within their group, so no task holds more
    than a group and groups don't wait for each other; at a few thousand pieces a group, what the last windows of each
    leave open is well under a thousandth. Equal pieces (repeated rows) are packed one by one, and `repeat` deals them over
    the groups, however many there are. sequence_id is the group's
    number times 2**40 plus the window's in the group; rows of a group are ordered before packing, so reruns agree.
    """

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        sequence, offset = best_fit_decreasing(group["length"].to_numpy(), window)
        group["sequence_id"] = group["_group"].astype("int64") * (1 << 40) + sequence
        group["offset"] = offset
        return group.drop(columns=["_group", "repeat"])

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "repeat"), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "repeat") + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 0, keep_ids: bool = True, group: int = GROUP) -> DataFrame:
    """documents (doc_id, text) packed into sequences of at most `window` ids; a row for each piece.

    Every id of every whole text lies in exactly one piece; a sequence's pieces lie gapless from offset 0. Columns: those of
    cut_documents, sequence_id and offset. Null doc_ids and repeated rows are documents of their own; an empty table gives
    none. With keep_ids the ids travel along (sequences can be written at once); without, only their digests do.
    """
    groups = max(1, -(-docs.count() // group))
    return pack_pieces(cut_documents(docs, tokenizer_path, window, end_id, keep_ids), groups, window)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The sequences themselves, from pack_documents with keep_ids: sequence_id, ids padded to `window` (except at a power of
    two) and, for each id, the place of its document's piece in the sequence, from 1 (padding: 0)."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))  # at most `window` pieces
    rows = rows.select("sequence_id", F.flatten(F.col("pieces.ids")).alias("ids"), F.flatten(F.transform("pieces", lambda p, i: F.array_repeat(i + 1, F.size(p.ids)))).alias("segments"))
    n = F.size("ids")
    missing = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(window) - n)
    return rows.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), missing)).alias("ids"), F.concat("segments", F.array_repeat(F.lit(0), missing)).alias("segments"))
