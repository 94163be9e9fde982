import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortspark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
_DEFAULT = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def words():
    return packing.WordIds(PATH)


_TEXT = st.lists(st.sampled_from(["a", " ", "  ", "\n", "\n\n ", "\t", "don't", "'s", "12", "é", "ñandú", "。", "🙂", "<|endoftext|>", "the ", " of", " ", " ", "\r\n", "x" * 30, "#!?"]), max_size=30).map("".join) | st.text(max_size=60)


@settings(max_examples=400, deadline=None)
@given(text=_TEXT)
def test_ids_are_the_tokenizers(tokenizer, words, text):
    assert np.frombuffer(words.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def best_fit(lengths, window):
    """Best-fit decreasing by looking at every open window."""
    room, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [k for k in range(len(room)) if room[k] >= lengths[i]]
        k = min(fits, key=lambda k: room[k]) if fits else len(room)
        if not fits:
            room.append(window)
        room[k] -= lengths[i]
        out[i] = k
    return room, out


@settings(max_examples=100, deadline=None)
@given(lengths=st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_decreasing(lengths):
    sequence, offset = packing.best_fit_decreasing(np.array(lengths, int), 16)
    room, _ = best_fit(lengths, 16)
    used = {}
    for i in sorted(range(len(lengths)), key=lambda i: (sequence[i], offset[i])):
        assert offset[i] == used.get(sequence[i], 0)
        used[sequence[i]] = offset[i] + lengths[i]
    assert sorted(16 - u for u in used.values()) == sorted(room)


def test_documents(spark, documents, tokenizer):
    rows = [(i, f"word{i} " * (i * 13 % 90)) for i in range(120)] + [(500, None), (501, ""), (None, "no id"), (7, "word7 " * 91), (502, "long " * 9000), (503, "same"), (503, "same")]
    packed = packing.pack_documents(documents(rows), PATH, window=64, group=40)
    got = packed.collect()
    assert len(documents(rows).columns) == 5 and sum(r.length for r in got) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    by = {}
    for r in got:
        assert r.length == len(r.ids) <= 64 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    doc = sorted((r for r in got if r.doc_id == 502), key=lambda r: r.start)
    assert [x for r in doc for x in r.ids] == [*tokenizer.encode("long " * 9000, add_special_tokens=False).ids, 0]
    assert {r.doc_tokens for r in doc} == {sum(r.length for r in doc)}
    whole = packing.sequences(packed, 64).collect()
    assert len(whole) == len(by) and all(len(s.ids) == 64 or len(s.ids) & (len(s.ids) - 1) == 0 for s in whole)
    assert packing.pack_documents(documents([]), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(text=_TEXT)
def test_ids_under_the_librarys_default_setting(words, text):
    assert np.frombuffer(words.ids(text), "<u4").tolist() == _DEFAULT.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_documents(spark, documents):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "no <|endoftext| > here", "end<|endoftext|>"]
    got = packing.cut_documents(documents(list(enumerate(texts))), PATH).collect()
    want = {i: [*_DEFAULT.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert {r.doc_id: list(r.ids) for r in got} == want and want[0] == [64, 220, 50256, 275, 0]
    assert all(r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes()) for r in got)
