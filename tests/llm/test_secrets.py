import random
import re

import numpy as np
import pytest

from cohortspark.llm import automaton, secret_scan
from cohortspark.llm.secret_scan import BASE, MORE, Rule, Scanner


def naive(text, rules):
    """Leftmost matches of each rule by the library's regular expressions, too short ones dropped after that."""
    out = []
    for k, rule in enumerate(rules):
        body = rule.body.decode().replace("{24,}", "+")
        out += [(m.start(), k, m.end()) for m in re.finditer(f"({rule.head.decode()})(?:{body})", text, re.ASCII) if len(m.group()) - len(m.group(1)) >= rule.least]
    return sorted(out)


def scanned(texts, rules=BASE + MORE):
    raw = [t.encode() for t in texts]
    cuts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(int)
    return Scanner(rules).scan(np.frombuffer(b"".join(raw), np.uint8), cuts)


BITS = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "AKIAABCD", "0123456789abcdef", "deadbeef", "ABCDEF0123456789", "é", "日", "ghp_", "xoxb-", "AIza", "eyJ", ".", "-", "-----BEGIN RSA PRIVATE KEY-----", "abcdef", "\n", "ſ", "\0", "/", "+", "😀"]


def test_scan():
    r = random.Random(1)
    texts = ["".join(r.choice(BITS) for _ in range(r.choice([0, 1, 5, 30, 300]))) for _ in range(1500)]
    found = scanned(texts)
    assert found == [naive(t, BASE + MORE) for t in texts]
    assert {k for f in found for _, k, _ in f} >= {0, 1, 2, 4, 7}


@pytest.mark.parametrize("lane,warm", [(1, 1), (7, 3), (64, 1)])
def test_lanes_agree(monkeypatch, lane, warm):
    """Wrong guesses of a lane's first state are read again."""
    monkeypatch.setattr(automaton, "LANE", lane)
    monkeypatch.setattr(automaton, "WARM", warm)
    r = random.Random(2)
    texts = ["".join(r.choice(BITS) for _ in range(r.choice([0, 3, 60]))) for _ in range(120)] + ["0123456789abcdef" * 60, "A" * 300 + "AKIA" + "B" * 300]
    assert scanned(texts) == [naive(t, BASE + MORE) for t in texts]


def test_cases():
    assert scanned(["secret=token:abcdefgh"]) == [[]]  # the short first match takes up the second's keyword
    assert scanned(["token==abcde", "token==abcd"]) == [[(0, 0, 12)], []]
    assert scanned(["é password: 'hunter22'"]) == [[(2, 0, 21)]]
    assert scanned(["f" * 23, "f" * 24, "é" + "f" * 5000]) == [[], [(0, 2, 24)], [(1, 2, 5001)]]


def test_compiled_is_minimal():
    assert len(automaton.compiled([b"(a|b)*abb"], False, False).moves) == 4 + 1  # and the state that accepts nothing
    table = automaton.compiled([b"[ab]{2,3}", b"(?i:AB)?x"], False, False)
    for text in ["ab", "aba", "abaa", "x", "abx", "ABx", "aBx", ""]:
        state = 0
        for b in text.encode():
            state = table.moves[state, table.classes[b]]
        want = bool(re.fullmatch("[ab]{2,3}", text)) + 2 * bool(re.fullmatch("((?i:ab))?x", text))
        assert table.accepts[state] == want
    with pytest.raises(ValueError):
        automaton.compiled([rb"\bword"], False, False)


def test_columns(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "token = abcdef and token: 'secret=1234567'", "c"), (2, "😀" * 70000 + " AKIA" + "Z" * 20, "d"), (2, "x" * 300000, "e"), (3, "a" * 40, "f"), (3, "a" * 40, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secret_scan.scan_secrets(df)
    assert got.columns == ["doc_id", "text", "spans", "spans_"]
    found = {(r.doc_id, r.spans): [(s.kind, s.start, s.end) for s in r.spans_] for r in got.collect()}
    assert got.count() == len(rows)
    assert found[(1, "a")] == found[(1, "b")] == found[(2, "e")] == []
    assert found[(None, "c")] == [("assign", 0, 14), ("assign", 19, 41)]
    assert found[(2, "d")] == [("access", 70001, 70025)] and found[(3, "f")] == [("hex", 0, 40)]
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0
    from pyspark.sql import functions as F

    clean = {r.spans: r.t for r in got.select("spans", secret_scan.redacted(F.col("text"), F.col("spans_")).alias("t")).collect()}
    assert clean["c"] == "[SECRET] and [SECRET]'" and clean["a"] is None and clean["b"] == "" and clean["f"] == "[SECRET]"


def test_own_rules():
    rules = (Rule("id", b"", rb"id-[0-9]{4,6}", 4), Rule("year", b"", rb"(?:19|20)[0-9][0-9]", 4))
    assert scanned(["id-1999 id-12345678"], rules) == [[(0, 0, 7), (3, 1, 7), (8, 0, 17)]]
