"""De-identification, sections, draws and as-of joins against plain Python."""

import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import notes, scalars
from cohortspark.operators import anchors as A
from cohortspark.operators import evaluate as E
from cohortspark.operators import splits as P
from cohortspark.operators import windows as W
from cohortspark.sources import io


@pytest.mark.parametrize(
    "text,want",
    [
        ("DR. MARTIN SAID", "<PERSON>DR. LAST_NAME</PERSON> SAID"),
        ("DR. SIMON READ IT", "<PERSON>DR. LAST_NAME</PERSON> READ IT"),
        ("DR. JONES (PAGER 1)", "<PERSON>DR. LAST_NAME</PERSON> (<PAGER>PAGER X</PAGER>)"),
        ("BY DR. JOHN DOE AND", "BY <PERSON>DR. FIRST_NAME LAST_NAME</PERSON> AND"),
        ("DR. ANTON INGRAM, MD", "<PERSON>DR. FIRST_NAME LAST_NAME</PERSON>, MD"),
        ("DR. O'NEIL-BY WAS", "<PERSON>DR. LAST_NAME</PERSON> WAS"),
        ("A DR. WAS", "A DR. WAS"),
    ],
)
def test_names_are_replaced_whole(text, want):
    assert notes.Tagger().replaced(text) == want


def test_sections(spark):
    rows = [(0, "a\x01b findings impression: x"), (1, "FINDINGS: y IMPRESSION: z SUMMARY CODE 3"), (2, "findings; only"), (3, None), (4, ""), (5, "conclusion: c impression; i"), (6, "impression: \n\t")]
    df = spark.createDataFrame(rows, "i int, note string")
    got = {r.i: (r.s, r.l) for r in df.select("i", notes.section(F.col("note")).alias("s"), notes.section(F.col("note"), strict=False).alias("l")).collect()}
    assert got[0][0] == "impression: x" and got[1][0] == "IMPRESSION: z " and got[2] == (None, "findings; only") and got[3][0] is None
    assert got[4] == (None, "") and got[5][0] == "impression; i"
    assert {r.i for r in notes.with_section(df, "note").collect()} == {0, 1, 5, 6}
    assert {r.i for r in notes.with_section(df.withColumn("note", F.regexp_replace("note", "impression: \\s*$", "")), "note").collect()} == {0, 1, 5}


def drawn(seed, key):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:12], 16)


def test_splits_rank_hashes(spark):
    keys = [k for k in range(203)]
    df = spark.createDataFrame([(k, j, "train" if k % 3 else "test") for k in keys for j in range(1 + k % 3)] + [(None, 0, "train")], "k long, j int, split string")
    order = sorted(keys, key=lambda k: (drawn(7, k), k))
    place = {k: i + 1 for i, k in enumerate(order)}
    assert {r.k for r in P.sample_keys(df, "k", 0.25, 7).collect()} == set(order[: int(203 * 0.25)])
    tests = {}
    for r in P.patient_folds(df, "k", 5, 7).where("role = 'test'").collect():
        tests.setdefault(r.fold, set()).add(r.k)
    assert tests == {f: {k for k in keys if place[k] % 5 == f} for f in range(5)}
    split = {r.k: r.split for r in P.random_split(df, "k", 7).collect()}
    assert split.pop(None) is None and split == {k: "train" if place[k] * 100 <= 203 * 60 else "valid" if place[k] * 100 <= 203 * 80 else "test" for k in keys}
    train = sorted((k for k in keys if k % 3), key=lambda k: (drawn(7, k), k))
    assert {r.k for r in P.holdout(df, "k", 10, 7).where("split = 'valid'").collect()} == {k for i, k in enumerate(train) if (i + 1) * 100 <= len(train) * 10}


def test_nearest_and_horizon_against_all_pairs(spark):
    r = random.Random(0)
    t = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(300))
    left = [(r.choice([1, 2, 3, None]), i, t()) for i in range(60)]
    right = [(r.choice([1, 2, 4, None]), 100 + i, t()) for i in range(60)] + [(1, 500, None)]
    a, b = spark.createDataFrame(left, "p long, l long, left_time timestamp"), spark.createDataFrame(right, "p long, r long, right_time timestamp")
    got = {x.l: (x.right_time, x.r) for x in W.asof_nearest(a, b, "p", "l", "r", 1.0).collect()}
    for p, i, at in left:
        near = [(abs(s - at), s, j) for q, j, s in right if p is not None and q == p and s is not None and abs(s - at) <= dt.timedelta(days=1)]
        assert got[i] == (min(near)[1:] if near else (None, None))
    anchors = spark.createDataFrame([(i, p, at) for p, i, at in left], "study_id long, person_id long, anchor_time timestamp")
    outcomes = spark.createDataFrame([(p, s) for p, _, s in right], "person_id long, event_time timestamp")
    seen = spark.createDataFrame([(1, dt.datetime(2024, 1, 9)), (2, dt.datetime(2025, 1, 1))], "person_id long, last_seen timestamp")
    got = {x.study_id: x.label for x in A.horizon_labels(anchors, outcomes, seen, 2, offset_days=1).collect()}
    for p, i, at in left:
        at, until = at - dt.timedelta(days=1), at + dt.timedelta(days=1)
        hit = any(p is not None and q == p and s is not None and at < s <= until for q, _, s in right)
        last = {1: dt.datetime(2024, 1, 9), 2: dt.datetime(2025, 1, 1)}.get(p)
        assert got[i] == (True if hit else None if last is None or last < until else False)


def test_window_join_with_and_without_buckets(spark):
    r = random.Random(1)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=r.randrange(120), hours=r.randrange(24))
    events = spark.createDataFrame([(r.randrange(4), i, day()) for i in range(200)], "person_id long, event_id long, event_time timestamp")
    anchors = spark.createDataFrame([(i, r.randrange(4), day(), r.randrange(40)) for i in range(40)], "study_id long, person_id long, anchor_time timestamp, cap int")
    for cap in (None, "cap"):
        found = [sorted((x.study_id, x.event_id, x.days_before) for x in W.window_join(events, anchors, 35, cap, buckets).collect()) for buckets in (0, None, 7, 200)]
        assert found[0] and all(f == found[0] for f in found)


def test_rows_are_numbered_in_order(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "k long").repartition(7)
    assert [r.k for r in sorted(io.numbered(df, [F.desc("k")], "n").collect(), key=lambda r: r.n)] == list(range(999, -1, -1))
    assert io.numbered(df.where("false"), [F.col("k")], "n").count() == 0


def test_missing_inputs(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None), (3, 1.0, 2.0)], "study_id long, hr double, bp double")
    assert {r.input: r.missing for r in scalars.missing_inputs(df).collect()} == {"hr": 2, "bp": 1}


def test_fusion_over_subsets_and_paired_delta(spark):
    r = random.Random(2)
    rows = [(m, t, i, y, min(0.99, max(0.01, 0.3 * y + r.random() * 0.6))) for t in ("a", "b") for i in range(80) for y in [i % 2] for m in "XYZ"]
    df = spark.createDataFrame(rows, "model string, task string, patient_id long, label int, prob double")
    out = E.fuse_subsets(df.where("patient_id < 40"), df.where("patient_id >= 40"), ["X", "Y", "Z"])
    got = {(x.model, x.task): x["count"] for x in out.groupBy("model", "task").count().collect()}
    assert got == {(m, t): 40 for m in ("X+Y", "X+Z", "Y+Z", "X+Y+Z") for t in "ab"}
    wide = spark.createDataFrame([("a", 0.5, 0.4), ("b", 0.7, 0.4), ("c", None, 0.1)], "task string, A double, B double")
    x = E.paired_delta(wide, "A", "B").first()
    assert x.n == 2 and abs(x["mean"] - 0.2) < 1e-9 and abs(x.high - (0.2 + 12.7062 * 0.1414214 / 2**0.5)) < 1e-3
    assert E.paired_delta(wide.where("task = 'a'"), "A", "B").first().low is None


def test_names_of_every_form():
    """Whole words, inner capitals, initials, particles and up to four words are replaced."""
    cases = {
        "Seen by Dr. McDonald today": "Seen by <PERSON>DR. LAST_NAME</PERSON> today",
        "by Dr. Mary Smith on call": "by <PERSON>DR. FIRST_NAME LAST_NAME</PERSON> on call",
        "PER DR. MARY ANN SMITH, MD": "PER <PERSON>DR. FIRST_NAME LAST_NAME</PERSON>, MD",
        "WITH DR. DE LA CRUZ": "WITH <PERSON>DR. FIRST_NAME LAST_NAME</PERSON>",
        "TO DR. A. B. JONES AT NOON": "TO <PERSON>DR. FIRST_NAME LAST_NAME</PERSON> AT NOON",
        "Dr. J. van der Berg-O'Neil wrote": "<PERSON>DR. FIRST_NAME LAST_NAME</PERSON> wrote",
        "DR. SMITH AND DR. LEE.": "<PERSON>DR. LAST_NAME</PERSON> AND <PERSON>DR. LAST_NAME</PERSON>.",
        "Drain in place. drs. of": "Drain in place. drs. of",
    }
    for text, want in cases.items():
        assert notes.Tagger().replaced(text) == want
        for word in ("McDonald", "Mary", "MARY", "ANN", "SMITH", "CRUZ", "JONES", "LEE", "Berg", "Neil"):
            assert word not in notes.Tagger().replaced(text)


def brute_names(text, names):
    """Every place where a name stands as whole words, by trying all."""
    low, out = notes.lowered(text), set()
    for name in names:
        n, at = notes.lowered(name.strip()), -1
        while n and (at := low.find(n, at + 1)) >= 0:
            word = lambda i: 0 <= i < len(text) and bool(re.match(r"\w", text[i]))
            if not (word(at - 1) and word(at)) and not (word(at + len(n)) and word(at + len(n) - 1)):
                out.add((at, at + len(n)))
    return sorted(out)


def test_name_dictionary(spark):
    r = random.Random(6)
    syllables = ["an", "na", "lee", "O'", "-", " ", "é", "İ", "ß", "1", "_"]
    names = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(200)] + [None, "", " "]
    texts = ["".join(r.choice(syllables + [" ", ". "]) for _ in range(r.randint(0, 60))) for _ in range(60)] + [None, ""]
    table = spark.createDataFrame([(n,) for n in names * 2], "name string")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, note string")
    known = [n for n in names if n]
    for most in (1_000_000, 40):
        parts = notes.dictionary(table, most=most)
        assert (len(parts) == 1) == (most > 1000)
        got = {x.i: x.s for x in df.select("i", notes.name_spans("note", parts).alias("s")).collect()}
        for i, t in enumerate(texts):
            want = None if t is None else brute_names(t, known)
            assert (None if got[i] is None else sorted({(s.start, s.end) for s in got[i]})) == want
    clean = {x.i: x.t for x in df.select("i", notes.anonymized("note", parts).alias("t")).collect()}
    assert clean[60] is None and clean[61] == ""
    assert notes.dictionary(table.limit(0))[0].value == []


def test_time_does_not_grow_with_names():
    import time

    text = "the quick brown fox saw ann lee. " * 70
    took = []
    for n in (200, 200_000):
        names = notes.Names(["ann lee", *(f"name{i} surname" for i in range(n))])
        began = time.perf_counter()
        for _ in range(20):
            assert len(names.found(text)) == 70
        took.append(time.perf_counter() - began)
    assert took[1] < 5 * took[0] + 0.05


def test_section_ends_after_its_start(spark):
    rows = [(0, "of a friend IMPRESSION: clot SUMMARY CODE 3"), (1, "summary. FINDINGS: y impression: z end of impression: w"), (2, "the end impression. FINDINGS: y")]
    df = spark.createDataFrame(rows, "i int, note string")
    got = {r.i: (r.s, r.l) for r in df.select("i", notes.section(F.col("note")).alias("s"), notes.section(F.col("note"), strict=False).alias("l")).collect()}
    assert got == {0: ("IMPRESSION: clot ",) * 2, 1: ("impression: z ",) * 2, 2: (None, "FINDINGS: y")}
    assert {r.i: r.section for r in notes.with_section(df, "note").collect()} == {0: "IMPRESSION: clot ", 1: "impression: z "}
