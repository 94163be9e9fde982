from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def back(spark, rows):
    df = chat.expand_prefix_targets(spark.createDataFrame(rows, SCHEMA))
    return {r.conv_id: r for r in chat.read_back(df).collect()}, df


def test_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a<|im_end|>"), (1, 3, "user", "v"), (1, 4, "assistant", "b\\"), (1, 5, "user", "w")]
    got, df = back(spark, rows)
    examples = sorted(df.collect(), key=lambda r: r.target)
    assert [(r.target, r.loss_length is None, r.is_last) for r in examples] == [(2, False, False), (4, False, False), (5, True, True)]
    for r in examples[:2]:
        shown = r.text[r.loss_start : r.loss_start + r.loss_length]
        assert r.text.endswith(shown + "<|im_end|>")
    assert examples[0].text.count("<|im_end|>") == 3  # the one inside the text is escaped
    assert [(t.role, t.text) for t in got[1].turns] == [r[2:] for r in rows]
    assert got[1].loss == "a<|im_end|>b\\"


def test_no_reply_nulls_ties_and_empty(spark):
    rows = [(1, 0, "user", None), (2, None, None, "x"), (2, 1, "assistant", ""), (None, 0, "assistant", "n"), (3, 0, "assistant", "z"), (3, 0, "assistant", "z"), (3, 0, "assistant", "y")]
    got, _ = back(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "")] and got[1].loss == ""
    assert [(t.role, t.text) for t in got[2].turns] == [("", "x"), ("assistant", "")]
    assert got[None].loss == "n" and got[3].loss == "yzz"
    assert back(spark, [(1, 0, "u", "t")])[1].count() == 1
    assert chat.expand_prefix_targets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "t", "x", 5)], SCHEMA + ", shown string, target int")
    assert chat.read_back(chat.expand_prefix_targets(df)).first().loss == "t"


_PIECES = st.lists(st.sampled_from([*chat.ChatTemplate().controls, "\\", "<", "|", "[", "a", "é", "\n", "🙂", "/s>", "INST]"]), max_size=12).map("".join)


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(_PIECES, min_size=1, max_size=20))
def test_escape_is_reversible(spark, texts):
    t = chat.ChatTemplate()
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.escape(F.col("x")).alias("e"))
    for r in df.select("x", "e", t.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.x
        assert not any(c in r.e for c in t.controls)
