"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is `open role sep text close`. Control strings inside roles and texts are escaped, so that a reader finds the
    turns again and a tokenizer never sees a marker that a text brought along."""

    open: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    #: Markers of other public templates, escaped as well.
    foreign: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.sep, self.close, *self.foreign)

    def escape(self, c: Column) -> Column:
        """Doubles each backslash and puts one after the first character of each control string."""
        tails = "|".join(re.escape(x[1:]) for x in self.controls)
        heads = "".join(sorted({re.escape(x[0]) for x in self.controls}))
        return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), rf"([{heads}])(?={tails})", r"$1\\")

    def unescape(self, c: Column) -> Column:
        return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def expand_prefix_targets(conversations: DataFrame, template: ChatTemplate = ChatTemplate(), trained_role: str = "assistant") -> DataFrame:
    """One example for every turn of the trained role, holding all turns before it and then the turn itself.

    Takes conv_id, turn, role, text (others are ignored). Returns conv_id, target (place of the last turn, from 0), is_last (no turn follows), text,
    loss_start and loss_length (code points of `text`; the reply's own escaped text, without its end marker).
    Turns that no reply follows would be in no example: a last example without loss (loss_length null) holds them.

    The length of a conversation's examples together grows with the square of its turns; that is what this expansion is.
    Rows of a conversation are sorted by turn (null first), role and text. Null roles and texts are empty strings; rows
    with a null conv_id are one conversation; repeated rows are turns of their own; an empty table gives none.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(template.open), template.escape(F.col("role")), F.lit(template.sep))
    body = template.escape(F.col("text"))
    turns = turns.select("conv_id", F.struct("turn", "role", "text", head.alias("head"), body.alias("body")).alias("t"))
    # role and text are only for the order; what follows keeps the rendered parts
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    whole = whole.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(t.head, t.body, F.lit(template.close))).alias("shown"),
        F.transform("ts", lambda t: t.role == F.lit(trained_role)).alias("trained"),
        F.transform("ts", lambda t: F.char_length(t.head)).alias("heads"),
        F.transform("ts", lambda t: F.char_length(t.body)).alias("bodies"),
    )
    places = F.filter(F.sequence(F.lit(0), F.size("shown") - 1), lambda i: F.element_at("trained", i + 1) | (i == F.size("shown") - 1))
    each = whole.withColumn("target", F.explode(places))
    before = F.concat_ws("", F.slice("shown", 1, F.col("target")))
    each = each.select("conv_id", "target", (F.col("target") == F.size("shown") - 1).alias("is_last"), before.alias("before"), *(F.element_at(c, F.col("target") + 1).alias(c) for c in ("shown", "trained", "heads", "bodies")))
    return each.select(
        "conv_id",
        "target",
        "is_last",
        F.concat("before", "shown").alias("text"),
        F.when(F.col("trained"), F.char_length("before") + F.col("heads")).alias("loss_start"),
        F.when(F.col("trained"), F.col("bodies")).alias("loss_length"),
    )


def parse_turns(text: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns (role, text) of a formatted text, unescaped."""
    parts = F.filter(F.split(text, re.escape(template.close)), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            template.unescape(F.substring_index(F.substring(p, len(template.open) + 1, 1 << 30), template.sep, 1)).alias("role"),
            template.unescape(F.substring_index(p, template.sep, -1)).alias("text"),
        ),
    )


def loss_text(template: ChatTemplate = ChatTemplate()) -> Column:
    """What the loss mask of an example covers, unescaped; null where it covers nothing."""
    return template.unescape(F.expr("substring(text, loss_start + 1, loss_length)"))


def read_back(examples: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """A row for each conversation, taken from its examples alone: turns and loss text as they were before formatting."""
    seen = examples.select("conv_id", "target", F.char_length("text").alias("chars"), loss_text(template).alias("loss"), F.when(F.col("is_last"), parse_turns(F.col("text"), template)).alias("turns"))
    losses = F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("target", "loss"))))
    whole = seen.groupBy("conv_id").agg(F.max_by("turns", "target").alias("turns"), losses.alias("losses"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", "turns", F.concat_ws("", F.transform("losses", lambda x: x.loss)).alias("loss"), "formatted_chars")
