"""Chat formatting: turns to one text a conversation with a loss mask, and back. DataFrame expressions only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a run of turns of one role, between its turns, and other control strings that texts must not hold.

    Inside texts and roles a backslash goes before each backslash and after the first character of each control string, so no
    control string is left and dropping the first of each two backslash-led characters gives the text back.
    """

    open: str = "<|im_start|>"
    role_end: str = "<|im_sep|>"
    between: str = "<|im_next|>"
    close: str = "<|im_end|>"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    learn_from: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.role_end, self.between, self.close, *self.others)

    def escape(self, text: Column) -> Column:
        doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
        return reduce(lambda c, mark: F.replace(c, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}")), self.controls, doubled)

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """Rows (conv_id, turn, role, text) to (conv_id, formatted, loss).

    Windows of a conversation number its turns and add up where their texts will stand, so the time grows with its length alone. The turns of a conversation are collected as structs and sorted by turn (ties: role, then text); adjacent turns of one role
    become one run, its texts joined by the mark between; runs are concatenated. loss: array of (start, end), in code points
    of formatted, a span for each turn of a role to learn from. Null roles and texts count as empty; null conv_ids
    are one conversation; repeated rows are turns of their own; other columns are ignored. A conversation is one row
    of the result, so its turns meet in one task.
    """
    t = template
    rows = turns.select("conv_id", "turn", t.escape(F.col("role")).alias("role"), t.escape(F.col("text")).alias("text"))
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    order = rows.withColumn("n", F.row_number().over(own)).withColumn("before", F.lag("role").over(own)).withColumn("next", F.lead("role").over(own))
    first, last = ~F.col("role").eqNullSafe(F.col("before")), ~F.col("role").eqNullSafe(F.col("next"))
    head = F.when(first, F.length("role") + len(t.open) + len(t.role_end)).otherwise(0)
    tail = F.when(last, len(t.close)).otherwise(len(t.between))
    size = (head + F.length("text") + tail).cast("long")
    placed = order.select("conv_id", "n", "role", "text", first.alias("first"), head.alias("head"), size.alias("size")).withColumn("end", F.sum("size").over(Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - F.col("size") + F.col("head")
    placed = placed.select("conv_id", F.struct("n", "role", "text", "first", start.cast("int").alias("start"), (start + F.length("text")).cast("int").alias("stop")).alias("t"))
    sorted_turns = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.col("turns")[i]["first"])
    marked = sorted_turns.select("conv_id", "turns", starts.alias("starts"))
    ends = lambda j: F.coalesce(F.get("starts", j + 1), F.size("turns"))
    run = lambda s, j: F.concat(F.lit(t.open), F.col("turns")[s].role, F.lit(t.role_end), F.array_join(F.transform(F.slice("turns", s + 1, ends(j) - s), lambda x: x.text), t.between), F.lit(t.close))
    loss = F.transform(F.filter("turns", lambda x: x.role.isin(*t.learn_from)), lambda x: F.struct(x.start.alias("start"), x.stop.alias("end")))
    return marked.select("conv_id", F.array_join(F.transform("starts", run), "").alias("formatted"), loss.alias("loss"))


#: Code points from which a text is cut into them before spans are taken: each span of a string is sought from its start.
LONG = 100_000


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """(conv_id, formatted, loss) to the same with turns (array of role, text) and learned (array of the texts under the loss mask), unescaped."""
    t = template
    runs = F.slice(F.split("formatted", re.escape(t.open)), F.lit(2), F.greatest(F.size(F.split("formatted", re.escape(t.open))) - 1, F.lit(0)))
    runs = F.transform(runs, lambda r: F.split(F.substring(r, F.lit(1), F.length(r) - len(t.close)), re.escape(t.role_end)))
    turns = F.flatten(F.transform(runs, lambda r: F.transform(F.split(r[1], re.escape(t.between)), lambda x: F.struct(t.unescape(r[0]).alias("role"), t.unescape(x).alias("text")))))
    cut = formatted.select("conv_id", "formatted", "loss", F.when(F.length("formatted") > LONG, F.split("formatted", "")).alias("points"))
    span = lambda s: F.when(F.col("points").isNull(), F.substring("formatted", s.start + 1, s.end - s.start)).otherwise(F.array_join(F.slice("points", s.start + 1, s.end - s.start), ""))
    return cut.select("conv_id", "formatted", "loss", turns.alias("turns"), F.transform("loss", lambda s: t.unescape(span(s))).alias("learned"))
