"""Chat formatting of reply trees.

Messages name the message they reply to, so those of one tree have many paths from its root
to a leaf, and each path is a conversation. Paths are enumerated by self-joins that double
their reach: the table of n-th ancestors joined to itself gives that of 2n-th ones, so a path
of d messages takes about log2(d) joins and no more rows than it has messages. Branches are
ranked by the mean score of their messages, and each chosen one is formatted as a single
text. Control strings that stand inside a text are escaped, and the loss mask gives the bytes
that the assistant said.

Everything is DataFrame functions; only ids travel until the paths are known.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.llm.tables import checkpointed


@dataclass(frozen=True)
class Template:
    """How turns are marked: `begin` role `middle` text `end`.

    These three and `others` are control strings: where one stands in a role or text, a
    backslash is put behind its first character, and one more where there are some already,
    which reading back takes away again. Behind its first character no control string may
    hold one that another begins with, so that escaping one never hides another.
    """

    begin: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    learned: str = "assistant"

    def __post_init__(self):
        firsts = {c[:1] for c in self.controls}
        if firsts & {"", "\\"} or any(set(c[1:]) & firsts or c[1:2] in ("", "\\") for c in self.controls):
            raise ValueError("control strings need two characters, and no other one's first character inside")

    @property
    def controls(self) -> tuple[str, ...]:
        return self.begin, self.middle, self.end, *self.others

    def _places(self, marked: str) -> str:
        """Matches a first character, what `marked` names and backslashes, if the rest of a control string follows."""
        firsts = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        return rf"([{firsts}]){marked}(\\*)(?={'|'.join(re.escape(c[1:]) for c in self.controls)})"

    def escape(self, text: Column) -> Column:
        """The text without control strings; `unescape` gives it back."""
        return F.regexp_replace(text, self._places(""), r"$1\\$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._places(r"\\"), "$1$2")

    def head(self, role: Column) -> Column:
        """What stands before a turn's text."""
        return F.concat(F.lit(self.begin), self.escape(role), F.lit(self.middle))


def _same(a: str, b: str, *keys: tuple[str, str]) -> Column:
    """Join condition: one tree, null being a tree as well, and equal columns besides."""
    parts = [F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")), *(F.col(f"{a}.{x}") == F.col(f"{b}.{y}") for x, y in keys)]
    return reduce(Column.__and__, parts)


def reply_paths(messages: DataFrame) -> DataFrame:
    """Every path from a root to a leaf, from rows `tree`, `id`, `parent`, `score` with one row for each id.

    Returns `tree`, `leaf`, `id`, `up` (steps from the leaf to this message) and `score`. A
    message without a parent in its tree is a root. Messages that reply to each other in a
    circle have no root; they and those below them are in no path.
    """
    known = checkpointed(messages.select("tree", "id", "parent", F.col("score").cast("decimal(18,6)").alias("score")))
    bound = known.count()
    link = known.alias("a").join(known.alias("b"), _same("a", "b", ("parent", "id")))
    jump = checkpointed(link.select("a.tree", "a.id", F.col("b.id").alias("to"), F.col("b.score").alias("score")))
    jumps, reach = [], 1
    while not jump.isEmpty() and reach <= bound:
        jumps.append(jump)
        twice = jump.alias("a").join(jump.alias("b"), _same("a", "b", ("to", "id")))
        jump, reach = checkpointed(twice.select("a.tree", "a.id", "b.to", "b.score")), 2 * reach
    leaves = known
    if jumps:
        leaves = leaves.alias("a").join(jumps[0].alias("b"), _same("a", "b", ("id", "to")), "left_anti")
    if reach > bound:  # ancestors beyond the number of messages: a circle
        leaves = leaves.alias("a").join(jump.alias("b"), _same("a", "b", ("id", "id")), "left_anti")
    paths = checkpointed(leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).alias("up"), "score"))
    for step, jump in enumerate(jumps):
        further = paths.alias("a").join(jump.alias("b"), _same("a", "b", ("id", "id")))
        moved = further.select("a.tree", "a.leaf", F.col("b.to").alias("id"), (F.col("a.up") + 2**step).alias("up"), "b.score")
        paths = paths.unionByName(checkpointed(moved))
    return paths


def rank_branches(paths: DataFrame, per_tree: int) -> DataFrame:
    """The `per_tree` best paths of each tree: `tree`, `leaf`, `branch_score`, `branch_rank`.

    A path's score is the mean of its messages' scores, of which those without one don't
    count; paths without any come last, and equal ones go by the leaf's id. The best are
    found among shares of a tree's paths first, so no tree is sorted by one task.
    """
    mean = F.round(F.sum("score") / F.count("score"), 6)
    scored = paths.groupBy("tree", "leaf").agg(mean.alias("branch_score"))
    order = [F.desc_nulls_last("branch_score"), F.col("leaf")]
    share = F.pmod(F.xxhash64("leaf"), F.lit(64))
    few = scored.withColumn("nth", F.row_number().over(Window.partitionBy("tree", share).orderBy(*order))).where(F.col("nth") <= per_tree)
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(*order))
    return few.withColumn("branch_rank", rank).where(F.col("branch_rank") <= per_tree).drop("nth")


def format_trees(
    messages: DataFrame,
    per_tree: int = 1,
    template: Template = Template(),
    tree_col: str = "tree",
    id_col: str = "id",
    parent_col: str = "parent",
    role_col: str = "role",
    text_col: str = "text",
    score_col: str | None = "score",
) -> DataFrame:
    """Format the `per_tree` best branches of each tree of messages as conversations.

    Returns `tree_col`, `leaf`, `branch_rank`, `branch_score`, `formatted` (the text) and
    `loss_mask`: for each turn of the learned role the bytes of `formatted`, in UTF-8, from
    `start` to `end` that hold its escaped text, in order.

    A null role or text is an empty one, a null score none. A null tree is a tree like any
    other. Messages with a null id have neither place nor path and are left out; of several with
    one id the one with the least role and text stays. A parent that isn't in the tree makes a
    root; see `reply_paths` for circles. A conversation is one row, so one path has to
    fit in memory; a tree doesn't. Further columns are ignored; an empty table gives an empty result.
    """
    score = F.col(score_col) if score_col else F.lit(None).cast("double")
    given = messages.where(F.col(id_col).isNotNull()).select(
        F.col(tree_col).alias("tree"),
        F.col(id_col).alias("id"),
        F.col(parent_col).alias("parent"),
        score.alias("score"),
        *(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((role_col, "role"), (text_col, "text"))),
    )
    content = F.min(F.struct("role", "text", "parent", "score"))
    whole = given.groupBy("tree", "id").agg(content.alias("m")).select("tree", "id", "m.*")
    return format_paths(whole, per_tree, template).withColumnRenamed("tree", tree_col)


def format_paths(whole: DataFrame, per_tree: int, template: Template) -> DataFrame:
    """`format_trees` for rows `tree`, `id`, `parent`, `score`, `role`, `text` without nulls in role, text and id and without repeated ids."""
    paths = reply_paths(whole)
    chosen = rank_branches(paths, per_tree)
    places = paths.alias("p").join(chosen.alias("c"), _same("p", "c", ("leaf", "leaf")))
    places = places.select("p.tree", "p.leaf", "p.id", "p.up", "c.branch_rank", "c.branch_score")
    turns = places.alias("p").join(whole.alias("m"), _same("p", "m", ("id", "id")))
    head, text = template.head(F.col("m.role")), template.escape(F.col("m.text"))
    turns = turns.select("p.*", (F.col("m.role") == template.learned).alias("learned"), head.alias("head"), text.alias("text"))
    size = F.octet_length("head") + F.octet_length("text") + len(template.end.encode())
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)) + F.octet_length("head")
    turn = F.struct((-F.col("up")).alias("nth"), F.concat("head", "text", F.lit(template.end)).alias("piece"), "learned", "start", "end")
    rows = turns.withColumn("start", start).withColumn("end", F.col("start") + F.octet_length("text"))
    sorted_turns = F.array_sort(F.collect_list(turn))
    one = rows.groupBy("tree", "leaf", "branch_rank", "branch_score").agg(sorted_turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t.learned), lambda t: F.struct(t.start.alias("start"), t.end.alias("end")))
    return one.select(
        "tree",
        "leaf",
        "branch_rank",
        "branch_score",
        F.array_join(F.transform("turns", lambda t: t.piece), "").alias("formatted"),
        spans.alias("loss_mask"),
    )


def as_replies(rows: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each turn replies to the one before it.

    Turns are numbered from 1 by turn, a null one first and equal ones by a hash of role and
    text. Returns what `format_paths` takes; a null role or text is an empty one.
    """
    filled = rows.select(
        F.col(tree_col).alias("tree"),
        F.col(turn_col).alias("turn"),
        *(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((role_col, "role"), (text_col, "text"))),
    )
    nth = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "tie")).cast("long")
    numbered = filled.withColumn("tie", F.xxhash64("role", "text")).withColumn("id", nth)
    parent = F.when(F.col("id") > 1, F.col("id") - 1)
    return numbered.select("tree", "id", parent.alias("parent"), F.lit(None).cast("double").alias("score"), "role", "text")


def turns_of(formatted: Column, template: Template = Template()) -> Column:
    """Read a formatted conversation back: an array of `role` and `text`."""

    def turn(piece: Column) -> Column:
        inside = F.substring(piece, F.lit(len(template.begin) + 1), F.length(piece))
        role = F.substring_index(inside, template.middle, 1)
        text = F.substring(inside, F.length(role) + len(template.middle) + 1, F.length(inside))
        return F.struct(template.unescape(role).alias("role"), template.unescape(text).alias("text"))

    pieces = F.split(formatted, re.escape(template.end))
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def learned_texts(formatted: Column, mask: Column, template: Template = Template()) -> Column:
    """The texts under the loss mask, unescaped.

    The bytes are cut into as many parts as each part has spans, so that the work grows by
    the power 1.5 of the number of turns and not by their square.
    """
    width = F.ceil(F.sqrt(F.size(mask))).cast("int")
    numbers = F.when(F.size(mask) > 0, F.sequence(F.lit(0), F.ceil(F.size(mask) / width).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def part(number: Column) -> Column:
        spans = F.slice(mask, number * width + 1, width)
        first, last = F.element_at(spans, 1).start, F.element_at(spans, -1).end
        held = F.substring(formatted.cast("binary"), (first + 1).cast("int"), (last - first).cast("int"))
        return F.struct(held.alias("held"), spans.alias("spans"), first.alias("first"))

    def texts(p: Column) -> Column:
        cut = lambda s: F.substring(p.held, (s.start - p.first + 1).cast("int"), (s.end - s.start).cast("int"))
        return F.transform(p.spans, lambda s: template.unescape(cut(s).cast("string")))

    return F.flatten(F.transform(F.transform(numbers, part), texts))
