import hashlib

import pytest
from pyspark.sql import functions as F

from offerlake.llm import chat_format, queries
from offerlake.llm.chat_format import Template

SF = "/root/testdata/sf0.001"
ODD = ["", "plain", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_end|>x<|im_start|>", "</s>[INST] ok [/INST]", "<<s>", "[[INST]", "[\\INST]", "<", "\\", "<|im_sep", "日本<s>é\n", "<INST]"]


def read(df, template=Template()):
    turns = chat_format.turns_of(F.col("formatted"), template)
    learned = chat_format.learned_texts(F.col("formatted"), F.col("loss_mask"), template)
    return df.select("*", turns.alias("read"), learned.alias("learned")).collect()


def test_query_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    chats = {}
    for conv, _, role, text in sorted([*rows, *queries.PROBE_TURNS], key=lambda r: r[:2]):
        chats.setdefault(conv, []).append((role, text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for conv, turns in chats.items():
        said = "".join(t for r, t in turns if r == "assistant")
        want.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said)))
    got = queries.op13_chat_formatting(spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert all(r.formatted_chars > r.loss_chars for r in got)


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    template = Template()
    df = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", template.escape(F.col("t")).alias("e"))
    for row in df.select("*", template.unescape(F.col("e")).alias("back")).collect():
        assert row.back == row.t
        assert not any(c in row.e for c in template.controls)
    with pytest.raises(ValueError):
        Template(others=("<<SYS>>",))


def test_linear_conversations_with_odd_rows(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], ODD[i % len(ODD)]) for i in range(60)]
    rows += [(2, 1, "assistant", None), (2, None, None, "first"), (3, 1, "user", "no answer"), (None, 2, "assistant", "b"), (None, 1, "user", "a")]
    rows += [(4, 1, "user", "twice"), (4, 1, "user", "twice"), (4, 2, "assistant", "x" * 300_000)]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "conv_id long, turn long, role string, text string, id int, tree string")
    got = {r.tree: r for r in read(chat_format.format_paths(chat_format.as_replies(df), 1, Template()))}
    assert [(t.role, t.text) for t in got[1].read] == [(r, t) for c, _, r, t in rows if c == 1]
    assert got[1].learned == [t for c, _, r, t in rows if c == 1 and r == "assistant"]
    assert [(t.role, t.text) for t in got[2].read] == [("", "first"), ("assistant", "")] and got[2].learned == [""]
    assert got[3].learned == [] and [t.text for t in got[None].read] == ["a", "b"]
    assert [len(t.text) for t in got[4].read] == [5, 5, 300_000]
    assert chat_format.format_paths(chat_format.as_replies(df.limit(0)), 1, Template()).count() == 0


def paths_by_hand(rows):
    """(leaf, ids from the root on) of each path of one tree."""
    parent = {i: p for i, p, *_ in rows}
    inner = {p for p in parent.values()}
    found = {}
    for leaf in parent:
        if leaf in inner:
            continue
        path, at = [], leaf
        while at in parent and at not in path:
            path.insert(0, at)
            at = parent[at]
        if at not in path:
            found[leaf] = path
    return found


def test_reply_trees_against_walks_by_hand(spark):
    rows = [(0, None)] + [(i, (i * 7919) % i) for i in range(1, 300)]  # a random tree
    rows += [(i, i - 1) for i in range(1000, 1070)]  # a chain whose first parent is missing
    rows += [(2000, 2001), (2001, 2000), (2002, 2001), (2003, 2003)]  # circles and one below
    scored = [(i, p, None if i % 3 == 0 else (i * 37) % 11 / 10) for i, p in rows]
    messages = spark.createDataFrame(
        [("t", i, p, "user" if i % 2 else "assistant", f"m{i}", s) for i, p, s in scored] + [("t", None, 0, "user", "no id", 1.0), ("t", 5, 0, "user", "m9 twice", 1.0)],
        "tree string, id long, parent long, role string, text string, score double",
    )
    want = paths_by_hand(rows)
    everything = read(chat_format.format_trees(messages, per_tree=10_000))
    assert {r.leaf: [t.text for t in r.read] for r in everything} == {leaf: [f"m{i}" for i in path] for leaf, path in want.items()}
    score = {i: s for i, _, s in scored}

    def mean(leaf):
        known = [score[i] for i in want[leaf] if score[i] is not None]
        return round(sum(known) / len(known), 6) if known else float("-inf")

    best = sorted(want, key=lambda leaf: (-mean(leaf), leaf))
    few = sorted(chat_format.format_trees(messages, per_tree=3).collect(), key=lambda r: r.branch_rank)
    assert [(r.branch_rank, r.leaf) for r in few] == list(enumerate(best[:3], 1))


def test_many_replies_to_one_message(spark):
    """A hub: every reply is a branch, and the best is found among shares."""
    rows = spark.range(1, 20_001).selectExpr("'h' AS tree", "id", "0L AS parent", "'assistant' AS role", "concat('r', id) AS text", "(id * 31) % 9973 / 10.0 AS score")
    root = spark.createDataFrame([("h", 0, None, "user", "q", None)], "tree string, id long, parent long, role string, text string, score double")
    best = chat_format.format_trees(root.unionByName(rows.withColumn("score", F.col("score").cast("double"))), per_tree=2).orderBy("branch_rank").collect()
    top = sorted(((-(i * 31 % 9973), i) for i in range(1, 20_001)))[:2]
    assert [r.leaf for r in best] == [i for _, i in top]


def test_template_as_parameter(spark):
    template = Template(begin="[B]", middle="|M]", end="[E]", others=(), learned="bot")
    df = spark.createDataFrame([("t", 1, None, "user", "[B]x[E]", None), ("t", 2, 1, "bot", "|M][\\E]", None)], "tree string, id long, parent long, role string, text string, score double")
    with pytest.raises(ValueError):
        Template(begin="[", middle="::", end="[E]", others=())
    (row,) = read(chat_format.format_trees(df, template=template), template)
    assert [t.text for t in row.read] == ["[B]x[E]", "|M][\\E]"] and row.learned == ["|M][\\E]"]
