"""What language models answered, as typed columns.

Models wrap their JSON in fences, talk around it, or break off. A scanner finds the largest
valid object of a text in one pass, and everything after that is column expressions: the
object is read once into variants, so a field's type can be told from its text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from offerlake.functions import titles

_TOKEN = re.compile(
    r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))'
)


def _object_end(text: str, start: int, ends: dict[int, int]) -> None:
    """Read one JSON value from the brace at `start` on, and note the end of every object in it, -1 for those that have none.

    `ends` remembers the objects of earlier calls, so no brace is opened twice: a known object
    is passed over at once, a known failure fails what holds it.
    """
    open_: list[int] = []  # starts of objects, -1 for arrays
    at, want = start, "value"
    while True:
        token = _TOKEN.match(text, at)
        if token is None:
            break
        sign, string, _ = token.groups()
        here, at = token.start(token.lastindex), token.end()
        if sign in ("{", "[") and want in ("value", "value or end"):
            if sign == "{" and here in ends:
                if ends[here] < 0:
                    break
                at, want = ends[here], "comma or end"
            else:
                open_.append(here if sign == "{" else -1)
                want = "key or end" if sign == "{" else "value or end"
        elif sign in ("}", "]"):
            if want not in ("comma or end", "key or end" if sign == "}" else "value or end") or (open_[-1] < 0) == (sign == "}"):
                break
            begun = open_.pop()
            if begun >= 0:
                ends[begun] = at
            if not open_:
                return
            want = "comma or end"
        elif sign == ",":
            if want != "comma or end":
                break
            want = "key" if open_[-1] >= 0 else "value"
        elif sign == ":":
            if want != "colon":
                break
            want = "value"
        elif string and want in ("key", "key or end"):
            want = "colon"
        elif not sign and want in ("value", "value or end"):
            want = "comma or end"
        else:
            break
    for begun in open_:
        if begun >= 0:
            ends[begun] = -1


def largest_object(text: str | None) -> str | None:
    """The longest part of a text that is a JSON object, of equals the first; null without one."""
    if not text:
        return None
    ends: dict[int, int] = {}
    for brace in re.finditer(r"\{", text):
        if brace.start() not in ends:
            _object_end(text, brace.start(), ends)
    best = min(((start - end, start) for start, end in ends.items() if end > 0), default=None)
    return None if best is None else text[best[1] : ends[best[1]]]


@F.pandas_udf(StringType())
def object_in(texts: pd.Series) -> pd.Series:
    """`largest_object` of each text."""
    return texts.map(largest_object, na_action="ignore")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def unfenced(text: Column) -> Column:
    """A text without spaces and Markdown fences around it."""
    return trimmed(F.regexp_replace(trimmed(text), r"(?s)^```(?:json)?(?:```)?|```$", ""))


#: Fields of an answer. The names are this library's; `ANSWER_KEYS` gives the keys that models were asked for. Fixed values.
ANSWER_KEYS = {
    "producer_jp": "brewery_name_jp",
    "producer_en": "brewery_name_en",
    "name_jp": "beer_name_jp",
    "name_en": "beer_name_en",
    "name_core": "beer_name_core",
    "search_hint": "search_hint",
    "inferred_producer": "english_brewery_name",
    "inferred_slug": "brewery_slug",
    "inferred_name": "english_beer_name",
}
#: Kinds of product that an answer may give, and what counts where it gives another. Fixed values.
KINDS, OTHERWISE = ("beer", "set", "glass", "other"), "beer"
#: Queries of an answer that are tried, and the characters they need. Fixed values.
MOST_QUERIES, LEAST_QUERY = 5, 3

_SHAPE = ", ".join(f"{key} variant" for key in (*ANSWER_KEYS.values(), "product_type", "is_set", "queries", "selected_index", "reason"))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _string(v: Column) -> Column:
    """A variant's text if it is a string that isn't blank."""
    return F.nullif(trimmed(F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))), F.lit(""))


def _truth(v: Column) -> Column:
    """Whether a value counts as true: not null, false, zero or empty."""
    said = F.to_json(v)
    return F.coalesce(~said.isin("null", "false", '""', "[]", "{}") & ~said.rlike(r"^-?0(\.0*)?$"), F.lit(False))


def read_answers(answers: DataFrame, column: str = "answer", noisy: bool = True) -> DataFrame:
    """Add to each answer the object in it and its fields.

    `object` is the largest JSON object of the text, or, unless `noisy`, the whole text
    without fences if that is one object. Names that are no strings or blank are null;
    `product_type` is one of `KINDS`, else beer; `is_set` is what counts as true; `queries` are the
    strings of that list that aren't blank, null if it is no list; `selected_index` is a whole
    number or -1; `inferred_slug` is in lower case. A text without an object gives null in all of them. A key that
    comes twice counts as the last says. Further columns stay; of the same names the new ones count.
    """
    text = F.col(column) if noisy else unfenced(F.col(column))
    found = object_in(text)
    whole = found if noisy else F.when(found == text, found)
    # a generated column: filters on what is read of the object don't look for it once more, in a second Python worker of the task
    rows = answers.select(*(c for c in answers.columns if c != "object"), F.explode(F.array(whole)).alias("object"))
    there = F.col("object").isNotNull()
    v = lambda key: F.col("_read")[key]
    kind, number = _string(v("product_type")), F.try_variant_get(v("selected_index"), "$", "int")
    listed = F.try_variant_get(v("queries"), "$", "array<variant>")
    fields = {name: _string(v(key)) for name, key in ANSWER_KEYS.items()}
    fields |= {
        "inferred_slug": F.lower(fields["inferred_slug"]),
        "product_type": F.when(there, F.when(kind.isin(*KINDS), kind).otherwise(OTHERWISE)),
        "is_set": F.when(there, _truth(v("is_set"))),
        "queries": F.filter(F.transform(listed, _string), lambda q: q.isNotNull()),
        "selected_index": F.when(there, F.coalesce(number, F.lit(-1))),
        "reason": _string(v("reason")),
    }
    return rows.withColumn("_read", F.from_json("object", _SHAPE)).withColumns(fields).drop("_read")


def extraction(read: DataFrame, title: str) -> DataFrame:
    """Correct what an answer says of a title's kind by rules.

    A title that names a pack is a set. What was called "other" though it has a producer or a
    name is a set or a beer, unless the title names printed matter, glasses or clothes.
    """
    names = ("producer_en", "producer_jp", "name_en", "name_jp")
    kind = titles.product_type(F.col(title), F.col("product_type"), F.col("is_set"), *(F.col(n) for n in names))
    return read.withColumns({"product_type": kind, "is_set": titles.is_set_pack(F.col(title), terms_too=True) | F.coalesce("is_set", F.lit(False))})


def queries_to_try(read: DataFrame, key: str) -> DataFrame:
    """Queries that an answer suggests, and before them the names it inferred: `key`, `nth`, `maker`, `name`.

    `nth` 0 is the inferred maker and name, if the answer has these and a slug; 1 to 5 are
    queries of three characters or more. What `linkage.second_chance` takes.
    """
    whole = F.col("inferred_producer").isNotNull() & F.col("inferred_slug").isNotNull() & F.col("inferred_name").isNotNull()
    first = read.where(whole).select(key, F.lit(0).alias("nth"), F.col("inferred_producer").alias("maker"), F.col("inferred_name").alias("name"))
    long = F.slice(F.filter("queries", lambda q: F.length(q) >= LEAST_QUERY), 1, MOST_QUERIES)
    tried = read.select(key, F.posexplode(long).alias("nth", "name"))
    return first.unionByName(tried.select(key, (F.col("nth") + 1).alias("nth"), F.lit(None).cast("string").alias("maker"), "name"))


def verdicts(read: DataFrame, asked: DataFrame, key: str = "url") -> DataFrame:
    """A model's choice among numbered candidates (`asked`: `key`, `pos` from 0, `product_url`): `key`, `product_url`, `selection_reason`.

    An answer that names none of them rejects all, which is a null `product_url`; a text
    without an object says nothing. What `linkage.decide` takes.
    """
    said = read.where(F.col("object").isNotNull()).select(key, F.col("selected_index").alias("pos"), F.col("reason").alias("_reason"))
    met = said.join(asked.select(key, "pos", "product_url"), [key, "pos"], "left")
    return met.select(key, "product_url", F.when(F.col("product_url").isNotNull(), F.coalesce("_reason", F.lit(""))).alias("selection_reason"))
