"""Ask language models about offers, and keep within what a day allows.

A provider answers four kinds of request. Requests are numbered in a defined order; as many
as the day's budget has left are asked, each once, in Arrow batches where the rows lie. What
comes back is text, which `sources.answers` reads. The default provider is a table of
answers that are known already.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.operators import ingest
from offerlake.operators.order import numbered
from offerlake.plans.lineage import checkpointed

#: Kinds of request, and the columns that each sees beside `url`.
REQUESTS = {
    "extract": ("title", "maker", "shop"),
    "suggest": ("title", "maker", "name"),
    "infer": ("title", "maker", "name"),
    "choose": ("title", "maker", "name", "candidates"),
}
#: Requests that a day allows. A fixed value.
DAILY = 14_000


class Provider(ABC):
    """A model behind four methods, each from a batch of requests (`REQUESTS`) to its answers' texts.

    A null answer is none. A provider travels to the tasks, so it holds what it takes to
    connect, not a connection; `open` is called once in each task. A batch whose method
    raises gets no answers, and the reason `error`.
    """

    name = "provider"

    def open(self) -> None:
        """Connect; does nothing where nothing is needed."""

    @abstractmethod
    def extract(self, batch: pd.DataFrame) -> pd.Series:
        """Maker, name and kind of each title."""

    @abstractmethod
    def suggest(self, batch: pd.DataFrame) -> pd.Series:
        """Other queries for offers that found nothing."""

    @abstractmethod
    def infer(self, batch: pd.DataFrame) -> pd.Series:
        """The maker's official name and slug, and the product's name."""

    @abstractmethod
    def choose(self, batch: pd.DataFrame) -> pd.Series:
        """The number of the candidate that fits, or -1; `candidates` is a JSON list."""


class TableProvider:
    """Answers out of a table (`kind`, `url`, `answer`), joined; of repeated ones the greatest counts."""

    name = "table"

    def __init__(self, answers: DataFrame):
        self.answers = answers

    def ask(self, requests: DataFrame, kind: str) -> DataFrame:
        known = self.answers.where(F.col("kind") == kind).groupBy("url").agg(F.max("answer").alias("answer"))
        return requests.join(known, "url", "left").withColumn("error", F.lit(None).cast("string"))


def _asked(requests: DataFrame, kind: str, provider: Provider | TableProvider) -> DataFrame:
    if isinstance(provider, TableProvider):
        return provider.ask(requests, kind)
    columns = requests.columns
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema] + ["answer string", "error string"]
    method: Callable[[pd.DataFrame], pd.Series] = getattr(provider, kind)

    def batches_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider.open()
        for batch in batches:
            error = None
            try:
                said = list(method(batch))
                if len(said) != len(batch):
                    raise ValueError(f"{len(said)} answers to {len(batch)} requests")
            except Exception as fault:  # noqa: BLE001  a provider's fault is a reason, not the end of the run
                said, error = [None] * len(batch), f"{type(fault).__name__}: {fault}"
            yield batch[columns].assign(answer=pd.Series(said, index=batch.index, dtype=object), error=error)

    return requests.mapInPandas(batches_of, ", ".join(fields))


def ask(
    requests: DataFrame, kind: str, provider: Provider | TableProvider, *order: Column, usage: DataFrame | None = None, day: Column | None = None, budget: int = DAILY
) -> tuple[DataFrame, DataFrame]:
    """Ask a provider: the requests with `answer`, `error` and `asked`, and the usage after it.

    `requests` has `url` and the columns of its kind. In the given order, then by url, as
    many are asked as `budget` leaves after what `usage` (`service`, `day`, `requests`)
    says of the provider's name on `day`; the others have neither answer nor error. The
    answers are kept in the shared folder before anything reads them, so a later failure asks nobody twice.
    """
    if kind not in REQUESTS:
        raise ValueError(f"no such request: {kind}")
    today = F.current_date() if day is None else day
    spent = 0
    if usage is not None:
        of_today = usage.where((F.col("service") == provider.name) & (F.col("day") == today))
        spent = of_today.agg(F.coalesce(F.sum("requests"), F.lit(0))).head()[0]
    rows = requests.select("url", *REQUESTS[kind], *(c for c in requests.columns if c not in ("url", *REQUESTS[kind])))
    placed = numbered(rows, *order, F.col("url"), name="_place")
    left = max(0, budget - spent)
    wanted = placed.where(F.col("_place") < left).drop("_place")
    answered = checkpointed(_asked(wanted, kind, provider).withColumn("asked", F.lit(True)))
    rest = placed.where(F.col("_place") >= left).drop("_place")
    nothing = {"answer": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "asked": F.lit(False)}
    calls = answered.select(F.lit(provider.name).alias("service"), today.alias("day"))
    before = usage if usage is not None else calls.limit(0).withColumn("requests", F.lit(0).cast("long"))
    return answered.unionByName(rest.withColumns(nothing)), ingest.add_usage(before, calls)
