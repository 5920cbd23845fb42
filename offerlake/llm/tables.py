"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Hashable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the Parquet tables below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """The number of shuffle partitions the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@lru_cache(maxsize=1)
def _of_this_machine() -> str:
    return tempfile.mkdtemp(prefix="offerlake-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's `spark.checkpoint.dir`.

    Only a local session may leave it unset, as tests do; it then gets a folder of this
    machine. A cluster without the setting is an error, for its executors share no such folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _of_this_machine()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder every executor shares."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Bytes of a side that is broadcast at most; a larger one is shuffled.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, size: Column) -> DataFrame:
    """Mark a table for broadcast if its rows take `BROADCAST_BYTES` at most; `size` is a row's bytes.

    The table should be checkpointed, because this measures it.
    """
    total = df.agg(F.sum(size.cast("long"))).head()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


#: Bytes of text of one shuffle partition, which holds some chunks.
PARTITION_BYTES = 32 << 20


def chunked(df: DataFrame, key: str, text: str, chunk_bytes: int, least: int) -> tuple[DataFrame, int]:
    """Deal the rows to chunks, and return them with the number of chunks.

    Both the number of chunks and that of partitions follow the bytes of text, so neither a
    chunk nor a task grows with the table. The key and the text together name the `chunk`:
    rows without a key, or with one in common, spread as their texts do.
    """
    total = df.agg(F.sum(F.octet_length(text))).head()[0] or 0
    count = max(least, -(-total // chunk_bytes))
    tasks = max(parallelism(df.sparkSession), -(-total // PARTITION_BYTES))
    place = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(count)).cast("int")
    return df.withColumn("chunk", place).repartition(tasks, "chunk"), count


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; `OFFERLAKE_TOKENIZERS` may name another folder."""
    folder = os.environ.get("OFFERLAKE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of an Arrow batch of whole texts.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same rows; where the session sets nothing else, batches for Python get `BATCH_BYTES` from now on.

    By default a batch has 10,000 rows, however long their texts are, and stands in the
    memory of the JVM and of the Python worker several times.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) is None:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


_model: dict[Hashable, object] = {}


def one_model(key: Hashable, build: Callable[[], object]):
    """What a Python worker builds once and keeps for its next tasks: one thing, so that memory stays bounded."""
    if key not in _model:
        no_model()
        _model[key] = build()
        _give_back()
    return _model[key]


def no_model() -> None:
    """Let go of what an earlier operator's tasks have left in this worker."""
    if _model:
        _model.clear()
        _give_back()


def _give_back() -> None:
    """Return freed memory to the system; workers live on after their tasks, and share the executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batch: pa.RecordBatch, text: str, bound: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts pass `bound` bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(batch):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + bound, side="right")))
        yield batch.slice(start, end - start)
        start = end


def written(df: DataFrame, place: str) -> DataFrame:
    """Write a table below the shared folder and read it again: cuts the lineage, packs columns better than a checkpoint."""
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def discard(spark: SparkSession, place: str) -> None:
    """Delete a table that `written` made."""
    old = spark._jvm.org.apache.hadoop.fs.Path(place)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
