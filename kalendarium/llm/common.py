"""What the operators of this folder share: batch sizes, worker-wide objects, text rules."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kalendarium.session import checkpoint_dir

#: white space of the word and line rules: blank, tab, newline, vertical tab, form feed, return
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: an Arrow batch ends at this many rows or bytes, so that very long texts don't pile up in a worker
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def run_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, below the folder all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table and go on from its files: cuts the lineage and gives later joins a known size."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The whole text; a missing one counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def per_worker(name: str, make: Callable):
    """An object kept for all tasks of a Python worker. Functions of this package travel by value, so
    their module globals live for one task only; the registry is a module that only lives in the worker."""
    registry = sys.modules.setdefault("_kalendarium_worker", types.ModuleType("_kalendarium_worker")).__dict__
    if name not in registry:
        forget_others()
        registry[name] = make()
    return registry[name]


def forget_others() -> None:
    """Drops what other operators kept: a worker outlives the stages of a pipeline, and an operator keeps one object."""
    registry = sys.modules.get("_kalendarium_worker")
    for name in [n for n in vars(registry) if not n.startswith("__")] if registry else []:
        del registry.__dict__[name]


#: names that tables of documents won't hold
KEY = ["__corpus_id", "__corpus_no_id", "__corpus_text"]


def keyed(df: DataFrame, text_hash: Column | None = None) -> DataFrame:
    """Adds the identity of a row of documents as plain equality keys (also where doc_id is missing)."""
    doc_id = F.col("doc_id").cast("long")
    hashed = F.xxhash64(text_of()) if text_hash is None else text_hash
    return df.withColumns(dict(zip(KEY, [F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), hashed])))


#: bytes of the plain word rule: A-Z in lower case, digits, a-z and all beyond ASCII stay, others part words
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def plain_words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: runs of digits, ASCII letters (in lower case) and code points beyond ASCII."""
    return text.translate(_WORD_BYTES).split()


def text_bytes(name: str = "text") -> Column:
    """The whole text as UTF-8 bytes; a missing one counts as empty."""
    return text_of(name).cast("binary")


class Memo(dict):
    """Remembers ``make(key)`` for the first ``room`` keys."""

    def __init__(self, make: Callable, room: int = 300_000):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.room:
            self[key] = value
        return value
