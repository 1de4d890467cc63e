"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch sent to Python. Texts may be long, so batches are kept short.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Set what bounds the memory of Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def by_size(texts: Sequence[str | None], most: int) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters in all, one text at least in each."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if isinstance(t, str) else 0
        if held >= most:
            yield slice(a, i + 1)
            a, held = i + 1, 0
    if a < len(texts):
        yield slice(a, len(texts))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, as in tests, one of our own on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="lectern-")
    return own


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Work behind it is done once, and a lost executor costs no more than reading the files again.
    """
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    path = f"{own}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(own)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)  # when the application ends
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by


def span_key(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def trim() -> None:
    """Hand freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_STATE: dict[str, Any] = {}


def worker_state(key: str, build: Callable[[], Any]) -> Any:  # noqa: ANN401
    """What a Python worker keeps between batches and tasks: of one operator at a time.

    Workers outlive stages. When another operator begins, what the last one kept is freed and handed back to the system.
    """
    if key not in _STATE:
        _STATE.clear()
        trim()
        _STATE[key] = build()
    return _STATE[key]
