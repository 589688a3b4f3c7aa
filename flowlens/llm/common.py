"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A working folder only for sessions that name none (tests on one machine).
LOCAL_SHARED = "/tmp/checkpoints"

#: Bytes that part words: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_TABLES: dict[int, np.ndarray] = {}
#: What this worker keeps from task to task, by name.
_KEPT: dict[str, Any] = {}
#: An odd number and its inverse modulo 2 ** 64.
ODD = 0x9E3779B97F4A7C15
BACK = pow(ODD, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A cluster has to name it; only one machine may go without."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if not named and not (conf.get("spark.master") or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return named or LOCAL_SHARED


def materialise(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowlens-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.flowlens_path = path
    return stored


def discard(stored: DataFrame) -> None:
    """Delete what materialise() wrote; nothing may read it any more."""
    spark = stored.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stored.flowlens_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def fold(of: str, parts: int) -> Column:
    """crc32 of the column as text, modulo parts; null rows are in part 0."""
    return F.coalesce(F.crc32(F.col(of).cast("string").cast("binary")) % parts, F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column without nulls, and the offsets of its rows."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts together have about `most` bytes; a longer text comes alone."""
    if not batch.num_rows:
        return
    _, offsets = string_buffers(batch.column(column))
    first = 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield batch.slice(first, end - first)
        first = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~IS_SPACE[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(data)]] = False
    after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets)
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def powers(n: int, of: int = ODD) -> np.ndarray:
    """The first n powers modulo 2 ** 64."""
    if len(_TABLES.get(of, ())) < n:
        _TABLES[of] = np.cumprod(np.append(np.ones(1, np.uint64), np.full(max(n, 256) - 1, of, np.uint64)), dtype=np.uint64)
    return _TABLES[of][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, reach: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; the spans are in order and don't overlap."""
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        begin = int(starts[first])
        end = max(first + 1, int(np.searchsorted(ends, begin + reach, "right")))
        own, low, high = slice(first, end), starts[first:end] - begin, ends[first:end] - begin
        n = int(high[-1])
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data[begin : begin + n] + np.uint64(1)) * powers(n), out=total[1:])
        out[own] = (total[high] - total[low]) * powers(n, BACK)[low] + (high - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        first = end
    return mix(out)


def give_back() -> None:
    """Return what is free in this worker to the system; a worker goes on to other groups, and would else keep the
    memory of its largest one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def keep(name: str, make: Callable[[], Any]) -> Any:
    """make(), once for all tasks that this worker has of one operator."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def drop_others(name: str = "") -> None:
    """Drop what this worker keeps under other names."""
    for other in [x for x in _KEPT if x != name]:
        del _KEPT[other]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; workers go on to tasks of other operators, so a task drops what those keep (all but `keeps`), and
    gives back what it used."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(keeps)
        yield from run(batches)
        give_back()

    return task


def in_blocks(df: DataFrame, text: str = "text", size: int = 8 << 20) -> DataFrame:
    """df with `_block`: rows dealt by a hash of id and text to blocks of about `size` bytes of text. A block
    is what a task holds at once; their number grows with the input."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(total // size + 1, df.sparkSession.sparkContext.defaultParallelism)
    return df.withColumn("_block", F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)).cast("int"))
