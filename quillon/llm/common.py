"""Helpers shared by the training-data operators.

Text columns reach Python as Arrow batches. `Texts` views a column as one UTF-8
buffer with offsets, so splitting into words and hashing are numpy passes over
bytes rather than Python loops over rows. Batches are worked on in chunks of half
a MB, which bounds a task's memory whatever the batch holds; a chunk always
holds whole documents.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
CHUNK_BYTES = 1 << 19
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

#: Bytes of `[^\x20\x09-\x0D]`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, applied after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-quillon-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; where it isn't set, a temporary one, and that in local mode only."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return given or _own_folder()


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet, with a writer's options, in the shared folder and read it back.

    It cuts the lineage: a lost executor costs the tasks that ran on it and no earlier stage.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that others of the caller's can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def without(df: DataFrame, ids: DataFrame, key: str = "doc_id", broadcast_rows: int = 200_000) -> DataFrame:
    """df without the rows whose key is in ids; rows with a null key stay. ids is counted, and broadcast only up to broadcast_rows rows of one long."""
    ids = stored(ids.select(key).dropna().distinct(), "ids")
    return df.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, key, "left_anti")


class Texts:
    """A text column as bytes: data, and offsets with one entry more than there are rows. Null counts as empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        n = len(column)
        _, at, data = column.buffers()  # seen as they are, not copied
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        self.offsets = at - at[0]
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and n else np.zeros(0, np.uint8)

    def chunks(self, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, bytes, offsets) of runs of whole rows; more than limit only for a single row."""
        i, n = 0, len(self.offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + limit, "right")) - 1)
            yield i, j, self.data[self.offsets[i] : self.offsets[j]], self.offsets[i : j + 1] - self.offsets[i]
            i = j


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and for each row (and one more) the number of its first word."""
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output's."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8: differences of its powers keep few factors of two
_INVERSE = pow(_BASE, -1, 1 << 64)
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 .. n - 1; kept for chunks of the usual size."""
    if len(_powers[base]) >= n:
        return _powers[base][:n]
    full = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
    full[0] = 1
    np.multiply.accumulate(full, out=full)
    if n <= 2 * CHUNK_BYTES:
        _powers[base] = full
    return full[:n]


class Rolling:
    """64-bit hashes of any slices of a sequence of 64-bit values, from one prefix sum modulo 2^64."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _power(_BASE, len(values)), out=self.sums[1:])
        self.back = _power(_INVERSE, len(values) + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + U(0x632BE59BD9B4E019) * (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Rolling(BYTE_VALUES[data]).hashes(starts, ends)


def in_small_batches(df: DataFrame) -> DataFrame:
    """df; Arrow batches of the session get the sizes of BATCHES unless it says otherwise: at Spark's own, a batch of long texts takes a GB."""
    for name, size in BATCHES.items():
        if df.sparkSession.conf.get(name, None) is None:
            df.sparkSession.conf.set(name, size)
    return df


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """df.mapInArrow where work turns a batch into dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    made = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in work(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type, from_pandas=False) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name].cast(f.type) for f in made], schema=made)
        released()

    return in_small_batches(df).mapInArrow(run, schema)


def released() -> None:
    """Give memory that a task has freed back to the system: Python workers are used again by tasks of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def squeezed(df: DataFrame) -> DataFrame:
    """df (columns of numbers, and text) with text as zstd bytes `z` and its length `size`: a shuffle moves two thirds of the bytes then."""
    kept = [f for f in df.schema.fields if f.name != "text"]

    def work(batch):
        codec = pa.Codec("zstd", 1)
        t = Texts(batch["text"])
        raw, at = t.data.tobytes(), t.offsets.tolist()
        z = [codec.compress(raw[a:b], asbytes=True) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield {f.name: batch[f.name] for f in kept} | {"z": z, "size": np.diff(t.offsets)}

    return arrow_map(df, work, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["z binary", "size long"]))


def unsqueezed(z: pa.Array, size: pa.Array) -> Texts:
    codec = pa.Codec("zstd", 1)
    return Texts(pa.array([codec.decompress(x, n, asbytes=True) for x, n in zip(z.to_pylist(), size.to_pylist(), strict=True)], pa.large_binary()))
