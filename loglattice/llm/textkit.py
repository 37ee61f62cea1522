"""Shared plumbing of the training-data operators: work folders and vectorised word hashing.

Word hashing works on the bytes of an Arrow string column with numpy, a few megabytes at a
time, so memory stays bounded however long a text or a batch is (one text longer than a
slice is a slice of its own).
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
SHINGLE_WORDS = 5

U64 = np.uint64
_GAMMA = U64(0x9E3779B97F4A7C15)
_M1 = U64(0xBF58476D1CE4E5B9)
_M2 = U64(0x94D049BB133111EB)

#: Word characters: ASCII letters and digits, and every byte of a non-ASCII character.
_WORD = np.zeros(256, dtype=bool)
_WORD[0x80:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _WORD[_lo:_hi] = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset (tests) a folder
    of our own is configured.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"/tmp/checkpoints/loglattice-{os.getuid()}"
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that Spark reads it by."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables of one run, in a folder of its own under the shared one.

    What ``put`` writes is deleted by ``clear``; what ``keep`` writes stays, for the result to read.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.n = spark, work_dir(spark, label), 0

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put(self, df: DataFrame, label: str, rows: int | None = None, per: int = 50_000) -> DataFrame:
        """Write a table that has about ``rows`` rows at most, in no more files than ``per`` rows each call for."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // per)))
        return self._write(df, self.path(label))

    def path(self, label: str) -> str:
        """A new folder name among those that ``clear`` deletes."""
        self.n += 1
        return f"{self.base}/scratch/{self.n:03d}-{label}"

    def counted(self, df: DataFrame, label: str, rows: int | None = None, per: int = 50_000) -> tuple[DataFrame, int]:
        """The same, with the number of rows that were written, which the files' footers tell."""
        out = self.put(df, label, rows, per)
        return out, out.count()

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        return self._write(df, f"{self.base}/{label}")

    def drop(self, name: str) -> None:
        """Delete a folder that no table still to be read needs."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        self.drop(f"{self.base}/scratch")


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold about ``BATCH_BYTES``, so that long rows take no more memory than short ones."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give memory that is no longer used back to the system: a worker process waits for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def map_arrow(df: DataFrame, f, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over batches of bounded size; columns may have any names."""
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = df.columns
    plain = [f"c{k}" for k in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in f(b.rename_columns(names) for b in batches):
            yield batch.rename_columns([f"c{k}" for k in range(batch.num_columns)])
        release()

    bound_batches(df.sparkSession)
    return df.toDF(*plain).mapInArrow(run, T.StructType([T.StructField(f"c{k}", x.dataType, x.nullable) for k, x in enumerate(out)])).toDF(*out.names)


def with_outputs(df: DataFrame, **cols: Column) -> DataFrame:
    """Add output columns; an input column of the same name (any case) is replaced."""
    names = {c.lower() for c in cols}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in names], *[v.alias(k) for k, v in cols.items()])


def fresh(*tables: DataFrame) -> str:
    """A prefix with which no column of the tables begins, whatever their case."""
    names = [c.lower() for t in tables for c in t.columns]
    p = "__ll_"
    while any(c.startswith(p) for c in names):
        p += "_"
    return p


def schema_with(df: DataFrame, name: str, kind: str) -> T.StructType:
    """The schema of ``df`` with one more column at its end."""
    return T.StructType([*df.schema.fields, T.StructField(name, T.DataType.fromDDL(kind))])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


_LONG = 64
_TAIL = (U64(1) << (U64(8) * np.arange(8, dtype=U64))) - U64(1)
_PLACE = mix((np.arange(_LONG // 8, dtype=U64) + U64(1)) * _GAMMA)


def words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of the buffer on as one little-endian number; zeros follow its end."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(buf) + 1,), strides=(1,))


def run_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs: a bijective mix after every eight bytes, XXH3 for runs of more than 64.

    Nothing is summed over places, so texts with an inner structure (a word and its complement,
    two parts exchanged) are told apart like any others.
    """
    start, end = np.asarray(start, dtype=np.int64), np.asarray(end, dtype=np.int64)
    size = end - start
    out = mix(size.astype(U64) * _GAMMA + U64(0x2545F4914F6CDD1D))
    at = words_at(buf)
    todo = np.flatnonzero((size > 0) & (size <= _LONG))
    for k in range(_LONG // 8):
        if not len(todo):
            break
        left = size[todo] - 8 * k
        block = at[start[todo] + 8 * k]
        block = np.where(left < 8, block & _TAIL[np.minimum(left, 7)], block)
        out[todo] = mix((out[todo] ^ (block * _M2)) + _PLACE[k])
        todo = todo[left > 8]
    long = np.flatnonzero(size > _LONG)
    if len(long):
        view = memoryview(np.ascontiguousarray(buf))
        out[long] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


def same_runs(a: np.ndarray, start_a: np.ndarray, b: np.ndarray, start_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether runs of ``size`` bytes from ``start_a`` in one buffer equal those from ``start_b`` in another, byte by byte."""
    same = np.ones(len(size), dtype=bool)
    at_a, at_b = words_at(a), words_at(b)
    todo = np.flatnonzero((size > 0) & (size <= _LONG))
    for k in range(_LONG // 8):
        if not len(todo):
            break
        left = size[todo] - 8 * k
        differ = at_a[start_a[todo] + 8 * k] ^ at_b[start_b[todo] + 8 * k]
        differ = np.where(left < 8, differ & _TAIL[np.minimum(left, 7)], differ)
        same[todo] &= differ == 0
        todo = todo[(left > 8) & (differ == 0)]
    for k in np.flatnonzero(size > _LONG).tolist():
        n = int(size[k])
        same[k] = np.array_equal(a[start_a[k] : start_a[k] + n], b[start_b[k] : start_b[k] + n])
    return same


def column_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column holding about ``limit`` bytes each, one row at least."""
    n = len(col)
    if not n:
        return
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    start = 0
    while start < n:
        base = end[start] - size[start]
        stop = max(start + 1, int(np.searchsorted(end, base + limit, side="right")))
        yield start, stop
        start = stop


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (nulls count as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word in order, and row offsets into that array."""
    n_rows = len(off) - 1
    is_word = _WORD[buf]
    if not is_word.any():
        return np.zeros(0, dtype=U64), np.zeros(n_rows + 1, dtype=np.int64)
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    inner = off[:-1][(off[:-1] > 0) & (off[:-1] < len(buf))]
    begins[inner] = is_word[inner]
    start = np.flatnonzero(begins)
    ends = is_word
    ends[:-1] &= ~is_word[1:]
    ends[inner - 1] = _WORD[buf[inner - 1]]
    return run_hashes(buf, start, np.flatnonzero(ends) + 1), np.searchsorted(start, off)


_STEP = mix((np.arange(64, dtype=U64) + U64(101)) * _GAMMA) | U64(1)


def shingle_hashes(words: np.ndarray, off: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, row by row, and row offsets.

    A row of 1 to k-1 words has one shingle of all its words; a row without words has none.
    """
    n = np.diff(off)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_off = np.concatenate([[0], np.cumsum(count)])
    total = int(out_off[-1])
    if not total:
        return np.zeros(0, dtype=U64), out_off
    at = np.arange(total) + np.repeat(off[:-1] - out_off[:-1], count)
    left = np.repeat(n, count)
    acc = np.zeros(total, dtype=U64)
    last = len(words) - 1
    for j in range(k):
        term = mix(words[np.minimum(at + j, last)] ^ _STEP[j])
        if j:
            term[left <= j] = 0
        acc += term
    return mix(acc + np.minimum(left, k).astype(U64)), out_off


def crc32_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)
