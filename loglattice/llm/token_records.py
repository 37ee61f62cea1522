"""Token ids as length-delimited binary records with a separate offset index.

A dataset is a folder:

* ``part-NNNNN-SSSS-<attempt>.rec``: records, each of
  ``uint64 length | uint32 masked crc of the length | payload | uint32 masked crc of the payload``,
  little-endian, checksums CRC-32C with the usual rotation mask;
* ``part-NNNNN-SSSS-<attempt>.idx``: per record five int64: byte offset, payload length, number of
  ids before it in the file, document id and whether it has one, so that records can be read in
  any order by seeking;
* ``manifest/``: Parquet with a row per file that counts.  A retried or speculative task
  writes under another attempt's name and its files are simply not listed.

A payload is the document's ids followed by the end id, as unsigned 16-bit numbers where the
vocabulary allows and else 32-bit ones.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglattice.llm import bpe
from loglattice.llm import textkit as tk

END_ID = 0
HEAD, TAIL = 12, 4
FILE_BYTES = 64 << 20
MANIFEST_SCHEMA = "part int, seq int, file string, n_records bigint, n_ids bigint, n_bytes bigint, id_bytes int"
_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64()), ("id_bytes", pa.int32())])
INDEX = np.dtype([("offset", "<i8"), ("length", "<i8"), ("start", "<i8"), ("doc_id", "<i8"), ("has_id", "<i8")])


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


_T = _crc_table()
#: Running the checksum over one more 16-bit word, from a zero register.
_W16 = _T[(_T[np.arange(65536) & 255] ^ (np.arange(65536) >> 8)) & 255] ^ (_T[np.arange(65536) & 255] >> 8)
_W16 = _W16.astype(np.uint32)
_zeros: list[tuple[np.ndarray, np.ndarray]] = []


def _skip(level: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables (low and high half) of the linear map that runs a register over 2**level zero words."""
    while len(_zeros) <= level:
        half = np.arange(65536, dtype=np.uint32)
        if not _zeros:
            _zeros.append((_W16.copy(), half))
        else:
            lo, hi = _zeros[-1]
            twice = lambda x: lo[x & 0xFFFF] ^ hi[x >> 16]
            _zeros.append((twice(lo), twice(hi)))
    return _zeros[level]


def crc32c_words(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """CRC-32C of each run of 16-bit little-endian words ``flat[off[i]:off[i + 1]]``.

    The checksum is linear, so words are combined pairwise up a tree; runs are padded in front
    to a power of two, where zero words leave a zero register as it is.
    """
    n = np.diff(off)
    out = np.zeros(len(n), dtype=np.uint32)
    level = np.where(n > 0, np.ceil(np.log2(np.maximum(n, 1))).astype(int), -1)
    for k in np.unique(level[level >= 0]):
        for rows in np.array_split(np.flatnonzero(level == k), max(1, int((level == k).sum()) * (1 << k) >> 22)):
            width = 1 << int(k)
            grid = np.zeros((len(rows), width), dtype=np.uint32)
            at = width - n[rows]
            where = np.arange(int(n[rows].sum())) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
            row = np.repeat(np.arange(len(rows)), n[rows])
            value = flat[where + np.repeat(off[rows], n[rows])].astype(np.uint32)
            # The register starts as all ones: that is, the first 32 bits are inverted.
            value ^= np.where(where < 2, np.uint32(0xFFFF), np.uint32(0))
            grid[row, where + np.repeat(at, n[rows])] = value
            grid = _W16[grid]
            for j in range(int(k)):
                lo, hi = _skip(j)
                left = grid[:, 0::2]
                grid = lo[left & 0xFFFF] ^ hi[left >> 16] ^ grid[:, 1::2]
            got = grid[:, 0]
            if k == 0:  # one word: the upper half of the inverted start is still in the register
                got = got ^ np.uint32(0xFFFF)
            out[rows] = ~got
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint64)
    return (((crc >> np.uint64(15)) | (crc << np.uint64(17))) + np.uint64(0xA282EAD8)).astype(np.uint32)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def frame(ids: np.ndarray, off: np.ndarray, id_bytes: int) -> tuple[bytes, np.ndarray]:
    """Records of some documents (whose ids include the end id) and their byte lengths."""
    n = len(off) - 1
    raw = ids.astype("<u2" if id_bytes == 2 else "<u4").tobytes()
    words = np.frombuffer(raw, dtype="<u2")
    body = np.diff(off) * id_bytes
    sums = masked(crc32c_words(words, off * (id_bytes // 2))).astype("<u4")
    head = body.astype("<u8")
    head_sums = masked(crc32c_words(head.view("<u2"), np.arange(n + 1) * 4)).astype("<u4")
    out = []
    at = (off * id_bytes).tolist()
    heads, head_crcs, crcs = head.tobytes(), head_sums.tobytes(), sums.tobytes()
    for k in range(n):
        out += [heads[8 * k : 8 * k + 8], head_crcs[4 * k : 4 * k + 4], raw[at[k] : at[k + 1]], crcs[4 * k : 4 * k + 4]]
    return b"".join(out), body + HEAD + TAIL


def _with_end(ids: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(off) - 1
    out = np.full(len(ids) + n, end_id, dtype=np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(off))] = ids
    return out, off + np.arange(n + 1)


class _Part:
    """One record file and its index, written under names of this attempt."""

    def __init__(self, folder: str, name: str):
        self.where, base = _open(folder)
        self.where.create_dir(base, recursive=True)
        self.name, self.n_records, self.n_ids, self.n_bytes = name, 0, 0, 0
        self.rec, self.idx = (self.where.open_output_stream(f"{base}/{name}.{x}") for x in ("rec", "idx"))

    def add(self, doc: pa.Array, ids: np.ndarray, off: np.ndarray, id_bytes: int) -> None:
        data, size = frame(ids, off, id_bytes)
        entry = np.empty(len(size), dtype=INDEX)
        entry["offset"] = self.n_bytes + np.cumsum(size) - size
        entry["length"] = np.diff(off) * id_bytes
        entry["start"] = self.n_ids + off[:-1]
        entry["doc_id"] = doc.fill_null(0).to_numpy(zero_copy_only=False)
        entry["has_id"] = doc.is_valid().to_numpy(zero_copy_only=False)
        self.rec.write(data)
        self.idx.write(entry.tobytes())
        self.n_records, self.n_ids, self.n_bytes = self.n_records + len(size), self.n_ids + len(ids), self.n_bytes + len(data)

    def close(self, part: int, seq: int, id_bytes: int) -> pa.RecordBatch:
        self.rec.close()
        self.idx.close()
        row = (part, seq, self.name, self.n_records, self.n_ids, self.n_bytes, id_bytes)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _MANIFEST.types, strict=True)], schema=_MANIFEST)


def _writer(tokenizer_path: str, folder: str, id_bytes: int, end_id: int, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(tokenizer_path)
        part, attempt, seq, out = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0, None
        for batch in batches:
            text, doc = batch.column("text"), batch.column("id")
            for a, b in tk.column_slices(text, bpe.SLICE_BYTES):
                out = out or _Part(folder, f"part-{part:05d}-{seq:04d}-{attempt}")
                out.add(doc.slice(a, b - a), *_with_end(*encoder.encode(*tk.text_bytes(text.slice(a, b - a))), end_id), id_bytes)
                if out.n_bytes >= file_bytes:
                    yield out.close(part, seq, id_bytes)
                    seq, out = seq + 1, None
        if out:
            yield out.close(part, seq, id_bytes)

    return write


def vocabulary_width(tokenizer_path: str, end_id: int = END_ID) -> int:
    """Bytes an id takes: 2 where every id fits, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(*Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values(), end_id) < 65536 else 4


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every text and write the dataset in ascending order of the integer ``id_col``.

    Null ids come first; rows of one id are ordered by their text, and equal rows are all
    written.  Null and empty texts are records of the end id alone.  Returns the manifest.
    """
    folder = tk.qualified(docs.sparkSession, folder)  # tasks open it by themselves
    rows = docs.select(docs[f"`{id_col}`"].cast("bigint").alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc()]
    ordered = rows.repartitionByRange(*keys[:2]).sortWithinPartitions(*keys)
    written = tk.map_arrow(ordered, _writer(tokenizer_path, folder, vocabulary_width(tokenizer_path, end_id), end_id, file_bytes), MANIFEST_SCHEMA)
    written.write.parquet(f"{folder}/manifest")
    return read_manifest(docs.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row per file, with the number of ids in all files before it as ``first_id``."""
    files = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint"))


def read_file(folder: str, name: str, id_bytes: int, chunk: int = 8 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index entries, ids and offsets into them, some records at a time; every checksum is verified."""
    where, base = _open(folder)
    with where.open_input_stream(f"{base}/{name}.idx") as f:
        index = np.frombuffer(f.read(), dtype=INDEX)
    end = index["offset"] + index["length"] + HEAD + TAIL
    with where.open_input_file(f"{base}/{name}.rec") as f:
        at = 0
        while at < len(index):
            to = max(at + 1, int(np.searchsorted(end, index["offset"][at] + chunk, side="right")))
            part = index[at:to]
            raw = f.read_at(int(end[to - 1] - part["offset"][0]), int(part["offset"][0]))
            place = part["offset"] - part["offset"][0]
            view = memoryview(raw)
            heads = b"".join(view[p : p + HEAD] for p in place.tolist())
            head = np.frombuffer(heads, dtype=[("length", "<u8"), ("crc", "<u4")])
            bodies = b"".join(view[p + HEAD : p + HEAD + n] for p, n in zip(place.tolist(), part["length"].tolist(), strict=True))
            crcs = np.frombuffer(b"".join(view[p : p + TAIL] for p in (place + HEAD + part["length"]).tolist()), dtype="<u4")
            off = np.concatenate([[0], np.cumsum(part["length"])])
            lengths = np.ascontiguousarray(head["length"])
            good = (lengths == part["length"].astype(np.uint64)) & (masked(crc32c_words(lengths.view("<u2"), np.arange(len(part) + 1) * 4)) == head["crc"])
            good &= masked(crc32c_words(np.frombuffer(bodies, dtype="<u2"), off // 2)) == crcs
            if not good.all():
                raise ValueError(f"{name}: record {at + int(np.argmin(good))} is damaged")
            yield part, np.frombuffer(bodies, dtype="<u2" if id_bytes == 2 else "<u4"), off // id_bytes
            at = to


RECORD_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string, byte_offset bigint, n_bytes bigint"


def _reader(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string()), ("byte_offset", pa.int64()), ("n_bytes", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                for index, ids, off in read_file(folder, f["file"], f["id_bytes"]):
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                    doc = pa.array(index["doc_id"], mask=index["has_id"] == 0)
                    yield pa.RecordBatch.from_arrays([doc, pa.array(index["start"] + f["first_id"]), pa.array(np.diff(off)), pa.array(crc, pa.int64()), pa.array([f["file"]] * len(index)), pa.array(index["offset"]), pa.array(index["length"] + HEAD + TAIL)], schema=schema)

    return read


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record, read back from the files and verified.

    start is the number of ids of all records before it, ids_crc32 the CRC-32 of its ids as
    little-endian unsigned 32-bit numbers.
    """
    folder = tk.qualified(spark, folder)
    files = read_manifest(spark, folder).select("file", "id_bytes", "first_id")
    return tk.map_arrow(files.repartition(max(1, min(files.count(), 10_000))), _reader(folder), RECORD_SCHEMA)
