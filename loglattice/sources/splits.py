"""Files whose records have no marks of their own, read in byte ranges by many tasks.

``SplitSource`` is a data source with a partition per range of a file (``ranges``).  A record
belongs to the range in which it begins, and its end is read from the next range, so any cut of a
file gives the same rows: (file, pos, text, context, reason, modified), the last in milliseconds.  Its layouts:

* ``lines``: a line is a record;
* ``blocks``: lines up to a blank one are a record;
* ``registry``: a value with the lines that continue it is a record, and its context is the key
  above it, which is looked for backwards from the range's begin.

``json_elements`` cuts JSON documents between the objects of an array or of a ``Data`` list.
Whether a place lies in a string, and how deep, depends on all that is before it: every range
tells its quotes' parity and its change of depth for both cases, these are added up over the
ranges of each file, and then every range knows where it begins.

What cannot be read is a row with a ``reason`` and no text: a file that can't be opened, a
compressed file that ends or breaks early (its rows up to there are kept), an object that does not
close.  Files named ``.gz`` are one range.  Text is UTF-16 with a byte order mark, else UTF-8, and a
record that is not UTF-8 is taken as Latin-1.
"""

from __future__ import annotations

import codecs
import gzip
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20
#: Bytes that are held at a time; even.
CHUNK = 1 << 20
NAME = "loglattice_splits"
SCHEMA = "file string, pos bigint, text string, context string, reason string, modified bigint"
_ROWS = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("text", pa.string()), ("context", pa.string()), ("reason", pa.string()), ("modified", pa.int64())])
_BROKEN = (OSError, EOFError, zlib.error, ValueError)


def _open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def reachable(path: str) -> bool:
    """Whether tasks can open files there by themselves; some stores only Spark's readers can."""
    try:
        _open_fs(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


File = tuple[str, int, int | None]


def files_under(path: str | list[str]) -> list[File]:
    """(path, size, time of change in ms) of files, or of all files under folders but hidden ones and markers."""
    if not isinstance(path, str):
        return [f for p in path for f in files_under(p)]
    where, base = _open_fs(path)
    info = where.get_file_info(base)
    fact = lambda name, f: (name, f.size, f.mtime_ns // 1_000_000 if f.mtime_ns is not None else None)
    if info.type == fs.FileType.File:
        return [fact(path, info)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    head = path.rstrip("/")
    found = where.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted(fact(head + f.path[len(base.rstrip("/")) :], f) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._")


def ranges(files: list[File], split_bytes: int) -> list[tuple[str, int, int, int | None]]:
    """(file, begin, end, time of change): even begins, so that no two-byte character is cut; a compressed file is one range."""
    step = max(2, split_bytes // 2 * 2)
    out = []
    for path, size, modified in files:
        if path.endswith(".gz"):
            out.append((path, 0, 1 << 62, modified))
        else:
            out += [(path, a, min(a + step, size), modified) for a in range(0, max(size, 1), step)]
    return out


class Bytes:
    """Random access to a file's bytes."""

    def __init__(self, path: str):
        where, base = _open_fs(path)
        self._file = where.open_input_file(base)
        self.size = self._file.size()
        head = self.at(0, 4)
        self.skip = 2 if head[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) else 3 if head[:3] == codecs.BOM_UTF8 else 0
        self.encoding = {codecs.BOM_UTF16_LE: "utf-16-le", codecs.BOM_UTF16_BE: "utf-16-be"}.get(head[:2], "utf-8")
        self.width = 2 if self.skip == 2 else 1
        self.newline = "\n".encode(self.encoding)

    def at(self, a: int, n: int) -> bytes:
        return self._file.read_at(max(0, min(n, self.size - a)), a) if a < self.size else b""

    def text(self, raw: bytes) -> str:
        try:
            return raw.decode(self.encoding)
        except UnicodeDecodeError:
            return raw.decode("latin-1" if self.width == 1 else self.encoding, "replace")

    def line_begin(self, a: int) -> int:
        """The first begin of a line at ``a`` or after it."""
        if a <= self.skip:
            return self.skip
        at = a - self.width
        while at < self.size:
            part = self.at(at, CHUNK)
            k = part.find(self.newline)
            while k >= 0 and k % self.width:
                k = part.find(self.newline, k + 1)
            if k >= 0:
                return at + k + self.width
            at += len(part)
        return self.size

    def line_before(self, a: int, mark: str) -> int:
        """The begin of the last line before ``a`` that begins with ``mark``, else the file's begin."""
        sign = (self.newline + mark.encode(self.encoding), mark.encode(self.encoding))
        end = a
        while end > self.skip:
            begin = max(self.skip, end - CHUNK)
            part = self.at(begin, end - begin + len(sign[0]))
            k = part.rfind(sign[0], 0, end - begin + len(self.newline))
            while k >= 0 and (begin + k - self.skip) % self.width:
                k = part.rfind(sign[0], 0, k + len(sign[0]) - 1)
            if k >= 0 and begin + k + self.width < a:
                return begin + k + self.width
            end = begin
        return self.skip

    def lines(self, a: int) -> Iterator[tuple[int, str]]:
        """(place, line) from a line's begin on, to the file's end."""
        at, rest = a, b""
        while True:
            part = self.at(at + len(rest), CHUNK)
            buf = rest + part
            begin = 0
            k = buf.find(self.newline)
            while k >= 0:
                if k % self.width:
                    k = buf.find(self.newline, k + 1)
                    continue
                yield at + begin, self.text(buf[begin:k]).rstrip("\r")
                begin = k + self.width
                k = buf.find(self.newline, begin)
            at, rest = at + begin, buf[begin:]
            if not part:
                if rest:
                    yield at, self.text(rest).rstrip("\r")
                return


Record = tuple[int, str, str | None]


def _lines(src: Bytes, a: int, b: int) -> Iterator[Record]:
    for pos, line in src.lines(src.line_begin(a)):
        if pos >= b:
            return
        yield pos, line, None


def _blocks(src: Bytes, a: int, b: int) -> Iterator[Record]:
    begin, blank = src.line_begin(a), True
    if begin > src.skip:
        # Whether the line before is blank: walk back over it as far as it is.
        end, seen = begin - src.width, b""
        while end > src.skip and not src.text(seen).strip() and "\n" not in src.text(seen):
            step = max(src.skip, end - 4096)
            seen, end = src.at(step, begin - src.width - step), step
        blank = not src.text(seen).rpartition("\n")[2].strip()
    held: list[str] = []
    at = begin
    for pos, line in src.lines(begin):
        if not line.strip():
            if held:
                yield at, "\n".join(held), None
            held, blank = [], True
            if pos >= b:
                return
        elif held:
            held.append(line)
        elif blank:
            if pos >= b:
                return
            held, at, blank = [line], pos, False
        elif pos >= b:
            return
    if held:
        yield at, "\n".join(held), None


def _registry(src: Bytes, a: int, b: int) -> Iterator[Record]:
    key, held, at = None, "", 0
    begin = src.line_before(a, "[") if a > src.skip else src.skip
    while begin > src.skip and not next(src.lines(begin))[1].rstrip().endswith("]"):
        begin = src.line_before(begin, "[")
    for pos, line in src.lines(begin):
        if held and line.startswith("["):  # a key never continues a value
            if at >= a:
                yield at, held, key
            held = ""
        if held:
            held += line.strip()
        else:
            if pos >= b:
                return
            at, held = pos, line
        if held.endswith(",\\"):
            held = held[:-1]
            continue
        line, held = held, ""
        if line.startswith("[") and line.rstrip().endswith("]"):
            key = line.rstrip()[1:-1].removeprefix("-")
        elif at >= a and line.strip():
            yield at, line, key
    if held and at >= a:
        yield at, held, key


LAYOUTS = {"lines": _lines, "blocks": _blocks, "registry": _registry}


class _Unpacked:
    """The lines of a compressed file, which can only be read from its begin."""

    skip, width = 0, 1

    def __init__(self, path: str):
        where, base = _open_fs(path)
        self._file = gzip.GzipFile(fileobj=where.open_input_stream(base, compression=None))

    text = Bytes.text
    encoding = "utf-8"

    def line_begin(self, a: int) -> int:
        return 0

    def line_before(self, a: int, mark: str) -> int:
        return 0

    def lines(self, a: int) -> Iterator[tuple[int, str]]:
        at = 0
        for line in self._file:
            yield at, self.text(line.removeprefix(codecs.BOM_UTF8) if not at else line).rstrip("\r\n")
            at += len(line)


def _batches(rows: Iterator[tuple], modified: int | None = None, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    chars = 0
    for r in rows:
        held.append((*r, modified))
        chars += len(r[2] or "")
        if len(held) >= size or chars > CHUNK:
            yield pa.RecordBatch.from_pylist([dict(zip(_ROWS.names, x, strict=True)) for x in held], schema=_ROWS)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(_ROWS.names, x, strict=True)) for x in held], schema=_ROWS)


def read_range(path: str, a: int, b: int, layout: str) -> Iterator[tuple]:
    """The rows of one range; what breaks is the last row, with its reason."""
    pos = a
    try:
        packed = path.endswith(".gz")
        src = _Unpacked(path) if packed else Bytes(path)
        for pos, text, context in LAYOUTS[layout](src, a, b):
            yield path, pos, text, context, None
    except _BROKEN as e:
        yield path, pos, None, None, f"{type(e).__name__}: {e}"[:200]


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, modified: int | None):
        self.path, self.begin, self.end, self.modified = path, begin, end, modified


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layout = options["path"].split("\n"), options.get("layout", "lines")
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        if self.layout not in LAYOUTS:
            raise ValueError(f"a layout is one of {', '.join(LAYOUTS)}")

    def partitions(self) -> list[InputPartition]:
        return [_Range(*r) for r in ranges(files_under(self.path), self.split)]

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # none: there are no files
            yield from _batches(read_range(partition.path, partition.begin, partition.end, self.layout), partition.modified)


class SplitSource(DataSource):
    """``spark.read.format("loglattice_splits").option("layout", ...).load(path)`` once it is registered."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def split_rows(spark: SparkSession, path: str | list[str], layout: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, pos, text, context, reason, modified) of files or folders, read in ranges."""
    spark.dataSource.register(SplitSource)
    return spark.read.format(NAME).option("layout", layout).option("splitBytes", split_bytes).load(path if isinstance(path, str) else "\n".join(path))


# JSON documents.

_QUOTE, _BACK, _OPEN, _CLOSE = 34, 92, (91, 123), (93, 125)
_STATE = pa.schema([("file", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("base", pa.int32()), ("quotes", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64()), ("reason", pa.string()), ("modified", pa.int64())])
HEAD = 1 << 16


def _marks(raw: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each byte is a quote that begins or ends a string; the parity of quotes before it; 1 for opening, -1 for closing brackets."""
    buf = np.frombuffer(raw, dtype=np.uint8)
    back = buf == _BACK
    # A byte is escaped if an odd run of backslashes ends before it.
    place = np.arange(len(buf))
    other = np.maximum.accumulate(np.where(~back, place, -1))
    run = place - other  # length of the run of backslashes that ends here
    if escaped and len(buf):
        lead = int(np.argmin(back)) if not back.all() else len(buf)
        run[:lead] += 1
    odd = run % 2 == 1
    quote = buf == _QUOTE
    quote[1:] &= ~(odd[:-1] & back[:-1])
    if len(buf) and escaped:
        quote[0] = False
    before = np.cumsum(quote) - quote
    step = np.zeros(len(buf), dtype=np.int64)
    step[np.isin(buf, _OPEN)] = 1
    step[np.isin(buf, _CLOSE)] = -1
    return quote, before % 2, step


def _escaped_at(src: Bytes, a: int) -> bool:
    """Whether an odd run of backslashes ends just before ``a``."""
    n = 0
    while a - n > 0:
        part = src.at(max(0, a - n - 256), min(256, a - n))
        tail = len(part) - len(part.rstrip(b"\\"))
        n += tail
        if tail < len(part):
            break
    return n % 2 == 1


def base_depth(head: str) -> int:
    """How deep the wanted objects lie: 0 for objects one after the other, 1 in an array, 2 in the list under ``Data``."""
    text = head.lstrip("﻿ \t\r\n")
    if text.startswith("["):
        return 1
    depth, k, string, key = 0, 0, False, ""
    while k < len(text):  # a few bytes: up to a Data list or the end of the head
        c = text[k]
        if string:
            if c == "\\":
                k += 1
            elif c == '"':
                string, key = False, text[start:k]
        elif c == '"':
            string, start = True, k + 1
        elif c in "{[":
            if c == "[" and depth == 1 and key.lower() == "data":
                return 2
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return 0
        k += 1
    return 0


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            out = r | {"base": 0, "quotes": 0, "outside": 0, "inside": 0, "reason": None}
            try:
                src = Bytes(r["file"])
                out["base"] = base_depth(src.text(src.at(src.skip, HEAD)))
                at, escaped, parity, depth = r["a"], _escaped_at(src, r["a"]), 0, [0, 0]
                while at < r["b"]:
                    raw = src.at(at, min(CHUNK, r["b"] - at))
                    quote, before, step = _marks(raw, escaped)
                    inside = (before + parity) % 2 == 1
                    depth[0] += int(step[~inside].sum())
                    depth[1] += int(step[inside].sum())
                    parity = (parity + int(quote.sum())) % 2
                    at += len(raw)
                    escaped = _escaped_at(src, at)
                out |= {"quotes": parity, "outside": depth[0], "inside": depth[1]}
            except _BROKEN as e:
                out["reason"] = f"{type(e).__name__}: {e}"[:200]
            yield pa.RecordBatch.from_pylist([{k: out[k] for k in _STATE.names}], schema=_STATE)


def _objects(path: str, a: int, b: int, base: int, in_string: bool, depth: int) -> Iterator[tuple]:
    """The objects at depth ``base`` that begin in a range; one that the file's end cuts off is a reason."""
    src = Bytes(path)
    at, escaped, parity = max(a, src.skip if a == 0 else a), _escaped_at(src, a), int(in_string)
    begin, held = None, b""
    while at < src.size and (at < b or begin is not None):
        raw = src.at(at, CHUNK)
        quote, before, step = _marks(raw, escaped)
        buf = np.frombuffer(raw, dtype=np.uint8)
        outside = (before + parity) % 2 == 0
        level = depth + np.cumsum(np.where(outside, step, 0))
        opens = np.flatnonzero(outside & (buf == 123) & (level == base + 1))
        closes = np.flatnonzero(outside & (buf == 125) & (level == base))
        for kind, k in sorted([(0, int(k)) for k in opens] + [(1, int(k)) for k in closes], key=lambda x: x[1]):
            if kind == 0 and begin is None and at + k < b:
                begin, held, start = at + k, b"", k
            elif kind == 1 and begin is not None:
                held += raw[start if begin >= at else 0 : k + 1]
                yield path, begin, src.text(held), None, None
                begin = None
        if begin is not None:
            held += raw[begin - at :] if begin >= at else raw
        depth, parity = int(level[-1]), (parity + int(quote.sum())) % 2
        at += len(raw)
        escaped = _escaped_at(src, at)
    if begin is not None:
        yield path, begin, None, None, "an object that does not close"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(r: dict) -> Iterator[tuple]:
        if r["reason"]:
            yield r["file"], r["a"], None, None, r["reason"]
            return
        try:
            yield from _objects(r["file"], r["a"], r["b"], r["base"], r["in_string"], r["depth"])
        except _BROKEN as e:
            yield r["file"], r["a"], None, None, f"{type(e).__name__}: {e}"[:200]

    for batch in batches:
        for r in batch.to_pylist():
            yield from _batches(rows(r), r["modified"])


def json_elements(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, pos, text, context, reason, modified): the objects of JSON documents, each document read by many tasks.

    The two passes over a file's bytes need no memory of its size; what is put in order is a row a
    range, file by file.
    """
    parts = ranges([f for f in files_under(path) if not f[0].endswith(".gz")], split_bytes)
    table = spark.createDataFrame(parts, "file string, a bigint, b bigint, modified bigint").repartition(max(1, min(len(parts), 10_000)), "file", "a")
    scanned = table.mapInArrow(_scan, "file string, a bigint, b bigint, base int, quotes bigint, outside bigint, inside bigint, reason string, modified bigint")
    before = Window.partitionBy("file").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    known = scanned.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    known = known.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    dealt = known.select("file", "a", "b", "base", "in_string", "depth", "reason", "modified").repartition(max(1, min(len(parts), 10_000)), "file", "a")
    return dealt.mapInArrow(_cut, SCHEMA)


def _whole_object(line: str) -> bool:
    try:
        return isinstance(json.loads(line.removeprefix("@rawstring:")), dict)
    except ValueError:
        return False


def is_document(head: str) -> bool:
    """Whether a JSON file that begins so is a document: an array, a ``Data`` list, or an object none of whose lines is one."""
    text = head.lstrip("\ufeff \t\r\n")
    if text.startswith("[") or not text.startswith("{"):
        return text.startswith("[")
    return base_depth(text) == 2 or not any(_whole_object(line) for line in text.splitlines() if line.startswith(("{", "@")))


def documents(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Those JSON files that are documents and not lines of objects, by their first 64 KiB.  A row a file."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for name in batch.column("file").to_pylist():
                try:
                    src = Bytes(name)
                    kept += [name] if is_document(src.text(src.at(src.skip, HEAD))) else []
                except _BROKEN:
                    continue  # its lines' reader says why
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], ["file"])

    names = [f[0] for f in files_under(path) if not f[0].endswith(".gz")]
    table = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, min(len(names), 1000)), "file")
    return sorted(r.file for r in table.mapInArrow(look, "file string").collect())
