"""Real values replaced by pseudonyms in all text columns of a table, in one pass over each text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.storage import stored

#: Up to so many values and bytes a mapping becomes one pattern, which goes out with the plan.
MAX_VALUES, MAX_BYTES = 20_000, 1 << 20
_SPECIAL = set("\\^$.|?*+()[]{}-&~# \t\n\r\f\v")


def _plain(c: str) -> str:
    return "\\" + c if c in _SPECIAL and c > " " else f"\\x{{{ord(c):x}}}" if c <= " " else c


def trie_pattern(values: list[str]) -> str:
    """A pattern of some values that shares their beginnings and takes the longest that fits."""
    root: dict = {}
    for v in values:
        at = root
        for c in v:
            at = at.setdefault(c, {})
        at[""] = {}

    def build(node: dict) -> str:
        parts = [_plain(c) + build(child) for c, child in node.items() if c]
        body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
        if not parts:
            return ""
        return f"(?:{body})?" if "" in node else body

    # Chains without branches are joined by build itself; recursion is as deep as the longest value.
    return build(root)


def replaced(text: Column, mapping: dict[str, str]) -> Column:
    """A text with every value of ``mapping`` replaced: longest first, ignoring case, nothing twice."""
    low = {k.lower(): v for k, v in mapping.items() if k}
    if not low:
        return text
    pattern = "(?iu)" + trie_pattern(sorted(low))
    names = F.create_map(*[F.lit(x) for kv in low.items() for x in kv])
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    swapped = F.transform(found, lambda m: F.coalesce(F.try_element_at(names, F.lower(m)), m))
    # A part before each match, and what is after the last one.
    joined = F.array_join(F.zip_with(between, swapped, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def _walk(c: Column, kind: T.DataType, change: Callable[[Column], Column]) -> Column:
    if isinstance(kind, T.StringType):
        return change(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _walk(x, kind.elementType, change))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_walk(c.getField(f.name), f.dataType, change).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        values = F.transform_values(c, lambda _, v: _walk(v, kind.valueType, change))
        return F.transform_keys(values, lambda k, _: _walk(k, kind.keyType, change)) if isinstance(kind.keyType, T.StringType) else values
    return c


def _texts(c: Column, kind: T.DataType) -> Column | None:
    """All texts that ``_walk`` comes to in a value, as an array; None if there can be none."""
    if isinstance(kind, T.StringType):
        return F.array(c)
    if isinstance(kind, T.ArrayType):
        if _texts(c, kind.elementType) is None:
            return None
        return F.coalesce(F.flatten(F.transform(c, lambda x: _texts(x, kind.elementType))), F.array().cast("array<string>"))
    if isinstance(kind, T.StructType):
        parts = [p for f in kind.fields if (p := _texts(c.getField(f.name), f.dataType)) is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.MapType):
        values = _texts(F.map_values(c), T.ArrayType(kind.valueType))
        keys = _texts(F.map_keys(c), T.ArrayType(kind.keyType)) if isinstance(kind.keyType, T.StringType) else None
        parts = [p for p in (keys, values) if p is not None]
        return F.concat(*parts) if parts else None
    return None


def _listed(mapping: DataFrame) -> DataFrame:
    """(real, pseudonym): a row per value in lower case."""
    return mapping.select(F.lower(F.trim("real")).alias("real"), F.coalesce("pseudonym", F.lit("")).alias("pseudonym")).filter("real <> ''").groupBy("real").agg(F.min("pseudonym").alias("pseudonym"))


def _size(rows: DataFrame) -> tuple[int, int]:
    return tuple(rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("real") + F.octet_length("pseudonym")), F.lit(0))).first())


def redact_table(df: DataFrame, mapping: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``df`` with the values of ``mapping`` (real, pseudonym) replaced in its text columns, nested ones too.

    The mapping's size is measured first: one of more than ``MAX_VALUES`` values or ``MAX_BYTES``
    bytes is refused.  Blank values are left out; of a value that is listed twice in any case the
    least pseudonym holds.  Nulls stay.
    """
    rows = _listed(mapping)
    n, size = _size(rows)
    if n > MAX_VALUES or size > MAX_BYTES:
        raise ValueError(f"a mapping of {n} values and {size} bytes is too large for one pattern")
    known = {r.real: r.pseudonym for r in rows.collect()}
    chosen = set(columns or df.columns)
    return df.select(*[_walk(df[f"`{f.name}`"], f.dataType, lambda t: replaced(t, known)).alias(f.name) if f.name in chosen else df[f"`{f.name}`"] for f in df.schema.fields])


#: Bits of the map of values that may be there: 8 megabytes, whatever the number of values; a full one only makes a run slower.
MAP_BITS = 26
#: Bytes of text and rows of a block; a single text may be longer.
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 8192
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _lower(text: str) -> str:
    """A text in lower case, with as many characters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _places(low: str, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Two places in the map of every run of some sizes, in ascending order; each size goes on from the one before."""
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    h = np.zeros(len(code), dtype=np.uint64)
    done = 0
    for size in sizes:
        n = len(code) - size + 1
        if n <= 0:
            return
        h = h[:n]
        for k in range(done, size):
            h = (h ^ code[k : k + n]) * _BASE + np.uint64(1)
            h ^= h >> np.uint64(29)
        done = size
        yield size, (h >> np.uint64(64 - MAP_BITS)).astype(np.int64), (h & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.unique(np.concatenate([np.zeros(0, np.int64), *(p for v in batch.column(0).to_pylist() for _, *both in _places(v, [len(v)]) for p in both)]))
        yield pa.RecordBatch.from_arrays([pa.array(found >> 12), pa.array(found & 4095)], ["page", "bit"])


def _page(key: tuple, table: pa.Table) -> pa.Table:
    bits = np.zeros(4096, dtype=bool)
    bits[table.column("bit").to_numpy()] = True
    return pa.table({"page": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _candidates(bits, sizes: list[int]):
    """(block, piece): the distinct runs of a block's texts that the map lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = bits.value
        has = lambda place: there[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1
        for batch in batches:
            blocks, pieces = [], []
            column = batch.column("texts").to_pylist()
            found: dict[int, list[str]] = {}
            for block, texts in zip(batch.column("block").to_pylist(), column, strict=True):
                found.setdefault(block, []).extend(texts)
            for block, texts in found.items():
                low = "\0".join(map(_lower, dict.fromkeys(texts)))  # a run across two texts is looked up for nothing
                own: set[str] = set()
                for size, one, two in _places(low, sizes):
                    own.update(low[k : k + size] for k in np.flatnonzero(has(one) & has(two)).tolist())
                blocks += [block] * len(own)
                pieces += own
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(pieces, pa.string())], ["block", "piece"])

    return run


def replaced_plainly(text: str, known: dict[str, str], sizes: dict[str, list[int]]) -> str:
    """``replaced`` for one text; ``sizes`` are the lengths of the values by their first character, longest first."""
    low, out, k, kept = _lower(text), [], 0, 0
    while k < len(low):
        hit = next((n for n in sizes.get(low[k], ()) if low[k : k + n] in known), 0)  # a run cut short by the end has a shorter size, too
        if hit := min(hit, len(low) - k):
            out += text[kept:k], known[low[k : k + hit]]
            kept = k + hit
        k += hit or 1
    return "".join(out) + text[kept:]


def _changes(texts: pa.Table, names: pa.Table) -> pa.Table:
    known = dict(zip(names.column("piece").to_pylist(), names.column("pseudonym").to_pylist(), strict=True))
    lengths: dict[str, set[int]] = {}
    for k in known:
        lengths.setdefault(k[0], set()).add(len(k))
    sizes = {c: sorted(n, reverse=True) for c, n in lengths.items()}
    made: dict[str, str] = {}
    rows, changed = [], []
    for row, own in zip(texts.column("row").to_pylist(), texts.column("texts").to_pylist(), strict=True):
        for t in own:
            if t not in made:
                made[t] = replaced_plainly(t, known, sizes)
        if pairs := [(t, made[t]) for t in own if made[t] != t]:
            rows.append(row)
            changed.append(pairs)
    return pa.table({"row": pa.array(rows, pa.int64()), "changed": pa.array(changed, pa.map_(pa.string(), pa.string()))})


def redact_joined(df: DataFrame, mapping: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``redact_table`` for a mapping of any size, which is joined and never held as a whole.

    The rows are stored in blocks.  Runs of a block's texts that are as long as some value and that
    a bit map of fixed size lets through are joined with the mapping, once a block however often they
    come; each block then gets the values that lie in it, and its texts are replaced by these.
    """
    spark = df.sparkSession
    listed = stored(_listed(mapping), "redaction")
    sizes = sorted(r.n for r in listed.select(F.char_length("real").alias("n")).distinct().collect())
    chosen = set(columns or df.columns)
    lists = [t for f in df.schema.fields if f.name in chosen and (t := _texts(df[f"`{f.name}`"], f.dataType)) is not None]
    if not sizes or not lists:
        return df
    texts = F.array_distinct(F.filter(F.concat(*lists), lambda t: t.isNotNull() & (t != "")))
    plain = [f"c{k}" for k in range(len(df.columns))]
    held = stored(df.select(F.monotonically_increasing_id().alias("row"), texts.alias("texts"), *[df[f"`{c}`"].alias(p) for c, p in zip(df.columns, plain, strict=True)]), "redaction")
    length = F.aggregate("texts", F.lit(0).cast("bigint"), lambda a, t: a + F.octet_length(t))
    n, size = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first()
    per = max(1, min(BLOCK_ROWS, BLOCK_BYTES * n // max(size, 1)))
    own = held.select(F.expr(f"row div {per}").alias("block"), "row", "texts")

    bits = np.zeros(1 << MAP_BITS - 3, dtype=np.uint8)
    pages = listed.select("real").mapInArrow(_marks, "page bigint, bit bigint").distinct().groupBy("page").applyInArrow(_page, "page bigint, bits binary")
    for r in pages.collect():  # fixed size
        bits[r.page * 512 : r.page * 512 + 512] = np.frombuffer(r.bits, dtype=np.uint8)
    sent = spark.sparkContext.broadcast(bits)
    pieces = own.select("block", "texts").mapInArrow(_candidates(sent, sizes), "block bigint, piece string")
    names = pieces.distinct().join(listed.withColumnRenamed("real", "piece"), "piece")
    changes = own.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(_changes, "row bigint, changed map<string,string>")
    back = held.join(changes, "row", "left")
    change = lambda t: F.coalesce(F.try_element_at("changed", t), t)
    return back.select(*[(_walk(F.col(p), f.dataType, change) if f.name in chosen else F.col(p)).alias(f.name) for p, f in zip(plain, df.schema.fields, strict=True)])


def redact(df: DataFrame, mapping: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The values of a mapping replaced: by one pattern if it is small, else by a join."""
    n, size = _size(_listed(mapping))
    return (redact_joined if n > MAX_VALUES or size > MAX_BYTES else redact_table)(df, mapping, columns)
