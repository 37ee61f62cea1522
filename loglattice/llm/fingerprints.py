"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph is a line.  Each is hashed to a wide vector, and a text's fingerprint is the sum of
its paragraphs' vectors, number by number, modulo a power of two.  So the order of paragraphs
does not matter, paragraphs are inserted by adding and deleted by subtracting their vectors, and
``fingerprint(a + "\\n" + b)`` is the sum of both.

The vector has two parts:

* ``EXACT`` = 8 numbers modulo 2**64, the BLAKE2b digest of the paragraph: sums are equal for
  equal multisets of paragraphs and, but for an accident of 2**-512, for no others;
* ``LANES`` = 256 numbers modulo 2**32, to which each run of three words of the paragraph (fewer
  where it has fewer) adds 1 or -1 in one place, both told by its hash.  The cosine of two such
  parts, taken as signed numbers, estimates that of the texts' word runs, with a deviation of
  1/16; this is the likeness of texts that are not equal.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.llm import textkit as tk

EXACT, LANES, RUN_WORDS = 8, 256, 3
#: Bytes of text that one sorted bucket should hold, and how many buckets there are at most; a bucket is streamed, never held.
BUCKET_BYTES, MAX_BUCKETS = 4 << 20, 10_000


class Prints:
    """The fingerprints of some texts: two arrays with a row a text."""

    def __init__(self, exact: np.ndarray, lanes: np.ndarray):
        self.exact, self.lanes = exact, lanes

    def __add__(self, other: Prints) -> Prints:
        return Prints(self.exact + other.exact, self.lanes + other.lanes)

    def __sub__(self, other: Prints) -> Prints:
        return Prints(self.exact - other.exact, self.lanes - other.lanes)

    def __len__(self) -> int:
        return len(self.exact)

    def rows(self, at) -> Prints:
        return Prints(self.exact[at], self.lanes[at])

    def to_bytes(self) -> list[bytes]:
        exact, lanes = self.exact.astype("<u8"), self.lanes.astype("<u4")
        return [a.tobytes() + b.tobytes() for a, b in zip(exact, lanes, strict=True)]

    def to_text(self) -> list[str]:
        return [base64.b64encode(b).decode() for b in self.to_bytes()]

    @staticmethod
    def of_text(values: list[str]) -> Prints:
        raw = np.frombuffer(b"".join(base64.b64decode(v) for v in values), dtype=np.uint8).reshape(len(values), 8 * EXACT + 4 * LANES)
        return Prints(np.ascontiguousarray(raw[:, : 8 * EXACT]).view("<u8").astype(np.uint64), np.ascontiguousarray(raw[:, 8 * EXACT :]).view("<u4").astype(np.uint32))


def paragraphs_of(texts: pa.Array) -> Prints:
    """The sum of the vectors of each text's paragraphs; a null text has none, an empty one has the empty paragraph."""
    n = len(texts)
    exact, lanes = np.zeros((n, EXACT), dtype=np.uint64), np.zeros((n, LANES), dtype=np.uint32)
    for a, b in tk.column_slices(texts):
        part = texts.slice(a, b - a)
        there = part.is_valid().to_numpy(zero_copy_only=False)
        buf, off = tk.text_bytes(part)
        # Rows of one text are parted by its line feeds only, so all lines are found at once.
        breaks = np.flatnonzero(buf == 10)
        start = np.sort(np.concatenate([breaks + 1, off[:-1][there]]), kind="stable")
        row = np.searchsorted(off, breaks, side="right") - 1
        rows = np.sort(np.concatenate([row, np.flatnonzero(there)]), kind="stable")
        # A line ends before the next line of its text, or where the text ends.
        last = np.append(rows[1:] != rows[:-1], True) if len(rows) else np.zeros(0, dtype=bool)
        end = np.where(last, off[rows + 1], np.append(start[1:], 0) - 1) if len(rows) else start
        view = memoryview(np.ascontiguousarray(buf))
        digest = np.frombuffer(b"".join(hashlib.blake2b(view[i:j], digest_size=8 * EXACT).digest() for i, j in zip(start.tolist(), end.tolist(), strict=True)), dtype="<u8")
        np.add.at(exact, a + rows, digest.reshape(-1, EXACT).astype(np.uint64))
        words, w_off = tk.word_hashes(buf, np.append(start, len(buf)) if len(start) and start[0] == 0 else np.concatenate([[0], start, [len(buf)]]))
        if len(start) and start[0] != 0:
            w_off = w_off[1:]
        runs, r_off = tk.shingle_hashes(words, w_off, RUN_WORDS) if len(start) else (np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64))
        owner = np.repeat(rows, np.diff(r_off))
        place = owner * LANES + (runs & np.uint64(LANES - 1)).astype(np.int64)
        sign = np.where(runs >> np.uint64(63), 1.0, -1.0)
        lanes[a:b] = np.bincount(place, weights=sign, minlength=(b - a) * LANES).reshape(b - a, LANES).astype(np.int64).astype(np.uint32)
    return Prints(exact, lanes)


def likeness(x: Prints, y: Prints) -> np.ndarray:
    """Row by row, 1 for equal fingerprints, else the cosine of their second parts, 0 where that is less or one is all zero."""
    a, b = (p.lanes.astype(np.int32).astype(np.float64) for p in (x, y))
    size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    cosine = np.divide((a * b).sum(axis=1), size, out=np.zeros(len(x)), where=size > 0)
    same = (x.exact == y.exact).all(axis=1) & (x.lanes == y.lanes).all(axis=1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def _printer(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            prints = paragraphs_of(text.fill_null(""))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.to_text())], [*batch.schema.names, "print"])

    return run


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, a column of that name replaced; null texts count as empty, equal texts are alike."""
    p = tk.fresh(docs)
    made = tk.map_arrow(docs, _printer(docs.columns.index(text_col)), tk.schema_with(docs, f"{p}print", "string"))
    return tk.with_outputs(made, fingerprint=F.col(f"{p}print")).drop(f"{p}print")


def changed(prints: DataFrame, inserted: DataFrame, deleted: DataFrame, id_col: str = "doc_id", text_col: str = "paragraph") -> DataFrame:
    """Fingerprints (id_col, fingerprint) after paragraphs were inserted into and deleted from their documents.

    ``inserted`` and ``deleted`` have (id_col, text_col); only these are hashed, summed by document
    in partial sums of the partitions, and added or subtracted.  Documents without changes keep
    their fingerprint, ids that ``prints`` lacks are left out, and a null paragraph is an empty one.
    """
    rows = inserted.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.lit(1).alias("sign")).unionByName(deleted.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.lit(-1).alias("sign")))
    partial = tk.map_arrow(rows, _partial_sums(), T.StructType([rows.schema["id"], T.StructField("change", T.StringType(), False)]))
    moves = partial.select("id", F.col("change").alias("p")).unionByName(prints.select(F.col(id_col).alias("id"), F.col("fingerprint").alias("p")).withColumn("base", F.lit(True)), allowMissingColumns=True)

    out = moves.groupBy("id").applyInArrow(_total, T.StructType([rows.schema["id"], T.StructField("fingerprint", T.StringType())]))
    return out.withColumnRenamed("id", id_col)


def _total(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of one document's fingerprint and its changes, if it has a fingerprint."""
    exact, lanes, known = np.zeros(EXACT, dtype=np.uint64), np.zeros(LANES, dtype=np.uint32), False
    for part in parts:
        found = Prints.of_text(part.column("p").to_pylist())
        exact, lanes = exact + found.exact.sum(axis=0, dtype=np.uint64), lanes + found.lanes.sum(axis=0, dtype=np.uint32)
        known = known or any(part.column("base").to_pylist())
    if known:
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], key[0].type), pa.array(Prints(exact[None], lanes[None]).to_text())], ["id", "fingerprint"])


def _partial_sums():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = paragraphs_of(batch.column("t").fill_null(""))
            sign = batch.column("sign").to_numpy()
            ids = batch.column("id").dictionary_encode(null_encoding="encode")
            code, n = ids.indices.to_numpy(), len(ids.dictionary)
            exact, lanes = np.zeros((n, EXACT), dtype=np.uint64), np.zeros((n, LANES), dtype=np.uint32)
            np.add.at(exact, code, np.where(sign[:, None] > 0, prints.exact, -prints.exact))
            np.add.at(lanes, code, np.where(sign[:, None] > 0, prints.lanes, -prints.lanes))
            yield pa.RecordBatch.from_arrays([ids.dictionary, pa.array(Prints(exact, lanes).to_text())], ["id", "change"])

    return run


# Texts and their neighbours.  The order is total but for rows equal in id and text, which are alike.


def _order(p: str) -> list[Column]:
    return [F.col(f"{p}id").desc_nulls_last(), F.col(f"{p}hash").desc()]


def _bounds(keys: DataFrame, n_bytes: int) -> list[tuple[int | None, int]]:
    """The first key of each of some buckets of about the same size, in descending order."""
    n = max(1, min(MAX_BUCKETS, -(-n_bytes // BUCKET_BYTES)))
    if n == 1:
        return []
    parts = keys.select("id", "hash").repartitionByRange(n, F.col("id").desc_nulls_last(), F.col("hash").desc())
    firsts = parts.groupBy(F.spark_partition_id().alias("part")).agg(F.max(F.struct("id", "hash")).alias("key")).select("key.id", "key.hash").collect()  # a row a bucket
    found = sorted({(r.id, r.hash) for r in firsts}, key=lambda k: (k[0] is not None, k[0] or 0, k[1]), reverse=True)
    return found[1:]


def _bucket(bounds: list[tuple[int | None, int]], key: Column) -> Column:
    """How many bounds a key is at or behind; two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    lit = lambda k: F.struct(F.lit(k[0]).cast("bigint").alias("id"), F.lit(k[1]).cast("bigint").alias("hash"))
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    heads, table = F.array(*[lit(b[0]) for b in blocks]), F.array(*[F.array(*map(lit, b)) for b in blocks])
    passed = F.size(F.filter(heads, lambda b: b >= key))
    inner = F.size(F.filter(F.element_at(table, F.greatest(passed, F.lit(1))), lambda b: b >= key))
    return F.when(passed == 0, 0).otherwise((passed - 1) * step + inner)


def _neighbours(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(bucket, guest, id, hash, text): all rows, and after each bucket the first row of the next as its guest; and the number of buckets."""
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    rows = docs.select(docs[f"`{id_col}`"].cast("bigint").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    keys = tk.stored(rows.select("id", "hash", F.octet_length("text").alias("size")), "fingerprint-keys")
    total = keys.agg(F.sum("size").alias("s")).first()["s"] or 0
    bounds = _bounds(keys, total)
    key = F.struct("id", "hash")
    placed = rows.withColumn("bucket", _bucket(bounds, key))
    top = keys.agg(F.max(key).alias("key")).first()["key"]
    if top is None:
        return placed.withColumn("guest", F.lit(False)), 1
    firsts = [(top["id"], top["hash"]), *bounds]
    # The bucket before the first is the last: its successor is the row that the order begins with.
    heads = [(len(firsts) - 1 if k == 0 else k - 1, i, h) for k, (i, h) in enumerate(firsts)]
    near = docs.sparkSession.createDataFrame(heads, "to_bucket int, head_id bigint, head_hash bigint")  # a row a bucket, MAX_BUCKETS at most
    guests = rows.join(F.broadcast(near), rows["id"].eqNullSafe(near["head_id"]) & (rows["hash"] == near["head_hash"]))
    guests = guests.select("id", "hash", "text", F.col("to_bucket").alias("bucket")).dropDuplicates(["bucket"])
    return placed.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True))), len(firsts)


_EDITED = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
EDITED_SCHEMA = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit(texts: list[str], following: list[str]) -> tuple[list[str], list[str | None], list[str], list[str]]:
    """Each text with its second half replaced by the beginning of the next.

    Returns the edited texts; and what they have in common with the texts by whole lines (None
    where that is nothing), and what follows it in the text and in the edited text.
    """
    edited, common, old, new = [], [], [], []
    for text, after in zip(texts, following, strict=True):
        half = len(text) // 2
        kept = text[: len(text) - half]
        now = kept + after[:half]
        cut = kept.rfind("\n")
        edited.append(now)
        common.append(kept[:cut] if cut >= 0 else None)
        old.append(text[cut + 1 :])
        new.append(now[cut + 1 :])
    return edited, common, old, new


def _rows_of(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """The results of some texts whose next documents are given; only lines that an edit touches are hashed anew."""
    edited, common, old, new = edit(texts, following)
    strings = lambda x: pa.array(x, pa.large_string())
    same = paragraphs_of(strings(common))
    own, now = same + paragraphs_of(strings(old)), same + paragraphs_of(strings(new))
    # The last text's next is another one's first; all others' are among the texts themselves.
    rest = paragraphs_of(strings(following[-1:]))
    after = Prints(np.concatenate([own.exact[1:], rest.exact]), np.concatenate([own.lanes[1:], rest.lanes]))
    digest = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    columns = [ids, [len(t) for t in texts], digest, own.to_text(), now.to_text(), likeness(own, now), likeness(own, after)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EDITED, strict=True)], schema=_EDITED)


SLICE_CHARS = 1 << 20


def _stream():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, bucket = [], [], None  # rows of one bucket that wait for their next document
        size = 0
        for batch in batches:
            for row, (b, i, text) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("id").to_pylist(), batch.column("text"), strict=True)):
                text = text.as_py()
                if b != bucket:
                    ids, texts, size, bucket = [], [], 0, b  # what waits is the guest of the bucket before
                ids.append(i)
                texts.append(text)
                size += len(text)
                if len(texts) > 1 and (size > SLICE_CHARS or len(texts) > 2000):
                    yield _rows_of(ids[:-1], texts[:-1], texts[1:])
                    ids, texts, size = ids[-1:], texts[-1:], len(text)
                elif batch.column("guest")[row].as_py() and len(texts) > 1:
                    yield _rows_of(ids[:-1], texts[:-1], texts[1:])
                    ids, texts, size = ids[-1:], texts[-1:], len(text)

    return run


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is the next one by descending id; the last one's next is the first.  Null
    ids come last; rows of one id are ordered by a hash of their text, and rows equal in both are
    each other's next.  A single row is its own next.  Null texts count as empty; an empty table
    gives an empty one.  Texts are shuffled once, into buckets that are streamed in order; the
    first row of each bucket is also sent to the bucket before.
    """
    near, n = _neighbours(docs, id_col, text_col)
    ordered = near.repartitionById(n, "bucket").sortWithinPartitions("bucket", "guest", F.col("id").desc_nulls_last(), F.col("hash").desc())
    return tk.map_arrow(ordered, _stream(), EDITED_SCHEMA)
