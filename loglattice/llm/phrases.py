"""Phrase mining by hierarchical pair naming.

Texts become sequences of word ids, and a phrase of k words is named by the pair of the two
phrases of k - 1 words that overlap in it: its left part lacks the last word, its right part the
first.  Level by level, adjacent names are replaced by the name of their pair if that pair is
frequent, so a level only looks at places where both parts are.  A name keeps its two parts, so
the same tables answer which counts a cut needs and which phrases lie inside another.

Work is done in blocks, some megabytes of texts of one language.  A block's distinct pairs with
their counts are what is shuffled; all blocks' rows of a pair meet, are summed, and the least
(block, code) among them becomes the pair's id, unique without any numbering step.  Frequent
names then go back to the blocks that hold them, packed.  Sequences and names are bucketed by
block, so they are joined where they lie and a sequence is never shuffled.  All counts are exact,
and ids are compared, never hashes.

Before that, the blocks' pairs are counted by bucket of a hash, packed.  A pair comes no more often
than its bucket, so pairs of buckets that do not come often enough are left out of the shuffle and of
the next sequence; whatever else shares a bucket with others only is told apart by the exact counts.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm import textkit as tk

MIN_COUNT, MAX_WORDS, TOP, COVER = 30, 4, 2000, 80
SCALE = 2_000_000
#: Bytes of a block, and of all texts that wait in a task for their blocks to fill.
BLOCK_BYTES, WAIT_BYTES = 8 << 20, 24 << 20
#: A name is block * 2**CODE_BITS + code; a task's n-th block is its partition * 2**TASK_BITS + n.
CODE_BITS, TASK_BITS = 30, 13
#: Pairs are counted in 2**BUCKET_BITS buckets, of which a task sums 2**RANGE_BITS at a time.
BUCKET_BITS, RANGE_BITS = 28, 20
#: Buckets of min_count // SLACK and more are let through.  Any floor up to min_count is exact; at min_count itself
#: the rows that pass grow 14-fold for five times the text (few pairs reach it in little text), at a fifth 10-fold.
SLACK = 5
#: Rows of names that a task packs at a time.
NAME_ROWS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?"]] = True
_BREAK[10:14] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True

_BLOCKS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("lang", pa.string()), ("seq", pa.binary()), ("code", pa.int32()), ("word", pa.string()), ("count", pa.int64())])
BLOCKS = "kind int, block bigint, lang string, seq binary, code int, word string, count bigint"
_PAIRS = pa.schema([("own", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("count", pa.int64())])
PAIRS = "own bigint, left bigint, right bigint, count bigint"
_SEQUENCES = pa.schema([("block", pa.int64()), ("seq", pa.binary())])
SEQUENCES = "block bigint, seq binary"
_TALLIES = pa.schema([("part", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])
TALLIES = "part int, places binary, counts binary"
_OFTEN = pa.schema([("part", pa.int32()), ("bits", pa.binary())])
OFTEN = "part int, bits binary"
_HELD = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("ids", pa.binary())])
HELD = "block bigint, codes binary, ids binary"
SEQUENCE, NAMES = 0, 1


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word in the bytes of some texts, and the number of the piece it lies in."""
    gap = _GAP[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    begins = ~gap
    begins[1:] &= gap[:-1] | edge[1:-1]
    ends = ~gap
    ends[:-1] &= gap[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    border = np.concatenate([np.flatnonzero(_BREAK[buf]), off[1:-1]])
    border.sort()
    return start, end, np.searchsorted(border, start, side="right")


def distinct_runs(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct run first stands, every run's number among these, and their counts; runs are equal only byte by byte."""
    _, first, code, count = np.unique(tk.run_hashes(buf, start, end), return_index=True, return_inverse=True, return_counts=True)
    size = end - start
    same = size == size[first][code]
    same &= tk.same_runs(buf, start, buf, start[first][code], np.where(same, size, 0))
    if not same.all():  # two runs with one hash
        known: dict[bytes, int] = {}
        code = np.fromiter((known.setdefault(buf[a:b].tobytes(), len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)), dtype=np.int64, count=len(start))
        _, first, count = np.unique(code, return_index=True, return_counts=True)
    return first, code, count


def squeezed(seq: np.ndarray) -> np.ndarray:
    """The sequence with runs of -1 made one, and none at its ends."""
    there = seq >= 0
    keep = there.copy()
    keep[1:] |= there[:-1]
    out = seq[keep]
    return out[:-1] if len(out) and out[-1] < 0 else out


def packed(numbers: np.ndarray, kind: str = "<i4") -> bytes:
    """Numbers of 32 bits, or of another kind, compressed: the lowest bytes of all, then the next ones, as the high bytes are much alike."""
    numbers = numbers.astype(kind)
    return zstandard.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes())


def unpacked(data: bytes | memoryview, kind: str = "<i4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _reader():
    def block(number: int, lang: str, texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        buf, off = tk.text_bytes(pa.concat_arrays(texts))
        buf = _LOWER[buf]
        start, end, piece = words_of(buf, off)
        if not len(start):
            return
        first, code, count = distinct_runs(buf, start, end)
        often = np.argsort(-count, kind="stable")  # frequent words have small codes, which pack well
        first, count = first[often], count[often]
        code = np.argsort(often)[code]
        new_piece = np.flatnonzero(piece[1:] != piece[:-1]) + 1
        seq = np.insert(code.astype("<i4"), new_piece, -1)
        raw = buf.tobytes()
        words = [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        n = len(words)
        yield pa.RecordBatch.from_arrays([pa.array([SEQUENCE], pa.int32()), pa.array([number]), pa.array([lang]), pa.array([packed(seq)]), *(pa.nulls(1, f.type) for f in list(_BLOCKS)[4:])], schema=_BLOCKS)
        columns = [np.full(n, NAMES, np.int32), np.full(n, number), [lang] * n, pa.nulls(n, pa.binary()), np.arange(n, dtype=np.int32), words, count]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCKS, strict=True)], schema=_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list] = {}
        size: dict[str, int] = {}
        base, n = TaskContext.get().partitionId() << TASK_BITS, 0

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal n
            if n >> TASK_BITS:
                raise ValueError("a partition has too many blocks: read it in more splits")
            n += 1
            del size[lang]
            yield from block(base + n - 1, lang, waiting.pop(lang))

        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            code = langs.indices.to_numpy()
            text = batch.column("text").cast(pa.large_string())
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = text.filter(pa.array(code == k))
                for a, b in tk.column_slices(own, BLOCK_BYTES):
                    part = own.slice(a, b - a)
                    waiting.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + part.nbytes
                    if size[lang] >= BLOCK_BYTES:
                        yield from flush(lang)
            while sum(size.values()) > WAIT_BYTES:
                yield from flush(max(size, key=size.get))
        for lang in list(waiting):
            yield from flush(lang)

    return run


def buckets_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The bucket in which each pair of names is counted."""
    return (tk.mix(tk.mix(left.astype(tk.U64)) + right.astype(tk.U64)) >> tk.U64(64 - BUCKET_BITS)).astype(np.int64)


def pairs_of(seq: np.ndarray, names: np.ndarray, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The next level's sequence, and the names on either side and count of each distinct pair.

    ``names`` has the name of each code, -1 for those that are not frequent; ``often`` a bit for
    each bucket, 0 where no pair of it is.
    """
    named = np.where(seq >= 0, names[seq], -1)
    both = (named[:-1] >= 0) & (named[1:] >= 0)
    wide = np.int64(len(names))
    key, code, count = np.unique(seq[:-1][both] * wide + seq[1:][both], return_inverse=True, return_counts=True)
    left, right = names[key // wide], names[key % wide]
    if often is not None:
        bucket = buckets_of(left, right)
        kept = (often[bucket >> 3] >> (bucket & 7) & 1).astype(bool)
        left, right, count = left[kept], right[kept], count[kept]
        code = np.where(kept, np.cumsum(kept) - 1, -1)[code]
    following = np.full(len(both), -1, dtype="<i4")
    following[both] = code
    return squeezed(following), left, right, count


def _leveled(batches: Iterator[pa.RecordBatch], often: np.ndarray | None = None) -> Iterator[tuple]:
    """Each block's number with what ``pairs_of`` makes of it."""
    for batch in batches:
        for row in range(batch.num_rows):
            seq = unpacked(batch.column("seq")[row].as_buffer()).astype(np.int64)
            known = batch.column("names")[row].values
            code, name = (known.field(k).to_numpy() for k in range(2))
            names = np.full(max(int(seq.max()), int(code.max())) + 2, -1, dtype=np.int64)
            names[code] = name
            following, left, right, count = pairs_of(seq, names, often)
            if len(count):
                yield batch.column("block")[row].as_py(), following, left, right, count


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names of each block's codes, packed: gaps between the codes, and ids."""

    def flush() -> pa.RecordBatch:
        own, name = (np.concatenate(x) for x in zip(*waiting, strict=True))
        order = np.argsort(own)
        own, name = own[order], name[order]
        block, code = own >> CODE_BITS, own & ((1 << CODE_BITS) - 1)
        start = np.flatnonzero(np.diff(block, prepend=-1))
        spans = list(zip(start.tolist(), [*start[1:].tolist(), len(block)], strict=True))
        columns = block[start], [packed(np.diff(code[a:b], prepend=0)) for a, b in spans], [packed(name[a:b], "<i8") for a, b in spans]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HELD, strict=True)], schema=_HELD)

    waiting, n = [], 0
    for batch in batches:
        waiting.append((batch.column("own").to_numpy(), batch.column("id").to_numpy()))
        n += batch.num_rows
        if n >= NAME_ROWS:
            yield flush()
            waiting, n = [], 0
    if n:
        yield flush()


def _opened(f: Callable) -> Callable:
    """``f`` over blocks whose names are packed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = batch.column("names")[row].values
                codes, ids = ([unpacked(x.as_buffer(), kind) for x in held.field(k)] for k, kind in enumerate(("<i4", "<i8")))
                names = pa.StructArray.from_arrays([pa.array(np.concatenate([np.cumsum(c, dtype=np.int64) for c in codes])), pa.array(np.concatenate(ids))], ["code", "id"])
                names = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(row, 1), batch.column("seq").slice(row, 1), names], ["block", "seq", "names"])

    return lambda batches: f(rows(batches))


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each block has each bucket, by range of buckets: gaps between the buckets, and counts."""
    for _, _, left, right, count in _leveled(batches):
        bucket = buckets_of(left, right)
        order = np.argsort(bucket)
        bucket = bucket[order]
        new = np.flatnonzero(np.diff(bucket, prepend=-1))
        bucket, count = bucket[new], np.add.reduceat(count[order], new)
        part, place = bucket >> RANGE_BITS, bucket & ((1 << RANGE_BITS) - 1)
        start = np.flatnonzero(np.diff(part, prepend=-1))
        spans = list(zip(start.tolist(), [*start[1:].tolist(), len(part)], strict=True))
        columns = part[start], [packed(np.diff(place[a:b], prepend=0)) for a, b in spans], [packed(count[a:b]) for a, b in spans]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TALLIES, strict=True)], schema=_TALLIES)


def _summed(floor: int):
    def bits(part: int, total: np.ndarray) -> pa.RecordBatch:
        often = zstandard.compress(np.packbits(total >= floor, bitorder="little").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([often])], schema=_OFTEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = -1, np.zeros(1 << RANGE_BITS, dtype=np.int64)
        for batch in batches:
            for row, part in enumerate(batch.column("part").to_pylist()):
                if part != now:
                    if now >= 0:
                        yield bits(now, total)
                        total[:] = 0
                    now = part
                place, count = (unpacked(batch.column(c)[row].as_buffer()) for c in ("places", "counts"))
                total[np.cumsum(place)] += count
        if now >= 0:
            yield bits(now, total)

    return run


def _often(blocks: DataFrame, floor: int) -> Broadcast:
    """The compressed bits of each range's buckets that come ``floor`` times in all blocks; 32 MB of bits at most, whatever the input."""
    tallies = tk.map_arrow(blocks, _opened(_tallies), TALLIES).repartition("part").sortWithinPartitions("part")
    return blocks.sparkSession.sparkContext.broadcast({r["part"]: bytes(r["bits"]) for r in tk.map_arrow(tallies, _summed(floor), OFTEN).collect()})


def _bits(often: Broadcast) -> np.ndarray:
    size = 1 << RANGE_BITS - 3
    out = np.zeros(1 << BUCKET_BITS - 3, dtype=np.uint8)
    for part, bits in often.value.items():
        out[part * size : (part + 1) * size] = np.frombuffer(zstandard.decompress(bits), dtype=np.uint8)
    return out


def _pairs(often: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, left, right, count in _leveled(batches, _bits(often)):
            own = np.arange(len(count), dtype=np.int64) + (number << CODE_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((own, left, right, count), _PAIRS, strict=True)], schema=_PAIRS)

    return run


def _sequences(often: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, following, *_ in _leveled(batches, _bits(often)):
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed(following)])], schema=_SEQUENCES)

    return run


def _table(path: str) -> str:
    return "_".join(path.split("/")[-3:]).replace("-", "_")


def _drop(scratch: tk.Scratch, path: str) -> None:
    """Delete a table of ``_bucketed``."""
    scratch.spark.sql(f"drop table if exists {_table(path)}")
    scratch.drop(path)


def _bucketed(scratch: tk.Scratch, df: DataFrame, path: str, *parts: str) -> DataFrame:
    """``df`` stored by bucket of its block: tables of as many buckets are joined without a shuffle."""
    table, n = _table(path), int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, "block")
    (out.partitionBy(*parts) if parts else out).saveAsTable(table)
    return scratch.spark.table(table)


def _kinds(scratch: tk.Scratch, df: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The sequences and the names of the blocks, from one pass over ``df``."""
    back = _bucketed(scratch, df, path, "kind")
    return back.filter(F.col("kind") == SEQUENCE).select("block", "seq"), back.filter(F.col("kind") == NAMES).drop("kind", "seq")


def _with_names(scratch: tk.Scratch, seq: DataFrame, found: DataFrame, path: str) -> DataFrame:
    """The sequences of the blocks, each with the names of its own codes that are frequent, packed."""
    held = tk.map_arrow(found.select("own", "id"), _held, HELD).groupBy("block").agg(F.collect_list(F.struct("codes", "ids")).alias("names"))
    return seq.join(_bucketed(scratch, held, path), "block")


def _frequent(names: DataFrame, key: list[str], min_count: int) -> DataFrame:
    """(own, key, id, f) of the names that come ``min_count`` times in all blocks.

    A name has one row a block, so what meets of it is a row for each of some megabytes of text.
    """
    meet = Window.partitionBy(*key)
    found = names.withColumns({"id": F.min("own").over(meet), "f": F.sum("count").over(meet)})
    return found.filter(F.col("f") >= min_count).select("own", *key, "id", "f")


def _dictionary(found: DataFrame) -> DataFrame:
    """A row per name: its first one."""
    return found.filter("id = own").drop("own")


def _forget(scratch: tk.Scratch) -> None:
    """Let Spark delete the shuffled files of jobs that are over: it does so when the driver collects its garbage."""
    gc.collect()
    scratch.spark._jvm.System.gc()


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, cover: int = COVER) -> DataFrame:
    """The first ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    A-Z are lower-cased; texts are split at ``.,;:!?`` and line breaks into pieces, and these at
    spaces and tabs into words.  Of all phrases of 2 to ``max_words`` words that come at least
    ``min_count`` times (a, overlaps included), each is cut where 2,000,000 a / (l + r), floored,
    is least, l and r being the counts of what is before and after the cut; of equal cuts the
    first counts.  A phrase inside a longer one that comes ``cover`` of a hundred times as often
    or more is left out.  n is the language's number of words.  Phrases are ordered by score, a
    and text, so there are no ties.  A null language counts as ``und``, a null text as empty;
    languages without a phrase have no row, and no other column of ``docs`` is looked at.
    """
    spark = docs.sparkSession
    scratch = tk.Scratch(spark, "phrases")
    rows = docs.select(F.coalesce(docs[f"`{lang_col}`"].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    path = scratch.path("words")
    seq, names = _kinds(scratch, tk.map_arrow(rows, _reader(), BLOCKS), path)
    total = scratch.put(names.groupBy("lang").agg(F.sum("count").alias("n")), "totals")
    words = names.select((F.col("block") * (1 << CODE_BITS) + F.col("code")).alias("own"), "lang", "word", "count")
    found = scratch.put(_frequent(words, ["lang", "word"], min_count), "level-1")
    scratch.drop(f"{path}/kind={NAMES}")
    levels = [_dictionary(found).select("id", "f", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails"))]
    for k in range(2, max_words + 1):
        _forget(scratch)
        done = path, scratch.path(f"names-{k - 1}")
        blocks = _with_names(scratch, seq, found, done[1])
        _forget(scratch)
        # Pairs go straight to where they meet; the sequence of the next level is made by another, cheap pass.
        often = _often(blocks, min_count // SLACK)
        _forget(scratch)
        found = scratch.put(_frequent(tk.map_arrow(blocks, _opened(_pairs(often)), PAIRS), ["left", "right"], min_count), f"level-{k}")
        if k < max_words:
            _forget(scratch)
            path = scratch.path(f"sequences-{k}")
            seq = _bucketed(scratch, tk.map_arrow(blocks, _opened(_sequences(often)), SEQUENCES), path)
        for old in done:
            _drop(scratch, old)
        often.destroy()
        # heads and tails: counts of the first and of the last 1, 2, ... words, up to the whole.
        part = levels[-1]
        left = part.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), "heads")
        right = part.select(F.col("id").alias("right"), "last", "tails")
        level = _dictionary(found).join(left, "left").join(right, "right")
        grown = {x: F.concat(x, F.array("f")) for x in ("heads", "tails")}
        level = level.withColumns({"phrase": F.concat_ws(" ", "head", "last"), **grown}).drop("head")
        levels.append(scratch.put(level, f"phrases-{k}"))

    ranked = []
    for k, level in enumerate(levels[1:], 2):
        out = level
        if k < max_words:
            # Whatever longer phrase holds this one and comes often enough holds one of k + 1 words that does, too.
            over = levels[k].select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            out = level.join(over, "id", "left").filter(f"longer is null or cast(100 as decimal(3,0)) * longer < cast({cover} as decimal(3,0)) * f")
        cuts = F.array(*[F.struct(F.expr(f"cast({SCALE} as decimal(7,0)) * cast(f as decimal(20,0)) div (cast(heads[{c - 1}] as decimal(20,0)) + cast(tails[{k - c - 1}] as decimal(20,0)))").alias("score"), F.lit(c).alias("k"), F.col("heads")[c - 1].alias("l"), F.col("tails")[k - c - 1].alias("r")) for c in range(1, k)])
        ranked.append(out.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"))
    every = ranked[0]
    for more in ranked[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # ``top`` rows a task and language are shuffled
    best = every.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    out = scratch.keep(best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "result")
    scratch.clear()
    return out


SQL = rf"""
with pieces as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
places as (select lang, k, unnest([w[i:i + k - 1] for i in range(1, len(w) - k + 2)]) as g from pieces, (select unnest(range(1, {MAX_WORDS + 1})) as k)),
grams as (select lang, k, g, count(*) as f from places group by all),
totals as (select lang, cast(sum(f) as bigint) as n from grams where k = 1 group by lang),
candidates as (select lang, k, g, f as a from grams where k > 1 and f >= {MIN_COUNT}),
parts as (select *, g[1:j] as head, g[j + 1:] as tail from candidates, (select unnest(range(1, {MAX_WORDS})) as j) where j < k),
cuts as (
  select p.lang, p.k, p.g, p.a, p.j, x.f as l, y.f as r, (cast({SCALE} as hugeint) * p.a) // (x.f + y.f) as score
  from parts p join grams x on x.lang = p.lang and x.g = p.head join grams y on y.lang = p.lang and y.g = p.tail),
least_cut as (select * from cuts qualify row_number() over (partition by lang, g order by score, j) = 1),
inner_ones as (
  select distinct q.lang, q.g[s:s + m - 1] as g, q.a as longer
  from candidates q, (select unnest(range(1, {MAX_WORDS})) as s) ss, (select unnest(range(2, {MAX_WORDS})) as m) mm where m < q.k and s + m - 1 <= q.k),
covered as (select distinct c.lang, c.g from candidates c join inner_ones o on o.lang = c.lang and o.g = c.g where 100 * cast(o.longer as hugeint) >= {COVER} * cast(c.a as hugeint)),
ranked as (
  select lang, array_to_string(g, ' ') as phrase, a, l, r, cast(score as bigint) as score from least_cut where not exists (select 1 from covered v where v.lang = least_cut.lang and v.g = least_cut.g)),
numbered as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from ranked)
select lang, rank, phrase, a, l, r, n, score from numbered join totals using (lang) where rank <= {TOP}
"""
