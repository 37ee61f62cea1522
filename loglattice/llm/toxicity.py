"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.  The running
words of a text are cut into windows of about ``WINDOW`` bytes, and every window is compressed
with either dictionary.  The bytes that the toxic dictionary saves are compared with a ladder of
thresholds; a logistic model calibrated on the training rows turns the numbers of windows over
each threshold into a score.

A label says of a whole text that it is toxic, while most of its words are ordinary.  So the
toxic dictionary is trained on those words of toxic texts that hold n-grams found in a far
larger share of toxic than of ordinary texts.  Both dictionaries begin with the ordinary content;
the toxic one adds the toxic content and the ordinary one padding of that length, so all else
costs the same with either.  A window is followed by a frame that is in both dictionaries, as the
compressor finds no match in the last bytes of an input.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm import textkit as tk

#: Bounds of the training sample: labelled rows, windows of one text (those of least hash), and ordinary windows for their dictionary.
TRAIN_ROWS, TRAIN_WINDOWS, ORDINARY_WINDOWS = 8_000, 2_048, 60_000
WINDOW = 16
TOXIC_BYTES, ORDINARY_BYTES, HARD_BYTES = 1_024, 8_192, 4_096
#: From how many bytes saved on a window of an ordinary text it goes into the ordinary dictionary.
MISLED = 2
GRAMS = (4, 6, 8)
#: How many times larger the share of toxic texts that hold a telling n-gram is.
TELLING = 30
#: The trainer's segments, and the runs of bytes whose frequency it counts.
SEGMENT, RUN = 24, 8
SLICE_BYTES = 1 << 19
_FRAME = np.arange(128, 160, dtype=np.uint8)
_STEPS = 14


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some rows, each led by a space, in one buffer: (bytes, starts, lengths, rows)."""
    solid = tk._WORD[buf]
    if not solid.any():
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint8), none, none, none
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = off[:-1][(off[:-1] > 0) & (off[:-1] < len(buf))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(begins)
    n = np.flatnonzero(ends) + 1 - start
    to = np.cumsum(n + 1) - (n + 1)
    out = np.full(int((n + 1).sum()), 32, dtype=np.uint8)
    at = np.flatnonzero(solid)
    out[at - np.repeat(start - to - 1, n)] = buf[at]
    return out, to, n + 1, np.searchsorted(off, start, side="right") - 1


def windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts with the end of all, rows): runs of words that begin in one cell of ``WINDOW`` bytes.

    A longer word is cut into pieces of that size.
    """
    out, to, n, row = words_of(buf, off)
    if not len(to):
        return out, np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
    k = -(-n // WINDOW)
    piece = np.repeat(to, k) + WINDOW * (np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k))
    row = np.repeat(row, k)
    new_row = np.append(True, row[1:] != row[:-1])
    cell = (piece - piece[np.flatnonzero(new_row)][np.cumsum(new_row) - 1]) // WINDOW
    new = new_row | np.append(True, cell[1:] != cell[:-1])
    return out, np.append(piece[new], len(out)), row[new]


def _parts(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of about ``SLICE_BYTES``; a longer text comes in parts cut between words."""
    for a, b in tk.column_slices(col, SLICE_BYTES):
        buf, off = tk.text_bytes(col.slice(a, b - a))
        at = 0
        while len(buf) - at > 2 * SLICE_BYTES and b == a + 1:
            gap = np.flatnonzero(~tk._WORD[buf[at + SLICE_BYTES // 2 : at + SLICE_BYTES]])
            to = at + (SLICE_BYTES // 2 + int(gap[-1]) if len(gap) else SLICE_BYTES)
            yield a, b, buf[at:to], np.array([0, to - at])
            at = to
        yield a, b, buf[at:], off - at if at == 0 else np.array([0, len(buf) - at])


#: How often the trainer is shown the same samples, until it has enough of them.
REPEATS = (1, 2, 4, 8, 16, 32, 64, 128)


def _train(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary.

    The trainer asks for more samples and bytes than small tables have; it then sees the same
    samples several times.  Of next to nothing (a few words) no dictionary can be trained: it is empty.
    """
    order = np.random.default_rng(0).permutation(len(samples))
    joined = [b"".join(samples[i] for i in order[k : k + 8]) for k in range(0, len(samples), 8)]
    for times in REPEATS:
        try:
            return zs.train_dictionary(size, joined * times, k=SEGMENT, d=RUN, level=3).as_bytes()
        except zs.ZstdError:
            continue
    return b""


@dataclass
class ToxicityModel:
    """Dictionaries and calibration; picklable, a few kilobytes."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # with the intercept first; none where one label only was seen
    share: float  # of label 1 in training: the score where nothing else is known

    def __post_init__(self):
        self._compressors = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def savings(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each of the consecutive windows."""
        if self._compressors is None:
            params = zs.ZstdCompressionParameters(format=zs.FORMAT_ZSTD1_MAGICLESS, window_log=16, hash_log=15, chain_log=13, search_log=4, min_match=6, target_length=0, strategy=zs.STRATEGY_FAST, write_checksum=0, write_content_size=0, write_dict_id=0)
            self._compressors = []
            for own in (bytes(len(self.toxic)), self.toxic):
                held = zs.ZstdCompressionDict(self.ordinary + own + _FRAME.tobytes(), dict_type=zs.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=params)
                self._compressors.append(zs.ZstdCompressor(dict_data=held, compression_params=params))
        n = np.diff(starts)
        if not len(n):
            return np.zeros(0, dtype=np.int64)
        size = n + len(_FRAME)
        at = np.cumsum(size) - size
        data = np.empty(int(size.sum()), dtype=np.uint8)
        data[np.arange(starts[0], starts[-1]) + np.repeat(at - starts[:-1], n)] = text[starts[0] : starts[-1]]
        data[(at + n)[:, None] + np.arange(len(_FRAME))] = _FRAME
        ready = zs.BufferWithSegments(data.tobytes(), np.stack([at, size], axis=1).astype(np.uint64).tobytes())
        one, two = (np.fromiter(map(len, c.multi_compress_to_buffer(ready, threads=1)), dtype=np.int64, count=len(n)) for c in self._compressors)
        return one - two

    def misled(self, col: pa.Array, labels: list[int]) -> list[bytes]:
        """Windows of ordinary texts on which the toxic dictionary saves bytes, a hash sample of ``ORDINARY_WINDOWS`` at most."""
        found: list[tuple[int, bytes]] = []
        plain = np.array(labels) == 0
        for a, _, buf, off in _parts(col):
            text, starts, row = windows(buf, off)
            raw, order = text.tobytes(), tk.run_hashes(text, starts[:-1], starts[1:])
            for k in np.flatnonzero((self.savings(text, starts) >= MISLED) & plain[a + row]).tolist():
                found.append((int(order[k]), raw[starts[k] : starts[k + 1]]))
            if len(found) > 2 * ORDINARY_WINDOWS:
                found = sorted(found)[:ORDINARY_WINDOWS]
        return [w for _, w in sorted(found)[:ORDINARY_WINDOWS]]

    def counts(self, col: pa.Array) -> np.ndarray:
        """For each text the log numbers of its windows, of all and of those over each threshold."""
        out = np.zeros((len(col), _STEPS))
        for a, _, buf, off in _parts(col):
            text, starts, row = windows(buf, off)
            np.add.at(out, (a + row, np.clip(self.savings(text, starts), 0, _STEPS - 1)), 1)
        return np.log1p(out[:, ::-1].cumsum(axis=1)[:, ::-1])

    def score(self, texts: pa.Array | list[str]) -> np.ndarray:
        col = texts if isinstance(texts, pa.Array) else pa.array([t.lower() for t in texts], pa.large_string())
        if not len(self.weight):
            return np.full(len(col), self.share)
        x = self.counts(col)
        z = (x - self.mean) / self.scale
        return np.where(x[:, 0] > 0, 1 / (1 + np.exp(-np.clip(z @ self.weight[1:] + self.weight[0], -30, 30))), self.share)


def _grams(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slice by slice the words of some texts, (bytes, starts, lengths, rows), and a hash and the word of every n-gram."""
    for a, b in tk.column_slices(col, SLICE_BYTES):
        out, to, n, row = words_of(*tk.text_bytes(col.slice(a, b - a)))
        at, word = np.arange(len(out)), np.repeat(np.arange(len(n)), n)
        end = to + n
        found = []
        for g in GRAMS:
            ok = at + g <= end[word]
            found.append((tk.run_hashes(out, at[ok], at[ok] + g), word[ok]))
        yield out, to, n, a + row, *(np.concatenate([f[k] for f in found]) for k in range(2))


def _once(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The hashes, each once a row."""
    key = tk.mix(hashes ^ (row.astype(tk.U64) * tk.U64(0x9E3779B97F4A7C15)))
    return hashes[np.unique(key, return_index=True)[1]]


def _within(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the hashes are among the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)


def telling_words(toxic: pa.Array, plain: pa.Array) -> list[bytes]:
    """The words of toxic texts that hold a telling n-gram, once for each text with the word."""
    support = max(min(5, 1 + len(toxic) // 10), len(toxic) // 100)
    # Counted roughly first, so that the rare ones need no place in the exact count.
    rough = np.zeros(1 << 22, dtype=np.int32)
    low = tk.U64(len(rough) - 1)
    for *_, row, h, word in _grams(toxic):
        np.add.at(rough, (_once(h, row[word]) & low).astype(np.int64), 1)
    often = [_once(h[keep], row[word[keep]]) for *_, row, h, word in _grams(toxic) for keep in [rough[(h & low).astype(np.int64)] >= support]]
    in_toxic, n = np.unique(np.concatenate(often) if often else np.zeros(0, dtype=tk.U64), return_counts=True)
    in_toxic, n = in_toxic[n >= support], n[n >= support]
    in_plain = np.zeros(len(in_toxic), dtype=np.int64)
    gate = np.zeros(len(rough), dtype=bool)
    gate[(in_toxic & low).astype(np.int64)] = True
    for *_, row, h, word in _grams(plain):
        keep = np.flatnonzero(gate[(h & low).astype(np.int64)])
        keep = keep[_within(h[keep], in_toxic)]
        np.add.at(in_plain, np.searchsorted(in_toxic, _once(h[keep], row[word[keep]])), 1)
    telling = in_toxic[n / max(1, len(toxic)) > TELLING * (in_plain + 1) / max(1, len(plain))]
    # Tiny samples have no n-gram that far apart: then those that no ordinary text holds.
    telling = telling if len(telling) else in_toxic[in_plain == 0]
    found: list[bytes] = []
    for out, to, size, row, h, word in _grams(toxic):
        raw = out.tobytes()
        own = np.unique(word[_within(h, telling)]).tolist()
        found += [w for _, w in sorted({(int(row[k]), raw[to[k] : to[k] + size[k]]) for k in own})]
    return found


def _dictionaries(col: pa.Array, labels: list[int]) -> ToxicityModel:
    """A model with dictionaries of the texts of both labels, not calibrated yet."""
    ordinary: list[bytes] = []
    n_plain, rng, none = len(labels) - sum(labels), np.random.default_rng(0), np.zeros(0)
    marks = np.array(labels, dtype=bool)
    plain = col.filter(pa.array(~marks))
    for a, b in tk.column_slices(plain, SLICE_BYTES):
        text, starts, row = windows(*tk.text_bytes(plain.slice(a, b - a)))
        raw, ends = text.tobytes(), np.searchsorted(row, np.arange(b - a + 1))
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            # Every ordinary text gives its share of windows.
            some = lo + rng.choice(hi - lo, min(hi - lo, -(-ORDINARY_WINDOWS // n_plain)), replace=False)
            ordinary += [raw[starts[i] : starts[i + 1]] for i in some.tolist()]
    common, toxic = _train(ordinary, ORDINARY_BYTES), _train(telling_words(col.filter(pa.array(marks)), plain), TOXIC_BYTES)
    del ordinary, plain
    model = ToxicityModel(common, toxic, none, none, none, sum(labels) / len(labels))
    hard = model.misled(col, labels)
    return ToxicityModel(_train(hard, HARD_BYTES) + common, toxic, none, none, none, model.share) if hard else model


def fit(texts: list[str] | pa.Array, labels: list[int]) -> ToxicityModel:
    """Train on labelled texts (an Arrow array must hold lower-case ones).

    Without both labels the score is the share of label 1 (0 without rows).
    """
    none = np.zeros(0)
    if not len(set(labels)) == 2:
        return ToxicityModel(b"", b"", none, none, none, float(any(labels)))
    col = texts if isinstance(texts, pa.Array) else pa.array([t.lower() for t in texts], pa.large_string())
    y = np.array(labels, dtype=np.float64)
    model = _dictionaries(col, labels)
    x = model.counts(col)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    model.scale[0] = max(model.scale[0], 0.5)  # texts of one length say nothing about other lengths
    z = np.c_[np.ones(len(x)), (x - model.mean) / model.scale]
    weight = np.zeros(z.shape[1])
    weight[0] = math.log(y.sum() / (len(y) - y.sum()))
    ridge = np.append(0.0, np.full(z.shape[1] - 1, 0.5))
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(z @ weight, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (p - y) + ridge * weight)
        weight -= step
        if np.abs(step).max() < 1e-6:
            break
    model.weight = weight
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(tk.crc32_mod(doc_id, 5) == 0, F.lit(False))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, label, text) with texts of more than ``TRAIN_WINDOWS`` windows cut to that many."""
    for batch in batches:
        kept = []
        for text in batch.column("text"):
            parts = []
            for _, _, buf, off in _parts(pa.array([text.as_py()], pa.large_string())):
                out, starts, _ = windows(buf, off)
                if len(starts) > 1:
                    parts.append((out, starts, tk.run_hashes(out, starts[:-1], starts[1:])))
            every = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, dtype=tk.U64)
            if len(every) <= TRAIN_WINDOWS:
                kept.append(text.as_py())
                continue
            limit = np.partition(every, TRAIN_WINDOWS - 1)[TRAIN_WINDOWS - 1]
            some = [out[s:e].tobytes() for out, starts, h in parts for s, e, ok in zip(starts[:-1].tolist(), starts[1:].tolist(), (h <= limit).tolist(), strict=True) if ok]
            kept.append(b"".join(some[:TRAIN_WINDOWS]).decode(errors="replace"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(kept, pa.string())], ["id", "label", "text"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled model of all rows of (id, label, text), or no row where there are none."""
    held = list(batches)
    if held:
        got = pa.Table.from_batches(held).sort_by("id")
        held.clear()
        col, marks = pa.concat_arrays(got.column("text").chunks).cast(pa.large_string()), got.column("label").to_pylist()
        del got
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(col, marks))], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on at most ``rows`` labelled rows outside the held-out part, those with the least hash of their id.

    A text of any length takes part: of more than ``TRAIN_WINDOWS`` windows those with the least
    hash stand for it.  A document labelled twice counts as toxic if one label says so; of rows
    with one id, the least text is taken; null labels, ids and texts are not used.
    """
    usable = labels.select(labels[f"`{id_col}`"].alias("id"), labels[f"`{label_col}`"].cast("int").alias("label")).filter("id is not null and label in (0, 1)").filter(~held_out(F.col("id")))
    one = usable.groupBy("id").agg(F.max("label").alias("label"))
    sample = one.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(docs[f"`{id_col}`"].alias("id"), F.lower(docs[f"`{text_col}`"]).alias("text")).filter("text is not null")
    found = texts.join(F.broadcast(sample), "id").select("id", "label", "text")  # at most `rows` small rows are broadcast
    # Rows with one id are few; the least hash of each is taken before anything is gathered.
    single = found.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("x")).select("id", "x.label", "x.text")
    sampled = tk.map_arrow(single, _sampled, f"id {dict(single.dtypes)['id']}, label int, text string")
    # The bounded sample meets in one task; the driver gets the model, a few kilobytes.
    row = tk.map_arrow(sampled.repartition(1), _fitted, "model binary").first()
    return pickle.loads(row["model"]) if row else fit([], [])


def score_column(model: ToxicityModel, text: Column) -> Column:
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            yield pa.array(model.score(col), pa.float64())
        tk.release()

    return score(F.lower(F.coalesce(text, F.lit(""))))


def classify(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on).

    Null texts are scored as empty; texts without words get the share of toxic training rows; equal texts have equal scores; columns of ``docs`` with the
    names of the outputs are replaced, and no other is touched.
    """
    tk.bound_batches(docs.sparkSession)
    p = tk.fresh(docs)
    scored = docs.withColumn(f"{p}score", score_column(model, docs[f"`{text_col}`"]))
    return tk.with_outputs(scored, score=F.col(f"{p}score"), predicted=(F.col(f"{p}score") >= 0.5).cast("int")).drop(f"{p}score")


def reject_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are predicted toxic."""
    tk.bound_batches(docs.sparkSession)
    p = tk.fresh(docs)
    return docs.withColumn(f"{p}score", score_column(model, docs[f"`{text_col}`"])).filter(F.col(f"{p}score") < 0.5).drop(f"{p}score")
