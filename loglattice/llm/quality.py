"""Quality by ordinal regression: a cumulative-link model over hashed text.

P(grade <= k) = logistic(threshold_k - w . x): one weight vector is shared by all grades, and
ordered thresholds cut the latent score.  x are hashed features of the bytes of a text:
trigrams, and words that were seen before in it or not, as relative frequencies under a square
root, so that long and short texts compare.  The model gives the expected grade and the tail
probability P(grade >= k) for selection; with two grades it is logistic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm import textkit as tk
from loglattice.llm.textkit import U64
from loglattice.llm.toxicity import held_out

#: Bounds of the training sample: labelled rows, and characters of one text in so many pieces.
TRAIN_ROWS, TRAIN_CHARS, TRAIN_PIECES = 6_000, 40_000, 8
BITS = 14
STEPS, RATE, RIDGE = 300, 0.05, 1e-4
SELECT_TAIL = 0.5
_SLOTS = 1 << BITS


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of the hashed features; rows without any get none."""
    n = len(off) - 1
    parts = []
    b = buf.astype(U64)
    if len(b) > 2:
        code = tk.mix((b[:-2] << U64(16)) | (b[1:-1] << U64(8)) | b[2:]) >> U64(64 - BITS)
        row = np.searchsorted(off, np.arange(len(code)), side="right") - 1
        inside = np.arange(len(code)) + 3 <= off[row + 1]
        parts.append((row[inside], code[inside].astype(np.int64)))
    words, w_off = tk.word_hashes(buf, off)
    if len(words):
        row = np.repeat(np.arange(n), np.diff(w_off))
        key = (row.astype(U64) << U64(40)) | (words >> U64(24))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), dtype=bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        pair = np.zeros(len(key), dtype=bool)  # a run of two words that was seen before in the text
        two = tk.mix(words[:-1] * U64(3) + words[1:])
        key2 = (row[:-1].astype(U64) << U64(40)) | (two >> U64(24))
        order2 = np.argsort(key2, kind="stable")
        pair[order2[1:]] = key2[order2[1:]] == key2[order2[:-1]]
        level = np.minimum(np.log2(1 + np.diff(w_off)).astype(np.int64), 15)[row]
        for flag, salt in ((again, 1), (pair, 2)):
            parts.append((row, (tk.mix(flag.astype(U64) * U64(64) + level.astype(U64) + U64(salt * 1_000_003)) >> U64(64 - BITS)).astype(np.int64)))
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    out = []
    for row, slot in parts:  # each group of features sums to 1 before the root
        cell, count = np.unique(row * _SLOTS + slot, return_counts=True)
        total = np.bincount(row, minlength=n)
        out.append((cell // _SLOTS, cell % _SLOTS, np.sqrt(count / total[cell // _SLOTS])))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class OrdinalModel:
    """Grades in order, one threshold fewer, and shared weights; picklable."""

    grades: np.ndarray
    thresholds: np.ndarray
    weight: np.ndarray

    def latent(self, texts: list[str | None]) -> np.ndarray:
        col = pa.array(texts, pa.large_string())
        out = np.zeros(len(texts))
        for a, b in tk.column_slices(col, 1 << 20):
            row, slot, value = features(*tk.text_bytes(col.slice(a, b - a)))
            out[a:b] = np.bincount(row, value * self.weight[slot], minlength=b - a)
        return out

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each grade but the least."""
        return _logistic(latent[:, None] - self.thresholds[None, :])

    def expected(self, latent: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(latent) @ np.diff(self.grades) if len(self.grades) > 1 else np.full(len(latent), float(self.grades[0]) if len(self.grades) else 0.0)


def fit(texts: list[str], grades: list[float], steps: int = STEPS) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam over the whole sample.

    Fewer than two grades give a model that knows only that one (0 without rows).
    """
    levels = np.unique(np.array(grades, dtype=np.float64))
    if len(levels) < 2:
        return OrdinalModel(levels if len(levels) else np.zeros(1), np.zeros(0), np.zeros(_SLOTS))
    y = np.searchsorted(levels, grades)
    col = pa.array(texts, pa.large_string())
    got = [(a, features(*tk.text_bytes(col.slice(a, b - a)))) for a, b in tk.column_slices(col, 1 << 20)]
    row, slot, value = (np.concatenate([(f[k] + a if k == 0 else f[k]) for a, f in got]) for k in range(3))
    row, slot, value = row.astype(np.int32), slot.astype(np.int32), value.astype(np.float32)
    n, k = len(texts), len(levels) - 1
    above = (y[:, None] > np.arange(k)[None, :]).mean(axis=0)
    start = np.log((1 - above) / above)  # thresholds without features
    # Thresholds are the first one and positive steps: they stay ordered.
    theta = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 1e-3)), np.zeros(_SLOTS)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        gaps = np.exp(theta[1:k])
        cut = np.concatenate([[-np.inf], theta[0] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        w = theta[k:]
        s = np.bincount(row, value * w[slot], minlength=n)
        hi, lo = _logistic(cut[y + 1] - s), _logistic(cut[y] - s)
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = np.where(y < k, hi * (1 - hi), 0) / p, np.where(y > 0, lo * (1 - lo), 0) / p
        d_s = (d_hi - d_lo) / n  # of the loss, by the latent score
        d_cut = np.zeros(k)
        np.add.at(d_cut, y[y < k], -d_hi[y < k] / n)
        np.add.at(d_cut, y[y > 0] - 1, d_lo[y > 0] / n)
        grad = np.concatenate([[d_cut.sum()], np.cumsum(d_cut[::-1])[::-1][1:] * gaps, np.bincount(slot, value * d_s[row], minlength=_SLOTS) + RIDGE * w])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cut = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:k]))])
    return OrdinalModel(levels, cut, theta[k:])


def train(docs: DataFrame, labels: DataFrame, grade_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on at most ``rows`` rated rows outside the held-out part, those with the least hash of
    their id.  A text of any length takes part: one of more than ``TRAIN_CHARS`` characters by pieces
    from all over it.  Several ratings of a document are
    averaged to the nearest given grade's rank by their median; null ratings and ids are not used."""
    usable = labels.select(labels[f"`{id_col}`"].alias("id"), labels[f"`{grade_col}`"].cast("double").alias("grade")).filter("id is not null and grade is not null").filter(~held_out(F.col("id")))
    one = usable.groupBy("id").agg(F.expr("percentile_disc(0.5) within group (order by grade)").alias("grade"))
    sample = one.orderBy(F.xxhash64("id"), "id").limit(rows)
    size, piece = F.length("text"), TRAIN_CHARS // TRAIN_PIECES
    pieces = [F.col("text").substr((F.lit(1) + F.pmod(F.xxhash64("id", F.lit(k)), size - piece)).cast("int"), F.lit(piece)) for k in range(TRAIN_PIECES)]
    texts = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")).filter("text is not null")
    texts = texts.withColumn("text", F.when(size <= TRAIN_CHARS, F.col("text")).otherwise(F.concat_ws(" ", *pieces)))
    got = texts.join(F.broadcast(sample), "id").select("id", "text", "grade").toArrow().to_pandas()  # at most `rows` small rows are broadcast
    got = got.sort_values(["id", "text"]).drop_duplicates("id")
    texts, grades = got["text"].tolist(), got["grade"].tolist()
    del got
    model = fit(texts, grades)
    del texts
    tk.release()  # the driver goes on with other work
    return model


def rate(docs: DataFrame, model: OrdinalModel, text_col: str = "text", at_least: float | None = None, tail: float = SELECT_TAIL) -> DataFrame:
    """``docs`` with expected_grade, tail_probability (of ``at_least``, by default the highest
    grade) and selected (whether that is ``tail`` or more).

    Null texts are rated as empty, equal texts alike; columns with the names of the outputs are
    replaced, and no other is touched.
    """
    want = model.grades[-1] if at_least is None else at_least
    k = int(np.searchsorted(model.grades, want)) - 1

    @F.pandas_udf("struct<expected:double,tail:double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            latent = model.latent(s.tolist())
            high = model.tails(latent)[:, k] if 0 <= k < len(model.thresholds) else np.full(len(s), float(k < 0))
            yield pd.DataFrame({"expected": model.expected(latent), "tail": high})

    tk.bound_batches(docs.sparkSession)
    p = tk.fresh(docs)
    scored = docs.withColumn(f"{p}q", score(F.coalesce(docs[f"`{text_col}`"], F.lit(""))))
    q: Column = F.col(f"{p}q")
    return tk.with_outputs(scored, expected_grade=q["expected"], tail_probability=q["tail"], selected=q["tail"] >= tail).drop(f"{p}q")
