"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source x language x topic, each with its tokens.  Raking
scales the cells' inclusion probabilities, one marginal after the other, until the expected
tokens of every source, language and topic meet their targets; probabilities stay at most 1,
so a cell that is exhausted is taken whole and the others of its marginals make up for it.
Every document is then sampled by its cell's probability with a hash of its id and text, so
the same document is decided alike in every run and on every executor.

Everything is DataFrame expressions.  The cells, not the documents, are iterated over: up to
``LOCAL_CELLS`` of them in one partition, where windows need no shuffle, beyond that shuffled.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm import textkit as tk

DIMS = ("source", "lang", "topic")
KEEP = 0.7
TEMPER = 0.7
LOCAL_CELLS = 200_000
#: Sweeps and passes between two looks at what is left.
BLOCK, FILL = 4, 8
#: The share by which a category may miss its target, and the part of all tokens that may stay open in sharing out.
TOLERANCE, FILLED = 1e-3, 1e-9
#: Raking goes on until the marginals meet their targets, or ``PATIENCE`` blocks in a row did not lower the least deviation by a hundredth.
GAIN, PATIENCE = 0.99, 3
NONE = "(none)"


def token_estimate(text: Column) -> Column:
    """Tokens of a text, estimated as a quarter of its UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


def topic_of(text: Column) -> Column:
    """A topic by surface form, for tables that have none: legal, records, tabular or prose."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.rlike(r"(?i)licen[sc]e|copyright"), "legal")
        .when(t.rlike(r"@[A-Za-z0-9-]+\.|[0-9]{7,}|\([0-9]{3}\)"), "records")
        .when(t.contains("|"), "tabular")
        .otherwise("prose")
    )


def _category(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NONE))


def _keyed(docs: DataFrame, text_col: str, dims: dict[str, Column], p: str) -> DataFrame:
    return docs.withColumns({f"{p}{d}": _category(c) for d, c in dims.items()} | {f"{p}tokens": token_estimate(docs[f"`{text_col}`"])})


def cells_of(docs: DataFrame, dims: dict[str, Column], text_col: str = "text") -> DataFrame:
    """(each dimension, tokens, n_docs) per cell; nulls are the category ``(none)``."""
    p = tk.fresh(docs)
    keyed = _keyed(docs, text_col, dims, p)
    return keyed.groupBy(*[F.col(f"{p}{d}").alias(d) for d in dims]).agg(F.sum(f"{p}tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))


def rake(cells: DataFrame, dims: tuple[str, ...], keep: float = KEEP, temper: float = TEMPER, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``cells`` with the probability that brings every marginal to its target.

    ``targets[dim]`` holds (value, share); shares are scaled to 1, and a category that is not
    in it has the target 0.  A dimension without targets aims at its observed shares to the
    power ``temper``: at 1 it stays as it is, towards 0 all its categories get alike.  Cells
    without tokens get ``keep``.  A warning names what is left of the deviation where marginals
    cannot meet their targets.
    """
    base = tk.stored(cells, "cells")
    n = base.count()
    local = n <= LOCAL_CELLS

    def total(df: DataFrame, value: Column) -> Column:
        """The sum over all cells: a window in the one partition, or a number found by a job."""
        return F.sum(value).over(Window.partitionBy(F.lit(1))) if local else F.lit(df.agg(F.sum(value)).first()[0])

    base = base.coalesce(1) if local else base
    base = base.withColumn("goal", F.coalesce(total(base, F.col("tokens")), F.lit(0)) * keep)
    for d in dims:
        by = Window.partitionBy(d)
        if targets and d in targets:
            given = targets[d].select(_category(F.col("value")).alias(d), F.col("share").cast("double").alias("__t")).groupBy(d).agg(F.sum("__t").alias("__t"))
            base = base.join(F.broadcast(given) if local else given, d, "left").withColumn("__t", F.coalesce("__t", F.lit(0.0)))
        else:
            base = base.withColumn("__t", F.pow(F.sum("tokens").over(by).cast("double"), F.lit(temper)))
        base = base.withColumns({"__have": F.sum("tokens").over(by).cast("double"), "__n": F.count(F.lit(1)).over(by)})
        # Each cell stands for its part of its category.  A category can give no more than it
        # has; what that leaves open is shared out among the others until nothing is left open or
        # no other can give more.  Every pass but the last exhausts a category.
        scale = F.col("goal") / F.nullif(total(base, F.col("__t") / F.col("__n")), F.lit(0.0))
        base = base.withColumn("__t", F.least(F.col("__have"), F.coalesce(F.col("__t") * scale, F.lit(0.0))))
        while True:
            for _ in range(FILL):
                full = F.col("__t") >= F.col("__have")
                given_out = total(base, F.when(full, F.col("__t") / F.col("__n")).otherwise(0.0))
                rest = total(base, F.when(full, 0.0).otherwise(F.col("__t") / F.col("__n")))
                scale = F.greatest(F.lit(1.0), (F.col("goal") - given_out) / F.nullif(rest, F.lit(0.0)))
                base = base.withColumn("__t", F.when(full, F.col("__t")).otherwise(F.least(F.col("__have"), F.coalesce(F.col("__t") * scale, F.lit(0.0)))))
            base = tk.stored(base, "targets")
            left = base.agg(F.first("goal").alias("goal"), F.sum(F.col("__t") / F.col("__n")).alias("t"), F.max((F.col("__t") > 0) & (F.col("__t") < F.col("__have"))).alias("more")).first()
            base = base.coalesce(1) if local else base
            if not left["more"] or left["t"] >= left["goal"] * (1 - FILLED):
                break
        base = base.withColumnRenamed("__t", f"__t_{d}").drop("__have", "__n")
    now = tk.stored(base.withColumn("p", F.lit(float(keep))), "raked")
    best, idle = float("inf"), 0
    while True:
        step = now.coalesce(1) if local else now
        for _ in range(BLOCK):
            for d in dims:
                mass = F.sum(F.col("tokens") * F.col("p")).over(Window.partitionBy(d))
                step = step.withColumn("p", F.least(F.lit(1.0), F.col("p") * F.coalesce(F.col(f"__t_{d}") / F.nullif(mass, F.lit(0.0)), F.lit(1.0))))
        for d in dims:
            mass = F.sum(F.col("tokens") * F.col("p")).over(Window.partitionBy(d))
            step = step.withColumn(f"__off_{d}", F.coalesce(F.abs(mass / F.nullif(F.col(f"__t_{d}"), F.lit(0.0)) - 1), F.lit(0.0)))
        now = tk.stored(step, "raked")
        row = now.agg(*[F.max(f"__off_{d}") for d in dims]).first()
        off = {d: x or 0.0 for d, x in zip(dims, row, strict=True)}
        worst = max(off.values())
        if worst < TOLERANCE:
            break
        best, idle = (worst, 0) if worst < GAIN * best else (best, idle + 1)
        if idle == PATIENCE:
            # Targets that exclude each other, or cells that are exhausted: no sweep brings them nearer.
            warnings.warn("marginals off their targets by at most " + ", ".join(f"{d} {x:.2%}" for d, x in off.items()), stacklevel=2)
            break
    return now.select(*dims, "tokens", "n_docs", F.col("p").alias("probability"))


def uniform(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def inclusion(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None, keep: float = KEEP, temper: float = TEMPER, targets: dict[str, DataFrame] | None = None, seed: int = 0) -> DataFrame:
    """``docs`` with topic, probability and kept.

    ``dims`` defaults to the columns source and lang and the topic by surface form (a column
    topic is used where there is one).  Null and empty texts hold no tokens: they are sampled by
    their cell's probability like all others.  Rows equal in id and text, null ids included, are
    decided alike.  Columns with the names of the outputs are replaced, and no other is touched.
    """
    text = docs[f"`{text_col}`"]
    topic = docs["topic"] if "topic" in docs.columns else topic_of(text)
    dims = dims or {"source": docs["source"], "lang": docs["lang"], "topic": topic}
    raked = rake(cells_of(docs, dims, text_col), tuple(dims), keep, temper, targets)
    p = tk.fresh(docs)
    u, prob = f"{p}u", f"{p}p"
    keyed = _keyed(docs, text_col, dims, p).withColumn(u, uniform(docs[f"`{id_col}`"], text, seed=seed))
    cells = raked.select(*[F.col(d).alias(f"{p}r_{d}") for d in dims], F.col("probability").alias(prob))
    joined = keyed.join(cells, [F.col(f"{p}{d}") == F.col(f"{p}r_{d}") for d in dims])
    out = tk.with_outputs(joined, topic=F.col(f"{p}topic") if "topic" in dims else F.lit(None).cast("string"), probability=F.col(prob), kept=F.col(u) < F.col(prob))
    return out.drop(f"{p}tokens", u, prob, *[f"{p}{d}" for d in dims], *[f"{p}r_{d}" for d in dims])


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs``, all columns as they were."""
    row = f"{tk.fresh(docs)}row"
    marked = docs.select("*", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    kept = inclusion(marked, **options).filter("kept")
    return kept.select([F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])
