"""Line deduplication by overlapping three-line windows.

Lines that hold more than white space are numbered within their text and compared without
surrounding white space, tabs and the like counting as spaces.  Every three consecutive ones are a window; a window that occurs more
than once anywhere is kept where it occurs first (least id, then text hash, then line) and all
lines that a later occurrence covers are removed.  Overlapping windows merge, so a passage of
any length from three lines on goes as one piece.  Blank lines are left where they are.

Only hashes are shuffled: the first occurrence of each window is found by an aggregation with
map-side combining, and the occurrences are joined with those of repeated windows alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm import textkit as tk

WINDOW = 3


def _keyed(docs: DataFrame, id_col: str, text_col: str, p: str) -> DataFrame:
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    return docs.withColumns({f"{p}id": docs[f"`{id_col}`"], f"{p}th": F.xxhash64(text), f"{p}text": text})


def window_rows(keyed: DataFrame) -> DataFrame:
    """(id, th, at, h1, h2): a row per window, ``at`` the number of its first line."""
    marked = keyed.withColumn("__l", F.filter(F.transform(F.split("__text", "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"[\t\r\x0B\f]", " "))), lambda x: x != ""))
    hashed = marked.withColumn("__h", F.transform("__l", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"))))
    pick = ", ".join(f"element_at(__h, i + {j}).{{0}}" for j in range(WINDOW))
    rows = F.expr(f"case when size(__h) >= {WINDOW} then transform(sequence(1, size(__h) - {WINDOW - 1}), i -> struct(i as at, xxhash64({pick.format('a')}) as h1, xxhash64({pick.format('b')}, 1) as h2)) else cast(array() as array<struct<at:int,h1:bigint,h2:bigint>>) end")
    return hashed.select(F.col("__id").alias("id"), F.col("__th").alias("th"), F.inline(rows))


def covered_lines(keyed: DataFrame) -> DataFrame:
    """(id, th, removed): the numbers of the lines that go, for texts that lose any."""
    rows = tk.stored(window_rows(keyed), "windows")
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("at").alias("at"))
    # Rows equal in id and text are one document: their windows are at one place.
    first = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("h1", "h2", "first")
    first = tk.stored(first, "first-windows")  # so that a window that many texts hold can be split in the join
    later = rows.join(first, ["h1", "h2"]).filter(place != F.col("first")).select("id", "th", F.explode(F.sequence("at", F.col("at") + WINDOW - 1)).alias("line"))
    return later.groupBy("id", "th").agg(F.array_sort(F.collect_set("line")).alias("removed"))  # at most a text's own lines


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its texts shortened, and the columns n_lines and n_removed.

    n_lines counts the lines with more than white space before removal.  Null texts become
    empty, with no lines; texts of fewer than three lines are left alone.  Rows equal in id and
    text are one document and keep the same lines; null ids come last in the order.
    """
    p = tk.fresh(docs)
    keyed = _keyed(docs, id_col, text_col, p)
    gone = covered_lines(keyed.select(*[F.col(f"{p}{c}").alias(f"__{c}") for c in ("id", "th", "text")]))
    gone = gone.select(F.col("id").alias(f"{p}gid"), F.col("th").alias(f"{p}gth"), F.col("removed").alias(f"{p}removed"))
    joined = keyed.join(gone, F.col(f"{p}id").eqNullSafe(F.col(f"{p}gid")) & (F.col(f"{p}th") == F.col(f"{p}gth")), "left")
    joined = joined.withColumn(f"{p}lines", F.split(f"{p}text", "\n", -1))
    solid = F.expr(rf"filter(sequence(1, size({p}lines)), i -> element_at({p}lines, i) rlike r'[^\x20\x09-\x0D]')")
    joined = joined.withColumn(f"{p}solid", solid)  # where the numbered lines are
    stay = F.expr(f"array_except(sequence(1, size({p}lines)), transform({p}removed, n -> element_at({p}solid, n)))")
    cut = F.when(F.col(f"{p}removed").isNull(), F.col(f"{p}text")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(f"{p}lines", i)), "\n"))
    n_lines = F.size(f"{p}solid").cast("bigint")
    out = tk.with_outputs(joined, **{text_col: cut, "n_lines": n_lines, "n_removed": F.coalesce(F.size(f"{p}removed"), F.lit(0)).cast("bigint")})
    return out.drop(*[f"{p}{c}" for c in ("id", "th", "text", "gid", "gth", "removed", "lines", "solid")])


#: DuckDB's version of the query; it compares the lines themselves.
SQL = r"""
WITH raw AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
solid AS (
  SELECT doc_id, pos, trim(regexp_replace(line, '[\t\r\x0B\f]', ' ', 'g'), ' ') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
win AS (
  SELECT doc_id, n, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c FROM solid WINDOW d AS (PARTITION BY doc_id ORDER BY n)),
later AS (
  SELECT doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, n) AS k FROM win WHERE c IS NOT NULL) WHERE k > 1),
gone AS (
  SELECT DISTINCT doc_id, n + k AS n FROM later, range(3) AS r(k)),
kept AS (
  SELECT raw.doc_id, string_agg(raw.line, chr(10) ORDER BY raw.pos) FILTER (gone.n IS NULL) AS text,
         count(solid.n) AS n_lines, count(gone.n) AS n_removed
  FROM raw LEFT JOIN solid ON solid.doc_id = raw.doc_id AND solid.pos = raw.pos
  LEFT JOIN gone ON gone.doc_id = solid.doc_id AND gone.n = solid.n GROUP BY raw.doc_id)
SELECT doc_id, coalesce(text, '') AS text, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed FROM kept
"""
