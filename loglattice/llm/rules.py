"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Base statistics of a text are exact and computed row by row.  Four ratios of them are judged
against limits read off a sketch of the text's language and source:

* ``word_length``: Tukey's outer fences, the quartiles minus and plus three times their distance
  (or, where they are one value, the step of the grid);
* ``symbols``, ``dup_lines`` and ``repeat_words``: the quantile at ``TAIL``, so that each of these
  takes at most that tail of a group.  What a text has once is never held against it
  (``ONCE``: a symbol, a repeated line, a phrase of up to twelve words that comes twice).

The sketch of a ratio (a whole number) is a histogram on a log-linear grid: values below 128
are kept, larger ones lose all but their leading seven bits, so a quantile is off by less than
1/64 of its value.  Sketches merge by adding counts.  Every group's sketch is merged with its
language's, scaled to the weight of ``PRIOR`` documents: a large group follows its own
documents, a small one leans on its language, without a switch between the two.

Everything is DataFrame expressions; documents that fail the base rules are not sketched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm import textkit as tk

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Weight of the language's sketch in a group's, in documents.
PRIOR = 50
#: A one-sided limit is the quantile TAIL[0] / TAIL[1].
TAIL = (95, 100)
RATIOS = ("word_length", "symbols", "dup_lines", "repeat_words")
#: The statistic behind a one-sided ratio, and how much of it counts as having it once.
ONCE = {"symbols": ("n_symbols", 1), "dup_lines": ("n_dup_lines", 1), "repeat_words": ("n_repeat_words", 24)}
NONE = "(none)"


def base_statistics(docs: DataFrame, text_col: str, p: str) -> DataFrame:
    """``docs`` with {p}b, a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Null texts have no words.  A word is a run of characters other than space, tab, line feed,
    vertical tab, form feed and carriage return.  ``p`` begins no name of a column of ``docs``.
    """
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    out = docs.withColumn(f"{p}t", text).withColumn(f"{p}w", F.filter(F.split(text, SPACES), lambda x: x != ""))
    out = out.withColumn(f"{p}h", F.transform(f"{p}w", lambda x: F.xxhash64(x)))
    k, h, win, at = WINDOW_WORDS, f"{p}h", f"{p}win", f"{p}at"
    run = ", ".join(f"element_at({h}, i + {j})" for j in range(k))
    out = out.withColumn(win, F.expr(f"case when size({h}) >= {k} then transform(sequence(1, size({h}) - {k - 1}), i -> xxhash64({run})) else cast(array() as array<bigint>) end"))
    # Texts in which a window repeats are few: only there are the windows sorted to find which.
    twice = "(i > 0 and element_at(s, greatest(i, 1)).h = x.h) or (i + 1 < size(s) and element_at(s, least(i + 2, size(s))).h = x.h)"
    marked = f"transform(filter(transform(s, (x, i) -> struct(x.i as i, {twice} as twice)), y -> y.twice), y -> y.i)"
    places = f"array_sort(flatten(transform(array(array_sort(transform({win}, (h, i) -> struct(h, i)))), s -> {marked})))"
    out = out.withColumn(at, F.expr(f"case when size(array_distinct({win})) = size({win}) then cast(array() as array<int>) else {places} end"))
    step = f"case when i = size({at}) then {k} else least({k}, element_at({at}, least(i + 1, size({at}))) - element_at({at}, i)) end"
    covered = F.expr(f"case when size({at}) = 0 then 0L else aggregate(sequence(1, size({at})), 0L, (acc, i) -> acc + {step}) end")
    lines = f"{p}lines"
    out = out.withColumn(lines, F.filter(F.split(f"{p}t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    stats = F.struct(
        F.size(f"{p}w").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(f"{p}t", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(f"{p}t") - F.length(F.translate(f"{p}t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
        F.size(lines).cast("bigint").alias("n_lines"),
    )
    return out.withColumn(f"{p}b", stats)


def base_failed(b: str) -> Column:
    return (F.col(f"{b}.n_words") < MIN_WORDS) | (100 * F.col(f"{b}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{b}.n_words"))


def ratios(b: str) -> dict[str, Column]:
    """Whole numbers: characters of 100 words, symbols per 1000 characters, repeated lines and words per 1000."""

    def per(a: str, n: str, scale: int) -> Column:
        return F.expr(f"cast({scale} * {b}.{a} div greatest({b}.{n}, 1) as bigint)")

    return {"word_length": per("word_chars", "n_words", 100), "symbols": per("n_symbols", "word_chars", 1000), "dup_lines": per("n_dup_lines", "n_lines", 1000), "repeat_words": per("n_repeat_words", "n_words", 1000)}


def grid(v: str) -> Column:
    """The value with all but its leading seven bits cleared."""
    s = f"greatest(length(bin({v})) - 7, 0)"
    return F.expr(f"shiftleft(shiftright({v}, {s}), {s})")


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, ratio, value, n) from rows of lang, source and the ratios; two such tables
    merge by union and another sum."""
    tall = rows.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(r).alias("v")) for r in RATIOS])).alias("x"))
    return tall.select("lang", "source", "x.ratio", grid("x.v").alias("value")).groupBy("lang", "source", "ratio", "value").agg(F.count(F.lit(1)).alias("n"))


def blended(sketch: DataFrame) -> DataFrame:
    """(lang, source, ratio, value, weight): each group's sketch merged with its language's.

    Weights are whole numbers, the language's documents times those of the group or the share
    of ``PRIOR``, so that sums are exact in any order.
    """
    weight = "decimal(38,0)"
    of_lang = sketch.groupBy("lang", "ratio", "value").agg(F.sum("n").alias("n"))
    docs = sketch.groupBy("lang", "ratio").agg(F.sum("n").alias("docs"))
    own = sketch.join(docs, ["lang", "ratio"]).select("lang", "source", "ratio", "value", (F.col("n").cast("decimal(19,0)") * F.col("docs").cast("decimal(18,0)")).cast(weight).alias("weight"))
    prior = sketch.select("lang", "source", "ratio").distinct().join(of_lang, ["lang", "ratio"]).select("lang", "source", "ratio", "value", (PRIOR * F.col("n")).cast(weight).alias("weight"))
    return own.unionByName(prior).groupBy("lang", "source", "ratio", "value").agg(F.sum("weight").cast(weight).alias("weight"))


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, limits): limits maps a ratio to its low and high bound."""
    group = Window.partitionBy("lang", "source", "ratio")  # at most some hundred grid values a group
    ranked = blended(sketch).withColumn("upto", F.sum("weight").over(group.orderBy("value"))).withColumn("all", F.sum("weight").over(group))

    def quantile(num: int, den: int) -> Column:
        return F.min(F.when(den * F.col("upto") >= num * F.col("all"), F.col("value")))

    q = ranked.groupBy("lang", "source", "ratio").agg(quantile(1, 4).alias("q1"), quantile(3, 4).alias("q3"), quantile(*TAIL).alias("tail"))
    # Quartiles are known to a step of the grid only.
    reach = 3 * F.greatest(F.col("q3") - F.col("q1"), F.expr("shiftleft(1L, greatest(length(bin(q3)) - 7, 0))"))
    two_sided = F.col("ratio") == "word_length"
    low, high = F.when(two_sided, F.col("q1") - reach), F.when(two_sided, F.col("q3") + reach).otherwise(F.col("tail"))
    entry = F.struct("ratio", F.struct(low.alias("low"), high.alias("high")))
    return q.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(entry)).alias("limits"))  # four entries


def apply_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (of its columns those in ``carry``, or all) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    kept is false where base_failed, else whether all ratios lie within their group's limits.
    Null languages and sources are the group ``(none)``; null and empty texts fail the base rules;
    repeated rows count as often as they come; columns of ``docs`` with the names of the outputs
    are replaced, and no other is touched.  The statistics are written once to the shared folder,
    as both the sketches and the verdicts need them.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    p = tk.fresh(docs)
    b, lang, source = f"{p}b", f"{p}lang", f"{p}source"
    keyed = docs.withColumns({lang: F.coalesce(docs[f"`{lang_col}`"].cast("string"), F.lit(NONE)), source: F.coalesce(docs[f"`{source_col}`"].cast("string"), F.lit(NONE))})
    wanted = docs.columns if carry is None else carry
    rows = tk.stored(base_statistics(keyed, text_col, p).select(*[F.col(f"`{c}`") for c in wanted], lang, source, b), "statistics")
    good = rows.filter(~base_failed(b)).select(F.col(lang).alias("lang"), F.col(source).alias("source"), *[c.alias(r) for r, c in ratios(b).items()])
    # Written, so that the join is broadcast where its size allows, and else a hot group can be split.
    found = tk.stored(limits(tk.stored(sketches(good), "sketches")), "limits").select(F.col("lang").alias(f"{p}l"), F.col("source").alias(f"{p}s"), F.col("limits").alias(f"{p}limits"))
    joined = rows.join(found, (F.col(lang) == F.col(f"{p}l")) & (F.col(source) == F.col(f"{p}s")), "left")
    verdict = ~base_failed(b)
    for r, c in ratios(b).items():
        within = c <= F.col(f"{p}limits.{r}.high")
        if r in ONCE:
            within |= F.col(f"{b}.{ONCE[r][0]}") <= ONCE[r][1]
        else:
            within &= c >= F.col(f"{p}limits.{r}.low")
        verdict &= F.coalesce(within, F.lit(False))
    out = tk.with_outputs(joined, **{n: F.col(f"{b}.{n}") for n in names}, base_failed=base_failed(b), kept=verdict)
    return out.drop(b, lang, source, f"{p}l", f"{p}s", f"{p}limits")


#: DuckDB's version of the query.
SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
rep AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win),
coverage AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep WHERE n > 1) GROUP BY doc_id),
b AS (
  SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN coverage ON t.doc_id = coverage.doc_id),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         100 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_symbols // greatest(word_chars, 1) AS symbols,
         1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_words
  FROM b),
tall AS (
  SELECT lang, source, 'word_length' AS ratio, word_length AS v FROM f WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'symbols', symbols FROM f WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'dup_lines', dup_lines FROM f WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'repeat_words', repeat_words FROM f WHERE NOT base_failed),
g AS (
  SELECT lang, source, ratio, (v >> greatest(length(bin(v)) - 7, 0)::INT) << greatest(length(bin(v)) - 7, 0)::INT AS v FROM tall),
own AS (
  SELECT lang, source, ratio, v, count(*) AS n FROM g GROUP BY lang, source, ratio, v),
of_lang AS (
  SELECT lang, ratio, v, count(*) AS n FROM g GROUP BY lang, ratio, v),
docs AS (
  SELECT lang, ratio, count(*) AS docs FROM g GROUP BY lang, ratio),
weighted AS (
  SELECT lang, source, ratio, v, n * docs AS weight FROM own JOIN docs USING (lang, ratio)
  UNION ALL
  SELECT lang, source, ratio, v, 50 * n FROM (SELECT DISTINCT lang, source, ratio FROM own) JOIN of_lang USING (lang, ratio)),
r AS (
  SELECT *, sum(weight) OVER (PARTITION BY lang, source, ratio ORDER BY v) AS upto, sum(weight) OVER (PARTITION BY lang, source, ratio) AS total FROM weighted),
q AS (
  SELECT lang, source, ratio, min(v) FILTER (4 * upto >= total) AS q1, min(v) FILTER (4 * upto >= 3 * total) AS q3, min(v) FILTER (100 * upto >= 95 * total) AS tail
  FROM r GROUP BY lang, source, ratio),
fence AS (
  SELECT lang, source, ratio, q1 - 3 * greatest(q3 - q1, 1 << greatest(length(bin(q3)) - 7, 0)::INT) AS low,
         CASE WHEN ratio = 'word_length' THEN q3 + 3 * greatest(q3 - q1, 1 << greatest(length(bin(q3)) - 7, 0)::INT) ELSE tail END AS high FROM q)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(word_length BETWEEN wl.low AND wl.high, false) AND coalesce(symbols <= sy.high OR n_symbols <= 1, false)
       AND coalesce(dup_lines <= dl.high OR n_dup_lines <= 1, false) AND coalesce(repeat_words <= rw.high OR n_repeat_words <= 24, false) AS kept
FROM f
LEFT JOIN fence wl ON wl.lang = f.lang AND wl.source = f.source AND wl.ratio = 'word_length'
LEFT JOIN fence sy ON sy.lang = f.lang AND sy.source = f.source AND sy.ratio = 'symbols'
LEFT JOIN fence dl ON dl.lang = f.lang AND dl.source = f.source AND dl.ratio = 'dup_lines'
LEFT JOIN fence rw ON rw.lang = f.lang AND rw.source = f.source AND rw.ratio = 'repeat_words'
"""
