"""Fill-in-the-middle: a text is cut into prefix, middle and suffix and written in another order.

A cut never falls inside a unit (a run of non-spaces with the spaces before it).  The tokenizers
library's ``Split`` pre-tokenizer, given the pattern of a unit and told to isolate its matches,
yields every unit's code-point offsets; nothing is trained.  The number of offsets is n, and the
offset at the rank of a cut is the place where the text is sliced.

Forms are ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix,
prefix, middle), chosen by digests of a seed and the id, so a rerun gives the same rows wherever
they lie.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.llm import textkit as tk

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACE = r"\x20\x09-\x0D"
UNIT = f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
SEED, FORMED, SPM = 42, 50, 80

#: Code points that are given to the library at a time; it keeps a string and two numbers a unit.
SLAB_CHARS = 1 << 16
_UNIT_END = re.compile(f"[^{SPACE}](?=[{SPACE}])")


def splitter() -> Callable[[str], list]:
    """The library's splitting of one string into (unit, (begin, end))."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(UNIT), behavior="isolated").pre_tokenize_str


def slabs(text: str, size: int = SLAB_CHARS) -> Iterator[tuple[int, str]]:
    """The text in parts of about ``size`` code points, each with its place; a part ends where a unit ends."""
    at = 0
    while at < len(text):
        end = _UNIT_END.search(text, at + size - 1) if len(text) - at > size else None
        to = end.end() if end else len(text)
        yield at, text[at:to]
        at = to


def unit_ends(text: str, split: Callable[[str], list]) -> np.ndarray:
    """Code-point offsets at which the units end, in order."""
    ends = [np.fromiter((to for _, (_, to) in split(part)), dtype=np.int64) + at for at, part in slabs(text)]
    return np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)


def _cutter(at: int, names: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in batches:
            text = batch.column(at)
            draws = [batch.column(batch.num_columns - k).to_numpy() for k in (2, 1)]
            out = np.zeros((batch.num_rows, 3), dtype=np.int64)
            for row, value in enumerate(text):
                ends = unit_ends(value.as_py() or "", split)
                n = len(ends)
                places = np.concatenate([[0], ends])
                first, last = sorted(int(d[row]) % (n + 1) for d in draws)
                out[row] = n, places[first], places[last]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[:, k]) for k in range(3))], names)

    return cut


def draws(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers: the first 8-digit groups of the SHA-256 of ``seed:id``.  A null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.

    Text of the forms psm and spm holds no marker, and no marker can begin or end inside a part
    (each begins with ``<`` and has no other), so splitting at markers gives the parts.
    """
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, formed: int = FORMED, spm: int = SPM) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars (code points) and output.

    ``formed`` of a hundred texts are rearranged, and of these ``spm`` of a hundred suffix first.
    The prefix ends after the lesser of the first two draws modulo n + 1, the middle after the
    greater.  Texts that are null (taken as empty), empty or hold a marker stay plain; of plain
    texts prefix_chars and middle_chars are null.  Rows equal in id and text come out alike, rows
    with a null id draw as one id, and an empty table gives an empty one.  A column of ``docs``
    with an output's name is replaced.
    """
    p = tk.fresh(docs)
    text, draw = docs[f"`{text_col}`"], draws(docs[f"`{id_col}`"], seed)
    rows = docs.withColumns({f"{p}rank": draw[2] % 100, f"{p}kind": draw[3] % 100, f"{p}h1": draw[0], f"{p}h2": draw[1]})
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f"{p}{name}", T.LongType(), False) for name in ("n", "first", "last"))])
    cut = tk.map_arrow(rows, _cutter(docs.columns.index(text_col), schema.names), schema)
    whole = F.coalesce(cut[f"`{text_col}`"], F.lit(""))
    first, last, n = (F.col(f"{p}{x}") for x in ("first", "last", "n"))
    plain = (whole == "") | whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE) | (F.col(f"{p}rank") >= formed)
    form = F.when(plain, "plain").when(F.col(f"{p}kind") < spm, "spm").otherwise("psm")
    shaped = cut.withColumn(f"{p}form", form)
    head, middle, tail = F.substring(whole, F.lit(1), first), F.substring(whole, first + 1, last - first), F.substring(whole, last + 1, F.char_length(whole))
    kind = F.col(f"{p}form")
    output = F.when(kind == "plain", whole).when(kind == "psm", F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), middle))
    output = output.otherwise(F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), middle))
    chars = lambda c: F.when(kind != "plain", c)
    made = tk.with_outputs(shaped, n=n, form=kind, prefix_chars=chars(first), middle_chars=chars(last - first), output=output)
    return made.drop(*(f"{p}{x}" for x in ("rank", "kind", "h1", "h2", "n", "first", "last", "form")))


SQL = f"""
with docs as (select doc_id, coalesce(text, '') as t, sha256('{SEED}:' || doc_id) as h from documents),
units as (select *, regexp_extract_all(t, '{UNIT}') as u,
                 cast('0x' || h[1:8] as ubigint) as h1, cast('0x' || h[9:16] as ubigint) as h2,
                 cast('0x' || h[17:24] as ubigint) as h3, cast('0x' || h[25:32] as ubigint) as h4 from docs),
cuts as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as c1, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as c2 from units),
parts as (select *, array_to_string(u[1:c1], '') as p, array_to_string(u[c1 + 1:c2], '') as m, array_to_string(u[c2 + 1:], '') as s,
                 case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or h3 % 100 >= {FORMED} then 'plain'
                      when h4 % 100 < {SPM} then 'spm' else 'psm' end as form from cuts),
made as (select *, case form when 'plain' then t when 'psm' then '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                             else '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m end as o from parts)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(o) as output_sha256,
       sha256(case form when 'plain' then o
                        when 'psm' then split_part(split_part(o, '{PREFIX}', 2), '{SUFFIX}', 1) || split_part(o, '{MIDDLE}', 2) || split_part(split_part(o, '{SUFFIX}', 2), '{MIDDLE}', 1)
                        else split_part(split_part(o, '{PREFIX}', 2), '{MIDDLE}', 1) || split_part(o, '{MIDDLE}', 2) || split_part(split_part(o, '{SUFFIX}', 2), '{PREFIX}', 1) end) as restored_sha256
from made
"""
