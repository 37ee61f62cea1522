"""Fill-in-the-middle against a plain version and DuckDB."""

import hashlib
import random
import re

import numpy as np
import pytest
from compare import assert_same

from loglattice.llm import fill_middle as fm
from loglattice.llm import queries

DDL = "doc_id long, text string, form string, N string, `a.b` string"
UNIT = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def brute(doc_id, text, seed=42, formed=50, spm=80):
    text = text or ""
    u = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= formed:
        return len(u), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(n):
    rng = random.Random(5)
    parts = ["a", "é", "日本", "\U0001f600", " ", "  ", "\t", "\n", "\x0b", "\x1c", " ", "　", "<", "P>", "<P", ">", "<S", "M>", "\0", "word"]
    return [(k, "".join(rng.choices(parts, k=rng.randrange(30)))) for k in range(n)]


def test_units_and_slabs():
    split = fm.splitter()
    for _, text in rows_of(400):
        want = np.cumsum([len(x) for x in UNIT.findall(text)]).tolist()
        assert fm.unit_ends(text, split).tolist() == want
        for size in (1, 2, 7):
            assert "".join(part for _, part in fm.slabs(text, size)) == text
            assert [x for _, part in fm.slabs(text, size) for x in UNIT.findall(part)] == UNIT.findall(text)


@pytest.mark.parametrize(("formed", "spm"), [(50, 80), (100, 40), (0, 80)])
def test_equals_brute_force(spark, monkeypatch, formed, spm):
    monkeypatch.setattr(fm, "SLAB_CHARS", 50)
    rows = [*rows_of(300), (None, "x y z"), (None, "x y z"), (301, None), (302, ""), (302, ""), (303, " "), (304, "a <P> b"), (305, "w " * 50_000), (306, "x" * 200_000), (307, "<<P> <S <M")]
    d = spark.createDataFrame([(i, t, "f", "n", "c") for i, t in rows], DDL)
    made = fm.fill_in_middle(d, formed=formed, spm=spm)
    assert made.columns == ["doc_id", "text", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("restored", fm.restored(made["output"], made["form"])).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, formed=formed, spm=spm)
        assert r.restored == (r.text or "")
    if formed == 100:
        assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fm.fill_in_middle(spark.createDataFrame([], DDL)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_duckdb(spark, sf):
    assert_same(spark, queries.op13_fill_middle, fm.SQL, f"/root/testdata/{sf}")
