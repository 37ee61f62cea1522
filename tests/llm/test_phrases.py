"""Phrase mining against a plain version and DuckDB."""

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same

from loglattice.llm import phrases as ph
from loglattice.llm import queries

DDL = "doc_id long, text string, lang string, word string, block string, `a.b` string"


def brute(rows, min_count, max_words=4, top=2000, cover=80):
    lower = {c: c + 32 for c in range(65, 91)}
    out = []
    for lang in {r[1] or "und" for r in rows}:
        f = Counter()
        for text, own in rows:
            if (own or "und") != lang:
                continue
            for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
                w = re.findall("[^ \t]+", piece)
                f.update(tuple(w[i : i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
        n = sum(c for g, c in f.items() if len(g) == 1)
        wanted = {g: c for g, c in f.items() if len(g) > 1 and c >= min_count}
        best = []
        for g, a in wanted.items():
            inside = any(len(q) > len(g) and 100 * b >= cover * a and any(q[i : i + len(g)] == g for i in range(len(q) - len(g) + 1)) for q, b in wanted.items())
            if not inside:
                score, _, l, r = min((ph.SCALE * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def mined(spark, rows, **how):
    d = spark.createDataFrame([(1, t, lang, "w", "b", "c") for t, lang in rows], DDL)
    return sorted(tuple(r) for r in ph.mine(d, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("block_bytes", [200, 8 << 20])
def test_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(ph, "BLOCK_BYTES", block_bytes)
    rng = random.Random(0)
    words = ["a", "B", "c", "É", "日本", "of", "The", "x,", "y.", "z\n", "\t", "", "-"]
    rows = [(" ".join(rng.choices(words, weights=range(13, 0, -1), k=rng.randrange(40))), rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    rows += [("New York City Hall", "en")] * 9 + [("New York City", "en"), ("York City Hall is", "en"), (None, "en"), ("", None), ("a " * 3000, "long")]
    assert mined(spark, rows, min_count=6, top=25) == brute(rows, 6, top=25)
    if block_bytes > 200:
        assert mined(spark, rows, min_count=6, max_words=6) == brute(rows, 6, max_words=6)


def test_ties_and_covered_phrases(spark):
    rows = [("p q r s", "en")] * 10 + [("p q", "en")] * 3 + [("t u", "en")] * 10 + [("T  U\tv", "en")] * 2
    got = mined(spark, rows, min_count=2)
    assert got == brute(rows, 2)
    assert {r[2] for r in got} == {"p q r s", "p q", "t u", "u v", "t u v"} & {r[2] for r in brute(rows, 2)}
    two = [("a b", "x")] * 3 + [("c d", "x")] * 3
    assert [r[:3] for r in mined(spark, two, min_count=3)] == [("x", 1, "a b"), ("x", 2, "c d")]


def test_nothing_to_find(spark):
    assert mined(spark, [], min_count=1) == []
    assert mined(spark, [(None, None), ("", "en"), (" .,\n", "en"), ("alone", "en")], min_count=1) == []


def test_many_languages_wait_for_their_blocks(spark, monkeypatch):
    monkeypatch.setattr(ph, "WAIT_BYTES", 300)
    rows = [(f"l{k % 60} and so on and so", f"l{k % 60}") for k in range(240)]
    assert mined(spark, rows, min_count=4) == brute(rows, 4)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(ph.tk, "run_hashes", lambda buf, a, b: ((b - a) % 2).astype(np.uint64))
    buf = np.frombuffer(b"aa bb aa cc bb aa ", dtype=np.uint8)
    start = np.arange(0, 18, 3)
    first, code, count = ph.distinct_runs(buf, start, start + 2)
    assert [buf[start[i] : start[i] + 2].tobytes() for i in first[code]] == [b"aa", b"bb", b"aa", b"cc", b"bb", b"aa"]
    assert count.tolist() == [3, 2, 1]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_duckdb(spark, sf):
    assert assert_same(spark, queries.op12_phrases, ph.SQL, f"/root/testdata/{sf}") > 0


def test_products_beyond_64_bits(spark):
    a, l = 3 * 10**14, 9 * 10**17
    score = spark.sql(f"select cast({ph.SCALE} as decimal(7,0)) * cast({a}L as decimal(20,0)) div (cast({l}L as decimal(20,0)) + cast({l}L as decimal(20,0))) as s").first().s
    assert score == ph.SCALE * a // (2 * l)


def test_pairs_are_not_stored_before_they_meet(spark, monkeypatch):
    stored, kinds = [], ph._kinds
    monkeypatch.setattr(ph, "_kinds", lambda scratch, df, path: stored.append(path) or kinds(scratch, df, path))
    rows = [("p q r s", "en")] * 4 + [("p q", "de")] * 3
    assert mined(spark, rows, min_count=3) == brute(rows, 3)
    assert len(stored) == 1


def test_pairs_that_cannot_be_frequent_are_not_shuffled(spark, monkeypatch):
    met, frequent = [], ph._frequent
    monkeypatch.setattr(ph, "_frequent", lambda names, key, min_count: met.append(names.select(*key).distinct().count()) or frequent(names, key, min_count))
    words = [f"w{k}" for k in range(12)]
    rows = [(f"{a} {b}", "en") for a in words for b in words] + [("w0 w1", "en")] * 9  # every word comes often, one pair does
    assert mined(spark, rows, min_count=10) == brute(rows, 10)
    assert met[:2] == [12, 1]


def test_pairs_that_share_buckets_are_told_apart(monkeypatch):
    monkeypatch.setattr(ph, "BUCKET_BITS", 7)
    monkeypatch.setattr(ph, "RANGE_BITS", 4)
    rng = np.random.default_rng(0)
    names = [{"code": c, "id": (c + 1) << 40} for c in range(40)]
    seqs = [np.minimum(rng.zipf(1.3, 900), 41).astype("<i4") - 1 for _ in range(5)]  # 40 has no name
    f = Counter((int(a + 1) << 40, int(b + 1) << 40) for s in seqs for a, b in zip(s[:-1], s[1:], strict=True) if max(a, b) < 40)
    blocks = pa.table({"block": range(5), "seq": [ph.packed(s) for s in seqs], "names": pa.array([names] * 5, pa.list_(pa.struct([("code", pa.int64()), ("id", pa.int64())])))}).to_batches(2)
    tallies = pa.Table.from_batches(ph._tallies(iter(blocks))).sort_by("part")
    often = SimpleNamespace(value={r["part"]: r["bits"] for b in ph._summed(30)(tallies.to_batches(3)) for r in b.to_pylist()})
    got = Counter()
    for b in ph._pairs(often)(iter(blocks)):
        for r in b.to_pylist():
            got[r["left"], r["right"]] += r["count"]
    wanted = {p: n for p, n in f.items() if n >= 30}
    assert {p: n for p, n in got.items() if n >= 30} == wanted
    assert len(wanted) < len(got) < len(f)


@pytest.mark.parametrize("numbers", [[], [-1, 0, 1, 255, 256, 1 << 30, -1], [7] * 1000])
def test_packed_numbers_come_back(numbers):
    assert ph.unpacked(ph.packed(np.array(numbers, dtype=np.int64))).tolist() == numbers


def test_sequences_are_stored_once_and_not_shuffled(spark, monkeypatch):
    labels, plans, path, often = [], [], ph.tk.Scratch.path, ph._often
    monkeypatch.setattr(ph.tk.Scratch, "path", lambda self, label: labels.append(label) or path(self, label))
    monkeypatch.setattr(ph, "_often", lambda blocks, floor: plans.append(blocks._jdf.queryExecution().executedPlan().toString()) or often(blocks, floor))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("p q r s", "en")] * 4 + [("p q", "de")] * 3
        assert mined(spark, rows, min_count=3) == brute(rows, 3)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(plans) == 3 and all("SortMergeJoin" in p and "Exchange" not in p for p in plans)
    assert not [x for x in labels if x.startswith("blocks")]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("phrases_")]


def test_names_come_back_packed_by_block(monkeypatch):
    monkeypatch.setattr(ph, "NAME_ROWS", 5)
    own = [(b << ph.CODE_BITS) + c for b in (3, 1 << 20) for c in (7, 0, (1 << 30) - 1, 2)]
    found = pa.table({"own": own, "id": [x >> 1 for x in own]}).to_batches(3)
    held = [r for b in ph._held(iter(found)) for r in b.to_pylist()]
    assert len(held) > 2
    packed = pa.array([[{k: r[k] for k in ("codes", "ids")} for r in held if r["block"] == b] for b in (3, 1 << 20)])
    batch = pa.RecordBatch.from_arrays([pa.array([3, 1 << 20]), pa.array([b"s", b"t"]), packed], ["block", "seq", "names"])
    back = [r for b in ph._opened(lambda batches: batches)(iter([batch])) for r in b.to_pylist()]
    assert [(r["block"], r["seq"]) for r in back] == [(3, b"s"), (1 << 20, b"t")]
    assert sorted((r["block"] << ph.CODE_BITS) + n["code"] for r in back for n in r["names"]) == sorted(own)
    assert all(n["id"] == ((r["block"] << ph.CODE_BITS) + n["code"]) >> 1 for r in back for n in r["names"])
