"""The corpus pipeline and each of its stages against brute-force versions."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loglattice.llm import mixing, neardup, queries, toxicity
from loglattice.llm import textkit as tk

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.toPandas().sort_values("doc_id")


def shingles(text):
    w = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode())
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])


def probability_jaccard(a, b):
    """By its definition, element by element."""
    both = a.keys() & b.keys()
    total = 0.0
    for i in both:
        total += 1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys())
    return total


def test_toxicity_stage(spark, docs, rows):
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == COLUMNS
    marks = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    marks = marks[[zlib.crc32(str(i).encode()) % 5 != 0 for i in marks.doc_id]]
    used = rows.merge(marks[["doc_id", "toxic"]], on="doc_id")
    model = toxicity.fit(used.text.tolist(), used.toxic.tolist())
    want = rows.doc_id[model.score(rows.text.tolist()) < 0.5].tolist()
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == want


def test_training_rows_stay_off_the_driver(spark, docs, rows, monkeypatch):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    marks = labels.toPandas()
    marks = marks[[zlib.crc32(str(i).encode()) % 5 != 0 for i in marks.doc_id]]
    used = rows.merge(marks[["doc_id", "toxic"]], on="doc_id")
    want = toxicity.fit(used.text.tolist(), used.toxic.tolist())
    nothing = toxicity.fit([], [])

    def refuse(*_):
        raise AssertionError("the driver trains, or gets the rows")

    monkeypatch.setattr(toxicity, "fit", lambda texts, marks: refuse() if len(marks) else nothing)
    monkeypatch.setattr(type(docs), "toArrow", refuse)
    got = toxicity.train(docs, labels)
    assert (got.ordinary, got.toxic, got.share) == (want.ordinary, want.toxic, want.share) and np.allclose(got.weight, want.weight)
    assert toxicity.train(docs.limit(0), labels).share == toxicity.train(docs, labels.limit(0)).share == 0


def test_components_of_many_rounds_write_two_tables_a_round(spark, monkeypatch):
    rng = np.random.default_rng(3)
    names = rng.permutation(600)
    # Chains of 300, 100 and 2 nodes in any order of their names, and a star.
    links = [(int(names[k]), int(names[k + 1])) for k in range(402) if k not in (299, 399, 401)] + [(int(names[450]), int(names[k])) for k in range(451, 500)]
    labels, write = [], tk.Scratch._write
    monkeypatch.setattr(tk.Scratch, "_write", lambda self, df, path: labels.append(path.rsplit("-", 1)[-1]) or write(self, df, path))
    run = tk.Scratch(spark, "components-test")
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(links, "u int, v int"), run).collect()}
    run.clear()
    up = {x: x for pair in links for x in pair}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in links:
        up[find(u)] = find(v)
    assert got.keys() == up.keys()
    assert {(find(x), r) for x, r in got.items()} == {(find(r), r) for r in got.values()} and len(set(got.values())) == len({find(x) for x in up})
    rounds = labels.count("moved")
    assert rounds >= 4 and len(labels) <= 2 * rounds + rounds // 4 + 3


def test_near_duplicate_stage(spark, docs, rows):
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == COLUMNS
    bags = [Counter(shingles(t)) for t in rows.text]
    ids, root = rows.doc_id.tolist(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(bags)):
        for j in range(i):
            a, b = bags[i], bags[j]
            shared = sum(1 for k in a if k in b)
            # At most the share of common elements: far pairs need no exact value.
            if (a or b) and shared >= 0.5 * min(len(a), len(b)) and probability_jaccard(a, b) >= 0.8 or not a and not b and rows.text.iloc[i] == rows.text.iloc[j]:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [ids[k] for k in range(len(ids)) if find(k) == k]


def test_decontamination_stage(spark, docs, rows):
    kept = corpus_pipeline.drop_benchmark_leaks(spark, docs, SF)
    assert kept.columns == COLUMNS
    items = [Counter(shingles(t)) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text]
    known = set().union(*items)

    def leaks(text):
        s = shingles(text)
        for item in items:
            size = sum(item.values())
            span = min(size, len(s))
            for k in {max(0, p - d) for p, x in enumerate(s) if x in item for d in range(span)}:
                if span and k + span <= len(s):
                    both = sum((Counter(s[k : k + span]) & item).values())
                    if both / (size + span - both) >= 0.8:
                        return True
        return False

    want = [i for i, t in zip(rows.doc_id, rows.text) if known.isdisjoint(shingles(t)) or not leaks(t)]
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == want and len(want) < len(rows)


def raked(cells, dims):
    """Iterative proportional fitting with probabilities of 1 at most, in numpy."""
    tokens = cells.tokens.to_numpy(float)
    goal, p = mixing.KEEP * tokens.sum(), np.full(len(cells), mixing.KEEP)
    places = [cells[d].to_numpy() for d in dims]
    targets = []
    for at in places:
        have = pd.Series(tokens).groupby(at).sum()
        t = have**mixing.TEMPER
        t = np.minimum(t * goal / t.sum(), have)
        for _ in range(1000):
            full = t >= have
            if not (~full).any() or t.sum() >= goal * (1 - 1e-12):
                break
            t = np.where(full, t, np.minimum(have, t * max(1, (goal - t[full].sum()) / t[~full].sum())))
            t = pd.Series(t, index=have.index)
        targets.append(t)
    for _ in range(20_000):
        for at, t in zip(places, targets):
            mass = pd.Series(tokens * p).groupby(at).sum()
            p = np.minimum(1, p * (t / mass).reindex(at).fillna(1).to_numpy())
    return p


def test_mixing_stage(spark, docs, rows):
    kept = corpus_pipeline.mix_sources(spark, docs, SF)
    assert kept.columns == COLUMNS
    got = mixing.inclusion(docs).toPandas().set_index("doc_id")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(got.index[got.kept])
    got["tokens"] = [-(-len(t.encode()) // 4) for t in got.text.fillna("")]
    cells = got.groupby(["source", "lang", "topic"]).agg(tokens=("tokens", "sum"), p=("probability", "first")).reset_index()
    want = raked(cells, ["source", "lang", "topic"])
    for d in ("source", "lang", "topic"):
        mine, best = ((cells.tokens * p).groupby(cells[d]).sum() for p in (cells.p, want))
        assert np.allclose(mine, best, rtol=0.03, atol=5), d


def test_token_stage(spark, docs, rows):
    from tokenizers import Tokenizer

    t, at, want = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for i, text in zip(rows.doc_id, rows.text.fillna("")):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = corpus_pipeline.write_token_records(spark, docs, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == want


def test_run_is_the_stages_one_after_the_other(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_records"]
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SF)
    pick = lambda df: sorted(map(tuple, df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    got = pick(corpus_pipeline.run(spark, SF))
    assert got == pick(step) and 0 < len(got) < docs.count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, texts, languages and sources, empty and very long texts, repeated rows, no rows at all, and a clashing column."""
    long = " ".join(f"word{k % 977} of {k}" for k in range(60_000))
    odd = [(None, "a text without an id, of nine words here", "en", "a", 1), (1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, long, "de", "b", 9), (4, long, "de", "b", 9), (5, "?!", "fr", None, 2), (6, "two words", "fr", "a", 3)]
    frame = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__ll_id", F.lit(7))
    for rows in (frame, frame.limit(0)):
        step = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, step, SF)
            assert out.columns == rows.columns, name
            assert out.count() <= step.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == rows.count()
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, SF).select("doc_id").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (False, 5), (False, 6), (True, 0)]
