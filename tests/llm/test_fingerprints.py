"""Fingerprints against a plain version that adds the vectors of a text's lines one by one."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from loglattice.llm import fingerprints as fp
from loglattice.llm import queries

DDL = "doc_id long, text string, hash string, bucket string, `a.b` string"


def prints(*texts):
    return fp.paragraphs_of(pa.array(texts, pa.large_string()))


def plain(text):
    """The sum of the lines' vectors, each hashed alone."""
    total = fp.Prints(np.zeros((1, fp.EXACT), np.uint64), np.zeros((1, fp.LANES), np.uint32))
    for line in text.split("\n"):
        total = total + prints(line)
    return total


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = plain(text), plain(edited), plain(after)
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), a.to_text()[0], b.to_text()[0], float(fp.likeness(a, b)[0]), float(fp.likeness(a, c)[0]))
    return out


def texts_of(n, seed=0):
    rng = random.Random(seed)
    words = ["ab", "é", "日本", "c", "lorem", "x1", "", "\U0001f600"]
    return ["\n".join(" ".join(rng.choices(words, k=rng.randrange(9))) for _ in range(rng.randrange(5))) for _ in range(n)]


def test_a_print_is_the_sum_of_its_lines():
    texts = [*texts_of(300), "", "\n", "\n\n", "a\n", "\na"]
    found = prints(*texts)
    for k, t in enumerate(texts):
        assert found.rows([k]).to_bytes() == plain(t).to_bytes()
    one = prints("two words")
    assert one.to_bytes()[0][: 8 * fp.EXACT] == hashlib.blake2b(b"two words", digest_size=64).digest()
    assert not prints(None).exact.any()
    assert fp.Prints.of_text(found.to_text()).to_bytes() == found.to_bytes()


def test_order_does_not_matter_and_repeats_do():
    a, b, c, d = (prints(t).to_text()[0] for t in ("x\ny\nz", "z\nx\ny", "x\ny\nz\nz", "x\ny"))
    assert a == b and len({a, c, d}) == 3
    assert (prints("x\ny\nz") - prints("z")).to_text()[0] == d
    assert (prints("x\ny") + prints("z")).to_text()[0] == a
    swapped = prints("a b\nc d"), prints("a d\nc b")
    assert swapped[0].to_text() != swapped[1].to_text() and fp.likeness(*swapped)[0] < 1


def test_likeness_follows_what_texts_share():
    rng = np.random.default_rng(1)
    w = [f"w{k}" for k in rng.integers(0, 100_000, 6000)]
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        n = int(2000 * share)
        a, b = w[:2000], w[:n] + w[2000 : 4000 - n]
        got = fp.likeness(prints(" ".join(a)), prints(" ".join(b)))[0]
        assert abs(got - share) < 0.2
    assert fp.likeness(prints("same"), prints("same"))[0] == 1
    assert fp.likeness(prints(""), prints("a b c"))[0] == 0
    assert fp.likeness(prints("a b c\n" * 50_000), prints("a b c\n" * 40_000))[0] > 0.99  # numbers that would not fit into 16 bits


@pytest.mark.parametrize("bucket_bytes", [1, 300, 1 << 20])
def test_neighbours_equal_brute_force(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(fp, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(fp, "SLICE_CHARS", 200)
    texts = [*texts_of(60, 2), "", None, "x", "long words\n" * 3000, "one line " * 20_000]
    ids = random.Random(3).sample(range(-500, 500), len(texts))
    rows = list(zip(ids, texts))
    d = spark.createDataFrame([(i, t, "h", "b", "c") for i, t in rows], DDL).repartition(3)
    got = {r.id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fp.edited_neighbours(d).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i][:4] == w[:4] and got[i][4:] == pytest.approx(w[4:])


@pytest.mark.parametrize("bucket_bytes", [1, 1 << 20])
def test_odd_rows(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(fp, "BUCKET_BYTES", bucket_bytes)
    rows = [(None, "x y\nz"), (None, "x y\nz"), (None, None), (7, "a"), (7, "a"), (7, "b"), (9, "")]
    got = fp.edited_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id is None, r.id, r.n_chars) for r in got if r.id is not None) == [(False, 7, 1)] * 3 + [(False, 9, 0)]
    assert sorted(r.n_chars for r in got if r.id is None) == [0, 5, 5]
    assert len({r.fingerprint for r in got}) == 4  # null and empty texts are one
    alone = fp.edited_neighbours(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone[0].near_next == 1
    assert fp.edited_neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprint_columns_and_changes(spark):
    docs = spark.createDataFrame([(1, "a\nb", "h", "b", "c"), (2, None, "h", "b", "c"), (3, "", None, None, None)], DDL).withColumnRenamed("hash", "Fingerprint")
    made = fp.fingerprints(docs)
    assert made.columns == ["doc_id", "text", "bucket", "a.b", "fingerprint"]
    before = {r.doc_id: r.fingerprint for r in made.collect()}
    assert before == {1: plain("a\nb").to_text()[0], 2: plain("").to_text()[0], 3: plain("").to_text()[0]}
    inserted = spark.createDataFrame([(1, "c"), (1, "c"), (2, None), (9, "x")], "doc_id long, paragraph string")
    deleted = spark.createDataFrame([(1, "a")], "doc_id long, paragraph string")
    after = {r.doc_id: r.fingerprint for r in fp.changed(made.select("doc_id", "fingerprint"), inserted, deleted).collect()}
    assert after == {1: plain("b\nc\nc").to_text()[0], 2: plain("\n").to_text()[0], 3: before[3]}
    assert fp.changed(made.limit(0).select("doc_id", "fingerprint"), inserted, deleted).count() == 0


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    want = brute([(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()])
    got = queries.op11_fingerprints(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == w[:4]
        assert (r.near_edited, r.near_next) == pytest.approx(w[4:])
    long = [r for r in got if r.n_chars > 1000]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97
