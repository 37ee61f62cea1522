"""Each training-data operator against a brute-force version on small rows, and on odd input."""

import re
import warnings
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loglattice.llm import bpe, decontam, line_dedup, mixing, neardup, pii, quality, queries, rules, token_counts, token_records, toxicity
from loglattice.llm import textkit as tk

DOCS = "doc_id long, text string, lang string, source string, score string"
ODD = [(1, None, "en", "a", "x"), (None, "one two three four five six seven", None, None, None), (2, "", "en", "a", "x"), (2, "", "en", "a", "x"), (3, "!!! ???", "de", None, "y"), (4, "é " * 3000, "fr", "b", None), (5, "a b", "en", "a", "z")]


def docs(spark, rows, ddl=DOCS):
    return spark.createDataFrame(rows, ddl)


def words(t):
    return re.findall(rb"[a-z0-9\x80-\xff]+", t.lower().encode())


def shingles(t):
    w = words(t)
    return Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else []))


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


def test_words_and_shingles_follow_the_rows():
    texts = ["", "a b", "a b c d e f", None, "a b c d e f", "é, ü. x"]
    h, off = tk.word_hashes(*tk.text_bytes(pa.array(texts)))
    assert np.diff(off).tolist() == [len(words(t or "")) for t in texts]
    s, s_off = tk.shingle_hashes(h, off)
    assert np.diff(s_off).tolist() == [0, 1, 2, 0, 2, 1]
    assert s[s_off[2] : s_off[3]].tolist() == s[s_off[4] : s_off[5]].tolist()


def test_pieces_encode_like_whole_texts(path):
    rng = np.random.default_rng(0)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "é", "!", ".", ",", "<|endoftext|>", " ", "　", "\x1c", "\r\n", "日本", " the"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 14))) for _ in range(5000)]
    e = bpe.PieceEncoder(path, memo_entries=400)
    ids, off = e.encode(*tk.text_bytes(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [x.tolist() for x in e.whole(texts)]


def test_counts_use_and_fill_the_cache(spark, path, tmp_path):
    from tokenizers import Tokenizer

    t, cache = Tokenizer.from_file(path), str(tmp_path / "cache")
    got = token_counts.count_tokens(docs(spark, ODD), path, cache).toPandas()
    assert len(got) == len(ODD) and "score" in got
    want = Counter((r[1], len(t.encode(r[1] or "", add_special_tokens=False).ids), len((r[1] or "").encode())) for r in ODD)
    assert Counter((None if pd.isna(a) else a, b, c) for a, b, c in zip(got.text, got.n_tokens, got.n_bytes)) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r[1] or "" for r in ODD})
    token_counts.count_tokens(docs(spark, ODD), path, cache).collect()
    assert stored.select("digest").distinct().count() == spark.read.parquet(cache).count()
    # A stored count is what is used.
    stored.withColumn("n_tokens", F.lit(7).cast("long")).write.parquet(str(tmp_path / "other"))
    assert {r.n_tokens for r in token_counts.count_tokens(docs(spark, ODD), path, str(tmp_path / "other")).collect()} == {7}


def thue_morse(levels):
    """A word over a and b and its complement: polynomial hashes modulo a power of two can't tell them apart."""
    t = "a"
    for _ in range(levels):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_structured_runs_apart():
    rng = np.random.default_rng(3)
    buf = rng.integers(0, 3, 60_000, dtype=np.uint8)
    start = rng.integers(0, 59_000, 8000)
    end = start + rng.integers(0, 400, 8000) ** 2 // 400
    found = {bytes(buf[a:b]): h for a, b, h in zip(start, end, tk.run_hashes(buf, start, end))}
    assert len(set(found.values())) == len(found)
    assert all(found[bytes(buf[a:b])] == h for a, b, h in zip(start, end, tk.run_hashes(buf, start, end)))
    for levels in range(1, 13):
        for times in (1, 2, 3):
            pair = [t * times for t in thue_morse(levels)]
            b, off = tk.text_bytes(pa.array(pair))
            assert len(set(tk.run_hashes(b, off[:-1], off[1:]).tolist())) == 2


def test_equal_hashes_do_not_share_ids(path, monkeypatch):
    texts = [f"w{k} and {k * k}, {'x' * (k % 90)}." for k in range(400)]
    monkeypatch.setattr(tk, "run_hashes", lambda buf, a, b: ((b - a) % 3).astype(np.uint64))
    e = bpe.PieceEncoder(path)
    ids, off = e.encode(*tk.text_bytes(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [x.tolist() for x in e.whole(texts)]


def test_structured_texts_in_the_operators(spark, path, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rows = [(n, x, "en", "a", "s") for n, x in enumerate([x * times for times in (1, 2) for x in thue_morse(10)])]
    want = {n: t.encode(x, add_special_tokens=False).ids for n, x, *_ in rows}
    counts = token_counts.count_tokens(docs(spark, rows), path, str(tmp_path / "cache")).collect()
    assert {r.doc_id: r.n_tokens for r in counts} == {n: len(x) for n, x in want.items()}
    token_records.write_records(docs(spark, rows), str(tmp_path / "records"), path)
    records = token_records.read_records(spark, str(tmp_path / "records")).collect()
    assert {r.doc_id: r.ids_crc32 for r in records} == {n: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for n, x in want.items()}
    leaks = decontam.leaks(docs(spark, rows), spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")).collect()
    assert {r.doc_id for r in leaks} == {0}
    assert {r.class_id for r in neardup.near_duplicates(docs(spark, rows)).collect()} == {0, 1, 2, 3}


def crc32c(b):
    c = 0xFFFFFFFF
    for x in b:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc32c():
    assert crc32c(b"123456789") == 0xE3069283
    rng = np.random.default_rng(1)
    runs = [rng.integers(0, 256, 2 * n, dtype=np.uint8).tobytes() for n in (1, 2, 3, 5, 8, 31, 200)]
    off = np.concatenate([[0], np.cumsum([len(r) // 2 for r in runs])])
    assert token_records.crc32c_words(np.frombuffer(b"".join(runs), "<u2"), off).tolist() == [crc32c(r) for r in runs]


def test_records_round_trip(spark, path, tmp_path):
    from tokenizers import Tokenizer

    t, folder = Tokenizer.from_file(path), str(tmp_path / "records")
    token_records.write_records(docs(spark, ODD), folder, path, file_bytes=500)
    rows = sorted(token_records.read_records(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 5]
    text = {r[0]: r[1] for r in ODD}
    at = 0
    for r in rows:
        ids = t.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    name = rows[-1].file
    raw = bytearray((tmp_path / "records" / f"{name}.rec").read_bytes())
    raw[-5] ^= 1
    (tmp_path / "records" / f"{name}.rec").write_bytes(bytes(raw))
    with pytest.raises(ValueError):
        list(token_records.read_file(folder, name, 2))
    assert token_records.write_records(docs(spark, []), str(tmp_path / "none"), path).count() == 0


def test_toxicity_learns_marked_words(spark):
    rng = np.random.default_rng(0)
    plain = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su", "no") for b in ("ndo", "stra", "pel", "vik", "mure", "ta", "gen")]
    bad = ["gruntfask", "blorvik", "zaxhund"]
    texts, labels = [], []
    for k in range(400):
        label = k % 4 == 0
        w = rng.choice(plain, 60).tolist()
        for i in rng.integers(0, 60, 4) if label else []:
            w[i] = bad[rng.integers(0, 3)]
        texts.append(" ".join(w))
        labels.append(int(label))
    model = toxicity.fit(texts[:300], labels[:300])
    p = model.score(texts[300:]) >= 0.5
    assert (p == np.array(labels[300:], bool)).mean() > 0.95
    got = toxicity.classify(docs(spark, ODD), model).toPandas()
    assert len(got) == len(ODD) and got.predicted.sum() == 0 and got.score.dtype == float  # the column of the same name is replaced
    assert toxicity.reject_toxic(docs(spark, ODD), model).columns == docs(spark, ODD).columns
    assert toxicity.fit([], []).score(["x"]).tolist() == [0.0]
    assert toxicity.fit(["a b"], [1]).score(["x", ""]).tolist() == [1.0, 1.0]
    assert model.score(["", "!"]).tolist() == [model.share, model.share]


def test_windows_cover_the_words_and_long_texts_come_in_parts(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(rng.choice(list("abcdé"), rng.integers(1, 40))) for _ in range(rng.integers(0, 60))) for _ in range(50)] + ["", "x" * 100, "?"]
    col = pa.array(texts, pa.large_string())
    out, starts, row = toxicity.windows(*tk.text_bytes(col))
    got = [b"" for _ in texts]
    for s, e, r in zip(starts[:-1], starts[1:], row):
        assert e - s <= 2 * toxicity.WINDOW + 1
        got[r] += out[s:e].tobytes()
    assert got == [b"".join(b" " + w for w in words(t)) for t in texts]
    model = toxicity.fit(["good words of a kind " * 3] * 30 + ["bad gruntfask words " * 3] * 30, [0] * 30 + [1] * 30)
    whole = model.counts(col)
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 1 << 9)
    np.testing.assert_allclose(np.expm1(model.counts(col))[:, 0], np.expm1(whole)[:, 0], atol=6)


def test_training_rows(spark, monkeypatch):
    """Repeated labels and rows, nulls, an empty table, and a long text that a sample of its windows stands for."""
    monkeypatch.setattr(toxicity, "TRAIN_WINDOWS", 50)
    rows = [(k, f"plain words number {k} of an ordinary text") for k in range(60)] + [(k, f"gruntfask {k} words of a zaxhund text") for k in range(60, 120)]
    rows += [(60, "gruntfask again"), (0, " ".join(f"word{j}" for j in range(3000))), (None, "gruntfask"), (119, None)]
    marks = [(k, int(k >= 60)) for k in range(120)] + [(61, 0), (62, None), (None, 1), (500, 1)]
    d, m = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(d, m)
    got = {r.doc_id: r.predicted for r in toxicity.classify(d.filter("doc_id > 0 and text is not null"), model).collect()}
    assert sum(got[k] == int(k >= 60) for k in got) >= 0.95 * len(got)
    assert toxicity.train(d.limit(0), m).share == 0 and toxicity.train(d, m.limit(0)).share == 0
    assert toxicity.classify(d.limit(0), model).count() == 0
    clash = d.withColumn("__ll_score", F.lit(5))
    assert {r["__ll_score"] for r in toxicity.classify(clash, model).collect()} == {5} and toxicity.reject_toxic(clash, model).columns == clash.columns


def test_toxicity_on_held_out_rows(spark):
    """The query's contract and its held-out figures on the smallest tables with enough labels."""
    sf = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    caught = got[got.toxic == 1].predicted.mean()
    spared = 1 - got[got.toxic == 0].predicted.mean()
    assert caught >= 0.65 and spared >= 0.99, (caught, spared)  # with 8,000 training rows 0.98 and 0.998


def test_pseudonyms_keep_format_and_link(spark):
    def luhn(s):
        d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
        return sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0

    cards = ["4111 1111 1111 1111", "4111111111111111", "378282246310005"]
    rows = [(1, f"pay {cards[0]}, {cards[1]} or {cards[2]}; not 4111111111111112"), (2, "on 2024-02-29, not 2023-02-29; 01/12/1999"), (3, "ssn 123-45-6789 not 000-12-3456 ip 10.0.0.1 not 300.0.0.1"), (4, "call +1 (212) 555-0123 mail a.bc@x.example"), (5, None), (6, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(d, "k").collect()}
    a, b, c = re.search(r"pay (.*), (.*) or (.*); not 4111111111111112$", got[1].text).groups()
    assert a.replace(" ", "") == b and luhn(a) and luhn(c) and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", a) and len(c) == 15 and b != cards[1]
    assert (got[1].n_card, got[2].n_date, got[3].n_ssn, got[3].n_ip, got[4].n_phone, got[4].n_email) == (3, 2, 1, 1, 1, 1)
    assert "not 2023-02-29" in got[2].text and "not 000-12-3456" in got[3].text and "not 300.0.0.1" in got[3].text and got[4].text.endswith("@x.example")
    assert got[5].text is None and got[6].text == ""
    assert pii.pseudonymise(d, "k").collect()[0].text == got[1].text != pii.pseudonymise(d, "other").collect()[0].text
    # A permutation: all three-digit tails of one prefix stay apart.
    many = spark.range(2000).selectExpr("id as doc_id", "date_format(date_add(date'1990-01-01', cast(id as int)), 'yyyy-MM-dd') as text")
    out = pii.pseudonymise(many, "k")
    assert out.select("text").distinct().count() == 2000 and out.filter("n_date = 1").count() == 2000


def brute_lines(rows):
    lines = {}
    for i, t in sorted(rows):
        lines[i] = [(k, x.strip(" \t\r\x0b\f")) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\f")]
    seen, gone = set(), {}
    for i in sorted(lines):
        for k in range(len(lines[i]) - 2):
            w = tuple(x for _, x in lines[i][k : k + 3])
            if w in seen:
                gone.setdefault(i, set()).update(p for p, _ in lines[i][k : k + 3])
            seen.add(w)
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone.get(i, ())) for i, t in rows}


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "\n".join(rng.choice(["a", "b", " ", "c ", ""], rng.integers(0, 12)))) for k in range(60)] + [(100, None), (101, "x\ny\nz"), (102, "p\nx\n\ny\nz\nq")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(d).collect()}
    assert got == brute_lines(rows)
    twice = line_dedup.remove_repeats(docs(spark, [*ODD, (9, "x\ny\nz", None, None, None), (9, "x\ny\nz", None, None, None)])).collect()
    assert [r.n_removed for r in twice if r.doc_id == 9] == [0, 0]
    assert line_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_ordinal_model_orders_grades(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 300)
    texts = [" ".join(rng.choice([["bad", "worse"], ["so", "fair"], ["good", "fine"]][k], 20)) for k in y]
    model = quality.fit(texts[:200], y[:200].tolist(), steps=150)
    assert (np.diff(model.thresholds) > 0).all()
    z = model.latent(texts[200:])
    assert np.corrcoef(model.expected(z), y[200:])[0, 1] > 0.95 and ((model.tails(z) >= 0.5).sum(axis=1) == y[200:]).mean() > 0.95
    got = quality.rate(docs(spark, ODD), model, at_least=1).toPandas()
    assert len(got) == len(ODD) and got.tail_probability.between(0, 1).all()
    assert quality.fit([], []).expected(np.zeros(2)).tolist() == [0, 0]


def test_rules_on_odd_rows(spark):
    got = rules.apply_rules(docs(spark, ODD)).toPandas()
    assert len(got) == len(ODD) and not got.kept[got.base_failed].any() and got.n_words.tolist().count(3000) == 1
    assert got.base_failed[got.n_words == 3000].all()  # one word over and over
    assert rules.apply_rules(docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_of_operators(spark, name):
    from compare import assert_same

    assert_same(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.001")


def test_raking_meets_its_marginals(spark):
    rng = np.random.default_rng(0)
    rows = [(s, g, t, int(n)) for s in "abcd" for g in ("en", "de") for t in ("x", "y", "z") for n in [rng.integers(50, 5000)]]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").withColumn("n_docs", F.lit(1).cast("long"))
    got = mixing.rake(cells, mixing.DIMS, keep=0.5).toPandas()
    assert got.probability.between(0, 1).all()
    total = got.tokens.sum()
    for d in mixing.DIMS:
        have = got.groupby(d).tokens.sum()
        target = have**0.7
        target = np.minimum(target / target.sum() * 0.5 * total, have)
        assert np.allclose((got.tokens * got.probability).groupby(got[d]).sum(), target, rtol=0.02)
    want = spark.createDataFrame([("en", 3.0), ("de", 1.0)], "value string, share double")
    got = mixing.rake(cells, mixing.DIMS, keep=0.2, targets={"lang": want}).toPandas()
    by = (got.tokens * got.probability).groupby(got.lang).sum()
    assert by["en"] / by["de"] == pytest.approx(3, rel=0.02)


def test_raking_ends_at_its_targets_or_warns(spark):
    ddl = "source string, lang string, topic string, tokens long, n_docs long"
    # Forty small categories run out one after the other.
    cells = spark.createDataFrame([(f"s{k:02}", "en", "x", 2**k, 1) for k in range(40)], ddl)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = mixing.rake(cells, mixing.DIMS, keep=0.9, temper=0.0).toPandas()
    assert (got.tokens * got.probability).sum() == pytest.approx(0.9 * (2**40 - 1), rel=1e-3)
    # Targets that the cells cannot meet together.
    cells = spark.createDataFrame([("a", "en", "x", 1000, 1), ("b", "de", "x", 1000, 1)], ddl)
    share = lambda a, b: spark.createDataFrame([(a, 3.0), (b, 1.0)], "value string, share double")
    with pytest.warns(UserWarning, match="off their targets"):
        mixing.rake(cells, mixing.DIMS, keep=0.2, targets={"source": share("a", "b"), "lang": share("de", "en")}).collect()


def test_sampling_on_odd_rows(spark):
    d = docs(spark, ODD)
    got = mixing.inclusion(d).toPandas()
    assert len(got) == len(ODD) and got.probability.between(0, 1).all()
    assert mixing.sample(d).columns == d.columns and mixing.sample(docs(spark, [])).count() == 0
    same = got[got.doc_id == 2].kept.tolist()
    assert same[0] == same[1]


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    vocab = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocab, n))) for k, n in enumerate((5, 8, 20, 20, 45))] + [(9, "too short"), (10, None)]
    texts = []
    for k in range(40):
        w = rng.choice(vocab, rng.integers(0, 120)).tolist()
        if k % 3 == 0:
            item = items[k % 5][1].upper().split()
            if k % 2:
                item = item[1:] + ["zzz"]  # a shift by one word
            w[5:5] = item
        texts.append((k, ", ".join(w)))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in texts:
        s = [tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)]
        for j, x in items:
            bag = shingles(x) if x and len(words(x)) >= 5 else None
            for k in range(len(s) - sum(bag.values()) + 1) if bag else ():
                both = sum((Counter(s[k : k + sum(bag.values())]) & bag).values())
                sim = both / (2 * sum(bag.values()) - both)
                if sim >= 0.8:
                    want[i, j] = max(sim, want.get((i, j), 0))
    assert got == pytest.approx(want) and len(want) > 8
    odd = docs(spark, ODD)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.decontaminate(odd, bench).count() == len(ODD) and decontam.decontaminate(odd, bench).columns == odd.columns
    assert decontam.leaks(odd, bench.limit(0)).count() == 0


def test_a_text_that_is_an_item_with_words_missing_is_a_leak(spark):
    w = [f"w{k}" for k in range(60)]
    bench = spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    texts = [(1, " ".join(w[:-1])), (2, " ".join(w[3:])), (3, " ".join(w[:50])), (4, " ".join(w[:48])), (5, " ".join(w[:40])), (6, " ".join(w))]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.first_word, r.n_words, r.similarity) for r in decontam.leaks(d, bench).collect()}
    assert got == {1: (0, 59, pytest.approx(55 / 56)), 2: (0, 57, pytest.approx(53 / 56)), 3: (0, 50, pytest.approx(46 / 56)), 6: (0, 60, 1.0)}
    assert sorted(r.doc_id for r in decontam.decontaminate(d, bench).collect()) == [4, 5]


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    index = decontam.ItemIndex([str(k) for k in range(8)], [" ".join(f"x{k}y{j}" for j in range(9)) for k in range(8)])
    _, fp, _ = index.tables[5]
    prints = np.concatenate([fp ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for n in range(0, 25)])
    w, i, d = index.candidates(5, prints)
    want = {(a, b) for a in range(len(prints)) for b in range(8) if int(np.bitwise_count(prints[a] ^ fp[b])) <= decontam.RADIUS}
    assert set(zip(w.tolist(), i.tolist())) == want


def test_recall_of_leaks_at_a_similarity_of_eight_tenths(spark):
    """One word of fifty replaced: 41 of 51 shingles are shared.  The share found is measured, 0.9 at least."""
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(5000)]
    items, texts = [], []
    for k in range(300):
        w = rng.choice(vocab, 50).tolist()
        items.append((k, " ".join(w)))
        w[25] = "zzz"
        texts.append((k, " ".join([*rng.choice(vocab, 30), *w, *rng.choice(vocab, 30)])))
    found = decontam.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r.doc_id == r.item_id and r.first_word == 30 and r.similarity == pytest.approx(41 / 51) for r in found)
    assert len(found) >= 270


def test_items_in_several_blocks_short_items_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 2)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(7)] + [(8, "Yes, it is"), (9, ""), (3, None), (0, " ".join(f"i0w{j}" for j in range(12)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(None, items[2][1], 1), (1, "before " + items[5][1], 2), (1, "yes it is", 3), (2, "yes it is not so", 4), (4, items[0][1], 5), (4, items[0][1], 6), (6, None, 7), (7, "", 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, __ll_id int")
    got = sorted(((r.doc_id, r.item_id, r.first_word, r.n_words, r.similarity) for r in decontam.leaks(d, bench).collect()), key=str)
    assert got == sorted([(None, 2, 0, 12, 1.0), (1, 5, 1, 12, 1.0), (1, 8, 0, 3, 1.0), (4, 0, 0, 12, 1.0), (4, 0, 0, 12, 1.0)], key=str)
    kept = decontam.decontaminate(d, bench)
    assert kept.columns == d.columns and sorted(r["__ll_id"] for r in kept.collect()) == [4, 7, 8]
    assert decontam.decontaminate(d.limit(0), bench).count() == 0


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    a, b = np.arange(1, 301, dtype=np.uint64), np.arange(51, 351, dtype=np.uint64)
    x, y = rng.integers(1, 5, 300), rng.integers(1, 5, 300)
    exact = neardup.probability_jaccard(a, x, b, y)
    brute = 0.0
    wx, wy = dict(zip(a.tolist(), x.tolist())), dict(zip(b.tolist(), y.tolist()))
    for d in set(wx) & set(wy):
        brute += 1 / sum(max(wx.get(e, 0) / wx[d], wy.get(e, 0) / wy[d]) for e in set(wx) | set(wy))
    assert exact == pytest.approx(brute)
    who = neardup.prob_minhash(np.concatenate([a, b]), np.concatenate([x, y]), np.array([0, 300, 600]), 2048)
    assert abs((who[0] == who[1]).mean() - exact) < 0.04


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    vocab = [f"w{k}" for k in range(3000)]
    rows = []
    for g in range(12):
        base = rng.choice(vocab, 120).tolist()
        for k in range(rng.integers(1, 6)):
            w = list(base)
            for i in rng.integers(0, 120, rng.integers(0, 4)):
                w[i] = "edit" + str(rng.integers(0, 10**6))
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), rows[0][1].upper()), (len(rows) + 1, rows[3][1])]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bags = {i: shingles(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, _ in rows:
        for j in range(i):
            both = len(set(bags[i]) & set(bags[j]))
            if both / (len(bags[i]) + len(bags[j]) - both) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i, _ in rows}


def test_deduplication_on_odd_rows(spark):
    d = docs(spark, ODD)
    kept = neardup.deduplicate(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0)]
    marked = neardup.near_duplicates(d).toPandas()
    assert len(marked) == len(ODD) and marked[marked.doc_id.isin([1, 2])].class_id.eq(1).all()
    assert neardup.deduplicate(docs(spark, [])).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(f"n{a:03d}", f"n{b:03d}") for a, b in rng.integers(0, 80, (50, 2))] + [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(links, "u string, v string"), tk.Scratch(spark, "components")).collect()}
    assert set(got) == set(root)
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in root for b in root)


def test_a_large_group_about_the_threshold(spark):
    """Near copies of one text whose similarities lie on both sides of 0.8: no link is lost."""
    rng = np.random.default_rng(1)
    vocab = [f"w{k}" for k in range(3000)]
    base = rng.choice(vocab, 150).tolist()
    rows = []
    for k in range(150):
        w = list(base)
        for i in rng.integers(0, 150, rng.integers(0, 6)):
            w[i] = "e" + str(rng.integers(0, 10**7))
        rows.append((k, " ".join(w)))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bags = [set(shingles(t)) for _, t in rows]
    root = list(range(150))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(150):
        for j in range(i):
            both = len(bags[i] & bags[j])
            if both / (len(bags[i]) + len(bags[j]) - both) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(150)}


def test_columns_with_the_operators_own_names_are_kept(spark, path, tmp_path):
    names = ["__t", "__b", "__h", "__th", "__m", "__l", "__ll_t", "__ll_tokens", "__LL_row", "fences", "limits", "ratio", "node", "text2"]
    clash = docs(spark, ODD).select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    made = {
        "rules": rules.apply_rules(clash), "pii": pii.pseudonymise(clash, "k"), "lines": line_dedup.remove_repeats(clash), "mix": mixing.inclusion(clash), "sample": mixing.sample(clash),
        "tokens": token_counts.count_tokens(clash, path, str(tmp_path / "cache")), "dedup": neardup.deduplicate(clash), "quality": quality.rate(clash, quality.fit([], [])),
    }
    for op, df in made.items():
        assert set(clash.columns) <= set(df.columns), op
        assert all(tuple(r[c] for c in names) == tuple(range(len(names))) for r in df.collect()), op


def test_telephone_numbers_and_addresses_stay_possible(spark):
    rows = [(0, "call (212) 555-0123 or +1 212-555-0123"), (1, "call (112) 555-0123"), (2, "at 010.0.0.1 and 10.0.0.1"), (3, "+44 123-456-7890"), (4, "call 212-155-0123")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    first, second = re.findall(r"[0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}", got[0].text)
    assert re.sub(r"\D", "", first) == re.sub(r"\D", "", second) != "2125550123" and re.fullmatch(r"[2-9]\d\d[2-9]\d{6}", re.sub(r"\D", "", first)) and got[0].n_phone == 2
    assert got[1].text == rows[1][1] and got[4].text == rows[4][1] and got[2].n_ip == 1 and "010.0.0.1" in got[2].text
    assert got[3].text != rows[3][1] and got[3].text.startswith("+44 ")
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.format_string("(%d) 555-%04d", 200 + F.col("id") % 800, F.col("id")).alias("text"))
    assert pii.pseudonymise(many, "k").select("text").distinct().count() == 2000


def test_limits_of_groups_differ_and_decide(spark):
    """Repeated lines: common in one source, rare in another; the same text is judged by its source."""
    plain = lambda k: "\n".join(f"line {k:04} {j} of text" for j in range(6))
    twice = lambda k: plain(k) + f"\nline {k:04} 0 of text\nline {k:04} 3 of text"
    rows = [(k, twice(k) if k % 5 == 0 else plain(k), "en", "forum") for k in range(400)] + [(1000 + k, twice(k) if k % 400 == 0 else plain(k), "en", "news") for k in range(1600)]
    got = rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().set_index("doc_id")
    assert got.kept[0] and not got.kept[1000] and got.kept.sum() == 1996
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    p = tk.fresh(d)
    good = rules.base_statistics(d, "text", p).select("lang", "source", *[c.alias(r) for r, c in rules.ratios(f"{p}b").items()])
    found = {r.source: r.limits["dup_lines"].high for r in rules.limits(rules.sketches(good)).collect()}
    assert found["news"] == 0 < found["forum"]


def feistel(l, r, a, b, key, *tweak):
    """The permutation by its definition, in Python."""
    import hashlib

    def prf(i, v, n):
        return int(hashlib.sha256("|".join(map(str, [key, *tweak, i, v, n])).encode()).hexdigest()[:15], 16) % n

    for i in range(1, pii.ROUNDS // 2 + 1):
        l = (l + prf(2 * i, r, a)) % a
        r = (r + prf(2 * i + 1, l, b)) % b
    return l, r


def test_pseudonyms_equal_a_plain_feistel_network(spark):
    import datetime

    rng = np.random.default_rng(0)
    ips = [tuple(map(int, rng.integers(0, 256, 4))) for _ in range(40)]
    days = [datetime.date(1800, 1, 1) + datetime.timedelta(int(d)) for d in rng.integers(0, 146_097, 40)]
    phones = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(200, 1000, 40), rng.integers(200, 1000, 40), rng.integers(0, 10_000, 40))]
    rows = [(k, f"{'.'.join(map(str, ip))} on {d.isoformat()} by ({p[0]}) {p[1]}-{p[2]:04}") for k, (ip, d, p) in enumerate(zip(ips, days, phones))]
    want = []
    for ip, d, p in zip(ips, days, phones):
        x, y = feistel(ip[0] * 256 + ip[1], ip[2] * 256 + ip[3], 65536, 65536, "k", "ip")
        n = (d - datetime.date(1800, 1, 1)).days
        u, v = feistel(n // 773, n % 773, 189, 773, "k", "date")
        a, b = feistel(p[0] - 200, (p[1] - 200) * 10_000 + p[2], 800, 8_000_000, "k", "phone")
        b = f"{b + 2_000_000:07}"
        want.append(f"{x // 256}.{x % 256}.{y // 256}.{y % 256} on {(datetime.date(1800, 1, 1) + datetime.timedelta(u * 773 + v)).isoformat()} by ({a + 200}) {b[:3]}-{b[3:]}")
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert [got[k] for k in range(40)] == want


def test_ordinal_fit_is_a_least_loss():
    """The loss, written out text by text, is not lowered by moving a threshold or the weights."""
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 60)
    texts = [" ".join(rng.choice(["bad", "fair", "good"], 12, p=[[0.6, 0.3, 0.1], [0.2, 0.6, 0.2], [0.1, 0.3, 0.6]][k])) for k in y]
    model = quality.fit(texts, y.tolist(), steps=3000)

    def loss(thresholds, weight):
        total = 0.0
        for t, k in zip(texts, y):
            _, slot, value = quality.features(*tk.text_bytes(pa.array([t])))
            cut = np.concatenate([[-np.inf], thresholds, [np.inf]]) - (value * weight[slot]).sum()
            hi, lo = 1 / (1 + np.exp(-cut[k + 1])), 1 / (1 + np.exp(-cut[k]))
            total -= np.log(hi - lo) / len(y)
        return total + quality.RIDGE / 2 * (weight**2).sum()

    best = loss(model.thresholds, model.weight)
    used = np.unique(np.concatenate([quality.features(*tk.text_bytes(pa.array([t])))[1] for t in texts]))
    for k in range(20):
        step = np.zeros_like(model.weight)
        step[used] = rng.normal(0, 0.1, len(used))
        assert loss(model.thresholds, model.weight + step) > best - 1e-4
    for move in ([0.1, 0], [-0.1, 0], [0, 0.1], [0, -0.1]):
        assert loss(model.thresholds + np.array(move), model.weight) > best - 1e-4


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 500 and ((got.tail_probability >= 0.5) == (got.quality == 1)).mean() >= 0.98


def test_quality_training_rows(spark):
    """Repeated ratings and rows, nulls, an empty table and a text longer than is used whole."""
    rows = [(k, f"good fine nice text {k}") for k in range(40)] + [(k, f"bad worse awful text {k}") for k in range(40, 80)] + [(0, "good " * 30_000), (None, "bad"), (79, None)]
    marks = [(k, int(k < 40)) for k in range(80)] + [(1, 1), (2, None), (None, 1)]
    d, m = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    got = quality.rate(d.filter("doc_id > 0"), quality.train(d, m)).toPandas()
    assert (got.selected == (got.doc_id < 40))[got.text.notna()].mean() > 0.95
    assert quality.train(d.limit(0), m).grades.tolist() == [0] and quality.train(d, m.limit(0)).grades.tolist() == [0]
    assert quality.rate(d.limit(0), quality.train(d, m)).count() == 0
