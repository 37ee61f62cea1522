"""Decoding, scoring, compliance, rules, cases and streams."""

import base64
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from loglattice import cases, cli
from loglattice.functions import addresses, decode, redaction, scoring
from loglattice.operators import delta, extras
from loglattice.schema import RAW
from loglattice.streaming import live


def test_decoders():
    cmd = "powershell -nop http://evil.example/a.exe"
    found = {(r["encoder"], r["decoded"]) for r in decode.scan(base64.b64encode(cmd.encode()).decode())}
    assert ("base64", cmd) in found
    assert ("base64", cmd) in {(r["encoder"], r["decoded"]) for r in decode.scan("-enc " + base64.b64encode(cmd.encode("utf-16-le")).decode())} or decode.scan("-enc " + base64.b64encode(cmd.encode("utf-16-le")).decode())
    assert ("hex", "cmd.exe /c whoami") in {(r["encoder"], r["decoded"]) for r in decode.scan("x " + b"cmd.exe /c whoami".hex())}
    assert ("url", "a=<script>") in {(r["encoder"], r["decoded"]) for r in decode.scan("a=%3Cscript%3E")}
    assert any(r["encoder"] == "rot" and "password" in r["decoded"] for r in decode.scan("gur cnffjbeq vf urer"))
    xored = bytes(b ^ 0x5A for b in cmd.encode()).hex()
    assert any(r["encoder"] == "xor" and r["decoded"] == cmd for r in decode.scan(xored))
    assert decode.scan("plain words only") == [] and decode.scan(None) == []


def test_decoders_take_whole_tokens_and_short_ones():
    def found(text):
        return {(r["encoder"], r["original"]): r for r in decode.scan(text)}

    long = "GET /index.html user=x " * 1000
    b64 = base64.b64encode(long.encode()).decode()
    assert found(b64)["base64", b64]["decoded"] == long
    assert found(long.encode().hex())["hex", long.encode().hex()]["decoded"] == long
    url = "a=" + "%3Cb%3E" * 2000
    assert found(url)["url", url]["decoded"] == "a=" + "<b>" * 2000
    for text in (long, "powershell -nop\n" * 100):  # the second is found by readability
        raw = bytes(b ^ 0x5A for b in text.encode())
        assert found(raw.hex())["xor", raw.hex()]["decoded"] == text
    n, b58 = int.from_bytes(long[:600].encode(), "big"), ""
    while n:
        n, d = divmod(n, 58)
        b58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"[d] + b58
    assert len(b58) > 512 and found(b58)["base58", b58]["decoded"] == long[:600]
    assert found("d2hvYW1p")["base64", "d2hvYW1p"]["decoded"] == "whoami"
    assert found("x=Y21kIC9jIGE=")["base64", "Y21kIC9jIGE="]["decoded"] == "cmd /c a"
    raw = bytes(range(128, 200))
    binary = found(base64.b64encode(raw).decode())["base64", base64.b64encode(raw).decode()]
    assert (binary["decoded"], binary["confidence"], binary["notes"]) == (raw.hex(), 0.5, "binary data")
    text = r"a \u0041 and \x42"
    assert found(text)["unicode", text]["decoded"] == "a A and B"
    assert found(r"\ud83d\ude00\ud83d")["unicode", r"\ud83d\ude00\ud83d"]["decoded"] == "\U0001f600\ufffd"
    assert found("Fubhyqre")["rot", "Fubhyqre"]["decoded"] == "Shoulder"  # no telling word
    run = "filler text " * 30 + "gur cnffjbeq"
    assert any(r["decoded"].endswith("the password") for r in decode.scan(run))


@pytest.mark.parametrize("vector, score", [("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:L/UI:R/S:C/C:L/I:L/A:N", 5.4), ("CVSS:3.1/AV:L/AC:H/PR:H/UI:R/S:U/C:N/I:N/A:N", 0.0), ("CVSS:3.1/AV:N", None), ("junk", None)])
def test_cvss(spark, vector, score):
    row = spark.createDataFrame([(vector,)], "v string").select(scoring.cvss31(F.col("v")).alias("s")).first()["s"]
    assert row["score"] == score


def test_kinds_duties_and_rules(spark):
    kinds = spark.createDataFrame([("8.8.8.8",), ("a" * 64,), ("evil.com",), ("srv.corp",), ("??",), ("2001:db8::1",)], "i string")
    assert [(r.indicator_kind, r.public) for r in scoring.annotate(kinds, "i").collect()] == [("ip", True), ("hash", True), ("domain", True), ("domain", False), ("unknown", False), ("ip", False)]
    incidents = spark.createDataFrame([(1, True, "high", True, "energy"), (2, False, "low", None, "x")], "id int, personal_data boolean, risk string, significant boolean, sector string")
    duties = scoring.obligations(incidents, scoring.RULES)
    assert duties.count() == 4 and duties.filter("id = 2").count() == 0
    assert scoring.obligations_summary(duties, "id").first()["most_urgent"] == "early warning"
    assert spark.createDataFrame([("CVSS:4.0/AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:N/SI:N/SA:N",), ("CVSS:4.0/AV:N",)], "v string").filter(scoring.cvss40_valid(F.col("v"))).count() == 1


def rows(spark, items):
    return spark.createDataFrame([tuple(x.get(f.name) for f in RAW.fields) for x in items], RAW)


def test_a_case_is_what_was_added(spark, tmp_path):
    batch = rows(spark, [{"ts": "2026-01-01T00:00:00Z", "source": "evtx", "user_name": "CORP\\a", "techniques": "T1110"}, {"ts": "2026-01-01T00:00:01Z", "source": "thor", "user_name": "a"}])
    case = cases.Case(spark, str(tmp_path), "c1").create("t")
    assert case.append(batch) == 2
    with pytest.raises(ValueError):
        case.append(batch)
    assert case.append(batch, force=True) == 2 and case.append(batch.limit(0)) == 0
    assert sorted(r.id for r in case.raw().collect()) == [0, 1, 2, 3]
    case.set_infrastructure(["10.0.0.1"])
    with pytest.raises(ValueError):
        case.set_infrastructure(["x"])
    case.note("seen")
    assert [m["id"] for m in cases.list_cases(spark, str(tmp_path))] == ["c1"] and case.meta["notes"][0]["text"] == "seen"
    with pytest.raises(ValueError):
        cases.Case(spark, str(tmp_path), "../x")
    tables = {k: v for k, v in case.analyze().items() if k in ("shared_indicators", "killchain", "technique_catalog", "timeline", "episodes", "incident_clusters")}
    got = cases.collect(tables)
    assert got["shared_indicators"][0]["indicator"] == "a" and cases.narrative(got)[-1] == "Reach: Exploitation."
    cut, counts = cases.collect_counted({"timeline": tables["timeline"], "killchain": tables["killchain"]}, limit=1)
    assert len(cut["timeline"]) == 1 and counts == {"timeline": {"records_total": 4, "records_capped": True}, "killchain": {"records_total": 1, "records_capped": False}}
    assert cases.bundle(cut, "full", counts)["counts"] == counts and "counts" not in cases.bundle(cut)
    text = json.dumps(cases.bundle(got, "detailed"))
    assert "timeline" not in cases.load_bundle(text)["analysis"] and "| indicator |" in cases.markdown(got) and "<table>" in cases.html_report(got)
    new = delta.delta({k: v.limit(0) for k, v in tables.items()}, tables)
    assert "new bridge" in delta.headline({k: [r.asDict() for r in v.collect()] for k, v in new.items() if k != "clusters"})
    case.delete()
    assert cases.list_cases(spark, str(tmp_path)) == []


def test_text_helpers():
    assert cases.redact({"a": ["Alice on WS-1", 3]}, {"alice": "U1", "ws-1": "H1"}) == {"a": ["U1 on H1", 3]}
    assert cases.describe_error(ValueError("no /root/x/y.log at https://a.example/b")) == "no y.log at https://a.example/b"
    assert cli.parser().parse_args(["decode", "x"]).text == "x"


def test_search_and_iocs(spark):
    d = spark.createDataFrame([("Evil.example was seen",), ("nothing",)], "text string")
    hits = extras.ioc_search(d, spark.createDataFrame([("evil.EXAMPLE",), (" ",), ("none",)], "ioc string"))
    assert [(r.ioc, r.hits) for r in hits.collect()] == [("evil.EXAMPLE", 1)]
    assert extras.search(d, regex="^.*not.ing.*$").count() == 1
    assert extras.ioc_search(d, spark.createDataFrame([], "ioc string")).count() == 0
    assert extras.ioc_search(d, spark.createDataFrame([(None,), (" ",)], "ioc string")).count() == 0
    assert extras.ioc_search(d.limit(0), spark.createDataFrame([("evil",)], "ioc string")).count() == 0


def test_indicators_equal_a_plain_search(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(extras, "MAP_BITS", 6)  # a map that says yes to nearly all
    parts = ["a", "É", "evil", ".com", " ", "日本", "10.0.0.", "7", "x" * 20]
    texts = [None, "", *("".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(150))] * 2
    iocs = [None, "", "a", "É", "é", "EVIL.com", "10.0.0.7", "evil.com ", "nowhere at all", *("".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(60))]
    got = extras.ioc_search(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(i,) for i in iocs], "ioc string")).collect()
    want = {i.strip(" "): sum((i.strip(" ").lower() in (t or "").lower()) for t in texts) for i in iocs if (i or "").strip(" ")}
    assert {r.ioc: r.hits for r in got} == {i: n for i, n in want.items() if n} and len(got) == len({r.ioc for r in got})
    both = spark.createDataFrame([("evil", "q"), ("q", "x EVIL y")], "a string, b string")
    assert [(r.ioc, r.hits) for r in extras.ioc_search(both, spark.createDataFrame([("Evil",)], "ioc string")).collect()] == [("Evil", 2)]


def test_streaming_sessions(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    lines = [{"id": k, "ts": f"2026-01-01T00:{m:02d}:00Z", "source": s, "host": "ws1"} for k, (m, s) in enumerate([(0, "evtx"), (1, "thor"), (30, "evtx"), (59, "evtx")])]
    (src / "a.json").write_text("\n".join(map(json.dumps, lines)))
    q = live.episodes(live.read_json(spark, str(src)), late="1 minute").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out))
    q.awaitTermination(120)
    got = spark.read.parquet(str(out)).collect()
    assert [(r.events, r.families) for r in got] == [(2, 2)]


def test_addresses_equal_the_standard_library(spark):
    rng = random.Random(2)
    borders = [int(x) for v in (addresses.SPECIAL_4, addresses.SPECIAL_6) for t in v for x in (ipaddress.ip_network(t).network_address, ipaddress.ip_network(t).broadcast_address)]
    six = [ipaddress.IPv6Address(min(max(b + d, 0), 2**128 - 1)) for b in borders if b >= 2**32 for d in (-1, 0, 1)] + [ipaddress.IPv6Address(rng.getrandbits(128)) for _ in range(100)]
    four = [ipaddress.IPv4Address(min(max(b + d, 0), 2**32 - 1)) for b in borders if b < 2**32 for d in (-1, 0, 1)]
    six += [ipaddress.IPv6Address(f"::ffff:{a}") for a in four[:60]]
    good = {str(a): a for a in [*six, *four]} | {a.exploded.upper(): a for a in six}
    junk = ["", "1.2.3", "1.2.3.256", "01.2.3.4", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "::1.2.3", "x", "1:2:3:4:5:6:7:8::", ":", "::ffff:1.2.3.999", None]
    table = spark.createDataFrame([(t,) for t in [*good, *junk, " fe80::1%eth0 "]], "t string")
    t = F.col("t")
    rows = {r.t: r for r in table.select("t", addresses.number(t).alias("n"), addresses.generic(t).alias("g"), addresses.public(t).alias("p"), scoring.indicator_kind(t).alias("kind")).collect()}
    for text, a in good.items():
        whole = int(a) if a.version == 6 else int(a) + (0xFFFF << 32)
        assert (int(rows[text].n.hi) << 64) + int(rows[text].n.lo) == whole and rows[text].kind == "ip"
        assert (rows[text].g, rows[text].p) == (addresses.is_generic(a), addresses.is_public(a)), text
    for text in junk:
        assert rows[text].n is None and rows[text].g and not rows[text].p
    assert rows[" fe80::1%eth0 "].g


def test_an_address_is_parsed_once(spark):
    t = F.col("t")
    plan = spark.createDataFrame([("::1",)], "t string").select(addresses.number(t).alias("n"), addresses.generic(t).alias("g"), addresses.public(t).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(lower(trim(") == 3


def test_redacted_tables_equal_the_plain_version(spark):
    rng = random.Random(9)
    parts = ["al", "ice", "WS", "-1", ".", "é", "(x)", " ", "bob", "日本", "\\", "|"]
    mapping = {"".join(rng.choices(parts, k=rng.randrange(1, 4))).strip(): f"<{k}>" for k in range(25)}
    mapping = {k: v for k, v in {k.lower(): v for k, v in mapping.items()}.items() if k}
    texts = [None, "", *("".join(rng.choice([p, p.upper()]) for p in rng.choices(parts, k=rng.randrange(12))) for _ in range(200))]
    table = spark.createDataFrame([(t, [t, "bob"], {"k": t}, (t, 1), 7) for t in texts], "t string, l array<string>, m map<string,string>, s struct<a string, n int>, n int")
    names = spark.createDataFrame(list(mapping.items()), "real string, pseudonym string")
    got = redaction.redact_table(table, names).collect()
    want = lambda t: cases.redact(t, mapping)
    assert [r.t for r in got] == [want(t) for t in texts] and [r.l[0] for r in got] == [want(t) for t in texts]
    assert [(r.m["k"], r.s.a, r.s.n, r.n) for r in got] == [(want(t), want(t), 1, 7) for t in texts]
    assert [r.t for r in redaction.redact_table(table, names.limit(0)).collect()] == texts
    big = spark.range(redaction.MAX_VALUES + 1).selectExpr("cast(id as string) as real", "'x' as pseudonym")
    with pytest.raises(ValueError):
        redaction.redact_table(table, big)


def test_a_mapping_of_any_size_is_joined(spark):
    rng = random.Random(10)
    parts = ["al", "ice", "WS", "-1", ".", "é", "(x)", " ", "bob", "日本", "\\", "|", "İ"]
    mapping = {k: f"<{k}>" for k in {"".join(rng.choices(parts, k=rng.randrange(1, 4))).strip().lower() for _ in range(25)} if k}
    texts = [None, "", *("".join(rng.choice([p, p.upper()]) for p in rng.choices(parts, k=rng.randrange(12))) for _ in range(200))]
    table = spark.createDataFrame([(t, [t, "bob", None], {"k": t}, (t, 1), 7) for t in texts] + [(None, None, None, None, None)], "t string, l array<string>, m map<string,string>, s struct<a string, n int>, n int")
    names = spark.createDataFrame(list(mapping.items()), "real string, pseudonym string")
    rows = lambda d: sorted(map(repr, d.collect()))
    want = rows(redaction.redact_table(table, names))
    assert rows(redaction.redact_joined(table, names)) == want
    many = spark.range(redaction.MAX_VALUES + 1).selectExpr("concat('no such name ', id) as real", "'x' as pseudonym")
    assert rows(redaction.redact(table, names.unionByName(many))) == want
    assert rows(redaction.redact_joined(table, names, ["l"])) == rows(redaction.redact_table(table, names, ["l"]))
    assert rows(redaction.redact_joined(table, names.limit(0))) == rows(table)


def test_wrapped_base64_is_one_token(spark):
    long, short = "every line of what an encoder wraps " * 4, "a command in one line"
    b64 = lambda t, how="utf-8": base64.b64encode(t.encode(how)).decode()
    wrap = lambda t, n, end: end.join(t[k : k + n] for k in range(0, len(t), n))
    one = b64("x" * 57)  # 76 characters
    cases = {
        1: ("-enc " + wrap(b64(long, "utf-16-le"), 76, "\r\n") + " more", [("utf-16", long)]),
        2: (wrap(b64(long), 64, "\n"), [("utf-8", long)]),
        3: (one + "\nHello world", [("utf-8", "x" * 57)]),
        4: (one + "\nNext word", [("utf-8", "x" * 57)]),
        5: (b64(short) + "\n" + b64(short), [("utf-8", short)] * 2),
        6: (wrap(b64(long * 300), 76, "\n"), [("utf-8", long * 300)]),
        7: (one + "\n" + wrap(b64("\0\1"), 76, "\n"), [("utf-8", "x" * 57)]),
        8: (wrap(b64("y" * 114), 76, "\n") + "\nNext", [("utf-8", "y" * 114)]),
        9: (None, []),
        10: (" and ".join([wrap(b64(long), 76, "\n"), b64(short), wrap(b64(long), 76, "\n")]), [("utf-8", short), ("utf-8", long), ("utf-8", long)]),
    }
    rows = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "id long, cmdline string")
    got = extras.extract_base64(rows).collect()
    for k, (_, want) in cases.items():
        assert sorted((r.encoding, r.decoded) for r in got if r.id == k) == sorted(want), k
    assert not any("\n" in r.token for r in got)
