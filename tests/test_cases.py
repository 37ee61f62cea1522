"""Cases: originals, rebuilding, replays and writers that were killed."""

import json

import pytest
from pyspark.sql import functions as F

from loglattice import cases, schema
from loglattice.sources import readers


@pytest.fixture
def case(spark, tmp_path):
    return cases.Case(spark, str(tmp_path / "root"), "c1").create("t")


def lines(tmp_path, name, n, start=0):
    path = tmp_path / name
    path.write_text("\n".join(json.dumps({"Timestamp": f"2026-01-01T00:00:{k % 60:02d}Z", "EventID": 4625, "Channel": "Security", "Computer": f"ws{k}", "RuleTitle": "r", "Details": {"User": f"u{k}", "Extra": {"score": k}}}) for k in range(start, start + n)))
    return str(path)


def test_originals_hold_what_the_schema_lacks(spark, case, tmp_path):
    assert case.append_source("evtx", lines(tmp_path, "a.jsonl", 5)) == 5
    flat = spark.createDataFrame([("2026-01-02T00:00:00Z", "scan", "ws7", 9.5, ["x", "y"])], "ts string, source string, host string, score double, tags array<string>")
    assert case.append(flat) == 1
    got = case.records().select("id", F.try_variant_get("record", "$.Details.Extra.score", "int").alias("a"), F.try_variant_get("record", "$.score", "double").alias("b"), F.try_variant_get("record", "$.tags[1]", "string").alias("c"))
    assert [tuple(r) for r in got.orderBy("id").collect()] == [*[(k, k, None, None) for k in range(5)], (5, None, 9.5, "y")]


def test_rebuilding_after_the_schema_changed(spark, case, tmp_path, monkeypatch):
    whole = schema.RAW
    smaller = type(whole)([f for f in whole.fields if f.name not in ("user_name", "event_code", "src_ip")])
    keyed = spark.createDataFrame([('{"@timestamp": "2026-01-01T00:00:00Z", "source": {"ip": "10.0.0.1"}, "event.code": "7", "user.name": ["a", "b"]}',)], "j string").select(F.expr("parse_json(j)").alias("v"))
    for module in (cases, schema):
        monkeypatch.setattr(module, "RAW", smaller)
    monkeypatch.setattr(cases, "fingerprint", lambda: schema.fingerprint(smaller))
    case.append_source("evtx", lines(tmp_path, "a.jsonl", 50))
    case.append(spark.createDataFrame([("2026-01-01T00:00:00Z", "scan", "10.9.9.9", 3)], "ts string, source string, src_ip string, event_code int"))
    for module in (cases, schema):
        monkeypatch.setattr(module, "RAW", whole)
    monkeypatch.setattr(cases, "fingerprint", lambda: schema.fingerprint(whole))
    assert case.meta["schema"] != schema.fingerprint() and case.raw().filter("user_name is not null").count() == 0
    before = {r.id: r.ts for r in case.raw().collect()}
    assert case.rebuild() == 2 and case.rebuild() == 0 and case.meta["schema"] == schema.fingerprint()
    rows = sorted(case.raw().collect(), key=lambda r: r.id)
    assert {r.id: r.ts for r in rows} == before
    assert [(r.user_name, r.event_code, r.host) for r in rows[:50]] == [(f"u{k}", 4625, f"ws{k}") for k in range(50)]
    assert (rows[50].src_ip, rows[50].event_code) == ("10.9.9.9", 3)
    made = schema.flat(keyed.withColumnRenamed("v", "record")).first()
    assert (made.ts, made.src_ip, made.event_code, made.user_name) == ("2026-01-01T00:00:00Z", "10.0.0.1", 7, "a,b")
    assert len(case.vacuum(hours=0)) == 2 and len(case.raw().collect()) == 51  # the batches that were replaced


def test_a_killed_writer_leaves_no_rows(spark, case, tmp_path, monkeypatch):
    batch = readers.detections(spark, lines(tmp_path, "a.jsonl", 7))
    monkeypatch.setattr(case.log, "commit", lambda make: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        case.append(batch, kind="evtx")
    again = cases.Case(spark, str(tmp_path / "root"), "c1")
    assert again.raw().count() == 0 and again.meta["events"] == 0
    assert again.append(batch, kind="evtx") == 7 and again.raw().count() == 7
    assert len(again.vacuum(hours=0)) == 1 and again.raw().count() == 7 and again.vacuum(hours=0) == []


def test_writers_at_the_same_time(spark, case, tmp_path):
    other = cases.Case(spark, str(tmp_path / "root"), "c1")
    inner = other.log.commit

    def first_the_other(make):
        monkey, case.log.commit = case.log.commit, kept
        other.append(spark.createDataFrame([("b",), ("c",)], "host string"))
        return monkey(make) if monkey is not first_the_other else kept(make)

    kept, case.log.commit = case.log.commit, first_the_other
    assert inner and case.append(spark.createDataFrame([("a",)], "host string")) == 1
    assert {r.id: r.host for r in case.raw().collect()}[2] == "a" and case.meta["events"] == 3
    with pytest.raises(FileExistsError):
        other.create()
    assert not case.folder.write_new("log/0000000000.json", "{}")


def test_replays_add_nothing(spark, case, tmp_path):
    batch = spark.createDataFrame([("a",)], "host string")
    assert case.append(batch, key="k") == 1 and case.append(batch, key="k") == 0 and case.append(batch, force=True, key="l") == 1
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"host": f"h{k}", "extra": k}) for k in range(4)))

    def run(checkpoint):
        stream = spark.readStream.schema("host string, extra int").json(str(src))
        stream.writeStream.foreachBatch(case.sink("s")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(120)

    run("cp")
    assert case.meta["events"] == 6
    run("cp2")  # the same epoch once more, as after a lost checkpoint
    assert case.meta["events"] == 6
    (src / "b.json").write_text(json.dumps({"host": "late"}))
    run("cp")
    assert case.meta["events"] == 7 and case.raw().filter("host = 'late'").count() == 1
    assert case.records().agg(F.sum(F.try_variant_get("record", "$.extra", "int"))).first()[0] == 6


def test_empty_and_odd_batches(spark, case):
    assert case.append(spark.createDataFrame([], "host string")) == 0 and case.append(spark.createDataFrame([], "host string")) == 0
    odd = spark.createDataFrame([("not json", "h", 5), (None, None, None)], "original string, host string, pos int")
    assert case.append(odd, kind="evtx") == 2
    assert sorted(str(r.line) for r in case.records().select(F.try_variant_get("record", "$.line", "string").alias("line")).collect()) == ["None", "not json"]
    assert case.append(odd) == 2 and case.raw().filter("host = 'h'").count() == 2
    with pytest.raises(FileNotFoundError):
        cases.Case(spark, str(case.folder.path) + "-no", "c2").append(odd)


def test_command_line(spark, tmp_path, capsys):
    from loglattice import cli

    root = ["--root", str(tmp_path / "cli")]
    run = lambda *a: (cli.main(["case", *a, *root]), capsys.readouterr().out)[1]
    run("new", "a", "First")
    run("new", "b", "Second")
    assert run("add", "a", "--source", f"evtx={lines(tmp_path, 'x.jsonl', 3)}").strip() == "3"
    run("add", "b", "--source", f"evtx={tmp_path / 'x.jsonl'}")
    run("add", "b", "--source", f"evtx={lines(tmp_path, 'y.jsonl', 4, 60)}")
    run("note", "b", "seen")
    run("infra", "b", "--infra", "10.0.0.1")
    assert json.loads(run("show", "b"))["events"] == 7
    told = json.loads(run("diff", "b", "a"))
    assert set(told) == {"headline", "bridges", "techniques", "episodes", "depth", "clusters"}
    text = run("document", "b")
    assert text.startswith("# Second") and "y.jsonl" in text and "seen" in text and "10.0.0.1" in text
    assert run("rebuild", "b").startswith("0") and run("vacuum", "b").startswith("0")
    run("rm", "a")
    assert [m["id"] for m in json.loads(run("list"))] == ["b"]
