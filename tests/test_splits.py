"""Files read in byte ranges give what whole files give, and what can't be read is accounted for."""

import gzip
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loglattice.sources import checked, readers, splits


def objects(rng, n):
    return [{"a": rng.choice(["x", '"q"', "\\", "{[", 'é"]}', '\\\\"', "日本"]), "n": {"k": [rng.random(), {"z": "]"}]}, "i": i} for i in range(n)]


def document(rng, form, o):
    if form == "array":
        return json.dumps(o, ensure_ascii=False)
    if form == "data":
        return json.dumps({"meta": {"x": [1, {}]}, "Data": o}, ensure_ascii=False)
    return "\n".join(json.dumps(x, indent=1 if form == "pretty" else None) for x in o)


def elements(path, split):
    """What the two passes give, without Spark."""
    parts = [dict(zip(("file", "a", "b", "modified"), r)) for r in splits.ranges(splits.files_under(path), split)]
    quotes = depth = 0
    for p in parts:
        s = next(splits._scan(iter([pa.RecordBatch.from_pylist([p])]))).to_pylist()[0]
        yield from splits._objects(p["file"], p["a"], p["b"], s["base"], quotes % 2 == 1, depth)
        depth += s["inside"] if quotes % 2 else s["outside"]
        quotes += s["quotes"]


@pytest.mark.parametrize("form", ["array", "data", "lines", "pretty"])
def test_json_is_cut_anywhere(tmp_path, monkeypatch, form):
    monkeypatch.setattr(splits, "CHUNK", 37)
    rng = random.Random(form)
    for _ in range(12):
        o = objects(rng, rng.randrange(8))
        path = tmp_path / "f.json"
        path.write_text(rng.choice(["", "﻿"]) + document(rng, form, o), encoding="utf-8")
        for split in (2, 6, 50, 1 << 20):
            assert [json.loads(r[2]) for r in elements(str(path), split)] == o


@pytest.mark.parametrize("layout", sorted(splits.LAYOUTS))
def test_layouts_are_cut_anywhere(tmp_path, monkeypatch, layout):
    monkeypatch.setattr(splits, "CHUNK", 30)
    rng = random.Random(layout)
    lines = ["[HKEY\\A\\é]", "[K2]", '"v"="x"', '"h"=hex:01,02,\\', "  03,04,\\", "  05", "", "  ", '@="d"', "key: value", "[no key"]
    for _ in range(60):
        enc = rng.choice(["utf-8", "utf-16-le", "utf-16-be", "latin-1"])
        text = rng.choice(["\n", "\r\n"]).join(rng.choices(lines, k=rng.randrange(14))) + rng.choice(["", "\n"])
        path = tmp_path / "f.txt"
        path.write_bytes({"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}.get(enc, b"") + text.encode(enc))
        whole = list(splits.read_range(str(path), 0, 1 << 40, layout))
        if layout == "lines":
            assert [r[2] for r in whole] == text.splitlines()
        for split in (2, 6, 14, 60):
            assert [r for f, a, b, _ in splits.ranges(splits.files_under(str(path)), split) for r in splits.read_range(f, a, b, layout)] == whole


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    o = objects(rng, 500)
    path = tmp_path / "f.json"
    path.write_text(document(rng, "array", o), encoding="utf-8")
    got = splits.json_elements(spark, str(path), 4000)
    assert sorted((json.loads(r.text) for r in got.collect()), key=lambda x: x["i"]) == o
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(r.m["i"] for r in readers.json_objects(spark, str(path)).collect()) == sorted(str(k) for k in range(500))
    empty = tmp_path / "none"
    empty.mkdir()
    assert splits.split_rows(spark, str(empty), "lines").count() == 0


def test_a_registry_export_in_ranges_equals_the_whole(spark, tmp_path):
    keys = [rf"HKEY_CURRENT_USER\Software\Microsoft\Windows\CurrentVersion\Run{'' if k % 2 else 'Once'}" for k in range(40)]
    multi = "one\0two\0\0".encode("utf-16-le").hex(",")
    body = "Windows Registry Editor Version 5.00\n\n" + "\n\n".join(f"[{key}]\n" + "\n".join(f'"v{k}.{j}"="é{j}.exe"' for j in range(9)) + f'\n"m{k}"=hex(7):{multi[:20]},\\\n  {multi[21:]}' for k, key in enumerate(keys))
    for name, raw in (("utf16", b"\xff\xfe" + body.encode("utf-16-le")), ("latin", body.encode("latin-1")), ("utf8", body.encode())):
        path = tmp_path / f"{name}.reg"
        path.write_bytes(raw)
        tables = [readers.registry_rows(splits.split_rows(spark, str(path), "registry", n).filter("reason is null")) for n in (300, 1 << 20)]
        assert tables[0].rdd.getNumPartitions() > 5 and tables[1].rdd.getNumPartitions() == 1
        small, whole = (sorted((r.registry_key, r.registry_value, r.registry_data, r.registry_type) for r in t.collect()) for t in tables)
        assert small == whole and len(whole) == 400
        assert (keys[3], "v3.2", "é2.exe", "REG_SZ") in whole and (keys[5], "m5", "one\ntwo", "REG_MULTI_SZ") in whole
        assert readers.registry_export(spark, str(path)).count() == 400


def detection(k):
    return json.dumps({"Timestamp": "2026-01-01T00:00:00Z", "EventID": 4624, "Channel": "Security", "Computer": f"ws{k}", "RuleTitle": "r"})


def test_what_cannot_be_read_is_accounted_for(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "good.jsonl").write_text("\n".join(map(detection, range(10))))
    (src / "damaged.jsonl").write_text("\n".join([detection(10), '{"Timestamp": "2026', "", detection(11), "junk"]))
    packed = gzip.compress("\n".join(detection(k) + " " * 200 for k in range(12, 400)).encode())
    (src / "whole.jsonl.gz").write_bytes(gzip.compress(detection(400).encode()))
    (src / "cut.jsonl.gz").write_bytes(packed[: len(packed) // 2])
    (src / "no.jsonl.gz").write_bytes(b"not compressed")
    (src / "array.json").write_text("[" + ", ".join(map(detection, range(401, 411))) + ', {"open": ')
    logs = tmp_path / "app.log"
    logs.write_text("level=info user=a\nsomething else\nlevel=warn user=b\n")
    sources = [("evtx", str(src), {}), ("log", str(logs), {"fmt": "regex", "pattern": r"level=(?<message>\w+) user=(?<user_name>\w+)"}), ("evtx", str(tmp_path / "nowhere"), {})]
    rows = checked.checked(spark, sources, split_bytes=700)
    events, dead, counts = checked.settle(rows, str(tmp_path / "out"))
    lost = sorted((r.origin.rpartition("/")[2], r.original, r.reason.partition(":")[0]) for r in dead.collect())
    names = [x[0] for x in lost]
    assert names == ["app.log", "array.json", "cut.jsonl.gz", "damaged.jsonl", "damaged.jsonl", "no.jsonl.gz", "nowhere"]
    assert ("damaged.jsonl", "junk", "not a JSON object") in lost and ("app.log", "something else", "does not fit the pattern") in lost
    assert ("array.json", None, "an object that does not close") in lost and ("no.jsonl.gz", None, "BadGzipFile") in lost
    hosts = {int(r.host[2:]) for r in events.filter("source = 'evtx'").collect()}
    assert hosts >= {*range(12), *range(400, 411)} and len(hosts & set(range(12, 400))) > 50
    assert [r.user_name for r in events.filter("source like 'log%'").orderBy("user_name").collect()] == ["a", "b"]
    assert counts == {"events": events.count(), "dead": 7} and events.select("id").distinct().count() == events.count()


def test_nothing_runs_before_the_table_is_used(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(detection(1))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    rows = checked.checked(spark, [("log", str(tmp_path), {})])
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert rows.count() == 1


def test_cards_and_one_object_files(spark, tmp_path):
    card = "Host name: ws{0}\nFile name: a.exe\nPlatform: Windows\nAgent ID: x{0}\nCommand line: a.exe -x\n"
    (tmp_path / "c.txt").write_text("\n\n".join(card.format(k) for k in range(30)))
    (tmp_path / "one.json").write_text(json.dumps({"ComputerName": "ws99", "event_platform": "Lin", "ParentProcessId": "4"}, indent=2))
    got = readers.crowdstrike(spark, str(tmp_path)).collect()
    assert {(r.host, r.host_os, r.agent_id) for r in got if r.action == "detection"} == {(f"ws{k}", "Windows", f"x{k}") for k in range(30)}
    assert [(r.host, r.host_os, r.parent_pid) for r in got if r.action != "detection"] == [("ws99", "Lin", "4")]


def test_documents_are_told_from_lines():
    whole = '{"a": 1}'
    assert all(map(splits.is_document, ["[" + whole, " [\n" + whole + ",", '{\n "a": {\n  "b": 1}\n}', '{"meta": {}, "Data": [' + whole, '{"a": 1,\n"b": 2}']))
    assert not any(map(splits.is_document, ["", whole, f"junk\n{whole}", '{"cut": "\n' + whole, "@rawstring: " + whole, whole + "\njunk"]))
