"""Normalisers, annotation and correlation on small hand-written events."""

import pytest
from pyspark.sql import functions as F

from loglattice.events import derive
from loglattice.functions import attack, vocab
from loglattice.functions import normalize as n
from loglattice.operators import correlate, graph, recipes
from loglattice.schema import RAW, fingerprint


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (n.canon_user, "CORP\\Alice", "alice"), (n.canon_user, "alice@corp.example", "alice"), (n.canon_user, " Alice ", "alice"), (n.canon_user, "CORP/bob", "bob"), (n.canon_user, "", None), (n.canon_user, None, None),
        (n.user_domain, "CORP\\alice", "corp"), (n.user_domain, "alice@Corp.Example.", "corp.example"), (n.user_domain, "a/b/c", "a/b"), (n.user_domain, "alice", None),
        (n.is_generic_user, "SYSTEM", True), (n.is_generic_user, "DC1$", True), (n.is_generic_user, "DWM-3", True), (n.is_generic_user, "alice", False), (n.is_generic_user, None, True), (n.is_machine_user, "DC1$", True),
        (n.canon_host, "DC1.corp.example.", "dc1"), (n.canon_host, "10.0.0.1", "10.0.0.1"), (n.canon_host, "fe80::1", "fe80::1"), (n.host_domain, "dc1.corp.example", "corp.example"), (n.host_domain, "10.0.0.1", None), (n.is_generic_host, "localhost", True),
        (n.canon_hash, "SHA256=" + "AB" * 32, "ab" * 32), (n.canon_hash, "abcd", None), (n.canon_hash, "g" * 32, None),
        (n.canon_domain, "Evil.Example.", "evil.example"), (n.is_generic_domain, "1.0.0.127.in-addr.arpa", True), (n.is_generic_domain, "evil.example", False),
        (n.canon_file, "C:\\Temp\\Evil.EXE", "evil.exe"), (n.canon_file, "/tmp/evil.exe/", "evil.exe"), (n.is_generic_file, "C:\\Windows\\System32\\svchost.exe", True),
        (n.source_family, "pcap:x.pcap", "pcap"), (n.source_family, "EVTX", "evtx"),
        (n.is_generic_ip, "127.0.0.1", True), (n.is_generic_ip, "169.254.1.1", True), (n.is_generic_ip, "224.0.0.1", True), (n.is_generic_ip, "300.1.1.1", True), (n.is_generic_ip, "10.0.0.1", False), (n.is_generic_ip, "::1", True), (n.is_generic_ip, "fe80::1", True), (n.is_generic_ip, "2001:db8::1", False), (n.is_generic_ip, None, True),
        (n.is_public_ip, "8.8.8.8", True), (n.is_public_ip, "10.0.0.1", False), (n.is_public_ip, "203.0.113.5", False),
        (attack.split_techniques, "t1059.001, T1059.001|bad;T1110.", ["T1059.001", "T1110"]),
    ],
)
def test_normalisers(spark, f, value, want):
    assert one(spark, f, value) == want


def test_times(spark):
    rows = spark.createDataFrame([("2026-01-01T02:00:00+02:00",), ("1767225600",), ("1767225600000",), ("2026-01-01 00:00:00",), ("junk",)], "ts string")
    assert [r[0] for r in rows.select(n.iso(n.parse_ts(F.col("ts")))).collect()] == ["2026-01-01T00:00:00Z", "2026-01-01T00:00:00Z", None, "2026-01-01T00:00:00Z", None]


def test_event_ids_and_registry_keys(spark):
    rows = spark.createDataFrame([(22, "Microsoft-Windows-TerminalServices-LocalSessionManager/Operational"), (22, None), (4624, "Security"), (9999, "Security")], "e int, c string")
    assert [tuple(r[0]) if r[0] else None for r in rows.select(vocab.classify(F.col("e"), F.col("c"))).collect()] == [("session", "rdp-shell-start"), ("network", "dns-query"), ("authentication", "logon"), None]
    assert one(spark, vocab.classify_key, r"HKLM\SOFTWARE\Microsoft\Windows\CurrentVersion\RunOnce") == "User ASEP - RunOnce"
    assert one(spark, vocab.classify_key, r"HKLM\SYSTEM\ControlSet001\Services\Evil") == "Services"
    assert one(spark, vocab.program_from_value, r"C:\Program Files\Vendor\agent.exe /silent x.exe") == r"C:\Program Files\Vendor\agent.exe"
    assert one(spark, vocab.program_from_value, "https://x.example/a.exe") is None
    assert one(spark, vocab.program_from_value, '"C:\\a b\\x.exe" -q') == "C:\\a b\\x.exe" and one(spark, vocab.program_from_value, '"C:\\open.exe') is None
    program = lambda category, name, data: one(spark, lambda c: vocab.program_of(F.lit(category), F.lit(name), c), data)
    assert program("Winlogon", "Userinit", r"C:\Windows\system32\userinit.exe,C:\Temp\evil.exe,") == r"C:\Temp\evil.exe" and program("Winlogon", "Other", "a.exe") is None
    assert program("Services", "ImagePath", r"\??\C:\s.exe -k") == r"C:\s.exe" and program("Services", "DisplayName", "s.exe") is None and program("LSA Packages", "x", "a.exe") is None


def events(spark, rows):
    names = [f.name for f in RAW.fields]
    full = [{"id": k, **r} for k, r in enumerate(rows)]
    return derive(spark.createDataFrame([tuple(r.get(c) for c in names) for r in full], RAW))


def at(second):
    return f"2026-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"


def bridges(ev, **k):
    return {(r["kind"], r["indicator"]): r for r in correlate.shared_indicators(ev, **k).collect()}


def test_one_account_three_spellings_and_realms(spark):
    got = bridges(events(spark, [{"source": "evtx", "user_name": "CORP\\alice"}, {"source": "log:a", "user_name": "alice"}, {"source": "crowdstrike", "user_name": "alice@corp.example"}]))
    assert got["user", "alice"]["families"] == 3 and got["user", "alice"]["match_type"] == "normalized"
    got = bridges(events(spark, [{"source": "evtx", "user_name": "alice@corp.example"}, {"source": "thor", "user_name": "alice@partner.example"}]))
    assert got["user", "alice"]["match_type"] == "ambiguous" and float(got["user", "alice"]["confidence"]) == 0.40


def test_generic_values_make_no_bridge(spark):
    both = [{"user_name": "SYSTEM", "host": "localhost", "src_ip": "127.0.0.1", "file_name": "svchost.exe"}, {"user_name": "dc1$"}]
    assert not bridges(events(spark, [{"source": s, **r} for s in ("evtx", "thor") for r in both]))


def test_hash_ranks_above_address_and_two_captures_are_one_family(spark):
    ev = events(spark, [{"source": "evtx", "file_hash": "AB" * 16, "src_ip": "10.1.1.1"}, {"source": "thor", "file_hash": "ab" * 16}, {"source": "pcap:a", "src_ip": "10.1.1.1"}, {"source": "pcap:b", "src_ip": "10.1.1.1", "dst_ip": "10.9.9.9"}, {"source": "pcap:a", "dst_ip": "10.9.9.9"}])
    rows = correlate.shared_indicators(ev).collect()
    assert [r["kind"] for r in rows] == ["file_hash", "ip"] and rows[1]["families"] == 2
    assert bridges(ev, infra_ips=("10.1.1.1",))["ip", "10.1.1.1"]["infrastructure"]


@pytest.mark.parametrize("gap, want", [(90, 1), (120, 1), (121, 2), (480, 2)])
def test_episodes_split_after_the_gap(spark, gap, want):
    ev = events(spark, [{"source": "evtx", "ts": at(3599)}, {"source": "thor", "ts": at(3599 + gap)}])
    assert correlate.episode_ids(ev).select("episode").distinct().count() == want
    assert correlate.episodes(ev).count() == (1 if want == 1 else 0)


def test_beacons_are_connections_not_segments(spark):
    calls = [{"source": "zeek", "ts": at(60 * k), "src_ip": "10.0.0.1", "dst_ip": "9.9.9.9", "dst_port": 443, "src_port": 50_000 + k} for k in range(6)]
    segments = [{**c, "dst_ip": "8.8.8.8", "src_port": 50_000} for c in calls]
    jittery = [{**c, "dst_ip": "7.7.7.7", "ts": at((60 * k) ** 2 // 60)} for k, c in enumerate(calls)]
    assert [r["dst_ip"] for r in recipes.beaconing(events(spark, calls + segments + jittery)).collect()] == ["9.9.9.9"]


def test_timeline_says_why(spark):
    ev = events(spark, [{"source": "evtx", "ts": at(5), "action": "audit-log-cleared"}, {"source": "evtx", "ts": at(1), "action": "x"}])
    assert [(r["id"], r["why"]) for r in correlate.timeline(ev).collect()] == [(0, "high-signal event type")]
    assert {r["why"] for r in correlate.timeline(ev.filter("id = 1")).collect()} == {"context"}


def test_clusters_join_over_shared_entities(spark):
    ev = events(spark, [{"source": "evtx", "user_name": "alice", "host": "ws1", "techniques": "T1110"}, {"source": "log:a", "user_name": "alice", "src_ip": "10.0.0.9"}, {"source": "thor", "host": "ws1", "file_hash": "cd" * 16}, {"source": "evtx", "user_name": "bob"}])
    got = graph.incident_clusters(ev).collect()
    assert len(got) == 1 and got[0]["sources"] == 3 and got[0]["hashes"] == 1 and got[0]["kc_depth"] == 4 and got[0]["deepest_phase"] == "Exploitation" and got[0]["tactics"] == "credential-access"


def test_empty_events_do_not_fail(spark):
    from loglattice.analyze import analyze

    ev = events(spark, [])
    for name, df in analyze(ev).items():
        assert df.count() == (3 if name == "summary" else 0), name


def test_fingerprint_follows_the_schema():
    assert len(fingerprint()) == 12
