"""Readers over hand-written files."""

import json

import pytest

from loglattice.sources import readers as r


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(p)


def rows(df):
    return [{k: v for k, v in x.asDict().items() if v not in (None, "")} for x in df.collect()]


def test_detections(spark, tmp_path):
    rec = {"Timestamp": "2026-01-01T00:00:00Z", "EventID": 1, "Channel": "Sysmon", "Computer": "ws1", "RuleTitle": "Bad", "Level": "high", "RuleFile": "sigma-custom/x.yml", "MitreTags": ["T1059.001", 7, "G1"], "MitreTactics": ["Exec"], "Details": {"Proc": "evil.exe", "TgtIP": ["", "9.9.9.9"], "TgtPort": "443"}}
    got = rows(r.detections(spark, write(tmp_path, "a.jsonl", "\ufeff" + json.dumps(rec) + "\nnot json\n[1]\n")))
    assert len(got) == 1
    assert got[0] | {"techniques": "T1059.001", "tactics_declared": "execution", "dst_ip": "9.9.9.9", "dst_port": 443, "sigma_community": True, "category": "process", "process_name": "evil.exe"} == got[0]


def test_windows_events(spark, tmp_path):
    payload = {"EventData": {"Data": [{"@Name": "TargetUserName", "#text": "alice"}, {"@Name": "TargetDomainName", "#text": "CORP"}, {"@Name": "LogonType", "#text": "3"}, {"@Name": "IpAddress", "#text": "10.0.0.1"}, {"@Name": "Hashes", "#text": "MD5=" + "a" * 32 + ",SHA256=" + "b" * 64 + ",IMPHASH=" + "c" * 32}]}}
    rec = {"EventId": 4625, "Channel": "Security", "Computer": "dc1", "TimeCreated": "2026-01-01T00:00:00.1234567", "Payload": json.dumps(payload)}
    got = rows(r.windows_events(spark, write(tmp_path, "e.json", json.dumps(rec))))[0]
    assert got | {"ts": "2026-01-01T00:00:00.123456Z", "user_name": "CORP\\alice", "outcome": "failure", "logon_type": "3", "action": "logon-failed", "file_hash": "b" * 64, "file_hash_md5": "a" * 32} == got


def test_packets(spark, tmp_path):
    text = "1767225600.5\t10.0.0.1\t\t9.9.9.9\t\t6\t50000\t443\t\t\t60\t\t\t\n1767225601\t\t\t\t\t\t\t\t\t\t60\t\t\t\n1767225602\t10.0.0.1\t\t8.8.8.8\t\t17\t\t\t50001\t53\t70\tx.example\t\t\n"
    got = rows(r.packets(spark, write(tmp_path, "p.tsv", text)))
    assert [(x["transport"], x["dst_port"], x.get("dns_query")) for x in got] == [("tcp", 443, None), ("udp", 53, "x.example")]


def test_zeek_joins_on_uid(spark, tmp_path):
    def log(name, fields, *lines):
        write(tmp_path, name, "#separator \\x09\n#fields\t" + "\t".join(fields) + "\n" + "".join("\t".join(x) + "\n" for x in lines))

    log("conn.log", ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "conn_state", "orig_bytes"], ["1767225600", "C1", "10.0.0.1", "5", "9.9.9.9", "80", "tcp", "http", "SF", "7"], ["1767225600", "C2", "10.0.0.1", "6", "9.9.9.9", "81", "udp", "-", "S0", "-"])
    log("dns.log", ["uid", "query", "answers", "rcode_name"])
    log("http.log", ["uid", "method", "status_code", "host", "uri"], ["C1", "GET", "200", "a.example", "/x"], ["C1", "GET", "404", "a.example", "/y"])
    log("ssl.log", ["uid", "server_name", "ja3", "version"])
    log("notice.log", ["ts", "uid", "note", "msg"], ["1", "C1", "First", "m"], ["2", "C1", "Second", "m"])
    got = rows(r.zeek(spark, str(tmp_path)))
    assert sorted((x["src_port"], x.get("url_path", ""), x.get("rule_title", ""), x.get("outcome", "")) for x in got) == [(5, "", "Second", "success"), (5, "/x", "First", "success"), (5, "/y", "First", "success"), (6, "", "", "")]


def test_access_syslog_line_and_regex_logs(spark, tmp_path):
    access = '10.0.0.1 - bob [01/Jan/2026:02:00:00 +0200] "GET /a HTTP/1.1" 404 12 "-" "x"\njunk 2026-01-01T00:00:00Z from 10.0.0.2\n'
    got = rows(r.log_file(spark, write(tmp_path, "access.log", access)))
    assert got[0] | {"ts": "2026-01-01T00:00:00Z", "outcome": "failure", "http_status": 404, "url": "/a", "source": "log:access.log", "user_name": "bob"} == got[0]
    assert got[1]["src_ip"] == "10.0.0.2"
    sys = "2026-01-01T00:00:00+00:00 x@gw kern.info kernel: IN=e SRC=10.0.0.1 DST=9.9.9.9 PROTO=TCP SPT=5 DPT=22\n2026-01-01T00:00:01+00:00 gw auth.info sshd[9]: Failed password for invalid user eve from 10.0.0.3 port 77 ssh2\n"
    got = rows(r.log_file(spark, write(tmp_path, "s.log", sys), "syslog"))
    assert (got[0]["host"], got[0]["src_port"], got[0]["dst_port"], got[0]["transport"]) == ("gw", 5, 22, "tcp")
    assert (got[1]["user_name"], got[1]["outcome"], got[1]["src_ip"], got[1]["process_name"]) == ("eve", "failure", "10.0.0.3", "sshd")
    got = rows(r.log_file(spark, write(tmp_path, "x.log", "u=ann ip=10.0.0.4\nnope\n"), "regex", r"u=(?P<user>\w+) ip=(?P<ip>\S+)", {"user": "user.name", "ip": "source.ip"}))
    assert [(x["user_name"], x["src_ip"]) for x in got] == [("ann", "10.0.0.4")]
    with pytest.raises(ValueError):
        r.log_file(spark, str(tmp_path), "regex")
    got = rows(r.log_file(spark, write(tmp_path, "j.log", '{"Timestamp":"2026-01-01T00:00:00Z","user":"ann","status":"200"}\nbad\n'), "jsonl"))
    assert got[0]["user_name"] == "ann" and got[0]["http_status"] == 200


def test_registry_export(spark, tmp_path):
    text = 'Windows Registry Editor Version 5.00\r\n\r\n[HKEY_LOCAL_MACHINE\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run]\r\n"Upd"="C:\\\\Windows\\\\Temp\\\\svc.exe"\r\n@="x"\r\n"n"=dword:00000001\r\n[HKEY_LOCAL_MACHINE\\SYSTEM\\ControlSet001\\Services\\Evil]\r\n"ImagePath"=hex(2):63,00,6d,00,64,00,\\\r\n  2e,00,65,00,78,00,65,00,20,00,2f,00,63,00,00,00\r\n'
    got = rows(r.registry_export(spark, write(tmp_path, "a.reg", b"\xff\xfe" + text.encode("utf-16-le"))))
    assert [(x["registry_value"], x["registry_type"], x.get("ioc_severity")) for x in got] == [("Upd", "REG_SZ", "high"), ("(Default)", "REG_SZ", None), ("n", "REG_DWORD", None), ("ImagePath", "REG_EXPAND_SZ", "high")]
    assert got[0]["file_name"] == "C:\\Windows\\Temp\\svc.exe" and got[3]["registry_data"] == "cmd.exe /c" and got[3]["rule_description"] == "Services"


def test_registry_tree_and_mft(spark, tmp_path):
    tree = {"KeyPath": "ROOT", "SubKeys": [{"KeyPath": "ROOT\\Microsoft\\Windows\\CurrentVersion\\Run", "LastWriteTimestamp": "2026-01-01 00:00:00.1234567", "Values": [{"ValueName": "a", "ValueData": "C:\\x.exe"}], "SubKeys": []}]}
    got = rows(r.registry_tree(spark, write(tmp_path, "t.json", json.dumps(tree)), "SOFTWARE"))
    assert [(x["registry_value"], x["file_name"], x["ts"]) for x in got] == [("a", "C:\\x.exe", "2026-01-01T00:00:00.123456Z")]
    got = r.mft(spark, write(tmp_path, "m.json", json.dumps({"FileName": "evil", "Extension": ".exe", "ParentPath": ".\\Users\\Public", "Created0x10": "", "Created0x30": "2026-01-01 00:00:00", "FileSize": 7})))
    assert rows(got)[0] | {"file_name": "evil.exe", "ts": "2026-01-01T00:00:00Z", "bytes": 7} == rows(got)[0]
    assert r.suspicious_files(got).count() == 1 and r.executable_files(got).count() == 1
    many = [{"FileName": f"f{k}.jse", "FullPath": p} for k, p in enumerate(("C:\\Windows\\Tasks\\a.job", "C:\\PerfLogs\\b", "C:\\Temp\\c"))] + [{"FileName": "d", "FullPath": "C:\\Windows\\Temp\\d", "IsDirectory": True}]
    for text in ("\n".join(map(json.dumps, many)), json.dumps(many), json.dumps(many, indent=1), json.dumps({"Data": many})):
        got = r.mft(spark, write(tmp_path, "n.json", text))
        assert got.count() == 4 and r.suspicious_files(got).count() == 1 and r.executable_files(got).count() == 3


def test_logon_summary(spark, tmp_path):
    text = """Successful,Event,Target Account,Target Domain,Target Computer,Logon Type,Source Account,Source Domain,Source Computer,Source IP
12,4624,ann,CORP,ws1,3 - Network,svc10,CORP,ws2,10.0.0.9
x,4624,bob,CORP,ws1,- ,7,CORP,ws2,10.0.0.8
1,4624,short
"""
    got = r.logon_summary(spark, write(tmp_path, "l.csv", text)).collect()
    assert [(x.n, x.user, x.host, x.src_ip, x.logon_type) for x in got] == [(12, "ann", "ws1", "10.0.0.9", "3"), (0, "bob", "ws1", "10.0.0.8", None)]


def test_zeek_with_the_logs_that_are_there(spark, tmp_path):
    folder = tmp_path / "capture.pcap"
    folder.mkdir()
    assert r.zeek(spark, str(folder)).count() == 0
    (folder / "conn.log").write_text("#separator \\x09\n#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tconn_state\n1767225600.5\tC1\t10.0.0.1\t5\t10.0.0.2\t53\tudp\tSF\n")
    got = rows(r.zeek(spark, str(folder)))
    assert [(x["source"], x["src_ip"], x["outcome"]) for x in got] == [("pcap:capture.pcap", "10.0.0.1", "success")]


def test_registry_tree_of_many_levels(spark, tmp_path):
    tree = {"KeyPath": "ROOT\\Microsoft\\Windows\\CurrentVersion\\Run", "LastWriteTimestamp": "2026-01-01 00:00:00", "Values": [{"ValueName": "deep", "ValueData": "C:\\x.exe"}]}
    for k in range(14):
        tree = {"KeyPath": f"ROOT\\k{k}", "SubKeys": [tree]}
    got = rows(r.registry_tree(spark, write(tmp_path, "t.json", json.dumps(tree)), "SOFTWARE"))
    assert [x["registry_value"] for x in got] == ["deep"]


def test_thor(spark, tmp_path):
    line = "Jan  5 10:00:00 ws1/10.0.0.1 THOR: Alert: MODULE: Filescan FILE: C:\\Temp\\e v.exe SCORE: 90 MD5: " + "a" * 32 + " REASON_1: bad TARGET: C:\\y.dll\nJan  5 10:00:01 ws1 THOR: Info: MESSAGE: none\n"
    got = rows(r.thor(spark, write(tmp_path, "ws1_2026-01-05.txt", line)))
    assert [(x["action"], x["file_name"]) for x in got] == [("thor-finding", "e v.exe"), ("thor-linked", "y.dll")]
    assert got[0]["ts"] == "2026-01-05T10:00:00Z" and got[0]["rule_level"] == "critical"


def test_osquery(spark, tmp_path):
    recs = [{"name": "proc", "hostIdentifier": "h", "unixTime": 1767225600, "action": "added", "columns": {"pid": "1", "cmdline": "x", "name": "sh"}}, {"name": "socks", "hostIdentifier": "h", "unixTime": "1767225600", "columns": {"pid": "1", "socket": "3", "remote_address": "9.9.9.9", "remote_port": "0"}}, {"name": "x"}]
    got = rows(r.osquery(spark, write(tmp_path, "o.json", "\n".join(map(json.dumps, recs)))))
    assert [(x["category"], x.get("process_name"), x.get("dst_port")) for x in got] == [("process", "sh", None), ("network", None, None)]


def test_crowdstrike(spark, tmp_path):
    card = "Host name: ws1\nFile name: evil.exe\nCommand line: evil.exe -x\nSHA 256: " + "a" * 64 + "\n\nHost name: ws2\nIP address: 10.0.0.1\n"
    got = rows(r.crowdstrike(spark, write(tmp_path, "c.txt", card)))
    assert sorted((x["host"], x.get("category"), x.get("src_ip")) for x in got) == [("ws1", "process", None), ("ws2", None, "10.0.0.1")]
    line = "@rawstring: " + json.dumps({"timestamp": "1767225600000", "ComputerName": "ws3", "event_simpleName": "DnsRequest", "DomainName": "x.example", "aip": "1.2.3.4"})
    got = rows(r.crowdstrike(spark, write(tmp_path, "d.txt", line)))
    assert got[0] | {"ts": "2026-01-01T00:00:00Z", "host": "ws3", "dns_query": "x.example"} == got[0] and "src_ip" not in got[0]


def test_literal_scan_and_errors(spark, tmp_path):
    p = write(tmp_path, "f.bin", b"\x00MALWARE\xff")
    assert [x["rule_name"] for x in rows(r.literal_scan(spark, p, {"m": ["MALWARE"], "n": ["none"]}))] == ["m"]
    errors = []
    assert r.build_events(spark, [("evtx", str(tmp_path / "missing"), {})], errors) is None and len(errors) == 1


def test_kinds_are_told_by_name_and_content(spark, tmp_path):
    from loglattice.sources.detect import detect, routed

    files = {
        "a.txt": "Jan  5 10:00:00 ws1 THOR: Alert: SCORE: 90\n", "b.csv": "a" * 32 + ",C:\\x,90\n", "c.json": '{"hostIdentifier":"h","unixTime":1}\n', "d.txt": "Host name: ws\nDescription: x\n", "e.jsonl": '{"RuleTitle":"r","Computer":"c"}\n',
        "f.json": '{"EventId":1,"Payload":"{}"}\n', "g.json": '{"KeyPath":"k","LastWriteTimestamp":"2026-01-01 00:00:00"}', "h.json": '{"EntryNumber":1,"FileName":"f"}\n', "i.log": "any line\n", "j.reg": "x\n", "k.evtx": "x\n", "SYSTEM": "regf....\n", "m.xyz": "x\n", "n.log": "", "NOTE": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = {r.path.rpartition("/")[2]: r.kind for r in detect(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "thor", "b.csv": "thor_csv", "c.json": "osquery", "d.txt": "crowdstrike", "e.jsonl": "evtx", "f.json": "evtx_full", "g.json": "registry_tree", "h.json": "mft", "i.log": "log", "j.reg": "reg", "k.evtx": "evtx_binary", "SYSTEM": "hive_binary", "m.xyz": None}
    taken, left = routed(spark, str(tmp_path))
    assert {k for k, _, _ in taken} == {"thor", "osquery", "crowdstrike", "evtx", "evtx_full", "registry_tree", "mft", "log", "reg"} and {p.rpartition("/")[2] for p, _ in left} == {"k.evtx", "SYSTEM", "m.xyz"}


def test_slice_report(spark, tmp_path):
    from loglattice.events import derive
    from loglattice.operators.slices import slice_report

    lines = [{"Timestamp": f"2026-01-01T00:00:0{k}Z", "EventID": 1, "Channel": "Sysmon", "Computer": "ws1", "RuleTitle": f"r|{k}", "Level": level, "MitreTags": tags, "MitreTactics": tactics, "Details": {"Proc": "p" * 60}} for k, (level, tags, tactics) in enumerate([("crit", ["T1110"], ["CredAccess"]), ("med", ["T1059.001", "T1110"], []), ("info", [], [])])]
    text = slice_report(derive(r.detections(spark, write(tmp_path, "d.jsonl", "\n".join(map(json.dumps, lines))))), "d.jsonl", "now", 2)
    assert "Detections: 3 · critical: 1 · medium: 1 · informational: 1" in text and "- **credential-access**: T1110" in text and "- **(tactic not indicated)**: T1059.001, T1110" in text
    assert "1 detections have no technique." in text and "| 2026-01-01T00:00:00Z | critical | r/0 | T1110 | 1 | " + "p" * 45 + "… |" in text and text.rstrip().endswith("1 more")
