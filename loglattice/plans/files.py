"""Registered queries of the source readers: files are written from the tables, read back, and held against DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice import cases
from loglattice.operators import extras
from loglattice.plans.queries import ISO, register, table
from loglattice.plans.telemetry import EPOCH
from loglattice.sources import checked, readers, splits
from loglattice.storage import scratch_path

BACK = chr(92)


def _written(spark: SparkSession, rows: DataFrame, label: str) -> str:
    """A folder of text files with the one column of ``rows``."""
    path = scratch_path(spark, label)
    rows.write.text(path)
    return path


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


#: Every event id that is a success or a failure by itself, and two that are neither.
_WINDOWS_IDS = (4624, 4634, 4647, 4672, 4768, 4769, 4625, 4771, 4648, 4688)
_WINDOWS_ID = f"element_at(array{_WINDOWS_IDS}, cast(user_id % {len(_WINDOWS_IDS)} + 1 as int))"
_EVENT_ID = "CASE event_type WHEN 'signup' THEN 4624 WHEN 'error' THEN 4625 WHEN 'click' THEN 4688 WHEN 'view' THEN 4663 ELSE 99999 END"


@register(
    "read_detections",
    f"""SELECT event_id::VARCHAR AS message_id, strftime(ts, {ISO}) AS ts, {_EVENT_ID} AS event_code, CASE event_type WHEN 'signup' THEN 'authentication' WHEN 'error' THEN 'authentication' WHEN 'click' THEN 'process' WHEN 'view' THEN 'file' END AS category,
  CASE event_type WHEN 'signup' THEN 'logon' WHEN 'error' THEN 'logon-failed' WHEN 'click' THEN 'process-create' WHEN 'view' THEN 'object-access-attempt' ELSE 'rule ' || event_type END AS action,
  CASE WHEN user_id % 3 = 0 THEN 'T1110,t1078.002' ELSE '' END AS techniques, CASE WHEN user_id % 3 = 0 THEN 'credential-access,other' ELSE '' END AS tactics_declared, 'ws' || user_id % 50 AS host, CASE WHEN user_id % 2 = 0 THEN 'u' || user_id ELSE 's' || user_id END AS user_name,
  'p' || user_id % 7 || '.exe' AS process_name, CASE WHEN user_id % 4 <> 0 THEN '10.0.0.' || user_id % 250 END AS src_ip, CASE WHEN user_id % 5 = 0 THEN (8000 + user_id % 100)::INT END AS dst_port, user_id % 2 = 0 AS sigma_community FROM events""",
)
def read_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    details = F.struct(
        F.when(u % 2 == 0, text("u", u)).otherwise("").alias("User"), text("s", u).alias("SrcUser"), F.concat(F.lit("p"), (u % 7).cast("string"), F.lit(".exe")).alias("Proc"), F.col("event_id").cast("string").alias("Cmdline"),
        F.when(u % 4 != 0, text("10.0.0.", u % 250)).alias("SrcIP"), F.when(u % 5 == 0, 8000 + u % 100).otherwise(None).alias("TgtPort"),
    )
    line = _json(
        Timestamp=F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), EventID=F.expr(_EVENT_ID), Channel=F.lit("Security"), Computer=text("ws", u % 50), RuleTitle=text("rule ", F.col("event_type")), Level=F.lit("high"),
        RuleFile=F.when(u % 2 == 0, "rules/sigma-community/x.yml").otherwise("builtin.yml"), MitreTags=F.when(u % 3 == 0, F.array(F.lit("T1110"), F.lit("G0001"), F.lit("t1078.002"))), MitreTactics=F.when(u % 3 == 0, F.array(F.lit("CredAccess"), F.lit("Other"))), Details=details,
    )
    got = readers.detections(spark, _written(spark, table(spark, sf_dir, "events").select(line.alias("value")), "detections"))
    return got.select(F.col("cmdline").alias("message_id"), "ts", "event_code", "category", "action", "techniques", "tactics_declared", "host", "user_name", "process_name", "src_ip", "dst_port", "sigma_community")


@register(
    "read_windows_events",
    f"""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.123456Z' AS ts, ([{", ".join(map(str, _WINDOWS_IDS))}])[user_id % {len(_WINDOWS_IDS)} + 1]::INT AS event_code, CASE WHEN user_id % 3 = 0 THEN 'failure' WHEN user_id % 3 = 1 THEN 'success' WHEN user_id % 10 <= 5 THEN 'success' WHEN user_id % 10 <= 7 THEN 'failure' END AS outcome, 'ws' || user_id % 50 AS host,
  CASE WHEN user_id % 4 = 0 THEN 'u' || user_id || '@corp.example' ELSE 'CORP' || chr(92) || 'u' || user_id END AS user_name, CASE WHEN user_id % 2 = 0 THEN '10.0.0.' || user_id % 250 END AS src_ip, (user_id % 12)::VARCHAR AS logon_type, CASE WHEN user_id % 5 = 0 THEN md5('x' || user_id) END AS file_hash_md5 FROM events""",
)
def read_windows_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    pair = lambda name, value: F.create_map(F.lit("@Name"), F.lit(name), F.lit("#text"), value)
    data = F.array(
        pair("TargetUserName", F.when(u % 4 == 0, F.concat(text("u", u), F.lit("@corp.example"))).otherwise(text("u", u))), pair("TargetDomainName", F.lit("CORP")), pair("IpAddress", F.when(u % 2 == 0, text("10.0.0.", u % 250)).otherwise("")),
        pair("LogonType", (u % 12).cast("string")), pair("Hashes", F.when(u % 5 == 0, F.concat(F.lit("MD5="), F.md5(text("x", u).cast("binary")))).otherwise("")),
    )
    payload = F.to_json(F.struct(F.struct(data.alias("Data")).alias("EventData")))
    line = _json(EventId=F.expr(_WINDOWS_ID), Channel=F.lit("Security"), Computer=text("ws", u % 50), TimeCreated=F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit(".1234567")), Keywords=F.when(u % 3 == 0, "Audit failure").when(u % 3 == 1, "Audit success"), Payload=payload)
    got = readers.windows_events(spark, _written(spark, table(spark, sf_dir, "events").select(line.alias("value")), "windows"))
    return got.select("ts", "event_code", "outcome", "host", "user_name", "src_ip", "logon_type", "file_hash_md5")


@register(
    "read_packets",
    f"""SELECT strftime(make_timestamp(({EPOCH} + o_orderkey % 100000) * 1000000), {ISO}) AS ts, CASE WHEN o_orderkey % 2 = 0 THEN '10.0.0.' || o_custkey % 250 ELSE 'fe80::' || o_custkey % 250 END AS src_ip, '10.1.0.9' AS dst_ip, (1024 + o_orderkey % 60000)::INT AS src_port,
  CASE WHEN o_orderkey % 3 = 0 THEN 53 ELSE 443 END::INT AS dst_port, CASE WHEN o_orderkey % 3 = 0 THEN 'udp' ELSE 'tcp' END AS transport, (o_orderkey % 1500)::BIGINT AS bytes, CASE WHEN o_orderkey % 3 = 0 THEN 'q' || o_custkey || '.example' END AS dns_query FROM orders""",
)
def read_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), (F.col("o_custkey") % 250).cast("string")
    udp = k % 3 == 0
    port = (1024 + k % 60000).cast("string")
    cells = {
        "time": F.concat((F.lit(EPOCH) + k % 100000).cast("string"), F.lit(".000000")), "src4": F.when(k % 2 == 0, F.concat(F.lit("10.0.0."), c)), "src6": F.when(k % 2 != 0, F.concat(F.lit("fe80::"), c)), "dst4": F.lit("10.1.0.9"), "dst6": F.lit(None), "proto": F.when(udp, "17").otherwise("6"),
        "tcp_src": F.when(~udp, port), "tcp_dst": F.when(~udp, "443"), "udp_src": F.when(udp, port), "udp_dst": F.when(udp, "53"), "length": (k % 1500).cast("string"), "query": F.when(udp, F.concat(F.lit("q"), F.col("o_custkey").cast("string"), F.lit(".example"))), "method": F.lit(None), "url": F.lit(None),
    }
    line = F.concat_ws("\t", *[F.coalesce(cells[f], F.lit("")) for f in readers.PACKET_FIELDS])
    got = readers.packets(spark, _written(spark, table(spark, sf_dir, "orders").select(line.alias("value")), "packets"))
    return got.select("ts", "src_ip", "dst_ip", "src_port", "dst_port", "transport", "bytes", "dns_query")


@register(
    "read_zeek",
    """WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'SF' WHEN 1 THEN 'S0' WHEN 2 THEN 'REJ' ELSE 'OTH' END AS state, CASE WHEN c_custkey % 2 = 0 THEN 'tcp' ELSE 'udp' END AS proto FROM customer)
SELECT '10.0.' || k // 250 || '.' || k % 250 AS src_ip, (1000 + k % 100)::INT AS src_port, proto AS transport, CASE WHEN state = 'S0' AND proto = 'udp' THEN NULL WHEN state IN ('S0', 'REJ') THEN 'failure' ELSE 'success' END AS outcome, CASE WHEN k % 5 = 0 THEN 7 ELSE 7 + k % 100 END::BIGINT AS bytes,
  CASE WHEN k % 3 = 0 THEN 'd' || k || '.example' END AS dns_query, CASE WHEN k % 7 = 0 THEN 'Scan' END AS rule_title FROM c""",
)
def read_zeek(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "zeek")
    k = F.col("c_custkey")
    text = lambda p, c, s="": F.concat(F.lit(p), c.cast("string"), F.lit(s))
    rows = table(spark, sf_dir, "customer").withColumn("uid", text("C", k))

    def log(name: str, where: Column, fields: dict[str, Column]) -> None:
        head = spark.createDataFrame([("\t".join(["#fields", *fields]),)], "value string")
        body = rows.filter(where).select(F.concat_ws("\t", *fields.values()).alias("value"))
        head.unionByName(body).coalesce(1).write.text(f"{folder}/{name}.log")  # a log is one file with its header

    state = F.when(k % 4 == 0, "SF").when(k % 4 == 1, "S0").when(k % 4 == 2, "REJ").otherwise("OTH")
    log("conn", F.lit(True), {
        "ts": text("", F.lit(EPOCH) + k, ".25"), "uid": F.col("uid"), "id.orig_h": F.concat(F.lit("10.0."), F.expr("cast(c_custkey div 250 as string)"), F.lit("."), (k % 250).cast("string")), "id.orig_p": text("", 1000 + k % 100),
        "id.resp_h": F.lit("10.9.9.9"), "id.resp_p": F.lit("53"), "proto": F.when(k % 2 == 0, "tcp").otherwise("udp"), "service": F.lit("-"), "conn_state": state, "orig_bytes": F.lit("7"), "resp_bytes": F.when(k % 5 == 0, "-").otherwise((k % 100).cast("string")),
    })
    log("dns", k % 3 == 0, {"ts": F.lit("1"), "uid": F.col("uid"), "query": text("d", k, ".example"), "answers": F.lit("(empty)"), "rcode_name": F.lit("NOERROR")})
    log("notice", k % 7 == 0, {"ts": F.lit("1"), "uid": F.col("uid"), "note": F.lit("Scan"), "msg": F.lit("ports")})
    return readers.zeek(spark, folder).select("src_ip", "src_port", "transport", "outcome", "bytes", "dns_query", "rule_title")


@register("read_log_jsonl", "SELECT c_name AS user_name, '10.0.0.' || c_custkey % 250 AS src_ip, (200 + c_custkey % 300)::INT AS http_status, 'm' || c_custkey AS message FROM customer WHERE c_custkey % 10 <> 0")
def read_log_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    line = F.when(k % 10 == 0, "not json").otherwise(F.to_json(F.create_map(F.lit("User"), F.col("c_name"), F.lit("src_ip"), F.concat(F.lit("10.0.0."), (k % 250).cast("string")), F.lit("STATUS"), (200 + k % 300).cast("string"), F.lit("msg"), F.concat(F.lit("m"), k.cast("string")))))
    got = readers.log_file(spark, _written(spark, table(spark, sf_dir, "customer").select(line.alias("value")), "jsonl"), "jsonl")
    return got.select("user_name", "src_ip", "http_status", "message")


@register("read_log_regex", "SELECT 'u' || c_custkey AS user_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '10.0.0.' || c_custkey % 250 END AS src_ip FROM customer WHERE c_custkey % 5 <> 0")
def read_log_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    line = F.when(k % 5 == 0, "other").otherwise(F.concat(F.lit("u=u"), k.cast("string"), F.lit(" (x) ip="), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("10.0.0."), (k % 250).cast("string"))), F.lit(";")))
    got = readers.log_file(spark, _written(spark, table(spark, sf_dir, "customer").select(line.alias("value")), "regex"), "regex", r"u=(?P<user>\w+) \((x)\) ip=(?P<ip>[0-9.]*);", {"user": "user.name", "ip": "source.ip"})
    return got.select("user_name", "src_ip")


@register("read_mft", "SELECT 'f' || p_partkey || '.exe' AS file_name, CASE WHEN p_size % 2 = 0 THEN 'directory-metadata' ELSE 'file-metadata' END AS action, CASE WHEN p_size % 3 = 0 THEN '2026-01-02T00:00:00.123456Z' ELSE '2026-01-01T00:00:00Z' END AS ts, p_size::BIGINT AS bytes FROM part")
def read_mft(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, base = F.col("p_size"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    line = _json(
        EntryNumber=F.col("p_partkey"), FileName=F.when(size % 5 == 0, base).otherwise(F.concat(base, F.lit(".exe"))), Extension=F.when(size % 4 == 0, "exe").otherwise(".exe"), FullPath=F.lit("C:" + BACK + "x"), FileSize=size, IsDirectory=size % 2 == 0,
        Created0x10=F.when(size % 3 == 0, "").otherwise("2026-01-01 00:00:00"), LastModified0x30=F.lit("2026-01-02 00:00:00.1234567"),
    )
    return readers.mft(spark, _written(spark, table(spark, sf_dir, "part").select(line.alias("value")), "mft")).select("file_name", "action", "ts", "bytes")


@register(
    "read_osquery",
    f"""SELECT strftime(make_timestamp(({EPOCH} + event_id) * 1000000), {ISO}) AS ts, CASE WHEN user_id % 2 = 0 THEN 'process' ELSE 'network' END AS category, CASE WHEN user_id % 2 = 0 THEN 'sh' END AS process_name, CASE WHEN user_id % 2 = 1 THEN '9.9.9.' || user_id % 250 END AS dst_ip,
  CASE WHEN user_id % 2 = 1 AND user_id % 10 > 0 THEN (user_id % 10)::INT END AS dst_port, 'u' || user_id AS user_name, CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR END AS pid FROM events WHERE event_id > 0""",
)
def read_osquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    columns = F.when(u % 2 == 0, F.create_map(F.lit("pid"), u.cast("string"), F.lit("cmdline"), F.lit("sh -c x"), F.lit("name"), F.lit("sh"))).otherwise(F.create_map(F.lit("socket"), F.lit("3"), F.lit("remote_address"), F.concat(F.lit("9.9.9."), (u % 250).cast("string")), F.lit("remote_port"), (u % 10).cast("string")))
    line = F.when(F.col("event_id") > 0, _json(name=F.lit("pack"), hostIdentifier=F.lit("h"), unixTime=F.lit(EPOCH) + F.col("event_id"), action=F.lit("added"), columns=columns, decorations=F.create_map(F.lit("username"), F.concat(F.lit("u"), u.cast("string"))))).otherwise('{"name":"no time"}')
    got = readers.osquery(spark, _written(spark, table(spark, sf_dir, "events").select(line.alias("value")), "osquery"))
    return got.select("ts", "category", "process_name", "dst_ip", "dst_port", "user_name", "pid")


@register("read_crowdstrike", f"SELECT strftime(make_timestamp(({EPOCH} + c_custkey) * 1000000), {ISO}) AS ts, 'ws' || c_custkey AS host, CASE WHEN c_custkey % 2 = 0 THEN 'process' END AS category, CASE WHEN c_custkey % 2 = 0 THEN 'x -y' END AS cmdline, CASE WHEN c_custkey % 2 = 1 THEN 'd' || c_custkey || '.example' END AS dns_query FROM customer")
def read_crowdstrike(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    body = _json(timestamp=((F.lit(EPOCH) + k) * 1000).cast("string"), ComputerName=F.concat(F.lit("ws"), k.cast("string")), CommandLine=F.when(k % 2 == 0, "x -y"), DomainName=F.when(k % 2 == 1, F.concat(F.lit("d"), k.cast("string"), F.lit(".example"))))
    line = F.when(k % 3 == 0, F.concat(F.lit("@rawstring: "), body)).otherwise(body)
    return readers.crowdstrike(spark, _written(spark, table(spark, sf_dir, "customer").select(line.alias("value")), "crowdstrike")).select("ts", "host", "category", "cmdline", "dns_query")


@register("read_logon_summary", """SELECT CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE (c_custkey % 100)::INT END AS n, '4624' AS event, c_name AS "user", 'ws' || c_custkey % 20 AS host, '10.0.0.' || c_custkey % 250 AS src_ip, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_custkey % 4)::VARCHAR END AS logon_type FROM customer WHERE c_custkey % 11 <> 0""")
def read_logon_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "-").otherwise(F.concat((k % 4).cast("string"), F.lit(" - Network")))
    cells = [F.when(k % 9 == 0, "many").otherwise((k % 100).cast("string")), F.lit("4624"), F.col("c_name"), F.lit("CORP"), F.concat(F.lit("ws"), (k % 20).cast("string")), kind, F.lit("svc7"), F.lit("CORP"), F.lit("src"), F.concat(F.lit("10.0.0."), (k % 250).cast("string"))]
    line = F.when(k % 11 == 0, "1,4624,short").otherwise(F.concat_ws(",", *cells))
    return readers.logon_summary(spark, _written(spark, table(spark, sf_dir, "customer").select(line.alias("value")), "logons"))


@register("read_thor", "SELECT 'ws' || p_partkey AS host, CASE p_size % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END AS rule_level, part.action, CASE WHEN part.action = 'thor-linked' THEN 'y.dll' ELSE 'e ' || p_partkey || '.exe' END AS file_name, (p_size + 50)::VARCHAR AS ioc_severity FROM (SELECT *, unnest(CASE WHEN p_size % 2 = 0 THEN ['thor-finding', 'thor-linked'] ELSE ['thor-finding'] END) AS action FROM part) part WHERE p_size % 5 <> 0")
def read_thor(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, k = F.col("p_size"), F.col("p_partkey").cast("string")
    level = F.when(size % 3 == 0, "Alert").when(size % 3 == 1, "Warning").otherwise("Notice")
    line = F.concat(F.lit("Jan  5 10:00:00 ws"), k, F.lit("/10.0.0.1 THOR: "), level, F.lit(": MODULE: Filescan FILE: C:" + BACK + "Temp" + BACK + "e "), k, F.lit(".exe"), F.when(size % 5 != 0, F.concat(F.lit(" SCORE: "), (size + 50).cast("string"))).otherwise(""), F.lit(" REASON_1: bad"), F.when(size % 2 == 0, " TARGET: C:" + BACK + "y.dll").otherwise(""))
    return readers.thor(spark, _written(spark, table(spark, sf_dir, "part").select(line.alias("value")), "thor"), 2026).select("host", "rule_level", "action", "file_name", "ioc_severity")


@register(
    "read_registry_export",
    """SELECT 'v' || s_suppkey AS registry_value, CASE WHEN s_suppkey % 2 = 0 THEN 'User ASEP - Run' ELSE 'Services' END AS rule_description, CASE WHEN s_suppkey % 2 = 1 THEN NULL WHEN s_suppkey % 4 = 0 THEN 'Run key with Temp directory path' WHEN s_suppkey % 3 = 0 THEN 'Run key with user-writable AppData path' END AS ioc_description,
  CASE WHEN s_suppkey % 2 = 1 THEN NULL WHEN s_suppkey % 4 = 0 THEN 'C:' || chr(92) || 'Temp' || chr(92) || 'a.exe' WHEN s_suppkey % 3 = 0 THEN 'C:' || chr(92) || 'Users' || chr(92) || 'ann' || chr(92) || 'AppData' || chr(92) || 'b.exe' ELSE 'c.exe' END AS file_name FROM supplier""",
)
def read_registry_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    path = lambda *parts: (BACK * 2).join(parts)
    value = F.when(k % 4 == 0, path("C:", "Temp", "a.exe") + " -q").when(k % 3 == 0, path("C:", "Users", "ann", "AppData", "b.exe")).otherwise("c.exe /s")
    key = F.when(k % 2 == 0, BACK.join(["[HKEY_CURRENT_USER", "Software", "Microsoft", "Windows", "CurrentVersion", "Run]"])).otherwise(BACK.join(["[HKEY_LOCAL_MACHINE", "SYSTEM", "ControlSet002", "Services", "Evil]"]))
    text = F.concat(key, F.lit('\n"v'), k.cast("string"), F.lit('"="'), value, F.lit('"'))
    got = readers.registry_export(spark, _written(spark, table(spark, sf_dir, "supplier").select(text.alias("value")), "reg"))
    return got.select("registry_value", "rule_description", "ioc_description", "file_name")


_TIMES = f"strftime(make_timestamp(({EPOCH} + o_orderkey) * 1000000), {ISO})"


def _detection(**more: Column) -> Column:
    k = F.col("o_orderkey")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    at = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + k), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.struct(at.alias("Timestamp"), F.lit(4625).alias("EventID"), F.lit("Security").alias("Channel"), text("ws", F.col("o_custkey")).alias("Computer"), F.lit("r").alias("RuleTitle"), F.struct(text("u", k).alias("User"), *[v.alias(c) for c, v in more.items()]).alias("Details"))


def _case_of_orders(spark: SparkSession, sf_dir: str) -> cases.Case:
    """A case with two batches: detections with a field of their own, and flat events with another."""
    case = cases.Case(spark, scratch_path(spark, "cases"), "orders").create()
    orders = table(spark, sf_dir, "orders")
    found = orders.filter("o_orderkey % 2 = 0").select(F.to_json(_detection(Price=F.struct(F.col("o_totalprice").cast("bigint").alias("total"), F.col("o_orderpriority").alias("kind")))).alias("value"))
    case.append_source("evtx", _written(spark, found, "case-detections"))
    k = F.col("o_orderkey")
    flat = orders.filter(k % 2 == 1).select(F.date_format(F.timestamp_seconds(F.lit(EPOCH) + k), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit("scan").alias("source"), F.concat(F.lit("ws"), F.col("o_custkey").cast("string")).alias("host"), (k % 65536).cast("int").alias("dst_port"), F.struct(F.col("o_totalprice").cast("bigint").alias("total"), F.col("o_orderpriority").alias("kind")).alias("Price"))
    case.append(flat)
    return case


@register("case_originals", "SELECT 'ws' || o_custkey AS host, o_orderpriority AS kind, count(*) AS n, sum(o_totalprice::BIGINT)::BIGINT AS total FROM (SELECT o_custkey, o_orderpriority, trunc(o_totalprice) AS o_totalprice FROM orders) GROUP BY ALL")
def case_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that the flat schema lacks, asked of the stored originals of both batches."""
    records = _case_of_orders(spark, sf_dir).records()
    price = lambda field, kind: F.coalesce(*[F.try_variant_get("record", f"$.{p}Price.{field}", kind) for p in ("Details.", "")])
    host = F.coalesce(F.try_variant_get("record", "$.Computer", "string"), F.try_variant_get("record", "$.host", "string"))
    return records.groupBy(host.alias("host"), price("kind", "string").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(price("total", "bigint")).alias("total"))


@register("case_rebuild", f"SELECT {_TIMES} AS ts, 'ws' || o_custkey AS host, CASE WHEN o_orderkey % 2 = 0 THEN 'u' || o_orderkey END AS user_name, CASE WHEN o_orderkey % 2 = 0 THEN 'logon-failed' END AS action, CASE WHEN o_orderkey % 2 = 1 THEN (o_orderkey % 65536)::INT END AS dst_port FROM orders")
def case_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns made anew from the stored originals."""
    case = _case_of_orders(spark, sf_dir)
    case.rebuild(every=True)
    return case.raw().select("ts", "host", "user_name", "action", "dst_port")


@register("read_errors", f"SELECT CASE WHEN o_orderkey % 7 <> 0 THEN {_TIMES} END AS ts, CASE WHEN o_orderkey % 7 <> 0 THEN 'u' || o_orderkey END AS user_name, CASE WHEN o_orderkey % 7 = 0 THEN 'cut ' || o_orderkey END AS lost, CASE WHEN o_orderkey % 7 = 0 THEN 'not a JSON object' END AS reason FROM orders")
def read_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good events and the lines that are none, from one reading in small ranges."""
    k = F.col("o_orderkey")
    value = F.when(k % 7 == 0, F.concat(F.lit("cut "), k.cast("string"))).otherwise(F.to_json(_detection()))
    path = _written(spark, table(spark, sf_dir, "orders").select(value.alias("value")), "damaged")
    events, dead, _ = checked.settle(checked.checked(spark, [("evtx", path, {})], split_bytes=1 << 20), scratch_path(spark, "checked"))
    return events.select("ts", "user_name").unionByName(dead.select(F.col("original").alias("lost"), "reason"), allowMissingColumns=True)


@register("read_json_splits", '''SELECT o_orderkey AS k, o_orderpriority || ' "]}{[' AS text, o_custkey AS nested FROM orders''')
def read_json_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects over many lines, cut out of files that are read in ranges of 64 KiB."""
    body = F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.concat(F.col("o_orderpriority"), F.lit(' "]}{[')).alias("text"), F.array(F.struct(F.col("o_custkey").alias("deep"))).alias("list")), {"pretty": "true"})
    path = _written(spark, table(spark, sf_dir, "orders").select(body.alias("value")), "pretty")
    rows = splits.json_elements(spark, path, 1 << 16).filter("reason is null")
    return rows.select(F.from_json("text", "k bigint, text string, list array<struct<deep: bigint>>").alias("o")).select("o.k", "o.text", F.col("o.list")[0]["deep"].alias("nested"))


@register("read_registry_splits", "SELECT 'HKEY_LOCAL_MACHINE' || chr(92) || 'k' || o_orderkey AS registry_key, v AS registry_value, CASE v WHEN 'a' THEN o_orderpriority WHEN 'm' THEN 'x' || chr(10) || 'y' ELSE '0000' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') END AS registry_data, CASE v WHEN 'a' THEN 'REG_SZ' WHEN 'm' THEN 'REG_MULTI_SZ' ELSE 'REG_DWORD' END AS registry_type FROM orders, (SELECT unnest(['a', 'm', 'd']) AS v)")
def read_registry_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with several values, one of them continued, from exports that are read in ranges of 64 KiB."""
    k = F.col("o_orderkey").cast("string")
    lines = [F.concat(F.lit(f"[HKEY_LOCAL_MACHINE{BACK}k"), k, F.lit("]")), F.concat(F.lit('"a"="'), F.col("o_orderpriority"), F.lit('"')), F.lit(f'"m"=hex(7):78,00,00,00,{BACK}'), F.lit("  79,00,00,00,00,00"), F.concat(F.lit('"d"=dword:0000'), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")), F.lit("")]
    path = _written(spark, table(spark, sf_dir, "orders").select(F.concat_ws("\n", *lines).alias("value")), "reg-splits")
    rows = splits.split_rows(spark, path, "registry", 1 << 16).filter("reason is null")
    return readers.registry_rows(rows).select("registry_key", "registry_value", "registry_data", "registry_type")


@register("read_crowdstrike_cards", "SELECT 'ws' || c_custkey AS host, 'Windows' AS host_os, 'a' || c_custkey AS agent_id, 'process' AS category, c_name || ' -x' AS cmdline, md5('x' || c_custkey) AS file_hash_md5 FROM customer")
def read_crowdstrike_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    fields = {"Host name": F.concat(F.lit("ws"), k), "Platform": F.lit("Windows"), "Agent ID": F.concat(F.lit("a"), k), "Command line": F.concat(F.col("c_name"), F.lit(" -x")), "MD5 Hash": F.md5(F.concat(F.lit("x"), k).cast("binary"))}
    card = F.concat(*[x for label, v in fields.items() for x in (F.lit(f"{label}: "), v, F.lit("\n"))])
    return readers.crowdstrike(spark, _written(spark, table(spark, sf_dir, "customer").select(card.alias("value")), "cards")).select("host", "host_os", "agent_id", "category", "cmdline", "file_hash_md5")


@register("read_osquery_tables", "SELECT 'h' || c_custkey % 20 AS host, 'process' AS category, (c_custkey % 30000)::VARCHAR AS pid, (c_custkey % 100)::VARCHAR AS parent_pid, (c_custkey % 7)::VARCHAR AS user_id, sha1('f' || c_custkey) AS file_hash_sha1 FROM customer")
def read_osquery_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    columns = F.struct((k % 30000).cast("string").alias("pid"), (k % 100).cast("string").alias("parent"), (k % 7).cast("string").alias("uid"), F.sha1(F.concat(F.lit("f"), k.cast("string")).cast("binary")).alias("sha1"))
    line = _json(name=F.lit("processes"), unixTime=F.lit(EPOCH) + k, hostIdentifier=F.concat(F.lit("h"), (k % 20).cast("string")), columns=columns)
    got = readers.osquery(spark, _written(spark, table(spark, sf_dir, "customer").select(line.alias("value")), "osquery-tables"))
    return got.select("host", "category", "pid", "parent_pid", "user_id", "file_hash_sha1")


@register("read_thor_csv", "SELECT md5(o_orderkey::VARCHAR) AS file_hash, 'f' || o_orderkey || '.exe' AS file_name, (o_orderkey % 997)::VARCHAR AS ioc_severity, 'thor-finding' AS action FROM orders WHERE o_orderkey % 9 <> 0")
def read_thor_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = F.concat(F.md5(k.cast("string").cast("binary")), F.lit(f',"C:{BACK}a b{BACK}f'), k.cast("string"), F.lit('.EXE",'), F.when(k % 9 == 0, "Score").otherwise((k % 997).cast("string")))
    return readers.thor_csv(spark, _written(spark, table(spark, sf_dir, "orders").select(line.alias("value")), "thor-csv")).select("file_hash", "file_name", "ioc_severity", "action")


@register(
    "thor_findings",
    f"""SELECT 'host' || o_custkey % 50 AS host, (o_orderkey % 997)::VARCHAR AS ioc_severity, md5(o_orderkey::VARCHAR) AS file_hash FROM orders WHERE o_orderkey % 5 <> 0 ORDER BY o_orderkey % 997 DESC, 'Jan 01 00:00:00 host' || o_custkey % 50 || '/10.0.0.1 THOR: Alert: MODULE: Filescan MESSAGE: m FILE: C:' || chr(92) || 'f' || o_orderkey || '.exe SCORE: ' || o_orderkey % 997 || ' MD5: ' || md5(o_orderkey::VARCHAR) LIMIT 1000""",
)
def thor_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanner's findings with the highest scores, over what the reader makes of its report."""
    k = F.col("o_orderkey")
    line = F.concat(F.lit("Jan 01 00:00:00 host"), (F.col("o_custkey") % 50).cast("string"), F.lit(f"/10.0.0.1 THOR: Alert: MODULE: Filescan MESSAGE: m FILE: C:{BACK}f"), k.cast("string"), F.lit(".exe"), F.when(k % 5 != 0, F.concat(F.lit(" SCORE: "), (k % 997).cast("string"))).otherwise(""), F.lit(" MD5: "), F.md5(k.cast("string").cast("binary")))
    got = readers.thor(spark, _written(spark, table(spark, sf_dir, "orders").select(line.alias("value")), "thor-findings"), 2026)
    return extras.thor_findings(got).select("host", "ioc_severity", "file_hash")
