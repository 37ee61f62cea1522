"""Readers of forensic tools' output: each gives raw events in the event schema.

JSON is read as text and parsed line by line, so a damaged line is dropped and not the file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglattice.functions import normalize as n
from loglattice.functions import vocab
from loglattice.schema import CARRIED, RAW, column_of, conform
from loglattice.sources import splits

MAP = "map<string,string>"
MESSAGE_CHARS = 2000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file) of a text file or folder; a byte order mark is cut off."""
    rows = spark.read.text(path)
    return rows.select(F.regexp_replace("value", "^\ufeff", "").alias("line"), F.col("_metadata.file_name").alias("file"))


def _objects(text: Column) -> Column:
    """The objects of one JSON text: an array's, those under ``Data``, or the one there is."""
    one = F.from_json(text, MAP)
    data = F.coalesce(one["Data"], one["data"])
    return F.when(text.startswith("["), F.from_json(text, f"array<{MAP}>")).when(data.startswith("["), F.from_json(data, f"array<{MAP}>")).otherwise(F.array(one))


def json_objects(spark: SparkSession, path: str | list[str], mark: str = "") -> DataFrame:
    """(m, file, original): every object as a map of its fields' JSON text, and as its own text.

    One object a line, an array, ``{"Data": [...]}`` or one object over many lines; all are read
    in splits.  A ``mark`` (pattern) that lines may begin with is taken off.
    """
    begin = f"^\ufeff|^\\s*(?:{mark})" if mark else "^\ufeff"
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", begin + "|\\s+$", "")).alias("t"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"))
    complete = F.col("t").startswith("{") & F.col("t").endswith("}")
    others = [r.path for r in lines.filter((F.col("t") != "") & ~complete).select("path").distinct().collect()]  # a row a file
    there = others and all(map(splits.reachable, others))
    others = splits.documents(spark, others) if there else others
    found = lines.filter(complete if not others else complete & ~F.col("path").isin(others)).select(F.explode(_objects(F.col("t"))).alias("m"), "file")
    if there and others:
        each = splits.json_elements(spark, others).filter("reason is null").select(F.from_json("text", MAP).alias("m"), F.substring_index("file", "/", -1).alias("file"))
        found = found.unionByName(each)
    elif others:  # a store that tasks can't open by themselves: these files are read whole
        whole = spark.read.text(others, wholetext=True).select(F.regexp_replace("value", "^\ufeff|^\\s+|\\s+$", "").alias("t"), F.col("_metadata.file_name").alias("file"))
        each = F.filter(F.transform(F.split("t", r"\r?\n"), lambda x: F.from_json(F.regexp_replace(x, begin, ""), MAP)), lambda m: m.isNotNull() & (F.size(m) > 0))
        good = F.filter(_objects(F.col("t")), lambda m: m.isNotNull() & (F.size(m) > 0))
        # Neither an array nor one object: lines, of which some are damaged.
        found = found.unionByName(whole.select(F.explode(F.when(F.size(good) > 0, good).otherwise(each)).alias("m"), "file"))
    return found.filter("m is not null and size(m) > 0").withColumn("original", F.to_json("m"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(m, file, original) of a file with one object a line; splittable, for large streams."""
    return _lines(spark, path).select(F.from_json("line", MAP).alias("m"), "file", F.col("line").alias("original")).filter("m is not null and size(m) > 0")


def _carried(rows: DataFrame) -> list[Column]:
    """Columns that go along with a record."""
    return [F.col(c) for c in CARRIED if c in rows.columns]


def _get(*keys: str, of: str = "m") -> Column:
    """The first of some fields that isn't empty; a list gives its first element."""

    def one(k: str) -> Column:
        v = F.col(of)[k]
        listed = F.from_json(v, "array<string>")
        return n.blank_to_null(F.when(v.startswith("["), F.try_element_at(F.filter(listed, lambda x: x != ""), F.lit(1))).otherwise(v))

    return F.coalesce(*[one(k) for k in keys])


TACTICS = {"Recon": "reconnaissance", "ResDev": "resource-development", "InitAccess": "initial-access", "Exec": "execution", "Persis": "persistence", "PrivEsc": "privilege-escalation", "Stealth": "stealth", "DefImpair": "defense-impairment", "CredAccess": "credential-access", "Disc": "discovery", "LatMov": "lateral-movement", "Collect": "collection", "C2": "command-and-control", "Exfil": "exfiltration", "Impact": "impact"}  # fixed values


def detections(spark: SparkSession, path: str, source: str = "evtx") -> DataFrame:
    """Sigma detections over Windows logs, JSON lines."""
    return detection_events(json_lines(spark, path), source)


def detection_events(rows: DataFrame, source: str = "evtx") -> DataFrame:
    """Events of detections given as maps (m)."""
    rows = rows.withColumn("d", F.from_json(F.col("m")["Details"], MAP))
    d = lambda *k: _get(*k, of="d")
    tags = F.filter(F.coalesce(F.from_json(F.col("m")["MitreTags"], "array<string>"), F.array().cast("array<string>")), lambda t: t.rlike("^[Tt][0-9]"))
    names = F.create_map(*[F.lit(x) for kv in TACTICS.items() for x in kv])
    tactics = F.transform(F.coalesce(F.from_json(F.col("m")["MitreTactics"], "array<string>"), F.array().cast("array<string>")), lambda t: F.coalesce(F.try_element_at(names, t), F.lower(t)))
    eid = F.col("m")["EventID"].try_cast("int")
    kind = vocab.classify(eid, F.col("m")["Channel"])
    rule_file = F.coalesce(F.col("m")["RuleFile"], F.lit(""))
    return conform(rows.select(
        F.col("m")["Timestamp"].alias("ts"), F.lit(source).alias("source"), kind["category"].alias("category"), F.coalesce(kind["action"], F.col("m")["RuleTitle"]).alias("action"), eid.alias("event_code"),
        F.array_join(tags, ",").alias("techniques"), F.array_join(tactics, ",").alias("tactics_declared"), F.col("m")["Computer"].alias("host"), d("User", "TgtUser", "SrcUser", "Target User").alias("user_name"),
        d("Proc", "Image", "Process").alias("process_name"), d("Cmdline", "CommandLine").alias("cmdline"), d("ParentProc", "ParentImage", "PProc").alias("parent_name"), d("SrcIP", "SourceIp").alias("src_ip"),
        d("TgtIP", "DstIP", "DestinationIp").alias("dst_ip"), d("TgtPort", "DstPort", "DestinationPort").alias("dst_port"), d("Query", "QueryName").alias("dns_query"), F.col("m")["RuleTitle"].alias("rule_title"),
        F.col("m")["Level"].alias("rule_level"), n.blank_to_null(rule_file).alias("rule_file"), rule_file.rlike("sigma-(community|custom)").alias("sigma_community"), *_carried(rows),
    ))


def windows_events(spark: SparkSession, path: str, source: str = "evtx_full") -> DataFrame:
    """The full Windows event stream, JSON lines with the payload as JSON in a string."""
    return windows_event_rows(json_lines(spark, path), source)


#: Event ids that are a success or a failure by themselves.
SUCCEEDED, FAILED = (4624, 4634, 4647, 4672, 4768, 4769), (4625, 4771)


def windows_event_rows(rows: DataFrame, source: str = "evtx_full") -> DataFrame:
    """Events of Windows events given as maps (m)."""
    data = F.from_json(F.col("m")["Payload"], "struct<EventData:struct<Data:array<map<string,string>>>>")["EventData"]["Data"]
    pairs = F.filter(F.coalesce(data, F.array().cast("array<map<string,string>>")), lambda x: x["@Name"].isNotNull())
    rows = rows.withColumn("d", F.map_from_entries(F.filter(F.transform(pairs, lambda x: F.struct(x["@Name"].alias("key"), x["#text"].alias("value"))), lambda x: x["key"].isNotNull())))
    d = lambda *k: F.coalesce(*[n.blank_to_null(F.col("d")[x]) for x in k])
    eid = F.col("m")["EventId"].try_cast("int")
    kind = vocab.classify(eid, F.col("m")["Channel"])
    hashes = F.str_to_map(F.col("d")["Hashes"], F.lit(","), F.lit("="))
    user = d("TargetUserName", "SubjectUserName", "User")
    realm = d("TargetDomainName", "SubjectDomainName")
    keywords = F.lower(F.coalesce(F.col("m")["Keywords"], F.lit("")))
    outcome = F.when(keywords.contains("failure"), "failure").when(keywords.contains("success"), "success").when(eid.isin(*FAILED), "failure").when(eid.isin(*SUCCEEDED), "success")
    return conform(rows.select(
        iso_time(F.col("m")["TimeCreated"]).alias("ts"), F.lit(source).alias("source"), kind["category"].alias("category"), kind["action"].alias("action"), eid.alias("event_code"), outcome.alias("outcome"),
        F.col("m")["Computer"].alias("host"), F.when(~user.rlike(r"[\\@/]") & realm.isNotNull(), F.concat(realm, F.lit("\\"), user)).otherwise(user).alias("user_name"), d("NewProcessName", "Image", "ProcessName").alias("process_name"),
        d("CommandLine").alias("cmdline"), d("ParentProcessName", "ParentImage").alias("parent_name"), d("NewProcessId", "ProcessId").alias("pid"), d("IpAddress", "SourceIp").alias("src_ip"), d("IpPort", "SourcePort").alias("src_port"),
        d("DestinationIp", "DestAddress").alias("dst_ip"), d("DestinationPort", "DestPort").alias("dst_port"), d("QueryName").alias("dns_query"), F.regexp_extract(F.coalesce(d("LogonType"), F.lit("")), "([0-9]+)", 1).alias("logon_type"),
        F.coalesce(hashes["SHA256"], hashes["SHA1"], hashes["MD5"]).alias("file_hash"), hashes["MD5"].alias("file_hash_md5"), d("TargetFilename", "TargetFileName").alias("file_path"), *_carried(rows),
    ))


def iso_time(c: Column) -> Column:
    """Six fractional digits at most, T between date and time, Z where no zone is given."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"(\.[0-9]{6})[0-9]+", "$1"), r"^([0-9-]{10}) ", "$1T")
    return F.when(t.rlike(r"^[0-9]{4}-.*(Z|[+-][0-9]{2}:?[0-9]{2})$"), t).otherwise(F.concat(t, F.lit("Z")))


PACKET_FIELDS = "time src4 src6 dst4 dst6 proto tcp_src tcp_dst udp_src udp_dst length query method url".split()


def packets(spark: SparkSession, path: str, source: str = "pcap") -> DataFrame:
    """Tab-separated packet fields, a row each; packets without addresses and query are dropped."""
    rows = spark.read.csv(path, sep="\t", schema=", ".join(f"{c} string" for c in PACKET_FIELDS))
    first = lambda *c: F.coalesce(*[n.blank_to_null(F.col(x)) for x in c])
    transport = F.when(first("tcp_src", "tcp_dst").isNotNull(), "tcp").when(first("udp_src", "udp_dst").isNotNull(), "udp").when(F.col("proto") == "6", "tcp").when(F.col("proto") == "17", "udp")
    out = rows.select(
        n.iso(F.timestamp_micros((F.col("time").try_cast("double") * 1e6).try_cast("bigint"))).alias("ts"), F.lit(source).alias("source"), F.lit("network").alias("category"), first("src4", "src6").alias("src_ip"), first("dst4", "dst6").alias("dst_ip"),
        first("tcp_src", "udp_src").alias("src_port"), first("tcp_dst", "udp_dst").alias("dst_port"), transport.alias("transport"), F.col("length").alias("bytes"), first("query").alias("dns_query"), first("method").alias("http_method"), first("url").alias("url"),
    )
    return conform(out.filter("src_ip is not null or dst_ip is not null or dns_query is not null"))


def zeek_log(spark: SparkSession, path: str) -> DataFrame:
    """(m): rows of a Zeek TSV log by its header's field names; ``-`` and ``(empty)`` are null."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    head = rows.filter("line like '#fields%'").select("file", F.expr("slice(split(line, '\t'), 2, 10000)").alias("names")).dropDuplicates(["file"])
    body = rows.filter("line not like '#%' and line <> ''").withColumn("v", F.transform(F.split("line", "\t", -1), lambda x: F.when(~x.isin("-", "(empty)"), x)))
    return body.join(F.broadcast(head), "file").select(F.map_from_arrays("names", F.expr("slice(concat(v, array_repeat(cast(null as string), size(names))), 1, size(names))")).alias("m"))  # a header line a file


FAILED_STATES = ("REJ", "RSTO", "RSTR", "RSTOS0", "RSTRH", "SH", "SHR")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def zeek(spark: SparkSession, folder: str, source: str | None = None, logs: tuple[str, ...] = ("conn", "dns", "http", "ssl", "notice")) -> DataFrame:
    """Connections with a row per transaction, joined on uid; the first notice is on all of a
    connection's rows, further ones are rows of their own.

    Logs that are not there are left out; without connections there are no rows.  The source is
    ``pcap:`` and the folder's name, so that Zeek's and other records of captures are one family.
    """
    m = F.col("m")
    source = source or f"pcap:{folder.rstrip('/').rpartition('/')[2]}"
    logs = tuple(log for log in logs if _there(spark, f"{folder}/{log}.log"))
    if "conn" not in logs:
        return spark.createDataFrame([], RAW)
    out = zeek_log(spark, f"{folder}/conn.log")
    state = m["conn_state"]
    outcome = F.when((state == "S0") & (m["proto"] == "udp"), F.lit(None)).when(state.isin("S0", *FAILED_STATES), "failure").when(state.isNotNull(), "success")
    conn = out.select(m["uid"].alias("uid"), n.iso(F.timestamp_micros((m["ts"].try_cast("double") * 1e6).try_cast("bigint"))).alias("ts"), m["id.orig_h"].alias("src_ip"), m["id.orig_p"].alias("src_port"), m["id.resp_h"].alias("dst_ip"), m["id.resp_p"].alias("dst_port"), m["proto"].alias("transport"), m["service"].alias("protocol"), F.expr("coalesce(try_cast(m['orig_bytes'] as bigint), 0) + coalesce(try_cast(m['resp_bytes'] as bigint), 0)").alias("bytes"), outcome.alias("outcome"))
    fields = {
        "dns": {"dns_query": "query", "dns_answer": "answers", "dns_response_code": "rcode_name"},
        "http": {"http_method": "method", "http_status": "status_code", "url_domain": "host", "url_path": "uri"},
        "ssl": {"tls_server_name": "server_name", "tls_ja3": "ja3", "tls_version": "version"},
    }
    names = [c for f in fields.values() for c in f]
    parts = None
    for log, f in fields.items():
        if log in logs:
            t = zeek_log(spark, f"{folder}/{log}.log").select(m["uid"].alias("uid"), *[(m[f[c]] if c in f else F.lit(None).cast("string")).alias(c) for c in names])
            parts = t if parts is None else parts.unionByName(t)
    joined = conn.join(parts, "uid", "left") if parts is not None else conn
    if "notice" in logs:
        rank = F.row_number().over(Window.partitionBy("uid").orderBy("nts", "note"))
        notes = zeek_log(spark, f"{folder}/notice.log").select(m["uid"].alias("uid"), m["ts"].alias("nts"), m["note"].alias("note"), m["msg"].alias("msg")).withColumn("k", rank)
        first = notes.filter("k = 1").select("uid", F.col("note").alias("rule_title"), F.col("msg").alias("message"))
        rest = conn.join(notes.filter("k > 1").select("uid", F.col("note").alias("rule_title"), F.col("msg").alias("message")), "uid")
        joined = joined.join(first, "uid", "left").unionByName(rest, allowMissingColumns=True)
    return conform(joined.withColumn("source", F.lit(source)).withColumn("category", F.lit("network")))


# -- generic logs ---------------------------------------------------------------------------------

ACCESS = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) (\S+)[^"]*" ([0-9]{3}) (\S+)'
SYSLOG = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T\S+)\s+(\S+)\s+(\S+)\s+([^:\s]+):\s?(.*)$"
ANY_TIME = r"([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)"
ANY_IP = r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"


def http_outcome(status: Column) -> Column:
    return F.when(status < 400, "success").when(status.isNotNull(), "failure")


def parse_access(line: Column) -> dict[str, Column]:
    """Fields of a common or combined access log line."""
    x = lambda k: F.nullif(F.nullif(F.regexp_extract(line, ACCESS, k), F.lit("")), F.lit("-"))
    status = x(6).try_cast("int")
    return {
        "ts": n.iso(F.try_to_timestamp(x(3), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))), "src_ip": x(1), "user_name": x(2), "http_method": x(4), "url": x(5), "http_status": status,
        "bytes": x(7).try_cast("bigint"), "outcome": http_outcome(status), "category": F.lit("web"), "action": F.lit("http-request"), "message": F.substring(line, 1, MESSAGE_CHARS),
    }


def parse_line(line: Column) -> dict[str, Column]:
    x = lambda p: n.blank_to_null(F.regexp_extract(line, p, 1))
    return {"ts": iso_time(x(ANY_TIME)), "src_ip": x(ANY_IP), "category": F.lit("log"), "message": F.substring(line, 1, MESSAGE_CHARS)}


def parse_syslog(line: Column) -> dict[str, Column]:
    """ISO syslog; packet filter and sshd messages are taken apart, sshd over packet filter."""
    x = lambda k: n.blank_to_null(F.regexp_extract(line, SYSLOG, k))
    msg = x(5)
    field = lambda k: n.blank_to_null(F.regexp_extract(msg, rf"\b{k}=(\S+)", 1))
    ssh = r"(Accepted|Failed) \S+ for (?:invalid user )?(\S+) from (\S+) port ([0-9]+)"
    s = lambda k: n.blank_to_null(F.regexp_extract(msg, ssh, k))
    return {
        "ts": x(1), "host": F.substring_index(x(2), "@", -1), "process_name": F.regexp_replace(x(4), r"\[[0-9]+\]$", ""), "src_ip": F.coalesce(s(3), field("SRC")), "dst_ip": field("DST"),
        "src_port": F.coalesce(s(4), field("SPT")).try_cast("int"), "dst_port": field("DPT").try_cast("int"), "transport": F.lower(field("PROTO")), "user_name": s(2),
        "outcome": F.when(s(1) == "Accepted", "success").when(s(1) == "Failed", "failure"), "action": F.when(s(1).isNotNull(), F.concat(F.lit("ssh-"), F.lower(s(1)))),
        "category": F.when(s(1).isNotNull(), "authentication").when(field("SRC").isNotNull(), "network").otherwise("log"), "message": F.substring(msg, 1, MESSAGE_CHARS),
    }


def _or(first: dict[str, Column], test: Column, other: dict[str, Column]) -> dict[str, Column]:
    null = F.lit(None)
    return {k: F.when(test, first.get(k, null)).otherwise(other.get(k, null)) for k in {**first, **other}}


def log_file(spark: SparkSession, path: str, fmt: str = "auto", pattern: str | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """Generic logs: access, syslog, jsonl, regex (named groups), line, or by each line's own look.

    Lines that don't fit access or syslog are read as plain lines; those that don't fit a given
    pattern are dropped.
    """
    return log_rows(_lines(spark, path), fmt, pattern, mapping)


def plain_pattern(pattern: str) -> str:
    """A pattern with its named groups as plain ones."""
    return re.sub(r"\(\?P?<[A-Za-z][A-Za-z0-9_]*>", "(", pattern)


def log_rows(rows: DataFrame, fmt: str = "auto", pattern: str | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """Events of log lines (line) of files (file); rows that carry a reason have no line and stay."""
    line = F.col("line")
    rows = rows.filter("trim(line) <> '' or line is null")
    source = F.concat(F.lit("log:"), F.col("file")).alias("source")
    to = lambda k: column_of((mapping or {}).get(k, k))
    if fmt == "regex":
        if not pattern:
            raise ValueError("the regex format needs a pattern")
        named = re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern))
        number, groups = named.groupindex, list(named.groupindex)
        plain = plain_pattern(pattern)
        return conform(rows.filter(line.rlike(plain) | line.isNull()).select(source, *_carried(rows), *[n.blank_to_null(F.regexp_extract(line, plain, number[g])).alias(to(g)) for g in groups]))
    if fmt == "jsonl":
        parsed = rows.select(source, *_carried(rows), F.from_json("line", MAP).alias("m"), "line").filter("(m is not null and size(m) > 0) or line is null")
        known = {**{c: c for c in ("ts", "host", "message")}, "timestamp": "ts", "time": "ts", "@timestamp": "ts", "src_ip": "src_ip", "source.ip": "src_ip", "dst_ip": "dst_ip", "destination.ip": "dst_ip", "user": "user_name", "user.name": "user_name", "username": "user_name", "hostname": "host", "host.name": "host", "status": "http_status", "method": "http_method", "url": "url", "msg": "message", "event.action": "action", "action": "action"}
        known |= {k: column_of(v) for k, v in (mapping or {}).items()}
        by: dict[str, list[str]] = {}
        for k, c in known.items():
            by.setdefault(c, []).append(k)
        lower = F.transform_keys("m", lambda k, _: F.lower(k)) if not mapping else F.col("m")
        return conform(parsed.withColumn("l", lower).select("source", *_carried(parsed), *[F.coalesce(*[F.col("l")[k] for k in ks]).alias(c) for c, ks in by.items()]))
    access, syslog, plain = parse_access(line), parse_syslog(line), parse_line(line)
    fields = {"access": _or(access, line.rlike(ACCESS), plain), "syslog": _or(syslog, line.rlike(SYSLOG), plain), "line": plain, "auto": _or(access, line.rlike(ACCESS), _or(syslog, line.rlike(SYSLOG), plain))}[fmt]
    return conform(rows.select(source, *_carried(rows), *[c.alias(k) for k, c in fields.items()]))


# -- registry, file system, scanners -----------------------------------------------------------


def registry_export(spark: SparkSession, path: str, source: str = "registry") -> DataFrame:
    """``.reg`` exports: each value with the key above it; a file may be read by many tasks.

    UTF-16 with a byte order mark, else UTF-8, else Latin-1; continued hex lines are joined.
    """
    return registry_rows(splits.split_rows(spark, path, "registry").filter("reason is null"), source)


def registry_rows(keyed: DataFrame, source: str = "registry") -> DataFrame:
    """Events of values given as lines (text), their keys (context) and the file's time (modified)."""
    keyed = keyed.withColumnsRenamed({"text": "line", "context": "key"}).withColumn("ts", n.iso(F.timestamp_millis("modified")))
    value = r'^(?:"((?:[^"\\]|\\.)*)"|(@))=(.*)$'
    rows = keyed.filter(F.col("line").rlike(value) | F.col("line").isNull()).withColumn("name", F.coalesce(n.blank_to_null(F.regexp_extract("line", value, 1)), F.lit("(Default)"))).withColumn("raw", F.trim(F.regexp_extract("line", value, 3)))
    code = F.regexp_extract("raw", r"^hex(?:\(([0-9a-fA-F]+)\))?:", 1)
    kind = F.when(F.col("raw").startswith('"'), "REG_SZ").when(F.col("raw").startswith("dword:"), "REG_DWORD").when(F.col("raw").rlike("^hex:"), "REG_BINARY").when(code == "1", "REG_SZ").when(code == "2", "REG_EXPAND_SZ").when(code == "7", "REG_MULTI_SZ").when(code == "b", "REG_QWORD").when(F.col("raw") == "-", "DELETED")
    wide = F.regexp_replace(F.expr(r"decode(try_to_binary(replace(regexp_extract(raw, '^hex[^:]*:(.*)$', 1), ',', ''), 'hex'), 'UTF-16LE')"), "\u0000+$", "")
    data = F.when(F.col("raw").startswith('"'), F.regexp_replace(F.regexp_extract("raw", r'^"(.*)"\s*$', 1), r"\\(.)", "$1")).when(code.isin("1", "2"), wide).when(code == "7", F.replace(wide, F.lit("\u0000"), F.lit("\n"))).otherwise(F.regexp_replace("raw", r"^(dword|hex[^:]*):", ""))
    rows = rows.withColumn("kind", kind).withColumn("data", data).withColumn("cat", vocab.classify_key(F.col("key")))
    hit = vocab.registry_indicator(F.col("cat"), F.col("name"), F.col("data"), F.col("kind"))
    hive = F.regexp_extract("key", r"^([^\\]+)", 1)
    program = F.when(F.col("kind").isin("REG_SZ", "REG_EXPAND_SZ"), vocab.program_of(F.col("cat"), F.col("name"), F.col("data")))
    return conform(rows.select("ts", F.lit(source).alias("source"), F.lit("registry").alias("category"), F.lit("registry-value").alias("action"), hive.alias("registry_hive"), F.col("key").alias("registry_key"), F.col("name").alias("registry_value"), F.col("data").alias("registry_data"), F.col("kind").alias("registry_type"), F.col("cat").alias("rule_description"), hit["description"].alias("ioc_description"), hit["severity"].alias("ioc_severity"), program.alias("file_name"), F.substring(F.concat_ws(" ", "key", "name", "data"), 1, MESSAGE_CHARS).alias("message"), *_carried(rows)))


def registry_tree(spark: SparkSession, path: str, hive: str, source: str = "registry", depth: int = 12) -> DataFrame:
    """Parsed hives as JSON trees of keys; autostart keys with a time are kept.

    Levels are taken off one by one; after every ``depth`` of them it is looked whether keys remain.
    """
    level = json_objects(spark, path).select("m")
    out = None
    while out is None or not level.isEmpty():
        for _ in range(depth):
            now = level.select(F.col("m")["KeyPath"].alias("key"), F.col("m")["LastWriteTimestamp"].alias("t"), F.col("m")["Values"].alias("values"))
            out = now if out is None else out.unionByName(now)
            level = level.select(F.explode(F.from_json(F.col("m")["SubKeys"], f"array<{MAP}>")).alias("m"))
    rows = out.withColumn("cat", vocab.classify_key(F.col("key"))).filter("cat is not null and t is not null")
    rows = rows.withColumn("v", F.explode_outer(F.from_json("values", f"array<{MAP}>")))
    return conform(rows.select(iso_time(F.col("t")).alias("ts"), F.lit(source).alias("source"), F.lit("registry").alias("category"), F.lit("registry-key").alias("action"), F.lit(hive).alias("registry_hive"), F.col("key").alias("registry_key"), F.col("v")["ValueName"].alias("registry_value"), F.col("v")["ValueData"].alias("registry_data"), F.col("cat").alias("rule_description"), vocab.program_of(F.col("cat"), F.col("v")["ValueName"], F.col("v")["ValueData"]).alias("file_name")))


#: The action of a folder's record.
DIRECTORY = "directory-metadata"


def mft(spark: SparkSession, path: str, source: str = "mft") -> DataFrame:
    """File records; the time is the first of created, modified, changed and accessed."""
    return mft_rows(json_objects(spark, path), source)


def mft_rows(rows: DataFrame, source: str = "mft") -> DataFrame:
    """Events of file records given as maps (m)."""
    time = lambda k: _get(f"{k}0x10", f"{k}0x30", k)
    ext = n.blank_to_null(F.col("m")["Extension"])
    dotted = F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))
    base = _get("FileName", "Name")
    name = F.when(dotted.isNotNull() & ~F.lower(base).endswith(F.lower(dotted)), F.concat(base, dotted)).otherwise(base)
    at = F.coalesce(time("Created"), time("LastModified"), time("LastRecordChange"), time("LastAccess"))
    folder = _get("ParentPath", "FullPath")
    return conform(rows.select(iso_time(at).alias("ts"), F.lit(source).alias("source"), F.lit("file").alias("category"), F.when(F.lower(_get("IsDirectory")) == "true", DIRECTORY).otherwise("file-metadata").alias("action"), name.alias("file_name"), F.when(F.col("m")["ParentPath"].isNotNull(), F.concat(folder, F.lit("\\"), name)).otherwise(folder).alias("file_path"), F.col("m")["FileSize"].alias("bytes"), *_carried(rows)))


# Parts of paths where attackers put files, and extensions of programs and scripts.
SUSPICIOUS_PATHS = ("\\appdata\\local\\temp\\", "\\windows\\temp\\", "\\programdata\\", "\\windows\\tasks\\", "\\users\\public\\", "$recycle.bin")
EXECUTABLES = ("exe", "dll", "ps1", "psm1", "bat", "cmd", "vbs", "vbe", "js", "jse", "hta", "scr", "msi", "com")


def suspicious_files(events: DataFrame) -> DataFrame:
    """Files, not folders, under paths where attackers put them."""
    path = F.lower(F.coalesce("file_path", F.lit("")))
    there = F.lit(False)
    for p in SUSPICIOUS_PATHS:
        there |= path.contains(p)
    return events.filter(there & ~F.coalesce(F.col("action") == DIRECTORY, F.lit(False)))


def executable_files(events: DataFrame) -> DataFrame:
    """Files that are programs or scripts by their extension, with or without its dot."""
    ext = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    return events.filter(ext.isin(*EXECUTABLES) & ~F.coalesce(F.col("action") == DIRECTORY, F.lit(False)))


def thor(spark: SparkSession, path: str, year: int | None = None, source: str = "thor") -> DataFrame:
    """Scanner report lines with a score; one that names a second file gives a linked row too.

    Lines have no year: it is the one in the file's name, else ``year``, else that of the file's last change.
    """
    rows = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("changed")).filter(F.col("line").rlike(r"\bSCORE: [0-9]+"))
    x = lambda k: n.blank_to_null(F.trim(F.regexp_extract("line", rf"(?:^| ){k}: (.*?)(?= [A-Z][A-Z0-9_]*: |$)", 1)))
    head = r"^([A-Z][a-z]{2}) +([0-9]{1,2}) ([0-9:]{8}) (\S+?)(?:/(\S+))? THOR: (\w+)"
    y = F.coalesce(n.blank_to_null(F.regexp_extract("file", r"(20[0-9]{2})", 1)), F.lit(str(year)) if year else F.year("changed").cast("string"))
    at = n.iso(F.try_to_timestamp(F.concat_ws(" ", y, F.regexp_extract("line", head, 1), F.lpad(F.regexp_extract("line", head, 2), 2, "0"), F.regexp_extract("line", head, 3)), F.lit("yyyy MMM dd HH:mm:ss")))
    level = F.lower(F.regexp_extract("line", head, 6))
    severity = F.when(level == "alert", "critical").when(level == "warning", "high").when(level == "notice", "medium").otherwise("low")
    primary = F.struct(F.lit("thor-finding").alias("action"), F.coalesce(x("FILE"), x("IMAGE")).alias("path"), F.coalesce(x("SHA256"), x("SHA1"), x("MD5")).alias("hash"))
    linked = F.struct(F.lit("thor-linked").alias("action"), x("TARGET").alias("path"), x("TARGET_MD5").alias("hash"))
    both = F.when(x("TARGET").isNotNull(), F.array(primary, linked)).otherwise(F.array(primary))
    out = rows.select(F.when(y.isNotNull(), at).alias("ts"), F.lit(source).alias("source"), F.lit("file").alias("category"), n.blank_to_null(F.regexp_extract("line", head, 4)).alias("host"), severity.alias("rule_level"), F.coalesce(x("REASON_1"), x("MESSAGE"), x("MODULE")).alias("rule_title"), x("SCORE").alias("ioc_severity"), F.substring("line", 1, MESSAGE_CHARS).alias("message"), F.inline(both))
    return conform(out.withColumn("file_path", F.col("path")).withColumn("file_name", n.canon_file(F.col("path"))).withColumn("file_hash", F.col("hash")))


def thor_csv(spark: SparkSession, path: str, source: str = "thor") -> DataFrame:
    rows = spark.read.csv(path, header=False, schema="md5 string, path string, score string").filter("try_cast(score as int) is not null")
    return conform(rows.select(F.lit(source).alias("source"), F.lit("file").alias("category"), F.lit("thor-finding").alias("action"), F.col("md5").alias("file_hash"), F.col("path").alias("file_path"), n.canon_file(F.col("path")).alias("file_name"), F.col("score").alias("ioc_severity")))


def literal_scan(spark: SparkSession, path: str, rules: dict[str, list[str]], source: str = "yara", all_of: bool = False) -> DataFrame:
    """Files that hold a rule's strings (any, or all): a row per file and rule."""
    files = spark.read.format("binaryFile").load(path)
    text = F.expr("decode(content, 'ISO-8859-1')")
    hits = []
    for rule, strings in rules.items():
        test = F.lit(all_of)
        for s in strings:
            test = test & text.contains(s) if all_of else test | text.contains(s)
        hits.append(F.when(test, F.lit(rule)))
    found = files.select(n.iso(F.col("modificationTime")).alias("ts"), F.col("path").alias("file_path"), F.sha2("content", 256).alias("file_hash"), F.explode(F.filter(F.array(*hits), lambda r: r.isNotNull())).alias("rule_name"))
    return conform(found.withColumn("source", F.lit(source)).withColumn("category", F.lit("file")).withColumn("action", F.lit("yara-match")).withColumn("file_name", n.canon_file(F.col("file_path"))))


OSQUERY = {"pid": "pid", "cmdline": "cmdline", "parent_path": "parent_name", "username": "user_name", "user": "user_name", "address": "src_ip", "local_address": "src_ip", "remote_address": "dst_ip", "local_port": "src_port", "port": "dst_port", "remote_port": "dst_port", "md5": "file_hash_md5", "sha1": "file_hash_sha1", "sha256": "file_hash", "target_path": "file_path", "parent": "parent_pid", "uid": "user_id"}  # fixed values
OSQUERY_TABLES = {"processes": "process", "process_open_sockets": "network", "listening_ports": "network", "arp_cache": "network", "users": "iam", "logged_in_users": "authentication", "file_events": "file", "hash": "file", "crashes": "process", "launch_daemons": "configuration", "kernel_extensions": "driver", "authorized_keys": "iam", "shadow_hash": "iam"}
OSQUERY_SIGNS = (("network", ("remote_address", "local_address", "socket", "address")), ("file", ("md5", "sha1", "sha256", "target_path")), ("authentication", ("tty",)), ("process", ("cmdline", "parent")), ("iam", ("directory", "shell", "gid")), ("process", ("pid",)))


def osquery(spark: SparkSession, path: str, source: str = "osquery") -> DataFrame:
    """osquery results with a unixTime; the category by query name, else by the columns there are."""
    return osquery_rows(json_objects(spark, path), source)


def osquery_rows(rows: DataFrame, source: str = "osquery") -> DataFrame:
    """Events of query results given as maps (m)."""
    rows = rows.filter("try_cast(m['unixTime'] as double) > 0" + (" or reason is not null" if "reason" in rows.columns else "")).withColumn("c", F.coalesce(F.from_json(F.col("m")["columns"], MAP), F.create_map().cast(MAP))).withColumn("deco", F.from_json(F.col("m")["decorations"], MAP))
    c = F.col("c")
    category = F.try_element_at(F.create_map(*[F.lit(x) for kv in OSQUERY_TABLES.items() for x in kv]), F.col("m")["name"])
    signs = F.lit(None).cast("string")
    for kind, marks in reversed(OSQUERY_SIGNS):
        signs = F.when(F.greatest(*[F.map_contains_key("c", m) for m in marks]) if len(marks) > 1 else F.map_contains_key("c", marks[0]), F.lit(kind)).otherwise(signs)
    category = F.coalesce(category, signs)
    by: dict[str, list[Column]] = {}
    for k, col in OSQUERY.items():
        v = n.blank_to_null(c[k])
        by.setdefault(col, []).append(F.when(~v.rlike(r"^0+(\.0*)?$"), v) if col.endswith("port") else v)
    fields = {col: F.coalesce(*vs) for col, vs in by.items()}
    fields["user_name"] = F.coalesce(fields["user_name"], F.col("deco")["username"])
    process = (category == "process") | F.map_contains_key("c", "cmdline") | F.map_contains_key("c", "pid")
    fields["process_name"] = F.when(process, n.blank_to_null(c["name"]))
    return conform(rows.select(n.iso(F.timestamp_seconds(F.col("m")["unixTime"].try_cast("double").try_cast("bigint"))).alias("ts"), F.lit(source).alias("source"), F.col("m")["action"].alias("action"), category.alias("category"), F.col("m")["hostIdentifier"].alias("host"), *[v.alias(k) for k, v in fields.items()], *_carried(rows)))


FALCON = {"ComputerName": "host", "SHA256HashData": "file_hash", "UserName": "user_name", "LocalAddressIP4": "src_ip", "event_simpleName": "action", "RawProcessId": "pid", "ImageFileName": "process_name", "CommandLine": "cmdline", "DomainName": "dns_query", "RemoteAddressIP4": "dst_ip", "event_platform": "host_os", "ParentProcessId": "parent_pid", "aid": "agent_id"}  # fixed values
#: Labels of a detection's card.
FALCON_CARD = {"Platform": "host_os", "Agent ID": "agent_id", "Host name": "host", "File name": "file_name", "File path": "file_path", "Command line": "cmdline", "SHA 256": "file_hash", "MD5 Hash": "file_hash_md5", "IP address": "src_ip", "User name": "user_name", "Description": "message"}


def crowdstrike(spark: SparkSession, path: str, source: str = "crowdstrike") -> DataFrame:
    """Exports as JSON, ``@rawstring:`` lines or ``Key: Value`` blocks, by what each file looks like.

    A card is a block of lines; every kind of file is read in splits.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))
    looks = lines.groupBy("path").agg(F.max(F.col("value").rlike(r"^\x{FEFF}?(Host name|File name|Command line|SHA 256): ")).alias("card")).collect()  # a row a file
    by_card = [r.path for r in looks if r.card]
    by_line = [r.path for r in looks if not r.card]
    none = spark.createDataFrame([], "m map<string,string>")
    cards = falcon = none
    if by_card:
        if all(map(splits.reachable, by_card)):
            blocks = splits.split_rows(spark, by_card, "blocks").filter("reason is null").select(F.col("text").alias("b"))
        else:
            whole = spark.read.text(by_card, wholetext=True).select(F.regexp_replace("value", "^\ufeff|\r", "").alias("t"))
            blocks = whole.select(F.explode(F.split("t", r"\n\s*\n")).alias("b")).filter("trim(b) <> ''")
        cards = blocks.select(F.map_from_entries(F.transform(F.regexp_extract_all("b", F.lit(r"(?m)^([^:\n]+): (.*)$"), F.lit(0)), lambda x: F.struct(F.substring_index(x, ": ", 1), F.regexp_extract(x, r"^[^:]+: (.*)$", 1)))).alias("m"))
    if by_line:
        falcon = json_objects(spark, by_line, r"@rawstring:\s*").select("m", "original")
    return falcon_rows(falcon, source).unionByName(card_rows(cards, source), allowMissingColumns=True)


def falcon_rows(rows: DataFrame, source: str = "crowdstrike") -> DataFrame:
    """Events of exported records given as maps (m)."""
    m = F.col("m")
    at = F.coalesce(m["timestamp"], m["@timestamp"], m["_time"])
    ts = F.when(at.rlike("^[0-9]{13}$"), n.iso(F.timestamp_millis(at.try_cast("bigint")))).otherwise(at)
    process = m["ImageFileName"].isNotNull() | m["CommandLine"].isNotNull()
    return conform(rows.select(ts.alias("ts"), F.lit(source).alias("source"), F.when(process, "process").alias("category"), *[m[k].alias(v) for k, v in FALCON.items()], *_carried(rows)))


def card_rows(rows: DataFrame, source: str = "crowdstrike") -> DataFrame:
    """Events of detections' cards given as maps (m) of label to value."""
    m = F.col("m")
    return conform(rows.select(F.lit(source).alias("source"), F.when(m["Command line"].isNotNull(), "process").alias("category"), F.lit("detection").alias("action"), *[m[k].alias(v) for k, v in FALCON_CARD.items()], *_carried(rows)))


def logon_summary(spark: SparkSession, path: str) -> DataFrame:
    """(n, event, user, host, src_ip, logon_type) of a logon summary CSV.

    Columns: count, event, target account, domain and computer, logon type ("3 - Network"), source
    account, domain, computer and address.  A header and rows of fewer than ten columns are
    skipped; a count that is no number is 0.
    """
    rows = _lines(spark, path).select(F.from_csv("line", ", ".join(f"c{k} string" for k in range(12))).alias("c")).filter("c.c9 is not null and not (c.c1 = 'Event' and c.c0 in ('Successful', 'Failed'))")
    x = lambda k: F.trim(F.col(f"c.c{k}"))
    kind = F.trim(F.substring_index(x(5), "-", 1))
    return rows.select(F.coalesce(x(0).try_cast("int"), F.lit(0)).alias("n"), x(1).alias("event"), x(2).alias("user"), x(4).alias("host"), x(9).alias("src_ip"), F.when(kind.rlike("^[0-9]+$"), kind).alias("logon_type"))


#: What makes events of stored records of a kind: maps of their fields' text, in a column m.
RECORD_EVENTS = {"evtx": detection_events, "evtx_full": windows_event_rows, "osquery": osquery_rows, "mft": mft_rows, "crowdstrike": falcon_rows}
READERS = {"evtx": detections, "evtx_full": windows_events, "pcap": packets, "zeek": zeek, "log": log_file, "reg": registry_export, "registry_tree": registry_tree, "mft": mft, "thor": thor, "thor_csv": thor_csv, "osquery": osquery, "crowdstrike": crowdstrike}


def build_events(spark: SparkSession, sources: list[tuple[str, str, dict]], errors: list[tuple[str, str]] | None = None) -> DataFrame:
    """Union of (kind, path, options) sources with ids; with ``errors`` a source that can't be read is
    noted there and left out, without it the first failure is raised."""
    out = None
    for kind, path, options in sources:
        try:
            part = READERS[kind](spark, path, **options)
        except Exception as e:
            if errors is None:
                raise
            errors.append((path, str(e)[:200]))
            continue
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("id", F.monotonically_increasing_id()) if out is not None else None
