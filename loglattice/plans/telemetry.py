"""Security telemetry bound to the driver's tables, in Spark and in DuckDB spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglattice.events import derive

EPOCH = 1_704_067_200  # 2024-01-01

COLUMNS = {
    "id": "bigint", "ts": "string", "source": "string", "category": "string", "action": "string", "event_code": "int", "outcome": "string", "host": "string",
    "user_name": "string", "process_name": "string", "parent_name": "string", "src_ip": "string", "src_port": "int", "dst_ip": "string", "dst_port": "int",
    "dns_query": "string", "transport": "string", "bytes": "bigint", "logon_type": "string", "url": "string", "http_status": "int", "http_method": "string",
    "url_domain": "string", "url_path": "string", "file_name": "string", "file_hash": "string", "techniques": "string", "rule_title": "string", "rule_level": "string",
}

SPARK = {
    "iso": "date_format(cast({} as timestamp), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
    "iso_s": "date_format(timestamp_seconds({}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
    "k": "cast(get_json_object(props, '$.k') as int)",
    "string": "string",
    "hash": "cast(conv(substr(md5({}), 1, 13), 16, 10) as bigint)",
    "table": "parquet.`{dir}/{name}.parquet`",
}
DUCK = {
    "iso": "strftime({}, '%Y-%m-%dT%H:%M:%SZ')",
    "iso_s": "strftime(make_timestamp(({}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')",
    "k": "cast(json_extract_string(props, '$.k') as int)",
    "string": "varchar",
    "hash": "cast('0x' || substr(md5({}), 1, 13) as bigint)",
    "table": "{name}",
}


def _families(d: dict[str, str]) -> dict[str, tuple[str, dict[str, str], str]]:
    """Family: (table, columns, where)."""
    line = d["hash"].format("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint))")
    flow = "l_orderkey * 1301 % 2500000 + l_linenumber * 60 + l_partkey % 30"
    return {
        "evtx": ("events", {
            "id": "event_id", "ts": d["iso"].format("ts"), "source": "'evtx'", "category": "'process'",
            "action": "case event_type when 'signup' then 'user-account-created' when 'error' then 'logon-failed' else event_type end",
            "event_code": "case event_type when 'signup' then 4624 when 'error' then 4625 when 'click' then 4688 when 'view' then 4663 else 4698 end",
            "outcome": "case when event_type = 'error' then 'failure' else 'success' end",
            "host": f"'ws-' || cast(user_id % 50 as {d['string']}) || '.corp.example'", "user_name": f"'CORP' || chr(92) || 'user' || cast(user_id as {d['string']})",
            "process_name": f"'proc' || cast(cast(floor(value) as bigint) as {d['string']}) || '.exe'", "parent_name": "event_type || '.exe'",
            "src_ip": f"'10.20.0.' || cast(user_id % 50 as {d['string']})", "dst_ip": f"'203.0.113.' || cast(user_id % 50 as {d['string']})", "dst_port": f"8000 + {d['k']}",
            "transport": "'tcp'", "bytes": "cast(floor(value * 100) as bigint)", "logon_type": f"cast({d['k']} % 12 as {d['string']})",
            "techniques": "case when user_id % 10 <> 0 then null when event_type = 'error' then 'T1110' when event_type = 'signup' then 'T1078' when event_type = 'purchase' then 'T1041,T1071.004' end",
            "rule_title": "case when user_id % 10 = 0 then 'rule ' || event_type end", "rule_level": "case when user_id % 10 = 0 and event_type = 'error' then 'high' when user_id % 10 = 0 then 'medium' end",
        }, "true"),
        "pcap": ("orders", {
            "id": "100000000 + o_orderkey", "ts": d["iso_s"].format(f"{EPOCH} + o_orderkey * 7919 % 2592000"), "source": "'pcap:capture.pcap'", "category": "'network'",
            "host": f"'WS-' || cast(o_custkey % 50 as {d['string']})", "user_name": f"'user' || cast(o_custkey as {d['string']}) || '@partner.example'",
            "src_ip": f"'10.20.0.' || cast(o_custkey % 50 as {d['string']})", "src_port": "cast(1024 + o_orderkey % 60000 as int)", "dst_ip": f"'203.0.113.' || cast(o_orderkey % 100 as {d['string']})", "dst_port": "443",
            "transport": "'tcp'", "bytes": "cast(floor(o_totalprice) as bigint)", "http_status": "case o_orderstatus when 'F' then 200 when 'O' then 302 else 404 end",
        }, "true"),
        "zeek": ("lineitem", {
            "id": f"1000000000 + {line}", "ts": d["iso_s"].format(f"{EPOCH} + {flow}"), "source": "'zeek'", "category": "'network'",
            "src_ip": f"'10.' || cast(1 + l_orderkey // 62500 as {d['string']}) || '.' || cast(l_orderkey // 250 % 250 as {d['string']}) || '.' || cast(l_orderkey % 250 as {d['string']})",
            "src_port": "1024 + l_linenumber", "dst_ip": f"'203.0.113.' || cast(100 + l_orderkey % 50 as {d['string']})", "dst_port": "8443", "transport": "'tcp'", "bytes": "cast(floor(l_extendedprice) as bigint)",
        }, "true"),
        "scan": ("documents", {
            "id": "900000000 + doc_id", "ts": d["iso_s"].format(f"{EPOCH} + doc_id * 37 % 2592000"), "source": "case when doc_id % 2 = 0 then 'thor' else 'yara' end", "category": "'file'", "action": "'file-match'",
            "file_name": "source", "file_hash": "md5(text)",
        }, "true"),
        "web": ("pages", {
            "id": "950000000 + page_id", "ts": d["iso_s"].format(f"{EPOCH} + page_id * 53 % 2592000"), "source": "'log:access.log'", "category": "'web'", "action": "'http-request'",
            "url": "url", "url_domain": "regexp_extract(url, 'https?://([^/]+)', 1)", "url_path": "regexp_extract(url, 'https?://[^/]+(/.*)', 1)", "dns_query": "regexp_extract(url, 'https?://([^/]+)', 1)",
            "src_ip": f"'10.20.0.' || cast(page_id % 50 as {d['string']})", "http_method": "'GET'", "http_status": "case when page_id % 7 = 0 then 404 else 200 end", "outcome": "case when page_id % 7 = 0 then 'failure' else 'success' end",
        }, "true"),
    }


ALL = ("evtx", "pcap", "zeek", "scan", "web")


def raw_sql(dialect: dict[str, str], families: tuple[str, ...] = ALL, sf_dir: str = "") -> str:
    out = []
    for f in families:
        table, cols, where = _families(dialect)[f]
        table = dialect["table"].format(dir=sf_dir, name=table)
        if dialect is SPARK:
            cols = {c: x.replace("l_orderkey // 62500", "(l_orderkey div 62500)").replace("l_orderkey // 250 % 250", "(l_orderkey div 250) % 250") for c, x in cols.items()}
        kind = {"string": dialect["string"]}
        picked = ", ".join(f"cast({cols.get(c, 'null')} as {kind.get(t, t)}) as {c}" for c, t in COLUMNS.items())
        out.append(f"select {picked} from {table} where {where}")
    return " union all ".join(out)


def raw_events(spark: SparkSession, sf_dir: str, families: tuple[str, ...] = ALL) -> DataFrame:
    return spark.sql(raw_sql(SPARK, families, sf_dir))


def telemetry(spark: SparkSession, sf_dir: str, families: tuple[str, ...] = ALL) -> DataFrame:
    """Derived events of the chosen families."""
    return derive(raw_events(spark, sf_dir, families))


def duck_events(families: tuple[str, ...] = ALL) -> str:
    """DuckDB's CTE text ``raw`` and ``ev`` (the derived events)."""
    return f"""raw AS ({raw_sql(DUCK, families)}),
ev AS (
  SELECT * REPLACE (lower(dns_query) AS dns_query), CAST(replace(ts, 'Z', '') AS TIMESTAMP) AS ts_parsed, lower(split_part(source, ':', 1)) AS family,
    lower(regexp_replace(split_part(user_name, '@', 1), '^.*[' || chr(92) || chr(92) || '/]', '')) AS user_canon,
    CASE WHEN contains(user_name, '@') THEN lower(split_part(user_name, '@', 2)) WHEN contains(user_name, chr(92)) THEN lower(split_part(user_name, chr(92), 1)) END AS user_domain,
    lower(split_part(host, '.', 1)) AS host_canon, CASE WHEN contains(host, '.') THEN lower(substr(host, instr(host, '.') + 1)) END AS host_domain, lower(file_name) AS file_canon,
    CASE techniques WHEN 'T1110' THEN 'credential-access' WHEN 'T1078' THEN 'defense-evasion,initial-access,persistence,privilege-escalation' WHEN 'T1041,T1071.004' THEN 'exfiltration,command-and-control' ELSE '' END AS tactics,
    CASE techniques WHEN 'T1110' THEN 'Exploitation' WHEN 'T1078' THEN 'Installation' WHEN 'T1041,T1071.004' THEN 'Actions on Objectives' END AS kc_phase,
    CASE techniques WHEN 'T1110' THEN 4 WHEN 'T1078' THEN 5 WHEN 'T1041,T1071.004' THEN 7 ELSE 0 END AS kc_order, techniques IS NOT NULL AS attack_evidence
  FROM raw)"""
