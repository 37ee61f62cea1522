"""Long-tail analytics over events: each takes events and parameters and returns a DataFrame.

Every order is total: the group keys break ties, nulls come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions import attack

# Ports whose traffic is expected.
COMMON_PORTS = (20, 21, 22, 23, 25, 53, 80, 88, 110, 123, 135, 139, 143, 389, 443, 445, 464, 465, 587, 636, 993, 995, 3389, 5985, 5986, 8080, 8443)

def count_rows() -> Column:
    return F.count(F.lit(1))


def _order(*cols: str) -> list[Column]:
    """Sort columns with nulls last; a leading minus is descending."""
    return [F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in cols]


def technique_frequency(events: DataFrame) -> DataFrame:
    counted = events.filter("techniques is not null").groupBy("techniques").agg(count_rows().alias("n"))
    split = counted.select(F.explode(attack.split_techniques(F.col("techniques"))).alias("technique"), "n")
    return split.groupBy("technique").agg(F.sum("n").alias("hits")).orderBy(*_order("-hits", "technique"))


def rare_processes(events: DataFrame, max_count: int = 2) -> DataFrame:
    named = events.filter("process_name is not null").groupBy("process_name")
    rare = named.agg(count_rows().alias("occurrences"), F.count_distinct("host").alias("hosts")).filter(F.col("occurrences") <= max_count)
    return rare.orderBy(*_order("occurrences", "process_name"))


def first_seen(events: DataFrame) -> DataFrame:
    """First event of each host and user by time; unparsable times count but are never first."""
    pairs = events.filter("host is not null and user_name is not null").groupBy("host", "user_name")
    seen = pairs.agg(F.min_by("ts", "ts_parsed").alias("first_ts"), count_rows().alias("events"), F.min("ts_parsed").alias("at"))
    return seen.orderBy(*_order("at", "host", "user_name")).drop("at")


def anomalous_parent_child(events: DataFrame, max_count: int = 2) -> DataFrame:
    pairs = events.filter("parent_name is not null and process_name is not null").groupBy("parent_name", "process_name")
    return pairs.agg(count_rows().alias("occurrences")).filter(F.col("occurrences") <= max_count).orderBy(*_order("occurrences", "parent_name", "process_name"))


def top_talkers(events: DataFrame, limit: int = 20) -> DataFrame:
    by = events.filter("dst_ip is not null").groupBy("dst_ip")
    agg = by.agg(count_rows().alias("connections"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.count_distinct("dst_port").alias("ports"))
    return agg.orderBy(*_order("-connections", "-total_bytes", "dst_ip")).limit(limit)


def rare_dns(events: DataFrame, max_count: int = 1, long_len: int = 50) -> DataFrame:
    agg = events.filter("dns_query is not null").groupBy("dns_query").agg(count_rows().alias("lookups"), F.max(F.length("dns_query")).alias("name_len"))
    return agg.filter((F.col("lookups") <= max_count) | (F.col("name_len") >= long_len)).orderBy(*_order("lookups", "-name_len", "dns_query"))


def nonstandard_ports(events: DataFrame) -> DataFrame:
    odd = events.filter(F.col("dst_port").isNotNull() & ~F.col("dst_port").isin(*COMMON_PORTS)).groupBy("dst_ip", "dst_port", "transport")
    return odd.agg(count_rows().alias("connections"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes")).orderBy(*_order("-connections", "dst_port", "dst_ip", "transport"))


def beaconing(events: DataFrame, min_events: int = 4, max_jitter: float = 0.25) -> DataFrame:
    """Regular call-backs.  Rows are folded to connections first (same source port; rows without
    one stand alone), so segments of one connection aren't call-backs."""
    flow = ["host", "src_ip", "dst_ip", "dst_port"]
    rows = events.filter("dst_ip is not null and ts_parsed is not null")
    alone = F.when(F.col("src_port").isNull(), F.col("id"))
    started = rows.groupBy(*flow, "src_port", alone.alias("alone")).agg(F.min("ts_parsed").alias("started"))
    gap = (F.unix_micros("started") - F.lag(F.unix_micros("started")).over(Window.partitionBy(*flow).orderBy("started"))) / 1e6
    stats = started.withColumn("gap", gap).filter("gap is not null").groupBy(*flow).agg(count_rows().alias("n"), F.avg("gap").alias("mean"), F.coalesce(F.stddev_samp("gap"), F.lit(0.0)).alias("sd"))
    regular = stats.filter((F.col("n") + 1 >= min_events) & (F.col("mean") > 0) & (F.col("sd") / F.nullif("mean", F.lit(0.0)) <= max_jitter))
    out = regular.select(*flow, (F.col("n") + 1).alias("connections"), F.round("mean", 2).alias("mean_interval_s"), F.round(F.col("sd") / F.nullif("mean", F.lit(0.0)), 3).alias("jitter"))
    return out.orderBy(*_order("jitter", "-connections", *flow))


def top_source_ips(events: DataFrame, limit: int = 25) -> DataFrame:
    agg = events.filter("src_ip is not null").groupBy("src_ip").agg(count_rows().alias("events"), F.count_distinct("url").alias("distinct_urls"), F.count_distinct("source").alias("sources"))
    return agg.orderBy(*_order("-events", "src_ip")).limit(limit)


def http_status_summary(events: DataFrame) -> DataFrame:
    agg = events.filter("http_status is not null").groupBy("http_status").agg(count_rows().alias("hits"), F.count_distinct("src_ip").alias("clients"))
    return agg.orderBy(*_order("-hits", "http_status"))


def web_targets(events: DataFrame, limit: int = 25) -> DataFrame:
    agg = events.filter("url is not null").groupBy("url").agg(count_rows().alias("hits"), F.count_distinct("src_ip").alias("clients"), F.max("http_status").alias("sample_status"))
    return agg.orderBy(*_order("-hits", "url")).limit(limit)


def _hits(events: DataFrame, where: Column, cols: dict[str, str], limit: int) -> DataFrame:
    agg = events.filter(where).groupBy(*[F.col(c).alias(k) for k, c in cols.items()]).agg(count_rows().alias("hits"))
    return agg.orderBy(*_order("-hits", *cols)).limit(limit)


def http_hosts(events: DataFrame, limit: int = 30) -> DataFrame:
    return _hits(events, F.col("url_domain").isNotNull(), {"domain": "url_domain", "path": "url_path", "method": "http_method", "status": "http_status"}, limit)


def tls_sessions(events: DataFrame, limit: int = 30) -> DataFrame:
    return _hits(events, F.col("tls_server_name").isNotNull(), {"ip": "dst_ip", "port": "dst_port", "sni": "tls_server_name", "ja3": "tls_ja3", "version": "tls_version"}, limit)


def dns_answers(events: DataFrame, limit: int = 30) -> DataFrame:
    where = F.col("dns_query").isNotNull() & (F.col("dns_response_code").isNotNull() | F.col("dns_answer").isNotNull())
    return _hits(events, where, {"query": "dns_query", "rcode": "dns_response_code", "answer": "dns_answer"}, limit)


def sigma_community(events: DataFrame) -> DataFrame:
    agg = events.filter("sigma_community").groupBy(F.col("rule_title").alias("rule"), F.col("rule_level").alias("level")).agg(count_rows().alias("hits"), F.array_sort(F.collect_set("host")).alias("hosts"))
    return agg.orderBy(*_order("-hits", "rule", "level"))


def severity_rank(c: Column) -> Column:
    s = F.lower(F.coalesce(c, F.lit("")))
    return F.when(s == "critical", 0).when(s == "high", 1).when(s == "medium", 2).when(s == "low", 3).otherwise(4)


def registry_findings(events: DataFrame, limit: int = 500) -> DataFrame:
    cols = {"hive": "registry_hive", "key": "registry_key", "value": "registry_value", "data": "registry_data", "type": "registry_type", "category": "rule_description", "severity": "ioc_severity", "indicator": "ioc_description", "host": "host", "source": "source", "observed": "ts"}
    rows = events.filter("registry_key <> ''").select(*[F.col(c).alias(k) for k, c in cols.items()])
    return rows.orderBy(severity_rank(F.col("severity")), *_order("key", "value", "data", "host", "source", "observed")).limit(limit)


def summary(events: DataFrame) -> DataFrame:
    """(section, name, n): the total, counts by family and category, distinct hosts and users."""
    name = F.coalesce("family", "source", F.lit("(none)"))
    totals = events.agg(count_rows().alias("total"), F.count_distinct("host_canon").alias("hosts"), F.count_distinct("user_canon").alias("users"))
    head = totals.select(F.inline(F.array(*[F.struct(F.lit(k).alias("section"), F.lit("").alias("name"), F.col(k).alias("n")) for k in ("total", "hosts", "users")])))
    family = events.groupBy(name.alias("name")).agg(count_rows().alias("n")).select(F.lit("family").alias("section"), "name", "n")
    category = events.groupBy(F.coalesce("category", F.lit("(none)")).alias("name")).agg(count_rows().alias("n")).select(F.lit("category").alias("section"), "name", "n")
    return head.unionByName(family).unionByName(category)


RECIPES = {f.__name__: f for f in (technique_frequency, rare_processes, first_seen, anomalous_parent_child, top_talkers, rare_dns, nonstandard_ports, beaconing, top_source_ips, http_status_summary, web_targets, http_hosts, tls_sessions, dns_answers, sigma_community, registry_findings)}
