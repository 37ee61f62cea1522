"""Registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.events import derive
from loglattice.functions import addresses, attack, decode, normalize, redaction, scoring, sigma
from loglattice.operators import correlate, delta, extras, graph, recipes, slices
from loglattice.plans.telemetry import duck_events, raw_events, telemetry
from loglattice.sources import readers
from loglattice.storage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None, families: tuple[str, ...] | None = None):
    """Register a query; with ``families`` the SQL sees the derived events of those as ``ev``."""

    def add(f: Query) -> Query:
        text = sql
        if sql is not None and families is not None:
            ctes = duck_events(families)
            head = "WITH RECURSIVE " if sql.startswith("WITH RECURSIVE ") else "WITH "
            text = f"{head}{ctes}, {sql.removeprefix(head)}" if sql.startswith(head) else f"WITH {ctes} {sql}"
        _found[name] = (f, text)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _found.items() if s is not None}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EVTX = ("evtx",)
FLOW = ("evtx", "pcap", "zeek")
ALL = ("evtx", "pcap", "zeek", "scan", "web")
ISO = "'%Y-%m-%dT%H:%M:%SZ'"


def _recipe(name: str, families: tuple[str, ...], sql: str, f: Callable[..., DataFrame], **options) -> None:
    register(name, sql, families)(lambda spark, sf_dir: f(telemetry(spark, sf_dir, families), **options))


_recipe("technique_frequency", EVTX, "SELECT trim(t) AS technique, count(*) AS hits FROM (SELECT unnest(string_split(techniques, ',')) AS t FROM ev WHERE techniques IS NOT NULL) GROUP BY 1", recipes.technique_frequency)
_recipe("rare_processes", EVTX, "SELECT process_name, count(*) AS occurrences, count(DISTINCT host) AS hosts FROM ev WHERE process_name IS NOT NULL GROUP BY 1 HAVING count(*) <= 2", recipes.rare_processes)
_recipe("anomalous_parent_child", EVTX, "SELECT parent_name, process_name, count(*) AS occurrences FROM ev WHERE parent_name IS NOT NULL AND process_name IS NOT NULL GROUP BY 1, 2 HAVING count(*) <= 2", recipes.anomalous_parent_child)
_recipe("first_seen", ("evtx", "pcap"), "SELECT host, user_name, min(ts) AS first_ts, count(*) AS events FROM ev WHERE host IS NOT NULL AND user_name IS NOT NULL GROUP BY 1, 2", recipes.first_seen)
_recipe("top_talkers", ALL, "SELECT dst_ip, count(*) AS connections, coalesce(sum(bytes), 0)::BIGINT AS total_bytes, count(DISTINCT dst_port) AS ports FROM ev WHERE dst_ip IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20", recipes.top_talkers)
_recipe("top_source_ips", ALL, "SELECT src_ip, count(*) AS events, count(DISTINCT url) AS distinct_urls, count(DISTINCT source) AS sources FROM ev WHERE src_ip IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", recipes.top_source_ips)
_recipe("nonstandard_ports", ALL, f"SELECT dst_ip, dst_port, transport, count(*) AS connections, coalesce(sum(bytes), 0)::BIGINT AS total_bytes FROM ev WHERE dst_port IS NOT NULL AND dst_port NOT IN {recipes.COMMON_PORTS} GROUP BY 1, 2, 3", recipes.nonstandard_ports)
_recipe("rare_domains", ("web",), "SELECT dns_query, count(*) AS lookups, max(length(dns_query))::INT AS name_len FROM ev WHERE dns_query IS NOT NULL GROUP BY 1 HAVING count(*) <= 1 OR max(length(dns_query)) >= 50", recipes.rare_dns)
_recipe("web_targets", ("web",), "SELECT url, count(*) AS hits, count(DISTINCT src_ip) AS clients, max(http_status) AS sample_status FROM ev WHERE url IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", recipes.web_targets)
_recipe("http_hosts", ("web",), "SELECT url_domain AS domain, url_path AS path, http_method AS method, http_status AS status, count(*) AS hits FROM ev WHERE url_domain IS NOT NULL GROUP BY 1, 2, 3, 4 ORDER BY 5 DESC, 1, 2, 3, 4 LIMIT 30", recipes.http_hosts)
_recipe("http_status_summary", ("pcap", "web"), "SELECT http_status, count(*) AS hits, count(DISTINCT src_ip) AS clients FROM ev WHERE http_status IS NOT NULL GROUP BY 1", recipes.http_status_summary)
_recipe(
    "beaconing", ("zeek",),
    """WITH folded AS (SELECT host, src_ip, dst_ip, dst_port, min(ts_parsed) AS started FROM ev WHERE dst_ip IS NOT NULL
  GROUP BY host, src_ip, dst_ip, dst_port, src_port, CASE WHEN src_port IS NULL THEN id END),
gaps AS (SELECT *, (epoch_us(started) - lag(epoch_us(started)) OVER (PARTITION BY host, src_ip, dst_ip, dst_port ORDER BY started)) / 1e6 AS gap FROM folded),
stats AS (SELECT host, src_ip, dst_ip, dst_port, count(*) AS n, avg(gap) AS mean, coalesce(stddev_samp(gap), 0) AS sd FROM gaps WHERE gap IS NOT NULL GROUP BY ALL)
SELECT host, src_ip, dst_ip, dst_port, n + 1 AS connections, round(mean, 2) AS mean_interval_s, round(sd / mean, 3) AS jitter FROM stats WHERE n + 1 >= 4 AND mean > 0 AND sd / mean <= 0.25""",
    recipes.beaconing,
)
_recipe(
    "summary", ALL,
    """SELECT 'total' AS section, '' AS name, count(*) AS n FROM ev UNION ALL SELECT 'hosts', '', count(DISTINCT host_canon) FROM ev UNION ALL SELECT 'users', '', count(DISTINCT user_canon) FROM ev
UNION ALL SELECT 'family', family, count(*) FROM ev GROUP BY family UNION ALL SELECT 'category', category, count(*) FROM ev GROUP BY category""",
    recipes.summary,
)

_WHY = f"""CASE WHEN attack_evidence THEN 'ATT&CK technique' WHEN lower(rule_level) IN ('critical', 'high') THEN 'Sigma ' || lower(rule_level) WHEN action IN {correlate.NOTABLE_ACTIONS} THEN 'high-signal event type'
  WHEN source LIKE 'thor%' AND coalesce(action, '') <> 'thor-linked' THEN 'THOR finding' WHEN lower(outcome) = 'failure' THEN 'failed action' END"""
_TL = "id, ts, source, category, action, event_code, outcome, host, user_name, process_name, src_ip, dst_ip, dst_port, dns_query, techniques, kc_phase, rule_title, rule_level, why"
_recipe("timeline", EVTX, f"SELECT {_TL} FROM (SELECT *, {_WHY} AS why FROM ev) WHERE why IS NOT NULL ORDER BY ts_parsed, id LIMIT 200", correlate.timeline)
_recipe("timeline_by_host", EVTX, f"SELECT {_TL} FROM (SELECT *, {_WHY} AS why FROM ev) WHERE why IS NOT NULL AND host = 'ws-7.corp.example' ORDER BY ts_parsed, id LIMIT 200", correlate.timeline, host="ws-7.corp.example")
_recipe("timeline_by_ip", ALL, f"SELECT {_TL} FROM (SELECT *, {_WHY} AS why FROM ev) WHERE why IS NOT NULL AND (src_ip = '10.20.0.7' OR dst_ip = '10.20.0.7') ORDER BY ts_parsed, id LIMIT 200", correlate.timeline, ip="10.20.0.7")
_recipe("host_overview", ALL, "SELECT host_canon AS host, count(*) AS events, count(DISTINCT user_canon) AS users, count(DISTINCT process_name) AS processes, count(DISTINCT dst_ip) AS dst_ips, count(*) FILTER (WHERE attack_evidence) AS attack_events FROM ev WHERE host_canon IS NOT NULL GROUP BY 1", correlate.host_overview)
_BRIDGES = """ind AS (
  SELECT user_canon AS indicator, user_name AS raw, 'user' AS kind, user_domain AS realm, family, source AS origin FROM ev
  UNION ALL SELECT host_canon, host, 'host', host_domain, family, source FROM ev UNION ALL SELECT src_ip, src_ip, 'ip', NULL, family, source FROM ev
  UNION ALL SELECT dst_ip, dst_ip, 'ip', NULL, family, source FROM ev UNION ALL SELECT dns_query, dns_query, 'domain', NULL, family, source FROM ev
  UNION ALL SELECT file_hash, file_hash, 'file_hash', NULL, family, source FROM ev UNION ALL SELECT file_canon, file_name, 'file', NULL, family, source FROM ev),
agg AS (
  SELECT indicator, kind, count(DISTINCT family) AS families, string_agg(DISTINCT family, ', ' ORDER BY family) AS family_list, string_agg(DISTINCT origin, ', ' ORDER BY origin) AS origins,
    string_agg(DISTINCT raw, ', ' ORDER BY raw) AS variants, string_agg(DISTINCT realm, ', ' ORDER BY realm) AS realm_list, count(*) AS occurrences, count(DISTINCT raw) AS raws, count(DISTINCT split_part(realm, '.', 1)) AS labels
  FROM ind WHERE indicator IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT family) > 1),
typed AS (SELECT *, CASE WHEN labels > 1 THEN 'ambiguous' WHEN raws > 1 THEN 'normalized' ELSE 'exact' END AS match_type FROM agg),
scored AS (
  SELECT *, greatest(0, least(1, CASE kind WHEN 'file_hash' THEN 85 WHEN 'user' THEN 70 WHEN 'host' THEN 55 WHEN 'domain' THEN 40 WHEN 'file' THEN 25 ELSE 10 END / 100.0 + least((families - 2) * 5, 10) / 100.0
    - CASE match_type WHEN 'ambiguous' THEN 0.30 WHEN 'normalized' THEN 0.05 ELSE 0 END)) AS c FROM typed)"""
register("shared_indicators", f"WITH {_BRIDGES} SELECT indicator, kind, families, family_list, origins, variants, realm_list, occurrences, match_type FROM scored", ALL)(
    lambda spark, sf_dir: correlate.shared_indicators(telemetry(spark, sf_dir)).select("indicator", "kind", "families", "family_list", "origins", "variants", "realm_list", "occurrences", "match_type")
)
register("bridge_confidence", f"WITH {_BRIDGES} SELECT indicator, kind, round(c, 2)::DOUBLE AS confidence, CASE WHEN round(c, 2) >= 0.7 THEN 'high' WHEN round(c, 2) >= 0.4 THEN 'medium' ELSE 'low' END AS confidence_label FROM scored", ALL)(
    lambda spark, sf_dir: correlate.shared_indicators(telemetry(spark, sf_dir)).select("indicator", "kind", F.col("confidence").cast("double"), "confidence_label")
)
_PHASE_ARROW = "array_to_string(list_filter(['Reconnaissance', 'Weaponization', 'Delivery', 'Exploitation', 'Installation', 'Command and Control', 'Actions on Objectives'], lambda p: list_contains(seen, p)), ' → ')"
_EPISODES = """WITH jumps AS (SELECT *, CASE WHEN epoch_us(ts_parsed) - lag(epoch_us(ts_parsed)) OVER (ORDER BY ts_parsed, id) > {gap} * 1000000 THEN 1 ELSE 0 END AS jump FROM ev),
numbered AS (SELECT *, sum(jump) OVER (ORDER BY ts_parsed, id ROWS UNBOUNDED PRECEDING) AS episode FROM jumps),
agg AS (SELECT episode, min(ts_parsed) AS s, max(ts_parsed) AS e, count(*) AS events, count(DISTINCT family) AS families, string_agg(DISTINCT family, ', ' ORDER BY family) AS family_list, count(DISTINCT host) AS hosts,
  count(DISTINCT coalesce(src_ip, dst_ip)) AS ips, coalesce(list(DISTINCT kc_phase), []) AS seen FROM numbered GROUP BY episode HAVING count(DISTINCT family) >= 2)
SELECT strftime(s, '%Y-%m-%dT%H:%M:%SZ') AS start_ts, strftime(e, '%Y-%m-%dT%H:%M:%SZ') AS end_ts, events, families, family_list, hosts, ips, """ + _PHASE_ARROW + " AS phases FROM agg ORDER BY s LIMIT {limit}"
_recipe("episodes", FLOW, _EPISODES.format(gap=120, limit=100), correlate.episodes)
_recipe("episodes_short_gap", FLOW, _EPISODES.format(gap=30, limit=10_000), correlate.episodes, gap_seconds=30, limit=10_000)
_recipe(
    "killchain", ALL,
    f"""SELECT kc_phase AS phase, kc_order AS phase_order, count(*) AS events, count(DISTINCT host_canon) AS hosts, count(DISTINCT family) AS sources, strftime(min(ts_parsed), {ISO}) AS first_seen, strftime(max(ts_parsed), {ISO}) AS last_seen,
  CASE kc_order WHEN 4 THEN 'credential-access' WHEN 5 THEN 'defense-evasion, initial-access, persistence, privilege-escalation' ELSE 'command-and-control, exfiltration' END AS tactics, CASE kc_order WHEN 4 THEN 'T1110' WHEN 5 THEN 'T1078' ELSE 'T1041, T1071.004' END AS technique_list
FROM ev WHERE kc_phase IS NOT NULL GROUP BY 1, 2""",
    correlate.killchain,
)
_recipe(
    "host_killchain", ALL,
    f"""WITH agg AS (SELECT host_canon AS host, max(kc_order) AS max_order, count(*) FILTER (WHERE attack_evidence) AS attack_events, count(DISTINCT kc_phase) AS phases_covered, list(DISTINCT kc_phase) AS seen,
  min(ts_parsed) FILTER (WHERE attack_evidence) AS f, max(ts_parsed) FILTER (WHERE attack_evidence) AS l FROM ev WHERE host_canon IS NOT NULL GROUP BY 1)
SELECT host, max_order, attack_events, phases_covered, {_PHASE_ARROW} AS phases, CASE max_order WHEN 4 THEN 'Exploitation' WHEN 5 THEN 'Installation' ELSE 'Actions on Objectives' END AS deepest_phase,
  strftime(f, {ISO}) AS first_seen, strftime(l, {ISO}) AS last_seen FROM agg WHERE attack_events > 0 ORDER BY max_order DESC, phases_covered DESC, attack_events DESC, host LIMIT 50""",
    correlate.host_killchain,
)
_recipe(
    "technique_catalog", ALL,
    f"""WITH lists AS (SELECT techniques, count(*) AS n, count(DISTINCT host_canon) AS h, count(DISTINCT family) AS s, min(ts_parsed) AS lo, max(ts_parsed) AS hi FROM ev WHERE techniques IS NOT NULL GROUP BY 1),
per AS (SELECT unnest(string_split(techniques, ',')) AS technique, * FROM lists)
SELECT technique, CASE technique WHEN 'T1110' THEN 'Brute Force' WHEN 'T1078' THEN 'Valid Accounts' WHEN 'T1041' THEN 'Exfiltration Over C2 Channel' ELSE 'DNS' END AS name,
  CASE technique WHEN 'T1110' THEN 'credential-access' WHEN 'T1078' THEN 'defense-evasion, initial-access, persistence, privilege-escalation' WHEN 'T1041' THEN 'exfiltration' ELSE 'command-and-control' END AS tactics,
  CASE technique WHEN 'T1110' THEN 'Exploitation' WHEN 'T1078' THEN 'Installation' WHEN 'T1041' THEN 'Actions on Objectives' ELSE 'Command and Control' END AS phase,
  sum(n)::BIGINT AS hits, max(h) AS hosts, max(s) AS sources, strftime(min(lo), {ISO}) AS first_seen, strftime(max(hi), {ISO}) AS last_seen FROM per GROUP BY 1""",
    correlate.technique_catalog,
)
# A table read from a STIX bundle, with techniques that the built-in one lacks.
_BUNDLE = attack.read_bundle([
    {"type": "attack-pattern", "name": "Adversary-in-the-Middle", "external_references": [{"source_name": "mitre-attack", "external_id": "T1557"}], "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": p} for p in ("credential-access", "collection")]},
    {"type": "attack-pattern", "name": "Gone", "revoked": True, "external_references": [{"source_name": "mitre-attack", "external_id": "T1078"}], "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "impact"}]},
    {"type": "attack-pattern", "name": "Exfiltration Over C2 Channel", "external_references": [{"source_name": "mitre-attack", "external_id": "T1041"}], "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "exfiltration"}]},
])


@register(
    "technique_catalog_bundle",
    f"""WITH lists AS (SELECT replace(techniques, 'T1110', 'T1557.002') AS techniques, count(*) AS n, count(DISTINCT host_canon) AS h, count(DISTINCT family) AS s, min(ts_parsed) AS lo, max(ts_parsed) AS hi FROM ev WHERE techniques IS NOT NULL GROUP BY 1),
per AS (SELECT unnest(string_split(techniques, ',')) AS technique, * FROM lists)
SELECT technique, CASE technique WHEN 'T1041' THEN 'Exfiltration Over C2 Channel' ELSE '(not in ATT&CK map)' END AS name,
  CASE technique WHEN 'T1557.002' THEN 'credential-access, collection' WHEN 'T1041' THEN 'exfiltration' ELSE '' END AS tactics,
  CASE technique WHEN 'T1557.002' THEN 'Actions on Objectives' WHEN 'T1041' THEN 'Actions on Objectives' ELSE '' END AS phase,
  sum(n)::BIGINT AS hits, max(h) AS hosts, max(s) AS sources, strftime(min(lo), {ISO}) AS first_seen, strftime(max(hi), {ISO}) AS last_seen FROM per GROUP BY 1""",
    ALL,
)
def technique_catalog_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_events(spark, sf_dir).withColumn("techniques", F.replace("techniques", F.lit("T1110"), F.lit("T1557.002")))
    return correlate.technique_catalog(derive(raw, _BUNDLE), techniques=_BUNDLE)


@register(
    "phase_corroboration_flagged",
    """WITH span AS (SELECT kc_phase AS phase, min(epoch_us(ts_parsed)) // 1000000 AS lo, max(epoch_us(ts_parsed)) // 1000000 AS hi FROM ev WHERE kc_phase IS NOT NULL GROUP BY 1),
near AS (SELECT s.phase, s.lo, s.hi, e.* FROM ev e JOIN span s ON epoch_us(e.ts_parsed) BETWEEN (s.lo - 120) * 1000000 AND (s.hi + 120) * 1000000
  WHERE NOT e.attack_evidence AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.kc_phase = s.phase AND x.family = e.family)),
agg AS (SELECT phase, family, count(*) AS events, count(*) FILTER (WHERE lower(outcome) = 'failure') AS failures, count(DISTINCT CASE WHEN dst_ip NOT LIKE '%5' THEN dst_ip END)::INT AS n_dsts, count(DISTINCT dns_query)::INT AS n_domains, count(DISTINCT user_canon)::INT AS n_users,
  any_value(hi - lo + 240) AS window_s, list_transform(list_sort(list(DISTINCT (CASE WHEN dst_ip LIKE '%1' THEN '0' ELSE '1' END) || dst_ip) FILTER (WHERE dst_ip IS NOT NULL AND dst_ip NOT LIKE '%5'))[1:2], lambda x: x[2:] || CASE WHEN x[1] = '0' THEN ' (flagged as periodic call-backs — to validate)' ELSE '' END) AS d, list_sort(list(DISTINCT dns_query) FILTER (WHERE dns_query IS NOT NULL))[1:2] AS q, list_sort(list(DISTINCT user_canon) FILTER (WHERE user_canon IS NOT NULL))[1:2] AS u FROM near GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY events DESC, family)::INT AS rank FROM agg)
SELECT phase, rank, family, events, failures, n_dsts, n_domains, n_users, family || ': ' || concat_ws(', ', events || ' event(s)', CASE WHEN failures > 0 THEN failures || ' failed' END, CASE WHEN len(d) > 0 THEN 'to ' || array_to_string(d, ', ') END,
  CASE WHEN len(q) > 0 THEN 'resolving ' || array_to_string(q, ', ') END, CASE WHEN len(u) > 0 THEN 'as ' || array_to_string(u, ', ') END) AS note, window_s FROM ranked WHERE rank <= 4""",
    ALL,
)
def phase_corroboration_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With destinations that are flagged as call-backs, and others that are declared infrastructure."""
    ev = telemetry(spark, sf_dir, ALL)
    infra = [f"203.0.113.{k}" for k in range(256) if k % 10 == 5]
    return correlate.phase_corroboration(ev, ev.filter("dst_ip like '%1'").select("dst_ip"), tuple(infra))


register(
    "phase_corroboration",
    """WITH span AS (SELECT kc_phase AS phase, min(epoch_us(ts_parsed)) // 1000000 AS lo, max(epoch_us(ts_parsed)) // 1000000 AS hi FROM ev WHERE kc_phase IS NOT NULL GROUP BY 1),
near AS (SELECT s.phase, s.lo, s.hi, e.* FROM ev e JOIN span s ON epoch_us(e.ts_parsed) BETWEEN (s.lo - 120) * 1000000 AND (s.hi + 120) * 1000000
  WHERE NOT e.attack_evidence AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.kc_phase = s.phase AND x.family = e.family)),
agg AS (SELECT phase, family, count(*) AS events, count(*) FILTER (WHERE lower(outcome) = 'failure') AS failures, count(DISTINCT dst_ip)::INT AS n_dsts, count(DISTINCT dns_query)::INT AS n_domains, count(DISTINCT user_canon)::INT AS n_users,
  any_value(hi - lo + 240) AS window_s, list_sort(list(DISTINCT dst_ip) FILTER (WHERE dst_ip IS NOT NULL))[1:2] AS d, list_sort(list(DISTINCT dns_query) FILTER (WHERE dns_query IS NOT NULL))[1:2] AS q, list_sort(list(DISTINCT user_canon) FILTER (WHERE user_canon IS NOT NULL))[1:2] AS u FROM near GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY events DESC, family)::INT AS rank FROM agg)
SELECT phase, rank, family, events, failures, n_dsts, n_domains, n_users, family || ': ' || concat_ws(', ', events || ' event(s)', CASE WHEN failures > 0 THEN failures || ' failed' END, CASE WHEN len(d) > 0 THEN 'to ' || array_to_string(d, ', ') END,
  CASE WHEN len(q) > 0 THEN 'resolving ' || array_to_string(q, ', ') END, CASE WHEN len(u) > 0 THEN 'as ' || array_to_string(u, ', ') END) AS note, window_s FROM ranked WHERE rank <= 4""",
    ALL,
)(lambda spark, sf_dir: correlate.phase_corroboration(telemetry(spark, sf_dir)))
_ENTS = """ents AS (SELECT id, family, kc_order, kc_phase, unnest(list_filter([CASE WHEN user_canon IS NOT NULL THEN 'user:' || user_canon END, CASE WHEN host_canon IS NOT NULL THEN 'host:' || host_canon END, CASE WHEN src_ip IS NOT NULL THEN 'ip:' || src_ip END,
  CASE WHEN dst_ip IS NOT NULL THEN 'ip:' || dst_ip END, CASE WHEN dns_query IS NOT NULL THEN 'domain:' || dns_query END, CASE WHEN file_hash IS NOT NULL THEN 'file_hash:' || file_hash END, CASE WHEN file_canon IS NOT NULL THEN 'file:' || file_canon END], lambda x: x IS NOT NULL)) AS k FROM ev)"""
_recipe("entity_nodes", ALL, f"WITH {_ENTS} SELECT split_part(k, ':', 1) AS kind, substr(k, instr(k, ':') + 1) AS value, count(*) AS events, count(DISTINCT family) AS families, max(kc_order) AS kc_order FROM ents GROUP BY 1, 2", graph.entity_nodes)
_recipe("entity_edges", ALL, f"WITH {_ENTS} SELECT x.k AS a, y.k AS b, count(*) AS weight FROM ents x JOIN ents y ON x.id = y.id AND x.k < y.k GROUP BY 1, 2", graph.entity_edges)
_CLUSTERS = """WITH RECURSIVE ent AS MATERIALIZED (SELECT family, kc_order, kc_phase, attack_evidence, tactics, list_filter(['user:' || user_canon, 'host:' || host_canon, 'ip:' || src_ip, 'ip:' || dst_ip, 'domain:' || dns_query, 'file_hash:' || file_hash, 'file:' || file_canon], lambda x: x IS NOT NULL) AS keys FROM ev),
star AS MATERIALIZED (SELECT DISTINCT keys[1] AS a, unnest(keys) AS b FROM ent WHERE len(keys) > 0),
near AS MATERIALIZED (SELECT a, b FROM star UNION SELECT b, a FROM star),
cc(node, root) USING KEY (node) AS (
  SELECT a, min(least(a, b)) FROM near GROUP BY a
  UNION SELECT l.node, min(n.root) FROM recurring.cc l JOIN near ON near.a = l.node JOIN cc n ON n.node = near.b WHERE n.root < l.root GROUP BY l.node),
m AS MATERIALIZED (SELECT cc.root, e.* FROM ent e JOIN cc ON cc.node = e.keys[1]),
facts AS (SELECT root, count(DISTINCT family) AS sources, string_agg(DISTINCT family, ', ' ORDER BY family) AS source_list, max(kc_order) AS kc_depth, bool_or(attack_evidence) AS evidence FROM m GROUP BY root),
phases AS (SELECT root, string_agg(kc_phase, ' → ' ORDER BY kc_order) AS kc_phases, max_by(kc_phase, kc_order) AS deepest FROM (SELECT DISTINCT root, kc_phase, kc_order FROM m WHERE kc_phase IS NOT NULL) GROUP BY root),
tacs AS (SELECT root, string_agg(t, ', ' ORDER BY t) AS tactics FROM (SELECT DISTINCT root, unnest(string_split(tactics, ',')) AS t FROM (SELECT DISTINCT root, tactics FROM m)) WHERE t <> '' GROUP BY root),
kinds AS (SELECT root, split_part(node, ':', 1) AS kind, substr(node, instr(node, ':') + 1) AS value FROM cc),
lists AS (SELECT root, kind, count(*) AS n, array_to_string(list_slice(list_sort(list(value)), 1, 8), ', ') AS list FROM kinds GROUP BY root, kind),
wide AS (SELECT root, sum(n)::BIGINT AS entities, coalesce(max(list) FILTER (kind = 'user'), '') AS users, coalesce(max(list) FILTER (kind = 'host'), '') AS hosts, coalesce(max(list) FILTER (kind = 'ip'), '') AS ips,
  coalesce(max(n) FILTER (kind = 'file_hash'), 0) AS hashes, coalesce(max(n) FILTER (kind = 'file'), 0) AS files, coalesce(max(n) FILTER (kind = 'domain'), 0) AS domains FROM lists GROUP BY root)
SELECT entities, sources, source_list, users, hosts, ips, hashes, files, domains, coalesce(kc_phases, '') AS kc_phases, kc_depth, coalesce(deepest, CASE WHEN evidence THEN '(technique not in ATT&CK map)' ELSE '' END) AS deepest_phase, coalesce(tactics, '') AS tactics
FROM facts JOIN wide USING (root) LEFT JOIN phases USING (root) LEFT JOIN tacs USING (root) WHERE sources >= 2 AND entities >= 2
ORDER BY kc_depth DESC, sources DESC, entities DESC, hosts, users, ips LIMIT 50"""
_recipe("incident_clusters", ALL, _CLUSTERS, graph.incident_clusters)


_GRAPH = f"""WITH {_ENTS}, pairs AS (SELECT x.k AS a, y.k AS b, count(*) AS weight FROM ents x JOIN ents y ON x.id = y.id AND x.k < y.k GROUP BY 1, 2),
deg AS (SELECT id, sum(weight)::BIGINT AS degree FROM (SELECT a AS id, weight FROM pairs UNION ALL SELECT b, weight FROM pairs) GROUP BY 1),
nodes AS (SELECT k AS id, count(*) AS events, count(DISTINCT family)::INT AS families, string_agg(DISTINCT family, ', ' ORDER BY family) AS family_list, coalesce(max(CASE WHEN kc_phase IS NOT NULL THEN kc_order END), 0)::INT AS kc_order, coalesce(arg_max(kc_phase, kc_order) FILTER (kc_phase IS NOT NULL), '') AS phase FROM ents GROUP BY 1),
shown AS (SELECT nodes.*, coalesce(degree, 0)::BIGINT AS degree, (SELECT count(*) FROM nodes) AS total_nodes FROM nodes LEFT JOIN deg USING (id) ORDER BY coalesce(degree, 0) DESC, families DESC, events DESC, id LIMIT 40)"""
_recipe("entity_graph_nodes", ALL, f"{_GRAPH} SELECT id, split_part(id, ':', 1) AS kind, substr(id, instr(id, ':') + 1) AS value, events, families, family_list, kc_order, phase, degree, total_nodes, total_nodes > 40 AS truncated, CASE phase WHEN '' THEN '{graph.NO_LANE}' ELSE phase END AS lane, row_number() OVER (PARTITION BY phase ORDER BY degree DESC, substr(id, instr(id, ':') + 1), id)::INT AS lane_rank FROM shown", lambda ev: graph.entity_graph(ev)[0].drop("phases", "lane_order"))
_recipe("entity_graph_edges", ALL, f"{_GRAPH} SELECT a, b, weight FROM pairs WHERE weight >= 2 AND a IN (SELECT id FROM shown) AND b IN (SELECT id FROM shown)", lambda ev: graph.entity_graph(ev, min_weight=2)[1])


@register(
    "baseline_diff",
    """WITH old AS (SELECT * FROM ev WHERE ts_parsed < TIMESTAMP '2024-01-08'), new AS (SELECT * FROM ev WHERE ts_parsed >= TIMESTAMP '2024-01-08')
SELECT 'process' AS dimension, v AS value FROM (SELECT process_name AS v FROM new WHERE process_name IS NOT NULL EXCEPT SELECT process_name FROM old)
UNION ALL SELECT 'dst_ip', v FROM (SELECT dst_ip AS v FROM new WHERE dst_ip IS NOT NULL EXCEPT SELECT dst_ip FROM old) UNION ALL SELECT 'dns', v FROM (SELECT dns_query AS v FROM new WHERE dns_query IS NOT NULL EXCEPT SELECT dns_query FROM old)
UNION ALL SELECT 'technique', v FROM (SELECT unnest(string_split(techniques, ',')) AS v FROM new WHERE techniques IS NOT NULL EXCEPT SELECT unnest(string_split(techniques, ',')) FROM old)
UNION ALL SELECT 'parent_child', v FROM (SELECT parent_name || ' → ' || process_name AS v FROM new WHERE parent_name IS NOT NULL EXCEPT SELECT parent_name || ' → ' || process_name FROM old)""",
    EVTX,
)
def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = telemetry(spark, sf_dir, EVTX)
    return delta.diff(ev.filter("ts_parsed < timestamp'2024-01-08 00:00:00'"), ev.filter("ts_parsed >= timestamp'2024-01-08 00:00:00'"))


@register(
    "delta_bridges",
    f"""WITH {_BRIDGES.replace("FROM ev", "FROM ev").replace("ind AS", "ind AS")},
old_ind AS (SELECT indicator, kind, count(DISTINCT family) AS families FROM ind_t WHERE indicator IS NOT NULL AND t < TIMESTAMP '2024-01-08' GROUP BY 1, 2 HAVING count(DISTINCT family) > 1)
SELECT n.indicator, n.kind, CASE WHEN o.families IS NULL THEN 'new' ELSE 'strengthened' END AS change, n.families, o.families AS families_before FROM scored n LEFT JOIN old_ind o USING (indicator, kind) WHERE o.families IS NULL OR n.families > o.families""".replace(
        "old_ind AS",
        """ind_t AS (SELECT user_canon AS indicator, 'user' AS kind, family, ts_parsed AS t FROM ev UNION ALL SELECT host_canon, 'host', family, ts_parsed FROM ev UNION ALL SELECT src_ip, 'ip', family, ts_parsed FROM ev UNION ALL SELECT dst_ip, 'ip', family, ts_parsed FROM ev
  UNION ALL SELECT dns_query, 'domain', family, ts_parsed FROM ev UNION ALL SELECT file_hash, 'file_hash', family, ts_parsed FROM ev UNION ALL SELECT file_canon, 'file', family, ts_parsed FROM ev),
old_ind AS""",
    ),
    ALL,
)
def delta_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = telemetry(spark, sf_dir)
    before = correlate.shared_indicators(ev.filter("ts_parsed < timestamp'2024-01-08 00:00:00'"))
    return delta.bridge_delta(before, correlate.shared_indicators(ev))


@register("ioc_search", "SELECT b.ioc, count(*) AS hits FROM (SELECT DISTINCT trim(text) AS ioc FROM benchmark) b JOIN documents d ON contains(lower(d.text), lower(b.ioc)) GROUP BY 1")
def ioc_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    iocs = table(spark, sf_dir, "benchmark").select(F.col("text").alias("ioc"))
    return extras.ioc_search(table(spark, sf_dir, "documents"), iocs, fields=["text"])


_recipe("pcap_conversations", ("pcap", "zeek"), f"SELECT src_ip, dst_ip, dst_port, transport, count(*) AS packets, coalesce(sum(bytes), 0)::BIGINT AS total_bytes, dst_port NOT IN {recipes.COMMON_PORTS} AS nonstandard, coalesce(sum(bytes), 0) > 1000000 AS exfil_hint FROM ev WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL GROUP BY 1, 2, 3, 4", extras.conversations)
_recipe("dns_counts", ("web",), "SELECT dns_query, count(*) AS lookups FROM ev WHERE dns_query IS NOT NULL GROUP BY 1", extras.dns_counts)
_recipe("remote_logons", EVTX, "SELECT CASE event_code WHEN 4624 THEN 'remote' ELSE 'failed' END AS kind, user_name AS user, host, src_ip, logon_type, count(*) AS n FROM ev WHERE (event_code = 4624 AND logon_type IN ('3', '8', '9', '10')) OR event_code = 4625 GROUP BY ALL", extras.logons)
_recipe("logon_totals", EVTX, "SELECT CASE event_code WHEN 4624 THEN 'remote' ELSE 'failed' END AS kind, count(*) AS n, count(DISTINCT user_name) AS users, count(DISTINCT host) AS hosts, count(DISTINCT src_ip) AS sources FROM ev WHERE (event_code = 4624 AND logon_type IN ('3', '8', '9', '10')) OR event_code = 4625 GROUP BY 1", extras.logon_totals)
_recipe("log_metrics", ALL, f"SELECT source, count(*) AS n, strftime(min(ts_parsed), {ISO}) AS first, strftime(max(ts_parsed), {ISO}) AS last FROM ev GROUP BY 1", lambda ev: extras.log_metrics(ev).withColumns({c: normalize.iso(F.col(c)) for c in ("first", "last")}))
_recipe("timeline_search", EVTX, f"SELECT {_TL} FROM (SELECT {_TL}, ts_parsed FROM (SELECT *, {_WHY} AS why FROM ev) WHERE why IS NOT NULL ORDER BY ts_parsed, id LIMIT 200) WHERE why = 'ATT&CK technique' AND lower(concat_ws(' ', ts, source, action, host, user_name, process_name, src_ip, dst_ip, dns_query, rule_title, why)) LIKE '%user1%'", lambda ev: extras.timeline_filter(correlate.timeline(ev), why="ATT&CK technique", q="USER1"))
_recipe("event_id_metrics", EVTX, "SELECT event_code, count(*) AS n FROM ev WHERE event_code IS NOT NULL GROUP BY 1", extras.event_id_metrics)
_recipe("computer_metrics", ALL, "SELECT host, count(*) AS n FROM ev WHERE host IS NOT NULL GROUP BY 1", extras.computer_metrics)
_recipe("pivot_keywords", ALL, "SELECT DISTINCT kind, value FROM (SELECT 'user' AS kind, user_name AS value FROM ev UNION ALL SELECT 'host', host FROM ev UNION ALL SELECT 'src_ip', src_ip FROM ev UNION ALL SELECT 'dst_ip', dst_ip FROM ev UNION ALL SELECT 'process', process_name FROM ev UNION ALL SELECT 'domain', dns_query FROM ev UNION ALL SELECT 'hash', file_hash FROM ev) WHERE value IS NOT NULL", extras.pivot_keywords)
_recipe("keyword_search", EVTX, "SELECT id FROM ev WHERE action = 'user-account-created' AND user_canon LIKE '%user1%'", lambda ev: extras.search(ev.select("id", "action", "user_canon"), ["account-created", "USER1"], all_of=True).select("id"))


@register(
    "flow_merge",
    """WITH p AS (SELECT src_ip, dst_ip, dst_port, transport, count(*) AS packets, sum(bytes) AS pb FROM ev WHERE family = 'pcap' GROUP BY 1, 2, 3, 4),
z AS (SELECT * FROM (SELECT src_ip, dst_ip, dst_port, transport, bytes AS zb, row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port, transport ORDER BY id DESC) AS r FROM ev WHERE family IN ('evtx', 'zeek')) WHERE r = 1)
SELECT coalesce(z.src_ip, p.src_ip) AS src_ip, coalesce(z.dst_ip, p.dst_ip) AS dst_ip, coalesce(z.dst_port, p.dst_port) AS dst_port, coalesce(z.transport, p.transport) AS transport, coalesce(packets, 0) AS packets, coalesce(zb, pb)::BIGINT AS bytes,
  CASE WHEN z.r IS NULL THEN 'packets' WHEN packets IS NULL THEN 'flows' ELSE 'both' END AS seen_by FROM p FULL JOIN z ON p.src_ip = z.src_ip AND p.dst_ip = z.dst_ip AND p.dst_port = z.dst_port AND p.transport = z.transport""",
    FLOW,
)
def flow_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.merge_flows(telemetry(spark, sf_dir, ("pcap",)), telemetry(spark, sf_dir, ("evtx", "zeek")))


@register("zeek_enrich", "SELECT o_orderkey AS uid, o_orderstatus AS state, l_linenumber AS answer, l_returnflag AS kind, (SELECT min(l_shipmode) FROM (SELECT l_linestatus AS l_shipmode FROM lineitem x WHERE x.l_orderkey = o_orderkey AND x.l_linenumber = 1)) AS notice FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def zeek_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    conns = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderstatus").alias("state"))
    items = table(spark, sf_dir, "lineitem")
    notices = items.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("uid"), F.col("l_linestatus").alias("ts"), F.col("l_linestatus").alias("note"))
    return extras.enrich_connections(conns, items.select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("answer"), F.col("l_returnflag").alias("kind")), notices)


@register("sigma_community", "SELECT p_brand AS rule, p_type AS level, count(*) AS hits, string_agg(DISTINCT 'h' || (p_size % 10), ', ' ORDER BY 'h' || (p_size % 10)) AS hosts FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2")
def sigma_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("rule_title"), F.col("p_type").alias("rule_level"), F.expr("'h' || (p_size % 10)").alias("host"), (F.col("p_size") % 2 == 0).alias("sigma_community"))
    return recipes.sigma_community(part).withColumn("hosts", F.array_join("hosts", ", "))


@register(
    "registry_findings",
    """SELECT 'HKLM' AS hive, p_type AS key, p_name AS value, p_brand AS data, 'REG_SZ' AS type, 'autostart' AS category, CASE p_size % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END AS severity, 'p' || p_partkey AS indicator, 'host' || (p_size % 7) AS host, 'reg' AS source, '2024' AS observed
FROM part ORDER BY CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END, p_type, p_name, p_brand, 'host' || (p_size % 7), 'p' || p_partkey LIMIT 500""",
)
def registry_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("'HKLM' as registry_hive", "p_type as registry_key", "p_name as registry_value", "p_brand as registry_data", "'REG_SZ' as registry_type", "'autostart' as rule_description", "case p_size % 5 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' end as ioc_severity", "'p' || p_partkey as ioc_description", "'host' || (p_size % 7) as host", "'reg' as source", "'2024' as ts")
    return recipes.registry_findings(rows)


@register("tls_sessions", "SELECT '203.0.113.' || s_nationkey AS ip, 443 AS port, 'n' || s_nationkey || '.example' AS sni, md5('n' || s_nationkey) AS ja3, 'TLSv12' AS version, count(*) AS hits FROM supplier GROUP BY ALL ORDER BY hits DESC, ip, port, sni, ja3, version LIMIT 30")
def tls_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.tls_sessions(table(spark, sf_dir, "supplier").selectExpr("'203.0.113.' || s_nationkey as dst_ip", "443 as dst_port", "'n' || s_nationkey || '.example' as tls_server_name", "md5('n' || s_nationkey) as tls_ja3", "'TLSv12' as tls_version"))


@register("dns_answers", "SELECT lower(c_mktsegment) || '.example' AS query, CASE WHEN c_nationkey % 3 > 0 THEN 'NOERROR' END AS rcode, CASE WHEN c_nationkey % 2 = 0 THEN '203.0.113.' || c_nationkey END AS answer, count(*) AS hits FROM customer WHERE c_nationkey % 3 > 0 OR c_nationkey % 2 = 0 GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 30")
def dns_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.dns_answers(table(spark, sf_dir, "customer").selectExpr("lower(c_mktsegment) || '.example' as dns_query", "case when c_nationkey % 3 > 0 then 'NOERROR' end as dns_response_code", "case when c_nationkey % 2 = 0 then '203.0.113.' || c_nationkey end as dns_answer"))


@register("canon_users", "SELECT DISTINCT user_name, user_canon, user_domain FROM ev WHERE user_name IS NOT NULL", ("evtx", "pcap"))
def canon_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir, ("evtx", "pcap")).filter("user_name is not null").select("user_name", "user_canon", "user_domain").distinct()


@register("canon_hosts", "SELECT DISTINCT host, host_canon, host_domain FROM ev WHERE host IS NOT NULL", ("evtx", "pcap"))
def canon_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir, ("evtx", "pcap")).filter("host is not null").select("host", "host_canon", "host_domain").distinct()


@register("canon_files", "SELECT p_name AS raw, lower(replace(p_name, ' ', '_')) || '.exe' AS canon FROM part")
def canon_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loglattice.functions import normalize as n

    raw = F.concat(F.lit("C:\\Temp\\"), F.translate("p_name", " ", "_"), F.lit(".EXE"))
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("raw"), n.canon_file(raw).alias("canon"))


# -- functions over the driver's tables --------------------------------------------------------


def _vector() -> F.Column:
    def pick(letters: str, k: str) -> F.Column:
        return F.element_at(F.array(*map(F.lit, letters)), (F.expr(f"cast({k} as int)") + 1))

    parts = (("CVSS:3.1/AV:", "NALP", "p_partkey % 4"), ("/AC:", "LH", "p_partkey % 2"), ("/PR:", "NLH", "p_partkey % 3"), ("/UI:", "NR", "p_size % 2"), ("/S:", "UC", "p_size % 2"), ("/C:", "HLN", "p_size % 3"), ("/I:", "HLN", "p_partkey % 3"), ("/A:", "HLN", "(p_size + p_partkey) % 3"))
    return F.concat(*[x for t, letters, k in parts for x in (F.lit(t), pick(letters, k))])


@register(
    "cvss_scores",
    """WITH v AS (SELECT p_partkey, [0.85, 0.62, 0.55, 0.2][p_partkey % 4 + 1] AS av, [0.77, 0.44][p_partkey % 2 + 1] AS ac, p_size % 2 = 1 AS ch, [0.85, 0.62, 0.27][p_partkey % 3 + 1] AS pu, [0.85, 0.68, 0.5][p_partkey % 3 + 1] AS pc,
  [0.85, 0.62][p_size % 2 + 1] AS ui, [0.56, 0.22, 0.0][p_size % 3 + 1] AS c, [0.56, 0.22, 0.0][p_partkey % 3 + 1] AS i, [0.56, 0.22, 0.0][(p_size + p_partkey) % 3 + 1] AS a FROM part),
w AS (SELECT *, 1 - (1 - c::DOUBLE) * (1 - i::DOUBLE) * (1 - a::DOUBLE) AS isc FROM v),
x AS (SELECT p_partkey, ch, CASE WHEN ch THEN 7.52::DOUBLE * (isc - 0.029::DOUBLE) - 3.25::DOUBLE * pow(isc - 0.02::DOUBLE, 15.0) ELSE 6.42::DOUBLE * isc END AS impact, 8.22::DOUBLE * av::DOUBLE * ac::DOUBLE * (CASE WHEN ch THEN pc ELSE pu END)::DOUBLE * ui::DOUBLE AS exploit FROM w),
y AS (SELECT p_partkey, impact, CAST(round(least(CASE WHEN ch THEN 1.08::DOUBLE * (impact + exploit) ELSE impact + exploit END, 10.0::DOUBLE) * 100000) AS BIGINT) AS whole FROM x),
z AS (SELECT p_partkey, CASE WHEN impact <= 0 THEN 0.0::DOUBLE WHEN whole % 10000 = 0 THEN whole / 100000.0::DOUBLE ELSE (whole // 10000 + 1) / 10.0::DOUBLE END AS score FROM y)
SELECT p_partkey, score, CASE WHEN score = 0 THEN 'None' WHEN score < 4 THEN 'Low' WHEN score < 7 THEN 'Medium' WHEN score < 9 THEN 'High' ELSE 'Critical' END AS severity FROM z""",
)
def cvss_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scoring.cvss31(_vector()).alias("s")).select("p_partkey", "s.score", "s.severity")


@register("risk_matrix", "SELECT p_partkey, (p_size % 5 + 1) * (p_partkey % 5 + 1) AS product, CASE WHEN (p_size % 5 + 1) * (p_partkey % 5 + 1) <= 4 THEN 'low' WHEN (p_size % 5 + 1) * (p_partkey % 5 + 1) <= 9 THEN 'medium' WHEN (p_size % 5 + 1) * (p_partkey % 5 + 1) <= 16 THEN 'high' ELSE 'critical' END AS level FROM part")
def risk_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scoring.risk(F.col("p_size") % 5 + 1, F.col("p_partkey") % 5 + 1).alias("r")).select("p_partkey", "r.product", "r.level")


@register(
    "indicator_kind",
    """WITH i AS (SELECT DISTINCT dns_query AS indicator FROM ev WHERE dns_query IS NOT NULL UNION SELECT file_hash FROM ev WHERE file_hash IS NOT NULL UNION SELECT src_ip FROM ev WHERE src_ip IS NOT NULL UNION SELECT dst_ip FROM ev WHERE dst_ip IS NOT NULL),
k AS (SELECT indicator, CASE WHEN regexp_full_match(indicator, '[0-9.]+') THEN 'ip' WHEN regexp_full_match(indicator, '[0-9a-f]{32}') THEN 'hash' ELSE 'domain' END AS kind FROM i)
SELECT indicator, kind, kind = 'hash' OR (kind = 'domain' AND NOT regexp_matches(indicator, '\\.(local|localdomain|lan|internal|intranet|corp|home|test|example|invalid|localhost)$')) OR (kind = 'ip' AND NOT regexp_matches(indicator, '^(10\\.|203\\.0\\.113\\.)')) AS public FROM k""",
    ("pcap", "scan", "web"),
)
def indicator_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = telemetry(spark, sf_dir, ("pcap", "scan", "web"))
    values = ev.select(F.explode(F.array("dns_query", "file_hash", "src_ip", "dst_ip")).alias("indicator")).filter("indicator is not null").distinct()
    return values.select("indicator", scoring.indicator_kind(F.col("indicator")).alias("kind"), scoring.is_public(F.col("indicator")).alias("public"))


@register("access_log_parse", "SELECT o_orderkey AS id, '10.0.0.' || (o_custkey % 250) AS src_ip, strftime(make_timestamp((1704067200 + o_orderkey) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts, '/p/' || o_orderstatus AS url, CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 302 ELSE 404 END AS http_status, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'success' ELSE 'failure' END AS outcome FROM orders")
def access_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = "case o_orderstatus when 'F' then 200 when 'O' then 302 else 404 end"
    line = F.expr(f"""concat('10.0.0.', o_custkey % 250, ' - - [', date_format(timestamp_seconds(1704067200 + o_orderkey + 7200), 'dd/MMM/yyyy:HH:mm:ss'), ' +0200] "GET /p/', o_orderstatus, ' HTTP/1.1" ', {status}, ' 12')""")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), line.alias("line"))
    f = readers.parse_access(F.col("line"))
    return rows.select("id", *[f[c].alias(c) for c in ("src_ip", "ts", "url", "http_status", "outcome")])


@register("syslog_parse", "SELECT event_id AS id, 'gw' || (user_id % 5) AS host, CASE WHEN event_type = 'error' THEN 'user' || user_id END AS user_name, '10.1.0.' || (user_id % 250) AS src_ip, CASE WHEN event_type = 'error' THEN 'failure' END AS outcome FROM events")
def syslog_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("""concat('2024-01-01T00:00:00Z x@gw', user_id % 5, ' auth.info ', if(event_type = 'error', concat('sshd[7]: Failed password for user', user_id, ' from 10.1.0.', user_id % 250, ' port 5 ssh2'), concat('kernel: IN=e SRC=10.1.0.', user_id % 250, ' DST=9.9.9.9 PROTO=TCP DPT=22')))""")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), line.alias("line"))
    f = readers.parse_syslog(F.col("line"))
    return rows.select("id", *[f[c].alias(c) for c in ("host", "user_name", "src_ip", "outcome")])


@register(
    "compliance_obligations",
    """SELECT o_orderkey, norm, duty, deadline_hours FROM (SELECT o_orderkey, o_orderstatus = 'F' AS pd, o_orderpriority LIKE '1%' AS hi, o_orderstatus <> 'P' AS sig, o_orderkey % 3 = 0 AS sec FROM orders)
JOIN (VALUES ('GDPR', 'notify the supervisory authority', 72, 1), ('GDPR', 'tell the persons concerned', NULL, 2), ('NIS2', 'early warning', 24, 3), ('NIS2', 'incident notification', 72, 3)) r(norm, duty, deadline_hours, k) ON (k = 1 AND pd) OR (k = 2 AND pd AND hi) OR (k = 3 AND sig AND sec)""",
)
def compliance_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidents = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus = 'F' as personal_data", "if(o_orderpriority like '1%', 'high', 'low') as risk", "o_orderstatus <> 'P' as significant", "if(o_orderkey % 3 = 0, 'energy', 'other') as sector")
    return scoring.obligations(incidents, scoring.RULES).select("o_orderkey", "norm", "duty", "deadline_hours")


@register("detection_rules", "SELECT id FROM ev WHERE (parent_name LIKE 'err%' OR parent_name LIKE '%up.exe') AND process_name LIKE '%1%' AND user_canon = 'user7'", EVTX)
def detection_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = scoring.detection([{"parent_name|re": ["^err", "up\\.exe$"], "process_name|contains": "1"}, {"user_canon": "USER7"}])
    return telemetry(spark, sf_dir, EVTX).filter(rule).select("id")


_FIRST = (0x2001, 0xFE80, 0xFF02, 0xFC00, 0xFEC0, 0x2A00, 0x64, 0, 0x2002, 0x3FFF, 0x4000)


def _address_sql(which: str) -> str:
    """A test of (hi, lo) over all ranges, written from numbers and not from text."""
    test = {"generic": addresses.is_generic, "public": addresses.is_public}[which]
    six = " OR ".join(f"(hi, lo) >= ({int(a[:16], 16)}, {int(a[16:], 16)}) AND (hi, lo) <= ({int(b[:16], 16)}, {int(b[16:], 16)})" for a, b in addresses.ranges(test, 6))
    four = " OR ".join(f"lo & 4294967295 BETWEEN {int(a, 16)} AND {int(b, 16)}" for a, b in addresses.ranges(test, 4))
    return f"CASE WHEN hi = 0 AND lo >> 32 = 65535 THEN {four} ELSE {six} END"


@register(
    "address_ranges",
    f"""WITH g AS (SELECT o_orderkey AS k, ([{", ".join(map(str, _FIRST))}])[o_orderkey % {len(_FIRST)} + 1]::UBIGINT AS a, (CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 5 = 0 THEN 3512 ELSE o_custkey % 65536 END)::UBIGINT AS b, (CASE WHEN o_orderkey % 2 = 0 THEN 65535 ELSE 0 END)::UBIGINT AS f, (o_custkey * 7 % 65536)::UBIGINT AS c, (o_orderkey % 65536)::UBIGINT AS d FROM orders),
n AS (SELECT k, (a << 48) | (b << 32) AS hi, (f << 32) | (c << 16) | d AS lo FROM g)
SELECT k, hi::DECIMAL(20,0) AS hi, lo::DECIMAL(20,0) AS lo, {_address_sql("generic")} AS generic, {_address_sql("public")} AS public FROM n""",
)
def address_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv6 addresses in three spellings: numbers, and whether they are generic and public."""
    k, m = F.col("o_orderkey"), F.col("o_custkey")
    group = lambda c: F.lower(F.hex(c))
    first = F.element_at(F.array(*map(F.lit, _FIRST)), (k % len(_FIRST) + 1).cast("int"))
    b = F.when(k % 3 == 0, 0).when(k % 5 == 0, 3512).otherwise(m % 65536)
    f, c, d = F.when(k % 2 == 0, 65535).otherwise(0), m * 7 % 65536, k % 65536
    byte = lambda x, n: (F.floor(x / n) % 256).cast("string")
    quad = F.concat_ws(".", byte(c, 256), byte(c, 1), byte(d, 256), byte(d, 1))
    full = F.concat_ws(":", group(first), group(b), F.lit("0"), F.lit("0000"), F.lit("0"), group(f), group(c), group(d))
    short = F.concat(group(first), F.lit(":"), group(b), F.lit("::"), group(f), F.lit(":"), group(c), F.lit(":"), group(d))
    mixed = F.concat(F.upper(group(first)), F.lit(":"), group(b), F.lit("::"), F.upper(group(f)), F.lit(":"), quad)
    text = F.when(k % 4 == 0, full).when(k % 4 == 1, mixed).otherwise(short)
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), text.alias("t"))
    n = addresses.number(F.col("t"))
    return rows.select("k", n["hi"].alias("hi"), n["lo"].alias("lo"), addresses.generic(F.col("t")).alias("generic"), addresses.public(F.col("t")).alias("public"))


@register("extract_base64", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'utf-16' ELSE 'utf-8' END AS encoding, CASE WHEN o_orderkey % 3 = 0 THEN 'message' ELSE 'cmdline' END AS field, 'run ' || o_orderpriority || ' no ' || o_custkey AS decoded FROM orders WHERE o_orderkey % 5 <> 0")
def extract_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded commands in two fields; a fifth of them are bytes that are no text."""
    k = F.col("o_orderkey")
    plain = F.concat(F.lit("run "), F.col("o_orderpriority"), F.lit(" no "), F.col("o_custkey").cast("string"))
    raw = F.when(k % 5 == 0, F.unhex(F.lit("00FF01FE02FD03FC04FB05FA"))).when(k % 2 == 0, F.encode(plain, "UTF-16LE")).otherwise(plain.cast("binary"))
    text = F.concat(F.lit("powershell -enc "), F.base64(raw), F.lit(" shortAA== plainword"))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 != 0, text).alias("cmdline"), F.when(k % 3 == 0, text).otherwise("nothing").alias("message"))
    return extras.extract_base64(rows).select("id", "encoding", "field", "decoded")


@register("redact_table", "SELECT o_orderkey AS k, CASE WHEN o_custkey % 3 = 0 THEN 'by U' || o_custkey || ' at H1' WHEN o_custkey % 3 = 1 THEN 'by P' || o_custkey || ' at H1' ELSE 'by q' || o_custkey || ' at H1' END AS note, ['H1', 'x'] AS tags FROM orders")
def redact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers, some of them parts of others, replaced in texts and lists."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(c % 3 == 0, F.concat(F.lit("user-"), c.cast("string"))).when(c % 3 == 1, F.concat(F.lit("User-"), c.cast("string"), F.lit(".ADM"))).otherwise(F.concat(F.lit("q"), c.cast("string")))
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("by "), name, F.lit(" at WS.1")).alias("note"), F.array(F.lit("ws.1"), F.lit("x")).alias("tags"))
    own = table(spark, sf_dir, "orders").select(c.alias("c")).distinct()
    names = own.select(F.inline(F.array(F.struct(F.concat(F.lit("USER-"), F.col("c").cast("string")).alias("real"), F.concat(F.lit("U"), F.col("c").cast("string")).alias("pseudonym")), F.struct(F.concat(F.lit("user-"), F.col("c").cast("string"), F.lit(".adm")).alias("real"), F.concat(F.lit("P"), F.col("c").cast("string")).alias("pseudonym")))))
    return redaction.redact(rows, names.unionByName(spark.createDataFrame([("ws.1", "H1"), (" ", "z")], "real string, pseudonym string")))


#: Rules of the shapes that are shipped with the detections, and nested ones.
_SIGMA = [
    {"title": "one selection", "level": "medium", "tags": ["attack.t1059.001"], "detection": {"selection": {"ParentImage|endswith": ["up.exe", "ick.exe"], "Image|contains": ["1", "7"]}, "condition": "selection"}},
    {"title": "two selections", "level": "low", "detection": {"selection": {"EventID": [4624, 4720]}, "users": {"user_canon|contains": ["r1", "r22"]}, "condition": "selection and users"}},
    {"title": "nested", "level": "high", "tags": ["attack.t1110", "attack.t1078"], "detection": {"sel_a": {"user_canon|endswith": "7"}, "sel_b": {"Image|re": "[13]"}, "filter_x": {"ParentImage|startswith": "err"}, "filter_y": [{"EventID": 4625}, {"EventID": 1102}], "condition": "all of sel_* and not (filter_x or 1 of filter_y) or (filter_x and not sel_b)"}},
]


@register(
    "sigma_rules",
    """SELECT id, 'one selection' AS rule_title, 'medium' AS rule_level, 'T1059.001' AS techniques FROM ev WHERE (lower(parent_name) LIKE '%up.exe' OR lower(parent_name) LIKE '%ick.exe') AND (process_name LIKE '%1%' OR process_name LIKE '%7%')
  UNION ALL SELECT id, 'two selections', 'low', '' FROM ev WHERE event_code IN (4624, 4720) AND (user_canon LIKE '%r1%' OR user_canon LIKE '%r22%')
  UNION ALL SELECT id, 'nested', 'high', 'T1110,T1078' FROM (SELECT id, coalesce(user_canon LIKE '%7', false) AS a, coalesce(regexp_matches(process_name, '[13]'), false) AS b, coalesce(lower(parent_name) LIKE 'err%', false) AS x, coalesce(event_code IN (4625, 1102), false) AS y FROM ev) WHERE ((a AND b) AND NOT (x OR y)) OR (x AND NOT b)""",
    EVTX,
)
def sigma_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with conditions, all in one pass."""
    return sigma.matches(telemetry(spark, sf_dir, EVTX), _SIGMA, keep=["id"])


@register("decode_scan")
def decode_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decode.scan_fields(docs, ["text"]).select("doc_id", "encoder", "original", "decoded", "confidence", "notes")


@register(
    "slice_levels",
    "SELECT CASE p_size % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'low' ELSE 'informational' END AS level, count(*) AS detections FROM part GROUP BY 1",
)
def slice_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*[F.lit(x) for x in ("crit", "CRITICAL", "High", "medium", "Low", "odd", None)]), (F.col("p_size") % 7 + 1).cast("int"))
    return slices.by_level(table(spark, sf_dir, "part").select(level.alias("rule_level")))


@register(
    "slice_tactics",
    "WITH t AS (SELECT trim(unnest(string_split(techniques, ','))) AS technique, CASE WHEN user_canon LIKE '%0' AND length(user_canon) % 2 = 0 THEN 'execution,impact' ELSE '(tactic not indicated)' END AS declared FROM ev WHERE techniques IS NOT NULL), p AS (SELECT DISTINCT unnest(string_split(declared, ',')) AS tactic, technique FROM t) SELECT tactic, string_agg(technique, ', ' ORDER BY technique) AS techniques FROM p GROUP BY 1",
    EVTX,
)
def slice_tactics(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = F.when(F.col("user_canon").like("%0") & (F.length("user_canon") % 2 == 0), "execution,impact")
    return slices.by_tactic(telemetry(spark, sf_dir, EVTX).withColumn("tactics_declared", declared))


# Part rows as file records: a folder by p_size, an extension by p_partkey, every eleventh a directory.
_FOLDERS = ("Users/ann/AppData/Local/Temp", "Windows/Temp", "ProgramData/x", "Windows/Tasks", "Users/Public/y", "$Recycle.Bin/S-1", "Windows/System32", "Users/ann/AppData/Roaming", "PerfLogs", "Temp")
_EXTENSIONS = ("exe", "PS1", "psm1", "jse", "com", "txt", "sys", "docx", "vbe")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % len(values) + 1).cast("int"))
    folder = F.translate(pick(_FOLDERS, "p_size"), "/", chr(92))
    name = F.concat(F.lit("f."), pick(_EXTENSIONS, "p_partkey"))
    action = F.when(F.col("p_partkey") % 11 == 0, readers.DIRECTORY).otherwise("file-metadata")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), action.alias("action"), F.concat(F.lit("C:" + chr(92)), folder, F.lit(chr(92)), name).alias("file_path"), name.alias("file_name"))


@register("mft_suspicious", "SELECT p_partkey AS id FROM part WHERE p_size % 10 < 6 AND p_partkey % 11 <> 0")
def mft_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.suspicious_files(_files(spark, sf_dir)).select("id")


@register("mft_executables", "SELECT p_partkey AS id FROM part WHERE p_partkey % 9 IN (0, 1, 2, 3, 4, 8) AND p_partkey % 11 <> 0")
def mft_executables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.executable_files(_files(spark, sf_dir)).select("id")
