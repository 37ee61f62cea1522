"""Correlation views: what several sources say about the same time, host or indicator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions import attack
from loglattice.functions import normalize as n
from loglattice.operators.recipes import _order, count_rows
from loglattice.storage import stored

# Event types that matter without a rule.
NOTABLE_ACTIONS = ("audit-log-cleared", "event-log-cleared", "audit-policy-changed", "event-log-service-stopped", "sysmon-config-changed", "process-tampering", "raw-access-read", "service-installed", "scheduled-task-created", "scheduled-task-registered", "wmi-event-consumer", "wmi-event-filter", "wmi-consumer-filter-binding", "wmi-permanent-consumer-registered", "wmi-permanent-consumer-binding", "user-account-created", "member-added-to-local-group", "member-added-to-global-group", "member-added-to-universal-group", "password-reset", "create-remote-thread", "logon-failed", "kerberos-preauth-failed")
# Weight of a bridge by kind, and what is taken off.
KIND_WEIGHT = {"file_hash": "0.85", "user": "0.70", "host": "0.55", "domain": "0.40", "file": "0.25", "ip": "0.10"}
UNMAPPED_PHASE = "(technique not in ATT&CK map)"
UNMAPPED_NAME = "(not in ATT&CK map)"
def family_key() -> Column:
    return F.coalesce(F.col("family"), F.col("source"))


def joined(c: str | Column, sep: str = ", ") -> Column:
    """Distinct values in order as one string; null without any."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(c)), sep), F.lit(""))


def timeline_reason() -> Column:
    level = F.lower(F.coalesce("rule_level", F.lit("")))
    return (
        F.when(F.coalesce("attack_evidence", F.lit(False)), "ATT&CK technique")
        .when(level.isin("critical", "high"), F.concat(F.lit("Sigma "), level))
        .when(F.col("action").isin(*NOTABLE_ACTIONS), "high-signal event type")
        .when(F.col("source").startswith("thor") & (F.coalesce("action", F.lit("")) != "thor-linked"), "THOR finding")
        .when(F.lower("outcome") == "failure", "failed action")
    )


TIMELINE = ["id", "ts", "source", "category", "action", "event_code", "outcome", "host", "user_name", "process_name", "src_ip", "dst_ip", "dst_port", "dns_query", "techniques", "kc_phase", "rule_title", "rule_level"]


def timeline(events: DataFrame, host: str | None = None, user: str | None = None, ip: str | None = None, limit: int = 200, notable: bool = True) -> DataFrame:
    """The first events with a reason; where there are none, the first events as context."""
    rows = events.withColumn("why", timeline_reason())
    for column, value in (("host", host), ("user_name", user)):
        rows = rows.filter(F.col(column) == value) if value is not None else rows
    if ip is not None:
        rows = rows.filter((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))
    cols = [c for c in TIMELINE if c in events.columns]
    told = rows.filter("why is not null")
    if notable and told.limit(1).count():
        chosen = told
    else:
        chosen = rows.withColumn("why", F.coalesce("why", F.lit("context")))
    return chosen.orderBy(F.col("ts_parsed").asc_nulls_last(), "id").limit(limit).select(*cols, "why")


def host_overview(events: DataFrame) -> DataFrame:
    by = events.filter("host_canon is not null").groupBy(F.col("host_canon").alias("host"))
    agg = by.agg(count_rows().alias("events"), F.count_distinct("user_canon").alias("users"), F.count_distinct("process_name").alias("processes"), F.count_distinct("dst_ip").alias("dst_ips"), F.count_if("attack_evidence").alias("attack_events"))
    return agg.orderBy(*_order("-attack_events", "-events", "host"))


def indicators(events: DataFrame) -> DataFrame:
    """(indicator, raw, kind, realm, family, origin): every indicator of every event, generic ones left out."""

    def one(value: str, raw: str, kind: str, realm: Column, skip: Column) -> Column:
        v = F.when(~F.coalesce(skip, F.lit(False)), F.col(value))
        return F.struct(v.alias("indicator"), F.col(raw).alias("raw"), F.lit(kind).alias("kind"), realm.alias("realm"))

    none = F.lit(None).cast("string")
    c = F.col
    never = F.lit(False)
    parts = [
        one("user_canon", "user_name", "user", c("user_domain"), c("user_generic")),
        one("host_canon", "host", "host", c("host_domain"), c("host_generic")),
        one("src_ip", "src_ip", "ip", none, c("src_ip_generic")),
        one("dst_ip", "dst_ip", "ip", none, c("dst_ip_generic")),
        one("dns_query", "dns_query", "domain", none, c("dns_generic")),
        one("file_hash", "file_hash", "file_hash", none, never),
        one("file_hash_md5", "file_hash_md5", "file_hash", none, never) if "file_hash_md5" in events.columns else None,
        one("file_canon", "file_name", "file", none, c("file_generic")),
    ]
    rows = events.select(family_key().alias("family"), F.col("source").alias("origin"), F.inline(F.array(*[p for p in parts if p is not None])))
    return rows.filter("indicator is not null")


def bridge_confidence(kind: Column, families: Column, match_type: Column, infrastructure: Column) -> tuple[Column, Column]:
    """Decimal confidence of a bridge and the arithmetic behind it in words."""
    d = "decimal(5,2)"
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast(d) if i % 2 else F.lit(x) for kv in KIND_WEIGHT.items() for i, x in enumerate(kv)]), kind), F.lit("0.25").cast(d))
    boost = F.least(F.greatest(families - 2, F.lit(0)) * F.lit("0.05").cast(d), F.lit("0.10").cast(d)).cast(d)
    off = (F.when(match_type == "ambiguous", F.lit("0.30")).when(match_type == "normalized", F.lit("0.05")).otherwise(F.lit("0.00"))).cast(d)
    infra = F.when(infrastructure, F.lit("0.30")).otherwise(F.lit("0.00")).cast(d)
    score = F.greatest(F.lit("0.00").cast(d), F.least(F.lit("1.00").cast(d), base + boost - off - infra)).cast("decimal(3,2)")
    why = F.concat_ws(
        " · ",
        F.format_string("%s bridge %s", kind, base.cast("string")),
        F.when(boost > 0, F.format_string("+%s for %s corroborating tools", boost.cast("string"), families.cast("string"))),
        F.when(match_type == "ambiguous", "-0.30 ambiguous (same name, different realms)").when(match_type == "normalized", "-0.05 spellings had to be normalized"),
        F.when(infrastructure, "-0.30 declared infrastructure"),
    )
    return score, why


def shared_indicators(events: DataFrame, infra_ips: tuple[str, ...] = ()) -> DataFrame:
    """Indicators that more than one tool family saw, most telling first."""
    # Equal spellings are folded before anything is shuffled by indicator.
    alike = indicators(events).groupBy("indicator", "kind", "family", "origin", "raw", "realm").agg(count_rows().alias("n"))
    agg = alike.groupBy("indicator", "kind").agg(
        F.collect_set("family").alias("seen"), F.sum("n").alias("occurrences"),
        joined("origin").alias("origins"), F.array_sort(F.collect_set("raw")).alias("raws"), F.array_sort(F.collect_set("realm")).alias("realms"),
    ).withColumns({"families": F.size("seen").cast("bigint"), "family_list": F.array_join(F.array_sort("seen"), ", ")}).filter("families > 1")
    infra = F.coalesce((F.col("kind") == "ip") & F.lower("indicator").isin(*[i.strip().lower() for i in infra_ips]), F.lit(False)) if infra_ips else F.lit(False)
    match = F.when(n.realms_conflict(F.col("realms")), "ambiguous").when(F.size("raws") > 1, "normalized").otherwise("exact")
    agg = agg.withColumn("match_type", match).withColumn("infrastructure", infra)
    score, why = bridge_confidence(F.col("kind"), F.col("families"), F.col("match_type"), F.col("infrastructure"))
    out = agg.withColumn("confidence", score).withColumn("confidence_why", why)
    label = F.when(F.col("confidence") >= 0.70, "high").when(F.col("confidence") >= 0.40, "medium").otherwise("low")
    out = out.select("indicator", "kind", "families", "family_list", "origins", F.array_join("raws", ", ").alias("variants"), F.nullif(F.array_join("realms", ", "), F.lit("")).alias("realm_list"), "occurrences", "match_type", "infrastructure", "confidence", label.alias("confidence_label"), "confidence_why")
    return out.orderBy(*_order("-confidence", "-families", "-occurrences", "kind", "indicator"))


def episode_ids(events: DataFrame, gap_seconds: int = 120, bucket_seconds: int = 600) -> DataFrame:
    """``events`` that have a time, with ``episode``: it rises by one after every gap of more than ``gap_seconds``.

    There is no sort of everything in one task: distinct times are windowed within buckets of time,
    and only a row per bucket (its end and number of gaps) is put in order over all.  However
    many events fall into one time, it is one row of the windows.
    """
    timed = events.filter("ts_parsed is not null").withColumn("us", F.unix_micros("ts_parsed"))
    times = timed.select("us").distinct().withColumn("bucket", F.expr(f"us div {bucket_seconds * 1_000_000}"))
    inside = Window.partitionBy("bucket").orderBy("us")
    jump = F.coalesce((F.col("us") - F.lag("us").over(inside)) > gap_seconds * 1_000_000, F.lit(False)).cast("int")
    marked = times.withColumn("jump", jump).withColumn("local", F.sum("jump").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = marked.groupBy("bucket").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.sum("jump").alias("jumps"))
    over = Window.orderBy("bucket")  # a row per bucket
    lead_in = F.coalesce((F.col("first_us") - F.lag("last_us").over(over)) > gap_seconds * 1_000_000, F.lit(False)).cast("int")
    placed = placed.withColumn("lead_in", lead_in)
    before = F.coalesce(F.sum("jumps").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("lead_in").over(over.rowsBetween(Window.unboundedPreceding, 0))
    at = marked.join(placed.select("bucket", before.alias("start")), "bucket").select("us", (F.col("start") + F.col("local")).cast("bigint").alias("episode"))
    return timed.join(at, "us").drop("us")


def episodes(events: DataFrame, gap_seconds: int = 120, min_sources: int = 2, limit: int = 100) -> DataFrame:
    # Events alike in all that is used are folded before times are joined, with their number.
    used = {"ts_parsed": F.col("ts_parsed"), "family": family_key(), "host": F.col("host"), "ip": F.coalesce("src_ip", "dst_ip"), "kc_phase": F.col("kc_phase")}
    # Stored, as it is used for the times and for what happened at them.
    alike = stored(events.select(*[c.alias(k) for k, c in used.items()]).groupBy(*used).agg(count_rows().alias("n")), "episodes")
    agg = episode_ids(alike, gap_seconds).groupBy("episode").agg(
        F.min("ts_parsed").alias("start"), F.max("ts_parsed").alias("end"), F.sum("n").alias("events"), F.count_distinct("family").alias("families"), joined("family").alias("family_list"),
        F.count_distinct("host").alias("hosts"), F.count_distinct("ip").alias("ips"), F.collect_set("kc_phase").alias("seen"),
    ).filter(F.col("families") >= min_sources)
    phases = F.filter(F.array(*map(F.lit, attack.PHASES)), lambda p: F.array_contains("seen", p))
    out = agg.select(n.iso(F.col("start")).alias("start_ts"), n.iso(F.col("end")).alias("end_ts"), "events", "families", "family_list", "hosts", "ips", F.array_join(phases, " → ").alias("phases"), "start")
    return out.orderBy("start").limit(limit).drop("start")


def killchain(events: DataFrame) -> DataFrame:
    agg = events.filter("kc_phase is not null").groupBy(F.col("kc_phase").alias("phase"), F.col("kc_order").alias("phase_order")).agg(
        count_rows().alias("events"), F.count_distinct("host_canon").alias("hosts"), F.count_distinct(family_key()).alias("sources"), F.min("ts_parsed").alias("first"), F.max("ts_parsed").alias("last"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tactic_list")))), ", ").alias("tactics"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("technique_ids")))), ", ").alias("technique_list"),
    )
    return agg.select("phase", "phase_order", "events", "hosts", "sources", n.iso(F.col("first")).alias("first_seen"), n.iso(F.col("last")).alias("last_seen"), "tactics", "technique_list").orderBy("phase_order")


def phase_corroboration(events: DataFrame, beacons: DataFrame | None = None, infra_ips: tuple[str, ...] = (), pad_seconds: int = 120, limit_families: int = 4) -> DataFrame:
    """What tools without ATT&CK evidence saw during each phase: (phase, family, ...) rows, most events first.

    The phases, seven at most, are broadcast and range-joined with the silent events; families
    that speak in the phase themselves are anti-joined away.
    """
    key = F.coalesce("family", "source", F.lit("(unnamed source)"))
    phased = events.filter("kc_phase is not null")
    span = phased.filter("ts_parsed is not null").groupBy("kc_phase").agg(F.min("ts_parsed").alias("lo"), F.max("ts_parsed").alias("hi"))
    # The reported ends are whole seconds, and the window is built on them.
    second = lambda c: F.unix_seconds(c)
    span = span.select(F.col("kc_phase").alias("phase"), second(F.col("lo")).alias("lo"), second(F.col("hi")).alias("hi"))
    speaking = phased.select(F.col("kc_phase").alias("phase"), key.alias("family")).distinct()
    at = F.unix_micros("ts_parsed")
    silent = events.filter("ts_parsed is not null and not coalesce(attack_evidence, false)").withColumn("family", key)
    near = silent.join(F.broadcast(span), (at >= (F.col("lo") - pad_seconds) * 1_000_000) & (at <= (F.col("hi") + pad_seconds) * 1_000_000))
    near = near.join(speaking, ["phase", "family"], "left_anti")
    told = lambda c, generic: F.when(~F.coalesce(F.col(generic), F.lit(False)), F.col(c))
    known = [i.strip().lower() for i in infra_ips]
    dst = told("dst_ip", "dst_ip_generic")
    dst = F.when(~F.lower(dst).isin(*known), dst) if known else dst
    # Events alike in all that is reported are one stored row with their number.
    used = {"phase": F.col("phase"), "family": F.col("family"), "lo": F.col("lo"), "hi": F.col("hi"), "failed": F.coalesce(F.lower("outcome") == "failure", F.lit(False)), "dst": dst, "domain": told("dns_query", "dns_generic"), "user": told("user_canon", "user_generic")}
    alike = stored(near.select(*[c.alias(k) for k, c in used.items()]).groupBy(*used).agg(count_rows().alias("n")), "corroboration")
    agg = alike.groupBy("phase", "family").agg(F.sum("n").alias("events"), F.sum(F.when(F.col("failed"), F.col("n")).otherwise(0)).alias("failures"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    rank = F.row_number().over(Window.partitionBy("phase").orderBy(F.col("events").desc(), "family"))
    top = agg.withColumn("rank", rank).filter(F.col("rank") <= limit_families)
    # Distinct values are counted and two of each kind are kept: none of them is gathered in a set.
    values = alike.select("phase", "family", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("dst", "domain", "user")]))).filter("value is not null").distinct()
    flag = F.lit(False)
    if beacons is not None:
        values = values.join(beacons.select(F.lit("dst").alias("kind"), F.col("dst_ip").alias("value"), F.lit(True).alias("beacon")).distinct(), ["kind", "value"], "left")
        flag = F.coalesce("beacon", F.lit(False))
    values = values.withColumn("flag", flag)
    place = F.row_number().over(Window.partitionBy("phase", "family", "kind").orderBy(F.desc("flag"), "value"))
    first = values.withColumn("place", place).filter("place <= 2").groupBy("phase", "family", "kind").agg(F.array_sort(F.collect_list(F.struct("place", "value", "flag"))).alias("two"))
    number = values.groupBy("phase", "family", "kind").agg(count_rows().alias("number"))
    of = lambda k, c: F.first(F.when(F.col("kind") == k, F.col(c)), ignorenulls=True)
    wide = number.join(first, ["phase", "family", "kind"]).groupBy("phase", "family").agg(*[F.coalesce(of(k, "number"), F.lit(0)).cast("int").alias(f"n_{k}s") for k in ("dst", "domain", "user")], *[of(k, "two").alias(k) for k in ("dst", "domain", "user")])
    top = top.join(wide, ["phase", "family"], "left").fillna(0, ["n_dsts", "n_domains", "n_users"])
    words = lambda k: F.array_join(F.transform(k, lambda x: F.concat(x["value"], F.when(x["flag"], " (flagged as periodic call-backs — to validate)").otherwise(""))), ", ")
    note = F.concat_ws(
        ", ",
        F.format_string("%s event(s)", F.col("events").cast("string")),
        F.when(F.col("failures") > 0, F.format_string("%s failed", F.col("failures").cast("string"))),
        *[F.when(F.col(f"n_{k}s") > 0, F.concat(F.lit(word), words(k))) for k, word in (("dst", "to "), ("domain", "resolving "), ("user", "as "))],
    )
    return top.select("phase", "rank", "family", "events", "failures", "n_dsts", "n_domains", "n_users", F.concat("family", F.lit(": "), note).alias("note"), (F.col("hi") - F.col("lo") + 2 * pad_seconds).alias("window_s")).orderBy("phase", "rank")


def technique_catalog(events: DataFrame, limit: int = 100, exact: bool = False, techniques: dict | None = None) -> DataFrame:
    """Techniques with hits and where they were seen.

    Hosts and sources are the most over the technique lists an id occurs in, or with ``exact``
    the distinct ones over all of them.
    """
    rows = events.filter("size(technique_ids) > 0")
    if exact:
        per = rows.select("host_canon", family_key().alias("f"), "ts_parsed", "kc_order", F.explode("technique_ids").alias("technique")).groupBy("technique")
        agg = per.agg(count_rows().alias("hits"), F.count_distinct("host_canon").alias("hosts"), F.count_distinct("f").alias("sources"), F.min("ts_parsed").alias("first"), F.max("ts_parsed").alias("last"))
    else:
        lists = rows.groupBy("techniques", "technique_ids").agg(count_rows().alias("n"), F.count_distinct("host_canon").alias("h"), F.count_distinct(family_key()).alias("s"), F.min("ts_parsed").alias("lo"), F.max("ts_parsed").alias("hi"))
        agg = lists.withColumn("technique", F.explode("technique_ids")).groupBy("technique").agg(F.sum("n").alias("hits"), F.max("h").alias("hosts"), F.max("s").alias("sources"), F.min("lo").alias("first"), F.max("hi").alias("last"))
    tactics = attack.tactics_of(F.array("technique"), techniques)
    name = F.coalesce(attack.technique_name(F.col("technique"), techniques), F.lit(UNMAPPED_NAME))
    return agg.select("technique", name.alias("name"), F.array_join(tactics, ", ").alias("tactics"), F.coalesce(attack.phase_at(attack.deepest_order(tactics)), F.lit("")).alias("phase"), "hits", "hosts", "sources", n.iso(F.col("first")).alias("first_seen"), n.iso(F.col("last")).alias("last_seen")).orderBy(*_order("-hits", "technique")).limit(limit)


def host_killchain(events: DataFrame, limit: int = 50) -> DataFrame:
    """Hosts with ATT&CK evidence, the deepest in the chain first."""
    told = F.coalesce("attack_evidence", F.lit(False))
    when = F.when(told, F.col("ts_parsed"))
    agg = events.filter("host_canon is not null").groupBy(F.col("host_canon").alias("host")).agg(F.max("kc_order").alias("max_order"), F.count_if(told).alias("attack_events"), F.count_distinct("kc_phase").alias("phases_covered"), F.collect_set("kc_phase").alias("seen"), F.min(when).alias("first"), F.max(when).alias("last")).filter("attack_events > 0")
    phases = F.filter(F.array(*map(F.lit, attack.PHASES)), lambda p: F.array_contains("seen", p))
    deepest = F.coalesce(F.try_element_at(phases, F.lit(-1)), F.lit(UNMAPPED_PHASE))
    out = agg.select("host", "max_order", "attack_events", "phases_covered", F.array_join(phases, " → ").alias("phases"), deepest.alias("deepest_phase"), n.iso(F.col("first")).alias("first_seen"), n.iso(F.col("last")).alias("last_seen"))
    return out.orderBy(*_order("-max_order", "-phases_covered", "-attack_events", "host")).limit(limit)
