"""Derived columns of events: one staged projection over the raw schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.functions import attack
from loglattice.functions import normalize as n


def derive(raw: DataFrame, techniques: dict | None = None) -> DataFrame:
    """Raw events with ts_parsed, family, canonical and generic columns and ATT&CK annotation.

    All are plain expressions, so a query computes only those it uses.
    """
    col = F.col
    has = set(raw.columns)
    declared = F.split(F.lower(F.coalesce(col("tactics_declared"), F.lit(""))), r"\s*[,|;]\s*") if "tactics_declared" in has else F.array().cast("array<string>")
    file_hash = F.coalesce(n.canon_hash(col("file_hash")), n.canon_hash(col("file_hash_sha256"))) if "file_hash_sha256" in has else n.canon_hash(col("file_hash"))
    out = raw.withColumns({
        "ts_parsed": n.parse_ts(col("ts")),
        "family": n.source_family(col("source")),
        "user_canon": n.canon_user(col("user_name")),
        "user_domain": n.user_domain(col("user_name")),
        "user_generic": n.is_generic_user(col("user_name")),
        "host_canon": n.canon_host(col("host")),
        "host_domain": n.host_domain(col("host")),
        "host_generic": n.is_generic_host(col("host")),
        "file_canon": n.canon_file(col("file_name")),
        "file_generic": n.is_generic_file(col("file_name")),
        "src_ip_generic": n.is_generic_ip(col("src_ip")),
        "dst_ip_generic": n.is_generic_ip(col("dst_ip")),
        "dns_query": n.canon_domain(col("dns_query")),
        "dns_generic": n.is_generic_domain(col("dns_query")),
        "file_hash": file_hash,
        "technique_ids": attack.split_techniques(col("techniques")),
    })
    out = out.withColumn("tactic_list", F.array_distinct(F.concat(F.filter(declared, lambda t: t != ""), attack.tactics_of(col("technique_ids"), techniques))))
    out = out.withColumn("kc_order", attack.deepest_order(col("tactic_list")))
    return out.withColumns({
        "tactics": F.array_join("tactic_list", ","),
        "kc_phase": attack.phase_at(col("kc_order")),
        "attack_evidence": (col("kc_order") > 0) | (F.size("technique_ids") > 0),
    })
