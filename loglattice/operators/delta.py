"""What is new: set differences of two event sets, and differences of two analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions import attack


def _dimensions(events: DataFrame) -> dict[str, DataFrame]:
    def values(c: str) -> DataFrame:
        return events.filter(F.col(c).isNotNull()).select(F.col(c).alias("value"))

    pair = events.filter("parent_name is not null and process_name is not null").select(F.concat("parent_name", F.lit(" → "), "process_name").alias("value"))
    technique = events.select(F.explode(attack.split_techniques(F.col("techniques"))).alias("value"))
    return {"process": values("process_name"), "dst_ip": values("dst_ip"), "dns": values("dns_query"), "technique": technique, "parent_child": pair}


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(dimension, value) that occur after and not before."""
    old, new = _dimensions(before), _dimensions(after)
    parts = [new[k].subtract(old[k]).select(F.lit(k).alias("dimension"), "value") for k in new]
    return reduce(DataFrame.unionByName, parts)


def bridge_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Bridges that are new, or that more families see than before: (indicator, kind, change, families, families_before)."""
    old = before.select("indicator", "kind", F.col("families").alias("families_before"))
    new = after.select("indicator", "kind", "families").join(old, ["indicator", "kind"], "left")
    change = F.when(F.col("families_before").isNull(), "new").when(F.col("families") > F.col("families_before"), "strengthened")
    return new.withColumn("change", change).filter("change is not null").select("indicator", "kind", "change", "families", "families_before")


def delta(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Differences of two analyses, given as the result tables of ``analyze``."""

    def scalar(tables: dict[str, DataFrame], name: str, c: Column) -> DataFrame:
        return tables[name].agg(c.alias("n"))

    depth = scalar(before, "killchain", F.coalesce(F.max("phase_order"), F.lit(0))).withColumnRenamed("n", "depth_before").crossJoin(scalar(after, "killchain", F.coalesce(F.max("phase_order"), F.lit(0))).withColumnRenamed("n", "depth_after"))  # two single rows
    count = F.count(F.lit(1))
    ents = F.coalesce(F.sum("entities"), F.lit(0))
    was, now = (d["incident_clusters"].agg(count.alias(f"clusters_{k}"), ents.alias(f"entities_{k}")) for d, k in ((before, "before"), (after, "after")))
    merged = was.crossJoin(now).withColumn("merged", (F.col("clusters_after") < F.col("clusters_before")) & (F.col("entities_after") > F.col("entities_before")))
    return {
        "bridges": bridge_delta(before["shared_indicators"], after["shared_indicators"]),
        "techniques": after["technique_catalog"].select("technique").subtract(before["technique_catalog"].select("technique")),
        "episodes": after["episodes"].join(before["episodes"].select("start_ts"), "start_ts", "left_anti"),
        "depth": depth,
        "clusters": merged,
    }


def headline(delta_rows: dict[str, list], first_analysis: bool = False) -> str:
    """One sentence on a collected delta."""
    if first_analysis:
        return "First analysis of this case."
    parts = []
    new = sum(r["change"] == "new" for r in delta_rows.get("bridges", []))
    more = len(delta_rows.get("bridges", [])) - new
    for n, what in ((new, "new bridge"), (more, "strengthened bridge"), (len(delta_rows.get("techniques", [])), "new technique"), (len(delta_rows.get("episodes", [])), "new episode")):
        if n:
            parts.append(f"{n} {what}{'s' if n > 1 else ''}")
    for r in delta_rows.get("depth", []):
        if r["depth_after"] > r["depth_before"]:
            parts.append(f"kill chain now reaches {attack.PHASES[r['depth_after'] - 1]}")
    return "; ".join(parts) + "." if parts else "Nothing new."
