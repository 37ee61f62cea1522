"""A slice of detections as a report: levels, techniques by tactic, and what has no mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions import normalize as n
from loglattice.operators.recipes import _order, count_rows

# How a level's name begins, gravest first, and its full name.
LEVELS = (("crit", "critical"), ("high", "high"), ("med", "medium"), ("low", "low"), ("info", "informational"))
NO_TACTIC = "(tactic not indicated)"  # fixed value


def level_name(c: Column) -> Column:
    """The full name of a level that is spelled out or abbreviated; anything else is informational."""
    v = F.lower(F.coalesce(n.blank_to_null(c), F.lit("info")))
    out = F.lit("informational")
    for start, name in reversed(LEVELS):
        out = F.when(v.startswith(start), name).otherwise(out)
    return out


def by_level(detections: DataFrame) -> DataFrame:
    """(level, detections), gravest first."""
    rank = F.array_position(F.array(*[F.lit(name) for _, name in LEVELS]), F.col("level"))
    return detections.groupBy(level_name(F.col("rule_level")).alias("level")).agg(count_rows().alias("detections")).orderBy(rank)


def by_tactic(detections: DataFrame) -> DataFrame:
    """(tactic, techniques): every technique under each tactic that its detections declare."""
    mapped = detections.filter("size(technique_ids) > 0").select("technique_ids", F.filter(F.split(F.coalesce("tactics_declared", F.lit("")), ","), lambda t: t != "").alias("declared"))
    tactics = F.when(F.size("declared") > 0, F.col("declared")).otherwise(F.array(F.lit(NO_TACTIC)))
    pairs = mapped.select(F.explode(tactics).alias("tactic"), "technique_ids").distinct().select("tactic", F.explode("technique_ids").alias("technique")).distinct()
    return pairs.groupBy("tactic").agg(F.array_join(F.array_sort(F.collect_list("technique")), ", ").alias("techniques")).orderBy("tactic")


def slice_report(detections: DataFrame, name: str, scanned_at: str, rows: int = 1_000) -> str:
    """The report as Markdown; the timeline shows the first ``rows`` detections and says how many more there are."""
    levels, tactics = by_level(detections).collect(), by_tactic(detections).collect()
    hosts = [r.host for r in detections.filter("host is not null").select("host").distinct().orderBy("host").collect()]
    total, unmapped = detections.agg(F.count(F.lit(1)), F.count_if(F.size("technique_ids") == 0)).first()
    process = F.coalesce(n.blank_to_null(F.col("process_name")), F.col("cmdline") if "cmdline" in detections.columns else F.lit(None), F.lit(""))
    shown = F.when(F.length(process) > 48, F.concat(F.substring(process, 1, 45), F.lit("…"))).otherwise(process)
    first = detections.select("ts", level_name(F.col("rule_level")).alias("level"), F.coalesce("rule_title", F.lit("")).alias("rule"), F.array_join("technique_ids", ", ").alias("technique"), "event_code", shown.alias("process")).orderBy(*_order("ts", "rule", "process")).limit(rows).collect()
    cell = lambda v: str("" if v is None else v).replace("|", "/").replace("\n", " ")
    out = [f"# Detections and ATT&CK: {name}", "", f"Source: `{name}`. Hosts: {', '.join(hosts) or 'none'}. Scanned: {scanned_at}.", f"Detections: {total}" + "".join(f" · {r.level}: {r.detections}" for r in levels), "", "## Techniques by tactic", ""]
    out += [f"- **{r.tactic}**: {r.techniques}" for r in tactics] or ["No technique is mapped."]
    if unmapped:
        out += ["", f"{unmapped} detections have no technique."]
    out += ["", "## Timeline", "", "| time (UTC) | level | rule | technique | event | process |", "|-|-|-|-|-|-|"]
    out += ["| " + " | ".join(map(cell, r)) + " |" for r in first]
    if total > len(first):
        out += ["", f"{total - len(first)} more"]
    return "\n".join([*out, ""])
