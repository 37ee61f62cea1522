"""All recipes and correlation views over one set of events, as lazy DataFrames by name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loglattice.operators import correlate, graph, recipes


def analyze(events: DataFrame, infra_ips: tuple[str, ...] = (), gap_seconds: int = 120, techniques: dict | None = None) -> dict[str, DataFrame]:
    """``techniques`` is the ATT&CK table that the events were derived with."""
    out = {name: recipe(events) for name, recipe in recipes.RECIPES.items()}
    out |= {
        "summary": recipes.summary(events),
        "timeline": correlate.timeline(events),
        "host_overview": correlate.host_overview(events),
        "shared_indicators": correlate.shared_indicators(events, infra_ips),
        "episodes": correlate.episodes(events, gap_seconds),
        "killchain": correlate.killchain(events),
        "technique_catalog": correlate.technique_catalog(events, techniques=techniques),
        "host_killchain": correlate.host_killchain(events),
        "incident_clusters": graph.incident_clusters(events, infra_ips),
    }
    out["phase_corroboration"] = correlate.phase_corroboration(events, out["beaconing"], infra_ips)
    out["graph_nodes"], out["graph_edges"] = graph.entity_graph(events, infra_ips)
    return out
