"""Entities that events have in common: nodes, edges and incident clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglattice.functions import attack
from loglattice.operators.correlate import UNMAPPED_PHASE, family_key
from loglattice.operators.recipes import _order, count_rows
from loglattice.storage import stored

ROUNDS = 60
SHOWN = 8


# The entities of an event in order: kind, column, and the column that marks it as generic.
ENTITIES = (
    ("user", "user_canon", "user_generic"), ("host", "host_canon", "host_generic"), ("ip", "src_ip", "src_ip_generic"), ("ip", "dst_ip", "dst_ip_generic"),
    ("domain", "dns_query", "dns_generic"), ("file_hash", "file_hash", None), ("file", "file_canon", "file_generic"),
)


def _values(infra_ips: tuple[str, ...]) -> list[tuple[str, Column]]:
    """(kind, value) per place; the value is null where it is generic, declared infrastructure, or not there."""
    known = [i.strip().lower() for i in infra_ips]
    out = []
    for kind, value, generic in ENTITIES:
        use = F.col(value).isNotNull()
        if generic:
            use &= ~F.coalesce(F.col(generic), F.lit(False))
        if kind == "ip" and known:
            use &= ~F.lower(F.col(value)).isin(*known)
        out.append((kind, F.when(use, F.col(value))))
    return out


def entities(infra_ips: tuple[str, ...] = ()) -> Column:
    """The entities of an event as an array of (kind, value), generic and infrastructure ones left out."""
    listed = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k, v in _values(infra_ips)])
    return F.filter(listed, lambda x: x.isNotNull())


def _placed(events: DataFrame, infra_ips: tuple[str, ...], *more: Column) -> tuple[DataFrame, list[str]]:
    """``more`` columns and one of the entity's value per place: plain columns, computed once a row in compiled code."""
    names = [f"e{i}" for i in range(len(ENTITIES))]
    return events.select(*more, *[v.alias(c) for c, (_, v) in zip(names, _values(infra_ips), strict=True)]), names


def _key(kind: str, c: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(c))


def _keyed(events: DataFrame, infra_ips: tuple[str, ...], *more: Column) -> DataFrame:
    """``more`` columns and ``keys``, the distinct entities of the event in order."""
    rows, names = _placed(events, infra_ips, *more)
    listed = F.array(*[_key(k, c) for c, (k, _, _) in zip(names, ENTITIES, strict=True)])
    return rows.withColumn("keys", F.array_except(listed, F.array(F.lit(None).cast("string")))).drop(*names)


def entity_nodes(events: DataFrame, infra_ips: tuple[str, ...] = (), dedupe: bool = False) -> DataFrame:
    """(kind, value, events, families, kc_order): an address that is source and destination of an
    event counts twice unless ``dedupe``."""
    rows, names = _placed(events, infra_ips, family_key().alias("family"), F.col("kc_order"))
    if dedupe:
        rows = rows.withColumn("e3", F.when(~F.col("e2").eqNullSafe(F.col("e3")), F.col("e3")))
    each = rows.select("family", "kc_order", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for c, (k, _, _) in zip(names, ENTITIES, strict=True)])))
    # Summed by family first: the second sum is over a few rows per entity.
    per = each.filter("value is not null").groupBy("kind", "value", "family").agg(count_rows().alias("n"), F.max("kc_order").alias("kc_order"))
    return per.groupBy("kind", "value").agg(F.sum("n").alias("events"), F.count("family").alias("families"), F.max("kc_order").alias("kc_order")).orderBy(*_order("-events", "kind", "value"))


def entity_edges(events: DataFrame, infra_ips: tuple[str, ...] = (), min_weight: int = 1) -> DataFrame:
    """(a, b, weight) of entities named by one event, a before b; pairs are made within the row, without a shuffle."""
    rows, names = _placed(events, infra_ips)
    keys = [_key(k, c) for c, (k, _, _) in zip(names, ENTITIES, strict=True)]
    # Events alike in all entities are one row with their number; pairs of kinds are fixed, so no array is walked.
    alike = rows.groupBy(*names).agg(count_rows().alias("n")).select("n", *[k.alias(c) for k, c in zip(keys, names, strict=True)])
    pairs = [F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), (F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y))).alias("both")) for i, x in enumerate(names) for y in names[i + 1 :]]
    found = alike.select("n", F.inline(F.array(*pairs))).filter("both")
    return found.groupBy("a", "b").agg(F.sum("n").alias("weight")).filter(F.col("weight") >= min_weight).orderBy(*_order("-weight", "a", "b"))


#: The lane of nodes without a place on the kill chain; it comes last.
NO_LANE = "not placed on the kill chain"


def entity_graph(events: DataFrame, infra_ips: tuple[str, ...] = (), limit_nodes: int = 40, min_weight: int = 1) -> tuple[DataFrame, DataFrame]:
    """The nodes of greatest weighted degree, and the edges among them that weigh ``min_weight`` or more.

    Nodes: (id, kind, value, events, families, family_list, phases, phase, kc_order, degree,
    total_nodes, truncated, lane, lane_order, lane_rank).  degree sums the weights of all of a node's
    edges, lighter ones included; total_nodes and truncated tell what was left out; a lane is the
    deepest phase of a node, and lane_rank its place there, by degree.  Events alike in all of this
    are folded into one stored table, from which nodes, degrees and edges are made.
    """
    rows, names = _placed(events, infra_ips, family_key().alias("family"), F.col("kc_phase"), F.col("kc_order"))
    alike = stored(rows.groupBy("family", "kc_phase", "kc_order", *names).agg(count_rows().alias("n")), "entity-graph")
    keys = [_key(k, c) for c, (k, _, _) in zip(names, ENTITIES, strict=True)]
    each = alike.select("family", "kc_phase", "kc_order", "n", F.explode(F.array(*keys)).alias("id")).filter("id is not null")
    told = F.col("kc_phase").isNotNull()
    per = each.groupBy("id", "family", "kc_phase").agg(F.sum("n").alias("n"), F.max(F.when(told, F.coalesce("kc_order", F.lit(0)))).alias("kc_order"))
    # Tools and phases are few, so their sets are.
    nodes = per.groupBy("id").agg(F.sum("n").alias("events"), F.array_sort(F.collect_set("family")).alias("seen_by"), F.collect_set("kc_phase").alias("seen"), F.coalesce(F.max("kc_order"), F.lit(0)).alias("kc_order"))
    keyed = alike.select("n", *[k.alias(c) for k, c in zip(keys, names, strict=True)])
    pairs = [F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), (F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y))).alias("both")) for i, x in enumerate(names) for y in names[i + 1 :]]
    edges = stored(keyed.select("n", F.inline(F.array(*pairs))).filter("both").groupBy("a", "b").agg(F.sum("n").alias("weight")), "entity-edges")
    degree = edges.select(F.col("a").alias("id"), "weight").unionAll(edges.select(F.col("b").alias("id"), "weight")).groupBy("id").agg(F.sum("weight").alias("degree"))
    phases = F.filter(F.array(*map(F.lit, attack.PHASES)), lambda p: F.array_contains("seen", p))
    whole = stored(nodes.join(degree, "id", "left").select("id", "events", F.size("seen_by").alias("families"), F.array_join("seen_by", ", ").alias("family_list"), F.array_join(phases, " → ").alias("phases"), F.coalesce(F.try_element_at(phases, F.lit(-1)), F.lit("")).alias("phase"), "kc_order", F.coalesce("degree", F.lit(0)).alias("degree")), "entity-nodes")
    total = whole.agg(count_rows().alias("total_nodes"))  # one row
    top = whole.orderBy(*_order("-degree", "-families", "-events", "id")).limit(limit_nodes)
    lane = F.when(F.col("phase") == "", NO_LANE).otherwise(F.col("phase"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, attack.PHASES)), F.col("phase")), F.lit(0)), F.lit(len(attack.PHASES) + 1))
    value = F.expr("substr(id, instr(id, ':') + 1)")
    top = top.crossJoin(F.broadcast(total)).select("id", F.substring_index("id", ":", 1).alias("kind"), value.alias("value"), *[c for c in whole.columns if c != "id"], "total_nodes", (F.col("total_nodes") > limit_nodes).alias("truncated"), lane.alias("lane"), place.cast("int").alias("lane_order"))
    top = top.withColumn("lane_rank", F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("degree"), "value", "id")))  # of the nodes that are shown
    kept = stored(top, "entity-top")
    ids = kept.select("id")
    inside = edges.filter(F.col("weight") >= min_weight).join(F.broadcast(ids.withColumnRenamed("id", "a")), "a", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "b")), "b", "left_semi")
    return kept.orderBy(*_order("-degree", "-families", "-events", "id")), inside.orderBy(*_order("-weight", "a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the components of the links (a, b): root is the component's least node.

    Names are numbered by a hash of 64 bits, so that rounds move numbers only.  Every round
    points each node at its least neighbour, follows that pointer once and merges nodes into what
    they point at.  Links inside a merged node vanish: the links shrink from round to round, and
    so does a hub's number of them.
    """
    named = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.xxhash64("node").alias("k"))
    links = stored(edges.filter("a != b").select(*_pair(F.xxhash64("a"), F.xxhash64("b"))).distinct())
    labels = None
    for _ in range(ROUNDS):
        if links.isEmpty():
            break
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy(F.col("a").alias("k")).agg(F.least(F.col("a"), F.min("b")).alias("up")))
        grand = parent.select(F.col("k").alias("up"), F.col("up").alias("top"))
        moved = stored(parent.join(grand, "up").select("k", F.col("top").alias("to")))
        if labels is None:
            labels = moved.select("k", F.col("to").alias("root"))
        else:
            step = moved.select(F.col("k").alias("root"), "to")
            labels = stored(labels.join(step, "root", "left").select("k", F.coalesce("to", "root").alias("root")))
        of = {c: moved.select(F.col("k").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")}
        inner = links.join(of["a"], "a").join(of["b"], "b").filter("a_to != b_to").select(*_pair(F.col("a_to"), F.col("b_to")))
        # What is pointed at may point on: that link stays.
        onward = moved.join(moved.select(F.col("k").alias("to"), F.col("to").alias("next")), "to").filter("next != to").select(*_pair(F.col("to"), F.col("next")))
        links = stored(inner.unionAll(onward).distinct())
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return named.select("node", F.col("node").alias("root"))
    rooted = named.join(labels, "k", "left").select("node", F.coalesce("root", "k").alias("r"))
    names = rooted.groupBy("r").agg(F.min("node").alias("root"))
    return stored(rooted.join(names, "r").select("node", "root"))


NODES = "node string, grp string"
MOVED = "grp string, root string"


def extend_components(nodes: DataFrame, moved: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components after some more links (a, b): the nodes that are new, and all groups that have been merged into others.

    State is ``nodes`` (node, grp), to which only rows are added, and ``moved`` (grp, root), a row per
    group that is no longer its own root.  Only the ends of the new links are looked up; what
    is joined to components is their roots, not their members.  ``current`` gives node and root,
    the same as ``components`` over all links so far.
    """
    edges = stored(edges.select("a", "b").distinct(), "components-batch")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct()
    found = ends.join(nodes, "node", "left").join(moved, "grp", "left")
    found = stored(found.select("node", F.col("grp").isNull().alias("new"), F.coalesce("root", "grp", "node").alias("root")), "components-ends")
    of = {c: found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")}
    links = stored(edges.join(of["a"], "a").join(of["b"], "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "components-links")
    joined = stored(components(links).select(F.col("node").alias("old"), F.col("root").alias("to")), "components-roots")
    added = found.filter("new").join(joined, F.col("root") == F.col("old")).select("node", F.col("to").alias("grp"))
    again = moved.join(joined, F.col("root") == F.col("old"), "left").select("grp", F.coalesce("to", "root").alias("root"))
    # A root that was no group yet is a new node, whose group is right from the start.
    merged = joined.filter("old != to").join(found.filter("not new").select(F.col("root").alias("old")).distinct(), "old", "left_semi").select(F.col("old").alias("grp"), F.col("to").alias("root"))
    return stored(added, "components-nodes"), stored(again.unionByName(merged), "components-moved")


def current(nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """(node, root) of the state of ``extend_components``."""
    return nodes.join(moved, "grp", "left").select("node", F.coalesce("root", "grp").alias("root"))


class Components:
    """The state of components in a folder of shared storage: a folder per batch for nodes and for merged groups."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.batches = 0

    def _read(self, what: str, schema: str, batches: range) -> DataFrame:
        paths = [f"{self.path}/{what}/{k:06d}" for k in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def state(self) -> tuple[DataFrame, DataFrame]:
        return self._read("nodes", NODES, range(self.batches)), self._read("moved", MOVED, range(self.batches)[-1:])

    def add(self, edges: DataFrame) -> None:
        """Take in the links (a, b) of a batch; entities without a partner are links to themselves."""
        added, moved = extend_components(*self.state(), edges)
        added.write.mode("overwrite").parquet(f"{self.path}/nodes/{self.batches:06d}")
        moved.write.mode("overwrite").parquet(f"{self.path}/moved/{self.batches:06d}")
        self.batches += 1

    def current(self) -> DataFrame:
        return current(*self.state())


def event_links(events: DataFrame, infra_ips: tuple[str, ...] = ()) -> DataFrame:
    """(a, b): each event's first entity and each of its entities."""
    rows = _keyed(events, infra_ips).filter("size(keys) > 0").distinct()
    return rows.select(F.col("keys")[0].alias("a"), F.explode("keys").alias("b")).distinct()


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def incident_clusters(events: DataFrame, infra_ips: tuple[str, ...] = (), min_families: int = 2, min_entities: int = 2, limit: int = 50, roots: DataFrame | None = None) -> DataFrame:
    """Entities joined by the events that name them together, deepest in the kill chain first.

    ``roots`` (node, root) may be given where components are kept up to date (``Components``).

    Each event links its first entity to its others; distinct links are joined to components.
    users, hosts and ips list the first few of them; hashes, files and domains are numbers.
    """
    used = ["family", "kc_order", "kc_phase", "attack_evidence", "tactic_list"]
    # Derived once; of events alike in all that is used one row is kept.
    rows = stored(_keyed(events, infra_ips, family_key().alias("family"), *map(F.col, used[1:])).filter("size(keys) > 0").distinct())
    if roots is None:
        roots = components(rows.select(F.col("keys")[0].alias("a"), F.explode("keys").alias("b")).distinct())
    # Distinct by first entity before the join, so that a hub is a few rows.
    member = rows.select(F.col("keys")[0].alias("node"), *used).distinct().join(roots, "node")
    facts = member.groupBy("root").agg(
        F.count_distinct("family").alias("sources"), F.array_join(F.array_sort(F.collect_set("family")), ", ").alias("source_list"), F.max("kc_order").alias("kc_depth"),
        F.max(F.coalesce("attack_evidence", F.lit(False))).alias("evidence"), F.collect_set("kc_phase").alias("seen"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tactic_list")))), ", ").alias("tactics"),
    ).filter(F.col("sources") >= min_families)
    kinds = roots.select("root", F.substring_index("node", ":", 1).alias("kind"), F.expr("substr(node, instr(node, ':') + 1)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("root", "kind").orderBy("value"))
    per_kind = kinds.groupBy("root", "kind").agg(count_rows().alias("n"))
    # The first few of each kind are listed; ranking has map-side limits, so a large cluster isn't gathered.
    first = kinds.withColumn("k", rank).filter(F.col("k") <= SHOWN).groupBy("root", "kind").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("list"))
    of_kind = lambda k, c, default: F.coalesce(F.max(F.when(F.col("kind") == k, F.col(c))), F.lit(default))
    wide = per_kind.join(first, ["root", "kind"]).groupBy("root").agg(
        F.sum("n").alias("entities"), *[of_kind(k, "list", "").alias(name) for k, name in (("user", "users"), ("host", "hosts"), ("ip", "ips"))],
        *[of_kind(k, "n", 0).alias(name) for k, name in (("file_hash", "hashes"), ("file", "files"), ("domain", "domains"))],
    )
    ordered = F.filter(F.array(*map(F.lit, attack.PHASES)), lambda p: F.array_contains("seen", p))
    deepest = F.coalesce(F.try_element_at(ordered, F.lit(-1)), F.when(F.col("evidence"), UNMAPPED_PHASE).otherwise(""))
    out = facts.join(wide, "root").filter(F.col("entities") >= min_entities).withColumns({"kc_phases": F.array_join(ordered, " → "), "deepest_phase": deepest})
    return out.drop("seen", "evidence", "root").orderBy(*_order("-kc_depth", "-sources", "-entities", "hosts", "users", "ips")).limit(limit)
