"""Near-duplicate classes with ProbMinHash.

1. Every text becomes a weighted set of five-word shingles (weight: how often it occurs).
   Texts with equal word sequences are one *node*; only nodes are compared.
2. ProbMinHash: each shingle sends a Poisson process of arrivals, at a rate of its weight, to
   random registers; a register keeps the shingle that arrives first.  A shingle stops once
   its next arrival comes later than every register's first.  Two texts agree in a register
   with the probability Jaccard similarity of their weighted sets.
3. Banding: registers are grouped into bands; nodes that agree in a whole band are candidates.
4. Verification computes the probability Jaccard similarity of candidates exactly.
5. Linked nodes are joined to classes; a class is named by the least id of its rows.

A band bucket may hold any number of nodes, so pairs are not listed within it.

* First every node is verified against one node, the *hub*, of its largest bucket, which gives one
  pair a node at most.
* Then one node of each class in each bucket is verified against the bucket's hub, unless they are
  of one class by now; this is done again while it joins classes.
* Where a bucket still holds several classes, every node outside the largest one is verified
  against that class's most central node: one pair a node and class again.
* At last the nodes outside that largest class are verified against nodes of other classes in
  their bucket, except where a bound rules the similarity out: each node carries the weight of the
  shingles that no other node has, and a bitmap of its shingles; a bit that one has and the other
  has not is a shingle that is not shared.  The bound is part of the join, so excluded pairs are
  not rows of it.

At the end each two nodes of a bucket are in one class, or have been compared, or cannot be
similar: no link that banding offers is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm import textkit as tk
from loglattice.llm.textkit import U64

THRESHOLD = 0.8
BANDS, ROWS = 32, 8
MAX_ROUNDS = 60
#: After how many rounds the joins that lead to a node's root are written.
ROUNDS_A_TABLE = 4
#: Bits of a node's bitmap of shingles.
BITS = 2048
_A = tk.mix((np.arange(64, dtype=U64) + U64(7001)) * U64(0x9E3779B97F4A7C15)) | U64(1)
_ID_BITS = U64(10)


def weighted_shingles(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (54-bit), their counts, row offsets; and a 128-bit digest of each row's words.

    A row without words has the digest of its bytes and no shingle.  At most 1024 rows.
    """
    words, w_off = tk.word_hashes(buf, off)
    sh, s_off = tk.shingle_hashes(words, w_off)
    n = len(off) - 1
    row = np.repeat(np.arange(n, dtype=U64), np.diff(s_off))
    key = np.sort((row << U64(54)) | (sh >> _ID_BITS))
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    bounds = np.searchsorted(key, np.arange(n + 1, dtype=U64) << U64(54)) if n < 1024 else np.append(np.searchsorted(key, np.arange(n, dtype=U64) << U64(54)), len(key))

    # The words in order, as two polynomials over their hashes.
    digest = np.empty((n, 2), dtype=U64)
    raw = tk.run_hashes(buf, off[:-1], off[1:])
    empty = np.diff(w_off) == 0
    for k, salt in enumerate((U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F))):
        mixed = tk.mix(words ^ salt)
        place = (np.arange(len(words)) - np.repeat(w_off[:-1], np.diff(w_off))).astype(U64)
        total = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(tk.mix(mixed + place * (salt | U64(1))))])
        digest[:, k] = tk.mix((total[w_off[1:]] - total[w_off[:-1]]) ^ np.diff(w_off).astype(U64))
        digest[empty, k] = tk.mix(raw[empty] ^ (salt >> U64(k + 1)))
    return key & U64((1 << 54) - 1), count, bounds, digest


def prob_minhash(elem: np.ndarray, weight: np.ndarray, bounds: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """The shingle that arrives first in each of ``m`` registers, for every row (0 in empty rows)."""
    if m > 2048 or m & (m - 1):
        raise ValueError("m must be a power of two, 2048 at most")
    n = len(bounds) - 1
    first = np.full(n * m, np.inf)
    who = np.zeros(n * m, dtype=U64)
    row = np.repeat(np.arange(n), np.diff(bounds))
    time = np.zeros(len(elem))
    drawn = np.zeros(len(elem), dtype=U64)
    active = np.arange(len(elem))
    size = 1
    while len(active):
        e, r, w = elem[active], row[active], weight[active]
        step = drawn[active][:, None] + np.arange(1, size + 1, dtype=U64)
        draw = tk.mix(tk.mix(e * U64(0xD6E8FEB86659FD93) + U64(1))[:, None] + step * U64(0x9E3779B97F4A7C15))
        wait = -np.log(((draw >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w[:, None]
        arrival = time[active][:, None] + np.cumsum(wait, axis=1)
        register = (draw & U64(m - 1)).astype(np.int64)  # bits that the waiting time leaves
        slot = (r[:, None] * m + register).ravel()
        flat = arrival.ravel()
        np.minimum.at(first, slot, flat)
        won = first[slot] == flat
        who[slot[won]] = np.repeat(e, size)[won]
        latest = first.reshape(n, m).max(axis=1)
        time[active] = arrival[:, -1]
        drawn[active] += U64(size)
        active = active[arrival[:, -1] < latest[r]]
        size = max(1, min(size * 2, 64, (1 << 18) // max(1, len(active))))
    return who.reshape(n, m)


def band_hashes(who: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    grid = who.reshape(len(who), bands, rows)
    return tk.mix((grid * _A[:rows]).sum(axis=2, dtype=U64) + np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15)).astype(np.int64)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets with sorted elements a, b and weights x, y."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if x.max() == 1 and y.max() == 1:
        return len(both) / (len(a) + len(b) - len(both))
    x, y = x.astype(np.float64), y.astype(np.float64)
    x_only, y_only = x.sum() - x[i].sum(), y.sum() - y[j].sum()
    xs, ys = x[i], y[j]
    order = np.argsort(ys / xs, kind="stable")
    xs, ys = xs[order], ys[order]
    low = x_only + np.cumsum(xs)  # elements whose y / x is at most this one's
    high = y_only + ys.sum() - np.cumsum(ys)
    return float((1.0 / (low / xs + high / ys)).sum())


def _slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    for a, b in tk.column_slices(text):
        for c in range(a, b, 1000):
            yield c, min(b, c + 1000)


def _digests(d: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(d), [None, pa.py_buffer(np.ascontiguousarray(d).tobytes())]).cast(pa.binary())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, th, node, bands)."""
    for batch in batches:
        for a, b in _slices(batch.column("text")):
            elem, count, bounds, digest = weighted_shingles(*tk.text_bytes(batch.column("text").slice(a, b - a)))
            bands = band_hashes(prob_minhash(elem, count, bounds))
            has = np.diff(bounds) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]), pa.int32()), pa.array(bands[has].ravel()))
            same = [batch.column(c).slice(a, b - a) for c in ("id", "th")]
            yield pa.RecordBatch.from_arrays([*same, _digests(digest), lists], ["id", "th", "node", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (node, weighted shingles as bytes)."""
    for batch in batches:
        for a, b in _slices(batch.column("text")):
            elem, count, bounds, digest = weighted_shingles(*tk.text_bytes(batch.column("text").slice(a, b - a)))
            packed = [elem[s:t].tobytes() + count[s:t].astype("<u4").tobytes() for s, t in zip(bounds[:-1], bounds[1:], strict=True)]
            total = np.concatenate([[0], np.cumsum(count)])
            yield pa.RecordBatch.from_arrays([_digests(digest), pa.array(packed, pa.binary()), pa.array(total[bounds[1:]] - total[bounds[:-1]])], ["node", "bag", "total"])


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, dtype=U64, count=n), np.frombuffer(raw, dtype="<u4", offset=8 * n)


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (shingle, node, weight) of some bags."""
    for batch in batches:
        for node, raw in zip(batch.column("node"), batch.column("bag"), strict=True):
            elem, weight = _unpack(raw.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(elem.astype(np.int64)), pa.array([node.as_py()] * len(elem), pa.binary()), pa.array(weight.astype(np.int64))], ["shingle", "node", "weight"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, total, unit, bits): the weight of all shingles, whether each weighs 1, and a bitmap of
    ``BITS`` bits in words of 64, in which every shingle sets one."""
    for batch in batches:
        out = np.zeros((len(batch), BITS), dtype=np.uint8)
        unit = np.zeros(len(batch), dtype=bool)
        for k, raw in enumerate(batch.column("bag")):
            elem, weight = _unpack(raw.as_py())
            out[k, (elem & U64(BITS - 1)).astype(np.int64)] = 1
            unit[k] = weight.max() == 1
        words = np.packbits(out, axis=1).view("<i8").ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * (BITS // 64)), pa.array(words))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("total"), pa.array(unit), lists], ["node", "total", "unit", "bits"])


def node_statistics(bags: DataFrame) -> DataFrame:
    """(node, total, unit, bits, own): see ``_bitmaps``; own is the weight of the shingles that no other of these nodes has."""
    rows = tk.map_arrow(bags.select("node", "bag"), _elements, "shingle bigint, node binary, weight bigint")
    single = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.sum("weight").alias("weight")).filter("n = 1")
    own = single.groupBy("node").agg(F.sum("weight").alias("own"))
    facts = tk.map_arrow(bags.select("node", "bag", "total"), _bitmaps, "node binary, total bigint, unit boolean, bits array<bigint>")
    return facts.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))


def may_link(x: str, y: str, threshold: float) -> Column:
    """Whether the statistics of two nodes allow a similarity of ``threshold``.

    What is known not to be shared: shingles that one alone of all nodes has, and bits that one
    alone of the two has (a weight of 1 at least stands behind each).  With weights of 1 the
    shared part is at most the smaller rest, and the union at least all else.  With other weights,
    the probability Jaccard similarity is at most 1 / (1 + g(x) + g(y)), g being lone / (total - lone):
    with a the share of x's weight and b of y's that is common, it is a sum of 1 / (X / x_d + lone_y / y_d)
    at most, which is concave and homogeneous, so at most that of the sums.
    """

    def bits(one: str, other: str) -> Column:
        return F.expr(" + ".join(f"bit_count({one}_bits[{i}] & ~{other}_bits[{i}])" for i in range(BITS // 64))).cast("bigint")

    def allowed(lone: dict[str, Column]) -> Column:
        rest = {k: F.col(f"{k}_total") - lone[k] for k in (x, y)}
        plain = F.least(rest[x], rest[y]) * (1 + threshold) + 1e-9 >= threshold * (F.col(f"{x}_total") + F.col(f"{y}_total"))
        cost = sum(lone[k] / F.greatest(rest[k], F.lit(1e-9)) for k in (x, y))
        return F.when(F.col(f"{x}_unit") & F.col(f"{y}_unit"), plain).otherwise((1 + cost) * threshold <= 1 + 1e-9)

    own = {k: F.col(f"{k}_own") for k in (x, y)}
    return allowed(own) & allowed({x: F.greatest(own[x], bits(x, y)), y: F.greatest(own[y], bits(y, x))})


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, similarity) of pairs of bags."""
    for batch in batches:
        last, hub, sim = None, None, []
        for one, two in zip(batch.column("bag_u"), batch.column("bag_v"), strict=True):
            raw = two.as_py()
            if raw != last:
                last, hub = raw, _unpack(raw)
            sim.append(probability_jaccard(*_unpack(one.as_py()), *hub))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(sim, pa.float64())], ["u", "v", "similarity"])


def components(links: DataFrame, run: tk.Scratch, rows: int | None = None) -> DataFrame:
    """(node, root) for all nodes of the links (u, v): root is one node of the component, the same for all.

    Every round points each node at its least neighbour, follows that pointer once, and merges
    nodes into what they point at; links within a merged node vanish, so the links shrink from
    round to round, and the files with them.  Pointers and links are written every round, roots
    every ``ROUNDS_A_TABLE``: each table is a query more that the driver plans and remembers.
    ``rows`` is a bound of the number of links, where one is known.
    """
    edges, n = run.counted(links.filter("u != v").select(*_ordered("u", "v")).distinct(), "edges", rows)
    labels, n_labels = None, 2 * n
    for turn in range(MAX_ROUNDS):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("up"))
        over = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        moved = run.put(parent.join(over, "up").select("node", F.col("top").alias("to")), "moved", 2 * n)
        if labels is None:
            labels = moved.select("node", F.col("to").alias("root"))
        else:
            step = moved.select(F.col("node").alias("root"), "to")
            labels = labels.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        at = {k: moved.select(F.col("node").alias(k), F.col("to").alias(f"{k}_to")) for k in ("u", "v")}
        merged = edges.join(at["u"], "u").join(at["v"], "v").filter("u_to != v_to").select(*_ordered("u_to", "v_to"))
        # A node pointed at may itself point on: that link stays.
        onward = moved.join(moved.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").filter("next != to").select(*_ordered("to", "next"))
        edges, n = run.counted(merged.unionByName(onward).distinct(), "edges", 3 * n)
        if turn and (not n or turn % ROUNDS_A_TABLE == 0):
            labels = run.put(labels, "labels", n_labels)
        if not n:
            return labels
    raise RuntimeError("components did not settle")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


class _Classes:
    """Classes of nodes, joined pair by pair of buckets (band, node, n, hub)."""

    def __init__(self, run: tk.Scratch, buckets: DataFrame, n_buckets: int, bags: DataFrame, threshold: float):
        self.run, self.buckets, self.n_buckets, self.bags, self.threshold = run, buckets, n_buckets, bags, threshold
        self.known: DataFrame | None = None  # similarities of all pairs so far
        self.n_known = 0
        self.roots: DataFrame | None = None

    def of(self, table: DataFrame, node: str, name: str) -> DataFrame:
        """``table`` with the class of a node."""
        if self.roots is None:
            return table.withColumn(name, F.col(node))
        root = self.roots.select(F.col("node").alias(node), F.col("root").alias("__root"))
        return table.join(root, node, "left").withColumn(name, F.coalesce("__root", node)).drop("__root")

    def verify(self, pairs: DataFrame) -> bool:
        """Find the similarities of the pairs that are not known, and join classes by them; whether there were any."""
        if self.known is not None:
            pairs = pairs.join(self.known, ["u", "v"], "left_anti")
        pairs, n = self.run.counted(pairs, "pairs", self.n_buckets)
        if not n:
            return False
        u, v = (self.bags.select(F.col("node").alias(k), F.col("bag").alias(f"bag_{k}")) for k in ("u", "v"))
        found = self.run.put(tk.map_arrow(pairs.join(u, "u").join(v, "v"), _similarities, "u binary, v binary, similarity double"), "similarities", n, 2_000)
        self.known = found if self.known is None else self.known.unionByName(found)
        self.n_known += n
        links = found.filter(F.col("similarity") >= self.threshold).select("u", "v")
        if not links.isEmpty():
            if self.roots is not None:
                links = links.unionByName(self.roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
            self.roots = components(links, self.run, 2 * self.n_known)
        return True

    def against_hubs(self) -> None:
        largest = self.buckets.groupBy("node").agg(F.max(F.struct("n", "band", "hub")).alias("b"))
        self.verify(largest.select("node", "b.hub").filter("node != hub").select(*_ordered("node", "hub")).distinct())
        while True:
            placed = self.of(self.of(self.buckets, "node", "class"), "hub", "hub_class").filter("class != hub_class")
            one = placed.groupBy("band", "hub", "class").agg(F.min("node").alias("node"))
            if not self.verify(one.select(*_ordered("node", "hub")).distinct()):
                return

    def mixed(self) -> tuple[DataFrame, int]:
        """(band, node, class, main) of buckets of several classes, main being the largest one; and the number of rows."""
        placed = self.of(self.buckets.select("band", "node"), "node", "class")
        per_class = placed.groupBy("band", "class").agg(F.count(F.lit(1)).alias("n"))
        several = per_class.groupBy("band").agg(F.max(F.struct("n", "class")).alias("top"), F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n")).filter("classes > 1 and n > 2")
        return self.run.counted(placed.join(several.select("band", F.col("top.class").alias("main")), "band"), "mixed", self.n_buckets)

    def across(self) -> None:
        """Compare what is left: nodes of mixed buckets with the central node, then with one another."""
        mixed, n = self.mixed()
        if not n:
            return
        stats = self.run.put(node_statistics(self.bags.join(mixed.select("node").distinct(), "node", "left_semi")), "statistics", n, 5_000)
        share = F.struct(F.col("own") / F.greatest("total", F.lit(1)), "node")
        pivots = mixed.join(stats, "node").groupBy("class").agg(F.min(share).alias("p")).select(F.col("class").alias("main"), F.col("p.node").alias("pivot"))
        # Written, so that the join with a large class has no aggregate beside it and can be split.
        pivots = self.run.put(pivots, "pivots", n)
        minor = mixed.filter("class != main").join(pivots, "main").select("node", "pivot")
        self.verify(minor.select(*_ordered("node", "pivot")).distinct())

        mixed, n = self.mixed()
        if not n:
            return
        full = self.run.put(mixed.join(stats, "node"), "placed", n, 5_000)
        facts = lambda d, k: d.select(F.col("band").alias(f"{k}_band"), F.col("node").alias(k), F.col("class").alias(f"{k}_class"), *[F.col(c).alias(f"{k}_{c}") for c in ("total", "unit", "own", "bits")])
        a, b = facts(full.filter("class != main"), "a"), facts(full, "b")
        on = (F.col("a_band") == F.col("b_band")) & (F.col("a_class") != F.col("b_class")) & may_link("a", "b", self.threshold)
        self.verify(a.join(b, on).select(*_ordered("a", "b")).distinct())


def _classify(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(id, th, class, class_id, n_members, is_first) of every row, th being a hash of its text.

    class_id is the least id of the class, n_members its number of rows.  Its first row is the
    one with the least id (null ids last).  Null texts count as empty.  Texts without words
    are of one class only with equal texts; texts of fewer than five words have all their
    words as one shingle.
    """
    run = tk.Scratch(docs.sparkSession, "near-duplicates")
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(text).alias("th"), F.lower(text).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    signed, n = run.counted(tk.map_arrow(rows, _sign, f"id {id_type}, th bigint, node binary, bands array<bigint>"), "signatures")
    # Rows of one node are folded before they are shuffled, and all joins by node but the last are between folded tables.
    order = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    nodes = run.put(signed.groupBy("node").agg(F.first("bands").alias("bands"), F.min(order).alias("head"), F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "nodes", n, 5_000)
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).filter("n > 1")
    buckets, n_buckets = run.counted(banded.join(shared, "band"), "buckets", n, 5_000)

    # Texts are read again, and only those of nodes in a shared bucket go on.
    wanted = run.put(buckets.select("node").distinct(), "shared-nodes", n_buckets)
    ids = nodes.join(wanted, "node", "left_semi").select("id").distinct()
    some = rows.join(ids, rows["id"].eqNullSafe(ids["id"]), "left_semi").select("text")
    bags = tk.map_arrow(some, _sets, "node binary, bag binary, total bigint").join(wanted, "node", "left_semi")
    bags = run.put(bags.groupBy("node").agg(F.first("bag").alias("bag"), F.first("total").alias("total")), "shingles", n_buckets, 5_000)

    classes = _Classes(run, buckets, n_buckets, bags, threshold)
    classes.against_hubs()
    classes.across()

    of_node = run.put(classes.of(nodes.select("node", "head", "id", "n"), "node", "class"), "node-class", n)
    named = of_node.groupBy("class").agg(F.min("id").alias("class_id"), F.sum("n").alias("n_members"), F.min("head").alias("head"))
    # Written, so that the join below has no aggregate on either side and a hot node can be split.
    of_node = run.put(of_node.select("node", "class").join(named, "class"), "class-of-node", n)
    is_first = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("th") == F.col("head.th"))
    out = run.keep(signed.select("id", "th", "node").join(of_node, "node").select("id", "th", "class", "class_id", "n_members", is_first.alias("is_first")), "classes")
    run.clear()
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row (id_col, class_id, n_members, is_first) for every row of ``docs``; see ``_classify``."""
    return _classify(docs, id_col, text_col, threshold).select(F.col("id").alias(id_col), "class_id", "n_members", "is_first")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates, all columns kept.

    It is the row with the least id, null ids last; of rows equal in id and text, any one.
    """
    p = tk.fresh(docs)
    first = _classify(docs, id_col, text_col, threshold).filter("is_first").select(F.col("id").alias(f"{p}id"), F.col("th").alias(f"{p}th"), F.col("class").alias(f"{p}class"))
    repeated = not first.groupBy(f"{p}class").count().filter("count > 1").isEmpty()
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    on = docs[f"`{id_col}`"].eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(text) == F.col(f"{p}th"))
    if not repeated:
        return docs.join(first, on, "left_semi")
    return docs.join(first.distinct(), on).dropDuplicates([f"{p}class"]).drop(f"{p}id", f"{p}th", f"{p}class")
