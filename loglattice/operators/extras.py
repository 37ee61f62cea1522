"""Smaller analytics: captures, logons, metrics, indicator search, flows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.operators.recipes import COMMON_PORTS, _order, count_rows
from loglattice.storage import stored

# Logon types that come over the network.
REMOTE_LOGONS = ("3", "8", "9", "10")
EXFIL_BYTES = 1_000_000


def conversations(events: DataFrame) -> DataFrame:
    agg = events.filter("src_ip is not null and dst_ip is not null").groupBy("src_ip", "dst_ip", "dst_port", "transport").agg(count_rows().alias("packets"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))
    odd = F.coalesce(~F.col("dst_port").isin(*COMMON_PORTS), F.lit(False))
    return agg.withColumn("nonstandard", odd).withColumn("exfil_hint", F.col("total_bytes") > EXFIL_BYTES).orderBy(*_order("-total_bytes", "src_ip", "dst_ip", "dst_port", "transport"))


def dns_counts(events: DataFrame) -> DataFrame:
    return events.filter("dns_query is not null").groupBy("dns_query").agg(count_rows().alias("lookups")).orderBy(*_order("-lookups", "dns_query"))


def logons(events: DataFrame) -> DataFrame:
    """Remote and failed logons of Windows events 4624 and 4625: (kind, user, host, src_ip, logon_type, n)."""
    keys = [F.col("user_name").alias("user"), "host", "src_ip", "logon_type"]
    ok = events.filter((F.col("event_code") == 4624) & F.col("logon_type").isin(*REMOTE_LOGONS)).groupBy(*keys).agg(count_rows().alias("n")).withColumn("kind", F.lit("remote"))
    bad = events.filter("event_code = 4625").groupBy(*keys).agg(count_rows().alias("n")).withColumn("kind", F.lit("failed"))
    both = ok.unionByName(bad).select("kind", "user", "host", "src_ip", "logon_type", "n")
    rank = F.when(F.col("kind") == "failed", -F.col("n")).otherwise(F.col("n"))
    return both.orderBy("kind", rank, *_order("user", "host", "src_ip", "logon_type"))


def logon_totals(events: DataFrame) -> DataFrame:
    """(kind, n, users, hosts, sources): the sums of remote and of failed logons, and how many users, hosts and addresses they have."""
    kind = F.when((F.col("event_code") == 4624) & F.col("logon_type").isin(*REMOTE_LOGONS), "remote").when(F.col("event_code") == 4625, "failed")
    rows = events.select(kind.alias("kind"), "user_name", "host", "src_ip").filter("kind is not null")
    return rows.groupBy("kind").agg(count_rows().alias("n"), F.count_distinct("user_name").alias("users"), F.count_distinct("host").alias("hosts"), F.count_distinct("src_ip").alias("sources")).orderBy("kind")


def event_id_metrics(events: DataFrame) -> DataFrame:
    return events.filter("event_code is not null").groupBy("event_code").agg(count_rows().alias("n")).orderBy(*_order("-n", "event_code"))


def log_metrics(events: DataFrame) -> DataFrame:
    return events.groupBy("source").agg(count_rows().alias("n"), F.min("ts_parsed").alias("first"), F.max("ts_parsed").alias("last")).orderBy(*_order("-n", "source"))


def computer_metrics(events: DataFrame) -> DataFrame:
    return events.filter("host is not null").groupBy("host").agg(count_rows().alias("n")).orderBy(*_order("-n", "host"))


def search(events: DataFrame, keywords: list[str] | None = None, regex: str | None = None, all_of: bool = False) -> DataFrame:
    """Events whose record holds a keyword (any, or all), case-insensitive, or matches a Java regex."""
    text = F.lower(F.to_json(F.struct("*")))
    test = F.lit(all_of)
    for k in keywords or []:
        one = text.contains(k.lower())
        test = test & one if all_of else test | one
    if regex is not None:
        test = F.to_json(F.struct("*")).rlike(regex)
    return events.filter(test)


def pivot_keywords(events: DataFrame) -> DataFrame:
    """(kind, value): the distinct users, hosts, addresses, processes, names and hashes."""
    kinds = {"user": "user_name", "host": "host", "src_ip": "src_ip", "dst_ip": "dst_ip", "process": "process_name", "domain": "dns_query", "hash": "file_hash"}
    rows = events.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items()])))
    return rows.filter("value is not null").distinct()


def extract_base64(events: DataFrame, fields: tuple[str, ...] = ("cmdline", "message"), least: int = 16) -> DataFrame:
    """(id, field, token, encoding, decoded): Base64 texts in some fields, told by built-in functions alone.

    A token has ``least`` characters or more and whole groups of four; it is one if it decodes to
    text, UTF-16 (every second byte of its first four is zero) or UTF-8, without control characters.
    Lines of 64 or 76 characters, as encoders wrap them, are one token with the line after them if
    they decode as one, or do so without the last line; else each line stands for itself.
    """
    letter = "[A-Za-z0-9+/]"
    last = f"(?:{letter}{{4}}|{letter}{{3}}=|{letter}{{2}}==)"
    token = rf"(?<![A-Za-z0-9+/=])((?:{letter}{{4}}){{{max(1, least // 4 - 1)},}}{last})(?![A-Za-z0-9+/=])"
    follows = [rf"(?:{letter}{{4}}){{0,{width // 4 - 1}}}{last}(?![A-Za-z0-9+/=])" for width in (64, 76)]
    lines = [rf"(?:{letter}{{{width}}}\r?\n(?={after}))++{after}" for width, after in zip((64, 76), follows, strict=True)]
    wrapped = rf"(?<![A-Za-z0-9+/=])({lines[0]}|{lines[1]})"

    byte = lambda raw, k: F.hex(F.substring(raw, k, 1)) == "00"
    wide = lambda raw: byte(raw, 2) & byte(raw, 4) & (F.octet_length(raw) % 2 == 0)
    decoded = lambda raw: F.when(wide(raw), F.decode(raw, "UTF-16LE")).when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    good = lambda text: text.isNotNull() & ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]")
    binary = lambda t: F.try_to_binary(t, F.lit("base64"))

    def tokens(c: Column) -> Column:
        single = lambda text: F.regexp_extract_all(text, F.lit(token), F.lit(1))
        glued = lambda w: F.regexp_replace(w, r"\r?\n", "")
        fits = lambda t: good(decoded(binary(t))) & (F.length(t) >= least)
        shorter = lambda w: F.regexp_replace(w, r"\r?\n[^\n]*$", "")
        rest = lambda w: single(F.regexp_extract(w, r"[^\n]*$", 0))
        of_span = lambda w: F.when(fits(glued(w)), F.array(glued(w))).when(fits(glued(shorter(w))), F.concat(F.array(glued(shorter(w))), rest(w))).otherwise(single(w))
        spans = F.transform(F.regexp_extract_all(c, F.lit(wrapped), F.lit(1)), of_span)
        return F.when(c.contains("\n") & c.rlike(wrapped), F.concat(F.flatten(spans), single(F.regexp_replace(c, wrapped, " ")))).otherwise(single(c))

    there = [f for f in fields if f in events.columns]
    likely = reduce(lambda a, b: a | b, [F.col(f).rlike(token) | (F.col(f).contains("\n") & F.col(f).rlike(wrapped)) for f in there])
    held = [F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("tokens")) for f in there]
    each = events.filter(likely).select("id", F.inline(F.array(*held))).select("id", "field", F.explode("tokens").alias("token")).withColumn("raw", binary(F.col("token")))
    out = each.withColumn("decoded", decoded(F.col("raw"))).withColumn("encoding", F.when(wide(F.col("raw")), "utf-16").otherwise("utf-8"))
    return out.filter(good(F.col("decoded"))).select("id", "field", "token", "encoding", "decoded")


#: Bytes of a gram; shorter indicators are keyed by all of their bytes.
GRAM = 8
#: Places of the map of grams that may matter: half a megabyte, whatever the number of indicators.
MAP_BITS = 22
#: One text in so many is looked at to tell which grams are rare; that only decides how fast a search is.
RARE_SAMPLE = 64


def _grams(buf: np.ndarray, n: int) -> np.ndarray:
    """All runs of ``n`` bytes (8 at most) as numbers, with their length in the place of missing bytes."""
    if len(buf) < n:
        return np.zeros(0, dtype=np.uint64)
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    runs = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(buf) - n + 1,), strides=(1,)).copy()
    return runs if n == 8 else runs & np.uint64((1 << 8 * n) - 1) | np.uint64(n << 56)


def _place(grams: np.ndarray, bits: int) -> np.ndarray:
    """The place of each gram in a map of ``2**bits``."""
    x = (grams ^ (grams >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _text_grams(there: np.ndarray | None, lengths: list[int]):
    """(digest, gram) of the grams of each text, of those only that the map has if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, found = [], []
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer()
                buf = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
                for n in lengths:
                    g = _grams(buf, n)
                    g = np.unique(g if there is None else g[there[_place(g, len(there).bit_length() - 1)]])
                    digests += [digest] * len(g)
                    found.append(g.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(np.concatenate(found) if found else [], pa.int64())], ["digest", "gram"])

    return run


def _mapped(grams: DataFrame) -> np.ndarray:
    """The map: which places the grams have; at most ``2**MAP_BITS`` numbers come to the driver."""
    bits = MAP_BITS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_place(batch.column("gram").to_numpy().view(np.uint64), bits)))], ["place"])

    there = np.zeros(1 << bits, dtype=bool)
    there[grams.mapInArrow(places, "place bigint").distinct().toArrow().column("place").to_numpy()] = True
    return there


def ioc_search(records: DataFrame, iocs: DataFrame, ioc_col: str = "ioc", fields: list[str] | None = None) -> DataFrame:
    """(ioc, hits): rows that hold each indicator anywhere, case-insensitive; indicators without a hit have no row.

    Any number of indicators is searched in one pass over the texts.  Each is keyed by its rarest
    run of eight bytes; the texts' grams that may be among the keys (a bit map of fixed size tells)
    are joined with the keys, and what meets is compared as a whole.  Equal texts are looked at
    once and counted as often as they come.  Blank and null indicators are left out, and an
    indicator in several spellings has a row for each.
    """
    one = (fields or records.columns)[0]
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in (fields or records.columns)])) if len(fields or records.columns) > 1 else F.col(f"`{one}`").cast("string")
    text = F.lower(whole)
    texts = records.select(text.alias("text")).filter("text <> ''").select("text", F.sha2("text", 256).alias("digest"))
    wanted = iocs.select(F.trim(F.col(f"`{ioc_col}`")).alias("ioc")).filter("ioc <> ''").distinct().select("ioc", F.lower("ioc").alias("form"))
    forms = wanted.select("form").distinct().withColumn("size", F.least(F.octet_length("form"), F.lit(GRAM)))
    lengths = [r["size"] for r in forms.select("size").distinct().collect()]  # eight at most
    if not lengths:
        return wanted.select("ioc", F.lit(0).cast("bigint").alias("hits")).limit(0)
    held = [forms.filter(F.col("size") == n).select(F.col("form").alias("digest"), F.col("form").alias("text")).mapInArrow(_text_grams(None, [n]), "digest string, gram bigint") for n in lengths]
    of_forms = reduce(DataFrame.unionByName, held).select(F.col("digest").alias("form"), "gram")
    some = texts.filter(F.pmod(F.xxhash64("digest"), F.lit(RARE_SAMPLE)) == 0).dropDuplicates(["digest"])
    often = some.mapInArrow(_text_grams(_mapped(of_forms.select("gram")), lengths), "digest string, gram bigint").groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    order = F.struct(F.coalesce("often", F.lit(0)).alias("often"), F.xxhash64("gram").alias("tie"), "gram")
    keys = stored(of_forms.join(often, "gram", "left").groupBy("form").agg(F.min(order)["gram"].alias("gram")), "ioc-keys")

    counts = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    counts = stored(counts, "ioc-texts")
    grams = counts.select("digest", "text").mapInArrow(_text_grams(_mapped(keys.select("gram")), lengths), "digest string, gram bigint")
    near = grams.join(keys, "gram").select("digest", "form")
    hits = near.join(counts, "digest").filter(F.contains("text", "form")).groupBy("form").agg(F.sum("n").alias("hits"))
    return wanted.join(hits, "form").select("ioc", "hits")


def timeline_filter(rows: DataFrame, source: str | None = None, why: str | None = None, q: str | None = None) -> DataFrame:
    out = rows
    for c, v in (("source", source), ("why", why)):
        out = out.filter(F.col(c) == v) if v else out
    fields = [c for c in ("ts", "source", "action", "host", "user_name", "process_name", "src_ip", "dst_ip", "dns_query", "rule_title", "why") if c in rows.columns]
    return out.filter(F.lower(F.concat_ws(" ", *fields)).contains(q.lower())) if q else out


def merge_flows(packets: DataFrame, flows: DataFrame) -> DataFrame:
    """Full outer merge on (src_ip, dst_ip, dst_port, transport); fields of ``flows`` win, its last record by id per key."""
    key = ["src_ip", "dst_ip", "dst_port", "transport"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("id").desc()))
    last = flows.withColumn("rank", rank).filter("rank = 1")
    grouped = packets.groupBy(*key).agg(count_rows().alias("packets"), F.sum("bytes").alias("packet_bytes"))
    a, b = grouped.alias("a"), last.select(*key, F.col("bytes").alias("flow_bytes"), F.col("source").alias("flow_source")).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    both = a.join(b, on, "full")
    return both.select(*[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in key], F.coalesce("a.packets", F.lit(0)).alias("packets"), F.coalesce("b.flow_bytes", "a.packet_bytes").alias("bytes"), F.when(F.col("b.flow_source").isNull(), "packets").when(F.col("a.packets").isNull(), "flows").otherwise("both").alias("seen_by"))


def enrich_connections(conns: DataFrame, transactions: DataFrame, notices: DataFrame | None = None, key: str = "uid") -> DataFrame:
    """Connections left-joined with their transactions, a row each; the first notice is on all of them."""
    out = conns.join(transactions, key, "left")
    if notices is not None:
        rank = F.row_number().over(Window.partitionBy(key).orderBy("ts"))
        first = notices.withColumn("rank", rank).filter("rank = 1").select(key, F.col("note").alias("notice"))
        out = out.join(first, key, "left")
    return out


def thor_findings(events: DataFrame, score: Column | str | None = None, limit: int = 1000) -> DataFrame:
    """The scanner's findings by score, the highest first; by default the score that the readers put into ``ioc_severity``."""
    rows = events.filter("source like 'thor%' and coalesce(action, '') <> 'thor-linked'")
    by = F.expr("try_cast(ioc_severity as double)") if score is None else F.col(score) if isinstance(score, str) else score
    return rows.orderBy(by.desc_nulls_last(), *_order("ts", "message")).limit(limit)
