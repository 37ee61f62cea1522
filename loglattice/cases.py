"""Persistent cases, bundles and reports.

A case is a folder on any file system that Spark reads: ``log/`` of commits (creation, batches,
notes, infrastructure, rebuilds) and ``data/`` with a folder per batch.  A batch holds, beside the
flat event columns, each original record as a VARIANT, so columns can be made anew when the schema
changes, and fields that it lacks can be asked for.  A batch counts from its commit on: one that was
killed leaves files that nothing names, and ``vacuum`` deletes them.
"""

from __future__ import annotations

import datetime
import hashlib
import html
import ipaddress
import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.caselog import CommitLog, Folder
from loglattice.events import derive
from loglattice.schema import RAW, conform, fingerprint, flat
from loglattice.sources import readers

CASE_ID = re.compile(r"^[a-z0-9][a-z0-9._-]{0,63}$")
BUNDLE_VERSION = 1
DIGEST_ROWS = 500
#: Hours after which files without a commit are taken for those of a writer that was killed.
ORPHAN_HOURS = 24


def _now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _stored_schema() -> T.StructType:
    return T.StructType([T.StructField("pos", T.LongType()), T.StructField("record", T.VariantType()), *[f for f in RAW.fields if f.name != "id"]])


def record_of(df: DataFrame, kind: str) -> Column:
    """The original of each row: its text as it was read, if that is a record of ``kind``, else all of its columns.

    Texts that are no JSON become an object with the text as ``line``.
    """
    text = F.col("original") if "original" in df.columns else F.lit(None).cast("string")
    if kind in readers.RECORD_EVENTS:
        return F.coalesce(F.try_parse_json(text), F.parse_json(F.to_json(F.struct(text.alias("line")))))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("id", "pos")]
    return F.parse_json(F.to_json(F.struct(*rest)))


def events_of(records: DataFrame, kind: str) -> DataFrame:
    """(pos, flat columns) made from (pos, record): by the reader of ``kind``, or by the common schema's keys."""
    if kind in readers.RECORD_EVENTS:
        return readers.RECORD_EVENTS[kind](records.select("pos", F.from_json(F.to_json("record"), readers.MAP).alias("m")))
    return flat(records.select("pos", "record"))


class Case:
    def __init__(self, spark: SparkSession, root: str, case_id: str):
        if not CASE_ID.match(case_id):
            raise ValueError(f"not a case id: {case_id!r}")
        self.spark, self.id = spark, case_id
        self.folder = Folder(spark, f"{root.rstrip('/')}/{case_id}")
        self.log = CommitLog(self.folder)

    @property
    def meta(self) -> dict:
        """The state that the commits add up to."""
        entries = self.log.entries()
        if not entries:
            raise FileNotFoundError(self.id)
        out = {"id": self.id, "events": 0, "batches": [], "notes": [], "infra_ips": [], "digest": None}
        for e in entries:
            if e["do"] == "create":
                out |= {"title": e["title"], "created": e["at"]}
            elif e["do"] == "append":
                out["batches"].append({k: e[k] for k in ("data", "n", "first", "signature", "key", "kind", "label", "schema")} | {"added": e["at"]})
                out["events"] += e["n"]
            elif e["do"] == "rebuild":
                for b in out["batches"]:
                    if b["data"] in e["moved"]:
                        b |= {"data": e["moved"][b["data"]], "schema": e["schema"]}
            elif e["do"] == "note":
                out["notes"].append({"at": e["at"], "text": e["text"]})
            elif e["do"] == "infrastructure":
                out["infra_ips"] = e["ips"]
            else:
                out["digest"] = e["digest"]
        schemas = {b["schema"] for b in out["batches"]}
        return out | {"schema": fingerprint() if schemas <= {fingerprint()} else min(schemas - {fingerprint()})}

    def _add(self, do: str, **what) -> None:
        self.meta  # of a case that there is
        self.log.commit(lambda _: {"do": do, "at": _now(), **what})

    def create(self, title: str = "") -> "Case":
        def first(entries: list[dict]) -> dict:
            if entries:
                raise FileExistsError(self.id)
            return {"do": "create", "at": _now(), "title": title}

        self.log.commit(first)
        return self

    def _write(self, rows: DataFrame) -> tuple[str, int, str]:
        """Write a batch in two passes, the second with places that go on from part to part; its folder, size and signature.

        The signature is a hash over the sums of the rows' hashes and their count, each row hashed
        with its place, so the order matters.
        """
        name = uuid.uuid4().hex
        draft, final = self.folder.at(f"data/{name}-draft"), self.folder.at(f"data/{name}")
        schema = _stored_schema()
        rows.withColumn("pos", F.monotonically_increasing_id()).select(*schema.names).write.parquet(draft)
        back = self.spark.read.schema(schema).parquet(draft).withColumn("part", F.shiftright("pos", 33))
        sizes = back.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        # A row per part is put in order, not every row.
        start = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "start")
        placed = back.join(start, "part").withColumn("pos", F.col("start") + F.col("pos").bitwiseAND((1 << 33) - 1))
        placed.select(*schema.names).write.parquet(final)
        self.folder.delete(f"data/{name}-draft")
        kept = self.spark.read.schema(schema).parquet(final)
        body = F.to_json("record")
        got = kept.select(F.xxhash64("pos", body).alias("a"), F.xxhash64(body, "pos").alias("b")).agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        return name, got[0], hashlib.sha256("|".join(map(str, got)).encode()).hexdigest()

    def append(self, raw: DataFrame, force: bool = False, kind: str = "flat", label: str = "", key: str | None = None) -> int:
        """Add a batch with continuing ids; the number of events that came in.

        The same batch again is refused unless ``force``; one with the ``key`` of an earlier batch
        is not added and no error, so a caller that can't know whether its last try came through may
        try again.  Of a ``kind`` in ``readers.RECORD_EVENTS`` the events' own texts (``original``)
        are the records; otherwise the records are all columns of ``raw``, those that the schema
        lacks included.
        """
        if key is not None and any(b["key"] == key for b in self.meta["batches"]):
            return 0
        self.meta
        name, n, signature = self._write(conform(raw.withColumn("record", record_of(raw, kind)), keep=("record",)))
        if not n:
            self.folder.delete(f"data/{name}")
            return 0

        def entry(entries: list[dict]) -> dict | None:
            batches = [e for e in entries if e["do"] == "append"]
            if key is not None and any(e["key"] == key for e in batches):
                return None
            if not force and any(e["signature"] == signature for e in batches):
                raise ValueError("this batch is in the case already")
            return {"do": "append", "at": _now(), "data": name, "n": n, "first": sum(e["n"] for e in batches), "signature": signature, "key": key, "kind": kind, "label": label, "schema": fingerprint()}

        try:
            done = self.log.commit(entry)
        except ValueError:
            self.folder.delete(f"data/{name}")
            raise
        if done is None:
            self.folder.delete(f"data/{name}")
            return 0
        return n

    def append_source(self, kind: str, path: str, force: bool = False, label: str = "", **options) -> int:
        """Read a source and add what it holds."""
        return self.append(readers.READERS[kind](self.spark, path, **options), force, kind if kind in readers.RECORD_EVENTS else "flat", label or path.rstrip("/").rpartition("/")[2])

    def sink(self, name: str, kind: str = "flat"):
        """For ``foreachBatch``: every micro-batch of the stream ``name`` is added once, however often it is replayed."""
        return lambda batch, epoch: self.append(batch, force=True, kind=kind, label=name, key=f"{name}/{epoch}") and None

    def _stored(self) -> DataFrame:
        """(id, record, flat columns): ids go on from batch to batch."""
        batches = self.meta["batches"]
        schema = _stored_schema()
        if not batches:
            return self.spark.createDataFrame([], T.StructType([T.StructField("id", T.LongType()), *schema.fields]))
        rows = self.spark.read.schema(schema).parquet(*[self.folder.at(f"data/{b['data']}") for b in batches])
        first = F.create_map(*[F.lit(x) for b in batches for x in (b["data"], b["first"])])
        of = F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32})/", 1)
        return rows.withColumn("id", (F.element_at(first, of) + F.col("pos")).cast("bigint"))

    def raw(self) -> DataFrame:
        return self._stored().select(*RAW.names)

    def records(self) -> DataFrame:
        """(id, record): the originals, for fields that the schema lacks (``try_variant_get``)."""
        return self._stored().select("id", "record")

    def events(self, techniques: dict | None = None) -> DataFrame:
        """Derived events; what is derived is never stored."""
        return derive(self.raw(), techniques)

    def rebuild(self, every: bool = False) -> int:
        """Make all columns anew from the originals, of batches that another schema wrote (or of ``every`` one); their number.

        Each batch is written beside the old one, and one commit moves them all.
        """
        moved = {}
        for b in self.meta["batches"]:
            if not every and b["schema"] == fingerprint():
                continue
            records = self.spark.read.schema(_stored_schema()).parquet(self.folder.at(f"data/{b['data']}")).select("pos", "record")
            made = events_of(records, b["kind"]).drop("id")
            name = uuid.uuid4().hex
            # A record that its reader passes over keeps its place, with empty columns.
            records.join(made, "pos", "left").select(*_stored_schema().names).write.parquet(self.folder.at(f"data/{name}"))
            moved[b["data"]] = name
        if moved:
            self._add("rebuild", moved=moved, schema=fingerprint())
        return len(moved)

    def vacuum(self, hours: float = ORPHAN_HOURS) -> list[str]:
        """Delete batches that no commit names and that are older than ``hours``; their names."""
        named = {b["data"] for b in self.meta["batches"]}
        old = [name for name, at in self.folder.names("data") if name not in named and at <= (time.time() - hours * 3600) * 1000]
        for name in old:
            self.folder.delete(f"data/{name}")
        return old

    def set_infrastructure(self, ips: list[str]) -> None:
        self._add("infrastructure", ips=sorted({str(ipaddress.ip_address(i.strip())) for i in ips}))

    def note(self, text: str) -> None:
        self._add("note", text=text)

    def analyze(self, techniques: dict | None = None) -> dict[str, DataFrame]:
        from loglattice.analyze import analyze

        return analyze(self.events(techniques), tuple(self.meta["infra_ips"]), techniques=techniques)

    def keep_digest(self, collected: dict[str, list[dict]]) -> None:
        self._add("digest", digest={k: v[:DIGEST_ROWS] for k, v in collected.items()})

    def delete(self) -> None:
        self.folder.delete()


def list_cases(spark: SparkSession, root: str) -> list[dict]:
    """Metadata of all cases, the newest first."""
    found = [Case(spark, root, name) for name, _ in Folder(spark, root).names() if CASE_ID.match(name)]
    return sorted((c.meta for c in found if c.log.entries()), key=lambda m: (m["created"], m["id"]), reverse=True)


def collect(tables: dict[str, DataFrame], limit: int = 5_000) -> dict[str, list[dict]]:
    """Result tables as rows for a report; at most ``limit`` of each are shown."""
    return {k: [json.loads(x) for x in df.limit(limit).toJSON().collect()] for k, df in tables.items()}


def collect_counted(tables: dict[str, DataFrame], limit: int = 5_000) -> tuple[dict[str, list[dict]], dict[str, dict]]:
    """``collect``, and for each table how many rows it has and whether ``limit`` cut it: a cut that nobody sees misleads."""
    found = collect({k: df for k, df in tables.items()}, limit + 1)
    total = {k: (len(rows) if len(rows) <= limit else tables[k].count()) for k, rows in found.items()}
    return {k: rows[:limit] for k, rows in found.items()}, {k: {"records_total": n, "records_capped": n > limit} for k, n in total.items()}


def bundle(collected: dict[str, list[dict]], level: str = "full", counts: dict[str, dict] | None = None) -> dict:
    """A versioned envelope: full, detailed (without timeline rows, with their number) or summary; with ``counts`` of ``collect_counted``."""
    if level not in ("full", "detailed", "summary"):
        raise ValueError(level)
    body = dict(collected)
    if level != "full":
        body["timeline_rows"] = len(body.pop("timeline", []))
    if level == "summary":
        body = {k: v for k, v in body.items() if k in ("summary", "killchain", "host_killchain", "timeline_rows")}
    return {"version": BUNDLE_VERSION, "created": _now(), "level": level, "analysis": body} | ({"counts": counts} if counts is not None else {})


def load_bundle(text: str) -> dict:
    """A bundle, or a bare analysis put into an envelope; other versions are refused."""
    data = json.loads(text)
    if "analysis" not in data:
        return {"version": BUNDLE_VERSION, "created": None, "level": "full", "analysis": data}
    if data.get("version") != BUNDLE_VERSION:
        raise ValueError(f"bundle version {data.get('version')!r}")
    return data


def markdown(collected: dict[str, list[dict]], title: str = "Analysis", rows: int = 20) -> str:
    out = [f"# {title}", ""]
    for name, items in collected.items():
        out += [f"## {name.replace('_', ' ')}", ""]
        if not items:
            out += ["none", ""]
            continue
        cols = list(dict.fromkeys(c for r in items for c in r))
        cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
        out += ["| " + " | ".join(cols) + " |", "|" + "-|" * len(cols)] + ["| " + " | ".join(cell(r.get(c)) for c in cols) + " |" for r in items[:rows]] + [""]
        if len(items) > rows:
            out += [f"{len(items) - rows} more", ""]
    return "\n".join(out)


def html_report(collected: dict[str, list[dict]], title: str = "Analysis", rows: int = 200) -> str:
    esc = lambda v: html.escape(str("" if v is None else v))
    out = [f"<!doctype html><meta charset=utf-8><title>{esc(title)}</title><h1>{esc(title)}</h1>"]
    for name, items in collected.items():
        cols = list(dict.fromkeys(c for r in items for c in r))
        head = "".join(f"<th>{esc(c)}</th>" for c in cols)
        body = "".join("<tr>" + "".join(f"<td>{esc(r.get(c))}</td>" for c in cols) + "</tr>" for r in items[:rows])
        out.append(f"<h2>{esc(name.replace('_', ' '))}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join(out)


def narrative(collected: dict[str, list[dict]]) -> list[str]:
    """A sentence per phase of the kill chain, and how far it reached."""
    names = {t["technique"]: t["name"] for t in collected.get("technique_catalog", [])}
    out = []
    for p in collected.get("killchain", []):
        ids = [t for t in (p.get("technique_list") or "").split(", ") if t]
        what = ", ".join(f"{names.get(t, t)} ({t})" for t in ids) or p.get("tactics") or "activity"
        out.append(f"{p['phase']}: {what}, {p['events']} event(s) on {p['hosts']} host(s).")
    if out:
        out.append(f"Reach: {collected['killchain'][-1]['phase']}.")
    return out


def document(meta: dict, collected: dict[str, list[dict]], rows: int = 20) -> str:
    """The case as a Markdown document: its sources, how far it reached, what was seen, notes, and what to keep in mind."""
    sources = [{"batch": b["label"] or b["kind"], "events": b["n"], "added": b["added"]} for b in meta["batches"]]
    told = narrative(collected)
    out = [f"# {meta['title'] or meta['id']}", "", f"Case {meta['id']}, created {meta['created']}, {meta['events']} event(s).", "", "## What happened", "", *([f"- {t}" for t in told] or ["No activity could be placed on the kill chain."]), ""]
    if meta["infra_ips"]:
        out += ["## Declared infrastructure", "", *[f"- {ip}" for ip in meta["infra_ips"]], ""]
    out += [markdown({"sources": sources}, "").split("\n", 2)[2]]
    shown = {k: collected[k] for k in ("shared_indicators", "incident_clusters", "episodes", "host_killchain", "technique_catalog", "timeline") if k in collected}
    out += [markdown(shown, "", rows).split("\n", 2)[2]]
    out += ["## Notes", "", *([f"- {x['at']}: {x['text']}" for x in meta["notes"]] or ["none"]), "", "## To keep in mind", "", "Links between entities are co-occurrence, not causation; every lead is to be validated against its source.", ""]
    return "\n".join(out)


def redact(value, mapping: dict[str, str]):
    """Replace real values by pseudonyms in any JSON value: longest first, ignoring case."""
    if not mapping:
        return value
    pattern = re.compile("|".join(re.escape(k) for k in sorted(mapping, key=lambda k: (-len(k), k))), re.IGNORECASE)
    low = {k.lower(): v for k, v in mapping.items()}

    def walk(v):
        if isinstance(v, str):
            return pattern.sub(lambda m: low[m[0].lower()], v)
        if isinstance(v, list):
            return [walk(x) for x in v]
        if isinstance(v, dict):
            return {walk(k): walk(x) for k, x in v.items()}
        return v

    return walk(value)


def describe_error(e: Exception) -> str:
    """An error's text without folders of this machine: paths keep their last part, links stay."""
    return re.sub(r"(?<![:/\w])(?:[A-Za-z]:)?[\\/](?:[^\s'\"\\/]+[\\/])+([^\s'\"\\/]*)", r"\1", str(e))[:200]
