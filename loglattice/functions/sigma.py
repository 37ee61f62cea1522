"""Sigma rules as columns: selections, modifiers and the whole ``condition`` language but its aggregations.

A rule becomes one boolean expression, so any number of rules is answered in one pass over the
events, and Catalyst shares what they have in common.  A missing field never matches; ``not``
turns that into a match, as every test is true or false and never null.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from fnmatch import fnmatchcase
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Field = Callable[[str], Column]

# Names that rules give to fields, and the columns that hold them.
FIELDS = {
    "EventID": "event_code", "Computer": "host", "ComputerName": "host", "User": "user_name", "TargetUserName": "user_name", "SubjectUserName": "user_name",
    "Image": "process_name", "NewProcessName": "process_name", "ProcessName": "process_name", "CommandLine": "cmdline", "ProcessCommandLine": "cmdline",
    "ParentImage": "parent_name", "ParentProcessName": "parent_name", "ProcessId": "pid", "ParentProcessId": "parent_pid", "SourceIp": "src_ip", "IpAddress": "src_ip",
    "DestinationIp": "dst_ip", "SourcePort": "src_port", "IpPort": "src_port", "DestinationPort": "dst_port", "QueryName": "dns_query", "LogonType": "logon_type",
    "TargetFilename": "file_path", "TargetObject": "registry_key", "Details": "registry_data", "md5": "file_hash_md5", "sha256": "file_hash", "Provider_Name": "source",
}


def event_field(name: str) -> Column:
    """The event column that a rule's field means; other names are columns themselves."""
    return F.col(f"`{FIELDS.get(name, name)}`")


def record_field(record: str = "record") -> Field:
    """Fields of a VARIANT record, at its top or in an object of Windows event data."""
    return lambda name: F.coalesce(*[F.try_variant_get(record, f"$.{p}['{name}']".replace(".[", "["), "string") for p in ("", "Details.", "EventData.", "Event.EventData.")])


def _pattern(value: str) -> str:
    """A value with ``*`` and ``?`` as an anchored pattern; a backslash before one of them, or before a backslash, makes it plain."""
    out = []
    for part in re.findall(r"\\[*?\\]|.", value, re.DOTALL):
        out.append(".*" if part == "*" else "." if part == "?" else re.escape(part[1] if len(part) == 2 else part))
    return "(?is)^" + "".join(out) + "$"


def _in_network(c: Column, value: str) -> Column:
    net = ipaddress.ip_network(value, strict=False)
    if net.version == 6:
        raise ValueError("networks of version 4 only")
    octets = F.split(c, r"\.")
    number = reduce(lambda a, k: a * 256 + octets[k].try_cast("bigint"), range(4), F.lit(0).cast("bigint"))
    return c.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & number.between(int(net.network_address), int(net.broadcast_address))


def _test(c: Column, how: list[str], value) -> Column:
    """Whether one field holds one value, by its modifiers."""
    text = c.cast("string")
    if "exists" in how:
        return c.isNotNull() if value in (True, "true", "yes") else c.isNull()
    if value is None:
        return c.isNull() | (text == "")
    for sign, f in (("lte", lambda a, b: a <= b), ("gte", lambda a, b: a >= b), ("lt", lambda a, b: a < b), ("gt", lambda a, b: a > b)):
        if sign in how:
            return f(text.try_cast("double"), F.lit(float(value)))
    if "re" in how:
        return text.rlike(str(value))
    if "cidr" in how:
        return _in_network(text, str(value))
    value = str(value).lower() if isinstance(value, bool) else str(value)
    if re.search(r"(?<!\\)(\\\\)*[*?]", value):
        lead, end = "contains" in how or "endswith" in how, "contains" in how or "startswith" in how
        made = _pattern(("*" if lead else "") + value + ("*" if end else ""))
        return text.rlike(made.replace("(?is)", "(?s)") if "cased" in how else made)
    value = re.sub(r"\\([*?\\])", r"\1", value)
    if "cased" not in how:
        text, value = F.lower(text), value.lower()
    return text.contains(value) if "contains" in how else text.startswith(value) if "startswith" in how else text.endswith(value) if "endswith" in how else text == value


KNOWN = {"contains", "startswith", "endswith", "re", "all", "cased", "exists", "lt", "lte", "gt", "gte", "cidr"}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def selection(body, field: Field = event_field, whole: Column | None = None) -> Column:
    """One selection: a map (all of its fields), a list of maps (any), or words (any anywhere in the record)."""
    if isinstance(body, dict):
        tests = []
        for key, values in body.items():
            name, *how = key.split("|")
            if set(how) - KNOWN:
                raise ValueError(f"modifier {', '.join(sorted(set(how) - KNOWN))}")
            each = [_sure(_test(field(name), how, v)) for v in (values if isinstance(values, list) else [values])]
            tests.append(_all(each) if "all" in how else _any(each))
        return _all(tests)
    if isinstance(body, list) and all(isinstance(x, dict) for x in body):
        return _any([selection(x, field, whole) for x in body])
    text = F.lower(F.to_json(F.struct("*"))) if whole is None else F.lower(whole)
    return _any([_sure(text.contains(str(x).lower())) for x in (body if isinstance(body, list) else [body])])


_TOKEN = re.compile(r"\s*(\(|\)|[^\s()]+)")


def condition(text: str, names: dict[str, Column]) -> Column:
    """The column of a condition: names, ``and``, ``or``, ``not``, brackets, ``1 of`` and ``all of`` a pattern or ``them``.

    ``not`` binds closer than ``and``, and ``and`` than ``or``.  Names that begin with an
    underscore are not among ``them``.
    """
    tokens = _TOKEN.findall(text)
    at = 0

    def peek() -> str:
        return tokens[at].lower() if at < len(tokens) else ""

    def take(wanted: str = "") -> str:
        nonlocal at
        if at >= len(tokens) or (wanted and tokens[at].lower() != wanted):
            raise ValueError(f"condition {text!r}: {wanted or 'a name'} is missing")
        at += 1
        return tokens[at - 1]

    def some() -> Column:
        out = every()
        while peek() == "or":
            take()
            out = out | every()
        return out

    def every() -> Column:
        out = one()
        while peek() == "and":
            take()
            out = out & one()
        return out

    def one() -> Column:
        if peek() == "not":
            take()
            return ~one()
        if peek() == "(":
            take()
            out = some()
            take(")")
            return out
        if peek() in ("1", "any", "all") and at + 1 < len(tokens) and tokens[at + 1].lower() == "of":
            join = _all if take().lower() == "all" else _any
            take("of")
            pattern = take()
            found = [c for n, c in names.items() if (fnmatchcase(n, pattern) if pattern.lower() != "them" else not n.startswith("_"))]
            if not found:
                raise ValueError(f"condition {text!r}: nothing is called {pattern}")
            return join(found)
        name = take()
        if name not in names:
            raise ValueError(f"condition {text!r}: nothing is called {name}")
        return names[name]

    out = some()
    if at < len(tokens):
        raise ValueError(f"condition {text!r}: {tokens[at]!r} is not understood")
    return out


def rule_column(rule: dict, field: Field = event_field, whole: Column | None = None) -> Column:
    """Whether an event matches a rule; several conditions are alternatives."""
    parts = dict(rule["detection"])
    wanted = parts.pop("condition")
    parts.pop("timeframe", None)
    names = {k: selection(v, field, whole) for k, v in parts.items()}
    return _any([condition(c, names) for c in (wanted if isinstance(wanted, list) else [wanted])])


def techniques(rule: dict) -> list[str]:
    """The ATT&CK ids among a rule's tags."""
    return [t.partition(".")[2].upper() for t in rule.get("tags") or [] if re.match(r"attack\.t[0-9]", t)]


def matches(events: DataFrame, rules: list[dict], field: Field = event_field, keep: list[str] | None = None, whole: Column | None = None) -> DataFrame:
    """A row per event and rule that it matches: ``keep`` columns (all by default), rule_title, rule_level, techniques."""
    fact = lambda r: F.struct(F.lit(r.get("title")).alias("rule_title"), F.lit(r.get("level")).alias("rule_level"), F.lit(",".join(techniques(r))).alias("techniques"))
    hits = F.filter(F.array(*[F.when(rule_column(r, field, whole), fact(r)) for r in rules]), lambda x: x.isNotNull())
    made = ("rule_title", "rule_level", "techniques")
    return events.select(*[F.col(f"`{c}`") for c in (keep or events.columns) if c not in made], F.inline(hits))


def load(text: str) -> list[dict]:
    """The rules of a YAML text, which may hold several; documents without a detection are passed over."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml library; rules may also be given as maps") from e
    return [r for r in yaml.safe_load_all(text) if isinstance(r, dict) and "detection" in r]
