"""CVSS base scores, risk matrix, indicator kinds, compliance duties and detection rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions import addresses
from loglattice.functions import normalize as n

# Fixed values of the CVSS v3.1 specification.
_AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
_AC = {"L": 0.77, "H": 0.44}
_PR = {"N": 0.85, "L": 0.62, "H": 0.27}
_PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}
_UI = {"N": 0.85, "R": 0.62}
_CIA = {"H": 0.56, "L": 0.22, "N": 0.0}
V4_METRICS = {"AV": "NALP", "AC": "LH", "AT": "NP", "PR": "NLH", "UI": "NPA", "VC": "HLN", "VI": "HLN", "VA": "HLN", "SC": "HLN", "SI": "HLN", "SA": "HLN"}


def _weight(table: dict[str, float], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def severity(score: Column) -> Column:
    return F.when(score == 0, "None").when(score < 4, "Low").when(score < 7, "Medium").when(score < 9, "High").when(score.isNotNull(), "Critical")


def _metrics(vector: Column, prefix: str) -> Column:
    return F.when(vector.startswith(prefix), F.str_to_map(F.regexp_replace(vector, f"^{prefix}", ""), F.lit("/"), F.lit(":")))


def cvss31(vector: Column) -> Column:
    """struct(score, severity) of a v3.1 base vector; nulls where a metric is missing or unknown."""
    m = _metrics(vector, "CVSS:3.1/")
    changed = m["S"] == "C"
    isc = 1 - (1 - _weight(_CIA, m["C"])) * (1 - _weight(_CIA, m["I"])) * (1 - _weight(_CIA, m["A"]))
    impact = F.when(changed, 7.52 * (isc - 0.029) - 3.25 * F.pow(isc - 0.02, F.lit(15.0))).when(m["S"] == "U", 6.42 * isc)
    exploit = 8.22 * _weight(_AV, m["AV"]) * _weight(_AC, m["AC"]) * F.when(changed, _weight(_PR_CHANGED, m["PR"])).otherwise(_weight(_PR, m["PR"])) * _weight(_UI, m["UI"])
    raw = F.least(F.when(changed, 1.08 * (impact + exploit)).otherwise(impact + exploit), F.lit(10.0))
    # Round up to a tenth, on whole hundred-thousandths as the specification says.
    whole = F.round(raw * 100_000).cast("bigint")
    up = F.when(whole % 10_000 == 0, whole / 100_000.0).otherwise((F.floor(whole / 10_000) + 1) / 10.0)
    score = F.when(impact <= 0, 0.0 * exploit).otherwise(F.when(impact.isNotNull() & exploit.isNotNull(), up))
    return F.struct(score.alias("score"), severity(score).alias("severity"))


def cvss40_valid(vector: Column) -> Column:
    """Whether a v4.0 vector has all base metrics with known values; no score is computed."""
    m = _metrics(vector, "CVSS:4.0/")
    return F.coalesce(reduce(lambda a, b: a & b, [F.coalesce(m[k].isin(*v), F.lit(False)) for k, v in V4_METRICS.items()]), F.lit(False))


def risk(likelihood: Column, impact: Column, scale: int = 5) -> Column:
    """struct(product, level) of a likelihood and an impact from 1 to ``scale``."""
    p = likelihood * impact
    share = p / float(scale * scale)
    ok = likelihood.between(1, scale) & impact.between(1, scale)
    level = F.when(share <= 0.16, "low").when(share <= 0.36, "medium").when(share <= 0.64, "high").otherwise("critical")
    return F.struct(F.when(ok, p).alias("product"), F.when(ok, level).alias("level"))


INTERNAL_NAMES = r"(?i)\.(local|localdomain|lan|internal|intranet|corp|home|test|example|invalid|localhost)$"
_DOMAIN = r"(?i)^(?=.{1,253}$)([a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?\.)+[a-z]([a-z0-9-]{0,61}[a-z0-9])$"


def indicator_kind(c: Column) -> Column:
    """ip, hash, domain or unknown."""
    s = F.trim(c)
    return F.when(s.rlike(addresses.IPV4) | addresses.digits_v6(s).isNotNull(), "ip").when(n.canon_hash(s).isNotNull(), "hash").when(s.rlike(_DOMAIN), "domain").otherwise("unknown")


def is_public(c: Column) -> Column:
    """Whether an indicator may be looked up outside: public addresses, hashes, names that aren't internal."""
    kind = indicator_kind(c)
    return F.when(kind == "ip", n.is_public_ip(c)).when(kind == "hash", F.lit(True)).when(kind == "domain", ~F.trim(c).rlike(INTERNAL_NAMES)).otherwise(F.lit(False))


def annotate(df: DataFrame, col: str) -> DataFrame:
    kind, public = indicator_kind(F.col(col)), is_public(F.col(col))
    reason = F.when(kind == "unknown", "not an indicator").when(~public, "internal, never sent out")
    return df.withColumns({"indicator_kind": kind, "public": public, "skip_reason": reason})


def obligations(incidents: DataFrame, rules: list[dict]) -> DataFrame:
    """Incidents with each duty whose triggers all hold: (incident columns, norm, duty, deadline_hours).

    A trigger is a column with a value that it must equal, or a list that it must be in.
    """

    def holds(when: dict) -> Column:
        tests = [F.col(k).isin(*v) if isinstance(v, list) else F.col(k) == F.lit(v) for k, v in when.items()]
        return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))

    one = [F.when(holds(r.get("when", {})), F.struct(F.lit(r["norm"]).alias("norm"), F.lit(r["duty"]).alias("duty"), F.lit(r.get("deadline_hours")).cast("int").alias("deadline_hours"))) for r in rules]
    return incidents.select(*incidents.columns, F.inline(F.filter(F.array(*one), lambda x: x.isNotNull())))


def obligations_summary(duties: DataFrame, key: str) -> DataFrame:
    return duties.groupBy(key).agg(F.count(F.lit(1)).alias("duties"), F.array_join(F.array_sort(F.collect_set("norm")), ", ").alias("norms"), F.min("deadline_hours").alias("first_deadline_hours"), F.min_by("duty", F.coalesce("deadline_hours", F.lit(2**31 - 1))).alias("most_urgent"))


#: A small set of public breach notification duties.
RULES = [
    {"norm": "GDPR", "duty": "notify the supervisory authority", "deadline_hours": 72, "when": {"personal_data": True}},
    {"norm": "GDPR", "duty": "tell the persons concerned", "when": {"personal_data": True, "risk": ["high", "critical"]}},
    {"norm": "NIS2", "duty": "early warning", "deadline_hours": 24, "when": {"significant": True, "sector": ["energy", "transport", "health", "digital"]}},
    {"norm": "NIS2", "duty": "incident notification", "deadline_hours": 72, "when": {"significant": True, "sector": ["energy", "transport", "health", "digital"]}},
]


def detection(selections: list[dict[str, str | list[str]]]) -> Column:
    """A Sigma-like predicate: all selections; in one, all fields; of a field's values, any.

    Field keys may end in ``|contains``, ``|startswith``, ``|endswith`` or ``|re``; comparison ignores case.
    """

    def field(key: str, values: str | list[str]) -> Column:
        name, _, how = key.partition("|")
        c = F.lower(F.col(name).cast("string"))
        tests = {"contains": lambda v: c.contains(v.lower()), "startswith": lambda v: c.startswith(v.lower()), "endswith": lambda v: c.endswith(v.lower()), "re": lambda v: F.col(name).rlike(v), "": lambda v: c == str(v).lower()}
        return reduce(lambda a, b: a | b, [tests[how](v) for v in (values if isinstance(values, list) else [values])])

    every = [field(k, v) for s in selections for k, v in s.items()]
    return F.coalesce(reduce(lambda a, b: a & b, every), F.lit(False))
