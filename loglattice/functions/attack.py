"""ATT&CK techniques, tactics and kill-chain phases as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seven phases in order, and the phase of each tactic.
PHASES = ("Reconnaissance", "Weaponization", "Delivery", "Exploitation", "Installation", "Command and Control", "Actions on Objectives")
TACTIC_PHASE = {
    "reconnaissance": "Reconnaissance", "resource-development": "Weaponization", "initial-access": "Delivery",
    "execution": "Exploitation", "exploitation": "Exploitation", "privilege-escalation": "Installation",
    "persistence": "Installation", "defense-evasion": "Installation", "stealth": "Installation",
    "defense-impairment": "Installation", "credential-access": "Exploitation", "discovery": "Exploitation",
    "lateral-movement": "Actions on Objectives", "collection": "Actions on Objectives",
    "command-and-control": "Command and Control", "exfiltration": "Actions on Objectives", "impact": "Actions on Objectives",
}

#: Public ATT&CK names and tactics of the techniques in use; ``read_bundle`` gives a full map.
TECHNIQUES = {
    "T1003": ("OS Credential Dumping", ["credential-access"]),
    "T1003.001": ("LSASS Memory", ["credential-access"]),
    "T1021": ("Remote Services", ["lateral-movement"]),
    "T1021.002": ("SMB/Windows Admin Shares", ["lateral-movement"]),
    "T1021.005": ("VNC", ["lateral-movement"]),
    "T1041": ("Exfiltration Over C2 Channel", ["exfiltration"]),
    "T1059": ("Command and Scripting Interpreter", ["execution"]),
    "T1059.001": ("PowerShell", ["execution"]),
    "T1070.001": ("Clear Windows Event Logs", ["defense-evasion"]),
    "T1071": ("Application Layer Protocol", ["command-and-control"]),
    "T1071.001": ("Web Protocols", ["command-and-control"]),
    "T1071.004": ("DNS", ["command-and-control"]),
    "T1078": ("Valid Accounts", ["defense-evasion", "initial-access", "persistence", "privilege-escalation"]),
    "T1105": ("Ingress Tool Transfer", ["command-and-control"]),
    "T1110": ("Brute Force", ["credential-access"]),
    "T1204.002": ("Malicious File", ["execution"]),
    "T1486": ("Data Encrypted for Impact", ["impact"]),
    "T1543.003": ("Windows Service", ["persistence", "privilege-escalation"]),
    "T1546.012": ("Image File Execution Options Injection", ["persistence", "privilege-escalation"]),
    "T1547": ("Boot or Logon Autostart Execution", ["persistence", "privilege-escalation"]),
    "T1547.001": ("Registry Run Keys / Startup Folder", ["persistence", "privilege-escalation"]),
    "T1547.005": ("Security Support Provider", ["persistence", "privilege-escalation"]),
    "T1566": ("Phishing", ["initial-access"]),
    "T1566.001": ("Spearphishing Attachment", ["initial-access"]),
    "T1569.002": ("Service Execution", ["execution"]),
    "T1571": ("Non-Standard Port", ["command-and-control"]),
}


def _map(items: dict[str, str | int | list[str]]) -> Column:
    flat: list[Column] = []
    for k, v in items.items():
        flat += [F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)]
    return F.create_map(*flat)


def load_table(path: str) -> dict[str, tuple[str, list[str]]]:
    """The technique table of a STIX bundle in a JSON file."""
    with open(path, encoding="utf-8") as f:
        return read_bundle(json.load(f).get("objects", []))


def read_bundle(objects: list[dict]) -> dict[str, tuple[str, list[str]]]:
    """A technique table from the objects of a STIX bundle; revoked and deprecated ones are left out."""
    out = {}
    for o in objects:
        ref = next((r["external_id"] for r in o.get("external_references", []) if r.get("source_name") == "mitre-attack" and "external_id" in r), None)
        if o.get("type") == "attack-pattern" and ref and not o.get("revoked") and not o.get("x_mitre_deprecated"):
            out[ref] = (o.get("name", ref), [p["phase_name"] for p in o.get("kill_chain_phases", []) if p.get("kill_chain_name") == "mitre-attack"])
    return out


def split_techniques(c: Column) -> Column:
    """Well-formed technique ids of a separated list, upper-case, each once, in order."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,|;]"), lambda x: F.upper(F.regexp_replace(F.trim(x), r"^\.+|\.+$", "")))
    return F.array_distinct(F.filter(parts, lambda x: x.rlike(r"^T[0-9]+(\..*)?$")))


def tactics_of(ids: Column, table: dict | None = None) -> Column:
    """Tactics of an array of ids in order; a sub-technique that isn't in the table takes its parent's."""
    known = _map({k: v[1] for k, v in (table or TECHNIQUES).items()})
    of = F.transform(ids, lambda t: F.coalesce(F.try_element_at(known, t), F.try_element_at(known, F.substring_index(t, ".", 1)), F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(of))


def technique_name(tid: Column, table: dict | None = None) -> Column:
    """The name of a technique; null where the table has none."""
    return F.try_element_at(_map({k: v[0] for k, v in (table or TECHNIQUES).items()}), tid)


def phase_of_tactic(c: Column) -> Column:
    return F.try_element_at(_map(TACTIC_PHASE), F.lower(F.trim(c)))


def phase_order(c: Column) -> Column:
    """1 to 7 along the chain, 0 for none."""
    return F.coalesce(F.try_element_at(_map({p: k + 1 for k, p in enumerate(PHASES)}), c), F.lit(0))


def deepest_order(tactics: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(tactics, lambda t: phase_order(phase_of_tactic(t)))), F.lit(0))


def phase_at(order: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, PHASES)), F.nullif(order, F.lit(0)))
