"""Canonical spellings of entities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.functions import addresses

# Names that are on every system and so identify nothing.
GENERIC_USERS = ("system", "local service", "network service", "local system", "anonymous logon", "iusr", "-", "n/a", "na", "unknown", "null", "dwm", "umfd", "font driver host", "window manager")
GENERIC_USER_PREFIXES = ("dwm-", "umfd-")
GENERIC_FILES = ("svchost.exe", "cmd.exe", "powershell.exe", "explorer.exe", "lsass.exe", "services.exe", "rundll32.exe", "regsvr32.exe", "wmiprvse.exe", "conhost.exe", "taskhostw.exe", "dllhost.exe", "csrss.exe", "winlogon.exe", "spoolsv.exe", "msiexec.exe", "searchindexer.exe", "smss.exe", "userinit.exe")
GENERIC_HOSTS = ("localhost", "-", "n/a", "na", "unknown", "null", "::1")
GENERIC_DOMAINS = ("localhost", "wpad", "-", "n/a")
GENERIC_DOMAIN_SUFFIX = ".arpa"
HASH_LENGTHS = (32, 40, 64, 128)

IPV4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _before_last(c: Column, sep: str) -> Column:
    return F.regexp_extract(c, r"^(.*)" + sep, 1)


def canon_user(c: Column) -> Column:
    """The account without realm: local part of a UPN, after the last backslash or slash, lower-case."""
    local = F.substring_index(F.trim(c), "@", 1)
    return blank_to_null(F.lower(F.trim(F.substring_index(F.substring_index(local, "\\", -1), "/", -1))))


def user_domain(c: Column) -> Column:
    """The realm: after the first at sign, else before the last backslash, else before the last slash."""
    s = F.trim(c)
    realm = (
        F.when(s.contains("@"), F.regexp_extract(s, r"^[^@]*@(.*)$", 1))
        .when(s.contains("\\"), _before_last(s, r"\\"))
        .when(s.contains("/"), _before_last(s, "/"))
    )
    return blank_to_null(F.lower(F.regexp_replace(F.trim(realm), r"^\.+|\.+$", "")))


def is_machine_user(c: Column) -> Column:
    return F.coalesce(canon_user(c).endswith("$"), F.lit(False))


def is_generic_user(c: Column) -> Column:
    u = canon_user(c)
    prefixed = F.lit(False)
    for p in GENERIC_USER_PREFIXES:
        prefixed |= u.startswith(p)
    return F.coalesce(u.endswith("$") | u.isin(*GENERIC_USERS) | prefixed, F.lit(True))


def _host(c: Column) -> Column:
    return blank_to_null(F.lower(F.regexp_replace(F.trim(c), r"\.+$", "")))


def _is_address(h: Column) -> Column:
    return h.rlike(IPV4) | h.contains(":")


def canon_host(c: Column) -> Column:
    """The first label, lower-case; addresses stay whole."""
    h = _host(c)
    return blank_to_null(F.when(_is_address(h), h).otherwise(F.substring_index(h, ".", 1)))


def host_domain(c: Column) -> Column:
    h = _host(c)
    return blank_to_null(F.when(_is_address(h), F.lit(None)).otherwise(F.regexp_extract(h, r"^[^.]*\.(.*)$", 1)))


def is_generic_host(c: Column) -> Column:
    return F.coalesce(canon_host(c).isin(*GENERIC_HOSTS), F.lit(True))


def realms_conflict(realms: Column) -> Column:
    """Whether an array of realms has more than one first label."""
    return F.size(F.array_distinct(F.transform(F.filter(realms, lambda r: r != ""), lambda r: F.substring_index(r, ".", 1)))) > 1


def canon_hash(c: Column) -> Column:
    h = F.substring_index(F.lower(F.trim(c)), "=", -1)
    return F.when(h.rlike("^[0-9a-f]+$") & F.length(h).isin(*HASH_LENGTHS), h)


def canon_domain(c: Column) -> Column:
    return blank_to_null(F.lower(F.regexp_replace(F.trim(c), r"\.+$", "")))


def is_generic_domain(c: Column) -> Column:
    d = canon_domain(c)
    return F.coalesce(d.isin(*GENERIC_DOMAINS) | d.endswith(GENERIC_DOMAIN_SUFFIX), F.lit(True))


def canon_file(c: Column) -> Column:
    path = F.regexp_replace(F.translate(F.trim(c), "\\", "/"), "/+$", "")
    return blank_to_null(F.lower(F.substring_index(path, "/", -1)))


def is_generic_file(c: Column) -> Column:
    return F.coalesce(canon_file(c).isin(*GENERIC_FILES), F.lit(True))


def source_family(c: Column) -> Column:
    """The tool that a source names: what is before the first colon."""
    return blank_to_null(F.lower(F.trim(F.substring_index(c, ":", 1))))


def is_generic_ip(c: Column) -> Column:
    """Addresses that point to no one machine: invalid, loopback, unspecified, link-local, multicast, reserved."""
    return addresses.generic(c)


def is_public_ip(c: Column) -> Column:
    return addresses.public(c)


def parse_ts(c: Column) -> Column:
    """ISO times with their offset, 9 to 11 digit epochs as seconds, other times as UTC; else null."""
    return F.when(
        c.rlike(r"^[0-9]{9,11}(\.[0-9]+)?$"), F.timestamp_micros((c.try_cast("double") * 1e6).try_cast("bigint"))
    ).otherwise(c.try_cast("timestamp"))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
