"""The flat event schema: names and types of the columns that sources fill, and its fingerprint."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = """ts source category action outcome host user_name process_name cmdline parent_name pid src_ip dst_ip
dns_query transport protocol logon_type url http_method file_name file_path file_hash file_hash_md5 message
techniques rule_title rule_level rule_file rule_name url_domain url_path dns_answer dns_response_code
tls_server_name tls_ja3 tls_version registry_key registry_value registry_data registry_hive registry_type
rule_description ioc_description ioc_severity tactics_declared file_hash_sha256 file_hash_sha1 parent_pid user_id
host_os agent_id""".split()
_TYPES = {"event_code": T.IntegerType(), "src_port": T.IntegerType(), "dst_port": T.IntegerType(), "http_status": T.IntegerType(), "bytes": T.LongType(), "sigma_community": T.BooleanType()}

RAW = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.StringType()) for c in _STRINGS], *[T.StructField(c, t) for c, t in _TYPES.items()]])

#: Dotted keys of the common schema whose column name isn't the key with underscores.
DOTTED = {
    "@timestamp": "ts", "event.source": "source", "event.category": "category", "event.action": "action", "event.code": "event_code",
    "event.outcome": "outcome", "host.name": "host", "user.name": "user_name", "process.name": "process_name",
    "process.command_line": "cmdline", "process.parent.name": "parent_name", "process.pid": "pid", "source.ip": "src_ip",
    "source.port": "src_port", "destination.ip": "dst_ip", "destination.port": "dst_port", "dns.question.name": "dns_query",
    "network.transport": "transport", "network.protocol": "protocol", "network.bytes": "bytes", "url.original": "url",
    "http.request.method": "http_method", "http.response.status_code": "http_status", "attack.techniques": "techniques",
    "attack.tactics": "tactics_declared", "process.parent.pid": "parent_pid", "user.id": "user_id", "host.os": "host_os",
}


#: Columns outside the schema that readers may add and ``conform`` keeps: a record's text as it was read, its file and place, and why it could not be read.
CARRIED = ("original", "origin", "pos", "reason")


def column_of(key: str) -> str:
    return DOTTED.get(key, key.replace(".", "_"))


def fingerprint(schema: T.StructType = RAW) -> str:
    """Twelve hex digits that change with any column's name or type."""
    return hashlib.sha256(";".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields).encode()).hexdigest()[:12]


def number(c: str, kind: str) -> F.Column:
    """A whole number from any spelling, truncated towards zero; junk is null."""
    return F.expr(f"try_cast(try_cast(trim(cast(`{c}` as string)) as double) as {kind})")


def conform(df: DataFrame, keep: tuple[str, ...] = CARRIED) -> DataFrame:
    """``df`` in the event schema: missing columns null, numbers cleaned, others but ``keep`` dropped."""
    have = set(df.columns)
    out = []
    for f in RAW.fields:
        if f.name not in have:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.LongType)) and not isinstance(df.schema[f.name].dataType, (T.IntegerType, T.LongType)):
            out.append(number(f.name, f.dataType.simpleString()).alias(f.name))
        elif isinstance(df.schema[f.name].dataType, T.ArrayType):
            out.append(F.array_join(F.col(f.name), ",").alias(f.name))
        else:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*out, *[c for c in keep if c in have])


def _keys_of(column: str) -> list[str]:
    """The keys under which a record of the common schema may hold a column's value."""
    return list(dict.fromkeys([*(k for k, c in DOTTED.items() if c == column), column, column.replace("_", ".")]))


def _value(record: F.Column, key: str) -> F.Column:
    """A field's text by its dotted key, as one key or as objects in one another; lists are joined by commas."""
    paths = [f"$['{key}']"] + ([f"$.{key}"] if "." in key else [])
    text = F.coalesce(*[F.try_variant_get(record, p, "string") for p in paths])
    return F.when(text.startswith("["), F.array_join(F.from_json(text, "array<string>"), ",")).otherwise(text)


def flat(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Raw events of records of the common schema, a VARIANT column; ``CARRIED`` columns stay."""
    record = F.col(record_col)
    found = {f.name: F.coalesce(*[_value(record, k) for k in _keys_of(f.name)]) for f in RAW.fields if f.name != "id"}
    typed = {k: F.expr(f"try_cast(`{k}` as boolean)") for k, t in _TYPES.items() if isinstance(t, T.BooleanType)}
    return conform(records.select(*[v.alias(k) for k, v in found.items()], *[c for c in CARRIED if c in records.columns]).withColumns(typed))
