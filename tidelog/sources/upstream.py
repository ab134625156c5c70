"""Addresses and credentials of issue trackers, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dsn(text: Column) -> Column:
    """scheme, key, host, project of scheme://key[:secret]@host/project; null for others."""
    pattern = r"^([^:/]+)://([^:@]+)(:.*)?@(.+)/([^/]+)/*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("scheme"), part(2).alias("key"), part(4).alias("host"), part(5).alias("project")))


def envelope_url(d: Column, project: Column | None = None) -> Column:
    return F.concat(d["scheme"], F.lit("://"), d["host"], F.lit("/api/"), d["project"] if project is None else project, F.lit("/envelope/"))


def auth_header(text: Column) -> Column:
    """key, client and version of an authentication header; null without a key."""
    rest = F.regexp_extract(F.trim(text), r"(?i)^sentry\s*(.*)$", 1)
    get = lambda name: F.nullif(F.trim(F.regexp_extract(rest, rf'(?i)(?:^|,)\s*sentry_{name}\s*=\s*"?([^",]*)', 1)), F.lit(""))
    return F.when(get("key").isNotNull(), F.struct(get("key").alias("key"), get("client").alias("client"), get("version").alias("version")))


def target(mode: str, client_key: Column, client_project: Column, configured: Column, override: Column, relay_host: Column | None = None) -> Column:
    """Where an envelope goes: the project's override; relayed with the client's own key;
    or signed anew with the configured address."""
    own = lambda d: F.struct(envelope_url(d).alias("url"), d["key"].alias("key"), d["project"].alias("project"))
    if mode == "relay":
        host = configured if relay_host is None else F.coalesce(relay_host, configured)
        rest = F.when(host.isNotNull(), F.struct(envelope_url(host, client_project).alias("url"), client_key.alias("key"), client_project.alias("project")))
    else:
        rest = F.when(configured.isNotNull(), own(configured))
    return F.when(override.isNotNull(), own(override)).otherwise(rest)
