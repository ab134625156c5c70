"""Plain lines as records: LEVEL<tab>message, logfmt fields, raw lines and their levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masking import words_of
from ..functions.severity import INFO, from_text
from .records import ATTRIBUTES, attr

#: Heads that name a level before a tab.
HEADS = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "WARNING": 13, "ERROR": 17, "FATAL": 21, "CRITICAL": 21}
PREFIX_WORDS = 12


def trace_bytes(value: Column) -> Column:
    """16 bytes of a trace id: its 32 hex digits, or two hashes of any other text."""
    low = F.lpad(F.lower(F.hex(F.xxhash64(value))), 16, "0")
    high = F.lpad(F.lower(F.hex(F.xxhash64(value, F.lit("trace")))), 16, "0")
    return F.unhex(F.when(value.rlike("^[0-9A-Fa-f]{32}$"), value).otherwise(F.concat(high, low)))


def new_event_id(now_ns: Column, *content: Column) -> Column:
    """A time-ordered id: milliseconds, then bits of a hash of what the record holds and
    where it stands, so that a retried task makes the same one."""
    stamp = F.lpad(F.hex(F.call_function("div", now_ns, F.lit(1_000_000).cast("long"))), 12, "0")
    rest = F.md5(F.concat_ws("\x1f", *(c.cast("string") for c in content)))
    return F.unhex(F.concat(stamp, F.lit("7"), F.substring(rest, 1, 3), F.lit("8"), F.substring(rest, 4, 15)))


def level_in_line(line: Column) -> Column:
    """The level that a line's prefix names: among its first words, before the first
    key=value; null if there is none."""
    words = F.slice(words_of(line), 1, PREFIX_WORDS)
    pair = F.transform(words, lambda w: F.instr(w, "=") > 1)
    stop = F.array_position(pair, F.lit(True)).cast("int")
    prefix = F.when(stop > 0, F.slice(words, 1, stop - 1)).otherwise(words)
    level = F.transform(prefix, lambda w: from_text(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return F.try_element_at(F.filter(level, lambda v: v.isNotNull()), F.lit(1))


def _record(df: DataFrame, now_ns: int, severity: Column, body: Column, key: Column, **more: Column) -> DataFrame:
    null = {"severity_text": "string", "service": "string", "trace_id": "binary", "span_id": "binary", "template_id": "long", "origin": "string"}
    now = F.lit(now_ns).cast("long")
    given = {"event_id": new_event_id(now, body, key), "timestamp_ns": now, "observed_ns": now, "severity": severity.cast("short"), "body": body}
    given |= {k: F.lit(None).cast(t) for k, t in null.items()} | {"attributes": F.array().cast(ATTRIBUTES)} | more
    names = ["event_id", "timestamp_ns", "observed_ns", "severity", "severity_text", "body", "service", "trace_id", "span_id", "template_id", "attributes", "origin"]
    return df.select(*(given[n].alias(n) for n in names))


def parse_lines(lines: DataFrame, now_ns: int, line: str = "value") -> DataFrame:
    """Lines of standard input or a file. A known LEVEL before a tab is the level; service,
    trace and request ids come from key=value words, the last one of each."""
    text, key = F.col(line), F.monotonically_increasing_id()
    head = F.upper(F.trim(F.substring_index(text, "\t", 1)))
    known = text.contains("\t") & head.isin(list(HEADS))
    severity = F.lit(INFO)
    for n in sorted(set(HEADS.values())):
        severity = F.when(known & head.isin([w for w, k in HEADS.items() if k == n]), n).otherwise(severity)
    body = F.when(known, F.substr(text, F.instr(text, "\t") + 1)).otherwise(text)
    pairs = F.transform(F.filter(words_of(body), lambda w: w.contains("=")), lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.substr(w, F.instr(w, "=") + 1).alias("v")))

    def last(*names: str) -> Column:
        return F.try_element_at(F.filter(pairs, lambda p: p["k"].isin(list(names))), F.lit(-1))["v"]

    asked = F.transform(F.filter(pairs, lambda p: p["k"].isin("request_id", "req_id", "session_id")), lambda p: attr("request_id", "Str", p["v"]))
    service = F.regexp_replace(last("service", "svc"), '^"+|"+$', "")
    return _record(lines, now_ns, severity, body, key, service=service, trace_id=trace_bytes(last("trace_id", "trace")), attributes=asked)


def parse_raw(bodies: DataFrame, now_ns: int, body: str = "value", query: str | None = None) -> DataFrame:
    """Raw request bodies: an event per line that isn't blank, metadata from a query string
    (host, source, sourcetype, index; sourcetype is the service)."""
    each = bodies.select(*([F.col(query).alias("__q")] if query else []), F.posexplode(F.split(F.col(body), r"\r?\n")).alias("__i", "__line")).where(F.trim("__line") != "")
    level = F.coalesce(level_in_line(F.col("__line")), F.lit(INFO))
    more = {}
    if query:
        meta = query_pairs(F.col("__q"))
        get = lambda k: F.try_element_at(F.filter(meta, lambda p: p["key"] == k), F.lit(-1))["value"]
        found = F.array(*(F.when(get(k).isNotNull(), attr(k, "Str", get(k))) for k in ("host", "source", "sourcetype", "index")))
        more = {"service": get("sourcetype"), "attributes": F.filter(found, lambda a: a.isNotNull())}
    return _record(each, now_ns, level, F.col("__line"), F.concat_ws("/", F.monotonically_increasing_id(), "__i"), **more)


def percent_decoded(text: Column) -> Column:
    """%XX and + as in query strings; a % without two hex digits stays."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_pairs(query: Column) -> Column:
    """Pairs of a query string, decoded; a part without = has an empty value."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    value = lambda p: F.when(p.contains("="), F.substr(p, F.instr(p, "=") + 1)).otherwise("")
    return F.transform(parts, lambda p: F.struct(percent_decoded(F.substring_index(p, "=", 1)).alias("key"), percent_decoded(value(p)).alias("value")))


def glob_pattern(glob: str) -> str:
    """A shell pattern (*, ?, [class]) as a regular expression for rlike."""
    import re

    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inside = glob[i + 1 : end]
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def tail(spark, path: str, glob: str = "*", now_ns: int = 0) -> DataFrame:
    """A streaming source of the lines of files that match a glob; the checkpoint holds
    what has been read."""
    return parse_lines(spark.readStream.option("pathGlobFilter", glob).text(path), now_ns)
