"""Request bodies as records: collector events, OTLP in JSON and protobuf, envelopes, peer
lines. Framing and nested JSON are decoded in Arrow batches, one body a row."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.severity import INFO, WORDS
from ..shipping import ship
from .records import RECORD

_level = {w: n for n, words in WORDS.items() for w in words}
LEVEL_KEYS = ("severity", "level", "log_level", "loglevel")
Attr = tuple[str, str, object]  # key, kind, value


def level_of(text) -> int | None:
    return _level.get(text.strip().lower()) if isinstance(text, str) else None


def level_in_line(line: str) -> int | None:
    for w in line.split()[:12]:
        if w.find("=") > 0:
            return None
        n = level_of(re.sub(r"^[\W_]+|[\W_]+$", "", w))
        if n is not None:
            return n
    return None


def _compact(v) -> str:
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def json_attr(key: str, v) -> Attr:
    if isinstance(v, str):
        return key, "Str", v
    if isinstance(v, bool):
        return key, "Bool", v
    if isinstance(v, int) and -(2**63) <= v < 2**63:
        return key, "I64", v
    if isinstance(v, (int, float)):
        return key, "F64", float(v)
    return key, "Str", _compact(v)


def put(attrs: list[Attr], one: Attr) -> None:
    """Replaces the attribute of the key, or adds it."""
    for i, a in enumerate(attrs):
        if a[0] == one[0]:
            attrs[i] = one
            return
    attrs.append(one)


def record(now: int, body: str, severity: int = INFO, **more) -> dict:
    return {"timestamp_ns": now, "observed_ns": now, "severity": severity, "severity_text": None, "body": body, "service": None, "trace_id": None, "span_id": None, "template_id": None, "attributes": [], "origin": None} | more


def _row(r: dict, source: str, at: int) -> dict:
    kinds = ("Str", "I64", "F64", "Bool")
    given = [{"key": k, "value": {x: (v if x == kind else None) for x in kinds}} for k, kind, v in r["attributes"]]
    h = hashlib.blake2b(f"{at}\x1f{source}".encode(), digest_size=10).digest()
    stamp = (r["observed_ns"] // 1_000_000 % (1 << 48)).to_bytes(6, "big")
    return r | {"attributes": given, "event_id": stamp + bytes([0x70 | h[0] & 15, h[1], 0x80 | h[2] & 63]) + h[3:]}


Parse = Callable[[str | bytes], list[dict]]


def _source(body: str | bytes, request: str | None) -> str:
    return f"{request}\x1e{body if isinstance(body, str) else body.hex()}"


def decoded(bodies: DataFrame, parse: Parse, body: str = "value", request: str | None = None) -> DataFrame:
    """A record for each that parse() finds in each body; a body that it refuses (raises
    ValueError) has none here and a row in refused(). Ids come from the body, the record's
    place in it and the column `request`, which tells equal bodies of different requests
    apart; without one they are the same records."""
    ship(bodies.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, number in zip(pdf["__body"], pdf["__request"]):
                try:
                    found = parse(text) if text is not None else []
                except ValueError:
                    found = []
                rows += [_row(r, _source(text, number), i) for i, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=RECORD.names).astype({"severity": "int16"}) if rows else pd.DataFrame(columns=RECORD.names)

    number = F.col(request).cast("string") if request else F.lit("")
    return bodies.select(F.col(body).alias("__body"), number.alias("__request")).mapInPandas(run, RECORD)


def refused(bodies: DataFrame, parse: Parse, body: str = "value") -> DataFrame:
    """The bodies that parse() refuses: body_hash (SHA-256), bytes, reason."""
    ship(bodies.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["__body"]:
                try:
                    parse(text) if text is not None else []
                except ValueError as e:
                    data = text.encode() if isinstance(text, str) else bytes(text)
                    rows.append((hashlib.sha256(data).hexdigest(), len(data), f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["body_hash", "bytes", "reason"])

    return bodies.select(F.col(body).alias("__body")).mapInPandas(run, "body_hash string, bytes long, reason string")


# --- collector events ------------------------------------------------------------------


def event_time(v) -> int | None:
    """Seconds or, from 1e11 on, milliseconds; nothing at or below 0."""
    try:
        x = float(v) if isinstance(v, (int, float, str)) and not isinstance(v, bool) else None
    except ValueError:
        return None
    if x is None or not x > 0:
        return None
    return int(x * (1e6 if x >= 1e11 else 1e9))


def collector_events(text: str, now: int, defaults: dict[str, str] | None = None) -> list[dict]:
    """JSON objects one after another; ValueError if any is none or has no event."""
    decode, at, out = json.JSONDecoder(), 0, []
    text = text.lstrip()
    if not text:
        raise ValueError("no data")
    while at < len(text):
        o, at = decode.raw_decode(text, at)
        while at < len(text) and text[at].isspace():
            at += 1
        if not isinstance(o, dict) or o.get("event") in (None, ""):
            raise ValueError("an event is required")
        event = o["event"]
        body = event if isinstance(event, str) else _compact(event)
        r = record(now, body, timestamp_ns=event_time(o.get("time")) or now)
        for given in (defaults or {}, o):
            for k in ("host", "source", "sourcetype", "index"):
                if isinstance(given.get(k), str):
                    put(r["attributes"], (k, "Str", given[k]))
                    if k == "sourcetype":
                        r["service"] = given[k]
        for k, v in (o["fields"].items() if isinstance(o.get("fields"), dict) else ()):
            put(r["attributes"], json_attr(k, v))
        named = [next((v for a, kind, v in r["attributes"] if a.lower() == k and kind == "Str"), None) for k in LEVEL_KEYS]
        named += [event[k] for k in LEVEL_KEYS if isinstance(event, dict) and k in event]
        level = next((n for n in map(level_of, named) if n is not None), None)
        if level is None and isinstance(event, str):
            level = level_in_line(event)
        r["severity"] = INFO if level is None else level
        r["severity_text"] = next((v for v in named if level_of(v) is not None), None)
        out.append(r)
    return out


# --- OTLP ------------------------------------------------------------------------------


def _id(data: bytes, n: int) -> bytes | None:
    return data if len(data) == n and any(data) else None


def _otlp_record(now: int, time: int, observed: int, number: int, text: str | None, body: str, attrs: list[Attr], trace: bytes, span: bytes, event: str | None) -> dict:
    seen = observed or now
    level = min(number, 24) if number else (level_of(text) or INFO)
    if event:
        attrs.append(("event.name", "Str", event))
    return record(seen, body, level, timestamp_ns=time or seen, severity_text=text or None, attributes=attrs, trace_id=_id(trace, 16), span_id=_id(span, 8))


def _rendered(kind: str, v) -> str:
    if kind == "Bool":
        return "true" if v else "false"
    if kind == "F64":
        return repr(v)[:-2] if repr(v).endswith(".0") else repr(v)
    return "" if v is None else str(v)


def _finish(records: list[dict], scope: str | None, resource: list[Attr]) -> list[dict]:
    service = next((v for k, kind, v in resource if k == "service.name" and kind == "Str"), None)
    for r in records:
        r["service"] = service
        r["attributes"] += ([("otel.scope.name", "Str", scope)] if scope else []) + resource
    return records


def _get(o: dict, camel: str):
    """A field in either name style."""
    snake = re.sub(r"[A-Z]", lambda m: "_" + m[0].lower(), camel)
    return o[camel] if camel in o else o.get(snake)


def _json_value(v) -> tuple[str, object]:
    if not isinstance(v, dict) or not v:
        return "Str", ""
    for name, kind, as_ in (("stringValue", "Str", str), ("boolValue", "Bool", bool), ("intValue", "I64", int), ("doubleValue", "F64", float)):
        if (x := _get(v, name)) is not None:
            return kind, as_(x)
    if (x := _get(v, "bytesValue")) is not None:
        return "Str", base64.b64decode(x).hex()
    if (x := _get(v, "arrayValue")) is not None:
        return "Str", "[" + ",".join(_rendered(*_json_value(e)) for e in x.get("values", [])) + "]"
    if (x := _get(v, "kvlistValue")) is not None:
        return "Str", "{" + " ".join(f"{e['key']}={_rendered(*_json_value(e.get('value')))}" for e in x.get("values", []) if e.get("key")) + "}"
    return "Str", ""


def _json_attrs(items) -> list[Attr]:
    return [(a["key"], *_json_value(a.get("value"))) for a in items or [] if a.get("key")]


def otlp_json(text: str, now: int) -> list[dict]:
    root = json.loads(text)
    if not isinstance(root, dict):
        raise ValueError("not an object")
    out = []
    for rl in _get(root, "resourceLogs") or []:
        resource = _json_attrs((rl.get("resource") or {}).get("attributes"))
        for sl in _get(rl, "scopeLogs") or []:
            records = []
            for r in _get(sl, "logRecords") or []:
                records.append(
                    _otlp_record(
                        now, int(_get(r, "timeUnixNano") or 0), int(_get(r, "observedTimeUnixNano") or 0), int(_get(r, "severityNumber") or 0), _get(r, "severityText"), _rendered(*_json_value(r.get("body"))),
                        _json_attrs(r.get("attributes")), bytes.fromhex(_get(r, "traceId") or ""), bytes.fromhex(_get(r, "spanId") or ""), _get(r, "eventName"),
                    )
                )
            out += _finish(records, (sl.get("scope") or {}).get("name") or None, resource)
    return out


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if i >= len(b) or shift > 63:
            raise ValueError("a cut number")
        n |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if b[i - 1] < 128:
            return n & 0xFFFFFFFFFFFFFFFF, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        wire = tag & 7
        if wire == 0:
            v, i = _varint(b, i)
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            v, i = b[i : i + n], i + n
        elif wire == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
            if len(v) != n:
                raise ValueError("a cut message")
        else:
            raise ValueError("an unknown wire type")
        yield tag >> 3, v


def _u64(v) -> int:
    return int.from_bytes(v, "little") if isinstance(v, bytes) else v


def _proto_value(b: bytes) -> tuple[str, object]:
    out: tuple[str, object] = ("Str", "")
    for f, v in _fields(b):
        if f == 1:
            out = "Str", v.decode()
        elif f == 2:
            out = "Bool", bool(v)
        elif f == 3:
            out = "I64", v - (1 << 64) if v >> 63 else v
        elif f == 4:
            out = "F64", struct.unpack("<d", v)[0]
        elif f == 5:
            out = "Str", "[" + ",".join(_rendered(*_proto_value(e)) for g, e in _fields(v) if g == 1) + "]"
        elif f == 6:
            out = "Str", "{" + " ".join(f"{k}={_rendered(kind, x)}" for k, kind, x in _proto_attrs(e for g, e in _fields(v) if g == 1)) + "}"
        elif f == 7:
            out = "Str", v.hex()
    return out


def _proto_attrs(items) -> list[Attr]:
    out = []
    for b in items:
        key, value = "", ("Str", "")
        for f, v in _fields(b):
            key, value = (v.decode(), value) if f == 1 else (key, _proto_value(v) if f == 2 else value)
        if key:
            out.append((key, *value))
    return out


def otlp_protobuf(data: bytes, now: int) -> list[dict]:
    out = []
    for _, rl in (x for x in _fields(bytes(data)) if x[0] == 1):
        parts = list(_fields(rl))
        resource = _proto_attrs(b for f, r in parts if f == 1 for g, b in _fields(r) if g == 1)
        for sl in (v for f, v in parts if f == 2):
            inner, records = list(_fields(sl)), []
            scope = next((n.decode() for f, s in inner if f == 1 for g, n in _fields(s) if g == 1 and n), None)
            for r in (v for f, v in inner if f == 2):
                got: dict[int, object] = {}
                attrs = []
                for f, v in _fields(r):
                    got[f] = v
                    if f == 6:
                        attrs.append(v)
                text = lambda k: got[k].decode() if got.get(k) else None  # noqa: B023, E731
                body = _rendered(*_proto_value(got[5])) if 5 in got else ""
                records.append(_otlp_record(now, _u64(got.get(1, 0)), _u64(got.get(11, 0)), _u64(got.get(2, 0)), text(3), body, _proto_attrs(attrs), got.get(9, b""), got.get(10, b""), text(12)))
            out += _finish(records, scope, resource)
    return out


# --- envelopes -------------------------------------------------------------------------

#: Item types, and the category that limits each.
CATEGORIES = {
    "event": "error", "transaction": "transaction", "session": "session", "sessions": "session", "attachment": "attachment", "client_report": "default", "check_in": "monitor",
    "profile": "profile", "replay_event": "replay", "replay_recording": "replay", "log": "log_item",
}
MOST_ITEMS = 1000


def envelope(data: bytes) -> tuple[dict, list[tuple[dict, bytes]]]:
    """Header and items (header, payload); ValueError where the framing is broken."""
    if not data:
        raise ValueError("an empty body")
    line, _, rest = data.partition(b"\n")
    head = json.loads(line)
    if not isinstance(head, dict):
        raise ValueError("the header is no object")
    items = []
    while rest.strip(b"\n"):
        if len(items) >= MOST_ITEMS:
            raise ValueError("too many items")
        line, _, rest = rest.partition(b"\n")
        h = json.loads(line)
        if not isinstance(h, dict):
            raise ValueError("an item header is no object")
        n = h.get("length")
        if isinstance(n, int) and not isinstance(n, bool) and n >= 0:
            if len(rest) < n:
                raise ValueError("an item is cut")
            payload, rest = rest[:n], rest[n:].removeprefix(b"\n")
        else:
            payload, _, rest = rest.partition(b"\n")
        items.append((h, payload))
    return head, items


def _at(v, *path):
    for p in path:
        v = v.get(p) if isinstance(v, dict) else None
    return v


def event_summary(v: dict) -> str:
    values = _at(v, "exception", "values")
    if isinstance(values, list) and values:
        last = values[-1] if isinstance(values[-1], dict) else {}
        kind = last["type"] if isinstance(last.get("type"), str) else "Error"
        return f"{kind}: {last['value']}" if isinstance(last.get("value"), str) and last["value"] else kind
    for text in (_at(v, "logentry", "formatted"), _at(v, "logentry", "message"), v.get("message")):
        if isinstance(text, str) and text:
            return text
    return "sentry event"


def _hex(text, n: int) -> bytes | None:
    clean = re.sub("[^0-9A-Fa-f]", "", text) if isinstance(text, str) else ""
    return bytes.fromhex(clean) if len(clean) == 2 * n else None


def envelope_records(data: bytes, now: int, project: str, key: str = "") -> list[dict]:
    head, items = envelope(bytes(data))
    out = []
    for h, payload in items:
        kind = h["type"] if isinstance(h.get("type"), str) else ""
        v = None
        if kind != "attachment":
            try:
                v = json.loads(payload)
            except ValueError:
                pass
        attrs: list[Attr] = [("sentry.project", "Str", project), ("sentry.key", "Str", key), ("sentry.item_type", "Str", kind)]
        if isinstance(head.get("event_id"), str):
            attrs.append(("sentry.event_id", "Str", head["event_id"]))
        r = record(now, f"{kind} item", service=f"sentry:{project}", attributes=attrs)
        if isinstance(v, dict) and kind in ("event", "transaction"):
            stamp = v.get("timestamp")
            if isinstance(stamp, (int, float)) and not isinstance(stamp, bool):
                r["timestamp_ns"] = int(stamp * 1e9)
            r["trace_id"], r["span_id"] = _hex(_at(v, "contexts", "trace", "trace_id"), 16), _hex(_at(v, "contexts", "trace", "span_id"), 8)
            if kind == "transaction":
                r["body"] = f"transaction {v['transaction'] if isinstance(v.get('transaction'), str) else '?'}"
            else:
                level = v.get("level")
                r |= {"severity": level_of(level) or 17, "severity_text": level if isinstance(level, str) else None, "body": event_summary(v)}
                for name in ("release", "environment", "platform", "server_name", "transaction"):
                    if isinstance(v.get(name), str):
                        attrs.append((f"sentry.{name}", "Str", v[name]))
                if isinstance(v.get("server_name"), str):
                    r["service"] = v["server_name"]
        elif kind == "attachment":
            r["body"] = f"attachment {len(payload)} bytes"
            attrs.append(("sentry.attachment_bytes", "I64", len(payload)))
        if kind != "attachment":
            attrs.append(("sentry.payload", "Str", payload.decode("utf-8", "replace")))
        out.append(r)
    return out


def envelope_of(attributes: dict[str, str], new_id: str) -> tuple[str, bytes] | None:
    """Project and envelope that a stored record came from; None if it holds none."""
    payload, project = attributes.get("sentry.payload"), attributes.get("sentry.project")
    if payload is None or project is None:
        return None
    head = _compact({"event_id": attributes.get("sentry.event_id", new_id)})
    data = payload.encode()
    return project, f'{head}\n{{"type":"{attributes.get("sentry.item_type", "event")}","length":{len(data)}}}\n'.encode() + data


def wrap_store_body(body: bytes, new_id: str) -> bytes:
    """A legacy JSON body as an envelope of one event."""
    try:
        id_ = json.loads(body).get("event_id")
    except (ValueError, AttributeError):
        id_ = None
    head = _compact({"event_id": id_ if isinstance(id_, str) else new_id})
    return f'{head}\n{{"type":"event","length":{len(body)},"content_type":"application/json"}}\n'.encode() + body


def rate_limits(headers: DataFrame, header: str, at_secs: str) -> DataFrame:
    """`secs:category;category:...` lists as category to the latest time it is limited
    until; no category means all."""
    each = headers.select(F.col(at_secs).alias("at"), F.explode(F.split(header, ",")).alias("one"))
    part = F.split(F.trim("one"), ":")
    secs = F.get(part, 0).try_cast("double")
    names = F.filter(F.split(F.coalesce(F.get(part, 1), F.lit("")), ";"), lambda c: c != "")
    names = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("all")))
    rows = each.where(secs.isNotNull()).select((F.col("at") + F.ceil(secs)).alias("until"), F.explode(names).alias("category"))
    return rows.groupBy("category").agg(F.max("until").alias("until"))


def peer_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Records that a peer sent, one JSON object a line."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RECORD).replace("event_id binary", "event_id string").replace("trace_id binary", "trace_id string").replace("span_id binary", "span_id string")
    r = lines.select(F.from_json(line, schema).alias("r")).where("r.body is not null").select("r.*")
    for c in ("event_id", "trace_id", "span_id"):
        r = r.withColumn(c, F.unhex(c))
    return r.select(*RECORD.names)


def to_peer_lines(logs: DataFrame) -> DataFrame:
    cols = [F.lower(F.hex(c)).alias(c) if c in ("event_id", "trace_id", "span_id") else F.col(c) for c in RECORD.names]
    return logs.select(F.to_json(F.struct(*cols)).alias("value"))
