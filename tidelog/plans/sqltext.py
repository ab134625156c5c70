"""Pieces of DuckDB SQL that the catalogue's counterparts are made of."""

from __future__ import annotations

from ..functions.masking import CLASSES

HOUR, MINUTE = 3_600_000_000_000, 60_000_000_000

#: The record view over events; ids in lower-case hex.
LOGS = """logs AS (SELECT event_id AS seq, printf('%032x', event_id) AS id, epoch_us(ts) * 1000 AS ts_ns,
  (CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 WHEN 'view' THEN 5 ELSE 9 END)::SMALLINT AS severity,
  CASE event_type WHEN 'error' THEN 'warn_plus' WHEN 'purchase' THEN 'warn_plus' WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
  event_type || ' user=' || user_id || ' took ' || value || 'ms' AS body,
  event_type || ' user=<NUM> took <NUM>' AS template,
  CASE WHEN user_id % 17 <> 0 THEN 'svc-' || (user_id % 8) END AS service,
  CASE WHEN event_id % 5 <> 0 THEN printf('%032x', user_id * 1000000 + epoch_us(ts) // 3600000000) END AS trace,
  strftime(ts, '%Y-%m-%dT%H') AS hour, CAST(props->>'$.k' AS BIGINT) AS k, value, event_type, user_id, 'node-' || (event_id % 3) AS origin FROM events)"""


def with_logs(select: str, *more: str) -> str:
    return f"WITH {', '.join([LOGS, *more])} {select}"


def _hash(expr: str, shift: int, start: str = "14695981039346656037") -> str:
    """The xor-multiply hash of a text's bytes, as HUGEINT."""
    bytes_ = f"list_transform(range(1, octet_length(encode({expr})) + 1), lambda i: ('0x' || hex(encode({expr})[i:i]))::HUGEINT)"
    return f"list_reduce(list_prepend({start}::HUGEINT, {bytes_}), lambda h, c: (xor(h, c) * {2**shift + 435}) % 18446744073709551616)"


def shape_hash(expr: str) -> str:
    """The signed 64-bit id of a template text."""
    h = _hash(expr, 44)
    return f"(CASE WHEN {h} >= 9223372036854775808 THEN {h} - 18446744073709551616 ELSE {h} END)::BIGINT"


def unsigned_hash(expr: str) -> str:
    return _hash(expr, 44)


def sample(id_: str) -> str:
    """The sampling hash, of the last 16 hex digits of an id."""
    bytes_ = f"list_transform(range(0, 8), lambda i: ('0x' || substr({id_}, (17 + 2 * i)::BIGINT, 2))::HUGEINT)"
    return f"list_reduce(list_prepend(14695981039346656037::HUGEINT, {bytes_}), lambda h, c: (xor(h, c) * {2**40 + 435}) % 18446744073709551616)"


def classify(token: str) -> str:
    tests = []
    for name, pattern, least in CLASSES:
        test = f"regexp_matches({token}, '{pattern.replace(chr(39), chr(39) * 2).replace(chr(92) + chr(34), chr(34))}')"
        tests.append(f"WHEN {f'octet_length(encode({token})) >= {least} AND ' if least else ''}{test} THEN '{name}'")
    return f"CASE {' '.join(tests)} ELSE '' END"
