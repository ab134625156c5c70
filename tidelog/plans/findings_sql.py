"""Windows, budgets, findings and plans over the storm view, in DuckDB SQL: ordered state
is a fold over lists, bucket by bucket with the empty ones written out."""

from __future__ import annotations

from . import sqltext as s
from .views import NS, STORM

D = "::DOUBLE"


def storm_sql(select: str, *more: str) -> str:
    """With `storm`, and `l`, its rows with template ids."""
    ids = f"sids AS (SELECT template, {s.shape_hash('template')} AS template_id FROM (SELECT DISTINCT template FROM storm))"
    return f"WITH {', '.join([STORM, ids, 'l AS (SELECT * FROM storm JOIN sids USING (template))', *more])} {select}"


def hex16(signed: str) -> str:
    return f"lower(lpad(hex(((({signed})::HUGEINT + 18446744073709551616) % 18446744073709551616)::UBIGINT), 16, '0'))"


def _let(fields: dict[str, str], name: str, then: str) -> str:
    """`then` with a struct bound to a name."""
    return f"list_transform([{_struct(fields)}], lambda {name}: {then})[1]"


def _struct(fields: dict[str, str]) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


def _fold(items: str, body: str) -> str:
    return f"list_reduce({items}, lambda a, y: {body})"


# --- context windows -------------------------------------------------------------------

MINUTE = 60 * NS


def windows(age_ns: int, ceiling: int, per_shape: int) -> list[str]:
    """`w`, each error with its context and flow; `told`, with status and suppressed."""
    dedupe = _fold(
        "x",
        f"CASE WHEN y.ts - a.last < {MINUTE} THEN "
        + _struct({"ts": "y.ts", "id": "y.id", "last": "a.last", "n": "a.n + 1::BIGINT", "out": "list_append(a.out, {'id': y.id, 'open': false, 'folded': 0::BIGINT})"})
        + " ELSE "
        + _struct({"ts": "y.ts", "id": "y.id", "last": "y.ts", "n": "0::BIGINT", "out": "list_append(a.out, {'id': y.id, 'open': true, 'folded': a.n})"})
        + " END",
    )
    now = {"start": f"CASE WHEN y.ts - a.start >= {MINUTE} THEN y.ts ELSE a.start END", "used": f"CASE WHEN y.ts - a.start >= {MINUTE} THEN 0::BIGINT ELSE a.used END", "cur": "list_filter(a.shapes, lambda z: z.key = y.key)[1]"}
    own = {"begin": f"CASE WHEN g.cur IS NULL OR y.ts - g.cur.begin >= {MINUTE} THEN y.ts ELSE g.cur.begin END", "n": f"CASE WHEN g.cur IS NULL OR y.ts - g.cur.begin >= {MINUTE} THEN 0::BIGINT ELSE g.cur.n END"}
    shapes = "list_append(list_filter(a.shapes, lambda z: z.key <> y.key), {'key': y.key, 'begin': c.begin, 'n': c.n + %d::BIGINT})"

    def state(used: str, left: str, ok: str) -> str:
        return _struct({"ts": "y.ts", "id": "y.id", "key": "y.key", "start": "g.start", "used": used, "shapes": left, "out": f"list_append(a.out, {{'id': y.id, 'ok': {ok}}})"})

    decide = f"CASE WHEN g.used >= {ceiling} THEN {state('g.used', 'a.shapes', 'false')} WHEN c.n >= {per_shape} THEN {state('g.used', shapes % 0, 'false')} ELSE {state('g.used + 1::BIGINT', shapes % 1, 'true')} END"
    budget = _fold("x", _let(now, "g", _let(own, "c", decide)))
    return [
        f"""w AS (SELECT e.id, any_value(e.ts_ns) AS ts_ns, any_value(e.severity) AS severity, any_value(e.body) AS body, any_value(e.service) AS service, any_value(e.template_id) AS template_id, any_value(e.origin) AS origin, count(c.id) AS lines,
            string_agg(c.body, '/' ORDER BY c.ts_ns, c.id) AS bodies, CASE WHEN count(c.id) > 0 THEN string_agg(c.template_id::VARCHAR, ',' ORDER BY c.ts_ns, c.id) || '|' || any_value(e.template_id) END AS path
            FROM l e LEFT JOIN l c ON e.trace = c.trace AND c.ts_ns >= e.ts_ns - {age_ns} AND (c.ts_ns < e.ts_ns OR c.ts_ns = e.ts_ns AND c.id < e.id) AND NOT (c.body = e.body AND c.ts_ns = e.ts_ns) WHERE e.severity >= 17 GROUP BY e.id)""",
        "fl AS (SELECT origin, path, list({'ts': ts_ns, 'id': id, 'last': ts_ns, 'n': 0::BIGINT, 'out': [{'id': id, 'open': true, 'folded': 0::BIGINT}]} ORDER BY ts_ns, id) AS x FROM w WHERE path IS NOT NULL GROUP BY ALL)",
        f"dd AS (SELECT unnest({dedupe}.out) AS o FROM fl)",
        "bl AS (SELECT origin, list({'ts': ts_ns, 'id': id, 'key': coalesce(service, '') || '/' || template_id, 'start': ts_ns, 'used': 1::BIGINT, 'shapes': [{'key': coalesce(service, '') || '/' || template_id, 'begin': ts_ns, 'n': 1::BIGINT}], 'out': [{'id': id, 'ok': true}]} ORDER BY ts_ns, id) AS x FROM w JOIN dd ON w.id = dd.o.id WHERE dd.o.open GROUP BY origin)",
        f"bb AS (SELECT unnest({budget}.out) AS o FROM bl)",
        """told AS (SELECT w.*, CASE WHEN dd.o.id IS NULL THEN 'no_context' WHEN NOT dd.o.open THEN 'duplicate_flow' WHEN bb.o.ok THEN 'window' ELSE 'rate_limited' END AS status,
            CASE WHEN bb.o.ok THEN dd.o.folded ELSE 0 END AS suppressed FROM w LEFT JOIN dd ON w.id = dd.o.id LEFT JOIN bb ON w.id = bb.o.id)""",
    ]


# --- findings --------------------------------------------------------------------------

_SD = f"4{D} * sqrt(a.var)"


def _update(x: str, slow: str | None) -> dict[str, str]:
    """The baseline after x, from that of a."""
    rate = f"(CASE WHEN ({slow}) AND a.n >= 6 THEN 0.02{D} ELSE 0.2{D} END)" if slow else f"0.2{D}"
    gap = f"({x} - a.mean)"
    return {"mean": f"a.mean + {rate} * {gap}", "var": f"(1{D} - {rate}) * (a.var + {rate} * {gap} * {gap})", "n": "a.n + 1"}


def _present(least: str, spiked: str | None) -> str:
    """The fold of a key that may fall silent; blocked buckets are in y.silent."""
    rest = {"b": "y.b", "x": "y.x", "p": "y.p", "worst": "y.worst", "silent": "y.silent"}
    there = {**rest, **_update("y.x", spiked), "quiet": "0", "flag": "false", "said": "a.said", "flags": "a.flags", "spikes": f"CASE WHEN {spiked} THEN list_append(a.spikes, {{'b': y.b, 'boost': y.worst >= 13}}) ELSE a.spikes END" if spiked else "a.spikes"}
    zero = _update(f"0{D}", None)
    low = f"a.mean < {least}"
    empty = {"quiet": "a.quiet + 1", "mean": f"CASE WHEN {low} THEN {zero['mean']} ELSE a.mean END", "var": f"CASE WHEN {low} THEN {zero['var']} ELSE a.var END", "n": f"CASE WHEN {low} THEN a.n + 1 ELSE a.n END"}
    fires = f"(g.mean >= {least} AND g.quiet >= 6 AND NOT a.flag AND NOT list_contains(y.silent, y.b))"
    gone = {**rest, "mean": "g.mean", "var": "g.var", "n": "g.n", "quiet": "g.quiet", "flag": f"a.flag OR {fires}", "said": f"CASE WHEN {fires} THEN list_append(a.said, y.b) ELSE a.said END", "flags": f"CASE WHEN a.flag OR {fires} THEN list_append(a.flags, y.b) ELSE a.flags END", "spikes": "a.spikes"}
    order = ["b", "x", "p", "worst", "silent", "mean", "var", "n", "quiet", "flag", "said", "flags", "spikes"]
    return f"CASE WHEN y.p THEN {_struct({k: there[k] for k in order})} ELSE {_let(empty, 'g', _struct({k: gone[k] for k in order}))} END"


_FIRST = "{'b': b, 'x': x, 'p': p, 'worst': worst, 'silent': silent, 'mean': x, 'var': 0::DOUBLE, 'n': 1, 'quiet': 0, 'flag': false, 'said': []::BIGINT[], 'flags': []::BIGINT[], 'spikes': []::STRUCT(b BIGINT, boost BOOLEAN)[]}"


def _spikes(spiked: str, slow: str) -> str:
    after = {"b": "y.b", "x": "y.x", **_update("y.x", slow), "out": f"CASE WHEN {spiked} THEN list_append(a.out, y.b) ELSE a.out END"}
    return _fold("list({'b': b, 'x': x, 'mean': x, 'var': 0::DOUBLE, 'n': 1, 'out': []::BIGINT[]} ORDER BY b)", _struct(after)) + ".out"


def findings() -> list[str]:
    """`bf`: service, template_id, bucket, kind, detail, boost."""
    flood = f"(a.n >= 6 AND y.x >= 30 AND y.x > a.mean + {_SD} + 10 AND y.x >= 4 * a.mean)"
    warned = f"a.n >= 6 AND y.x >= 20 AND y.x > a.mean + {_SD} + 10 AND y.x >= 3 * a.mean"
    shared = f"a.n >= 6 AND y.x > a.mean + {_SD} + 0.05{D} AND y.x >= 3 * a.mean"
    moved = f"a.n >= 12 AND abs(y.x - a.mean) > 5{D} * sqrt(a.var) AND abs(y.x - a.mean) >= 0.5{D} * abs(a.mean) AND abs(y.x - a.mean) >= 1"
    every = "unnest(range(min(b), any_value(end_) + 1)) AS b"
    return [
        "k AS (SELECT *, ts_ns // 10000000000 AS bucket FROM l)",
        f"e1 AS (SELECT bucket, min(ts_ns) AS first FROM k GROUP BY bucket), e2 AS (SELECT bucket, sum(CASE WHEN coalesce(first - prior * 10000000000 > {3600 * NS}, true) THEN 1 ELSE 0 END) OVER (ORDER BY bucket) AS epoch FROM (SELECT *, lag(bucket) OVER (ORDER BY bucket) AS prior FROM e1))",
        "ep AS (SELECT epoch, min(bucket) AS begin_, CASE WHEN epoch = max(epoch) OVER () THEN max(bucket) ELSE max(bucket) - 1 END AS end_ FROM e2 GROUP BY epoch)",
        "sc AS (SELECT coalesce(service, '(no service)') AS name, epoch, end_, bucket AS b, count(*) AS total, count(*) FILTER (WHERE severity >= 17) AS errors, count(*) FILTER (WHERE severity >= 13) AS warns FROM k JOIN ep ON bucket BETWEEN begin_ AND end_ GROUP BY ALL)",
        f"""s1 AS (SELECT name, epoch, {every} FROM sc GROUP BY name, epoch), s2 AS (SELECT name, epoch, b, coalesce(total, 0)::DOUBLE AS x, total IS NOT NULL AS p, 0 AS worst, []::BIGINT[] AS silent FROM s1 LEFT JOIN sc USING (name, epoch, b))""",
        f"s3 AS (SELECT name, epoch, {_fold(f'list({_FIRST} ORDER BY b)', _present('5', None))} AS r FROM s2 GROUP BY name, epoch)",
        f"r1 AS (SELECT name, epoch, {every} FROM sc WHERE warns > 0 GROUP BY name, epoch), r2 AS (SELECT name, epoch, b, coalesce(warns, 0)::DOUBLE AS x FROM r1 LEFT JOIN sc USING (name, epoch, b))",
        f"r3 AS (SELECT name, unnest({_spikes(warned, 'y.x > 3 * a.mean')}) AS b FROM r2 GROUP BY name, epoch)",
        f"h3 AS (SELECT name, unnest(o) AS b FROM (SELECT name, {_spikes('y.ok AND ' + shared, 'y.ok AND ' + shared)} AS o FROM (SELECT * FROM sc) GROUP BY name, epoch))".replace(
            "{'b': b, 'x': x, 'mean': x,", "{'b': b, 'x': errors / total, 'ok': errors >= 5, 'mean': errors / total,"
        ).replace("{'b': y.b, 'x': y.x,", "{'b': y.b, 'x': y.x, 'ok': y.ok,").replace("(SELECT * FROM sc)", "(SELECT * FROM sc WHERE total >= 20)"),
        "tc AS (SELECT coalesce(service, '(no service)') AS name, template_id, epoch, end_, bucket AS b, count(*) AS n, max(severity) AS worst FROM k JOIN ep ON bucket BETWEEN begin_ AND end_ GROUP BY ALL)",
        f"t1 AS (SELECT name, template_id, epoch, {every} FROM tc GROUP BY name, template_id, epoch), t2 AS (SELECT t1.*, coalesce(n, 0)::DOUBLE AS x, n IS NOT NULL AS p, coalesce(worst, 0)::INTEGER AS worst, s3.r.flags AS silent FROM t1 LEFT JOIN tc USING (name, template_id, epoch, b) JOIN s3 USING (name, epoch))",
        f"t3 AS (SELECT name, template_id, {_fold(f'list({_FIRST} ORDER BY b)', _present('3', flood))} AS r FROM t2 GROUP BY name, template_id, epoch)",
        "d1 AS (SELECT coalesce(service, '(no service)') AS name, template_id, unnest(range(len(numbers))) AS slot, epoch, bucket AS b, unnest(numbers)::DOUBLE AS v FROM k JOIN ep ON bucket BETWEEN begin_ AND end_)",
        "d2 AS (SELECT name, template_id, slot, epoch, b, sum(v) / count(*) AS x FROM d1 GROUP BY ALL HAVING count(*) >= 10)",
        f"d3 AS (SELECT name, template_id, slot, unnest({_spikes(moved, moved)}) AS b FROM d2 GROUP BY name, template_id, slot, epoch)",
        """bf AS (SELECT nullif(name, '(no service)') AS service, template_id, bucket, kind, detail, boost FROM (
            SELECT name, NULL::BIGINT AS template_id, unnest(r.said) AS bucket, 'silence' AS kind, name AS detail, false AS boost FROM s3 UNION ALL SELECT name, NULL, b, 'rate', name, true FROM r3 UNION ALL SELECT name, NULL, b, 'error_share', name, true FROM h3
            UNION ALL SELECT name, template_id, unnest(r.said), 'silence', name, false FROM t3 UNION ALL SELECT name, template_id, z.b, 'template_rate', name, z.boost FROM (SELECT name, template_id, unnest(r.spikes) AS z FROM t3)
            UNION ALL SELECT name, template_id, b, 'param_drift', name || ' value ' || (slot + 1), true FROM d3))""",
    ]


def firsts(learn_ns: int) -> list[str]:
    """`ff`: novel, new_pair and flow at their records."""
    return [
        "st AS (SELECT min(ts_ns) AS t0 FROM l)",
        f"""ff AS (SELECT service, template_id, ts_ns AS at_ns, 'novel' AS kind, '' AS detail FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY ts_ns, id) AS r FROM l), st WHERE r = 1 AND ts_ns >= t0 + {learn_ns}
UNION ALL SELECT service, template_id, ts_ns, 'new_pair', '' FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY ts_ns, id) AS first_, row_number() OVER (PARTITION BY template_id, service ORDER BY ts_ns, id) AS pair_ FROM l), st WHERE pair_ = 1 AND first_ > 1 AND ts_ns >= t0 + {learn_ns}
UNION ALL SELECT service, template_id, ts_ns, 'flow', previous::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY service, previous, template_id ORDER BY ts_ns, id) AS f FROM (SELECT *, lag(template_id) OVER (PARTITION BY trace ORDER BY ts_ns, id) AS previous FROM l WHERE trace IS NOT NULL) WHERE previous <> template_id), st, (SELECT template_id AS t, arg_min(id, (ts_ns, id)) AS first_id FROM l GROUP BY ALL) WHERE t = template_id AND f = 1 AND id <> first_id AND ts_ns >= t0 + {learn_ns})""",
    ]


# --- planner ---------------------------------------------------------------------------


def planned(learn_ns: int, fidelity: int) -> list[str]:
    """`tr`, findings with said and new_boost; `pl`, rows with sent; `su`, the lead-ups."""
    boost, quiet = 300 * NS, 30 * NS
    now = {"fresh": "y.boost AND a.until <= y.told", "last": "list_filter(a.kinds, lambda z: z.kind = y.kind)[1]"}
    speak = f"(g.fresh OR NOT (g.last IS NOT NULL AND y.told - g.last.told < {quiet}))"
    after = {
        "told": "y.told", "kind": "y.kind", "boost": "y.boost", "t": "y.t", "detail": "y.detail",
        "until": f"CASE WHEN y.boost THEN greatest(a.until, y.told + {boost}) ELSE a.until END",
        "kinds": f"CASE WHEN {speak} THEN list_append(list_filter(a.kinds, lambda z: z.kind <> y.kind), {{'kind': y.kind, 'told': y.told}}) ELSE a.kinds END",
        "out": f"list_append(a.out, {{'told': y.told, 'kind': y.kind, 'boost': y.boost, 't': y.t, 'detail': y.detail, 'said': {speak}, 'new_boost': g.fresh}})",
    }
    first = f"{{'told': at_ns, 'kind': kind, 'boost': boost, 't': template_id, 'detail': detail, 'until': CASE WHEN boost THEN at_ns + {boost} ELSE 0::BIGINT END, 'kinds': [{{'kind': kind, 'told': at_ns}}], 'out': [{{'told': at_ns, 'kind': kind, 'boost': boost, 't': template_id, 'detail': detail, 'said': true, 'new_boost': boost}}]}}"
    return [
        *findings(),
        *firsts(learn_ns),
        "fd AS (SELECT service, template_id, at_ns, kind, detail, true AS boost FROM ff UNION ALL SELECT service, template_id, (bucket + 1) * 10000000000, kind, detail, boost FROM bf)",
        f"tr AS (SELECT service, o.* FROM (SELECT service, unnest({_fold(f'list({first} ORDER BY at_ns, kind, template_id NULLS LAST, detail)', _let(now, 'g', _struct(after)))}.out) AS o FROM fd GROUP BY service))",
        f"pl AS (SELECT l.*, severity >= 17 OR {s.sample('id')} % 100 < {fidelity} OR EXISTS (SELECT 1 FROM tr WHERE tr.boost AND tr.service IS NOT DISTINCT FROM l.service AND tr.told <= l.ts_ns AND l.ts_ns < tr.told + {boost}) AS sent FROM l)",
        f"su AS (SELECT id, min(told) AS at_ns, 'lookback:' || arg_min(kind, (told, kind)) AS supplement FROM pl JOIN tr ON tr.boost AND tr.said AND tr.service IS NOT DISTINCT FROM pl.service AND pl.ts_ns < tr.told AND pl.ts_ns >= tr.told - {60 * NS} WHERE NOT sent GROUP BY id)",
    ]
