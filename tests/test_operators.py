"""Mining, context, findings, typed columns, policy, against their rules."""

from __future__ import annotations

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelog.functions.hashing import shape_hash_of
from tidelog.functions.masking import mask_line
from tidelog.operators import catalog, context, dictionary, forward, mining, planner, policy, rollup, scan, shapes, signals, suggestions, typed
from tidelog.plans import catalogue
from tidelog.sources import records
from tidelog.sources.records import RECORD

S = 1_000_000_000


def logs(spark, rows):
    """(seconds, severity, body, service, trace, template, attributes)"""
    out = []
    for i, r in enumerate(rows):
        t, sev, body, service, trace, template, attrs = (*r, *[None] * (7 - len(r)))
        given = [{"key": k, "value": {x: v if x == kind else None for x in ("Str", "I64", "F64", "Bool")}} for k, kind, v in attrs or []]
        ns = int(t * S)
        out.append((i.to_bytes(16, "big"), ns, ns, sev, None, body, service, trace.to_bytes(16, "big") if trace else None, None, template, given, "n"))
    return spark.createDataFrame(out, RECORD)


def miner(*texts, **config):
    m = mining.Miner(mining.MinerConfig(**config))
    return m, [m.add(mask_line(t)[0]) for t in texts]


def test_one_shape():
    m, got = miner(*(f"user {i} logged in from 10.0.0.{i}" for i in range(50)))
    assert len(m.templates) == 1 and got[0] == (1, True) and set(got[1:]) == {(1, False)}
    assert m.templates[1].text == "user <NUM> logged in from <IP>" and m.ids[1] == shape_hash_of(m.templates[1].text)


def test_short_lines_must_agree_and_long_ones_widen():
    m, got = miner("cache miss for alpha", "cache miss for beta")
    assert len(m.templates) == 2
    long = "a b c d e f g h i j k"
    m, got = miner(f"{long} alpha", f"{long} beta", f"{long} gamma")
    assert len(m.templates) == 1 and m.templates[1].text == f"{long} <*>"
    assert m.templates[1].lineage_id == shape_hash_of(f"{long} alpha") and len(m.shapes) == 2


def test_ties_go_to_the_newest_and_lengths_part():
    assert mining.similarity(["a", "<NUM>"], ["a", "<NUM>"]) == 1.0 and mining.similarity(["<NUM>"], ["<IP>"]) == 1.0 and mining.similarity(["a"], ["a", "b"]) == 0.0
    m, got = miner("1 2", "10.0.0.1 2", "x")
    assert got == [(1, True), (1, False), (2, True)] and m.templates[1].text == "<*> <NUM>"


def test_a_widened_shape_is_minted_again():
    long = "a b c d e f g h i j k"
    m, _ = miner(f"{long} alpha", f"{long} beta")
    tokens = f"{long} alpha".split()
    assert m.add(tokens) == (1, False)
    again = mining.Miner(known=[mining.Template(1, tokens, shape_hash_of(" ".join(tokens)))])
    again.templates[1].tokens = ["q"] * 12
    number, new = again.add(tokens)
    assert new and again.templates[number].lineage_id == shape_hash_of(f"{' '.join(tokens)}\x1f{number}")


def test_cap_and_empty_lines():
    m, got = miner(*(f"shape{'x' * i} word" for i in range(1, 8)), "", max_templates=3)
    assert len(m.templates) == 3 and m.untemplated == 4 and got[-1] == (None, False) and m.seen == 8


def test_full_nodes_share_a_branch():
    m, _ = miner(*(f"{c} one two" for c in "abcdef"), max_children=3)
    assert len(m.roots[3].children) == 4 and len(m.templates) == 6


@pytest.mark.parametrize("exact", [False, True])
def test_mined_rows(spark, exact):
    r = random.Random(0)
    bodies = [r.choice(["user {} in", "disk {} full on /dev/sd{}", "[api] call {} took {}ms", "retry", ""]).format(r.randrange(99), r.randrange(9)) for _ in range(300)]
    df = logs(spark, [(i, 9, b, f"s{i % 2}") for i, b in enumerate(bodies)]).drop("template_id")
    rows = mining.mine_templates(df, ["service"], ["observed_ns", "event_id"], exact=exact).collect()
    ms = {f"s{k}": mining.Miner() for k in (0, 1)}
    for x in sorted(rows, key=lambda x: x.observed_ns):
        m = ms[x.service]
        number, new = m.add(mask_line(x.body)[0])
        assert (x.template_id, x.is_new) == (m.ids.get(number), new)
        assert x.template == (m.templates[number].text if number else None)
    assert len(rows) == 300


def replayed(rows, config=mining.MinerConfig()):
    """Event time to (template_id, template, is_new): every line in arrival order, one miner
    for each service."""
    ms, out = {}, {}
    for x in sorted(rows, key=lambda x: x.observed_ns):
        tokens = mask_line(x.body)[0]
        m = ms.setdefault(x.service, mining.Miner(config))
        number, new = m.add(tokens)
        out[x.observed_ns] = (m.ids.get(number), m.templates[number].text if number else None, new)
    return out


def test_repeats_carry_the_widened_template(spark):
    line = "one two three four five six seven eight nine {} {}"
    bodies = [line.format(a, b) for a, b in (("ten", "k"), ("ten", "k"), ("alpha", "k"), ("ten", "k"), ("ten", "m"), ("ten", "k"), ("alpha", "k"))]
    df = logs(spark, [(i, 9, b, "s") for i, b in enumerate(bodies)]).drop("template_id")
    rows = {x.observed_ns: x for x in mining.mine_templates(df, ["service"], ["observed_ns", "event_id"]).collect()}
    assert [rows[t].template.split(" ")[9:] for t in sorted(rows)] == [["ten", "k"]] * 2 + [["<*>", "k"]] * 2 + [["<*>", "<*>"]] * 3
    assert [rows[t].params for t in sorted(rows)] == [[], [], ["alpha"], ["ten"], ["ten", "m"], ["ten", "k"], ["alpha", "k"]]
    assert {t: (x.template_id, x.template, x.is_new) for t, x in rows.items()} == replayed(rows.values())


@pytest.mark.parametrize("scope", [[], ["service"]])
def test_the_cap_holds_over_all_token_counts(spark, scope):
    """Against one miner for each scope that sees every line."""
    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(t, 9, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3]))), r.choice(["a", "b"])) for t in range(300)]
    config = mining.MinerConfig(max_templates=12)
    miners: dict = {}
    want = []
    for t, _, body, service in rows:
        m = miners.setdefault(service if scope else 0, mining.Miner(config))
        number, new = m.add(mask_line(body)[0])
        want.append((t * S, m.templates[number].text if number else None, new))
    out = mining.mine_templates(logs(spark, rows), scope, ["observed_ns", "event_id"], config=config)
    assert sorted(((x.observed_ns, x.template, x.is_new) for x in out.collect()), key=str) == sorted(want, key=str)
    assert mining.untemplated(out).first().n == sum(m.untemplated for m in miners.values()) > 0


@pytest.mark.parametrize("seed,config", [(s, c) for s in range(3) for c in ({}, {"similarity": 0.5}, {"similarity": 0.5, "max_templates": 3}, {"similarity": 0.4, "max_children": 2}, {"similarity": 2.0})])
def test_mining_equals_a_replay_of_every_line(spark, seed, config):
    r = random.Random(seed)
    words = [["a", "b", "c"][: r.randrange(1, 4)] for _ in range(6)]
    bodies = [" ".join(r.choice(w) for w in words[: r.choice([4, 6, 6])]) for _ in range(400)] + ["", None]
    df = logs(spark, [(i, 9, b, f"s{i % 3}" if i % 3 else None) for i, b in enumerate(bodies) if b is not None]).drop("template_id")
    rows = mining.mine_templates(df, ["service"], ["observed_ns", "event_id"], config=mining.MinerConfig(**config)).collect()
    assert len(rows) == 401
    assert {x.observed_ns: (x.template_id, x.template, x.is_new) for x in rows} == replayed(rows, mining.MinerConfig(**config))


class Plain(mining.Miner):
    """Compares a line with every template of its leaf."""

    def _near(self, node, tokens):
        return list(node.templates) if node else []


@pytest.mark.parametrize("like", [2.0, 0.9, 0.8, 0.5, 0.0])
def test_lines_meet_all_templates_that_may_be_alike(like):
    r = random.Random(like)
    config = mining.MinerConfig(similarity=like, max_children=4, max_templates=None)
    quick, plain, met, there = mining.Miner(config), Plain(config), 0, 0
    for _ in range(3000):
        line = [f"{c}{r.randrange(2)}" for c in "abcdefghijklmnopqrstuvwxyz"[: r.choice([1, 2, 3, 4, 5, 9, 20, 26])]]
        for k in range(len(line)):
            if r.random() < 0.1:
                line[k] = r.choice(["<NUM>", "<*>", "x", "y"])
        leaf = quick._leaf(line)
        met, there = met + len(quick._near(leaf, line)), there + len(leaf.templates if leaf else [])
        assert quick.add(line) == plain.add(line)
    assert {n: (t.tokens, t.count) for n, t in quick.templates.items()} == {n: (t.tokens, t.count) for n, t in plain.templates.items()}
    assert met < there or like < 0.9


def test_free_text_has_no_cap(spark, tmp_path):
    """More texts of a role than the log engine's 10,000 templates."""
    n = mining.MinerConfig().max_templates + 50
    turns = spark.range(n).selectExpr("id AS conv_id", "0 AS turn", "'user' AS role", "translate(concat_ws(' ', id, 7 * id, 'and', 11 * id), '0123456789', 'abcdefghij') AS text")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalogue.queries()["mined_texts"](spark, str(tmp_path)).agg(F.count("template"), F.count_if("is_new")).first()
    assert tuple(got) == (n, n)


def test_correlation_keys(spark):
    a = [("request_id", "Str", "r1")]
    rows = context.correlation_key(
        logs(spark, [(0, 9, "x", "api", 5), (0, 9, "x", "api", None, None, a), (0, 9, "x", None, None, None, [("session_id", "I64", 7)]), (0, 9, "x", "api", None, None, [("host", "Str", "h"), ("pid", "I64", 3), ("thread", "Str", "t")]), (0, 9, "x", "api", None, None, [("pid", "I64", 3)])])
    ).orderBy("event_id").collect()
    assert [(r.key_tier, r.key) for r in rows] == [("trace", f"{5:032x}"), ("request", "api/r1"), ("request", "/7"), ("thread", "h/3/t"), ("service", "/api")]


def test_context_age_count_and_self(spark):
    rows = [(t, 9, f"line {t}", "api") for t in range(0, 40)] + [(39.5, 17, "boom", "api"), (39.5, 9, "boom", "api"), (39.2, 9, "other", "web")]
    got = context.windows(logs(spark, rows), lines=5).collect()
    assert len(got) == 1 and [c.body for c in got[0].context] == [f"line {t}" for t in range(35, 40)]
    wide = context.windows(logs(spark, rows)).collect()[0]
    assert [c.body for c in wide.context] == [f"line {t}" for t in range(10, 40)]


def naive_capture(errors):
    """Dedupe, then the ceiling per minute, then per shape; one by one."""
    flows, start, used, shapes, out = {}, None, 0, {}, []
    for now, flow, service, template in errors:
        folded = 0
        if flow in flows:
            last, n = flows[flow]
            if now - last < 60 * S:
                flows[flow] = (last, n + 1)
                out.append(("duplicate_flow", 0))
                continue
            folded = n
        flows[flow] = (now, 0)
        if start is None or now - start >= 60 * S:
            start, used = now, 0
        if used >= 30:
            out.append(("rate_limited", 0))
            continue
        key = (service or "", template or 0)
        begin, n = shapes.get(key, (now, 0))
        if now - begin >= 60 * S:
            begin, n = now, 0
        if n >= 3:
            shapes[key] = (begin, n)
            out.append(("rate_limited", 0))
            continue
        shapes[key] = (begin, n + 1)
        used += 1
        out.append(("window", folded))
    return out


def test_dedupe_and_budgets(spark):
    r = random.Random(4)
    t, rows, want = 0.0, [], []
    for i in range(400):
        t += r.choice([0.2, 1, 4, 30])
        service, template, flow = r.choice([None, "a", "b"]), r.choice([None, 1, 2, 3]), r.randrange(25)
        origin = r.choice([None, "n1", "n2"])
        rows.append((i.to_bytes(16, "big"), int(t * S), service, template, flow, origin))
        want.append((origin, (int(t * S), flow, service, template)))
    df = spark.createDataFrame(rows, "event_id binary, observed_ns long, service string, template_id long, flow_hash long, origin string")
    got = context.captured(df).orderBy("event_id").collect()
    for node in (None, "n1", "n2"):  # each has budgets of its own
        assert [(x.status, x.suppressed) for x in got if x.origin == node] == naive_capture([w for o, w in want if o == node])
    none = context.captured(df.withColumn("flow_hash", F.lit(None).cast("long"))).collect()
    assert {x.status for x in none} == {"no_context"} and len(none) == 400


def naive_service(counts, end):
    """Bucket after bucket, with every empty one."""
    mean = var = 0.0
    n = quiet = 0
    flagged, seen, out = False, False, []

    def update(x):
        nonlocal mean, var, n
        if n == 0:
            mean, var = x, 0.0
        else:
            d = x - mean
            mean += 0.2 * d
            var = 0.8 * (var + 0.2 * d * d)
        n += 1

    for b in range(end + 1):
        if b in counts:
            seen, quiet, flagged = True, 0, False
            update(float(counts[b]))
        elif seen:
            quiet += 1
            if mean < 5:
                update(0.0)
            if mean >= 5 and quiet >= 6 and not flagged:
                flagged = True
                out.append(b)
            if quiet >= 360 and mean < 5:
                seen, mean, var, n, quiet, flagged = False, 0.0, 0.0, 0, 0, False
    return out


@pytest.mark.parametrize("seed", range(5))
def test_service_silence(seed):
    r = random.Random(seed)
    counts, b = {}, 0
    while b < 3000:
        counts[b] = r.choice([1, 4, 9, 30])
        b += r.choice([1, 1, 1, 2, 5, 8, 40, 500])
    got = [x[0] for x in signals.service_rows(sorted(counts.items()), 3500, "s")[0]]
    assert got == naive_service(counts, 3500)


def naive_rate(counts, end):
    out, base, seen = [], signals.Baseline(), False
    for b in range(end + 1):
        seen = seen or b in counts
        if seen:
            x = float(counts.get(b, 0))
            if base.n >= 6 and x >= 20 and x > base.mean + 4 * base.sd + 10 and x >= 3 * base.mean:
                out.append(b)
            base.update(x, x > 3 * base.mean)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_rate(seed):
    r = random.Random(seed)
    counts = {b: r.choice([2, 3, 5, 80]) if r.random() < 0.1 else 3 for b in range(2500) if r.random() < 0.6}
    assert [x[0] for x in signals.rate_rows(sorted(counts.items()), 2600, "s")] == naive_rate(counts, 2600)


def test_template_flood_and_silence():
    steady = [(b, 5, 9) for b in range(20)]
    assert signals.template_rows([*steady, (20, 200, 13)], 20, "t", []) == [(20, "template_rate", "t", True)]
    assert signals.template_rows([*steady, (20, 200, 9)], 20, "t", []) == [(20, "template_rate", "t", False)]
    assert signals.template_rows(steady, 40, "t", []) == [(25, "silence", "t", False)]
    assert signals.template_rows(steady, 40, "t", [(20, 40)]) == []
    assert signals.template_rows([(b, 1, 9) for b in range(20)], 60, "t", []) == []


def test_error_share_and_drift():
    calm = [(b, 100, 2) for b in range(10)]
    assert signals.share_rows([*calm, (10, 100, 60)], "s") == [(10, "error_share", "s", True)]
    assert signals.share_rows([*calm, (10, 19, 19)], "s") == []
    even = [(b, 100.0 + b % 2, 10) for b in range(14)]
    assert signals.drift_rows([*even, (14, 900.0, 10)], "p") == [(14, "param_drift", "p", True)]
    assert signals.drift_rows([*even, (14, 900.0, 9)], "p") == []


def test_findings_of_a_storm(spark):
    rows = [(t / 2, 9, f"step took {t % 7}ms", "api", None, 1) for t in range(400)] + [(200 + t / 50, 17, "boom", "api", None, 2) for t in range(300)]
    found = {(r.kind, r.template_id) for r in signals.findings(logs(spark, rows)).collect()}
    assert {("error_share", None), ("novel", 2)} <= found
    assert ("new_pair", 2) not in found


def test_sessions(spark):
    r = random.Random(9)
    rows, t = [], 0
    for i in range(500):
        t += r.choice([0, 1, 30, 59, 60, 61, 4000]) * S
        rows.append((i.to_bytes(16, "big"), t, r.choice(["a", None])))
    got = sorted((x.event_id, x.session) for x in context.sessions(spark.createDataFrame(rows, "event_id binary, observed_ns long, o string"), 60 * S, "o").collect())
    want, last, number = [], {}, {}
    for id_, t, o in rows:
        if o not in last or t - last[o] >= 60 * S:
            number[o] = number.get(o, 0) + 1
        last[o] = t
        want.append((id_, number[o]))
    assert got == want


def test_detectors_start_anew_after_a_stall(spark):
    """As if ticks came with records: an hour without any says nothing about the traffic."""
    steady = [(t / 5, 9, "x", "api", None, 1) for t in range(1000)]
    later = [(200 + 3700 + t / 5, 9, "x", "web", None, 2) for t in range(1000)]
    kinds = lambda rows: {(x.kind, x.service) for x in signals.bucket_findings(logs(spark, rows)).collect()}
    assert kinds(steady + later) == set()
    assert ("silence", "api") in kinds(steady + [(r[0] - 3500, *r[1:]) for r in later])


def test_a_hot_service_is_dealt_by_template(spark):
    rows = [(t / 20, 9, f"step {t}", "api" if t % 10 else "web", None, t % 40) for t in range(4000)]
    counts = signals.template_counts(logs(spark, rows)).where("service = 'api'").groupBy("template_id").count().collect()
    assert max(r["count"] for r in counts) <= 0.2 * sum(r["count"] for r in counts)


def test_firsts(spark):
    rows = [(0, 9, "a", "x", 1, 1), (10, 9, "b", "x", 1, 2), (100, 9, "a", "y", 2, 1), (110, 9, "b", "x", 3, 2), (120, 9, "a", "x", 3, 1), (130, 9, "c", "x", 3, 3), (140, 9, "a", "x", 4, 1), (150, 9, "a", "x", 4, 1)]
    got = sorted((r.kind, r.service, r.template_id, r.observed_ns // S) for r in signals.first_findings(logs(spark, rows)).collect())
    assert got == [("flow", "x", 1, 120), ("new_pair", "y", 1, 100), ("novel", "x", 3, 130)]


def test_planner(spark):
    rows = [(t, 9, "calm", "api", None, 1) for t in range(300)] + [(200.5, 9, "new", "api", None, 2)] + [(t + 0.1, 9, "calm", "web", None, 1) for t in range(300)]
    df = logs(spark, rows)
    told = planner.triggers(signals.first_findings(df).select("service", "template_id", F.col("observed_ns").alias("at_ns"), "kind", "detail", "boost"))
    out = planner.plan(df, told, 0).collect()
    assert len(out) == len(rows)
    assert {r.sent for r in out if r.service == "api" and r.observed_ns >= 200.5 * S} == {True}
    assert not any(r.sent for r in out if r.service == "web" or r.observed_ns < 200.5 * S)
    lead = planner.supplements(planner.plan(df, told, 0), told).collect()
    assert len(lead) == 60 and {r.supplement for r in lead} == {"lookback:novel"}
    assert planner.markers(told, planner.supplements(planner.plan(df, told, 0), told)).count() == 1
    rolls = rollup.minute_rollups(df.where("severity < 0").unionByName(planner.plan(df, told, 0).where("not sent").drop("sent")))
    assert rolls.agg(F.sum("count")).first()[0] + sum(r.sent for r in out) == len(rows)


def test_quiet_periods():
    pdf = pd.DataFrame({"at_ns": [0, 10 * S, 20 * S, 40 * S, 400 * S], "kind": ["rate", "rate", "flow", "rate", "rate"], "boost": [True, True, False, True, True], "template_id": [0] * 5, "detail": [""] * 5})
    out = planner._triggers(pdf)
    assert list(out.said) == [True, False, True, True, True] and list(out.new_boost) == [True, False, False, False, True]


def test_loops(spark):
    def a(*x):
        return [(0, 9, "b", None, None, None, list(x))]

    cases = [a(), a(("tidelog.origin", "Str", "me")), a(("tidelog.origin", "Str", "you")), a(("tidelog.hops", "I64", 8)), a(("tidelog.hops", "Str", "7")), a(("tidelog.hops", "Str", "x")), a(("tidelog.hops", "I64", -1)), a(("tidelog.origin", "I64", 4)), a(("tidelog.origin", "Str", "you"), ("tidelog.origin", "Str", "you")), a(("tidelog.origin", "Str", ""))]
    df = logs(spark, [c[0] for c in cases])
    got = [r.l for r in df.select("event_id", context.is_loop(F.col("attributes"), "me").alias("l")).orderBy("event_id").collect()]
    assert got == [False, True, False, True, False, True, True, True, True, True]
    sent = forward.stamped(df, "me").orderBy("event_id").collect()
    hops = [next(x.value.I64 for x in r.attributes if x.key == "tidelog.hops") for r in sent]
    assert hops[0] == 1 and hops[3] == 8 and hops[4] == 8


def test_running_sums(spark):
    r = random.Random(1)
    rows = [(i.to_bytes(16, "big"), r.randrange(0, 20_000) * S, r.choice(["a", "b", None]), r.randrange(9)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id binary, observed_ns long, o string, w int")
    for of in ((), ("o",)):
        want, sums = [], {}
        for id_, _, o, w in sorted(rows, key=lambda x: (x[1], x[0])):
            key = o if of else 0
            want.append((id_, sums.get(key, 0)))
            sums[key] = sums.get(key, 0) + w
        assert sorted((bytes(x.event_id), x.before) for x in shapes.running(df, "before", F.col("w"), *of).collect()) == sorted(want)


def test_strided_statistics_and_repeated_keys(spark):
    rows = [(t, 9, "x", "api", None, 1, [("k", "I64", t), ("k", "Str", "later")]) for t in range(100)]
    (got,) = typed.key_statistics(logs(spark, rows), 10, ["observed_ns", "event_id"]).collect()
    assert (got.sampled, got.present, got.ints, got.strings, got.rows) == (10, 10, 10, 0, 100)


def test_column_names():
    assert typed.column_name("http.Status-Code") == "attr_http_status_code" and typed.column_name("é1") == "attr___1"
    assert typed.column_name("") is None and typed.column_name("x" * 65) is None and typed.column_name("._-") is None


def attrs(spark, n=400):
    rows = []
    for i in range(n):
        a = [("latency_ms", "I64", i), ("route", "Str", "/x"), ("hit", "Bool", i % 2 == 0), ("ratio", "F64" if i % 3 else "I64", i * 0.5 if i % 3 else i), ("started", "Str", "2024-01-02T03:04:05Z"), ("mixed", "I64" if i % 2 else "Str", i if i % 2 else "s"), ("blob", "Str", "y" * 300)]
        rows.append((i, 9, "b", "api", None, None, a + ([("rare", "I64", 1)] if i % 10 == 0 else [])))
    return logs(spark, rows)


def test_promotion(spark):
    df = attrs(spark)
    got = {c.key: c.type for c in typed.plan(df)}
    assert got == {"latency_ms": "int64", "route": "string", "hit": "bool", "ratio": "float64", "started": "timestamp"}
    assert typed.plan(attrs(spark, 100)) == []
    two = typed.plan(df, config=typed.TypedConfig(max_per_service=2))
    assert [c.key for c in two] == ["hit", "latency_ms"]
    assert [c.key for c in typed.plan(df, two, typed.TypedConfig(max_per_service=3))] == ["ratio"]
    assert {c.key for c in typed.plan(df, config=typed.TypedConfig(sample_rows=133), order=["timestamp_ns"])} == set(got)


def test_encode_and_back(spark):
    df = logs(spark, [(0, 9, "b", "s", None, None, [("n", "I64", 5), ("n", "I64", 6), ("x", "I64", 2**60), ("t", "Str", "2024-01-02T03:04:05.100000Z")]), (1, 9, "b", "s", None, None, [("n", "Str", "no"), ("x", "I64", 4), ("t", "Str", "2024-01-02T03:04:05Z")]), (2, 9, "b", "s")])
    columns = [typed.TypedColumn("attr_n", "n", "int64", "s"), typed.TypedColumn("attr_x", "x", "float64", "s"), typed.TypedColumn("attr_t", "t", "timestamp", "s")]
    out = typed.encode(df, columns)
    rows = out.orderBy("event_id").collect()
    assert [(r.attr_n, r.attr_x, r.attr_t) for r in rows] == [(5, None, None), (None, 4.0, 1_704_164_645 * S), (None, None, None)]
    assert [[a.key for a in r.attributes] for r in rows] == [["n", "x", "t"], ["n"], []]
    back = typed.decode(out, columns).orderBy("event_id").collect()
    assert [sorted(a.key for a in r.attributes) for r in back] == [["n", "n", "t", "x"], ["n", "t", "x"], []]
    assert out.schema["attr_n"].metadata == {"attr_key": "n", "attr_type": "int64"}


def files(spark, rows):
    return spark.createDataFrame([("t", "i", h, lv, "n", b, ts, ts, f"p{k:03d}", w) for k, (h, lv, b, ts, w) in enumerate(rows)], "tenant string, index string, hour string, level string, node string, bytes long, min_ts long, max_ts long, path string, written_secs long")


def test_retention_edges(spark):
    df = files(spark, [("1970-01-01T00", "debug", 1, 0, 0), ("1970-01-01T01", "debug", 1, 0, 0), ("1970-01-01T00", "info", 1, 0, 0), ("1970-01-01T00", "odd", 1, 0, 0)])
    got = {r.path: r.verdict for r in policy.retention(df, 3600 + 86_400).collect()}
    assert got == {"p000": "expired", "p001": "kept", "p002": "kept", "p003": "orphan"}
    assert {r.verdict for r in policy.retention(df, 10**9, scopes=[("t", "other")]).collect()} == {"orphan"}


def test_reclaim_order_and_target(spark):
    df = files(spark, [("h", "warn_plus", 10, 1, 0), ("h", "debug", 10, 5, 0), ("h", "odd", 10, 0, 0), ("h", "info", 10, 2, 0), ("h", "debug", 10, 5, 0)])
    assert sorted(r.path for r in policy.reclaim(df, 50, 50).collect()) == ["p001", "p004"]
    assert sorted(r.path for r in policy.reclaim(df, 50, 20).collect()) == ["p000", "p001", "p003", "p004"]
    assert policy.reclaim(df, 35, 50).collect() == []


def test_pins_and_compaction(spark):
    df = files(spark, [("h", "info", 10, k, 0) for k in range(5)] + [("h", "info", 100, 9, 0)])
    assert [r.path for r in policy.pins(df, 60, 0).collect()] == []
    assert sorted(r.path for r in policy.pins(df.where("bytes = 10"), 25, 0).collect()) == ["p003", "p004"]
    assert sorted(r.path for r in policy.compactable(df, 10_000, small=50, target=35).collect()) == ["p000", "p001", "p002"]
    assert policy.compactable(df, 100, small=50).collect() == [] and policy.compactable(df.limit(3), 10_000).collect() == []


def test_pressure(spark):
    rows = spark.createDataFrame([(95, 100), (80, 100), (79, 100), (5, 0)], "u long, b long").select(policy.pressure(F.col("u"), F.col("b")).alias("p")).collect()
    assert [r.p for r in rows] == ["critical", "high", "normal", "normal"]


def test_limit_zero_and_truncation(spark):
    df = records.with_partitions(logs(spark, [(t * 3600, 9, "b", "s") for t in range(5)]))
    assert scan.scan(df, scan.Query(limit=0)).count() == 1
    assert scan.truncated(df, scan.Query(limit=5)).first().truncated and not scan.truncated(df, scan.Query(limit=6)).first().truncated
    assert [r.timestamp_ns // (3600 * S) for r in scan.scan(df, scan.Query(limit=2)).collect()] == [3, 4]
    half_open = scan.scan(df, scan.Query(3600 * S, 7200 * S)).collect()
    assert [r.timestamp_ns for r in half_open] == [3600 * S]


def test_suggestions(spark):
    t = spark.createDataFrame([("disk full on <PATH>", 9), ("disk is full on <PATH>", 5), ("user <NUM> in", 7), ("12 34", 3)], "template string, n long")
    pairs = suggestions.candidate_pairs(t)
    rows = pairs.collect()
    assert rows[0].a == "disk full on <PATH>" and rows[0].b == "disk is full on <PATH>" and math.isclose(rows[0].jaccard, 0.8)
    assert suggestions.suggest(pairs, lambda a, b: 0.91234)["suggestions"][0]["p_same"] == 0.9123

    def down(a, b):
        raise OSError("down")

    assert suggestions.suggest(pairs, down)["failed"] <= 3


def test_first_text_names_a_shape(spark):
    df = logs(spark, [(0, 9, "a", "s", None, 5), (1, 9, "b", "s", None, 5), (2, 9, "c", None, None, None)]).withColumn("template", F.col("body")).withColumn("lineage_id", F.col("template_id"))
    shape = dictionary.shapes(df, ["observed_ns"]).collect()
    assert [(r.text, r.collisions) for r in shape] == [("a", 1)]
    seen = dictionary.sightings(records.with_partitions(df))
    assert [(r.service, r.rows) for r in seen.collect()] == [("s", 2)]


def test_accounts():
    assert catalog.accounted(10, 6, 3, 1) == (0, True) and catalog.accounted(10, 6, 3, 2) == (-1, False) and catalog.accounted(10, 6, 2, 1, 1) == (1, True)


def test_admission(spark):
    df = spark.createDataFrame([("a", "i1"), (None, None), ("b", "i1"), ("a", "zz")], "tenant_claim string, requested string")
    assert catalog.admitted(df, "a", ["i1"]).count() == 2 and catalog.admitted(df, "a", ["i1"], whole=True).count() == 0


def test_policy_document():
    from tidelog.operators import settings as st

    new = {**st.DEFAULT, "ingest": {"critical_enqueue_timeout_ms": 0, "queue_capacity": 10}, "retention": st.DEFAULT["retention"][:2]}
    assert st.problems(st.DEFAULT) == [] and st.problems(new) == []
    assert [p for p, *_ in st.diff(st.DEFAULT, new)] == ["ingest.critical_enqueue_timeout_ms", "ingest.queue_capacity", "retention[2].min_severity", "retention[2].name", "retention[2].retention_secs"]
    assert st.lossy(st.DEFAULT, new) == ["ingest.queue_capacity", "ingest.critical_enqueue_timeout_ms"]
    assert st.pending_restart(new, st.DEFAULT) == {"ingest.queue_capacity": 65_536}
    assert st.overlay(st.DEFAULT, new, ["ingest.queue_capacity", "retention[2].name"])["ingest"]["queue_capacity"] == 10
    assert st.sources(new, ["retention"])["retention[0].name"] == "runtime"
    with pytest.raises(KeyError):
        st.overlay(st.DEFAULT, new, ["storage.nothing"])
    bad = {**st.DEFAULT, "retention": [{"name": "a", "min_severity": 1, "retention_secs": 0}, {"name": "A", "min_severity": 1, "retention_secs": 5}], "storage": {"disk_budget_bytes": 0, "high_water": 0.9, "critical_water": 0.8, "reclaim_target": 0.95}}
    assert sorted(p for p, _ in st.problems(bad)) == ["retention[0].min_severity", "retention[0].retention_secs", "retention[1].min_severity", "retention[1].name", "storage.disk_budget_bytes", "storage.high_water", "storage.reclaim_target"]


def test_lineage_links(spark):
    old = spark.createDataFrame([("disk full on <PATH>",), ("user <NUM> in",)], "template string")
    new = spark.createDataFrame([("disk is full on <PATH>",), ("nothing alike",)], "template string")
    assert [(r.now, r.was) for r in dictionary.lineage_links(old, new).collect()] == [("disk is full on <PATH>", "disk full on <PATH>")]


def test_export_by_scope(spark, tmp_path):
    df = spark.createDataFrame([("t", "a", 1), ("t", "b", 2)], "tenant string, index string, template_id long")
    dictionary.export(df, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2


def test_given_ids_are_kept(spark):
    rows = mining.mine_missing(logs(spark, [(0, 9, "user 1 in", "s"), (1, 9, "user 2 in", "s", None, 77)]), ["service"], ["observed_ns"]).collect()
    assert {r.body: r.template_id for r in rows} == {"user 1 in": shape_hash_of("user <NUM> in"), "user 2 in": 77}
