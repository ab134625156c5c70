"""The policy document: what is valid, what changed, what runs."""

from __future__ import annotations

import copy
import math
import re
from collections.abc import Callable

#: Bounds of the document's numbers.
MAX_SEVERITY, MAX_RETENTION, MAX_QUEUE, MAX_WAIT_MS, SAFE_QUEUE = 255, 10 * 365 * 86_400, 10_000_000, 60_000, 1_000

DEFAULT = {
    "retention": [{"name": "debug", "min_severity": 0, "retention_secs": 86_400}, {"name": "info", "min_severity": 9, "retention_secs": 604_800}, {"name": "warn_plus", "min_severity": 13, "retention_secs": 2_592_000}],
    "storage": {"disk_budget_bytes": 10 << 30, "high_water": 0.80, "critical_water": 0.95, "reclaim_target": 0.70},
    "ingest": {"critical_enqueue_timeout_ms": 250, "queue_capacity": 65_536},
    "pushdown": {"enabled": True, "trigger_severity": 17},
}
#: Leaves that only a restart applies.
RESTART = {"ingest.queue_capacity"}


def leaves(doc: dict) -> dict[str, object]:
    out: dict[str, object] = {}

    def walk(at: str, v: object) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                walk(f"{at}.{k}" if at else k, x)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(f"{at}[{i}]", x)
        else:
            out[at] = v

    walk("", doc)
    return out


def _names(doc: dict, upto: int) -> list[str]:
    return [r["name"].lower() for r in doc["retention"][:upto]]


def _finite(*values: float) -> bool:
    return all(map(math.isfinite, values))


#: What each leaf must be: path (a * stands for every bucket), a test of its value in the
#: document at that bucket, and what to say. A path's tests run in order; all that fail are told.
RULES: list[tuple[str, Callable[[object, dict, int], bool], str]] = [
    ("retention[*].name", lambda v, d, i: bool(re.fullmatch(r"(?=.*[A-Za-z])[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}", v)), "not a usable folder name"),
    ("retention[*].name", lambda v, d, i: v.lower() not in _names(d, i), "names differ, letter case apart"),
    ("retention[*].min_severity", lambda v, d, i: 0 <= v <= MAX_SEVERITY, f"0 to {MAX_SEVERITY}"),
    ("retention[*].min_severity", lambda v, d, i: i > 0 or v == 0, "the first bucket starts at 0"),
    ("retention[*].min_severity", lambda v, d, i: i == 0 or v > d["retention"][i - 1]["min_severity"], "buckets rise by severity"),
    ("retention[*].retention_secs", lambda v, d, i: 1 <= v <= MAX_RETENTION, f"1 to {MAX_RETENTION} seconds"),
    ("storage.disk_budget_bytes", lambda v, d, i: v > 0, "more than 0"),
    ("storage.reclaim_target", lambda v, d, i: _finite(v) and v > 0, "more than 0"),
    ("storage.reclaim_target", lambda v, d, i: not _finite(v) or v <= 0 or v < d["storage"]["high_water"], "below high_water"),
    ("storage.high_water", lambda v, d, i: _finite(v) and v < d["storage"]["critical_water"], "below critical_water"),
    ("storage.critical_water", lambda v, d, i: _finite(v) and v <= 1, "at most 1"),
    ("ingest.queue_capacity", lambda v, d, i: 1 <= v <= MAX_QUEUE, f"1 to {MAX_QUEUE}"),
    ("ingest.critical_enqueue_timeout_ms", lambda v, d, i: v <= MAX_WAIT_MS, f"at most {MAX_WAIT_MS}"),
    ("pushdown.trigger_severity", lambda v, d, i: 0 <= v <= MAX_SEVERITY, f"0 to {MAX_SEVERITY}"),
]


def problems(doc: dict) -> list[tuple[str, str]]:
    """(path, what is wrong with it) of each fault."""
    out = [] if doc["retention"] else [("retention", "define at least one bucket")]
    for path, value in leaves(doc).items():
        at = re.search(r"\[(\d+)\]", path)
        for rule, test, why in RULES:
            if rule == re.sub(r"\[\d+\]", "[*]", path) and not test(value, doc, int(at[1]) if at else 0):
                out.append((path, why))
    return out


def _natural(path: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", path)]


def diff(old: dict, new: dict) -> list[tuple[str, object, object, str]]:
    """(path, from, to, restart or hot) of each leaf that differs; absent leaves are None."""
    a, b = leaves(old), leaves(new)
    return [(p, a.get(p), b.get(p), "restart" if p in RESTART else "hot") for p in sorted(a.keys() | b.keys(), key=_natural) if a.get(p) != b.get(p)]


def overlay(file: dict, stored: dict, overrides: list[str]) -> dict:
    """The file's document with the overridden leaves of the stored one. An override of a
    bucket that the file no longer has at that place is left out."""
    out = copy.deepcopy(file)
    for key in overrides:
        m = re.fullmatch(r"retention\[(\d+)\]\.(\w+)", key)
        if m:
            i, name = int(m[1]), m[2]
            same = i < len(file["retention"]) and i < len(stored["retention"]) and file["retention"][i]["name"] == stored["retention"][i]["name"]
            if same:
                out["retention"][i][name] = stored["retention"][i][name]
        elif key == "retention":
            out["retention"] = copy.deepcopy(stored["retention"])
        else:
            group, _, name = key.partition(".")
            if not isinstance(stored.get(group), dict) or name not in stored[group]:
                raise KeyError(key)
            out[group][name] = stored[group][name]
    return out


def sources(doc: dict, overrides: list[str]) -> dict[str, str]:
    own = set(overrides)
    return {p: "runtime" if p in own or p.startswith("retention[") and "retention" in own else "file" for p in leaves(doc)}


def pending_restart(doc: dict, running: dict) -> dict[str, object]:
    """Leaves that wait for a restart, with the value that still runs."""
    now = leaves(running)
    return {p: now.get(p) for p, v in leaves(doc).items() if p in RESTART and now.get(p) != v}


#: Leaves whose change can lose records: when, from the value that runs to the proposed one.
LOSSY: dict[str, Callable[[object, object], bool]] = {
    "ingest.queue_capacity": lambda now, then: now != then and then < SAFE_QUEUE,
    "ingest.critical_enqueue_timeout_ms": lambda now, then: now != then and then == 0,
    "pushdown.enabled": lambda now, then: bool(now) and not then,
}


def lossy(current: dict, proposed: dict) -> list[str]:
    """Changes that lose records."""
    now, then = leaves(current), leaves(proposed)
    return [path for path, loses in LOSSY.items() if loses(now[path], then[path])]
