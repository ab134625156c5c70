"""Registered queries: the driver's contract, and parity with SQL over a small table."""

from __future__ import annotations

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog.plans import catalogue

FAST = ["spine", "scan_limited", "issue_list", "template_dictionary", "rollup_records", "deterministic_sample", "context_lines", "first_findings", "mined_templates", "reclaim", "policy_impact", "gap_percentiles", "collector_bodies", "token_classes", "mined_lines", "context_windows", "pushdown_lines", "store_scan_limited", "stream_rollups", "prune_analysis"]


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalogue.queries()) >= 90


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", FAST)
def test_parity(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(row[names.index(c)]) for c in cols]) for row in got.fetchall())
    assert sorted(repr([plain(row[c]) for c in cols]) for row in df.collect()) == want


def test_nothing_outside_imports_the_llm_folder():
    from pathlib import Path

    top = Path(catalogue.__file__).resolve().parent.parent
    for p in top.rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert not re.search(r"tidelog\.llm|from \.+llm|import llm", p.read_text()), p
