"""Registered queries against their DuckDB twins on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
PICKED = [
    "line_rule_pass", "scan_documents", "coverage_events", "enrich_findings", "score_by_document", "extract_actions",
    "step_sequence_events", "download_execute_text", "source_sink_text", "correlated_chains", "security_graph", "attack_paths",
    "policy_evaluate", "check_spoiled_rows", "component_risk_evidence", "collapse_http_claims", "server_findings",
    "baseline_annotate", "sarif_results", "evaluate_cases", "lab_cases", "whole_scan_findings",
    "whole_scan_paths", "chain_remote_mcp", "policy_status", "pattern_table", "path_context", "sarif_run", "serialize_graph",
]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
@pytest.mark.parametrize("name", PICKED)
def test_query_equals_its_twin(spark, duck, name):
    columns, rows, _ = check.run_spark(entry.queries()[name](spark, FOLDER))
    done = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in done.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = [tuple(check.plain(r[i]) for i in order) for r in done.fetchall()]
    assert columns == sorted(names)
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
