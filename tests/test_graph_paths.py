"""Hand-built graphs, path identity, risk and checks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.operators import checks as ck
from wardlight.operators import components as cp
from wardlight.operators import graph as gr
from wardlight.operators import paths as pt
from wardlight.operators import policy as po

EDGE = "component string, source string, target string, type string, severity string, confidence string"


def edges_of(spark, rows):
    return spark.createDataFrame([(c, s, t, k, sev, conf) for c, s, t, k, sev, conf in rows], EDGE)


def simple(c, s, t, k):
    return (c, s, t, k, None, None)


def lineage(c="a.md"):
    return [
        simple(c, f"SKILL:{c}", "DATA:x", "READS"), simple(c, "DATA:x", "DATA:y", "FLOWS_TO"), simple(c, "DATA:y", "DATA:z", "FLOWS_TO"),
        simple(c, "DATA:z", "ENDPOINT:https://e", "SENDS_TO"),
    ]


def routes(paths):
    return {" ".join(r.nodes): r for r in paths.collect()}


def test_lineage_becomes_one_path(spark):
    rows = routes(pt.analyze(edges_of(spark, lineage())))
    assert list(rows) == ["SKILL:a.md DATA:x DATA:y DATA:z ENDPOINT:https://e"]
    r = next(iter(rows.values()))
    assert (r.attack_type, r.severity, r.risk_severity, r.risk_score) == ("DATA_EXFILTRATION", "MEDIUM", "HIGH", 70)
    assert r.evidence == ["sensitive data read", "data transformation", "sensitive data flow", "external network send"]
    assert (r.entry_node, r.asset_node, r.sink_node, r.title) == ("SKILL:a.md", "DATA:x", "ENDPOINT:https://e", "Sensitive data sent to external endpoint")


def test_components_do_not_mix(spark):
    rows = [simple("a", "SKILL:a", "DATA:x", "READS"), simple("b", "DATA:x", "ENDPOINT:e", "SENDS_TO")]
    assert pt.analyze(edges_of(spark, rows)).count() == 0


def test_using_an_endpoint_is_not_sending(spark):
    rows = [simple("a", "SKILL:a", "DATA:x", "READS"), simple("a", "SKILL:a", "ENDPOINT:e", "USES"), simple("a", "SKILL:a", "DATA:y", "PRODUCES")]
    assert pt.analyze(edges_of(spark, rows)).count() == 0


def test_secret_and_execution_is_a_correlation(spark):
    rows = [("a", "SKILL:a", "SECRET:k", "READS", "CRITICAL", "HIGH"), simple("a", "SKILL:a", "ACTION:run", "EXECUTES"), simple("a", "SKILL:a", "DATA:d", "READS")]
    r = pt.analyze(edges_of(spark, rows)).collect()
    assert len(r) == 1 and r[0].nodes == ["SKILL:a", "ACTION:run"]
    # metadata may not outrun the proof
    assert (r[0].attack_type, r[0].severity, r[0].confidence, r[0].risk_score) == ("CORRELATED_SECRET_EXECUTION", "MEDIUM", "MEDIUM", 38)
    assert r[0].evidence == ["secret read", "execution"]


def test_cycles_and_depth(spark):
    c = "a"
    ring = [simple(c, "SKILL:a", "SECRET:0", "READS"), simple(c, "SECRET:0", "DATA:1", "FLOWS_TO"), simple(c, "DATA:1", "SECRET:0", "FLOWS_TO"), simple(c, "DATA:1", "ENDPOINT:e", "SENDS_TO")]
    assert set(routes(pt.analyze(edges_of(spark, ring)))) == {"SKILL:a SECRET:0 DATA:1 ENDPOINT:e"}
    long = [simple(c, "SKILL:a", "DATA:0", "READS")] + [simple(c, f"DATA:{i}", f"DATA:{i + 1}", "FLOWS_TO") for i in range(14)]
    reach = {n: pt.analyze(edges_of(spark, [*long, simple(c, f"DATA:{n}", "ENDPOINT:e", "SENDS_TO")]), limit=10).count() for n in (10, 11)}
    assert reach == {10: 1, 11: 0}


def test_handoffs_branch_and_stop(spark):
    def hand(a, b):
        return simple(a, f"SKILL:{a}", f"SKILL:{b}", "HANDOFF")

    rows = [hand("A", "B"), hand("B", "C"), hand("B", "D"), hand("D", "B"), hand("X", "Y"), hand("Y", "X")]
    paths = pt.analyze(edges_of(spark, rows))
    assert set(routes(paths)) == {"SKILL:A SKILL:B SKILL:C", "SKILL:A SKILL:B SKILL:D"}
    r = paths.first()
    assert (r.attack_type, r.severity, r.is_composed, r.component_ids[:2]) == ("UNKNOWN", "INFO", True, ["A", "B"])


def walks_by_hand(edges, origin, limit):
    out, stack = [], [[origin]]
    while stack:
        walk = stack.pop()
        out.append(tuple(walk))
        if len(walk) <= limit:
            stack += [walk + [t] for s, t in edges if s == walk[-1] and t not in walk]
    return out


def test_walks_equal_definition(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for c in range(6):
        pairs = sorted({(f"DATA:{rng.randrange(7)}", f"DATA:{rng.randrange(7)}") for _ in range(11)})
        rows += [simple(str(c), s, t, "FLOWS_TO") for s, t in pairs]
        want[str(c)] = sorted(walks_by_hand(pairs, "DATA:0", 4))
    edges = pt.ranked_edges(edges_of(spark, rows))
    origins = spark.createDataFrame([(str(c), "DATA:0") for c in range(6)], "component string, origin string")
    got = {}
    for r in pt.flow_walks(edges, origins, 4).collect():
        got.setdefault(r.component, []).append(tuple(r.walk))
    assert {c: sorted(v) for c, v in got.items()} == want


def test_path_identity_is_the_documented_hash(spark):
    text = "N\x1fSKILL:a\x1fACTION:r\x1eE\x1fSKILL:a\x1fACTION:r\x1fEXECUTES\x1eA\x1fSKILL:a\x1fSECRET:k\\\\x\x1fREADS"
    rows = [simple("a", "SKILL:a", "SECRET:k\\x", "READS"), simple("a", "SKILL:a", "ACTION:r", "EXECUTES")]
    assert pt.analyze(edges_of(spark, rows)).first().path_id == hashlib.sha256(text.encode()).hexdigest()


def test_breakpoints_and_provenance(spark):
    edges = edges_of(spark, [*lineage(), simple("a.md", "SKILL:a.md", "SECRET:k", "READS"), simple("a.md", "SKILL:a.md", "ACTION:r", "EXECUTES")])
    paths = pt.analyze(edges)
    kinds = {}
    for r in pt.breakpoints(paths).orderBy("path_id", "associated", "pos").collect():
        kinds.setdefault(r.path_id, []).append(r.impact)
    assert sorted(kinds.values()) == [["ACCESS", "DATA_FLOW", "DATA_FLOW", "EXTERNAL_TRANSMISSION"], ["EXECUTION", "ACCESS"]]
    owners = {r.owner for r in pt.edge_provenance(paths, edges).collect()}
    assert owners == {"a.md"}


def test_policies(spark):
    paths = pt.analyze(edges_of(spark, lineage()))
    rows = {r.policy_id: (r.violated, r.reason) for r in po.evaluate(paths.select("path_id", "attack_type")).collect()}
    said = {policy: (description, why) for policy, _, description, why in vocab.POLICIES}
    assert rows["DATA-EXFILTRATION-001"] == (True, said["DATA-EXFILTRATION-001"][1])
    assert rows["SECRET-EXFILTRATION-001"] == (False, said["SECRET-EXFILTRATION-001"][0])
    with pytest.raises(ValueError):
        po.evaluate(paths, ["MY-POLICY"])
    with pytest.raises(Exception, match="no path_id"):
        po.evaluate(spark.createDataFrame([("", "UNKNOWN")], "path_id string, attack_type string")).collect()


def test_policy_status_needs_coverage(spark):
    results = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "t string, violated boolean")
    cover = spark.createDataFrame([("a", "none"), ("b", "full"), ("c", "partial"), ("d", "full")], "t string, coverage_status string")
    assert {r.t: r.policy_status for r in po.status(results, cover, ["t"]).collect()} == {"a": "FAIL", "b": "PASS", "c": "UNKNOWN", "d": "PASS"}


def test_checks_find_what_is_wrong(spark):
    edges = edges_of(spark, lineage())
    paths = pt.analyze(edges)
    results = po.evaluate(paths.select("path_id", "attack_type"))
    assert ck.all_checks(paths, results, edges, gr.nodes_of(edges)).count() == 0
    bad = paths.withColumn("severity", F.lit("CRITICAL")).withColumn("nodes", F.slice("nodes", 1, 2))
    kinds = {r.kind for r in ck.all_checks(bad, results, edges.where("type <> 'READS'"), gr.nodes_of(edges)).collect()}
    assert kinds == {"path_id_mismatch", "non_contiguous_walk", "phantom_edge", "unproven_severity"}
    with pytest.raises(AssertionError):
        ck.assert_sound(ck.ceiling(bad))


def test_finding_edges(spark):
    rows = [
        ("a\\b/", 3, "AS-006", "HIGH", "HIGH", "Sensitive credential file access", "d", "Access", "cat ~/.aws/credentials"),
        ("a", 4, "AS-003", "MEDIUM", "MEDIUM", "External network access", "d", "HTTP client call", "requests.get('https://h.example/x')."),
        ("a", 5, "AS-003", "MEDIUM", "MEDIUM", "External network access", "d", "HTTP client call", "import requests"),
        ("a", 6, "AS-002", "INFO", "LOW", "Command execution", "d", "e", "os.system(x)"),
        ("a", 7, "AS-CHAIN-002", "CRITICAL", "HIGH", "Remote download followed by execution", "d", "e", "e"),
        ("a", None, "AS-MCP-005", "LOW", "MEDIUM", "Environment", "MCP server 'files': x", "e", "e"),
        ("a", 8, "AS-004", "HIGH", "MEDIUM", "Prompt injection", "d", "e", "x"),
        ("a", 9, "AS-CHAIN-001", "CRITICAL", "HIGH", "Potential secret exfiltration chain", "d", "e", "e"),
    ]
    df = spark.createDataFrame(rows, "path string, line int, rule_id string, severity string, confidence string, title string, description string, evidence string, matched_text string")
    got = {(r.source, r.type, r.target) for r in gr.finding_edges(df).collect()}
    assert got == {
        ("SKILL:a/b", "READS", "SECRET:.aws/credentials"), ("SKILL:a", "USES", "ENDPOINT:https://h.example/x"), ("SKILL:a", "EXECUTES", "ACTION:a:6:executes"),
        ("SKILL:a", "EXECUTES", "ACTION:a:7:executes"), ("SKILL:a", "USES", "MCPSERVER:files"), ("SKILL:a", "CONTAINS", "ACTION:a:8:contains-action"),
        ("SKILL:a", "SENDS_TO", "ACTION:a:9:sends-to-endpoint"),
    }
    merged = {r.target: (r.severity, r.confidence) for r in gr.merge_edges(gr.finding_edges(df)).collect()}
    assert merged["ACTION:a:6:executes"] == ("LOW", None)


def test_an_action_edge_hides_finding_metadata(spark):
    rows = spark.createDataFrame([("a", "SKILL:a", "SECRET:k", "READS", "CRITICAL", "HIGH")], EDGE)
    acts = spark.createDataFrame([("a", "SENSITIVE", "get", "k", None, None)], "component string, category string, verb string, object string, destination string, output string")
    graph = gr.security_graph(rows, gr.action_edges(acts)).where("type = 'READS'").collect()
    assert [(r.severity, r.by_action) for r in graph] == [(None, True)]


def test_empty_objects_make_nodes_only_when_read(spark):
    acts = spark.createDataFrame(
        [("a", "SOURCE", "read", "", None, None), ("a", "NETWORK", "send", "", "https://e", None), ("a", "TRANSFER", "call", "x", "b.md", None)],
        "component string, category string, verb string, object string, destination string, output string",
    )
    assert {(r.source, r.type, r.target) for r in gr.action_edges(acts).collect()} == {
        ("SKILL:a", "READS", "DATA:"), ("SKILL:a", "SENDS_TO", "ENDPOINT:https://e"), ("SKILL:a", "HANDOFF", "SKILL:b.md"),
    }


def test_component_projections(spark):
    edges = edges_of(spark, [*lineage(), simple("a.md", "SKILL:a.md", "TOOL:t", "USES")])
    paths = pt.analyze(edges)
    rows = [
        ("SKILL:a.md", "SKILL", "SKILL:a.md", "READS", "DATA:x", "d"), ("TOOL:t", "TOOL", "DATA:z", "SENDS_TO", "ENDPOINT:https://e", "d"),
        ("TOOL:t", "AGENT", "DATA:z", "SENDS_TO", "ENDPOINT:https://e", "d"), ("TOOL:gone", "TOOL", "DATA:x", "FLOWS_TO", "DATA:y", "d"),
        ("SKILL:a.md", "SKILL", "DATA:x", "FLOWS_TO", "DATA:q", "d"), ("SKILL:a.md", "SKILL", "SKILL:a.md", "USES", "TOOL:t", "d"),
    ]
    context = spark.createDataFrame(rows, "component_id string, component_type string, source string, edge_type string, target string, assoc_source string").withColumn("component", F.lit("a.md"))
    nodes = gr.nodes_of(edges)
    assert {r.kind for r in cp.context_violations(context, nodes, edges).collect()} == {"type_mismatch", "unknown_component", "unknown_edge", "edge_type"}
    good = cp.valid_context(context, nodes, edges)
    assert good.count() == 2
    assert [r.component_id for r in cp.composition(paths, good).orderBy("path_id", "place").limit(2).collect()] == ["TOOL:t", "SKILL:a.md"]
    elsewhere = context.withColumn("component", F.lit("b.md"))
    assert cp.valid_context(elsewhere, nodes, edges).count() == 0 and cp.participation(paths, elsewhere).count() == 0
    facts = {r.component_id: r.evidence for r in cp.risk_evidence(paths, good).collect()}
    assert facts == {"SKILL:a.md": ["sensitive data read"], "TOOL:t": ["external network send"]}


def test_risk_table_is_its_own_ceiling():
    for severity, confidence, score in vocab.RISK.values():
        assert severity in vocab.SEVERITY_RANK and confidence in vocab.CONFIDENCE_RANK and 0 <= score <= 100


def test_policy_results_are_counted_in_one_join(spark):
    """Every kind of bad result as often as it occurs; all checks together read paths and results a few times only."""
    paths = spark.createDataFrame([("p", "UNKNOWN"), ("q", "DATA_EXFILTRATION"), ("", "UNKNOWN"), ("n", None)], "path_id string, attack_type string")
    rows = [("A", "p", True, " "), ("A", "p", False, "r"), ("A", "p", True, "r"), ("B", "q", True, None), ("B", "x", True, "r"), ("B", "x", False, "r"),
            ("B", "", False, "r"), ("C", None, True, "r"), ("C", "n", True, "r"), (None, "q", None, "r")]
    results = spark.createDataFrame(rows, "policy_id string, path_id string, violated boolean, reason string")
    found = sorted((r.kind, r.subject) for r in ck.policy_results(paths, results).collect())
    assert found == sorted([
        ("duplicate_policy_result", "A@p"), ("duplicate_policy_result", "A@p"), ("violation_without_proof", "A@p"), ("violation_without_proof", "A@p"),
        ("violation_without_reason", "A@p"), ("violation_without_reason", "B@q"), ("orphan_policy_result", "B@x"), ("orphan_policy_result", "B@x"),
        ("result_without_path_id", "B@<no path_id>"), ("result_without_path_id", "C@<no path_id>"),
    ])
    edges = edges_of(spark, lineage())
    whole = ck.all_checks(pt.analyze(edges).checkpoint(), po.evaluate(pt.analyze(edges).select("path_id", "attack_type")).checkpoint(), edges, gr.nodes_of(edges))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert sum(" Join " in line or line.strip(" :+-").startswith("Join ") for line in plan.split("\n")) == 3


def test_paths_without_violations_need_no_row_of_policies(spark):
    """An explanation says the same with violated ids alone, and paths are not joined with themselves for them."""
    rows = [*lineage(), simple("b", "SKILL:b", "SKILL:c", "HANDOFF")]
    edges = edges_of(spark, rows).checkpoint() if spark.sparkContext.getCheckpointDir() else edges_of(spark, rows)
    paths = pt.cut(pt.analyze(edges))
    results, owners = po.evaluate(paths.select("path_id", "attack_type")), pt.edge_provenance(paths, edges)
    ids = {r.path_id: r.policy_ids for r in po.violated_ids(results).collect()}
    assert ids == {r.path_id: r.policy_ids for r in po.associate(paths, results).collect() if r.policy_ids} and len(ids) == 1 and paths.count() == 2
    few, many = (pt.explain(paths, told, owners) for told in (po.violated_ids(results), po.associate(paths, results)))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    joins = [df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for df in (few, many)]
    assert joins[0] == joins[1] - 1
