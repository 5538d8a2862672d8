"""Counts and shortest walks against listings, and graphs whose walks nobody could list."""

import random
import time

import pytest
from pyspark.sql import functions as F

from wardlight.operators import paths as pt
from wardlight.operators import walk_sets as ws
from wardlight.plans import scan

EDGE = "scan string, component string, source string, target string, type string"


def edges_of(spark, rows):
    return spark.createDataFrame(rows, EDGE).withColumns({"severity": F.lit("HIGH"), "confidence": F.lit("HIGH")})


def ladder(rungs, scan_key="l"):
    """Two nodes a rung, each leading to both of the next: 2^rungs walks."""
    rows = [(scan_key, "c", "SKILL:c", "DATA:s", "READS"), (scan_key, "c", f"DATA:{rungs}a", "ENDPOINT:e", "SENDS_TO"), (scan_key, "c", f"DATA:{rungs}b", "ENDPOINT:e", "SENDS_TO")]
    rows += [(scan_key, "c", "DATA:s", f"DATA:1{x}", "FLOWS_TO") for x in "ab"]
    return rows + [(scan_key, "c", f"DATA:{i}{x}", f"DATA:{i + 1}{y}", "FLOWS_TO") for i in range(1, rungs) for x in "ab" for y in "ab"]


def random_graph(draw, scan_key, cyclic):
    rows = set()
    for comp in ("c", "d"):
        names = [f"{draw.choice(['DATA', 'SECRET'])}:{i}" for i in range(7)]
        for _ in range(12):
            i, j = sorted(draw.sample(range(7), 2), reverse=cyclic and draw.random() < 0.3)
            rows.add((scan_key, comp, names[i], names[j], "FLOWS_TO"))
        rows |= {(scan_key, comp, f"SKILL:{comp}", draw.choice(names), "READS") for _ in range(3)}
        rows |= {(scan_key, comp, draw.choice(names), draw.choice(["ENDPOINT:x", "ENDPOINT:y", "TOOL:z"]), "SENDS_TO") for _ in range(3)}
        rows |= {(scan_key, comp, f"SKILL:{comp}", f"ACTION:{draw.randrange(3)}", "EXECUTES") for _ in range(2)}
        rows |= {(scan_key, comp, f"SKILL:{draw.randrange(5)}", f"SKILL:{draw.randrange(5, 9)}", "HANDOFF") for _ in range(3)}
        if cyclic:
            rows |= {(scan_key, comp, f"SKILL:{draw.randrange(4, 9)}", f"SKILL:{draw.randrange(4, 9)}", "HANDOFF") for _ in range(3)}
    return sorted(rows)


@pytest.mark.parametrize("cyclic", [False, True])
def test_counts_equal_the_listing(spark, cyclic):
    draw = random.Random(8)
    rows = [r for i in range(8) for r in random_graph(draw, None if i == 0 else f"t{i}", cyclic and i % 2 == 1)]
    edges = edges_of(spark, rows)
    listed = pt.analyze(edges, ["scan"])
    want = {(r["scan"], r["attack_type"]): r["count"] for r in listed.groupBy("scan", "attack_type").count().collect()}
    got = {(r["scan"], r["attack_type"]): int(r["walks"]) for r in ws.walk_counts(edges, ["scan"]).collect()}
    assert got == want
    proven = {(r["scan"], r["attack_type"]) for r in pt.attack_types(edges, ["scan"]).collect()}
    assert proven == {k for k in want if k[1] != "UNKNOWN"}
    walks = {}
    for r in listed.where(F.array_contains(F.col("edges.type"), "SENDS_TO")).select("scan", "component", "nodes", "path_id", "sev", "conf", "kind", "attack_type").collect():
        walks.setdefault((r["scan"], r["component"]), []).append((len(r["nodes"]), tuple(r["nodes"]), r["path_id"], r["sev"], r["conf"], r["kind"], r["attack_type"]))
    best = {}
    for r in ws.shortest_walks(edges, ["scan"], 3).collect():
        best.setdefault((r["scan"], r["component"]), []).append((len(r["nodes"]), tuple(r["nodes"]), r["path_id"], r["sev"], r["conf"], r["kind"], r["attack_type"]))
    assert {k: sorted(v) for k, v in best.items()} == {k: sorted(v)[:3] for k, v in walks.items()}


def test_a_ladder_of_a_million_walks(spark):
    edges = edges_of(spark, ladder(20) + [("u", "c", "SKILL:c", "DATA:s", "READS")])
    start = time.time()
    assert [(r["scan"], r["attack_type"], int(r["walks"])) for r in ws.walk_counts(edges, ["scan"]).collect()] == [("l", "DATA_EXFILTRATION", 2**20)]
    best = ws.shortest_walks(edges, ["scan"], 10).collect()
    assert len(best) == 10 and {len(r["nodes"]) for r in best} == {23} and len({r["path_id"] for r in best}) == 10
    assert time.time() - start < 180


def test_verdicts_list_no_walk(spark):
    declared = spark.createDataFrame([(None, *r[1:]) for r in ladder(20)], EDGE.replace("scan ", "scan_t ")).withColumns({"severity": F.lit("HIGH"), "confidence": F.lit("HIGH")})
    docs = spark.createDataFrame([(None, "a.md", "plain text"), ("u", "a.md", "plain text")], "t string, path string, text string")
    found = scan.run(docs, ["t"], declared=declared, walks=False)
    assert found.paths is None
    rows = {r.t: (r.paths, r.policy_status, r.worst_attack, r.worst_path_score) for r in found.targets.collect()}
    assert rows == {None: (2**20, "FAIL", "DATA_EXFILTRATION", 70), "u": (0, "PASS", None, None)}
