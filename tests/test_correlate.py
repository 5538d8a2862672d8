"""Chains over findings against a plain reading of their definition."""

import itertools
import random

from wardlight import vocab
from wardlight.operators import bands
from wardlight.operators import correlate as co

SPAN = vocab.LINE_SPAN
RULES = ["AS-001", "AS-002", "AS-003", "AS-004", "AS-004", "AS-005"]
SCHEMA = "target string, path string, pos int, line int, rule_id string, severity string"


def random_findings(rng, files=60, loose=0.05, spread=60):
    rows = []
    for f in range(files):
        for pos in range(rng.randint(0, 8)):
            line = None if rng.random() < loose else rng.randint(1, spread)
            rows.append(("t", f"f{f}", pos, line, rng.choice(RULES), rng.choice(vocab.SEVERITIES)))
    return rows


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


def first_triple(group):
    inj = [r for r in group if r[4] in vocab.INJECTION_RULES]
    sec = [r for r in group if r[4] in vocab.SECRET_RULES]
    net = [r for r in group if r[4] in vocab.NETWORK_RULES]
    for distinct in (True, False):
        for t in itertools.product(inj, sec, net):
            if distinct and len({x[2] for x in t}) < 3:
                continue
            lines = [x[3] for x in t if x[3] is not None]
            if len(lines) < 3 or max(lines) - min(lines) <= SPAN:
                return tuple(x[2] for x in t)
    return None


def test_triples_equal_definition(spark):
    for seed, loose in ((1, 0.0), (2, 0.08)):
        rows = random_findings(random.Random(seed), files=150, loose=loose)
        df = spark.createDataFrame(rows, SCHEMA)
        got = {r.path: (r.a.pos, r.b.pos, r.c.pos) for r in co.secret_exfiltration(df, ["path"], ["pos"]).collect()}
        want = {f: first_triple(v) for f, v in grouped(rows).items()}
        want = {f: v for f, v in want.items() if v}
        assert got == want and len(want) > 20


def test_pairs_equal_definition(spark):
    rows = random_findings(random.Random(3), files=150, loose=0.1, spread=120)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.path, r.pos, r.side) for r in co.download_execute(df, ["path"]).collect()}
    want = set()
    for f, group in grouped(rows).items():
        for d, e in itertools.product(group, group):
            if d[4] in vocab.NETWORK_RULES and e[4] in vocab.EXEC_RULES and (d[3] is None or e[3] is None or abs(d[3] - e[3]) <= SPAN):
                want |= {(f, d[2], "download"), (f, e[2], "execution")}
    assert got == want and len(want) > 30


def test_one_finding_per_target_and_chain(spark):
    rows = [
        ("t1", "a.md", 0, 1, "AS-004", "HIGH"), ("t1", "a.md", 1, 2, "AS-003", "MEDIUM"), ("t1", "b.md", 0, 5, "AS-003", "HIGH"), ("t1", "b.md", 1, 9, "AS-002", "LOW"),
        ("t1", "c.md", 0, 5, "AS-005", "LOW"), ("t1", "c.md", 1, 9, "AS-002", "CRITICAL"), ("t2", "a.md", 0, 1, "AS-004", "HIGH"), ("t2", "a.md", 1, 40, "AS-003", "HIGH"),
        ("t3", "m.json", 0, 2, "AS-MCP-001", "MEDIUM"), ("t3", "n.json", 0, None, "AS-MCP-004", "HIGH"), ("t3", "n.json", 1, 3, "AS-MCP-007", "HIGH"), ("t4", "m.json", 0, 2, "AS-MCP-001", "MEDIUM"),
    ]
    parts = co.contributors(spark.createDataFrame(rows, SCHEMA), ["target"], "path", ["pos"])
    got = {(r.target, r.rule_id): (r.severity, r.evidence.split("Contributing: ")[1]) for r in co.chain_findings(parts, ["target"], "path").collect()}
    assert got == {
        # an injection next to a network finding fires: it counts for two signals
        ("t1", "AS-CHAIN-001"): ("CRITICAL", "a.md:1, a.md:2"),
        # strong on both sides, though never in one pair
        ("t1", "AS-CHAIN-002"): ("CRITICAL", "b.md:5, b.md:9, c.md:5, c.md:9"),
        ("t3", "AS-CHAIN-003"): ("CRITICAL", "m.json:2, n.json, n.json:3"),
    }


def test_long_location_lists_are_complete(spark):
    n = 6000  # 12 000 places, more than any list was once allowed
    rows = [("t", f"f{i}", 0, 1, "AS-003", "LOW") for i in range(n)] + [("t", f"f{i}", 1, 2, "AS-002", "LOW") for i in range(n)]
    parts = co.contributors(spark.createDataFrame(rows, SCHEMA), ["target"], "path", ["pos"])
    places = co.locations(parts, ["target"], "path").first().places.split(", ")
    assert places == sorted(f"f{i}:{line}" for i in range(n) for line in (1, 2))


def test_covered_chains_are_dropped(spark):
    chains = spark.createDataFrame(
        [("t", "a", "AS-CHAIN-001", 5, 9), ("t", "a", "AS-CHAIN-002", 30, 40), ("t", "b", "AS-CHAIN-002", 1, 3), ("t", "b", "AS-CHAIN-004", 1, 9000)],
        "target string, path string, rule_id string, first int, last int",
    )
    parts = spark.createDataFrame(
        [("t", "a", "AS-CHAIN-001", 9), ("t", "a", "AS-CHAIN-002", 41), ("t", "b", "AS-CHAIN-002", None)],
        "target string, path string, chain string, line int",
    )
    left = co.uncovered(chains, parts, ["target"], "path").collect()
    assert {(r.path, r.rule_id) for r in left} == {("a", "AS-CHAIN-002"), ("b", "AS-CHAIN-004")}


def test_near_equals_definition(spark):
    rng = random.Random(5)
    left = [(rng.choice("ab"), rng.randint(0, 300), i) for i in range(200)]
    right = [(rng.choice("ab"), rng.randint(0, 300), i) for i in range(200)]
    got = {(r.id, r.rid) for r in bands.near(
        spark.createDataFrame(left, "k string, line int, id int"), spark.createDataFrame(right, "k string, other_line int, rid int"), ["k"], SPAN).collect()}
    assert got == {(i, j) for k, a, i in left for q, b, j in right if k == q and abs(a - b) <= SPAN}
