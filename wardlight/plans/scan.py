"""The whole scan as one flow of tables: documents to findings, chains, graph, paths and verdicts.

``scan`` names the columns that make one target. They go through everything: equal paths
in two targets are two files, two components and two graphs. Tables of edges and paths
have columns of their own called ``source`` and ``target``, so there, and in declared
edges and context, a target column ``x`` is called ``scan_x``; in other tables only where the
table has an ``x`` of its own. Inside, the target columns are one struct: a null is a target like
any other, and their names meet no column of an operator.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.operators import baseline as bl
from wardlight.operators import checks as ck
from wardlight.operators import components as cp
from wardlight.operators import correlate as co
from wardlight.operators import document_rules as dr
from wardlight.operators import enrich as en
from wardlight.operators import graph as gr
from wardlight.operators import line_rules as lr
from wardlight.operators import paths as pt
from wardlight.operators import policy as po
from wardlight.operators import scoring as sc
from wardlight.operators import server_rules as sr
from wardlight.operators import steps as st
from wardlight.operators import targets as tg
from wardlight.operators import walk_sets as ws
from wardlight.session import cut, settle
from wardlight.sources.corpus import explode_lines

ORDER = ["phase", "line", "rule_order"]
SHAPE = ["path", "phase", "line", "rule_order", "rule_id", "severity", "title", "description", "evidence", "remediation", "matched_text"]


def inner(scan: Sequence[str]) -> list[str]:
    """Names of the target columns in tables of edges, paths and context."""
    return [f"scan_{k}" for k in scan]


def _renamed(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(old, new)))


@dataclass
class Found:
    """What single files and their correlation yield; all three are materialised."""

    findings: DataFrame
    contributors: DataFrame
    steps: DataFrame


@dataclass
class Scan:
    """Tables of one scan, each with its target columns. Findings, edges and paths are materialised."""

    findings: DataFrame
    contributors: DataFrame
    edges: DataFrame
    paths: DataFrame | None
    policy_results: DataFrame | None
    entry_files: DataFrame | None
    path_policies: DataFrame | None
    context: DataFrame | None
    targets: DataFrame


def file_findings(docs: DataFrame, scan: Sequence[str]) -> DataFrame:
    """Findings of single files: line, document and server rules. ``docs``: scan keys, path, text."""
    shape = [*scan, *SHAPE]
    by_line = lr.line_findings(explode_lines(docs)).withColumn("phase", F.lit(0)).select(*shape)
    by_document = dr.document_findings(docs).withColumn("phase", F.lit(1)).select(*shape)
    by_server = (
        sr.server_findings(sr.read_servers(docs))
        .withColumn("phase", F.lit(2))
        .withColumn("rule_order", F.substring("rule_id", -3, 3).cast("int"))
        .withColumn("remediation", F.lit("Review the server configuration."))
        .select(*shape)
    )
    return by_line.unionByName(by_document).unionByName(by_server)


def extract(docs: DataFrame, scan: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What the texts themselves yield, written down: findings of single files, and steps. Nothing after it reads a text."""
    keys = list(scan)
    file = [*keys, "path"]
    raw = cut(dr.collapse_http_claims(cut(file_findings(docs, keys)), file))
    return raw, cut(st.actions(explode_lines(docs)).select(*file, *st.ACTION_COLUMNS))


def correlate(raw: DataFrame, steps: DataFrame, scan: Sequence[str]) -> Found:
    """Chains over the findings and over the steps of ``extract``, enriched."""
    keys = list(scan)
    file = [*keys, "path"]
    parts = cut(co.contributors(raw, keys, "path", ORDER, written=True))
    settle(raw.sparkSession)
    chains = cut(co.uncovered(cut(st.file_chains(steps, file)), parts, keys, "path"))
    nothing = F.lit(None).cast("int")

    def shaped(df: DataFrame, phase: int, path, line) -> DataFrame:
        return df.select(
            *keys, path.alias("path"), F.lit(phase).alias("phase"), line.alias("line"), nothing.alias("rule_order"), "rule_id", "severity",
            "title", "description", "evidence", F.lit("Review the named steps and destinations.").alias("remediation"), F.col("evidence").alias("matched_text"),
        )

    together = shaped(cut(co.chain_findings(parts, keys, "path")), 3, F.col("file"), nothing)
    inside = shaped(chains, 4, F.col("path"), F.col("first"))
    return Found(cut(en.enrich(raw.unionByName(together).unionByName(inside))), parts, steps)


def find(docs: DataFrame, scan: Sequence[str]) -> Found:
    """Findings of files, chains over findings and chains over steps, enriched."""
    keys = list(scan)
    if not tg.is_sealed(keys):
        found = find(tg.seal(docs, keys), [tg.BOX])
        return Found(*[tg.unseal(table, keys) for table in (found.findings, found.contributors, found.steps)])
    return correlate(*extract(docs, keys), keys)


def graph(found: Found, scan: Sequence[str], declared: DataFrame | None = None) -> DataFrame:
    """Edges of every target: of findings, of steps, and declared ones (scan_ keys, component, source, target, type)."""
    keys = inner(scan)
    steps = _renamed(found.steps, scan, keys).withColumn("component", gr.component_id(F.col("path")))
    acted = gr.action_edges(steps, keys)
    edges = gr.security_graph(gr.finding_edges(_renamed(found.findings, scan, keys), keys), acted, keys)
    return cut(edges if declared is None else edges.unionByName(declared, allowMissingColumns=True))


def run(
    docs: DataFrame, scan: Sequence[str], declared: DataFrame | None = None, events: DataFrame | None = None, baseline: DataFrame | None = None,
    context: DataFrame | None = None, ignore: dict | None = None, limit: int | None = None, walks: bool = True, roots: DataFrame | None = None,
    found: Found | None = None,
) -> Scan:
    """Scan documents (scan keys, path, text).

    ``events``: coverage rows (scan keys, kind, path, reason, line) of what was read or not;
    without them every document counts as read. ``baseline``: fingerprints with the scan keys.
    ``roots``: folders of the targets (scan keys, root); with them a finding's ``file`` is relative to the
    longest root that holds it, and the baseline is compared by it and by evidence without host paths.
    ``found``: what ``find`` or ``rescan.Results`` has for these documents; no text is read then.
    ``context``: component associations with the scan_ keys. ``ignore``: lists of rules, servers
    and domains. ``limit`` bounds the edges of a walk; a cut walk leaves a coverage row, which
    makes its target's coverage partial. Verdicts, counts of paths and the worst type need no listed
    walk, so they do not depend on ``limit``; without ``walks`` none is listed, and the tables of paths are None.
    """
    names, own = list(scan), inner(scan)
    keys = [tg.BOX] if names and not tg.is_sealed(names) else names
    inside = inner(keys)
    if keys != names:
        docs, events, baseline, roots = (tg.seal(table, names) for table in (docs, events, baseline, roots))
        declared, context = (tg.seal(table, own, inside[0]) for table in (declared, context))
    if found is None:
        found = find(docs, keys)
    elif keys != names:
        found = Found(*[tg.seal(table, names) for table in (found.findings, found.contributors, found.steps)])
    edges = graph(found, keys, declared)
    counts = cut(ws.walk_counts(edges, inside))
    nodes = gr.nodes_of(edges, inside)
    paths = results = entries = violated = None
    if walks:
        paths = cut(pt.analyze(edges, inside, limit))
        results = po.evaluate(paths.select(*inside, "path_id", "attack_type"))
        ck.assert_sound(ck.all_checks(paths, results, edges, nodes, inside))
        files = _renamed(docs, keys, inside).select(*inside, gr.component_id(F.col("path")).alias("path")).distinct()
        entries, violated = pt.entry_files(paths, files, inside), po.associate(paths, results, inside)
    none = F.lit(None).cast("string")
    read = docs.select(*keys, F.lit("scanned").alias("kind"), "path", none.alias("reason"), F.lit(None).cast("int").alias("line"))
    events = read if events is None else events
    if limit is not None and walks:
        ranked = cut(pt.ranked_edges(edges, inside))
        flows, origins = ranked.where("type = 'FLOWS_TO'"), pt.read_origins(ranked).select(*inside, "component", F.col("target").alias("origin"))
        short = _renamed(pt.cut_walks(pt.flow_walks(flows, origins, limit, inside), flows, limit, inside), inside, keys)
        events = events.unionByName(short.select(*keys, F.lit("skipped").alias("kind"), F.col("component").alias("path"), F.lit("walk_cut").alias("reason"), F.lit(None).cast("int").alias("line")))
    findings = en.suppress(found.findings, **(ignore or {})).withColumn("file", F.col("path"))
    if roots is not None:
        placed = bl.rooted(findings, roots, keys)
        findings = placed.withColumn("file", bl.relative_location(F.col("path"), F.col("root"))).withColumn("told", bl.sanitize_evidence(F.coalesce("evidence", F.lit("")), F.coalesce("root", F.lit("/")))).drop("root")
    if baseline is not None:
        # the fingerprint's evidence is the scrubbed one where roots say how to scrub it
        printed = findings.withColumnRenamed("evidence", "shown").withColumnRenamed("told", "evidence") if roots is not None else findings
        printed = cut(bl.annotate(printed, baseline, ORDER, F.floor(F.coalesce("line", F.lit(0)) / 4096), [*keys, *bl.KEY]))
        findings = printed.drop("evidence").withColumnRenamed("shown", "evidence") if roots is not None else printed
    else:
        findings = findings.drop("told").withColumn("baseline_state", none)
    valid = None if context is None else cp.valid_context(context, nodes, edges, inside)
    verdicts = targets(findings, _renamed(counts, inside, keys), events, keys)
    if keys == names:
        return Scan(findings, found.contributors, edges, paths, results, entries, violated, valid, verdicts)
    outer = (tg.unseal(table, names) for table in (findings, found.contributors, verdicts))
    tables = (tg.unseal(table, own, inside[0]) for table in (edges, paths, results, entries, violated, valid))
    findings, contributors, verdicts = outer
    return Scan(findings, contributors, *tables, verdicts)


def targets(findings: DataFrame, counts: DataFrame, events: DataFrame, scan: Sequence[str]) -> DataFrame:
    """One row per target: score, level, counts, coverage, baseline, policy status and the worst type of path.

    ``counts``: walks by target and attack type.
    """
    keys = list(scan)
    coverage = sc.coverage_status(events, keys)
    row = sc.risk_with_coverage(sc.scores(findings, keys), coverage, keys).join(coverage.drop("coverage_status", "holes"), keys, "left")
    row = row.join(sc.severity_summary(findings, keys), keys, "left")
    states = findings.groupBy(*keys).agg(
        F.count("*").alias("findings"), F.count_if(F.col("baseline_state") == "new").alias("new"), F.count_if(F.col("baseline_state") == "matched").alias("matched")
    )
    verdict = po.status(po.violated_types(counts.select(*keys, "attack_type")), coverage.select(*keys, "coverage_status"), keys)
    for part in (states, ws.worst_type(counts, keys), verdict):
        row = row.join(part, keys, "left")
    counts = ["critical", "high", "medium", "low", "suppressed", "findings", "new", "matched", "paths", "proven_paths", "files_scanned"]
    return row.select(
        *keys, "score", "risk_level", "coverage_status", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], "policy_status", "worst_attack", "worst_path_score"
    )
