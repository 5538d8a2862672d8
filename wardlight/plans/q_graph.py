"""Graphs, paths, policies, checks and component projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.operators import checks as ck
from wardlight.operators import components as cp
from wardlight.operators import enrich as en
from wardlight.operators import graph as gr
from wardlight.operators import paths as pt
from wardlight.operators import policy as po
from wardlight.operators import scoring as sc
from wardlight.plans import carriers
from wardlight.plans.carriers import ACTIONS_SQL, GRAPH_SQL
from wardlight.plans.q_rules import FINDINGS_SQL, seeded_findings
from wardlight.plans.q_steps import SEGMENTS_SQL, seeded_actions
from wardlight.plans.sqltext import m, q
from wardlight.session import cut
from wardlight.sources.corpus import read_table

# ------------------------------------------------------------ finding graph


def finding_rows(spark: SparkSession, folder: str) -> DataFrame:
    return gr.finding_edges(en.enrich(seeded_findings(spark, folder)))


def finding_edges(spark: SparkSession, folder: str) -> DataFrame:
    return finding_rows(spark, folder).select("component", "source", "target", "type", "signal", "line", "rule_id")


def merged_edges(spark: SparkSession, folder: str) -> DataFrame:
    return gr.merge_edges(finding_rows(spark, folder))


def edge_facts(spark: SparkSession, folder: str) -> DataFrame:
    return gr.edge_facts(finding_rows(spark, folder))


def corpus_graph(spark: SparkSession, folder: str) -> DataFrame:
    acts = seeded_actions(spark, folder).withColumn("component", gr.component_id(F.col("path")))
    return gr.security_graph(cut(finding_rows(spark, folder)), gr.action_edges(acts))


def corpus_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return gr.nodes_of(corpus_graph(spark, folder)).select("id", "type", "label")


def text_action_edges(spark: SparkSession, folder: str) -> DataFrame:
    return gr.action_edges(seeded_actions(spark, folder).withColumn("component", gr.component_id(F.col("path"))))


def event_action_edges(spark: SparkSession, folder: str) -> DataFrame:
    return gr.action_edges(carriers.action_stream(spark, folder))


def busiest_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """Out-edges of every data node of the event graph."""
    edges = event_action_edges(spark, folder)
    data = edges.where("target LIKE 'DATA:%'").select(F.col("target").alias("id"))
    return gr.neighbors(edges, data)


def component_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = carriers.seeded_documents(spark, folder)
    raw = F.when(F.col("doc_id") % 5 == 0, F.lit("")).when(F.col("doc_id") % 5 == 1, F.concat(F.replace("path", F.lit("/"), F.lit("\\")), F.lit("/"))).otherwise(F.col("path"))
    return docs.select("doc_id", gr.component_id(raw).alias("component"))


# --------------------------------------------------------------- declarations
def _declared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    region, nation, supplier = (read_table(spark, folder, t) for t in ("region", "nation", "supplier"))
    existing = nation.select(F.concat(F.lit("SKILL:"), "n_name").alias("id"), F.lit("SKILL").alias("type"))
    comps = (
        region.select(F.concat(F.lit(" AGENT:"), "r_name").alias("node_id"), F.lit("AGENT").alias("node_type"))
        .unionByName(supplier.select(F.concat(F.lit("TOOL:"), "s_name").alias("node_id"), F.when(F.col("s_suppkey") % 7 == 0, F.lit("DATA")).otherwise(F.lit("TOOL")).alias("node_type")))
        .unionByName(nation.where("n_regionkey = 2").select(F.concat(F.lit("SKILL:"), "n_name").alias("node_id"), F.lit("AGENT").alias("node_type")))
    )
    rels = (
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.concat(F.lit("AGENT:"), "r_name").alias("source_id"), F.concat(F.lit("SKILL:"), "n_name").alias("target_id"), F.lit("CONTAINS").alias("edge_type"))
        .unionByName(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("SKILL:"), "n_name"), F.concat(F.lit("TOOL:"), "s_name"),
            F.when(F.col("s_suppkey") % 5 == 0, F.lit("READS")).when(F.col("s_suppkey") % 5 == 1, F.lit("HANDOFF")).otherwise(F.lit("USES"))).toDF("source_id", "target_id", "edge_type"))
        .unionByName(nation.select(F.concat(F.lit("SKILL:"), "n_name"), F.concat(F.lit("SKILL:"), "n_name"), F.lit("HANDOFF")).toDF("source_id", "target_id", "edge_type"))
        .unionByName(nation.select(F.concat(F.lit("TOOL:none"), F.col("n_nationkey").cast("string")), F.concat(F.lit("SKILL:"), "n_name"), F.lit("TRUSTS")).toDF("source_id", "target_id", "edge_type"))
    )
    return existing, comps, rels


def declaration_violations(spark: SparkSession, folder: str) -> DataFrame:
    return gr.declaration_violations(*_declared(spark, folder))


def declared_edges(spark: SparkSession, folder: str) -> DataFrame:
    """All relationships declared twice over, one region already in the graph."""
    _, _, good = _declared(spark, folder)
    have = good.where("source_id = 'AGENT:ASIA'").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("edge_type").alias("type"))
    return gr.apply_declarations(have, good.unionByName(good))


def declared_handoffs(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as transfers of control between nations; each market segment is a target."""
    rows = read_table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("target_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("component"),
        F.concat(F.lit("n"), (F.col("c_custkey") % 25).cast("string")).alias("to"),
    )
    return gr.handoff_edges(rows, ["target_id"])


def handoff_heads_by_target(spark: SparkSession, folder: str) -> DataFrame:
    """Heads of declared transfers that only lead to later nations, per market segment."""
    edges = declared_handoffs(spark, folder)
    number = lambda c: F.substring(c, 8, 9).cast("int")
    return pt.handoff_heads(edges.where(number("source") < number("target")).where(number("target") % 3 != 0), ["target_id"])


# ---------------------------------------------------------------------- paths
def event_graph(spark: SparkSession, folder: str) -> DataFrame:
    return carriers.path_graph(spark, folder)


def event_paths(spark: SparkSession, folder: str) -> DataFrame:
    return pt.analyze(event_graph(spark, folder))


SHOWN = ["path_id", "nodes", "attack_type", "severity", "confidence", "title", "description", "entry_node", "asset_node", "sink_node"]


def _flat(paths: DataFrame, *columns: str) -> DataFrame:
    return paths.withColumn("nodes", F.array_join("nodes", " > ")).select(*columns)


def attack_paths(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(event_paths(spark, folder), *SHOWN)


def corpus_paths(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(pt.analyze(corpus_graph(spark, folder)), *SHOWN)


def path_risk(spark: SparkSession, folder: str) -> DataFrame:
    return event_paths(spark, folder).select(
        "path_id", "risk_severity", "risk_confidence", "risk_score", F.array_join("evidence", "; ").alias("evidence"), "explanation"
    )


def read_origins(spark: SparkSession, folder: str) -> DataFrame:
    return pt.read_origins(event_graph(spark, folder)).select("component", "source", "target").distinct()


def flow_walks(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(pt.ranked_edges(event_graph(spark, folder)))
    origins = pt.read_origins(edges).select("component", F.col("target").alias("origin"))
    walks = pt.flow_walks(edges.where("type = 'FLOWS_TO'"), origins)
    return walks.select("component", "origin", F.array_join("walk", " > ").alias("walk"), "sev", "conf")


def exfiltration(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(pt.exfiltration_paths(event_graph(spark, folder)), "component", "nodes", "kind", "sev", "conf")


def correlation(spark: SparkSession, folder: str) -> DataFrame:
    rows = pt.correlation_paths(event_graph(spark, folder))
    return rows.select("component", F.array_join("nodes", " > ").alias("nodes"), F.get("associated_edges", F.lit(0))["target"].alias("secret"), "sev", "conf")


def handoff_heads(spark: SparkSession, folder: str) -> DataFrame:
    return pt.handoff_heads(event_graph(spark, folder))


def handoffs(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(pt.handoff_paths(event_graph(spark, folder)), "component", "nodes", "sev", "conf")


def breakpoints(spark: SparkSession, folder: str) -> DataFrame:
    return pt.breakpoints(cut(event_paths(spark, folder)))


def composed(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_paths(spark, folder).where("is_composed")
    return rows.select("path_id", F.array_join("component_ids", " > ").alias("components"))


def provenance(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(event_graph(spark, folder))
    return pt.edge_provenance(cut(pt.analyze(edges)), edges).select("path_id", "pos", "associated", "owner")


def node_provenance(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(event_graph(spark, folder))
    return pt.node_provenance(pt.edge_provenance(cut(pt.analyze(edges)), edges))


def explanations(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(event_graph(spark, folder))
    paths = cut(pt.analyze(edges))
    told = pt.explain(paths, po.violated_ids(po.evaluate(paths.select("path_id", "attack_type"))), pt.edge_provenance(paths, edges))
    e = F.col("explanation")
    return told.select(
        "path_id", e["summary"].alias("summary"), e["entry"].alias("entry"), e["asset"].alias("asset"), e["sink"].alias("sink"),
        F.array_join(e["steps"], "\n").alias("steps"), F.array_join(e["associated_evidence"], "\n").alias("associated"),
        e["impact"].alias("impact"), F.array_join(e["policies"], ",").alias("policies"),
        F.array_join(e["breakpoints"], "\n").alias("breakpoints"), F.array_join(e["components"], ",").alias("components"),
    )


def entry_files(spark: SparkSession, folder: str) -> DataFrame:
    """Entry components that exist as read files: those with a large purchase."""
    edges = event_graph(spark, folder)
    block = F.floor(F.col("event_id") / carriers.ACTIONS_PER_COMPONENT).cast("string")
    files = read_table(spark, folder, "events").where("event_type = 'purchase' AND value > 60").select(F.concat(F.lit("c"), block).alias("path")).distinct()
    return pt.entry_files(pt.analyze(edges), files)


def top_path(spark: SparkSession, folder: str) -> DataFrame:
    return sc.highest_risk_path(event_paths(spark, folder), ["component"])


# ------------------------------------------------------------------- policies
def policy_results(spark: SparkSession, folder: str) -> DataFrame:
    return po.evaluate(event_paths(spark, folder).select("path_id", "attack_type"))


def policy_ids(spark: SparkSession, folder: str) -> DataFrame:
    paths = cut(event_paths(spark, folder).select("path_id", "attack_type"))
    return po.associate(paths, po.evaluate(paths)).select("path_id", F.array_join("policy_ids", ",").alias("policy_ids"))


def _by_component(spark: SparkSession, folder: str) -> DataFrame:
    return cut(po.evaluate(event_paths(spark, folder).select("component", "path_id", "attack_type")))


def policy_status(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts from what is reachable; no path is listed."""
    edges = cut(event_graph(spark, folder))
    results = po.violated_types(pt.attack_types(edges))
    seen = edges.groupBy("component").agg(F.count("*").alias("n"))
    coverage = seen.select("component", F.when(F.col("n") % 2 == 0, F.lit("full")).otherwise(F.lit("partial")).alias("coverage_status"))
    return po.status(results, coverage, ["component"])


def attack_types(spark: SparkSession, folder: str) -> DataFrame:
    return pt.attack_types(event_graph(spark, folder))


def cut_walks(spark: SparkSession, folder: str) -> DataFrame:
    """Walks that a bound of two edges cuts."""
    edges = cut(pt.ranked_edges(event_graph(spark, folder)))
    flows, origins = edges.where("type = 'FLOWS_TO'"), pt.read_origins(edges).select("component", F.col("target").alias("origin"))
    cut_off = pt.cut_walks(pt.flow_walks(flows, origins, 2), flows, 2)
    return cut_off.select("component", "origin", F.array_join("walk", " > ").alias("walk"))


def violation_counts(spark: SparkSession, folder: str) -> DataFrame:
    return po.violation_counts(_by_component(spark, folder), ["component"])


def violated_paths(spark: SparkSession, folder: str) -> DataFrame:
    return po.violated_paths(_by_component(spark, folder), ["component"])


# --------------------------------------------------------------------- checks
def _spoiled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sound paths and results, some of them spoiled by the first digit of their id."""
    edges = cut(event_graph(spark, folder))
    good = cut(pt.analyze(edges))
    results = po.evaluate(good.select("path_id", "attack_type"))
    digit = F.left("path_id", F.lit(1))
    bad = (
        good.withColumn("_d", digit)
        .withColumn("path_id", F.when(F.col("_d") == "0", F.lit("")).when(F.col("_d") == "1", F.concat(F.lit("x"), "path_id")).otherwise(F.col("path_id")))
        .withColumn("severity", F.when(F.col("_d") == "2", F.lit("CRITICAL")).otherwise(F.col("severity")))
        .withColumn("risk_severity", F.when(F.col("_d") == "3", F.lit("CRITICAL")).otherwise(F.col("risk_severity")))
        .withColumn("evidence", F.when(F.col("_d") == "4", F.array().cast("array<string>")).otherwise(F.col("evidence")))
        .withColumn("nodes", F.when(F.col("_d") == "5", F.concat("nodes", F.array(F.lit("DATA:ghost")))).otherwise(F.col("nodes")))
        .withColumn("confidence", F.when(F.col("_d") == "6", F.lit("HIGH")).otherwise(F.col("confidence")))
        .drop("_d")
    )
    spoiled = (
        results.withColumn("reason", F.when(digit == "7", F.lit(" ")).otherwise(F.col("reason")))
        .withColumn("violated", F.col("violated") | (digit == "8"))
        .unionByName(results.where(digit == "9"))
    )
    real = edges.where("NOT (type = 'SENDS_TO' AND target LIKE '%h6')")
    return bad, spoiled, real, gr.nodes_of(edges.where("target NOT LIKE 'ACTION:node'"))


def sound_run(spark: SparkSession, folder: str) -> DataFrame:
    """All checks on a run as it is: how many paths and results they saw, and that nothing was found."""
    edges = cut(event_graph(spark, folder))
    paths = cut(pt.analyze(edges))
    results = po.evaluate(paths.select("path_id", "attack_type"))
    found = ck.all_checks(paths, results, edges, gr.nodes_of(edges))
    counts = [df.agg(F.count("*").alias(name)) for df, name in ((paths, "paths"), (results, "results"), (found, "violations"))]
    named = counts[0].withColumn("k", F.lit(1))
    for more in counts[1:]:
        named = named.join(more.withColumn("k", F.lit(1)), "k")
    return named.drop("k")


def spoiled_run(spark: SparkSession, folder: str) -> DataFrame:
    return ck.all_checks(*_spoiled(spark, folder)).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


def spoiled_rows(spark: SparkSession, folder: str) -> DataFrame:
    return ck.all_checks(*_spoiled(spark, folder)).select("kind", "subject", "detail")


def proofs(spark: SparkSession, folder: str) -> DataFrame:
    return ck.proof_checks(event_paths(spark, folder)).select("path_id", "attack_type", "clause", "ok")


def contiguity(spark: SparkSession, folder: str) -> DataFrame:
    paths = event_paths(spark, folder)
    return paths.select(
        "path_id", pt.is_contiguous(F.col("nodes"), F.col("edges")).alias("sound"),
        pt.is_contiguous(F.reverse("nodes"), F.col("edges")).alias("reversed"),
    )


# ----------------------------------------------------------------- components
def _context(spark: SparkSession, folder: str) -> DataFrame:
    """Associations for the event graph: each behaviour edge belongs to its skill;
    others name components, types or edges that do not exist."""
    n = F.col("event_id")
    events = read_table(spark, folder, "events")
    rows = carriers.path_graph(spark, folder).where(F.col("type").isin(vocab.BEHAVIOUR_TYPES))
    owned = rows.select(
        F.concat(F.lit("SKILL:"), "component").alias("component_id"), F.lit("SKILL").alias("component_type"),
        "component", "source", F.col("type").alias("edge_type"), "target", F.lit("decl").alias("assoc_source"),
    ).distinct()
    odd = events.select(
        F.when(n % 100 == 0, F.lit("TOOL:absent")).otherwise(F.lit("SKILL:c0")).alias("component_id"),
        F.when(n % 150 == 0, F.lit("AGENT")).when(n % 250 == 0, F.lit("DATA")).otherwise(F.lit("SKILL")).alias("component_type"),
        F.lit("c0").alias("component"), F.lit("SKILL:c0").alias("source"), F.when(n % 200 == 0, F.lit("USES")).otherwise(F.lit("READS")).alias("edge_type"),
        F.concat(F.lit("DATA:o"), (n % 30).cast("string")).alias("target"), F.lit("odd").alias("assoc_source"),
    ).distinct()
    return owned.unionByName(odd)


def context_violations(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(event_graph(spark, folder))
    return cp.context_violations(cut(_context(spark, folder)), gr.nodes_of(edges), edges)


def _valid(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    edges = cut(event_graph(spark, folder))
    return cut(pt.analyze(edges)), cut(cp.valid_context(_context(spark, folder), gr.nodes_of(edges), edges))


def list_context(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(event_graph(spark, folder))
    rows = cp.valid_context(_context(spark, folder), gr.nodes_of(edges), edges)
    return rows.select(*cp.OWNER, "source", "edge_type", "target", "assoc_source").orderBy("component_id", "source", "target", "edge_type", "assoc_source")


def security_scope(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(event_graph(spark, folder))
    return cp.security_scope(cp.valid_context(_context(spark, folder), gr.nodes_of(edges), edges))


def participation(spark: SparkSession, folder: str) -> DataFrame:
    return cp.participation(*_valid(spark, folder))


def composition(spark: SparkSession, folder: str) -> DataFrame:
    return cp.composition(*_valid(spark, folder)).select("path_id", *cp.OWNER, "behaviours", "place")


def risk_evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = cp.risk_evidence(*_valid(spark, folder))
    return rows.withColumn("evidence", F.array_join("evidence", "; "))


def context_on_path(spark: SparkSession, folder: str) -> DataFrame:
    return pt.context_on_path(*_valid(spark, folder))


QUERIES = {
    "component_id": component_ids,
    "finding_to_edge": finding_edges,
    "merge_edges": merged_edges,
    "edge_facts": edge_facts,
    "action_edges_text": text_action_edges,
    "action_edges_events": event_action_edges,
    "graph_neighbors": busiest_neighbors,
    "security_graph": corpus_graph,
    "graph_nodes": corpus_nodes,
    "declaration_violations": declaration_violations,
    "apply_declarations": declared_edges,
    "handoff_edges": declared_handoffs,
    "handoff_heads_by_target": handoff_heads_by_target,
    "attack_types": attack_types,
    "cut_walks": cut_walks,
    "read_origins": read_origins,
    "flow_walks": flow_walks,
    "exfiltration_paths": exfiltration,
    "correlation_paths": correlation,
    "handoff_heads": handoff_heads,
    "handoff_paths": handoffs,
    "attack_paths": attack_paths,
    "corpus_attack_paths": corpus_paths,
    "path_risk": path_risk,
    "path_contiguity": contiguity,
    "path_breakpoints": breakpoints,
    "path_composition": composed,
    "path_provenance": provenance,
    "path_node_provenance": node_provenance,
    "path_explanation": explanations,
    "path_entry_files": entry_files,
    "path_context": context_on_path,
    "highest_risk_path": top_path,
    "policy_evaluate": policy_results,
    "policy_associate": policy_ids,
    "policy_status": policy_status,
    "policy_violation_counts": violation_counts,
    "policy_violated_paths": violated_paths,
    "check_sound_run": sound_run,
    "check_spoiled_kinds": spoiled_run,
    "check_spoiled_rows": spoiled_rows,
    "proof_checks": proofs,
    "context_violations": context_violations,
    "context_list": list_context,
    "component_scope": security_scope,
    "component_participation": participation,
    "component_composition": composition,
    "component_risk_evidence": risk_evidence,
}

# ------------------------------------------------------------------ SQL twins
SEV = "CASE {c} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 WHEN 'INFO' THEN 0 END"
CONF = "CASE {c} WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 0 END"
SEV_NAME = "CASE {c} WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' WHEN 0 THEN 'INFO' END"
CONF_NAME = "CASE {c} WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 0 THEN 'LOW' END"
URL_OF = "nullif(rtrim(regexp_extract({t}, '(?i)https?://[^\\s''\"]+'), '.,;:!?)]}}\"'''), '')"


def _pick(pattern: str) -> str:
    return f"lower(coalesce(nullif(regexp_extract(shown, {q('(?i)' + pattern)}), ''), nullif(regexp_extract(evidence, {q('(?i)' + pattern)}), '')))"


FINDING_EDGES = FINDINGS_SQL + f""", named AS (SELECT *, path AS component,
    CASE WHEN rule_id = 'AS-001' THEN evidence ELSE trim(text) END AS shown,
    CASE WHEN rule_id = 'AS-006' OR (rule_id = 'AS-001' AND (contains(evidence, 'API credential detected') OR contains(evidence, 'Private key block'))) THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
  FROM line_findings),
ided AS (SELECT *, coalesce({URL_OF.format(t='shown')}, {URL_OF.format(t='evidence')}) AS endpoint, {_pick(gr.SECRET_NAME)} AS secret, lower(title) AS lt FROM named),
specced AS (SELECT *, CASE WHEN contains(lt, 'sensitive credential') OR (contains(lower(description), 'credential') AND secret IS NOT NULL) THEN 'reads-secret'
    WHEN contains(lt, 'hardcoded secret') THEN 'contains-secret' WHEN {m('lt', gr.EXEC_TITLE)} THEN 'executes'
    WHEN endpoint IS NOT NULL AND (contains(lt, 'network access') OR contains(lt, 'suspicious url') OR contains(lt, 'download and execute')) THEN 'uses-endpoint'
    WHEN contains(lt, 'prompt injection') THEN 'contains-action' END AS signal FROM ided),
fe AS (SELECT component, 'SKILL:' || component AS source, coalesce(CASE signal WHEN 'reads-secret' THEN 'SECRET:' || secret WHEN 'contains-secret' THEN 'SECRET:' || secret
      WHEN 'uses-endpoint' THEN 'ENDPOINT:' || endpoint END, 'ACTION:' || component || ':' || line || ':' || signal) AS target,
    CASE signal WHEN 'reads-secret' THEN 'READS' WHEN 'contains-secret' THEN 'CONTAINS' WHEN 'executes' THEN 'EXECUTES' WHEN 'uses-endpoint' THEN 'USES' ELSE 'CONTAINS' END AS type,
    signal, line, rule_id, path, evidence, severity, confidence FROM specced WHERE signal IS NOT NULL),
merged AS (SELECT component, source, target, type, greatest(max({SEV.format(c='severity')}), 1) AS s, max({CONF.format(c='confidence')}) AS c, count(*) AS n_facts FROM fe GROUP BY ALL)"""


def action_sql(table: str, component: str) -> str:
    return f"""acted AS (SELECT DISTINCT component, e.source AS source, e.target AS target, e.type AS type FROM (SELECT component, unnest(list_filter([
      CASE WHEN category = 'SOURCE' THEN {{'source': skill, 'target': 'DATA:' || object, 'type': 'READS'}} END,
      CASE WHEN category = 'SENSITIVE' THEN {{'source': skill, 'target': 'SECRET:' || object, 'type': 'READS'}} END,
      CASE WHEN category = 'TRANSFORM' AND object <> '' AND output <> '' THEN {{'source': skill, 'target': 'DATA:' || output, 'type': 'PRODUCES'}} END,
      CASE WHEN category = 'TRANSFORM' AND object <> '' AND output <> '' THEN {{'source': 'DATA:' || object, 'target': 'DATA:' || output, 'type': 'FLOWS_TO'}} END,
      CASE WHEN category = 'NETWORK' AND destination <> '' THEN {{'source': skill, 'target': 'ENDPOINT:' || destination, 'type': 'SENDS_TO'}} END,
      CASE WHEN category = 'NETWORK' AND destination <> '' AND object <> '' THEN {{'source': 'DATA:' || object, 'target': 'ENDPOINT:' || destination, 'type': 'SENDS_TO'}} END,
      CASE WHEN category = 'DOWNLOAD' AND destination <> '' THEN {{'source': skill, 'target': 'ENDPOINT:' || destination, 'type': 'USES'}} END,
      CASE WHEN category = 'EXECUTION' THEN {{'source': skill, 'target': 'ACTION:' || verb, 'type': 'EXECUTES'}} END], lambda x: x IS NOT NULL)) AS e
    FROM (SELECT *, {component} AS component_, 'SKILL:' || {component} AS skill FROM (SELECT * REPLACE (trim(object) AS object) FROM {table}))))""".replace(
        "SELECT component, unnest", "SELECT component_ AS component, unnest"
    )


CORPUS_GRAPH = f"""{SEGMENTS_SQL}, {FINDING_EDGES[FINDING_EDGES.index('line_findings AS ('):]}, {action_sql('steps', 'path')},
graph AS (SELECT component, source, target, type, CASE WHEN NOT bool_or(by_action) THEN max(severity) END AS severity,
    CASE WHEN NOT bool_or(by_action) THEN max(confidence) END AS confidence, bool_or(by_action) AS by_action
  FROM (SELECT component, source, target, type, {SEV_NAME.format(c='s')} AS severity, CASE WHEN c > 0 THEN {CONF_NAME.format(c='c')} END AS confidence, false AS by_action FROM merged
    UNION ALL SELECT DISTINCT component, 'AGENT:<agent>', source, 'CONTAINS', NULL, NULL, false FROM fe
    UNION ALL SELECT component, source, target, type, NULL, NULL, true FROM acted) GROUP BY component, source, target, type)"""

US, RS = "chr(31)", "chr(30)"
PATHS = f"""ranked AS (SELECT component, source, target, type, max({SEV.format(c='severity')}) AS sev, max({CONF.format(c='confidence')}) AS conf FROM graph GROUP BY ALL),
reads AS (SELECT * FROM ranked WHERE type = 'READS' AND source LIKE 'SKILL:%' AND (target LIKE 'SECRET:%' OR target LIKE 'DATA:%')),
walks AS (SELECT DISTINCT component, target AS origin, target AS last, [target] AS walk, CAST(NULL AS INTEGER) AS sev, CAST(NULL AS INTEGER) AS conf, 0 AS depth FROM reads
  UNION ALL SELECT w.component, w.origin, e.target, list_append(w.walk, e.target), greatest(w.sev, e.sev), greatest(w.conf, e.conf), w.depth + 1
    FROM walks w JOIN ranked e ON w.component = e.component AND w.last = e.source AND e.type = 'FLOWS_TO' AND NOT list_contains(w.walk, e.target)),
exfil AS (SELECT w.component, list_append(list_prepend(r.source, w.walk), s.target) AS nodes,
    CASE WHEN w.origin LIKE 'SECRET:%' THEN 'exposure' WHEN len(w.walk) > 1 THEN 'sensitive-data' ELSE 'data' END AS kind,
    greatest(w.sev, r.sev, s.sev, 2) AS sev, greatest(w.conf, r.conf, s.conf, 1) AS conf, w.origin AS asset, CAST(NULL AS VARCHAR) AS secret
  FROM walks w JOIN reads r ON r.component = w.component AND r.target = w.origin
  JOIN ranked s ON s.component = w.component AND s.source = w.last AND s.type = 'SENDS_TO'),
shared AS (SELECT r.component, [r.source, x.target] AS nodes, 'execution' AS kind, greatest(r.sev, x.sev, 2) AS sev, greatest(r.conf, x.conf, 1) AS conf, r.target AS asset, r.target AS secret
  FROM reads r JOIN ranked x ON x.component = r.component AND x.source = r.source AND x.type = 'EXECUTES' WHERE r.target LIKE 'SECRET:%'),
hand AS (SELECT source, target, max(sev) AS sev, max(conf) AS conf FROM ranked WHERE type = 'HANDOFF' GROUP BY ALL),
heads AS (SELECT DISTINCT source FROM hand WHERE source NOT IN (SELECT target FROM hand)),
hwalks AS (SELECT source AS last, [source] AS nodes, 2 AS sev, 1 AS conf FROM heads
  UNION ALL SELECT h.target, list_append(w.nodes, h.target), greatest(w.sev, h.sev), greatest(w.conf, h.conf)
    FROM hwalks w JOIN hand h ON h.source = w.last AND NOT list_contains(w.nodes, h.target)),
handed AS (SELECT substr(w.nodes[1], 7) AS component, w.nodes, 'handoff' AS kind, w.sev, w.conf, '' AS asset, CAST(NULL AS VARCHAR) AS secret FROM hwalks w
  WHERE len(w.nodes) > 1 AND NOT EXISTS (SELECT 1 FROM hand h WHERE h.source = w.last AND NOT list_contains(w.nodes, h.target))),
allp AS (SELECT * FROM exfil UNION ALL SELECT * FROM shared UNION ALL SELECT * FROM handed),
typed AS (SELECT *, list_transform(range(1, len(nodes)), lambda i: {{'source': nodes[i], 'target': nodes[i + 1], 'type': CASE WHEN kind = 'handoff' THEN 'HANDOFF' WHEN kind = 'execution' THEN 'EXECUTES'
    WHEN i = 1 THEN 'READS' WHEN i = len(nodes) - 1 THEN 'SENDS_TO' ELSE 'FLOWS_TO' END}}) AS edges,
    CASE WHEN secret IS NULL THEN [] ELSE [{{'source': nodes[1], 'target': secret, 'type': 'READS'}}] END AS assoc,
    CASE kind WHEN 'exposure' THEN 'SECRET_EXFILTRATION' WHEN 'execution' THEN 'CORRELATED_SECRET_EXECUTION' WHEN 'handoff' THEN 'UNKNOWN' ELSE 'DATA_EXFILTRATION' END AS attack_type FROM allp),
p AS (SELECT *, sha256('N' || {US} || array_to_string(nodes, {US}) || {RS} || 'E' || {US} || array_to_string(list_transform(edges, lambda e: e.source || {US} || e.target || {US} || e.type), {US})
    || {RS} || 'A' || {US} || array_to_string(list_transform(assoc, lambda e: e.source || {US} || e.target || {US} || e.type), {US})) AS path_id,
    CASE attack_type WHEN 'SECRET_EXFILTRATION' THEN 'CRITICAL' WHEN 'DATA_EXFILTRATION' THEN 'HIGH' WHEN 'CORRELATED_SECRET_EXECUTION' THEN 'MEDIUM' ELSE 'INFO' END AS risk_severity,
    CASE attack_type WHEN 'CORRELATED_SECRET_EXECUTION' THEN 'MEDIUM' WHEN 'UNKNOWN' THEN 'LOW' ELSE 'HIGH' END AS risk_confidence,
    CASE attack_type WHEN 'SECRET_EXFILTRATION' THEN 95 WHEN 'DATA_EXFILTRATION' THEN 70 WHEN 'CORRELATED_SECRET_EXECUTION' THEN 38 ELSE 0 END AS risk_score,
    CASE kind WHEN 'execution' THEN ['secret read', 'execution'] WHEN 'handoff' THEN [] ELSE
      list_concat([CASE kind WHEN 'exposure' THEN 'secret read' ELSE 'sensitive data read' END],
        CASE WHEN len(nodes) > 3 THEN ['data transformation', 'sensitive data flow', 'external network send'] ELSE ['external network send'] END) END AS evidence FROM typed),
pe AS (SELECT path_id, component, attack_type, kind, CAST(i - 1 AS INTEGER) AS pos, false AS associated, edges[i].source AS source, edges[i].target AS target, edges[i].type AS type
    FROM (SELECT *, unnest(range(1, len(edges) + 1)) AS i FROM p)
  UNION ALL SELECT path_id, component, attack_type, kind, 0, true, assoc[1].source, assoc[1].target, assoc[1].type FROM p WHERE len(assoc) > 0)"""
CLAMPED = (
    "CASE least(sev, " + SEV.format(c="risk_severity") + ") WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'INFO' END AS severity, "
    "CASE least(conf, " + CONF.format(c="risk_confidence") + ") WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence"
)
TITLE = "CASE kind " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in vocab.PATH_TITLES.items()) + " END"
SHOW_SQL = (
    f"SELECT path_id, array_to_string(nodes, ' > ') AS nodes, attack_type, {CLAMPED}, {TITLE} AS title, nodes[1] || ' gets to ' || nodes[-1] || ' in ' || (len(nodes) - 1) || ' steps.' AS description, nodes[1] AS entry_node, asset AS asset_node, "
    "CASE WHEN kind = 'handoff' THEN '' ELSE nodes[-1] END AS sink_node FROM p"
)
G = f"WITH RECURSIVE {GRAPH_SQL}, {PATHS}"
RESULTS = "results AS (SELECT policy_id, path_id, component, attack_type, attack_type = kind2 AS violated, CASE WHEN attack_type = kind2 THEN why ELSE said END AS reason FROM p, (VALUES " + ", ".join(
    f"({q(a)}, {q(b)}, {q(c)}, {q(d)})" for a, b, c, d in vocab.POLICIES
) + ") pol(policy_id, kind2, said, why))"
CONTEXT = f"""context AS (SELECT DISTINCT 'SKILL:' || component AS component_id, 'SKILL' AS component_type, component, source, type AS edge_type, target, 'decl' AS assoc_source FROM graph
    WHERE type IN ('READS', 'WRITES', 'SENDS_TO', 'EXECUTES', 'PRODUCES', 'FLOWS_TO')
  UNION ALL SELECT DISTINCT CASE WHEN event_id % 100 = 0 THEN 'TOOL:absent' ELSE 'SKILL:c0' END, CASE WHEN event_id % 150 = 0 THEN 'AGENT' WHEN event_id % 250 = 0 THEN 'DATA' ELSE 'SKILL' END,
    'c0', 'SKILL:c0', CASE WHEN event_id % 200 = 0 THEN 'USES' ELSE 'READS' END, 'DATA:o' || (event_id % 30), 'odd' FROM events),
gnodes AS (SELECT source AS id FROM graph UNION SELECT target FROM graph),
valid AS (SELECT DISTINCT c.* FROM context c WHERE component_type IN ('AGENT', 'SKILL', 'TOOL', 'MCPSERVER') AND edge_type IN ('READS', 'WRITES', 'SENDS_TO', 'EXECUTES', 'PRODUCES', 'FLOWS_TO')
  AND component_id IN (SELECT id FROM gnodes) AND split_part(component_id, ':', 1) = component_type
  AND EXISTS (SELECT 1 FROM graph g WHERE g.component = c.component AND g.source = c.source AND g.target = c.target AND g.type = c.edge_type)),
onpath AS (SELECT DISTINCT pe.path_id, v.component_id, v.component_type, pe.source, v.edge_type, pe.target FROM pe JOIN valid v ON v.component = pe.component AND v.source = pe.source AND v.target = pe.target AND v.edge_type = pe.type)"""
C = f"{G}, {CONTEXT}"
OWNERS = """owned AS (SELECT DISTINCT pe.path_id, pe.pos, pe.associated, pe.source, pe.target, pe.type, g.component AS owner FROM pe JOIN graph g ON g.source = pe.source AND g.target = pe.target AND g.type = pe.type
  WHERE pe.kind = 'handoff' OR g.component = pe.component)"""
BREAK = "(attack_type IN ('SECRET_EXFILTRATION', 'DATA_EXFILTRATION') AND NOT associated) OR attack_type = 'CORRELATED_SECRET_EXECUTION'"
IMPACT = "CASE type " + " ".join(f"WHEN {q(k)} THEN {q(v[0])}" for k, v in vocab.BREAKPOINTS.items()) + " END"
REASON = "CASE type " + " ".join(f"WHEN {q(k)} THEN {q(v[1])}" for k, v in vocab.BREAKPOINTS.items()) + " END"
SPOILED = f"""{G}, {RESULTS}, good AS (SELECT *, left(path_id, 1) AS d FROM (SELECT *, {CLAMPED} FROM p)),
bad AS (SELECT CASE d WHEN '0' THEN '' WHEN '1' THEN 'x' || path_id ELSE path_id END AS path_id, path_id AS own, attack_type, kind, component,
    CASE d WHEN '2' THEN 'CRITICAL' ELSE severity END AS severity, CASE d WHEN '3' THEN 'CRITICAL' ELSE risk_severity END AS risk_severity,
    CASE d WHEN '6' THEN 'HIGH' ELSE confidence END AS confidence, CASE d WHEN '4' THEN [] ELSE evidence END AS evidence, CASE d WHEN '5' THEN list_append(nodes, 'DATA:ghost') ELSE nodes END AS nodes, d,
    CASE attack_type WHEN 'SECRET_EXFILTRATION' THEN 4 WHEN 'DATA_EXFILTRATION' THEN 3 WHEN 'CORRELATED_SECRET_EXECUTION' THEN 2 ELSE 0 END AS top,
    CASE attack_type WHEN 'CORRELATED_SECRET_EXECUTION' THEN 1 WHEN 'UNKNOWN' THEN 0 ELSE 2 END AS topc FROM good),
spoiled AS (SELECT policy_id, path_id, violated OR left(path_id, 1) = '8' AS violated, CASE left(path_id, 1) WHEN '7' THEN ' ' ELSE reason END AS reason FROM results
  UNION ALL SELECT policy_id, path_id, violated, reason FROM results WHERE left(path_id, 1) = '9'),
nodeset AS (SELECT source AS id FROM graph WHERE target NOT LIKE 'ACTION:node' UNION SELECT target FROM graph WHERE target NOT LIKE 'ACTION:node'),
sub AS (SELECT *, CASE WHEN path_id = '' THEN '<no path_id>' ELSE path_id END AS subject FROM bad),
byid AS (SELECT path_id, any_value(attack_type) AS attack_type FROM bad WHERE path_id <> '' GROUP BY path_id),
named AS (SELECT *, path_id <> '' AS has FROM sub),
viol AS (SELECT 'missing_path_id' AS kind, subject, 'the path has no identity' AS detail FROM sub WHERE path_id = ''
  UNION ALL SELECT 'path_id_mismatch', subject, 'the identity is not that of the walk' FROM sub WHERE path_id <> '' AND (path_id <> own OR d = '5')
  UNION ALL SELECT 'non_contiguous_walk', subject, 'the edges are no walk over the nodes' FROM sub WHERE d = '5'
  UNION ALL SELECT 'phantom_node', subject, 'node ' || n || ' is not in the graph' FROM (SELECT subject, unnest(nodes) AS n FROM sub) WHERE n NOT IN (SELECT id FROM nodeset)
  UNION ALL SELECT 'phantom_edge', s.subject, 'edge ' || pe.source || ' -' || pe.type || '-> ' || pe.target || ' is not in the graph' FROM sub s JOIN pe ON pe.path_id = s.own WHERE pe.type = 'SENDS_TO' AND pe.target LIKE '%h6'
  UNION ALL SELECT 'unproven_severity', subject, 'severity ' || severity || ' is more than ' || attack_type || ' proves' FROM sub WHERE {SEV.format(c='severity')} > top
  UNION ALL SELECT 'unproven_confidence', subject, 'confidence ' || confidence || ' is more than ' || attack_type || ' proves' FROM sub WHERE {CONF.format(c='confidence')} > topc
  UNION ALL SELECT 'risk_above_ceiling', subject, 'risk_severity ' || risk_severity || ' is more than ' || attack_type || ' proves' FROM sub WHERE {SEV.format(c='risk_severity')} > top
  UNION ALL SELECT 'severity_without_evidence', subject, 'risk_severity ' || risk_severity || ' without evidence' FROM sub WHERE risk_severity <> 'INFO' AND len(evidence) = 0
  UNION ALL SELECT 'orphan_policy_result', policy_id || '@' || path_id, 'the path was not evaluated' FROM spoiled WHERE path_id NOT IN (SELECT path_id FROM byid)
  UNION ALL SELECT 'duplicate_policy_result', policy_id || '@' || path_id, 'the pair was evaluated again' FROM spoiled JOIN byid USING (path_id) GROUP BY policy_id, path_id HAVING count(*) > 1
  UNION ALL SELECT 'violation_without_proof', policy_id || '@' || path_id, 'violated on a path without proven semantics' FROM spoiled JOIN byid USING (path_id) WHERE violated AND attack_type = 'UNKNOWN'
  UNION ALL SELECT 'violation_without_reason', policy_id || '@' || path_id, 'violated with an empty reason' FROM spoiled JOIN byid USING (path_id) WHERE violated AND trim(reason) = '')"""
FULL = "CASE WHEN n % 2 = 0 THEN 'full' ELSE 'partial' END"
DECLARED = """existing AS (SELECT 'SKILL:' || n_name AS id, 'SKILL' AS type FROM nation),
comps AS (SELECT 'AGENT:' || r_name AS node_id, 'AGENT' AS node_type FROM region UNION ALL SELECT 'TOOL:' || s_name, CASE WHEN s_suppkey % 7 = 0 THEN 'DATA' ELSE 'TOOL' END FROM supplier
  UNION ALL SELECT 'SKILL:' || n_name, 'AGENT' FROM nation WHERE n_regionkey = 2),
rels AS (SELECT 'AGENT:' || r_name AS s, 'SKILL:' || n_name AS t, 'CONTAINS' AS e FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'SKILL:' || n_name, 'TOOL:' || s_name, CASE s_suppkey % 5 WHEN 0 THEN 'READS' WHEN 1 THEN 'HANDOFF' ELSE 'USES' END FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'SKILL:' || n_name, 'SKILL:' || n_name, 'HANDOFF' FROM nation UNION ALL SELECT 'TOOL:none' || n_nationkey, 'SKILL:' || n_name, 'TRUSTS' FROM nation),
decl AS (SELECT id AS node_id, type AS node_type FROM existing UNION SELECT node_id, node_type FROM comps WHERE node_type <> 'DATA'),
types AS (SELECT node_id, min(node_type) AS node_type FROM decl GROUP BY node_id),
allowed(st, e, tt) AS (VALUES """ + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in vocab.DECLARATION_MATRIX) + ")"

ORACLES = {
    "component_id": f"WITH {carriers.DOCS_SQL} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '<unknown>' ELSE path END AS component FROM docs",
    "finding_to_edge": f"WITH {FINDING_EDGES} SELECT component, source, target, type, signal, line, rule_id FROM fe",
    "merge_edges": f"WITH {FINDING_EDGES} SELECT component, source, target, type, {SEV_NAME.format(c='s')} AS severity, CASE WHEN c > 0 THEN {CONF_NAME.format(c='c')} END AS confidence, n_facts FROM merged",
    "edge_facts": f"""WITH {FINDING_EDGES} SELECT DISTINCT component, source, target, type, 'rule' AS fact, rule_id AS value FROM fe
        UNION SELECT component, source, target, type, 'file', path FROM fe UNION SELECT component, source, target, type, 'line', CAST(line AS VARCHAR) FROM fe
        UNION SELECT component, source, target, type, 'evidence', evidence FROM fe""",
    "action_edges_text": f"WITH {SEGMENTS_SQL}, {action_sql('steps', 'path')} SELECT * FROM acted",
    "action_edges_events": f"WITH {ACTIONS_SQL}, {action_sql('actions', 'component')} SELECT * FROM acted",
    "graph_neighbors": f"WITH {ACTIONS_SQL}, {action_sql('actions', 'component')} SELECT source, component, target, type FROM acted WHERE source IN (SELECT target FROM acted WHERE target LIKE 'DATA:%')",
    "security_graph": f"WITH {CORPUS_GRAPH} SELECT * FROM graph",
    "graph_nodes": f"WITH {CORPUS_GRAPH} SELECT DISTINCT id, split_part(id, ':', 1) AS type, substr(id, position(':' IN id) + 1) AS label FROM (SELECT source AS id FROM graph UNION SELECT target FROM graph)",
    "declaration_violations": f"""WITH {DECLARED} SELECT DISTINCT * FROM (
        SELECT 'component_type' AS kind, node_id || ' ' || node_type AS subject FROM comps WHERE node_type = 'DATA'
        UNION ALL SELECT 'type_conflict', node_id FROM decl GROUP BY node_id HAVING count(*) > 1
        UNION ALL SELECT 'self_loop', s || ' ' || e || ' ' || t FROM rels WHERE s = t
        UNION ALL SELECT 'edge_type', s || ' ' || e || ' ' || t FROM rels WHERE e = 'READS'
        UNION ALL SELECT 'undeclared_source', s || ' ' || e || ' ' || t FROM rels WHERE s NOT IN (SELECT node_id FROM decl)
        UNION ALL SELECT 'undeclared_target', s || ' ' || e || ' ' || t FROM rels WHERE t NOT IN (SELECT node_id FROM decl)
        UNION ALL SELECT 'unsupported', s || ' ' || e || ' ' || t FROM rels JOIN types a ON a.node_id = s JOIN types b ON b.node_id = t
          WHERE s <> t AND NOT EXISTS (SELECT 1 FROM allowed WHERE st = a.node_type AND allowed.e = rels.e AND tt = b.node_type))""",
    "apply_declarations": f"WITH {DECLARED} SELECT DISTINCT s AS source, t AS target, e AS type FROM rels WHERE s <> 'AGENT:ASIA'",
    "read_origins": f"{G} SELECT component, source, target FROM reads",
    "flow_walks": f"{G} SELECT component, origin, array_to_string(walk, ' > ') AS walk, sev, conf FROM walks",
    "exfiltration_paths": f"{G} SELECT component, array_to_string(nodes, ' > ') AS nodes, kind, sev, conf FROM exfil",
    "correlation_paths": f"{G} SELECT component, array_to_string(nodes, ' > ') AS nodes, secret, sev, conf FROM shared",
    "handoff_heads": f"{G} SELECT source FROM heads",
    "handoff_paths": f"{G} SELECT component, array_to_string(nodes, ' > ') AS nodes, sev, conf FROM handed",
    "attack_paths": f"{G} {SHOW_SQL}",
    "corpus_attack_paths": f"WITH RECURSIVE {CORPUS_GRAPH}, {PATHS} {SHOW_SQL}",
    "path_risk": f"{G} SELECT path_id, risk_severity, risk_confidence, risk_score, array_to_string(evidence, '; ') AS evidence, "
    + "CASE attack_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in vocab.EXPLANATIONS.items()) + " ELSE '' END AS explanation FROM p",
    "path_contiguity": f"{G} SELECT path_id, true AS sound, false AS reversed FROM p",
    "path_breakpoints": f"{G} SELECT path_id, associated, pos, source, target, type, {IMPACT} AS impact, {REASON} AS reason FROM pe WHERE {BREAK}",
    "path_composition": f"{G} SELECT path_id, array_to_string(list_transform(nodes, lambda n: substr(n, 7)), ' > ') AS components FROM p WHERE kind = 'handoff'",
    "path_provenance": f"{G}, {OWNERS} SELECT path_id, pos, associated, owner FROM owned",
    "path_node_provenance": f"{G}, {OWNERS} SELECT DISTINCT path_id, node, owner FROM (SELECT path_id, source AS node, owner FROM owned UNION SELECT path_id, target, owner FROM owned)",
    "path_explanation": f"""{G}, {OWNERS}, {RESULTS}, own AS (SELECT path_id, string_agg(DISTINCT owner, ',' ORDER BY owner) AS components FROM owned GROUP BY path_id),
        pol AS (SELECT path_id, string_agg(policy_id, ',') AS policies FROM results WHERE violated GROUP BY path_id),
        brk AS (SELECT path_id, string_agg(source || ' --' || type || '--> ' || target || ' [' || {IMPACT} || ']: ' || {REASON}, chr(10) ORDER BY associated, pos) AS breakpoints FROM pe WHERE {BREAK} GROUP BY path_id)
        SELECT path_id, {"CASE attack_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in vocab.SUMMARIES.items()) + " END"} AS summary, nodes[1] AS entry, nullif(asset, '') AS asset,
        CASE WHEN kind <> 'handoff' THEN nodes[-1] END AS sink, array_to_string(list_transform(edges, lambda e: e.source || ' --' || e.type || '--> ' || e.target), chr(10)) AS steps,
        CASE WHEN secret IS NULL THEN '' ELSE nodes[1] || ' --READS--> ' || secret END AS associated,
        'Severity ' || risk_severity || ', confidence ' || risk_confidence || ', risk score ' || risk_score || '.' AS impact,
        coalesce(policies, '') AS policies, coalesce(breakpoints, '') AS breakpoints, coalesce(components, '') AS components
        FROM p LEFT JOIN own USING (path_id) LEFT JOIN pol USING (path_id) LEFT JOIN brk USING (path_id)""",
    "path_entry_files": f"{G} SELECT path_id, substr(nodes[1], 7) AS file FROM p WHERE substr(nodes[1], 7) IN (SELECT 'c' || (event_id // {carriers.ACTIONS_PER_COMPONENT}) FROM events WHERE event_type = 'purchase' AND value > 60)",
    "path_context": f"{C} SELECT DISTINCT pe.path_id, v.component_id, v.component_type, pe.source, v.edge_type, pe.target, v.assoc_source FROM pe JOIN valid v ON v.component = pe.component AND v.source = pe.source AND v.target = pe.target AND v.edge_type = pe.type",
    "highest_risk_path": f"{G} SELECT component, unnest(arg_min({{'path_id': path_id, 'attack_type': attack_type, 'risk_severity': risk_severity, 'risk_score': risk_score}}, (-risk_score, path_id))) FROM p GROUP BY component",
    "policy_evaluate": f"{G}, {RESULTS} SELECT policy_id, path_id, violated, reason FROM results",
    "policy_associate": f"{G}, {RESULTS} SELECT path_id, coalesce(string_agg(policy_id, ',') FILTER (violated), '') AS policy_ids FROM results GROUP BY path_id",
    "policy_status": f"""{G}, {RESULTS}, cov AS (SELECT component, count(*) AS n FROM graph GROUP BY component), f AS (SELECT component, bool_or(violated) AS failed FROM results GROUP BY component)
        SELECT component, CASE WHEN coalesce(failed, false) THEN 'FAIL' WHEN coalesce({FULL}, 'none') <> 'full' THEN 'UNKNOWN' ELSE 'PASS' END AS policy_status FROM cov FULL JOIN f USING (component)""",
    "policy_violation_counts": f"{G}, {RESULTS} SELECT component, policy_id, count(*) AS violations FROM results WHERE violated GROUP BY ALL",
    "policy_violated_paths": f"{G}, {RESULTS} SELECT component, policy_id, path_id FROM results WHERE violated",
    "check_sound_run": f"{G}, {RESULTS} SELECT (SELECT count(*) FROM p) AS paths, (SELECT count(*) FROM results) AS results, CAST(0 AS BIGINT) AS violations",
    "check_spoiled_kinds": f"{SPOILED} SELECT kind, count(*) AS n, count(DISTINCT subject) AS subjects FROM viol GROUP BY kind",
    "check_spoiled_rows": f"{SPOILED} SELECT kind, subject, detail FROM viol",
    "proof_checks": f"""{G} SELECT path_id, attack_type, clause, true AS ok FROM (SELECT path_id, attack_type, unnest(CASE WHEN kind = 'execution'
        THEN ['contiguous-walk', 'skill-executes-action', 'associated-secret-read', 'no-secret-to-action-edge']
        ELSE ['contiguous-walk', 'reads-into-asset', 'sends-to-endpoint', 'flows-to-lineage', 'asset-kind-matches-type'] END) AS clause FROM p WHERE kind <> 'handoff')""",
    "context_violations": f"""{C} SELECT DISTINCT kind, subject FROM (SELECT component_id || ' ' || component_type || ' ' || source || ' ' || edge_type || ' ' || target AS subject, unnest([
        CASE WHEN component_type = 'DATA' THEN 'component_type' END, CASE WHEN edge_type = 'USES' THEN 'edge_type' END,
        CASE WHEN component_id NOT IN (SELECT id FROM gnodes) THEN 'unknown_component' WHEN split_part(component_id, ':', 1) <> component_type THEN 'type_mismatch' END,
        CASE WHEN NOT EXISTS (SELECT 1 FROM graph g WHERE g.component = c.component AND g.source = c.source AND g.target = c.target AND g.type = c.edge_type) THEN 'unknown_edge' END]) AS kind FROM context c) WHERE kind IS NOT NULL""",
    "context_list": f"{C} SELECT component_id, component_type, source, edge_type, target, assoc_source FROM valid",
    "component_scope": f"{C} SELECT DISTINCT component_id, component_type, source, edge_type, target FROM valid",
    "component_participation": f"{C} SELECT * FROM onpath",
    "component_composition": f"""{C}, firsts AS (SELECT path_id, component_id, component_type, min((source, edge_type, target)) AS f, count(*) AS behaviours FROM onpath GROUP BY path_id, component_id, component_type)
        SELECT path_id, component_id, component_type, behaviours, CAST(row_number() OVER (PARTITION BY path_id ORDER BY f, component_type, component_id) AS INTEGER) AS place FROM firsts""",
    "handoff_edges": "SELECT DISTINCT c_mktsegment AS target_id, 'n' || c_nationkey AS component, 'SKILL:n' || c_nationkey AS source, 'SKILL:n' || (c_custkey % 25) AS target, 'HANDOFF' AS type FROM customer",
    "handoff_heads_by_target": """WITH h AS (SELECT DISTINCT c_mktsegment AS target_id, c_nationkey AS s, c_custkey % 25 AS t FROM customer WHERE c_nationkey < c_custkey % 25 AND (c_custkey % 25) % 3 <> 0)
        SELECT DISTINCT target_id, 'SKILL:n' || s AS source FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.target_id = h.target_id AND g.t = h.s)""",
    "attack_types": f"{G} SELECT DISTINCT component, attack_type FROM p WHERE attack_type <> 'UNKNOWN'",
    "cut_walks": f"""{G} SELECT DISTINCT w.component, w.origin, array_to_string(w.walk, ' > ') AS walk FROM walks w JOIN ranked e ON e.component = w.component AND e.source = w.last
        AND e.type = 'FLOWS_TO' AND NOT list_contains(w.walk, e.target) WHERE w.depth = 2""",
    "component_risk_evidence": f"""{C}, lab AS (SELECT *, CASE WHEN edge_type = 'READS' AND target LIKE 'SECRET:%' THEN 'secret read' WHEN edge_type = 'READS' AND target LIKE 'DATA:%' THEN 'sensitive data read'
          WHEN edge_type = 'FLOWS_TO' THEN 'sensitive data flow' WHEN edge_type = 'SENDS_TO' THEN 'external network send' WHEN edge_type = 'EXECUTES' THEN 'execution' END AS label FROM onpath),
        agg AS (SELECT path_id, component_id, component_type, count(*) AS behaviours, list(DISTINCT label) AS labels FROM lab WHERE label IS NOT NULL GROUP BY ALL)
        SELECT path_id, component_id, component_type, behaviours, array_to_string(list_filter({'[' + ', '.join(q(x) for x in vocab.EVIDENCE_ORDER) + ']'}, lambda x: list_contains(labels, x) AND list_contains(evidence, x)), '; ') AS evidence,
        risk_severity, risk_confidence FROM agg JOIN p USING (path_id)""",
}
