"""Typed nodes and edges from findings, actions and declarations.

Edges carry their target (``keys``) and their component, so every component is a
graph of its own and the components of one target together are its merged graph. What an edge is based on (rules, files,
lines, evidence) stays rows in a fact table; the edge itself keeps only what
paths need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.functions import text as tx
from wardlight.operators.targets import by_target
from wardlight.session import constant_table

EDGE_KEY = ["component", "source", "target", "type"]
AGENT = "AGENT:<agent>"
# fixed values
URL = r"https?://[^\s'\"]+"
SECRET_NAME = r"(?:\.env\b|\.aws\S*|\.ssh\S*|credentials\S*|id_rsa|id_ed25519|\.pem\b|\.key\b)"
SERVER_NAME = r"server\s+'([^']+)'"
EXEC_TITLE = r"\b(?:command|shell|eval|execution|exec|encoded content executed|dynamic code)\b"
EXFIL_TITLE = r"\b(?:exfiltration|source-to-sink)\b"
REMOTE_TITLE = r"\bremote mcp execution\b"


def component_id(path: Column) -> Column:
    """A path as component identity, independent of the machine."""
    plain = F.rtrim(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("<unknown>"))


def kind_of(node: Column) -> Column:
    """Node type, the part before the first colon; null without one."""
    return F.when(node.contains(":"), F.substring_index(node, ":", 1))


def label_of(node: Column) -> Column:
    return F.substring(node, F.length(F.substring_index(node, ":", 1)) + 2, F.length(node))


def _first_of(pattern: str, group: int, *texts: Column) -> Column:
    return F.coalesce(*[F.nullif(tx.first_match(F.coalesce(t, F.lit("")), pattern, group, fold=True), F.lit("")) for t in texts])


def identities(findings: DataFrame) -> DataFrame:
    """Concrete things a finding names: ``endpoint``, ``secret``, ``server``."""
    shown, evidence = F.col("matched_text"), F.col("evidence")
    return (
        findings.withColumn("endpoint", tx.strip_url_tail(_first_of(URL, 0, shown, evidence)))
        .withColumn("secret", F.lower(_first_of(SECRET_NAME, 0, shown, evidence)))
        .withColumn("server", _first_of(SERVER_NAME, 1, F.col("description")))
    )


def finding_edges(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per finding that says something about the graph.

    The cases are tried in a fixed order. A finding that names no concrete
    object points at an action of its own place.
    """
    title, desc = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("description", F.lit("")))
    named = identities(findings).withColumn("component", component_id(F.col("path")))

    def case(signal: str, kind: str, edge: str, thing: Column) -> Column:
        return F.struct(
            F.lit(signal).alias("signal"), F.lit(kind).alias("kind"), F.lit(edge).alias("type"),
            thing.cast("string").alias("thing"),
        )

    endpoint, secret, server = F.col("endpoint"), F.col("secret"), F.col("server")
    nothing = F.lit(None)
    uses = title.contains("network access") | title.contains("suspicious url") | title.contains("download and execute")
    spec = (
        F.when(title.contains("sensitive credential") | (desc.contains("credential") & secret.isNotNull()),
               case("reads-secret", "SECRET", "READS", secret))
        .when(title.contains("hardcoded secret"), case("contains-secret", "SECRET", "CONTAINS", secret))
        .when(tx.has(title, EXEC_TITLE), case("executes", "ACTION", "EXECUTES", nothing))
        .when(tx.has(title, EXFIL_TITLE), case("sends-to-endpoint", "ENDPOINT", "SENDS_TO", endpoint))
        .when(tx.has(title, REMOTE_TITLE), case("trusts-mcp", "MCPSERVER", "TRUSTS", server))
        .when(endpoint.isNotNull() & uses, case("uses-endpoint", "ENDPOINT", "USES", endpoint))
        .when(server.isNotNull() & desc.contains("mcp"), case("uses-mcp", "MCPSERVER", "USES", server))
        .when(title.contains("prompt injection"), case("contains-action", "ACTION", "CONTAINS", nothing))
    )
    place = F.concat(
        F.lit("ACTION:"), "component", F.lit(":"), F.coalesce("line", F.lit(0)).cast("string"), F.lit(":"), F.col("spec.signal")
    )
    concrete = F.concat(F.col("spec.kind"), F.lit(":"), F.col("spec.thing"))
    return named.withColumn("spec", spec).where("spec IS NOT NULL").select(
        *keys, "component",
        F.concat(F.lit("SKILL:"), "component").alias("source"),
        F.coalesce(concrete, place).alias("target"),
        F.col("spec.type").alias("type"),
        F.col("spec.signal").alias("signal"),
        F.when(concrete.isNull(), F.concat("spec.signal", F.lit(" ("), "spec.type", F.lit(")"))).otherwise(F.col("spec.thing")).alias("label"),
        "rule_id", "path", "line", "evidence", "severity", "confidence",
    )


def merge_edges(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One edge per (target, component, source, target, type) with the strongest metadata.

    Severity starts at LOW; a confidence of LOW counts as none.
    """
    merged = rows.groupBy(*keys, *EDGE_KEY).agg(
        F.max(tx.severity_rank(F.col("severity"))).alias("s"),
        F.max(tx.confidence_rank(F.col("confidence"))).alias("c"),
        F.count("*").alias("n_facts"),
    )
    return merged.select(
        *keys, *EDGE_KEY,
        tx.severity_name(F.greatest(F.col("s"), F.lit(1))).alias("severity"),
        tx.confidence_name(F.when(F.col("c") > 0, F.col("c"))).alias("confidence"),
        "n_facts",
    )


def edge_facts(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What edges are based on: distinct (edge, fact kind, value) rows."""
    def fact(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("fact"), value.alias("value"))

    facts = F.array(
        fact("rule", F.col("rule_id")),
        fact("file", F.col("path")),
        fact("line", F.when(F.col("line") > 0, F.col("line").cast("string"))),
        fact("evidence", F.nullif("evidence", F.lit(""))),
    )
    return rows.select(*keys, *EDGE_KEY, F.inline(facts)).where("value IS NOT NULL").distinct()


def skill_edges(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The agent contains every component that has a finding in the graph."""
    skills = rows.select(*keys, "component", F.col("source").alias("target")).distinct()
    return skills.select(*keys, "component", F.lit(AGENT).alias("source"), "target", F.lit("CONTAINS").alias("type"))


def action_edges(actions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Edges of ordered actions, each owned by its component (repeats kept out).

    ``actions``: component, category, verb, object, destination, output.
    """
    obj, out, dest = F.coalesce(F.trim("object"), F.lit("")), F.coalesce(F.trim("output"), F.lit("")), F.trim("destination")
    skill = F.concat(F.lit("SKILL:"), "component")

    def edge(source: Column, target: Column, kind: str) -> Column:
        return F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"))

    def node(kind: str, key: Column) -> Column:
        return F.concat(F.lit(kind + ":"), key)

    cat, has_dest = F.upper("category"), F.coalesce(F.col("destination"), F.lit("")) != ""
    flow = (cat == "TRANSFORM") & (obj != "") & (out != "")
    sends = (cat == "NETWORK") & has_dest
    edges = F.array_compact(F.array(
        F.when(cat == "SOURCE", edge(skill, node("DATA", obj), "READS")),
        F.when(cat == "SENSITIVE", edge(skill, node("SECRET", obj), "READS")),
        F.when(flow, edge(skill, node("DATA", out), "PRODUCES")),
        F.when(flow, edge(node("DATA", obj), node("DATA", out), "FLOWS_TO")),
        F.when(sends, edge(skill, node("ENDPOINT", dest), "SENDS_TO")),
        F.when(sends & (obj != ""), edge(node("DATA", obj), node("ENDPOINT", dest), "SENDS_TO")),
        F.when((cat == "DOWNLOAD") & has_dest, edge(skill, node("ENDPOINT", dest), "USES")),
        F.when(cat == "EXECUTION", edge(skill, node("ACTION", F.lower("verb")), "EXECUTES")),
        F.when((cat == "TRANSFER") & has_dest, edge(skill, node("SKILL", dest), "HANDOFF")),
    ))
    return actions.select(*keys, "component", F.inline(edges)).distinct()


def handoff_edges(handoffs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Declared control transfers (component, to) as edges of the giving component."""
    return handoffs.select(
        *keys, "component", F.concat(F.lit("SKILL:"), "component").alias("source"),
        F.concat(F.lit("SKILL:"), F.col("to")).alias("target"), F.lit("HANDOFF").alias("type"),
    ).distinct()


def security_graph(finding_rows: DataFrame, from_actions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All edges per target and component. An action edge stands over a finding edge of the same key:
    it carries no severity, and the later record of an edge is the one paths consult."""
    shown = [*keys, *EDGE_KEY]
    nothing = F.lit(None).cast("string")
    found = merge_edges(finding_rows, keys).select(*shown, "severity", "confidence", F.lit(False).alias("by_action"))
    agent = skill_edges(finding_rows, keys).select(*shown, nothing.alias("severity"), nothing.alias("confidence"), F.lit(False).alias("by_action"))
    acted = from_actions.select(*shown, nothing.alias("severity"), nothing.alias("confidence"), F.lit(True).alias("by_action"))
    merged = found.unionByName(agent).unionByName(acted).groupBy(*shown).agg(
        F.bool_or("by_action").alias("by_action"), F.max("severity").alias("_s"), F.max("confidence").alias("_c")
    )
    return merged.select(
        *shown,
        F.when(~F.col("by_action"), F.col("_s")).alias("severity"),
        F.when(~F.col("by_action"), F.col("_c")).alias("confidence"),
        "by_action",
    )


def nodes_of(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct nodes of an edge table: id, type, label."""
    ends = edges.select(*keys, F.explode(F.array("source", "target")).alias("id")).distinct()
    return ends.select(*keys, "id", kind_of(F.col("id")).alias("type"), label_of(F.col("id")).alias("label"))


@by_target()
def neighbors(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Out-edges of the given nodes (``id``)."""
    return edges.join(nodes.select(*keys, F.col("id").alias("source")).distinct(), [*keys, "source"], "left_semi")


# --------------------------------------------------------------- declarations


def matrix(spark: SparkSession) -> DataFrame:
    return constant_table(spark, ["source_type", "edge_type", "target_type"], vocab.DECLARATION_MATRIX)


def declaration_violations(nodes: DataFrame, components: DataFrame, relationships: DataFrame) -> DataFrame:
    """Why a set of declarations cannot be applied: (kind, subject) rows; none means it can.

    ``nodes``: id, type of the graph so far. ``components``: node_id, node_type.
    ``relationships``: source_id, target_id, edge_type.
    """
    spark = nodes.sparkSession
    known = nodes.where(F.col("type").isin(vocab.COMPONENT_TYPES)).select(F.col("id").alias("node_id"), F.col("type").alias("node_type"))
    clean = components.select(F.trim("node_id").alias("node_id"), "node_type")
    bad_type = clean.where(~F.col("node_type").isin(vocab.COMPONENT_TYPES)).select(
        F.lit("component_type").alias("kind"), F.concat_ws(" ", "node_id", "node_type").alias("subject")
    )
    empty = clean.where("node_id = ''").select(F.lit("empty_id").alias("kind"), F.col("node_type").alias("subject"))
    good = clean.where(F.col("node_type").isin(vocab.COMPONENT_TYPES) & (F.col("node_id") != ""))
    declared = known.unionByName(good).distinct()
    conflict = declared.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1").select(
        F.lit("type_conflict").alias("kind"), F.col("node_id").alias("subject")
    )
    rel = relationships.select(F.trim("source_id").alias("source_id"), F.trim("target_id").alias("target_id"), "edge_type")
    named = F.concat_ws(" ", "source_id", "edge_type", "target_id").alias("subject")
    self_loop = rel.where("source_id = target_id").select(F.lit("self_loop").alias("kind"), named)
    bad_edge = rel.where(~F.col("edge_type").isin(vocab.RELATIONSHIP_TYPES)).select(F.lit("edge_type").alias("kind"), named)
    ids = declared.select("node_id").distinct()
    missing = rel.join(ids, rel.source_id == ids.node_id, "left_anti").select(F.lit("undeclared_source").alias("kind"), named).unionByName(
        rel.join(ids, rel.target_id == ids.node_id, "left_anti").select(F.lit("undeclared_target").alias("kind"), named)
    )
    types = declared.groupBy("node_id").agg(F.min("node_type").alias("node_type"))
    typed = (
        rel.where("source_id <> target_id")
        .join(types.toDF("source_id", "source_type"), "source_id")
        .join(types.toDF("target_id", "target_type"), "target_id")
    )
    unsupported = typed.join(F.broadcast(matrix(spark)), ["source_type", "edge_type", "target_type"], "left_anti").select(
        F.lit("unsupported").alias("kind"), named
    )
    rows = [bad_type, empty, conflict, self_loop, bad_edge, missing, unsupported]
    result = rows[0]
    for r in rows[1:]:
        result = result.unionByName(r)
    return result.distinct()


def apply_declarations(edges: DataFrame, relationships: DataFrame) -> DataFrame:
    """New edges of valid declarations; applying them twice adds nothing."""
    new = relationships.select(
        F.trim("source_id").alias("source"), F.trim("target_id").alias("target"), F.col("edge_type").alias("type")
    ).distinct()
    return new.join(edges.select("source", "target", "type").distinct(), ["source", "target", "type"], "left_anti")
