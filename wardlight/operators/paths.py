"""Attack paths: walks over edge tables, their identity, class, risk and proof.

``keys`` names the columns of one target, wherever it occurs. Equal names in two
targets are different things: every join, grouping and identity holds within a target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.functions import text as tx
from wardlight.operators.graph import EDGE_KEY, kind_of, label_of
from wardlight.operators.targets import by_target
from wardlight.session import cut

PATH_COLUMNS = ["component", "nodes", "edges", "associated_edges", "sev", "conf", "kind"]
MEDIUM = vocab.SEVERITY_RANK["MEDIUM"]
MEDIUM_CONF = vocab.CONFIDENCE_RANK["MEDIUM"]


def ranked_edges(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per edge key with numeric ranks; unknown metadata stays null."""
    return edges.groupBy(*keys, *EDGE_KEY).agg(
        F.max(tx.severity_rank(F.col("severity"))).alias("sev"),
        F.max(tx.confidence_rank(F.col("confidence"))).alias("conf"),
    )


def read_origins(edges: DataFrame) -> DataFrame:
    """READS edges of skills into secrets and data."""
    return edges.where(
        (F.col("type") == "READS")
        & (kind_of(F.col("source")) == "SKILL")
        & kind_of(F.col("target")).isin("SECRET", "DATA")
    )


def _of_type(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.col("type") == kind)


@by_target()
def flow_walks(flows: DataFrame, origins: DataFrame, limit: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """All simple FLOWS_TO walks from the origins, the empty walk included; a walk visits no node twice.

    ``origins``: keys, component, origin. Each level joins on (component, last), so a
    level is spread by its open ends; it is written out before the next one. A caller
    may bound the edges of a walk by ``limit``; ``cut_walks`` then names what it cut.
    """
    place = [*keys, "component"]
    steps = flows.select(*place, F.col("source").alias("last"), F.col("target").alias("to"), F.col("sev").alias("s"), F.col("conf").alias("c"))
    level = cut(origins.select(*place, "origin").distinct()).select(  # read by the next level and with all walks
        *place, "origin", F.col("origin").alias("last"), F.array("origin").alias("walk"),
        F.lit(None).cast("int").alias("sev"), F.lit(None).cast("int").alias("conf"),
    )
    walks, depth = level, 0
    while limit is None or depth < limit:
        depth += 1
        level = cut(
            level.join(steps, [*place, "last"])
            .where(~F.array_contains("walk", F.col("to")))
            .select(
                *place, "origin", F.col("to").alias("last"), F.array_append("walk", F.col("to")).alias("walk"),
                F.greatest("sev", "s").alias("sev"), F.greatest("conf", "c").alias("conf"),
            )
        )
        if level.isEmpty():
            break
        walks = walks.unionByName(level)
    return walks


@by_target()
def cut_walks(walks: DataFrame, flows: DataFrame, limit: int, keys: Sequence[str] = ()) -> DataFrame:
    """Walks of ``limit`` edges that a further edge would continue: keys, component, origin, walk."""
    place = [*keys, "component"]
    steps = flows.select(*place, F.col("source").alias("last"), F.col("target").alias("to"))
    full = walks.where(F.size("walk") == limit + 1).join(steps, [*place, "last"])
    return full.where(~F.array_contains("walk", F.col("to"))).select(*place, "origin", "walk").distinct()


def _can_reach(flows: DataFrame, goals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nodes (keys, component, node) from which a goal is reachable; a set, so it stays linear.

    What every round reads is written once, without what it does not need.
    """
    place = [*keys, "component"]
    back = cut(flows.select(*place, F.col("source").alias("node"), F.col("target").alias("to")))
    known = cut(goals.select(*place, "node").distinct())
    fresh = known
    while True:
        fresh = cut(
            back.join(fresh.withColumnRenamed("node", "to"), [*place, "to"])
            .select(*place, "node")
            .distinct()
            .join(known, [*place, "node"], "left_anti")
        )
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)


def reached(flows: DataFrame, starts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nodes (keys, component, node) that flows lead to from the starts, these included."""
    turned = flows.select(*keys, "component", F.col("target").alias("source"), F.col("source").alias("target"))
    return _can_reach(turned, starts, keys)


@by_target()
def attack_types(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, component, attack_type) of the proven attack types, without listing a path.

    A component has an exfiltration path when a send is reachable from something its
    skill reads, and a correlated execution when a skill both reads a secret and executes.
    """
    place = [*keys, "component"]
    ranked = cut(ranked_edges(edges.where("type IN ('READS', 'FLOWS_TO', 'SENDS_TO', 'EXECUTES')"), keys))
    reads, flows = read_origins(ranked), _of_type(ranked, "FLOWS_TO")
    sends = _of_type(ranked, "SENDS_TO").where(kind_of(F.col("target")) == "ENDPOINT")
    ends = sends.select(*place, F.col("source").alias("node"))
    useful = _can_reach(flows, ends, keys).withColumnRenamed("node", "target")
    leaked = reads.join(useful, [*place, "target"], "left_semi")
    named = F.when(kind_of(F.col("target")) == "SECRET", F.lit("SECRET_EXFILTRATION")).otherwise(F.lit("DATA_EXFILTRATION"))
    runs = _of_type(ranked, "EXECUTES").where(kind_of(F.col("target")) == "ACTION").select(*place, "source")
    shared = reads.where(kind_of(F.col("target")) == "SECRET").join(runs, [*place, "source"], "left_semi")
    rows = leaked.select(*place, named.alias("attack_type"))
    return rows.unionByName(shared.select(*place, F.lit("CORRELATED_SECRET_EXECUTION").alias("attack_type"))).distinct()


def _walk_edges(nodes: Column) -> Column:
    """Edges of an exfiltration walk: READS, FLOWS_TO ..., SENDS_TO."""
    last = F.size(nodes) - 2
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            F.get(nodes, i).alias("source"), F.get(nodes, i + 1).alias("target"),
            F.when(i == 0, F.lit("READS")).when(i == last, F.lit("SENDS_TO")).otherwise(F.lit("FLOWS_TO")).alias("type"),
        ),
    )


def _no_edges() -> Column:
    return F.array().cast("array<struct<source:string,target:string,type:string>>")


@by_target()
def exfiltration_paths(edges: DataFrame, limit: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """skill READS origin, origin FLOWS_TO ... , last SENDS_TO endpoint.

    Walks are grown only along edges that can still end at a send.
    """
    return _exfiltration(cut(ranked_edges(edges.where("type IN ('READS', 'FLOWS_TO', 'SENDS_TO')"), keys)), limit, keys)


def _exfiltration(edges: DataFrame, limit: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    place = [*keys, "component"]
    reads, flows, sends = read_origins(edges), _of_type(edges, "FLOWS_TO"), _of_type(edges, "SENDS_TO")
    useful = _can_reach(flows, sends.select(*place, F.col("source").alias("node")), keys)
    useful_flows = cut(flows.join(useful.withColumnRenamed("node", "target"), [*place, "target"], "left_semi"))
    origins = reads.select(*place, F.col("target").alias("node")).distinct().join(useful, [*place, "node"], "left_semi")
    walks = flow_walks(useful_flows, origins.withColumnRenamed("node", "origin"), limit, keys)
    start = reads.select(*place, F.col("target").alias("origin"), F.col("source").alias("skill"), F.col("sev").alias("rs"), F.col("conf").alias("rc"))
    end = sends.select(*place, F.col("source").alias("last"), F.col("target").alias("endpoint"), F.col("sev").alias("es"), F.col("conf").alias("ec"))
    nodes = F.concat(F.array("skill"), "walk", F.array("endpoint"))
    kind = (
        F.when(kind_of(F.col("origin")) == "SECRET", F.lit("exposure"))
        .when(F.size("walk") > 1, F.lit("sensitive-data"))
        .otherwise(F.lit("data"))
    )
    return (
        walks.join(end, [*place, "last"])
        .join(start, [*place, "origin"])
        .select(
            *place, nodes.alias("nodes"), kind.alias("kind"),
            F.greatest("sev", "rs", "es", F.lit(MEDIUM)).alias("sev"),
            F.greatest("conf", "rc", "ec", F.lit(MEDIUM_CONF)).alias("conf"),
        )
        .select(*place, "nodes", _walk_edges(F.col("nodes")).alias("edges"), _no_edges().alias("associated_edges"), "sev", "conf", "kind")
    )


@by_target()
def correlation_paths(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A skill that reads a secret and executes an action; the read is associated, not walked."""
    return _correlation(ranked_edges(edges.where("type IN ('READS', 'EXECUTES')"), keys), keys)


def _correlation(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    place = [*keys, "component"]
    secrets = read_origins(edges).where(kind_of(F.col("target")) == "SECRET").select(
        *place, F.col("source").alias("skill"), F.col("target").alias("secret"), F.col("sev").alias("s1"), F.col("conf").alias("c1")
    )
    runs = _of_type(edges, "EXECUTES").select(
        *place, F.col("source").alias("skill"), F.col("target").alias("action"), F.col("sev").alias("s2"), F.col("conf").alias("c2")
    )

    def edge(target: str, kind: str) -> Column:
        return F.array(F.struct(F.col("skill").alias("source"), F.col(target).alias("target"), F.lit(kind).alias("type")))

    return secrets.join(runs, [*place, "skill"]).select(
        *place, F.array("skill", "action").alias("nodes"), edge("action", "EXECUTES").alias("edges"),
        edge("secret", "READS").alias("associated_edges"),
        F.greatest("s1", "s2", F.lit(MEDIUM)).alias("sev"), F.greatest("c1", "c2", F.lit(MEDIUM_CONF)).alias("conf"),
        F.lit("execution").alias("kind"),
    )


@by_target()
def handoff_heads(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Skills that hand off but are never handed to."""
    hand = _of_type(edges, "HANDOFF")
    given = hand.select(*keys, F.col("target").alias("source")).distinct()
    return hand.select(*keys, "source").distinct().join(given, [*keys, "source"], "left_anti")


@by_target()
def handoff_paths(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Maximal simple HANDOFF walks over the merged graph of a target, from every head.

    One left join per level tells walks that go on from walks that end; the
    cycle guard is part of the join condition, so a walk whose every successor
    was visited ends too.
    """
    return _handoffs(ranked_edges(_of_type(edges, "HANDOFF"), keys), keys)


def _handoffs(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    hand = cut(
        _of_type(edges, "HANDOFF").groupBy(*keys, "source", "target").agg(F.max("sev").alias("s"), F.max("conf").alias("c"))
    )
    level = handoff_heads(hand.withColumn("type", F.lit("HANDOFF")), keys).select(
        *keys, F.col("source").alias("last"), F.array("source").alias("nodes"),
        F.lit(MEDIUM).alias("sev"), F.lit(MEDIUM_CONF).alias("conf"),
    )
    kept = [F.col(f"w.{k}").alias(k) for k in keys]
    ended = None
    while True:
        goes_on = (F.col("w.last") == F.col("h.source")) & ~F.array_contains(F.col("w.nodes"), F.col("h.target"))
        for k in keys:
            goes_on = goes_on & F.col(f"w.{k}").eqNullSafe(F.col(f"h.{k}"))
        tried = cut(level.alias("w").join(hand.alias("h"), goes_on, "left").select(*kept, "w.nodes", "w.sev", "w.conf", "h.target", "h.s", "h.c"))
        leaves = tried.where("target IS NULL").select(*keys, "nodes", "sev", "conf")
        ended = leaves if ended is None else ended.unionByName(leaves)
        level = tried.where("target IS NOT NULL").select(
            *keys, F.col("target").alias("last"), F.array_append("nodes", F.col("target")).alias("nodes"),
            F.greatest("sev", "s").alias("sev"), F.greatest("conf", "c").alias("conf"),
        )
        if level.isEmpty():
            break
    walked = F.transform(
        F.sequence(F.lit(0), F.size("nodes") - 2),
        lambda i: F.struct(F.get("nodes", i).alias("source"), F.get("nodes", i + 1).alias("target"), F.lit("HANDOFF").alias("type")),
    )
    return ended.where(F.size("nodes") > 1).select(
        *keys, label_of(F.get("nodes", F.lit(0))).alias("component"), "nodes", walked.alias("edges"), _no_edges().alias("associated_edges"),
        "sev", "conf", F.lit("handoff").alias("kind"),
    )


# ------------------------------------------------------------------- identity


def _escape(token: Column) -> Column:
    plain = F.replace(token, F.lit("\\"), F.lit("\\\\"))
    plain = F.replace(plain, F.lit(vocab.FIELD_SEP), F.lit("\\x1f"))
    return F.replace(plain, F.lit(vocab.RECORD_SEP), F.lit("\\x1e"))


def _edge_text(edges: Column) -> Column:
    return F.array_join(
        F.transform(edges, lambda e: F.concat_ws(vocab.FIELD_SEP, _escape(e["source"]), _escape(e["target"]), _escape(e["type"]))),
        vocab.FIELD_SEP,
    )


def path_id(nodes: Column, edges: Column, associated: Column) -> Column:
    """sha256 over the walk and the sorted associated edges."""
    sep = vocab.FIELD_SEP
    return F.sha2(
        F.concat(
            F.lit("N" + sep), F.array_join(F.transform(nodes, _escape), sep), F.lit(vocab.RECORD_SEP + "E" + sep),
            _edge_text(edges), F.lit(vocab.RECORD_SEP + "A" + sep), _edge_text(F.array_sort(associated)),
        ),
        256,
    )


def is_contiguous(nodes: Column, edges: Column) -> Column:
    """The edges form a walk over the nodes, in order."""
    steps = F.sequence(F.lit(0), F.greatest(F.size(edges) - 1, F.lit(0)))
    fits = F.forall(
        steps,
        lambda i: (F.get(edges, i)["source"] == F.get(nodes, i)) & (F.get(edges, i)["target"] == F.get(nodes, i + 1)),
    )
    return (F.size(nodes) == F.size(edges) + 1) & F.when(F.size(edges) > 0, fits).otherwise(True)


# ------------------------------------------------------- classification, risk


def asset_index(nodes: Column) -> Column:
    """0-based position of the first secret or data node, -1 when there is none."""
    return (F.array_position(F.transform(nodes, lambda n: F.coalesce(kind_of(n).isin("SECRET", "DATA"), F.lit(False))), True) - 1).cast("int")


def classify(paths: DataFrame) -> DataFrame:
    """Adds attack_type, entry, asset and sink; a type is given only when the edge sequence proves it."""
    nodes, edges, assoc = F.col("nodes"), F.col("edges"), F.col("associated_edges")
    sink = tx.last(nodes)
    at = F.col("_asset")
    between = F.slice(edges, F.greatest(at, F.lit(0)) + 1, F.greatest(F.size(edges) - 1 - at, F.lit(0)))
    proven = (
        F.col("_walk") & (kind_of(sink) == "ENDPOINT") & (at >= 1)
        & (F.get(edges, at - 1)["type"] == "READS")
        & (tx.last(edges)["type"] == "SENDS_TO")
        & F.forall(between, lambda e: e["type"] == "FLOWS_TO")
    )
    reads = F.filter(assoc, lambda e: (e["type"] == "READS") & (kind_of(e["target"]) == "SECRET"))
    shared = F.col("_walk") & (kind_of(sink) == "ACTION") & (F.size(reads) > 0)
    asset = F.get(nodes, at)
    kind = (
        F.when(F.coalesce(proven, F.lit(False)), F.when(kind_of(asset) == "SECRET", F.lit("SECRET_EXFILTRATION")).otherwise(F.lit("DATA_EXFILTRATION")))
        .when(F.coalesce(shared, F.lit(False)), F.lit("CORRELATED_SECRET_EXECUTION"))
        .otherwise(F.lit("UNKNOWN"))
    )
    known = F.col("attack_type") != "UNKNOWN"
    return (
        paths.withColumn("_walk", is_contiguous(nodes, edges) & (F.size(nodes) > 0))
        .withColumn("_asset", asset_index(nodes))
        .withColumn("attack_type", kind)
        .withColumn("entry_node", F.when(F.col("_walk"), F.get(nodes, F.lit(0))).otherwise(F.lit("")))
        .withColumn(
            "asset_node",
            F.when(F.col("attack_type") == "CORRELATED_SECRET_EXECUTION", F.get(reads, F.lit(0))["target"])
            .when(known, asset).otherwise(F.lit("")),
        )
        .withColumn("sink_node", F.when(known, sink).otherwise(F.lit("")))
        .withColumn("explanation", tx.map_lookup(F.col("attack_type"), vocab.EXPLANATIONS, ""))
        .drop("_walk", "_asset")
    )


def _risk(attack_type: Column, index: int) -> Column:
    return tx.map_lookup(attack_type, {k: v[index] for k, v in vocab.RISK.items()})


def assess(paths: DataFrame) -> DataFrame:
    """Risk fields, evidence, and declared strength cut to what the walk proves."""
    kind = F.col("attack_type")
    flows = F.exists("edges", lambda e: e["type"] == "FLOWS_TO")
    changed = F.exists(
        F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 1, F.lit(0))),
        lambda e: (e["type"] == "FLOWS_TO") & kind_of(e["target"]).isin("SECRET", "DATA"),
    )
    exfil = kind.isin("SECRET_EXFILTRATION", "DATA_EXFILTRATION")
    facts = F.array_compact(F.array(
        F.when(kind.isin("SECRET_EXFILTRATION", "CORRELATED_SECRET_EXECUTION"), F.lit("secret read")),
        F.when(kind == "DATA_EXFILTRATION", F.lit("sensitive data read")),
        F.when(exfil & changed, F.lit("data transformation")),
        F.when(exfil & flows, F.lit("sensitive data flow")),
        F.when(exfil, F.lit("external network send")),
        F.when(kind == "CORRELATED_SECRET_EXECUTION", F.lit("execution")),
    ))
    return (
        paths.withColumn("risk_severity", _risk(kind, 0))
        .withColumn("risk_confidence", _risk(kind, 1))
        .withColumn("risk_score", _risk(kind, 2).cast("int"))
        .withColumn("evidence", facts)
        .withColumn("severity", tx.severity_name(F.least(F.col("sev"), tx.severity_rank(F.col("risk_severity")))))
        .withColumn("confidence", tx.confidence_name(F.least(F.col("conf"), tx.confidence_rank(F.col("risk_confidence")))))
    )


def describe(paths: DataFrame) -> DataFrame:
    """Title, description and composition: the components a walk crosses, listed when there are several."""
    comps = F.array_distinct(F.transform(F.filter("nodes", lambda n: kind_of(n) == "SKILL"), label_of))
    several = F.size("_comps") > 1
    return (
        paths.withColumn("title", tx.map_lookup(F.col("kind"), vocab.PATH_TITLES))
        .withColumn("description", F.concat(F.get("nodes", F.lit(0)), F.lit(" gets to "), tx.last(F.col("nodes")), F.lit(" in "), (F.size("nodes") - 1).cast("string"), F.lit(" steps.")))
        .withColumn("_comps", comps)
        .withColumn("component_ids", F.when(several, F.col("_comps")).otherwise(F.array().cast("array<string>")))
        .withColumn("is_composed", several)
        .drop("_comps")
    )


def finalize(paths: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Identity, one row per target and identity, class, risk and wording.

    Rows of one identity keep the strongest ranks and the first component and kind by name.
    """
    named = paths.withColumn("path_id", path_id(F.col("nodes"), F.col("edges"), F.col("associated_edges")))
    one = named.groupBy(*keys, "path_id").agg(
        F.min("component").alias("component"), *[F.first(c).alias(c) for c in ("nodes", "edges", "associated_edges")],
        F.max("sev").alias("sev"), F.max("conf").alias("conf"), F.min("kind").alias("kind"),
    )
    return describe(assess(classify(one)))


@by_target()
def analyze(edges: DataFrame, keys: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Every path of every component plus the hand-off walks of each target's merged graph."""
    ranked = cut(ranked_edges(edges, keys))
    found = _exfiltration(ranked, limit, keys).unionByName(_correlation(ranked, keys)).unionByName(_handoffs(ranked, keys))
    return finalize(found.select(*keys, *PATH_COLUMNS), keys)


# ----------------------------------------------------------- parts of a path


def path_edges(paths: DataFrame, keys: Sequence[str] = (), *more: str) -> DataFrame:
    """One row per edge on a path: walk edges in order, then associated ones; ``more`` columns of the path stay."""
    kept = [*keys, "path_id", *more]

    def placed(edges: Column, associated: bool) -> Column:
        return F.transform(edges, lambda e, i: F.struct(
            i.alias("pos"), F.lit(associated).alias("associated"), e["source"].alias("source"), e["target"].alias("target"), e["type"].alias("type"),
        ))

    # a null array has no edges
    both = [F.coalesce(placed(e, a), placed(_no_edges(), a)) for e, a in ((F.col("edges"), False), (F.array_sort("associated_edges"), True))]
    return paths.select(*kept, F.inline_outer(F.concat(*both))).where("pos IS NOT NULL")  # ``inline`` would be evaluated twice, once in an inferred filter


def breakpoints(paths: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Edges whose removal interrupts a proven path, in walk order."""
    kind, edge_type = F.col("attack_type"), F.col("type")
    exfil = kind.isin("SECRET_EXFILTRATION", "DATA_EXFILTRATION") & ~F.col("associated") & edge_type.isin(list(vocab.BREAKPOINTS))
    shared = (kind == "CORRELATED_SECRET_EXECUTION") & (
        (~F.col("associated") & (edge_type == "EXECUTES")) | (F.col("associated") & (edge_type == "READS"))
    )
    return path_edges(paths, keys, "attack_type").where(exfil | shared).select(
        *keys, "path_id", "associated", "pos", "source", "target", "type",
        tx.map_lookup(edge_type, {k: v[0] for k, v in vocab.BREAKPOINTS.items()}).alias("impact"),
        tx.map_lookup(edge_type, {k: v[1] for k, v in vocab.BREAKPOINTS.items()}).alias("reason"),
    )


@by_target()
def edge_provenance(paths: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Components that really built each edge of a path: distinct rows.

    A local path is judged in its own component only, so the component is part
    of the join key; an edge that many components share meets none of the
    others. Only composed paths look over all components of their target.
    """
    owners = edges.where("component <> '<unknown>'").select(*keys, "source", "target", "type", F.col("component").alias("owner")).distinct()
    on_path = path_edges(paths, keys, "is_composed", "component")
    key = [*keys, "source", "target", "type"]
    shown = [*keys, "path_id", "associated", "pos", "source", "target", "type", "owner"]
    local = on_path.where("NOT is_composed").withColumnRenamed("component", "owner").join(owners, [*key, "owner"], "left_semi")
    composed = on_path.where("is_composed").join(owners, key)
    return local.select(*shown).unionByName(composed.select(*shown)).distinct()


def node_provenance(provenance: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Components per node of a path, from the edges that touch it."""
    return provenance.select(*keys, "path_id", F.explode(F.array("source", "target")).alias("node"), "owner").distinct()


@by_target()
def entry_files(paths: DataFrame, files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The file behind the entry of a path, when it is a skill that was read."""
    read = files.select(*keys, F.col("path").alias("file")).distinct()
    entry = paths.where(kind_of(F.col("entry_node")) == "SKILL").select(*keys, "path_id", label_of(F.col("entry_node")).alias("file"))
    return entry.join(read, [*keys, "file"]).select(*keys, "path_id", "file")


@by_target()
def context_on_path(paths: DataFrame, context: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Declared component context whose edge lies on the path.

    An association names an edge of one component, and only local paths hold such
    edges (hand-offs are no behaviour), so the component is part of the key: a component
    takes no part in paths of others that merely share names.
    """
    on = path_edges(paths, keys, "component").select(*keys, "path_id", "component", "source", "target", "type").distinct()
    told = context.withColumnRenamed("edge_type", "type")
    return on.join(told, [*keys, "component", "source", "target", "type"]).select(
        *keys, "path_id", "component_id", "component_type", "source", F.col("type").alias("edge_type"), "target", "assoc_source"
    )


def _edge_words(e: Column) -> Column:
    return F.concat(e["source"], F.lit(" --"), e["type"], F.lit("--> "), e["target"])


def _breakpoint_words() -> Column:
    """The breakpoints of a row as text, in walk order."""
    def words(e: Column) -> Column:
        impact = tx.map_lookup(e["type"], {k: v[0] for k, v in vocab.BREAKPOINTS.items()})
        reason = tx.map_lookup(e["type"], {k: v[1] for k, v in vocab.BREAKPOINTS.items()})
        return F.concat(_edge_words(e), F.lit(" ["), impact, F.lit("]: "), reason)

    kind = F.col("attack_type")
    walked = F.filter("edges", lambda e: e["type"].isin(list(vocab.BREAKPOINTS)))
    shared = F.concat(
        F.filter("edges", lambda e: e["type"] == "EXECUTES"),
        F.filter(F.array_sort("associated_edges"), lambda e: e["type"] == "READS"),
    )
    chosen = (
        F.when(kind.isin("SECRET_EXFILTRATION", "DATA_EXFILTRATION"), walked)
        .when(kind == "CORRELATED_SECRET_EXECUTION", shared)
        .otherwise(_no_edges())
    )
    return F.transform(chosen, words)


@by_target()
def explain(paths: DataFrame, policies: DataFrame, provenance: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Structured explanation read off the finished path.

    ``policies``: path_id, policy_ids. ``provenance``: path_id, owner, the components
    that built the edges. A local path lists its own component; a composed one names
    the components it crosses, and all owners of its edges stay rows of ``provenance``.
    """
    impact = F.concat(
        F.lit("Severity "), "risk_severity", F.lit(", confidence "), "risk_confidence",
        F.lit(", risk score "), F.col("risk_score").cast("string"), F.lit("."),
    )
    own = [*keys, "path_id"]
    crossed = paths.select(*own, F.explode(F.array_distinct(F.concat(F.array("component"), "component_ids"))).alias("owner"))
    owners = provenance.select(*own, "owner").distinct().join(crossed, [*own, "owner"], "left_semi")
    owners = owners.groupBy(*own).agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    none = F.array().cast("array<string>")
    return paths.join(policies, own, "left").join(owners, own, "left").select(
        *own,
        F.struct(
            tx.map_lookup(F.col("attack_type"), vocab.SUMMARIES).alias("summary"),
            F.nullif("entry_node", F.lit("")).alias("entry"),
            F.nullif("asset_node", F.lit("")).alias("asset"),
            F.nullif("sink_node", F.lit("")).alias("sink"),
            F.transform("edges", _edge_words).alias("steps"),
            F.transform("associated_edges", _edge_words).alias("associated_evidence"),
            impact.alias("impact"),
            F.coalesce("policy_ids", none).alias("policies"),
            _breakpoint_words().alias("breakpoints"),
            F.coalesce("owners", none).alias("components"),
        ).alias("explanation"),
    )
