"""Baselines, reports, evaluations, extensions, streams and the whole scan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.functions import text as tx
from wardlight.operators import baseline as bl
from wardlight.operators import enrich as en
from wardlight.operators import evaluation as ev
from wardlight.operators import extend as ex
from wardlight.operators import graph as gr
from wardlight.operators import line_rules as lr
from wardlight.operators import paths as pt
from wardlight.operators import policy as po
from wardlight.operators import rule_catalog as rc
from wardlight.operators import scoring as sc
from wardlight.plans import carriers
from wardlight.plans import rescan
from wardlight.plans import scan as whole
from wardlight.plans.carriers import GRAPH_SQL, LINES_SQL
from wardlight.plans.q_documents import COLLAPSE, PAYLOADS
from wardlight.plans.q_graph import FINDING_EDGES, PATHS, RESULTS, action_sql, event_graph, event_paths
from wardlight.plans.q_rules import FINDINGS_SQL, plain_findings_sql, seeded_findings
from wardlight.plans.q_scoring import LEVEL, MARKED_SQL, TREE_SQL, file_tree, marked_findings, score_sql
from wardlight.plans.q_steps import CHAINS_SQL, TRIPLE_SQL
from wardlight.plans.sqltext import m, q
from wardlight.session import constant_table, cut, shared_folder
from wardlight.sources import reports as rp
from wardlight.sources import snapshots as sn
from wardlight.sources.corpus import coverage_events, decode, documents_of, explode_lines, prune, read_table, scan_files
from wardlight.streaming import arrivals as ar

# ------------------------------------------------------------------- baseline
ROOT = "/build/work"


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the seeded corpus at absolute paths, some of them outside the root."""
    found = seeded_findings(spark, folder).select("doc_id", "path", "line", "rule_order", "rule_id", "severity", "evidence")
    n = F.col("doc_id")
    place = (
        F.when(n % 6 == 0, F.concat(F.lit("/other/place/"), "path"))
        .when(n % 6 == 1, F.concat(F.lit("/build/work/./x/../"), "path"))
        .when(n % 6 == 2, F.lit("<correlated>"))
        .otherwise(F.concat(F.lit("/build/work/"), "path"))
    )
    said = F.when(n % 4 == 0, F.concat(F.lit("Contributing: "), place, F.lit(":"), F.col("line").cast("string"), F.lit(", /usr/lib/x.md and ../../up"))).otherwise(F.col("evidence"))
    return found.withColumns({"path": place, "evidence": said})


def locations(spark: SparkSession, folder: str) -> DataFrame:
    rows = _placed(spark, folder)
    return rows.groupBy(bl.relative_location(F.col("path"), ROOT).alias("file")).agg(F.count("*").alias("n"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    return bl.sorted_records(bl.records(_placed(spark, folder), ROOT))


def rooted(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of targets with roots of their own, one of them the null target: files relative to the longest root."""
    found = seeded_findings(spark, folder).select("doc_id", "path")
    k = F.col("doc_id") % 5
    target = F.when(k < 4, F.concat(F.lit("t"), k.cast("string")))
    rows = found.select(target.alias("target"), F.concat(F.lit("/srv/"), F.coalesce(target, F.lit("null")), F.lit("/./in/"), "path").alias("path"))
    roots = constant_table(spark, ["target", "root"], [("t0", "/srv/t0"), ("t0", "/srv/t0/in/"), ("t0", "/"), ("t1", "/srv/t1/"), ("t2", "/srv/t2/in"), ("t2", "/srv/t2/i"), ("t3", "/srv/t"), (None, "/srv/null")])
    placed = bl.rooted(rows, roots, ["target"])
    return placed.groupBy("target", bl.relative_location(F.col("path"), F.col("root")).alias("file")).agg(F.count("*").alias("n"))


def ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = bl.with_ids(bl.records(_placed(spark, folder), ROOT))
    return rows.groupBy("finding_id", "rule_id").agg(F.count("*").alias("n"))


def ambiguous(spark: SparkSession, folder: str) -> DataFrame:
    return bl.ambiguous_ids(bl.with_ids(bl.records(_placed(spark, folder), ROOT)), "finding_id")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """First twenty record ids in order and how many more there are."""
    rows = bl.with_ids(bl.records(_placed(spark, folder), ROOT)).select("finding_id").distinct()
    return sc.record_index(rows, "finding_id")


def known_files(spark: SparkSession, folder: str) -> DataFrame:
    """Relative file names inside evidence, rewritten by a join with the file table."""
    rows = seeded_findings(spark, folder).select(
        F.concat_ws(":", "doc_id", "line", "rule").alias("id"), "path",
        F.concat(F.lit("see "), "path", F.lit(":"), F.col("line").cast("string"), F.lit(" or other/file.md (")).alias("evidence"),
    )
    files = carriers.seeded_documents(spark, folder).select("path")
    return bl.rewrite_known_files(rows, files, "/build/work/corpus", "/build/work", "id").select("id", "evidence")


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """lineitem read twice as fingerprints with many repeats: severity by quantity now, by discount then."""
    n = F.col("l_orderkey")
    rows = read_table(spark, folder, "lineitem").select(
        n.alias("o"), "l_linenumber",
        F.concat(F.lit("R-"), "l_returnflag").alias("rule_id"), F.concat(F.lit("f"), (n % 50).cast("string")).alias("file"),
        F.when(F.col("l_linenumber") > 5, F.lit(None).cast("int")).otherwise(F.col("l_linenumber")).alias("line"),
        F.col("l_linestatus").alias("evidence"), "l_quantity", "l_discount",
    )

    def graded(high) -> DataFrame:
        return rows.withColumn("severity", F.when(high, F.lit("HIGH")).otherwise(F.lit("LOW"))).drop("l_quantity", "l_discount")

    return graded(F.col("l_quantity") > 25), graded(F.col("l_discount") > 0.05)


CHUNK = 4096


def diff(spark: SparkSession, folder: str) -> DataFrame:
    return bl.matched_counts(*_sides(spark, folder))


def diff_counts(spark: SparkSession, folder: str) -> DataFrame:
    return bl.diff_counts(*_sides(spark, folder))


def annotated(spark: SparkSession, folder: str) -> DataFrame:
    now, then = _sides(spark, folder)
    rows = bl.annotate(now, then, ["o", "l_linenumber"], F.floor(F.col("o") / CHUNK), excluded=F.col("file") == "f7")
    return rows.select("o", "l_linenumber", "baseline_state")


def fixed(spark: SparkSession, folder: str) -> DataFrame:
    return bl.fixed_rows(*_sides(spark, folder))


def diff_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Per file the sides of the difference, each counted on its own: states of rows and fixed rows."""
    now, then = _sides(spark, folder)
    states = bl.annotate(now, then, ["o", "l_linenumber"], F.floor(F.col("o") / CHUNK)).groupBy("file").agg(
        F.count("*").alias("rows_now"), F.count_if(F.col("baseline_state") == "matched").alias("matched"), F.count_if(F.col("baseline_state") == "new").alias("new")
    )
    gone = bl.fixed_rows(now, then).groupBy("file").agg(F.count("*").alias("fixed"))
    return states.join(gone, "file", "left").withColumn("fixed", F.coalesce("fixed", F.lit(0)))


def round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Records written as a table of any size and read back; per rule how many came back equal."""
    rows = cut(bl.records(_placed(spark, folder), ROOT).select(*bl.KEY))
    place = f"{shared_folder(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    sn.write_records(rows, place)
    return bl.matched_counts(rows, sn.read_records(spark, place)).groupBy("rule_id").agg(
        F.sum("n_current").alias("written"), F.sum("n_baseline").alias("back"), F.sum("matched").alias("equal")
    )


def resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of records and of nothing, resolved."""
    rows = cut(bl.with_ids(bl.records(_placed(spark, folder), ROOT)).select("finding_id", "rule_id", "file"))
    wanted = rows.select("finding_id").unionByName(rows.where("rule_id = 'AS-002'").select(F.concat("finding_id", F.lit("x")).alias("finding_id")))
    return bl.resolve(rows, "finding_id", wanted)


def matched_severity(spark: SparkSession, folder: str) -> DataFrame:
    now, then = _sides(spark, folder)
    rows = bl.annotate(now, then, ["o", "l_linenumber"], F.floor(F.col("o") / CHUNK))
    return sc.matched_by_severity(rows, ["file"])


def gate_new(spark: SparkSession, folder: str) -> DataFrame:
    now, then = _sides(spark, folder)
    rows = bl.annotate(now, then, ["o", "l_linenumber"], F.floor(F.col("o") / CHUNK)).withColumn("target", F.col("o") % 1000)
    return sc.gate(rows, ["target"], "HIGH", only_new=True)


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot documents made of customers, good and bad, parsed and checked."""
    n = F.col("c_custkey")
    item = F.concat(F.lit('{"rule_id": "R'), (n % 5).cast("string"), F.lit('", "file": "a.md", "line": '),
                    F.when(n % 7 == 0, F.lit("null")).when(n % 7 == 1, F.lit("true")).when(n % 7 == 2, F.lit("1.5")).otherwise(n.cast("string")),
                    F.lit(', "evidence": '), F.when(n % 11 == 0, F.lit("3")).otherwise(F.lit('"e"')), F.lit(', "severity": "LOW"}'))
    text = (
        F.when(n % 13 == 0, F.lit("not json")).when(n % 13 == 1, F.lit("[1]"))
        .when(n % 13 == 2, F.lit('{"version": 2, "findings": []}')).when(n % 13 == 3, F.lit('{"version": 1}'))
        .otherwise(F.concat(F.lit('{"version": 1, "findings": ['), item, F.lit(", "), item, F.lit("]}")))
    )
    docs = read_table(spark, folder, "customer").select(n.cast("string").alias("path"), text.alias("text"))
    good, problems = sn.parse_snapshot(docs)
    return good.groupBy("path").agg(F.count("*").alias("n"), F.sum("line").alias("lines")).select(
        "path", F.lit("ok").alias("verdict"), "n", "lines"
    ).unionByName(problems.groupBy("path", F.col("problem").alias("verdict")).agg(F.count("*").alias("n")).withColumn("lines", F.lit(None).cast("bigint")).select("path", "verdict", "n", "lines"))


# -------------------------------------------------------------------- reports
def _reported(spark: SparkSession, folder: str) -> DataFrame:
    return en.enrich(marked_findings(spark, folder)).withColumn("file", F.col("path")).withColumn(
        "baseline_state", F.when(F.col("doc_id") % 3 == 0, F.lit("new")).when(F.col("doc_id") % 3 == 1, F.lit("matched"))
    )


def findings_json(spark: SparkSession, folder: str) -> DataFrame:
    rows = rp.finding_json(_reported(spark, folder))
    j = F.col("json")
    return rows.select(
        "doc_id", "line", "rule", F.get_json_object(j, "$.severity").alias("severity"), F.get_json_object(j, "$.matched_text").alias("matched_text"),
        F.get_json_object(j, "$.cwe[0]").alias("cwe"), F.get_json_object(j, "$.baseline_state").alias("state"), j.contains('"mitre"').alias("has_mitre"),
    )


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One result document per source, as ordered rows; what its opening says and what it lists."""
    found = cut(_reported(spark, folder).drop("text", "rule"))
    keys = ["source"]
    coverage = read_table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("files_scanned")).withColumn("coverage_status", F.lit("full"))
    rows = cut(rp.scan_json(found, sc.scores(found, keys), sc.severity_summary(found, keys), coverage, keys, ["doc_id", "line", "rule_order"], F.floor(F.col("doc_id") / 64)))
    j = F.concat("json", F.lit("]}"))
    heads = rows.where("section = 0").select(
        "source", F.get_json_object(j, "$.score").alias("score"), F.get_json_object(j, "$.risk_level").alias("risk_level"),
        F.get_json_object(j, "$.summary.high").alias("high"), F.get_json_object(j, "$.coverage.files_scanned").alias("files"),
    )
    rule = F.get_json_object(F.regexp_replace("json", "^,", ""), "$.rule_id")
    listed = rows.where("section = 1").groupBy("source").agg(F.min_by(rule, "pos").alias("first_rule"), F.count("*").cast("int").alias("listed"))
    return heads.join(listed, "source")


def sarif_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One SARIF document per source, as ordered rows; lines per section."""
    found = cut(_reported(spark, folder))
    results = rp.result_json(rp.sarif_results(found)).select("source", "doc_id", "line", "rule_order", "json")
    run = rp.sarif_run(results, rp.sarif_rules(found, ["source"], ["doc_id", "line", "rule_order"]), rp.sarif_artifacts(found, ["source"]), ["source"],
                       ["doc_id", "line", "rule_order"], F.floor(F.col("doc_id") / 64))
    return run.groupBy("source", "section").agg(F.count("*").alias("n"))


def _superseding(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    paths = cut(event_paths(spark, folder))
    files = event_graph(spark, folder).select(F.col("component").alias("path")).distinct()
    return paths, pt.entry_files(paths, files), rp.superseding_paths(paths, pt.entry_files(paths, files))


def superseded(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of components, some of them chains, next to the proven paths of the component."""
    _, _, best = _superseding(spark, folder)
    chains = (
        carriers.action_stream(spark, folder).select(
            F.col("component").alias("file"), "line", F.when(F.col("idx") % 2 == 0, F.lit("AS-CHAIN-004")).otherwise(F.lit("AS-003")).alias("rule_id"),
            F.lit("HIGH").alias("severity"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("matched_text"),
            F.lit(False).alias("suppressed"), F.lit(None).cast("string").alias("suppression_reason"), F.lit(None).cast("string").alias("baseline_state"),
        )
    )
    rows = rp.sarif_results(chains, best)
    return rows.select("file", "line", "rule_id", "level", "superseded_by_path", F.get("suppressions", F.lit(0))["kind"].alias("kind"))


def sarif_results(spark: SparkSession, folder: str) -> DataFrame:
    rows = rp.result_json(rp.sarif_results(_reported(spark, folder)))
    return rows.select(
        "doc_id", "line", "rule", "level", "message", "baselineState",
        F.get_json_object("json", "$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"),
        F.get_json_object("json", "$.suppressions[0].justification").alias("justification"),
    )


def sarif_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = rp.sarif_rules(_reported(spark, folder), ["source"], ["doc_id", "line", "rule_order"])
    return rows.select("source", "rule_id", "title", F.get_json_object("json", "$.properties.confidence").alias("confidence"))


def sarif_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    return rp.sarif_artifacts(_reported(spark, folder), ["source"]).select("source", "uri")


def sarif_paths(spark: SparkSession, folder: str) -> DataFrame:
    paths, entries, _ = _superseding(spark, folder)
    ids_ = po.violated_ids(po.evaluate(paths.select("path_id", "attack_type")))
    rows = rp.path_results(paths, entries, ids_)
    j = F.col("json")
    return rows.select("path_id", F.col("ruleId").alias("rule"), F.get_json_object(j, "$.level").alias("level"),
                       F.get_json_object(j, "$.properties.policy_ids[0]").alias("policy"), F.get_json_object(j, "$.properties.location_provenance").alias("place"))


def serialized_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths as stable JSON; fields read back from the text."""
    rows = event_paths(spark, folder).select(
        "path_id", F.to_json(F.struct("path_id", "nodes", "edges", "associated_edges", "severity", "confidence", "attack_type", "risk_score", "evidence")).alias("json")
    )
    j = F.col("json")
    return rows.select(
        F.get_json_object(j, "$.path_id").alias("path_id"), F.get_json_object(j, "$.edges[0].type").alias("first_type"), F.get_json_object(j, "$.attack_type").alias("attack_type"),
        F.json_array_length(F.get_json_object(j, "$.nodes")).alias("n_nodes"), F.get_json_object(j, "$.risk_score").alias("risk_score"),
    )


def serialized_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes, edges and policy results of the event graph as JSON texts."""
    edges = cut(event_graph(spark, folder))
    paths = event_paths(spark, folder).select("path_id", "attack_type")
    keep = {"ignoreNullFields": "false"}
    merged = edges.groupBy("component", "source", "target", "type").agg(F.max("severity").alias("severity"))
    parts = [
        gr.nodes_of(edges).select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "type", "label")).alias("json")),
        merged.select(F.lit("edge").alias("kind"), F.to_json(F.struct("component", "source", "target", "type", "severity"), keep).alias("json")),
        po.evaluate(paths).select(F.lit("policy").alias("kind"), F.to_json(F.struct("policy_id", "path_id", "violated", "reason")).alias("json")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ----------------------------------------------------------------- evaluation
def _cases(spark: SparkSession, folder: str) -> DataFrame:
    """part as vendor cases, written as JSON and adapted back."""
    key = F.col("p_partkey")
    raw = read_table(spark, folder, "part").select(
        "p_brand",
        F.to_json(F.struct(
            F.when(key % 17 == 0, F.lit("  ")).otherwise(key.cast("string")).alias("case_id"), F.col("p_name").alias("name"),
            F.when(key % 19 != 0, F.col("p_type")).alias("description"),
            F.array(F.concat(F.lit("ASI0"), (key % 12).cast("string")), F.lit(" ASI01 "), F.lit("")).alias("threat_ids"),
            F.array(F.lit(" R"), F.lit("A"), F.lit("N "), F.lit("A")).alias("expected_security_properties"),
        )).alias("json"),
    )
    good, _ = ev.adapt_cases(raw.select("json"), "parts")
    return good


def adapted(spark: SparkSession, folder: str) -> DataFrame:
    return _cases(spark, folder).select("benchmark_id", "case_id", "name", "description", F.array_join("threat_ids", ",").alias("threats"),
                                        F.array_join("expected_security_properties", ",").alias("expected"))


def _benchmarks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Brands as benchmarks, parts as cases, line items as observations."""
    part = read_table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("benchmark_id"))
    cases = part.select("benchmark_id", F.col("k").cast("string").alias("case_id"), F.when(F.col("k") % 3 == 0, F.array(F.lit("R"), F.lit("A"))).otherwise(F.array(F.lit("N"))).alias("expected_security_properties"))
    items = read_table(spark, folder, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag", "l_linestatus", "l_quantity")
    seen = items.groupBy("k").agg(
        # three flags at most
        F.collect_set(F.when(F.col("l_quantity") < 4, F.col("l_returnflag"))).alias("observed_properties"), F.when(F.max("l_quantity") > 49, F.lit("error")).when(F.min("l_quantity") < 2, F.lit("timeout")).otherwise(F.lit("completed")).alias("status"),
    )
    # a few observations name a benchmark that does not know the case
    observations = seen.join(part, "k").select(
        F.when(F.col("k") % 101 == 0, F.lit("Brand#none")).otherwise(F.col("benchmark_id")).alias("benchmark_id"), F.col("k").cast("string").alias("case_id"), "observed_properties", "status",
    )
    return cases, observations


def evaluated(spark: SparkSession, folder: str) -> DataFrame:
    rows = ev.evaluate(*_benchmarks(spark, folder))
    return rows.select(*ev.CASE, F.array_join("violated_properties", ",").alias("violated"), "passed", "status", "message")


def executions(spark: SparkSession, folder: str) -> DataFrame:
    return ev.evaluate_executions(*_benchmarks(spark, folder)).select(*ev.CASE, "passed", "status")


def unbound(spark: SparkSession, folder: str) -> DataFrame:
    return ev.unbound(*_benchmarks(spark, folder))


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    return ev.summarize(ev.evaluate(*_benchmarks(spark, folder)))


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    return ev.status_counts(ev.evaluate(*_benchmarks(spark, folder)))


def bad_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries, some of which were changed: a passed case too many, or a total that the statuses do not reach."""
    results = ev.evaluate(*_benchmarks(spark, folder))
    told = ev.summarize(results)
    changed = told.withColumn("passed_cases", F.col("passed_cases") + F.when(F.col("benchmark_id").endswith("3"), 1).otherwise(0))
    both = F.when(F.col("benchmark_id").endswith("4"), 1).otherwise(0)
    changed = changed.withColumn("total_cases", F.col("total_cases") + both).withColumn("failed_cases", F.col("failed_cases") + both)
    return ev.summary_violations(changed, ev.status_counts(results))


def cross(spark: SparkSession, folder: str) -> DataFrame:
    return ev.cross_benchmark(summaries(spark, folder))


def duplicate_benchmarks(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of all benchmarks plus those of three brands once more."""
    rows = summaries(spark, folder)
    return ev.duplicate_benchmarks(rows.unionByName(rows.where("benchmark_id LIKE '%1'")))


def threats(spark: SparkSession, folder: str) -> DataFrame:
    rows = ev.map_threats(_cases(spark, folder).select(F.col("case_id").alias("scenario_id"), "threat_ids"), ev.taxonomy(spark))
    return rows.groupBy("threat_id", "taxonomy_id", "entry_name").agg(F.count("*").alias("n"))


def duplicate_entries(spark: SparkSession, folder: str) -> DataFrame:
    part = read_table(spark, folder, "part").select(F.col("p_brand").alias("taxonomy_id"), F.col("p_type").alias("entry_id"))
    return ev.duplicate_entries(part)


def properties(spark: SparkSession, folder: str) -> DataFrame:
    """String-set normalisation over part words."""
    part = read_table(spark, folder, "part")
    words = F.concat(F.split("p_name", " "), F.split("p_type", " "), F.array(F.lit(" "), F.lit(" zeta "), F.lit("zeta")))
    return part.select("p_partkey", F.array_join(tx.clean_set(words), ",").alias("words"), F.array_join(ev.violated(words, F.split("p_name", " ")), ",").alias("missing"))


def _lab(spark: SparkSession, folder: str) -> DataFrame:
    """Every seeded document is a labelled case."""
    docs = carriers.seeded_documents(spark, folder)
    kind = F.col("doc_id") % 4
    cases = docs.select(
        "doc_id", F.col("source").alias("category"),
        F.when(kind == 0, F.array(F.lit("AS-003"), F.lit("AS-005"))).when(kind == 1, F.array(F.lit("AS-002"))).otherwise(F.array().cast("array<string>")).alias("expected_rules"),
        (kind == 3).alias("is_benign"),
    )
    return ev.classify_cases(cases, seeded_findings(spark, folder).select("doc_id", "rule_id", "severity"), ["doc_id"])


def lab_cases(spark: SparkSession, folder: str) -> DataFrame:
    return _lab(spark, folder).select("doc_id", "result")


def lab_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ev.lab_summary(_lab(spark, folder))


def lab_categories(spark: SparkSession, folder: str) -> DataFrame:
    return ev.lab_by_category(_lab(spark, folder))


def precision(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as verdicts: quality says whether a claim about a document held."""
    docs = read_table(spark, folder, "documents").select("doc_id", "source")
    verdict = F.when(F.col("toxic") == 1, F.lit("INCONCLUSIVE")).when(F.col("quality") == 1, F.lit("TP")).otherwise(F.lit("FP"))
    return ev.precision(read_table(spark, folder, "labels").join(docs, "doc_id").withColumn("verdict", verdict), ["source"])


# ----------------------------------------------------------------- extensions
def own_rule(spark: SparkSession, folder: str) -> DataFrame:
    """A registered rule next to the built-in ones."""
    book = ex.RuleBook()
    book.register_line_rule(
        lr.LineRule("todo_marker", lambda t, low: low.contains("nothing"), keep=lambda t: t.rlike("(?i)nothing (?:to|else)")),
        ("X-001", "INFO", "Marker", "marker word", "A marker occurs.", "None."),
    )
    found = book.line_findings(carriers.seeded_lines(spark, folder).select("doc_id", "line", "text"))
    return found.groupBy("rule", "rule_id", "severity").agg(F.count("*").alias("n"))


PATTERNS = [("P1", "ignore", r"\bignore\b.*\binstructions\b"), ("P2", "curl", r"\bcurl\b"), ("P3", "token", r"\btoken\w*"), ("P4", "read", r"^read\b"), ("P5", "the", r"\bthe\b.*\bthe\b")]


def pattern_table(spark: SparkSession, folder: str) -> DataFrame:
    lines = carriers.seeded_lines(spark, folder).select("doc_id", "line", "text")
    return ex.match_pattern_table(lines, constant_table(spark, ["pattern_id", "stem", "pattern"], PATTERNS)).select("doc_id", "line", "pattern_id")


def pattern_table_many(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines against as many patterns as parts have names; texts hold every third word in part."""
    word = F.lower(F.regexp_extract("p_name", r"(\w+)$", 1))
    named = read_table(spark, folder, "part").select(word.alias("w")).distinct().where("w <> ''")
    table = named.select(F.concat(F.lit("W-"), "w").alias("pattern_id"), F.left("w", F.lit(4)).alias("stem"), F.left("w", F.lit(4)).alias("pattern"))
    lines = carriers.seeded_lines(spark, folder).select("doc_id", "line", "text")
    return ex.match_pattern_table(lines, table.unionByName(constant_table(spark, ["pattern_id", "stem", "pattern"], PATTERNS))).select("doc_id", "line", "pattern_id")


def own_file_rule(spark: SparkSession, folder: str) -> DataFrame:
    """A registered document rule: files that both start a process and evaluate text."""
    book = ex.RuleBook()

    @book.register_document_rule
    def both(docs: DataFrame) -> DataFrame:
        hit = F.col("text").contains("subprocess") & F.col("text").contains("eval(")
        return docs.where(hit).select("doc_id", F.lit("X-F-001").alias("rule_id"), F.lit("HIGH").alias("severity"))

    found = book.document_findings(carriers.seeded_documents(spark, folder).select("doc_id", "text"))
    return found[0]


def _fussy(text: str) -> str | None:
    """A rule that fails on some texts."""
    if "password" in text:
        raise ValueError(text)
    return "short" if 0 < len(text) < 12 else None


def python_rule(spark: SparkSession, folder: str) -> DataFrame:
    lines = carriers.seeded_lines(spark, folder).select("doc_id", "line", "text")
    return ex.apply_python_rule(lines, "fussy", _fussy).select("doc_id", "line", F.coalesce("reason", "evidence").alias("outcome"))


# -------------------------------------------------------------------- streams
def _stream(spark: SparkSession, folder: str) -> DataFrame:
    docs = ar.read_table(spark, f"{folder.rstrip('/')}/documents.parquet", read_table(spark, folder, "documents").schema)
    snippets = constant_table(spark, ["k", "body"], [(i, b) for i, (_, b) in enumerate(carriers.SNIPPETS)])
    seeded = docs.join(F.broadcast(snippets), F.col("doc_id") % carriers.PERIOD == F.col("k"))
    return ar.stream_findings(seeded.select("doc_id", F.concat("text", F.lit("\n"), "body").alias("text")))


def stream_scan(spark: SparkSession, folder: str) -> DataFrame:
    out, checkpoint = ar.fresh_folders(spark)
    ar.write_findings(_stream(spark, folder).select("doc_id", "line", "rule", "severity"), out, checkpoint, available_now=True).awaitTermination()
    return spark.read.parquet(out)


def stream_new(spark: SparkSession, folder: str) -> DataFrame:
    """Only findings a baseline lacks: it was taken before the command rules existed."""
    out, checkpoint = ar.fresh_folders(spark)
    found = _stream(spark, folder).select("doc_id", "rule_id", F.col("doc_id").cast("string").alias("file"), "line", "rule_order", "evidence", "severity")
    known = seeded_findings(spark, folder).where("rule_id <> 'AS-002'").select("rule_id", F.col("doc_id").cast("string").alias("file"), "line", "evidence", "severity")
    ar.write_new_findings(found, cut(known), out, checkpoint, available_now=True).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "line", "rule_id", "evidence")


def stream_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose findings come in several batches, against a baseline of every third document."""
    out, checkpoint = ar.fresh_folders(spark)
    parts = f"{out}-parts"
    found = seeded_findings(spark, folder).select("doc_id", "rule_id", (F.col("doc_id") % 7).cast("string").alias("file"), "line", "rule_order", "evidence", "severity")
    cut(found).repartitionByRange(4, "doc_id").write.parquet(parts)
    docs = ar.read_documents(spark, parts, spark.read.parquet(parts).schema, files_per_batch=1)
    known = spark.read.parquet(parts).where("doc_id % 3 = 0").select(*bl.KEY)
    ar.write_new_findings(docs, known, out, checkpoint, available_now=True, fold_every=3).awaitTermination()
    return spark.read.parquet(out).groupBy("file", "rule_id").agg(F.count("*").alias("new_rows"))


# ------------------------------------------------------------------ all of it
def corpus_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as files, a folder per source, and read back as bytes: lines and findings per source."""
    root = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, folder, "documents").select("source", "text").where("text IS NOT NULL")
    docs.write.partitionBy("source").option("maxRecordsPerFile", 500).text(root)
    read = documents_of(decode(scan_files(spark, root))).withColumn("source", F.regexp_extract("path", "/source=([^/]*)/", 1))
    lines = cut(explode_lines(read.select("source", "text")).where("text <> ''"))
    found = lr.line_findings(lines).groupBy("source").agg(F.count("*").alias("findings"))
    sizes = lines.groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))
    return sizes.join(found, "source", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))


def files_to_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files in a tree: bytes are pruned, decoded, ruled and accounted for."""
    left, pruned = prune(file_tree(spark, folder))
    read = cut(decode(left, vocab.MAX_FILE_SIZE).select("path", "text", "skip_reason", "lossy"))
    found = lr.line_findings(explode_lines(documents_of(read).select("path", "text")))
    events = coverage_events(read, pruned)
    return found.groupBy(F.lit("finding").alias("kind"), F.col("rule").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("files")).unionByName(
        events.groupBy("kind", F.coalesce("reason", F.lit("read")).alias("name")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))
    )


TARGET = ["source"]


def _docs_by_target(spark: SparkSession, folder: str) -> DataFrame:
    return cut(carriers.target_documents(spark, folder))


def scan_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Targets that hold equal paths, scanned together; the twin scans files of unique paths."""
    found = whole.find(_docs_by_target(spark, folder), TARGET)
    return found.findings.groupBy("source", "rule_id", "severity").agg(F.count("*").alias("n"))


def rescan_findings(spark: SparkSession, folder: str) -> DataFrame:
    """A scan brought up to date: a tenth of the files came, a tenth changed, and some are gone since the first one."""
    docs = _docs_by_target(spark, folder).withColumn("n", F.pmod(F.xxhash64("path"), F.lit(10)))
    older = docs.where("n > 0").withColumn("text", F.when(F.col("n") == 1, F.concat(F.lit("eval(x)\nRead the password.\n"), "text")).otherwise(F.col("text")))
    gone = docs.where("n = 2").withColumn("path", F.concat(F.lit("old/"), "path"))
    results = rescan.Results(spark, f"{shared_folder(spark).rstrip('/')}/rescan-{uuid.uuid4().hex}", TARGET)
    results.refresh(older.unionByName(gone).drop("n"))
    found = results.refresh(docs.drop("n"))
    return found.findings.groupBy("source", "rule_id", "severity").agg(F.count("*").alias("n"))


def scan_paths(spark: SparkSession, folder: str) -> DataFrame:
    found = whole.find(_docs_by_target(spark, folder), TARGET)
    paths = pt.analyze(whole.graph(found, TARGET), whole.inner(TARGET))
    return paths.groupBy(F.col("scan_source").alias("source"), "attack_type", "risk_score").agg(F.count("*").alias("n"))


def scan_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The whole scan: one row per target. URL findings are ignored, command findings are in the baseline."""
    docs = _docs_by_target(spark, folder)
    commands = lr.pick_rules([row[0] for row in rc.LINE_RULES if row[1] == "AS-002"])
    known = lr.line_findings(explode_lines(docs), commands).select("source", "rule_id", F.col("path").alias("file"), "line", "evidence", "severity")
    return whole.run(docs, TARGET, baseline=known, ignore={"rules": ["AS-005"]}, walks=False).targets


QUERIES = {
    "relative_location": locations,
    "baseline_records": records,
    "baseline_roots": rooted,
    "rewrite_known_files": known_files,
    "finding_ids": ids,
    "ambiguous_ids": ambiguous,
    "record_index": index,
    "baseline_diff": diff,
    "baseline_counts": diff_counts,
    "baseline_annotate": annotated,
    "baseline_fixed": fixed,
    "baseline_balance": diff_balance,
    "matched_by_severity": matched_severity,
    "gate_only_new": gate_new,
    "read_snapshots": snapshots,
    "findings_json": findings_json,
    "scan_json": scan_documents,
    "sarif_results": sarif_results,
    "sarif_rules": sarif_rules,
    "sarif_artifacts": sarif_artifacts,
    "sarif_paths": sarif_paths,
    "superseded_chains": superseded,
    "serialize_paths": serialized_paths,
    "serialize_graph": serialized_graph,
    "sarif_run": sarif_documents,
    "baseline_round_trip": round_trip,
    "resolve_ids": resolved,
    "adapt_cases": adapted,
    "evaluate_cases": evaluated,
    "evaluate_executions": executions,
    "unbound_executions": unbound,
    "benchmark_summary": summaries,
    "benchmark_statuses": statuses,
    "benchmark_sum_check": bad_summaries,
    "cross_benchmark": cross,
    "duplicate_benchmarks": duplicate_benchmarks,
    "threat_mapping": threats,
    "duplicate_entries": duplicate_entries,
    "normalize_sets": properties,
    "lab_cases": lab_cases,
    "lab_summary": lab_summary,
    "lab_by_category": lab_categories,
    "precision_wilson": precision,
    "register_rule": own_rule,
    "register_file_rule": own_file_rule,
    "pattern_table": pattern_table,
    "pattern_table_many": pattern_table_many,
    "python_rule_errors": python_rule,
    "stream_scan": stream_scan,
    "stream_new_findings": stream_new,
    "stream_files_in_parts": stream_parts,
    "corpus_scan": corpus_scan,
    "files_to_findings": files_to_findings,
    "whole_scan_findings": scan_findings,
    "rescan_findings": rescan_findings,
    "whole_scan_paths": scan_paths,
    "whole_scan_targets": scan_targets,
}

# ------------------------------------------------------------------ SQL twins
PLACED = f"""{FINDINGS_SQL}, abs_ AS (SELECT *, CASE doc_id % 6 WHEN 0 THEN '/other/place/' || path WHEN 1 THEN '/build/work/./x/../' || path WHEN 2 THEN '<correlated>' ELSE '/build/work/' || path END AS p,
    CASE doc_id % 6 WHEN 0 THEN '<outside>/' || regexp_extract(path, '([^/]*)$', 1) WHEN 2 THEN '<correlated>' ELSE path END AS file FROM line_findings),
recs AS (SELECT rule_id, file, line, CASE WHEN doc_id % 4 <> 0 THEN regexp_replace(evidence, '(^|[^\\w:/.~+-])/sh\\b', '\\1/sh') ELSE 'Contributing: ' || replace(file, '<outside>/', '<outside><path>/') || ':' || line || ', <outside><path>/x.md and up' END AS evidence, severity, doc_id FROM abs_)"""
ID = "'fnd-' || left(sha256(rule_id || chr(31) || file || chr(31) || coalesce(CAST(line AS VARCHAR), '') || chr(31) || evidence || chr(31) || severity), 12)"
SIDES = """items AS (SELECT l_orderkey AS o, l_linenumber, 'R-' || l_returnflag AS rule_id, 'f' || (l_orderkey % 50) AS file, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_linenumber END AS line,
    l_linestatus AS evidence, l_quantity, l_discount FROM lineitem),
cur AS (SELECT *, CASE WHEN l_quantity > 25 THEN 'HIGH' ELSE 'LOW' END AS severity FROM items), base AS (SELECT *, CASE WHEN l_discount > 0.05 THEN 'HIGH' ELSE 'LOW' END AS severity FROM items),
cn AS (SELECT rule_id, file, line, evidence, severity, count(*) AS a FROM cur GROUP BY ALL), bn AS (SELECT rule_id, file, line, evidence, severity, count(*) AS b FROM base GROUP BY ALL),
cnt AS (SELECT coalesce(cn.rule_id, bn.rule_id) AS rule_id, coalesce(cn.file, bn.file) AS file, CASE WHEN a IS NOT NULL THEN cn.line ELSE bn.line END AS line, coalesce(cn.evidence, bn.evidence) AS evidence,
    coalesce(cn.severity, bn.severity) AS severity, coalesce(a, 0) AS n_current, coalesce(b, 0) AS n_baseline, least(coalesce(a, 0), coalesce(b, 0)) AS matched
  FROM cn FULL JOIN bn ON cn.rule_id = bn.rule_id AND cn.file = bn.file AND cn.line IS NOT DISTINCT FROM bn.line AND cn.evidence = bn.evidence AND cn.severity = bn.severity),
numbered AS (SELECT *, row_number() OVER (PARTITION BY rule_id, file, line, evidence, severity ORDER BY o, l_linenumber) AS rn FROM cur),
state AS (SELECT n.*, CASE WHEN rn <= coalesce(b, 0) THEN 'matched' ELSE 'new' END AS baseline_state FROM numbered n LEFT JOIN bn ON n.rule_id = bn.rule_id AND n.file = bn.file
  AND n.line IS NOT DISTINCT FROM bn.line AND n.evidence = bn.evidence AND n.severity = bn.severity)"""
SNAP = """snap AS (SELECT c_custkey AS n, CAST(c_custkey AS VARCHAR) AS path FROM customer), judged AS (SELECT *, CASE WHEN n % 13 = 0 THEN 'not valid JSON' WHEN n % 13 = 1 THEN 'not a JSON object'
    WHEN n % 13 = 2 THEN 'unsupported version' WHEN n % 13 = 3 THEN 'no findings list' WHEN n % 7 IN (1, 2) THEN 'record has a non-integer line' WHEN n % 11 = 0 THEN 'record has a non-string evidence' ELSE 'ok' END AS verdict FROM snap)"""
MARK = "CASE WHEN rule_id = 'AS-001' THEN evidence ELSE trim(text) END"
STATE = "CASE doc_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'matched' END"
CONFIDENCE = "CASE WHEN rule_id IN ('AS-006', 'AS-007') OR (rule_id = 'AS-001' AND (contains(evidence, 'API credential detected') OR contains(evidence, 'Private key block'))) THEN 'HIGH' ELSE 'MEDIUM' END"
BENCH = """cases AS (SELECT p_brand AS benchmark_id, CAST(p_partkey AS VARCHAR) AS case_id, p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN ['A', 'R'] ELSE ['N'] END AS expected FROM part),
seen AS (SELECT l_partkey AS k, coalesce(list(DISTINCT l_returnflag) FILTER (l_quantity < 4), []) AS observed, CASE WHEN max(l_quantity) > 49 THEN 'error' WHEN min(l_quantity) < 2 THEN 'timeout' ELSE 'completed' END AS status FROM lineitem GROUP BY l_partkey),
obs AS (SELECT CASE WHEN k % 101 = 0 THEN 'Brand#none' ELSE benchmark_id END AS benchmark_id, case_id, observed, status FROM seen JOIN cases USING (k)),
res AS (SELECT benchmark_id, case_id, list_filter(expected, lambda x: NOT list_contains(observed, x)) AS missing, status FROM cases JOIN obs USING (benchmark_id, case_id)),
summ AS (SELECT benchmark_id, count(*) AS total_cases, count(*) FILTER (status <> 'error' AND len(missing) = 0) AS passed_cases, count(*) FILTER (status <> 'error' AND len(missing) > 0) AS failed_cases,
  count(*) FILTER (status = 'error') AS error_cases FROM res GROUP BY benchmark_id)"""
CASES = """ok AS (SELECT * FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 19 <> 0)"""
LAB = f"""{FINDINGS_SQL}, hit AS (SELECT doc_id, bool_or(severity IN ('HIGH', 'CRITICAL')) AS strong, list(DISTINCT rule_id) AS rules FROM line_findings GROUP BY doc_id),
lab AS (SELECT doc_id, source AS category, CASE WHEN doc_id % 4 = 3 THEN CASE WHEN coalesce(strong, false) THEN 'FALSE_POSITIVE' ELSE 'DETECTED' END WHEN coalesce(strong, false) THEN 'DETECTED'
    WHEN CASE doc_id % 4 WHEN 0 THEN coalesce(len(list_intersect(rules, ['AS-003', 'AS-005'])) > 0, false) WHEN 1 THEN coalesce(list_contains(rules, 'AS-002'), false) ELSE rules IS NOT NULL END THEN 'PARTIALLY_DETECTED'
    ELSE 'MISSED' END AS result FROM documents LEFT JOIN hit USING (doc_id))"""
COUNTS = ", ".join(f"count(*) FILTER (result = {q(k)}) AS {v}" for k, v in ev.RESULTS.items())
HITS = " UNION ALL ".join(f"SELECT doc_id, line, {q(a)} AS pattern_id FROM lines WHERE contains(lower(text), {q(s)}) AND {m('text', p, True)}" for a, s, p in PATTERNS)
G = f"WITH RECURSIVE {GRAPH_SQL}, {PATHS}"
Z = "1.959963984540054"
WHOLE = f"""{CHAINS_SQL}, {FINDINGS_SQL[FINDINGS_SQL.index('line_findings AS ('):].replace('line_findings AS (', 'raw_findings AS (', 1)}, {COLLAPSE[:COLLAPSE.rindex('SELECT doc_id, line, rule, matched_text')].rstrip().rstrip(',').replace('\nf AS (', '\nfhttp AS (', 1).replace('FROM f)', 'FROM fhttp)')},
claims AS ({COLLAPSE[COLLAPSE.rindex('SELECT doc_id, line, rule, matched_text'):]}), {PAYLOADS},
line_findings AS (SELECT doc_id, source, path, 0 AS phase, line, rule_order, rule, rule_id, severity FROM raw_findings WHERE rule <> 'http_client'
  UNION ALL SELECT c.doc_id, d.source, d.path, CASE c.rule WHEN 'http_client' THEN 0 ELSE 1 END, c.line, CASE c.rule WHEN 'http_client' THEN {rc.RULE_ORDER['http_client']} ELSE {rc.RULE_ORDER['session_request']} END, c.rule, 'AS-003', 'MEDIUM' FROM claims c JOIN docs d USING (doc_id)
  UNION ALL SELECT h.doc_id, d.source, d.path, 1, h.line, 99, h.rule, 'AS-007', CASE h.rule WHEN 'base64_url' THEN 'HIGH' ELSE 'CRITICAL' END FROM hidden h JOIN docs d USING (doc_id) WHERE h.rule IS NOT NULL),
{TRIPLE_SQL.replace('struct_pack(line := line, rule_order := rule_order)', 'struct_pack(phase := phase, line := line, rule_order := rule_order)')}"""
ALL_FINDINGS = """SELECT source, rule_id, severity FROM line_findings
        UNION ALL SELECT source, chain, CASE WHEN chain = 'AS-CHAIN-001' OR (bool_or(severity IN ('CRITICAL', 'HIGH') AND rule_id IN ('AS-003','AS-005')) AND bool_or(severity IN ('CRITICAL', 'HIGH') AND rule_id = 'AS-002')) THEN 'CRITICAL' ELSE 'HIGH' END FROM parts GROUP BY source, chain
        UNION ALL SELECT d.source, c.rule_id, 'CRITICAL' FROM chains c JOIN docs d USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.path = d.path AND p.chain = c.rule_id AND p.line BETWEEN c."first" AND c."last")"""
WHOLE_PATHS = f"""{WHOLE}, {FINDING_EDGES[FINDING_EDGES.index('named AS ('):].replace('FROM line_findings', 'FROM raw_findings')}, {action_sql('steps', 'path')},
ran AS (SELECT d.path AS component, h.line FROM hidden h JOIN docs d USING (doc_id) WHERE h.rule IN ('base64_command', 'rot13_token', 'rot13_phrase')
  UNION SELECT d.path, c."first" FROM chains c JOIN docs d USING (doc_id) WHERE c.rule_id = 'AS-CHAIN-002' AND NOT EXISTS (SELECT 1 FROM parts p WHERE p.path = d.path AND p.chain = c.rule_id AND p.line BETWEEN c."first" AND c."last")),
graph AS (SELECT DISTINCT component, source, target, type, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS VARCHAR) AS confidence FROM (SELECT component, source, target, type FROM fe
  UNION ALL SELECT component, source, target, type FROM acted UNION ALL SELECT component, 'SKILL:' || component, 'ACTION:' || component || ':' || line || ':executes', 'EXECUTES' FROM ran)),
{PATHS.replace('exfil AS (SELECT', 'exfil_walks AS (SELECT').replace('FROM exfil UNION', 'FROM exfil_walks UNION').replace('allp AS', 'allpaths AS').replace('FROM allp)', 'FROM allpaths)')},
per AS (SELECT d.source, p.attack_type, p.risk_score FROM p JOIN docs d ON d.path = p.component)"""
GRAPH_RESULTS = RESULTS
ORACLES = {
    "relative_location": f"WITH {PLACED} SELECT file, count(*) AS n FROM recs GROUP BY file",
    "baseline_roots": f"""WITH {FINDINGS_SQL} SELECT CASE WHEN doc_id % 5 < 4 THEN 't' || doc_id % 5 END AS target,
      CASE doc_id % 5 WHEN 0 THEN path WHEN 2 THEN path WHEN 3 THEN '<outside>/' || regexp_extract(path, '([^/]*)$', 1) ELSE 'in/' || path END AS file, count(*) AS n
      FROM line_findings GROUP BY ALL""",
    "baseline_records": f"WITH {PLACED} SELECT rule_id, file, line, evidence, severity FROM recs",
    "rewrite_known_files": f"WITH {FINDINGS_SQL} SELECT doc_id || ':' || line || ':' || rule AS id, 'see ' || substr(path, 8) || ':' || line || ' or other/file.md (' AS evidence FROM line_findings",
    "finding_ids": f"WITH {PLACED} SELECT {ID} AS finding_id, rule_id, count(*) AS n FROM recs GROUP BY ALL",
    "ambiguous_ids": f"WITH {PLACED} SELECT finding_id, n FROM (SELECT {ID} AS finding_id, count(*) AS n FROM recs GROUP BY ALL) WHERE n > 1",
    "record_index": f"WITH {PLACED}, u AS (SELECT DISTINCT {ID} AS finding_id FROM recs) SELECT finding_id, (SELECT count(*) FROM u) AS total, greatest((SELECT count(*) FROM u) - 20, 0) AS not_shown FROM u ORDER BY finding_id LIMIT 20",
    "baseline_diff": f"WITH {SIDES} SELECT * FROM cnt",
    "baseline_counts": f"WITH {SIDES} SELECT CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(n_current - matched) AS BIGINT) AS new, CAST(sum(n_baseline - matched) AS BIGINT) AS fixed FROM cnt",
    "baseline_annotate": f"WITH {SIDES} SELECT o, l_linenumber, CASE WHEN file = 'f7' THEN NULL ELSE baseline_state END AS baseline_state FROM state",
    "baseline_fixed": f"WITH {SIDES} SELECT rule_id, file, line, evidence, severity FROM (SELECT *, unnest(range(0, n_baseline - matched)) AS i FROM cnt)",
    "baseline_balance": f"""WITH {SIDES}, s AS (SELECT file, count(*) AS rows_now, count(*) FILTER (baseline_state = 'matched') AS matched, count(*) FILTER (baseline_state = 'new') AS new FROM state GROUP BY file),
        g AS (SELECT file, CAST(sum(n_baseline - matched) AS BIGINT) AS fixed FROM cnt GROUP BY file) SELECT s.*, coalesce(fixed, 0) AS fixed FROM s LEFT JOIN g USING (file)""",
    "baseline_round_trip": f"WITH {PLACED} SELECT rule_id, count(*) AS written, count(*) AS back, count(*) AS equal FROM recs GROUP BY rule_id",
    "resolve_ids": f"""WITH {PLACED}, i AS (SELECT {ID} AS finding_id, rule_id, file FROM recs), c AS (SELECT finding_id, count(*) AS n, min(rule_id) AS r, min(file) AS f FROM i GROUP BY finding_id)
        SELECT finding_id, n AS n_records, CASE WHEN n = 1 THEN r END AS rule_id, CASE WHEN n = 1 THEN f END AS file FROM c
        UNION ALL SELECT finding_id || 'x', CAST(0 AS BIGINT), NULL, NULL FROM c WHERE finding_id IN (SELECT finding_id FROM i WHERE rule_id = 'AS-002')""",
    "sarif_run": f"""WITH {FINDINGS_SQL}, t AS (SELECT DISTINCT source FROM line_findings) SELECT source, CAST(section AS INTEGER) AS section, n FROM (
        SELECT source, unnest([0, 2, 4, 6]) AS section, CAST(1 AS BIGINT) AS n FROM t UNION ALL SELECT source, 1, count(DISTINCT rule_id) FROM line_findings GROUP BY source
        UNION ALL SELECT source, 3, count(DISTINCT path) FROM line_findings GROUP BY source UNION ALL SELECT source, 5, count(*) FROM line_findings GROUP BY source)""",
    "serialize_paths": f"""{G} SELECT path_id, edges[1].type AS first_type, attack_type, CAST(len(nodes) AS INTEGER) AS n_nodes, CAST(risk_score AS VARCHAR) AS risk_score FROM p""",
    "serialize_graph": f"""{G}, {GRAPH_RESULTS}, ids AS (SELECT source AS id FROM graph UNION SELECT target FROM graph),
        merged AS (SELECT component, source, target, type, max(severity) AS severity FROM graph GROUP BY ALL)
        SELECT 'node' AS kind, '{{"id":"' || id || '","type":"' || split_part(id, ':', 1) || '","label":"' || substr(id, position(':' IN id) + 1) || '"}}' AS json FROM ids
        UNION ALL SELECT 'edge', '{{"component":"' || component || '","source":"' || source || '","target":"' || target || '","type":"' || type || '","severity":' || coalesce('"' || severity || '"', 'null') || '}}' FROM merged
        UNION ALL SELECT 'policy', '{{"policy_id":"' || policy_id || '","path_id":"' || path_id || '","violated":' || CASE WHEN violated THEN 'true' ELSE 'false' END || ',"reason":"' || reason || '"}}' FROM results""",
    "matched_by_severity": f"WITH {SIDES} SELECT file, severity, count(*) AS n FROM state WHERE baseline_state = 'matched' GROUP BY ALL",
    "gate_only_new": f"WITH {SIDES} SELECT o % 1000 AS target, CASE WHEN count(*) FILTER (baseline_state = 'new' AND severity = 'HIGH') > 0 THEN 1 ELSE 0 END AS exit_code FROM state GROUP BY ALL",
    "read_snapshots": f"WITH {SNAP} SELECT path, verdict, CASE WHEN n % 13 < 4 THEN 1 ELSE 2 END::BIGINT AS n, CASE WHEN verdict = 'ok' AND n % 7 <> 0 THEN 2 * n END AS lines FROM (SELECT path, verdict, n FROM judged)",
    "findings_json": f"""WITH {MARKED_SQL} SELECT doc_id, line, rule, severity, nullif({MARK}, '') AS matched_text, CASE rule_id WHEN 'AS-001' THEN 'CWE-798' WHEN 'AS-002' THEN 'CWE-78' WHEN 'AS-006' THEN 'CWE-522' END AS cwe,
        {STATE} AS state, rule_id IN ('AS-001', 'AS-002', 'AS-006') AS has_mitre FROM marked""",
    "scan_json": f"""WITH {MARKED_SQL}, {score_sql('source')}, s AS (SELECT source, count(*) FILTER (NOT suppressed AND severity = 'HIGH') AS high, count(*) AS n, arg_min(rule_id, (doc_id, line, rule_order)) AS fr FROM marked GROUP BY source)
        SELECT source, CAST(score AS VARCHAR) AS score, {LEVEL} AS risk_level, CAST(high AS VARCHAR) AS high, CAST(files AS VARCHAR) AS files, fr AS first_rule, CAST(n AS INTEGER) AS listed
        FROM scored JOIN s USING (source) JOIN (SELECT source, count(*) AS files FROM documents GROUP BY source) USING (source)""",
    "sarif_results": f"""WITH {MARKED_SQL} SELECT doc_id, line, rule, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level,
        title || ': ' || {MARK} AS message, CASE {STATE} WHEN 'new' THEN 'new' WHEN 'matched' THEN 'unchanged' END AS "baselineState", path AS uri, suppression_reason AS justification FROM marked""",
    "sarif_rules": f"WITH {FINDINGS_SQL} SELECT source, rule_id, arg_min(title, (doc_id, line, rule_order)) AS title, arg_min({CONFIDENCE}, (doc_id, line, rule_order)) AS confidence FROM line_findings GROUP BY source, rule_id",
    "sarif_artifacts": f"WITH {FINDINGS_SQL} SELECT DISTINCT source, path AS uri FROM line_findings",
    "sarif_paths": f"""{G} SELECT path_id, 'ATTACK-PATH-' || attack_type AS rule, CASE risk_severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level,
        CASE attack_type WHEN 'UNKNOWN' THEN NULL ELSE replace(attack_type, '_', '-') || '-001' END AS policy, 'entry_node_skill_file' AS place FROM p""",
    "superseded_chains": f"""{G}, {carriers.ACTIONS_SQL}, best AS (SELECT substr(nodes[1], 7) AS file, max(path_id) AS pid FROM p WHERE substr(nodes[1], 7) IN (SELECT component FROM graph) GROUP BY ALL)
        SELECT a.component AS file, line, CASE WHEN idx % 2 = 0 THEN 'AS-CHAIN-004' ELSE 'AS-003' END AS rule_id, 'error' AS level, CASE WHEN idx % 2 = 0 THEN pid END AS superseded_by_path,
        CASE WHEN idx % 2 = 0 AND pid IS NOT NULL THEN 'inSource' END AS kind FROM actions a LEFT JOIN best ON best.file = a.component""",
    "adapt_cases": f"WITH {CASES} SELECT 'parts' AS benchmark_id, CAST(p_partkey AS VARCHAR) AS case_id, p_name AS name, p_type AS description, array_to_string(list_sort(list_distinct(['ASI0' || (p_partkey % 12), 'ASI01'])), ',') AS threats, 'A,N,R' AS expected FROM ok",
    "evaluate_cases": f"WITH {BENCH} SELECT benchmark_id, case_id, array_to_string(missing, ',') AS violated, len(missing) = 0 AS passed, status, 'Benchmark evaluation completed.' AS message FROM res",
    "evaluate_executions": f"WITH {BENCH} SELECT benchmark_id, case_id, len(missing) = 0 AS passed, 'completed' AS status FROM res",
    "unbound_executions": f"""WITH {BENCH} SELECT benchmark_id, case_id, 'no such case' AS problem FROM obs WHERE benchmark_id = 'Brand#none'
        UNION ALL SELECT benchmark_id, case_id, 'not executed' FROM cases WHERE (benchmark_id, case_id) NOT IN (SELECT benchmark_id, case_id FROM obs)""",
    "benchmark_summary": f"WITH {BENCH} SELECT * FROM summ",
    "benchmark_statuses": f"WITH {BENCH} SELECT benchmark_id, status, count(*) AS n FROM res GROUP BY ALL",
    "benchmark_sum_check": f"WITH {BENCH} SELECT benchmark_id FROM summ WHERE benchmark_id LIKE '%3' OR benchmark_id LIKE '%4'",
    "cross_benchmark": f"WITH {BENCH} SELECT count(*) AS total_benchmarks, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("total_cases", "passed_cases", "failed_cases", "error_cases")) + " FROM summ",
    "duplicate_benchmarks": f"WITH {BENCH} SELECT benchmark_id, CAST(2 AS BIGINT) AS n FROM summ WHERE benchmark_id LIKE '%1'",
    "threat_mapping": f"WITH {CASES}, tax(entry_id, entry_name) AS (VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b, _ in ev.TAXONOMY)
    + f"), t AS (SELECT unnest(list_distinct(['ASI0' || (p_partkey % 12), 'ASI01'])) AS threat_id FROM ok) SELECT threat_id, CASE WHEN entry_name IS NOT NULL THEN {q(ev.TAXONOMY_ID)} END AS taxonomy_id, entry_name, count(*) AS n FROM t LEFT JOIN tax ON entry_id = threat_id GROUP BY ALL",
    "duplicate_entries": "SELECT p_brand AS taxonomy_id, p_type AS entry_id, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1",
    "normalize_sets": """SELECT p_partkey, array_to_string(w, ',') AS words, array_to_string(list_filter(w, lambda x: NOT list_contains(string_split(p_name, ' '), x)), ',') AS missing
        FROM (SELECT *, list_sort(list_distinct(list_concat(string_split(p_name, ' '), string_split(p_type, ' '), ['zeta']))) AS w FROM part)""",
    "lab_cases": f"WITH {LAB} SELECT doc_id, result FROM lab",
    "lab_summary": f"WITH {LAB} SELECT count(*) AS total, {COUNTS}, round_even(100.0 * count(*) FILTER (result = 'DETECTED') / count(*), 1) AS detection_percentage FROM lab",
    "lab_by_category": f"WITH {LAB} SELECT category, count(*) AS total, {COUNTS} FROM lab GROUP BY category",
    "precision_wilson": f"""WITH c AS (SELECT source, count(*) FILTER (toxic <> 1 AND quality = 1) AS tp, count(*) FILTER (toxic <> 1 AND quality <> 1) AS fp, count(*) FILTER (toxic = 1) AS inconclusive
          FROM labels JOIN documents USING (doc_id) GROUP BY source), d AS (SELECT *, CAST(tp + fp AS DOUBLE) AS n, tp / CAST(tp + fp AS DOUBLE) AS p FROM c),
        e AS (SELECT *, (p + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) AS mid, {Z} / (1 + {Z} * {Z} / n) * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n)) AS half FROM d)
        SELECT source, tp, fp, inconclusive, CASE WHEN n > 0 THEN round(p, 6) END AS precision, CASE WHEN n > 0 THEN round(mid - half, 6) END AS low, CASE WHEN n > 0 THEN round(mid + half, 6) END AS high FROM e""",
    "register_rule": f"""WITH {FINDINGS_SQL} SELECT rule, rule_id, severity, count(*) AS n FROM line_findings GROUP BY ALL
        UNION ALL SELECT 'todo_marker', 'X-001', 'INFO', count(*) FROM lines WHERE regexp_matches(text, '(?i)nothing (?:to|else)')""",
    "register_file_rule": f"WITH {carriers.DOCS_SQL} SELECT doc_id, 'X-F-001' AS rule_id, 'HIGH' AS severity FROM docs WHERE contains(text, 'subprocess') AND contains(text, 'eval(')",
    "pattern_table": f"WITH {LINES_SQL} {HITS}",
    "pattern_table_many": f"""WITH {LINES_SQL}, w AS (SELECT DISTINCT lower(regexp_extract(p_name, '(\\w+)$', 1)) AS w FROM part)
        SELECT DISTINCT doc_id, line, 'W-' || w AS pattern_id FROM lines JOIN w ON contains(lower(text), left(w, 4)) WHERE w <> '' UNION ALL {HITS}""",
    "python_rule_errors": f"WITH {LINES_SQL} SELECT doc_id, line, CASE WHEN contains(text, 'password') THEN 'line_rule_exception' ELSE 'short' END AS outcome FROM lines WHERE contains(text, 'password') OR length(text) BETWEEN 1 AND 11",
    "stream_scan": f"WITH {FINDINGS_SQL} SELECT doc_id, line, rule, severity FROM line_findings",
    "stream_files_in_parts": f"""WITH {FINDINGS_SQL} SELECT CAST(doc_id % 7 AS VARCHAR) AS file, rule_id, count(*) FILTER (doc_id % 3 <> 0) AS new_rows
      FROM line_findings GROUP BY ALL HAVING new_rows > 0""",
    "stream_new_findings": f"WITH {FINDINGS_SQL} SELECT doc_id, line, rule_id, evidence FROM line_findings WHERE rule_id = 'AS-002'",
    "corpus_scan": f"""WITH {plain_findings_sql("SELECT source AS id, text FROM documents")}, s AS (SELECT id AS source, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM lines WHERE text <> '' GROUP BY id),
        g AS (SELECT id AS source, count(*) AS findings FROM f GROUP BY id) SELECT s.*, coalesce(findings, 0) AS findings FROM s LEFT JOIN g USING (source)""",
    "files_to_findings": f"""WITH {TREE_SQL}, {plain_findings_sql("SELECT path AS id, CASE WHEN variant = 2 THEN text || chr(65533) ELSE text END AS text FROM judged WHERE skip_reason IS NULL AND NOT pruned")}
        SELECT 'finding' AS kind, rule AS name, count(*) AS n, count(DISTINCT id) AS files FROM f GROUP BY rule
        UNION ALL SELECT kind, coalesce(reason, 'read'), count(*), count(DISTINCT path) FROM events_of GROUP BY ALL""",
    "whole_scan_findings": f"WITH RECURSIVE {WHOLE} SELECT source, rule_id, severity, count(*) AS n FROM ({ALL_FINDINGS}) GROUP BY ALL",
    "rescan_findings": f"WITH RECURSIVE {WHOLE} SELECT source, rule_id, severity, count(*) AS n FROM ({ALL_FINDINGS}) GROUP BY ALL",
    "whole_scan_paths": f"WITH RECURSIVE {WHOLE_PATHS} SELECT source, attack_type, risk_score, count(*) AS n FROM per GROUP BY ALL",
    "whole_scan_targets": f"""WITH RECURSIVE {WHOLE_PATHS}, every_finding AS ({ALL_FINDINGS}), marked AS (SELECT *, rule_id = 'AS-005' AS suppressed FROM every_finding), {score_sql('source')},
        counted AS (SELECT source, {", ".join(f"count(*) FILTER (NOT suppressed AND severity = {q(s)}) AS {s.lower()}" for s in vocab.SEVERITIES[:4])}, count(*) FILTER (suppressed) AS suppressed,
          count(*) AS findings, count(*) FILTER (rule_id <> 'AS-002') AS new, count(*) FILTER (rule_id = 'AS-002') AS matched FROM marked GROUP BY source),
        pathed AS (SELECT source, count(*) AS paths, count(*) FILTER (attack_type <> 'UNKNOWN') AS proven_paths, max(risk_score) AS worst_path_score, arg_max(attack_type, risk_score) AS worst_attack FROM per GROUP BY source)
        SELECT t.source, coalesce(score, 0) AS score, {LEVEL.replace('score', 'coalesce(score, 0)')} AS risk_level, 'full' AS coverage_status, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("critical", "high", "medium", "low", "suppressed", "findings", "new", "matched", "paths", "proven_paths"))},
        files_scanned, CASE WHEN coalesce(proven_paths, 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS policy_status, worst_attack, worst_path_score
        FROM (SELECT source, count(*) AS files_scanned FROM documents GROUP BY source) t LEFT JOIN scored USING (source) LEFT JOIN counted USING (source) LEFT JOIN pathed USING (source)""",
}
