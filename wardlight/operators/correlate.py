"""Chains over findings of one target: what occurs together, and close together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.operators.bands import TILE, near, tile_of, touching
from wardlight.operators.targets import by_target
from wardlight.session import cut

STRONG = ["CRITICAL", "HIGH"]
CHAINS = {
    "AS-CHAIN-001": (
        "Potential secret exfiltration chain", "Signals: prompt-injection + secret-access + network. Contributing: ",
        "Injection, secret or credential access and network use stand close together in one file.",
    ),
    "AS-CHAIN-002": (
        "Remote download followed by execution", "Signals: remote-download + command-execution. Contributing: ",
        "A download and a command execution stand close together in one file.",
    ),
    "AS-CHAIN-003": (
        "High-risk remote MCP execution chain", "Signals: remote-mcp + dynamic-exec. Contributing: ",
        "A remote MCP endpoint and dynamic package execution occur in one target.",
    ),
}


def _points(findings: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per (file, line) the first findings of each signal: all that can start or end a triple.

    AS-004 counts as injection and as secret access, hence two of it.
    """
    kind = (
        F.when(F.col("rule_id").isin(vocab.INJECTION_RULES), F.lit("I"))
        .when(F.col("rule_id").isin(vocab.SECRET_RULES), F.lit("K"))
        .when(F.col("rule_id").isin(vocab.NETWORK_RULES), F.lit("N"))
    )
    rows = findings.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("ord", F.struct(*order))
    place = W.partitionBy(*keys, "line", "kind").orderBy("ord")
    return (
        rows.withColumn("_rn", F.row_number().over(place))
        .where("_rn <= 2")
        .where("_rn = 1 OR kind = 'I'")
        .select(*keys, "line", "kind", "ord")
    )


def _feasible(pairs: DataFrame, networks: DataFrame, keys: Sequence[str], span: int) -> DataFrame:
    """Pairs (line, lo, hi) with a network finding inside [lo, hi]."""
    ranges = pairs.withColumnRenamed("lo", "first").withColumnRenamed("hi", "last")
    points = networks.select(*keys, F.col("line").alias("other_line"))
    return touching(ranges, points, keys, span)


@by_target()
def secret_exfiltration(findings: DataFrame, keys: Sequence[str], order: Sequence[str], span: int = vocab.LINE_SPAN) -> DataFrame:
    """The first local triple (injection, secret, network) of every file.

    ``keys`` name one file, ``order`` is the scan order within it. Three
    distinct findings are preferred; an AS-004 may stand for two signals only
    when no file-local distinct triple exists. Returns keys and the order
    values ``a``, ``b``, ``c``.
    """
    points = cut(_points(findings, keys, order))
    placed, loose = points.where("line IS NOT NULL"), points.where("line IS NULL")
    inj = placed.where("kind = 'I'")
    sec = placed.where("kind IN ('I', 'K')").select(*keys, F.col("line").alias("other_line"), F.col("ord").alias("b"))
    net = placed.where("kind = 'N'").select(*keys, "line", F.col("ord").alias("c"))
    lo = F.greatest("line", "other_line") - span
    hi = F.least("line", "other_line") + span
    pairs = (
        near(inj.select(*keys, "line", F.col("ord").alias("a")), sec, keys, span)
        .where("a <> b")
        .withColumn("lo", lo)
        .withColumn("hi", hi)
    )
    first_pair = cut(
        _feasible(pairs, net, keys, span)
        .groupBy(*keys)
        .agg(F.min(F.struct("a", "b", "first", "last")).alias("m"))
        .select(*keys, "m.*")
    )
    # one pair a file, a few tiles wide: the network findings meet it on (file, tile)
    tiles = F.sequence(tile_of(F.col("first"), TILE).cast("int"), tile_of(F.col("last"), TILE).cast("int"))
    distinct = (
        first_pair.withColumn("_tile", F.explode(tiles))
        .join(net.withColumn("_tile", tile_of(F.col("line"), TILE).cast("int")), [*keys, "_tile"])
        .where("line BETWEEN first AND last")
        .groupBy(*keys, "a", "b")
        .agg(F.min("c").alias("c"))
    )
    # second choice: one finding for both signals
    double = cut(
        near(inj.select(*keys, "line", F.col("ord").alias("a")),
             net.select(*keys, F.col("line").alias("other_line"), "c"), keys, span)
        .groupBy(*keys)
        .agg(F.min(F.struct("a", F.col("a").alias("b"), "c")).alias("m"))
        .select(*keys, "m.*")
    )
    loose_triples = _loose_triples(placed, loose, keys)
    ranked = (
        distinct.select(*keys, F.lit(0).alias("_tier"), "a", "b", "c")
        .unionByName(loose_triples)
        .unionByName(double.select(*keys, F.lit(1).alias("_tier"), "a", "b", "c"))
    )
    best = F.min(F.struct("_tier", "a", "b", "c"))
    return ranked.groupBy(*keys).agg(best.alias("m")).select(*keys, "m.a", "m.b", "m.c")


def _loose_triples(placed: DataFrame, loose: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Triples with a finding of unknown line: only the file has to agree.

    Per file and signal the first findings, with and without a line, are
    enough; that is at most a few dozen combinations.
    """
    files = loose.select(*keys).distinct()
    everything = placed.withColumn("free", F.lit(False)).unionByName(loose.withColumn("free", F.lit(True)))
    mine = everything.join(files, list(keys), "left_semi")
    place = W.partitionBy(*keys, "kind", "free").orderBy("ord")
    few = cut(mine.withColumn("_rn", F.row_number().over(place)).where("_rn <= 2").drop("_rn", "line"))
    a = few.where("kind = 'I'").select(*keys, F.col("ord").alias("a"), F.col("free").alias("fa"))
    b = few.where("kind IN ('I', 'K')").select(*keys, F.col("ord").alias("b"), F.col("free").alias("fb"))
    c = few.where("kind = 'N'").select(*keys, F.col("ord").alias("c"), F.col("free").alias("fc"))
    triples = a.join(b, list(keys)).join(c, list(keys)).where("fa OR fb OR fc")
    tier = F.when(F.col("a") == F.col("b"), 1).otherwise(0)
    best = F.min(F.struct(tier.alias("_tier"), "a", "b", "c"))
    return triples.groupBy(*keys).agg(best.alias("m")).select(*keys, "m._tier", "m.a", "m.b", "m.c")


@by_target()
def download_execute(findings: DataFrame, keys: Sequence[str], span: int = vocab.LINE_SPAN) -> DataFrame:
    """Download and execution findings that have a counterpart near them (adds ``side``)."""
    downloads = findings.where(F.col("rule_id").isin(vocab.NETWORK_RULES))
    executions = findings.where(F.col("rule_id").isin(vocab.EXEC_RULES))

    def with_partner(mine: DataFrame, others: DataFrame, side: str) -> DataFrame:
        lines = others.where("line IS NOT NULL").select(*keys, F.col("line").alias("other_line")).distinct()
        close = near(mine.where("line IS NOT NULL"), lines, keys, span, "left_semi")
        anywhere = others.where("line IS NULL").select(*keys).distinct()
        far = near(mine.where("line IS NOT NULL"), lines, keys, span, "left_anti").join(anywhere, list(keys), "left_semi")
        unplaced = mine.where("line IS NULL").join(others.select(*keys).distinct(), list(keys), "left_semi")
        return cut(close.unionByName(far).unionByName(unplaced).withColumn("side", F.lit(side)))

    return with_partner(downloads, executions, "download").unionByName(
        with_partner(executions, downloads, "execution")
    )


def location_of(file: Column, line: Column) -> Column:
    return F.when(F.coalesce(line, F.lit(0)) > 0, F.concat(file, F.lit(":"), line.cast("string"))).otherwise(file)


@by_target("scan")
def contributors(findings: DataFrame, scan: Sequence[str], file: str, order: Sequence[str], written: bool = False) -> DataFrame:
    """(scan keys, chain rule, contributing finding): the rows chains are made of.

    ``scan`` names one target; ``file`` the path column; ``order`` the scan
    order within a file. This is the whole result; the chain findings are a
    summary of it. ``written`` says that the findings are a written table already.
    """
    keys = [*scan, file]
    known = [r for rules in (
        vocab.SECRET_RULES, vocab.NETWORK_RULES, vocab.EXEC_RULES, vocab.REMOTE_RULES, vocab.DYNAMIC_RULES,
        vocab.SERVER_SECRET_RULES, vocab.SERVER_FS_RULES,
    ) for r in rules]
    findings = findings.where(F.col("rule_id").isin(known)).select(*dict.fromkeys([*keys, *order, "rule_id", "severity", "line"]))
    if not written:  # the joins below read the findings several times; the rules must not run again
        findings = cut(findings)
    triple = cut(secret_exfiltration(findings, keys, order))
    chosen = triple.select(*keys, F.explode(F.array_distinct(F.array("a", "b", "c"))).alias("ord"))
    one = (
        findings.withColumn("ord", F.struct(*order))
        .join(chosen, [*keys, "ord"])
        .select(*keys, F.lit("AS-CHAIN-001").alias("chain"), "rule_id", "severity", "line")
    )
    two = download_execute(findings, keys).select(
        *keys, F.lit("AS-CHAIN-002").alias("chain"), "rule_id", "severity", "line"
    )
    wanted = vocab.REMOTE_RULES + vocab.DYNAMIC_RULES + vocab.SERVER_SECRET_RULES + vocab.SERVER_FS_RULES
    remote = findings.where(F.col("rule_id").isin(wanted))
    ready = (
        remote.groupBy(*scan)
        .agg(
            F.bool_or(F.col("rule_id").isin(vocab.REMOTE_RULES)).alias("r"),
            F.bool_or(F.col("rule_id").isin(vocab.DYNAMIC_RULES)).alias("d"),
        )
        .where("r AND d")
        .select(*scan)
    )
    three = remote.join(ready, list(scan), "left_semi").select(
        *keys, F.lit("AS-CHAIN-003").alias("chain"), "rule_id", "severity", "line"
    )
    return one.unionByName(two).unionByName(three)


@by_target("scan")
def chain_findings(parts: DataFrame, scan: Sequence[str], file: str) -> DataFrame:
    """One finding per target and chain, summarising its contributors (read twice)."""
    strong = F.col("severity").isin(STRONG)
    flags = parts.groupBy(*scan, "chain").agg(
        F.bool_or(F.col("rule_id").isin(vocab.NETWORK_RULES) & strong).alias("strong_download"),
        F.bool_or(F.col("rule_id").isin(vocab.EXEC_RULES) & strong).alias("strong_execution"),
        F.bool_or(F.col("rule_id").isin(vocab.SERVER_SECRET_RULES + vocab.SERVER_FS_RULES)).alias("extra"),
    )
    severity = (
        F.when(F.col("chain") == "AS-CHAIN-001", F.lit("CRITICAL"))
        .when((F.col("chain") == "AS-CHAIN-002") & F.col("strong_download") & F.col("strong_execution"), F.lit("CRITICAL"))
        .when((F.col("chain") == "AS-CHAIN-003") & F.col("extra"), F.lit("CRITICAL"))
        .otherwise(F.lit("HIGH"))
    )

    def say(index: int) -> Column:
        expr = None
        for rule, words in CHAINS.items():
            cond = F.col("chain") == rule
            expr = F.when(cond, F.lit(words[index])) if expr is None else expr.when(cond, F.lit(words[index]))
        return expr

    places = locations(parts, scan, file)
    return flags.join(places, [*scan, "chain"]).select(
        *scan,
        F.col("chain").alias("rule_id"), severity.alias("severity"), say(0).alias("title"), say(2).alias("description"),
        F.lit("<correlated>").alias("file"), F.concat(say(1), "places").alias("evidence"),
    )


@by_target("scan")
def locations(parts: DataFrame, scan: Sequence[str], file: str) -> DataFrame:
    """Sorted ``file:line`` list per target and chain, always complete.

    It is the evidence of one finding, and identities hash it, so it may not depend on its
    length. It grows with the target's contributors; readers that want rows take those.
    """
    spots = parts.select(*scan, "chain", location_of(F.col(file), F.col("line")).alias("spot")).distinct()
    return spots.groupBy(*scan, "chain").agg(F.array_join(F.array_sort(F.collect_set("spot")), ", ").alias("places"))


@by_target("scan")
def uncovered(chains: DataFrame, parts: DataFrame, scan: Sequence[str], file: str, span: int = vocab.LINE_SPAN) -> DataFrame:
    """Document chains that no correlation contributor of the same rule already describes."""
    keys = [*scan, file, "rule_id"]
    marks = parts.select(*scan, file, F.col("chain").alias("rule_id"), F.col("line").alias("other_line"))
    whole = marks.where("other_line IS NULL").select(*keys).distinct()
    left = chains.join(whole, keys, "left_anti")
    # only rules correlation can report need the range test
    rules = list(CHAINS)
    open_rules = left.where(~F.col("rule_id").isin(rules))
    tested = touching(left.where(F.col("rule_id").isin(rules)), marks.where("other_line IS NOT NULL"), keys, span, "left_anti")
    return tested.unionByName(open_rules)


