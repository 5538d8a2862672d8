"""Personal data by weak supervision, in DataFrame and SQL expressions only.

Base spans are exact: leftmost matches of the fixed patterns that pass their check. Candidates for
further spans are near misses (matches that fail the check) and looser shapes: spelled-out
addresses, defanged IPs, numbers of 13 to 15 digits, phone numbers without a country code. Three
labelers vote on every candidate, base spans included: the shape check, a gazetteer (top-level
domains, issuer and country prefixes, routable first octets) and the context. Expectation-
maximisation over the table of vote patterns, eight a kind, estimates how reliable each labeler
is; the posterior of a candidate is its soft label. The span classifier is a naive Bayes over
shape, length, both contexts and votes, trained on the soft labels of all candidates. Looser shapes
that it accepts and that overlap no base span are added; base spans stay.

Positions: a pattern splits a text into what lies between its matches; the lengths of these
pieces, added up by a window over the matches of a text, are the code points before a match.
Patterns have no group loops, so texts of any length keep the matcher's stack flat: separators
that cannot belong to a number or domain are first replaced by a letter of equal width.

Defined results: null is the empty text. Repeated rows are rows of their own; ids may be null.
Spans are ordered by kind, then start; ends are exclusive. A text without spans has counts 0,
an empty list and the digest of the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm.common import Scratch, table

KINDS = ["email", "ip", "card", "phone"]
ROUNDS, ACCEPT = 30, 0.5
_DOTTED = r"(?:\[\.\]|\(\.\)|\[dot\]| dot )"
#: pattern name -> (kind, base, cheap test that a text can match, text to match, pattern)
PATTERNS = {
    "email": (
        "email", True, "contains(text, '@')", r"regexp_replace(text, '(?<![A-Za-z0-9-])\\.|\\.(?![A-Za-z0-9-])', '_')",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
    ),
    "ip": ("ip", True, r"text rlike '[0-9]\\.[0-9]++\\.[0-9]'", "text", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "number": (
        "card", True, "text rlike '[0-9](?:[ -]?[0-9]){12}'", "regexp_replace(text, '(?<![0-9])[ -]|[ -](?![0-9])', 'x')", r"[0-9][0-9 -]{12,}+",
    ),
    "phone": ("phone", True, r"text rlike '\\+[0-9]'", "text", r"\+[0-9][ ().0-9-]+[0-9]"),
    "spelled": (
        "email", False, r"text rlike '(?i)[\\[(] ?at ?[\\])]'", "text",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]++(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?|\.)[A-Za-z0-9-]++",
    ),
    "defanged": ("ip", False, r"text rlike '[0-9](?:\\[|\\(|\\[dot\\]| dot )'", "text", r"(?<![0-9.])[0-9]{1,3}" + (_DOTTED + "[0-9]{1,3}") * 3 + "(?![0-9])"),
    "local": ("phone", False, "text rlike '[0-9]{3}[ .-][0-9]{4}'", "text", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
#: Gazetteers: what a genuine value of each kind tends to begin or end with.
KNOWN = {
    "email": r"(?i)[. ](?:com|org|net|edu|gov|mil|int|info|io|dev|de|fr|es|uk|eu|us|ch|at|it|nl)$",
    "ip": r"^0*(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])[^0-9]",
    "card": r"^(?:3[47]|4|5[1-5]|2[2-7]|6)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reply|courriel|correo|kontakt)", "ip": r"(?i)(?:\bip\b|host|server|addr|client|ping|login)",
    "card": r"(?i)(?:card|visa|credit|pay|karte|carte|tarjeta)", "phone": r"(?i)(?:phone|call|tel|fax|mobil|handy|numéro|ruf)",
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(name: str) -> Column:
    """Matches of one pattern: turn, code points since the last match, value and both contexts."""
    _, _, test, source, pattern = PATTERNS[name]
    at = _quoted(pattern)
    body = f"transform(array({source}), t -> named_struct('p', split(t, {at}, -1), 'm', regexp_extract_all(t, {at}, 0)))"
    one = "named_struct('turn', i, 'before', length(s.p[i]), 'value', x, 'left', right(s.p[i], 32), 'right', left(s.p[i + 1], 16))"
    return F.expr(f"case when {test} then transform({body}, s -> transform(s.m, (x, i) -> {one}))[0] end")


def candidates(docs: DataFrame, scratch: Scratch, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id) of all rows; candidates as (uid, kind, base, start, end, shape, known, near, features...)."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = scratch.write(rows.select("uid", "doc_id", *[_matches(name).alias(name) for name in PATTERNS]), "matches")
    some = F.array(*[F.struct(F.lit(n).alias("pattern"), F.lit(k).alias("kind"), F.lit(b).alias("base"), F.col(n).alias("found")) for n, (k, b, *_) in PATTERNS.items()])
    flat = found.select("uid", F.explode(some).alias("p")).select("uid", "p.pattern", "p.kind", "p.base", F.explode("p.found").alias("m")).select("uid", "pattern", "kind", "base", "m.*")
    # the text that was matched may have stand-ins for separators between matches, never inside one
    so_far = W.partitionBy("uid", "pattern").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    flat = flat.withColumn("end", F.sum(F.col("before") + F.length("value")).over(so_far).cast("long")).withColumn("start", F.col("end") - F.length("value"))
    digits = flat.withColumn("digits", F.regexp_replace("value", "[^0-9]", ""))
    n = F.length("digits")
    luhn = F.expr("""aggregate(sequence(1, length(digits)), 0, (a, i) -> a + case when i % 2 = 1 then int(substring(reverse(digits), i, 1))
        else int(substring(reverse(digits), i, 1)) * 2 - case when int(substring(reverse(digits), i, 1)) > 4 then 9 else 0 end end) % 10 = 0""")
    octets = F.expr(r"forall(split(regexp_replace(value, '[^0-9]+', '.'), '\\.'), x -> length(ltrim('0', x)) <= 3 and int(right(concat('000', ltrim('0', x)), 3)) <= 255)")
    octets = F.coalesce(octets, F.lit(False))
    checks = {"email": F.lit(True), "ip": octets, "number": n.between(16, 19) & luhn, "phone": n.between(8, 15), "spelled": F.lit(True), "defanged": octets, "local": n == 10}
    passed = F.lit(False)
    shaped = F.lit(False)
    for name, test in checks.items():
        passed = F.when(F.col("pattern") == name, test).otherwise(passed)
    shaped = F.when((F.col("pattern") == "number") & n.between(13, 15), luhn).otherwise(passed)
    flagged = digits.withColumn("passed", F.col("base") & passed).withColumn("shape", shaped)
    flagged = flagged.withColumn("loose", (~F.col("base") | ((F.col("pattern") == "number") & n.between(13, 15))) & F.col("shape"))
    known, near = F.lit(False), F.lit(False)
    for kind in KINDS:
        known = F.when(F.col("kind") == kind, F.when(F.lit(kind == "card"), F.col("digits")).otherwise(F.col("value")).rlike(KNOWN[kind])).otherwise(known)
        near = F.when(F.col("kind") == kind, F.col("left").rlike(CONTEXT[kind])).otherwise(near)
    alone = F.col("left").rlike(r"(?:^|[\s(\[<\"':;,])$") & F.col("right").rlike(r"^(?:$|[\s)\]>\"'.,;:!?])")
    out = flagged.select(
        "uid", "kind", "pattern", "passed", "loose", "start", "end", F.col("shape").cast("int").alias("shape"), known.cast("int").alias("known"),
        (near | alone).cast("int").alias("near"),
        F.array(
            F.concat(F.lit("pattern="), "pattern"), F.concat(F.lit("length="), F.least(F.length("value"), F.lit(40)).cast("string")),
            F.concat(F.lit("digits="), F.least(n, F.lit(24)).cast("string")), F.concat(F.lit("word="), near.cast("string")), F.concat(F.lit("alone="), alone.cast("string")),
            F.concat(F.lit("known="), known.cast("string")), F.concat(F.lit("shape="), F.col("shape").cast("string")),
        ).alias("features"),
    )
    return found.select("uid", "doc_id"), scratch.write(out, "candidates")


_VOTES = ["shape", "known", "near"]


def reliabilities(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, model) by expectation-maximisation; model has the prior and, of each labeler, how often it votes for true and for false spans."""
    patterns = found.groupBy("kind", *_VOTES).agg(F.count(F.lit(1)).cast("double").alias("n"))
    held = patterns.groupBy("kind").agg(F.collect_list(F.struct(*_VOTES, "n")).alias("v"))  # eight rows a kind
    likely = lambda side: " * ".join(f"if(x.{c} = 1, m.{c}{side}, 1 - m.{c}{side})" for c in _VOTES)
    total = lambda what: f"aggregate(w, 0d, (a, x) -> a + {what})"
    posterior = f"m.prior * {likely(1)} / (m.prior * {likely(1)} + (1 - m.prior) * {likely(0)})"
    yes, no = total("x.n * x.q"), total("x.n * (1 - x.q)")
    fields = [f"'prior', ({yes} + 1) / ({yes} + {no} + 2)"]
    for c in _VOTES:
        fields.append(f"'{c}1', ({total(f'x.n * x.q * x.{c}')} + 2) / ({yes} + 3), '{c}0', ({total(f'x.n * (1 - x.q) * x.{c}')} + 1) / ({no} + 3)")
    step = f"transform(array(transform(v, x -> named_struct({', '.join(f"'{c}', x.{c}" for c in _VOTES)}, 'n', x.n, 'q', {posterior}))), w -> named_struct({', '.join(fields)}))[0]"
    first = "named_struct('prior', 0.5d, " + ", ".join(f"'{c}1', 0.8d, '{c}0', 0.3d" for c in _VOTES) + ")"
    return held.select("kind", F.expr(f"aggregate(sequence(1, {rounds}), {first}, (m, i) -> {step})").alias("m"))


def classify(found: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """Candidates with ``p``, the classifier's probability of a genuine span."""
    side = lambda k: " * ".join(f"if({c} = 1, m.{c}{k}, 1 - m.{c}{k})" for c in _VOTES)
    soft = found.join(reliabilities(found, rounds), "kind").withColumn("q", F.expr(f"m.prior * {side(1)} / (m.prior * {side(1)} + (1 - m.prior) * {side(0)})"))
    # equal candidates are one row from here on: kind and features are few
    types = scratch.write(soft.groupBy("kind", "features").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")), "types")
    prior = types.groupBy("kind").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    flat = types.select("kind", "features", "yes", "no", F.explode("features").alias("feature"))
    weight = flat.groupBy("kind", "feature").agg(F.sum("yes").alias("f_yes"), F.sum("no").alias("f_no")).join(prior, "kind")
    # smoothed towards the odds of the kind, so a value that is rare says little
    share = (F.col("all_yes") + 0.5) / (F.col("all_yes") + F.col("all_no") + 1)
    first = F.log(share / (1 - share))
    log_odds = F.log((F.col("f_yes") + 2 * share) / (F.col("f_no") + 2 * (1 - share))) - first
    weight = weight.select("kind", "feature", log_odds.alias("odds"), first.alias("first"))
    told = flat.select("kind", "features", "feature").join(weight, ["kind", "feature"]).groupBy("kind", "features").agg((F.sum("odds") + F.max("first")).alias("z"))
    return found.join(told.withColumn("p", 1 / (1 + F.exp(-F.col("z")))).drop("z"), ["kind", "features"], "left")


def spans(docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, accept: float = ACCEPT) -> tuple[DataFrame, DataFrame]:
    """((uid, doc_id) of every row, spans as (uid, kind, start, end, base, p))."""
    rows, found = candidates(docs, scratch, id, text)
    judged = classify(found, scratch, rounds).filter(F.col("passed") | (F.col("loose") & (F.col("p") >= accept)))
    order = W.partitionBy("uid").orderBy("start", "end", F.col("passed").desc(), "pattern")
    covered = F.max(F.when(F.col("passed"), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("passed"), F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
    earlier = F.max(F.when(~F.col("passed"), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    clear = (F.coalesce(covered, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end")) & (F.coalesce(earlier, F.lit(0)) <= F.col("start"))
    kept = judged.withColumn("clear", clear).filter(F.col("passed") | F.col("clear"))
    return rows, kept.select("uid", "kind", "start", "end", F.col("passed").alias("base"), "p")


def find(docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_<kind> of base spans, base_sha256, spans, n_added."""
    rows, kept = spans(docs, scratch, id, text, **settings)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    told = kept.withColumn("told", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")))
    one = F.struct(place.alias("place"), "start", "end", "told")
    joined = lambda which: F.expr(f"array_join(transform({which}, x -> x.told), ',')")
    counts = [F.coalesce(F.count_if(F.col("base") & (F.col("kind") == k)), F.lit(0)).alias(f"n_{k}") for k in KINDS]
    grouped = told.groupBy("uid").agg(
        *counts, F.sort_array(F.collect_list(F.when(F.col("base"), one))).alias("base_spans"), F.sort_array(F.collect_list(one)).alias("all_spans"),
        F.count_if(~F.col("base")).alias("n_added"),
    )
    texts = grouped.select("uid", *[f"n_{k}" for k in KINDS], "n_added", joined("base_spans").alias("base_text"), joined("all_spans").alias("spans"))
    none = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return rows.join(texts, "uid", "left").select(
        "doc_id", *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base_text", F.lit("")).cast("binary"), 256).alias("base_sha256"), none("spans", ""), F.coalesce("n_added", F.lit(0)).cast("long").alias("n_added"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), Scratch(spark, "pii"))
