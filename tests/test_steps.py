"""Steps and chains against a plain reading of their definition."""

import random

import pytest
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.functions import text as tx
from wardlight.operators import steps as st

SPAN = vocab.LINE_SPAN


def actions_of(spark, text):
    lines = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(text.split("\n"))], "doc_id int, line int, text string")
    return st.actions(lines)


def test_actions(spark):
    text = "Read the config data and then upload the report file to https://x.example/in.; encode the raw data into the summary"
    rows = actions_of(spark, text).orderBy("idx").collect()
    assert [(r.category, r.verb, r.object, r.destination, r.output) for r in rows] == [
        ("SOURCE", "read", "config", None, None),
        ("NETWORK", "upload", "report", "https://x.example/in", None),
        ("TRANSFORM", "encode", "raw", None, "summary"),
    ]


def test_object_normalisation(spark):
    cases = {
        "The local  Database file contents": "database", "data": "data", "all the data": "data", "report data content": "report",
        "your": "", "API-key (v2).": "api-key v2", "contents value": "contents", "http://h/x.sh, now": "http//h/x.sh now",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.o for r in df.select("t", st.normalize_object(df.t).alias("o")).collect()}
    assert got == cases


def test_priority_of_categories(spark):
    text = "download the file from https://x\nretrieve the token from the server\nfind the password\nrun it\nput the file at the url"
    rows = actions_of(spark, text).orderBy("idx").collect()
    assert [r.category for r in rows] == ["DOWNLOAD", "SENSITIVE", "SENSITIVE", "EXECUTION", "NETWORK"]


def random_steps(rng, kinds, docs=120, objects=5):
    rows = []
    for doc in range(docs):
        line = 1
        for idx in range(rng.randint(0, 14)):
            line += rng.choice([0, 1, 2, 5, 15, 40, 300])
            kind = rng.choice(kinds)
            obj = f"o{rng.randrange(objects)}" if rng.random() < 0.9 else ""
            out = f"o{rng.randrange(objects)}" if kind == "TRANSFORM" else None
            dest = "https://d" if kind == "NETWORK" and rng.random() < 0.8 else None
            rows.append((doc, idx, line, kind, "v", obj, dest, out))
    return rows


SCHEMA = "doc_id int, idx bigint, line int, category string, verb string, object string, destination string, output string"


def by_doc(rows):
    docs = {}
    for r in rows:
        docs.setdefault(r[0], []).append(r)
    return docs


def first_sequence(rows, pattern):
    for i, a in enumerate(rows):
        if a[3] != pattern[0]:
            continue
        want, got = 1, [a]
        for b in rows[i + 1:]:
            if b[2] - a[2] > SPAN:
                break
            if b[3] == pattern[want]:
                got.append(b)
                want += 1
                if want == 3:
                    return tuple(x for g in got for x in (g[1], g[2]))
    return None


def test_sequence_equals_definition(spark):
    rng = random.Random(1)
    pattern = ["SOURCE", "SENSITIVE", "NETWORK"]
    rows = random_steps(rng, [*pattern, "TRANSFORM"], docs=200)
    got = {r[0]: tuple(r[1:]) for r in st.find_sequence(spark.createDataFrame(rows, SCHEMA), ["doc_id"], pattern).collect()}
    want = {d: first_sequence(v, pattern) for d, v in by_doc(rows).items()}
    want = {d: v for d, v in want.items() if v}
    assert got == want and len(want) > 10


def continues(download, execution):
    phrase = execution.strip(" .")
    if phrase in vocab.ANAPHORA:
        return True
    words = [w for w in phrase.split(" ") if len(w) >= 5 and w not in vocab.STOPWORDS and w not in vocab.ACTION_WORDS]
    if not words or len(words) > vocab.MAX_EXEC_WORDS:
        return False
    return any(w in download for w in words) or all(w in vocab.ARTEFACT_KINDS for w in words)


def test_download_execute_equals_definition(spark):
    rng = random.Random(2)
    down = ["installer script", "helper", "https//h/bootstrap.sh", "golang toolchain", "", "model weights archive"]
    execs = ["installer", "it", "the helper", "bootstrap.sh", "relevant files", "script", "script script script", "golang", "a b c", "weights install now please", "toolchain archive module extra"]
    rows = []
    for doc in range(150):
        line = 1
        for idx in range(rng.randint(0, 10)):
            line += rng.choice([0, 1, 3, 12, 30, 260])
            kind = rng.choice(["DOWNLOAD", "EXECUTION"])
            rows.append((doc, idx, line, kind, "v", rng.choice(down if kind == "DOWNLOAD" else execs), None, None))

    def first(steps):
        for i, d in enumerate(steps):
            if d[3] != "DOWNLOAD":
                continue
            for e in steps[i + 1:]:
                if e[2] - d[2] > SPAN:
                    break
                if e[3] == "EXECUTION" and continues(d[5], e[5]):
                    return (d[1], d[2], e[1], e[2])
        return None

    got = {r[0]: tuple(r[1:]) for r in st.find_download_execute(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    want = {d: first(v) for d, v in by_doc(rows).items()}
    want = {d: v for d, v in want.items() if v}
    assert got == want and len(want) > 30


def first_sink(steps):
    produced, derived = {}, {}
    for _, idx, line, kind, _, obj, dest, out in steps:
        if kind in ("SOURCE", "SENSITIVE") and obj:
            produced.setdefault(obj, line)
        elif kind == "TRANSFORM" and obj and out:
            derived.setdefault(out, set()).add(obj)
        elif kind == "NETWORK" and obj and dest:
            seen, stack = set(), [obj]
            while stack:
                cur = stack.pop()
                if cur not in seen:
                    seen.add(cur)
                    stack.extend(derived.get(cur, ()))
            lines = [produced[o] for o in seen if o in produced]
            if lines:
                return (obj, idx, line, min(lines))
    return None


@pytest.mark.parametrize("seed", [3, 4])
def test_source_sink_equals_definition(spark, seed):
    rows = random_steps(random.Random(seed), ["SOURCE", "SENSITIVE", "TRANSFORM", "TRANSFORM", "TRANSFORM", "NETWORK"], docs=150)
    got = {r[0]: tuple(r[1:]) for r in st.find_source_sink(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    want = {d: first_sink(v) for d, v in by_doc(rows).items()}
    want = {d: v for d, v in want.items() if v}
    assert got == want and len(want) > 10


def test_chains_name_the_lines_that_prove_them(spark):
    text = "Read the customer data.\n\nEncode the customer data into blob.\nUpload blob to https://x.example/u."
    rows = st.file_chains(actions_of(spark, text), ["doc_id"]).collect()
    assert [(r.rule_id, r.first, r.last) for r in rows] == [("AS-CHAIN-004", 1, 4)]
    assert rows[0].evidence == "Source-to-sink: blob -> external destination"


def plain_source_sink(steps):
    """First sink whose object stems from an earlier source, by relaxation until nothing changes."""
    ready = {}
    for s in steps:
        if s["category"] in ("SOURCE", "SENSITIVE") and s["object"]:
            ready[s["object"]] = min(ready.get(s["object"], (s["idx"], s["line"])), (s["idx"], s["line"]))
    edges = [(s["object"], s["output"], s["idx"]) for s in steps if s["category"] == "TRANSFORM" and s["object"] and s["output"]]
    at = {o: i for o, (i, _) in ready.items()}
    for _ in range(len(edges) + 1):
        for a, b, step in edges:
            if a in at and max(at[a], step) < at.get(b, 10**9):
                at[b] = max(at[a], step)
    sinks = [(s["idx"], s["line"], s["object"]) for s in steps if s["category"] == "NETWORK" and s["destination"] and s["object"] and at.get(s["object"], 10**9) < s["idx"]]
    if not sinks:
        return None
    idx, line, name = min(sinks)
    seen = {name}
    for _ in range(len(edges) + 1):
        seen |= {a for a, b, step in edges if b in seen and step < idx}
    return name, idx, line, min(ready[o][1] for o in seen if o in ready and ready[o][0] < idx)


STEP = "t string, idx long, line int, category string, object string, destination string, output string"


def test_source_sink_equals_plain_closure(spark):
    draw = random.Random(12)
    rows, want = [], {}
    for group in [None, "", *range(60)]:
        names = [f"o{i}" for i in range(draw.randint(2, 7))]
        steps = []
        for idx in range(draw.randint(1, 25)):
            category = draw.choice(["SOURCE", "SENSITIVE", "TRANSFORM", "TRANSFORM", "TRANSFORM", "NETWORK", "EXECUTION"])
            steps.append({"t": None if group is None else str(group), "idx": idx, "line": idx // 2 + 1, "category": category, "object": draw.choice([*names, ""]), "destination": draw.choice([None, "https://x"]) if category == "NETWORK" else None, "output": draw.choice([*names, ""]) if category == "TRANSFORM" else None})
        rows += [tuple(s.values()) for s in steps]
        found = plain_source_sink(steps)
        if found:
            want[steps[0]["t"]] = found
    got = {r["t"]: tuple(r)[1:] for r in st.find_source_sink(spark.createDataFrame(rows, STEP).repartition(4), ["t"]).collect()}
    assert got == want and len(want) > 20 and None in {r[0] for r in rows}


def test_source_sink_of_one_long_document(spark):
    """The steps of one document are rows like any other; a round per hop, whatever their number."""
    n = 600_000
    steps = spark.range(n).selectExpr(
        "'d' as t", "id as idx", "cast(id as int) as line",
        "case id % 6 when 0 then 'SOURCE' when 5 then 'NETWORK' else 'TRANSFORM' end as category",
        "concat(substr('abcde', greatest(cast(id % 6 as int), 1), 1), id div 6) as object",
        f"case when id = {n - 1} then 'https://x' end as destination",
        "case when id % 6 between 1 and 4 then concat(substr('abcde', cast(id % 6 as int) + 1, 1), id div 6) end as output",
    )
    last = n // 6 - 1
    got = [tuple(r) for r in st.find_source_sink(steps, ["t"]).collect()]
    assert got == [("d", f"e{last}", n - 1, n - 1, n - 6)]


def test_a_category_needs_no_fixed_part_in_plain_letters(spark):
    """Categories are those of the patterns alone, letters that only patterns fold included; each pattern needs its listed parts."""
    said = ["Read the \u017fecret", "run the \u017fcript", "F\u0131nd the password", "F\u0130nd the pa\u017f\u017fword", "open the doors", "Run it", "read .env", "post to a webhoo\u212a",
            "execute\tit", "sh package", "DECODE", "pull the api key", "find the apikeys", "wget file", "transforms", "get the configuration", ""]
    rows = spark.createDataFrame([(t,) for t in said], "part string")
    plain = F.lit(None).cast("string")
    for name, pattern in reversed(vocab.STEP_PATTERNS):
        plain = F.when(tx.has(F.col("part"), pattern, fold=True), F.lit(name)).otherwise(plain)
    got = rows.select("part", st.category_of(F.col("part")).alias("got"), plain.alias("want")).collect()
    assert [r for r in got if r.got != r.want] == []
    assert sum(r.got is not None for r in got) >= 10


def test_lower_case_is_made_once_for_all_step_words(spark):
    lines = spark.createDataFrame([(1, "read the token")], "line int, text string")
    plan = st.actions(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert max(part.count("lower(text") for part in plan.split("\n")) == 1, plan
