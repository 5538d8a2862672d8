"""The sieve in front of the line rules, the steps and the payload rule loses nothing."""

from dataclasses import replace

from pyspark.sql import functions as F

from test_line_rules import HITS, MISSES
from wardlight import vocab
from wardlight.functions import text as tx
from wardlight.operators import document_rules as dr
from wardlight.operators import line_rules as lr
from wardlight.operators import steps as st

ODD = ["", None, "READ the Key Config", "oſ.ſyſtem(x)", "Fınd the paſſword", "İnstall the code", "xread data", "éread data; geté key",
       "Get it; then read the .ssh", "a;run it", "and then Execute the script", "unshüre content", "Fetch_remote script", "send·url", "run " * 500 + "content"]
LINES = [t for rows in (HITS, MISSES) for texts in rows.values() for t in texts] + ODD


def test_bits_name_the_choices_a_text_matches_in_full(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["run it now", "run", "it", "", None, "sh[", "rerun it"])], "i int, text string")
    choices = [[r"\brun\b", "it"], [tx.any_word(["[", "now"])], ["it"]]
    found = {r.i: r.b for r in texts.select("i", tx.matching(F.col("text"), choices).alias("b")).collect()}
    assert found == {0: 7, 1: 0, 2: 4, 3: 0, 4: 0, 5: 2, 6: 4}


def test_rules_find_the_same_with_and_without_the_sieve(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line int, text string")
    assert all(r.stems for r in lr.RULES)
    plain = [replace(r, stems=()) for r in lr.RULES]
    found, all_tried = (sorted((r.line, r.rule, r.found) for r in lr.judge_lines(lines, rules).select("line", "rule", F.coalesce("found", F.lit("")).alias("found")).collect()) for rules in (None, plain))
    assert found == all_tried and len(found) > 100
    mixed = [replace(r, stems=r.stems if i % 2 else ()) for i, r in enumerate(lr.RULES)]
    assert sorted((r.line, r.rule) for r in lr.judge_lines(lines, mixed).collect()) == [f[:2] for f in found]


def test_steps_are_those_of_all_lines(spark):
    verbs = ["read", "Load", "get", "extract", "retrieve", "curl", "fetch", "send", "push", "run", "exec", "bash", "shell", "system", "parse", "reads", "bashed"]
    nouns = ["the config", "a Token", "api key", "~/.ssh", "remote content", "to https://a.example", "webhook", "this script", "it", "code", "nothing", "é.aws"]
    texts = [f"{v} {n}" for v in verbs for n in nouns] + [t for t in LINES if t]
    lines = spark.createDataFrame(list(enumerate(texts)), "line int, text string")
    steps = st.classified(st.split_actions(lines)).select("line", "seg", "category")
    expected = sorted((r.line * 2**32 + r.seg, r.category) for r in steps.collect())
    assert sorted((r.idx, r.category) for r in st.actions(lines).collect()) == expected and len(expected) > 60
    assert {c for _, c in expected} == {name for name, _ in vocab.STEP_PATTERNS}


def test_payloads_of_every_context(spark):
    command, link = "cm0gLXJmIC90bXAvZGF0YQ==", "aHR0cHM6Ly9ldmlsLmV4YW1wbGUvcGF5bG9hZC5zaA=="
    texts = [f"{command}\nEXECUTE", f"{command}\n| Bash", f"{command}\nno", f"{link}\nRetrıeve the ſcript", f"{link}\nget\nurl", f"{link}\nGet the URL", 'ROT13 "ez -es /gzc/qngn abj"\nrun', None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert sorted((r.i, r.rule) for r in dr.payloads(docs).collect()) == [(0, "base64_command"), (1, "base64_command"), (3, "base64_url"), (5, "base64_url"), (6, "rot13_phrase")]
