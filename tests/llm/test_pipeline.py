import corpus_pipeline
from helpers import awkward, none_of, prose

from wardlight.llm import exact_dedup, toxicity
from wardlight.llm.common import Scratch
from wardlight.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    assert [q.split("_")[0] for q in sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 11)]
    assert set(ORACLES) <= set(QUERIES)


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables hold too few labels to learn from
    docs, scratch = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark, "t")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        last = docs
        docs = scratch.write(stage(spark, docs, sf), name)
        if name != "mixing":
            assert docs.columns == last.columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] >= counts[4] == counts[5]
    again = corpus_pipeline.run(spark, sf)
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, docs.collect())) == sorted(map(key, again.collect()))


def test_stages_on_awkward_rows(spark):
    for docs in (awkward(spark), none_of(spark)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            assert Scratch(spark, "t").write(stage(spark, docs, SF), name).columns == docs.columns
        assert corpus_pipeline.mixture(spark, docs, SF).count() == docs.count()


def test_a_stage_judges_its_own_input(spark):
    """A copy that an earlier stage removed does not decide for later ones."""
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, prose(1, 50)), (2, prose(1, 50)), (3, prose(2, 50))], "doc_id long, text string")
    first = toxicity.keep_clean(docs.filter("doc_id != 2"), labels, Scratch(spark, "t"))
    assert {r["doc_id"] for r in exact_dedup.keep_one(first, keep="largest").collect()} == {1, 3}
