"""Documents to a training mix, stage by stage; every stage is one operator of ``wardlight.llm``.

The operators' tables in the shared folder back a stage's lazy result. A stage's result is
written before the next stage begins, so each stage first deletes what the ones before it left.
"""

from __future__ import annotations

from wardlight.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity
from wardlight.llm.common import Scratch, table


def _scratch(spark, name: str) -> Scratch:
    for old in _LEFT:
        old.drop()
    _LEFT[:] = [Scratch(spark, name)]
    return _LEFT[0]


_LEFT: list[Scratch] = []


def clean(spark, docs, sf_dir):
    """Documents that do not read as toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), _scratch(spark, "toxicity"))


def exact(spark, docs, sf_dir):
    """One row of each text, that with the largest id."""
    _scratch(spark, "exact")  # nothing to keep, but what the stage before left goes
    return exact_dedup.keep_one(docs, keep="largest")


def near(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return near_dedup.keep_one(docs, _scratch(spark, "near"))


def uncontaminated(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), _scratch(spark, "leaks"))


def mixture(spark, docs, sf_dir):
    """What the mix takes of each document that is left."""
    return mixing.mix(docs, Scratch(spark, "mix"))  # read after the pipeline has ended


STAGES = [("toxicity", clean), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", uncontaminated), ("mixing", mixture)]
#: Learned scores, sketches and seeded choices have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, written = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = written.write(stage(spark, docs, sf_dir), name)
    return docs
