"""The five stages on the smallest tables, each against its own operator's rule."""

import os

import pytest

import corpus_pipeline
from coocatlas.llm import hyperminhash, quality_rules, suffix_search
from coocatlas.llm.tables import read, staged

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables absent")


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages(spark):
    docs = read(spark, SF_DIR, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "private_data", "packing"]
    good = staged(stages["quality"](spark, docs, SF_DIR), "t")
    assert good.columns == docs.columns
    assert ids(good) == ids(quality_rules.ledger(docs).where(quality_rules.passes()))
    single = staged(stages["near_duplicates"](spark, good, SF_DIR), "t")
    assert ids(single) == ids(hyperminhash.components(good).where("doc_id = component_id"))
    benchmark = read(spark, SF_DIR, "benchmark")
    clean = staged(stages["decontamination"](spark, single, SF_DIR), "t")
    assert ids(clean) == ids(suffix_search.search(single, benchmark).where(~suffix_search.contaminated()))
    masked = staged(stages["private_data"](spark, clean, SF_DIR), "t")
    assert ids(masked) == ids(clean) and masked.columns == docs.columns
    pieces = stages["packing"](spark, masked, SF_DIR)
    assert sorted({r.doc_id for r in pieces.select("doc_id").collect()}) == ids(masked)
