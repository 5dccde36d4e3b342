from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.test_search import brute_links
from tidewatch.llm import decontamination, packing, pii, quality
from tidewatch.llm.common import table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


def test_stages_against_brute_force(llm):
    docs = table(llm, FOLDER, "documents")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](llm, docs, FOLDER)
    predicted = {r.doc_id for r in quality.score(docs, table(llm, FOLDER, "labels")).collect() if r.predicted}
    assert {r.doc_id for r in good.collect()} == predicted and good.columns == docs.columns

    rows = [(r.doc_id, r.text) for r in good.collect()]
    component = {i: c for (i, _, c) in brute_links(rows)}
    single = stages["near_copies"](llm, good, FOLDER)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, _ in rows if component[i] == i)
    assert single.columns == docs.columns

    leaks = {r.doc_id for r in decontamination.find(single, table(llm, FOLDER, "benchmark")).collect()}
    clean = stages["decontamination"](llm, single, FOLDER)
    assert leaks and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaks

    private = stages["pii"](llm, clean, FOLDER)
    assert private.columns == docs.columns
    assert private.count() == clean.count()
    assert sum(r[k] for r in pii.report(private).collect() for k in ("n_email", "n_ip", "n_card", "n_phone")) == 0
    assert all(r.n_chars == len(r.text) for r in private.collect())

    packed = stages["packing"](llm, private, FOLDER)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in private.collect()}
    assert packing.CAPACITY == 2048


def test_copies_and_odd_rows(llm, make_docs):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text), (3, text), (1, text + " eleven"), (None, text), (None, "alone and without an id here"), (7, None), (7, ""), (8, "x")]
    kept = corpus_pipeline.near_copy_stage(llm, make_docs(rows), FOLDER).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [
        (0, "alone and without an id here"), (1, text + " eleven"), (7, ""), (7, ""), (8, "x")]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(llm, make_docs([]), FOLDER).count() == 0, name


def test_extra_columns_survive(llm):
    docs = llm.sql("SELECT 1L AS doc_id, 'mail me a@b.cd' AS text, 14L AS n_chars, 'k' AS text_key, 2 AS row, 3 AS all, array(1) AS email")
    for stage in (corpus_pipeline.pii_stage, corpus_pipeline.near_copy_stage, corpus_pipeline.decontamination_stage):
        out = stage(llm, docs, FOLDER)
        assert out.columns == docs.columns and out.first().text_key == "k"
    assert corpus_pipeline.pii_stage(llm, docs, FOLDER).first().text == "mail me <email>"
