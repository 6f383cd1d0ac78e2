"""Columns of any name pass through every operator that returns the documents, with their own values."""

import pytest

from tidemark.llm import decontam, mixing, near_dup, pii, quality, sentence_spans
from tidemark.llm.shared import own

NAMES = ["p", "_id", "id", "extra", "_key", "_mark", "_doc", "_places", "_tokens", "_topic", "_k", "own_p", "node", "label", "hash", "place", "w", "t"]


@pytest.mark.parametrize("run", [
    near_dup.keep_first, lambda d: decontam.remove(d, d.sparkSession.createDataFrame([(1, "no such passage")], "item_id long, text string")), pii.sanitise, sentence_spans.dedup, lambda d: mixing.mix(d, budget=1.0),
    lambda d: quality.good(d, quality.fit(d, d.selectExpr("doc_id", "cast(doc_id % 3 as int) as grade")), 0.0),
], ids=["near_dup", "decontam", "pii", "sentence_spans", "mixing", "quality"])
def test_columns(spark, run):
    rows = [(i, f"text number {i} of its own, mail a{i}@b.cd", "en", "s", *(1000 * i + k for k in range(len(NAMES)))) for i in range(6)] + [(None, None, None, None, *range(7000, 7000 + len(NAMES)))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` long" for n in NAMES))
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in run(d).collect()}
    assert got == {r[0]: r[4:] for r in rows}


def test_own(spark):
    assert own(spark.createDataFrame([(1, 2)], "a int, OWN_x int")) == "own__"
