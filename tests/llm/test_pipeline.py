"""The pipeline's stages against brute force over each stage's own input."""

import re

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

from tests.llm import test_op1, test_op5, test_op6
from tidemark.llm import quality

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("steps")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in C.STAGES:
        made = stage(spark, docs, SF)
        made.write.parquet(str(path / name))
        before, docs = docs, spark.read.parquet(str(path / name))
        out.append(({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()}))
    return out


def test_order_and_columns(steps):
    assert [n for n, _ in C.STAGES] == ["quality", "near_dup", "decontam", "pii", "mixing"]
    for before, after in steps:
        assert after and {*after} <= {*before}
    for _, after in steps[:4]:
        assert next(iter(after.values())).__fields__ == COLUMNS


def test_quality(spark, steps):
    before, after = steps[0]
    want = quality.score(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), quality.grades(spark.read.parquet(f"{SF}/labels.parquet"))))
    assert {*after} == {r.doc_id for r in want.where(F.col("p_good") >= quality.KEEP).collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, r in labels.items() if d in before and r.quality and not r.toxic]
    assert sum(d in after for d in good) >= 0.95 * len(good)


def test_near_dup(steps):
    before, after = steps[1]
    assert {*after} == {i for i, (_, _, kept) in test_op5.brute([(i, r.text) for i, r in before.items()], 5).items() if kept}


def test_decontam(spark, steps):
    before, after = steps[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {*after} == {r[0] for r in test_op6.brute([(i, r.text) for i, r in before.items()], items) if not r[-1]}


def test_pii(steps):
    before, after = steps[3]
    want = test_op1.brute([(i, r.text) for i, r in before.items()])
    marks = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}
    assert {*after} == {*before}
    for i, r in before.items():
        out, at = [], 0
        for k, a, z in (s.split(":") for s in want[i].split(",") if s):
            if int(a) >= at:
                out += [r.text[at : int(a)], marks[k]]
            at = max(at, int(z))
        text = "".join([*out, r.text[at:]])
        assert after[i].text == text and after[i].n_chars == len(text)
        assert not re.search(r"@[a-z]+\.[a-z]", after[i].text)


def test_mixing(steps):
    before, after = steps[4]
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in before.items()}
    assert all(after[i].n_tokens == words[i] and 0 < after[i].p_keep <= 1 for i in after)
    assert 0.35 < sum(words[i] for i in after) / sum(words.values()) < 0.65


def test_run(spark, steps):
    assert {r.doc_id for r in C.run(spark, SF).select("doc_id").collect()} == {*steps[-1][1]}
