import itertools
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing as M


def test_sql(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(tuple(r) for r in M.op4_raking(d).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(con.execute(M.op4_sql()).fetchall()) and got


def cells(spark, rows):
    return spark.createDataFrame([(*r, float(r[3])) for r in rows], "source string, lang string, topic string, t long, w double")


def frames(spark, want):
    return {d: spark.createDataFrame(list(v.items()), f"{d} string, share double") for d, v in want.items()}


def marginals(got, d):
    out = {}
    for r in got:
        out[r[d]] = out.get(r[d], 0) + r.w
    return out


SKEWED = [("a", "en", "x", 100), ("a", "de", "x", 50), ("b", "en", "y", 400), ("b", "de", "x", 10), ("c", "de", "y", 5)]
WANT = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"x": 0.6, "y": 0.4}}


def test_raking_meets_marginals(spark):
    got = M.rake(cells(spark, SKEWED), frames(spark, WANT), 1e-6).collect()
    assert len(got) == 5
    for d, v in WANT.items():
        assert marginals(got, d) == pytest.approx(v, abs=2e-6)
    # the raked weights are the start weights times one factor for each category: cross ratios stay
    more = [(s, lang, t, n) for n, (s, lang, t) in enumerate(itertools.product("ab", ("en", "de"), "xy"), 3)]
    w = {(r.source, r.lang, r.topic): r.w / r.t for r in M.rake(cells(spark, more), frames(spark, {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.2, "de": 0.8}, "topic": {"x": 0.5, "y": 0.5}})).collect()}
    for t in "xy":
        assert w["a", "en", t] * w["b", "de", t] == pytest.approx(w["a", "de", t] * w["b", "en", t])


def test_missing_and_infeasible_targets(spark):
    want = WANT | {"source": {"a": 0.5, "b": 0.3, "gone": 0.2}}
    got = M.rake(cells(spark, SKEWED), frames(spark, want | {"lang": {"en": 0.55, "de": 0.45}}), 1e-6).collect()
    assert marginals(got, "source") == pytest.approx({"a": 0.625, "b": 0.375, "c": 0.0})
    with pytest.warns(RuntimeWarning, match="off by"):
        got = M.rake(cells(spark, [("a", "en", "x", 3), ("b", "de", "x", 3)]), frames(spark, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.9, "de": 0.1}, "topic": {"x": 1.0}})).collect()
    assert len(got) == 2 and sum(r.w for r in got) == pytest.approx(1)


def test_budget_is_spread_until_it_is_met(spark):
    rows = [(f"s{i}", "en", "x", 10, w) for i, w in enumerate([0.5, 0.2, 0.1, 0.08, 0.06, 0.03, 0.02, 0.01])]
    got = M.probabilities(spark.createDataFrame(rows, "source string, lang string, topic string, t long, w double"), 0.9).collect()
    assert sum(r.p * r.t for r in got) == pytest.approx(72) and max(r.p for r in got) == 1


def test_budget_and_draws(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("source"), F.lit("en").alias("lang"), F.repeat(F.lit("word "), F.lit(20)).alias("text"))
    got = M.mix(d)
    n = got.agg(F.sum("n_tokens")).first()[0]
    assert abs(n / (4000 * 20) - M.BUDGET) < 4 * math.sqrt(0.25 / 4000)
    rate = {r.source: r.p_keep for r in got.select("source", "p_keep").distinct().collect()}
    assert rate["small"] > rate["big"]
    again = M.mix(d.repartition(7)).select("doc_id").collect()
    assert sorted(again) == sorted(got.select("doc_id").collect())


def test_edge_cases(spark):
    rows = [(None, None, None, None, 1), (1, "", "", "", 2), (2, "w " * 100_000, None, "en", 3), (2, "w " * 100_000, None, "en", 3), (3, "a | b", "s", "en", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic long")
    got = M.mix(d, budget=1.0)
    assert got.count() == 5 and got.columns == ["doc_id", "text", "source", "lang", "topic", "n_tokens", "p_keep"]
    assert M.mix(d.limit(0)).count() == 0


def test_clashing_columns(spark):
    rows = [(i, "w " * 5, "s", "en", 7, 8, 9) for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, p long, _tokens long, own_p long")
    got = M.mix(d, budget=1.0).collect()
    assert len(got) == 6 and all((r.p, r._tokens, r.own_p) == (7, 8, 9) for r in got)
