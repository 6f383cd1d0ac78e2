import numpy as np

from tidemark.llm import quality as Q


def test_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    g = Q.grades(labels)
    model = Q.fit(d, g.where("doc_id % 5 <> 0"))
    assert (np.diff(model[1]) > 0).all()
    held = Q.score(d.select("doc_id", "text").join(g.where("doc_id % 5 = 0"), "doc_id"), model)
    rows = [(r.grade, r.expected_grade, r.p_good >= Q.KEEP) for r in held.collect()]
    good, toxic = [k for y, _, k in rows if y == 2], [k for y, _, k in rows if y == 0]
    poor = [k for y, _, k in rows if y == 1]
    print(np.mean(good), np.mean(poor), np.mean(toxic), len(rows))
    assert np.mean(good) >= 0.97 and np.mean(toxic) <= 0.25 and np.mean(poor) <= 0.1
    means = [np.mean([e for y, e, _ in rows if y == k]) for k in range(3)]
    assert means[0] < means[2] and means[1] < means[2]


def test_gradient():
    """The step's direction against numeric differences of the likelihood."""
    t = np.array([-0.5, 1.0])

    def loss(s, t, y):
        full = np.concatenate([[1.0], Q.tails(np.array([s]), t)[0], [0.0]])
        return -np.log(full[y] - full[y + 1])

    for y in range(3):
        w, new = Q._pass([(y, np.array([0]))], np.zeros(4), t)
        assert np.sign(w[0]) == -np.sign(round(loss(1e-4, t, y) - loss(-1e-4, t, y), 9))
        for k in range(2):
            e = np.eye(2)[k] * 1e-4
            assert np.sign(np.round(t - new, 9))[k] == np.sign(np.round(loss(0.0, t + e, y) - loss(0.0, t - e, y), 9))


def test_edge_cases(spark):
    d = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "x" * 100_000, 1.0), (3, "word " * 50_000, None), (3, "word " * 50_000, None)], "doc_id long, text string, p_good double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.keep for r in Q.op2_ordinal_quality(d, none).collect()] == [True] * 5
    some = spark.createDataFrame([(1, 1, 0), (3, None, None), (9, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert Q.op2_ordinal_quality(d, some).count() == 5
    assert Q.score(d, Q.fit(d, Q.grades(some))).columns == ["doc_id", "text", "expected_grade", "p_good"]
    assert Q.op2_ordinal_quality(d.limit(0), some).count() == 0
