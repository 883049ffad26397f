"""Markov models against numpy and brute-force enumeration, and golden values."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.functions import kernels
from wavelark.operators import evaluation, hmm
from wavelark.plans import fixtures

SF = "/root/testdata/sf0.01"
START = fixtures.MODELS[0]


@pytest.fixture(scope="module")
def sequences(spark):
    return fixtures.user_sequences(spark, SF).cache()


def paths(o, m):
    for q in itertools.product(range(len(m.pi)), repeat=len(o)):
        p = m.pi[q[0]] * m.emit[q[0], o[0]]
        for t in range(1, len(o)):
            p *= m.trans[q[t - 1], q[t]] * m.emit[q[t], o[t]]
        yield q, p


@pytest.mark.parametrize("m", fixtures.MODELS)
def test_scores_and_paths_by_enumeration(spark, m):
    rng = np.random.default_rng(2)
    seqs = [[int(x) for x in rng.integers(0, 5, n)] for n in (1, 2, 6)]
    rows = spark.createDataFrame([(i, o) for i, o in enumerate(seqs)], "i int, symbols array<int>")
    for r in rows.select("i", hmm.log_likelihood(m, native=True).alias("lp"), hmm.log_likelihood(m, native=False).alias("lp2"), hmm.viterbi(m).alias("v")).collect():
        every = list(paths(seqs[r.i], m))
        total = np.log(sum(p for _, p in every))
        best = max(p for _, p in every)
        assert r.lp == pytest.approx(total) and r.lp2 == pytest.approx(total) and r.v.lp == pytest.approx(np.log(best))
        assert dict(every)[tuple(r.v.path)] == pytest.approx(best)
        assert kernels.viterbi(np.array(seqs[r.i]), m.pi, m.trans, m.emit)[1] == r.v.path


def test_viterbi_ties_take_the_lowest_state(spark):
    m = hmm.Hmm.of([0.5, 0.5], [[0.5, 0.5]] * 2, [[0.5, 0.5]] * 2)
    assert spark.createDataFrame([([0, 1, 0],)], "symbols array<int>").select(hmm.viterbi(m)["path"]).first()[0] == [0, 0, 0]


def test_impossible_and_empty_sequences(spark):
    m = hmm.Hmm.of([1, 0], [[1, 0], [0, 1]], [[1, 0], [0, 1]])
    rows = spark.createDataFrame([([0, 1],), ([],)], "symbols array<int>")
    assert [r[0] for r in rows.select(hmm.log_likelihood(m)).collect()] == [float("-inf"), 0.0]
    assert hmm.em_step(rows.where(F.size("symbols") > 0), m)[2] == 1
    assert hmm.conforming(rows, 2).count() == 1 and hmm.conforming(rows, 1).count() == 0


def test_expected_counts_by_enumeration():
    o = [0, 3, 1, 4, 2, 0]
    a, b, d, lp = kernels.expected_counts(np.array(o), START.pi, START.trans, START.emit)
    ea, eb, total = np.zeros((3, 3)), np.zeros((3, 5)), 0.0
    for q, p in paths(o, START):
        total += p
        for t, s in enumerate(q):
            eb[s, o[t]] += p
            if t:
                ea[q[t - 1], s] += p
    assert np.allclose(a, ea / total) and np.allclose(b, eb / total) and lp == pytest.approx(np.log(total))
    assert np.allclose(d, a.sum(axis=1))


def test_em_golden(sequences):
    new, lp, dead = hmm.em_step(sequences, START)
    assert dead == 0 and lp == pytest.approx(-16136.968226, abs=1e-5)
    assert np.allclose(new.trans, [[0.591542, 0.305281, 0.103177], [0.196559, 0.498916, 0.304525], [0.097377, 0.297587, 0.605036]], atol=1e-6)
    assert np.allclose(new.emit, [[0.098331, 0.266187, 0.313334, 0.203656, 0.118492], [0.286167, 0.177875, 0.104722, 0.201908, 0.229328], [0.188746, 0.176472, 0.208246, 0.199976, 0.22656]], atol=1e-6)
    assert (new.pi == START.pi).all()


def test_learning(sequences):
    _, history = hmm.learn(sequences, START, max_iterations=5, auto=0, estimate=False)
    assert np.allclose(history, [-16136.968226, -16098.199823, -16097.754226, -16097.376783, -16097.053457, -16096.773739], atol=1e-4)
    model, short = hmm.learn(sequences, START, auto=0.5, max_iterations=50)
    assert len(short) < 50 and abs(short[-1] - short[-2]) <= abs(np.log(0.5))
    assert np.allclose(model.trans.sum(axis=1), 1) and np.allclose(model.emit.sum(axis=1), 1) and (model.emit >= hmm.EPSILON).all()


def test_initial_models():
    for kind in ("random", "uniform", "cascade2", "cascade3"):
        m = hmm.initial_model(5, 7, kind, seed=3)
        for rows in ([m.pi], m.trans, m.emit):
            assert np.allclose(np.sum(rows, axis=1), 1)
    assert (np.tril(hmm.initial_model(5, 7, "cascade2").trans, -1) == 0).all() and hmm.initial_model(5, 7, "cascade2").trans[0, 2] == 0


def test_floor():
    out = hmm.floor_emissions(np.array([[0, 0.5, 0.5], [0.2, 0.3, 0.5]]), 0.01)
    assert np.allclose(out.sum(axis=1), 1) and (out >= 0.01).all() and np.allclose(out[1], [0.2, 0.3, 0.5])
    with pytest.raises(ValueError):
        hmm.floor_emissions(np.full((1, 4), 0.25), 0.3)


def test_classification(spark, sequences):
    twins = [fixtures.MODELS[0], fixtures.MODELS[0]]
    top = hmm.scores(sequences.limit(3), twins, ["user_id"]).where("rank = 1")
    assert {r.model_id for r in top.collect()} == {1}  # the higher model wins ties
    only = hmm.classify(sequences, fixtures.MODELS[:2], ["user_id"])
    assert {r.actual for r in only.select("actual").distinct().collect()} == {"0", "1"}
    assert [r.class_name for r in hmm.unmatched(sequences, fixtures.MODELS[:2]).collect()] == ["2"]
    cases = hmm.classify(sequences, fixtures.MODELS, ["user_id"])
    acc = evaluation.accuracy(cases).first()
    assert acc.tests == 150 and acc.json == '{"accuracy": %.2f, "avg_accuracy": %.2f}' % (acc.accuracy, acc.avg_accuracy)
    order = {r.class_name: r for r in evaluation.candidate_order(cases, 3).collect()}
    assert order["TOTAL"].tests == 150 and order["TOTAL"].r1 == acc.hits
    table = evaluation.confusion(cases, ["0", "1", "2"]).collect()
    assert sum(r["tests"] - r["errors"] for r in table) == acc.hits
    assert evaluation.accuracy(cases.where("false")).count() == 0


def test_generation(spark):
    a = hmm.generate(spark, START, 50, 30, seed=5, partitions=1).orderBy("seq").collect()
    assert a == hmm.generate(spark, START, 50, 30, seed=5, partitions=7).orderBy("seq").collect()
    assert a != hmm.generate(spark, START, 50, 30, seed=6).orderBy("seq").collect()
    first = np.bincount([r.states[0] for r in hmm.generate(spark, START, 3000, 1).collect()], minlength=3) / 3000
    assert np.allclose(first, START.pi, atol=0.04)


def test_generated_data_is_learned(spark):
    data = hmm.generate(spark, fixtures.MODELS[1], 200, 30, seed=1).withColumn("class_name", F.lit("x"))
    models = hmm.learn_by_class(data, 2, 5, "random", max_iterations=3)
    assert [m.class_name for m in models] == ["x"] and np.allclose(models[0].emit.sum(axis=1), 1)


def test_dead_states_get_new_rows(spark):
    """A state that no sequence visits: its rows are drawn again within its kind, and stay stochastic."""
    m = hmm.Hmm.of([1, 0, 0], [[0.5, 0.5, 0], [0, 1, 0], [0, 0, 1]], [[0.5, 0.5], [0.5, 0.5], [0.5, 0.5]], kind="cascade2")
    s = spark.createDataFrame([([0, 1, 1, 0],)], "symbols array<int>")
    new, _, dead = hmm.em_step(s, m, seed=3)
    assert dead == 0 and new.trans[2].tolist() == [0, 0, 1] and np.allclose(new.trans.sum(axis=1), 1) and np.allclose(new.emit.sum(axis=1), 1)
    free = hmm.Hmm.of([1, 0, 0], [[0.5, 0.5, 0], [0, 1, 0], [0.2, 0.3, 0.5]], [[0.5, 0.5]] * 3)
    new, _, _ = hmm.em_step(s, free, seed=3)
    assert np.isclose(new.trans[2].sum(), 1) and (new.trans[2] > 0).all() and new.trans[2].tolist() != [0.2, 0.3, 0.5]


def test_other_alphabets_do_not_conform(spark):
    rows = [([0, 1], 2, "a"), ([0, 1], 4, "a"), ([], 2, "a"), ([0, 3], 2, "a")]
    s = spark.createDataFrame(rows, "symbols array<int>, n_symbols int, class_name string")
    assert hmm.conforming(s, 2).count() == 1 and hmm.conforming(s.drop("n_symbols"), 2).count() == 2
    m = [hmm.initial_model(2, 2, "random", 1, "a")]
    assert hmm.classify(s, m, []).count() == 1


def test_training_texts(spark):
    m = hmm.initial_model(2, 3, "cascade3", 1, "k")
    text = hmm.training_summary(m, 7, [-9.5, -8.25])
    assert "class: k" in text and "refinements: 1" in text and "sum of log P: -8.25" in text
    assert hmm.model_directory(3, 5, 3, 0.3) == "N3__M5_t3__a0.3"
