"""Linear prediction, quantization and endpoint detection against numpy written from the formulas, and golden values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.functions import hof, kernels
from wavelark.operators import endpoint, lpc, vq
from wavelark.plans import catalogue, fixtures
from wavelark.sources import wav

SF = "/root/testdata/sf0.01"


def scalar_levinson(r):
    a, rc, pe = [1.0], [0.0], r[0]
    for k in range(1, len(r)):
        q = -sum(a[j] * r[k - j] for j in range(k)) / pe
        a = [1.0] + [a[j] + q * a[k - j] for j in range(1, k)] + [q]
        rc.append(q)
        pe *= 1 - q * q
    return rc, a, pe


@pytest.fixture(scope="module")
def signals(spark):
    rng = np.random.default_rng(1)
    rows = [(f"d/c{i % 2}/{i}.wav", f"c{i % 2}", [float(x) for x in rng.standard_normal(50 + 37 * i)]) for i in range(6)]
    return spark.createDataFrame([*rows, ("d/c0/short.wav", "c0", [1.0, 2.0]), ("d/c0/quiet.wav", "c0", [0.0] * 60)], "path string, class_name string, samples array<double>")


def test_levinson_and_raa(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((20, 40))
    rows = spark.createDataFrame([(i, [float(v) for v in f]) for i, f in enumerate(x)], "i int, frame array<double>")
    got = lpc.features(rows, 6, normalize=False).withColumn("raa", hof.reflections_to_raa(F.col("lp.rc"))).collect()
    for g in got:
        r = [float(np.dot(x[g.i][: 40 - k], x[g.i][k:])) for k in range(7)]
        rc, a, pe = scalar_levinson(r)
        assert np.allclose(g.r, r) and np.allclose(g.lp.rc, rc) and np.allclose(g.lp.a, a) and g.lp.pe == pytest.approx(pe) and g.lp.status == 0
        assert np.allclose(g.raa, [sum(a[k] * a[k + n] for k in range(7 - n)) for n in range(7)])
        assert max(abs(v) for v in g.lp.rc) < 1
        k_rc, k_a, k_pe, _ = kernels.levinson(np.array([r]))
        assert np.allclose(k_rc[0], rc) and np.allclose(k_a[0], a) and np.allclose(k_pe[0], pe)
        assert np.allclose(kernels.reflections_to_raa(np.array([rc]))[0], g.raa)


def test_native_and_arrow_features_agree(signals):
    key = lambda r: (r.path, r.t)
    a = sorted(lpc.lpc_frames(signals, 5, 16, 8, native=True).collect(), key=key)
    b = sorted(lpc.lpc_frames(signals, 5, 16, 8, native=False).collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b]
    assert all(np.allclose(x.r, y.r) and x.status == y.status for x, y in zip(a, b))
    assert {r.status for r in a if "quiet" in r.path} == {1} and not any("short" in r.path for r in a)
    assert sum(r.path == "d/c0/0.wav" for r in a) == (50 - 16) // 8 + 1


def test_features_straight_from_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    for i, (rate, n) in enumerate([(16000, 20_000), (8000, 3_000), (16000, 100), (16000, 2_000)]):
        folder = tmp_path / f"c{i % 2}"
        folder.mkdir(exist_ok=True)
        (folder / f"{i}.wav").write_bytes(wav.encode(np.zeros(n) if i == 3 else rng.uniform(-1, 1, n), rate))
    (tmp_path / "c0" / "broken.wav").write_bytes(b"RIFF????WAVEfmt ")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    got = {(r.path, r.t): r for r in lpc.lpc_files(files, 12).collect()}
    want = {}
    for s in wav.read(spark, [str(tmp_path / "c0"), str(tmp_path / "c1")]).collect():
        width, step = lpc.window_of(s.sample_rate, 45, 15)
        one = spark.createDataFrame([(s.path, s.samples)], "path string, samples array<double>")
        want |= {(r.path, r.t): (s.class_name, s.sample_rate, r.r, r.status) for r in lpc.lpc_frames(one, 12, width, step, native=True).collect()}
    assert got.keys() == want.keys() and len({p for p, _ in got}) == 3 and {r.class_name for r in got.values()} == {"c0", "c1"}
    for k, (class_name, rate, r, status) in want.items():
        assert (got[k].class_name, got[k].sample_rate, got[k].status) == (class_name, rate, status) and np.allclose(got[k].r, r)
    with pytest.raises(Exception, match="WavError|struct.error|no samples"):
        lpc.lpc_files(files, 12, mode="FAILFAST").count()


@pytest.mark.parametrize("width", [257, 300, 720, 1440])
def test_wide_autocorrelation(width):
    t = np.arange(width)
    x = np.stack([np.random.default_rng(width).standard_normal(width), np.sin(0.3 * t), np.zeros(width), np.full(width, 1e-9)])
    direct = np.array([[np.dot(v[: width - k], v[k:]) for k in range(37)] for v in x])
    got = kernels.autocorrelation(x, 36)
    assert np.allclose(got, direct, rtol=1e-11, atol=1e-12 * np.abs(direct[:, :1])) and not got[2].any()


def test_split(signals):
    out = lpc.split_train_test(signals, 0.5, min_per_class=1).groupBy("class_name", "split").count().collect()
    n = {(r.class_name, r.split): r["count"] for r in out}
    assert n == {("c0", "TRAIN"): 3, ("c0", "TEST"): 2, ("c1", "TRAIN"): 2, ("c1", "TEST"): 1}  # one more than int(0.5 n)
    assert lpc.split_train_test(signals, 0.5, min_per_class=4).select("class_name").distinct().count() == 1
    assert lpc.split_train_test(signals, 0.0).select("split").distinct().first()[0] == "predictors"


GOLDEN = [(2, 3, 0.111357, 0.432498, 619.175661, 0), (4, 3, 0.102325, 0.642790, 605.245812, 0), (8, 4, 0.084152, 1.151581, 587.984906, 0), (16, 4, 0.069092, 1.796405, 570.669914, 0)]


@pytest.mark.parametrize("native", [True, False])
def test_codebook_training_golden(spark, native):
    seen = []
    out = list(vq.learn_codebook(catalogue.features(spark, SF), 8, eps=0.05, max_size=16, native=native, callback=lambda *x: seen.append(x)))
    for got, want in zip(out, GOLDEN, strict=True):
        assert (got.size, got.passes, got.empty) == (want[0], want[1], want[5])
        assert np.allclose((got.avg_distortion, got.sigma, got.inertia), want[2:5], atol=2e-6)
    assert [s[0] for s in seen] == [2, 4, 8, 16]


def test_ties_and_empty_cells(spark):
    book = vq.Codebook.of(np.array([[0, 0.5, 0], [0, 0.5, 0], [0, 0.9, 0]]))
    frames = spark.createDataFrame([(0, [1.0, -0.4, 0.1]), (1, [1.0, -0.3, 0.2])], "vec_id int, r array<double>")
    for native in (True, False):
        assert {r.near.i for r in vq.assigned(frames, book, native=native).collect()} == {0}
    report = {r["index"]: (r.cardinality, r.distortion) for r in vq.cell_report(frames, book).collect()}
    assert report[0][0] == 2 and report[1][0] == 0 and np.isnan(report[1][1])
    assert sorted(r.codeword for r in vq.unused(frames, book).collect()) == [1, 2]
    new, _ = vq.centroids(book, vq.cells(frames, book).collect())
    assert np.allclose(new.rc[1:], book.rc[1:]) and not np.allclose(new.rc[0], book.rc[0])
    with pytest.raises(ValueError):
        vq.grow(book, 4)


def test_vq_classification_ranks(spark):
    books = [vq.Codebook.of(np.array([[0, v, 0], [0, -v, 0]])) for v in (0.1, 0.1, 0.7)]
    frames = spark.createDataFrame([("s", [1.0, -0.1, 0.0])], "seq string, r array<double>")
    rank = {r.model_id: r["rank"] for r in vq.classify(frames, books, ["seq"]).collect()}
    assert rank == {1: 1, 0: 2, 2: 3}  # equal scores: the higher model first
    with pytest.raises(ValueError):
        vq.classify(frames, [books[0], vq.Codebook.of(np.zeros((1, 3)))], ["seq"])


ENDPOINTS = {"click": (9, 3152, 15760, 290, 1470), "error": (9, 2918, 14590, 300, 1470), "purchase": (9, 3611, 18055, 290, 1440), "signup": (9, 3262, 16310, 290, 1480), "view": (9, 2897, 14485, 290, 1450)}


def test_endpoints_golden(spark):
    got = {r.path: (r.izct, r.itl, r.itu, r.start, r.length) for r in endpoint.endpoints(fixtures.typed_signals(spark, SF)).collect()}
    assert got == ENDPOINTS


def test_endpoint_refinement_and_misses(spark):
    quiet = [5.0 * (-1) ** (n // 5) for n in range(300)]
    hiss = [60.0 * (-1) ** n for n in range(100)]
    loud = [9000.0 * np.sin(n / 3) for n in range(400)]
    s = spark.createDataFrame([("a", 1000.0, [float(x) for x in quiet + hiss + loud + quiet]), ("none", 1000.0, [1.0] * 900), ("short", 1000.0, [1.0] * 100)], "path string, sample_rate double, samples array<double>")
    got = {r.path: r for r in endpoint.endpoints(s).collect()}
    assert set(got) == {"a"}
    assert got["a"].start <= 310 and got["a"].start + got["a"].length >= 700  # the hiss before the utterance belongs to it
    cut = endpoint.trimmed(s).first()
    assert len(cut.samples) == cut.length and cut.out_name == f"a__S{cut.start}_L{cut.length}$.wav"


def test_strings(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    cls = lambda p: value(hof.class_of_path(F.lit(p)))
    assert [cls(p) for p in ("a/bar/x.wav", "bar/x.wav", "/bar/x.wav", "x")] == ["bar", "", "bar", ""]
    assert value(hof.change_extension(F.lit("a.b/c"), ".prd")) == "a.prd" and value(hof.change_extension(F.lit("ab"), ".prd")) == "ab" and value(hof.change_extension(F.lit("a.b"), ".x")) == "a.b.x"
    assert value(hof.output_path(F.lit("x.wav"), "base", ".seq")) == "data/base/_/x.seq"
    assert value(hof.selection_number(F.lit("d/c/00012.seq"))) == 12 and value(hof.selection_number(F.lit("d/c/x.seq"))) == -1
    ms = lambda t: value(hof.duration_ms(F.lit(t)))
    assert [ms(t) for t in ("1h57m39.828s", "2m", "", "abc", "7")] == [7059828, 120000, None, None, None]
    assert value(hof.abbreviated(F.array(*map(F.lit, range(50))))).count("...") == 1
    assert value(hof.rank_color(F.lit(9))) == "brown"


def test_spectra(spark):
    frames = {r.vec_id: r.frame for r in fixtures.embedding_frames(spark, SF).where("vec_id < 5").collect()}
    got = catalogue.queries()["frame_spectrum"](spark, SF).where("vec_id < 5").collect()
    for r in got:
        assert r.db == pytest.approx(20 * np.log10(abs(np.fft.rfft(frames[r.vec_id])[r.bin])), abs=1e-5)
    predictors = {r.vec_id: r.a for r in catalogue.features(spark, SF).where("vec_id < 5").select("vec_id", "lp.a").collect()}
    for r in catalogue.queries()["lpc_envelope"](spark, SF).where("vec_id < 5").collect():
        z = np.exp(-2j * np.pi * r.bin / 16 * np.arange(9))
        assert r.db == pytest.approx(-20 * np.log10(abs(np.dot(predictors[r.vec_id], z))), abs=1e-5)


def test_more_strings(spark):
    rows = spark.createDataFrame([("a/TRAIN/x.seq",), ("TRAIN.seq",), ("b/MYTEST/x",), ("TEST",)], "p string")
    got = rows.select(vq.routed(F.col("p")).alias("r"), hof.has_suffix(F.col("p"), ".seq").alias("s"), hof.fixed_width(F.col("p"), 6).alias("w")).collect()
    assert [r.r for r in got] == ["TRAIN", "", "TEST", ""] and [r.s for r in got] == [True, True, False, False]
    assert [r.w for r in got] == ["a/TRA\0", "TRAIN\0", "b/MYT\0", "TEST\0_"]
    assert hof.sequence_dir("data/sequences/TRAIN", 512) == "data/sequences/TRAIN/M512" and vq.codebook_name(0.0005, 64) == "eps_0.0005_M_0064.cbook"


def test_selections_of_rows(spark):
    from wavelark.operators import selection

    rows = spark.createDataFrame([(s, s * 1.0, s + 0.5, s % 3) for s in (-1, 0, 1, 2, 3, 4)], "selection int, begin_s double, end_s double, codeword int")
    assert [r.selection for r in selection.numbered(rows).orderBy("selection").collect()] == [1, 2, 3, 4]
    assert [r.selection for r in selection.contained(rows, 1.0, 3.5).orderBy("selection").collect()] == [1, 2, 3]
    assert selection.sample_rows(rows, 4, 1).count() == 4 and selection.sample_rows(rows, 99).count() == 6
    assert sorted(map(tuple, selection.sample_rows(rows, 4, 1).collect())) == sorted(map(tuple, selection.sample_rows(rows.repartition(3), 4, 1).collect()))
    assert selection.codebook_size(rows).first()[0] == 3 and sorted(r[0] for r in selection.unique_codewords(rows).collect()) == [0, 1, 2]
    frames = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 3)], "k int, idx int")
    marks = spark.createDataFrame([(1, 0.02, 0.05, "a"), (1, 0.021, 0.049, "b"), (1, 0.5, 0.4, "none"), (3, 0.0, 1.0, "c")], "k int, begin_s double, end_s double, mark string")
    got = sorted((r.mark, r.idx) for r in selection.frames_in_intervals(frames, marks, ["k"], 0.01).collect())
    assert got == [("a", 2), ("a", 3), ("a", 4), ("b", 3), ("b", 4)]


def test_framed_windows_and_spectrum(spark):
    """Framing, preprocessing and the spectrum in one plan."""
    from wavelark.functions import kernels
    from wavelark.operators import lpc

    x = np.sin(np.arange(200) / 3)
    d = lpc.frame_signals(spark.createDataFrame([(1, x.tolist())], "k int, samples array<double>"), 64, 32)
    out = kernels.with_spectrum(d.withColumn("y", lpc.preprocessed(F.col("frame"), 64)), "y", 64).orderBy("t").collect()
    assert len(out) == 1 + (200 - 64) // 32
    for r in out:
        f = x[32 * r.t : 32 * r.t + 64]
        f = f - f.mean()
        f = (f - 0.95 * np.concatenate([[0], f[:-1]])) * np.hamming(64)
        assert np.allclose(r.db, 20 * np.log10(np.maximum(np.abs(np.fft.rfft(f)), 1e-12)), atol=1e-6)
    assert spark.range(1).select(hof.hamming_window(1).alias("w")).first().w == pytest.approx([0.08])


def test_base_codebooks_unused_codewords_and_reports(spark):
    rng = np.random.default_rng(1)
    frames = np.abs(rng.standard_normal((60, 3))) * 0.1
    frames[:, 0] = 1
    d = spark.createDataFrame([(i, str(i % 2), r.tolist()) for i, r in enumerate(frames)], "seq int, class_name string, r array<double>")
    books = [b.book for b in vq.learn_codebook(d, 2, eps=0.1, max_size=4)]
    assert [len(b) for b in books] == [2, 4]
    more = list(vq.learn_codebook(d, 2, eps=0.1, base=books[0], max_size=4))
    assert [len(t.book) for t in more] == [4] and np.allclose(more[0].book.rc, books[1].rc)
    far = vq.Codebook.of(np.vstack([books[0].rc, [[0, -0.999, 0.0]]]))
    used = {r.codeword for r in vq.cells(d, far).collect()}
    assert {r.codeword for r in vq.unused(d, far).collect()} == {0, 1, 2} - used
    named = [vq.Codebook(b.rc, b.raa, c) for b, c in zip((books[0], vq.grow(vq.initial_codebook(2))), "01")]
    named[1] = vq.Codebook.of(named[1].rc[:2], "1")
    cases = vq.classified(vq.classify(d, named, ["seq", "class_name"]), named, ["seq"]).collect()
    assert len(cases) == 60 and all(c.correct == (c.predicted == c.actual) == (c.rank == 1) and sorted(c.ranked) == ["0", "1"] for c in cases)
