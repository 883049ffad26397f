"""Files: round trips, every audio encoding, damaged input, tables, streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.operators import hmm, selection, vq
from wavelark.plans import fixtures
from wavelark.sources import binary, tables, wav
from wavelark.streaming import online


def riff(tag, bits, data, channels=1, block=None, extra=b"", tail=b""):
    form = struct.pack("<HHIIHH", tag, channels, 8000, 0, block or channels * bits // 8, bits) + extra
    body = b"WAVE" + b"JUNK" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(form)) + form + tail + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav_encodings():
    x = np.array([0, 1000, -1000, 32767, -32768])
    assert np.allclose(wav.decode(riff(1, 16, x.astype("<i2").tobytes()))[1], x / 32768)
    assert np.allclose(wav.decode(riff(1, 8, bytes([0, 128, 255])))[1], [-1, 128 / 255 * 2 - 1, 1])
    assert np.allclose(wav.decode(riff(1, 24, b"".join(int(v * 256).to_bytes(3, "little", signed=True) for v in x)))[1], x / 32768)
    assert np.allclose(wav.decode(riff(1, 32, (x * 65536).astype("<i4").tobytes()))[1], x / 32768)
    for bits in (32, 64):
        assert np.allclose(wav.decode(riff(3, bits, (x / 7).astype(f"<f{bits // 8}").tobytes()))[1], x / 7)
    extensible = riff(0xFFFE, 16, x.astype("<i2").tobytes(), extra=struct.pack("<HHIH", 22, 16, 0, 1) + bytes(14))
    assert np.allclose(wav.decode(extensible)[1], x / 32768)
    assert wav.decode(riff(7, 8, bytes([0xFF, 0x80, 0x00])))[1].tolist() == [0.0, 32124 / 32768, -32124 / 32768]
    assert wav.decode(riff(6, 8, bytes([0xD5, 0x55])))[1].tolist() == [8 / 32768, -8 / 32768]
    ima = struct.pack("<hBx", 100, 0) + bytes([0x07, 0x80])
    # steps 7, 16, 14, 13: +(0+7+3+1), +16/8, +14/8, -13/8
    assert (wav.decode(riff(0x11, 4, ima, block=6))[1] * 32768).tolist() == [100, 111, 113, 114, 113]
    ms = struct.pack("<Bhhh", 0, 16, 50, 40) + bytes([0x1F])
    assert (wav.decode(riff(2, 4, ms, block=8))[1] * 32768).tolist() == [40, 50, 66, 50]
    with pytest.raises(wav.WavError):
        wav.decode(riff(1, 16, bytes(8), channels=2))
    with pytest.raises(wav.WavError):
        wav.decode(b"no audio")


def test_wave64():
    guid = lambda name: name + wav.W64_TAIL
    chunk = lambda name, body: guid(name) + struct.pack("<Q", 24 + len(body)) + body + bytes(-len(body) % 8)
    form = struct.pack("<HHIIHH", 1, 1, 16000, 0, 2, 16)
    raw = wav.W64_RIFF + struct.pack("<Q", 0) + guid(b"wave") + chunk(b"fmt ", form) + chunk(b"data", np.array([1, 2], "<i2").tobytes())
    rate, x = wav.decode(raw)
    assert rate == 16000 and np.allclose(x * 32768, [1, 2])


def test_wav_read(spark, tmp_path):
    (tmp_path / "dogs").mkdir()
    x = np.linspace(-1, 1, 50)
    (tmp_path / "dogs" / "a.wav").write_bytes(wav.encode(x, 8000))
    (tmp_path / "dogs" / "bad.wav").write_bytes(b"RIFFxxxx")
    got = wav.read(spark, f"{tmp_path}/dogs/*.wav").collect()
    assert len(got) == 1 and got[0].class_name == "dogs" and got[0].sample_rate == 8000 and np.allclose(got[0].samples, x, atol=1e-7)
    assert wav.read(spark, f"{tmp_path}/dogs/*.wav", header_only=True).first().samples is None
    wav.register(spark)
    assert np.allclose(spark.read.format("wav").load(str(tmp_path)).first().samples, x, atol=1e-7)
    with pytest.raises(Exception):
        wav.read(spark, f"{tmp_path}/dogs/*.wav", mode="FAILFAST").collect()


@pytest.mark.parametrize("kind", ["prd", "cbook", "seq", "hmm"])
def test_round_trips(spark, tmp_path, kind):
    rng = np.random.default_rng(0)
    m = fixtures.MODELS[2]
    rows = {
        "prd": [("a/x.prd", "frogs", 3, t, [float(v) for v in rng.random(4)]) for t in range(5)],
        "cbook": [("a/x.cbook", "frogs", 3, t, [0.0, *(float(v) for v in rng.random(3))]) for t in range(4)],
        "seq": [("a/x.seq", "clasita", 4, [t % 4 for t in range(20)])],  # the classic self-test sequence
        "hmm": [("a/x.hmm", "frogs", m.pi.tolist(), m.trans.tolist(), m.emit.tolist())],
    }[kind]
    df = spark.createDataFrame(rows, binary.SCHEMAS[kind])
    assert binary.write(df, kind, f"file://{tmp_path}") == 1
    raw = (tmp_path / "a" / f"x.{kind}").read_bytes()
    assert raw[:16].rstrip(b"\0") == binary.IDENTS[kind] and raw[16:112].split(b"\0")[0] == rows[0][1].encode() and raw[111:112] == b"_"
    back = binary.read(spark, f"file://{tmp_path}/a/*", kind).drop("path").collect()
    assert sorted(map(tuple, back), key=repr) == sorted((tuple(r)[1:] for r in df.collect()), key=repr)
    (tmp_path / "a" / "broken").write_bytes(raw[:-3])
    assert binary.read(spark, f"file://{tmp_path}/a/*", kind).count() == len(rows)


def test_tables(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("# made by hand\nSelection\tView\tChannel\tBegin Time (s)\tEnd Time (s)\tLow Freq (Hz)\tHigh Freq (Hz)\tType\n7\tv\t1\t0.5\t1.25\t10\t20\tA\n")
    seg = tables.read_segments(spark, f"{tmp_path}/s.tsv")
    assert tuple(seg.first()) == (7, 0.5, 1.25, 10.0, 20.0, "A")
    cases = spark.createDataFrame([("d/A/7.seq", 1), ("d/A/8.seq", 2), ("d/A/x.seq", 3)], "seq_filename string, rank int")
    joined = {r["rank"]: (r.selection, r.begin_s) for r in selection.with_segments(cases, seg).collect()}
    assert joined == {1: (7, 0.5), 2: (8, None), 3: (-1, None)}
    tables.write_table(cases, f"{tmp_path}/out", ["rank"])
    assert tables.read_table(spark, f"{tmp_path}/out").count() == 3
    assert [r[0] for r in selection.expand_ranges(spark, ["9", "3-5"]).collect()] == [3, 4, 5, 9]


def test_streams(spark, tmp_path):
    m = fixtures.MODELS[0]
    for part in range(3):
        rows = [(k, part * 4 + t, (k + part + t) % 5) for k in range(2) for t in range(4)]
        spark.createDataFrame(rows, "key int, t int, o int").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema("key int, t int, o int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = online.online_log_likelihood(stream, m, "key", "t").writeStream.outputMode("update").format("memory").queryName("online").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    last = {r.key: r.lp for r in spark.sql("select key, max_by(lp, n) as lp from online group by key").collect()}
    batch = spark.read.parquet(f"{tmp_path}/in/*").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "o"))), lambda x: x["o"]).alias("symbols"))
    for r in batch.select("key", hmm.log_likelihood(m).alias("lp")).collect():
        assert last[r.key] == pytest.approx(r.lp)
    frames = spark.createDataFrame([([1.0, -0.4, 0.1],)], "r array<double>")
    assert online.quantized(frames, vq.initial_codebook(2)).first().codeword in (0, 1)


def test_damaged_wav_is_skipped(spark, tmp_path):
    good = wav.encode(np.array([0.0, 0.5, -0.5]), 8000)
    for name, raw in {"a": good, "b": riff(0x11, 4, bytes(8), block=0)[:20] + struct.pack("<HHIIHH", 0x11, 1, 8000, 0, 0, 4) + b"", "c": b"RIFF", "d": b""}.items():
        (tmp_path / f"{name}.wav").write_bytes(raw)
    ima = struct.pack("<HHIIHH", 0x11, 1, 8000, 0, 0, 4)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(ima)) + ima + b"data" + struct.pack("<I", 8) + bytes(8)
    (tmp_path / "e.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    with pytest.raises(wav.WavError):
        wav.decode((tmp_path / "e.wav").read_bytes())
    assert [r.num_samples for r in wav.read(spark, f"{tmp_path}/*.wav").collect()] == [3]


def test_header_only_tells_the_length():
    x = np.arange(40) % 7
    for raw in (riff(1, 16, x.astype("<i2").tobytes()), riff(3, 32, x.astype("<f4").tobytes()), riff(6, 8, bytes(40)), riff(0x11, 4, bytes(36), block=12), riff(2, 4, bytes(33), block=11), riff(0x11, 4, bytes(17), block=12), riff(2, 4, bytes(30), block=11)):
        assert len(wav.decode(raw, header_only=True)[1]) == len(wav.decode(raw)[1])


def test_wav_sink(spark, tmp_path):
    rows = [("k/one.wav", 8000.0, [0.0, 0.25, -1.0]), ("k/two.wav", 16000.0, [])]
    assert wav.write(spark.createDataFrame(rows, "path string, sample_rate double, samples array<double>"), str(tmp_path)) == 2
    got = {r.path.rsplit("/", 1)[1]: (r.sample_rate, r.samples, r.class_name) for r in wav.read(spark, f"{tmp_path}/k/*.wav").collect()}
    assert got == {"one.wav": (8000.0, [0.0, 0.25, -1.0], "k"), "two.wav": (16000.0, [], "k")}


def test_commented_report(spark, tmp_path):
    tables.write_commented(hmm.training_history(spark, [-5.0, -4.5]), str(tmp_path / "h.csv"), ["two steps"], ["I"])
    assert (tmp_path / "h.csv").read_text() == "# two steps\nI,sum_log_prob\n0,-5.0\n1,-4.5\n"
    assert tables.read_table(spark, str(tmp_path / "h.csv")).count() == 2
