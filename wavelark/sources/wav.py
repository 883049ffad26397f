"""WAV audio: RIFF and Sony Wave64 containers, PCM, IEEE float, A-law, mu-law, Microsoft and IMA ADPCM; mono.

`register(spark)` adds the format `wav` (a row a file); `read` uses Spark's own file listing.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, class_name string, sample_rate double, num_samples int, samples array<double>"

# fixed values: format tags, and the Wave64 chunk identifiers' common tail
PCM, MS_ADPCM, FLOAT, A_LAW, MU_LAW, IMA_ADPCM, EXTENSIBLE = 0x1, 0x2, 0x3, 0x6, 0x7, 0x11, 0xFFFE
W64_RIFF = b"riff\x2e\x91\xcf\x11\xa5\xd6\x28\xdb\x04\xc1\x00\x00"
W64_TAIL = b"\xf3\xac\xd3\x11\x8c\xd1\x00\xc0\x4f\x8e\xdb\x8a"
# fixed values: the two ADPCM standards' tables
IMA_INDEX = [-1, -1, -1, -1, 2, 4, 6, 8]
MS_ADAPT = [230, 230, 230, 230, 307, 409, 512, 614, 768, 614, 512, 409, 307, 230, 230, 230]
MS_COEFFICIENTS = [(256, 0), (512, -256), (0, 0), (192, 64), (240, 0), (460, -208), (392, -232)]
# fixed values: IMA step sizes
IMA_STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]


class WavError(ValueError):
    pass


def chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Four-letter name and body of each chunk."""
    if raw[:4] == b"RIFF" and raw[8:12] == b"WAVE":
        at = 12
        while at + 8 <= len(raw):
            size = struct.unpack_from("<I", raw, at + 4)[0]
            yield raw[at : at + 4], raw[at + 8 : at + 8 + size]
            at += 8 + size + size % 2
    elif raw[:16] == W64_RIFF:
        at = 40
        while at + 24 <= len(raw):
            size = struct.unpack_from("<Q", raw, at + 16)[0]
            if size < 24:
                return
            yield (raw[at : at + 4] if raw[at + 4 : at + 16] == W64_TAIL else b"?"), raw[at + 24 : at + size]
            at += size + -size % 8
    else:
        raise WavError("not a WAV file")


def _pcm(data: bytes, size: int) -> np.ndarray:
    n = len(data) // size
    if size == 1:
        return np.frombuffer(data, np.uint8, n) / 255.0 * 2 - 1
    if size in (2, 4):
        return np.frombuffer(data, f"<i{size}", n) / 2.0 ** (8 * size - 1)
    raw = np.frombuffer(data, np.uint8, n * size).reshape(n, size)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, 8 - size :] = raw[:, :8] if size <= 8 else raw[:, -8:]
    return wide.view("<i8").ravel() / 2.0**63


def _a_law(data: bytes) -> np.ndarray:
    v = np.frombuffer(data, np.uint8).astype(int) ^ 0x55
    exponent, mantissa = (v >> 4) & 7, v & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(v & 0x80, size, -size) / 32768.0


def _mu_law(data: bytes) -> np.ndarray:
    v = ~np.frombuffer(data, np.uint8).astype(int) & 0xFF
    size = ((((v & 15) << 3) + 0x84) << ((v >> 4) & 7)) - 0x84
    return np.where(v & 0x80, -size, size) / 32768.0


def _ima(data: bytes, block: int) -> np.ndarray:
    out: list[int] = []
    for a in range(0, len(data) - 3, block):
        part = data[a : a + block]
        value, index = struct.unpack_from("<hB", part)
        index = min(index, 88)
        out.append(value)
        for byte in part[4:]:
            for code in (byte & 15, byte >> 4):
                step = IMA_STEPS[index]
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + IMA_INDEX[code & 7]))
                out.append(value)
    return np.array(out) / 32768.0


def _ms(data: bytes, block: int) -> np.ndarray:
    out: list[int] = []
    for a in range(0, len(data) - 6, block):
        part = data[a : a + block]
        kind, delta, newer, older = struct.unpack_from("<Bhhh", part)
        c1, c2 = MS_COEFFICIENTS[min(kind, 6)]
        out += [older, newer]
        for byte in part[7:]:
            for code in (byte >> 4, byte & 15):
                signed = code - 16 if code & 8 else code
                value = max(-32768, min(32767, (newer * c1 + older * c2) // 256 + signed * delta))
                older, newer = newer, value
                delta = max(16, MS_ADAPT[code] * delta // 256)
                out.append(value)
    return np.array(out) / 32768.0


def _length(tag: int, size: int, block: int, bits: int) -> int:
    """How many samples so many bytes hold."""
    if tag == IMA_ADPCM:
        return sum(1 + 2 * max(0, min(block, size - a) - 4) for a in range(0, size - 3, block))
    if tag == MS_ADPCM:
        return sum(2 + 2 * max(0, min(block, size - a) - 7) for a in range(0, size - 6, block))
    return size // max(1, 1 if tag in (A_LAW, MU_LAW) else bits // 8 if tag == FLOAT and bits in (32, 64) else block or bits // 8)


def decode(raw: bytes, header_only: bool = False) -> tuple[float, np.ndarray]:
    """Sample rate and samples in [-1, 1]; header_only: an array that only has their number."""
    form, facts = None, None
    for name, body in chunks(raw):
        if name == b"fmt ":
            tag, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", body)
            if tag == EXTENSIBLE and len(body) >= 26:
                tag = struct.unpack_from("<H", body, 24)[0]
            form = tag, channels, rate, block, bits
        elif name == b"fact" and len(body) >= 4:
            facts = struct.unpack_from("<I", body)[0]
        elif name == b"data":
            if form is None:
                break
            tag, channels, rate, block, bits = form
            if channels != 1:
                raise WavError("only mono signals")
            if tag in (MS_ADPCM, IMA_ADPCM) and block < {MS_ADPCM: 7, IMA_ADPCM: 4}[tag]:
                raise WavError(f"blocks of {block} bytes can't hold their head")
            if header_only:
                n = facts if facts is not None and tag in (MS_ADPCM, IMA_ADPCM) else _length(tag, len(body), block, bits)
                return float(rate), np.empty(n, np.void)
            if tag == PCM:
                x = _pcm(body, max(1, (block or bits // 8)))
            elif tag == FLOAT and bits in (32, 64):
                x = np.frombuffer(body[: len(body) // (bits // 8) * (bits // 8)], f"<f{bits // 8}").astype(float)
            elif tag == FLOAT:
                x = np.zeros(len(body) // max(1, block))
            elif tag == A_LAW:
                x = _a_law(body)
            elif tag == MU_LAW:
                x = _mu_law(body)
            elif tag in (MS_ADPCM, IMA_ADPCM):
                x = (_ms if tag == MS_ADPCM else _ima)(body, block)[:facts]
            else:
                raise WavError(f"format tag {tag} is not known")
            return float(rate), x
    raise WavError("no samples")


def encode(samples: np.ndarray, sample_rate: float) -> bytes:
    """RIFF, one channel, 32-bit IEEE float."""
    data = np.asarray(samples, "<f4").tobytes()
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, FLOAT, 1, int(sample_rate), int(sample_rate) * 4, 4, 32)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + len(data), b"WAVE") + form + struct.pack("<4sI", b"data", len(data)) + data


def write(signals: DataFrame, base: str) -> int:
    """Writes path, sample_rate and samples as files under base (see binary.write_files). Returns how many."""
    from wavelark.sources.binary import write_files

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "content": [encode(np.asarray(x), rate) for x, rate in zip(pdf["samples"], pdf["sample_rate"])]})

    return write_files(signals.select("path", "sample_rate", "samples").mapInPandas(run, "path string, content binary"), base)


def class_of(path: str) -> str:
    parts = path.split("/")
    return parts[-2] if len(parts) > 2 else ""


def read(spark: SparkSession, path: str | list[str], mode: str = "PERMISSIVE", header_only: bool = False) -> DataFrame:
    """Signals of WAV files. Files that can't be read are skipped (FAILFAST: raise). header_only leaves the samples null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"]):
                try:
                    rate, x = decode(bytes(raw), header_only)
                except (WavError, struct.error):
                    if mode == "FAILFAST":
                        raise
                    continue
                yield pd.DataFrame({"path": [p], "class_name": [class_of(p)], "sample_rate": [rate], "num_samples": [len(x)], "samples": [None if header_only else x.tolist()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


class WavSource(DataSource):
    """spark.read.format("wav").load(file or folder on a file system that all executors mount)."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _WavReader(self.options)


class _WavReader(DataSourceReader):
    def __init__(self, options) -> None:  # noqa: ANN001
        self.path, self.mode = options["path"], options.get("mode", "PERMISSIVE")

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "**", "*.wav"), recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [InputPartition(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            raw = f.read()
        try:
            rate, x = decode(raw)
        except (WavError, struct.error):
            if self.mode == "FAILFAST":
                raise
            return
        yield partition.value, class_of(partition.value), rate, len(x), x.tolist()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)
