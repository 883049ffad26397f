"""Vector quantization: assignment, codebook training, quality measures, classification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelark.functions import hof, kernels

#: Growth factors, single-precision constants widened to double.
GROW = (float(np.float32(0.99)), float(np.float32(1.01)))
MAX_CODEWORDS = 4096
#: Codebooks larger than this, or longer vectors, are assigned through Arrow and a matrix product.
NATIVE_CODEWORDS, NATIVE_ORDER = 16, 16


@dataclass
class Codebook:
    """Reflections and their predictors' autocorrelations, a row a codeword. Small: at most MAX_CODEWORDS rows."""

    rc: np.ndarray
    raa: np.ndarray
    class_name: str = ""

    @classmethod
    def of(cls, rc: np.ndarray, class_name: str = "") -> Codebook:
        rc = np.asarray(rc, float)
        return cls(rc, kernels.reflections_to_raa(rc), class_name)

    def __len__(self) -> int:
        return len(self.rc)

    def to_frame(self, spark) -> DataFrame:  # noqa: ANN001
        rows = [(i, [float(x) for x in rc], [float(x) for x in raa]) for i, (rc, raa) in enumerate(zip(self.rc, self.raa))]
        return spark.createDataFrame(rows, "codeword int, rc array<double>, raa array<double>")


def initial_codebook(order: int) -> Codebook:
    rc = np.zeros((2, order + 1))
    rc[:, 1] = (-0.5, 0.5)
    return Codebook.of(rc)


def grow(book: Codebook, most: int = MAX_CODEWORDS) -> Codebook:
    """Each codeword becomes two, just below and just above it."""
    if 2 * len(book) > most:
        raise ValueError(f"a codebook has {most} codewords at most")
    return Codebook.of(np.stack([book.rc * GROW[0], book.rc * GROW[1]], axis=1).reshape(2 * len(book), -1), book.class_name)


def assigned(frames: DataFrame, book: Codebook, r_col: str = "r", native: bool | None = None) -> DataFrame:
    """Adds near: struct(d, i), the least distortion and its codeword (the lowest on ties)."""
    if native if native is not None else len(book) <= NATIVE_CODEWORDS and book.rc.shape[1] <= NATIVE_ORDER:
        return frames.withColumn("near", hof.nearest_codeword(F.col(r_col), hof.matrix(book.raa)))
    return frames.withColumn("near", kernels.nearest_codeword(book.raa)(F.col(r_col)))


def quantize(frames: DataFrame, book: Codebook, keys: list[str], t_col: str = "t", r_col: str = "r") -> DataFrame:
    """One row per sequence: keys, symbols in the order of t, avg_distortion (mean of d - 1)."""
    near = assigned(frames, book, r_col)
    return near.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(t_col).alias("t"), F.col("near.i").alias("i")))), lambda x: x["i"]).alias("symbols"), F.avg(F.col("near.d") - 1).alias("avg_distortion"))


def overall_distortion(sequences: DataFrame) -> DataFrame:
    """The mean of the sequences' means."""
    return sequences.agg(F.avg("avg_distortion").alias("avg_distortion"))


def routed(path: Column) -> Column:
    """TRAIN or TEST by a folder of the path (the name may end with it), else empty."""
    return F.when(path.contains("TRAIN/"), "TRAIN").when(path.contains("TEST/"), "TEST").otherwise("")


def cells(frames: DataFrame, book: Codebook, r_col: str = "r", native: bool | None = None) -> DataFrame:
    """codeword, cardinality, distortion (sum of d - 1), sums (the cell's added vectors); used codewords only. One shuffle of partial sums."""
    size = book.raa.shape[1]
    near = assigned(frames, book, r_col, native).select(F.col("near.i").alias("codeword"), F.col("near.d").alias("d"), F.col(r_col).alias("v"))
    sums = [F.sum(hof.at(F.col("v"), n)).alias(f"s{n}") for n in range(size)]
    out = near.groupBy("codeword").agg(F.count("*").alias("cardinality"), F.sum(F.col("d") - 1).alias("distortion"), *sums)
    return out.select("codeword", "cardinality", "distortion", F.array(*[f"s{n}" for n in range(size)]).alias("sums"))


def cell_report(frames: DataFrame, book: Codebook, r_col: str = "r") -> DataFrame:
    """index, cardinality, distortion (mean; NaN for an empty cell) of every codeword."""
    grid = frames.sparkSession.range(len(book)).select(F.col("id").cast("int").alias("codeword"))
    found = cells(frames, book, r_col)
    return grid.join(F.broadcast(found), "codeword", "left").select(F.col("codeword").alias("index"), F.coalesce("cardinality", F.lit(0)).alias("cardinality"), F.coalesce(F.col("distortion") / F.col("cardinality"), F.lit(float("nan"))).alias("distortion"))


def unused(frames: DataFrame, book: Codebook, r_col: str = "r") -> DataFrame:
    """Codewords without a vector."""
    grid = frames.sparkSession.range(len(book)).select(F.col("id").cast("int").alias("codeword"))
    return grid.join(cells(frames, book, r_col).select("codeword"), "codeword", "left_anti")


def min_distances(frames: DataFrame, book: Codebook, keys: list[str], r_col: str = "r") -> DataFrame:
    return assigned(frames, book, r_col).select(*keys, F.col("near.i").alias("codeword"), (F.col("near.d") - 1).alias("min_distortion"))


def centroids(book: Codebook, cell_rows: list) -> tuple[Codebook, np.ndarray]:
    """The codebook after one pass, and the cells' gain-normalised sums. Empty cells keep their codeword."""
    rc, sums = book.rc.copy(), np.zeros_like(book.raa)
    for row in cell_rows:
        new, _, pe, status = kernels.levinson(np.array([row["sums"]]))
        if status[0] != 1:
            rc[row["codeword"]] = new[0]
            sums[row["codeword"]] = np.array(row["sums"]) / pe[0]
    return Codebook.of(rc, book.class_name), sums


def sigma_ratio(cell_sums: np.ndarray, book: Codebook, avg_distortion: float) -> float:
    """Mean distortion of cells under the other codewords, over the average distortion."""
    d = kernels.distortions(cell_sums, book.raa) - 1
    np.fill_diagonal(d, 0.0)
    m = len(book)
    return float(d.sum() / (m * (m - 1)) / avg_distortion)


def inertia(frames: DataFrame, book: Codebook, r_col: str = "r") -> DataFrame:
    near = assigned(frames, book, r_col)
    return near.agg(F.sum(F.col("near.d") * F.col("near.d")).alias("inertia"))


@dataclass
class Trained:
    """A finished codebook size: average distortion (of the codebook before its last update), sigma ratio, inertia, empty cells."""

    book: Codebook
    size: int
    passes: int
    avg_distortion: float
    sigma: float
    inertia: float
    empty: int


def learn_codebook(frames: DataFrame, order: int, eps: float = 0.05, base: Codebook | None = None, max_size: int = MAX_CODEWORDS, r_col: str = "r", callback=None, native: bool | None = None) -> Iterator[Trained]:  # noqa: ANN001
    """Codebooks of doubling size. Each pass over the frames is one job that returns a row a codeword; only those reach the driver."""
    book = grow(base, max_size) if base else initial_codebook(order)
    kept = frames.select(r_col).persist()
    try:
        total = kept.count()
        while total:
            passes, before = 0, None
            while True:
                rows = cells(kept, book, r_col, native).collect()
                avg = sum(r["distortion"] for r in rows) / total
                book, sums = centroids(book, rows)
                passes += 1
                if before is not None and (avg == 0 or (before - avg) / avg < eps):
                    break
                before = avg
            done = Trained(book, len(book), passes, avg, sigma_ratio(sums, book, avg) if avg else float("nan"), inertia(kept, book, r_col).first()[0], len(book) - len(rows))
            if callback:
                callback(done.size, done.avg_distortion, done.sigma, done.inertia)
            yield done
            if 2 * len(book) > max_size:
                return
            book = grow(book, max_size)
    finally:
        kept.unpersist()


def training_report(spark, results: list[Trained]) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame([(r.size, r.passes, r.avg_distortion, r.sigma, r.inertia) for r in results], "M int, passes int, avg_distortion double, sigma double, inertia double")


def classify(frames: DataFrame, books: list[Codebook], keys: list[str], r_col: str = "r") -> DataFrame:
    """Average distortion of each sequence under each codebook, with its rank: keys, model_id, score, rank.

    Ranks are by score; on equal scores the higher model comes first. All codebooks are scored in one pass over the frames.
    """
    if len({b.raa.shape for b in books}) > 1:
        raise ValueError("codebooks must agree in size and order")
    if len(books) * len(books[0]) <= NATIVE_CODEWORDS and books[0].rc.shape[1] <= NATIVE_ORDER:
        best = [hof.nearest_codeword(F.col(r_col), hof.matrix(b.raa))["d"] - 1 for b in books]
        scored = frames.select(*keys, *[d.alias(f"_m{i}") for i, d in enumerate(best)])
    else:
        scored = frames
        for i, b in enumerate(books):
            scored = scored.withColumn(f"_m{i}", kernels.nearest_codeword(b.raa)(F.col(r_col))["d"] - 1)
    means = scored.groupBy(*keys).agg(*[F.avg(f"_m{i}").alias(f"_m{i}") for i in range(len(books))])
    long = means.select(*keys, F.posexplode(F.array(*[f"_m{i}" for i in range(len(books))])).alias("model_id", "score"))
    return long.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("score", F.desc("model_id"))))


def classified(scored: DataFrame, books: list[Codebook], keys: list[str], class_col: str = "class_name") -> DataFrame:
    """What classify() gives, with the sequences' classes, as cases for evaluation: keys, actual, predicted, correct, rank, ranked.

    Sequences of a class without a codebook are left out; of several codebooks of a class the first stands for it.
    """
    home: dict[str, int] = {}
    for i, b in enumerate(books):
        home.setdefault(b.class_name, i)
    names = F.array(*[F.lit(b.class_name) for b in books])
    order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "model_id"))), lambda x: x["model_id"])
    one = scored.groupBy(*keys, class_col).agg(order.alias("_ids")).withColumn("_home", F.try_element_at(F.create_map(*[x for k, v in home.items() for x in (F.lit(k), F.lit(v))]), F.col(class_col))).where("_home is not null")
    place = F.array_position("_ids", F.col("_home"))
    return one.select(*keys, F.col(class_col).alias("actual"), hof.at(names, hof.at(F.col("_ids"), 0)).alias("predicted"), (place == 1).alias("correct"), place.cast("int").alias("rank"), F.transform("_ids", lambda i: hof.at(names, i)).alias("ranked"))


def show_codebook(spark, book: Codebook, first: int, last: int) -> DataFrame:  # noqa: ANN001
    """Reflections first..last of each codeword as shortest text; index 0 is not a coefficient and is left out."""
    first = max(first, 1)
    rows = [(i, *(f"{v:g}" for v in rc[first : last + 1])) for i, rc in enumerate(book.rc.tolist())]
    return spark.createDataFrame(rows, "codeword int, " + ", ".join(f"k{i}" + " string" for i in range(first, min(last, book.rc.shape[1] - 1) + 1)))


def codebook_name(eps: float, size: int) -> str:
    return f"eps_{eps:g}_M_{size:04d}.cbook"
