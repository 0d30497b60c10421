"""Vector analytics: built-in higher-order functions for the arithmetic, numpy where a matrix is the point."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import text as T
from lumenloom.operators.skew import broadcast_small, small
from lumenloom.session import discard, materialize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, floor: float = 1e-8) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(floor)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-8))


def mean_pool(rows: Column, width: int) -> Column:
    """The mean of an array of vectors, padding included."""
    total = F.aggregate(rows, F.array_repeat(F.lit(0.0), width), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(rows), F.lit(1)))


def masked(rows: Column, mask: Column) -> Column:
    """The elements whose mask is true."""
    return F.transform(F.filter(F.arrays_zip(rows.alias("v"), mask.alias("m")), lambda z: z["m"]), lambda z: z["v"])


def centroids(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """``by..., centroid``: mean vector of each group, element-wise. Every batch of rows becomes one row of
    sums for each of its groups where it lies, so it is sums that are taken apart and shuffled, not vectors.
    Null vectors and null elements count nowhere; null groups are groups; no rows give no rows (a null
    centroid without ``by``)."""
    rows = df.select(*by, F.col(vector).cast("array<double>").alias("_v")).where("_v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(by))), strict=True)) if by else [()] * batch.num_rows
            first: dict[tuple, int] = {}
            for i, key in enumerate(keys):
                first.setdefault(key, i)
            number = {key: n for n, key in enumerate(first)}
            lists = batch.column(len(by))
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            owner = np.repeat(np.array([number[k] for k in keys]), sizes)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            width = int(sizes.max(initial=0))
            cell = owner * width + place
            sums = np.bincount(cell[there], flat.to_numpy(zero_copy_only=False)[there], len(first) * width).reshape(len(first), width)
            counts = np.bincount(cell[there], minlength=len(first) * width).reshape(len(first), width).astype(float)
            held = np.bincount(cell, minlength=len(first) * width).reshape(len(first), width).astype(float)
            at = pa.array(list(first.values()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(by))), pa.array(sums.tolist(), pa.list_(pa.float64())), pa.array(counts.tolist(), pa.list_(pa.float64())), pa.array(held.tolist(), pa.list_(pa.float64()))], names=[*by, "_sums", "_counts", "_held"])

    shape = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "_sums array<double>", "_counts array<double>", "_held array<double>"])
    each = rows.mapInArrow(run, shape).select(*by, F.posexplode(F.arrays_zip("_sums", "_counts", "_held")).alias("_pos", "_x")).where("_x._held > 0")
    long = each.groupBy(*by, "_pos").agg((F.sum("_x._sums") / F.nullif(F.sum("_x._counts"), F.lit(0.0))).alias("_mean"))
    whole = long.groupBy(*by) if by else long.groupBy()
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_mean"))), lambda s: s["_mean"]).alias("centroid"))


def scored(df: DataFrame, vector: str, labels: DataFrame) -> DataFrame:
    """``df`` with ``scores``: the dot product with every label's centroid, as structs (score, -ord). The
    labels (ord, centroid) are a taxonomy's axis, some tens of rows: they are put into one row, so scoring
    is a projection and no vector is shuffled."""
    table = labels.agg(F.collect_list(F.struct("ord", "centroid")).alias("_labels"))
    pairs = F.transform(small(F.col("_labels"), "labels"), lambda c: F.struct(dot(F.col(vector), c["centroid"]).alias("score"), (-c["ord"]).alias("back")))
    return df.crossJoin(F.broadcast(table)).withColumn("scores", pairs).drop("_labels")


def nearest(df: DataFrame, vector: str, labels: DataFrame) -> DataFrame:
    """Each row with the ``ord`` of the label of the largest dot product, the first of equals, and that ``score``."""
    best = F.array_max("scores")
    return scored(df, vector, labels).select(*df.columns, (-best["back"]).alias("best"), best["score"].alias("score"))


def covariance(df: DataFrame, vector: str, width: int) -> DataFrame:
    """``(i, j, cov)``: the sample covariance of the vector's elements; one matrix a task, merged in one.

    Each task reduces its rows to counts, sums and outer products, so what is shuffled has the size of the
    matrix, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = np.stack(batch.column(0).to_pylist()).astype(float) if batch.num_rows else np.empty((0, width))
            n, total, outer = n + len(x), total + x.sum(0), outer + x.T @ x
        i, j = np.indices((width, width))
        yield pa.RecordBatch.from_pydict({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "n": np.full(width * width, n), "si": total[i.ravel()], "sj": total[j.ravel()], "p": outer.ravel()})

    parts = df.select(vector).where(F.col(vector).isNotNull()).mapInArrow(run, "i int, j int, n bigint, si double, sj double, p double")
    n = F.sum("n")
    return parts.groupBy("i", "j").agg(((F.sum("p") - F.sum("si") * F.sum("sj") / n) / (n - 1)).alias("cov"))


def poly_mmd(df: DataFrame, vector: str, side: Column, subset: Column, width: int, degree: int = 3) -> DataFrame:
    """``(subset, mmd)``: unbiased polynomial-kernel discrepancy of the two sides of each subset of rows.

    (x.y / width + 1)^degree summed over all pairs is a weighted sum of the inner products of both sides'
    moments up to the degree, so each task adds up moments (width^degree numbers at most for each subset
    and side) and no pair of rows ever meets: the work grows with the rows, whatever a subset holds. Null
    vectors are left out; a side of fewer than two rows gives a null.
    """
    sizes = [width**j for j in range(degree + 1)]
    starts = np.cumsum([0, *sizes])
    cells = int(starts[-1]) + 1  # the last one: the pairs of a row with itself

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(0).to_pylist()).astype(float)
            sides, subsets = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            keys = list(zip(subsets, sides.tolist(), strict=True))
            for key in set(keys):
                mine = x[[k == key for k in keys]]
                total = sums.setdefault(key, np.zeros(cells))
                for at in range(0, len(mine), 512):
                    power = part = mine[at : at + 512]
                    total[0] += len(part)
                    for j in range(1, degree + 1):
                        if j == degree > 1:  # the highest moment as one product of matrices
                            total[starts[j] : starts[j + 1]] += (power.T @ part).ravel()
                        else:
                            total[starts[j] : starts[j + 1]] += power.sum(0)
                            power = (power[:, :, None] * part[:, None, :]).reshape(len(part), -1) if j + 1 < degree else power
                    total[-1] += (((part**2).sum(1) / width + 1) ** degree).sum()
        for (subset, first), total in sums.items():
            for chunk in range(0, cells, MOMENT_CHUNK):
                values = total[chunk : chunk + MOMENT_CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array([subset], pa.int32()), pa.array([first]), pa.array([chunk]), pa.array([values.tobytes()], pa.binary())], names=["subset", "side", "chunk", "sums"])

    def merged(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in part.column("sums").to_pylist())
        return pa.table({"subset": part.column("subset")[:1], "side": part.column("side")[:1], "chunk": part.column("chunk")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    def distance(part: pd.DataFrame) -> pd.DataFrame:
        sums = {}
        for first, mine in part.sort_values("chunk").groupby("side"):
            sums[bool(first)] = np.concatenate([np.frombuffer(b) for b in mine["sums"]])
        subset = part["subset"].iloc[:1]
        if len(sums) < 2 or min(s[0] for s in sums.values()) < 2:
            return pd.DataFrame({"subset": subset, "mmd": [None]})

        def all_pairs(a: np.ndarray, b: np.ndarray) -> float:
            return sum(comb(degree, j) / width**j * float(a[starts[j] : starts[j + 1]] @ b[starts[j] : starts[j + 1]]) for j in range(degree + 1))

        own = lambda a: (all_pairs(a, a) - a[-1]) / (a[0] * (a[0] - 1))
        a, b = sums[True], sums[False]
        return pd.DataFrame({"subset": subset, "mmd": [own(a) + own(b) - 2 * all_pairs(a, b) / (a[0] * b[0])]})

    shape = "subset int, side boolean, chunk bigint, sums binary"
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"), F.coalesce(side, F.lit(False)).alias("side"), subset.cast("int").alias("subset"))
    together = rows.mapInArrow(moments, shape).groupBy("subset", "side", "chunk").applyInArrow(merged, shape)
    return together.groupBy("subset").applyInPandas(distance, "subset int, mmd double")


#: Numbers of a moment that travel together.
MOMENT_CHUNK = 1 << 14


def subset_mmd(df: DataFrame, id_col: str, vector: str, side: Column, width: int, subsets: int = 100, size: int = 100, degree: int = 3) -> DataFrame:
    """``(subset, mmd)`` of ``subsets`` drawn subsets, each of min(size, rows) rows a side in a hash order of
    its own. Rows are sieved by their hash where they lie (four times as many as needed pass); what meets
    in a task is a subset, 2 * size rows at most."""
    sided = df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.coalesce(side, F.lit(False)).alias("side"))
    counts = {r["side"]: r["n"] for r in sided.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("side"), min(1.0, 4 * size / max(counts.get(True, 0), 1))).otherwise(min(1.0, 4 * size / max(counts.get(False, 0), 1)))
    order = lambda s: F.md5(F.concat(F.col("id").cast("string"), F.lit(":"), s.cast("string")))
    first = lambda s: F.conv(F.substring(order(s), 1, 7), 16, 10).cast("bigint") / F.lit(268435456.0)
    passed = F.filter(F.sequence(F.lit(0), F.lit(subsets - 1)), lambda s: first(s) <= share)
    drawn = sided.select("*", F.explode(passed).alias("subset"))
    window = Window.partitionBy("side", "subset").orderBy(order(F.col("subset")), "id")
    kept = drawn.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= size)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        v, one = np.stack(part["v"].to_numpy()).astype(float), part["side"].to_numpy(bool)
        a, b = v[one], v[~one]
        if len(a) < 2 or len(b) < 2:
            return pd.DataFrame({"subset": part["subset"].iloc[:1], "mmd": [None]})
        k = lambda x, y: (x @ y.T / width + 1) ** degree
        own = lambda x: (k(x, x).sum() - np.trace(k(x, x))) / (len(x) * (len(x) - 1))
        return pd.DataFrame({"subset": part["subset"].iloc[:1], "mmd": [own(a) + own(b) - 2 * k(a, b).mean()]})

    return kept.groupBy("subset").applyInPandas(run, "subset int, mmd double")


def frechet(mu_a: np.ndarray, cov_a: np.ndarray, mu_b: np.ndarray, cov_b: np.ndarray) -> float:
    """The Fréchet distance of two Gaussians, the matrix root by eigenvalues."""
    w, q = np.linalg.eigh(cov_a)
    root = (q * np.sqrt(np.clip(w, 0, None))) @ q.T
    cross = np.linalg.eigvalsh(root @ cov_b @ root)
    return float(((mu_a - mu_b) ** 2).sum() + np.trace(cov_a) + np.trace(cov_b) - 2 * np.sqrt(np.clip(cross, 0, None)).sum())


def frechet_distance(df: DataFrame, vector: str, side: Column, width: int) -> DataFrame:
    """``(frechet)`` between the rows of the two sides: their moments are aggregated in Spark, one pair of
    matrices of fixed size reaches the driver."""
    moments = {}
    for name, mine in (("a", df.where(side)), ("b", df.where(~side))):
        cov = covariance(mine, vector, width).toPandas()
        mean = centroids(mine, vector, []).collect()[0]["centroid"]
        m = np.zeros((width, width))
        m[cov["i"], cov["j"]] = cov["cov"]
        moments[name] = (np.array(mean), m)
    return df.sparkSession.createDataFrame([(frechet(*moments["a"], *moments["b"]),)], "frechet double")


#: Rows of a cluster's block; a larger cluster is cut into a grid of blocks.
CLUSTER_BLOCK = 4096


def cluster_pairs(df: DataFrame, id_col: str, cluster: str, vector: str, above: float) -> DataFrame:
    """``(id_a, id_b, cos)``: pairs inside a cluster with cosine strictly above. A cluster is cut into blocks
    by a hash of the id; each pair of blocks is a task's work of bounded size. The pairs looked at are
    quadratic in a cluster: see ``kmeans``. Null ids, clusters and vectors are in no pair."""
    rows = df.select(F.col(id_col).alias("id"), F.col(cluster).alias("c"), F.col(vector).alias("v")).where("id is not null and c is not null and v is not null")
    blocks = rows.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / CLUSTER_BLOCK).cast("int").alias("blocks"))
    placed = rows.join(broadcast_small(blocks, "clusters"), "c").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = placed.select("id", "c", "v", "mine", other).select("id", "c", "v", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        ids, mine, v = part["id"].to_numpy(), part["mine"].to_numpy(), np.stack(part["v"].to_numpy()).astype(float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
        same = part["low"].iloc[0] == part["high"].iloc[0]
        found = []
        for at in range(0, len(v), 1024):
            s = v[at : at + 1024] @ v.T
            i, j = np.nonzero(s > above)
            keep = (j > i + at) & (same | (mine[i + at] != mine[j]))
            found.append(pd.DataFrame({"id_a": ids[i[keep] + at], "id_b": ids[j[keep]], "cos": s[i[keep], j[keep]]}))
        return pd.concat(found)

    return cells.groupBy("c", "low", "high").applyInPandas(run, "id_a bigint, id_b bigint, cos double")


def kmeans(df: DataFrame, id_col: str, vector: str, rows: int, seed: int = 42, sample: int = 100_000) -> DataFrame:
    """``(id, cluster)``: k-means with k = min(2000, max(10, floor(sqrt(rows)))) and 20 rounds, fitted on at
    most ``sample`` rows drawn by hash, all rows assigned by broadcast centres (k * width numbers)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    k = min(2000, max(10, int(rows**0.5)))
    share = min(1.0, sample / max(rows, 1))
    points = df.select(F.col(id_col).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    drawn = points.where(T.hash_uniform(F.col("id"), seed) < share)
    model = KMeans(k=k, maxIter=20, seed=seed).fit(drawn)
    return model.transform(points).select("id", F.col("prediction").alias("cluster"))


def mmr(df: DataFrame, id_col: str, cell: str, vector: str, most: int, balance: float = 0.5) -> DataFrame:
    """``(cell, id, rank)``: maximal marginal relevance inside each cell: first the row nearest the centroid,
    then the one that best weighs nearness to it against the largest similarity to what was taken.

    All rows of a cell compete. Each of the ``most`` rounds scores the rows where they lie against the
    cell's centroid and the vectors taken (cells * most at most, broadcast) and combines the best of each
    cell before the shuffle. The smallest id wins among equals. Null ids, cells and vectors are left out.
    """
    rows = df.select(F.col(cell).alias("cell"), F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).where("cell is not null and id is not null and v is not null")
    mean = centroids(rows, "v", ["cell"])
    centre = materialize(mean.select("cell", F.transform("centroid", lambda x: x / (norm(F.col("centroid")) + 1e-8)).alias("centre")), "centres")
    taken = centre.select("cell", "centre", F.array().cast("array<bigint>").alias("ids"), F.array().cast(f"array<{rows.schema['v'].dataType.simpleString()}>").alias("vectors"))
    for _ in range(most):
        open_ = rows.join(broadcast_small(taken, "cells"), "cell").where(~F.array_contains("ids", F.col("id")))
        near = dot(F.col("v"), F.col("centre"))
        worst = F.array_max(F.transform("vectors", lambda t: dot(F.col("v"), t)))
        score = F.when(F.size("ids") == 0, near).otherwise(balance * near - (1 - balance) * worst)
        best = open_.groupBy("cell").agg(F.max_by(F.struct("id", "v"), F.struct(score.alias("score"), (-F.col("id")).alias("back"))).alias("best"))
        more = lambda column, field: F.when(F.col("best").isNull(), F.col(column)).otherwise(F.concat(column, F.array(f"best.{field}"))).alias(column)
        following = materialize(taken.join(F.broadcast(best), "cell", "left").select("cell", "centre", more("ids", "id"), more("vectors", "v")), "taken")
        discard(taken)
        taken = following
    return taken.select("cell", F.posexplode("ids").alias("rank", "id")).select("cell", "id", (F.col("rank") + 1).alias("rank"))


def sinusoidal(t: Column, width: int = 8, period: float = 10000.0) -> Column:
    half = width // 2
    angle = lambda i: t * F.exp(F.lit(-float(np.log(period))) * i / half)
    steps = F.sequence(F.lit(0), F.lit(half - 1))
    return F.concat(F.transform(steps, lambda i: F.cos(angle(i))), F.transform(steps, lambda i: F.sin(angle(i))))


def pad_to(rows: Column, multiple: int = 32) -> Column:
    """An array padded to a multiple of ``multiple`` by repeating its last element."""
    missing = F.pmod(-F.size(rows), F.lit(multiple))
    return F.concat(rows, F.array_repeat(F.element_at(rows, -1), missing))


def patches(image: Column, height: int, width: int, size: int = 2) -> Column:
    """A row-major image as an array of its size*size patches, each row-major."""
    grid = F.sequence(F.lit(0), F.lit((height // size) * (width // size) - 1))
    inner = F.sequence(F.lit(0), F.lit(size * size - 1))
    per = width // size

    def patch(p: Column) -> Column:
        row, column = F.floor(p / per) * size, (p % per) * size
        return F.transform(inner, lambda q: F.element_at(image, ((row + F.floor(q / size)) * width + column + q % size + 1).cast("int")))

    return F.transform(grid, patch)


def unpatched(cut: Column, height: int, width: int, size: int = 2) -> Column:
    """The row-major image whose ``patches`` these are."""
    per = width // size

    def pixel(q: Column) -> Column:
        row, column = F.floor(q / width), q % width
        patch = F.floor(row / size) * per + F.floor(column / size)
        return F.element_at(F.element_at(cut, (patch + 1).cast("int")), ((row % size) * size + column % size + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), pixel)


def pixels(v: Column) -> Column:
    """[-1, 1] to 0..255, halves to even."""
    return F.transform(v, lambda x: F.bround(F.least(F.greatest(x.cast("double") / 2 + 0.5, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))
