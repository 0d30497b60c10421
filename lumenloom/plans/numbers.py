"""Queries on vectors, run logs, schedules, JSON events and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom.functions import text as T
from lumenloom.operators import classify, filters, runlog, vectors
from lumenloom.operators import sampling
from lumenloom.operators.dedup import greedy_within
from lumenloom.plans.corpus import HASH
from lumenloom.plans.registry import query
from lumenloom.session import read_table, working_dir
from lumenloom.streaming import streams

WIDTH = 64
_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings")


_CENTROIDS = """
c AS (SELECT label, list(m ORDER BY pos) AS raw FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY label),
n AS (SELECT label, list_transform(raw, lambda x: x / (sqrt(""" + _DOT.format(a="raw", b="raw") + """) + 1e-8)) AS centroid FROM c)"""


def _centroids(df: DataFrame) -> DataFrame:
    raw = vectors.centroids(df, "embedding", ["label"])
    return raw.select("label", F.transform("centroid", lambda x: x / (vectors.norm(F.col("centroid")) + 1e-8)).alias("centroid"))


@query("SELECT vec_id, round(sqrt(" + _DOT.format(a="embedding", b="embedding") + "), 6) AS length, round(list_max(embedding)::DOUBLE, 6) AS top FROM embeddings")
def vector_lengths(spark, folder):
    return _vectors(spark, folder).select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"), F.round(F.array_max("embedding").cast("double"), 6).alias("top"))


@query("SELECT vec_id, list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS finite FROM embeddings")
def finite_vectors(spark, folder):
    return _vectors(spark, folder).select("vec_id", filters.finite(F.col("embedding")).alias("finite"))


@query(f"WITH {_CENTROIDS} SELECT label, pos, round(x, 6) AS x FROM (SELECT label, unnest(centroid) AS x, unnest(range(1, 65)) AS pos FROM n)")
def label_centroids(spark, folder):
    return _centroids(_vectors(spark, folder)).select("label", F.posexplode("centroid").alias("p", "x")).select("label", (F.col("p") + 1).cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@query(f"""
WITH {_CENTROIDS}, s AS (SELECT e.vec_id, n.label, {_DOT.format(a='e.embedding', b='n.centroid')} AS score FROM embeddings e CROSS JOIN n)
SELECT vec_id, label AS best, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1""")
def nearest_centroid(spark, folder):
    rows = _vectors(spark, folder)
    labels = _centroids(rows).withColumnRenamed("label", "ord")
    return vectors.nearest(rows.select("vec_id", "embedding"), "embedding", labels).select("vec_id", "best", F.round("score", 6).alias("score"))


@query(f"""
WITH {_CENTROIDS}, s AS (SELECT e.vec_id, n.label, {_DOT.format(a='e.embedding', b='n.centroid')} AS score FROM embeddings e CROSS JOIN n),
b AS (SELECT vec_id, max(score) - max(CASE WHEN label = 0 THEN score END) AS gap, max_by(label, score) AS best FROM s GROUP BY vec_id)
SELECT vec_id, CASE WHEN best <> 0 AND gap > 0.05 THEN 'C' || (best + 1) ELSE 'C1' END AS camera FROM b""")
def hybrid_camera(spark, folder):
    """The hybrid rule where every keyword says C1: the nearest centroid if it beats the default's by the margin."""
    rows = _vectors(spark, folder)
    labels = _centroids(rows).select("label", "centroid")
    scored = vectors.scored(rows.select("vec_id", "embedding"), "embedding", labels.withColumnRenamed("label", "ord"))
    best = F.array_max("scores")
    default = F.element_at(F.filter("scores", lambda x: x["back"] == 0), 1)["score"]
    code = F.concat(F.lit("C"), (1 - best["back"]).cast("string"))
    return scored.select("vec_id", classify.hybrid_camera(F.lit("C1"), code, best["score"] - default).alias("camera"))


@query(f"""SELECT a.vec_id AS id_a, b.vec_id AS id_b, round({_DOT.format(a='a.embedding', b='b.embedding')} / (sqrt({_DOT.format(a='a.embedding', b='a.embedding')}) * sqrt({_DOT.format(a='b.embedding', b='b.embedding')})), 5) AS cos
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_DOT.format(a='a.embedding', b='b.embedding')} / (sqrt({_DOT.format(a='a.embedding', b='a.embedding')}) * sqrt({_DOT.format(a='b.embedding', b='b.embedding')})) > 0.3""")
def cluster_pairs(spark, folder):
    """Pairs inside a cluster with cosine above 0.3 (the rows' label stands for the cluster)."""
    return vectors.cluster_pairs(_vectors(spark, folder), "vec_id", "label", "embedding", 0.3).withColumn("cos", F.round("cos", 5))


@query("SELECT avg(n) AS mean, max(n) AS largest, median(n) AS middle FROM (SELECT count(*) AS n FROM embeddings GROUP BY label HAVING count(*) >= 2)")
def cluster_sizes(spark, folder):
    n = _vectors(spark, folder).groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return n.agg(F.avg("n").alias("mean"), F.max("n").alias("largest"), F.expr("percentile(n, 0.5)").alias("middle"))


@query("""
WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings)
SELECT a.i::INT AS i, b.i::INT AS j, round(covar_samp(a.x, b.x), 6) + 0.0 AS cov FROM l a JOIN l b USING (vec_id) GROUP BY 1, 2""")
def covariance_matrix(spark, folder):
    return vectors.covariance(_vectors(spark, folder), "embedding", WIDTH).select("i", "j", (F.round("cov", 6) + 0.0).alias("cov"))


@query(f"""
WITH r AS (SELECT vec_id, embedding, label < 5 AS side, ('0x' || left(md5(concat(vec_id, ':42')), 2))::INT % 3 AS subset FROM embeddings),
p AS (SELECT a.subset, a.side AS sa, b.side AS sb, a.vec_id = b.vec_id AS same, power({_DOT.format(a='a.embedding', b='b.embedding')} / 64 + 1, 3) AS k FROM r a JOIN r b ON a.subset = b.subset)
SELECT subset::INT AS subset, round(avg(k) FILTER (sa AND sb AND NOT same) + avg(k) FILTER (NOT sa AND NOT sb AND NOT same) - 2 * avg(k) FILTER (sa AND NOT sb), 6) AS mmd FROM p GROUP BY subset""")
def kernel_distance(spark, folder):
    """Unbiased cubic-kernel discrepancy per hashed subset."""
    rows = _vectors(spark, folder)
    subset = F.conv(F.substring(T.hash_order(F.col("vec_id")), 1, 2), 16, 10).cast("int") % 3
    return vectors.poly_mmd(rows, "embedding", F.col("label") < 5, subset, WIDTH).select("subset", F.round("mmd", 6).alias("mmd"))


@query(None)
def frechet_distance(spark, folder):
    return vectors.frechet_distance(_vectors(spark, folder), "embedding", F.col("label") < 5, WIDTH)


def _mmr_sql(most: int) -> str:
    near = _DOT.format(a="e.embedding", b="n.centroid")
    steps = [f"{_CENTROIDS}, near AS (SELECT e.label, e.vec_id, e.embedding, {near} AS near FROM embeddings e JOIN n ON n.label = e.label)", "t0 AS (SELECT NULL::BIGINT AS label, NULL::BIGINT AS vec_id, NULL::FLOAT[] AS embedding, 0 AS rank WHERE false)"]
    for r in range(1, most + 1):
        worst = f"(SELECT max({_DOT.format(a='c.embedding', b='t.embedding')}) FROM t{r - 1} t WHERE t.label = c.label)"
        score = "c.near" if r == 1 else f"0.5 * c.near - 0.5 * {worst}"
        left = f"SELECT c.label, c.vec_id, c.embedding, {score} AS score FROM near c WHERE NOT EXISTS (SELECT 1 FROM t{r - 1} t WHERE t.label = c.label AND t.vec_id = c.vec_id)"
        steps.append(f"t{r} AS (SELECT * FROM t{r - 1} UNION ALL SELECT label, vec_id, embedding, {r} AS rank FROM ({left}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1)")
    return f"WITH {', '.join(steps)} SELECT label AS cell, vec_id AS id, rank FROM t{most}"


@query(_mmr_sql(5))
def mmr_selection(spark, folder):
    return vectors.mmr(_vectors(spark, folder), "vec_id", "label", "embedding", 5)


@query(f"""
WITH sizes AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label), total AS (SELECT count(*) AS n FROM embeddings),
a AS (SELECT label, CASE WHEN n <= 40 THEN size ELSE least((least(2, size) + 20 * size / n::DOUBLE)::DOUBLE, size) END AS alloc FROM sizes CROSS JOIN total),
m AS ({_mmr_sql(6)})
SELECT m.cell, m.id, m.rank FROM m JOIN a ON a.label = m.cell WHERE m.rank <= floor(a.alloc)""")
def weighted_selection(spark, folder):
    """Rows by weighted allocation to the cells, chosen within each by maximal marginal relevance."""
    rows = _vectors(spark, folder)
    alloc = sampling.weighted_allocation(rows, ["label"], 40, 2, 10).select(F.col("label").alias("cell"), "alloc")
    chosen = vectors.mmr(rows, "vec_id", "label", "embedding", int(alloc.agg(F.max("alloc")).collect()[0][0] or 0))
    return chosen.join(F.broadcast(alloc), "cell").where("rank <= alloc").select("cell", "id", "rank")  # a row a cell


@query(None)
def kmeans_clusters(spark, folder):
    rows = _vectors(spark, folder)
    return vectors.kmeans(rows, "vec_id", "embedding", rows.count())


@query(f"""
WITH RECURSIVE v AS (SELECT label, vec_id, embedding, ('0x' || left(md5(concat(vec_id, ':42')), 7))::BIGINT / 268435456.0::DOUBLE AS score, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
near AS (SELECT a.label, a.i, list(b.i) FILTER (b.score <= a.score) AS lower, list(b.i) FILTER (b.score > a.score) AS higher FROM v a JOIN v b ON a.label = b.label AND a.i < b.i WHERE {_DOT.format(a='a.embedding', b='b.embedding')} > 0.3 GROUP BY 1, 2),
r(label, i, gone) AS (
  SELECT DISTINCT label, 0::BIGINT, []::BIGINT[] FROM v
  UNION ALL SELECT r.label, v.i, CASE WHEN list_contains(r.gone, v.i) OR n.i IS NULL THEN r.gone
    ELSE list_concat(r.gone, list_concat(coalesce(n.lower, []), CASE WHEN len(list_filter(coalesce(n.higher, []), lambda x: NOT list_contains(r.gone, x))) > 0 THEN [v.i] ELSE [] END)) END
  FROM r JOIN v ON v.label = r.label AND v.i = r.i + 1 LEFT JOIN near n ON n.label = v.label AND n.i = v.i),
last AS (SELECT label, arg_max(gone, i) AS gone FROM r GROUP BY label)
SELECT vec_id AS id FROM v JOIN last USING (label) WHERE NOT list_contains(gone, v.i)""")
def greedy_survivors(spark, folder):
    rows = _vectors(spark, folder).select(F.col("label").alias("cluster"), F.col("vec_id").alias("id"), T.hash_uniform(F.col("vec_id")).alias("score"), F.col("embedding").alias("vector"))
    return greedy_within(rows, 0.3)


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)) / 8, 6) AS pooled, len(embedding[1:10])::INT AS kept FROM embeddings")
def pooled_prefix(spark, folder):
    """Mean pooling of a ragged array (here eight one-element rows), a valid prefix of a padded one."""
    rows = _vectors(spark, folder)
    ragged = F.transform(F.slice("embedding", 1, 8), lambda x: F.array(x))
    return rows.select("vec_id", F.round(F.element_at(vectors.mean_pool(ragged, 1), 1), 6).alias("pooled"), F.size(F.slice("embedding", 1, 10)).alias("kept"))


@query("SELECT vec_id, list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: 1))::BIGINT AS positive, (64 + 0)::BIGINT AS padded FROM embeddings")
def masked_and_padded(spark, folder):
    mask = F.transform("embedding", lambda x: x > 0)
    rows = _vectors(spark, folder)
    return rows.select("vec_id", F.size(vectors.masked(F.col("embedding"), mask)).cast("bigint").alias("positive"), F.size(vectors.pad_to(F.slice("embedding", 1, 50), 32)).cast("bigint").alias("padded"))


@query("SELECT vec_id, list_transform([0, 1, 8, 9], lambda i: round(embedding[i + 1]::DOUBLE, 6)) AS first_patch, [round_even(least(greatest(embedding[1]::DOUBLE / 2 + 0.5, 0), 1) * 255, 0)::INT, round_even(least(greatest(embedding[2]::DOUBLE / 2 + 0.5, 0), 1) * 255, 0)::INT] AS px FROM embeddings")
def patches_and_pixels(spark, folder):
    rows = _vectors(spark, folder)
    first = F.element_at(vectors.patches(F.col("embedding"), 8, 8), 1)
    return rows.select("vec_id", F.transform(first, lambda x: F.round(x.cast("double"), 6)).alias("first_patch"), vectors.pixels(F.slice("embedding", 1, 2)).alias("px"))


@query("SELECT y.y::BIGINT AS y, x.x::BIGINT AS x FROM range(0, 4) y(y) CROSS JOIN range(0, 6) x(x)")
def coordinate_grid(spark, folder):
    return spark.range(4).select(F.col("id").alias("y")).select("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("x"))


@query("SELECT vec_id, k::BIGINT AS k FROM embeddings CROSS JOIN range(0, 3) r(k)")
def repeated_rows(spark, folder):
    return _vectors(spark, folder).select("vec_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("k"))


@query("""SELECT step, list_transform(range(0, 4), lambda i: round(cos(step * exp(-ln(10000.0::DOUBLE) * i / 4)), 6)) AS c, list_transform(range(0, 4), lambda i: round(sin(step * exp(-ln(10000.0::DOUBLE) * i / 4)), 6)) AS s FROM (SELECT DISTINCT step FROM eval_results)""")
def step_embedding(spark, folder):
    steps = read_table(spark, folder, "eval_results").select("step").distinct()
    e = vectors.sinusoidal(F.col("step"), 8)
    rounded = F.transform(e, lambda x: F.round(x, 6))
    return steps.select("step", F.slice(rounded, 1, 4).alias("c"), F.slice(rounded, 5, 4).alias("s"))


@query("SELECT m.row_id, e.label FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS place FROM metadata_10) m JOIN (SELECT label, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings) e USING (place)")
def aligned_join(spark, folder):
    """Two tables aligned by position: the places are made explicit, then joined."""
    records = sampling.positions(read_table(spark, folder, "metadata_10").select("row_id"), [F.col("row_id")])
    rows = sampling.positions(_vectors(spark, folder).select("vec_id", "label"), [F.col("vec_id")])
    return records.join(rows, "_pos").select("row_id", "label")


@query(f"""
WITH p AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS place FROM metadata_10), n AS (SELECT count(*) AS n FROM embeddings),
e AS (SELECT label, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings)
SELECT p.row_id, p.place < n.n AS own, e.label FROM p CROSS JOIN n JOIN e ON e.place = CASE WHEN p.place < n.n THEN p.place ELSE ('0x' || left({HASH.format(seed=42)}, 7))::BIGINT % n.n END""")
def substituted_join(spark, folder):
    """A left join whose missing rows get another row, drawn by hash."""
    records = sampling.positions(read_table(spark, folder, "metadata_10").select("row_id"), [F.col("row_id")])
    rows = sampling.positions(_vectors(spark, folder).select("vec_id", "label"), [F.col("vec_id")])
    n = rows.count()
    drawn = F.conv(F.substring(T.hash_order(F.col("row_id")), 1, 7), 16, 10).cast("bigint") % n
    placed = records.withColumn("own", F.col("_pos") < n).withColumn("_pos", F.when(F.col("own"), F.col("_pos")).otherwise(drawn))
    return placed.join(rows, "_pos").select("row_id", "own", "label")


@query("SELECT ratio, width::INT AS width, height::INT AS height FROM (SELECT e.event_id % 40 AS k, (e.event_id % 40 + 10) / 20.0::DOUBLE AS ratio FROM events e) JOIN (SELECT 1) ON true CROSS JOIN (SELECT * FROM (VALUES (0, 512, 512), (1, 640, 480), (2, 480, 640), (3, 768, 432)) b(i, width, height)) QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(ratio - width / height::DOUBLE), i) = 1")
def nearest_bucket(spark, folder):
    """The aspect-ratio bucket nearest to each ratio."""
    key = F.pmod("event_id", F.lit(40))
    ratios = read_table(spark, folder, "events").select(((key + 10) / F.lit(20.0)).alias("ratio")).distinct()
    buckets = spark.createDataFrame([(0, 512, 512), (1, 640, 480), (2, 480, 640), (3, 768, 432)], "i int, width int, height int").withColumn("r", F.col("width") / F.col("height"))
    return runlog.nearest_row(ratios, buckets, "ratio", "r", "i").select("ratio", "width", "height")


# --- run logs ---


@query("SELECT DISTINCT run_id, step, num_images, kid_mean, kid_std, CASE WHEN kid_mean IS NOT NULL AND (best IS NULL OR kid_mean < best) THEN 'keep' ELSE 'discard' END AS verdict FROM (SELECT *, min(kid_mean) OVER (PARTITION BY run_id ORDER BY step, recorded_at, num_images ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT DISTINCT run_id, step, num_images, kid_mean, kid_std, recorded_at FROM eval_results))")
def running_best(spark, folder):
    rows = read_table(spark, folder, "eval_results").select("run_id", "step", "num_images", "kid_mean", "kid_std", "recorded_at").distinct()
    return runlog.running_best(rows, "run_id", ["step", "recorded_at", "num_images"], "kid_mean").drop("recorded_at").distinct()


_STREAK = """
e AS (SELECT user_id, event_id, ts, (event_type = 'error')::INT AS f FROM events), g AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM e),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM g)"""


@query(f"WITH {_STREAK} SELECT user_id, max(streak)::BIGINT AS longest FROM s GROUP BY user_id")
def error_streaks(spark, folder):
    rows = runlog.failure_streak(read_table(spark, folder, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return rows.groupBy("user_id").agg(F.max("streak").alias("longest"))


@query("""
WITH x AS (SELECT user_id, event_id, (event_type = 'error')::INT AS f FROM events), g AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM x),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id, grp ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS streak FROM g)
SELECT user_id, min(CASE WHEN streak >= 2 THEN event_id END) AS stop FROM s GROUP BY user_id""")
def early_stops(spark, folder):
    return runlog.early_stop(read_table(spark, folder, "events"), "user_id", ["event_id"], F.col("event_type") == "error", 2)


@query("SELECT event_id, value > 15 OR value < 0.1 AS failing FROM (SELECT event_id, coalesce(value, 1.0) AS value FROM events)")
def failing_checks(spark, folder):
    rows = read_table(spark, folder, "events")
    return rows.select("event_id", filters.failing(F.lit(0.7), F.lit(0.7), F.col("value")).alias("failing"))


@query("SELECT round(avg((value > 50)::INT) FILTER (event_type = 'click'), 6) AS accuracy_real, round(avg((value < 50)::INT) FILTER (event_type = 'view'), 6) AS accuracy_fake, round(avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view'), 6) AS gap FROM events")
def conditional_means(spark, folder):
    e, v = F.col("event_type"), F.col("value")
    return read_table(spark, folder, "events").agg(
        F.round(F.avg(F.when(e == "click", F.when(v.isNotNull(), (v > 50).cast("int")))), 6).alias("accuracy_real"),
        F.round(F.avg(F.when(e == "view", F.when(v.isNotNull(), (v < 50).cast("int")))), 6).alias("accuracy_fake"),
        F.round(F.avg(F.when(e == "click", v)) - F.avg(F.when(e == "view", v)), 6).alias("gap"),
    )


@query("""
SELECT round(avg(greatest(0, 1 - v)) FILTER (event_type = 'click') + avg(greatest(0, 1 + v)) FILTER (event_type = 'view'), 6) AS hinge, round(avg(CASE WHEN abs(v) <= 50 THEN v * v ELSE 0 END), 6) AS mse, round(sqrt(sum(v * v)), 4) AS norm
FROM (SELECT event_type, value - 50 AS v FROM events)""")
def losses(spark, folder):
    rows = read_table(spark, folder, "events").select("event_type", (F.col("value") - 50).alias("v"))
    v = F.col("v")
    real, fake = F.when(F.col("event_type") == "click", v), F.when(F.col("event_type") == "view", v)
    pos = lambda x, s: F.when(x.isNotNull(), F.greatest(F.lit(0.0), 1 + s * x))
    return rows.agg(F.round(F.avg(pos(real, -1)) + F.avg(pos(fake, 1)), 6).alias("hinge"), F.round(runlog.clipped_mse(v), 6).alias("mse"), F.round(F.sqrt(F.sum(v * v)), 4).alias("norm"))


@query("SELECT DISTINCT 'checkpoint-' || step AS name, step FROM eval_results ORDER BY step DESC LIMIT 3")
def keep_last_checkpoints(spark, folder):
    names = read_table(spark, folder, "eval_results").select(F.concat(F.lit("checkpoint-"), F.col("step").cast("string")).alias("name")).distinct()
    return runlog.keep_last(names, "name", 3)


@query("SELECT DISTINCT run_id, step FROM eval_results WHERE step % 1000 = 0")
def periodic_steps(spark, folder):
    return read_table(spark, folder, "eval_results").where(F.pmod("step", F.lit(1000)) == 0).select("run_id", "step").distinct()


@query("SELECT event_type, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY event_type")
def latency_summary(spark, folder):
    v = F.col("value")
    return read_table(spark, folder, "events").groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.sum(v), 4).alias("total"), F.round(F.min(v), 6).alias("low"), F.round(F.max(v), 6).alias("high"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_fields(spark, folder):
    return read_table(spark, folder, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# --- schedules ---

_SIGMAS = "SELECT i::INT AS i, CASE WHEN i = 20 THEN 0 ELSE 3 * (1 - i / 19.0::DOUBLE) / (1 + 2 * (1 - i / 19.0::DOUBLE)) END AS sigma FROM range(0, 21) r(i)"


def _schedule(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.posexplode(runlog.schedule(20)).alias("i", "sigma"))


@query(f"SELECT i, round(sigma, 6) AS sigma, round(lead(sigma) OVER (ORDER BY i) - sigma, 6) AS delta FROM ({_SIGMAS})")
def sigma_schedule(spark, folder):
    window = Window.orderBy("i")  # a schedule of some tens of steps
    return _schedule(spark).select("i", F.round("sigma", 6).alias("sigma"), F.round(F.lead("sigma").over(window) - F.col("sigma"), 6).alias("delta"))


@query(f"""SELECT event_id, i FROM (SELECT e.event_id, s.i, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.value / 100 - s.sigma), s.i) AS rk FROM events e CROSS JOIN ({_SIGMAS}) s WHERE e.value IS NOT NULL) WHERE rk = 1""")
def nearest_step(spark, folder):
    """As-of-nearest join of values to schedule rows."""
    rows = read_table(spark, folder, "events").where("value is not null").select("event_id", (F.col("value") / 100).alias("at"))
    return runlog.nearest_row(rows, _schedule(spark), "at", "sigma", "i").select("event_id", "i")


@query("""SELECT step, round(0.5 + (step - 256) * (0.65 / 3840.0::DOUBLE), 6) AS mu,
round(CASE WHEN step > 4300 THEN 0.00016927 * step + 0.45666666 ELSE (8.73809524e-05 * step + 1.89833333) + ((0.00016927 * step + 0.45666666) - (8.73809524e-05 * step + 1.89833333)) * 18 / 190.0::DOUBLE END, 6) AS fitted,
round(CASE WHEN step >= 20000 THEN 0.1 ELSE 1 + (0.1 - 1) * step / 20000.0::DOUBLE END, 6) AS decayed FROM (SELECT DISTINCT step FROM eval_results)""")
def schedule_shifts(spark, folder):
    steps = read_table(spark, folder, "eval_results").select("step").distinct()
    s = F.col("step")
    return steps.select("step", F.round(runlog.shift(s), 6).alias("mu"), F.round(runlog.empirical_shift(s, F.lit(28)), 6).alias("fitted"), F.round(runlog.linear_decay(F.lit(1.0), F.lit(0.1), F.lit(20000), s), 6).alias("decayed"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS a, list_transform(embedding[5:8], lambda x: x::DOUBLE) AS b FROM embeddings)
SELECT vec_id, list_transform(range(1, 5), lambda i: round(0.75::DOUBLE * a[i] + 0.25::DOUBLE * b[i], 6)) AS mixed, list_transform(range(1, 5), lambda i: round(a[i] - 0.1::DOUBLE * b[i], 6)) AS stepped, list_transform(range(1, 5), lambda i: round(a[i] + 5 * (a[i] - b[i]), 6)) AS guided FROM v""")
def flow_arithmetic(spark, folder):
    cut = lambda a: F.transform(F.slice("embedding", a, 4), lambda x: x.cast("double"))
    r6 = lambda v: F.transform(v, lambda x: F.round(x, 6))
    a, b = cut(1), cut(5)
    return _vectors(spark, folder).select("vec_id", r6(runlog.interpolate(a, b, F.lit(0.25))).alias("mixed"), r6(runlog.euler(a, b, F.lit(-0.1))).alias("stepped"), r6(runlog.guided(a, b, 5.0)).alias("guided"))


#: A fold over each user's values by recursion: (place, sum since the last step computed, whether this one is skipped).
FOLD = """
v AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS i FROM events WHERE value IS NOT NULL),
f(user_id, event_id, i, total, skip) AS (
  SELECT user_id, event_id, i, 0.0::DOUBLE, false FROM v WHERE i = 1
  UNION ALL SELECT v.user_id, v.event_id, v.i, CASE WHEN f.total + v.value < 150 THEN f.total + v.value ELSE 0 END, f.total + v.value < 150 FROM f JOIN v ON v.user_id = f.user_id AND v.i = f.i + 1)"""


@query(f"WITH RECURSIVE {FOLD.format(order='ts, event_id')} SELECT user_id, count(*) FILTER (skip) AS skipped, count(*) AS steps FROM f GROUP BY user_id")
def threshold_fold(spark, folder):
    """Accumulate-until-threshold over each user's ordered values: a fold over a sorted array."""
    rows = read_table(spark, folder, "events").where("value is not null")
    ordered = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    skips = runlog.fold_threshold(F.transform("e", lambda x: x["value"]), 150.0)
    return ordered.select("user_id", F.size(F.filter(skips, lambda s: s)).alias("skipped"), F.size(skips).alias("steps"))


# --- streams: bounded runs over the events table ---


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of parts: a pattern of paths takes both, a plain path only folders."""
    kinds = read_table(spark, folder, name).schema
    return spark.readStream.schema(kinds).parquet(f"{folder}/{name}.parque[t]")


def _run(df: DataFrame, mode: str) -> DataFrame:
    name = "stream_" + uuid.uuid4().hex
    return streams.run_available(df, name, mode, f"{working_dir(df.sparkSession)}/{name}")


@query("""
WITH d AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT strftime(start, '%Y-%m-%d') AS day, event_type, n FROM d WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def streamed_tumbling(spark, folder):
    """Closed daily windows of the event stream; the last day stays open."""
    counts = streams.windowed_counts(_stream(spark, folder, "events"), "ts", ["event_type"], F.window("ts", "1 day"), "1 hour")
    return _run(counts, "append").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT DISTINCT event_type, user_id FROM events")
def streamed_dedup(spark, folder):
    rows = _stream(spark, folder, "events").withColumn("text", F.concat_ws("|", "event_type", F.col("user_id").cast("string")))
    return _run(streams.dedup_stream(rows, "text", "ts", "40 days"), "append").select("event_type", "user_id")


@query("""
WITH g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)),
w AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end_, count(*) AS n FROM g GROUP BY user_id, s)
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(end_, '%Y-%m-%d %H:%M:%S') AS "end", n FROM w WHERE end_ <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def streamed_sessions(spark, folder):
    counts = streams.windowed_counts(_stream(spark, folder, "events"), "ts", ["user_id"], F.session_window("ts", "6 hours"), "1 hour")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return _run(counts, "append").select("user_id", at("start"), at("end"), "n")


@query(f"WITH {_STREAK} SELECT user_id AS key, max(streak)::INT AS longest FROM s GROUP BY user_id")
def streamed_streaks(spark, folder):
    found = streams.failure_streaks(_stream(spark, folder, "events"), "user_id", "ts", F.col("event_type") == "error")
    return _run(found, "update").groupBy("key").agg(F.max("longest").alias("longest"))
