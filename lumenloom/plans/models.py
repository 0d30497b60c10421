"""Queries on classification by vectors, drawn timesteps, guidance, norms and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.functions import text as T
from lumenloom.operators import classify as C
from lumenloom.operators import filters, runlog, sampling, vectors
from lumenloom.plans.corpus import CATEGORIES, HASH, _case
from lumenloom.plans.extras import _NORMAL, _U, hash_normal
from lumenloom.plans.numbers import _CENTROIDS, _DOT, _centroids
from lumenloom.plans.registry import query
from lumenloom.session import read_table


def _gated(code: str, text: str) -> str:
    return f"""(CASE WHEN ({code} = 'T6' AND NOT coalesce(regexp_matches(lower({text}), '{"|".join(C.STRONG_DESIGN)}'), false)) OR ({code} = 'T7' AND NOT coalesce(regexp_matches(lower({text}), '{"|".join(C.STRONG_EXPERIMENTAL)}'), false)) THEN 'T1' ELSE {code} END)"""


_WEAK = "len(list_filter([" + ",".join(f"'{k}'" for k in C.STYLE_KEYWORDS["T6"]) + "], lambda k: contains(lower(text), k) AND k NOT IN (" + ",".join(f"'{k}'" for k in C.WEAK_DESIGN) + "))) = 0"


@query(rf"""
WITH {_CENTROIDS}, rec AS (SELECT row_id, text, row_number() OVER (ORDER BY row_id) - 1 AS place FROM metadata_10), e AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings), size AS (SELECT count(*) AS many FROM embeddings),
r AS (SELECT rec.row_id, rec.text, a.embedding AS v, b.embedding AS cv FROM rec CROSS JOIN size JOIN e a ON a.place = rec.place % many JOIN e b ON b.place = (rec.place * 7 + 3) % many WHERE rec.text IS NOT NULL),
o AS (SELECT row_id, regexp_extract(regexp_replace(text, '^\s+|\s+$', '', 'g'), '{T.CAPTION}', 1) AS rest FROM r WHERE regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '{T.CAPTION}')),
cap AS (SELECT row_id, regexp_replace(CASE WHEN instr(rest, '. ') > 1 THEN left(rest, instr(rest, '. ') - 1) WHEN instr(rest, '.' || chr(10)) > 1 THEN left(rest, instr(rest, '.' || chr(10)) - 1) ELSE rest END, '^\s+|\s+$', '', 'g') AS sentence FROM o),
s AS (SELECT r.row_id, n.label, {_DOT.format(a='r.v', b='n.centroid')} AS s, {_DOT.format(a='r.cv', b='n.centroid')} AS cs FROM r CROSS JOIN n),
b AS (SELECT row_id, 'S' || (arg_max(label, s) + 1) AS sb, max(s) - max(s) FILTER (label = 9) AS sg, 'S' || (arg_max(label, cs) + 1) AS scb,
  'T' || (arg_max(label, s) FILTER (label < 7) + 1) AS tb, max(s) FILTER (label < 7) - max(s) FILTER (label = 0) AS tg, 'T' || (arg_max(label, cs) FILTER (label < 7) + 1) AS tcb,
  'C' || (arg_max(label, s) FILTER (label < 8) + 1) AS cb, max(s) FILTER (label < 8) - max(s) FILTER (label = 0) AS cg FROM s GROUP BY row_id),
rules AS (SELECT code, ord, list_transform(regexp_extract_all(label, '[A-Z]?[a-z]{{3,}}'), lambda w: regexp_replace(lower(w), 's$', '')) AS kws, label FROM taxonomy WHERE axis = 'subject'),
hit AS (SELECT r.row_id, min_by(k.code, k.ord) AS code FROM r JOIN rules k ON len(list_filter(CASE WHEN len(k.kws) = 0 THEN [lower(k.label)] ELSE k.kws END, lambda w: contains(lower(r.text), w))) > 0 GROUP BY r.row_id),
k AS (SELECT r.row_id, r.text, cap.sentence, b.*, coalesce(hit.code, 'S10') AS skw, {_case(C.STYLE_KEYWORDS, 'T1')} AS tkw, {_case(C.CAMERA_KEYWORDS, 'C1')} AS ckw FROM r JOIN b USING (row_id) LEFT JOIN cap USING (row_id) LEFT JOIN hit USING (row_id)),
t AS (SELECT *, CASE WHEN tkw = 'T6' AND {_WEAK} THEN 'T1' ELSE tkw END AS trusted, {_gated('tb', 'text')} AS strong, {_gated('tcb', 'sentence')} AS captioned FROM k)
SELECT row_id,
  CASE WHEN sentence IS NOT NULL THEN scb WHEN skw <> 'S10' THEN skw WHEN sb <> 'S10' AND sg > 0.05 THEN sb ELSE 'S10' END AS subject,
  CASE WHEN sentence IS NOT NULL THEN captioned WHEN trusted <> 'T1' THEN trusted WHEN strong <> 'T1' AND tg > 0.05 THEN strong ELSE 'T1' END AS style,
  CASE WHEN ckw <> 'C1' THEN ckw WHEN cb <> 'C1' AND cg > 0.05 THEN cb ELSE 'C1' END AS camera FROM t""")
def zero_shot_classification(spark, folder):
    """The three hybrid rules in one plan: a record's vector and its caption's against each axis's centroids."""
    rows = sampling.positions(read_table(spark, folder, "metadata_10").select("row_id", "text"), [F.col("row_id")]).where("text is not null")
    table = read_table(spark, folder, "embeddings")
    places = sampling.positions(table.select("vec_id", "embedding"), [F.col("vec_id")]).select(F.col("_pos").alias("place"), "embedding")
    many = places.count()
    with_vector = rows.withColumn("place", F.pmod("_pos", F.lit(many))).join(places.withColumnRenamed("embedding", "v"), "place").drop("place")
    both = with_vector.withColumn("place", F.pmod(F.col("_pos") * 7 + 3, F.lit(many))).join(places.withColumnRenamed("embedding", "cv"), "place").drop("place")
    labels = _centroids(table).withColumnRenamed("label", "ord")
    axes = {"subject": (labels.where("ord < 10"), "S", 9), "style": (labels.where("ord < 7"), "T", 0), "camera": (labels.where("ord < 8"), "C", 0)}
    rules = C.rules_of(read_table(spark, folder, "taxonomy"), "subject")
    return C.zero_shot(both, "text", "v", "cv", axes, rules).select("row_id", "subject", "style", "camera")


@query(f"SELECT row_id, floor(least(greatest(1000 / (1 + exp(-{_NORMAL})), 0), 999))::BIGINT AS step FROM metadata_10")
def discrete_logit_normal(spark, folder):
    """Logit-normal steps of a schedule of a thousand."""
    return read_table(spark, folder, "metadata_10").select("row_id", runlog.discrete_logit_normal(hash_normal(F.col("row_id")), 1000).alias("step"))


_PICK = f"greatest(('0x' || left({HASH.format(seed=42)}, 7))::BIGINT / 268435456.0::DOUBLE, 0)"


@query(f"""SELECT row_id, CASE WHEN row_id % 1000 < 500 THEN CASE WHEN {_PICK} < 0.5 THEN 500 ELSE 250 END
  ELSE CASE WHEN {_PICK} < 0.7 THEN 1000 WHEN {_PICK} < 0.7::DOUBLE + 0.3::DOUBLE / 3 THEN 750 WHEN {_PICK} < 0.7::DOUBLE + 0.3::DOUBLE / 3 + 0.3::DOUBLE / 3 THEN 500 ELSE 250 END END AS timestep FROM metadata_10""")
def warmed_choice(spark, folder):
    """A timestep whose weights depend on the training step: the last two evenly while warming up, then mostly the first."""
    step = F.pmod("row_id", F.lit(1000))
    return read_table(spark, folder, "metadata_10").select("row_id", runlog.student_step(F.col("row_id"), step, [1000, 750, 500, 250], 500).alias("timestep"))


@query("""
WITH p AS (SELECT label, vec_id, embedding AS x, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
d AS (SELECT label, vec_id, list_sum(list_transform(range(1, 65), lambda i: abs(x[i]::DOUBLE - p[i]::DOUBLE))) / 64 / (list_sum(list_transform(range(1, 65), lambda i: abs(p[i]::DOUBLE))) / 64 + 1e-6::DOUBLE) AS r FROM p WHERE p IS NOT NULL)
SELECT vec_id, round(r, 6) AS relative, round(0.5::DOUBLE * r * r + 0.25::DOUBLE * r + 0.125::DOUBLE, 6) AS rescaled FROM d""")
def relative_distances(spark, folder):
    """Relative L1 distance of each vector to the one before it, and its rescaling by a polynomial."""
    from pyspark.sql import Window

    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    rows = read_table(spark, folder, "embeddings").select("vec_id", "embedding", before.alias("p")).where("p is not null")
    r = runlog.relative_l1(F.col("embedding"), F.col("p"))
    return rows.select("vec_id", F.round(r, 6).alias("relative"), F.round(runlog.polynomial(r, [0.5, 0.25, 0.125]), 6).alias("rescaled"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS p, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS n FROM embeddings),
g AS (SELECT vec_id, list_transform(range(1, 33), lambda i: p[i] + 5 * (p[i] - n[i])) AS g, sqrt(list_sum(list_transform(p, lambda x: x * x))) AS cap FROM v),
s AS (SELECT vec_id, g, cap, sqrt(list_sum(list_transform(g, lambda x: x * x))) AS own FROM g)
SELECT vec_id, list_transform(g, lambda x: round(CASE WHEN own > cap THEN x * (cap / own) ELSE x END, 5)) AS guided FROM s""")
def capped_guidance(spark, folder):
    """Classifier-free guidance whose norm stays at most that of the positive part; halves of the whole vectors."""
    half = lambda a: F.transform(F.slice("embedding", a, 32), lambda x: x.cast("double"))
    rows = read_table(spark, folder, "embeddings").select("vec_id", half(1).alias("p"), half(33).alias("n"))
    return rows.select("vec_id", F.transform(runlog.guided_capped(F.col("p"), F.col("n"), 5.0, 1.0), lambda x: F.round(x, 5)).alias("guided"))


@query("""
WITH t AS (SELECT label, sqrt(sum(x * x)) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label), g AS (SELECT sqrt(sum(n * n)) AS total FROM t),
l AS (SELECT step, total, CASE WHEN step >= 20000 THEN 1.0 ELSE 10 + (1.0::DOUBLE - 10) * step / 20000.0::DOUBLE END AS most FROM g CROSS JOIN (SELECT DISTINCT step FROM eval_results))
SELECT step, round(total, 5) AS norm, round(CASE WHEN total / most > 5 AND step > 20000 THEN most / least(total / most, 10) ELSE most END, 6) AS clip FROM l""")
def gradient_clips(spark, folder):
    """The norm of per-tensor norms (a label's vectors stand for a tensor) and the clipping threshold of each step."""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    tensors = read_table(spark, folder, "embeddings").groupBy("label").agg(F.sqrt(F.sum(square)).alias("n"))
    total = tensors.agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("total"))  # one number
    steps = read_table(spark, folder, "eval_results").select("step").distinct().crossJoin(F.broadcast(total))
    most = runlog.linear_decay(F.lit(10.0), F.lit(1.0), F.lit(20000), F.col("step"))
    return steps.select("step", F.round("total", 5).alias("norm"), F.round(runlog.clip_threshold(F.col("total"), most, F.col("step"), 20000), 6).alias("clip"))


@query("SELECT DISTINCT step, round(CASE WHEN step = 0 THEN 0 ELSE exp(1.15::DOUBLE) / (exp(1.15::DOUBLE) + power(30000.0::DOUBLE / step - 1, 1)) END, 6) AS shifted FROM eval_results WHERE step <= 30000")
def shifted_times(spark, folder):
    """The exponential form of the schedule's shift."""
    steps = read_table(spark, folder, "eval_results").where("step <= 30000").select("step").distinct()
    return steps.select("step", F.round(runlog.time_shift(F.lit(1.15), 1.0, F.col("step") / F.lit(30000.0)), 6).alias("shifted"))


@query("SELECT source, round(n / total, 6) AS share FROM (SELECT source, count(*) AS n, sum(count(*)) OVER () AS total FROM metadata_10 GROUP BY source) ORDER BY n DESC, source NULLS LAST LIMIT 1")
def largest_source(spark, folder):
    """The source with the largest share, the first by name of equals."""
    counts = read_table(spark, folder, "metadata_10").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    best = F.struct("n", F.col("source").isNotNull().alias("named"))
    top = counts.agg(F.max(best).alias("b"), F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(top)).where((F.col("n") == F.col("b.n")) & (F.col("source").isNotNull() == F.col("b.named"))).groupBy("n", "total").agg(F.min("source").alias("source")).select("source", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(max(avg(value)) OVER () / avg(value), 6) AS speedup FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_speedup(spark, folder):
    """Mean latency and how many times faster than the slowest."""
    means = read_table(spark, folder, "events").where("value is not null").groupBy("event_type").agg(F.avg("value").alias("mean"))
    slowest = means.agg(F.max("mean").alias("most"))  # one number
    return means.crossJoin(F.broadcast(slowest)).select("event_type", F.round("mean", 6).alias("mean"), F.round(F.col("most") / F.col("mean"), 6).alias("speedup"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS image, list_transform(range(0, 16), lambda p: round(list_sum(list_transform([0, 1, 8, 9], lambda o: embedding[(p // 4) * 16 + (p % 4) * 2 + o + 1]::DOUBLE)), 5)) AS sums FROM embeddings")
def patches_and_back(spark, folder):
    """An 8 x 8 image cut into its 16 patches, and put together again."""
    cut = read_table(spark, folder, "embeddings").select("vec_id", vectors.patches(F.col("embedding"), 8, 8).alias("p"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    image = F.transform(vectors.unpatched(F.col("p"), 8, 8), lambda x: F.round(x.cast("double"), 6))
    return cut.select("vec_id", image.alias("image"), F.transform("p", lambda v: F.round(total(v), 5)).alias("sums"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round_even(least(greatest(x::DOUBLE / 2 + 0.5, 0), 1) * 255, 0)::INT) AS px, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64, 6) AS pooled FROM embeddings")
def whole_pixels(spark, folder):
    """Every element as a pixel, and the mean over eight rows of eight pooled again."""
    rows = read_table(spark, folder, "embeddings")
    lines = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    pooled = vectors.mean_pool(lines, 8)
    mean = F.aggregate(pooled, F.lit(0.0), lambda s, x: s + x) / 8
    return rows.select("vec_id", vectors.pixels(F.col("embedding")).alias("px"), F.round(mean, 6).alias("pooled"))


#: Categories that mean something else in one source; a parameter of the lookup.
BY_SOURCE = {("promptwell", "objects"): "S11", ("benchpool", "people"): "S9", ("denseleaf", "outdoor"): "S6"}


@query("""
SELECT item_id, coalesce(CASE """ + " ".join(f"WHEN source = '{s}' AND cat = '{c}' THEN '{v}'" for (s, c), v in BY_SOURCE.items()) + " END, CASE cat " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORIES.items()) + r""" END, 'S10') AS subject
FROM (SELECT item_id, source, lower(regexp_replace(original_category, '^\s+|\s+$', '', 'g')) AS cat FROM benchmark_stage)""")
def subject_by_source(spark, folder):
    """Dimension lookup by source and category, then by category alone, then the default."""
    category = F.lower(T.strip(F.col("original_category")))
    return read_table(spark, folder, "benchmark_stage").select("item_id", F.coalesce(C.mapped_subject(category, F.col("source"), BY_SOURCE, CATEGORIES), F.lit("S10")).alias("subject"))


@query("""
WITH a AS (SELECT user_id, event_type, avg((value > 40)::INT) AS real, avg((value < 60)::INT) AS fake, avg(value) - 45 AS gap FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type)
SELECT user_id, event_type, (real > 0.95 AND fake > 0.95) OR (real < 0.55 AND fake < 0.55) OR gap > 15 OR gap < 0.1 AS failing FROM a""")
def failing_groups(spark, folder):
    """Health checks on three measured numbers a group."""
    rows = read_table(spark, folder, "events").where("value is not null")
    share = lambda c: F.avg(c.cast("int"))
    groups = rows.groupBy("user_id", "event_type").agg(share(F.col("value") > 40).alias("real"), share(F.col("value") < 60).alias("fake"), (F.avg("value") - 45).alias("gap"))
    return groups.select("user_id", "event_type", filters.failing(F.col("real"), F.col("fake"), F.col("gap")).alias("failing"))


@query(f"SELECT row_id, CASE WHEN {_U.format(seed=3)} < 0.5 THEN 'left' ELSE 'right' END AS half FROM metadata_10")
def even_halves(spark, folder):
    """An even choice between two values."""
    return read_table(spark, folder, "metadata_10").select("row_id", sampling.weighted_pick(F.col("row_id"), [("left", 1.0), ("right", 1.0)], 3).alias("half"))
