"""Further queries: joins by schedule and name, drawn choices, embedders, generators, and the star schema.

The star-schema queries are an extension, for relational operators that the prompt corpus doesn't exercise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lumenloom.functions import text as T
from lumenloom.operators import edits, generate, report, runlog, sampling, vectors
from lumenloom.plans.numbers import FOLD, _run, _schedule, _stream
from lumenloom.plans.registry import query
from lumenloom.session import read_table
from lumenloom.streaming import streams

_SIGMAS = "SELECT i::INT AS i, CASE WHEN i = 20 THEN 0 ELSE 3 * (1 - i / 19.0::DOUBLE) / (1 + 2 * (1 - i / 19.0::DOUBLE)) END AS sigma FROM range(0, 21) r(i)"


@query(f"SELECT e.event_id, s.i FROM events e JOIN ({_SIGMAS}) s ON s.i = e.event_id % 20")
def exact_step(spark, folder):
    """Exact-key schedule lookup: every key must match one row."""
    rows = read_table(spark, folder, "events").select("event_id", F.pmod("event_id", F.lit(20)).cast("int").alias("key"))
    return runlog.exact_row(rows, _schedule(spark), "key", "i").select("event_id", "i")


@query("SELECT timestep, CASE WHEN count(*) > 1 THEN max(i) FILTER (rk = 2) ELSE min(i) END::INT AS place FROM (SELECT step // 2000 AS timestep, i, row_number() OVER (PARTITION BY step // 2000 ORDER BY i) AS rk FROM (SELECT step, row_number() OVER (ORDER BY step) - 1 AS i FROM (SELECT DISTINCT step FROM eval_results))) GROUP BY timestep")
def step_place(spark, folder):
    """The place of a timestep in a schedule: the second match if it stands there more than once."""
    steps = read_table(spark, folder, "eval_results").select("step").distinct()
    placed = steps.withColumn("i", F.row_number().over(Window.orderBy("step")) - 1)  # a run's few steps
    found = placed.groupBy(F.floor(F.col("step") / 2000).cast("int").alias("timestep")).agg(F.array_sort(F.collect_list("i")).alias("at"))
    return found.select("timestep", F.when(F.size("at") > 1, F.element_at("at", 2)).otherwise(F.element_at("at", 1)).alias("place"))


@query("""
WITH a AS (SELECT lpad((row_id % 1000)::VARCHAR, 5, '0') || '.png' AS name, row_id FROM metadata_10), b AS (SELECT lpad((item_id % 1000)::VARCHAR, 5, '0') || '.png' AS name, item_id FROM benchmark_stage)
SELECT a.name, a.row_id, b.item_id FROM a JOIN b USING (name)""")
def name_join(spark, folder):
    """Two folders of images joined by file name."""
    named = lambda c: F.concat(T.padded(F.pmod(F.col(c), F.lit(1000)), 5), F.lit(".png")).alias("name")
    a = read_table(spark, folder, "metadata_10").select(named("row_id"), "row_id")
    return a.join(read_table(spark, folder, "benchmark_stage").select(named("item_id"), "item_id"), "name")


_U = "greatest(('0x' || left(md5(concat(row_id, ':{seed}')), 7))::BIGINT / 268435456.0::DOUBLE, 1e-9::DOUBLE)"
_NORMAL = f"(sqrt(-2 * ln({_U.format(seed=1)})) * cos(2 * pi() * {_U.format(seed=2)}))"


def hash_normal(key: Column, seed: int = 1) -> Column:
    """A reproducible standard normal number from two hashed uniform ones."""
    u = F.greatest(T.hash_uniform(key, seed), F.lit(1e-9))
    v = F.greatest(T.hash_uniform(key, seed + 1), F.lit(1e-9))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * v)


@query(f"SELECT row_id, round(least(greatest(1 / (1 + exp(-(1 + {_NORMAL}))), 0.001), 0.999), 6) AS t, floor({_U.format(seed=5)} * 1000)::BIGINT AS uniform_step FROM metadata_10")
def drawn_timesteps(spark, folder):
    """Logit-normal and uniform discrete timesteps."""
    k = F.col("row_id")
    t = 1 / (1 + F.exp(-(1 + hash_normal(k))))
    uniform = F.greatest(T.hash_uniform(k, 5), F.lit(1e-9))
    return read_table(spark, folder, "metadata_10").select("row_id", F.round(F.least(F.greatest(t, F.lit(0.001)), F.lit(0.999)), 6).alias("t"), F.floor(uniform * 1000).alias("uniform_step"))


@query(f"SELECT row_id, CASE WHEN row_id % 5 < 2 THEN CASE WHEN {_U.format(seed=42)} < 0.9 THEN 1.0::DOUBLE ELSE 0.5 END ELSE CASE WHEN {_U.format(seed=42)} < 0.9 THEN 0.75::DOUBLE ELSE 0.25 END END AS ratio FROM metadata_10")
def bucketed_choice(spark, folder):
    """A downsampling ratio whose choices depend on a size class, the first taken nine times in ten."""
    k = F.col("row_id")
    small = F.pmod(k, F.lit(5)) < 2
    pick = lambda a, b: sampling.weighted_pick(k, [(a, 0.9), (b, 0.1)])
    return read_table(spark, folder, "metadata_10").select("row_id", F.when(small, pick(1.0, 0.5)).otherwise(pick(0.75, 0.25)).alias("ratio"))


@query("SELECT event_id, w, h, ceil(w * greatest(512.0::DOUBLE / w, 384.0::DOUBLE / h))::BIGINT AS rw, ceil(h * greatest(512.0::DOUBLE / w, 384.0::DOUBLE / h))::BIGINT AS rh, floor((ceil(w * greatest(512.0::DOUBLE / w, 384.0::DOUBLE / h)) - 512) / 2)::BIGINT AS cx FROM (SELECT event_id, 200 + event_id % 900 AS w, 200 + event_id * 7 % 900 AS h FROM events)")
def crop_geometry(spark, folder):
    """Resize so that a target fits, then crop its centre."""
    rows = read_table(spark, folder, "events").select("event_id", (200 + F.pmod("event_id", F.lit(900))).alias("w"), (200 + F.pmod(F.col("event_id") * 7, F.lit(900))).alias("h"))
    scale = F.greatest(512.0 / F.col("w"), 384.0 / F.col("h"))
    rw, rh = F.ceil(F.col("w") * scale), F.ceil(F.col("h") * scale)
    return rows.select("event_id", "w", "h", rw.alias("rw"), rh.alias("rh"), F.floor((rw - 512) / 2).alias("cx"))


@query(f"""
WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat(vec_id, ':42')), vec_id) AS rk FROM embeddings),
l AS (SELECT vec_id FROM r WHERE rk > 20 ORDER BY md5(concat(vec_id, ':42')), vec_id LIMIT greatest(0, 250 - (SELECT count(*) FROM r WHERE rk <= 20)))
SELECT vec_id FROM r WHERE rk <= 20 UNION ALL SELECT vec_id FROM l""")
def balanced_sample(spark, folder):
    """Up to 20 a label, filled up to 250 from what is left."""
    ranked = sampling.stratum_rank(read_table(spark, folder, "embeddings").select("vec_id", "label"), ["label"], "vec_id")
    first = ranked.where("_rank <= 20")
    rest = ranked.where("_rank > 20").orderBy(T.hash_order(F.col("vec_id")), "vec_id").limit(max(0, 250 - first.count()))
    return first.select("vec_id").unionByName(rest.select("vec_id"))


@query("SELECT a.item_id AS id_a, b.item_id AS id_b, levenshtein(a.text, b.text)::INT AS edits FROM benchmark_stage a JOIN benchmark_stage b ON a.item_id < b.item_id AND abs(length(a.text) - length(b.text)) <= 0.1 * greatest(length(a.text), length(b.text)) WHERE levenshtein(a.text, b.text) < 0.1 * greatest(length(a.text), length(b.text))".replace("length(a.text) - length(b.text)", "length(a.text)::INT - length(b.text)::INT"))
def edit_distance_pairs(spark, folder):
    """Pairs within a tenth of their length in edits."""
    return edits.pairs_within_a_tenth(read_table(spark, folder, "benchmark_stage"), "item_id", "text")


def hashing_embedder(width: int = 64):
    """A deterministic stand-in for a sentence model: signed hashed word counts, unit length. An iterator of
    Arrow batches, so that a real model would be loaded once a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, width), np.float32)
            for i, text in enumerate(batch.column(1).to_pylist()):
                for word in (text or "").lower().split():
                    h = xxhash.xxh64_intdigest(word)
                    out[i, h % width] += 1.0 if h >> 63 else -1.0
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)
            flat = pa.array(out.ravel())
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * width, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["row_id", "embedding"])

    return run


@query(None)
def text_embeddings(spark, folder):
    return read_table(spark, folder, "metadata_10").select("row_id", "text").mapInArrow(hashing_embedder(), "row_id bigint, embedding array<float>")


_GAPS = """
g AS (SELECT s.code AS subject, t.code AS style, s.ord AS so, t.ord AS sto, lower(s.label) AS sl, lower(t.label) AS tl FROM taxonomy s CROSS JOIN taxonomy t WHERE s.axis = 'subject' AND t.axis = 'style'),
c AS (SELECT g.*, count(m.row_id) AS n FROM g LEFT JOIN metadata_10 m ON m.subject = g.subject AND m.style = g.style GROUP BY ALL),
need AS (SELECT *, 100 - n AS need FROM c WHERE n < 100 ORDER BY need DESC, so, sto LIMIT 20),
m AS (SELECT subject, style, sl, tl, unnest(range(1, least(need, 25) + 1)) AS number FROM need),
u AS (SELECT *, ('0x' || left(md5(concat(subject, '-', style, '-', number, ':42')), 7))::BIGINT / 268435456.0::DOUBLE AS u FROM m)"""
_GAP_CAMERA = "CASE " + " ".join(f"WHEN u < {0.7 + i * 0.3 / 7!r}::DOUBLE THEN 'C{i + 1}'" for i in range(7)) + " ELSE 'C8' END"


def _gap_rows(spark, folder):
    """The cells of the coverage's gaps with their labels, one row for each prompt wanted, 25 a cell at most."""
    gaps = report.gaps(report.coverage_grid(read_table(spark, folder, "metadata_10"), read_table(spark, folder, "taxonomy")), 100)
    names = read_table(spark, folder, "taxonomy")
    label = lambda axis, c: F.broadcast(names.where(F.col("axis") == axis).select(F.col("code").alias(c), F.lower("label").alias(f"{c}_label")))
    rows = gaps.join(label("subject", "subject"), "subject").join(label("style", "style"), "style")
    each = F.explode(F.sequence(F.lit(1), F.least(F.col("need"), F.lit(25)).cast("int"))).alias("number")
    return rows.select("subject", "style", "subject_label", "style_label", each)


@query(f"WITH {_GAPS} SELECT subject, style, {_GAP_CAMERA} AS camera, number || '. ' || sl || ' in the manner of ' || tl AS text FROM u")
def gap_prompts(spark, folder):
    """Template prompts for the coverage's gaps: a deterministic stand-in for a generating model, 25 a batch."""
    made = _gap_rows(spark, folder)
    key = F.concat_ws("-", "subject", "style", F.col("number").cast("string"))
    camera = sampling.weighted_pick(key, [("C1", 0.7), *[(f"C{i}", 0.3 / 7) for i in range(2, 9)]])
    return made.select("subject", "style", camera.alias("camera"), F.format_string("%d. %s in the manner of %s", "number", "subject_label", "style_label").alias("text"))


@query(f"WITH {_GAPS} SELECT subject, style, lang, replace(replace(CASE WHEN lang = 'zh' THEN '{{a}}，以{{b}}的风格' ELSE '{{a}} in the manner of {{b}}' END, '{{a}}', sl), '{{b}}', tl) AS text FROM (SELECT *, CASE WHEN number > least(need, 25) - floor(least(need, 25) * 0.3) THEN 'zh' ELSE 'en' END AS lang FROM m JOIN need USING (subject, style, sl, tl))")
def gap_prompts_by_language(spark, folder):
    """Three tenths of a cell's prompts in Chinese, asked of a model that fails now and then and is asked again."""
    made = _gap_rows(spark, folder)
    window = Window.partitionBy("subject", "style")  # 25 rows at most
    rows = made.withColumn("most", F.count(F.lit(1)).over(window))
    rows = rows.withColumn("lang", F.when(F.col("number") > F.col("most") - F.floor(F.col("most") * 0.3), "zh").otherwise("en"))
    asked = rows.select("subject", "style", "lang", F.to_json(F.struct("subject_label", "style_label", "lang")).alias("request"))
    return generate.generated(asked, "request", template_model, "text", pause=0.0).select("subject", "style", "lang", "text")


def template_model():
    """A model that fills templates; every third call fails, as one behind a network would."""
    import json

    calls = [0]

    def answer(request: str) -> str:
        calls[0] += 1
        if calls[0] % 3 == 0:
            raise TimeoutError("try again")
        r = json.loads(request)
        form = "{}，以{}的风格" if r["lang"] == "zh" else "{} in the manner of {}"
        return form.format(r["subject_label"], r["style_label"])

    return answer


@query("""
WITH p AS (SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // 64 AS batch FROM metadata_10)
SELECT batch::BIGINT AS batch, list(row_id ORDER BY row_id) AS ids, count(*) AS n FROM p GROUP BY batch HAVING count(*) = 64""")
def collated_batches(spark, folder):
    """Rows gathered into batches of a fixed size."""
    rows = sampling.batches(read_table(spark, folder, "metadata_10").select("row_id", "text"), [F.col("row_id")], 64, drop_last=True)
    return rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("row_id", "text"))).alias("rows")).select("batch", F.col("rows.row_id").alias("ids"), F.size("rows").alias("n"))


@query(None)
def projected_vectors(spark, folder):
    """Two principal components: the deterministic stand-in for a neighbour embedding."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = read_table(spark, folder, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).select("vec_id", vector_to_array("p").alias("xy"))


@query("""
WITH r AS (SELECT vec_id, embedding, label < 5 AS side, ('0x' || left(md5(concat(vec_id, ':42')), 2))::INT % 3 AS subset FROM embeddings),
p AS (SELECT a.subset, a.side AS sa, b.side AS sb, a.vec_id = b.vec_id AS same, power(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / 64 + 1, 3) AS k FROM r a JOIN r b ON a.subset = b.subset),
m AS (SELECT subset, avg(k) FILTER (sa AND sb AND NOT same) + avg(k) FILTER (NOT sa AND NOT sb AND NOT same) - 2 * avg(k) FILTER (sa AND NOT sb) AS mmd FROM p GROUP BY subset)
SELECT round(avg(mmd), 6) AS kid_mean, round(stddev_pop(mmd), 6) AS kid_std FROM m""")
def kernel_distance_summary(spark, folder):
    subset = F.conv(F.substring(T.hash_order(F.col("vec_id")), 1, 2), 16, 10).cast("int") % 3
    found = vectors.poly_mmd(read_table(spark, folder, "embeddings"), "embedding", F.col("label") < 5, subset, 64)
    return found.agg(F.round(F.avg("mmd"), 6).alias("kid_mean"), F.round(F.stddev_pop("mmd"), 6).alias("kid_std"))


_DRAWN = """
s AS (SELECT vec_id, embedding::DOUBLE[] AS v, label < 5 AS side, unnest(range(0, 100)) AS subset FROM embeddings),
d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY side, subset ORDER BY md5(concat(vec_id, ':', subset)), vec_id) <= 100),
k AS (SELECT a.subset, a.side AS sa, b.side AS sb, a.vec_id = b.vec_id AS same, power(list_inner_product(a.v, b.v) / 64 + 1, 3) AS k FROM d a JOIN d b ON a.subset = b.subset),
m AS (SELECT subset, avg(k) FILTER (sa AND sb AND NOT same) + avg(k) FILTER (NOT sa AND NOT sb AND NOT same) - 2 * avg(k) FILTER (sa AND NOT sb) AS mmd FROM k GROUP BY subset)"""


@query(f"WITH {_DRAWN} SELECT subset::INT AS subset, round(mmd, 6) AS mmd FROM m")
def kernel_distance_subsets(spark, folder):
    """The cubic-kernel discrepancy of a hundred subsets, each of a hundred rows a side (all, if there are fewer)."""
    found = vectors.subset_mmd(read_table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("label") < 5, 64)
    return found.select("subset", F.round("mmd", 6).alias("mmd"))


@query(f"WITH {_DRAWN} SELECT round(avg(mmd), 6) AS kid_mean, round(stddev_pop(mmd), 6) AS kid_std FROM m")
def kernel_distance_drawn(spark, folder):
    found = vectors.subset_mmd(read_table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("label") < 5, 64)
    return found.agg(F.round(F.avg("mmd"), 6).alias("kid_mean"), F.round(F.stddev_pop("mmd"), 6).alias("kid_std"))


@query("SELECT vec_id, label::INT AS label FROM embeddings")
def aligned_columns(spark, folder):
    """Two tables of the same number of rows put side by side by position, their counts compared first."""
    rows = read_table(spark, folder, "embeddings")
    return sampling.aligned(rows.select("vec_id"), rows.select(F.col("vec_id").alias("place"), F.col("label").cast("int").alias("label")), ["vec_id"], ["place"]).select("vec_id", "label")


@query("""
SELECT strftime(w, '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 12 HOUR]) AS w FROM events) GROUP BY 1, 2""")
def sliding_windows(spark, folder):
    rows = streams.event_time(read_table(spark, folder, "events"), "ts")
    counts = rows.groupBy(F.window("ts", "1 day", "12 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


@query("""
WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 12 HOUR]) AS w FROM events)
SELECT strftime(w, '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM w WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def streamed_sliding(spark, folder):
    """Closed windows of a day, every twelve hours."""
    counts = streams.windowed_counts(_stream(spark, folder, "events"), "ts", ["event_type"], F.window("ts", "1 day", "12 hours"), "1 hour")
    return _run(counts, "append").select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


@query(f"WITH RECURSIVE {FOLD.format(order='event_id')} SELECT user_id AS key, event_id AS o, skip FROM f")
def streamed_skips(spark, folder):
    found = streams.threshold_skips(_stream(spark, folder, "events").where("value is not null"), "user_id", "event_id", "value", 150.0)
    return _run(found, "append")


# --- star schema (extension) ---


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def star_pricing(spark, folder):
    rows = read_table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n")
    )


@query("""
SELECT n_name, CASE WHEN grouping(o_orderpriority) = 1 THEN 'ALL' ELSE o_orderpriority END AS priority, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, ROLLUP (o_orderpriority)""")
def star_rollup(spark, folder):
    t = lambda n: read_table(spark, folder, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = rows.groupingSets([["n_name", "o_orderpriority"], ["n_name"]], "n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping("o_orderpriority").alias("g"))
    return out.select("n_name", F.when(F.col("g") == 1, "ALL").otherwise(F.col("o_orderpriority")).alias("priority"), "orders", "total")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def star_except(spark, folder):
    return read_table(spark, folder, "customer").select("c_custkey").exceptAll(read_table(spark, folder, "orders").where("o_totalprice > 100000").select("o_custkey").distinct()).distinct()


@query("SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def star_intersect(spark, folder):
    return read_table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation")).intersect(read_table(spark, folder, "customer").select("c_nationkey"))


@query("""
SELECT o.o_orderkey, e.n AS events FROM (SELECT o_orderkey, o_custkey % 150 AS u FROM orders) o FULL OUTER JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e ON o.u = e.user_id""")
def star_full_outer_whole(spark, folder):
    return _orders_and_events(spark, folder)


def _orders_and_events(spark, folder):
    counts = read_table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    orders = read_table(spark, folder, "orders").select("o_orderkey", F.pmod("o_custkey", F.lit(150)).alias("user_id"))
    return orders.join(counts, "user_id", "full").select("o_orderkey", "events")


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber, rk, round(running, 2) AS running FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER w AS rk, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS running FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber)) WHERE rk <= 5""")
def star_windows(spark, folder):
    window = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    rows = read_table(spark, folder, "lineitem").withColumn("rk", F.row_number().over(window).cast("bigint")).withColumn("running", F.sum("l_quantity").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("rk <= 5").select("l_suppkey", "l_orderkey", "l_linenumber", "rk", F.round("running", 2).alias("running"))
