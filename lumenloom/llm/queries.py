"""The pN_ queries, each over its whole tables with production parameters, and their SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions.text import bare
from lumenloom.llm import cross_split, format_dups, language, mixing, mojibake, near_dup, packing, quota_sample, tokens
from lumenloom.session import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_dup.near_duplicate_groups(read_table(spark, folder, "metadata_10"), "row_id", "text")
    return groups.where("member_id <> group_id").select(F.col("group_id").alias("group_row_id"), F.col("member_id").alias("row_id"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cross_split.cross_split_pairs(read_table(spark, folder, "metadata_10"), "row_id", "text", "split")
    return pairs.select(F.least("eval_id", "train_id").alias("row_id_a"), F.greatest("eval_id", "train_id").alias("row_id_b"))


def p2_overlap_report(spark: SparkSession, folder: str) -> DataFrame:
    records = read_table(spark, folder, "metadata_10")
    pairs = cross_split.cross_split_pairs(records, "row_id", "text", "split")
    return cross_split.overlap_report(pairs, records, "row_id", "split", "source")


def _train(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "metadata_10").where("split = 'train'")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    report = quota_sample.quota_report(_train(spark, folder), "row_id", read_table(spark, folder, "sample_plan"))
    return report.where("exhausted").select("plan_id", "axis", "code")


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    return quota_sample.quota_sample(_train(spark, folder), "row_id", read_table(spark, folder, "sample_plan")).withColumnRenamed("id", "row_id")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """What each target asks for, what is there and what the sample takes; ``unmet`` where the sample falls short of
    the target, because the code is exhausted or because the targets of other axes stand against it."""
    report = quota_sample.quota_report(_train(spark, folder), "row_id", read_table(spark, folder, "sample_plan"))
    wanted = F.greatest(F.expr("target_permille * sample_rows div 1000"), F.col("min_rows"))
    return report.withColumn("unmet", F.col("rows_sampled") < wanted)


def _language_model(spark: SparkSession, folder: str) -> language.Model:
    samples = read_table(spark, folder, "lang_samples").select("lang", F.col("sample_text").alias("text"))
    forms = read_table(spark, folder, "lang_forms").select("label_form", F.col("lang").alias("named"))
    records = read_table(spark, folder, "metadata_10").select(F.col("row_id").alias("id"), F.col("lang").alias("label_form"), "text")
    labelled = records.join(F.broadcast(forms), "label_form").select("id", F.col("named").alias("lang"), "text")
    return language.train(samples, labelled)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    cases = language.label_cases(read_table(spark, folder, "metadata_10"), "row_id", "text", "lang", read_table(spark, folder, "lang_forms"), _language_model(spark, folder))
    return cases.withColumnRenamed("id", "row_id")


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    found = language.language_segments(read_table(spark, folder, "metadata_10"), "row_id", "text", _language_model(spark, folder))
    return found.withColumnRenamed("id", "row_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    report = mixing.mix_report(_train(spark, folder), "row_id", "text", "source", read_table(spark, folder, "mix_plan"))
    return report.where("out_of_reach").select("mix_id", "source")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    report = mixing.mix_report(_train(spark, folder), "row_id", "text", "source", read_table(spark, folder, "mix_plan"))
    return report.select("mix_id", "source", "budget", "wanted", "have")


def p5_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sample(_train(spark, folder), "row_id", "text", "source", read_table(spark, folder, "mix_plan")).withColumnRenamed("id", "row_id")


def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mixes really reach, from their records."""
    train = _train(spark, folder)
    mix = mixing.mix_sample(train, "row_id", "text", "source", read_table(spark, folder, "mix_plan"))
    return mixing.reached(mix, train, "row_id", "text", "source")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    copies = format_dups.format_copies(read_table(spark, folder, "metadata_10"), "row_id", "text", "source")
    return copies.where("id <> first_id").select(F.col("first_id").alias("first_row_id"), F.col("id").alias("row_id"))


def _sliced(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, Column]]:
    forms = read_table(spark, folder, "lang_forms").select(F.col("label_form").alias("lang"), F.col("lang").alias("named"))
    records = read_table(spark, folder, "metadata_10").select("text", "source", "subject", "lang", "split")
    slices = {"source": bare(F.col("source")), "lang": F.col("named"), "subject": quota_sample.code(F.col("subject"))}
    return records.join(F.broadcast(forms), "lang", "left"), slices  # a fixed list of labels


def p7_cube(spark: SparkSession, folder: str) -> DataFrame:
    records, slices = _sliced(spark, folder)
    return tokens.TokenLedger(spark).update(records, "text", slices)


def p7_documents(spark: SparkSession, folder: str) -> DataFrame:
    return p7_cube(spark, folder).select("source", "lang", "subject", "documents")


def p7_updated(spark: SparkSession, folder: str) -> DataFrame:
    """The cube of the whole table, then that of its train records in trimmed texts, by deltas from the first."""
    records, slices = _sliced(spark, folder)
    ledger = tokens.TokenLedger(spark)
    ledger.update(records, "text", slices)
    return tokens.TokenLedger(spark, ledger.home).update(records.where("split = 'train'").withColumn("text", F.trim("text")), "text", slices)


def p7_updated_documents(spark: SparkSession, folder: str) -> DataFrame:
    return p7_updated(spark, folder).select("source", "lang", "subject", "documents")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(read_table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.decode_rows(p8_ids(spark, folder), "doc_id").withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(read_table(spark, folder, "documents"), "doc_id", "text", read_table(spark, folder, "pack_specs"), only="window_4k")
    return packed.where("pieces > 1").select(F.col("id").alias("doc_id")).distinct()


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    specs = read_table(spark, folder, "pack_specs")
    return packing.fill_report(packing.pack_documents(read_table(spark, folder, "documents"), "doc_id", "text", specs), specs)


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    # a fixed table of clean texts, a few hundred rows
    samples = [r[0] for r in read_table(spark, folder, "lang_samples").select("sample_text").where("sample_text is not null").orderBy("sample_id").collect()]
    return mojibake.repair(read_table(spark, folder, "documents"), "doc_id", "text", samples).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder).select("doc_id")


def p10_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p2_found, p2_overlap_report, p3_found, p3_sample, p3_report, p4_found, p4_segments, p5_found, p5_report, p5_mix, p5_shares, p6_found, p7_cube, p7_documents, p7_updated, p7_updated_documents, p8_ids, p8_decoded, p9_found, p9_fill, p10_found, p10_repaired)
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_overlap_report": P2_OVERLAP, "p3_found": P3_FOUND, "p5_found": P5_FOUND, "p5_report": P5_REPORT, "p5_mix": P5_MIX, "p5_shares": P5_SHARES, "p6_found": P6_FOUND, "p7_documents": P7_DOCUMENTS, "p7_updated_documents": P7_DOCUMENTS.replace("TRUE", "split = 'train'"), "p8_decoded": P8_DECODED}


_ITEMS = r"""
low AS (SELECT row_id, split, source, text, lower(text) AS t FROM metadata_10 WHERE text IS NOT NULL),
w AS (SELECT row_id, split, unnest(list_distinct(list_concat(
  regexp_extract_all(regexp_replace(t, '[\x{4e00}-\x{9fff}]+', ' ', 'g'), '[\p{L}\p{N}]+'),
  flatten(list_transform(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))))) AS item FROM low),
s AS (SELECT row_id, count(*) AS n FROM w GROUP BY row_id HAVING count(*) >= 5)"""
P1_FOUND = f"""
WITH RECURSIVE {_ITEMS},
p AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS o FROM w a JOIN w b ON a.item = b.item AND a.row_id < b.row_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN s x ON x.row_id = a JOIN s y ON y.row_id = b WHERE o * 10 >= 7 * (x.n + y.n - o)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT min(b) AS group_row_id, a AS row_id FROM reach GROUP BY a HAVING min(b) < a"""
P2_FOUND = f"""
WITH {_ITEMS},
p AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS o FROM w a JOIN w b ON a.item = b.item AND a.split IN ('val', 'test') AND b.split = 'train' GROUP BY 1, 2)
SELECT least(a, b) AS row_id_a, greatest(a, b) AS row_id_b FROM p JOIN s x ON x.row_id = a JOIN s y ON y.row_id = b WHERE o * 10 >= 7 * (x.n + y.n - o)"""
P2_OVERLAP = f"""
WITH {_ITEMS},
p AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS o FROM w a JOIN w b ON a.item = b.item AND a.split IN ('val', 'test') AND b.split = 'train' GROUP BY 1, 2),
found AS (SELECT a, b FROM p JOIN s x ON x.row_id = a JOIN s y ON y.row_id = b WHERE o * 10 >= 7 * (x.n + y.n - o))
SELECT m.split, regexp_replace(lower(m.source), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS source, count(DISTINCT a) AS overlapping, count(*) AS pairs FROM found JOIN metadata_10 m ON m.row_id = a GROUP BY 1, 2"""
_BARE = r"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_PIECES = r"list_filter(regexp_split_to_array(text, '[;|\n\r]'), lambda x: regexp_matches(x, '\S'))"
P6_FOUND = f"""
WITH {_ITEMS},
f AS (SELECT row_id, source, text, CASE WHEN json_valid(text) AND json_type(text) = 'OBJECT' THEN 'json'
  WHEN len({_PIECES}) >= 3 AND list_bool_and(list_transform({_PIECES}, lambda x: length(x) - length(replace(x, ':', '')) = 1)) THEN 'pieces' ELSE 'plain' END AS kind
  FROM low JOIN s USING (row_id) WHERE source IS NOT NULL),
k AS (SELECT row_id, {_BARE.format(x='source')} AS source, CASE kind
  WHEN 'plain' THEN 'plain ' || {_BARE.format(x='text')}
  WHEN 'pieces' THEN 'named ' || list_sort(list_distinct(list_transform({_PIECES}, lambda x: {_BARE.format(x="split_part(x, ':', 1)")} || ':' || {_BARE.format(x="split_part(x, ':', 2)")})))::VARCHAR
  ELSE 'named ' || list_sort(list_distinct(list_transform(json_keys(text), lambda x: {_BARE.format(x='x')} || ':' || {_BARE.format(x="json_extract_string(text, '$.' || chr(34) || x || chr(34))")})))::VARCHAR END AS key FROM f),
g AS (SELECT row_id, min(row_id) OVER (PARTITION BY source, key) AS first_row_id FROM k)
SELECT first_row_id, row_id FROM g WHERE first_row_id < row_id"""


P3_FOUND = """
WITH train AS (SELECT * FROM metadata_10 WHERE split = 'train'),
codes AS (
  SELECT 'subject' AS axis, upper(trim(subject)) AS code FROM train
  UNION ALL SELECT 'style', upper(trim(style)) FROM train
  UNION ALL SELECT 'camera', upper(trim(camera)) FROM train),
counts AS (SELECT axis, code, count(*) AS n FROM codes GROUP BY axis, code)
SELECT p.plan_id, p.axis, p.code
FROM sample_plan p LEFT JOIN counts c ON c.axis = p.axis AND c.code = upper(trim(p.code))
WHERE coalesce(c.n, 0) * 1000 < p.target_permille * (p.sample_permille * (SELECT count(*) FROM train) // 1000)
"""

_MIX = """
WITH train AS (
  SELECT regexp_replace(lower(source), '[^\\p{L}\\p{N}]', '', 'g') AS name, length(text) AS size
  FROM metadata_10 WHERE split = 'train' AND text IS NOT NULL),
have AS (SELECT name, sum(size)::BIGINT AS have FROM train GROUP BY name),
total AS (SELECT sum(size)::BIGINT AS total FROM train),
plan AS (
  SELECT p.*, (p.budget_permille * t.total // 1000)::BIGINT AS budget, coalesce(h.have, 0)::BIGINT AS have
  FROM mix_plan p CROSS JOIN total t
  LEFT JOIN have h ON h.name = regexp_replace(lower(p.source), '[^\\p{L}\\p{N}]', '', 'g'))
"""
P5_FOUND = _MIX + "SELECT mix_id, source FROM plan WHERE have * max_repeats * 1000 < target_permille * budget"
_MIXED = _MIX + """,
goals AS (SELECT mix_id, regexp_replace(lower(source), '[^\\p{L}\\p{N}]', '', 'g') AS name, have, least(target_permille * budget // 1000, have * max_repeats) AS goal FROM plan WHERE have > 0),
r AS (SELECT row_id, regexp_replace(lower(source), '[^\\p{L}\\p{N}]', '', 'g') AS name, length(text) AS size, left(md5(concat(row_id, ':7')), 15) AS draw FROM metadata_10 WHERE split = 'train' AND text IS NOT NULL),
w AS (SELECT g.*, r.row_id, r.size, sum(r.size) OVER (PARTITION BY g.mix_id, g.name ORDER BY r.draw, r.row_id, r.size ROWS UNBOUNDED PRECEDING) AS run FROM goals g JOIN r USING (name)),
mix AS (SELECT mix_id, name, row_id, size, goal // have + CASE WHEN goal % have > 0 AND run <= goal % have THEN 1 ELSE 0 END AS copies FROM w)
"""
P5_MIX = _MIXED + "SELECT mix_id, row_id, copies::BIGINT AS copies FROM mix WHERE copies > 0"
P5_SHARES = _MIXED + """, s AS (SELECT mix_id, name AS source, count(*) AS records, sum(size * copies)::BIGINT AS size FROM mix WHERE copies > 0 GROUP BY 1, 2)
SELECT mix_id, source, records, size, size * 1000.0::DOUBLE / sum(size) OVER (PARTITION BY mix_id) AS permille FROM s"""
P5_REPORT = _MIX + "SELECT mix_id, source, budget, target_permille * budget // 1000 AS wanted, have FROM plan"
P7_DOCUMENTS = f"""
SELECT {_BARE.format(x='source')} AS source, f.lang AS lang, upper(trim(coalesce(subject, ''))) AS subject, count(*) AS documents
FROM metadata_10 m LEFT JOIN lang_forms f ON m.lang = f.label_form WHERE TRUE GROUP BY 1, 2, 3"""
P8_DECODED = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
