"""Queries on the prompt corpus: cleaning, filters, dedup, classification, reports, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom import schema
from lumenloom.functions import text as T
from lumenloom.operators import classify as C
from lumenloom.operators import dedup, filters, report, sampling
from lumenloom.operators.components import connected_components
from lumenloom.operators.skew import join_skewed
from lumenloom.plans.registry import query
from lumenloom.session import read_table

# --- SQL fragments that the oracles share ---
STRIP = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
STEXT = STRIP.format(t="text")
WORDS = r"len(list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> ''))"
WTEXT = WORDS.format(t="text")
URLS = "len(regexp_extract_all(text, 'https?://'))"
PHRASES = "|".join(T.BOILERPLATE)
SHARE = rf"(length(regexp_replace({STEXT}, '[^\p{{L}}\s]', '', 'g')) / greatest(length({STEXT}), 1))"
QUALITY = rf"""coalesce({STEXT} <> '' AND (CASE WHEN lang = 'zh' THEN length({STEXT}) >= 15 ELSE {WTEXT} BETWEEN 8 AND 200 END)
  AND {URLS} < 2 AND NOT regexp_matches(lower(text), '{PHRASES}') AND {SHARE} >= 0.7, false)"""
HASH = "md5(concat(row_id, ':{seed}'))"
# Words that count as visual detail.
VISUAL = ["red", "blue", "green", "golden", "marble", "wooden", "glass", "dramatic", "soft", "ambient", "neon", "sunset", "shadow", "reflection", "texture", "metallic", "matte"]
VISUAL_SQL = ",".join(f"'{w}'" for w in VISUAL)


def _meta(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "metadata_10")


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "raw_harvest")


@query(f"""
WITH first AS (SELECT * FROM metadata_10 QUALIFY row_number() OVER (PARTITION BY lower({STEXT}) ORDER BY row_id) = 1)
SELECT source, lang, count(*) AS n FROM first WHERE {QUALITY} GROUP BY source, lang""")
def curation_coverage(spark, folder):
    """Dedup before the filter (the first of equal texts claims the key even if it is then rejected), then coverage."""
    good = filters.quality(F.col("text"), F.col("lang"))
    rows = _meta(spark, folder).select("row_id", F.md5(dedup.exact_key(F.col("text"))).alias("key"), good.alias("good"), "source", "lang")
    kept = dedup.keep_first(rows, F.col("key"), [F.col("row_id")])  # the digest and the verdict travel, the text stays
    return kept.where("good").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT row_id FROM metadata_10 QUALIFY row_number() OVER (PARTITION BY lower({STEXT}) ORDER BY row_id) = 1")
def exact_dedup(spark, folder):
    keys = _meta(spark, folder).select("row_id", F.md5(dedup.exact_key(F.col("text"))).alias("key"))
    return keys.groupBy("key").agg(F.min("row_id").alias("row_id")).select("row_id")  # numbers and digests: hashed, not sorted


@query("SELECT row_id FROM metadata_10 QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1")
def exact_dedup_raw_key(spark, folder):
    return dedup.keep_first(_meta(spark, folder).select("row_id", "text"), F.col("text"), [F.col("row_id")]).select("row_id")


@query(r"""
SELECT row_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::BIGINT AS words,
  len(regexp_extract_all(text, 'https?://'))::BIGINT AS urls,
  round(length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) / greatest(length(text), 1), 6) AS han,
  regexp_matches(text, '[\x{4e00}-\x{9fff}]') AS has_han,
  round(length(regexp_replace(text, '[^\p{L}\s]', '', 'g')) / greatest(length(text), 1), 6) AS letters,
  regexp_matches(lower(text), '""" + PHRASES + r"""') AS boilerplate
FROM metadata_10""")
def text_profile(spark, folder):
    t = F.col("text")
    return _meta(spark, folder).select(
        "row_id", T.word_count(t).alias("words"), T.url_count(t).alias("urls"), F.round(T.han_share(t), 6).alias("han"), T.has_han(t).alias("has_han"),
        F.round(T.letter_share(t), 6).alias("letters"), T.any_of(t, T.BOILERPLATE).alias("boilerplate"),
    )


@query(r"""
SELECT row_id, len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+')))::BIGINT AS proper,
  len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[0-9]+')))::BIGINT AS numbers,
  len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w IN (@visual)))::BIGINT AS visual
FROM metadata_10""".replace("@visual", VISUAL_SQL))
def specificity(spark, folder):
    t = F.col("text")
    return _meta(spark, folder).select("row_id", T.proper_nouns(t).alias("proper"), T.numbers(t).alias("numbers"), T.listed_words(t, VISUAL).alias("visual"))


#: Source priors are a parameter; sources that aren't named count 0.3.
PRIORS = {"denseleaf": 0.75, "recapgrove": 0.5, "promptwell": 0.6, "shareview": 0.8, "handnotes": 1.0}


def quality_score(text, source, priors):
    """Word band (0.3, 0.15, 0) + 0.2 prior + 0.25 min(visual / 5, 1) + 0.25 min(specifics / 4, 1)."""
    n = T.word_count(text)
    band = F.when(n.between(15, 60), 0.3).when(n.between(10, 80), 0.15).otherwise(0.0)
    prior = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in priors.items() for x in kv]), source), F.lit(0.3))
    specifics = T.proper_nouns(text) + T.numbers(text)
    return band + 0.2 * prior + 0.25 * F.least(T.listed_words(text, VISUAL) / 5.0, F.lit(1.0)) + 0.25 * F.least(specifics / 4.0, F.lit(1.0))


@query(r"""
WITH p AS (SELECT row_id, source, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n,
  len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+') OR regexp_full_match(w, '[0-9]+'))) AS s,
  len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w IN (@visual))) AS v
  FROM metadata_10 WHERE text IS NOT NULL)
SELECT row_id, round((CASE WHEN n BETWEEN 15 AND 60 THEN 0.3::DOUBLE WHEN n BETWEEN 10 AND 80 THEN 0.15 ELSE 0 END)
  + 0.2::DOUBLE * (CASE source WHEN 'denseleaf' THEN 0.75::DOUBLE WHEN 'recapgrove' THEN 0.5 WHEN 'promptwell' THEN 0.6 WHEN 'shareview' THEN 0.8 WHEN 'handnotes' THEN 1.0 ELSE 0.3 END)
  + 0.25::DOUBLE * least(v / 5.0::DOUBLE, 1) + 0.25::DOUBLE * least(s / 4.0::DOUBLE, 1), 6) AS score FROM p""".replace("@visual", VISUAL_SQL))
def quality_scores(spark, folder):
    rows = _meta(spark, folder).where("text is not null")
    return rows.select("row_id", F.round(quality_score(F.col("text"), F.coalesce("source", F.lit("")), PRIORS), 6).alias("score"))


@query(f"SELECT row_id FROM metadata_10 WHERE {QUALITY}")
def quality_filter(spark, folder):
    return _meta(spark, folder).where(filters.quality(F.col("text"), F.col("lang"))).select("row_id")


@query("SELECT raw_id, source FROM raw_harvest WHERE coalesce(CASE WHEN isnan(prompt_nsfw) THEN 0 ELSE prompt_nsfw END, 0) <= 0.5")
def score_filter(spark, folder):
    return _raw(spark, folder).where(filters.safe(F.col("prompt_nsfw"))).select("raw_id", "source")


@query(f"SELECT raw_id, 'zh' AS lang FROM raw_harvest WHERE coalesce(length({STEXT}) >= 10 AND {URLS} < 2, false)")
def relaxed_han_filter(spark, folder):
    return _raw(spark, folder).where(filters.relaxed_han(F.col("text"))).select("raw_id", F.lit("zh").alias("lang"))


@query(f"SELECT item_id FROM benchmark_stage WHERE coalesce(CASE WHEN language = 'zh' THEN length({STEXT}) >= 4 ELSE {WTEXT} >= 5 END, false)")
def short_filter(spark, folder):
    return read_table(spark, folder, "benchmark_stage").where(filters.long_enough(F.col("text"), F.col("language"))).select("item_id")


@query(f"SELECT row_id FROM metadata_10 WHERE coalesce(CASE WHEN lang = 'zh' THEN length({STEXT}) >= 20 ELSE {WTEXT} BETWEEN 8 AND 150 END, false)")
def final_length_filter(spark, folder):
    return _meta(spark, folder).where(filters.final_length(F.col("text"), F.col("lang"))).select("row_id")


@query("""
SELECT item_id, coalesce(nullif(original_category, ''), nullif(source, ''), '') AS category, coalesce(language, 'en') AS lang FROM benchmark_stage""")
def first_filled_columns(spark, folder):
    rows = schema.normalise(read_table(spark, folder, "benchmark_stage"))
    return rows.select("item_id", schema.first_filled(F.col("original_category"), F.col("source")).alias("category"), "lang")


@query("""
WITH t AS (SELECT conv_id, caption, text, list_filter(turns, lambda x: coalesce(nullif(x.sender, ''), x.role, '') IN ('gpt', 'assistant')) AS a FROM conversation_source)
SELECT conv_id, coalesce(nullif(coalesce(nullif(a[1].utterance, ''), a[1].content), ''), nullif(caption, ''), nullif(text, ''), '') AS prompt FROM t""")
def first_assistant_turn(spark, folder):
    """Nested projection: the first turn of the assistant, under either naming, else caption, else text."""
    rows = read_table(spark, folder, "conversation_source")
    who = lambda x: F.coalesce(F.nullif(x["sender"], F.lit("")), x["role"], F.lit(""))
    mine = F.get(F.filter("turns", lambda x: who(x).isin("gpt", "assistant")), 0)
    said = F.coalesce(F.nullif(mine["utterance"], F.lit("")), mine["content"])
    return rows.select("conv_id", schema.first_filled(said, F.col("caption"), F.col("text")).alias("prompt"))


@query("SELECT path FROM manifest_files WHERE ends_with(path, '.json') OR starts_with(path, 'transformer')")
def affix_filter(spark, folder):
    return read_table(spark, folder, "manifest_files").where(F.endswith("path", F.lit(".json")) | F.startswith("path", F.lit("transformer"))).select("path")


@query("SELECT row_id FROM metadata_10 WHERE subject = 'S5' AND style = 'T1' AND source = 'denseleaf' AND lang = 'en' AND contains(lower(text), 'mountain')")
def browse_filter(spark, folder):
    rows = _meta(spark, folder).where("subject = 'S5' and style = 'T1' and source = 'denseleaf' and lang = 'en'")
    return rows.where(F.contains(F.lower("text"), F.lit("mountain"))).select("row_id")


@query(f"SELECT row_id, source FROM metadata_10 WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY {HASH.format(seed=42)}, row_id) <= 50")
def sample_per_source(spark, folder):
    return sampling.capped_each(_meta(spark, folder).where("source is not null").select("row_id", "source"), "source", "row_id", 50)


@query(r"""SELECT raw_id, regexp_replace(regexp_replace(text, '\s*--\w+\s+\S*', '', 'g'), '^\s+|\s+$', '', 'g') AS clean, source FROM raw_harvest""")
def strip_flags(spark, folder):
    return _raw(spark, folder).select("raw_id", T.without_flags(F.col("text")).alias("clean"), "source")


@query(r"""
SELECT row_id, len(CASE WHEN lang = 'zh' THEN list_transform(range(1, greatest(1, length(regexp_replace(text, '\s+', '', 'g')) - 2) + 1), lambda i: substr(text, i, 3))
  ELSE list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') END)::BIGINT AS tokens
FROM metadata_10 WHERE text IS NOT NULL""")
def token_counts(spark, folder):
    return _meta(spark, folder).where("text is not null").select("row_id", F.size(T.tokens(F.col("text"), F.col("lang"))).cast("bigint").alias("tokens"))


@query(r"""
WITH r AS (SELECT row_id, regexp_extract(regexp_replace(text, '^\s+|\s+$', '', 'g'), '(?is)^(?:the|this)\s+image\s+(?:displays?|shows?|features?|captures?|depicts?|presents?|is)\s+(.*)$', 1) AS rest FROM metadata_10
  WHERE regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '(?is)^(?:the|this)\s+image\s+(?:displays?|shows?|features?|captures?|depicts?|presents?|is)\s+'))
SELECT row_id, regexp_replace(CASE WHEN instr(rest, '. ') > 1 THEN left(rest, instr(rest, '. ') - 1) WHEN instr(rest, '.' || chr(10)) > 1 THEN left(rest, instr(rest, '.' || chr(10)) - 1) ELSE rest END, '^\s+|\s+$', '', 'g') AS sentence FROM r""")
def caption_sentences(spark, folder):
    return _meta(spark, folder).select("row_id", T.caption_sentence(F.col("text")).alias("sentence")).where("sentence is not null")


def _case(rules: dict[str, list[str]], default: str) -> str:
    arms = " ".join(f"WHEN {' OR '.join('contains(lower(text), ' + repr(k).replace(chr(34), chr(39)) + ')' if chr(39) not in k else 'contains(lower(text), ' + chr(39) + k.replace(chr(39), chr(39) * 2) + chr(39) + ')' for k in ks)} THEN '{c}'" for c, ks in rules.items())
    return f"(CASE {arms} ELSE '{default}' END)"


@query(f"SELECT row_id, {_case(C.STYLE_KEYWORDS, 'T1')} AS style_kw, {_case(C.CAMERA_KEYWORDS, 'C1')} AS camera_kw FROM metadata_10 WHERE text IS NOT NULL")
def keyword_style_camera(spark, folder):
    t = F.col("text")
    return _meta(spark, folder).where("text is not null").select("row_id", C.style(t).alias("style_kw"), C.camera(t).alias("camera_kw"))


#: Category names that name a subject; a parameter of the lookup.
CATEGORIES = {"people": "S1", "animals": "S2", "food": "S3", "indoor": "S4", "outdoor": "S5", "architecture": "S6", "vehicles": "S7", "plants": "S8", "fashion": "S9", "objects": "S10", "text": "S11", "abstract": "S14"}


@query("""
WITH rules AS (SELECT code, ord, list_transform(regexp_extract_all(label, '[A-Z]?[a-z]{3,}'), lambda w: regexp_replace(lower(w), 's$', '')) AS kws, label FROM taxonomy WHERE axis = 'subject'),
hit AS (SELECT b.item_id, min_by(r.code, r.ord) AS code FROM benchmark_stage b JOIN rules r ON len(list_filter(CASE WHEN len(r.kws) = 0 THEN [lower(r.label)] ELSE r.kws END, lambda k: contains(lower(b.text), k))) > 0 GROUP BY b.item_id)
SELECT b.item_id, coalesce(CASE lower(regexp_replace(b.original_category, '^\\s+|\\s+$', '', 'g')) """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORIES.items()) + """ END, h.code, 'S10') AS subject
FROM benchmark_stage b LEFT JOIN hit h USING (item_id)""")
def subject_lookup(spark, folder):
    """Dimension lookup by category, else keyword rules from the taxonomy's labels, else the default."""
    rules = C.rules_of(read_table(spark, folder, "taxonomy"), "subject")
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), F.coalesce(F.lower(T.strip(F.col("original_category"))), F.lit("")))
    return read_table(spark, folder, "benchmark_stage").select("item_id", C.subject(F.coalesce("text", F.lit("")), mapped, rules).alias("subject"))


@query("""
SELECT row_id, len(list_filter(['graphic design','poster','logo','infographic','typography','minimal','flat','icon','badge','emblem','sticker'], lambda k: contains(lower(text), k) AND k NOT IN ('minimal','flat','icon','typography','sticker','logo','badge','emblem'))) = 0 AS weak,
  regexp_matches(lower(text), '""" + "|".join(C.STRONG_DESIGN) + """') AS design, regexp_matches(lower(text), '""" + "|".join(C.STRONG_EXPERIMENTAL) + """') AS experimental
FROM metadata_10 WHERE text IS NOT NULL""")
def style_gates(spark, folder):
    t = F.col("text")
    rows = _meta(spark, folder).where("text is not null")
    return rows.select("row_id", C.weak_design(t).alias("weak"), T.any_of(t, C.STRONG_DESIGN).alias("design"), T.any_of(t, C.STRONG_EXPERIMENTAL).alias("experimental"))


_LETTERS = r"regexp_replace(lower(text), '[^\p{L}\p{N}]+', '-', 'g')"
_SLUG = rf"coalesce(nullif(regexp_replace(left(regexp_replace({_LETTERS}, '^-+|-+$', '', 'g'), 60), '^-+|-+$', '', 'g'), ''), 'prompt')"


@query(rf"SELECT item_id, {_SLUG} AS slug, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview, lpad(item_id::VARCHAR, 6, '0') || '.png' AS name FROM benchmark_stage WHERE text IS NOT NULL")
def names_and_previews(spark, folder):
    rows = read_table(spark, folder, "benchmark_stage").where("text is not null")
    t = F.col("text")
    return rows.select("item_id", T.slug(t).alias("slug"), T.preview(t).alias("preview"), F.concat(T.padded(F.col("item_id"), 6), F.lit(".png")).alias("name"))


@query(r"""
WITH l AS (SELECT raw_id, unnest(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS line FROM raw_harvest WHERE text IS NOT NULL)
SELECT raw_id, regexp_replace(line, '^\d+[\.\)\-]\s*', '') AS line FROM l WHERE line <> '' AND NOT starts_with(line, '#')""")
def generated_lines(spark, folder):
    return _raw(spark, folder).where("text is not null").select("raw_id", F.explode(T.generated_lines(F.col("text"))).alias("line"))


@query("SELECT doc_id, md5(text) AS digest, printf('%.2f GB', octet_length(encode(text)) / 1073741824) AS size FROM documents WHERE text IS NOT NULL")
def content_digests(spark, folder):
    rows = read_table(spark, folder, "documents").where("text is not null")
    return rows.select("doc_id", F.md5("text").alias("digest"), T.gigabytes(F.octet_length("text")).alias("size"))


# --- reports ---


@query("""
WITH g AS (SELECT s.code AS subject, t.code AS style FROM taxonomy s CROSS JOIN taxonomy t WHERE s.axis = 'subject' AND t.axis = 'style')
SELECT g.subject, g.style, count(m.row_id) AS n FROM g LEFT JOIN metadata_10 m ON m.subject = g.subject AND m.style = g.style GROUP BY g.subject, g.style""")
def coverage_grid(spark, folder):
    return report.coverage_grid(_meta(spark, folder), read_table(spark, folder, "taxonomy")).select("subject", "style", "n")


@query("""
WITH g AS (SELECT s.code AS subject, s.ord AS so, t.code AS style, t.ord AS sto FROM taxonomy s CROSS JOIN taxonomy t WHERE s.axis = 'subject' AND t.axis = 'style'),
c AS (SELECT g.*, count(m.row_id) AS n FROM g LEFT JOIN metadata_10 m ON m.subject = g.subject AND m.style = g.style GROUP BY ALL)
SELECT subject, style, 100 - n AS need FROM c WHERE n < 100 ORDER BY need DESC, so, sto LIMIT 20""")
def coverage_gaps(spark, folder):
    return report.gaps(report.coverage_grid(_meta(spark, folder), read_table(spark, folder, "taxonomy")), 100)


@query("""
SELECT CASE WHEN grouping(subject) = 1 THEN 'ALL' ELSE subject END AS subject, CASE WHEN grouping(style) = 1 THEN 'ALL' ELSE style END AS style, count(*) AS n
FROM metadata_10 GROUP BY CUBE (subject, style)""")
def coverage_margins(spark, folder):
    return report.margins(_meta(spark, folder))


@query("SELECT subject, " + ", ".join(f"count(*) FILTER (style = 'T{i}') AS T{i}" for i in range(1, 8)) + ", count(*) FILTER (style IN ('T1','T2','T3','T4','T5','T6','T7')) AS total FROM metadata_10 GROUP BY subject")
def coverage_pivot(spark, folder):
    return report.pivoted(_meta(spark, folder), [f"T{i}" for i in range(1, 8)])


@query("SELECT source AS value, count(*) AS n, min(row_id) AS first_seen FROM metadata_10 GROUP BY source")
def source_frequency(spark, folder):
    return report.frequency(_meta(spark, folder), "source", "row_id")


@query("SELECT style AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM metadata_10 GROUP BY style")
def style_shares(spark, folder):
    return report.shares(_meta(spark, folder), "style").withColumn("percent", F.round("percent", 6))


@query(rf"""
WITH w AS (SELECT *, {WTEXT} AS wc FROM metadata_10),
a AS (SELECT count(*) AS n, avg(CASE WHEN coalesce(lang, 'en') = 'en' THEN 1.0 ELSE 0 END) * 100 AS en, avg(CASE WHEN lang = 'zh' THEN 1.0 ELSE 0 END) * 100 AS zh, avg(CASE WHEN coalesce(lang, 'en') = 'en' THEN wc END) AS words FROM w),
c AS (SELECT count(*) AS populated, min(c) AS least, count(*) FILTER (c < 20) AS below FROM (SELECT count(*) AS c FROM metadata_10 GROUP BY subject, style)),
d AS (SELECT sum(c - 1) AS dups FROM (SELECT count(*) AS c FROM metadata_10 GROUP BY lower({STEXT}))),
s AS (SELECT max(c) AS top FROM (SELECT count(*) AS c FROM metadata_10 GROUP BY source)),
r AS (SELECT * FROM a, c, d, s)
SELECT 'rows' AS check, n::DOUBLE AS value, CASE WHEN n BETWEEN 950 AND 1000000 THEN 'PASS' ELSE 'WARN' END AS status FROM r
UNION ALL SELECT 'populated_cells', populated, CASE WHEN populated = 98 THEN 'PASS' ELSE 'WARN' END FROM r
UNION ALL SELECT 'min_cell', least, 'INFO' FROM r UNION ALL SELECT 'cells_below_floor', below, 'INFO' FROM r
UNION ALL SELECT 'en_percent', round(en, 6), 'INFO' FROM r UNION ALL SELECT 'zh_percent', round(zh, 6), 'INFO' FROM r
UNION ALL SELECT 'mean_en_words', round(words, 6), CASE WHEN words BETWEEN 30 AND 45 THEN 'PASS' ELSE 'INFO' END FROM r
UNION ALL SELECT 'duplicates', dups, CASE WHEN dups = 0 THEN 'PASS' ELSE 'WARN' END FROM r
UNION ALL SELECT 'max_source_percent', round(top * 100.0 / n, 6), CASE WHEN top * 100.0 / n <= 35 THEN 'PASS' ELSE 'WARN' END FROM r""")
def validation_report(spark, folder):
    return report.validation(_meta(spark, folder), 950, 1_000_000, 98, 20).withColumn("value", F.round("value", 6))


@query(rf"SELECT (floor({WTEXT} / 50) * 50)::BIGINT AS bucket, count(*) AS n FROM metadata_10 WHERE text IS NOT NULL GROUP BY 1")
def word_histogram(spark, folder):
    return report.histogram(_meta(spark, folder).where("text is not null"), T.word_count(F.col("text")), 50)


@query(r"""
SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS word FROM metadata_10) GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def top_words(spark, folder):
    return report.top_words(_meta(spark, folder), "text", 50)


@query(rf"SELECT source, subject, round(avg({WTEXT}), 6) AS mean_words, min({WTEXT})::BIGINT AS min_words, max({WTEXT})::BIGINT AS max_words FROM metadata_10 WHERE text IS NOT NULL GROUP BY source, subject")
def words_by_slice(spark, folder):
    n = T.word_count(F.col("text"))
    rows = _meta(spark, folder).where("text is not null")
    return rows.groupBy("source", "subject").agg(F.round(F.avg(n), 6).alias("mean_words"), F.min(n).alias("min_words"), F.max(n).alias("max_words"))


@query(f"""
WITH d AS (SELECT * FROM metadata_10 QUALIFY row_number() OVER (PARTITION BY lower({STEXT}) ORDER BY row_id) = 1), q AS (SELECT * FROM d WHERE {QUALITY})
SELECT 'input' AS stage, count(*) AS kept FROM metadata_10 UNION ALL SELECT 'deduplicated', count(*) FROM d UNION ALL SELECT 'filtered', count(*) FROM q""")
def stage_accounting(spark, folder):
    return report.dedup_accounting(_meta(spark, folder), F.md5(dedup.exact_key(F.col("text"))), "row_id", filters.quality(F.col("text"), F.col("lang")))


# --- samples and splits ---


@query("SELECT subject, style, row_id FROM metadata_10 QUALIFY row_number() OVER (PARTITION BY subject, style ORDER BY row_id) = 1")
def debug_split(spark, folder):
    return _meta(spark, folder).groupBy("subject", "style").agg(F.min("row_id").alias("row_id"))


@query(f"""SELECT row_id, subject FROM metadata_10 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY {HASH.format(seed=42)}, row_id) <= (SELECT floor(count(*) * 0.05) FROM metadata_10)""")
def subject_cap(spark, folder):
    return sampling.capped(_meta(spark, folder).select("row_id", "subject"), "subject", "row_id", 0.05)


@query(f"""
WITH r AS (SELECT row_id, subject, style, row_number() OVER (PARTITION BY subject, style ORDER BY {HASH.format(seed=42)}, row_id) AS rk, count(*) OVER (PARTITION BY subject, style) AS n FROM metadata_10),
a AS (SELECT *, greatest(1, round_even(n * 0.025::DOUBLE, 0)) AS t FROM r), b AS (SELECT *, CASE WHEN t + t >= n THEN least(t, greatest(1, n // 3)) ELSE t END AS k FROM a)
SELECT row_id, subject, style, CASE WHEN rk <= k THEN 'test' WHEN rk <= k + k THEN 'val' ELSE 'train' END AS part FROM b""")
def stratified_split(spark, folder):
    return sampling.stratified_split(_meta(spark, folder).select("row_id", "subject", "style"), ["subject", "style"], "row_id")


@query(f"""
WITH s AS (SELECT subject, style, camera, count(*) AS size FROM metadata_10 GROUP BY ALL),
a AS (SELECT *, greatest(1, round_even(size / sum(size) OVER () * 500, 0))::BIGINT AS alloc FROM s), o AS (SELECT *, sum(alloc) OVER () - 500 AS over FROM a),
t AS (SELECT *, CASE WHEN over > 0 THEN alloc > 1 ELSE alloc < size END AS can FROM o),
u AS (SELECT *, sum(can::INT) OVER (ORDER BY size DESC, subject NULLS FIRST, style NULLS FIRST, camera NULLS FIRST ROWS UNBOUNDED PRECEDING) AS turn FROM t),
q AS (SELECT subject, style, camera, alloc - CASE WHEN can AND turn <= abs(over) THEN sign(over) ELSE 0 END AS quota FROM u),
r AS (SELECT row_id, subject, style, camera, row_number() OVER (PARTITION BY subject, style, camera ORDER BY {HASH.format(seed=42)}, row_id) AS rk FROM metadata_10)
SELECT r.row_id FROM r JOIN q ON r.subject IS NOT DISTINCT FROM q.subject AND r.style IS NOT DISTINCT FROM q.style AND r.camera IS NOT DISTINCT FROM q.camera
ORDER BY CASE WHEN rk <= quota THEN 0 ELSE 1 END, md5(concat(row_id, ':43')), row_id LIMIT 500""")
def stratified_sample(spark, folder):
    rows = _meta(spark, folder).select("row_id", "subject", "style", "camera")
    return sampling.stratified_sample(rows, ["subject", "style", "camera"], "row_id", 500).select("row_id")


@query("""
WITH s AS (SELECT subject, style, count(*) AS size FROM metadata_10 GROUP BY ALL), t AS (SELECT sum(size)::BIGINT AS total FROM s)
SELECT subject, style, size, CASE WHEN total <= 2000 THEN size ELSE least((least(10, size) + (2000 - least(10 * 98, 2000)) * size / total)::DOUBLE, size) END AS alloc FROM (SELECT s.subject, s.style, s.size, t.total FROM s, t)
""".replace("least((least(10, size) + (2000 - least(10 * 98, 2000)) * size / total)::DOUBLE, size) END AS alloc", "least(floor(least(10, size) + (2000 - least(10 * 98, 2000)) * size / total)::BIGINT, size) END AS alloc"))
def weighted_allocation(spark, folder):
    return sampling.weighted_allocation(_meta(spark, folder), ["subject", "style"], 2000, 10, 98)


@query(f"""
WITH r AS (SELECT row_id, row_number() OVER (ORDER BY {HASH.format(seed=42)}, row_id) AS rk FROM metadata_10)
SELECT row_id, rk <= 20 AS shown, rk <= 100 AS scored FROM r WHERE rk <= 100""")
def nested_subsets(spark, folder):
    return sampling.nested_subsets(_meta(spark, folder).select("row_id"), "row_id", {"shown": 20, "scored": 100})


@query("SELECT row_id, source FROM raw_ranked".replace("raw_ranked", f"(SELECT *, row_number() OVER (PARTITION BY source ORDER BY row_id) AS rk FROM metadata_10 WHERE {QUALITY}) WHERE rk <= 100"))
def limit_after_filter(spark, folder):
    """At most 100 rows a source, in input order, after the filter."""
    window = Window.partitionBy("source").orderBy("row_id")  # planned with a group limit: tasks keep 100 a source before the shuffle
    kept = _meta(spark, folder).where(filters.quality(F.col("text"), F.col("lang"))).select("row_id", "source")
    return kept.withColumn("_r", F.row_number().over(window)).where("_r <= 100").drop("_r")


@query("SELECT row_id, floor((row_number() OVER (ORDER BY row_id) - 1) / 64)::BIGINT AS batch FROM metadata_10 QUALIFY batch < (SELECT count(*) FROM metadata_10) // 64")
def contiguous_batches(spark, folder):
    return sampling.batches(_meta(spark, folder).select("row_id"), [F.col("row_id")], 64, drop_last=True)


@query("SELECT row_id % 8 AS shard, count(*) AS n, min(row_id) AS first_id FROM metadata_10 GROUP BY 1")
def modulo_shards(spark, folder):
    return _meta(spark, folder).groupBy(F.pmod("row_id", F.lit(8)).cast("bigint").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id"))


@query(f"SELECT row_id, row_number() OVER (ORDER BY md5(concat(row_id, ':45')), row_id) - 1 AS place FROM metadata_10")
def epoch_shuffle(spark, folder):
    """A seeded global order (seed 42, epoch 3)."""
    rows = _meta(spark, folder).select("row_id").withColumn("_h", T.hash_order(F.col("row_id"), 45))
    return sampling.positions(rows, [F.col("_h"), F.col("row_id")]).select("row_id", F.col("_pos").alias("place"))


_U = "(('0x' || left(md5(concat(row_id, ':{seed}')), 7))::BIGINT / 268435456.0::DOUBLE)"


@query(f"""SELECT row_id, CASE WHEN {_U.format(seed=42)} < 0.7 THEN 'C1' ELSE 'C2' END AS camera_pick, {_U.format(seed=7)} < 0.1 AS dropped,
CASE WHEN {_U.format(seed=9)} < 0.1 THEN 1.0::DOUBLE WHEN {_U.format(seed=9)} < 0.2 THEN 0.75 WHEN {_U.format(seed=9)} < 0.3 THEN 0.5 ELSE 0.25 END AS step_pick FROM metadata_10""")
def hashed_choices(spark, folder):
    k = F.col("row_id")
    return _meta(spark, folder).select(
        "row_id", sampling.weighted_pick(k, [("C1", 0.7), ("C2", 0.3)]).alias("camera_pick"), (T.hash_uniform(k, 7) < 0.1).alias("dropped"),
        sampling.weighted_pick(k, [(1.0, 0.1), (0.75, 0.1), (0.5, 0.1), (0.25, 0.7)], 9).alias("step_pick"),
    )


@query("SELECT code, row_number() OVER (ORDER BY substr(code, 2)::INT) AS by_number, row_number() OVER (ORDER BY code) AS by_text FROM taxonomy WHERE axis = 'subject'")
def code_orders(spark, folder):
    codes = read_table(spark, folder, "taxonomy").where("axis = 'subject'")
    number = Window.orderBy(F.substring("code", 2, 9).cast("int"))  # a fixed table of codes
    return codes.select("code", F.row_number().over(number).cast("bigint").alias("by_number"), F.row_number().over(Window.orderBy("code")).cast("bigint").alias("by_text"))


@query("SELECT row_id, text FROM metadata_10 ORDER BY row_id LIMIT 10")
def prefix_slice(spark, folder):
    return _meta(spark, folder).select("row_id", "text").orderBy("row_id").limit(10)


# --- set operations ---


@query(f"""
WITH u AS (SELECT 0 AS part, row_id AS id, text, source FROM metadata_10 UNION ALL SELECT 1, raw_id, text, source FROM raw_harvest)
SELECT part, id, source FROM u QUALIFY row_number() OVER (PARTITION BY lower({STEXT}) ORDER BY part, id, source) = 1""")
def union_keep_first(spark, folder):
    """Union of two sources, the first in source order claims a text."""
    a = _meta(spark, folder).select(F.lit(0).alias("part"), F.col("row_id").alias("id"), "text", "source")
    b = _raw(spark, folder).select(F.lit(1).alias("part"), F.col("raw_id").alias("id"), "text", "source")
    order = [F.col("part"), F.col("id"), F.coalesce(F.col("source"), F.lit("\U0010ffff"))]
    return dedup.keep_first(a.unionByName(b), dedup.exact_key(F.col("text")), order).select("part", "id", "source")


@query(f"""
SELECT row_id FROM metadata_10 WHERE row_id NOT IN (SELECT row_id FROM metadata_10 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY {HASH.format(seed=42)}, row_id) <= (SELECT floor(count(*) * 0.05) FROM metadata_10))""")
def leftovers(spark, folder):
    """What a sample did not take: an anti join by key."""
    rows = _meta(spark, folder).select("row_id", "subject")
    return rows.join(sampling.capped(rows, "subject", "row_id", 0.05), "row_id", "left_anti").select("row_id")


@query("SELECT (SELECT count(*) FROM metadata_10) AS n, count(DISTINCT row_id) AS parts, 0::BIGINT AS shared FROM metadata_10")
def split_conservation(spark, folder):
    """The parts of a split are disjoint and add up to the input."""
    split = sampling.stratified_split(_meta(spark, folder).select("row_id", "subject", "style"), ["subject", "style"], "row_id")
    seen = split.groupBy("row_id").agg(F.countDistinct("part").alias("p"), F.count(F.lit(1)).alias("c"))
    return seen.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("parts"), F.sum(F.when(F.col("p") > 1, 1).otherwise(0)).cast("bigint").alias("shared"))


# --- joins ---


def _by_digest(rows: DataFrame, *columns: str, nulls: bool = False) -> DataFrame:
    """The columns with ``key``, the text's 128-bit digest; rows without a text only if asked for."""
    keyed = rows.select(F.md5("text").alias("key"), *columns)
    return keyed if nulls else keyed.where("key is not null")


@query("""
WITH b AS (SELECT text, max_by(raw_id, raw_id) AS raw_id FROM raw_harvest WHERE text IS NOT NULL GROUP BY text)
SELECT m.row_id, b.raw_id FROM metadata_10 m LEFT JOIN b ON m.text = b.text""")
def keep_last_join(spark, folder):
    """Equi-join on text, the last of repeated build rows winning."""
    built = _by_digest(_raw(spark, folder), "raw_id").groupBy("key").agg(F.max("raw_id").alias("raw_id"))
    return join_skewed(_by_digest(_meta(spark, folder), "row_id", nulls=True), built, ["key"], "left").select("row_id", "raw_id")


@query("""
WITH j AS (SELECT m.row_id, max(r.raw_id) AS raw_id FROM metadata_10 m LEFT JOIN raw_harvest r ON m.text = r.text GROUP BY m.row_id)
SELECT round(avg(CASE WHEN raw_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS matched, avg(CASE WHEN raw_id IS NULL THEN 0.0 ELSE 1.0 END) >= 0.8 AS usable FROM j""")
def join_guard(spark, folder):
    joined = keep_last_join(spark, folder)
    share = F.avg(F.when(F.col("raw_id").isNull(), 0.0).otherwise(1.0))
    return joined.agg(F.round(share, 6).alias("matched"), (share >= 0.8).alias("usable"))


@query("SELECT row_id FROM metadata_10 m WHERE NOT EXISTS (SELECT 1 FROM raw_harvest r WHERE r.text = m.text)")
def resume_anti_join(spark, folder):
    """Rows without an output yet."""
    done = _by_digest(_raw(spark, folder)).distinct().withColumn("done", F.lit(True))
    return join_skewed(_by_digest(_meta(spark, folder), "row_id", nulls=True), done, ["key"], "left").where("done is null").select("row_id")


@query("SELECT row_id FROM metadata_10 m WHERE EXISTS (SELECT 1 FROM raw_harvest r WHERE r.text = m.text)")
def seen_semi_join(spark, folder):
    return join_skewed(_by_digest(_meta(spark, folder), "row_id"), _by_digest(_raw(spark, folder)).distinct(), ["key"]).select("row_id")


@query("""
WITH disk AS (SELECT DISTINCT path, CASE WHEN contains(path, 'vae') THEN 'changed' ELSE md5 END AS found FROM manifest_files WHERE NOT contains(path, 'tokenizer'))
SELECT DISTINCT m.path, CASE WHEN d.path IS NULL THEN 'missing' WHEN m.md5 IS NOT NULL AND d.found IS DISTINCT FROM m.md5 THEN 'corrupted' ELSE 'ok' END AS status FROM manifest_files m LEFT JOIN disk d ON m.path = d.path""")
def manifest_check(spark, folder):
    """Files listed against files found (here a listing with some left out and some changed)."""
    from lumenloom.sources.files import verify_manifest

    listed = read_table(spark, folder, "manifest_files")
    found = listed.where(~F.contains("path", F.lit("tokenizer"))).select("path", F.when(F.contains("path", F.lit("vae")), "changed").otherwise(F.col("md5")).alias("found"))
    return verify_manifest(listed, found)


@query("SELECT m.row_id, coalesce(r.prompt_nsfw, 0.5) AS score FROM metadata_10 m LEFT JOIN (SELECT text, min(CASE WHEN isnan(prompt_nsfw) THEN NULL ELSE prompt_nsfw END) AS prompt_nsfw FROM raw_harvest GROUP BY text) r ON r.text = m.text")
def left_join_default(spark, folder):
    scores = _by_digest(_raw(spark, folder), "prompt_nsfw").groupBy("key").agg(F.min(F.when(~F.isnan("prompt_nsfw"), F.col("prompt_nsfw"))).alias("s"))
    return join_skewed(_by_digest(_meta(spark, folder), "row_id", nulls=True), scores, ["key"], "left").select("row_id", F.coalesce("s", F.lit(0.5)).alias("score"))


@query(f"""
WITH k AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS old FROM metadata_10), c AS (SELECT * FROM k ORDER BY {HASH.format(seed=42)}, row_id LIMIT 200)
SELECT row_id, old, row_number() OVER (ORDER BY old) - 1 AS new FROM c""")
def position_remap(spark, folder):
    """Old and new positions of a random subset, put back in input order."""
    placed = sampling.positions(_meta(spark, folder).select("row_id"), [F.col("row_id")])
    chosen = placed.orderBy(T.hash_order(F.col("row_id")), "row_id").limit(200)
    return chosen.select("row_id", F.col("_pos").alias("old"), (F.row_number().over(Window.orderBy("_pos")) - 1).cast("bigint").alias("new"))


# --- near duplicates ---

_JACCARD = r"""
w AS (SELECT DISTINCT item_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS word FROM benchmark_stage),
s AS (SELECT id, count(*) AS n FROM w GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS o FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT id_a, id_b, o / (x.n + y.n - o) AS jaccard FROM p JOIN s x ON x.id = id_a JOIN s y ON y.id = id_b WHERE o * 1000 >= 700 * (x.n + y.n - o))"""


@query(f"WITH {_JACCARD} SELECT id_a, id_b, round(jaccard, 6) AS jaccard FROM pairs")
def similar_word_pairs(spark, folder):
    """Lossless set-similarity self-join by prefix filter."""
    return dedup.word_pairs(read_table(spark, folder, "benchmark_stage"), "item_id", "text").withColumn("jaccard", F.round("jaccard", 6))


@query(f"""
WITH RECURSIVE {_JACCARD}, e AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
comp AS (SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a),
c AS (SELECT i.item_id, i.text, coalesce(c.component, -1 - i.item_id) AS g FROM benchmark_stage i LEFT JOIN comp c ON c.id = i.item_id)
SELECT item_id FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY length(text) DESC, item_id) = 1""")
def near_dup_survivors(spark, folder):
    """Components of similar texts; the longest of each survives, the smallest id among equals."""
    items = read_table(spark, folder, "benchmark_stage").select("item_id", "text")
    found = connected_components(dedup.word_pairs(items, "item_id", "text"), "id_a", "id_b")
    return dedup.survivors(items, found.select(F.col("vertex").alias("id"), "component"), "item_id", "text").select("item_id")


_ITEMS = r"""
low AS (SELECT raw_id, lower(text) AS t FROM raw_harvest WHERE text IS NOT NULL),
w AS (SELECT DISTINCT raw_id, t, unnest(list_distinct(list_concat(
  regexp_extract_all(regexp_replace(t, '[\x{4e00}-\x{9fff}]+', ' ', 'g'), '[\p{L}\p{N}]+'),
  flatten(list_transform(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))))) AS item FROM low),
s AS (SELECT raw_id, t, count(*) AS n FROM w GROUP BY 1, 2),
o AS (SELECT a.raw_id AS a, b.raw_id AS b, a.t AS ta, b.t AS tb, count(*) AS o FROM w a JOIN w b ON a.item = b.item GROUP BY 1, 2, 3, 4)"""


@query(f"""
WITH RECURSIVE {_ITEMS},
links AS (SELECT DISTINCT a, b FROM o JOIN s x ON x.raw_id = a AND x.t = ta JOIN s y ON y.raw_id = b AND y.t = tb WHERE o * 1000 >= 700 * (x.n + y.n - o)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT a AS raw_id, min(b) AS first_id FROM reach GROUP BY a""")
def near_dup_groups(spark, folder):
    """Near-duplicates over the raw harvest, without loss: each id with the smallest one of its group."""
    groups = dedup.alike_groups(_raw(spark, folder), "raw_id", "text")
    # an id that was delivered with several texts ties their groups together
    tied = groups.groupBy("id").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    ties = connected_components(tied.where("low <> high").select("low", "high").unionByName(_middle(groups, tied)), "low", "high")
    placed = groups.join(ties.select(F.col("vertex").alias("component"), F.col("component").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("group")).distinct()
    first = placed.groupBy("group").agg(F.min("id").alias("first_id"))
    return join_skewed(placed, first, ["group"]).groupBy("id").agg(F.min("first_id").alias("first_id")).select(F.col("id").alias("raw_id"), "first_id")


def _middle(groups: DataFrame, tied: DataFrame) -> DataFrame:
    """The further groups of an id that is in more than two."""
    return groups.join(tied.where("low <> high"), "id").where("component <> low").select("low", F.col("component").alias("high"))


@query(None)
def banded_near_dups(spark, folder):
    """Near-duplicates over the raw harvest, without loss: ids and their component."""
    return dedup.alike_groups(_raw(spark, folder), "raw_id", "text")
