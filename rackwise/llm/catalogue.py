"""The registered queries of the text operators, over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackwise.llm.common import fixed_rows, in_fold, read_table, stored
from rackwise.llm.decontamination import find_contamination, items_digest
from rackwise.llm.embedding_join import link_vectors
from rackwise.llm.html_text import extract_text
from rackwise.llm.language import fit_languages, identify_language
from rackwise.llm.mixing import mix, word_count
from rackwise.llm.near_duplicates import mark_near_duplicates
from rackwise.llm.pii import replace_personal_data
from rackwise.llm.quality_model import fit_quality, score_quality, with_statistics
from rackwise.llm.recompression import remove_repeats
from rackwise.llm.secrets import BASE_RULES, RULES, Rule, scan_secrets, span_texts
from rackwise.llm.token_alignment import align_tokens
from rackwise.llm.url_filters import LOWER, UPPER, judge_urls
from rackwise.llm.whitening import fit_whitening, identity_error, whiten

TOKENIZERS = "/opt/tokenizers"
PII_KEY = "check"  # a user gives a secret one
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def language_training(docs: DataFrame) -> DataFrame:
    """The rows that the language query learns from."""
    return docs.where(~in_fold(F.col("doc_id"), 4, 2)).select("text", "lang")


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = fit_languages(language_training(docs))
    rows = docs.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    return identify_language(rows, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(with_statistics(read_table(spark, folder, "documents").select("doc_id", "text")), "statistics")
    rows = rows.withColumn("held_out", in_fold(F.col("doc_id"), 5, 0))
    labels = read_table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit_quality(rows.where(~F.col("held_out")).join(labels, "doc_id"))
    return score_quality(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(read_table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return mark_near_duplicates(docs).select("doc_id", "class_id", "class_size", "kept")


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = find_contamination(docs, read_table(spark, folder, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items_digest(F.col("items")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    base = [r.kind for r in BASE_RULES]
    of_base = F.filter("secrets", lambda s: s["kind"].isin(base))

    def n_of(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [n_of(kind) for kind in base]
    return scan_secrets(docs).select("doc_id", *counts, F.sha2(span_texts(of_base), 256).alias("base_sha256"), span_texts(F.col("secrets")).alias("spans"))


def op7_vector_links(spark: SparkSession, folder: str) -> DataFrame:
    return link_vectors(read_table(spark, folder, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return replace_personal_data(docs, PII_KEY).select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = fixed_rows(spark, URL_RULES, ["host", "path", "verdict"])
    return judge_urls(read_table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


def op10_mix(spark: SparkSession, folder: str) -> DataFrame:
    # The operator meets its rows twice; stored, their words are counted, and the texts read, only once.
    docs = stored(read_table(spark, folder, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words")), "sizes")
    return mix(docs, size="words").select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return remove_repeats(docs, digest=True)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    model = fit_whitening(rows)
    explained = model.explained if model else []
    white = stored(whiten(rows, model).select("vec_id", "n", "deviation", "whitened"), "whitened")
    error = identity_error(white, len(explained))
    each = white.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    share = F.element_at(F.array(*[F.lit(e) for e in explained]).cast("array<double>"), F.col("place") + 1)
    return each.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return align_tokens(docs, TOKENIZERS, keep_text=False)


QUERIES = {"op8_personal_data": op8_personal_data, "op7_vector_links": op7_vector_links, "op4_near_duplicates": op4_near_duplicates, "op5_decontaminate": op5_decontaminate, "op1_language": op1_language, "op2_quality": op2_quality, "op3_html_text": op3_html_text, "op6_secrets": op6_secrets, "op9_url_filter": op9_url_filter, "op10_mix": op10_mix, "op11_substring_dedup": op11_substring_dedup, "op12_whitening": op12_whitening, "op13_token_alignment": op13_token_alignment}

_HOST = f"translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
_PATH = "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"
_FITS = "(host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)"

_OP9 = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
parts AS (SELECT page_id, row_number() OVER () AS n, {_HOST} AS host, {_PATH} AS path FROM pages),
best AS (
  SELECT n, max((length(rule_host || rule_path), length(rule_host), verdict, rule_host || rule_path)) AS b
  FROM parts JOIN rules ON {_FITS} GROUP BY n
)
SELECT page_id, host, path, b[4] AS rule, coalesce(b[3], 'allow') AS verdict FROM parts LEFT JOIN best USING (n)
"""


def _spans_sql(rule: Rule, number: int) -> str:
    """Spans of one rule in DuckDB: where the match before ended, found from running sums of lengths."""
    pattern = rule.pattern.replace("'", "''")
    long_enough = f"length(list_extract(vals, i)) >= {rule.value_length}"
    return f"""
SELECT n, unnest(list_filter(list_transform(range(1, len(whole) + 1), lambda i: {{
    'at': coalesce(list_sum(list_transform(gaps[:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(whole[:i - 1], lambda w: length(w))), 0),
    'number': {number}, 'size': length(whole[i]), 'ok': {long_enough}}}), lambda s: s.ok)) AS s
FROM (SELECT n, regexp_extract_all(body, '{pattern}') AS whole, regexp_extract_all(body, '{pattern}', {rule.value_group}) AS vals,
      string_split_regex(body, '{pattern}') AS gaps FROM texts WHERE regexp_matches(body, '{pattern}'))"""


def _op6() -> str:
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    span = f"{kinds}[s.number + 1] || ':' || CAST(CAST(s.at AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s.at AS BIGINT) + s.size AS VARCHAR)"
    order = "ORDER BY s.at, s.number"
    counts = ", ".join(f"CAST(count(*) FILTER (s.number = {i}) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(BASE_RULES))
    return f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS body FROM documents),
found AS ({' UNION ALL '.join(_spans_sql(r, i) for i, r in enumerate(RULES))})
SELECT doc_id, {counts},
  sha256(coalesce(string_agg({span}, ',' {order}) FILTER (s.number < {len(BASE_RULES)}), '')) AS base_sha256,
  coalesce(string_agg({span}, ',' {order}) FILTER (s.number IS NOT NULL), '') AS spans
FROM texts LEFT JOIN found USING (n) GROUP BY n, doc_id
"""


_FOLDED = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP5 = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, {_FOLDED} AS words FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLDED} AS words FROM benchmark WHERE item_id IS NOT NULL),
tests AS (
  SELECT DISTINCT item, least(len(words), 10) AS size, array_to_string(words[p:p + 9], ' ') AS body
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p FROM items WHERE len(words) > 0)
),
windows AS (
  SELECT n, p, size, array_to_string(words[p:p + size - 1], ' ') AS body
  FROM (SELECT n, words, size, unnest(range(1, len(words) - size + 2)) AS p
        FROM docs, (SELECT DISTINCT size FROM tests) WHERE len(words) >= size)
),
found AS (SELECT n, p, size, item FROM windows JOIN tests USING (size, body)),
hit AS (
  SELECT n, count(DISTINCT word) AS n_hit
  FROM (SELECT n, unnest(range(p, p + size)) AS word FROM (SELECT DISTINCT n, p, size FROM found)) GROUP BY n
),
named AS (
  SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT n, item FROM found) GROUP BY n
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (n) LEFT JOIN named USING (n)
"""

_OP7 = """
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS n, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
),
usable AS (
  SELECT * FROM vectors
  WHERE v IS NOT NULL AND label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.n AS a, b.n AS b FROM usable a JOIN usable b ON a.label = b.label AND a.n <> b.n AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
),
reach(n, m) AS (SELECT a, b FROM links UNION SELECT reach.n, links.b FROM reach JOIN links ON reach.m = links.a),
counts AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a),
roots AS (SELECT reach.n, min(o.vec_id) AS other FROM reach JOIN vectors o ON o.n = reach.m GROUP BY reach.n)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id,
  vec_id <= coalesce(other, vec_id) AS kept
FROM vectors LEFT JOIN counts USING (n) LEFT JOIN roots USING (n)
"""

_OP11 = """
WITH texts AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
),
windows AS (
  SELECT n, doc_id, p, array_to_string(words[p:p + 12], ' ') AS body
  FROM (SELECT n, doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM texts WHERE len(words) >= 13)
),
firsts AS (SELECT body, min(doc_id) AS first_doc FROM windows GROUP BY body),
gone AS (
  SELECT DISTINCT n, unnest(range(p, p + 13)) AS p FROM windows JOIN firsts USING (body) WHERE first_doc < doc_id
),
each AS (SELECT n, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM texts),
kept AS (SELECT n, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS body FROM each ANTI JOIN gone USING (n, p) GROUP BY n)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (n)
"""

# Those of op5, op7 and op11 make rows of all windows, or all pairs of a label: meant for the small tables.
ORACLE_SQL: dict[str, str] = {"op5_decontaminate": _OP5, "op6_secrets": _op6(), "op7_vector_links": _OP7, "op9_url_filter": _OP9, "op11_substring_dedup": _OP11}
