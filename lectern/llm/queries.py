"""The operators applied to their whole tables, one query each, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._run import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, weights=(3, 1, 2), share=1.5, most=2).select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, toxicity, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out()))
    scored = toxicity(docs, model, spans=False)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def capture_dates(pages: DataFrame) -> DataFrame:
    """The pages table has no times: page_id days, modulo a year, after 2024-01-01."""
    return pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))


def list_events(pages: DataFrame) -> DataFrame:
    """Dated events of four lists, made from the hosts of the pages by rules that only depend on the host."""
    from .url_filter import host

    hosts = pages.select(host(F.col("url")).alias("h")).dropna().distinct()
    n = F.length("h")
    day = lambda start, plus=None: F.date_add(F.lit(start).cast("date"), plus if plus is not None else F.lit(0))
    rules = [
        (n % 5 == 0, "adult", "domain", F.col("h"), "add", day("2024-02-01", n)),
        (n % 5 == 0, "adult", "domain", F.col("h"), "drop", day("2024-04-01", n)),
        (n % 5 == 0, "adult", "domain", F.col("h"), "add", day("2024-07-01", n)),
        (F.col("h").startswith("m.") | F.col("h").startswith("blog."), "spam", "prefix", F.concat("h", F.lit("/es")), "add", day("2024-03-01", n)),
        (n % 7 == 3, "malware", "host", F.col("h"), "add", day("2024-01-10")),
        (n % 7 == 3, "malware", "host", F.col("h"), "drop", day("2024-10-01")),
        (F.lit(True), "parked", "domain", F.substring_index("h", ".", -2), "add", day("2024-11-01")),
        (F.col("h").endswith(".org"), "parked", "domain", F.substring_index("h", ".", -2), "drop", day("2024-11-15")),
    ]
    out = None
    for when, name, kind, entry, action, at in rules:
        one = hosts.where(when).select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), entry.alias("entry"), F.lit(action).alias("action"), at.alias("at"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filtered, host

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = filtered(capture_dates(pages), list_events(pages))
    return found.select("page_id", "url", host(F.col("url")).alias("host"), "fetched", F.array_join("lists", ",").alias("lists"), "n_entries", "blocked")


def op4_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None, limit: int = 2048) -> DataFrame:
    """path: the tokenizer's file; else word_bpe_49k.json of the installed public ones."""
    from .token_counts import token_counts

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), path).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, window=50, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    found = jaccard_components(table(spark, sf_dir, "documents"), n=5, threshold=(80, 100))
    return found.select(F.col("_d").alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .knn_join import knn_join

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return knn_join(rows, rows.where("vec_id % 20 = 0"), k=20).withColumnRenamed("id", "vec_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, train

    model = train(table(spark, sf_dir, "documents").select("text", "lang"))
    return identify(table(spark, sf_dir, "pages"), model).withColumnRenamed("id", "page_id")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_toxicity, op3_url_filter, op4_token_counts, op5_substring_dedup, op6_jaccard_join, op7_html_text, op8_decontamination, op9_knn_join, op10_language_id)}

_HOST = r"""regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '^www\.', '')"""
_PATH = r"""regexp_replace(coalesce(regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1), ''), '/+$', '')"""

ORACLES: dict[str, str] = {
    "op3_url_filter": f"""
WITH p AS (
  SELECT page_id, url, nullif({_HOST}, '') AS host, {_PATH} AS path, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched FROM pages
), h AS (SELECT DISTINCT host, CAST(length(host) AS INTEGER) AS n FROM p WHERE host IS NOT NULL
), e AS (
  SELECT 'adult' AS list, 'domain' AS kind, host AS entry, 'add' AS action, CAST(DATE '2024-02-01' + n AS DATE) AS day FROM h WHERE n % 5 = 0
  UNION SELECT 'adult', 'domain', host, 'drop', CAST(DATE '2024-04-01' + n AS DATE) FROM h WHERE n % 5 = 0
  UNION SELECT 'adult', 'domain', host, 'add', CAST(DATE '2024-07-01' + n AS DATE) FROM h WHERE n % 5 = 0
  UNION SELECT 'spam', 'prefix', host || '/es', 'add', CAST(DATE '2024-03-01' + n AS DATE) FROM h WHERE host LIKE 'm.%' OR host LIKE 'blog.%'
  UNION SELECT 'malware', 'host', host, 'add', DATE '2024-01-10' FROM h WHERE n % 7 = 3
  UNION SELECT 'malware', 'host', host, 'drop', DATE '2024-10-01' FROM h WHERE n % 7 = 3
  UNION SELECT 'parked', 'domain', regexp_extract(host, '([^.]+\\.[^.]+)$', 1), 'add', DATE '2024-11-01' FROM h
  UNION SELECT 'parked', 'domain', regexp_extract(host, '([^.]+\\.[^.]+)$', 1), 'drop', DATE '2024-11-15' FROM h WHERE host LIKE '%.org'
), s AS (
  SELECT list, kind, entry, day, action, lag(action, 1, 'drop') OVER w AS was FROM e WINDOW w AS (PARTITION BY list, kind, entry ORDER BY day)
), v AS (
  SELECT list, kind, entry, action, day AS valid_from, lead(day) OVER (PARTITION BY list, kind, entry ORDER BY day) AS valid_to FROM s WHERE action <> was
), k AS (
  SELECT page_id, fetched, 'host' AS kind, host AS entry FROM p WHERE host IS NOT NULL
  UNION ALL SELECT page_id, fetched, 'domain', array_to_string(list_slice(string_split(host, '.'), i, 99), '.')
    FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p WHERE host IS NOT NULL)
  UNION ALL SELECT page_id, fetched, 'prefix', host || '/' || array_to_string(list_slice(parts, 1, i), '/')
    FROM (SELECT *, unnest(range(0, len(parts) + 1)) AS i FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p WHERE host IS NOT NULL))
), m AS (
  SELECT k.page_id, v.list, v.kind, v.entry FROM k JOIN v ON k.kind = v.kind AND k.entry = v.entry AND v.action = 'add' AND k.fetched >= v.valid_from AND (v.valid_to IS NULL OR k.fetched < v.valid_to)
), g AS (
  SELECT page_id, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists, count(DISTINCT list || ' ' || kind || ' ' || entry) AS n_entries FROM m GROUP BY page_id
)
SELECT p.page_id, p.url, p.host, p.fetched, coalesce(g.lists, '') AS lists, coalesce(g.n_entries, 0) AS n_entries, coalesce(g.n_entries, 0) > 0 AS blocked
FROM p LEFT JOIN g ON p.page_id = g.page_id""",
    "op9_knn_join": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), t AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS x
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM t
), g AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), h AS (SELECT g.doc_id, g.i, g.n, t.item_id FROM g JOIN t ON g.n = t.n AND g.x = t.x
), c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id
), s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(s.n_items, 0) AS n_items, sha256(coalesce(s.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN s ON d.doc_id = s.doc_id""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), f AS (SELECT x, min(doc_id) AS least FROM g GROUP BY x
), r AS (SELECT DISTINCT doc_id, j FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 50)) AS j FROM g JOIN f ON g.x = f.x WHERE f.least < g.doc_id)
), a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d WHERE len(w) > 0
), k AS (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.j) AS kept FROM a LEFT JOIN r ON a.doc_id = r.doc_id AND a.j = r.j WHERE r.j IS NULL GROUP BY a.doc_id
), n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN n ON d.doc_id = n.doc_id""",
    "op6_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (SELECT o.a, o.b FROM o JOIN n p ON o.a = p.doc_id JOIN n q ON o.b = q.doc_id WHERE 100 * o.c >= 80 * (p.n + q.n - o.c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), m AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.a""",
}
