"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, lm, near_dup, packing, quality, secrets, topk, toxicity, url_filter
from .frames import table

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the interpolated bigram model."""
    return lm.score(_read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), toxicity.remainder("doc_id", 3) != 1)
    held_out = toxicity.remainder("doc_id", 3) == 1
    scored = toxicity.score(docs, model, name="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th vector against all others."""
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("v"))
    return topk.search(rows.filter(F.col("id") % 20 == 0), rows, 20)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document's whole text."""
    return secrets.digest(_read(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items found in every document."""
    found = decontaminate.find_leaks(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "distances")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    featured = table(quality.with_features(_read(spark, sf_dir, "documents")), "features")
    model = quality.fit(featured, _read(spark, sf_dir, "labels"), toxicity.remainder("doc_id", 5) != 0)
    held_out = toxicity.remainder("doc_id", 5) == 0
    return quality.score(featured, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    return url_filter.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Query] = {
    "op1_html": op1_html,
    "op2_neardup": op2_neardup,
    "op3_lm": op3_lm,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_topk": op6_topk,
    "op7_secrets": op7_secrets,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_urls": op10_urls,
}


def _secrets_sql() -> str:
    def spans(kind: int, pattern: str, group: int, least: int) -> str:
        whole = f"(?s).*?(?:{pattern})".replace("'", "''")
        one = pattern.replace("'", "''")
        ends = "list_sum(list_transform(p[1:k], lambda x: length(x)))"
        return f"""list_filter(list_transform(range(1, len(p) + 1), lambda k: {{'s': CAST({ends} - length(regexp_extract(p[k], '{one}', 0)) AS INT), 'k': {kind},
            'e': CAST({ends} AS INT), 'b': regexp_extract(p[k], '{one}', {group})}}), lambda x: length(x.b) >= {least}) FROM (SELECT regexp_extract_all(t, '{whole}', 0) AS p)"""

    names = "['assign', 'access', 'hex', 'entropy']"
    w, bits = secrets.WINDOW, f"CASE WHEN regexp_matches(c.b, '^[0-9a-fA-F]+$') THEN {secrets.HEX_BITS} WHEN regexp_matches(c.b, '^[0-9a-zA-Z]+$') THEN {secrets.ALNUM_BITS} ELSE {secrets.MIXED_BITS} END"
    text = lambda col: f"list_aggregate(list_transform({col}, lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), 'string_agg', ',')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    b AS (SELECT doc_id, t, (SELECT {spans(0, secrets.ASSIGN, 1, 8)}) AS a, (SELECT {spans(1, secrets.ACCESS, 0, 16)}) AS c, (SELECT {spans(2, secrets.HEX, 0, 32)}) AS h FROM d),
    u AS (SELECT doc_id, t, len(a) AS na, len(c) AS nc, len(h) AS nh, list_sort(list_transform(list_concat(a, c, h), lambda x: {{'s': x.s, 'k': x.k, 'e': x.e}})) AS base FROM b),
    m AS (SELECT doc_id, na, nc, nh, base, list_reduce(list_concat([{{'t': t, 's': 0, 'e': 0}}], list_transform(base, lambda x: {{'t': '', 's': x.s, 'e': x.e}})),
        lambda y, x: {{'t': substr(y.t, 1, x.s) || repeat(' ', x.e - x.s) || substr(y.t, x.e + 1), 's': 0, 'e': 0}}).t AS t FROM u),
    v AS (SELECT doc_id, na, nc, nh, base, list_filter((SELECT {spans(3, secrets.CANDIDATE, 0, 0)}), lambda c: NOT regexp_matches(c.b, '{secrets.ALLOWED}')) AS e FROM m),
    x AS (SELECT doc_id, na, nc, nh, base, list_transform(e, lambda c: {{'s': c.s, 'hits': list_filter(range(0, length(c.b) - {w - 1}),
        lambda i: list_entropy(string_split(substr(c.b, CAST(i AS INT) + 1, {w}), '')) >= {bits})}}) AS e FROM v),
    y AS (SELECT doc_id, na, nc, nh, base, list_sort(list_concat(base, list_transform(list_filter(e, lambda c: len(c.hits) > 0),
        lambda c: {{'s': CAST(c.s + c.hits[1] AS INT), 'k': 3, 'e': CAST(c.s + c.hits[-1] + {w} AS INT)}}))) AS al FROM x)
    SELECT doc_id, CAST(na AS BIGINT) AS n_assign, CAST(nc AS BIGINT) AS n_access, CAST(nh AS BIGINT) AS n_hex, sha256(coalesce({text("base")}, '')) AS base_sha256, coalesce({text("al")}, '') AS spans FROM y
    """


def _urls_sql() -> str:
    host = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    query = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*([?][^#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    case = lambda rules, what: " ".join(f"WHEN regexp_matches(host || path || query, '{r.pattern}') THEN '{getattr(r, what)}'" for r in rules)
    fixed = sorted(url_filter.FIXED_RULES, key=lambda r: (-len(r.name), r.name))
    method = sorted(url_filter.METHOD_RULES, key=lambda r: r.layer)
    return f"""
    WITH p AS (SELECT page_id, {host} AS host, {path} AS path, {query} AS query FROM pages)
    SELECT page_id, host, path, CASE {case(fixed, "name")} END AS rule, CASE {case(fixed, "verdict")} {case(method, "verdict")} ELSE 'allow' END AS verdict FROM p
    """


ORACLES: dict[str, str] = {
    "op2_neardup": r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
    e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    r(doc_id, m) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id),
    c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
    """,
    "op6_topk": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op7_secrets": _secrets_sql(),
    "op10_urls": _urls_sql(),
}
