"""The registered queries of the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sha_of_list
from .decontaminate import find_contamination
from .html_text import extract_text
from .minhash import near_duplicates
from .packing import pack
from .pii import KINDS, find_pii, listed
from .substrings import remove_repeats
from .topk import exact_topk
from .toxicity import score as toxicity_score
from .url_rules import judge_urls
from .warc_zip import read_archives, write_archives

#: Fixed host and path rules of the URL filter.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The tokenizer file in the installed vocabularies' folder (TOKENIZER_DIR, if set)."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return f"{folder}/{name}"
    return importlib.import_module("public_tokenizers").path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_archives(spark, write_archives(table(spark, sf_dir, "pages")), with_payload=False)
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
     f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f"""


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def _of_kind(number: int):
    return lambda s: s["kind"] == number


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    size = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", size("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), size("near_spans").alias("n_near"))


def _repeated(n: int) -> str:
    """Maximal byte ranges (s) that strings of n bytes cover which start elsewhere too, on hexadecimal texts in chunks of 2,048 starts."""
    return f"""
     c{n} AS (SELECT doc_id, n, k, substr(x, k * 4096 + 1, {4096 + 2 * n - 2}) AS y FROM (SELECT *, unnest(generate_series(0, (n - {n}) // 2048)) AS k FROM d WHERE n >= {n})),
     w{n} AS (SELECT doc_id, k * 2048 + i AS p, md5_number(substr(y, 2 * i + 1, {2 * n})) AS s FROM (SELECT *, unnest(generate_series(0, least(2047, n - {n} - k * 2048))) AS i FROM c{n})),
     r{n} AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > {n} AS apart FROM w{n} JOIN (SELECT s FROM w{n} GROUP BY s HAVING count(*) > 1) USING (s)),
     s{n} AS (SELECT doc_id, min(p) AS a, max(p) + {n} AS b FROM (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r{n}) GROUP BY doc_id, run)"""

OP5_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),{_repeated(400)},{_repeated(300)},
     k AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept
           FROM (SELECT d.doc_id, x, coalesce(lag(s.b) OVER (PARTITION BY d.doc_id ORDER BY s.a), 0) AS a, s.a AS b FROM d JOIN s400 s USING (doc_id)
                 UNION ALL SELECT doc_id, x, b AS a, n AS b FROM d JOIN (SELECT doc_id, max(b) AS b FROM s400 GROUP BY doc_id) USING (doc_id)) GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(r.removed, 0)::BIGINT AS n_removed, coalesce(r.spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, x))) AS kept_sha256, coalesce(q.removed, 0)::BIGINT AS n_near
FROM d LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM s400 GROUP BY doc_id) r USING (doc_id)
     LEFT JOIN (SELECT doc_id, sum(b - a) AS removed FROM s300 GROUP BY doc_id) q USING (doc_id) LEFT JOIN k USING (doc_id)"""


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS g
           FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(3, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
     e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
     r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.m = e.a),
     c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                  list_sum(list_transform(generate_series(1, least(len(q.w), len(c.w))), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), special_tokens=True)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", words.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha_of_list(F.col("items")).alias("items_sha256"), F.col("hit").alias("contaminated"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
            FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT size FROM bw),
     dw AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS g
            FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
     hit AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.size = bw.size),
     places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hit) GROUP BY doc_id),
     items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
               FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""


QUERIES = {"op1_warc": op1_warc, "op2_html_text": op2_html_text, "op3_pii": op3_pii, "op4_toxicity": op4_toxicity, "op5_repeats": op5_repeats, "op6_minhash": op6_minhash, "op7_url_rules": op7_url_rules, "op8_topk": op8_topk, "op9_packing": op9_packing, "op10_decontaminate": op10_decontaminate}
ORACLE_SQL = {"op1_warc": OP1_SQL, "op5_repeats": OP5_SQL, "op6_minhash": OP6_SQL, "op8_topk": OP8_SQL, "op10_decontaminate": OP10_SQL}
