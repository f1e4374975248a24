"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .collocations import collocations
from .common import scratch, table
from .divergence import divergence
from .embed_dedup import embedding_duplicates
from .langid import identify, learn_dictionaries
from .mixing import mix_sources
from .packing import pack
from .piece_codec import encode_pieces
from .pii import replace
from .quality import fit, score
from .simhash import near_duplicates
from .token_counts import token_counts
from .warc import read_warc, write_warc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: The key of this repository's own runs; a deployment passes a secret one.
PII_KEY = b"tidemark surrogate key"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "text", F.size("pii_entities").alias("n_entities"), "pii_entities")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Learnt from the labels of documents outside the held-out fold."""
    return fit(docs, table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = learn_dictionaries(docs.where(fold(F.col("doc_id"), 5) != 0))
    out = identify(docs.select("doc_id", "text"), learned, min_margin=0.01)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), keep=False)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_nearest, op3_pii, op4_quality, op5_mixing, op6_token_counts, op7_packing, op8_warc, op9_embedding_dedup, op10_language, op11_collocations, op12_pieces, op13_divergence)
    return {f.__name__: f for f in found}


#: The same mix by sorting: documents in the order of their hash, as long as the running sum stays within the budget.
OP5_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), src AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
         CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w
  FROM base GROUP BY source
), ranked AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, CAST((SELECT SUM(source_size) FROM src) AS DOUBLE) AS total,
         row_number() OVER (ORDER BY (3.0::DOUBLE * source_size) / w, source ASC NULLS LAST) AS pos
  FROM src
), lev AS (
  SELECT *, (total - COALESCE(SUM(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / SUM(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), ff AS (
  SELECT pos AS fpos, level AS flevel FROM lev WHERE cap > w * level ORDER BY pos LIMIT 1
), tgt AS (
  SELECT source, source_size, CASE WHEN fpos IS NULL OR pos < fpos THEN cap ELSE w * flevel END AS target
  FROM lev LEFT JOIN ff ON TRUE
), st AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM tgt
), run AS (
  SELECT b.doc_id, b.source, b.size, s.source_size, s.target, s.whole, s.target - s.whole * s.source_size AS budget, b.h,
         SUM(b.size) OVER (PARTITION BY b.source ORDER BY b.h) AS upto
  FROM base b JOIN st s ON b.source IS NOT DISTINCT FROM s.source
), th AS (
  SELECT source AS tsource, MIN(h) AS threshold FROM run WHERE upto > budget GROUP BY source
), done AS (
  SELECT run.*, CAST(least(whole + CASE WHEN source_size > 0 AND h < threshold THEN 1 ELSE 0 END, 3) AS INTEGER) AS copies
  FROM run LEFT JOIN th ON run.source IS NOT DISTINCT FROM th.tsource
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, copies FROM done
"""


OP8_SQL = """
WITH p AS (
  SELECT page_id, COALESCE(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN MAX(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS keeper FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keeper THEN keeper END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM k
"""


#: All pairs of a label, and what they reach by recursion.
OP9_SQL = """
WITH RECURSIVE raw AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), parts_of AS (
  SELECT vec_id, unnest(v) AS x FROM raw
), bad AS (
  SELECT vec_id FROM parts_of GROUP BY 1 HAVING bool_or(x IS NULL OR isnan(x) OR isinf(x)) OR NOT bool_or(x <> 0)
), live AS (
  SELECT * FROM raw WHERE label IS NOT NULL AND len(v) > 0 AND vec_id NOT IN (SELECT vec_id FROM bad)
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM live a JOIN live b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM raw UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), parts AS (
  SELECT a, MIN(b) AS component_id FROM reach GROUP BY 1
)
SELECT vec_id, (SELECT COUNT(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM raw JOIN parts ON parts.a = vec_id
"""


#: All n-grams of one to five words, every cut of the frequent ones, and whether a longer one stands around each.
OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), totals AS (
  SELECT lang, CAST(SUM(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY 1
), grams AS (
  SELECT lang, list_slice(w, i, i + size - 1) AS each, CAST(COUNT(*) AS HUGEINT) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces), (SELECT unnest(range(1, 6)) AS size) WHERE i + size - 1 <= len(w)
  GROUP BY 1, 2 HAVING COUNT(*) >= 100
), candidates AS (
  SELECT *, array_to_string(each, ' ') AS phrase FROM grams WHERE len(each) > 1
), cuts AS (
  SELECT lang, each, phrase, f AS a, unnest(range(1, len(each))) AS k FROM candidates
), scored AS (
  SELECT c.*, l.f AS l, r.f AS r, t.n, (1000 * c.a * t.n) // (l.f * r.f) AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000 * c.a * t.n) // (l.f * r.f), c.k) AS nth
  FROM cuts c JOIN totals t ON t.lang = c.lang JOIN grams l ON l.lang = c.lang AND l.each = list_slice(c.each, 1, c.k)
    JOIN grams r ON r.lang = c.lang AND r.each = list_slice(c.each, c.k + 1, len(c.each))
), parts AS (
  SELECT lang, f, each, size, unnest(range(1, len(each) - size + 2)) AS i FROM (SELECT lang, f, each, unnest(range(2, len(each))) AS size FROM candidates)
), around AS (
  SELECT lang, list_slice(each, i, i + size - 1) AS each, MAX(f) AS f FROM parts GROUP BY 1, 2
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN around o ON o.lang = s.lang AND o.each = s.each WHERE s.nth = 1 AND (o.f IS NULL OR 100 * o.f < 100 * s.a)
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


#: Every group with every kept term of its language.
OP13_SQL = r"""
WITH d AS (
  SELECT COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
         regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), occ AS (
  SELECT lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY 1, 2 HAVING COUNT(*) >= 10
), groups AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT g.lang, g.source, k.term, CAST(COALESCE(o.n, 0) AS HUGEINT) AS n
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN (SELECT lang, source, term, COUNT(*) AS n FROM occ GROUP BY 1, 2, 3) o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (SUM(n) OVER (PARTITION BY lang, source) + 2 * COUNT(*) OVER (PARTITION BY lang, source)) AS p FROM c
), q AS (
  SELECT lang, term, 1 + 1000000000 * (n + 2) // (SUM(n) OVER (PARTITION BY lang) + 2 * COUNT(*) OVER (PARTITION BY lang)) AS q FROM (SELECT lang, term, SUM(n) AS n FROM c GROUP BY 1, 2)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, SUM((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_divergence": OP13_SQL, "op11_collocations": OP11_SQL, "op9_embedding_dedup": OP9_SQL, "op5_mixing": OP5_SQL, "op8_warc": OP8_SQL}
