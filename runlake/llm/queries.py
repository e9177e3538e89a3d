"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm import toxicity
from runlake.llm.alignment import align
from runlake.llm.exact_dedup import exact_groups
from runlake.llm.language_id import fit, predict
from runlake.llm.minhash import near_duplicates
from runlake.llm.mixing import mix
from runlake.llm.packing import pack
from runlake.storage import new_path
from runlake.llm.sharding import byte_shards
from runlake.llm.suffix_dedup import repeated_passages
from runlake.llm.token_counts import token_counts
from runlake.llm.token_store import read_tokens, write_tokens
from runlake.llm.vector_dedup import near_vectors
from runlake.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"))
    found = predict(docs.withColumn("doc_id", F.struct("doc_id", "held_out")), fit(docs.where("not held_out")))
    return found.select("doc_id.*", "lang_pred", "score")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), all_digests=True)  # the query owes every row's digest


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_shards(table(spark, sf_dir, "documents"), 8).drop("start")
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), 4096)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = toxicity.score(docs, toxicity.fit(docs.where(~held_out), labels.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), words=50).select("doc_id", "start_word", "n_words")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=4)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), limit=1024)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return ORACLE


#: Words of a text for the SQL.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w"
ORACLE: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
        FROM d WINDOW w AS (PARTITION BY h)""",
    "op6_minhash": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {WORDS} FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0) x),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        c(node, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, c.least FROM c JOIN e ON c.node = e.a WHERE c.least < e.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.least AS component_id, m.least = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(least) AS least FROM c GROUP BY node) m ON m.node = d.doc_id""",
    "op7_vector_dedup": r"""
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
        n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
        c(node, least) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.least FROM c JOIN l ON c.node = l.a WHERE c.least < l.b)
        SELECT e.vec_id, (SELECT count(*) FROM l WHERE a = e.vec_id) AS n_links, m.least AS component_id, m.least = e.vec_id AS kept FROM embeddings e JOIN (SELECT node, min(least) AS least FROM c GROUP BY node) m ON m.node = e.vec_id""",
    "op10_suffix_dedup": rf"""
        WITH w AS (SELECT doc_id, {WORDS} FROM documents),
        p AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS p FROM w WHERE len(w) >= 50),
        k AS (SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + 50], ' ')) AS h FROM p),
        d AS (SELECT doc_id, p FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(DISTINCT doc_id) > 1)),
        o AS (SELECT *, CASE WHEN p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -100) + 50 THEN 1 ELSE 0 END AS opens FROM d),
        i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS island FROM o)
        SELECT doc_id, min(p) AS start_word, max(p) + 50 - min(p) AS n_words FROM i GROUP BY doc_id, island""",
}
