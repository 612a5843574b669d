"""The queries of the corpus operators, opN_<name>, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, train_fold


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out() -> Column:
    """Whether a row is in the held-out fold; a row without an id is neither held out nor learned from."""
    return F.coalesce(train_fold() == 1, F.lit(False)).alias("held_out")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, scan

    found = scan(table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["kind"].isin([r.kind for r in BASE]))
    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(train_fold() != 1))
    return predict(docs, model).select("doc_id", held_out(), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(train_fold() != 1))
    return score(docs, model).select("doc_id", held_out(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    # the contract's 400 bytes miss many passages of over 50 words: these have a column of their own
    return remove_repeats(table(spark, sf_dir, "documents"), words=51).withColumn("n_kept", F.col("n_bytes") - F.col("n_removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("kept_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import rebuilt, sequences, trie

    c = F.col("conv_id")
    own = sequences(table(spark, sf_dir, "conversations"))
    return trie(rebuilt(own, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, 8))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(fold != 0))
    return score(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    i = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(i % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, i % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_dedup": op2_line_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_sharding": op8_sharding,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_toxicity": op12_toxicity,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op9_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
g AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i WHERE 100 * c >= 75 * (na + nb - c)), b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT b.y, r.c FROM r JOIN b ON r.id = b.x WHERE r.c < b.y)
SELECT s.doc_id, len(s.sh) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.id = s.doc_id GROUP BY 1, 2""",
    # exact neighbours: the forest finds the same where it searches all of a small table, as at the scale of the comparison
    "op10_nearest_neighbours": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10""",
    # crc32 of the decimal id, bit by bit: DuckDB has no such function
    "op11_conversation_trie": r"""WITH o AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT conv_id, w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h FROM o),
s AS (SELECT h.conv_id, list_concat(coalesce(b.w[1:h.h], []), h.w[h.h + 1:]) AS s FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
e AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM s),
n AS (SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(s) = d) AS ends FROM e GROUP BY 1, 2),
c AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
t AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * strlen(n.p[n.d].t) END AS own FROM n LEFT JOIN c ON c.d = n.d AND c.p = n.p),
u AS (SELECT t.p[1:a.d] AS p, a.d AS d, sum(t.own)::BIGINT AS saved_tokens, count(*) FILTER (WHERE t.n_children = 0) AS n_leaves FROM t, (SELECT DISTINCT d FROM t) a WHERE a.d <= t.d GROUP BY 1, 2)
SELECT t.conv_id, t.d AS depth, q.conv_id AS parent_conv_id, t.n AS n_convs, t.n_children, u.n_leaves, u.saved_tokens, sha256(coalesce(t.ends, '')) AS ends_sha256
FROM t JOIN u ON u.d = t.d AND u.p = t.p LEFT JOIN t q ON q.d = t.d - 1 AND q.p = t.p[1:t.d - 1]""",
    "op13_hard_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) <= 5""",
}
