"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe,
    common,
    conversation_trie,
    decontaminate,
    embedding_dedup,
    licenses,
    near_dedup,
    packing,
    perspectives,
    sharding,
    substring_dedup,
    token_counts,
    toxicity,
    vector_codes,
)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: Vocabulary files of public tokenizers; parameters, never copied here.
BPE, PIECES, WORDS = "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"


@query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(common.documents(spark, sf_dir, "doc_id", "text"), width=4, threshold=0.8)


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(common.documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=5, threshold=0.8)


ORACLE_SQL["op1_decontamination"] = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
), items AS (
  SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM (SELECT DISTINCT item_id, text FROM benchmark)
), item_shingles AS (
  SELECT item_id, least(len(words), 5) AS width, unnest(list_distinct(list_transform(range(1, len(words) - least(len(words), 5) + 2), lambda i: array_to_string(words[i : i + least(len(words), 5) - 1], ' ')))) AS shingle
  FROM items WHERE len(words) > 0
), sizes AS (
  SELECT item_id, width, count(*) AS n_item FROM item_shingles GROUP BY ALL
), doc_shingles AS (
  SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(words) - width + 2), lambda i: array_to_string(words[i : i + width - 1], ' '))) AS shingle
  FROM docs, (SELECT DISTINCT width FROM sizes)
)
SELECT d.doc_id, i.item_id, count(*) AS n_common, any_value(s.n_item) AS n_item
FROM doc_shingles d JOIN item_shingles i USING (width, shingle) JOIN sizes s ON s.item_id = i.item_id AND s.width = i.width
GROUP BY d.doc_id, i.item_id HAVING count(*) >= ceil(0.8 * any_value(s.n_item) - 1e-9)"""


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(common.documents(spark, sf_dir, "doc_id", "text"), BPE)


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(common.documents(spark, sf_dir, "doc_id", "text"), PIECES)


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(common.documents(spark, sf_dir, "doc_id", "text"), 8)


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.documents(spark, sf_dir, "doc_id", "text"))


ORACLE_SQL["op7_licenses"] = licenses.oracle()


@query
def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL["op10_perspectives"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(nullif(trim(regexp_replace(role, '<\|im_start\|>|<\|im_end\|>|[\r\n]+', ' ', 'g')), ''), 'unknown') AS speaker, regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<| \1|>', 'g') AS text FROM conversations
), seen AS (
  SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM turns WHERE speaker <> 'system'
), every AS (
  SELECT conv_id, perspective, turn, speaker, text, speaker = perspective AS own,
    '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END || chr(10) || text || '<|im_end|>' || chr(10) AS rendered
  FROM turns JOIN seen ON conv_id IS NOT DISTINCT FROM conv
), placed AS (
  SELECT *, row_number() OVER w - 1 AS position, sum(length(rendered)) OVER w AS done FROM every
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, position, turn, speaker, rendered, (done - length(rendered))::BIGINT AS char_start, done::BIGINT AS char_end,
  CASE WHEN own THEN (done - length(text) - 11)::BIGINT END AS learn_start, CASE WHEN own THEN (done - 1)::BIGINT END AS learn_end
FROM placed"""


def learnable():
    """Labels may be learnt from rows whose crc32 of the id, as text, is not divisible by five."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learnable=learnable())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (~learnable()).alias("held_out"), "score", "predicted")


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(common.documents(spark, sf_dir, "doc_id", "text"))


@query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), threshold=0.95)


ORACLE_SQL["op6_sharding"] = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))
), docs AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
    xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc
), steps AS (
  SELECT doc_id, coalesce(doc_id, 0)::HUGEINT AS key, 0::BIGINT AS b, 0::BIGINT AS j FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, next, j, floor((j + 1) * (2147483648.0::DOUBLE / ((next // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, j, (key * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS next FROM steps WHERE j < 9)
), placed AS (
  SELECT doc_id, max(b) FILTER (b < 8)::INT AS shard, max(b) FILTER (b < 9)::INT AS grown_shard FROM steps GROUP BY doc_id
)
SELECT d.doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY d.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM docs d JOIN placed p ON d.doc_id IS NOT DISTINCT FROM p.doc_id"""

#: Smallest id reachable by links (a, b), of the nodes in ``nodes`` (id).
REACH = """
linked AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT id, id FROM nodes UNION SELECT linked.b, reach.root FROM reach JOIN linked ON linked.a = reach.node),
component AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)"""

ORACLE_SQL["op3_embedding_dedup"] = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))) AND list_sum(list_transform(embedding, lambda c: abs(c))) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95), {REACH},
counted AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM nodes JOIN component ON node = id LEFT JOIN counted ON a = id"""

ORACLE_SQL["op8_near_dedup"] = rf"""
WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
worded AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' ')) END) AS s FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)), {REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM nodes JOIN component ON node = id LEFT JOIN sizes ON doc_id = id"""


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations, with totals over subtrees."""
    return conversation_trie.rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


ORACLE_SQL["op11_conversation_trie"] = conversation_trie.ORACLE_SQL


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of at most 2048 tokens."""
    return packing.pack(common.documents(spark, sf_dir, "doc_id", "text"), WORDS, size=2048, end=0)


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors: 16 parts, 64 entries, two rounds."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return vector_codes.with_label_errors(vector_codes.compress(vectors, parts=16, entries=64, rounds=2, scale=256))


ORACLE_SQL["op13_vector_codes"] = vector_codes.ORACLE_SQL
