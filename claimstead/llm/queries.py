"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstead.llm.bpe_fst import encode_decode
from claimstead.llm.chat_format import format_conversations, read_formatted
from claimstead.llm.common import read_table, stored
from claimstead.llm.hilbert_neighbours import nearest
from claimstead.llm.language_id import language_id
from claimstead.llm.packing import best_fit_pack
from claimstead.llm.parity_join import similar_documents
from claimstead.llm.personal_data import BASE, count_of, find_personal_data, span_list
from claimstead.llm.quality_rules import quality_rules
from claimstead.llm.suffix_dedup import remove_repeats
from claimstead.llm.token_store import store_documents


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), ["doc_id"]).drop("kept_text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    counts = [count_of(spans, k).alias(f"n_{k}") for k in BASE]
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    scores = F.array_join(F.transform(spans, lambda x: x["score"].cast("string")), ",").alias("scores")
    found = find_personal_data(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(spans).alias("spans"), scores)


def op6_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_formatted(stored(format_conversations(rows.unionByName(added)), "chat"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_documents(read_table(spark, sf_dir, "documents"), size=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_quality_rules, op4_best_fit_packing, op5_personal_data, op6_hilbert_neighbours, op7_chat_format, op8_bpe_transducer, op9_parity_join, op10_token_store)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL: dict[str, str] = {
    "op9_parity_join": f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM words WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN sizes z USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) m USING (doc_id)
""",
}
