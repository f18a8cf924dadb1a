"""Name -> callable and name -> DuckDB SQL for the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tallyloom.llm import bpe, codes, langid, mixing, ngram_join, ogg, oracles, packing, pii, quality, sharding, suffix_dedup, tandem, topk
from tallyloom.llm.common import held_out
from tallyloom.session import ship, table

#: Name of the vocabulary file, looked up among the public tokenizers of the machine.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_json(name: str = TOKENIZER) -> str:
    """Content of a vocabulary file, read where the driver runs; workers get it by broadcast."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out_of_training = held_out(F.col("doc_id"), 5, 0)
    model = langid.fit(docs, ~out_of_training)
    predicted = langid.predict(docs, model)
    return predicted.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.read(ogg.store(table(spark, sf_dir, "documents")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 3, 1), metadata=("n_chars",))
    scored = quality.score(docs, machine, metadata=("n_chars",))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"), length=200)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_json())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(table(spark, sf_dir, "documents"))


def op11_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.runs(table(spark, sf_dir, "documents"), least=24, exponent=3, planted=True)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_json(), capacity=2048, end_id=0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def shipped(query):
    """The query, with the package given to the Python workers first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    """The corpus queries: opN_<name>."""
    return {name: shipped(f) for name, f in QUERIES.items()}


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_ogg_media": op3_ogg_media,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_ngram_join": op6_ngram_join,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_bpe": op8_bpe,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
    "op11_tandem_runs": op11_tandem_runs,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_vector_codes": op13_vector_codes,
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the corpus queries that SQL expresses."""
    return dict(oracles.SQL)
