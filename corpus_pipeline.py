"""A training-corpus pipeline: five stages, each a corpus operator over what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, langid, mixing, ngram_join, pii
from tallyloom.llm.common import folder, scratch, written
from tallyloom.session import ship, table

#: Name of the vocabulary file among the public tokenizers of the machine.
TOKENIZER = "word_bpe_49k.json"
#: A text is rejected whose language has a lower posterior than this, or that has no letter.
SURE = 0.5

#: Rows of an Arrow batch: texts are wide, and a batch is held by an executor and its Python worker a few times over.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def ready(spark: SparkSession) -> None:
    """Workers get this package; batches get BATCH rows, unless the session has a number of its own (Spark's is 10,000)."""
    ship(spark)
    if spark.conf.get(BATCH[0]) == "10000":
        spark.conf.set(*BATCH)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter or of no recognised language; fill in missing languages.

    Null and empty texts have no letter and go. Rows are judged by their text alone: null and repeated
    ids, repeated rows and very long texts stay like any other, and a language that is given stays.
    """
    ready(spark)
    model = langid.fit(docs, F.lit(True))
    tagged = langid.annotated(docs, model)
    kept = tagged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by five-word shingles at 0.8, the document of the smallest id stays.

    Documents are told apart by id and text, so a null id is one like any other (it comes last) and
    different texts of one id are different documents. Of rows of one id and text one stays: the
    least by all columns, with nulls first. Texts without words are in groups of their own.
    """
    ready(spark)
    row = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())
    keyed = docs.select(row.alias("_row"), "doc_id", "text")
    groups = ngram_join.linked(keyed, n=5, num=80, den=100, id_col="_row").select(F.col("doc_id").alias("_label"), F.col("component_id").alias("_group")).distinct()
    ids = keyed.select("_row", "doc_id").distinct()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = ids.join(groups.hint("merge"), F.col("_row") == F.col("_label")).groupBy("_group").agg(best.alias("best")).select(F.col("best._row").alias("_kept"))
    mine = docs.withColumn("_row", row).join(kept.hint("merge"), F.col("_row") == F.col("_kept"), "left_semi")
    return mine.groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("least")).select(*[F.col(f"least.{c}").alias(c) for c in docs.columns])


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and n_chars follows.

    Every row stays, whatever its id; a null text stays null, with n_chars null; texts without personal data are untouched.
    """
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; of one that it takes in part, whole copies to the nearest.

    A text without words has size 0, takes no part and goes. Null ids and a null source are like any
    other; equal rows are told by their number, and rows that only share an id are apart.
    """
    # tables of ids grow with the documents, so they are joined by sorting at any size; a row is known by all its columns
    row = F.xxhash64(*[x for c in docs.columns for x in (F.col(c), F.col(c).isNull())])
    docs = docs.withColumn("_row", row)
    mixed = mixing.mix(docs, keep=("_row",))
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    per_row = mixed.where("size > 0").groupBy("_row").agg(F.sum(copies).cast("int").alias("_copies"))
    times = written(per_row.select(F.col("_row").alias("_mixed"), "_copies").where("_copies > 0"), "mix-copies")
    each = docs.dropDuplicates(["_row"])  # equal rows are counted in the copies
    repeated = each.join(times.hint("merge"), F.col("_row") == F.col("_mixed")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*[c for c in docs.columns if c != "_row"])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, as digests, and of the text decoded from them; a null text has none. Every row stays."""
    ready(spark)
    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        return bpe.encode_decode(docs, f.read())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("private", private),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL expresses neither the trained language model nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again; what a stage wrote besides goes with it.

    An empty table passes through all stages. Columns besides those of documents are kept as they are.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        place = folder(spark, f"stage-{name}")
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(place)
        docs = spark.read.schema(kept.schema).parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
