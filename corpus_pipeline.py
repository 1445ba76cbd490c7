"""The corpus pipeline: five of the ten operators, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the
columns of documents. The decisions need more than SQL, so there is no ORACLE_SQL; tests compare with brute force.
Rows without a doc_id stay unless their text is rejected: near-duplicate removal keeps them all, as its operator does,
and decontamination judges them by their text. Extra columns are carried, whatever their names. run() removes the table
of a stage once the next one is written; the last one's input stays, as its result is read from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, language_id, minhash, pii, sentencepiece_codec
from folioflow.llm.common import documents, fresh, small_batches
from folioflow.sources.shared import remove, written

#: A language is rejected when it is unknown or less probable than this.
MIN_LANGUAGE_SCORE = 0.5
TOKENIZER = f"{sentencepiece_codec.TOKENIZERS}/{sentencepiece_codec.MODEL}"
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay, as they are."""
    small_batches(spark)
    keep = tuple(c for c in docs.columns if c != "doc_id")
    lang, score = fresh(docs.columns, "stage_lang", "stage_score")
    judged = language_id.predict(docs, language_id.train(docs), keep=keep, out=(lang, score))
    good = (F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)
    return judged.filter(good).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays, and all without an id. An id stays when
    one of its rows is kept. Rows without an id aren't joined, as they would all meet in one task."""
    small_batches(spark)
    kept = minhash.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    known = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return known.unionByName(docs.filter("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share 10 words in a row, or a whole shorter item, with the benchmark go. Rows are judged by their
    own texts: an id of one text may be repeated with another, and a digest stands in for one that is missing."""
    small_batches(spark)
    (name,) = fresh(docs.columns, "stage_id")
    named = docs.withColumn(name, F.when(F.col("doc_id").isNotNull(), F.concat_ws(" ", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))).otherwise(F.concat(F.lit("text "), F.sha2(F.coalesce("text", F.lit("")), 256))))
    bad = decontaminate.decontaminate(named, documents(spark, sf_dir, "benchmark"), id_col=name).filter("contaminated").select(name).distinct()
    return named.join(bad, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text. Every document stays."""
    found = pii.find_pii(docs, carry=True)
    clean = F.when(F.col("_none"), F.lit(None).cast("string")).otherwise(pii.redact(F.col("text"), F.col("spans")))
    out = found.select("_row", (F.size("spans") > 0).alias("_changed"), clean.alias("_clean"))
    new = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_changed"), F.length("_clean").cast("bigint")).otherwise(F.col("_row.n_chars"))
    return out.select(*[(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids, restored): piece ids, decoded again to see that the text comes back."""
    small_batches(spark)
    return sentencepiece_codec.round_trip(docs, TOKENIZER).select("doc_id", "ids", "n_ids", "restored")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
        if before is not None:
            remove(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
