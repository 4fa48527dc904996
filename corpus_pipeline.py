"""A training corpus from documents, in five stages; each one reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlake.llm import language, packing, paragraph_dedup, pii, simhash
from quietlake.llm.common import table, written

#: A document stays if one language has at least this share of its mixture.
MIN_SHARE = 0.5


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, whose names meet none of those that the operators give theirs."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    return docs.select("doc_id", "text", F.struct(*rest).alias("document"))


def _unpacked(carried: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns as they were, but for text and those that are new."""
    kept = {c: F.col("document").getField(f"c{i}") for i, c in enumerate(columns)} | {"text": F.col("text")} | new
    return carried.select(*[kept[c].alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language, which becomes their lang; those without letters or a main language go."""
    carried = _carried(docs)
    out = language.predict(carried, language.train(docs), keep=carried.columns)
    out = out.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_SHARE))
    return _unpacked(out, docs.columns, lang=F.col("lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id; rows without one stay.

    Near-duplicates are those of op2: fingerprints of four-word shingles within 4 bits, by
    pigeonring. Of what they leave, documents with a similarity of 0.8 on five-word shingles are
    near-duplicates too, which is about 10 bits and too wide for fingerprints.
    """
    left = written(simhash.first_of_each(_carried(docs), simhash.fingerprint_classes(docs)), "fingerprinted")
    return _unpacked(simhash.first_of_each(left, simhash.similar_documents(left, shingle_words=5, threshold=0.8)), docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; documents of which nothing is left go."""
    return _unpacked(paragraph_dedup.deduplicated(_carried(docs)), docs.columns, n_chars=F.length("text").cast("long"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets."""
    carried = _carried(docs)
    found = pii.find(carried, keep=carried.columns, materialise=False)
    out = found.withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    return _unpacked(out, docs.columns, n_chars=F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("PII", mask_personal_data),
    ("packing", pack_sequences),
]

#: Mixtures, fingerprints, classifiers and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
