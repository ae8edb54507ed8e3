"""A training corpus from documents: five stages, each over all that the one before kept.

``run`` writes each stage's rows below the session's shared folder and reads them
again as the documents of the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import line_dedup, mixing, near_dup, pieces, quality
from folioscan.llm.common import load, materialise
from folioscan.llm.queries import GOOD_FROM, MIX_PERCENT, MIX_SEED, MIX_WEIGHTS, domain_of, model_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null text is scored as an empty one; rows are judged one by one, so rows without an
    id and repeated rows stay or go by their own text.  Without labels every score is 0.5,
    below the threshold; an empty table stays empty.  Other columns than ``COLUMNS`` are
    left behind, whatever their names.
    """
    model = quality.train(docs, load(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, keep=COLUMNS, threshold=GOOD_FROM).where("predicted = 1").select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of a smaller id holds as well go; ``n_chars`` follows the text.

    A null text becomes an empty one.  Rows of one id are one document, which keeps its own
    repeats; rows without an id are one document behind all others.  Every row stays, if only
    with an empty text.
    """
    index = line_dedup.LineIndex.build(docs)
    kept = line_dedup.dedup_lines(docs, index, keep=["lang", "source"])
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id.

    Null texts are empty, and texts without words are copies of each other.  Of rows that
    share an id one stays.  Rows without an id cannot be told apart, so all of them stay.
    """
    kept = near_dup.keep_representatives(docs, near_dup.near_duplicates(docs))
    return kept.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's prefix of one seeded epoch, under budgets from the target weights.

    Documents leave here by design, whatever their quality: half of the tokens are budgeted.
    Null names of a language or source are the name ''; null texts cost nothing.  The seeded
    order is by id, so rows without one have no place in it and go; rows that share an
    id stay or go together.
    """
    chosen = mixing.mix_sources(docs, MIX_WEIGHTS, domain_of(F.col("source")), MIX_PERCENT, 1, MIX_SEED)
    return docs.join(chosen.select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the byte spans of the pieces; a null or empty text has none.  Every row stays."""
    coded = pieces.encode(docs, model_file(), keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "begins", "ends")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding", sentencepiece_encoding),
]

#: A classifier, a similarity and a tokenizer are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
