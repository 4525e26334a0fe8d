"""The corpus pipeline: stages that each take what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Between stages
the rows are written as Parquet in the shared folder and read again. All but the last stage return the
columns of ``documents``, and further ones of any name. Documents with null ids, null or empty texts pass through wherever a
stage has no reason to drop them; ties go to the least id; rows alike in id and text share their fate but at the n-gram join, where one
of them stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismloom.llm import bpe, decontamination, langid, linededup, ngramjoin
from prismloom.llm.storage import row_key, table, written

VOCABULARY = "byte_bpe_50k.json"


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under names that clash with nothing, and the new name of each column."""
    own = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is unknown: texts that are null or have no letter.

    Where there is nothing to learn from, all languages are unknown.
    """
    rows, own = _renamed(docs)
    net = langid.fit(rows, id=own["doc_id"], text=own["text"], lang=own["lang"])
    found = langid.identify(rows, net, text=own["text"])
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(*own.values()).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages from texts. ``n_chars`` follows the text; documents of which nothing is left go."""
    rows, own = _renamed(docs)
    found = linededup.dedup_lines(rows, id=own["doc_id"], text=own["text"])
    left = found.where((F.col("n_removed") == 0) | F.col(own["text"]).rlike(r"\S"))
    if "n_chars" in own:
        left = left.withColumn(own["n_chars"], F.char_length(own["text"]).cast(rows.schema[own["n_chars"]].dataType))
    return left.select(*own.values()).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, whole."""
    return ngramjoin.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages to the extent that the contract calls contaminated."""
    rows, own = _renamed(docs)
    keyed = rows.withColumn("row_key", row_key(F.col(own["doc_id"]), F.col(own["text"])))
    found = decontamination.decontaminate(keyed.select("row_key", F.col(own["text"]).alias("text")), table(spark, sf_dir, "benchmark"), keys=["row_key"])
    return keyed.join(found.where("contaminated").select("row_key"), "row_key", "left_anti").select(*own.values()).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_equal): token ids, and whether they decode to the text."""
    path = public_tokenizers.path(VOCABULARY)
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return both.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same.alias("decoded_equal"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("line_dedup", line_dedup),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminated),
    ("bpe", tokens),
]
#: Training, pruning by probabilities and BPE are beyond SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
