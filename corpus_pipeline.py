"""The corpus pipeline: language ID, line dedup, near duplicates, source mix, piece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is
written as Parquet and read again. All but the last return the columns of ``documents``.

Defined results: a null text, or one without a letter, goes at the first stage; very short texts stay there;
an empty text can't come further. A document that loses all its lines goes, one that loses some keeps the
others. Rows of equal ids are rows of their own in every stage; of equal texts the first by id stays, null
ids last. Very long texts are taken whole. An empty table gives an empty result with the last stage's columns.
Extra columns pass through to the last stage, whatever they are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchloom.llm.common import discard, documents, materialize
from watchloom.llm.language_id import in_known_language
from watchloom.llm.line_dedup import without_repeated_lines
from watchloom.llm.mixing import mixture
from watchloom.llm.ngram_join import near_duplicates
from watchloom.llm.pieces import encode_documents


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter or in no known language."""
    return in_known_language(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that repeat an earlier line; drops documents left without any."""
    return without_repeated_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_duplicates(docs).filter("kept").select("doc.*")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the sources to their target weights; a document may come twice."""
    return mixture(docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text into pieces."""
    return encode_documents(docs)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mix_stage),
    ("SentencePiece encoding and decoding", piece_stage),
]

#: SQL can't express the language and piece stages; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if hasattr(docs, "written_to"):  # the stage before's table has been read for the last time
            discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
