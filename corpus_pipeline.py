"""A training corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geograph.llm import importance, jaccard_join, mixing, packing, suffix_dedup
from geograph.llm.common import stage_table
from geograph.llm.queries import good_labels, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go.

    Null, empty and blank texts have no n-gram and go. A null id is never labelled,
    but its text is judged like any other. Repeated rows are judged alike and, at a
    tie of sample keys, kept alike. Texts of any length are read whole. Columns of
    any name go through; an empty table stays empty; without labels documents of
    at least average likeness stay.
    """
    return importance.keep_best(docs, good_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Jaccard join on five-word shingles from 0.8 on: one document of each group stays.

    Of each component the row of the least id stays, of equal ids the first row; a
    null id comes last. Rows are judged by their own texts, so repeated rows leave
    one, and an id with several texts may keep several. Null, empty and blank texts
    are like nothing and stay. Texts are read whole; columns of any name go through;
    an empty table stays empty.
    """
    return jaccard_join.keep_one(docs, width=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: strings of 200 bytes that occur twice are cut out.

    Every occurrence goes, in the same document too; a character that is cut in part
    goes whole. Documents that have nothing left go, and so do both of two equal
    rows of 200 bytes or more, though none come from the stage before. Null and
    empty texts stay as they are. n_chars follows the text; columns of any name go
    through; an empty table stays empty.
    """
    return suffix_dedup.cut_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: documents as often, and as far, as they are taken.

    A null source is a source of its own. A document that is taken twice stands
    twice; one of which some blocks are taken is cut to each run of them. Null,
    empty and blank texts have no words and are not taken. Documents go by id, equal
    and null ids by their place in the table, so reruns agree. n_chars follows the
    text; columns of any name go through; an empty table gives an empty mix.
    """
    return mixing.mix_texts(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing along the Hilbert curve: pieces of sequences, with their ids.

    A null or empty text is one end id. Documents of equal curve keys go by id, then
    by their place in the table; a null id comes first. Repeated rows are packed
    each; texts of any length are cut freely. Other columns are not read; an empty
    table gives no pieces.
    """
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("sequences", sequences)]

#: The sampling stages follow hashes and generators that SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
