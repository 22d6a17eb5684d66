"""From raw documents to packed training sequences: the stages of the corpus pipeline.

Each stage reads doc_id, text, lang, source and n_chars; further columns, whatever their names, are dropped. An
empty table gives an empty one. Rows are judged by themselves, so repeated rows stay repeated until
`near_duplicates` keeps one; ids, langs and sources may be null everywhere. Whole texts are read, of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import langid, line_rules, mixing, near_dup, packing
from offerloom.llm.common import stored
from offerloom.session import small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from four fifths of the rows, as by op1.

    Null and empty texts and texts without a letter go, as do texts whose score is under the threshold for their length.
    """
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs.filter(langid.remainder(5) != 0))
    return langid.identify(docs, model).filter(~F.col("rejected")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail; n_chars is that of the text that is left.

    Null and empty texts go: they have fewer than twenty words.
    """
    kept = line_rules.judge(docs.select(*COLUMNS)).filter("kept")
    return kept.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class of near-duplicates, a null id counting as least; of equal rows one.

    Texts without words, null ones too, are one class.
    """
    small_batches(spark)
    return near_dup.one_of_each(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as rows of the documents they are from; blocks have 1,024 words.

    A null source is a source of its own. Documents without words give no row, others as many as blocks of them are taken.
    """
    return mixing.mix_documents(docs.select(*COLUMNS), block_words=1024).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 1,024 tokens; a null text is an end id alone."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: Language, near-duplicates, mixture and tokens cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
