"""The corpus pipeline: quality, language, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from siftlake.llm import exact_dedup as exact
from siftlake.llm import langid, near_dedup, packing, quality
from siftlake.llm.common import crc_mod, numbered, plain_names, table, tune, written


def judged(docs: DataFrame, judge: Callable[[DataFrame, list[str], str], DataFrame], keep: Column) -> DataFrame:
    """Rows of docs that keep holds for, once judge has added its columns; names in docs never clash with those."""
    plain, names = plain_names(docs)
    return judge(plain, list(names.values()), names["text"]).filter(keep).select(*[F.col(v).alias(k) for k, v in names.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones that are not held out, takes as good."""
    tune(spark)
    chain = quality.train(docs, table(spark, sf_dir, "labels"))
    return judged(docs, lambda d, columns, text: quality.score(d, chain, columns, text), F.col("predicted") == 1)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin."""
    tune(spark)
    model = langid.fit(docs.filter(crc_mod("doc_id", 3) != 1))
    return judged(docs, lambda d, columns, text: langid.predict(d, model, columns, text), ~F.col("rejected"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the one of the smallest id."""
    tune(spark)
    return exact.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document of the smallest id."""
    tune(spark)
    plain, names = plain_names(docs)
    rows = numbered(plain)
    kept = near_dedup.near_duplicates(rows, names["doc_id"], names["text"], "row").filter("kept").select("row")
    return rows.join(kept, "row", "left_semi").select(*[F.col(v).alias(k) for k, v in names.items()])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences."""
    tune(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs


#: Classifier, language dictionaries, near duplicates and packing have no SQL form; the tests hold run() to a plain version.
ORACLE_SQL = None
