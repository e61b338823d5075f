"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary of every partition's digests finds the few that can be frequent; their exact statistics are broadcast
(at most ``capacity + 1`` rows, whatever the input) so that rows of hot groups never shuffle. All other digests take the
ordinary path, a grouped aggregate joined back on the digest, where no group is large any more.

Defined results: a null text counts as empty; equal rows (same id and text) are separate members of a group of which the first
in the table stays; a null id is never smaller than another id; an empty table gives an empty result; extra columns, of whatever
name, are ignored by exact_groups and kept by exact_dedup.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import numbered, plain_names, text_of, written

#: White space that is folded before texts are compared.
SPACE = r"[\x20\x09-\x0D]+"
CAPACITY = 1024


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space turned into one space."""
    return F.regexp_replace(text, SPACE, " ")


def summarise(counts: dict[bytes, int], capacity: int) -> dict[bytes, int]:
    """The Misra-Gries step: no more than capacity counters, each too small by at most the same amount."""
    if len(counts) <= capacity:
        return counts
    cut = sorted(counts.values(), reverse=True)[capacity]
    return {k: v - cut for k, v in counts.items() if v > cut}


def heavy_candidates(digests: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Digests that may hold over 2 n / (capacity + 1) of the n rows: no more than capacity + 1 of them."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[bytes, int] = {}
        seen = 0
        for batch in batches:
            seen += len(batch)
            for digest, n in batch["digest"].value_counts().items():
                counts[digest] = counts.get(digest, 0) + int(n)
            counts = summarise(counts, capacity)
        yield pd.DataFrame({"digest": [None, *counts], "n": [seen, *counts.values()]})

    summed = digests.select("digest").mapInPandas(scan, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    summed = written(summed, "heavy")
    rows = summed.filter(F.col("digest").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # A counter falls short of the truth by at most rows / (capacity + 1), so nothing over twice that is missed.
    return summed.filter(F.col("digest").isNotNull() & (F.col("n") > rows / (capacity + 1))).select("digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, row_no (row_col of docs, if given)."""
    digests = docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(normalised(text_of(text_col)), 256)).alias("digest"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row_no"),
    )
    digests = written(digests, "digests")
    # A null id sorts after all others; row_no decides between rows of the same id.
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row_no"))
    stats = [F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")]
    heavy = heavy_candidates(digests, capacity)
    winners = written(digests.join(F.broadcast(heavy), "digest").groupBy("digest").agg(*stats), "winners")
    marked = digests.join(F.broadcast(winners), "digest", "left")
    hot = marked.filter(F.col("group_size").isNotNull())
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    cold = rest.join(rest.groupBy("digest").agg(*stats), "digest")
    return hot.unionByName(cold).select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        F.col("group_size"),
        (F.col("row_no") == F.col("first.row_no")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("row_no"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    plain, names = plain_names(docs)
    rows = numbered(plain)
    groups = exact_groups(rows, names[id_col], names[text_col], capacity, "row")
    kept = rows.join(groups.filter("kept").select(F.col("row_no").alias("row")), "row", "left_semi")
    return kept.select(*[F.col(v).alias(k) for k, v in names.items()])
