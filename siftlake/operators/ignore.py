"""Ignore files: which entries the rules of the folders above leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.globs import ignore_rule

#: Later ones win over earlier ones.
SOURCES = ("global", "exclude", ".gitignore", ".ignore")
RULES = "dir string, source int, seq int, regex string, white boolean, dir_only boolean"


def rules_of(spark: SparkSession, files: list[tuple[str, str, str]]) -> DataFrame:
    """RULES of ignore files given as (folder, one of SOURCES, text)."""
    rows = []
    for folder, source, text in files:
        for seq, line in enumerate(text.splitlines()):
            if rule := ignore_rule(line):
                rows.append((folder, SOURCES.index(source), seq, *rule))
    return spark.createDataFrame(rows, RULES)


def ancestors(path: str, itself: bool) -> F.Column:
    """The folders above a path, with the path itself or without."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - (0 if itself else 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def ignored(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """path of the entries (path, kind; folders are rows too) that are left out.

    Each entry is judged once, by the rules of the folders above it: the last that matches, of the strongest source and then the
    deepest folder, decides. What lies in a folder that is left out is left out too, whatever else lets it in. Folders above are
    exploded and joined by equality; the rules of one folder travel as one array, which is as long as its ignore files.
    """
    rule = F.struct("source", F.length("dir").alias("depth"), "seq", "white", "dir_only", "regex")
    by_folder = rules.groupBy(F.col("dir").alias("above")).agg(F.collect_list(rule).alias("rules"))
    own = entries.select("path", "kind", F.explode(ancestors("path", False)).alias("above"))
    held = own.join(by_folder, "above").withColumn("below", F.expr("substring(path, length(above) + 2)"))
    hits = held.withColumn("hit", F.expr("array_max(transform(filter(rules, r -> (NOT r.dir_only OR kind = 1) AND below RLIKE r.regex), r -> named_struct('source', r.source, 'depth', r.depth, 'seq', r.seq, 'white', r.white)))"))
    judged = hits.filter("hit IS NOT NULL").groupBy("path").agg(F.max("hit").alias("hit"))
    out = judged.filter("NOT hit.white").select("path")
    under = entries.select("path", F.explode(ancestors("path", True)).alias("above"))
    return under.join(out.withColumnRenamed("path", "above"), "above", "left_semi").select("path").distinct()
