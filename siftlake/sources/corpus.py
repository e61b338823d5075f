"""The file tree that the tables stand for: files of documents, parts, customers and pages, and the folders that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOME = "/Users/u"
NOW = 1_706_745_600

#: table: path, size, mtime, body as SQL over the table ({str} is the string type, {bytes} the length of a text in bytes).
FILES = {
    "documents": (
        "concat('/Users/u/notes/', lang, '/', source, CASE doc_id % 7 WHEN 0 THEN '/build' WHEN 1 THEN '/.cache' WHEN 2 THEN '/src' ELSE '' END, '/doc_', lpad(CAST(doc_id AS {str}), 6, '0'), "
        "CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.rs' WHEN 3 THEN '.json' ELSE '.log' END)",
        "{bytes:text}",
        "1706745600 - (doc_id * 7919 % 400) * 86400 - (doc_id * 104729 % 86400)",
        "text",
    ),
    "part": (
        "concat('/Users/u/Catalog/', p_brand, '/', p_type, '/', p_name, ' ', CAST(p_partkey AS {str}), '.key')",
        "CAST(p_size AS BIGINT) * 1000",
        "1706745600 - (p_partkey * 6151 % 900) * 86400",
        "CAST(NULL AS {str})",
    ),
    "customer": (
        "concat('/Users/u/Contacts/', n_name, '/', c_name, '.vcf')",
        "200 + c_custkey % 50",
        "1706745600 - (c_custkey * 3571 % 60) * 3600",
        "CAST(NULL AS {str})",
    ),
    "pages": (
        "concat('/Users/u/Sites/', regexp_extract(url, '^https?://([^/]+)', 1), '/page_', CAST(page_id AS {str}), '.html')",
        "{bytes:html}",
        "1706745600 - (page_id * 4099 % 120) * 86400",
        "html",
    ),
}


def sql_of(text: str, spark: bool) -> str:
    """An expression of FILES in one of the two dialects."""
    for name in ("text", "html"):
        text = text.replace(f"{{bytes:{name}}}", f"octet_length({name})" if spark else f"octet_length(encode({name}))")
    return text.replace("{str}", "STRING" if spark else "VARCHAR")


def files(spark: SparkSession, sf_dir: str, body: bool = False, tables: tuple[str, ...] = tuple(FILES)) -> DataFrame:
    """path, size, mtime (and body) of every file."""
    out = None
    for name in tables:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "customer":
            nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
            df = df.join(nation, df.c_nationkey == nation.n_nationkey)
        path, size, mtime, text = (sql_of(x, True) for x in FILES[name])
        columns = [f"{path} AS path", f"CAST({size} AS BIGINT) AS size", f"CAST({mtime} AS BIGINT) AS mtime"] + [f"{text} AS body"] * body
        part = df.selectExpr(*columns)
        out = part if out is None else out.unionByName(part)
    return out


def with_names(df: DataFrame) -> DataFrame:
    """parent and name of each path."""
    return df.withColumns({"name": F.substring_index("path", "/", -1), "parent": F.regexp_replace("path", "/[^/]*$", "")})


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, parent, name, kind (0 file, 1 folder), size, mtime: all files and every folder above one."""
    own = files(spark, sf_dir)
    # Folders are few beside files: each is cut into those above it once.
    held = own.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.max("mtime").alias("mtime")).filter("folder <> ''")
    parts = F.split("folder", "/")
    above = F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    folders = held.select(above.alias("path"), "mtime").groupBy("path").agg(F.max("mtime").alias("mtime"))
    folders = folders.select("path", F.lit(0).cast("bigint").alias("size"), "mtime", F.lit(1).alias("kind"))
    return with_names(own.withColumn("kind", F.lit(0)).unionByName(folders)).select("path", "parent", "name", "kind", "size", "mtime")


def files_sql(body: bool = False, tables: tuple[str, ...] = tuple(FILES)) -> str:
    """The same for the oracle: a SELECT of path, size, mtime (and body)."""
    out = []
    for name in tables:
        path, size, mtime, text = (sql_of(x, False) for x in FILES[name])
        source = "customer JOIN nation ON c_nationkey = n_nationkey" if name == "customer" else name
        out.append(f"SELECT {path} AS path, CAST({size} AS BIGINT) AS size, CAST({mtime} AS BIGINT) AS mtime{f', {text} AS body' if body else ''} FROM {source}")
    return " UNION ALL ".join(out)


#: CTEs of the oracle: files f, entries e (with the parts of the parent, for ties).
ENTRIES_SQL = f"""f AS ({files_sql()}),
g AS (SELECT path, unnest(range(2, len(string_split(path, '/')))) AS i, mtime FROM f),
d AS (SELECT array_to_string(string_split(path, '/')[1:i], '/') AS path, CAST(0 AS BIGINT) AS size, max(mtime) AS mtime FROM g GROUP BY 1),
e AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, string_split(path, '/')[-1] AS name, kind, size, mtime
      FROM (SELECT path, 0 AS kind, size, mtime FROM f UNION ALL SELECT path, 1, size, mtime FROM d))"""
