"""Version-control status text (porcelain v2, NUL-separated) to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.enrich import ADDED, CONFLICT, DELETED, IGNORED, MODIFIED, RENAMED, STAGED, UNTRACKED


def status_rows(texts: DataFrame) -> DataFrame:
    """listed, bits, is_dir of captured status texts (repo, text): paths from the root on; a Python table function over the texts."""

    @F.udtf(returnType="path string, bits int, is_dir boolean")
    class Records:
        def eval(self, text: str):
            yield from parse_status(text or "")

    texts.sparkSession.udtf.register("siftlake_status", Records)
    texts.createOrReplaceTempView("siftlake_status_texts")
    return texts.sparkSession.sql("SELECT concat(t.repo, '/', r.path) AS listed, r.bits, r.is_dir FROM siftlake_status_texts t, LATERAL siftlake_status(t.text) r")


def commit_rows(texts: DataFrame) -> DataFrame:
    """commit, ts, merge, path of captured logs (repo, text): NUL before each commit, then its seconds, then a file a line."""
    each = texts.select("repo", F.posexplode(F.split("text", "\0")).alias("at", "block")).filter("block <> ''")
    lines = F.split("block", "\n")
    named = each.select("repo", F.concat_ws("@", "repo", F.col("at").cast("string")).alias("commit"), F.trim(lines[0]).try_cast("long").alias("ts"), F.filter(F.slice(lines, 2, 1 << 30), lambda x: x != "").alias("files"))
    files = named.select("repo", "commit", F.coalesce("ts", F.lit(0)).alias("ts"), F.explode_outer("files").alias("file"))
    return files.select("commit", "ts", F.lit(False).alias("merge"), F.concat("repo", F.lit("/"), "file").alias("path"))


def parse_status(text: str) -> list[tuple[str, int, bool]]:
    """(path, bits, is folder) of each record."""
    out, records = [], iter(text.split("\0"))
    for r in records:
        kind = r[:1]
        if kind in "?!" and kind:
            path = r[2:]
            out.append((path.rstrip("/"), UNTRACKED if kind == "?" else IGNORED, path.endswith("/")))
        elif kind in ("1", "2", "u"):
            fields = r.split(" ", {"1": 8, "2": 9, "u": 10}[kind])
            staged, tree = fields[1]
            bits = CONFLICT if kind == "u" else 0
            if kind != "u":
                bits |= STAGED if staged != "." else 0
                bits |= {"A": ADDED, "D": DELETED, "R": RENAMED, "C": RENAMED}.get(staged, 0)
                bits |= {"M": MODIFIED, "T": MODIFIED, "D": DELETED}.get(tree, 0)
            out.append((fields[-1], bits, False))
            if kind == "2":
                next(records, None)
    return out
