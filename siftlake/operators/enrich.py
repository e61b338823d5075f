"""Enrichment of hits: usage that fades, nearness, version-control status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

HALF_LIFE = 14 * 86_400
QUIET = 30
LEAST_SCORE = 0.06
MOST_USED, KEPT = 4096, 3072
HISTORY, MOST_COMMITS, MOST_FILES = 60 * 86_400, 1000, 50
# Status bits.
MODIFIED, STAGED, ADDED, DELETED, RENAMED, UNTRACKED, IGNORED, CONFLICT = (1 << i for i in range(8))


def debounced_score(times: str, now: int) -> Column:
    """Opens that fade by half in two weeks; one less than QUIET seconds after the last accepted one doesn't count."""
    step = f"(a, t) -> CASE WHEN a.last IS NULL OR t - a.last >= {QUIET} THEN named_struct('last', t, 'score', a.score + power(2D, -({now} - t) / {HALF_LIFE}D)) ELSE a END"
    return F.expr(f"aggregate({times}, named_struct('last', CAST(NULL AS BIGINT), 'score', 0D), {step}).score")


def frecency(opens: DataFrame, now: int) -> DataFrame:
    """path, score of opens (path, ts).

    An open QUIET seconds or more after the one before it always counts, so times are cut there into runs, which are folded by
    themselves: an array is as long as one run, never as a path's whole history.
    """
    own = Window.partitionBy("path").orderBy("ts")
    fresh = F.coalesce(F.col("ts") - F.lag("ts").over(own) >= QUIET, F.lit(True)).cast("int")
    runs = opens.select("path", "ts").distinct().withColumn("run", fresh).withColumn("run", F.sum("run").over(own))
    times = runs.groupBy("path", "run").agg(F.array_sort(F.collect_list("ts")).alias("times"))
    scores = times.select("path", debounced_score("times", now).alias("score")).groupBy("path").agg(F.sum("score").alias("score"))
    return scores.filter(F.col("score") >= LEAST_SCORE)


def trimmed_usage(scores: DataFrame) -> DataFrame:
    """Usage (path, score): once it has more than MOST_USED paths, the KEPT of the highest score, ties by path."""
    if scores.limit(MOST_USED + 1).count() <= MOST_USED:
        return scores
    return scores.orderBy(F.desc("score"), "path").limit(KEPT)


def history(commits: DataFrame, now: int) -> DataFrame:
    """path, score of own commits (commit, ts, merge, path: a row a file): each fades like an open.

    Of the last 60 days the latest MOST_COMMITS that are no merges count, and those of over MOST_FILES files are then left out.
    """
    known = commits.filter(~F.col("merge") & (F.col("ts") >= now - HISTORY)).groupBy("commit", "ts").agg(F.count("path").alias("files"))
    latest = known.orderBy(F.desc("ts"), "commit").limit(MOST_COMMITS).filter(F.col("files") <= MOST_FILES)
    weight = F.pow(F.lit(2.0), -F.greatest(F.lit(now) - F.col("ts"), F.lit(0)) / F.lit(float(HALF_LIFE)))
    # MOST_COMMITS rows at most.
    return commits.select("commit", "path").filter(F.col("path").isNotNull()).join(F.broadcast(latest.select("commit", "ts")), "commit").groupBy("path").agg(F.sum(weight).alias("score"))


def worked_on(opens: DataFrame, commits: DataFrame | None, now: int) -> DataFrame:
    """path, score: opens and own commits together."""
    used = frecency(opens, now)
    both = used if commits is None else used.unionByName(history(commits, now))
    return both.groupBy("path").agg(F.sum("score").alias("score"))


def boost(score: Column) -> Column:
    """Up to 40; none for what was never opened (least would pass over a null)."""
    return F.least(12 * F.log1p(F.coalesce(score, F.lit(0.0))), F.lit(40)).cast("int")


def nearness(path: Column, near: str) -> Column:
    """12 in the same folder, 3 less for each folder apart, 0 at least; the file itself -20."""
    folder = [c for c in near.split("/")[:-1] if c]
    own = F.slice(F.filter(F.split(path, "/"), lambda c: c != ""), F.lit(1), F.size(F.filter(F.split(path, "/"), lambda c: c != "")) - 1)
    want = F.array(*[F.lit(c) for c in folder])
    shared = F.aggregate(F.transform(F.arrays_zip(own.alias("a"), want.alias("b")), lambda z: z["a"] == z["b"]), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
                         lambda a, x: F.struct((a["n"] + F.when(a["go"] & F.coalesce(x, F.lit(False)), 1).otherwise(0)).alias("n"), (a["go"] & F.coalesce(x, F.lit(False))).alias("go")))["n"]
    apart = F.size(own) + len(folder) - 2 * shared
    return F.when(path == near, -20).otherwise(F.greatest(F.lit(0), 12 - 3 * apart))


def status_of(paths: DataFrame, listed: DataFrame) -> DataFrame:
    """path, bits: a file's own, else those of the deepest listed folder above it, else 0.

    Folders are few beside files: each distinct one is cut into those above it, which are joined by equality, so no pair of path and
    prefix is ever tried.
    """
    parent = F.regexp_replace("path", "/[^/]*$", "")
    own = listed.groupBy(F.col("listed").alias("path")).agg(F.first("bits").alias("own"))
    folders = paths.select(parent.alias("parent")).distinct()
    hits = with_above(folders, "parent", "listed").join(listed.filter("is_dir"), "listed")
    best = hits.groupBy("parent").agg(F.max_by("bits", F.length("listed")).alias("inherited"))
    found = paths.join(own, "path", "left").withColumn("parent", parent).join(best, "parent", "left")
    return found.select("path", F.coalesce("own", "inherited", F.lit(0)).alias("bits"))


def with_above(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows once for each folder at or above that of a column, as name."""
    parts = F.split(column, "/")
    own = rows.filter(F.size(parts) >= 2)
    return own.withColumn(name, F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))


def status_in_repositories(paths: DataFrame, repos: DataFrame, listed: DataFrame) -> DataFrame:
    """path, bits: null outside of repositories (path, repo), IGNORED in their .git, else status_of."""
    bits = status_of(paths, listed).join(repos, "path", "left")
    inside = F.expr("substring(path, length(repo) + 2)")
    own = F.when((inside == ".git") | inside.startswith(".git/"), IGNORED).otherwise(F.col("bits"))
    return bits.select("path", F.when(F.col("repo").isNotNull(), own).alias("bits"))


def listed_with(listed: DataFrame, selector: str, entries: DataFrame) -> DataFrame:
    """Entries that a selector of listed states takes, from the listing on: listed files, and all in folders that are listed whole.

    Only for selectors that take nothing of what isn't listed; the listing is small beside the entries, and joined by equality.
    """
    if selector in ("clean", "tracked") or selector.startswith("!"):
        raise ValueError(f"not a listed state: {selector}")
    hits = listed.filter(selected(F.col("bits"), selector))
    files = entries.join(hits.filter("NOT is_dir").select(F.col("listed").alias("path")), "path", "left_semi")
    whole = hits.filter("is_dir").select("listed")
    parent = F.regexp_replace("path", "/[^/]*$", "")
    inside = with_above(entries.select(parent.alias("parent")).distinct(), "parent", "listed").join(whole, "listed", "left_semi").select("parent").distinct()
    # In such a folder, or such a folder itself.
    within = entries.withColumn("_in", parent).join(inside.withColumnRenamed("parent", "_in"), "_in", "left_semi").select(*entries.columns)
    below = within.unionByName(entries.join(whole.select(F.col("listed").alias("path")), "path", "left_semi"))
    # A file that is listed itself has its own state, whatever its folder's.
    own = listed.filter("NOT is_dir").select(F.col("listed").alias("path"))
    return files.unionByName(below.join(own, "path", "left_anti")).dropDuplicates(["path"])


def refreshed(listed: DataFrame, folders: DataFrame, fresh: DataFrame) -> DataFrame:
    """A listing (listed, bits, is_dir) with all at or below some folders (path) read anew; joined by equality with the folders above."""
    parts = F.split("listed", "/")
    above = listed.withColumn("above", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    stale = above.join(folders.select(F.col("path").alias("above")), "above", "left_semi").select("listed").distinct()
    return listed.join(stale, "listed", "left_anti").unionByName(fresh)


def word(bits: Column) -> Column:
    """The status as a word; none if clean."""
    out = None
    for bit, name in ((CONFLICT, "conflict"), (UNTRACKED, "untracked"), (IGNORED, "ignored"), (MODIFIED, "modified"), (ADDED, "added"), (RENAMED, "renamed"), (DELETED, "deleted"), (STAGED, "staged")):
        hit = bits.bitwiseAND(F.lit(bit)) != 0
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def selected(bits: Column, selector: str) -> Column:
    """A selector by any prefix of its name; a null status fails."""
    names = {"modified": bits.bitwiseAND(F.lit(255 - IGNORED)) != 0, "clean": bits == 0, "tracked": bits.bitwiseAND(F.lit(UNTRACKED | IGNORED)) == 0}
    names |= {n: bits.bitwiseAND(F.lit(b)) != 0 for n, b in (("staged", STAGED), ("untracked", UNTRACKED), ("ignored", IGNORED), ("conflict", CONFLICT))}
    known = [n for n in names if n.startswith(selector)]
    if not known:
        raise ValueError(f"unknown status: {selector}")
    return F.coalesce(names[known[0]], F.lit(False))
