"""The live view: an immutable base, tombstones and a delta; folder diffs; compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PENDING, LEAST_PENDING, MOST_SOFT, QUIET, STALE = 350_000, 50_000, 175_000, 30, 12 * 3600
MOST_MERGED = 96 << 20


def live_view(base: DataFrame, dead: DataFrame, delta: DataFrame) -> DataFrame:
    """Base entries that are neither dead nor replaced, and the delta's."""
    gone = dead.select("path").union(delta.select("path")).distinct()
    return base.join(gone, "path", "left_anti").unionByName(delta)


def with_subtrees(gone: DataFrame, entries: DataFrame) -> DataFrame:
    """path of the gone paths and of all entries below them; the folders above each distinct folder are exploded and joined by equality."""
    held = entries.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("parent"))
    folders = held.select("parent").distinct()
    parts = F.split("parent", "/")
    above = folders.select("parent", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("above"))
    lost = above.join(gone.select(F.col("path").alias("above")), "above", "left_semi").select("parent").distinct()
    return held.join(lost, "parent", "left_semi").select("path").union(gone.select("path")).distinct()


def changed_since(entries: DataFrame, since: int, synced: int | None = None) -> DataFrame:
    """path of the folders to list again after events were lost: those whose own time is since or later, and, where a sync is known
    to have been at a time, those that hold a file changed from then on."""
    folders = entries.filter((F.col("kind") == 1) & (F.col("mtime") >= since)).select("path")
    if synced is None:
        return folders
    return folders.union(entries.filter((F.col("kind") == 0) & (F.col("mtime") >= synced)).select(F.col("parent").alias("path"))).distinct()


def changed_documents(held: DataFrame, entries: DataFrame, since: int) -> DataFrame:
    """path of the folders with a held document (path, size, mtime) whose file has another size, or a time since or later, or is gone."""
    now = entries.filter("kind = 0").select("path", F.col("size").alias("n_size"), F.col("mtime").alias("n_mtime"))
    both = held.select("path", "size", "mtime").join(now, "path", "left")
    other = F.col("n_size").isNull() | (F.col("size") != F.col("n_size")) | (F.col("n_mtime") >= since)
    return both.filter(other).select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()


def relist_in(last: float | None, now: float, cooldown: int = 300) -> float:
    """Seconds until folders may be listed by time again."""
    return 0.0 if last is None else max(0.0, last + cooldown - now)


def lost(failures: int, dropped_by_system: bool) -> str:
    """What lost events call for: replay from the last good one, or a listing by time after three failures or a drop by the system."""
    return "relist" if dropped_by_system or failures >= 3 else "replay"


def folder_diff(current: DataFrame, listing: DataFrame) -> DataFrame:
    """path, op: what makes current (path, kind, size, mtime) the listing; applied twice it is as if once."""
    old = current.select("path", *[F.col(c).alias(f"o_{c}") for c in ("kind", "size", "mtime")])
    both = old.join(listing, "path", "full_outer")
    op = F.when(F.col("o_kind").isNull(), "new").when(F.col("kind").isNull(), "removed").when(F.col("kind") != F.col("o_kind"), "kind").when((F.col("size") != F.col("o_size")) | (F.col("mtime") != F.col("o_mtime")), "changed")
    return both.select("path", op.alias("op")).filter("op IS NOT NULL")


def coalesced(events: DataFrame) -> DataFrame:
    """One row for each folder of a batch: whether any event was recursive, and the least id."""
    return events.groupBy("dir").agg(F.bool_or("recursive").alias("recursive"), F.min("id").alias("id"))


def advance(current: int, seen: int, floor: int | None, gap: int | None) -> int:
    """The watermark after a batch: held below the floor of what is put off; it goes back only to the start of a gap."""
    if gap is not None:
        return min(current, gap)
    return max(current, min(seen, floor - 1) if floor is not None else seen) if floor != 0 else current


def should_compact(pending: int, base: int, quiet: float, stale: float, asked: bool = False) -> bool:
    """Whether to rewrite the snapshot."""
    soft = max(LEAST_PENDING, min(base // 8, MOST_SOFT))
    return asked or pending > MOST_PENDING or quiet >= QUIET and (pending > soft or stale >= STALE and pending > 0)


def merge_plan(segments: list[tuple[int, int, int]]) -> list[int]:
    """Which segments (id, bytes, dead bytes) to rewrite as one: the one with the largest dead share once a sixteenth of all is dead,
    else eight of one size tier (powers of four) of up to MOST_MERGED bytes, smallest tier first; none if all is well."""
    if sum(d for *_, d in segments) * 16 > sum(b for _, b, _ in segments):
        return [max(segments, key=lambda s: s[2] / max(s[1], 1))[0]]
    tiers: dict[int, list[tuple[int, int, int]]] = {}
    for s in segments:
        tiers.setdefault((max(s[1], 1).bit_length() - 1) // 2, []).append(s)
    for _, group in sorted(tiers.items()):
        if len(group) >= 8 and sum(b for _, b, _ in group[:8]) <= MOST_MERGED:
            return [i for i, *_ in group[:8]]
    return []


def sync_diff(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """path, op of docs (path, size, mtime): keep, reindex (new or changed) or drop."""
    have = held.select("path", F.col("size").alias("h_size"), F.col("mtime").alias("h_mtime"), F.lit(True).alias("held"))
    both = wanted.select("path", "size", "mtime", F.lit(True).alias("wanted")).join(have, "path", "full_outer")
    same = F.col("held") & F.col("size").eqNullSafe(F.col("h_size")) & F.col("mtime").eqNullSafe(F.col("h_mtime"))
    return both.select("path", F.when(F.col("wanted").isNull(), "drop").when(F.coalesce(same, F.lit(False)), "keep").otherwise("reindex").alias("op"))


def replay_delay(failures: int) -> int:
    """Seconds before lost events are asked for again."""
    return min(60, 2 << min(failures, 10))
