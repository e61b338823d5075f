"""Changes below folders that churn, put off by unit: keyed state with a timer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .feed import OLDEST, QUIET

# Folders whose changes wait, below which each child is a unit; and names of folders that are one wherever they are.
PREFIXES = (
    "~/.cache ~/Library/Caches ~/Library/Logs ~/.Trash ~/.npm ~/.cargo/registry ~/.gradle/caches ~/Library/Developer/Xcode/DerivedData "
    "~/Library/Developer/CoreSimulator /private/var /private/tmp /Library/Caches"
).split()
NAMES = ("node_modules", "__pycache__")
CACHE_TAG = "CACHEDIR.TAG"
#: A unit with more folders than this is listed whole.
COLLAPSE = 2048
#: A unit of content is flushed after other times: quiet and oldest in seconds.
CONTENT_QUIET, CONTENT_OLDEST = 2, 300
#: A folder may be listed for a fiftieth of the time, AHEAD seconds ahead of that.
SHARE, AHEAD = 50, 2.5


def unit_of(path: Column, home: str, tagged: list[str] = []) -> Column:  # noqa: B006
    """The unit that a folder's changes wait in: a child of a lazy prefix, else its topmost folder of a lazy name or with a tag; null if none."""
    out = None
    for p in (x.replace("~", home, 1) if x[0] == "~" else x for x in PREFIXES):
        hit = (path == p) | path.startswith(p + "/")
        child = F.concat(F.lit(p), F.regexp_extract(F.substring(path, len(p) + 1, 1 << 30), "^(/[^/]*)?", 0))
        out = F.when(hit, child) if out is None else out.when(hit, child)
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.element_at(parts, i).alias("name"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder")))
    lazy = F.filter(folders, lambda x: x["name"].isin(*NAMES) | (x["folder"].isin(tagged) if tagged else F.lit(False)))
    return out.otherwise(F.try_element_at(lazy, F.lit(1))["folder"])


def tagged_folders(entries: DataFrame) -> DataFrame:
    """path of the folders that hold a regular file that tags them as a cache."""
    return entries.filter((F.col("kind") == 0) & (F.col("name") == CACHE_TAG)).select(F.col("parent").alias("path")).distinct()


STATE = "first double, last double, least long, whole boolean, dirs array<string>, deep array<boolean>"
FLUSHED = "unit string, dir string, recursive boolean, least long"


def waiting_units(events: DataFrame, quiet: float = QUIET, oldest: float = OLDEST, collapse: int = COLLAPSE) -> DataFrame:
    """unit, dir, recursive, least of a stream of events (unit, dir, recursive, id): a unit's folders once it was quiet for a while, or too old.

    A timer of processing time for each unit; least is the least id of the flushed events, below which the watermark was held. A unit of
    more than collapse folders gives itself, to be listed whole.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() / 1000
        first, last, least, whole, dirs, deep = state.get if state.exists else (now, now, None, False, [], [])
        held = dict(zip(dirs, deep, strict=True))
        for b in batches:
            last = now
            for d, r, i in zip(b["dir"], b["recursive"], b["id"], strict=True):
                least = int(i) if least is None else min(least, int(i))
                if not whole:
                    held[d] = held.get(d, False) or bool(r)
                    if len(held) > collapse:
                        whole, held = True, {}
        due = min(last + quiet, first + oldest)
        if state.hasTimedOut or now >= due:
            state.remove()
            rows = [(key[0], key[0], True, least)] if whole else [(key[0], d, r, least) for d, r in sorted(held.items())]
            yield pd.DataFrame(rows, columns=["unit", "dir", "recursive", "least"])
            return
        state.update((first, last, least, whole, list(held), list(held.values())))
        state.setTimeoutDuration(max(1, int((due - now) * 1000)))

    return events.groupBy("unit").applyInPandasWithState(step, FLUSHED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def folders_due(events: DataFrame, now: int, quiet: int = QUIET, oldest: int = OLDEST, collapse: int = COLLAPSE) -> DataFrame:
    """unit, dir, recursive, least as of a time, of events (unit, dir, recursive, id, ts) that have not been flushed: the same rule over a table."""
    by_dir = events.groupBy("unit", "dir").agg(F.bool_or("recursive").alias("recursive"), F.min("id").alias("least"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    units = by_dir.groupBy("unit").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("least").alias("least"), F.count(F.lit(1)).alias("dirs"))
    due = units.filter((now - F.col("last") >= quiet) | (now - F.col("first") >= oldest))
    whole = due.filter(F.col("dirs") > collapse).select("unit", F.col("unit").alias("dir"), F.lit(True).alias("recursive"), "least")
    each = by_dir.drop("least").join(due.filter(F.col("dirs") <= collapse).select("unit", "least"), "unit").select("unit", "dir", "recursive", "least")
    return each.unionByName(whole)


def paced(events: DataFrame, listed: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Events (dir, recursive, id) that may be listed now, and those that wait, by when their folders' listings (dir, at, took) are paid for.

    Each listing is paid SHARE times its length from when it was made or the one before was paid; a restoration (id 0) never waits.
    """
    order = F.array_sort(F.collect_list(F.struct("at", "took")))
    step = f"(paid, x) -> least(greatest(paid, x.at) + x.took * {SHARE}D, x.at + {AHEAD + 1}D)"
    paid = listed.groupBy("dir").agg(order.alias("times")).select("dir", F.expr(f"aggregate(times, 0D, {step})").alias("paid"))
    known = events.join(paid, "dir", "left")
    free = F.coalesce(F.col("paid") <= now + AHEAD, F.lit(True)) | (F.col("id") == 0)
    return known.filter(free).drop("paid"), known.filter(~free).drop("paid")


def floor_of(*waiting: DataFrame) -> int | None:
    """The least id of all that waits: the watermark stays below."""
    ids = [d.select(F.min("id").alias("id")) for d in waiting]
    return reduce(DataFrame.unionByName, ids).agg(F.min("id")).first()[0] if ids else None
