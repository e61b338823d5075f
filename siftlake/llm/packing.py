"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition packs its pieces best-fit, largest first, and emits the bins that are full enough; underfull bins go on as items
to fewer partitions, which pack them again, until one round's worth is left. A bin carries its pieces (at most ``capacity`` of
them, as a piece has a token at least), so what a level hands on is bounded by the waste of the level before, never by the input.

Two bins can only become one if one of them is at most half full, and best fit leaves no more than one such bin a task. So once a
round saves fewer bins than it has tasks, only those go on, and all others are final: no later round could save more than one
sequence for each GROUP_ITEMS items of this one.

Defined results: a null text is an empty one, a single end token; repeated rows are packed each, and ids may be null; an empty
table gives an empty result; a document of over ``capacity`` tokens is cut into pieces of which only the first may be shorter;
extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_batches, text_of, written
from .tokens import END, encoder

CAPACITY = 1024
#: A bin with at most this many tokens free is emitted at once.
SLACK = 8
#: Items that a task packs in a round of merging; and how many bins go to the last, single task at most.
GROUP_ITEMS = 20_000
PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def cut_points(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    first = length % capacity or min(length, capacity)
    out = [(0, first)]
    while out[-1][0] + out[-1][1] < length:
        out.append((sum(out[-1]), capacity))
    return out


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: items, largest first, each into the fullest bin that it fits."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free tokens
    free = 0  # bit f is set if a bin has f tokens free
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        if fit := free >> size:
            left = size + (fit & -fit).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                free &= ~(1 << left)
            bins[at].append(int(i))
        else:
            left, at = capacity, len(bins)
            bins.append([int(i)])
        left -= size
        if left:
            room[left].append(at)
            free |= 1 << left
    return bins


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document."""

    def make() -> Callable[[dict], dict]:
        encode = encoder()

        def step(batch: dict) -> dict:
            out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                ids = np.asarray([*encode(text), END], dtype="<u4")
                for k, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    for name, value in zip(out, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        out[name].append(value)
            return out

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), make, PIECE.format(id=kind))


def packed_bins(items: DataFrame, capacity: int, last: bool) -> DataFrame:
    """items (size, parts) packed within each partition -> bins (size, parts, done)."""
    schema = f"size int, parts {items.schema['parts'].dataType.simpleString()}, done boolean"

    def scan(batches: Iterator) -> Iterator:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        sizes = whole["size"].to_numpy()
        bins = best_fit(sizes, capacity)
        order = np.fromiter((i for b in bins for i in b), dtype=np.int64)
        counts = np.fromiter(map(len, bins), dtype=np.int64)
        parts = whole["parts"].combine_chunks()
        if isinstance(parts, pa.ChunkedArray):
            parts = pa.concat_arrays(parts.chunks)
        taken = parts.take(pa.array(order))
        lengths = np.asarray(taken.value_lengths(), dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
        filled = np.add.reduceat(sizes[order], np.concatenate([[0], np.cumsum(counts)[:-1]]))
        out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), taken.flatten())
        done = np.full(len(bins), True) if last else filled >= capacity - SLACK
        table = pa.table({"size": pa.array(filled, pa.int32()), "parts": out.cast(whole.schema.field("parts").type), "done": done})
        yield from table.to_batches(max_chunksize=10_000)

    return items.mapInArrow(scan, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with length) and sequence_id, offset: bins of at most capacity tokens, gapless from 0."""
    part = F.struct(*pieces.columns)
    pieces = written(pieces, "pieces")
    full = pieces.filter(F.col("length") >= capacity).select(F.col("length").cast("int").alias("size"), F.array(part).alias("parts"))
    items = pieces.filter(F.col("length") < capacity).select(F.col("length").cast("int").alias("size"), F.array(part).alias("parts"))
    finished = [full]
    n = items.count()
    while True:
        groups = max(1, -(-n // GROUP_ITEMS))
        # Dealt round-robin over size classes, so that every group gets the whole spread of sizes.
        dealt = items.repartition(groups) if groups > 1 else items.coalesce(1)
        bins = written(packed_bins(dealt, capacity, last=groups == 1), "bins")
        finished.append(bins.filter("done").select("size", "parts"))
        left = bins.filter("NOT done").select("size", "parts")
        if groups == 1 or not (m := left.count()):
            break
        if n - m < groups:
            finished.append(left.filter(2 * F.col("size") > capacity))
            left = left.filter(2 * F.col("size") <= capacity)
            m = left.count()
        items, n = left, m
        if not m:
            break
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return flattened(out.withColumn("sequence_id", F.monotonically_increasing_id()))


def flattened(bins: DataFrame) -> DataFrame:
    """bins (sequence_id, parts) -> a row for each piece, with its offset: the sum of the lengths before it in its bin."""
    piece = bins.schema["parts"].dataType.elementType
    schema = T.StructType([*piece.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch["parts"]
            counts = np.asarray(parts.value_lengths(), dtype=np.int64)
            flat = parts.flatten()
            columns = dict(zip([f.name for f in piece], flat.flatten(), strict=True))
            before = np.cumsum(columns["length"].to_numpy()) - columns["length"].to_numpy()
            starts = np.repeat(before[np.minimum(np.cumsum(counts) - counts, len(before) - 1)], counts)
            columns |= {"sequence_id": pa.array(np.repeat(batch["sequence_id"].to_numpy(), counts)), "offset": pa.array(before - starts)}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)

    return bins.select("sequence_id", "parts").mapInArrow(scan, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each document."""
    return pack(pieces_of(docs, id_col, text_col, capacity), capacity)
