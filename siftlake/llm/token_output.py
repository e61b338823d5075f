"""Training-order materialisation of token ids as fixed-stride binary shards.

Documents become sequences of ``stride`` ids (the last of a document padded), numbered 0..n-1 in the order of the table: a first
scan counts the sequences of each partition (a text of fewer bytes than the stride is a single one and isn't encoded), and a
partition's numbers start at the sum of the counts before it. A keyed Feistel permutation of 0..n-1 with cycle-walking gives each
number its global slot, a bijection. Slot s is record s mod SHARD_ROWS of shard s div SHARD_ROWS and starts at byte (s mod
SHARD_ROWS) * stride * 2 of its file, so a reader seeks to any slot by arithmetic, reads on in training order, and resumes from a
slot number. Ranges of shards are the partitions that write them.

Both scans must deal documents alike. The number of splits is held between them, and the second scan compares what each partition
holds with what the first one saw; if that ever differs the table is written once and both scans read that, so numbers are never
wrong.

Defined results: a null text is an empty one (a single end token); repeated rows get sequences each; ids are only carried, and may
be null; an empty table gives no shards; extra columns, of whatever name, are ignored; a document may have any number of sequences.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_64_intdigest

from .common import shared_dir, text_of, written
from .tokens import END, encoder

STRIDE = 1024
PAD = b"\0"
#: Sequences in a shard, and bytes that a task writes at least, if there are so many.
SHARD_ROWS = 16_384
TASK_BYTES = 256 << 20
KEY = 0x5EED
ROUNDS = 4
CHANGED = "the table was dealt otherwise between two scans"


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of x and a round key."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def feistel(x: np.ndarray, half: int, key: int) -> np.ndarray:
    """A balanced Feistel network over 2 * half bits."""
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for r in range(ROUNDS):
        left, right = right, left ^ (mixed(right, key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & mask)
    return (left << np.uint64(half)) | right


def permuted(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The permutation of 0..n-1: a value outside is walked along its cycle until it falls inside."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    x = numbers.astype(np.uint64)
    out = feistel(x, half, key)
    while len(outside := np.flatnonzero(out >= np.uint64(n))):
        out[outside] = feistel(out[outside], half, key)
    return out.astype(np.int64)


def carried(old: int, doc: int | None, text: str) -> int:
    """A running hash of what a partition holds."""
    return xxh3_64_intdigest(f"{old} {doc} {len(text)} {text[:64]}".encode("utf-8", "surrogatepass"))


def counts(docs: DataFrame, stride: int) -> dict[int, tuple[int, int, int]]:
    """For each partition of docs (doc_id, text): its first number, how many sequences it has, and a hash of what it holds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n, seen = encoder(), 0, 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                seen = carried(seen, doc, text)
                # A token is a byte at least, and the end token comes on top.
                short = len(text) < stride and len(text.encode()) < stride
                n += 1 if short else len(encode(text)) // stride + 1
        if n:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int32()), (n, pa.int64()), (seen - (1 << 63), pa.int64()))], names=["part", "n", "seen"])

    out, base = {}, 0
    # A row for each partition of the scan, however many documents there are.
    for part, n, seen in sorted(map(tuple, docs.mapInArrow(scan, "part int, n long, seen long").collect())):
        out[part] = (base, n, seen)
        base += n
    return out


def sequences(docs: DataFrame, stride: int, parts: dict[int, tuple[int, int, int]], shard_rows: int, key: int) -> DataFrame:
    """doc_id, piece, n_ids, slot, shard, ids (a zstandard frame of little-endian 16-bit ids): a row for each sequence."""
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    total = sum(n for _, n, _ in parts.values())
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"doc_id {kind}, piece int, n_ids int, slot long, shard int, ids binary")
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        # Entropy coding, which the shuffle's own codec lacks; padding is added where shards are written.
        encode, squeeze = encoder(), zstandard.ZstdCompressor(level=2).compress
        base, expected, hashed = shared.value.get(TaskContext.get().partitionId(), (0, 0, -(1 << 63)))
        n, seen = 0, 0
        for batch in batches:
            out: dict = {k: [] for k in ("doc_id", "piece", "n_ids", "ids")}
            first = n
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                seen = carried(seen, doc, text)
                tokens = encode(text)
                tokens.append(END)
                ids = np.fromiter(tokens, "<u2", len(tokens))
                for k in range(0, len(ids), stride):
                    piece = ids[k : k + stride]
                    for name, value in zip(out, (doc, k // stride, len(piece), squeeze(piece.tobytes())), strict=True):
                        out[name].append(value)
                    n += 1
            if n > expected:
                raise RuntimeError(CHANGED)
            if n > first:
                slot = permuted(np.arange(base + first, base + n, dtype=np.uint64), total, key)
                out |= {"slot": slot, "shard": (slot // shard_rows).astype(np.int32)}
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        if n != expected or seen - (1 << 63) != hashed:
            raise RuntimeError(CHANGED)

    return docs.mapInArrow(scan, schema)


def write_shards(seqs: DataFrame, folder: str, stride: int, shard_rows: int) -> DataFrame:
    """Write every shard that a partition holds, in order of slot, sequences padded to stride; seqs is dealt by shard and sorted by slot.

    A shard is written under a name of the task attempt and then renamed, so that a task that runs again replaces it whole.
    """
    kind = seqs.schema["doc_id"].dataType.simpleString()
    result = T.StructType.fromDDL(f"doc_id {kind}, piece int, n_ids int, slot long, shard int, byte_offset long, ids_crc32 long")
    schema = to_arrow_schema(result)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        store, root = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        now, out = -1, None

        def close() -> None:
            if out is None:
                return
            out.close()
            target = f"{root}/{shard_name(now)}"
            if store.get_file_info(target).type != fs.FileType.NotFound:
                store.delete_file(target)  # of an earlier attempt: some stores don't rename over a file
            store.move(f"{root}/.{now}-{attempt}", target)

        for batch in batches:
            crcs = []
            for shard, frame in zip(batch["shard"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if shard != now:
                    close()
                    now = shard
                    out = store.open_output_stream(f"{root}/.{now}-{attempt}")
                raw = expand(frame)
                out.write(raw.ljust(stride * 2, PAD))
                crcs.append(zlib.crc32(np.frombuffer(raw, "<u2").astype("<u4")))
            slots = batch["slot"].to_numpy()
            at = pa.array(slots % shard_rows * stride * 2)
            yield pa.RecordBatch.from_arrays([batch[c] for c in ("doc_id", "piece", "n_ids", "slot", "shard")] + [at, pa.array(crcs, pa.int64())], schema=schema)
        close()

    return seqs.select("doc_id", "piece", "n_ids", "slot", "shard", "ids").mapInArrow(scan, result)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def materialise(docs: DataFrame, folder: str | None = None, stride: int = STRIDE, shard_rows: int = SHARD_ROWS, key: int = KEY) -> DataFrame:
    """Write the shards to folder (in the shared folder if not given); a row for each sequence of docs.

    Returned: doc_id, piece, n_ids, slot, shard, byte_offset, ids_crc32, shard_file. ids_crc32 is that of the sequence's ids
    without padding, as little-endian unsigned 32-bit numbers.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    rows = docs.select("doc_id", text_of().alias("text"))
    # What a scan is split into follows from the cores at hand, unless it is told.
    splits = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(splits, None)
    spark.conf.set(splits, before or str(spark.sparkContext.defaultParallelism))
    try:
        try:
            index = placed(rows, folder, stride, shard_rows, key)
        except Exception as e:
            if CHANGED not in str(e):
                raise
            index = placed(written(rows, "rows"), folder, stride, shard_rows, key)
    finally:
        if before is None:
            spark.conf.unset(splits)
    for left in store.get_file_info(fs.FileSelector(root)):
        if left.base_name.startswith("."):
            store.delete_file(left.path)  # of attempts that never ended
    name = F.concat(F.lit("shard-"), F.lpad(F.col("shard").cast("string"), 8, "0"), F.lit(".bin"))
    return index.select("doc_id", "piece", "n_ids", "slot", "shard", "byte_offset", "ids_crc32", name.alias("shard_file"))


def placed(rows: DataFrame, folder: str, stride: int, shard_rows: int, key: int) -> DataFrame:
    """The index of rows' sequences, whose shards have been written."""
    parts = counts(rows, stride)
    total = sum(n for _, n, _ in parts.values())
    shards = -(-total // shard_rows)
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(shards, max(least, total * stride * 2 // TASK_BYTES)))
    seqs = sequences(rows, stride, parts, shard_rows, key).withColumn("task", F.floor(F.col("shard") * tasks / F.lit(max(1, shards))).cast("int"))
    dealt = seqs.repartitionById(tasks, "task") if hasattr(seqs, "repartitionById") else seqs.repartition(tasks, "task")
    return written(write_shards(dealt.sortWithinPartitions("slot"), folder, stride, shard_rows), "shard-index")


def read_from(folder: str, slot: int, n: int, stride: int = STRIDE, shard_rows: int = SHARD_ROWS) -> Iterator[np.ndarray]:
    """Up to n sequences from a slot on, in training order. Seeks once in a shard, then reads on."""
    store, root = fs.FileSystem.from_uri(folder)
    while n > 0:
        shard, record = divmod(slot, shard_rows)
        if store.get_file_info(f"{root}/{shard_name(shard)}").type == fs.FileType.NotFound:
            return
        with store.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(record * stride * 2)
            for _ in range(min(n, shard_rows - record)):
                got = f.read(stride * 2)
                if not got:
                    return
                yield np.frombuffer(got, "<u2")
                slot, n = slot + 1, n - 1
