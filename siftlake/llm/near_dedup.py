"""Near-duplicate classes by BagMinHash.

A text is the multiset of its shingles of WORDS words. Each shingle runs Poisson processes over dyadic strips of its weight -
(0, 1], (1, 2], (2, 4], ... -, whose points have a time, a component and a level within the strip; a point counts if its level is
within the shingle's multiplicity. A component's signature is the earliest time of all, so that two texts agree in a component
with a probability of their weighted Jaccard similarity. Points are drawn in order of time and stop once they are later than the
text's latest component.

Signatures are cut into bands; texts that share a band are candidates. In each bucket the text that shares most with others is the
leader, and every member is compared with it, by the exact multiset overlap of the texts. Buckets whose members are all in one
class by then are settled. In the others every two members of different classes are compared, in blocks of BLOCK members within
tasks (texts travel, pairs don't) and but for those that the distances to a few pivots keep apart, so that no link is lost and no
group is one task's. Classes are connected components.

Texts with the same words are one node from the start. A miss needs a pair of similarity 0.8 to share none of BANDS bands of
ROWS components: (1 - 0.8 ** 4) ** 24, under 4 in a million; above 0.85 under 1 in a billion.

Defined results: texts without words are one class; a text of fewer than WORDS words is a single shingle; null texts count as empty;
repeated rows are in one class; ids may be null or repeated, a null one being greater than others; ties of ids go to the row of the
smallest number; an empty table gives an empty result; extra columns, of whatever name, are ignored. Hot keys (a bucket, a leader, a
class or a text that a third of all rows share) are counted with partial sums and joined by skew_join, never met in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_keys, map_batches, numbered, skew_join, text_of, written
from .components import connected_components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
SIZE = BANDS * ROWS
BLOCK = 128
BLOCK_CHARS = 16 << 20
#: Members of a group that all others are measured against, so that most pairs needn't be compared.
PIVOTS = 6
#: Pairs of one leader that meet in a task.
PAIRS = 512
M1, M2, GOLD = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(M2)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 500_000:
            self.clear()
        self[word] = got = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingles(words: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text and how often each occurs."""
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(WORDS, len(w))
    if not k:
        return w, np.zeros(0, dtype=np.int64)
    out = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(GOLD) + w[i : i + len(out)])
    return np.unique(out, return_counts=True)


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """Signatures (texts x SIZE) of all texts of a batch: owner tells whose a shingle is; infinite for texts without shingles."""
    most = int(weight.max(initial=1))
    parts = [(owner, shingle, np.zeros(len(owner), dtype=np.int64), weight)]
    for strip in range(1, most.bit_length() + 1):
        if len(at := np.flatnonzero(weight > (1 << (strip - 1)))):
            parts.append((owner[at], shingle[at], np.full(len(at), strip), weight[at]))
    own, element, strip, limit = (np.concatenate(x) for x in zip(*parts, strict=True))
    seed = mix(element + strip.astype(np.uint64) * np.uint64(GOLD))
    floor = np.where(strip > 0, 1 << np.maximum(strip - 1, 0), 0)
    width = np.where(strip > 0, floor, 1)
    partly = limit < floor + width
    time = np.zeros(len(own))
    best = np.full(texts * SIZE, np.inf)
    latest = np.full(texts, np.inf)
    point = 0
    while len(own):
        point += 1
        draw = mix(seed + np.uint64(point * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        live = time < latest[own]
        if not live.all():
            own, seed, time, width, floor, limit, partly, draw = (x[live] for x in (own, seed, time, width, floor, limit, partly, draw))
        second = mix(draw ^ np.uint64(GOLD))
        slot = own * SIZE + (second % np.uint64(SIZE)).astype(np.int64)
        count = np.ones(len(own), dtype=bool)
        if partly.any():
            at = np.flatnonzero(partly)
            level = floor[at] + 1 + (mix(second[at]) % width[at].astype(np.uint64)).astype(np.int64)
            count[at] = level <= limit[at]
        count &= time < best[slot]
        np.minimum.at(best, slot[count], time[count])
        latest = best.reshape(texts, SIZE).max(axis=1)
    return best.reshape(texts, SIZE)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band (texts x BANDS), different from band to band."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(ROWS):
        key = mix(key * np.uint64(GOLD) + bits[:, :, r])
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """docs (id, row, text) -> id, row, digest of the words, keys of the bands."""

    def make() -> Callable[[dict], dict]:
        from xxhash import xxh3_128_digest

        hashes = WordHashes()

        def step(batch: dict) -> dict:
            digests, got = [], []
            for text in batch["text"]:
                words = words_of(text)
                digests.append(xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
                got.append(shingles(words, hashes))
            sizes = [len(g[0]) for g in got]
            owner = np.repeat(np.arange(len(got)), sizes)
            with np.errstate(over="ignore"):
                keys = band_keys(signatures(owner, np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), len(got)))
            return {"id": batch["id"], "row": batch["row"], "digest": digests, "keys": [k if n else [] for k, n in zip(keys, sizes, strict=True)]}

        return step

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs.select("id", "row", "text"), make, f"id {kind}, row long, digest binary, keys array<long>")


def overlap(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    if len(a) > len(b):
        a, b = b, a
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (a.total() + b.total() - both) if a or b else 1.0


def bag(text: str) -> Counter:
    """The multiset of a text's shingles, the words themselves."""
    words = words_of(text)
    k = min(WORDS, len(words))
    return Counter(zip(*(words[i:] for i in range(k)), strict=False)) if k else Counter()


def apart(bags: list[Counter]) -> np.ndarray:
    """For each two bags whether a few pivots tell that they aren't similar, without comparing them.

    1 - overlap is a metric, so bags whose distances to a pivot differ by more than 1 - SIMILARITY are no closer to each other than that. Each pivot
    is the bag farthest from those before it.
    """
    far = np.zeros((len(bags), len(bags)), dtype=bool)
    nearest = np.full(len(bags), np.inf)
    pivot = 0
    for _ in range(PIVOTS if len(bags) > 2 * PIVOTS else 0):
        d = np.array([1 - overlap(bags[pivot], b) for b in bags])
        far |= np.abs(d[:, None] - d[None, :]) > 1 - SIMILARITY + 1e-9
        nearest = np.minimum(nearest, d)
        pivot = int(nearest.argmax())
        if nearest[pivot] <= 0:
            break
    return far


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b, n) whose texts (node, text) have an overlap of SIMILARITY at least.

    n: about how many pairs a has. They are dealt by the salt of b, PAIRS to a task's key at most; a's text goes to each of its salts.
    """

    def make() -> Callable[[dict], dict]:
        last: list = [None, None]

        def step(batch: dict) -> dict:
            out: dict = {"a": [], "b": []}
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True):
                if last[0] != a:
                    last[:] = a, bag(ta)
                if overlap(last[1], bag(tb)) >= SIMILARITY:
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return step

    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PAIRS)).alias("salt")
    pairs = written(pairs.select("a", "b", salt), "pairs")
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    heads = pairs.select("a", "salt").distinct().join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(heads, ["a", "salt"])
    return map_batches(both.select("a", "b", "ta", "tb"), make, "a long, b long")


def verified_in_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between members (key, node, component) of a bucket that are in different components.

    Every bucket is dealt into blocks; each two blocks meet in a group, and within a group only enough links to join what belongs
    together are returned.
    """
    long = members.join(texts.select("node", F.length("text").alias("chars")), "node")
    sizes = written(long.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")), "sizes")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    placed = skew_join(members, sizes, "key", hot_keys(sizes, "key", "n", members.count())).select("key", "node", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    met = placed.select("key", "node", "component", "block", F.inline(each)).join(texts, "node")
    # By number: what a task does grows with the square of its rows, so partitions aren't merged by their bytes.
    dealt = met.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    schema = T.StructType.fromDDL("a long, b long")

    def compare(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        bags = {r[0]: bag(r[3]) for r in rows}
        sizes = {k: b.total() for k, b in bags.items()}
        far = apart(list(bags.values()))
        place = {k: i for i, k in enumerate(bags)}
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        for n, (a, ca, block, *_) in enumerate(rows):
            for b, cb, other, *_ in rows[:n]:
                # Within a block a pair meets in the group of that block alone, or with each other block: once is enough.
                if (block != other or rows[0][4] == rows[0][5]) and not far[place[a], place[b]] and root(ca) != root(cb) and min(sizes[a], sizes[b]) >= SIMILARITY * max(sizes[a], sizes[b]) and overlap(bags[a], bags[b]) >= SIMILARITY:
                    parent[root(ca)] = root(cb)
                    yield a, b

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for key, i, j, node, component, block, text in zip(*(batch[c].to_pylist() for c in ("key", "i", "j", "node", "component", "block", "text")), strict=True):
                if (key, i, j) != now:
                    found += compare(rows)
                    now, rows = (key, i, j), []
                rows.append((node, component, block, text, i, j))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        found = list(compare(rows))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.select("key", "i", "j", "node", "component", "block", "text").mapInArrow(scan, schema)


def compared_groups(unsettled: DataFrame, hot: list[int]) -> DataFrame:
    """unsettled (key, node, component) with buckets that overlap merged where that makes fewer comparisons.

    Near copies of one text share buckets in most bands, and each bucket holds most of them: one group of all of them is then
    compared once instead of once a bucket. Where buckets only hang together by a few members each stays by itself. hot: see hot_keys.
    """
    cost = lambda n: n * F.ceil(n / BLOCK)
    heads = unsettled.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n"))
    star = skew_join(unsettled, heads, "key", hot).filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    groups = written(connected_components(star), "groups")
    apart = heads.join(groups.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.sum(cost(F.col("n"))).alias("apart"))
    merged = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(apart, "component").filter(cost(F.col("n")) <= F.col("apart"))
    chosen = groups.join(merged, "component", "left").select("node", F.when(F.col("n").isNotNull(), F.col("component")).alias("group"))
    keyed = unsettled.join(chosen, "node")
    return keyed.select(F.coalesce("group", "key").alias("key"), "node", "component").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """A row for each row of docs: id, row, class_id (the least id of the class), class_size, n_links, kept.

    n_links: verified links of the row's text to other texts that the classes were joined by. kept: one row of each class, that
    of the least id. row: the number of the row, which row_col holds if docs is a written table that has one already.
    """
    docs = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), *([F.col(row_col).alias("row")] if row_col else []))
    docs = docs if row_col else numbered(docs)
    rows = written(sketches(docs), "sketches")
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    nodes = written(rows.groupBy("digest").agg(F.min("row").alias("node"), F.min_by("keys", "row").alias("keys"), F.min(first).alias("first"), F.count(F.lit(1)).alias("copies")), "nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    hot = hot_keys(shared, "key", "n", nodes.agg(F.sum(F.size("keys"))).first()[0] or 0)
    members = written(skew_join(keyed, shared, "key", hot), "members")
    rank = members.groupBy("node").agg(F.sum("n").alias("rank"))
    best = F.max(F.struct("rank", F.negative("node").alias("node"))).alias("top")
    leaders = written(members.join(rank, "node").groupBy("key", "n").agg(best).select("key", "n", F.negative("top.node").alias("a")), "leaders")
    pairs = skew_join(members.select("key", "node"), leaders, "key", hot).filter("a <> node").groupBy("a", F.col("node").alias("b")).agg(F.max("n").alias("n"))
    texts = docs.select("row", "text").join(members.select(F.col("node").alias("row")).distinct(), "row", "left_semi").select(F.col("row").alias("node"), "text")
    texts = written(texts, "texts")
    links = written(verified(pairs, texts), "verified")
    parts = connected_components(links)
    placed = members.select("key", "node").join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    # Buckets with the same members count once.
    stats = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor"))
    open_keys = written(stats.filter("least <> most").groupBy("n", "sum", "xor").agg(F.min("key").alias("key")).select("key"), "open")
    if open_keys.head(1):
        unsettled = written(skew_join(placed, open_keys, "key", hot, "left_semi"), "unsettled")
        links = links.unionByName(written(verified_in_blocks(written(compared_groups(unsettled, hot), "groups"), texts), "verified"))
        parts = connected_components(links)
    degrees = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.select("node", "digest", "first", "copies").join(parts, "node", "left").join(degrees, "node", "left")
    named = named.select("digest", "first", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "node").alias("class"))
    # Written, so that a large class is no partition of the join's: its rows are then split by the adaptive plan.
    classes = written(named.groupBy("class").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts")), "classes")
    whole = skew_join(named.select("digest", "n_links", "class"), classes.drop("texts"), "class", hot_keys(classes, "class", "texts", nodes.count()))
    out = skew_join(rows.select("id", "row", "digest"), whole, "digest", hot_keys(nodes, "digest", "copies", rows.count()))
    return out.select(F.col("id").alias(id_col), "row", F.col("head.id").alias("class_id"), "class_size", "n_links", (F.col("row") == F.col("head.row")).alias("kept"))
