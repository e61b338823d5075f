"""SentencePiece encoding and decoding, giant documents by a parallel max-plus scan.

The public vocabulary is a BPE one. Its encoding of a text is the one path through the lattice of pieces in which each two
neighbours are compatible, i.e. encode to themselves when joined; with a weight of 0 for compatible neighbours and minus
infinity for others that is a max-plus shortest path, and a boundary's state is the piece that ends at it or spans it. A giant
document is split into chunks; each gives its transfer matrix from the states of its left boundary to those of its right one
(the finite entries). Max-plus products combine FAN neighbouring matrices into one, level by level up a tree, until one matrix
is left for a document; on the way down each node knows the states at its two ends and traces those between its children, so no
task ever holds more than FAN matrices of a document. Each chunk is then traced back by itself. No piece has a word mark but at
its start, so between two words every state is the same: all but the ends of a chunk is encoded by the library.

Defined results: a null text counts as empty and has no ids; repeated rows get a row each; ids may be null; an empty table gives
an empty result; extra columns, of whatever name, are ignored; texts end in the same ids wherever chunks are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import cache, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of, written

CHUNK = 16_384
#: Characters of a chunk's neighbours that it sees: the longest piece.
REACH = 16
#: Matrices that a product combines at once.
FAN = 16
MARK = "▁"
Token = tuple[int, int]
START: Token = (0, 0)
#: The finite entries of a transfer matrix: weights by state at the left and state at the right boundary.
Matrix = dict[tuple[Token, Token], int]


class Pieces:
    """The vocabulary: ids, BPE of short strings, and which neighbours are compatible."""

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers as public
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public.path("piece_bpe_32k.model"))
        m = self.model
        self.ids = {m.id_to_piece(i): i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.scores = {p: m.get_score(i) for p, i in self.ids.items()}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        assert self.longest <= REACH
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE of a short string: the pair of the best score merges first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            pairs = [(self.scores.get(a + b), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            known = [p for p in pairs if p[0] is not None]
            if not known:
                break
            i = -max(known)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def is_token(self, text: str) -> bool:
        """A piece that encodes to itself, or any single character."""
        if len(text) == 1:
            return True
        if text not in self.ids:
            return False
        if (got := self.whole.get(text)) is None:
            got = self.whole[text] = self.merged(text) == [text]
        return got

    def compatible(self, a: str, b: str) -> bool:
        if (got := self.fits.get((a, b))) is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            got = self.fits[a, b] = self.merged(a + b) == [a, b]
        return got

    def ids_of(self, token: str) -> list[int]:
        known = self.ids.get(token)
        return [known] if known is not None else [self.bytes[b] for b in token.encode()]

    def words(self, text: str) -> list[int]:
        """Ids of marked text that starts with a word mark, by the library."""
        return self.model.encode(text[1:]) if len(text) > 1 else self.ids_of(text)


@cache
def pieces(path: str | None = None) -> Pieces:
    return Pieces(path)


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def spanning(p: Pieces, t: str, at: int) -> list[Token]:
    """Tokens that start before a place and end at it or beyond."""
    return [(s, e) for s in range(max(0, at - REACH), at) for e in range(at, min(len(t), s + REACH) + 1) if p.is_token(t[s:e])]


def paths(p: Pieces, t: str, begin: dict[Token, int], stop: int) -> tuple[dict[Token, int], dict[Token, list[Token]]]:
    """From tokens (with a mask of where they come from) over compatible ones to those that span or end at stop.

    Returned: these with the masks that reach them, and each token's predecessors.
    """
    ends: dict[int, dict[Token, int]] = {}
    for token, mask in begin.items():
        ends.setdefault(token[1], {})[token] = mask
    back: dict[Token, list[Token]] = {}
    for at in range(min(ends, default=stop), stop):
        before = ends.get(at)
        if not before:
            continue
        for e in range(at + 1, min(len(t), at + REACH) + 1):
            text = t[at:e]
            if not p.is_token(text):
                continue
            mask = 0
            for x, m in before.items():
                if x[0] == x[1] or p.compatible(t[x[0] : x[1]], text):
                    mask |= m
                    back.setdefault((at, e), []).append(x)
            if mask:
                ends.setdefault(e, {})[at, e] = mask
    return {x: m for e, xs in ends.items() if e >= stop for x, m in xs.items()}, back


def reachable(p: Pieces, t: str, at: int) -> list[Token]:
    """The states of a boundary: if a word starts within a piece's reach before it, those that lead there from its start."""
    near = words_between(t, at - REACH, at - 1)
    return list(paths(p, t, {(near[1], near[1]): 1}, at)[0]) if near else spanning(p, t, at)


def words_between(t: str, left: int, right: int) -> tuple[int, int] | None:
    """The first and last place of left..right at which a word starts after something that isn't a mark."""
    starts = lambda i: t[i] == MARK and i > 0 and t[i - 1] != MARK
    first = next((i for i in range(max(left, 1), right + 1) if i < len(t) and starts(i)), None)
    if first is None:
        return None
    return first, next(i for i in range(min(right, len(t) - 1), first - 1, -1) if starts(i))


def chunk_entries(p: Pieces, t: str, left: int, right: int, first: bool, last: bool) -> list[tuple[Token, Token]]:
    """The finite entries of a chunk's transfer matrix: pairs of states, as places from its left and right boundary."""
    begin = [(left, left)] if first else reachable(p, t, left)
    at = words_between(t, left, right - 1)
    masks = {x: 1 << i for i, x in enumerate(begin)}
    if at is None:
        got, _ = paths(p, t, masks, right)
        found = [(x, y) for y, m in got.items() if not last or y[1] == right for i, x in enumerate(begin) if m >> i & 1]
    else:
        inner, outer = at
        got, _ = paths(p, t, {x: m for x, m in masks.items() if x[1] <= inner}, inner)
        mask = 0
        for y, m in got.items():
            mask |= m if y[1] == inner else 0
        ahead, _ = paths(p, t, {(outer, outer): 1}, right)
        found = [(x, y) for i, x in enumerate(begin) if mask >> i & 1 for y in ahead if not last or y[1] == right]
    return [((x[0] - left, x[1] - left), (y[0] - right, y[1] - right)) for x, y in found]


def chunk_ids(p: Pieces, t: str, left: int, right: int, x: Token, y: Token) -> list[int]:
    """Ids of the tokens after state x up to state y (places from the left and right boundary)."""
    x, y = (x[0] + left, x[1] + left), (y[0] + right, y[1] + right)
    if x == y:
        return []

    def traced(begin: Token, stop: int, goal: Token | None) -> list[int]:
        if goal == begin or begin[1] >= stop:
            return []
        got, back = paths(p, t, {begin: 1}, stop)
        now = goal if goal is not None else next(z for z in got if z[1] == stop)
        out = [now]
        while begin not in back[out[-1]]:
            out.append(back[out[-1]][0])
        return [i for s, e in reversed(out) for i in p.ids_of(t[s:e])]

    at = words_between(t, max(left, x[1]), min(right, y[0]))
    if at is None:
        return traced(x, right, y)
    inner, outer = at
    head = traced(x, inner, None)
    return head + (p.words(t[inner:outer]) if outer > inner else []) + traced((outer, outer), right, y)


def product(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product: the best weight of a path over any state at the boundary between."""
    onward: dict[Token, list[tuple[Token, int]]] = {}
    for (m, y), w in b.items():
        onward.setdefault(m, []).append((y, w))
    out: Matrix = {}
    for (x, m), w in a.items():
        for y, v in onward.get(m, ()):
            if w + v > out.get((x, y), -(1 << 62)):
                out[x, y] = w + v
    return out


def traced_states(parts: list[Matrix], left: Token, right: Token) -> list[Token]:
    """The states at the boundaries of parts on the best path from left to right, both of these included."""
    ahead = [{left: 0}]
    for matrix in parts:
        best: dict[Token, int] = {}
        for (x, y), w in matrix.items():
            if x in ahead[-1] and ahead[-1][x] + w > best.get(y, -(1 << 62)):
                best[y] = ahead[-1][x] + w
        ahead.append(best)
    out = [right]
    for matrix, before in zip(reversed(parts), reversed(ahead[:-1]), strict=True):
        out.append(max((before[x] + w, x) for (x, y), w in matrix.items() if y == out[-1] and x in before)[1])
    return out[::-1]


def end_of(whole: Matrix) -> Token:
    """The state at the end of a document of that matrix."""
    return max((w, y) for (x, y), w in whole.items() if x == START)[1]


def combined(parts: list[Matrix]) -> Matrix:
    return reduce(product, parts)


def resolve(parts: list[Matrix], fan: int = FAN) -> list[Token]:
    """The states at all boundaries of a document, by the tree of products, in one place."""
    levels = [parts]
    while len(levels[-1]) > 1:
        levels.append([combined(levels[-1][k : k + fan]) for k in range(0, len(levels[-1]), fan)])
    states = [START, end_of(levels[-1][0])]
    for below in reversed(levels[:-1]):
        states = [states[0], *(s for k in range(len(states) - 1) for s in traced_states(below[k * fan : (k + 1) * fan], states[k], states[k + 1])[1:])]
    return states


def flat(matrix: Matrix) -> list[int]:
    return [v for (x, y), w in matrix.items() for v in (*x, *y, w)]


def unflat(values: list[int]) -> Matrix:
    return {((a, b), (c, d)): w for a, b, c, d, w in zip(*(values[i::5] for i in range(5)), strict=True)}


def encode_whole(p: Pieces, text: str, chunk: int = CHUNK, fan: int = FAN) -> list[int]:
    """Encoding by chunks in one place, as the scan does it over Spark."""
    t = marked(text)
    if not t:
        return []
    cuts = [*range(0, len(t), chunk), len(t)]
    entries = [dict.fromkeys(chunk_entries(p, t, a, b, a == 0, b == len(t)), 0) for a, b in zip(cuts, cuts[1:], strict=False)]
    states = resolve(entries, fan)
    return [i for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) for i in chunk_ids(p, t, a, b, states[k], states[k + 1])]


def parted(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, text, sha) of a single chunk, and those of more."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of().alias("text")).withColumn("sha", F.sha2("text", 256))
    size = F.length("text") + 1
    return rows.filter(size <= chunk), rows.filter(size > chunk)


def encoded(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, chunks, ids (array<int>), sha (of the text): a row for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    small, giant = parted(docs, chunk)

    def direct() -> Callable[[dict], dict]:
        p = pieces()

        def step(batch: dict) -> dict:
            return {"row": batch["row"], "doc_id": batch["doc_id"], "chunks": [1] * len(batch["row"]), "ids": p.model.encode(batch["text"], num_threads=1), "sha": batch["sha"]}

        return step

    schema = f"row long, doc_id {kind}, chunks int, ids array<int>, sha string"
    return map_batches(small, direct, schema).unionByName(scanned(giant, chunk))


def scanned(giant: DataFrame, chunk: int, fan: int = FAN) -> DataFrame:
    """Giant documents (row, doc_id, text, sha) by the parallel scan: row, doc_id, chunks, ids, sha."""
    kind = giant.schema["doc_id"].dataType.simpleString()
    size = F.length("text") + 1
    n = F.ceil(size / chunk).cast("int")
    text = F.concat(F.lit(MARK), F.translate("text", " ", MARK)).alias("text")
    giant = giant.select("row", "doc_id", "sha", n.alias("chunks"), text)
    k = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k")
    giant = giant.select("row", "doc_id", "sha", "chunks", "text", k)
    begin = F.greatest(F.col("k") * chunk - REACH, F.lit(0))
    cut = F.substring("text", begin + 1, F.lit(chunk) + F.col("k") * chunk - begin + REACH)
    cuts = written(giant.select("row", "doc_id", "sha", "chunks", "k", (F.col("k") * chunk - begin).cast("int").alias("left"), cut.alias("cut")), "chunks")

    def bounds(text: str, left: int, k: int, chunks: int) -> tuple[int, int]:
        return left, len(text) if k == chunks - 1 else left + chunk

    def matrices() -> Callable[[dict], dict]:
        p = pieces()

        def step(batch: dict) -> dict:
            out = []
            for text, left, k, chunks in zip(batch["cut"], batch["left"], batch["k"], batch["chunks"], strict=True):
                a, b = bounds(text, left, k, chunks)
                out.append(flat(dict.fromkeys(chunk_entries(p, text, a, b, k == 0, k == chunks - 1), 0)))
            return {"row": batch["row"], "k": batch["k"], "entries": out}

        return step

    entries = map_batches(cuts.select("row", "k", "chunks", "left", "cut"), matrices, "row long, k int, entries array<int>")
    states = boundary_states(written(entries, "matrices"), fan)

    def trace() -> Callable[[dict], dict]:
        p = pieces()

        def step(batch: dict) -> dict:
            out = []
            for text, left, k, chunks, s in zip(batch["cut"], batch["left"], batch["k"], batch["chunks"], batch["state"], strict=True):
                a, b = bounds(text, left, k, chunks)
                out.append(chunk_ids(p, text, a, b, (s[0], s[1]), (s[2], s[3])))
            return {"row": batch["row"], "doc_id": batch["doc_id"], "sha": batch["sha"], "chunks": batch["chunks"], "k": batch["k"], "ids": out}

        return step

    traced = map_batches(cuts.join(states, ["row", "k"]), trace, f"row long, doc_id {kind}, sha string, chunks int, k int, ids array<int>")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda q: q["ids"])
    return traced.groupBy("row", "doc_id", "chunks", "sha").agg(F.flatten(parts).alias("ids")).select("row", "doc_id", "chunks", "ids", "sha")


def boundary_states(entries: DataFrame, fan: int = FAN) -> DataFrame:
    """entries (row, k, entries: matrix of chunk k) -> row, k, state: the states at the left and right boundary of each chunk."""
    most = entries.agg(F.max("k")).first()[0] or 0
    parts = F.array_sort(F.collect_list(F.struct("k", "entries"))).alias("parts")
    levels, now = [], entries

    def up() -> Callable[[dict], dict]:
        def step(batch: dict) -> dict:
            return {"row": batch["row"], "k": batch["k"], "entries": [flat(combined([unflat(q["entries"]) for q in qs])) for qs in batch["parts"]]}

        return step

    def top() -> Callable[[dict], dict]:
        def step(batch: dict) -> dict:
            return {"row": batch["row"], "k": batch["k"], "state": [[*START, *end_of(unflat(e))] for e in batch["entries"]]}

        return step

    def down() -> Callable[[dict], dict]:
        def step(batch: dict) -> dict:
            out: dict = {"row": [], "k": [], "state": []}
            for row, qs, s in zip(batch["row"], batch["parts"], batch["state"], strict=True):
                states = traced_states([unflat(q["entries"]) for q in qs], (s[0], s[1]), (s[2], s[3]))
                for q, a, b in zip(qs, states, states[1:], strict=False):
                    out["row"].append(row)
                    out["k"].append(q["k"])
                    out["state"].append([*a, *b])
            return out

        return step

    while most:
        most //= fan
        levels.append(written(now.groupBy("row", F.floor(F.col("k") / fan).cast("int").alias("k")).agg(parts), "level"))
        now = written(map_batches(levels[-1], up, "row long, k int, entries array<int>"), "matrices")
    states = map_batches(now, top, "row long, k int, state array<int>")
    for level in reversed(levels):
        states = map_batches(level.join(states, ["row", "k"]), down, "row long, k int, state array<int>")
    return written(states, "states")


def encode_and_decode(docs: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, n_chunks, n_ids, ids_crc32, round_trip: whether decoding gives the text again.

    Ids of single chunks don't leave the task that encodes them.
    """
    from hashlib import sha256

    small, giant = parted(docs, chunk)

    def make() -> Callable[[dict], dict]:
        model = pieces().model

        def step(batch: dict) -> dict:
            ids = batch["ids"] if "ids" in batch else model.encode(batch["text"], num_threads=1)
            crcs = [zlib.crc32(np.array(i, dtype="<u4").tobytes()) for i in ids]
            back = model.decode(ids)
            same = [b == t for b, t in zip(back, batch["text"], strict=True)] if "text" in batch else [sha256(b.encode()).hexdigest() == s for b, s in zip(back, batch["sha"], strict=True)]
            chunks = batch.get("chunks") or [1] * len(ids)
            return {"doc_id": batch["doc_id"], "n_chunks": chunks, "n_ids": [len(i) for i in ids], "ids_crc32": crcs, "round_trip": same}

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chunks int, n_ids long, ids_crc32 long, round_trip boolean"
    by_scan = map_batches(scanned(giant, chunk, fan).select("doc_id", "chunks", "ids", "sha"), make, schema)
    return map_batches(small.select("doc_id", "text"), make, schema).unionByName(by_scan)
