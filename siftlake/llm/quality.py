"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are counts of its own characters and words and those of the lines before and after; the
chain adds weights for neighbouring labels. Training takes a document's label for all of its lines (a bounded sample of labelled
rows, likelihood with a ridge, fitted by Adam) and then once more with lines of bad documents that the first fit finds good
taken as good. A document's score is the mean of its lines' forward-backward marginals of good, weighted by length.

The training sample is bounded: of labelled rows that are not held out, the SAMPLE_ROWS of the least hash among those of at most
SAMPLE_CHARS characters.

Defined results: a null or empty text is a single empty line and has that line's score; repeated rows get a row each; ids may be
null and are then not held out; a null label is none; without labelled rows every score is 0.5; an empty table gives an empty
result; extra columns, of whatever name, are ignored. Labels, language, source and id are never features.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, text_of

#: Bound of the training sample: rows, and characters of a row that may be in it.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 20_000
#: Lines whose features are held at once.
MOST_LINES = 50_000
#: Characters of a sample that are cut into words at once.
MOST_CHARS = 1 << 20
STEPS = 150
RATE = 0.1
RIDGE = 1e-3
THRESHOLD = 0.3
FEATURES = 13
#: Classes of characters: 0 others, 1 lower case, 2 upper case, 3 digits, 4 white space, 5 symbols, 6 stops and commas.
CLASSES = 7


def classes() -> np.ndarray:
    """The class of each code point of the first plane; all beyond are symbols."""
    out = np.zeros(0x10001, dtype=np.uint8)
    for c in range(0x10000):
        s = chr(c)
        out[c] = 3 if s.isdigit() else 4 if s.isspace() else 2 if s.isupper() else 1 if s.islower() else 0 if s.isalpha() else 6 if s in ".,;:!?'\"-()" else 5
    out[0x10000] = 5
    return out


CLASS_OF = classes()


def line_features(texts: list[str], repeated: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of the texts, the lines' weights, and the number of lines of each text.

    repeated: which lines stood in their text before, if that is known of more of it than the texts hold.
    """
    lines = [line for t in texts for line in t.split("\n")]
    counts = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    joined = "\n".join(lines)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    line_of = np.repeat(np.arange(len(lines)), lengths + 1)[: len(points)]
    kind = CLASS_OF[np.minimum(points, 0x10000)]
    by = np.bincount(line_of * CLASSES + kind, minlength=len(lines) * CLASSES).reshape(-1, CLASSES).astype(np.float64)
    by[:-1, 4] -= 1  # the line break itself
    words = [line.split() for line in lines]
    n_words = np.fromiter(map(len, words), dtype=np.float64, count=len(lines))
    unique = np.fromiter((len(set(w)) for w in words), dtype=np.float64, count=len(lines))
    single = np.fromiter((len(set(line)) for line in lines), dtype=np.float64, count=len(lines))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    before = np.zeros(len(lines))
    for a, n in zip(starts, counts, strict=True) if repeated is None else ():
        if n > 1:
            before[a : a + n] = repeats(lines[a : a + n])
    before = before if repeated is None else repeated
    n = np.maximum(lengths, 1)
    w = np.maximum(n_words, 1)
    own = np.stack([
        np.log1p(lengths), np.log1p(n_words), unique / w, np.minimum(lengths / w, 30) / 10,
        by[:, 2] / n, by[:, 3] / n, by[:, 5] / n, by[:, 6] / n, by[:, 0] / n, by[:, 4] / n,
        np.log1p(w - unique), before, single / (n ** 0.5 + 5),
    ], axis=1)
    first = np.zeros(len(lines), dtype=bool)
    first[starts] = True
    last = np.roll(first, -1)
    prev, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    prev[first], after[last] = 0, 0
    return np.concatenate([own, prev, after, first[:, None], last[:, None]], axis=1), lengths + 1.0, counts


def sample_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features of many texts, of MOST_CHARS (or one text) at once: only the features themselves are held of all."""
    counts = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    features, lengths = np.empty((counts.sum(), 3 * FEATURES + 2)), np.empty(counts.sum())
    a = line = held = 0
    for b, text in enumerate(texts, 1):
        held += len(text)
        if b == len(texts) or held + len(texts[b]) > MOST_CHARS:
            end = line + counts[a:b].sum()
            features[line:end], lengths[line:end], _ = line_features(texts[a:b])
            a, line, held = b, end, 0
    return features, lengths, counts


def repeats(lines: list[str]) -> np.ndarray:
    """1 for each line that isn't empty and stood before."""
    seen: set[str] = set()
    out = np.zeros(len(lines))
    for i, line in enumerate(lines):
        out[i] = line in seen and line != ""
        seen.add(line)
    return out


@dataclass(frozen=True)
class Chain:
    """Weights of a line for good, of pairs of neighbouring labels, and the features' mean and scale."""

    weights: np.ndarray
    bias: float
    pairs: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights + self.bias


def marginals(scores: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line the probability of good, of each document the log of the sum, and the expected counts of pairs.

    All documents advance together, longest first, so that each step works on those that still have lines.
    """
    order = np.argsort(-counts, kind="stable")
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[order]
    sizes = counts[order]
    most = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(1, most + 1), side="right")
    own = np.stack([np.zeros_like(scores), scores], axis=1)
    ahead, behind = np.zeros_like(own), np.zeros_like(own)
    ahead[starts] = own[starts]
    for t in range(1, most):
        at = starts[: active[t]] + t
        ahead[at] = own[at] + np.logaddexp(ahead[at - 1, :1] + pairs[0], ahead[at - 1, 1:] + pairs[1])
    total = np.empty(len(counts))
    total[order] = np.logaddexp(*ahead[starts + sizes - 1].T)
    expected = np.zeros((2, 2))
    for t in range(most - 1, 0, -1):
        at = starts[: active[t]] + t
        onward = own[at] + behind[at]
        behind[at - 1] = np.logaddexp(pairs[:, 0] + onward[:, :1], pairs[:, 1] + onward[:, 1:])
        joint = ahead[at - 1][:, :, None] + pairs[None] + onward[:, None, :] - total[order[: active[t]]][:, None, None]
        expected += np.exp(joint).sum(axis=0)
    good = np.exp(ahead[:, 1] + behind[:, 1] - np.repeat(total, counts))
    return good, total, expected


def standardise(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of the features, which are brought to 0 and 1 in place: no second array of all lines stays."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    features -= mean
    features /= scale
    return mean, scale


def fit_chain(x: np.ndarray, labels: np.ndarray, counts: np.ndarray, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Chain:
    """Maximum likelihood with a ridge, by Adam on the whole sample. x: features by their mean and scale; weights: of each line, for its own label's share."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    inner = np.ones(len(labels), dtype=bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(labels[at - 1] * 2 + labels[at], minlength=4).reshape(2, 2).astype(float)
    theta = np.zeros(x.shape[1] + 1 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = len(labels)
    for step in range(1, STEPS + 1):
        w, b, pairs = theta[: x.shape[1]], theta[x.shape[1]], theta[-4:].reshape(2, 2)
        good, _, expected = marginals(x @ w + b, pairs, counts)
        diff = (labels - good) * weights
        grad = np.concatenate([x.T @ diff / n, [diff.mean()], (seen - expected).ravel() / n]) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain(theta[: x.shape[1]], float(theta[x.shape[1]]), theta[-4:].reshape(2, 2).copy(), mean, scale)


def fit(texts: list[str], labels: list[int]) -> Chain | None:
    """The chain for texts with labels 1 (good) or 0."""
    if not texts:
        return None
    features, lengths, counts = sample_features(texts)
    mean, scale = standardise(features)
    own = np.repeat(np.asarray(labels, dtype=np.int64), counts)
    chain = fit_chain(features, own, counts, np.ones(len(own)), mean, scale)
    good, _, _ = marginals(features @ chain.weights + chain.bias, chain.pairs, counts)
    # Lines of bad documents that look good are taken as good, but for each document's worst line.
    lines = np.where((own == 0) & (good > 0.7), 1, own)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for a, n, label in zip(starts, counts, labels, strict=True):
        if not label:
            lines[a + int(np.argmin(good[a : a + n] / np.sqrt(lengths[a : a + n])))] = 0
    return fit_chain(features, lines, counts, np.ones(len(own)), mean, scale)


def document_scores(chain: Chain | None, texts: list[str]) -> np.ndarray:
    """Each text's mean of its lines' marginals of good, weighted by length."""
    if chain is None:
        return np.full(len(texts), 0.5)
    out, group, held = [], [], 0
    for text in texts:
        n = text.count("\n") + 1
        if n > MOST_LINES:
            out.append((group, n, text))
            group, held = [], 0
            continue
        if group and held + n > MOST_LINES:
            out.append((group, 0, ""))
            group, held = [], 0
        group.append(text)
        held += n
    out.append((group, 0, ""))
    scores: list[float] = []
    for group, giant, text in out:
        if group:
            features, lengths, counts = line_features(group)
            good, _, _ = marginals(chain.scores(features), chain.pairs, counts)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            scores += list(np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts))
        if giant:
            scores.append(giant_score(chain, text))
    return np.clip(np.asarray(scores, dtype=np.float64), 0, 1)


def giant_score(chain: Chain, text: str) -> float:
    """The score of a text of more lines than features are held of at once: scores of lines are found in pieces, the chain is one."""
    lines = text.split("\n")
    again = repeats(lines)
    scores, lengths = np.empty(len(lines)), np.empty(len(lines))
    for a in range(0, len(lines), MOST_LINES):
        b = min(a + MOST_LINES, len(lines))
        # A line more at either end, so that neighbours are known.
        left, right = max(0, a - 1), min(len(lines), b + 1)
        features, weights, _ = line_features(["\n".join(lines[left:right])], again[left:right])
        scores[a:b], lengths[a:b] = chain.scores(features)[a - left : b - left], weights[a - left : b - left]
    good, _, _ = marginals(scores, chain.pairs, np.array([len(lines)]))
    return float(np.average(good, weights=lengths))


def train(docs: DataFrame, labels: DataFrame) -> Chain | None:
    """The chain for labelled documents that are not held out: a sample by hash of the id, bounded by SAMPLE_ROWS."""
    known = labels.filter(F.col("quality").isNotNull() & (crc_mod("doc_id", 5) != 0)).select("doc_id", "quality")
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    # Twice the share that is expected to do, so that few rows are shuffled; the bound itself is exact.
    share = 2 * SAMPLE_ROWS / max(1, known.count())
    rows = docs.filter((rank < share) & (F.length(text_of()) <= SAMPLE_CHARS)).select("doc_id", text_of().alias("text"))
    both = rows.join(known.filter(rank < share), "doc_id").select(rank.alias("rank"), "doc_id", "text", "quality")
    got = both.orderBy("rank", "doc_id", "text", "quality").limit(SAMPLE_ROWS).collect()
    return fit([r["text"] for r in got], [int(r["quality"]) for r in got])


def score(docs: DataFrame, chain: Chain | None, columns: list[str], text_col: str = "text") -> DataFrame:
    """columns of docs (and its text) with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def make() -> Callable[[dict], dict]:
        def step(batch: dict) -> dict:
            got = document_scores(shared.value, batch["__text"])
            return {c: batch[c] for c in columns} | {"score": got, "predicted": (got >= THRESHOLD).astype(np.int32)}

        return step

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return map_batches(docs.select(*columns, text_of(text_col).alias("__text")), make, f"{kept}, score double, predicted int")


def quality_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    chain = train(docs, labels)
    rows = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return score(rows, chain, ["doc_id", "held_out"])
