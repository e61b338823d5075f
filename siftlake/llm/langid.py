"""Language identification by compression.

Each language has a raw-content zstandard dictionary of sampled training texts. A whole text is cut into blocks of words, each
block is compressed with every dictionary, and the language whose sum is smallest wins; a narrow margin marks the text as rejected.
Compressing in blocks keeps a long text from becoming its own dictionary.

The training sample is bounded: of each of the LANGUAGES most frequent languages about SAMPLE_ROWS rows, of each row one block (the
whole text if it is shorter) from a place that its hash gives, of as many characters as make up DICT_CHARS with those of all rows.

Defined results: ``und`` (score 0, rejected) for a null text or one without a letter (numbers such as a half or a Roman one are
none); ties go to the language with more training rows; languages are those of the training rows, however few and however long;
without any training row every text is ``und``; repeated rows get a row each; ids may be null; an empty table gives an empty
result; extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_batches

UNKNOWN = "und"
#: Bounds of the training sample: languages, rows of each, and characters of a dictionary, to which each row gives its part.
LANGUAGES = 256
SAMPLE_ROWS = 800
DICT_CHARS = 400_000
LEVEL = 3
BLOCK = 2000
#: Bytes a thousand characters (and at least) by which the best language must win for a text not to be rejected.
MARGIN = 2.0
LEAST_MARGIN = 1.0
NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    """Languages by falling number of training rows, and the text of each one's dictionary."""

    languages: tuple[str, ...]
    texts: tuple[bytes, ...]


def letters(text: str) -> str:
    """Lower-case words of letters, one space between."""
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id") -> LanguageModel:
    """Dictionaries of a bounded sample: rows by hash of their key and text, about SAMPLE_ROWS of each language."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key_col, text_col).alias("hash"))
    rows = rows.filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return LanguageModel((), ())
    rank = F.pmod("hash", F.lit(1_000_000)) / 1e6
    # A bounded table: a share for each of LANGUAGES languages.
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, SAMPLE_ROWS / n), DICT_CHARS // min(n, SAMPLE_ROWS)) for k, n in counts.items()], "lang string, share double, chars int")
    kept = rows.withColumn("lang", F.col("lang").cast("string")).join(F.broadcast(shares), "lang").filter(rank < F.col("share"))
    start = F.pmod(F.xxhash64("hash"), F.greatest(F.length("text") - F.col("chars") + 1, F.lit(1))).cast("int") + 1
    sample = kept.select("lang", F.substring("text", start, F.col("chars")).alias("block"), "hash").collect()
    parts: dict[str, list[str]] = {k: [] for k in counts}
    for lang, block, _ in sorted(map(tuple, sample), key=lambda r: (r[2], r[1])):
        parts[lang].append(letters(block))
    texts = tuple(" ".join(dict.fromkeys(parts[k]))[-DICT_CHARS:].encode() for k in counts)
    return LanguageModel(tuple(counts), texts)


def blocks(words: str) -> list[bytes]:
    """The words in blocks of about BLOCK characters, cut at spaces where there are any."""
    out, at = [], 0
    while at < len(words):
        end = at + BLOCK
        if end < len(words) and (space := words.rfind(" ", at + BLOCK // 2, end)) > 0:
            end = space
        out.append(words[at:end].encode())
        at = end
    return out


def classifier(model: LanguageModel) -> Callable[[str | None], tuple[str, float, bool]]:
    """text -> language, score, rejected."""
    import zstandard as z

    squeezers = []
    for text in model.texts:
        raw = z.ZstdCompressionDict(text, dict_type=z.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        squeezers.append(z.ZstdCompressor(level=LEVEL, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def classify(text: str | None) -> tuple[str, float, bool]:
        words = letters(text or "")
        if not has_letter(words) or not squeezers:
            return UNKNOWN, 0.0, True
        cut = blocks(f" {words} ")
        sizes = [sum(len(f(b)) for b in cut) for f in squeezers]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        gaps = [s - sizes[best] for i, s in enumerate(sizes) if i != best]
        gap = min(gaps, default=math.inf)
        score = 1 / (1 + sum(math.exp(-min(g, 60) / 3) for g in gaps))
        return model.languages[best], score, gap < max(LEAST_MARGIN, MARGIN * len(words) / 1000)

    return classify


def predict(docs: DataFrame, model: LanguageModel, columns: list[str], text_col: str = "text") -> DataFrame:
    """columns of docs (and its text) with lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[dict], dict]:
        classify = classifier(shared.value)

        def step(batch: dict) -> dict:
            got = [classify(t) for t in batch["__text"]]
            return {c: batch[c] for c in columns} | {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]}

        return step

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return map_batches(docs.select(*columns, F.col(text_col).alias("__text")), make, f"{kept}, lang_pred string, score double, rejected boolean")


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: learned from rows that are not held out, predicted for all."""
    held_out = crc_mod("doc_id", 3) == 1
    model = fit(docs.filter(~held_out))
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])
