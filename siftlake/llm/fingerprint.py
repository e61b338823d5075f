"""Canonical exact digests, with DataFrame functions only.

A text is brought into canonical form (composed Unicode, case folded, white space folded), hashed to 128 bits by two xxhash64
of different seeds, and texts that share a hash are compared byte by byte: where two canonical texts differ, the fingerprint
gets the SHA-256 of the canonical text as a suffix, so that equal texts always have equal fingerprints and others never do.
Edited texts, which no table holds, are told apart by their SHA-256 in place of their bytes.

Composition is normal form C as unicodedata has it: characters are decomposed, runs of marks sorted by combining class, and
composed again, Hangul by arithmetic; texts without a character that this could change are left alone. Folding is full case
folding, character by character (sharp s to ss, final sigma to sigma).

Defined results: a null text counts as empty; repeated rows get a row each, next to each other in some order; a null id comes
last; a single row is its own next document; an empty table gives an empty result; extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import hot_keys, skew_join, text_of, written

#: Buckets of the order of ids for each shuffle partition, and rows sampled for each bucket's bounds.
BUCKETS, SAMPLED = 8, 20
#: Vowels and final consonants of Hangul that compose with what is before them.
VOWELS, FINALS = (0x1161, 0x1175), (0x11A8, 0x11C2)


@cache
def compositions() -> dict[str, str]:
    """Pairs of characters with the one that Unicode composes of them (without Hangul)."""
    out = {}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", c) == c:
            out[chr(int(parts[0], 16)) + chr(int(parts[1], 16))] = c
    return out


@cache
def decompositions() -> dict[str, str]:
    """Characters with their full canonical decomposition (without Hangul)."""
    every = (chr(code) for code in range(sys.maxunicode + 1) if not 0xD800 <= code < 0xE000 and not 0xAC00 <= code <= 0xD7A3)
    return {c: d for c in every if (d := unicodedata.normalize("NFD", c)) != c}


@cache
def marks() -> dict[str, int]:
    """Characters of a combining class, with it."""
    return {chr(code): n for code in range(sys.maxunicode + 1) if (n := unicodedata.combining(chr(code)))}


def ranges(characters: set[str]) -> str:
    """The inside of a regex class of characters."""
    codes, out = sorted(map(ord, characters)), []
    for code in codes:
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


def one_of(characters: set[str], gap: int = 128) -> str:
    """A regex of one of the characters: few wide ranges are looked at before many narrow ones."""
    wide: set[str] = set()
    codes = sorted(map(ord, characters))
    for a, b in zip(codes, codes[1:] + [codes[-1]], strict=True):
        wide.update(map(chr, range(a, b if b - a <= gap else a + 1)), chr(b))
    return f"(?=[{ranges(wide)}])[{ranges(characters)}]"


def composed(text: Column) -> Column:
    """The text in normal form C; texts without a character that it could change are left alone."""
    # One literal a table: thousands of them take long to plan.
    table = lambda d: F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in d.items())), F.lit("\x02"), F.lit("\x01"))
    pairs, whole, classes = compositions(), decompositions(), marks()
    hangul = {chr(code) for a, b in (VOWELS, FINALS) for code in range(a, b + 1)}
    joining = set(classes) | {k[1] for k in pairs} | hangul
    joins, splits = ranges(joining), ranges(set(whole))
    changing = one_of(joining | {c for c in whole if unicodedata.normalize("NFC", c) != c})
    # A class is looked up as the code of a character that stands for it, 0 for characters of none.
    froms, tos = "".join(classes), "".join(chr(0xE000 + n) for n in classes.values())
    code = lambda c: F.ascii(c)
    class_of = lambda c: F.when(F.translate(c, froms, tos) != c, code(F.translate(c, froms, tos)) - 0xE000).otherwise(F.lit(0))
    each = lambda t: F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))

    def ordered(t: Column) -> Column:
        """Characters with their class: runs of marks sorted by it, others in place."""
        numbered = F.transform(each(t), lambda c, i: F.struct(class_of(c).alias("n"), i.alias("i"), c.alias("c")))
        start = F.struct(F.lit(0).alias("run"), F.array().cast("array<struct<run:int,n:int,i:int,c:string>>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            run = a["run"] + F.when(x["n"] == 0, 1).otherwise(0)
            return F.struct(run.alias("run"), F.concat(a["out"], F.array(F.struct(run.alias("run"), x["n"].alias("n"), x["i"].alias("i"), x["c"].alias("c")))).alias("out"))

        return F.array_sort(F.aggregate(numbered, start, step)["out"])

    def pair(a: Column, c: Column) -> Column:
        """What a and c compose to, else null."""
        first, second = code(a), code(c)
        syllable = F.when(first.between(0x1100, 0x1112) & second.between(*VOWELS), 0xAC00 + ((first - 0x1100) * 21 + second - VOWELS[0]) * 28)
        syllable = syllable.when(first.between(0xAC00, 0xD7A3) & ((first - 0xAC00) % 28 == 0) & second.between(*FINALS), first + second - FINALS[0] + 1)
        return F.coalesce(F.decode(F.unhex(F.hex(syllable)), "UTF-16BE"), F.try_element_at(table(pairs), F.concat(a, c)))

    def cluster(t: Column) -> Column:
        """done: text behind; base: the last character of no class; rest: marks after it, the last of class n."""
        start = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("rest"), F.lit(0).alias("n"))

        def step(a: Column, x: Column) -> Column:
            free = (a["rest"] == "") | (a["n"] < x["n"])
            put = lambda done, base, rest, n: F.struct(done.alias("done"), base.alias("base"), rest.alias("rest"), n.alias("n"))
            new = F.when(free, pair(a["base"], x["c"]))
            apart = F.when(x["n"] == 0, put(F.concat(a["done"], a["base"], a["rest"]), x["c"], F.lit(""), F.lit(0))).otherwise(put(a["done"], a["base"], F.concat(a["rest"], x["c"]), x["n"]))
            return F.when(new.isNotNull(), put(a["done"], new, a["rest"], a["n"])).otherwise(apart)

        return F.aggregate(ordered(t), start, step, lambda a: F.concat(a["done"], a["base"], a["rest"]))

    tokens = F.regexp_extract_all(text, F.lit(f"(?s)[{splits}]|[^{splits}]+"), F.lit(0))
    apart = F.array_join(F.transform(tokens, lambda t: F.when(F.length(t) == 1, F.coalesce(F.try_element_at(table(whole), t), t)).otherwise(t)), "")
    tokens = F.regexp_extract_all(apart, F.lit(f"(?s)[^{joins}]?[{joins}]+|[^{joins}]+(?=[^{joins}][{joins}])|[^{joins}]+"), F.lit(0))
    out = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(f"[{joins}]"), cluster(t)).otherwise(t)), "")
    return F.when(text.rlike(changing), out).otherwise(text)


@cache
def foldings() -> dict[str, str]:
    """Characters whose case folding is not their lower case."""
    every = (chr(code) for code in range(sys.maxunicode + 1) if not 0xD800 <= code < 0xE000)
    return {c: c.casefold() for c in every if c.casefold() != c.lower()}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: From here on characters can be marks, compose, or have no simple folding but for the few that low() has.
HIGH = "[\\x{300}-\\x{10FFFF}]"


def low(text: Column) -> Column:
    """The case folding of a text without a character of HIGH."""
    for c, f in foldings().items():
        if ord(c) < 0x300:
            text = F.replace(text, F.lit(c), F.lit(f))
    return F.lower(text)


def folded(text: Column) -> Column:
    """The text in full case folding."""
    special = foldings()
    inside = ranges(set(special))
    table = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in special.items())), F.lit("\x02"), F.lit("\x01"))

    def high(t: Column) -> Column:
        tokens = F.regexp_extract_all(t, F.lit(f"(?s)[{inside}]|[^{inside}]+"), F.lit(0))
        mapped = F.array_join(F.transform(tokens, lambda x: F.when(F.length(x) == 1, F.coalesce(F.try_element_at(table, x), x)).otherwise(x)), "")
        # Lower case makes a capital sigma at the end of a word a final one.
        return F.replace(F.lower(F.when(t.rlike(one_of(set(special))), mapped).otherwise(t)), F.lit("\u03c2"), F.lit("\u03c3"))

    return let(text, lambda t: F.when(t.rlike(HIGH), high(t)).otherwise(low(t)))


def canonical(text: Column) -> Column:
    """Composed, case folded, every run of white space one space, trimmed."""
    form = let(text, lambda t: F.when(t.rlike(HIGH), folded(composed(t))).otherwise(low(t)))
    return F.trim(F.regexp_replace(form, r"[\s\x85\p{Z}]+", " "))


def hash128(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of independent seeds."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def hex128(high: str, low: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def bounds(rows: DataFrame, buckets: int) -> list[list[tuple[int, int]]]:
    """Lower bounds of at most so many buckets of rows (d, t) of similar size, in groups: quantiles of a bounded sample.

    They only decide where the order is cut, so any sample gives the same results.
    """
    n = rows.count()
    some = rows.sample(min(1.0, buckets * SAMPLED / max(1, n)), seed=1).select("d", "t").collect()
    cuts = sorted({(r.d, r.t) for r in sorted(some)[SAMPLED::SAMPLED]})
    size = max(1, int(len(cuts) ** 0.5))
    return [cuts[k : k + size] for k in range(0, len(cuts), size)]


def bucket_of(place: Column, cuts: list[list[tuple[int, int]]]) -> Column:
    """The number of bounds that place (a struct of d and t) has reached, found by group and within the group."""
    if not cuts:
        return F.lit(0)
    literal = lambda rows, kind: F.from_json(F.lit(json.dumps(rows)), kind)
    named = [[{"d": d, "t": t} for d, t in group] for group in cuts]
    heads = literal([g[0] for g in named], "array<struct<d:bigint,t:bigint>>")
    groups = literal(named, "array<array<struct<d:bigint,t:bigint>>>")
    group = F.size(F.filter(heads, lambda x: x <= place))
    inner = F.size(F.filter(F.element_at(groups, group), lambda x: x <= place))
    return F.when(group == 0, 0).otherwise((group - 1) * len(cuts[0]) + inner)


def with_next_text(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with edge and next_text: the text of the next row by descending doc_id.

    Rows are cut into buckets at quantiles of (id, number of the row), so that neither an outlying id nor one of many rows makes
    a large bucket, and each text is shuffled once. The last row of a bucket has no next text yet; edge tells the first and last.
    Returned beside that: bucket, where a higher one comes first.
    """
    least = F.lit(-(1 << 63)).cast("long")
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", least).alias("d"), F.xxhash64(F.monotonically_increasing_id()).alias("t"))
    cuts = bounds(rows, BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.withColumn("bucket", bucket_of(F.struct("d", "t"), cuts))
    order = Window.partitionBy("bucket").orderBy(F.desc("d"), F.desc("t"))
    first, last = F.lag("d").over(order).isNull(), F.lead("d").over(order).isNull()
    return placed.select("doc_id", "text", "bucket", F.lead("text").over(order).alias("next_text"), first.alias("first"), last.alias("last"))


def prints(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, next_text and others, which stay) with the columns of which fingerprints are made."""
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - cut), F.left(F.coalesce("next_text", F.lit("")), cut))
    others = [c for c in rows.columns if c not in ("doc_id", "text", "next_text")]
    forms = rows.select(*others, "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), canonical(F.col("text")).alias("c"), canonical(edited).alias("e"), canonical(F.coalesce("next_text", F.lit(""))).alias("n"))
    hashes = [h.alias(f"{k}{i}") for k in "ce" for i, h in enumerate(hash128(F.col(k)))]
    # Fingerprints are equal exactly where canonical texts are, so likeness compares those.
    same = [(F.col("c") == F.col(k)).cast("double").alias(name) for k, name in (("e", "near_edited"), ("n", "near_next"))]
    return forms.select(*others, "doc_id", "text", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"), *hashes, *[F.unhex(F.sha2(k, 256)).alias(f"{k}s") for k in "ce"], *same)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, for every row of docs."""
    base = docs.select("doc_id", text_of().alias("text"))
    near = with_next_text(base)
    edge = F.when(F.col("first") | F.col("last"), F.col("text"))
    slim = written(prints(near).withColumn("text", edge), "fingerprints")
    # Two rows a bucket at most: its last one is followed by the first one of the bucket after it, after the last by the first.
    edges = slim.filter("first OR last").select("bucket", "first", "last", "doc_id", "text")
    heads = edges.filter("first").select("bucket", F.col("text").alias("next_text"))
    after = edges.filter("first").select("bucket", F.lag("bucket").over(Window.orderBy("bucket")).alias("after"), F.max("bucket").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("top"))
    after = after.select("bucket", F.coalesce("after", "top").alias("after"))
    ends = edges.filter("last").join(after, "bucket").join(heads.withColumnRenamed("bucket", "after"), "after").select("doc_id", "text", "next_text")
    rows = written(slim.filter("NOT last").drop("text", "bucket", "first", "last").unionByName(prints(ends).drop("text")), "fingerprints")
    clash = clashes(base, rows)
    out = {}
    for k, name in (("c", "fingerprint"), ("e", "edited_fingerprint")):
        short = hex128(f"{k}0", f"{k}1")
        found = F.lit(False) if clash is None else F.array_contains(F.lit(clash), short)
        out[name] = F.when(found, F.concat(short, F.lit("-"), F.lower(F.hex(f"{k}s")))).otherwise(short)
    return rows.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), *[v.alias(k) for k, v in out.items()], "near_edited", "near_next")


def clashes(base: DataFrame, slim: DataFrame) -> list[str] | None:
    """Hashes that texts of different bytes share, as hex; None if there are none, which is all that ever happens by chance.

    Only rows whose hash another row has are read again; a bucket's different canonical texts are counted, equal ones being
    merged before they are shuffled. Edited texts count by their SHA-256.
    """
    known = slim.select("doc_id", F.struct("c0", "c1").alias("key"))
    shared = written(known.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    least = F.lit(-(1 << 63)).cast("long")
    ids = skew_join(known, shared.select("key"), "key", hot_keys(shared, "key", "n", slim.count()), "left_semi").select(F.coalesce("doc_id", least).alias("d")).distinct()
    texts = base.withColumn("d", F.coalesce("doc_id", least)).join(ids, "d", "left_semi").select(canonical(F.col("text")).alias("c"))
    high, low = hash128(F.col("c"))
    different = texts.withColumns({"h0": high, "h1": low}).groupBy("h0", "h1", "c").agg(F.lit(1).alias("one"))
    differ = different.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h0", "h1")
    both = slim.select(F.col("c0").alias("h0"), F.col("c1").alias("h1"), F.col("cs").alias("s")).unionByName(slim.select(F.col("e0").alias("h0"), F.col("e1").alias("h1"), F.col("es").alias("s")))
    edited = both.groupBy("h0", "h1").agg(F.min(F.xxhash64("s")).alias("least"), F.max(F.xxhash64("s")).alias("most")).filter("least <> most").select("h0", "h1")
    found = sorted({r[0] for r in differ.union(edited).select(hex128("h0", "h1")).collect()})
    return found or None
