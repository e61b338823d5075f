"""Ranked search over names: predicates, scores of distinct names, inheritance from folders, a deterministic top-k."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.scoring import LOWER, UPPER, fuzzy, fuzzy_column, mode_score, prior, tweaks
from ..plans.ir import Query, Token
from ..plans.trigrams import of_regex

#: What a token that only a folder on the path matches adds: three quarters of the folder's best, or FLAT beyond the first four.
FLAT, SCORED_TOKENS = 6, 4
PATH_MISS, PATH_HIT = 40, 30
HIDDEN = -8
#: Hits that are looked at to tell whether words are well found.
WELL_TOP = 8


def folded(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def ext_is(name: Column, exts: list[str]) -> Column:
    return name.contains(".") & folded(F.substring_index(name, ".", -1)).isin(exts)


def extension_counts(entries: DataFrame) -> DataFrame:
    """ext, n: how many files have an extension, A-Z folded; the empty one is of those without."""
    ext = F.when(F.col("name").contains("."), folded(F.substring_index("name", ".", -1))).otherwise("")
    return entries.filter("kind = 0").groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def holds(text: Column, token: Token) -> Column:
    """Whether a name matches a token, as far as negation and folders ask."""
    low, want = folded(text), token.text
    if token.mode == "prefix":
        return low.startswith(want)
    if token.mode == "suffix":
        return low.endswith(want)
    if token.mode == "exact":
        return low.contains(want)
    return low.rlike(".*".join("\\Q" + c + "\\E" for c in want))


def any_part(path: Column, token: Token) -> Column:
    """Whether a token matches the own name or that of any folder above."""
    return F.exists(F.filter(F.split(path, "/"), lambda c: c != ""), lambda c: holds(c, token))


def predicate(q: Query) -> Column:
    """Every filter of a query but its positive tokens, cheap ones first; those on path, kind, size and mtime reach a Parquet scan."""
    name, path = F.col("name"), F.col("path")
    out: list[Column] = []
    if q.scope:
        out.append(path.startswith(q.scope + "/"))
    if q.kind is not None:
        out.append(F.col("kind").isin([1, 2]) if q.apps and q.kind == 1 else F.col("kind") == q.kind)
    if q.size:
        out.append(F.col("size").between(*q.size))
    if q.mtime:
        out.append(F.col("mtime").between(*q.mtime))
    if q.exts is not None:
        out.append(ext_is(name, q.exts) if q.exts != ["/"] else F.lit(False))
    if q.not_exts:
        out.append(~ext_is(name, q.not_exts))
    if q.name_regex:
        out += [folded(name).contains(k) for k in required(q.name_regex)] + [name.rlike("(?i)" + q.name_regex)]
    for t in q.tokens:
        if t.negate:
            out.append(~any_part(path, t))
    for g in q.globs:
        below = F.substring(path, len(q.scope) + 1, 1 << 30) if q.scope else path
        hit = reduce(lambda a, b: a | b, [below.rlike(p) for p in g.patterns])
        out.append(~hit if g.negate else hit)
    if q.path_regex:
        out += [folded(path).contains(k) for k in required(q.path_regex)] + [path.rlike("(?i)" + q.path_regex)]
    return reduce(lambda a, b: a & b, out, F.lit(True))


def required(regex: str) -> list[str]:
    """A few texts, A-Z folded, that all that a regex matches must hold: looked for before the regex is."""
    plan = of_regex("(?i)" + regex)
    keys = [plan] if isinstance(plan, str) else [k for k in plan[1] if isinstance(k, str)] if plan and plan[0] == "and" else []
    # Letters beyond ASCII fold to k and s in a regex, but not here.
    return sorted(k for k in keys if k.isascii() and not set(k) & set("ks"))[:4]


def token_scores(names: DataFrame, token: Token, typos: str = "none") -> DataFrame:
    """name, score of the names that match a token; typos: none, one (an edit after the first letter) or deep."""
    if token.mode == "fuzzy":
        clean = fuzzy(names.select("name"), token.text)
        if typos == "none" or not edits_of(token):
            return clean
        other = deep_scores(names, token.text) if typos == "deep" else typo_scores(names, token.text)
        return clean.unionByName(other).groupBy("name").agg(F.max("score").alias("score"))
    where, score = mode_score(token.text, token.mode)
    return names.select("name").filter(where).select("name", F.expr(score).alias("score"))


def squashed(name: Column) -> Column:
    return F.translate(folded(name), "_-. ", "")


def spelled(q: list[Token]) -> Column:
    """A bonus for several words that spell a name or its stem, delimiters left out."""
    if len(q) < 2 or any(t.under for t in q):
        return F.lit(0)
    joined = F.lit("".join(t.text for t in q).translate({ord(c): None for c in "_-. "}))
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    return F.when((squashed(F.col("name")) == joined) | (squashed(stem) == joined), 100).otherwise(0)


def search(entries: DataFrame, q: Query, now: int, offset: int = 0, typos: str = "none") -> DataFrame:
    """path, kind, size, mtime, score: q.limit entries from place offset on, by score, files first, then folder and name.

    Names are scored once each and joined back, which Catalyst doesn't do by itself; folders are scored per distinct name too.
    """
    # Entries that the file system hides, if that is known of them.
    hidden = F.when(F.col("hidden"), HIDDEN).otherwise(0) if "hidden" in entries.columns else F.lit(0)
    score = F.col("own") + prior("parent") + F.expr(tweaks(now)) + hidden
    out = matched(entries, q, typos).select("path", "parent", "name", "kind", "size", "mtime", score.cast("int").alias("score"))
    ordered = out.orderBy(*total_order())
    top = ordered.limit(q.limit) if not offset else ordered.offset(offset).limit(q.limit)
    return top.select("path", "kind", "size", "mtime", "score")


def matched(entries: DataFrame, q: Query, typos: str = "none", overlay: bool = False) -> DataFrame:
    """The entries that a query lets through, with own: what their names and folders score."""
    tokens = [t for t in q.tokens if not t.negate]
    found = entries.filter(predicate(q))
    names = found.select("name").distinct()
    if not tokens:
        return found.withColumn("own", F.lit(0))
    if len(tokens) == 1:
        return found.join(token_scores(names, tokens[0], typos).withColumnRenamed("score", "own"), "name")
    return several(found, names, tokens, typos, overlay)


def total_order() -> list[Column]:
    return [F.desc("score"), (F.col("kind") != 0).asc(), F.split("parent", "/").asc(), F.col("name").asc()]


def live_search(base: DataFrame, dead: DataFrame, delta: DataFrame, q: Query, now: int, typos: str = "none") -> DataFrame:
    """path, kind, size, mtime, score over a base without what is dead or replaced, and a delta.

    Of equal scores files come first, then the base before the delta, whose own ties go by path. An entry of the delta ranks with the
    prior of the nearest folder that the base knows (a folder only in the delta has none of its own), and takes three quarters of what
    its folders match for each word, whatever that is.
    """
    kept = base.join(dead.select("path").union(delta.select("path")).distinct(), "path", "left_anti")
    of_base = matched(kept, q, typos).withColumn("prior", prior("parent")).withColumn("newer", F.lit(False))
    over = matched(delta, q, typos, overlay=True)
    over = over.join(known_folders(over.select("parent").distinct(), base), "parent", "left").withColumn("prior", F.coalesce(prior("known"), F.lit(0))).drop("known").withColumn("newer", F.lit(True))
    score = (F.col("own") + F.col("prior") + F.expr(tweaks(now))).cast("int").alias("score")
    columns = ["path", "parent", "name", "kind", "size", "mtime", "newer"]
    both = of_base.select(*columns, score).unionByName(over.select(*columns, score))
    place = F.when(F.col("newer"), F.array("path")).otherwise(F.split("parent", "/"))
    order = [F.desc("score"), (F.col("kind") != 0).asc(), F.col("newer").asc(), place.asc(), F.col("name").asc()]
    return both.orderBy(*order).limit(q.limit).select("path", "kind", "size", "mtime", "score")


def known_folders(folders: DataFrame, base: DataFrame) -> DataFrame:
    """parent, known: the nearest folder at or above each that is a folder of the base; folders above are joined by equality."""
    parts = F.split("parent", "/")
    above = folders.select("parent", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("above"))
    hits = above.join(base.filter("kind = 1").select(F.col("path").alias("above")), "above", "left_semi")
    return hits.groupBy("parent").agg(F.max_by("above", F.length("above")).alias("known"))


def scored_names(names: DataFrame, tokens: list[Token], alias: str, typos: str = "none") -> DataFrame:
    """names (name) with a column of scores for each token, null where it doesn't match: one pass, joined only where typos count."""
    out = names
    for k, t in enumerate(tokens):
        column = f"{alias}{k}"
        if t.mode != "fuzzy":
            where, score = mode_score(t.text, t.mode)
            out = out.withColumn(column, F.when(F.expr(where), F.expr(score)))
        elif typos == "none" or not edits_of(t):
            out = fuzzy_column(out, t.text, column)
        else:
            out = out.join(token_scores(names, t, typos).withColumnRenamed("score", column), "name", "left")
    # Names are distinct, so nothing is merged or shuffled here; but no filter on a score is pushed below, which would write its steps out.
    return out.groupBy("name").agg(*[F.first(f"{alias}{k}").alias(f"{alias}{k}") for k in range(len(tokens))])


def several(found: DataFrame, names: DataFrame, tokens: list[Token], typos: str = "none", overlay: bool = False) -> DataFrame:
    """found with own: each token in the own name, or inherited from a folder; one in the own name at least."""
    table = scored_names(names, tokens, "t", typos)
    folders = found.select("parent").distinct()
    each = folders.select("parent", F.posexplode(F.filter(F.split("parent", "/"), lambda c: c != "")).alias("at", "name"))
    parts = scored_names(each.select("name").distinct(), tokens, "d", typos)
    ks = range(len(tokens))
    best = each.join(parts, "name").groupBy("parent").agg(*[F.max(f"d{k}").alias(f"d{k}") for k in ks], *[F.max_by(F.col(f"d{k}").isNotNull(), "at").alias(f"p{k}") for k in ks])
    scored = found.join(table, "name").join(best, "parent", "left")
    own, some, every = F.lit(0), F.lit(False), F.lit(True)
    for k in ks:
        there, above = F.col(f"t{k}"), F.col(f"d{k}")
        # An overlay's entries inherit from each word, less than nothing too.
        share = above * 3 / 4 if overlay else F.greatest(above, F.lit(0)) * 3 / 4 if k < SCORED_TOKENS else F.lit(FLAT)
        own = own + F.coalesce(there, share.cast("int"))
        some, every = some | there.isNotNull(), every & (there.isNotNull() | above.isNotNull())
    whole = reduce(lambda a, b: a & b, [F.col(f"t{k}").isNotNull() for k in ks])
    bonus = F.when(whole, spelled(tokens)).otherwise(0) + path_fit(tokens)
    return scored.filter(some & every).withColumn("own", own + bonus)


def path_fit(tokens: list[Token]) -> Column:
    """For words with slashes: less if the last piece isn't in the own name, more if a piece is and the one before names the folder."""
    under = [k for k, t in enumerate(tokens) if t.under]
    if not under:
        return F.lit(0)
    there = lambda k: F.col(f"t{k}").isNotNull()
    fits = reduce(lambda a, b: a | b, [there(k) & F.coalesce(F.col(f"p{k - 1}"), F.lit(False)) for k in under if k], F.lit(False))
    return F.when(there(under[-1]), 0).otherwise(-PATH_MISS) + F.when(fits, PATH_HIT).otherwise(0)


def search_deep(entries: DataFrame, q: Query, now: int, offset: int = 0) -> DataFrame:
    """A search in which words may have a typo; where one isn't well found among the first WELL_TOP hits, deeper typos count too.

    Only those few hits come to the driver.
    """
    tokens = [t for t in q.tokens if edits_of(t)]
    if tokens:
        top = [r.path for r in search(entries, replace(q, limit=WELL_TOP), now, 0, "one").select("path").collect()]
        if not all(any(well_found(c, t.text) for p in top for c in p.split("/") if c) for t in tokens):
            return search(entries, q, now, offset, "deep")
    return search(entries, q, now, offset, "one" if tokens else "none")


def well_found(name: str, text: str) -> bool:
    """Whether a name holds a word as typed from a word's start on, with a typo after its first letter, or as an abbreviation."""
    score = fuzzy_score(name, text)
    if score is not None and score + min(len(name), 80) // 3 >= 23 * len(text) + 7:
        return True
    low = name.translate({c: c + 32 for c in range(65, 91)})
    starts = [i for i in range(len(low)) if i == 0 or name[i - 1] in "_-. "]
    return any(low.startswith(text, i) for i in starts) or typo_score(name, text, 30, 60) is not None or abbreviates(name, text)


def letter_kind(c: str) -> str:
    return "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "d" if "0" <= c <= "9" else "_" if c in " _-./()[],+@" else "o"


def abbreviates(name: str, text: str) -> bool:
    """Whether text spells a name by the beginnings of two or more of its words, two letters of each at least."""
    if any(c in "_-. " for c in text):
        return False
    low = name.translate({c: c + 32 for c in range(65, 91)})
    kinds = [letter_kind(c) for c in name]
    begins = [i == 0 or kinds[i - 1] == "_" != kinds[i] or kinds[i - 1] + kinds[i] in ("lu", "ld", "ud") for i in range(len(name))]
    lengths: list[int] = []
    at = 0
    for c in text:
        if lengths and at < len(low) and low[at] == c:
            lengths[-1] += 1
        else:
            at = next((i for i in range(at, len(low)) if begins[i] and low[i] == c), -1)
            if at < 0:
                return False
            lengths.append(1)
        at += 1
    return len(lengths) > 1 and min(lengths) > 1


def edits_of(token: Token) -> int:
    """How many edits a token may take when typos count: one from 5 letters on, two from 8."""
    return 0 if token.mode != "fuzzy" or token.negate else (len(token.text) >= 5) + (len(token.text) >= 8)


def deep_scores(names: DataFrame, text: str) -> DataFrame:
    """name, score of names that hold text with one or two edits, the first letter's too, at the start of a word.

    An Arrow function over distinct names; names too short to hold the text are out before.
    """
    most = edits_of(Token(text))

    @F.pandas_udf("int")
    def score(column: pd.Series) -> pd.Series:
        return column.map(lambda n: deep_score(n, text, most)).astype("Int32")

    long = names.select("name").filter(F.length("name") >= len(text) - most)
    return long.select("name", score("name").alias("score")).filter("score IS NOT NULL")


def deep_score(name: str, text: str, most: int, cost: int = 60) -> int | None:
    """The score of the part of a name that text spells with the fewest edits, then the earliest start; none if it spells it right."""
    if not most or len(text) > 64:
        return None
    low = name[:63].translate({c: c + 32 for c in range(65, 91)})
    starts = [int(len(name) > 1 and name[0] == ".")] + [i + 1 for i, c in enumerate(low) if c == " "]
    found = [(got[0], s, got[1]) for s in starts if (got := fewest_edits(low[s : s + len(text) + most], text, most))]
    if not found:
        return None
    edits, start, length = min(found)
    part = fuzzy_score(name, low[start : start + length], 30)
    return None if part is None else part - cost * edits


@lru_cache(1 << 16)
def fewest_edits(word: str, text: str, most: int) -> tuple[int, int] | None:
    """(edits, length) of the prefix of word nearest to text: letters may be wrong, extra, missing or swapped, digits never.

    One row of costs for each letter of text, over prefixes of word; swaps look two rows back. A prefix longer than text by more than most
    has too many edits, so callers cut words there, and those that start alike are looked at once.
    """
    far = most + 1
    before: list[int] = []
    row = [0]
    for c in word[: most]:
        row.append(far if c.isdigit() else min(far, row[-1] + 1))
    row += [far] * (len(word) + 1 - len(row))
    for i, c in enumerate(text):
        free = not c.isdigit()
        new = [row[0] + 1 if free else far]
        for j, w in enumerate(word, 1):
            w_free = not w.isdigit()
            cost = row[j - 1] if w == c else row[j - 1] + 1 if free and w_free else far
            if free:
                cost = min(cost, row[j] + 1)
            if w_free:
                cost = min(cost, new[j - 1] + 1)
            if i and j > 1 and free and text[i - 1] != c and not text[i - 1].isdigit() and w == text[i - 1] and word[j - 2] == c:
                cost = min(cost, before[j - 2] + 1)
            new.append(min(cost, far))
        if min(new) > most:
            return None
        before, row = row, new
    least = min(row)
    return None if least == 0 or least > most else (least, row.index(least))


def typo_scores(names: DataFrame, text: str) -> DataFrame:
    """name, score of names that hold text with one edit at the start of a word; a Python function over distinct names.

    An edit is a wrong, extra, missing or swapped letter, never a digit, nor the first letter.
    """
    cost, cap = 60, 30

    @F.pandas_udf("int")
    def score(column: pd.Series) -> pd.Series:
        return column.map(lambda n: typo_score(n, text, cap, cost)).astype("Int32")

    # What can't hold the word is out before the function: too short, or no word starts with its first letter.
    start = "(?:^[.]?| )" + re.sub(r"([^\w\s])", r"\\\1", text[0], flags=re.A)
    likely = names.select("name").filter((F.length("name") >= len(text) - 1) & folded(F.col("name")).rlike(start))
    return likely.select("name", score("name").alias("score")).filter("score IS NOT NULL")


def edited_prefix(word: str, text: str) -> int | None:
    """How long a prefix of word text spells with exactly one edit."""
    i = next((k for k in range(len(text)) if k >= len(word) or word[k] != text[k]), None)
    if i is None or text[i].isdigit() or i < len(word) and word[i].isdigit():
        return None
    here, after = word[i:], word[i + 1 :]
    if here[:2] == text[i : i + 2][::-1] and len(text[i : i + 2]) == 2 and word[i + 2 :].startswith(text[i + 2 :]):
        return len(text)
    if i < len(word) and after.startswith(text[i + 1 :]):
        return len(text)
    if here.startswith(text[i + 1 :]):
        return len(text) - 1
    return len(text) + 1 if i < len(word) and after.startswith(text[i:]) else None


def fuzzy_score(name: str, text: str, cap: int = 116) -> int | None:
    """The score of functions.scoring for one name, in Python."""
    low = name.translate({c: c + 32 for c in range(65, 91)})
    end = -1
    for c in text:
        if (end := low.find(c, end + 1)) < 0:
            return None
    start = end + 1
    for c in reversed(text):
        start = low.rfind(c, 0, start)

    def kind(i: int) -> str:
        return letter_kind(name[i] if i >= 0 else " ")

    total, at, first = 0, start, 0
    for k, c in enumerate(text):
        run = False
        if k:
            last, at = at, low.find(c, at + 1)
            run = at == last + 1
            total -= 0 if run else 3 + (at - last - 2)
        before, own = kind(at - 1), kind(at)
        b = 8 if before == "_" != own else 7 if (before, own) in (("l", "u"), ("l", "d"), ("u", "d")) else 0
        if run:
            first = b if b >= 8 and b > first else first
            b = max(b, first, 4)
        else:
            first = b
        total += 16 + (2 * b if k == 0 else b)
    off = int(len(name) > 1 and name[0] == ".")
    stem = name.rfind(".") if name.rfind(".") > off else len(name)
    length, placed = len(name), 0
    if start == off and end + 1 - start == len(text):
        placed = 100 + 16 * off if end + 1 == len(name) else 100 if end + 1 == stem else 30
        length = end + 1 if placed >= 100 else len(name)
    return total + min(placed, cap) - min(length, 80) // 3


def typo_score(name: str, text: str, cap: int, cost: int) -> int | None:
    low = name.translate({c: c + 32 for c in range(65, 91)})
    starts = [int(len(name) > 1 and name[0] == ".")] + [i + 1 for i, c in enumerate(name) if c == " "]
    best = None
    for s in starts:
        if s < len(low) and low[s] == text[0] and (n := edited_prefix(low[s:], text)) is not None:
            got = fuzzy_score(name, low[s : s + n], cap)
            if got is not None and (best is None or got - cost > best):
                best = got - cost
    return best
