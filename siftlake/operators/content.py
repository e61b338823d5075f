"""Content search: eligible text, distinct bodies, a trigram index, lines that match."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.scoring import LOWER, UPPER
from ..plans import trigrams as index

# Fixed values.
DEFINES = "fn|func|function|def|class|struct|enum|trait|interface|type|typealias|impl|let|const|var|val|static|module|mod|protocol|extension|macro_rules!|define|typedef|union|object|record|namespace|actor"
LOCKFILES = "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml bun.lock bun.lockb deno.lock Cargo.lock Gemfile.lock poetry.lock Pipfile.lock uv.lock composer.lock go.sum Podfile.lock Package.resolved Cartfile.resolved flake.lock mix.lock pubspec.lock packages.lock.json gradle.lockfile".split()
LATE_SUFFIXES = (".jsonl", ".ndjson", ".log", ".lock", ".sum")
SHOWN, PER_FILE = 400, 5
MOST_ALTERNATIVES = 16
#: What stands after a body's last two letters in the key of its end.
END = "\0"


def is_text(body: Column) -> Column:
    """No NUL byte, and not long lines: 4 KB and up with fewer than a line break per 1001 bytes."""
    size = F.octet_length(body)
    breaks = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))
    return (F.instr(body, "\0") == 0) & ~((size >= 4096) & (breaks < F.floor(size / 1001)))


def generated(name: Column, size: Column) -> Column:
    """Lockfiles, large JSON, minified or bundled assets."""
    low = F.translate(name, UPPER, LOWER)
    asset = low.rlike(r"\.(js|mjs|cjs|css)$") & (name.rlike(r"\.(min|bundle|chunk)\.") | name.startswith("bundle.") | name.startswith("chunk-"))
    return name.isin(LOCKFILES) | (low.rlike(r"\.(json|jsonc|json5)$") & (size >= 100 << 10)) | asset


def doc_rank(path: Column) -> Column:
    """Hidden folders go last, then logs and locks."""
    late = reduce(lambda a, b: a | b, [path.endswith(s) for s in LATE_SUFFIXES])
    return F.when(path.contains("/."), -2).otherwise(0) - F.when(late, 1).otherwise(0)


def smart_case(pattern: str, regex: bool = False) -> bool:
    """Whether case counts: an upper-case letter that is no escape's; without any letter at all it does."""
    letters = re.sub(r"\\[A-Za-z]|\\p\{[^}]*\}", "", pattern) if regex else pattern
    return any(c.isupper() for c in letters) or regex and not any(c.isalpha() for c in letters)


def java_regex(pattern: str, mode: str = "literal", case: bool | None = None) -> str:
    """A pattern of one of three modes as a Java regex for single lines."""
    if mode == "symbol":
        body = rf"(?<![A-Za-z0-9_])(?:{DEFINES})(?:<[^>\n]*>)?[ \t*&]+(?:mut[ \t]+)?{re.escape(pattern)}(?![A-Za-z0-9_])"
        return ("" if case in (None, True) else "(?iu)") + body
    exact = smart_case(pattern, mode == "regex") if case is None else case
    body = re.sub(r"([^\w\s])", r"\\\1", pattern, flags=re.A) if mode == "literal" else pattern
    return ("" if exact else "(?iu)") + body


def any_of(patterns: list[str]) -> str:
    """Any of several literals; case doesn't count only if it doesn't for each."""
    exact = any(smart_case(p) for p in patterns)
    return ("" if exact else "(?iu)") + "|".join(java_regex(p, "literal", True) for p in patterns)


def shown(text: Column) -> Column:
    """A line as it is shown: its first SHOWN bytes, white space at the end left out; a character that is cut becomes U+FFFD."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, SHOWN).cast("string"))
    return F.regexp_replace(F.when(F.octet_length(text) <= SHOWN, text).otherwise(cut), r"\s+$", "")


def match_ranges(text: Column, regex: str) -> Column:
    """Where in a line its matches that aren't empty stand, as (first, end) bytes."""
    sizes = lambda parts: F.transform(parts, lambda x: F.octet_length(x))
    pairs = F.arrays_zip(sizes(F.split(text, regex, -1)).alias("gap"), sizes(F.regexp_extract_all(text, F.lit(regex), F.lit(0))).alias("match"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,end:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        first = a["at"] + x["gap"]
        end = first + F.coalesce(x["match"], F.lit(0))
        return F.struct(end.alias("at"), F.when(x["match"] > 0, F.concat(a["out"], F.array(F.struct(first.alias("first"), end.alias("end"))))).otherwise(a["out"]).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def defines(text: Column, regex: str) -> Column:
    """Whether a match stands where its line declares it: a declaring keyword before it, the end of a word after it."""
    flags = "(?iu)" if regex.startswith("(?iu)") else ""
    return text.rlike(rf"(?<![A-Za-z0-9_])(?:{DEFINES})(?:<[^>\n]*>)?[ \t*&]+(?:mut[ \t]+)?{flags}(?:{regex.removeprefix(flags)})(?![A-Za-z0-9_])")


def lines_of(docs: DataFrame) -> DataFrame:
    """path, line (from 1), text: lines without their end; nothing after the last line break."""
    lines = docs.select("path", F.posexplode(F.split("body", "\n", -1)).alias("at", "text"), F.size(F.split("body", "\n", -1)).alias("n"))
    return lines.filter(~((F.col("at") == F.col("n") - 1) & (F.col("text") == "") & (F.col("n") > 0))).select("path", (F.col("at") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def in_file(docs: DataFrame, path: str, regex: str, most: int = 200) -> DataFrame:
    """path, line, text, col: the lines of one file that match, whatever it looks like; only a NUL in its first 8 KB rules it out."""
    own = docs.filter(F.col("path") == path).filter(F.instr(F.substring("body", 1, 8192), "\0") == 0)
    return grep(own, regex, most)


def grep(docs: DataFrame, regex: str, per_file: int = PER_FILE) -> DataFrame:
    """path, line, text, col: matching lines of each file, the first per_file of them. A body that can't match is never cut."""
    likely = docs.filter(F.col("body").rlike("(?m)" + regex))
    hits = lines_of(likely).filter(F.col("text").rlike(regex))
    hits = hits.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy("line"))).filter(F.col("rn") <= per_file)
    at = F.octet_length(F.regexp_extract("text", "(?s)^(.*?)(?:" + regex + ")", 1)) if "(?iu)" not in regex else F.octet_length(F.regexp_extract("text", "(?ius)^(.*?)(?:" + regex.replace("(?iu)", "") + ")", 1))
    return hits.select("path", "line", shown(F.col("text")).alias("text"), at.alias("col"))


def with_context(docs: DataFrame, regex: str, n: int) -> DataFrame:
    """path, line, before, after: the n lines around each match."""
    own = Window.partitionBy("path").orderBy("line")
    lines = lines_of(docs.filter(F.col("body").rlike("(?m)" + regex)))
    brief = shown(F.col("text"))
    around = lines.withColumns({"before": F.collect_list(brief).over(own.rowsBetween(-n, -1)), "after": F.collect_list(brief).over(own.rowsBetween(1, n))})
    return around.filter(F.col("text").rlike(regex)).select("path", "line", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


def contents(docs: DataFrame) -> DataFrame:
    """gid, body, copies: distinct bodies, by SHA-256."""
    return docs.withColumn("gid", F.sha2("body", 256)).groupBy("gid").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("copies"))


def trigrams(bodies: DataFrame, by: str = "gid") -> DataFrame:
    """key, gid (or what else a body goes by): the distinct three-character keys of each body, A-Z folded."""
    # The two letters that a search without case takes for k and s are folded to them.
    low = F.translate("body", UPPER + "\u017f\u212a", LOWER + "sk")
    # Characters are cut once, and neighbours put together: a substring by place would count from the start each time.
    keys = F.transform(F.array(F.regexp_extract_all(low, F.lit("(?s)."), F.lit(0))), joined)[0]
    # The end of a body is a key too, so that a search for two letters finds them there.
    last = F.when(F.length(low) >= 2, F.array(F.concat(F.right(low, F.lit(2)), F.lit(END)))).otherwise(F.array().cast("array<string>"))
    return bodies.select(by, F.explode(F.array_union(keys, last)).alias("key"))


def postings_of(docs: DataFrame, keys: list[str]) -> DataFrame:
    """key, gid: what trigrams(contents(docs)) has of some three-character keys, without making all others.

    Each of them is looked for in each body, which is folded once; no body is shuffled.
    """
    low = F.translate("body", UPPER + "\u017f\u212a", LOWER + "sk")
    wanted = F.array(*[F.lit(k) for k in keys])
    held = F.transform(F.array(low), lambda text: F.filter(wanted, lambda k: F.contains(text, k)))[0]
    return docs.select(F.sha2("body", 256).alias("gid"), held.alias("keys")).select("gid", F.explode("keys").alias("key")).distinct()


def joined(letters: Column) -> Column:
    """The distinct runs of three letters."""
    n = F.greatest(F.size(letters) - 2, F.lit(0))
    two = F.zip_with(F.slice(letters, F.lit(1), n), F.slice(letters, F.lit(2), n), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.zip_with(two, F.slice(letters, F.lit(3), n), lambda a, b: F.concat(a, b)))


def literal_plan(pattern: str) -> list[str]:
    """Trigrams that a body must hold to hold a literal; none if it is too short."""
    low = pattern.translate({c: c + 32 for c in range(65, 91)})
    return sorted({low[i : i + 3] for i in range(len(low) - 2) if low[i : i + 3].isascii()})


def holding_pair(postings: DataFrame, pair: str) -> DataFrame:
    """gid of bodies that hold two letters: those with a key that starts with them, the key of their end among them."""
    low = pair.translate({c: c + 32 for c in range(65, 91)})
    return postings.filter(F.col("key").startswith(low)).select("gid").distinct()


def literal_candidates(postings: DataFrame, pattern: str) -> DataFrame | None:
    """gid of bodies that may hold a literal; None if it is too short or has no key to tell."""
    if len(pattern) == 2 and pattern.isascii():
        return holding_pair(postings, pattern)
    plan = literal_plan(pattern)
    return candidates(postings, plan) if plan else None


def candidates(postings: DataFrame, plan: list[str]) -> DataFrame:
    """gid of bodies that hold every key of a plan."""
    return postings.filter(F.col("key").isin(plan)).groupBy("gid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(plan)).select("gid")


def planned(postings: DataFrame, plan: index.Plan) -> DataFrame:
    """gid of the bodies that a plan of plans.trigrams lets in: one pass over the plan's keys, one flag for each key of it."""
    wanted = sorted(index.keys(plan))
    flag = {k: f"k{i}" for i, k in enumerate(wanted)}

    def holds(p: index.Plan) -> Column:
        if isinstance(p, str):
            return F.col(flag[p])
        parts = [holds(x) for x in p[1]]
        return reduce(lambda a, b: a & b, parts) if p[0] == "and" else reduce(lambda a, b: a | b, parts)

    seen = postings.filter(F.col("key").isin(wanted)).groupBy("gid").agg(*[F.bool_or(F.col("key") == k).alias(f) for k, f in flag.items()])
    return seen.filter(holds(plan)).select("gid")


def symbols(bodies: DataFrame) -> DataFrame:
    """symbol, gid: identifiers after a declaring keyword; a name that is itself a keyword is looked at again."""
    regex = rf"(?<![A-Za-z0-9_])(?={'(?:' + DEFINES + ')'}(?:<[^>\n]*>)?[ \t*&]+(?:mut[ \t]+)?([A-Za-z_][A-Za-z0-9_]*))"
    return bodies.select("gid", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(regex), F.lit(1)))).alias("symbol"))
