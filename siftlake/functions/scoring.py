"""Scores of names, as columns: a list of (alias, expression) steps in SQL.

A step may use the columns before it. Letters of the query are known when the plan is made, so the walk over a name is one column a
letter and stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

MATCH, GAP_START, GAP_MORE, BOUNDARY, CAMEL, RUN = 16, 3, 1, 8, 7, 4
WHOLE, DOT_WHOLE, PREFIX = 100, 16, 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASS_FROM = LOWER + UPPER + "0123456789" + " _-./()[],+@"
CLASS_TO = "l" * 26 + "u" * 26 + "d" * 10 + "_" * 12

Steps = list[tuple[str, str]]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def find(letter: str, text: str, start: str) -> str:
    """The first place (from 1) of a letter that is known to come."""
    return f"locate({quoted(letter)}, {text}, {start})"


def like(text: str) -> str:
    """A LIKE pattern of names that have these letters in order."""
    return "%" + "%".join("\\" + c if c in "%_\\" else c for c in text) + "%"


def fuzzy_steps(text: str) -> Steps:
    """Steps to the column score for names that hold the letters of text in order (see like)."""
    last = len(text) - 1
    steps: Steps = [
        ("folded", f"translate(name, '{UPPER}', '{LOWER}')"),
        ("classes", f"translate(name, '{CLASS_FROM}', '{CLASS_TO}')"),
        ("n", "length(name)"),
        ("flipped", "reverse(folded)"),
        ("p0", find(text[0], "folded", "1")),
    ]
    for k in range(1, len(text)):
        steps.append((f"p{k}", find(text[k], "folded", f"(p{k - 1} + 1)")))
    # The latest start that still ends there, then the greedy walk from it.
    steps.append((f"r{last}", find(text[last], "flipped", f"(n - p{last} + 1)")))
    for k in range(last - 1, -1, -1):
        steps.append((f"r{k}", find(text[k], "flipped", f"(r{k + 1} + 1)")))
    steps.append(("a0", "n - r0 + 1"))
    for k in range(1, len(text)):
        steps.append((f"a{k}", find(text[k], "folded", f"(a{k - 1} + 1)")))
    for k in range(len(text)):
        before = f"CASE WHEN a{k} = 1 THEN '_' ELSE substr(classes, a{k} - 1, 1) END"
        own = f"substr(classes, a{k}, 1)"
        steps.append((f"v{k}", before))
        steps.append((f"b{k}", f"CASE WHEN v{k} = '_' AND {own} <> '_' THEN {BOUNDARY} WHEN v{k} = 'l' AND {own} = 'u' OR v{k} IN ('l', 'u') AND {own} = 'd' THEN {CAMEL} ELSE 0 END"))
        if k == 0:
            steps += [("f0", "b0"), ("s0", f"{MATCH} + b0 * 2")]
            continue
        run = f"a{k} = a{k - 1} + 1"
        steps.append((f"f{k}", f"CASE WHEN {run} AND NOT (b{k} >= {BOUNDARY} AND b{k} > f{k - 1}) THEN f{k - 1} ELSE b{k} END"))
        steps.append((f"s{k}", f"s{k - 1} + {MATCH} + CASE WHEN {run} THEN greatest(b{k}, f{k}, {RUN}) ELSE b{k} - {GAP_START} - (a{k} - a{k - 1} - 2) * {GAP_MORE} END"))
    steps.append(("dot", "CASE WHEN n > 1 AND name LIKE '.%' THEN 1 ELSE 0 END"))
    steps.append(("cut", "n - instr(flipped, '.') + 1"))
    steps.append(("stem", "CASE WHEN instr(flipped, '.') > 0 AND cut - 1 > dot THEN cut - 1 ELSE n END"))
    steps.append(("whole", f"CASE WHEN a0 - 1 <> dot OR p{last} + 1 - a0 <> {len(text)} THEN 0 WHEN p{last} = n THEN {WHOLE} + {DOT_WHOLE} * dot WHEN p{last} = stem THEN {WHOLE} ELSE {PREFIX} END"))
    steps.append(("span", f"least(CASE WHEN whole >= {WHOLE} THEN p{last} ELSE n END, 80)"))
    steps.append(("score", f"CAST(s{last} + whole - (span - span % 3) / 3 AS INT)"))
    return steps


def stepped(names: DataFrame, text: str) -> DataFrame:
    """names with all steps of a word: one projection whose later columns name earlier ones, so that it is analysed once."""
    return names.selectExpr(*[f"`{c}`" for c in names.columns], *[f"{expression} AS {alias}" for alias, expression in fuzzy_steps(text)])


def fuzzy(names: DataFrame, text: str) -> DataFrame:
    """names (name) that match, with score."""
    found = names.filter(F.translate("name", UPPER, LOWER).like(like(text)))
    return stepped(found, text).select(*names.columns, "score")


def fuzzy_column(names: DataFrame, text: str, alias: str) -> DataFrame:
    """names with the score under an alias, null where a name doesn't match: several words are scored in one pass."""
    hit = F.translate("name", UPPER, LOWER).like(like(text))
    return stepped(names, text).select(*names.columns, F.when(hit, F.col("score")).alias(alias))


def mode_score(text: str, mode: str) -> tuple[str, str]:
    """(filter, score) of exact, prefix and suffix words, in SQL over name."""
    folded = f"translate(name, '{UPPER}', '{LOWER}')"
    short = "(least(length(name), 80) - least(length(name), 80) % 3) / 3"
    at = f"instr({folded}, {quoted(text)})"
    if mode == "exact":
        return f"{at} > 0", f"CAST(40 + CASE WHEN {at} = 1 THEN 30 ELSE 0 END - {short} AS INT)"
    if mode == "prefix":
        return f"{at} = 1", f"CAST(60 - {short} AS INT)"
    return f"right({folded}, {len(text)}) = {quoted(text)}", f"CAST(50 - {short} AS INT)"


# Adjustments of a folder's prior by its name.
FIRST_LEVEL = {"Users": 0, "Applications": 10, "Volumes": -10, "Library": -25, "System": -40, "opt": -25}
BY_NAME = {
    -20: "Library Caches caches cache Cache Logs DerivedData CoreSimulator",
    -30: "node_modules __pycache__ site-packages Pods venv bower_components",
    -12: "target build dist out vendor deps tmp temp",
    -10: "folders Containers",
    -5: "",
}
SPACED = {"Group Containers": -10, "Application Support": -5}
BUNDLES = ".framework .bundle .plugin .appex .kext .xpc .lproj .xcassets .photoslibrary .musiclibrary .tvlibrary .imovielibrary .dsym .xcarchive .sdk .platform"
HOME_BONUS, LOWEST, HIGHEST = 15, -100, 60


def prior_adjust(name: str = "x", depth: str = "depth") -> str:
    """The adjustment of one folder, in SQL over its name and depth."""
    first = " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in FIRST_LEVEL.items())
    named = " ".join(f"WHEN {name} IN ({', '.join(quoted(x) for x in names.split())}) THEN {v}" for v, names in BY_NAME.items() if names)
    spaced = " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in SPACED.items())
    bundle = " OR ".join(f"lower({name}) LIKE '_%{b}'" for b in BUNDLES.split())
    return (
        f"CASE WHEN {depth} = 1 THEN CASE {first} ELSE -35 END WHEN {name} = 'Applications' THEN 30 WHEN {name} LIKE '%.app' THEN -25 "
        f"WHEN {bundle} THEN -20 WHEN {name} LIKE '.%' THEN -25 {named} {spaced} ELSE 0 END"
    )


def prior(folder: str, home: tuple[str, ...] = ("Users", "u")) -> Column:
    """The location prior of a folder's path: adjustments from the top down, clamped at each level."""
    homes = ", ".join(quoted(h) for h in home)
    step = (
        f"(a, x) -> named_struct('p', greatest({LOWEST}, least({HIGHEST}, a.p + {prior_adjust('x', '(a.d + 1)')} + "
        f"CASE WHEN a.h = a.d AND a.d = {len(home) - 1} AND x = array({homes})[{len(home) - 1}] THEN {HOME_BONUS} ELSE 0 END)), 'd', a.d + 1, "
        f"'h', CASE WHEN a.h = a.d AND a.d < {len(home)} AND x = try_element_at(array({homes}), a.d + 1) THEN a.h + 1 ELSE a.h END)"
    )
    return F.expr(f"aggregate(filter(split({folder}, '/'), x -> x <> ''), named_struct('p', 0, 'd', 0, 'h', 0), {step}).p")


def tweaks(now: int) -> str:
    """Small nudges by entry, in SQL."""
    age = f"greatest({now} - mtime, 0)"
    return (
        "CASE WHEN name LIKE '.%' THEN -8 ELSE 0 END + CASE WHEN kind IN (1, 2) AND lower(name) LIKE '%.app' THEN 25 ELSE 0 END + "
        f"CASE WHEN {age} <= 86400 THEN 10 WHEN {age} <= 604800 THEN 7 WHEN {age} <= 2592000 THEN 4 WHEN {age} <= 31536000 THEN 1 ELSE 0 END"
    )
