"""Formulas of the DuckDB oracles, written by hand for that engine and from the rules alone: nothing here is shared with the engine's columns."""

from __future__ import annotations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KINDS = f"translate(name, '{LOW}{UP}0123456789 _-./()[],+@', '{'l' * 26}{'u' * 26}{'d' * 10}{'_' * 12}')"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def bonus(at: str) -> str:
    """What a letter at a place (from 1) gets for where it stands in its word."""
    own, before = f"substr(kinds, {at}, 1)", f"(CASE WHEN {at} = 1 THEN '_' ELSE substr(kinds, {at} - 1, 1) END)"
    return f"(CASE WHEN {before} = '_' AND {own} <> '_' THEN 8 WHEN {before} || {own} IN ('lu', 'ld', 'ud') THEN 7 ELSE 0 END)"


def fuzzy_rows(source: str, cap: int = 116) -> str:
    """A SELECT of name, q, score over a relation of names and lower-case words q: a walk by recursion, a row a letter.

    Forward to the first place at which all letters have come, back from there to the latest start, and forward again.
    """
    return f"""WITH RECURSIVE f AS (SELECT DISTINCT name, q, translate(name, '{UP}', '{LOW}') AS low, {KINDS} AS kinds, length(q) AS m FROM {source}),
ahead AS (SELECT *, 1 AS k, instr(low, substr(q, 1, 1)) AS p FROM f WHERE instr(low, substr(q, 1, 1)) > 0
  UNION ALL SELECT name, q, low, kinds, m, k + 1, p + instr(substr(low, p + 1), substr(q, k + 1, 1)) FROM ahead WHERE k < m AND instr(substr(low, p + 1), substr(q, k + 1, 1)) > 0),
back AS (SELECT *, p AS last FROM ahead WHERE k = m
  UNION ALL SELECT name, q, low, kinds, m, k - 1, p - instr(reverse(substr(low, 1, p - 1)), substr(q, k - 1, 1)), last FROM back WHERE k > 1),
walk AS (SELECT name, q, low, kinds, m, last, p AS start, 1 AS k, p AS here, {bonus('p')} AS opened, 16 + 2 * {bonus('p')} AS total FROM back WHERE k = 1
  UNION ALL SELECT name, q, low, kinds, m, last, start, k + 1, nx, CASE WHEN nx = here + 1 AND NOT (b >= 8 AND b > opened) THEN opened ELSE b END,
    total + 16 + CASE WHEN nx = here + 1 THEN greatest(b, CASE WHEN b >= 8 AND b > opened THEN b ELSE opened END, 4) ELSE b - 3 - (nx - here - 2) END
  FROM (SELECT *, {bonus('nx')} AS b FROM (SELECT *, here + instr(substr(low, here + 1), substr(q, k + 1, 1)) AS nx FROM walk WHERE k < m))),
ended AS (SELECT *, length(name) AS n, CASE WHEN length(name) > 1 AND starts_with(name, '.') THEN 1 ELSE 0 END AS off, length(name) - instr(reverse(name), '.') + 1 AS dot FROM walk WHERE k = m),
put AS (SELECT *, CASE WHEN start - 1 <> off OR last + 1 - start <> m THEN 0 WHEN last = n THEN 100 + 16 * off
  WHEN contains(name, '.') AND dot - 1 > off AND last = dot - 1 THEN 100 ELSE 30 END AS placed FROM ended)
SELECT name, q, CAST(total + least(placed, {cap}) - least(CASE WHEN placed >= 100 THEN last ELSE n END, 80) // 3 AS INT) AS score FROM put"""


def fuzzy(source: str, word: str) -> str:
    """The CTE scored (name, score) of the names of a relation for a word."""
    return f"scored AS (SELECT name, score FROM ({fuzzy_rows(f'(SELECT name, {text(word)} AS q FROM {source})')}))"


STARTS = "(SELECT name, unnest(list_filter(range(1, length(name) + 1), lambda i: i = CASE WHEN length(name) > 1 AND starts_with(name, '.') THEN 2 ELSE 1 END OR i > 1 AND substr(name, i - 1, 1) = ' ')) AS s FROM {source})"


def typo_rows(source: str, word: str) -> str:
    """A SELECT of name, score of the names that hold a word with one edit after its first letter, where a word of theirs starts.

    The edits are read off the first letter that differs: two letters swapped, one wrong, one missing, one extra, in this order.
    """
    w, n = text(word), len(word)
    at = f"(SELECT name, s, substr(low, s) AS word, list_min(list_filter(range(1, {n} + 1), lambda i: substr(low, s + i - 1, 1) <> substr({w}, i, 1))) AS i FROM (SELECT *, translate(name, '{UP}', '{LOW}') AS low FROM {STARTS.format(source=source)}))"
    rest = lambda skip: f"substr({w}, CAST(i AS INT) + {skip})"
    word_from = lambda skip: f"substr(word, CAST(i AS INT) + {skip})"
    length = (f"CASE WHEN i < {n} AND substr(word, CAST(i AS INT), 2) = reverse(substr({w}, CAST(i AS INT), 2)) AND starts_with({word_from(2)}, {rest(2)}) THEN {n} "
              f"WHEN i <= length(word) AND starts_with({word_from(1)}, {rest(1)}) THEN {n} WHEN starts_with({word_from(0)}, {rest(1)}) THEN {n - 1} "
              f"WHEN i <= length(word) AND starts_with({word_from(1)}, {rest(0)}) THEN {n + 1} END")  # fmt: skip
    plain = f"NOT regexp_matches(substr({w}, CAST(i AS INT), 1) || substr(word, CAST(i AS INT), 1), '[0-9]')"
    parts = f"(SELECT name, substr(word, 1, size) AS q FROM (SELECT *, {length} AS size FROM {at} WHERE i > 1 AND {plain}) WHERE size IS NOT NULL)"
    return f"SELECT name, max(score) - 60 AS score FROM ({fuzzy_rows(parts, 30)}) GROUP BY name"


def deep_rows(source: str, word: str, most: int) -> str:
    """A SELECT of name, score of names of which a word's beginning is at most so many edits from a word without digits: fewest edits, then the
    earliest word, then the shortest beginning. Beginnings with a digit would need a digit edited."""
    w, n = text(word), len(word)
    cut = f"(SELECT name, s, substr(substr(translate(name, '{UP}', '{LOW}'), 1, 63), s) AS word FROM {STARTS.format(source=source)})"
    tried = f"(SELECT name, s, size, substr(word, 1, CAST(size AS INT)) AS q FROM (SELECT *, unnest(range({n - most}, {n + most + 1})) AS size FROM {cut}) WHERE length(word) >= size)"
    ranked = f"(SELECT *, damerau_levenshtein(q, {w}) AS d FROM {tried} WHERE NOT regexp_matches(q, '[0-9]'))"
    word_best = f"(SELECT name, s, min(d) AS d FROM {ranked} GROUP BY name, s HAVING min(d) BETWEEN 1 AND {most})"
    best = f"(SELECT name, arg_min(s, d * 1000 + s) AS s, min(d) AS d FROM {word_best} GROUP BY name)"
    parts = f"(SELECT b.name, arg_min(q, size) AS q, any_value(b.d) AS d FROM {best} b JOIN {ranked} r ON r.name = b.name AND r.s = b.s AND r.d = b.d GROUP BY b.name)"
    return f"SELECT p.name, CAST(score - 60 * p.d AS INT) AS score FROM {parts} p JOIN ({fuzzy_rows(parts, 30)}) z ON z.name = p.name"


#: Adjustments of folders by name, at the top and elsewhere, and what a name's form says.
TOP_FOLDERS = "(VALUES ('Users', 0), ('Applications', 10), ('Volumes', -10), ('Library', -25), ('System', -40), ('opt', -25)) AS top(name, adjust)"
NAMED_FOLDERS = """(VALUES ('Library', -20), ('Caches', -20), ('caches', -20), ('cache', -20), ('Cache', -20), ('Logs', -20), ('DerivedData', -20), ('CoreSimulator', -20),
 ('node_modules', -30), ('__pycache__', -30), ('site-packages', -30), ('Pods', -30), ('venv', -30), ('bower_components', -30),
 ('target', -12), ('build', -12), ('dist', -12), ('out', -12), ('vendor', -12), ('deps', -12), ('tmp', -12), ('temp', -12),
 ('folders', -10), ('Containers', -10), ('Group Containers', -10), ('Application Support', -5)) AS named(name, adjust)"""
BUNDLED = "[^/][.](framework|bundle|plugin|appex|kext|xpc|lproj|xcassets|photoslibrary|musiclibrary|tvlibrary|imovielibrary|dsym|xcarchive|sdk|platform)$"
FOLDERS = f"""a AS (SELECT e.path, e.parent, e.name, len(string_split(e.path, '/')) - 1 AS depth,
 CASE WHEN e.parent = '' THEN coalesce((SELECT adjust FROM {TOP_FOLDERS} WHERE top.name = e.name), -35) WHEN e.name = 'Applications' THEN 30 WHEN ends_with(e.name, '.app') THEN -25
 WHEN regexp_matches(e.name, '{BUNDLED}', 'i') THEN -20 WHEN starts_with(e.name, '.') THEN -25
 ELSE coalesce((SELECT adjust FROM {NAMED_FOLDERS} WHERE named.name = e.name), 0) END AS adjust FROM e WHERE kind = 1)"""


def priors(home: str) -> str:
    """CTEs a and p (path, depth, prior): adjustments added from the top down, kept between -100 and 60, 15 more on coming home."""
    return f"""{FOLDERS},
p AS (SELECT path, depth, greatest(-100, least(60, adjust)) AS prior FROM a WHERE parent = ''
      UNION ALL SELECT a.path, a.depth, greatest(-100, least(60, p.prior + a.adjust + CASE WHEN a.path = '{home}' THEN 15 ELSE 0 END)) FROM a JOIN p ON a.parent = p.path)"""


def nudges(now: int, of: str = "e") -> str:
    """Small nudges by an entry's name, kind and age."""
    days = f"greatest({now} - {of}.mtime, 0) / 86400.0"
    return (f"(CASE WHEN starts_with({of}.name, '.') THEN -8 ELSE 0 END + CASE WHEN {of}.kind <> 0 AND regexp_matches({of}.name, '[.]app$', 'i') THEN 25 ELSE 0 END"
            f" + CASE WHEN {days} <= 1 THEN 10 WHEN {days} <= 7 THEN 7 WHEN {days} <= 30 THEN 4 WHEN {days} <= 365 THEN 1 ELSE 0 END)")  # fmt: skip


def mode(word: str, how: str) -> str:
    """The CTE scored of exact, prefix and suffix words over u (name)."""
    low, w = f"translate(name, '{UP}', '{LOW}')", text(word)
    where = {"exact": f"contains({low}, {w})", "prefix": f"starts_with({low}, {w})", "suffix": f"ends_with({low}, {w})"}[how]
    base = {"exact": f"40 + CASE WHEN starts_with({low}, {w}) THEN 30 ELSE 0 END", "prefix": "60", "suffix": "50"}[how]
    return f"scored AS (SELECT name, CAST({base} - least(length(name), 80) // 3 AS INT) AS score FROM u WHERE {where})"


def several(words: list[str], under: list[int] = []) -> str:  # noqa: B006
    """The CTE own (path, parent, name, kind, size, mtime, own) of entries e for several words, under: those after a slash (from 0)."""
    n = len(words)
    out = [f"t{k} AS MATERIALIZED (SELECT name, score FROM ({fuzzy_rows(f'(SELECT DISTINCT name, {text(w)} AS q FROM e)')}))" for k, w in enumerate(words)]
    out.append("way AS (SELECT parent, part, i, len(parts) AS deep FROM (SELECT parent, parts, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT DISTINCT parent, list_filter(string_split(parent, '/'), lambda c: c <> '') AS parts FROM e)))")
    best = ", ".join(f"max(t{k}.score) AS d{k}, bool_or(i = deep AND t{k}.score IS NOT NULL) AS p{k}" for k in range(n))
    joins = " ".join(f"LEFT JOIN t{k} ON t{k}.name = part" for k in range(n))
    out.append(f"memo AS (SELECT parent, {best} FROM way {joins} GROUP BY parent)")
    own = " + ".join(f"coalesce(t{k}.score, {f'greatest(d{k}, 0) * 3 // 4' if k < 4 else '6'})" for k in range(n))
    some, every = " OR ".join(f"t{k}.score IS NOT NULL" for k in range(n)), " AND ".join(f"(t{k}.score IS NOT NULL OR d{k} IS NOT NULL)" for k in range(n))
    fit = "0"
    if under:
        hit = " OR ".join(f"t{k}.score IS NOT NULL AND p{k - 1}" for k in under)
        fit = f"CASE WHEN t{under[-1]}.score IS NULL THEN -40 ELSE 0 END + CASE WHEN {hit} THEN 30 ELSE 0 END"
    else:
        squash = lambda s: f"translate({s}, '{UP}_-. ', '{LOW}')"
        whole, joined = " AND ".join(f"t{k}.score IS NOT NULL" for k in range(n)), text("".join(words))
        stem = "CASE WHEN instr(reverse(e.name), '.') BETWEEN 1 AND length(e.name) - 1 THEN left(e.name, length(e.name) - instr(reverse(e.name), '.')) ELSE e.name END"
        fit = f"CASE WHEN {whole} AND {joined} IN ({squash('e.name')}, {squash(stem)}) THEN 100 ELSE 0 END"
    out.append(f"own AS (SELECT e.*, CAST({own} + {fit} AS INT) AS own FROM e LEFT JOIN memo ON memo.parent = e.parent {' '.join(f'LEFT JOIN t{k} ON t{k}.name = e.name' for k in range(n))} WHERE ({some}) AND {every})")
    return ",\n".join(out)


def shown(line: str) -> str:
    """A line's first 400 bytes, a character that is cut in two as U+FFFD, white space at the end left out."""
    bytes_of = lambda s: f"octet_length(encode({s}))"
    fits = f"list_max(list_filter(range(100, 401), lambda i: {bytes_of(f'substr({line}, 1, i)')} <= 400))"
    cut = f"substr({line}, 1, {fits})"
    return f"regexp_replace(CASE WHEN {bytes_of(line)} <= 400 THEN {line} ELSE {cut} || CASE WHEN {bytes_of(cut)} < 400 THEN chr(65533) ELSE '' END END, '\\s+$', '')"


def debounced(events: str, key: str, quiet: int, now: int) -> str:
    """CTEs ending in used (key, score): opens (key, ts) that fade by half in two weeks, those soon after the last accepted one left out."""
    return f"""seq AS MATERIALIZED (SELECT {key} AS k, ts, row_number() OVER (PARTITION BY {key} ORDER BY ts) AS i FROM {events}),
acc AS (SELECT k, i, ts AS last, power(2.0, -({now} - ts) / 1209600.0) AS score FROM seq WHERE i = 1
  UNION ALL SELECT seq.k, seq.i, CASE WHEN seq.ts - last >= {quiet} THEN seq.ts ELSE last END, score + CASE WHEN seq.ts - last >= {quiet} THEN power(2.0, -({now} - seq.ts) / 1209600.0) ELSE 0 END
  FROM acc JOIN seq ON seq.k = acc.k AND seq.i = acc.i + 1),
used AS (SELECT k, score FROM (SELECT k, arg_max(score, i) AS score FROM acc GROUP BY k) WHERE score >= 0.06)"""
