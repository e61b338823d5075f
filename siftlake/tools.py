"""Tools over an engine: find files and grep, which loosen a query that finds nothing one way at a time, and answer with text."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .engine import Engine
from .operators import content
from .plans.parser import is_filter, spellings, split_request, split_words

# Words that declare a name, words before them, and folders of tools, tests, samples and docs.
DECLARING = "fn func function def class struct enum trait interface type impl module mod object protocol extension union typedef namespace record actor macro_rules! #define".split()
MODIFIERS = "pub export default async abstract unsafe static protected private public final inline extern const".split()
ASIDE = "tools test tests testing selftests testdata fixtures samples examples Documentation docs scripts benches vendor third_party".split()
C_FILES = ("c", "h", "cc", "cpp", "hpp", "m", "mm")
#: Lines shown of a definition's body, and of a file that is only counted.
BODY, COUNTED = 6, 1000
#: Characters shown of a line.
WIDTH = 160


def any_word(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def definition_regex(name: str) -> str:
    """A regex of lines that define a name, for Java and Python alike: a declaring word after any modifiers and then the name, where a type
    has a body or nothing after it and others don't just end with a semicolon; or a C function's first line, from column 0."""
    n = re.escape(name) + r"(?![A-Za-z0-9_])"
    lead = rf"^\s*(?:(?:pub\([^)]*\)|{any_word(MODIFIERS)})\s+)*"
    gap = r"(?:<[^>]*>)?[\s(*&]+(?:mut\s+)?"
    types = rf"(?:struct|union|enum|class){gap}{n}\s*(?:<.*>)?\s*(?:$|[{{:(]|where|extends|implements)"
    other = rf"(?:{any_word(w for w in DECLARING if w not in ('struct', 'union', 'enum', 'class'))}){gap}{n}(?:.*[={{].*|.*[^;\s])?\s*$"
    function = rf"^(?!extern|\s)(?:[^=(]*[ *])?{n}\s*\((?:.*[^;\s])?\s*$"
    return rf"(?:{lead}(?:{types}|{other}))|(?:{function})"


def is_definition(line: Column, name: str) -> Column:
    return line.rlike(definition_regex(name))


def sought_name(pattern: str) -> str | None:
    """The identifier that a pattern is after: itself, or what follows a declaring word."""
    words = pattern.split(" ")
    if len(words) == 2 and words[0] in DECLARING:
        words = words[1:]
    return words[0] if len(words) == 1 and re.fullmatch(r"[A-Za-z0-9_-]{3,}", words[0]) and re.search("[A-Za-z]", words[0]) else None


def reads_as_regex(pattern: str) -> bool:
    """Whether text makes sense as a regex only."""
    alternatives = pattern.split("|")
    return bool(
        re.search(r"\\[bsdwSWD(\[.{]|\(\?|\.[*+?]|\[[^\]]*-[^\]]*\]", pattern)
        or len(alternatives) > 1 and all(a and a == a.strip(" ") for a in alternatives)
        or len(pattern) > 1 and (pattern[0] == "^" or pattern[-1] == "$" and pattern[-2] != "\\")
    )


def other_spellings(name: str) -> str:
    """A regex of an identifier's words with or without a delimiter between them, in any case."""
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)
    return "(?i)" + "[_-]?".join(words)


def swaps(word: str) -> list[str]:
    """A short word with two neighbouring letters swapped; longer ones may have typos anyway."""
    if not 3 <= len(word) <= 4 or not (word.isascii() and word.isalnum()):
        return []
    return list(dict.fromkeys(w for i in range(len(word) - 1) if (w := word[:i] + word[i + 1] + word[i] + word[i + 2 :]) != word))


def aside(path: str) -> bool:
    return any(part in ASIDE for part in path.split("/"))


def importing(line: str) -> bool:
    return re.match(r"\s*(?:import |use |from |#include|require\(|@import)", line) is not None


def clip(line: str, around: str = "", most: int = WIDTH) -> str:
    """A line trimmed; of a long one a window around a text."""
    text = line.strip()
    if len(text) <= most:
        return text
    at = text.lower().find(around.lower()) if around else -1
    start = max(0, at - most // 3) if at > 0 else 0
    end = min(len(text), start + most)
    return ("\u2026" if start else "") + text[start:end] + ("\u2026" if end < len(text) else "")


def path_lines(hits: DataFrame) -> DataFrame:
    """value: a path a line."""
    return hits.select(F.col("path").alias("value"))


def match_lines(lines: DataFrame) -> DataFrame:
    """value: path:line: text."""
    return lines.select(F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(": "), "text").alias("value"))


def json_lines(rows: DataFrame) -> DataFrame:
    """value: a JSON object a row."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


@dataclass
class Tools:
    """find_files and grep for a folder; paths are shown from root on. Only pages of hits come to the driver, never more than asked for."""

    engine: Engine
    root: str = ""

    def show(self, path: str) -> str:
        return path.removeprefix(self.root + "/") if self.root else path

    def scope(self) -> list[str]:
        return [f"in:{self.root}"] if self.root else []

    # Finding files.

    def find_files(self, query: str, limit: int = 20, offset: int = 0) -> str:
        """Paths for a query. If nothing matches: short words with two letters swapped, then what is ignored, then one word less, the last
        first, and then files that hold the text, definitions first."""
        if query.strip() in ("", "*"):
            return self.worked_on(limit)
        filters, globs, words = split_request(query)
        folders = not words and len(globs) == 1 and globs[0].endswith("/") and globs[0][0] != "!"
        if folders:
            words, globs = [globs[0].rstrip("/").split("/")[-1]], []
        kind = [] if any(f.startswith("kind:") for f in filters) else ["kind:dir" if folders else "kind:file"]

        def hits(some: list[str], hide: bool = True) -> list:
            text = " ".join([*some, *filters, *kind, *self.scope(), *globs, f"limit:{limit + 1}"])
            return self.engine.named(self.engine.search(text, offset, hide_ignored=hide)).orderBy(F.desc("score"), "path").collect()

        tries: list[tuple[list[str], bool, str]] = [(words, True, "")]
        for i, w in enumerate(words):
            tries += [([*words[:i], s, *words[i + 1 :]], True, f"0 files match '{w}'; as '{s}':") for s in swaps(w)]
        if self.engine.ignored is not None:
            tries.append((words, False, "0 matches outside ignored files; ignored:"))
        if len(words) > 1:
            tries += [([*words[:i], *words[i + 1 :]], True, f"0 files match all of '{' '.join(words)}'; without '{words[i]}':") for i in reversed(range(len(words)))]
        for k, (some, hide, note) in enumerate(tries):
            if got := hits(some, hide):
                return self.files_text(got[:limit], some, note, offset + limit if len(got) > limit else None)
            if k == 0 and offset:
                return f"no more files past cursor {offset}"
        if words and self.engine.docs is not None:
            text = " ".join(words)
            if found := self.lines_for(text, limit=5, per_file=1):
                return "\n".join([f"0 file names match '{text}'; files containing it:", *[f"{self.show(r.path)}:{r.line}: {clip(r.text, text, 120)}" for r in found]])
        return f"0 files match '{query}' in {self.root or 'the whole tree'}"

    def worked_on(self, limit: int) -> str:
        """No query: what has a status, then what was opened or committed lately."""
        paths: list[str] = []
        if self.engine.status is not None:
            paths = [r.path for r in self.engine.search(" ".join(["git:modified", "kind:file", *self.scope(), f"limit:{limit}"])).collect()]
        if self.engine.opens is not None:
            paths += [r.path for r in self.engine.recent(" ".join([*self.scope(), f"limit:{limit}"])).collect()]
        paths = list(dict.fromkeys(paths))[:limit]
        return "\n".join(["changed, then worked on lately:", *map(self.show, paths)]) if paths else "nothing changed or worked on lately here; give a query"

    def files_text(self, hits: list, words: list[str], note: str, cursor: int | None) -> str:
        """A path a line, with a slash after folders and the status; a file at a path that was given comes first."""
        given = [w.removeprefix("./") for w in words if "/" in w]
        at = lambda h: any(self.show(h.path) == w or h.path.endswith("/" + w) for w in given)
        hits = sorted(hits, key=lambda h: not at(h))
        out = [note] if note else []
        if not note and words and not all(w.lower() in hits[0].path.lower() for w in words):
            out.append(f"no exact match for '{' '.join(words)}'; closest:")
        out += [self.show(h.path) + ("/" if h.kind == "dir" else "") + (f" ({h.git})" if h.git else "") for h in hits]
        return "\n".join(out + ([f"cursor: {cursor}"] if cursor else []))

    # Searching text.

    def grep(self, query: str, mode: str = "content", limit: int = 20, offset: int = 0, context: int = 0, regex: bool | None = None) -> str:
        """Lines for a query: content, files or count. If nothing matches: without the file that was named, as a regex, in other spellings,
        for its longest word, and then names of files like it. What defines the name that is sought comes first."""
        words = split_words(query)
        texts = [w for w in words if not (is_filter(w) or w.startswith("!") or self.names_files(w))]
        where = [w for w in words if w not in texts] if texts else []
        pattern = " ".join(texts or words)
        as_regex = reads_as_regex(pattern) if regex is None else regex
        named = [w for w in where if not is_filter(w) and re.fullmatch(r"[\w./@+-]+\.\w{1,10}", w)]
        tries: list[tuple[str, bool, list[str], str]] = [(pattern, as_regex, where, "")]
        if as_regex and regex is None:
            tries.append((pattern, False, where, ""))
        if named:
            tries.append((pattern, as_regex, [w for w in where if w not in named], f"0 matches for '{pattern}' in the named file; everywhere:"))
        if not as_regex and reads_as_regex(pattern):
            tries.append((pattern, True, where, f"0 matches for '{pattern}' as text; as a regex:"))
        if not as_regex and spellings(pattern):
            tries.append((other_spellings(pattern), True, where, f"0 matches for '{pattern}'; other spellings:"))
        if not as_regex and " " in pattern:
            longest = max(pattern.split(), key=len)
            tries.append((longest, False, where, f"0 matches for '{pattern}'; for '{longest}':"))
        per_file = COUNTED if mode == "count" else content.PER_FILE
        for k, (text, is_regex, filters, note) in enumerate(tries):
            if k and offset:
                return f"no more matches past cursor {offset}"
            try:
                re.compile(text if is_regex else "")
            except re.error:
                continue
            if got := self.lines_for(text, is_regex, filters, limit + 1, per_file, offset, context, sought_name(pattern) if mode == "content" else None):
                return self.lines_text(got, text if not is_regex else "", note, mode, limit, offset)
        near = [self.show(r.path) for r in self.engine.search(" ".join([pattern.replace(":", " "), "kind:file", *self.scope(), "limit:3"])).collect()]
        out = f"0 matches for '{pattern}' in {self.root or 'the whole tree'}"
        return "\n".join([out + "; files named like it:", *near]) if near else out

    def multi_grep(self, patterns: list[str], mode: str = "content", limit: int = 20, where: str = "") -> str:
        """Lines with any of several texts, case counting only if it does for one of them."""
        got = self.collected(content.any_of(patterns), where.split(), limit + 1, content.PER_FILE, 0, 0, None)
        return self.lines_text(got, "", "", mode, limit, 0) if got else f"0 matches for {', '.join(patterns)}"

    def names_files(self, word: str) -> bool:
        return bool(re.search(r"[*?{\[].*/|/.*[*?{\[]|^\*\.\w+$|.+/$", word)) or re.fullmatch(r"[\w./@+-]+\.[A-Za-z][A-Za-z0-9]{0,9}", word) is not None

    def lines_for(self, text: str, is_regex: bool = False, filters: Iterable[str] = (), limit: int = 20, per_file: int = content.PER_FILE, offset: int = 0, context: int = 0, name: str | None = None) -> list:
        return self.collected(content.java_regex(text, "regex" if is_regex else "literal"), list(filters), limit, per_file, offset, context, name or sought_name(text))

    def collected(self, regex: str, filters: list[str], limit: int, per_file: int, offset: int, context: int, name: str | None) -> list:
        """Rows (path, line, text, def, before, after, body) of a page of files, those with a definition of name first.

        Files are ranked and cut in Spark; a page has at most limit files with per_file lines each.
        """
        where = " ".join([*self.scope(), *[f if is_filter(f) or f[0] == "!" or re.search(r"[*?{\[/]", f) else f"'{f}" for f in filters]])
        lines, files = self.engine.matches(regex, self.engine.parsed(where), per_file)
        flag = is_definition(F.col("text"), name) if name else F.lit(False)
        lines = lines.withColumn("def", flag)
        beside = F.exists(F.split("path", "/"), lambda c: c.isin(ASIDE))
        only_imports = F.min(F.col("text").rlike(r"^\s*(?:import |use |from |#include|require\(|@import)").cast("int"))
        files = files.join(lines.groupBy("path").agg(F.max(F.col("def").cast("int")).alias("has"), only_imports.alias("imports")), "path")
        order = [F.desc(F.col("has") * (1 - beside.cast("int"))), F.desc("has"), F.asc("imports"), F.asc(beside.cast("int")), F.desc("rank"), F.desc("mtime"), F.asc("path")]
        page = files.orderBy(*order).offset(offset).limit(limit)
        rows = lines.join(page, "path").orderBy(*order, "line")
        found = rows.select("path", "line", "text", "def").collect()
        bodies = {r.path: r.lines for r in self.bodies_of({r.path for r in found} if context or name else set())}
        return [Match(r.path, r.line, r.text, r["def"], context, bodies.get(r.path, [])) for r in found]

    def bodies_of(self, paths: set[str]) -> list:
        """Lines of the files of a page."""
        if not paths:
            return []
        return self.engine.docs.filter(F.col("path").isin(sorted(paths))).select("path", F.split("body", "\n").alias("lines")).collect()

    def lines_text(self, rows: list, pattern: str, note: str, mode: str, limit: int, offset: int) -> str:
        """A page as text: files with their lines, the first two definitions with their bodies."""
        files = list(dict.fromkeys(r.path for r in rows))
        shown = files[:limit]
        out = [note] if note else []
        if mode == "files":
            out += map(self.show, shown)
        elif mode == "count":
            counts = Counter(r.path for r in rows)
            out += [f"{self.show(p)}: {counts[p]}{'+' if counts[p] >= COUNTED else ''}" for p in shown]
        else:
            bodies = 2
            for p in shown:
                out.append(self.show(p))
                own = {r.line: r for r in rows if r.path == p}
                last = 0
                for r in own.values():
                    if r.line <= last:
                        continue
                    for n in range(max(last + 1, r.line - r.context), r.line):
                        out.append(f"{n}-{clip(r.body[n - 1])}") if n <= len(r.body) else None
                    out.append(f"{r.line}:{clip(r.text, pattern)}")
                    last, after = r.line, r.context
                    if not after and r.defines and bodies and r.text.rstrip().endswith(("{", "\\", ":", "(", ",", ")")):
                        bodies, after = bodies - 1, BODY
                    for n in range(r.line + 1, min(r.line + after, len(r.body)) + 1):
                        if n in own or not r.context and not r.body[n - 1].strip():
                            break
                        out.append(f"{n}-{clip(r.body[n - 1])}")
                        last = n
        return "\n".join(out + ([f"cursor: {offset + limit}"] if len(files) > limit else []))


@dataclass(frozen=True)
class Match:
    path: str
    line: int
    text: str
    defines: bool
    context: int
    body: list[str]


def serve(tools: Tools, message: str) -> str | None:
    """A JSON-RPC message as its answer: initialize, ping, tools/list and tools/call; none for a notification. Batches are answered in one."""
    try:
        request = json.loads(message)
    except ValueError:
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}})
    if isinstance(request, list):
        answers = [a for r in request if (a := serve(tools, json.dumps(r)))]
        return f"[{', '.join(answers)}]" if answers else None
    known: dict[str, Callable[..., str]] = {"find_files": tools.find_files, "grep": tools.grep, "multi_grep": tools.multi_grep}
    number, method, params = request.get("id"), request.get("method"), request.get("params") or {}
    if number is None:
        return None
    reply: dict = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        reply["result"] = {"protocolVersion": params.get("protocolVersion", "2025-06-18"), "capabilities": {"tools": {}}, "serverInfo": {"name": "siftlake", "version": "1"}}
    elif method == "ping":
        reply["result"] = {}
    elif method == "tools/list":
        reply["result"] = {"tools": [{"name": n, "description": " ".join((f.__doc__ or "").split()), "inputSchema": {"type": "object"}} for n, f in known.items()]}
    elif method == "tools/call" and params.get("name") in known:
        try:
            text, failed = known[params["name"]](**params.get("arguments", {})), False
        except (ValueError, TypeError) as e:
            text, failed = str(e), True
        reply["result"] = {"content": [{"type": "text", "text": text}], "isError": failed}
    else:
        reply["error"] = {"code": -32601, "message": f"unknown method: {method}"}
    return json.dumps(reply)
