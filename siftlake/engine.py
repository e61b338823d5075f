"""One object over entries, bodies, status and usage: search, glob, grep, recent, status."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import content, eligible, enrich, names
from .plans import trigrams
from .plans.globs import GlobError, narrowing, request_regex
from .plans.ir import Query
from .plans.parser import QueryError, parse

#: So many of the best hits are put in order again by usage and nearness.
RERANKED = 256


@dataclass
class Engine:
    """entries (path, parent, name, kind, size, mtime); docs (path, size, mtime, body); status (listed, bits, is_dir); opens (path, ts)."""

    entries: DataFrame
    docs: DataFrame | None = None
    status: DataFrame | None = None
    opens: DataFrame | None = None
    home: str = "/"
    now: int = 0
    near: str | None = None
    postings: DataFrame | None = None
    #: Own commits (commit, ts, merge, path), which count as usage; paths that ignore files leave out; repositories' folders (path).
    commits: DataFrame | None = None
    ignored: DataFrame | None = None
    repos: DataFrame | None = None
    #: Whether words may have a typo, and deeper ones where that finds nothing good.
    typos: bool = True
    #: How many documents the content index doesn't hold yet; and what writes all that is held in memory, for the op save.
    indexing: int = 0
    save: Callable[[], object] | None = None

    def search(self, text: str, offset: int = 0, hide_ignored: bool = False) -> DataFrame:
        """Ranked entries with every filter of the query applied, those on status and content too."""
        queries = [self.parsed(t) for t in forms(text)]
        if hide_ignored and self.ignored is not None:
            return replace(self, entries=self.entries.join(self.ignored, "path", "left_anti"), ignored=None).search(text, offset)
        if len(queries) == 1:
            return self.ranked(queries[0], offset)
        # Each form gives all that a page of the merged order may need; the page is cut after.
        limit = queries[0].limit
        found = [self.ranked(replace(q, limit=limit + offset), 0) for q in queries]
        columns = ["kind", "size", "mtime"]
        merged = reduce(DataFrame.unionByName, found).groupBy("path").agg(*[F.first(c).alias(c) for c in columns], F.max("score").alias("score"))
        return merged.orderBy(F.desc("score"), (F.col("kind") != 0).asc(), "path").offset(offset).limit(limit)

    def parsed(self, text: str) -> Query:
        return parse(text, self.home, self.now)

    def ranked(self, q: Query, offset: int) -> DataFrame:
        found = self.entries
        if q.git or q.grep:
            # What the query's other filters leave out needs no status and no text.
            found = found.filter(names.predicate(q))
            if len(own := [t for t in q.tokens if not t.negate]) == 1:
                found = found.filter(names.holds(F.col("name"), own[0])) if own[0].mode in ("prefix", "suffix", "exact") else found
        if q.git:
            found = self.with_status(found, q.git)
        if q.grep:
            found = found.join(self.holding_text(q.grep, q.grep_mode), "path", "left_semi")
        find = names.search_deep if self.typos else names.search
        if self.opens is None and self.near is None:
            return find(found, q, self.now, offset)
        wide = replace(q, limit=max(RERANKED, q.limit + offset))
        return self.reranked(find(found, wide, self.now), q.limit, offset)

    def named(self, hits: DataFrame) -> DataFrame:
        """Hits as they are shown: kinds by name, and the word of their status."""
        kind = F.when(F.col("kind") == 0, "file").when(F.col("kind") == 1, "dir").otherwise("link").alias("kind")
        if self.status is None:
            return hits.select("path", kind, "size", "mtime", "score", F.lit(None).cast("string").alias("git"))
        bits = enrich.status_of(hits.select("path"), self.status)
        if self.repos is not None:
            bits = enrich.status_in_repositories(hits.select("path"), eligible.repository_of(hits.select("path"), self.entries, self.home), self.status)
        return hits.join(bits, "path").select("path", kind, "size", "mtime", "score", enrich.word(F.col("bits")).alias("git"))

    def listed(self, selector: str) -> DataFrame:
        """Entries of a listed state, from the status listing on."""
        return enrich.listed_with(self.status, selector, self.entries)

    def reranked(self, hits: DataFrame, limit: int, offset: int) -> DataFrame:
        lift = F.lit(0)
        if self.opens is not None:
            hits = hits.join(enrich.worked_on(self.opens, self.commits, self.now).withColumnRenamed("score", "used"), "path", "left")
            lift = lift + F.coalesce(enrich.boost(F.col("used")), F.lit(0))
        if self.near is not None:
            lift = lift + enrich.nearness(F.col("path"), self.near)
        out = hits.withColumn("lifted", (F.col("score") + lift).cast("int"))
        order = [F.desc("lifted"), F.desc("score"), (F.col("kind") != 0).asc(), F.split("path", "/").asc()]
        return out.orderBy(*order).offset(offset).limit(limit).select("path", "kind", "size", "mtime", F.col("lifted").alias("score"))

    def with_status(self, entries: DataFrame, selectors: list[str]) -> DataFrame:
        """Entries whose status every selector takes; ! turns one round."""
        if self.status is None:
            return entries.filter(F.lit(False))
        bits = enrich.status_of(entries.select("path"), self.status)
        hits = [~enrich.selected(F.col("bits"), s[1:]) if s.startswith("!") else enrich.selected(F.col("bits"), s) for s in selectors]
        return entries.join(bits.filter(reduce(lambda a, b: a & b, hits)).select("path"), "path", "left_semi")

    def holding_text(self, pattern: str, mode: str) -> DataFrame:
        """path of the docs with a line that matches; only bodies that match as a whole are cut into lines."""
        regex = content.java_regex(pattern, mode)
        docs = self.likely(regex).filter(F.col("body").rlike("(?m)" + regex))
        return content.lines_of(docs).filter(F.col("text").rlike(regex)).select("path").distinct()

    def likely(self, regex: str) -> DataFrame:
        plan = trigrams.of_regex(regex) if self.postings is not None else None
        if plan is None:
            return self.docs
        gids = content.planned(self.postings, plan)
        return self.docs.withColumn("gid", F.sha2("body", 256)).join(gids, "gid", "left_semi").drop("gid")

    def matches(self, regex: str, q: Query, per_file: int = content.PER_FILE) -> tuple[DataFrame, DataFrame]:
        """(lines, files) of the files that a name query lets through: matching lines, and path, mtime, rank of those that have one."""
        parts = F.split("path", "/")
        docs = self.likely(regex).withColumns({"name": F.element_at(parts, -1), "kind": F.lit(0)}).filter(names.predicate(q))
        for t in q.tokens:
            if not t.negate:
                docs = docs.filter(names.any_part(F.col("path"), t))
        if q.git:
            docs = self.with_status(docs, q.git)
        lines = content.grep(docs, regex, per_file)
        files = docs.select("path", "mtime").join(lines.select("path").distinct(), "path", "left_semi")
        return lines, files.withColumn("rank", content.doc_rank(F.col("path")))

    def grep(self, pattern: str, mode: str = "literal", where: str = "", per_file: int = content.PER_FILE, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Lines of matching files that the name query `where` lets through; files in order of rank, then newest, then path."""
        q = self.parsed(where)
        lines, files = self.matches(content.java_regex(pattern, mode), q, per_file)
        page = files.orderBy(F.desc("rank"), F.desc("mtime"), "path").offset(offset).limit(q.limit if limit is None else limit)
        return lines.join(page, "path").orderBy(F.desc("rank"), F.desc("mtime"), "path", "line").select("path", "line", "text", "col")

    def glob(self, pattern: str, base: str = "/", ignored: DataFrame | None = None) -> DataFrame:
        """Entries whose path a glob matches, those of a table of ignored paths left out."""
        start, exts = narrowing(pattern, base)
        likely = self.entries.filter(names.folded(F.col("path")).startswith(start)) if start.isascii() else self.entries
        if exts:
            likely = likely.filter(names.ext_is(F.col("name"), exts))
        hits = likely.filter(F.col("path").rlike(request_regex(pattern, base)))
        return hits if ignored is None else hits.join(ignored, "path", "left_anti")

    def recent(self, where: str = "") -> DataFrame:
        """path, score: what was opened lately and passes a query, score times 100."""
        q = self.parsed(where)
        kept = self.entries.filter(names.predicate(q))
        used = enrich.worked_on(self.opens, self.commits, self.now)
        hits = kept.join(used, "path").select("path", F.floor(F.col("score") * 100).cast("long").alias("score"))
        return hits.orderBy(F.desc("score"), "path").limit(q.limit)

    def opened(self, path: str) -> Engine:
        """This engine once a path has been opened now."""
        one = self.entries.sparkSession.createDataFrame([(path, self.now)], "path string, ts long")
        return replace(self, opens=one if self.opens is None else self.opens.select("path", F.col("ts").cast("long").alias("ts")).unionByName(one))

    def list_folder(self, folder: str) -> DataFrame:
        return self.entries.filter(F.col("parent") == folder.rstrip("/"))

    def lookup(self, path: str) -> DataFrame:
        """The entry of a path; if there is none, those that differ in the case of A-Z only."""
        same = self.entries.filter(F.col("path") == path)
        low = path.translate({c: c + 32 for c in range(65, 91)})
        return same if same.head(1) else self.entries.filter(names.folded(F.col("path")) == low)

    def holding(self, name: str) -> DataFrame:
        """Folders that hold a file of a name."""
        return self.entries.filter((F.col("kind") == 0) & (F.col("name") == name)).select(F.col("parent").alias("path")).distinct()

    def counts(self) -> dict[str, int]:
        """Entries by kind, and bodies."""
        by_kind = {r.kind: r.n for r in self.entries.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {"files": by_kind.get(0, 0), "folders": by_kind.get(1, 0), "docs": self.docs.count() if self.docs is not None else 0}

    def grep_file(self, path: str, pattern: str, mode: str = "literal") -> DataFrame:
        """The lines of one file that match, whatever kind of file it is."""
        return content.in_file(self.docs, path, content.java_regex(pattern, mode))

    def answer(self, op: str, id: int | None = None, **args: object) -> dict:  # noqa: A002
        """A request as a reply: rows or an error, never an exception of a query that can't be read; ids come back as they were sent.

        Pages tell where the next one starts, if there is one.
        """
        ops: dict[str, Callable[..., DataFrame]] = {"search": self.search, "grep": self.grep, "glob": self.glob, "recent": self.recent, "list": self.list_folder, "git": self.listed}
        tag = {} if id is None else {"id": id}
        try:
            if op == "ping":
                return {"ok": True, **tag}
            if op == "status":
                return {"ok": True, **self.counts(), "indexing": self.indexing, **tag}
            if op == "save":
                return {"ok": True, "saved": self.save is not None and bool(self.save() or True), **tag}
            if op == "open":
                return {"ok": True, "score": float(enrich.frecency(self.opened(str(args["path"])).opens.filter(F.col("path") == args["path"]), self.now).first().score), **tag}
            if op not in ops:
                raise QueryError(f"unknown op: {op}")
            reply = {"ok": True, "hits": [r.asDict() for r in ops[op](**args).collect()], **tag}
            if op == "grep" and self.indexing:
                reply["indexing"] = self.indexing
            limit = self.parsed(str(args.get("text", ""))).limit if op == "search" else args.get("limit") if op == "grep" else None
            offset = int(args.get("offset", 0) or 0)
            shown = len({h["path"] for h in reply["hits"]})
            if limit and shown == limit and ops[op](**{**args, "offset": offset + shown}).head(1):
                reply["next"] = offset + shown
            return reply
        except (QueryError, GlobError, ValueError, TypeError) as e:
            return {"ok": False, "error": str(e), **tag}


@dataclass
class Typing:
    """Searches of one word as it is typed: as long as a word only gets longer, names that the shorter one left out aren't scored again."""

    engine: Engine
    last: tuple[Query, DataFrame] | None = None

    def search(self, text: str) -> DataFrame:
        q = self.engine.parsed(text)
        tokens = [t for t in q.tokens if not t.negate]
        if self.engine.typos or len(tokens) != 1 or tokens[0].mode != "fuzzy" or len(forms(text)) > 1:
            return self.engine.search(text)
        entries, token = self.engine.entries, tokens[0]
        if self.last and self.narrows(self.last[0], q):
            entries = entries.join(self.last[1], "name", "left_semi")
        kept = names.fuzzy(entries.filter(names.predicate(q)).select("name").distinct(), token.text).select("name").cache()
        if self.last:
            kept.count()  # before what it was made from is let go
            self.last[1].unpersist()
        self.last = q, kept
        return replace(self.engine, entries=self.engine.entries.join(kept, "name", "left_semi")).ranked(q, 0)

    @staticmethod
    def narrows(old: Query, new: Query) -> bool:
        """Whether all names that a query matches are matched by an older one: the same but for a word that starts with the old one."""
        words = [[t.text for t in q.tokens if not t.negate] for q in (old, new)]
        same = [replace(q, tokens=[t for t in q.tokens if t.negate], limit=0) for q in (old, new)]
        return same[0] == same[1] and words[1][0].startswith(words[0][0])


def forms(text: str) -> list[str]:
    """A query in its own normal form and, where letters outside ASCII differ in it, the other."""
    if text.isascii():
        return [text]
    return list(dict.fromkeys([text, unicodedata.normalize("NFC", text), unicodedata.normalize("NFD", text)]))
