"""Eligibility, the segment index, typos that start by themselves, path words, tools, units and the feed, against small fixtures."""

import json
import time

import pytest
from pyspark.sql import functions as F

from siftlake.engine import Engine, Typing
from siftlake.operators import content, eligible, enrich, live, names
from siftlake.operators.ignore import rules_of
from siftlake.plans.parser import parse
from siftlake.sources import porcelain
from siftlake.sources.corpus import with_names
from siftlake.sources.segments import Segments
from siftlake.streaming import units
from siftlake.streaming.feed import Feed, flushes
from siftlake.tools import Tools, is_definition, json_lines, match_lines, path_lines, serve

HOME, NOW = "/h/u", 1_700_000_000


def tree(spark, paths, sizes=None, mtime=NOW - 10**8):
    """Entries of files (a path that ends in / is a folder), and every folder above one."""
    rows = {}
    for p in paths:
        path, kind = p.rstrip("/"), int(p.endswith("/"))
        rows[path] = (path, kind, (sizes or {}).get(path, 100 if not kind else 0), mtime)
        for i in range(2, path.count("/") + 1):
            up = "/".join(path.split("/")[:i])
            rows.setdefault(up, (up, 1, 0, mtime))
    df = spark.createDataFrame(list(rows.values()), "path string, kind int, size long, mtime long")
    return with_names(df).select("path", "parent", "name", "kind", "size", "mtime")


def test_wanted_documents(spark):
    paths = ["/h/u/a.txt", "/h/u/b.png", "/h/u/Makefile", "/h/u/node_modules/x.js", "/h/u/repo/.git/", "/h/u/repo/.git/config", "/h/u/repo/x.dat", "/h/u/repo/y.png",
             "/h/u/repo/node_modules/z.js", "/h/u/target/t.rs", "/h/u/build/CACHEDIR.TAG", "/h/u/build/b.rs", "/h/u/big.txt", "/h/u/repo/big.txt", "/h/u/repo/big.json", "/h/u/repo/yarn.lock",
             "/h/u/My.app/in.txt", "/h/u/go/pkg/m.go", "/h/u/skip/s.txt", "/h/u/repo/out/o.txt", "/h/u/x.bundle.js", "/other/o.txt", "/h/u/tree/.git", "/h/u/tree/t.txt"]
    big = {"/h/u/big.txt": 2 << 20, "/h/u/repo/big.txt": 2 << 20, "/h/u/repo/big.json": 2 << 20}
    rules = rules_of(spark, [("/h/u/repo", ".gitignore", "out/\n")])
    git = spark.createDataFrame([("/h/u/tree/.git", "gitdir: /h/u/repo/.git/worktrees/tree\n")], "path string, body string")
    e = tree(spark, paths, big)
    got = {r.path for r in eligible.wanted(e, HOME, rules, ["/h/u/skip"], worktrees=eligible.linked_worktrees(git)).collect()}
    assert got == {"/h/u/a.txt", "/h/u/Makefile", "/h/u/repo/x.dat", "/h/u/repo/node_modules/z.js", "/h/u/target/t.rs", "/h/u/repo/big.txt"}
    assert {r.path for r in eligible.wanted(e, HOME, rules, folder="/h/u", recursive=False).collect()} == {"/h/u/a.txt", "/h/u/Makefile"}
    repos = {r.path: r.repo for r in eligible.repository_of(e.filter("kind = 0").select("path"), e, HOME).collect()}
    assert repos["/h/u/repo/out/o.txt"] == "/h/u/repo" and repos["/h/u/a.txt"] is None
    changed = eligible.resynced(tree(spark, ["/h/u/repo/.gitignore", "/h/u/.ignore"]), tree(spark, ["/h/u/repo/.gitignore", "/h/u/.ignore"], {"/h/u/.ignore": 7}))
    assert [r.path for r in changed.collect()] == ["/h/u"]


def docs_of(spark, bodies):
    return spark.createDataFrame([(p, len(b.encode()), m, b) for p, m, b in bodies], "path string, size long, mtime long, body string")


def test_segment_index(spark, tmp_path):
    index = Segments(spark, f"file://{tmp_path}/index")
    first = docs_of(spark, [("/a", 5, "hello World\nfn main()"), ("/b", 6, "hello World\nfn main()"), ("/c", 7, "other ok"), ("/n", 1, "a\0b"), ("/e", 1, "")])
    assert {r.op for r in index.sync(first).collect()} == {"reindex"} and index.docs().count() == 5
    assert {r.path for r in index.grep("hello").collect()} == {"/a", "/b"} and sorted(r.n for r in index.references().collect()) == [1, 2]
    second = docs_of(spark, [("/a", 8, "bye World"), ("/b", 6, "hello World\nfn main()"), ("/n", 1, "a\0b"), ("/e", 1, "")])
    ops = {r.path: r.op for r in index.sync(second).collect()}
    assert ops == {"/a": "reindex", "/c": "drop"} and index.docs().count() == 4
    assert {r.path for r in index.grep("hello").collect()} == {"/b"} and not index.grep("other").collect() and index.dead_bodies().count() == 1
    fresh = docs_of(spark, [("/b", 9, "now different"), ("/z", 10, "hello there")])
    got = index.grep("hello", fresh=fresh).collect()
    assert [(r.path, r.fresh) for r in got] == [("/z", True)]
    assert [r.path for r in index.grep("World", fresh=fresh.limit(0)).collect()] == ["/a", "/b"]
    # Two letters, in the middle and at the very end of a body.
    assert {r.path for r in index.grep("ye").collect()} == {"/a"} and {r.path for r in index.grep("()").collect()} == {"/b"} and {r.path for r in index.grep("ld").collect()} == {"/a", "/b"}
    before = {(r.path, r.line, r.text) for r in index.grep("o").collect()}
    assert len(index.merge()) == 1 and {(r.path, r.line, r.text) for r in index.grep("o").collect()} == before and index.docs().count() == 4
    assert {r.path for r in index.grep("w.*ld", "regex").collect()} == {"/a", "/b"}


def test_path_words_and_overlay(spark):
    e = tree(spark, ["/h/u/server/parse.rs", "/h/u/parse/server.rs", "/h/u/server/deep/parse.rs", "/h/u/server/parse/other.rs"])
    got = {r.path: r.own for r in names.matched(e, parse("server/parse", HOME, NOW)).select("path", "own").collect()}
    plain = {r.path: r.own for r in names.matched(e, parse("server parse", HOME, NOW)).select("path", "own").collect()}
    fit = {p: got[p] - plain[p] for p in got}
    assert fit["/h/u/server/parse.rs"] == 30 and fit["/h/u/server/deep/parse.rs"] == 0 and fit["/h/u/parse/server.rs"] == -40
    dead = e.filter("path = '/h/u/server/parse.rs'")
    delta = tree(spark, ["/h/u/new/parse.rs"]).filter("path = '/h/u/new/parse.rs'")
    hits = [r.path for r in names.live_search(e, dead, delta, parse("parse.rs kind:file", HOME, NOW), NOW).collect()]
    assert "/h/u/server/parse.rs" not in hits and hits[-1] == "/h/u/new/parse.rs" or hits[0] == "/h/u/new/parse.rs"
    both = names.live_search(e.filter("name = 'other.rs'"), e.limit(0), tree(spark, ["/h/u/server/parse/other.rs.b"]).filter("kind = 0"), parse("other", HOME, NOW), NOW).collect()
    assert [r.path for r in both] == ["/h/u/server/parse/other.rs", "/h/u/server/parse/other.rs.b"]


def test_typos_start_by_themselves(spark):
    e = tree(spark, ["/h/u/customer.rs", "/h/u/RegionalCapabilitiesServiceFactory.java", "/h/u/c_x_u_s_t_o_m_e_r.txt"])
    find = lambda text: [r.path for r in Engine(e, home=HOME, now=NOW, typos=True).search(text).collect()]
    assert find("custmoer") == ["/h/u/customer.rs"] and find("vustomer")[0] == "/h/u/customer.rs"
    assert find("regcapserfac") == ["/h/u/RegionalCapabilitiesServiceFactory.java"]
    assert names.abbreviates("RegionalCapabilitiesServiceFactory", "regcapserfac") and not names.abbreviates("regional", "regi") and not names.abbreviates("ab_cd", "abc")
    assert names.well_found("customer.rs", "customer") and names.well_found("customer.rs", "custmoer") and not names.well_found("c_x_u_s_t_o_m_e_r.txt", "customer")


def test_lines_are_shown_by_bytes(spark):
    body = "é" * 300 + "\n" + "x" * 395 + "ééé\nshort  \t\nfn name(a)\nlet mut name = name;"
    d = docs_of(spark, [("/a", 1, body)])
    got = {r.line: r.text for r in content.grep(d, "(?iu)é|short").collect()}
    assert got[1] == "é" * 200 and got[2] == "x" * 395 + "éé�" and got[3] == "short"
    rows = spark.createDataFrame([("aéb aB ab",)], "text string").select(content.match_ranges(F.col("text"), "(?iu)ab").alias("r")).first().r
    assert [(x.first, x.end) for x in rows] == [(5, 7), (8, 10)]
    flags = [r.d for r in content.lines_of(d).select(content.defines(F.col("text"), "name").alias("d"), "line").orderBy("line").collect()]
    assert flags == [False, False, False, True, True]
    assert [r.line for r in content.in_file(d, "/a", "name").collect()] == [4, 5]


def test_usage_of_commits_and_runs(spark):
    day = 86_400
    commits = [("a", NOW - 14 * day, False, "/x"), ("a", NOW - 14 * day, False, "/y"), ("b", NOW, True, "/x"), ("c", NOW - 61 * day, False, "/x")] + [("d", NOW, False, f"/f{i}") for i in range(51)]
    got = {r.path: round(r.score, 6) for r in enrich.history(spark.createDataFrame(commits, "commit string, ts long, merge boolean, path string"), NOW).collect()}
    assert got == {"/x": 0.5, "/y": 0.5}
    opens = spark.createDataFrame([("/x", NOW), ("/x", NOW - 10), ("/x", NOW - 20), ("/x", NOW - 45), ("/x", NOW - 14 * day)], "path string, ts long")
    plain, last = 0.0, None
    for t in sorted(r.ts for r in opens.collect()):
        if last is None or t - last >= 30:
            plain, last = plain + 2 ** (-(NOW - t) / (14 * day)), t
    assert abs(enrich.frecency(opens, NOW).first().score - plain) < 1e-9
    many = spark.range(5000).select(F.concat(F.lit("/p"), "id").alias("path"), F.col("id").cast("double").alias("score"))
    assert enrich.trimmed_usage(many).count() == 3072 and enrich.trimmed_usage(many.limit(4096)).count() == 4096
    text = f"\0{NOW}\n\na.txt\nb.txt\n\0{NOW - 5}\n\nc.txt\n"
    rows = porcelain.commit_rows(spark.createDataFrame([("/r", text)], "repo string, text string")).collect()
    assert {(r.ts, r.path) for r in rows} == {(NOW, "/r/a.txt"), (NOW, "/r/b.txt"), (NOW - 5, "/r/c.txt")}


def test_status_of_repositories(spark):
    e = tree(spark, ["/h/u/repo/.git/config", "/h/u/repo/a.rs", "/h/u/repo/junk/b.rs", "/h/u/free.rs"])
    text = "1 .M N... 100644 100644 100644 a a a.rs\0? junk/\0" + "1 .A N... 100644 100644 100644 a a new.rs\0"
    listed = porcelain.status_rows(spark.createDataFrame([("/h/u/repo", text)], "repo string, text string"))
    paths = e.filter("kind = 0").select("path")
    got = {r.path: r.bits for r in enrich.status_in_repositories(paths, eligible.repository_of(paths, e, HOME), listed).collect()}
    assert got == {"/h/u/repo/.git/config": enrich.IGNORED, "/h/u/repo/a.rs": enrich.MODIFIED, "/h/u/repo/junk/b.rs": enrich.UNTRACKED, "/h/u/free.rs": None}
    assert {r.listed: r.bits for r in listed.collect()}["/h/u/repo/new.rs"] == 0
    assert {r.path for r in enrich.listed_with(listed, "untracked", e).collect()} == {"/h/u/repo/junk", "/h/u/repo/junk/b.rs"}
    assert {r.path for r in enrich.listed_with(listed, "modified", e).collect()} >= {"/h/u/repo/a.rs"}


@pytest.fixture(scope="module")
def tools(spark):
    bodies = [("/h/u/p/src/lib.rs", 9, "use crate::x;\npub fn prepare_upload(x: u8) {\n    body(x)\n}\n\nlast"), ("/h/u/p/tests/t.rs", 10, "prepare_upload(1);\nfn prepare_upload() {\n}"), ("/h/u/p/src/use.rs", 11, "use a::prepare_upload;"),
              ("/h/u/p/src/main.rs", 12, "alpha beta\nALPHA"), ("/h/u/p/out/gen.rs", 1, "generated")]
    d = docs_of(spark, bodies)
    e = tree(spark, [p for p, *_ in bodies])
    return Tools(Engine(e, d, home=HOME, now=NOW, ignored=e.filter("path LIKE '/h/u/p/out%'").select("path")), "/h/u/p")


def test_find_files_loosens_one_way_at_a_time(tools):
    assert tools.find_files("lib") == "src/lib.rs"
    assert tools.find_files("mian") == "0 files match 'mian'; as 'main':\nsrc/main.rs"
    assert tools.find_files("gen").startswith("0 matches outside ignored files; ignored:\nout/gen.rs")
    assert tools.find_files("lib zzzz") == "0 files match all of 'lib zzzz'; without 'zzzz':\nsrc/lib.rs"
    assert tools.find_files("prepare_upload").splitlines()[0] == "0 file names match 'prepare_upload'; files containing it:"
    assert tools.find_files("prepare_upload").splitlines()[1] == "src/lib.rs:2: pub fn prepare_upload(x: u8) {"
    assert tools.find_files("src/") == "src/" and tools.find_files("qqqq") == "0 files match 'qqqq' in /h/u/p"
    assert "cursor: 2" in tools.find_files("rs", limit=2) and tools.find_files("rs", limit=2, offset=9) == "no more files past cursor 9"


def test_grep_leads_with_definitions(tools):
    lines = tools.grep("prepare_upload").splitlines()
    assert lines[:4] == ["src/lib.rs", "2:pub fn prepare_upload(x: u8) {", "3-body(x)", "4-}"] and lines.index("tests/t.rs") < lines.index("src/use.rs")
    assert tools.grep("prepareUpload").startswith("0 matches for 'prepareUpload'; other spellings:\nsrc/lib.rs")
    assert tools.grep("alpha gamma") == "0 matches for 'alpha gamma'; for 'alpha':\nsrc/main.rs\n1:alpha beta\n2:ALPHA"
    assert tools.grep("main.rs body(x)").startswith("0 matches for 'body(x)' in the named file; everywhere:\nsrc/lib.rs")
    assert tools.grep("al.*ta", regex=False).startswith("0 matches for 'al.*ta' as text; as a regex:\nsrc/main.rs") and tools.grep("al.*ta").startswith("src/main.rs")
    assert tools.grep("alpha", mode="count") == "src/main.rs: 2" and tools.grep("beta", mode="files") == "src/main.rs" and tools.grep("ALPHA") == "src/main.rs\n2:ALPHA"
    assert tools.grep("main") == "0 matches for 'main' in /h/u/p; files named like it:\nsrc/main.rs"
    assert tools.grep("body(x)", context=1).splitlines() == ["src/lib.rs", "2-pub fn prepare_upload(x: u8) {", "3:body(x)", "4-}"]
    assert tools.multi_grep(["beta", "last"]).splitlines() == ["src/main.rs", "1:alpha beta", "src/lib.rs", "6:last"]


def test_messages_and_sinks(spark, tools):
    call = lambda **m: json.loads(serve(tools, json.dumps({"jsonrpc": "2.0", **m})))
    assert call(id=1, method="ping")["result"] == {} and serve(tools, json.dumps({"method": "initialized"})) is None
    assert [t["name"] for t in call(id=2, method="tools/list")["result"]["tools"]] == ["find_files", "grep", "multi_grep"]
    assert call(id=3, method="tools/call", params={"name": "find_files", "arguments": {"query": "lib"}})["result"]["content"][0]["text"] == "src/lib.rs"
    assert call(id=4, method="tools/call", params={"name": "find_files", "arguments": {"query": "kind:x"}})["result"]["isError"] and call(id=5, method="x")["error"]["code"] == -32601
    engine = tools.engine
    assert engine.answer("nope", id=7) == {"ok": False, "error": "unknown op: nope", "id": 7} and engine.answer("ping") == {"ok": True}
    page = engine.answer("search", text="rs kind:file limit:2")
    assert page["next"] == 2 and "next" not in engine.answer("search", text="rs kind:file limit:2", offset=4)
    rows = spark.createDataFrame([("/a", 3, "x")], "path string, line int, text string")
    assert [f(rows).first().value for f in (path_lines, match_lines, json_lines)] == ["/a", "/a:3: x", '{"path":"/a","line":3,"text":"x"}']
    lines = spark.createDataFrame([(x,) for x in ("struct page;", "struct page {", "int page(int a,", "  page(a);", "type page = Y;")], "text string")
    assert [r.d for r in lines.select(is_definition(F.col("text"), "page").alias("d")).collect()] == [False, True, True, False, True]


def test_units(spark):
    path = lambda p: spark.createDataFrame([(p,)], "p string").select(units.unit_of(F.col("p"), HOME, ["/h/u/t"]).alias("u")).first().u
    assert path("/a/b/node_modules/c/d") == "/a/b/node_modules" and path("/private/var/folders/zz/x") == "/private/var/folders" and path("/a/b/.git/x") is None
    assert path("/h/u/t/x/y") == "/h/u/t" and path("/h/u/.cache") == "/h/u/.cache" and path("/h/u/.cache/k/l") == "/h/u/.cache/k"
    events = [("u", f"d{i}", False, i, 100 + i) for i in range(5)] + [("w", f"d{i}", False, 50 + i, 100) for i in range(9)] + [("busy", "b", True, 7, t) for t in range(90, 112)]
    df = spark.createDataFrame(events, "unit string, dir string, recursive boolean, id long, ts long")
    got = units.folders_due(df, 112, collapse=8).collect()
    assert {(r.unit, r.dir, r.recursive, r.least) for r in got} == {("u", f"d{i}", False, 0) for i in range(5)} | {("w", "w", True, 50)}
    assert {r.unit for r in units.folders_due(df, 160, collapse=8).collect()} == {"u", "w", "busy"}
    listed = spark.createDataFrame([("hot", 100.0, 0.1), ("cold", 100.0, 0.001)], "dir string, at double, took double")
    asked = spark.createDataFrame([("hot", False, 5), ("cold", False, 6), ("hot", False, 0), ("new", False, 8)], "dir string, recursive boolean, id long")
    free, held = units.paced(asked, listed, 100.5)
    assert [r.id for r in held.collect()] == [5] and {r.id for r in free.collect()} == {6, 0, 8} and units.floor_of(held) == 5


def test_waiting_units_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [("u", "a", False, 3), ("u", "a", True, 2), ("u", "b", False, 9)]
    (source / "1.json").write_text("\n".join(json.dumps(dict(zip(("unit", "dir", "recursive", "id"), r))) for r in rows))
    stream = spark.readStream.schema("unit string, dir string, recursive boolean, id long").json(str(source))
    query = units.waiting_units(stream, quiet=1, oldest=5).writeStream.format("memory").queryName("flushed_units").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and not (got := spark.table("flushed_units").collect()):
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(map(tuple, got)) == [("u", "a", True, 2), ("u", "b", False, 2)]


def test_feed_takes_subtrees_and_keeps_its_watermark(spark, tmp_path):
    feed = Feed(f"file://{tmp_path}/feed", stream=1)
    schema = "id long, dir string, recursive boolean, path string, kind int, size long, mtime long, gone boolean, stream int"
    feed.apply(spark.createDataFrame([(1, "/a", False, "/a", 1, 0, 1, False, 1), (2, "/a", False, "/a/x", 0, 5, 1, False, 1), (3, "/a/s", False, "/a/s/y", 0, 6, 1, False, 1)], schema), 0)
    feed.apply(spark.createDataFrame([(4, "/", False, "/a", 1, 0, 1, True, 1)], schema), 1)
    assert feed.current(spark).count() == 0 and feed.saved_watermark(spark) == 4
    feed.apply(spark.createDataFrame([(90, "/b", False, "/b", 0, 1, 1, False, 0)], schema), 2)  # a straggler of another stream
    assert feed.saved_watermark(spark) == 4 and feed.current(spark).count() == 1
    again = Feed(f"file://{tmp_path}/feed", stream=1, floors={"held": 7})
    again.apply(spark.createDataFrame([(9, "/c", False, "/c/z", 0, 1, 1, False, 1)], schema), 3)
    assert again.saved_watermark(spark) == 6
    listing = spark.createDataFrame([("/c/w", 0, 2, 2)], "path string, kind int, size long, mtime long")
    again.list_folder("/c", listing, 4)
    now = {r.path for r in again.current(spark).collect()}
    assert now == {"/b", "/c/w"} and again.compact(spark, 0, 0, asked=True) and {r.path for r in again.current(spark).collect()} == now
    again.apply(spark.createDataFrame([(10, "/c", False, "/c/w", 0, 1, 1, True, 1)], schema), 5)
    assert {r.path for r in again.current(spark).collect()} == {"/b"}


def test_recovery_by_time(spark):
    e = tree(spark, ["/h/a/x", "/h/b/y"], mtime=100).withColumn("mtime", F.when(F.col("path").isin("/h/b", "/h/a/x"), 200).otherwise(F.col("mtime")))
    assert {r.path for r in live.changed_since(e, 150).collect()} == {"/h/b"} and {r.path for r in live.changed_since(e, 150, 150).collect()} == {"/h/b", "/h/a"}
    held = spark.createDataFrame([("/h/a/x", 100, 1), ("/h/b/y", 99, 100), ("/h/b/z", 1, 1)], "path string, size long, mtime long")
    assert {r.path for r in live.changed_documents(held, e, 150).collect()} == {"/h/a", "/h/b"}
    assert live.relist_in(None, 5) == 0 and live.relist_in(10, 20) == 290 and live.lost(3, False) == live.lost(0, True) == "relist" and live.lost(1, False) == "replay"


def test_flushes_by_runs(spark):
    times = [0, 1, 2, 10, 11, *range(100, 200, 2), 500, 500]
    df = spark.createDataFrame([("u", t) for t in times], "unit string, ts long")
    want, batch = [], None
    for t in sorted(times):
        if batch is None or t - batch[1] > 5 or t - batch[0] > 60:
            batch = [t, t, 0]
            want.append(batch)
        batch[1], batch[2] = t, batch[2] + 1
    assert sorted((r.first, r.last, r.n) for r in flushes(df, "unit").collect()) == [tuple(b) for b in want]


def test_commands_over_a_real_folder(spark, tmp_path, capsys):
    from siftlake import __main__ as cli

    root, folder = tmp_path / "root", f"file://{tmp_path}/index"
    (root / "src").mkdir(parents=True)
    (root / "src" / "main.rs").write_text("fn main() {\n}\n")
    (root / "notes.md").write_text("# Notes on spark\n")
    assert cli.main(["index", f"file://{root}", folder]) == 0 and capsys.readouterr().out.split()[-1] == "2"
    assert cli.main(["search", folder, "main"]) == 0 and capsys.readouterr().out.split() == [f"{root}/src/main.rs"]
    assert cli.main(["search", folder, "src", "kind:dir"]) == 0 and capsys.readouterr().out.split() == [f"{root}/src"]
    assert cli.main(["grep", folder, "notes"]) == 0 and capsys.readouterr().out.strip() == f"{root}/notes.md:1: # Notes on spark"
    assert cli.main(["status", folder]) == 0 and json.loads(capsys.readouterr().out)["files"] == 2
    assert cli.main(["search", folder, "kind:x"]) == 1 and cli.main(["version"]) == 0
    (root / "notes.md").unlink()
    assert cli.main(["index", f"file://{root}", folder]) == 0 and cli.main(["grep", folder, "notes"]) == 0
    assert "notes.md" not in capsys.readouterr().out


def test_hidden_entries_and_ops(spark):
    e = tree(spark, ["/h/u/a.txt", "/h/u/b.txt"]).withColumn("hidden", F.col("name") == "a.txt")
    got = {r.path: r.score for r in names.search(e, parse("kind:file", HOME, NOW), NOW).collect()}
    assert got["/h/u/b.txt"] - got["/h/u/a.txt"] == 8
    saved = []
    engine = Engine(e, home=HOME, now=NOW, save=lambda: saved.append(1), indexing=3)
    assert engine.answer("save") == {"ok": True, "saved": True} and saved == [1] and engine.answer("status")["indexing"] == 3
    assert engine.answer("open", path="/h/u/a.txt") == {"ok": True, "score": 1.0}
    assert engine.answer("open", path="/h/u/a.txt", id=4)["id"] == 4 and not engine.answer("search", text="size:..5")["ok"]


def test_typing_narrows(spark):
    e = tree(spark, ["/h/u/customer.rs", "/h/u/cousin.txt", "/h/u/c_u_s.md", "/h/u/other.md"])
    engine = Engine(e, home=HOME, now=NOW)
    typing = Typing(engine)
    for text in ("c", "cu", "cus", "cust", "cu", "cu ext:md", "cus ext:md", "'cus", "other"):
        assert [tuple(r) for r in typing.search(text).collect()] == [tuple(r) for r in engine.search(text).collect()], text
    assert Typing.narrows(parse("cu ext:md", HOME, NOW), parse("cus ext:md", HOME, NOW)) and not Typing.narrows(parse("cu", HOME, NOW), parse("cus ext:md", HOME, NOW))


def test_words_of_an_overlay(spark):
    """Three quarters of a folder's match for each word, the fifth and later ones too, where the base adds the same for all."""
    path = "/h/u/abcdefgh/zeta.md"
    e = tree(spark, [path]).filter("kind = 0")
    words = ["zeta", "ab", "abc", "abcd", "bcd", "bc"]
    q = parse(" ".join(words), HOME, NOW)
    own = names.fuzzy_score("zeta.md", "zeta")
    shares = [names.fuzzy_score("abcdefgh", w) for w in words[1:]]
    got = [names.matched(e, q, overlay=o).first().own for o in (True, False)]
    assert got == [own + sum(int(s * 3 / 4) for s in shares), own + sum(int(s * 3 / 4) for s in shares[:3]) + 2 * names.FLAT]


def test_feed_holds_and_starts(spark, tmp_path):
    """What is put off holds the watermark below it, a gap takes it back to its start, and a new feed starts from its snapshot's event."""
    schema = "id long, dir string, recursive boolean, path string, kind int, size long, mtime long, gone boolean, stream int"
    batch = lambda i, stream=1: spark.createDataFrame([(i, "/d", False, f"/d/{i}", 0, 1, 1, False, stream)], schema)
    feed = Feed(f"file://{tmp_path}/feed", watermark=40, stream=1, floors={"relist": 45})
    feed.apply(batch(60), 0)
    assert feed.watermark == 44
    feed.apply(batch(61), 1)
    assert feed.watermark == 44
    feed.floors.clear()
    feed.apply(batch(999, 0), 2)
    assert feed.watermark == 44
    feed.apply(batch(62), 3)
    assert feed.watermark == 62
    feed.gap = 50
    feed.apply(batch(70), 4)
    assert feed.watermark == 50 and Feed(f"file://{tmp_path}/feed").saved_watermark(spark) == 50
    assert Feed(f"file://{tmp_path}/other", watermark=9).saved_watermark(spark) == 9
