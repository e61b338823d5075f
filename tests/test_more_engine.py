import itertools
import re

import pytest
from pyspark.sql import functions as F

from siftlake.engine import Engine
from siftlake.operators import content, live
from siftlake.operators.ignore import ignored, rules_of
from siftlake.operators.names import deep_score, fewest_edits, search
from siftlake.plans import trigrams
from siftlake.plans.globs import GlobError, ignore_rule, request_regex
from siftlake.plans.parser import parse, spellings, split_request
from siftlake.sources import store

NOW = 1_706_745_600
ENTRIES = "path string, parent string, name string, kind int, size long, mtime long"


def tree(spark, paths):
    rows = {}
    for p in paths:
        parts = p.split("/")
        for i in range(2, len(parts) + 1):
            path = "/".join(parts[:i])
            rows[path] = (path, "/".join(parts[: i - 1]), parts[i - 1], 0 if i == len(parts) else 1, 10, NOW)
    return spark.createDataFrame(list(rows.values()), ENTRIES)


@pytest.mark.parametrize(
    ("glob", "hits", "misses"),
    [
        ("*.rs", ["/b/a.rs", "/b/c/a.RS"], ["/b/a.rsx", "/x/a.rs"]),
        ("src/**/*.rs", ["/b/src/a.rs", "/b/src/x/y/a.rs"], ["/b/x/src/a.rs"]),
        ("tests/", ["/b/tests", "/b/q/tests/x"], ["/b/tests2/x"]),
        ("/etc/*.conf", ["/etc/a.conf"], ["/b/etc/a.conf"]),
        ("{a,b}?[!0-9]", ["/b/axz", "/b/q/bxz"], ["/b/ax1", "/b/cxz"]),
        ("a\\*b", ["/b/a*b"], ["/b/axb"]),
    ],
)
def test_request_globs(glob, hits, misses):
    regex = request_regex(glob, "/b")
    assert all(re.search(regex, h) for h in hits) and not any(re.search(regex, m) for m in misses)


def test_open_globs():
    for glob in ("a[b", "{a,b"):
        with pytest.raises(GlobError):
            request_regex(glob, "/")


@pytest.mark.parametrize(
    ("line", "hits", "misses"),
    [
        ("*.log", ["a.log", "x/y/a.log"], ["a.logs", "a.LOG"]),
        ("/a", ["a"], ["x/a"]),
        ("a/b", ["a/b"], ["x/a/b"]),
        ("a/**", ["a/b", "a/b/c"], ["a"]),
        ("a/**/b", ["a/b", "a/x/y/b"], ["ab"]),
        ("**/b", ["b", "x/b"], ["xb"]),
        ("a**b", ["ab", "axb"], ["a/b"]),
        ("[!a-c]x", ["dx"], ["ax"]),
        ("a[", ["a["], ["a"]),
        ("{x,yy}.c", ["x.c", "q/yy.c"], ["z.c"]),
        ("\\#a", ["#a"], ["a"]),
    ],
)
def test_ignore_lines(line, hits, misses):
    regex, white, folder = ignore_rule(line)
    assert not white and not folder
    assert all(re.search(regex, h) for h in hits) and not any(re.search(regex, m) for m in misses)


def test_lines_that_are_no_rules():
    assert [ignore_rule(x) for x in ("", "# a", "[c-a]", "{a,{b}}", "{a", "a\\")] == [None] * 6
    assert ignore_rule("!a/")[1:] == (True, True)


def test_ignored_entries(spark):
    e = tree(spark, ["/r/a.log", "/r/keep.log", "/r/out/keep.log", "/r/sub/a.log", "/r/sub/b.txt", "/r/file/out"])
    rules = rules_of(spark, [("/r", ".gitignore", "*.log\n!keep.log\nout/\n"), ("/r/sub", ".gitignore", "!a.log\n"), ("/r/sub", ".ignore", "b.*\n")])
    assert sorted(r.path for r in ignored(e, rules).collect()) == ["/r/a.log", "/r/out", "/r/out/keep.log", "/r/sub/b.txt"]
    assert ignored(e, rules_of(spark, [])).count() == 0
    assert ignored(e.limit(0), rules).count() == 0


REGEXES = ["abc", "ab+c", "(foo|bar)baz", "colou?r", "x[12]yz", "a.c", "^start", "hello.*world", "(?:ab)?cde", "[a-z]{3}", "Kelvin", "(abc|d)", "\\bword\\b", "(one|two|three) (four|five)", "a{2,3}bc", "(?=abc)abcd"]


def test_plans_never_lose_a_match(spark):
    bodies = ["abc", "abbbc", "foobaz", "barbaz", "color", "colour", "x1yz", "axc", "start it", "hello big world", "abcde", "cde", "Kelvin", "KELVIN", "d", "a word.", "TWO five", "aabc", "abcd", "", "ab"]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "gid string, body string").cache()
    postings = content.trigrams(df).cache()
    planned = 0
    for regex in REGEXES:
        plan = trigrams.of_regex(regex)
        if plan is not None:
            planned += 1
            want = {r.gid for r in df.filter(F.col("body").rlike("(?iu)" + regex)).collect()}
            assert want <= {r.gid for r in content.planned(postings, plan).collect()}, regex
    assert planned >= 11
    assert trigrams.of_regex("(") is None and trigrams.of_regex("abc") == "abc"


def test_deep_typos():
    assert fewest_edits("customer", "customer", 2) is None
    assert fewest_edits("customer", "ucstomer", 2) == (1, 8)
    assert fewest_edits("customer", "kustomer", 2) == (1, 8)
    assert fewest_edits("customer", "custmr", 1) is None
    assert fewest_edits("hat_98", "hat_18", 2) is None
    assert deep_score("main window.rs", "windwo", 1) is not None
    assert deep_score("customer.vcf", "kusotmer", 2) == deep_score("customer.vcf", "kustomer", 2) - 60


def test_typos_in_search(spark):
    e = tree(spark, ["/u/customer.vcf", "/u/other.vcf"])
    find = lambda text, typos: [r.path for r in search(e, parse(text, "/u", NOW), NOW, typos=typos).collect()]
    assert find("custmoer", "none") == [] and find("custmoer", "one") == ["/u/customer.vcf"] and find("ucstomer", "deep") == ["/u/customer.vcf"]


def test_request_words():
    assert split_request("*.rs src/ !test/ parse config") == (["ext:rs"], ["src/", "!test/"], ["parse", "config"])
    assert {"prepare_upload", "PrepareUpload", "PREPARE-UPLOAD"} <= set(spellings("prepareUpload")) and spellings("one") == []


def test_merging():
    assert live.merge_plan([(1, 100, 0), (2, 100, 50)]) == [2]
    assert live.merge_plan([(i, 5, 0) for i in range(9)]) == list(range(8))
    assert live.merge_plan([(i, 20 << 20, 0) for i in range(9)]) == [] and live.merge_plan([]) == []


def test_engine(spark):
    e = tree(spark, ["/u/a/one.rs", "/u/a/two.rs", "/u/b/one.md"])
    docs = spark.createDataFrame([("/u/a/one.rs", 10, NOW, "fn main\nlicense"), ("/u/a/two.rs", 10, NOW - 5, "License"), ("/u/b/one.md", 10, NOW, "none")], "path string, size long, mtime long, body string")
    status = spark.createDataFrame([("/u/a/two.rs", 1, False)], "listed string, bits int, is_dir boolean")
    opens = spark.createDataFrame([("/u/b/one.md", NOW - 100)], "path string, ts long")
    postings = content.trigrams(content.contents(docs))
    for index in (None, postings):
        x = Engine(e, docs, status, home="/u", now=NOW, postings=index)
        assert [r.path for r in x.search("grep:license").orderBy("path").collect()] == ["/u/a/one.rs", "/u/a/two.rs"]
        assert [r.path for r in x.search("git:modified").collect()] == ["/u/a/two.rs"]
        assert [(r.path, r.line) for r in x.grep("license").collect()] == [("/u/a/one.rs", 2), ("/u/a/two.rs", 1)]
        pages = [[r.path for r in x.grep("license", limit=1, offset=k).collect()] for k in range(3)]
        assert pages == [["/u/a/one.rs"], ["/u/a/two.rs"], []]
    assert sorted(r.path for r in x.glob("*.rs", "/u").collect()) == ["/u/a/one.rs", "/u/a/two.rs"]
    used = Engine(e, docs, opens=opens, home="/u", now=NOW)
    assert used.search("one").first().path == "/u/b/one.md" and used.recent().first().score == 99
    assert x.counts() == {"files": 3, "folders": 3, "docs": 3}
    assert x.answer("search", text="kind:x")["ok"] is False and x.answer("nope")["ok"] is False
    assert len(x.answer("search", text="one")["hits"]) == 2
    assert [r.path for r in x.lookup("/U/A/one.rs").collect()] == ["/u/a/one.rs"]


def test_normal_forms(spark):
    e = tree(spark, ["/u/caf\u00e9.txt", "/u/cafe\u0301.txt"])
    x = Engine(e, home="/u", now=NOW)
    every = [r.path for r in x.search("caf\u00e9").collect()]
    assert len(every) == 2
    assert [[r.path for r in x.search("caf\u00e9 limit:1", offset=k).collect()] for k in range(3)] == [every[:1], every[1:], []]


def test_store(spark, tmp_path):
    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / "sub" / "a.txt").write_text("hello")
    got = store.crawl(spark, f"file://{tmp_path}/t", bodies=True).collect()
    assert [(r.name, r.size, r.body) for r in got] == [("a.txt", 5, "hello")] and got[0].path == f"{tmp_path}/t/sub/a.txt"
    e = tree(spark, ["/u/a/one.rs"])
    for event in (5, 9):
        store.save_snapshot(e, f"file://{tmp_path}/snap", event, 100 + event)
    back, event, synced = store.load_snapshot(spark, f"file://{tmp_path}/snap")
    assert (event, synced) == (9, 109) and back.count() == e.count()
    usage = spark.createDataFrame([("/a\tb", 1.5, 7), ('"q\nz', 2.0, 8)], "path string, score double, last long")
    store.write_usage(usage, f"file://{tmp_path}/usage")
    assert sorted(tuple(r) for r in store.read_usage(spark, f"file://{tmp_path}/usage").collect()) == sorted([("/a\tb", 1.5, 7), ('"q\nz', 2.0, 8)])
    assert store.skip_list("# x\n~/a/\n\n/b\n", "/u") == ["/u/a", "/b"]
    assert [r.path for r in e.filter(~store.blocked(F.col("path"), ["/u/a"])).collect()] == ["/u"]


def one_edit(text):
    """All that one edit makes of a text, digits untouched."""
    letters = "abc"
    for i in range(len(text) + 1):
        yield from (text[:i] + x + text[i:] for x in letters)
        if i < len(text) and not text[i].isdigit():
            yield text[:i] + text[i + 1 :]
            yield from (text[:i] + x + text[i + 1 :] for x in letters)
            if i and text[i - 1] != text[i] and not text[i - 1].isdigit():
                yield text[: i - 1] + text[i] + text[i - 1] + text[i + 1 :]


def test_one_edit_against_all_edits():
    for text in ("abca", "ab1c", "aab", "1b2"):
        near = {x for x in one_edit(text)}
        for word in map("".join, itertools.chain.from_iterable(itertools.product("ab1c", repeat=n) for n in range(6))):
            lengths = [len(x) for x in near if word.startswith(x)]
            want = None if word.startswith(text) or not lengths else (1, min(lengths))
            assert fewest_edits(word, text, 1) == want, (word, text)
