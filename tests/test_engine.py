import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftlake.operators import content, enrich, live
from siftlake.operators.names import fuzzy_score, search, token_scores, typo_score
from siftlake.plans.ir import Token
from siftlake.plans.parser import QueryError, parse
from siftlake.queries import ORACLES, QUERIES
from siftlake.sources.porcelain import parse_status
from siftlake.streaming.feed import Feed

SF = "/root/testdata/sf0.001"
NOW = 1_706_745_600


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_oracle(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("nation", "customer", "part", "documents", "pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    assert set(got.columns) == set(want.columns)
    cols = sorted(got.columns)
    rows = lambda d: sorted((tuple(r) for r in d[cols].astype(object).where(d[cols].notna(), None).values.tolist()), key=repr)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_fuzzy_columns_agree_with_the_walk(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abAB12_-. ") for _ in range(rng.randint(1, 14))) for _ in range(400)})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for q in ("a", "ab", "ba1", "aab2"):
        got = {r[0]: r[1] for r in token_scores(df, Token(q)).collect()}
        assert got == {n: s for n in names if (s := fuzzy_score(n, q)) is not None}


def test_typos():
    assert typo_score("main.rs", "mian.rs", 30, 60) is not None
    assert typo_score("hat_98", "hat_18", 30, 60) is None


def test_parser():
    q = parse("ext:.rs,md !test/ 'exact ^pre suf$ !neg a/b", "/Users/u", NOW)
    assert q.exts == ["rs", "md"] and q.globs[0].negate
    assert [(t.text, t.mode, t.negate, t.under) for t in q.tokens] == [("exact", "exact", False, False), ("pre", "prefix", False, False), ("suf", "suffix", False, False), ("neg", "exact", True, False), ("a", "fuzzy", False, False), ("b", "fuzzy", False, True)]
    assert parse("mtime:>140y", "/", NOW).mtime == (0, 0)
    with pytest.raises(QueryError):
        parse("kind:x", "/", NOW)


def test_limit_over_two_files(spark):
    df = spark.createDataFrame([("/abc", "", "abc", 0, 0, 0), ("/abd", "", "abd", 0, 0, 0)], "path string, parent string, name string, kind int, size long, mtime long")
    assert search(df, parse("ab limit:1000000", "/Users/u", NOW), NOW).count() == 2


def test_lines_and_case(spark):
    docs = spark.createDataFrame([("/a", "foo\r\nbar\r\nfoo"), ("/b", "ÉMILE"), ("/c", "émile")], "path string, body string")
    assert [r.line for r in content.grep(docs, content.java_regex("foo$", "regex")).orderBy("line").collect()] == [1, 3]
    assert content.grep(docs, content.java_regex("émile")).count() == 2


def test_candidates_are_a_superset(spark):
    docs = spark.createDataFrame([(f"/{i}", f"alpha {i} Beta" if i % 3 else "gamma") for i in range(30)], "path string, body string")
    bodies = content.contents(docs)
    got = {r[0] for r in content.candidates(content.trigrams(bodies), content.literal_plan("Beta")).collect()}
    assert {r.gid for r in bodies.filter(F.contains("body", F.lit("Beta"))).collect()} <= got


def test_enrichment(spark):
    opens = spark.createDataFrame([("/a", NOW), ("/a", NOW + 10), ("/a", NOW + 1000)], "path string, ts long")
    assert abs(enrich.frecency(opens, NOW + 1000).first().score - 2) < 0.01
    rows = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (100.0,)], "s double").select(enrich.boost(F.col("s")).alias("b")).collect()
    assert [r.b for r in rows] == [0, 8, 21, 40]
    near = spark.createDataFrame([("/a/b/x",), ("/a/b/y",), ("/a/b/c/z",), ("/a/c/z",), ("/q/w/e/r/t",)], "path string").select(enrich.nearness(F.col("path"), "/a/b/x").alias("n")).collect()
    assert [r.n for r in near] == [-20, 12, 9, 6, 0]


def test_status():
    got = dict((p, b) for p, b, _ in parse_status("1 .M N... 100644 100644 100644 a b m\0? junk/\0! out\0"))
    assert got == {"m": enrich.MODIFIED, "junk": enrich.UNTRACKED, "out": enrich.IGNORED}


def test_policies():
    assert [live.advance(5, 100, None, None), live.advance(5, 100, 50, None), live.advance(90, 30, None, 40), live.advance(90, 30, None, None), live.advance(0, 100, 0, None)] == [100, 49, 40, 90, 0]
    assert [live.replay_delay(n) for n in (0, 1, 3, 5, 9)] == [2, 4, 16, 60, 60]
    assert live.should_compact(1, 10, 0, 0, asked=True) and live.should_compact(350_001, 10, 0, 0)
    assert live.should_compact(50_001, 10, 30, 0) and not live.should_compact(50_001, 10, 1, 0) and live.should_compact(125_001, 1_000_000, 30, 0)


def test_feed_is_idempotent(spark, tmp_path):
    feed = Feed(f"file://{tmp_path}/feed")
    schema = "id long, dir string, recursive boolean, path string, kind int, size long, mtime long, gone boolean"
    one = spark.createDataFrame([(1, "/d", False, "/d/a", 0, 1, 1, False), (2, "/d", True, "/d/b", 0, 1, 1, False)], schema)
    two = spark.createDataFrame([(3, "/d", False, "/d/a", 0, 1, 1, True)], schema)
    for number, batch in ((0, one), (1, two), (1, two)):
        feed.apply(batch, number)
    assert [r.path for r in feed.current(spark).collect()] == ["/d/b"] and feed.watermark == 3
