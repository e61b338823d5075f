"""Tests of what the third round found."""

import os
import random

from pyspark.sql import functions as F

from siftlake.operators import bits, content, enrich, live, names
from siftlake.sources.segments import Segments


def words_of(spark, n):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    rows = [(f"/d{i}", i, "\n".join(" ".join(rng.choices(words, k=9)) for _ in range(20))) for i in range(n)]
    return spark.createDataFrame([(p, len(b), i, b) for p, i, b in rows], "path string, size long, mtime long, body string")


def test_index_is_smaller_than_its_texts(spark, tmp_path):
    docs = words_of(spark, 400)
    index = Segments(spark, f"file://{tmp_path}/index")
    index.sync(docs)
    texts = docs.agg(F.sum("size")).first()[0]
    held = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "index" / "postings") for f in names)
    assert held < 2 * texts
    word = docs.first().body.split()[3]
    assert {r.path for r in index.grep(word, limit=1000).collect()} == {r.path for r in docs.filter(F.contains("body", F.lit(word))).collect()}


def test_rows_parted_by_a_bitmap(spark):
    df = spark.range(5000).select((F.col("id") % 2500).cast("string").alias("k"), "id")
    keys = spark.range(0, 2500, 7).select(F.col("id").cast("string").alias("k"))
    sure, maybe = bits.parted(df, keys, ["k"])
    assert sure.join(keys, "k").isEmpty() and sure.count() + maybe.count() == 5000 and maybe.count() < 1500
    for got, how in ((bits.only(df, keys, ["k"]), "left_semi"), (bits.without(df, keys, ["k"]), "left_anti")):
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in df.join(keys, "k", how).collect())
    assert bits.only(df, keys.limit(0), ["k"]).isEmpty() and bits.without(df, keys.limit(0), ["k"]).count() == 5000


def test_files_of_unknown_size_are_synced(spark):
    schema = "path string, size long, mtime long"
    wanted = spark.createDataFrame([("/new", None, 1), ("/same", None, 1), ("/other", None, 2)], schema)
    held = spark.createDataFrame([("/same", None, 1), ("/other", None, 1), ("/gone", None, 1)], schema)
    assert {r.path: r.op for r in live.sync_diff(wanted, held).collect()} == {"/new": "reindex", "/same": "keep", "/other": "reindex", "/gone": "drop"}


def test_grep_reads_files_without_a_held_body(spark, tmp_path):
    long = "Apache " * 900
    rows = [("/long", len(long), 1, long), ("/short", 6, 2, "Apache"), ("/nul", 8, 3, "Apache\0b"), ("/now", 2, 4, "ab")]
    docs = spark.createDataFrame(rows, "path string, size long, mtime long, body string")
    index = Segments(spark, f"file://{tmp_path}/index")
    index.sync(docs)
    assert [r.path for r in index.grep("Apache", limit=None).collect()] == ["/short"]
    fresh = docs.filter("path IN ('/now', '/nul')").withColumn("body", F.lit("Apache"))
    got = index.grep("Apache", fresh=fresh, limit=None, per_file=1, unheld=docs).collect()
    assert {(r.path, r.fresh) for r in got} == {("/long", False), ("/short", False), ("/nul", True), ("/now", True)}


def test_postings_of_some_keys(spark):
    rows = [("/a", "GNU General"), ("/b", "GNU General"), ("/c", "the gnu"), ("/d", None), ("/e", ""), ("/f", "\u017fu\u212aX Gene")]
    docs = spark.createDataFrame(rows, "path string, body string")
    keys = ["gnu", "nu ", "gen", "suk", "ene", "zzz"]
    whole = content.trigrams(content.contents(docs.filter("body IS NOT NULL"))).filter(F.col("key").isin(keys))
    some = content.postings_of(docs, keys)
    assert sorted((r.gid, r.key) for r in some.collect()) == sorted((r.gid, r.key) for r in whole.collect())
    assert "regexp_extract_all" not in some._jdf.queryExecution().toString()


def exploded(df):
    """Whether a plan explodes the folders above every path, not above every folder."""
    return "slice(split(path" in df._jdf.queryExecution().toString()


def test_status_cuts_folders_and_not_paths(spark):
    paths = spark.createDataFrame([("/a/b/c.rs",), ("/a/b/d.rs",), ("/a/e.rs",), ("/f.rs",), ("/a/b",)], "path string")
    listed = spark.createDataFrame([("/a", 32, True), ("/a/b", 64, True), ("/a/b/d.rs", 1, False), ("/a/e.rs/x", 2, False)], "listed string, bits int, is_dir boolean")
    got = enrich.status_of(paths, listed)
    assert {r.path: r.bits for r in got.collect()} == {"/a/b/c.rs": 64, "/a/b/d.rs": 1, "/a/e.rs": 32, "/f.rs": 0, "/a/b": 64} and not exploded(got)


def test_listed_state_cuts_folders_and_not_paths(spark):
    paths = spark.createDataFrame([("/a/b/c.rs",), ("/a/b/d.rs",), ("/a/e.rs",), ("/a/b",), ("/g/h.rs",)], "path string")
    listed = spark.createDataFrame([("/a/b", 32, True), ("/a/b/d.rs", 1, False), ("/g/h.rs", 32, False)], "listed string, bits int, is_dir boolean")
    got = enrich.listed_with(listed, "untracked", paths)
    assert sorted(r.path for r in got.collect()) == ["/a/b", "/a/b/c.rs", "/g/h.rs"] and not exploded(got)


def test_subtrees_cut_folders_and_not_paths(spark):
    entries = spark.createDataFrame([("/a",), ("/a/b",), ("/a/b/c",), ("/ab",), ("/d/e",)], "path string")
    got = live.with_subtrees(entries.filter("path = '/a/b' OR path = '/d/e'"), entries)
    assert sorted(r.path for r in got.collect()) == ["/a/b", "/a/b/c", "/d/e"] and not exploded(got)


def test_words_are_cut_where_edits_end():
    rng = random.Random(9)
    for _ in range(4000):
        text = "".join(rng.choice("abc1") for _ in range(rng.randint(5, 8)))
        word = "".join(rng.choice("abc1") for _ in range(rng.randint(0, 14)))
        assert names.fewest_edits(word, text, 2) == names.fewest_edits(word[: len(text) + 2], text, 2)
    names.fewest_edits.cache_clear()
    assert {names.deep_score(f"customer#{i:09d}.vcf", "ucstomer", 2) for i in range(500)} == {names.deep_score("customer#000000000.vcf", "ucstomer", 2)}
    assert names.fewest_edits.cache_info().currsize < 20
