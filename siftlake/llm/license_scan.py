"""License scans by diagonal voting, with DataFrame functions only.

Every rolling hash of GRAM words of a text is joined to the places of the same hash in the templates (a fixed parameter of a few
hundred rows, broadcast). Hits are summed by offset diagonal (place in the text less place in the template), and each diagonal is
merged with its neighbours, those that a span of few enough edits can have. A merged span is verified by the edit distance of its
words to the notice's, of which the share that is no edit is its cover; of neighbouring spans the best one stays.

The table is scanned once: a marker takes each row's number, id and count of words through the same join.

Defined results: a null text counts as empty; an empty text has no words; repeated rows get a row each; ids may be null; an empty
table gives an empty result; extra columns, of whatever name, are ignored; ties of neighbouring spans go to the first one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import text_of, written

#: What stands between words, in text in which A-Z have been lowered.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The characters beyond ASCII whose lower case has ASCII letters: for texts without them, lower() does to words what lowering A-Z
#: does, as far as ASCII words go, and is much faster.
ODD = "[\u0130\u212a]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 2
#: Twins' spans that start no further apart than this many words stand in the same place.
DRIFT = 3
#: Share of a notice's words that its span must have without an edit.
COVER = 0.7
#: A gram's hash that marks rows, and the number that stands for its template.
MARKER, ROW = 0, -1


@dataclass(frozen=True)
class Template:
    """base: an exact phrase whose places are counted; else a notice that may differ by a few words."""

    label: str
    text: str
    base: bool = False


TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-notice", "licensed under the apache license version 2 0"),
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def twins(templates: Sequence[Template]) -> list[tuple[int, list[int]]]:
    """For each template a number that its twins share, and the places of the words that tell it from them.

    Twins are notices of one length that differ in so few words that a copy of one covers the other (CC BY-NC and CC BY-SA).
    """
    out = []
    for i, t in enumerate(templates):
        family, telling = i, set()
        for j, u in enumerate(templates):
            differ = [k for k, (a, b) in enumerate(zip(t.text.split(), u.text.split(), strict=False)) if a != b]
            n = len(t.text.split())
            if i != j and not t.base and not u.base and n == len(u.text.split()) and n - len(differ) >= COVER * n:
                family, telling = min(family, j), telling | set(differ)
        out.append((family, sorted(telling)))
    return out


def words_of(text: Column) -> Column:
    """The words, A-Z lowered. (Splitting at gaps takes a quarter of the time of extracting words.)"""
    lowered = F.when(text.rlike(ODD), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, GAP), "")


def template_table(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """A row for each template: t, label, base, twords, edits (how many a span may have), code, family, telling."""
    codes = vocabulary(templates)
    rows = []
    for i, (t, w) in enumerate(zip(templates, twins(templates), strict=True)):
        words = t.text.split()
        rows.append((i, t.label, t.base, words, 0 if t.base else int((1 - COVER) * len(words) + 1e-9), "".join(map(codes.__getitem__, words)), *w))
    return spark.createDataFrame(rows, "t int, label string, base boolean, twords array<string>, edits int, code string, family int, telling array<int>")


def vocabulary(templates: Sequence[Template]) -> dict[str, str]:
    """A character for each word of the templates, so that the edit distance of words is one of strings."""
    return {w: chr(0x100 + k) for k, w in enumerate(dict.fromkeys(w for t in templates for w in t.text.split()))}


def gram_hashes(words: Column) -> Column:
    """The hash of each word with the next one; none if there is a single word."""
    last = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), last), F.slice(words, F.lit(GRAM), last), lambda a, b: F.xxhash64(a, b))


def license_lines(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> row_no, t, diagonal, votes, w0, wide, written once.

    wide: the words beside the template on that diagonal and as many more at either end as a span may have edits, from word w0 on.
    For each row of docs there is also one line with the template ROW, and with doc_id and n_words.
    """
    marker = docs.sparkSession.createDataFrame([(ROW, 0, 0, 0, MARKER)], "t int, size int, edits int, tpos int, gram long")
    own = table.select("t", F.size("twords").alias("size"), "edits", F.posexplode(gram_hashes(F.col("twords"))).alias("tpos", "gram"))
    words = docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", words_of(F.col("text")).alias("words"))
    marked = F.concat(F.array(F.lit(MARKER).cast("long")), gram_hashes(F.col("words")))
    hits = words.select("row_no", "doc_id", "words", F.posexplode(marked).alias("pos", "gram")).join(F.broadcast(own.unionByName(marker)), "gram")
    row = F.col("t") == ROW
    hits = hits.filter(row == (F.col("pos") == 0))
    diagonal = F.when(row, 0).otherwise(F.col("pos") - 1 - F.col("tpos"))
    hits = hits.select("row_no", "t", "size", "edits", "words", diagonal.alias("diagonal"), F.when(row, F.col("doc_id")).alias("doc_id"), F.when(row, F.size("words").cast("long")).alias("n_words"))
    w0 = F.greatest(F.col("diagonal") - F.col("edits"), F.lit(0))
    wide = F.slice("words", w0 + 1, F.col("diagonal") + F.col("size") + F.col("edits") - w0)
    hits = hits.select("row_no", "t", "diagonal", "doc_id", "n_words", w0.alias("w0"), F.when(F.col("t") != ROW, wide).alias("wide"))
    lines = hits.groupBy("row_no", "t", "diagonal", "doc_id", "n_words", "w0").agg(F.count(F.lit(1)).alias("votes"), F.first("wide").alias("wide"))
    return written(lines, "diagonals")


def license_spans(lines: DataFrame, table: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """row_no, label, base, start, stop (words from 0), cover: every verified span of license_lines."""
    lines = lines.filter(F.col("t") != ROW).select("row_no", "t", "diagonal", "votes", "w0", "wide").join(F.broadcast(table), "t")
    # A phrase needs every vote of its diagonal; a notice is judged by the words of its merged span only.
    lines = lines.filter(~F.col("base") | (F.col("votes") >= F.size("twords") - GRAM + 1))
    # The words in place on this diagonal, by their place in the template.
    skipped = F.greatest(F.negative("diagonal"), F.lit(0))
    n = F.size("twords")
    same = F.zip_with(F.slice("wide", F.col("diagonal") + skipped - F.col("w0") + 1, n - skipped), F.slice("twords", skipped + 1, n), lambda a, b: a == b)
    hit_at = F.filter(F.transform(same, lambda x, i: F.when(x, i + skipped)), lambda i: i.isNotNull())
    lines = lines.withColumn("at", hit_at).filter(F.size("at") > 0)
    exact = lines.filter("base").filter(F.size("at") == n).select("row_no", "label", "base", F.col("diagonal").alias("start"), (F.col("diagonal") + n).alias("stop"), F.lit(1.0).alias("cover"))
    # A notice with a word more or less lies on neighbouring diagonals, no more than the edits allowed apart.
    most = max((int((1 - COVER) * len(t.text.split())) for t in templates if not t.base), default=0)
    near = Window.partitionBy("row_no", "t").orderBy("diagonal").rangeBetween(-most, most)
    one = F.struct("diagonal", "at", (F.col("diagonal") + F.array_min("at")).alias("start"), (F.col("diagonal") + F.array_max("at") + 1).alias("stop"))
    notices = lines.filter("NOT base").withColumn("near", F.collect_list(one).over(near))
    notices = notices.withColumn("near", F.filter("near", lambda x: F.abs(x["diagonal"] - F.col("diagonal")) <= F.col("edits")))
    notices = notices.withColumn("places", F.array_distinct(F.flatten(F.transform("near", lambda x: x["at"])))).filter(F.size("places") >= n - F.col("edits"))
    # Of all spans from a neighbour's first word to a neighbour's last one, that of the fewest edits.
    codes = F.create_map(*[F.lit(x) for pair in vocabulary(templates).items() for x in pair])
    notices = notices.withColumn("seen", F.array_join(F.transform("wide", lambda w: F.coalesce(F.try_element_at(codes, w), F.lit("."))), ""))
    span = lambda a, b: F.substring(F.col("seen"), a["start"] - F.col("w0") + 1, b["stop"] - a["start"])
    tried = lambda a, b: F.struct(F.levenshtein(span(a, b), F.col("code")).alias("d"), a["start"].alias("start"), b["stop"].alias("stop"))
    fits = lambda x: (x["start"] >= F.col("w0")) & (x["start"] < x["stop"]) & (x["stop"] <= F.col("w0") + F.size("wide"))
    every = F.flatten(F.transform("near", lambda a: F.transform("near", lambda b: tried(a, b))))
    notices = notices.withColumn("best", F.array_min(F.filter(every, fits))).filter(F.col("best.d") <= F.col("edits"))
    first = Window.partitionBy("row_no", "t").orderBy("diagonal").rangeBetween(-most, most)
    rank = F.struct("best.d", "diagonal")
    notices = notices.withColumn("rank", rank).withColumn("least", F.min("rank").over(first)).filter(F.col("rank") == F.col("least"))
    notices = notices.select("row_no", "label", "base", "family", "telling", "places", F.col("best.start").alias("start"), F.col("best.stop").alias("stop"), ((n - F.col("best.d")) / n).alias("cover"))
    # A span without a word that tells its notice from a twin gives way to one of the twin that has such a word, in the same place.
    beside = Window.partitionBy("row_no", "family").orderBy("start").rangeBetween(-DRIFT, DRIFT)
    told = F.arrays_overlap("places", "telling")
    notices = notices.withColumn("told", told).withColumn("rival", F.max("told").over(beside)).filter((F.size("telling") == 0) | F.col("told") | ~F.col("rival"))
    return exact.unionByName(notices.select("row_no", "label", "base", "start", "stop", "cover"))


def license_scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts and places of base phrases, labels, and a score."""
    table = template_table(docs.sparkSession, templates)
    lines = license_lines(docs.select("doc_id", text_of().alias("text")), table)
    spans = license_spans(lines, table, templates)
    at = F.when(F.col("base"), F.col("start"))
    found = spans.groupBy("row_no").agg(
        F.count(at).alias("n_base"),
        F.min(at).cast("long").alias("first_word"),
        F.max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    out = lines.filter(F.col("t") == ROW).select("row_no", "doc_id", "n_words").join(found, "row_no", "left")
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.withColumns({k: F.coalesce(F.col(k), v) for k, v in none.items()}).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
