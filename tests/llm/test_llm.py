import hashlib
import pathlib
import re
import tracemalloc
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.llm import html_extract, langid, license_scan, near_dedup, packing, quality, token_output
from siftlake.llm.common import drop_written, hot_keys, skew_join, table
from siftlake.llm.components import connected_components
from siftlake.llm.exact_dedup import exact_dedup, exact_groups
from siftlake.llm.fingerprint import composed, fingerprints, folded, with_next_text
from siftlake.llm.sentencepiece_scan import CHUNK, encode_and_decode, encode_whole, pieces, product, traced_states
from siftlake.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "A b\tc"), (4, "a B c"), (5, "\u00e9t\u00e9 " * 5), (6, "e\u0301te\u0301 " * 5), (7, "word " * 30_000), (8, "A b  c"), (8, "A b  c"), (None, "MIT License mit license")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1.5) for i, t in ODD], "doc_id long, text string, score double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_exact_against_brute_force(spark, odd, empty):
    norm = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", " ", t or "")
    got = exact_groups(odd).collect()
    sizes = Counter(norm(t) for _, t in ODD)
    assert len(got) == len(ODD) and sum(r.kept for r in got) == len(sizes)
    assert Counter(r.group_size for r in got) == Counter(sizes[norm(t)] for _, t in ODD)
    assert {r.text_sha256 for r in got} == {hashlib.sha256(norm(t).encode()).hexdigest() for _, t in ODD}
    assert exact_dedup(odd).count() == len(sizes)
    assert exact_groups(empty).count() == 0 and exact_dedup(empty).count() == 0


def test_skew_join_is_a_join(spark):
    left = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), "id")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").filter("k <> 4")
    for how in ("inner", "left", "left_semi"):
        for hot in ([], hot_keys(right, "k", "n", 200_000), hot_keys(right, "k", "n", 1000)):
            got = skew_join(left, right, "k", hot, how)
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)


def test_few_rows_make_no_key_hot(spark):
    """Every hot key is a literal in the driver's plans: a small table has none but those with many rows."""
    counted = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") == 7, 900).otherwise(3).alias("n"))
    assert hot_keys(counted, "k", "n", 2000) == [counted.filter("k = 7").select(F.xxhash64("k")).first()[0]]
    assert hot_keys(counted, "k", "n", 1_000_000) == []


def test_components_of_hubs_and_chains(spark):
    links = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(300)}, **{1000 + i: 1000 for i in range(61)}, 5000: 5000, 5001: 5000}


def test_near_against_brute_force(spark, odd, empty):
    docs = table(spark, SF, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    bags = [near_dedup.bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.overlap(bags[i], bags[j]) >= near_dedup.SIMILARITY:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}
    assert near_dedup.near_duplicates(odd).count() == len(ODD) and near_dedup.near_duplicates(empty).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    shingle = near_dedup.mix(np.arange(1, 401, dtype=np.uint64))
    wa, wb = rng.integers(1, 6, 400), rng.integers(1, 6, 400)
    with np.errstate(over="ignore"):
        same = [near_dedup.signatures(np.repeat([0, 1], 400), np.tile(shingle + np.uint64(k * 7919), 2), np.concatenate([wa, wb]), 2) for k in range(20)]
    got = np.mean([np.mean(s[0] == s[1]) for s in same])
    assert abs(got - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.05


def test_fingerprints_against_brute_force(spark, odd, empty):
    rows = [(r.doc_id, r.text or "") for r in table(spark, SF, "documents").collect()]
    rows.sort(reverse=True)
    canon = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFC", t).casefold()).strip()
    got = {r.doc_id: r for r in fingerprints(table(spark, SF, "documents")).collect()}
    for k, (i, t) in enumerate(rows):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + rows[(k + 1) % len(rows)][1][:cut]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert (got[i].near_edited == 1) == (canon(t) == canon(edited))
    assert len({r.fingerprint for r in got.values()}) == len({canon(t) for _, t in rows})
    by_id = {r.doc_id: r.fingerprint for r in fingerprints(odd).collect()}
    assert by_id[5] == by_id[6] and by_id[1] == by_id[2] and by_id[3] == by_id[4] == by_id[8]
    assert fingerprints(empty).count() == 0
    one = fingerprints(odd.filter("doc_id = 3")).first()
    assert one.edited_sha256 == hashlib.sha256(b"A b\tA").hexdigest() and one.near_next == 1


def test_next_texts_with_outliers_and_repeats(spark):
    """Ids far apart and one id of a third of all rows: buckets stay small, and every row has the one after it in some order of ties."""
    ids = [*range(2000), 1 << 50, -(1 << 62), None, *[77] * 1000]
    df = spark.createDataFrame([(i, f"t{k}", "x") for k, i in enumerate(ids)], "doc_id long, text string, bucket string")
    placed = with_next_text(df.select("doc_id", "text"))
    rows = placed.collect()
    sizes = Counter(r.bucket for r in rows)
    assert len(rows) == len(ids) and max(sizes.values()) < len(ids) / 6 and len(sizes) > 16
    assert Counter(r.doc_id for r in rows if r.next_text is not None)[77] > 950
    got = {r.doc_id: r for r in fingerprints(df).collect() if r.doc_id != 77}
    texts = {i: f"t{k}" for k, i in enumerate(ids)}
    order = [1 << 50, *range(1999, 77, -1)]
    for a, b in [*zip(order, order[1:])][:-1] + [(0, -(1 << 62)), (-(1 << 62), None), (None, 1 << 50)]:
        cut = len(texts[a]) // 3
        assert got[a].edited_sha256 == hashlib.sha256((texts[a][: len(texts[a]) - cut] + texts[b][:cut]).encode()).hexdigest()


def test_folding_is_full_case_folding(spark):
    chars = [chr(c) for c in range(0x20, 0x1F000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = ["".join(chars[k : k + 64]) for k in range(0, len(chars), 64)] + ["Straße STRASSE", "ΟΔΟΣ οδος ς", "İstanbul ı I", "ŉ ǰ ﬁ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("c", folded(F.col("text"))).collect()
    # Cherokee alone folds to capitals by the standard, to small letters here: the same letters are equal.
    cherokee = {c: chr(c).lower() for c in range(0x13A0, 0x13F6)}
    assert [r.text for r in rows if r.c != r.text.casefold().translate(cherokee)] == []


def test_composed_is_normal_form_c(spark):
    nfd = lambda t: unicodedata.normalize("NFD", t)
    changed = "".join(c for c in map(chr, range(0x30000)) if not "\ud800" <= c <= "\udfff" and unicodedata.normalize("NFC", c) != c)
    letters = " ".join(c for c in map(chr, range(0x30000)) if not "\uac00" <= c <= "\udfff" and nfd(c) != c)
    texts = ["", "plain", "\u212b \u2126 \uf900", changed, letters, nfd(letters), nfd("\ud55c\uad6d\uc5b4 \uac00\uac01"), "\uac00\u11a8\u11a8 \u1100\u1161\u0301\u11a8 \u1161", "a\u0327\u0301", "\u00e1\u0327",
             "a\u0301\u0327", "\u0301\u0327x", "q\u0307\u0323\u0301", "a\u0315\u0300\u05ae\u0300\u0062", "\u09c7\u09be \u09c7\u0301\u09be", "".join(map(chr, range(0xAC00, 0xAC40))), "a\n" + "e\u0301" * 9]
    rng = np.random.default_rng(3)
    pool = list("aeoAqc \n\u00e1\u01d5\u0327\u0301\u0308\u0323\u0345\u09c7\u09be\u1100\u1161\u11a8\uac00\u212b\u0344\u0958\U0001d15e\U0001d165\U0001d16e")
    texts += ["".join(rng.choice(pool, 30)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("c", composed(F.col("text")))
    for r in df.collect():
        assert r.c == unicodedata.normalize("NFC", r.text), r.text


def test_licenses_against_brute_force(spark, odd, empty):
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in license_scan.license_scan(docs).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]))
        at = [(i, k) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({k for _, k in at})) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
    got = {r.doc_id: r for r in license_scan.license_scan(odd).collect()}
    assert got[None].n_base == 2 and got[None].last_word == 2 and got[1].n_words == 0
    assert license_scan.license_scan(empty).count() == 0


def test_license_notices_with_a_word_more(spark):
    texts = ["Licensed under the CC BY-NC 4.0", "This work by Jane Doe is licensed under the GNU General Public License, version 3", "Licensed under CC BY-SA 4.0",
             "Licensed under CC BY-X 4.0", "the GNU Affero General Public License", "licensed under something 4 0", "This program is free software: you may redistribute it and/or change it under the terms of the GNU General Public License"]
    assert len(texts) == 7
    bsd = next(t.text for t in license_scan.TEMPLATES if t.label == "bsd").split()
    texts += [" ".join(x for w in bsd for x in (w, "and" if len(w) > 5 else w)), " ".join(reversed(bsd)), " ".join(bsd), f"x {' '.join(bsd)} y {' '.join(bsd)}", " ".join(bsd[:3] + ["a", "b"] + bsd[5:])]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == ("cc-by-nc", 6 / 7) and got[1][0] == "gpl,gpl-notice" and got[2] == ("cc-by-sa", 1.0) and got[3] == ("cc-by-nc,cc-by-sa", 6 / 7)
    assert got[4] == ("agpl,gpl", 1.0) and got[5] == ("", 0.0) and "gpl-header" in got[6][0]
    # Stretched by fillers and repeats, or out of order: no notice, however many words stand in some place.
    assert got[7] == ("", 0.0) and got[8] == ("", 0.0) and got[9] == got[10] == ("bsd", 1.0) and got[11] == ("bsd", (len(bsd) - 2) / len(bsd))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_license_notices_against_brute_force(spark):
    """Every notice label of a text has a span of few enough edits; a text with at most one edit in the middle of a notice has its label."""
    rng = np.random.default_rng(5)
    notices = [t for t in license_scan.TEMPLATES if not t.base]
    filler = ["lorem", "the", "of", "license", "ipsum", "under"]
    texts, planted = [], []
    for k in range(200):
        t = notices[k % len(notices)]
        words = t.text.split()
        at = int(rng.integers(2, len(words) - 2))
        kind = int(rng.integers(0, 4))
        words = words if kind == 0 else words[:at] + ["zzz"] * (kind < 3) + words[at + (kind > 1) :]
        pad = lambda: list(rng.choice(filler, int(rng.integers(0, 9))))
        texts.append(" ".join([*pad(), *words, *pad()]))
        planted.append(t.label)
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    bases = {t.label for t in license_scan.TEMPLATES if t.base}
    twins = {"cc-by-nc", "cc-by-sa"}, {"lgpl", "agpl"}
    for i, text in enumerate(texts):
        words, labels = text.split(), set(got[i].labels.split(",")) - {""} - bases
        for label in labels:
            t = next(t for t in notices if t.label == label).text.split()
            most = int((1 - license_scan.COVER) * len(t) + 1e-9)
            assert any(edits(words[a:b], t) <= most for a in range(len(words)) for b in range(a + len(t) - most, min(len(words), a + len(t) + most) + 1)), (text, label)
        if len(next(t for t in notices if t.label == planted[i]).text.split()) >= 7:
            assert planted[i] in labels or any(planted[i] in pair and labels & pair for pair in twins), (text, planted[i], labels)


def test_packing(spark, odd, empty):
    encode = encoder()
    for docs in (table(spark, SF, "documents"), odd.dropDuplicates(["doc_id"])):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        got = packing.pack_documents(docs).toPandas()
        assert got.groupby("sequence_id").length.sum().max() <= 1024
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all()
        for r in got.itertuples():
            ids = np.array([*encode(texts[None if r.doc_id != r.doc_id else int(r.doc_id)]), 2], "<u4")
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert got.sequence_id.nunique() <= 1.02 * np.ceil(got.length.sum() / 1024) + 3
    assert packing.pack_documents(empty).count() == 0


def test_token_ids_are_those_of_tokenizers():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    whole, encode = Tokenizer.from_file(public.path("byte_bpe_50k.json")), encoder()
    for t in ["a  b\n\n c", "it's 12345 ÄÖ 漢字 🙂", "x<|endoftext|>y", "́​\t \r\n", "aaaa" * 300]:
        assert encode(t) == whole.encode(t, add_special_tokens=False).ids


def plain_slot(number, n, key=token_output.KEY):
    """The keyed permutation, one number at a time and with plain integers."""
    half, full = max(1, -(-max(1, (n - 1).bit_length()) // 2)), (1 << 64) - 1
    while True:
        left, right = number >> half, number & ((1 << half) - 1)
        for r in range(token_output.ROUNDS):
            z = (right + ((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & full)) & full
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & full
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & full
            left, right = right, left ^ ((z ^ (z >> 31)) & ((1 << half) - 1))
        number = (left << half) | right
        if number < n:
            return number


def test_token_output(spark, odd, empty, tmp_path):
    encode = encoder()
    docs = table(spark, SF, "documents")
    for k, df in enumerate((docs.withColumn("shard", F.lit("x")), odd)):
        folder = f"file://{tmp_path}/out{k}"
        got = sorted(token_output.materialise(df, folder, shard_rows=16).collect(), key=lambda r: r.slot)
        # Sequences in the order of the table, as one reads it, and their slots by the plain permutation.
        plain = [(r.doc_id, i // 1024, ids[i : i + 1024]) for r in df.select("doc_id", "text").collect() for ids in [[*encode(r.text or ""), 2]] for i in range(0, len(ids), 1024)]
        n = len(plain)
        slots = [plain_slot(i, n) for i in range(n)]
        assert sorted(slots) == list(range(n)) and [r.slot for r in got] == list(range(n))
        by_slot = {s: p for s, p in zip(slots, plain)}
        assert [(r.doc_id, r.piece, r.n_ids) for r in got] == [(by_slot[s][0], by_slot[s][1], len(by_slot[s][2])) for s in range(n)]
        assert all(r.shard == r.slot // 16 and r.byte_offset == r.slot % 16 * 2048 for r in got)
        read = list(token_output.read_from(folder, 0, n + 5, shard_rows=16))
        assert [list(a) for a in read] == [by_slot[s][2] + [0] * (1024 - len(by_slot[s][2])) for s in range(n)]
        assert [list(a) for a in token_output.read_from(folder, 21, 30, shard_rows=16)] == [list(a) for a in read[21:51]]
        assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(by_slot[s][2], "<u4").tobytes()) for s in range(n)]
    assert token_output.materialise(empty).count() == 0
    for n in (1, 2, 37, 1000):
        assert sorted(token_output.permuted(np.arange(n), n)) == list(range(n)) == sorted(plain_slot(i, n) for i in range(n))


def test_token_output_of_a_table_that_is_dealt_otherwise(spark, tmp_path, monkeypatch):
    """If the second scan sees other partitions than the first, the table is written and scanned again."""
    docs, honest = table(spark, SF, "documents"), token_output.counts
    calls = []

    def lying(rows, stride):
        calls.append(1)
        return honest(rows.limit(50) if len(calls) == 1 else rows, stride)

    monkeypatch.setattr(token_output, "counts", lying)
    got = token_output.materialise(docs, f"file://{tmp_path}/out").collect()
    assert len(calls) == 2 and sorted(r.slot for r in got) == list(range(len(got))) and len({r.doc_id for r in got}) == docs.count()


def test_sentencepiece_scan(spark, odd, empty):
    p = pieces()
    for t in ["thequickbrownfox" * 300, "a  b\n 漢字🙂 xyz" * 60, "word " * 500]:
        for chunk, fan in ((7, 2), (7, 16), (64, 3), (1000, 16)):
            assert encode_whole(p, t, chunk, fan) == p.model.encode(t)
    t = "ab" * (CHUNK // 2) + "thequick brownfox " * 3000  # borders of the shipped size within a word and between words
    assert encode_whole(p, t) == p.model.encode(t)
    got = encode_and_decode(odd, chunk=64, fan=4).collect()
    assert all(r.round_trip for r in got) and len(got) == len(ODD)
    ids = {i: p.model.encode(t or "") for i, t in ODD}
    assert all(r.n_ids == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()) for r in got)
    assert encode_and_decode(empty).count() == 0


def test_max_plus_products_are_associative_and_traced():
    rng = np.random.default_rng(4)
    states = [(i, i) for i in range(5)]
    parts = [{(x, y): int(rng.integers(-9, 9)) for x in states for y in states if rng.random() < 0.8} for _ in range(4)]
    a, b, c, d = parts
    whole = product(product(product(a, b), c), d)
    assert whole == product(product(a, b), product(c, d)) == product(a, product(product(b, c), d))
    for (x, y), w in whole.items():
        path = traced_states(parts, x, y)
        assert path[0] == x and path[-1] == y and sum(m[s, t] for m, s, t in zip(parts, path, path[1:])) == w
        assert w == max(sum(v) for q in np.ndindex(5, 5, 5) for s in [[x, *(states[i] for i in q), y]] if all((u, t) in m for m, u, t in zip(parts, s, s[1:])) for v in [[m[u, t] for m, u, t in zip(parts, s, s[1:])]])


def test_quality(spark, odd, empty):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = quality.quality_of_documents(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.95
    assert quality.score(odd.select("doc_id", "text"), None, ["doc_id"]).count() == len(ODD)
    assert quality.quality_of_documents(empty, labels).count() == 0


def test_chain_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    scores, pairs = rng.normal(size=4), rng.normal(size=(2, 2))
    paths = [[b >> i & 1 for i in range(4)] for b in range(16)]
    weight = np.exp([sum(s * y for s, y in zip(scores, ys)) + sum(pairs[a, b] for a, b in zip(ys, ys[1:])) for ys in paths])
    good, total, _ = quality.marginals(scores, pairs, np.array([4]))
    assert np.allclose(good, (weight[:, None] * np.array(paths)).sum(0) / weight.sum()) and np.isclose(total[0], np.log(weight.sum()))


def test_language(spark, odd, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.language_of_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95
    model = langid.fit(docs)
    und = {r.doc_id: r.lang_pred for r in langid.predict(odd, model, ["doc_id"]).collect()}
    assert und[1] == und[2] == "und" and und[7] != "und" and langid.language_of_documents(empty.selectExpr("doc_id", "text", "'x' lang")).count() == 0


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav>menu</nav><div class=ad>buy</div><article><h1>Head &amp; more</h1><p><b>One<br>two<p>Three\n four</article><div id=comments>no</div><footer>f</footer>"
    assert html_extract.main_text(html_extract.parse(page), set()) == "Head & more\n\nOne two\n\nThree four"
    rows = [(i, f"http://h/{i}", f"<body><div>same words here</div><p>own {i}</p><script>x</script>") for i in range(20)] + [(None, None, None), (21, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[3].text == "own 3" and got[None].text == "" and got[21].n_chars == 0 and len(got) == 22


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, "http://h/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extract(df).collect()}


def test_html_template_of_few_pages_of_a_host(spark):
    got = texts_of(spark, [f"<body>{'<div>in this part</div>' if i < 10 else ''}<p>own {i}</p>" for i in range(320)])
    assert got == {i: f"own {i}" for i in range(320)}


def test_html_copies_of_a_page_are_no_template(spark):
    bare, marked = "<body><p>one</p><p>two</p>", "<body><article><div><h1>Head</h1><p>three</p></div></article>"
    got = texts_of(spark, [bare] * 5 + [marked] * 5 + [f"{marked}<!-- {i} --><script>{i}</script>" for i in range(3)])
    assert set(got.values()) == {"one\n\ntwo", "Head\n\nthree"}


def test_html_wrappers_of_a_page_are_kept():
    text = lambda page: html_extract.main_text(html_extract.parse(page), set())
    menu, related = "<nav>menu</nav>", "<div class=related><article>teaser</article></div>"
    article = "<article><h1>Head</h1><p>The text of it.</p></article>"
    for wrap in ("div class=content-sidebar-wrap", 'div class="site has-sidebar"', "form id=aspnetForm", "div class=no-header", "div role=form"):
        end = wrap.split()[0]
        assert text(f"<body><{wrap}>{menu}{article}{related}</{end}><footer>foot</footer>") == "Head\n\nThe text of it."
        assert text(f"<body><{wrap}>{menu}<p>The text of the page.</p><div class=related>no</div></{end}><footer>foot</footer>") == "The text of the page."
    assert text(f"<body>{article}<form>Your mail</form>{related}") == "Head\n\nThe text of it."
    assert text("<body><article><p>It holds</p><p><math><mi>x</mi></math> here</p><div class=share>no</div></article>") == "It holds\n\nx here"
    assert text("<body><div hidden><article>none</article></div><p>a</p>") == "a" and text("<body><article class=comment>c</article><p>some text</p>") == "some text"

WILD = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `__row` string, `__sha` string, c0 string, score string, key string"


@pytest.fixture(scope="module")
def wild(spark):
    """Odd rows with columns of names that operators use themselves; one text of many lines and one very long line."""
    rows = [(i, t, "en", "s", 0, "r", "w", "h", "c", "x", "k") for i, t in ODD] + [(20, "a line\n" * 4000, "en", "s", 0, *"rwhcxk"), (21, "x" * 300_000, None, None, None, *"rwhcxk")]
    return spark.createDataFrame(rows, WILD)


def test_clashing_names_are_kept_and_ignored(spark, wild):
    import corpus_pipeline

    names = wild.columns
    kept = exact_dedup(wild)
    assert kept.columns == names and {r["__sha"] for r in kept.collect()} == {"h"} and kept.count() == 9
    near = corpus_pipeline.near_stage(spark, wild, SF)
    assert near.columns == names and {r["__row"] for r in near.collect()} == {"w"} and near.count() <= 9
    for stage in (corpus_pipeline.language_stage, corpus_pipeline.quality_stage):
        out = stage(spark, wild, SF)
        assert out.columns == names and out.count() <= wild.count()
    n = wild.count()
    assert fingerprints(wild).count() == n and license_scan.license_scan(wild).count() == n and encode_and_decode(wild).count() == n
    assert quality.quality_of_documents(wild, table(spark, SF, "labels")).count() == n and langid.language_of_documents(wild).count() == n
    assert packing.pack_documents(wild).agg(F.countDistinct("doc_id")).first()[0] == 10 and token_output.materialise(wild).filter("piece = 0").count() == n
    pages = wild.select(F.col("doc_id").alias("page_id"), F.lit("http://h/").alias("url"), F.col("text").alias("html"), *[f"`{c}`" for c in names if c not in ("doc_id", "text")])
    assert html_extract.extract(pages).columns == ["page_id", "url", "text", "n_chars"] and html_extract.extract(pages).count() == n


def test_html_of_odd_tables(spark):
    schema = "page_id long, url string, html string"
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0
    page = "<body><p>one</p><div class=x>two</div></body>"
    rows = [(1, "http://h/1", page)] * 7 + [(None, None, page), (2, None, "<p>" + "word " * 200_000), (3, "http://h/3", '<p title="abc>hello'), (4, "", None)]
    got = [(r.page_id, r.text) for r in html_extract.extract(spark.createDataFrame(rows, schema)).collect()]
    assert len(got) == len(rows) and got.count((1, "one\n\ntwo")) == 7 and (None, "one\n\ntwo") in got and (3, "hello") in got and (4, "") in got
    assert dict(got)[2] == ("word " * 200_000).strip()


def test_html_against_plain_counts(spark):
    """Texts of all pages of a table, and of its pages with menus of every kind put in, against counts over all of them in one place."""
    pages = table(spark, "/root/testdata/sf0.01", "pages").select("page_id", F.lit("http://host.example/x").alias("url"), "html")
    menu = F.when(F.col("page_id") % 3 == 0, "<div><b>one menu</b> of three</div>").when(F.col("page_id") % 97 == 1, "<section>seldom seen</section>").otherwise("")
    for df in (table(spark, "/root/testdata/sf0.01", "pages"), pages.withColumn("html", F.concat(menu, "html")), pages.unionByName(pages).unionByName(pages)):
        rows = df.collect()
        seen = {}
        for r in rows:
            page = html_extract.parse(r.html)
            host = re.sub(r"^[a-z]+://([^/]+).*$", r"\1", r.url)
            for h in html_extract.subtrees(page):
                seen.setdefault((host, h), set()).add(" ".join(" ".join(t for _, t in page.pieces).split()))
        want = Counter()
        for r in rows:
            host = re.sub(r"^[a-z]+://([^/]+).*$", r"\1", r.url)
            page = html_extract.parse(r.html)
            want[r.page_id, html_extract.main_text(page, {h for h in html_extract.subtrees(page) if len(seen[host, h]) >= html_extract.MIN_PAGES})] += 1
        assert Counter((r.page_id, r.text) for r in html_extract.extract(df).collect()) == want


def test_language_against_plain_compression(spark):
    """Each text's language is the one whose dictionary makes its blocks smallest, each block compressed by itself."""
    import zstandard

    docs = table(spark, SF, "documents")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    for r in docs.collect():
        words = " ".join("".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in (r.text or "").lower()).split())
        if not words:
            assert got[r.doc_id].lang_pred == "und"
            continue
        sizes = []
        for text in model.texts:
            squeeze = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(squeeze.compress(b)) for b in langid.blocks(f" {langid.letters(r.text)} ")))
        assert got[r.doc_id].lang_pred == model.languages[sizes.index(min(sizes))]
        assert got[r.doc_id].rejected == (sorted(sizes)[1] - min(sizes) < max(langid.LEAST_MARGIN, langid.MARGIN * len(langid.letters(r.text)) / 1000))


def test_html_is_read_in_linear_time():
    import time

    for source in ('<a ' * 60_000 + '"', '<a "' * 60_000, '<a ">" ' * 60_000, "<" * 60_000, "<div>" * 60_000, "<b>" * 60_000 + "<li>x</li>" * 60_000, "<p><span class=ad>" * 30_000):
        began = time.time()
        page = html_extract.parse(source)
        html_extract.subtrees(page)
        html_extract.main_text(page, {1})
        assert time.time() - began < 20


def plain_marginals(scores, pairs):
    """Forward-backward of one chain, in plain numbers."""
    n = len(scores)
    own = [(1.0, np.exp(s)) for s in scores]
    step = np.exp(pairs)
    ahead, behind = [np.array(own[0])], [np.ones(2)]
    for k in range(1, n):
        v = ahead[-1] @ step * own[k]
        ahead.append(v / v.sum())
    for k in range(n - 1, 0, -1):
        v = step @ (own[k] * behind[-1])
        behind.append(v / v.sum())
    both = [a * b for a, b in zip(ahead, reversed(behind))]
    return [v[1] / v.sum() for v in both]


def test_quality_scores_against_plain_chains(spark, wild):
    """Every score, of odd texts and giants too, is the length-weighted mean of marginals of a chain that stands alone."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    chain = quality.train(docs, labels)
    for rows in (wild.select("doc_id", "text"), docs.select("doc_id", "text")):
        got = quality.score(rows, chain, ["doc_id", "text"]).collect()
        assert len(got) == rows.count()
        for r in got:
            features, lengths, counts = quality.line_features([r.text or ""])
            good = plain_marginals(chain.scores(features), chain.pairs)
            want = float(np.average(good, weights=lengths))
            assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1


def test_scores_of_giants_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    words = ["alpha", "beta!!", "Gamma", "42", "delta,", ""]
    texts = ["\n".join(" ".join(rng.choice(words, int(rng.integers(0, 6)))) for _ in range(int(n))) for n in (1, 3, 40, 7, 90, 25)]
    chain = quality.fit(texts, [1, 0, 1, 0, 1, 0])
    whole = quality.document_scores(chain, texts)
    monkeypatch.setattr(quality, "MOST_LINES", 10)
    assert np.allclose(quality.document_scores(chain, texts), whole)


def test_training_holds_features_alone(monkeypatch):
    """The driver holds features of all lines of the sample, but words and code points of a part of it; the parts make no difference."""
    rng = np.random.default_rng(8)
    words = ["alpha", "beta!!", "Gamma", "42", "delta,", "", "\n"]
    texts = [" ".join(rng.choice(words, 4000)) for _ in range(200)] + ["", "\n\n"]
    labels = [i % 2 for i in range(len(texts))]
    monkeypatch.setattr(quality, "STEPS", 2)
    whole = quality.line_features(texts)
    tracemalloc.start()
    quality.fit(texts, labels)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 2.5 * whole[0].nbytes
    for most in (10, 50_000, 1 << 30):
        monkeypatch.setattr(quality, "MOST_CHARS", most)
        assert all(np.array_equal(a, b) for a, b in zip(quality.sample_features(texts), whole, strict=True))


def test_pivots_keep_only_what_is_apart_apart():
    rng = np.random.default_rng(7)
    bags = [Counter(rng.integers(0, 40, int(rng.integers(5, 60))).tolist()) for _ in range(30)]
    bags += [b + Counter([int(rng.integers(0, 40))]) for b in bags]
    far = near_dedup.apart(bags)
    assert far.any()
    for i in range(len(bags)):
        for j in range(len(bags)):
            assert not far[i, j] or near_dedup.overlap(bags[i], bags[j]) < near_dedup.SIMILARITY


def test_language_of_what_has_no_letters_and_of_long_rows(spark):
    train = [(k, "der hund und die katze sind im garten und spielen " * 300, "de") for k in range(40)] + [(100 + k, "the dog and the cat are in the garden and they play " * (1 + k % 3), "en") for k in range(40)]
    docs = spark.createDataFrame(train + [(500 + k, t, None) for k, t in enumerate(["½ ²", "Ⅷ", "123 !?", "", None, "der hund ist im garten"])], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.language_of_documents(docs).collect()}
    assert [got[500 + k] for k in range(5)] == ["und"] * 5 and got[505] == "de"
    many = spark.createDataFrame([(k, f"word{k} text", f"l{k}") for k in range(400)], "doc_id long, text string, lang string")
    assert len(langid.fit(many).languages) == langid.LANGUAGES


def test_packing_of_repeats_and_its_rounds(spark, monkeypatch):
    """Repeated rows are packed each; several rounds of merging lose nothing and leave little waste."""
    encode = encoder()
    monkeypatch.setattr(packing, "GROUP_ITEMS", 40)
    docs = table(spark, SF, "documents").select("doc_id", "text")
    twice = docs.unionByName(docs.limit(50))
    got = packing.pack_documents(twice).toPandas()
    want = Counter((r.doc_id, k, start, length) for r in twice.collect() for k, (start, length) in enumerate(packing.cut_points(len(encode(r.text or "")) + 1)))
    assert Counter(zip(got.doc_id, got.piece, got.start, got.length)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 1024 and (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all()
    assert got.sequence_id.nunique() <= 1.05 * np.ceil(got.length.sum() / 1024) + 3


def test_pipeline(spark):
    """Every stage's decisions and the packed pieces, against plain Python over the same rows."""
    import corpus_pipeline

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    left = {r.doc_id: r.text or "" for r in docs.collect()}
    chain = quality.train(docs, labels)

    def score(text):
        features, lengths, _ = quality.line_features([text])
        return float(np.average(plain_marginals(chain.scores(features), chain.pairs), weights=lengths))

    left = {i: t for i, t in left.items() if score(t) >= quality.THRESHOLD}
    frame = docs.filter(F.col("doc_id").isin(list(left)))
    classify = langid.classifier(langid.fit(frame.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)))
    left = {i: t for i, t in left.items() if not classify(t)[2]}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[ \t\n\x0b\f\r]+", " ", left[i]), i)
    left = {i: left[i] for i in first.values()}
    ids = sorted(left)
    bags = {i: near_dedup.bag(left[i]) for i in ids}
    head = {i: i for i in ids}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if near_dedup.overlap(bags[i], bags[j]) >= near_dedup.SIMILARITY:
                a, b = sorted((root(i), root(j)))
                head[b] = a
    left = {i: left[i] for i in ids if root(i) == i}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(left)
    encode = encoder()
    want = {(i, k, start, length) for i, t in left.items() for k, (start, length) in enumerate(packing.cut_points(len(encode(t)) + 1))}
    assert {(r.doc_id, r.piece, r.start, r.length) for r in got} == want and len(got) == len(want)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = sum(1 for _ in pathlib.Path(folder).iterdir())
    drop_written(spark)
    assert sum(1 for _ in pathlib.Path(folder).iterdir()) < before
