"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import zlib
from collections import Counter

import helpers
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taskatlas.llm import components as components_module
from taskatlas.llm import contamination, inner_product, language, notices, packing, parity_join, pseudonyms, quality, toxicity, url_filter
from taskatlas.llm.components import components

DOCS = "doc_id long, text string, score double, piece string, key string, cls string, label string, part string"


def docs_of(spark, rows):
    """Documents with columns that clash with names the operators use."""
    return spark.createDataFrame([(i, t, 1.0, "p", "k", "c", "l", "x") for i, t in rows], DOCS)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


# Inner products


def brute_top(vectors, asks, k):
    found = []
    for q in asks:
        rows = sorted((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:k]
        found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(rows)]
    return sorted(found)


@pytest.mark.parametrize("coordinate_from", [-2.0, 0.3, 2.0])
def test_top_products_prune_exactly(spark, coordinate_from):
    rng = np.random.default_rng(3)
    vectors = {i: np.floor(rng.standard_normal(6) * rng.choice([1, 5, 40])).astype(int).tolist() for i in range(300)}
    vectors |= {i: [3, 1, 4, 1, 5, 9] for i in range(300, 340)} | {400: [0] * 6, 401: [0] * 6}
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], "id long, v array<long>, part int").repartition(5)
    found = inner_product.top_products(df, "id", "v", F.col("id") % 20 == 0, k=7, range_rows=60, lane_rows=8, seed_rows=20, coordinate_from=coordinate_from)
    assert sorted(map(tuple, found.collect())) == brute_top(vectors, [i for i in vectors if i % 20 == 0], 7)


def test_top_products_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, 0.5]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (None, [9.0, 9.0]), (7, [-0.1])]
    df = spark.createDataFrame(rows, "id long, v array<float>").select("id", inner_product.quantized(F.col("v")).alias("v"))
    found = [tuple(r) for r in inner_product.top_products(df, "id", "v", F.col("id") % 20 == 0, k=5).orderBy("rank").collect()]
    assert found == [(0, 1, 5, 64 * 32 + 128 * 32), (0, 2, 6, 64 * 32 + 128 * 32), (0, 3, 7, 64 * -7)]
    assert inner_product.top_products(df.limit(0), "id", "v", F.col("id") % 20 == 0).count() == 0


# Pseudonyms

VALUES = {
    "email": ["bob.42@mail8.example.com", "A-b@x.org"],
    "address": ["10.0.0.1", "255.255.255.255"],
    "date": ["2024-02-29", "1999-12-31", "29/02/2024", "01.01.1900"],
    "social": ["123-45-6789"],
    "phone": ["+1 (988) 555-2485", "(212) 555-0000", "212-555-0199"],
    "card": ["4041894974608795", "4041 8949 7460 8795", "378282246310005"],
}
OTHERS = ["2023-02-29", "31/04/2024", "999.1.1.1", "000-12-3456", "4041894974608796", "version 2.0", "1.2.3.4.5", "x4041894974608795", "a@b", "12-34", ""]


def test_values_are_found_and_come_back(spark):
    rows = [(v, k) for k, vs in VALUES.items() for v in vs]
    df = spark.createDataFrame(rows, "value string, kind string").withColumn("text", F.concat(F.lit("so "), "value", F.lit(". ünd, "), "value", F.lit("!")))
    df = df.select("value", "kind", "text", pseudonyms.private_values(F.col("text")).alias("found"), pseudonyms.pseudonymized(F.col("text"), "k1").alias("new"), pseudonyms.pseudonymized(F.col("text"), "k2").alias("other"))
    for r in df.withColumn("back", pseudonyms.pseudonymized(F.col("new"), "k1", reverse=True)).collect():
        assert [(v["value"], v["kind"]) for v in r["found"]] == [(r["value"], r["kind"])] * 2, r
        assert r["value"] not in r["new"]
        assert r["new"] != r["other"]
        middle = r["new"][3:].split(". ünd, ")
        assert middle[0] + "!" == middle[1]  # equal values stay equal
        if r["kind"] != "email":
            assert r["back"] == r["text"]
            again = "".join("9" if c.isdigit() else c for c in middle[0])
            if r["kind"] != "address":
                assert again == "".join("9" if c.isdigit() else c for c in r["value"])
            assert pseudonyms_kind(spark, middle[0]) == r["kind"]


def pseudonyms_kind(spark, value):
    return spark.createDataFrame([(value,)], "v string").select(pseudonyms.kind_of(F.col("v"))).first()[0]


def test_pseudonyms_are_a_permutation(spark):
    x = spark.range(1000).select(pseudonyms.feistel(F.col("id"), F.lit(10), F.lit(100), "k", "t").alias("y"))
    assert sorted(r["y"] for r in x.collect()) == list(range(1000))


def test_texts_without_values_stay(spark):
    long = "word " * 30_000 + "10.0.0.1"
    df = docs_of(spark, [(i, t) for i, t in enumerate(OTHERS)] + [(90, None), (91, long), (91, long)])
    rows = pseudonyms.pseudonymize(df, "k").collect()
    assert df.columns == list(rows[0].asDict())
    assert {r["doc_id"]: r["text"] for r in rows if r["doc_id"] < 91} == dict(enumerate(OTHERS)) | {90: None}
    assert len({r["text"] for r in rows if r["doc_id"] == 91}) == 1 and all("10.0.0.1" not in r["text"] for r in rows if r["doc_id"] == 91)
    assert pseudonyms.pseudonymize(df.limit(0), "k").count() == 0


# URLs


def test_urls_odd_rows(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y=1#z", "http://net", "http://net/", "http://x.example.com/de/1", "http://xexample.com/de/", "ftp://a.org/fr/?q", "http://h?/net/", "http://u@h.net:80/p//q"]
    pages = spark.createDataFrame([(i, u, "s", "d") for i, u in enumerate(urls)], "page_id long, url string, suffix string, domain string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, "page_id", "url").collect()}
    assert len(got) == len(urls)
    assert (got[0]["host"], got[0]["path"], got[1]["host"], got[2]["host"]) == ("", "", "", "")
    assert [got[i]["rule"] for i in range(3, 11)] == ["example.net/en/", None, "net/", "example.com/de/", None, "org/fr/", None, None]
    assert (got[3]["host"], got[3]["path"], got[9]["path"], got[10]["path"]) == ("a.example.net", "/en/x", "", "/p//q")
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert url_filter.judge_urls(pages.limit(0), "page_id", "url").count() == 0
    one = spark.createDataFrame([("http://a.b/c", 1), ("http://a.b/d", 1)], "url string, label int")
    assert {r["verdict"] for r in url_filter.judge_urls(pages, "page_id", "url", rules=(), labelled=one).collect()} == {"block"}


def test_trees_learn_from_labels(spark):
    rng = random.Random(4)
    urls = [(f"http://{sentence(rng, 1)}.site/{'/'.join(str(rng.randrange(10**9)) for _ in range(4)) if bad else sentence(rng, 1)}", int(bad)) for bad in [True, False] * 150]
    labelled = spark.createDataFrame(urls, "url string, label int")
    pages = labelled.select(F.monotonically_increasing_id().alias("page_id"), "url", "label")
    got = url_filter.judge_urls(pages, "page_id", "url", rules=(), labelled=labelled).join(pages.drop("url"), "page_id").collect()
    assert np.mean([(r["verdict"] == "block") == bool(r["label"]) for r in got]) > 0.95


def test_copies_of_a_url_do_not_fill_the_training_sample(spark):
    rng = random.Random(4)
    urls = [(f"http://{sentence(rng, 1)}.site/{'/'.join(str(rng.randrange(10**9)) for _ in range(4)) if bad else sentence(rng, 1)}", int(bad)) for bad in [True, False] * 100]
    # The url with the smallest hash, so its copies come first.
    first = spark.createDataFrame(urls, "url string, label int").orderBy(F.xxhash64("url")).first()
    labelled = spark.createDataFrame(urls + [tuple(first)] * 300, "url string, label int")
    sample = url_filter.training_sample(labelled, 200).collect()
    assert sorted((r["url"], r["label"], r["copies"]) for r in sample) == sorted((u, b, 301.0 if u == first["url"] else float(urls.count((u, b)))) for u, b in set(urls))
    pages = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(urls)], "page_id long, url string, label int")
    got = url_filter.judge_urls(pages, "page_id", "url", rules=(), labelled=labelled, max_training_rows=200).join(pages.drop("url"), "page_id").collect()
    assert np.mean([(r["verdict"] == "block") == bool(r["label"]) for r in got]) > 0.95


# Toxicity


@pytest.mark.parametrize("block", [1, 4, 16, 1000])
def test_block_maxima_lose_nothing(block):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(500):
        # Term 0 and its neighbours stand in most rows (full rows), the others in few (postings).
        ids = np.unique(np.append(rng.integers(0, 900, rng.integers(0, 30)), rng.integers(0, 4, 2) if rng.random() < 0.7 else []).astype(np.int64))
        w = rng.random(len(ids)) ** 4
        rows.append((ids, w / max(np.sqrt(w @ w), 1e-9)))
    rows += rows[:30]  # ties
    index = toxicity.BlockMaxIndex(rows, 900, block)
    assert 0 < len(index.full) < 10 and len(index.place) > 100
    dense = np.zeros((len(rows), 900))
    for i, (ids, w) in enumerate(rows):
        dense[i, ids] = w
    exact = np.round(dense @ dense.T, 9)
    for without in (None, np.arange(120)):
        found, scored = index.nearest(rows[:120], 9, without)
        for i, (near, cosines) in enumerate(found):
            cosine = exact[i].copy()
            if without is not None:
                cosine[i] = 0.0
            order = np.lexsort((np.arange(len(rows)), -cosine))[:9]
            order = order[cosine[order] > 0]
            assert near.tolist() == order.tolist() and np.allclose(cosines, cosine[order])
        if block == 4:
            assert scored.mean() < 0.6 * index.blocks
    assert index.nearest([], 9)[0] == []


def test_term_numbers_count_as_terms_of():
    texts = ["Vile scum, vile SCUMBAGS!", "", None, "other words", "scumbag scum"]
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts[::4] for w in toxicity.terms_of(t)}))}
    numbers = toxicity.TermNumbers(vocabulary)
    for text in texts:
        counted = Counter(vocabulary[w] for w in toxicity.terms_of(text) if w in vocabulary)
        ids, counts = numbers.counted(text)
        assert list(zip(ids.tolist(), counts.tolist())) == sorted(counted.items())


def test_toxicity_odd_rows(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, 60) + (" vile scum" if i % 3 == 0 else " fine day")) for i in range(240)]
    df = docs_of(spark, [*rows, (900, None), (901, ""), (902, "vile scum"), (902, "vile scum"), (903, "scum " * 30_000), (None, "vile")])
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i, _ in rows], "doc_id long, label int, text string")
    got = toxicity.score_toxicity(df, labels).collect()
    assert len(got) == 246 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[902]["predicted"] == by[903]["predicted"] == 1 and by[900]["predicted"] == by[901]["predicted"] == 0
    assert by[900]["evidence"] == [] and by[902]["evidence"][0]["label"] == 1
    assert np.mean([by[i]["predicted"] == (i % 3 == 0) for i, _ in rows]) > 0.95
    kept = toxicity.without_toxic(df, labels)
    assert kept.columns == df.columns and {902, 903} & {r["doc_id"] for r in kept.collect()} == set()
    assert toxicity.score_toxicity(df.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(df, labels.limit(0)).collect()} == {0.0}


def test_toxicity_compares_all_words(spark):
    """Words of a single example, and words as frequent under both labels, count as well."""
    rng = random.Random(16)
    rows = [(i, sentence(rng, 40) + (" vile scum" if i % 3 == 0 else " fine day")) for i in range(240)]
    alone = [(300 + i, f"zq{i}x wv{i}u yt{i}s") for i in range(20)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows + alone], "doc_id long, label int")
    copies = [(1000 + i, t) for i, t in alone]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs_of(spark, rows + alone + copies), labels).collect()}
    learnt = [i for i, _ in alone if zlib.crc32(str(i).encode()) % 5]
    assert learnt
    for i in learnt:
        (near,) = got[1000 + i]["evidence"]
        assert (near["doc_id"], near["label"]) == (i, int(i % 3 == 0)) and near["cosine"] == pytest.approx(1.0)
        assert got[1000 + i]["predicted"] == int(i % 3 == 0)


# Language


def test_language_odd_rows(spark):
    rng = random.Random(7)
    xx = lambda n: " ".join("".join(rng.choice("bdgk") + rng.choice("ao") for _ in range(3)) for _ in range(n))
    yy = lambda n: " ".join("".join(rng.choice("éèü") + rng.choice("xzq") for _ in range(3)) for _ in range(n))
    rows = [(i, xx(80) if i % 2 else yy(80)) for i in range(120)]
    labelled = spark.createDataFrame([(i, t, "xx" if i % 2 else "yy") for i, t in rows], "doc_id long, text string, label string")
    odd = [(900, None), (901, ""), (902, "123 ... 456"), (903, xx(30_000)), (904, yy(3)), (904, yy(3)), (None, xx(5))]
    got = language.identify_languages(docs_of(spark, rows + odd), labelled).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert (by[903]["lang_pred"], by[904]["lang_pred"], by[None]["lang_pred"]) == ("xx", "yy", "xx")
    assert language.identify_languages(docs_of(spark, odd), labelled.limit(0)).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language.identify_languages(docs_of(spark, odd).limit(0), labelled).count() == 0


def test_windows_hold_every_byte():
    for n in (0, 1, 127, 128, 129, 1000):
        data = bytes(i % 250 + 1 for i in range(n))
        assert language.windows(data).tobytes().rstrip(b"\0") == data


# Parity join


def near_copy(rng, text, edits):
    tokens = text.split()
    for _ in range(edits):
        tokens[rng.randrange(len(tokens))] = sentence(rng, 1)
    return " ".join(tokens)


def test_links_of_all_sizes(spark):
    rng = random.Random(8)
    texts, n = {}, 0
    for size in (3, 5, 6, 9, 14, 30, 60, 150, 400):
        for _ in range(3):
            base = sentence(rng, size)
            for edits in (0, 0, 1, 1, 2, 3, size // 40, size // 25):
                texts[n] = near_copy(rng, base, edits)
                n += 1
            texts[n] = base + " " + sentence(rng, max(1, size // 6))
            n += 1
    passage = sentence(rng, 60)
    for _ in range(120):  # a passage that unlinked texts share
        texts[n] = sentence(rng, rng.randint(1, 40)) + " " + passage
        n += 1
    texts |= {n: None, n + 1: "", n + 2: " \n\t", n + 3: sentence(rng, 9) + "   ", n + 4: "word " * 20_000, n + 5: "WORD " * 20_000}
    got = parity_join.jaccard_components(docs_of(spark, texts.items()).repartition(7)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == helpers.component_ids(texts)
    assert len(got) == len(texts)


def test_more_members_than_anchors(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "ANCHORS", 3)
    monkeypatch.setattr(parity_join, "LANE", 4)
    rng = random.Random(9)
    passage = sentence(rng, 90)
    texts = {i: passage + " " + sentence(rng, rng.randint(8, 30)) for i in range(60)}
    got = parity_join.jaccard_components(docs_of(spark, texts.items())).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == helpers.component_ids(texts)


def test_joined_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A B C D E F"), (None, "a b c d e f"), (7, "other words of five or more"), (7, None)]
    got = sorted((tuple(r) for r in parity_join.jaccard_components(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 2, 3), (5, 2, 3), (3, 2, 3), (None, 2, None), (7, 2, 7), (7, 0, 7)], key=str)
    kept = parity_join.one_of_each(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([rows[2], rows[3], rows[4], rows[5]], key=str)
    again = parity_join.one_of_each(docs_of(spark, rows[:2]))
    assert [(r["doc_id"], r["text"]) for r in again.collect()] == rows[:1]
    assert parity_join.jaccard_components(docs_of(spark, rows).limit(0)).count() == 0


def test_a_copy_does_not_remove_other_texts_of_its_id(spark):
    rows = [(3, "a b c d e f"), (5, "A B c d e f"), (5, "quite other words that nobody repeats"), (5, "quite other words that nobody repeats"), (6, None), (6, "a b c d e f"), (8, "A b c d e f")]
    kept = parity_join.one_of_each(docs_of(spark, rows))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [rows[0], rows[2], rows[4]]


def test_bound_of_differing_parts():
    bands = parity_join.Bands(80)
    for a in range(1, 300):
        for b in range(a, 100 * a // 80 + 1):
            common = -(-80 * (a + b) // 180)
            differ = a + b - 2 * common
            if common <= a:
                assert differ <= bands.smaller(a) and differ <= bands.larger(b)
                assert bands.number(a) in bands.of(b)
        assert bands.parts(bands.number(a)) > bands.smaller(a)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 160), 100) | {200: 200, 201: 200}


def test_components_that_are_stars_need_no_round(spark, monkeypatch):
    """Links that already lead to the smallest node are not joined again to see that nothing changes."""
    rounds, real = [], components_module._large_star
    monkeypatch.setattr(components_module, "_large_star", lambda edges: rounds.append(1) or real(edges))
    for edges, count in (([(1, 2), (3, 1), (1, 4), (5, 6), (6, 5), (7, 7), (None, 8)], 0), ([(1, 2), (2, 3)], 1), ([], 0)):
        rounds.clear()
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert len(rounds) == count
        assert got == {0: {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}, 1: {1: 1, 2: 1, 3: 1}}[count] if edges else got == {}


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_links_are_joined_in_few_shuffles(spark):
    """A round of components, the meeting of texts and that of sketches deal no table out again that is already together or counted."""
    edges = spark.createDataFrame([(2, 1), (3, 2)], "u long, v long")
    assert shuffles(components_module._small_star(components_module._large_star(edges))) <= 7
    texts, pairs = spark.createDataFrame([(1, "a b")], "cls long, text string"), spark.createDataFrame([(1, 2)], "a long, b long")
    assert shuffles(parity_join.verified(texts, pairs, 5, 80)) <= 5
    members = spark.createDataFrame([(1, 1, 6, True, 1, 2), (1, 2, 6, True, 2, 2)], "key long, cls long, n long, strong boolean, component long, held long")
    sketches = spark.createDataFrame([(1, b"\0" * 8), (2, b"\0" * 8)], "cls long, sketch binary")
    found = parity_join.close_candidates(members.filter("cls = 2"), members, sketches, 2, 80)
    assert shuffles(found) <= 6 and [tuple(r) for r in found.collect()] == [(1, 2)]


# Contamination


def test_contamination_odd_rows(spark):
    rng = random.Random(10)
    items = [(1, sentence(rng, 40)), (2, "Just Three-words"), (3, None), (4, ""), (5, sentence(rng, 12)), (5, sentence(rng, 12)), (6, "solo")]
    items.append((7, items[0][1]))
    cut = items[0][1].split()
    texts = [
        (1, "x " + " ".join(cut[5:18]) + " y"), (2, "so JUST, three words"), (3, None), (4, ""), (5, " ".join(cut)), (5, " ".join(cut)),
        (6, " ".join(cut[:9])), (7, "solo solo trip"), (8, "y " * 20_000 + " ".join(cut[:10]) + " ünd"), (9, "-- " + items[4][1].upper()), (None, items[0][1]),
    ]
    bench = spark.createDataFrame([(i, t, "w", 1) for i, t in items], "item_id long, text string, window string, size int")
    got = contamination.contamination(docs_of(spark, texts), bench).collect()
    expected = [(i, len(helpers.words(t)), *(f(helpers.hit_words(t, [x for x in items if x[1]])) for f in (lambda h: len(h[0]), lambda h: sorted(h[1])))) for i, t in texts]
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == sorted(expected, key=str)
    clean = contamination.decontaminate(docs_of(spark, texts), bench)
    assert clean.columns == docs_of(spark, texts).columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 6]
    spans = {r["doc_id"]: r["text"] for r in contamination.decontaminate(docs_of(spark, texts), bench, remove="spans").collect()}
    assert spans[1] == "x y" and spans[2] == "so " and spans[3] is None and spans[6] == texts[6][1] and spans[7] == "trip"
    assert contamination.contamination(docs_of(spark, texts).limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in contamination.contamination(docs_of(spark, texts), bench.limit(0)).collect())


def test_a_large_benchmark_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BROADCAST_WINDOWS", 0)
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = contamination.contamination(docs_of(spark, [(1, "zero one two three four"), (2, "one two"), (3, None)]), bench)
    assert sorted((r["doc_id"], r["n_hit"]) for r in got.collect()) == [(1, 3), (2, 0), (3, 0)]


# Packing


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference, encode = Tokenizer.from_file(path), packing.load_encoder(path)
    for text in ["", " ", "\n\n  a", "It's  we'll\tdo  ", "naïve Ünïcode 漢字 🙂   x", "<|endoftext|> a", "a <|endoftext|><|endoftext|>\n b<|endoftext",  "1234567 3.14\r\n\r\n", "a" * 5000, "\x00\x85 ok"]:
        assert encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_bins_keep_every_capacity(rule):
    rng = np.random.default_rng(11)
    lengths = rng.integers(1, 100, 400)
    bins, offsets = packing.best_fit(lengths, np.array([100.0, 3.0, 4_000.0 + 100 * 100]), np.array([1.0, 0.2, 0.2]), rule)
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        assert lengths[own].sum() <= 100 and len(own) <= 3 and (lengths[own] ** 2).sum() <= 14_000
        assert sorted(offsets[own]) == [0, *np.cumsum(lengths[own][np.argsort(offsets[own])])[:-1]]
    assert len(np.unique(bins)) <= 1.1 * max(lengths.sum() / 100, 400 / 3) + 2


def test_packing_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = docs_of(spark, [(1, None), (2, ""), (3, "one two three " * 3_000), (4, "a"), (4, "a"), (None, "b")])
    rows = packing.pack_documents(df, path, max_tokens=512).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows if r["doc_id"] != 3) == [(0, 2), (1, 1), (2, 1), (4, 2), (4, 2)]
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 3)
    assert all(n == 512 for _, _, n in long[1:]) and [s for _, s, _ in long] == [0, *np.cumsum([n for _, _, n in long])[:-1]]
    assert packing.pack_documents(df.limit(0), path).count() == 0


# Whole sketches


def test_close_pairs_lose_no_link(monkeypatch):
    """Every linked pair of a key with an anchor remains, at any size of the steps."""
    monkeypatch.setattr(parity_join, "PAIRS_AT_ONCE", 7)
    rng, bands = np.random.default_rng(8), parity_join.Bands(80)
    base = rng.integers(0, 2**63, 2_000, dtype=np.uint64)
    sets = []
    for i in range(40):
        size = int(rng.choice([1, 5, 40, 300, 1_900]))
        kept = base[:size][rng.random(size) > rng.choice([0, 0.05, 0.1, 0.3])]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, int(rng.integers(0, size // 10 + 2)), dtype=np.uint64)])))
    rows = [(k, 0, i, len(s), True, i, parity_join.whole_sketch(s, bands).tobytes(), a) for k in (1, 2) for i, s in enumerate(sets) if len(s) for a in (False, True)[: 1 + (i < 15 * k)]]
    names = ["key", "lane", "cls", "n", "strong", "component", "sketch", "anchor"]
    a, b = parity_join.close_pairs(pa.table({c: list(v) for c, v in zip(names, zip(*rows, strict=True), strict=True)}), 80)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    wanted = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            common = len(np.intersect1d(sets[i], sets[j]))
            if i < 30 and common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                wanted.add((i, j))
    assert wanted and wanted <= got and len(got) < 2 * len(wanted) + 20


# Notices


def test_notices_with_errors(spark):
    texts = [
        (1, "x Licensed under the Apache Licence, Version 2.0 y"), (2, None), (3, ""), (4, "All rights reserved. All rights reserved."), (5, "fall rights reserved"),
        (6, "word " * 30_000 + "released undr the MIT license"), (6, "released undr the MIT license"), (7, "This work is lcensed under the GNU General Public Licens, version 3"), (None, "cc by"), (8, "nothing to see"),
    ]
    got = notices.scan_notices(docs_of(spark, texts)).collect()
    assert len(got) == len(texts)
    labels = {}
    for r in got:
        labels.setdefault(r["doc_id"], []).append(({n["label"] for n in r["notices"]}, [(p["label"], p["word"]) for p in r["places"]], r["n_words"]))
    assert labels[1][0][0] == {"apache-2"} and labels[7][0][0] == {"gpl"} and labels[8][0][0] == set()
    assert labels[2] == labels[3] == [(set(), [], 0)]
    assert labels[4][0][1] == [("reserved", 0), ("reserved", 3)] and labels[5][0][1] == []
    assert all(found == {"mit"} for found, _, _ in labels[6]) and labels[None][0][1] == [("cc-by", 0)]
    first = next(r for r in got if r["doc_id"] == 1)["notices"][0]
    assert (first["first_word"], first["last_word"], first["edits"]) == (1, 8, 1)
    assert notices.scan_notices(docs_of(spark, texts).limit(0)).count() == 0


def test_seeds_find_every_match_within_the_bound():
    import regex

    rng = random.Random(12)
    text, label = notices.NOTICES[0]
    errors = int(len(text) * notices.ERROR_SHARE)
    find = notices.make_finder((), [(text, label)], notices.ERROR_SHARE)
    pattern = regex.compile(f"(?:{regex.escape(text, literal_spaces=True)}){{e<={errors}}}")
    for _ in range(200):
        letters = list(text)
        for _ in range(rng.randint(0, errors + 2)):
            letters[rng.randrange(len(letters))] = rng.choice("abcxyz")
        whole = " some words " + "".join(letters) + " and more "
        assert bool(find(whole.encode())[1]) == bool(pattern.search(whole))


def least_edits(text, notice):
    """Fewest edits between the notice and whole words of a text with blanks around, by the full table."""
    row = [0 if j and text[j - 1] == " " else 10**6 for j in range(len(text) + 1)]
    for j in range(1, len(row)):
        row[j] = min(row[j], row[j - 1] + 1)
    for c in notice:
        new = [row[0] + 1]
        for j in range(1, len(row)):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (text[j - 1] != c)))
        row = new
    return min(row[j] for j in range(len(text)) if text[j] == " ")


def test_notices_with_letters_added_at_the_ends():
    for text, label in [
        ("is released under the mit licenses today", "mit"), ("creative commons attributions", "cc-by"), ("unlicensed under the apache license version 2 0", "apache-2"),
        ("licensed under the apache license version 2 01", "apache-2"), ("licensed under the apache license version 2 0ecxex", "apache-2"),
    ]:
        assert [n[0] for n in notices.make_finder((), notices.NOTICES, notices.ERROR_SHARE)(f" {text} ".encode())[1]] == [label]
    rng = random.Random(17)
    finders = [(t, max(1, int(len(t) * notices.ERROR_SHARE)), notices.make_finder((), [(t, v)], notices.ERROR_SHARE)) for t, v in notices.NOTICES]
    for _ in range(600):
        notice, errors, find = rng.choice(finders)
        letters = notice
        for _ in range(rng.randint(0, errors + 1)):
            at, kind, c = rng.choice([0, len(letters), rng.randrange(len(letters))]), rng.random(), rng.choice("abcx e")
            letters = letters[:at] + (c if kind < 0.8 else "") + letters[at + (kind > 0.6) :]
        whole = f" {' '.join((rng.choice(['some words ', '', 'x ', 'a ']) + letters + rng.choice([' and more', '', ' a', ' s'])).split())} "
        least, found = least_edits(whole, notice), find(whole.encode())[1]
        assert [n[3] for n in found] == ([least] if least <= errors else []), (whole, found, least)
        for _, first, last, edits, _ in found:
            assert whole[first - 1] == whole[last] == " " and least_edits(f" {whole[first:last]} ", notice) == edits


def test_the_nearest_of_rival_notices_counts():
    find = notices.make_finder((), notices.NOTICES, notices.ERROR_SHARE)
    for text, label in [
        ("licensed under cc by nd 4 0", "cc-by-nd"), ("licensed under cc by sa 4 0", "cc-by-sa"), ("licensed under cc by nc 4 0", "cc-by-nc"),
        ("mozilla public license version 1 1", "mpl-1"), ("mozila public license version 2 0", "mpl-2"), ("licensed under the apache license version 1 1", "apache-1"),
    ]:
        assert {n[0] for n in find(f" so {text} it says ".encode())[1]} == {label}
    # Copies in a row, each with its own edits, are all found.
    row = "released under the mit license relesed under the mit license released under te mit licens " * 40
    assert [n[3] for n in find(f" {row}".encode())[1]] == [0, 1, 2] * 40


# Quality


def test_quality_odd_rows(spark):
    rng = random.Random(13)
    kinds = [lambda: "BUY!! " * 40, lambda: sentence(rng, 40) + " | | |", lambda: sentence(rng, 60) + "."]
    rows = [(i, kinds[i % 3]()) for i in range(300)]
    df = docs_of(spark, [*rows, (900, None), (901, " \n"), (902, sentence(rng, 40_000)), (903, "BUY!! " * 40), (903, "BUY!! " * 40), (None, "x")])
    ratings = spark.createDataFrame([(i, i % 3, "t") for i, _ in rows] + [(None, 2, "t"), (3, None, "t"), (4, 17, "t")], "doc_id long, label int, tail string")
    got = quality.grade_documents(df, ratings).collect()
    assert len(got) == 306
    by = {r["doc_id"]: r for r in got}
    assert (by[900]["expected_grade"], by[900]["tail"], by[901]["keep"], by[903]["keep"]) == (0.0, 0.0, False, False)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert np.mean([round(r["expected_grade"]) == r["doc_id"] % 3 for r in held]) > 0.9
    assert {r["tail"] for r in quality.grade_documents(df.filter("doc_id < 900"), ratings.limit(0)).collect()} == {0.5}
    assert quality.grade_documents(df.limit(0), ratings).count() == 0


def test_thresholds_stay_in_order():
    rng = np.random.default_rng(14)
    grades = rng.integers(0, 4, 400)
    rows = [np.concatenate([rng.integers(0, 50, 5), np.full(g * 3 + 1, 60 + g)]) for g in grades]
    model = quality.fit_ordinal(rows, grades, 4)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(np.array([model.utility(r) for r in rows]))
    assert (np.diff(tails, axis=1) < 0).all() and np.mean(np.round(tails.sum(1)) == grades) > 0.9


@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_decontaminate_takes_any_column_names(spark, remove):
    phrase = "one two three four five six seven eight nine ten"
    rows = [(1, f"a {phrase} b", 1, "k", 7), (2, "clean text", 2, "k", 7), (None, None, 3, "k", 7), (3, "", 4, "k", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int, __KEY string, __spans int")
    items = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    found = {r["__id"]: (r["text"], r["__KEY"], r["__spans"]) for r in contamination.decontaminate(docs, items, remove=remove).collect()}
    assert {k: v[1:] for k, v in found.items()} == {i: ("k", 7) for i in ((2, 3, 4) if remove == "documents" else (1, 2, 3, 4))}
    assert (found[2][0], found[3][0], found[4][0]) == ("clean text", None, "")
    if remove == "spans":
        assert "three" not in found[1][0]


def test_private_values_need_no_count_of_characters(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "mail me at jane.doe@example.org"), (2, None), (3, "")], "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.private_values(spark, docs, "").collect()}
    assert found[2] is None and found[3] == "" and "jane.doe" not in found[1]
