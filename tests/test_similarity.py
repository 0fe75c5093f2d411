import numpy as np
import pytest
from pyspark.sql import functions as F

from taskatlas.functions import vectors as vx
from taskatlas.operators import classify, embedding, similarity
from taskatlas.operators.similarity import Plan

GRID = Plan(resident_bytes=0, range_rows=23, lane_rows=9)


def frame(spark, matrix, name, groups=None):
    groups = groups if groups is not None else [0] * len(matrix)
    rows = [(i, [float(x) for x in v], int(g)) for i, (v, g) in enumerate(zip(matrix, groups))]
    return spark.createDataFrame(rows, f"{name} long, vec array<double>, g int").repartition(4)


@pytest.fixture(scope="module")
def data():
    """Clustered vectors; a third of the documents are copies of one, and one vector is zero."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6))
    docs = centres[rng.integers(0, 4, 120)] + 0.3 * rng.normal(size=(120, 6))
    docs[::3] = docs[0]
    docs[7] = 0.0
    queries = centres[rng.integers(0, 4, 25)] + 0.3 * rng.normal(size=(25, 6))
    queries[4] = 0.0
    return queries, docs, rng.integers(0, 3, 120)


def brute(queries, docs):
    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-10)
    return np.round(unit(queries) @ unit(docs).T, 9)


def expected_top(sims, groups, k):
    out = set()
    for q, row in enumerate(sims):
        for g in set(groups):
            ids = [d for d in range(len(row)) if groups[d] == g]
            ids.sort(key=lambda d: (-row[d], d))
            out |= {(q, int(g), rank + 1, d) for rank, d in enumerate(ids[:k])}
    return out


@pytest.mark.parametrize("plan", [Plan(), GRID], ids=["resident", "grid"])
def test_match_against_brute_force(spark, data, plan):
    queries, docs, groups = data
    sims = brute(queries, docs)
    q, d = frame(spark, queries, "qid").select("qid", "vec"), frame(spark, docs, "id", groups)
    for threshold in (0.9, 0.2, -0.5):
        pairs = similarity.similar_pairs(q, d, threshold=threshold, plan=plan).collect()
        assert {(r["qid"], r["id"]) for r in pairs} == set(zip(*map(lambda a: a.tolist(), np.nonzero(sims >= threshold))))
        assert len(pairs) == (sims >= threshold).sum()
        counts = similarity.match_counts(q, d, threshold=threshold, keys=["g"], k=4, plan=plan).collect()
        want = {(i, int(g)): min(4, int((sims[i, groups == g] >= threshold).sum())) for i in range(25) for g in set(groups)}
        assert {(r["qid"], r["g"]): r["matches"] for r in counts} == {key: n for key, n in want.items() if n}
    for k in (1, 5, 200):
        found = similarity.top_k(q, d, k=k, keys=["g"], plan=plan).collect()
        assert {(r["qid"], r["g"], r["rank"], r["id"]) for r in found} == expected_top(sims, groups, k)


def test_top_k_handles_groups_a_query_meets_late(spark):
    """A group found only far from the query must still fill its top k."""
    docs = np.array([[1.0, 0.0]] * 6 + [[-1.0, 0.01]] * 6)
    groups = [0] * 6 + [1] * 6
    queries = np.array([[1.0, 0.05], [-1.0, 0.0]])
    q, d = frame(spark, queries, "qid").select("qid", "vec"), frame(spark, docs, "id", groups)
    found = similarity.top_k(q, d, k=2, keys=["g"], plan=Plan(resident_bytes=0, range_rows=3, lane_rows=1)).collect()
    assert {(r["qid"], r["g"], r["rank"], r["id"]) for r in found} == expected_top(brute(queries, docs), groups, 2)


def test_both_ways_agree_on_near_copies(spark):
    """At a threshold of 1 rounding decides; the ways must decide alike."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    docs = np.concatenate([base, base * 3.0, base + 1e-6 * rng.normal(size=base.shape), base + 1e-3])
    q, d = frame(spark, base, "qid").select("qid", "vec"), frame(spark, docs, "id").drop("g")
    for threshold in (1.0, 1.0 - 1e-9, 0.999999):
        ways = [sorted(map(tuple, similarity.similar_pairs(q, d, threshold=threshold, plan=p).collect())) for p in (Plan(), GRID)]
        assert ways[0] == ways[1] and len(ways[0]) >= 12


def test_grid_copies_follow_the_sizes(spark, data):
    """A query goes once to each range and a document once to each lane; both inputs are read once."""
    assert similarity.grid_shape(25, 120, GRID) == (6, 3)
    queries, docs, _ = data
    reads = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(batches):
            for batch in batches:
                reads.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    q, d = frame(spark, queries, "qid").select("qid", "vec"), frame(spark, docs, "id").drop("g")
    found = similarity.top_k(q, counted(d), k=3, plan=GRID)
    assert found.count() == 75 and reads.value == 120
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_approximate_top_k(spark, data):
    queries, docs, groups = data
    q, d = frame(spark, queries, "qid").select("qid", "vec"), frame(spark, docs, "id", groups)
    exact = similarity.top_k(q, d, k=5)
    full = similarity.approximate_top_k(q, d, k=5, leaves=4, leaves_to_search=4)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, exact.collect()))
    shares = [
        similarity.recall(similarity.approximate_top_k(q, d, k=5, leaves=4, leaves_to_search=n), exact).first()[0] for n in (1, 4)
    ]
    assert 0.2 < shares[0] <= shares[1] == 1.0


def test_neighbour_lists_round_trip(spark, data):
    queries, docs, groups = data
    q, d = frame(spark, queries, "qid").select("qid", "vec"), frame(spark, docs, "id", groups)
    ranked = similarity.top_k(q, d, k=3, keys=["g"])
    lists = similarity.neighbour_lists(ranked, ["g"])
    assert lists.filter(F.size("neighbours") > 3).count() == 0
    back = similarity.neighbour_rows(lists, ["g"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ranked.collect()))


def test_metrics(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(*[vx.metric(m)(F.col("a"), F.col("b")).alias(m) for m in ("cosine", "euclidean", "manhattan", "dot")]).collect()
    assert got[0].asDict() == pytest.approx({"cosine": 0.96, "euclidean": 2**0.5, "manhattan": 2.0, "dot": 24.0})
    assert got[1]["cosine"] == 0.0
    with pytest.raises(ValueError, match="unknown metric"):
        vx.metric("hamming")


def test_zero_rules(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    for rule, zero in (("clip", [0.0, 0.0]), ("one", [0.0, 0.0]), ("none", [None, None])):
        rows = [r[0] for r in df.select(vx.normalise(F.col("v"), zero_rule=rule)).collect()]
        assert rows == [[0.6, 0.8], zero]


def test_pooling(spark):
    rows = [(1, 0, 1, [1.0, 5.0]), (1, 1, 1, [3.0, 1.0]), (1, 2, 0, [9.0, 9.0]), (2, 0, 0, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "doc_id int, pos int, mask int, vec array<double>").repartition(3)

    def pooled(how):
        return {r["doc_id"]: list(r["vec"]) for r in embedding.pool_tokens(df, how=how).collect()}

    assert pooled("mean") == {1: [2.0, 3.0], 2: [0.0, 0.0]}
    assert pooled("cls") == {1: [1.0, 5.0], 2: [2.0, 2.0]}
    assert pooled("max") == {1: [3.0, 5.0], 2: [-1e9, -1e9]}
    with pytest.raises(ValueError):
        embedding.pool_tokens(df, how="sum")


def test_encoders(spark):
    rows = [(0, "Red red BLUE"), (1, ""), (2, None), (3, " \t "), (4, "word " * 30_000)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r["i"]: np.array(r["vec"]) for r in embedding.encode_text(df, "t", width=16).collect()}
    want = np.zeros(16)
    for word in ("red", "red", "blue"):
        want[embedding.token_bucket(word, 16)] += 1
    assert np.allclose(got[0], want / np.linalg.norm(want))
    assert not got[1].any() and not got[2].any() and not got[3].any()
    assert got[4].sum() == pytest.approx(1.0) and len(got[4]) == 16

    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    custom = {r["i"]: r["vec"] for r in embedding.encode_with(df, "t", make, width=2, unit=False).collect()}
    assert custom[0] == [12.0, 1.0] and custom[1] == [0.0, 0.0] and custom[4] == [150_000.0, 1.0]
    cut = embedding.encode_with(df, "t", make, width=2, unit=False, max_words=2)
    assert {r["i"]: r["vec"] for r in cut.collect()}[4] == [9.0, 1.0]


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1] + 10
    projected, share = embedding.reduce_dimensions(frame(spark, matrix, "id"), "id", n_components=2)
    got = np.array([r["vec"] for r in projected.orderBy("id").collect()])
    _, s, vt = np.linalg.svd(matrix - matrix.mean(axis=0), full_matrices=False)
    assert share == pytest.approx((s[:2] ** 2).sum() / (s**2).sum())
    assert np.allclose(np.abs(got), np.abs((matrix - matrix.mean(axis=0)) @ vt[:2].T))
    assert np.allclose(got.mean(axis=0), 0)


def test_labels_take_the_first_category_on_ties(spark):
    cats = classify.CategoryVectors(("first", "second"), np.array([[1.0, 0.0], [1.0, 0.0]]))
    df = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, None, "x"), (3, [0.5, 0.5], "  ")], "id int, vec array<double>, t string")
    rows = {r["id"]: (r["category"], r["confidence"]) for r in classify.classify(df, cats, blank=F.trim("t") == "").collect()}
    assert rows == {1: ("first", 1.0), 2: (None, None), 3: ("missing_data", 0.0)}


def test_category_table_is_bounded(spark):
    df = spark.range(5).select(F.col("id").alias("cat_pos"), F.col("id").cast("string").alias("category"), F.array(F.lit(1.0)).alias("vec"))
    assert classify.category_vectors(df, limit=5).matrix.shape == (5, 1)
    with pytest.raises(ValueError, match="more than 4"):
        classify.category_vectors(df, limit=4)


def test_validation(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), (None, "a")], "t string, p string")
    rows = {r["category"]: r for r in classify.validation(df, "t", "p").collect()}
    assert (rows["a"]["precision"], rows["a"]["recall"], rows["a"]["support"]) == (1.0, 0.5, 2)
    assert rows["b"]["precision"] == pytest.approx(0.666667) and rows["b"]["accuracy"] == 0.75


def collected(collector, blocks):
    rows = []
    for values, ids, sims in blocks:
        rows += list(collector.add(values, ids, sims))
    rows += list(collector.finish())
    return rows


def test_running_state_is_bounded(monkeypatch):
    """With room for one group only, groups are handed over early and nothing is lost."""
    monkeypatch.setattr(similarity, "STATE_CELLS", 8)
    rng = np.random.default_rng(2)
    qids = np.array([10, 11, 12, 13])
    blocks = [((g,), np.sort(rng.choice(1000, 5, replace=False)), np.round(rng.random((4, 5)), 1)) for g in (0, 1, 0, 1, 1)]
    found = {}
    for (g,), q, n in collected(similarity.Counts(qids, 0.5), blocks):
        for a, b in zip(q, n):
            found[(g, a)] = found.get((g, a), 0) + b
    want = {(g, q): sum((s[i] >= 0.5).sum() for (h,), _, s in blocks if h == g) for g in (0, 1) for i, q in enumerate(qids)}
    assert found == {key: n for key, n in want.items() if n}
    for k in (1, 2, 9):
        top = {}
        for (g,), q, ids, sims in collected(similarity.LocalTop(qids, k), blocks):
            for a, i, s in zip(q, ids, sims):
                top.setdefault((g, a), []).append((-s, i))
        for g in (0, 1):
            for i, q in enumerate(qids):
                every = sorted((-s[i][j], ids[j]) for (h,), ids, s in blocks if h == g for j in range(5))
                assert sorted(top[(g, q)])[:k] == every[:k]


def test_copies_do_not_grow_with_the_tables():
    """Ten times the rows are not ten times the copies of each row."""
    small = Plan(resident_bytes=0, range_rows=512, lane_rows=64)
    for rows in (50_000, 500_000):
        assert similarity.grid_shape(rows, rows, small, width=64, state=10) == (16, 16)
    # Lanes stay within a task's memory, whatever that copies.
    assert similarity.grid_shape(5_000_000, 5_000_000, small, width=64)[1] == 39
    assert similarity.grid_shape(20_000, 2_000_000, small, width=64, state=1_000)[0] == 1_600


def test_a_group_hands_over_while_it_streams(spark, monkeypatch):
    """Neither the documents nor the pairs of a group are held: what a batch gives leaves the task before the next comes."""
    monkeypatch.setattr(similarity, "COPIES", 1)
    matrix = np.random.default_rng(8).normal(size=(60, 4))
    q, d = frame(spark, matrix[:20], "qid").select("qid", "vec"), frame(spark, matrix, "id", np.arange(60) % 7)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        sims = brute(matrix[:20], matrix)
        pairs = similarity.similar_pairs(q, d, threshold=0.3, plan=GRID).collect()
        assert sorted((r["qid"], r["id"]) for r in pairs) == sorted(zip(*map(lambda a: a.tolist(), np.nonzero(sims >= 0.3))))
        found = similarity.top_k(q, d, k=2, keys=["g"], plan=GRID).collect()
        assert {(r["qid"], r["g"], r["rank"], r["id"]) for r in found} == expected_top(sims, np.arange(60) % 7, 2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_collectors_round_what_is_near_a_bound():
    """Products come unrounded; a score that rounds up to the bound counts, and ties by rounding go to the smaller id."""
    sims = np.array([[0.5 - 4e-10, 0.5 - 6e-10, 0.7, 0.7 + 4e-10, np.nan]])
    ids, qids = np.array([1, 2, 3, 4, 5]), np.array([9])
    assert [ids.tolist() for _, _, ids, _ in collected(similarity.Hits(qids, 0.5), [((), ids, sims)])] == [[1, 3, 4]]
    assert [n.tolist() for _, _, n in collected(similarity.Counts(qids, 0.5), [((), ids, sims)])] == [[3]]
    for blocks in ([((), ids, sims)], [((), ids[i : i + 1], sims[:, i : i + 1]) for i in (3, 2, 1, 0)]):
        assert [i.tolist() for _, _, i, _ in collected(similarity.LocalTop(qids, 1), blocks)] == [[3]]
    twice = [((), np.array([1, 2]), np.array([[0.1, 0.2]])), ((), np.array([1, 3]), np.array([[0.9, 0.8]]))]
    assert [i.tolist() for _, _, i, _ in collected(similarity.LocalTop(qids, 3, distinct=True), twice)] == [[1, 3, 2]]


@pytest.mark.parametrize("distinct", [False, True])
@pytest.mark.parametrize("k", [1, 3, 20])
def test_a_query_has_a_bounded_number_of_places(k, distinct):
    """Rising scores all reach the bound; a query still holds no more than its places, and ties go to the smaller id."""
    rng = np.random.default_rng(k)
    blocks = []
    for step in range(30):
        ids = np.sort(rng.choice(400, 40, replace=False))
        if not distinct:
            ids += 400 * step
        sims = np.round(rng.random((5, 40)), 1) + 0.05 * step
        sims[2:4] -= 2 * 0.05 * step
        sims[4] = 0.5
        blocks.append((ids, sims))
    top, held = similarity.LocalTop(np.arange(10, 15), k, distinct), []
    for ids, sims in blocks:
        assert list(top.add((), ids, sims, notes=ids.astype(np.int32) % 7)) == []
        held.append(max(part.scores.shape for parts in top.groups.values() for part in parts.values()))
    assert set(held) == {(5, max(2 * k, similarity.LEAST_ROOM))}
    (_, q, ids, sims, notes), = top.finish()
    for i in range(5):
        every = {}
        for names, scores in blocks:
            for name, score in zip(names.tolist(), scores[i]):
                every[name] = max(every.get(name, -9.0), round(score, 9))
        want = sorted((-v, name) for name, v in every.items())[:k]
        assert [(-v, name) for v, name in zip(sims[q == 10 + i], ids[q == 10 + i])] == want
    assert (notes == ids % 7).all()


def test_single_precision_only_passes_over(monkeypatch):
    """Near copies that single precision cannot tell apart are ranked by their double products, copies by id."""
    rng = np.random.default_rng(6)
    docs = similarity.unit_rows(rng.normal(size=(6_000, 12)))
    docs[::97] = docs[0]
    docs[1::97] = similarity.unit_rows(docs[0] + 1e-7 * rng.normal(size=docs[1::97].shape))
    docs[5] = 0.0
    queries, whole = docs[:40].copy(), similarity.scores(docs[:40], docs)
    ids, rows, k = np.arange(6_000) * 3, np.arange(40), 10
    short, doubles = (queries.astype(np.float32), docs.astype(np.float32)), []
    top, real = similarity.LocalTop(rows, k), similarity.LocalTop.add
    monkeypatch.setattr(similarity.LocalTop, "add", lambda self, *a, **b: doubles.append(a[2].size) or real(self, *a, **b))
    for at in range(0, 6_000, 200):
        part = slice(at, at + 200)
        assert list(top.add_near((), ids[part], queries, docs[part], (short[0], short[1][part]), rows)) == []
    (_, q, names, sims), = top.finish()
    assert sum(doubles) < whole.size // 2
    for i in rows:
        best = np.lexsort((ids, -whole[i]))[:k]
        assert names[q == i].tolist() == ids[best].tolist() and sims[q == i].tolist() == whole[i][best].tolist()


def test_encoders_take_some_text_at_a_time(spark, monkeypatch):
    """A batch is encoded in slices of bounded bytes; a longer text stands alone, and the vectors are the same."""
    texts = ["red blue", None, "", "word " * 40, "a b c", "red"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    sizes = spark.sparkContext.accumulator(0)

    def make():
        def encode(values):
            assert sum(map(len, values)) <= 20 or len(values) == 1
            sizes.add(len(values))
            return np.array([[len(v), 1.0] for v in values])

        return encode

    whole = embedding.encode_text(df, "t", width=16).orderBy("i").collect()
    monkeypatch.setattr(embedding, "SLICE_BYTES", 20)
    parts = [p.to_pylist() for p in embedding.text_slices(embedding.pa.array(texts))]
    assert parts == [["red blue", None, ""], ["word " * 40], ["a b c", "red"]]
    assert embedding.encode_text(df, "t", width=16).orderBy("i").collect() == whole
    found = {r["i"]: r["vec"] for r in embedding.encode_with(df, "t", make, width=2, unit=False).collect()}
    assert found[3] == [200.0, 1.0] and found[1] == [0.0, 0.0] and found[5] == [3.0, 1.0] and sizes.value == 4
