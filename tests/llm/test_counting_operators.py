"""Language-model scores, filter audit and collocations against plain versions, on odd rows too."""

import math
import re
from collections import Counter, defaultdict
from itertools import permutations
from zlib import crc32

import helpers
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taskatlas.llm import collocations, filter_audit, suffix_tree, token_hashes, word_grams

DOCS = "doc_id long, text string, lang string, source string, block long, key string, word string, n long, mask int, part string"


def table(spark, rows, schema=DOCS):
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def some_texts(seed, count, vocabulary=6, longest=30):
    rng = np.random.default_rng(seed)
    words = ["the", "Of", "a-b", "é", "naïve", "zz", "x.y", "w w"][:vocabulary]
    texts = []
    for _ in range(count):
        picked = []
        for _ in range(rng.integers(0, longest)):
            # Half of the words follow from the two before.
            own = len("".join(picked[-2:])) % vocabulary if rng.random() < 0.5 else rng.integers(vocabulary)
            picked.append(words[own])
        texts.append("".join(w + rng.choice([" ", " ", " ", "\t", "\n", ", ", ". "]) for w in picked))
    return texts


ODD = [None, "", " \n\t ", "the", "the of the", "Of the a-b " * 400, "!!", "　", "the\x0bof\x1cof"]


# ------------------------------------------------------------------ suffix tree


def is_held_out(doc_id):
    return doc_id is not None and crc32(str(doc_id).encode()) % 7 == 2


def plain_scores(rows, depth, min_next):
    """Every score by counting tuples of words."""
    def tokens(text):
        return [*helpers.TOKEN.findall(helpers.lower(text)), None]

    count = Counter()
    for doc_id, text in rows:
        if not is_held_out(doc_id):
            own = tokens(text)
            for i in range(len(own)):
                for k in range(1, depth + 2):
                    if i + k <= len(own):
                        count[tuple(own[i : i + k])] += 1
    n = sum(c for g, c in count.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in count)

    def share(g):
        return count[g] / (count[g[:-1]] if len(g) > 1 else n)

    moves = defaultdict(dict)
    for g, c in count.items():
        if len(g) > 1 and c >= min_next:
            moves[g[:-1]][g[-1]] = c
    kept = set()
    for s, known in moves.items():
        times, total = count[s], sum(known.values())
        gain = sum(c * math.log(share((*s, w)) / share((*s[1:], w))) for w, c in known.items())
        if times > total:
            gain += (times - total) * math.log((times - total) / times / (1 - sum(share((*s[1:], w)) for w in known)))
        if 2 * gain >= len(known) * math.log(times):
            kept.update(s[i:] for i in range(len(s)))

    def probability(history, w):
        p = (count[(w,)] + 1) / (n + v + 1)
        for k in range(1, depth + 1):
            s = tuple(history[-k:])
            if len(s) == k and s in kept:
                total, known = count[s], moves[s]
                p = (known.get(w, 0) + (total - sum(known.values()) + len(known)) * p) / (total + len(known))
        return p

    result = []
    for doc_id, text in rows:
        own = tokens(text)
        base = sum(math.log10((count[(w,)] + 1) / (n + v + 1)) for w in own)
        score = sum(math.log10(probability(own[:i], w)) for i, w in enumerate(own))
        result.append((doc_id, is_held_out(doc_id), len(own), sum(count[(w,)] > 0 for w in own), n, base, score))
    return result, kept


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def same_scores(spark, rows, depth=3, min_next=3):
    found = ordered(map(tuple, suffix_tree.score_language(table(spark, rows), depth=depth, min_next=min_next, block_bytes=2_000).collect()))
    expected, kept = plain_scores(rows, depth, min_next)
    expected = ordered(expected)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for a, b in zip(found, expected):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    return kept


def test_scores_equal_plain_counting(spark):
    rows = list(enumerate(some_texts(1, 60)))
    kept = same_scores(spark, rows)
    assert {len(s) for s in kept} >= {1, 2}
    assert {len(s) for s in same_scores(spark, rows, depth=1, min_next=2)} == {1}


def test_scores_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "the of"), (None, None), (3, "the of the"), (3, "the of the"), (4, "the of the")]
    same_scores(spark, rows, min_next=2)


def test_scores_without_training_rows(spark):
    held = next(i for i in range(100) if is_held_out(i))
    assert [tuple(r) for r in suffix_tree.score_language(table(spark, [(held, "a b")])).collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]
    assert suffix_tree.score_language(table(spark, [])).collect() == []


def test_model_is_a_distribution(spark):
    """From any history, the probabilities of all words, the end and one unknown word add up to one."""
    rows = list(enumerate(some_texts(3, 40, vocabulary=4)))
    words = sorted({w for _, t in rows for w in helpers.TOKEN.findall(helpers.lower(t))} | {"never-seen"})
    histories = ["", "the", "the of", "of the of", "a-b the of"]
    asked = [i for i in range(10_000, 40_000) if is_held_out(i)]
    added, sums = [], defaultdict(float)
    for history in histories:
        for w in [None, *words]:
            added.append((asked.pop(), history, w))
    probes = [(i, f"{h} {w}" if w else h) for i, h, w in added]
    found = {r["doc_id"]: r["score"] for r in suffix_tree.score_language(table(spark, rows + probes), min_next=2).collect()}
    plain = {r[0]: r[6] for r in plain_scores(rows + probes, 3, 2)[0]}
    assert all(found[i] == pytest.approx(plain[i]) for i, _ in probes)


def test_a_block_names_a_sequence_once(spark):
    """Whatever a block meets again after many other sequences is still one row."""
    text = " ".join(f"w{i}" for i in range(80_000))
    rows = table(spark, [(i, text) for i in range(3)]).selectExpr("0L as block", "false as held_out", "text").coalesce(1)
    packed, bits = np.full(1 << 13, 255, np.uint8), 16
    shared = [spark.sparkContext.broadcast(packed)] * 2
    found = suffix_tree._met(rows, shared, bits, 3).groupBy("k").agg({"n": "sum", "key": "count"})
    assert sorted(tuple(r[c] for c in ("k", "count(key)", "sum(n)")) for r in found.collect()) == [
        (1, 80_001, 240_003), (2, 80_000, 240_000), (3, 79_999, 239_997), (4, 79_998, 239_994)
    ]


def test_scores_when_blocks_name_sequences_again(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "HELD_ROWS", 4)
    same_scores(spark, list(enumerate(some_texts(1, 60))))


def test_scores_with_many_parts_and_few_tasks(spark, monkeypatch):
    """Ranges of hashes and blocks that share tasks, sorted in them."""
    monkeypatch.setattr(suffix_tree, "PART_BYTES", 300)
    monkeypatch.setattr(suffix_tree, "MAX_TASKS", 2)
    same_scores(spark, list(enumerate(some_texts(5, 60))))


def test_a_block_hands_over_arrays(spark):
    """However many words and sequences a block has, it is two rows for each part, and its counts are whole."""
    texts = [" ".join(f"w{i}" for i in range(at, at + 3_000)) for at in range(0, 9_000, 1_000)]
    rows = table(spark, list(enumerate(texts))).selectExpr("doc_id % 3 as block", "doc_id = 0 as held_out", "text")
    packed, bits = np.full(1 << 13, 255, np.uint8), 16
    shared = [spark.sparkContext.broadcast(packed)] * 2
    counted = suffix_tree._counted(rows.coalesce(1).sortWithinPartitions("block"), shared, bits, 3, 2).cache()
    assert counted.groupBy("part", "block").count().filter("count <> 2").count() == 0
    merged = suffix_tree._merged_parts(counted, 2, 2).filter("kind <= 1").cache()
    assert [tuple(r) for r in merged.filter("kind = 1").selectExpr("sum(n)", "sum(gram)").collect()] == [(8 * 3_001, 10_001)]
    plain = suffix_tree._met(rows, shared, bits, 3).groupBy("k", "key", "prefix", "suffix").agg({"n": "sum"}).filter("sum(n) >= 2")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, merged.filter("kind = 0").select("k", "gram", "prefix", "suffix", "n").collect()))


def test_token_hashes_tell_words_apart():
    texts = [*ODD, "", "a b", "ab", None, " b", "Ab  aB\tq\x0bz", "é É\xa0x \x1c", "x" * 70_000 + " y", "x" * 70_001, "z" * 32, "z" * 33, "last"]
    column = pa.array(["left out", *texts], pa.string()).slice(1)
    hashes, lengths = token_hashes.token_hashes(column)
    words = [[m.encode() for m in helpers.TOKEN.findall(helpers.lower(t or ""))] for t in texts]
    assert lengths.tolist() == [len(w) + 1 for w in words]
    named = {}
    for word, key in zip([w for own in words for w in [*own, None]], hashes.tolist()):
        assert named.setdefault(word, key) == key
    assert len(set(named.values())) == len(named)
    assert token_hashes.token_hashes(pa.array([], pa.string()))[0].tolist() == []


# ------------------------------------------------------------------ filter audit


def plain_audit(rows, labels):
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    cells = []
    for doc_id, text, part in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows):
            fails.add("E")
        cells.append((part or "", fails, doc_id in good, doc_id in toxic))
    result = {}
    for part in {c[0] for c in cells}:
        mine = [c for c in cells if c[0] == part]
        totals = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                earlier = set(order[: step - 1])
                lost = [c for c in mine if f in c[1] and not c[1] & earlier]
                totals[f] += len(lost)
                result[part, "".join(order), step] = [
                    sum(not c[1] & (earlier | {f}) for c in mine), len(lost), sum(f in c[1] and bool(c[1] & earlier) for c in mine),
                    sum(c[1] == {f} for c in mine), sum(c[2] for c in lost), sum(c[3] for c in lost), f,
                ]
        for key, counts in result.items():
            if key[0] == part:
                counts[-1] = totals[counts[-1]]
    return result


def test_audit_equals_plain_counting(spark):
    texts = [*ODD, "word " * 300, " ".join(map(str, range(250))), " ".join(map(str, range(250))) + " |", "ABC", "ÀÉ x", None, "", "the"]
    rows = [(i, t, None, ["s", "t", None, ""][i % 4]) for i, t in enumerate(texts)]
    rows += [(None, "the", None, "s"), (3, "the", None, "s"), (3, "the", None, "t"), (2, "word " * 300, None, "t"), (None, None, None, None)]
    labels = [(0, 1, 0), (1, 0, 1), (3, 1, 1), (3, 0, 0), (4, None, 1), (None, 1, 1), (9, 1, None), (999, 1, 1)]
    found = filter_audit.audit_filters(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in found.collect()}
    assert got == plain_audit([(i, t, s) for i, t, _, s in rows], labels)
    assert len(got) == 600 * 3


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(table(spark, []), labels).collect() == []


# ------------------------------------------------------------------ collocations


def plain_collocations(rows, min_count, top, longest=5):
    total, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", helpers.lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    result = defaultdict(list)
    frequent = [(lang, p, a) for (lang, p), a in f.items() if len(p) > 1 and a >= min_count]
    for lang, p, a in frequent:
        around = [b for other, q, b in frequent if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 100 * a for b in around):
            continue
        n = total[lang]
        score, k = min((1000 * a * n // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        result[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n))
    out = []
    for lang, found in result.items():
        for rank, (score, a, phrase, l, r, n) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


@pytest.mark.parametrize("longest", [2, 5])
def test_collocations_equal_plain_counting(spark, longest):
    langs = ["en", None, "und", ""]
    rows = [(i, t, langs[i % 4]) for i, t in enumerate(some_texts(5, 80, vocabulary=8))] + [(i, t, "en") for i, t in enumerate(ODD)]
    found = collocations.mine_collocations(table(spark, rows), min_count=4, top=15, longest=longest).collect()
    assert sorted(map(tuple, found)) == plain_collocations([(t, lang) for _, t, lang in rows], 4, 15, longest)


def test_collocations_of_nothing(spark):
    assert collocations.mine_collocations(table(spark, [])).collect() == []
    assert collocations.mine_collocations(table(spark, [(1, None, "en"), (2, "", None), (3, "a. b", "en")])).collect() == []


def test_windows_survive_a_crowded_table(spark, monkeypatch):
    """With all words in a handful of buckets nothing is pruned, and nothing is lost."""
    monkeypatch.setattr(collocations, "table_bits", lambda rows: 4)
    rows = [(i, t, "en") for i, t in enumerate(some_texts(8, 50))]
    found = collocations.mine_collocations(table(spark, rows), min_count=3, top=50).collect()
    assert sorted(map(tuple, found)) == plain_collocations([(t, lang) for _, t, lang in rows], 3, 50)


def test_a_task_hands_over_a_window_once(spark, monkeypatch):
    """New words in later batches do not make a task hand over the same windows again."""
    monkeypatch.setattr(collocations, "HELD_WORDS", 2)
    rows = table(spark, [(i, t, "en") for i, t in enumerate(some_texts(5, 80) * 4)]).select("lang", "text").coalesce(1)
    tables = collocations.frequent_phrases(rows, 5, 4, 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        found = collocations.window_counts(rows, tables, 5).drop("n").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(set(found)) > 100


def test_splits_do_not_multiply_counting_tasks(spark, monkeypatch):
    """Partial counts grow with the tasks that count, so those do not grow with the splits of a table."""
    seen, real = [], collocations.window_counts
    monkeypatch.setattr(collocations, "window_counts", lambda rows, *a: seen.append(rows.rdd.getNumPartitions()) or real(rows, *a))
    texts = some_texts(5, 80, vocabulary=8)
    found = collocations.mine_collocations(table(spark, [(i, t, "en") for i, t in enumerate(texts)]).repartition(100), min_count=4, top=15).collect()
    assert seen == [2 * spark.sparkContext.defaultParallelism]
    assert sorted(map(tuple, found)) == plain_collocations([(t, "en") for t in texts], 4, 15)


# ------------------------------------------------------------------ word grams


@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=30), st.integers(1, 60))
@settings(max_examples=50, deadline=None)
def test_text_runs_cover_every_row_once(texts, size):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    runs = list(word_grams.text_runs(batch, size))
    assert [t for run in runs for t in run["text"].to_pylist()] == texts
    assert all(run.num_rows == 1 or sum(len((t or "").encode()) for t in run["text"].to_pylist()) <= size for run in runs)


def test_frequent_buckets_are_exact_without_collisions(spark):
    hashes = (np.arange(40, dtype=np.uint64) * np.uint64(7) + np.uint64(1)) << np.uint64(52)
    rows = spark.range(200).repartition(7)
    seen = spark.createDataFrame([(int(h),) for h in np.repeat(np.arange(40), np.arange(40))], "i int").repartition(5)

    def grams_of():
        def read(batch):
            yield hashes[batch["i"].to_numpy()]
        return read

    table_ = word_grams.frequent_grams(seen, grams_of, 12, 12)
    assert table_.frequent(hashes).tolist() == [i >= 12 for i in range(40)]
    assert rows.count() == 200
