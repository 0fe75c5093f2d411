"""The queries of the subpackage against SQL or plain versions, over whole small tables."""

import corpus_pipeline
import helpers
import numpy as np
import oracle
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taskatlas.llm import packing, toxicity
from taskatlas.llm.catalog import LLM_ORACLES, LLM_QUERIES
from taskatlas.llm.url_filter import RULES

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "contamination", "private_values", "packing"]


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_against_sql(spark, sf_dir, con, name):
    assert oracle.differences(LLM_QUERIES[name](spark, sf_dir), con, LLM_ORACLES[name]) == []


def test_pseudonyms(spark, sf_dir, documents):
    rows = LLM_QUERIES["op2_pseudonyms"](spark, sf_dir).collect()
    assert len(rows) == len(documents)
    assert any(r["n_values"] for r in rows)
    for r in rows:
        assert (r["text"] != documents[r["doc_id"]]["text"]) == (r["n_values"] > 0)


def test_urls_follow_the_rules(spark, sf_dir):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = LLM_QUERIES["op3_judge_urls"](spark, sf_dir).collect()
    assert len(rows) == len(urls)
    for r in rows:
        rest = urls[r["page_id"]].partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = helpers.lower(rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
        fits = [(t, v) for t, v in RULES if (host == t.partition("/")[0] or host.endswith("." + t.partition("/")[0])) and path.startswith("/" + t.partition("/")[2])]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = LLM_QUERIES["op4_toxicity"](spark, sf).filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert toxic and clean
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in clean] for a in toxic]) > 0.8


def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = LLM_QUERIES["op5_language"](spark, sf).filter("held_out").join(langs, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = LLM_QUERIES["op10_quality"](spark, sf).filter("held_out").join(labels, "doc_id").collect()
    poor, fair = [r["tail"] for r in rows if not r["quality"]], [r["tail"] for r in rows if r["quality"]]
    assert np.mean([[a < b for b in fair] for a in poor]) > 0.9


def check_packed(rows, texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    total = 0
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        own = sorted(pieces[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 2048 for r in own[1:])
        for r in own:
            assert packing.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= 2048
    return len(places), -(-total // 2048)


def test_packing_is_whole_and_tight(spark, sf_dir, documents):
    used, least = check_packed(LLM_QUERIES["op8_pack"](spark, sf_dir).collect(), {i: d["text"] for i, d in documents.items()})
    assert used <= least + 2


def test_notices(spark, sf_dir, documents):
    for r in LLM_QUERIES["op9_notices"](spark, sf_dir).collect():
        own = helpers.words(documents[r["doc_id"]]["text"])
        places = [
            (i, label)
            for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
            for i in range(len(own))
            if own[i : i + len(phrase.split())] == phrase.split()
        ]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"]) == (len(own), len(places))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_pipeline_stage_by_stage(spark, sf_dir):
    """Each stage against a plain version of it, given what the stage before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "packing":
            check_packed(out.collect(), {i: d["text"] for i, d in before.items()})
            break
        assert out.columns == names
        docs = corpus_pipeline.stored(out, "test-stage")
        after = {r["doc_id"]: r for r in docs.collect()}
        texts = {i: d["text"] for i, d in before.items()}
        if name == "toxicity":
            model = toxicity.fit_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
            assert set(after) == {i for i, t in texts.items() if model.judge(t)[0] < 0.5}
        if name == "near_duplicates":
            assert set(after) == {i for i, (_, least) in helpers.component_ids(texts).items() if i == least}
        if name == "contamination":
            assert set(after) == {i for i, t in texts.items() if not helpers.hit_words(t, items)[0]}
        if name == "private_values":
            assert set(after) == set(before)
            assert all(d["n_chars"] == len(d["text"]) for d in after.values())
        else:
            assert all(after[i] == before[i] for i in after)
        before = after
