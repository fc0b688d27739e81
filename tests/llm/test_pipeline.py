"""The pipeline's stages, one after the other, and the whole against brute force on a small fixture."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from blockyard.llm import bpe, quality
from blockyard.llm.common import crc_mod
from tests.llm.test_operators import brute_components, prose, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(12)
    items = [(0, prose(rng, 30)), (1, "short item"), (2, None)]
    texts = {i: "BUY now!!! $$ " * rng.randint(4, 9) + f"{i}" if i % 3 == 0 else prose(rng, rng.randint(20, 60)) + "." for i in range(160)}
    for i in (31, 61, 91):
        texts[i] = texts[1].replace(" ", "  ")  # equal but for white space
    for i in (34, 64, 94):
        texts[i] = texts[4].replace(".", f" tail{i}.")  # nearly equal
    for i in (37, 67):
        texts[i] = f"{texts[i]} {items[i % 3 - 1][1]} {texts[i]}"
    texts[40] = "it holds a SHORT\nitem here"
    texts |= {200: None, 201: "", 202: "é \U0001f600 x"}
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in texts.items()]
    labels = [(i, int(i % 3 != 0), 0) for i in range(160) if i % 2]
    return rows, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, items = fixture()
    path = tmp_path_factory.mktemp("pipeline")
    for name, own, schema in (("documents", rows, COLUMNS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(own, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def brute_exact(rows):
    least = {}
    for r in rows:
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    keep = {min(ids) for ids in least.values()}
    return [r for r in rows if r[0] in keep]


def brute_near(rows):
    keep = {i for i, _, c in brute_components([r[:2] for r in rows], 5, 80) if i == c}
    return [r for r in rows if r[0] in keep]


def brute_clean(rows, items):
    def holds(text, item):
        own, ws = words(item), words(text)
        k = min(5, len(own))
        if not own:
            return False
        grams = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)}
        return 100 * len(grams & {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)}) >= 80 * len(grams)

    return [r for r in rows if not any(holds(r[1], t) for _, t in items)]


def brute_encode(rows):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for i, t, lang, source, _ in rows:
        ids = own.encode_ordinary(t or "")
        out.append((i, lang, source, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()), ids))
    return out


def test_stages_and_run_match_brute_force(spark, folder):
    rows, _, items = fixture()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # a classifier has no brute force: what the stage adds to it is the rule by which rows go
    scored = quality.score(docs, spark.read.parquet(f"{folder}/labels.parquet"), crc_mod(F.col("doc_id"), 5) != 0)
    bad = {r["doc_id"] for r in scored.collect() if r["score"] < corpus_pipeline.LEAST_QUALITY}
    want = {"quality": lambda x: [r for r in x if r[0] not in bad], "exact_dedup": brute_exact, "near_dedup": brute_near, "decontaminate": lambda x: brute_clean(x, items), "encode": brute_encode}
    assert [name for name, _ in corpus_pipeline.STAGES] == list(want)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        expected = want[name](rows)
        if name == "encode":
            assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
        else:
            assert out.schema.simpleString() == docs.schema.simpleString() and 0 < len(expected) < len(rows), name
        got = sorted(tuple(r) for r in out.collect())
        assert got == sorted(expected), name
        if name != "encode":
            rows, docs = expected, spark.createDataFrame(expected, COLUMNS)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == got


def test_stages_handle_nulls_repeats_empty_tables_and_clashing_columns(spark, folder):
    rows, _, _ = fixture()
    odd = [(None, None), (None, "BUY now!!! $$ " * 6), (None, "kind words here. " * 3), (3, rows[1][1]), (3, rows[1][1]), (500, ""), (500, "  "), (501, "x" * 300_000)]
    names = ("_bad", "_digest", "_gone", "_row", "_sha", "_leak", "_id", "_text", "_y", "_lid")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *names) for r in [*rows, *[(i, t, None, None, None) for i, t in odd]]], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        left = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert 0 < len(left) <= docs.count(), name
        assert name == "quality" or {(501, "x" * 300_000), (None, "kind words here. " * 3)} <= set(left), name
        assert stage(spark, docs.limit(0), folder).collect() == [], name
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert encoded.count() == docs.count() and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).collect() == []
    only_nulls = spark.createDataFrame([(None, None, None, None, None)], COLUMNS)
    assert all(stage(spark, only_nulls, folder).count() <= 1 for _, stage in corpus_pipeline.STAGES)
