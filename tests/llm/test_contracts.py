"""The columns, types and digests of every opN query on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from blockyard.llm import bpe, queries
from tests.llm.test_operators import prose, words
from tests.llm.test_repeats import brute

COLUMNS = {
    "op1_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_quotes": "conv_id bigint, turn bigint, role string, text string, n_quotes int, n_linked int, parent_turn bigint, root_turn bigint, depth bigint, reply_order bigint",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int, n_offending int",
    "op4_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double",
    "op7_repeats": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op9_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op10_decontaminate": "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint, containment double",
}


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def held(i, n, want):
    return zlib.crc32(str(i).encode()) % n == want


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(21)
    shared = "".join(rng.choices("abcdef ", k=450))
    texts = [None, "", " ", "One  two", "one two", "One two"]
    for i in range(150):
        t = prose(rng, rng.randint(5, 120)) if i % 3 else "BUY now!!! $$ " * rng.randint(4, 9) + str(i)
        if i % 5 == 0:
            t += ". you vile scum. " + prose(rng, 5)
        texts.append(t + (shared if i % 11 == 0 else ""))
    texts += texts[20:24]
    documents = [(i, t) for i, t in enumerate(texts)]
    labels = [(i, int(bool((i - 6) % 3)), int((i - 6) % 5 == 0)) for i in range(6, 140)]
    return documents, labels


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    documents, labels = tables
    path = tmp_path_factory.mktemp("contracts")
    rows = {
        "documents": (documents, "doc_id long, text string"),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "pages": ([(0, "http://a.net/de/x", "h"), (1, None, None)], "page_id long, url string, html string"),
        "benchmark": ([(0, documents[30][1][:200]), (1, "One two")], "item_id long, text string"),
        "conversations": ([(1, 0, "a", "hello there"), (1, 1, "b", "> hello there\nyes"), (2, 0, "a", None)], "conv_id long, turn long, role string, text string"),
    }
    for name, (own, schema) in rows.items():
        spark.createDataFrame(own, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def results(spark, folder):
    return {name: queries.QUERIES[name](spark, folder) for name in COLUMNS}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_types(results, name):
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in results[name].schema.fields) == COLUMNS[name]


def test_classifiers_hold_rows_out_and_cut_at_their_thresholds(results, tables):
    for name, n, want, at in (("op1_quality", 5, 0, 0.3), ("op3_toxicity", 3, 1, 0.7)):
        got = by_id(results[name])
        assert len(got) == len(tables[0])
        for i, r in got.items():
            assert r["held_out"] == held(i, n, want) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= at)


def test_bpe_digests(results, tables):
    ranks = dict(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(results["op5_bpe"])
    for i, t in tables[0]:
        ids = own.encode_ordinary(t or "")
        assert tuple(got[i]) == (i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))


def test_language_model_baseline(results, tables):
    count = Counter()
    for i, t in tables[0]:
        if not held(i, 10, 0):
            count.update([*words(t), None])
    total, distinct = sum(count.values()), len(count)
    for i, r in by_id(results["op6_lm_score"]).items():
        own = [*words(dict(tables[0])[i]), None]
        want = sum(np.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i, 10, 0), len(own), sum(count[w] > 0 for w in own), total)
        assert abs(r["base_score"] - want) < 1e-6 and r["score"] <= 0


def test_repeat_counts(results, tables):
    texts = [t for _, t in tables[0]]
    got = by_id(results["op7_repeats"])
    for (i, t), kept in zip(tables[0], brute(texts, 400)):
        raw = (t or "").encode()
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(raw), len(raw) - len(kept), sha(kept))
    assert any(r["n_spans"] for r in got.values())


def test_exact_groups_and_digests(results, tables):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in tables[0]:
        groups.setdefault(norm(t), []).append(i)
    for i, r in by_id(results["op8_exact_dedup"]).items():
        own = groups[norm(dict(tables[0])[i])]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(own), len(own), i == min(own), sha(norm(dict(tables[0])[i]).encode()))
