"""Repeated strings against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from blockyard.llm import bwt, common, repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(bytes(b for b, g in zip(t, gone) if not g))
    return out


@pytest.mark.parametrize("most, piece", [(5000, 1 << 18), (1, 1 << 18), (6, 60)])
def test_spans_match_brute_force(spark, most, piece):
    rng = random.Random(4)
    parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    texts = [None, "", "short", "x" * 200, "ab" * 90]
    for _ in range(60):
        t = "".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8)))
        texts.append(t)
    texts += texts[10:20]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, _row string")
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs, length=24, core=16, most=most, piece=piece).collect()}
    assert len(got) == len(texts)
    for i, kept in enumerate(brute(texts, 24)):
        assert bytes(got[i]["kept"]) == kept, i
        assert got[i]["n_bytes"] - sum(s["end"] - s["start"] for s in got[i]["spans"]) == len(kept)


def test_production_lengths_and_a_text_over_two_megabytes(spark):
    rng = random.Random(6)
    make = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared, edge = make(900), make(400)
    long = make(1_100_000) + shared + make(1_000_000) + edge + make(300_000)
    texts = [long, make(500) + shared + make(10), edge, edge[:399], make(3000), "x" * 900, "y" * 400, "z" * 401, None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, texts[4]), (4, texts[4])]
    got = {}
    for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, kept in enumerate(brute([t for _, t in rows], 400)[:10]):
        assert all(bytes(r["kept"]) == kept for r in got[i]), i
    assert len(got[4]) == 2 and [(s["start"], s["end"]) for s in got[4][0]["spans"]] == [(0, 3000)]


def test_a_copied_text_is_looked_at_once(spark, monkeypatch):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    one, other = make(1500), make(1500)
    texts = [one] * 40 + [other, make(300) + one[200:900] + make(300), other[:700] + make(200), "z" * 399, "z" * 399]
    rows, write = {}, repeats.materialize

    def counted(df, name, *how):
        out = write(df, name, *how)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(repeats, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 400)
    assert rows["repeat-segments"] < 40 * len(one) / 101  # each copy alone has more than its windows over 101


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_dir", lambda _: f"file://{tmp_path}")
    out = repeats.remove_repeats(spark.createDataFrame([(1, "a" * 900), (2, "b")], "doc_id long, text string"))
    kinds = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert kinds == {"blockyard-repeat-docs", "blockyard-repeat-spans"} and out.count() == 2


class Unset:
    """A session whose settings name no shared folder."""

    def __init__(self, master):
        self.conf, self.sparkContext, self.master = {}, self, master


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    monkeypatch.setattr(common, "_local", [])
    with pytest.raises(ValueError):
        common.scratch_dir(Unset("spark://host:7077"))
    assert common.scratch_dir(Unset("local[4]")) == common.scratch_dir(Unset("local[4]")) == common._local[0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(docs).collect() == []


def test_merge_finds_repeats_across_shards():
    rng = np.random.default_rng(0)
    for _ in range(40):
        strings = [rng.integers(1, 4, rng.integers(0, 30)).astype(np.int32) for _ in range(rng.integers(1, 8))]
        length = int(rng.integers(1, 8))
        seen = Counter(tuple(s[i : i + length]) for s in strings for i in range(len(s) - length + 1))
        want = [i + length <= len(s) and seen[tuple(s[i : i + length])] > 1 for s in strings for i in range(len(s))]
        assert bwt.repeated(strings, length, per_shard=int(rng.integers(1, 60))).tolist() == want


def test_merge_gives_common_prefixes():
    rng = np.random.default_rng(1)
    strings = [rng.integers(1, 3, 12).astype(np.int32) for _ in range(6)]
    shards = [bwt.Shard(np.concatenate([np.append(s, 0) for s in strings[i : i + 2]]).astype(np.int16)) for i in (0, 2, 4)]
    z, place, _, common = bwt.merge(shards, 20)
    texts = [np.concatenate([np.append(s, 0) for s in strings[i : i + 2]]) for i in (0, 2, 4)]

    def suffix(k):
        t = texts[z[k]][place[k] :].tolist()
        return t[: t.index(0)]

    for k in range(1, len(z)):
        a, b = suffix(k - 1), suffix(k)
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert a <= b and common[k] == n


def test_a_single_shard_gives_what_the_rounds_give():
    rng = np.random.default_rng(2)
    none = bwt.Shard(np.zeros(0, np.int16))
    for _ in range(40):
        shard = bwt.Shard(np.concatenate([np.append(rng.integers(1, 3, rng.integers(0, 40)), 0) for _ in range(rng.integers(1, 9))]).astype(np.int16))
        depth = int(rng.integers(1, 30))
        assert shard.common(depth).tolist() == bwt.merge([shard, none], depth)[3].tolist()
        for alone, rounds in zip(bwt.merge([shard], depth), bwt.merge([shard, none], depth)):
            assert alone.tolist() == rounds.tolist()
