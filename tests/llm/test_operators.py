"""Operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from blockyard.llm import bpe, ctw, decontaminate, exact, near, quality, toxicity, url_filter, vectext
from blockyard.llm.queries import URL_RULES

CLASH = "doc_id long, text string, _row string, _sha string, _key string, _gone string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "r", "s", "k", "g") for i, t in rows], CLASH)


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# exact copies

EXACT = [(5, "a  b"), (3, "a b"), (3, "a b"), (9, "a\t\nb"), (7, None), (8, ""), (1, "alone"), (None, "a b"), (11, "x" * 300 + "1"), (12, "x" * 300 + "2"), (13, " "), (14, "  ")]


def test_exact_groups(spark):
    got = exact.exact_groups(table(spark, EXACT), hash_all=True).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in EXACT:
        groups.setdefault(norm(t), []).append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(EXACT)
    for r in got:
        ids = by_sha[r["sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == min(i for i in ids if i is not None)
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_drop_copies_keeps_columns_and_one_row_of_each(spark):
    docs = table(spark, EXACT)
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 7, 11, 12, 13]
    assert exact.drop_copies(docs.limit(0)).collect() == [] and exact.exact_groups(docs.limit(0)).collect() == []


# near copies


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        ws = words(t)
        sets.append({tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    return [(i, len(s), least[find(a)]) for a, ((i, _), s) in enumerate(zip(rows, sets))]


def near_rows():
    rng = random.Random(2)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE  two"), (5, "three"), (6, "long " * 3000)]
    for g in range(14):
        base = prose(rng, rng.randint(30, 120)).split()
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(99)}"
            rows.append((100 * g + len(rows), " ".join(own)))
    return rows + rows[10:14]


def test_near_groups_match_brute_force(spark):
    rows = near_rows()
    for k, percent in ((4, 80), (5, 80)):
        got = near.near_groups(table(spark, rows), k=k, percent=percent).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows, k, percent))
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_blocks_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 2)
    rng = random.Random(5)
    base = prose(rng, 60).split()
    rows = []
    for i in range(40):  # a chain of drifting texts: many share buckets, few are linked to the same leader
        base[rng.randrange(60)] = f"d{i}"
        rows.append((i, " ".join(base)))
    got = {r["doc_id"]: r["component_id"] for r in near.near_groups(table(spark, rows), k=4).collect()}
    assert got == {i: c for i, _, c in brute_components(rows, 4, 80)}


def test_near_empty_table(spark):
    docs = table(spark, [(1, "a")]).limit(0)
    assert near.near_groups(docs).collect() == [] and near.drop_near_copies(docs).collect() == []


def test_near_copies_go_row_by_row(spark):
    rng = random.Random(11)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (2, b), (2, f"{a} end"), (3, f"{b} end"), (None, f"{b} tail"), (None, prose(rng, 30)), (4, None), (4, "")]
    docs = table(spark, rows).withColumnRenamed("_sha", "_component")
    left = near.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == sorted((i is None, i or 0, t or "") for i, t in (rows[0], rows[1], rows[5], rows[6], rows[7]))


def test_large_disjoint_sets_share_no_band():
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 1 << 63, 1_500_000, dtype=np.uint64) << np.uint64(1)) for _ in range(2))
    one, two = near.signatures([a, b])
    assert not (near.band_keys(one) == near.band_keys(two)).any() and (one == two).mean() < 0.01
    both = np.unique(np.concatenate([a[:1_350_000], b[:150_000]]))
    assert (near.band_keys(one) == near.band_keys(near.signature(both))).any()


def test_recall_at_the_threshold():
    # pairs of similarity just over 0.8: the bands find all of 400
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(50, 400))
        every = rng.integers(0, 1 << 63, n + 2 * (n // 9) + 2, dtype=np.uint64) << np.uint64(1)
        cut = n // 9
        one, two = near.signatures([every[: n + cut], np.concatenate([every[:n], every[n + cut : n + 2 * cut]])])
        assert (near.band_keys(one) == near.band_keys(two)).any()


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 900, dtype=np.uint64) << np.uint64(1)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    assert abs((near.signature(a) == near.signature(b)).mean() - 0.8) < 0.15


# benchmark passages


@pytest.mark.parametrize("most, universe", [(decontaminate.COORDINATES, decontaminate.UNIVERSE), (40, 700)])
def test_contained_matches_brute_force(spark, monkeypatch, most, universe):
    monkeypatch.setattr(decontaminate, "COORDINATES", most)
    monkeypatch.setattr(decontaminate, "UNIVERSE", universe)
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randint(1, 80))) for i in range(25)] + [(30, None), (31, ""), (32, "tiny item"), (33, prose(rng, 600))]
    docs = [(0, None), (1, ""), (2, "holds Tiny\nITEM here")]
    for i in range(40):
        parts = [prose(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            if own and rng.random() < 0.5:
                own[rng.randrange(len(own))] = "changed"
            parts += [" ".join(own), prose(rng, 10)]
        docs.append((10 + i, " ".join(parts)))
    docs.append((99, " ".join(t for _, t in items if t)))  # holds every item: far larger than each
    docs += docs[5:7]
    want = set()
    for d, t in docs:
        ws = words(t)
        for i, text in items:
            own = words(text)
            k = min(5, len(own))
            if own:
                grams = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)}
                shared = len(grams & {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)})
                if 100 * shared >= 80 * len(grams):
                    want.add((d, i, shared, len(grams)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained(table(spark, docs), bench).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in got} == want
    left = {r["doc_id"] for r in decontaminate.drop_contaminated(table(spark, docs), bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, *_ in want}
    assert decontaminate.contained(table(spark, docs), bench.limit(0)).collect() == []
    lost = spark.createDataFrame([(None, f"so {items[0][1]} it", 1), (None, "clean", 2), (7, items[0][1], 3), (7, "clean too", 4)], "doc_id long, text string, _leak long")
    assert sorted(r["_leak"] for r in decontaminate.drop_contaminated(lost, bench).collect()) == [2, 4]
    assert decontaminate.contained(table(spark, docs).limit(0), bench).collect() == []


# URL rules


#: The rules as the query's contract states them, apart from the code's own list.
CONTRACT = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def brute_judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    best = None
    for rule, verdict in CONTRACT.items():
        h, _, rest = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return (host, path, *(best or (None, "allow")))


VERDICTS = {
    "http://shop.net/de/1": ("net/de/", "allow"),
    "http://net/de/": ("net/de/", "allow"),
    "http://example.net/de/7": ("net/de/", "allow"),
    "http://www.example.net/de/81": ("example.net/de/8", "block"),
    "http://a.com/en/7": ("com/en/", "block"),
    "http://a.example.com/en/7x": ("example.com/en/7", "allow"),
    "http://x.org/es/q": ("org/es/", "block"),
    "http://x.org/de/q": (None, "allow"),
}


@pytest.mark.parametrize("inline", [2000, 0])
def test_url_rules_match_brute_force(spark, inline):
    urls = [None, "", "x", "://", "http://com/en/", "http://A.Com/en/x", "http://example.com/en/70", "http://example.com/en/7?q", "http://sub.example.com/en/8", "http://notexample.net/de/8"]
    urls += [*VERDICTS, "http://example.net/de/8#a", "http://xcom/en/", "http://com/EN/", "a://b://com/en/", "http://org/es", "http://o.org/es/\nx", "http://com?/en/", "http://com/en/" + "y" * 9000, "http://example.com/en/7"] * 2
    rows = [(i, u, "a", "b", "c", "d") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, _key string, _best string, _rule string")
    rules = [url_filter.Rule.prefix(v, t) for v, t in URL_RULES]
    got = {r["page_id"]: r for r in url_filter.judge(pages, rules, inline=inline).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == brute_judge(u), u
        assert got[i]["_key"] == "b" and got[i]["_rule"] == "d"
        if u in VERDICTS:
            assert (got[i]["rule"], got[i]["verdict"]) == VERDICTS[u]
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules, inline=inline).collect() == []


# byte-level BPE


def test_bpe_equals_tiktoken_and_decodes(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\x85", "a", "é", "1", "²", "'s", "'ll", "!", "日本", "\U0001f600", "\r\n", "word", "<|endoftext|>"]
    texts = [None, "", "x" * 5000, "ab " * 3000, "日" * 2000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = table(spark, list(enumerate(texts)))
    out = bpe.encode(docs, path, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == own.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode()
    again = bpe.decode(out.drop("decoded").withColumn("decoded", F.lit("clash")), path)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in again.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.encode(docs.limit(0), path, public_tokenizers.PATTERN).collect() == []


def test_splitter_equals_the_pattern():
    assert bpe.KNOWN == public_tokenizers.PATTERN
    import regex

    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\x85", "\xa0", "\u3000", "\x1c", "a", "B", "é", "e\u0301", "1", "²", "'", "'s", "'S", "'re", "'r", "'ll", "'l", "'ve", "'d", "!", "-", "日本", "\U0001f600", "\r\n", "word", "\0", "٣", "x'tis", "don't"]
    texts = ["", "'", "'s", " 's", "\n's", "'s's", "x 'll", "  a", " \na", "a  ", "''s", "'re'"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    starts, ends = bpe.Splitter()(np.frombuffer(b"".join(raw), np.uint8), off)
    want = [m.encode() for t in texts for m in regex.findall(bpe.KNOWN, t)]
    whole = b"".join(raw)
    assert [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())] == want


def test_bpe_of_long_texts_and_other_patterns(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    rng = random.Random(8)
    texts = ["".join(rng.choice([" ", "  ", "word ", "é", "'s ", "\n", "12", "!"]) for _ in range(4000)), "x" * 3000 + " y" * 700, "ab cd"]
    for pattern in (public_tokenizers.PATTERN, r"\S+|\s+"):
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})
        encoder = bpe.Encoder(ranks, pattern)
        for piece in (1 << 20, 500, 64):
            monkeypatch.setattr(bpe, "PIECE", piece)
            ids, ends = bpe.TextEncoder(encoder)(bpe.pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [own.encode_ordinary(t) for t in texts]


def test_long_runs_encode_like_tiktoken():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(2)
    for t in ("".join(rng.choices("abcde", k=70_000)), "x" * 66_000):
        assert encoder.merge(t.encode()) == own.encode_ordinary(t)


LONG_TEXT = 20 << 20


def test_texts_of_twenty_megabytes_stay_within_memory():
    """Peak memory of each operator's work on one text, beyond the text, its arrays of results and some margin."""
    import tracemalloc

    from blockyard.llm import repeats

    rng = np.random.default_rng(0)
    vocabulary = np.array([f"w{i}" for i in range(20_000)])
    text = " ".join(rng.choice(vocabulary, LONG_TEXT // 6))[:LONG_TEXT]
    ((_, _, buf, off),) = vectext.slices(bpe.pa.array([text]))
    model, vectors = toxicity.NoisyOr(np.arange(5, dtype=np.uint64)), np.zeros((1 << quality.BITS, quality.DIMS), np.float32)
    encoder = bpe.TextEncoder(bpe.Encoder(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN))
    column = bpe.pa.array([text])

    def segments():
        for _, _, _, own, ends in vectext.pieces(column.cast("binary"), repeats.PIECE, repeats.LENGTH - 1):
            repeats.segments(own, ends, repeats.LENGTH, repeats.CORE)

    def grams():
        for _, g in ctw.gram_pieces(buf, off):
            np.unique(g)

    work = {
        "op1": lambda: quality.pool(*quality.tokens(buf, off), 1, vectors),
        "op3": lambda: model.sentences(*toxicity.instances(buf, off)[:2]),
        "op5": lambda: encoder(column),
        "op6": grams,
        "op7": segments,
        "op9": lambda: near.signatures(vectext.shingles(*vectext.words(buf, off), 1, 5)),
    }
    for name, f in work.items():
        tracemalloc.start()
        f()
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert peak < 400 << 20, (name, peak >> 20)


def test_perfect_hash_is_minimal_and_knows_strangers():
    keys = [str(i).encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slots.tolist()) == list(range(3000)) and [h.get(k) for k in keys] == list(range(3000))
    assert all(h.get(f"x{i}".encode()) == -1 for i in range(3000)) and bpe.PerfectHash([]).get(b"a") == -1


# language-model scores


def test_base_score_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (2, "New  words ONLY here")] + [(i, prose(rng, rng.randint(1, 40), 50)) for i in range(3, 60)]
    held = lambda i: i % 4 == 0
    from collections import Counter

    count = Counter()
    for i, t in rows:
        if not held(i):
            count.update([*words(t), None])
    total, distinct = sum(count.values()), len(count)
    out = ctw.score(table(spark, rows), F.col("doc_id") % 4 != 0, words=20)
    for r in out.collect():
        own = [*words(dict(rows)[r["doc_id"]]), None]
        want = sum(np.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        assert abs(r["base_score"] - want) < 1e-6 and r["n_tokens"] == len(own)
        assert r["n_known"] == sum(count[w] > 0 for w in own) and r["train_tokens"] == total
        assert r["score"] <= 0 and (r["n_bytes"] == 0 or r["bits_per_byte"] < 8)
    assert ctw.score(table(spark, rows).limit(0), F.lit(True)).collect() == []


def test_context_tree_probabilities_add_up_to_one():
    buf = np.frombuffer(b"abracadabra abracadabra simsalabim " * 5, np.uint8)
    g = ctw.grams(buf, np.array([0, len(buf)]))
    pairs = []
    for d in range(ctw.DEPTH + 1):
        key, n = np.unique(g & ((1 << 8 * (d + 1)) - 1), return_counts=True)
        pairs.append((key >> 8, key & 255, n))
    tree = ctw.Tree(pairs)
    for context in (g[40] >> 8, g[100] >> 8, 0, 0x7A7A7A7A7A):
        every = (np.int64(context) << 8) | np.arange(256)
        assert abs((10.0 ** tree.score(every)).sum() - 1) < 1e-4
    assert -tree.score(g).mean() / np.log10(2) < 2.0


@pytest.mark.parametrize("pairs", [30, ctw.PAIRS])
def test_score_uses_every_context(spark, monkeypatch, pairs):
    monkeypatch.setattr(ctw, "CHUNK", 50, raising=False)
    rng = random.Random(8)
    rows = [(0, None), (1, ""), (4, "never seen \U0001f600 Zq"), (5, "\0\0")] + [(i, prose(rng, rng.randint(1, 40), 90)) for i in range(6, 90)]
    rows += [(90, "only here \x7f"), (91, None), (91, "w1 w2")]
    raw = [(t or "").encode() for i, t in rows]
    taught = [t for (i, _), t in zip(rows, raw) if i % 4]
    every = lambda texts: ctw.grams(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    g = every(taught)
    tree = []
    for d in range(ctw.DEPTH + 1):
        key, n = np.unique(g & ((1 << 8 * (d + 1)) - 1), return_counts=True)
        tree.append((key >> 8, key & 255, n))
    tree = ctw.Tree(tree)
    want = sorted((i, round(float(tree.score(every([t])).sum()) if t else 0.0, 3)) for (i, _), t in zip(rows, raw))
    got = sorted((r["doc_id"], r["score"]) for r in ctw.score(table(spark, rows), F.col("doc_id") % 4 != 0, pairs=pairs).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 2e-3 for (_, a), (_, b) in zip(got, want))


def test_grams_do_not_depend_on_pieces():
    buf = np.frombuffer(b"abracadabra" * 9, np.uint8)
    off = np.array([0, len(buf)])
    whole = ctw.grams(buf, off)
    for limit in (1, 4, 7, 50):
        parts = list(ctw.gram_pieces(buf, off, limit))
        assert np.concatenate([g for _, g in parts]).tolist() == whole.tolist() and [a for a, _ in parts] == list(range(0, len(buf), limit))


def test_krichevsky_trofimov_blocks():
    for a, b in ((0, 0), (1, 0), (3, 2), (0, 7)):
        p, za, zb = 1.0, 0, 0
        for bit in [0] * a + [1] * b:
            p *= ((zb if bit else za) + 0.5) / (za + zb + 1)
            za, zb = za + (1 - bit), zb + bit
        assert abs(ctw.kt(np.array([a]), np.array([b]))[0] - np.log(p)) < 1e-9


# classifiers


def test_quality_learns_and_handles_odd_rows(spark):
    rng = random.Random(6)
    rows = [(i, " ".join((f"good{rng.randrange(40)} line." if i % 2 else f"BUY{rng.randrange(40)} !!! $$") for _ in range(rng.randint(5, 30)))) for i in range(600)]
    rows += [(900, None), (901, ""), (902, "x" * 200_000)] + rows[:3]
    labels = spark.createDataFrame([(i, i % 2 if i % 7 else None) for i in range(500)] + [(None, 1)], "doc_id long, quality int")
    docs = table(spark, rows)
    got = quality.score(docs, labels, F.col("doc_id") % 5 != 0).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] < 600 and (r["doc_id"] % 5 == 0 or r["doc_id"] >= 500)]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in held]) > 0.95
    assert {r["score"] for r in quality.score(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels, F.lit(True)).collect() == []


def naive_tokens(text):
    return [m for m in re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9\x20\x09-\x0D]+", (text or "").encode())]


@pytest.mark.parametrize("chunk", [3, quality.CHUNK])
def test_word_vectors_and_pools_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(quality, "CHUNK", chunk)
    rng = random.Random(3)
    texts = [None, "", "one", "Éa a!a 12", "a a a b"] + [" ".join(rng.choice(["ab", "Ab", "12", "--", "é", "x1!"]) for _ in range(rng.randint(1, 30))) for _ in range(20)]
    docs = table(spark, list(enumerate(texts)))
    hashed = lambda t: int(vectext.span_hash(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0])
    vectors = np.zeros((1 << quality.BITS, quality.DIMS))

    def index(t):
        v = np.zeros(quality.DIMS)
        for i in range(quality.NONZERO):
            x = hashed(t) >> 8 * i & ((1 << 63) - 1)
            v[np.int64(np.uint64(hashed(t)) >> np.uint64(8 * i)) % quality.DIMS] += 1 if x >> 6 & 1 else -1
        return v

    for t in texts:
        own = naive_tokens(t)
        for i, a in enumerate(own):
            for b in own[max(0, i - quality.WINDOW) : i] + own[i + 1 : i + 1 + quality.WINDOW]:
                vectors[hashed(a) >> 64 - quality.BITS] += index(b)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    want = np.where(norm > 0, vectors / np.maximum(norm, 1e-9), 0)
    got = quality.word_vectors(docs)
    assert np.allclose(got, want, atol=1e-5)
    for r in quality.pooled(docs.select("doc_id", "text", "_row"), got).collect():
        own = naive_tokens(texts[r["doc_id"]])
        p = np.array(r["pool"])
        if not own:
            assert not p.any()
            continue
        v = np.array([want[hashed(t) >> 64 - quality.BITS] for t in own])
        assert np.allclose(p[: quality.DIMS], v.mean(axis=0), atol=1e-4) and np.allclose(p[quality.DIMS : 2 * quality.DIMS], v.std(axis=0), atol=2e-3)
        again = sum(a == b for a, b in zip(own, own[1:]))
        assert np.allclose(p[2 * quality.DIMS :], [np.log1p(len(own)) / 10, len(set(own)) / len(own), np.linalg.norm(v.mean(axis=0)), again / len(own)], atol=1e-4)


def test_network_gradient_steps_lower_the_loss_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (4000, quality.WIDTH))
    p = 1 / (1 + np.exp(-x[:, 0] - x[:, 1]))
    y = (rng.random(4000) < p).astype(float)
    net = quality.Network().fit(x[:3000], y[:3000])
    q = net.predict(x[3000:])
    loss = lambda q: -np.mean(y[3000:] * np.log(q) + (1 - y[3000:]) * np.log(1 - q))
    assert loss(q) < loss(np.full(1000, y.mean())) - 0.05
    bins = np.digitize(q, [0.2, 0.4, 0.6, 0.8])
    assert all(abs(q[bins == b].mean() - y[3000:][bins == b].mean()) < 0.15 for b in range(5))


def test_toxicity_locates_the_sentence(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        own = [" ".join(f"plain{rng.randrange(60)}" for _ in range(6)) + "." for _ in range(rng.randint(2, 8))]
        if i % 3 == 0:
            own[rng.randrange(len(own))] = "you vile scum go away."
        rows.append((i, " ".join(own)))
    rows += [(900, None), (901, ""), (902, "é" * 100_000)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    docs = table(spark, rows)
    model = toxicity.train(docs, labels, F.lit(True))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for i, t in rows[400:600]:
        assert (got[i]["score"] >= 0.7) == (i % 3 == 0)
        said = [t.encode()[s["start"] : s["end"]] for s in got[i]["spans"]]
        assert len(said) == (i % 3 == 0) and all(b"vile scum" in s for s in said)
    assert got[900]["score"] == got[901]["score"] == model.leak < 0.05 and got[901]["spans"] == [] and got[902]["score"] < 0.5
    silent = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert max(r["score"] for r in toxicity.score(docs, silent).collect()) < 1e-6
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_toxicity_does_not_grow_with_wordless_or_plain_sentences(spark):
    rng = random.Random(7)
    plain = lambda: " ".join(f"plain{chr(97 + rng.randrange(26))}" for _ in range(6)) + ". "
    rows = [(i, plain() * 3 + ("you vile scum. " if i % 3 == 0 else "") + plain()) for i in range(300)]
    more = [(900, "Hello"), (901, "Hello" + "." * 20_000), (902, "\n\n" * 5000), (903, plain() * 5000), (904, "Hello. you VILE scum!" + "?" * 3000), (904, "same id, clean")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x", "y") for i in range(300)], "doc_id long, toxic int, _lid string, _y string")
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows + more], "doc_id long, text string, _lid string, _y string, _id string")
    model = toxicity.train(docs, labels, F.lit(True))
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "score", "spans"]
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r["doc_id"], []).append(r["score"])
    assert by_id[900] == by_id[901] == by_id[902] and max(by_id[900] + by_id[903]) < 0.05
    assert max(by_id[904]) > 0.7 and min(by_id[904]) < 0.05 and len(by_id[904]) == 2


def test_noisy_or_matches_brute_force_and_its_gradient():
    rng = np.random.default_rng(1)
    words = np.arange(5, dtype=np.uint64) + np.uint64(10)
    model = toxicity.NoisyOr(words)
    # documents of sentences of words
    docs = [[[0, 1], [2]], [[3]], [[1, 4], [0], [2, 3]], [[4]]]
    y, c, plain = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 0.5, 1]), np.array([7.0, 2.0])
    owner = np.array([d for d, x in enumerate(docs) for _ in x])
    flat = [w for x in docs for w in x]
    row, word = np.array([i for i, x in enumerate(flat) for _ in x]), np.array([w for x in flat for w in x])
    w, b, leak = rng.normal(0, 1, 5), -0.7, -2.0
    sigmoid = lambda z: 1 / (1 + np.exp(-z))

    def brute(w, b, leak):
        total = 0.0
        for x, label, weight in zip(docs, y, c):
            q = 1 - (1 - sigmoid(leak)) * np.prod([1 - sigmoid(b + sum(w[k] for k in s)) for s in x])
            total -= weight * np.log(q if label else 1 - q)
        total -= plain[0] * np.log(1 - sigmoid(leak)) + plain[1] * np.log(sigmoid(leak))
        return (total + model.decay * (w @ w) / 2) / (c.sum() + plain.sum())

    value, gw, gb, gl = model.loss(w, b, leak, owner, row, word, y, c, plain)
    assert abs(value - brute(w, b, leak)) < 1e-9
    e = 1e-6
    for i in range(5):
        step = np.eye(5)[i] * e
        assert abs(gw[i] - (brute(w + step, b, leak) - brute(w - step, b, leak)) / (2 * e)) < 1e-6
    assert abs(gb - (brute(w, b + e, leak) - brute(w, b - e, leak)) / (2 * e)) < 1e-6
    assert abs(gl - (brute(w, b, leak + e) - brute(w, b, leak - e)) / (2 * e)) < 1e-6


@pytest.mark.parametrize("limit", [toxicity.SAMPLE, 60])
def test_toxicity_learns_rare_words_of_all_labelled_rows(spark, limit):
    rng = random.Random(9)
    rows, toxic = [], {}
    for i in range(600):
        own = [" ".join(f"plain{chr(97 + rng.randrange(26))}" for _ in range(6)) + "." for _ in range(rng.randint(2, 8))]
        toxic[i] = int(i % 10 == 0)
        if toxic[i]:
            own[rng.randrange(len(own))] = f"plainb {'stupid' if i % 120 == 0 else 'vile'} plainc."
        rows.append((i, " ".join(own)))
    rows += [(900, "Plaina plainb. This is stupid stuff. Plainc."), (901, "Plaina plainb. This is other stuff. Plainc.")]
    docs = table(spark, rows)
    labels = spark.createDataFrame(sorted(toxic.items()), "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True), limit=limit)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert got[900] >= 0.7 and got[901] < 0.5
    assert all((got[i] >= 0.7) == bool(t) for i, t in toxic.items())


@pytest.mark.parametrize("limit", [1, 3, 7, 1 << 20])
def test_tokens_do_not_depend_on_pieces(limit):
    texts = [b"", b"One two\tTHREE", b" ", b"lone", b"a" * 40, b"", "é one  two ".encode()]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    h, doc = vectext.words(buf, off, limit)
    own = [(w.lower(), i) for i, t in enumerate(texts) for w in re.split(rb"[\x20\x09-\x0D]+", t) if w]
    assert doc.tolist() == [i for _, i in own]
    flat = np.frombuffer(b"".join(w for w, _ in own), np.uint8)
    ends = np.cumsum([len(w) for w, _ in own])
    assert h.tolist() == vectext.span_hash(flat, ends - [len(w) for w, _ in own], ends).tolist()


def test_lookup_table_finds_keys():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64)
    t = vectext.Table(keys)
    assert (t.find(keys) == np.arange(5000)).all() and (t.find(keys + np.uint64(1)) == -1).all()
