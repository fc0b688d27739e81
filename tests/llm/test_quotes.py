"""Quotation linking on small conversations."""

import random

from blockyard.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows):
    return {(r["conv_id"], r["turn"]): r for r in quotes.link(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_parse_levels():
    own, found = quotes.parse("> > old\n> asked\n> again\nmine\n>\n")
    assert own == "mine"
    assert found == [(2, "old"), (1, "asked\nagain"), (1, "")]
    assert quotes.parse(None) == ("", [])


def test_links_and_order(spark):
    rows = [
        (1, 0, "a", "First thing.\n\nSecond thing."),
        (1, 1, "b", "Unrelated"),
        (1, 2, "a", "> second   THING.\nYes"),
        (1, 3, "b", "> > second thing.\n> yes\nNo"),
        (1, 4, "a", "> never said\nhm"),
        (1, 5, "a", "> Unrelated\n> words\nsplit by lines"),
        (2, 7, "a", "> First thing.\nother conversation"),
        (2, 8, "b", None),
        (None, 0, "a", "lost"),
        (3, None, "a", "> lost"),
    ]
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert {k: r["parent_turn"] for k, r in got.items() if k[0] == 1} == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 2, (1, 4): 3, (1, 5): 1}
    assert got[1, 3]["depth"] == 2 and got[1, 3]["root_turn"] == 0 and got[1, 3]["n_linked"] == 2
    assert got[1, 2]["text"] == "Yes" and got[1, 4]["n_quotes"] == 1 and got[1, 4]["n_linked"] == 0
    assert got[2, 7]["parent_turn"] is None and got[2, 7]["depth"] == 0
    assert got[2, 8]["text"] == "" and got[2, 8]["parent_turn"] == 7
    assert got[None, 0]["depth"] is None and got[3, None]["text"] == ""


def test_long_chain_and_repeats(spark):
    rows = [(1, i, "a", f"m{i}") for i in range(70)] + [(1, 5, "a", "m5")]
    got = quotes.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 71 and all(r["depth"] == r["turn"] and r["root_turn"] == 0 for r in got)


def test_reply_order_of_branching_threads(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for c in range(25):
        under, text = {}, {}
        for t in [t for t in range(40 if c else 300) if rng.random() < 0.9]:
            said = f"message {c} number {t}"
            quoted = rng.choice([*text, None]) if c % 5 else 0 if 0 in text else None  # every fifth: all answer the first
            parent = quoted if quoted is not None else t - 1 if t - 1 in text else None
            rows.append((c, t, "a", said if quoted is None else f"> {text[quoted]}\n{said}"))
            text[t] = said
            under.setdefault(parent, []).append(t)
        stack = under.get(None, [])[::-1]
        while stack:
            t = stack.pop()
            want[c, t] = len([k for k in want if k[0] == c])
            stack += under.get(t, [])[::-1]
    rng.shuffle(rows)
    got = run(spark, [*rows, (None, 1, "a", "x"), (7, None, "a", "x")])
    assert got.pop((None, 1))["reply_order"] is None and got.pop((7, None))["reply_order"] is None
    assert {k: r["reply_order"] for k, r in got.items()} == want


def brute(rows):
    """parent, root, depth of each message by reading every earlier one of its conversation."""
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((t, quotes.parse(x)) for cc, t, _, x in rows if cc == c)
        parent = {}
        for t, (_, quoted) in own:
            found = []
            for level, passage in quoted:
                before = [(u, set(quotes.passages(o))) for u, (o, _) in own if u < t]
                whole = [u for u, keys in before if quotes.key(passage) in keys]
                lines = [max((u for u, keys in before if quotes.key(line) in keys), default=None) for line in passage.split("\n")] if "\n" in passage else []
                lines = [u for u in lines if u is not None]
                if whole and quotes.key(passage) is not None:
                    found.append((-level, max(whole)))
                elif lines:
                    found.append((-level, max(lines)))
            turns = [u for u, _ in own]
            parent[t] = max(found)[1] if found else t - 1 if t - 1 in turns else None
        for t in parent:
            up, depth = t, 0
            while parent[up] is not None:
                up, depth = parent[up], depth + 1
            out[c, t] = (parent[t], up, depth)
    return out


def test_links_match_brute_force(spark):
    rng = random.Random(9)
    common = ["ok", "thanks", "Yes.", "what do you mean?"]
    rows = []
    for c in range(12):
        said = []
        for t in range(60 if c else 400):
            if rng.random() < 0.05:
                continue
            own = [rng.choice(common) if rng.random() < 0.4 else f"line {c} {t} {k}" for k in range(rng.randint(1, 3))]
            quoted = []
            for _ in range(rng.randint(0, 2)):
                if said:
                    lines = rng.choice(said)
                    lines = lines if rng.random() < 0.5 else [*lines, "never said"]
                    quoted += ["> " * rng.randint(1, 2) + x for x in lines] + [""]
            rows.append((c, t, "a", "\n".join([*quoted, *own])))
            said.append(own)
    rng.shuffle(rows)
    want = brute(rows)
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", str(4 * parts))
        got = run(spark, rows)
        assert {k: (r["parent_turn"], r["root_turn"], r["depth"]) for k, r in got.items()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_common_line_belongs_to_its_latest_writer(spark):
    rows = [(1, 0, "a", "question"), (1, 1, "b", "ok"), (1, 4, "a", "other"), (1, 5, "b", "ok"), (1, 7, "a", "> ok\nthen go"), (1, 8, "b", "ok"), (1, 9, "a", "> ok\nok")]
    got = run(spark, rows)
    assert got[1, 7]["parent_turn"] == 5 and got[1, 9]["parent_turn"] == 8


def test_empty_table(spark):
    assert quotes.link(spark.createDataFrame([], SCHEMA)).collect() == []
