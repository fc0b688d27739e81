"""Quotation linking: who answers whom in conversations that quote.

Lines that begin with ``>`` marks are quotes; the number of marks is the level.
Runs of lines of one level are passages.  Normalised passages are hashed and
joined to the message of the conversation that wrote them last before, which
gives each message the one it replies to; messages are returned without their quotes
and with the keys that put every message after the one it answers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, materialize, scratched, sized, small_batches, tidy

MARK = re.compile(r"^((?:[ \t]*>)+)[ \t]?(.*)$", re.DOTALL)


def normalised(passage: str) -> str:
    """Lower case, with each run of white space as one space and none at the ends."""
    return " ".join(passage.lower().split())


def key(passage: str) -> int | None:
    """64-bit hash of the normalised passage; none for a blank one."""
    n = normalised(passage)
    return int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "big", signed=True) if n else None


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """Own text of a message and its quoted passages (level, passage) in order."""
    own, quotes, run, level = [], [], [], 0

    def close():
        if level and run:
            quotes.append((level, "\n".join(run)))

    for line in (text or "").split("\n"):
        m = MARK.match(line)
        at = m[1].count(">") if m else 0
        if at != level:
            close()
            run, level = [], at
        if at:
            run.append(m[2])
        else:
            own.append(line)
    close()
    return "\n".join(own).strip("\n"), quotes


def passages(own: str) -> list[int]:
    """Hashes under which a message can be quoted: whole, by paragraph and by line."""
    parts = [own, *re.split(r"\n[ \t]*\n", own), *own.split("\n")]
    return sorted({k for k in map(key, parts) if k is not None})


def _follow(links: DataFrame, name: str) -> DataFrame:
    """_up: where the links from (_c, _t) to _up end, and _d: the sum of their lengths; an end links to itself.

    Each round doubles how far a message looks up, so rounds grow with the logarithm of the
    depth; messages that have found their end are no longer joined, and no join is by
    conversation alone.
    """
    now = materialize(links.withColumn("_open", F.col("_up") != F.col("_t")), f"{name}-up")
    while not now.where("_open").isEmpty():
        over = now.select("_c", F.col("_t").alias("_up"), F.col("_up").alias("_next"), F.col("_d").alias("_more"))
        step = now.where("_open").join(over, ["_c", "_up"]).select("_c", "_t", F.col("_next").alias("_up"), (F.col("_d") + F.col("_more")).alias("_d"), (F.col("_next") != F.col("_up")).alias("_open"))
        further = materialize(now.where("not _open").unionByName(step), f"{name}-up")
        drop_table(now)
        now = further
    return now.drop("_open")


def _latest(origin: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (_c, _h, _t) with _from: the last turn before of ``origin`` (_c, _h, _from); without one left out.

    Both are dealt to even parts in order of passage and turn, so a common
    passage is no task's alone, and each part begins with what those before end with.
    """
    spark = asked.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    said = origin.select("_c", "_h", F.col("_from").alias("_t"), F.lit(1).alias("_said"))
    every = asked.select("_c", "_h", "_t", F.lit(0).alias("_said")).unionByName(said)
    dealt = materialize(every.repartitionByRange(n, "_c", "_h", "_t").withColumn("_k", F.spark_partition_id()), "quote-dealt")
    row = F.struct("_c", "_h", "_t")
    last = materialize(dealt.where("_said = 1").groupBy("_k").agg(F.max(row).alias("_last")), "quote-last")  # one row a part
    parts = spark.range(n).select(F.col("id").cast("int").alias("_k"))
    before = parts.join(F.broadcast(last.withColumnRenamed("_k", "_b")), F.col("_b") < F.col("_k")).groupBy("_k").agg(F.max("_last").alias("_last"))
    before = sized(materialize(before, "quote-before"))
    # what a message says itself comes after what it asks for
    here = F.last(F.when(F.col("_said") == 1, row), ignorenulls=True).over(Window.partitionBy("_k").orderBy("_c", "_h", "_t", "_said").rowsBetween(Window.unboundedPreceding, -1))
    found = dealt.withColumn("_here", here).where("_said = 0").join(before, "_k", "left").withColumn("_own", F.coalesce("_here", "_last"))
    same = F.col("_own._c").eqNullSafe(F.col("_c")) & (F.col("_own._h") == F.col("_h")) & (F.col("_own._t") < F.col("_t"))
    return found.where(same).select("_c", "_h", "_t", F.col("_own._t").alias("_from"))


def _next_answer(tree: DataFrame) -> DataFrame:
    """``tree`` (_c, _t, _p) with _s: the next answer to the same message, by turn; even parts, also of one message's answers."""
    spark = tree.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(tree.repartitionByRange(n, "_c", "_p", "_t").withColumn("_k", F.spark_partition_id()), "quote-parts")
    row = F.struct("_c", "_p", "_t")
    first = materialize(parts.groupBy("_k").agg(F.min(row).alias("_first")), "quote-first")  # one row a part
    a, b = first.select("_k").alias("a"), first.alias("b")
    after = materialize(F.broadcast(a).join(b, F.col("b._k") > F.col("a._k")).groupBy(F.col("a._k").alias("_k")).agg(F.min_by("b._first", "b._k").alias("_first")), "quote-after")
    ahead = parts.withColumn("_n", F.lead(row).over(Window.partitionBy("_k").orderBy("_c", "_p", "_t"))).join(sized(after), "_k", "left")
    ahead = ahead.withColumn("_n", F.coalesce("_n", "_first"))
    same = F.col("_n._c").eqNullSafe(F.col("_c")) & F.col("_n._p").eqNullSafe(F.col("_p"))
    return materialize(ahead.select("_c", "_t", "_p", F.when(same, F.col("_n._t")).alias("_s")), "quote-next")


def _reply_order(tree: DataFrame) -> DataFrame:
    """_c, _t and reply_order of each message, given the message _p that it answers.

    After a message comes its first answer; after one without answers the next
    answer of the nearest message upwards that has one.  These steps form one
    chain a conversation, along which places are counted.
    """
    tree = _next_answer(tree)
    first = materialize(tree.where(F.col("_p").isNotNull()).groupBy("_c", "_p").agg(F.min("_t").alias("_child")).withColumnRenamed("_p", "_t"), "quote-child")
    back = tree.select("_c", "_t", F.when(F.col("_s").isNotNull() | F.col("_p").isNull(), F.col("_t")).otherwise(F.col("_p")).alias("_up"), F.lit(0).cast("long").alias("_d"))
    leaf = _follow(back, "quote-back").join(sized(first), ["_c", "_t"], "left_anti")
    exits = tree.where(F.col("_s").isNotNull()).select("_c", F.col("_t").alias("_up"), "_s")
    steps = first.select("_c", "_t", F.col("_child").alias("_to")).unionByName(leaf.join(exits, ["_c", "_up"]).select("_c", "_t", F.col("_s").alias("_to")))
    steps = materialize(steps.select("_c", F.col("_to").alias("_t"), F.col("_t").alias("_before")), "quote-steps")
    chain = tree.select("_c", "_t").join(sized(steps), ["_c", "_t"], "left")
    chain = materialize(chain.select("_c", "_t", F.coalesce("_before", "_t").alias("_up"), F.when(F.col("_before").isNull(), 0).otherwise(1).cast("long").alias("_d")), "quote-chain")
    return _follow(chain, "quote-order").select("_c", "_t", F.col("_d").alias("reply_order"))


@scratched
def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``messages`` with text without quotes, n_quotes, n_linked, parent_turn, root_turn, depth, reply_order.

    A quoted passage belongs to the latest message of an earlier turn in the
    conversation that has it as its text, a paragraph or a line of it; a
    passage found nowhere as a whole is looked up by its lines.  A message
    replies to the latest message that it quotes at level 1, else to that quoted
    at the lowest level, else to the turn before (turn - 1), else to none.
    ``reply_order`` counts the messages of a conversation from 0, so that each
    follows the one it answers and its answers, with all that answers them, come
    before the next answer; roots, and answers to one message, go by turn.

    Null texts are empty.  Messages with a null conversation or turn have no
    parent, root, depth or order.  Rows that share conversation and turn are one message
    with several texts: they have one parent, root, depth and order.  Columns of these
    names are replaced.
    """
    spark = messages.sparkSession
    small_batches(spark)
    added = ("n_quotes", "n_linked", "parent_turn", "root_turn", "depth", "reply_order")
    own_names = [f.name for f in messages.schema.fields if f.name != text and f.name not in added]
    # The caller's columns go by number meanwhile, so no name of theirs can clash.
    kept = [T.StructField(f"_x{i}", messages.schema[n].dataType) for i, n in enumerate(own_names)]
    names = [f.name for f in kept]
    conv_at, turn_at = names[own_names.index(conv)], names[own_names.index(turn)]
    quote = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("hash", T.LongType())])
    schema = T.StructType([*kept, T.StructField("_own", T.StringType()), T.StructField("n_quotes", T.IntegerType()), T.StructField("_keys", T.ArrayType(T.LongType())), T.StructField("_quotes", T.ArrayType(quote))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, count, keys, quoted = [], [], [], []
            for t in batch.column("_said").to_pylist():
                o, q = parse(t)
                own.append(o)
                count.append(len(q))
                keys.append(passages(o))
                found = []
                for n, (level, p) in enumerate(q):
                    parts = [p, *(p.split("\n") if "\n" in p else ())]
                    found += [{"level": level, "number": n, "part": min(i, 1), "hash": k} for i, x in enumerate(parts) if (k := key(x)) is not None]
                quoted.append(found)
            kinds = pa.list_(pa.struct([("level", pa.int32()), ("number", pa.int32()), ("part", pa.int32()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(own, pa.string()), pa.array(count, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(quoted, kinds)], names=[*names, "_own", "n_quotes", "_keys", "_quotes"]
            )

    parsed = materialize(messages.select(*[F.col(f"`{n}`").alias(x) for n, x in zip(own_names, names)], F.col(text).alias("_said")).mapInArrow(tidy(run), schema), "quote-parsed")
    c, t = F.col(conv_at).alias("_c"), F.col(turn_at).alias("_t")
    real = parsed.where(F.col(conv_at).isNotNull() & F.col(turn_at).isNotNull())
    asked = real.select(c, t, F.explode("_quotes").alias("q")).select("_c", "_t", "q.level", "q.number", "q.part", F.col("q.hash").alias("_h"))
    asked = materialize(asked, "quote-asked")
    wanted = materialize(asked.select("_c", "_h").distinct(), "quote-wanted")
    origin = real.select(c, F.col(turn_at).alias("_from"), F.explode("_keys").alias("_h")).distinct().join(sized(wanted), ["_c", "_h"], "left_semi")
    found = materialize(_latest(origin, asked.select("_c", "_h", "_t").distinct()), "quote-found")
    found = asked.join(sized(found), ["_c", "_h", "_t"])
    # of a passage the whole counts before its lines, and of lines the latest message
    best = found.groupBy("_c", "_t", "level", "number").agg(F.max(F.struct(-F.col("part"), "_from"))["_from"].alias("_from"))
    best = best.groupBy("_c", "_t").agg(F.max(F.struct(-F.col("level"), "_from"))["_from"].alias("_parent"), F.count("*").cast("int").alias("n_linked"))
    best = materialize(best, "quote-best")

    turns = materialize(real.select(c, t).distinct(), "quote-turns")
    before = turns.select("_c", (F.col("_t") + 1).alias("_t"), F.col("_t").alias("_before"))
    parents = turns.join(sized(best), ["_c", "_t"], "left").join(before, ["_c", "_t"], "left")
    parents = materialize(parents.select("_c", "_t", F.coalesce("_parent", "_before").alias("parent_turn"), "n_linked"), "quote-parents")
    link_up = parents.select("_c", "_t", F.coalesce("parent_turn", "_t").alias("_up"), F.when(F.col("parent_turn").isNull(), 0).otherwise(1).cast("long").alias("_d"))
    up = _follow(link_up, "quote")
    place = parents.join(up, ["_c", "_t"]).join(_reply_order(parents.select("_c", "_t", F.col("parent_turn").alias("_p"))), ["_c", "_t"])
    place = materialize(place, "quote-place")
    out = parsed.drop("_keys", "_quotes").join(sized(place), (F.col(conv_at) == F.col("_c")) & (F.col(turn_at) == F.col("_t")), "left")
    return out.select(*[F.col(x).alias(n) for n, x in zip(own_names, names)], F.col("_own").alias(text), "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_turn", F.col("_up").alias("root_turn"), F.col("_d").alias("depth"), "reply_order")
