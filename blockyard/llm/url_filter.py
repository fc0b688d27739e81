"""URL rules fetched by their rarest literal token.

Each rule is a regular expression with the literal tokens that any match must
hold.  It is filed under the one of them that the fewest URLs contain; a URL's
own tokens fetch candidate rules, and only those run their expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, materialize, scratched

#: Rule sets up to this size travel as a literal index inside the plan.
INLINE_RULES = 2000
TOKEN = r"[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched against host and path; ``tokens`` are whole literal tokens of any match."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int

    @classmethod
    def prefix(cls, verdict: str, text: str) -> Rule:
        """Rule ``host/path``: the host and its subdomains, paths that start so."""
        host, slash, rest = text.partition("/")
        path = slash + rest
        tokens = [t for t in re.split(TOKEN, host) if t]
        whole = re.split(TOKEN, path)[:-1]  # the last token may go on in the URL
        tokens += [t for t in whole if t]
        return cls(text, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), len(text))


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    u = F.coalesce(url, F.lit(""))
    return F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def token_counts(urls: DataFrame, key: str, tokens: Sequence[str]) -> dict[str, int]:
    """How many URLs hold each of ``tokens``; the result is no larger than the rule set."""
    if not tokens:
        return {}
    found = urls.select(F.explode(F.array_distinct(F.split(key, TOKEN))).alias("t"))
    found = found.where(F.col("t").isin(list(tokens))).groupBy("t").count()
    return {r["t"]: r["count"] for r in found.collect()}


@scratched
def judge(
    urls: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", inline: int = INLINE_RULES
) -> DataFrame:
    """``urls`` with host, path, rule and verdict; the rule with the longest text wins.

    Null URLs and those without ``://`` have empty host and path and match
    nothing.  Equally long rules go by name.  Columns of ``urls`` named host,
    path, rule or verdict are replaced.  Rule sets of up to ``inline`` rules are
    looked up inside the row, with no shuffle; larger ones are joined by token.
    """
    key, best_of = fresh([*urls.columns, "host", "path", "rule", "verdict"], "_key", "_best")
    rows = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rows = rows.withColumn(key, F.concat("host", "path"))
    wanted = sorted({t for r in rules for t in r.tokens})
    if len(rules) > inline:
        return _joined(rows, key, rules, default)
    counts = token_counts(rows, key, wanted)
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(i)
    # The best rule comes first, so the first that matches is the answer.
    order = {i: n for n, i in enumerate(sorted(range(len(rules)), key=lambda i: (-rules[i].weight, rules[i].name)))}
    if not rules:
        best = F.lit(None).cast("struct<n:int,rule:string,verdict:string,pattern:string>")
    else:
        row = lambda i: F.struct(
            F.lit(order[i]).alias("n"), F.lit(rules[i].name).alias("rule"), F.lit(rules[i].verdict).alias("verdict"), F.lit(rules[i].pattern).alias("pattern")
        )
        table = F.create_map(*[x for t, own in index.items() for x in (F.lit(t), F.array(*map(row, own)))])
        tokens = F.array_distinct(F.concat(F.split(key, TOKEN), F.array(F.lit(""))))
        fetched = F.flatten(F.filter(F.transform(tokens, lambda t: F.try_element_at(table, t)), F.isnotnull))
        fits = F.filter(fetched, lambda r: F.regexp(F.col(key), r["pattern"]))
        best = F.array_min(fits)
    rows = rows.withColumn(best_of, best)
    rows = rows.withColumns({"rule": F.col(f"{best_of}.rule"), "verdict": F.coalesce(f"{best_of}.verdict", F.lit(default))})
    return rows.drop(key, best_of)


def _joined(rows: DataFrame, key: str, rules: Sequence[Rule], default: str) -> DataFrame:
    """The same for rule sets too large for the plan: distinct keys meet rules by token.

    Keys are judged once each, however many URLs share them; the rules' side is
    a table, and a hot token is split by adaptive execution.
    """
    spark = rows.sparkSession
    schema = "_rule string, _verdict string, _pattern string, _weight long, _tokens array<string>"
    table = spark.createDataFrame([(r.name, r.verdict, r.pattern, r.weight, list(r.tokens) or [""]) for r in rules], schema)
    keys = materialize(rows.select(F.col(key).alias("_key")).distinct(), "url-keys")
    pairs = keys.select("_key", F.explode(F.array_distinct(F.concat(F.split("_key", TOKEN), F.array(F.lit(""))))).alias("_token"))
    counts = pairs.groupBy("_token").agg(F.count("*").alias("_n"))
    filed = table.select("_rule", F.explode("_tokens").alias("_token")).join(counts, "_token", "left")
    filed = filed.groupBy("_rule").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_token"))["_token"].alias("_token"))
    filed = materialize(table.drop("_tokens").join(filed, "_rule"), "url-rules")
    hits = pairs.join(filed, "_token").where(F.regexp(F.col("_key"), F.col("_pattern")))
    best = hits.groupBy("_key").agg(F.min(F.struct(-F.col("_weight"), "_rule", "_verdict")).alias("_best"))
    best = materialize(best.select("_key", "_best._rule", "_best._verdict"), "url-best")
    right = fresh(rows.columns, "_k", "_rule", "_verdict")
    out = rows.join(best.toDF(*right), F.col(key) == F.col(right[0]), "left")
    return out.withColumns({"rule": F.col(right[1]), "verdict": F.coalesce(right[2], F.lit(default))}).drop(key, *right)
