"""URL filters: association rules mined by FP-growth, matched through an inverted index.

URLs that the given rules decide are the labels. FP-growth finds token sets that are frequent with a
label; a set becomes a rule when its confidence and support suffice and no smaller set is as sure."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Mining:
    """Least share of labelled URLs a token set occurs in, least confidence, most tokens of a rule, most tokens of
    one URL that FP-growth takes (sets with the others are grown by level), and how many rules one pass over the pages
    holds in a task."""
    support: float = 0.005
    confidence: float = 0.8
    most_tokens: int = 3
    most_mined: int = 16
    block_rules: int = 100_000


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` and ``path`` in place of columns of these names.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up
    to ``?``, ``#`` or the end. A null url or one without ``://`` has both empty."""
    start = F.instr("url", "://")
    rest = F.when(start > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return pages.withColumns({"host": F.translate(host, UPPER, LOWER), "path": F.regexp_extract(tail, r"^[^?#]*", 0)})


def url_tokens() -> Column:
    """Tokens of ``host``, ``path`` and ``url``, all of them.

    The labels of the host by their place from the end, the segments of the path by theirs with digit runs as ``#``,
    the ending after the last dot, the query keys, how deep the path is, and whether there is a fragment."""
    labels = F.reverse(F.split("host", r"\."))
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    plain = F.transform(parts, lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    query = F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    ending = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)
    def placed(kind: str, xs: Column) -> Column:
        return F.transform(xs, lambda x, i: F.concat(F.lit(kind), i.cast("string"), F.lit(":"), x))
    return F.array_distinct(F.concat(
        F.filter(placed("host", labels), lambda x: ~x.endswith(":")), placed("path", plain),
        F.transform(keys, lambda x: F.concat(F.lit("key:"), x)),
        F.when(ending != "", F.array(F.concat(F.lit("ending:"), ending))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("depth:"), F.size(parts).cast("string"))),
        F.when(F.instr("url", "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))))


def given_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str | None, str | None]:
    """The longest of the given rules that fits, and its verdict; ``rules`` by host: (path, verdict)."""
    best = None
    while host:
        for start, verdict in rules.get(host, ()):
            if path.startswith(start) and (best is None or len(host + start) > len(best[0])):
                best = host + start, verdict
        cut = host.find(".")
        host = host[cut + 1:] if cut >= 0 else ""
    return best or (None, None)


def by_host(rules: list[tuple[str, str]]) -> dict[str, list[tuple[str, str]]]:
    """(verdict, rule such as ``example.org/es/``) by the rule's host."""
    out: dict[str, list[tuple[str, str]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, verdict))
    return out


def _sets_of(tokens: list[str], grown_from: frozenset, known: list[set], size: int) -> list[tuple]:
    """Sets of ``size`` of the tokens with one of ``grown_from``, whose smaller sets of that kind are all ``known``, by size."""
    have = sorted(set(tokens))
    sets = {(t,) for t in have if t in grown_from}
    for k in range(1, size):
        kept = {s for s in sets if s in known[k - 1]}
        wider = {tuple(sorted((*s, t))) for s in kept for t in have if t not in s}
        sets = {s for s in wider if all(less in kept for i in range(k + 1) if not grown_from.isdisjoint(less := s[:i] + s[i + 1:]))}
    return sorted(sets)


def _with_grown(sets: DataFrame, labelled: DataFrame, shared, total: int, p: Mining) -> DataFrame:
    """``sets`` of FP-growth with the exact counts of those that hold a token it did not take from every URL.

    Where no URL has more than ``most_mined`` frequent tokens, they are ``sets`` themselves. Otherwise sets without
    such a token are right, and those with one are counted over all labelled URLs, size by size, from the frequent ones
    of the size before: the work is polynomial in the tokens of a URL, and none is left out."""
    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = shared.value, set()
        for b in batches:
            for tokens in b.column("tokens").to_pylist():
                seen.update(sorted((t for t in tokens if t in count), key=lambda t: (count[t], t))[p.most_mined:])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["t"])

    cut = frozenset(r["t"] for r in labelled.select("tokens").mapInArrow(left_out, "t string").distinct().collect())
    if not cut:
        return sets
    spark, known = labelled.sparkSession, []
    out = sets.filter(~F.arrays_overlap("items", F.array(*[F.lit(t) for t in sorted(cut)])))
    for size in range(1, p.most_tokens + 1):
        smaller = spark.sparkContext.broadcast(known)

        def counted(batches: Iterator[pa.RecordBatch], size=size, smaller=smaller) -> Iterator[pa.RecordBatch]:
            def flushed(found):
                return pa.RecordBatch.from_arrays([pa.array([list(k[0]) for k in found], pa.list_(pa.string())), pa.array([k[1] for k in found], pa.string()),
                                                   pa.array(list(found.values()), pa.int64())], ["tokens", "verdict", "n"])

            count, found = shared.value, {}
            for b in batches:
                for tokens, verdict in zip(b.column("tokens").to_pylist(), b.column("verdict").to_pylist()):
                    for s in _sets_of([t for t in tokens if t in count], cut, smaller.value, size):
                        found[s, verdict] = found.get((s, verdict), 0) + 1
                    if len(found) > 100_000:
                        yield flushed(found)
                        found = {}
            yield flushed(found)

        n = labelled.select("tokens", "verdict").mapInArrow(counted, "tokens array<string>, verdict string, n long")
        n = written(n.groupBy("tokens", "verdict").agg(F.sum("n").alias("freq")), "grown")
        alone = n.groupBy("tokens").agg(F.sum("freq").alias("freq")).filter(F.col("freq") >= p.support * total)
        known.append({tuple(r["tokens"]) for r in alone.select("tokens").collect()})
        joint = n.filter(F.col("freq") >= p.support * total)
        out = out.unionByName(alone.select(F.col("tokens").alias("items"), "freq")).unionByName(
            joint.select(F.array_sort(F.concat("tokens", F.array(F.concat(F.lit("verdict:"), "verdict")))).alias("items"), "freq"))
    return written(out, "itemsets-whole")


def mine(labelled: DataFrame, p: Mining = Mining()) -> DataFrame:
    """Rules ``tokens``, ``verdict``, ``confidence``, ``support`` (rows) from ``tokens``, ``verdict`` of labelled URLs.

    The empty rule stands for the most frequent verdict. Rules that a rule with one token less matches in
    confidence, for the same verdict, are pruned."""
    labelled = labelled.filter("verdict is not null")
    total = labelled.count()
    schema = "tokens array<string>, verdict string, confidence double, support long"
    spark = labelled.sparkSession
    if not total:
        return spark.createDataFrame([], schema)
    # a token below the support is in no frequent set; of the others there are at most 1 / support times as many as an
    # average URL has tokens, so they go to every task
    often = labelled.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).filter(F.col("n") >= p.support * total)
    shared = spark.sparkContext.broadcast({r["t"]: r["n"] for r in often.collect()})

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for b in batches:
            out = []
            for tokens, verdict in zip(b.column("tokens").to_pylist(), b.column("verdict").to_pylist()):
                kept = [t for t in tokens if t in count]
                # FP-growth is exponential in the tokens of a URL: of more than ``most_mined`` it takes the rarest
                out.append([*sorted(kept, key=lambda t: (count[t], t))[:p.most_mined], f"verdict:{verdict}"])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["items"])

    rows = labelled.select("tokens", "verdict").mapInArrow(items, "items array<string>")
    sets = FPGrowth(itemsCol="items", minSupport=p.support).fit(rows).freqItemsets
    sets = written(sets.filter(F.size("items") <= p.most_tokens + 1).select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    sets = _with_grown(sets, labelled, shared, total, p)
    named = F.filter("items", lambda x: x.startswith("verdict:"))
    tokens = F.filter("items", lambda x: ~x.startswith("verdict:"))
    joint = sets.filter(F.size(named) == 1).select(tokens.alias("tokens"), F.substring(named[0], len("verdict:") + 1, 10_000).alias("verdict"), F.col("freq").alias("support"))
    alone = sets.filter(F.size(named) == 0).select(F.col("items").alias("tokens"), "freq")
    sure = joint.join(alone, "tokens", "left").select(
        "tokens", "verdict", "support", (F.col("support") / F.when(F.size("tokens") == 0, F.lit(total)).otherwise(F.col("freq"))).alias("confidence"))
    sure = written(sure, "confidences")
    wider = sure.select("tokens", "verdict", "confidence", F.explode("tokens").alias("__t"))
    wider = wider.select("tokens", "verdict", "confidence", F.array_remove("tokens", F.col("__t")).alias("less"))
    general = sure.select(F.col("tokens").alias("less"), "verdict", F.col("confidence").alias("sure"))
    matched = wider.join(general, ["less", "verdict"]).filter("sure >= confidence").select("tokens", "verdict").distinct()
    rules = sure.filter((F.col("confidence") >= p.confidence) & (F.size("tokens") > 0)).join(matched, ["tokens", "verdict"], "left_anti")
    base = sure.filter(F.size("tokens") == 0)
    return written(rules.unionByName(base).select("tokens", "verdict", "confidence", "support"), "url-rules")


class Index:
    """Rules by their least frequent token, so that a URL meets few that do not fit."""

    def __init__(self, rules: list[tuple]):
        count: dict[str, int] = {}
        for tokens, *_ in rules:
            for t in tokens:
                count[t] = count.get(t, 0) + 1
        self.lists: dict[str, list] = {}
        for tokens, verdict, confidence, support in rules:
            key = min(tokens, key=lambda t: (count[t], t)) if tokens else ""
            # surer rules first, then those with more support; the empty rule comes after all
            self.lists.setdefault(key, []).append(((bool(tokens), confidence, support, sorted(tokens)), verdict, frozenset(tokens)))

    def best(self, tokens: list[str]):
        """(rank, verdict) of the surest rule whose tokens are all there."""
        have = set(tokens)
        fits = ((rank, verdict) for t in ("", *have) for rank, verdict, need in self.lists.get(t, ()) if need <= have)
        return max(fits, default=None)


def judge(pages: DataFrame, rules: list[tuple[str, str]], p: Mining = Mining(), default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule`` (the given rule that fits, or null),
    ``verdict``, ``mined`` (tokens of the mined rule that decided, or null), ``confidence``.

    ``rules``: (verdict, host and path); a rule fits its host and all subdomains when the path starts with
    its own; the longest wins. Other URLs get the verdict of the surest mined rule, ties by support and
    tokens; the empty rule is the majority; ``default`` where nothing is labelled. Rules too many for one
    task's memory are matched block by block, each block by one pass over the pages."""
    table = by_host(rules)
    page = with_host_and_path(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"))
    page = page.select("page_id", "host", "path", url_tokens().alias("tokens"))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [given_rule(h, x, table) for h, x in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())],
                                             [*b.schema.names, "rule", "verdict"])

    known = page.mapInArrow(decided, "page_id long, host string, path string, tokens array<string>, rule string, verdict string")
    known = written(known, "urls-decided")
    mined = mine(known.select("tokens", "verdict"), p)
    blocks = max(1, -(-mined.count() // p.block_rules))
    out = known.select("*", F.lit(None).cast("string").alias("guess"), F.lit(None).cast("array<string>").alias("mined"),
                       F.lit(None).cast("double").alias("confidence"), F.lit(0).cast("long").alias("__support"))
    schema = out.schema
    for k in range(blocks):
        some = [tuple(r) for r in mined.filter(F.pmod(F.xxhash64("tokens", "verdict"), F.lit(blocks)) == k).collect()]
        shared = pages.sparkSession.sparkContext.broadcast(some)

        def matched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for b in batches:
                rows = b.to_pylist()
                for r in rows:
                    if r["rule"] is None and (found := index.best(r["tokens"])):
                        rank, verdict = found
                        before = (bool(r["mined"]), r["confidence"], r["__support"], r["mined"])
                        if r["guess"] is None or rank > before:
                            r["guess"], (_, r["confidence"], r["__support"], r["mined"]) = verdict, rank
                yield pa.RecordBatch.from_pylist(rows, b.schema)

        out = out.mapInArrow(matched, schema)
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "guess", F.lit(default)).alias("verdict"), "mined", "confidence")
