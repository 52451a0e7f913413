"""A mixture of sources in target shares of all tokens, from texts that may belong to several sources.

Texts are aggregated by membership pattern (the set of targeted sources that hold them). A minimum-cost flow from the
patterns to the sources' quotas, where each further use of a pattern's tokens costs one more, says how many tokens of
which pattern go to which source; only that small network is solved on the driver. Then each pattern's texts stand in
a seeded order on a line of tokens, once per use, and each text goes to the source in whose stretch its middle lies.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.digest import strip
from cairn.llm.tokens import BYTE_BPE_50K, token_count
from cairn.session import cut

ROWS_PER_BUCKET = 20_000
#: Membership patterns (sets of targets that share a text) up to which the flow is solved on the driver, their plans broadcast.
MOST_PATTERNS = 20_000


def normal_source(source: Column) -> Column:
    """A source without blanks around it, in lower case; '' is no source."""
    return F.nullif(F.lower(strip(source)), F.lit(""))


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


def min_cost_flow(nodes: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The flow on each arc (from, to, capacity, cost) of a maximum flow of least cost, by successive shortest paths."""
    graph: list[list[_Arc]] = [[] for _ in range(nodes)]
    place = []
    for a, b, room, cost in arcs:
        place.append((a, len(graph[a])))
        graph[a].append(_Arc(b, room, cost, len(graph[b])))
        graph[b].append(_Arc(a, 0, -cost, len(graph[a]) - 1))
    while True:
        far: list[int | None] = [None] * nodes
        via: list[tuple[int, int] | None] = [None] * nodes
        far[source] = 0
        queue, waits = deque([source]), {source}
        while queue:
            a = queue.popleft()
            waits.discard(a)
            for i, arc in enumerate(graph[a]):
                if arc.room > 0 and (far[arc.to] is None or far[a] + arc.cost < far[arc.to]):
                    far[arc.to], via[arc.to] = far[a] + arc.cost, (a, i)
                    if arc.to not in waits:
                        waits.add(arc.to)
                        queue.append(arc.to)
        if far[sink] is None:
            return [arcs[k][2] - graph[a][i].room for k, (a, i) in enumerate(place)]
        room, at = None, sink
        while at != source:
            a, i = via[at]
            room = graph[a][i].room if room is None else min(room, graph[a][i].room)
            at = a
        at = sink
        while at != source:
            a, i = via[at]
            graph[a][i].room -= room
            graph[at][graph[a][i].back].room += room
            at = a


def allot(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens of each pattern for each source. A text is used at most as often as every source it belongs to allows."""
    keys, sources = sorted(patterns), sorted(quotas)
    number = {x: i + 2 for i, x in enumerate([*keys, *sources])}
    arcs, meant = [], []
    for p in keys:
        for use in range(min(repeats[s] for s in p)):
            arcs.append((0, number[p], patterns[p], use))
        for s in p:
            meant.append((len(arcs), p, s))
            arcs.append((number[p], number[s], sum(quotas.values()), 0))
    for s in sources:
        arcs.append((number[s], 1, quotas[s], 0))
    flow = min_cost_flow(len(number) + 2, arcs, 0, 1)
    return {(p, s): flow[k] for k, p, s in meant if flow[k]}


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 0, total: int | None = None, vocabulary: str = BYTE_BPE_50K) -> tuple[DataFrame, DataFrame]:
    """(the chosen texts, the shares reached).

    documents has doc_id, text, source; targets has source, target_share, max_repeats. Each source's quota is its share of
    total, by default all tokens of documents.text. A text is told by its content: repeats of it in one source or in
    several are one text. Chosen: doc_id (the least of the text in that source), source, uses, tokens (of one use).
    Shares, one row per target: quota, tokens, texts and most_uses reached, share_of_total (against total) and
    share_of_mixture. A source that can't fill its quota within its repeats falls short and shows it; one without
    documents reaches 0. Each quota is met to within one text. Documents without a targeted source count in total only;
    empty and null texts have no tokens and aren't chosen. Null shares count as 0, null repeats as 1; of targets that
    repeat a source the greatest share and least repeats count. Over MOST_PATTERNS sets of targets that share texts (n
    targets have 2^n) raise ValueError rather than leave any out. The result depends on texts, ids and seed, not on order.
    """
    spark = documents.sparkSession
    wanted = targets.select(normal_source(targets["source"]).alias("source"), F.coalesce(targets["target_share"], F.lit(0.0)).alias("share"), F.greatest(F.coalesce(targets["max_repeats"], F.lit(1)), F.lit(0)).alias("repeats"))
    rows = wanted.where("source is not null").groupBy("source").agg(F.max("share").alias("share"), F.min("repeats").alias("repeats")).collect()  # a row per target
    share, repeats = {r.source: r.share for r in rows}, {r.source: r.repeats for r in rows}

    counted = documents.select(documents["doc_id"].alias("doc_id"), normal_source(documents["source"]).alias("source"), F.sha2(documents["text"], 256).alias("text_key"), token_count(documents["text"], vocabulary).alias("tokens"))
    source = F.when(F.col("source").isin(*share), F.col("source"))
    by_source = counted.groupBy("text_key", source.alias("source")).agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"), F.sum("tokens").alias("all_tokens"))
    members = F.array_sort(F.filter(F.collect_list(F.struct("source", "doc_id")), lambda m: m["source"].isNotNull()))
    texts = by_source.groupBy("text_key").agg(members.alias("members"), F.max("tokens").alias("tokens"), F.sum("all_tokens").alias("all_tokens"))
    texts = cut(texts.withColumn("pattern", F.array_join(F.transform("members", lambda m: m["source"]), "\n")), "mixture")

    by_pattern = texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.sum("all_tokens").alias("all_tokens"), F.count("*").alias("n")).limit(MOST_PATTERNS + 1).collect()  # a row per set of targets
    if len(by_pattern) > MOST_PATTERNS:
        raise ValueError(f"texts belong to over {MOST_PATTERNS} different sets of targets")
    total = sum(r.all_tokens for r in by_pattern) if total is None else total
    quotas = {s: floor(x * total + 0.5) for s, x in share.items()}
    patterns = {tuple(r.pattern.split("\n")): r.tokens for r in by_pattern if r.pattern and r.tokens}
    flow = allot(patterns, quotas, repeats)
    plan = []
    for p, tokens in patterns.items():
        ends, end = [], 0
        for s in p:
            end += flow.get((p, s), 0)
            ends.append((s, end))
        if end:
            plan.append(("\n".join(p), tokens, -(-end // tokens), ends))
    plans = spark.createDataFrame(plan, "pattern string, pattern_tokens bigint, layers int, ends array<struct<source:string,end:bigint>>")

    buckets = max(1, max((r.n for r in by_pattern), default=1) // ROWS_PER_BUCKET)
    order = F.xxhash64("text_key", F.lit(seed))
    line = texts.where("tokens > 0 and pattern <> ''").select("pattern", "members", "tokens", "text_key", order.alias("place"), F.pmod(F.shiftrightunsigned(order, 8), F.lit(buckets)).alias("bucket"))
    before = W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = line.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("sum")).select("pattern", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("pattern", "bucket").orderBy("place", "text_key").rowsBetween(W.unboundedPreceding, -1)
    placed = line.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(starts, ["pattern", "bucket"]).join(F.broadcast(plans), "pattern")
    middle = F.col("start") + F.col("inner") + F.col("tokens") / 2
    uses = placed.select("members", "tokens", "ends", F.explode(F.transform(F.sequence(F.lit(0), F.col("layers") - 1), lambda i: i * F.col("pattern_tokens") + middle)).alias("at"))
    to = F.get(F.filter("ends", lambda e: F.col("at") < e["end"]), F.lit(0))["source"]
    picked = uses.select("members", "tokens", to.alias("source")).where("source is not null")
    doc = F.get(F.filter("members", lambda m: m["source"] == F.col("source")), F.lit(0))["doc_id"]
    chosen = cut(picked.select(doc.alias("doc_id"), "source", "tokens").groupBy("doc_id", "source", "tokens").agg(F.count("*").cast("int").alias("uses")), "mixture")

    reached = chosen.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("tokens"), F.count("*").alias("texts"), F.max("uses").alias("most_uses"))
    goals = spark.createDataFrame([(s, float(share[s]), quotas[s], repeats[s]) for s in sorted(share)], "source string, target_share double, quota bigint, max_repeats int")
    shares = F.broadcast(goals).join(reached, "source", "left").select("source", "target_share", "max_repeats", "quota", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "texts", "most_uses")])
    every = W.partitionBy(F.lit(0))
    return chosen.select("doc_id", "source", "uses", "tokens"), shares.withColumn("share_of_total", F.col("tokens") / F.lit(max(total, 1))).withColumn("share_of_mixture", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(every)), F.lit(0.0)))
