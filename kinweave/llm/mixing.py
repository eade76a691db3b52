"""Mix sources to target weights by min-cost flow.

1. Documents are aggregated by membership pattern (the set of sources that they belong to).
2. Every source gets a target: its share by weight, but no more than `repeats` times its size; what is cut off is shared
   out anew. Targets are min(level * weight, repeats * size), and the level is found by Newton's steps, each an aggregate.
3. Token capacity flows from patterns to source quotas. Every pattern offers its tokens once for each permitted
   repetition, the r-th at cost r, so that costs are convex and nothing is repeated while new tokens are left. Patterns
   that share no source, directly or by way of others, don't touch each other's flow: connected sets of patterns are
   dealt to tasks, and a task finds the flow of all its sets at once.
4. In each pattern, the flow is met by whole rounds of all documents and a seeded selection for the rest: documents
   in hash order while they fit, then others, from long to short and each length in hash order, that still fit, then
   the one that comes nearest to what is left, if taking it helps.

The driver holds no row of documents, patterns or sources. Selection orders by hash buckets, so that no task sorts a
whole source. The documents of one connected set of patterns' counts are in one task: as many rows as it has patterns.

A null source is one of its own, ordered last; so is a null or empty array of sources. Null or empty texts have size 0
and are never taken. The hash covers id and text: rows equal in both are taken alike, other rows under one id are
separate documents, also of null ids. Very long texts count whole. Columns besides those named are ignored; `carry` takes
any others along. Empty tables give no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, small
from .components import components

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEATS = 2
#: Hash buckets of a pattern; only documents of the one bucket where the quota ends are ordered one by one.
BUCKETS = 4096
#: Documents of each length (by powers of 2) and pattern among which the end of a quota is filled.
FILLERS = 128
#: Sources that a task numbers, and patterns whose flow it finds, if their connected sets are no larger.
RANKED, ROUTED = 100_000, 20_000
#: Bytes of a pattern's row in a broadcast, names of sources included.
PLAN_BYTES = 400


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space, 0 for null: starts of words are counted in the text's runs."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """The sources with their rank (from 0) by code point, null last; no task sees them all. sources: source, size."""
    parts = max(1, -(-sources.count() // RANKED))
    null = F.col("source").isNull()
    dealt = sources.withColumn("null", null).repartitionByRange(parts, "null", "source").sortWithinPartitions("null", "source")
    at = F.monotonically_increasing_id()
    dealt = materialize(dealt.select("source", "size", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "mix-sources")
    before, offsets = 0, []
    for r in sorted(dealt.groupBy("part").count().collect()):  # a row for RANKED sources
        offsets.append((r["part"], before))
        before += r["count"]
    if not offsets:
        return dealt.select("source", "size", F.lit(0).cast("long").alias("rank"))
    table = dealt.sparkSession.createDataFrame(offsets, "part int, before bigint")
    return dealt.join(F.broadcast(table), "part").select("source", "size", (F.col("before") + F.col("at")).alias("rank"))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = MAX_REPEATS) -> DataFrame:
    """source, size, rank and target: `share` of all sizes split by weight, none above limit * size, the excess shared
    out anew. The weights repeat over the sources in code point order, null last. sources: source, size."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = ranked(sources).withColumn("weight", weight)
    most = F.col("size") * float(limit)
    total = float(share) * float(table.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"])
    level, held = 0.0, -1
    while True:
        full = F.col("weight") * level >= most
        r = table.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, most)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if r["n"] == held or not r["open"]:
            break
        held, level = r["n"], max(level, (total - (r["full"] or 0.0)) / r["open"])
    return table.select("source", "size", "rank", F.least(F.col("weight") * level, most).alias("target"))


def route(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[float], repeats: int = MAX_REPEATS) -> list[dict[int, float]]:
    """Min-cost flow from patterns to sources; flow[p][s] is what source s takes of pattern p.

    Successive shortest paths, all of one cost at a time: an augmenting path costs as much as the repetition whose tokens
    it begins with, as giving back and rerouting is free. For each repetition the flow is made maximal by blocking flows
    along the layers of a breadth-first search (Dinic). Without overlaps, one pass over the patterns does.
    """
    flow: list[dict[int, float]] = [dict.fromkeys(m, 0.0) for m in members]
    by_source: list[list[int]] = [[] for _ in quota]
    for p, m in enumerate(members):
        for s in m:
            by_source[s].append(p)
    need, used = [float(x) for x in quota], [0.0] * len(capacity)
    eps = 1e-9 * max(1.0, sum(need))
    for level in range(1, repeats + 1):
        free = [level * c - u for c, u in zip(capacity, used, strict=True)]
        while True:
            layer_p, layer_s, end = _layers(members, by_source, flow, free, need, eps)
            if end is None:
                break
            next_p, next_s = [0] * len(members), [0] * len(need)
            for p in range(len(members)):
                if layer_p[p] == 0:
                    _push(p, members, by_source, flow, free, used, need, layer_p, layer_s, end, next_p, next_s, eps)
    return flow


def _layers(members, by_source, flow, free, need, eps):
    """Steps from patterns with free tokens to each pattern and source, and the layer of the nearest sources in need."""
    layer_p, layer_s, end = [-1] * len(members), [-1] * len(need), None
    queue = deque(p for p in range(len(members)) if free[p] > eps)
    for p in queue:
        layer_p[p] = 0
    while queue:
        p = queue.popleft()
        if end is not None and layer_p[p] + 1 > end:
            break
        for s in members[p]:
            if layer_s[s] < 0:
                layer_s[s] = layer_p[p] + 1
                if need[s] > eps:
                    end = layer_s[s]
                elif end is None:
                    for other in by_source[s]:
                        if layer_p[other] < 0 and flow[other][s] > eps:
                            layer_p[other] = layer_s[s] + 1
                            queue.append(other)
    return layer_p, layer_s, end


def _push(start, members, by_source, flow, free, used, need, layer_p, layer_s, end, next_p, next_s, eps):
    """Send the free tokens of a pattern along the layers until none is left or no way leads on."""
    path = [start]  # pattern, source, pattern, source ...
    while path and free[start] > eps:
        node = path[-1]
        if len(path) % 2:  # a pattern: on to a source of the next layer
            if next_p[node] < len(members[node]):
                s = members[node][next_p[node]]
                if layer_s[s] == layer_p[node] + 1 and (layer_s[s] < end or need[s] > eps):
                    path.append(s)
                else:
                    next_p[node] += 1
                continue
        elif layer_s[node] == end:
            x = min(free[start], need[node], *[flow[path[k + 1]][path[k]] for k in range(1, len(path) - 1, 2)])
            for k in range(0, len(path) - 1):
                if k % 2:
                    flow[path[k + 1]][path[k]] -= x
                else:
                    flow[path[k]][path[k + 1]] += x
            free[start] -= x
            used[start] += x
            need[node] -= x
            path = [start]
            continue
        elif next_s[node] < len(by_source[node]):  # a source: a pattern of the next layer gives back what it has from it
            p = by_source[node][next_s[node]]
            if layer_p[p] == layer_s[node] + 1 and flow[p][node] > eps:
                path.append(p)
            else:
                next_s[node] += 1
            continue
        path.pop()
        if path:
            (next_s if len(path) % 2 == 0 else next_p)[path[-1]] += 1


def _flows(patterns: DataFrame, wanted: DataFrame, repeats: int) -> DataFrame:
    """pattern, sources, capacity, flow (tokens to take), and source, source_size and target of its first source."""
    member = patterns.select("pattern", "sources", "capacity", F.explode("sources").alias("of"))
    member = member.join(wanted, F.col("of").eqNullSafe(F.col("source")))
    held = F.sort_array(F.collect_list(F.struct("rank", "target", "size", "source"))).alias("held")
    whole = materialize(member.groupBy("pattern").agg(F.first("sources").alias("sources"), F.first("capacity").alias("capacity"), held), "mix-members")
    first = F.col("held")[0]["rank"]
    found = None
    edges = whole.select(first.alias("a"), F.explode("held.rank").alias("b")).filter("a <> b").distinct()
    if edges.isEmpty():
        sets = whole.select("pattern", "capacity", "held", first.alias("component"))
    else:
        found = components(edges).withColumnRenamed("id", "first")
        sets = whole.withColumn("first", first).join(found, "first", "left").select("pattern", "capacity", "held", F.coalesce("component", "first").alias("component"))
    tasks = max(1, -(-whole.count() // ROUTED))
    dealt = sets.select("pattern", F.col("capacity"), F.col("held.rank").alias("ranks"), F.col("held.target").alias("quotas"), F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task"))

    def routed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pattern")
        quota = dict(sorted((int(r), float(q)) for ranks, quotas in zip(frame["ranks"], frame["quotas"], strict=True) for r, q in zip(ranks, quotas, strict=True)))
        number = {r: k for k, r in enumerate(quota)}
        flow = route([int(c) for c in frame["capacity"]], [[number[int(r)] for r in ranks] for ranks in frame["ranks"]], list(quota.values()), repeats)
        return pd.DataFrame({"pattern": frame["pattern"].to_numpy(), "flow": [float(sum(f.values())) for f in flow]})

    flows = dealt.groupBy("task").applyInPandas(routed, "pattern bigint, flow double")
    one = F.col("held")[0]
    table = whole.join(flows, "pattern").select("pattern", "sources", "capacity", "flow", one["source"].alias("source"), one["size"].alias("source_size"), one["target"].alias("target"))
    table = materialize(table, "mix-flows")
    for old in (whole, found):
        if old is not None:
            discard(old)
    return table


def _fill(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a pattern's documents that are left over, those which fill its gap: long ones first."""
    frame = frame.sort_values(["length", "place"], ascending=[False, True])
    gap, picks, mass = int(frame["gap"].iloc[0]), [], frame["mass"].tolist()
    left = []
    for k, m in enumerate(mass):
        if m <= gap:
            picks.append(k)
            gap -= m
        else:
            left.append(k)
    near = min(left, key=lambda k: (abs(gap - mass[k]), frame["place"].iat[k]), default=None)
    if near is not None and abs(gap - mass[near]) < gap:
        picks.append(near)
    return frame[["pattern", "place"]].iloc[picks]


def select(facts: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each pattern's quota ends. facts: sources, size, place; plan: pattern, sources, capacity, flow.

    Gives the plan with rounds (of all documents), rest, edge and last (documents up to this bucket and place are taken
    once more), and the places (pattern, place) taken beyond them.
    """
    rounds = F.when(F.col("capacity") > 0, F.floor(F.col("flow") / F.col("capacity") + 1e-12)).otherwise(0).cast("long")
    plan = plan.withColumn("rounds", rounds).withColumn("rest", F.round(F.col("flow") - F.col("rounds") * F.col("capacity")).cast("long"))
    worded = facts.filter("size > 0").withColumn("bucket", _bucket())
    asked = worded.join(small(plan.filter("rest > 0").select("sources", "pattern", "rest"), PLAN_BYTES), "sources").select("pattern", "rest", "bucket", "place", "size")
    per_bucket = asked.groupBy("pattern", "bucket").agg(F.sum("size").alias("tokens"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = per_bucket.withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0))).filter("before <= rest and before + tokens > rest")
    edges = materialize(edges.select("pattern", F.col("bucket").alias("edge"), "before"), "mix-edges")
    # equal rows are one unit, so that they are taken alike
    at_edge = asked.join(small(edges, 64), "pattern").filter("bucket = edge").groupBy("pattern", "place").agg(F.sum("size").alias("mass"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    within = Window.partitionBy("pattern").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = at_edge.withColumn("reach", F.col("before") + F.sum("mass").over(within)).filter("reach <= rest")
    ends = at_edge.groupBy("pattern").agg(F.max("place").alias("last"), F.max("reach").alias("reach"))
    cut = plan.join(edges, "pattern", "left").join(ends, "pattern", "left")
    cut = materialize(cut.withColumn("gap", F.when(F.col("edge").isNotNull(), F.col("rest") - F.coalesce("reach", "before"))).drop("before", "reach"), "mix-cuts")
    # what is left over and may bring the sum nearer to the quota
    open_ = cut.filter("gap > 0").select("sources", "pattern", "edge", "last", "rest", "gap")
    over = worded.join(small(open_, PLAN_BYTES), "sources").filter((F.col("size") < 2 * F.col("gap")) & ~_first())
    over = over.groupBy("pattern", "place").agg(F.sum("size").alias("mass"), F.first("gap").alias("gap")).filter("mass < 2 * gap").withColumn("length", F.floor(F.log2("mass")).cast("int"))
    some = over.withColumn("n", F.row_number().over(Window.partitionBy("pattern", "length").orderBy("place"))).filter(F.col("n") <= FILLERS)
    picks = materialize(some.select("pattern", "place", "mass", "gap", "length").groupBy("pattern").applyInPandas(_fill, "pattern bigint, place bigint"), "mix-picks")
    discard(edges)
    return cut, picks


def _bucket() -> Column:
    return F.shiftrightunsigned("place", 64 - (BUCKETS - 1).bit_length()).cast("int")


def _first() -> Column:
    """Whether a document is among those taken once more in hash order; without an edge, a rest takes all of them."""
    before = (_bucket() < F.col("edge")) | ((_bucket() == F.col("edge")) & F.coalesce(F.col("place") <= F.col("last"), F.lit(False)))
    return F.when(F.col("rest") <= 0, F.lit(False)).when(F.col("edge").isNull(), F.lit(True)).otherwise(before)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS, seed: int = 0, size: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Per document: id, source, size, source_size, target (of its source), copies and `carry`.

    source_col may be a string or an array of strings (overlapping sources). For overlapping sources, source_size and
    target are those of the first source.
    """
    many = docs.schema[source_col].dataType.typeName() == "array"
    of = F.col(source_col)
    sources = F.when(F.coalesce(F.size(of), F.lit(0)) > 0, F.array_sort(F.array_distinct(of))).otherwise(F.array(F.lit(None).cast("string"))) if many else F.array(of.cast("string"))
    place = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.lit("mix"))
    rows = docs.select(F.col(id_col).alias("id"), sources.alias("sources"), (word_count(F.col(text_col)) if size is None else size).alias("size"), place.alias("place"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)])
    facts = materialize(rows.select("id", "sources", "size", "place"), "mix-sizes")  # read several times below, the texts once
    patterns = materialize(facts.groupBy("sources").agg(F.sum("size").alias("capacity")).withColumn("pattern", F.monotonically_increasing_id()), "mix-patterns")
    sizes = patterns.select(F.explode("sources").alias("source"), "capacity").groupBy("source").agg(F.sum("capacity").alias("size"))
    plan = _flows(patterns, targets(sizes, weights, share, repeats), repeats)
    cut, picks = select(facts, plan)
    taken = (rows if carry else facts).join(small(cut, PLAN_BYTES), "sources")
    taken = taken.join(small(picks.withColumn("picked", F.lit(True)), 64), ["pattern", "place"], "left")
    extra = (_first() | F.coalesce("picked", F.lit(False))).cast("long")
    copies = F.when(F.col("size") > 0, F.col("rounds") + extra).otherwise(0)
    return taken.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)])
