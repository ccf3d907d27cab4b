"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents with equal sets of sources form one pattern. The driver holds only the patterns' token sums (at most
``max_patterns``, else an error), gives each source a quota and routes pattern tokens to quotas. The k-th repetition of a
pattern's tokens costs k - 1 for each token, a convex cost on the arcs from the origin alone; so the cheapest flow of most
tokens comes from opening the repetitions one after another and augmenting each time, which never takes back flow from
the origin. Documents are then selected in a seeded order: running token sums (in two levels, so that no task sees a
whole pattern) place each document's middle in the flow's ranges.

Cases: null texts have size 0 and are taken 0 words; a null source is a source of its own, last; documents without any
source are in no mix; rows with equal ids are separate documents; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.llm.store import written

WEIGHTS = (3, 1, 2)
BUCKET_ROWS = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: dict[str | None, int], share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> dict[str | None, float]:
    """Targets by weight, repeating in code point order with null last; one above ``most`` times its size stops there and the rest share its excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if part[s] > most * sizes[s]]
        if not over:
            return out | part
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], repeats: int) -> list[list[dict[int, int]]]:
    """flow[pattern][repetition][source] of most tokens and least cost."""
    n = len(supply)
    room, left = [0] * n, list(quota)
    sent: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in members]
    users: list[list[int]] = [[] for _ in quota]
    for p, m in enumerate(members):
        for s in m:
            users[s].append(p)
    totals = []
    for _ in range(repeats):
        room = [r + x for r, x in zip(room, supply, strict=True)]
        for p in range(n):
            while room[p]:
                came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None}
                todo, found = deque([("p", p)]), None
                while todo and found is None:
                    kind, x = todo.popleft()
                    for y in members[x] if kind == "p" else [q for q in users[x] if sent[q][x]]:
                        node = ("s" if kind == "p" else "p", y)
                        if node not in came:
                            came[node] = (kind, x)
                            if node[0] == "s" and left[y]:
                                found = node
                                break
                            todo.append(node)
                if found is None:
                    break
                path = [found]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                back = [(path[i][1], path[i + 1][1]) for i in range(1, len(path) - 1, 2)]  # (source, pattern) whose flow shrinks
                amount = min([room[p], left[found[1]], *(sent[q][s] for s, q in back)])
                for s, q in back:
                    sent[q][s] -= amount
                for i in range(0, len(path) - 1, 2):
                    sent[path[i][1]][path[i + 1][1]] += amount
                room[p] -= amount
                left[found[1]] -= amount
        totals.append([sum(x.values()) for x in sent])
    out: list[list[dict[int, int]]] = []
    for p in range(n):
        rest, steps = {s: x for s, x in sent[p].items() if x}, []
        for k in range(repeats):
            need = max(0, min(supply[p], sum(sent[p].values()) - k * supply[p]))
            step: dict[int, int] = {}
            for s in list(rest):
                if take := min(need, rest[s]):
                    step[s] = take
                    need -= take
                    rest[s] -= take
            steps.append(step)
        out.append(steps)
    return out


def mix(docs: DataFrame, sources: Column, size: Column, id_col: str = "doc_id", repeats: int = 2, share: float = 1.5, seed: int = 17, max_patterns: int = 100_000) -> DataFrame:
    """(id_col, size, source_size, target, taken, picked array<string>) of each document.

    ``sources``: array of the document's sources. ``source_size`` and ``target`` are those of the first of them in code
    point order; ``picked`` has the source whose quota each taken repetition fills.
    """
    rows = docs.select(F.col(id_col), F.array_sort(F.array_distinct(sources)).alias("sources"), size.alias("size")).withColumn("pattern", F.to_json("sources"))
    rows = written(rows.withColumn("h", F.xxhash64(F.col(id_col), F.lit(seed))), "mix-sizes")
    spark = docs.sparkSession
    found = rows.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("tokens"), F.count("*").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    found = sorted((r for r in found if r["sources"]), key=lambda r: r["pattern"])
    names = sorted({s for r in found for s in r["sources"]}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r["tokens"] for r in found if s in r["sources"]) for s in names}
    targets = source_targets(sizes, share, repeats)
    at = {s: i for i, s in enumerate(names)}
    flow = min_cost_flow([r["tokens"] for r in found], [[at[s] for s in r["sources"]] for r in found], [round(targets[s]) for s in names], repeats)
    plan = []
    for r, steps in zip(found, flow, strict=True):
        ranges, first = [], r["sources"][0]
        for step in steps:
            upto, cuts = 0, []
            for s, x in step.items():
                upto += x
                cuts.append((upto, names[s]))
            ranges.append(cuts)
        plan.append((r["pattern"], max(1, -(-r["n"] // BUCKET_ROWS)), sizes[first], float(targets[first]), ranges))
    shape = "_pattern string, buckets bigint, source_size bigint, target double, ranges array<array<struct<upto:bigint,name:string>>>"
    plans = F.broadcast(spark.createDataFrame(plan, shape))  # at most max_patterns rows
    dealt = rows.join(plans.select("_pattern", "buckets"), F.col("pattern") == F.col("_pattern"), "left").withColumn("bucket", F.pmod("h", F.coalesce("buckets", F.lit(1)))).select(id_col, "size", "pattern", "h", "bucket")
    sums = dealt.groupBy("pattern", "bucket").agg(F.sum("size").alias("sum"))
    before = sums.select(F.col("pattern").alias("_p"), F.col("bucket").alias("_b"), (F.sum("sum").over(W.partitionBy("pattern").orderBy("bucket")) - F.col("sum")).alias("before"))
    placed = dealt.join(before, F.col("pattern").eqNullSafe(F.col("_p")) & (F.col("bucket") == F.col("_b")))
    upto = F.sum("size").over(W.partitionBy("pattern", "bucket").orderBy("h", id_col, "size").rowsBetween(W.unboundedPreceding, 0))
    placed = placed.withColumn("middle", F.col("before") + upto - F.col("size") / 2)
    whole = placed.join(plans, F.col("pattern") == F.col("_pattern"), "left")
    hit = F.filter(F.transform("ranges", lambda cuts: F.filter(cuts, lambda c: (F.col("size") > 0) & (F.col("middle") < c["upto"]))), lambda cuts: F.size(cuts) > 0)
    return whole.select(id_col, "size", "source_size", "target", (F.col("size") * F.coalesce(F.size(hit), F.lit(0))).cast("bigint").alias("taken"), F.transform(hit, lambda cuts: cuts[0]["name"]).alias("picked"))
