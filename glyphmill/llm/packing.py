"""Filling fixed-capacity containers with items (problem 7): hierarchical residual packing.

Each partition packs its items best-fit in decreasing order and emits the nearly full containers. The underfull ones
go on as items of the next round, merged into as many tasks as their measured number asks for, and are packed again,
until what room they leave is too little to save a container, or a round no longer saves any to speak of.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.tokens import TOKENIZERS, token_counts
from glyphmill.session import cut, shuffle_width

#: A container filled to this share is emitted; the others are packed again.
FULL = 0.985
#: A round that leaves more than this share of the underfull containers of the round before is the last.
SHRINK = 0.98
#: Tasks of a round at least: what is left over is spread, however little it is.
LEAST_TASKS = 2
#: Items packed together in one step; a partition holds no more than these and what is left of the step before.
WINDOW = 20_000
#: The budget table is small by nature; more rows than this are refused.
MAX_BUDGETS = 100

_BIN = "budget_id int, capacity bigint, size bigint, docs array<bigint>, parts array<int>, sizes array<bigint>, done boolean"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items (by position) of each container. No size may exceed the capacity."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    free: list[tuple[int, int]] = []  # (room left, container), sorted
    bins: list[list[int]] = []
    for i in order:
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > sizes[i]:
            insort(free, (room - sizes[i], b))
    return bins


def _pack(full: float):
    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[tuple[int, int], list] = {}

        def emit(key: tuple[int, int], last: bool) -> pd.DataFrame:
            items, (budget, capacity) = waiting[key], key
            rows, left = [], []
            for members in best_fit([x[0] for x in items], capacity):
                size = sum(items[i][0] for i in members)
                merged = (size, [d for i in members for d in items[i][1]], [p for i in members for p in items[i][2]], [s for i in members for s in items[i][3]])
                done = size >= full * capacity
                if done or last:
                    rows.append((budget, capacity, *merged, done))
                else:
                    left.append(merged)
            if len(left) > WINDOW // 2:  # they do not combine here: let the next round see them
                rows += [(budget, capacity, *m, False) for m in left]
                left = []
            waiting[key] = left
            return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _BIN.split(", ")])

        for frame in frames:
            for budget, capacity, size, docs, parts, sizes in zip(frame["budget_id"], frame["capacity"], frame["size"], frame["docs"], frame["parts"], frame["sizes"]):
                key = (int(budget), int(capacity))
                waiting.setdefault(key, []).append((int(size), list(docs), list(parts), list(sizes)))
                if len(waiting[key]) >= WINDOW:
                    yield emit(key, last=False)
        for key in sorted(waiting):
            if waiting[key]:
                yield emit(key, last=True)

    return packed


def items(sizes: DataFrame, budgets: list[tuple[int, int]], key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(budget_id, capacity, doc_id, part_no, n_tokens): what is to be packed, for every budget.

    A text within the capacity is one item. A larger one is split: parts of a whole capacity and the rest.
    """
    offered = sizes.select(
        F.col(key).alias("doc_id"), F.col(size).cast("bigint").alias("total"),
        F.explode(F.array(*[F.struct(F.lit(b).cast("int").alias("budget_id"), F.lit(c).cast("bigint").alias("capacity")) for b, c in budgets])).alias("b"),
    ).select("doc_id", "total", "b.*").filter("total > 0")
    last = F.floor((F.col("total") - 1) / F.col("capacity")).cast("int")
    return offered.select("budget_id", "capacity", "doc_id", "total", F.explode(F.sequence(F.lit(0), last)).alias("part_no")).select(
        "budget_id", "capacity", "doc_id", "part_no", F.least(F.col("capacity"), F.col("total") - F.col("part_no") * F.col("capacity")).alias("n_tokens")
    )


def pack(sizes: DataFrame, budgets: list[tuple[int, int]], key: str = "doc_id", size: str = "n_tokens", partitions: int | None = None, full: float = FULL) -> DataFrame:
    """(budget_id, capacity, container_id, doc_id, part_no, n_tokens): each item's container, for every budget.

    Sizes of zero or null need no container and give no row. container_id names the container by its smallest item,
    so it does not depend on the run. Calling it runs the rounds, each written to the checkpoint folder. The number of
    underfull containers decides how many tasks a round has: half a window of them each, and never one task alone.
    """
    spark = sizes.sparkSession
    if not budgets:
        return spark.createDataFrame([], "budget_id int, capacity bigint, container_id string, doc_id bigint, part_no int, n_tokens bigint")
    width = max(LEAST_TASKS, partitions or shuffle_width(spark))
    offered = items(sizes, budgets, key, size).select("budget_id", "capacity", F.col("n_tokens").alias("size"), F.array("doc_id").alias("docs"), F.array("part_no").alias("parts"), F.array("n_tokens").alias("sizes"))
    closed = offered.filter("size = capacity").withColumn("done", F.lit(True))
    open_bins, before, at = offered.filter("size < capacity"), None, 0
    while True:
        # the same rows meet in the same order in every attempt, so a lost task gives the same containers again
        spread = open_bins.repartition(width, F.pmod(F.xxhash64("docs", "parts", F.lit(at)), F.lit(1 << 20))).sortWithinPartitions("budget_id", "docs", "parts")
        bins = cut(spread.mapInPandas(_pack(full), _BIN))
        left = bins.filter("NOT done").groupBy("budget_id").agg(F.count("*").alias("n"), F.sum((F.col("capacity") - F.col("size")) / F.col("capacity")).alias("room")).collect()  # a row per budget
        n = sum(r.n for r in left)
        width = max(LEAST_TASKS, -(-2 * n // WINDOW))
        if not any(r.room >= width for r in left) or before is not None and n > SHRINK * before:
            closed = closed.unionByName(bins)
            break
        closed, open_bins, before, at = closed.unionByName(bins.filter("done")), bins.filter("NOT done").drop("done"), n, at + 1
    member = F.arrays_zip(F.col("docs").alias("doc_id"), F.col("parts").alias("part_no"), F.col("sizes").alias("n_tokens"))
    first = F.array_min(F.transform(member, lambda m: F.struct(m["doc_id"], m["part_no"])))
    name = F.concat_ws("-", F.col("budget_id").cast("string"), first["doc_id"].cast("string"), first["part_no"].cast("string"))
    return closed.select("budget_id", "capacity", name.alias("container_id"), F.explode(member).alias("m")).select("budget_id", "capacity", "container_id", "m.doc_id", "m.part_no", "m.n_tokens")


def budget_list(budgets: DataFrame) -> list[tuple[int, int]]:
    """(budget_id, capacity) of the small budget table; rows without a positive capacity are ignored."""
    rows = budgets.select("budget_id", "capacity").filter("budget_id is not null and capacity > 0").distinct().limit(MAX_BUDGETS + 1).collect()
    if len(rows) > MAX_BUDGETS:
        raise ValueError(f"more than {MAX_BUDGETS} budgets")
    return sorted((r.budget_id, r.capacity) for r in rows)


def pack_documents(documents: DataFrame, budgets: DataFrame, tokenizer: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """Documents, sized in tokens, in containers of every capacity of the budget table."""
    return pack(cut(token_counts(documents, name=tokenizer, tokenizers=tokenizers)), budget_list(budgets))


def fill_report(packed: DataFrame) -> DataFrame:
    """(budget_id, capacity, n_containers, n_items, n_tokens, fill, least_containers): how full the containers are."""
    per = packed.groupBy("budget_id", "capacity", "container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    return per.groupBy("budget_id", "capacity").agg(F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("n_tokens").alias("n_tokens")).withColumn(
        "fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))
    ).withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity")))


def packing_faults(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(budget_id, capacity, n_documents, n_over, n_amiss): packed documents, containers beyond their capacity, and documents whose parts are not the whole.

    Parts amiss do not add up to the document, are cut without need, or lack a place in their order.
    """
    over = packed.groupBy("budget_id", "capacity", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("budget_id", "capacity").agg(F.count_if(F.col("n") > F.col("capacity")).alias("n_over"))
    parts = packed.groupBy("budget_id", "capacity", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("n_parts"), F.countDistinct("part_no").alias("places"), F.max("part_no").alias("last"))
    told = parts.join(sizes.select("doc_id", "n_tokens"), "doc_id")
    right = (F.col("n") == F.col("n_tokens")) & (F.col("n_parts") == F.ceil(F.col("n_tokens") / F.col("capacity"))) & (F.col("places") == F.col("n_parts")) & (F.col("last") == F.col("n_parts") - 1)
    return told.groupBy("budget_id", "capacity").agg(F.count("*").alias("n_documents"), F.count_if(~right).alias("n_amiss")).join(over, ["budget_id", "capacity"])
