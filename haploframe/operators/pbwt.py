"""Positional prefix order of a panel, divergence, statistics and the states selected from them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import AS_IMPLEMENTED, MISSING, ImputationError
from ..storage import shared_path

#: Markers whose prefix orders one task makes from the order before them, and cells (markers x haplotypes) of that at most.
BLOCK = 512
BLOCK_CELLS = 1 << 24
#: Summaries of blocks that are combined to one.
FAN = 16
#: A compact index: for each block the state before it and each marker's column of bits, in the order before the marker, as run lengths.
COMPACT = "chrom string, block int, before int, order binary, start binary, markers array<int>, columns array<binary>"
ORDERS = "chrom string, marker_idx int, order array<int>, divergence array<int>"
SUMMARY = "chrom string, block int, n int, order binary, start binary"
STATE = "chrom string, block int, before int, order binary, start binary"


def with_keys(alleles: DataFrame) -> DataFrame:
    """Adds revkey: for each haplotype the bits (allele is not 0) of this marker, the one before, and so on to the first."""
    bit = F.when(F.coalesce("allele", F.lit(MISSING)) == 0, "0").otherwise("1")
    back = Window.partitionBy("hap_idx").orderBy("marker_idx").rowsBetween(Window.unboundedPreceding, 0)
    return alleles.withColumn("revkey", F.reverse(F.array_join(F.collect_list(bit).over(back), "")))


def prefix_order(alleles: DataFrame) -> DataFrame:
    """marker_idx, rank, hap_idx: haplotypes sorted by their reversed prefixes, ties by index. alleles: marker_idx, hap_idx, allele of a full panel."""
    by = Window.partitionBy("marker_idx").orderBy("revkey", "hap_idx")
    return with_keys(alleles).select("marker_idx", (F.row_number().over(by) - 1).alias("rank"), "hap_idx")


def regroup(order: np.ndarray, start: np.ndarray, key: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order sorted stably by each haplotype's key, and the first column of each one's match with its new predecessor: the greatest one passed on the way inside a key, heads[key] for its first."""
    k = key[order]
    perm = np.argsort(k, kind="stable")
    k = k[perm]
    new = heads[k].astype(np.int32)
    same = np.flatnonzero(k[1:] == k[:-1])
    if len(same):
        ends = np.stack((perm[same] + 1, perm[same + 1] + 1), 1).ravel()
        new[same + 1] = np.maximum.reduceat(np.append(start, 0), ends)[::2]
    return order[perm], new


def add_column(order: np.ndarray, start: np.ndarray, alleles: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    return regroup(order, start, (alleles != 0).astype(np.uint8), np.array([m + 1, m + 1]))


def compose(order: np.ndarray, start: np.ndarray, before: int, o: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order, and where matches begin, before some markers, and the same of the n markers after them as if they were the first: those of both. Haplotypes that are equal throughout the later markers keep their order. This is associative."""
    first = s > 0
    first[0] = True
    key, heads = np.empty(len(o), np.int32), before + s[first]
    key[o] = np.cumsum(first) - 1
    heads[0] = before + n
    return regroup(order, start, key, heads)


def ints(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int32)


def packed(*columns: tuple[str, list, pa.DataType]) -> pa.Table:
    return pa.table({name: pa.array(values, kind) for name, values, kind in columns})


def sorted_rows(table: pa.Table, by: str) -> list[dict]:
    """A group's rows in order, the one without a place first."""
    return sorted(table.to_pylist(), key=lambda r: -1 if r[by] is None else r[by])


def fold_block(table: pa.Table) -> pa.Table:
    """A block's (chrom, block, marker_idx, alleles) rows to its summary: its last order, as if it began its chromosome."""
    rows = sorted_rows(table, "marker_idx")
    haps = len(rows[0]["alleles"])
    order, start = np.arange(haps, dtype=np.int32), np.zeros(haps, np.int32)
    for m, r in enumerate(rows):
        order, start = add_column(order, start, np.frombuffer(r["alleles"], np.uint8), m)
    return packed(("chrom", [rows[0]["chrom"]], pa.string()), ("block", [rows[0]["block"]], pa.int32()), ("n", [len(rows)], pa.int32()), ("order", [order.astype(np.int32).tobytes()], pa.binary()), ("start", [start.tobytes()], pa.binary()))


def combined(table: pa.Table) -> pa.Table:
    """Neighbouring summaries to one."""
    rows = sorted_rows(table, "block")
    order, start, n = ints(rows[0]["order"]), ints(rows[0]["start"]), rows[0]["n"]
    for r in rows[1:]:
        order, start = compose(order, start, n, ints(r["order"]), ints(r["start"]), r["n"])
        n += r["n"]
    return packed(("chrom", [rows[0]["chrom"]], pa.string()), ("block", [rows[0]["parent"]], pa.int32()), ("n", [n], pa.int32()), ("order", [order.astype(np.int32).tobytes()], pa.binary()), ("start", [start.tobytes()], pa.binary()))


def carried(table: pa.Table) -> pa.Table:
    """Summaries of neighbours, and the state before the first of them (a row without n; the chromosome's begin if there is none), to the state before each."""
    rows = sorted_rows(table, "n_block")
    given = rows[0] if rows[0]["n"] is None else None
    rows = rows[1:] if given else rows
    order, start, before = (ints(given["order"]), ints(given["start"]), given["before"]) if given else (np.arange(len(ints(rows[0]["order"])), dtype=np.int32), np.zeros(len(ints(rows[0]["order"])), np.int32), 0)
    out = []
    for r in rows:
        out.append((r["block"], before, order.astype(np.int32).tobytes(), start.tobytes()))
        order, start = compose(order, start, before, ints(r["order"]), ints(r["start"]), r["n"])
        before += r["n"]
    blocks, befores, orders, starts = map(list, zip(*out)) if out else ([], [], [], [])
    return packed(("chrom", [r["chrom"] for r in rows], pa.string()), ("block", blocks, pa.int32()), ("before", befores, pa.int32()), ("order", orders, pa.binary()), ("start", starts, pa.binary()))


def replayed(table: pa.Table) -> pa.Table:
    """A block's rows and the state before it (a row without marker_idx) to the order at each of its markers."""
    state, *rows = sorted_rows(table, "marker_idx")
    order, start, orders, starts = ints(state["order"]), ints(state["start"]), [], []
    for m, r in enumerate(rows, state["before"]):
        order, start = add_column(order, start, np.frombuffer(r["alleles"], np.uint8), m)
        orders.append(order), starts.append(start)
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(order), pa.int32()), pa.array(np.concatenate(x).astype(np.int32))) for x in (orders, starts)]
    return pa.table({"chrom": pa.array([r["chrom"] for r in rows], pa.string()), "marker_idx": pa.array([r["marker_idx"] for r in rows], pa.int32()), "order": lists[0], "divergence": lists[1]})


def runs_of(bits: np.ndarray) -> bytes:
    """Lengths of the runs of equal bits, the first one of zeros (of length 0 if there is none), in groups of seven bits."""
    n = np.diff(np.concatenate(([0], np.flatnonzero(bits[1:] != bits[:-1]) + 1, [len(bits)])))
    n = np.concatenate(([0], n)) if len(bits) and bits[0] else n
    # Low groups first, the highest bit tells that more follow.
    groups = np.maximum(1, -(-np.frexp(n.astype(np.float64))[1] // 7))
    out, ends = np.zeros(groups.sum(), np.uint8), np.cumsum(groups)
    for k in range(int(groups.max(initial=0))):
        some = groups > k
        out[(ends - groups)[some] + k] = (n[some] >> 7 * k & 127) | ((groups[some] > k + 1) << 7)
    return out.tobytes()


def bits_of(runs: bytes) -> np.ndarray:
    x = np.frombuffer(runs, np.uint8)
    first = np.concatenate(([True], x[:-1] < 128))
    of = np.cumsum(first) - 1
    place = np.arange(len(x)) - np.flatnonzero(first)[of]
    n = np.bincount(of, (x & 127).astype(np.float64) * 128.0**place).astype(np.int64)
    return np.repeat(np.arange(len(n), dtype=np.uint8) & 1, n)


def compacted(table: pa.Table) -> pa.Table:
    """What replayed takes, to a row of a compact index."""
    state, *rows = sorted_rows(table, "marker_idx")
    order, start, columns = ints(state["order"]), ints(state["start"]), []
    for m, r in enumerate(rows, state["before"]):
        a = np.frombuffer(r["alleles"], np.uint8)
        columns.append(runs_of((a != 0).astype(np.uint8)[order]))
        order, start = add_column(order, start, a, m)
    fields = [("chrom", state["chrom"], pa.string()), ("block", state["block"], pa.int32()), ("before", state["before"], pa.int32()), ("order", state["order"], pa.binary()), ("start", state["start"], pa.binary()), ("markers", [r["marker_idx"] for r in rows], pa.list_(pa.int32())), ("columns", columns, pa.list_(pa.binary()))]
    return packed(*((name, [v], kind) for name, v, kind in fields))


def expanded(batches):
    """Rows of a compact index to the orders at their markers, some markers at a time."""
    for batch in batches:
        for r in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
            order, start, done = ints(r["order"]), ints(r["start"]), []
            for m, (marker, runs) in enumerate(zip(r["markers"], r["columns"])):
                bits = np.empty(len(order), np.uint8)
                bits[order] = bits_of(runs)
                order, start = add_column(order, start, bits, r["before"] + m)
                done.append((marker, order, start))
                if len(done) * len(order) >= 1 << 20 or m + 1 == len(r["markers"]):
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(done) + 1) * len(order), pa.int32()), pa.array(np.concatenate(x).astype(np.int32))) for x in list(zip(*done))[1:]]
                    yield pa.RecordBatch.from_arrays([pa.array([r["chrom"]] * len(done), pa.string()), pa.array([d[0] for d in done], pa.int32()), *lists], ["chrom", "marker_idx", "order", "divergence"])
                    done = []


def states_before(own: DataFrame, blocks: int, fan: int) -> DataFrame:
    """STATE rows of SUMMARY rows: a tree of summaries, fan to one, up; then the states down to its leaves."""
    leaves = own.withColumn("parent", F.expr(f"block div {fan}").cast("int"))
    down = leaves.select("chrom", "parent", "block", "n", F.lit(None).cast("int").alias("before"), "order", "start", F.col("block").alias("n_block"))
    if blocks > fan:
        spark = own.sparkSession
        path = shared_path(spark, "summaries")
        leaves.groupBy("chrom", "parent").applyInArrow(combined, SUMMARY).write.parquet(path)
        above = states_before(spark.read.schema(SUMMARY).parquet(path), -(-blocks // fan), fan)
        none = F.lit(None).cast("int")
        down = down.unionByName(above.select("chrom", F.col("block").alias("parent"), none.alias("block"), none.alias("n"), "before", "order", "start", none.alias("n_block")))
    return down.groupBy("chrom", "parent").applyInArrow(carried, STATE)


def blocks_of(panel: DataFrame, block: int | None, fan: int) -> DataFrame | None:
    """The rows of each block of markers and, without a marker_idx, the state before it; None for an empty panel.

    Blocks of markers are folded on their own to summaries, two numbers a haplotype and block. Summaries are combined in
    a tree, fan of them at a time, and the order before each block comes down the tree. No task has more than a block's
    cells or fan summaries. block: markers, by default as many as bound the cells.
    """
    last, haps = panel.agg(F.max("marker_idx"), F.max(F.octet_length("alleles"))).first()
    if not haps:
        return None
    block = block or max(1, min(BLOCK, BLOCK_CELLS // haps))
    rows = panel.select("chrom", F.expr(f"cast(marker_idx div {block} as int)").alias("block"), F.col("marker_idx").cast("int").alias("marker_idx"), "alleles")
    blocks = last // block + 1
    own = rows.groupBy("chrom", "block").applyInArrow(fold_block, SUMMARY)
    if blocks > fan:
        path = shared_path(panel.sparkSession, "summaries")
        own.write.parquet(path)
        own = panel.sparkSession.read.schema(SUMMARY).parquet(path)
    return rows.unionByName(states_before(own, blocks, fan), allowMissingColumns=True)


def fold_order(panel: DataFrame, block: int | None = None, fan: int = FAN) -> DataFrame:
    """chrom, marker_idx, order, divergence of a wide panel (chrom, marker_idx, alleles binary): blocks of markers are folded again from the order before them."""
    both = blocks_of(panel, block, fan)
    return panel.sparkSession.createDataFrame([], ORDERS) if both is None else both.groupBy("chrom", "block").applyInArrow(replayed, ORDERS)


def compact_index(panel: DataFrame, block: int = 64, fan: int = FAN) -> DataFrame:
    """A compact index (COMPACT) of a wide panel: a state every block markers and columns of run lengths, from which expand makes all orders again."""
    both = blocks_of(panel, block, fan)
    return panel.sparkSession.createDataFrame([], COMPACT) if both is None else both.groupBy("chrom", "block").applyInArrow(compacted, COMPACT)


def expand(compact: DataFrame) -> DataFrame:
    """What fold_order gives, from a compact index; blocks are independent of each other."""
    return compact.select(*(c.split()[0] for c in COMPACT.split(", "))).mapInArrow(expanded, ORDERS)


def wide(alleles: DataFrame, marks: DataFrame) -> DataFrame:
    """chrom, marker_idx, alleles (a byte for each haplotype, 255 for a missing one) of a full panel in rows."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("hap_idx", F.coalesce("allele", F.lit(MISSING)).alias("a")))), lambda c: F.lpad(F.hex(c["a"]), 2, "0"))
    rows = alleles.groupBy("marker_idx").agg(F.unhex(F.array_join(cells, "")).alias("alleles"))
    return rows.join(marks.select("marker_idx", "chrom"), "marker_idx").select("chrom", "marker_idx", "alleles")


def save_index(index: DataFrame, path: str) -> None:
    """The orders of a panel, or a compact index, as Parquet by marker."""
    by = ["chrom", "block"] if "columns" in index.columns else ["marker_idx"]
    index.repartitionByRange(*by).sortWithinPartitions(*by).write.option("compression", "zstd").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The orders from either."""
    found = spark.read.parquet(path)
    return expand(found) if "columns" in found.columns else found.select("chrom", "marker_idx", "order", "divergence")


def choose(index: DataFrame, states: int, n: int, selector: str = "auto") -> DataFrame:
    """marker_idx, state, hap0, hap1 like select_states, from the lists of an index without a row for each haplotype."""
    rule = selector_for(states, n, selector)
    order = F.col("order")
    if rule == "warp" and (n >= 128 or n % 32 == 0):
        picks = F.transform(F.sequence(F.lit(0), F.lit(min(4, n // 32, states) - 1)), lambda k: F.get(order, 32 * k))
    elif rule == "longest":
        by = F.array_sort(F.transform(F.arrays_zip("divergence", "order"), lambda x, i: F.struct(x["divergence"], i, x["order"].alias("h"))))
        picks = F.transform(F.slice(by, 1, states), lambda x: x["h"])
    else:
        picks = F.slice(order, 1, states)
    rows = index.withColumn("_picks", picks)
    each = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda k: F.coalesce(F.get("_picks", k), k % n))
    return _pairs(rows.select("marker_idx", F.posexplode(each).alias("state", "hap0")), n)


def divergence(alleles: DataFrame, mode: str = AS_IMPLEMENTED) -> DataFrame:
    """marker_idx, rank, hap_idx, divergence. As implemented it is the marker; documented: the first column of the longest match with the predecessor, marker + 1 without any."""
    if mode == AS_IMPLEMENTED:
        return prefix_order(alleles).withColumn("divergence", F.col("marker_idx"))
    by = Window.partitionBy("marker_idx").orderBy("revkey", "hap_idx")
    k = with_keys(alleles).withColumn("before", F.lag("revkey").over(by))
    differ = F.array_position(F.zip_with(F.split("revkey", ""), F.split("before", ""), lambda x, y: x != y), True)
    n = F.col("marker_idx") + 1
    common = F.when(F.col("before").isNull(), 0).when(differ == 0, n).otherwise(differ - 1)
    return k.select("marker_idx", (F.row_number().over(by) - 1).alias("rank"), "hap_idx", (n - common).cast("int").alias("divergence"))


def stats(div: DataFrame, order: DataFrame, alleles: DataFrame) -> DataFrame:
    """marker_idx, avg_divergence, median_divergence, max_divergence and run_ratio, runs of equal alleles in prefix order over haplotypes."""
    d = div.groupBy("marker_idx").agg(F.avg("divergence").alias("avg_divergence"), F.percentile("divergence", 0.5).alias("median_divergence"), F.max("divergence").alias("max_divergence"))
    by = Window.partitionBy("marker_idx").orderBy("rank")
    a = order.join(alleles, ["marker_idx", "hap_idx"]).withColumn("v", F.coalesce("allele", F.lit(MISSING)))
    runs = a.withColumn("new", (~F.col("v").eqNullSafe(F.lag("v").over(by))).cast("int")).groupBy("marker_idx").agg((F.sum("new") / F.count("*")).alias("run_ratio"))
    return d.join(runs, "marker_idx")


def validate(order: DataFrame) -> DataFrame:
    """marker_idx, haplotypes, is_permutation."""
    g = order.groupBy("marker_idx").agg(F.count("*").alias("haplotypes"), F.countDistinct("hap_idx").alias("d"), F.min("hap_idx").alias("lo"), F.max("hap_idx").alias("hi"), F.countDistinct("rank").alias("r"))
    return g.select("marker_idx", "haplotypes", ((F.col("d") == F.col("haplotypes")) & (F.col("r") == F.col("haplotypes")) & (F.col("lo") == 0) & (F.col("hi") == F.col("haplotypes") - 1)).alias("is_permutation"))


def validate_sorted(order: DataFrame, alleles: DataFrame) -> DataFrame:
    """Adds is_sorted to validate: a marker's order is the one before it, parted stably by (allele is not 0)."""
    bit = (F.coalesce("allele", F.lit(MISSING)) != 0).cast("int")
    by_hap, by_rank = Window.partitionBy("hap_idx").orderBy("marker_idx"), Window.partitionBy("marker_idx").orderBy("rank")
    a = order.join(alleles.select("marker_idx", "hap_idx", bit.alias("bit")), ["marker_idx", "hap_idx"])
    a = a.withColumn("key", F.struct("bit", F.coalesce(F.lag("rank").over(by_hap), F.col("hap_idx"))))
    s = a.withColumn("up", F.coalesce(F.lag("key").over(by_rank) < F.col("key"), F.lit(True))).groupBy("marker_idx").agg(F.bool_and("up").alias("is_sorted"))
    return validate(order).join(s, "marker_idx")


def _pairs(chosen: DataFrame, n: int) -> DataFrame:
    """Each state is a haplotype and its right neighbour, round the panel."""
    return chosen.select("marker_idx", F.col("state").cast("int").alias("state"), F.col("hap0").cast("int").alias("hap0"), ((F.col("hap0") + 1) % n).cast("int").alias("hap1"))


def _padded(chosen: DataFrame, states: int, n: int) -> DataFrame:
    """States a marker has no choice for are their own number modulo the panel's size."""
    marks = chosen.select("marker_idx").distinct()
    grid = marks.select("marker_idx", F.explode(F.sequence(F.lit(0), F.lit(states - 1))).alias("state"))
    return _pairs(grid.join(chosen.select("marker_idx", "state", "hap0"), ["marker_idx", "state"], "left").withColumn("hap0", F.coalesce("hap0", F.col("state") % n)), n)


def select_first(order: DataFrame, states: int, n: int) -> DataFrame:
    """The first states of the prefix order (all divergences tie), padded."""
    return _padded(order.filter(F.col("rank") < states).select("marker_idx", F.col("rank").alias("state"), F.col("hap_idx").alias("hap0")), states, n)


def select_warp(order: DataFrame, states: int, n: int) -> DataFrame:
    """Ranks 0, 32, 64 and 96 as far as the panel has whole groups of 32, then padding. Panels that are no multiple of 32 and under 128 take the first ranks."""
    if n < 128 and n % 32:
        return select_first(order, states, n)
    picks = min(4, n // 32, states)
    return _padded(order.filter((F.col("rank") % 32 == 0) & (F.col("rank") < 32 * picks)).select("marker_idx", (F.col("rank") / 32).cast("int").alias("state"), F.col("hap_idx").alias("hap0")), states, n)


def select_longest(div: DataFrame, states: int, n: int) -> DataFrame:
    """The longest matches with the predecessor: smallest documented divergence first, then rank."""
    by = Window.partitionBy("marker_idx").orderBy("divergence", "rank")
    return _padded(div.select("marker_idx", (F.row_number().over(by) - 1).alias("state"), F.col("hap_idx").alias("hap0")).filter(F.col("state") < states), states, n)


def select_simple(marks: DataFrame, states: int, n: int) -> DataFrame:
    """Without an index: haplotypes 2k and 2k + 1, round the panel."""
    grid = marks.select("marker_idx", F.explode(F.sequence(F.lit(0), F.lit(states - 1))).alias("state"))
    return grid.select("marker_idx", "state", ((2 * F.col("state")) % n).cast("int").alias("hap0"), ((2 * F.col("state") + 1) % n).cast("int").alias("hap1"))


def select_dynamic(order: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The first of the order, a number of states for each marker (marker_idx, states)."""
    return _pairs(order.join(wanted, "marker_idx").filter(F.col("rank") < F.col("states")).select("marker_idx", F.col("rank").alias("state"), F.col("hap_idx").alias("hap0")), n)


def selector_for(states: int, n: int, selector: str = "auto") -> str:
    """The rule for these sizes, or the one named."""
    if selector == "auto":
        return "warp" if states <= 32 and n <= 10000 else "first"
    if selector not in ("warp", "first", "longest"):
        raise ImputationError(f"no selector {selector!r}")
    return selector


def select_states(order: DataFrame, states: int, n: int, selector: str = "auto") -> DataFrame:
    """marker_idx, state, hap0, hap1 by the rule for these sizes, or the one named; "longest" takes an order with documented divergence."""
    rules: dict[str, Callable] = {"warp": select_warp, "first": select_first, "longest": select_longest}
    return rules[selector_for(states, n, selector)](order, states, n)
