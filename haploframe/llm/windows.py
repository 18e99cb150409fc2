"""Bringing equal windows of a corpus together: anchors, candidate stretches and removal of stretches from texts.

The anchor of a window is the k-gram with the smallest hash in it (the leftmost of equal ones), so equal windows have
equal anchors at equal offsets. Successive windows with one anchor form a stretch. Anchors that occur once can't be
in a repeated window; their stretches leave by a semi-join on the anchor's hash, after counts that are summed before
the shuffle. What stays is cut out of its text and sent to the shard of its anchor. The stretches of an anchor with
more than ``HOT_ROWS`` of them are first merged by content, with partial sums before the shuffle: only distinct ones
meet in the shard, and what they are told reaches their copies by a join on (anchor, content) that can be split. Where
more than ``HOT_ROWS`` distinct ones are left, their windows are halved by how far they reach left of the anchor: one
half holds so many items before the anchor, the other so many behind it, and these items lengthen the anchor. Equal
windows stay together, and halving goes on until every group is small; at the end a group is one window's content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .tokens import BASE, BASE_INVERSE, content_keys, gram_hashes, mix, powers, text_chunks, word_bounds, word_hashes

#: Bits for the place of a k-gram beside its hash when smallest ones are sought.
PLACE_BITS = 28
HOT_ROWS = 100_000
NO_MINIMUM = np.uint64((1 << 64) - 1)


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k bytes in a row."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    return mix((sums[k:] - sums[:n]) * powers(BASE_INVERSE, n))


def stretches(grams: np.ndarray, bounds: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, windows, anchor's offset, anchor's hash) of each stretch; begin counts items over all texts. bounds: the first item of each text, and the end."""
    none = np.zeros(0, np.int64)
    m, count = width - k + 1, len(grams) + k - width
    long = bounds[1:] - bounds[:-1] >= width
    if count <= 0 or not long.any():
        return none, none, none, np.zeros(0, np.uint64)
    if len(grams) >> PLACE_BITS:
        raise ValueError("a single text is too long for one window search")
    low = np.uint64((1 << PLACE_BITS) - 1)
    packed = np.full(-(-len(grams) // m) * m, NO_MINIMUM)
    packed[: len(grams)] = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    rows = packed.reshape(-1, m)
    smallest = np.minimum(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[:count], np.minimum.accumulate(rows, axis=1).ravel()[m - 1 : m - 1 + count])
    place = (smallest & low).astype(np.int64)
    steps = np.zeros(count + 1, np.int64)
    np.add.at(steps, bounds[:-1][long], 1)
    np.add.at(steps, bounds[1:][long] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(steps[:count]))
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (place[at[1:]] != place[at[:-1]])
    first = np.flatnonzero(new)
    begin = at[first]
    windows = np.diff(np.append(first, len(at)))
    return begin, windows, place[begin] - begin, grams[place[begin]]


def items_of(kind: str, data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-gram hashes over a run of texts, and the first item of each text; items are bytes or words."""
    if kind == "bytes":
        return byte_grams(data, k), offsets
    b, e, first = word_bounds(data, offsets)
    return gram_hashes(word_hashes(data, b, e), k), first


def anchor_rows(kind: str, width: int, k: int) -> Callable:
    """(doc_id, part, text) batches to (a, doc_id, part, at) rows; at packs the begin in its text, the anchor's offset and the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, text = batch.columns
            for row, end, data, offsets in text_chunks(text):
                grams, bounds = items_of(kind, data, offsets, k)
                begin, windows, offset, anchor = stretches(grams, bounds, width, k)
                of = np.searchsorted(bounds, begin, "right") - 1
                at = (begin - bounds[of]) << 32 | offset << 16 | windows
                take = pa.array(of + row)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), ids.take(take), parts.take(take), pa.array(at)], ["a", "doc_id", "part", "at"])

    return run


def anchors_only(kind: str, width: int, k: int) -> Callable:
    """(text) batches to (a, n): how often each anchor heads a stretch, summed over a run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                grams, bounds = items_of(kind, data, offsets, k)
                a, n = np.unique(stretches(grams, bounds, width, k)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], ["a", "n"])

    return run


def cut_out(kind: str, width: int, keyed: bool = False) -> Callable:
    """(doc_id, part, text, found) batches to the stretches' contents, and hashes s of these if keyed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, text, found = batch.columns
            flat, lists = found.flatten(), found.offsets.to_numpy().astype(np.int64)
            lists = lists - lists[0]
            anchor, at = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            for row, end, data, offsets in text_chunks(text):
                lo, hi = lists[row], lists[end]
                of = np.repeat(np.arange(end - row), np.diff(lists[row : end + 1]))
                begin, last = at[lo:hi] >> 32, (at[lo:hi] >> 32) + (at[lo:hi] & 0xFFFF) - 2 + width
                if kind == "bytes":
                    b, e = offsets[of] + begin, offsets[of] + last + 1
                else:
                    starts, ends, first = word_bounds(data, offsets)
                    b, e = starts[first[of] + begin], ends[first[of] + last]
                size, whole = e - b, data.tobytes()
                # A batch of contents is kept to some MB.
                cuts = np.searchsorted(np.cumsum(size), np.arange(1, int(size.sum() >> 22) + 1) << 22)
                for x, y in zip(np.append(0, cuts), np.append(cuts, len(b))):
                    if x < y:
                        take = pa.array(of[x:y] + row)
                        content = [whole[i:j] for i, j in zip(b[x:y], e[x:y])]
                        cols = [pa.array(anchor[lo:hi][x:y]), ids.take(take), parts.take(take), pa.array(at[lo:hi][x:y]), pa.array(content, pa.binary())]
                        if keyed:
                            cols.append(pa.array(content_keys(content).view(np.int64)))
                        yield pa.RecordBatch.from_arrays(cols, ["a", "doc_id", "part", "at", "content", "s"][: len(cols)])

    return run


def halves(kind: str, width: int, k: int) -> Callable:
    """(a, doc_id, part, at, content, l, r) batches to the two halves of each stretch's windows under longer anchors, and hashes s of their contents. All windows hold l items before the anchor's k-gram and r behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for i, (a, at, content, l, r) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 3, 4, 5, 6)))):
                items, joined = (content, bytes) if kind == "bytes" else (content.split(), b" ".join)
                begin, offset, windows = at >> 32, at >> 16 & 0xFFFF, at & 0xFFFF
                # Window j holds offset - j items before the k-gram, from l to width - k - r; in the first half middle or more.
                middle = l + (width - k - l - r + 1) // 2
                cut = min(max(offset - middle + 1, 0), windows)
                for side, lo, hi, left, right in ((0, 0, cut, middle, r), (1, cut, windows, l, width - k - middle + 1)):
                    if lo < hi:
                        of.append(i)
                        longer = b"%d %d " % (a, side) + joined(items[offset - left : offset + k + right])
                        out.append((longer, (begin + lo) << 32 | (offset - lo) << 16 | (hi - lo), joined(items[lo : hi - 1 + width]), left, right))
            if out:
                longer, at, content, l, r = map(list, zip(*out))
                take = pa.array(of)
                a, s = (pa.array(content_keys(x).view(np.int64)) for x in (longer, content))
                yield pa.RecordBatch.from_arrays([a, batch.column(1).take(take), batch.column(2).take(take), pa.array(at), pa.array(content, pa.binary()), s, pa.array(l, pa.int32()), pa.array(r, pa.int32())], ["a", "doc_id", "part", "at", "content", "s", "l", "r"])

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, part, text: rows that share a doc_id are told apart by part, in the order of their texts."""
    d = docs.select("doc_id", "text")
    if d.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return d.select("doc_id", F.lit(0).alias("part"), "text")
    return d.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())) - 1).alias("part"), "text")


def repeated_anchors(docs: DataFrame, kind: str, width: int, k: int) -> DataFrame:
    """a, n of the anchors that head more than one stretch."""
    return keep(docs.select("text").mapInArrow(anchors_only(kind, width, k), "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).filter("n > 1"), "anchors")


def candidates(docs: DataFrame, anchors: DataFrame, kind: str, width: int, k: int, keyed: bool = False) -> DataFrame:
    """a, doc_id, part, at, content (and s) of the stretches with these anchors. docs: doc_id, part, text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(anchor_rows(kind, width, k), f"a long, doc_id {id_type}, part int, at long").join(anchors.select("a"), "a", "left_semi")
    found = rows.groupBy("doc_id", "part").agg(F.collect_list(F.struct("a", "at")).alias("found"))
    text = docs.select("doc_id", "part", "text")
    same = text["doc_id"].eqNullSafe(found["doc_id"]) & (text["part"] == found["part"])
    return text.join(found, same).select(text["doc_id"], text["part"], "text", "found").mapInArrow(cut_out(kind, width, keyed), f"a long, doc_id {id_type}, part int, at long, content binary" + ", s long" * keyed)


def by_anchor(solve: Callable, width: int, least: int) -> Callable:
    """Batches sorted by anchor to (doc_id, part, begin, end) of the items to remove. solve gets whole groups, least rows or more at once: a group number for each row, begins, offsets, windows, contents, and (doc_id, part) order numbers; it returns a list of window flags for each row."""

    def settle(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        at = t["at"].to_numpy()
        begin, offset, windows = at >> 32, at >> 16 & 0xFFFF, at & 0xFFFF
        group = np.unique(t["a"].to_numpy(), return_inverse=True)[1]
        flags = solve(group, begin, offset, windows, t["content"].to_pylist(), t.select(["doc_id", "part"]))
        # Runs of flagged windows, over all rows laid end to end with a gap between them.
        first = np.concatenate(([0], np.cumsum(windows + 1)))
        line = np.zeros(first[-1] + 1, np.int8)
        line[np.arange(len(flags)) + np.repeat(np.arange(len(windows)), windows)] = flags
        step = np.diff(np.concatenate(([0], line)))
        up, down = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        row = np.searchsorted(first, up, "right") - 1
        take = pa.array(row)
        start = begin[row] + up - first[row]
        return pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks().take(take), t["part"].combine_chunks().take(take), pa.array(start), pa.array(start + down - up - 1 + width)], ["doc_id", "part", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            a = batch.column(0).to_numpy()
            if not len(a):
                continue
            # The last group may go on in the next batch.
            cut = int(np.searchsorted(a, a[-1])) if (a[1:] >= a[:-1]).all() else 0
            if cut and sum(map(len, held)) + cut >= least:
                yield settle([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield settle(held)

    return run


def repeated(docs: DataFrame, kind: str, width: int, k: int, solve: Callable, least: int, earlier: bool) -> DataFrame:
    """doc_id, part and cuts, the list of (begin, end) items to remove. earlier: a window goes if it also starts earlier, else if it also is anywhere else."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def settled(c: DataFrame) -> DataFrame:
        return c.select("a", "doc_id", "part", "at", "content").repartition(parts, "a").sortWithinPartitions("a").mapInArrow(by_anchor(solve, width, least), f"doc_id {id_type}, part int, begin long, end long")

    anchors = repeated_anchors(docs, kind, width, k)
    hot = anchors.filter(F.col("n") > HOT_ROWS)
    if hot.isEmpty():
        runs = settled(candidates(docs, anchors, kind, width, k))
    else:
        runs = settled(candidates(docs, anchors.filter(F.col("n") <= HOT_ROWS), kind, width, k))
        c = candidates(docs, hot, kind, width, k, keyed=True).withColumns({"l": F.lit(0), "r": F.lit(0)})
        place, begin = F.struct("doc_id", "part", "at"), F.shiftright("at", 32)
        while True:
            first = keep(c.groupBy("a", "s").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.any_value("content").alias("content"), F.any_value("l").alias("l"), F.any_value("r").alias("r")), "hot-stretches")
            # All windows of a later copy start earlier; all windows of a stretch that has copies are elsewhere.
            whole = place != F.col("first") if earlier else F.col("copies") > 1
            copies = c.select("a", "s", "doc_id", "part", "at").join(first.filter("copies > 1").select("a", "s", "first", "copies"), ["a", "s"]).filter(whole)
            runs = runs.union(copies.select("doc_id", "part", begin.alias("begin"), (begin + F.col("at").bitwiseAND(0xFFFF) - 1 + width).alias("end")))
            large = keep(first.groupBy("a").count().filter(F.col("count") > HOT_ROWS).select("a"), "large-groups")
            if large.isEmpty():
                runs = runs.union(settled(first.select("a", "first.*", "content")))
                break
            runs = runs.union(settled(first.join(F.broadcast(large), "a", "left_anti").select("a", "first.*", "content")))
            rows = first.join(F.broadcast(large), "a", "left_semi").select("a", "first.*", "content", "l", "r")
            c = keep(rows.mapInArrow(halves(kind, width, k), f"a long, doc_id {id_type}, part int, at long, content binary, s long, l int, r int"), "halves")
    return runs.groupBy("doc_id", "part").agg(F.collect_list(F.struct("begin", "end")).alias("cuts"))


def with_cuts(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    text = docs.select("doc_id", "part", "text")
    return text.join(cuts, text["doc_id"].eqNullSafe(cuts["doc_id"]) & (text["part"] == cuts["part"]), "left").select(text["doc_id"], text["part"], "text", "cuts")


def merged(cuts: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of a list of (begin, end)."""
    out: list[list[int]] = []
    for c in sorted((c["begin"], c["end"]) for c in cuts or ()):
        if out and c[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], c[1])
        else:
            out.append([*c])
    return [tuple(x) for x in out]
