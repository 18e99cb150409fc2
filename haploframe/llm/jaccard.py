"""N-gram Jaccard join: a count-vector R-tree behind an exact prefix filter, links and their components.

Texts with equal shingle sets form one class. Two sets at similarity t differ in at most n (1 - t) / t shingles, n being
the smaller size. So the hashes are cut into more ranges than that, and what a set holds in one range is a bundle: of the
bundles of each set all but as many as there are differences are in the other set too. Bundles have one global order,
rarest first by the rarest shingle in them (by the counts of 65,536 hash buckets over all texts), then by hash; by the
prefix filter the two sets share one of the leading bundles of each, one more than differences. A single shingle is
shared by more unrelated texts the larger the corpus is, a bundle of several is not. The number of ranges depends on the
smaller set's size, so a set enters under its own sizes and, near their begin, under the sizes below. A set with too few
bundles enters with all, empty ones included. Classes meet in the groups of these bundles. A class is a point: its shingles are hashed
into ``DIMS`` groups and the counts are its coordinates. In each group an R-tree over the points finds pairs whose sum
of coordinate minima, an upper bound of the overlap, can reach the threshold. Each class proposes its best
``proposals`` partners of other components; they are verified on whole texts, components are joined, and the next
round looks only at groups that still hold several components, with more proposals and without pairs that failed, until
no pair is left. So every link between different components is found or excluded, while pairs inside a component
need no test.

The first round takes three leading bundles only. Large groups are split: in the first round into blocks, later into
parts by size and by pairs of blocks in which all pairs meet that can be linked. A document without words is linked with
nothing; null text is such a document; fewer words than a shingle are one shingle. A ``Rule`` gives the words of a
shingle and the least similarity: ``CONTRACT`` (three words, 9/10) for op3, ``STAGE`` (five words, 0.8) for stages of a
corpus. Rows that repeat a doc_id are nodes of
their own by text; component ids are the smallest doc_id, null only where no row of the component has one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, keep
from .components import stars
from .tokens import BASE, LOWER, mix, text_chunks, word_bounds, word_hashes


class Rule(NamedTuple):
    """Words of a shingle; denominator * overlap >= numerator * union."""

    shingle: int
    numerator: int
    denominator: int


CONTRACT, STAGE = Rule(3, 9, 10), Rule(5, 4, 5)
DIMS = 128
BUCKETS = 1 << 16
#: Begins of ranges of sizes, each half as large again as the one before.
SIZES = [1]
while SIZES[-1] < 1 << 31:
    SIZES.append(max(SIZES[-1] + 1, SIZES[-1] * 3 // 2))
SIZES = np.array(SIZES)
FIRST_TOKENS, FIRST_PROPOSALS, BLOCK_ROWS = 3, 2, 4096
LEAF = 32
#: Groups up to this size are compared pair by pair, larger ones through a tree.
SMALL_GROUP = 32
#: Pairs compared at once.
PAIRS = 1 << 14
#: Rows up to this number (24 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def chunk_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = CONTRACT.shingle) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = LOWER[data]
    b, e, first = word_bounds(data, offsets)
    h = word_hashes(data, b, e)
    grams = np.zeros(max(0, len(h) - shingle + 1), np.uint64)
    for j in range(shingle):
        grams = grams * BASE + h[j : j + len(grams)]
    grams = mix(grams)
    for x, y in zip(first[:-1], first[1:]):
        if y - x >= shingle:
            yield np.unique(grams[x : y - shingle + 1])
        elif y > x:
            one = np.array([y - x], np.uint64)
            for w in h[x:y]:
                one = one * BASE + w
            yield mix(one ^ np.uint64(1))
        else:
            yield np.zeros(0, np.uint64)


def bucket_counts(rule: Rule = CONTRACT) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                for s in chunk_sets(data, offsets, rule.shingle):
                    np.add.at(total, (s & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], ["bucket", "n"])

    return run


def differences(n: int, rule: Rule = CONTRACT) -> int:
    """Most shingles that are in one only of a set of n and a linked one of no fewer."""
    return n * (rule.denominator - rule.numerator) // rule.numerator


@cache
def ranges(c: int, rule: Rule) -> tuple[int, np.ndarray, np.ndarray]:
    """For pairs whose smaller set has SIZES[c] shingles or more, but less than SIZES[c + 1]: most differences, inner bounds of the hash ranges, a number for each range."""
    most = differences(int(SIZES[c + 1]) - 1, rule)
    k = (most + 1) * 4 // 3 + 1
    return most, np.arange(1, k, dtype=np.uint64) * np.uint64((1 << 64) // k), mix(np.arange(k, dtype=np.uint64) + np.uint64(c << 40))


def leading(s: np.ndarray, mixed: np.ndarray, counts: np.ndarray, rule: Rule = CONTRACT) -> np.ndarray:
    """Names of the leading bundles of a set. s: its sorted hashes; mixed: the same, scrambled; counts: how frequent each is."""
    n, out = len(s), [np.zeros(0, np.uint64)]
    own = differences(n, rule)
    c = int(np.searchsorted(SIZES, n, "right")) - 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    # Without differences only equal sets are linked, and these are one class.
    while c >= 0 and own and (int(SIZES[c + 1]) - 1) * rule.denominator >= rule.numerator * n:
        most, inner, names = ranges(c, rule)
        at = np.concatenate(([0], np.searchsorted(s, inner), [n]))
        t = mix((sums[at[1:]] - sums[at[:-1]]) ^ names)
        full, need = np.flatnonzero(at[1:] > at[:-1]), min(own, most) + 1
        if len(full) >= need:
            t = t[full]
            t = t[np.lexsort((t, np.minimum.reduceat(counts, at[:-1][full])))[:need]]
        if most:
            out.append(t)
        c -= 1
    return np.concatenate(out)


def points(order, rule: Rule = CONTRACT) -> Callable:
    """(doc_id, uid, text) batches to the class, size, point and leading bundles of each row. order: a broadcast of bucket counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for batch in batches:
            ids, uids, text = batch.columns
            for row, end, data, offsets in text_chunks(text):
                cid, size, vec, lead = [], [], [], []
                for s in chunk_sets(data, offsets, rule.shingle):
                    n = len(s)
                    size.append(n)
                    if not n:
                        cid.append(0), vec.append(b""), lead.append(np.zeros(0, np.int64))
                        continue
                    m = mix(s)
                    cid.append(int(mix(np.sum(m, keepdims=True) * BASE + np.bitwise_xor.reduce(mix(m), keepdims=True) + np.uint64(n)).view(np.int64)[0]))
                    at = np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=DIMS)
                    vec.append(at.astype(np.uint8 if at.max() < 256 else np.int32).tobytes())
                    lead.append(leading(s, m, counts[(s & np.uint64(BUCKETS - 1)).astype(np.int64)], rule).view(np.int64))
                leads = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in lead]))), pa.int32()), pa.array(np.concatenate(lead)))
                yield pa.RecordBatch.from_arrays([ids.slice(row, end - row), uids.slice(row, end - row), pa.array(cid, pa.int64()), pa.array(size, pa.int32()), pa.array(vec, pa.binary()), leads], ["doc_id", "uid", "cid", "n", "vec", "lead"])

    return run


class CountTree:
    """An R-tree over count vectors that are sorted by their sums: leaves of LEAF points, nodes of LEAF leaves, each with its upper corner."""

    def __init__(self, vec: np.ndarray, n: np.ndarray, rule: Rule = CONTRACT):
        self.vec, self.n, self.rule = vec, n, rule
        at = np.arange(0, len(n), LEAF)
        self.leaf_top, self.leaf_n = np.maximum.reduceat(vec, at, axis=0), n[at]
        up = np.arange(0, len(at), LEAF)
        self.node_top, self.node_n = np.maximum.reduceat(self.leaf_top, up, axis=0), self.leaf_n[up]

    def search(self, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Points whose size and bound allow the threshold with a set of n shingles, and their bounds."""
        _, num, den = self.rule
        # The least size in a box stands for the size of its points.
        able = lambda top, least: (num + den) * np.minimum(q, top).sum(1) >= num * (n + np.maximum(least, -(-num * n // den)))
        nodes = np.flatnonzero(able(self.node_top, self.node_n))
        leaves = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaves = leaves[leaves < len(self.leaf_n)]
        leaves = leaves[able(self.leaf_top[leaves], self.leaf_n[leaves])]
        at = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.n)]
        at = at[(den * self.n[at] >= num * n) & (num * self.n[at] <= den * n)]
        bound = np.minimum(q, self.vec[at]).sum(1)
        fits = (num + den) * bound >= num * (n + self.n[at])
        return at[fits], bound[fits]


def group_pairs(proposals: int, rule: Rule = CONTRACT) -> Callable:
    """(t, cid, comp, n, vec) batches sorted by t to proposed pairs (x, y); more is 1 where a class had further partners."""
    _, num, den = rule

    def settle(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        t, cid, comp, n = (table[c].to_numpy() for c in ("t", "cid", "comp", "n"))
        # Points whose coordinates are under 256 come as bytes, others as 32-bit numbers.
        raw = table["vec"].to_pylist()
        short = np.array([len(v) == DIMS for v in raw])
        vec = np.empty((len(raw), DIMS), np.int32)
        vec[short] = np.frombuffer(b"".join(v for v in raw if len(v) == DIMS), np.uint8).reshape(-1, DIMS)
        vec[~short] = np.frombuffer(b"".join(v for v in raw if len(v) != DIMS), np.int32).reshape(-1, DIMS)
        by = np.lexsort((cid, n, t))
        t, cid, comp, n, vec = t[by], cid[by], comp[by], n[by].astype(np.int64), vec[by]
        begin = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        size = np.diff(np.append(begin, len(t)))
        xs, ys, more = [], [], []
        for m in range(2, SMALL_GROUP + 1):
            lower, upper = np.triu_indices(m, 1)
            heads = begin[size == m]
            for at in range(0, len(heads), max(1, PAIRS // len(lower))):
                some = heads[at : at + max(1, PAIRS // len(lower))]
                y, x = (some[:, None] + lower).ravel(), (some[:, None] + upper).ravel()
                fits = (comp[x] != comp[y]) & (den * n[y] >= num * n[x])
                x, y = x[fits], y[fits]
                bound = np.minimum(vec[x], vec[y]).sum(1)
                fits = (num + den) * bound >= num * (n[x] + n[y])
                x, y, bound = x[fits], y[fits], bound[fits]
                # The best partners of each x.
                by = np.lexsort((-(bound - (n[x] + n[y]) * num / (num + den)), x))
                x, y = x[by], y[by]
                nth = np.arange(len(x)) - np.searchsorted(x, x)
                best = nth < proposals
                xs.append(cid[x[best]]), ys.append(cid[y[best]]), more.append((np.searchsorted(x, x, "right") - np.searchsorted(x, x) > proposals)[best].astype(np.int32))
        for b, m in zip(begin[size > SMALL_GROUP], size[size > SMALL_GROUP]):
            c, d, k = cid[b : b + m], comp[b : b + m], n[b : b + m]
            # Pairs inside the largest component need no test, so its members don't ask.
            names, of, count = np.unique(d, return_inverse=True, return_counts=True)
            asking = np.flatnonzero(of != count.argmax()) if count.max() > 1 else np.arange(1, m)
            tree = CountTree(vec[b : b + m], k, rule) if len(asking) else None
            for i in asking:
                at, bound = tree.search(vec[b + i], int(k[i]))
                other = d[at] != d[i]
                at, bound = at[other], bound[other]
                if len(at):
                    best = at[np.argsort(-(bound - (k[i] + k[at]) * num / (num + den)), kind="stable")[:proposals]]
                    xs.append(np.full(len(best), c[i])), ys.append(c[best]), more.append(np.full(len(best), len(at) > proposals, np.int32))
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (xs, ys, more)]
        x, y = np.maximum(cols[0], cols[1]), np.minimum(cols[0], cols[1])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(cols[2], pa.int32())], ["x", "y", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            # The partition is sorted by t, so the last group alone may go on.
            t = batch.column(0).to_numpy()
            cut = int(np.searchsorted(t, t[-1]))
            if cut:
                yield settle([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield settle(held)

    return run


def verify(rule: Rule = CONTRACT) -> Callable:
    """(x, y, text_x, text_y) batches to (x, y, linked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[s for _, _, data, offsets in text_chunks(batch.column(i)) for s in chunk_sets(data, offsets, rule.shingle)] for i in (2, 3)]
            linked = []
            for a, b in zip(*sets):
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(rule.denominator * both >= rule.numerator * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["x", "y", "linked"])

    return run


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """x, y, linked of pairs of classes, by the whole texts of their smallest rows."""
    inside = keep(pairs.select(F.col("x").alias("cid")).union(pairs.select("y")).distinct().join(classes.select("cid", "low"), "cid").select("cid", "low.*").toDF("cid", "low_id", "low_uid"), "paired")
    if inside.count() <= BROADCAST_ROWS:
        inside = F.broadcast(inside)
    same = F.col("doc_id").eqNullSafe(F.col("low_id")) & (F.col("uid") == F.col("low_uid"))
    texts = keep(docs.join(inside, same).select("cid", "text"), "paired-texts")
    return pairs.join(texts.toDF("x", "text_x"), "x").join(texts.toDF("y", "text_y"), "y").select("x", "y", "text_x", "text_y").mapInArrow(verify(rule), "x long, y long, linked boolean")


def parted(group: DataFrame, first: bool, rule: Rule) -> DataFrame:
    """Gives the parts of groups of more than BLOCK_ROWS classes names of their own.

    In the first round a part is a block of classes. Later all pairs must meet: sets that can be linked have sizes
    within the threshold, so they lie in one of two neighbouring ranges of sizes, and each class enters the part of its
    range and of the next; inside a range each two blocks of classes form a part.
    """
    large, blocks = F.col("classes") > BLOCK_ROWS, F.ceil(F.col("classes") / BLOCK_ROWS).cast("long")
    own = F.pmod("cid", blocks)
    if first:
        return group.withColumn("t", F.when(large, F.xxhash64("t", own)).otherwise(F.col("t")))
    size = F.floor(F.log("n") / float(np.log(rule.denominator / rule.numerator))).cast("long")
    others = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    names = F.flatten(F.transform(F.array(size, size + 1), lambda k: F.transform(others, lambda p: F.xxhash64(F.col("t"), k, p["i"], p["j"]))))
    return group.withColumn("t", F.explode(F.when(large, names).otherwise(F.array("t"))))


def rooted_components(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """doc_id, uid (of the text), n_shingles, component_id and root for every row of docs. root names the component also where ids are null or repeated; it is null without words."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.xxhash64("text").alias("uid"), "text")
    id_type = d.schema["doc_id"].dataType.simpleString()
    counts = np.zeros(BUCKETS, np.int64)
    for r in d.select("text").mapInArrow(bucket_counts(rule), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.bucket] = r.n
    order = spark.sparkContext.broadcast(counts)
    rows = keep(d.mapInArrow(points(order, rule), f"doc_id {id_type}, uid long, cid long, n int, vec binary, lead array<long>"), "points")
    classes = keep(rows.filter("n > 0").groupBy("cid").agg(F.min("n").alias("n"), F.any_value("vec").alias("vec"), F.any_value("lead").alias("lead"), F.min(F.struct("doc_id", "uid")).alias("low"), F.min("doc_id").alias("id")), "classes")
    tokens = classes.select("cid", F.posexplode("lead").alias("place", "t"))
    shared = keep(tokens.join(tokens.groupBy("t").agg(F.count("*").alias("classes")).filter("classes > 1"), "t"), "shared-bundles")
    vectors = classes.select("cid", "n", "vec")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    comps, tested, proposals, first = None, None, FIRST_PROPOSALS, True
    while True:
        group = shared.filter(F.col("place") < FIRST_TOKENS) if first else shared
        group = group.select("t", "cid", "classes")
        if comps is None:
            group = group.withColumn("comp", F.col("cid"))
        else:
            group = group.join(comps.toDF("cid", "root"), "cid", "left").select("t", "cid", "classes", F.coalesce("root", "cid").alias("comp"))
            open_ = group.groupBy("t").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("t")
            group = group.join(open_, "t", "left_semi")
        group = parted(group.join(vectors, "cid"), first, rule).select("t", "cid", "comp", "n", "vec").repartition(parts, "t").sortWithinPartitions("t")
        found = group.mapInArrow(group_pairs(proposals, rule), "x long, y long, more int").groupBy("x", "y").agg(F.max("more").alias("more"))
        found = keep(found, "proposed")
        new = found if tested is None else found.join(tested, ["x", "y"], "left_anti")
        done = keep(verified(d, classes, keep(new.select("x", "y"), "new-pairs"), rule), "verified")
        links = done.filter("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
        tested = done.select("x", "y").distinct() if tested is None else tested.union(done.select("x", "y").distinct())
        more = found.agg(F.max("more")).first()[0]
        linked = not links.isEmpty()
        if linked:
            comps = stars(links if comps is None else links.union(comps))
        if not first and not more and not linked:
            break
        proposals, first = proposals * 4, False
    low = classes.select("cid", "id")
    if comps is not None:
        low = low.join(comps.toDF("cid", "root"), "cid", "left").select("cid", F.coalesce("root", "cid").alias("root"), "id")
        ids = low.groupBy("root").agg(F.min("id").alias("component_id"))
        low = low.join(ids, "root").select("cid", "root", "component_id")
    else:
        low = low.select("cid", F.col("cid").alias("root"), F.col("id").alias("component_id"))
    out = rows.select("doc_id", "uid", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(low, "cid", "left")
    return out.select("doc_id", "uid", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def jaccard_components(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """doc_id, uid (of the text), n_shingles and component_id for every row of docs."""
    return rooted_components(docs, rule).drop("root")


def keep_one(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """The rows of docs without those linked to a row of smaller (doc_id, text hash); rows without words stay. Of rows that repeat an id and its text one stays."""
    found = rooted_components(docs, rule).filter("n_shingles > 0").select("doc_id", "uid", "root").distinct()
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "uid")).alias("first"))
    gone = found.join(first, "root").filter(F.struct("doc_id", "uid") > F.col("first")).select(F.col("doc_id").alias("__hf_id"), F.col("uid").alias("__hf_uid"))
    left = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__hf_id")) & (F.xxhash64("text") == F.col("__hf_uid")), "left_anti")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return left
    return left.dropDuplicates(["doc_id", "text"])


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).drop("uid")


ORACLE = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[j:j + {CONTRACT.shingle - 1}], ' ') as shingle from (select doc_id, w, unnest(range(1, greatest(len(w) - {CONTRACT.shingle - 2}, 2))) as j from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where {CONTRACT.denominator} * shared >= {CONTRACT.numerator} * (a.n + b.n - shared)),
e as (select x, y from l union select y, x from l),
r(x, y) as (select x, y from e union select r.x, e.y from r join e on r.y = e.x),
c as (select x, min(y) as y from r group by x)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(y, doc_id)) as component_id from documents left join n using (doc_id) left join c on x = doc_id
"""
