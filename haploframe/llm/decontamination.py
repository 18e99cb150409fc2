"""Benchmark decontamination: SimHash over item-sized windows, a multi-index on Hamming blocks, exact verification.

For an item of W words, every W-word window of a document that holds enough of the item's word shingles to be able to
reach the threshold gets a 64-bit SimHash in which each shingle votes by its weight, the number of times it occurs.
The fingerprint is cut into ``BLOCKS`` blocks: two fingerprints within the radius differ in at most ``RADIUS // BLOCKS``
bits of one of them. Each item stands in the index of a block under all values that near to its own, so a join on
(W, block number, block value) finds all pairs within the radius. These are verified by the
weighted Jaccard similarity of their shingles, sum of minima over sum of maxima. At a similarity of 0.8 two
fingerprints differ in 9.7 bits on average, in more than 19 in less than one of 1,000 cases.

The bound that admits windows is exact: similarity t needs t times the item's shingles inside the window. It is taken
in two steps, first per document and item by counting shingles, then per window.

Words are compared in lower case. An item of fewer than five words has no shingle and is never found; a document
shorter than an item is one window. Null and empty texts hold nothing. Rows that share a doc_id are judged by their
own text and reported under that id once; items with equal texts are each reported; a null doc_id or item_id is kept.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, keep, words_of

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 19
BLOCKS = 5
CUTS = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
#: What is added to a block's value, bit by bit, to reach the values within its share of the radius.
FLIPS = [sum(1 << i for i in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(64 // BLOCKS + 1), r)]
#: Item shingles up to this number are broadcast (16 bytes each), more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shingles(words: Column) -> Column:
    n = F.size(words) - SHINGLE + 1
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(SHINGLE)))))


def simhash(hashes: Column) -> Column:
    bit = lambda x, b: F.call_function("shiftrightunsigned", x, b).bitwiseAND(1)
    ones = lambda b: F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, x: a + bit(x, b))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(2 * ones(b) > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def blocks(fingerprint: Column) -> Column:
    """(number, width, value) of each block; widths differ by one bit at most."""
    return F.array(*(F.struct(F.lit(i).alias("b"), F.lit(y - x).alias("bits"), F.shiftrightunsigned(fingerprint, x).bitwiseAND((1 << (y - x)) - 1).alias("v")) for i, (x, y) in enumerate(zip(CUTS, CUTS[1:]))))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two shingle lists."""
    count = lambda xs, h: F.size(F.filter(xs, lambda x: x == h))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, h: n + F.least(count(a, h), count(b, h)))
    return common / (F.size(a) + F.size(b) - common).cast("double")


def item_table(benchmark: DataFrame) -> DataFrame:
    """item_id, width (words), item_hashes and item_print of the items that have shingles."""
    w = benchmark.select("item_id", words_of(F.lower("text")).alias("words")).filter(F.size("words") >= SHINGLE)
    return w.select("item_id", F.size("words").alias("width"), shingles(F.col("words")).alias("item_hashes")).withColumn("item_print", simhash(F.col("item_hashes")))


def text_key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").filter(F.col("text").isNotNull()).withColumn("uid", F.xxhash64("text"))


def suspects(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """doc_id, uid, item_id, width, need and hits, the positions of the item's shingles, of pairs that have enough of them."""
    seeds = items.select("item_id", "width", F.explode(F.array_distinct("item_hashes")).alias("h"))
    if seeds.count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    d = text_key(docs).withColumn("words", words_of(F.lower("text"))).filter(F.size("words") >= SHINGLE)
    d = d.withColumn("hashes", shingles(F.col("words"))).select("doc_id", "uid", F.posexplode_outer("hashes").alias("pos", "at"))  # not outer, the optimizer would put the array's size, and with it all of its making, into a filter
    need = F.ceil(F.lit(threshold) * (F.col("width") - SHINGLE + 1) - 1e-9).cast("int").alias("need")
    hits = d.join(seeds, F.col("at") == F.col("h")).groupBy("doc_id", "uid", "item_id", "width").agg(F.collect_set("pos").alias("hits"))
    return hits.select("doc_id", "uid", "item_id", "width", need, F.sort_array("hits").alias("hits")).filter(F.size("hits") >= F.col("need"))


def windows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, uid, width, start, hashes and print of the windows that hold enough shingles of some item of their width."""
    span = F.col("width") - SHINGLE + 1
    starts = F.sequence(F.greatest(F.element_at("hits", 1) - span + 1, F.lit(0)), F.element_at("hits", -1))
    # A window holds need hits just if the need-th hit from its first one lies within it.
    w = found.select("doc_id", "uid", "width", "need", "hits", F.explode(starts).alias("start"))
    w = w.withColumn("inside", F.size(F.filter("hits", lambda p: (p >= F.col("start")) & (p < F.col("start") + span)))).filter("inside >= need")
    w = w.groupBy(F.col("doc_id").alias("_id"), F.col("uid").alias("_uid")).agg(F.collect_set(F.struct("width", "start")).alias("at"))
    d = text_key(docs).join(w, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("uid") == F.col("_uid"))).select("doc_id", "uid", "at", words_of(F.lower("text")).alias("words"))
    d = d.withColumn("all", shingles(F.col("words"))).drop("words")
    # A window that would run over the end begins earlier, so that it has the item's width if the text allows.
    fit = lambda x: F.struct(x["width"].alias("width"), F.greatest(F.lit(0), F.least(x["start"], F.size("all") - x["width"] + SHINGLE - 1)).alias("start"))
    cut = lambda x: F.struct(x["width"].alias("width"), x["start"].alias("start"), F.slice("all", x["start"] + 1, x["width"] - SHINGLE + 1).alias("hashes"))
    d = d.select("doc_id", "uid", F.explode(F.transform(F.array_distinct(F.transform("at", fit)), cut)).alias("w")).select("doc_id", "uid", "w.*")
    # Texts that share an id and a hash are one; the many windows of few texts are spread before they are hashed.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(parts, "doc_id", "uid", "width", "start").dropDuplicates(["doc_id", "uid", "width", "start"]).withColumn("print", simhash(F.col("hashes")))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity, start and n_windows: one row for each document and item that it holds."""
    items = keep(item_table(benchmark), "items")
    found = keep(suspects(docs, items, threshold), "suspects")
    w = keep(windows(docs, found), "prints").withColumn("block", F.explode(blocks(F.col("print"))))
    i = items.select("item_id", "width", "item_print", F.xxhash64("item_hashes").alias("item_no"), F.explode(blocks(F.col("item_print"))).alias("block")).withColumn("flip", F.explode(F.lit(FLIPS)))
    i = i.filter(F.col("flip") < F.call_function("shiftleft", F.lit(1), F.col("block.bits")))
    i = i.withColumn("block", F.struct(F.col("block.b").alias("b"), F.col("block.bits").alias("bits"), F.col("block.v").bitwiseXOR(F.col("flip")).alias("v"))).drop("flip")
    # Written, the index has a size that the join goes by; the items' shingles are joined to what it finds.
    i = keep(i, "item-index")
    shingled = items.select(F.xxhash64("item_hashes").alias("item_no"), "item_hashes").dropDuplicates(["item_no"])
    near = w.join(i, ["width", "block"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    # Of the blocks that find a pair, the first counts.
    close = F.filter(F.zip_with(blocks(F.col("print")), blocks(F.col("item_print")), lambda a, b: F.when(F.bit_count(a["v"].bitwiseXOR(b["v"])) <= RADIUS // BLOCKS, a["b"])), lambda x: x.isNotNull())
    near = near.filter(F.col("block.b") == F.array_min(close)).join(shingled, "item_no").withColumn("similarity", similarity(F.col("hashes"), F.col("item_hashes"))).filter(F.col("similarity") >= threshold)
    best = F.max_by("start", F.struct("similarity", -F.col("start")))
    return near.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), best.alias("start_word"), F.countDistinct("uid", "start").alias("n_windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text holds no item."""
    bad = leaks(docs.withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("of"))), benchmark, threshold).select("doc_id.*").distinct().toDF("__hf_id", "__hf_of")
    same = F.col("doc_id").eqNullSafe(F.col("__hf_id")) & (F.xxhash64("text") == F.col("__hf_of"))
    return docs.join(bad, same, "left_anti")


def op2_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: All windows by their exact similarity, without fingerprints.
ORACLE = f"""
with t as (select 'd' as kind, doc_id as id, lower(coalesce(text, '')) as text from documents union all select 'i', item_id, lower(coalesce(text, '')) from benchmark),
w as (select kind, id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from t),
s as (select kind, id, j - 1 as pos, len(w) - {SHINGLE - 1} as n, array_to_string(w[j:j + {SHINGLE - 1}], ' ') as h from (select *, unnest(range(1, len(w) - {SHINGLE - 2})) as j from w where len(w) >= {SHINGLE})),
i as (select id as item_id, h, n as span, count(*) as c from s where kind = 'i' group by all),
d as (select * from s where kind = 'd'),
hit as (select d.id as doc_id, item_id, pos, d.n, span, d.h, c from d join i using (h)),
cand as (select doc_id, item_id, any_value(n) as n, any_value(span) as span from hit group by doc_id, item_id having count(*) >= {THRESHOLD} * any_value(span) - 1e-9),
st as (select *, unnest(range(0, greatest(n - span, 0) + 1)) as start from cand),
m as (select st.doc_id, st.item_id, st.start, st.n, st.span, hit.h, least(count(*), any_value(c)) as c from st join hit on hit.doc_id = st.doc_id and hit.item_id = st.item_id and pos >= start and pos < start + st.span group by all),
v as (select doc_id, item_id, start, sum(c) / (any_value(least(n, span)) + any_value(span) - sum(c))::double as similarity from m group by doc_id, item_id, start)
select doc_id, item_id, max(similarity) as similarity, min_by(start, (-similarity, start))::int as start_word, count(*)::bigint as n_windows from v where similarity >= {THRESHOLD} group by doc_id, item_id
"""
