"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

The 64-bit hashes of a text's word shingles are taken once; the high bits choose one of ``BINS`` bins and each bin
keeps its smallest hash. An empty bin takes the value of the filled bin that comes first in its own seeded random
order of bins, so two texts fill it alike if they agree there. ``BITS`` low-order bits of each bin are kept, packed
as hexadecimal digits. The share of equal bins of two fingerprints is corrected for bits that agree by chance.

A shingle is five words; a shorter text is one shingle of all its words; a text without words (null, empty or blank)
has a fingerprint of its own (``EMPTY``) that is like itself and unlike any other. Equal texts have equal
fingerprints. The next document follows by descending doc_id; rows that share a doc_id are ordered by a hash of their
text, and the row after the last is the first. A null doc_id comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, keep, words_of

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 8
EMPTY = "empty"
#: doc_ids in one run of the descending order, as a power of two: rows of a run are sorted together, and one row of each is looked up for the run before it.
RUN_BITS = 12
#: First rows of runs up to this number (24 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Numbers of runs that one task may order.
ORDER_ROWS = 65_536


#: Choices of an empty bin that are looked up one by one before all filled bins are compared.
CHOICES = 6
HEX = [f"{v:02x}" for v in range(256)]


def shingle_hashes(words: Column, k: int = SHINGLE) -> Column:
    """A hash for each run of k words, or one for all words of a shorter text."""
    many = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    return F.when(F.size(words) < k, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(many)


def with_print(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint as a sorted array with one number, bin * 256 + low bits - 32768, for each bin; an empty array without words."""
    top, low = 64 - BIN_BITS, (1 << BITS) - 1
    bin_of = lambda x: (F.shiftright(x, top) + BINS // 2).cast("int")
    df = df.withColumn("_words", words_of(F.col(text))).withColumn("_none", F.size("_words") == 0)
    df = df.withColumn("_hashes", F.sort_array(shingle_hashes(F.col("_words")))).drop("_words")
    # In sorted order the first hash of each bin is its smallest.
    first = F.filter("_hashes", lambda x, i: (i == 0) | (F.shiftright(x, top) != F.shiftright(F.get("_hashes", i - 1), top)))
    df = df.withColumn("_filled", first).drop("_hashes")
    df = df.withColumns({"_bins": F.transform("_filled", bin_of), "_low": F.transform("_filled", lambda x: x.bitwiseAND(low).cast("int"))}).drop("_filled")
    # The turn of bin c for an empty bin b is (c - o) * i modulo BINS, o and an odd i drawn from b; so its n-th choice is o + n / i.
    drawn = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(BINS - 1)), "_bins"), lambda b: F.struct(b.alias("b"), F.xxhash64(b).bitwiseAND(BINS - 1).cast("int").alias("o"), F.shiftright(F.xxhash64(b), 8).bitwiseAND(BINS - 1).bitwiseOR(1).cast("int").alias("i")))
    better = lambda x, i: (x * (2 - i * x)).bitwiseAND(BINS - 1)  # noqa: E731  one Newton step to 1 / i
    df = df.withColumn("_empty", F.transform(drawn, lambda e: F.struct(e["b"].alias("b"), e["o"].alias("o"), e["i"].alias("i"), better(better(e["i"], e["i"]), e["i"]).alias("s"))))
    choice = lambda e, n: F.get("_low", F.array_position("_bins", (e["o"] + n * e["s"]).bitwiseAND(BINS - 1)).cast("int") - 1)
    # Beyond the first choices, the least turn over all filled bins.
    rest = lambda e: F.array_min(F.zip_with("_bins", "_low", lambda c, v: F.shiftleft(((c - e["o"]) * e["i"]).bitwiseAND(BINS - 1), BITS) + v)).bitwiseAND(low)
    lent = F.transform("_empty", lambda e: F.shiftleft(e["b"], BITS) + F.coalesce(*(choice(e, n) for n in range(CHOICES)), rest(e)))
    own = F.zip_with("_bins", "_low", lambda c, v: F.shiftleft(c, BITS) + v)
    values = F.transform(F.sort_array(F.concat(own, lent)), lambda v: (v - 32768).cast("smallint"))
    return df.withColumn(out, F.when(F.col("_none"), F.array().cast("array<smallint>")).otherwise(values)).drop("_none", "_bins", "_low", "_empty")


def packed(values: Column) -> Column:
    """The low-order bits of all bins as hexadecimal digits."""
    digits = F.lit(HEX)
    return F.when(F.size(values) == 0, EMPTY).otherwise(F.array_join(F.transform(values, lambda v: F.get(digits, v.cast("int").bitwiseAND(255))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two shingle sets, corrected for low-order bits that agree by chance."""
    chance = 2.0**-BITS
    share = F.size(F.array_intersect(a, b)) / F.lit(float(BINS))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), (share - chance) / (1 - chance)))


def run_of(doc_id: Column) -> Column:
    return F.shiftright(doc_id, RUN_BITS)


def above(keys: DataFrame) -> DataFrame:
    """own, up: each key and the next greater one, null for the greatest. keys: own, distinct and not null.

    Keys are ordered inside runs of numbers; a run's greatest key is followed by the least one of the next run that has
    keys, which the same step finds among the runs. So no task orders more than one run, or a checked number of keys.
    """
    if keys.count() <= ORDER_ROWS:
        return keys.select("own", F.lag("own").over(Window.orderBy(F.desc("own"))).alias("up"))
    inside = keys.withColumn("run", run_of(F.col("own")))
    inside = inside.select("own", "run", F.lag("own").over(Window.partitionBy("run").orderBy(F.desc("own"))).alias("up"))
    runs = keep(keys.groupBy(run_of(F.col("own")).alias("own")).agg(F.min("own").alias("least")), "runs")
    tops = above(runs.select("own")).join(runs.select(F.col("own").alias("up"), "least"), "up").select(F.col("own").alias("run"), "least")
    return inside.join(tops, "run", "left").select("own", F.coalesce("up", "least").alias("up"))


def next_heads(docs: DataFrame) -> DataFrame:
    """_id, _uid and run: the first row of each run of ids, and the run before it (for the first run, the last one)."""
    heads = keep(docs.groupBy(run_of(F.col("doc_id")).alias("own")).agg(F.max_by(F.struct("doc_id", "uid"), F.struct("doc_id", -F.col("uid"))).alias("head")), "run-firsts")
    ends = heads.agg(F.min("own").alias("least"), F.max(F.col("own").isNull()).alias("nulls")).first()
    least = F.lit(ends.least).cast("long")
    last = F.lit(None).cast("long") if ends.nulls else least
    run = F.when(F.col("own").isNull(), least).when(F.col("up").isNull(), last).otherwise(F.col("up"))
    found = heads.join(above(heads.select("own").filter(F.col("own").isNotNull())), "own", "left")
    return found.select("head.doc_id", "head.uid", run.alias("run")).toDF("_id", "_uid", "run")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row of docs."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("uid", F.xxhash64("text").bitwiseAND((1 << 62) - 1))
    heads = keep(next_heads(d.select("doc_id", "uid")), "run-heads")
    if heads.count() <= BROADCAST_ROWS:
        heads = F.broadcast(heads)
    # The first row of a run also stands, as a ghost, at the end of the run before it.
    ghosts = d.join(heads, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("uid") == F.col("_uid"))).select("doc_id", "text", "uid", "run", F.lit(1).alias("ghost"))
    rows = d.select("doc_id", "text", "uid", run_of(F.col("doc_id")).cast("long").alias("run"), F.lit(0).alias("ghost")).unionByName(ghosts)
    rows = with_print(rows, "text", "print")
    order = Window.partitionBy("run").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "uid")
    rows = rows.select("doc_id", "text", "print", "ghost", F.lead("text").over(order).alias("next"), F.lead("print").over(order).alias("next_print")).filter("ghost = 0")
    n = F.length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.expr("concat(substring(text, 1, length(text) - length(text) div 3), substring(next, 1, cast(length(text) div 3 as int)))"))
    rows = with_print(rows.drop("text", "next"), "edited", "edited_print")
    near = likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed(F.col("print")).alias("fingerprint"), packed(F.col("edited_print")).alias("edited_fingerprint"), *near)


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
