"""Line dedup: later copies of repeated line runs are deleted.

The collection is a sequence of line ids for each document. Prefix doubling orders its suffixes by their first 1, 2, 4,
… lines: suffixes get the rank of their first line, and from the ranks of h lines, pairs h or fewer apart give those of
up to 2h lines. The distinct keys are ranked by a sort inside fixed ranges of their first member and by running totals
over those ranges, so neither a frequent line nor the whole list meets in one task. Suffixes whose prefix of a depth is
unique leave after each step: they can't begin a longer repeated run. Suffixes of equal rank at a depth are the
longest-common-prefix intervals of at least that depth; each but the earliest of an interval (smallest doc_id, then
position) begins a later copy.

Later copies of ``min_lines`` lines go, and with ``min_words`` shorter ones too, single lines included, if they hold that
many words. What goes is the union of such copies: the maximal runs of lines that are in one. Deeper ranks would delete
no other line, so doubling ends there.

All of this comes from one table of line ids, written once. Lines are what line feeds separate, compared whole and
unchanged by two 64-bit hashes; blank lines count as lines. A null text has no lines and stays null; an empty text has
one. Rows that repeat an id and its text are one document and get the same result; rows that share only an id are told
apart by their text. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, keep

MIN_LINES = 3
#: Words of a shorter run that goes too, in the query and in stages of a corpus.
MIN_WORDS = 8
#: Ranks in one range, as a power of two.
RANGE_BITS = 16
WORD = r"[^\x20\x09-\x0D]+"


def line_ids(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc, uid, pos, the line's two hashes h1 and h2, and for each of sizes the words w<n> of so many lines from there on."""
    d = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("uid"), "text")
    if not d.groupBy("doc", "uid").count().filter("count > 1").isEmpty():
        d = d.dropDuplicates(["doc", "uid"])
    line = lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"), (F.regexp_count(x, F.lit(WORD)) if sizes else F.lit(0)).alias("w"))
    d = d.select("doc", "uid", F.transform(F.split("text", "\n", -1), line).alias("ids"))
    d = d.select("doc", "uid", F.arrays_zip(*(F.expr(f"slice(ids, {k + 1}, size(ids))").alias(f"l{k}") for k in range(max(sizes, default=1)))).alias("lines"))
    # The outer form: Catalyst puts no filter on the size of the list below it, which would count all words again.
    d = d.select("doc", "uid", F.posexplode_outer("lines").alias("pos", "at"))
    words = lambda n: sum((F.coalesce(f"at.l{k}.w", F.lit(0)) for k in range(1, n)), F.col("at.l0.w")).alias(f"w{n}")
    return d.select("doc", "uid", "pos", "at.l0.h1", "at.l0.h2", *(words(n) for n in sizes))


def ranked(suffixes: DataFrame, key: list[str], part: Column) -> DataFrame:
    """Replaces the key of each suffix by its rank, the number of suffixes with smaller keys, and later, whether one with an equal key begins earlier; suffixes with a key of their own leave."""
    here = F.struct("doc", "uid", "pos")
    groups = keep(suffixes.groupBy(*key).agg(F.count("*").alias("n"), F.min(here).alias("first")).filter("n > 1").withColumn("part", part), "line-keys")
    order = Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = groups.groupBy("part").agg(F.sum("n").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    ranks = groups.withColumn("inside", F.coalesce(F.sum("n").over(order), F.lit(0))).join(parts, "part").select(*(F.col(c).alias(f"_{c}") for c in key), (F.col("base") + F.col("inside")).alias("new_rank"), "first")
    same = F.lit(True)
    for c in key:
        same &= F.col(c) == F.col(f"_{c}")
    rest = [c for c in suffixes.columns if c not in (*key, "doc", "uid", "pos", "rank", "later")]
    return suffixes.join(ranks, same).select("doc", "uid", "pos", *rest, F.col("new_rank").alias("rank"), (here > F.col("first")).alias("later"))


def doubled(suffixes: DataFrame, step: int) -> DataFrame:
    """The ranks of suffixes of some depth to those of a depth that is step greater."""
    # The rank step lines on: suffixes that have left leave gaps, so positions are compared.
    ahead = Window.partitionBy("doc", "uid").orderBy("pos").rangeBetween(step, step)
    return ranked(suffixes.withColumn("next", F.first("rank").over(ahead)).filter(F.col("next").isNotNull()), ["rank", "next"], F.shiftright("rank", RANGE_BITS))


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """doc, uid, pos and end of each run of min_lines lines, or of fewer lines with min_words words, that also begins earlier."""
    if min_lines < 1:
        raise ValueError("a run has at least one line")
    short = list(range(1, min_lines)) if min_words is not None else []
    lines = keep(line_ids(docs, short), "line-ids")
    ranks = {1: keep(ranked(lines, ["h1", "h2"], F.shiftrightunsigned("h1", 48)), "line-ranks")}
    powers = [1 << k for k in range(1, min_lines.bit_length()) if 1 << k < min_lines]
    for depth in sorted({*powers, *short, min_lines} - {1}):
        half = 1 << (depth - 1).bit_length() - 1
        ranks[depth] = keep(doubled(ranks[half], depth - half), "line-ranks")
    gone = [ranks[n].filter(F.col("later") & (F.col(f"w{n}") >= min_words)) for n in short] + [ranks[min_lines].filter("later")]
    out = None
    for n, found in zip([*short, min_lines], gone):
        found = found.select("doc", "uid", "pos", (F.col("pos") + n).alias("end"))
        out = found if out is None else out.union(found)
    return out


def removed_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """doc, uid and the sorted maximal runs [from, to) of lines that go."""
    c = later_copies(docs, min_lines, min_words)
    by = Window.partitionBy("doc", "uid").orderBy("pos", "end")
    c = c.withColumn("new", (F.col("pos") > F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))).cast("int"))
    c = c.withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(by)).groupBy("doc", "uid", "run").agg(F.min("pos").alias("from"), F.max("end").alias("to"))
    return c.groupBy("doc", "uid").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """docs without later copies of runs of min_lines lines, or of fewer lines with min_words words: text cut, and n_lines and n_removed added (existing columns of these names are replaced)."""
    base = docs.drop("n_lines", "n_removed")
    runs = removed_runs(docs, min_lines, min_words).select(F.col("doc").alias("__hf_doc"), F.col("uid").alias("__hf_uid"), F.col("runs").alias("__hf_runs"))
    d = base.withColumn("__hf_of", F.xxhash64("text")).join(runs, F.col("doc_id").eqNullSafe(F.col("__hf_doc")) & (F.col("__hf_of") == F.col("__hf_uid")), "left")
    lines = F.split("text", "\n", -1)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    gone = F.aggregate("__hf_runs", F.lit(0), lambda a, r: a + r["to"] - r["from"])
    # What lies between one run's end and the next run's start.
    starts = F.concat(F.transform("__hf_runs", lambda r: r["from"]), F.array(n))
    ends = F.concat(F.array(F.lit(0)), F.transform("__hf_runs", lambda r: r["to"]))
    parts = F.zip_with(ends, starts, lambda a, b: F.slice(lines, a + 1, b - a))
    text = F.when(F.col("__hf_runs").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(parts), "\n"))
    return d.withColumns({"__hf_cut": text, "n_lines": n.cast("long"), "n_removed": F.coalesce(gone, F.lit(0)).cast("long")}).select(*(F.col("__hf_cut").alias("text") if c == "text" else c for c in base.columns), "n_lines", "n_removed")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    d = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_words=MIN_WORDS)
    return d.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def oracle(min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> str:
    """SQL for op8_line_dedup: runs of one line up to min_lines lines, all but the longest with min_words words."""
    sizes = range(1, min_lines + 1)
    runs = {n: " || chr(10) || ".join(f"lead(line, {k}) over by_pos" for k in range(n)) for n in sizes}
    words = {n: " + ".join(f"lead(words, {k}) over by_pos" for k in range(n)) for n in sizes}
    later = {n: f"row_number() over (partition by r{n} order by doc_id, pos) > 1 and r{n} is not null" + (f" and w{n} >= {min_words}" if n < min_lines else "") for n in sizes}
    gone = " or ".join(f"coalesce(lag(f{n}, {k}) over by_pos, false)" for n in sizes for k in range(n))
    return f"""
with l0 as (select doc_id, string_split(text, chr(10)) as a from documents where text is not null),
l1 as (select doc_id, unnest(a) as line, unnest(range(len(a))) as pos from l0),
l as (select *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as words from l1),
w as (select doc_id, pos, line, {", ".join(f"{runs[n]} as r{n}, {words[n]} as w{n}" for n in sizes)} from l window by_pos as (partition by doc_id order by pos)),
f as (select *, {", ".join(f"{later[n]} as f{n}" for n in sizes)} from w),
g as (select *, {gone} as gone from f window by_pos as (partition by doc_id order by pos)),
r as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as kept from g group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents d left join r using (doc_id)
"""
