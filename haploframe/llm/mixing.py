"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's documents form one token stream in seeded order, cut into blocks of ``block`` words. A mix of
``rate`` times all words is shared among sources by weight, no source beyond ``cap`` times its size. Blocks go to
sources by highest quotients. A source's stream is cut into shards of ``SHARD`` blocks. They are equal but for the last
one, so their quotients tie; running totals from a seeded phase settle the ties and give each shard an integer quota.
Inside a shard its quota of blocks is selected by a seeded permutation of the shard's blocks. A document takes the words
of its selected blocks: what it takes follows from its place in the stream, nothing is sorted globally or collected.

Null or blank texts have size 0 and take 0; null sources form one source, ranked last; repeated rows count each;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, keep, word_count

WEIGHTS = (5, 2, 1)
SEED = "mix-1"
BLOCK = 32
#: Blocks of a shard, and steps of its permutation: primes beyond that.
SHARD = 1024
STEPS = (1031, 1429, 2027, 3323, 5167, 7919, 10007, 15401)
#: Digits of the seeded order that name the runs whose places are summed up first.
RUN_DIGITS = 3


def targets(sized: DataFrame, weights=WEIGHTS, rate=(3, 2), cap: int = 2) -> DataFrame:
    """source, source_size, rank, target, and den * target as an exact integer ratio; one row per source."""
    by = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by)).withColumn("w", w.cast("long"))
    # Sources fill up in the order of size over weight; those before the first that stays below its cap are full.
    up = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("rank"))
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("left", rate[0] * F.sum("source_size").over(Window.partitionBy()) - rate[1] * F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)))
    s = s.withColumn("open_w", F.sum("w").over(after)).withColumn("full", rate[1] * cap * F.col("source_size") * F.col("open_w") <= F.col("left") * F.col("w"))
    s = s.withColumn("at", F.row_number().over(up)).withColumn("first", F.min(F.when(~F.col("full"), F.struct("at", "left", "open_w"))).over(Window.partitionBy()))
    share = (F.col("first.left") * F.col("w")).cast("double") / (rate[1] * F.col("first.open_w")).cast("double")
    return s.withColumn("target", F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(share)).select("source", "source_size", "rank", "target")


def quotas(goal: DataFrame, block: int = BLOCK, rate=(3, 2), cap: int = 2) -> DataFrame:
    """Blocks for each source by highest quotients target / (2 k + 1): the seats of one divisor, then single seats."""
    whole = Window.partitionBy()
    g = goal.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    g = g.withColumn("seats", F.expr(f"({rate[0]} * sum(source_size) over () + {rate[1] * block // 2}) div {rate[1] * block}"))
    g = g.withColumn("base", F.floor(F.col("target") / block + 0.5).cast("long")).withColumn("gap", F.col("seats") - F.sum("base").over(whole))
    steps = F.expr("case when gap > 0 then sequence(base, base + gap - 1) when gap < 0 then sequence(greatest(base + gap, 0), base - 1) else array() end")
    each = g.filter("source_size > 0 and (gap > 0 or base > 0)").select("rank", "target", "gap", "blocks", F.explode(steps).alias("k")).filter(f"gap < 0 or k < {cap} * blocks")
    each = each.withColumn("quotient", F.col("target") / (2 * F.col("k") + 1).cast("double"))
    sign = F.signum(F.col("gap"))
    best = Window.orderBy((-sign * F.col("quotient")).asc(), (sign * F.col("rank")).asc(), F.col("k"))
    moved = each.withColumn("nth", F.row_number().over(best)).filter("nth <= abs(gap)").groupBy("rank").agg(F.sum(F.signum("gap")).cast("long").alias("moved"))
    return g.join(moved, "rank", "left").withColumn("quota", F.col("base") + F.coalesce("moved", F.lit(0))).select("source", "source_size", "rank", "target", "blocks", "quota")


def mix_sources(docs: DataFrame, block: int = BLOCK, seed: str = SEED, weights=WEIGHTS, rate=(3, 2), cap: int = 2) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of docs (doc_id, text, source)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")), "sizes").withColumn("run", F.substring("key", 1, RUN_DIGITS))
    q = quotas(targets(sized, weights, rate, cap), block, rate, cap)
    # One row per source and run: where the run begins in its source's stream.
    running = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = sized.groupBy("source", "run").agg(F.sum("size").alias("words")).withColumn("begin", F.coalesce(F.sum("words").over(running), F.lit(0)))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long")
    q = q.withColumn("n", F.greatest("blocks", F.lit(1))).withColumn("seed", start).withColumn("phase", F.pmod(start, F.col("n"))).withColumn("each", F.expr("quota div n")).withColumn("extra", F.expr("quota % n"))
    q = q.withColumnRenamed("source", "q_source")
    runs = runs.join(q, runs["source"].eqNullSafe(q["q_source"])).drop("q_source", "words", "rank", "blocks", "quota").withColumnRenamed("source", "r_source").withColumnRenamed("run", "r_run")
    d = sized.join(runs, sized["source"].eqNullSafe(runs["r_source"]) & (sized["run"] == runs["r_run"]))
    inside = Window.partitionBy("source", "run").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("a", F.col("begin") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.withColumn("b0", F.expr(f"a div {block}")).withColumn("b1", F.expr(f"(a + size - 1) div {block}"))
    # The shards that hold blocks of the document, with their quotas, and the seeded permutation b -> (b * step + shift) % len of their blocks.
    summed = lambda b: f"((cast({b} as decimal(19,0)) * cast(extra as decimal(18,0)) + phase) div n)"
    length, mixed = f"(least(n, (s + 1) * {SHARD}L) - s * {SHARD}L)", "((seed + s * 2654435761L) % 4294967296L)"
    shard = f"named_struct('first', s * {SHARD}L, 'len', {length}, 'quota', {summed(f'least(n, (s + 1) * {SHARD}L)')} - {summed(f's * {SHARD}L')}, 'step', element_at(array{STEPS}, cast({mixed} % {len(STEPS)} + 1 as int)), 'shift', ({mixed} div {len(STEPS)}) % {length})"
    d = d.withColumn("shards", F.expr(f"transform(sequence(b0 div {SHARD}, b1 div {SHARD}), s -> {shard})"))
    part = f"least(a + size, (b + 1) * {block}L) - greatest(a, b * {block}L)"
    words = f"aggregate(sequence(greatest(b0, x.first), least(b1, x.first + x.len - 1)), 0L, (w, b) -> w + if(((b - x.first) * x.step + x.shift) % x.len < x.quota, {part}, 0L))"
    taken = F.expr(f"case when size = 0 then 0L else each * size + aggregate(shards, 0L, (t, x) -> t + {words}) end")
    return d.withColumn("taken", taken.cast("long")).select("doc_id", "size", "source_size", "target", "taken")


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def oracle(block: int = BLOCK, seed: str = SEED) -> str:
    f = lambda b: f"((({b})::hugeint * extra + phase) // n)"
    s, mixed = f"(b // {SHARD})", f"((start + (b // {SHARD}) * 2654435761) % 4294967296)"
    length = f"(least(n, ({s} + 1) * {SHARD}) - {s} * {SHARD})"
    quota = f"({f(f'least(n, ({s} + 1) * {SHARD})')} - {f(f'{s} * {SHARD}')})"
    chosen = f"((b - {s} * {SHARD}) * ([{', '.join(map(str, STEPS))}])[({mixed} % {len(STEPS)} + 1)::int] + ({mixed} // {len(STEPS)}) % {length}) % {length} < {quota}"
    return f"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size, md5('{seed}:' || coalesce(doc_id::varchar, '')) as k from documents),
s0 as (select source, sum(size)::bigint source_size from sized group by source),
s1 as (select *, row_number() over (order by source nulls last) as rank from s0),
s2 as (select *, (case (rank - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::bigint w from s1),
s3 as (select *, row_number() over up as spot, (3 * sum(source_size) over () - 2 * coalesce(sum(2 * source_size) over (order by source_size::double / w, rank rows between unbounded preceding and 1 preceding), 0))::bigint l,
  (sum(w) over (order by source_size::double / w, rank rows between current row and unbounded following))::bigint ow from s2 window up as (order by source_size::double / w, rank)),
s4 as (select *, 4 * source_size * ow <= l * w as is_full from s3),
f as (select l as fl, ow as fow from s4 where not is_full order by spot limit 1),
s5 as (select source, source_size, rank, case when is_full then (2 * source_size)::double else (fl * w)::double / (2 * fow)::double end as target from s4 left join f on true),
g as (select *, (source_size + {block - 1}) // {block} as blocks, ((3 * sum(source_size) over () + {block}) // {2 * block})::bigint seats, floor(target / {block} + 0.5)::bigint base from s5),
g1 as (select *, (seats - sum(base) over ())::bigint gap from g),
c as (select rank, gap, unnest(case when gap > 0 then range(base, base + gap) when gap < 0 then range(greatest(base + gap, 0), base) else [] end) as k, target, blocks from g1 where source_size > 0),
c1 as (select *, row_number() over (order by -sign(gap) * (target / (2 * k + 1)::double), sign(gap) * rank, k) as nth from c where gap < 0 or k < 2 * blocks),
m as (select rank, sum(sign(gap))::bigint moved from c1 where nth <= abs(gap) group by rank),
q as (select g1.*, base + coalesce(moved, 0) as quota, greatest(blocks, 1) as n from g1 left join m using (rank)),
q0 as (select *, ('0x' || substr(md5('{seed}/' || coalesce(source, '')), 1, 8))::bigint as start from q),
q1 as (select *, start % n as phase, quota // n as each, quota % n as extra from q0),
d as (select doc_id, size, source_size, target, n, start, phase, each, extra, coalesce(sum(size) over (partition by sized.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint a
  from sized join q1 on sized.source is not distinct from q1.source),
e as (select *, row_number() over () as id, a // {block} as b0, (a + size - 1) // {block} as b1 from d),
p as (select *, unnest(range(b0, b1 + 1)) as b from e where size > 0),
t as (select id, sum(case when {chosen} then least(a + size, (b + 1) * {block}) - greatest(a, b * {block}) else 0 end) as selected from p group by id)
select doc_id, size, source_size, target, (each * size + coalesce(selected, 0))::bigint as taken from e left join t using (id)
"""
