"""Haplotype calls from posteriors, dosages, INFO scores and measures of quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def argmax_calls(post: DataFrame, states: DataFrame) -> DataFrame:
    """sample_idx, marker_idx, state, hap0, hap1: alleles of the likeliest state; posteriors equal to six places tie, the lowest state wins. post: sample_idx, marker_idx, log_post by state."""
    places = post.select("sample_idx", "marker_idx", F.transform("log_post", lambda x: F.round(x, 6)).alias("r"))
    return _alleles(places.select("sample_idx", "marker_idx", (F.array_position("r", F.array_max("r")) - 1).cast("int").alias("state")), states)


def uniform(seed: int, sample: Column, marker: Column) -> Column:
    """A number in [0, 1) that depends on seed, sample and marker alone."""
    key = F.concat_ws("|", F.lit(str(seed)), sample.cast("string"), marker.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def sampled_calls(post: DataFrame, states: DataFrame, seed: int = 12345) -> DataFrame:
    """sample_idx, marker_idx, state, hap0, hap1 with states drawn by their probabilities; state 0 where rounding leaves none."""
    p = post.select("sample_idx", "marker_idx", "log_post", F.array_max("log_post").alias("top"), uniform(seed, F.col("sample_idx"), F.col("marker_idx")).alias("u"))
    p = p.withColumn("p", F.transform("log_post", lambda x: F.exp(x - F.col("top"))))
    p = p.withColumn("total", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
    # The running sum, the number of states passed, and the first whose share of the sum lies above u.
    begin = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("state"))
    walk = lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n"), F.coalesce(a["state"], F.when(F.col("u") < (a["sum"] + x) / F.col("total"), a["n"])).alias("state"))
    drawn = p.select("sample_idx", "marker_idx", F.coalesce(F.aggregate("p", begin, walk, lambda a: a["state"]), F.lit(0)).alias("state"))
    return _alleles(drawn, states)


def state_lists(states: DataFrame) -> DataFrame:
    """marker_idx, a0s, a1s: the alleles of all states in their order."""
    s = states.groupBy("marker_idx").agg(F.array_sort(F.collect_list(F.struct("state", "a0", "a1"))).alias("s"))
    return s.select("marker_idx", F.col("s.a0").alias("a0s"), F.col("s.a1").alias("a1s"))


def _alleles(chosen: DataFrame, states: DataFrame) -> DataFrame:
    return chosen.join(state_lists(states), "marker_idx").select("sample_idx", "marker_idx", "state", F.get("a0s", "state").alias("hap0"), F.get("a1s", "state").alias("hap1"))


def likelihood_calls(gl: DataFrame) -> DataFrame:
    """Calls by the greatest genotype likelihood alone; ties go to more ALT alleles."""
    g = F.when((F.col("ll_00") > F.col("ll_01")) & (F.col("ll_00") > F.col("ll_11")), 0).when(F.col("ll_01") > F.col("ll_11"), 1).otherwise(2)
    return gl.select("sample_idx", "marker_idx", F.when(g == 2, 1).otherwise(0).alias("hap0"), F.when(g == 0, 0).otherwise(1).alias("hap1"))


def dosages(calls: DataFrame) -> DataFrame:
    return calls.select("sample_idx", "marker_idx", (F.col("hap0") + F.col("hap1")).cast("int").alias("dosage"))


def info_scores(d: DataFrame) -> DataFrame:
    """marker_idx, p, info: 1 less variance over 2p(1-p), between 0 and 1; 1 for a marker without variation."""
    g = d.groupBy("marker_idx").agg(F.avg("dosage").alias("mu"), F.avg(F.col("dosage") * F.col("dosage")).alias("sq")).withColumn("p", F.col("mu") / 2)
    score = 1 - (F.col("sq") - F.col("mu") * F.col("mu")) / (2 * F.col("p") * (1 - F.col("p")))
    return g.select("marker_idx", "p", F.when((F.col("p") <= 0) | (F.col("p") >= 1), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("info"))


def allelic_posteriors(post: DataFrame, states: DataFrame) -> DataFrame:
    """sample_idx, marker_idx, p, q: probabilities that the first and second haplotype carry an ALT allele."""
    s = post.select("sample_idx", "marker_idx", F.transform("log_post", F.exp).alias("w")).join(state_lists(states), "marker_idx")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    share = lambda a: total(F.zip_with("w", a, lambda w, x: F.when(x != 0, w).otherwise(0.0))) / total(F.col("w"))
    return s.select("sample_idx", "marker_idx", share("a0s").alias("p"), share("a1s").alias("q"))


def concordance(d: DataFrame, truth: DataFrame) -> DataFrame:
    """marker_idx, compared, concordance and r2 of dosages against known genotypes (sample_idx, marker_idx, genotype); r2 is 0 where either is constant."""
    j = d.join(truth.filter(F.col("genotype").isNotNull()), ["sample_idx", "marker_idx"])
    x, y = F.col("dosage").cast("double"), F.col("genotype").cast("double")
    # corr itself divides by zero, which is an error in ANSI mode, where either side is constant.
    r2 = F.try_divide(F.pow(F.covar_pop(x, y), 2), F.var_pop(x) * F.var_pop(y))
    return j.groupBy("marker_idx").agg(F.count("*").alias("compared"), F.avg((F.col("dosage") == F.col("genotype")).cast("double")).alias("concordance"), F.coalesce(r2, F.lit(0.0)).alias("r2"))


def memory_bytes(markers: Column, haplotypes: Column, samples: Column, states: int) -> Column:
    """Bytes of panel, index and the arrays of one batch of samples."""
    return (markers * haplotypes * 5 + markers * samples * (states * 8)).cast("long")


def size_report(alleles: DataFrame, gl: DataFrame, states: int) -> DataFrame:
    """One row: markers, haplotypes, samples and the bytes that they take."""
    a = alleles.agg(F.countDistinct("marker_idx").alias("markers"), F.countDistinct("hap_idx").alias("haplotypes"))
    both = a.join(gl.agg(F.countDistinct("sample_idx").alias("samples")), F.lit(True))
    return both.withColumn("bytes", memory_bytes(F.col("markers"), F.col("haplotypes"), F.col("samples"), states))


def sample_partitions(samples: DataFrame, parts: int, total: int) -> DataFrame:
    """sample_idx, part: even consecutive runs."""
    size = -(-total // parts)
    return samples.select("sample_idx", F.floor(F.col("sample_idx") / size).cast("int").alias("part"))


def placed(rows: DataFrame, parts: int, samples: int) -> DataFrame:
    """rows (sample_idx, …) with part, the number of their run of samples, each run in the partition of that number."""
    return sample_partitions(rows, parts, samples).repartitionById(parts, F.col("part"))
