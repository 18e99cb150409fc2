"""A panel, targets and markers derived from the order tables by integer arithmetic, as input of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HMMParameters
from ..functions.genotypes import likelihood_columns, morgans
from ..operators import hmm, pbwt

MARKERS, PANEL_SAMPLES, TARGETS, STATES = 32, 16, 24, 8
HAPLOTYPES = 2 * PANEL_SAMPLES
PARAMETERS = HMMParameters(num_states=STATES)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def alleles(spark: SparkSession, sf_dir: str, panel_samples: int = PANEL_SAMPLES) -> DataFrame:
    """marker_idx, hap_idx, allele of the whole grid; cells without a row are missing (NULL)."""
    m, h = (F.col("l_partkey") % MARKERS).cast("int"), ((F.col("l_suppkey") % panel_samples) * 2 + F.col("l_linenumber") % 2).cast("int")
    known = lineitem(spark, sf_dir).groupBy(m.alias("marker_idx"), h.alias("hap_idx")).agg((F.sum("l_quantity").cast("long") % 2).cast("int").alias("allele"))
    grid = spark.range(MARKERS * 2 * panel_samples).select((F.col("id") / (2 * panel_samples)).cast("int").alias("marker_idx"), (F.col("id") % (2 * panel_samples)).cast("int").alias("hap_idx"))
    return grid.join(known, ["marker_idx", "hap_idx"], "left")


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, marker_idx, genotype (0, 1, 2 or NULL)."""
    g = lineitem(spark, sf_dir).groupBy((F.col("l_orderkey") % TARGETS).cast("int").alias("sample_idx"), (F.col("l_partkey") % MARKERS).cast("int").alias("marker_idx"))
    return g.agg(F.when(F.count("*") % 7 != 0, (F.sum("l_quantity").cast("long") % 3).cast("int")).alias("genotype"))


def likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes(spark, sf_dir).select("sample_idx", "marker_idx", *likelihood_columns(F.col("genotype")))


def markers(spark: SparkSession) -> DataFrame:
    m = F.col("id")
    return spark.range(MARKERS).select(m.cast("int").alias("marker_idx"), F.lit("chr1").alias("chrom"), ((m + 1) * 1000 + m * m * 10).alias("pos"), F.concat(F.lit("rs"), (m + 1).cast("string")).alias("id"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.lit(0.0).alias("cm"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers as many as there are parts, 500 a chromosome, every third one with a map position."""
    k = F.col("p_partkey")
    pos = (k % 500 + 1) * 1000 + F.col("p_size")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.cast("int").alias("marker_idx"), F.concat(F.lit("chr"), (F.expr("p_partkey div 500") + 1).cast("string")).alias("chrom"), pos.cast("long").alias("pos"), F.concat(F.lit("rs"), k.cast("string")).alias("id"), F.when(k % 3 == 0, F.col("p_retailprice") / 1000).otherwise(0.0).alias("cm"))


def mapped_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).select("marker_idx", "chrom", "pos", morgans(F.col("pos"), F.col("cm")).alias("morgans"))


def mapped(spark: SparkSession) -> DataFrame:
    return markers(spark).select("marker_idx", "chrom", "pos", morgans(F.col("pos"), F.col("cm")).alias("morgans"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alleles(spark, sf_dir)
    return hmm.state_alleles(pbwt.select_first(pbwt.prefix_order(a), STATES, HAPLOTYPES), a)


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.emissions(likelihoods(spark, sf_dir), states(spark, sf_dir))


def posteriors(spark: SparkSession, sf_dir: str, mode: str = "as_implemented", window: int = 0) -> DataFrame:
    """By state in lists; see hmm.unrolled for rows."""
    return hmm.posteriors(likelihoods(spark, sf_dir), states(spark, sf_dir), mapped(spark), PARAMETERS, mode, window)
