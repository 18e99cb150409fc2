"""Parsing and packing of genotypes, likelihoods and small scalar models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LOG_ZERO


def parse_gt(field: Column) -> Column:
    """Alleles of a sample field: the part before the first colon, cut at its first | or /; a dot is NULL. One allele gives a one-element array."""
    parts = F.split(F.substring_index(field, ":", 1), r"[|/]", 2)
    # A second part with more separators counts up to the next one.
    return F.transform(parts, lambda x: F.when(x != ".", F.regexp_extract(x, r"^\d+", 0)).try_cast("smallint"))


def likelihood_columns(genotype: Column) -> list[Column]:
    """log10 likelihoods of 0, 1 and 2 ALT alleles for a hard call; all 0 if it is missing or something else."""
    known = genotype.isin(0, 1, 2)
    return [F.when(known & (genotype != g), F.lit(LOG_ZERO)).otherwise(F.lit(0.0)).alias(name) for g, name in enumerate(("ll_00", "ll_01", "ll_11"))]


def call_genotype(alleles: Column) -> Column:
    """Number of ALT alleles of a diploid call, NULL when there are fewer than two alleles, one is missing or not 0/1."""
    a, b = F.get(alleles, 0), F.get(alleles, 1)
    return F.when(a.isin(0, 1) & b.isin(0, 1), a + b)


def morgans(pos: Column, cm: Column | None = None) -> Column:
    """Genetic position: cM / 100 where a positive map value is known, else one cM per million bases."""
    plain = pos / F.lit(1e8)
    return plain if cm is None else F.when(cm > 0, cm / 100.0).otherwise(plain)


def haploid_emission(ll_00: Column, ll_01: Column, ll_11: Column, allele: Column, theta: float) -> Column:
    """Probability of the likelihoods given one reference allele, with error rate theta."""
    p = [F.pow(F.lit(10.0), x) for x in (ll_00, ll_01, ll_11)]
    total = p[0] + p[1] + p[2]
    same, other = F.when(allele == 0, p[0]).otherwise(p[2]), F.when(allele == 0, p[2]).otherwise(p[0])
    return (same * (1 - theta) + p[1] * 0.5 + other * theta) / total


def linear_switch(cm: Column, ne: int, rate: float) -> Column:
    """Switch probability that is linear in the distance."""
    return cm / 100.0 * (rate * ne)


def genotype_probabilities(p: Column, q: Column) -> list[Column]:
    """P(0), P(1), P(2 ALT alleles) of two independent allelic probabilities."""
    return [((1 - p) * (1 - q)).alias("p0"), ((1 - p) * q + p * (1 - q)).alias("p1"), (p * q).alias("p2")]


def pack_alleles(alleles: DataFrame, keys: list[str], index: str = "hap_idx", allele: str = "allele") -> DataFrame:
    """Four two-bit alleles a byte: keys, byte_idx, packed."""
    bits = F.call_function("shiftleft", F.col(allele).cast("int").bitwiseAND(3), (2 * (F.col(index) % 4)).cast("int"))
    return alleles.groupBy(*keys, F.floor(F.col(index) / 4).cast("int").alias("byte_idx")).agg(F.sum(bits).cast("int").alias("packed"))


def unpack_alleles(packed: DataFrame, keys: list[str], index: str = "hap_idx", allele: str = "allele") -> DataFrame:
    each = packed.select(*keys, "byte_idx", "packed", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("_k"))
    return each.select(*keys, (F.col("byte_idx") * 4 + F.col("_k")).alias(index), F.call_function("shiftright", F.col("packed"), 2 * F.col("_k")).bitwiseAND(3).alias(allele))
