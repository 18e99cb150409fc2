"""Values at given places, with a default where there is none: left joins of a table of places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MISSING


def _at(places: DataFrame, values: DataFrame, keys: list[str], **defaults: float | int | None) -> DataFrame:
    found = places.join(values.select(*keys, *defaults), keys, "left")
    return found.select(*places.columns, *((F.coalesce(c, F.lit(d)) if d is not None else F.col(c)).alias(c) for c, d in defaults.items()))


def allele_at(places: DataFrame, alleles: DataFrame) -> DataFrame:
    """places (marker_idx, hap_idx) with allele; outside the panel, or missing, it is 255."""
    return _at(places, alleles, ["marker_idx", "hap_idx"], allele=MISSING)


def likelihood_at(places: DataFrame, gl: DataFrame) -> DataFrame:
    """places (sample_idx, marker_idx) with ll_00, ll_01, ll_11; all 0 where there is no target."""
    return _at(places, gl, ["sample_idx", "marker_idx"], ll_00=0.0, ll_01=0.0, ll_11=0.0)


def haplotypes_at(places: DataFrame, imputed: DataFrame) -> DataFrame:
    """places (sample_idx, marker_idx) with hap0 and hap1, NULL where nothing was imputed."""
    return _at(places, imputed, ["sample_idx", "marker_idx"], hap0=None, hap1=None)


def dosage_at(places: DataFrame, dosages: DataFrame) -> DataFrame:
    """places (sample_idx, marker_idx) with dosage, 0 where nothing was imputed."""
    return _at(places, dosages, ["sample_idx", "marker_idx"], dosage=0)


def info_at(places: DataFrame, info: DataFrame) -> DataFrame:
    """places (marker_idx) with info, 0 for a marker without one."""
    return _at(places, info, ["marker_idx"], info=0.0)
