"""Made-up files of a published size, to time the whole pipeline: 444 targets, 1,644 markers, 4,432 haplotypes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..config import HMMParameters, ImputationConfig
from ..sources.vcf import write_vcf
from .impute import ImputationResult, impute

MARKERS, HAPLOTYPES, TARGETS, STATES = 1644, 4432, 444, 8


def lines(spark: SparkSession, samples: int, seed: int, masked: float, sep: str) -> DataFrame:
    """marker_idx, line: records of samples whose haplotypes are mosaics of 32 founders; a share of the genotypes is missing."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m in batch.column(0).to_pylist():
                haps = np.arange(2 * samples)
                founder = (haps * 7 + haps // 32 * (m // 200)) % 32
                a = (np.random.default_rng(m).random(32) < 0.3)[founder].astype(int).reshape(-1, 2)
                gone = np.random.default_rng(seed * MARKERS + m).random(samples) < masked
                cells = [f".{sep}." if g else f"{x}{sep}{y}" for (x, y), g in zip(a.tolist(), gone.tolist())]
                out.append("\t".join(["chr1", str((m + 1) * 1000), f"rs{m + 1}", "A", "G", ".", "PASS", ".", "GT", *cells]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(out)], ["marker_idx", "line"])

    return spark.range(MARKERS).mapInArrow(rows, "marker_idx int, line string")


def write_files(spark: SparkSession, folder: str) -> tuple[str, str]:
    """Panel and targets as VCF folders below folder."""
    n = HAPLOTYPES // 2
    write_vcf(lines(spark, n, 1, 0.0, "|"), f"{folder}/panel", [f"P{i}" for i in range(n)], ["chr1"])
    write_vcf(lines(spark, TARGETS, 2, 0.5, "/"), f"{folder}/targets", [f"T{i}" for i in range(TARGETS)], ["chr1"])
    return f"{folder}/panel", f"{folder}/targets"


def impute_published_size(spark: SparkSession, panel: str, targets: str, out: str) -> ImputationResult:
    """From files to files: load, index, states, recursion, sampled calls, written rows."""
    return impute(spark, panel, targets, out, ImputationConfig(HMMParameters(num_states=STATES)))
