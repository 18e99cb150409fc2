"""Command line: python -m haploframe --reference PANEL --target TARGET --output FOLDER."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import SparkSession

from .config import AS_IMPLEMENTED, DOCUMENTED, HMMParameters, ImputationConfig
from .plans.impute import impute


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="haploframe", description="Impute genotypes of a target VCF from a phased reference panel.")
    p.add_argument("-r", "--reference", required=True)
    p.add_argument("-t", "--target", required=True)
    p.add_argument("-o", "--output", required=True, help="folder for the VCF's parts")
    p.add_argument("-s", "--states", type=int, default=8)
    p.add_argument("--ne", type=int, default=10000)
    p.add_argument("--region", default="", help="chrom or chrom:start-end")
    p.add_argument("--mode", choices=[AS_IMPLEMENTED, DOCUMENTED], default=AS_IMPLEMENTED)
    p.add_argument("--deterministic", action="store_true")
    p.add_argument("--seed", type=int, default=12345)
    p.add_argument("--window-size", type=int, default=10000, help="markers handled at once, 0 for all")
    p.add_argument("--selector", choices=["auto", "warp", "first", "longest"], default="auto")
    p.add_argument("--gzip", action="store_true")
    p.add_argument("--probabilities", action="store_true", help="write GP")
    p.add_argument("--dosages", action="store_true", help="write DS and GP")
    p.add_argument("--strict-markers", action="store_true", help="match markers by chrom, pos, ref and alt")
    p.add_argument("--progress", action="store_true", help="print the share of samples done")
    p.add_argument("--batch-size", type=int, default=100, help="samples between two lines of --progress")
    p.add_argument("--benchmark", action="store_true", help="print seconds, samples and markers a second")
    p.add_argument("--verbose", action="store_true")
    return p


def shown(done: int, total: int) -> None:
    print(f"{done}/{total} samples, {100 * done / total:.1f} %", flush=True)


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, format="%(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    config = ImputationConfig(HMMParameters(ne=a.ne, num_states=a.states), mode=a.mode, deterministic=a.deterministic, seed=a.seed, window_size=a.window_size, selector=a.selector, strict_markers=a.strict_markers, region=a.region, output_probabilities=a.probabilities, output_dosages=a.dosages)
    spark = SparkSession.builder.appName("haploframe").getOrCreate()
    began = time.time()
    try:
        done = impute(spark, a.reference, a.target, a.output, config, "gzip" if a.gzip else "none", shown if a.progress else None, a.batch_size)
        done.release()
    except Exception as e:  # the exit code tells callers
        logging.error("%s", e)
        return 1
    if a.benchmark:
        print(f"seconds {time.time() - began:.2f}", *(f"{k}/s {v:.1f}" for k, v in done.rates.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
