"""The imputation pipeline over relations and over VCF files."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import Accumulator, InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import AS_IMPLEMENTED, ImputationConfig, ImputationError
from ..functions.genotypes import genotype_probabilities, morgans
from ..operators import calls, hmm, pbwt
from ..sources import vcf
from ..storage import shared_path

#: Seconds between two looks at a running query.
POLL = 0.2

log = logging.getLogger("haploframe")


@dataclass
class ImputationResult:
    """Lazy results: imputed(sample_idx, marker_idx, state, hap0, hap1), kept once it was made, info(marker_idx, p, info), probabilities(…, p0, p1, p2, ds)."""

    imputed: DataFrame
    info: DataFrame
    probabilities: DataFrame
    markers: DataFrame
    samples: list[str] | None = None
    #: Tables kept in memory for this result.
    held: list[DataFrame] = field(default_factory=list)
    #: Samples, markers and, after Imputer.run, cells a second, from reading to writing, once something was written.
    rates: dict[str, float] = field(default_factory=dict)

    def release(self) -> None:
        """Lets go of the tables that are kept; what is asked for afterwards is made anew."""
        for df in self.held:
            df.unpersist()

    def dosages(self) -> DataFrame:
        return calls.dosages(self.imputed)

    def haplotypes(self, sample: int) -> DataFrame:
        return self.imputed.filter(F.col("sample_idx") == sample).select("marker_idx", "hap0", "hap1")

    def write_vcf(self, path: str, compression: str = "none", probabilities: bool = False, dosage: bool = False) -> None:
        contigs = [r[0] for r in self.markers.select("chrom").distinct().orderBy("chrom").collect()]
        names = self.samples or [f"S{r[0]}" for r in self.imputed.select("sample_idx").distinct().orderBy("sample_idx").collect()]
        rows = vcf.probability_rows(self.probabilities, self.markers, dosage) if probabilities else vcf.phased_rows(self.imputed, self.markers)
        if path.endswith((".vcf.gz", ".vcf.bgz", vcf.BCF)):
            vcf.save_vcf(rows, path, names, contigs)
        else:
            vcf.write_vcf(rows, path, names, contigs, compression)


class Imputer:
    """Imputes targets against one panel: markers (marker_idx, chrom, pos, …), and alleles in rows (marker_idx, hap_idx, allele) or wide (chrom, marker_idx, alleles, see vcf.wide_panel)."""

    def __init__(self, alleles: DataFrame, markers: DataFrame, config: ImputationConfig | None = None):
        self.config = config or ImputationConfig()
        self.markers = markers
        self.panel = alleles if "alleles" in alleles.columns else pbwt.wide(alleles, markers)
        self.index: DataFrame | None = None
        self._haplotypes: int | None = None
        self._size: int | None = None

    @property
    def haplotypes(self) -> int:
        if self._haplotypes is None:
            found = self.panel.agg(F.max(F.octet_length("alleles"))).first()[0]
            if not found:
                raise ImputationError("the panel is empty")
            self._haplotypes = found
        return self._haplotypes

    @property
    def size(self) -> int:
        """Number of markers."""
        if self._size is None:
            self._size = self.markers.count()
        return self._size

    def sequences(self) -> DataFrame:
        """The wide panel; as implemented, all chromosomes are one sequence."""
        return self.panel.withColumn("chrom", F.lit("")) if self.config.mode == AS_IMPLEMENTED else self.panel

    def build_index(self) -> Imputer:
        self.index = pbwt.fold_order(self.sequences())
        return self

    def save_index(self, path: str) -> None:
        """In its compact form, from which load_index makes the orders again."""
        pbwt.save_index(pbwt.compact_index(self.sequences()), path)

    def load_index(self, path: str) -> Imputer:
        self.index = pbwt.load_index(self.panel.sparkSession, path)
        return self

    @property
    def has_index(self) -> bool:
        return self.index is not None

    def states(self) -> DataFrame:
        """marker_idx, state, hap0, hap1, a0, a1."""
        h, n = self.config.hmm, self.haplotypes
        if h.use_pbwt_selection and self.has_index:
            chosen = pbwt.choose(self.index, h.num_states, n, self.config.selector)
        else:
            chosen = pbwt.select_simple(self.panel.select("marker_idx"), h.num_states, n)
        at = lambda c: F.conv(F.hex(F.substring("alleles", F.col(c) + 1, F.lit(1))), 16, 10).cast("int")
        return chosen.join(self.panel.select("marker_idx", "alleles"), "marker_idx").select("marker_idx", "state", "hap0", "hap1", at("hap0").alias("a0"), at("hap1").alias("a1"))

    def marks(self) -> DataFrame:
        return self.markers.select("marker_idx", "chrom", morgans(F.col("pos"), F.col("cm") if "cm" in self.markers.columns else None).alias("morgans"))

    def transitions(self) -> DataFrame:
        return hmm.transitions(self.marks(), self.config.hmm)

    def check(self, gl: DataFrame, target_markers: DataFrame | None) -> DataFrame:
        """Targets on the panel's marker numbers: by place with equal counts, or by (chrom, pos, ref, alt) if strict; markers that strict targets lack count as not genotyped."""
        if target_markers is None:
            return gl
        if self.config.strict_markers:
            by = ["chrom", "pos", "ref", "alt"]
            same = target_markers.select(F.col("marker_idx").alias("_t"), *by).join(self.markers.select("marker_idx", *by), by)
            if "calls" in gl.columns:
                n = gl.agg(F.max(F.octet_length("calls"))).first()[0] or 0
                known = gl.withColumnRenamed("marker_idx", "_t").join(same.select("_t", "marker_idx"), "_t").drop("_t")
                return self.markers.select("marker_idx").join(known, "marker_idx", "left").withColumn("calls", F.coalesce("calls", F.lit(bytes([255] * n))))
            return hmm.complete(gl.withColumnRenamed("marker_idx", "_t").join(same.select("_t", "marker_idx"), "_t").drop("_t"), self.markers)
        found = target_markers.count()
        if found != self.size:
            raise ImputationError(f"{found} target markers for a panel of {self.size}")
        return gl

    def posteriors(self, gl: DataFrame, states: DataFrame, done: Accumulator | None = None) -> DataFrame:
        c = self.config
        return hmm.posteriors(gl, states, self.marks(), c.hmm, c.mode, c.window_size if 0 < c.window_size < self.size else 0, ("log_post",), done=done)

    def called(self, post: DataFrame, states: DataFrame) -> DataFrame:
        return calls.argmax_calls(post, states) if self.config.deterministic else calls.sampled_calls(post, states, self.config.seed)

    def impute(self, gl: DataFrame, target_markers: DataFrame | None = None, samples: list[str] | None = None) -> ImputationResult:
        """gl: sample_idx, marker_idx, ll_00, ll_01, ll_11 (log10), a row for each sample and marker, or wide targets (marker_idx, calls, see vcf.wide_targets). The recursion runs once, when a result is first asked for."""
        states = self.states().persist()
        post = self.posteriors(self.check(gl, target_markers), states)
        held = [states]
        if self.config.output_probabilities or self.config.output_dosages:
            held.append(post := post.persist())
        held.append(imputed := self.called(post, states).persist())
        return self.result(imputed, post, states, samples, held)

    def result(self, imputed: DataFrame, post: DataFrame, states: DataFrame, samples: list[str] | None, held: list[DataFrame]) -> ImputationResult:
        pq = calls.allelic_posteriors(post, states)
        probs = pq.select("sample_idx", "marker_idx", *genotype_probabilities(F.col("p"), F.col("q")), (F.col("p") + F.col("q")).alias("ds"))
        return ImputationResult(imputed, calls.info_scores(calls.dosages(imputed)), probs, self.markers, samples, held)

    def run(self, gl: DataFrame, path: str, progress: Callable[[int, int], None] | None = None, step: int = 100, target_markers: DataFrame | None = None, samples: list[str] | None = None) -> ImputationResult:
        """Imputes into Parquet below path, all samples in one query; the result reads that table and has rates.

        progress(done, total) is called in this thread for each ``step`` samples, and for all at the end. While the
        query runs, samples are counted by the cells of finished tasks of the recursion, so the calls come as tasks end,
        and a task that runs again counts once. An error of progress stops the query. gl is as in impute; no sample, no
        call and an empty table.
        """
        spark = gl.sparkSession
        began = time.time()
        wide = "calls" in gl.columns
        total = (gl.agg(F.max(F.octet_length("calls") if wide else F.col("sample_idx") + 1)).first()[0]) or 0
        states = self.states().persist()
        goal = self.check(gl, target_markers)
        done, cells = spark.sparkContext.accumulator({}, hmm.Finished()), Observation()
        rows = self.called(self.posteriors(goal, states, done), states).observe(cells, F.count("*").alias("cells"))
        tag, failed = f"haploframe-{uuid.uuid4().hex}", []

        def write() -> None:
            try:
                spark.addTag(tag)
                rows.write.parquet(path)
            except BaseException as e:  # raised again by the caller's thread
                failed.append(e)

        told = 0
        job = InheritableThread(target=write, session=spark)
        job.start()
        try:
            while job.is_alive():
                job.join(POLL)
                while progress and told + step <= min(total, sum(done.value.values()) // max(1, self.size)):
                    told += step
                    progress(told, total)
        except BaseException:
            spark.interruptTag(tag)
            job.join()
            states.unpersist()
            raise
        if failed:
            states.unpersist()
            raise failed[0]
        while progress and told < total:
            told = min(told + step, total)
            progress(told, total)
        s = time.time() - began
        found = self.result(spark.read.schema(rows.schema).parquet(path), self.posteriors(goal, states), states, samples, [states])
        found.rates = {"samples": total / s, "markers": self.size / s, "cells": cells.get["cells"] / s}
        return found

    def impute_with_progress(self, gl: DataFrame, progress: Callable[[int, int], None], path: str, batch_size: int = 100) -> DataFrame:
        """The imputed rows of run, with a call of progress for each batch_size samples."""
        found = self.run(gl, path, progress, batch_size)
        found.release()
        return found.imputed


def impute(spark: SparkSession, reference: str, target: str, out: str | None = None, config: ImputationConfig | None = None, compression: str = "none", progress: Callable[[int, int], None] | None = None, step: int = 100) -> ImputationResult:
    """Panel and targets from VCF or BCF files, results to out if it is given: one indexed file for a name that ends in .vcf.gz or .bcf, else a folder of text parts. With progress (see Imputer.run) the calls are first written below spark.checkpoint.dir."""
    c = config or ImputationConfig()
    began = time.time()
    panel = vcf.panel_rows(spark, reference, c.region).persist()
    goal = vcf.target_rows(spark, target, c.region).persist()
    imputer = Imputer(panel, panel.drop("alleles"), c).build_index()
    names = vcf.read_header(spark, target).sample_names
    known = goal.select("marker_idx", "calls"), goal.drop("calls")
    result = imputer.run(known[0], shared_path(spark, "imputed"), progress, step, known[1], names) if progress else imputer.impute(*known, names)
    result.held += [panel, goal]
    if out:
        result.write_vcf(out, compression, c.output_probabilities or c.output_dosages, c.output_dosages)
        s = time.time() - began
        result.rates |= {"samples": len(names) / s, "markers": imputer.size / s}
        log.info("%d samples and %d markers in %.1f s; a second: %.1f samples, %.1f markers", len(names), imputer.size, s, len(names) / s, imputer.size / s)
    return result
