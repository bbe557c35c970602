"""One sample from input files to exported segments, stage by stage.

Each stage writes Parquet under the run's folder and is skipped when its
result is there, so a run that broke off goes on where it was. Within a stage
the plan is lazy; samplers run one chain for each arm, segment or draw.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.genome import chromosome_lengths, genome_position
from strandline.operators import allelic_mcmc, conversion, copy_ratio, coverage, coverage_mcmc, dirichlet, intervals, ordered, purity, regression, snps
from strandline.sources import readers


@dataclass(frozen=True)
class Inputs:
    """Paths of a sample's files; those that are None are left out."""

    calls: str
    tumour_counts: str
    coverage: str
    cytoband: str
    normal_counts: str | None = None
    readbacked: str | None = None
    tracks: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Settings:
    seed: int = 1
    site_chunk: int = 10_000
    allelic_iterations: int = 20_000
    allelic_draws: int = 10
    cluster_sweeps: int = 40
    coverage_iterations: int = 200
    coverage_draws: int = 5
    ratio_iterations: int = 2000
    exome: bool = False


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a stage has finished: its success mark is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


class Run:
    """The stages of a sample under one folder."""

    def __init__(self, spark: SparkSession, inputs: Inputs, folder: str, settings: Settings = Settings()) -> None:
        self.spark, self.inputs, self.folder, self.settings = spark, inputs, folder.rstrip("/"), settings

    def _stage(self, name: str, make) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not exists(self.spark, path):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def arms(self) -> DataFrame:
        return self._stage("arms", lambda: snps.chromosome_arms(readers.cytoband(self.spark, self.inputs.cytoband)))

    def sites(self) -> DataFrame:
        def make() -> DataFrame:
            i = self.inputs
            normal = readers.allele_counts(self.spark, i.normal_counts, "_n") if i.normal_counts else None
            backed = readers.readbacked_vcf(self.spark, i.readbacked) if i.readbacked else None
            return snps.load_sites(readers.phased_vcf(self.spark, i.calls), readers.allele_counts(self.spark, i.tumour_counts), self.arms(), normal, backed)

        return self._stage("sites", make)

    def chunked_segments(self) -> DataFrame:
        """Segmentations of chunks of sites, merged to one for each arm."""

        def make() -> DataFrame:
            size = self.settings.site_chunk
            ranges = ordered.chunk_ranges(self.sites(), ["arm"], size).select("arm", F.col("start").alias("chunk_start"), F.col("end").alias("chunk_end"))
            place = F.row_number().over(Window.partitionBy("arm").orderBy("pos")) - 1
            placed = self.sites().withColumn("place", place.cast("long")).join(F.broadcast(ranges), "arm").filter("place >= chunk_start and place < chunk_end")
            return allelic_mcmc.merge_chunks(allelic_mcmc.allelic_segments(placed, ["arm", "chunk_start"], "place", "maj_count", "min_count", self.settings.allelic_iterations, self.settings.allelic_draws, self.settings.seed))

        return self._stage("allelic_segments", make)

    def reference_bias(self) -> float:
        last = self._last_draw(self.chunked_segments())
        breaks = last.select("arm", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))
        placed = self.sites().withColumn("snp_id", (F.row_number().over(Window.partitionBy("arm").orderBy("pos")) - 1).cast("long"))
        return snps.estimate_reference_bias(snps.segment_alleles(placed, breaks), self.settings.seed)

    @staticmethod
    def _last_draw(segments: DataFrame) -> DataFrame:
        """The draw of the highest likelihood of each arm."""
        best = segments.groupBy("arm").agg(F.min(F.struct((-F.col("loglik")).alias("o"), "draw"))["draw"].alias("draw"))
        return segments.join(best, ["arm", "draw"])

    def allelic_clusters(self) -> DataFrame:
        """(arm, seg_start, seg_end, segment, cluster, flipped, minor, major)."""

        def make() -> DataFrame:
            last = self._last_draw(self.chunked_segments()).select("arm", "seg_start", "seg_end", "major", "minor", (F.col("seg_end") - F.col("seg_start")).alias("n"))
            rows = ordered.row_ids(last, ["arm"], ["seg_start"], "segment").withColumn("sample", F.lit(1))
            prior = 1.0 if self.settings.exome else None
            drawn = dirichlet.allelic_clusters(rows, ["sample"], "segment", "minor", "major", "n", self.settings.cluster_sweeps, 5, self.settings.seed, prior)
            top = drawn.agg(F.min(F.struct((-F.col("loglik")).alias("o"), "draw"))["draw"]).first()[0]
            return rows.join(drawn.filter(F.col("draw") == F.lit(top)).select("segment", "cluster", "flipped"), "segment")

        return self._stage("allelic_clusters", make)

    def bins(self) -> DataFrame:
        """Coverage bins with segments, counts and scaled covariates."""

        def make() -> DataFrame:
            rows = coverage.clean_bins(readers.coverage_bed(self.spark, self.inputs.coverage))
            rows = genome_position(rows, chromosome_lengths(self.arms()), "start", "start_g")
            rows = coverage.fragment_lengths(rows)
            for name, path in self.inputs.tracks.items():
                rows = coverage.join_track(rows, readers.covariate_bed(self.spark, path, name), [f"C_{name}"])
            rows = ordered.row_ids(rows, ["chr"], ["start"], "bin_id")
            place = (F.row_number().over(Window.partitionBy("arm").orderBy("pos")) - 1).cast("long")
            sites = self.sites().withColumn("place", place)
            segs = self.allelic_clusters().select(F.col("arm").alias("__arm"), "seg_start", "seg_end", F.col("segment").alias("seg_idx"), "cluster", "flipped")
            met = intervals.point_in_interval(sites, segs.withColumnRenamed("__arm", "arm"), ["arm"], "place", "seg_start", "seg_end", 1000)
            own = met.withColumn("a", F.when(F.col("flipped"), F.col("maj_count")).otherwise(F.col("min_count"))).withColumn("b", F.when(F.col("flipped"), F.col("min_count")).otherwise(F.col("maj_count")))
            own = own.drop("min_count", "maj_count").withColumnRenamed("a", "min_count").withColumnRenamed("b", "maj_count")
            inside = coverage.site_bins(own, rows)
            out = coverage.assign_segments(rows, inside)
            extents = own.groupBy("chr", "seg_idx").agg(F.min("pos").alias("low"), (F.max("pos") + 1).alias("high"), F.min("cluster").alias("cluster"))
            out = coverage.fill_from_segments(out, extents).filter("seg_idx is not null")
            logged = ["C_frag_len", "C_frag_len11"]
            return coverage.filter_bins(coverage.scale_covariates(out, [f"C_{n}" for n in self.inputs.tracks], logged))

        return self._stage("bins", make)

    def coverage_fit(self) -> tuple[list[str], list[float], float]:
        """Covariates, their coefficients, and the exposure."""
        rows = self.bins()
        names = coverage.covariate_columns(rows)
        fit = regression.poisson_regression(rows, "allelic_cluster", "fragcorr", names)
        return names, fit.beta.tolist(), 0.0

    def coverage_segments(self) -> DataFrame:
        def make() -> DataFrame:
            names, beta, exposure = self.coverage_fit()
            drawn = coverage_mcmc.coverage_segments(self.bins(), ["seg_idx"], "start_g", "fragcorr", names, beta, exposure, self.settings.coverage_iterations, self.settings.coverage_draws, self.settings.seed)
            return coverage_mcmc.collect_segments(drawn, ["seg_idx"]).filter("best")

        return self._stage("coverage_segments", make)

    def _segment_bins(self) -> DataFrame:
        place = (F.row_number().over(Window.partitionBy("seg_idx").orderBy("start_g")) - 1).cast("long")
        segs = self.coverage_segments().select(F.col("seg_idx").alias("__s"), "seg_start", "seg_end", "seg_id", "mu", "log_sigma")
        rows = self.bins().withColumn("place", place)
        return rows.join(segs, (F.col("seg_idx") == F.col("__s")) & (F.col("place") >= F.col("seg_start")) & (F.col("place") < F.col("seg_end")))

    def segment_counts(self) -> DataFrame:
        """(seg_id, mu, sigma, a, b, bins): coverage and the counts of the
        minor and major allele of each segment."""

        def make() -> DataFrame:
            stats = self._segment_bins().groupBy("seg_id").agg(F.first("mu").alias("mu"), F.greatest(F.exp(F.first("log_sigma")), F.lit(1e-3)).alias("sigma"), F.sum("min_count").alias("a"), F.sum("maj_count").alias("b"), F.count(F.lit(1)).alias("bins"))
            return stats.fillna(0, ["a", "b"])

        return self._stage("segment_counts", make)

    def allelic_ratios(self) -> DataFrame:
        """(unit, seg_id, allele, n, mean, ssd, cluster, cluster_mean,
        cluster_sd): copy ratios of alleles, about one, and their clusters."""

        def make() -> DataFrame:
            both = copy_ratio.allele_rows(self.segment_counts()).withColumn("own", F.when(F.col("allele") < 0, F.col("a")).otherwise(F.col("b"))).withColumn("other", F.when(F.col("allele") < 0, F.col("b")).otherwise(F.col("a")))
            seen = copy_ratio.pseudo_observations(both.withColumn("sample", F.lit(1)).withColumnRenamed("seg_id", "segment"), ["sample"], self.settings.seed)
            unit = F.col("segment") * 2 + F.when(F.col("allele") > 0, 1).otherwise(0)
            scale = float(seen.agg(F.avg("mean")).first()[0] or 1.0)
            ready = seen.withColumn("unit", unit).withColumn("mean", F.col("mean") / scale).withColumn("ssd", F.col("ssd") / scale**2)
            fit = dirichlet.copy_ratio_clusters(ready, ["sample"], "unit", "n", "mean", "ssd", self.settings.ratio_iterations, self.settings.seed, alpha=2.0, beta=0.02)
            return ready.select("unit", F.col("segment").alias("seg_id"), "allele", "n", "mean", "ssd").join(fit.select("unit", "cluster", "cluster_mean", "cluster_sd"), "unit")

        return self._stage("allelic_ratios", make)

    def optimal_fit(self) -> DataFrame:
        """One row (purity, k, threshold, segments, clonal): the purity that
        explains the segments' allele counts by whole copies, the score above
        which a segment is clonal, and the copy ratio k of one copy among the
        clusters of clonal segments. With fewer than two segments purity, k
        and threshold are null and none is clonal."""

        def make() -> DataFrame:
            counts = self.segment_counts().filter("a + b > 0").select("seg_id", F.greatest("a", "b").alias("major"), F.least("a", "b").alias("minor"), "bins")
            total, kind = counts.count(), "purity double, k double, threshold double, segments long, clonal long"
            best = purity.fit_purity(counts, "major", "minor")
            if best is None:
                return self.spark.createDataFrame([(None, None, None, total, 0)], kind)
            scored = purity.scored_at(counts, "major", "minor", best)
            threshold = conversion.clonal_threshold(scored, "score", "bins")
            clonal = scored.filter(F.col("score") > F.lit(threshold)).select("seg_id")
            clusters = self.allelic_ratios().join(clonal, "seg_id", "left_semi").groupBy("cluster").agg(F.first("cluster_mean").alias("mean"), F.greatest(F.first("cluster_sd"), F.lit(1e-3)).alias("sd"), F.sum("n").alias("n"))
            k = purity.fit_scale(clusters, "mean", "sd", best, weight="n")
            return self.spark.createDataFrame([(best, k, threshold, total, clonal.count())], kind)

        return self._stage("optimal_fit", make)

    def segments(self) -> DataFrame:
        """Exported segments, rescaled to a mean of two copies."""

        def make() -> DataFrame:
            fit = self.allelic_ratios()
            side = lambda k, name: fit.filter(F.col("unit") % 2 == k).select("seg_id", F.col("cluster").alias(f"{name}_cluster"), F.col("cluster_mean").alias(f"mu_{name}"), F.col("cluster_sd").alias(f"sigma_{name}"))
            return copy_ratio.export_segments(self._segment_bins().select("chr", "start", "end", "seg_id").join(side(0, "minor"), "seg_id").join(side(1, "major"), "seg_id"))

        return self._stage("segments", make)

    def export(self, path: str) -> None:
        readers.write_segments(self.segments(), path)


