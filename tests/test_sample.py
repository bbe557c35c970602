"""A planted sample from files to segments, and the readers on the way."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.__main__ import main
from strandline.functions import genome
from strandline.operators import copy_ratio, coverage, intervals, purity, scoring, snps
from strandline.plans.sample import Inputs, Run, Settings
from strandline.sources import readers
from strandline.streaming import ingest

LENGTHS = {1: 400_000, 2: 300_000}
CUT = {1: 150_000, 2: 140_000}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Chromosome 1 has one copy more of a haplotype from 250,000 on."""
    rng = np.random.default_rng(8)
    folder = tmp_path_factory.mktemp("sample")
    bands, calls, counts, bins, track = [], ["#header"], ["CONTIG\tPOSITION\tREF_COUNT\tALT_COUNT"], [], []
    for c, n in LENGTHS.items():
        bands += [f"chr{c}\t0\t{CUT[c] - 10_000}\tp1\tgneg", f"chr{c}\t{CUT[c] - 10_000}\t{CUT[c]}\tp0\tacen", f"chr{c}\t{CUT[c]}\t{n}\tq1\tgneg"]
        for pos in range(500, n, 1500):
            high = c == 1 and pos >= 250_000
            depth = rng.poisson(90 if high else 60) + 1
            a_alt = rng.random() < 0.5
            a = rng.binomial(depth, 2 / 3 if high else 0.5)
            alt = a if a_alt else depth - a
            calls.append(f"chr{c}\t{pos}\t.\tA\tC\t.\t.\t.\t.\t{'1|0' if a_alt else '0|1'}")
            counts.append(f"chr{c}\t{pos}\t{depth - alt}\t{alt}")
        for s in range(0, n, 2000):
            high = c == 1 and s >= 250_000
            signal = rng.normal()
            x = rng.poisson(np.exp(np.log(60 if high else 40) + 0.1 * signal + rng.normal(0, 0.05)))
            bins.append(f"chr{c}\t{s}\t{s + 2000}\t{x * 150}\t{150 + rng.normal():.3f}\t20\t{x}\t{2 * x}\t{rng.binomial(2 * x, 0.02)}")
            track.append(f"chr{c}\t{s}\t{s + 2000}\t{signal:.4f}")
    calls.append("chr1\t777\t.\tA\tC\t.\t.\t.\t.\t1|1")
    bins.append("chrUn\t0\t2000\t6000\t150\t20\t40\t80\t1")
    for name, lines in dict(bands=["chr\tstart\tend\tband\tstain", *bands], calls=calls, counts=counts, bins=bins, track=track).items():
        (folder / name).write_text("\n".join(lines) + "\n")
    return folder


def test_readers_and_arms(spark, files):
    arms = snps.chromosome_arms(readers.cytoband(spark, str(files / "bands"))).orderBy("arm").collect()
    assert [(r.chr, r.start, r.end, r.arm) for r in arms] == [(1, 0, 140_000 + 10_000, 0), (1, 150_000, 400_000, 1), (2, 0, 140_000, 2), (2, 140_000, 300_000, 3)]
    calls = readers.phased_vcf(spark, str(files / "calls"))
    assert "x" not in calls.columns and calls.filter("hap = '1|1'").count() == 1
    sites = snps.load_sites(calls, readers.allele_counts(spark, str(files / "counts")), spark.createDataFrame(arms))
    assert sites.count() == sum(len(range(500, n, 1500)) for n in LENGTHS.values())
    ids = [r[0] for r in sites.orderBy("chr", "pos").select("snp_id").collect()]
    assert ids == list(range(len(ids)))
    bad = files / "short"
    bad.write_text("chr1\t0\t10\n")
    with pytest.raises(Exception, match="nine fields"):
        readers.coverage_bed(spark, str(bad)).collect()
    ci = snps.credible_interval(sites.limit(20)).collect()
    assert all(r.ci_lo < r.median < r.ci_hi for r in ci)


def test_run_recovers_the_planted_gain(spark, files, tmp_path):
    inputs = Inputs(calls=str(files / "calls"), tumour_counts=str(files / "counts"), coverage=str(files / "bins"), cytoband=str(files / "bands"), tracks={"RT": str(files / "track")})
    settings = Settings(allelic_iterations=1500, allelic_draws=4, cluster_sweeps=12, coverage_iterations=30, coverage_draws=2, ratio_iterations=800)
    run = Run(spark, inputs, str(tmp_path / "run"), settings)
    segments = run.segments().orderBy("chr", "start_bp").collect()
    assert all(a.chr != b.chr or a.end_bp <= b.start_bp for a, b in zip(segments, segments[1:]))
    weigh = lambda rows, c: sum((r.end_bp - r.start_bp) * (r.mu_major + r.mu_minor) for r in rows) / c
    assert weigh(segments, sum(r.end_bp - r.start_bp for r in segments)) == pytest.approx(2, abs=1e-6)
    gain = [r for r in segments if r.chr == 1 and r.start_bp >= 240_000]
    rest = [r for r in segments if r.chr == 2]
    ratio = weigh(gain, sum(r.end_bp - r.start_bp for r in gain)) / weigh(rest, sum(r.end_bp - r.start_bp for r in rest))
    assert ratio == pytest.approx(1.5, abs=0.15)
    assert 0.9 < run.reference_bias() < 1.1
    fit = run.optimal_fit().first()
    assert 0 < fit.purity < 1 and fit.k > 0 and 0 <= fit.clonal <= fit.segments
    # two thirds of the gain's reads are of one haplotype: a level of the purity found
    seen = [(1 + fit.purity * (na - 1)) / (2 * (1 - fit.purity) + t * fit.purity) for na, t in purity.levels()]
    assert min(abs(x - 2 / 3) for x in seen) < 0.03
    names, beta, _ = run.coverage_fit()
    assert dict(zip(names, beta))["C_RT_z"] == pytest.approx(0.1, abs=0.03)
    (tmp_path / "config.json").write_text(json.dumps({"inputs": inputs.__dict__, "settings": settings.__dict__}))
    assert main(["run", "--config", str(tmp_path / "config.json"), "--folder", str(tmp_path / "run"), "--export", str(tmp_path / "out")]) == 0
    assert readers.read_segments(spark, str(tmp_path / "out")).count() == len(segments)
    wide = copy_ratio.absolute_segments(run.segments().withColumn("n_hets", F.lit(1)))
    readers.write_segments(wide, str(tmp_path / "wide"), readers.ABSOLUTE_COLUMNS)
    assert readers.read_segments(spark, str(tmp_path / "wide"), readers.ABSOLUTE_COLUMNS).columns == list(readers.ABSOLUTE_COLUMNS)


def test_coordinates(spark):
    names = spark.createDataFrame([("chr1",), ("X",), ("chrY",), ("23",), ("MT",), ("chrUn_1",)], "n string")
    assert [r[0] for r in names.select(genome.chromosome_number(F.col("n"))).collect()] == [1, 23, 24, 23, 0, 0]
    arms = spark.createDataFrame([(1, 0, 100), (1, 100, 250), (2, 0, 50)], "chr int, start long, end long")
    lengths = genome.chromosome_lengths(arms)
    points = spark.createDataFrame([(1, 7), (2, 9)], "chr int, at long")
    placed = genome.genome_position(points, lengths, "at", "g")
    assert sorted(r.g for r in placed.collect()) == [7, 259]
    back = genome.chromosome_position(placed.select("g"), lengths, "g").select("chr", "pos").collect()
    assert sorted(map(tuple, back)) == [(1, 7), (2, 9)]


def test_gc_and_fasta(spark, tmp_path):
    (tmp_path / "c.fa").write_text(">chr3\n" + "\n".join(["ACGTG", "GGCCA", "TTTTT", "CG"]) + "\n")
    pieces = readers.fasta_pieces(spark, str(tmp_path / "c.fa"), width=4)
    assert "".join(r.bases for r in pieces.orderBy("at").collect()) == "ACGTGGGCCATTTTTCG"
    bins = spark.createDataFrame([(3, 0, 4), (3, 3, 9), (3, 15, 16)], "chr int, start long, end long")
    got = {(r.start, r.end): r.C_GC for r in readers.gc_content(bins, pieces).collect()}
    text = "ACGTGGGCCATTTTTCG"
    assert got == {(s, e): pytest.approx(sum(x in "GC" for x in text[s : e + 1]) / (e + 1 - s)) for s, e in ((0, 4), (3, 9), (15, 16))}


def test_clean_bins_edges(spark):
    rows = [("chr1", k * 10, k * 10 + 10, 30.0, 10.0, 1.0, 3, 10, 0) for k in range(20)] + [("chrM", 0, 10, 30.0, 10.0, 1.0, 3, 10, 0), ("chr1", 900, 910, 30.0, 10.0, 1.0, 3, 10, 10), ("chr1", 990, 999, 30.0, 10.0, 1.0, 0, 10, 0)]
    got = coverage.clean_bins(spark.createDataFrame(rows, readers.COVERAGE_SCHEMA))
    assert got.count() == 20 and got.agg(F.max("fragcorr")).first()[0] == 3.0
    none = coverage.scale_covariates(got.withColumn("C_A", F.lit(None).cast("double")).withColumn("C_B", F.col("start").cast("double")), ["C_A", "C_B"], [])
    assert coverage.covariate_columns(none) == ["C_B_z"]


def test_selection_of_heterozygous_calls(spark):
    rows = [("1", k, "A", "C", 100, 0, 40, 40, a, b) for k, (a, b) in enumerate([(50, 50), (90, 5), (2, 1), (55, 48)])]
    calls = spark.createDataFrame(rows, "chr string, pos long, ref string, alt string, total_reads long, mapq0_reads long, t_refcount long, t_altcount long, n_refcount long, n_altcount long")
    assert sorted(r.pos for r in snps.heterozygous_calls(calls).collect()) == [0, 3]
    assert snps.quality_calls(calls.withColumn("total_reads", F.lit(200))).count() == 2
    assert [round(r[0], 2) for r in calls.select(snps.hom_mass("n_altcount", "n_refcount")).collect()][0] == 0.0


def test_simulation_and_scoring(spark):
    truth = scoring.random_profile(spark, {1: 1_000_000, 2: 800_000}, 6, seed=3)
    assert scoring.compare(truth, truth).first().mad_score == pytest.approx(0, abs=0.05)
    sites = spark.createDataFrame([(1, p, p % 2 == 0) for p in range(1000, 900_000, 9000)], "chr int, pos long, aidx boolean")
    sim = scoring.simulated_sites(sites, truth, 0.7, 60, seed=1)
    again = scoring.simulated_sites(sites.repartition(3), truth, 0.7, 60, seed=1)
    assert sorted(map(tuple, sim.collect())) == sorted(map(tuple, again.collect())) and sim.count() == sites.count()
    baf = scoring.log_ratio_and_baf(sim.select("chr", "pos", "ref_count", "alt_count"), sim.select("chr", "pos", F.lit(30).alias("ref_count"), F.lit(30).alias("alt_count")), seed=2)
    assert abs(baf.agg(F.avg("log_r")).first()[0]) < 1e-9
    rows = spark.createDataFrame([(1, 0, 10, 0.0, 0.5), (1, 10, 20, 1.0, 0.25)], "chr int, start_bp long, end_bp long, log_ratio double, maf double")
    got = scoring.from_log_ratio(rows).orderBy("start_bp").collect()
    assert [(r.mu_major, r.mu_minor) for r in got] == [(1.0, 1.0), (3.0, 1.0)]
    bins = spark.createDataFrame([(1, 0, 5, 7), (1, 5, 9, 7), (1, 9, 12, 8)], "chr int, start long, end long, cluster int")
    copies = spark.createDataFrame([(7, 2, 1), (8, 1, 1)], "cluster int, n_major int, n_minor int")
    assert sorted((r.start_bp, r.end_bp, r.mu_major) for r in scoring.from_bins(bins, copies).collect()) == [(0, 9, 2.0), (9, 12, 1.0)]
    assert intervals.bucket_of(F.lit(5), 2) is not None


def test_stream_of_shards(spark, files, tmp_path):
    shards = tmp_path / "shards"
    shards.mkdir()
    rows = (files / "bins").read_text().splitlines()[:-1]
    for k in range(3):
        (shards / f"s{k}").write_text("\n".join(rows[k::3]) + "\n")
    (shards / "again").write_text("\n".join(rows[:10]) + "\n")
    query = ingest.start(spark, str(shards), "totals", str(tmp_path / "mark"), width=100_000)
    query.awaitTermination(120)
    got = spark.table("totals").agg(F.sum("bins"), F.sum("tot_reads")).first()
    assert got[0] == len(rows) and got[1] == sum(int(r.split("\t")[7]) for r in rows)
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0)], "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.n, r.total) for r in ingest.windowed_counts(events, "ts", "k", "v").collect()) == [(1, 4.0), (2, 3.0)]
