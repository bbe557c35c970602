import pytest
from pyspark.sql import functions as F

from strandline.operators import conversion as c
from strandline.operators import copy_ratio, coverage, purity, snps
from strandline.sources.registry import ReferenceFiles


def test_counts_of_other_tools(spark):
    normal = spark.createDataFrame([(1, 5, "A", "C", 20, 10), (1, 9, "G", "T", 3, 4)], "chr int, pos long, ref string, alt string, ref_count long, alt_count long")
    tumour = spark.createDataFrame([(1, 5, 7.6, 8.2)], "chr int, pos long, ref_count double, alt_count double")
    rows = {r.Position: (r.File1R, r.File1A, r.File2R, r.File2A, r.File2E) for r in c.pileup_counts(tumour, normal).collect()}
    assert rows == {5: (20, 10, 8, 8, 0), 9: (3, 4, 0, 0, 0)}
    sites = normal.select("chr", "pos", F.lit(3).alias("bin_id"))
    bins = spark.createDataFrame([(3, 12.0)], "bin_id int, depth double")
    assert sorted((r.pos, r.ref_count, r.alt_count) for r in c.refilled_counts(sites, tumour, bins).collect()) == [(5, 7.6, 8.2), (9, 12.0, 0.0)]
    header = spark.createDataFrame([("@HD",), ("@SQ",)], "value string").coalesce(1)
    lines = [r.value for r in c.allelic_count_table(normal.union(normal), header).collect()]
    assert lines[:2] == ["@HD", "@SQ"] and lines[2].startswith("CONTIG") and lines[3:] == ["1\t5\t20\t10\tA\tC", "1\t9\t3\t4\tG\tT"]
    assert c.known_sites(normal, sites.union(sites)).count() == 2
    flat = c.dummy_normal(sites.select("chr", "pos"), seed=4).collect()
    assert all(r.ref_count + r.alt_count == 30 for r in flat)
    calls = spark.createDataFrame([("A", "C", "0|1"), ("AT", "C", "0|1"), ("A", "C", "1|1")], "ref string, alt string, hap string")
    assert c.substitutions(calls).count() == 1


def test_intervals_and_counts(spark):
    marks = spark.createDataFrame([(1, 0), (1, 50), (2, 10)], "chr int, threshold long")
    lengths = spark.createDataFrame([(1, 80), (2, 30)], "chr int, length long")
    spans = c.threshold_intervals(marks, lengths)
    assert sorted(map(tuple, spans.collect())) == [(1, 0, 50), (1, 50, 80), (2, 10, 30)]
    totals = spark.createDataFrame([(1, 0, 7), (1, 1, 8), (2, 0, 9)], "chr int, k int, reads long")
    assert sorted((r.chr, r.start, r.reads) for r in c.interval_totals(spans, totals).collect()) == [(1, 0, 7), (1, 50, 8), (2, 10, 9)]
    meta = spark.createDataFrame([("1", 0, 9, 1.0)], "contig string, start long, end long, count double")
    assert c.replaced_counts(meta, meta.withColumn("count", F.lit(5.0))).first()["count"] == 5.0
    with pytest.raises(Exception, match="no count"):
        c.replaced_counts(meta, meta.filter("start > 0")).collect()
    assert c.without_contigs(meta, ["1"]).count() == 0
    assert c.sample_totals(spark.createDataFrame([("a", 1), ("a", 2)], "sample string, reads long")).first().reads == 3


def test_thresholds_and_results(spark):
    bent = spark.createDataFrame([(float(k), 10.0 if k < 3 else 0.1) for k in range(20)], "s double, w double")
    assert c.clonal_threshold(bent, "s", "w") == 2.0
    flat = spark.createDataFrame([(float(k), 1.0) for k in range(101)], "s double, w double")
    assert c.clonal_threshold(flat, "s", "w") == 50.0
    assert c.clonal_threshold(flat.filter("s < 0"), "s", "w") is None
    res = spark.createDataFrame([("x_0.3_a/plain.tsv", 0.2), ("y_0.3_a/plain.tsv", 0.4)], "path string, mad_score double")
    assert tuple(c.best_of_results(res).first()) == (0.3, "plain", pytest.approx(0.3), 2)


def test_purity_pieces(spark):
    row = spark.range(1).select(purity.imbalance(F.lit(0.5), F.lit(2.0), F.lit(3.0)).alias("a"), purity.subclone_imbalance(F.lit(0.5), F.lit(0.0), F.lit(2.0), F.lit(3.0), F.lit(1.0), F.lit(2.0)).alias("b"), purity.copy_number(F.lit(2.2), F.lit(1.0)).alias("n")).first()
    assert row.a == pytest.approx(1.5 / 2.5) and row.b == pytest.approx(row.a) and row.n == 2.0
    assert (1, 1) in purity.levels() and all(2 * na >= t for na, t in purity.levels())
    segs = spark.createDataFrame([(150, 100), (101, 99)], "a long, b long")
    comb = purity.purity_comb(segs, "a", "b", points=50).collect()
    assert len(comb) == 50 and all(r.score is not None for r in comb)


def test_segment_helpers(spark):
    bins = spark.createDataFrame([(1, 0, 5.0, 3.0), (1, 0, 7.0, 3.0)] + [(2, 0, 1.0, 1.0)] * 12, "seg_idx int, allelic_cluster int, min_count double, maj_count double")
    out = {(r.seg_idx, round(r.min_count, 3)) for r in coverage.fallback_counts(bins).collect()}
    assert out == {(1, round(24 / 14, 3)), (2, 1.0)}
    assert copy_ratio.allele_rows(bins).count() == 28
    a = spark.createDataFrame([(1, 4), (1, 9)], "s int, cluster int")
    merged = copy_ratio.merge_classes(a, a, ["s"], "cluster").collect()
    assert sorted((r.cluster, r.subclonal) for r in merged) == [(0, False), (1, False), (2, True), (3, True)]
    biased = snps.apply_reference_bias(spark.createDataFrame([(10.0, 5.0, 1, 0, True), (0.0, 6.0, 0, 1, True)], "ref_count double, alt_count double, allele_a int, allele_b int, phased boolean"), 0.5).collect()
    assert [(r.maj_count, r.min_count) for r in biased] == [(5.0, 5.0), (0.0, 12.0)]


def test_reference_bias_is_found(spark):
    rows = []
    for seg in range(6):
        for allele in (0, 1):
            rows.append((seg, allele, 4000 / 0.9, 4000.0, 50))
    got = snps.estimate_reference_bias(spark.createDataFrame(rows, "segment long, allele int, ref double, alt double, n_snp long"), seed=3)
    assert got == pytest.approx(0.9, abs=0.02)


def test_registry(spark, tmp_path):
    files = ReferenceFiles.of(str(tmp_path), "hg38")
    assert "cytoband" in files.missing(spark)
    (tmp_path / "c").write_text("x")
    own = files.overridden('{"cytoband": "%s", "faire": null}' % (tmp_path / "c"))
    assert "cytoband" not in own.missing(spark) and "faire" not in own.missing(spark)
    with pytest.raises(ValueError, match="unknown"):
        files.overridden('{"other": 1}')
    with pytest.raises(ValueError, match="build"):
        ReferenceFiles.of("x", "hg17")
