"""FASTQ, UMI operators, file readers and sinks."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from spotweave.operators import reads as R
from spotweave.sources import fastq, genomic, sinks, tables


def write_reads(path, n, quality="I", length=36, opener=open):
    with opener(path, "wt") as f:
        for i in range(n):
            f.write(f"@READ{i:05d}\n{('ACGT' * length)[:length]}\n+\n{quality * length}\n")


@pytest.fixture()
def lanes(tmp_path):
    write_reads(tmp_path / "good.fastq", 100)
    write_reads(tmp_path / "good.fastq.gz", 100, opener=gzip.open)
    write_reads(tmp_path / "low.fastq", 50, quality="+")
    (tmp_path / "bad.fastq").write_text("@READ1\nACGT\nIIII\n")
    (tmp_path / "empty.fastq").write_text("")
    (tmp_path / "blank.fastq").write_text("@R\nACGT\n+\nIIII\n\n")
    (tmp_path / "mixed.fastq").write_text("@A/1 GENE:TP53\nACGT\n+\n@III\n@B/2\nACG\n+\nIIII\nC\nA\n+\nI\n@D\n\n+\n\n")
    return tmp_path


def test_validate_reads(spark, lanes):
    rows = {r.file.split("/")[-1]: r for r in R.validate_reads(fastq.read_fastq(spark, str(lanes))).collect()}
    for name in ("good.fastq", "good.fastq.gz"):
        assert (rows[name].valid, rows[name].total_reads, rows[name].avg_quality, rows[name].avg_read_length) == (True, 100, 40.0, 36.0)
    assert not rows["low.fastq"].valid and rows["low.fastq"].avg_quality == 10.0
    assert rows["low.fastq"].warnings == ["mean quality below threshold"]
    assert not rows["bad.fastq"].valid and not rows["blank.fastq"].valid
    assert "empty.fastq" not in rows
    strict = R.validate_reads(fastq.read_fastq(spark, str(lanes / "good.fastq")), 30).first()
    assert strict.valid


def test_format_errors_and_headers(spark, lanes):
    reads = fastq.read_fastq(spark, [str(lanes / f) for f in ("mixed.fastq", "bad.fastq", "blank.fastq")])
    problems = {(r.file.split("/")[-1], r.problem) for r in R.read_format_errors(reads).collect()}
    assert problems == {
        ("mixed.fastq", "length_mismatch"), ("mixed.fastq", "bad_header"), ("mixed.fastq", "empty_record"),
        ("bad.fastq", "truncated"), ("blank.fastq", "bad_header"),
    }
    first = reads.where("read_id = 'A'").withColumn("gene", fastq.gene_of()).first()
    assert (first.mate, first.comment, first.gene, first.quality) == (1, "GENE:TP53", "TP53", "@III")


def test_splits_cut_between_records(spark, tmp_path):
    path = tmp_path / "big.fastq"
    with open(path, "w") as f:
        for i in range(400):
            f.write(f"@R{i}/1\nACGTACGT\n+\n@{'I' * 7}\n")
    whole = fastq.read_fastq(spark, str(path))
    split = fastq.read_fastq(spark, str(path), split_bytes=777)
    assert split.rdd.getNumPartitions() > 5
    assert sorted(split.collect()) == sorted(whole.collect())
    assert [r.read_id for r in R.sample_reads(split, 3).orderBy("pos").collect()] == ["R0", "R1", "R2"]


def test_umis(spark):
    rows = [("f", i, f"r{i}", s, "I" * len(s)) for i, s in enumerate(["A" * 16 + "C" * 12 + "TTTT", "A" * 16 + "C" * 12 + "GG", "ACGT"])]
    reads = spark.createDataFrame(rows, "file string, pos long, read_id string, sequence string, quality string")
    tagged = R.extract_umis(reads, 12, "16M12M+T")
    got = [tuple(r) for r in tagged.select("barcode", "umi", "template", "read_name").orderBy("pos").collect()]
    assert got[0] == ("A" * 16, "C" * 12, "TTTT", "r0:" + "C" * 12)
    assert got[2][:3] == (None, None, None)
    assert R.umi_stats(tagged).first().umi_count == 1
    assert R.umi_extraction_rate(reads).first().extraction_rate == pytest.approx(2 / 3)
    for bad in (3, 21):
        with pytest.raises(ValueError):
            R.extract_umis(reads, bad)
    with pytest.raises(ValueError):
        R.parse_read_structure("12M+T4B")
    assert R.parse_read_structure("12M+T") == [("M", 1, 12), ("T", 13, None)]


def test_molecule_counts(spark):
    rows = [("b1", "g1", "u1"), ("b1", "g1", "u1"), ("b1", "g1", "u2"), ("b2", "g1", "u1"), ("b2", "g2", None)]
    tagged = spark.createDataFrame(rows, "barcode string, gene string, umi string")
    assert {tuple(r) for r in R.count_umis(tagged).collect()} == {("b1", "g1", 2), ("b2", "g1", 1), ("b2", "g2", 0)}
    dup = R.umi_duplication_rate(tagged).first()
    assert (dup.reads, dup.molecules, dup.passed) == (5, 4, False)
    spots = spark.createDataFrame([("b1",), ("b1",), ("b9",)], "barcode string")
    match = R.match_barcodes(tagged, spots).first()
    assert (match.reads, match.matched_reads, match.passed) == (5, 3, False)
    assert [tuple(r) for r in R.barcode_mismatches(tagged, spots).collect()] == [("b2", 2)]
    assert R.match_barcodes(tagged.limit(0), spots).first().match_rate == 0.0


def test_alignment_rates(spark, tmp_path):
    sam = tmp_path / "a.sam"
    line = "{}\t{}\tchr1\t1\t255\t4M\t*\t0\t0\tACGT\tIIII{}\n"
    sam.write_text(
        "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:10\n" + line.format("@r1", 0, "\tNH:i:1\tHI:i:1\tnM:i:2\tMD:Z:4")
        + line.format("r2", 0, "\tNH:i:2") + line.format("r2", 256, "\tNH:i:2") + line.format("r3", 4, "")
    )
    rows = genomic.read_alignments(spark, str(sam))
    assert {(r.read_id, r.nh) for r in rows.collect()} == {("@r1", 1), ("r2", 2), ("r3", 0)}
    assert rows.where("read_id = '@r1'").first().md == "4"
    got = R.alignment_stats(rows).first()
    assert (got.total_reads, got.uniquely_mapped, got.multi_mapped, got.unmapped) == (3, 1, 1, 1)
    assert got.alignment_rate == pytest.approx(2 / 3) and got.unique_mapping_rate == pytest.approx(1 / 3)


def test_spot_tables(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("barcode,n_reads,n_genes,mt_percent,extra\nx,10,5,NaN,e\n")
    b.write_text("barcode,n_reads,n_genes,mt_percent\ny,20,6,1.5\n")
    rows = {r.barcode: r for r in tables.read_spot_table(spark, [str(a), str(b)]).collect()}
    assert rows["x"].mt_percent is None and rows["x"].extra == "e"
    assert rows["y"].extra is None and rows["y"].n_reads == 20
    with pytest.raises(ValueError, match="unsupported"):
        tables.read_spot_table(spark, str(tmp_path / "a.h5"))
    assert tables.read_spot_table(spark, [str(a), str(tmp_path / "c.h5")], skip_others=True).count() == 1


def test_json_readers(spark, tmp_path):
    (tmp_path / "expr.json").write_text(json.dumps([{"spot_id": "S1", "barcode": "B", "region": "tumor", "TP53": 3, "KRT7": 0}]))
    for genes in (None, ["KRT7", "TP53"]):
        got = tables.read_expression(spark, str(tmp_path / "expr.json"), genes)
        assert {(r.gene, r["count"]) for r in got.collect()} == {("TP53", 3), ("KRT7", 0)}
    (tmp_path / "clin.json").write_text(json.dumps([{"patient_id": "P1", "age": 5, "diagnosis": {"icd10": "C50.9", "stage": "II"}, "survival_months": None}]))
    row = tables.read_clinical(spark, str(tmp_path / "clin.json")).first()
    assert row.diagnosis.stage == "II" and row.survival_months is None
    (tmp_path / "pos.csv").write_text("AAA,1,0,0,10,20\n")
    (tmp_path / "scale.json").write_text('{"tissue_hires_scalef": 0.5}')
    row = tables.read_coordinates(spark, str(tmp_path / "pos.csv"), str(tmp_path / "scale.json")).first()
    assert (row.x, row.y) == (10.0, 5.0)


def test_genomic_readers(spark, tmp_path):
    gtf = tmp_path / "g.gtf"
    gtf.write_text('#!header\nchr17\tHAVANA\tgene\t7661779\t7687550\t.\t-\t.\tgene_id "ENSG1"; gene_type "protein_coding"; gene_name "TP53";\n'
                   'chr17\tHAVANA\texon\t1\t2\t.\t-\t.\tgene_id "ENSG1";\n')
    row = genomic.read_annotations(spark, str(gtf), genome="hg38").collect()
    assert len(row) == 1 and (row[0].gene_name, row[0].gene_type, row[0].start, row[0].strand) == ("TP53", "protein_coding", 7661779, "-")
    gff = tmp_path / "g.gff3"
    gff.write_text("chr1\tx\tgene\t1\t9\t.\t+\t.\tID=gene1;Name=ABC;biotype=lncRNA\n")
    row = genomic.read_annotations(spark, str(gff), "gff3").first()
    assert (row.gene_name, row.gene_id, row.gene_type) == ("ABC", "gene1", "lncRNA")
    gmt = tmp_path / "s.gmt"
    gmt.write_text("P1\tdesc\tA\tB\nEMPTY\tdesc\n")
    assert {(r.pathway, r.gene) for r in genomic.read_gene_sets(spark, str(gmt)).collect()} == {("P1", "A"), ("P1", "B")}
    maf = tmp_path / "m.maf"
    maf.write_text("#version\nHugo_Symbol\tVariant_Classification\tTumor_Sample_Barcode\nTP53\tFrame_Shift_Ins\tS1\nTP53\tSilent\tS2\n")
    assert {(r.sample_id, r.variant_class) for r in genomic.read_mutations(spark, str(maf)).collect()} == {("S1", "frameshift"), ("S2", "other")}


def test_sinks_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", "r1"), ("b", "r2"), ("c", None)], "barcode string, region string")
    sinks.write_by_region(df, str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"region=r1", "region=r2", "region=__HIVE_DEFAULT_PARTITION__"}
    assert spark.read.parquet(str(tmp_path / "by")).where("region is null").count() == 1
    sinks.write_filtered(df, str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    data = tmp_path / "files"
    data.mkdir()
    (data / "x.fastq").write_bytes(b"hello")
    (data / "y.TXT").write_bytes(b"0123456789")
    rows = {r.path.split("/")[-1]: r for r in sinks.file_manifest(spark, str(data)).collect()}
    assert rows["x.fastq"].md5 == hashlib.md5(b"hello").hexdigest() and rows["y.TXT"].size_bytes == 10
    checked = {r.path.split("/")[-1]: r.problem for r in sinks.check_files(spark, str(data), [".FASTQ", ".txt"], max_size=5).collect()}
    assert checked == {"x.fastq": None, "y.TXT": "too_large"}
    assert {r.problem for r in sinks.check_files(spark, str(data), [".bam"]).collect()} == {"bad_extension"}
    with pytest.raises(ValueError):
        sinks.check_files(spark, "/data/../etc")


def test_quality_and_composition(spark):
    reads = spark.createDataFrame([(1, "GGAT", "II+5"), (1, "CCNN", "IIII"), (2, "", "")], "mate int, sequence string, quality string")
    got = {r.mate: r for r in R.read_composition(reads).collect()}
    assert got[1].gc_percent == pytest.approx(50.0) and got[1].mean_length == 4.0
    assert got[1].mean_quality == pytest.approx(((40 + 40 + 10 + 20) / 4 + 40) / 2)
    assert {(r.mean_phred, r.reads) for r in R.quality_histogram(reads).collect()} == {(27, 1), (40, 1), (None, 1)}
    assert reads.agg(F.sum(R.quality_sum())).first()[0] == 110 + 160
