"""Round trips through the file formats (S1-S16, V3): rows of the test tables are written in a format below
the shared folder, read back by the reader of that format, and compared with the tables."""

from pyspark.sql import functions as F

from spotweave.operators import cohort as T
from spotweave.operators import enrichment as P
from spotweave.operators import qc as Q
from spotweave.operators import reads as R
from spotweave.plans.registry import query
from spotweave.session import fresh_path
from spotweave.sources import fastq, genomic, sinks, tables


def _lines(df, t, label, *columns, header=None):
    """Tab-separated text files, one per task; a header is a first line of every file."""
    path = fresh_path(t.spark, label)
    writer = df.select(*columns).write.option("sep", "\t").option("quote", "").option("escapeQuotes", "false")
    writer.option("header", bool(header)).csv(path)
    return path


@query(
    "read_fastq", "read_id:s mate:i gene:s sequence:s quality:s problem:s",
    """select concat(read_id, ':', substr(sequence, 17, 12)) as read_id, mate, substr(comment, 6) as gene, sequence, quality,
              case when length(sequence) <> length(quality) then 'length_mismatch' end as problem from {reads}""",
)
def read_fastq(t):
    path = fresh_path(t.spark, "fastq")
    fastq.write_fastq(R.extract_umis(t.reads, 12, "16B12M+T"), path)
    back = fastq.read_fastq(t.spark, path)
    return back.withColumns({"gene": fastq.gene_of(), "problem": R.format_problem()})


@query(
    "read_fastq_split", "reads:i bases:i distinct_reads:i",
    """select count(*) as reads, sum(length(sequence)) as bases, count(distinct (read_id, mate, quality)) as distinct_reads
       from {reads}""",
)
def read_fastq_split(t):
    path = fresh_path(t.spark, "fastq-plain")
    fastq.write_fastq(t.reads, path, name="read_id", compression="none")
    back = fastq.read_fastq(t.spark, path, split_bytes=1 << 20)
    return back.agg(
        F.count("*").alias("reads"), F.sum(F.length("sequence")).alias("bases"),
        F.count_distinct("read_id", "mate", "quality").alias("distinct_reads"),
    )


@query(
    "read_spot_table", "barcode:s n_reads:i mt_percent:d4 region:s",
    """select barcode, spot_id * 3 as n_reads, acctbal / 100 as mt_percent, region from {spots}""",
)
def read_spot_table(t):
    path = fresh_path(t.spark, "spots") + ".csv"
    out = t.spots.select("barcode", (F.col("spot_id") * 3).alias("n_reads"), (F.col("acctbal") / 100).alias("mt_percent"), "region")
    sinks.write_filtered(out, path, "csv")
    return tables.read_spot_table(t.spark, path)


@query(
    "read_expression", "spot_id:s gene:s count:i",
    """with s as (select distinct spot_id from {brand_expr}), g as (select distinct gene from {brand_expr})
       select cast(s.spot_id as varchar) as spot_id, g.gene, coalesce(sum(count), 0) as count
       from s cross join g left join {brand_expr} e on e.spot_id = s.spot_id and e.gene = g.gene group by s.spot_id, g.gene""",
)
def read_expression(t):
    from spotweave.operators.expression import to_wide

    genes = [f"Brand#{i}" for i in range(1, 26)]
    path = fresh_path(t.spark, "expression")
    wide = to_wide(t.brand_expr, genes).withColumn("spot_id", F.col("spot_id").cast("string"))
    wide.withColumns({"barcode": F.col("spot_id"), "region": F.lit("r")}).write.json(path)
    return tables.read_expression(t.spark, path, genes, lines=True)


@query(
    "read_coordinates", "barcode:s x:d4 y:d4",
    "select barcode, x * 0.5 as x, y * 0.5 as y from {spots}",
)
def read_coordinates(t):
    path, factors = fresh_path(t.spark, "positions") + ".csv", fresh_path(t.spark, "factors")
    t.spots.select("barcode", F.lit(1), F.lit(0), F.lit(0), "y", "x").write.csv(path)
    t.spark.range(1).select(F.lit('{"tissue_hires_scalef": 0.5}').alias("value")).write.text(factors)
    return tables.read_coordinates(t.spark, path, factors)


@query(
    "read_clinical", "patient_id:s survival_months:i response:s stage:s",
    "select patient_id, survival_months, response, stage from {clinical}",
)
def read_clinical(t):
    path = fresh_path(t.spark, "clinical")
    nested = t.clinical.select(
        F.col("patient_id").cast("string"), "survival_months", "response", F.col("sample_id").cast("string"),
        F.struct(F.lit("C50.9").alias("icd10"), F.lit("").alias("description"), "stage").alias("diagnosis"),
    )
    sinks.write_report(nested, path)
    return tables.read_clinical(t.spark, path, lines=True).select("patient_id", "survival_months", "response", "diagnosis.stage")


@query(
    "read_image_catalog", "image_id:s stain_type:s file_size_mb:d2",
    "select image_id, stain_type, file_size_mb from {images}",
)
def read_image_catalog(t):
    path = fresh_path(t.spark, "images")
    sinks.write_report(t.images, path)
    return tables.read_image_catalog(t.spark, path, lines=True)


@query(
    "read_annotations", "gene_name:s gene_id:s chromosome:s start_pos:i end_pos:i strand:s gene_type:s source:s",
    """select gene_name, gene_id, chromosome, start as start_pos, "end" as end_pos, strand, gene_type, source from {annotations}""",
)
def read_annotations(t):
    attributes = F.format_string('gene_id "%s"; gene_name "%s"; gene_type "%s";', "gene_id", "gene_name", "gene_type")
    path = _lines(
        t.annotations, t, "gtf", "chromosome", "source", F.lit("gene"), "start", "end", F.lit("."), "strand", F.lit("."), attributes
    )
    back = genomic.read_annotations(t.spark, path)
    return back.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query(
    "read_alignments", "total_reads:i uniquely_mapped:i multi_mapped:i unmapped:i",
    """with per_read as (select read_id, max(nh) as nh from {alignments} group by read_id)
       select count(*) as total_reads, count(*) filter (where nh = 1) as uniquely_mapped,
              count(*) filter (where nh > 1) as multi_mapped, count(*) filter (where nh = 0) as unmapped from per_read""",
)
def read_alignments(t):
    unmapped = F.col("nh") == 0
    path = _lines(
        t.alignments, t, "sam", "read_id", F.when(unmapped, 4).otherwise(0), F.lit("chr1"), F.lit(1), F.lit(255), F.lit("75M"),
        F.lit("*"), F.lit(0), F.lit(0), F.lit("A"), F.lit("I"), F.concat(F.lit("NH:i:"), F.col("nh").cast("string")), F.lit("HI:i:1"),
    )
    return R.alignment_stats(genomic.read_alignments(t.spark, path))


@query(
    "read_gene_sets", "pathway:s genes_in_pathway:i genes_overlapping:i",
    """select pathway, count(*) as genes_in_pathway,
              count(*) filter (where gene in (select gene from {gene_list})) as genes_overlapping from {gene_sets} group by pathway""",
)
def read_gene_sets(t):
    path = fresh_path(t.spark, "gmt")
    members = F.concat_ws("\t", F.collect_list(F.col("gene").cast("string")))
    t.gene_sets.groupBy("pathway").agg(members.alias("m")).select(
        F.concat_ws("\t", "pathway", F.lit("-"), "m").alias("value")
    ).write.text(path)
    sets = genomic.read_gene_sets(t.spark, path, "GO_BP")
    return P.pathway_overlap(t.gene_list.select(F.col("gene").cast("string").alias("gene")), sets)


@query(
    "read_mutations", "gene:s mutated_samples:i missense_share:d6 frameshift_share:d6",
    """select gene, count(distinct sample_id) as mutated_samples, avg((variant_class = 'missense')::int) as missense_share,
              avg((variant_class = 'frameshift')::int) as frameshift_share from {mutations} group by gene""",
)
def read_mutations(t):
    names = {"missense": "Missense_Mutation", "nonsense": "Nonsense_Mutation", "frameshift": "Frame_Shift_Del", "splice_site": "Splice_Site"}
    variant = F.element_at(F.create_map(*[F.lit(v) for p in names.items() for v in p]), F.col("variant_class"))
    path = _lines(
        t.mutations, t, "maf", F.col("gene").alias("Hugo_Symbol"), variant.alias("Variant_Classification"),
        F.col("sample_id").alias("Tumor_Sample_Barcode"), header=True,
    )
    # gene names hold '#', which only starts a comment at the beginning of a line
    return T.mutation_frequency(genomic.read_mutations(t.spark, path), t.samples)


@query(
    "read_cosmx", "fov:i cell_id:i count:i area:d1 vertices:i first_x:d4",
    """select cell_id % 25 as fov, cell_id, cell_id * 2 as count, area, 3 as vertices, x as first_x from {cells}""",
)
def read_cosmx(t):
    ids = [(F.col("cell_id") % 25).alias("fov"), F.col("cell_id")]
    write = lambda df, label: (p := fresh_path(t.spark, label), df.write.csv(p, header=True))[0]
    expression = write(t.cells.select(*ids, (F.col("cell_id") * 2).alias("EPCAM")), "cosmx-expr")
    metadata = write(t.cells.select(*ids, "area"), "cosmx-meta")
    corners = F.posexplode(F.array(*[F.struct((F.col("x") + d).alias("x"), (F.col("y") + e).alias("y")) for d, e in ((0, 0), (1, 0), (0, 1))]))
    polygons = write(t.cells.select(*ids, corners.alias("vertex", "p")).select("fov", "cell_id", "vertex", "p.x", "p.y"), "cosmx-poly")
    parts = tables.read_cosmx(t.spark, expression, metadata, polygons)
    joined = parts["expression"].join(parts["cells"], ["fov", "cell_id"]).join(parts["boundaries"], ["fov", "cell_id"])
    return joined.select(
        "fov", "cell_id", "count", "area", F.size("vertices").alias("vertices"), F.col("vertices")[0]["x"].alias("first_x")
    )


@query(
    "write_by_region", "region:s barcode_count:i",
    "select region, count(*) as barcode_count from {spots} group by region",
)
def write_by_region(t):
    path = fresh_path(t.spark, "regions")
    sinks.write_by_region(Q.split_by_region(t.spots), path)
    return Q.region_counts(t.spark.read.parquet(path))


@query(
    "write_filtered", "spot_id:i region:s",
    "select spot_id, region from {spots} where acctbal >= 0",
)
def write_filtered(t):
    path = fresh_path(t.spark, "filtered")
    sinks.write_filtered(t.spots.where("acctbal >= 0"), path)
    return t.spark.read.parquet(path)


@query("file_manifest", "file:s size_bytes:i md5:s")
def file_manifest(t):
    files = sinks.file_manifest(t.spark, t.sf_dir, "*.parquet")
    return files.withColumn("file", F.element_at(F.split("path", "/"), -1))


@query("check_files", "file:s problem:s")
def check_files(t):
    files = sinks.check_files(t.spark, t.sf_dir, [".PARQUET"], max_size=1_000_000)
    return files.withColumn("file", F.element_at(F.split("path", "/"), -1))
