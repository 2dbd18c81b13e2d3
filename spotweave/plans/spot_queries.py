"""Spot QC, expression and spatial queries."""

from pyspark.sql import functions as F

from spotweave.operators import expression as E
from spotweave.operators import permutation as P
from spotweave.operators import qc as Q
from spotweave.operators import spatial as A
from spotweave.plans.registry import normal_p_sql, query
from spotweave.session import materialize

# thresholds that suit the test tables: orders of magnitude fewer genes per spot than a real slide
BOUNDS = dict(min_reads=800, min_genes=30, max_mt_percent=15.0)

_METRICS = """
    per_gene as (select spot_id, gene, sum(count) as count from {expr} group by spot_id, gene),
    metrics as (select spot_id, sum(count) as n_reads, count(*) filter (where count > 0) as n_genes,
                       100.0 * sum(case when starts_with(gene, 'MT-') then count else 0 end) / sum(count) as mt_percent
                from per_gene group by spot_id)"""
_PASS = "n_reads >= 800 and n_genes >= 30 and mt_percent <= 15"
_SUMMARY = f"""count(*) as spots_before, count(*) filter (where {_PASS}) as spots_after,
    coalesce(max(n_genes) filter (where {_PASS}), 0) as genes_detected,
    coalesce(avg(n_reads) filter (where {_PASS}), 0) as mean_reads_per_spot,
    coalesce(median(n_genes) filter (where {_PASS}), 0) as median_genes_per_spot,
    coalesce(avg(mt_percent) filter (where {_PASS}), 0) as mean_mt_percent,
    count(*) filter (where {_PASS}) / count(*) as filtering_rate"""
_SUMMARY_COLUMNS = (
    "spots_before:i spots_after:i genes_detected:i mean_reads_per_spot:d4 median_genes_per_spot:d2 "
    "mean_mt_percent:d6 filtering_rate:d6"
)


@query("spot_metrics", "spot_id:i n_reads:i n_genes:i mt_percent:d6", f"with {_METRICS} select * from metrics")
def spot_metrics(t):
    return Q.spot_metrics(t.expr)


@query(
    "filter_quality", "spot_id:i n_reads:i n_genes:i mt_percent:d6",
    f"with {_METRICS} select * from metrics where {_PASS}",
)
def filter_quality(t):
    return Q.filter_quality(Q.spot_metrics(t.expr), **BOUNDS)


@query("qc_summary", _SUMMARY_COLUMNS, f"with {_METRICS} select {_SUMMARY} from metrics")
def qc_summary(t):
    return Q.qc_summary(Q.spot_metrics(t.expr), **BOUNDS)


@query(
    "qc_summary_by_region", f"region:s {_SUMMARY_COLUMNS}",
    f"with {_METRICS} select region, {_SUMMARY} from metrics join {{spots}} using (spot_id) group by region",
)
def qc_summary_by_region(t):
    metrics = Q.spot_metrics(t.expr).join(t.spots.select("spot_id", "region"), "spot_id")
    return Q.qc_summary(metrics, **BOUNDS, by=["region"])


@query(
    "split_by_region", "spot_id:i region:s",
    "select spot_id, region from {spots} where region in ('HOUSEHOLD', 'MACHINERY')",
)
def split_by_region(t):
    return Q.split_by_region(t.spots, ["HOUSEHOLD", "MACHINERY"])


@query(
    "grid_regions", "spot_id:i region:s",
    """with s as (select spot_id, x, min(x) over () as lo, max(x) over () as hi from {spots})
       select spot_id, concat('region_', cast(greatest(least(ceil((x - lo) * 4 / (hi - lo)) - 1, 3), 0) as bigint)) as region
       from s""",
)
def grid_regions(t):
    return Q.split_by_region(t.spots.drop("region"), num_regions=4, x="x")


@query(
    "roi_regions", "spot_id:i roi_id:s",
    "select spot_id, roi_id from {spots} join {rois} on x between x1 and x2 and y between y1 and y2",
)
def roi_regions(t):
    return Q.roi_regions(t.spots, t.rois)


@query(
    "region_stats", "total_regions:i mean_per_region:i min_per_region:i max_per_region:i",
    """with c as (select region, count(*) as n from {spots} group by region)
       select count(*) as total_regions, floor(avg(n)) as mean_per_region, min(n) as min_per_region,
              max(n) as max_per_region from c""",
)
def region_stats(t):
    return Q.region_stats(t.spots)


@query(
    "region_distribution", "region:s spots:i percent:d6",
    """select region, count(*) as spots, 100.0 * count(*) / (select count(*) from {spots}) as percent
       from {spots} group by region""",
)
def region_distribution(t):
    return Q.region_distribution(t.spots)


@query(
    "merge_tiles_average", "barcode:s value:d6 note:s",
    "select barcode, avg(value) as value, arg_min(note, (tile, row_no)) as note from {tiles} group by barcode",
)
def merge_tiles_average(t):
    return Q.merge_tiles(t.tiles, "average", ["tile", "row_no"])


@query(
    "merge_tiles_max", "barcode:s tile:s row_no:i value:d2 note:s",
    """select barcode, max(tile) as tile, max(row_no) as row_no, max(value) as value, max(note) as note
       from {tiles} group by barcode""",
)
def merge_tiles_max(t):
    return Q.merge_tiles(t.tiles, "max")


@query(
    "merge_tiles_first", "barcode:s value:d2 note:s",
    """select barcode, arg_min(value, (tile, row_no)) as value, arg_min(note, (tile, row_no)) as note
       from {tiles} group by barcode""",
)
def merge_tiles_first(t):
    return Q.merge_tiles(t.tiles, "first", ["tile", "row_no"])


@query(
    "overlap_stats", "tiles_merged:i total_barcodes:i overlapping_barcodes:i overlap_percent:d6",
    """select count(distinct tile) as tiles_merged, count(distinct barcode) as total_barcodes,
              count(*) - count(distinct barcode) as overlapping_barcodes,
              100.0 * (count(*) - count(distinct barcode)) / count(distinct barcode) as overlap_percent from {tiles}""",
)
def overlap_stats(t):
    return Q.overlap_stats(t.tiles)


@query(
    "gene_filter", "spot_id:i gene:s count:i",
    """select spot_id, gene, count from {brand_expr}
       where gene in (select p_brand from {part} group by p_brand having avg(p_size) > 25)""",
)
def gene_filter(t):
    wanted = t.part.groupBy(F.col("p_brand").alias("gene")).agg(F.avg("p_size").alias("s")).where("s > 25")
    return Q.gene_filter(t.brand_expr, wanted)


_BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query(
    "to_wide", "spot_id:i " + " ".join(f"b{i}:i" for i in range(1, 26)),
    "select spot_id, "
    + ", ".join(f"sum(case when gene = '{b}' then count else 0 end) as b{i}" for i, b in enumerate(_BRANDS, 1))
    + " from {brand_expr} group by spot_id",
)
def to_wide(t):
    return E.to_wide(t.brand_expr, _BRANDS).toDF("spot_id", *[f"b{i}" for i in range(1, 26)])


@query(
    "to_long", "spot_id:i gene:s count:i",
    """with s as (select distinct spot_id from {brand_expr}), g as (select distinct gene from {brand_expr})
       select s.spot_id, g.gene, coalesce(sum(count), 0) as count
       from s cross join g left join {brand_expr} e on e.spot_id = s.spot_id and e.gene = g.gene group by s.spot_id, g.gene""",
)
def to_long(t):
    return E.to_long(E.to_wide(t.brand_expr, _BRANDS), ["spot_id"])


def _lengths(t):
    return t.part.groupBy(F.col("p_brand").alias("gene")).agg(F.sum("p_size").alias("length"))


_NORM = """
    c as (select spot_id, gene, sum(count) as count from {brand_expr} group by spot_id, gene),
    len as (select p_brand as gene, sum(p_size) as length from {part} group by p_brand),
    r as (select spot_id, gene, count, length from c join len using (gene))"""


@query(
    "normalize_tpm", "spot_id:i gene:s value:d4",
    f"""with {_NORM} select spot_id, gene,
        (count / length) / sum(count / length) over (partition by spot_id) * 1e6 as value from r""",
)
def normalize_tpm(t):
    return E.normalize(t.brand_expr, "TPM", _lengths(t))


@query(
    "normalize_fpkm", "spot_id:i gene:s value:d2",
    f"""with {_NORM} select spot_id, gene,
        count * 1e9 / (length * sum(count) over (partition by spot_id)) as value from r""",
)
def normalize_fpkm(t):
    return E.normalize(t.brand_expr, "FPKM", _lengths(t))


@query(
    "region_expression", "region:s gene:s total:i mean_count:d6 detection_rate:d6",
    """with c as (select spot_id, gene, sum(count) as count from {brand_expr} group by spot_id, gene),
            n as (select region, count(*) as n from {spots} group by region)
       select region, gene, sum(count) as total, sum(count) / any_value(n) as mean_count,
              count(*) filter (where count > 0) / any_value(n) as detection_rate
       from c join {spots} using (spot_id) join n using (region) group by region, gene""",
)
def region_expression(t):
    return E.region_expression(t.brand_expr, t.spots)


def _markers(t):
    return t.part.select(F.col("p_type").alias("category"), F.col("p_brand").alias("gene")).distinct()


@query(
    "marker_category_scores", "spot_id:i category:s score:d6 markers_seen:i",
    """with m as (select distinct p_type as category, p_brand as gene from {part}),
            n as (select category, count(*) as n from m group by category),
            c as (select spot_id, gene, sum(count) as count from {brand_expr} group by spot_id, gene)
       select spot_id, category, sum(ln(1 + count)) / any_value(n) as score,
              count(*) filter (where count > 0) as markers_seen
       from c join m using (gene) join n using (category) group by spot_id, category""",
)
def marker_category_scores(t):
    return E.marker_category_scores(t.brand_expr, _markers(t))


@query("pca", "spot_id:i pc1:d4 pc2:d4")
def pca(t):
    pcs = E.pca(t.brand_expr, _BRANDS, k=2)
    return pcs.select("spot_id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))


def _knn_sql(k: int) -> str:
    """Brute force, for the oracle only."""
    return f"""
    knn as (
        select a.spot_id, b.spot_id as neighbour_id,
               (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) as d2,
               row_number() over (partition by a.spot_id
                   order by (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.spot_id) as rank
        from {{spots}} a join {{spots}} b on a.spot_id <> b.spot_id
        qualify rank <= {k})"""


_SUMS = f"""
    {_knn_sql(6)},
    v as (select gene, spot_id, value, value - avg(value) over (partition by gene) as z from {{moran_values}}),
    k as (select count(*)::double as s0 from knn),
    deg as (select id, sum(o) as o, sum(i) as i from (
                select spot_id as id, 1.0 as o, 0.0 as i from knn union all select neighbour_id, 0.0, 1.0 from knn)
            group by id),
    s2 as (select sum((o + i) * (o + i)) as s2 from deg),
    s1 as (select sum(n * n) as s1 from (
                select count(*) as n from knn group by least(spot_id, neighbour_id), greatest(spot_id, neighbour_id))),
    g as (select gene, count(*)::double as n, sum(z * z) as m2, sum(z * z * z * z) as m4 from v group by gene),
    c as (select a.gene, sum(a.z * b.z) as wzz, sum((a.z - b.z) * (a.z - b.z)) as wdd
          from knn join v a on a.spot_id = knn.spot_id join v b on b.spot_id = knn.neighbour_id and b.gene = a.gene
          group by a.gene),
    stat as (select gene, n, m2, m4, s0, s1, s2, n / s0 * wzz / m2 as i, (n - 1) * wdd / (2 * s0 * m2) as c,
                    -1 / (n - 1) as e, n * m4 / (m2 * m2) as b2
             from g join c using (gene) cross join k cross join s1 cross join s2),
    zs as (select *,
        (i - e) / sqrt((n * ((n*n - 3*n + 3) * s1 - n * s2 + 3 * s0*s0) - b2 * ((n*n - n) * s1 - 2*n * s2 + 6 * s0*s0))
            / ((n - 1) * (n - 2) * (n - 3) * s0*s0) - e * e) as zi,
        (c - 1) / sqrt(((n - 1) * s1 * (n*n - 3*n + 3 - (n - 1) * b2)
            - 0.25 * (n - 1) * s2 * (n*n + 3*n - 6 - (n*n - n + 2) * b2)
            + s0*s0 * (n*n - 3 - (n - 1) * (n - 1) * b2)) / (n * (n - 2) * (n - 3) * s0*s0)) as zc
        from stat)"""


@query(
    "knn_weights", "spot_id:i neighbour_id:i rank:i distance:d6",
    f"with {_knn_sql(6)} select spot_id, neighbour_id, rank, sqrt(d2) as distance from knn",
)
def knn_weights(t):
    return A.knn_weights(t.spots, 6)


@query(
    "knn_weights_per_sample", "sample_id:s spot_id:i neighbour_id:i rank:i distance:d6",
    """select a.sample_id, a.spot_id, b.spot_id as neighbour_id,
              row_number() over (partition by a.spot_id
                  order by (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.spot_id) as rank,
              sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) as distance
       from {spots} a join {spots} b on a.spot_id <> b.spot_id and a.sample_id = b.sample_id qualify rank <= 4""",
)
def knn_weights_per_sample(t):
    return A.knn_weights(t.spots, 4, keys=["sample_id"])


def _weights(t):
    # the graph is read several times per statistic, so it is computed once and written
    return materialize(A.knn_weights(t.spots, 6), "weights")


@query("morans_i", "gene:s n:i morans_i:d6", f"with {_SUMS} select gene, n, i as morans_i from stat")
def morans_i(t):
    return A.morans_i(t.moran_values, _weights(t), t.spots)


@query("gearys_c", "gene:s n:i gearys_c:d6", f"with {_SUMS} select gene, n, c as gearys_c from stat")
def gearys_c(t):
    return A.gearys_c(t.moran_values, _weights(t), t.spots)


@query(
    "autocorr_significance", "gene:s morans_i:d6 gearys_c:d6 z_score:d6 p_value:d6 geary_z:d6 geary_p_value:d6",
    f"""with {_SUMS} select gene, i as morans_i, c as gearys_c, zi as z_score, {normal_p_sql('zi')} as p_value,
        zc as geary_z, {normal_p_sql('zc')} as geary_p_value from zs""",
)
def autocorr_significance(t):
    weights = _weights(t)
    return A.autocorr_significance(A.autocorr_sums(t.moran_values, weights, t.spots), weights)


@query(
    "interpret_autocorr", "gene:s morans_i:d6 interpretation:s",
    f"""with {_SUMS} select gene, i as morans_i,
        case when i > 0.3 then 'clustered' when i < -0.3 then 'dispersed' else 'random' end as interpretation from stat""",
)
def interpret_autocorr(t):
    return A.interpret_autocorr(A.morans_i(t.moran_values, _weights(t), t.spots))


@query("autocorr_permutation", "gene:s morans_i:d6 at_least:i permutations:i p_value:d6")
def autocorr_permutation(t):
    return P.autocorr_permutation(t.moran_values, _weights(t), t.spots, seed=7)
