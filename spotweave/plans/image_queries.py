"""Image, cell and sequence queries."""

from pyspark.sql import functions as F

from spotweave.operators import cells as K
from spotweave.operators import imaging as I
from spotweave.plans.registry import query


@query(
    "find_images", "image_id:s stain_type:s served_magnification:s",
    """select image_id, stain_type, '20x' as served_magnification from {images}
       where stain_type = 'H&E' and file_size_mb <= 1000""",
)
def find_images(t):
    return I.find_images(t.images, stain_type="he", resolution="high", max_size_mb=1000)


_FIT = """
    m as (select sample_id, avg(x) as mx, avg(y) as my, avg(u) as mu, avg(v) as mv, count(*) as n from {landmarks} group by sample_id),
    c as (select sample_id, n, mx, my, mu, mv, x - mx as x, y - my as y, u - mu as u, v - mv as v
          from {landmarks} join m using (sample_id)),
    s as (select sample_id, any_value(n) as n, any_value(mx) as mx, any_value(my) as my, any_value(mu) as mu, any_value(mv) as mv,
                 sum(x*x) as sxx, sum(y*y) as syy, sum(x*y) as sxy, sum(x*u) as sxu, sum(y*u) as syu, sum(x*v) as sxv, sum(y*v) as syv
          from c group by sample_id),
    p as (select sample_id, n as matched_points, mx, my, mu, mv,
                 (sxu*syy - syu*sxy) / (sxx*syy - sxy*sxy) as a, (syu*sxx - sxu*sxy) / (sxx*syy - sxy*sxy) as b,
                 (sxv*syy - syv*sxy) / (sxx*syy - sxy*sxy) as c, (syv*sxx - sxv*sxy) / (sxx*syy - sxy*sxy) as d from s),
    fit as (select sample_id, matched_points, a, b, c, d, mu - a*mx - b*my as translation_x, mv - c*mx - d*my as translation_y,
                   sqrt(a*a + c*c) as scale_x, sqrt(b*b + d*d) as scale_y, degrees(atan2(c, a)) as rotation_degrees from p)"""
_FIT_COLUMNS = (
    "sample_id:s matched_points:i a:d6 b:d6 c:d6 d:d6 translation_x:d6 translation_y:d6 scale_x:d6 scale_y:d6 rotation_degrees:d6"
)


@query("fit_registration", _FIT_COLUMNS, f"with {_FIT} select * from fit")
def fit_registration(t):
    return I.fit_registration(t.landmarks)


@query(
    "fit_registration_rigid", _FIT_COLUMNS,
    f"""with {_FIT}, r as (select *, atan2(sxv - syu, sxu + syv) as angle from s),
        q as (select *, cos(angle) as a, -sin(angle) as b, sin(angle) as c, cos(angle) as d from r)
        select sample_id, n as matched_points, a, b, c, d, mu - a*mx - b*my as translation_x, mv - c*mx - d*my as translation_y,
               1.0 as scale_x, 1.0 as scale_y, degrees(angle) as rotation_degrees from q""",
)
def fit_registration_rigid(t):
    return I.fit_registration(t.landmarks, "rigid")


@query(
    "apply_registration", "spot_id:i image_x:d5 image_y:d5",
    f"""with {_FIT} select spot_id, a*x + b*y + translation_x as image_x, c*x + d*y + translation_y as image_y
        from {{spots}} join fit using (sample_id)""",
)
def apply_registration(t):
    return I.apply_registration(t.spots.select("spot_id", "sample_id", "x", "y"), I.fit_registration(t.landmarks))


@query(
    "registration_quality", "sample_id:s rmse:d6 correlation:d6 matched_points:i passed:b",
    f"""with {_FIT}, e as (select sample_id, u, v, a*x + b*y + translation_x as iu, c*x + d*y + translation_y as iv
                           from {{landmarks}} join fit using (sample_id))
        select sample_id, sqrt(avg((iu-u)*(iu-u) + (iv-v)*(iv-v))) as rmse, (corr(iu, u) + corr(iv, v)) / 2 as correlation,
               count(*) as matched_points, sqrt(avg((iu-u)*(iu-u) + (iv-v)*(iv-v))) < 5 as passed from e group by sample_id""",
)
def registration_quality(t):
    return I.registration_quality(t.landmarks, I.fit_registration(t.landmarks))


_INSIDE = """
    inside as (select roi_id, image_id, p.x, p.y, intensity from {pixels} p join {image_rois} r using (image_id)
               where p.x between x1 and x2 and p.y between y1 and y2)"""


@query(
    "image_intensity", "roi_id:i pixels:i mean:d6 std:d6 min:d6 max:d6 p25:d6 p50:d6 p75:d6",
    f"""with {_INSIDE} select roi_id, count(*) as pixels, avg(intensity) as mean, stddev_samp(intensity) as std,
        min(intensity) as min, max(intensity) as max, quantile_cont(intensity, 0.25) as p25,
        quantile_cont(intensity, 0.5) as p50, quantile_cont(intensity, 0.75) as p75 from inside group by roi_id""",
)
def image_intensity(t):
    return I.image_features(t.pixels, t.image_rois, "intensity")


@query(
    "image_texture", "roi_id:i pairs:i contrast:d6 energy:d6 homogeneity:d6 correlation:d8",
    f"""with {_INSIDE},
        g as (select roi_id, x, greatest(least(floor((intensity + 0.6) / (0.6 - (-0.6)) * 8), 7), 0) as g from inside),
        pr as (select a.roi_id, a.g as i, b.g as j from g a join g b on a.roi_id = b.roi_id and b.x = a.x + 1),
        cell as (select roi_id, i, j, count(*)::double as c from pr group by all)
        select roi_id, sum(c) as pairs, sum(c * (i-j) * (i-j)) / sum(c) as contrast, sum(c*c) / (sum(c) * sum(c)) as energy,
               sum(c / (1 + abs(i-j))) / sum(c) as homogeneity,
               (sum(c*i*j) / sum(c) - sum(c*i) * sum(c*j) / (sum(c) * sum(c)))
                 / sqrt((sum(c*i*i) / sum(c) - sum(c*i) * sum(c*i) / (sum(c) * sum(c)))
                      * (sum(c*j*j) / sum(c) - sum(c*j) * sum(c*j) / (sum(c) * sum(c)))) as correlation
        from cell group by roi_id""",
)
def image_texture(t):
    return I.image_features(t.pixels, t.image_rois, "texture", low=-0.6, high=0.6, levels=8)


@query(
    "image_summary", "image_id:i pixels:i width:i height:i mean:d6 std:d6 min:d6 max:d6",
    """select image_id, count(*) as pixels, max(x) - min(x) + 1 as width, max(y) - min(y) + 1 as height, avg(intensity) as mean,
              stddev_samp(intensity) as std, min(intensity) as min, max(intensity) as max from {square_pixels} group by image_id""",
)
def image_summary(t):
    return I.image_summary(t.square_pixels)


@query(
    "texture_2d", "image_id:i direction:s pairs:i contrast:d6 energy:d6 homogeneity:d6 correlation:d8",
    """with g as (select image_id, x, y, greatest(least(floor((intensity + 0.6) / (0.6 - (-0.6)) * 8), 7), 0) as g from {square_pixels}),
            s(direction, dx, dy) as (values ('0', 1, 0), ('90', 0, 1), ('45', 1, -1), ('135', 1, 1)),
            pr as (select a.image_id, direction, a.g as i, b.g as j from g a cross join s
                   join g b on b.image_id = a.image_id and b.x = a.x + dx and b.y = a.y + dy),
            cell as (select image_id, direction, i, j, count(*)::double as c from
                       (select image_id, direction, i, j from pr union all select image_id, direction, j, i from pr) q group by all),
            m as (select image_id, direction, sum(c * i) / sum(c) as m, sum(c) as n from cell group by all)
       select image_id, direction, any_value(n) / 2 as pairs, sum(c * (i - j) * (i - j)) / any_value(n) as contrast,
              sum(c * c) / (any_value(n) * any_value(n)) as energy, sum(c / (1 + abs(i - j))) / any_value(n) as homogeneity,
              case when sum(c * (i - m) * (i - m)) / any_value(n) > 1e-12
                   then sum(c * (i - m) * (j - m)) / sum(c * (i - m) * (i - m)) end as correlation
       from cell join m using (image_id, direction) group by image_id, direction""",
)
def texture_2d(t):
    return I.texture_2d(t.square_pixels, low=-0.6, high=0.6, levels=8)


@query(
    "image_objects", "image_id:i area:i centroid_x:d6 centroid_y:d6 x1:i y1:i x2:i y2:i perimeter:i",
    """with recursive p as (select image_id, x, y, y * 8 + x as k from {square_pixels} where intensity >= 0.05),
            e as (select a.image_id, a.k as a, b.k as b from p a join p b on a.image_id = b.image_id and abs(a.x - b.x) + abs(a.y - b.y) = 1),
            r(image_id, k, root) as (
              select image_id, k, k from p union select r.image_id, e.b, r.root from r join e on e.image_id = r.image_id and e.a = r.k),
            o as (select image_id, k, min(root) as root from r group by image_id, k),
            n as (select image_id, a as k, count(*) as near from e group by image_id, a)
       select image_id, count(*) as area, avg(x) as centroid_x, avg(y) as centroid_y, min(x) as x1, min(y) as y1, max(x) as x2, max(y) as y2,
              sum(4 - coalesce(near, 0)) as perimeter
       from p join o using (image_id, k) left join n using (image_id, k) group by image_id, root""",
)
def image_objects(t):
    # tiles of three, so that objects of these small images cross borders
    return I.image_objects(t.square_pixels, threshold=0.05, tile=3)


@query(
    "image_morphology", "roi_id:i area:i centroid_x:d6 centroid_y:d6 major_axis:d6 minor_axis:d6",
    f"""with {_INSIDE} select roi_id, count(*) as area, avg(x) as centroid_x, avg(y) as centroid_y,
        4 * sqrt(var_pop(x)) as major_axis, 0.0 as minor_axis from inside where intensity >= 0 group by roi_id""",
)
def image_morphology(t):
    return I.image_features(t.pixels, t.image_rois, "morphology", threshold=0.0)


@query("filter_cells", "cell_id:i area:d1", "select cell_id, area from {cells} where area >= 100")
def filter_cells(t):
    return K.filter_cells(t.cells)


@query(
    "cell_summary", "cells_detected:i mean_cell_area:d6 mean_confidence:d6 cells_filtered:i",
    """select count(*) filter (where area >= 100) as cells_detected, avg(area) filter (where area >= 100) as mean_cell_area,
              avg(confidence) filter (where area >= 100) as mean_confidence,
              count(*) filter (where area < 100) as cells_filtered from {cells}""",
)
def cell_summary(t):
    return K.cell_summary(t.cells)


_SCORES = """
    size as (select label, count(distinct gene) as size from {signatures} group by label),
    cnt as (select cell_id, gene, sum(count) as count from {cell_expr} group by cell_id, gene),
    seen as (select cell_id, label, sum(ln(1 + count)) as s from cnt join {signatures} using (gene) group by cell_id, label),
    full_ as (select c.cell_id, size.label, coalesce(s, 0) / size as score
              from (select distinct cell_id from cnt) c cross join size left join seen using (cell_id, label)),
    best as (select cell_id, arg_min(label, (-score, label)) as label, max(score) as score,
                    exp(max(score)) / sum(exp(score)) as confidence from full_ group by cell_id)"""


@query(
    "classify_cell_states", "cell_id:i state:s confidence:d6",
    f"""with {_SCORES} select cell_id, label as state, confidence from best
        where cell_id in (select cell_id from {{cells}} where area >= 100)""",
)
def classify_cell_states(t):
    return K.classify_cell_states(K.filter_cells(t.cells), t.cell_expr, t.signatures)


@query(
    "predict_cell_type", "cell_id:i cell_type:s confidence:d6",
    f"with {_SCORES} select cell_id, label as cell_type, confidence from best",
)
def predict_cell_type(t):
    return K.predict_cell_type(t.cell_expr, t.signatures)


@query(
    "cell_type_summary", "total_cells:i unique_types:i",
    f"with {_SCORES} select count(*) as total_cells, count(distinct label) as unique_types from best",
)
def cell_type_summary(t):
    return K.cell_type_summary(K.predict_cell_type(t.cell_expr, t.signatures))


@query(
    "cell_type_report", "cell_type:s cells:i share:d6 confident_share:d6 low_confidence:i",
    """select cell_type, count(*) as cells, count(*) / (select count(*) from {cells}) as share,
              count(*) filter (where confidence >= 0.7) / count(*) as confident_share,
              count(*) filter (where confidence < 0.7) as low_confidence from {cells} group by cell_type""",
)
def cell_type_report(t):
    return K.cell_type_report(t.cells)


@query("low_confidence_cells", "cell_id:i confidence:d6", "select * from {cells} where confidence < 0.7")
def low_confidence_cells(t):
    return K.low_confidence_cells(t.cells)


# a box with a notch in its upper side, as SQL pairs
_NOTCHED = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("(x1 + x2) / 2", "(y1 + y2) / 2"), ("x1", "y2")]
_CROSSINGS = " + ".join(
    f"(case when (({ay}) > y) <> (({by}) > y) "
    f"and x < (({bx}) - ({ax})) * (y - ({ay})) / nullif(({by}) - ({ay}), 0) + ({ax}) then 1 else 0 end)"
    for (ax, ay), (bx, by) in zip(_NOTCHED, _NOTCHED[1:] + _NOTCHED[:1])
)


@query(
    "cells_in_boundary", "cell_id:i polygon_id:s",
    f"select cell_id, roi_id as polygon_id from {{cells}} cross join {{rois}} where ({_CROSSINGS}) % 2 = 1",
)
def cells_in_boundary(t):
    corners = [F.struct(F.expr(x).alias("x"), F.expr(y).alias("y")) for x, y in _NOTCHED]
    polygons = t.rois.select(F.col("roi_id").alias("polygon_id"), F.array(*corners).alias("vertices"))
    return K.cells_in_boundary(t.cells, polygons)


@query(
    "kmer_counts", "seq_id:i kmer:s n:i",
    """with k as (select seq_id, substr(sequence, unnest(range(1, length(sequence) - 4)), 6) as kmer from {sequences})
       select seq_id, kmer, count(*) as n from k where length(kmer) = 6 group by seq_id, kmer""",
)
def kmer_counts(t):
    return K.kmer_counts(t.sequences, 6)


@query(
    "embed_sequences", "seq_id:i dim:i counts:l",
    """with k as (select seq_id, substr(sequence, unnest(range(1, length(sequence) - 4)), 6) as kmer from {sequences}),
            c as (select seq_id, ('0x' || substr(md5(kmer), 1, 8))::bigint % 768 as place, count(*) as n from k where length(kmer) = 6 group by 1, 2),
            d as (select seq_id, list(cast(place as varchar) || ':' || cast(n as varchar) order by place) as counts from c group by seq_id)
       select s.seq_id, 768 as dim, coalesce(d.counts, []) as counts from (select distinct seq_id from {sequences}) s left join d using (seq_id)""",
)
def embed_sequences(t):
    """The whole vector, as its places that aren't zero."""
    out = K.embed_sequences(t.sequences)
    shown = F.transform("embedding", lambda v, i: F.when(v > 0, F.concat(i.cast("string"), F.lit(":"), v.cast("bigint").cast("string"))))
    return out.select("seq_id", F.size("embedding").alias("dim"), F.filter(shown, lambda c: c.isNotNull()).alias("counts"))


@query(
    "platform_correlation", "shared_genes:i pearson_r:d6 passed:b",
    """with a as (select p_brand as gene, avg(l_quantity) as va from {lineitem} join {part} on l_partkey = p_partkey group by 1),
            b as (select p_brand as gene, avg(p_retailprice) as vb from {part} group by 1)
       select count(*) as shared_genes, corr(va, vb) as pearson_r, corr(va, vb) >= 0.7 as passed from a join b using (gene)""",
)
def platform_correlation(t):
    first = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("gene"), F.col("l_quantity").alias("value")
    )
    return K.platform_correlation(first, t.part.select(F.col("p_brand").alias("gene"), F.col("p_retailprice").alias("value")))
