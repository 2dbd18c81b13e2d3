"""Differential expression, batch and enrichment queries."""

from pyspark.sql import functions as F

from spotweave.functions.running import running
from spotweave.operators import batch_effects as B
from spotweave.operators import differential as D
from spotweave.operators import enrichment as P
from spotweave.operators import expression as E
from spotweave.operators.principal import principal_axes
from spotweave.plans.registry import normal_p_sql, query, t_p_sql
from spotweave.session import materialize

_WILCOXON = """
    r as (select gene, grp, value, rank() over (partition by gene order by value)
              + (count(*) over (partition by gene, value) - 1) / 2 as midrank,
              count(*) over (partition by gene, value) as t from {de_obs}),
    w as (select gene, count(*) filter (where grp = 1)::double as n1, count(*) filter (where grp = 2)::double as n2,
                 sum(midrank) filter (where grp = 1) as rank_sum, sum(t::double * t - 1) as ties from r group by gene),
    u as (select gene, n1, n2, rank_sum - n1 * (n1 + 1) / 2 as u_statistic,
                 n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))) as var from w),
    wil as (select gene, n1, n2, u_statistic, (u_statistic - n1 * n2 / 2) / sqrt(var) as z_score from u)"""

_FOLD = """
    fold as (select gene, avg(value) as base_mean, log2((avg(value) filter (where grp = 1) + 1)
                    / (avg(value) filter (where grp = 2) + 1)) as log2_fold_change from {de_obs} group by gene)"""

_ADJUSTED = f"""
    {_WILCOXON}, {_FOLD},
    p as (select gene, base_mean, log2_fold_change, {normal_p_sql('z_score')} as p_value from wil join fold using (gene)),
    ranked as (select *, count(*) over () as m, count(*) over (order by p_value) as k from p),
    adj as (select *, min(least(p_value * m / k, 1)) over (order by p_value
                    range between current row and unbounded following) as p_adj from ranked),
    called as (select *, abs(log2_fold_change) >= 0.5 and p_adj < 0.05 as significant from adj)"""


@query(
    "de_wilcoxon", "gene:i n1:i n2:i u_statistic:d2 z_score:d6 p_value:d6",
    f"with {_WILCOXON} select *, {normal_p_sql('z_score')} as p_value from wil",
)
def de_wilcoxon(t):
    return D.de_wilcoxon(t.de_obs)


_TTEST = """
    with m as (select gene, count(*) filter (where grp = 1) as n1, count(*) filter (where grp = 2) as n2,
                      avg(value) filter (where grp = 1) as mean1, avg(value) filter (where grp = 2) as mean2,
                      var_samp(value) filter (where grp = 1) / count(*) filter (where grp = 1) as a,
                      var_samp(value) filter (where grp = 2) / count(*) filter (where grp = 2) as b
               from {de_obs} group by gene)
    select gene, n1, n2, mean1, mean2, (mean1 - mean2) / sqrt(a + b) as t_statistic,
           (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) as df from m"""


@query("de_ttest", "gene:i n1:i n2:i mean1:d6 mean2:d6 t_statistic:d6 df:d4", _TTEST)
def de_ttest(t):
    return D.de_ttest(t.de_obs)


@query(
    "de_ttest_p", "gene:i t_statistic:d6 df:d4 p_value:d6",
    f"select *, {t_p_sql('t_statistic', 'df')} as p_value from ({_TTEST}) q",
)
def de_ttest_p(t):
    return D.de_ttest(t.de_obs)


@query(
    "de_negbin", "gene:i base_mean:d4 dispersion:d6 log2_fold_change:d6 z_score:d4 p_value:d6",
    f"""with c as (select * from {{nb_counts}}),
        g as (select gene, avg(ln(count)) as g from c where count > 0 group by gene
              having count(*) = (select count(distinct sample_id) from c)),
        sf as (select sample_id, median(count / exp(g)) as s from c join g using (gene) group by sample_id),
        l as (select sample_id, s, grp from sf join {{nb_groups}} using (sample_id)),
        tot as (select count(*) filter (where grp = 1)::double as n1, count(*) filter (where grp = 2)::double as n2,
                       avg(1 / s) as inv from l),
        s as (select gene, coalesce(sum(count / s) filter (where grp = 1), 0) as s1,
                     coalesce(sum(count / s) filter (where grp = 2), 0) as s2, sum((count / s) * (count / s)) as ss
              from c join l using (sample_id) group by gene),
        m as (select gene, n1, n2, (s1 + s2) / (n1 + n2) as base_mean, s1 / n1 as mu1, s2 / n2 as mu2,
                     (ss - s1 * s1 / n1 - s2 * s2 / n2) / (n1 + n2 - 2) as var, inv
              from s cross join tot),
        d as (select *, greatest((var - base_mean * inv) / (base_mean * base_mean), 1e-8) as dispersion from m),
        z as (select *, log2(mu1 / mu2) as log2_fold_change, ln(mu1 / mu2)
                  / sqrt((1 / mu1 + dispersion) / n1 + (1 / mu2 + dispersion) / n2) as z_score from d)
        select *, {normal_p_sql('z_score')} as p_value from z""",
)
def de_negbin(t):
    return D.de_negbin(t.nb_counts, t.nb_groups)


@query("de_negbin_shrunk", "gene:i base_mean:d4 dispersion:d6 trend:d6 shrunk:d6 log2_fold_change:d6 z_score:d4 p_value:d6")
def de_negbin_shrunk(t):
    return D.de_negbin_shrunk(t.nb_counts, t.nb_groups)


@query("differential_t_test", "gene:i base_mean:d6 log2_fold_change:d6 p_value:d6 p_adj:d6 significant:b")
def differential_t_test(t):
    return D.differential_expression(t.de_obs, "t_test")


@query("differential_deseq2", "gene:i base_mean:d4 log2_fold_change:d6 p_value:d6 p_adj:d6 significant:b")
def differential_deseq2(t):
    rows = t.nb_counts.join(t.nb_groups, "sample_id")
    return D.differential_expression(rows.select(F.col("sample_id").alias("spot_id"), "gene", "grp", F.col("count").alias("value")), "deseq2")


@query("fold_change", "gene:i base_mean:d6 log2_fold_change:d6", f"with {_FOLD} select * from fold")
def fold_change(t):
    return D.fold_change(t.de_obs)


def _tested(t):
    return D.fold_change(t.de_obs).join(D.de_wilcoxon(t.de_obs).select("gene", "p_value"), "gene")


@query("adjust_bh", "gene:i p_value:d6 p_adj:d6", f"with {_ADJUSTED} select gene, p_value, p_adj from adj")
def adjust_bh(t):
    return D.adjust_pvalues(D.de_wilcoxon(t.de_obs), "bh")


@query(
    "adjust_bonferroni", "gene:i p_value:d6 p_adj:d6",
    f"with {_ADJUSTED} select gene, p_value, least(p_value * m, 1) as p_adj from adj",
)
def adjust_bonferroni(t):
    return D.adjust_pvalues(D.de_wilcoxon(t.de_obs), "bonferroni")


@query(
    "adjust_bh_per_family", "family:s gene:i p_value:d6 p_adj:d6",
    f"""with z as (select l_linestatus as family, l_partkey as gene,
                   (avg(l_quantity) - 25.5) / (14.43 / sqrt(count(*))) as z from {{lineitem}} group by all),
        p as (select family, gene, {normal_p_sql('z')} as p_value from z),
        r as (select *, count(*) over (partition by family) as m,
                     count(*) over (partition by family order by p_value) as k from p)
        select family, gene, p_value, min(least(p_value * m / k, 1)) over (partition by family order by p_value
               range between current row and unbounded following) as p_adj from r""",
)
def adjust_bh_per_family(t):
    from spotweave.functions.numeric import normal_two_sided

    z = (F.avg("l_quantity") - 25.5) / (F.lit(14.43) / F.sqrt(F.count("*")))
    scored = t.lineitem.groupBy(F.col("l_linestatus").alias("family"), F.col("l_partkey").alias("gene")).agg(z.alias("z"))
    return D.adjust_pvalues(scored.withColumn("p_value", normal_two_sided("z")), "bh", ["family"])


@query(
    "call_significant", "gene:i log2_fold_change:d6 p_adj:d6 significant:b",
    f"with {_ADJUSTED} select * from called",
)
def call_significant(t):
    return D.differential_expression(t.de_obs, "wilcoxon")


@query(
    "most_significant", "rank:i gene:i p_adj:d6",
    f"""with {_ADJUSTED}, placed as (select *, row_number() over (order by round(p_adj, 9), round(abs(log2_fold_change), 9) desc,
        gene) as rank from called) select rank, gene, p_adj from placed where rank <= 20""",
)
def most_significant(t):
    return D.most_significant(D.differential_expression(t.de_obs, "wilcoxon"), 20)


@query(
    "top_genes", "gene:i log2_fold_change:d6",
    f"""with {_ADJUSTED} select * from called where significant and log2_fold_change > 0
        order by log2_fold_change desc, gene limit 5""",
)
def top_genes(t):
    return D.top_genes(D.differential_expression(t.de_obs, "wilcoxon"), 5, "up")


@query(
    "top_genes_down", "gene:i log2_fold_change:d6",
    f"""with {_ADJUSTED} select * from called where significant and log2_fold_change < 0
        order by log2_fold_change, gene limit 5""",
)
def top_genes_down(t):
    return D.top_genes(D.differential_expression(t.de_obs, "wilcoxon"), 5, "down")


@query(
    "de_summary",
    "group1_size:i group2_size:i total_genes_tested:i significant_genes:i upregulated:i downregulated:i",
    f"""with {_ADJUSTED} select (select count(*) from {{de_obs}} where grp = 1) as group1_size,
        (select count(*) from {{de_obs}} where grp = 2) as group2_size, count(*) as total_genes_tested,
        count(*) filter (where significant) as significant_genes,
        count(*) filter (where significant and log2_fold_change > 0) as upregulated,
        count(*) filter (where significant and log2_fold_change < 0) as downregulated from called""",
)
def de_summary(t):
    size = lambda g: t.de_obs.agg(F.count_if(F.col("grp") == g).alias("n")).scalar()
    return D.de_summary(D.differential_expression(t.de_obs, "wilcoxon"), size(1), size(2))


# ---- batch -----------------------------------------------------------------------------------------------


def _combat_sql(steps: int) -> str:
    chain = [
        "e0 as (select *, gamma_hat as g, delta_hat as d from h join pr using (batch))"
    ]
    for i in range(1, steps + 1):
        gamma = "(t2 * n * gamma_hat + d * gamma_bar) / (t2 * n + d)"
        chain.append(
            f"e{i} as materialized (select * exclude (g, d, g1), g1 as g, (0.5 * ((n - 1) * delta_hat + n * (gamma_hat - g1) "
            f"* (gamma_hat - g1)) + b) / (n / 2 + a - 1) as d from (select *, {gamma} as g1 from e{i - 1}) q)"
        )
    return f"""
    cell as (select gene, batch, count(*)::double as n, avg(value) as mean, var_samp(value) as var
             from {{batch_expr}} group by gene, batch),
    ge as (select gene, sum(n * mean) / sum(n) as grand, sum((n - 1) * var) / sum(n) as pooled from cell group by gene),
    h as (select gene, batch, n, grand, pooled, (mean - grand) / sqrt(pooled) as gamma_hat, var / pooled as delta_hat
          from cell join ge using (gene)),
    pb as (select batch, avg(gamma_hat) as gamma_bar, var_samp(gamma_hat) as t2, avg(delta_hat) as m,
                  greatest(var_samp(delta_hat), 1e-12) as s2 from h group by batch),
    pr as (select batch, gamma_bar, t2, (2 * s2 + m * m) / s2 as a, (m * s2 + m * m * m) / s2 as b from pb),
    {', '.join(chain)},
    fixed as (select x.*, ((value - grand) / sqrt(pooled) - g) / sqrt(d) * sqrt(pooled) + grand as corrected
              from {{batch_expr}} x join e{steps} using (gene, batch))"""


def _share_sql(name: str, value: str) -> str:
    return f"""
    {name}_c as (select gene, batch, count(*) as n, avg({value}) as mean, var_pop({value}) as var from fixed group by gene, batch),
    {name}_g as (select gene, sum(n * mean) / sum(n) as grand from {name}_c group by gene),
    {name} as (select gene, sum(n * (mean - grand) * (mean - grand))
                   / (sum(n * (mean - grand) * (mean - grand)) + sum(n * var)) as share
               from {name}_c join {name}_g using (gene) group by gene)"""


@query(
    "combat", "spot_id:i gene:s batch:s value:d4 corrected:d4",
    f"with {_combat_sql(20)} select * from fixed",
)
def combat(t):
    return B.combat(t.batch_expr)


@query(
    "batch_variance", "variance_before:d6 variance_after:d6 variance_reduction:d4",
    f"""with {_combat_sql(20)}, {_share_sql('b', 'value')}, {_share_sql('a', 'corrected')}
        select (select avg(share) from b) as variance_before, (select avg(share) from a) as variance_after,
               1 - (select avg(share) from a) / (select avg(share) from b) as variance_reduction""",
)
def batch_variance(t):
    return B.batch_variance(B.combat(t.batch_expr))


@query(
    "batch_summary", "method:s num_batches:i num_samples:i genes_corrected:i",
    """select 'combat' as method, count(distinct batch) as num_batches, count(distinct spot_id) as num_samples,
              count(distinct gene) as genes_corrected from {batch_expr}""",
)
def batch_summary(t):
    return B.batch_summary(t.batch_expr)


@query(
    "kbet", "spots_tested:i mean_chi_square:d6 acceptance_rate:d6",
    """with knn as (select a.spot_id as id, b.batch from {spots} a join {spots} b on a.spot_id <> b.spot_id
            qualify row_number() over (partition by a.spot_id
                order by (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.spot_id) <= 10),
        f as (select batch, count(*) / (select count(*) from {spots}) as f from {spots} group by batch),
        o as (select id, batch, count(*) as o from knn group by id, batch),
        x as (select id, sum(o * o / f) / sum(o) - sum(o) as chi from o join f using (batch) group by id)
       select count(*) as spots_tested, avg(chi) as mean_chi_square,
              avg(case when exp(-chi / 2) * (1 + chi / 2) >= 0.05 then 1.0 else 0.0 end) as acceptance_rate from x""",
)
def kbet(t):
    return B.kbet(t.spots, k=10)


@query(
    "kbet_vectors", "spots_tested:i mean_chi_square:d6 acceptance_rate:d6",
    f"""with e as (select vec_id as spot_id, label % 3 as batch, embedding as v from {{embeddings}}),
             d as (select a.spot_id, b.spot_id as other, b.batch,
                          list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1]::double - z[2]) * (z[1]::double - z[2]))) as d2
                   from e a join e b on a.spot_id <> b.spot_id),
             knn as (select * from d qualify row_number() over (partition by spot_id order by d2, other) <= 10),
             f as (select batch, count(*) / (select count(*) from e) as f from e group by batch),
             o as (select spot_id, batch, count(*) as o from knn group by spot_id, batch),
             s as (select spot_id, sum(o * o / f) / sum(o) - sum(o) as chi_square from o join f using (batch) group by spot_id),
             t as (select chi_square, exp(-greatest(chi_square, 0) / 2) as p_value from s)
        select count(*) as spots_tested, avg(chi_square) as mean_chi_square,
               avg(case when p_value >= 0.05 then 1.0 else 0.0 end) as acceptance_rate from t""",
)
def kbet_vectors(t):
    # three batches have two degrees of freedom, whose upper tail is exp(-x / 2)
    spots = t.embeddings.select(
        F.col("vec_id").alias("spot_id"), (F.col("label") % 3).alias("batch"), F.col("embedding").cast("array<double>").alias("pc")
    )
    return B.kbet(spots, k=10)


_GENES = [f"Brand#{i}" for i in range(1, 26)]


@query(
    "pca_geometry", "spot_id:i distance_to_next:d6",
    """with c as (select spot_id, gene, ln(1 + sum(count)) as v from {brand_expr} group by spot_id, gene),
            s as (select spot_id, lead(spot_id) over (order by spot_id) as other from (select distinct spot_id from c) q),
            g as (select distinct gene from c)
       select s.spot_id, sqrt(sum((coalesce(a.v, 0) - coalesce(b.v, 0)) * (coalesce(a.v, 0) - coalesce(b.v, 0)))) as distance_to_next
       from s cross join g left join c a on a.spot_id = s.spot_id and a.gene = g.gene
            left join c b on b.spot_id = s.other and b.gene = g.gene
       where s.other is not null group by s.spot_id""",
)
def pca_geometry(t):
    """Distances between spots next to each other, in the space of all components: turning keeps them."""
    pcs = materialize(E.pca(t.brand_expr, k=len(_GENES)), "all-components")
    order = running(pcs.select("spot_id"), [], "spot_id", {"place": ("sum", F.lit(1))})
    placed = pcs.join(order, "spot_id")
    following = placed.select((F.col("place") - 1).alias("place"), F.col("pc").alias("other"))
    gap = F.aggregate(F.zip_with("pc", "other", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return placed.join(following, "place").select("spot_id", F.sqrt(gap).alias("distance_to_next"))


@query(
    "pca_variance", "components:i total_variance:d6 squared_variance:d6",
    """with c as (select spot_id, gene, ln(1 + sum(count)) as v from {brand_expr} group by spot_id, gene),
            n as (select count(distinct spot_id) as n from c),
            m as (select gene, sum(v) / any_value(n) as mean from c, n group by gene),
            cov as (select a.gene as g, b.gene as h,
                           (sum(x.v * y.v) - any_value(n) * any_value(a.mean) * any_value(b.mean)) / (any_value(n) - 1) as v
                    from m a cross join m b cross join n left join c x on x.gene = a.gene
                         left join c y on y.gene = b.gene and y.spot_id = x.spot_id
                    group by a.gene, b.gene)
       select count(*) filter (where g = h) as components, sum(v) filter (where g = h) as total_variance,
              sum(v * v) as squared_variance from cov""",
)
def pca_variance(t):
    """Sum of the components' variances and of their squares: trace and squared norm of the covariance."""
    table = principal_axes(t.brand_expr, len(_GENES)).variance_table()
    v = F.col("variance")
    return table.agg(F.count("*").alias("components"), F.sum(v).alias("total_variance"), F.sum(v * v).alias("squared_variance"))


def _pcs(t):
    batches = t.spots.select("spot_id", "batch")
    return materialize(E.pca(t.brand_expr, _GENES, 5).join(batches, "spot_id"), "pcs")


def _listed(pcs):
    return pcs.select("spot_id", "batch", *[F.col("pc")[j].alias(f"pc{j + 1}") for j in range(5)])


@query("harmony", "spot_id:i batch:s pc1:d4 pc2:d4 pc3:d4 pc4:d4 pc5:d4")
def harmony(t):
    return _listed(B.harmony(_pcs(t), clusters=4))


@query("scanorama", "spot_id:i batch:s pc1:d4 pc2:d4 pc3:d4 pc4:d4 pc5:d4")
def scanorama(t):
    return _listed(B.scanorama(_pcs(t), k=5))


@query("batch_correction_report", "method:s variance_before:d6 variance_after:d6 variance_reduction:d4 kbet_before:d4 kbet_after:d4")
def batch_correction_report(t):
    return B.correction_report(t.batch_expr, "combat", components=5)


# ---- enrichment ------------------------------------------------------------------------------------------

_OVERLAP = """
    overlap as (select pathway, count(*) as genes_in_pathway,
                       count(*) filter (where gene in (select gene from {gene_list})) as genes_overlapping,
                       list_sort(list(gene) filter (where gene in (select gene from {gene_list}))) as genes
                from {gene_sets} group by pathway),
    sizes as (select (select count(*) from {gene_list}) as n, (select count(*) from {background}) as total)"""
_LC = lambda n, k: f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - ({k}) + 1.0))"
_FISHER = f"""
    {_OVERLAP},
    terms as (select pathway, genes_in_pathway as kk, n, total,
                     unnest(range(genes_overlapping, least(genes_in_pathway, n) + 1)) as i from overlap cross join sizes),
    fisher as (select pathway, least(sum(exp({_LC('kk', 'i')} + {_LC('(total - kk)', '(n - i)')} - {_LC('total', 'n')})), 1) as p_value
               from terms group by pathway),
    enriched as (select pathway, genes_in_pathway, genes_overlapping, genes, p_value,
                        (genes_overlapping / n) / (genes_in_pathway / total) as fold_enrichment
                 from overlap join fisher using (pathway) cross join sizes),
    er as (select *, count(*) over () as m, count(*) over (order by round(p_value, 9)) as k from enriched),
    ea as (select *, min(least(p_value * m / k, 1)) over (order by round(p_value, 9)
                     range between current row and unbounded following) as p_adj from er)"""


@query(
    "pathway_overlap", "pathway:s genes_in_pathway:i genes_overlapping:i genes:l",
    f"with {_OVERLAP} select * from overlap",
)
def pathway_overlap(t):
    return P.pathway_overlap(t.gene_list, t.gene_sets, t.background)


@query("enrich_fisher", "pathway:s p_value:d8", f"with {_FISHER} select * from enriched")
def enrich_fisher(t):
    overlap = P.pathway_overlap(t.gene_list, t.gene_sets, t.background)
    return P.enrich_fisher(overlap, t.gene_list, t.background)


@query("fold_enrichment", "pathway:s fold_enrichment:d6", f"with {_FISHER} select * from enriched")
def fold_enrichment(t):
    overlap = P.pathway_overlap(t.gene_list, t.gene_sets, t.background)
    return P.enrich_fisher(overlap, t.gene_list, t.background)


@query(
    "enrich", "pathway:s genes_in_pathway:i genes_overlapping:i p_value:d6 p_adj:d6 fold_enrichment:d6",
    f"with {_FISHER} select * from ea",
)
def enrich(t):
    return P.enrich(t.gene_list, t.gene_sets, t.background)


@query(
    "enrich_database", "pathway_id:s pathway:s genes_in_pathway:i genes_overlapping:i p_value:d6 p_adj:d6",
    f"with {_FISHER.replace('{gene_sets}', '{kegg_sets}')} select pathway as pathway_id, substr(pathway, 4) as pathway, * exclude (pathway) from ea",
)
def enrich_database(t):
    return P.enrich_database(t.gene_list, t.database_sets, "KEGG", t.background)


@query(
    "enrich_summary", "pathways_tested:i pathways_enriched:i top_pathway:s",
    f"""with {_FISHER} select count(*) as pathways_tested, count(*) filter (where p_adj < 0.05) as pathways_enriched,
        arg_min(pathway, (p_value, pathway)) as top_pathway from ea""",
)
def enrich_summary(t):
    return P.enrich_summary(P.enrich(t.gene_list, t.gene_sets, t.background))
