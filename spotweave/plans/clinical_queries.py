"""Cohort, survival, clinical and catalog queries."""

from pyspark.sql import functions as F

from spotweave.functions.checks import safe_identifier, valid_genome
from spotweave.operators import catalogs as G
from spotweave.operators import clinical as C
from spotweave.operators import cohort as T
from spotweave.operators import survival as S
from spotweave.plans.registry import erfc_sql, normal_p_sql, query, t_p_sql

_CATALOG = """
    catalog as (select cohort as code, count(*) filter (where tissue_type = 'primary_tumor') as primary_tumor_samples,
                       count(*) filter (where tissue_type = 'normal') as normal_samples,
                       count(*) filter (where tissue_type = 'metastatic') as metastatic_samples
                from {samples} group by cohort)"""


@query(
    "cohort_catalog", "code:s primary_tumor_samples:i normal_samples:i metastatic_samples:i",
    f"with {_CATALOG} select * from catalog",
)
def cohort_catalog(t):
    return T.cohort_catalog(t.samples)


@query(
    "query_cohorts", "code:s matching_samples:i",
    f"with {_CATALOG} select code, normal_samples as matching_samples from catalog where normal_samples >= 20",
)
def query_cohorts(t):
    return T.query_cohorts(T.cohort_catalog(t.samples), tissue_type="normal", min_samples=20)


@query(
    "fetch_expression", "sample_id:i gene:s value:d2",
    """select sample_id, gene, value from {cohort_expr} where cohort = 'NATION_3' and tissue_type = 'primary_tumor'
       and gene in ('Brand#1', 'Brand#2', 'Brand#3')""",
)
def fetch_expression(t):
    return T.fetch_expression(t.cohort_expr, "NATION_3", ["Brand#1", "Brand#2", "Brand#3"])


@query(
    "fetch_expression_tpm", "sample_id:i gene:s value:d4",
    """with len as (select p_brand as gene, sum(p_size) as length from {part} group by p_brand),
            r as (select sample_id, gene, (value / length) / sum(value / length) over (partition by sample_id) * 1e6 as value
                  from {cohort_expr} join len using (gene) where cohort = 'NATION_3' and tissue_type = 'primary_tumor')
       select * from r where gene in ('Brand#1', 'Brand#2')""",
)
def fetch_expression_tpm(t):
    lengths = t.part.groupBy(F.col("p_brand").alias("gene")).agg(F.sum("p_size").alias("length"))
    return T.fetch_expression(t.cohort_expr, "NATION_3", ["Brand#1", "Brand#2"], normalization="TPM", gene_lengths=lengths)


@query(
    "expression_arrays", "gene:s chunk:i sample_ids:l values:s",
    """select gene, 0 as chunk, list(sample_id order by sample_id) as sample_ids,
              array_to_string(list(cast(value as bigint) order by sample_id), ' ') as values
       from {cohort_expr} where cohort = 'NATION_3' and tissue_type = 'normal' group by gene""",
)
def expression_arrays(t):
    genes = t.part.select(F.col("p_brand").alias("gene")).distinct()
    arrays = T.expression_arrays(T.fetch_expression(t.cohort_expr, "NATION_3", genes, "normal"))
    whole = F.transform("values", lambda v: v.cast("bigint").cast("string"))
    return arrays.withColumn("values", F.concat_ws(" ", whole))


_COMPARED = """
    cmp as (select e.gene, any_value(coalesce(s.value, 0)) as sample_expression, count(*) as n, avg(e.value) as cohort_mean,
                   stddev_samp(e.value) as cohort_std,
                   (any_value(coalesce(s.value, 0)) - avg(e.value)) / stddev_samp(e.value) as z_score,
                   avg(case when e.value <= coalesce(s.value, 0) then 100.0 else 0.0 end) as percentile,
                   sum(case when e.value < coalesce(s.value, 0) then 1.0
                            when e.value = coalesce(s.value, 0) then 0.5 else 0 end) as u
            from {cohort_expr} e left join {sample_vector} s on e.gene = s.gene group by e.gene)"""


@query(
    "compare_z",
    "gene:s sample_expression:d6 n:i cohort_mean:d6 cohort_std:d6 z_score:d6 p_value:d6 percentile:d6 interpretation:s",
    f"""with {_COMPARED} select *, {normal_p_sql('z_score')} as p_value,
        case when z_score > 1.96 then 'higher' when z_score < -1.96 then 'lower' else 'similar' end as interpretation
        from cmp""",
)
def compare_z(t):
    return T.compare_to_cohort(t.sample_vector, t.cohort_expr)


@query(
    "comparison_summary", "genes_compared:i significantly_different:i",
    f"""with {_COMPARED} select count(*) as genes_compared,
        count(*) filter (where {normal_p_sql('z_score')} < 0.05) as significantly_different from cmp""",
)
def comparison_summary(t):
    return T.comparison_summary(T.compare_to_cohort(t.sample_vector, t.cohort_expr))


@query(
    "compare_wilcoxon", "gene:s p_value:d6",
    f"""with {_COMPARED}, r as (select gene, (u - n / 2) / sqrt(n::double * (n + 2) / 12) as z from cmp)
        select gene, {normal_p_sql('z')} as p_value from r""",
)
def compare_wilcoxon(t):
    return T.compare_to_cohort(t.sample_vector, t.cohort_expr, test="wilcoxon")


@query(
    "compare_t_test", "gene:s z_score:d6 p_value:d6",
    f"""with {_COMPARED}, s as (select *, (sample_expression - cohort_mean) / (cohort_std * sqrt(1 + 1 / n)) as t, n - 1 as nu from cmp)
        select gene, z_score, {t_p_sql('t', 'nu')} as p_value from s""",
)
def compare_t_test(t):
    return T.compare_to_cohort(t.sample_vector, t.cohort_expr, test="t_test")


@query("percentile_rank", "gene:s percentile:d6", f"with {_COMPARED} select * from cmp")
def percentile_rank(t):
    return T.percentile_rank(t.sample_vector, t.cohort_expr)


@query("outlier_genes", "gene:s z_score:d6", f"with {_COMPARED} select * from cmp where abs(z_score) > 0.05")
def outlier_genes(t):
    return T.outlier_genes(T.compare_to_cohort(t.sample_vector, t.cohort_expr), cut=0.05)


_GROUPS = """
    med as (select median(value) as m from {survival}),
    surv as (select patient_id, months, event, case when value >= m then 'high' else 'low' end as grp
             from {survival} cross join med)"""
_KM = f"""
    {_GROUPS},
    pm as (select grp, months, count(*) as leaving, count(*) filter (where event) as events from surv group by grp, months),
    ar as (select *, sum(leaving) over (partition by grp order by months desc) as at_risk from pm),
    km as (select grp, months, at_risk, events, leaving - events as censored,
                  case when max(case when events = at_risk then 1 else 0 end) over w = 1 then 0.0
                       else exp(sum(case when events < at_risk then ln(1 - events / at_risk) else 0 end) over w) end as survival
           from ar window w as (partition by grp order by months))"""
_LOGRANK = f"""
    {_GROUPS},
    pm as (select months, count(*) filter (where grp = 'high') as l1, count(*) filter (where grp = 'low') as l2,
                  count(*) filter (where grp = 'high' and event) as d1, count(*) filter (where grp = 'low' and event) as d2
           from surv group by months),
    ar as (select *, sum(l1) over (order by months desc)::double as n1, sum(l2) over (order by months desc)::double as n2 from pm),
    lr as (select sum(d1) as observed1, sum(d2) as observed2, sum((d1 + d2) * n1 / (n1 + n2)) as expected1,
                  sum((d1 + d2) * n2 / (n1 + n2)) as expected2,
                  sum(case when n1 + n2 > 1 then n1 / (n1 + n2) * n2 / (n1 + n2) * (d1 + d2) * (n1 + n2 - d1 - d2) / (n1 + n2 - 1)
                      else 0 end) as variance from ar)"""


def _grouped(t):
    return S.split_by_expression(t.survival, "median")


@query("split_by_expression", "patient_id:i grp:s", f"with {_GROUPS} select * from surv")
def split_by_expression(t):
    return _grouped(t)


@query(
    "kaplan_meier", "grp:s months:i at_risk:i events:i censored:i survival:d6", f"with {_KM} select * from km"
)
def kaplan_meier(t):
    return S.kaplan_meier(_grouped(t))


@query(
    "median_survival", "grp:s median_survival_months:i num_samples:i num_events:i",
    f"""with {_KM} select grp, min(months) filter (where survival <= 0.5) as median_survival_months,
        max(at_risk) as num_samples, sum(events) as num_events from km group by grp""",
)
def median_survival(t):
    return S.median_survival(S.kaplan_meier(_grouped(t)))


@query(
    "survival_at_60", "grp:s survival_rate:d6",
    f"with {_KM} select grp, arg_max(survival, months) as survival_rate from km where months <= 60 group by grp",
)
def survival_at_60(t):
    return S.survival_at(S.kaplan_meier(_grouped(t)), 60)


@query(
    "log_rank", "observed1:i observed2:i expected1:d6 expected2:d6 variance:d6 chi_square:d6 p_value:d6",
    f"""with {_LOGRANK}, c as (select *, (observed1 - expected1) * (observed1 - expected1) / variance as chi_square from lr)
        select *, {erfc_sql('sqrt(chi_square / 2)')} as p_value from c""",
)
def log_rank(t):
    return S.log_rank(_grouped(t))


@query(
    "log_rank_groups", "groups:i chi_square:d6 degrees:i p_value:d6",
    """with m as (select months, patient_id % 3 as g, count(*) as l, count(*) filter (where event) as d from {survival}
                  where months is not null group by months, patient_id % 3),
            t as (select distinct months from m),
            r as (select t.months, sum(l) filter (where g = 0 and m.months >= t.months) as n0,
                         sum(l) filter (where g = 1 and m.months >= t.months) as n1, sum(l) filter (where m.months >= t.months) as n,
                         coalesce(sum(d) filter (where g = 0 and m.months = t.months), 0) as d0,
                         coalesce(sum(d) filter (where g = 1 and m.months = t.months), 0) as d1,
                         coalesce(sum(d) filter (where m.months = t.months), 0) as d
                  from t cross join m group by t.months),
            x as (select coalesce(n0, 0)::double / n as s0, coalesce(n1, 0)::double / n as s1, d0, d1, d::double as d,
                         case when n > 1 then d::double * (n - d) / (n - 1) else 0 end as w from r),
            v as (select sum(d0 - d * s0) as u0, sum(d1 - d * s1) as u1, sum(w * s0 * (1 - s0)) as v00, sum(w * s1 * (1 - s1)) as v11,
                         -sum(w * s0 * s1) as v01 from x),
            c as (select (v11 * u0 * u0 - 2 * v01 * u0 * u1 + v00 * u1 * u1) / (v00 * v11 - v01 * v01) as chi_square from v)
       select 3 as groups, chi_square, 2 as degrees, exp(-chi_square / 2) as p_value from c""",
)
def log_rank_groups(t):
    return S.log_rank_groups(t.survival.withColumn("grp", F.col("patient_id") % 3))


@query(
    "survival_report",
    "grp:s median_survival_months:i num_samples:i num_events:i survival_rate:d6 log_rank_p_value:d6 hazard_ratio:d6",
    f"""select k.*, l.p_value as log_rank_p_value, (observed1 / expected1) / (observed2 / expected2) as hazard_ratio
        from (with {_KM} select grp, min(months) filter (where survival <= 0.5) as median_survival_months,
                     max(at_risk) as num_samples, sum(events) as num_events,
                     arg_max(survival, months) filter (where months <= 60) as survival_rate from km group by grp) k
        cross join (with {_LOGRANK}, c as (select *, (observed1 - expected1) * (observed1 - expected1) / variance as chi from lr)
                    select *, {erfc_sql('sqrt(chi / 2)')} as p_value from c) l""",
)
def survival_report(t):
    return S.survival_report(_grouped(t), 60)


@query(
    "hazard_ratio", "hazard_ratio:d6 ci_low:d6 ci_high:d6",
    f"""with {_LOGRANK}, h as (select (observed1 / expected1) / (observed2 / expected2) as hazard_ratio,
               1.96 * sqrt(1 / expected1 + 1 / expected2) as w from lr)
        select hazard_ratio, exp(ln(hazard_ratio) - w) as ci_low, exp(ln(hazard_ratio) + w) as ci_high from h""",
)
def hazard_ratio(t):
    return S.hazard_ratio(_grouped(t))


@query(
    "mutation_frequency",
    "gene:s mutated_samples:i total_samples:i frequency:d6 missense_share:d6 nonsense_share:d6 frameshift_share:d6 splice_site_share:d6",
    """select gene, count(distinct sample_id) as mutated_samples, (select count(*) from {customer}) as total_samples,
              count(distinct sample_id) / (select count(*) from {customer}) as frequency,
              avg((variant_class = 'missense')::int) as missense_share, avg((variant_class = 'nonsense')::int) as nonsense_share,
              avg((variant_class = 'frameshift')::int) as frameshift_share,
              avg((variant_class = 'splice_site')::int) as splice_site_share
       from {mutations} group by gene""",
)
def mutation_frequency(t):
    return T.mutation_frequency(t.mutations, t.samples)


@query(
    "mutation_expression", "gene:s mean_mutated:d6 mean_wild_type:d6 mutation_rate:d6 mean_expression:d6 point_biserial_r:d6",
    """with m as (select distinct sample_id, gene, 1.0 as m from {mutations}),
            f as (select gene, value, coalesce(m, 0.0) as m from {cohort_expr} left join m using (sample_id, gene))
       select gene, avg(value) filter (where m = 1) as mean_mutated, avg(value) filter (where m = 0) as mean_wild_type,
              avg(m) as mutation_rate, avg(value) as mean_expression, corr(value, m) as point_biserial_r
       from f group by gene""",
)
def mutation_expression(t):
    return T.mutation_expression(t.mutations, t.cohort_expr)


@query(
    "subtype_counts", "cohort:s subtype:s samples:i",
    "select cohort, subtype, count(*) as samples from {samples} group by cohort, subtype",
)
def subtype_counts(t):
    return T.subtype_counts(t.samples)


# ---- clinical --------------------------------------------------------------------------------------------


def _patients(t):
    """Nested patient records: diagnoses from order priority and status, labs from the balance and segment.

    First and last order date per (patient, code, stage) come before the nesting, so a list holds at most
    one entry per code and stage, whatever the number of orders.
    """
    code = F.concat(F.substring("o_orderpriority", 1, 1), F.lit("00."), F.substring("o_orderpriority", 3, 1))
    diagnoses = (
        t.orders.groupBy(F.col("o_custkey").alias("patient_id"), code.alias("icd10"), F.col("o_orderstatus").alias("stage"))
        .agg(F.min("o_orderdate").cast("date").alias("date"))
        .groupBy("patient_id")
        .agg(F.sort_array(F.collect_list(F.struct("icd10", "stage", "date"))).alias("diagnoses"))
    )
    lab = lambda v, unit, span: F.struct(v.cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(span).alias("ref_range"))
    people = t.clinical.join(t.customer, F.col("patient_id") == F.col("c_custkey")).select(
        "patient_id", "sample_id", "stage",
        F.create_map(
            F.lit("balance"), lab(F.col("c_acctbal"), "USD", "0-5000"),
            F.lit("segment"), lab(F.length("c_mktsegment"), "chars", "8.5-9.5"),
        ).alias("labs"),
        F.array(
            F.struct(
                F.col("c_mktsegment").alias("name"), F.concat(F.col("c_nationkey").cast("string"), F.lit("mg")).alias("dose"),
                F.lit("daily").alias("frequency"),
            )
        ).alias("medications"),
    )
    empty = F.array().cast(diagnoses.schema["diagnoses"].dataType)
    return people.join(diagnoses, "patient_id", "left").withColumn("diagnoses", F.coalesce("diagnoses", empty))


@query(
    "patient_records", "patient_id:i diagnoses:i labs:i medications:i",
    """select c_custkey as patient_id, coalesce(n, 0) as diagnoses, 2 as labs, 0 as medications
       from {customer} left join (select o_custkey, count(distinct (o_orderpriority, o_orderstatus)) as n
                                  from {orders} group by o_custkey) o on c_custkey = o_custkey
       where c_acctbal < 0""",
)
def patient_records(t):
    wanted = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("patient_id"))
    records = C.patient_records(_patients(t), wanted, include_meds=False)
    return records.select("patient_id", *[F.size(c).alias(c) for c in ("diagnoses", "labs", "medications")])


@query(
    "link_spatial_to_clinical", "link_id:s region:s response:s survival_months:i",
    """select concat('link_', s.spot_id, '_', c.patient_id) as link_id, region, response, survival_months
       from {spots} s join {clinical} c on s.spot_id = c.sample_id""",
)
def link_spatial_to_clinical(t):
    spatial = t.spots.select(F.col("spot_id").alias("sample_id"), "region")
    return C.link_spatial_to_clinical(spatial, t.clinical).select("link_id", "region", "outcome_data.*")


@query(
    "search_diagnoses_code", "code:s description:s",
    "select code, description from {diagnosis_codes} where substr(code, 1, 3) = 'D12'",
)
def search_diagnoses_code(t):
    return C.search_diagnoses(t.diagnosis_codes, icd10_code="D12.9", keyword="ring")


@query(
    "search_diagnoses_keyword", "code:s description:s",
    "select code, description from {diagnosis_codes} where contains(lower(description), 'ring')",
)
def search_diagnoses_keyword(t):
    return C.search_diagnoses(t.diagnosis_codes, keyword="RiNg")


@query(
    "clinical_completeness", "patient_id:i present:i completeness:d6 missing:l",
    """select patient_id, 3 - len(m) as present, (3 - len(m)) / 3 as completeness, m as missing
       from (select patient_id, list_filter([case when treatment is null then 'treatment' end,
             case when survival_months is null then 'survival_months' end, case when stage is null then 'stage' end],
             lambda e: e is not null) as m from {clinical}) q""",
)
def clinical_completeness(t):
    return C.clinical_completeness(t.clinical, ["treatment", "survival_months", "stage"])


@query(
    "expression_by_response", "gene:s response:s samples:i mean_expression:d6 months_r:d6",
    """select gene, response, count(*) as samples, avg(value) as mean_expression,
              corr(value, survival_months) as months_r
       from {cohort_expr} join {clinical} using (sample_id) group by gene, response""",
)
def expression_by_response(t):
    return C.expression_by_response(t.cohort_expr, t.clinical)


@query(
    "lab_flags", "patient_id:i lab:s value:d2 flag:s",
    """select c_custkey as patient_id, 'balance' as lab, c_acctbal as value,
              case when c_acctbal < 0 then 'low' when c_acctbal > 5000 then 'high' else 'normal' end as flag from {customer}
       union all select c_custkey, 'segment', length(c_mktsegment),
              case when length(c_mktsegment) < 8.5 then 'low' when length(c_mktsegment) > 9.5 then 'high' else 'normal' end
       from {customer}""",
)
def lab_flags(t):
    return C.lab_flags(_patients(t))


@query(
    "diagnosis_counts", "category:s stage:s patients:i",
    """select concat(substr(o_orderpriority, 1, 1), '00') as category, o_orderstatus as stage,
              count(distinct o_custkey) as patients from {orders} group by all""",
)
def diagnosis_counts(t):
    return C.diagnosis_counts(_patients(t))


# ---- catalogs --------------------------------------------------------------------------------------------


@query(
    "genome_catalog", "genome_id:s assembly:s organism:s size_mb:i genes:i",
    """with g(genome_id, assembly, organism, size_mb) as (values
           ('hg38', 'GRCh38', 'Homo sapiens', 938), ('mm10', 'GRCm38', 'Mus musculus', 782),
           ('hg19', 'GRCh37', 'Homo sapiens', 920), ('mm39', 'GRCm39', 'Mus musculus', 785),
           ('rn6', 'Rnor_6.0', 'Rattus norvegicus', 740), ('danRer11', 'GRCz11', 'Danio rerio', 410))
       select a.genome as genome_id, assembly, organism, size_mb, count(*) as genes
       from {annotations} a left join g on a.genome = g.genome_id group by all""",
)
def genome_catalog(t):
    used = t.annotations.groupBy(F.col("genome").alias("genome_id")).agg(F.count("*").alias("genes"))
    return G.describe_genomes(used)


@query(
    "query_genes", "gene_id:s gene_name:s chromosome:s start:i",
    """select gene_id, gene_name, chromosome, start from {annotations}
       where genome = 'hg38' and source = 'gencode' and chromosome = 'chr1'""",
)
def query_genes(t):
    return G.query_genes(t.annotations, genome="hg38", chromosome="chr1", source="gencode")


@query(
    "query_genes_by_name", "gene_id:s gene_name:s genome:s",
    "select gene_id, gene_name, genome from {annotations} where gene_name = 'SMALL RING'",
)
def query_genes_by_name(t):
    return G.query_genes(t.annotations, gene_name="Small Ring")


@query(
    "convert_coordinates", "gene_id:s start_0:i end_0:i",
    'select gene_id, start - 1 as start_0, "end" as end_0 from {annotations}',
)
def convert_coordinates(t):
    moved = G.convert_coordinates(t.annotations, "one_closed", "zero_half_open")
    return moved.withColumnsRenamed({"start": "start_0", "end": "end_0"})


@query(
    "overlap_genes", "interval_id:i gene_name:s chromosome:s overlap:i",
    """select i.interval_id, a.gene_name, i.chromosome, least(i."end", a."end") - greatest(i.start, a.start) + 1 as overlap
       from {intervals} i join {annotations} a on i.chromosome = a.chromosome and i.start <= a."end" and a.start <= i."end" """,
)
def overlap_genes(t):
    return G.overlap_genes(t.intervals, t.annotations)


@query(
    "workflow_catalog", "category:s name:s total_count:i",
    """select category, name, count(*) over () as total_count from {workflow_catalog} where category = 'ECONOMY'""",
)
def workflow_catalog(t):
    return G.list_workflows(t.workflow_catalog, "ECONOMY")


@query(
    "valid_genome", "genome:s valid:b genes:i",
    """select genome, genome in ('hg38', 'hg19', 'mm10', 'mm39', 'rn6', 'danRer11') as valid, count(*) as genes
       from {annotations} group by genome""",
)
def valid_genome_query(t):
    return t.annotations.groupBy("genome").agg(F.count("*").alias("genes")).withColumn("valid", valid_genome("genome"))


@query(
    "safe_identifier", "kind:s checked:i safe:i",
    r"""with v as (select 'url' as kind, url as value from {pages} union all select 'customer', c_name from {customer}
                   union all select 'document', text from {documents} union all select 'type', p_type from {part})
        select kind, count(*) as checked,
               count(*) filter (where regexp_full_match(value, '[a-zA-Z0-9_\-./]+') and length(value) <= 1000) as safe
        from v group by kind""",
)
def safe_identifier_query(t):
    kinds = [("url", t.pages, "url"), ("customer", t.customer, "c_name"), ("document", t.documents, "text"), ("type", t.part, "p_type")]
    frames = [df.select(F.lit(kind).alias("kind"), F.col(c).alias("value")) for kind, df, c in kinds]
    rows = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
    return rows.groupBy("kind").agg(F.count("*").alias("checked"), F.count_if(safe_identifier("value")).alias("safe"))
