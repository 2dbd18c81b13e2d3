"""Canonical frames derived from the star-schema test tables.

Each binding is one SQL text that both Spark and DuckDB run, so the operators and their oracles start
from the same rows. ``{name}`` refers to a table or to another binding. Where the engines spell a function
differently the entry is a pair (Spark, DuckDB).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from spotweave.session import dealt

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

BINDINGS: dict[str, str | tuple[str, str]] = {
    # long expression with mitochondrial genes: a part number is a gene, a customer a spot
    "expr": """
        select o.o_custkey as spot_id,
               concat(case when l.l_partkey % 10 = 0 then 'MT-' else 'G' end, cast(l.l_partkey as string)) as gene,
               cast(l.l_quantity as bigint) as count
        from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey""",
    "brand_expr": """
        select o.o_custkey as spot_id, p.p_brand as gene, cast(l.l_quantity as bigint) as count
        from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey join {part} p on l.l_partkey = p.p_partkey""",
    "spots": """
        select c.c_custkey as spot_id, cast(c.c_custkey as string) as barcode,
               cast(c.c_custkey * 7919 % 10007 as double) / 100 as x,
               cast(c.c_custkey * 104729 % 10009 as double) / 100 as y,
               c.c_mktsegment as region, r.r_name as batch, n.n_name as sample_id, c.c_acctbal as acctbal
        from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey
             join {region} r on n.n_regionkey = r.r_regionkey""",
    "moran_values": """
        select spot_id, 'random' as gene, acctbal as value from {spots}
        union all select spot_id, 'clustered' as gene, acctbal + 100 * x as value from {spots}""",
    # one planted up or down shift per size class, one observation per line
    "de_obs": """
        select p.p_size as gene, case when l.l_returnflag = 'A' then 1 else 2 end as grp,
               l.l_quantity + case when p.p_size % 5 = 0 and l.l_returnflag = 'A' then 15
                                   when p.p_size % 7 = 0 and l.l_returnflag = 'R' then 15 else 0 end as value
        from {lineitem} l join {part} p on l.l_partkey = p.p_partkey where l.l_returnflag in ('A', 'R')""",
    "nb_counts": """
        select l.l_suppkey % 10 as sample_id, p.p_size as gene,
               sum(cast(l.l_quantity as bigint) * case when p.p_size % 5 = 0 and l.l_suppkey % 2 = 0 then 3 else 1 end) as count
        from {lineitem} l join {part} p on l.l_partkey = p.p_partkey group by l.l_suppkey % 10, p.p_size""",
    "nb_groups": """
        select distinct l_suppkey % 10 as sample_id, case when l_suppkey % 2 = 0 then 1 else 2 end as grp
        from {lineitem}""",
    # one batch per region, with a shift that differs by batch and gene
    "batch_expr": """
        select s.spot_id, e.gene, s.batch,
               cast(sum(e.count) as double) + length(s.batch) * 5 + cast(substr(e.gene, 7) as int) % 3 * length(s.batch) as value
        from {brand_expr} e join {spots} s on e.spot_id = s.spot_id group by s.spot_id, e.gene, s.batch""",
    "gene_sets": "select distinct p_name as pathway, p_partkey as gene from {part}",
    # every pathway belongs to one database
    "database_sets": """
        select distinct case length(p_name) % 4 when 0 then 'GO_BP' when 1 then 'KEGG' when 2 then 'Reactome' else 'Hallmark' end
                        as database,
               concat('id:', p_name) as pathway_id, p_name as pathway, p_partkey as gene
        from {part}""",
    "kegg_sets": "select pathway_id as pathway, gene from {database_sets} where database = 'KEGG'",
    "gene_list": "select distinct p_partkey as gene from {part} where p_size <= 10",
    "background": "select distinct p_partkey as gene from {part}",
    "tiles": """
        select cast(o_custkey as string) as barcode, o_orderstatus as tile, o_orderkey as row_no,
               o_totalprice as value, o_orderpriority as note from {orders}""",
    "reads": """
        select concat('lane_', cast(l_suppkey % 8 as string), '.fastq') as file,
               (l_orderkey * 8 + l_linenumber) * 1000000000 + (l_partkey * 100003 + l_suppkey) % 1000000000 as pos,
               concat(case when l_partkey % 97 = 0 then '' else '@' end, 'READ', cast(l_orderkey as string), '.',
                      cast(l_linenumber as string), '.', cast(l_partkey as string)) as header,
               concat('READ', cast(l_orderkey as string), '.', cast(l_linenumber as string), '.',
                      cast(l_partkey as string)) as read_id,
               1 + l_linenumber % 2 as mate,
               concat('GENE:', cast(l_partkey % 50 as string)) as comment,
               concat(translate(substr(md5(cast(l_suppkey as string)), 1, 16), '0123456789abcdef', 'ACGTACGTACGTACGT'),
                      translate(substr(md5(cast(l_partkey as string)), 1, 12), '0123456789abcdef', 'ACGTACGTACGTACGT'),
                      case when l_linenumber = 7 then '' else 'TTTT' end) as sequence,
               case when l_partkey % 89 = 0 then '-' else '+' end as plus,
               substr(translate(md5(concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-',
                                           cast(l_partkey as string), '-', cast(l_suppkey as string))),
                                '0123456789abcdef', 'IHGFEDCBA@?>=<;:'), 1,
                      case when l_linenumber = 7 then 28 when l_partkey % 83 = 0 then 31 else 32 end) as quality
        from {lineitem}""",
    "tagged_reads": """
        select substr(sequence, 1, 16) as barcode, substr(sequence, 17, 12) as umi, substr(comment, 6) as gene
        from {reads}""",
    "known_spots": """
        select translate(substr(md5(cast(s_suppkey as string)), 1, 16), '0123456789abcdef', 'ACGTACGTACGTACGT') as barcode
        from {supplier} where s_acctbal >= 0""",
    "alignments": """
        select concat(cast(l_orderkey as string), '-', cast(l_partkey as string)) as read_id, l_linenumber % 3 as nh
        from {lineitem}""",
    "survival": (
        """select c.c_custkey as patient_id,
               cast(floor(datediff(max(o.o_orderdate), min(o.o_orderdate)) / 30) as int) as months,
               max_by(o.o_orderstatus, o.o_orderdate + make_interval(0, 0, 0, 0, 0, 0, o.o_orderkey / 1000000)) = 'F' as event,
               max(c.c_acctbal) as value
        from {customer} c join {orders} o on c.c_custkey = o.o_custkey group by c.c_custkey""",
        """select c.c_custkey as patient_id,
               cast(floor(date_diff('day', min(o.o_orderdate)::date, max(o.o_orderdate)::date) / 30) as int) as months,
               arg_max(o.o_orderstatus, o.o_orderdate + to_microseconds(o.o_orderkey)) = 'F' as event,
               max(c.c_acctbal) as value
        from {customer} c join {orders} o on c.c_custkey = o.o_custkey group by c.c_custkey""",
    ),
    "mutations": """
        select o.o_custkey as sample_id, p.p_brand as gene,
               case l.l_linenumber % 4 when 0 then 'missense' when 1 then 'nonsense' when 2 then 'frameshift'
                    else 'splice_site' end as variant_class
        from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey join {part} p on l.l_partkey = p.p_partkey
        where l.l_quantity > 40""",
    "samples": """
        select c_custkey as sample_id, n_name as cohort,
               case c_custkey % 3 when 0 then 'primary_tumor' when 1 then 'normal' else 'metastatic' end as tissue_type,
               c_mktsegment as subtype
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "cohort_expr": """
        select s.cohort, s.tissue_type, e.spot_id as sample_id, e.gene, cast(sum(e.count) as double) as value
        from {brand_expr} e join {samples} s on e.spot_id = s.sample_id
        group by s.cohort, s.tissue_type, e.spot_id, e.gene""",
    "sample_vector": """
        select gene, avg(value) as value from {cohort_expr} where tissue_type = 'metastatic' group by gene""",
    "landmarks": """
        select sample_id, spot_id, x, y,
               1.5 * x - 0.4 * y + 12 + cast(spot_id % 7 - 3 as double) / 10 as u,
               0.3 * x + 1.2 * y - 7 + cast(spot_id % 5 - 2 as double) / 10 as v
        from {spots}""",
    "cells": """
        select p_partkey as cell_id, cast(p_size * 20 as double) as area,
               cast(p_partkey % 100 as double) / 100 as confidence, p_brand as cell_type,
               cast(p_partkey * 7919 % 10007 as double) / 100 as x,
               cast(p_partkey * 104729 % 10009 as double) / 100 as y
        from {part}""",
    "cell_expr": """
        select l_partkey as cell_id, concat('S', cast(l_suppkey % 40 as string)) as gene, cast(l_quantity as bigint) as count
        from {lineitem}""",
    "signatures": """
        select distinct case l_suppkey % 4 when 0 then 'apoptotic' when 1 then 'proliferating' when 2 then 'quiescent'
                             else 'senescent' end as label,
               concat('S', cast(l_suppkey % 40 as string)) as gene
        from {lineitem}""",
    "pixels": (
        """select vec_id as image_id, pos as x, 0 as y, cast(v as double) as intensity
           from (select vec_id, posexplode(embedding) as (pos, v) from {embeddings})""",
        """select vec_id as image_id, cast(unnest(range(len(embedding))) as int) as x, 0 as y,
                  cast(unnest(embedding) as double) as intensity from {embeddings}""",
    ),
    # the same as square images of eight by eight
    "square_pixels": (
        """select vec_id as image_id, pos % 8 as x, cast(floor(pos / 8) as int) as y, cast(v as double) as intensity
           from (select vec_id, posexplode(embedding) as (pos, v) from {embeddings})""",
        """select vec_id as image_id, cast(pos % 8 as int) as x, cast(pos // 8 as int) as y, cast(v as double) as intensity
           from (select vec_id, unnest(range(len(embedding))) as pos, unnest(embedding) as v from {embeddings})""",
    ),
    "image_rois": """
        select vec_id as image_id, vec_id * 2 + k as roi_id, label % 8 as x1, 0 as y1, 31 + 32 * k as x2, 0 as y2
        from (select vec_id, label, 0 as k from {embeddings} union all select vec_id, label, 1 as k from {embeddings}) e""",
    # every letter of a text becomes a base; whole texts
    "sequences": (
        """select doc_id as seq_id, translate(regexp_replace(text, '[^A-Za-z]', ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz',
                  'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC') as sequence from {documents}""",
        """select doc_id as seq_id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz',
                  'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC') as sequence from {documents}""",
    ),
    "rois": """
        select n_name as roi_id, cast(n_nationkey * 4 as double) as x1, cast(n_nationkey % 5 * 18 as double) as y1,
               cast(n_nationkey * 4 + 10 + n_nationkey % 3 * 12 as double) as x2,
               cast(n_nationkey % 5 * 18 + 15 as double) as y2
        from {nation}""",
    "annotations": """
        select upper(p_name) as gene_name, cast(p_partkey as string) as gene_id,
               concat('chr', cast(p_partkey % 5 as string)) as chromosome,
               p_partkey * 37 % 100003 * 10 as start,
               p_partkey * 37 % 100003 * 10 + p_size * p_size * 4 as end,
               case when p_size % 2 = 0 then '+' else '-' end as strand,
               p_type as gene_type,
               case p_partkey % 3 when 0 then 'gencode' when 1 then 'ensembl' else 'refseq' end as source,
               case p_size % 7 when 0 then 'hg38' when 1 then 'hg19' when 2 then 'mm10' when 3 then 'mm39'
                    when 4 then 'rn6' when 5 then 'danRer11' else 'hg99' end as genome
        from {part}""",
    "intervals": """
        select o_orderkey as interval_id, concat('chr', cast(o_orderkey % 5 as string)) as chromosome,
               o_orderkey * 61 % 1000003 as start,
               o_orderkey * 61 % 1000003 + o_custkey % 211 * (o_custkey % 13) as end
        from {orders}""",
    "workflow_catalog": "select p_type as category, p_name as name from {part} group by p_type, p_name",
    "diagnosis_codes": """
        select distinct concat('D', cast(p_size as string), '.', substr(p_brand, 7)) as code,
               concat(p_name, ' of ', lower(p_type)) as description from {part}""",
    "clinical": """
        select c.c_custkey as patient_id, c.c_custkey as sample_id, c.c_mktsegment as response,
               case when c.c_custkey % 11 = 0 then null else n.n_name end as treatment,
               case when c.c_custkey % 7 = 0 then null else cast(c.c_custkey % 60 as int) end as survival_months,
               case when c.c_acctbal < 0 then null else concat('stage ', cast(c.c_custkey % 4 as string)) end as stage
        from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey""",
    "images": """
        select cast(p_partkey as string) as image_id, p_name as sample_id,
               case p_size % 3 when 0 then 'H&E' when 1 then 'IF' else 'IHC' end as stain_type,
               p_retailprice as file_size_mb from {part}""",
    "tool_events": """
        select event_id, event_id - event_id % 3 as request_id, event_type as tool, user_id,
               cast(ts as timestamp) as ts, value as duration, event_type <> 'error' as success from {events}""",
    "run_events": """
        select event_id, user_id as run_id, cast(ts as timestamp) as ts, event_type as process,
               case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'running' end as status,
               event_id % 50 as completed, 50 as total,
               value as cpu_hours, value * 4 as memory_gb_hours, value / 20 as cost from {events}""",
    "calls": """
        select event_id as request_id, event_type as tool, cast(ts as timestamp) as ts from {events}
        where event_type in ('view', 'click', 'signup')""",
    "results": """
        select event_id - 1 as request_id, cast(ts as timestamp) as ts, event_type = 'purchase' as success from {events}
        where event_type in ('purchase', 'error')""",
    "arrivals": """
        select event_id, cast(ts as timestamp) as ts, (event_id + event_id % 7 * 50) * 10 + event_id % 7 as arrival
        from {events}""",
}

# bindings whose per-row work is heavy, with the table and the columns they read
SPREAD = {
    "reads": ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]),
    "sequences": ("documents", ["doc_id", "text"]),
}

# bindings that join a frame and group what is joined, with the key of that join: dealt out by the rows of lineitem
DEALT = {
    "brand_expr": ("lineitem", "l_orderkey"),
    "mutations": ("lineitem", "l_orderkey"),
    "cohort_expr": ("brand_expr", "spot_id"),
}

_REFERENCE = re.compile(r"\{(\w+)\}")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """Deal rows out to all cores when the scan has fewer tasks than the session has cores, as a file with
    one row group is one task. Data in many tasks passes through without a shuffle. The plan of the scan says how many."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    pruned = df.select(*columns)
    return pruned if pruned.rdd.getNumPartitions() >= cores else pruned.repartition(cores, *columns[:3])


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or binding as a Spark DataFrame. Sessions are pinned to UTC, as the tables carry no zone."""
    if name in TABLES:
        return load(spark, sf_dir, name)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    entry = BINDINGS[name]
    text = entry if isinstance(entry, str) else entry[0]
    frames = {dep: bind(spark, sf_dir, dep) for dep in dict.fromkeys(_REFERENCE.findall(text))}
    if name in SPREAD:
        table, columns = SPREAD[name]
        frames[table] = spread(frames[table], columns)
    if name in DEALT:
        frame, key = DEALT[name]
        frames[frame] = dealt(frames[frame], load(spark, sf_dir, "lineitem").count(), key)
    return spark.sql(text, **frames)


def _duck(name: str) -> str:
    entry = BINDINGS[name]
    return entry if isinstance(entry, str) else entry[1]


def duck_sql(body: str) -> str:
    """Put the bindings that a DuckDB text refers to in front of it as common table expressions."""
    ctes: dict[str, str] = {}

    def visit(text: str) -> None:
        for dep in dict.fromkeys(_REFERENCE.findall(text)):
            if dep in BINDINGS and dep not in ctes:
                visit(_duck(dep))
                ctes[dep] = _REFERENCE.sub(r"\1", _duck(dep))

    visit(body)
    plain = _REFERENCE.sub(r"\1", body).strip()
    if not ctes:
        return plain
    head = ", ".join(f"{name} as ({text})" for name, text in ctes.items())
    if plain.lower().startswith("with recursive "):
        return f"with recursive {head}, {plain[15:]}"
    return f"with {head}, {plain[5:]}" if plain.lower().startswith("with ") else f"with {head} {plain}"
