"""Read-level queries."""

from spotweave.operators import reads as R
from spotweave.plans.registry import query

_CHECKED = """
    checked as (
        select *, case when not starts_with(header, '@') then 'bad_header'
                       when not starts_with(plus, '+') then 'bad_separator'
                       when length(sequence) <> length(quality) then 'length_mismatch' end as problem,
               list_sum(list_transform(range(1, length(quality) + 1), lambda i: ascii(substr(quality, i, 1)) - 33))
                   / length(quality) as q
        from {reads})"""


@query(
    "validate_reads", "file:s valid:b total_reads:i avg_quality:d2 avg_read_length:d2 format_errors:i warnings:l",
    f"""with {_CHECKED}
    select file, avg(q) filter (where problem is null) >= 30 and count(problem) = 0 as valid,
           count(*) as total_reads, avg(q) filter (where problem is null) as avg_quality,
           avg(length(sequence)) filter (where problem is null) as avg_read_length, count(problem) as format_errors,
           list_filter([case when avg(q) filter (where problem is null) < 30 then 'mean quality below threshold' end,
                        case when count(problem) > 0 then 'malformed records' end], lambda w: w is not null) as warnings
    from checked group by file""",
)
def validate_reads(t):
    return R.validate_reads(t.reads, min_quality=30)


@query(
    "read_format_errors", "file:s pos:i problem:s",
    f"with {_CHECKED} select file, pos, problem from checked where problem is not null",
)
def read_format_errors(t):
    return R.read_format_errors(t.reads)


@query(
    "sample_reads", "file:s pos:i read_id:s quality:s",
    """select file, pos, read_id, quality from {reads}
       qualify row_number() over (partition by file order by pos) <= 500""",
)
def sample_reads(t):
    return R.sample_reads(t.reads, 500)


@query(
    "extract_umis", "file:s pos:i read_name:s barcode:s umi:s template:s template_quality:s",
    """select file, pos, concat(read_id, ':', substr(sequence, 17, 12)) as read_name, substr(sequence, 1, 16) as barcode,
              substr(sequence, 17, 12) as umi, substr(sequence, 29) as template, substr(quality, 29) as template_quality
       from {reads}""",
)
def extract_umis(t):
    return R.extract_umis(t.reads, 12, "16M12M+T")


@query(
    "umi_stats", "reads_processed:i umi_count:i unique_umi_ratio:d6",
    """select count(*) as reads_processed, count(distinct umi) as umi_count,
              count(distinct umi) / count(*) as unique_umi_ratio from {tagged_reads}""",
)
def umi_stats(t):
    return R.umi_stats(R.extract_umis(t.reads, 12, "16B12M+T"))


@query(
    "umi_extraction_rate", "reads:i extractable:i extraction_rate:d6",
    """select count(*) as reads, count(*) filter (where length(sequence) >= 32) as extractable,
              count(*) filter (where length(sequence) >= 32) / count(*) as extraction_rate from {reads}""",
)
def umi_extraction_rate(t):
    return R.umi_extraction_rate(t.reads, needed=32)


@query(
    "match_barcodes", "reads:i matched_reads:i match_rate:d6 passed:b",
    """select count(*) as reads, count(*) filter (where barcode in (select barcode from {known_spots})) as matched_reads,
              count(*) filter (where barcode in (select barcode from {known_spots})) / count(*) as match_rate,
              count(*) filter (where barcode in (select barcode from {known_spots})) / count(*) >= 0.95 as passed
       from {tagged_reads}""",
)
def match_barcodes(t):
    return R.match_barcodes(t.tagged_reads, t.known_spots)


@query(
    "barcode_mismatches", "barcode:s reads:i",
    """select barcode, count(*) as reads from {tagged_reads}
       where barcode not in (select barcode from {known_spots}) group by barcode""",
)
def barcode_mismatches(t):
    return R.barcode_mismatches(t.tagged_reads, t.known_spots)


@query(
    "umi_duplication_rate", "reads:i molecules:i duplication_rate:d6 passed:b",
    """select count(*) as reads, count(distinct (barcode, gene, umi)) as molecules,
              1 - count(distinct (barcode, gene, umi)) / count(*) as duplication_rate,
              1 - count(distinct (barcode, gene, umi)) / count(*) <= 0.1 as passed from {tagged_reads}""",
)
def umi_duplication_rate(t):
    return R.umi_duplication_rate(t.tagged_reads)


@query(
    "count_umis", "barcode:s gene:s count:i",
    "select barcode, gene, count(distinct umi) as count from {tagged_reads} group by barcode, gene",
)
def count_umis(t):
    return R.count_umis(t.tagged_reads)


@query(
    "alignment_stats",
    "total_reads:i uniquely_mapped:i multi_mapped:i unmapped:i alignment_rate:d6 unique_mapping_rate:d6",
    """with per_read as (select read_id, max(nh) as nh from {alignments} group by read_id)
       select count(*) as total_reads, count(*) filter (where nh = 1) as uniquely_mapped,
              count(*) filter (where nh > 1) as multi_mapped, count(*) filter (where nh = 0) as unmapped,
              count(*) filter (where nh >= 1) / count(*) as alignment_rate,
              count(*) filter (where nh = 1) / count(*) as unique_mapping_rate from per_read""",
)
def alignment_stats(t):
    return R.alignment_stats(t.alignments)


@query(
    "read_composition", "mate:i reads:i mean_length:d6 gc_percent:d6 mean_quality:d6",
    f"""with {_CHECKED}
    select mate, count(*) as reads, avg(length(sequence)) as mean_length,
           100.0 * sum(length(translate(sequence, 'AT', ''))) / sum(length(sequence)) as gc_percent, avg(q) as mean_quality
    from checked group by mate""",
)
def read_composition(t):
    return R.read_composition(t.reads)


@query(
    "quality_histogram", "mean_phred:i reads:i",
    f"with {_CHECKED} select floor(q) as mean_phred, count(*) as reads from checked group by floor(q)",
)
def quality_histogram(t):
    return R.quality_histogram(t.reads)
