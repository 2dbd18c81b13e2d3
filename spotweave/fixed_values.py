"""Names, limits and small catalogs that the operators' contracts prescribe."""

# QC defaults: reads, genes, percent mitochondrial
MIN_READS_PER_SPOT = 1000
MIN_GENES_PER_SPOT = 200
MAX_MT_PERCENT = 20.0
MT_PREFIX = "MT-"

# FASTQ
PHRED_OFFSET = 33
MIN_BASE_QUALITY = 20
UMI_LENGTH_RANGE = (4, 20)
SAMPLE_READS = 10000

# Visium read layout: barcode 1-16, UMI 17-28
BARCODE_LENGTH = 16
UMI_LENGTH = 12

MERGE_MODES = ("average", "max", "first")
TEST_METHODS = ("wilcoxon", "t_test", "deseq2")
COHORT_TESTS = ("t_test", "wilcoxon", "z_score")
BATCH_METHODS = ("combat", "harmony", "scanorama")
NORMALIZATIONS = ("TPM", "FPKM", "counts")
TISSUE_TYPES = ("primary_tumor", "normal", "metastatic")
GENE_SET_DATABASES = ("GO_BP", "KEGG", "Reactome", "Hallmark")
ANNOTATION_SOURCES = ("gencode", "ensembl", "refseq")
FEATURE_TYPES = ("texture", "intensity", "morphology")
STAIN_CODES = {"H&E": "he", "IF": "if"}
MUTATION_CLASSES = ("missense", "nonsense", "frameshift", "splice_site")

MIN_LOG_FC = 0.5
ALPHA = 0.05
NEIGHBOURS = 6
PERMUTATIONS = 1000
CLUSTERED_CUT = 0.3
OUTLIER_Z = 1.96
BACKGROUND_GENES = 20000
MIN_CELL_SIZE = 100
EMBEDDING_DIM = 768
SAFE_IDENTIFIER = r"^[a-zA-Z0-9_\-./]+$"
SAFE_LENGTH = 1000

# genome id, assembly, organism, size in MB
GENOMES = (
    ("hg38", "GRCh38", "Homo sapiens", 938),
    ("mm10", "GRCm38", "Mus musculus", 782),
    ("hg19", "GRCh37", "Homo sapiens", 920),
    ("mm39", "GRCm39", "Mus musculus", 785),
    ("rn6", "Rnor_6.0", "Rattus norvegicus", 740),
    ("danRer11", "GRCz11", "Danio rerio", 410),
)

MARKER_GENES = {
    "epithelial": ["EPCAM", "KRT19", "KRT7", "KRT8", "KRT18", "CDH1", "CLDN4", "MUC1"],
    "stromal": ["VIM", "FN1", "COL1A1", "COL1A2", "COL3A1", "ACTA2", "PDGFRA", "FAP"],
    "immune": ["PTPRC", "CD3D", "CD3E", "CD4", "CD8A", "CD19", "CD68", "CD163"],
    "tumor": ["MKI67", "PCNA", "TOP2A", "CCND1", "MYC", "TP53", "KRAS", "PIK3CA"],
    "angiogenesis": ["VEGFA", "PECAM1", "CD34", "FLT1", "KDR"],
}

CELL_STATES = ("proliferating", "quiescent", "apoptotic", "senescent")

# cohort code, name, primary, normal and metastatic sample counts
COHORTS = (
    ("BRCA", "Breast Invasive Carcinoma", 1097, 113, 7),
    ("LUAD", "Lung Adenocarcinoma", 515, 59, 1),
    ("COAD", "Colon Adenocarcinoma", 459, 41, 0),
)

DIAGNOSIS_CODES = (
    ("C50.9", "Malignant neoplasm of breast, unspecified"),
    ("C50.1", "Malignant neoplasm of central portion of breast"),
    ("E11.9", "Type 2 diabetes mellitus without complications"),
    ("E11.65", "Type 2 diabetes with hyperglycemia"),
)

# workflow category, workflow name
WORKFLOWS = (
    ("rnaseq", "nf-core/rnaseq"),
    ("rnaseq", "nf-core/atacseq"),
    ("spatial", "nf-core/spatial"),
    ("spatial", "custom/spatial-transcriptomics"),
    ("variant", "nf-core/sarek"),
    ("variant", "nf-core/variantcalling"),
)

# metric, value to pass, value below which it fails, whether larger is better
QC_THRESHOLDS = (
    ("mean_phred", 30.0, 20.0, True),
    ("alignment_rate", 0.80, 0.60, True),
    ("umi_duplication", 0.10, 0.20, False),
    ("barcode_match", 0.95, 0.80, True),
    ("qc_retention", 0.80, 0.50, True),
    ("spatial_correlation", 0.70, 0.50, True),
    ("confident_predictions", 0.80, 0.60, True),
)
