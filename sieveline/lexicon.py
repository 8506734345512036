"""Word lists, patterns and parameters.  All of them are fixed values: results depend on them as they stand."""

from __future__ import annotations

from dataclasses import dataclass, field

# Entity patterns.
CHECKPOINT = r"\b(PD-?1|PD-?L1|CTLA-?4|LAG-?3|TIM-?3|TIGIT)\b"
PATHWAY = r"\b(MAPK|PI3K/?AKT|AKT|mTOR|WNT|TGF-?β|TGF-?B|JAK/?STAT|NF-?κB|NF-?KB)\b"
DRUG = r"\b[a-zA-Z][a-zA-Z\-]{3,40}(?:nib|tinib|mab|zumab|ximab|umab|cept|parib|ciclib|platin|taxel|cycline)\b"
CELL_LINE = r"\b(?:[A-Z]\d{3,5}|H\d{3,5}|HCC\d{3,5}|NCI-?H\d{2,4}|PC-?9)\b"
DIAGNOSTIC = r"\b(IHC|FISH|PCR|qPCR|ELISA|NGS|WES|RNA-?seq|microarray|immunohistochem)\b"
ENDPOINT = r"\b(OS|PFS|DFS|RFS|ORR|DCR|HR|CI|AUC|Cmax|Tmax|t1/2|half-?life|PK|PD|ICER|QALY)\b"
IMAGING = r"\b(PET/?CT|CT|MRI|DWI|FDG|SUV|max)\b"
GENE = r"\b[A-Z]{2,}[A-Z0-9]{0,8}\b"
GENE_LOOSE = r"\b[A-Z][A-Z0-9]{1,9}\b"
GENE_STOP = (
    "CI SD SE NS NA USA BMC AJCC WHO SEER CT MRI PET FDG SUV FIG TABLE SUPP ETAL I II III IV V VI DNA RNA MRNA "
    "OS PFS DFS RFS ORR DCR HR PK PD AUC"
).split()

# The labels' terms, in order of priority where the order decides.
LABEL_TERMS = {
    "Colon_Cancer": {
        "must": ["colorectal", "colon", "rectal", "rectum", "crc", "mcrc", "sigmoid", "cecum", "caecum", "large intestine", "bowel"],
        "anti": ["thyroid", "papillary thyroid", "follicular thyroid", "medullary thyroid", "nsclc", "sclc", "non-small cell lung", "small cell lung", "pulmonary"],
    },
    "Lung_Cancer": {
        "must": ["lung", "pulmonary", "nsclc", "sclc", "non-small cell", "small cell", "lung adenocarcinoma", "squamous cell lung"],
        "anti": ["thyroid", "papillary thyroid", "follicular thyroid", "medullary thyroid", "colon", "colorectal", "rectal", "crc"],
    },
    "Thyroid_Cancer": {
        "must": [
            "thyroid", "papillary thyroid", "follicular thyroid", "medullary thyroid", "anaplastic thyroid", "differentiated thyroid",
            "ptc", "ftc", "mtc", "atc", "dtc", "thyroid cancer", "thyroid carcinoma", "papillary thyroid carcinoma",
            "follicular thyroid carcinoma", "medullary thyroid carcinoma", "anaplastic thyroid carcinoma", "calcitonin",
            "thyroglobulin", "tsh", "ret proto-oncogene", "thyroidectomy",
        ],
        "anti": ["nsclc", "sclc", "lung", "pulmonary", "colon", "colorectal", "rectal", "crc"],
    },
}
LABEL_KEYWORDS = {
    "Thyroid_Cancer": ["thyroid", "papillary", "follicular", "medullary", "anaplastic"],
    "Colon_Cancer": ["colon", "colorectal", "crc", "rectal"],
    "Lung_Cancer": ["lung", "nsclc", "sclc", "adenocarcinoma", "squamous"],
}
LABEL_PATTERNS = {
    "Thyroid_Cancer": r"\bthyroid cancer\b|\bthyroid carcinoma\b|\bpapillary thyroid\b|\bfollicular thyroid\b|\bmedullary thyroid\b|\banaplastic thyroid\b|\bptc\b|\bftc\b|\bmtc\b|\batc\b",
    "Lung_Cancer": r"\blung cancer\b|\bnsclc\b|\bsclc\b|\blung carcinoma\b|\badenocarcinoma of the lung\b|\bsquamous cell lung\b",
    "Colon_Cancer": r"\bcolon cancer\b|\bcolorectal cancer\b|\brectal cancer\b|\bcrc\b|\bmcrc\b",
}

# Intents in order; the first that matches is the query's.
INTENTS = {
    "cost_effectiveness": r"\b(cost|cost-?effect|icer|qaly)\b",
    "pharmacokinetics": r"\b(pharmacokinetic|pharmacodynamic|\bpk\b|\bpd\b|auc|cmax|tmax|half-?life|t1/2)\b",
    "trial_design": r"\b(trial|phase\s*(i|ii|iii|iv)|randomi[sz]ed|double-?blind|placebo|cohort|observational|real-?world)\b",
    "efficacy_outcomes": r"\b(efficacy|response rate|orr|dcr|os|pfs|dfs|hazard ratio|hr)\b",
    "adverse_events": r"\b(adverse event|toxicity|safety|grade\s*[34]|ctcae)\b",
    "immune_therapy": r"\b(checkpoint|immunotherapy|pd-?1|pd-?l1|ctla-?4|tigit|lag-?3)\b",
    "resistance": r"\b(resistance|resistant|escape|reversal|mechanism)\b",
    "mutations": r"\b(mutation|mutations|variant|variants|kras|braf|egfr|alk|tp53|fusion|rearrangement)\b",
    "biomarkers_dx": r"\b(biomarker|diagnos|screen|sensitivity|specificity|roc|auroc)\b",
    "prognosis_signatures": r"\b(signature|signatures|gene-?expression|multigene|prognos)\b",
    "multi_omics": r"\b(multi-?omics|proteomic|transcriptomic|genomic|metabolomic|integrat|rna-?seq)\b",
    "models_cell_lines": r"\b(xenograft|mouse|mice|in vivo|animal model|cell line|in vitro|a549|h1975|hcc827)\b",
    "surgery": r"\b(surger|resection|laparoscop|tme|lymph node dissection)\b",
    "radiation": r"\b(radiotherap|sabr|sb rt|stereotactic|irradiat)\b",
    "epigenetics": r"\b(methylation|epigenet|histone|chromatin)\b",
    "microbiome": r"\b(microbiome|microbiota)\b",
    "prevention_risk": r"\b(risk factor|lifestyle|smoking|diet|prevention)\b",
}
SECTION_BIAS = {
    "pharmacokinetics": {"METHODS": 0.25, "MATERIALS AND METHODS": 0.25, "RESULTS": 0.15, "DISCUSSION": 0.05},
    "cost_effectiveness": {"RESULTS": 0.20, "DISCUSSION": 0.15, "METHODS": 0.10},
    "trial_design": {"METHODS": 0.25, "RESULTS": 0.15, "DISCUSSION": 0.05},
    "efficacy_outcomes": {"RESULTS": 0.25, "DISCUSSION": 0.10, "METHODS": 0.05},
    "adverse_events": {"RESULTS": 0.20, "METHODS": 0.10, "DISCUSSION": 0.10},
    "immune_therapy": {"RESULTS": 0.20, "DISCUSSION": 0.15, "INTRODUCTION": 0.05},
    "resistance": {"RESULTS": 0.20, "DISCUSSION": 0.20, "METHODS": 0.10},
    "mutations": {"RESULTS": 0.20, "METHODS": 0.15, "DISCUSSION": 0.10},
    "biomarkers_dx": {"RESULTS": 0.20, "METHODS": 0.15, "DISCUSSION": 0.10},
    "prognosis_signatures": {"RESULTS": 0.20, "DISCUSSION": 0.20, "METHODS": 0.10},
    "multi_omics": {"METHODS": 0.20, "RESULTS": 0.20, "DISCUSSION": 0.10},
    "models_cell_lines": {"METHODS": 0.25, "MATERIALS AND METHODS": 0.25, "RESULTS": 0.10},
    "surgery": {"METHODS": 0.20, "RESULTS": 0.20, "DISCUSSION": 0.10},
    "radiation": {"METHODS": 0.15, "RESULTS": 0.20, "DISCUSSION": 0.15},
    "epigenetics": {"RESULTS": 0.20, "DISCUSSION": 0.15, "METHODS": 0.10},
    "microbiome": {"RESULTS": 0.20, "DISCUSSION": 0.15, "INTRODUCTION": 0.05},
    "prevention_risk": {"RESULTS": 0.15, "DISCUSSION": 0.20, "INTRODUCTION": 0.10},
    "general": {"RESULTS": 0.10, "DISCUSSION": 0.10},
}
SECTION_PENALTY = {
    "REFERENCES": -0.40, "ACKNOWLEDGEMENTS": -0.50, "ACKNOWLEDGMENTS": -0.50, "FUNDING": -0.50, "CONFLICT OF INTEREST": -0.50,
    "COMPETING INTERESTS": -0.50, "DATA AVAILABILITY": -0.30, "SUPPLEMENTARY INFORMATION": -0.30, "SUPPLEMENTARY MATERIAL": -0.30,
    "TRIAL REGISTRATION": -0.30, "UNKNOWN": -0.05, "ABSTRACT": -0.05,
}
CONTENT_SECTIONS = ["ABSTRACT", "INTRODUCTION", "BACKGROUND", "RESULTS", "DISCUSSION", "CONCLUSION", "UNKNOWN"]
CITATION_QUERY = r"\b(cite|citation|citations|reference|references|bibliograph|pmid|doi|pubmed)\b"
RESISTANCE_EVIDENCE = r"\b(resistan|refractor|escape|non[- ]?respond|sensitiz|overcome)\w*"

# Section headings and the substrings that show one.
HEADING_HINTS = ["abstract", "introduction", "background", "methods", "materials and methods", "results", "discussion", "conclusion", "conclusions", "references"]
UNFLATTEN_HEADINGS = [
    "ABSTRACT", "BACKGROUND", "INTRODUCTION", "OBJECTIVE", "OBJECTIVES", "METHODS", "MATERIALS AND METHODS",
    "PATIENTS AND METHODS", "RESULTS", "DISCUSSION", "CONCLUSION", "CONCLUSIONS", "LIMITATIONS", "FUNDING",
    "CONFLICT OF INTEREST", "ACKNOWLEDGEMENTS", "REFERENCES", "BIBLIOGRAPHY", "REFERENCE LIST", "LITERATURE CITED",
    "WORKS CITED", "REFERENCES AND NOTES",
]
CHUNK_HEADINGS = UNFLATTEN_HEADINGS[:18]
SKIP_SECTIONS = [
    "ACKNOWLEDGEMENTS", "ACKNOWLEDGMENTS", "FUNDING", "CONFLICT OF INTEREST", "COMPETING INTERESTS", "DATA AVAILABILITY",
    "AVAILABILITY OF DATA AND MATERIALS", "CONSENT", "CONSENT FOR PUBLICATION", "TRIAL REGISTRATION",
    "PROVENANCE AND PEER REVIEW", "SUPPLEMENTARY MATERIAL", "SUPPLEMENTARY INFORMATION",
]
DEEP_CLEAN_HEADING_HINTS = ["ABSTRACT", "INTRODUCTION", "METHODS", "RESULTS", "DISCUSSION", "CONCLUSION", "REFERENCES"]
MOJIBAKE_HINT = "(Ã|â€™|â€“|â€œ|â€|�)"
MOJIBAKE_HINTS = ["Ã", "â€", "�"]
YEAR_HINT = r"\b(19|20)\d{2}[a-z]?\b"

# Lines and parts that cleaning removes.
BOILERPLATE_LINE = (
    r"^\s*(?:.*\b[\w\.-]+@[\w\.-]+\.\w+\b.*|.*\b\d{4}-\d{4}-\d{4}-\d{3}[\dX]\b.*|.*(?:https?://\S+|www\.\S+).*|.*\bdoi:\s*\S+.*|"
    r".*\b(vol(?:ume)?\s+\d+|issue\s+\d+|page\s+\d+)\b.*|.*(creative\s+commons|open\s+access|cc[-\s]?by|all\s+rights\s+reserved|copyright).*)\s*$\n?"
)
# One of these stands in every boilerplate line, the numbered ones with a digit; letters that fold to ASCII ones count.
BOILERPLATE_PARTS = ["@", "http", "www.", "doi:", "creative", "access", "cc", "reserved", "copyright", "ſ", "\u212a", "ı", "i̇"]
BOILERPLATE_NUMBERED = ["vol", "issue", "page", "-"]
JUNK_LINE = (
    r"^\s*(?:submit\s+your\s+manuscript\b.*|(?:https?://|www\.)\S+.*|.*\bdovepress\b.*|.*\bplos\s+one\b.*|.*\bjournalpone\d+\b.*|"
    r".*\bmdpi\b.*|.*\bhindawi\b.*|.*\bspringer\b.*|.*\bwiley\b.*|.*\belsevier\b.*|.*\bfrontiers\b.*)\s*$\n?"
)
SUPPLEMENT_BLOCK = r"\b(?:additional\s+file|supplementary\s+(?:material|appendix|table|figure)|(?:figure|table)\s*s\d+)\b.*?(?:\n\n|$)"
FIGURE_INLINE = r"\((?:see\s+)?(figure|fig\.?|table)\s*\d+[a-z]?(?:[^)]*)\)"
FIGURE_AS_SHOWN = r"\b(as\s+shown\s+in|shown\s+in|see)\s+(figure|fig\.?|table)\s*\d+[a-z]?\b[^\.]*\."
FIGURE_LABEL = r"\b(figure|fig\.?|table)\s*\d+[a-z]?\b[:\.\)]?"
TABLE_DUMP = r"\n(?:table\s*\d+[^\n]*\n)?(?:[^\n]*\d+[^\n]*\n){6,}"
TABLE_DUMP_ONCE = r"\n(?:table\s*\d+[^\n]*\n)?(?:[^\n\d]*+\d[^\n]*+\n){6,}+"
CITE_BRACKET = r"\[\s*\d+(?:\s*[\-,–]\s*\d+)?(?:\s*,\s*\d+(?:\s*[\-,–]\s*\d+)?)?\s*\]"
CITE_PAREN = r"\(\s*\d+(?:\s*,\s*\d+)*\s*\)"
CITE_AUTHOR_PAREN = r"\(\s*[A-Z][A-Za-z'’\-]+(?:\s+et\s+al\.?)?\s*,\s*\d{4}[a-z]?\s*\)"
CITE_AUTHOR = r"\b[A-Z][A-Za-z'’\-]+(?:\s+et\s+al\.?)?\s*\(\s*\d{4}[a-z]?\s*\)"
CITE_DOI = r"(?i)\bdoi\s*:\s*\S+|\b10\.\d{4,9}/\S+\b"
TAIL_CUTS = [
    r"\nREFERENCES\b", r"\nREFERENCE\b", r"\nBIBLIOGRAPHY\b", r"\nLITERATURE\s+CITED\b", r"\nACKNOWLEDGMENT[S]?\b",
    r"\nDECLARATION[S]?\b", r"\nCONFLICT[S]?\s+OF\s+INTEREST\b", r"\nAUTHOR[S]?\s+CONTRIBUTION[S]?\b",
]
TAIL_BEGINS = r"\n(?:REF|BIB|LIT|ACK|DEC|CON|AUT)"
TAIL_CHARS = 20_000
JUNK_TRIGGERS = ["dovepress", "plos", "journalpone", "submit your manuscript", "supplement", "additional file", "http", "www."]

# Spacing repair of the second pass.
OCR_GARBAGE = r"\b(0cnoitavonn|cnoitavonn|0cxu|0cli|Ieh|ehT)\b"
JOINED_AFTER = "of the and or to in for with from by as at on into over under between after before during within without among through via per".split()
JOINED_BEFORE = "of the and or in to for with by from as at on".split()
DRUG_BOUNDARY = r"\b([a-zA-Z]{4,}(?:nib|mab|ciclib|parib|tinib|zumab|ximab|umab|cept))([a-z]{2,})\b"
SUFFIX_SPLITS = {
    "cell": "carcinoma lines line culture cultures", "thyroid": "cancer carcinoma tumor tumour", "lung": "cancer carcinoma",
    "colon": "cancer carcinoma", "breast": "cancer carcinoma", "prostate": "cancer carcinoma", "high": "resolution risk grade",
    "low": "risk grade", "multi": "omics center centre drug", "micro": "environment biome biota",
}
COMMON_SUFFIX = r"\b([a-z]{4,})(patients|analysis|outcomes|therapy|carcinoma|disease|syndrome|screening|satisfaction)\b"

# Signs of reference lists, tables and other junk.
WEIRD_PARTS = ["cnoitavonn", "ie h t", "ieh t", "0cxu", "0cnoitav"]
REF_CUE = (
    r"\b(references|bibliography|et al|doi|pmid|arxiv|preprint|copyright|springer|elsevier|wiley|nature\.com|sciencedirect|"
    r"vol\.?\s*\d+|issue\s*\d+|\b\d+\s*\(\d+\)\s*:\s*\d+)\b"
)
AUTHOR_PAIR = r"\b[a-z]{2,}\s+[a-z]{1,3}(?=\s*[,;])"
JOURNALISH = r"\b(health\s+qual\s+life\s+outcomes|clin(?:ical)?\s+cancer\s+res|j\s+clin\s+oncol|proc\s+natl\s+acad\s+sci|lancet|radiother\s+oncol|int\s+j\s+radiat)\b"
YEAR = r"\b(19|20)\d{2}\b"
FIG_TABLE_NOISE = r"\b(fig(?:ure)?|table)\s*\d+\b"
PAGE_ARTIFACT = r"\b(page|diagnostic pathology)\b"
OCR_CODE = r"\b0\s*cli\b|\b0c[a-z]{2,}\b"
URL = r"(www\.|https?://)"
CAPTION = r"^\s*(table|figure)\s*\d+\b"
ASSAY_TABLE = "(ic50|abts|frap|trolox|equivalents|assay)"
PUBLISHER_HEADER = r"(scientific\s*reports|nature\.com|vol\d{3,}|issn)"
TABLE_SIGN = r"(table\s*\d|figure\s*\d|t00\d|journal\w+|dbcond\d{6,})"
JOURNAL_HINTS = [
    "bmj", "lancet", "ann oncol", "jama", "n engl j med", "clin oncol", "head neck", "esmo", "nat rev", "jco", "pediatr",
    "crit care", "cancer res", "cancer sci", "j clin oncol", "j clin pathol", "nature", "cell", "proc natl acad sci", "plos",
    "oncology",
]
# Signs of a reference list; their points stand beside them.
REF_DOI = r"\bdoi\b|10\.\d{4,9}/\S+"
REF_LINK = r"\bhttps?://|www\."
REF_PMC = r"\bpmc\d+\b"
REF_PMID = r"\bpmid\b|\b\d{7,8}\b"
REF_ET_AL = r"\bet\s+al\.?\b"
REF_AUTHOR = r"\b[A-Z][a-z]+(?:['-][A-Z][a-z]+)?\s+[A-Z]{1,3}\b"
REF_AUTHOR_PREFIX = r"\b(?:van|von|de|del|di|da)\s+[A-Z][a-z]+\b"
REF_NUMBERED_LINE = r"(^|\n)\s*(\[\d{1,3}\]|\d{1,3}[.)])\s+"
REF_BRACKET = r"\[\d{1,3}\]"
REF_ISSUE = r"\b\d{1,3}\s*\(\s*\d{1,3}\s*\)\s*:\s*\d{1,4}\s*[-–]\s*\d{1,4}\b"
REF_RANGE = r"\b\d{1,4}\s*[-–]\s*\d{1,4}\b"
STOPWORD_GLUE = r"\b[a-z]{5,}(?:of|the|and|in|to|for|with|by)[a-z]{3,}\b"
TABLEISH_LINE = r"(?i)^\s*(table\s*\d+|fig(?:ure)?\s*\d+)\b"
MANY_NUMBERS = r"(?:\d[\d\.\-\(\)%/]*\s+){8,}"
PIPE_TABLE = r"\|(?:[^|\n]+\|){2,}"
REPEATED_SEPARATOR = "[-_]{6,}|={6,}"
BAD_KEY_SENTENCE = r"\b(preprint|doi|http|https|www|copyright|license)\b"


@dataclass(frozen=True)
class Retrieval:
    """Weights of the ranked retrieval."""

    top_n_dense: int = 200
    top_n_bm25: int = 200
    top_k: int = 10
    max_per_paper: int = 1
    max_per_hash: int = 1
    bm25_div: float = 20.0
    bm25_weight_no_entities: float = 0.10
    bm25_weight_with_entities: float = 0.25
    entity_bonus_per_hit: float = 0.03
    entity_bonus_cap: float = 0.25
    rerank_weight: float = 0.18
    rerank_min_entities: int = 2
    req_hits_bonus_per_hit: float = 0.06
    req_hits_bonus_cap: float = 0.25
    generic_penalty: float = -0.10
    present_per_hit: float = 0.10
    present_cap: float = 0.30
    absent_strong_penalty: float = -0.60
    absent_weak_penalty: float = -0.25
    mismatch_strong_penalty: float = 0.35
    mismatch_weak_penalty: float = 0.20
    must_strong_other_penalty: float = 0.60
    must_weak_other_penalty: float = 0.30
    must_generic_penalty: float = 0.15
    reference_section_penalty: float = 0.12
    reference_flag_penalty: float = 0.45


@dataclass(frozen=True)
class Chunking:
    target: int = 320
    overlap: int = 80
    min_paragraph: int = 80
    min_chunk: int = 160
    min_final: int = 180
    max_final: int = 650
    slack: int = 80
    min_section: int = 120
    min_doc_words: int = 200


@dataclass(frozen=True)
class Agent:
    local_score_threshold: float = 0.55
    local_min_hits: int = 2
    max_external: int = 6
    abstract_chars: int = 1200
    entity_min_len: int = 3


@dataclass(frozen=True)
class Generation:
    max_contexts: int = 6
    min_answer_sentences: int = 3
    max_answer_sentences: int = 5
    entity_weight: float = 1.5
    label_weight: float = 1.0
    intent_weight: float = 1.5
    entity_default: float = 0.4
    label_default: float = 0.5
    clinical_match_bonus: float = 0.7
    clinical_mismatch_penalty: float = -0.7
    clinical_unknown_penalty: float = -0.2
    ae_match_bonus: float = 0.7
    ae_mismatch_penalty: float = -0.4
    filter_min_score: float = 1.6
    filter_keep: int = 6
    filter_fallback: int = 4
    min_signals: int = 2


@dataclass(frozen=True)
class Lexicon:
    """The label vocabulary that retrieval and detection use; another corpus brings its own."""

    terms: dict[str, dict[str, list[str]]] = field(default_factory=lambda: LABEL_TERMS)
    keywords: dict[str, list[str]] = field(default_factory=lambda: LABEL_KEYWORDS)
    patterns: dict[str, str] = field(default_factory=lambda: LABEL_PATTERNS)
