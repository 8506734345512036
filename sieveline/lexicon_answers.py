"""Terms of the answer gates.  All of them are fixed values."""

from __future__ import annotations

INTENT_TERMS = {
    "response": ["response", "responder", "nonresponder", "efficacy", "benefit", "predict", "predictive"],
    "resistance": ["resistance", "resistant", "refractory", "escape", "acquired", "primary resistance"],
    "survival": ["survival", "overall survival", "os", "pfs", "progression-free", "hazard ratio", "hr"],
    "biomarker": ["biomarker", "marker", "predictive", "prognostic", "wild-type", "mutant", "mutation"],
    "trial": ["phase i", "phase ii", "phase iii", "randomized", "trial", "cohort"],
}
DEFAULT_INTENT_TERMS = ["response", "resistance", "efficacy", "survival", "predictive", "prognostic"]
LABEL_TERMS = {
    "Colon_Cancer": ["colon", "colorectal", "crc", "rectal", "mcrc"],
    "Lung_Cancer": ["lung", "nsclc", "sclc", "pulmonary"],
    "Thyroid_Cancer": ["thyroid", "ptc", "ftc", "mtc", "atc", "dtc"],
}
CLINICAL = ["phase i", "phase ii", "phase iii", "randomized", "trial", "patients", "cohort", "overall survival", "pfs", "os", "response rate", "safety"]
PRECLINICAL = ["xenograft", "in vivo", "in vitro", "cell line", "murine", "mouse", "rat", "tumor model"]
AE_SIGNS = [
    "adverse", "adverse event", "ae", "toxicity", "immune-related", "grade", "safety", "pneumonitis", "colitis", "rash",
    "hepatitis", "endocrine", "nephritis", "side effect", "dose reduction", "discontinuation",
]
AE_QUESTION = [
    "adverse", "adverse effect", "adverse event", "toxicity", "toxic", "side effect", "safety", "immune-related", "irae",
    "pneumonitis", "colitis", "hepatitis", "rash", "endocrine", "nephritis", "dose reduction",
]
AE_NEED = ["adverse", "side effect", "toxicity", "safety"]
CLINICAL_NEED = ["clinical", "trial", "phase", "patients", "cohort", "randomized"]
AGENT_KEYWORDS = {"Thyroid_Cancer": ["thyroid"], "Colon_Cancer": ["colon", "colorectal", "crc"], "Lung_Cancer": ["lung", "nsclc"]}
SUBJECT_HEADINGS = {"Colon_Cancer": "colorectal neoplasms", "Lung_Cancer": "lung neoplasms", "Thyroid_Cancer": "thyroid neoplasms"}
QUERY_STOP = "what which how does are the for with that this from".split()
NO_PASSAGES = "Insufficient context: no retrieved passages were provided."
NO_SOURCES = "Insufficient context: no relevant passages found in local index or PubMed."
