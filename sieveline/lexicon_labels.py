"""Patterns of the strict label cascade.  All of them are fixed values."""

from __future__ import annotations

CANCER = r"\b(cancer|carcinoma|tumou?r|neoplasm|malignan|metastas(?:is|e|es|ed|ing)?|oncolog|adenocarcinoma)\w*\b"
CORE_PARTS = {
    "Lung_Cancer": [
        r"\blung(s)?\b", r"\bpulmonar(y|ies)\b", r"\bnsclc\b", r"\bsclc\b", r"\bnon[-\s]?small\s+cell\b", r"\bsmall\s+cell\b",
        r"\bbronch(us|ial|ogenic)?\b", r"\bpleura(l)?\b", r"\bthorac(ic|ax)\b", r"\bmesothelioma\b",
    ],
    "Colon_Cancer": [
        r"\bneoplasia\b", r"\bcrn\b", r"\bcolon\b", r"\bcolorectal\b", r"\bcrc\b", r"\brectal\b", r"\bcolonic\b",
        r"\b(sigmoid|cecum|caecum|ileocecal|appendix)\b", r"\blarge\s+intestine\b", r"\bcolonoscopy\b", r"\bpolyp(s)?\b",
        r"\badenoma(s)?\b", r"\b(hnpcc|lynch)\b", r"\bfap\b", r"\bcolorect(al)?\s+carcinoma\b", r"\bcolorectal\s+adenocarcinoma\b",
        r"\brectum\b", r"\bcecal\b", r"\bcolectomy\b", r"\bhemicolectomy\b", r"\bmetastatic\s+colorectal\b",
    ],
    "Thyroid_Cancer": [
        r"\bthyroid\b", r"\bthyroidectomy\b", r"\bthyroglobulin\b", r"\btsh\b", r"\bpapillary\b", r"\bfollicular\b", r"\bmedullary\b",
        r"\banaplastic\b", r"\b(ptc|ftc|mtc|atc)\b", r"\bhashimoto\b", r"\bgraves\b", r"\bdifferentiated\s+thyroid\s+cancer\b",
        r"\bthyroid\s+carcinoma\b", r"\bmetastatic\s+thyroid\b", r"\brai\b", r"\bradioiodine\b", r"\bi[-\s]?131\b", r"\bbethesda\b",
        r"\bfna\b", r"\bfine\s+needle\s+aspiration\b", r"\bbraf\b", r"\bv600e\b", r"\btert\b", r"\bret\b", r"\bnif?tp\b",
        r"\bthy\s*\d\b", r"\bpoorly\s+differentiated\s+thyroid\b",
    ],
}
SECONDARY_PARTS = {
    "Colon_Cancer": [
        r"\bbowel\b", r"\bibd\b", r"\bulcerative\s+colitis\b", r"\bcrohn(?:'s)?\b", r"\bdiverticul(itis|osis)\b",
        r"\b(colon|colorectal)\s+adenocarcinoma\b", r"\bmetastatic\s+colorectal\b", r"\brectum\b", r"\bcecal\b", r"\bcaecal\b",
        r"\bileum\b", r"\bileal\b", r"\bcolectomy\b", r"\bproctectomy\b", r"\bcrc\s+cell\b", r"\bapc\b", r"\bkras\b", r"\bbraf\b",
    ],
    "Thyroid_Cancer": [
        r"\bnodule(s)?\b", r"\bgoit(re|er)\b", r"\bdtc\b", r"\bradioiodine\b", r"\brai\b", r"\bi[-\s]?131\b", r"\bfna\b",
        r"\bfine\s+needle\s+aspiration\b", r"\bbethesda\b", r"\bbraf\b", r"\bv600e\b", r"\btert\b", r"\bret\b",
        r"\blevothyroxine\b", r"\bthyrotoxic\b",
    ],
    "Lung_Cancer": [r"\balveol(ar|i)\b", r"\btrachea(l)?\b", r"\b(emphysema|chronic\s+bronchitis)\b"],
}
LABELS = list(CORE_PARTS)
CORE = {k: "|".join(v) for k, v in CORE_PARTS.items()}
SECONDARY = {k: "|".join(v) for k, v in SECONDARY_PARTS.items()}
CROSS = {
    "Colon_Cancer": CORE["Lung_Cancer"],
    "Lung_Cancer": CORE["Colon_Cancer"],
    "Thyroid_Cancer": CORE["Lung_Cancer"] + "|" + CORE["Colon_Cancer"],
}
NEGATIVE = {"Thyroid_Cancer": r"\b(covid|sars[-\s]?cov[-\s]?2|disinfectant|steriliz|pandemic)\b"}
ONCO_CONTEXT = (
    r"\b(tumou?r|carcinoma|metasta|oncolog|chemotherap|radiotherap|immunotherap|survival|prognos|stage\s+[ivx]+|"
    r"hazard\s+ratio|overall\s+survival|disease[-\s]?free)\b"
)
STRONG = {
    "Thyroid_Cancer": (
        r"\b(thyroid\s+(?:cancer|carcinoma|microcarcinoma|neoplasm|malignan(?:cy|t)|tumou?r)|"
        r"(?:papillary|follicular|medullary|anaplastic|poorly\s+differentiated)\s+thyroid\s+(?:carcinoma|cancer|microcarcinoma)|"
        r"\bDTC\b|\bPTC\b|\bPTMC\b|\bMTC\b|\bATC\b|\bFTC\b)\b"
    ),
    "Colon_Cancer": (
        r"\b(colorectal\s+(?:cancer|carcinoma|adenocarcinoma)|colon\s+(?:cancer|carcinoma|adenocarcinoma)|\bCRC\b|\bHNPCC\b|"
        r"\bLynch\b|\bFAP\b|colectomy|hemicolectomy|colonoscopy)\b"
    ),
    "Lung_Cancer": (
        r"\b(lung\s+(?:cancer|carcinoma)|\bNSCLC\b|\bSCLC\b|non[-\s]?small\s+cell|small\s+cell|pulmonar(?:y|ies)|"
        r"bronch(?:us|ial)|mesothelioma)\b"
    ),
}
OTHER_PRIMARY = (
    r"\b(glioblastoma|astrocytoma|meningioma|breast\s+cancer|mammary\s+carcinoma|prostate\s+cancer|ovarian\s+cancer|"
    r"pancreatic\s+cancer|gastric\s+cancer|stomach\s+cancer|hepatocellular|liver\s+cancer|renal\s+cell|kidney\s+cancer|"
    r"bladder\s+cancer|leukemia|lymphoma|myeloma|mammary|hcc\b|aml\b|cervical cancer|endometrial cancer|glioma|renal cancer|melanoma)\b"
)
NEURO_DISEASE = r"\b(alzheimer|parkinson|dementia|amyotrophic\s+lateral\s+sclerosis|\bALS\b)\b"
