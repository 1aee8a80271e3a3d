"""Lexicon tags of captions, vocabularies of modalities, clean-up of generated texts and small text metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import bound, is_blank, squeeze

# A modality and the pattern of a caption that names it; earlier ones win.
MODALITIES = [
    ("fmri", r"\bfunctional MRI\b|\bfMRI\b|\bBOLD\b|resting[- ]state"),
    ("mri", r"\bMRI\b|\bMR imaging\b|magnetic resonance|\bT1[- ]weighted|\bT2[- ]weighted|\bFLAIR\b|\bDWI\b|\bADC map"),
    ("ct", r"\bCT\b|computed tomograph|\bCTA\b|\bHRCT\b|\bCBCT\b|cone[- ]beam"),
    ("pet_spect", r"\bPET\b|\bSPECT\b|\bFDG\b|scintigraph|radionuclide|\bPET/CT\b|\bPET-CT\b"),
    ("mammography", r"mammogra|\btomosynthes"),
    ("angiography", r"angiogra|\bDSA\b|arteriogra|venogra|coronary angio"),
    ("ultrasound", r"ultrasound|ultrasonograph|\bUS image\b|sonogra|echocardiogra|\bdoppler\b"),
    ("xray", r"\bx-?ray\b|radiograph|\bCXR\b|\bKUB\b|fluoroscop|orthopantomogram|\bOPG\b"),
]
# The other specialties and the pattern of a caption that names each; earlier ones win.
SPECIALTIES = [
    ("pathology", r"histopatholog|histolog|\bH&E\b|haematoxylin|hematoxylin|immunohistochem|\bIHC\b|cytolog|biopsy specimen|\bgross (?:specimen|pathology)|microscopic examination|magnification\s*[x×]?\s*\d+|\b\d+\s*[x×]\s*magnif"),
    ("ophthalmology", r"fundus|retinal? (?:image|photograph|scan)|\bOCT\b|slit[- ]lamp|optic (?:disc|nerve head)|fluorescein angiogra|cornea|anterior segment"),
    ("endoscopy", r"endoscop|colonoscop|gastroscop|bronchoscop|laparoscop|arthroscop|cystoscop|hysteroscop|\bEGD\b|capsule endoscop"),
    ("dermatology", r"dermoscop|dermatoscop|skin lesion|cutaneous|\brash\b|erythema|papule|plaque|pustule|clinical photograph of the skin"),
    ("physiological_signals", r"\bECG\b|\bEKG\b|electrocardiogra|\bEEG\b|electroencephalogra|\bEMG\b|spirometr|waveform|polysomnogra"),
    ("microscopy_nonpathology", r"electron microscop|\bSEM\b|\bTEM\b|confocal|fluorescence microscop|immunofluorescen|scanning electron|transmission electron|\bDAPI\b|\bGFP\b|\bmCherry\b|phalloidin|\bDIC\b|bright[- ]?field|phase[- ]contrast|scale bar|\bum\b scale|stained with|counterstain|cell culture|cultured cells|\bin vitro\b|transfected|knockdown|immunostain|\bWB\b|colony formation|flow cytometr"),
    ("clinical_photography", r"intraoperative photograph|clinical photograph|gross appearance|surgical (?:field|specimen|photograph|view)|pre-?operative photograph|post-?operative photograph|intra-?operative (?:view|image|finding)|occlusal view|intra-?oral|extra-?oral|clinical (?:image|view|appearance|photo)|macroscopic (?:view|appearance)|resected specimen|excised specimen|operative field|photograph of the (?:patient|lesion|wound|limb|face)|wound|prosthes[ie]s in place|cast|physical examination"),
]
# A sure sign of radiology without a modality, and of something that is not medical.
GENERIC = r"\bradiolog|\bimaging (?:study|studies|finding)|axial|coronal|sagittal|contrast[- ]enhanc|\bmyelogra|\burogra|\bcholangiogra"
NOT_MEDICAL = r"\b(?:flow ?chart|flowchart|schematic|study design|consort diagram|bar (?:chart|graph)|scatter ?plot|kaplan[- ]meier|forest plot|box ?plot|histogram|western blot|gel electrophoresis)\b"


#: Every lexicon in the order in which they count: specialty, modality, confidence and pattern.
LEXICONS = [("radiology", name, "high", pattern) for name, pattern in MODALITIES] + [(name, None, "high", pattern) for name, pattern in SPECIALTIES]
LEXICONS += [("radiology", "radiology_other", "low", GENERIC), ("non_medical", None, "low", NOT_MEDICAL)]


@F.arrow_udf(T.IntegerType())
def _may_match(texts: pa.Array) -> pa.Array:
    """A bit for each lexicon that may match. Arrow's expressions take time in proportion to a text, whatever the number of
    words; they find all that Java's do, which decide: their words end at every letter that is not ASCII, and their white space
    is made to have the vertical tab."""
    bits = pa.array(np.zeros(len(texts), np.int32))
    for i, (*_, pattern) in enumerate(LEXICONS):
        found = pc.match_substring_regex(texts, pattern.replace(r"\s", r"[\s\x0B]"), ignore_case=True)
        bits = pc.bit_wise_or(bits, pc.multiply(pc.fill_null(found, False).cast(pa.int32()), pa.scalar(1 << i, pa.int32())))
    return bits


def tag(text: Column) -> Column:
    """specialty, modality, confidence and evidence of a caption, or null; the first lexicon that matches wins."""
    entry = lambda t, specialty, modality, sure, pattern: F.struct(F.lit(specialty).alias("specialty"), F.lit(modality).cast("string").alias("modality"), F.lit(sure).alias("confidence"), F.substring(F.regexp_extract(t, f"(?i)({pattern})", 1), 1, 40).alias("evidence"))

    def first(p: Column) -> Column:
        case = F
        for i, rule in enumerate(LEXICONS):
            case = case.when((p["bits"].bitwiseAND(1 << i) != 0) & p["t"].rlike(f"(?i)({rule[3]})"), entry(p["t"], *rule))
        return case

    return bound(first, t=text, bits=_may_match(text))


def tag_caption(own: Column, parent: Column) -> Column:
    """The tag of a caption or, at low confidence, of its parent's; ``source`` says which. Without either: unknown."""
    fields = lambda t, sure, source: F.struct(t["specialty"].alias("specialty"), t["modality"].alias("modality"), sure.alias("confidence"), t["evidence"].alias("evidence"), F.lit(source).alias("source"))
    none = F.lit(None).cast("string")
    unknown = F.struct(F.lit("unknown").alias("specialty"), none.alias("modality"), none.alias("confidence"), none.alias("evidence"), none.alias("source"))
    chosen = lambda p: F.when(p["mine"].isNotNull(), fields(p["mine"], p["mine"]["confidence"], "own")).when(p["theirs"].isNotNull(), fields(p["theirs"], F.lit("low"), "parent")).otherwise(unknown)
    return bound(chosen, mine=tag(own), theirs=tag(parent))


def one_modality(found: Column) -> Column:
    """The only value of an array without its nulls and repeats; null if there are none or several."""
    kinds = F.array_distinct(F.filter(found, lambda x: x.isNotNull()))
    return F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0)))


# The marks that a generator of grounded reports leaves in its text.
MARKS = (r"\[[^\[\]]*:[^\[\]]*\]", r"<box>.*?</box>", r"<ref>", r"</ref>", r"\*+")


def clean_generated(text: Column) -> Column:
    """A generated report without grounding marks, as one line; null stays null."""
    for mark in MARKS:
        text = F.regexp_replace(text, mark, "")
    return squeeze(text)


def usable_pair(reference: Column, hypothesis: Column) -> Column:
    """Both texts have something to score."""
    return ~is_blank(reference) & ~is_blank(hypothesis)


def shingles(words: Column, n: int) -> Column:
    """The distinct runs of n words; of fewer words, none."""
    last = F.size(words) - (n - 1)
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def ngram_precision(hypothesis: Column, reference: Column, n: int) -> Column:
    """The share of the distinct n-grams of a text that its reference has; null without any."""
    own, theirs = shingles(hypothesis, n), shingles(reference, n)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, theirs)) / F.size(own))
