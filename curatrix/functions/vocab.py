"""Controlled vocabularies and their matching. Order counts: the first label or token that fits wins."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabularies: label and accepted tokens. Fixed values.
MODALITIES = {
    "meg": ["meg", "magnetoencephalography", "magnetoencephalogram"],
    "eeg": ["eeg", "electroencephalography", "electroencephalogram"],
    "ieeg": ["ieeg", "intracranial eeg", "intracranial electroencephalography"],
    "ecog": ["ecog", "electrocorticography"],
    "mri": ["mri", "magnetic resonance imaging", "functional nuclear magnetic resonance", "functional nuclear magnetic resonance imaging"],
    "fmri": ["fmri", "functional mri", "functional magnetic resonance imaging"],
    "smri": ["smri", "structural mri", "structural magnetic resonance imaging", "t1-weighted", "t2-weighted"],
    "pet": ["pet", "positron emission tomography"],
    "dti": ["dti", "diffusion tensor imaging", "diffusion-weighted imaging", "diffusion mri"],
    "nirs": ["nirs", "near-infrared spectroscopy"],
    "fnirs": ["fnirs", "functional near-infrared spectroscopy"],
}
TASKS = {
    "resting-state": ["resting state", "resting-state", "resting state fmri", "resting-state fmri", "rs-fmri", "resting state functional mri"],
    "working-memory": ["working memory", "working-memory"],
    "motor": ["motor task", "motor imagery", "motor learning", "finger tapping"],
    "attention": ["attention task", "sustained attention", "selective attention", "divided attention", "visual attention", "attention network test"],
    "language": ["language task", "language processing", "speech production", "sentence comprehension"],
}
AGES = {
    "infant": ["infant", "infants", "newborn", "newborns", "neonatal", "neonates"],
    "child": ["child", "children", "pediatric", "pediatrics", "school-age"],
    "adolescent": ["adolescent", "adolescents", "teenager", "teenagers", "youth"],
    "adult": ["adult", "adults"],
    "elderly": ["elderly", "older adult", "older adults", "older-adult", "geriatric", "aged"],
}
SPECIES = {
    "human": [
        "human", "humans", "participant", "participants", "volunteer", "volunteers",
        "subject", "subjects", "patients", "healthy controls", "adult volunteers",
    ],
    "mouse": ["mouse", "mice", "murine"],
    "rat": ["rat", "rats"],
    "macaque": ["macaque", "macaques", "rhesus", "monkey", "monkeys", "primate", "primates", "nhp", "non-human primate", "nonhuman primate"],
    "zebrafish": ["zebrafish", "danio rerio"],
    "drosophila": ["drosophila", "fruit fly", "fruit flies"],
    "c.elegans": ["c. elegans", "caenorhabditis elegans"],
}
#: Regions, each its own label. Fixed values.
REGIONS = {
    term: [term]
    for term in (
        "dorsolateral prefrontal cortex", "ventromedial prefrontal cortex", "prefrontal cortex", "somatosensory cortex",
        "motor cortex", "visual cortex", "auditory cortex", "cingulate cortex", "entorhinal cortex",
        "parahippocampal gyrus", "parahippocampal cortex", "insula", "insular cortex", "frontal cortex",
        "temporal cortex", "parietal cortex", "occipital cortex", "cerebral cortex", "basal ganglia",
        "nucleus accumbens", "substantia nigra", "ventral tegmental area", "corpus callosum", "white matter",
        "gray matter", "grey matter", "default mode network", "hippocampus", "hippocampal", "amygdala", "thalamus",
        "hypothalamus", "striatum", "cerebellum", "cerebellar", "brainstem", "whole brain", "whole-brain",
    )
}
DISEASES = {
    "parkinson": ["parkinson", "parkinson's", "parkinsons", "parkinson disease", "parkinson's disease"],
    "alzheimer": ["alzheimer", "alzheimer's", "alzheimers", "alzheimer disease", "alzheimer's disease"],
    "mild cognitive impairment": ["mild cognitive impairment", "cognitive impairment"],
    "dementia": ["dementia", "demented", "lewy body"],
    "adhd": ["adhd", "attention deficit hyperactivity disorder", "attention deficit disorder"],
    "schizophrenia": ["schizophrenia", "schizophrenic", "psychosis", "psychotic"],
    "bipolar": ["bipolar", "bipolar disorder", "manic depression"],
    "depression": ["depression", "depressive", "major depressive disorder", "mdd"],
    "anxiety": ["anxiety", "anxious", "generalized anxiety"],
    "autism": ["autism", "autistic", "asd", "autism spectrum disorder"],
    "epilepsy": ["epilepsy", "epileptic", "epileptiform", "seizure", "seizures"],
    "multiple sclerosis": ["multiple sclerosis"],
    "amyotrophic lateral sclerosis": ["amyotrophic lateral sclerosis"],
    "huntington": ["huntington", "huntington's", "huntingtons", "huntington disease"],
    "stroke": ["stroke", "strokes", "ischemic stroke", "cerebrovascular accident"],
    "traumatic brain injury": ["traumatic brain injury", "head injury", "concussion"],
    "migraine": ["migraine", "migraines"],
    "insomnia": ["insomnia", "sleep disorder", "sleep disorders"],
    "obesity": ["obesity", "obese"],
    "diabetes": ["diabetes", "diabetic", "type 2 diabetes", "type 1 diabetes"],
    "covid": ["covid", "covid-19", "sars-cov-2", "coronavirus"],
    "tinnitus": ["tinnitus"],
    "chronic pain": ["chronic pain", "neuropathic pain", "fibromyalgia"],
}
#: Words of sentences that speak of tools, not of acquisition. Fixed values.
TOOL_WORDS = (
    "portal", "software", "toolbox", "tool", "tools", "viewer", "viewers", "visualization", "visualisation", "visualize",
    "visualise", "visualizing", "visualising", "view", "views", "viewed", "viewing", "supports", "support", "supported",
    "compatible", "platform", "nemar", "plugin", "gui", "browser", "dashboard", "website", "webpage", "web page",
    "powered by", "hosted on", "available on", "accessible via", "tutorial",
)
#: Families of modality names that count as one another. Fixed values.
SYNONYMS = {
    "fmri": ["fmri", "mri", "functional mri", "functional magnetic resonance imaging"],
    "smri": ["smri", "mri", "structural mri", "structural magnetic resonance imaging"],
    "mri": ["mri", "fmri", "smri", "functional mri", "structural mri", "functional nuclear magnetic resonance", "functional nuclear magnetic resonance imaging"],
    "eeg": ["eeg", "electroencephalography"],
    "meg": ["meg", "magnetoencephalography"],
    "ieeg": ["ieeg", "intracranial eeg", "ecog"],
    "ecog": ["ecog", "ieeg", "intracranial eeg"],
    "pet": ["pet", "positron emission tomography"],
    "dti": ["dti", "diffusion mri", "diffusion tensor imaging", "mri"],
    "nirs": ["nirs", "fnirs", "functional near-infrared spectroscopy"],
    "fnirs": ["fnirs", "nirs"],
}


def words_pattern(tokens) -> str:
    """Java pattern of any of the tokens as whole words, Unicode letters being word characters."""
    return r"(?U)\b(?:" + "|".join(re.escape(t).replace(r"\ ", " ").replace(r"\-", "-") for t in tokens) + r")\b"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def holds(text: Column, tokens) -> Column:
    """Any of the tokens as they stand, also inside words. Tokens that hold another one need no look."""
    return reduce(lambda a, b: a | b, [text.contains(t) for t in tokens if not any(o != t and o in t for o in tokens)])


def holds_word(text: Column, tokens) -> Column:
    """Any of the tokens as whole words. Plain search is far cheaper than the pattern and comes first."""
    return holds(text, tokens) & text.rlike(words_pattern(tokens))


def labels(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """All labels of which a token stands in ``text`` (lower case), in vocabulary order."""
    return F.array_compact(F.array(*[F.when(holds_word(text, t), F.lit(label)) for label, t in vocabulary.items()]))


def first_label(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.when(holds_word(text, t), F.lit(label)) for label, t in vocabulary.items()])


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?;])\s+"), lambda s: F.trim(s) != "")


def acquisition_labels(text: Column, vocabulary: dict[str, list[str]] = MODALITIES, tools=TOOL_WORDS) -> Column:
    """Labels from the sentences that name no tool."""
    clean = F.filter(F.transform(sentences(text), F.lower), lambda s: ~holds_word(s, tools))
    return let(F.array_join(clean, " \n "), lambda t: labels(t, vocabulary))


def normalise(values: Column, vocabulary: dict[str, list[str]]) -> Column:
    """Labels of an array of raw tokens; unknown ones stay, blanks and mere numbers go, repeats too."""
    token = {t: label for label, ts in vocabulary.items() for t in ts}
    known = F.create_map(*[F.lit(x) for kv in token.items() for x in kv])
    clean = F.filter(F.transform(F.array_compact(values), lambda v: F.lower(F.trim(v))), lambda v: (v != "") & ~v.rlike("^[0-9]+$"))
    return F.array_distinct(F.transform(clean, lambda v: F.coalesce(F.try_element_at(known, v), v)))


def task_label(value: Column, vocabulary: dict[str, list[str]] = TASKS) -> Column:
    """The label of a free task name: a token or label as it stands, else the first token inside it; null for none."""
    exact = {t: label for label, ts in vocabulary.items() for t in (label, *ts)}
    known = F.create_map(*[F.lit(x) for kv in exact.items() for x in kv])
    return let(F.lower(F.trim(value)), lambda v: F.coalesce(F.try_element_at(known, v), first_label(v, vocabulary)))


def tiers(*evidence: tuple[str, Column]) -> Column:
    """Struct (labels, tier) of the first evidence that has a label; null where none has."""
    some = F.array(*[F.struct(c.alias("labels"), F.lit(name).alias("tier")) for name, c in evidence])
    return F.try_element_at(F.filter(some, lambda e: F.size(e["labels"]) > 0), F.lit(1))


def modality_overlap(requested: str, declared: Column) -> Column:
    """Equal, of one family, or one inside the other."""
    r, d = requested.lower().strip(), F.lower(F.trim(declared))
    families = {k: set(v) for k, v in SYNONYMS.items()}
    own = families.get(r)
    loose = d.contains(r) | F.lit(r).contains(d)
    if own is None:
        inside = F.lit(False)
        for k, v in families.items():
            inside = F.when(d == k, F.lit(r in v)).otherwise(inside)
        out = F.when(d.isin(*families), inside).otherwise(loose)
    else:
        met = [k for k, v in families.items() if v & own]
        out = F.when(d.isin(*families), d.isin(*met)).otherwise(d.isin(*sorted(own)))
    return (d != "") & ((d == r) | out)
