"""Inspectable scores of retrieved chunks: lexicons are parameters, and these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_patient_story, text_of

# Topic needles with the source hint that they favour, terms, and sections by worth.
TOPICS = (
    ("thoracic outlet", "thoracic-outlet"), ("tos", "thoracic-outlet"), ("tmj", "temporomandibular"), ("tmd", "temporomandibular"),
    ("pots", "pots"), ("postural orthostatic", "pots"), ("atlas", "atlas"), ("atlantoaxial", "atlanto"), ("cci", "atlanto"),
    ("aai", "atlanto"), ("jugular", "jugular"), ("jos", "jugular"), ("lumbar plexus", "lumbar-plexus"), ("lpcs", "lumbar-plexus"),
    ("migraine", "migraine"),
)
TERMS = (
    "scalene", "scalenes", "trapezius", "levator", "pectoralis", "suboccipital", "longus", "sternocleidomastoid", "scm",
    "strength", "strengthen", "stretch", "posture", "kyphosis", "hinge", "dyskinesis", "breathing", "mechanics",
)
GOOD = (
    "Dysfunctional scapular movement", "Scapular depression", "Scapular dyskinesis", "Evaluation of scapular movement", "Optimal scapular movement",
    "Proper scapular / clavicular resting position", "Proper structural habits", "Why improper scapular mechanics cause injury",
    "The cause of scapular dyskinesis", "Identification", "Identification & correction", "Identification and correction", "Identification and treatment",
    "Identification by provocative testing", "Assessment", "Evaluation", "Diagnosis", "Etiology", "Mechanism", "Biomechanics", "Pathomechanics",
    "Scapuloclavicular depression", "Causes and consequences", "Common causes of misalignment", "Joint misalignment", "The cervical complex",
    "Forward head posture", "Poor craniocervical posture with neck 'hinging'", "Swayback posture", "Anterior pelvic tilt",
    "Functional varus & tibial internal rotation", "Anterior tibial glide", "Tibial posterior glide", "Anterior femoral glide", "Hip impingement",
    "External (posterior) hip impingement", "Internal (anterior) hip impingement", "Lumbosacral plexus", "Lumbar plexus",
    "Brachial plexus compression sites", "Entrapment sites", "Compression vs. entrapment", "The median nerve compression sites",
    "The musculocutaneous nerve compression sites", "The radial & axillary nerve compression sites", "The ulnar nerve compression sites",
    "Neurogenic TOS", "Arterial / Vascular TOS", "TOS and autonomic dysfunction", "Scapular resting position", "Corrective strategies", "Treatment",
    "Treatment strategies", "Specific strengthening exercises", "Retraining the affected muscles",
)
NARRATIVE = (
    "A little story", "Case report", "Case report #2", "Case example", "Case #2 – Positionally conditioned", "In training", "Psychological factors",
    "Stress levels", "Stress and neck pain", "In summary", "In conclusion",
)
LOW = (
    "Conclusion", "Summary", "Other contributing factors", "What does the common sense say?", "What does the research show?", "The problem",
    "The postural common denominator", "Additional research on scapular dysfunction", "Proper atlantal measurements & identification",
)
NARRATIVE_PARTS = ("case report", "case-report", "case series", "case study", "a little story", "patient story")
GOOD_PARTS = ("definition", "anatomy", "mechanism", "pathomechan", "biomechan", "assessment", "diagnosis", "evaluation", "treatment", "exercise", "management", "summary", "conclusion")


@dataclass(frozen=True)
class Lexicon:
    topics: tuple[tuple[str, str], ...] = TOPICS
    terms: tuple[str, ...] = TERMS
    good: tuple[str, ...] = GOOD
    narrative: tuple[str, ...] = NARRATIVE
    low: tuple[str, ...] = LOW
    topic_bonus: float = 0.30
    term_bonus: float = 0.15
    story_penalty: float = 0.20
    good_parts: tuple[str, ...] = GOOD_PARTS
    narrative_parts: tuple[str, ...] = NARRATIVE_PARTS


def any_part(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def section_bias(section: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Exact names first (good, narrative, low), then parts of names (good, narrative), else 0."""
    s, low = F.trim(text_of(section)), F.lower(F.trim(text_of(section)))
    return (
        F.when(s.isin(*lexicon.good), -0.50).when(s.isin(*lexicon.narrative), 0.75).when(s.isin(*lexicon.low), 0.20)
        .when(any_part(low, lexicon.good_parts), -0.35).when(any_part(low, lexicon.narrative_parts), 0.50).otherwise(0.0)
    )


def section_priority(section: Column) -> Column:
    """Order of sections in a context: the first part that the name holds."""
    low = F.lower(text_of(section))
    order = (("rest",), ("movement",), ("biomech", "mechan"), ("compens",), ("symptom", "pain"), ("treat", "exercise"), ("concl", "summary"))
    out = F
    for i, parts in enumerate(order):
        out = out.when(any_part(low, parts), i)
    return out.otherwise(7)


def biased_distance(dist: Column, question: Column, source: Column, text: Column, section: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """A distance with one topic bonus at most, a term bonus, the section's bias and a penalty for patient stories."""
    q, s, t = F.lower(text_of(question)), F.lower(text_of(source)), F.lower(text_of(text))
    topic = F.lit(False)
    for needle, hint in lexicon.topics:
        topic = topic | (F.contains(q, F.lit(needle)) & F.contains(s, F.lit(hint)))
    return (
        dist - F.when(topic, lexicon.topic_bonus).otherwise(0.0) - F.when(any_part(t, lexicon.terms), lexicon.term_bonus).otherwise(0.0)
        + section_bias(section, lexicon) + F.when(is_patient_story(text), lexicon.story_penalty).otherwise(0.0)
    )
