"""Case metadata by patterns over a document's whole text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .query import any_of
from .text import clean_text, let, normalize_digits, strip

# The patterns of each field, the first that matches counts.
PATTERNS = {
    "decision_no": (r"निर्णय\s*नं\.?\s*([0-9]+)", r"Decision\s*(?:No\.?|Number)\s*[:.-]?\s*([0-9]+)"),
    "date": (
        r"फैसला\s*मिति\s*[:：\-]?\s*([0-9]{3,4}[./\-।][0-9]{1,2}[./\-।][0-9]{1,2})",
        r"आदेश\s*मिति\s*[:：\-]?\s*([0-9]{3,4}[./\-।][0-9]{1,2}[./\-।][0-9]{1,2})",
    ),
    "subject": (r"विषय\s*[ः:：-]?\s*([^\n|]+)",),
    "appellant": (r"पुनरावेदक/विपक्षी\s*[:：-]\s*([^\n]+)", r"निवेदक\s*[:：-]\s*([^\n]+)", r"पुनरावेदक\s*[:：-]\s*([^\n]+)"),
    "respondent": (r"प्रत्यर्थी/निवेदक\s*[:：-]\s*([^\n]+)", r"विपक्षी\s*[:：-]\s*([^\n]+)", r"प्रत्यर्थी\s*[:：-]\s*([^\n]+)"),
    "appellant_lawyer": (r"पुनरावेदकका\s*तर्फबाट\s*[:：-]?\s*([^\n]+)", r"निवेदकका\s*तर्फबाट\s*[:：-]?\s*([^\n]+)"),
    "respondent_lawyer": (r"प्रत्यर्थीका\s*तर्फबाट\s*[:：-]?\s*([^\n]+)", r"विपक्षीका\s*तर्फबाट\s*[:：-]?\s*([^\n]+)"),
    "chief": (r"सम्माननीय\s*(?:का\.मु\.\s*)?प्रधानन्यायाधीश\s*श्री\s*([^\n]+)", r"प्रधानन्यायाधीश\s*श्री\s*([^\n]+)"),
}
COURT = "सर्वोच्च अदालत"


def first_match(c: Column, patterns: tuple[str, ...]) -> Column:
    """Group 1, stripped, of the first pattern that matches; empty without one."""
    return F.coalesce(*(strip(F.nullif(F.regexp_extract(c, f"(?imU){p}", 1), F.lit(""))) for p in patterns), F.lit(""))  # no pattern matches with an empty group


def judges(text: Column, split_names: bool = True) -> Column:
    """The chief justice and the other judges, joined by commas. ``split_names``: cut at every letter र, as inside names too."""
    chief = first_match(text, PATTERNS["chief"])
    honoured = F.regexp_extract_all(text, F.lit(r"(?U)माननीय\s*न्यायाधीश\s*श्री\s*([^\n]+)"), F.lit(1))
    plain = F.regexp_extract_all(text, F.lit(r"(?U)न्यायाधीश\s*श्री\s*([^\n]+)"), F.lit(1))
    lines = F.filter(F.when(F.size(honoured) > 0, honoured).otherwise(plain), lambda x: ~F.contains(x, F.lit("का.मु.प्")))
    cut = r"(?U)\s*र\s*|\s*,\s*" if split_names else r"(?U)\s+र\s+|\s*,\s*"
    names = F.filter(F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, cut), strip))), lambda x: F.length(x) > 2)
    head = F.when(chief != "", F.array(F.concat(F.lit("प्रधानन्यायाधीश "), chief))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_join(F.concat(head, names), ", ")


def provisions(text: Column) -> Column:
    return F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(?:दफा|धारा)\s*[०-९0-9]+(?:\s*\([^)]+\))?"), F.lit(0))), ", ")


def case_metadata(text: Column, file_name: Column, split_names: bool = True) -> Column:
    """Struct of a case's metadata; what is not found is empty. The text is cleaned here, also when it was before."""
    return let(clean_text(text), lambda t: let(normalize_digits(t), lambda norm: _fields(t, norm, file_name, split_names)))


def _fields(t: Column, norm: Column, file_name: Column, split_names: bool) -> Column:
    number = first_match(norm, PATTERNS["decision_no"])
    subject = first_match(t, PATTERNS["subject"])
    fallback = F.coalesce(*(F.when(any_of(t, (k,)), k) for k in K.SUBJECT_KEYWORDS), subject)
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")
    return F.struct(
        F.when(number != "", F.concat(F.lit("decision_"), number)).otherwise(F.concat(F.lit("file_"), stem)).alias("case_id"),
        number.alias("decision_no"),
        first_match(norm, PATTERNS["date"]).alias("date"),
        F.when(subject.isin("", "हुने"), fallback).otherwise(subject).alias("subject"),
        F.when(F.contains(t, F.lit(COURT)), COURT).otherwise("").alias("court"),
        F.struct(first_match(t, PATTERNS["appellant"]).alias("appellant"), first_match(t, PATTERNS["respondent"]).alias("respondent")).alias("parties"),
        first_match(t, PATTERNS["appellant_lawyer"]).alias("appellant_lawyer"),
        first_match(t, PATTERNS["respondent_lawyer"]).alias("respondent_lawyer"),
        judges(t, split_names).alias("judges"),
        provisions(t).alias("provisions"),
    )
