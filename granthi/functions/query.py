"""What a question asks for: intent, identifiers, categories. All are column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import normalize_digits, strip


def any_of(c: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(t)) for t in terms))


def intent(c: Column) -> Column:
    """LIST_CASES, CASE_SUMMARY, CASE_LOOKUP, LEGAL_PROVISION, COMPARISON or LEGAL_QA: the first whose signs are there."""
    q = strip(F.lower(F.coalesce(c, F.lit(""))))
    numbered = q.rlike(f"(?U){K.NAMED_DECISION}")
    filed = q.rlike(f"(?U){K.NAMED_FILE}") | F.contains(q, F.lit(".pdf"))
    return (
        F.when(any_of(q, K.LIST_PHRASES), "LIST_CASES")
        .when(any_of(q, K.SUMMARY_TERMS), "CASE_SUMMARY")
        .when(numbered | filed, "CASE_LOOKUP")
        .when(any_of(q, K.PROVISION_TERMS), "LEGAL_PROVISION")
        .when(any_of(q, K.COMPARISON_TERMS), "COMPARISON")
        .otherwise("LEGAL_QA")
    )


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def numbers(c: Column) -> Column:
    """Numbers of three or four digits that stand alone, Devanagari digits counted as ASCII ones."""
    return F.regexp_extract_all(normalize_digits(F.coalesce(c, F.lit(""))), F.lit(r"(?<![\p{L}\p{N}_])([0-9]{3,4})(?![\p{L}\p{N}_])"), F.lit(1))


def decision_number(c: Column, active_case: Column | None = None) -> Column:
    """The decision that a question names, or seems to name, or, by a pronoun, the active case's."""
    q = normalize_digits(F.coalesce(c, F.lit("")))
    low = F.lower(F.coalesce(c, F.lit("")))
    alone = numbers(c)
    options = [_found(q, f"(?U){p}") for p in K.DECISION_PATTERNS]
    options.append(F.when(any_of(low, K.CASE_KEYWORDS) & (F.size(alone) == 1), F.element_at(alone, 1)))
    if active_case is not None:
        options.append(F.when(any_of(low, K.RELATIVE_PRONOUNS), F.nullif(F.replace(active_case, F.lit("decision_"), F.lit("")), F.lit(""))))
    return F.coalesce(*options)


def source_file(c: Column) -> Column:
    return _found(F.coalesce(c, F.lit("")), K.SOURCE_FILE)


def source_stem(c: Column) -> Column:
    stem = _found(F.coalesce(c, F.lit("")), K.SOURCE_STEM)
    return F.when(source_file(c).isNull(), stem)


def analysis(c: Column) -> Column:
    """Source, kind and expansion of a question, by the simpler classifier."""
    q = F.coalesce(c, F.lit(""))
    source = F.regexp_replace(F.lower(F.nullif(F.regexp_extract(q, f"(?U){K.ANALYSED_SOURCE}", 0), F.lit(""))), f"(?U){K.SOURCE_MARKS}", "_")
    kind = (
        F.when(any_of(q, K.ENTITY_TERMS), "ENTITY_CASE_ANALYSIS")
        .when(any_of(q, K.CASE_TERMS), "CASE_SUMMARY")
        .when(any_of(q, K.LOOKUP_TERMS), "LEGAL_PROVISION_LOOKUP")
        .otherwise("DIRECT_FACT")
    )
    return F.struct(source.alias("source_filter"), kind.alias("query_type"), kind.isin("ENTITY_CASE_ANALYSIS", "CASE_SUMMARY").alias("requires_expansion"))


def factual_category(c: Column) -> Column:
    """The fact that a question asks for; ``reasoning`` for those that ask why; null for none."""
    q = F.lower(F.coalesce(c, F.lit("")))
    reasoning = any_of(q, K.REASONING_WORDS) & ~any_of(q, K.REASONING_EXCEPT)
    # a vowel sign ends the pattern's word only where a letter follows
    who = q.rlike(r"(?<![\p{L}\p{N}_])कसले(?=[\p{L}\p{N}_])")
    kind = (
        F.when(any_of(q, K.LAWYER_WORDS), "lawyers")
        .when(who, "petitioner")
        .when(any_of(q, K.JUDGE_WORDS), "judges")
        .when(any_of(q, K.FACT_PROVISION_WORDS), "provisions")
        .when(F.contains(q, F.lit("विरुद्ध")), "respondent")
        .when(any_of(q, K.PETITIONER_WORDS), "petitioner")
        .when(F.contains(q, F.lit("मुद्दा")) & F.contains(q, F.lit("प्रकार")), "case_type")
        .when(any_of(q, ("मिति", "कहिले")), "date")
        .when(F.contains(q, F.lit("फैसला")) & any_of(q, ("के", "कस्तो", "गरेको")), "final_order")
        .when(F.contains(q, F.lit("मुद्दा")) & F.contains(q, F.lit("नं")), "case_number")
    )
    specific = reduce(lambda a, b: a | b, (q.rlike(f"(?U){p}") for p in K.SPECIFIC_PROVISION))
    return F.when(reasoning, "reasoning").when((kind == "provisions") & specific, F.lit(None)).otherwise(kind)


def token_budget(kind: Column) -> Column:
    return F.when(kind.isin("LIST_CASES", "CASE_LOOKUP"), 500).when(kind == "CASE_SUMMARY", 1200).otherwise(1024)


def last_decision(answer: Column) -> Column:
    """The last decision number that an answer quotes."""
    return F.try_element_at(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(f"(?U){K.LAST_DECISION}"), F.lit(1)), F.lit(-1))
