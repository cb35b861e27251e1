"""Rule-based answers over search hits; a language model is a function that the caller gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import query as Q
from ..functions.text import ocr_fixes, repair_output, strip, truncate_sentence

def case_lines(cases: DataFrame) -> DataFrame:
    """(first_idx, line): a row for each case, for lists of any length."""
    line = F.concat(F.lit("- निर्णय नं. "), "decision_no", F.lit(" (मिति: "), "date", F.lit(", विषय: "), "subject", F.lit(")"))
    return cases.select("first_idx", line.alias("line"))


def case_list(cases: DataFrame) -> DataFrame:
    """One row: the list of all cases in order of their first chunk, from (first_idx, decision_no, date, subject)."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("first_idx", "line"))), lambda x: x["line"])
    return case_lines(cases).agg(lines.alias("lines")).select(F.when(F.size("lines") > 0, F.concat_ws("\n", F.lit(K.CASES_HEADING), F.array_join("lines", "\n"))).otherwise(K.NO_CASES).alias("answer"))


def evidence(hits: DataFrame, most: int = 5, limit: int = 600) -> DataFrame:
    """One row: the first ``most`` hits as context, each cut at a sentence and headed by its page."""
    part = F.concat(F.lit("--- पृष्ठ "), F.col("page").cast("string"), F.lit(" ---\n"), truncate_sentence(F.col("content"), limit))
    top = hits.where(F.col("rank") <= most).select("rank", part.alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"])
    return top.agg(F.array_join(parts, "\n\n").alias("context"))


def clean_judges(c: Column) -> Column:
    c = ocr_fixes(c)
    for pattern, to in K.JUDGE_TITLES:
        c = F.regexp_replace(c, f"(?U){pattern}", to)
    return strip(c)


def compared_field(query: Column) -> Column:
    out = F.lit("all")
    for field, words in reversed(K.COMPARED_WORDS):
        out = F.when(Q.any_of(query, words), field).otherwise(out)
    return out


def comparison_lines(cases: DataFrame, summaries: DataFrame, headers: DataFrame, field: str) -> DataFrame:
    """(position, line, judges) for each case of ``cases`` (position, case_id): from its summary, else its header row.

    Spark picks the joins by the tables' sizes: none is taken to be small.
    """
    own_headers = headers.select("case_id", F.col("judges").alias("header_judges"))
    joined = cases.join(summaries.alias("s"), "case_id", "left").join(own_headers, "case_id", "left")
    title = F.concat(F.lit("**निर्णय नं. "), F.replace("case_id", F.lit("decision_"), F.lit("")), F.lit("** – "))
    written = F.col("introduction").isNotNull()
    if field == "judges":
        own = strip(F.regexp_extract("introduction", f"(?U){K.JUDGES_LINE}", 1))
        names = clean_judges(F.when(written, own).otherwise(F.coalesce("header_judges", F.lit(""))))
        known = written | F.col("header_judges").isNotNull()
        text = F.when(known, F.concat(F.lit("न्यायाधीश: "), F.when(names == "", "अज्ञात").otherwise(names)))
        return joined.select("position", F.concat(title, F.coalesce(text, F.lit("जानकारी उपलब्ध छैन"))).alias("line"), F.when(known, names).alias("judges"))
    if field == "petitioner":
        own = F.regexp_extract("parties", r"(?s)निवेदक:(.*?)(?:विपक्षी:|$)", 1)
        text = F.concat(F.lit("निवेदक: "), F.when(F.contains("parties", F.lit("निवेदक:")), strip(own)).otherwise("अज्ञात"))
    elif field == "date":
        own = F.regexp_extract("introduction", f"(?U){K.DECISION_DATE}", 1)
        text = F.concat(F.lit("फैसला मिति: "), F.when(own == "", "अज्ञात").otherwise(own))
    else:
        text = F.coalesce(F.nullif("subject", F.lit("")), F.lit("विषय अज्ञात"))
    return joined.select("position", F.concat(title, F.when(written, text).otherwise("जानकारी उपलब्ध छैन")).alias("line"), F.lit(None).cast("string").alias("judges"))


def common_judges(a: Column, b: Column) -> Column:
    """Judges on both lists, in the first one's order."""
    names = lambda c: F.filter(F.split(strip(c), f"(?U){K.JUDGE_SEPARATOR}"), lambda x: x != "")
    both = F.array_distinct(F.array_intersect(names(a), names(b)))
    return F.when(F.size(both) > 0, F.concat(F.lit("\n**साझा न्यायाधीश:** "), F.array_join(both, ", "))).otherwise("\n**साझा न्यायाधीश:** कुनै पनि छैनन्")


def summary_text() -> Column:
    """A summary's eight parts under their headings; null if one is missing."""
    return F.concat(*(x for k, (title, field) in enumerate(K.SUMMARY_PARTS) for x in (F.lit(("\n\n" if k else "") + f"**{title}**\n"), F.col(field))))


def reasoning_text(query: Column, reasoning: Column) -> Column:
    short = F.when(F.length(reasoning) > 500, F.concat(F.substring(reasoning, 1, 500), F.lit("..."))).otherwise(reasoning)
    return F.when((Q.factual_category(query) == "reasoning") & (F.coalesce(reasoning, F.lit("")) != ""), F.concat(F.lit("अदालतको तर्क/निष्कर्ष:\n\n"), short))


def asked_paragraph(query: Column) -> Column:
    """The number of the paragraph or article that a question names; null without one."""
    return F.nullif(F.regexp_extract(query, f"(?U){K.ASKED_PARAGRAPH}", 1), F.lit(""))


def paragraph_text(number: str, hits: DataFrame) -> str:
    """The first hit of that paragraph (column ``paragraph_no``, where the chunks carry it), or that there is none."""
    own = hits.where(F.col("paragraph_no") == number).orderBy("rank").select("content").first() if "paragraph_no" in hits.columns else None
    return f"प्रकरण/अनुच्छेद नं. {number} को पाठ:\n\n{own['content']}" if own else f"प्रकरण/अनुच्छेद नं. {number} को जानकारी उपलब्ध छैन।"


def fallback(query: Column, content: Column) -> Column:
    """The answer from a case's header row, for questions about lawyers or judges; null content: no header."""
    line = lambda label: strip(F.regexp_extract(content, f"(?U){label}:\\s*([^\\n]+)", 1))
    appellant, respondent, judges = (line(x) for x in ("पुनरावेदकका कानून व्यवसायी", "प्रत्यर्थीका कानून व्यवसायी", "न्यायाधीश"))
    lawyers = Q.any_of(query, ("लायर", "कानून व्यवसायी"))
    return (
        F.when(content.isNull(), K.NO_INFO)
        .when(lawyers & (appellant != ""), F.concat(F.lit("पुनरावेदकका कानून व्यवसायी: "), appellant))
        .when(lawyers & (respondent != ""), F.concat(F.lit("प्रत्यर्थीका कानून व्यवसायी: "), respondent))
        .when(Q.any_of(query, ("न्यायाधीश", "इजलास")) & (judges != ""), F.concat(F.lit("न्यायाधीश: "), judges))
        .otherwise(K.NOT_IN_DOCUMENTS)
    )


def model_summary() -> Column:
    """What a model is told of a case's summary: five labelled fields, those that are missing empty."""
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"**{label}:** "), F.coalesce(F.col(field), F.lit(""))) for label, field in K.MODEL_FIELDS))


def instructions(case: str | None, summary: str, context: str) -> str:
    return K.MODEL_PROMPT.format(nothing=K.NO_INFO, case=case or K.UNKNOWN, summary=summary, context=context).strip()


def answer(
    query: str,
    hits: DataFrame,
    cases: DataFrame,
    summaries: DataFrame,
    current_case: str | None = None,
    compare: list[str] | None = None,
    model: Callable[[str, str, int], str] | None = None,
) -> str:
    """The answer to a question from its hits (at most a few dozen rows): rules in their order, then the model, then the header.

    ``cases``: the input of ``case_list``; ``compare``: the numbers of a comparison; ``model(instructions, question, tokens)``:
    the instructions name the case and hold its summary and the evidence, ``tokens`` is the most that an answer may take.
    """
    spark = hits.sparkSession
    rows = hits.orderBy("rank").collect()
    if not rows:
        return K.NO_INFO
    q = F.lit(query)
    kind = spark.range(1).select(Q.intent(q)).first()[0]
    if kind == "LIST_CASES":
        return case_list(cases).first()[0]
    if compare:
        known = {r["case_id"] for r in rows} | {r["case_id"] for r in summaries.select("case_id").collect()}
        ids = [f"decision_{n}" for n in compare if f"decision_{n}" in known]
        if len(ids) >= 2:
            field = spark.range(1).select(compared_field(q)).first()[0]
            asked = spark.createDataFrame([*enumerate(ids)], "position int, case_id string")
            lines = comparison_lines(asked, summaries, hits.where("is_header").dropDuplicates(["case_id"]), field).orderBy("position").collect()
            out = [r["line"] for r in lines]
            judges = [r["judges"] for r in lines if r["judges"] is not None]
            if field == "judges" and len(judges) == 2:
                out.append(spark.range(1).select(common_judges(F.lit(judges[0]), F.lit(judges[1]))).first()[0])
            return "\n\n".join(out)
    own = summaries.where(F.col("case_id") == (current_case or ""))
    if kind == "CASE_SUMMARY":
        whole = own.select(summary_text().alias("t")).first()
        if whole and whole["t"] is not None:
            return whole["t"]
    why = own.select(reasoning_text(q, F.col("reasoning")).alias("t")).first()
    if why and why["t"]:
        return why["t"]
    if current_case and not compare:
        hits = hits.where(F.col("case_id") == current_case)
        rows = [r for r in rows if r["case_id"] == current_case]
        if not rows:
            return K.NO_INFO
    paragraph = spark.range(1).select(asked_paragraph(q)).first()[0]
    if paragraph:
        return paragraph_text(paragraph, hits)
    if model:
        try:
            told = own.select(model_summary().alias("s")).first()
            budget = spark.range(1).select(Q.token_budget(F.lit(kind))).first()[0]
            said = model(instructions(current_case, told["s"] if told else "", evidence(hits).first()["context"]), query.strip(), budget)
            if said and said.strip():
                return spark.range(1).select(repair_output(F.lit(said))).first()[0]
        except Exception:  # noqa: BLE001  a model that fails leaves the answer to the header
            pass
    head = next((r["content"] for r in rows if r["is_header"]), None)
    return spark.range(1).select(fallback(q, F.lit(head).cast("string"))).first()[0]
