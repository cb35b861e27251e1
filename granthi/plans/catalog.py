"""The registered queries over the synthetic tables, and the same in SQL.

The tables stand for the engine's own: a document is a chunk, its source its case (``decision_100`` for
src0 and so on), embeddings are the chunks' vectors by id. As no table holds Devanagari text, some queries
put dandas for full stops or Devanagari digits for ASCII ones first, or stand behind fixed Devanagari lines with
Unicode blanks and decomposed letters, in both languages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import constants as K
from ..functions import query as Q
from ..functions import text as T
from ..functions.metadata import PATTERNS, case_metadata
from ..operators import answers, chunks, search, sparse
from ..sources.files import html_pages, kept, scratch_dir, valid_pages
from ..streaming.session import session_fold

QUERY, TOP_K, ALPHA, VECTOR_ID, CASE = "the nation and the thing", 5, 0.15, 7, 103


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its schema is read once for each application: Spark starts a job to infer it."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


#: Bytes of a table, for each core, below which it is dealt out: a small file may be one row group, which is one task.
SMALL, LEAST = 16 << 20, 1 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small table dealt out by ``key`` over all cores, since the work on a text outweighs its way; a large one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()  # the files' bytes
    return df.repartition(cores, key) if LEAST <= size <= SMALL * cores else df


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def chunk_view(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """``dealt``: as ``docs`` has it; a search reads few rows and takes the files as they are."""
    number = (F.substring("source", 4, 9).cast("int") + 100).cast("string")
    rows = docs(spark, sf_dir) if dealt else table(spark, sf_dir, "documents")
    return rows.select(
        F.col("doc_id").alias("idx"),
        "source",
        F.concat(F.lit("decision_"), number).alias("case_id"),
        number.alias("decision_no"),
        (F.col("doc_id") % 7).cast("int").alias("page"),
        (F.col("doc_id") % 50 == 0).alias("is_header"),
        F.col("text").alias("content"),
    )


def danda(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit("।"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "embedding")


_BUILT: dict[tuple[str, str], str] = {}


def built(spark: SparkSession, sf_dir: str) -> str:
    """The path of the documents' saved index, made once for each application and folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        path = f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"
        sparse.save(chunk_view(spark, sf_dir), path, "content")
        _BUILT[key] = path
    return _BUILT[key]


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query's vector, from the embeddings alone: a search of vectors builds no index of texts."""
    return list(vectors(spark, sf_dir).where(f"idx = {VECTOR_ID}").first()["embedding"])


def index_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return sparse.load(spark, built(spark, sf_dir))


def bm25_of(spark: SparkSession, sf_dir: str, query: str = QUERY) -> DataFrame:
    return sparse.bm25(index_of(spark, sf_dir), query)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_view(spark, sf_dir)
    near = search.knn(vectors(spark, sf_dir), query_vector(spark, sf_dir), 100)
    return search.fused(rows, near, bm25_of(spark, sf_dir), QUERY, ALPHA)


def ocr_fixes(s, d):
    return docs(s, d).select("doc_id", T.ocr_fixes(F.concat(F.lit("काश SEAT "), "text")).alias("fixed"))


#: Decomposed letters, Unicode blanks and control characters around a text.
CLEAN_HEAD, CLEAN_TAIL = "\u00a0 \t काश \u0928\u093c\u0958 e\u0301\n\n\n\n", " \x01\u2003\u00a0"


def clean_text(s, d):
    return docs(s, d).select("doc_id", T.clean_text(F.concat(F.lit(CLEAN_HEAD), "text", F.lit(CLEAN_TAIL))).alias("cleaned"))


def clean_marks(s, d):
    """As ``clean_text``, which has its marks too."""
    return clean_text(s, d)


def normalize_digits(s, d):
    return docs(s, d).select("doc_id", T.normalize_digits(F.translate("text", "0123456789", "०१२३४५६७८९")).alias("normal"))


def script_ratio(s, d):
    text = F.translate("text", "aeiou", "कखगघङ")
    return docs(s, d).select("doc_id", F.round(T.script_ratio(text), 9).alias("ratio"), T.is_valid_script(text).alias("valid"))


def sentence_rows(s, d):
    sents = T.sentences(T.clean_text(danda(F.col("text"))))
    return docs(s, d).select("doc_id", F.posexplode(sents).alias("sentence_no", "sentence"))


def normalize_match(s, d):
    return docs(s, d).select("doc_id", T.normalize_match(F.col("text")).alias("normal"))


def repair_output(s, d):
    return docs(s, d).select("doc_id", T.repair_output(F.concat(F.lit("```text\n"), "text", F.lit("  \n\n\n\n```"))).alias("repaired"))


def truncate_sentence(s, d):
    return docs(s, d).select("doc_id", T.truncate_sentence(danda(F.col("text")), 300).alias("short"))


def page_view(s, d):
    return docs(s, d).select(F.col("source").alias("path"), F.col("source"), F.col("doc_id").cast("int").alias("page"), F.lit(1).alias("total_pages"), danda(F.col("text")).alias("text"))


def chunk_pack(s, d):
    return chunks.chunk_rows(page_view(s, d)).select("source", "page", "chunk_no", "content")


def chunk_index(s, d):
    return chunks.with_index(chunks.chunk_rows(page_view(s, d))).select("idx", "source", "page", "chunk_no", F.length("content").alias("n_chars"))


def header_union(s, d):
    rows = chunk_view(s, d).withColumns({"date": F.lit("2063-01-02"), "subject": F.lit(""), "court": F.lit(""), "judges": F.lit(""), "appellant_lawyer": F.lit(""), "respondent_lawyer": F.lit(""), "provisions": F.lit(""), "parties": F.struct(F.lit("A").alias("appellant"), F.lit("").alias("respondent"))})
    head = rows.select("idx", F.lit(0).alias("page"), F.lit(True).alias("is_header"), chunks.header_text().alias("search_text"))
    body = rows.select("idx", "page", F.lit(False).alias("is_header"), chunks.search_text(F.col("content")).alias("search_text"))
    return head.unionByName(body)


def char_trigrams(s, d):
    return sparse.postings(chunk_view(s, d), "content").groupBy("idx").agg(F.count("*").alias("grams"), F.sum("tf").alias("total"), F.max("tf").alias("most"))


def gram_df(s, d):
    return sparse.document_counts(chunk_view(s, d), "content")


def doc_len(s, d):
    return sparse.lengths(chunk_view(s, d), "content")


def corpus_stats(s, d):
    stats = index_of(s, d)["stats"]
    return stats.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"))


def bm25_scores(s, d):
    return bm25_of(s, d).select("idx", F.round("bm25", 6).alias("bm25"))


def bm25_topk(s, d):
    rows = sparse.bm25_top(index_of(s, d), QUERY, 10).select("idx", F.round("bm25", 6).alias("bm25"))
    return rows.orderBy(F.desc("bm25"), "idx").limit(10)


def bm25_queries(s, d):
    """The five best documents for every benchmark item, all at once."""
    return sparse.bm25_many(index_of(s, d), table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 5)


def knn_queries(s, d):
    """The ten nearest vectors to each whose id is divisible by 100."""
    rows = vectors(s, d)
    return search.knn_many(rows, rows.where("idx % 100 = 0"), 10).select("query_id", "rank", "idx", F.round("distance", 6).alias("distance"))


def bm25_norm(s, d):
    rows, scores = chunk_view(s, d).where(f"case_id = 'decision_{CASE}'"), bm25_of(s, d)
    return search.fused(rows, vectors(s, d).limit(0).select("idx", F.lit(0.0).alias("vector_score")), scores, QUERY, ALPHA).select("idx", F.round("bm25_score", 6).alias("bm25_score"))


def lexical_score(s, d):
    return docs(s, d).select("doc_id", F.round(T.lexical_score(F.lit(QUERY), F.col("text")), 9).alias("lexical"))


def knn_cosine(s, d):
    return search.knn(vectors(s, d), query_vector(s, d), 100).select("idx", F.round("vector_score", 6).alias("vector_score"))


def knn_postfilter(s, d):
    near = search.knn(vectors(s, d), query_vector(s, d), 100)
    return near.join(chunk_view(s, d).where(f"case_id = 'decision_{CASE}'").select("idx"), "idx", "left_semi").select("idx", F.round("vector_score", 6).alias("vector_score"))


def hybrid_fused(s, d):
    return scored(s, d).select("idx", *(F.round(c, 6).alias(c) for c in search.SCORES))


def case_filter(s, d):
    return search.case_rows(chunk_view(s, d), "decision_101", str(CASE)).select("idx", "case_id")


def case_dump(s, d):
    return search.case_dump(search.case_rows(chunk_view(s, d), None, str(CASE))).select("rank", "idx", "page", "is_header", "score")


def dominant_case(s, d):
    return search.dominant_case(scored(s, d).withColumn("case_id", F.when(F.col("idx") % 3 > 0, "decision_100").otherwise(F.col("case_id"))), TOP_K)


def dominant_topk(s, d):
    made = scored(s, d).withColumn("case_id", F.when(F.col("idx") % 3 > 0, "decision_100").otherwise(F.col("case_id"))).select("idx", "case_id", "score")
    rows = kept(made, "scored")  # read twice: texts are scored once
    case = search.dominant_case(rows, TOP_K)
    return search.ranked(rows.join(F.broadcast(case), "case_id", "left_semi"), TOP_K).select("rank", "idx", F.round("score", 6).alias("score"))  # one row


def neighbour_expand(s, d):
    same = lambda df: df.withColumn("case_id", F.when(F.col("idx") % 5 > 0, "decision_100").otherwise(F.col("case_id")))
    top = search.ranked(same(scored(s, d)), TOP_K)
    return search.expanded(top, same(chunk_view(s, d)), TOP_K).select("idx", *(F.round(c, 6).alias(c) for c in search.SCORES))


def hybrid_search(s, d):
    vector = query_vector(s, d)
    engine = search.Engine(chunk_view(s, d, False), vectors(s, d), index_of(s, d), lambda _: vector)
    return engine.search(QUERY, TOP_K, ALPHA).select("rank", "idx", "case_id", F.round("score", 6).alias("score"))


LISTING = "list of cases the nation and the thing"


def search_list(s, d):
    """A search whose intent is the list: plain top-k, no dominant case, no neighbours."""
    vector = query_vector(s, d)
    engine = search.Engine(chunk_view(s, d, False), vectors(s, d), index_of(s, d), lambda _: vector)
    return engine.search(LISTING, 7, 0.5).select("rank", "idx", "case_id", F.round("score", 6).alias("score"))


def current_case_filter(s, d):
    return search.case_rows(chunk_view(s, d), f"decision_{CASE}", None).select("idx", "case_id")


def case_id_fallback(s, d):
    """No chunk carries the number itself: it is found in the case ids."""
    return search.case_rows(chunk_view(s, d).withColumn("decision_no", F.lit("")), None, str(CASE)).select("idx", "case_id")


def full_text(s, d):
    return chunks.full_texts(page_view(s, d)).select("source", "total_pages", F.length("text").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def full_text_pages(s, d):
    """The same as rows, in no cell for a whole source."""
    return chunks.page_texts(page_view(s, d)).select("source", "page", F.length("text").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def page_validity(s, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "aeioun", "कखगघङत")).otherwise(F.col("text"))
    return valid_pages(docs(s, d).select("doc_id", text.alias("text"))).select("doc_id", "native_ok", F.length("text").alias("n_chars"))


ASKED = (
    "कुन कुन मुद्दा छन्", "list of cases please", "summary of decision no 4512", "यो मुद्दा के हो", "", "निर्णय नं. ९८७६ को फैसला", "nkp_12_3.pdf",
    "दफा ८८ बमोजिम", "compare case 123 and 456", "difference between them", "निर्णय 123", "case no: 4521", "what about the case 2063", "said order", "who is it",
    "अनुसार कसरी", "यस मुद्दाको मिति कहिले हो", "वकील को हुन्", "निर्णय नं. १२३४ र ५६७८ तुलना", "NKP 2_2 को निवेदक", "विरुद्ध को", "मुद्दा नं", "फैसला के गरेको",
    "निर्णय\u00a0नं.\u00a0९८७६", "decision\u2003no\u00a0812 summary", "case\u00a0no:\u2009771", "nkp\u00a03_4", "दफा\u00a0८८ को\u00a0बारे", "प्रकरण\u00a0नं.\u00a0१२", "अनुच्छेद नं ४ के हो", "कुन-कुन\u00a0धारा", "कुन\u2003धारा",
)


def asked(s: SparkSession, d: str) -> DataFrame:
    """Every benchmark item's whole text behind one of the fixed questions."""
    lines = F.element_at(F.array(*(F.lit(x) for x in ASKED)), (F.col("item_id") % len(ASKED) + 1).cast("int"))
    return table(s, d, "benchmark").select("item_id", F.concat(lines, F.lit(" "), "text").alias("q"))


def query_intent(s, d):
    return asked(s, d).select("item_id", Q.intent(F.col("q")).alias("intent"), Q.token_budget(Q.intent(F.col("q"))).alias("budget"))


def query_identifiers(s, d):
    return asked(s, d).select("item_id", Q.decision_number(F.col("q"), F.lit("decision_777")).alias("decision_no"), Q.source_file(F.col("q")).alias("source"), Q.source_stem(F.col("q")).alias("source_stem"))


def number_list(s, d):
    return docs(s, d).select("doc_id", F.array_join(Q.numbers(F.col("text")), ",").alias("numbers"), (F.size(Q.numbers(F.col("text"))) >= 2).alias("comparison"))


def analyze_query(s, d):
    return asked(s, d).select("item_id", Q.analysis(F.col("q")).alias("a")).select("item_id", "a.*")


def factual_category(s, d):
    return asked(s, d).select("item_id", Q.factual_category(F.col("q")).alias("category"))


CASE_LINES = "निर्णय\u00a0नं.\u2003{n}\nफैसला\u00a0मिति:\u00a0२०६३/१/{k}\nविषय:\u00a0उत्प्रेषण\u00a0| x\nनिवेदक: रा\u0928\u093cम\u00a0\nविपक्षी:\u2009श्याम\nमाननीय\u00a0न्यायाधीश श्री कखगघ, चछजझ\nदफा ८८ र धारा १२ (१) दफा ८८\n"


def case_texts(s: SparkSession, d: str) -> DataFrame:
    top = F.format_string(CASE_LINES.replace("{n}", "%s").replace("{k}", "%s"), F.translate((F.col("doc_id") + 1000).cast("string"), K.ASCII_DIGITS, K.DEVANAGARI_DIGITS), (F.col("doc_id") % 9 + 1).cast("string"))
    return docs(s, d).select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file"), F.concat(F.when(F.col("doc_id") % 4 > 0, top).otherwise(""), "text").alias("text"))


def metadata_extract(s, d):
    m = case_texts(s, d).select("file", case_metadata(F.col("text"), F.col("file")).alias("m"))
    return m.select("file", "m.case_id", "m.decision_no", "m.date", "m.subject", "m.parties.appellant", "m.parties.respondent", "m.judges", "m.provisions")


def first_wins_case(s, d):
    return chunk_view(s, d).groupBy("case_id").agg(F.min_by(F.struct("idx", "page", "source"), "idx").alias("m")).select("case_id", "m.*")


def listed_cases(s, d):
    return chunk_view(s, d).groupBy("case_id", "decision_no").agg(F.min("idx").alias("first_idx")).withColumns({"date": F.lit("d"), "subject": F.lit("s")})


def case_list(s, d):
    return answers.case_list(listed_cases(s, d))


def case_lines(s, d):
    """The list as rows, a case for each document."""
    cases = docs(s, d).select(F.col("doc_id").alias("first_idx"), F.col("doc_id").cast("string").alias("decision_no"), F.col("lang").alias("date"), F.col("source").alias("subject"))
    return answers.case_lines(cases)


def corpus_cases(s, d):
    """The summary's cases as rows: the metadata of each one's first chunk."""
    rows = chunk_view(s, d).withColumns({"date": F.lit("d"), "subject": F.col("content"), "court": F.lit(""), "parties": F.struct(F.col("source").alias("appellant"), F.lit("").alias("respondent")), "judges": F.lit(""), "appellant_lawyer": F.lit(""), "respondent_lawyer": F.lit(""), "provisions": F.lit("")})
    rows = rows.withColumn("case_id", F.concat("case_id", F.lit("_"), (F.col("idx") % 1009).cast("string")))
    return chunks.case_rows(rows).select("case_id", "first_idx", "source", "decision_no", "subject", "parties.appellant")


def corpus_summary(s, d):
    c = chunk_view(s, d)
    return c.agg(F.count_distinct("source").alias("total_files"), F.sum("page").alias("total_pages"), F.count("*").alias("total_chunks"), F.array_join(F.sort_array(F.collect_set("case_id")), ",").alias("cases"))


def evidence_context(s, d):
    top = search.ranked(scored(s, d), TOP_K)
    return answers.evidence(top)


def fallback_answer(s, d):
    head = F.format_string("न्यायाधीश: %s\nपुनरावेदकका कानून व्यवसायी: %s", F.concat(F.lit("J"), F.col("item_id").cast("string")), F.when(F.col("item_id") % 2 == 0, "L").otherwise(""))
    return asked(s, d).select("item_id", answers.fallback(F.concat(F.element_at(F.array(F.lit("लायर "), F.lit("न्यायाधीश "), F.lit("")), (F.col("item_id") % 3 + 1).cast("int")), "q"), F.when(F.col("item_id") % 5 > 0, head)).alias("answer"))


def compare_cases(s, d):
    rows = chunk_view(s, d).where("is_header").groupBy("case_id").agg(F.concat(F.lit("A, माननीय B"), F.min("idx").cast("string")).alias("judges"))
    ids = s.createDataFrame([(0, "decision_100"), (1, "decision_105"), (2, "decision_999")], "position int, case_id string")
    none = s.createDataFrame([], "case_id string, introduction string, parties string, subject string")
    return answers.comparison_lines(ids, none, rows, "judges").select("position", "line")


#: Hand-written summaries, as the engine loads them: case id and fields in SUMMARY_FIELDS' order.
SUMMARY_FIELDS = ("introduction", "parties", "lawyers", "key_facts", "legal_questions", "reasoning", "final_order", "legal_principle", "subject")
SUMMARIES = (
    ("decision_100", "फैसला मिति: 2063/1/2\nन्यायाधीशहरू: सम्माननीय\u00a0राम , माननीय  श्याम र हरि।", "निवेदक: राम बहादुर\nविपक्षी: श्याम", "l", "k", "q", "तर्क " * 120, "f", "p", "उत्प्रेषण"),
    ("decision_105", "फैसला मिति १२", "विपक्षी: श्याम", "l", "k", "q", "छोटो तर्क", "f", "p", ""),
    ("decision_106", "न्यायाधीश राम", "निवेदक: हरि", None, "k", "q", "", "f", "p", "रिट"),
)


def summaries(s: SparkSession) -> DataFrame:
    return s.createDataFrame([*SUMMARIES], "case_id string, " + ", ".join(f"{f} string" for f in SUMMARY_FIELDS))


def document_summaries(s: SparkSession, d: str) -> DataFrame:
    """A summary for three documents in four, made of the whole text: with and without a date, judges, a petitioner, lawyers and a subject."""
    i = F.col("doc_id")
    date = F.when(i % 5 > 0, F.concat(F.lit("फैसला मिति: 2063/1/"), (i % 28).cast("string"), F.lit("\n"))).otherwise("फैसला मिति १२\n")
    judges = F.when(i % 3 > 0, F.concat(F.lit("न्यायाधीशहरू: सम्माननीय\u00a0"), "lang", F.lit(" , माननीय  "), "source", F.lit(" र हरि।\n"))).otherwise("")
    text = F.coalesce("text", F.lit(""))
    fields = {
        "introduction": F.concat(date, judges, text),
        "parties": F.concat(F.when(i % 7 > 0, "निवेदक: ").otherwise("पक्ष: "), text, F.lit("\nविपक्षी: श्याम")),
        "lawyers": F.when(i % 6 > 0, F.col("lang")),
        "key_facts": text,
        "legal_questions": F.col("source"),
        "reasoning": text,
        "final_order": F.col("lang"),
        "legal_principle": F.col("source"),
        "subject": F.when(i % 3 > 0, F.col("source")).otherwise(""),
    }
    return docs(s, d).where(i % 4 > 0).select(F.concat(F.lit("decision_"), i.cast("string")).alias("case_id"), *(c.alias(k) for k, c in fields.items()))


def compared(s: SparkSession, d: str, field: str) -> DataFrame:
    """A line for each document's case: from its summary, else its header row, which one in eight has in its place."""
    case = F.concat(F.lit("decision_"), F.col("doc_id").cast("string")).alias("case_id")
    headers = docs(s, d).where("doc_id % 8 = 4").select(case, F.concat(F.lit("A, माननीय B"), "source").alias("judges"))
    return answers.comparison_lines(docs(s, d).select(F.col("doc_id").alias("position"), case), document_summaries(s, d), headers, field).select("position", "line")


def compare_judges(s, d):
    return compared(s, d, "judges")


def compare_petitioner(s, d):
    return compared(s, d, "petitioner")


def compare_date(s, d):
    return compared(s, d, "date")


def compare_all(s, d):
    return compared(s, d, "all")


def compared_field(s, d):
    return asked(s, d).select("item_id", answers.compared_field(F.col("q")).alias("field"))


def common_judges(s, d):
    a, b = F.concat(F.lit("कमल, "), "source", F.lit(" र नवीन")), F.concat(F.col("lang"), F.lit(" र शोभा ,\u00a0"), F.when(F.col("doc_id") % 3 > 0, F.concat("source", F.lit(", कमल"))).otherwise("x"))
    return docs(s, d).select("doc_id", answers.common_judges(a, b).alias("common"))


def judges_clean(s, d):
    return docs(s, d).select("doc_id", answers.clean_judges(F.concat(F.lit("सम्माननीय\u00a0का.मु. राम ,माननीय  "), "text")).alias("judges"))


def summary_answer(s, d):
    return document_summaries(s, d).select("case_id", answers.summary_text().alias("answer"))


def reasoning_answer(s, d):
    rows = asked(s, d).join(F.broadcast(summaries(s).select("case_id", "reasoning")), F.col("case_id") == F.element_at(F.array(*(F.lit(x[0]) for x in SUMMARIES)), (F.col("item_id") % 3 + 1).cast("int")))  # three rows
    return rows.select("item_id", answers.reasoning_text(F.col("q"), F.col("reasoning")).alias("answer"))


def asked_paragraph(s, d):
    return asked(s, d).select("item_id", answers.asked_paragraph(F.col("q")).alias("number"))


def last_decision(s, d):
    text = F.concat("text", F.when(F.col("turn") % 3 > 0, F.concat(F.lit(" निर्णय नं.\u00a0१२३ र निर्णय नं. "), (F.col("turn") + 100).cast("string"))).otherwise(""))
    return table(s, d, "conversations").select("conv_id", "turn", Q.last_decision(text).alias("decision_no"))


def conversation_fold(s, d):
    rows = table(s, d, "conversations").withColumn("text", F.when(F.col("role") == "user", F.concat(F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("निर्णय नं. "), (F.col("turn") + 1000).cast("string"), F.lit(" "))).otherwise(F.lit("यो ")), "text")).otherwise(F.concat(F.lit("निर्णय नं. "), (F.col("conv_id") + 2000).cast("string"))))
    return session_fold(rows)


def page_text(s, d):
    return html_pages(table(s, d, "pages")).select("page_id", "url", F.length("text").alias("n_chars"), "text")


def paragraph_chunks(s, d):
    text = F.concat(F.lit("before प्रकरण नं. १२ "), danda(F.col("text")), F.lit(" (प्रकरण नं. 13) after"))
    return docs(s, d).select("doc_id", F.posexplode(T.paragraph_chunks(text)).alias("chunk_no", "p")).select("doc_id", "chunk_no", "p.number", "p.chunk")


def evidence_ranks(s, d):
    w = Window.orderBy(F.desc("score"), "idx")
    top = search.ranked(scored(s, d), TOP_K)
    return top.select(F.row_number().over(w).alias("rank"), "source", "decision_no", "page", F.format_string("%.4f", F.col("score")).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_queries, knn_queries, ocr_fixes, clean_text, clean_marks, normalize_digits, script_ratio, sentence_rows, normalize_match, repair_output, truncate_sentence, chunk_pack, chunk_index,
        header_union, char_trigrams, gram_df, doc_len, corpus_stats, bm25_scores, bm25_norm, lexical_score, knn_cosine, knn_postfilter, hybrid_fused, case_filter,
        case_dump, dominant_case, dominant_topk, neighbour_expand, hybrid_search, query_intent, query_identifiers, number_list, analyze_query, factual_category,
        metadata_extract, first_wins_case, case_list, case_lines, corpus_summary, corpus_cases, evidence_context, fallback_answer, compare_cases, conversation_fold, page_text,
        paragraph_chunks, evidence_ranks, search_list, current_case_filter, case_id_fallback, full_text, full_text_pages, page_validity, compare_judges, compare_petitioner, compare_date,
        compare_all, compared_field, common_judges, judges_clean, summary_answer, reasoning_answer, asked_paragraph, last_decision,
    )
}


# The same in SQL.


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: What is white space beside RE2's own.
BLANKS = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def uni(pattern: str) -> str:
    """The pattern with every ``\\s`` written out, inside a class or outside."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out.append(BLANKS if inside else f"[{BLANKS}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
        k += 2 if two[0] == "\\" else 1
    return "".join(out)


def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '{uni(r'^\s+|\s+$')}', '', 'g')"


def sql_fixes(e: str) -> str:
    for a, b in K.OCR_FIXES:
        e = f"replace({e}, {sql_text(a)}, {sql_text(b)})"
    return e


def sql_clean(e: str) -> str:
    e = rf"regexp_replace(nfc_normalize(coalesce({e}, '')), '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g')"
    e = rf"regexp_replace(regexp_replace({e}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return sql_strip(sql_fixes(e))


def sql_sentences(e: str) -> str:
    split = rf"string_split_regex(regexp_replace({e}, '{uni(r"([।!?])\s+")}', '\1' || chr(1), 'g'), '[\x01\n]+')"
    return f"list_filter(list_transform({split}, lambda x: {sql_strip('x')}), lambda x: x <> '')"


def sql_normal(e: str) -> str:
    return rf"regexp_replace(lower(translate(coalesce({e}, ''), '{K.DEVANAGARI_DIGITS}', '{K.ASCII_DIGITS}')), '[^\p{{L}}\p{{N}}_\x{{0900}}-\x{{097F}}]+', '', 'g')"


def sql_grams(e: str) -> str:
    return f"CASE WHEN length({e}) = 0 THEN []::VARCHAR[] WHEN length({e}) <= 3 THEN [{e}] ELSE list_transform(range(1, length({e}) - 1), lambda i: substring({e}, i, 3)) END"


DANDA = "replace(text, '.', '।')"
CHUNKS = "c AS (SELECT doc_id AS idx, source, 'decision_' || (100 + CAST(substr(source, 4) AS INT)) AS case_id, CAST(100 + CAST(substr(source, 4) AS INT) AS VARCHAR) AS decision_no, CAST(doc_id % 7 AS INT) AS page, doc_id % 50 = 0 AS is_header, text AS content FROM documents)"
GRAMS = rf"""t AS (SELECT doc_id AS idx, lower(regexp_replace(coalesce(text, ''), '{uni(r"\s+")}', '', 'g')) AS s FROM documents),
g AS (SELECT idx, unnest({sql_grams("s")}) AS gram FROM t),
posts AS (SELECT idx, gram, count(*) AS tf FROM g GROUP BY ALL),
df AS (SELECT gram, count(*) AS df FROM posts GROUP BY ALL),
dl AS (SELECT idx, CASE WHEN length(s) <= 3 THEN least(length(s), 1) ELSE length(s) - 2 END AS dl FROM t)"""
BM25 = rf"""{GRAMS}, st AS (SELECT (SELECT count(*) FROM dl) AS n, (SELECT avg(dl) FROM dl) AS avgdl),
ix AS (SELECT gram, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st), m AS (SELECT avg(raw) AS mean_idf FROM ix),
qg AS (SELECT gram, count(*) AS times FROM (SELECT unnest({sql_grams("'" + QUERY.replace(" ", "") + "'")}) AS gram) GROUP BY 1),
b AS (SELECT posts.idx, sum(times * CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM posts JOIN qg USING (gram) JOIN ix USING (gram) JOIN dl ON dl.idx = posts.idx, st, m GROUP BY 1)"""
KNN = f"""qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {VECTOR_ID}),
near AS (SELECT vec_id AS idx, 1 / (1 + distance) AS vector_score FROM (SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 9) AS distance FROM embeddings, qv) ORDER BY distance, idx LIMIT 100)"""
LEXICAL = f"""lx AS (SELECT doc_id AS idx, CASE WHEN s = '' THEN 0.0 ELSE least(((CASE WHEN contains(s, q) THEN 1.0 ELSE 0.0 END) + len(list_intersect(qs, gs))::DOUBLE / len(qs)) / 2, 1.0) END AS lexical_score
  FROM (SELECT doc_id, s, q, list_distinct({sql_grams("q")}) AS qs, list_distinct({sql_grams("s")}) AS gs FROM (SELECT doc_id, {sql_normal("text")} AS s, {sql_normal(sql_text(QUERY))} AS q FROM documents)))"""
FUSED = f"""{CHUNKS}, {BM25}, {KNN}, {LEXICAL}, mx AS (SELECT max(bm25) AS most FROM b JOIN c USING (idx)),
f0 AS (SELECT c.*, coalesce(vector_score, 0) AS vector_score, greatest(coalesce(bm25, 0), 0) / CASE WHEN most > 0 THEN most ELSE 1 END AS bm25_score, lexical_score
  FROM c LEFT JOIN near USING (idx) LEFT JOIN b USING (idx) JOIN lx USING (idx), mx),
f AS (SELECT *, round({ALPHA} * vector_score + {1 - ALPHA} * bm25_score + 0.2 * lexical_score, 9) AS score FROM f0)"""
SCORES6 = ", ".join(f"round({c}, 6) AS {c}" for c in search.SCORES)
PACK = f"""s AS (SELECT source, CAST(doc_id AS INT) AS page, {sql_sentences(sql_clean(DANDA))} AS sents FROM documents),
w AS (SELECT source, page, sents, 0 AS nxt, 0 AS first, 0::BIGINT AS size, NULL::INT AS a, NULL::INT AS b FROM s WHERE len(sents) > 0
  UNION ALL SELECT source, page, sents, nxt + 1,
    CASE WHEN nxt > first AND size + length(sents[nxt + 1]) + 1 > 600 THEN greatest(first, nxt - 1) ELSE first END,
    CASE WHEN nxt > first AND size + length(sents[nxt + 1]) + 1 > 600 THEN length(sents[nxt]) + 1 + length(sents[nxt + 1]) ELSE size + length(sents[nxt + 1]) + CASE WHEN nxt > first THEN 1 ELSE 0 END END,
    CASE WHEN nxt > first AND size + length(sents[nxt + 1]) + 1 > 600 THEN first END, CASE WHEN nxt > first AND size + length(sents[nxt + 1]) + 1 > 600 THEN nxt END
  FROM w WHERE nxt < len(sents)),
p AS (SELECT source, page, sents, a, b FROM w WHERE a IS NOT NULL UNION ALL SELECT source, page, sents, first, nxt FROM w WHERE nxt = len(sents)),
k AS (SELECT source, page, CAST(row_number() OVER (PARTITION BY source, page ORDER BY b) - 1 AS INT) AS chunk_no, array_to_string(sents[a + 1:b], ' ') AS content FROM p)"""
MIXED = "CASE WHEN idx % {} > 0 THEN 'decision_100' ELSE case_id END AS case_id"
NUMBERS = rf"list_filter(regexp_extract_all(regexp_replace(regexp_replace(translate(coalesce({{}}, ''), '{K.DEVANAGARI_DIGITS}', '{K.ASCII_DIGITS}'), '[\p{{{{L}}}}\p{{{{N}}}}_]+', ' \0 ', 'g'), '$', ' '), ' ([0-9]{{{{3,4}}}}) ', 1), lambda x: x <> '')"
ASK = f"q AS (SELECT item_id, list_extract([{', '.join(map(sql_text, ASKED))}], CAST(item_id % {len(ASKED)} + 1 AS INT)) || ' ' || text AS q FROM benchmark)"


def sql_any(e: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({e}, {sql_text(t)})" for t in terms) + ")"


def sql_first(e: str, patterns: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({e}, {sql_text('(?im)' + uni(p))}) THEN {sql_strip(f'regexp_extract({e}, {sql_text("(?im)" + uni(p))}, 1)')}" for p in patterns) + " ELSE '' END"


INTENT = f"""CASE WHEN {sql_any("l", K.LIST_PHRASES)} THEN 'LIST_CASES' WHEN {sql_any("l", K.SUMMARY_TERMS)} THEN 'CASE_SUMMARY'
  WHEN regexp_matches(l, '{uni(K.NAMED_DECISION)}') OR regexp_matches(l, '{uni(K.NAMED_FILE)}') OR contains(l, '.pdf') THEN 'CASE_LOOKUP'
  WHEN {sql_any("l", K.PROVISION_TERMS)} THEN 'LEGAL_PROVISION' WHEN {sql_any("l", K.COMPARISON_TERMS)} THEN 'COMPARISON' ELSE 'LEGAL_QA' END"""
N = f"translate(q, '{K.DEVANAGARI_DIGITS}', '{K.ASCII_DIGITS}')"
DECISION = "coalesce(" + ", ".join(f"nullif(regexp_extract(n, '{uni(p)}', 1), '')" for p in K.DECISION_PATTERNS) + f", CASE WHEN {sql_any('l', K.CASE_KEYWORDS)} AND len(alone) = 1 THEN alone[1] END)"
CATEGORY = f"""CASE WHEN {sql_any("l", K.LAWYER_WORDS)} THEN 'lawyers' WHEN regexp_matches(l, '(^|[^\\p{{L}}\\p{{N}}_])कसले[\\p{{L}}\\p{{N}}_]') THEN 'petitioner' WHEN {sql_any("l", K.JUDGE_WORDS)} THEN 'judges'
  WHEN {sql_any("l", K.FACT_PROVISION_WORDS)} THEN 'provisions' WHEN contains(l, 'विरुद्ध') THEN 'respondent' WHEN {sql_any("l", K.PETITIONER_WORDS)} THEN 'petitioner'
  WHEN contains(l, 'मुद्दा') AND contains(l, 'प्रकार') THEN 'case_type' WHEN {sql_any("l", ("मिति", "कहिले"))} THEN 'date' WHEN contains(l, 'फैसला') AND {sql_any("l", ("के", "कस्तो", "गरेको"))} THEN 'final_order'
  WHEN contains(l, 'मुद्दा') AND contains(l, 'नं') THEN 'case_number' END"""
SPECIFIC = f"regexp_matches(l, '{uni(K.SPECIFIC_PROVISION[0])}') OR regexp_matches(replace(l, 'कुन-कुन', 'कुन-'), '{uni(K.SPECIFIC_PROVISION[1]).removeprefix('(?<!कुन-)')}') OR regexp_matches(l, '{uni(K.SPECIFIC_PROVISION[2])}')"
TRUNCATED = "CASE WHEN length({x}) <= {n} THEN {x} WHEN regexp_matches(substring({x}, {m}, 150), '[।\\n?!]') THEN substring({x}, 1, {m} - 1) || regexp_extract(substring({x}, {m}, 150), '(?s)^(.*[।\\n?!])', 1) WHEN contains(substring({x}, {m}, 150), ' ') THEN substring({x}, 1, {m} - 1) || regexp_extract(substring({x}, {m}, 150), '(?s)^(.*) ', 1) || ' ...' ELSE substring({x}, 1, {n}) || ' ...' END"
CASE_TOP = "'" + CASE_LINES.replace("{n}", "' || translate(CAST(doc_id + 1000 AS VARCHAR), '" + K.ASCII_DIGITS + "', '" + K.DEVANAGARI_DIGITS + "') || '").replace("{k}", "' || CAST(doc_id % 9 + 1 AS VARCHAR) || '") + "'"
HEAD = "concat_ws(chr(10), 'CASE_ID: ' || case_id, 'निर्णय नं.: ' || decision_no, 'मिति: 2063-01-02', 'अदालत: ', 'विषय: ', 'मुद्दाको प्रकार: ', 'न्यायाधीश: ', 'पुनरावेदक/निवेदक: A', 'प्रत्यर्थी/विपक्षी: ', 'पुनरावेदकका कानून व्यवसायी: ', 'प्रत्यर्थीका कानून व्यवसायी: ', 'प्रमुख कानूनी प्रावधान: ')"
BODY = "'[CASE_ID=' || case_id || '] [DECISION_NO=' || decision_no || '] [DATE=2063-01-02] [SUBJECT=UNKNOWN] [COURT=UNKNOWN] [CASE_TYPE=UNKNOWN] [JUDGES=UNKNOWN] [APPELLANT=A] [RESPONDENT=] [APPELLANT_LAWYER=UNKNOWN] [RESPONDENT_LAWYER=UNKNOWN] [PROVISIONS=UNKNOWN] [SOURCE=' || source || '] [PAGE=' || page || ']' || chr(10) || content"
VOTES = f"f1 AS (SELECT * REPLACE ({MIXED.format(3).replace(' AS case_id', '')} AS case_id) FROM f), v AS (SELECT case_id, count(*) AS votes, min(rank) AS first FROM (SELECT *, row_number() OVER (ORDER BY score DESC, idx) AS rank FROM f1) WHERE rank <= 10 GROUP BY 1), dc AS (SELECT case_id FROM (SELECT * FROM v ORDER BY votes DESC, first LIMIT 1) WHERE votes >= 5)"

PLAIN_VOTES = "v AS (SELECT case_id, count(*) AS votes, min(rank) AS first FROM (SELECT *, row_number() OVER (ORDER BY score DESC, idx) AS rank FROM f) WHERE rank <= 10 GROUP BY 1), dc AS (SELECT case_id FROM (SELECT * FROM v ORDER BY votes DESC, first LIMIT 1) WHERE votes >= 5)"
DEVANAGARI_WORDS = "[" + ", ".join(map(sql_text, (*K.FOLLOWUP_PRONOUNS, *K.CASE_REFERENCES))) + "]"
TURN = "CASE WHEN role = 'user' THEN CASE WHEN conv_id % 3 = 0 THEN 'निर्णय नं. ' || (turn + 1000) || ' ' ELSE 'यो ' END || text ELSE 'निर्णय नं. ' || (conv_id + 2000) END"
SUMMARY_ROWS = "su(case_id, " + ", ".join(SUMMARY_FIELDS) + ") AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else sql_text(x) for x in row) + ")" for row in SUMMARIES) + ")"


def sql_judges(e: str) -> str:
    e = sql_fixes(e)
    for pattern, to in K.JUDGE_TITLES:
        e = f"regexp_replace({e}, '{uni(pattern)}', '{to}', 'g')"
    return sql_strip(e)


DOCUMENT_SUMMARIES = f"""su AS (SELECT 'decision_' || doc_id AS case_id,
    CASE WHEN doc_id % 5 > 0 THEN 'फैसला मिति: 2063/1/' || (doc_id % 28) ELSE 'फैसला मिति १२' END || chr(10) || CASE WHEN doc_id % 3 > 0 THEN 'न्यायाधीशहरू: सम्माननीय' || chr(160) || lang || ' , माननीय  ' || source || ' र हरि।' || chr(10) ELSE '' END || coalesce(text, '') AS introduction,
    CASE WHEN doc_id % 7 > 0 THEN 'निवेदक: ' ELSE 'पक्ष: ' END || coalesce(text, '') || chr(10) || 'विपक्षी: श्याम' AS parties, CASE WHEN doc_id % 6 > 0 THEN lang END AS lawyers, coalesce(text, '') AS key_facts, source AS legal_questions,
    coalesce(text, '') AS reasoning, lang AS final_order, source AS legal_principle, CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END AS subject FROM documents WHERE doc_id % 4 > 0)"""


def sql_compared(text: str, headers: bool = False) -> str:
    """Lines of cases with a summary by ``text``; of others only the judges have header rows to fall back on."""
    known = f"WHEN h.case_id IS NOT NULL THEN 'न्यायाधीश: ' || {sql_judges('h.judges')} " if headers else ""
    return f"""WITH {DOCUMENT_SUMMARIES}, a AS (SELECT doc_id AS position, 'decision_' || doc_id AS case_id FROM documents), h AS (SELECT 'decision_' || doc_id AS case_id, 'A, माननीय B' || source AS judges FROM documents WHERE doc_id % 8 = 4)
      SELECT position, '**निर्णय नं. ' || replace(case_id, 'decision_', '') || '** – ' || CASE WHEN introduction IS NOT NULL THEN {text} {known}ELSE 'जानकारी उपलब्ध छैन' END AS line
      FROM a LEFT JOIN su USING (case_id) LEFT JOIN h USING (case_id)"""


WRITTEN_JUDGES = sql_judges(sql_strip(f"regexp_extract(introduction, '{uni(K.JUDGES_LINE)}', 1)"))
PARAGRAPHS = f"""t AS (SELECT doc_id, {sql_text("before प्रकरण नं. १२ ")} || {DANDA} || {sql_text(" (प्रकरण नं. 13) after")} AS x FROM documents),
p AS (SELECT doc_id, string_split_regex(x, '{uni(K.PARAGRAPH_MARKER.removeprefix("(?U)"))}') AS bodies, regexp_extract_all(x, '{uni(K.PARAGRAPH_MARKER.removeprefix("(?U)"))}', 1) AS numbers FROM t),
b AS (SELECT doc_id, generate_subscripts(bodies, 1) AS part, unnest(bodies) AS body, numbers FROM p),
s AS (SELECT doc_id, part, CASE WHEN part > 1 THEN numbers[part - 1] END AS number, list_filter(string_split_regex(regexp_replace(body, '{uni("([।!?])" + chr(92) + "s+")}', '\\1' || chr(1), 'g'), chr(1)), lambda x: {sql_strip("x")} <> '') AS own FROM b),
q AS (SELECT doc_id, part, number, CASE WHEN number IS NULL THEN own ELSE list_prepend(number, own) END AS sents FROM s),
w AS (SELECT doc_id, part, number, sents, 0 AS nxt, 0 AS first, 0::BIGINT AS size, NULL::INT AS a, NULL::INT AS b FROM q WHERE len(sents) > 0
  UNION ALL SELECT doc_id, part, number, sents, nxt + 1,
    CASE WHEN nxt > first AND size + length(sents[nxt + 1]) > 600 THEN greatest(first, nxt - 100) ELSE first END,
    CASE WHEN nxt > first AND size + length(sents[nxt + 1]) > 600 THEN list_sum(list_transform(sents[greatest(first, nxt - 100) + 1:nxt + 1], lambda z: length(z)))::BIGINT ELSE size + length(sents[nxt + 1]) END,
    CASE WHEN nxt > first AND size + length(sents[nxt + 1]) > 600 THEN first END, CASE WHEN nxt > first AND size + length(sents[nxt + 1]) > 600 THEN nxt END
  FROM w WHERE nxt < len(sents)),
r AS (SELECT doc_id, part, number, sents, a, b FROM w WHERE a IS NOT NULL UNION ALL SELECT doc_id, part, number, sents, first, nxt FROM w WHERE nxt = len(sents) AND number IS NOT NULL),
k AS (SELECT doc_id, part, b, number, {sql_strip("array_to_string(sents[a + 1:b], ' ')")} AS chunk FROM r)"""
NEIGHBOURS = f"""tp AS (SELECT *, row_number() OVER (ORDER BY score DESC, idx) AS rank FROM f ORDER BY score DESC, idx LIMIT {TOP_K}),
  e AS (SELECT idx + delta AS idx, case_id AS of_case, rank, role, score * CASE WHEN role = 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score FROM tp, (VALUES (0, 0), (-1, 1), (1, 2)) d(delta, role)),
  o AS (SELECT e.*, n.case_id FROM e JOIN c n ON n.idx = e.idx WHERE role = 0 OR n.case_id = of_case QUALIFY row_number() OVER (PARTITION BY e.idx ORDER BY rank, role) = 1),
  z AS (SELECT row_number() OVER (ORDER BY score DESC, rank, role) AS rank, idx, case_id, score FROM o)"""

SQL = {
    "hybrid_search": f"""WITH {FUSED}, {PLAIN_VOTES}, {NEIGHBOURS}, dom AS (SELECT row_number() OVER (ORDER BY score DESC, idx) AS rank, idx, case_id, score FROM f SEMI JOIN dc USING (case_id))
      SELECT CAST(rank AS INT) AS rank, idx, case_id, round(score, 6) AS score FROM dom WHERE rank <= {TOP_K} UNION ALL SELECT CAST(rank AS INT), idx, case_id, round(score, 6) FROM z WHERE rank <= {3 * TOP_K} AND NOT EXISTS (SELECT 1 FROM dc)""",
    "search_list": f"""WITH {FUSED.replace(sql_text(QUERY), sql_text(LISTING)).replace("'" + QUERY.replace(" ", "") + "'", "'" + LISTING.replace(" ", "") + "'").replace(f"{ALPHA} *", "0.5 *").replace(f"{1 - ALPHA} *", "0.5 *")}
      SELECT CAST(row_number() OVER (ORDER BY f.score DESC, idx) AS INT) AS rank, idx, case_id, round(f.score, 6) AS score FROM f ORDER BY f.score DESC, idx LIMIT 7""",
    "current_case_filter": f"WITH {CHUNKS} SELECT idx, case_id FROM c WHERE case_id = 'decision_{CASE}'",
    "case_id_fallback": f"WITH {CHUNKS} SELECT idx, case_id FROM c WHERE case_id = 'decision_{CASE}'",
    "full_text": f"WITH t AS (SELECT source, string_agg({sql_clean(DANDA)}, chr(10) || chr(10) ORDER BY CAST(doc_id AS INT)) AS x FROM documents GROUP BY 1) SELECT source, 1 AS total_pages, length(x)::INT AS n_chars, sha256(x) AS text_sha256 FROM t",
    "page_validity": rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(text, 'aeioun', 'कखगघङत') ELSE text END AS x FROM documents), l AS (SELECT *, regexp_replace(x, '[^\p{{L}}]', '', 'g') AS letters FROM t)
      SELECT doc_id, length({sql_strip("x")}) >= 20 AND coalesce(length(regexp_replace(letters, '[^\x{{0900}}-\x{{097F}}]', '', 'g')) / nullif(length(letters), 0), 0) >= 0.4 AS native_ok, length({sql_clean("x")})::INT AS n_chars FROM l""",
    "paragraph_chunks": f"WITH RECURSIVE {PARAGRAPHS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, b) - 1 AS INT) AS chunk_no, number, chunk FROM k WHERE chunk <> ''",
    "compare_judges": sql_compared(f"'न्यायाधीश: ' || CASE WHEN {WRITTEN_JUDGES} = '' THEN 'अज्ञात' ELSE {WRITTEN_JUDGES} END", headers=True),
    "compare_petitioner": sql_compared(f"'निवेदक: ' || CASE WHEN contains(parties, 'निवेदक:') THEN {sql_strip("split_part(split_part(parties, 'निवेदक:', 2), 'विपक्षी:', 1)")} ELSE 'अज्ञात' END"),
    "compare_date": sql_compared(f"'फैसला मिति: ' || coalesce(nullif(regexp_extract(introduction, '{uni(K.DECISION_DATE)}', 1), ''), 'अज्ञात')"),
    "compare_all": sql_compared("coalesce(nullif(subject, ''), 'विषय अज्ञात')"),
    "compared_field": f"WITH {ASK} SELECT item_id, CASE WHEN {sql_any('q', ('न्यायाधीश', 'इजलास', 'जज'))} THEN 'judges' WHEN {sql_any('q', ('निवेदक', 'पुनरावेदक'))} THEN 'petitioner' WHEN contains(q, 'मिति') THEN 'date' ELSE 'all' END AS field FROM q",
    "common_judges": f"""WITH t AS (SELECT doc_id, ['कमल', source, 'नवीन'] AS a, CASE WHEN doc_id % 3 > 0 THEN [lang, 'शोभा', source, 'कमल'] ELSE [lang, 'शोभा', 'x'] END AS b FROM documents), i AS (SELECT doc_id, list_filter(a, lambda x: list_contains(b, x)) AS shared FROM t)
      SELECT doc_id, chr(10) || '**साझा न्यायाधीश:** ' || CASE WHEN len(shared) > 0 THEN array_to_string(shared, ', ') ELSE 'कुनै पनि छैनन्' END AS common FROM i""",
    "judges_clean": f"SELECT doc_id, {sql_judges(sql_text('सम्माननीय' + chr(0xA0) + 'का.मु. राम ,माननीय  ') + ' || text')} AS judges FROM documents",
    "summary_answer": f"WITH {DOCUMENT_SUMMARIES} SELECT case_id, " + " || chr(10) || chr(10) || ".join(f"'**{title}**' || chr(10) || {field}" for title, field in K.SUMMARY_PARTS) + " AS answer FROM su",
    "reasoning_answer": f"""WITH {ASK}, {SUMMARY_ROWS}, x AS (SELECT item_id, lower(q) AS l, reasoning AS r FROM q JOIN su ON case_id = list_extract([{", ".join(sql_text(x[0]) for x in SUMMARIES)}], CAST(item_id % 3 + 1 AS INT)))
      SELECT item_id, CASE WHEN {sql_any("l", K.REASONING_WORDS)} AND NOT {sql_any("l", K.REASONING_EXCEPT)} AND r <> '' THEN 'अदालतको तर्क/निष्कर्ष:' || chr(10) || chr(10) || CASE WHEN length(r) > 500 THEN substring(r, 1, 500) || '...' ELSE r END END AS answer FROM x""",
    "asked_paragraph": f"WITH {ASK} SELECT item_id, nullif(regexp_extract(q, '{uni(K.ASKED_PARAGRAPH)}', 1), '') AS number FROM q",
    "last_decision": f"SELECT conv_id, turn, list_extract(regexp_extract_all(text || CASE WHEN turn % 3 > 0 THEN ' निर्णय नं.' || chr(160) || '१२३ र निर्णय नं. ' || (turn + 100) ELSE '' END, '{uni(K.LAST_DECISION)}', 1), -1) AS decision_no FROM conversations",
    "conversation_fold": f"""WITH RECURSIVE x AS (SELECT conv_id, turn, role, {TURN} AS raw FROM conversations), y AS (SELECT *, {sql_clean("raw")} AS q FROM x),
      n AS (SELECT *, lower(q) AS l, {N} AS n, {NUMBERS.format("q")} AS alone FROM y),
      z AS (SELECT conv_id, turn, role, q, len(alone) >= 2 AS cmp, {DECISION} AS named, {sql_any("l", K.RELATIVE_PRONOUNS)} AS pron, list_has_any(string_split_regex(l, '{uni(chr(92) + "s+")}'), {DEVANAGARI_WORDS}) AS ref,
        list_extract(regexp_extract_all(raw, '{uni(K.LAST_DECISION)}', 1), -1) AS quoted, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM n),
      s AS (SELECT conv_id, 0::BIGINT AS i, NULL::VARCHAR AS cur, NULL::VARCHAR AS last, NULL::BIGINT AS turn, NULL::VARCHAR AS role, NULL::VARCHAR AS resolved, NULL::BOOLEAN AS cmp FROM (SELECT DISTINCT conv_id FROM z)
        UNION ALL SELECT conv_id, i, CASE WHEN role = 'user' THEN CASE WHEN cmp THEN c1 ELSE coalesce(new, last) END ELSE c0 END, CASE WHEN role = 'assistant' THEN quoted ELSE last END, turn, role, resolved, cmp FROM (
          SELECT *, CASE WHEN q = '' THEN c1 WHEN p2 IS NOT NULL THEN p2 WHEN ref THEN coalesce(c1, last) ELSE c1 END AS new,
            CASE WHEN q <> '' AND p2 IS NULL AND ref AND coalesce(c1, last) IS NOT NULL THEN 'मुद्दा decision_' || coalesce(c1, last) || ' (निर्णय नं. ' || coalesce(c1, last) || ') को बारेमा: ' || q ELSE q END AS resolved FROM (
            SELECT *, coalesce(named, CASE WHEN pron THEN c1 END) AS p2 FROM (
              SELECT z.conv_id, z.i, z.turn, z.role, z.q, z.cmp, z.named, z.pron, z.ref, z.quoted, s.cur AS c0, s.last, CASE WHEN z.cmp THEN s.cur ELSE coalesce(z.named, s.cur) END AS c1 FROM s JOIN z ON z.conv_id = s.conv_id AND z.i = s.i + 1))))
      SELECT conv_id, turn, CASE WHEN NOT cmp THEN 'decision_' || cur END AS search_case, 'decision_' || cur AS current_case, resolved AS resolved_query, cmp AS comparison FROM s WHERE role = 'user'""",
    "bm25_topk": f"WITH {BM25} SELECT idx, round(bm25, 6) AS bm25 FROM b ORDER BY 2 DESC, 1 LIMIT 10",
    "bm25_queries": f"""WITH {BM25}, ig AS (SELECT item_id, unnest({sql_grams("s")}) AS gram FROM (SELECT item_id, lower(regexp_replace(coalesce(text, ''), '{uni(r"\s+")}', '', 'g')) AS s FROM benchmark)), im AS (SELECT item_id, gram, count(*) AS times FROM ig GROUP BY ALL),
      sc AS (SELECT item_id, posts.idx, round(sum(times * CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM posts JOIN im USING (gram) JOIN ix USING (gram) JOIN dl ON dl.idx = posts.idx, st, m GROUP BY 1, 2)
      SELECT item_id AS query_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, idx) AS INT) AS rank, idx, bm25 FROM sc QUALIFY rank <= 5""",
    "knn_queries": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT q.vec_id AS query_id, e.vec_id AS idx, round(1 - list_cosine_similarity(e.v, q.v), 9) AS distance FROM e, e q WHERE q.vec_id % 100 = 0)
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, idx) AS INT) AS rank, idx, round(distance, 6) AS distance FROM d QUALIFY rank <= 10""",
    "ocr_fixes": f"SELECT doc_id, {sql_fixes("'काश SEAT ' || text")} AS fixed FROM documents",
    "clean_text": f"SELECT doc_id, {sql_clean(f"{sql_text(CLEAN_HEAD)} || text || {sql_text(CLEAN_TAIL)}")} AS cleaned FROM documents",
    "clean_marks": f"SELECT doc_id, {sql_clean(f"{sql_text(CLEAN_HEAD)} || text || {sql_text(CLEAN_TAIL)}")} AS cleaned FROM documents",
    "normalize_digits": "SELECT doc_id, text AS normal FROM documents",
    "script_ratio": r"""WITH t AS (SELECT doc_id, translate(text, 'aeiou', 'कखगघङ') AS x FROM documents), l AS (SELECT *, regexp_replace(x, '[^\p{L}]', '', 'g') AS letters FROM t),
      r AS (SELECT *, CASE WHEN length(letters) > 0 THEN length(regexp_replace(letters, '[^\x{0900}-\x{097F}]', '', 'g')) / length(letters) END AS ratio FROM l)
      SELECT doc_id, round(ratio, 9) AS ratio, length(trim(x, chr(32) || chr(10) || chr(9) || chr(13))) >= 20 AND coalesce(ratio, 0) >= 0.4 AS valid FROM r""",
    "sentence_rows": f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS sentence_no, unnest(s) AS sentence FROM (SELECT doc_id, {sql_sentences(sql_clean(DANDA))} AS s FROM documents)",
    "normalize_match": f"SELECT doc_id, {sql_normal('text')} AS normal FROM documents",
    "repair_output": rf"SELECT doc_id, regexp_replace(regexp_replace({sql_strip('text')}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS repaired FROM documents",
    "truncate_sentence": f"SELECT doc_id, {TRUNCATED.format(x='x', n=300, m=151)} AS short FROM (SELECT doc_id, {DANDA} AS x FROM documents)",
    "chunk_pack": f"WITH RECURSIVE {PACK} SELECT source, page, chunk_no, content FROM k",
    "chunk_index": f"WITH RECURSIVE {PACK} SELECT row_number() OVER (ORDER BY source, page, chunk_no) - 1 AS idx, source, page, chunk_no, length(content)::INT AS n_chars FROM k",
    "header_union": f"WITH {CHUNKS} SELECT idx, 0 AS page, true AS is_header, {HEAD} AS search_text FROM c UNION ALL SELECT idx, page, false, {BODY} FROM c",
    "char_trigrams": f"WITH {GRAMS} SELECT idx, count(*) AS grams, sum(tf)::BIGINT AS total, max(tf) AS most FROM posts GROUP BY 1",
    "gram_df": f"WITH {GRAMS} SELECT gram, df FROM df",
    "doc_len": f"WITH {GRAMS} SELECT idx, dl::BIGINT AS dl FROM dl",
    "corpus_stats": f"WITH {BM25} SELECT n, round(avgdl, 6) AS avgdl, round(mean_idf, 6) AS mean_idf FROM st, m",
    "bm25_scores": f"WITH {BM25} SELECT idx, round(bm25, 6) AS bm25 FROM b",
    "bm25_norm": f"WITH {CHUNKS}, {BM25}, cc AS (SELECT idx, coalesce(bm25, 0) AS bm25 FROM c LEFT JOIN b USING (idx) WHERE case_id = 'decision_{CASE}') SELECT idx, round(greatest(bm25, 0) / (SELECT CASE WHEN max(bm25) > 0 THEN max(bm25) ELSE 1 END FROM cc), 6) AS bm25_score FROM cc",
    "lexical_score": f"WITH {LEXICAL} SELECT idx AS doc_id, round(lexical_score, 9) AS lexical FROM lx",
    "knn_cosine": f"WITH {KNN} SELECT idx, round(vector_score, 6) AS vector_score FROM near",
    "knn_postfilter": f"WITH {CHUNKS}, {KNN} SELECT idx, round(vector_score, 6) AS vector_score FROM near SEMI JOIN (SELECT idx FROM c WHERE case_id = 'decision_{CASE}') x USING (idx)",
    "hybrid_fused": f"WITH {FUSED} SELECT idx, {SCORES6} FROM f",
    "case_filter": f"WITH {CHUNKS} SELECT idx, case_id FROM c WHERE decision_no = '{CASE}'",
    "case_dump": f"WITH {CHUNKS}, x AS (SELECT * FROM c WHERE decision_no = '{CASE}' ORDER BY page, idx LIMIT 50) SELECT CAST(row_number() OVER (ORDER BY is_header DESC, page DESC, idx) AS INT) AS rank, idx, page, is_header, 1.0::DOUBLE AS score FROM x",
    "dominant_case": f"WITH {FUSED}, {VOTES} SELECT case_id FROM dc",
    "dominant_topk": f"WITH {FUSED}, {VOTES}, x AS (SELECT * FROM f1 SEMI JOIN dc USING (case_id) ORDER BY score DESC, idx LIMIT {TOP_K}) SELECT CAST(row_number() OVER (ORDER BY score DESC, idx) AS INT) AS rank, idx, round(score, 6) AS score FROM x",
    "neighbour_expand": f"""WITH {FUSED}, f1 AS (SELECT * REPLACE ({MIXED.format(5).replace(" AS case_id", "")} AS case_id) FROM f), tp AS (SELECT *, row_number() OVER (ORDER BY score DESC, idx) AS rank FROM f1 ORDER BY score DESC, idx LIMIT {TOP_K}),
      e AS (SELECT idx + delta AS idx, case_id AS of_case, rank, role, CASE WHEN role = 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS share, score, vector_score, bm25_score, lexical_score FROM tp, (VALUES (0, 0), (-1, 1), (1, 2)) d(delta, role)),
      o AS (SELECT e.* FROM e JOIN (SELECT idx, {MIXED.format(5)} FROM c) n ON n.idx = e.idx WHERE role = 0 OR n.case_id = of_case QUALIFY row_number() OVER (PARTITION BY e.idx ORDER BY rank, role) = 1),
      z AS (SELECT idx, rank, role, {", ".join(f"{c} * share AS {c}" for c in search.SCORES)} FROM o ORDER BY score DESC, rank, role LIMIT {3 * TOP_K}) SELECT idx, {SCORES6} FROM z""",
    "query_intent": f"WITH {ASK}, i AS (SELECT item_id, {INTENT} AS intent FROM (SELECT item_id, {sql_strip('lower(q)')} AS l FROM q)) SELECT item_id, intent, CASE WHEN intent IN ('LIST_CASES', 'CASE_LOOKUP') THEN 500 WHEN intent = 'CASE_SUMMARY' THEN 1200 ELSE 1024 END AS budget FROM i",
    "query_identifiers": rf"""WITH {ASK}, n AS (SELECT item_id, q, lower(q) AS l, {N} AS n, {NUMBERS.format("q")} AS alone FROM q)
      SELECT item_id, coalesce({DECISION}, CASE WHEN {sql_any("l", K.RELATIVE_PRONOUNS)} THEN '777' END) AS decision_no,
        nullif(regexp_extract(q, '{K.SOURCE_FILE}', 1), '') AS source, CASE WHEN regexp_extract(q, '{K.SOURCE_FILE}', 1) = '' THEN nullif(regexp_extract(q, '{K.SOURCE_STEM}', 1), '') END AS source_stem FROM n""",
    "number_list": f"SELECT doc_id, array_to_string(n, ',') AS numbers, len(n) >= 2 AS comparison FROM (SELECT doc_id, {NUMBERS.format('text')} AS n FROM documents)",
    "analyze_query": rf"""WITH {ASK}, k AS (SELECT item_id, regexp_replace(lower(nullif(regexp_extract(q, '{uni(K.ANALYSED_SOURCE)}', 0), '')), '{uni(K.SOURCE_MARKS)}', '_', 'g') AS source_filter,
      CASE WHEN {sql_any("q", ("निवेदक", "विपक्षी"))} THEN 'ENTITY_CASE_ANALYSIS' WHEN {sql_any("q", ("फैसला", "विवाद", "पृष्ठभूमि", "आदेश"))} THEN 'CASE_SUMMARY' WHEN {sql_any("q", ("धारा", "दफा"))} THEN 'LEGAL_PROVISION_LOOKUP' ELSE 'DIRECT_FACT' END AS query_type FROM q)
      SELECT *, query_type IN ('ENTITY_CASE_ANALYSIS', 'CASE_SUMMARY') AS requires_expansion FROM k""",
    "factual_category": rf"""WITH {ASK}, k AS (SELECT item_id, l, {CATEGORY} AS kind FROM (SELECT item_id, lower(q) AS l FROM q))
      SELECT item_id, CASE WHEN {sql_any("l", K.REASONING_WORDS)} AND NOT {sql_any("l", K.REASONING_EXCEPT)} THEN 'reasoning'
        WHEN kind = 'provisions' AND ({SPECIFIC}) THEN NULL ELSE kind END AS category FROM k""",
    "metadata_extract": rf"""WITH x AS (SELECT doc_id || '.pdf' AS file, {sql_clean(f"CASE WHEN doc_id % 4 > 0 THEN {CASE_TOP} ELSE '' END || text")} AS t, doc_id FROM documents), y AS (SELECT *, translate(t, '{K.DEVANAGARI_DIGITS}', '{K.ASCII_DIGITS}') AS n FROM x),
      z AS (SELECT *, {sql_first("n", PATTERNS["decision_no"])} AS decision_no, {sql_first("t", PATTERNS["subject"])} AS s FROM y)
      SELECT file, CASE WHEN decision_no <> '' THEN 'decision_' || decision_no ELSE 'file_' || doc_id END AS case_id, decision_no, {sql_first("n", PATTERNS["date"])} AS date, s AS subject,
        {sql_first("t", PATTERNS["appellant"])} AS appellant, {sql_first("t", PATTERNS["respondent"])} AS respondent,
        CASE WHEN doc_id % 4 > 0 THEN 'कखगघ, चछजझ' ELSE '' END AS judges, CASE WHEN doc_id % 4 > 0 THEN 'दफा ८८, धारा १२ (१)' ELSE '' END AS provisions FROM z""",
    "first_wins_case": f"WITH {CHUNKS} SELECT case_id, idx, page, source FROM c QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY idx) = 1",
    "case_list": f"WITH {CHUNKS}, x AS (SELECT decision_no, min(idx) AS first_idx FROM c GROUP BY 1) SELECT {sql_text(K.CASES_HEADING)} || chr(10) || string_agg('- निर्णय नं. ' || decision_no || ' (मिति: d, विषय: s)', chr(10) ORDER BY first_idx) AS answer FROM x",
    "case_lines": "SELECT doc_id AS first_idx, '- निर्णय नं. ' || doc_id || ' (मिति: ' || lang || ', विषय: ' || source || ')' AS line FROM documents",
    "corpus_cases": f"WITH {CHUNKS} SELECT case_id || '_' || (idx % 1009) AS case_id, idx AS first_idx, source, decision_no, content AS subject, source AS appellant FROM c QUALIFY row_number() OVER (PARTITION BY case_id || '_' || (idx % 1009) ORDER BY idx) = 1",
    "full_text_pages": f"SELECT source, CAST(doc_id AS INT) AS page, length({sql_clean(DANDA)})::INT AS n_chars, sha256({sql_clean(DANDA)}) AS text_sha256 FROM documents",
    "corpus_summary": f"WITH {CHUNKS} SELECT count(DISTINCT source) AS total_files, sum(page)::BIGINT AS total_pages, count(*) AS total_chunks, array_to_string(list_sort(list(DISTINCT case_id)), ',') AS cases FROM c",
    "evidence_context": f"WITH {FUSED}, tp AS (SELECT *, row_number() OVER (ORDER BY score DESC, idx) AS rank FROM f ORDER BY score DESC, idx LIMIT 5) SELECT string_agg('--- पृष्ठ ' || page || ' ---' || chr(10) || {TRUNCATED.format(x='content', n=600, m=451)}, chr(10) || chr(10) ORDER BY rank) AS context FROM tp",
    "fallback_answer": f"""WITH {ASK}, h AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'लायर ' WHEN 1 THEN 'न्यायाधीश ' ELSE '' END || q AS q FROM q)
      SELECT item_id, CASE WHEN item_id % 5 = 0 THEN {sql_text(K.NO_INFO)} WHEN {sql_any("q", ("लायर", "कानून व्यवसायी"))} AND item_id % 2 = 0 THEN 'पुनरावेदकका कानून व्यवसायी: L'
        WHEN {sql_any("q", ("न्यायाधीश", "इजलास"))} THEN 'न्यायाधीश: J' || item_id ELSE {sql_text(K.NOT_IN_DOCUMENTS)} END AS answer FROM h""",
    "compare_cases": f"WITH {CHUNKS}, h AS (SELECT case_id, min(idx) AS i FROM c WHERE is_header GROUP BY 1), a(position, case_id) AS (VALUES (0, 'decision_100'), (1, 'decision_105'), (2, 'decision_999')) SELECT position, '**निर्णय नं. ' || substr(case_id, 10) || '** – ' || CASE WHEN i IS NULL THEN 'जानकारी उपलब्ध छैन' ELSE 'न्यायाधीश: A, B' || i END AS line FROM a LEFT JOIN h USING (case_id)",
    "page_text": r"SELECT page_id, url, length(t)::INT AS n_chars, t AS text FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)",
    "evidence_ranks": f"WITH {FUSED} SELECT CAST(row_number() OVER (ORDER BY f.score DESC, idx) AS INT) AS rank, source, decision_no, page, printf('%.4f', f.score) AS score FROM f ORDER BY f.score DESC, idx LIMIT {TOP_K}",
}
