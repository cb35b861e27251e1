from granthi.plans import catalog


def test_header_union_has_every_document(spark, tmp_path):
    rows = [(0, "a b", "src0"), (1, "c", "src3"), (2, "", "src0"), (99, "d\ne", "src12"), (100, "f", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, text, source in rows:
        no = 100 + int(source[3:])
        head = ["CASE_ID: decision_%d" % no, "निर्णय नं.: %d" % no, "मिति: 2063-01-02", "अदालत: ", "विषय: ", "मुद्दाको प्रकार: ", "न्यायाधीश: ", "पुनरावेदक/निवेदक: A", "प्रत्यर्थी/विपक्षी: ", "पुनरावेदकका कानून व्यवसायी: ", "प्रत्यर्थीका कानून व्यवसायी: ", "प्रमुख कानूनी प्रावधान: "]
        tags = f"[CASE_ID=decision_{no}] [DECISION_NO={no}] [DATE=2063-01-02] [SUBJECT=UNKNOWN] [COURT=UNKNOWN] [CASE_TYPE=UNKNOWN] [JUDGES=UNKNOWN] [APPELLANT=A] [RESPONDENT=] [APPELLANT_LAWYER=UNKNOWN] [RESPONDENT_LAWYER=UNKNOWN] [PROVISIONS=UNKNOWN] [SOURCE={source}] [PAGE={i % 7}]"
        want += [(i, 0, True, "\n".join(head)), (i, i % 7, False, f"{tags}\n{text}")]
    got = [tuple(r) for r in catalog.header_union(spark, str(tmp_path)).select("idx", "page", "is_header", "search_text").collect()]
    assert sorted(got) == sorted(want)


def test_questions_are_read_whole(spark, tmp_path):
    text = "x " * 40 + "decision no 4512 nkp_12_3.pdf निवेदक न्यायाधीश"
    spark.createDataFrame([(68, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).drop("item_id").first()
    assert catalog.ASKED[68 % len(catalog.ASKED)] == ""
    assert tuple(got("query_intent")) == ("CASE_LOOKUP", 500)
    assert tuple(got("query_identifiers")) == ("4512", "nkp_12_3.pdf", None)
    assert tuple(got("analyze_query")) == ("nkp_12_3", "ENTITY_CASE_ANALYSIS", True)
    assert tuple(got("factual_category")) == ("judges",)
    assert tuple(got("fallback_answer")) == ("न्यायाधीश: J68",)


def test_clean_text_has_its_marks(spark, tmp_path):
    """The query cleans each text between the fixed marks: decomposed letters, Unicode blanks and control characters."""
    spark.createDataFrame([(1, "x\x01y\n\n\n\nz"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["cleaned"] for r in catalog.QUERIES["clean_text"](spark, str(tmp_path)).collect()}
    assert got[1].endswith("\n\nx y\n\nz") and "\u0929\u0915\u093c \u00e9" in got[1] and got[2] == ""


def test_vector_search_builds_no_index(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, [1.0, k / 10]) for k in range(150)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))

    def build(*_):
        raise AssertionError("an index of texts")

    monkeypatch.setattr(catalog.sparse, "save", build)
    got = {r["idx"] for r in catalog.QUERIES["knn_cosine"](spark, str(tmp_path)).collect()}
    assert len(got) == 100 and {6, 7, 8} <= got


def test_dominant_topk_scores_texts_once(spark, tmp_path):
    """What it returns is made from saved scores: the texts are not read again."""
    spark.createDataFrame([(k, f"the nation {k} and the thing", f"src{k % 4}") for k in range(40)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, [1.0, k / 10]) for k in range(40)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    made = catalog.QUERIES["dominant_topk"](spark, str(tmp_path))
    assert "documents.parquet" not in made._jdf.queryExecution().toString() and made.count() == 5
