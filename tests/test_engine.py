import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granthi.functions import constants as K
from granthi.operators import answers, chunks, ingest, search, sparse
from granthi.sources import files, lots
from granthi.streaming.session import prepared, session_fold, step

TEXT = "निर्णय नं. {n}\nफैसला मिति: 2063/1/2\nविषय: x\nन्यायाधीश श्री कखगघ\nपहिलो वाक्य। दोस्रो वाक्य।"


def pages(spark):
    rows = [("a.pdf", 1, 2, TEXT.format(n=9876)), ("a.pdf", 2, 2, "अर्को पृष्ठ। " * 80), ("b.pdf", 1, 1, "no number here at all")]
    return spark.createDataFrame(rows, "source string, page int, total_pages int, text string")


def test_chunk_table(spark):
    rows = chunks.chunk_table(pages(spark)).orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(len(rows)))
    assert rows[0]["is_header"] and rows[0]["page"] == 0 and rows[0]["case_id"] == "decision_9876"
    assert {r["case_id"] for r in rows} == {"decision_9876", "file_b"}
    assert all(r["search_text"].startswith("[CASE_ID=") for r in rows if not r["is_header"])
    summary = chunks.ingest_summary(chunks.chunk_table(pages(spark)), pages(spark)).first()
    assert (summary["total_files"], summary["total_pages"], summary["cases"]) == (2, 3, ["decision_9876", "file_b"])


def engine(spark):
    table = chunks.chunk_table(pages(spark)).cache()
    vectors = table.select("idx", F.array(F.lit(1.0), F.col("idx").cast("double")).alias("embedding"))
    return search.Engine(table, vectors, sparse.index(table), lambda q: [1.0, 0.0])


def test_search_and_answers(spark):
    e = engine(spark)
    dump = e.search("निर्णय नं. 9876")
    assert dump.orderBy("rank").first()["is_header"] and dump.where("score <> 1").isEmpty()
    assert e.search("निर्णय नं. 5555").isEmpty()
    hits = e.search("number here", top_k=2)
    assert hits.orderBy("rank").first()["case_id"] == "file_b"
    none = files.load_case_summaries(spark, "/nonexistent/summaries.json")
    cases = e.chunks.groupBy("case_id").agg(F.min("idx").alias("first_idx"), F.first("decision_no").alias("decision_no"), F.first("date").alias("date"), F.first("subject").alias("subject"))
    assert answers.answer("x", hits.limit(0), cases, none) == K.NO_INFO
    assert "निर्णय नं. 9876" in answers.answer("कुन कुन मुद्दा छन्", hits, cases, none)
    assert answers.answer("न्यायाधीश को हुन्", dump, cases, none) == "न्यायाधीश: कखगघ"
    assert answers.answer("x", dump, cases, none, model=lambda told, q, tokens: "```\nok\n```") == "ok"


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("d/x.PDF", "y.pdf", "z.txt"):
        (tmp_path / name).write_bytes(b"page one" if name != "y.pdf" else b"bad")
    found = files.list_files(spark, f"file://{tmp_path}")
    assert found.count() == 2

    def extract(content):
        if content == b"bad":
            raise ValueError("broken")
        return [(content.decode(), 7)]

    rows = {r["source"]: r for r in files.extract_pages(found, extract, ocr=lambda handle: f"ocr {handle}").collect()}
    assert rows["x.PDF"]["text"] == "ocr 7" and rows["y.pdf"]["error"] == "broken"
    assert files.list_files(spark, f"file://{tmp_path}/none").isEmpty()
    assert files.ocr_languages(["eng", "nep"]) == "nep+eng" and files.ocr_languages([]) == "eng"


TURNS = [
    (1, 0, "user", "निर्णय नं. 9876 के हो"),
    (1, 1, "assistant", "निर्णय नं. 9876"),
    (1, 2, "user", "यो मुद्दा को फैसला"),
    (1, 3, "assistant", "निर्णय नं. 1234"),
    (1, 4, "user", "1234 र 5678 तुलना"),
    (2, 0, "user", "hello"),
    (2, 1, "assistant", "निर्णय नं. 4321"),
    (2, 2, "user", "and then"),
]


def test_session(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in session_fold(turns).collect()}
    assert got[1, 0]["current_case"] == "decision_9876"
    assert got[1, 2]["current_case"] == "decision_9876"
    assert got[1, 4]["comparison"] and got[1, 4]["search_case"] is None
    assert got[2, 0]["current_case"] is None and got[2, 2]["current_case"] == "decision_4321"
    assert step(None, None, {"role": "system"})[2] is None
    assert prepared(turns.limit(0)).count() == 0


def test_session_stream(spark, tmp_path):
    from granthi.streaming.session import session_stream

    schema = "conv_id long, turn long, role string, text string"
    for k, part in enumerate((TURNS[:3], TURNS[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = session_stream(stream).writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "at")).start()
    run.processAllAvailable()
    run.stop()
    want = session_fold(spark.createDataFrame(TURNS, schema)).collect()
    assert len(want) == 5 and sorted(map(tuple, spark.table("sessions").collect())) == sorted(map(tuple, want))


def test_turns_in_any_order(spark, tmp_path):
    """Shuffled micro-batches give the batch's rows; a turn that never comes holds the others up for a while only."""
    from granthi.streaming import session

    schema = "conv_id long, turn long, role string, text string"
    gap = [(3, 3, "assistant", "निर्णय नं. 77"), (3, 0, "user", "निर्णय नं. 5555 के हो"), (3, 2, "user", "यो के हो")]  # turn 1 never comes
    with pytest.raises(ValueError, match="RocksDB"):
        session.session_stream_any_order(spark.createDataFrame(TURNS, schema))
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", session.ROCKSDB)
    try:
        for name, lots_of_turns, wait in (("shuffled", [[TURNS[i] for i in x] for x in ((6, 4, 2), (7, 0, 5), (3, 1))], 600_000), ("gap", [gap], 1000)):
            for part in lots_of_turns:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
            run = session.session_stream_any_order(stream, wait).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"at-{name}")).start()
            want = sorted(map(tuple, session_fold(spark.createDataFrame(sum(lots_of_turns, []), schema)).collect()))
            until = time.time() + 90
            while time.time() < until and spark.table(name).count() < len(want):
                time.sleep(0.5)
            run.stop()
            assert sorted(map(tuple, spark.table(name).collect())) == want and len(want) == (5 if name == "shuffled" else 2)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def test_from_files_to_answers(spark, tmp_path):
    """An ingest writes a base; an engine over it ranks as one over tables in memory, and answers follow."""
    (tmp_path / "in").mkdir()
    first, second = TEXT.format(n=9876), TEXT.replace("कखगघ", "चछजझ").format(n=1234) + "\nसंविधान बमोजिम निवेदन खारेज हुने ठहर्छ।"
    for name, text in (("a.pdf", first), ("b.PDF", second), ("bad.pdf", "broken")):
        (tmp_path / "in" / name).write_bytes(text.encode())

    def extract(content):
        if content == b"broken":
            raise ValueError("no pages")
        return [(content.decode(), None), ("अर्को पृष्ठ छ। " * 60, None)]

    def embed(texts):
        return [[float(len(t) % 7 + 1), 2.0, float("९८७६" in t or "9876" in t)] for t in texts]

    out = f"file://{tmp_path}/base"
    summary = ingest.ingest(spark, f"file://{tmp_path}/in", out, extract, embed).first()
    assert (summary["total_files"], summary["total_pages"], summary["cases"]) == (3, 4, ["decision_1234", "decision_9876"])
    assert summary["files"] == ["a.pdf", "b.PDF", "bad.pdf"]
    assert summary["case_metadata"].asDict()["decision_9876"]["judges"] == "कखगघ" if not isinstance(summary["case_metadata"], dict) else summary["case_metadata"]["decision_9876"]["judges"] == "कखगघ"
    e = search.open_engine(spark, out, lambda q: embed([q])[0])
    assert search.open_engine(spark, out, embed) is e
    norms = e.vectors.select(F.expr("aggregate(embedding, 0D, (s, x) -> s + x * x)").alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-5 for r in norms) and len(norms) == summary["total_chunks"]
    memory = search.Engine(e.chunks, e.vectors, sparse.index(e.chunks), e.embed)
    for q in ("संविधान बमोजिम खारेज", "अर्को पृष्ठ", "which cases are there"):
        rows = [[(r["rank"], r["idx"], round(r["score"], 6)) for r in x.search(q, 3).orderBy("rank").collect()] for x in (e, memory)]
        assert rows[0] == rows[1] and rows[0]
    cases = e.chunks.groupBy("case_id").agg(F.min("idx").alias("first_idx"), F.first("decision_no").alias("decision_no"), F.first("date").alias("date"), F.first("subject").alias("subject"))
    none = files.load_case_summaries(spark, "/nonexistent/summaries.json")
    assert answers.answer("निर्णय नं. 1234 का न्यायाधीश को हुन्", e.search("निर्णय नं. 1234"), cases, none) == "न्यायाधीश: चछजझ"
    assert spark.read.parquet(f"{ingest.current(spark, out)}/pages").where("error is not null").select("source").collect() == [("bad.pdf",)]
    search.clear_engines()
    assert search.open_engine(spark, out, embed) is not e


def test_paragraph_answers(spark):
    hits = spark.createDataFrame([(1, "x", "५"), (2, "पाठ", "४")], "rank int, content string, paragraph_no string")
    assert answers.paragraph_text("४", hits) == "प्रकरण/अनुच्छेद नं. ४ को पाठ:\n\nपाठ"
    assert answers.paragraph_text("९", hits).endswith("उपलब्ध छैन।") and answers.paragraph_text("४", hits.drop("paragraph_no")).endswith("उपलब्ध छैन।")


SUMMARY = dict.fromkeys(("introduction", "parties", "lawyers", "key_facts", "legal_questions", "reasoning", "final_order", "legal_principle"), "क")


def test_routes_with_summaries(spark, tmp_path):
    """Summary, reasoning, comparison and the current case's filter, as the router has them in order."""
    (tmp_path / "s.json").write_text(json.dumps({"decision_9876": SUMMARY | {"introduction": "न्यायाधीश: कमल, नवीन।"}, "decision_1234": SUMMARY | {"introduction": "न्यायाधीश: नवीन र शोभा"}}), encoding="utf-8")
    written = files.load_case_summaries(spark, f"file://{tmp_path}/s.json")
    hits = spark.createDataFrame([(1, "decision_9876", True, 0, "x", "j")], "rank int, case_id string, is_header boolean, page int, content string, judges string")
    cases = spark.createDataFrame([], "first_idx long, decision_no string, date string, subject string")
    ask = lambda q, **more: answers.answer(q, hits, cases, written, **more)
    assert ask("मुद्दाको सारांश", current_case="decision_9876").startswith("**मुद्दाको परिचय**\nन्यायाधीश: कमल, नवीन।\n\n**पक्षकारहरू**\nक")
    assert ask("किन", current_case="decision_9876") == "अदालतको तर्क/निष्कर्ष:\n\nक"
    assert ask("न्यायाधीश तुलना", compare=["9876", "1234"]).endswith("\n\n\n**साझा न्यायाधीश:** नवीन")
    assert ask("who", current_case="decision_5") == K.NO_INFO
    assert ask("कुन कुन मुद्दा") == K.NO_CASES


@pytest.fixture
def plain():
    """An extractor and an embedding, made here so that workers get them by value."""

    def extract(content):
        if content == b"broken":
            raise ValueError("no pages")
        return [(content.decode(), None)]

    return extract, lambda texts: [[float(len(t) % 7 + 1), 2.0] for t in texts]


def test_equal_names_in_two_folders(spark, tmp_path, plain):
    """Two files of one name are two documents, by either way of reading; a file that fails is counted."""
    for name, n in (("a/x.pdf", 1111), ("b/x.pdf", 2222), ("b/y.PDF", 0)):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(TEXT.format(n=n).encode() if n else b"broken")
    seen = []
    for read, root in ((files.list_files, f"file://{tmp_path}/in"), (lots.file_lots, f"{tmp_path}/in")):
        out = f"file://{tmp_path}/base-{len(seen)}"
        summary = ingest.ingest(spark, root, out, *plain, read=read).first()
        assert (summary["total_files"], summary["total_pages"]) == (3, 2)
        assert (summary["cases"], summary["files"]) == (["decision_1111", "decision_2222"], ["x.pdf", "x.pdf", "y.PDF"])
        table = spark.read.parquet(f"{ingest.current(spark, out)}/chunks")
        rows = table.where("not is_header").select("case_id", "content", "path", "source").collect()
        assert {(r["case_id"], "1111" in r["content"], r["path"].rsplit("/", 2)[-2]) for r in rows} == {("decision_1111", True, "a"), ("decision_2222", False, "b")}
        assert {r["source"] for r in rows} == {"x.pdf"}
        seen.append(sorted((r["idx"], r["content"]) for r in table.collect()))
    assert seen[0] == seen[1]


def test_failed_ingest_leaves_the_base(spark, tmp_path, plain):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(TEXT.format(n=1111).encode())
    out = f"file://{tmp_path}/base"
    ingest.ingest(spark, f"file://{tmp_path}/in", out, *plain)
    first, engine = ingest.current(spark, out), search.open_engine(spark, out, lambda q: plain[1]([q])[0])
    (tmp_path / "in/b.pdf").write_bytes(TEXT.format(n=2222).encode())

    def broken(texts):
        raise RuntimeError("no embedding")

    with pytest.raises(Exception, match="no embedding"):
        ingest.ingest(spark, f"file://{tmp_path}/in", out, plain[0], broken)
    assert ingest.current(spark, out) == first and ingest.summary(spark, out).first()["cases"] == ["decision_1111"]
    assert search.open_engine(spark, out, lambda q: [1.0, 0.0]) is engine
    for n in (1, 2):
        assert ingest.ingest(spark, f"file://{tmp_path}/in", out, *plain).first()["total_files"] == 2
        assert engine.chunks.count() > 0 if n == 1 else True  # the version before stays for those that read it
    assert search.open_engine(spark, out, lambda q: [1.0, 0.0]) is not engine
    assert len([x for x in (tmp_path / "base").iterdir() if x.name.startswith("v-")]) == 2
    search.clear_engines()


def test_file_lots(spark, tmp_path):
    """Lots hold all files once, by size and number; one that goes away is a row with its error; a stream gives new files once."""
    for k in range(11):
        (tmp_path / f"d{k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 3}/f.{k}.{'pdf' if k % 2 else 'PDF'}").write_bytes(b"x" * k)
    (tmp_path / "z.txt").write_bytes(b"no")
    listed = lots.listed(str(tmp_path), "pdf")
    assert [p for p, *_ in listed] == sorted(str(p) for p in tmp_path.rglob("*") if p.suffix.lower() == ".pdf") and len(listed) == 11
    for files_at_most, bytes_at_most in ((3, 1 << 20), (100, 10), (1, 1)):
        made = lots.lots(listed, files_at_most, bytes_at_most)
        assert [f for lot in made for f in lot.files] == listed and all(len(lot.files) <= files_at_most for lot in made)
        assert all(sum(f[2] for f in lot.files[:-1]) < bytes_at_most for lot in made)
    got = lots.file_lots(spark, str(tmp_path), lotFiles="2")
    assert sorted((r["path"], bytes(r["content"]), r["length"], r["error"]) for r in got.collect()) == sorted((p, b"x" * n, n, None) for p, _, n in listed)
    assert lots.file_lots(spark, str(tmp_path / "none")).isEmpty() and lots.file_lots(spark, listed[0][0]).count() == 1
    gone = [*lots._rows(str(tmp_path), [listed[0], (f"{tmp_path}/gone.pdf", 0, 5)])]
    assert gone[0][4] is None and gone[1][3] is None and "gone.pdf" in gone[1][4]
    run = lots.new_files(spark, str(tmp_path)).writeStream.format("memory").queryName("lots").option("checkpointLocation", str(tmp_path / "at")).start()
    run.processAllAvailable()
    (tmp_path / "d0/new.pdf").write_bytes(b"later")
    run.processAllAvailable()
    run.stop()
    assert sorted(r["path"] for r in spark.table("lots").collect()) == sorted([p for p, *_ in listed] + [f"{tmp_path}/d0/new.pdf"])


def test_global_index(spark):
    """Numbers follow the order over all partitions, whatever a path holds."""
    rows = [(f"p{k % 7 if k % 3 else 0}", k % 11, k, "x") for k in range(3000)]
    df = spark.createDataFrame(rows, "path string, page int, chunk_no int, content string").repartition(5)
    got = sorted(chunks.with_index(df).select("idx", "path", "page", "chunk_no").collect())
    assert [tuple(r)[1:] for r in got] == sorted(r[:3] for r in rows) and [r["idx"] for r in got] == list(range(3000))
    assert chunks.with_index(df.limit(0)).isEmpty()


def brute_bm25(rows, query):
    from math import log

    grams = lambda t: [t[i : i + 3] for i in range(max(len(t) - 2, 1))] if t else []
    docs = {i: grams("".join(t.split()).lower()) for i, t in rows}
    df = Counter(g for d in docs.values() for g in set(d))
    mean_length = sum(map(len, docs.values())) / len(docs)
    raw = {g: log(len(docs) - n + 0.5) - log(n + 0.5) for g, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    out = {}
    for i, d in docs.items():
        tf = Counter(d)
        s = sum((raw[g] if raw[g] >= 0 else 0.25 * mean) * tf[g] * 2.5 / (tf[g] + 1.5 * (0.25 + 0.75 * len(d) / mean_length)) for g in grams("".join(query.split()).lower()) if g in tf)
        if any(g in tf for g in grams("".join(query.split()).lower())):
            out[i] = s
    return out


def texts_of_words(n, seed=1):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "the", "nation", "thing", "rare" if k % 97 == 0 else "of"]) for _ in range(rng.randint(0, 60)))) for k in range(n)]


def test_top_k_reads_a_share(spark, tmp_path, monkeypatch):
    """The best chunks from a part of the blocks are the best of all; ranges narrow what completes their scores."""
    monkeypatch.setattr(sparse, "RANGE", 64)
    rows = texts_of_words(1500)
    df = spark.createDataFrame(rows, "idx long, search_text string").repartition(6, "idx")
    sparse.save(df, f"file://{tmp_path}/ix")
    found = sparse.load(spark, f"file://{tmp_path}/ix")
    for query in ("the nation and the thing", "rare gamma", "nothing here zzz", "", "a", "the the the of of thing"):
        want = brute_bm25(rows, query)
        full = {r["idx"]: r["bm25"] for r in sparse.bm25(found, query).collect()}
        assert full.keys() == want.keys() and all(abs(full[i] - want[i]) < 1e-9 for i in want)
        for k in (1, 10):
            best = sorted(want.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
            got = {r["idx"]: r["bm25"] for r in sparse.bm25_top(found, query, k).collect()}
            assert all(abs(s - want[i]) < 1e-9 for i, s in got.items())
            assert sorted(got.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k] == [(i, got[i]) for i, _ in best]
    asked = sparse.terms(found, "the nation and the thing")
    assert 0 < asked.share(asked.upto(sparse.FIRST * asked.most())) < 1
    assert found["blocks"].where("gram = 'the'").select("range").distinct().count() > 20
    queries = spark.createDataFrame([(k, q) for k, q in enumerate(("the nation and the thing", "rare gamma", "zzz", None, ""))] + [(None, "the")], "query_id long, text string")
    many = {}
    for r in sparse.bm25_many(found, queries, 5).collect():
        many.setdefault(r["query_id"], []).append((r["rank"], r["idx"], r["bm25"]))
    for k, q in ((0, "the nation and the thing"), (1, "rare gamma")):
        best = sorted(((i, round(s, 6)) for i, s in brute_bm25(rows, q).items() if round(s, 6) > 0), key=lambda x: (-x[1], x[0]))[:5]
        assert [(i, s) for _, i, s in sorted(many[k])] == best and [r for r, *_ in sorted(many[k])] == [1, 2, 3, 4, 5]
    assert many.keys() == {0, 1}


def test_many_queries_in_lots(spark, monkeypatch):
    monkeypatch.setattr(sparse, "QUERIES", 3)
    monkeypatch.setattr(sparse, "GRAMS_AT_ONCE", 4)
    rows = texts_of_words(300, 2)
    found = sparse.index(spark.createDataFrame(rows, "idx long, search_text string").repartition(3))
    queries = [(k, t) for k, t in texts_of_words(10, 3) if t]
    got = {}
    for r in sparse.bm25_many(found, spark.createDataFrame(queries, "query_id long, text string"), 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["idx"], r["bm25"]))
    for k, q in queries:
        best = sorted(((i, round(s, 6)) for i, s in brute_bm25(rows, q).items() if round(s, 6) > 0), key=lambda x: (-x[1], x[0]))[:4]
        assert [(i, s) for _, i, s in sorted(got.get(k, []))] == best


def test_search_scores_few_rows(spark, monkeypatch):
    """The bounded search ranks as one that scores every row, whichever way it goes."""
    rows = [(i, f"decision_{100 + i % 5}", str(100 + i % 5), i % 7, i % 50 == 0, t) for i, t in texts_of_words(800, 4)]
    table = spark.createDataFrame(rows, "idx long, case_id string, decision_no string, page int, is_header boolean, content string").withColumn("search_text", F.col("content")).withColumn("source", F.col("case_id")).cache()
    vectors = table.where("idx % 3 = 0").select("idx", F.array(F.lit(1.0), (F.col("idx") % 13).cast("double")).alias("embedding"))
    e = search.Engine(table, vectors, {k: v.cache() for k, v in sparse.index(table).items()}, lambda q: [1.0, 3.0])
    for head, tried, sent in ((10_000, 64, 100), (20, 12, 0)):
        monkeypatch.setattr(search, "HEAD", head)
        monkeypatch.setattr(search, "TRIED", tried)
        monkeypatch.setattr(search, "SENT", sent)
        for query, n, alpha in (("the nation and the thing", 10, 0.15), ("zzz", 5, 0.5)):
            near = search.knn(vectors, [1.0, 3.0], 60)
            parts = sparse._of(e.sparse["blocks"], [*sparse.terms(e.sparse, query).weights])
            bm25 = sparse.contributions(parts, sparse.terms(e.sparse, query))
            for rows_of, everywhere in ((table, True), (table.where("case_id = 'decision_103'"), False)):
                want = search.ranked(search.fused(rows_of, near, sparse.bm25(e.sparse, query), query, alpha), n).orderBy("rank").collect()
                got = e._best(rows_of, everywhere, near, bm25, query, alpha, n)
                assert [(r["idx"], round(r["score"], 8)) for r in got] == [(r["idx"], round(r["score"], 8)) for r in want]
    table.unpersist()


def test_knn_many(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 50)
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    rng = random.Random(9)
    rows = [(k, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]) for k in range(400)]
    df = spark.createDataFrame([*rows, (None, [1.0] * 4), (900, None)], "idx long, embedding array<float>").repartition(4)
    asks = df.where("idx % 40 = 0")
    got = {}
    for r in search.knn_many(df, asks, 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["idx"], r["distance"]))

    def distance(a, b):
        norm = lambda x: sum(v * v for v in x) ** 0.5 or 1.0
        return round(1 - sum(x * y for x, y in zip(a, b, strict=True)) / (norm(a) * norm(b)), 9) + 0.0

    for k, v in rows[::40]:
        best = sorted((distance(v, w), i) for i, w in rows)[:7]
        assert [(abs(d), i) for _, i, d in sorted(got[k])] == [(abs(d), i) for d, i in best]
    assert search.knn_many(df, asks.limit(0), 7).isEmpty()


def test_model_is_told_case_and_summary(spark):
    hits = spark.createDataFrame([(1, "decision_9876", True, 3, "पाठ", "j")], "rank int, case_id string, is_header boolean, page int, content string, judges string")
    cases = spark.createDataFrame([], "first_idx long, decision_no string, date string, subject string")
    told = []
    written = spark.createDataFrame([("decision_9876", *["क"] * 8, "s", None)], "case_id string, introduction string, parties string, lawyers string, key_facts string, legal_questions string, reasoning string, final_order string, legal_principle string, subject string, judges string")
    model = lambda *x: told.append(x) or "ok"
    assert answers.answer(" के भयो ", hits, cases, written, current_case="decision_9876", model=model) == "ok"
    text, question, tokens = told[0]
    assert (question, tokens) == ("के भयो", 1024) and text.endswith("प्रमाण (कागजातका अंशहरू):\n--- पृष्ठ 3 ---\nपाठ")
    assert "हालको मुद्दा: decision_9876\n\n**परिचय:** क\n\n**पक्षकार:** क\n\n**न्यायाधीश:** \n\n**मुख्य तथ्य:** क\n\n**अन्तिम आदेश:** क\n\n" in text
    assert answers.answer("निर्णय नं. 9876", hits, cases, written.limit(0), model=model) == "ok"
    assert told[1][2] == 500 and f"हालको मुद्दा: {K.UNKNOWN}" in told[1][0]


def test_lots_merge_into_blocks(spark, monkeypatch):
    """Each gram, level and range is one block, whichever lots its chunks were in; texts of one or two characters are grams of their own."""
    for name, value in (("RANGE", 16), ("GROUP", 2), ("LOT", 300)):
        monkeypatch.setattr(sparse, name, value)
    rows = [*texts_of_words(150, 4), (150, "ab"), (151, "a"), (152, ""), (153, " "), (154, "a\0b\0"), (155, "कागज र 𝒳𝒳𝒳"), (156, None), (157, "the" * 2000)]
    want, length = {}, {i: max(len(s) - 2, min(len(s), 1)) for i, s in ((i, "".join((t or "").split())) for i, t in rows)}
    for i, t in rows:
        for g, n in sparse.query_grams(t or "").items():
            want[g, i] = n
    mean = sum(length.values()) / len(length)
    df = spark.createDataFrame(rows, "idx long, search_text string").repartition(5)
    got, seen = {}, []
    for r in sparse.blocks(df, mean).collect():
        seen.append((r["gram"], r["level"], r["range"]))
        assert r["bucket"] == sparse._bucket(r["gram"]) and r["ids"] == sorted(r["ids"])
        parts = [tf * (sparse.K1 + 1) / (tf + sparse.K1 * (1 - sparse.B + sparse.B * dl / mean)) for tf, dl in zip(r["tfs"], r["dls"], strict=True)]
        assert abs(r["top"] - max(parts)) < 1e-12
        for k, tf, dl in zip(r["ids"], r["tfs"], r["dls"], strict=True):
            got[r["gram"], r["range"] * 16 + k] = tf
            assert dl == length[r["range"] * 16 + k]
    assert got == want and len(seen) == len(set(seen))
    assert sparse.blocks(df.limit(0), 1.0).count() == 0


def test_postings_are_counted_in_place(spark, monkeypatch):
    """No posting of a chunk with an idx of its own is shuffled; chunks that share one, or have none, count together."""
    monkeypatch.setattr(sparse, "LOT", 100)
    own = [*texts_of_words(60, 5), (60, "ab"), (61, ""), (62, None), (63, "कागज र 𝒳𝒳𝒳"), (64, "a\0b\0"), (65, "the" * 500)]
    for rows in (own, [*own, (3, "the the"), (3, "ab"), (None, "thethe"), (None, "The"), (60, None)]):
        want = {}
        for i, t in rows:
            for g, n in sparse.query_grams(t or "").items():
                want[i, g] = want.get((i, g), 0) + n
        df = spark.createDataFrame(rows, "idx long, search_text string").repartition(3)
        made = sparse.postings(df)
        got = [tuple(r) for r in made.collect()]
        assert len(got) == len(want) and {(i, g): n for i, g, n in got} == want
        if rows is own:
            assert "gram" not in "".join(x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)
            assert "hashpartitioning(idx" not in made._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(sparse, "FEW_IDS", 0)
    assert {(i, g): n for i, g, n in sparse.postings(df).collect()} == want


def test_many_queries_travel_apart_from_blocks(spark, monkeypatch):
    """Few queries are broadcast, and blocks are shuffled without them; with many the result is the same."""
    df = spark.createDataFrame(texts_of_words(120, 7), "idx long, search_text string")
    found = {k: v.cache() for k, v in sparse.index(df).items()}
    queries = spark.createDataFrame([(k, t) for k, t in texts_of_words(12, 8)], "query_id long, text string")
    monkeypatch.setattr(sparse, "QUERIES", 5)
    few = sparse.bm25_many(found, queries, 4)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    placed = plan[plan.index("MapInArrow") :]
    assert "RepartitionByExpression [lot" in placed and placed.index("Join") < placed.index("RepartitionByExpression [lot")
    monkeypatch.setattr(sparse, "SENT", 0)
    many = sparse.bm25_many(found, queries, 4)
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 48


def test_blocks_are_not_sorted_again(spark, tmp_path):
    """Packed postings travel and are sorted in a byte or two each; blocks are written as they are made, a file's rows by range and gram."""
    words = random.Random(9)
    rows = [(k, "".join(words.choice("etaoinshrdlu") for _ in range(400))) for k in range(300)]
    df = spark.createDataFrame(rows, "idx long, search_text string").repartition(2)
    n = sum(len(sparse.query_grams(t)) for _, t in rows)
    size = lambda v: len(v) if isinstance(v, (bytes, bytearray)) else 4 * len(v) if isinstance(v, list) else 8
    assert sum(size(v) for r in sparse.lots(df).collect() for v in r) < 3 * n
    before = spark.conf.get(sparse.WRITERS)
    sparse.save(df, f"file://{tmp_path}/ix")
    assert spark.conf.get(sparse.WRITERS) == before
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    (written,) = [p for p in plans if f"{tmp_path}/ix/blocks" in p and "WriteFiles" in p and "MapInArrow" in p]
    above = written[: written.index("MapInArrow")]
    assert "Sort" not in above and "Exchange" not in above
    found = sparse.load(spark, f"file://{tmp_path}/ix")
    assert found["blocks"].select(F.sum(F.size("ids"))).first()[0] == n and found["stats"].first()["n"] == 300
