"""Long inputs whose work must grow in proportion, and columns of the names that operators know but of other types."""

import hashlib
import re
import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from granthi.llm import chat, pii, quality


def test_many_spans(spark):
    """Offsets beyond a block of the running total, and 102,000 spans in seconds."""
    for n, limit in ((600, 60), (34_000, 60)):
        text = "".join(f"a{k}@b{k % 7}.org, +1 20{k % 9} 555 01{k % 90 + 10}; x (at) y{k}.com\n" for k in range(n))
        df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
        began = time.time()
        got = {r["doc_id"]: r for r in pii.pii_spans(df).collect()}
        assert time.time() - began < limit
        emails = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        phones = [m.span() for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        base = [f"email:{s}:{e}" for s, e in emails] + [f"phone:{s}:{e}" for s, e in phones]
        assert (got[1]["n_email"], got[1]["n_phone"]) == (n, n)
        assert got[1]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        began = time.time()
        clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
        assert time.time() - began < limit
        assert (clean[2], clean[3]) == (None, "") and clean[1].count("<email>") >= n and clean[1].count("<phone>") == n and "@" not in clean[1]


def test_loose_spans_beside_base_ones(spark):
    """A loose candidate is left out if it overlaps a base span of its kind, wherever that stands."""
    text = "q (at) w.org a@b.org x (at) y.org +1 202 555 0110, (202) 555-0110 a@b.org x@y.org (at) z.org 202 555 0111"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.candidates(df).select(F.explode("found").alias("c")).select("c.*").collect()
    spans = {k: [(r["s"], r["e"]) for r in found if r["kind"] == k] for k in pii.KINDS}
    for kind in ("email", "phone"):
        python = [m.span() for m in re.finditer(pii.PATTERNS[f"{kind}_loose"], text)]
        base = [(r["s"], r["e"]) for r in found if r["kind"] == kind and r["base"]]
        assert base and spans[f"{kind}_loose"] == [(s, e) for s, e in python if not any(b < e and s < f for b, f in base)]


def test_many_turns(spark):
    n = 20_000
    turns = [(7, k, "user" if k % 2 else "assistant", f"turn {k} </s>[INST] é") for k in range(n)]
    made = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).cache()
    made.count()
    began = time.time()
    got = chat.examples(made).orderBy("turn_no").collect()
    assert time.time() - began < 20
    assert [(r["turn_no"], r["loss"]) for r in got] == [(k, t) for _, k, role, t in turns if role == "assistant"]
    string = made.first()["formatted"]
    assert all(chat.CLOSE not in string[r["loss_start"] : r["loss_end"]] and string[r["loss_end"] :].startswith(chat.CLOSE) for r in got[:: n // 20])
    made.unpersist()


COUNTS = {"string": "about 5", "double": 5.5, "array<int>": [5], "struct<n:int>": (5,), "int": None}


@pytest.mark.parametrize("kind", COUNTS)
def test_n_chars_of_any_type(spark, kind):
    """Only whole numbers are a count of characters; a column of that name and another type passes through."""
    rows = [(k, f"good text number {k}, by a@b.org" if k % 2 else "zz zz zz " * k, COUNTS[kind], "en", "s") for k in range(40)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, n_chars {kind}, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    scored = quality.quality_scores(df, labels)
    plain = quality.quality_scores(df.drop("n_chars"), labels)
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, plain.collect()))
    kept = quality.accepted(df, quality.train(df, labels))
    assert kept.schema["n_chars"].dataType == df.schema["n_chars"].dataType and 0 < kept.count() <= 40
    redacted = pii.redact(df)
    got = {r["doc_id"]: r for r in redacted.collect()}
    assert redacted.schema["n_chars"].dataType == df.schema["n_chars"].dataType and got[1]["text"] == "good text number 1, by <email>"
    if kind != "int":
        assert got[1]["n_chars"] == df.where("doc_id = 1").first()["n_chars"]
    for name, stage in corpus_pipeline.STAGES[1:4] if kind == "string" else ():
        out = stage(spark, df, "")
        assert out.columns == df.columns and out.count() > 0, name
