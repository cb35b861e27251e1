import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from granthi.functions import query as Q
from granthi.functions import text as T
from granthi.functions.metadata import case_metadata


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_clean_and_digits(spark):
    assert one(spark, T.clean_text(F.lit(" a\x00\t b\n\n\n\nc "))) == "a b\n\nc"
    assert one(spark, T.clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, T.normalize_digits(F.lit("२०६३"))) == "2063"
    assert one(spark, T.ocr_fixes(F.lit("प्रकाश"))) == "प्रप्रकाश"
    assert one(spark, T.clean_text(F.lit("\u00a0e\u0301\u0928\u093c\u0958\u00a0"))) == "\u00e9\u0929\u0915\u093c"


def test_script(spark):
    assert one(spark, T.is_valid_script(F.lit("नेपालको अन्तरिम संविधान बमोजिम")))
    assert not one(spark, T.is_valid_script(F.lit("plain english text, long enough")))
    assert not one(spark, T.is_valid_script(F.lit("नेपाल")))


def test_sentences_and_chunks(spark):
    text = F.lit("एक। दुई! तीन?\nचार.पाँच छ")
    assert one(spark, T.sentences(text)) == ["एक।", "दुई!", "तीन?", "चार.पाँच छ"]
    made = one(spark, T.chunk_sentences(T.sentences(F.lit("aaaa\nbbbb\ncccc\n" + "d" * 30)), 10, 1))
    assert made == ["aaaa bbbb", "bbbb cccc", "cccc " + "d" * 30]
    assert one(spark, T.chunk_sentences(T.sentences(F.lit("")), 10, 1)) == []


def test_grams(spark):
    for text, want in (("", []), (" \n", []), ("A b", ["ab"]), ("abc", ["abc"]), ("a bcd", ["abc", "bcd"]), ("aaaa", ["aaa", "aaa"])):
        assert one(spark, T.char_ngrams(F.lit(text))) == want


def test_truncate_and_repair(spark):
    assert one(spark, T.truncate_sentence(F.lit("x" * 200 + "। " + "y" * 200), 300)) == "x" * 200 + "।"
    assert one(spark, T.truncate_sentence(F.lit("x" * 200 + " " + "y" * 200), 300)) == "x" * 200 + " ..."
    assert one(spark, T.truncate_sentence(F.lit("x" * 400), 300)) == "x" * 300 + " ..."
    assert one(spark, T.repair_output(F.lit("```text\na   b\n\n\n\nc\n```"))) == "a b\n\nc"


def test_lexical(spark):
    assert one(spark, T.lexical_score(F.lit("abcd"), F.lit("x abcd y"))) == 1.0
    assert one(spark, T.lexical_score(F.lit(""), F.lit("x"))) == 0.0


def test_intents(spark):
    cases = {
        "कुन कुन मुद्दा छन्": "LIST_CASES",
        "मुद्दाको सारांश": "CASE_SUMMARY",
        "अनुसार": "CASE_SUMMARY",
        "निर्णय नं. ९८७६": "CASE_LOOKUP",
        "x.pdf": "CASE_LOOKUP",
        "दफा ८८": "LEGAL_PROVISION",
        "compare them": "COMPARISON",
        "": "LEGAL_QA",
    }
    for q, want in cases.items():
        assert one(spark, Q.intent(F.lit(q))) == want


def test_identifiers(spark):
    number = lambda q, active=None: one(spark, Q.decision_number(F.lit(q), F.lit(active) if active else None))
    assert number("निर्णय नं. ९८७६ को") == "9876"
    assert number("case no: 4521") == "4521"
    assert number("what about the case 2063") == "2063"
    assert number("case 123 and 456") is None
    assert number("यो के हो", "decision_77") == "77"
    assert one(spark, Q.numbers(F.lit("9876को 123 ४५६ 12345"))) == ["123", "456"]
    assert one(spark, Q.last_decision(F.lit("निर्णय नं. 12 र निर्णय नं. ३४"))) == "३४"


def test_metadata(spark):
    text = "निर्णय नं. ९८७६\nफैसला मिति: २०६३/१/२\nनिवेदक: राम\nविपक्षी: श्याम\nमाननीय न्यायाधीश श्री कखगघ, चछजझ\nदफा ८८ दफा ८८"
    m = one(spark, case_metadata(F.lit(text), F.lit("a.pdf")))
    assert (m["case_id"], m["date"], m["parties"]["appellant"], m["judges"], m["provisions"]) == ("decision_9876", "2063/1/2", "राम", "कखगघ, चछजझ", "दफा ८८")
    assert one(spark, case_metadata(F.lit("none"), F.lit("a.pdf")))["case_id"] == "file_a"


def test_unicode_blanks(spark):
    text = "निर्णय\u00a0नं.\u00a09876\nविषय:\u2003रिट\u00a0\nन्यायाधीश\u00a0श्री कखगघ"
    m = one(spark, case_metadata(F.lit(text), F.lit("a.pdf")))
    assert (m["decision_no"], m["subject"], m["judges"]) == ("9876", "रिट", "कखगघ")
    assert one(spark, Q.intent(F.lit("निर्णय\u00a0नं.\u00a0९८७६"))) == "CASE_LOOKUP"
    assert one(spark, Q.decision_number(F.lit("case\u00a0no:\u2009771"))) == "771"


def test_paragraph_chunks(spark):
    """The number is a paragraph's first sentence; a closed chunk's sentences begin the next one."""
    text = "before। (प्रकरण नं. १२) एक। दुई। तीन। प्रकरण\u00a0नं. 3 चार।"
    chunked = lambda most, again: [tuple(x) for x in one(spark, T.paragraph_chunks(F.lit(text), most, again))]
    assert chunked(600, 100) == [("१२", "१२  एक। दुई। तीन।"), ("3", "3 चार।")]
    assert chunked(10, 1) == [("१२", "१२  एक। दुई।"), ("१२", "दुई। तीन।"), ("3", "3 चार।")]
    assert chunked(10, 100) == [("१२", "१२  एक। दुई।"), ("१२", "१२  एक। दुई। तीन।"), ("3", "3 चार।")]
    assert one(spark, T.paragraph_chunks(F.lit("no number"))) == [] and one(spark, T.paragraph_chunks(F.lit("aaa। bbb। ccc।"), 4, 0))[0]["chunk"] == "aaa।"


def test_settled_characters_are_settled():
    """No character that stays in the JVM changes, joins the one before it, or moves among its neighbours."""
    import re
    import unicodedata

    inside = re.compile("[" + re.sub(r"\\x\{?([0-9A-F]{2,4})\}?", lambda m: f"\\u{int(m[1], 16):04x}", T.SETTLED) + "]")
    second = {int(d[1], 16) for d in (unicodedata.decomposition(chr(i)).split() for i in range(0x110000)) if len(d) == 2 and d[0][0] != "<"}
    settled = [i for i in range(0x10000) if not 0xD800 <= i < 0xE000 and inside.fullmatch(chr(i))]
    assert len(settled) > 900 and not {*settled} & second
    assert all(unicodedata.is_normalized("NFC", chr(i)) for i in settled)
    assert {i for i in settled if unicodedata.combining(chr(i))} == {0x94D}


def test_normal_form_and_sentences_against_python(spark):
    import random
    import re
    import unicodedata

    rng = random.Random(4)
    pieces = ["a", "é", "e\u0301", "न\u093c", "\u0958", "क्", "\u094d\u093c", "।", "!", " ", "\u00a0", "\n", "\u2003", "\u1e0a\u0323", "", "x\u0300", "\u0951\u094d"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(400)] + [" " * 20_000 + "a" + "\u00a0" * 20_000 + "b\n"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    blank = "[" + T.BLANKS + "]"
    for r in df.select("k", T.nfc(F.col("t")).alias("n"), T.sentences(F.col("t")).alias("s")).collect():
        t = texts[r["k"]]
        assert r["n"] == unicodedata.normalize("NFC", t)
        assert r["s"] == [x for x in (p.strip(T.BLANKS) for p in re.split(rf"(?<=[।!?]){blank}+|\n+", t)) if x]


def test_unsettled_parts_alone_leave_the_jvm(spark, monkeypatch):
    """Normal form C is made of the few characters that it can change, not of the texts around them, and whatever stands beside them."""
    import random
    import unicodedata

    rng = random.Random(6)
    pieces = ["a", "q" * 50, "\u094d", "\u093c", "\u0929", "\u0301", "\u0323", "\u0958", "\u1100", "\u1161", "\u11a8", "\uac00", "\U00011099\U000110ba", "\U0001d15e", "\x00", "\n", "\u2003", "क"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.choice([1, 2, 3, 6, 30]))) for _ in range(3000)] + ["x" * 100_000 + "e\u0301" + "\u094d" * 100_000, "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(2)
    for r in df.select("k", T.nfc(F.col("t")).alias("n")).collect():
        t = texts[r["k"]]
        assert r["n"] == (t if t is None else unicodedata.normalize("NFC", t))

    def short(s: pa.Array) -> pa.Array:
        if (pc.max(pc.utf8_length(s.flatten())).as_py() or 0) > 10:
            raise ValueError("more than the unsettled part")
        return nfc(s)

    nfc = T._nfc
    monkeypatch.setattr(T, "_nfc", short)
    long = spark.createDataFrame([("q" * 1000 + "e\u0301" + "q" * 1000,)], "t string")
    assert long.select(T.nfc(F.col("t")).alias("n")).first()["n"] == "q" * 1000 + "\u00e9" + "q" * 1000
