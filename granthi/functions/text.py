"""Text functions on columns. All but ``nfc`` are built-in expressions. White space is Unicode's, as by ``(?U)\\s``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .constants import ASCII_DIGITS, DEVANAGARI_DIGITS, OCR_FIXES


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` needs it inside a lambda."""
    return F.element_at(F.transform(F.array(c), use), 1)


def ocr_fixes(c: Column) -> Column:
    """The replacements in their order. Not idempotent: some corrections hold a string that a later one replaces."""
    for wrong, right in OCR_FIXES:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


#: White space at a text's ends: Unicode's, as by ``(?U)\\s``.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")
#: Characters that normal form C leaves alone among each other: Latin, Devanagari without the nukta, the letters that are
#: written with it and the accents, and punctuation. None is second in a composition, and of the marks that have an order
#: (the virama alone) there is one kind.
SETTLED = r"\x00-\x{2FF}\x{900}-\x{93B}\x{93D}-\x{950}\x{955}-\x{957}\x{960}-\x{97F}\x{2002}-\x{206F}"


#: The settled characters that have no order of their own: all but the virama.
STARTERS = SETTLED.replace(r"\x{93D}-\x{950}", r"\x{93D}-\x{94C}\x{94E}-\x{950}")
#: What normal form C can change: a run of characters that are not settled, with the viramas in and around it, and the
#: character before them, which it may join. At either end of it a text can be cut and normalised part by part. Each character
#: is looked at once, a Latin one by the first test.
UNSETTLED = rf"[^\x{{94D}}]\x{{94D}}*+(?![\x00-\x{{2FF}}])[^{SETTLED}][^{STARTERS}]*+"
#: Parts that are strings of Python at one time.
AT_ONCE = 1000


def _nfc(s: pa.Array) -> pa.Array:
    flat = s.flatten()  # of lists without null ones, in order
    made = pa.concat_arrays([pa.array([unicodedata.normalize("NFC", x) for x in flat.slice(k, AT_ONCE).to_pylist()], pa.string()) for k in range(0, len(flat) or 1, AT_ONCE)])
    offsets = pc.subtract(s.offsets, s.offsets[0])
    return pa.ListArray.from_arrays(offsets, made)


def nfc(c: Column) -> Column:
    """Unicode normal form C. Spark has no built-in function for it: the parts of a text that hold more than ``SETTLED`` characters leave
    the JVM, in Arrow batches, and come back into their places; what is between them, mostly the whole text, stays."""
    led = F.concat(F.lit("\n"), c)  # a part has a character before it
    unsettled = c.rlike(f"[^{SETTLED}]")
    none = F.expr("cast(array() as array<string>)")
    made = F.arrow_udf(_nfc, "array<string>")(F.when(unsettled, F.regexp_extract_all(led, F.lit(UNSETTLED), F.lit(0))).otherwise(none))
    joined = F.array_join(F.zip_with(F.split(led, UNSETTLED), made, lambda between, part: F.concat(between, F.coalesce(part, F.lit("")))), "")
    return F.when(unsettled, F.substr(joined, F.lit(2))).otherwise(c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def clean_text(c: Column) -> Column:
    """Normal form C, control characters to blanks, runs of blanks to one, three or more line ends to two, then ``ocr_fixes``; null to empty."""
    c = nfc(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(ocr_fixes(c))


def normalize_digits(c: Column) -> Column:
    return F.translate(c, DEVANAGARI_DIGITS, ASCII_DIGITS)


def script_ratio(c: Column, low: str = "\\u0900", high: str = "\\u097F") -> Column:
    """The share of letters in a block; null without letters. Vowel signs are no letters."""
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    inside = F.length(F.regexp_replace(letters, rf"[^{low}-{high}]", ""))
    return F.when(F.length(letters) > 0, inside / F.length(letters))


def is_valid_script(c: Column, least: float = 0.4, low: str = "\\u0900", high: str = "\\u097F") -> Column:
    return (F.length(strip(c)) >= 20) & (F.coalesce(script_ratio(c, low, high), F.lit(0.0)) >= least)


def sentences(c: Column) -> Column:
    """Stripped sentences: a break is white space after a danda, ! or ?, or white space that holds a line end.

    Breaks take all the white space around them, and are looked for where white space begins alone, so no sentence is
    stripped by itself and a long blank is read once.
    """
    parts = F.split(strip(F.coalesce(c, F.lit(""))), r"(?U)(?<=[।!?])\s+|(?<!\s)\s*\n\s*")
    return F.filter(parts, lambda x: x != "")


def chunk_sentences(sents: Column, max_chars: int = 600, overlap: int = 1) -> Column:
    """Sentences packed in order into chunks of at most ``max_chars``, joined by blanks.

    A chunk that is full is closed and the next one begins with its last ``overlap`` sentences. A sentence is
    never split, so a long one, or an overlap with one, may exceed the limit. The fold keeps positions only.
    """
    return let(sents, lambda s: let(F.transform(s, F.length), lambda sizes: _packed(s, sizes, max_chars, overlap)))


def _packed(sents: Column, sizes: Column, max_chars: int, overlap: int) -> Column:
    ranges = _ranges(sizes, max_chars, overlap, 1, True)
    return F.transform(ranges, lambda r: F.array_join(F.slice(sents, r["a"] + 1, r["b"] - r["a"]), " "))


def _ranges(sizes: Column, max_chars: int, overlap: int, between: int, last: bool | Column) -> Column:
    """From which item to which each chunk goes, of items of these sizes with ``between`` added from one to the next; ``last``: whether the unfinished one counts."""
    state = F.struct(F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("next"), F.lit(0).alias("size"))

    def step(acc: Column, n: Column) -> Column:
        begun = acc["next"] > acc["first"]
        add = n + F.when(begun, between).otherwise(0)
        full = begun & (acc["size"] + add > max_chars)
        again = F.greatest(acc["first"], acc["next"] - overlap)
        carried = F.aggregate(F.slice(sizes, again + 1, acc["next"] - again), F.lit(0), lambda s, x: s + x + between)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.struct(acc["first"].alias("a"), acc["next"].alias("b"))))).otherwise(acc["done"]).alias("done"),
            F.when(full, again).otherwise(acc["first"]).alias("first"),
            (acc["next"] + 1).alias("next"),
            F.when(full, carried + n).otherwise(acc["size"] + add).alias("size"),
        )

    def finish(acc: Column) -> Column:
        return F.when(last & (acc["next"] > acc["first"]), F.concat(acc["done"], F.array(F.struct(acc["first"].alias("a"), acc["next"].alias("b"))))).otherwise(acc["done"])

    return F.aggregate(sizes, state, step, finish)


def squeezed(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """All windows of ``n`` characters of the lower-cased text without white space; a text of up to ``n`` is one gram."""
    none = F.expr("cast(array() as array<string>)")

    def windows(text: Column, chars: Column) -> Column:
        first = F.sequence(F.lit(0), F.length(text) - n)
        return F.transform(first, lambda i: F.concat(*(chars[i + k] for k in range(n))))

    def grams(text: Column) -> Column:
        return F.when(text == "", none).when(F.length(text) <= n, F.array(text)).otherwise(let(F.split(text, ""), lambda chars: windows(text, chars)))

    return let(squeezed(c), grams)


def repair_output(c: Column) -> Column:
    """A generated answer without a code fence, runs of blanks and of line ends."""
    c = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?iU)^```(?:text|markdown)?\s*|\s*```$", "")
    return F.regexp_replace(F.regexp_replace(strip(c), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")


def normalize_match(c: Column) -> Column:
    """Digits normalised, lower case, only letters, numbers, underscore and the Devanagari block."""
    return F.regexp_replace(F.lower(normalize_digits(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}_\x{0900}-\x{097F}]+", "")


#: A query of so many trigrams at most is looked for gram by gram; of a longer one the text's trigrams are made.
FEW_GRAMS = 64


def lexical_score(query: Column, text: Column) -> Column:
    """Half of: whether the text contains the query, plus the share of the query's trigrams in the text."""
    q = normalize_match(query)

    def score(t: Column, grams: Column) -> Column:
        # a window of the text is a part of it; a gram shorter than a window can only be the whole text
        few = F.size(F.filter(grams, lambda g: F.when(F.length(g) < 3, t == g).otherwise(F.contains(t, g))))
        shared = F.when(F.size(grams) <= FEW_GRAMS, few).otherwise(F.size(F.array_intersect(grams, char_ngrams(t))))
        both = (F.when(F.contains(t, q), 1.0).otherwise(0.0) + shared / F.greatest(F.size(grams), F.lit(1))) / 2
        return F.when((q == "") | (t == ""), 0.0).otherwise(F.least(both, F.lit(1.0)))

    return let(normalize_match(text), lambda t: let(F.array_distinct(char_ngrams(q)), lambda grams: score(t, grams)))


def truncate_sentence(c: Column, limit: int = 300) -> Column:
    """The first ``limit`` characters, cut after the last sentence end or before the last blank of their final 150."""
    head = F.substring(c, 1, limit)
    start = max(0, limit - 150)
    tail = F.substring(head, start + 1, limit)
    keep = F.substring(head, 1, start)
    stop, blank = (F.regexp_extract(tail, p, 1) for p in (r"(?s)^(.*[।\n?!])", r"(?s)^(.*) "))
    cut = F.when(tail.rlike(r"[।\n?!]"), F.concat(keep, stop)).when(F.contains(tail, F.lit(" ")), F.concat(keep, blank, F.lit(" ..."))).otherwise(F.concat(head, F.lit(" ...")))
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def paragraph_chunks(c: Column, max_chars: int = 600, overlap: int = 100) -> Column:
    """Array of (number, chunk): a text's numbered paragraphs, each packed by sentences into chunks.

    A paragraph's number is its first sentence. A chunk is closed where the next sentence would take its sentences
    beyond ``max_chars``, and the next chunk begins with the last ``overlap`` sentences of it. Text before the first
    number gives chunks without one, but not its unfinished last chunk. Null and empty texts have none.
    """
    marker = K.PARAGRAPH_MARKER
    numbers = F.regexp_extract_all(c, F.lit(marker), F.lit(1))
    bodies = F.split(c, marker)
    parts = F.transform(bodies, lambda b, i: F.struct(F.when(i > 0, F.get(numbers, i - 1)).alias("number"), b.alias("body")))

    def chunked(p: Column) -> Column:
        sents = F.filter(F.split(p["body"], r"(?U)(?<=[।!?])\s+"), lambda x: strip(x) != "")
        sents = F.when(p["number"].isNull(), sents).otherwise(F.concat(F.array(p["number"]), sents))
        return let(sents, lambda s: let(F.transform(s, F.length), lambda sizes: F.transform(
            _ranges(sizes, max_chars, overlap, 0, p["number"].isNotNull()),
            lambda r: F.struct(p["number"].alias("number"), strip(F.array_join(F.slice(s, r["a"] + 1, r["b"] - r["a"]), " ")).alias("chunk")),
        )))

    return F.filter(F.flatten(F.transform(parts, chunked)), lambda x: x["chunk"] != "")
