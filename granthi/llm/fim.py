"""Fill-in-middle by ropes.

A text is a balanced tree over leaves of whole lines; every node caches the lines (units) and the code points
below it. Two splits at unit ranks give prefix, middle and suffix, whose trees are joined in their new order with the
sentinels between, and only then written out. The inverse builds a tree over the output, splits it at the code-point ranks
of the sentinels and joins the pieces in their old order. A split walks one path and makes one node for each level, and no
text is copied but in the leaf that is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, read_table

#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The order of the marks in each form's output.
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
SEED, RATE, SPM = 7, 100, 50
#: Code points after which a leaf ends with its line.
LEAF = 1024


class Rope:
    """A leaf (``text``) or a join of two ropes. ``units`` counts lines as long as every piece ends where a line ends."""

    __slots__ = ("left", "points", "right", "text", "units")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is None:
            self.units, self.points = left.units + right.units, left.points + right.points
        else:
            self.units, self.points = text.count("\n") + (text[-1:] not in ("", "\n")), len(text)

    def __str__(self) -> str:
        out, open_nodes = [], [self]
        while open_nodes:
            node = open_nodes.pop()
            if node.text is None:
                open_nodes += (node.right, node.left)
            else:
                out.append(node.text)
        return "".join(out)


EMPTY = Rope("")


def joined(*ropes: Rope) -> Rope:
    """The ropes one after the other; empty ones leave no node."""
    out = EMPTY
    for rope in ropes:
        out = rope if not out.points else out if not rope.points else Rope(left=out, right=rope)
    return out


def build(text: str, size: int = LEAF) -> Rope:
    """A balanced rope whose leaves are whole lines of about ``size`` code points."""
    level, at = [], 0
    while at < len(text):
        end = text.find("\n", min(at + size, len(text)) - 1) + 1 or len(text)
        level.append(Rope(text[at:end]))
        at = end
    while len(level) > 1:
        level = [joined(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def split(rope: Rope, rank: int, by: str) -> tuple[Rope, Rope]:
    """The first ``rank`` of what ``by`` ("units" or "points") counts, and the rest."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= getattr(rope, by):
        return rope, EMPTY
    if rope.text is not None:
        at = rank
        if by == "units":
            at = 0
            for _ in range(rank):
                at = rope.text.index("\n", at) + 1
        return Rope(rope.text[:at]), Rope(rope.text[at:])
    before = getattr(rope.left, by)
    if rank <= before:
        a, b = split(rope.left, rank, by)
        return a, joined(b, rope.right)
    a, b = split(rope.right, rank - before, by)
    return joined(rope.left, a), b


def rearranged(text: str, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of a text; which lines are cut, and how, follows from the seed and the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    rope = build(text)
    n = rope.units
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, rest = split(rope, first, "units")
    middle, suffix = split(rest, second - first, "units")
    form = "spm" if h[3] % 100 < spm else "psm"
    part = {PREFIX: prefix, SUFFIX: suffix, MIDDLE: middle}
    out = joined(*(x for mark in FORMS[form] for x in (Rope(mark), part[mark])))
    return n, form, prefix.points, middle.points, str(out)


def restored_text(output: str, form: str) -> str:
    """The text of an output, from it and its form alone. No part holds a mark, so each mark's first place is its own."""
    if form == "plain":
        return output
    marks = FORMS[form]
    places = [output.index(mark) for mark in marks]
    rest, at, part = build(output), 0, {}
    for mark, start, end in zip(marks, places, [*places[1:], len(output)], strict=True):
        _, rest = split(rest, start + len(mark) - at, "points")
        part[mark], rest = split(rest, end - start - len(mark), "points")
        at = end
    return str(joined(part[PREFIX], part[MIDDLE], part[SUFFIX]))


OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (lines), form, prefix_chars, middle_chars (code points; null if plain), output.

    ``rate``: in a hundred texts so many are rearranged; ``spm``: so many of these have the suffix first. Null texts are
    empty and plain, as are texts that hold a mark. A null doc_id counts as the empty text when cuts are drawn. Repeated
    rows repeat; an empty table gives an empty result; columns other than doc_id and text are ignored. Rows are made
    where they are read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for texts in chunks(batch.column(1)):
                ids = batch.column(0).slice(start, len(texts))
                start += len(texts)
                made = [rearranged(text, i.as_py(), seed, rate, spm) for i, text in zip(ids, texts, strict=True)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(rows, OUT)


def restored(made: DataFrame) -> DataFrame:
    """Rows of ``fill_in_middle`` with ``restored``: the text, rebuilt from output and form."""
    columns = made.columns
    output, form = columns.index("output"), columns.index("form")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for texts in chunks(batch.column(output)):
                part = batch.slice(start, len(texts))
                start += len(texts)
                back = [restored_text(text, f.as_py()) for text, f in zip(texts, part.column(form), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.string())], names=[*columns, "restored"])

    return made.mapInArrow(rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema) + ", restored string")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of every document's output and of the text restored from it."""
    made = restored(fill_in_middle(read_table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, len(lines) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS k FROM t
), c AS (
  SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR k[3] % 100 >= {RATE} THEN 'plain' WHEN k[4] % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, array_to_string(lines[1:a], '') AS pre, array_to_string(lines[a + 1:b], '') AS mid, array_to_string(lines[b + 1:], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
