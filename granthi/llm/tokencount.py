"""Token counts by a count-only Viterbi search.

An Aho-Corasick automaton over a unigram vocabulary gives every match in a text; dynamic programming
carries the best score and the number of pieces that reach it, and no lattice or back pointers. The
tie rule is the tokenizer's own: of equal scores the piece that begins first stays (a later one must be
strictly better). A character that no piece covers is
unknown, scores ten below the vocabulary's least, and counts as its UTF-8 bytes (byte fallback).
A text is solved in parts where that changes nothing: no piece of the vocabulary continues from another
character to a white-space mark (this is looked up), so the best path always has a cut before a run of marks,
and what begins with such a run is solved alone and remembered. Its sums then begin at 0, which is the same as
long as scores are whole numbers, as ranks are; other vocabularies are solved text by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import read_table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: Distinct words that a Python worker remembers; then it starts anew.
REMEMBERED = 1_000_000
#: The score of byte pieces: they are never better than another way.
BYTE_SCORE = -1e6


@lru_cache(2)
def vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """(piece, score): the unknown piece first, then ordinary and byte pieces; control pieces are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [("<unk>", 0.0)] + [
        (model.id_to_piece(i), BYTE_SCORE if model.is_byte(i) else model.get_score(i))
        for i in ids
        if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i))
    ]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - 10.0
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.known: dict[str, int] = {}
        cut = all(MARK not in piece.lstrip(MARK) and score == int(score) for piece, score in pieces)
        self.find = re.compile(f"{MARK}+[^{MARK}]*" if cut else "(?s).+").findall

    def word(self, word: str) -> int:
        """The number of pieces on the best path through ``word``."""
        size = len(word)
        best, count = [None] * (size + 1), [0] * (size + 1)
        best[0] = 0.0
        done = 0

        def settle(upto: int) -> None:
            for end in range(done + 1, upto + 1):  # ends whose matches are all seen: only an unknown one may come
                c = word[end - 1]
                if c not in self.single:
                    s = best[end - 1] + self.unknown
                    if best[end] is None or s > best[end]:
                        best[end], count[end] = s, count[end - 1] + len(c.encode())

        for last, (length, score) in self.automaton.iter(word):  # at one end the longest match comes first
            end = last + 1
            if end - 1 > done:
                settle(end - 1)
                done = end - 1
            s = best[end - length] + score
            if best[end] is None or s > best[end]:
                best[end], count[end] = s, count[end - length] + 1
        settle(size)
        return count[size]

    def text(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        words = self.find(marked if marked[0] == MARK else MARK + marked)
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = self.word(w)
        return sum(map(known.__getitem__, words))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens) for every row of ``docs``.

    Null and empty texts have no tokens. Repeated rows repeat; an empty table gives an empty result;
    columns other than doc_id and text are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            counts = pa.array([own.text(t.as_py() or "") for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=["doc_id", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
