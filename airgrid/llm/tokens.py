"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists all pieces that match; for every end position the search keeps the best score and the number of
pieces of that path, no path itself. Tie rule: candidates of an end are tried from the longest piece to the shortest and only a
larger score replaces one; where no piece is the single character itself, the character is also tried last as unknown, 10 below
the least score. An unknown character counts as its UTF-8 bytes if the vocabulary has byte pieces, else neighbouring ones count as one.
Spaces are written as the piece mark, and one is put in front of a text. Scores are summed in double precision.

No piece of the vocabulary goes on across the start of a word, so that words are searched on their own and a task
remembers at most ``KNOWN`` of them; with a vocabulary that has such pieces, whole texts are searched.

Defined results: null and empty texts have 0 tokens and score 0; ids and repeated rows are returned as they are; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import slices, utf8_texts

MARK = "▁"
KNOWN = 500_000
PENALTY = 10.0


@dataclass
class Unigram:
    pieces: dict[str, float]
    byte_pieces: bool

    @property
    def unknown(self) -> float:
        return min(self.pieces.values()) - PENALTY


def read_model(path: str) -> Unigram:
    """Pieces and scores of a model file; unknown, control and byte pieces match no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    return Unigram({sp.id_to_piece(i): float(sp.get_score(i)) for i in ids if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))},
                   any(sp.is_byte(i) for i in ids))


class Counter:
    """One task's automaton and the words that it has met."""

    def __init__(self, model: Unigram):
        self.model, self.unknown, self.known = model, model.unknown, {}
        self.automaton = ahocorasick.Automaton()
        for piece, score in model.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        alone = "\n" if not any("\n" in p and len(p) > 1 for p in model.pieces) else ""
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in model.pieces)
        # without byte pieces, unknown characters at both sides of a line end would be counted apart
        alone = alone if model.byte_pieces else ""
        self.words = re.compile("(?s).+") if crossing or not model.byte_pieces else re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|{alone}" if alone else ""))

    def search(self, word: str) -> tuple[int, float]:
        """Number of pieces and score of the best path."""
        n = len(word)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(word)
        found = next(matches, None)
        for end in range(1, n + 1):
            top, pieces, single, is_unknown = None, 0, False, False
            while found is not None and found[0] == end - 1:
                length, score = found[1]
                value = best[end - length] + score
                if top is None or value > top:
                    top, pieces = value, count[end - length] + 1
                single = single or length == 1
                found = next(matches, None)
            if not single:
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    top, is_unknown = value, True
                    if self.model.byte_pieces:
                        pieces = count[end - 1] + len(word[end - 1].encode())
                    else:
                        pieces = count[end - 1] + (not unknown[end - 1])
            best[end], count[end], unknown[end] = top, pieces, is_unknown
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        known, total, score = self.known, 0, 0.0
        if len(known) > KNOWN:
            known.clear()
        for word in self.words.findall(MARK + text.replace(" ", MARK)):
            got = known.get(word)
            if got is None:
                got = known[word] = self.search(word)
            total += got[0]
            score += got[1]
        return total, score


def count_tokens(docs: DataFrame, model: Unigram) -> DataFrame:
    """doc_id, n_tokens and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for part in slices(batches):
            counter = counter or Counter(shared.value)
            found = [counter.count(t.decode()) for t in utf8_texts(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                                             names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, score double")
