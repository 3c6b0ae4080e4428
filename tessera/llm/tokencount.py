"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary pieces that end at a position; dynamic programming keeps only the best score
and the piece count of the best path to each position, never the pieces. Ties follow the tokenizer: pieces are
tried by rising start, and a later one must score strictly more. A character that no piece covers alone is unknown, ten
below the least score, and counts its bytes where the vocabulary has byte pieces.

No piece goes on over a space mark that follows another character, and none holds a line feed, so a text's best path
is the best paths of its parts in order; parts are looked up in a bounded memory first. That is done for scores that are
whole numbers, as here: they add up exactly, so ties come out the same in parts as in the whole. With other scores texts
are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMORY = 1_000_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file without its control pieces; the unknown piece stays first."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size()) if not sp.is_control(i)]


class Counter:
    """Best score and piece count of texts, for a vocabulary of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.has_bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        if any(not s.is_integer() for _, s in pieces):
            self.splits = None  # sums of parts round otherwise than the whole, which may turn ties
        elif not self.has_bytes or any("\n" in p or SPACE_MARK in p.lstrip(SPACE_MARK) for p in names):
            self.splits = None  # unknown runs count once, or pieces go over the cuts: texts are taken whole
        else:
            self.splits = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+|\n")
        self.marked: dict[str, tuple[float, int]] = {}
        self.bare: dict[str, tuple[float, int]] = {}

    def path(self, text: str) -> tuple[float, int]:
        """Viterbi over the whole of ``text``, already with space marks."""
        n = len(text)
        if not n:
            return 0.0, 0
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, single, best, best_count = 0, False, None, 0
        done = 0

        def close(end: int) -> None:
            """Settle position ``end``: the unknown character is its last candidate."""
            nonlocal best, best_count, single
            is_unknown = False
            if not single:
                s = score[end - 1] + self.unknown
                if best is None or s > best:
                    best, is_unknown = s, True
                    if self.has_bytes:
                        best_count = count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
                    else:  # a run of unknown characters is one piece
                        best_count = count[end - 1] + (not unknown[end - 1])
            score[end], count[end], unknown[end] = best, best_count, is_unknown
            best, single = None, False

        for last, (length, piece_score) in self.automaton.iter(text):  # by rising end, longest first
            end = last + 1
            while done < end - 1:
                done += 1
                close(done)
            at = end - length
            s = score[at] + piece_score
            if best is None or s > best:
                best, best_count = s, count[at] + 1
            single |= length == 1
        while done < n:
            done += 1
            close(done)
        return score[n], count[n]

    def _part(self, text: str, memory: dict[str, tuple[float, int]], mark: str) -> tuple[float, int]:
        found = memory.get(text)
        if found is None:
            if len(memory) >= MEMORY:
                memory.clear()
            memory[text] = found = self.path(mark + text)
        return found

    def count(self, text: str | None) -> tuple[float, int]:
        """(best score, pieces) of a whole text as the tokenizer reads it: a space mark first, and for each space."""
        if not text:
            return 0.0, 0
        if self.splits is None:
            return self.path(SPACE_MARK + text.replace(" ", SPACE_MARK))
        if "  " in text or SPACE_MARK in text or text[0] == " " or text[-1] == " " or "\n " in text or " \n" in text:
            parts = self.splits.findall(SPACE_MARK + text.replace(" ", SPACE_MARK))
            found = [self._part(p, self.bare, "") for p in parts]
        else:
            lines = text.split("\n")
            words = [line.split(" ") for line in lines]
            found = [self._part(w, self.marked, SPACE_MARK) for i, ws in enumerate(words) for w in (ws[1:] if i else ws)]
            found += [self._part(ws[0], self.bare, "") for ws in words[1:]]
            found += [self._part("\n", self.bare, "")] * (len(lines) - 1)
        return sum(s for s, _ in found), sum(n for _, n in found)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker process and file."""
    if path not in _counters:
        _counters[path] = Counter(load_pieces(path))
    return _counters[path]


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens long, best_score double) for the whole text of each row.

    Null and empty texts have no tokens. Repeated rows and null ids get a row each; other columns aren't read.
    """
    where = path or vocabulary_path()
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counter(where).count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())], ["id", "n_tokens", "best_score"])

    return kept.mapInArrow(run, f"id {id_type}, n_tokens long, best_score double").withColumnRenamed("id", id_col)
