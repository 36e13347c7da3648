"""Token counts of a unigram vocabulary by count-only Viterbi over Aho-Corasick matches."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.words import Cache, alphabet, map_batches, slices, split_words

SPACE_MARK = "▁"
#: What an unknown character costs below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Bytes of the cache of a worker's counter.
CACHE_BYTES = 64 << 20
_counters: dict[str, UnigramCounter] = {}  # by vocabulary file, of this worker


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file without its control, unknown and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class UnigramCounter:
    """Pieces in the best segmentation of a text, unknown characters falling back to their bytes.

    Tie rules of the exact tokenizer: scores add up from the left in double precision, and of segmentations that reach a
    position with equal scores the one whose last piece starts first stays. Aho-Corasick reports the matches that end at a
    position longest first, so a later match replaces the best only if its score is strictly greater. A character is unknown
    where no piece is that character alone; it scores the worst piece less 10.

    Spaces become marks, with one put in front. No piece has a mark behind another character, so no piece crosses from a word
    into the mark after it, and the best segmentation of a text is that of its mark-led runs one after the other.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p, _ in vocabulary):
            raise ValueError("a piece has a space mark behind another character")
        self.automaton = ahocorasick.Automaton()
        for piece, value in vocabulary:
            self.automaton.add_word(piece, (len(piece), value))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.known = Cache(CACHE_BYTES)

    def count(self, run: str) -> int:
        n = len(run)
        best, pieces = [-float("inf")] * (n + 1), [0] * (n + 1)
        best[0], done = 0.0, 0
        single, unknown = self.single, self.unknown

        def pass_unknown(upto: int) -> None:
            nonlocal done
            while done < upto:  # positions between matches are reached by unknown characters alone
                c, score = run[done], best[done] + unknown
                done += 1
                if c not in single and score > best[done]:
                    best[done], pieces[done] = score, pieces[done - 1] + len(c.encode())

        for end, (size, value) in self.automaton.iter(run):
            pass_unknown(end)
            score, start = best[end + 1 - size] + value, end + 1 - size
            if score > best[end + 1]:
                best[end + 1], pieces[end + 1] = score, pieces[start] + 1
        pass_unknown(n)
        return pieces[n]

    def counts(self, column: pa.Array) -> np.ndarray:
        """Of each text. Runs of ordinary words are counted once while they stay in the worker's cache."""
        words = split_words(column, _BLANK)
        own = np.zeros(len(words.distinct), np.int64)
        for i, w in enumerate(words.distinct):
            n = self.known.get(w)
            if n is None:
                n = self.count(SPACE_MARK + w.decode())
                self.known.put(w, n)
            own[i] = n
        before = np.concatenate(([0], np.cumsum(own[words.index]))) if len(own) else np.zeros(1, np.int64)
        out = before[words.first[1:]] - before[words.first[:-1]]
        for i, text in enumerate(column.to_pylist()):
            if text and (text[0] == " " or text[-1] == " " or "  " in text or SPACE_MARK in text):
                out[i] = self.whole(text)
        return out

    def whole(self, text: str) -> int:
        """A text with runs of spaces: marks gather in front of the word after them."""
        marked, total, start = SPACE_MARK + text.replace(" ", SPACE_MARK), 0, 0
        for k in range(1, len(marked)):
            if marked[k] == SPACE_MARK and marked[k - 1] != SPACE_MARK:
                total += self.count(marked[start:k])
                start = k
        return total + self.count(marked[start:])


_BLANK = alphabet(b" ")


def counter(path: str) -> UnigramCounter:
    if path not in _counters:
        _counters[path] = UnigramCounter(read_vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_bytes for every row of ``docs (doc_id, text)``; a null or empty text has no tokens.

    Texts of any length are counted whole. Nothing is shuffled, repeated rows give repeated rows, other columns are ignored,
    an empty table gives no rows.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts = counter(path).counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), part.column("n_bytes")], ["doc_id", "n_tokens", "n_bytes"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return map_batches(rows, run, "doc_id bigint, n_tokens bigint, n_bytes bigint")
