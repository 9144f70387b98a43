"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end
at each character; the dynamic programme keeps, per position, the best score
and how many tokens its path has, nothing to trace back, and of both only as
many positions as the longest piece reaches back: a word of any length takes
the same memory. Ties go as in the tokenizer: of equal scores the piece that begins first wins, an unknown
character comes after all pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import Memo, tokenizer_file

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
LONG = 64  # longer words aren't remembered


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts tokens of one word (a piece of text between spaces, its space sign in front)."""

    def __init__(self, pieces: Sequence[tuple[str, float]], byte_fallback: bool = True) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max((len(piece) for piece, _ in pieces), default=1)
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        known = {piece for piece, _ in pieces}
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in known} if byte_fallback else set()

    def run(self, word: str) -> tuple[int, int, float]:
        """Tokens, how many of them are bytes or unknown, and the best score."""
        n, size = len(word), self.longest + 1
        best, count, strange = [0.0] * size, [0] * size, [0] * size  # rings by position
        run, covered = 0, True  # bytes of the unknown characters just before; whether all are pieces
        matches = self.automaton.iter(word)
        last, match = next(matches, (n, None))
        for end in range(1, n + 1):
            top, start, single = float("-inf"), -1, False
            while last == end - 1:  # longest first
                length, score = match
                value = score + best[(end - length) % size]
                single |= length == 1
                if start < 0 or value > top:
                    top, start = value, (end - length) % size
                last, match = next(matches, (n, None))
            here = end % size
            if not single:
                before = (end - 1) % size
                value = self.unknown + best[before]
                if start < 0 or value > top:
                    encoded = word[end - 1].encode()
                    tokens = -self.fallback(run, covered)
                    run, covered = run + len(encoded), covered and self.bytes.issuperset(encoded)
                    tokens += self.fallback(run, covered)
                    best[here], count[here], strange[here] = value, count[before] + tokens, strange[before] + tokens
                    continue
            run, covered = 0, True
            best[here], count[here], strange[here] = top, count[start] + 1, strange[start]
        return count[n % size], strange[n % size], best[n % size]

    def fallback(self, run: int, covered: bool) -> int:
        """Tokens of a run of unknown characters of so many bytes: the bytes where all are pieces, else one."""
        return run if self.bytes and covered else min(run, 1)


def words(text: str) -> list[str]:
    """Words as the tokenizer cuts them: spaces become its space sign, one is put in front, each begins a word."""
    if not text:
        return []
    marked = text.replace(" ", SPACE)
    return [SPACE + x for x in (marked[1:] if marked[0] == SPACE else marked).split(SPACE)]


def count_tokens(docs: DataFrame, *, model: str | None = None, byte_fallback: bool = True) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_tokens, n_fallback, best_score.

    ``n_fallback`` is how many of the tokens are bytes or unknown,
    ``best_score`` the sum of the words' best path scores. Null and empty
    texts have no tokens. Repeated rows and null ids are counted each by
    itself; other columns are not read; no rows give no rows. One pass, no shuffle.
    """
    path = model or tokenizer_file("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        counter = Counter(vocabulary(path), byte_fallback)
        memo = Memo(counter.run)

        def found(word: str) -> tuple[int, int, float]:
            return memo[word] if len(word) <= LONG else counter.run(word)

        for batch in batches:
            tokens, strange, scores = [], [], []
            for text in batch.column(1).to_pylist():
                own = list(map(found, words(text or "")))
                tokens.append(sum(x[0] for x in own))
                strange.append(sum(x[1] for x in own))
                scores.append(float(sum(x[2] for x in own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(strange, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_tokens", "n_fallback", "best_score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, n_fallback long, best_score double")
