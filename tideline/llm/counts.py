"""Token counts of a unigram tokenizer without building its tokens.

An Aho-Corasick automaton finds every vocabulary piece that ends at a character; the best score of
the text up to there and the number of pieces on that best path are all that is carried along. Ties
go to the piece that starts first, as in the tokenizer, which fills its table from left to right and
replaces an entry only by a higher score. Characters that no piece has are counted as their UTF-8 bytes
where the vocabulary has a piece for every byte, else a run of them as one unknown piece. Words are
tokenized on their own, so frequent words are remembered.

The public piece file is one of merges: its scores are the merges' ranks, which serve as log
probabilities here. Counts are those of a unigram tokenizer with these pieces and scores, not of the
merge tokenizer.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.batches import Remembered, per_chunk

MARK = "▁"
#: Fixed value: what the tokenizer takes off the lowest score for an unknown character.
UNKNOWN_PENALTY = 10.0
NEVER = float("-inf")


def unigram_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a public piece file; the unknown piece comes first, control pieces are left out."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kept = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i))]
    return [("<unk>", 0.0)] + [(p.id_to_piece(i), p.get_score(i)) for i in kept]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.has_bytes = {f"<0x{b:02X}>" for b in range(256)} <= {piece for piece, _ in vocabulary}
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            self.automaton.add_word(piece, (len(piece), score, i == 0))
        self.automaton.make_automaton()
        self.remembered = Remembered(self._word)

    def _word(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best path through one word.

        Neighbouring unknown characters and unknown pieces are one run. ``run`` holds, for paths that
        end in one, the pieces before it, its bytes, and whether it is a single unknown piece.
        """
        word = MARK + word
        n = len(word)
        score, pieces = [0.0] + [NEVER] * n, [0] * (n + 1)
        run: list[tuple[int, int, bool] | None] = [None] * (n + 1)
        unlisted = [i + 1 for i, c in enumerate(word) if c not in self.single]
        for last, (length, value, is_unknown) in self.automaton.iter(word):
            while unlisted and unlisted[0] <= last:
                end = unlisted.pop(0)
                self._unknown(word[end - 1 : end], end - 1, end, self.unknown, False, score, pieces, run)
            end = last + 1
            start = end - length
            if is_unknown:
                self._unknown(word[start:end], start, end, value, True, score, pieces, run)
            elif score[start] + value > score[end]:
                score[end], pieces[end], run[end] = score[start] + value, pieces[start] + 1, None
        for end in unlisted:
            self._unknown(word[end - 1 : end], end - 1, end, self.unknown, False, score, pieces, run)
        return pieces[n], score[n]

    def _unknown(self, text: str, start: int, end: int, value: float, piece: bool, score: list, pieces: list, run: list) -> None:
        """A character that is no piece, which is tried last, as it starts last; or the unknown piece."""
        s = score[start] + value
        if s > score[end]:
            before, size, _ = run[start] or (pieces[start], 0, False)
            run[end] = (before, size + len(text.encode()), piece and not size)
            score[end] = s
            pieces[end] = before + (run[end][1] if self.has_bytes and not run[end][2] else 1)

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = text.replace(" ", MARK)
        words = (marked[1:] if marked.startswith(MARK) else marked).split(MARK)
        found = list(map(self.remembered.__getitem__, words))
        return sum(p for p, _ in found), sum(s for _, s in found)


@cache
def _counter(model_file: str) -> UnigramCounter:
    return UnigramCounter(unigram_vocabulary(model_file))


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the ``score`` of the best path, one row per row of ``docs``.

    Counts hold no begin or end. A null or empty text has no tokens and score 0. Repeated rows and null ids stay; other columns
    are not looked at; texts are counted whole.
    """

    def make():
        counter = _counter(model_file)

        def work(doc_ids, texts):
            found = [counter.count(t) for t in texts]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([s for _, s in found], pa.float64()),
                ],
                ["doc_id", "n_tokens", "score"],
            )

        return work

    return per_chunk(docs, make, "doc_id bigint, n_tokens bigint, score double")
