"""A fixed public vocabulary of pieces, and its matches in many words at once.

An Aho-Corasick automaton enumerates every piece in every word; the dynamic programs over them (op 4 and 6)
then run over all words side by side, one end position at a time.
"""
from __future__ import annotations

import functools
from itertools import chain

import numpy as np

MARK = "▁"
#: Stands between words that are searched together; no piece holds it, and a word that does is handled by itself.
APART = "\0"
#: The library's penalty below the lowest score for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Words beyond this length are handled one by one, in time in proportion to their length.
SIDE_BY_SIDE = 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.scores = np.array([model.get_score(i) for i in range(len(self.pieces))])
        self._build()

    def _build(self) -> None:
        import ahocorasick

        self.lengths = np.array([len(p) for p in self.pieces])
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.singles = {p for p in self.pieces if len(p) == 1}
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY

    def matches(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece of every match; by word, end, and start.  No word holds APART."""
        joined = APART.join(words)
        flat = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        ends, piece = flat[:, 0] + 1, flat[:, 1]
        begins = np.zeros(len(words), np.int64)
        np.cumsum([len(w) + 1 for w in words[:-1]], out=begins[1:])
        word = np.searchsorted(begins, ends - 1, side="right") - 1
        ends = ends - begins[word]
        return word, ends - self.lengths[piece], ends, piece

    def uncovered(self, words: list[str]) -> list[tuple[int, int, str]]:
        """Word, place and character wherever no piece is that single character."""
        singles = self.singles
        return [(i, k, c) for i, w in enumerate(words) if not singles.issuperset(w) for k, c in enumerate(w) if c not in singles]


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)
