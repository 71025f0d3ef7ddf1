"""Token counts with a public SentencePiece model, each distinct chunk counted once.

The model writes a blank as U+2581 and puts one before the text.  Where no piece holds
another character before U+2581, no merge crosses from a word into the blanks after it, so
the tokens of a text are those of its chunks (blanks and what follows them).  This is
checked on the vocabulary; a model that breaks it counts whole texts.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

CACHE = 500_000
_BLANK = "▁"
_CHUNK = re.compile(f"{_BLANK}+[^{_BLANK}]*")


class Pieces:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.apart = not any(re.search(f"[^{_BLANK}]{_BLANK}", p) for p in names)
        plain = self.model.encode(["x  y ", " x"], out_type=str)
        self.apart &= "".join(plain[0]) == f"{_BLANK}x{_BLANK * 2}y{_BLANK}" and "".join(plain[1]) == f"{_BLANK * 2}x"
        self.kept: dict[str, int] = {_BLANK: 1}  # a last blank alone, which the model can't be given

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        if not self.apart:
            return np.array([len(x) for x in self.model.encode(texts, num_threads=1)], np.int64)
        kept, out = self.kept, np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if not text:
                continue
            chunks = _CHUNK.findall(_BLANK + text.replace(" ", _BLANK))
            found = list(map(kept.get, chunks))
            if None in found:
                new = list({c for c, n in zip(chunks, found, strict=True) if n is None})
                if len(kept) > CACHE:
                    kept.clear()
                    kept[_BLANK] = 1
                fresh = dict(zip(new, map(len, self.model.encode([c[1:].replace(_BLANK, " ") for c in new], num_threads=1)), strict=True))
                kept |= fresh
                found = [fresh[c] if n is None else n for c, n in zip(chunks, found, strict=True)]
            out[k] = sum(found)
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """A worker's model, loaded once."""
    return Pieces(path)
