"""Token ids for whole texts, with a word cache in front of the tokenizer.

The vocabulary of word_bpe_49k.json splits a text into words and merges inside
a word only, so ids of a text are the ids of its words in order. Texts made of
ASCII and precomposed Latin letters are split here by the vocabulary's own
pattern and a worker process remembers its words' ids from task to task, in two
generations, so that frequent words stay; any other text, and any text that holds
a special token's string, goes to the tokenizer as a whole.
"""

from __future__ import annotations

import os
import re

VOCABULARY = "word_bpe_49k.json"
END_ID = 1  # closes every document
GENERATION = 400_000  # words a worker remembers, twice over: those in use and the generation before

# The vocabulary's split pattern over the letters of PLAIN, and its special tokens.
LATIN = "ß-öø-ɏ"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^ \t-\ra-z{LATIN}0-9]+")
OTHER = re.compile("[^\x00-\x7fÀ-ÖØ-öø-įı-ž]")
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(text): little-endian unsigned 32-bit ids as bytes, without the closing id."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.np = np
        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        ends = [i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        self.last[ends] = True

    def _bytes(self, ids) -> bytes:
        return self.np.array(ids, dtype="<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if (not text.isascii() and OTHER.search(text)) or any(s in text for s in SPECIAL):
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = WORDS.findall(text.lower())
        every = set(words)
        if missing := every.difference(self.words):
            if len(self.words) + len(missing) > GENERATION:
                self.older, self.words, missing = self.words, {}, every
            self._learn(missing)
        return b"".join(map(self.words.__getitem__, words))

    def _learn(self, missing: set[str]) -> None:
        """Takes words from the older generation, and encodes the rest in one text, cutting its ids after each id that ends a word."""
        np = self.np
        new = []
        for w in missing:
            known = self.older.get(w)
            if known is None:
                new.append(w)
            else:
                self.words[w] = known
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.last[ids]) + 1
        if len(cuts) != len(new) or (len(cuts) and cuts[-1] != len(ids)):
            raise ValueError("the vocabulary has no mark at some word's end")
        raw, at = ids.tobytes(), 0
        for w, cut in zip(new, (4 * cuts).tolist(), strict=True):
            self.words[w] = raw[at:cut]
            at = cut


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
