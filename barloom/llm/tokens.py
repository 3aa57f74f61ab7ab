"""Token ids of whole texts by a public vocabulary of the ``tokenizers`` library."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np

#: Words whose ids are remembered in one worker; as many more are kept from before, those used again longest.
REMEMBERED = 250_000
#: Texts whose unknown words go to the library together.
TOGETHER = 64

#: White space other than the plain space and the line feed.
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
#: A word of letters with up to three signs after it; an apostrophe may belong to the letters.
_SIGNS_AFTER = re.compile("(\n?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]{1,3})").fullmatch
_encoders: dict[str, "Encoder"] = {}


def _plain(text: str) -> bool:
    """Single spaces or up to two line feeds between visible characters, and no other white space."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text:
        return False
    return not any(c in text for c in _OTHER_SPACE)


class Encoder:
    """Encodes texts word by word and remembers the ids of words.

    A byte-level vocabulary with the usual pattern never joins a space or a line feed to a visible character before it,
    nor a line feed to one after it, so a text may be cut before single spaces and line feeds and the parts encoded
    apart. Signs after the letters of a word are a part of their own, so their ids are put behind those of the letters.
    Unknown words go to the library in one string; each of their first ids is one that starts with a space or is a
    line feed. Texts with any other white space, and all texts of vocabularies that cut them otherwise, go to the
    library whole. Special tokens in a text count as ordinary text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        cut = self.tokenizer.pre_tokenizer and json.loads(self.tokenizer.pre_tokenizer.__getstate__())
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.by_word = bool(cut) and self.tokenizer.normalizer is None and usual.items() <= cut.items()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.opens = {" ": np.array([x.startswith("Ġ") for x in names]), "\n": np.array([x == "Ċ" for x in names])}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}

    def forget(self) -> None:
        self.known.clear()
        self.older.clear()

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _ask(self, words: list[str], between: str) -> None:
        """Learn words that follow a space, or that begin with a line feed."""
        if not words:
            return
        ids = self.library(between + between.join(words) if between == " " else "".join(words))
        first = np.flatnonzero(self.opens[between][ids])
        if len(first) != len(words):
            raise ValueError("this vocabulary does not mark where a word begins")
        raw, cut = ids.tobytes(), [*(first * 4).tolist(), len(ids) * 4]
        self.known.update((w, raw[lo:hi]) for w, lo, hi in zip(words, cut, cut[1:]))

    def _learn(self, words: set[str]) -> None:
        ask, signed = set(), []
        for word in words:
            if word in self.older:
                self.known[word] = self.older[word]
            elif parts := _SIGNS_AFTER(word):
                letters, signs = parts.groups()
                signed.append((word, letters, signs))
                if letters not in self.known:
                    if letters in self.older:
                        self.known[letters] = self.older[letters]
                    else:
                        ask.add(letters)
            else:
                ask.add(word)
        self._ask([w for w in ask if w[0] != "\n"], " ")
        self._ask([w for w in ask if w[0] == "\n"], "\n")
        for word, letters, signs in signed:
            if signs not in self.signs:
                self.signs[signs] = self.library(signs).tobytes()
            self.known[word] = self.known[letters] + self.signs[signs]

    def ids(self, texts: Sequence[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null counts as empty."""
        for at in range(0, len(texts), TOGETHER):
            yield from self._some(texts[at : at + TOGETHER])

    def _some(self, texts: Sequence[str | None]) -> Iterator[bytes]:
        # a line feed is put before each text and its id left out, so first words are those of a line
        words = [("\n" + t).replace("\n", " \n")[1:].split(" ") if t and self.by_word and _plain(t) else None for t in texts]
        all_ = set().union(*(w for w in words if w))
        new = all_.difference(self.known)
        if new and len(self.known) + len(new) > REMEMBERED:
            self.known, self.older = {}, self.known
            new = all_
        if new:
            self._learn(new)
        rest = [t or "" for t, w in zip(texts, words) if not w]
        rest = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else ())
        for own in words:
            yield b"".join(map(self.known.__getitem__, own))[4:] if own else np.array(next(rest).ids, "<u4").tobytes()


def encoder(path: str) -> Encoder:
    """The encoder of this worker process; the file is read where the work runs."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
