"""Whole-text encoding with the tokenizers library, each distinct word once per worker."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import regex

from lectern.llm.words import SPACED, U64, Words


#: Pieces of words whose ids are kept beside those of whole words.
_KEPT_PIECES = 50_000
#: Signs that stand for themselves behind a word.
_SIGNS = frozenset(".,;:!?)")
#: Words that the quick way for printable ASCII must encode as the tokenizer does, else it is not used.
_PROBES = (
    "the The THE word. Word, (word) \"quoted\" it's IT'S don't we're I'll they'd x's's 'tis a_b a-b a/b 12 1,234.5 2nd x2y3 -- ... !? @home #tag $5 50%"
    " <b> <|x a|b [c] {d} e=f*g+h ~ ^ ` \\ C++ f(x) user@host.org http://a.b/c?d=e&f zzzqqx pneumonoultramicroscopic"
).split()


class WordEncoder:
    """Encodes texts exactly as the tokenizer does.

    It is made for tokenizers that drop white space and never look across it, which is
    checked on load. Texts are cut at ASCII white space; a word is known by its 64-bit
    hash, and new words go to the tokenizer, or, if probes on load show that it does the
    same, are lower-cased, cut and encoded piece by piece here. The store of known words is
    emptied when it is full, so memory stays bounded; results do not depend on it.
    """

    def __init__(self, path: str, limit: int = 800_000):
        # One task, one thread: Spark runs as many tasks as there are cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_padding()
        self.exact.no_truncation()
        if len(self.exact.encode("a \n b", add_special_tokens=False).ids) != 2:
            raise ValueError("the tokenizer keeps white space")
        #: For words of printable ASCII the tokenizer lower-cases, cuts so and encodes each piece.
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.model = self.exact.model
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.limit = limit
        self.quick = True
        self._forget()
        texts = [*_PROBES, *(f"{a} \t{b}\n{a}" for a, b in zip(_PROBES, _PROBES[1:], strict=False)), "é\u3000\x1c x  y\r\n日本 z\x00"]
        if not self._is_exact(texts):
            self.quick = False
            self._forget()
            if not self._is_exact(texts):
                raise ValueError("the tokenizer looks across white space")
        self._forget()

    def _is_exact(self, texts: list[str]) -> bool:
        raw = [t.encode() for t in texts]
        mine = self.encode(b"".join(raw), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
        theirs = [np.array(self.exact.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        return mine == theirs

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=U64)  # sorted hashes of the words
        self.at = np.zeros(0, dtype=np.int64)  # where their ids begin in the pool
        self.size = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype="<u4")

    def _piece(self, piece: str) -> tuple[int, ...]:
        found = tuple([t.id for t in self.model.tokenize(piece)])
        if len(self.pieces) < _KEPT_PIECES:
            self.pieces[piece] = found
        return found

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        ids, sizes, other = array("I"), [], []
        get, add = self.pieces.get, ids.extend
        for i, raw in enumerate(words):
            before = len(ids)
            if self.quick and raw.isascii() and len(raw) <= 200 and b"<|" not in raw and (word := raw.decode()).isprintable():
                word = word.lower()
                if word.isalpha():
                    add(get(word) or self._piece(word))
                elif word[:-1].isalpha() and word[-1] in _SIGNS:
                    add(get(word[:-1]) or self._piece(word[:-1]))
                    add(get(word[-1]) or self._piece(word[-1]))
                else:
                    for piece in self.cut(word):
                        add(get(piece) or self._piece(piece))
            else:
                other.append(i)
            sizes.append(len(ids) - before)
        rare: list[np.ndarray] = []
        for i in range(0, len(other), 1000):
            texts = [words[j].decode() for j in other[i : i + 1000]]
            rare += [np.array(e.ids, dtype="<u4") for e in self.exact.encode_batch_fast(texts, add_special_tokens=False)]
        pool = np.frombuffer(ids, dtype="<u4") if len(ids) else np.zeros(0, dtype="<u4")
        size = np.array(sizes, dtype=np.int64)
        at = np.cumsum(size) - size
        used = len(pool)
        for i, e in zip(other, rare, strict=True):
            at[i], size[i] = used, len(e)
            used += len(e)
        at += len(self.pool)
        self.pool = np.concatenate([self.pool, pool, *rare])
        known = np.concatenate([self.known, keys])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.at, self.size = np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def encode(self, data: bytes, offsets: np.ndarray) -> list[bytes]:
        """The ids of consecutive UTF-8 texts, as little-endian unsigned 32-bit integers."""
        w = Words(data, offsets, SPACED, lower=False)
        keys, first, place = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > self.limit:
            self._forget()
        at = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != keys[inside]
        if new.any():
            self._learn(keys[new], [w.word(i) for i in first[new]])
            at = np.searchsorted(self.known, keys)
        word = at[place]
        size = self.size[word]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        ids = self.pool[np.repeat(self.at[word] - (end - size), size) + np.arange(total)]
        bounds = np.concatenate([[0], end])[w.bounds].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, which keeps what it knows from task to task."""
    return WordEncoder(path)
