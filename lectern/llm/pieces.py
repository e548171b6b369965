"""SentencePiece encoding and decoding by an automaton over the pieces and one Viterbi pass.

An Aho-Corasick automaton over all pieces reads a text once. At each position its output
links name the pieces that end there, and each relaxes the best way to that position. In a
unigram model the best way has the highest sum of scores. In a byte-pair model, where sums
of scores don't tell what the library returns, the best way has the fewest faults: a piece
is at fault if merging it with the piece before gives anything but these two, and a
character that falls back to bytes though it needn't is one too. Merging a prefix of a text
gives its one way without faults, so the result equals the library's. Characters without a
piece fall back to their bytes.

Texts are cut before each run of spaces, which no piece crosses (checked on load); a part
is worked out once per worker and then known by its 64-bit hash, in a store of bounded
size. Decoding joins the pieces and drops the space put before each text.

Null and empty texts have no ids. A literal word mark (U+2581) in a text decodes to a
space, as in the library, and such texts are compared in that form. Repeated rows each get
a row; an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lectern.llm.words import U64, Words, separators, slices, text_column
from lectern.session import bounded_batches

MARK = "▁"
#: Neighbouring pieces whose merging is remembered.
_KEPT_PAIRS = 200_000
#: More faults than any text has characters.
_WORST = 1 << 62
_SPACES = separators([(0x20, 0x20)])
_PARTS = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


class Pieces:
    """The pieces of a model: strings, scores, and the ids of single bytes."""

    def __init__(self, strings: dict[int, str], scores: dict[int, float], byte_ids: dict[int, int], unk: int, kind: str):
        self.strings, self.scores, self.byte_ids, self.unk, self.kind = strings, scores, byte_ids, unk, kind

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        strings, scores, byte_ids = {}, {}, {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                strings[i], scores[i] = sp.id_to_piece(i), sp.get_score(i)
        probe = " A  b\tcéﬁ① \n"
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("the model changes texts before it cuts them")
        return cls(strings, scores, byte_ids, sp.unk_id(), kind)


class Encoder:
    def __init__(self, pieces: Pieces, limit: int = 600_000):
        import ahocorasick

        self.pieces, self.limit = pieces, limit
        self.automaton = ahocorasick.Automaton()
        for i, s in pieces.strings.items():
            if regex.search(f"[^{MARK}]{MARK}", s):
                raise ValueError("a piece crosses a space")
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.ids = {s: i for i, s in pieces.strings.items()}
        self.apart: dict[tuple[int, int], bool] = {}
        self.part = self._byte_pairs if pieces.kind == "bpe" else self._unigram
        self.least = min(pieces.scores.values(), default=0.0) - 10.0
        size = max([*pieces.strings, *pieces.byte_ids.values(), pieces.unk], default=0) + 1
        raw = [b""] * size
        for i, s in pieces.strings.items():
            raw[i] = s.replace(MARK, " ").encode()
        for b, i in pieces.byte_ids.items():
            raw[i] = bytes([b])
        raw[pieces.unk] = " ⁇ ".encode()
        self.width = np.array([len(x) for x in raw], dtype=np.int64)
        self.where = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known, self.pool = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int32)
        self.at, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _merge(self, text: str) -> list[str]:
        """Pieces of a short text by repeated merging of its best neighbours."""
        out = list(text)
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                k = self.ids.get(out[i] + out[i + 1])
                if k is not None and (best is None or self.pieces.scores[k] > best):
                    best, at = self.pieces.scores[k], i
            if at < 0:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def _stay_apart(self, a: int, b: int) -> bool:
        key = (a, b)
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > _KEPT_PAIRS:
                self.apart.clear()
            s = self.pieces.strings
            x = s[b] if a < 0 else s[a] + s[b]
            found = self.apart[key] = self._merge(x) == ([s[b]] if a < 0 else [s[a], s[b]])
        return found

    def _byte_pairs(self, text: str) -> list[int]:
        n = len(text)
        # Of the best way to each position: its faults, and length and id (-1: bytes) of its last piece.
        faults = [_WORST] * (n + 1)
        length, last = [1] * (n + 1), [-1] * (n + 1)
        faults[0] = done = 0
        apart = self.apart.get
        for end, (size, i) in self.automaton.iter(text):
            end += 1
            while done < end - 1:  # what is behind is final; a place that no piece ends at is reached by bytes
                done += 1
                if faults[done] == _WORST:
                    faults[done] = faults[done - 1]
            if not faults[end]:  # no way is better
                continue
            start = end - size
            ok = apart((last[start], i))
            if ok is None:
                ok = self._stay_apart(last[start], i)
            got = faults[start] + (not ok)
            if got < faults[end]:
                faults[end], length[end], last[end] = got, size, i
        out, at = [], n
        while at:
            size, i = length[at], last[at]
            if i < 0:
                out += self._fallback(text[at - size : at])[::-1]
            else:
                out.append(i)
            at -= size
        return out[::-1]

    def _unigram(self, text: str) -> list[int]:
        n = len(text)
        score = [-1e30] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        score[0] = 0.0
        done = 0
        for end, (length, i) in self.automaton.iter(text):
            end += 1
            while done < end - 1:
                done += 1
                if score[done - 1] + self.least > score[done]:
                    score[done], back[done] = score[done - 1] + self.least, (1, -1)
            got = score[end - length] + self.pieces.scores[i]
            if got > score[end]:
                score[end], back[end] = got, (length, i)
        while done < n:
            done += 1
            if score[done - 1] + self.least > score[done]:
                score[done], back[done] = score[done - 1] + self.least, (1, -1)
        out, at = [], n
        while at:
            length, i = back[at]
            if i < 0:
                out += self._fallback(text[at - length : at])[::-1]
            else:
                out.append(i)
            at -= length
        return out[::-1]

    def _fallback(self, char: str) -> list[int]:
        raw = char.encode()
        ids = [self.pieces.byte_ids.get(b) for b in raw]
        return ids if None not in ids else [self.pieces.unk]

    def encode_text(self, text: str) -> list[int]:
        """The ids of one text, part by part."""
        if not text:
            return []
        return [i for p in _PARTS(MARK + text.replace(" ", MARK)) for i in self.part(p)]

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        ids, sizes = array("i"), []
        for raw in words:
            got = self.part(MARK + raw.decode())
            ids.extend(got)
            sizes.append(len(got))
        size = np.array(sizes, dtype=np.int64)
        at = np.cumsum(size) - size + len(self.pool)
        self.pool = np.concatenate([self.pool, np.frombuffer(ids, dtype=np.int32)])
        known = np.concatenate([self.known, keys])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.at, self.size = np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def encode(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive UTF-8 texts and each text's range in them."""
        w = Words(data, offsets, _SPACES, lower=False)
        raw = np.frombuffer(data, dtype=np.uint8)
        n = len(offsets) - 1
        # Texts with other than single spaces between words, or a literal mark, go part by part.
        spaces = np.concatenate([[0], np.cumsum(raw == 0x20)])[offsets]
        odd = np.diff(spaces) != np.maximum(w.counts - 1, 0)
        mark = MARK.encode()
        if mark in data:
            odd |= np.array([mark in data[a:b] for a, b in zip(offsets, offsets[1:], strict=False)])
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
        ids = self.pool[np.repeat(self.at[word] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]
        bounds = np.concatenate([[0], end])[w.bounds]
        if odd.any():
            parts = [
                np.array(self.encode_text(data[offsets[i] : offsets[i + 1]].decode()), dtype=np.int32) if odd[i] else ids[bounds[i] : bounds[i + 1]]
                for i in range(n)
            ]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            ids = np.concatenate(parts) if parts else ids
        return ids, bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the texts behind ranges of ids, and each text's range in them."""
        width = self.width[ids]
        end = np.cumsum(width)
        out = self.bytes[np.repeat(self.where[ids] - (end - width), width) + np.arange(int(end[-1]) if len(end) else 0)]
        at = np.concatenate([[0], end])[bounds]
        keep = np.ones(len(out), dtype=bool)
        begins = at[:-1][at[1:] > at[:-1]]
        keep[begins[out[begins] == 0x20]] = False  # the space put before each text
        return out[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[at]


@lru_cache(maxsize=1)
def shared_encoder(model: str, kind: str) -> Encoder:
    """The encoder of this worker process, which keeps what it knows from task to task."""
    return Encoder(Pieces.load(model, kind))


def encode(docs: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """Per row: doc_id, n_tokens, ids and whether decoding gives the text again.

    ``model`` is the path of a model file that every worker can read.
    """
    bounded_batches(docs.sparkSession, size="8m")

    def run(batches):
        mark = MARK.encode()
        for batch in batches:
            encoder = shared_encoder(model, kind)
            doc_ids = batch.column(0).cast(pa.int64())
            for first, last, data, offsets in slices(text_column(batch)):
                ids, bounds = encoder.encode(data, offsets)
                back, at = encoder.decode(ids, bounds)
                same = [
                    back[a:b] == data[c:d] or back[a:b] == data[c:d].replace(mark, b" ")
                    for a, b, c, d in zip(at.tolist(), at[1:].tolist(), offsets.tolist(), offsets[1:].tolist(), strict=False)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids[first:last], pa.array(np.diff(bounds).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(same, pa.bool_()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give the empty text."""
    bounded_batches(encoded.sparkSession)

    def run(batches):
        for batch in batches:
            encoder = shared_encoder(model, kind)
            rows = [np.asarray(x or [], dtype=np.int32) for x in batch.column(1).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
            data, at = encoder.decode(np.concatenate(rows) if rows else np.zeros(0, np.int32), bounds)
            text = [data[a:b].decode(errors="replace") for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
