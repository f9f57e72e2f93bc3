"""Token ids of whole batches of texts, by the tokenizers library."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

#: Chunks whose ids a worker keeps; beyond, it forgets the half that it has met least often.
MEMO_CHUNKS = 500_000
#: Bytes of text to encode at once: the more, the fewer times a common word is looked up.
ENCODE_BYTES = 2 << 20

_CUTTERS = np.zeros(256, dtype=bool)
_CUTTERS[[9, 10, 13, 32]] = True
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[0x21:0x7F] = True
_TWO = np.zeros(256, dtype=bool)
_TWO[0xC3:0xE0] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LATIN = np.zeros(256, dtype=bool)  # second bytes of the letters from U+00C0 to U+00FF
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_MARK = _PLAIN & ~_LETTER
_MARK[48:58] = False
_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Pre-tokenizers that split words from white space never let a token reach from a
    character that is not white space into white space behind it, nor from a letter into
    a mark behind it. So a text may be cut there, and words that come again need no second
    run of the tokenizer. Texts with an added token in them are cut at white space alone,
    and files whose added tokens take in white space are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t["content"].encode() for t in added]
        self.cuts = not any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in added)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.first = np.zeros(1 << 18, np.int64)
        self.count = np.zeros(1 << 18, np.int64)
        self.met = np.zeros(1 << 18, np.int32)

    def _forget_rare(self) -> None:
        n = len(self.memo)
        keep = np.zeros(n, dtype=bool)
        keep[np.argsort(-self.met[:n], kind="stable")[: MEMO_CHUNKS // 2]] = True
        memo, ids, first, count, met = self.memo, self.ids, self.first[:n][keep], self.count[:n][keep], self.met[:n][keep]
        self._forget()
        self.memo = {chunk: k for k, chunk in enumerate(c for c, kept in zip(memo, keep.tolist()) if kept)}
        upto = np.cumsum(count)
        self.used = int(upto[-1]) if len(upto) else 0
        self.ids = np.zeros(max(1 << 20, 2 * self.used), np.uint32)
        self.ids[: self.used] = ids[np.repeat(first - upto + count, count) + np.arange(self.used)]
        size = max(1 << 18, len(count))
        for name, values in (("first", upto - count), ("count", count), ("met", met // 2)):
            room = np.zeros(size, getattr(self, name).dtype)
            room[: len(values)] = values
            setattr(self, name, room)

    def _learn(self, chunks: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([c.decode("utf-8") for c in chunks], add_special_tokens=False)
        for chunk, e in zip(chunks, found):
            ids, slot = e.ids, len(self.memo)
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
            if slot == len(self.first):
                self.first, self.count, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.met))
            self.ids[self.used : self.used + len(ids)] = ids
            self.first[slot], self.count[slot] = self.used, len(ids)
            self.used += len(ids)
            self.memo[chunk] = slot

    def encode(self, raw: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the id ``end``, and where each text's begin."""
        begins = np.zeros(len(raw) + 1, dtype=bool)
        if self.cuts and len(raw) > 3:
            safe = _PLAIN[raw]
            safe[1:] |= (raw[1:] >= 0x80) & _TWO[raw[:-1]]
            begins[1:-1] = _CUTTERS[raw[1:]] & safe[:-1]
            data = raw.tobytes()
            if not any(a in data for a in self.added):
                letter = _LETTER[raw]
                letter[1:] |= (raw[:-1] == 0xC3) & _LATIN[raw[1:]]
                begins[1:-1] |= _MARK[raw[1:]] & letter[:-1]
        begins[at] = True
        begins[-1] = False
        cut = np.flatnonzero(begins)
        bounds = np.append(cut, len(raw)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = chunks.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.memo) + len(words) > MEMO_CHUNKS:
            self._forget_rare()
        found = list(map(self.memo.get, words))
        new = [k for k, slot in enumerate(found) if slot is None]
        for k in range(0, len(new), 4096):
            self._learn([words[i] for i in new[k : k + 4096]])
        for k in new:
            found[k] = self.memo[words[k]]
        known = np.array(found, np.int64)
        self.met[known] += 1
        slots = known.take(coded.indices.to_numpy(zero_copy_only=False)) if words else known
        counts = self.count[slots]
        upto = np.zeros(len(slots) + 1, np.int64)
        np.cumsum(counts, out=upto[1:])
        texts = np.arange(len(at))
        firsts = upto[np.searchsorted(cut, at)] + texts
        ids = np.full(upto[-1] + len(at) - 1, end, np.uint32)
        body = np.ones(len(ids), dtype=bool)
        body[firsts[1:] - 1] = False
        ids[body] = self.ids[np.repeat(self.first[slots] - upto[:-1], counts) + np.arange(upto[-1])]
        return ids, firsts
