"""Token ids of whole texts by the tokenizers library, with words remembered."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from .wordhash import HashIndex, ascii_lower, flat_utf8, ragged, span_hashes, word_spans

# Fixed: the pre-tokenizer pattern and the normalizers that this fast path knows.
_KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_KNOWN_NORMS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes
_PLAIN = regex.compile(r"[\x21-\x7e¡-¬®-įı-ſ]+")
# 1: ASCII letters; 2: ASCII punctuation but the apostrophe; so neighbours that may be cut add up to 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2
_KIND[0x80:] = 8


class TextEncoder:
    """Encodes whole texts to ids, as ``Tokenizer.encode(add_special_tokens=False)`` does.

    The known tokenizer never joins characters over white space, nor an ASCII
    letter with ASCII punctuation other than the apostrophe.  So a text is cut
    there, and the ids of each cut word are looked up by its hash, and its bytes
    compared with those of the word found; only unseen words are merged.  The memory is emptied when it holds ``keep`` words.  Any
    other tokenizer file, and any text that holds a special token's first two
    characters, goes through the library whole, and so does any word outside
    the plain letters this holds for.
    """

    def __init__(self, tokenizer_json: str, keep: int = 600_000):
        self.whole = Tokenizer.from_str(tokenizer_json)
        self.whole.no_padding()
        self.whole.no_truncation()
        spec = json.loads(tokenizer_json)
        kinds = [s.get("pattern", {}).get("Regex") for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.fast = kinds == [_KNOWN_SPLIT, None] and (spec.get("normalizer") or {}).get("normalizers") == _KNOWN_NORMS
        self.special = [t["content"][:2].encode() for t in spec.get("added_tokens", [])]
        self.split = regex.compile(_KNOWN_SPLIT).findall
        self.byte_char = _byte_chars()
        self.tokenize = self.whole.model.tokenize
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.index = HashIndex()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.text, self.text_at, self.text_size = np.zeros(1 << 18, np.uint8), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = self.text_used = 0

    def encode_column(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text d, followed by ``end_id``, has ``ids[offsets[d]:offsets[d + 1]]``; null reads as empty."""
        raw, offsets = flat_utf8(column)
        n = len(offsets) - 1
        odd = {d for d in range(n) if self._odd(raw[offsets[d] : offsets[d + 1]].tobytes())} if n and self._odd(raw.tobytes()) else set()
        if odd:
            parts = []
            for d in range(n):
                text = raw[offsets[d] : offsets[d + 1]].tobytes()
                parts.append(np.array([*self.whole.encode(text.decode(), add_special_tokens=False).ids, end_id], np.uint32) if d in odd else self.encode_column(pa.array([text], pa.binary()), end_id)[0])
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        first, start, length = self._places(raw, offsets)
        length = np.insert(length, first[1:], 1)
        start = np.insert(start, first[1:], 0)
        self.ids[0] = end_id  # the place that texts' ends are read from
        out = self.ids[ragged(start, length)]
        upto = np.concatenate([[0], np.cumsum(length)])
        return out, upto[first + np.arange(n + 1)]

    def _odd(self, text: bytes) -> bool:
        return not self.fast or any(s in text for s in self.special)

    def _places(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word of each text, where each word's ids begin, how many they are)."""
        if self.index.n > self.keep:
            self._forget()
        if not self.used:
            self.used = 1
        low = ascii_lower(raw)
        kind = _KIND[low]
        cuts = np.flatnonzero(kind[:-1] + kind[1:] == 3) + 1 if len(low) else None
        starts, ends, first = word_spans(low, offsets, cuts)
        h = self.hashes(low, starts, ends)
        word = self.index.find(h)
        missing = np.flatnonzero(word < 0)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            self._learn(new, self._texts(low, starts[missing[at]], ends[missing[at]]))
            word[missing] = self.index.find(h[missing])
        start, length = self.start[word], self.length[word]
        for k in self._unlike(low, starts, ends, word).tolist():  # a word that another of the same hash stands for
            ids = self._word(low[starts[k] : ends[k]].tobytes().decode())
            start[k], length[k] = self._put(np.array(ids, np.uint32)), len(ids)
        return first, start, length

    hashes = staticmethod(span_hashes)

    @staticmethod
    def _texts(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        text = low.tobytes()
        return [text[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _unlike(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Words whose bytes aren't those of the known word of their hash, compared eight at a time."""
        size = ends - starts
        bad = size != self.text_size[word]
        padded = np.concatenate([low, np.zeros(8, np.uint8)])
        eight = lambda x: np.lib.stride_tricks.as_strided(x[:8].view(np.uint64), (len(x) - 7,), (1,))
        here, known = eight(padded), eight(self.text)
        rows, k = np.flatnonzero(~bad), 0
        while len(rows):
            mask = _LOW_BYTES[np.minimum(size[rows] - k, 8)]
            bad[rows] = (here[starts[rows] + k] & mask) != (known[self.text_at[word[rows]] + k] & mask)
            k += 8
            rows = rows[(size[rows] > k) & ~bad[rows]]
        return np.flatnonzero(bad)

    def _put(self, ids: np.ndarray) -> int:
        """Where these ids now lie."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _learn(self, new: np.ndarray, texts: list[bytes]) -> None:
        found = [self._word(t.decode()) for t in texts]
        n, length = self.index.n, np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(length.sum()))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        while n + len(new) > len(self.start):
            for name in ("start", "length", "text_at", "text_size"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(self.start)]))
        while self.text_used + int(size.sum()) + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.start[n : n + len(new)] = self._put(flat) + np.cumsum(length) - length
        self.length[n : n + len(new)] = length
        self.text[self.text_used : self.text_used + int(size.sum())] = np.frombuffer(b"".join(texts), np.uint8)
        self.text_at[n : n + len(new)] = self.text_used + np.cumsum(size) - size
        self.text_size[n : n + len(new)] = size
        self.text_used += int(size.sum())
        self.index.add(new)

    def _word(self, word: str) -> list[int]:
        if not _PLAIN.fullmatch(word):
            return self.whole.encode(word, add_special_tokens=False).ids
        if word.isascii() and word.isalpha():
            return [t.id for t in self.tokenize(word)]
        return [t.id for piece in self.split(word.lower()) for t in self.tokenize(piece if piece.isascii() else "".join(map(self.byte_char.__getitem__, piece.encode())))]


def _byte_chars() -> list[str]:
    """The visible character that byte-level vocabularies write for each byte: printable Latin-1 as is, others from U+0100 on."""
    shown = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


_ENCODERS: dict[int, TextEncoder] = {}


def encoder_for(tokenizer_json: str) -> TextEncoder:
    """The encoder of a tokenizer file's content; a Python worker keeps the last one over its tasks."""
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(tokenizer_json)
    return _ENCODERS[key]


def tokenizer_text(path: str) -> str:
    """The content of a tokenizer file, read once on the driver and sent to the tasks (a few MB, fixed by the vocabulary)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
