"""Ids of whole texts from a vocabulary whose pieces never cross white space and ignore case.

Words between ASCII white space are found and hashed as arrays, and looked up
in an open-addressed table of arrays that the library fills, so each distinct
word is encoded about once per worker. The ids of a text are those of its
words, one after another. Texts that hold a special string of the vocabulary
go to the library as they are. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from .common import Words, ragged

#: Words that a worker remembers; beyond, those it has met only once are forgotten, or all.
REMEMBERED = 440_000


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for ``n`` values, doubled as needed."""
    if len(x) >= n:
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


#: Words that need no normalisation but lower case: printable ASCII without apostrophes and bars, and composed Latin letters.
_SIMPLE = re.compile("[!-&(-{}~À-ÖØ-öø-ÿ]+").fullmatch
#: Kinds of bytes of such words, spaces between them included: digits stand alone, letters and other characters make runs.
_SPACE_KIND, _DIGIT, _LETTER, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x20], _KIND[ord("0") : ord("9") + 1], _KIND[ord("a") : ord("z") + 1], _KIND[0x80:] = _SPACE_KIND, _DIGIT, _LETTER, _LETTER
#: The characters that stand for bytes: those that print as themselves, the others in order from 256 on; spaces stay.
_CHARACTER = np.arange(256, dtype="<u4")
_UNPRINTED = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
_CHARACTER[_UNPRINTED] = 256 + np.arange(len(_UNPRINTED))
_CHARACTER[0x20] = 0x20


class _Pieces:
    """The library's merges alone, for words already cut into pieces: what it normalises and cuts itself costs more than merging does."""

    def __init__(self, config: dict):
        from tokenizers import Tokenizer

        suffix = config["model"]["end_of_word_suffix"]
        self.library = Tokenizer.from_str(json.dumps(config | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
        vocabulary = config["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    @classmethod
    def of(cls, path: str) -> _Pieces | None:
        """For files that lower-case, cut runs of letters, single digits and runs of others, and mark word ends; None for others."""
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        kinds = lambda part, many: [x["type"] for x in (config.get(part) or {}).get(many, [])]
        cut = next((x["pattern"].get("Regex", "") for x in (config.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"), "")
        known = kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"] and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]
        known = known and cut == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and config["model"].get("end_of_word_suffix")
        return cls(config) if known else None

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        data = np.frombuffer(" ".join(words).lower().encode(), np.uint8)
        kind = _KIND[data]
        cut = np.flatnonzero((kind[1:] != _SPACE_KIND) & (kind[:-1] != _SPACE_KIND) & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))) + 1
        pieces = np.diff(np.concatenate([[0], np.searchsorted(cut, np.flatnonzero(kind == _SPACE_KIND)), [len(cut)]])) + 1
        plain = np.insert(_CHARACTER[data], cut, 0x20).tobytes().decode("utf-32-le")
        ids = np.array(self.library.encode_batch_fast([plain], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        return ids, np.diff(np.concatenate([[0], ends[np.cumsum(pieces) - 1]]))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = self.library.get_added_tokens_decoder()
        self.special = [t.content for t in special.values()]
        self.mark, self.mark_id = next(((t.content, i) for i, t in special.items() if t.special), ("", -1))
        self.pieces = _Pieces.of(path)
        self.words, self.ids = 0, 0
        self.hash, self.start, self.length, self.met = (np.zeros(1 << 16, t) for t in (np.uint64, np.int64, np.int32, np.int32))
        self.flat = np.zeros(1 << 18, np.uint32)
        self.rehash(1 << 18)

    def rehash(self, size: int) -> None:
        self.slots = np.full(size, -1, np.int32)
        self.place(np.arange(self.words))

    def place(self, numbers: np.ndarray) -> None:
        """Enter words, whose hashes are distinct and new, into the table."""
        mask = len(self.slots) - 1
        at = (self.hash[numbers] >> np.uint64(20)).astype(np.int64) & mask
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            won = self.slots[at] == numbers  # of several for one place, one has it
            numbers, at = numbers[~won], (at[~won] + 1) & mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each word, or -1."""
        mask = len(self.slots) - 1
        at = (h >> np.uint64(20)).astype(np.int64) & mask
        out = self.slots[at]
        other = np.flatnonzero((out >= 0) & (self.hash[out] != h))
        at = at[other]
        while len(other):
            at = (at + 1) & mask
            found = self.slots[at]
            out[other] = found
            on = (found >= 0) & (self.hash[found] != h[other])
            other, at = other[on], at[on]
        return out

    def forget(self) -> None:
        keep = np.flatnonzero(self.met[: self.words] > 1)
        if len(keep) > REMEMBERED // 2:
            keep = keep[:0]
        flat = self.flat[ragged(self.start[keep], self.length[keep])]
        self.words, self.ids = len(keep), len(flat)
        self.hash[: len(keep)], self.length[: len(keep)] = self.hash[keep], self.length[keep]
        self.start[: len(keep)] = np.cumsum(self.length[: len(keep)]) - self.length[: len(keep)]
        self.met[: len(keep)], self.flat[: len(flat)] = 0, flat
        self.rehash(len(self.slots))

    def learn(self, words: list[str], hashes: np.ndarray) -> None:
        """Encode new words: simple ones as pieces, others by the library, many in one call with a special token between them."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        simple = np.array([_SIMPLE(w) is not None for w in words], bool) if self.pieces else np.zeros(len(words), bool)
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        hashes, words = hashes[order], [words[i] for i in order.tolist()]
        n = int(simple.sum())
        for i in range(0, n, 4096):
            found, length = self.pieces.encode(words[i : min(i + 4096, n)])
            ids.append(found)
            lengths.append(length)
        for i in range(n, len(words), 4096):
            part = words[i : i + 4096]
            if self.mark:
                found = np.array(self.library.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, np.uint32)
                cut = np.flatnonzero(found == self.mark_id)
                lengths.append(np.diff(np.concatenate([[-1], cut, [len(found)]])) - 1)
                ids.append(np.delete(found, cut))
            else:
                own = [e.ids for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
                lengths.append(np.fromiter(map(len, own), np.int64, len(own)))
                ids.append(np.array([x for e in own for x in e], np.uint32))
        flat, length = np.concatenate(ids), np.concatenate(lengths)
        a, b, c, d = self.words, self.words + len(words), self.ids, self.ids + len(flat)
        self.hash, self.start, self.length, self.met = (_room(x, b) for x in (self.hash, self.start, self.length, self.met))
        self.flat = _room(self.flat, d)
        self.hash[a:b], self.start[a:b], self.length[a:b], self.met[a:b] = hashes, c + np.cumsum(length) - length, length, 0
        self.flat[c:d] = flat
        self.words, self.ids = b, d
        if 2 * b > len(self.slots):
            self.rehash(2 * len(self.slots))
        else:
            self.place(np.arange(a, b))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has; a null text has none."""
        if self.words > REMEMBERED:
            self.forget()
        words = Words(texts)
        raw = words.data.tobytes()
        if any(s.encode() in raw for s in self.special):
            return self.mixed(texts)
        number = self.find(words.hash)
        new = np.flatnonzero(number < 0)
        if len(new):
            hashes, first = np.unique(words.hash[new], return_index=True)
            at = new[first]
            self.learn([raw[s:e].decode() for s, e in zip(words.start[at].tolist(), words.end[at].tolist())], hashes)
            number[new] = self.find(words.hash[new])
        counted = np.bincount(number, minlength=self.words) if len(number) else 0
        self.met[: self.words] += counted
        lengths = self.length[number].astype(np.int64)
        ids = self.flat[ragged(self.start[number], lengths)]
        edge = np.concatenate([[0], np.cumsum(lengths)])[words.first]
        return ids, np.diff(edge)

    def mixed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, text by text where a special string occurs."""
        out, lengths = [np.zeros(0, np.uint32)], []
        for text in texts.to_pylist():
            if text and any(s in text for s in self.special):
                ids = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                ids, _ = self.encode(pa.array([text], pa.string()))
            out.append(ids)
            lengths.append(len(ids))
        return np.concatenate(out), np.array(lengths, np.int64)


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after the ids of each text."""
    return np.insert(ids, np.cumsum(lengths), end_id).astype(np.uint32), lengths + 1
