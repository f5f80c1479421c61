"""Encoding with given BPE vocabularies: a word-level cache over the tokenizers library, and numpy merge rounds.

Both split a text as the vocabulary's own pre-tokeniser does. Texts whose characters all lie below U+0100 (and
hold neither \\x1C-\\x1F nor the start of a special token) are split with a Latin-1 form of its pattern; others
take the general way, so the result is the library's for every text.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import regex

from .textnum import ragged

_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼½¾"
_COMPLEX = re.compile("[^\x00-\x1b\x20-\xff]|<\\|")
_WORD_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
_BYTE_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_BYTE_ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_ASCII_SPACE = re.compile("[ \t\n\r\f\v]+")


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Cache(dict):
    """Piece -> number of its entry; entries' ids lie one after another. Emptied between calls when large."""

    def __init__(self) -> None:
        self.ids, self.ends = array("I"), array("q", [0])

    def add(self, piece: str, ids) -> int:
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        self[piece] = at = len(self.ends) - 2
        return at

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all entries in order, and each entry's number of ids."""
        ends = np.array(self.ends, np.int64)
        n = (ends[1:] - ends[:-1])[entries] if len(ends) > 1 else np.zeros(0, np.int64)
        return np.array(self.ids, np.uint32)[ragged(ends[entries], n)], n


def _totals(n: np.ndarray, counts: list[int]) -> np.ndarray:
    """Sums of n over runs of the given lengths."""
    total = np.concatenate([[0], np.cumsum(n)])
    at = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    return total[at[1:]] - total[at[:-1]]


class WordBpe:
    """The tokenizers library's encode(text, add_special_tokens=False).ids for a lower-casing word-end vocabulary.

    Pieces are encoded by the library's own model and remembered; pieces of white-space-free runs with other
    characters or special tokens go through its whole pipeline. most: entries remembered at most.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.most = most
        chars = byte_chars()
        self.table = {c: "".join(chars[b] for b in chr(c).encode()) for c in range(256)}
        self.cache = self._fresh()

    def _fresh(self) -> _Cache:
        model, table, whole = self.whole.model, self.table, self.whole

        class Cache(_Cache):
            def __missing__(self, piece: str) -> int:
                if piece[0] == "\0" and len(piece) > 1 and _COMPLEX.search(piece):
                    return self.add(piece, whole.encode(piece[1:], add_special_tokens=False).ids)
                return self.add(piece, [t.id for t in model.tokenize(piece.translate(table))])

        return Cache()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids."""
        if len(self.cache) > self.most:
            self.cache = self._fresh()
        entries, counts = [], []
        get, find = self.cache.__getitem__, _WORD_LATIN.findall
        for text in texts:
            if _COMPLEX.search(text) is None:
                words = find(text.lower())
            else:
                words = []
                for run in _ASCII_SPACE.split(text):
                    if _COMPLEX.search(run):
                        words.append("\0" + run)
                    else:
                        words += find(run.lower())
            counts.append(len(words))
            entries.append(np.fromiter(map(get, words), np.int64, len(words)))
        ids, n = self.cache.gather(np.concatenate(entries) if entries else np.zeros(0, np.int64))
        return ids, _totals(n, counts)


class ByteBpe:
    """Byte-level BPE from a tokenizers file by batched merge rounds.

    The symbols of many words lie in one array. A round looks every neighbouring pair up in the sorted pair
    keys, finds each word's lowest rank, merges all its occurrences from the left, and sets finished words aside.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        chars = byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.byte_ids = np.array([vocab[c] for c in chars], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        back = {c: b for b, c in enumerate(chars)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for t, i in vocab.items():
            if t not in self.special:
                tokens[i] = bytes(back[c] for c in t)
        for t, i in self.special.items():
            tokens[i] = t.encode()
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.most, self.cache = most, _Cache()

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and each word's number of ids. No word is empty."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), counts)
        far = np.int64(1) << 40
        done = []
        while len(symbols):
            key = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), far)
            rank[:-1] = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], far)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbols))))
            going = least < far
            if not going.all():
                done.append((owner[~going], symbols[~going]))
            here = np.flatnonzero((rank == least) & going)
            if not len(here):
                break
            start = np.concatenate([[True], here[1:] != here[:-1] + 1])  # runs of one pair of equal symbols: every other one
            here = here[(here - here[start][np.cumsum(start) - 1]) % 2 == 0]
            symbols[here] = self.made[at[here]]
            going[here + 1] = False
            symbols, owner = symbols[going], owner[going]
        if not done:
            return np.zeros(0, np.uint32), counts
        owner, symbols = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(owner, minlength=len(words))

    def _words(self, text: str) -> list[str]:
        if _COMPLEX.search(text) is None:
            return _BYTE_LATIN.findall(text)
        out, at = [], 0
        for m in self.split.finditer(text) if self.split else ():
            out += _BYTE_ANY.findall(text[at : m.start()])
            out.append("\0" + m[0])  # no word of the pattern holds a special token after another character
            at = m.end()
        return out + _BYTE_ANY.findall(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids."""
        if len(self.cache) > self.most:
            self.cache = _Cache()
        split = [self._words(t) for t in texts]
        counts = [len(w) for w in split]
        new = list({w for words in split for w in words if w not in self.cache})
        plain = []
        for w in new:
            if w[0] == "\0" and w[1:] in self.special:
                self.cache.add(w, [self.special[w[1:]]])
            else:
                plain.append(w)
        if plain:
            ids, n = self.merge([w.encode() for w in plain])
            base, first = len(self.cache.ids), len(self.cache.ends) - 1
            self.cache.ids.frombytes(ids.tobytes())
            self.cache.ends.frombytes((base + np.cumsum(n)).astype(np.int64).tobytes())
            self.cache.update(zip(plain, range(first, first + len(plain))))
        get = self.cache.__getitem__
        ids, n = self.cache.gather(np.fromiter((get(w) for words in split for w in words), np.int64, sum(counts)))
        return ids, _totals(n, counts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of the decoded text of each run of ids; invalid bytes become U+FFFD."""
        n = self.token_len[ids]
        data = self.token_bytes[ragged(self.token_at[ids], n)].tobytes()
        ends = np.concatenate([[0], np.cumsum(_totals(n, counts.tolist()))]).tolist()
        return [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends, ends[1:])]
