"""Token ids of whole texts by a public word-level BPE, in numpy.

White space always ends a token, so the ids of a text are those of its words.
Words are looked up by their 128-bit hashes in a table of bounded size. A plain
new word (Latin letters, then ASCII punctuation) is merged together with all
others of its batch, by the tokenizer file's own merges; any other new word
goes through the ``tokenizers`` library.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .words import Words

SLOTS = 20
POOL = 1 << 22
# Kinds of bytes: ASCII letter 0, ASCII punctuation 1, lead byte of U+00C0 to U+00FF 2, its second byte 3, any other 4.
_KIND = np.full(256, 4, np.int8)
_KIND[65:91] = _KIND[97:123] = 0
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 1
_KIND[0xC3], _KIND[0x80:0xC0] = 2, 3


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class BatchMerger:
    """Byte pair merges for many words at once; the leftmost pair of the lowest rank goes first, as in any BPE."""

    def __init__(self, model: dict):
        vocab, suffix, letters = model["vocab"], model["end_of_word_suffix"] or "", _byte_letters()
        self.inner = np.asarray([vocab[c] for c in letters], np.int64)
        self.last = np.asarray([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.asarray([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, np.asarray([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def __call__(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (at least one byte each) in a row, and how many each has."""
        ends = np.cumsum(sizes) - 1
        ids = self.inner[data]
        ids[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(sizes)), sizes)
        # the rank of each symbol with the next one of its word
        rank = np.full(len(ids), self.none)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self._rank(ids[inside], ids[inside + 1])
        done_ids, done_words = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(ids)])
            done = least == self.none
            if done.any():
                live = np.repeat(~done, counts)
                done_ids.append(ids[~live])
                done_words.append(word[~live])
                ids, word, rank = ids[live], word[live], rank[live]
                counts, least = counts[~done], least[~done]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, counts))
            hits = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]
            ids[hits] = self.made[rank[hits]]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            moved = hits - np.arange(len(hits))
            ids, word, rank = ids[keep], word[keep], rank[keep]
            for at in (moved, moved - 1):
                at = at[(at >= 0) & (at < len(ids))]
                near = np.minimum(at + 1, len(ids) - 1)
                rank[at] = np.where((near > at) & (word[near] == word[at]), self._rank(ids[at], ids[near]), self.none)
        if not done_ids:
            return np.zeros(0, np.uint32), np.zeros(len(sizes), np.int64)
        words = np.concatenate(done_words)
        return np.concatenate(done_ids)[np.argsort(words, kind="stable")].astype(np.uint32), np.bincount(words, minlength=len(sizes))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class WordIds:
    """Ids of texts; ``path``: a tokenizers file, None for the public word BPE."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.tokenizer = Tokenizer.from_file(path)
        # the plain path stands for NFC, lower case and splitting at letters; others than this family go through the library
        self.merger = BatchMerger(model) if model.get("end_of_word_suffix") and self._library(["Plain-x"])[0].tolist() == self._library(["plain", "-", "X"])[0].tolist() else None
        self._clear()

    def _clear(self) -> None:
        n = 1 << SLOTS
        self.low, self.high, self.at, self.size = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for at in range(0, len(words), 20_000) for e in self.tokenizer.encode_batch_fast(words[at : at + 20_000], add_special_tokens=False)]
        return np.fromiter((i for ids in found for i in ids), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _tokenise(self, words: Words, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``new``, one word after the other, and how many each has."""
        start, size = words.start[new], words.size[new]
        plain, heads = np.zeros(len(new), bool), np.zeros(len(new), np.int64)
        if self.merger is not None:
            data = words.data[spread(start, size)]
            kind = _KIND[data]
            bad = (kind == 4) | (data == 0x97) | (data == 0xB7)
            # two-byte letters: the lead byte has its second, and no second stands alone
            second = kind == 3
            bad[1:] |= second[1:] != (kind[:-1] == 2)
            bad[:1] |= second[:1]
            mark = kind == 1
            bad[1:] |= mark[:-1] & ~mark[1:]
            begins = np.cumsum(size) - size
            # a word's own first byte follows nothing
            bad[begins] = (kind[begins] == 4) | second[begins] | mark[begins]
            plain = ~np.logical_or.reduceat(bad, begins)
            heads = np.add.reduceat(~mark, begins)
        counts = np.zeros(len(new), np.int64)
        parts, places = [], []
        own = np.flatnonzero(plain)
        if len(own):
            lower = data + np.where((data >= 65) & (data < 91), 32, 0).astype(np.uint8)
            lower[1:] += np.where((kind[:-1] == 2) & (data[1:] < 0x9F), 32, 0).astype(np.uint8)
            ids, n = self.merger(lower[spread(begins[own], heads[own])], heads[own])
            tails = own[size[own] > heads[own]]
            parts.append(ids)
            places.append(np.repeat(2 * own, n))
            counts[own] = n
            if len(tails):
                ids, n = self.merger(data[spread((begins + heads)[tails], (size - heads)[tails])], (size - heads)[tails])
                parts.append(ids)
                places.append(np.repeat(2 * tails + 1, n))
                counts[tails] += n
        rest = np.flatnonzero(~plain)
        if len(rest):
            ids, n = self._library([w.decode() for w in words.words(new[rest])])
            parts.append(ids)
            places.append(np.repeat(2 * rest, n))
            counts[rest] = n
        return np.concatenate(parts)[np.argsort(np.concatenate(places), kind="stable")], counts

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (and the end)."""
        if self.used > POOL:
            self._clear()
        low, high = words.hashes()
        slot = (low >> np.uint64(64 - SLOTS)).astype(np.int64)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        miss = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high))
        if len(miss):
            own = np.stack([low[miss], high[miss]], 1)
            _, first, back = np.unique(own[:, 0], return_index=True, return_inverse=True)
            if (own[first[back], 1] != own[:, 1]).any():
                _, first, back = np.unique(own, axis=0, return_index=True, return_inverse=True)
            new = miss[first]
            ids, counts = self._tokenise(words, new)
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            begin = self.used + np.cumsum(counts) - counts
            self.used += len(ids)
            at[miss], size[miss] = begin[back], counts[back]
            to = slot[new]
            self.low[to], self.high[to], self.at[to], self.size[to] = low[new], high[new], begin, counts
            # of new words that share a slot numpy keeps one, the same in every column
        return self.pool[spread(at, size)], np.concatenate([[0], np.cumsum(size)])[words.first]

    def documents(self, words: Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text, and where each text's begin (and the end)."""
        ids, first = self(words)
        out = np.full(len(ids) + words.n, end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(words.n), np.diff(first))] = ids
        return out, first + np.arange(words.n + 1)
