"""Token ids of many texts at once: words are hashed and looked up in numpy, and only new ones reach the library.

Words end at ASCII white space, where the files that are supported always cut.  Where a blank belongs to the word after
it, a word's key also says what stands before it: nothing, a blank or a line feed; texts with any other white space, or
with more than one such character running, are left to tokens.Encoder whole.

The ids of known words lie one after another in one array; keys are 64-bit hashes in order, and each is checked by a second
such hash, of other steps.  A word costs some 40 bytes.
"""

from __future__ import annotations

import functools

import numpy as np

from kindred.llm.common import mix, word_bounds, word_hashes

_U = np.uint64


class Store:
    """Keys in order, each with a slice of ids."""

    def __init__(self):
        self.keys, self.checks, self.begin, self.size = np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.used = np.zeros(0, bool)
        self.ids = np.zeros(0, "<u4")

    def find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys, and which of them are there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = (self.keys[at] == keys) & (self.checks[at] == checks)
        self.used[at[found]] = True
        return at, found

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries, one after another, and their numbers."""
        size = self.size[at].astype(np.int64)
        base = np.cumsum(size) - size
        return self.ids[np.repeat(self.begin[at] - base, size) + np.arange(size.sum())], size

    def merge(self, keys: np.ndarray, checks: np.ndarray, size: np.ndarray, ids: np.ndarray, keep: np.ndarray | None = None) -> None:
        """Adds entries with new keys; of its own only those in keep."""
        if keep is not None:
            at = np.flatnonzero(keep)
            self.ids, own = self.take(at)
            self.keys, self.checks, self.size, self.begin = self.keys[at], self.checks[at], self.size[at], np.cumsum(own) - own
        begin = np.cumsum(size) - size + len(self.ids)
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every)
        self.keys = every[order]
        self.checks = np.concatenate([self.checks, checks])[order]
        self.begin = np.concatenate([self.begin, begin])[order]
        self.size = np.concatenate([self.size, size.astype(np.int32)])[order]
        self.ids = np.concatenate([self.ids, ids])
        self.used = np.zeros(len(order), bool)


class Bulk:
    def __init__(self, path: str, spaced: bool, keep: int):
        from kindred.llm.tokens import Encoder

        self.whole, self.spaced, self.keep = Encoder(path, spaced, 20_000), spaced, keep
        self.known, self.recent = Store(), Store()

    def _odd(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts have white space other than lone blanks and line feeds between other characters."""
        odd = np.zeros(len(offsets) - 1, bool)
        if not self.spaced or not len(raw):
            return odd
        plain = (raw == 32) | (raw == 10)
        at = [np.flatnonzero(((raw >= 9) & (raw <= 13) & (raw != 10)) | ((raw >= 28) & (raw <= 31))), np.flatnonzero(plain[1:] & plain[:-1])]
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        odd[full] = plain[offsets[full]] | plain[offsets[full + 1] - 1]
        lead = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
        if len(lead):
            a = raw[lead]
            b, c = (raw[np.minimum(lead + k, len(raw) - 1)] for k in (1, 2))
            space = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
            space |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
            space |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
            space |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
            at.append(lead[space])
        odd[np.searchsorted(offsets, np.concatenate(at), "right") - 1] = True
        return odd

    def _learn(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray, kind: np.ndarray) -> list[bytes]:
        data = raw.tobytes()
        parts = [data[a:b].decode() for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        if not self.spaced:
            new = self.whole._learn({}, list(set(parts)), "")
            return [new[x] for x in parts]
        after = kind == 1
        blank = self.whole._learn({}, list({x for x, k in zip(parts, after.tolist(), strict=True) if k}), " ")
        bare = self.whole._learn({}, list({x for x, k in zip(parts, after.tolist(), strict=True) if not k}), "")
        return [(blank[x] if k == 1 else bare[x] if k == 0 else self.whole.line + bare[x]) for x, k in zip(parts, kind.tolist(), strict=True)]

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text."""
        n = len(offsets) - 1
        odd = self._odd(raw, offsets)
        start, stop = word_bounds(raw, offsets[1:])
        row = np.searchsorted(offsets, start, "right") - 1
        if odd.any():
            mine = ~odd[row]
            start, stop, row = start[mine], stop[mine], row[mine]
        key, kind = word_hashes(raw, start, stop), np.zeros(len(start), np.int8)
        if self.spaced:
            inner = start > offsets[row]
            kind[inner] = np.where(raw[start[inner] - 1] == 32, 1, 2)
            key = mix(key + kind.astype(_U) * _U(0xD1342543DE82EF95))
        unique, first, back = np.unique(key, return_index=True, return_inverse=True)
        check = word_hashes(raw, start[first], stop[first], seed=1) ^ kind[first].astype(_U)
        size, begin = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        pieces, base = [], 0
        left = np.arange(len(unique))
        for store in (self.known, self.recent):
            at, found = store.find(unique[left], check[left])
            ids, sizes = store.take(at[found])
            size[left[found]], begin[left[found]] = sizes, np.cumsum(sizes) - sizes + base
            pieces.append(ids)
            base += len(ids)
            left = left[~found]
        if len(left):
            f = first[left]
            new = self._learn(raw, start[f], stop[f], kind[f])
            sizes = np.fromiter(map(len, new), np.int64, len(new)) // 4
            ids = np.frombuffer(b"".join(new), "<u4")
            size[left], begin[left] = sizes, np.cumsum(sizes) - sizes + base
            pieces.append(ids)
            if len(self.recent.keys) > self.keep // 4:  # what was asked for again is kept, the rest forgotten
                again = np.flatnonzero(self.recent.used)
                ids_, sizes_ = self.recent.take(again)
                self.known.merge(self.recent.keys[again], self.recent.checks[again], sizes_, ids_, self.known.used if len(self.known.keys) > self.keep else None)
                self.recent = Store()
            self.recent.merge(unique[left], check[left], sizes, ids)
        every = np.concatenate(pieces)
        words = size[back]
        before = np.cumsum(words) - words
        flat = every[np.repeat(begin[back] - before, words) + np.arange(words.sum())]
        edge = np.concatenate([[0], np.cumsum(np.bincount(row, words, n).astype(np.int64))])
        out = [flat[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        if odd.any():
            which = np.flatnonzero(odd).tolist()
            data = raw.tobytes()
            for i, ids in zip(which, self.whole([data[offsets[i] : offsets[i + 1]].decode() for i in which]), strict=True):
                out[i] = ids
        return out


@functools.lru_cache(2)
def bulk(path: str, spaced: bool, keep: int) -> Bulk:
    """One in each Python worker; what it has learnt serves later tasks too."""
    return Bulk(path, spaced, keep)
