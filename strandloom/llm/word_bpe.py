"""Vectorised byte-pair encoding of letter words, many words at a time.

It reads a ``tokenizers`` file whose model is byte-level BPE with an end-of-word suffix, and
gives the ids that the library gives for words of lower-case letters in normal form.  Words
of one byte length stand in one matrix; each round merges in every word its lowest-ranked
pair, the leftmost of equals, and recomputes only the ranks beside it.  (A pair made by a
merge always ranks behind that merge, so this is the library's order.)
"""

from __future__ import annotations

import json

import numpy as np

#: Words of more bytes are left to the library.
LONGEST = 40
_NONE = np.int32(1 << 30)


def _byte_symbols() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 characters for
    themselves, the other bytes from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    @classmethod
    def load(cls, path: str) -> WordBpe | None:
        """The encoder of a file, or None if it is of another make."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, norm = spec["model"], spec.get("normalizer") or {}
        steps = [n.get("type") for n in norm.get("normalizers", [])]
        pre = [p.get("type") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        letters = any(r"[\p{L}]+" in p.get("pattern", {}).get("Regex", "") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []))
        ok = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
        return cls(model) if ok and steps == ["NFC", "Replace", "Lowercase"] and pre == ["Split", "ByteLevel"] and letters and len(model["vocab"]) < 1 << 16 else None

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        symbols = _byte_symbols()
        self.inner = np.asarray([vocab[s] for s in symbols], np.int32)
        self.last = np.asarray([vocab[s + end] for s in symbols], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.asarray([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.asarray([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        keys, ranks = keys[order], order.astype(np.int32)
        # an open-addressed table: a few probes settle every key
        self.mask = (1 << 18) - 1
        self.slot_key = np.full(self.mask + 1, -1, np.int64)
        self.slot_rank = np.full(self.mask + 1, _NONE, np.int32)
        at, left = self._place(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.slot_key[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[put], ranks[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64) & self.mask

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 16 | b
        at = self._place(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            found = self.slot_key[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def encode(self, buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place, count): the ids of the word at each span of bytes begin at its place."""
        place, count = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        order = np.argsort(size, kind="stable")
        flat, total, at = [], 0, 0
        ends = np.searchsorted(size[order], np.arange(int(size.max(initial=0)) + 1), "right")
        while at < len(order):
            n = int(size[order[at]])
            to = min(int(ends[n]), at + 20_000)
            some = order[at:to]
            ids, k = self._merge(buffer[start[some][:, None] + np.arange(n)])
            place[some] = total + n * np.arange(len(some))
            count[some] = k
            flat.append(ids.reshape(-1))
            total += ids.size
            at = to
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), place, count

    def _merge(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, n = raw.shape
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        count = np.full(m, n)
        if n == 1:
            return ids, count
        rank = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, n - 1)
        rows = np.arange(m)
        t, r = ids, rank
        column = np.arange(n)
        while True:
            best = r.argmin(axis=1)
            lowest = r[np.arange(len(r)), best]
            on = lowest < _NONE
            if not on.all():
                ids[rows[~on]] = t[~on]
                rows, t, r, best, lowest = rows[on], t[on], r[on], best[on], lowest[on]
            if not len(rows):
                return ids, count
            k = np.arange(len(rows))
            t[k, best] = self.made[lowest]
            # close the gap behind the merged pair
            source = np.minimum(column + (column > best[:, None]), n - 1)
            t = np.take_along_axis(t, source, axis=1)
            r = np.take_along_axis(r, np.minimum(source[:, :-1], n - 2), axis=1)
            count[rows] -= 1
            live = count[rows]
            r[k, np.minimum(live - 1, n - 2)] = _NONE
            left = best > 0
            r[k[left], best[left] - 1] = self._rank(t[k[left], best[left] - 1], t[k[left], best[left]])
            right = best < live - 1
            r[k[right], best[right]] = self._rank(t[k[right], best[right]], t[k[right], best[right] + 1])
