"""URL rules in a sorted digest array.

Every rule (host, path) is keyed by the 64-bit xxhash of ``host + path``.  The keys are
sorted into one array beside offsets into a blob of the full rule strings; Python
workers memory-map the three files and probe them with a vectorised binary search, and
every hit is confirmed against the stored string, so that colliding digests do no harm.

A url is probed with each suffix of its host joined to each prefix of its path whose
length some rule has; the longest rule string that fits wins (ties: the longer host).
Urls that no rule fits get ``default`` (a listed-urls filter lets the rest pass).

Cases: a null url or one without ``://`` has an empty host and path, fits no rule and
gets the default; repeated rows are judged each; an empty table gives an empty table;
an empty rule list gives the default everywhere; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Size up to which an index is one set of files.  A larger rule list becomes several, which
#: are mapped and probed one after the other; only touched pages of a mapped file use memory.
MAX_INDEX_BYTES = 2 << 30

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url, both empty without ``://``."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    stop = len(rest)
    for c in "?#":
        at = rest.find(c)
        if 0 <= at < stop:
            stop = at
    slash = rest.find("/", 0, stop)
    if slash < 0:
        return rest[:stop].translate(_UPPER), ""
    return rest[:slash].translate(_UPPER), rest[slash:stop]


class DigestIndex:
    """Sorted 64-bit keys with their full strings, in three mappable files."""

    def __init__(self, folder: str, name: str):
        at = lambda part: os.path.join(folder, f"{name}.{part}.npy")
        self.keys = np.load(at("keys"), mmap_mode="r")
        self.offsets = np.load(at("offsets"), mmap_mode="r")
        self.blob = np.load(at("blob"), mmap_mode="r")
        self.values = np.load(at("values"), mmap_mode="r")
        self.hosts = np.load(at("hosts"), mmap_mode="r")
        self.path_lengths = np.load(at("lengths"))

    @staticmethod
    def build(rules: Iterable[tuple[str, str, str]], folder: str, name: str) -> list[str]:
        """Write the index of (host, path, verdict) rules; returns the files."""
        rows = sorted({(xxhash.xxh64_intdigest((h + p).encode()), h + p, len(h), v == "allow", len(p)) for h, p, v in rules})
        texts = [r[1].encode() for r in rows]
        parts = {
            "keys": np.asarray([r[0] for r in rows], np.uint64),
            "offsets": np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64),
            "blob": np.frombuffer(b"".join(texts) or b"\0", np.uint8),
            "values": np.asarray([r[3] for r in rows], np.uint8),
            "hosts": np.asarray([r[2] for r in rows], np.int64),
            "lengths": np.asarray(sorted({r[4] for r in rows}), np.int64),
        }
        files = []
        for part, array in parts.items():
            path = os.path.join(folder, f"{name}.{part}.npy")
            np.save(path, array)
            files.append(path)
        return files

    def lookup(self, digests: np.ndarray, texts: list[str], host_lengths: np.ndarray) -> np.ndarray:
        """Row of each text in the index, -1 where it is not a rule of that host."""
        n = len(self.keys)
        found = np.full(len(texts), -1, np.int64)
        if not n or not len(texts):
            return found
        at = np.searchsorted(self.keys, digests)
        live = np.flatnonzero(self.keys[np.minimum(at, n - 1)] == digests)
        for i in live:
            j = int(at[i])
            raw = texts[i].encode()
            while j < n and self.keys[j] == digests[i]:  # equal digests lie side by side
                if self.hosts[j] == host_lengths[i] and self.blob[self.offsets[j] : self.offsets[j + 1]].tobytes() == raw:
                    found[i] = j
                    break
                j += 1
        return found


_open: dict[str, DigestIndex] = {}


def judge(urls: list[str | None], indexes: list[DigestIndex], default: str) -> list[tuple[str, str, str | None, str]]:
    """(host, path, rule, verdict) of each url."""
    split = [split_url(u) for u in urls]
    best: dict[int, tuple[int, int, str, str]] = {}
    for index in indexes:
        owner, texts, hosts = [], [], []
        lengths = index.path_lengths.tolist()
        for i, (host, path) in enumerate(split):
            paths = [path[:k] for k in lengths if k <= len(path)] if host or path else []
            suffix = host
            while paths:
                for p in paths:
                    owner.append(i)
                    texts.append(suffix + p)
                    hosts.append(len(suffix))
                dot = suffix.find(".")
                if dot < 0:
                    break
                suffix = suffix[dot + 1 :]
        digests = np.fromiter((xxhash.xxh64_intdigest(t.encode()) for t in texts), np.uint64, len(texts))
        row = index.lookup(digests, texts, np.asarray(hosts, np.int64))
        for k in np.flatnonzero(row >= 0):
            i, text = owner[k], texts[k]
            rank = (len(text), hosts[k])
            if i not in best or rank > best[i][:2]:
                best[i] = (*rank, text, "allow" if index.values[row[k]] else "block")
    return [(h, p, best[i][2], best[i][3]) if i in best else (h, p, None, default) for i, (h, p) in enumerate(split)]


def _parts(rules: list[tuple[str, str, str]], limit: int) -> list[list[tuple[str, str, str]]]:
    """The rules in runs of at most ``limit`` bytes of index."""
    out, size = [[]], 0
    for h, p, v in sorted(rules):
        own = len(h.encode()) + len(p.encode()) + 33
        if out[-1] and size + own > limit:
            out.append([])
            size = 0
        out[-1].append((h, p, v))
        size += own
    return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", key: str = "page_id", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """key, host, path, rule, verdict of every row's ``url``.  A map: nothing is shuffled."""
    sc = pages.sparkSession.sparkContext
    names = []
    for part in _parts(rules, max_index_bytes):
        names.append("urls" + xxhash.xxh3_128_hexdigest(repr(part).encode()))
        if not any(f"/{names[-1]}." in f for f in sc.listFiles):
            for path in DigestIndex.build(part, tempfile.mkdtemp(prefix="strandloom-index-"), names[-1]):
                sc.addFile(path)  # Spark serves it to every executor

    def run(batches):
        for name in names:
            if name not in _open:
                _open[name] = DigestIndex(SparkFiles.getRootDirectory(), name)
        indexes = [_open[name] for name in names]
        for batch in batches:
            rows = judge(batch.column(1).to_pylist(), indexes, default)
            cols = [pa.array([r[k] for r in rows], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[key, "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "url").mapInArrow(run, f"{key} {kind}, host string, path string, rule string, verdict string")
