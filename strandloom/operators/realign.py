"""Base alignment quality: how sure each base's place is, by a probabilistic alignment.

A read and its stretch of the reference go through a banded hidden Markov model with match,
insertion and deletion states that begins and ends anywhere on the reference.  The posterior
of each base's best state gives its alignment quality, which caps the base quality.  Reads of
one band are aligned together, whatever their lengths: a step of the model is a numpy operation
over all of them and the band.  Reads that are equal in bases, qualities and runs on an equal
window are aligned once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import UNMAPPED

# Fixed values of the model: probabilities of opening and extending a gap, of a base in an
# insertion, share of a base error, least band; and ten over the logarithm of ten.
GAP_OPEN, GAP_EXTEND, INSERTED, ERROR, BAND, PHRED = 0.001, 0.1, 0.25, 0.33333333333, 7, 4.343
#: What stands for no change in the tags.
SAME = 64
#: Bases of reads whose results are kept for equal ones, and cells (read, base, place) that are
#: aligned together (one read may have more).
KNOWN_BASES, STATE_CELLS = 2_000_000, 1 << 20
_CODE = np.full(256, 4, np.int8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
_PART = re.compile(r"(\d+)([MIDNSHP=X])")


def align(reference: np.ndarray, query: np.ndarray, quality: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, inserted, quality) of each base of reads (n, Q) on references (n, L), as codes 0 to
    3 and 4 for any: the place of its best state, whether that is an insertion, and the phred
    quality of the choice."""
    found = align_mixed(list(reference), list(query), list(quality), _reach(reference.shape[1], query.shape[1], band))
    return tuple(np.stack([x[k] for x in found]) for k in range(3))


def _reach(size: int, length: int, band: int) -> int:
    """The band of a read of ``length`` on ``size`` bases."""
    return max(min(max(size, length), band), abs(size - length))


def align_mixed(reference: list[np.ndarray], query: list[np.ndarray], quality: list[np.ndarray], band: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``align`` for reads of any lengths that share a band, the longest reads first.

    Arrays are (band, reads): at row i the reads that still have a base are a prefix of the
    columns, and the reference under the band is a slice of the padded references.
    """
    n, width = len(query), 2 * band + 1
    lengths = np.asarray([len(x) for x in query])
    sizes = np.asarray([len(x) for x in reference])
    most = int(lengths[0])
    outside = 5  # the code of places before and behind a reference
    under = np.full((max(most, int(sizes.max())) + 2 * band + 2, n), outside, np.int8)
    bases, right_odds, wrong_odds = np.full((most, n), 4, np.int8), np.ones((most, n)), np.ones((most, n))
    for c in range(n):
        under[band + 1 : band + 1 + sizes[c], c] = reference[c]
        bases[: lengths[c], c] = query[c]
        wrong = 10.0 ** (-quality[c] / 10.0)
        known = query[c] <= 3
        right_odds[: lengths[c], c] = np.where(known, 1 - wrong, 1.0)
        wrong_odds[: lengths[c], c] = np.where(known, wrong * ERROR, 1.0)
    inside = (under != outside).astype(np.float64)
    live = [int((lengths >= i).sum()) for i in range(most + 2)]  # reads with a base i (from 1)
    end = 1.0 / (2 * lengths + 2)
    stay = 1 - end
    mm, mi = (1 - 2 * GAP_OPEN) * stay, GAP_OPEN * stay
    im, ii, dm, dd = (1 - GAP_EXTEND) * stay, GAP_EXTEND * stay, 1 - GAP_EXTEND, GAP_EXTEND

    forward = np.zeros((most + 1, 2, width, n))
    emitted = np.zeros((most + 2, width, n))
    scale = np.ones((most + 2, n))
    last = np.ones(n)
    m = ins = d = np.zeros((width, n))
    for i in range(1, most + 1):
        a = live[i]
        there, codes = inside[i : i + width, :a], under[i : i + width, :a]
        e = emitted[i, :, :a]
        e[:] = np.where(codes == bases[i - 1, :a], right_odds[i - 1, :a], wrong_odds[i - 1, :a])
        e[codes == 4] = 1.0
        e *= there
        row = np.empty((3, width, a))
        if i == 1:
            row[0] = e * (1 - GAP_OPEN) / sizes[:a]
            row[1] = there * (INSERTED * GAP_OPEN / sizes[:a])
            row[2] = 0.0
        else:
            m, ins, d = m[:, :a], ins[:, :a], d[:, :a]
            row[0] = e * (mm[:a] * m + im[:a] * ins + dm * d)
            row[1, :-1] = INSERTED * (mi[:a] * m[1:] + ii[:a] * ins[1:])
            row[1, -1] = 0.0
            row[1] *= there
            opened = mi[:a] * row[0]
            row[2, 0] = 0.0
            for j in range(1, width):
                row[2, j] = opened[j - 1] + dd * row[2, j - 1]
            row[2] *= there
        scale[i, :a] = row.sum(axis=(0, 1))
        row /= scale[i, :a]
        m, ins, d = row
        forward[i, :, :, :a] = row[:2]
        done = live[i + 1]
        last[done:a] = end[done:a] * row[:2, :, done:].sum(axis=(0, 1))

    state, top = np.zeros((most, n), np.int64), np.zeros((most, n))
    backward = np.zeros((2, width, n))
    for i in range(most, 0, -1):
        a, more = live[i], live[i + 1]
        there = inside[i : i + width, :a]
        new = np.empty((2, width, a))
        new[:, :, more:] = there[:, more:] * (end[more:a] / scale[i, more:a] / last[more:a])
        if more:
            # the next base one place on (the same band column), inserted here, or behind a gap
            ahead = emitted[i + 1, :, :more] * backward[0, :, :more]
            added = np.zeros((width, more))
            added[1:] = INSERTED * backward[1, :-1, :more]
            new[0, :, :more] = mm[:more] * ahead + mi[:more] * added
            if i > 1:
                gap = dm * ahead
                for j in range(width - 2, -1, -1):
                    gap[j] += dd * gap[j + 1]
                new[0, :-1, :more] += mi[:more] * gap[1:]
            new[1, :, :more] = im[:more] * ahead + ii[:more] * added
            new[:, :, :more] *= there[:, :more] / scale[i, :more]
        backward = new
        both = (forward[i, :, :, :a] * new).transpose(2, 1, 0).reshape(a, -1)  # by place, the match before the insertion
        best = both.argmax(axis=1)
        top[i - 1, :a] = both[np.arange(a), best] / both.sum(axis=1)
        state[i - 1, :a] = (i - band - 1 + best // 2) * 2 + best % 2
    with np.errstate(divide="ignore"):
        value = -PHRED * np.log(1 - top) + 0.499
    sure = np.where(value > 100, 99, np.minimum(value, 100)).astype(np.int64)
    return [(state[:q, c] >> 1, state[:q, c] & 1, sure[:q, c]) for c, q in enumerate(lengths)]


@dataclass
class _Read:
    """A read that is to be aligned: its runs, its window of the reference from ``lo`` on, and band."""

    pos: int
    runs: list[tuple[int, str]]
    reference: str
    seq: str
    qual: np.ndarray
    lo: int
    band: int


@lru_cache(1 << 14)
def _runs(cigar: str) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in _PART.findall(cigar)]


def _numbers(text: str, zero: int) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1"), np.uint8).astype(np.int64) - zero


def _text(values: np.ndarray, zero: int) -> str:
    return "".join(map(chr, (values + zero).tolist()))


def _together(reads: dict[tuple, _Read]) -> Iterator[list[tuple[tuple, _Read]]]:
    """The reads of one band, the longest first, so many at a time that their states stay small."""
    rows = sorted(reads.items(), key=lambda r: (r[1].band, -len(r[1].seq)))
    part = []
    for row in rows:
        cells = len(part[0][1].seq) * (2 * row[1].band + 1) * len(part) if part else 0
        if part and (row[1].band != part[0][1].band or len(part) >= 256 or cells > STATE_CELLS):
            yield part
            part = []
        part.append(row)
    if part:
        yield part


def window(pos: int, runs: list[tuple[int, str]], length: int) -> tuple[int, int, int] | None:
    """(lo, hi, band) of the reference that a read is aligned to; None if it is not."""
    x, y, first, last = pos, 0, None, None
    for n, op in runs:
        if op in "M=X":
            first = first or (x, y)
            x, y = x + n, y + n
            last = (x, y)
        elif op in "SI":
            y += n
        elif op == "D":
            x += n
        elif op == "N":
            return None
    if first is None:
        return None
    gap = abs((last[0] - first[0]) - (last[1] - first[1]))
    band = gap + 3 if gap > BAND else BAND
    lo = max(0, first[0] - first[1] - band // 2)
    hi = last[0] + length - last[1] + band // 2
    if hi - lo - length > band:
        lo += (hi - lo - length - band) // 2
        hi -= (hi - lo - length - band) // 2
    return lo, hi, band


def alignment_quality(read: _Read, place: np.ndarray, inserted: np.ndarray, sure: np.ndarray, extend: bool) -> np.ndarray:
    """What a read's base qualities lose: by the least of both qualities, or, extended, as far as
    the surest bases on both sides of a base in its aligned run do not speak for it."""
    out = np.zeros(len(read.qual), np.int64)
    x, y = read.pos, 0
    for n, op in read.runs:
        if op in "M=X":
            m = min(n, len(read.qual) - y)
            at = slice(y, y + m)
            as_aligned = (inserted[at] == 0) & (place[at] == x - read.lo + np.arange(m))
            value = np.where(as_aligned, sure[at], 0)
            if extend and m:
                value = np.minimum(np.maximum.accumulate(value), np.maximum.accumulate(value[::-1])[::-1])
            out[at] = np.maximum(read.qual[at] - value, 0)
            x, y = x + n, y + m
        elif op in "SI":
            y += n
        elif op == "D":
            x += n
    return out


def _tagged(aux: dict, length: int, redo: bool) -> tuple[dict, str | None]:
    """The tags without those that do not count, and which of BQ and ZQ stays."""
    aux = dict(aux)
    valid = lambda t: t[:2] == "Z:" and len(t) - 2 == length
    if "ZQ" in aux and not valid(aux["ZQ"]):
        raise ValueError("a ZQ tag is not as long as its read")
    if "BQ" in aux and redo:
        del aux["BQ"]
    if "BQ" in aux and "ZQ" in aux:
        del aux["ZQ"]
    if "BQ" in aux and not valid(aux["BQ"]):
        del aux["BQ"]
    return aux, next((t for t in ("BQ", "ZQ") if t in aux), None)


def base_alignment_quality(reads: DataFrame, apply: bool = False, extend: bool = False, redo: bool = False) -> DataFrame:
    """``reads`` (flag, pos, cigar, seq, qual, aux, and ``reference`` from 0-based
    ``reference_start`` on) with alignment qualities in the BQ tag, or, with ``apply``, taken off
    the qualities, which the ZQ tag can undo.

    Reads that have one of the tags already are turned into the wanted form; unmapped ones, those
    without bases, qualities or aligned runs and those with skips stay as they are.
    ``reference`` must hold the read's window (``with_reference`` sees to that) or end where the
    sequence does.
    """

    def run(batches):
        known: dict[tuple, tuple[str, str]] = {}  # tag and qualities of equal reads in equal windows
        held = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("flag", "pos", "cigar", "seq", "qual", "aux", "reference", "reference_start")]
            quals, tags = columns[4], [None if x is None else dict(x) for x in columns[5]]
            keys: dict[int, tuple] = {}
            todo: dict[tuple, _Read] = {}
            for i, (flag, pos, cigar, seq, text, _, reference, start) in enumerate(zip(*columns)):
                length = 0 if seq in (None, "*", "") else len(seq)
                if flag & UNMAPPED or not length or text in (None, "*"):
                    continue
                tags[i], tag = _tagged(tags[i] or {}, length, redo)
                if tag:
                    qual = _numbers(text, 33)
                    change = _numbers(tags[i][tag][2:], SAME)
                    if apply == (tag == "BQ"):
                        qual = np.maximum(qual - change, 0) if apply else qual + change
                        tags[i]["ZQ" if apply else "BQ"] = tags[i].pop(tag)
                        quals[i] = _text(qual, 33)
                    continue
                runs = _runs(cigar or "")
                shape = window(pos, runs, length)
                if shape is None or reference is None:
                    continue
                lo, hi, band = shape
                hi = min(hi, start + len(reference))
                if hi > lo >= start:
                    cut = reference[lo - start : hi - start]
                    key = keys[i] = (cut, seq, text, cigar, pos - lo)
                    if key not in known and key not in todo:
                        todo[key] = _Read(pos, runs, cut, seq, _numbers(text, 33), lo, _reach(hi - lo, length, band))
            settled = {k: known[k] for k in keys.values() if k in known}
            if held > KNOWN_BASES:
                known.clear()
                held = 0
            for part in _together(todo):
                codes = [[_CODE[np.frombuffer(t.encode("latin-1", "replace"), np.uint8)] for t in texts] for texts in ([x.reference for _, x in part], [x.seq for _, x in part])]
                found = align_mixed(codes[0], codes[1], [x.qual for _, x in part], part[0][1].band)
                for (key, x), (place, inserted, sure) in zip(part, found):
                    lost = alignment_quality(x, place, inserted, sure, extend)
                    known[key] = settled[key] = ("Z:" + _text(lost, SAME), _text(x.qual - lost, 33))
                    held += len(x.seq)
            for i, key in keys.items():
                tags[i]["ZQ" if apply else "BQ"], less = settled[key]
                if apply:
                    quals[i] = less
            made = {"qual": pa.array(quals, pa.string()), "aux": pa.array([None if x is None else list(x.items()) for x in tags], batch.schema.field("aux").type)}
            yield pa.RecordBatch.from_arrays([made[c].cast(batch.schema.field(c).type) if c in made else batch.column(c) for c in batch.schema.names], schema=batch.schema)

    return reads.mapInArrow(run, reads.schema)


def with_reference(reads: DataFrame, chunks: DataFrame) -> DataFrame:
    """``reads`` with the stretch of their sequence (``chunks`` of ``read_fasta``) that alignment
    may need, and where it begins."""
    from ..functions.alignment import reference_length
    from ..sources.sequences import fetch

    room = F.length("seq") + 2 * reference_length(F.col("cigar")) + 2 * BAND
    spans = reads.where(F.col("chr") != "*").select("ord", "chr", F.greatest(F.col("pos") - room, F.lit(0)).alias("beg"), (F.col("pos") + 2 * room).alias("end"))
    cut = fetch(chunks, spans).select(F.col("ord").alias("_ord"), F.col("seq").alias("reference"), F.col("beg").alias("reference_start"))
    return reads.join(cut, F.col("ord") == F.col("_ord"), "left").drop("_ord")
