"""Best-two-fit packing of token pieces into fixed-length sequences.

Packing depends on piece lengths only, so the plan is made on the histogram of
lengths (at most ``capacity`` rows whatever the corpus size) and is itself run-length
coded: "this pattern of lengths, m times over".  Pieces then find their place by
(length, rank within length); ranks come from two-level counting, so no length, however
frequent, is gathered in one task.

Best-two-fit: a bin is filled greedily, largest piece first; if a gap is left, its
smallest piece is taken out and the two unpacked pieces that fit the widened gap most
tightly take its place, when they fill more than it did.  While every length that a
pattern uses is in stock often enough, the procedure repeats the same choice, so it is
applied in one run of as many bins.

Cases: a null text counts as empty and is one end token; an empty table packs to an
empty table; repeated rows are packed each on its own; texts of any length are
tokenized whole; other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import texthash
from ._shared import stored, tidy
from .texthash import joined as _joined
from .word_bpe import LONGEST, WordBpe

CAPACITY = 2048
END_ID = 0
#: Bytes of text whose distinct words are tokenized together.
CHUNK_BYTES = 48_000_000
#: Slices of a length whose counts are added up in one window.
STRETCH = 4096

_tokenizers: dict[str, tuple] = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = (Tokenizer.from_file(path), WordBpe.load(path))
    return _tokenizers[path]


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letters(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to ASCII or Latin-1 letters, and the bytes in lower case."""
    lead = buffer == 0xC3
    second = np.zeros(len(buffer), bool)
    second[1:] = lead[:-1] & (buffer[1:] >= 0x80) & (buffer[1:] <= 0xBF) & (buffer[1:] != 0x97) & (buffer[1:] != 0xB7)
    first = np.zeros(len(buffer), bool)
    first[:-1] = second[1:]
    upper = (buffer >= 65) & (buffer <= 90)
    small = buffer + np.where(upper | (second & (buffer <= 0x9E)), 32, 0).astype(np.uint8)
    return ((small >= 97) & (small <= 122) & (buffer < 128)) | first | second, small


def _distinct_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, place, count) of blank-free stretches of text.

    Letters, alone or with a final stop or comma, take the vectorised encoder (a final mark
    is a token of its own); all other stretches go to the library.
    """
    tok, letters = _tokenizer(path)
    size = end - start
    raw = data[_joined(start, size)]
    stop = np.cumsum(size)
    begin = stop - size
    good, small = _letters(raw)
    count = np.concatenate([[0], np.cumsum(good)])
    n_letters = count[stop] - count[begin]
    last = raw[stop - 1] if len(stop) else raw[:0]
    marked = (n_letters == size - 1) & ((last == 46) | (last == 44)) & ~good[stop - 1]
    stem = size - marked
    easy = (n_letters == stem) & (stem > 0) & (stem <= LONGEST) & (letters is not None)
    place, n_ids = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    flats, total = [], 0
    if easy.any():
        at, to = begin[easy], (begin + stem)[easy]
        first, inverse = texthash.exact_groups(texthash.span_hashes(small, at, to), at, to, small)
        ids, where, k = letters.encode(small, at[first], (to - at)[first])
        marks = {c: tok.encode(chr(c), add_special_tokens=False).ids for c in (44, 46)}
        k, where = k[inverse], where[inverse]
        more = marked[easy].astype(np.int64)
        own = k + more
        ends = np.cumsum(own)
        flat = np.zeros(int(ends[-1]), np.int64)
        flat[_joined(ends - own, k)] = ids[_joined(where, k)]
        tail = ends[more == 1] - 1
        flat[tail] = np.where(last[easy][more == 1] == 44, marks[44][0], marks[46][0])
        place[easy], n_ids[easy] = ends - own, own
        flats.append(flat)
        total = len(flat)
    hard = np.flatnonzero(~easy)
    for lo in range(0, len(hard), 50_000):
        some = hard[lo : lo + 50_000]
        texts = [raw[begin[i] : stop[i]].tobytes().decode("utf-8", "replace") for i in some]
        encoded = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        own = np.fromiter(map(len, encoded), np.int64, len(encoded))
        place[some], n_ids[some] = total + np.cumsum(own) - own, own
        flats.append(np.fromiter(itertools.chain.from_iterable(encoded), np.int64, int(own.sum())))
        total += int(own.sum())
    return np.concatenate(flats) if flats else np.zeros(0, np.int64), place, n_ids


def encode_rows(offsets: np.ndarray, data: np.ndarray, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids, ends): the tokenizer's ids of each row, slice by slice.

    The vocabulary's pre-tokenizer never joins across white space, and neither does its
    normaliser, so a text's ids are those of its stretches between blanks, in turn; case is
    folded by the normaliser, so stretches that differ in A-Z only are one.  Each distinct
    stretch of a chunk is tokenized once.  Slices with marks of special tokens, which are
    matched before normalisation, go to the library text by text.
    """
    for a, b in texthash.slices(offsets, CHUNK_BYTES):
        kept = []
        for lo, hi in texthash.slices(offsets[a : b + 1]):
            own = offsets[a + lo : a + hi + 1]
            part = data[own[0] : own[-1]]
            if ((part[:-1] == 60) & (part[1:] == 124)).any():
                kept.append((lo, hi, None))
                continue
            h, row, start, end = texthash.words(own, data)
            first, inverse = texthash.exact_groups(h, start, end, data)
            kept.append((lo, hi, (h[first], start[first], end[first], inverse.astype(np.int32), np.cumsum(np.bincount(row, minlength=hi - lo)))))
        found = [k[2] for k in kept if k[2] is not None]
        if found:
            begins, stops = (np.concatenate([f[k] for f in found]) for k in (1, 2))
            first, inverse = texthash.exact_groups(np.concatenate([f[0] for f in found]), begins, stops, data)
            ids, place, count = _distinct_ids(data, begins[first], stops[first], path)
        at = 0
        for lo, hi, f in kept:
            if f is None:
                own = offsets[a + lo : a + hi + 1]
                texts = [data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(own, own[1:])]
                encoded = [e.ids for e in _tokenizer(path)[0].encode_batch_fast(texts, add_special_tokens=False)]
                yield a + lo, a + hi, np.fromiter(itertools.chain.from_iterable(encoded), np.int64), np.cumsum([len(e) for e in encoded])
                continue
            w = inverse[at : at + len(f[0])][f[3]]
            at += len(f[0])
            k = count[w]
            tokens = np.concatenate([[0], np.cumsum(k)])
            yield a + lo, a + hi, ids[_joined(place[w], k)], tokens[f[4]]


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if wanted) of every text's pieces."""
    path = tokenizer_path or default_tokenizer_path()
    end = np.asarray([END_ID], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            offsets, data = texthash.buffers(batch.column(1))
            for lo, hi, ids, ends in encode_rows(offsets, data, path):
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                raw_ids = ids.astype("<u4")
                at = 0
                for i, stop in enumerate(ends.tolist(), lo):
                    raw = raw_ids[at:stop].tobytes() + end
                    at = stop
                    for p, x in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[x : x + 4 * capacity]
                        row.append(i)
                        piece.append(p)
                        start.append(x // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            kept.append(np.frombuffer(part, "<u4").astype("i4"))
                cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
        tidy()

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first bin, offset) of every slot of every run of bins."""
    left = {n: c for n, c in histogram.items() if c > 0}
    stock = sorted(left)
    taken = dict.fromkeys(left, 0)
    slots, bins = [], 0
    while stock:
        use: dict[int, int] = {}
        pattern: list[int] = []
        room = capacity
        while room > 0:
            i = bisect.bisect_right(stock, room) - 1
            while i >= 0 and use.get(stock[i], 0) >= left[stock[i]]:
                i -= 1
            if i < 0:
                break
            n = stock[i]
            use[n] = use.get(n, 0) + 1
            pattern.append(n)
            room -= n
        if room > 0:
            small = pattern[-1]
            pair = _tightest_pair(stock, left, use, small, room + small)
            if pair:
                pattern.pop()
                use[small] -= 1
                for n in pair:
                    pattern.append(n)
                    use[n] = use.get(n, 0) + 1
        times = min(left[n] // k for n, k in use.items() if k)
        offset = 0
        for n in pattern:
            slots.append((n, taken[n], times, bins, offset))
            taken[n] += times
            offset += n
        bins += times
        for n, k in use.items():
            left[n] -= k * times
            if not left[n]:
                stock.pop(bisect.bisect_left(stock, n))
                del left[n]
    return slots


def _tightest_pair(stock: list[int], left: dict, use: dict, small: int, space: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in (small, space], or None.

    A bin that is not full holds every unused piece that would fit its gap, so one of
    the pair is at least as long as the gap's largest candidate; ties go to the pair
    with the longer first piece.
    """
    free = [n for n in stock[: bisect.bisect_right(stock, space - 1)] if left[n] - use.get(n, 0) + (n == small) > 0]
    if not free:
        return None
    a = np.asarray(free, np.int64)
    count = np.asarray([left[n] - use.get(n, 0) + (n == small) for n in free])
    j = np.searchsorted(a, space - a, "right") - 1
    j = np.minimum(j, np.arange(len(a)))
    j = np.where((j == np.arange(len(a))) & (count < 2), j - 1, j)
    total = np.where(j >= 0, a + a[j], 0)
    best = len(a) - 1 - int(np.argmax(total[::-1]))
    if total[best] <= small:
        return None
    return int(a[best]), int(a[j[best]])


def place(pieces: DataFrame, capacity: int = CAPACITY, rows_per_slice: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to pieces (a stored table: it is read three times)."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = {r["length"]: r["count"] for r in counts}
    slots = plan_bins(histogram, capacity)
    plan = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "p_length bigint, p_first bigint, p_ranks bigint, p_bin bigint, p_offset bigint")
    slices = max(1, sum(histogram.values()) // rows_per_slice)
    keyed = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    # the rows before each slice: within stretches of slices, on top of the stretches' own sums
    sizes = keyed.groupBy("length", "_slice").count().withColumn("_part", F.floor(F.col("_slice") / STRETCH))
    earlier = lambda key, *group: Window.partitionBy(*group).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("length", "_part").agg(F.sum("count").alias("count"))
    parts = parts.select(F.col("length").alias("_p_length"), F.col("_part").alias("_p_part"), F.coalesce(F.sum("count").over(earlier("_part", "length")), F.lit(0)).alias("_ahead"))
    base = sizes.withColumn("_inner", F.coalesce(F.sum("count").over(earlier("_slice", "length", "_part")), F.lit(0)))
    base = base.join(parts, (F.col("length") == F.col("_p_length")) & (F.col("_part") == F.col("_p_part"))).select(
        F.col("length").alias("_b_length"), F.col("_slice").alias("_b_slice"), (F.col("_ahead") + F.col("_inner")).alias("_base")
    )
    within = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1)
    ranked = ranked.join(base, (F.col("length") == F.col("_b_length")) & (F.col("_slice") == F.col("_b_slice"))).withColumn("_rank", F.col("_rank") + F.col("_base"))
    # Bounded: a run of bins uses up at least one length (or leaves fewer than it needs), so
    # the plan has a few slots for each of ``capacity`` lengths, for any corpus.
    fits = (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_first")) & (F.col("_rank") < F.col("p_first") + F.col("p_ranks"))
    return ranked.join(F.broadcast(plan), fits).select(
        *pieces.columns,
        (F.col("p_bin") + F.col("_rank") - F.col("p_first")).alias("sequence_id"),
        F.col("p_offset").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenize whole documents and pack their pieces; one row a piece."""
    return place(stored(token_pieces(docs, tokenizer_path, capacity, keep_ids), "pieces"), capacity)
