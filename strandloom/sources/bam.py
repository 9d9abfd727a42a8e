"""BAM as a Python data source.

A file is cut into byte ranges.  A task finds the first block in its range, then the first
record in it (a place from which a chain of well-formed records leads on), and reads the records
that begin in its range, so one large file is many tasks.  With a .bai index beside the file a
region reads only the chunks that the index names.  ``ord`` is the split's number times 2^40 plus
the record's number in it: unique over a folder and in file order.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..shipping import ship_package
from . import bgzf

SCHEMA = "ord bigint, qname string, flag int, chr string, pos bigint, mapq int, cigar string, mchr string, mpos bigint, tlen bigint, seq string, qual string, aux map<string,string>, xm string, xm_type string"
# Fixed alphabets of the format.
_BASES = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"
#: Compressed bytes of a task, and what is looked at for the first record of a range.
SPLIT_BYTES = 64 << 20
_LOOK = 1 << 20
_SCALARS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}") if not path.startswith("file:/") or path.startswith("file://") else fs.FileSystem.from_uri("file://" + path[5:])


def _aux(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(raw):
        tag, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind == "A":
            out[tag] = f"A:{chr(raw[at])}"
            at += 1
        elif kind in _SCALARS:
            fmt = "<" + _SCALARS[kind]
            value = struct.unpack_from(fmt, raw, at)[0]
            out[tag] = f"f:{value:g}" if kind == "f" else f"i:{value}"
            at += struct.calcsize(fmt)
        elif kind in "ZH":
            end = raw.index(0, at)
            out[tag] = f"{kind}:{raw[at:end].decode()}"
            at = end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<I", raw, at + 1)[0]
            fmt = f"<{n}{_SCALARS[sub]}"
            out[tag] = f"B:{sub}," + ",".join(f"{v:g}" if sub == "f" else str(v) for v in struct.unpack_from(fmt, raw, at + 5))
            at += 5 + struct.calcsize(fmt)
        elif kind == "d":
            out[tag] = f"f:{struct.unpack_from('<d', raw, at)[0]:g}"
            at += 8
        else:
            raise ValueError(f"unknown optional field type {kind!r}")
    return out


def _header(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    n = struct.unpack_from("<i", data, 4)[0]
    text = data[8 : 8 + n].rstrip(b"\0").decode()
    at = 8 + n
    refs = []
    for _ in range(struct.unpack_from("<i", data, at)[0]):
        at += 4 if not refs else 0
        size = struct.unpack_from("<i", data, at)[0]
        name = data[at + 4 : at + 3 + size].decode()
        refs.append((name, struct.unpack_from("<i", data, at + 4 + size)[0]))
        at += 8 + size
    return text, refs, at if refs else at + 4


def open_file(path: str):
    files, root = _fs(path)
    return files.open_input_file(root)


def read_header(path: str) -> tuple[str, list[tuple[str, int]], int]:
    """(text, sequences, virtual offset of the first record) of a file."""
    pending, segments = b"", []
    with open_file(path) as stream:
        for at, data in bgzf.blocks(stream):
            segments.append((len(pending), at))
            pending += data
            try:
                text, refs, end = _header(pending)
            except (struct.error, IndexError):
                continue
            if end > len(pending):
                continue
            if end == len(pending):  # the record begins with the next block
                return text, refs, stream.tell() << 16
            start, block = [s for s in segments if s[0] <= end][-1]
            return text, refs, block << 16 | (end - start)
    raise ValueError(f"{path}: the header is cut short")


def raw_records(path: str, beg: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, bytes) of the records that begin in [beg, end) of a file."""
    with open_file(path) as stream:
        stream.seek(beg >> 16)
        buffer, segments, skip = b"", [], beg & 0xFFFF
        for block, data in bgzf.blocks(stream, beg >> 16):
            segments.append((len(buffer), block, skip))
            buffer += data[skip:]
            skip, at, k = 0, 0, 0
            while len(buffer) - at >= 4:
                while k + 1 < len(segments) and segments[k + 1][0] <= at:
                    k += 1
                here = segments[k][1] << 16 | (at - segments[k][0] + segments[k][2])
                if end is not None and here >= end:
                    return
                size = struct.unpack_from("<i", buffer, at)[0]
                if len(buffer) - at < 4 + size:
                    break
                yield here, buffer[at + 4 : at + 4 + size]
                at += 4 + size
            buffer = buffer[at:]
            segments = [(max(0, s - at), b, u + max(0, at - s)) for s, b, u in segments[k:]]
            if not buffer and end is not None and stream.tell() << 16 >= end:
                return
    if buffer:
        raise ValueError(f"{path}: the file ends within a record")


def _plausible(data: bytes, n_refs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``data`` whether a record may begin there, and where the next would."""
    n = len(data) - 36
    if n <= 0:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    word = lambda at: np.ndarray((n,), "<i4", raw[at:].tobytes(), 0, (1,)).astype(np.int64)
    half = lambda at: np.ndarray((n,), "<u2", raw[at:].tobytes(), 0, (1,)).astype(np.int64)
    size, ref, pos, name, ops, length, mate, mate_pos = word(0), word(4), word(8), raw[12 : 12 + n].astype(np.int64), half(16), word(20), word(24), word(28)
    ok = (size >= 32) & (size < 1 << 28) & (ref >= -1) & (ref < n_refs) & (pos >= -1) & (name >= 1) & (length >= 0) & (mate >= -1) & (mate < n_refs) & (mate_pos >= -1)
    ok &= 32 + name + 4 * ops + (length + 1) // 2 + length <= size
    end = np.arange(n) + 36 + name - 1
    inside = end < len(raw)
    ok &= ~inside | (raw[np.minimum(end, len(raw) - 1)] == 0)
    return ok, np.arange(n) + 4 + size


def first_record(path: str, lo: int, n_refs: int) -> int | None:
    """The virtual offset of the first record that begins in a block at or behind byte ``lo``."""
    with open_file(path) as stream:
        stream.seek(lo)
        head = stream.read(_LOOK)
        at = bgzf.next_block(head)
        if at < 0:
            return None
        stream.seek(lo + at)
        data, segments, look = b"", [], _LOOK
        source = bgzf.blocks(stream, lo + at)
        while True:
            ended = True
            for block, content in source:
                segments.append((len(data), block))
                data += content
                if len(data) >= look:
                    ended = False
                    break
            ok, ahead = _plausible(data, n_refs)
            for u in np.flatnonzero(ok):
                place, links = int(u), 0
                while place < len(ok) and ok[place]:
                    place, links = int(ahead[place]), links + 1
                # the chain leaves the data whole, or ends with it
                if place >= len(ok) and (place >= len(data) or not ended) and (not ended or place == len(data)):
                    start, block = [s for s in segments if s[0] <= u][-1]
                    return block << 16 | (int(u) - start)
            if ended:
                return None
            look += _LOOK


def _record(raw: bytes, refs: list[tuple[str, int]]) -> tuple:
    tid, pos, l_name, mapq, _, n_ops, flag, l_seq, mtid, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32
    qname = raw[at : at + l_name - 1].decode()
    at += l_name
    ops = struct.unpack_from(f"<{n_ops}I", raw, at)
    at += 4 * n_ops
    packed = raw[at : at + (l_seq + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
    at += (l_seq + 1) // 2
    qual = raw[at : at + l_seq]
    aux = _aux(raw[at + l_seq :])
    text = "*" if not l_seq or qual[0] == 255 else "".join(chr(q + 33) for q in qual)
    name = lambda t: refs[t][0] if t >= 0 else "*"
    xm = aux.get("XM")
    return (qname, flag, name(tid), pos, mapq, "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*", name(mtid), mpos, tlen, seq or "*", text, aux, xm[2:] if xm else None, xm[0] if xm else None)


# The binning scheme of the index: fixed values.
_LEVELS, _SHIFT, _META = 5, 14, 37450


def bin_of(beg: int, end: int) -> int:
    """The smallest bin that holds [beg, end)."""
    end -= 1
    for level in range(_LEVELS, 0, -1):
        shift = _SHIFT + 3 * (_LEVELS - level)
        if beg >> shift == end >> shift:
            return ((1 << 3 * level) - 1) // 7 + (beg >> shift)
    return 0


def bins_of(beg: int, end: int) -> list[range]:
    """All bins that may hold something of [beg, end)."""
    out = [range(0, 1)]
    for level in range(1, _LEVELS + 1):
        first, shift = ((1 << 3 * level) - 1) // 7, _SHIFT + 3 * (_LEVELS - level)
        out.append(range(first + (beg >> shift), first + (max(beg, end - 1) >> shift) + 1))
    return out


def read_index(path: str) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]] | None:
    """(chunks by bin, linear offsets) of each sequence from FILE.bai or FILE with .bai for .bam;
    None without an index."""
    from pyarrow import fs

    for name in (path + ".bai", re.sub(r"\.bam$", ".bai", path)):
        files, root = _fs(name)
        if name != path and files.get_file_info(root).type == fs.FileType.File:
            break
    else:
        return None
    with files.open_input_file(root) as stream:
        raw = stream.read()
    if raw[:4] != b"BAI\1":
        raise ValueError(f"{name}: not an index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", raw, 4)[0]):
        bins = {}
        n_bins = struct.unpack_from("<i", raw, at)[0]
        at += 4
        for _ in range(n_bins):
            number, n = struct.unpack_from("<Ii", raw, at)
            pairs = struct.unpack_from(f"<{2 * n}Q", raw, at + 8)
            at += 8 + 16 * n
            if number != _META:
                bins[number] = list(zip(pairs[::2], pairs[1::2]))
        n = struct.unpack_from("<i", raw, at)[0]
        out.append((bins, list(struct.unpack_from(f"<{n}Q", raw, at + 4))))
        at += 4 + 8 * n
    return out


def chunks_of(index, tid: int, beg: int, end: int) -> list[tuple[int, int]]:
    """Ranges of virtual offsets that hold all records over [beg, end) of a sequence."""
    bins, linear = index[tid]
    floor = linear[min(beg >> _SHIFT, len(linear) - 1)] if linear else 0
    found = sorted((max(a, floor), b) for bin_range in bins_of(beg, end) for k in (bin_range if len(bin_range) < len(bins) else [x for x in bins if x in bin_range]) for a, b in bins.get(k, ()) if b > floor)
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a >> 16 <= out[-1][1] >> 16:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


@dataclass
class _Part(InputPartition):
    number: int
    path: str
    lo: int  # bytes, or virtual offsets if exact
    hi: int | None
    exact: bool = False


def _files(path: str, ending: str = ".bam") -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder with an ending, by name."""
    from pyarrow import fs

    files, root = _fs(path)
    info = files.get_file_info(root)
    if info.type != fs.FileType.Directory:
        return [(path, info.size)]
    scheme = path.split("://")[0] if "://" in path else "file"
    found = sorted((f.path, f.size) for f in files.get_file_info(fs.FileSelector(root)) if f.path.endswith(ending))
    return [(f"{scheme}://{p}", n) for p, n in found]


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.chr = options.get("chr")
        # a region [beg, end) that reads must overlap, and bounds of their first positions
        self.beg, self.end = (int(options[k]) if k in options else None for k in ("beg", "end"))
        self.lo, self.hi = None, None

    def partitions(self):
        parts = []
        for path, size in _files(self.path):
            index = read_index(path) if self.chr is not None else None
            if index is not None:
                names = [n for n, _ in read_header(path)[1]]
                if self.chr not in names:
                    continue
                beg = max(0, max((x for x in (self.beg, self.lo) if x is not None), default=0))
                end = min((x for x in (self.end, None if self.hi is None else self.hi + 1) if x is not None), default=1 << 29)
                for a, b in chunks_of(index, names.index(self.chr), beg, max(end, beg + 1)):
                    parts.append(_Part(len(parts), path, a, b, True))
                continue
            step = max(1, self.split)
            parts += [_Part(len(parts) + k, path, lo, min(size, lo + step)) for k, lo in enumerate(range(0, size, step))]
        return parts or [_Part(0, "", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        _, refs, first = read_header(partition.path)
        if partition.exact:
            beg, end = partition.lo, partition.hi
        else:
            beg, end = first, partition.hi << 16
            if partition.lo > first >> 16:
                beg = first_record(partition.path, partition.lo, len(refs))
            if beg is None or beg >= end:
                return
        base = partition.number << 40
        for k, (_, raw) in enumerate(raw_records(partition.path, beg, end)):
            row = _record(raw, refs)
            if self.chr is not None and row[2] != self.chr:
                continue
            pos = row[3]
            if (self.lo is not None and pos < self.lo) or (self.hi is not None and pos > self.hi) or (self.end is not None and pos >= self.end):
                continue
            if self.beg is not None and pos + max(1, _span(row[5])) <= self.beg:
                continue
            yield (base + k, *row)


class PushingBamReader(BamReader):
    """A reader that takes filters on chr and pos; Spark allows this by a setting only."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chr",):
                self.chr = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("pos",):
                self.lo = f.value if self.lo is None else max(self.lo, f.value)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("pos",):
                self.hi = f.value if self.hi is None else min(self.hi, f.value)
            yield f  # a superset is read; Spark filters exactly


def _span(cigar: str) -> int:
    return sum(int(n) for n, op in re.findall(r"(\d+)([MDN=X])", cigar))


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PushingBamReader if self.options.get("pushdown") == "true" else BamReader)(self.options)

    def writer(self, schema, overwrite):
        return BamWriter(self.options)


_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def read_bam(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Alignments of a BAM file or of a folder of them, in splits of about ``split_bytes``.

    ``region`` (chr, beg, end; 0-based, half-open) keeps the reads that overlap it, and with an
    index beside a file reads only what may hold them.  Filters on chr and pos are pushed down
    too where the session has the setting for it.
    """
    ship_package(spark)
    spark.dataSource.register(BamSource)
    options = {"splitBytes": str(split_bytes), "pushdown": str(spark.conf.get(_PUSHDOWN, "false")).lower()}
    if region is not None:
        options |= {"chr": region[0], "beg": str(region[1]), "end": str(region[2])}
    return spark.read.format("bam").options(**options).load(path)


def index_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> None:
    """Write FILE.bai of a sorted file.  The splits are read in parallel; what meets on the driver
    is the index: at most a chunk for each run of records of one bin."""
    ship_package(spark)
    parts = BamReader({"path": path, "splitbytes": str(split_bytes)}).partitions()
    rows = spark.createDataFrame([(p.number, p.lo, p.hi) for p in parts], "number bigint, lo bigint, hi bigint").repartition(len(parts), "number")

    def run(batches):
        for batch in batches:
            for number, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                out = list(_index_rows(path, lo, hi))
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(out), pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=["number", "tid", "bin", "beg", "end", "windows"])

    found = rows.mapInArrow(run, "number bigint, tid bigint, bin bigint, beg bigint, end bigint, windows bigint").collect()
    _, refs, _ = read_header(path)
    bins: list[dict[int, list]] = [{} for _ in refs]
    linear: list[dict[int, int]] = [{} for _ in refs]
    for r in sorted(found, key=lambda r: (r["number"], r["beg"])):
        if r["bin"] < 0:  # the first record over a window
            linear[r["tid"]].setdefault(r["windows"], r["beg"])
            linear[r["tid"]][r["windows"]] = min(linear[r["tid"]][r["windows"]], r["beg"])
        else:
            bins[r["tid"]].setdefault(r["bin"], []).append((r["beg"], r["end"]))
    out = bytearray(b"BAI\1" + struct.pack("<i", len(refs)))
    for own, windows in zip(bins, linear):
        out += struct.pack("<i", len(own))
        for number, chunks in sorted(own.items()):
            out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", a, b) for a, b in chunks)
        offsets, last = [], 0
        for k in range(max(windows, default=-1) + 1):
            last = windows.get(k, last)
            offsets.append(last)
        out += struct.pack("<i", len(offsets)) + struct.pack(f"<{len(offsets)}Q", *offsets)
    files, root = _fs(path + ".bai")
    with files.open_output_stream(root, compression=None) as stream:
        stream.write(bytes(out))


def _index_rows(path: str, lo: int, hi: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(tid, bin, beg, end, -1) of runs of records in one bin, and (tid, -1, beg, beg, window)
    of the first record over each window, of a split."""
    _, refs, first = read_header(path)
    beg = first if lo <= first >> 16 else first_record(path, lo, len(refs))
    if beg is None or beg >= hi << 16:
        return
    run, seen, last, end = None, set(), None, beg
    for here, raw in raw_records(path, beg, hi << 16):
        tid, pos = struct.unpack_from("<ii", raw)
        if last is not None and (tid if tid >= 0 else len(refs), pos) < last:
            raise ValueError(f"{path}: not in the order of positions")
        last = (tid if tid >= 0 else len(refs), pos)
        row = _record(raw, refs) if tid >= 0 else None
        key = None
        if row is not None and pos >= 0:
            stop = pos + max(1, _span(row[5]))
            key = (tid, bin_of(pos, stop))
            for w in range(pos >> _SHIFT, (stop - 1 >> _SHIFT) + 1):
                if (tid, w) not in seen:
                    seen.add((tid, w))
                    yield tid, -1, here, here, w
        if run is not None and run[0] != key:
            yield *run[0], run[1], here, -1
            run = None
        if run is None and key is not None:
            run = (key, here)
        end = here + 1
    if run is not None:
        # the next split's first record ends the chunk; any offset behind the last one does
        yield *run[0], run[1], end, -1


def encode(rows: list[dict], refs: list[tuple[str, int]], text: str = "") -> bytes:
    """A BAM file of records given as dicts of the alignment schema."""
    ids = {n: i for i, (n, _) in enumerate(refs)}
    return bgzf.compress(encode_header(refs, text) + b"".join(encode_record(r, ids) for r in rows))


def encode_header(refs: list[tuple[str, int]], text: str) -> bytes:
    raw = text.encode()
    out = bytearray(b"BAM\1" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(refs)))
    for name, size in refs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    return bytes(out)


def encode_record(r: dict, ids: dict[str, int]) -> bytes:
    """A record of a dict of the alignment schema, with its size before it."""
    ops = [(int(n), _OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", r["cigar"])]
    seq = "" if r["seq"] == "*" else r["seq"]
    codes = [_BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", ids.get(r["chr"], -1), r["pos"], len(r["qname"]) + 1, r["mapq"], bin_of(max(0, r["pos"]), max(0, r["pos"]) + max(1, _span(r["cigar"]))), len(ops), r["flag"], len(seq), ids.get(r["mchr"], -1), r["mpos"], r["tlen"])
    body += r["qname"].encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops)
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    body += b"\xff" * len(seq) if r["qual"] == "*" else bytes(ord(c) - 33 for c in r["qual"])
    for tag, value in (r.get("aux") or {}).items():
        kind, v = value[0], value[2:]
        body += tag.encode() + kind.encode()
        if kind == "i":
            body += struct.pack("<i", int(v))
        elif kind == "f":
            body += struct.pack("<f", float(v))
        elif kind == "A":
            body += v.encode()
        elif kind in "ZH":
            body += v.encode() + b"\0"
        else:
            sub, *items = v.split(",")
            body += sub.encode() + struct.pack("<I", len(items)) + struct.pack(f"<{len(items)}{_SCALARS[sub]}", *(float(x) if sub == "f" else int(x) for x in items))
    return struct.pack("<i", len(body)) + body


@dataclass
class _Written(WriterCommitMessage):
    draft: str
    final: str


class FolderWriter(DataSourceWriter):
    """A folder with a block-gzip file for each partition, each whole in itself; files get their
    names when the job is committed, so a lost or repeated task leaves nothing behind."""

    ending = ""

    def __init__(self, options):
        self.path, self.text = options["path"].rstrip("/"), options.get("header", "")

    def head(self) -> bytes:
        raise NotImplementedError

    def record(self, row: dict) -> bytes:
        raise NotImplementedError

    def write(self, iterator):
        files, root = _fs(self.path)
        files.create_dir(root, recursive=True)
        final = f"{root}/part-{TaskContext.get().partitionId():05d}{self.ending}"
        draft = f"{root}/.{uuid.uuid4().hex}.draft"
        with files.open_output_stream(draft, compression=None) as out:
            data = bytearray(self.head())
            for row in iterator:
                data += self.record(row.asDict(recursive=True))
                while len(data) >= bgzf.BLOCK:
                    out.write(bgzf.compress_block(bytes(data[: bgzf.BLOCK])))
                    del data[: bgzf.BLOCK]
            if data:
                out.write(bgzf.compress_block(bytes(data)))
            out.write(bgzf.END)
        return _Written(draft, final)

    def commit(self, messages):
        files, _ = _fs(self.path)
        for m in messages:
            if m is not None:
                files.move(m.draft, m.final)

    def abort(self, messages):
        files, _ = _fs(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(m.draft)


class BamWriter(FolderWriter):
    ending = ".bam"

    def head(self) -> bytes:
        lines = [dict(f.split(":", 1) for f in line.split("\t")[1:]) for line in self.text.splitlines() if line.startswith("@SQ")]
        refs = [(f["SN"], int(f["LN"])) for f in lines]
        self.ids = {n: i for i, (n, _) in enumerate(refs)}
        return encode_header(refs, self.text)

    def record(self, row: dict) -> bytes:
        return encode_record(row, self.ids)


def write_bam(records: DataFrame, path: str, header: str) -> None:
    """Write alignments in their partitions' order as a folder of BAM files; ``header`` is SAM
    header text with an @SQ line for each sequence."""
    spark = records.sparkSession
    ship_package(spark)
    spark.dataSource.register(BamSource)
    wanted = ["ord", "qname", "flag", "chr", "pos", "mapq", "cigar", "mchr", "mpos", "tlen", "seq", "qual", "aux"]
    records.select(*wanted).write.format("bam").mode("append").option("header", header).save(path)
