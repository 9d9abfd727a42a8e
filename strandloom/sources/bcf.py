"""BCF: the binary form of variant records, as a Python data source."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship_package
from . import bgzf
from .bam import FolderWriter, _files, _fs

SCHEMA = "chr string, pos bigint, id string, ref string, alts array<string>, qual double, filters array<string>, info map<string,string>, samples map<string,map<string,string>>"
# Fixed type codes: struct format, missing value and end-of-vector value of each.
_KINDS = {1: ("b", -128, -127), 2: ("h", -(1 << 15), -(1 << 15) + 1), 3: ("i", -(1 << 31), -(1 << 31) + 1)}
_FLOAT_MISSING, _FLOAT_END = 0x7F800001, 0x7F800002


def dictionaries(text: str) -> tuple[list[str], list[str], list[str]]:
    """(contigs, strings, samples) in the order of a header's text; IDX entries decide."""
    contigs: dict[int, str] = {}
    strings: dict[int, str] = {0: "PASS"}
    samples: list[str] = []
    for line in text.splitlines():
        m = re.match(r"##(contig|INFO|FORMAT|FILTER)=<ID=([^,>]+)", line)
        if m:
            table = contigs if m[1] == "contig" else strings
            if m[2] in table.values():
                continue
            at = re.search(r"IDX=(\d+)", line)
            table[int(at[1]) if at else max(table, default=-1) + 1] = m[2]
        elif line.startswith("#CHROM"):
            samples = line.split("\t")[9:]
    listed = lambda t: [t.get(i, "") for i in range(max(t, default=-1) + 1)]
    return listed(contigs), listed(strings), samples


class _Cursor:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, fmt: str) -> tuple:
        out = struct.unpack_from("<" + fmt, self.raw, self.at)
        self.at += struct.calcsize("<" + fmt)
        return out

    def head(self) -> tuple[int, int]:
        """(count, kind) of a typed value."""
        b = self.take("B")[0]
        n = b >> 4
        return (self.typed()[0] if n == 15 else n), b & 15

    def values(self, n: int, kind: int) -> list:
        if kind == 0 or n == 0:
            return []
        if kind == 7:
            return [self.take(f"{n}s")[0].rstrip(b"\0").decode()]
        if kind == 5:
            bits = self.take(f"{n}I")
            return [None if b == _FLOAT_MISSING else struct.unpack("<f", struct.pack("<I", b))[0] for b in bits if b != _FLOAT_END]
        fmt, missing, end = _KINDS[kind]
        return [None if v == missing else v for v in self.take(f"{n}{fmt}") if v != end]

    def typed(self) -> list:
        return self.values(*self.head())


def _text(values: list) -> str:
    return ",".join("." if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in values)


def _genotype(values: list) -> str:
    out = ""
    for i, v in enumerate(values):
        v = v or 0
        out += ("|" if v & 1 else "/") * (i > 0) + (str((v >> 1) - 1) if v >> 1 else ".")
    return out or "."


def record(shared: bytes, own: bytes, contigs: list[str], strings: list[str], samples: list[str]) -> tuple:
    c = _Cursor(shared)
    chrom, pos, _, qual, n_info, n_allele, counts = c.take("iiiIHHI")
    n_sample, n_fmt = counts & 0xFFFFFF, counts >> 24
    name = c.typed()
    alleles = [(c.typed() or [""])[0] for _ in range(n_allele)]
    filters = [strings[i] for i in c.typed()]
    info = {}
    for _ in range(n_info):
        key = strings[c.typed()[0]]
        info[key] = _text(c.typed())
    f = _Cursor(own)
    calls: dict[str, dict[str, str]] = {s: {} for s in samples}
    for _ in range(n_fmt):
        key = strings[f.typed()[0]]
        n, kind = f.head()
        for s in samples[:n_sample]:
            values = f.values(n, kind)
            calls[s][key] = _genotype(values) if key == "GT" else _text(values) or "."
    quality = None if qual == _FLOAT_MISSING else struct.unpack("<f", struct.pack("<I", qual))[0]
    return (contigs[chrom], pos + 1, name[0] if name and name[0] != "." else None, alleles[0], alleles[1:], quality, filters, info, calls or None)


def records(stream) -> Iterator[tuple]:
    pending, tables = b"", None
    for _, data in bgzf.blocks(stream):
        pending += data
        at = 0
        if tables is None:
            if len(pending) < 9 or len(pending) < 9 + struct.unpack_from("<I", pending, 5)[0]:
                continue
            if pending[:3] != b"BCF":
                raise ValueError("not a BCF file")
            size = struct.unpack_from("<I", pending, 5)[0]
            tables = dictionaries(pending[9 : 9 + size].rstrip(b"\0").decode())
            at = 9 + size
        while len(pending) - at >= 8:
            a, b = struct.unpack_from("<II", pending, at)
            if len(pending) - at < 8 + a + b:
                break
            yield record(pending[at + 8 : at + 8 + a], pending[at + 8 + a : at + 8 + a + b], *tables)
            at += 8 + a + b
        pending = pending[at:]
    if pending:
        raise ValueError("the file ends within a record")


@dataclass
class _Part(InputPartition):
    path: str


class BcfReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [_Part(p) for p, _ in _files(self.path, ".bcf")] or [_Part("")]

    def read(self, partition):
        if not partition.path:
            return
        files, root = _fs(partition.path)
        with files.open_input_stream(root, compression=None, buffer_size=1 << 20) as stream:
            yield from records(stream)


class BcfSource(DataSource):
    @classmethod
    def name(cls):
        return "bcf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BcfReader(self.options)

    def writer(self, schema, overwrite):
        return BcfWriter(self.options)


def read_bcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a BCF file, or of a folder of them (a task each), in the columns of
    ``read_vcf``."""
    ship_package(spark)
    spark.dataSource.register(BcfSource)
    return spark.read.format("bcf").load(path)


def _typed(values: list | str) -> bytes:
    if isinstance(values, str):
        raw, kind = values.encode(), 7
    elif any(isinstance(v, float) for v in values):
        raw, kind = b"".join(struct.pack("<I", _FLOAT_MISSING) if v is None else struct.pack("<f", v) for v in values), 5
    else:
        raw, kind = b"".join(struct.pack("<i", _KINDS[3][1] if v is None else v) for v in values), 3
    n = len(values)
    head = bytes([n << 4 | kind]) if n < 15 else bytes([15 << 4 | kind, 1 << 4 | 3]) + struct.pack("<i", n)
    return (head if n else b"\0") + raw


def encode(header: str, rows: list[dict]) -> bytes:
    """A BCF file of records: dicts with chr, pos, id, ref, alts, qual, filters, info (lists or
    text by key) and calls (key -> one list a sample, all of one length)."""
    tables = dictionaries(header)
    return bgzf.compress(encode_header(header) + b"".join(encode_record(r, *tables) for r in rows))


def encode_header(header: str) -> bytes:
    text = header.encode() + b"\0"
    return b"BCF\2\2" + struct.pack("<I", len(text)) + text


def encode_record(r: dict, contigs: list[str], strings: list[str], samples: list[str]) -> bytes:
    shared = struct.pack("<iii", contigs.index(r["chr"]), r["pos"] - 1, len(r["ref"]))
    shared += struct.pack("<I", _FLOAT_MISSING) if r["qual"] is None else struct.pack("<f", r["qual"])
    shared += struct.pack("<HHI", len(r["info"]), 1 + len(r["alts"]), len(r["calls"]) << 24 | len(samples))
    shared += _typed(r["id"] or ".") + b"".join(_typed(a) for a in (r["ref"], *r["alts"])) + _typed([strings.index(x) for x in r["filters"]])
    shared += b"".join(_typed([strings.index(k)]) + _typed(v) for k, v in r["info"].items())
    own = b""
    for k, lists in r["calls"].items():
        own += _typed([strings.index(k)]) + _vectors(lists)
    return struct.pack("<II", len(shared), len(own)) + shared + own


def _vectors(lists: list) -> bytes:
    """One vector a sample, all as long as the longest."""
    if any(isinstance(v, str) for v in lists):
        size = max(len(v.encode()) for v in lists)
        return _head(size, 7) + b"".join(v.encode().ljust(size, b"\0") for v in lists)
    size = max(map(len, lists))
    real = any(isinstance(x, float) for v in lists for x in v)
    end, missing = (_FLOAT_END, _FLOAT_MISSING) if real else (_KINDS[3][2], _KINDS[3][1])
    pack = lambda x: struct.pack("<I" if real else "<i", missing) if x is None else struct.pack("<f" if real else "<i", x)
    pad = struct.pack("<I" if real else "<i", end)
    return _head(size, 5 if real else 3) + b"".join(b"".join(map(pack, v)) + pad * (size - len(v)) for v in lists)


def _head(n: int, kind: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([15 << 4 | kind, 1 << 4 | 3]) + struct.pack("<i", n)


def _parsed(text: str, kind: str) -> list | str:
    """A field's text as values of its header type."""
    if kind in ("String", "Character"):
        return text
    number = float if kind == "Float" else int
    return [None if x in (".", "") else number(x) for x in text.split(",")]


def _alleles(gt: str) -> list[int]:
    """The coded alleles of genotype text."""
    out = []
    for sep, allele in re.findall(r"(^|[/|])(\.|\d+)", gt):
        out.append((0 if allele == "." else int(allele) + 1) << 1 | (sep == "|"))
    return out or [0]


def from_columns(row: dict, kinds: dict[tuple[str, str], str], samples: list[str]) -> dict:
    """A record for ``encode_record`` from the columns of ``read_vcf``."""
    info = {}
    for key, text in (row["info"] or {}).items():
        kind = kinds.get(("INFO", key), "String")
        info[key] = [] if kind == "Flag" else _parsed(text, kind)
    calls: dict[str, list] = {}
    by_sample = row["samples"] or {}
    for key in dict.fromkeys(k for s in samples for k in (by_sample.get(s) or {})):
        texts = [(by_sample.get(s) or {}).get(key, ".") for s in samples]
        calls[key] = [_alleles(t) for t in texts] if key == "GT" else [_parsed(t, kinds.get(("FORMAT", key), "String")) for t in texts]
    return {"chr": row["chr"], "pos": row["pos"], "id": row["id"], "ref": row["ref"], "alts": row["alts"] or [], "qual": row["qual"], "filters": row["filters"] or [], "info": info, "calls": calls}


class BcfWriter(FolderWriter):
    """A folder with a file for each partition, each whole in itself."""

    ending = ".bcf"

    def head(self) -> bytes:
        self.kinds = {(m[1], m[2]): m[3] for m in re.finditer(r"##(INFO|FORMAT)=<ID=([^,>]+)[^\n]*?Type=(\w+)", self.text)}
        self.tables = dictionaries(self.text)
        return encode_header(self.text)

    def record(self, row: dict) -> bytes:
        return encode_record(from_columns(row, self.kinds, self.tables[2]), *self.tables)


def write_bcf(records: DataFrame, path: str, header: str) -> None:
    """Write variants (the columns of ``read_vcf``) in their partitions' order as a folder of BCF
    files; ``header`` is VCF header text that declares all contigs, filters and fields."""
    spark = records.sparkSession
    ship_package(spark)
    spark.dataSource.register(BcfSource)
    records.select("chr", "pos", "id", "ref", "alts", "qual", "filters", "info", "samples").write.format("bcf").mode("append").option("header", header).save(path)
