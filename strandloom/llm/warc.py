"""WARC archives and their capture index by external merge.

Pages are written as WARC/1.1 records, each its own gzip member, by as many tasks as hold
them, into archives in the shared folder.  Of equal payloads the smallest page_id is a
response and the others revisit it.  The archives are then read back from start to end: each
record's payload and digest are checked, and its capture entries are sorted by URL key,
timestamp and page_id into a local run.  The runs are merged by k-way loser trees by ranges of
keys, split at sampled keys: a task merges one range and reads of its runs only the row groups
that the range touches.  More runs than FAN_IN are first merged in passes, each of whose tasks
merges FAN_IN runs over a block of neighbouring ranges into a run of that block, so that no
task grows with the corpus.  Taken in range order the result is one capture history in global
order.

A url stands in its record as it is; one with control or other unprintable characters, or with
blanks at an end, stands percent-encoded beside a mark that has the reader decode it.

Archive and run names are unique to a task attempt and only those that a finished attempt
reports are read, so a lost executor's leavings do no harm.

Cases: a null html is an empty payload; a null url has no target and an empty key; rows
that repeat a page_id with the smallest page_id of their payload are responses all; a null
page_id is a response if its payload has no other id, else a revisit; payloads below
``min_revisit`` bytes are always responses; an empty table writes nothing and gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh_path, open_fs, salt, stored, tidy, with_group_stats

ARCHIVE_BYTES = 1 << 30
RUN_ROWS = 100_000
RANGE_ROWS = 100_000
FAN_IN = 64
#: Entries that a task of a pass merges, about.
PASS_ROWS = 2_000_000
#: A run hands on the key of every such entry; of these about so many for each range are used.
SAMPLE_EVERY, SAMPLES = 512, 8
CAPTURED = "20240101000000"

ENTRY = "urlkey string, timestamp string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, offset bigint, length bigint"
_ENTRY = pa.schema(
    [("urlkey", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)


#: Characters that stand for themselves in a percent-encoded url.
_PLAIN = "".join(map(chr, range(33, 127))).replace("%", "")


def url_key(url: str | None) -> str:
    """Sort key of a url: host labels reversed, then the rest, in lower case."""
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)(.*)", (url or "").lower(), re.S)
    if not m:
        return (url or "").lower()
    host, _, port = m[1].partition(":")
    return ",".join(reversed(host.split("."))) + (":" + port if port else "") + ")" + (m[2] or "/")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, timestamp: str) -> bytes:
    """One gzip member with a response, or a revisit that leaves the payload out."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    date = f"{timestamp[:4]}-{timestamp[4:6]}-{timestamp[6:8]}T{timestamp[8:10]}:{timestamp[10:12]}:{timestamp[12:14]}Z"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {sha}')}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        if url.isprintable() and url == url.strip():
            head.append("WARC-Target-URI: " + url)
        else:
            head += ["WARC-Target-URI: " + quote(url, safe=_PLAIN), "X-Target-URI-Encoded: percent"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(pages: DataFrame, min_revisit: int = 0, timestamp: str = CAPTURED) -> DataFrame:
    """Write every row's record; (archive, records, bytes) of the archives, a stored table."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    rows = with_group_stats(rows, ["sha"], [(F.min("page_id").alias("first"), F.min("first").alias("first"))], salt("page_id", "url"))

    def run(batches):
        files, root = open_fs(folder)
        files.create_dir(root, recursive=True)
        out, path, size, n = None, "", 0, 0
        done = []
        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if out is None:
                    path, size, n = posixpath.join(folder, f"{uuid.uuid4().hex}.warc.gz"), 0, 0
                    out = files.open_output_stream(open_fs(path)[1])
                revisit = first is not None and page_id != first and len(payload) >= min_revisit
                raw = record(page_id, url, payload, first, revisit, timestamp)
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    done.append((path, n, size))
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])
        tidy()

    return stored(rows.select("page_id", "url", "payload", "first").mapInArrow(run, "archive string, records bigint, bytes bigint"), "warc-archives")


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of each gzip member of a file."""
    z, at, start, parts = zlib.decompressobj(31), 0, 0, []
    while True:
        chunk = stream.read(1 << 20)
        if not chunk:
            break
        while chunk:
            parts.append(z.decompress(chunk))
            if not z.eof:
                at += len(chunk)
                break
            at += len(chunk) - len(z.unused_data)
            yield start, at - start, b"".join(parts)
            chunk, start, parts, z = z.unused_data, at, [], zlib.decompressobj(31)
    if parts and b"".join(parts):
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> dict:
    """The entry of one record, its digests checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if "sha1:" + digest(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response":
        size, sha = len(payload), digest(payload)
        if "sha1:" + sha != fields["WARC-Payload-Digest"]:
            raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    refers = fields.get("X-Refers-To-Page")
    page, url = fields.get("X-Page-Id"), fields.get("WARC-Target-URI")
    if "X-Target-URI-Encoded" in fields:
        url = unquote(url)
    return {"page_id": None if page is None else int(page), "url": url, "payload_bytes": size, "payload_digest": sha, "record_type": kind, "refers_to": None if refers is None else int(refers), "timestamp": re.sub(r"\D", "", fields["WARC-Date"])}


def cut_key(e: dict) -> tuple:
    """The key by which ranges are cut: a null page_id comes last."""
    return e["urlkey"], e["timestamp"], e["page_id"] is None, e["page_id"] or 0


def order_key(e: dict) -> tuple:
    """Global order of entries: the cut key, then the place in the archives."""
    return *cut_key(e), e["archive"], e["offset"]


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next
    winner is found by replaying one path."""

    def __init__(self, runs: list[Iterator[tuple[tuple, object]]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for i in range(len(self.heads)):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a][0], a) < (self.heads[b][0], b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.tree[node] < 0:
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while True:
            w = self.tree[0]
            if w < 0 or self.heads[w] is None:
                return
            yield self.heads[w][1]
            self.heads[w] = next(self.runs[w], None)
            i, node = w, (w + self.k) // 2
            while node:
                if self._beats(self.tree[node], i):
                    self.tree[node], i = i, self.tree[node]
                node //= 2
            self.tree[0] = i


_KEY = pa.struct([("urlkey", pa.string()), ("timestamp", pa.string()), ("absent", pa.bool_()), ("page", pa.int64())])


def _write_run(files, folder: str, entries: Iterable[dict], sample_every: int = SAMPLE_EVERY) -> tuple[str, int, list]:
    """A run file of sorted entries with small row groups, and the key of every
    ``sample_every``-th entry."""
    import pyarrow.parquet as pq

    path = posixpath.join(folder, f"{uuid.uuid4().hex}.parquet")
    n, keys, batch = 0, [], []
    with pq.ParquetWriter(open_fs(path)[1], _ENTRY, filesystem=files) as out:

        def flush():
            if batch:
                out.write_table(pa.Table.from_pylist(batch, _ENTRY), row_group_size=4096)
                batch.clear()

        for e in entries:
            if n % sample_every == 0:
                keys.append(dict(zip(("urlkey", "timestamp", "absent", "page"), cut_key(e))))
            n += 1
            batch.append(e)
            if len(batch) == 4096:
                flush()
        flush()
    return path, n, keys


def _read_run(uri: str, lo, hi) -> Iterator[tuple[tuple, dict]]:
    """A run's entries with lo <= cut key < hi; None is open."""
    import pyarrow.parquet as pq

    files, path = open_fs(uri)
    file = pq.ParquetFile(path, filesystem=files)
    column = file.schema_arrow.names.index("urlkey")
    for g in range(file.num_row_groups):
        stats = file.metadata.row_group(g).column(column).statistics
        if stats is not None and stats.has_min_max and ((lo and stats.max < lo[0]) or (hi and stats.min > hi[0])):
            continue
        # a few rows at a time: many runs are read side by side
        for batch in file.iter_batches(256, [g], use_threads=False):
            for e in batch.to_pylist():
                key = cut_key(e)
                if (lo is None or key >= lo) and (hi is None or key < hi):
                    yield order_key(e), e


#: A run and the ranges that it lies in, [lo, hi); the runs of the archives lie in all.
_RUN = "run string, n bigint, keys array<struct<urlkey:string,timestamp:string,absent:boolean,page:bigint>>, lo bigint, hi bigint"


def _run_batch(done: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.list_(_KEY), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names=["run", "n", "keys", "lo", "hi"])


def read_archives(archives: DataFrame, run_rows: int = RUN_ROWS, sample_every: int = SAMPLE_EVERY) -> DataFrame:
    """Read archives back into sorted runs; (run, n, keys), a stored table."""
    folder = fresh_path(archives.sparkSession, "warc-runs")

    def run(batches):
        files, root = open_fs(folder)
        files.create_dir(root, recursive=True)
        entries, done = [], []

        def close():
            entries.sort(key=order_key)
            done.append((*_write_run(files, folder, entries, sample_every), 0, None))
            entries.clear()

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_fs(path)[0].open_input_stream(open_fs(path)[1]) as stream:
                    for offset, length, raw in members(stream):
                        e = parse(raw)
                        entries.append(e | {"urlkey": url_key(e["url"]), "archive": path, "offset": offset, "length": length})
                        if len(entries) >= run_rows:
                            close()
        if entries:
            close()
        yield _run_batch(done)
        tidy()

    n = max(1, archives.count())
    return stored(archives.select("archive").repartition(n).mapInArrow(run, _RUN), "warc-runs")


def _cuts(runs: DataFrame, parts: int) -> list[tuple]:
    """At most parts - 1 keys that split the runs' entries into ranges of about one size, from
    about SAMPLES keys for each range."""
    keys = runs.select("run", F.posexplode("keys").alias("at", "k"))
    thin = max(1, keys.count() // (SAMPLES * parts))
    some = keys.where(F.pmod(F.xxhash64("run", "at"), F.lit(thin)) == 0) if thin > 1 else keys
    found = sorted((k["urlkey"], k["timestamp"], k["absent"], k["page"]) for (k,) in some.select("k").collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def merge_runs(runs: DataFrame, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS, pass_rows: int = PASS_ROWS) -> DataFrame:
    """The entries of all runs in global order (partition by partition)."""
    spark = runs.sparkSession
    total = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cuts = _cuts(runs, max(1, -(-total // range_rows)))
    ranges = list(zip([None, *cuts], [*cuts, None]))
    runs = runs.withColumn("hi", F.coalesce("hi", F.lit(len(ranges))))
    block = 1 << (len(ranges) - 1).bit_length()  # neighbouring ranges that one run covers
    deep = runs.count()  # runs that meet in a range
    while deep > fan_in:
        folder = fresh_path(spark, "warc-runs")
        groups = -(-deep // fan_in)
        # halve the blocks until a task's share of fan_in runs is small enough
        share = total / groups
        while block > 1 and share * block / len(ranges) > pass_rows:
            block //= 2

        def merge(batches, folder=folder, block=block):
            files, root = open_fs(folder)
            files.create_dir(root, recursive=True)
            for batch in batches:
                for at, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    lo, hi = at * block, min(len(ranges), (at + 1) * block)
                    merged = LoserTree([_read_run(r, ranges[lo][0], ranges[hi - 1][1]) for r in group])
                    yield _run_batch([(*_write_run(files, folder, merged), lo, hi)])
            tidy()

        each = runs.withColumn("at", F.explode(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})")))
        dealt = each.withColumn("g", F.expr(f"pmod(xxhash64(run), {groups})")).groupBy("at", "g").agg(F.collect_list("run").alias("runs"))
        tasks = max(1, groups * -(-len(ranges) // block))
        runs = stored(dealt.select("at", "runs").repartition(tasks, "at", "runs").mapInArrow(merge, _RUN), "warc-runs")
        deep = groups
    # FAN_IN runs a block at most, and blocks of about PASS_ROWS entries
    listed = [(r["lo"], r["hi"], r["run"]) for r in runs.select("lo", "hi", "run").collect()]

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rows = []
                for e in LoserTree([_read_run(r, *ranges[i]) for lo, hi, r in listed if lo <= i < hi]):
                    rows.append(e)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, _ENTRY)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _ENTRY)

    return spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(run, ENTRY)


def capture_history(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Archive pages, read them back, and index the captures in global order."""
    return merge_runs(read_archives(write_archives(pages, min_revisit)))
