"""MinHash near-duplicates by a multi-index Hamming join.

Every text becomes its set of distinct five-word shingles: 64-bit hashes of randomly weighted
sums, which no pattern of words makes equal; two given shingles meet with a chance of 2^-63.
Equal sets form
a class; each class has a MinHash signature of CHUNKS x CHUNK symbols of 16 bits.  Two
signatures that differ in at most ``ERRORS * CHUNKS + CHUNKS - 1`` symbols agree, by the
pigeonhole principle, in some chunk up to ERRORS symbols; a chunk's key is therefore
indexed once for each symbol that may be wrong, with that symbol left out (enumerating the
values it could have had instead would need 2^16 keys).  At a Jaccard similarity of 0.75 a
pair differs in 12 of 48 symbols on average, more than the 23 guaranteed with a chance of
about 1e-4, and meets in no key with a chance of about 1e-7.

Pairs are never expanded within a bucket of alike texts.  Each class first takes one star,
the least class of the buckets it shares most often; star links are confirmed on the full
sets and joined to components.  Then only classes of one bucket that are in different
components are still open: they try the bucket's largest component's star again.  What
remains open may be many texts that share some passages but are not near-duplicates, so
their pairs are not listed from the buckets; an exact prefix filter finds those that can
reach the similarity.  With shingles ordered rarest first, two such texts share one of the
first quarter of the larger's shingles that is among the first seventh of the smaller's.
The order is by counts in a fixed number of hash cells; any order serves as well for
exactness.  Pairs within a component are never formed.  Where more than PAIRWISE texts
share a prefix shingle, they are dealt into blocks of about BLOCK texts (fewer long ones:
about BLOCK_SHINGLES in all), each pair of blocks is one small group whose intersections are
counted as a matrix product, and only links come out, one for each pair of components.

Cases: null and empty texts have empty sets and link with nothing; rows with a null doc_id
are returned with a null component and kept; rows that repeat a doc_id are one node and are
linked by any of their texts, and of these rows ``drop_near_duplicates`` keeps the one with the
least text (nulls first; rows of one text are told apart by a hash of their other columns); an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import texthash
from ._shared import discard, fresh_path, open_fs, salt, stored, tidy, with_group_stats
from .components import components

SHINGLE = 5
CHUNKS, CHUNK, ERRORS = 12, 4, 1
SYMBOLS = CHUNKS * CHUNK
#: Hash cells in which the open texts' shingles are counted, to order them by rarity.
CELLS = 1 << 22
#: Texts of one prefix shingle whose pairs are listed; more are compared in blocks.
PAIRWISE = 48
BLOCK, BLOCK_SHINGLES = 512, 500_000
#: Within blocks, the texts of a shingle up to which their pairs are listed, and the columns of
#: a matrix product for the others.
FEW, TILE = 8, 4096
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75

_rng = np.random.default_rng(75)
_FLIP = _rng.integers(0, 1 << 32, (SYMBOLS, 1), dtype=np.uint32)
_TIMES = (_rng.integers(0, 1 << 31, (SYMBOLS, 1), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit symbols: the least of each permuted set, folded to 16 bits."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 65536):
        least = np.minimum(least, ((low[None, at : at + 65536] ^ _FLIP) * _TIMES).min(axis=1))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * CHUNK) keys: each chunk with one symbol left out."""
    chunks = signatures.reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
    keys = []
    for out in range(CHUNK):
        acc = np.zeros(chunks.shape[:2], np.uint64)
        for k in range(CHUNK):
            if k != out:
                acc = (acc << np.uint64(16)) | chunks[:, :, k]
        keys.append(texthash.mix(acc | (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(out)) << np.uint64(48)))
    return np.concatenate(keys, axis=1)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted distinct sets are as alike as ``percent`` of their union."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketch(batches):
    for batch in batches:
        offsets, data = texthash.buffers(batch.column(1))
        for lo, hi in texthash.slices(offsets):
            sets = texthash.shingle_sets(offsets[lo : hi + 1], data, SHINGLE)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_key", "sig"],
            )
    tidy()


def _keys(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        keys = chunk_keys(sigs)
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
        flat = keys.reshape(-1).view(np.int64)
        for at in range(0, len(flat), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(flat[at : at + 100_000]), pa.array(ids[at : at + 100_000])], names=["key", "id"])


def _sets(batches):
    for batch in batches:
        offsets, data = texthash.buffers(batch.column(1))
        for lo, hi in texthash.slices(offsets):
            sets = texthash.shingle_sets(offsets[lo : hi + 1], data, SHINGLE)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])
    tidy()


def _cells(batches):
    counts = np.zeros(CELLS, np.int32)
    for batch in batches:
        for raw in batch.column(1).to_pylist():
            counts[(np.frombuffer(raw, np.uint64) & np.uint64(CELLS - 1)).astype(np.int64)] += 1
    some = np.flatnonzero(counts)
    for at in range(0, len(some), 100_000):
        part = some[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(counts[part], pa.int64())], names=["cell", "n"])
    tidy()


@lru_cache(maxsize=1)
def _rarity(uri: str) -> np.ndarray:
    import pyarrow.parquet as pq

    files, root = open_fs(uri)
    table = pq.read_table(root, filesystem=files)
    counts = np.zeros(CELLS, np.int32)
    counts[table["cell"].to_numpy()] = np.minimum(table["n"].to_numpy(), 1 << 30)
    return counts


def prefixes(shingles: np.ndarray, rarity: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that a partner no larger must have one of, rarest first, and whether
    each is also among those that a partner no smaller must have one of."""
    n = len(shingles)
    seen = rarity[(shingles & np.uint64(CELLS - 1)).astype(np.int64)]
    order = np.lexsort((shingles, seen))
    probe = n - -(-percent * n // 100) + 1
    index = n - -(-2 * percent * n // (100 + percent)) + 1
    first = order[:probe]
    shared = seen[first] > 1  # a cell seen once holds a shingle of this text alone
    return shingles[first[shared]], (np.arange(len(first)) < index)[shared]


def _prefix_rows(uri: str):
    def run(batches):
        rarity = _rarity(uri)
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shingles = np.frombuffer(raw, np.uint64)
                key, index = prefixes(shingles, rarity)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(np.full(len(key), i, np.int64)), pa.array(np.full(len(key), len(shingles), np.int64)), pa.array(index)],
                    names=["key", "id", "size", "indexed"],
                )

    return run


def _prefix_members(known: DataFrame, sets: DataFrame, gone: list[DataFrame]) -> DataFrame:
    """(key, id, size, indexed): the prefixes of the texts that are still open; the table of
    their sets is added to ``gone``."""
    ids = known.select(F.col("id").alias("k_id")).distinct()
    open_sets = stored(sets.join(ids, F.col("id") == F.col("k_id"), "left_semi"), "nd-open")
    gone.append(open_sets)
    uri = fresh_path(open_sets.sparkSession, "nd-cells")
    open_sets.mapInArrow(_cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).write.parquet(uri)
    return open_sets.mapInArrow(_prefix_rows(uri), "key bigint, id bigint, size bigint, indexed boolean")


def _confirm(batches):
    for batch in batches:
        ok = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))
    tidy()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` whose full sets are alike."""
    a = sets.select(F.col("id").alias("a_id"), F.col("set").alias("a_set"))
    b = sets.select(F.col("id").alias("b_id"), F.col("set").alias("b_set"))
    met = pairs.join(a, F.col("u") == F.col("a_id")).drop("a_id").join(b, F.col("v") == F.col("b_id")).select("u", "v", "a_set", "b_set")
    return met.mapInArrow(_confirm, "u bigint, v bigint")


def _best_star(candidates: DataFrame) -> DataFrame:
    """For each u the v it meets in most keys (the least of these)."""
    counted = candidates.groupBy("u", "v").agg(F.count("*").alias("n"))
    return counted.groupBy("u").agg(F.max_by("v", F.struct("n", (-F.col("v")).alias("least"))).alias("v"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stored(docs.mapInArrow(_sketch, "doc_id bigint, n_shingles bigint, set_key binary, sig binary"), "nd-sketch")
    linked = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    tagged = stored(
        with_group_stats(linked, ["set_key"], [(F.min("doc_id").alias("rep"), F.min("rep").alias("rep"))], salt("doc_id")).select(
            "doc_id", "n_shingles", "set_key", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig")
        ),
        "nd-tagged",
    )
    reps = tagged.where("sig IS NOT NULL").select(F.col("rep").alias("id"), "sig").distinct()
    keys = reps.mapInArrow(_keys, "key bigint, id bigint")
    shared = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(F.col("key").alias("s_key"), "least")
    members = stored(keys.join(shared, F.col("key") == F.col("s_key")).select("key", "id", "least"), "nd-members")
    open_ids = members.select(F.col("id").alias("o_id")).distinct()
    texts = docs.join(open_ids, F.col("doc_id") == F.col("o_id"), "left_semi")
    sets = stored(texts.mapInArrow(_sets, "id bigint, set binary"), "nd-sets")

    stars = _best_star(members.where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")))
    gone = [members, sets]  # tables that are deleted in the end
    links = stored(_confirmed(stars, sets), "nd-links")
    gone.append(links)
    # rows of one doc_id with different texts tie their classes together
    torn = tagged.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u < v")
    torn = tagged.join(torn.select(F.col("doc_id").alias("t_id"), "u"), F.col("doc_id") == F.col("t_id")).where("rep > u").select(F.col("rep").alias("u"), F.col("u").alias("v"))
    links = links.unionByName(torn)
    label = components(links)

    known = stored(_labelled(members.select("key", "id"), label), "nd-known")
    stars = _best_star(known.where("component <> main").select(F.col("id").alias("u"), F.col("star").alias("v")))
    more = stored(_confirmed(stars, sets), "nd-links")
    links, label = _joined(links, label, more)
    gone += [known, more]
    known = stored(_labelled(members.select("key", "id"), label), "nd-known")
    gone.append(known)
    known = stored(_labelled(_prefix_members(known, sets, gone), label), "nd-known")
    gone.append(known)
    sized = known.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where(F.col("n") > PAIRWISE)
    sizes = sized.select(F.col("key").alias("b_key"), F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    crowded = stored(known.join(sizes, F.col("key") == F.col("b_key")).drop("b_key"), "nd-crowded")
    few = known.join(sizes, F.col("key") == F.col("b_key"), "left_anti")
    more = stored(_confirmed(_open_pairs(few), sets).unionByName(_block_links(crowded, sets)), "nd-links")
    links, label = _joined(links, label, more)
    discard(*gone, crowded, more)

    found = label.select(F.col("id").alias("l_id"), F.col("component").alias("l_component"))
    done = tagged.select("doc_id", "n_shingles", "rep").join(found, F.col("rep") == F.col("l_id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("l_component", "rep").alias("component_id")
    )
    alone = sketch.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _joined(links: DataFrame, label: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    if not more.limit(1).count():
        return links, label
    links = links.unionByName(more)
    return links, components(links)


def _labelled(members: DataFrame, label: DataFrame) -> DataFrame:
    """The members of those keys where several components meet, with their component and
    the key's largest one."""
    found = label.select(F.col("id").alias("l_id"), "component")
    known = members.join(found, F.col("id") == F.col("l_id"), "left").select(*members.columns, F.coalesce("component", "id").alias("component"))
    sized = known.groupBy("key", "component").agg(F.count("*").alias("n"), F.min("id").alias("star"))
    mixed = (
        sized.groupBy("key")
        .agg(F.count("*").alias("parts"), F.max_by(F.struct("component", "star"), F.struct("n", (-F.col("star")).alias("least"))).alias("main"))
        .where("parts > 1")
        .select(F.col("key").alias("m_key"), F.col("main.component").alias("main"), F.col("main.star").alias("star"))
    )
    return known.join(mixed, F.col("key") == F.col("m_key")).drop("m_key")


def _open_pairs(known: DataFrame) -> DataFrame:
    """Pairs of different components that may be alike: they share a prefix shingle, the
    smaller text's being an indexed one, and their sizes allow it."""
    side = known.where("component <> main").select("key", F.col("id").alias("u"), "component", "size", "indexed")
    other = known.select(F.col("key").alias("o_key"), F.col("id").alias("v"), F.col("component").alias("o_component"), F.col("size").alias("o_size"), F.col("indexed").alias("o_indexed"), (F.col("component") != F.col("main")).alias("o_side"))
    smaller = F.when(F.col("size") < F.col("o_size"), F.col("indexed")).when(F.col("size") > F.col("o_size"), F.col("o_indexed")).otherwise(F.col("indexed") | F.col("o_indexed"))
    alike = F.least("size", "o_size") * 100 >= F.greatest("size", "o_size") * PERCENT
    met = side.join(
        other,
        (F.col("key") == F.col("o_key")) & (F.col("component") != F.col("o_component")) & (~F.col("o_side") | (F.col("u") < F.col("v"))) & alike & smaller,
    )
    return met.select("u", "v").distinct()


def _alike(table: pa.Table) -> pa.Table:
    """Links between the two blocks of a group (or within one), one a pair of components."""
    first, second, block, ids, parts = (table[c].to_numpy() for c in ("first", "second", "block", "id", "component"))
    a, b = np.flatnonzero(block == first[0]), np.flatnonzero(block == second[0])
    chunks = table["set"].chunks  # read where they lie, without a copy
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in chunks for x in c]
    size = np.asarray([len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every = every[order]
    begins = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    seen = np.diff(np.append(begins, len(every)))  # texts of each shingle
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)[order]
    del every, order
    seen_at = np.repeat(seen, seen)
    # shingles of few texts: their pairs, one distance in the order after another
    n = len(sets)
    both = np.zeros(n * n, np.float32)
    few = np.flatnonzero((seen_at > 1) & (seen_at <= FEW))
    column = np.repeat(np.arange(len(seen), dtype=np.int32), seen)
    for step in range(1, FEW):
        at = few[few + step < len(owner)]
        at = at[column[at] == column[at + step]]
        if len(at):
            both += np.bincount(owner[at].astype(np.int64) * n + owner[at + step], minlength=n * n)
    both = both.reshape(n, n)
    both += both.T
    both = both[np.ix_(a, b)]
    # the others: a product of incidence matrices, some columns at a time
    at = np.flatnonzero(seen_at > FEW)
    owner, column = owner[at], (np.cumsum(seen > FEW) - 1).astype(np.int32)[column[at]]
    row_a, row_b = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    row_a[a], row_b[b] = np.arange(len(a)), np.arange(len(b))
    last = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, last, TILE):
        x, y = np.searchsorted(column, (lo, lo + TILE))
        half = []
        for row, m in ((row_a, len(a)), (row_b, len(b))):
            has = np.zeros((m, min(TILE, last - lo)), np.float32)
            on = row[owner[x:y]]
            has[on[on >= 0], column[x:y][on >= 0] - lo] = 1
            half.append(has)
        both += half[0] @ half[1].T
    ok = (100 * both >= PERCENT * (size[a][:, None] + size[b][None, :] - both)) & (parts[a][:, None] != parts[b][None, :])
    i, j = np.nonzero(ok)
    low, high = np.minimum(parts[a[i]], parts[b[j]]), np.maximum(parts[a[i]], parts[b[j]])
    _, one = np.unique(np.stack([low, high], axis=1), axis=0, return_index=True)
    tidy()
    return pa.table({"u": ids[a[i[one]]], "v": ids[b[j[one]]]})


def _block_links(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components among texts that share a crowded prefix shingle."""
    own = sets.select(F.col("id").alias("s_id"), "set")
    dealt = crowded.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "id", "component", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")
    )
    met = paired.join(own, F.col("id") == F.col("s_id")).drop("s_id")
    return met.groupBy("key", "first", "second").applyInArrow(_alike, "u bigint, v bigint")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates, all columns as they were."""
    found = stored(near_duplicates(docs), "nd-found")
    gone = found.where("NOT kept").select(F.col("doc_id").alias("g_id")).distinct()
    out = docs.join(gone, docs["doc_id"].cast("long") == F.col("g_id"), "left_anti")
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeated:
        plain = [c for c in out.columns if not isinstance(out.schema[c].dataType, T.MapType)]
        order = F.struct("text", F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
        same = out.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in out.columns]), order).alias("_row"))
        out = same.select("_row.*").unionByName(out.where("doc_id IS NULL"))
    return out
