import math
import os
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from strandloom.llm import registry

sys.path.insert(0, str(Path(__file__).parent))  # the brute-force versions of the text tests
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [docs.count()]
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), "test")
        if at < 3:
            assert docs.columns == before.columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] and counts[2] <= counts[3]
    assert corpus_pipeline.run(spark, DATA).count() == counts[-1]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got, want = registry.queries()[name](spark, DATA), con.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    rows = lambda df: sorted(tuple(str(v) for v in r) for r in df[columns].astype(object).where(df[columns].notna(), None).values.tolist())
    assert sorted(got.columns) == columns and rows(got.toPandas()) == rows(want)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_mix(rows, hashes, max_epochs=1.5):
    """doc_id -> copies: weights by the closed form, the last part of a pass from the permutation's head."""
    words = {i: len(words_of(t)) for i, t, _ in rows}
    by = {}
    for i, _, s in rows:
        if words[i]:
            by.setdefault(s, []).append(i)
    sums = {s: sum(words[i] for i in ids) for s, ids in by.items()}
    top, low = max(sums.values()), min(sums.values())
    a = max(0.0, 1 - math.log(max_epochs) / math.log(top / low)) if top > low else 0.0
    copies = {i: 1 for i, _, _ in rows}
    for s, ids in by.items():
        epochs = (top / sums[s]) ** (1 - a)
        if abs(epochs - round(epochs)) < 1e-9:
            epochs = round(epochs)
        left = (epochs - math.floor(epochs)) * sums[s]
        for i in sorted(ids, key=hashes.get):
            left -= words[i]
            copies[i] = math.floor(epochs) + (left >= -1e-6)
    return copies


def test_pipeline_equals_brute_force(spark):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from strandloom.llm import language_id, packing
    from test_text_operators import brute_components

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    judged = {r.doc_id: r for r in language_id.identify(docs).collect()}
    languages = len(language_id.fit(docs).languages)
    least = (1 / languages + language_id.REJECT_MARGIN * (1 - 1 / languages)) * (1 - 1e-6)
    rows = [r for r in docs.select("doc_id", "text", "source").collect() if judged[r.doc_id].lang_pred != "und" and judged[r.doc_id].score >= least]
    parts = brute_components([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if parts[r.doc_id][1] == r.doc_id]
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(7), "doc_id").alias("h")).collect()}
    copies = brute_mix([tuple(r) for r in rows], hashes)
    assert set(copies.values()) == {1, 2}
    tok, want = Tokenizer.from_file(packing.default_tokenizer_path()), Counter()
    tok.encode_special_tokens = False
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r.doc_id, p, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += copies[r.doc_id]
    got = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 2
