"""Near-duplicates, language ID, packing, mixing and language-model scores."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import language_id as L
from strandloom.llm import lattice_lm as M
from strandloom.llm import mixing, near_dup, packing, texthash

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))


def documents(spark, texts, lang=None, source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in texts], DOC)


def prose(rng, n, stem="abcdefgh"):
    return " ".join("".join(rng.choices(stem, k=rng.randint(2, 7))) for _ in range(n))


def brute_components(texts):
    sets, parent = {}, {}
    for i, t in texts:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[i] = i

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts(rng):
    texts, n = [], 0

    def add(t):
        nonlocal n
        texts.append((n, t))
        n += 1

    for _ in range(12):
        add(prose(rng, rng.randint(3, 120)))
    base = prose(rng, 90).split()
    for k in range(70):  # a crowded group around the similarity
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 999)}"
        add(" ".join(w))
    for t in (None, "", " \n\t", "one", "One", "a b c d", "A b  c\nd", "a b c d e", "x" * 5000, prose(rng, 9000)):
        add(t)
    add(texts[-1][1])
    add(texts[0][1].upper())
    return texts


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = near_texts(rng)
    want = brute_components(texts)
    for pairwise, block, shingles in ((48, 512, 1_000_000), (4, 16, 1_000_000), (4, 512, 300)):
        monkeypatch.setattr(near_dup, "PAIRWISE", pairwise)
        monkeypatch.setattr(near_dup, "BLOCK", block)
        monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", shingles)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(documents(spark, texts)).collect()}
        assert got == want


def test_near_duplicates_edges(spark):
    same = prose(random.Random(1), 30)
    rows = [(1, same), (1, same), (None, same), (7, same), (7, "quite another text with no copy here"), (9, "quite another text with no copy here"), (4, None)]
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dup.near_duplicates(documents(spark, rows)).collect())
    assert got == [(-1, None, True), (1, 1, True), (1, 1, True), (4, 4, True), (7, 1, False), (7, 1, False), (9, 1, False)]
    kept = near_dup.drop_near_duplicates(documents(spark, rows).withColumn("rep", pa_lit()).withColumn("key", pa_lit()))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4] and kept.columns[-2:] == ["rep", "key"]
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0


def test_of_rows_of_one_id_the_least_text_stays(spark):
    rows = [(1, "b b"), (1, "a a"), (1, "c c"), (2, None), (2, "z"), (3, "q w e r t y u"), (3, "q w e r t y u")]
    for parts in (1, 5):
        kept = near_dup.drop_near_duplicates(documents(spark, rows).repartition(parts)).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == [(1, "a a"), (2, None), (3, "q w e r t y u")]


def pa_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_prefix_filter_loses_no_pair():
    rng = np.random.default_rng(3)
    rarity = rng.integers(1, 50, near_dup.CELLS)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        keep = rng.random(len(a)) < 0.9
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 1 << 63, int(rng.integers(0, 8)), dtype=np.uint64)]))
        if len(b) and near_dup.similar(a, b):
            big, small = (a, b) if len(a) >= len(b) else (b, a)
            probe, _ = near_dup.prefixes(big, rarity)
            key, indexed = near_dup.prefixes(small, rarity)
            assert set(probe.tolist()) & set(key[indexed].tolist()) or (rarity[(big & np.uint64(near_dup.CELLS - 1)).astype(int)] == 1).any()


def test_blocks_equal_brute_force():
    rng = np.random.default_rng(1)
    for trial in range(60):
        n = int(rng.integers(1, 40))
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 60)), dtype=np.uint64))
        sets = []
        for _ in range(n):
            keep = base[rng.random(len(base)) < rng.choice([0.85, 0.95, 0.5])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, 6)), dtype=np.uint64), rng.choice(base, 1)])))
        second = int(trial % 3 > 0)  # two blocks, or one with itself
        block, part = rng.integers(0, second + 1, n), rng.integers(0, n, n)
        table = pa.table({"id": np.arange(n), "component": part, "block": block, "first": np.zeros(n, int), "second": np.full(n, second), "set": pa.array([x.tobytes() for x in sets], pa.binary())})
        links = near_dup._alike(table).to_pydict()
        pair = lambda i, j: tuple(sorted((part[i], part[j])))
        assert all(near_dup.similar(sets[i], sets[j]) for i, j in zip(links["u"], links["v"]))
        want = {pair(i, j) for i in range(n) for j in range(n) if block[i] == 0 and block[j] == second and part[i] != part[j] and near_dup.similar(sets[i], sets[j])}
        assert {pair(i, j) for i, j in zip(links["u"], links["v"])} == want


def test_pigeonhole_guarantee():
    rng = np.random.default_rng(9)
    limit = near_dup.ERRORS * near_dup.CHUNKS + near_dup.CHUNKS - 1
    for _ in range(200):
        a = rng.integers(0, 1 << 16, near_dup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(near_dup.SYMBOLS, limit, replace=False)
        b[at] ^= 1
        ka, kb = near_dup.chunk_keys(np.stack([a, b]))
        assert set(ka.tolist()) & set(kb.tolist())


def test_word_hashes_do_not_depend_on_place():
    texts = ["The cat", None, "", "cat\tTHE\x0bcat", "é cat", "the"]
    offsets, data = texthash.buffers(pa.array(texts))
    h, row, start, end = texthash.words(offsets, data)
    assert [data[s:e].tobytes().decode() for s, e in zip(start, end)] == ["The", "cat", "cat", "THE", "cat", "é", "cat", "the"]
    assert row.tolist() == [0, 0, 3, 3, 3, 4, 4, 5]
    assert h[0] == h[3] == h[7] and h[1] == h[2] == h[4] == h[6] and len(set(h.tolist())) == 3
    part = texthash.words(offsets[3:5], data)[0]
    assert part.tolist() == h[2:5].tolist()


def thue_morse(n=2048):
    """Two words that any polynomial hash modulo 2^64 takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_one_hash_stay_apart(spark, monkeypatch):
    from tokenizers import Tokenizer

    a, b = thue_morse()
    offsets, data = texthash.buffers(pa.array([f"{a} {b}"]))
    h = texthash.words(offsets, data)[0]
    assert h[0] != h[1]
    texts = [(0, a), (1, b), (2, f"q r s t {a}"), (3, f"q r s t {b}"), (4, a.upper())]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}

    rng = random.Random(3)
    mixed = [prose(rng, 200, "abé").replace("a", rng.choice("aA")) for _ in range(6)] + [f"{a} {b}, {a}.", "x" * 3000 + " " + "x" * 2999 + "y", "Ab aB ab ba"]
    path = packing.default_tokenizer_path()
    tok = Tokenizer.from_file(path)
    plain = texthash.span_hashes
    for few in (None, 4, 1):  # with few different hashes the bytes alone tell words apart
        monkeypatch.setattr(texthash, "span_hashes", plain if few is None else lambda *x, few=few: plain(*x) % np.uint64(few))
        offsets, data = texthash.buffers(pa.array(mixed))
        for lo, hi, ids, ends in packing.encode_rows(offsets, data, path):
            for text, own in zip(mixed[lo:hi], np.split(ids, ends[:-1])):
                assert own.tolist() == tok.encode(text, add_special_tokens=False).ids
        h, _, start, end = texthash.words(offsets, data)
        first, inverse = texthash.exact_groups(h, start, end, data)
        word = [data[x:y].tobytes().lower() for x, y in zip(start, end)]
        assert [word[i] for i in first[inverse]] == word and len(first) == len(set(word))


def test_language_gradient_is_right():
    rng = np.random.default_rng(0)
    model = L.train([], ["a", "b"], hidden=3)
    model = L.Model(model.languages, *(p.astype(np.float64) for p in model.params()))
    rows = rng.integers(97, 103, (7, 4)).astype(np.uint8)
    mask, target = (rng.random((7, 4)) < 0.8).astype(np.float32), np.asarray([0, 1, 1, 0])
    loss, grads = L._gradient(model, rows, mask, target)
    for p, g in zip(model.params(), grads):
        flat = np.argsort(-np.abs(g).ravel())[:5]
        for i in flat:
            old = p.flat[i]
            p.flat[i] = old + 1e-2
            up = L._gradient(model, rows, mask, target)[0]
            p.flat[i] = old - 1e-2
            down = L._gradient(model, rows, mask, target)[0]
            p.flat[i] = old
            assert math.isclose((up - down) / 2e-2, g.flat[i], rel_tol=0.03, abs_tol=2e-4)


def test_language_identification(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        lang, stem = [("xx", "abcde"), ("yy", "stuvé")][i % 2]
        rows.append((i, prose(rng, rng.randint(5, 80), stem), lang if i % 7 else None, "s", 1))
    rows += [(900, None, "xx", "s", 0), (901, "", "xx", "s", 0), (902, "12 !! ..", "yy", "s", 0), (903, prose(rng, 30_000, "abcde"), "xx", "s", 0), (None, "abc abc abc", "xx", "s", 0)]
    docs = spark.createDataFrame(rows, DOC).withColumn("score", pa_lit()).withColumn("held_out", pa_lit())
    got = L.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == len(rows)
    for i in range(240):
        assert found[i].lang_pred == ["xx", "yy"][i % 2] and 0 <= found[i].score <= 1 and found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [found[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "xx", "xx"]
    kept = L.drop_rejected(docs)
    assert kept.columns == docs.columns and kept.count() == 242
    none = L.identify(docs.where("doc_id > 899").withColumn("lang", pa_lit_null()))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert L.identify(docs.limit(0)).count() == 0


def pa_lit_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")


def test_every_language_is_learned(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, prose(rng, 5) if i % 3 else "12 !!", f"l{i % 300:03d}", "s", 1) for i in range(1, 3600)]
    rows += [(10_000 + i, "12 !!" if i < 40 else prose(rng, 5), "rare", "s", 1) for i in range(60)]
    taken = []
    monkeypatch.setattr(L, "train", lambda texts, labels: taken.extend(labels) or L.Model(sorted(set(labels)), *[None] * 4))
    lettered = {r[2] for r in rows if "12" not in r[1] and zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert len(lettered) == 201  # more than the sample has room for below
    docs = spark.createDataFrame(rows, DOC)
    for options, most in (({}, 500), ({"sample_docs": 900}, 2), ({"sample_docs": 50}, 1)):
        taken.clear()
        assert set(L.fit(docs, **options).languages) == lettered == set(taken)
        assert max(Counter(taken).values()) <= most * L.WINDOWS_PER_DOC
    # with room for 300 languages and more, none is left out
    many = spark.createDataFrame([(i, prose(rng, 5), f"l{i % 300:03d}", "s", 1) for i in range(6000)], DOC)
    assert len(L.fit(many).languages) == 300


def test_slices_shrink_with_many_languages():
    rng = np.random.default_rng(1)
    few = L.train([], ["a", "b"], hidden=3)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 5, 64, 700, 3)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    whole = L.document_probabilities(few, offsets, data)
    many = L.Model([str(i) for i in range(400_000)], few.x, few.u, few.v, few.b)
    assert np.allclose(L.document_probabilities(many, offsets, data)[:, :2], whole[:, :2])
    assert [r for r in L._slices(offsets, 2)] == [(0, 5)] and [r for r in L._slices(offsets, 1_280_000)] == [(0, 2), (2, 4), (4, 5)]


def test_nothing_is_judged_without_a_learned_language(spark):
    rows = [(1, "ab cd.", None, "s", 1), (2, None, None, "s", 0), (3, "12 !!", None, "s", 0), (4, "", None, "s", 0), (None, "é", None, "s", 1), (1, "ab cd.", None, "s", 1)]
    docs = spark.createDataFrame(rows, DOC)
    kept = L.drop_rejected(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.text in ("ab cd.", "é"))
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    only = spark.createDataFrame([(held, "ab cd.", "xx", "s", 1)], DOC)
    assert [r.doc_id for r in L.drop_rejected(only).collect()] == [held] and L.drop_rejected(docs.limit(0)).count() == 0


def naive_probabilities(model, raw):
    """Mean probabilities of a text, byte by byte, from single states."""
    sigmoid = lambda a: 1 / (1 + np.exp(-a))

    def state(side, seen):
        x, u = model.x[side].astype(float), model.u[side].astype(float)
        k = u.shape[1]
        h = np.zeros(k)
        for c in seen:
            rec = u @ h
            z, r = sigmoid(x[c, :k] + rec[:k]), sigmoid(x[c, k : 2 * k] + rec[k : 2 * k])
            n = np.tanh(x[c, 2 * k :] + r * rec[2 * k :])
            h = n + z * (h - n)
        return h

    total = 0
    for i in range(len(raw)):
        lo = i // L.WINDOW * L.WINDOW
        before = raw[max(0, lo - L.CONTEXT) : i + 1]
        behind = raw[i : min(len(raw), lo + L.WINDOW + L.CONTEXT)]
        logits = model.v @ np.concatenate([state(0, before), state(1, behind[::-1])]) + model.b
        p = np.exp(logits - logits.max())
        total = total + p / p.sum()
    return total / max(1, len(raw))


def test_windows_equal_a_network_by_position():
    rng = np.random.default_rng(8)
    model = L.train([], ["a", "b", "c"], hidden=3)
    sizes = [0, 1, 2, 31, 191, 192, 193, 230, 400, 700]
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in sizes]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    got = L.document_probabilities(model, offsets, np.frombuffer(b"".join(texts), np.uint8))
    assert np.allclose(got, [naive_probabilities(model, t) if t else np.zeros(3) for t in texts], atol=1e-5)


def test_windows_end_at_characters():
    text = "aé日本𝄞z".encode() * 3
    for a in range(len(text)):
        for b in range(a, len(text) + 1):
            cut = L._at_characters(text[a:b])
            assert cut in text[a:b] and (len(text[a:b]) < 8 or len(cut) >= b - a - 6)
            cut.decode()


def test_held_out_accuracy_on_the_given_tables(spark):
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.isfile(path):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(path)
    judged = L.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    right, seen = Counter(r.lang for r in judged if r.lang == r.lang_pred), Counter(r.lang for r in judged)
    assert len(seen) == 4 and min(seen.values()) >= 15 and all(right[x] / n >= 0.93 for x, n in seen.items())


def test_two_languages_and_one_are_judged(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30, ["abcde", "stuvw"][i % 2]), ["xx", "yy"][i % 2], "s", 1) for i in range(120)]
    rows += [(500, prose(rng, 30, "klmnoäöü"), None, "s", 1), (501, "7 8 9", None, "s", 1)]
    docs = spark.createDataFrame(rows, DOC)
    assert {r.doc_id for r in L.drop_rejected(docs).collect()} >= set(range(120))
    assert {r.doc_id for r in L.drop_rejected(docs, margin=0.999).collect()} <= set(range(120))
    one = docs.withColumn("lang", F_lit_if_known())
    assert {r.doc_id for r in L.drop_rejected(one).collect()} == {*range(120), 500}


def F_lit_if_known():
    from pyspark.sql import functions as F

    return F.when(F.col("lang").isNotNull(), F.lit("xx"))


def test_equal_texts_get_equal_labels(spark):
    rng = random.Random(4)
    text = prose(rng, 50)
    rows = [(i, text if i % 3 == 0 else prose(rng, rng.randint(1, 60)), "xx" if i % 2 else "yy", "s", 1) for i in range(90)]
    got = [r for r in L.identify(spark.createDataFrame(rows, DOC)).collect() if r.doc_id % 3 == 0]
    assert len({r.lang_pred for r in got}) == 1 and max(r.score for r in got) - min(r.score for r in got) < 1e-5


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = ["ΣΑΣ. ΌΔΟΣ, İstanbul Å ß ẞ", "a,, b.. .c ,d ..", "x y z\tw\r\nq", "it's IT'S don't, 12 1a2b", "<|endoftext|> a<|startoftext|>b", "", "\n\n", "ﬁ ½ ² ǅ ŉ", "é É. \u0301x", "日本語。テスト, ok", "A. B, c.d. E"]
    texts += ["×a a× ÷. É,É é., ÀÉÎÕÜßÿ. ẞ. a" * 3, "Word word, WORD. wOrd", "\x0b\x0cq\x1cz\u00a0y\u2003x", "z" * 50 + " " + "é" * 21 + ". " + "é" * 20]
    for group in (texts, [t for t in texts if "<|" not in t]):
        offsets, data = texthash.buffers(pa.array(group + [None]))
        for lo, hi, ids, ends in packing.encode_rows(offsets, data, path):
            got = np.split(ids, ends[:-1])
            for text, own in zip((group + [""])[lo:hi], got):
                assert own.tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_packing_places_every_piece(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = [(i, prose(rng, rng.randint(0, 300))) for i in range(60)] + [(60, None), (61, ""), (5, "again"), (62, prose(rng, 6000)), (None, "no id")]
    docs = documents(spark, texts).withColumn("piece", pa_lit())
    rows = packing.pack_documents(docs, keep_ids=True).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer_path())
    want = Counter()
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, p, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == r.length
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 2048) + 1
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_plan_bins_is_whole_and_tight():
    rng = random.Random(3)
    for _ in range(60):
        hist = {rng.randint(1, 100): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        slots = packing.plan_bins(hist, 100)
        seen, bins = {}, {}
        for n, first, times, base, offset in slots:
            assert first == seen.get(n, 0)
            seen[n] = first + times
            for k in range(times):
                bins.setdefault(base + k, []).append((offset, n))
        assert seen == hist
        for parts in bins.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 100
        assert len(bins) <= 2 * sum(n * c for n, c in hist.items()) / 100 + 1


def test_two_fit_replaces_the_smallest():
    # greedy takes 60 and 35, which leaves 5; two pieces of 20 fill the 40 instead of the 35
    slots = packing.plan_bins({60: 1, 35: 1, 20: 2}, 100)
    first_bin = sorted(n for n, _, times, base, _ in slots for k in range(times) if base + k == 0)
    assert first_bin in ([20, 20, 60],)


def brute_mix(rows, max_epochs):
    sums = Counter()
    for _, text, _, source, _ in rows:
        sums[source] += len(words_of(text))
    sums = {s: n for s, n in sums.items() if n}
    total = sum(sums.values())
    p = {s: n / total for s, n in sums.items()}
    top, low = max(p.values()), min(p.values())
    a = max(0.0, 1 - math.log(max_epochs) / math.log(top / low)) if top > low else 0.0
    z = sum(v**a for v in p.values())
    return {s: v**a / z for s, v in p.items()}, {s: (top / v) ** (1 - a) for s, v in p.items()}


def test_mixing(spark):
    rng = random.Random(12)
    sizes = {"big": 300, "mid": 120, "low": 60, None: 40}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, prose(rng, rng.randint(1, 30)), None, s, 1))
            i += 1
    rows += [(9000, None, None, "low", 0), (9001, "  ", None, "blank", 0), (3, rows[3][1], None, "big", 1)]
    docs = spark.createDataFrame(rows, DOC)
    got = mixing.mix_sources(docs, max_epochs=2.0).collect()
    assert len(got) == len(rows)
    weight, epochs = brute_mix(rows, 2.0)
    used, have = Counter(), Counter()
    for r in got:
        have[r.source] += r.n_tokens
        used[r.source] += r.n_tokens * r.copies
        if r.n_tokens:
            assert math.isclose(r.weight, weight[r.source], rel_tol=1e-6) and math.isclose(r.epochs, epochs[r.source], rel_tol=1e-6)
            assert r.copies in (math.floor(r.epochs), math.floor(r.epochs) + 1)
        else:
            assert r.copies == 1
    for s, e in epochs.items():
        assert e * have[s] - 30 <= used[s] <= e * have[s] + 1e-6 * have[s]
    copied = mixing.mixed_documents(docs.withColumn("weight", pa_lit()).withColumn("copies", pa_lit()), max_epochs=2.0)
    assert copied.columns == docs.columns + ["weight", "copies"] and copied.count() == sum(r.copies for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_to_an_entropy_and_a_budget(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 20), None, "abc"[min(2, i % 10 // 4)], 1) for i in range(200)]
    docs = spark.createDataFrame(rows, DOC)
    got = mixing.mix_sources(docs, max_epochs=None, entropy=1.05, budget=3000).collect()
    w = {r.source: r.weight for r in got}
    assert math.isclose(-sum(v * math.log(v) for v in w.values()), 1.05, abs_tol=1e-5)
    assert 3000 - 60 <= sum(r.copies * r.n_tokens for r in got) <= 3000
    placed = mixing.realise(mixing.mix_sources(docs, max_epochs=2.0)).collect()
    assert all(0 <= r.position <= 1 + 1e-9 for r in placed if r.epochs == int(r.epochs))


def test_a_target_out_of_reach_is_told(spark):
    docs = spark.createDataFrame([(i, "a b c", None, "ab"[i % 2], 1) for i in range(20)], DOC)
    with pytest.raises(ValueError, match="entropy"):
        mixing.mix_sources(docs, max_epochs=None, entropy=0.5)  # two equal sources always have ln 2
    with pytest.raises(ValueError, match="epochs"):
        mixing.mix_sources(docs, max_epochs=0.5)


def test_counted_tokens_mix_alike(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", " \n"]) if i % 17 == 0 else prose(rng, rng.randint(1, 30)), None, rng.choice("aaaabbc"), 1) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC)
    columns = ["doc_id", "source", "n_tokens", "weight", "epochs", "copies", "block"]
    want = sorted(map(str, mixing.mix_sources(docs).select(columns).collect()))
    assert sorted(map(str, mixing.mix_sources(mixing.token_table(docs), tokens="n_tokens").select(columns).collect())) == want


def test_copies_have_positions_at_the_weights(spark, tmp_path):
    from strandloom.llm import registry

    rng = random.Random(9)
    rows = [(i, prose(rng, 10), None, "a" if i % 4 else "b", 1) for i in range(4000)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op7_temperature_mixing(spark, str(tmp_path)).collect()
    copies = {r.doc_id: r.copies for r in got}
    assert Counter(r.doc_id for r in got) == copies and len(copies) == len(rows) and set(copies.values()) == {1, 2}
    assert {(r.doc_id, r.copy) for r in got} == {(d, c) for d, n in copies.items() for c in range(n)}
    assert all(0 <= r.position <= 1.05 for r in got)
    share = sum(r.source == "b" for r in got) / len(got)
    for k in range(5):
        part = [r.source == "b" for r in got if k / 5 <= r.position < (k + 1) / 5]
        assert abs(sum(part) / len(part) - share) < 0.06


def test_language_model(spark):
    rng = random.Random(8)
    texts = [(i, prose(rng, rng.randint(0, 40), "abcé")) for i in range(80)] + [(80, None), (81, ""), (82, "Z" * 3000 + " ab"), (2, "aa bb"), (None, "ab Ab")]
    docs = documents(spark, texts).withColumn("h", pa_lit()).withColumn("score", pa_lit())
    count, n_train = Counter(), 0
    tokens = [(i, words_of(t) + [None]) for i, t in texts]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for i, w in tokens:
        if not held(i):
            count.update(w)
    n, v = sum(count.values()), len(count)
    for frequent in (0, 5, 10**6):  # the split into looked-up and joined words changes nothing
        got = M.score_documents(docs, frequent=frequent).collect()
        assert len(got) == len(texts)
        want = sorted((str(i), held(i), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens)
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
        scores = sorted((str(r.doc_id), round(r.score, 6)) for r in got)
        assert frequent == 0 or scores == before
        before = scores
    assert M.score_documents(docs.limit(0)).count() == 0


def test_lattice_equals_enumeration():
    path = M.default_vocabulary_path()
    logp = M.zipf(len(M.vocabulary(path).pieces))
    lattice = M.Lattice(path, logp)

    def paths(word):
        if not word:
            yield 1.0
            return
        for rest in paths(word[1:]):
            yield math.exp(M._byte_logp(word[0])) * rest
        for k in range(1, len(word) + 1):
            piece = lattice.vocab.ids.get(word[:k])
            if piece is not None:
                for rest in paths(word[k:]):
                    yield math.exp(logp[piece]) * rest

    words = ["the", "of", "zżó", "日本", "a", "qx"]
    expected, again = np.zeros(len(logp)), np.zeros(len(logp))
    got = lattice.scores(words, np.ones(len(words)), expected)
    assert np.allclose(got, [math.log(sum(paths(M.MARK + w))) for w in words])
    singles = [lattice._single(M.MARK + w, 1.0, again) for w in words]
    assert np.allclose(singles, got) and np.allclose(expected, again)
    long = "ab" * 40
    assert math.isclose(lattice.scores([long])[0], lattice._single(M.MARK + long, None, None), rel_tol=1e-12)


def test_scores_equal_enumeration_of_whole_texts(spark):
    """Score and fitted score by the sums over all segmentations of every word, the fitted pieces
    by their expected uses in these."""
    texts = [(i, t) for i, t in enumerate(["the cat", "The the of", "a żó a", "qx 日", "", "of of of the", "cat", "tha", "co of", "A b"])]
    path = M.default_vocabulary_path()
    vocab = M.vocabulary(path)
    ranks = -vocab.scores
    assert (ranks == np.floor(ranks)).all()  # merge ranks
    weight = 1 / (ranks + 10)
    own = dict(zip(vocab.pieces, weight / weight.sum() * (1 - M.BYTE_MASS)))

    def paths(word, p):
        """(probability, pieces) of every segmentation."""
        if not word:
            yield 1.0, ()
            return
        for rest, used in paths(word[1:], p):
            yield (M.BYTE_MASS / 256) ** len(word[0].encode()) * rest, used
        for k in range(1, len(word) + 1):
            if word[:k] in p:
                for rest, used in paths(word[k:], p):
                    yield p[word[:k]] * rest, (word[:k], *used)

    held = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    train = [w for i, t in texts if i not in held for w in words_of(t)]
    ends, uses = len(texts) - len(held), Counter()
    for w in train:
        every = list(paths(M.MARK + w, own))
        total = sum(q for q, _ in every)
        for q, used in every:
            for piece in used:
                uses[piece] += q / total
    whole = sum(uses.values()) + ends + M.PSEUDO * (len(own) + 1)
    end = (ends + M.PSEUDO) / whole
    fitted = {x: (uses[x] + M.PSEUDO) / whole * (1 - M.BYTE_MASS) for x in own}
    scaled = {x: v * (1 - end) for x, v in own.items()}
    assert math.isclose(sum(scaled.values()) + (end + M.BYTE_MASS / (1 - M.BYTE_MASS)) * (1 - M.BYTE_MASS), 1, rel_tol=1e-9)
    for frequent in (0, 3, 100):
        for r in M.score_documents(documents(spark, texts), frequent=frequent).collect():
            for got, p in ((r.score, scaled), (r.fitted_score, fitted)):
                want = math.log10(end * (1 - M.BYTE_MASS)) + sum(math.log10(sum(q for q, _ in paths(M.MARK + w, p))) for w in words_of(texts[r.doc_id][1]))
                assert math.isclose(got, want, rel_tol=1e-9), (r, want)


def test_log_probabilities_of_a_unigram_file():
    vocab = M.Vocabulary.__new__(M.Vocabulary)
    vocab.scores = np.asarray([-1.5, -2.25, -7.0])
    p = np.exp(M.own_logp(vocab))
    assert math.isclose(p.sum(), 1 - M.BYTE_MASS) and np.allclose(p / p[0], np.exp(vocab.scores + 1.5))


def test_scores_of_words_of_one_hash(spark, monkeypatch):
    a, b = thue_morse()
    rng = random.Random(3)
    texts = [(i, " ".join([rng.choice([a, b, "ab", "ba", "Ab", "c"]) for _ in range(rng.randint(1, 12))])) for i in range(40)]
    want = [tuple(r) for r in M.score_documents(documents(spark, texts)).orderBy("doc_id").collect()]
    count = Counter(w for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*words_of(t), None])
    n, v = sum(count.values()), len(count)
    for (i, t), r in zip(texts, want):
        assert math.isclose(r[5], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*words_of(t), None]), rel_tol=1e-9)
    # as if all words had one of two hashes: the bytes tell them apart
    words, plain = sorted({w for _, t in texts for w in words_of(t)}), texthash.span_hashes
    monkeypatch.setattr(texthash, "span_hashes", lambda *x: plain(*x) % np.uint64(2))
    import pyarrow.parquet as pq
    import tempfile

    folder = tempfile.mkdtemp()
    pq.write_table(pa.table({"word": words, "c": [count[w] for w in words], "own": np.arange(len(words)) * 1.0, "fitted": np.zeros(len(words))}), f"{folder}/a.parquet")
    known = M._Frequent(f"file://{folder}")
    column = pa.array([t for _, t in texts] + ["not there"])
    _, data = texthash.buffers(column)
    for _, _, _, _, h, start, end in M._groups(column):
        place = known.find(h, data, start, end)
        for p, s, e in zip(place, start, end):
            word = data[s:e].tobytes().decode().lower()
            assert (words[int(known.logs[0][p])] == word) if p >= 0 else word in ("not", "there")


def test_ranks_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 3)
    rows = [(i, 0, 0, 5 + i % 3, i) for i in range(900)]
    pieces = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    for per_slice in (20_000, 30):
        placed = packing.place(pieces, 20, per_slice).collect()
        assert len(placed) == 900 and len({(r.sequence_id, r.offset) for r in placed}) == 900
        by = Counter()
        for r in placed:
            by[r.sequence_id] += r.length
        assert max(by.values()) <= 20


def test_stored_tables_are_deleted_when_told(spark):
    import os

    from strandloom.llm import _shared

    table = _shared.stored(spark.range(5), "test-discard")
    path = _shared._places[id(table)][1].removeprefix("file://")
    assert os.path.isdir(path) and table.count() == 5
    _shared.discard(spark.range(3), table.select("id"))
    assert os.path.isdir(path)
    _shared.discard(table)
    assert not os.path.isdir(path)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from strandloom.llm import _shared

    conf = SimpleNamespace(get=lambda key: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _shared.shared_dir(cluster)
