"""HTML extraction, url rules, WARC, search and media."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import cover_search, html_extract, media, url_filter, warc
from strandloom.llm.registry import URL_RULES

PAGE = "page_id bigint, url string, html string"


def test_sum_product_equals_enumeration():
    rng = np.random.default_rng(1)
    parent = np.asarray([-1, 0, 0, 1, 1, 2, -1, 6])
    kind = rng.integers(0, 4, len(parent))
    phi, psi = rng.normal(size=(len(parent), 2)), rng.normal(size=(4, 2, 2))
    weight = np.zeros((len(parent), 2))
    pairs = np.zeros((len(parent), 2, 2))
    for y in itertools.product((0, 1), repeat=len(parent)):
        s = sum(phi[i, y[i]] for i in range(len(y))) + sum(psi[kind[i], y[parent[i]], y[i]] for i in range(len(y)) if parent[i] >= 0)
        for i in range(len(y)):
            weight[i, y[i]] += np.exp(s)
            if parent[i] >= 0:
                pairs[i, y[parent[i]], y[i]] += np.exp(s)
    node, pair = html_extract.sum_product(phi, psi, parent, kind)
    assert np.allclose(node, weight / weight.sum(axis=1, keepdims=True))
    has = parent >= 0
    assert np.allclose(pair[has], pairs[has] / pairs[has].sum(axis=(1, 2), keepdims=True))


def test_extraction_on_unseen_layouts():
    model = html_extract.default_model()
    pages = html_extract.labelled_pages(120, seed=991)
    doms = [html_extract.parse(p, True) for p in pages]
    odds, label, size = model.marginals(doms), np.asarray([v for d in doms for v in d.label]), np.asarray([v for d in doms for v in d.own])
    right = (odds >= 0.5) == label
    assert right.mean() > 0.95 and (right * size).sum() / size.sum() > 0.93


PAGE_HTML = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- x --><div class="ad">Buy this now.</div>
<article><h1>Caf&eacute; &amp; bar</h1><p><b>One  two</b>\nthree.<br><p>Fo<i>u</i>r &lt;five&gt;.</article>
<section class="comments"><p>Nice post, thanks a lot.</p></section><form><label>Mail</label><input></form><footer>&copy; us</footer>"""


def test_extraction(spark):
    deep = "<div>" * 3000 + "<article><p>Deep text here, really.</p></article>" + "</div>" * 3000
    long = "<article>" + "<p>Some words in a row, and more of them.</p>" * 20_000 + "</article>"
    rows = [(1, "u", PAGE_HTML), (2, None, None), (3, "v", ""), (None, "w", PAGE_HTML), (1, "u", PAGE_HTML), (5, "x", deep), (6, "y", long), (7, "z", "<p <b> ' \" unclosed"), (8, "z", "<script>never closed")]
    pages = spark.createDataFrame(rows, PAGE).withColumn("text", F.lit("clash"))
    got = html_extract.extract_pages(pages).collect()
    want = "Café & bar One two three. Four <five>."
    assert [r.text for r in got if r.page_id in (1, None)] == [want] * 3 and all(r.n_chars == len(r.text) for r in got)
    found = {r.page_id: r.text for r in got}
    assert found[2] == found[3] == found[8] == "" and found[5] == "Deep text here, really." and len(found[6]) == 20_000 * 38 + 19_999
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_head_without_end_tag(spark):
    body = PAGE_HTML[PAGE_HTML.index("<nav>"):]
    heads = [
        PAGE_HTML.replace("</head>", ""), PAGE_HTML.replace("</head><body>", ""), PAGE_HTML.replace("<html><head>", "<head><html><head>").replace("</head>", ""),
        "<head><meta charset=x><link rel=y><noscript><img src=z><p>None here.</p></noscript><template><div>Nor here, no.</div></template>\n<body>" + body,
        "<head><title>T</title><noscript>Never ended.<body>" + body, "<head><title>T</title></br>" + body, "<head><title>T</title><img src=z>" + body,
    ]
    bare = ["<head><title>T</title>Bare text, as it stands here.", "<head><title>T</title><!-- x --></body>Bare text, as it stands here.", "<head><title>T</title>\n<b>Bare</b> text, as it stands here."]
    same = ["<head><title>T</title></head>" + b[b.index("</title>") + 8 :] for b in bare]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(heads + bare + same)], PAGE)
    found = [r.text for r in sorted(html_extract.extract_pages(pages).collect(), key=lambda r: r.page_id)]
    assert found[: len(heads)] == ["Café & bar One two three. Four <five>."] * len(heads)
    assert found[len(heads) : len(heads) + 3] == found[len(heads) + 3 :]
    assert all(html_extract.parse(b).pieces and "".join(t for n, t in html_extract.parse(b).pieces if n >= 0).strip() == "Bare text, as it stands here." for b in bare)
    made, model = html_extract.labelled_pages(40, seed=5), html_extract.default_model()
    assert html_extract.extract([p.replace("</head>", "") for p in made], model) == html_extract.extract(made, model)


def brute_text(page, model):
    """The text of a small page by enumeration of all its labellings."""
    dom = html_extract.parse(page)
    x, parent, kind = html_extract.features([dom])
    n, score = len(parent), x @ model.weights
    total, own = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(score[i] * y[i] for i in range(n)) + sum(model.pairs[kind[i], y[parent[i]], y[i]] for i in range(n) if parent[i] >= 0))
        total += w
        own += w * np.asarray(y)
    return " ".join("".join(t if i < 0 or own[i] >= total / 2 else " " for i, t in dom.pieces).split())


def test_small_pages_equal_enumeration():
    model = html_extract.default_model()
    pages = [p for p in html_extract.labelled_pages(150, seed=21, bare_pages=60) if 0 < len(html_extract.parse(p).tag) <= 13]
    pages += [PAGE_HTML, "Text only.", "<p>One.<p>Two, in more words."]
    assert len(pages) > 40
    assert html_extract.extract(pages, model) == [brute_text(p, model) for p in pages]


def test_labels_are_read_in_fitting_only(spark):
    odd = ["top", "12.5", "0", "1", "", "é"]
    plain = "<article><h1>Title of it</h1><p>Words in a row, and more of them.</p></article><footer>&copy; us</footer>"
    rows = [(i, "u", plain.replace("<article", f'<article data-y="{y}"').replace("<footer", f'<footer data-y="{y}"')) for i, y in enumerate(odd)]
    got = html_extract.extract_pages(spark.createDataFrame([*rows, (9, "u", plain), (10, "u", html_extract.BARE + plain)], PAGE)).collect()
    assert {r.text for r in got} == {"Title of it Words in a row, and more of them."}
    assert [html_extract.parse(h).label for _, _, h in rows] == [[0] * 5] * len(rows)


def test_pages_without_containers(spark):
    texts = {
        "Just some plain text, no tags at all.": None, "one &amp; two": "one & two", "Line one.<br>Line two, longer.": "Line one. Line two, longer.",
        "<p>One paragraph here.<p>Two, with more words in it.": "One paragraph here. Two, with more words in it.", "<p>Hi</p>": "Hi",
        "<html><body>Text in the body only. And more.</body></html>": "Text in the body only. And more.",
        "<html><head><title>T</title></head><body><h1>Title here</h1><p>A bare paragraph, with words.</p></body></html>": "Title here A bare paragraph, with words.",
    }
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(texts)], PAGE)
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert [got[i] for i in range(len(texts))] == [w or h for h, w in texts.items()]


def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", "", None, "allow"
    host = m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fit = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and m[2].startswith(p)]
    return (host, m[2], *(max(fit)[1:] if fit else (None, "allow")))


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://example.com", "http://example.com/", "http://EXAMPLE.com/en/x?q#f", "https://www.example.com/en/1", "https://a.www.example.com/en/1", "http://x.net/es/", "http://x.net/es", "http://net/fr/1", "http://notexample.com/en/", "http://example.com/en", "http://ex#a/en/", "http://x?y/z", "a://b://c.com/", "http://É.com/ü", "http://example.com/en/" + "a" * 100_000, "http://.com/", "http://com./"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)] + [(None, urls[5], ""), (5, urls[5], "")], PAGE).withColumn("host", F.lit("clash"))
    for r in url_filter.filter_urls(pages, URL_RULES).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_rule(urls[5 if r.page_id is None else r.page_id])
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, [], default="block").collect()} == {"block"}


def test_urls_in_several_parts(spark):
    rng = random.Random(3)
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h in ("a.b", "b", "c.a.b", "d") for p in ("/", "/x/", "/x/y/")}.values())
    pages = spark.createDataFrame([(i, f"http://{rng.choice(['a.b', 'z.c.a.b', 'b', 'q.d', 'e'])}{rng.choice(['', '/', '/x/', '/x/y/z', '/w'])}", "") for i in range(200)], PAGE)
    whole = sorted(map(tuple, url_filter.filter_urls(pages, rules).collect()))
    assert sorted(map(tuple, url_filter.filter_urls(pages, rules, max_index_bytes=120).collect())) == whole


def test_colliding_digests_are_told_apart(tmp_path):
    url_filter.DigestIndex.build([("a", "/", "allow"), ("b", "/", "block")], str(tmp_path), "i")
    index = url_filter.DigestIndex(str(tmp_path), "i")
    # pretend both keys were equal: the stored strings decide
    index.keys = np.full(2, 7, np.uint64)
    rows = index.lookup(np.asarray([7, 7, 7], np.uint64), ["a/", "b/", "c/"], np.asarray([1, 1, 1]))
    assert rows[2] == -1 and rows[0] != rows[1] and min(rows[:2]) >= 0


def test_warc(spark):
    rng = random.Random(7)
    bodies = [None, "", "<p>é</p>", "x" * 300_000, "<p>copy</p>"]
    rows = [(i, f"http://h{rng.randint(0, 3)}.example.com/{rng.randint(0, 9)} \n", rng.choice(bodies)) for i in range(120)] + [(500, None, "only"), (None, "http://n/", "<p>copy</p>"), (3, "http://dup/", "dup"), (3, "http://dup/", "dup"), (4, "http://dup/", "dup")]
    pages = spark.createDataFrame(rows, PAGE).withColumn("sha", F.lit("clash"))
    got = warc.capture_history(pages).collect()
    first = {}
    for i, _, b in rows:
        if i is not None:
            first[b or ""] = min(i, first.get(b or "", i))
    want = Counter()
    for i, _, b in rows:
        raw = (b or "").encode()
        response = i == first[b or ""]
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else first[b or ""]] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.capture_history(pages.limit(0)).count() == 0
    assert {r.record_type for r in warc.capture_history(pages, min_revisit=1 << 30).collect()} == {"response"}


def test_urls_come_back_as_they_were(spark):
    urls = ["http://a/a%20b?q=%41%zz", "http://a/é/ü?x=%C3%A9", "http://b.a/ ", " http://b.a/", "http://a/x\ny: z\r\nWARC-Type: no", "http://a/\t\x00\x85\u2028%0A", "HTTP://U:p@Host.Example.com:8080/P?q#f", "", None, "no scheme: x", "http://日本/", "a" * 70_000, "http://a: b/%"]
    pages = spark.createDataFrame([(i, u, str(i)) for i, u in enumerate(urls)] + [(99, urls[0], "99")], PAGE)
    got = warc.capture_history(pages).collect()
    assert {r.page_id: r.url for r in got} == {**dict(enumerate(urls)), 99: urls[0]}
    assert {r.page_id: r.urlkey for r in got if r.page_id < 99} == {i: warc.url_key(u) for i, u in enumerate(urls)}
    assert warc.url_key(urls[6]) == "com,example,host:8080)/p?q#f"


def test_one_order_for_cuts_and_merge(spark):
    ids = [None, -5, -40, 3, 20, 100, 7, -1, 0]
    pages = spark.createDataFrame([(i, "http://one/", f"{i} {k}") for k in range(40) for i in ids], PAGE).repartition(7)
    runs = warc.read_archives(warc.write_archives(pages), run_rows=50, sample_every=3)
    for options in ({}, {"fan_in": 2, "range_rows": 30, "pass_rows": 60}, {"fan_in": 3, "range_rows": 5, "pass_rows": 10}):
        got = [(r.page_id is None, r.page_id or 0) for r in warc.merge_runs(runs, **options).collect()]
        assert got == sorted(got) and len(got) == 40 * len(ids)


def test_index_merge_in_passes_and_ranges(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 13}.com/{i % 7}", str(i)) for i in range(300)], PAGE).repartition(9)
    runs = warc.read_archives(warc.write_archives(pages), run_rows=23, sample_every=2)
    assert runs.count() > 8
    merged = warc.merge_runs(runs, fan_in=2, range_rows=40)
    assert merged.rdd.getNumPartitions() > 2
    rows = [(r.urlkey, r.timestamp, r.page_id) for r in merged.collect()]
    assert rows == sorted(rows) and len(rows) == 300
    # each pass merges by ranges, and none loses or repeats an entry
    for fan_in, range_rows, pass_rows in ((2, 10, 20), (2, 300, 1), (3, 7, 1000), (64, 1, 1)):
        assert [(r.urlkey, r.timestamp, r.page_id) for r in warc.merge_runs(runs, fan_in, range_rows, pass_rows).collect()] == rows


def test_loser_tree():
    rng = random.Random(0)
    for _ in range(100):
        lists = [sorted(rng.choices(range(20), k=rng.randint(0, 8))) for _ in range(rng.randint(0, 9))]
        assert list(warc.LoserTree([iter([((x,), x) for x in one]) for one in lists])) == sorted(sum(lists, []))


def test_damaged_records_are_noticed():
    raw = zlib.decompress(warc.record(1, "http://a/", b"hello", None, False, warc.CAPTURED), 31)
    assert warc.parse(raw)["payload_bytes"] == 5
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(raw.replace(b"hello", b"hellp"))


def brute_search(rows, every, k):
    ok = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        own = min((np.asarray(v, np.float64).tobytes() for i, v in ok if i == q))
        vec = np.frombuffer(own, np.float64).astype(int).tolist()
        scored = sorted((-sum(a * b for a, b in zip(vec, v)), i) for i, v in ok if i != q and len(v) == len(vec))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(900)]
    rows += [(i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]) for i in range(900, 1100)]  # ties
    rows += [(2000, None), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2200, [float("nan")] * 6), (2300, [float("inf")] * 6), (2400, [0.5, 0.25]), (2401, [1.0, 1.0]), (2500, []), (None, [1.0] * 6), (905, [9.0] * 6), (700, [0.1] * 6), (2600, [3e9] * 6), (2601, [-2e9] * 6)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    want = brute_search(rows, 100, 10)
    monkeypatch.setattr(cover_search, "DATA_BLOCK", 128)
    assert sorted(map(tuple, cover_search.top_k(table.repartition(3)).collect())) == want
    assert cover_search.top_k(table.limit(0)).count() == 0


def test_cover_tree_covers():
    rng = np.random.default_rng(2)
    points = np.floor(rng.normal(size=(700, 5)) * 100)
    points[100:300] = points[0]
    tree = cover_search.CoverTree(points, 16)
    assert sorted(tree.order.tolist()) == list(range(700))
    for (lo, hi), centre, radius, kids in zip(tree.span, tree.centre, tree.radius, tree.kids):
        assert np.sqrt(((points[tree.order[lo:hi]] - centre) ** 2).sum(axis=1)).max() <= radius + 1e-9
        assert not kids or sorted(i for k in kids for i in range(*tree.span[k])) == list(range(lo, hi))


# a plain progressive encoder, coefficient by coefficient, for streams of other make
_HUFF = ([0, 0, 0, 0, 0, 0, 0, 255, 1] + [0] * 7, list(range(256)))


class Writer:
    def __init__(self):
        self.bits = []
        self.codes = media._canonical(_HUFF)

    def put(self, value, size):
        self.bits += [value >> (size - 1 - k) & 1 for k in range(size)]

    def symbol(self, s):
        self.put(*self.codes[s])

    def signed(self, v):
        size = abs(v).bit_length()
        return size, v if v > 0 else v + (1 << size) - 1


def encode_scan(w, coefs, lo, hi, high, low):
    shift = lambda v: (abs(v) >> low) * (1 if v > 0 else -1)
    run, pending = 0, []

    def flush():
        nonlocal run, pending
        if run:
            size = run.bit_length() - 1
            w.symbol(size << 4)
            w.put(run - (1 << size), size)
            w.bits += pending
        run, pending = 0, []

    for row in coefs:
        k, zeros, corrections = lo, 0, []
        new = [j for j in range(lo, hi + 1) if (abs(row[j]) >> low == 1 if high else shift(row[j]))]
        last = max(new, default=lo - 1)
        if new:
            flush()
        while k <= last:
            v = row[k]
            if high and abs(v) >> low > 1:
                corrections.append(abs(v) >> low & 1)
            elif shift(v) == 0:
                zeros += 1
                if zeros == 16:
                    w.symbol(0xF0)
                    w.bits += corrections
                    zeros, corrections = 0, []
            else:
                if high:
                    w.symbol(zeros << 4 | 1)
                    w.put(int(v > 0), 1)
                    w.bits += corrections
                    corrections = []
                else:
                    size, bits = w.signed(shift(v))
                    w.symbol(zeros << 4 | size)
                    w.put(bits, size)
                zeros = 0
            k += 1
        if last < hi:
            corrections += [abs(row[j]) >> low & 1 for j in range(last + 1, hi + 1) if high and abs(row[j]) >> low > 1]
            run += 1
            pending += corrections
            if run == 32767:
                flush()
    flush()


@pytest.mark.parametrize("restart", [0, 3])
def test_decoder_reads_other_streams(restart):
    rng = np.random.default_rng(4)
    width, height = 45, 20  # partly filled blocks
    across, down = 3, 2
    luma = np.where(rng.random((24, 64)) < 0.3, rng.integers(-60, 61, (24, 64)), 0)
    luma[5] = 0
    chroma = [np.where(rng.random((6, 64)) < 0.2, rng.integers(-30, 31, (6, 64)), 0) for _ in range(2)]
    out = [b"\xff\xd8", media._segment(0xDB, bytes([0] + [1] * 64)), media._segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), media._table(0, 0, _HUFF), media._table(1, 0, _HUFF)]
    if restart:
        out.append(media._segment(0xDD, restart.to_bytes(2, "big")))
    order = media._mcu_order(across, down)

    def scan(parts, lo, hi, high, low, units, write):
        body = bytes([len(parts)]) + b"".join(bytes([p, 0]) for p in parts) + bytes([lo, hi, high << 4 | low])
        step, pieces = restart or units, []
        for at in range(0, units, step):
            w = Writer()
            write(w, range(at, min(units, at + step)))
            pieces.append(media._packed(np.asarray(w.bits, np.uint8)))
        out.append(media._segment(0xDA, body) + b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(pieces) else b"") for k, p in enumerate(pieces)))

    def dc(low, high):
        def write(w, units):
            last = [0, 0, 0]
            for u in units:
                for c, v in [(0, luma[b, 0]) for b in order[u]] + [(1, chroma[0][u, 0]), (2, chroma[1][u, 0])]:
                    v = int(v) >> low
                    if high:
                        w.put(v & 1, 1)
                        continue
                    d, last[c] = v - last[c], v
                    size, bits = w.signed(d) if d else (0, 0)
                    w.symbol(size)
                    w.put(bits, size)

        return write

    # a scan of one component has only the blocks that hold pixels
    wide = [6, 3, 3]
    seen = [[y * 6 + x for y in range(3) for x in range(6)], list(range(6)), list(range(6))]
    hidden = sorted(set(range(24)) - set(seen[0]))
    luma[hidden, 1:] = 0
    scan([1, 2, 3], 0, 0, 0, 1, 6, dc(1, 0))
    for c, plane in enumerate((luma, *chroma)):
        for lo, hi in ((1, 5), (6, 63)):
            scan([c + 1], lo, hi, 0, 2, len(seen[c]), lambda w, u, p=plane, s=seen[c], lo=lo, hi=hi: encode_scan(w, [p[s[k]].tolist() for k in u], lo, hi, 0, 2))
        for low in (1, 0):
            scan([c + 1], 1, 63, low + 1, low, len(seen[c]), lambda w, u, p=plane, s=seen[c], low=low: encode_scan(w, [p[s[k]].tolist() for k in u], 1, 63, low + 1, low))
    scan([1, 2, 3], 0, 0, 1, 0, 6, dc(0, 1))
    image = media.Image(b"".join(out) + b"\xff\xd9")
    assert (image.parts[0]["coefs"] == luma).all() and (image.parts[1]["coefs"] == chroma[0]).all() and (image.parts[2]["coefs"] == chroma[1]).all() and wide
    assert image.rgb().shape == (height, width, 3)


def test_transform_is_the_inverse_of_the_cosines():
    flat = np.zeros(64)
    flat[0] = 8 * 10
    assert np.allclose(flat @ media._BASIS, 10)
    assert np.allclose(media._BASIS @ media._BASIS.T, np.eye(64))
    assert media._ZIGZAG[:8].tolist() == [0, 1, 8, 16, 9, 2, 3, 10]


def test_every_coefficient_is_refined_and_shown():
    """No scan but the first ones of DC and of two bands and those of last bits: every coefficient
    lacks its last bit before the latter, and pixels change with each byte of a text."""
    rng = random.Random(2)
    raw = bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz ", k=384))
    stream = media.encode_payload(raw)
    heads, at = [], 2
    while stream[at + 1] != 0xD9:
        size = int.from_bytes(stream[at + 2 : at + 4], "big")
        body = stream[at + 4 : at + 2 + size]
        if stream[at + 1] == 0xDA:
            heads.append(tuple(body[-3:]))
        found = media._NEXT.search(stream, at + 2 + size) if stream[at + 1] == 0xDA else None
        at = found.start() if found else at + 2 + size
    first = {z for lo, hi, bits in heads if bits == 0x01 for z in range(lo, hi + 1)}
    again = {z for lo, hi, bits in heads if bits == 0x10 for z in range(lo, hi + 1)}
    assert first == again == set(range(64)) and all(bits in (0x01, 0x10) for *_, bits in heads)
    whole = media.Image(stream)
    plain = whole.rgb()
    assert ((plain == 0) | (plain == 255)).mean() < 0.5
    # a byte one apart moves some pixel of the block
    for at in range(0, 256):
        other = bytearray(raw)
        other[at] ^= 2
        assert (media.Image(media.encode_payload(bytes(other))).rgb() != plain).any()


def test_colours_as_pixel_by_pixel():
    """The colour transform of subsampled chroma, also of two chroma planes sampled unlike."""
    rng = np.random.default_rng(4)
    for shapes in (((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (2, 1)), ((1, 1), (1, 1), (1, 1)), ((1, 1), (2, 2), (1, 2))):
        image = media.Image.__new__(media.Image)
        image.parts, image.quant, image.places = [], {0: np.ones(64, np.float32)}, {}
        image._frame(bytes([8, 0, 21, 0, 35, 3]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(shapes)))
        for p in image.parts:
            p["coefs"][:] = rng.integers(-120, 121, p["coefs"].shape)
        full = [image._plane(p).repeat(image.h // p["h"], axis=1).repeat(image.v // p["v"], axis=0)[:21, :35].astype(int) for p in image.parts]
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        want = [((y << 16) + v + 32768) >> 16 for v in (91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)]
        assert (image.rgb() == np.clip(np.stack(want, axis=2), 0, 255)).all()


def test_grey_image():
    image = media.Image.__new__(media.Image)
    image.parts, image.quant = [], {0: np.ones(64, np.float32)}
    image._frame(bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    image.parts[0]["coefs"][1, 0] = 80
    assert image.rgb()[0, 0].tolist() == [128] * 3 and image.rgb()[0, 8].tolist() == [138] * 3


def test_media_are_stored(spark):
    from pathlib import Path

    from strandloom.llm._shared import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://")) / "strandloom"
    before = set(folder.glob("media-*")) | set(folder.glob("tensors-*"))
    docs = spark.createDataFrame([(1, "Some text."), (2, None), (1, "Some text."), (None, "é" * 5000)], "doc_id bigint, text string")
    got = sorted(map(str, media.media_digests(docs).collect()))
    (made,) = set(folder.glob("media-*")) - before
    (tensors,) = set(folder.glob("tensors-*")) - before
    rows = spark.read.parquet(str(tensors)).collect()
    assert len(rows) == 4 and all(len(r.rgb) == r.height * r.width * 3 for r in rows) and max(r.height for r in rows) > 16
    assert all(media.features(np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)) == r.feature for r in rows)
    table = spark.read.parquet(str(made))
    assert table.columns == ["doc_id", "media"] and table.count() == 4 and sorted(map(str, media.decode_media(table).collect())) == got


def test_tensors_lie_on_disk_one_slice_at_a_time(spark, monkeypatch):
    """All rows go through a stored table of tensors, but never all of them at once; media stay whole."""
    from pathlib import Path

    from strandloom.llm._shared import _places, shared_dir

    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "".join(rng.choices("abcdefgh ", k=rng.randint(0, 900)))) for i in range(90)] + [(None, None), (5, "again")], "doc_id bigint, text string").repartition(6)
    docs = docs.persist()
    want = sorted(map(str, media.media_digests(docs).collect()))  # small tables are one slice
    folder = Path(shared_dir(spark).removeprefix("file://")) / "strandloom"
    before = set(folder.glob("media-*")) | set(folder.glob("tensors-*"))
    stored, written, at_once = media.stored, [], []

    def watched(df, label, **options):
        table = stored(df, label, **options)
        if label == "tensors":
            written.append(spark.read.parquet(_places[id(table)][1]).count())
            at_once.append(sum(spark.read.parquet(str(f)).count() for f in set(folder.glob("tensors-*")) - before))
        return table

    monkeypatch.setattr(media, "stored", watched)
    monkeypatch.setattr(media, "LEAST_SLICE", 1)
    monkeypatch.setattr(media, "SLICES", 4)
    monkeypatch.setattr(media, "FILE_ROWS", 4)
    got = media.media_digests(docs)
    assert sorted(map(str, got.collect())) == want and len(want) == 92
    assert len(written) >= 4 and sum(written) == 92 and max(at_once) < 46
    (made,) = set(folder.glob("media-*")) - before
    assert spark.read.parquet(str(made)).count() == 92
    # the operator itself keeps every tensor
    assert media.tensors(docs).where("length(rgb) = 3 * height * width").count() == 92
    docs.unpersist()


def test_media_round_trip(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "".join(chr(rng.randint(32, 900)) for _ in range(5000)), "\x00\x00", "ÿ" * 100_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, "a"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("media", F.lit("clash"))
    got = media.media_digests(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = ("a" if r.doc_id is None else texts[r.doc_id] or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stream = media.encode_payload(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (None, 2)}) == 1
    tensor = media.decode_media(media.encode_media(docs.where("doc_id = 6")), keep_tensor=True).first()
    assert len(tensor.rgb) == tensor.height * tensor.width * 3 and media.features(np.frombuffer(tensor.rgb, np.uint8).reshape(tensor.height, tensor.width, 3)) == tensor.feature
    assert media.media_digests(docs.limit(0)).count() == 0
