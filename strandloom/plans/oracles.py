"""DuckDB SQL twins of the catalogue's queries, written independently of the operators."""

from __future__ import annotations

_SITES = """
sites AS (
  SELECT 'chr' || CAST(p_partkey % 5 AS VARCHAR) AS chr,
         100 + 37 * (p_partkey // 5) + ((p_partkey // 5) * (p_partkey // 5)) % 11 AS pos, p_partkey // 5 AS rk
  FROM part
)"""

_HAPS = f"""{_SITES},
last AS (SELECT chr, max(rk) AS max_rk FROM sites GROUP BY chr),
raw AS (
  SELECT 'chr' || CAST(l_partkey % 5 AS VARCHAR) AS chr, l_partkey // 5 AS rk, 1 + CAST(l_quantity AS INTEGER) % 8 AS want,
         l_orderkey * 31 + l_linenumber * 7 AS v, l_linenumber AS cnt, l_orderkey % 2 AS half,
         CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand
  FROM lineitem
),
haps AS (
  SELECT raw.chr, a.pos AS beg, b.pos AS "end", substr(reverse(lpad(bin(v % 256), 8, '0')), 1, CAST(least(want, max_rk - raw.rk + 1) AS BIGINT)) AS hap,
         cnt, raw.strand, half, raw.rk
  FROM raw JOIN last ON raw.chr = last.chr
  JOIN sites a ON a.chr = raw.chr AND a.rk = raw.rk
  JOIN sites b ON b.chr = raw.chr AND b.rk = raw.rk + least(want, max_rk - raw.rk + 1) - 1
)"""

_BED = """
bed AS (
  SELECT ord, chr, beg, beg + 60 + (w * 13) % 900 AS "end" FROM (
    SELECT s_suppkey AS ord, 'chr' || CAST(s_suppkey % 6 AS VARCHAR) AS chr,
           CASE WHEN s_suppkey % 10 = 9 THEN 10000000 + s_suppkey ELSE (s_suppkey * 977) % 14000 END AS beg, s_suppkey % 400 AS w
    FROM supplier)
)"""

_BITS = f"""{_HAPS},
bits AS (
  SELECT h.chr, h.beg, s.pos, substr(h.hap, CAST(s.rk - h.rk + 1 AS BIGINT), 1) AS bit, h.cnt, h.strand
  FROM haps h JOIN sites s ON s.chr = h.chr AND s.rk >= h.rk AND s.rk < h.rk + length(h.hap)
)"""


def _sums(strand: str) -> str:
    return f"""{_BITS},
sums AS (
  SELECT chr, pos, {strand} AS strand, CAST(sum(CASE WHEN bit = '1' THEN cnt ELSE 0 END) AS BIGINT) AS meth, CAST(sum(cnt) AS BIGINT) AS total
  FROM bits GROUP BY 1, 2, 3
)"""


def _beta_sites(strand: str) -> str:
    return f"""WITH {_sums(strand)}
SELECT chr, pos, pos + 1 AS "end", (meth * 100) // total AS pct, meth, total - meth AS unmeth, strand FROM sums WHERE total > 0"""


def _beta_regions(strand: str, values: str, compat: bool = False) -> str:
    lo = 'least(b.beg, coalesce(m.last, b.beg))' if compat else "b.beg"
    return f"""WITH {_sums(strand)}, {_BED},
ends AS (SELECT chr, max(pos) AS last FROM sites GROUP BY chr),
wanted AS (SELECT DISTINCT b.chr, b.beg, b."end", {lo} AS lo, greatest(b."end", {lo}) AS hi, s.strand FROM bed b LEFT JOIN ends m ON b.chr = m.chr CROSS JOIN (VALUES {values}) s(strand)),
rolled AS (
  SELECT w.chr, w.beg, w."end", w.strand, CAST(coalesce(sum(s.meth), 0) AS BIGINT) AS meth, CAST(coalesce(sum(s.total), 0) AS BIGINT) AS total
  FROM wanted w LEFT JOIN sums s ON s.chr = w.chr AND s.strand = w.strand AND s.pos BETWEEN w.lo AND w.hi GROUP BY 1, 2, 3, 4
)
SELECT chr, beg, "end", CASE WHEN total > 0 THEN (meth * 100) // total ELSE 0 END AS pct, meth, total - meth AS unmeth, strand FROM rolled"""


_MEASURED = f"""{_HAPS},
measured AS (
  SELECT chr, beg, "end", strand, rk, length(hap) AS len, CAST(cnt AS BIGINT) AS n, length(hap) - length(replace(hap, '1', '')) AS ones FROM haps
)"""
_MEASURES = """CAST(coalesce(sum(n), 0) AS BIGINT) AS nReads, CAST(coalesce(sum(ones * n), 0) AS BIGINT) AS mBase, CAST(coalesce(sum(len * n), 0) AS BIGINT) AS tBase,
  CAST(coalesce(sum(CASE WHEN ones > 0 THEN (len - ones) * n END), 0) AS BIGINT) AS cBase, CAST(coalesce(sum(CASE WHEN len >= 4 THEN n END), 0) AS BIGINT) AS K4plus,
  CAST(coalesce(sum(CASE WHEN len >= 4 AND ones > 0 AND ones < len THEN n END), 0) AS BIGINT) AS nDR, CAST(coalesce(sum(CASE WHEN len >= 4 AND ones > 0 THEN n END), 0) AS BIGINT) AS nMR"""


def _summary_regions(strand: str, values: str) -> str:
    return f"""WITH {_MEASURED}, {_BED}
SELECT b.ord, b.chr, b.beg + 1 AS beg, b."end", s.strand, {_MEASURES}
FROM bed b CROSS JOIN (VALUES {values}) s(strand)
LEFT JOIN measured m ON m.chr = b.chr AND m.beg <= b."end" AND m."end" >= b.beg + 1 AND {strand} = s.strand
GROUP BY 1, 2, 3, 4, 5"""


def _summary_genome(strand: str) -> str:
    return f"""WITH {_MEASURED}
SELECT s.chr, s.pos, s.pos + 1 AS "end", {strand} AS strand, {_MEASURES}
FROM measured m JOIN sites s ON s.chr = m.chr AND s.rk >= m.rk AND s.rk < m.rk + m.len GROUP BY 1, 2, 3, 4"""


_ALN = """
names AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 97 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS q FROM orders),
mates AS (SELECT k, q, mate FROM names CROSS JOIN (VALUES (0), (1)) m(mate)),
shaped AS (
  SELECT k * 2 + mate AS ord, 'q' || CAST(q AS VARCHAR) AS qname, 'chr' || CAST(q % 5 AS VARCHAR) AS chr, k,
    CAST(CASE WHEN k % 31 = 0 THEN 1 WHEN k % 13 = 0 THEN 16 * (k % 2) WHEN k % 29 = 0 THEN 67
         WHEN k % 2 = 0 THEN 99 + mate * 48 ELSE 83 + mate * 80 END + CASE WHEN k % 50 = 7 THEN 1024 ELSE 0 END AS INTEGER) AS flag,
    90 + 37 * ((q // 5) % 380) + k % 23 + mate * (k % 60) AS pos, 40 + k % 50 AS len, k % 6 AS v
  FROM mates
),
aln AS (
  SELECT ord, qname, flag, chr, pos, len,
    CAST(5 + k % 4 AS VARCHAR) || 'S' || CAST(len - 12 - k % 4 AS VARCHAR) || 'M' || CAST(1 + k % 3 AS VARCHAR) || 'I' || CAST(3 - k % 3 AS VARCHAR) || 'M' || CAST(k % 5 + 1 AS VARCHAR) || 'D3M' AS cigar,
    len AS qlen, len - 12 - k % 4 + 3 - k % 3 + k % 5 + 1 + 3 AS rlen, 5 + k % 4 AS clip, len - 12 - k % 4 AS m1, 1 + k % 3 AS ins, 3 - k % 3 AS m2, k % 5 + 1 AS del,
    substr(repeat(CASE WHEN (flag & 1023) IN (16, 83, 163)
        THEN CASE v WHEN 0 THEN 'GGAA' WHEN 1 THEN 'GAGA' WHEN 2 THEN 'AAGG' WHEN 3 THEN 'AGAG' WHEN 4 THEN 'GGGA' ELSE 'GGCA' END
        ELSE CASE v WHEN 0 THEN 'CCTT' WHEN 1 THEN 'CTCT' WHEN 2 THEN 'TTCC' WHEN 3 THEN 'TCTC' WHEN 4 THEN 'CCCT' ELSE 'CCAT' END END, 30), 1 + pos % 4, len) AS seq,
    CASE WHEN k % 41 = 0 THEN '*' ELSE substr(repeat('!5?I+', 30), 1 + k % 5, len) END AS qual,
    CASE WHEN k % 17 = 0 THEN 'zzXh' WHEN k % 17 = 1 THEN 'zzh.' END AS xm
  FROM shaped
)"""

_WC = """CASE WHEN (flag & 3) = 3 THEN
    CASE WHEN (flag & 64) <> 0 THEN CASE WHEN (flag & 16) <> 0 THEN 2 WHEN (flag & 32) <> 0 THEN 1 ELSE 0 END
         WHEN (flag & 128) <> 0 THEN CASE WHEN (flag & 16) <> 0 THEN 1 WHEN (flag & 32) <> 0 THEN 2 ELSE 0 END ELSE 0 END
  WHEN (flag & 3) = 0 THEN CASE WHEN (flag & 16) <> 0 THEN 2 ELSE 1 END END"""
_SYM = "CASE wc WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE '*' END"


def _bases(mode: str = "BS", directional: bool = True, source: str = "aln") -> str:
    c, t = ("1", "0") if mode == "BS" else ("0", "1")
    wc = _WC if directional else "0"
    return f"""{_SITES}, {_ALN},
accepted AS (
  SELECT * FROM (SELECT *, {wc} AS wc FROM {source} WHERE (flag & 3844) = 0 AND (xm IS NULL OR NOT regexp_matches(xm, '[XHU]'))) WHERE wc IS NOT NULL
),
covered AS (
  SELECT a.ord, a.chr, a.qname, a.wc, s.pos AS site, s.pos - a.pos - CASE WHEN a.wc = 2 THEN 0 ELSE 1 END AS i, a.seq, a.qual
  FROM accepted a JOIN sites s ON s.chr = a.chr
   AND s.pos >= a.pos + CASE WHEN a.wc = 2 THEN 0 ELSE 1 END AND s.pos <= a.pos + a.len - CASE WHEN a.wc = 2 THEN 1 ELSE 0 END
),
bases AS (
  SELECT ord, chr, qname, wc, site,
    CASE WHEN wc = 2 THEN CASE substr(seq, i + 1, 1) WHEN 'G' THEN '{c}' WHEN 'A' THEN '{t}' END
         ELSE CASE substr(seq, i + 1, 1) WHEN 'C' THEN '{c}' WHEN 'T' THEN '{t}' END END AS met,
    CASE WHEN qual = '*' THEN -1 ELSE ascii(substr(qual, i + 1, 1)) - 33 END AS q
  FROM covered
),
legal AS (SELECT ord, min(site) AS s0, max(site) AS e0 FROM bases GROUP BY ord HAVING bool_and(met IS NOT NULL))"""


def _paired(mode: str = "BS", source: str = "aln", extra: str = "") -> str:
    return f"""{_bases(mode, True, source)}{extra},
numbered AS (
  SELECT l.ord, l.s0, l.e0, a.chr, a.qname, a.wc, row_number() OVER (PARTITION BY a.chr, a.qname ORDER BY l.ord) - 1 AS rn
  FROM legal l JOIN accepted a ON a.ord = l.ord
),
pairs AS (SELECT *, rn // 2 AS pair FROM numbered),
grouped AS (
  SELECT *, CASE WHEN count(*) OVER w = 2 AND max(s0) OVER w <= min(e0) OVER w THEN min(ord) OVER w ELSE ord END AS g FROM pairs WINDOW w AS (PARTITION BY chr, qname, pair)
),
best AS (
  SELECT g.g, b.chr, b.site, b.met, row_number() OVER (PARTITION BY g.g, b.site ORDER BY b.q DESC, b.ord) AS r
  FROM grouped g JOIN bases b ON b.ord = g.ord
),
instances AS (
  SELECT b.chr, min(b.site) AS beg, max(b.site) AS "end", string_agg(b.met, '' ORDER BY b.site) AS hap, CASE a.wc WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE '*' END AS strand
  FROM best b JOIN accepted a ON a.ord = b.g WHERE b.r = 1 GROUP BY b.g, b.chr, a.wc
)"""


_FAR = """
far AS (SELECT * EXCLUDE (ord), CASE WHEN ord % 2 = 1 AND (ord // 2) % 3 = 0 THEN (ord + 1400) * 4 + 1 ELSE ord * 4 END AS ord FROM aln)"""


def _walked(rows: str) -> str:
    """The reads of a name in turn: ``waits`` is the number of the read that waits after each."""
    return f"""walk AS (
  SELECT chr, qname, ord, rn, idx, CAST(0 AS BIGINT) AS pair, idx AS waits, CAST(NULL AS BIGINT) AS met, false AS broken FROM {rows} WHERE rn = 1
  UNION ALL
  SELECT n.chr, n.qname, n.ord, n.rn, n.idx, CASE WHEN w.waits + 101 > n.idx + 1 OR ((w.waits + 101 + 999) // 1000) * 1000 > n.idx + 1 THEN w.pair ELSE w.pair + 1 END,
    CASE WHEN w.waits IS NOT NULL AND ((w.waits + 101 + 999) // 1000) * 1000 > n.idx + 1 THEN NULL ELSE n.idx END, w.waits,
    w.waits IS NOT NULL AND ((w.waits + 101 + 999) // 1000) * 1000 <= n.idx + 1
  FROM walk w JOIN {rows} n ON n.chr = w.chr AND n.qname = w.qname AND n.rn = w.rn + 1
)"""


def _evicting() -> str:
    """Pairs by a buffer that gives up, every 1000 accepted reads, those that waited for 100."""
    base = _paired("BS", "far").replace(_ALN, _ALN + "," + _FAR)
    head, rest = base.split("pairs AS (", 1)
    rest = rest.split("),\ngrouped AS", 1)[1]
    counted = """counted AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS idx FROM accepted),
turns AS (SELECT n.*, c.idx FROM (SELECT * EXCLUDE (rn), rn + 1 AS rn FROM numbered) n JOIN counted c ON c.ord = n.ord),"""
    return f"WITH RECURSIVE {head}{counted}\n{_walked('turns')},\npairs AS (SELECT t.*, w.pair FROM turns t JOIN walk w ON w.ord = t.ord),\ngrouped AS{rest} {_COUNTED}"


def _meetings(source: str = "far") -> str:
    base = _bases(source=source).replace(_ALN, _ALN + "," + _FAR)
    return f"""WITH RECURSIVE {base},
counted AS (SELECT ord, chr, qname, row_number() OVER (ORDER BY ord) - 1 AS idx FROM accepted),
turns AS (SELECT *, row_number() OVER (PARTITION BY chr, qname ORDER BY ord) AS rn FROM counted),
{_walked('turns')}
SELECT chr, qname, met AS i, idx AS j, broken FROM walk WHERE met IS NOT NULL"""


_COVER = """
u AS (
  SELECT a.*, unnest(range(1, rlen + 1)) AS ix FROM aln a WHERE (flag & 3844) = 0
),
column_bases AS (
  SELECT u.chr, u.pos + u.ix AS position, ord % 40 + 2 AS quality, ord % 2 = 1 AS reverse,
    substr(seq, CAST(CASE WHEN ix <= m1 THEN clip + ix WHEN ix <= m1 + m2 THEN clip + ins + ix ELSE clip + ins + ix - del END AS BIGINT), 1) AS base
  FROM u JOIN sites s ON s.chr = u.chr AND s.pos = u.pos + u.ix WHERE NOT (ix > m1 + m2 AND ix <= m1 + m2 + del)
)"""


def _likelihoods() -> str:
    pairs = ", ".join(f"('{a}{b}', '{a}', '{b}')" for i, a in enumerate("ACGT") for b in "ACGT"[i:])
    return f"""WITH {_SITES}, {_ALN}, {_COVER},
c AS (SELECT chr, position, base, reverse, CAST(least(63, greatest(4, quality)) AS BIGINT) AS q, count(*) OVER (PARTITION BY chr, position) AS n, row_number() OVER () AS u FROM column_bases),
r AS (
  SELECT *, row_number() OVER (PARTITION BY chr, position, base ORDER BY q DESC, reverse DESC, u) - 1 AS k,
    row_number() OVER (PARTITION BY chr, position, base, reverse ORDER BY q DESC, u) - 1 AS j FROM c WHERE base IN ('A', 'C', 'G', 'T')
),
pmf AS (
  SELECT q, n, i, exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(pow(10, -q / 10)) + (n - i) * ln(1 - pow(10, -q / 10))) AS p
  FROM (SELECT q, n, unnest(range(0, n + 1)) AS i FROM (SELECT DISTINCT q, n FROM r))
),
tails AS (SELECT q, n, i, sum(p) OVER (PARTITION BY q, n ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS tail FROM pmf),
spent AS (
  SELECT r.chr, r.position, r.base, count(*) AS m, sum((pow(0.83, j) * 0.97 + 0.03) * -10 * log10(b.tail / a.tail)) AS cost
  FROM r JOIN tails a ON a.q = r.q AND a.n = r.n AND a.i = r.k JOIN tails b ON b.q = r.q AND b.n = r.n AND b.i = r.k + 1 GROUP BY 1, 2, 3
),
whole AS (SELECT c.chr, c.position, count(*) AS depth FROM c GROUP BY 1, 2),
total AS (SELECT chr, position, sum(cost) AS cost FROM spent GROUP BY 1, 2),
g AS (
  SELECT w.chr, w.position, w.depth, v.genotype, v.x <> v.y AS het, coalesce(t.cost, 0) - coalesce(a.cost, 0) - CASE WHEN v.x <> v.y THEN coalesce(b.cost, 0) ELSE 0 END AS rest,
    coalesce(a.m, 0) AS am, coalesce(b.m, 0) AS bm
  FROM whole w CROSS JOIN (VALUES {pairs}) v(genotype, x, y) LEFT JOIN total t ON t.chr = w.chr AND t.position = w.position
  LEFT JOIN spent a ON a.chr = w.chr AND a.position = w.position AND a.base = v.x LEFT JOIN spent b ON b.chr = w.chr AND b.position = w.position AND b.base = v.y
)
SELECT chr, position, depth, genotype, round(greatest(0.0, rest - CASE WHEN het THEN 4.343 * (lgamma(am + bm + 1.0) - lgamma(am + 1.0) - lgamma(bm + 1.0) - ln(2) * (am + bm)) ELSE 0 END), 4) AS phred FROM g"""


_CAP = """
reads AS (SELECT *, repeat('CT', 60) AS reference FROM aln),
each AS (SELECT ord, qual, seq, reference, clip, m1, ins, m2, del, rlen, len, unnest(range(1, rlen + 1)) AS ix FROM reads),
faced AS (
  SELECT ord, ix, substr(reference, ix, 1) AS o, ix <= m1 + m2 OR ix > m1 + m2 + del AS aligned,
    CASE WHEN ix <= m1 THEN clip + ix WHEN ix <= m1 + m2 THEN clip + ins + ix ELSE clip + ins + ix - del END AS y, seq, qual FROM each
),
scored AS (
  SELECT ord, substr(seq, CAST(y AS BIGINT), 1) AS b, o, CASE WHEN qual = '*' THEN 255 ELSE ascii(substr(qual, CAST(y AS BIGINT), 1)) - 33 END AS s FROM faced WHERE aligned
),
met AS (
  SELECT ord, count(*) FILTER (b <> 'N' AND o <> 'N' AND s >= 13) + count(*) AS n, count(*) FILTER (s >= 13 AND b <> o) AS m, coalesce(sum(least(s, 33)) FILTER (s >= 13 AND b <> o), 0) AS q FROM scored GROUP BY ord
),
clipped AS (
  SELECT ord, sum(CASE WHEN qual = '*' THEN 255 ELSE ascii(substr(qual, CAST(i AS BIGINT), 1)) - 33 END) AS c FROM (SELECT ord, qual, unnest(range(1, clip + 1)) AS i FROM reads) GROUP BY ord
),
t AS (SELECT met.ord, q - 4.343 * CASE WHEN m > 0 THEN m * ln(n) - lgamma(m + 1.0) ELSE 0 END + c / 5.0 AS t FROM met JOIN clipped ON clipped.ord = met.ord)"""

_COUNTED = 'SELECT chr, beg, "end", hap, count(*) AS cnt, strand FROM instances GROUP BY chr, beg, "end", hap, strand'


def _single(directional: bool) -> str:
    return f"""WITH {_bases("BS", directional)},
instances AS (
  SELECT b.chr, min(b.site) AS beg, max(b.site) AS "end", string_agg(b.met, '' ORDER BY b.site) AS hap, CASE b.wc WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE '*' END AS strand
  FROM bases b JOIN legal l ON l.ord = b.ord GROUP BY b.ord, b.chr, b.wc
) {_COUNTED}"""


_SELECTED = f""", {_BED},
chosen AS (SELECT a.* FROM aln a WHERE EXISTS (SELECT 1 FROM bed b WHERE b.chr = a.chr AND a.pos + 1 <= b."end" AND a.pos + a.len >= b.beg + 1))"""

_VAR = """
vars AS (
  SELECT p_partkey AS id, 'chr' || CAST(p_partkey % 5 AS VARCHAR) AS chr, 100 + 37 * (p_partkey // 5) AS pos, substr('ACGTTACG', 1 + p_partkey % 4, 1 + p_partkey % 3) AS ref,
    CASE p_partkey % 23 WHEN 0 THEN '*' WHEN 1 THEN '<X>' WHEN 2 THEN '<DEL>' WHEN 3 THEN '.' WHEN 4 THEN substr('ACGTTACG', 1 + p_partkey % 4, 1 + p_partkey % 3) || ']chr1:5]'
      ELSE substr('acGTCAGTTACC', 1 + p_partkey % 7, 1 + p_partkey % 4) END AS alt
  FROM part
),
cut1 AS (
  SELECT *, upper(ref) AS r, upper(alt) AS a, len(list_filter(range(1, least(length(ref), length(alt)) + 1), lambda i: upper(ref)[1:i] = upper(alt)[1:i])) AS p FROM vars
),
cut2 AS (
  SELECT *, length(r) - p AS lr, length(a) - p AS la,
    len(list_filter(range(1, greatest(least(length(r), length(a)) - p, 1)), lambda i: right(r, i) = right(a, i))) AS t FROM cut1
),
kinds AS (
  SELECT id, chr, pos, ref, alt, CASE
    WHEN alt = '*' THEN 32 WHEN length(ref) = 1 AND length(alt) = 1 AND alt IN ('.', ref, 'X') THEN 0 WHEN length(ref) = 1 AND length(alt) = 1 THEN 1
    WHEN starts_with(alt, '<X>') OR starts_with(alt, '<*>') THEN 0 WHEN starts_with(alt, '<') THEN 8
    WHEN lr = 0 AND la = 0 THEN 0 WHEN lr = 0 AND substr(a, p + 1, 1) IN (']', '[') THEN 16 WHEN lr = 0 OR la = 0 THEN 4
    WHEN lr - t = 1 AND la - t = 1 THEN 1
    WHEN lr - t = 1 OR la - t = 1 THEN CASE WHEN substr(r, length(r) - t, 1) = substr(a, length(a) - t, 1) THEN 4 ELSE 8 END
    WHEN lr = la THEN 2 ELSE 8 END AS type,
   CAST(CASE
    WHEN alt = '*' THEN 0 WHEN length(ref) = 1 AND length(alt) = 1 AND alt IN ('.', ref, 'X') THEN 0 WHEN length(ref) = 1 AND length(alt) = 1 THEN 1
    WHEN starts_with(alt, '<') THEN 0 WHEN lr = 0 AND la = 0 THEN 0 WHEN lr = 0 AND substr(a, p + 1, 1) IN (']', '[') THEN 0 WHEN lr = 0 OR la = 0 THEN la - lr
    WHEN lr - t = 1 AND la - t = 1 THEN 1 WHEN la - t = 1 THEN 1 - (lr - t) WHEN lr - t = 1 THEN la - t - 1
    WHEN lr = la THEN la - t WHEN lr > la THEN t - lr ELSE la - t END AS INTEGER) AS n
  FROM cut2
)"""

_GT = """
gts AS (
  SELECT l_partkey AS variant, CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN '.' WHEN (l_orderkey + l_linenumber) % 11 = 1 THEN CAST(l_suppkey % 3 AS VARCHAR)
    WHEN (l_orderkey + l_linenumber) % 11 = 2 THEN './' || CAST(l_suppkey % 2 AS VARCHAR) ELSE CAST(l_suppkey % 3 AS VARCHAR) || '/' || CAST(l_orderkey % 3 AS VARCHAR) END AS gt
  FROM lineitem
)"""

ORACLES: dict[str, str] = {
    "beta_sites": _beta_sites("'*'"),
    "beta_sites_stranded": _beta_sites("strand"),
    "beta_sites_range": f"WITH {_sums(chr(39) + '*' + chr(39))} SELECT chr, pos, meth, total FROM sums",
    "beta_regions": _beta_regions("'*'", "('*')"),
    "beta_regions_compat": _beta_regions("'*'", "('*')", True),
    "beta_regions_stranded": _beta_regions("strand", "('+'), ('-')"),
    "summary_regions": _summary_regions("'*'", "('*')"),
    "summary_regions_stranded": _summary_regions("m.strand", "('+'), ('-')"),
    "summary_genome": _summary_genome("'*'"),
    "summary_genome_stranded": _summary_genome("m.strand"),
    "merge_grouped": f'WITH {_HAPS} SELECT chr, beg, "end", hap, CAST(sum(cnt) AS BIGINT) AS cnt, strand FROM haps GROUP BY chr, beg, "end", hap, strand',
    "merge_adjacent": f"""WITH {_HAPS},
marked AS (SELECT *, CASE WHEN lag(chr || ':' || beg || ':' || "end" || ':' || hap || strand) OVER w = chr || ':' || beg || ':' || "end" || ':' || hap || strand THEN 0 ELSE 1 END AS brk FROM haps WINDOW w AS (ORDER BY chr, beg, "end", hap, cnt, strand)),
runs AS (SELECT *, sum(brk) OVER (ORDER BY chr, beg, "end", hap, cnt, strand ROWS UNBOUNDED PRECEDING) AS isl FROM marked)
SELECT DISTINCT chr, beg, "end", hap, cnt, strand FROM (SELECT isl, chr, beg, "end", hap, strand, CAST(sum(cnt) AS BIGINT) AS cnt FROM runs GROUP BY isl, chr, beg, "end", hap, strand)""",
    "hap_union_all": f'WITH {_HAPS} SELECT chr, beg, "end", hap, cnt, strand FROM haps',
    "hap_explode_sites": f"WITH {_BITS} SELECT chr, beg, pos, bit, CAST(sum(cnt) AS BIGINT) AS n FROM bits GROUP BY 1, 2, 3, 4",
    "sites_rank": f"WITH {_SITES} SELECT chr, pos, row_number() OVER (PARTITION BY chr ORDER BY pos) - 1 AS rk FROM sites",
    "sites_dedup": "SELECT DISTINCT 'chr' || CAST(l_partkey % 5 AS VARCHAR) AS chr, 100 + 37 * (l_partkey // 5) + ((l_partkey // 5) * (l_partkey // 5)) % 11 AS pos FROM lineitem",
    "sites_invalid": f'WITH {_SITES} SELECT chr, pos, CAST(2 AS BIGINT) AS "count" FROM sites WHERE pos % 3 = 0',
    "consistency_antijoin": f"""WITH {_HAPS}, moved AS (SELECT chr, beg + CASE WHEN cnt = 3 THEN 1 ELSE 0 END AS beg, "end", hap, cnt, strand FROM haps)
SELECT m.* FROM moved m WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.chr = m.chr AND s.pos = m.beg)""",
    "aln_flag_filter": f"WITH {_ALN} SELECT ord, flag FROM aln WHERE (flag & 3844) = 0",
    "aln_xm_filter": f"WITH {_ALN} SELECT ord, xm FROM aln WHERE xm IS NULL OR NOT regexp_matches(xm, '[XHU]')",
    "aln_strand": f"WITH {_ALN} SELECT ord, flag, {_SYM} AS strand FROM (SELECT ord, flag, {_WC} AS wc FROM aln) WHERE wc IS NOT NULL",
    "aln_flag_string": f"""WITH {_ALN}, f AS (SELECT DISTINCT flag FROM aln)
SELECT flag, array_to_string(list_filter([CASE WHEN (flag & 1) <> 0 THEN 'PAIRED' END, CASE WHEN (flag & 2) <> 0 THEN 'PROPER_PAIR' END, CASE WHEN (flag & 4) <> 0 THEN 'UNMAP' END, CASE WHEN (flag & 8) <> 0 THEN 'MUNMAP' END,
  CASE WHEN (flag & 16) <> 0 THEN 'REVERSE' END, CASE WHEN (flag & 32) <> 0 THEN 'MREVERSE' END, CASE WHEN (flag & 64) <> 0 THEN 'READ1' END, CASE WHEN (flag & 128) <> 0 THEN 'READ2' END,
  CASE WHEN (flag & 1024) <> 0 THEN 'DUP' END], lambda x: x IS NOT NULL), ',') AS names, flag AS again FROM f""",
    "aln_cigar_lengths": f"WITH {_ALN} SELECT ord, qlen, rlen, pos + rlen AS endpos FROM aln",
    "aln_site_join": f"WITH {_bases()} SELECT ord, site FROM bases",
    "aln_methylation_bs": f"WITH {_bases()} SELECT ord, site, met, q FROM bases",
    "aln_methylation_taps": f"WITH {_bases('TAPS')} SELECT ord, site, met, q FROM bases",
    "aln_region_select": f"WITH {_ALN} {_SELECTED} SELECT ord, chr, pos FROM chosen",
    "convert_single_end": _single(True),
    "convert_nondirectional": _single(False),
    "mate_pair": f"WITH {_paired()} SELECT ord, qname, pair FROM pairs",
    "mate_union_max_quality": f'WITH {_paired()} SELECT chr, beg, "end", hap, strand FROM instances',
    "convert_paired": f"WITH {_paired()} {_COUNTED}",
    "convert_evicting": f"WITH {_paired()} {_COUNTED}",
    "convert_paired_taps": f"WITH {_paired('TAPS')} {_COUNTED}",
    "convert_regions": f"WITH {_paired('BS', 'aln').replace('FROM aln WHERE (flag & 3844) = 0', 'FROM aln a WHERE (flag & 3844) = 0 AND EXISTS (SELECT 1 FROM bed b WHERE b.chr = a.chr AND a.pos + 1 <= b.' + chr(34) + 'end' + chr(34) + ' AND a.pos + a.len >= b.beg + 1)').replace('WITH ', '').replace('accepted AS', _BED.strip() + ', accepted AS', 1)} {_COUNTED}",
    "convert_evicting_far": _evicting(),
    "mate_evict_far": _meetings(),
    "mate_evict_all": _meetings("aln"),
    "genotype_likelihood": _likelihoods(),
    "aln_mapq_cap": f"WITH {_ALN}, {_CAP} SELECT ord, CAST(CASE WHEN t > 40 THEN -1 ELSE floor(sqrt((40 - greatest(t, 0.0)) / 40) * 40 + 0.499) END AS INTEGER) AS cap FROM t",
    "region_parse": """WITH s AS (SELECT s_suppkey AS id, 'chr' || CAST(s_suppkey % 5 AS VARCHAR) AS c, 310 + s_suppkey % 677 AS a FROM supplier)
SELECT id, CASE id % 6 WHEN 0 THEN c WHEN 1 THEN c || ':' || a WHEN 2 THEN c || ':' || a || '-' || (a + 283) WHEN 3 THEN c || ':-' || a
    WHEN 4 THEN c || ':7,' || a || '-8,' || a ELSE '{' || c || '}:' || a || 'k-' || (a + 1) || '.5K' END AS region, c AS chr,
  CAST(CASE id % 6 WHEN 1 THEN a - 1 WHEN 2 THEN a - 1 WHEN 4 THEN 6999 + a WHEN 5 THEN 1000 * a - 1 ELSE 0 END AS BIGINT) AS beg,
  CAST(CASE id % 6 WHEN 2 THEN a + 283 WHEN 3 THEN a WHEN 4 THEN 8000 + a WHEN 5 THEN 1000 * (a + 1) + 500 ELSE 9223372036854775807 END AS BIGINT) AS "end" FROM s""",
    "fisher_exact_strands": f"""WITH {_sums("strand")},
t AS (
  SELECT chr, pos, sum(CASE WHEN strand = '+' THEN meth ELSE 0 END) AS a, sum(CASE WHEN strand = '+' THEN total - meth ELSE 0 END) AS b,
    sum(CASE WHEN strand = '-' THEN meth ELSE 0 END) AS c, sum(CASE WHEN strand = '-' THEN total - meth ELSE 0 END) AS d FROM sums GROUP BY 1, 2
),
k AS (SELECT *, unnest(range(CAST(greatest(0, a - d) AS BIGINT), CAST(least(a + b, a + c) AS BIGINT) + 1)) AS k FROM t),
p AS (
  SELECT chr, pos, a, k, exp(lgamma(a + b + 1.0) - lgamma(k + 1.0) - lgamma(a + b - k + 1.0) + lgamma(c + d + 1.0) - lgamma(a + c - k + 1.0) - lgamma(d - a + k + 1.0)
    - lgamma(a + b + c + d + 1.0) + lgamma(a + c + 1.0) + lgamma(b + d + 1.0)) AS p FROM k
),
own AS (SELECT chr, pos, p AS own FROM p WHERE k = a)
SELECT p.chr, p.pos, round(least(1.0, sum(p.p) FILTER (p.p <= own * (1 + 1e-8))), 6) AS p_two FROM p JOIN own ON own.chr = p.chr AND own.pos = p.pos GROUP BY 1, 2""",
    "mate_evict": f"""WITH {_bases()}, idx AS (SELECT chr, qname, row_number() OVER (ORDER BY ord) - 1 AS idx FROM accepted),
two AS (SELECT chr, qname, min(idx) AS i, max(idx) AS j FROM idx GROUP BY 1, 2 HAVING count(*) = 2)
SELECT chr, qname, i, j, ((i + 101 + 999) // 1000) * 1000 <= j + 1 AS broken FROM two""",
    "bed_normalise": f'WITH {_BED} SELECT ord, chr, beg + 1 AS beg, "end" FROM bed',
    "region_overlap_semi": f"""WITH {_HAPS}, {_BED} SELECT chr, beg, "end", hap, cnt, strand FROM haps h
WHERE EXISTS (SELECT 1 FROM bed b WHERE b.chr = h.chr AND h.beg <= b."end" AND h."end" >= b.beg + 1)""",
    "region_missed_anti": f"""WITH {_HAPS}, {_BED} SELECT ord, chr, beg + 1 AS beg, "end" FROM bed b
WHERE NOT EXISTS (SELECT 1 FROM haps h WHERE b.chr = h.chr AND h.beg <= b."end" AND h."end" >= b.beg + 1)""",
    "region_compact": f"""WITH {_BED}, o AS (SELECT chr, beg + 1 AS beg, "end", max("end") OVER (PARTITION BY chr ORDER BY beg, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bed),
r AS (SELECT *, sum(CASE WHEN beg <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY beg, "end" ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT chr, min(beg) AS beg, max("end") AS "end" FROM r GROUP BY chr, run""",
    "depth_pileup": f"WITH {_ALN} SELECT chr, p AS position, count(*) AS depth FROM (SELECT chr, unnest(range(pos + 1, pos + rlen + 1)) AS p FROM aln WHERE (flag & 3844) = 0) GROUP BY 1, 2",
    "pileup_bases": f"""WITH {_ALN}, u AS (SELECT chr, unnest(range(pos + 1, pos + rlen + 1)) AS position, pos, m1, m2, del FROM aln WHERE (flag & 3844) = 0)
SELECT chr, position, CASE WHEN position - pos > m1 + m2 AND position - pos <= m1 + m2 + del THEN 'D' ELSE 'M' END AS kind, count(*) AS n FROM u GROUP BY 1, 2, 3""",
    "index_stats": f"WITH {_ALN} SELECT chr, count(*) FILTER ((flag & 4) = 0) AS mapped, count(*) FILTER ((flag & 4) <> 0) AS unmapped FROM aln GROUP BY chr",
    "overlap_quality": f"""WITH {_bases()}, p AS (SELECT chr, qname, site AS position, ord, coalesce(met, '?') AS base, q FROM bases),
m AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY chr, qname, position ORDER BY ord) AS rn, sum(q) OVER w - q AS other, min(base) OVER w = max(base) OVER w AS same FROM p WINDOW w AS (PARTITION BY chr, qname, position))
SELECT chr, qname, position, ord, base, q, CAST(CASE WHEN n <> 2 THEN q WHEN same THEN CASE WHEN rn = 1 THEN least(q + other, 200) ELSE 0 END
  WHEN q > other OR (q = other AND rn = 1) THEN floor(q * 0.8) ELSE 0 END AS INTEGER) AS q_new FROM m""",
    "variant_type": f"WITH {_VAR} SELECT id, ref, alt, type, n FROM kinds",
    "variant_is_snp": f"WITH {_VAR} SELECT id, length(ref) = 1 AND ((length(alt) = 1 AND alt <> '*') OR alt IN ('<X>', '<*>')) AS snp FROM vars",
    "genotype_class": f"""WITH {_GT} SELECT gt, CASE WHEN contains(gt, '.') THEN 6 WHEN length(gt) = 1 THEN CASE WHEN gt = '0' THEN 4 ELSE 5 END
  WHEN gt = '0/0' THEN 0 WHEN contains(gt, '0') THEN 2 WHEN gt[1] = gt[3] THEN 1 ELSE 3 END AS class, count(*) AS n FROM gts GROUP BY 1, 2""",
    "allele_count": f"WITH {_GT}, e AS (SELECT variant, TRY_CAST(unnest(string_split(gt, '/')) AS INTEGER) AS allele FROM gts) SELECT variant, allele, count(*) AS n FROM e WHERE allele IS NOT NULL GROUP BY 1, 2",
    "variant_synchronized": f"""WITH {_VAR},
l AS (SELECT chr, pos, ref, alt, type, row_number() OVER (PARTITION BY chr, pos, type ORDER BY ref, alt) AS k FROM kinds WHERE id % 3 <> 0),
r AS (SELECT chr, pos, ref, alt, type, row_number() OVER (PARTITION BY chr, pos, type ORDER BY ref, alt) AS k FROM kinds WHERE id % 3 <> 1)
SELECT coalesce(l.chr, r.chr) AS chr, coalesce(l.pos, r.pos) AS pos, l.ref AS l_ref, l.alt AS l_alt, r.ref AS r_ref, r.alt AS r_alt
FROM l FULL OUTER JOIN r ON l.chr = r.chr AND l.pos = r.pos AND l.type = r.type AND l.k = r.k""",
    "streamed_event_haplotypes": "SELECT date_trunc('hour', ts) AS window_start, event_type AS chr, CAST(count(*) AS BIGINT) AS cnt, CAST(sum(CASE WHEN value >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS meth FROM events GROUP BY 1, 2",
    "variant_synchronized_many": f"""WITH {_VAR},
t AS (SELECT id, chr, pos // 111 * 111 AS pos, ref, alt, k FROM vars CROSS JOIN (VALUES (0), (1), (2)) v(k) WHERE id % 4 <> k),
n AS (SELECT *, row_number() OVER (PARTITION BY k, chr, pos, ref, alt ORDER BY id) AS copy FROM t)
SELECT chr, pos, max(CASE WHEN k = 0 THEN ref END) AS ref0, max(CASE WHEN k = 0 THEN alt END) AS alt0, max(CASE WHEN k = 1 THEN ref END) AS ref1, max(CASE WHEN k = 1 THEN alt END) AS alt1,
  max(CASE WHEN k = 2 THEN ref END) AS ref2, max(CASE WHEN k = 2 THEN alt END) AS alt2
FROM n GROUP BY chr, pos, ref, alt, copy""",
    "variant_targets_by_alleles": f"WITH {_VAR} SELECT id, chr, pos FROM kinds WHERE (id % 5 = 0 AND type = 4) OR (id % 5 = 1 AND type <> 4)",
    "bam_folder_reads": f"WITH {_ALN} SELECT qname, flag, chr, pos, CAST(ord // 2 % 60 AS INTEGER) AS mapq, cigar, seq, qual FROM aln",
    "fastq_records": f"WITH {_ALN} SELECT CAST(ord AS VARCHAR) AS name, seq, CASE WHEN qual = '*' THEN repeat('I', length(seq)) ELSE qual END AS qual FROM aln",
    "aln_insertions": f"WITH {_ALN} SELECT ord, pos + m1 AS position, substr(seq, clip + m1 + 1, ins) AS bases FROM aln",
    "variant_remove_alleles": """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'C,T' ELSE 'C,G,T' END AS alts,
  array_to_string([p_partkey + i FOR i IN CASE WHEN p_partkey % 2 = 0 THEN [0, 2] ELSE [0, 1, 2] END], ',') AS a,
  array_to_string([p_partkey + i FOR i IN CASE WHEN p_partkey % 2 = 0 THEN [0, 1, 3] ELSE [0, 1, 2, 3] END], ',') AS r,
  array_to_string([p_partkey + i FOR i IN CASE WHEN p_partkey % 2 = 0 THEN [0, 1, 2, 6, 7, 9] ELSE [0, 1, 2, 3, 4, 5, 6, 7, 8, 9] END], ',') AS g FROM part""",
    "variant_targets": f"WITH {_VAR}, {_BED} SELECT id, chr, pos FROM vars v WHERE EXISTS (SELECT 1 FROM bed b WHERE b.chr = v.chr AND v.pos BETWEEN b.beg + 1 AND b.\"end\")",
    "variant_targets_excluded": f"WITH {_VAR}, {_BED} SELECT id, chr, pos FROM vars v WHERE NOT EXISTS (SELECT 1 FROM bed b WHERE b.chr = v.chr AND v.pos BETWEEN b.beg + 1 AND b.\"end\")",
    "list_chromosomes": "SELECT DISTINCT 'chr' || CAST(l_partkey % 5 AS VARCHAR) AS chr FROM lineitem",
    "text_utilities": "SELECT p_partkey, md5(p_name) AS md5, string_split(p_name, ' ')[1] AS word, p_name AS decoded, p_name AS again FROM part",
}
