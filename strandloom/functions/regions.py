"""Region strings and BED conventions."""

from __future__ import annotations

import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POS_MAX = (1 << 63) - 1
_NUMBER = re.compile(r"([+-]?)([\d,]*)(?:\.(\d*))?(?:[eE]([+-]?\d+))?([kKmMgG]?)")
_SCALE = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9}


def parse_decimal(text: str, commas: bool = True) -> tuple[int, str]:
    """(number, rest): digits with commas, a fraction, an exponent and K, M or G."""
    m = _NUMBER.match(text)
    digits = m[2] if commas else m[2].split(",")[0]
    if not digits.strip(",") and not m[3]:
        return 0, text
    if not commas and "," in m[2]:
        return int(m[1] + digits), text[len(m[1]) + len(digits) :]
    value = Decimal(f"{digits.replace(',', '') or '0'}.{m[3] or '0'}") * Decimal(10) ** int(m[4] or 0) * _SCALE[m[5].lower()]
    return (-1 if m[1] == "-" else 1) * int(value), text[m.end() :]


def _span(text: str, one_coord: bool, commas: bool) -> tuple[int, int, str]:
    """0-based half-open span of what follows the colon, and the rest."""
    if not text:
        return 0, POS_MAX, ""
    if text[0] == "-":
        end, rest = parse_decimal(text[1:], commas)
        if rest == text[1:]:
            raise ValueError(f"no number in {text!r}")
        return 0, end, rest
    beg, rest = parse_decimal(text, commas)
    if rest == text:
        raise ValueError(f"no number in {text!r}")
    beg = max(0, beg - 1)
    if not rest.startswith("-"):
        return beg, beg + 1 if one_coord else POS_MAX, rest
    tail = rest[1:]
    if not tail:
        return beg, POS_MAX, ""
    end, rest = parse_decimal(tail, commas)
    if rest == tail:
        raise ValueError(f"no number in {tail!r}")
    return beg, end, rest


def parse_region(text: str, names: list[str], one_coord: bool = False, as_list: bool = False) -> tuple[str, int, int, str]:
    """(name, beg, end, rest) of a region: 0-based, half-open.

    ``name``, ``name:n``, ``name:n-m``, ``name:n-`` and ``name:-m``; braces quote a name; the last
    colon counts; a text that is both a name and a name with a span is an error.  With
    ``as_list`` the region ends at the first comma outside braces, and the rest is returned.
    """
    known = set(names)
    if text.startswith("{"):
        close = text.find("}")
        if close < 0:
            raise ValueError(f"unclosed brace in {text!r}")
        name, tail = text[1:close], text[close + 1 :]
        if name not in known:
            raise ValueError(f"unknown sequence {name!r}")
        if not tail or (as_list and tail.startswith(",")):
            return name, 0, POS_MAX, tail[1:]
        if not tail.startswith(":"):
            raise ValueError(f"unexpected {tail!r} after a name")
        tail = tail[1:]
    else:
        body = text.split(",", 1)[0] if as_list else text
        rest = text[len(body) + 1 :]
        prefix, colon, _ = body.rpartition(":")
        if body in known:
            if colon and prefix in known:
                raise ValueError(f"{body!r} is both a name and a span; put the name in braces")
            return body, 0, POS_MAX, rest
        if not colon or prefix not in known:
            raise ValueError(f"unknown sequence in {text!r}")
        name, tail = prefix, text[len(prefix) + 1 :]
    beg, end, rest = _span(tail, one_coord, not as_list)
    if rest and as_list and rest.startswith(","):
        rest = rest[1:]
    elif rest:
        raise ValueError(f"unexpected {rest!r} in {text!r}")
    if end <= beg:
        raise ValueError(f"{text!r} ends before it begins")
    return name, beg, end, rest


def parse_regions(text: Column, names: list[str], one_coord: bool = False) -> Column:
    """struct<chr, beg, end> of a column of regions, as ``parse_region`` reads one; null for null.
    ``names`` are those of a file's header."""

    @F.pandas_udf("chr string, beg bigint, end bigint")
    def parsed(column: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if t is None else parse_region(t, names, one_coord)[:3] for t in column]
        frame = pd.DataFrame(rows, columns=["chr", "beg", "end"], index=column.index)
        return frame.astype({"beg": "Int64", "end": "Int64"})

    return parsed(text)


def parse_summary_region(text: str) -> tuple[str, int, int]:
    """chr:beg-end, 1-based and closed, as the summary command takes it."""
    m = re.fullmatch(r"(.+):(\d+)-(\d+)", text)
    if not m:
        raise ValueError(f"not chr:beg-end: {text!r}")
    return m[1], int(m[2]), int(m[3])


def detect_region_format(path: str) -> str:
    """bed, vcf, tab or reg by a file's name."""
    stem = re.sub(r"\.(gz|bgz)$", "", path.lower())
    for ending, kind in ((".bed", "bed"), (".vcf", "vcf"), (".tab", "tab"), (".txt", "tab")):
        if stem.endswith(ending):
            return kind
    return "reg"
