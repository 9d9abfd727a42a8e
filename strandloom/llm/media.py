"""Media columns as progressive JPEG.

``encode_payload`` stores bytes losslessly as the coefficients of a 4:2:0 colour image: 64
bytes a block (the format's unit), blocks filling the Y, Cb and Cr planes in turn.  The
stream is a spectral-selection and successive-approximation script: DC and two AC bands
without their last bits, then the last bits of DC and of all AC coefficients.

``Image`` reads any Huffman-coded progressive stream of one or three 8-bit components:
scans are accumulated into coefficient arrays, multiplied by the quantisation table and
inverse-transformed in numpy, chroma is upsampled, and the result is a full-resolution RGB
tensor.  Scans whose code table has one symbol only have a layout known in advance and are
read as bytes or bit planes; all others go symbol by symbol.

Every byte is a coefficient of its own.  DC is byte - 128.  In the AC bands a byte b is b itself
from 128 on and below that the negative of 254 - b (256 - b if b is odd), so that without the
last bit all have a magnitude of 64 to 127: one class with seven more bits, which behind a code of
one bit fill a byte.  So coded bytes repeat where the text does, and the stored table compresses
nearly as the text would, but for the last bits.  The number of bytes stands in a comment segment.

``tensors`` writes the table of media, reads it back, and writes the table of RGB tensors with
their figures.  A tensor has two bytes a byte of text (more for short ones, which fill one unit).
AC coefficients are quantised by one, the finest step, so pixels vary with the text and the
tensors hardly compress: they are the larger table.  ``media_digests`` needs their figures only.
It stores the media whole and the tensors of one slice of them after another; a slice's tensors
are deleted when its figures have been read from them and stored, before the next slice's are
written.  The last slice's (of small tables: all) stay.

Cases: a null or empty text is stored as one block of zeros; texts of any length up to
6.4 GB fit one image; equal texts have equal images and features; rows that repeat are
stored each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cached_property, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, stored, stored_files, tidy

BLOCK = 64
BANDS = ((1, 5), (6, 63))
_ZIGZAG = np.asarray([i * 8 + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
DIGESTS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
#: Rows yielded together hold about so many bytes.
SLICE_BYTES = 4_000_000
#: Rows of a stored file of media.
FILE_ROWS = 2048
#: Tensors on disk at once are those of about one in SLICES bytes of media, or of LEAST_SLICE bytes.
SLICES, LEAST_SLICE = 16, 8 << 20

# code tables as (number of codes of each length, symbols)
_DC_CODES = ([0, 0, 7, 1] + [0] * 12, [6, 5, 4, 3, 7, 2, 1, 0])
_AC_FIRST = ([1] + [0] * 15, [0x07])
_AC_REFINE = ([1] + [0] * 15, [0x00])
QUANTISATION = [8] + [1] * 63


def _compressed(level: int) -> dict[str, str]:
    """Options of a stored table."""
    return {"compression": "zstd", "parquet.compression.codec.zstd.level": str(level)}


def _idct_basis() -> np.ndarray:
    k = np.arange(8)
    c = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None] == 0, np.sqrt(0.125), 0.5)
    both = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return both[_ZIGZAG]


#: Row z holds the pixels of zigzag coefficient z.
_BASIS = _idct_basis()


@lru_cache(16)
def _scaled_basis(quant: bytes) -> np.ndarray:
    """The basis times a quantisation table, both as 32-bit floats."""
    return (np.frombuffer(quant, np.float32)[:, None] * _BASIS).astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, slot: int, codes) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | slot, *codes[0], *codes[1]]))


def _packed(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes of a 0/1 array: padded with ones, 0xFF stuffed."""
    extra = -len(bits) % 8
    if extra:
        bits = np.concatenate([bits, np.ones(extra, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _scan(parts: list[tuple[int, int]], lo: int, hi: int, high: int, low: int, coded: np.ndarray | bytes) -> bytes:
    """A scan of entropy-coded bytes, or of bits to be packed."""
    body = bytes([len(parts)]) + b"".join(bytes(p) for p in parts) + bytes([lo, hi, high << 4 | low])
    return _segment(0xDA, body) + (coded if isinstance(coded, bytes) else _packed(coded))


def _canonical(codes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length)"""
    out, code, at = {}, 0, 0
    for length, n in enumerate(codes[0], 1):
        for s in codes[1][at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _spread(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits of each value, most significant first, ``size`` of them each, joined."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    owner = np.repeat(np.arange(len(size)), size)
    shift = ends[owner] - 1 - np.arange(total)
    return ((value[owner] >> shift) & 1).astype(np.uint8)


def _dc_bits(values: np.ndarray) -> np.ndarray:
    """Bits of one component sequence after another is not enough in an interleaved scan:
    ``values`` are differences in scan order already."""
    codes = _canonical(_DC_CODES)
    code = np.asarray([codes[s][0] for s in range(8)])
    length = np.asarray([codes[s][1] for s in range(8)])
    size = np.zeros(len(values), np.int64)
    magnitude = np.abs(values)
    while magnitude.any():
        size += magnitude > 0
        magnitude = magnitude >> 1
    extra = np.where(values < 0, values + (1 << size) - 1, values)
    return _spread((code[size] << size) | extra, length[size] + size)


def _shape(blocks: int) -> tuple[int, int]:
    """MCUs across and down for so many blocks."""
    mcus = -(-blocks // 6)
    across = int(np.ceil(np.sqrt(mcus)))
    return across, -(-mcus // across)


def _mcu_order(across: int, down: int) -> np.ndarray:
    """Raster indices of the luma blocks in MCU order, (mcus, 4)."""
    y, x = np.divmod(np.arange(across * down), across)
    at = 2 * y * (2 * across) + 2 * x
    return np.stack([at, at + 1, at + 2 * across, at + 2 * across + 1], axis=1)


def encode_payload(raw: bytes) -> bytes:
    """A progressive JPEG that holds ``raw`` losslessly in its coefficients."""
    blocks = max(1, -(-len(raw) // BLOCK))
    across, down = _shape(blocks)
    mcus = across * down
    data = np.zeros((6 * mcus, BLOCK), np.uint8)
    data.reshape(-1)[: len(raw)] = np.frombuffer(raw, np.uint8)
    planes = [data[: 4 * mcus], data[4 * mcus : 5 * mcus], data[5 * mcus :]]
    out = [
        b"\xff\xd8",
        _segment(0xFE, b"bytes=%d" % len(raw)),
        _segment(0xDB, bytes([0, *QUANTISATION])),
        _segment(0xC2, bytes([8]) + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _table(0, 0, _DC_CODES),
        _table(1, 0, _AC_FIRST),
        _table(1, 1, _AC_REFINE),
    ]
    dc = [p[:, 0].astype(np.int64) - 128 for p in planes]
    order = _mcu_order(across, down)
    luma = (dc[0] >> 1)[order.reshape(-1)]
    steps = [np.diff(x, prepend=0) for x in (luma, dc[1] >> 1, dc[2] >> 1)]
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1, _dc_bits(np.concatenate([steps[0].reshape(-1, 4), steps[1][:, None], steps[2][:, None]], axis=1).reshape(-1))))
    for c, plane in enumerate(planes, 1):
        for lo, hi in BANDS:
            # code "0" and seven bits make a byte, never 0xFF
            out.append(_scan([(c, 0)], lo, hi, 0, 1, (plane[:, lo : hi + 1] >> 1).tobytes()))
    last = [x & 1 for x in dc]
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0, np.concatenate([last[0][order], last[1][:, None], last[2][:, None]], axis=1).reshape(-1).astype(np.uint8)))
    for c, plane in enumerate(planes, 1):
        bits = plane & 1
        bits[:, 0] = 0  # the code of "end of block"; the corrections follow it
        out.append(_scan([(c, 1)], 1, BLOCK - 1, 1, 0, bits.reshape(-1)))
    out.append(b"\xff\xd9")
    return b"".join(out)


class _Bits:
    """Bits of one restart interval."""

    def __init__(self, raw: bytes):
        self.raw = np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8)
        self.at = 0
        self._list = None

    @cached_property
    def bits(self) -> np.ndarray:
        return np.unpackbits(self.raw)

    def one(self) -> int:
        if self._list is None:
            self._list = self.bits.tolist()
        b = self._list[self.at]
        self.at += 1
        return b

    def many(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.one()
        return v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.one()
            s = table.get((length, code))
            if s is not None:
                return s
        raise ValueError("no such code")


def _extend(v: int, size: int) -> int:
    return v - (1 << size) + 1 if size and v < 1 << (size - 1) else v


def _dc_symbols(bits: _Bits, table: dict, n: int) -> np.ndarray:
    """n DC differences that share one code table, by a chain over all bit places."""
    raw = bits.bits[bits.at :]
    wide = np.concatenate([raw, np.ones(32, np.uint8)]).astype(np.int64)
    size = np.full(len(raw), -1, np.int64)
    length = np.zeros(len(raw), np.int64)
    window, upto = np.zeros(len(raw), np.int64), 0
    for (bits_of, code), s in sorted(table.items()):
        while upto < bits_of:
            window = window << 1 | wide[upto : upto + len(raw)]
            upto += 1
        hit = (window == code) & (size < 0)
        size[hit] = s
        length[hit] = bits_of
    ahead = np.where(size >= 0, length + size, 1).tolist()
    places, p = [], 0
    for _ in range(n):
        places.append(p)
        p += ahead[p]
    at = np.asarray(places, np.int64)
    s, start = size[at], at + length[at]
    if (s < 0).any():
        raise ValueError("no such code")
    value = np.zeros(n, np.int64)
    for k in range(int(s.max(initial=0))):
        on = s > k
        value[on] = value[on] << 1 | wide[start[on] + k]
    bits.at += p
    return np.where((s > 0) & (value < 1 << np.maximum(s - 1, 0)), value - (1 << s) + 1, value)


def _ac_first(bits: _Bits, table: dict, coefs: np.ndarray, lo: int, hi: int, low: int) -> None:
    """First scan of a band, for blocks in scan order (a view or copy of the coefficients)."""
    n, width = len(coefs), hi - lo + 1
    if len(table) == 1:
        ((length, _), s), = table.items()
        if s >> 4 == 0 and s & 15:
            size = s & 15
            wide, odd = divmod(length + size, 8)
            if not odd and size <= 8 and not bits.at:  # whole bytes, the value in the last
                value = (bits.raw[wide - 1 : n * width * wide : wide] & ((1 << size) - 1)).astype(np.int32).reshape(n, width)
                bits.at += 8 * n * width * wide
                coefs[:, lo : hi + 1] = np.where(value < 1 << (size - 1), value - (1 << size) + 1, value) << low
                return
            flat = bits.bits[bits.at : bits.at + n * width * (length + size)].reshape(n, width, length + size)[:, :, length:]
            bits.at += n * width * (length + size)
            value = flat[:, :, 0].astype(np.int32)
            for k in range(1, size):
                value = value << 1 | flat[:, :, k]
            value = np.where(value < 1 << (size - 1), value - (1 << size) + 1, value)
            coefs[:, lo : hi + 1] = value << low
            return
    run = 0
    for b in range(n):
        if run:
            run -= 1
            continue
        k = lo
        while k <= hi:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            if size:
                k += zeros
                coefs[b, k] = _extend(bits.many(size), size) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) - 1 + (bits.many(zeros) if zeros else 0)
                break


def _ac_refine(bits: _Bits, table: dict, coefs: np.ndarray, lo: int, hi: int, low: int) -> None:
    """A later scan of a band: one more bit of the known coefficients, and new ones."""
    n, width, step = len(coefs), hi - lo + 1, 1 << low
    if len(table) == 1 and next(iter(table.values())) == 0:
        length = next(iter(table))[0]
        band = coefs[:, lo : hi + 1]
        known = band != 0
        if known.all():
            flat = bits.bits[bits.at : bits.at + n * (length + width)].reshape(n, length + width)[:, length:]
            bits.at += n * (length + width)
            coefs[:, lo : hi + 1] = band + np.where(band > 0, step, -step) * flat
            return
    run = 0
    for b in range(n):
        row, k = coefs[b], lo

        def correct(k):
            if bits.one() and not int(abs(row[k])) & step:
                row[k] += step if row[k] > 0 else -step

        if not run:
            while k <= hi:
                s = bits.symbol(table)
                zeros, size, new = s >> 4, s & 15, 0
                if size:
                    new = step if bits.one() else -step
                elif zeros < 15:
                    run = (1 << zeros) + (bits.many(zeros) if zeros else 0)
                    break
                while k <= hi:
                    if row[k]:
                        correct(k)
                    elif zeros:
                        zeros -= 1
                    else:
                        break
                    k += 1
                if new and k <= hi:
                    row[k] = new
                k += 1
        if run:
            for j in range(k, hi + 1):
                if row[j]:
                    correct(j)
            run -= 1


_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _lone(wide: int, tall: int, stride: int) -> np.ndarray:
    """Indices of a lone component's blocks in scan order, rows of ``stride`` blocks."""
    return (np.arange(tall)[:, None] * stride + np.arange(wide)[None, :]).reshape(-1, 1)


def _interleaved(across: int, down: int, h: int, v: int) -> np.ndarray:
    """Indices of the h x v blocks that a component has in each unit, in scan order."""
    y, x = np.divmod(np.arange(across * down), across)
    dy, dx = np.divmod(np.arange(h * v), h)
    return (y[:, None] * v + dy) * (across * h) + x[:, None] * h + dx


#: Places are kept for images of up to so many units.
KEPT_MCUS = 1024
_kept_lone, _kept_interleaved = lru_cache(128)(_lone), lru_cache(128)(_interleaved)


@lru_cache(64)
def _decoding(table: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a table: 16 counts, then the symbols."""
    return {(length, code): s for s, (code, length) in _canonical((list(table[:16]), list(table[16:]))).items()}


class Image:
    """A decoded stream: coefficient arrays, comment, and pixels on demand."""

    def __init__(self, stream: bytes):
        self.comment = b""
        self.parts: list[dict] = []
        self.places: dict[tuple, list[np.ndarray]] = {}
        quant, codes, restart, at = {}, {}, 0, 2
        if stream[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG stream")
        while at < len(stream):
            marker = stream[at + 1]
            if marker == 0xD9:
                break
            size = int.from_bytes(stream[at + 2 : at + 4], "big")
            body = stream[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    codes[body[0]] = _decoding(bytes(body[1 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xDD:
                restart = int.from_bytes(body, "big")
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xDA:
                end = _NEXT.search(stream, at)
                stop = end.start() if end else len(stream)
                self._scan(body, stream[at:stop], codes, restart)
                at = stop
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("only Huffman-coded progressive streams are read")
        self.quant = quant

    def _frame(self, body: bytes) -> None:
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        for i in range(body[5]):
            c, hv, q = body[6 + 3 * i : 9 + 3 * i]
            self.parts.append({"id": c, "h": hv >> 4, "v": hv & 15, "q": q})
        self.h, self.v = max(p["h"] for p in self.parts), max(p["v"] for p in self.parts)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for p in self.parts:
            p["wide"], p["tall"] = self.across * p["h"], self.down * p["v"]
            p["coefs"] = np.zeros((p["wide"] * p["tall"], 64), np.int32)

    def _places(self, parts: list[dict]) -> list[np.ndarray]:
        """For each component of a scan, (units, blocks a unit) indices in scan order."""
        key = tuple(p["id"] for p in parts)
        if key not in self.places:
            self.places[key] = self._find_places(parts)
        return self.places[key]

    def _find_places(self, parts: list[dict]) -> list[np.ndarray]:
        small = self.across * self.down <= KEPT_MCUS
        if len(parts) == 1:
            p = parts[0]
            wide, tall = -(-self.width * p["h"] // (8 * self.h)), -(-self.height * p["v"] // (8 * self.v))
            return [(_kept_lone if small else _lone)(wide, tall, p["wide"])]
        return [(_kept_interleaved if small else _interleaved)(self.across, self.down, p["h"], p["v"]) for p in parts]

    def _scan(self, head: bytes, data: bytes, codes: dict, restart: int) -> None:
        n = head[0]
        by_id = {p["id"]: p for p in self.parts}
        parts = [by_id[head[1 + 2 * i]] for i in range(n)]
        slots = [head[2 + 2 * i] for i in range(n)]
        lo, hi, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        places = self._places(parts)
        units = len(places[0])
        step = restart or units
        pieces = _RESTART.split(data) if restart else [data]
        for k, piece in enumerate(pieces):
            bits = _Bits(piece)
            own = [p[k * step : (k + 1) * step] for p in places]
            if lo == 0:
                self._dc(bits, parts, slots, own, codes, high, low)
                continue
            index = own[0].reshape(-1)
            every = len(index) == len(parts[0]["coefs"])  # a lone component's blocks are in order
            coefs = parts[0]["coefs"] if every else parts[0]["coefs"][index]
            (_ac_refine if high else _ac_first)(bits, codes[0x10 | slots[0] & 15], coefs, lo, hi, low)
            if not every:
                parts[0]["coefs"][index] = coefs

    def _dc(self, bits: _Bits, parts, slots, own, codes, high: int, low: int) -> None:
        wide = [o.shape[1] for o in own]
        units = len(own[0])
        at = np.concatenate([[0], np.cumsum(wide)])
        n = units * int(at[-1])
        if high:
            flat = bits.bits[bits.at : bits.at + n].reshape(units, -1).astype(np.int32) << low
            for p, o, a, b in zip(parts, own, at, at[1:]):
                p["coefs"][o, 0] |= flat[:, a:b]
            return
        tables = [codes[s >> 4] for s in slots]
        if all(t == tables[0] for t in tables):
            steps = _dc_symbols(bits, tables[0], n).reshape(units, -1)
        else:
            steps = np.zeros((units, int(at[-1])), np.int64)
            for u in range(units):
                for t, a, b in zip(tables, at, at[1:]):
                    for j in range(a, b):
                        size = bits.symbol(t)
                        steps[u, j] = _extend(bits.many(size), size)
        for p, o, a, b in zip(parts, own, at, at[1:]):
            p["coefs"][o.reshape(-1), 0] = np.cumsum(steps[:, a:b].reshape(-1)) << low

    def _plane(self, p: dict) -> np.ndarray:
        pixels = p["coefs"].astype(np.float32) @ _scaled_basis(self.quant[p["q"]].tobytes())
        pixels += np.float32(128.5)
        np.maximum(pixels, 0, out=pixels)
        np.minimum(pixels, 255, out=pixels)
        return pixels.astype(np.uint8).reshape(p["tall"], p["wide"], 8, 8).swapaxes(1, 2).reshape(p["tall"] * 8, p["wide"] * 8)

    def rgb(self) -> np.ndarray:
        """(height, width, 3) uint8."""
        planes = [self._plane(p) for p in self.parts]
        if len(planes) == 1:
            return np.repeat(self._full(planes[0], self.parts[0])[:, :, None], 3, axis=2)
        y = self._full(planes[0], self.parts[0]).astype(np.int16)
        part = self.parts[1]
        if (part["h"], part["v"]) != (self.parts[2]["h"], self.parts[2]["v"]):
            planes[1:] = [self._full(x, p) for x, p in zip(planes[1:], self.parts[1:])]
            part = {"h": self.h, "v": self.v}
        cb, cr = planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
        # the usual colour transform in 16-bit fixed point; what chroma adds is rounded before it is
        # upsampled, as whole luma values do not change the rounding
        added = np.stack([91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb])
        added += 32768
        added >>= 16
        both = np.stack([self._full(x, part) for x in added.astype(np.int16)])
        both += y
        np.maximum(both, 0, out=both)
        np.minimum(both, 255, out=both)
        out = np.empty((self.height, self.width, 3), np.uint8)
        out[:] = both.transpose(1, 2, 0)
        return out

    def _full(self, plane: np.ndarray, part: dict) -> np.ndarray:
        """A component's plane at the image's size."""
        if part["h"] < self.h:
            plane = plane.repeat(self.h // part["h"], axis=1)
        if part["v"] < self.v:
            plane = plane.repeat(self.v // part["v"], axis=0)
        return plane[: self.height, : self.width]


def payload_of(image: Image) -> tuple[bytes, int]:
    """The stored payload (padded to blocks) and the number of its own bytes."""
    n = int(image.comment.removeprefix(b"bytes="))
    size = max(1, -(-n // BLOCK)) * BLOCK
    data = np.concatenate([p["coefs"] for p in image.parts])[: size // BLOCK]
    size_of = np.abs(data)
    out = np.where(data > 0, data, 254 - size_of + 2 * (size_of & 1)).astype(np.uint8)
    out[:, 0] = data[:, 0] + 128
    return out.tobytes(), n


def features(rgb: np.ndarray) -> str:
    """Size, then mean and deviation of each channel and the share of saturated values."""
    n = rgb.shape[0] * rgb.shape[1]
    flat = rgb.reshape(-1, 3)
    counts = [np.bincount(flat[:, c], minlength=256) for c in range(3)]
    level = np.arange(256)
    out = []
    for k in counts:
        mean = int((k * level).sum()) / n
        out.append(f"{mean:.3f}/{(int((k * level * level).sum()) / n - mean * mean) ** 0.5:.3f}")
    full = sum(int(k[0] + k[255]) for k in counts) / (3 * n)
    return f"{rgb.shape[1]}x{rgb.shape[0]} {' '.join(out)} {full:.4f}"


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id and ``media``, the text's bytes as a progressive JPEG."""

    def run(batches):
        for batch in batches:
            ids, media, size = [], [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                media.append(encode_payload((text or "").encode()))
                ids.append(i)
                size += len(media[-1])
                if size >= SLICE_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(media, pa.binary())], names=["doc_id", "media"])
                    ids, media, size = [], [], 0
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, media binary")


def decode_media(media: DataFrame, keep_tensor: bool = False) -> DataFrame:
    """Digests and features of the stored images, read back; with ``keep_tensor`` also
    height, width and the RGB bytes."""
    names = list(DIGESTS)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    if keep_tensor:
        names += ["height", "width", "rgb"]
        kinds += [pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        for batch in batches:
            ids, rows, size = [], [], 0
            for i in range(batch.num_rows):
                stream = batch.column(1)[i].as_py()
                image = Image(stream)
                payload, n = payload_of(image)
                rgb = image.rgb()
                row = [n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stream), hashlib.sha256(stream).hexdigest(), features(rgb)]
                if keep_tensor:
                    row += [rgb.shape[0], rgb.shape[1], rgb.tobytes()]
                rows.append(row)
                ids.append(i)
                size += rgb.nbytes if keep_tensor else 200
                if size >= SLICE_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)
                    ids, rows, size = [], [], 0
        tidy()

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "media").mapInArrow(run, schema + ", height int, width int, rgb binary" * keep_tensor)


def _stored_media(docs: DataFrame) -> DataFrame:
    return stored(encode_media(docs), "media", maxRecordsPerFile=str(FILE_ROWS), **_compressed(6))


def _stored_tensors(media: DataFrame) -> DataFrame:
    return stored(decode_media(media, keep_tensor=True), "tensors", **_compressed(1))


def tensors(docs: DataFrame) -> DataFrame:
    """The stored table of RGB tensors and figures, made from the stored table of media."""
    return _stored_tensors(_stored_media(docs))


def _slices(media: DataFrame) -> list[DataFrame]:
    """A stored table of media, dealt out by files; no slice but one of a single file is larger than
    a SLICES-th of the table or LEAST_SLICE bytes."""
    files = stored_files(media)
    most = max(LEAST_SLICE, -(-sum(n for _, n in files) // SLICES))
    groups, size = [[]], 0
    for uri, n in files:
        if groups[-1] and size + n > most:
            groups.append([])
            size = 0
        groups[-1].append(uri)
        size += n
    if len(groups) == 1:
        return [media]
    return [media.sparkSession.read.schema(media.schema).parquet(*g) for g in groups]


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text in a table of media, read that back into tables of tensors, one slice at a
    time; one row a document."""
    *before, last = _slices(_stored_media(docs))
    done = []
    for part in before:
        made = _stored_tensors(part)
        done.append(stored(made.select(DIGESTS), "digests"))
        discard(made)
    return reduce(DataFrame.union, done, _stored_tensors(last).select(DIGESTS))
