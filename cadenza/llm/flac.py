"""Media columns: FLAC, encoded and decoded in batches of frames.

Frames of a batch are laid side by side and worked on together with NumPy:
one step handles the same sample of every frame. Encoded are 8-bit mono streams
with constant, verbatim, fixed and LPC subframes, whichever is smallest, and a
SEEKTABLE with a point for each frame, so any sample offset is found without a
scan. Decoded are streams of 4 to 24 bits and 1 to 8 channels, also as sums and
differences, with blocks of any size, wasted bits, and partitioned Rice
residuals with escapes; frames of one kind are decoded together, whatever
streams they are from. Header CRC-8, frame CRC-16 and the stream's MD5 are
verified.

Defined cases: null and empty texts are stored as one block of padding; texts
of any length are one stream each, in batches of bounded bytes; equal texts give
equal streams; null media stay null; a damaged stream raises ``FlacError``; an
empty table gives no rows; repeated rows give equal rows; columns that clash
with results are replaced, others stay.
"""

from __future__ import annotations

import hashlib
import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import discard, map_arrow, stage

BLOCK = 576
SEEK = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
#: Samples that are worked on at a time.
CHUNK = 1 << 21


class FlacError(ValueError):
    """The stream is damaged or of a kind that is not supported."""


@cache
def crc_table(bits: int, poly: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, (table << 1) ^ poly, table << 1) & ((1 << bits) - 1)
    return table.astype(np.uint32)


def crc(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """CRC-8 or CRC-16 of many stretches of data, a byte of each at a time."""
    table = crc_table(bits, 0x07 if bits == 8 else 0x8005)
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order].astype(np.int64), lengths[order]
    value = np.zeros(len(order), np.uint32)
    active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
    for i, n in enumerate(active.tolist()):
        v = value[:n]
        byte = data[at[:n] + i]
        value[:n] = table[byte ^ v] if bits == 8 else table[byte ^ (v >> 8)] ^ ((v << 8) & 0xFFFF)
    out = np.empty_like(value)
    out[order] = value
    return out


def utf8_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 of the format."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x40
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
        if n < limit:
            return bytes([(0xFF00 >> len(tail) + 1) & 0xFF | n, *tail[::-1]])


# ---------------------------------------------------------------- encoding


def lpc_coefficients(x: np.ndarray, order: int, precision: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors of frames (samples, frames) by Levinson and Durbin: coefficients (frames, order) and shifts."""
    n, f = x.shape
    windowed = x * np.hanning(n + 2)[1:-1, None]
    auto = np.stack([(windowed[: n - k] * windowed[k:]).sum(0) for k in range(order + 1)])
    error = auto[0] + 1e-9
    a = np.zeros((order, f))
    for i in range(order):
        k = (auto[i + 1] - (a[:i] * auto[i:0:-1]).sum(0)) / error
        a[:i] = a[:i] - k * a[:i][::-1]
        a[i] = k
        error = error * (1 - k * k) + 1e-9
    top = np.abs(a).max(0) + 1e-9
    shift = np.clip(precision - 2 - np.ceil(np.log2(top)), 0, 15).astype(np.int64)
    limit = 2 ** (precision - 1) - 1
    return np.clip(np.rint(a * 2.0**shift), -limit, limit).astype(np.int64).T, shift


def _residuals(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Of (samples, frames) after the warm-up samples; coefs (frames, order)."""
    order = coefs.shape[1]
    guess = sum((x[order - 1 - j : len(x) - 1 - j] * coefs[:, j] for j in range(order)), np.zeros_like(x[order:]))
    return x[order:] - (guess >> shift)


def encode_frames(x: np.ndarray, numbers: np.ndarray, bps: int = 8, lpc_order: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Frames of one channel: x (frames, block) ints -> bytes of all frames and their start offsets (one more)."""
    frames, block = x.shape
    xt = np.ascontiguousarray(x.T).astype(np.int32)
    # (kind byte, order, coefficients, shifts, zigzag residuals) of each way to predict
    ways = []
    for order in range(3):
        r = np.diff(xt, order, axis=0)
        ways.append((8 + order, order, None, None, (r << 1) ^ (r >> 31)))
    if lpc_order:
        coefs, shifts = lpc_coefficients(xt.astype(np.float64), lpc_order)
        r = _residuals(xt.astype(np.int64), coefs, shifts)
        ways.append((32 + lpc_order - 1, lpc_order, coefs, shifts, (r << 1) ^ (r >> 63)))
    best = np.full(frames, bps * block, np.int64)
    way, rice = np.full(frames, -1), np.zeros(frames, np.int64)  # -1: verbatim
    least = np.argmin([w[4].mean(0) for w in ways], axis=0)
    for i, (_, order, coefs, _, every) in enumerate(ways):
        own = np.flatnonzero(least == i)
        u = every[:, own]
        extra = order * bps + (9 + 12 * order if coefs is not None else 0) + 10
        for k in range(14 if len(own) else 0):
            cost = (u >> k).sum(0) + (k + 1) * (block - order) + extra
            better = own[cost < best[own]]
            best[better], way[better], rice[better] = cost[cost < best[own]], i, k
            if not len(better) and k > 5:
                break
    constant = (x == x[:, :1]).all(1)
    way[constant] = -2
    best[constant] = bps
    head = [b"\xff\xf8" + bytes([{576: 0x20, 1152: 0x30, 2304: 0x40, 4608: 0x50, 256: 0x80, 512: 0x90, 1024: 0xA0, 2048: 0xB0, 4096: 0xC0}[block], {8: 2, 12: 4, 16: 8, 20: 10, 24: 12}[bps]]) + utf8_number(n) for n in numbers.tolist()]
    head_len = np.fromiter(map(len, head), np.int64, frames)
    bits_at = (head_len + 2) * 8  # after CRC-8 and the subframe's kind
    size = (bits_at + best + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(int(start[-1]) * 8, np.uint8)
    base = start[:-1] * 8 + bits_at

    def put(pos: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[pos + j] = (value >> (width - 1 - j)) & 1

    kind = np.zeros(frames, np.uint8)
    verbatim = np.flatnonzero(way == -1)
    kind[verbatim] = 1
    for i in range(block):
        put(base[verbatim] + i * bps, xt[i, verbatim], bps) if len(verbatim) else None
    flat = np.flatnonzero(way == -2)
    put(base[flat], xt[0, flat], bps)
    for i, (code, order, coefs, shifts, u) in enumerate(ways):
        for k in np.unique(rice[way == i]).tolist():
            own = np.flatnonzero((way == i) & (rice == k))
            kind[own] = code
            pos = base[own].copy()
            for j in range(order):
                put(pos, xt[j, own], bps)
                pos += bps
            if coefs is not None:
                put(pos, np.full(len(own), 11), 4)  # precision 12
                put(pos + 4, shifts[own], 5)
                for j in range(order):
                    put(pos + 9 + 12 * j, coefs[own, j], 12)
                pos += 9 + 12 * order
            put(pos, np.full(len(own), k), 10)  # 4-bit parameters, one partition
            v = u[:, own].T
            q = v >> k
            stop = pos[:, None] + 10 + np.cumsum(q + k + 1, axis=1) - 1 - k
            bits[stop] = 1
            for j in range(k):
                bits[stop + k - j] = (v >> j) & 1
    data = np.packbits(bits)
    del bits
    for at, h in zip(start.tolist(), head):
        data[at : at + len(h)] = np.frombuffer(h, np.uint8)
    data[start[:-1] + head_len] = crc(data, start[:-1], head_len, 8)
    data[start[:-1] + head_len + 1] = kind << 1
    check = crc(data, start[:-1], size - 2, 16)
    data[start[1:] - 2], data[start[1:] - 1] = check >> 8, check & 0xFF
    return data, start


def encode(payloads: list[bytes], rate: int = 8000, lpc_order: int = 0) -> list[bytes]:
    """FLAC streams of payloads, each byte an 8-bit sample; lengths must be positive multiples of 576."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    x = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).reshape(-1, BLOCK)
    first = np.concatenate([[0], np.cumsum(counts)])
    numbers = np.arange(len(x)) - np.repeat(first[:-1], counts)
    step = max(1, CHUNK // BLOCK)
    parts, starts, done = [], [], 0
    for at in range(0, len(x), step):
        data, start = encode_frames(x[at : at + step], numbers[at : at + step], 8, lpc_order)
        parts.append(data)
        starts.append(start[:-1] + done)
        done += len(data)
    data, start = np.concatenate(parts), np.concatenate([*starts, [done]])
    out = []
    for i, n in enumerate(counts.tolist()):
        own = start[first[i] : first[i + 1] + 1]
        table = np.zeros(n, SEEK)
        table["sample"], table["offset"], table["samples"] = np.arange(n) * BLOCK, own[:-1] - own[0], BLOCK
        sizes = np.diff(own)
        packed = rate << 44 | 0 << 41 | 7 << 36 | n * BLOCK
        signed = (np.frombuffer(payloads[i], np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed).digest()
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + table.nbytes.to_bytes(3, "big") + table.tobytes() + data[own[0] : own[-1]].tobytes())
    return out


# ---------------------------------------------------------------- decoding


class Stream:
    """Metadata of a stream: block size, rate, channels, bits, samples, MD5, seek table and where frames begin."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"fLaC":
            raise FlacError("no fLaC marker")
        at, last, self.seek = 4, False, None
        while not last:
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if len(body) < size:
                raise FlacError("metadata is cut short")
            if kind == 0:
                self.block, packed, self.md5 = int.from_bytes(body[2:4], "big"), int.from_bytes(body[10:18], "big"), body[18:34]
                self.rate, self.channels, self.bps, self.samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
            elif kind == 3:
                self.seek = np.frombuffer(body, SEEK)
                self.seek = self.seek[self.seek["sample"] != 0xFFFFFFFFFFFFFFFF]
            at += 4 + size
        self.start = at

    def frame_starts(self, data: bytes) -> np.ndarray:
        """Byte offsets of all frames from the seek table or, where it does not list them all, from the sync codes."""
        frames = -(-self.samples // self.block)
        if self.seek is not None and len(self.seek) == frames:
            return self.seek["offset"].astype(np.int64) + self.start
        raw = np.frombuffer(data, np.uint8)
        found = np.flatnonzero((raw[self.start : -6] == 0xFF) & (raw[self.start + 1 : -5] & 0xFE == 0xF8)) + self.start
        good = []
        sizes = head_sizes(np.concatenate([raw, np.zeros(32, np.uint8)]).astype(np.int64), found)[0]
        for p, n in zip(found.tolist(), sizes.tolist()):
            if p + n < len(raw) and crc(raw, np.array([p]), np.array([n]), 8)[0] == raw[p + n]:
                good.append((p, n))
        # a frame ends where the next begins, if its CRC-16 says so
        out, i = [], 0
        while i < len(good):
            p = good[i][0]
            for j in range(i + 1, len(good) + 1):
                end = good[j][0] if j < len(good) else len(raw)
                if crc(raw, np.array([p]), np.array([end - p]), 16)[0] == 0:
                    out.append(p)
                    i = j
                    break
            else:
                raise FlacError("no frame ends here")
        return np.array(out, np.int64)


def _utf8_extra(byte: np.ndarray) -> np.ndarray:
    return np.where(byte < 0xC0, 0, np.where(byte < 0xE0, 1, np.where(byte < 0xF0, 2, np.where(byte < 0xF8, 3, np.where(byte < 0xFC, 4, np.where(byte < 0xFE, 5, 6))))))


@cache
def leading_zeros() -> np.ndarray:
    """Of 16-bit numbers."""
    return (16 - np.frexp(np.arange(1 << 16, dtype=np.float64))[1]).astype(np.uint64)


class Bits:
    """A place in the bits for each frame; reads move it on. All in unsigned 64-bit numbers."""

    def __init__(self, data: np.ndarray, pos: np.ndarray) -> None:
        d = np.concatenate([data, np.zeros(8, np.uint8)])
        self.word = np.ndarray((len(d) - 7,), ">u8", d, strides=(1,))  # the 64 bits from each byte on
        self.pos = pos.astype(np.uint64)

    def window(self, at: np.ndarray) -> np.ndarray:
        """57 bits or more from at on, at the upper end."""
        return self.word[at >> np.uint64(3)].astype(np.uint64) << (at & np.uint64(7))

    def take(self, width: int | np.ndarray, own: np.ndarray | slice = slice(None), signed: bool = False) -> np.ndarray:
        at = self.pos[own]
        width = np.broadcast_to(np.asarray(width, np.int64), at.shape)
        value = (self.window(at) >> np.uint64(1) >> (63 - width).astype(np.uint64)).astype(np.int64)
        self.pos[own] = at + width.astype(np.uint64)
        return value - ((value >> np.maximum(width - 1, 0) & (width > 0)) << width) if signed else value

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rice codes at ``at`` with parameters k (unsigned): values and where they end."""
        v = self.window(at)
        zeros = leading_zeros()[v >> np.uint64(48)]
        long = np.flatnonzero(zeros == 16)
        if len(long):
            zeros, v = zeros.copy(), v.copy()
            for i in long.tolist():
                place = int(at[i])
                while not (w := int(self.window(np.array([place], np.uint64))[0]) >> 8):
                    place += 56
                    if place >> 3 >= len(self.word):
                        raise FlacError("the residual runs past the end")
                place += 56 - w.bit_length()
                zeros[i] = place - int(at[i])
            end = at + zeros + np.uint64(1)
            v = self.window(end)
        else:
            end = at + zeros + np.uint64(1)
            v = v << (zeros + np.uint64(1))
            if len(k) and int(k.max()) > 40:
                raise FlacError("a Rice parameter is out of range")
        return zeros << k | v >> np.uint64(1) >> (np.uint64(63) - k), end + k


def _residual(bits: Bits, own: np.ndarray, block: int, order: np.ndarray) -> np.ndarray:
    """Rice-coded residuals (block, frames), each frame's from sample ``order`` on."""
    wide = bits.take(2, own) == 1
    parts = bits.take(4, own)
    out = np.zeros((block, len(own)), np.uint64)
    raws: list[tuple[int, np.ndarray, np.ndarray]] = []
    length = block >> parts
    if (length < order).any():
        raise FlacError("a partition is shorter than the warm-up")
    k = np.zeros(len(own), np.uint64)
    raw = np.zeros(len(own), bool)
    raw_width = np.zeros(len(own), np.int64)
    one_part, late = bool((parts == 0).all()), int(order.max(initial=0))
    pos = bits.pos[own]
    for n in range(block):
        if n <= late or not one_part:
            new = np.flatnonzero((n == order) | (n > order) & (n % length == 0))
            if len(new):
                bits.pos[own[new]] = pos[new]
                value = bits.take(np.where(wide[new], 5, 4), own[new])
                k[new] = value
                raw[new] = value == np.where(wide[new], 31, 15)
                if raw[new].any():
                    raw_width[new[raw[new]]] = bits.take(5, own[new[raw[new]]])
                pos[new] = bits.pos[own[new]]
        if n < late or raw.any():
            rice, plain = np.flatnonzero(~raw & (n >= order)), np.flatnonzero(raw & (n >= order))
            out[n, rice], pos[rice] = bits.rice(pos[rice], k[rice])
            if len(plain):
                bits.pos[own[plain]] = pos[plain]
                raws.append((n, plain, bits.take(raw_width[plain], own[plain], signed=True)))
                pos[plain] = bits.pos[own[plain]]
        else:
            out[n], pos = bits.rice(pos, k)
    bits.pos[own] = pos
    signed = (out >> np.uint64(1)).view(np.int64) ^ -(out & np.uint64(1)).view(np.int64)
    for n, plain, value in raws:
        signed[n, plain] = value
    return signed


def head_sizes(d: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of frame headers up to their CRC-8, and where an explicit block size stands. d has some bytes to spare at its end."""
    code, rate = d[starts + 2] >> 4, d[starts + 2] & 15
    at = starts + 5 + _utf8_extra(d[starts + 4])
    end = at + np.where(code == 6, 1, np.where(code == 7, 2, 0)) + np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0))
    return end - starts, at


class _Heads:
    """What frame headers say, a value for each frame: block size, coding of channels, header bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray) -> None:
        d = np.concatenate([data, np.zeros(32, np.uint8)]).astype(np.int64)
        if (d[starts] != 0xFF).any() or (d[starts + 1] & 0xFC != 0xF8).any():
            raise FlacError("no frame at its offset")
        code, rate = d[starts + 2] >> 4, d[starts + 2] & 15
        self.coding = d[starts + 3] >> 4
        self.size, at = head_sizes(d, starts)
        explicit = np.where(code == 6, d[at] + 1, (d[at] << 8 | d[at + 1]) + 1)
        self.block = np.where(code == 1, 192, np.where(code < 6, 144 << np.minimum(code, 5), np.where(code < 8, explicit, 1 << code)))
        if (code == 0).any() or (rate == 15).any() or (self.coding > 10).any():
            raise FlacError("a frame header has a reserved value")
        if (crc(data, starts, self.size, 8) != d[starts + self.size]).any():
            raise FlacError("a frame header's checksum is wrong")


#: Codings of two channels as left and side, side and right, mid and side: which channel is the side, of one bit more.
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10
SIDE = {LEFT_SIDE: 1, SIDE_RIGHT: 0, MID_SIDE: 1}


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int, coding: int = 0, bps: int = 8, head: np.ndarray | None = None) -> np.ndarray:
    """Samples (frames, channels, block) of frames of one block size and channel coding; checks CRC-16."""
    if crc(data, starts, ends - starts, 16).any():
        raise FlacError("a frame's checksum is wrong")
    head = _Heads(data, starts).size if head is None else head
    channels = coding + 1 if coding < LEFT_SIDE else 2
    bits = Bits(data, (starts + head + 1) * 8)
    out = np.empty((channels, block, len(starts)), np.int64)
    for channel in range(channels):
        kind = bits.take(8)
        depth = np.full(len(starts), bps + (SIDE.get(coding) == channel))
        wasted = np.zeros(len(starts), np.int64)
        left = np.flatnonzero(kind & 1)
        while len(left):  # a unary count of bits that are 0 in all samples
            wasted[left] += 1
            left = left[bits.take(1, left) == 0]
            if (wasted > 31).any():
                raise FlacError("a subframe wastes all its bits")
        depth = depth - wasted
        if (kind & 0x80).any() or (depth < 1).any():
            raise FlacError("a subframe is of a reserved kind")
        kind >>= 1
        if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any():
            raise FlacError("a subframe is of a reserved kind")
        own = np.flatnonzero(kind == 0)
        out[channel][:, own] = bits.take(depth[own], own, signed=True)
        if len(own := np.flatnonzero(kind == 1)):
            out[channel][:, own] = np.stack([bits.take(depth[own], own, signed=True) for _ in range(block)])
        if len(own := np.flatnonzero(kind >= 8)):
            out[channel][:, own] = _predicted(bits, own, block, depth[own], kind[own])
        out[channel] <<= wasted
    if ((bits.pos.astype(np.int64) + 7) // 8 + 2 != ends).any():
        raise FlacError("a frame does not end where the next begins")
    if coding == LEFT_SIDE:
        out[1] = out[0] - out[1]
    elif coding == SIDE_RIGHT:
        out[0] = out[0] + out[1]
    elif coding == MID_SIDE:
        both = out[0] * 2 + (out[1] & 1)
        out[0], out[1] = (both + out[1]) >> 1, (both - out[1]) >> 1
    return out.transpose(2, 0, 1)


def _predicted(bits: Bits, own: np.ndarray, block: int, bps: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Samples of fixed (8 to 12) and LPC (from 32) subframes: residuals of all together, then each predictor's sums."""
    order = np.where(kind < 32, kind - 8, kind - 31)
    warm = np.zeros((int(order.max()), len(own)), np.int64)
    for i in range(len(warm)):
        more = np.flatnonzero(order > i)
        warm[i, more] = bits.take(bps[more], own[more], signed=True)
    lpc = np.flatnonzero(kind >= 32)
    coefs, shift = np.zeros((32, len(own)), np.int64), np.zeros(len(own), np.int64)
    if len(lpc):
        precision = bits.take(4, own[lpc]) + 1
        shift[lpc] = bits.take(5, own[lpc])
        for i in range(int(order[lpc].max())):
            more = np.flatnonzero(order[lpc] > i)
            coefs[i, lpc[more]] = bits.take(precision[more], own[lpc[more]], signed=True)
    x = _residual(bits, own, block, order)
    for code in np.unique(kind).tolist():
        group = np.flatnonzero(kind == code)
        n = int(order[group[0]])
        y = x[:, group]
        y[:n] = warm[:n, group]
        if code < 32:  # the residual is the n-th difference
            for _ in range(n):
                y[:n] = np.diff(y[:n], axis=0, prepend=0)
            for _ in range(n):
                y = np.cumsum(y, axis=0)
        else:
            c, s = coefs[:n, group], shift[group]
            for i in range(n, block):
                y[i] += (c * y[i - n : i][::-1]).sum(0) >> s
        x[:, group] = y
    return x


def decode(streams: list[bytes], verify_md5: bool = True) -> list[np.ndarray]:
    """Samples (samples, channels) of each stream; frames of all streams that are of one kind are decoded together."""
    infos = [Stream(s) for s in streams]
    out: list[np.ndarray] = []
    group, size = [], 0
    for info, data in zip(infos, streams):
        group.append((info, data))
        size += info.samples * info.channels
        if size >= CHUNK:
            out += _decode_group(group, verify_md5)
            group, size = [], 0
    return out + (_decode_group(group, verify_md5) if group else [])


def pcm_bytes(x: np.ndarray, bps: int) -> bytes:
    """Samples as the MD5 of a stream takes them: interleaved, signed, little-endian, in whole bytes."""
    width = (bps + 7) // 8
    return np.ascontiguousarray(x).astype("<i4").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()


def _decode_group(group: list[tuple[Stream, bytes]], verify_md5: bool) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(d for _, d in group), np.uint8)
    starts, ends, owner, done = [], [], [], 0
    for i, (info, d) in enumerate(group):
        own = info.frame_starts(d)
        starts.append(own + done)
        done += len(d)
        ends.append(np.append(own[1:] + done - len(d), done) if len(own) else own)
        owner.append(np.full(len(own), i))
    starts, ends, owner = map(np.concatenate, (starts, ends, owner))
    heads = _Heads(data, starts)
    bps = np.array([info.bps for info, _ in group])[owner]
    kinds, which = np.unique(np.stack([heads.block, heads.coding, bps]), axis=1, return_inverse=True)
    frames: list[np.ndarray | None] = [None] * len(starts)
    for k, (block, coding, depth) in enumerate(kinds.T.tolist()):
        every = np.flatnonzero(which.reshape(-1) == k)
        step = max(1, CHUNK // (block * (coding + 1 if coding < LEFT_SIDE else 2)))
        for at in range(0, len(every), step):
            own = every[at : at + step]
            for i, x in zip(own.tolist(), decode_frames(data, starts[own], ends[own], block, coding, depth, heads.size[own])):
                frames[i] = x
    out, first = [], np.searchsorted(owner, np.arange(len(group) + 1))
    for i, (info, _) in enumerate(group):
        own = frames[first[i] : first[i + 1]]
        x = np.concatenate(own, axis=1).T if own else np.empty((0, info.channels), np.int64)
        if info.samples and len(x) != info.samples or x.shape[1] != info.channels:
            raise FlacError("the stream's frames are not all of its samples")
        if verify_md5 and any(info.md5) and hashlib.md5(pcm_bytes(x, info.bps)).digest() != info.md5:
            raise FlacError("the stream's MD5 is wrong")
        out.append(x)
    return out


def payloads(streams: list[bytes]) -> list[bytes]:
    """The bytes that ``encode`` took: 8-bit mono samples, 128 for silence. Streams of other kinds give their PCM."""
    out = []
    for s, x in zip(streams, decode(streams)):
        info = Stream(s)
        out.append((x + 128).astype(np.uint8).tobytes() if (info.channels, info.bps) == (1, 8) else pcm_bytes(x, info.bps))
    return out


def read_samples(stream: bytes, start: int, count: int) -> np.ndarray:
    """``count`` samples from offset ``start`` on, (count, channels): only the frames that hold them are decoded."""
    info = Stream(stream)
    data = np.frombuffer(stream, np.uint8)
    frames = np.append(info.frame_starts(stream), len(stream))
    a, b = start // info.block, min(-(-(start + count) // info.block), len(frames) - 1)
    if a >= b:
        return np.empty((0, info.channels), np.int64)
    heads = _Heads(data, frames[a:b])
    parts = [decode_frames(data, frames[i : i + 1], frames[i + 1 : i + 2], int(heads.block[i - a]), int(heads.coding[i - a]), info.bps)[0] for i in range(a, b)]
    return np.concatenate(parts, axis=1).T[start - a * info.block :][:count]


# ---------------------------------------------------------------- columns


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def features(payload: bytes, bps: int = 8, channels: int = 1) -> str:
    """Loudness, mean level, zero crossings and span of the samples of a decoded stream, of its first channel."""
    if bps == 8 and channels == 1:
        x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    else:
        width = (bps + 7) // 8
        raw = np.frombuffer(payload, np.uint8).reshape(-1, channels, width)[:, 0].astype(np.int64)
        x = (raw << 8 * np.arange(width)).sum(1)
        x -= (x >> 8 * width - 1) << 8 * width
    if not len(x):
        return ""
    rms = float(np.sqrt(np.mean(x.astype(np.float64) ** 2)))
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    return f"rms={rms:.4f};mean={x.mean():.4f};zcr={crossings / len(x):.6f};min={x.min()};max={x.max()}"


#: Order of the linear predictors that ``encode_column`` tries beside the fixed ones.
LPC_ORDER = 4


def encode_column(df: DataFrame, text: str = "text", media: str = "media", lpc_order: int = LPC_ORDER) -> DataFrame:
    """df with each text's FLAC stream in ``media`` and its UTF-8 length in ``n_bytes``, without the text."""
    kept = [c for c in df.columns if c not in (text, media, "n_bytes")]
    schema = df.select(*kept, F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias(media)).schema

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(text).to_pylist()
            streams = encode([payload_of(t) for t in texts], lpc_order=lpc_order) if texts else []
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sizes, pa.int64()), pa.array(streams, pa.binary())], names=[*kept, "n_bytes", media])

        return each

    return map_arrow(df, make, schema, rows=600)


def decode_column(df: DataFrame, media: str = "media", pcm: str = "pcm") -> DataFrame:
    """df with the decoded and verified samples of ``media`` in ``pcm`` and their features in ``feature``."""
    kept = [c for c in df.columns if c not in (pcm, "feature")]
    schema = df.select(*kept, F.lit(b"").alias(pcm), F.lit("").alias("feature")).schema

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            streams = batch.column(media).to_pylist()
            found = iter(payloads([s for s in streams if s is not None]))
            infos = [None if s is None else Stream(s) for s in streams]
            pcms = [None if s is None else next(found) for s in streams]
            told = [None if i is None else features(p, i.bps, i.channels) for i, p in zip(infos, pcms)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(pcms, pa.binary()), pa.array(told, pa.string())], names=[*kept, pcm, "feature"])

        return each

    return map_arrow(df, make, schema, rows=600)


#: Parts that ``store_and_read`` works through one after the other.
PARTS = 2


def store_and_read(df: DataFrame, *columns: Column | str, text: str = "text", parts: int = PARTS) -> DataFrame:
    """``columns`` of df with ``n_bytes``, ``media``, ``pcm`` and ``feature``, from streams that are written and then read back.

    Each text's stream is written once, to a table ``media-…`` in the shared folder. Streams of text are larger than the
    texts' own compressed table, so they are stored in parts, by a hash of the text: a part is written, read back, and
    deleted when what was asked of it is staged. All parts together are all rows. Who wants to keep the streams writes
    ``encode_column``'s result where they shall stay.
    """
    found = None
    for part in range(parts):
        own = df.where(F.pmod(F.xxhash64(text), F.lit(parts)) == part)
        media = stage(encode_column(own, text), "media")
        read = stage(decode_column(media).select(*columns), "media-features")
        discard(media)
        found = read if found is None else found.unionByName(read)
    return found
