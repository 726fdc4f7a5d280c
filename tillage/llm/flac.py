"""FLAC in numpy: a decoder for many frames at once, PCM blocks with sample offsets, and a small encoder.

Frames don't depend on each other, so all frames of a batch are decoded side by side:
step t takes the t-th Rice residual of every frame, wherever its bits are, and
undoes every frame's linear predictor at sample t. Header (CRC-8) and whole frame
(CRC-16) checksums are verified first, and the MD5 of all samples at a stream's end. Long streams are taken in slabs of frames.

The decoder reads mono streams of 4 to 24 bits with constant, verbatim, fixed and LPC
subframes, wasted bits, both Rice codings, any partition order and escaped
partitions. The encoder writes 8-bit mono with one partition a frame and, for each
frame, whichever of six predictors leaves the least.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import written

BLOCK = 2048
RATE = 8000
#: Bytes of payload that are coded side by side at most, and those of one payload; a longer one is coded in slabs of frames.
BATCH_BYTES = 2 << 20
SLAB = 1 << 20
#: Frames that are decoded side by side at most.
BATCH_FRAMES = 1024
#: Samples of a PCM block.
PCM_SAMPLES = 1 << 16

# Coefficients of the format's fixed predictors of orders 0 to 4.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
#: The encoder's own predictor: the mean of the last eight samples, drawn to the middle by 0.625.
DRAWN_MEAN = ([10] * 8, 7)
PRECISION = 5


def _crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
_CRC8 = CRC8.tolist()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each slice of buf, all slices a byte at a time."""
    order = np.argsort(starts - ends, kind="stable")
    at, left = starts[order].copy(), (ends - starts)[order]
    crc = np.zeros(len(at), np.uint32)
    live = len(at)
    for t in range(int(left[0]) if live else 0):
        while live and left[live - 1] <= t:
            live -= 1
        c = crc[:live]
        crc[:live] = ((c << np.uint32(8)) & np.uint32(0xFFFF)) ^ CRC16[(c >> np.uint32(8)) ^ buf[at[:live] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8_number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >= 1 << (6 * more + 6 - more):
        more += 1
    first = (0xFF << (7 - more)) & 0xFF | n >> (6 * more)
    return bytes([first, *[0x80 | n >> (6 * k) & 0x3F for k in range(more - 1, -1, -1)]])


def _slabs(lengths: list[int], most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Batches of (item, start, end) that cover items of the given lengths in order, most in all and SLAB each at most;
    an empty item has one empty slab."""
    batch, held = [], 0
    for i, n in enumerate(lengths):
        for a in range(0, max(n, 1), SLAB):
            z = min(n, a + SLAB)
            if batch and held + z - a > most:
                yield batch
                batch, held = [], 0
            batch.append((i, a, z))
            held += z - a
    if batch:
        yield batch


def encode_payloads(payloads: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(FLAC stream, its frames' lengths in bytes) for each payload, whose bytes b are the 8-bit samples b - 128."""
    frames: list[list[bytes]] = [[] for _ in payloads]
    sizes: list[list[np.ndarray]] = [[] for _ in payloads]
    sums = [hashlib.md5() for _ in payloads]
    for batch in _slabs([len(p) for p in payloads], BATCH_BYTES):
        parts = [payloads[i][a:z] for i, a, z in batch]
        for (i, _, _), part, (data, n) in zip(batch, parts, _encode_frames(parts, [a // BLOCK for _, a, _ in batch])):
            frames[i].append(data)
            sizes[i].append(n)
            sums[i].update((np.frombuffer(part, np.uint8) ^ 0x80).tobytes())
    out = []
    for p, data, parts, md5 in zip(payloads, frames, sizes, sums):
        n = np.concatenate(parts)
        info = BLOCK.to_bytes(2, "big") * 2 + int(n.min()).to_bytes(3, "big") + int(n.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + md5.digest()
        out.append((b"".join([b"fLaC", bytes([0x80]), len(info).to_bytes(3, "big"), info, *data]), n.astype(np.int32)))
    return out


def _encode_frames(payloads: list[bytes], first_frames: list[int]) -> list[tuple[bytes, np.ndarray]]:
    """(frames, their lengths in bytes) of each payload, whose frames are numbered from its first frame on."""
    lengths = np.array([len(p) for p in payloads])
    per = np.maximum(1, -(-lengths // BLOCK))
    owner = np.repeat(np.arange(len(payloads)), per)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    number = place + np.repeat(first_frames, per)
    size = np.minimum(BLOCK, lengths[owner] - place * BLOCK)
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    begin = (np.cumsum(lengths) - lengths)[owner] + place * BLOCK
    inside = np.arange(BLOCK) < size[:, None]
    x = np.where(inside, flat[np.minimum(begin[:, None] + np.arange(BLOCK), max(len(flat) - 1, 0))].astype(np.int32) - 128, 0)
    tries = [(c, 0, k) for k, c in enumerate(FIXED)] + [(*DRAWN_MEAN, 32 + 7)]
    lowest, best, r = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64), np.zeros_like(x)
    for which, (coefs, shift, _) in enumerate(tries):
        guess = np.zeros_like(x)
        for j, c in enumerate(coefs, 1):
            guess[:, j:] += c * x[:, :-j]
        left = x - (guess >> shift)
        left[:, : len(coefs)] = 0
        left[~inside] = 0
        cost = np.where(size <= len(coefs), np.iinfo(np.int64).max, np.abs(left).sum(1, dtype=np.int64) + 5 * len(coefs))
        better = cost < lowest
        r[better], best[better], lowest[better] = left[better], which, cost[better]
    constant = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(1)
    order = np.array([len(t[0]) for t in tries])[best]
    folded = np.where(r >= 0, 2 * r, -2 * r - 1).astype(np.int64)
    counted = inside & (np.arange(BLOCK) >= order[:, None])
    n = np.maximum(counted.sum(1), 1)
    mean = (folded * counted).sum(1) / n
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1))).astype(np.int64), 0, 14)
    bits_for = lambda k: ((folded >> k[:, None]) * counted).sum(1) + n * (k + 1)
    k = np.where(bits_for(np.minimum(k + 1, 14)) < bits_for(k), np.minimum(k + 1, 14), k)
    # headers of all frames, as bits before the residuals
    heads, warm_bits = [], []
    for i in range(len(x)):
        full = size[i] == BLOCK
        h = bytes([0xFF, 0xF8, (0xB0 if full else 0x70), 0x02]) + _utf8_number(int(number[i])) + (b"" if full else int(size[i] - 1).to_bytes(2, "big"))
        h += bytes([crc8(h)])
        coefs, shift, kind = tries[best[i]]
        if constant[i]:
            h += bytes([0, x[i, 0] & 0xFF])
            heads.append(h)
            warm_bits.append("")
            continue
        kind = kind if kind >= 32 else 8 + len(coefs)
        h += bytes([kind << 1]) + (x[i, : len(coefs)] & 0xFF).astype(np.uint8).tobytes()
        tail = ""
        if kind >= 32:
            tail += format(PRECISION - 1, "04b") + format(shift, "05b") + "".join(format(c & 31, "05b") for c in coefs)
        heads.append(h)
        warm_bits.append(tail + "00" + "0000" + format(int(k[i]), "04b"))
    width = np.where(counted & ~constant[:, None], (folded >> k[:, None]) + 1 + k[:, None], 0)
    lead = np.array([8 * len(h) + len(w) for h, w in zip(heads, warm_bits)])
    body = width.sum(1)
    frame_bytes = -(-(lead + body) // 8) + 2
    where = np.cumsum(frame_bytes) - frame_bytes
    bits = np.zeros(int(frame_bytes.sum()) * 8, np.uint8)
    stop = where[:, None] * 8 + lead[:, None] + np.cumsum(width, axis=1)
    real = width > 0
    kk = np.broadcast_to(k[:, None], width.shape)[real]
    one = stop[real] - kk - 1
    bits[one] = 1
    low = folded[real]
    for j in range(int(kk.max(initial=0))):
        has = kk > j
        bits[(stop[real][has] - 1 - j)] = (low[has] >> j) & 1
    out = np.packbits(bits)
    for i, (h, w) in enumerate(zip(heads, warm_bits)):
        out[where[i] : where[i] + len(h)] = np.frombuffer(h, np.uint8)
        if w:
            at = where[i] + len(h)
            whole = int(w, 2) << (-len(w) % 8)
            raw = np.frombuffer(whole.to_bytes(-(-len(w) // 8), "big"), np.uint8)
            out[at : at + len(raw)] |= raw
    crc = crc16_of(out, where, where + frame_bytes - 2)
    out[where + frame_bytes - 2] = crc >> 8
    out[where + frame_bytes - 1] = crc & 0xFF
    ends, first = where + frame_bytes, np.cumsum(per) - per
    return [(out[where[a] : ends[a + n - 1]].tobytes(), frame_bytes[a : a + n]) for a, n in zip(first, per)]


class FlacError(ValueError):
    """A stream that is damaged or not of the kind that this decoder reads."""


class _Bits:
    """Reads a byte string bit by bit; for headers only."""

    def __init__(self, data, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise FlacError("a stream ends too early")
        v = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n)
        self.at += n
        return v & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if v >> (n - 1) else v


def _stream_info(data: bytes) -> tuple[int, dict]:
    if data[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, info, last = 4, {}, False
    while not last:
        kind, n = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        last = bool(data[at] & 0x80)
        if kind == 0:
            x = int.from_bytes(data[at + 14 : at + 22], "big")
            info = {"block": int.from_bytes(data[at + 6 : at + 8], "big"), "channels": (x >> 41 & 7) + 1, "bits": (x >> 36 & 31) + 1, "samples": x & ((1 << 36) - 1), "md5": data[at + 22 : at + 38]}
        at += 4 + n
    if not info or info["channels"] != 1:
        raise FlacError("only mono streams are read")
    return at, info


# Block sizes and sample sizes by their codes in a frame's header.
BLOCK_SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _frame_header(data: bytes, at: int, info: dict) -> tuple[int, int, int]:
    """(place after the header, samples in the frame, bits of a sample) of the frame at `at`."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise FlacError(f"no frame at byte {at}")
    size_code, rate_code, bits_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 1 & 7
    p = at + 4
    lead = data[p]
    p += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if size_code == 6:
        size, p = data[p] + 1, p + 1
    elif size_code == 7:
        size, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    else:
        size = BLOCK_SIZES.get(size_code)
    p += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if size is None or crc8(data[at:p]) != data[p]:
        raise FlacError(f"the header at byte {at} is damaged")
    return p + 1, size, SAMPLE_BITS.get(bits_code, info["bits"])


def _frame_starts(data: bytes, at: int, info: dict) -> list[tuple[int, int, int, int]]:
    """(start, after header, samples, bits) of each frame. A frame ends where the next one whose
    header's checksum holds begins and the CRC-16 up to there is right; that is verified for all at once later."""
    found, done = [], 0
    while done < info["samples"]:
        p, n, bits = _frame_header(data, at, info)
        found.append((at, p, n, bits))
        done += n
        if done >= info["samples"]:
            break
        seek = p + 2
        while True:
            seek = data.find(b"\xff\xf8", seek)
            if seek < 0:
                raise FlacError("a stream ends too early")
            try:
                _frame_header(data, seek, info)
            except (FlacError, IndexError):
                seek += 1
                continue
            if _crc16_scalar(data, at, seek) == 0:
                break
            seek += 1
        at = seek
    return found


_CRC16 = CRC16.tolist()


def _crc16_scalar(data: bytes, a: int, b: int) -> int:
    """CRC-16 of data[a:b]; 0 if the last two bytes are the checksum of those before."""
    c = int(crc16_of(np.frombuffer(data, np.uint8), np.array([a]), np.array([b]))[0]) if b - a > 4096 else 0
    if b - a <= 4096:
        for x in data[a:b]:
            c = ((c << 8) & 0xFFFF) ^ _CRC16[(c >> 8) ^ x]
    return c


Frame = tuple[int, int, int, int, int]


def _frames_of(data: bytes, table: np.ndarray | None) -> tuple[list[Frame], dict]:
    """(frames as (start, after header, samples, bits, end), stream info). table holds the frames' lengths in bytes, a
    seek table, which saves the search for their starts."""
    at, info = _stream_info(data)
    if table is None:
        found = _frame_starts(data, at, info)
        return [(*f, g[0]) for f, g in zip(found, [*found[1:], (len(data),)])], info
    frames = []
    for n in table.tolist():
        frames.append((at, *_frame_header(data, at, info), at + n))
        at += n
    if at != len(data):
        raise FlacError("frame lengths don't fit the stream")
    return frames, info


def decoded_slabs(streams: list[bytes], tables: list[np.ndarray] | None = None, most: int | None = None) -> Iterator[tuple[int, np.ndarray, dict, bool]]:
    """(stream, samples, stream info, whether these are its last) in order, checksums verified: CRC-8 and CRC-16 of the frames, and at
    a stream's end its length and the MD5 of its samples. No more than `most` frames are decoded at a time, of one stream or of several."""
    most = most or BATCH_FRAMES
    located = [_frames_of(data, None if tables is None else tables[s]) for s, data in enumerate(streams)]
    done, sums = [0] * len(streams), [hashlib.md5() for _ in streams]
    batch: list[tuple[int, int, int]] = []

    def decode() -> Iterator[tuple[int, np.ndarray, dict, bool]]:
        parts = []
        for s, a, z in batch:
            frames = located[s][0][a:z]
            lo = frames[0][0] if frames else 0
            parts.append((streams[s][lo : frames[-1][4]] if frames else b"", [(f[0] - lo, f[1] - lo, f[2], f[3], f[4] - lo) for f in frames]))
        for (s, a, z), x in zip(batch, _decode_frames(parts)):
            frames, info = located[s]
            done[s] += len(x)
            sums[s].update(_as_bytes(x, info["bits"]))
            last = z == len(frames)
            if last and done[s] != info["samples"]:
                raise FlacError("a stream's samples are not complete")
            if last and any(info["md5"]) and sums[s].digest() != info["md5"]:
                raise FlacError("a stream's samples don't have its MD5")
            yield s, x, info, last

    held = 0
    for s, (frames, _) in enumerate(located):
        for a in range(0, max(len(frames), 1), most):
            z = min(len(frames), a + most)
            if batch and held + z - a > most:
                yield from decode()
                batch, held = [], 0
            batch.append((s, a, z))
            held += z - a
    if batch:
        yield from decode()


def _as_bytes(x: np.ndarray, bits: int) -> bytes:
    """Samples as the format's MD5 sees them: signed, little-endian, in whole bytes."""
    if bits <= 8:
        return x.astype(np.int8).tobytes()
    if bits <= 16:
        return x.astype("<i2").tobytes()
    wide = x.astype("<i4").view(np.uint8).reshape(-1, 4)
    return wide[:, : (bits + 7) // 8].tobytes()


def decode_streams(streams: list[bytes], frame_sizes: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """The samples (int32) of each stream, checksums verified; see decoded_slabs."""
    out: list[list[np.ndarray]] = [[] for _ in streams]
    for s, x, _, _ in decoded_slabs(streams, frame_sizes):
        out[s].append(x)
    return [np.concatenate(x) for x in out]


def _decode_frames(runs: list[tuple[bytes, list[Frame]]]) -> list[np.ndarray]:
    """The samples of each run's frames, one after another; the frames of all runs are decoded side by side."""
    buf = np.frombuffer(b"".join([d for d, _ in runs]) + b"\0" * 16, np.uint8)
    raw = buf.tobytes()
    starts, bodies, sizes, depth, owner, ends = [], [], [], [], [], []
    base = 0
    for s, (data, frames) in enumerate(runs):
        for a, p, n, bits, z in frames:
            starts.append(base + a)
            bodies.append(base + p)
            sizes.append(n)
            depth.append(bits)
            owner.append(s)
            ends.append(base + z)
        base += len(data)
    starts, ends, sizes, owner = (np.array(v, np.int64) for v in (starts, ends, sizes, owner))
    if len(starts) and crc16_of(buf, starts, ends).any():
        raise FlacError("a frame's checksum is wrong")
    n, longest = len(starts), int(sizes.max(initial=0))
    order, coefs, shift, wasted = np.zeros(n, np.int64), np.zeros((n, 32), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    samples = np.zeros((longest, n), np.int64)
    rice: list[tuple[int, int, int, int]] = []  # (frame, bit place, method, partition order)
    for i in range(n):
        b = _Bits(raw, bodies[i])
        bits, size = depth[i], int(sizes[i])
        b.take(1)
        kind = b.take(6)
        if b.take(1):
            wasted[i] = 1
            while not b.take(1):
                wasted[i] += 1
            bits -= int(wasted[i])
        if kind == 0:
            samples[:size, i] = b.signed(bits)
            continue
        if kind == 1:
            samples[:size, i] = [b.signed(bits) for _ in range(size)]
            continue
        if 8 <= kind <= 12:
            order[i] = kind - 8
        elif kind >= 32:
            order[i] = kind - 31
        else:
            raise FlacError("a subframe of a reserved kind")
        o = int(order[i])
        for t in range(o):
            samples[t, i] = b.signed(bits)
        if kind >= 32:
            precision = b.take(4) + 1
            shift[i] = b.signed(5)
            coefs[i, :o] = [b.signed(precision) for _ in range(o)]
        else:
            coefs[i, :o] = FIXED[o]
        method, parts = b.take(2), b.take(4)
        rice.append((i, b.at, method, parts))
    if rice:
        _residuals(buf, raw, rice, samples, sizes, order)
        _predict(samples, np.array([r[0] for r in rice]), order, coefs, shift, sizes)
    samples <<= wasted
    first, out = np.searchsorted(owner, np.arange(len(runs) + 1)), []
    for s in range(len(runs)):
        pieces = [samples[: sizes[i], i] for i in range(first[s], first[s + 1])]
        out.append(np.concatenate(pieces).astype(np.int32) if pieces else np.zeros(0, np.int32))
    return out


def _residuals(buf: np.ndarray, raw: bytes, rice: list, samples: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> None:
    """Put the Rice residuals of all frames in rice into samples, a sample of every frame at a step."""
    words = np.ndarray((len(buf) - 7,), "<u8", buffer=raw, strides=(1,))
    frame = np.array([r[0] for r in rice])
    at = np.array([r[1] for r in rice])
    method = np.array([r[2] for r in rice])
    parts = np.array([r[3] for r in rice])
    if (method > 1).any():
        raise FlacError("a residual coding that is reserved")
    part_size = sizes[frame] >> parts
    k_bits = np.where(method == 0, 4, 5)
    width = np.zeros(len(rice), np.int64)  # of escaped samples, 0 where Rice codes stand
    k = np.zeros(len(rice), np.int64)
    by = np.argsort(-sizes[frame], kind="stable")
    frame, at, part_size, k_bits, width, k = frame[by], at[by], part_size[by], k_bits[by], width[by], k[by]
    size, start = sizes[frame], order[frame]
    u = np.uint64

    def window(p: np.ndarray) -> np.ndarray:
        return words[p >> 3].byteswap() << (p & 7).astype(u)

    for t in range(int(size[0])):
        live = int(np.searchsorted(-size, -t, "left"))
        if not live:
            break
        lead = (t == start[:live]) | (t > start[:live]) & (t % part_size[:live] == 0)
        if lead.any():
            which = np.flatnonzero(lead)
            bits = k_bits[which]
            w = window(at[which])
            v = (w >> (64 - bits).astype(u)).astype(np.int64)
            at[which] += bits
            escaped = v == (1 << bits) - 1
            raw_width = (window(at[which]) >> u(59)).astype(np.int64)
            at[which] += np.where(escaped, 5, 0)
            width[which] = np.where(escaped, np.where(raw_width == 0, -1, raw_width), 0)
            k[which] = np.where(escaped, 0, v)
        on = t >= start[:live]
        coded = on & (width[:live] == 0)
        i = slice(0, live) if coded.all() else np.flatnonzero(coded)
        p, kk = at[i], k[i]
        w = window(p)
        high = (w >> u(32)).astype(np.float64)
        q = np.where(high > 0, 31 - ((high.view(np.int64) >> 52) - 1023), 32)
        zeros = q.copy()
        while (more := q == 32).any():
            j = np.flatnonzero(more)
            w = w.copy()
            p = p.copy()
            p[j] += 32
            if int(p[j].max(initial=0)) >> 3 >= len(words):
                raise FlacError("a stream ends too early")
            w[j] = window(p[j])
            h = (w[j] >> u(32)).astype(np.float64)
            q[j] = np.where(h > 0, 31 - ((h.view(np.int64) >> 52) - 1023), 32)
            zeros[j] += q[j]
        w = window(p + q + 1) if int(kk.max(initial=0)) > 24 else w << (q + 1).astype(u)
        low = np.where(kk > 0, (w >> u(1)) >> (63 - kk).astype(u), u(0)).astype(np.int64)
        at[i] = p + q + 1 + kk
        value = (zeros << kk) | low
        samples[t, frame[i]] = (value >> 1) ^ -(value & 1)
        if not coded.all() and (plain := np.flatnonzero(on & (width[:live] > 0))).size:
            w = window(at[plain])
            samples[t, frame[plain]] = w.astype(np.int64) >> (64 - width[plain])
            at[plain] += width[plain]


def _predict(samples: np.ndarray, frame: np.ndarray, order: np.ndarray, coefs: np.ndarray, shift: np.ndarray, sizes: np.ndarray) -> None:
    """Undo the linear predictors of the given frames, one sample of every frame at a step."""
    for o in np.unique(order[frame]).tolist():
        if not o:
            continue
        f = frame[order[frame] == o]
        x, c, s = samples[:, f], coefs[f, :o].T.copy(), shift[f]
        for t in range(o, int(sizes[f].max())):
            guess = c[0] * x[t - 1]
            for j in range(1, o):
                guess += c[j] * x[t - 1 - j]
            x[t] += guess >> s
        samples[:, f] = x


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, its payload: these and zero bytes up to a positive multiple of 64)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def _row_batches(lengths: list[int], most: int = BATCH_BYTES) -> Iterator[slice]:
    """Slices of rows that hold `most` bytes, or one row."""
    a = n = 0
    for i, x in enumerate(lengths):
        if i > a and n + x > most:
            yield slice(a, i)
            a, n = i, 0
        n += x
    if lengths:
        yield slice(a, len(lengths))


def encode_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, frame_sizes) for each row of docs: its payload as a FLAC stream and a seek table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            for part in _row_batches([x.as_py() or 0 for x in pc.binary_length(texts)]):
                made = [payload_of(t) for t in texts[part.start : part.stop].to_pylist()]
                streams = encode_payloads([p for _, p in made])
                cols = [
                    ids[part.start : part.stop],
                    pa.array([n for n, _ in made], pa.int64()),
                    pa.array([x for x, _ in streams], pa.binary()),
                    pa.array([x for _, x in streams], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "media", "frame_sizes"])

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary, frame_sizes array<int>")


class _Media:
    """Rows of a batch of media, decoded together: iterate for (row, PCM block, its samples, stream info, whether it is the row's last)."""

    def __init__(self, batch: pa.RecordBatch, samples: int):
        self.batch, self.samples = batch, samples

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, int, dict, bool]]:
        media, tables = self.batch.column("media"), self.batch.column("frame_sizes")
        sizes = [x.as_py() or 0 for x in pc.binary_length(media)]
        for part in _row_batches(sizes):
            rows = [i for i in range(part.start, part.stop) if media[i].is_valid]
            streams = [media[i].as_py() for i in rows]
            known = None if any(not tables[i].is_valid for i in rows) else [np.asarray(tables[i].values, np.int64) for i in rows]
            held, offset = np.zeros(0, np.int32), 0
            for s, x, info, last in decoded_slabs(streams, known):
                held = np.concatenate([held, x]) if len(held) else x
                stop = len(held) if last else len(held) - len(held) % self.samples
                for a in range(0, stop, self.samples):
                    z = min(stop, a + self.samples)
                    yield rows[s], held[a:z], offset + a, info, last and z == stop
                if last and not stop:
                    yield rows[s], held, offset, info, True
                held, offset = (np.zeros(0, np.int32), 0) if last else (held[stop:], offset + stop)


def pcm_blocks(media: DataFrame, samples: int = PCM_SAMPLES) -> DataFrame:
    """(doc_id, block, sample_offset, n_samples, pcm): the decoded streams of media (as encode_table gives
    them; frame_sizes may be null) in blocks of so many samples; block k starts at sample k x samples.

    pcm is unsigned for 8-bit streams and else little-endian signed, as in WAV
    files. A null or empty stream has no blocks; a damaged one raises FlacError.
    """
    schema = "doc_id bigint, block int, sample_offset bigint, n_samples int, pcm binary"
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    names = ["doc_id", "block", "sample_offset", "n_samples", "pcm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for i, x, offset, info, _ in _Media(b, samples):
                if len(x):
                    out.append((b.column("doc_id")[i].as_py(), offset // samples, offset, len(x), to_pcm(x, info["bits"])[0]))
                    size += len(out[-1][4])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return media.select("doc_id", "media", "frame_sizes").mapInArrow(run, schema)


def write_pcm(media: DataFrame, samples: int = PCM_SAMPLES) -> DataFrame:
    """The PCM blocks of media, written as Parquet and read again. Of samples wanted only their blocks need be read; see seek."""
    return written(pcm_blocks(media, samples), "pcm", compression="zstd")


def seek(blocks: DataFrame, wanted: DataFrame, samples: int = PCM_SAMPLES, width: int = 1) -> DataFrame:
    """(doc_id, start, pcm): the PCM of the samples [start, stop) of wanted (doc_id, start, stop), from blocks as write_pcm gives them,
    width bytes a sample. A range beyond the end is cut there; a range without any sample has no row."""
    each = wanted.filter("stop > start").select("doc_id", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / samples).cast("int"), F.floor((F.col("stop") - 1) / samples).cast("int"))).alias("block"))
    hit = blocks.join(each, ["doc_id", "block"])
    first = F.greatest(F.col("start") - F.col("sample_offset"), F.lit(0))
    last = F.least(F.col("stop") - F.col("sample_offset"), F.col("n_samples"))
    piece = F.substring(F.col("pcm"), (first * width + 1).cast("int"), F.greatest((last - first) * width, F.lit(0)).cast("int"))
    parts = hit.groupBy("doc_id", "start", "stop").agg(F.array_sort(F.collect_list(F.struct("block", piece.alias("pcm")))).alias("p"))
    return parts.select("doc_id", "start", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["pcm"])).alias("pcm")).filter(F.length("pcm") > 0)


def to_pcm(samples: np.ndarray, bits: int) -> tuple[bytes, int]:
    """(PCM bytes, bytes a sample)."""
    if bits <= 8:
        return (samples + 128).astype(np.uint8).tobytes(), 1
    if bits <= 16:
        return samples.astype("<i2").tobytes(), 2
    return samples.astype("<i4").tobytes(), 4


class Features:
    """Peak, root of the mean square in thousandths, and sign changes of the differences of a recording, block by block."""

    def __init__(self):
        self.n = self.peak = self.power = self.turns = 0
        self.end = np.zeros(0, np.int64)

    def add(self, samples: np.ndarray) -> None:
        x = samples.astype(np.int64)
        self.n += len(x)
        self.peak = max(self.peak, int(np.abs(x).max(initial=0)))
        self.power += int((x * x).sum())
        d = np.diff(np.concatenate([self.end, x]))
        self.turns += int((d[1:] * d[:-1] < 0).sum())
        self.end = np.concatenate([self.end, x])[-2:]

    def __str__(self) -> str:
        power = int(round(1000 * float(np.sqrt(self.power / self.n)))) if self.n else 0
        return f"peak={self.peak};rms={power};turns={self.turns}"


def media_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each row of docs, from streams written, read back and decoded in PCM blocks: doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm_blocks (how many).

    The payload is the whole text in UTF-8 (a null text is empty) and zero bytes
    up to a positive multiple of 64, each byte an 8-bit sample. Equal texts give
    equal values, other columns are ignored, and an empty table gives no rows. Long texts are encoded and decoded in slabs.
    """
    media = written(encode_table(docs, text), "media", compression="zstd")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_blocks"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, of, tail, blocks, features = [], hashlib.sha256(), b"", 0, Features()
            for i, x, _, info, last in _Media(b, PCM_SAMPLES):
                pcm = to_pcm(x, info["bits"])[0]
                of.update(pcm)
                features.add(x)
                blocks += 1
                tail = (tail + pcm[-64:])[-64:]
                if last:
                    data = b.column("media")[i].as_buffer()
                    row = (b.column("doc_id")[i].as_py(), b.column("n_bytes")[i].as_py(), features.n, of.hexdigest(), zlib.crc32(tail), data.size, hashlib.sha256(data).hexdigest(), str(features), blocks)
                    out.append(row)
                    of, tail, blocks, features = hashlib.sha256(), b"", 0, Features()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return media.select("doc_id", "media", "frame_sizes", "n_bytes").mapInArrow(
        run,
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pcm_blocks int",
    )
