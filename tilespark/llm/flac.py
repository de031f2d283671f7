"""Media columns: FLAC encoding and decoding on numpy arrays, many streams at once.

Encoding cuts a stream of 8-bit mono samples into blocks; each block takes the cheapest of constant, the
fixed predictors of order 0 to 2 and a quantised linear predictor, and writes Rice-coded residuals.
Every frame stands in the seek table. Decoding reads the frames that the seek table names side by side:
each step takes one Rice code from every frame, then predictors are undone for all frames; header (CRC-8)
and frame (CRC-16) checksums and the MD5 of the samples are verified, a mismatch raises. So does a stream
that isn't 8-bit mono, or that has frames outside its seek table.

As a column: a text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the samples.
Null counts as empty; equal texts give equal streams whatever else is in their batch. Long texts are cut
into blocks like short ones. The column and its PCM blocks are stored, and payloads are read from the blocks.
Rows that repeat id and text each have a stream of their own, null ids too. An empty table gives an empty
result; other columns of docs, also ones called media or pcm, don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tilespark.llm.common import chunked, frugal, remove, scratch, small_batches, stored, text_buffer

BLOCK = 2048
LPC_ORDER = 6
PRECISION = 12
#: Texts of so many bytes are encoded at once, streams of so many decoded: encoding takes about 100 times its bytes
#: of memory, decoding about 25 times, with more to win from many frames side by side.
ENCODED, DECODED = 1 << 19, 1 << 21
#: Fixed predictors that encoding tries; decoding knows all five.
FIXED_ORDERS = (0, 1, 2)
I, U = np.int64, np.uint64


def _crc_table(poly: int, bits: int, of: int) -> np.ndarray:
    t = np.arange(1 << of, dtype=I) << (bits - of if bits > of else 0)
    for _ in range(of):
        t = np.where(t >> (bits - 1) & 1, t << 1 ^ poly, t << 1) & ((1 << bits) - 1)
    return t


CRC8 = _crc_table(0x07, 8, 8)
CRC16 = _crc_table(0x8005, 16, 16).astype(np.uint16)
#: Leading zero bits of 16-bit numbers.
LEAD = (15 - np.floor(np.log2(np.maximum(np.arange(1 << 16), 0.5)))).astype(I)


def crc16(buf: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of `length` bytes of buf from each place. Leading zeros leave this CRC at 0, so the runs are aligned
    to the right and read two bytes a step."""
    width = int(length.max(initial=0)) + 1 & ~1
    cols = np.arange(width, dtype=np.int32)
    lead = (width - length).astype(np.int32)
    place = (at - lead)[:, None].astype(np.int32 if len(buf) < 1 << 31 else I) + cols
    b = buf[np.maximum(place, 0, out=place)]
    del place
    b[cols < lead[:, None]] = 0
    w = np.ascontiguousarray((b[:, 0::2].astype(np.uint16) << 8 | b[:, 1::2]).T)
    crc = np.zeros(len(length), np.uint16)
    for row in w:
        crc = CRC16[crc ^ row]
    return crc


def crc8(raw: bytes) -> int:
    c = 0
    for x in raw:
        c = int(CRC8[c ^ x])
    return c


def coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >= 1 << (6 * more + 6 - more):
        more += 1
    head = (0xFF << (7 - more) & 0xFF) | n >> 6 * more
    return bytes([head, *(0x80 | n >> 6 * k & 0x3F for k in range(more - 1, -1, -1))])


def put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = value >> (width - 1 - j) & 1


def predictors(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised linear predictor of each block (rows of x, n samples each): coefficients, shift, and
    whether there is one."""
    f, order = len(x), LPC_ORDER
    # whole numbers: sums don't depend on the order of their terms, so equal blocks get equal predictors
    auto = np.stack([np.einsum("ij,ij->i", x[:, k:], x[:, : x.shape[1] - k]).astype(np.float64) for k in range(order + 1)], 1)
    err, a = auto[:, 0].copy(), np.zeros((f, order))
    ok = (err > 0) & (n > 4 * order)
    err[~ok] = 1
    for k in range(order):
        r = (auto[:, k + 1] - (a[:, :k] * auto[:, k:0:-1]).sum(1)) / err
        prev = a[:, :k].copy()
        a[:, k] = r
        a[:, :k] = prev - r[:, None] * prev[:, ::-1]
        err = np.maximum(err * (1 - r * r), 1e-9)
    top = np.abs(a).max(1)
    ok &= (top > 1e-6) & (top < 60)
    shift = np.clip(PRECISION - 2 - np.ceil(np.log2(np.maximum(top, 1e-6))), 0, 15).astype(I)
    lim = 1 << (PRECISION - 1)
    q = np.clip(np.floor(a * (1 << shift)[:, None] + 0.5), -lim, lim - 1).astype(I)
    return q, shift, ok


def rice_bits(res: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least number of bits for each row's residuals, and its parameter."""
    z = (res << 1 ^ res >> 31) * live
    count = live.sum(1)
    mean = z.sum(1) / np.maximum(count, 1)
    guess = np.clip(np.floor(np.log2(np.maximum(mean, 1) * 0.7)), 0, 14).astype(I)
    best, k_of = np.full(len(res), 1 << 60, I), guess.copy()
    for d in (0, 1):
        k = np.clip(guess + d, 0, 14)
        b = (z >> k[:, None].astype(np.int32)).sum(1) + count * (1 + k)
        k_of = np.where(b < best, k, k_of)
        best = np.minimum(best, b)
    return best, k_of


def encode(data: np.ndarray, offs: np.ndarray, rate: int = 8000) -> list[bytes]:
    """One FLAC stream for each run of bytes (offset binary samples) in data."""
    sizes = np.diff(offs)
    per = -(-sizes // BLOCK)
    total = int(per.sum())
    stream = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
    begin = offs[:-1][stream] + number * BLOCK
    n = np.minimum(BLOCK, offs[1:][stream] - begin)
    cols = np.arange(BLOCK)
    live = cols < n[:, None]
    x = np.zeros((total, BLOCK), np.int32)
    x[live] = data.astype(np.int32) - 128
    constant = ((x == x[:, :1]) | ~live).all(1)
    # the fixed predictor with the least sum of residuals, then its Rice parameter
    best, kind, res = np.full(total, 1 << 60, I), np.zeros(total, I), x
    d, own = x, live
    for order in FIXED_ORDERS:
        if order:
            e = np.zeros_like(x)
            np.subtract(d[:, order:], d[:, order - 1 : -1], out=e[:, order:])
            d = e
        total_abs = np.where(n > order, (np.abs(d) * live).sum(1), 1 << 60)
        win = total_abs < best
        best, kind = np.where(win, total_abs, best), np.where(win, order, kind)
        res = np.where(win[:, None], d, res) if order and win.any() else res
    own = live & (cols >= kind[:, None])
    best, k_of = rice_bits(res, own)
    best += 8 * kind
    coef, shift, ok = predictors(x, n)
    p = np.zeros_like(x)
    for j in range(LPC_ORDER):
        p[:, LPC_ORDER:] += coef[:, j : j + 1].astype(np.int32) * x[:, LPC_ORDER - 1 - j : BLOCK - 1 - j]
    e = x - (p >> shift[:, None].astype(np.int32))
    bits, k = rice_bits(e, live & (cols >= LPC_ORDER))
    bits += LPC_ORDER * (8 + PRECISION) + 9
    win = ok & (bits < best)
    kind, k_of = np.where(win, 32, kind), np.where(win, k, k_of)
    res = np.where(win[:, None], e, res)
    kind[constant] = 99
    order = np.where(kind == 32, LPC_ORDER, np.where(kind == 99, 1, kind))
    # frame headers
    heads = []
    for i in range(total):
        h = bytes([0xFF, 0xF8, 0x70, 0x02]) + coded_number(int(number[i])) + int(n[i] - 1).to_bytes(2, "big")
        heads.append(h + bytes([crc8(h)]))
    head_len = np.fromiter(map(len, heads), I, total)
    body = 8 + 8 * order + np.where(kind == 32, 9 + PRECISION * LPC_ORDER, 0)
    coded = kind != 99
    own = (live & (cols >= order[:, None])) & coded[:, None]
    z = (res << 1 ^ res >> 31)[own]
    kk = np.broadcast_to(k_of[:, None].astype(np.int32), own.shape)[own]
    lens = np.zeros((total, BLOCK), np.int32)
    lens[own] = (z >> kk) + 1 + kk
    ends = np.cumsum(lens, 1, dtype=np.int32)
    body = body + np.where(coded, 10, 0)
    size = head_len + (body + (ends[:, -1] if total else 0) + 7) // 8 + 2
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    bits = np.zeros(len(out) * 8, np.uint8)
    first = (at + head_len) * 8
    code = np.where(kind == 99, 0, np.where(kind == 32, 32 | LPC_ORDER - 1, 8 | kind))
    put(bits, first, code << 1, 8)
    for j in range(int(order.max(initial=0))):
        w = order > j
        put(bits, first[w] + 8 + 8 * j, x[w, j] & 255, 8)
    here = first + 8 + 8 * order
    w = kind == 32
    put(bits, here[w], np.full(int(w.sum()), PRECISION - 1), 4)
    put(bits, here[w] + 4, shift[w], 5)
    for j in range(LPC_ORDER):
        put(bits, here[w] + 9 + PRECISION * j, coef[w, j] & (1 << PRECISION) - 1, PRECISION)
    here = first + body
    put(bits, here[coded] - 4, k_of[coded], 4)  # method and partition order before it are 0
    # each code's one bit and remainder, shifted to the byte grid; bits of codes never overlap, so sums
    # of what falls in a byte put them together
    stop = (here[:, None] + ends)[own]
    v = (1 << kk | z & (1 << kk) - 1) << (-stop & 7).astype(np.int32)
    byte = stop - 1 >> 3
    out = np.packbits(bits)
    if len(v):
        lo = int(byte[0]) - 2
        for back in range(3):
            sums = np.bincount(byte - lo - back, v >> 8 * back & 255)
            out[lo : lo + len(sums)] += sums.astype(np.uint8)
    for a, h in zip(at.tolist(), heads, strict=True):
        out[a : a + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16(out, at, size - 2)
    out[at + size - 2], out[at + size - 1] = crc >> 8, crc & 255
    raw, signed = out.tobytes(), (data ^ 128).tobytes()
    streams, f = [], 0
    for i, count in enumerate(per.tolist()):
        g = f + count
        own_size = size[f:g]
        lo = int(at[f]) if count else 0
        hi = int(at[g - 1] + size[g - 1]) if count else 0
        length = int(sizes[i])
        info = BLOCK.to_bytes(2, "big") * 2 + int(own_size.min(initial=1 << 23 if count else 0)).to_bytes(3, "big") + int(own_size.max(initial=0)).to_bytes(3, "big")
        info += (rate << 44 | 7 << 36 | length).to_bytes(8, "big") + hashlib.md5(signed[offs[i] : offs[i + 1]]).digest()
        seek = b"".join(int(k * BLOCK).to_bytes(8, "big") + int(at[f + k] - lo).to_bytes(8, "big") + int(n[f + k]).to_bytes(2, "big") for k in range(count))
        streams.append(b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + raw[lo:hi])
        f = g
    return streams


@dataclass
class Stream:
    raw: bytes
    frames: int  # where the first frame begins
    length: int
    bits: int
    md5: bytes
    seek: list[tuple[int, int, int]]


def parse(raw: bytes) -> Stream:
    if raw[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, s, seek = 4, False, None, []
    while not last:
        last, kind, size = bool(raw[at] & 128), raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
        b = raw[at + 4 : at + 4 + size]
        if kind == 0:
            v = int.from_bytes(b[10:18], "big")
            s = Stream(raw, 0, v & (1 << 36) - 1, (v >> 36 & 31) + 1, b[18:34], seek)
        elif kind == 3:
            seek += [(int.from_bytes(b[k : k + 8], "big"), int.from_bytes(b[k + 8 : k + 16], "big"), int.from_bytes(b[k + 16 : k + 18], "big")) for k in range(0, size, 18)]
        at += 4 + size
    if s is None:
        raise ValueError("a FLAC stream without STREAMINFO")
    s.frames = at
    return s


def frame_head(raw: bytes, at: int) -> tuple[int, int]:
    """Samples in the frame at this place, and the length of its header, whose CRC-8 is verified."""
    if raw[at] != 0xFF or raw[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame here")
    code, p = raw[at + 2] >> 4, at + 4
    lead = raw[p]
    p += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if code == 6:
        n, p = raw[p] + 1, p + 1
    elif code == 7:
        n, p = int.from_bytes(raw[p : p + 2], "big") + 1, p + 2
    else:
        n = 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8
    p += {12: 1, 13: 2, 14: 2}.get(raw[at + 2] & 15, 0)
    if crc8(raw[at:p]) != raw[p]:
        raise ValueError("a frame header doesn't match its CRC-8")
    return n, p + 1 - at


def decode_frames(buf: np.ndarray, at: np.ndarray, end: np.ndarray, head: np.ndarray, n: np.ndarray, bps: int = 8) -> np.ndarray:
    """Samples (frames x longest block) of mono frames at these places of buf, side by side. Verifies each
    frame's CRC-16."""
    f = len(at)
    if (crc16(buf, at, end - at - 2) != (buf[end - 2].astype(I) << 8 | buf[end - 1])).any():
        raise ValueError("a frame doesn't match its CRC-16")
    padded = np.r_[buf, np.zeros(16, np.uint8)]
    window = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))

    def take(p: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned bits at places p (of bits)."""
        w = window[p >> 3].astype(U) << (p & 7).astype(U)
        return (w >> U(1) >> (U(63) - np.asarray(width).astype(U))).astype(I)

    def signed(v: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        s = I(1) << (np.asarray(width, I) - 1)
        return (v ^ s) - s

    p = (at + head) * 8
    kind = take(p, 8)
    if (kind & 129).any():
        raise ValueError("wasted bits aren't supported")
    kind >>= 1
    p = p + 8
    out = np.zeros((int(n.max(initial=0)), f), np.int32)
    constant, verbatim, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | lpc).all():
        raise ValueError("a subframe of a reserved kind")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    if constant.any():
        out[:, constant] = signed(take(p[constant], bps), bps)
    for i in range(int(n[verbatim].max(initial=0))):
        w = np.flatnonzero(verbatim & (n > i))
        out[i, w] = signed(take(p[w] + bps * i, bps), bps)
    for i in range(int(order.max(initial=0))):
        w = np.flatnonzero(order > i)
        out[i, w] = signed(take(p[w] + bps * i, bps), bps)
    p = p + bps * order
    most = int(order[lpc].max(initial=0))
    coef, shift = np.zeros((most, f), I), np.zeros(f, I)
    if most:
        w = np.flatnonzero(lpc)
        prec = take(p[w], 4) + 1
        shift[w] = take(p[w] + 4, 5)
        p[w] += 9
        for j in range(most):
            h = order[w] > j
            coef[j, w[h]] = signed(take(p[w[h]], prec[h]), prec[h])
            p[w[h]] += prec[h]
    # Rice residuals, one of each frame a step; frames with more residuals first, so that those still
    # open are the first ones
    todo = np.flatnonzero((fixed | lpc) & (n > order))
    todo = todo[np.argsort(order[todo] - n[todo], kind="stable")]
    if len(todo):
        m, pos, length, o = len(todo), p[todo], n[todo], order[todo]
        wide = np.where(take(pos, 2) == 1, 5, 4)
        parts = take(pos + 2, 4)
        pos = pos + 6
        part_len = length >> parts
        left = part_len - o
        k, raw_width = np.zeros(m, I), np.full(m, -1, I)
        res = np.zeros((int(length.max()), m), np.int32)
        place = o.copy()  # sample that the next code of this frame gives
        need_head = np.ones(m, bool)
        lanes = m
        while lanes:
            if need_head[:lanes].any():
                w = np.flatnonzero(need_head[:lanes])
                k[w] = take(pos[w], wide[w])
                esc = k[w] == np.where(wide[w] == 5, 31, 15)
                pos[w] += wide[w]
                raw_width[w] = -1
                if esc.any():
                    v = w[esc]
                    raw_width[v] = take(pos[v], 5)
                    pos[v] += 5
                need_head[w] = False
            steps = int(min(left[:lanes].min(), (length[:lanes] - place[:lanes]).min()))
            kk, pp, row, lane = k[:lanes].astype(U), pos[:lanes], place[:lanes], np.arange(lanes)
            plain = not (raw_width[:lanes] >= 0).any()
            k_i, tail = k[:lanes], U(63) - kk
            even = bool((row == row[0]).all())
            for s in range(steps):
                w = window[pp >> 3].astype(U) << (pp & 7).astype(U)
                q = LEAD[(w >> U(48)).astype(I)]
                if (q == 16).any():
                    more = np.flatnonzero(q == 16)
                    far = pp.copy()
                    while len(more):
                        far[more] += 16
                        w[more] = window[far[more] >> 3].astype(U) << (far[more] & 7).astype(U)
                        add = LEAD[(w[more] >> U(48)).astype(I)]
                        q[more] += add
                        more = more[add == 16]
                    short = q - (far - pp)
                else:
                    short = q
                v = q << k_i | (w << (short + 1).astype(U) >> U(1) >> tail).astype(I)
                v = v >> 1 ^ -(v & 1)
                step = q + 1 + k_i
                if not plain:
                    e = np.flatnonzero(raw_width[:lanes] >= 0)
                    rw = raw_width[e]
                    v[e] = np.where(rw > 0, signed(take(pp[e], np.maximum(rw, 1)), np.maximum(rw, 1)), 0)
                    step[e] = rw
                if even:
                    res[row[0] + s, :lanes] = v
                else:
                    res[row + s, lane] = v
                pp = pp + step
            pos[:lanes] = pp
            place[:lanes] += steps
            left[:lanes] -= steps
            fresh = left[:lanes] == 0
            left[:lanes][fresh] = part_len[:lanes][fresh]
            need_head[:lanes][fresh] = True
            lanes = int((place < length).sum())
        for i in range(int(o.max(initial=0))):
            w = np.flatnonzero(o > i)
            res[i, w] = out[i, todo[w]]
        simple = ~lpc[todo]
        for q in range(1, 5):
            w = np.flatnonzero(simple & (o == q))
            if len(w):
                # undo differences: the first q rows are samples, their differences start the sums
                d = res[:, w]
                starts = [d[:q]]
                for _ in range(q - 1):
                    starts.append(np.diff(starts[-1], axis=0))
                d = d.copy()
                for level in range(q - 1, -1, -1):
                    d[level] = starts[level][0]
                    d[level:] = np.cumsum(d[level:], axis=0)
                res[:, w] = d
        w = np.flatnonzero(~simple)
        if len(w):
            r, c, sh, oo = np.ascontiguousarray(res[:, w]), coef[:, todo[w]], shift[todo[w]], o[w]
            low = int(oo.min())
            for i in range(low, len(r)):
                acc = np.zeros(len(w), I)
                for j in range(min(i, most)):
                    acc += c[j] * r[i - 1 - j]
                acc >>= sh
                if i < most:
                    acc[oo > i] = 0
                r[i] += acc
            res[:, w] = r
            del r
        out[: len(res), todo] = res
    return out.T


def decode(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Samples of all streams as offset binary bytes, one after another, and where each begins."""
    parsed = [parse(s) for s in streams]
    if any(s.bits != 8 for s in parsed):
        raise ValueError("samples aren't of 8 bits")
    buf = np.frombuffer(b"".join(streams), np.uint8)
    at, end, head, n, base = [], [], [], [], 0
    for s in parsed:
        starts = [s.frames + o for _, o, _ in s.seek]
        for k, a in enumerate(starts):
            m, h = frame_head(s.raw, a)
            if m != s.seek[k][2]:
                raise ValueError("the seek table doesn't match a frame")
            at.append(base + a)
            end.append(base + (starts[k + 1] if k + 1 < len(starts) else len(s.raw)))
            head.append(h)
            n.append(m)
        base += len(s.raw)
    at, end, head, n = (np.array(v, I) for v in (at, end, head, n))
    offs = np.r_[0, np.cumsum([s.length for s in parsed])].astype(I)
    if int(n.sum()) != offs[-1]:
        raise ValueError("frames are missing")
    if len(at):
        x = decode_frames(buf, at, end, head, n)
        flat = x[np.arange(x.shape[1]) < n[:, None]]
    else:
        flat = np.zeros(0, I)
    signed = flat.astype(np.int8).tobytes()
    for i, s in enumerate(parsed):
        if hashlib.md5(signed[offs[i] : offs[i + 1]]).digest() != s.md5:
            raise ValueError("samples don't match their MD5")
    return (flat + 128).astype(np.uint8), offs


def read_samples(stream: bytes, start: int, count: int) -> bytes:
    """Some samples only: the seek table leads to the frames that hold them."""
    s = parse(stream)
    buf, out = np.frombuffer(stream, np.uint8), []
    for k, (sample, offset, n) in enumerate(s.seek):
        if sample + n > start and sample < start + count:
            a = s.frames + offset
            e = s.frames + s.seek[k + 1][1] if k + 1 < len(s.seek) else len(stream)
            m, h = frame_head(stream, a)
            x = decode_frames(buf, *(np.array([v], I) for v in (a, e, h, m)))[0]
            out.append((x[max(0, start - sample) : start + count - sample] + 128).astype(np.uint8).tobytes())
    return b"".join(out)


def pad(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zero bytes after each run, up to a positive multiple of 64."""
    size = np.diff(offs)
    full = np.maximum(64, -(-size // 64) * 64)
    at = np.r_[0, np.cumsum(full)].astype(I)
    out = np.zeros(int(at[-1]), np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] - offs[:-1], size)] = data
    return out, at


def features(pcm: np.ndarray) -> str:
    """Of one stream's samples: mean level, root mean square, peak, zero crossings, and mean step."""
    x = pcm.astype(I) - 128
    step = np.abs(np.diff(x))
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};peak={np.abs(x).max()};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};step={step.mean() if len(step) else 0.0:.4f}"


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a FLAC column."""

    def make(batches):
        for b in batches:
            for lo, hi, data, offs in chunked(*text_buffer(b.column("text")), ENCODED):
                media = encode(*pad(data, offs))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(frugal(make), "doc_id long, n_bytes long, media binary")


def _decoded(media: list[bytes]):
    """Runs of streams of about DECODED bytes, decoded: first stream, samples, where each begins."""
    i = 0
    while i < len(media):
        j, size = i, 0
        while j < len(media) and (j == i or size + len(media[j]) <= DECODED):
            size += len(media[j])
            j += 1
        yield i, *decode(media[i:j])
        i = j


def read_media(media: DataFrame) -> DataFrame:
    """Decodes a media column: payload size and digest, crc32 of the last 64 samples, features."""

    def look(batches):
        for b in batches:
            col = b.column("media").to_pylist()
            rows: list[tuple] = []
            for i, pcm, offs in _decoded(col):
                raw = pcm.tobytes()
                for k in range(len(offs) - 1):
                    own = raw[offs[k] : offs[k + 1]]
                    m = col[i + k]
                    rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]), len(m), hashlib.sha256(m).hexdigest(), features(pcm[offs[k] : offs[k + 1]])))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *cols], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(look, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


BLOCKS = "row long, doc_id long, n_bytes long, media_bytes long, media_sha256 string, samples long, block long, sample_offset long, n long, pcm binary"
PAYLOADS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def arrow_schema(ddl: str) -> pa.Schema:
    """On the driver: the text is read by the session."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def record_batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(target)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)


def pcm_blocks(media: DataFrame, samples: int = BLOCK) -> DataFrame:
    """PCM blocks of a media column with their sample offsets: block, sample_offset, n, pcm, beside what is
    known of the whole stream. `row` tells rows of media apart once the blocks are stored."""
    target = arrow_schema(BLOCKS)

    def cut(batches):
        for b in batches:
            of = [b.column(c).to_pylist() for c in ("row", "doc_id", "n_bytes")]
            col = b.column("media").to_pylist()
            for i, pcm, offs in _decoded(col):
                rows = []
                for k in range(len(offs) - 1):
                    m, own = col[i + k], pcm[offs[k] : offs[k + 1]]
                    known = (*(c[i + k] for c in of), len(m), hashlib.sha256(m).hexdigest(), len(own))
                    rows += [(*known, s // samples, s, len(own[s : s + samples]), own[s : s + samples].tobytes()) for s in range(0, len(own), samples)]
                yield record_batch(rows, target)

    rows = media.where(F.col("media").isNotNull()).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", "media")
    return rows.mapInArrow(frugal(cut), BLOCKS)


def joined(blocks: DataFrame, whole: bool) -> DataFrame:
    """Payloads of streams all of whose blocks stand together in a task. Other streams come back as longer
    blocks, with the columns of payloads empty; with whole=True they raise."""
    schema = f"{PAYLOADS}, piece struct<{BLOCKS}>"
    target, names = arrow_schema(schema), arrow_schema(BLOCKS).names

    def look(batches):
        head: dict | None = None
        parts: list[bytes] = []

        def result() -> tuple:
            own = b"".join(parts)
            if head["sample_offset"] == 0 and len(own) == head["samples"]:
                return (head["doc_id"], head["n_bytes"], len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]), head["media_bytes"], head["media_sha256"], features(np.frombuffer(own, np.uint8)), None)
            if whole:
                raise ValueError("blocks are missing")
            return (*(None,) * 8, head | {"n": len(own), "pcm": own})

        size = 0
        for b in batches:
            rows: list[tuple] = []
            for r in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                r = dict(zip(names, r, strict=True))
                if head is None or r["row"] != head["row"] or r["sample_offset"] != head["sample_offset"] + size:
                    if head is not None:
                        rows.append(result())
                    head, parts, size = r, [], 0
                parts.append(r["pcm"])
                size += len(r["pcm"])
            yield record_batch(rows, target)
        if head is not None:
            yield record_batch([result()], target)

    return blocks.select(*names).mapInArrow(frugal(look), schema)


def payloads(blocks: DataFrame) -> DataFrame:
    """The columns of read_media, from stored PCM blocks. Only streams whose blocks are read by more than
    one task are dealt out again."""
    read = stored(joined(blocks, whole=False), "media-payloads")
    pieces = read.where("piece is not null").select("piece.*").repartition("row").sortWithinPartitions("row", "sample_offset")
    return read.where("piece is null").drop("piece").unionByName(joined(pieces, whole=True).drop("piece"))


def through_store(docs: DataFrame, waves: int = 4, one_wave_bytes: int = 1 << 26) -> DataFrame:
    """The columns of read_media, by way of stored media and stored PCM blocks. All rows are dealt to `waves` by
    their texts (to one if there are at most one_wave_bytes of text); each wave's media are stored, read back
    and decoded to blocks, which are stored for good. Media are incompressible and nearly as large as the texts,
    so those of one wave stay at a time, until the next wave's take their place."""
    spark = docs.sparkSession
    small_batches(spark)
    blocks, media = scratch(spark, "pcm-blocks"), None
    if (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= one_wave_bytes:
        waves = 1
    dealt = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(waves))
    for wave in range(waves):
        if media:
            remove(spark, media)
        media = scratch(spark, "media")
        text_media(docs.select("doc_id", "text").where(dealt == wave)).write.option("compression", "zstd").parquet(media)
        own = pcm_blocks(spark.read.parquet(media)).withColumn("row", F.col("row") * waves + wave)
        own.write.mode("append").option("compression", "zstd").parquet(blocks)
    return payloads(spark.read.parquet(blocks))
