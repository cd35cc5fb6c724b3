"""JPEG-LS frames: prediction from three neighbours, adaptive Golomb codes, runs.

One scan for each sample; 2 to 16 bits; lossless, or no pixel off by more than `near`. Encoder and decoder walk the same model; only what they do with a
number differs, so the model is written once.
"""

from __future__ import annotations

import struct

import numpy as np

from tessera.errors import Unsupported

# Fixed values of the standard: bits of the run lengths by run index, the halving period, and the basic thresholds.
RUN_BITS = [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 9, 10, 11, 12, 13, 14, 15]
RESET, THRESHOLDS = 64, (3, 7, 21)
FRAME, SCAN = 0xF7, 0xDA


class _Out:
    """Bits to bytes; after a byte of ones the next begins with a zero."""

    def __init__(self) -> None:
        self.data, self.held, self.n = bytearray(), 0, 0

    def bits(self, value: int, n: int) -> int:
        self.held, self.n = self.held << n | value, self.n + n
        while self.n >= (room := 7 if self.data and self.data[-1] == 0xFF else 8):
            self.n -= room
            self.data.append(self.held >> self.n)
            self.held &= (1 << self.n) - 1
        return value

    def golomb(self, value: int, k: int, limit: int, wide: int) -> int:
        high = value >> k
        if high < limit - wide - 1:
            self.bits(1, high + 1)
            self.bits(value & ((1 << k) - 1), k)
        else:
            self.bits(1, limit - wide)
            self.bits(value - 1, wide)
        return value

    def done(self) -> bytes:
        if self.n:
            self.bits(0, (7 if self.data and self.data[-1] == 0xFF else 8) - self.n)
        if self.data and self.data[-1] == 0xFF:
            self.data.append(0)
        return bytes(self.data)


class _In:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def _more(self) -> None:
        byte = self.data[self.at] if self.at < len(self.data) else 0
        room = 7 if self.at and self.at <= len(self.data) and self.data[self.at - 1] == 0xFF else 8
        self.held, self.n, self.at = (self.held & ((1 << self.n) - 1)) << room | byte, self.n + room, self.at + 1

    def bits(self, _: int, n: int) -> int:
        while self.n < n:
            self._more()
        self.n -= n
        return self.held >> self.n & ((1 << n) - 1)

    def golomb(self, _: int, k: int, limit: int, wide: int) -> int:
        high = 0
        while not self.bits(0, 1):
            high += 1
            if high > limit:
                raise Unsupported("the stream ends inside a frame")
        return high << k | self.bits(0, k) if high < limit - wide - 1 else self.bits(0, wide) + 1


def _code(plane: list[list[int]], rows: int, columns: int, bits: int, stream, write: bool, near: int = 0) -> None:
    """Encodes the plane to the stream, or fills it from the stream; an encoded plane holds what a decoder will have."""
    top, unit = (1 << bits) - 1, 2 * near + 1
    span, limit = (top + 2 * near) // unit + 1, 2 * (max(2, bits) + max(8, bits))
    wide = max((span - 1).bit_length(), 1)
    factor = (min(top, 4095) + 128) // 256
    basic = (factor * (t - b) + b for t, b in zip(THRESHOLDS, (2, 3, 4), strict=True)) if top >= 128 else (max(b, t // (256 // (top + 1))) for t, b in zip(THRESHOLDS, (2, 3, 4), strict=True))
    t1, t2, t3 = (t + k * near for t, k in zip(basic, (3, 5, 7), strict=True))
    low = near + 1
    t1 = t1 if low <= t1 <= top else low
    t2 = t2 if t1 <= t2 <= top else t1
    t3 = t3 if t2 <= t3 <= top else t2
    size, drift, fix, seen = [max(2, (span + 32) // 64)] * 367, [0] * 365, [0] * 365, [1] * 367
    below = [0, 0]  # negative errors after runs, by type
    run_index = 0
    step = lambda d: 0 if abs(d) <= near else (d > 0) - (d < 0) if abs(d) < t1 else (2 if abs(d) < t2 else 3 if abs(d) < t3 else 4) * (1 if d > 0 else -1)
    before, before_left = [0] * (columns + 2), 0

    def error(x: int, guess: int, sign: int) -> int:
        """The number that is coded for a pixel: its distance from the guess in units, folded into the span."""
        e = (x - guess) * sign
        e = ((e + near) // unit if e > 0 else -((near - e) // unit)) % span
        return e - span if e >= (span + 1) // 2 else e

    def pixel(e: int, guess: int, sign: int) -> int:
        v = guess + sign * e * unit
        v = v + span * unit if v < -near else v - span * unit if v > top + near else v
        return min(max(v, 0), top)

    for y in range(rows):
        line = plane[y]
        left_edge = before[0]  # stands in for the left neighbour of the first one
        x = 0
        while x < columns:
            b = before[x]
            a = line[x - 1] if x else left_edge
            c = before[x - 1] if x else before_left
            d = before[x + 1] if x + 1 < columns else b
            if abs(d - b) <= near and abs(b - c) <= near and abs(c - a) <= near:
                n = 0
                if write:
                    while x + n < columns and abs(line[x + n] - a) <= near:
                        n += 1
                    rest = n
                    line[x : x + n] = [a] * n
                    while rest >= 1 << RUN_BITS[run_index]:
                        stream.bits(1, 1)
                        rest -= 1 << RUN_BITS[run_index]
                        run_index = min(run_index + 1, 31)
                    ended = x + n == columns
                    if ended:
                        if rest:
                            stream.bits(1, 1)
                    else:
                        stream.bits(0, 1)
                        stream.bits(rest, RUN_BITS[run_index])
                else:
                    ended = True
                    while x + n < columns:
                        if stream.bits(0, 1):
                            whole = 1 << RUN_BITS[run_index]
                            run_index = min(run_index + 1, 31) if whole <= columns - x - n else run_index
                            n += min(whole, columns - x - n)
                        else:
                            n += stream.bits(0, RUN_BITS[run_index])
                            ended = False
                            break
                    line[x : x + n] = [a] * n
                x += n
                if ended:
                    break
                # the one that ends the run
                b = before[x]
                a = line[x - 1] if x else left_edge
                alike = int(abs(a - b) <= near)
                guess, sign = (a, 1) if alike else (b, -1 if a > b else 1)
                q = 365 + alike
                scale = size[366] + (seen[366] >> 1) if alike else size[365]
                k = 0
                while seen[q] << k < scale:
                    k += 1
                e = 0
                if write:
                    e = error(line[x], guess, sign)
                flip = lambda e: int(k == 0 and e > 0 and 2 * below[alike] < seen[q] or e < 0 and (k != 0 or 2 * below[alike] >= seen[q]))  # noqa: E731, B023
                mapped = stream.golomb(2 * abs(e) - alike - flip(e), k, limit - RUN_BITS[run_index] - 1, wide)
                if not write:
                    half = (mapped + alike + 1) // 2
                    odd = (mapped + alike) & 1  # whether the sign was flipped
                    e = next(v for v in ((half, -half) if half else (0,)) if flip(v) == odd)
                line[x] = pixel(e, guess, sign)
                run_index = max(run_index - 1, 0)
                below[alike] += e < 0
                size[q] += (mapped + 1 - alike) >> 1
                if seen[q] == RESET:
                    size[q], seen[q], below[alike] = size[q] >> 1, seen[q] >> 1, below[alike] >> 1
                seen[q] += 1
                x += 1
                continue
            q1, q2, q3 = step(d - b), step(b - c), step(c - a)
            sign = -1 if (q1 or q2 or q3) < 0 else 1
            q = sign * (81 * q1 + 9 * q2 + q3)
            guess = min(a, b) if c >= max(a, b) else max(a, b) if c <= min(a, b) else a + b - c
            guess = min(max(guess + sign * fix[q], 0), top)
            k, n = 0, seen[q]
            while n << k < size[q]:
                k += 1
            turned = k == 0 and not near and 2 * drift[q] <= -n
            e = 0
            if write:
                e = error(line[x], guess, sign)
                mapped = (2 * e + 1 if e >= 0 else -2 * (e + 1)) if turned else (2 * e if e >= 0 else -2 * e - 1)
                stream.golomb(mapped, k, limit, wide)
            else:
                mapped = stream.golomb(0, k, limit, wide)
                e = -(mapped >> 1) - 1 if mapped & 1 else mapped >> 1
                e = -e - 1 if turned else e
            line[x] = pixel(e, guess, sign)
            drift[q] += e * unit
            size[q] += abs(e)
            if n == RESET:
                size[q], drift[q], seen[q] = size[q] >> 1, drift[q] >> 1, n >> 1
            seen[q] += 1
            if drift[q] <= -seen[q]:
                drift[q] = max(drift[q] + seen[q], 1 - seen[q])
                fix[q] = max(fix[q] - 1, -128)
            elif drift[q] > 0:
                drift[q] = min(drift[q] - seen[q], 0)
                fix[q] = min(fix[q] + 1, 127)
            x += 1
        before_left, before = left_edge, line


def encode(a: np.ndarray, bits: int | None = None, near: int = 0) -> bytes:
    """A frame of bytes or 16-bit numbers, (rows, columns) or (rows, columns, samples); near: how far a decoded pixel may be off."""
    bits = bits or 8 * a.dtype.itemsize
    planes = a.reshape(*a.shape[:2], -1)
    n = planes.shape[2]
    out = [b"\xff\xd8", struct.pack(">BBHBHHB", 0xFF, FRAME, 8 + 3 * n, bits, *a.shape[:2], n), *[bytes([c + 1, 0x11, 0]) for c in range(n)]]
    for c in range(n):
        stream = _Out()
        _code(planes[..., c].tolist(), *a.shape[:2], bits, stream, True, near)
        out += [struct.pack(">BBHB", 0xFF, SCAN, 8, 1), bytes([c + 1, 0, near, 0, 0]), stream.done()]
    return b"".join([*out, b"\xff\xd9"])


def decode(data: bytes) -> np.ndarray:
    """The frame of an encoder that leaves samples apart and has the default thresholds."""
    at, head, planes = 2, None, []
    while at + 4 <= len(data) and data[at + 1] != 0xD9:
        marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == FRAME:
            head = struct.unpack(">BHHB", body[:6])
        elif marker == 0xF8:
            raise Unsupported("parameters of its own")
        elif marker == SCAN:
            if head is None or body[0] != 1 or body[4]:
                raise Unsupported("samples together")
            end = at
            while not (data[end] == 0xFF and data[end + 1] >= 0x80):
                end += 1
            bits, rows, columns, _ = head
            plane = [[0] * columns for _ in range(rows)]
            _code(plane, rows, columns, bits, _In(data[at:end]), False, body[3])
            planes.append(plane)
            at = end
    if head is None or len(planes) != head[3]:
        raise Unsupported("not all samples are there")
    image = np.moveaxis(np.array(planes, np.uint16), 0, -1).astype(np.uint8 if head[0] <= 8 else np.uint16)
    return image[..., 0] if len(planes) == 1 else image
