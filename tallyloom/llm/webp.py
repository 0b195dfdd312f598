"""Media columns as lossless WebP: texts stored as images, images read back as pixel arrays.

store() turns each text's bytes into one or more VP8L files, four bytes a pixel (green, red, blue,
alpha) and 16 pixels a row; read() takes only the stored bytes and gives the samples back. The
reader handles the whole lossless format: simple and normal prefix codes, meta prefix images,
back-references, colour cache, and the predictor, cross-colour, subtract-green and palette
transforms. The writer uses length-limited prefix codes, and per file whichever it estimates
smallest of back-references, a colour cache or literals alone, over the plain pixels, the residuals
of the predictor from above, or palette indexes. (Cross-colour and subtract-green never pay for
text; the writer leaves them to the reader.) Images of one group of codes are read with array
operations: what would begin at each bit is looked up for all bits at once, and the real beginnings
are then followed from one to the next; other images go through the symbol loop.

Defined cases: null text counts as empty; empty payloads are padded to 64 zero bytes. A payload
over 1 MiB becomes several files in a row, each complete. Texts of any length are read whole.
Extra columns are ignored; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import slices, whole_text

ROW_PIXELS = 16
#: Rows of one file: the format's limit on height.
MAX_ROWS = 16_384
BLOCK = 64

# Fixed values of the public VP8L bit-stream format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
LENGTH_CODES, DISTANCE_CODES = 24, 40
#: Offsets (x back, y up) of the 120 short distance codes: the nearest pixels first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda d: (d[0] ** 2 + d[1] ** 2, abs(d[0]), -d[0]))


class WebPError(ValueError):
    """A stream that isn't lossless WebP or breaks its rules."""


def _places(marked: np.ndarray) -> np.ndarray:
    """Where a one-dimensional array isn't 0."""
    return marked.nonzero()[0]


#: Powers of two up to those of the longest code.
POWERS = 1 << np.arange(16)

# --- reading -----------------------------------------------------------------


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data = data + bytes(8)
        self.at = 0
        self.end = 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 6], "little") >> (self.at & 7) & (1 << n) - 1

    def read(self, n: int) -> int:
        value = self.peek(n) if n else 0
        self.at += n
        if self.at > self.end:
            raise WebPError("the stream ends early")
        return value


    def slice(self, at: int, n: int) -> int:
        """n bits from a place on as a number."""
        return int.from_bytes(self.data[at >> 3 : (at + n + 7 >> 3)], "little") >> (at & 7) & (1 << n) - 1

    def read_array(self, n: int) -> np.ndarray:
        """The next n bits one by one."""
        first = self.at >> 3
        if self.at + n > self.end:
            raise WebPError("the stream ends early")
        raw = np.frombuffer(self.data, np.uint8, (self.at + n + 7 >> 3) - first, first)
        out = np.unpackbits(raw, bitorder="little")[self.at & 7 :][:n]
        self.at += n
        return out


@functools.cache
def _mirrored(depth: int) -> np.ndarray:
    """The numbers of `depth` bits with their bits in opposite order."""
    order, out = np.arange(1 << depth), np.zeros(1 << depth, np.int64)
    for bit in range(depth):
        out |= (order >> bit & 1) << depth - 1 - bit
    return out


class PrefixCode:
    """Canonical code from lengths; one symbol alone takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = _places(lengths)
        if not len(used):
            used = np.array([0])
        self.only = int(used[0]) if len(used) == 1 else None
        sizes = lengths[used]
        order = sizes.argsort(kind="stable")
        self.symbols, sizes = used[order], sizes[order]
        self.depth = int(sizes[-1]) if self.only is None else 0
        self._times = POWERS[self.depth - sizes] if self.only is None else None
        if self.only is None and int(self._times.sum()) != 1 << self.depth:
            raise WebPError("prefix code is not complete")
        self._sizes, self._table, self._arrays, self._packed = sizes, None, None, None

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and its bits for every next `depth` bits as read."""
        if self._arrays is None:
            if self.only is not None:
                self._arrays = np.array([self.only], np.int32), np.zeros(1, np.int32)
            else:
                times, order = self._times, _mirrored(self.depth)
                self._arrays = np.repeat(self.symbols.astype(np.int32), times)[order], np.repeat(self._sizes.astype(np.int32), times)[order]
        return self._arrays

    def packed(self) -> np.ndarray:
        """The same in one number, the bits in its lowest four."""
        if self._packed is None:
            if self.only is not None:
                self._packed = np.array([self.only << 4])
            else:
                self._packed = (self.symbols << 4 | self._sizes).repeat(self._times)[_mirrored(self.depth)]
        return self._packed

    def table(self) -> list[tuple[int, int]]:
        """The same as a list of pairs."""
        if self._table is None:
            symbols, sizes = self.arrays()
            self._table = list(zip(symbols.tolist(), sizes.tolist(), strict=True))
        return self._table

    def next(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        symbol, size = self.table()[bits.peek(self.depth)]
        bits.at += size
        return symbol


def _read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            if s >= alphabet:
                raise WebPError("symbol outside its alphabet")
            lengths[s] = 1
        return PrefixCode(lengths)
    outer = np.zeros(19, np.int64)
    count = 4 + bits.read(4)
    word = bits.slice(bits.at, 3 * count)
    bits.at += 3 * count
    for place in CODE_LENGTH_ORDER[:count]:
        outer[place] = word & 7
        word >>= 3
    code = PrefixCode(outer)
    left = alphabet if not bits.read(1) else 2 + bits.read(2 + 2 * bits.read(3))
    if code.depth <= 1 and code.symbols[-1] < 16 and left <= alphabet:
        lengths[:left] = code.symbols[bits.read_array(left) if code.depth else 0]
        return PrefixCode(lengths)
    # The next bits as one number: no length takes more than 14.
    byte, table, mask = bits.at >> 3, code.packed().tolist(), (1 << code.depth) - 1
    word, taken = int.from_bytes(bits.data[byte : byte + 2 * alphabet + 8], "little") >> (bits.at & 7), 0
    values: list[int] = []
    previous = 8
    while left > 0 and len(values) < alphabet:
        left -= 1
        s = table[word & mask]
        size = s & 15
        s >>= 4
        word >>= size
        taken += size
        if s < 16:
            if s:
                previous = s
            values.append(s)
        else:
            extra, least, s = (2, 3, previous) if s == 16 else (3, 3, 0) if s == 17 else (7, 11, 0)
            values += [s] * (least + (word & (1 << extra) - 1))
            word >>= extra
            taken += extra
    if len(values) > alphabet:
        raise WebPError("code lengths run over")
    bits.at += taken
    if bits.at > bits.end:
        raise WebPError("the stream ends early")
    lengths[: len(values)] = values
    return PrefixCode(lengths)


def _prefixed(bits: Bits, code: int) -> int:
    if code < 4:
        return code + 1
    extra = code - 2 >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: Bits, width: int, height: int, meta: bool) -> np.ndarray:
    """Samples (height * width, 4) in the order green, red, blue, alpha."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("colour cache is too large")
    groups, group_of, shift, across = 1, None, 0, 0
    if meta and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width >> shift)
        image = _read_image(bits, across, -(-height >> shift), False).astype(np.int64)
        group_of = (image[:, 1] << 8 | image[:, 0]).tolist()
        groups = max(group_of) + 1
    codes = []
    for _ in range(groups):
        green, start = _read_code(bits, 256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0)), bits.at
        red = _read_code(bits, 256)
        size = bits.at - start
        written = bits.slice(start, size)
        group = [green, red]
        for _ in range(2):
            if bits.slice(bits.at, size) == written and bits.at + size <= bits.end:  # the same code again
                group.append(red)
                bits.at += size
            else:
                group.append(_read_code(bits, 256))
        codes.append([*group, _read_code(bits, DISTANCE_CODES)])
    if groups == 1 and meta and (samples := _read_at_once(bits, codes[0], cache_bits, width, width * height)) is not None:
        return samples
    return _read_symbols(bits, codes, group_of, shift, across, cache_bits, width, height)


#: Extra bits of each length or distance code, and the least value it stands for.
EXTRA_OF = np.array([max(0, c - 2 >> 1) for c in range(DISTANCE_CODES)])
LEAST_OF = np.array([c + 1 if c < 4 else ((2 + (c & 1)) << (c - 2 >> 1)) + 1 for c in range(DISTANCE_CODES)])


def _read_at_once(bits: Bits, codes: list[PrefixCode], cache_bits: int, width: int, total: int) -> np.ndarray | None:
    """The pixels of an image with one group of codes; None, with bits as they were, if it mixes copies and cache hits."""
    if all(c.only is not None for c in codes[:4]) and codes[0].only < 256:
        return np.tile(np.array([c.only for c in codes[:4]], np.uint8), (total, 1))
    first, n = bits.at >> 3, bits.end - bits.at
    # The next 25 bits or more at each bit, from four bytes at each byte.
    four = np.ndarray(len(bits.data) + 20 - first, "<u4", bits.data + bytes(24), first, (1,)).astype(np.int64)
    ahead = np.empty((len(four), 8), np.int64)
    for shift in range(8):
        np.right_shift(four, shift, out=ahead[:, shift])
    ahead = ahead.ravel()[bits.at & 7 :]

    def look(code: PrefixCode, where) -> np.ndarray:
        return code.packed().take(ahead[where] & (1 << code.depth) - 1, mode="wrap")

    green, at = look(codes[0], slice(0, n + 1)), np.arange(n + 64)
    after = at[: n + 1] + (green & 15)  # where what follows green begins
    jump, beyond = after, {}
    for code in codes[1:4]:
        if code.only is None:
            if id(code) not in beyond:
                beyond[id(code)] = at + (look(code, slice(0, n + 64)) & 15)
            jump = beyond[id(code)].take(jump, mode="wrap")
    if codes[0].symbols.max() > 255:
        jump = jump.copy() if jump is after else jump
        special = _places(green >= 256 << 4)
        jump[special] = after[special]
        if codes[0].symbols.max() < 256 + LENGTH_CODES:
            copies = special
        else:
            copies = special[green[special] < 256 + LENGTH_CODES << 4]
        then = after[copies] + EXTRA_OF[(green[copies] >> 4) - 256]
        far = look(codes[4], then)
        jump[copies] = then + (far & 15) + EXTRA_OF[far >> 4]
    # Four beginnings a step; n + 1 stands for all that lies past the end.
    jump = np.append(np.minimum(jump, n + 1), n + 1)
    twice = jump.take(jump, mode="wrap")
    begins, where, step = [], 0, memoryview(twice.take(twice, mode="wrap"))
    for _ in range(-(-total // 4)):
        if where > n:
            break
        begins.append(where)
        where = step[where]
    quads = np.empty((len(begins), 4), np.int64)
    quads[:, 0] = begins
    quads[:, 2] = twice[quads[:, 0]]
    quads[:, 1::2] = jump[quads[:, ::2]]
    begins = quads.ravel()[:total]
    begins = begins[begins <= n]
    symbol = green[begins] >> 4
    copy, run = (symbol > 255) & (symbol < 256 + LENGTH_CODES), np.ones(len(begins), np.int64)
    if copy.any():
        if (symbol >= 256 + LENGTH_CODES).any():
            return None
        code = symbol[copy] - 256
        run[copy] = LEAST_OF[code] + (ahead[after[begins[copy]]] & (1 << EXTRA_OF[code]) - 1)
    ends = np.cumsum(run)
    count = int(np.searchsorted(ends, total)) + 1
    if count > len(ends) or ends[count - 1] != total or jump[begins[count - 1]] > n:
        raise WebPError("the stream ends early or a back-reference leaves the image")
    begins, symbol, copy, run, starts = begins[:count], symbol[:count], copy[:count], run[:count], (ends - run)[:count]
    bits.at += int(jump[begins[-1]])
    literal = symbol < 256
    place = after[begins[literal]]
    colours = np.empty((len(place), 4), np.uint8)
    colours[:, 0] = symbol[literal]
    for channel, code in enumerate(codes[1:4], 1):
        found = look(code, place)
        colours[:, channel] = found >> 4
        place = place + (found & 15)
    if literal.all():
        return colours
    out = np.zeros((total, 4), np.uint8)
    out[starts[literal]] = colours
    if copy.any():
        place = after[begins[copy]] + EXTRA_OF[symbol[copy] - 256]
        far = look(codes[4], place)
        place, far = place + (far & 15), far >> 4
        far = LEAST_OF[far] + (ahead[place] & (1 << EXTRA_OF[far]) - 1)
        for s, length, d in zip(starts[copy].tolist(), run[copy].tolist(), far.tolist(), strict=True):
            d = d - 120 if d > 120 else max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * width)
            if d > s:
                raise WebPError("back-reference leaves the image")
            out[s : s + length] = out[s - d : s - d + length] if d >= length else np.resize(out[s - d : s], (length, 4))
    else:
        if not cache_bits:
            raise WebPError("no colour cache")
        keys = _cache_keys(_argb(colours), cache_bits).astype(np.int64) * total + starts[literal]
        order = np.argsort(keys)
        asked = (symbol[~literal] - 256 - LENGTH_CODES) * total + starts[~literal]
        found = np.searchsorted(keys[order], asked) - 1
        hit = (found >= 0) & (keys[order][found] // total == asked // total)  # an entry that nothing was put in is 0
        out[starts[~literal][hit]] = colours[order[found[hit]]]
    return out


def _argb(samples: np.ndarray) -> np.ndarray:
    """Pixels as alpha, red, green, blue from the top byte down."""
    s = samples.astype(np.uint32)
    return s[:, 3] << 24 | s[:, 1] << 16 | s[:, 0] << 8 | s[:, 2]


def _cache_keys(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    return argb * np.uint32(CACHE_MULTIPLIER) >> np.uint32(32 - cache_bits)


def _read_symbols(bits: Bits, codes, group_of, shift: int, across: int, cache_bits: int, width: int, height: int) -> np.ndarray:
    """Pixel by pixel: literals, back-references and colour-cache hits of any prefix codes."""
    total = width * height
    pixels: list[int] = []  # alpha, red, green, blue from the top byte down
    cache = [0] * (1 << cache_bits) if cache_bits else None
    noted = 0
    while len(pixels) < total:
        at = len(pixels)
        group = codes[group_of[(at // width >> shift) * across + (at % width >> shift)] if group_of else 0]
        s = group[0].next(bits)
        if s < 256:
            red = group[1].next(bits)
            blue = group[2].next(bits)
            pixels.append(group[3].next(bits) << 24 | red << 16 | s << 8 | blue)
        elif s < 256 + LENGTH_CODES:
            run = _prefixed(bits, s - 256)
            far = _prefixed(bits, group[4].next(bits))
            if far > 120:
                far -= 120
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * width)
            if far > at or at + run > total:
                raise WebPError("back-reference leaves the image")
            for _ in range(run):
                pixels.append(pixels[-far])
        else:
            # The cache holds every pixel so far; it is brought up to date only when it is asked.
            if cache is None:
                raise WebPError("no colour cache")
            for p in pixels[noted:]:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> 32 - cache_bits] = p
            noted = at
            pixels.append(cache[s - 256 - LENGTH_CODES])
        if bits.at > bits.end:
            raise WebPError("the stream ends early")
    packed = np.array(pixels, np.uint32)
    return np.stack([packed >> 8 & 255, packed >> 16 & 255, packed & 255, packed >> 24], axis=1).astype(np.uint8)


def _blocks(image: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    """The element of each pixel's block, (height, width, 4)."""
    across = -(-width >> bits)
    grid = image.reshape(-1, across, 4)
    return grid[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b >> 1


def _predict(mode: int, left, top, top_right, top_left):
    """The predicted samples; operands are int arrays (n, 4) or one pixel (4,)."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _half(_half(left, top_right), top)
    if mode == 6:
        return _half(left, top_left)
    if mode == 7:
        return _half(left, top)
    if mode == 8:
        return _half(top_left, top)
    if mode == 9:
        return _half(top, top_right)
    if mode == 10:
        return _half(_half(left, top_left), _half(top, top_right))
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = _half(left, top)
    delta = mean - top_left
    return np.clip(mean + np.sign(delta) * (np.abs(delta) >> 1), 0, 255)


#: What modes 0 and above 13 predict, and the first pixel: opaque black in (g, r, b, a).
BLACK = np.array([0, 0, 0, 255])


def _undo_predictor(samples: np.ndarray, modes: np.ndarray, width: int, height: int) -> np.ndarray:
    """Rows of modes that look only upwards are undone whole, others pixel by pixel."""
    out = samples.reshape(height, width, 4).astype(np.int64)
    modes = modes[:, :, 0] & 15
    out[0, 0] = out[0, 0] + BLACK & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    upward = {2, 3, 4, 8, 9}
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = row[0] + above[0] & 255
        kinds = set(modes[y, 1:].tolist())
        if len(kinds) == 1 and (mode := next(iter(kinds))) in upward | {0, 1, 14, 15}:
            if mode == 1:
                out[y] = np.cumsum(row, axis=0) & 255
                continue
            right = np.concatenate([above[2:], row[:1]])
            guess = _predict(mode, None, above[1:], right, above[:-1]) if mode in upward else BLACK
            row[1:] = row[1:] + guess & 255
            continue
        for x in range(1, width):
            mode = int(modes[y, x])
            right = above[x + 1] if x + 1 < width else row[0]
            guess = BLACK if mode == 0 or mode > 13 else _predict(mode, row[x - 1], above[x], right, above[x - 1])
            row[x] = row[x] + guess & 255
    return out.reshape(-1, 4).astype(np.uint8)


def _undo_cross_colour(samples: np.ndarray, elements: np.ndarray) -> np.ndarray:
    signed = samples.view(np.int8).astype(np.int32)
    by = elements.reshape(-1, 4).view(np.int8).astype(np.int32)
    out = samples.astype(np.int32)
    red = out[:, 1] + (by[:, 2] * signed[:, 0] >> 5) & 255
    new_red = red.astype(np.uint8).view(np.int8).astype(np.int32)
    out[:, 1] = red
    out[:, 2] = out[:, 2] + (by[:, 0] * signed[:, 0] >> 5) + (by[:, 1] * new_red >> 5) & 255
    return out.astype(np.uint8)


def decode(data: bytes) -> tuple[int, int, np.ndarray, int]:
    """width, height, samples (height * width, 4) as green, red, blue, alpha, bytes of the file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise WebPError("not a lossless WebP file")
    size = 8 + struct.unpack("<I", data[4:8])[0]
    bits = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("unknown version")
    stored, undo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if any(kind == u[0] for u in undo):
            raise WebPError("a transform twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            undo.append((kind, _read_image(bits, -(-stored >> block), -(-height >> block), False), block, stored))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, None, 0, stored))
        else:
            colours = bits.read(8) + 1
            palette = np.cumsum(_read_image(bits, colours, 1, False), axis=0, dtype=np.int64).astype(np.uint8)
            pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
            undo.append((kind, palette, pack, stored))
            stored = -(-stored >> pack)
    samples = _read_image(bits, stored, height, True)
    for kind, image, block, across in reversed(undo):
        if kind == PREDICTOR:
            samples = _undo_predictor(samples, _blocks(image, block, across, height), across, height)
        elif kind == CROSS_COLOUR:
            samples = _undo_cross_colour(samples, _blocks(image, block, across, height))
        elif kind == SUBTRACT_GREEN:
            samples = samples.copy()
            samples[:, 1] += samples[:, 0]
            samples[:, 2] += samples[:, 0]
        else:
            index = samples[:, 0].reshape(height, -1)
            if block:
                n, per = 8 >> block, 1 << block
                index = (index[:, :, None] >> np.arange(per) * n & (1 << n) - 1).reshape(height, -1)[:, :across]
            table = np.zeros((256, 4), np.uint8)
            table[: len(image)] = image
            samples = table[index.ravel()]
    return width, height, samples, size


def decode_all(media: bytes) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Shapes and samples of the files in a row."""
    at, shapes, parts = 0, [], []
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        width, height, samples, size = decode(media[at : at + size])
        shapes.append((width, height))
        parts.append(samples)
        at += size
    return shapes, parts[0] if len(parts) == 1 else np.concatenate(parts)


# --- writing -----------------------------------------------------------------


class BitWriter:
    """Fields in a row, each least significant bit first."""

    def __init__(self):
        self.parts: list[tuple[list[int] | np.ndarray, list[int] | np.ndarray]] = [([], [])]

    def put(self, value: int, n: int) -> None:
        self.parts[-1][0].append(value)
        self.parts[-1][1].append(n)

    def repeat(self, first: int, times: int) -> None:
        """What was put from part `first` on, again."""
        self.parts += self.parts[first:] * times + [([], [])]

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.parts += [(values, sizes), ([], [])]

    def finish(self) -> bytes:
        values = np.concatenate([np.asarray(v, np.int64) for v, _ in self.parts])
        sizes = np.concatenate([np.asarray(n, np.int64) for _, n in self.parts])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        # Fields that begin in the same four bytes are added up, which reach into the next four.
        word, fields = starts >> 5, values.astype(np.uint64) << (starts & 31).astype(np.uint64)
        firsts = _places(np.append(True, word[1:] != word[:-1]))
        sums = np.add.reduceat(fields, firsts)
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        out[word[firsts]] = sums & np.uint64(0xFFFFFFFF)
        out[word[firsts] + 1] += sums >> np.uint64(32)
        return out.astype("<u4").tobytes()[: int(ends[-1]) + 7 >> 3]


def code_lengths(counts: list[int], limit: int) -> list[int]:
    """Bits of each of two or more symbols in an optimal code; counts are flattened until no symbol has more than limit."""
    n = len(counts)
    while True:
        order = sorted(range(n), key=counts.__getitem__)
        none = sum(counts) + 1
        leaves, inner, above, leaf, node = [counts[i] for i in order] + [none, none], [none] * (n + 1), [0] * (2 * n - 1), 0, 0
        for new in range(n - 1):  # the two lightest of the next leaves and the next inner nodes
            if leaves[leaf] <= inner[node]:
                weight, above[leaf] = leaves[leaf], n + new
                leaf += 1
            else:
                weight, above[n + node] = inner[node], n + new
                node += 1
            if leaves[leaf] <= inner[node]:
                weight, above[leaf] = weight + leaves[leaf], n + new
                leaf += 1
            else:
                weight, above[n + node] = weight + inner[node], n + new
                node += 1
            inner[new] = weight
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth[:n]) <= limit:
            out = [0] * n
            for k, i in enumerate(order):
                out[i] = depth[k]
            return out
        counts = [c + 1 >> 1 for c in counts]


def canonical(symbols: np.ndarray, sizes: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Code, as it is read, and bits of every symbol."""
    order = sizes.argsort(kind="stable")  # the symbols come in their order
    ranked = sizes[order]
    depth = int(ranked[-1])
    steps = POWERS[depth - ranked]
    codes, lengths = np.zeros(alphabet, np.int64), np.zeros(alphabet, np.int64)
    codes[symbols[order]] = _mirrored(depth)[steps.cumsum() - steps]
    lengths[symbols] = sizes
    return codes, lengths


#: Extra bits of the tokens that code lengths are written with.
EXTRA_BITS = np.array([0] * 16 + [2, 3, 7])


def _put_code(out: BitWriter, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A prefix code for the counts of an alphabet's symbols; gives back code and bits of each symbol."""
    alphabet, used = len(counts), _places(counts)
    if len(used) <= 1:
        symbol = int(used[0]) if len(used) else 0
        if symbol < 256:
            for value, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
                out.put(value, n)
            return np.zeros(alphabet, np.int64), np.zeros(alphabet, np.int64)
        used = np.array([0, symbol])
    sizes = np.array(code_lengths(np.maximum(1, counts[used]).tolist(), 15), np.int64)
    codes, lengths = canonical(used, sizes, alphabet)
    if len(used) == 2 and used[1] < 256:
        for value, n in ((1, 1), (1, 1), (1, 1), (int(used[0]), 8), (int(used[1]), 8)):
            out.put(value, n)
        return codes, lengths
    out.put(0, 1)
    # Runs of equal lengths: 17 and 18 for zeros, 16 for the last length again.
    breaks = (lengths[1:] != lengths[:-1]).nonzero()[0]  # the last place of each run but the last
    ends = [*breaks.tolist(), alphabet - 1]
    runs = map(int.__sub__, ends, [-1, *ends])
    tokens: list[int] = []  # token, and from bit 5 on its extra value
    seen = [0] * 19
    for value, run in zip(lengths[ends].tolist(), runs, strict=True):
        if run == 1:
            seen[value] += 1
            tokens.append(value)
            continue
        if value:
            seen[value] += 1
            tokens.append(value)
            run -= 1
            while run >= 3:
                part = min(run, 6)
                seen[16] += 1
                tokens.append(16 | part - 3 << 5)
                run -= part
        else:
            while run >= 11:
                part = min(run, 138)
                seen[18] += 1
                tokens.append(18 | part - 11 << 5)
                run -= part
            if run >= 3:
                seen[17] += 1
                tokens.append(17 | run - 3 << 5)
                run = 0
        if run:
            seen[value] += run
            tokens += [value] * run
    names = [k for k, c in enumerate(seen) if c]
    bits = code_lengths([seen[k] for k in names], 7) if len(names) > 1 else [1]
    token_codes, token_bits = canonical(np.array(names), np.array(bits), 19) if len(names) > 1 else (np.zeros(19, np.int64), np.zeros(19, np.int64))
    written = dict(zip(names, bits, strict=True))
    count = max(4, 1 + max(CODE_LENGTH_ORDER.index(k) for k in names))
    out.put(count - 4, 4)
    for k in CODE_LENGTH_ORDER[:count]:
        out.put(written.get(k, 0), 3)
    out.put(0, 1)
    packed = np.array(tokens)
    token = packed & 31
    out.put_all(token_codes[token] | packed >> 5 << token_bits[token], token_bits[token] + EXTRA_BITS[token])
    return codes, lengths


#: Pixels of the shortest and the longest back-reference.
LEAST_COPY, MOST_COPY = 3, 4096


def back_references(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, pixels, distance) of copies, greedily from the left; each looks at the last place with its first three pixels."""
    if len(pixels) < 2 * LEAST_COPY - 2:
        return []
    wide = pixels.astype(np.uint64)
    keys = wide[:-2] * np.uint64(0x9E3779B97F4A7C15) + wide[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + wide[2:] * np.uint64(0x165667B19E3779F9)
    order = np.argsort(keys, kind="stable")
    again = keys[order[1:]] == keys[order[:-1]]
    before = np.full(len(keys), -1)
    before[order[1:][again]] = order[:-1][again]
    out, at = [], 0
    places = _places(before >= 0)
    for start, source in zip(places.tolist(), before[places].tolist(), strict=True):
        if start < at:
            continue
        size = 64
        while True:  # few copies are long
            size = min(size, MOST_COPY, len(pixels) - start)
            other = _places(pixels[start : start + size] != pixels[source : source + size])
            if len(other) or size in (MOST_COPY, len(pixels) - start):
                break
            size *= 8
        length = int(other[0]) if len(other) else size
        if length >= LEAST_COPY:
            out.append((start, length, start - source))
            at = start + length
    return out


def _prefix_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, extra value and extra bits of lengths or distances from 1 on."""
    if values.max(initial=0) < PREFIXED:
        code, extra, bits = _prefix_table()
        return code[values], extra[values], bits[values]
    return _prefix_by_size(values)


#: Lengths and distances whose codes are looked up.
PREFIXED = 1 << 13


@functools.cache
def _prefix_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _prefix_by_size(np.maximum(1, np.arange(PREFIXED)))


def _prefix_by_size(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = values - 1
    top = np.frexp(np.maximum(v, 1).astype(float))[1] - 1
    bits = np.where(v < 4, 0, top - 1)
    code = np.where(v < 4, v, 2 * top + (v >> np.maximum(0, top - 1) & 1))
    return code, np.where(v < 4, 0, v & (1 << bits) - 1), bits


@functools.cache
def _log_table() -> np.ndarray:
    """n * log2(n) of counts up to three samples of each pixel of a file."""
    n = np.arange(3 * MAX_ROWS * ROW_PIXELS + 1, dtype=float)
    return n * np.log2(np.maximum(n, 1))


def _entropy(counts: np.ndarray, sums: list[int]) -> float:
    """Bits of the counted symbols, and about what their codes take; sums: counts of each alphabet."""
    table = _log_table()
    return float(sum(table[n] for n in sums) - table[counts].sum()) + 6.0 * np.count_nonzero(counts)


#: Where each channel's counts begin when four are counted as one alphabet.
OFFSETS = np.arange(4) * 256


def _literal_cost(samples: np.ndarray) -> float:
    return _entropy(np.bincount((samples + OFFSETS).ravel(), minlength=1024), [len(samples)] * 4)


class Tokens:
    """An image as literals, copies and cache hits: symbols of the five codes and extra bits."""

    def __init__(self, samples: np.ndarray, copies: list[tuple[int, int, int]] = (), cache_bits: int = 0):
        n = len(samples)
        self.cache_bits, self.extra = cache_bits, None
        # All codes but that of distances as one alphabet: green, red, blue, alpha, and a symbol of no bits.
        self.greens = 256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0)
        self.symbols = samples.astype(np.int64)
        for channel in range(1, 4):
            self.symbols[:, channel] += self.greens + 256 * (channel - 1)
        far = np.empty(0, np.int64)
        self.kind = np.zeros(n, np.int8)
        if copies:
            keep = np.ones(n, bool)
            for s, k, _ in copies:
                keep[s + 1 : s + k] = False
            start, length, distance = np.array(copies, np.int64).T
            code, extra, bits = _prefix_of(length)
            far, more, many = _prefix_of(distance + 120)
            self.extra = (extra, bits, far, more, many)
            self.kind[start] = 1
            self.symbols[start, 0] = 256 + code
            self.symbols[start, 1:] = self.greens + 768
            self.symbols, self.kind = self.symbols[keep], self.kind[keep]
        if cache_bits:
            argb = _argb(samples)
            keys = _cache_keys(argb, cache_bits)
            order = np.argsort(keys, kind="stable")
            hits = order[1:][(keys[order[1:]] == keys[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])]
            self.kind[hits] = 2
            self.symbols[hits, 0] = 256 + LENGTH_CODES + keys[hits]
            self.symbols[hits, 1:] = self.greens + 768
        counts = np.bincount(self.symbols.ravel(), minlength=self.greens + 769)[:-1]
        distances = np.bincount(far, minlength=DISTANCE_CODES)
        self.counts = [counts[: self.greens], *counts[self.greens :].reshape(3, 256), distances]
        tokens, literals = len(self.symbols), int(np.count_nonzero(self.kind == 0)) if len(copies) or cache_bits else len(self.symbols)
        self.cost = _entropy(counts, [tokens, *[literals] * 3]) + (_entropy(distances, [len(far)]) if len(far) else 0.0)
        if self.extra:
            self.cost += int(self.extra[1].sum() + self.extra[4].sum())

    def put(self, out: BitWriter, meta: bool) -> None:
        out.put(1 if self.cache_bits else 0, 1)
        if self.cache_bits:
            out.put(self.cache_bits, 4)
        if meta:
            out.put(0, 1)  # one group of codes
        green, *rest, far = self.counts
        joint = sum(rest)
        apart = _entropy(np.concatenate(rest), [int(c.sum()) for c in rest])
        codes = [_put_code(out, green)]
        if _entropy(joint, [int(joint.sum())]) <= apart * 1.02:  # as in text, where all channels are alike
            out.parts.append(([], []))
            at = len(out.parts) - 1
            codes += [_put_code(out, joint)] * 3
            out.repeat(at, 2)
        else:
            codes += [_put_code(out, c) for c in rest]
        far_codes, far_bits = _put_code(out, far)
        nothing = np.zeros(1, np.int64)
        values = np.concatenate([*(c for c, _ in codes), nothing])[self.symbols]
        sizes = np.concatenate([*(n for _, n in codes), nothing])[self.symbols]
        if self.extra:
            extra, bits, code, more, many = self.extra
            at = _places(self.kind == 1)
            values[at, 1:] = np.stack([extra, far_codes[code], more], axis=1)
            sizes[at, 1:] = np.stack([bits, far_bits[code], many], axis=1)
        out.put_all(values.ravel(), sizes.ravel())


def tokens_of(samples: np.ndarray) -> Tokens:
    """The cheapest of literals alone, back-references and a colour cache."""
    best = Tokens(samples)
    if copies := back_references(np.ascontiguousarray(samples).view(np.uint32).ravel()):
        best = min(best, Tokens(samples, copies), key=lambda t: t.cost)
    if len(samples) >= 1024:
        best = min(best, Tokens(samples, (), 7 if len(samples) < 4096 else 10), key=lambda t: t.cost)
    return best


def _file(width: int, height: int, write) -> bytes:
    out = BitWriter()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    write(out)
    stream = b"\x2f" + out.finish()
    chunk = b"VP8L" + struct.pack("<I", len(stream)) + stream + bytes(len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def encode_plain(samples: np.ndarray, height: int, tokens: Tokens | None = None) -> bytes:
    def write(out: BitWriter) -> None:
        out.put(0, 1)
        (tokens or tokens_of(samples)).put(out, True)

    return _file(ROW_PIXELS, height, write)


#: Predictor blocks of 512 x 512 pixels, all with mode 2: the pixel above.
PREDICTOR_BLOCK, ABOVE = 9, 2


def residuals(samples: np.ndarray) -> np.ndarray:
    """What the predictor from above leaves; the first row is predicted from the left."""
    grid = samples.reshape(-1, ROW_PIXELS, 4)
    out = grid.copy()
    out[1:] -= grid[:-1]
    out[0, 1:] -= grid[0, :-1]
    out[0, 0] -= BLACK.astype(np.uint8)
    return out.reshape(-1, 4)


def encode_predicted(left: np.ndarray, height: int) -> bytes:
    def write(out: BitWriter) -> None:
        out.put(1, 1)
        out.put(PREDICTOR, 2)
        out.put(PREDICTOR_BLOCK - 2, 3)
        modes = np.zeros((-(-height >> PREDICTOR_BLOCK), 4), np.uint8)
        modes[:, 0], modes[:, 3] = ABOVE, 255
        Tokens(modes).put(out, False)
        out.put(0, 1)
        tokens_of(left).put(out, True)

    return _file(ROW_PIXELS, height, write)


def encode_palette(height: int, colours: np.ndarray, index: np.ndarray) -> bytes:
    table = np.ascontiguousarray(colours).view(np.uint8).reshape(-1, 4)
    pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    n, per = 8 >> pack, 1 << pack
    image = np.zeros((len(index) // per, 4), np.uint8)
    image[:, 0] = (index.reshape(-1, per).astype(np.uint16) << np.arange(per) * n).sum(axis=1)
    image[:, 3] = 255

    def write(out: BitWriter) -> None:
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(colours) - 1, 8)
        Tokens(table - np.concatenate([np.zeros((1, 4), np.uint8), table[:-1]])).put(out, False)
        out.put(0, 1)
        tokens_of(image).put(out, True)

    return _file(ROW_PIXELS, height, write)


def encode(payload: bytes) -> bytes:
    """The payload (a positive multiple of 64 bytes) as one or more files, each in the smallest of its forms."""
    files = []
    for at in range(0, len(payload), MAX_ROWS * BLOCK):
        part = np.frombuffer(payload, np.uint8, min(len(payload) - at, MAX_ROWS * BLOCK), at).reshape(-1, 4)
        height = len(part) // ROW_PIXELS
        plain = tokens_of(part)
        best = encode_plain(part, height, plain)
        # A quarter of the samples like those above: only then can the predictor pay.
        if height > 1 and 4 * np.count_nonzero(part[ROW_PIXELS:] == part[:-ROW_PIXELS]) > part.size:
            left = residuals(part)
            if _literal_cost(left) < min(plain.cost, 0.9 * _literal_cost(part)):
                best = min(best, encode_predicted(left, height), key=len)
        words = part.view(np.uint32).ravel()
        # More pixels than colours are needed for a palette to pay; few texts repeat so much.
        if len(words) < 64 or 2 * len(set(words[:512].tolist())) <= min(len(words), 512):
            colours, index = np.unique(words, return_inverse=True)
            if len(colours) <= 256 and 4 * len(colours) < len(best):
                best = min(best, encode_palette(height, colours, index), key=len)
        files.append(best)
    return b"".join(files)


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


# --- Spark -------------------------------------------------------------------

STORED = "doc_id long, n_bytes long, media binary"
PIXELS = "doc_id long, n_bytes long, media binary, width int, height int, files int, pixels binary"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        raw = batch.column(1)
        media = [encode(padded(x.as_buffer().to_pybytes())) for x in raw]
        sizes = pc.binary_length(raw).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (WebP files) of every row of docs; writable as a table."""
    return docs.select("doc_id", F.encode(whole_text(), "UTF-8").alias("raw")).mapInArrow(_store, STORED)


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        shapes, pixels = zip(*(decode_all(x.as_buffer().to_pybytes()) for x in batch.column(2)), strict=True) if batch.num_rows else ((), ())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([s[0][0] for s in shapes], pa.int32()), pa.array([sum(h for _, h in s) for s in shapes], pa.int32()), pa.array([len(s) for s in shapes], pa.int32()), pa.array([p.tobytes() for p in pixels], pa.binary())],
            ["doc_id", "n_bytes", "media", "width", "height", "files", "pixels"],
        )


def read_pixels(stored: DataFrame) -> DataFrame:
    """Pixel arrays (samples as green, red, blue, alpha) of a table of stored media."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_pixels, PIXELS)


def describe(shapes: list[tuple[int, int]], samples: np.ndarray) -> str:
    """Integer features of the pixels: size, sum, distinct values, eight-bin histogram, steps."""
    flat = samples.ravel()
    counts = np.bincount(flat, minlength=256)
    bins = counts.reshape(8, 32).sum(axis=1)
    total = int(counts @ np.arange(256))
    return f"{shapes[0][0]}x{sum(h for _, h in shapes)};files={len(shapes)};mean={total // len(flat)};distinct={int((counts > 0).sum())};hist={','.join(map(str, bins.tolist()))};steps={int((samples[1:, 0] != samples[:-1, 0]).sum())}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        rows = []
        for x in batch.column(2):
            media = x.as_buffer().to_pybytes()
            shapes, samples = decode_all(media)
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), describe(shapes, samples)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [f.split()[0] for f in DIGEST.split(", ")])


def digests(stored: DataFrame) -> DataFrame:
    """Digests and features of what is read back from stored media."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_digest, DIGEST)
