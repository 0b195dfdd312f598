"""A small VP8L writer for tests: any lengths of codes, back-references, colour cache, transforms.

It builds random token lists and works out the pixels token by token, on its own.
"""

import random
import struct

MULTIPLIER = 0x1E35A7BD


class Out:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]

    def code(self, code, n):
        self.bits += [code >> n - 1 - k & 1 for k in range(n)]

    def bytes(self):
        padded = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(b << k for k, b in enumerate(padded[at : at + 8])) for at in range(0, len(padded), 8))


def lengths_for(symbols, rnd):
    """A complete, uneven code: leaves split at random."""
    symbols = list(symbols)
    rnd.shuffle(symbols)
    if len(symbols) == 1:
        return {symbols[0]: 1}
    leaves = [(0, symbols)]
    out = {}
    while leaves:
        depth, part = leaves.pop()
        if len(part) == 1:
            out[part[0]] = depth
            continue
        cut = rnd.randint(1, len(part) - 1) if depth < 6 else len(part) // 2
        leaves += [(depth + 1, part[:cut]), (depth + 1, part[cut:])]
    return out


def canonical(lengths):
    code, previous, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - previous
        out[s] = (code, n)
        code, previous = code + 1, n
    return out


def put_code(out, used, alphabet, rnd):
    """Writes a code for the used symbols and gives back symbol -> (code, bits)."""
    used = sorted(set(used)) or [0]
    if len(used) == 1 and used[0] < 256:
        out.put(1, 1), out.put(0, 1), out.put(1, 1), out.put(used[0], 8)
        return {used[0]: (0, 0)}
    if len(used) == 1:
        used = [0, used[0]]
    lengths = lengths_for(used, rnd)
    assert max(lengths.values()) <= 15
    out.put(0, 1)
    out.put(19 - 4, 4)
    for _ in range(19):  # a code of 16 symbols with 4 bits for 0..15, run symbols unused
        pass
    order = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    # Symbols 0..14 take 4 bits, 15 and the run of zeros (18) 5 bits each: complete.
    outer = {s: 4 for s in range(15)} | {15: 5, 18: 5}
    for s in order:
        out.put(outer.get(s, 0), 3)
    outer = canonical(outer)
    out.put(0, 1)
    at = 0
    while at < alphabet:
        run = 0
        while at + run < alphabet and lengths.get(at + run, 0) == 0 and run < 138:
            run += 1
        if run >= 11:
            out.code(*outer[18])
            out.put(run - 11, 7)
            at += run
        else:
            out.code(*outer[lengths.get(at, 0)])
            at += 1
    return canonical(lengths)


def prefixed(value):
    """Code, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    top = value.bit_length() - 1
    second = value >> top - 1 & 1
    extra = top - 1
    return 2 * top + second, value - ((2 + second) << extra), extra


def random_tokens(total, cache_bits, rnd, colours, near, width):
    """Tokens and the pixels (argb) they stand for."""
    pixels, tokens = [], []
    cache = {}
    while len(pixels) < total:
        kind = rnd.random()
        if kind < 0.2 and pixels:
            run = min(rnd.randint(1, 9), total - len(pixels))
            far = rnd.randint(1, len(pixels))
            coded = far + 120
            for k, (x, y) in enumerate(near):
                if max(1, x + y * width) == far and rnd.random() < 0.7:
                    coded = k + 1
                    break
            tokens.append(("copy", run, coded))
            for _ in range(run):
                pixels.append(pixels[-far])
        elif kind < 0.4 and cache_bits and pixels:
            for p in pixels:
                cache[(MULTIPLIER * p & 0xFFFFFFFF) >> 32 - cache_bits] = p
            index = rnd.choice(sorted(cache))
            tokens.append(("cache", index))
            pixels.append(cache[index])
        else:
            p = rnd.choice(colours)
            tokens.append(("pixel", p))
            pixels.append(p)
    return tokens, pixels


def put_image(out, tokens, cache_bits, meta, rnd):
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if meta:
        out.put(0, 1)
    used = [[], [], [], [], []]
    for t in tokens:
        if t[0] == "pixel":
            p = t[1]
            for k, v in enumerate((p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24)):
                used[k].append(v)
        elif t[0] == "copy":
            used[0].append(256 + prefixed(t[1])[0])
            used[4].append(prefixed(t[2])[0])
        else:
            used[0].append(280 + t[1])
    size = 280 + (1 << cache_bits if cache_bits else 0)
    codes = [put_code(out, u, n, rnd) for u, n in zip(used, (size, 256, 256, 256, 40), strict=True)]
    for t in tokens:
        if t[0] == "pixel":
            p = t[1]
            for k, v in enumerate((p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24)):
                out.code(*codes[k][v])
        elif t[0] == "copy":
            for k, base, value in ((0, 256, t[1]), (4, 0, t[2])):
                c, extra, n = prefixed(value)
                out.code(*codes[k][base + c])
                out.put(extra, n)
        else:
            out.code(*codes[0][280 + t[1]])


def literals(pixels):
    return [("pixel", p) for p in pixels]


def file(width, height, body):
    """body(out) writes what follows the header."""
    out = Out()
    out.put(width - 1, 14), out.put(height - 1, 14), out.put(1, 1), out.put(0, 3)
    body(out)
    stream = b"\x2f" + out.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(stream)) + stream + bytes(len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def rng(seed):
    return random.Random(seed)
