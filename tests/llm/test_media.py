import hashlib
import os
import zlib

import numpy as np
import pytest

import vp8l_writer as vw
from tallyloom.llm import webp


def argb(samples):
    s = samples.astype(np.uint32)
    return (s[:, 3] << 24 | s[:, 1] << 16 | s[:, 0] << 8 | s[:, 2]).tolist()


@pytest.mark.parametrize("seed", range(12))
def test_general_streams(seed):
    rnd = vw.rng(seed)
    width, height, cache = rnd.randint(1, 19), rnd.randint(1, 15), rnd.choice([0, 1, 4, 8])
    colours = [rnd.getrandbits(32) for _ in range(rnd.choice([1, 3, 40]))]
    tokens, pixels = vw.random_tokens(width * height, cache, rnd, colours, webp.NEAR, width)

    def body(out):
        out.put(0, 1)
        vw.put_image(out, tokens, cache, True, rnd)

    w, h, samples, size = webp.decode(vw.file(width, height, body))
    assert (w, h) == (width, height) and argb(samples) == pixels


def channels(p):
    return [p >> 24 & 255, p >> 16 & 255, p >> 8 & 255, p & 255]


def packed(c):
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def predict(mode, l, t, tr, tl):
    """The format's predictors on single channel lists (a, r, g, b)."""
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: max(0, min(255, v))
    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode == 11:
        p = [a + b - c for a, b, c in zip(l, t, tl, strict=True)]
        far_l = sum(abs(x - y) for x, y in zip(p, l, strict=True))
        far_t = sum(abs(x - y) for x, y in zip(p, t, strict=True))
        return l if far_l < far_t else t
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(l, t, tl, strict=True)]
    if mode == 13:
        return [clamp(a + int((a - c) / 2)) for a, c in zip(avg(l, t), tl, strict=True)]
    return {1: l, 2: t, 3: tr, 4: tl, 5: avg(avg(l, tr), t), 6: avg(l, tl), 7: avg(l, t), 8: avg(tl, t), 9: avg(t, tr), 10: avg(avg(l, tl), avg(t, tr))}[mode]


@pytest.mark.parametrize("mode", [*range(16), None])
def test_predictor(mode):
    rnd = vw.rng(mode or 99)
    width, height, block = 11, 9, 2
    across, down = -(-width >> block), -(-height >> block)
    modes = [mode if mode is not None else rnd.randrange(14) for _ in range(across * down)]
    left = [rnd.getrandbits(32) for _ in range(width * height)]

    def body(out):
        out.put(1, 1), out.put(webp.PREDICTOR, 2), out.put(block - 2, 3)
        vw.put_image(out, vw.literals([255 << 24 | m << 8 for m in modes]), 0, False, rnd)
        out.put(0, 1)
        vw.put_image(out, vw.literals(left), 0, True, rnd)

    want = []
    for y in range(height):
        for x in range(width):
            at = y * width + x
            if at == 0:
                guess = [255, 0, 0, 0]
            elif y == 0:
                guess = channels(want[at - 1])
            elif x == 0:
                guess = channels(want[at - width])
            else:
                guess = predict(modes[(y >> block) * across + (x >> block)], channels(want[at - 1]), channels(want[at - width]), channels(want[at - width + 1]), channels(want[at - width - 1]))
            want.append(packed([a + b & 255 for a, b in zip(channels(left[at]), guess, strict=True)]))
    assert argb(webp.decode(vw.file(width, height, body))[2]) == want


def signed(v):
    return v - 256 if v > 127 else v


def test_cross_colour_green_and_palette():
    rnd = vw.rng(5)
    width, height, block = 10, 6, 2
    across, down = -(-width >> block), -(-height >> block)
    elements = [rnd.getrandbits(24) | 255 << 24 for _ in range(across * down)]
    colours = [rnd.getrandbits(32) for _ in range(13)]
    index = [rnd.randrange(13) for _ in range(width * height)]
    rows = [[index[y * width + x] for x in range(width)] for y in range(height)]
    bundled = [sum(v << 4 * k for k, v in enumerate(row[at : at + 2])) for row in rows for at in range(0, width, 2)]
    deltas = [colours[0]] + [packed([a - b & 255 for a, b in zip(channels(p), channels(q), strict=True)]) for p, q in zip(colours[1:], colours, strict=False)]

    def body(out):
        out.put(1, 1), out.put(webp.CROSS_COLOUR, 2), out.put(block - 2, 3)
        vw.put_image(out, vw.literals(elements), 0, False, rnd)
        out.put(1, 1), out.put(webp.SUBTRACT_GREEN, 2)
        out.put(1, 1), out.put(webp.PALETTE, 2), out.put(12, 8)
        vw.put_image(out, vw.literals(deltas), 0, False, rnd)
        out.put(0, 1)
        vw.put_image(out, vw.literals([255 << 24 | v << 8 for v in bundled]), 0, True, rnd)

    want = []
    for at, i in enumerate(index):
        a, r, g, b = channels(colours[i])
        r, b = r + g & 255, b + g & 255
        e = channels(elements[(at // width >> block) * across + (at % width >> block)])
        r = r + (signed(e[3]) * signed(g) >> 5) & 255
        b = b + (signed(e[2]) * signed(g) >> 5) + (signed(e[1]) * signed(r) >> 5) & 255
        want.append(packed([a, r, g, b]))
    assert argb(webp.decode(vw.file(width, height, body))[2]) == want


def test_meta_prefix_groups():
    rnd = vw.rng(8)
    width, height = 8, 8
    group = [0, 1, 1, 0]  # four blocks of 4 x 4

    def body(out):
        out.put(0, 1), out.put(0, 1)
        out.put(1, 1), out.put(0, 3)
        vw.put_image(out, vw.literals([255 << 24 | g << 8 for g in group]), 0, False, rnd)
        for g in range(2):  # two groups whose codes name one colour each
            for v in (10 + g, 20 + g, 30 + g, 40 + g, 0):
                vw.put_code(out, [v], 280, rnd)

    got = argb(webp.decode(vw.file(width, height, body))[2])
    assert got == [(40 + g) << 24 | (20 + g) << 16 | (10 + g) << 8 | 30 + g for y in range(8) for x in range(8) for g in [group[(y >> 2) * 2 + (x >> 2)]]]


@pytest.mark.parametrize("raw", [b"", b"a", b"ab" * 700, bytes(range(256)) * 9, os.urandom(3000), "héé\n".encode() * 90, b"q" * (64 * webp.MAX_ROWS + 1)])
def test_round_trip(raw):
    payload = webp.padded(raw)
    shapes, samples = webp.decode_all(webp.encode(payload))
    assert len(payload) % 64 == 0 and payload and samples.tobytes() == payload


def test_broken_streams_raise():
    good = webp.encode(webp.padded(b"hello"))
    for bad in (b"", good[:20], b"RIFX" + good[4:], good[: len(good) - 12]):
        with pytest.raises((webp.WebPError, ValueError, Exception)):
            webp.decode(bad)


def test_table(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "", 0), (3, "text " * 400, 0)], "doc_id long, text string, media int")
    stored = webp.store(rows)
    got = {r["doc_id"]: r for r in webp.digests(stored).collect()}
    payload = webp.padded(b"text " * 400)
    assert got[3]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[3]["n_bytes"] == 2000
    assert got[1]["payload_bytes"] == 64 and got[1]["tail_crc32"] == zlib.crc32(bytes(64)) and got[1]["media_sha256"] == got[2]["media_sha256"]
    assert webp.digests(stored).count() == 4
    pixels = webp.read_pixels(stored).where("doc_id = 3").first()
    assert bytes(pixels["pixels"]) == payload and pixels["width"] == 16
    assert webp.digests(webp.store(rows.limit(0))).count() == 0


def test_every_path_of_the_writer_is_read_back(sf, monkeypatch):
    """Real texts and made ones go through uneven codes, back-references, the colour cache, the predictor and a palette."""
    import pyarrow.parquet as pq

    took = {"uneven": 0, "copies": 0, "cache": 0, "predictor": 0, "palette": 0, "loop": 0}
    put, undo, loop, at_once = webp.Tokens.put, webp._undo_predictor, webp._read_symbols, webp._read_at_once

    def counted(self, out, meta):
        took["copies"] += bool((self.kind == 1).any())
        took["cache"] += bool((self.kind == 2).any())
        return put(self, out, meta)

    def seen(bits, codes, *rest):
        took["uneven"] += any(c.only is None and len(set(c._sizes.tolist())) > 1 for c in codes)
        return at_once(bits, codes, *rest)

    monkeypatch.setattr(webp.Tokens, "put", counted)
    monkeypatch.setattr(webp, "_read_at_once", seen)
    monkeypatch.setattr(webp, "_undo_predictor", lambda *a: (took.__setitem__("predictor", took["predictor"] + 1), undo(*a))[1])
    monkeypatch.setattr(webp, "_read_symbols", lambda *a: (took.__setitem__("loop", took["loop"] + 1), loop(*a))[1])
    monkeypatch.setattr(webp, "encode_palette", lambda *a, f=webp.encode_palette: (took.__setitem__("palette", took["palette"] + 1), f(*a))[1])
    texts = [(t or "").encode() for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()]
    rnd = vw.rng(1)
    letters = lambda n: bytes(rnd.randrange(97, 123) for _ in range(n))
    row = bytearray(letters(64))
    fading = b"".join(bytes(row) for _ in range(300) if [row.__setitem__(rnd.randrange(64), rnd.randrange(97, 123)) for _ in range(20)])
    parts = [letters(4) for _ in range(700)]
    texts += [fading, b"".join(rnd.choice(parts) for _ in range(6000)), b"abcd" * 3 + b"wxyz" * 900]
    for raw in texts:
        payload = webp.padded(raw)
        assert webp.decode_all(webp.encode(payload))[1].tobytes() == payload
    assert took["uneven"] > 0.9 * len(texts) and took["copies"] > 20 and all(took[k] > 0 for k in ("cache", "predictor", "palette", "loop")), took


def test_reading_follows_no_bit_twice(monkeypatch):
    """Fields are packed by words, and an image's beginnings are followed four at a step: the bytes and pixels stay those of the plain way."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 19, 500)
    values = rng.integers(0, 1 << 19, 500) & (1 << sizes) - 1
    out = webp.BitWriter()
    out.put_all(values, sizes)
    whole, at = 0, 0
    for v, n in zip(values.tolist(), sizes.tolist(), strict=True):
        whole |= v << at
        at += n
    assert out.finish() == whole.to_bytes(at + 7 >> 3, "little")
    steps, real = [], memoryview

    class Counted:
        def __init__(self, x):
            self.x = real(x)

        def __getitem__(self, k):
            steps.append(k)
            return self.x[k]

    monkeypatch.setattr(webp, "memoryview", Counted, raising=False)
    payload = webp.padded(bytes(rng.integers(97, 123, 4096).tolist()))
    assert webp.decode_all(webp.encode(payload))[1].tobytes() == payload
    assert len(steps) <= len(payload) // 4 // 4 + 1
