import struct
import zlib

import numpy as np

from rowsmith.llm import images as M
from rowsmith.llm.common import Scratch
from rowsmith.llm.queries import op5_image_copies

SMALL = "/root/testdata/sf0.001"


def picture(seed, h=96, w=128):
    rng = np.random.default_rng(seed)
    px = np.full((h, w), 120.0)
    for _ in range(40):
        y, x, dy, dx = rng.integers(0, h), rng.integers(0, w), rng.integers(6, 30), rng.integers(6, 30)
        px[y : y + dy, x : x + dx] = rng.integers(0, 256)
    texture = np.repeat(np.repeat(rng.normal(0, 35, (h // 4, w // 4)), 4, 0), 4, 1)
    return np.clip(px + texture, 0, 243).astype(np.uint8)


def pgm(px):
    return b"P5\n# made\n%d %d\n255\n" % px.shape[::-1] + px.tobytes()


def png(px, kind=0, filters=(0, 1, 2, 3, 4)):
    px = px if px.ndim == 3 else px[:, :, None]
    h, w, bpp = px.shape
    flat, body = np.zeros((h + 1, (w + 1) * bpp), int), b""
    flat[1:, bpp:] = px.reshape(h, -1)
    for y in range(h):
        f = filters[y % len(filters)]
        a, b, c, x = flat[y + 1, :-bpp], flat[y, bpp:], flat[y, :-bpp], flat[y + 1, bpp:]
        p = a + b - c
        paeth = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        body += bytes([f]) + ((x - (0 * x, a, b, (a + b) // 2, paeth)[f]) & 255).astype(np.uint8).tobytes()
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_decoders():
    px = picture(1)
    assert np.array_equal(M.decode(pgm(px)), px) and np.array_equal(M.decode(png(px)), px)
    rgb = np.stack([px, px, px], 2)
    assert np.array_equal(M.decode(png(rgb, 2)), px) and np.array_equal(M.decode(b"P6 128 96 255\n" + rgb.tobytes()), px)
    assert all(M.decode(x) is None for x in (None, b"", b"P5 9 9 255\nshort", b"GIF89a", b"\x89PNG\r\n\x1a\nbad"))


def test_crops_and_edits_are_linked(spark):
    rows, truth = [], {}
    for s in range(12):
        px = picture(s)
        edited = px.copy()
        edited[10:25, 10:40] = 255
        bright = (px + 12).astype(np.uint8)
        for k, x in enumerate((px, px[8:, 12:], edited, bright, np.rot90(px).copy(), px)):
            rows.append((s * 10 + k, pgm(x) if k % 2 else png(x)))
            truth[s * 10 + k] = s
    rows += [(900, None), (901, b"no image"), (902, pgm(np.full((64, 64), 9, np.uint8))), (903, pgm(picture(50)[:10, :10])), (None, pgm(picture(60)))]
    out = {r.image_id: r for r in M.copies(spark.createDataFrame(rows, "i bigint, data binary"), "i", "data").collect()}
    assert len(out) == len(rows)
    for i, s in truth.items():
        assert out[i].component_id // 10 == s  # nothing unlike is joined
    assert sum(out[i].component_id == s * 10 for i, s in truth.items()) >= 0.9 * len(truth)
    assert all(out[s * 10 + 5].class_id == s * 10 for s in range(12))
    assert out[900].class_id is None and out[901].component_id is None and out[902].n_links == 0 and out[903].component_id == 903 and out[None].n_links == 0
    empty = spark.createDataFrame([], "i bigint, data binary")
    assert M.copies(empty, "i", "data").count() == 0


def test_hamming_tables_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, (6, 4))
    rows = []
    for i in range(30):
        for k in range(5):
            d = base[k].copy()
            if i % 3:
                d[rng.integers(4)] ^= 1 << int(rng.integers(60))
            rows.append((i, k, float(10 * k + (i % 5) * 30), float(7 * k), 1.0, 0.3, [int(x) for x in d]))
    df = spark.createDataFrame(rows, "image_id bigint, k int, x double, y double, scale double, angle double, d array<bigint>")
    assert {(r.a, r.b): r.votes for r in M.links(df).collect()} == {(a, b): 5 for a in range(30) for b in range(a + 1, 30)}


def test_pages(spark):
    out = op5_image_copies(spark, SMALL).collect()
    assert sorted(r.page_id for r in out) == sorted(r.page_id for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect())
    assert M.render(None) is None and M.render("").shape == (12, 64)


def test_as_many_corners_as_a_picture_has(spark):
    rows = []
    for s in range(12):
        px = picture(s + 100, 160, 200)
        rows += [(s * 10, pgm(px)), (s * 10 + 1, pgm(px[40:120, 50:150]))]
    out = {r.image_id: r for r in M.copies(spark.createDataFrame(rows, "i bigint, data binary"), "i", "data").collect()}
    assert all(out[i].component_id // 10 == i // 10 for i in out)
    assert sum(out[s * 10 + 1].component_id == s * 10 for s in range(12)) >= 11  # a quarter of a picture
    places, words = M.describe(picture(7, 800, 800))
    assert len(words) > M.AT_ONCE / 4 and len(places) == len(words)
    at, M.AT_ONCE = M.AT_ONCE, 7
    try:
        assert np.array_equal(M.describe(picture(7, 800, 800))[1], words)
    finally:
        M.AT_ONCE = at


def test_descriptors_are_compared_where_they_meet(spark, monkeypatch):
    rng = np.random.default_rng(9)
    bits = rng.integers(0, 2, (12, 256)).repeat(8, 0)
    for i, row in enumerate(bits):
        row[rng.choice(256, (0, 2, 9, 18, 22, 30, 60, 1)[i % 8], replace=False)] ^= 1
    d = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
    # bit n of the 256 is bit n % 64, from the lowest, of word n // 64
    low = bits.reshape(-1, 4, 64)[:, :, ::-1].reshape(-1, 256)
    alike = lambda a, b: any((low[a, 25 * k : 25 * k + 24] == low[b, 25 * k : 25 * k + 24]).all() for k in range(M.BANDS))
    want = [(a, b) for a in range(96) for b in range(a + 1, 96) if (bits[a] != bits[b]).sum() <= M.MAX_BITS and alike(a, b)]
    words = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(d)], "w bigint, d array<bigint>")
    got = [tuple(r) for r in M.near_words(words, Scratch(spark, "near", tidy=True)).collect()]
    assert len(want) > 50 and sorted(got) == want
    made, gone, put, drop = [], [], Scratch.put, Scratch.drop
    monkeypatch.setattr(Scratch, "put", lambda self, df, name: made.append((name, self.tidy)) or put(self, df, name))
    monkeypatch.setattr(Scratch, "drop", lambda self, *names: gone.extend(names) or drop(self, *names))
    px = picture(3)
    out = M.copies(spark.createDataFrame([(1, pgm(px)), (2, pgm(px[8:, 12:]))], "i bigint, data binary"), "i", "data")
    assert {r.component_id for r in out.collect()} == {1}
    assert all(tidy for _, tidy in made) and {"features", "words", "placed", "alike", "near-9"} <= {n for n, _ in made} & set(gone)
    monkeypatch.setattr(M.F, "xxhash64", lambda c: M.F.length(c) if c == "class" else M.F.lit(7).cast("long") if c == "d" else None)
    corners = spark.createDataFrame([(i, k, 9.0 * k + i, 7.0 * k, 1.0, 0.3, [int(x) for x in d[8 * k]]) for i in range(3) for k in range(6)], "image_id bigint, k int, x double, y double, scale double, angle double, d array<bigint>")
    assert {(r.a, r.b): r.votes for r in M.links(corners).collect()} == {(0, 1): 6, (0, 2): 6, (1, 2): 6}  # hashes that are all equal
