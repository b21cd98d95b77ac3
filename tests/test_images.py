import io
import json
import struct
import zlib

import numpy as np
import pytest

from glyphmill.operators import images, raster


def write_png(path, a):
    """A PNG with numpy alone; a: (height, width, 3) or (height, width)."""
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in a.astype(np.uint8))
    kind = 2 if a.ndim == 3 else 0
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def read_png(data):
    """Pixels of a heatmap: filter 0, red green blue."""
    f, out = io.BytesIO(data[8:]), {}
    while head := f.read(8):
        size, kind = struct.unpack(">I4s", head)
        body = f.read(size)
        assert struct.unpack(">I", f.read(4))[0] == zlib.crc32(kind + body)
        out[kind] = out.get(kind, b"") + body
    w, h = struct.unpack(">II", out[b"IHDR"][:8])
    rows = np.frombuffer(zlib.decompress(out[b"IDAT"]), dtype=np.uint8).reshape(h, 1 + 3 * w)  # checks the stream's adler32
    assert not rows[:, 0].any()
    return rows[:, 1:].reshape(h, w, 3)


def page(rng, h, w):
    return rng.integers(0, 256, (h, w, 3))


@pytest.fixture()
def folders(tmp_path, monkeypatch):
    monkeypatch.setattr(images, "STRIP", 5)
    monkeypatch.setattr(images, "MOST_PIXELS", 5000)
    rng = np.random.default_rng(0)
    pages = {}
    for doc, n in (("same", 2), ("changed", 3), ("wider", 1), ("longer", 2)):
        for i in range(1, n + 1):
            pages["before", doc, i] = page(rng, 13, 9)
            pages["after", doc, i] = pages["before", doc, i].copy()
    pages["after", "changed", 2][4:7, 2:5] += 100
    pages["after", "changed", 2] %= 256
    pages["after", "wider", 1] = page(rng, 11, 12)
    pages["after", "longer", 3] = page(rng, 4, 4)
    pages["before", "large", 1] = pages["after", "large", 1] = page(rng, 80, 80)
    pages["before", "alone", 1] = page(rng, 2, 2)
    pages["before", "gray", 1] = pages["after", "gray", 1] = rng.integers(0, 256, (6, 6))
    for (side, doc, i), a in pages.items():
        write_png(tmp_path / side / doc / f"p{i:02d}.png", a)
    for side in ("before", "after"):
        (tmp_path / side / "torn").mkdir()
        (tmp_path / side / "torn" / "a.png").write_bytes(b"no image")
    return tmp_path, pages


def brute(a, b):
    h, w = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])
    x, y = (np.full((h, w, 3), 255) for _ in range(2))
    x[: a.shape[0], : a.shape[1]], y[: b.shape[0], : b.shape[1]] = a, b
    d = abs(x - y)
    gray = (d[:, :, 0] * 19595 + d[:, :, 1] * 38470 + d[:, :, 2] * 7471 + 32768) // 65536
    mean = int(gray.mean() + 0.5)
    out = np.zeros((h, w, 3), dtype=int)
    for i in range(h):
        for j in range(w):
            for c in range(3):
                base = (239, 68, 68)[c] if gray[i, j] > 12 else y[i, j, c]
                strong = int(min(255, max(0, np.float32(mean) + np.float32(2.5) * np.float32(d[i, j, c] - mean))))
                out[i, j, c] = int(np.float32(base) + np.float32(0.22) * np.float32(strong - base))
    return int((gray > 12).sum()), h * w, int(d.max()), out


def test_folders_against_brute_force(spark, folders):
    at, pages = folders
    found = images.Comparison(spark, str(at / "before"), str(at / "after"))
    errors = {r.doc: r.error for r in found.errors.collect()}
    assert set(errors) == {"large", "alone", "torn"} and "pixels" in errors["large"] and "one side" in errors["alone"] and "read" in errors["torn"]
    rows = {(r.doc, r.page): r for r in found.pages.collect()}
    heat = {(r.doc, r.page): read_png(bytes(r.heatmap)) for r in found.heatmaps().collect()}
    assert len(rows) == len(heat) == 2 + 3 + 1 + 3 + 1
    for (doc, i), r in rows.items():
        white = np.full((4, 4, 3), 255)
        a, b = pages.get(("before", doc, i), white), pages.get(("after", doc, i))
        a, b = (np.repeat(x[:, :, None], 3, axis=2) if x.ndim == 2 else x for x in (a, b))
        changed, area, most, want = brute(a, b)
        assert (r.changed, r.area, r.maximum_delta) == (changed, area, most) and np.array_equal(heat[doc, i], want)
    assert {r.doc: r.passed for r in found.documents.collect()} == {"same": True, "changed": False, "wider": False, "longer": False, "gray": True}
    loose = images.Comparison(spark, str(at / "before"), str(at / "after"), tolerance=0.1)
    assert {r.doc for r in loose.documents.where("passed").collect()} == {"same", "changed", "gray"}


def test_written_reports(spark, folders, tmp_path):
    at, _ = folders
    out = images.Comparison(spark, str(at / "before"), str(at / "after")).write(str(tmp_path / "out"))
    assert {r.doc for r in out.where("error is not null").collect()} == {"large", "alone", "torn"}
    names = sorted(p.name for p in (tmp_path / "out" / "changed").iterdir())
    assert names == ["page-001-diff.png", "page-002-diff.png", "page-003-diff.png", "visual-comparison.json"]
    report = json.loads((tmp_path / "out" / "changed" / "visual-comparison.json").read_text())
    assert [p["page"] for p in report["pages"]] == [1, 2, 3] and report["pages"][1]["before_size"] == [9, 13] and not report["passed"] and report["changed_ratio"] == pytest.approx(9 / 351)


def test_ratio_is_that_of_pixel_rows(spark, folders):
    at, pages = folders
    rows = [(side, i, x, y, *map(int, a[y, x])) for (side, doc, i), a in pages.items() if doc == "wider" for y in range(a.shape[0]) for x in range(a.shape[1])]
    want = raster.page_diffs(spark.createDataFrame(rows, "side string, page long, x int, y int, r int, g int, b int")).first()
    got = images.Comparison(spark, str(at / "before"), str(at / "after")).pages.where("doc = 'wider'").first()
    assert (got.changed, got.area, got.maximum_delta) == (want.changed, want.area, want.maximum_delta)


def test_checksums_are_joined():
    rng = np.random.default_rng(1)
    for n in (0, 1, 70_000):
        a, b = rng.bytes(n), rng.bytes(100_000 - n)
        assert images.adler_joined(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


def test_bounds():
    with pytest.raises(ValueError):
        images.Comparison(None, "a", "b", threshold=256)
