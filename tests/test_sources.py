"""Files, pages, pixels, sinks and the stream."""

import base64
import datetime as dt
import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from papyra.sources import files, images, ocr, pdf, sinks
from papyra.sources import pages as source
from papyra.streaming.verify import stream_pages, verify_stream


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def jpeg(orientation, order="<"):
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 1) + struct.pack(order + "HHIHH", 0x0112, 3, 1, orientation, 0) + struct.pack(order + "I", 0)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\0"


def test_files_are_checked_and_rendered(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 three pages")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "c.png").write_bytes(b"\x89PNG....")
    (tmp_path / "d.txt").write_bytes(b"text")
    df = files.read_files(spark, str(tmp_path))
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in df.collect()}
    assert errors == {"a.pdf": None, "b.pdf": files.NOT_A_PDF, "c.png": None, "d.txt": files.UNSUPPORTED}
    pages = files.render_pages(df, lambda content, wanted, scale: [(n, b"page%d" % n) for n in wanted], F.lit(3))
    got = {(r.path.rsplit("/", 1)[1], r.page_number, r.error) for r in pages.collect()}
    assert got == {("a.pdf", 1, None), ("a.pdf", 2, None), ("a.pdf", 3, None), ("b.pdf", None, files.NOT_A_PDF), ("c.png", 1, None), ("d.txt", None, files.UNSUPPORTED)}

    def broken(content, wanted, scale):
        raise OSError("no engine")

    failed = files.render_pages(df.where(F.col("path").endswith("a.pdf")), broken, F.lit(3)).first()
    assert failed.error == "Rendering failed: no engine"
    text = files.read_text(pages, lambda image: image.decode() if image.startswith(b"page") else 1 / 0)
    assert {r.full_text for r in text.collect()} == {"page1", "page2", "page3", ""}
    assert files.read_text(pages, None).first().full_text == ""


def test_kinds(spark):
    for content, kind in ((b"\xff\xd8\xff\xe0", "jpeg"), (b"\x89PNG", "png"), (b"RIFF....WEBP", "webp"), (b"GIF89a", "gif"), (b"", None), (b"RIFF....WAVE", None)):
        assert value(spark, files.image_kind(F.lit(content))) == kind
    assert value(spark, files.file_error(F.lit(None).cast("long"), F.lit("image/png"), F.lit("x.png"), F.lit(b"x"))) == files.EMPTY
    assert value(spark, files.file_error(F.lit(16 << 20), F.lit("image/png"), F.lit("x.png"), F.lit(b"x"))) == files.TOO_LARGE
    assert value(spark, files.data_url(F.lit("image/png"), F.lit(b"abc"))) == "data:image/png;base64,YWJj"


def test_pages(spark):
    wanted = lambda *p: F.array(*[F.lit(x) for x in p])
    assert value(spark, files.pages_to_render(F.lit(8))) == [1, 2, 3, 4, 5]
    assert value(spark, files.pages_to_render(F.lit(0))) == []
    assert value(spark, files.pages_to_render(F.lit(4), wanted(9, 3, 3, 1, 0))) == [3, 3, 1]
    assert value(spark, files.sorted_pages(F.lit(9), wanted(9, 3, 3, 1))) == [1, 3]
    assert value(spark, files.preview_page(F.lit(9), F.lit(4))) == 4
    assert files.selected_pages("all") == [] and files.selected_pages("3") == [3]
    assert value(spark, files.fitted_scale(F.lit(1000), F.lit(1000))) == 2.5
    assert value(spark, files.fitted_scale(F.lit(10000), F.lit(10000))) == pytest.approx(0.5)
    assert value(spark, files.size_is_allowed(F.lit(0), F.lit(5))) is False


def test_pixels():
    plane = np.array([[[128, 0, 255, 9]]], dtype=np.uint8)
    assert images.enhance_contrast(plane)[0, 0].tolist() == [136, 0, 255, 9]
    assert images.enhance_zone(np.array([[[250, 250, 250], [10, 10, 10], [128, 128, 128]]], dtype=np.uint8))[0, :, 0].tolist() == [255, 0, 128]
    assert images.prepare_page(np.zeros((10, 3600, 4), dtype=np.uint8)).shape == (5, 1800, 4)
    assert images.crop_zone(np.zeros((100, 10, 4), dtype=np.uint8)).shape[1] == 30
    with pytest.raises(ValueError):
        images.protect_size(0, 5)


@pytest.mark.parametrize("order", ["<", ">"])
def test_orientation(order):
    corner = np.arange(6).reshape(2, 3)
    for o in range(1, 9):
        assert images.exif_orientation(jpeg(o, order)) == o
    assert images.orient(corner, 6).tolist() == [[3, 0], [4, 1], [5, 2]] and images.orient(corner, 8).tolist() == [[2, 5], [1, 4], [0, 3]]
    assert images.orient(corner, 3).tolist() == [[5, 4, 3], [2, 1, 0]] and images.orient(corner, 5).tolist() == [[0, 3], [1, 4], [2, 5]]
    assert images.exif_orientation(b"no image") == 1 and images.upright(b"\xff\xd8\xff\xe1\0", corner).tolist() == corner.tolist()


def png(plane, filters):
    """A file of a plane, its rows filtered by the kinds given in turn."""
    h, w, c = plane.shape
    flat, out = plane.reshape(h, w * c).astype(int), b""
    for y in range(h):
        kind, line = filters[y % len(filters)], []
        for x in range(w * c):
            left, up = flat[y, x - c] if x >= c else 0, flat[y - 1, x] if y else 0
            corner = flat[y - 1, x - c] if y and x >= c else 0
            near = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
            line.append((flat[y, x] - (0, left, up, (left + up) // 2, near)[kind]) % 256)
        out += bytes([kind, *line])
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png(channels):
    plane = np.random.default_rng(channels).integers(0, 256, (11, 7, channels)).astype(np.uint8)
    got = ocr.decode_png(png(plane, (0, 1, 2, 3, 4)))
    assert (got[..., 0] == plane[..., 0]).all() and (channels < 3 or (got == plane).all()) and got.shape[2] in (3, 4)
    assert (ocr.load_image("data:image/png;base64," + base64.b64encode(png(plane, (4,))).decode()) == got).all()
    with pytest.raises(ValueError):
        ocr.load_image(b"plain")


def test_page_texts(spark):
    plane = np.full((20, 10, 3), 128, dtype=np.uint8)
    rows = [(1, bytearray(png(plane, (2,)))), (2, None), (3, bytearray(b"no image"))]
    pages = spark.createDataFrame(rows, "page_number int, image binary")
    engine = lambda p, chars: f"{p.shape[0]}x{p.shape[1]} {p[0, 0, 0]} {len(chars or '')}"
    got = {r.page_number: r for r in ocr.read_page_texts(pages, engine).collect()}
    assert (got[1].full_text, got[1].mrz_text, got[1].text_error) == ("20x10 136 37", "27x30 128 37", None)
    assert [(got[k].full_text, got[k].text_error) for k in (2, 3)] == [("", "No image."), ("", "Unable to load image.")]
    second = ocr.read_page_texts(pages, engine, primary=False).first()
    assert (second.full_text, second.mrz_text) == ("20x10 136 0", "") and ocr.read_page_texts(pages, None).first().full_text == ""


def integrated(plane, width, height):
    """A smaller plane by direct integration over pixels, for tests."""
    h, w = plane.shape[:2]
    out = np.zeros((height, width, plane.shape[2]))
    for y in range(height):
        for x in range(width):
            top, bottom, left, right = y * h / height, (y + 1) * h / height, x * w / width, (x + 1) * w / width
            total = area = 0
            for j in range(int(top), min(h, int(np.ceil(bottom)))):
                for i in range(int(left), min(w, int(np.ceil(right)))):
                    share = (min(bottom, j + 1) - max(top, j)) * (min(right, i + 1) - max(left, i))
                    total, area = total + share * plane[j, i].astype(float), area + share
            out[y, x] = total / area
    return np.clip(np.rint(out), 0, 255)


def test_resampling(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(images, "STRIP", 4)
    plane = rng.integers(0, 256, (17, 23, 3), dtype=np.uint8)
    for width, height in ((5, 4), (23, 6), (11, 17), (22, 16), (1, 1)):
        assert np.abs(images.resize(plane, width, height) - integrated(plane, width, height)).max() <= 1
    grown = images.resize(plane, 69, 51).astype(float)
    assert np.abs(grown[1::3, 1::3] - plane).max() == 0  # the middle of three lies on a pixel's centre
    between = (2 * plane[:, :-1].astype(float) + plane[:, 1:]) / 3
    assert np.abs(grown[1::3, 2:-1:3][:, : between.shape[1]] - between).max() <= 1
    assert (images.resize(plane, 23, 17) == plane).all() and (images.resize(np.full((7, 9, 4), 77, np.uint8), 100, 3) == 77).all()
    assert images.resize(plane[:1, :1], 4, 3).shape == (3, 4, 3)


def huffman(lengths):
    """Counts by length, and codes, of values that all get codes of these lengths, shortest first."""
    codes, code, last = {}, 0, 0
    for value, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        codes[value], last = (code, n), n
        code += 1
    ordered = sorted(lengths, key=lambda v: (lengths[v], v))
    return bytes([0, *(sum(n == k for n in lengths.values()) for k in range(1, 17))][1:]) + bytes(ordered), codes


def encode_jpeg(planes, sampling, quality=1, restart=0, grey=False):
    """A baseline file of planes (height, width), each at its own sampling; and the planes that its coefficients give."""
    cos = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    zigzag = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
    dc_table, dc = huffman({v: 4 for v in range(12)})
    ac_table, ac = huffman({v: 8 if v in (0, 240) or v < 128 and v % 16 < 8 else 9 for v in [0, 240, *(r * 16 + s for r in range(16) for s in range(1, 11))]})
    h, w = planes[0].shape
    most = max(x for x, _ in sampling), max(y for _, y in sampling)
    across, down = -(-w // (8 * most[0])), -(-h // (8 * most[1]))
    bits, scans, made = "", [], [np.zeros((down * v * 8, across * u * 8)) for u, v in sampling]
    padded = [np.pad(p, ((0, down * v * 8 - p.shape[0]), (0, across * u * 8 - p.shape[1])), mode="edge") for p, (u, v) in zip(planes, sampling)]

    def number(x):
        size = int(abs(x)).bit_length()
        return size, format(x if x > 0 else x + (1 << size) - 1, f"0{size}b") if size else ""

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""

    before, unit = [0] * len(planes), 0
    for my in range(down):
        for mx in range(across):
            if restart and unit and unit % restart == 0:
                scans.append(flush(bits))
                bits, before = "", [0] * len(planes)
            unit += 1
            for c, (u, v) in enumerate(sampling):
                for by in range(v):
                    for bx in range(u):
                        y, x = (my * v + by) * 8, (mx * u + bx) * 8
                        q = np.rint(cos @ (padded[c][y : y + 8, x : x + 8] - 128.0) @ cos.T / quality).astype(int)
                        made[c][y : y + 8, x : x + 8] = np.clip(np.rint(cos.T @ (q * quality) @ cos + 128), 0, 255)
                        flat = q.ravel()[zigzag]
                        size, text = number(flat[0] - before[c])
                        before[c] = flat[0]
                        bits += format(dc[size][0], f"0{dc[size][1]}b") + text
                        run = 0
                        for k in range(1, 64):
                            if not flat[k:].any():
                                bits += format(ac[0][0], f"0{ac[0][1]}b")
                                break
                            if flat[k] == 0:
                                run += 1
                                continue
                            while run > 15:
                                bits, run = bits + format(ac[240][0], f"0{ac[240][1]}b"), run - 16
                            size, text = number(flat[k])
                            key = run * 16 + size
                            bits, run = bits + format(ac[key][0], f"0{ac[key][1]}b") + text, 0
    scans.append(flush(bits))
    part = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + part(0xDB, b"\0" + bytes([quality]) * 64) + part(0xC4, b"\0" + dc_table) + part(0xC4, b"\x10" + ac_table) + (part(0xDD, struct.pack(">H", restart)) if restart else b"")
    out += part(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([i + 1, u * 16 + v, 0]) for i, (u, v) in enumerate(sampling)))
    out += part(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + b"\0?\0")
    return out + b"".join(s + (b"\xff" + bytes([0xD0 + i % 8]) if i + 1 < len(scans) else b"") for i, s in enumerate(scans)) + b"\xff\xd9", made


@pytest.mark.parametrize(("sampling", "restart", "quality"), [([(1, 1)], 0, 1), ([(1, 1)] * 3, 0, 1), ([(2, 2), (1, 1), (1, 1)], 0, 1), ([(2, 1), (1, 1), (1, 1)], 2, 7), ([(1, 1)], 3, 20)])
def test_jpeg(sampling, restart, quality):
    rng = np.random.default_rng(5)
    h, w = 37, 51
    most = max(x for x, _ in sampling), max(y for _, y in sampling)
    wave = 128 + 100 * np.sin(np.arange(h)[:, None] / 5) * np.cos(np.arange(w)[None, :] / 7)
    planes = [np.clip(wave[: -(-h * v // most[1]), : -(-w * u // most[0])] + rng.normal(0, 8, (-(-h * v // most[1]), -(-w * u // most[0]))) + 9 * i, 0, 255) for i, (u, v) in enumerate(sampling)]
    content, made = encode_jpeg(planes, sampling, quality, restart)
    got = ocr.load_image(content)
    full = [images.resize(m[: p.shape[0], : p.shape[1]].astype(np.uint8)[..., None], w, h)[..., 0].astype(float) if p.shape != (h, w) else m[:h, :w] for p, m in zip(planes, made)]
    if len(full) == 1:
        want = np.repeat(full[0][..., None], 3, axis=2)
    else:
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2), 0, 255)
    assert got.shape == (h, w, 3) and np.abs(got.astype(float) - want).max() <= 1
    if quality == 1 and len(full) == 1:
        assert np.abs(got[..., 0].astype(float) - planes[0]).max() <= 4


def test_jpeg_turned_upright_and_broken():
    plane = np.arange(64, dtype=float).reshape(8, 8) * 3
    content, _ = encode_jpeg([plane], [(1, 1)])
    head = jpeg(6)[2:-4]  # its orientation alone
    turned = ocr.load_image(b"\xff\xd8" + head + content[2:])
    assert np.abs(turned[..., 0].astype(int) - np.rot90(plane, -1)).max() <= 2
    for broken in (b"\xff\xd8\xff\xd9", content[:40], content.replace(b"\xff\xc0", b"\xff\xc2"), b"\xff\xd8\xff\xe0"):
        with pytest.raises((ValueError, IndexError, struct.error)):
            ocr.load_image(broken)


PDF_OBJECTS = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>",
    2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 3 /MediaBox [0 0 595.5 842] >>",
    3: b"<< /Type /Page /Parent 2 0 R /Rotate 90 >>",
    4: b"<< /Type /Pages /Parent 2 0 R /Kids [5 0 R 6 0 R 2 0 R] /MediaBox [0 0 100 200] >>",  # holds the root again
    5: b"<</Type/Page/CropBox[10 10 60 500]>>",
    6: b"<< /Type /Page /MediaBox [0 0 7 0 R 8] /Note (a \\) (b) c) /X <48 65> /Y null /Z [true -1.5] % so\n >>",
    7: b"300",
}
PDF_SIZES = [(1, 842.0, 595.5, 90), (2, 50.0, 190.0, 0), (3, 300.0, 8.0, 0)]


def table_pdf(objects, off=0, before=b"", prev=None):
    """A file with a cross-reference table; before: an earlier revision, whose table stands at prev."""
    out, at = before or b"%PDF-1.4\n%\xe2\xe3\n", {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    place = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, x) for n, x in at.items())
    extra = b" /Prev %d" % prev if prev else b""
    return out + b"trailer\n<< /Size 99 /Root 1 0 R%s >>\nstartxref\n%d\n%%%%EOF\n" % (extra, place + off)


def stream_pdf(objects):
    """A file whose objects stand in a compressed stream, found by a cross-reference stream with a predictor."""
    inner, heads = b"", []
    for n, body in objects.items():
        heads.append(b"%d %d" % (n, len(inner)))
        inner += body + b" "
    first = b" ".join(heads) + b" "
    packed = zlib.compress(first + inner)
    out = b"%PDF-1.5\n"
    rows = {20: (1, len(out), 0)} | {n: (2, 20, i) for i, n in enumerate(objects)}
    out += b"20 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(objects), len(first), len(packed)) + packed + b"\nendstream\nendobj\n"
    place, raw, before = len(out), b"", bytes(4)
    rows[21] = (1, place, 0)
    for n in range(22):
        row = struct.pack(">BHB", *rows.get(n, (0, 0, 0)))
        raw += b"\x02" + bytes((p - q) & 255 for p, q in zip(row, before))
        before = row
    table = zlib.compress(raw)
    out += b"21 0 obj\n<< /Type /XRef /Size 22 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> /Length %d >>\nstream\n" % len(table) + table
    return out + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % place


def scan_pdf(image, kind, w, h):
    head = b"<< /Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter /%s /Length %d >>\nstream\n" % (w, h, kind, len(image))
    page = b"<< /Type /Page /MediaBox [0 0 10 20] /Resources << /XObject << /I 4 0 R >> >> >>"
    return table_pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: page, 4: head + image + b"\nendstream"})


def test_pdf_structure(spark):
    whole = table_pdf(PDF_OBJECTS)
    revised = table_pdf({7: b"301", 3: b"<< /Type /Page /Parent 2 0 R >>"}, before=whole, prev=whole.rindex(b"xref\n", 0, whole.rindex(b"startxref")))
    later = [(1, 595.5, 842.0, 0), PDF_SIZES[1], (3, 301.0, 8.0, 0)]
    cases = [(whole, PDF_SIZES), (table_pdf(PDF_OBJECTS, off=9), PDF_SIZES), (stream_pdf(PDF_OBJECTS), PDF_SIZES), (stream_pdf(PDF_OBJECTS).replace(b"startxref", b"startxxxx"), PDF_SIZES), (revised, later)]
    cases += [(b"%PDF-1.7", None), (b"GIF89a", None), (b"", None), (None, None), (whole.replace(b"/Root", b"/Encrypt 7 0 R /Root"), None), (b"%PDF-1.4\n1 0 obj\n" + b"[" * 500, None)]
    cases += [(b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[2 0 R 2 0 R]>> endobj", None)]
    rows = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, (c, _) in enumerate(cases)], "i int, content binary")
    got = {r.i: (r.p, r.n) for r in rows.select("i", pdf.pdf_pages(F.col("content")).alias("p"), pdf.pdf_page_count(F.col("content")).alias("n")).collect()}
    for i, (_, want) in enumerate(cases):
        pages, n = got[i]
        assert ([tuple(p) for p in pages] if pages else None, n) == (want, len(want) if want else None), i


def test_pages_as_a_source(spark, tmp_path):
    plane = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    files = {"a.pdf": table_pdf(PDF_OBJECTS), "sub/b.PDF": scan_pdf(zlib.compress(plane.tobytes()), b"FlateDecode", 3, 2), "c.png": png(plane, (0,)), "broken.pdf": b"%PDF-1.4", "note.txt": b"x", "d.pdf": scan_pdf(b"\xff\xd8\xff\xe0jpeg", b"DCTDecode", 3, 2), "e.pdf": scan_pdf(b"zz", b"FlateDecode", 3, 2)}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    source.register(spark)
    pages = spark.read.format("papyra_pages").load(str(tmp_path))
    got = {(r.path.rsplit("/", 1)[-1], r.page_number): r for r in pages.collect()}
    assert set(got) == {("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3), ("b.PDF", 1), ("c.png", 1), ("broken.pdf", None), ("d.pdf", 1), ("e.pdf", 1)}
    assert [tuple(got["a.pdf", i])[1:5] for i in (1, 2, 3)] == PDF_SIZES and got["broken.pdf", None].error and got["e.pdf", 1].error and got["e.pdf", 1].width == 10
    assert (ocr.load_image(bytes(got["b.PDF", 1].image)) == plane).all() and bytes(got["c.png", 1].image) == files["c.png"] and bytes(got["d.pdf", 1].image) == b"\xff\xd8\xff\xe0jpeg"
    second = pages.where("page_number = 2")
    assert [(r.path.rsplit("/", 1)[-1], r.width) for r in second.collect()] == [("a.pdf", 50.0)]
    plan = second._jdf.queryExecution().executedPlan().toString()
    assert "page_number" in plan and "Filter (page_number" not in plan.replace("#", "").replace("isnotnull(page_number", "")
    assert pages.where("page_number > 1 and page_number <= 2 and page_number in (2, 3)").count() == 1
    assert pages.where(F.col("path") == got["c.png", 1].path).count() == 1
    reader = source.PageReader({"path": str(tmp_path)})
    kept = list(reader.pushFilters([EqualTo(("page_number",), 2), EqualTo(("width",), 1.0)]))
    assert kept == [EqualTo(("width",), 1.0)] and reader.asked.only == frozenset({2})


def test_sinks(spark):
    assert sinks.label("dateOfBirth") == "Date Of Birth" and value(spark, sinks.label_column(F.lit("dateOfBirth"))) == "Date Of Birth"
    assert value(spark, sinks.escape_html(F.lit("<a href=\"x\">'&'"))) == "&lt;a href=&quot;x&quot;&gt;&#039;&amp;&#039;"
    df = spark.createDataFrame([(1, "x", ["a", "b"], None, (1,))], "k int, firstName string, tags array<string>, none string, inner struct<v:int>")
    rows = [(r.field_ord, r.label, r.value) for r in sinks.data_table(df, "k").collect()]
    assert rows == [(0, "First Name", "x"), (1, "Tags", "a | b"), (2, "None", "Not detected"), (3, "Inner", '{"v":1}')]
    v = spark.createDataFrame([("c", "VERIFIED", "LOW", 97, "fine", [])], "case_id string, decision string, riskLevel string, score int, reason string, alerts array<string>")
    assert sinks.decision_table(v).first().score == "97%" and sinks.alert_rows(v).first().alert == sinks.NO_ALERTS
    assert json.loads(value(spark, sinks.as_json("id")))["id"] == 0


def test_stream(spark, tmp_path):
    from tests.test_travel_documents import NOW, TD3_VALID, VISA

    rows = [{"case_id": "c", "role": role, "page_number": 1, "full_text": full, "mrz_text": zone, "arrived": "2026-01-01T00:00:00Z"} for role, full, zone in (("primary", "", TD3_VALID), ("secondary", VISA, None), ("secondary", VISA, None))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "pages.json").write_text("\n".join(map(json.dumps, rows)))
    got = []
    query = verify_stream(stream_pages(spark, str(tmp_path / "in")), NOW, lambda df, n: got.extend(df.collect()), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert query.exception() is None
    assert [(v.case_id, v.revision, v.score) for v in got] == [("c", 1, 97)] and NOW == dt.date(2026, 11, 26)


def test_documents_that_arrive_apart(spark, tmp_path):
    from tests.test_travel_documents import NOW, TD3_VALID, VISA

    def page(case, role, number, hour, full="", zone=None):
        return {"case_id": case, "role": role, "page_number": number, "full_text": full, "mrz_text": zone, "arrived": f"2026-01-01T{hour:02d}:00:00Z"}

    batches = [
        [page("c", "primary", 2, 1, zone=TD3_VALID), page("d", "primary", 1, 1, zone=TD3_VALID), page("e", "secondary", 1, 1, VISA)],
        [page("c", "secondary", 1, 2, "VISA"), page("c", "primary", 1, 2, "nothing"), page("e", "primary", 1, 2, zone=TD3_VALID)],
        [page("c", "secondary", 2, 3, VISA), page("c", "primary", 2, 3, zone=TD3_VALID)],  # a better page, and one that is repeated
        [page("c", "secondary", 3, 4, VISA)],  # as good as the second, which came first
        [page("z", "secondary", 1, 20, VISA)],  # time passes
        [page("c", "secondary", 4, 2, VISA), page("z", "primary", 1, 20, zone=TD3_VALID)],  # too late for its case; z is complete
    ]
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        path = tmp_path / "in" / f"{i}.json"
        path.write_text("\n".join(map(json.dumps, rows)))
        os.utime(path, (1_700_000_000 + 60 * i,) * 2)
    got = []
    pages = stream_pages(spark, str(tmp_path / "in"), late="1 hour", files=1)
    query = verify_stream(pages, NOW, lambda df, n: got.extend(df.collect()), str(tmp_path / "state"), wait="6 hours")
    query.awaitTermination(240)
    assert query.exception() is None
    by_case = {}
    for v in got:
        by_case.setdefault(v.case_id, []).append((v.revision, v.complete, v.decision, v.score))
    assert [x[:2] for x in by_case["c"]] == [(1, True), (2, True)] and by_case["c"][1][2:] == ("VERIFIED", 97) and by_case["c"][0][3] < 97
    assert by_case["d"] == [(1, False, None, None)] and next(v for v in got if v.case_id == "d").reason == "secondary document did not arrive"
    assert by_case["e"] == [(1, True, "VERIFIED", 97)] and by_case["z"] == [(1, True, "VERIFIED", 97)]
