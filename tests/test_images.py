"""Image headers: every prefix of real headers, random bytes, and lying ones."""

import random
import struct

from auditloom.sources.images import image_facts, image_headers

PNG = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 640, 480) + b"\x08\x02"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xfe\x00\x03c\xff\xd0\xff\xff\xc0\x00\x11\x08" + struct.pack(">HH", 48, 64) + b"\x03"
LOSSY = b"RIFF\x00\x00\x00\x00WEBPVP8 \x00\x00\x00\x00\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 300 | 0x4000, 200)
LOSSLESS = b"RIFF\x00\x00\x00\x00WEBPVP8L\x00\x00\x00\x00\x2f" + struct.pack("<I", 299 | 199 << 14)
ICO = b"\x00\x00\x01\x00\x02\x00" + bytes([16, 16] + [0] * 14) + bytes([0, 0] + [0] * 14)
WHOLE = {PNG: ("png", 640, 480, []), JPEG: ("jpeg", 64, 48, []), LOSSY: ("webp", 300, 200, []), LOSSLESS: ("webp", 300, 200, []), ICO: ("ico", 256, 256, ["16x16", "256x256"]), b"GIF89a" + struct.pack("<HH", 5, 6): ("gif", 5, 6, []), b"BM" + b"\x00" * 16 + struct.pack("<ii", 7, -8): ("bmp", 7, 8, [])}


def test_headers(spark):
    rows = [(i, b, "x") for i, b in enumerate(WHOLE)] + [(90, None, "x"), (91, b"", "x"), (92, b"%PDF", "x")]
    got = {r.i: (r.format, r.width, r.height, r.sizes) for r in image_headers(spark.createDataFrame(rows, "i int, head binary, format_ string")).collect()}
    assert got == {i: w for i, w in enumerate(WHOLE.values())} | dict.fromkeys((90, 91, 92), ("unknown", None, None, []))
    assert image_headers(spark.createDataFrame([], "i int, head binary")).count() == 0


def test_cut_and_lying_headers():
    for whole, facts in WHOLE.items():
        for n in range(len(whole)):
            kind, width, height, _ = image_facts(whole[:n])
            assert kind in (facts[0], "unknown") and (width is None or (width, height) == facts[1:3] or kind == "ico")
    assert image_facts(b"\xff\xd8\xff\xe0\x00\x01" + JPEG[6:])[:2] == ("jpeg", None)
    assert image_facts(b"\x00\x00\x01\x00\xff\xff" + ICO[6:22])[3] == ["16x16"]
    assert image_facts(PNG[:16] + b"\x00" * 8) == ("png", None, None, [])
    rnd = random.Random(1)
    for start in (b"", b"\xff\xd8\xff", b"RIFF0000WEBPVP8X", b"\x00\x00\x01\x00", b"BM"):
        for _ in range(300):
            image_facts(start + rnd.randbytes(rnd.randrange(60)))
