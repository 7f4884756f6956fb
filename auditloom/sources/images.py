"""Image files from their first bytes: format, pixel size, and the sizes that an icon file holds.

Only a bounded start of each file is looked at (`HEAD` bytes; readers can cut the column there). A file is walked by
its own structure: JPEG by its segments to the frame header, WebP by its first chunk, icons by their directory.

Defined cases: null or unknown bytes are of format `unknown`. A file that ends before its size has the format and null
sizes; so has one whose header names a size of 0. A header is believed: pixels are not decoded. A JPEG segment of a
length under 2 ends the walk. An icon directory names at most as many entries as it has bytes for, and an entry of 0
means 256. Extra columns are carried. An empty table gives an empty result.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

HEAD = 1 << 16
#: JPEG markers of frame headers, and markers without a segment.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
BARE = frozenset([0x01, *range(0xD0, 0xD9)])


def _jpeg(b: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return None
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in BARE:
            at += 2
            continue
        if marker == 0xD9:
            return None
        (size,) = struct.unpack_from(">H", b, at + 2)
        if marker in FRAMES:
            return struct.unpack_from(">HH", b, at + 5)[::-1] if at + 9 <= len(b) else None
        if size < 2:
            return None
        at += 2 + size
    return None


def _webp(b: bytes) -> tuple[int, int] | None:
    kind = b[12:16]
    if kind == b"VP8 " and len(b) >= 30 and b[23:26] == b"\x9d\x01\x2a":
        w, h = struct.unpack_from("<HH", b, 26)
        return w & 0x3FFF, h & 0x3FFF
    if kind == b"VP8L" and len(b) >= 25 and b[20] == 0x2F:
        (bits,) = struct.unpack_from("<I", b, 21)
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X" and len(b) >= 30:
        return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
    return None


def image_facts(head: bytes | None) -> tuple[str, int | None, int | None, list[str]]:
    """(format, width, height, sizes of an icon's images)."""
    b = (head or b"")[:HEAD]
    size, icons, kind = None, [], "unknown"
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        kind = "png"
        size = struct.unpack_from(">II", b, 16) if len(b) >= 24 and b[12:16] == b"IHDR" else None
    elif b[:6] in (b"GIF87a", b"GIF89a"):
        kind, size = "gif", struct.unpack_from("<HH", b, 6) if len(b) >= 10 else None
    elif b[:3] == b"\xff\xd8\xff":
        kind, size = "jpeg", _jpeg(b)
    elif b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        kind, size = "webp", _webp(b)
    elif b[:2] == b"BM":
        kind, size = "bmp", tuple(map(abs, struct.unpack_from("<ii", b, 18))) if len(b) >= 26 else None
    elif b[:4] == b"\x00\x00\x01\x00":
        kind = "ico"
        count = min(struct.unpack_from("<H", b, 4)[0], (len(b) - 6) // 16) if len(b) >= 6 else 0
        pairs = [(b[6 + 16 * i] or 256, b[7 + 16 * i] or 256) for i in range(count)]
        icons = [f"{w}x{h}" for w, h in pairs]
        size = max(pairs, default=None)
    if not size or 0 in size:
        return kind, None, None, icons
    return kind, size[0], size[1], icons


def image_headers(files: DataFrame, head: str = "head") -> DataFrame:
    """`files` without the bytes of `head`, with format, width, height and sizes; files are read where they lie."""
    names = [c for c in files.columns if c != head]
    rows = files.select(*names, head).toDF(*[f"c{i}" for i in range(len(names))], "_head")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            facts = [image_facts(b) for b in batch.column(len(names)).to_pylist()]
            kind, width, height, sizes = (list(c) for c in zip(*facts, strict=True)) if facts else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(kind, pa.string()), pa.array(width, pa.int64()), pa.array(height, pa.int64()), pa.array(sizes, pa.list_(pa.string()))],
                [*batch.schema.names[:-1], "format", "width", "height", "sizes"],
            )

    return rows.mapInArrow(run, f"{fields}format string, width long, height long, sizes array<string>").toDF(*names, "format", "width", "height", "sizes")
