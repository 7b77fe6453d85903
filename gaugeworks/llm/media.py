"""Media columns: bytes stored as PNG images in binary columns, read back and perceptually hashed.

A payload becomes an 8-bit grey image of ``width`` samples a row: signature, IHDR, IDAT (zlib),
IEND, each chunk with its checksum. Reading walks the chunks, tests every checksum, inflates, and
undoes the row filters in numpy. The hash holds the signs of the low frequencies of a cosine
transform of the image, averaged down to 32 x 32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import others, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8


class CorruptImage(ValueError):
    """A PNG whose structure or checksums don't hold."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int, level: int = 6) -> bytes:
    """``payload``, a positive multiple of ``width`` bytes, as a grey PNG.

    The image takes row filter Up (2) or none (0), whichever has the smaller sum of absolute
    differences, so equal payloads give equal files.
    """
    if not payload or len(payload) % width:
        raise ValueError(f"payload of {len(payload)} bytes isn't a positive multiple of {width}")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    up = rows.copy()
    up[1:] -= rows[:-1]
    plain_cost = np.abs(rows.view(np.int8).astype(np.int16)).sum(1)
    up_cost = np.abs(up.view(np.int8).astype(np.int16)).sum(1)
    use = up_cost < plain_cost
    out = np.empty((len(rows), width + 1), np.uint8)
    out[:, 0] = np.where(use, 2, 0)
    out[:, 1:] = np.where(use[:, None], up, rows)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, rows: np.ndarray, bpp: int) -> np.ndarray:
    """Undoes PNG's five row filters; runs of rows with filter none or Up go at once."""
    n, width = rows.shape
    out = np.empty_like(rows)
    above = np.zeros(width, np.uint8)
    y = 0
    while y < n:
        kind = int(kinds[y])
        if kind in (0, 2):
            end = y + 1
            while end < n and kinds[end] == 2:
                end += 1
            block = rows[y:end].copy()
            if kind == 2:
                block[0] += above
            out[y:end] = np.add.accumulate(block, axis=0, dtype=np.uint8)
            y, above = end, out[end - 1]
            continue
        if kind == 1:
            out[y] = np.add.accumulate(rows[y].reshape(-1, bpp), axis=0, dtype=np.uint8).reshape(-1)
        elif kind in (3, 4):
            line, up = [0] * bpp, [0] * bpp + above.tolist()
            for x, value in enumerate(rows[y].tolist(), bpp):
                a, b, c = line[x - bpp], up[x], up[x - bpp]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                line.append((value + guess) & 255)
            out[y] = line[bpp:]
        else:
            raise CorruptImage(f"row filter {kind}")
        above = out[y]
        y += 1
    return out


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit PNG without palette and interlace, as height x (width x channels).

    Raises CorruptImage on a wrong signature, checksum, size or order of chunks.
    """
    if media[:8] != SIGNATURE:
        raise CorruptImage("signature")
    at, head, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise CorruptImage("cut short")
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(media):
            raise CorruptImage("cut short")
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise CorruptImage(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + size
    if head is None or not ended:
        raise CorruptImage("IHDR or IEND missing")
    width, height, depth, colour, *rest = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or any(rest):
        raise CorruptImage("only 8-bit images without palette and interlace are stored here")
    raw = zlib.decompress(b"".join(data))
    if len(raw) != height * (width * channels + 1):
        raise CorruptImage("size of the image data")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * channels + 1)
    return _unfilter(lines[:, 0], lines[:, 1:], channels)


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(k)[:, None] / (2 * n))


_BASIS = _cosines(SIDE, LOW)


def _shrink(image: np.ndarray) -> np.ndarray:
    """Means over a SIDE x SIDE grid; an image with fewer rows or columns repeats them."""
    total = image.astype(np.int64)
    for axis in (0, 1):
        n = total.shape[axis]
        if n < SIDE:
            total = np.repeat(total, -(-SIDE // n), axis)
            n = total.shape[axis]
        edges = np.arange(SIDE) * n // SIDE
        total = np.add.reduceat(total, edges, axis)
    rows, cols = (np.diff(np.append(np.arange(SIDE) * n // SIDE, n)) for n in (max(image.shape[0], -(-SIDE // image.shape[0]) * image.shape[0]), max(image.shape[1], -(-SIDE // image.shape[1]) * image.shape[1])))
    return total / (rows[:, None] * cols)


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies lie above their median; bit 0, the mean, is 0."""
    low = (_BASIS @ _shrink(image) @ _BASIS.T).round(6).reshape(-1)
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def media_columns(docs: DataFrame, text: str = "text", width: int = 192, keep: list[str] | None = None) -> DataFrame:
    """Stores each text's UTF-8 bytes, padded with spaces to whole rows, as a PNG.

    Returns the columns ``keep`` (all but the text, if not given) and n_bytes, media (binary: the
    PNG), payload (binary: read back from the PNG, padding included) and phash (binary, 8 bytes).
    A column of ``docs`` with one of these names gives way. Null and empty texts are one row of spaces. Rows are handled one by one where they lie:
    nothing is shuffled, repeated rows give equal values, and the largest text bounds the memory.
    """
    made = ("n_bytes", "media", "payload", "phash")
    keep = others(docs if keep is None else docs.select(*keep), (*made, "__text", *([text] if keep is None else [])))
    source = docs.select(*keep, docs[text].cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, media, payloads, hashes = [], [], [], []
                for value in part.column(part.num_columns - 1):
                    raw = (value.as_py() or "").encode()
                    sizes.append(len(raw))
                    png = encode_png(raw.ljust(max(width, -(-len(raw) // width) * width)), width)
                    image = decode_png(png)
                    media.append(png)
                    payloads.append(image.tobytes())
                    hashes.append(cosine_hash(image))
                made = [pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (media, payloads, hashes))]
                names = names or [*part.schema.names[:-1], "n_bytes", "media", "payload", "phash"]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names)

    return source.mapInArrow(run, ", ".join(x for x in (kinds, "n_bytes long, media binary, payload binary, phash binary") if x))


def op10(spark, sf_dir: str) -> DataFrame:
    made = media_columns(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return made.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("phash")).alias("feature"),
    )
