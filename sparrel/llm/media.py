"""Media columns: PNG images written and read with zlib and numpy alone, and hashes of their
low-frequency cosine transform.

Payloads become 8-bit RGB images of 64 pixels a row (192 bytes), whole and lossless, however long.
Reading tests the signature, every chunk's CRC-32 and the stream's Adler-32, and undoes all five
row filters with numpy. Nothing here is sampled or cut; equal payloads give equal bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrel.llm.common import extended, slices

ROW = 192
#: The fixed first bytes of a PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of the colour types that are read here, with 8 bits a sample.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


class MediaError(ValueError):
    """Stored bytes are no image that can be read whole."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(rows: np.ndarray, bpp: int, kinds: Iterable[int]) -> np.ndarray:
    """Every row with the filter of least summed absolute difference, its number before it."""
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, bpp:] = rows[:, :-bpp]
    up[1:] = rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, bpp:] = rows[:-1, :-bpp]
    made = []
    for k in kinds:
        if k == 0:
            made.append(rows)
        elif k == 1:
            made.append(rows - left)
        elif k == 2:
            made.append(rows - up)
        elif k == 3:
            made.append(rows - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8))
        else:
            made.append(rows - _paeth(left, up, corner))
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(1) for x in made])
    best = cost.argmin(0)
    out = np.empty((len(rows), rows.shape[1] + 1), dtype=np.uint8)
    out[:, 0] = np.array(list(kinds), dtype=np.uint8)[best]
    for i, x in enumerate(made):
        out[best == i, 1:] = x[best == i]
    return out


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a16, b16, c16 = a.astype(np.int16), b.astype(np.int16), c.astype(np.int16)
    da, db, dc = abs(b16 - c16), abs(a16 - c16), abs(a16 + b16 - 2 * c16)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def png_encode(payload: bytes, *, level: int = 6, filters: tuple[int, ...] = (0, 1, 2), part: int = 1 << 16) -> bytes:
    """A PNG of the payload, whose length must be a positive multiple of 192; the compressed
    stream is dealt out over chunks of at most `part` bytes."""
    if not payload or len(payload) % ROW:
        raise MediaError(f"payload of {len(payload)} bytes is no positive multiple of {ROW}")
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    stream = zlib.compress(_filtered(rows, 3, filters).tobytes(), level)
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    parts = [_chunk(b"IDAT", stream[i : i + part]) for i in range(0, len(stream), part)]
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(parts) + _chunk(b"IEND", b"")


def _unfiltered(kinds: np.ndarray, rows: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the filters, by runs of rows of one kind."""
    n, width = rows.shape
    out = np.empty_like(rows)
    before = np.zeros(width, dtype=np.uint8)
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, n], strict=True):
        run = rows[lo:hi]
        if kinds[lo] == 0:
            out[lo:hi] = run
        elif kinds[lo] == 1:
            out[lo:hi] = np.cumsum(run.reshape(hi - lo, -1, bpp), axis=1, dtype=np.uint8).reshape(hi - lo, width)
        elif kinds[lo] == 2:
            out[lo:hi] = np.cumsum(run, axis=0, dtype=np.uint8) + before
        elif kinds[lo] in (3, 4):
            for y in range(lo, hi):
                above = (out[y - 1] if y else before).reshape(-1, bpp)
                line, left, corner = rows[y].reshape(-1, bpp), np.zeros(bpp, np.uint8), np.zeros(bpp, np.uint8)
                made = out[y].reshape(-1, bpp)
                for x in range(len(line)):
                    if kinds[lo] == 3:
                        guess = ((left.astype(np.uint16) + above[x]) >> 1).astype(np.uint8)
                    else:
                        guess = _paeth(left, above[x], corner)
                    left = made[x] = line[x] + guess
                    corner = above[x]
        else:
            raise MediaError(f"row filter {kinds[lo]} is unknown")
        before = out[hi - 1]
    return out


def png_decode(media: bytes) -> np.ndarray:
    """Samples of shape (height, width, channels)."""
    if media[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, head, stream, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise MediaError("a chunk is cut off")
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data, end = media[at + 8 : at + 8 + size], at + 12 + size
        if end > len(media) or zlib.crc32(kind + data) != struct.unpack_from(">I", media, end - 4)[0]:
            raise MediaError(f"chunk {kind!r} is cut off or fails its checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            stream.append(data)
        elif kind == b"IEND":
            ended = True
        elif kind[:1].isupper():
            raise MediaError(f"chunk {kind!r} is unknown and critical")
        at = end
    if head is None or not ended:
        raise MediaError("header or end chunk is missing")
    width, height, depth, colour, packing, scheme, interlace = head
    if depth != 8 or colour not in CHANNELS or packing or scheme or interlace:
        raise MediaError(f"image kind {head[2:]} isn't read here")
    bpp = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(stream))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != height * (width * bpp + 1):
        raise MediaError("the image has not its stated size")
    lines = np.frombuffer(raw, dtype=np.uint8).reshape(height, width * bpp + 1)
    return _unfiltered(lines[:, 0], lines[:, 1:], bpp).reshape(height, width, bpp)


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(k)[:, None] / (2 * n))


_C = _cosines(32, 8)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits as 8 bytes: brightness, averaged to 32 x 32, through the cosine transform; a bit for
    each of the 8 x 8 lowest frequencies, set if over their median without the constant term."""
    grey = samples.mean(axis=2)
    for axis in (0, 1):
        n = grey.shape[axis]
        if n >= 32:
            cut = np.arange(32) * n // 32
            grey = np.add.reduceat(grey, cut, axis=axis) / np.expand_dims(np.diff([*cut, n]), 1 - axis)
        else:
            grey = np.take(grey, np.arange(32) * n // 32, axis=axis)
    low = _C @ grey @ _C.T
    return np.packbits(low.ravel() > np.median(low.ravel()[1:]) + 1e-9).tobytes()


def _column(batch: pa.RecordBatch, added: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    names = [n for n, _ in added]
    keep = [n for n in batch.schema.names if n not in names]
    return pa.record_batch([*(batch.column(n) for n in keep), *(x for _, x in added)], names=[*keep, *names])


def attach_png(df: DataFrame, text: str = "text", out: str = "media", *, level: int = 6) -> DataFrame:
    """Replace column `text` by the binary column `out`: the UTF-8 bytes of each whole text (null:
    none), filled with spaces up to a positive multiple of 192, as a PNG; and by `n_bytes`, their
    number before. Other columns stay; a column that has the name of a new one is replaced."""
    df = df.drop(*({out, "n_bytes"} - {text}))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            raw = [(x or "").encode() for x in batch.column(text).to_pylist()]
            media = [png_encode(x + b" " * (-len(x) % ROW or ROW * (not x)), level=level) for x in raw]
            kept = batch.drop_columns([text])
            yield _column(kept, [("n_bytes", pa.array(map(len, raw), pa.int64())), (out, pa.array(media, pa.binary()))])

    return df.mapInArrow(made, extended(df.drop(text), {"n_bytes": "long", out: "binary"}))


def read_png(df: DataFrame, media: str = "media", out: str = "payload", *, digests: bool = False) -> DataFrame:
    """Replace binary column `media` by `out`, the payload read back, and `hash`, the 8 bytes of its
    cosine hash. With digests=True, what is known by digest alone instead of the payload:
    payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes, media_sha256.
    A null image gives nulls; damaged bytes raise MediaError."""
    new = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "hash": "binary"}
    new = new if digests else {out: "binary", "hash": "binary"}
    df = df.drop(*(new.keys() - {media}))

    def one(x: bytes | None) -> tuple:
        if x is None:
            return (None,) * len(new)
        samples = png_decode(x)
        payload, mark = samples.tobytes(), cosine_hash(samples)
        if not digests:
            return payload, mark
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return len(payload), sha(payload), zlib.crc32(payload[-16:]), len(x), sha(x), mark

    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, media):
            got = list(zip(*map(one, batch.column(media).to_pylist()), strict=True))
            kept = batch.drop_columns([media])
            yield _column(kept, [(n, pa.array(x, types[new[n]])) for n, x in zip(new, got, strict=True)])

    return df.mapInArrow(made, extended(df.drop(media), new))


def media_digests(docs: DataFrame) -> DataFrame:
    """For documents (doc_id, text): the row's payload as stored and read back, by digests, with the
    hash in hexadecimal as `feature`. One row for each row, nulls and repeats included."""
    stored = attach_png(docs.select("doc_id", "text"))
    return read_png(stored, digests=True).withColumn("feature", F.lower(F.hex("hash"))).drop("hash")
