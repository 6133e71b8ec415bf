"""TIFF as a media column: write byte payloads as 8-bit images, walk image directories back, one row per page."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lanework.llm import _base

#: Fixed values of the TIFF 6.0 format: tag numbers, field sizes, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, ADOBE_DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

ROW_BYTES = 192
STRIP_ROWS = 64


def unpack_bits(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


REPEATED = re.compile(rb"(.)\1{1,127}", re.S)


def pack_bits(data: bytes) -> bytes:
    """Runs of two to 128 equal bytes, and what stands between them in pieces of up to 128."""
    out, at = bytearray(), 0

    def literal(start: int, end: int) -> None:
        for i in range(start, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in REPEATED.finditer(data):
        literal(at, run.start())
        at = run.end()
        out.append(257 - (at - run.start()))
        out.append(data[run.start()])
    literal(at, len(data))
    return bytes(out)


def _lzw_width(size: int) -> int:
    """Bits of the next code: TIFF widens one code early."""
    return 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12


def unpack_lzw(data: bytes) -> bytes:
    """Most significant bit first; 256 clears the table, 257 ends."""
    bits, have, out = 0, 0, bytearray()
    table: list[bytes] = []
    before = b""
    for byte in data:
        bits = (bits << 8 | byte) & 0xFFFFFF
        have += 8
        width = _lzw_width(len(table)) if table else 9
        if have < width:
            continue
        have -= width
        code = bits >> have & ((1 << width) - 1)
        if code == 256:
            table = [bytes((i,)) for i in range(256)] + [b"", b""]
            before = b""
        elif code == 257:
            break
        else:
            if not table or code > len(table) or (code == len(table) and not before):
                raise ValueError("bad LZW code")
            word = table[code] if code < len(table) else before + before[:1]
            out += word
            if before:
                table.append(before + word[:1])
            before = word
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    bits = have = 0
    out = bytearray()

    def put(code: int, size: int) -> None:
        nonlocal bits, have
        width = _lzw_width(size)
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
            bits &= (1 << have) - 1

    fresh = lambda: {bytes((i,)): i for i in range(256)}
    table, size, word = fresh(), 258, b""
    put(256, 258)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], size - 1)
        table[longer] = size
        size += 1
        word = data[i : i + 1]
        if size == 4095:
            put(table[word], size - 1)
            put(256, size)
            table, size, word = fresh(), 258, b""
    if word:
        put(table[word], size - 1)
        size += 1
    put(257, size - 1)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


PACKERS = {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, ADOBE_DEFLATE: lambda x: zlib.compress(x, 6), OLD_DEFLATE: lambda x: zlib.compress(x, 6)}
UNPACKERS = {NONE: bytes, PACKBITS: unpack_bits, LZW: unpack_lzw, ADOBE_DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}


def difference(block: np.ndarray) -> np.ndarray:
    """Predictor 2 of (rows, columns, samples): each sample minus the one to its left."""
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def undo_difference(block: np.ndarray) -> np.ndarray:
    return np.cumsum(block, axis=1, dtype=block.dtype)


def write_pages(pages: list[np.ndarray], compression: int = ADOBE_DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: int | None = None) -> bytes:
    """Pages of uint8 (rows, columns, samples) as one little-endian TIFF, in strips or in square tiles (edges padded by zeros)."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for page in pages:
        height, width, samples = page.shape
        if tile:
            blocks = [np.zeros((tile, tile, samples), np.uint8) for _ in range(-(-height // tile) * -(-width // tile))]
            across = -(-width // tile)
            for i, block in enumerate(blocks):
                part = page[i // across * tile :, i % across * tile :][:tile, :tile]
                block[: part.shape[0], : part.shape[1]] = part
        else:
            blocks = [page[i : i + strip_rows] for i in range(0, height, strip_rows)]
        packed = [PACKERS[compression](np.ascontiguousarray(difference(x) if predictor == 2 else x).tobytes()) for x in blocks]
        offsets = []
        for x in packed:
            offsets.append(len(out))
            out += x + b"\0" * (len(x) % 2)
        counts = [len(x) for x in packed]
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_COUNTS, 4, counts)]
        entries = bytearray()
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw
                raw = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


#: Most bytes that a byte of a file can stand for (LZW, the highest: a code of 12 bits for 4 KB), and most of a page.
EXPANSION, PAGE_BYTES = 4096, 1 << 30


def directories(data: bytes) -> list[dict[int, list[int]] | str]:
    """The chain of image directories, as tag -> integers, or why one is unreadable; a loop in the chain ends it, and so does a broken link."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF")
    end = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(end + "HI", data, 2)
    if magic != 42:
        raise ValueError("not a classic TIFF")
    found, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        try:
            (n,) = struct.unpack_from(end + "H", data, at)
        except struct.error as e:
            found.append(str(e))
            break
        tags = {}
        try:
            for i in range(n):
                tag, kind, count = struct.unpack_from(end + "HHI", data, at + 2 + 12 * i)
                size = FIELD_SIZES.get(kind, 0) * count
                if kind not in (1, 3, 4):
                    continue
                place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(end + "I", data, at + 10 + 12 * i)[0]
                tags[tag] = list(struct.unpack_from(f"{end}{count}{'BxHI'[kind - 1]}", data, place))
            found.append(tags)
        except (struct.error, OverflowError, MemoryError) as e:
            found.append(str(e))
        try:
            (at,) = struct.unpack_from(end + "I", data, at + 2 + 12 * n)
        except struct.error as e:
            if isinstance(found[-1], dict):
                found.append(str(e))
            break
    if not found:
        raise ValueError("no image directory")
    return found


def read_page(data: bytes, tags: dict[int, list[int]]) -> np.ndarray:
    """Samples of one directory as uint8 (rows, columns, samples)."""
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    samples = tags.get(SAMPLES, [1])[0]
    if set(tags.get(BITS, [1])) != {8} or tags.get(PLANAR, [1])[0] != 1:
        raise ValueError("only 8-bit interleaved samples are read")
    unpack, predictor = UNPACKERS.get(tags.get(COMPRESSION, [1])[0]), tags.get(PREDICTOR, [1])[0]
    if unpack is None or predictor not in (1, 2):
        raise ValueError("unknown compression or predictor")
    if min(width, height, samples) < 1 or height * width * samples > min(PAGE_BYTES, EXPANSION * len(data)):
        raise ValueError(f"declared size {width} x {height} x {samples} is nothing, or more than the file can hold")
    page = np.zeros((height, width, samples), np.uint8)
    if TILE_OFFSETS in tags:
        down, across = tags[TILE_LENGTH][0], tags[TILE_WIDTH][0]
        if min(down, across) < 1 or down * across * samples > min(PAGE_BYTES, EXPANSION * len(data)):
            raise ValueError(f"declared tile size {across} x {down} is nothing, or more than the file can hold")
        if len(tags[TILE_OFFSETS]) != -(-width // across) * -(-height // down):
            raise ValueError("the tiles do not make up the page")
        places = [(i // -(-width // across) * down, i % -(-width // across) * across) for i in range(len(tags[TILE_OFFSETS]))]
        offsets, counts, shapes = tags[TILE_OFFSETS], tags[TILE_COUNTS], [(down, across)] * len(places)
    else:
        rows = min(tags.get(ROWS_PER_STRIP, [height])[0], height)
        if rows < 1:
            raise ValueError("strips of no rows")
        places = [(y, 0) for y in range(0, height, rows)]
        offsets, counts, shapes = tags[STRIP_OFFSETS], tags[STRIP_COUNTS], [(min(rows, height - y), width) for y, _ in places]
    for (y, x), offset, count, (h, w) in zip(places, offsets, counts, shapes, strict=True):
        raw = unpack(data[offset : offset + count])
        block = np.frombuffer(raw, np.uint8, h * w * samples).reshape(h, w, samples)
        block = undo_difference(block) if predictor == 2 else block
        page[y : y + h, x : x + w] = block[: height - y, : width - x]
    return page


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and a 16-bin histogram of all samples, as text."""
    flat = samples.reshape(-1)
    if not flat.size:
        return "0;0;" + ",".join(["0"] * 16)
    counts = np.bincount(flat, minlength=256)
    values = np.arange(256)
    mean = float((counts * values).sum()) / flat.size
    var = float((counts * values * values).sum()) / flat.size - mean * mean
    return f"{mean:.6f};{max(var, 0.0) ** 0.5:.6f};" + ",".join(map(str, counts.reshape(16, 16).sum(1).tolist()))


#: Forms that texts are stored in, by a hash of what is stored: compression, predictor, edge of square tiles (None: strips).
#: LZW, the slowest to pack, takes an eighth of them.
FORMS = ((LZW, 1, None), (LZW, 2, 64), (PACKBITS, 1, None), (PACKBITS, 2, None), (PACKBITS, 1, 64), (ADOBE_DEFLATE, 1, None), (ADOBE_DEFLATE, 2, None), (ADOBE_DEFLATE, 2, 64), *[(ADOBE_DEFLATE, 1, t) for t in (None, 64)] * 4)


def form_of(payload: bytes) -> tuple[int, int, int | None]:
    return FORMS[zlib.crc32(payload) % len(FORMS)]


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", form: tuple[int, int, int | None] | None = None) -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8 bytes, padded by blanks to a positive multiple of 192, as a one-page grey TIFF.

    form: compression, predictor and tile of all; without it each text has one of FORMS, equal texts the same. A null text
    counts as empty (one row of blanks). Rows keep their number; null ids and equal rows are ordinary rows; an empty table
    gives an empty result; further columns are not read.
    """

    def make():
        def one(batch):
            sizes, media = [], []
            for x in batch.column(1).to_pylist():
                raw = (x or "").encode()
                sizes.append(len(raw))
                payload = raw.ljust(max(ROW_BYTES, -(-len(raw) // ROW_BYTES) * ROW_BYTES), b" ")
                compression, predictor, tile = form or form_of(payload)
                media.append(write_pages([np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES, 1)], compression, predictor, tile=tile))
            return {"doc_id": batch.column(0), "n_bytes": sizes, "media": media}

        return one

    return _base.map_batches(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), make, "doc_id long, n_bytes long, media binary")


def read_pages(media: DataFrame, key: str = "doc_id", column: str = "media", carry: tuple[str, ...] = (), samples: bool = True) -> DataFrame:
    """One row per page: (key, carried columns, page, n_pages, width, height, n_samples, samples, payload_bytes, payload_sha256, tail_crc32, feature, error).

    A null or unreadable file gives one row with page null and the reason in error, an unreadable page one with its page and
    the reason. samples=False leaves the bytes out.
    """
    kept = [key, *carry]
    types = dict(media.dtypes)

    def make():
        names = ("page", "n_pages", "width", "height", "n_samples", "samples", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "error")

        errors = (ValueError, KeyError, IndexError, OverflowError, ZeroDivisionError, MemoryError, struct.error, zlib.error)

        def read(data, i, n, tags):
            try:
                if isinstance(tags, str):
                    raise ValueError(tags)
                p = read_page(data, tags)
                raw = p.tobytes()
                return i, n, p.shape[1], p.shape[0], p.shape[2], raw if samples else None, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), feature(p), None
            except errors as e:
                return (i, n, *[None] * 8, str(e))

        def one(batch):
            out: dict[str, list] = {k: [] for k in names}
            source = []
            for row, data in enumerate(batch.column(0).to_pylist()):
                try:
                    pages = directories(data or b"")
                    found = [read(data, i, len(pages), tags) for i, tags in enumerate(pages)]
                except errors as e:
                    found = [(None,) * 10 + (str(e),)]
                source += [row] * len(found)
                for values in found:
                    for name, value in zip(names, values, strict=True):
                        out[name].append(value)
            return out | {c: batch.column(1 + k).take(pa.array(source)) for k, c in enumerate(kept)}

        return one

    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", page int, n_pages int, width int, height int, n_samples int, samples binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, error string"
    return _base.map_batches(media.select(media[column], *(media[c] for c in kept)), make, schema)
