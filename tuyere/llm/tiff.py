"""Media columns: TIFF images in a binary column, written and read.

Reading walks the chain of image directories of either byte order, decodes strips or tiles stored plain, as PackBits, LZW
or deflate, undoes the horizontal predictor, and emits one row per page. Writing lays bytes out as 8-bit grey pages.

Cases: a null or empty media value gives no page; a value that is no TIFF, a directory chain that loops, a size that the
stored strips or tiles do not fill, or a codec or sample format that is not known gives one row whose ``error`` says so and
whose pixels are null, never a failed job: no memory is taken for pixels before the parts that hold them are decoded, and
no part is decoded beyond its size. Pages of any size are read whole; equal values give equal rows; an empty table gives an
empty result; of the input's columns only the id and the named one are read, whatever the others are called.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuyere.llm.shared import slices

# Fixed values of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}
LZW_CLEAR, LZW_END = 256, 257


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as a count and the byte; all else as literals of at most 128 bytes."""
    values = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(values)) + 1
    starts = np.concatenate([[0], edges]) if len(values) else np.zeros(0, np.int64)
    lengths = np.diff(np.concatenate([starts, [len(values)]])) if len(values) else starts
    out, literal = bytearray(), 0

    def literals(upto: int) -> None:
        for at in range(literal, upto, 128):
            part = data[at : min(at + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(lengths >= 3).tolist():
        start, n = int(starts[k]), int(lengths[k])
        literals(start)
        for at in range(0, n, 128):
            run = min(128, n - at)
            out.append((257 - run) & 255)
            out.append(data[start])
        literal = start + n
    literals(len(data))
    return bytes(out)


def packbits_decode(data: bytes, most: int | None = None) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and (most is None or len(out) < most):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def _widths(n: int) -> np.ndarray:
    """Bits of the codes after a clear code: the width grows one code early, as the format has it."""
    place = np.arange(n)
    return 9 + (place >= 254).astype(np.int64) + (place >= 766) + (place >= 1790)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; a clear code comes before the table is full."""
    codes, widths = [LZW_CLEAR], [np.array([9])]
    table, begin, size = {}, 1, 258
    code = data[0] if data else -1
    get = table.get
    for byte in data[1:]:
        longer = code << 8 | byte
        found = get(longer)
        if found is not None:
            code = found
            continue
        codes.append(code)
        table[longer] = size
        size += 1
        if size == 4094:
            widths += [_widths(len(codes) - begin), np.array([12])]
            codes.append(LZW_CLEAR)
            table.clear()
            begin, size = len(codes), 258
        code = byte
    if data:
        codes.append(code)
    codes.append(LZW_END)
    widths.append(_widths(len(codes) - begin))
    width = np.concatenate(widths)
    bits = np.unpackbits((np.array(codes) << (16 - width)).astype(">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) < width[:, None]]).tobytes()


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Up to an end code, the end of the data, or so many bytes."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    out: list[bytes] = []
    at, done, bits = 0, 0, 8 * len(data)
    while at + 9 <= bits and (most is None or done < most):
        widths = _widths(4096)
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, bits, side="right"))
        widths, begins = widths[:n], ends[:n] - widths[:n]
        byte = begins >> 3
        window = raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]
        codes = window >> (24 - (begins & 7) - widths) & ((1 << widths) - 1)
        stops = np.flatnonzero((codes == LZW_CLEAR) | (codes == LZW_END))
        own = codes[: stops[0]].tolist() if len(stops) else codes.tolist()
        if not len(stops) and n == 4096:
            raise ValueError("LZW data without a clear code")
        table, last = list(first), b""
        for code in own:
            if code < len(table):
                entry = table[code]
            elif last and code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            out.append(entry)
            if last:
                table.append(last + entry[:1])
            last = entry
            done += len(entry)
            if most is not None and done >= most:
                break
        if not len(stops) or codes[stops[0]] == LZW_END:
            break
        at = int(ends[stops[0]])
    return b"".join(out)


def _coded(data: bytes, codec: int) -> bytes:
    return {PLAIN: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6)}[codec](data)


def _plain(data: bytes, codec: int, most: int) -> bytes:
    """The first bytes of a strip or tile, no more than it can hold."""
    if codec == PLAIN:
        return data[:most]
    if codec == PACKBITS:
        return packbits_decode(data, most)[:most]
    if codec == LZW:
        return lzw_decode(data, most)[:most]
    if codec in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    raise ValueError(f"compression {codec} is not known")


def _directory(entries: list[tuple[int, int, list[int]]], at: int, more: bool) -> bytes:
    """A little-endian image directory that starts at a position, with the values that do not fit in its entries after it."""
    entries = sorted(entries)
    head, tail = struct.pack("<H", len(entries)), b""
    after = at + 2 + 12 * len(entries) + 4
    for tag, kind, values in entries:
        raw = struct.pack(f"<{len(values)}{TYPE_CODES[kind]}", *values)
        if len(raw) <= 4:
            field = raw.ljust(4, b"\0")
        else:
            field = struct.pack("<I", after + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
        head += struct.pack("<HHI", tag, kind, len(values)) + field
    return head + struct.pack("<I", after + len(tail) if more else 0) + tail


def encode_pages(payload: bytes, width: int = 64, rows_per_page: int = 4096, rows_per_strip: int = 1024, codec: int | None = None) -> bytes:
    """A TIFF of 8-bit grey pages that holds the payload, row after row; its length is a multiple of the width.

    Without a codec, the payload's checksum chooses: LZW strips with the horizontal predictor, PackBits tiles of 64 x 64,
    or deflate strips, each for a third of all payloads whatever their length."""
    assert payload and len(payload) % width == 0
    if codec is None:
        codec = (LZW, PACKBITS, DEFLATE)[zlib.crc32(payload) % 3]
    tiled, predictor = codec == PACKBITS and width == 64, 2 if codec == LZW else 1
    out = bytearray(b"II*\0" + struct.pack("<I", 8))
    page_bytes = rows_per_page * width
    for start in range(0, len(payload), page_bytes):
        page = np.frombuffer(payload[start : start + page_bytes], np.uint8).reshape(-1, width)
        step = 64 if tiled else rows_per_strip
        parts = []
        for row in range(0, len(page), step):
            part = page[row : row + step]
            if tiled and len(part) < step:
                part = np.vstack([part, np.zeros((step - len(part), width), np.uint8)])
            if predictor == 2:
                part = np.hstack([part[:, :1], np.diff(part, axis=1)])
            parts.append(_coded(part.tobytes(), codec))
        shape = [(TILE_WIDTH, 3, [width]), (TILE_HEIGHT, 3, [64])] if tiled else [(ROWS_PER_STRIP, 4, [step])]
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [len(page)]), (BITS, 3, [8]), (COMPRESSION, 3, [codec]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor]), *shape]
        more = start + page_bytes < len(payload)
        offsets, counts = (TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)
        sizes = [len(x) for x in parts]
        whole = lambda at: _directory([*tags, (offsets, 4, at), (counts, 4, sizes)], len(out), False)
        base = len(out) + len(whole(sizes))
        places = [base + sum(sizes[:k]) for k in range(len(parts))]
        directory = bytearray(whole(places))
        if more:  # the next directory begins on a word after the data
            end = base + sum(sizes)
            struct.pack_into("<I", directory, 2 + 12 * (len(tags) + 2), end + end % 2)
        out += directory + b"".join(parts)
        if more and len(out) % 2:
            out += b"\0"
    return bytes(out)


def decode_pages(media: bytes):
    """(width, height, samples, codec, pixels) of each page; pixels row by row, samples interleaved, 8 or 16 bits a sample
    as stored (16 bits in little-endian order)."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if order is None or struct.unpack(order + "H", media[2:4])[0] != 42:
        raise ValueError("no TIFF")
    (at,), seen = struct.unpack(order + "I", media[4:8]), set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", media, at)
        tags: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", media, at + 2 + 12 * k)
            if kind not in TYPE_CODES:
                continue
            code = f"{order}{count}{TYPE_CODES[kind]}"
            place = at + 2 + 12 * k + 8
            if struct.calcsize(code) > 4:
                (place,) = struct.unpack_from(order + "I", media, place)
            tags[tag] = struct.unpack_from(code, media, place)
        yield _page(media, tags, order)
        (at,) = struct.unpack_from(order + "I", media, at + 2 + 12 * n)


def _page(media: bytes, tags: dict[int, tuple[int, ...]], order: str):
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, bits, codec = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, PLAIN)
    predictor = one(PREDICTOR, 1)
    if bits not in (8, 16) or one(SAMPLE_FORMAT, 1) not in (1, 2) or predictor not in (1, 2):
        raise ValueError(f"samples of {bits} bits, format {one(SAMPLE_FORMAT, 1)}, predictor {predictor} are not known")
    kind = np.dtype(f"{order}u{bits // 8}")
    planes = samples if one(PLANAR, 1) == 2 else 1
    each = 1 if planes > 1 else samples
    tiled = TILE_OFFSETS in tags
    across, down = (one(TILE_WIDTH, width), one(TILE_HEIGHT, height)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height) or 1)
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    if min(width, height, samples, across, down) < 1:
        raise ValueError(f"an image of {width} x {height} x {samples} in parts of {across} x {down}")
    columns, rows = -(-width // across), -(-height // down)
    if not len(offsets) == len(counts) == columns * rows * planes:
        raise ValueError(f"{len(offsets)} parts for an image of {columns} x {rows} parts in {planes} planes")
    parts = []
    for k, (start, size) in enumerate(zip(offsets, counts, strict=True)):
        y = k % (columns * rows) // columns * down
        tall = down if tiled else min(down, height - y)
        need = tall * across * each * kind.itemsize
        part = _plain(media[start : start + size], codec, need)
        if len(part) < need:
            raise ValueError(f"a part of {len(part)} bytes where {need} are due")
        parts.append(np.frombuffer(part, kind).reshape(tall, across, each))
    image = np.zeros((height, width, samples), kind)
    for k, part in enumerate(parts):
        plane, place = divmod(k, columns * rows)
        y, x = place // columns * down, place % columns * across
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        image[y : y + len(part), x : x + across, plane : plane + each] = part[: height - y, : width - x]
    return width, height, samples, codec, image.astype(kind.newbyteorder("<")).tobytes()


#: What a damaged file can raise.
DAMAGE = (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error)


def read_pages(df: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page: the id column, page (from 0), width, height, samples, codec, pixels, error. No shuffle; the pages
    of a value come one after another."""
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{media_col}`").alias("media"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def read(batches):
        import pyarrow as pa

        schema = None
        for batch in slices(batches, 200):
            schema = schema or pa.schema([("doc_id", batch.schema.field("doc_id").type), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("codec", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])
            rows = []
            for doc_id, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = 0
                try:
                    for found in decode_pages(media) if media else ():
                        rows.append((doc_id, page, *found, None))
                        page += 1
                except DAMAGE as e:
                    rows.append((doc_id, page, None, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return source.mapInArrow(read, f"doc_id {kind}, page int, width int, height int, samples int, codec int, pixels binary, error string")


def store_texts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a TIFF."""
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("body"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def store(batches):
        import pyarrow as pa

        for batch in slices(batches, 200):
            media = []
            for body in batch.column(1).to_pylist():
                media.append(encode_pages(body.ljust(max(64, -(-len(body) // 64) * 64), b"\0")))
            sizes = pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return source.mapInArrow(store, f"doc_id {kind}, n_bytes long, media binary")


def features(pixels: bytes, width: int = 64) -> str:
    """Mean, standard deviation and entropy of the samples, and a 64-bit difference hash of 8 x 9 block means."""
    values = np.frombuffer(pixels, np.uint8)
    counts = np.bincount(values, minlength=256)
    levels, n = np.arange(256), len(values)
    mean = float(counts @ levels) / n
    spread = (float(counts @ (levels - mean) ** 2) / n) ** 0.5
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    edges = np.linspace(0, n, 73).astype(np.int64)[:-1]
    total = np.add.reduceat(values, np.minimum(edges, n - 1), dtype=np.int64) / np.maximum(np.diff(np.append(edges, n)), 1)
    grid = total.reshape(8, 9)
    bits = np.packbits((grid[:, 1:] > grid[:, :-1]).ravel()).tobytes().hex()
    return f"mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f};dhash={bits}"
