"""TIFF columns: images as bytes in a binary column, one row for each page.

read_tiff() walks the chain of image directories, decodes stored, PackBits, LZW or deflate strips and tiles, undoes the
horizontal predictor, and gives the 8-bit samples. write_tiff() is its counterpart. A file that can't be read, a page of
another depth, or one of over MOST bytes gives a row with an error and null samples; what a strip unpacks to beyond the size that
the page's tags give is never built. Null and empty media: null give no page, empty an error. Ids may be null or repeat, each row
gives its own pages; an empty table gives an empty result; only the id and the media (or text) column are read.

text_media() takes null text as empty, and a very long text as many pages.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

STORED, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, PAGE_ROWS, STRIP_ROWS = 64, 4096, 1024
MOST = 1 << 30
BROKEN = (KeyError, ValueError, IndexError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error)
KINDS = {1: "B", 2: "c", 3: "H", 4: "I"}


def unpack_bits(data: bytes, most: int = MOST) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < most:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and data[end] != data[end - 1]:
            end += 1
        out += bytes((end - at - 1,)) + data[at:end]
        at = end
    return bytes(out)


def unpack_lzw(data: bytes, most: int = MOST) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, bits, held, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        bits, held = (bits << 8 | byte) & 0xFFFFFF, held + 8
        if held < width:
            continue
        if len(out) >= most:
            break
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code > len(table) or code == len(table) and not last:
            raise ValueError("LZW code beyond the table")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    bits, held, out = 0, 0, bytearray()
    table: dict[bytes, int] = {}
    width, size = 9, 258

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    code_of = lambda s: s[0] if len(s) == 1 else table[s]
    put(256)
    word = b""
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if len(more) == 1 or more in table:
            word = more
            continue
        put(code_of(word))
        table[more] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256)
            table, size, width = {}, 258, 9
        word = data[i : i + 1]
    if word:
        put(code_of(word))
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if held:
        out.append(bits << 8 - held & 255)
    return bytes(out)


PACK = {STORED: bytes, LZW: pack_lzw, DEFLATE: lambda x: zlib.compress(x, 6), PACKBITS: pack_bits}


def unpack_deflate(data: bytes, most: int = MOST) -> bytes:
    return zlib.decompressobj().decompress(data, max(most, 1))


UNPACK = {STORED: lambda data, most: data[:most], LZW: unpack_lzw, DEFLATE: unpack_deflate, OLD_DEFLATE: unpack_deflate, PACKBITS: unpack_bits}


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None) -> bytes:
    """pages: arrays of uint8, height x width x samples. tile: its height and width, multiples of 16."""
    out, before = bytearray(b"II*\0\0\0\0\0"), 4

    def block(x: np.ndarray) -> bytes:
        if predictor == 2:
            x = np.concatenate([x[:, :1], x[:, 1:] - x[:, :-1]], axis=1)
        return PACK[compression](x.tobytes())

    for page in pages:
        height, width, samples = page.shape
        if tile:
            padded = np.pad(page, ((0, -height % tile[0]), (0, -width % tile[1]), (0, 0)))
            blocks = [block(padded[y : y + tile[0], x : x + tile[1]]) for y in range(0, height, tile[0]) for x in range(0, width, tile[1])]
        else:
            blocks = [block(page[y : y + strip_rows]) for y in range(0, height, strip_rows)]
        places = []
        for b in blocks:
            places.append(len(out))
            out += b + b"\0" * (len(b) % 2)
        tags = {256: (4, [width]), 257: (4, [height]), 258: (3, [8] * samples), 259: (3, [compression]), 262: (3, [2 if samples >= 3 else 1]), 277: (3, [samples]), 284: (3, [1]), 317: (3, [predictor])}
        tags |= {322: (4, [tile[1]]), 323: (4, [tile[0]]), 324: (4, places), 325: (4, [len(b) for b in blocks])} if tile else {273: (4, places), 278: (4, [strip_rows]), 279: (4, [len(b) for b in blocks])}
        rows = []
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"<{len(values)}{KINDS[kind]}", *values)
            if len(raw) > 4:
                rows.append(struct.pack("<HHII", tag, kind, len(values), len(out)))
                out += raw
            else:
                rows.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, before, len(out))
        out += struct.pack("<H", len(rows)) + b"".join(rows)
        before = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in (1, 3, 4):
            one = order + str(count) + KINDS[kind]
            place = at + 10 + 12 * k
            if struct.calcsize(one) > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            tags[tag] = list(struct.unpack_from(one, data, place))
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _samples(data: bytes, tags: dict[int, list[int]], most: int) -> np.ndarray:
    width, height, samples = tags[256][0], tags[257][0], tags.get(277, [1])[0]
    if not 0 < width * height * samples <= most:
        raise ValueError(f"a page of {width} x {height} x {samples} samples")
    if any(b != 8 for b in tags.get(258, [1])) or tags.get(284, [1])[0] != 1:
        raise ValueError("not chunky 8-bit samples")
    unpack = UNPACK[tags.get(259, [1])[0]]
    tiled = 324 in tags
    tall, wide = (tags[323][0], tags[322][0]) if tiled else (min(tags.get(278, [height])[0], height), width)
    across = -(-width // wide)
    if -(-height // tall) * tall * across * wide * samples > 4 * most or tags.get(317, [1])[0] not in (1, 2):
        raise ValueError("tiles beyond the page, or another predictor")
    page = np.zeros((-(-height // tall) * tall if tiled else height, across * wide, samples), np.uint8)
    for k, (place, size) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
        y, x = k // across * tall, k % across * wide
        rows = tall if tiled else min(tall, height - y)
        if rows < 1:
            raise ValueError("more strips or tiles than the page has")
        own = rows * wide * samples
        part = np.frombuffer(unpack(data[place : place + size], own)[:own], np.uint8).reshape(rows, wide, samples)
        page[y : y + rows, x : x + wide] = np.cumsum(part, axis=1, dtype=np.uint8) if tags.get(317, [1])[0] == 2 else part
    return page[:height, :width]


def read_tiff(data: bytes, most: int = MOST):
    """Yields (page number, tags, samples or None, error or None); pages of over most bytes are an error."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        yield 0, {}, None, "not a TIFF file"
        return
    seen: set[int] = set()
    try:
        (at,) = struct.unpack_from(order + "I", data, 4)
        while at:
            if at in seen:
                raise ValueError("image directories form a loop")
            seen.add(at)
            tags, at = _directory(data, at, order)
            try:
                yield len(seen) - 1, tags, _samples(data, tags, most), None
            except BROKEN as e:
                yield len(seen) - 1, tags, None, f"{type(e).__name__}: {e}"
    except BROKEN as e:
        yield len(seen), {}, None, f"{type(e).__name__}: {e}"


def _small(values: list[int] | None) -> int | None:
    """The first value, where it is a signed 32-bit number."""
    return values[0] if values and values[0] < 1 << 31 else None


def tiff_pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, page, width, height, samples_per_pixel, samples, error): one row for each page."""
    schema = "doc_id long, page int, width int, height int, samples_per_pixel int, samples binary, error string"

    def run(batches):
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1)):
                for page, tags, x, error in read_tiff(data.as_py()) if data.is_valid else ():
                    size = [x.shape[1], x.shape[0], x.shape[2]] if x is not None else [_small(tags.get(t)) for t in (256, 257, 277)]
                    yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "page", "width", "height", "samples_per_pixel", "samples", "error"), (key, page, *size, x.tobytes() if x is not None else None, error)))], schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples_per_pixel", pa.int32()), ("samples", pa.binary()), ("error", pa.string())])
    return media.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{media_col}` media").mapInArrow(run, schema)


def payload_of(text: bytes) -> bytes:
    """The bytes, filled with 0 to a positive multiple of WIDTH."""
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def store(payload: bytes) -> bytes:
    """A grey TIFF of WIDTH samples a row and PAGE_ROWS rows a page at most."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 1)
    return write_tiff([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)])


def feature_of(samples: np.ndarray, pages: int) -> str:
    """Pages, rows, mean, variance and a histogram of 16 bins, in whole numbers so that it is exact."""
    bins = np.bincount(samples.reshape(-1), minlength=256)
    n, total = samples.size, int(bins @ np.arange(256))
    mean, square = total * 1000 // n, int(bins @ np.arange(256) ** 2)
    return f"p{pages} r{n // WIDTH} m{mean} v{(square * n - total * total) * 1000 // (n * n)} h{','.join(map(str, bins.reshape(16, 16).sum(axis=1)))}"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a TIFF, reads it back page by page, and describes both. Null text counts as empty."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1):
                raw = (text.as_py() or "").encode()
                media = store(payload_of(raw))
                pages = [x for _, _, x, error in read_tiff(media)]
                samples = np.concatenate(pages)
                back = samples.tobytes()
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples, len(pages))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [f.split()[0] for f in schema.split(", ")])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, schema)


def op4_tiff_media(spark, sf_dir: str) -> DataFrame:
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
