"""GeoTIFF: a reader of headers and pixels and a writer of single float bands, in numpy and the standard library.

Reading takes classic TIFF in either byte order, strips or tiles, 8/16/32-bit integers and 32/64-bit floats, without
compression, LZW or deflate, with or without the horizontal predictor, interleaved or planar.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.store import Ranged

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
HEADER = "band_count int, width int, height int, crs string, resolution double, minx double, miny double, maxx double, maxy double, dtype string, nodata string"


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, code width raised one code early."""
    out, bits, n = bytearray(), 0, 0
    table: dict[bytes, int] = {}

    def put(code: int, width: int) -> None:
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
        bits &= (1 << n) - 1

    def reset() -> None:
        table.clear()
        table.update({bytes((i,)): i for i in range(256)})

    reset()
    put(256, 9)
    width, word, free = 9, b"", 258
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = free
        free += 1
        if free == 4095:
            put(256, width)
            reset()
            width, free = 9, 258
        elif free + 1 > 1 << width and width < 12:
            width += 1
        word = data[k : k + 1]
    if word:
        put(table[word], width)
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    put(257, width)
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    out, table, width, bits, n, last = [], [], 9, 0, 0, None
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    for byte in data:
        bits, n = bits << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, bits = bits >> n, bits & ((1 << n) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out.append(word)
        last = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def parse_header(data) -> dict:
    """Tags of the first directory: number to tuple or text; ``order`` is the byte order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict = {"order": order}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        size = _SIZES.get(kind, 1) * count
        where = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        raw = data[where : where + size]
        tags[tag] = raw.split(b"\0")[0].decode("latin-1") if kind == 2 else struct.unpack(f"{order}{count}{_CODES[kind]}", raw) if kind in _CODES else raw
    return tags


def describe(data) -> dict:
    """Shape, type, reference system, resolution and bounds, from the header alone."""
    t = parse_header(data)
    w, h, bands = t[256][0], t[257][0], t.get(277, (1,))[0]
    kind = {1: "uint", 2: "int", 3: "float"}[t.get(339, (1,))[0]] + str(t.get(258, (1,))[0])
    sx, sy, *_ = t.get(33550, (1.0, 1.0, 0.0))
    col, row, _, x, y, _ = t.get(33922, (0.0,) * 6)
    left, top = x - col * sx, y + row * sy
    keys = t.get(34735, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4)}
    code = codes.get(3072) or codes.get(2048)
    return {"band_count": bands, "width": w, "height": h, "crs": f"EPSG:{code}" if code else None, "resolution": sx, "minx": left, "miny": top - h * sy, "maxx": left + w * sx, "maxy": top, "dtype": kind, "nodata": t.get(42113)}


def block_size(t: dict) -> tuple[int, int]:
    """Rows and columns of a file's blocks: its tiles, or its strips."""
    return (t[323][0], t[322][0]) if 322 in t else (min(t[257][0], t.get(278, (t[257][0],))[0]), t[256][0])


def read_window(data, bands: list[int] | None = None, row0: int = 0, col0: int = 0, height: int | None = None, width: int | None = None) -> np.ndarray:
    """Array (bands, rows, columns) of a window; ``bands`` are 1-based, all if None.

    ``data`` is bytes or anything with slices of bytes. Only blocks that the window meets are read and unpacked, and of a planar
    file only those of the wanted bands.
    """
    t = parse_header(data)
    w, h, n_bands = t[256][0], t[257][0], t.get(277, (1,))[0]
    bands = list(range(1, n_bands + 1)) if bands is None else bands
    if max(bands) > n_bands:
        raise ValueError(f"it has {n_bands} bands, not {max(bands)}")
    height, width = h if height is None else height, w if width is None else width
    dtype = np.dtype(t["order"] + {1: "u", 2: "i", 3: "f"}[t.get(339, (1,))[0]] + str(t.get(258, (1,))[0] // 8))
    planar, (bh, bw) = t.get(284, (1,))[0] == 2, block_size(t)
    offsets, sizes = (t[324], t[325]) if 322 in t else (t[273], t[279])
    across, down = -(-w // bw), -(-h // bh)
    per = 1 if planar else n_bands
    unpack = {1: bytes, 5: lzw_decode, 8: zlib.decompress, 32946: zlib.decompress}[t.get(259, (1,))[0]]
    out = np.zeros((len(bands), height, width), dtype)
    if not height or not width:
        return out
    for r in range(row0 // bh, (row0 + height - 1) // bh + 1):
        for c in range(col0 // bw, (col0 + width - 1) // bw + 1):
            top, left = max(row0, r * bh), max(col0, c * bw)
            for plane in sorted({b - 1 for b in bands}) if planar else [0]:
                k = plane * across * down + r * across + c
                a = np.frombuffer(unpack(data[offsets[k] : offsets[k] + sizes[k]]), dtype)
                rows = len(a) // (bw * per)
                a = a[: rows * bw * per].reshape(rows, bw, per)
                if t.get(317, (1,))[0] == 2:
                    a = np.cumsum(a, axis=1, dtype=dtype)
                a = a[top - r * bh : row0 + height - r * bh, left - c * bw : col0 + width - c * bw]
                for i, b in enumerate(bands):
                    if not planar or b - 1 == plane:
                        out[i, top - row0 : top - row0 + len(a), left - col0 : left - col0 + a.shape[1]] = a[:, :, 0 if planar else b - 1]
    return out


def read_bands(data) -> np.ndarray:
    """All of a file: array (bands, rows, columns)."""
    return read_window(data)


def write_band(values: np.ndarray, x: float, y: float, dx: float, dy: float, epsg: int | None = 4326) -> bytes:
    """One float32 band, NaN as nodata, LZW, strips of about 8 KB; (x, y) is the upper left corner."""
    a = np.ascontiguousarray(values, "<f4")
    h, w = a.shape
    rows = max(1, 8192 // (4 * w))
    strips = [lzw_encode(a[k : k + rows].tobytes()) for k in range(0, h, rows)]
    model = 2 if epsg == 4326 else 1
    keys = (1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, 2048 if model == 2 else 3072, 0, 1, epsg or 32767)
    body, spots = bytearray(), []
    for s in strips:
        spots.append(8 + len(body))
        body += s + b"\0" * (len(s) % 2)
    tags = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (32,)), (259, 3, (5,)), (262, 3, (1,)), (273, 4, spots), (277, 3, (1,)), (278, 4, (rows,)), (279, 4, [len(s) for s in strips]), (339, 3, (3,)), (33550, 12, (dx, dy, 0.0)), (33922, 12, (0.0, 0.0, 0.0, x, y, 0.0)), (34735, 3, keys), (42113, 2, b"nan\0")]
    return _with_directory(bytes(body), tags)


def write_bands(values: np.ndarray, x: float, y: float, dx: float, dy: float, epsg: int | None = 4326) -> bytes:
    """Array (bands, rows, columns) of any integer or float type, interleaved, one deflated strip for each row of pixels."""
    a = np.ascontiguousarray(np.moveaxis(values, 0, 2))
    a = a.astype(a.dtype.newbyteorder("<"))
    h, w, n = a.shape
    strips = [zlib.compress(a[k].tobytes()) for k in range(h)]
    model = 2 if epsg == 4326 else 1
    keys = (1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, 2048 if model == 2 else 3072, 0, 1, epsg or 32767)
    spots = [8 + sum(len(s) + len(s) % 2 for s in strips[:k]) for k in range(h)]
    body = b"".join(s + b"\0" * (len(s) % 2) for s in strips)
    bits, kind = a.dtype.itemsize * 8, {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    tags = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (bits,) * n), (259, 3, (8,)), (262, 3, (2 if n >= 3 else 1,)), (273, 4, spots), (277, 3, (n,)), (278, 4, (1,)), (279, 4, [len(s) for s in strips]), (284, 3, (1,)), (339, 3, (kind,) * n), (33550, 12, (dx, dy, 0.0)), (33922, 12, (0.0, 0.0, 0.0, x, y, 0.0)), (34735, 3, keys)]
    return _with_directory(body, tags)


def _with_directory(body: bytes, tags: list[tuple]) -> bytes:
    directory, extra, base = bytearray(struct.pack("<H", len(tags))), bytearray(), 8 + len(body) + 2 + 12 * len(tags) + 4
    for tag, kind, value in tags:
        raw = bytes(value) if kind == 2 else struct.pack(f"<{len(value)}{_CODES[kind]}", *value)
        directory += struct.pack("<HHI", tag, kind, len(value))
        if len(raw) <= 4:
            directory += raw.ljust(4, b"\0")
        else:
            directory += struct.pack("<I", base + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return b"II" + struct.pack("<HI", 42, 8 + len(body)) + body + bytes(directory) + b"\0\0\0\0" + bytes(extra)


def export_geotiff(pixels: DataFrame, value: str, group: str = "boundary_id", x: float = 0.0, y: float = 0.0, step: float = 1.0, epsg: int | None = 4326) -> DataFrame:
    """(group, data): one file per raster; missing pixels are NaN."""
    kind = pixels.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["px_row"].to_numpy(), pdf["px_col"].to_numpy()
        a = np.full((r.max() + 1, c.max() + 1), np.nan, np.float32)
        a[r, c] = pdf[value].to_numpy(np.float32)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "data": [write_band(a, x, y, step, step, epsg)]})

    return pixels.select(group, "px_row", "px_col", value).groupBy(group).applyInPandas(one, f"{group} {kind}, data binary")


def source_of(files: DataFrame, data: str = "data") -> str:
    """The column that files are read from: ``path`` if there is one, by byte ranges, else their bytes."""
    return "path" if "path" in files.columns else data


def reader(value):
    """A file by its URI or its bytes."""
    return Ranged(value) if isinstance(value, str) else bytes(value)


def inspect(files: DataFrame, key: str, data: str = "data", blocks: bool = False) -> DataFrame:
    """Header rows of a table of files (key, path or bytes): no pixel is decoded, and of a path only its header is read.

    ``blocks`` adds the rows and columns of a file's blocks.
    """
    kind, source = files.schema[key].dataType.simpleString(), source_of(files, data)
    names = [x.split()[0] for x in HEADER.split(", ")] + ["block_height", "block_width"] * blocks

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d in map(reader, b[source]):
                rows.append(describe(d) | dict(zip(("block_height", "block_width"), block_size(parse_header(d)))))
            yield pd.DataFrame({key: b[key].to_numpy(), **{n: [r[n] for r in rows] for n in names}}, columns=[key, *names])

    return files.select(key, source).mapInPandas(scan, f"{key} {kind}, {HEADER}" + ", block_height int, block_width int" * blocks)


def pixels_of(files: DataFrame, key: str, bands: dict[str, int], data: str = "data") -> DataFrame:
    """Pixel rows of the chosen bands (name to 1-based number); NaN is NULL."""
    kind = files.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, d in zip(b[key], b[data]):
                a = read_bands(bytes(d)).astype(float)
                h, w = a.shape[1:]
                row, col = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({key: k, "px_row": row.astype(np.int32), "px_col": col.astype(np.int32), **{n: a[i - 1].ravel() for n, i in bands.items()}})

    out = files.select(key, data).mapInPandas(scan, f"{key} {kind}, px_row int, px_col int, " + ", ".join(f"{n} double" for n in bands))
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in bands})
