"""PNG overlays, XLSX sheets and one-page PDF reports, by the standard library."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def png(rgba: np.ndarray) -> bytes:
    """8-bit PNG of an array (rows, columns, 3 or 4)."""
    h, w, n = rgba.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(rgba, np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 6 if n == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def export_png(pixels: DataFrame, group: str) -> DataFrame:
    """(group, png, overlay): PNG bytes and their base64 text, of pixel rows with r, g, b, a."""
    kind = pixels.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["px_row"].to_numpy(), pdf["px_col"].to_numpy()
        a = np.zeros((r.max() + 1, c.max() + 1, 4), np.uint8)
        a[r, c] = pdf[["r", "g", "b", "a"]].to_numpy()
        return pd.DataFrame({group: [pdf[group].iloc[0]], "png": [png(a)]})

    made = pixels.select(group, "px_row", "px_col", "r", "g", "b", "a").groupBy(group).applyInPandas(one, f"{group} {kind}, png binary")
    return made.withColumn("overlay", F.base64("png"))


def scale_colour(value: float | None, low: float | None, high: float | None) -> str | None:
    """Hex colour between (215, 48, 39) and (26, 152, 80), truncated; none if there is no range."""
    if value is None or low is None or high == low:
        return None
    t = (value - low) / (high - low)
    return "".join(f"{int(a + (b - a) * t):02X}" for a, b in zip((215, 48, 39), (26, 152, 80)))


def xlsx(rows: list[dict], title: str, scaled: str = "mean") -> bytes:
    """One sheet: header from the first row, a colour scale on one column; a placeholder if there are no rows."""
    rows = rows or [{"message": "No data available"}]
    names = list(rows[0])
    known = [r[scaled] for r in rows if scaled in r and r[scaled] is not None]
    low, high = (min(known), max(known)) if known else (None, None)
    fills: dict[str, int] = {}
    letter = lambda k: (chr(64 + k // 26) if k >= 26 else "") + chr(65 + k % 26)

    def cell(k: int, n: int, value, style: int = 0) -> str:
        at = f'r="{letter(k)}{n}"' + (f' s="{style}"' if style else "")
        if value is None or value != value:
            return f"<c {at}/>"
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f"<c {at}><v>{value!r}</v></c>"
        return f'<c {at} t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'

    lines = ['<row r="1">' + "".join(cell(k, 1, n, 1) for k, n in enumerate(names)) + "</row>"]
    for i, r in enumerate(rows, 2):
        cells = []
        for k, n in enumerate(names):
            colour = scale_colour(r.get(n), low, high) if n == scaled else None
            cells.append(cell(k, i, r.get(n), fills.setdefault(colour, len(fills) + 2) if colour else 0))
        lines.append(f'<row r="{i}">' + "".join(cells) + "</row>")
    cols = "".join(f'<col min="{k}" max="{k}" width="{max(12, len(n) + 4)}" customWidth="1"/>' for k, n in enumerate(names, 1))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    pack = "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    solid = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in fills)
    styles = f'<styleSheet {main}><fonts count="2"><font/><font><b/></font></fonts><fills count="{2 + len(fills)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{solid}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{2 + len(fills)}"><xf/><xf fontId="1" applyFont="1"/>' + "".join(f'<xf fillId="{2 + k}" applyFill="1"/>' for k in range(len(fills))) + "</cellXfs></styleSheet>"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{office}"><sheets><sheet name="{escape(title[:31])}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {main}><cols>{cols}</cols><sheetData>{''.join(lines)}</sheetData></worksheet>",
        "xl/styles.xml": styles,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def export_xlsx(statistics: DataFrame, group: str, order: str, title: str = "Plot statistics") -> DataFrame:
    """(group, data): a sheet of each group's rows, in order."""
    kind = statistics.schema[group].dataType.simpleString()
    names = [c for c in statistics.columns if c != group]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{n: None if pd.isna(v) else v for n, v in r.items()} for r in pdf.sort_values(order)[names].to_dict("records")]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "data": [xlsx(rows, title)]})

    return statistics.groupBy(group).applyInPandas(one, f"{group} {kind}, data binary")


def png_pixels(data: bytes) -> np.ndarray:
    """Array (rows, columns, channels) of an 8-bit PNG without interlace, with any row filter."""
    at, parts = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, laced = struct.unpack(">2I5B", body)
            n = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
            if depth != 8 or laced or n is None:
                raise ValueError("only plain 8-bit PNG is read")
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    for y in range(h):
        line, up = raw[y, 1:], out[y - 1] if y else np.zeros(w * n, np.uint8)
        if raw[y, 0] == 0:
            out[y] = line
        elif raw[y, 0] == 2:
            out[y] = line + up
        else:
            row = bytearray(w * n)
            for k in range(w * n):
                a, b, c = row[k - n] if k >= n else 0, int(up[k]), int(up[k - n]) if k >= n else 0
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                row[k] = (int(line[k]) + {1: a, 3: (a + b) // 2, 4: near}[int(raw[y, 0])]) & 255
            out[y] = np.frombuffer(bytes(row), np.uint8)
    return out.reshape(h, w, n)


def xlsx_rows(data: bytes) -> list[list[str | None]]:
    """Cell texts of the first sheet, row by row."""
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    sheet = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("xl/worksheets/sheet1.xml"))
    text = lambda c: next((e.text for e in c.iter() if e.tag in (f"{space}v", f"{space}t")), None)
    return [[text(c) for c in row.iter(f"{space}c")] for row in sheet.iter(f"{space}row")]


def pdf_lines(data: bytes) -> list[str]:
    """The texts that a page of ``pdf_page`` shows, in order."""
    import re

    shown = re.findall(rb"\(((?:[^()\\]|\\.)*)\) Tj", data)
    return [re.sub(rb"\\(.)", rb"\1", x).decode("latin-1") for x in shown]


def pdf_page(title: str, lines: list[str], overlay: bytes | None = None) -> bytes:
    """An A4 page of text and, below it, a PNG picture in a square of 120 mm, its alpha as a mask."""
    safe = lambda t: t.encode("latin-1", "replace").decode("latin-1").replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")
    body = f"BT /F1 18 Tf 50 780 Td ({safe(title)}) Tj /F1 11 Tf " + " ".join(f"0 -20 Td ({safe(x)}) Tj" for x in lines) + " ET"
    pictures, named = [], ""
    if overlay:
        a = png_pixels(overlay)
        h, w, n = a.shape
        side = 120 * 72 / 25.4
        by = side / max(h, w)
        body += f" q {w * by:.3f} 0 0 {h * by:.3f} 50 {760 - 20 * len(lines) - h * by:.3f} cm /Im1 Do Q"
        stream = lambda head, data: f"<< /Type /XObject /Subtype /Image /Width {w} /Height {h} /BitsPerComponent 8 /Filter /FlateDecode {head} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"
        colours = np.ascontiguousarray(a[:, :, :3] if n >= 3 else np.repeat(a[:, :, :1], 3, axis=2))
        pictures = [stream("/ColorSpace /DeviceRGB" + (" /SMask 7 0 R" if n in (2, 4) else ""), zlib.compress(colours.tobytes()))]
        if n in (2, 4):
            pictures.append(stream("/ColorSpace /DeviceGray", zlib.compress(np.ascontiguousarray(a[:, :, -1]).tobytes())))
        named = " /XObject << /Im1 6 0 R >>"
    text = body.encode("latin-1")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 5 0 R /Resources << /Font << /F1 4 0 R >>{named} >> >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", f"<< /Length {len(text)} >>\nstream\n".encode() + text + b"\nendstream", *pictures]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{k} 0 obj\n".encode() + o + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    return bytes(out + f"trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF".encode())


def export_pdf(reports: DataFrame, key: str = "boundary_id", overlay: str | None = None) -> DataFrame:
    """(key, data): a page per row of ``report_rows``; floats with three digits, other values as text; ``overlay`` names a column of PNG bytes."""
    kind = reports.schema[key].dataType.simpleString()
    names = [c for c in reports.columns if c not in (key, "name", overlay)]
    whole = {f.name for f in reports.schema.fields if isinstance(f.dataType, T.IntegralType)}

    def scan(batches):
        for b in batches:
            pages = []
            for _, r in b.iterrows():
                lines = [f"{n}: {'n/a' if pd.isna(r[n]) else int(r[n]) if n in whole else format(r[n], '.3f') if isinstance(r[n], float) else r[n]}" for n in names]
                pages.append(pdf_page(str(r["name"]), lines, bytes(r[overlay]) if overlay and r[overlay] is not None else None))
            yield pd.DataFrame({key: b[key], "data": pages})

    return reports.mapInPandas(scan, f"{key} {kind}, data binary")
