"""Bytes of the layered outputs of one image: PNG, PSD, a script of text layers and the JSON document."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Mapping, Sequence

import numpy as np

from layertext.functions import layout

PAD = 4


def png(image: np.ndarray) -> bytes:
    """[height, width, 3 or 4] of uint8."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, n = image.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image).reshape(h, w * n)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def packed(row: np.ndarray) -> bytes:
    """A row by the PackBits rule: runs of 3 to 128 equal bytes, else literals of up to 128."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    ends = np.r_[starts[1:], len(row)]
    out, plain = bytearray(), 0

    def literals(until: int) -> None:
        for i in range(plain, until, 128):
            piece = row[i : min(i + 128, until)]
            out.append(len(piece) - 1)
            out.extend(piece.tobytes())

    for start, end in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
        literals(start)
        while end - start > 1:
            n = min(end - start, 128)
            out += bytes([257 - n, int(row[start])])
            start += n
        plain = start
    literals(len(row))
    return bytes(out)


def _rows(channel: np.ndarray) -> tuple[bytes, bytes]:
    rows = [packed(r) for r in channel]
    return b"".join(struct.pack(">H", len(r)) for r in rows), b"".join(rows)


def _tagged(key: bytes, data: bytes) -> bytes:
    data += b"\0" * (-len(data) % 4)
    return b"8BIM" + key + struct.pack(">I", len(data)) + data


def _layer(name: str, top: int, left: int, image: np.ndarray | None, section: int = 0) -> tuple[bytes, bytes]:
    """Record and channel data; `section` is 1 for the head of a group and 3 for its end."""
    h, w = (0, 0) if image is None else image.shape[:2]
    channels = {i: b"\0\0" for i in (-1, 0, 1, 2)}
    if image is not None:
        planes = {-1: image[..., 3], 0: image[..., 0], 1: image[..., 1], 2: image[..., 2]}
        channels = {i: b"\0\1" + b"".join(_rows(p)) for i, p in planes.items()}
    short = name.encode("ascii", "replace")[:255]
    pascal = bytes([len(short)]) + short
    pascal += b"\0" * (-len(pascal) % 4)
    wide = name.encode("utf-16-be")
    extra = struct.pack(">II", 0, 0) + pascal + _tagged(b"luni", struct.pack(">I", len(wide) // 2) + wide)
    if section:
        extra += _tagged(b"lsct", struct.pack(">I", section))
    record = struct.pack(">iiiiH", top, left, top + h, left + w, 4) + b"".join(struct.pack(">hI", i, len(d)) for i, d in channels.items())
    record += b"8BIMnorm" + struct.pack(">BBBB", 255, 0, 8, 0) + struct.pack(">I", len(extra)) + extra
    return record, b"".join(channels.values())


def _opaque(image: np.ndarray) -> np.ndarray:
    return np.dstack([image[..., :3], np.full(image.shape[:2], 255, np.uint8)])


def psd(image: np.ndarray, regions: Sequence[Mapping], painted: np.ndarray | None = None) -> bytes:
    """A layered file: the image, the image without text if given, and a group with a layer for each region."""
    h, w = image.shape[:2]
    layers = [_layer("Original Image", 0, 0, _opaque(image))]
    if painted is not None:
        layers.append(_layer("Inpainted (Text Removed)", 0, 0, _opaque(painted)))
    if regions:
        layers.append(_layer("</Layer group>", 0, 0, None, 3))
        for i, r in enumerate(regions, 1):
            name = f"Text {i}: " + r["text"][:20].replace("\n", " ").encode("ascii", "replace").decode()
            layers.append(_layer(name, max(r["y"] - PAD, 0), max(r["x"] - PAD, 0), text_layer(r)))
        layers.append(_layer("Text Layers", 0, 0, None, 1))
    body = struct.pack(">h", len(layers)) + b"".join(a for a, _ in layers) + b"".join(b for _, b in layers)
    body += b"\0" * (len(body) % 2)
    section = struct.pack(">I", len(body)) + body + struct.pack(">I", 0)
    counts, data = zip(*[_rows(image[..., i]) for i in range(3)], strict=True)
    head = b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, h, w, 8, 3) + struct.pack(">II", 0, 0)
    return head + struct.pack(">I", len(section)) + section + b"\0\1" + b"".join(counts) + b"".join(data)


def text_layer(region: Mapping) -> np.ndarray:
    """The region's text as blocks in its colour, one a character, as no font is at hand; the rest is transparent."""
    shown = region.get("text_corrected") or region["text"]
    size = max(region["font_size"], 10)
    w, h, chars = layout.placed(shown, size, region["width"], region["height"], region["direction"] == "v", PAD)
    out = np.zeros((h, w, 4), np.uint8)
    for char, x, y in chars:
        if not char.isspace():
            out[max(y, 0) : y + size * 4 // 5, max(x, 0) : x + max(int(layout.advance(char, size)) - 1, 1)] = [*region["fg_color"], 255]
    return out


def script(regions: Sequence[Mapping]) -> str:
    """A script for the editor that puts an editable text layer for each region with text; empty if there is none."""
    layers = []
    for i, r in enumerate(regions, 1):
        shown = r.get("text_corrected") or r["text"]
        if shown.strip():
            size = max(r["font_size"], 10)
            text = shown.replace("\r\n", "\r\r").replace("\n", "\r")
            preview = shown[:20].replace("\n", " ")
            layers.append(dict(name=f"Text {i}: {preview}", text=text, size=size, x=r["x"], y=r["y"] + size * 4 // 5, vertical=r["direction"] == "v", color=list(r["fg_color"])))
    if not layers:
        return ""
    rows = ",\n".join("  " + json.dumps(x, ensure_ascii=False).replace("\u2028", "\\u2028").replace("\u2029", "\\u2029") for x in layers)
    return f"""var font = "NanumGothic";
var texts = [
{rows}
];
var doc = app.activeDocument;
for (var k = doc.layerSets.length; k-- > 0; ) if (doc.layerSets[k].name === "Text Layers") doc.layerSets[k].remove();
var target = doc.layerSets.add();
target.name = "Text Layers (Editable)";
if (doc.layers.length > 1) target.move(doc.layers[0], ElementPlacement.PLACEBEFORE);
function px(n) {{ return new UnitValue(n, "px"); }}
for (var k = 0; k < texts.length; k++) {{
  var spec = texts[k], added = target.artLayers.add(), ink = new SolidColor();
  added.kind = LayerKind.TEXT;
  added.name = spec.name;
  var item = added.textItem;
  if (spec.vertical) item.direction = Direction.VERTICAL;
  item.size = px(spec.size);
  item.position = [px(spec.x), px(spec.y)];
  item.contents = spec.text;
  try {{ item.font = font; }} catch (missing) {{}}
  ink.rgb.red = spec.color[0];
  ink.rgb.green = spec.color[1];
  ink.rgb.blue = spec.color[2];
  item.color = ink;
}}
alert(texts.length + " text layers");
"""


def document(path: str, width: int, height: int, regions: Sequence[Mapping], painted: str | None = None) -> str:
    """The JSON document, indented by 2, with every character as it is."""
    rows = dict(image_path=path, image_width=width, image_height=height, regions=list(regions), inpainted_image_path=painted)
    return json.dumps(rows, indent=2, ensure_ascii=False)
