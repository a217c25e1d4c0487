"""Places of characters where no font can be measured: wide characters advance by the font size, others by half of it."""

from __future__ import annotations

import unicodedata


def advance(char: str, size: int) -> float:
    return size if unicodedata.east_asian_width(char) in "WF" else size / 2


def rows(text: str, size: int, width: float) -> list[str]:
    """Lines filled character by character; a character wider than the line gets a line of its own."""
    out: list[str] = []
    left = 0.0
    for char in text:
        need = advance(char, size)
        if not out or need > left:
            out.append("")
            left = width
        out[-1] += char
        left -= need
    return out


def columns(text: str, size: int, height: float) -> list[str]:
    """Columns from right to left: a new one at a line break and where the next character would pass the height."""
    out, used = [""], 0
    for char in text:
        if char == "\n" or used + size > height:
            out.append("")
            used = 0
        if char != "\n":
            out[-1] += char
            used += size + size * 15 // 100
    return out


def placed(text: str, size: int, width: int, height: int, vertical: bool, pad: int = 4) -> tuple[int, int, list[tuple[str, int, int]]]:
    """Width and height of a layer of text, and each character with its left and top in it."""
    size, width, height = max(size, 10), max(width, 20), max(height, 20)
    if vertical:
        found = columns(text, size, height)
        step = size * 13 // 10
        wide, high = max(width, len(found) * step + size) + 2 * pad, height + 2 * pad
        right = wide - pad - size
        return wide, high, [(c, right - i * step, pad + j * (size + size * 15 // 100)) for i, column in enumerate(found) for j, c in enumerate(column)]
    lines = rows(text, size, width)
    step = size * 12 // 10
    out = []
    for i, line in enumerate(lines):
        left = float(pad)
        for c in line:
            out.append((c, int(left), pad + i * step))
            left += advance(c, size)
    return width + 2 * pad, max(height, len(lines) * step) + 2 * pad, out
