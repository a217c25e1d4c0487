"""Column functions on texts."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The image extensions, and the ranges of right-to-left and Hangul characters.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff")
RTL_RANGES = ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF), (0x10E60, 0x10E7F), (0x1EE00, 0x1EEFF))
HANGUL_RANGES = ((0xAC00, 0xD7AF), (0x3131, 0x3163))
#: Scripts that tell a language, the more telling ones last: Han, kana and Hangul may stand in one text.
SCRIPTS = (("\\p{IsGreek}", "el"), ("\\p{IsCyrillic}", "ru"), ("\\p{IsHebrew}", "he"), ("\\p{IsArabic}", "ar"), ("\\p{IsThai}", "th"), ("\\p{IsHan}", "zh"), ("[\\p{IsHiragana}\\p{IsKatakana}]", "ja"), ("\\p{IsHangul}", "ko"))
#: Symbols of ASCII that are no punctuation in Unicode and have no value for a text either.
SYMBOLS = "$+<=>^`|~"


def ranges(pairs: Iterable[tuple[int, int]]) -> str:
    """A class of characters, as Java's and DuckDB's patterns write it."""
    return "[" + "".join(f"\\x{{{a:04X}}}" + (f"-\\x{{{b:04X}}}" if b > a else "") for a, b in pairs) + "]"


def _digits() -> list[tuple[int, int]]:
    """Runs of the characters that are digits without being decimal numbers: superscripts, circled digits and the like."""
    out: list[tuple[int, int]] = []
    for i in range(sys.maxunicode + 1):
        if chr(i).isdigit() and unicodedata.category(chr(i)) != "Nd":
            if out and out[-1][1] == i - 1:
                out[-1] = (out[-1][0], i)
            else:
                out.append((i, i))
    return out


RTL, HANGUL = ranges(RTL_RANGES), ranges(HANGUL_RANGES)
NOT_VALUABLE = "[\\p{P}\\p{Zs}\\p{Cc}\\p{Cf}\\p{Nd}" + "".join(f"\\{c}" for c in SYMBOLS) + ranges(_digits())[1:]


def natural_key(name: Column) -> Column:
    """Lower case, in which a run of digits stands after its length and without leading zeros, so that it sorts as its number
    does however long it is; every other run ends with U+0001, so that the shorter of two sorts first."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("(\\d+|\\D+)"), F.lit(1))
    number = lambda p: F.regexp_replace(p, "^0+", "")
    keyed = F.transform(parts, lambda p: F.when(p.rlike("^\\d"), F.concat(F.lpad(F.length(number(p)).cast("string"), 10, "0"), number(p))).otherwise(F.concat(p, F.lit("\x01"))))
    return F.concat(F.when(name.rlike("^\\d"), F.lit("\x01")).otherwise(F.lit("")), F.array_join(keyed, ""))


def file_name(url: Column) -> Column:
    return F.regexp_extract(url, "/([^/?]+)[^/]*$", 1)


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1)).isin(*EXTENSIONS)


def joined(texts: Column) -> Column:
    """Texts in order, with no space next to a character of U+3000..U+9FFF and one space elsewhere."""
    wide = "[\\u3000-\\u9FFF]"

    def add(acc: Column, t: Column) -> Column:
        tight = (acc == "") | acc.rlike(wide + "$") | t.rlike("^" + wide)
        return F.when(tight, F.concat(acc, t)).otherwise(F.concat_ws(" ", acc, t))

    return F.aggregate(texts, F.lit(""), add)


def js_escape(text: Column) -> Column:
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\r"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def layer_name(index: Column, text: Column) -> Column:
    """The first 20 characters, on one line, in ASCII."""
    short = F.regexp_replace(F.replace(F.substring(text, 1, 20), F.lit("\n"), F.lit(" ")), "[^\\x00-\\x7F]", "?")
    return F.concat(F.lit("Text "), index.cast("string"), F.lit(": "), short)


def valuable(text: Column) -> Column:
    return F.regexp_replace(text, NOT_VALUABLE, "")


def is_korean(text: Column, lang: Column) -> Column:
    return F.when(lang == "ko", True).when(F.coalesce(lang, F.lit("")) != "", False).otherwise(text.rlike(HANGUL))


def script_language(text: Column) -> Column:
    """A guess of the language by the script of the letters, empty where there are none; Latin letters count as English.

    It stands for a trained classifier, of which none can be had here.
    """
    out = F.when(text.rlike("[A-Za-z\\x{00C0}-\\x{024F}]"), "en").otherwise("")
    for pattern, lang in SCRIPTS:
        out = F.when(text.rlike(pattern), lang).otherwise(out)
    return out


def corrected(text: Column, lang: Column, correct: Callable[[Column, Column], Column]) -> Column:
    """Korean texts with their spacing corrected; blank ones and those of other languages as they are."""
    return F.when(is_korean(text, lang) & text.rlike("(?U)\\S"), correct(text, lang)).otherwise(text)


def shown(corrected: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(corrected, F.lit("")), text)


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most `width` characters of one advance each."""
    n = F.greatest(F.ceil(F.length(text) / width), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * width + 1, F.lit(width)))
