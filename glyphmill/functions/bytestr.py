"""Byte strings: text in which every character is one UTF-8 byte, and the scalars of the tokenizer.

A byte string keeps byte order and byte length in a string column, so string functions work on bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KINDS = ("start", "end", "mid", "letter", "whole", "delim")
START, END, MID, LETTER, WHOLE, DELIMITER = range(6)


def to_byte_string(text: Column) -> Column:
    """One character for each UTF-8 byte of the text."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def from_byte_string(bytes_: Column) -> Column:
    """The text of a byte string; bytes that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(F.encode(bytes_, "ISO-8859-1").cast("string"))


def ascii_lower(text: Column) -> Column:
    """A to Z in small letters; everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def byte_class(char: Column) -> Column:
    """'word' (letters and digits of ASCII), 'space' (blank, tab, CR, LF) or 'punct' (all else) of one character."""
    return F.when(char.rlike("^[A-Za-z0-9]$"), "word").when(char.rlike("^[ \t\r\n]$"), "space").otherwise("punct")


def number_prefix(text: Column) -> Column:
    """Length of the sign and currency mark in front of a number at the text's start: 0, 1 or 2."""
    return F.length(F.regexp_extract(text, r"^((?:[-+][$]?|[$]))(?=[0-9])", 1))


def number_prefix_at(text: Column, pos: Column) -> Column:
    """number_prefix() at a place from 0; 0 too where a letter or digit stands right before it."""
    before = F.when(pos > 0, F.substring(text, pos, F.lit(1))).otherwise("")
    return F.when(before.rlike("[A-Za-z0-9]"), 0).otherwise(number_prefix(F.substring(text, pos + 1, F.lit(3))))


def whitespace_class(run: Column) -> Column:
    """What a run of white space stands for: two line feeds, one, a blank, or a tab."""
    feeds = F.length(run) - F.length(F.replace(run, F.lit("\n"), F.lit("")))
    return F.when(feeds >= 2, "\n\n").when(feeds == 1, "\n").when(run == " ", " ").otherwise("\t")


def punctuation_class(run: Column) -> Column:
    """What a run of punctuation stands for: three or more dots, two or more dashes, or itself."""
    return F.when(run.rlike(r"^\.{3,}$"), "...").when(run.rlike("^-{2,}$"), "--").otherwise(run)


def kind_name(kind: Column) -> Column:
    """The name of a part kind; '?' for a number that is none."""
    names = F.create_map(*[F.lit(x) for k, name in enumerate(KINDS) for x in (k, name)])
    return F.coalesce(F.try_element_at(names, kind.cast("int")), F.lit("?"))


def kind_number(name: Column) -> Column:
    """The number of a part kind's name; null for a name that is none."""
    numbers = F.create_map(*[F.lit(x) for k, n in enumerate(KINDS) for x in (n, k)])
    return F.try_element_at(numbers, name)


def sparse_width(size: Column) -> Column:
    """Bits an id needs in a space of so many ids: 16 or 32."""
    return F.when(size <= 65536, 16).otherwise(32)


def escape(value: Column) -> Column:
    """Control characters and backslashes written out, as dictionary files have them."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for raw, name in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    for c in (*range(32), 127):
        if c not in (9, 10, 13):
            out = F.replace(out, F.lit(chr(c)), F.lit(f"\\x{c:02X}"))
    return out


def unescape_text(value: str) -> str:
    """The inverse of escape(); a backslash that begins no known sequence stays."""
    import re

    plain = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}

    def one(m: re.Match) -> str:
        return chr(int(m[1], 16)) if m[1] else plain[m[2]]

    return re.sub(r"\\(?:x([0-9A-Fa-f]{2})|([ntr\\]))", one, value)
