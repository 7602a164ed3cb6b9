"""One consistent form for text that looks the same.

The form is computed on whole Arrow batches.  The UTF-8 buffer of a string array becomes one array of code points;
lookup tables then decide for every code point what it turns into (nothing, another one, or several), offsets spread
the longer ones, look-alike letters are exchanged inside the words they stand in, and marks are put in order and
composed.  No step calls Python once per row.

Ignored: width forms, composed or separate accents, characters without width, the kind of an ordinary or narrow
space, the kind of a hyphen, and letters of another script that look like the Latin letters of their word.
Kept apart: upper and lower case, missing accents, raised digits, the number of spaces, dashes that are no hyphens.
"""

from __future__ import annotations

import functools
import sys
import unicodedata as ud
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

# Letters of other scripts and the Latin letter they look like.
LOOKALIKES = (
    ("Cyrillic", "АВЕКМНОРСТУХІЈЅԌԚԜҮаесорухіјѕһԁԛԝүӏ", "ABEKMHOPCTYXIJSGQWYaecopyxijshdqwyl"),
    ("Greek", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγινορυϲϳ", "ABEZHIKMNOPTYXayivopucj"),
    ("Armenian", "ՕՍօոսհց", "OUonuhg"),
    ("Cherokee", "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTiAJEWMHYGZRWVSLCPKB"),
)
# Spaces as wide as the ordinary one or narrower, and the hyphens.
SPACES = (0x00A0, 0x2004, 0x2005, 0x2006, 0x2008, 0x2009, 0x200A, 0x202F, 0x205F)
HYPHENS = (0x2010, 0x2011, 0xFE63)
# Ranges of characters without width.
WITHOUT_WIDTH = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

_TOP = sys.maxunicode + 1


class Tables:
    """Lookup tables over all code points, made from the Unicode data of the running Python."""

    def __init__(self) -> None:
        self.width = np.ones(_TOP, np.uint8)  # how many code points come out
        self.first = np.zeros(_TOP, np.int64)  # where they start in pool
        pool: list[int] = []
        self.simple = np.arange(_TOP, dtype=np.uint32)
        self.ccc = np.zeros(_TOP, np.uint8)
        self.letter = np.zeros(_TOP, bool)
        self.latin = np.zeros(_TOP, bool)
        self.digit = np.zeros(_TOP, bool)
        compose: dict[int, int] = {}
        blocks = [range(0x0, 0x3400), range(0xA000, 0xD800), range(0xF900, 0x1F000), range(0x1F100, 0x1F200), range(0x2F800, 0x2FA20)]
        for block in blocks:
            for c in block:
                ch = chr(c)
                cat = ud.category(ch)
                if cat[0] in "LM":
                    self.letter[c] = True
                    if cat[0] == "L" and ud.name(ch, "").startswith("LATIN"):
                        self.latin[c] = True
                elif cat == "Nd":
                    self.digit[c] = True
                self.ccc[c] = ud.combining(ch)
                how = ud.decomposition(ch)
                if how.startswith(("<wide>", "<narrow>")):
                    to = ud.normalize("NFD", "".join(chr(int(x, 16)) for x in how.split()[1:]))
                else:
                    to = ud.normalize("NFD", ch)
                if to != ch:
                    self.width[c], self.first[c] = len(to), len(pool)
                    pool += map(ord, to)
                    if len(to) == 1:
                        self.simple[c] = ord(to)
                    if not how.startswith("<") and ud.normalize("NFC", ch) == ch:
                        pair = how.split()
                        if len(pair) == 2:
                            compose[int(pair[0], 16) << 21 | int(pair[1], 16)] = c
                        elif 0xAC00 <= c <= 0xD7A3:
                            t = (c - 0xAC00) % 28
                            lv = c - t
                            key = lv << 21 | 0x11A7 + t if t else ord(to[0]) << 21 | ord(to[1])
                            compose[key] = c
        for a, b in ((0x3400, 0xA000), (0x20000, 0x32000)):  # ideographs
            self.letter[a:b] = True
        for c in SPACES:
            self._to(c, ord(" "))
        for c in HYPHENS:
            self._to(c, ord("-"))
        for a, b in WITHOUT_WIDTH:
            self.width[a : b + 1] = 0
        self.pool = np.array(pool, np.uint32)
        self.multi = self.width > 1
        self.alike = np.arange(_TOP, dtype=np.uint32)
        for _, other, latin in LOOKALIKES:
            for a, b in zip(other, latin, strict=True):
                self.alike[ord(a)] = ord(b)
        keys = np.array(sorted(compose), np.int64)
        self.keys, self.made = keys, np.array([compose[k] for k in keys.tolist()], np.uint32)
        self.second = np.zeros(_TOP, bool)  # can stand second in a composition
        self.second[(keys & 0x1FFFFF)] = True
        # code points that stand for themselves, or for another single one, whatever is around them
        whole = np.zeros(_TOP, bool)
        whole[self.made] = True  # comes apart and together again, if its letter is not exchanged
        whole[self.multi] &= self.alike[self.pool[self.first[self.multi]]] == self.pool[self.first[self.multi]]
        alone = (self.alike == np.arange(_TOP)) & (self.ccc == 0) & ~self.second
        self.plain = ((self.width == 1) | whole) & alone & alone[self.simple]

    def _to(self, c: int, to: int) -> None:
        self.width[c], self.simple[c] = 1, to


@functools.cache
def tables() -> Tables:
    return Tables()


def code_points(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings end to end, and the n + 1 places where the strings start. A null is an empty string."""
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    n = len(array)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, at, data = array.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, array.offset * 8)
    raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
    raw = bytes(raw)
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:  # broken bytes: one replacement mark for each
        parts = [raw[a - offsets[0] : b - offsets[0]].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, parts)])
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    count = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=count[1:])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), count[offsets - offsets[0]]


def slices(array: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """The array in parts of at most so many bytes, or of one row, each with the row it begins at."""
    size = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < len(array):
        base = ends[at - 1] if at else 0
        z = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, array.slice(at, z - at)
        at = z


def to_arrow(cps: np.ndarray, starts: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The strings of code points as an Arrow array; null: a mask of rows that are null."""
    c = cps.astype(np.uint32, copy=False)
    data = c.tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace")
    size = np.zeros(len(c) + 1, np.int64)
    np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000), out=size[1:])
    valid = None
    if null is not None and null.any():
        valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    out = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [valid, pa.py_buffer(size[starts].tobytes()), pa.py_buffer(data)])
    return out.cast(pa.string())


def _spread(cps: np.ndarray, row: np.ndarray, src: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = t.width[cps]
    if (width == 1).all():
        return t.simple[cps], row, src
    many = np.repeat(np.arange(len(cps)), width)
    out = t.simple[cps[many]]
    first = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(width, out=first[1:])
    rank = np.arange(len(many)) - first[many]
    long = t.multi[cps[many]]
    out[long] = t.pool[t.first[cps[many[long]]] + rank[long]]
    return out, row[many], src[many]


def _alike(cps: np.ndarray, row: np.ndarray, t: Tables) -> np.ndarray:
    new = t.alike[cps]
    if (new == cps).all():
        return cps
    part = t.letter[cps] | t.digit[cps]
    start = np.ones(len(cps), bool)
    start[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
    word = np.cumsum(start) - 1
    mixed = np.bincount(word, weights=t.latin[cps], minlength=word[-1] + 1) > 0
    return np.where(part & mixed[word], new, cps)


def _order(cps: np.ndarray, row: np.ndarray, src: np.ndarray, t: Tables) -> None:
    """Canonical order of marks, in place."""
    ccc = t.ccc[cps]
    while True:
        bad = np.flatnonzero((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (row[1:] == row[:-1]))
        if not len(bad):
            return
        bad = bad[np.concatenate(([True], np.diff(bad) > 1))]
        for a in (cps, src, ccc):
            a[bad], a[bad + 1] = a[bad + 1].copy(), a[bad].copy()


def _compose(cps: np.ndarray, row: np.ndarray, src: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    while True:
        at = np.flatnonzero(t.second[cps])
        at = at[at > 0]
        if not len(at):
            return cps, row, src
        ccc = t.ccc[cps]
        base = np.where(ccc == 0, np.arange(len(cps)), 0)
        base = np.maximum.accumulate(base)[at - 1]  # the last starter before
        before = ccc[at - 1]
        ok = (row[base] == row[at]) & (ccc[base] == 0) & ((base == at - 1) | ((before > 0) & (before < ccc[at])))
        at, base = at[ok], base[ok]
        key = cps[base].astype(np.int64) << 21 | cps[at]
        i = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
        hit = t.keys[i] == key
        at, base, made = at[hit], base[hit], t.made[i[hit]]
        if not len(at):
            return cps, row, src
        gone = np.zeros(len(cps), bool)
        gone[at] = True
        ok = ~gone[base] & np.concatenate(([True], base[1:] != base[:-1]))
        at, base, made = at[ok], base[ok], made[ok]
        cps = cps.copy()
        cps[base] = made
        keep = np.ones(len(cps), bool)
        keep[at] = False
        cps, row, src = cps[keep], row[keep], src[keep]


def form_points(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The form of strings given as code points: code points, starts, and for each the place in cps it came from.

    Rows of plain code points need one lookup; the others are worked on together and put back in their places.
    """
    t = tables()
    size = np.diff(starts)
    odd = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(~t.plain[cps], out=odd[1:])
    hard = odd[starts[1:]] > odd[starts[:-1]]
    if not hard.any():
        return t.simple[cps], starts.copy(), np.arange(len(cps))
    mask = np.repeat(hard, size)
    places = np.flatnonzero(mask)
    some, at, src = _form_hard(cps[places], np.concatenate(([0], np.cumsum(size[hard]))), t)
    new = size.copy()
    new[hard] = np.diff(at)
    out_at = np.concatenate(([0], np.cumsum(new)))
    out, out_src = np.empty(out_at[-1], np.uint32), np.empty(out_at[-1], np.int64)
    into = np.repeat(hard, new)
    out[into], out_src[into] = some, places[src]
    easy = np.flatnonzero(~mask)
    out[~into], out_src[~into] = t.simple[cps[easy]], easy
    return out, out_at, out_src


def _form_hard(cps: np.ndarray, starts: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(starts) - 1
    row = np.repeat(np.arange(n), np.diff(starts))
    cps, row, src = _spread(cps, row, np.arange(len(cps)), t)
    if len(cps):
        cps = _alike(cps, row, t).copy()
        src = src.copy()
        _order(cps, row, src, t)
        cps, row, src = _compose(cps, row, src, t)
    new = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=n), out=new[1:])
    return cps, new, src


def form_array(array: pa.Array) -> pa.Array:
    """The form of every string; null stays null."""
    parts = []
    for _, some in slices(array):
        null = np.asarray(some.is_null())
        cps, starts, _ = form_points(*code_points(some))
        parts.append(to_arrow(cps, starts, null))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def form_text(text: str) -> str:
    """The form of one string."""
    return form_array(pa.array([text]))[0].as_py()


def consistent_form(text: Column) -> Column:
    """Column of the consistent form of a text column. Null gives null, the empty text an empty text; any length."""

    @F.arrow_udf("string")
    def form(a: pa.Array) -> pa.Array:
        return form_array(a)

    return form(text)


def _mixed(rows: DataFrame, key: str, value: str, within: str | None) -> DataFrame:
    """Rows (__w, __f, __v, __k) of the forms that more than one string has.

    The form is computed once for every row and kept as a hash; only rows of hashes that different strings have are
    looked at again, and get the form itself.
    """
    w = F.col(within) if within else F.lit(0)
    a = rows.select(w.alias("__w"), F.col(key).alias("__k"), F.col(value).alias("__v")).where("__k is not null and __v is not null and __w is not null")
    a = stored(a.withColumn("__h", F.xxhash64(consistent_form(F.col("__v")))), "forms")
    several = a.groupBy("__w", "__h").agg(F.min("__v").alias("lo"), F.max("__v").alias("hi")).where("lo < hi").select("__w", "__h")
    again = a.join(several, ["__w", "__h"], "left_semi").withColumn("__f", consistent_form(F.col("__v")))
    return stored(again.select("__w", "__f", "__v", "__k"), "mixed")


def look_alikes(rows: DataFrame, key: str, value: str, within: str | None = None) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of rows that look the same but whose strings differ.

    rows: key has one row each; within: only pairs that agree in this column. A null value or key never counts, an
    empty text is a text like any other, and equal strings are no pair. Other columns are ignored, so their names may
    clash with anything. An empty table gives no pairs.

    Only forms that several strings have can hold a pair. Strings are joined with strings first, then with the rows that
    hold them, so that a form repeated in many equal strings never meets itself. look_alike_classes() names the classes
    instead of the pairs.
    """
    a = _mixed(rows, key, value, within)
    forms = a.select("__w", "__f", "__v").distinct()
    pairs = forms.join(forms.select("__w", "__f", F.col("__v").alias("__v2")), ["__w", "__f"]).where("__v < __v2").drop("__f")
    left = pairs.join(a.select("__w", "__v", "__k"), ["__w", "__v"])
    both = left.join(a.select("__w", F.col("__v").alias("__v2"), F.col("__k").alias("__k2")), ["__w", "__v2"])
    return both.select(F.least("__k", "__k2").alias("id_a"), F.greatest("__k", "__k2").alias("id_b"))


def look_alike_classes(rows: DataFrame, key: str, value: str, within: str | None = None) -> DataFrame:
    """Rows (key, form, class_id, links) of the rows that look_alikes() pairs: their form, the number of the class that
    all of this form (and within) share, and in how many pairs the row is. Nothing is expanded into pairs."""
    a = _mixed(rows, key, value, within)
    by_value = a.groupBy("__w", "__f", "__v").agg(F.count(F.lit(1)).alias("n"))
    links = by_value.groupBy("__w", "__f").agg(F.sum("n").alias("all")).join(by_value, ["__w", "__f"])
    links = links.where("all > n").select("__w", "__f", "__v", (F.col("all") - F.col("n")).alias("links"))
    return a.join(links, ["__w", "__f", "__v"]).select(F.col("__k").alias(key), F.col("__f").alias("form"), F.xxhash64("__w", "__f").alias("class_id"), "links")
