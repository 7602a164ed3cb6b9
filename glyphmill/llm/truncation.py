"""Texts cut off before their end.

One pass over the documents measures every text as different systems would have stored it (code points, UTF-8 bytes,
UTF-16 units, entity and JSON escaping, line ends converted, words) and looks at how it ends.  Grouped by source,
measure and length, a storage limit shows as a length at which far more texts end open than at the lengths around it;
a source may have had several.
A text is cut if its end is open, or if it stands at a limit of its source and its end is one that only a limit explains:
a mark left in place of the rest, a line like a signature, or a script without a mark at the sentence's end.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .lexicon import Corpus, Lexicon, consulted, corpus_of, forms_of
from .mixing import source_name
from .sentences import DOTTED, ORDINAL_BEFORE, TERM, Document, blocks, split_block
from .textform import code_points, slices

MEASURES = ("chars", "utf8", "utf16", "html", "html_ascii", "json", "json_ascii", "chars_crlf", "utf8_crlf", "html_crlf", "chars_lf", "utf8_lf", "html_lf", "words")
# Words that close a text, openings of a closing line, and what stands for a part left out.
CLOSING = frozenset("fin finis ende end the end fine das ende la fin 完 終 了 (fin) [end] (end) [fin]".split()) | {"the end", "das ende", "la fin", "el fin"}
GREETING = re.compile(r"(?:Yours|Sincerely|Regards|Best|Love|Kind regards|Cordialement|Gruß|Grüße|Atentamente|Saludos)\b[^.!?]*")
NAME = re.compile(r"[A-ZÀ-Þ][^\W\d_]*(?:\s+[A-ZÀ-Þ][^\W\d_]*){1,2}")
SIGNED = re.compile(r"(?:--?|—|–)\s*" + NAME.pattern)
ADDRESS = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\w+")
LEFT_OUT = re.compile(r"\s*(?:…|\.{3,}|\[(?:…|\.{3})\]|\((?:…|\.{3})\))$")
BROKEN = re.compile(r"(?:&#?\w{0,8}|<[^<>\s]{0,20}|\\u?[0-9a-fA-F]{0,4}|�+)$")
GAP = re.compile(r"\n[ \t\r]*\n")
CLOSERS = "\"”“»«›’'」』)]"

OPEN, LEFT, SOFT, CLOSED = 3, 2, 1, 0


@functools.cache
def weights() -> np.ndarray:
    """Units each code point takes, a row for each measure that is a plain sum."""
    c = np.arange(0x110000)
    utf8 = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    utf16 = 1 + (c >= 0x10000)
    entity = np.ones(len(c), int)
    for ch, n in (("&", 5), ("<", 4), (">", 4), ('"', 6), ("'", 6)):
        entity[ord(ch)] = n
    escaped = np.ones(len(c), int)
    escaped[:32] = 6
    for ch in '"\\\n\r\t\b\f':
        escaped[ord(ch)] = 2
    plain = c < 0x80
    digits = np.floor(np.log10(np.maximum(c, 1))).astype(int) + 1
    numbered = np.where(plain, entity, digits + 3)
    uescaped = np.where(plain, escaped, 6 * utf16)
    return np.stack([np.ones(len(c), int), utf8, utf16, entity, numbered, escaped, uescaped]).astype(np.uint8)


BLANK = np.zeros(0x110000, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of the values of each text, empty ones too."""
    out = np.zeros(len(starts) - 1, np.int64)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        out[some] = np.add.reduceat(values, starts[some], dtype=np.int64)
    return out


def lengths(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row for each measure, a column for each text."""
    sums = [np.diff(starts), *(_sums(w[cps], starts) for w in weights()[1:])]
    first = np.zeros(len(cps) + 1, bool)
    first[starts] = True  # of a text, or of the next one
    feed = cps == 10
    pair = np.zeros(len(cps), bool)
    pair[1:] = feed[1:] & (cps[:-1] == 13) & ~first[1:-1]
    feeds, pairs = _sums(feed, starts), _sums(pair, starts)
    blank = BLANK[cps]
    word = ~blank
    word[1:] &= blank[:-1] | first[1:-1]
    crlf, lf = (sums[0], sums[1], sums[3]), feeds - pairs
    return np.vstack([*sums, *(x + lf for x in crlf), *(x - pairs for x in crlf), _sums(word, starts)])


def ending(form: str, lexicon: Lexicon | None = None) -> int:
    """How a text in the consistent form ends: OPEN, LEFT (a mark stands for the rest), SOFT or CLOSED."""
    if not form.strip():
        return CLOSED
    if BROKEN.search(form.rstrip("\r\n ")[-24:]) and not re.search(r"&#?\w+;$", form):
        return OPEN
    last, begin = None, 0
    for gap in GAP.finditer(form, 0, len(form.rstrip())):  # nothing before a blank line changes what follows it
        begin = gap.end()
    for last in blocks(form[begin:]):
        pass
    if last is None or last[0] != "text":
        return CLOSED
    a, b = last[1] + begin, last[2] + begin
    whole = form[a:b].strip()
    tail = form[b:].strip()
    if tail:  # a rule line ends the text
        return CLOSED
    one = "\n" not in whole and "\r" not in whole
    if one and (whole.lower() in CLOSING or ADDRESS.fullmatch(whole)):
        return CLOSED
    if one and (GREETING.fullmatch(whole) or SIGNED.fullmatch(whole)):
        return CLOSED
    if one and NAME.fullmatch(whole):
        return SOFT
    doc = Document(form, lexicon or Lexicon())
    s, e, opened = split_block(form, a, b, doc, True)[-1]
    unit = form[s:e]
    cut = LEFT_OUT.search(unit)
    rest = unit[: cut.start()] if cut else unit
    if cut and not rest:
        return LEFT
    if opened:
        return LEFT if cut else OPEN
    bare = rest.rstrip(CLOSERS + " ")
    state = OPEN
    if bare and bare[-1] in TERM:
        state = CLOSED
        if bare[-1] == "." and rest[-1] == ".":
            tok = re.split(r"[\s\"“”„«»()\[\]]", bare[:-1])[-1]
            words = unit.split()
            if doc.never_last(tok) or (len(tok) == 1 and tok.isalpha()) or (DOTTED.fullmatch(tok) and tok.islower() and not doc.known(tok)):
                state = OPEN
            elif tok.endswith(".") or (tok.isdigit() and len(tok) < 4 and len(words) == 2 and words[0].lower() in ORDINAL_BEFORE):
                state = OPEN  # two of three dots, or a day without its month
            elif len(words) < 4 or "@" in tok or "://" in tok:
                state = SOFT
        elif rest[-1] in CLOSERS and unit[0] in "\"“„«「『":
            state = SOFT  # a quotation whose speaker is still to come
    elif not bare and rest:
        state = CLOSED
    elif bare and "฀" <= bare[-1] <= "๿":
        return SOFT
    return LEFT if cut and state != CLOSED else state


def profiles(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", corpus: Corpus | None = None) -> DataFrame:
    """Rows (k, s, h, state, len) of each document: source name, hash of the text, how it ends, its lengths."""
    kinds = (("k", docs.schema[key].dataType), ("s", T.StringType()), ("h", T.LongType()), ("state", T.ByteType()), ("len", T.ArrayType(T.IntegerType())))
    schema = T.StructType([T.StructField(n, t) for n, t in kinds])

    def work(batch: pa.RecordBatch, lexicon: Callable[[int], Lexicon], done: Callable[[int, str], bool]) -> pa.RecordBatch:
        texts = batch.column(3)
        size = np.hstack([lengths(*code_points(some)) for _, some in slices(texts)] or [np.zeros((len(MEASURES), 0), np.int64)])
        state, keep = np.zeros(len(texts), np.int8), np.ones(len(texts), bool)
        for k, form, _, _ in forms_of(texts):
            state[k] = ending(form, lexicon(k))
            keep[k] = done(k, form)
        flat = pa.array(size.T.ravel().astype(np.int32))
        off = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(MEASURES))
        got = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(state), pa.ListArray.from_arrays(off, flat)], names=["k", "s", "h", "state", "len"])
        return got if keep.all() else got.take(pa.array(np.flatnonzero(keep)))

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), source_name(F.col(source)).alias("s"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    return consulted(rows, corpus or corpus_of(docs, text), work, schema)


def _stands_at(length: F.Column, measure: F.Column, at: F.Column) -> F.Column:
    """The length is at the limit; bytes that were cut inside a character may have come out as a mark of three."""
    names = F.array(*map(F.lit, MEASURES))
    return (length == at) | (names[measure].startswith("utf8") & (length > at) & (length <= at + 2))


def _sure(open_: F.Column, usual: F.Column) -> F.Column:
    """How little chance explains so many open texts where so many are usual, as a logarithm."""
    usual = F.greatest(usual, F.lit(0.05))
    return open_ * F.log(open_ / usual) - (open_ - usual)


def limits(profiled: DataFrame, least: int = 5, times: float = 5.0, around: int = 40, sure: float = 15.0) -> DataFrame:
    """Rows (s, m, measure, at, n, open): all lengths at which a source's texts are cut.

    A limit is a length with at least `least` different texts that end open (or with a mark for the rest), most of all
    there; `times` as many as the lengths around it have on average, and more than chance gives with exp(-sure). Ends
    that tell nothing (SOFT) count neither way. One length shows in many measures, as most texts measure the same in
    several. So of a source's candidates the one with most open texts is taken, its texts are set aside, and the others
    are counted again, as long as one holds. Before that the texts are summed by the candidates they stand at.
    """
    names = F.array(*map(F.lit, MEASURES))
    told = profiled.where("s is not null").where(F.col("state") != SOFT)
    each = stored(told.select("s", "h", (F.col("state") > SOFT).cast("int").alias("open"), "len").dropDuplicates(["s", "h"]), "texts")
    flat = each.select("s", "open", F.posexplode("len").alias("m", "at"))
    counts = flat.groupBy("s", "m", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("open").alias("open"))
    near = Window.partitionBy("s", "m").orderBy("at").rangeBetween(-around, around)
    usual = (F.sum("open").over(near) - F.col("open")) / (2.0 * around)
    floor = times * F.greatest(F.col("usual"), F.lit(0.2))
    found = counts.withColumn("usual", usual).where((F.col("open") >= least) & (F.col("open") >= 0.6 * F.col("n")) & (F.col("open") >= floor) & (_sure(F.col("open"), F.col("usual")) > sure))
    listed = found.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("m", "at", "usual"))).alias("c"))
    here = each.join(listed, "s").withColumn("c", F.filter("c", lambda c: _stands_at(F.element_at("len", c["m"] + 1), c["m"], c["at"]))).where(F.size("c") > 0)
    sets = here.groupBy("s", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("open").alias("open"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        left = [([(c["m"], c["at"], c["usual"]) for c in r.c], r.n, r.open) for r in rows.itertuples()]
        chance = lambda n, usual: n * math.log(n / usual) - (n - usual)
        out = []
        while left:
            n, open_ = {}, {}
            for places, all_, cut in left:
                for p in places:
                    n[p], open_[p] = n.get(p, 0) + all_, open_.get(p, 0) + cut
            good = [p for p in n if open_[p] >= max(least, times * max(p[2], 0.2), 0.6 * n[p]) and chance(open_[p], max(p[2], 0.05)) > sure]
            if not good:
                break
            best = min(good, key=lambda p: (-open_[p], p))
            out.append((rows["s"].iloc[0], best[0], best[1], n[best], open_[best]))
            left = [x for x in left if best not in x[0]]
        return pd.DataFrame(out, columns=["s", "m", "at", "n", "open"])

    got = sets.groupBy("s").applyInPandas(choose, "s string, m int, at int, n long, open long")
    return got.select("s", "m", names[F.col("m")].alias("measure"), "at", "n", "open")


def cut_off(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", corpus: Corpus | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with a mark of those cut off, and how often each source cuts.

    The first has a row (k, s, cut, at_limit) for each document with a text, copies each; the second a row (source,
    documents, cut, share, limits) for each source, null for documents without one; limits lists (measure, at, texts),
    the clearest first. Source names are compared without case and outer spaces. Null texts are left out, empty ones
    are whole; null keys are kept. Texts are read whole. An empty table gives empty results; other columns are ignored.
    """
    profiled = stored(profiles(docs, key, text, source, corpus), "profiles")
    cap = limits(profiled).groupBy("s").agg(F.sort_array(F.collect_list(F.struct((-F.col("open")).alias("o"), "m", "at", "measure"))).alias("caps"))
    cap = stored(cap, "limits")
    at = F.exists("caps", lambda c: _stands_at(F.element_at("len", c["m"] + 1), c["m"], c["at"]))
    rows = profiled.join(cap, "s", "left").withColumn("at_limit", F.coalesce(at, F.lit(False)))
    rows = rows.withColumn("cut", (F.col("state") == OPEN) | (F.col("at_limit") & (F.col("state") > 0)))
    counts = rows.groupBy("s").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("cut").cast("long")).alias("cut"))
    listed = F.coalesce(F.transform("caps", lambda c: F.struct(c["measure"].alias("measure"), c["at"].alias("at"), (-c["o"]).alias("texts"))), F.array().cast("array<struct<measure:string,at:int,texts:bigint>>"))
    report = counts.join(cap, "s", "left")
    return rows.select("k", "s", "cut", "at_limit"), report.select(F.col("s").alias("source"), "documents", "cut", (F.col("cut") / F.col("documents")).alias("share"), listed.alias("limits"))
