"""What a corpus says about its words and full stops, and how documents ask it.

Counts of words of any length are made over all documents and judged by odds alone, so no word is too rare for a large
corpus, and none too long.  The judged words form a table that may grow without bound.  Its most frequent words, a fixed
number, go to every task; the others go there as a bit filter of fixed size, which never misses one.  A document that
asks for no word of the filter is done at once.  One that does is set aside with the words it asked for, joined with the
table, and done again with the answers, so the result is the same wherever the line between frequent and rare is drawn.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata as ud
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .textform import code_points, form_points, slices

BEFORE, LAST, COMMON = 1, 2, 3  # never ends a sentence; an abbreviation that may; usual in small letters
TOP = 1 << 17  # words every task has
BITS, PROBES = 1 << 27, 4  # of the filter of all others


def _ranges(kinds: str) -> str:
    """A character class of the code points below 0x10000 whose category begins with one of the letters."""
    at = [c for c in itertools.chain(range(0x3400), range(0xA000, 0xAC00), range(0xD7A4, 0xD800), range(0xF900, 0x10000)) if ud.category(chr(c))[0] in kinds]
    cut = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1] + 1), len(at)]
    more = "㐀-鿿가-힣" if "L" in kinds else ""
    return "".join(f"{re.escape(chr(at[a]))}-{re.escape(chr(at[z - 1]))}" for a, z in itertools.pairwise(cut)) + more


LETTER = _ranges("LM")
WORD = re.compile(f"[{LETTER}]+")
LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
STOP = re.compile(r"\.(?=(\s+)(\S)|()([,;])|\s*\Z)")
LONGEST = 6  # letters of most abbreviations
_TAIL = re.compile(f"[{LETTER}0-9.]+\\Z")
_BACK = re.compile(f"[{LETTER}0-9.]+")
_RUN = re.compile(f"[{LETTER}.]+")


def small(text: str, q: int, b: int) -> bool:
    """A word in small letters begins at q; pH or iPhone is no such word."""
    if not text[q].islower():
        return False
    m = WORD.match(text, q, b)
    return not (m and not m.group().islower() and any(c.isupper() for c in m.group()))


def word_before(text: str, i: int, most: int | None = LONGEST) -> str:
    """The word of at most so many letters (None: of any number) that ends at i, dots between its letters included; else
    an empty string."""
    if most is None:
        size, run = 32, ""
        while m := _BACK.match(text[max(0, i - size) : i][::-1]):  # backwards, so that only the word is read
            run = m.group()[::-1]
            if len(run) < size:
                break
            size *= 4
        at = i - len(run)
    else:
        if text[max(0, i - most - 1) : i].isalpha() and i > most:
            return ""
        m = _TAIL.search(text, max(0, i - 2 * most - 1), i)
        run, at = (m.group(), m.start()) if m else ("", i)
    if not run or any(c.isdigit() for c in run) or text[at - 1 : at] == "_":
        return ""
    word = run.lstrip(".")
    letters = len(word) - word.count(".")
    return word if 0 < letters and (most is None or letters <= most) and ".." not in word else ""


def stops(text: str, most: int | None = LONGEST) -> Iterator[tuple[str, str]]:
    """Each word of at most so many letters (None: of any number) with a full stop, and what follows: 'small' (a small
    letter or comma), 'end' (of a paragraph), 'text' (of the text), 'big' (anything else)."""
    for m in STOP.finditer(text):
        if word := word_before(text, m.start(), most):
            if m[4]:
                yield word, "small"
            elif m[2] is None:
                yield word, "text"
            elif len(m[1]) > 1 and len(LINES.findall(m[1])) > 1:
                yield word, "end"
            else:
                yield word, "small" if m[2] in ",;" or small(text, m.start(2), len(text)) else "big"


def forms_of(texts: pa.Array) -> Iterator[tuple[int, str, np.ndarray, int]]:
    """Row, consistent form, place of each of its characters in the text, length of the text; nulls are left out."""
    for first, some in slices(texts):
        cps, starts = code_points(some)
        form, at, src = form_points(cps, starts)
        whole = form.astype("<u4", copy=False).tobytes().decode("utf-32-le", "replace")
        null = np.asarray(some.is_null())
        begin, edge = starts.tolist(), at.tolist()
        for k in range(len(some)):
            if not null[k]:
                yield first + k, whole[edge[k] : edge[k + 1]], src[edge[k] : edge[k + 1]] - begin[k], begin[k + 1] - begin[k]


def gather(texts: pa.Array) -> dict[str, tuple[int, int, int, int]]:
    """For each word: how often it stands, with a stop, with one before a small letter, at a paragraph's end."""
    every: Counter = Counter()
    stopped: Counter = Counter()
    for _, text, _, _ in forms_of(texts):
        every.update(WORD.findall(text))
        stopped.update(stops(text, None))
    found = {w: [n, 0, 0, 0] for w, n in every.items()}
    for (w, what), n in stopped.items():
        row = found.setdefault(w, [0, 0, 0, 0])
        row[0] += n if "." in w else 0  # its letters were counted one by one
        row[1] += n
        if what == "small":
            row[2] += n
        elif what == "end":
            row[3] += n
    return {w: tuple(row) for w, row in found.items()}


STATS = "word string, n_all long, n_stop long, n_small long, n_end long"


def word_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Corpus counts of words by how they stand with a full stop; see gather(). Sums are made in each batch, or 16 MB of it."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in slices(batch.column(0), 1 << 24):
                n = gather(some)
                columns = zip(*n.values(), strict=True) if n else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["word", "n_all", "n_stop", "n_small", "n_end"])

    parts = docs.select(text).where(F.col(text).isNotNull()).mapInArrow(part, STATS)
    return parts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n_all", "n_stop", "n_small", "n_end")))


class Lexicon:
    """Kinds of words: those at hand, answers of the table for one document, and a filter of what only the table has."""

    def __init__(self, kinds: dict[str, int] | None = None, rest: np.ndarray | None = None, answers: dict[str, int] | None = None) -> None:
        self.kinds, self.rest, self.answers = kinds or {}, rest, answers or {}
        self.unsure = False  # a word of the filter was asked for

    def kind(self, word: str) -> int:
        """BEFORE, LAST, COMMON or 0."""
        got = self.kinds.get(word) or self.answers.get(word)
        if got is None:
            if self.rest is not None and _maybe(self.rest, word):
                self.unsure = True
            return 0
        return got

    def told(self, answers: dict[str, int]) -> Lexicon:
        """The lexicon with answers of the table; no other word of it will be asked for."""
        return Lexicon(self.kinds, None, answers)

    def questions(self, text: str) -> list[str]:
        """Every word of the filter that the text could ask for."""
        runs = {r.strip(".") for r in _RUN.findall(text)}
        words = {w for r in runs for w in (r, *r.split("."))}
        return sorted(w for x in words for w in {x, x.lower(), x.title()} if w and w not in self.kinds and _maybe(self.rest, w))


def _places(code: int) -> list[int]:
    code &= 0xFFFFFFFFFFFFFFFF
    return [((code & 0xFFFFFFFF) + k * ((code >> 32) | 1)) % BITS for k in range(PROBES)]


def _maybe(bits: np.ndarray, word: str) -> bool:
    return all(bits[p >> 3] >> (p & 7) & 1 for p in _places(xxhash.xxh64_intdigest(word.encode(), 42)))


class Corpus:
    """A corpus' judged words: the lexicon every task has, and the table of the others (None where there are none)."""

    def __init__(self, lexicon: Lexicon, rest: DataFrame | None = None) -> None:
        self.lexicon, self.rest = lexicon, rest


def judged(stats: DataFrame, sure: float = 1e-3) -> DataFrame:
    """Rows (word, kind, n_all) of the words that the counts tell something about.

    A word that, of all its stops, has far fewer at the ends of paragraphs than a word that ends sentences would by
    chance, or (if it has no dots in it) hardly any that do not stand before a small letter, never ends one (BEFORE). sure: the highest chance at which that is believed. One that nearly always has a
    stop and often goes on in small letters is an abbreviation that may end one (LAST). One in small letters that mostly
    stands without a stop is COMMON. Initials are none of these. Shares and odds decide, not the size of the corpus.
    Words of any length are judged. How often a stop is at a paragraph's end is told by the short ones: many of these
    are abbreviations, so the share is low, and it takes more stops to believe that a word never ends a sentence.
    """
    short = F.length(F.replace("word", F.lit("."), F.lit(""))) <= LONGEST
    stop, end = stats.where(short).agg(F.sum("n_stop"), F.sum("n_end")).first()
    rate = min(0.5, max(0.02, (end or 0) / max(1, stop or 1)))
    big, low = F.col("n_stop") - F.col("n_small"), F.lower("word")
    initial = (F.length("word") == 1) & (F.col("word") != low)
    few = math.log(sure) / math.log(1 - rate)  # so many chances a word that ends sentences doesn't miss
    inside = (F.col("n_end") == 0) & (big <= 0.05 * F.col("n_stop")) & (F.col("n_stop") > few) & ~F.col("word").contains(".")
    never = ((F.col("n_end") <= 0.05 * rate * big) & (big > few)) | inside
    never = never & (F.col("n_stop") >= 0.25 * F.col("n_all"))
    often = (F.col("n_stop") >= 0.9 * F.col("n_all")) & (F.col("n_stop") >= 5) & (F.col("n_small") >= F.greatest(F.lit(3.0), 0.1 * F.col("n_stop"))) & ((F.col("n_end") > 0) | ~F.col("word").contains("."))
    plain = (F.col("word") == low) & (F.upper("word") != low) & (F.col("n_all") >= 3) & (F.col("n_stop") < 0.5 * F.col("n_all"))
    kind = F.when(initial, 0).when((F.col("n_stop") >= 5) & never, BEFORE).when(often, LAST).when(plain, COMMON).otherwise(0)
    return stats.select("word", kind.alias("kind"), "n_all").where("kind > 0")


def corpus_of(docs: DataFrame, text: str = "text", top: int = TOP, sure: float = 1e-3) -> Corpus:
    """The judged words of all documents. top: how many of the most frequent ones every task gets; it changes no result."""
    told = "n_stop > 0 or n_all >= 3 and upper(word) <> lower(word)"  # judged() makes nothing of the others
    words = stored(judged(stored(word_stats(docs, text).where(told), "stats"), sure), "words")
    first = words.orderBy(F.desc("n_all"), "word").limit(top).collect()
    kinds = {r["word"]: r["kind"] for r in first}
    if len(first) < top:
        return Corpus(Lexicon(kinds))
    last = first[-1]
    rest = words.where((F.col("n_all") < last["n_all"]) | ((F.col("n_all") == last["n_all"]) & (F.col("word") > last["word"]))).select("word", "kind")
    code = F.xxhash64("word")
    low, high = code.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(code, 32).bitwiseOR(F.lit(1))
    place = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda k: F.pmod(low + k * high, F.lit(BITS))))
    cells = rest.select(place.alias("p")).groupBy(F.shiftright("p", 5).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 31 as int)))").alias("v"))
    got = cells.toArrow()  # at most BITS / 32 rows
    bits = np.zeros(BITS // 32, "<u4")
    bits[np.asarray(got["at"])] = np.asarray(got["v"]).astype(np.uint32)
    return Corpus(Lexicon(kinds, bits.view(np.uint8)), rest)


Work = Callable[[pa.RecordBatch, Callable[[int], Lexicon], Callable[[int, str], bool]], pa.RecordBatch]


def consulted(rows: DataFrame, corpus: Corpus, work: Work, schema: T.StructType) -> DataFrame:
    """The rows of work(batch, lexicon, done) over all batches of rows, which have the words of the corpus at hand.

    lexicon(i) is the lexicon for row i; done(i, form) tells, when the row has been worked on, whether its result holds.
    A row for which it does not must give nothing: it is worked on again with every word it could ask for.
    """
    shared: Broadcast = rows.sparkSession.sparkContext.broadcast(corpus.lexicon)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            yield work(batch, lambda _: lexicon, lambda *_: True)

    if corpus.rest is None:
        return rows.mapInArrow(plain, schema)
    both = T.StructType([T.StructField("out", schema), T.StructField("row", rows.schema), T.StructField("id", T.StringType()), T.StructField("asked", T.ArrayType(T.StringType()))])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            open_: dict[int, list[str]] = {}

            def done(i: int, form: str, open_: dict = open_) -> bool:
                if lexicon.unsure:
                    open_[i], lexicon.unsure = lexicon.questions(form), False
                return i not in open_

            out = work(batch, lambda _: lexicon, done)
            n = len(open_)
            again = pa.RecordBatch.from_arrays([c.take(pa.array(list(open_), pa.int64())) for c in batch.columns], names=batch.schema.names)
            struct = lambda b: pa.StructArray.from_arrays(b.columns, fields=list(b.schema))
            left, right = struct(out), struct(again)
            names = ["out", "row", "id", "asked"]
            text, words = pa.string(), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([left, pa.nulls(len(left), right.type), pa.nulls(len(left), text), pa.nulls(len(left), words)], names=names)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, left.type), right, pa.array([uuid.uuid4().hex for _ in open_], text), pa.array(open_.values(), words)], names=names)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            again, answers = batch.columns

            def told(i: int, answers: pa.Array = answers) -> Lexicon:
                return lexicon.told({a["word"]: a["kind"] for a in answers[i].as_py() or ()})

            yield work(pa.RecordBatch.from_arrays(again.flatten(), names=[f.name for f in again.type]), told, lambda *_: True)

    got = stored(rows.mapInArrow(first, both), "consulted")
    sure = got.where("id is null").select("out.*")
    asked = got.where("id is not null").select("id", "row", "asked")
    answers = asked.select("id", F.explode("asked").alias("word")).join(corpus.rest, "word").groupBy("id").agg(F.collect_list(F.struct("word", "kind")).alias("answers"))
    again = asked.select("id", "row").join(answers, "id", "left").select("row", "answers")
    return sure.union(again.mapInArrow(second, schema))

