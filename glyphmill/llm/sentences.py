"""Sentence units of texts in any language and script.

At a full stop the document itself decides first, by its unambiguous places.  A word that it has with a stop before a
small letter or comma, and never without a stop, is an abbreviation; one that it has without a stop is an ordinary word
and ends the sentence; a word that it has with a capital inside sentences, and not in small letters, is a name.  Where
the document has no such place, counts over all documents decide (see lexicon.py): a word that, in spite of many
chances, never ends a paragraph never ends a sentence (titles, "No."), and an abbreviation that does may ("etc.").  A
short list of well-known abbreviations is a prior for words on which neither says anything.  Terminators, quotations
and spaces follow the rules of the script they stand in.

Decisions are made on the consistent form of the text, so disguised letters and characters without width do not hide
an abbreviation; offsets refer to the text as stored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon import BEFORE, COMMON, LAST, LETTER, LINES, WORD, Corpus, Lexicon, consulted, corpus_of, forms_of, small, stops

# Abbreviations before a name, a number or an example, which do not end a sentence; a prior only.
SEED_BEFORE = frozenset(
    "Dr Mr Mrs Ms Prof St Rev Gen Col Capt Lt Sgt Hon No Nos Vol Vols Fig Figs Sec Ch Art Eq p pp cf approx ca vs viz al "
    "M MM Mme Mlle Mgr t ch éd n ex Fr Hr Hrn Nr Bd Bde S Abb Abs Kap Tab Aufl bzw vgl Vgl sog ggf evtl "
    "Sr Sra Srta Sres Dra Ud Uds D núm pág págs cap art ej "
    "e.g i.e z.B d.h u.a o.ä p.ex p.ej डॉ श्री د أ".split()
)
# Abbreviations that can be the last word of a sentence; a prior only.
SEED_LAST = frozenset("etc usw usf a.m p.m Inc Ltd Corp Co Jr".split())
# Words before a German ordinal, and verbs that name the speaker of a quotation.
ORDINAL_BEFORE = frozenset("am im vom zum beim der die das den dem des ab bis seit im den und".split())
SPEECH = frozenset(
    "said asked replied answered wrote cried whispered shouted added says asks called muttered "
    "dit demanda répondit cria ajouta murmura écrivit sagte rief fragte antwortete flüsterte schrieb "
    "dijo preguntó respondió gritó añadió escribió".split()
)
# What closes each opening mark.
CLOSES = {'"': '"', "“": "”“", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "(": ")", "[": "]", "‹": "›", "《": "》", "〈": "〉"}
HARD = "。।॥؟۔"
TERM = ".!?…" + HARD
AFTER = "\"”’»›)]』」'"

RULE = re.compile(r"([*+\-=_~])\1{2,}")
HEADING = re.compile(r"#+\s+\S")
ITEM = re.compile(r"(?:[-*+•‣◦·–]|\(?\d{1,3}[.)]|\(?[A-Za-z]\))\s+\S")
EVENT = re.compile(r"""["“„«»「『(\[‹《〈]|[.!?…。।॥؟۔]+|(?<=[฀-๿])\s+|(?<=[0-9])\s+(?=[฀-๿])""")
NUMBER = re.compile(r"[$€£]?\d+(?:[.,:]\d+)*")
DOTTED = re.compile(f"(?:[{LETTER}]\\.)+[{LETTER}]")
NAMED = re.compile(f"(?<![{LETTER}0-9])([{LETTER}]+),?[ \t]+(?=([{LETTER}]{{2,}}))")
LAST_WORD = re.compile(f"[{LETTER}]+\\Z")
SHORT = 2000  # characters of a text in which a word is looked for before all words are counted


class Document:
    """One document's own evidence, made when first asked for, and behind it the corpus and the seeds."""

    def __init__(self, text: str, lexicon: Lexicon) -> None:
        self.text, self.lexicon, self._plain, self._named = text, lexicon, None, None
        self._kinds: dict[str, int] = {}

    def _look(self) -> None:
        """Words without a stop, those with one before a small letter or comma, and those with one at a paragraph's end."""
        self._plain, self._inside, self._final = Counter(WORD.findall(self.text)), Counter(), Counter()
        for word, what in stops(self.text, None):
            (self._final if what in ("end", "text") else self._inside)[word] += what != "big"
            self._plain[word] -= 1
        if m := LAST_WORD.search(self.text, max(0, len(self.text) - 40)):  # the text may be cut before its stop
            self._plain[m.group()] -= 1

    def plain(self, word: str) -> bool:
        """The document has the word, in these letters, without a stop after it, and not only as its last word."""
        if self._plain is None:
            if len(self.text) < SHORT and self.text.count(word) == self.text.count(word + "."):
                return False
            self._look()
        return self._plain[word] > 0

    def abbreviation(self, word: str) -> bool:
        """The document has the word with a stop before a small letter or comma, more often than at a paragraph's end."""
        if self._plain is None:
            if len(self.text) < SHORT and self.text.count(word + ".") < 2:  # no other place
                return False
            self._look()
        return self._inside[word] > self._final[word]

    def name(self, word: str) -> bool:
        """The document has the word with a capital inside a sentence, and never in small letters."""
        if self._named is None:
            self._named = {m[2] for m in NAMED.finditer(self.text) if m[1].islower() and m[2][0].isupper() and not m[2].isupper()}
        return word in self._named and not self.common(word)

    def kind(self, word: str) -> int:
        """What the corpus says of the word, in any case it may stand in; what the seeds say where that is nothing."""
        got = self._kinds.get(word)
        if got is None:
            cases = (word, word.lower(), word.title()) if word.isalpha() and len(word) > 1 and word.isupper() else (word,)
            told = {self.lexicon.kind(w) for w in cases}
            got = next((k for k in (BEFORE, LAST, COMMON) if k in told), 0)
            got = got or (BEFORE if any(w in SEED_BEFORE for w in cases) else LAST if any(w in SEED_LAST for w in cases) else 0)
            self._kinds[word] = got
        return got

    def never_last(self, word: str) -> bool:
        return self.kind(word) == BEFORE and not (len(word) > 1 and word.isalpha() and word.islower() and self.plain(word))

    def known(self, word: str) -> bool:
        return self.kind(word) == LAST or self.never_last(word)

    def common(self, word: str) -> bool:
        low = word.lower()
        return low != word and (self.plain(low) or self.lexicon.kind(low) == COMMON)

    def says(self, word: str, following: str) -> bool | None:
        """Whether the stop between the two words ends a sentence, as the document's other places tell; None if they
        don't. An ordinary word ends it. An abbreviation that can end sentences does so unless a name follows; any
        other goes on unless a common word follows."""
        if len(word) < 2:
            return None
        if not self.abbreviation(word):
            return True if word.isalpha() and word.islower() and self.plain(word) else None
        if DOTTED.fullmatch(word) or self.kind(word) == LAST:
            return False if self.name(following) else None
        if self.plain(word) or self.lexicon.kind(word.lower()) == COMMON:
            return None
        return False if self.never_last(word) else self.common(following)


class Closers:
    """Where each opening mark of a range closes, found in one pass for each kind of mark."""

    def __init__(self, text: str, a: int, b: int) -> None:
        self.text, self.a, self.b, self._of = text, a, b, {}

    def at(self, i: int) -> int:
        """Where the mark opened at i closes; -1 if it doesn't."""
        c = self.text[i]
        found = self._of.get(c)
        if found is None:
            found, open_, ends = {}, [], CLOSES[c]
            for m in _PAIR[c].finditer(self.text, self.a, self.b):
                if m.group() in ends:
                    if open_:
                        found[open_.pop()] = m.start()
                    if c not in ends:
                        continue
                    open_ = []  # the mark is its own end: what comes next ends it
                open_.append(m.start())
            self._of[c] = found
        return found.get(i, -1)


_PAIR = {c: re.compile(f"[{re.escape(c + ends)}]") for c, ends in CLOSES.items()}


def _capitals(text: str, st: int, i: int, m: re.Match | None) -> bool:
    """The sentence so far and the next word are in capitals, so that case says nothing."""
    if not m or not m.group().isupper() or len(m.group()) < 2:
        return False
    around = text[max(st, i - 40) : i] + text[m.start() : m.start() + 12]
    return around.isupper() and sum(c.isupper() for c in around) > 4


def _skip(text: str, q: int, b: int, what: str) -> int:
    while q < b and (text[q].isspace() or text[q] in what):
        q += 1
    return q


def _opens(text: str, i: int, a: int) -> bool:
    c = text[i]
    if c == '"':
        return i == a or text[i - 1].isspace() or text[i - 1] in "([{“«„—–-.!?…。" or not text[i - 1].isascii()
    if c == "»":
        return (i == a or text[i - 1].isspace()) and i + 1 < len(text) and text[i + 1].isalnum()
    return True


def _speaks(text: str, q: int, b: int) -> bool:
    """A clause that names a speaker begins at q."""
    m = re.compile(r"[^.!?…。]*").match(text, q, b)
    words = WORD.findall(m.group())
    return any(w.lower() in SPEECH for w in words[:8])


def _at_dot(text: str, a: int, b: int, st: int, i: int, e: int, doc: Document) -> bool:
    """The single full stop at i, with e after it and its closing marks, ends a sentence."""
    j = i
    while j > st and not text[j - 1].isspace() and text[j - 1] not in "\"“”„«»()[]「」,;!?":
        j -= 1
    tok = text[j:i]
    tail = tok.rpartition(".")[2]
    space = text[e].isspace()
    if not space:
        nx = text[e]
        if nx in "“„«「『" or nx == '"':
            return not doc.never_last(tok)
        if not nx.isalpha() or nx.islower():
            return False
        if "@" in tok or "://" in tok or tok.startswith("www."):
            return False
        if nx.isupper():
            m = WORD.match(text, e, b)
            if len(tail) == 1 and not tail.isdigit():
                return "." in tok and tail.isupper() and len(m.group()) > 1 and m.group()[1:].islower()
            return not doc.never_last(tok)
        return not (len(tok) == 1 or doc.never_last(tok))
    q = _skip(text, e, b, "")
    if q >= b:
        return True
    if text[q] in ",;:)]":
        return False
    w = _skip(text, q, b, "\"“„«‹'‘’(¿¡[—–-「『")
    if w >= b:
        return True
    if small(text, w, b):
        return False
    if not text[w].isalpha():  # a number or a sign
        return not (doc.known(tok) or (len(tok) == 1 and tok.isalpha()) or (DOTTED.fullmatch(tok) and tail.islower()))
    m = WORD.match(text, w, b)
    if m and (said := doc.says(tok, m.group())) is not None:
        return said
    if _capitals(text, st, i, m) and not NUMBER.fullmatch(tok):
        if len(tok) == 1 or doc.never_last(tok):
            return False
        return not ((DOTTED.fullmatch(tok) or doc.known(tok)) and doc.lexicon.kind(m.group().lower()) == COMMON)
    if NUMBER.fullmatch(tok):
        before = WORD.findall(text[max(st, j - 24) : j])
        near = text[max(st, j - 1) : j].isspace()
        return not (near and len(tok) <= 3 and tok.isdigit() and before and before[-1].lower() in ORDINAL_BEFORE and text[j - 2].isalpha())
    if len(tok) == 1 and tok.isalpha():
        if doc.never_last(tok):
            return False
        if j > st + 2 and text[j - 2] == "." and text[j - 3].islower() and (j - 4 < st or not text[j - 4].isalnum()):
            return False  # z. B.
        if not (tok.isupper() and m and w == q) or (len(m.group()) == 1 and text[m.end() : m.end() + 1] == "."):
            return False
        return doc.common(m.group())
    if DOTTED.fullmatch(tok):
        return not doc.never_last(tok)
    if doc.never_last(tok):
        return False
    return not (tail and tail != tok and doc.never_last(tail) and not tail.isdigit() and len(tail) > 1)


def _ends(text: str, a: int, b: int, st: int, i: int, run: str, e: int, doc: Document) -> bool:
    """The run of terminators at i, with e after it and its closing marks, ends a sentence."""
    if e >= b:
        return True
    if run == ".":
        return _at_dot(text, a, b, st, i, e, doc)
    q = _skip(text, e, b, "")
    if q >= b:
        return True
    if set(run) <= {".", "…"}:  # dots of omission
        w = _skip(text, q, b, "\"“„«‹'‘(¿¡[—–-")
        return q > e and w < b and text[w].isupper()
    if any(c in HARD for c in run):
        return text[q] not in "，,、；;"
    if text[q] in ",;:、)]":
        return False
    if q == e and text[q].isascii() and text[i - 1].isascii():
        word = text[max(st, i - 200) : i].rsplit(None, 1)[-1:]
        if (not text[q].isupper() and text[q] not in "\"([#") or (word and "://" in word[0]):
            return False
    w = _skip(text, q, b, "\"“„«‹'‘(¿¡[—–-")
    return w >= b or not small(text, w, b)


def split_block(text: str, a: int, b: int, doc: Document, final: bool) -> list[tuple[int, int, bool]]:
    """Sentences of the running text [a, b): start, end, and whether an open quotation runs to the end."""
    out: list[tuple[int, int, bool]] = []
    st = _skip(text, a, b, "")
    pos, opened, closers = st, False, Closers(text, a, b)

    def cut(at: int) -> None:
        nonlocal st, pos
        end = at
        while end > st and text[end - 1].isspace():
            end -= 1
        if end > st:
            out.append((st, end, False))
        st = _skip(text, at, b, "")
        pos = max(pos, st)

    while pos < b:
        m = EVENT.search(text, pos, b)
        if not m:
            break
        i, run = m.start(), m.group()
        c = run[0]
        pos = m.end()
        if c in CLOSES:
            if not _opens(text, i, a):
                continue
            j = closers.at(i)
            if j < 0:
                if final and c not in "([":
                    opened = True
                    break
                continue
            pos = j + 1
            k = j - 1
            while k > i and text[k].isspace():
                k -= 1
            if k == i or text[k] not in TERM or pos >= b or text[pos] in TERM:
                continue
            first = not text[st:i].strip(" \t\r\n—–-¿¡")
            q = _skip(text, pos, b, "")
            if q >= b:
                continue
            nx = text[q]
            if nx in ",;:、)]，" or (nx in "-–—" and not (q + 1 < b and text[q + 1].isupper())):
                continue
            w = _skip(text, q, b, "\"“„«‹'‘(¿¡[—–-")
            upper = w < b and (text[w].isupper() or (text[w].isalpha() and not small(text, w, b)))
            if c in "([":
                if first and upper and w < b and text[w].isupper():
                    cut(pos)
                continue
            if first:
                if nx in CLOSES and nx not in "([":
                    cut(pos)
                elif w < b and (text[w].isupper() or text[w].isdigit()) and not _speaks(text, q, b):
                    cut(pos)
                continue
            if w < b and small(text, w, b):
                continue
            if c in "「『" and nx in "とっ":
                continue
            cut(pos)
            continue
        if c.isspace():
            cut(i)
            continue
        e = pos
        while e < b and text[e] in AFTER and not (text[e] in "\"'" and e + 1 < b and text[e + 1].isalnum()):
            e += 1
        if _ends(text, a, b, st, i, run, e, doc):
            pos = e
            cut(e)
    end = b
    while end > st and text[end - 1].isspace():
        end -= 1
    if end > st:
        out.append((st, end, opened))
    return out


def blocks(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind and range of each part of a text: heading, item (a line each) and running text (lines up to a blank)."""
    a = 0
    run: tuple[int, int] | None = None
    after = ""  # the kind of the line before, in the same paragraph
    for m in [*LINES.finditer(text), None]:
        b = m.start() if m else len(text)
        line = text[a:b]
        bare = line.strip()
        kind = "text"
        if not bare:
            kind = ""
        elif RULE.fullmatch(bare):
            kind = "rule"
        elif HEADING.match(bare):
            kind = "heading"
        elif after != "text" and ITEM.match(bare):
            kind = "item"
        if kind == "text":
            run = (run[0] if run else a, b)
        else:
            if run:
                yield "text", *run
                run = None
            if kind in ("heading", "item"):
                s = a + len(line) - len(line.lstrip())
                yield kind, s, s + len(bare)
        after = kind
        if m:
            a = m.end()
    if run:
        yield "text", *run


def units(text: str, lexicon: Lexicon | None = None) -> list[tuple[int, int, str, bool]]:
    """Units of a text in the consistent form: start, end, kind of block, whether a quotation is left open."""
    doc = Document(text, lexicon or Lexicon())
    parts = list(blocks(text))
    out: list[tuple[int, int, str, bool]] = []
    for n, (kind, a, b) in enumerate(parts):
        if kind != "text":
            out.append((a, b, kind, False))
        else:
            out += [(s, e, kind, o) for s, e, o in split_block(text, a, b, doc, n == len(parts) - 1)]
    return out


def text_units(raw: str, form: str, src: np.ndarray, size: int, lexicon: Lexicon | None = None) -> list[tuple[int, int]]:
    """Units as ranges of the stored text."""
    out = []
    for s, e, _, _ in units(form, lexicon):
        a, z = int(src[s]), int(src[e]) if e < len(src) else size
        while z > a and (raw[z - 1].isspace() or raw[z - 1] in "​‌‍⁠﻿­"):
            z -= 1
        out.append((a, z))
    return out


def sentence_units(docs: DataFrame, key: str = "doc_id", text: str = "text", corpus: Corpus | None = None) -> DataFrame:
    """One row (key, seg_idx, seg_start, seg_end) for each unit of each document, half-open, in code points.

    A null text or one of white space and rule lines gives no unit; a null key is kept. Rows with the same key or text
    are cut alike and count each. Texts of any length are cut whole. Other columns are ignored, so their names may
    clash with the result's; the key keeps its name and type. An empty table gives an empty result. corpus: what other
    documents say; by default these say it.
    """
    kind = docs.schema[key].dataType
    i = T.IntegerType()
    schema = T.StructType([T.StructField("k", kind), *(T.StructField(c, i) for c in "ise")])

    def work(batch: pa.RecordBatch, lexicon: Callable[[int], Lexicon], done: Callable[[int, str], bool]) -> pa.RecordBatch:
        rows, idx, start, end = [], [], [], []
        raws = batch.column(1)
        for k, form, src, size in forms_of(raws):
            found = text_units(raws[k].as_py(), form, src, size, lexicon(k))
            if not done(k, form):
                continue
            rows += [k] * len(found)
            idx += range(len(found))
            start += [s for s, _ in found]
            end += [e for _, e in found]
        keys = batch.column(0).take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([keys, *(pa.array(x, pa.int32()) for x in (idx, start, end))], names=["k", "i", "s", "e"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return consulted(rows, corpus or corpus_of(docs, text), work, schema).toDF(key, "seg_idx", "seg_start", "seg_end")
