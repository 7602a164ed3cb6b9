"""Test passages inside a corpus, by pigeonhole edit matching.

A passage is a window of consecutive words of a test item, with an error budget in characters.  The window is split into
one piece more than the budget, so at least one stands in a document unharmed; of each piece all words but the last are
looked up, as a space lost between two pieces harms the last word of one and the first of the next, and so one piece
only.  The pieces of all windows are hashed; each document is read once, its word runs of that length are looked up, and
every window around a hit is verified with Myers' bit-parallel edit distance, for all windows of a batch at once.  Words
are those of the consistent form, lower-cased, so punctuation, line breaks and disguise do not matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon import forms_of
from .setjoin import mix

WORD = re.compile(r"[^\W_]+")
MARK = re.compile(r"[̀-ͯ]")


def words_of(form: str) -> list[str]:
    """Maximal runs of letters and digits, lower-cased; marks that no letter takes up are no part of a word."""
    return WORD.findall(form.lower())


def myers(pattern: str, text: str, most: int) -> int:
    """Least edit distance of the pattern to any part of the text, or most + 1 if it is greater than most."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        best = min(best, score)
    return best if best <= most else most + 1


def myers_all(patterns: list[str], texts: list[str]) -> np.ndarray:
    """The least edit distance of each pattern to any part of its text, for all at once; as myers() without a limit."""
    best = np.array([len(p) for p in patterns], np.int64)
    for some in _alike_sizes(patterns, texts):
        m = np.array([len(patterns[k]) for k in some])
        n = np.array([len(texts[k]) for k in some])
        p, t = (np.zeros((len(some), size), np.uint32) for size in (max(1, m.max()), max(1, n.max())))
        for i, k in enumerate(some):
            p[i, : m[i]] = np.frombuffer(patterns[k].encode("utf-32-le"), np.uint32)
            t[i, : n[i]] = np.frombuffer(texts[k].encode("utf-32-le"), np.uint32) + np.uint32(1)  # 0 stands for no character
        p += np.arange(p.shape[1]) < m[:, None]
        words = -(-p.shape[1] // 64)
        width, rows = words * 64, np.arange(len(some))
        bits = np.zeros((len(some), width), bool)
        bits[:, : p.shape[1]] = np.arange(p.shape[1]) < m[:, None]
        pack = lambda x: np.packbits(x, axis=1, bitorder="little").view("<u8").T.copy()
        full = pack(bits)
        top = np.maximum(m - 1, 0)
        one = np.uint64(1)
        pv, mv, score = full.copy(), np.zeros_like(full), m.copy()
        least = m.copy()
        for step in range(t.shape[1]):
            c = t[:, step]
            bits[:, : p.shape[1]] = (p == c[:, None]) & (p > 0)
            eq = pack(bits)
            xv = eq | mv
            total, carry = np.empty_like(eq), np.zeros(len(some), np.uint64)
            for w in range(words):
                x = (eq[w] & pv[w]) + pv[w]
                y = x + carry
                carry = ((x < pv[w]) | (y < x)).astype(np.uint64)
                total[w] = y
            xh = (total ^ pv) | eq
            ph, mh = (mv | ~(xh | pv)) & full, pv & xh
            up, down = ((h[top >> 6, rows] >> (top & 63).astype(np.uint64)) & one for h in (ph, mh))
            score += up.astype(np.int64) - down.astype(np.int64)
            least = np.where((step < n) & (m > 0), np.minimum(least, score), least)
            shift = lambda h: np.vstack([h[:1] << one, (h[1:] << one) | (h[:-1] >> np.uint64(63))]) & full
            ph, mh = shift(ph), shift(mh)
            pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        best[some] = least
    return best


def _alike_sizes(patterns: list[str], texts: list[str], most: int = 1 << 12) -> Iterator[list[int]]:
    """Numbers of pairs of about the same size, so many at a time."""
    order = sorted(range(len(patterns)), key=lambda k: (len(patterns[k]), len(texts[k])))
    for a in range(0, len(order), most):
        yield order[a : a + most]


class Index:
    """Pieces of the windows of some items."""

    def __init__(self, items: list[tuple[object, str]], words: int, errors: int) -> None:
        self.words, self.errors = words, errors
        self.step = words // (errors + 1)  # words from one piece to the next
        self.piece = self.step - (errors > 0)  # words of it that are looked up
        if self.piece < 1:
            raise ValueError("too many errors for a window of so few words")
        self.ids = [i for i, _ in items]
        self.texts = [words_of(t) for _, t in items]
        self.vocabulary: dict[str, int] = {}
        for ws in self.texts:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        codes, item, at = [], [], []
        for n, ws in enumerate(self.texts):
            if len(ws) < words:
                continue
            ids = np.array([self.vocabulary[w] for w in ws])
            h = self.hashes(ids)
            codes.append(h)
            item.append(np.full(len(h), n))
            at.append(np.arange(len(h)))
        self.hash = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, int)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, int)

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        """A hash of each run of a piece's length."""
        n = len(ids) - self.piece + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for k in range(self.piece):
            h = mix(h ^ (ids[k : k + n].astype(np.uint64) + np.uint64(k + 1)))
        return h

    def find(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Row, place in the row, item and place in the item of each piece found in rows of word ids laid end to end."""
        h = self.hashes(ids)
        if not len(h) or not len(self.hash):
            return
        low = np.searchsorted(self.hash, h, "left")
        hit = np.flatnonzero((low < len(self.hash)) & (self.hash[np.minimum(low, len(self.hash) - 1)] == h))
        row = np.searchsorted(starts, hit, "right") - 1
        inside = hit + self.piece <= starts[row + 1]
        for p, r in zip(hit[inside].tolist(), row[inside].tolist(), strict=True):
            k = int(low[p])
            while k < len(self.hash) and self.hash[k] == h[p]:
                yield r, p - int(starts[r]), int(self.item[k]), int(self.at[k])
                k += 1

    def run(self, doc: list[str], hits: list[tuple[int, int]], item: list[str]) -> int:
        """The longest exact run of words through one of the hits (place in doc, place in item)."""
        run = 0
        seen: dict[int, int] = {}
        for p, q in sorted(hits):
            if seen.get(p - q, -1) >= p:
                continue
            a = 0
            while p - a > 0 and q - a > 0 and doc[p - a - 1] == item[q - a - 1]:
                a += 1
            z = 0
            while p + z < len(doc) and q + z < len(item) and doc[p + z] == item[q + z]:
                z += 1
            seen[p - q] = p + z - self.piece
            run = max(run, a + z)
        return run

    def windows(self, doc: list[str], hits: list[tuple[int, int]], item: list[str]) -> Iterator[tuple[str, str]]:
        """The windows of the item that a hit is a piece of, each with the part of the document around it. Windows with
        more unlike words than the errors can spoil are left out: an error spoils two words at most."""
        tried = set()
        least = self.words - 2 * self.errors
        for p, q in hits:
            for back in range(0, self.words - self.piece + 1, self.step):
                s = q - back
                if s < 0 or s + self.words > len(item) or (s, p - q) in tried:
                    continue
                tried.add((s, p - q))
                near = doc[max(0, p - back - self.errors) : p - back + self.words + self.errors]
                here = set(near)
                if sum(w in here for w in item[s : s + self.words]) >= least:
                    yield " ".join(item[s : s + self.words]), " ".join(near)


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", words: int = 12, errors: int = 1, block: int = 32 << 20) -> DataFrame:
    """Rows (doc_key, item_key, exact_words, distance) of documents that hold a window of the item's words.

    A window is `words` consecutive words of the item; it is held if the document has it with at most `errors`
    characters changed, left out or put in. distance is the least one of a window, exact_words the longest run of
    words that agrees. The items are the stated query set: they are read in blocks of at most `block` bytes of text,
    each matched against all documents, so that what a task holds stays bounded. Null texts and keys, and items with
    fewer words, give no row. Copies of a document or item count each; texts are searched whole. Other columns are
    ignored; the keys keep their names and types (item_key is called "item" beside a doc_key of the same name).
    """
    spark = docs.sparkSession
    base = items.where(F.col(item_key).isNotNull() & F.col(text).isNotNull()).select(F.col(item_key).alias("i"), F.col(text).alias("t"))
    total = base.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block))
    rows = docs.where(F.col(doc_key).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_key).alias("d"), F.col(text).alias("t"))
    schema = T.StructType([T.StructField("d", docs.schema[doc_key].dataType), T.StructField("i", items.schema[item_key].dataType), T.StructField("exact_words", T.IntegerType()), T.StructField("distance", T.IntegerType())])
    out = None
    for b in range(blocks):
        some = base.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else base
        table = some.toArrow()
        listed = [(i.as_py(), f) for i, f in zip(table["i"].combine_chunks(), (x[1] for x in forms_of(table["t"].combine_chunks())), strict=True)] if table.num_rows else []
        index = spark.sparkContext.broadcast(Index(listed, words, errors))

        def part(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            get = ix.vocabulary.get
            for batch in batches:
                docs_words = [words_of(f) for _, f, _, _ in forms_of(batch.column(1))]
                starts = np.cumsum([0, *map(len, docs_words)])
                ids = np.fromiter((get(w, 0) for ws in docs_words for w in ws), np.int64, int(starts[-1]))
                hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for r, p, n, q in ix.find(ids, starts):
                    hits.setdefault((r, n), []).append((p, q))
                owner, patterns, texts = [], [], []
                for (r, n), places in hits.items():
                    for pattern, near in ix.windows(docs_words[r], places, ix.texts[n]):
                        owner.append((r, n))
                        patterns.append(pattern)
                        texts.append(near)
                best: dict[tuple[int, int], int] = {}
                for who, distance in zip(owner, myers_all(patterns, texts).tolist(), strict=True):
                    if distance <= errors:
                        best[who] = min(distance, best.get(who, distance))
                got = [(r, n, (ix.run(docs_words[r], hits[r, n], ix.texts[n]), distance)) for (r, n), distance in best.items()]
                keys = batch.column(0).take(pa.array([r for r, _, _ in got], pa.int64()))
                found = pa.array([ix.ids[n] for _, n, _ in got], table["i"].type)
                yield pa.RecordBatch.from_arrays([keys, found, pa.array([v[0] for *_, v in got], pa.int32()), pa.array([v[1] for *_, v in got], pa.int32())], names=["d", "i", "exact_words", "distance"])

        one = rows.mapInArrow(part, schema)
        out = one if out is None else out.union(one)
    return out.toDF(doc_key, item_key if item_key != doc_key else "item", "exact_words", "distance")
