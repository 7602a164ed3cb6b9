from __future__ import annotations

import random

import pytest

from glyphmill.llm import leaks as L


def edit(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(1)
    for _ in range(400):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (90, 120))
        assert L.myers(p, t, 200) == edit(p, t)
    pairs = [("".join(rng.choice("abcé") for _ in range(rng.randint(0, n))) for n in (150, 90)) for _ in range(300)]
    p, t = map(list, zip(*pairs, strict=True))
    assert L.myers_all(p, t).tolist() == [edit(a, b) for a, b in zip(p, t, strict=True)] and not len(L.myers_all([], []))
    assert L.myers("abc", "xyz", 1) == 2 and L.myers("", "x", 0) == 0


def exact(doc, item, n):
    d, i = (L.words_of(L_form(x)) for x in (doc, item))
    runs = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)}
    return any(tuple(d[k : k + n]) in runs for k in range(len(d) - n + 1))


def L_form(text):
    from glyphmill.llm.textform import form_text

    return form_text(text)


@pytest.mark.parametrize("errors", [0, 1])
def test_exact_runs_against_brute_force(spark, errors):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 20)))) for k in range(12)]
    docs = []
    for k in range(150):
        w = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        src = rng.choice(items)[1].split()
        a = rng.randint(0, max(0, len(src) - 4))
        piece = src[a : a + rng.randint(3, 12)]
        docs.append((k, ", ".join(w + piece).replace("w1", "Ｗ1").replace("w2", "w​2"), "x"))
    d = spark.createDataFrame(docs, "doc_id int, text string, distance string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in L.leaked_items(d, i, words=6, errors=errors).where("exact_words >= 6").collect()}
    assert got == {(a, b) for a, t, _ in docs for b, s in items if exact(t, s, 6)} and len(got) > 20
    blocks = L.leaked_items(d, i, words=6, errors=errors, block=100).where("exact_words >= 6")
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == got


@pytest.mark.parametrize("errors", [1, 2])
def test_planted_near_windows_are_all_found(spark, errors):
    rng = random.Random(errors)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(16))) for k in range(20)]
    docs, want = [], set()
    for k in range(300):
        n, text = rng.choice(items)
        a = rng.randint(0, 4)
        t = " ".join(text.split()[a : a + 12])
        for _ in range(errors):  # a character changed, left out, put in, or a space
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice(["", "x", " ", t[i] + "q"]) + t[i + 1 :]
        docs.append((k, f"{' '.join(rng.choices(words, k=9))} {t} {' '.join(rng.choices(words, k=9))}"))
        want.add((k, n))
    got = L.leaked_items(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), words=12, errors=errors)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} >= want


def test_near_copies_and_dirt(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, item.replace("three", "thre").upper()), (2, item.replace("three", "tree").replace("ten", "tan")), (3, None), (4, ""), (None, item), (5, "x " * 100_000 + item), (5, item)]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    i = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (7, item)], "item_id int, text string")
    one = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in L.leaked_items(d, i, words=12, errors=1).collect())
    assert one == [(1, 7, 1), (1, 7, 1), *[(5, 7, 0)] * 4]
    assert (2, 7, 2) in {(r["doc_id"], r["item_id"], r["distance"]) for r in L.leaked_items(d, i, words=12, errors=2).collect()}
    assert L.leaked_items(d.limit(0), i).count() == 0 and L.leaked_items(d, i.limit(0)).count() == 0


def test_spaces_lost_where_pieces_meet(spark):
    w = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima".split()
    at = [" ".join(w[:k]) + " ".join(w[k:]) for k in range(1, 12)]  # a space lost behind the k-th word
    docs = [(k, x) for k, x in enumerate(at)] + [(100 + k, x.replace("kilo", "kilt")) for k, x in enumerate(at)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    got = {r["doc_id"]: r["distance"] for r in L.leaked_items(df, items, words=12, errors=2).collect()}
    assert got == {k: 1 + (k >= 100) for k, _ in docs}
    assert {r["doc_id"] for r in L.leaked_items(df, items, words=12, errors=1).collect()} == set(range(11))
