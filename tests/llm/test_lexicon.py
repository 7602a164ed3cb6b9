from __future__ import annotations

import random

import pytest

from glyphmill.llm import lexicon as X
from glyphmill.llm import sentences as S
from glyphmill.llm import truncation as T


def test_stops():
    text = "Dr. Vim ran at 5 p.m. today, etc., and so.\n\nPots etc.\n\nA3. b_c. longerword. X. डॉ. राम"
    assert list(X.stops(text)) == [("Dr", "big"), ("p.m", "small"), ("etc", "small"), ("so", "end"), ("etc", "end"), ("X", "big"), ("डॉ", "big")]


def test_counts():
    n = X.gather(__import__("pyarrow").array(["Dr. Vim. Dr. Al. abc etc.\n\nAn etc. and", None, ""]))
    assert n["Dr"] == (2, 2, 0, 0) and n["etc"] == (2, 2, 1, 1) and n["abc"] == (1, 0, 0, 0)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    low = ["".join(rng.choice("bdgklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(300)]
    short = [w[:3] for w in low[:40]]
    rows = []
    for k in range(400):
        text = ""
        for _ in range(rng.randint(1, 6)):
            name = rng.choice(low).title()
            text += f"The {rng.choice(low)} saw {rng.choice(short)}. {name} and {rng.choice(low)}, {rng.choice(short)}. {rng.choice(low)} at {rng.choice(low)}. "
            text += "\n\n" if rng.random() < 0.4 else ""
        rows.append((k % 397, text.strip() if k % 9 else None, rng.choice(["a", "b"])))
    return spark.createDataFrame([*rows, (None, "", "a")], "doc_id long, text string, source string")


def test_words_outside_the_top_are_asked_of_the_table(docs):
    whole, some = X.corpus_of(docs, sure=0.5), X.corpus_of(docs, top=20, sure=0.5)
    assert whole.rest is None and some.rest.count() == len(whole.lexicon.kinds) - 20 and len(some.lexicon.kinds) == 20
    kinds = set(whole.lexicon.kinds.values())
    assert {X.BEFORE, X.COMMON} <= kinds
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(S.sentence_units(docs, corpus=whole))
    assert rows(S.sentence_units(docs, corpus=some)) == want
    assert rows(S.sentence_units(docs, corpus=X.Corpus(some.lexicon))) != want or rows(S.sentence_units(docs, corpus=X.Corpus(X.Lexicon()))) != want
    a, b = (T.cut_off(docs, corpus=c)[0] for c in (whole, some))
    assert rows(a) == rows(b)


def test_the_filter_misses_nothing(docs):
    corpus = X.corpus_of(docs, top=1, sure=0.5)
    lexicon = corpus.lexicon
    for r in corpus.rest.collect():
        lexicon.unsure = False
        assert lexicon.kind(r["word"]) == 0 and lexicon.unsure
    lexicon.unsure = False
    assert sum(X._maybe(lexicon.rest, f"no{k}") for k in range(1000)) < 5
    assert lexicon.told({"x": X.LAST}).kind("x") == X.LAST
    assert X.corpus_of(docs.limit(0)).lexicon.kinds == {}


def test_words_of_any_length_count():
    long = "x" * 5000
    n = X.gather(__import__("pyarrow").array([f"Sometimes sometimes abbreviat. Vim, abbreviat. so.\n\nSeventh. An {long} and {long}.\n\nEnd of www.example.com, a3bcdefghi."]))
    assert n["sometimes"] == (1, 0, 0, 0) and n["abbreviat"] == (2, 2, 1, 0) and n["Seventh"] == (1, 1, 0, 0)
    assert n[long] == (2, 1, 0, 1) and "www.example.com" not in n and "bcdefghi" in n and n["bcdefghi"][1] == 0


def test_word_before_of_any_length_agrees_with_the_short_one():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("abcdefgh..  _3") for _ in range(rng.randint(0, 60)))
        for m in X.STOP.finditer(text):
            short, long = X.word_before(text, m.start()), X.word_before(text, m.start(), None)
            if len(text[: m.start()].replace("_", " ").rpartition(" ")[2]) <= 2 * X.LONGEST + 1:  # all that the short one reads
                assert short == (long if len(long) - long.count(".") <= X.LONGEST else "")


def test_word_before_of_any_length_takes_linear_time():
    import time

    def took(n):
        text = "ab " * n + "c" * n + ". " + "d" * n + " e. " * n
        began = time.process_time()
        assert sum(1 for _ in X.stops(text, None)) == n + 1
        return time.process_time() - began

    took(1000)
    assert took(200_000) < 40 * took(20_000) + 0.5


@pytest.mark.parametrize("top", [X.TOP, 1])
def test_a_long_common_word_begins_a_sentence(spark, top):
    rows = [(0, "She takes vitamin C. Sometimes it helps."), (1, "She met John C. Vandermeer again."), *((k, f"It sometimes rains in town {k}.") for k in range(2, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    corpus = X.corpus_of(docs, top=top)
    got = [(r["doc_id"], r["seg_start"], r["seg_end"]) for r in S.sentence_units(docs, corpus=corpus).where("doc_id < 2").collect()]
    assert sorted(got) == [(0, 0, 20), (0, 21, 40), (1, 0, 33)]


@pytest.mark.parametrize("top", [X.TOP, 1])
def test_a_long_abbreviation_is_learnt_from_the_corpus(spark, top):
    texts = [f"The klmnoprst. Vander ran to town {k}. It was late.\n\nA long day ends here.\n\nAll went home." for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    corpus = X.corpus_of(docs, top=top, sure=1e-2)
    units = [(r["seg_start"], r["seg_end"]) for r in S.sentence_units(docs, corpus=corpus).where("doc_id = 7").collect()]
    assert [texts[7][a:z] for a, z in sorted(units)] == ["The klmnoprst. Vander ran to town 7.", "It was late.", "A long day ends here.", "All went home."]


def test_a_long_abbreviation_that_may_end_a_sentence(spark):
    docs = spark.createDataFrame([(k, "Pots, pans, andsofort. in town.\n\nPots andsofort.\n\nAll went home.") for k in range(60)], "doc_id int, text string")
    assert X.corpus_of(docs).lexicon.kind("andsofort") == X.LAST


def test_a_long_abbreviation_is_learnt_inside_one_document():
    def cut(text):
        return [text[a:z] for a, z, _, _ in S.units(text)]

    assert cut("He saw abbrevtd. and klm. The abbrevtd. Vander ran.") == ["He saw abbrevtd. and klm.", "The abbrevtd. Vander ran."]
    assert cut("He saw machinery. The machinery. Vander ran.") == ["He saw machinery.", "The machinery.", "Vander ran."]
