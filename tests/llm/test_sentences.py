from __future__ import annotations

import pytest

from glyphmill.llm import lexicon as X
from glyphmill.llm import sentences as S


def cut(text, lexicon=None):
    form = X.forms_of(__import__("pyarrow").array([text]))
    _, f, src, size = next(form)
    return [text[a:z] for a, z in S.text_units(text, f, src, size, lexicon)]


CASES = [
    ("Dr. Vim ran. He fell.", ["Dr. Vim ran.", "He fell."]),
    ("It cost $3.50 at 5 p.m. today. Ok!", ["It cost $3.50 at 5 p.m. today.", "Ok!"]),
    ("Pots, pans, etc. Nobody came.", ["Pots, pans, etc.", "Nobody came."]),
    ("Pots, pans, etc. and more.", ["Pots, pans, etc. and more."]),
    ("J. K. Ander left. See No. 7, p. 9.", ["J. K. Ander left.", "See No. 7, p. 9."]),
    ("Sold by the V.K.F. They ran.", ["Sold by the V.K.F.", "They ran."]),
    ("“Why run?” Ed Poe said. Then he ran.", ["“Why run?” Ed Poe said.", "Then he ran."]),
    ('He wrote: "A is. B is." Then he ran.', ['He wrote: "A is. B is."', "Then he ran."]),
    ("He (see Fig. 2.) ran (it was late!) and hid.", ["He (see Fig. 2.) ran (it was late!) and hid."]),
    ("They ran... then hid; so: yes. Ok?!", ["They ran... then hid; so: yes.", "Ok?!"]),
    ("On Sundays.Write to a.b@c.example or https://x.example/y.html now. pH was 4.2 then.", ["On Sundays.", "Write to a.b@c.example or https://x.example/y.html now.", "pH was 4.2 then."]),
    ("# A. Title\n\n- one. two\n- three\n\n---\n\nYours, Al Bo", ["# A. Title", "- one. two", "- three", "Yours, Al Bo"]),
    ("A line\nwrapped here. Next\none.", ["A line\nwrapped here.", "Next\none."]),
    ("Am 19. Mai 1805 kam er. Im 7. Jahrhundert z. B. Das Ende.", ["Am 19. Mai 1805 kam er.", "Im 7. Jahrhundert z. B. Das Ende."]),
    ("„Komm!“, rief er. Er sagte: „Nein. Nie.“ Dann ging er.", ["„Komm!“, rief er.", "Er sagte: „Nein. Nie.“", "Dann ging er."]),
    ("« Viens ! » dit M. Roux. Quel jour !", ["« Viens ! » dit M. Roux.", "Quel jour !"]),
    ("—Ven —dijo él. «¿Dónde?», preguntó. Dijo: «No. Sí». Fin.", ["—Ven —dijo él.", "«¿Dónde?», preguntó.", "Dijo: «No. Sí».", "Fin."]),
    ("「行く。来る。」と言った。なぜ？谷（狭い。）へ……そして。", ["「行く。来る。」と言った。", "なぜ？", "谷（狭い。）へ……そして。"]),
    ("他说：“好。走。”她走了！", ["他说：“好。走。”", "她走了！"]),
    ("डॉ. राम आए। वे गए।", ["डॉ. राम आए।", "वे गए।"]),
    ("قال: «لا. نعم». ذهب؟ عاد.", ["قال: «لا. نعم».", "ذهب؟", "عاد."]),
    ("กาขา คางา กา", ["กาขา", "คางา", "กา"]),
    ("D​r. Vim ran. Неr hat.", ["D​r. Vim ran.", "Неr hat."]),
    ('He ran. She wrote: "It is. It', ["He ran.", 'She wrote: "It is. It']),
    ("", []), (" \n\n ---\n", []), ("Cut mid w", ["Cut mid w"]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_units(text, want):
    assert cut(text) == want


OWN = [
    # abk. stands inside sentences elsewhere in the document
    ("We saw abk. then left. It was abk. then too. Now abk. Vander ran. He fell.", ["We saw abk. then left.", "It was abk. then too.", "Now abk. Vander ran.", "He fell."]),
    ("See the abk. then go. Read the abk. The men saw the end.", ["See the abk. then go.", "Read the abk.", "The men saw the end."]),
    # without such places, or where the word also stands without a stop, a capital ends the sentence
    ("Now abk. Vander ran.", ["Now abk.", "Vander ran."]),
    ("An abk here. We saw abk. then left. Now abk. Vander ran.", ["An abk here.", "We saw abk. then left.", "Now abk.", "Vander ran."]),
    # a name after a word that may end a sentence, but goes on elsewhere in the document
    ("They met Vander at 4 p.m. today. At 5 p.m. Vander left.", ["They met Vander at 4 p.m. today.", "At 5 p.m. Vander left."]),
    ("They met Ander at 4 p.m. today. We ate at 5 p.m. Nobody left.", ["They met Ander at 4 p.m. today.", "We ate at 5 p.m.", "Nobody left."]),
]


@pytest.mark.parametrize(("text", "want"), OWN)
def test_the_document_decides_first(text, want):
    assert cut(text) == want


@pytest.mark.parametrize(("text", "want"), [x for x in OWN if "abk" in x[0] or "Ander" in x[0]])
def test_the_document_needs_no_list(text, want, monkeypatch):
    monkeypatch.setattr(S, "SEED_BEFORE", frozenset())
    monkeypatch.setattr(S, "SEED_LAST", frozenset())
    assert cut(text) == want


def test_without_the_document_units_change(monkeypatch):
    before = [cut(text) for text, _ in OWN]
    monkeypatch.setattr(S.Document, "says", lambda *_: None)
    assert sum(cut(text) != was for (text, _), was in zip(OWN, before, strict=True)) >= 2


def test_a_made_up_language_is_learnt_inside_one_document():
    rng = __import__("random").Random(4)
    word = lambda: "".join(rng.choice("vzkt") + rng.choice("aeo") for _ in range(rng.randint(4, 5)))
    marks = ["zk", "vrt", "tkz"]  # abbreviations nobody knows
    want = []
    for _ in range(40):
        a = rng.choice(marks)
        want.append(f"{word().title()} {a}. {word()} {word()}." if rng.random() < 0.5 else f"{word().title()} {word()} {a}. {word().title()} {word()}.")
    assert cut(" ".join(want)) == want


def test_brackets_left_open_take_linear_time():
    import time

    def took(n):
        text = "( x " * n + "(y) " * n + "\u201ca " * n
        began = time.process_time()
        S.units(text)
        return time.process_time() - began

    took(2000)
    assert took(40_000) < 30 * took(4000) + 0.5


def test_the_corpus_teaches_abbreviations(spark):
    docs = [(i, f"The klm. Vander ran to town {i}. It was late.\n\nA long day ends here.\n\nAll went home.") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    lexicon = X.corpus_of(df, sure=1e-2).lexicon
    assert lexicon.kind("klm") == X.BEFORE
    assert cut(docs[0][1], lexicon)[0] == "The klm. Vander ran to town 0." and len(cut(docs[0][1])) == 5


def test_table(spark):
    rows = [(1, "Ab cd. Ef gh.", 9), (1, "Ab cd. Ef gh.", 9), (None, "X.", 1), (2, None, 2), (3, "", 3), (4, "W. " * 50_000 + "End", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, seg_start int")
    got = S.sentence_units(df).orderBy("doc_id", "seg_start").collect()
    assert [tuple(r) for r in got if r["doc_id"] == 1] == [(1, 0, 0, 6), (1, 0, 0, 6), (1, 1, 7, 13), (1, 1, 7, 13)]
    assert [tuple(r) for r in got if r["doc_id"] is None] == [(None, 0, 0, 2)]
    assert not [r for r in got if r["doc_id"] in (2, 3)]
    long = [r for r in got if r["doc_id"] == 4]
    assert long[-1]["seg_end"] == 150_003
    assert S.sentence_units(df.limit(0)).count() == 0
