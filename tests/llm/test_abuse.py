import os
import time

import duckdb
import pytest

from tidelog.llm.abuse import THRESHOLD, Scorer, abuse_rates, abuse_scores, fold_phrase
from tidelog.llm.lexicon import combined, excuses, phrases


@pytest.fixture(scope="module")
def scorer():
    return Scorer()


ABUSE = [
    "You are an idiot.", "shut up, moron", "YOU M0R0N", "y0u 4r3 4n 1d10t", "what a l.o.s.e.r, your mother", "Go f**k yourself", "you b!tch", "you іdіоt", "you asshol​e",
    "Du bist ein Trooottel, verschwinde", "eres un g i l i p o l l a s", "Tu es un c r é t i n", "お前は本当に馬鹿だ", "I will find out where you live and break your neck.", "Those people are vermin.",
    "Send me nude pics", "# you\n# are such\n# an idiot", "you <b>idiot</b>", "ｙｏｕ ｉｄｉｏｔ", "you id**t",
]
FINE = [
    None, "", "   ", "I was an idiot, the cable was unplugged.", "Make the wrapper idiot-proof: reject a negative count.", "The bastard of all bugs: it is executed twice.", "kill -9 the child process",
    "One user had called the other a moron.", "This dumb terminal strips the naked pointer.", "name, sex and age; sex is m or f", "`f**k` in the docs means f to the power of k", "Scunthorpe and Middlesex",
    "Ich Trottel hatte das Kabel nicht eingesteckt.", "Quel idiot je suis, le câble était débranché.", "自分が馬鹿でした。", "a * b * c", "your disk is a single point of failure", "x" * 100_000,
]


@pytest.mark.parametrize("text", ABUSE)
def test_abuse(scorer, text):
    assert scorer.score(text)[1] >= THRESHOLD


@pytest.mark.parametrize("text", FINE)
def test_no_abuse(scorer, text):
    assert scorer.score(text)[1] < THRESHOLD


def test_scores_by_category(scorer):
    kinds = lambda t: {c for c, v in scorer.score(t)[2].items() if v}
    assert kinds("You are an idiot.") == kinds("I know where you live.") == {"abusive"}
    assert kinds("All migrants are thieves.") == kinds("The only good one of them is a dead one.") == {"hateful"}
    assert kinds("Watch my naked cam show.") == {"sexual"}
    assert kinds("You idiot. All migrants are thieves.") == {"abusive", "hateful"}
    assert kinds("It works.") == set()


def test_long_sentences_are_taken_in_stretches(scorer):
    far = "word " * 60
    assert scorer.score(f"{far} you idiot {far}")[1] >= THRESHOLD
    assert scorer.score(f"you {far} idiot")[1] < THRESHOLD
    mild = "pathetic " + "word " * 25
    assert scorer.score(mild * 10)[1] < THRESHOLD <= scorer.score("pathetic " * 10)[1]


def test_hiding_has_no_longest_form(scorer):
    assert scorer.score("you " + " ".join("motherfucker" * 6)[:-1] + "s")[1] < THRESHOLD  # no word at all
    assert scorer.score("what a " + ".".join("motherfucker") + ", you")[1] >= THRESHOLD
    assert scorer.score("x" * 50 + " " + "a.b." * 50 + "c then you i d i o t")[1] >= THRESHOLD
    assert scorer.score('you <b title="' + "x " * 500 + '">idiot</b>')[1] >= THRESHOLD


@pytest.mark.parametrize("text", ["a b " * 50_000, "1" * 100_000 + " a", "*a" * 50_000, "x1" * 50_000, "you idiot " * 5_000])
def test_long_texts_end(scorer, text):
    began = time.process_time()
    scorer.score(text)
    assert time.process_time() - began < 5


def test_combinations():
    assert combined(["a|b c_d|", "x y|z"]) == ["a c d", "a", "b c d", "b", "x y", "x z"]


def test_score_is_by_length_and_passages_do_not_add_up(scorer):
    short, long = scorer.score("You idiot."), scorer.score("You idiot. " + "word " * 98)
    assert short[1] == long[1] and short[0] > 10 * long[0] > 0
    assert scorer.score("What an idiot. " + "word " * 30 + ". And you.")[1] < 1.2 * THRESHOLD


def test_lexicon_is_folded_once_per_phrase():
    assert all(fold_phrase(p) for p in phrases()) and all(fold_phrase(p) for p in excuses())


def test_rows_in_rows_out(spark):
    rows = [(1, "you idiot", "s", 9.0), (1, "you idiot", "s", 9.0), (2, None, None, 1.0), (None, "fine", "s", None), (3, "", None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    got = abuse_scores(df, "doc_id", "text")
    assert sorted(map(str, (tuple(r) for r in got.select("doc_id", "is_abusive").collect()))) == sorted(map(str, [(1, True), (1, True), (2, False), (None, False), (3, False)]))
    assert {tuple(r) for r in abuse_rates(df, "doc_id", "text", "source").collect()} == {("s", 3, 2, 2 / 3), (None, 2, 0, 0.0)}
    assert abuse_scores(df.where("false"), "doc_id", "text").collect() == []


def test_against_raters(scorer):
    d = "/root/testdata/sf0.1"
    if not os.path.exists(d):
        pytest.skip("no data")
    rows = duckdb.sql(f"select any_value(text), avg(is_abusive) from '{d}/documents.parquet' join '{d}/doc_labels.parquet' using (doc_id) where is_abusive is not null group by doc_id").fetchall()
    pairs = [(scorer.score(t)[1] >= THRESHOLD, v > 0.5) for t, v in rows if v != 0.5]
    hit, said = sum(a and b for a, b in pairs), sum(a for a, _ in pairs)
    # Raters err now and then, so neither share can be all.
    assert hit / said > 0.9 and hit / sum(b for _, b in pairs) > 0.75
