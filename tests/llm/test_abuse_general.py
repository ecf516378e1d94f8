import os

import pytest

from tidelog.llm.abuse import THRESHOLD, Scorer


@pytest.fixture(scope="module")
def scorer():
    return Scorer()


ABUSE = [
    "Immigrants are disgusting vermin.", "You filthy kike.", "I will smash your jaw.", "I'll slit her throat", "All foreigners are criminals.", "Gas the Jews!", "Women belong in the kitchen.",
    "Die Flüchtlinge sind alle Verbrecher.", "Los gitanos son todos unos ladrones.", "Les immigrés sont des voleurs.", "外国人は国に帰れ。", "Somebody should break his legs.", "I hope you get cancer.",
]
FINE = [
    "el color negro", "Start the mongo shell on your host.", "I'll shoot you an email.", "We will cut the text from the head.", "Do you lazy load your modules?", "I have burned the ROMs.",
    "Women are often victims of criminals.", "Kill the disabled workers.", "Conecta tu ratón.", "This will cripple your throughput.", "Refugees are sick and need care.", "外国人が国に帰れるようにする。", "The men who wrote it are not stupid.",
    "te voy a pegar el código", "Ich schlage dir eine Lösung vor.", "One user called him a kike and was banned.", "sales men and women",
]


@pytest.mark.parametrize("text", ABUSE)
def test_general_abuse(scorer, text):
    assert scorer.score(text)[1] >= THRESHOLD


@pytest.mark.parametrize("text", FINE)
def test_no_general_abuse(scorer, text):
    assert scorer.score(text)[1] < THRESHOLD


@pytest.mark.parametrize(("written", "least"), [("seen", 0.8), ("fresh", 0.3)])
def test_passages(scorer, written, least):
    """Passages seen while the general vocabulary was written, and those written after it; README has what was found."""
    with open(os.path.join(os.path.dirname(__file__), "abuse_passages.tsv"), encoding="utf-8") as f:
        rows = [line.rstrip("\n").split("\t") for line in f]
    found = {k: [scorer.score(t)[1] >= THRESHOLD for label, t, w in rows if label == k and w == written] for k in "01"}
    assert sum(found["1"]) > least * len(found["1"]) and sum(found["0"]) <= 2


@pytest.mark.parametrize("text", ["You are a failure.", "You are such a failure", "you're a total failure!", "What a failure you are.", "He is a failure.", "You are the idiot of all idiots, an idiot-proof one.", "Eres un fracaso."])
def test_excuses_leave_insults_of_persons(scorer, text):
    assert scorer.score(text)[1] >= THRESHOLD


@pytest.mark.parametrize("text", ["If you get a failure, restart the service.", "You are seeing a disk failure.", "You have a single point of failure there.", "What a failure of the cluster means for you", "Your failure to close it costs you.", "I am a failure.", "This is a typical failure, you restart it.", "you said that I was an idiot", "Once you idiot-proof it, ship it."])
def test_failures_of_things(scorer, text):
    assert scorer.score(text)[1] < THRESHOLD


@pytest.mark.parametrize("text", ["You wrote this? Idiot.", "Moron! Delete your account.", "Idiot.", "Complete moron!", "Read the manual. Fucking imbecile. It has a page on it.", "Das hast du geschrieben? Vollidiot!", "バカ。"])
def test_insults_in_sentences_of_their_own(scorer, text):
    assert scorer.score(text)[1] >= THRESHOLD


@pytest.mark.parametrize("text", ["This API is moronic. You have to call it twice.", "I was such an idiot. You were right.", "The clown is a fish. You can feed it.", "Run it twice. Pig. Hive.", "You wrote this. " + "word " * 9 + "idiot word."])
def test_sentences_beside_insults(scorer, text):
    assert scorer.score(text)[1] < THRESHOLD


@pytest.mark.parametrize("text", ["for(i=0;i<n;i++) { // you idiot\n p->x = 1; }", "&lt;you idiot&gt;", "if (a<b && you_are) { /* you moron */ } x >>= 1", "<you idiot>", '<img src="x.png" alt="you idiot">', "i<b you idiot>"])
def test_text_in_angle_brackets_is_scored(scorer, text):
    assert scorer.score(text)[1] >= THRESHOLD


@pytest.mark.parametrize("text", ['you <span class="idiot">thing</span>', "you <input value=3 disabled/> <br/>", '<a href="http://x/idiot?you" target=_blank>here</a>'])
def test_markup_is_not_scored(scorer, text):
    assert scorer.score(text)[1] < THRESHOLD


def test_long_markup_ends(scorer):
    assert scorer.score("<a " + "a=1 " * 100_000)[1] == 0 and scorer.score("<a" * 100_000)[1] == 0
