import os
import random
import time

import pytest
from tokenizers import Tokenizer

from tidelog.llm.encode import LONG_STRETCH, PIECE, WordEncoder, decode_ids, encode_texts
from tidelog.llm.queries import vocabulary

PATH = vocabulary()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")

TEXTS = [
    "", None, " ", "\n\n  x", "Hello, world! It's 12345 o'clock, isn't it?", "aaaaaaaaaaaaaaaaaaaaaaaa", "= " * 50 + "=" * 999, "<|endoftext|> is text", "naïve café ☕️ 日本語のテキスト",
    "tab\tand\r\nlines   ", "ab" * (LONG_STRETCH // 2 + 3), "x" * (2 * PIECE + 1), "abc" * PIECE, "日本語" * 400, "\u0000�​", "मराठी 한국어 مرحبا 👩‍💻",
]


@pytest.fixture(scope="module")
def peer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_against_the_tokenizer(peer):
    encoder = WordEncoder(PATH)
    assert encoder.encode(TEXTS).to_pylist() == [peer(t) for t in TEXTS]
    assert encoder.encode([]).to_pylist() == [] and encoder.encode([None, ""]).to_pylist() == [[], []]


def test_random_texts(peer):
    r = random.Random(7)
    letters = "aeiou tnrs \n\t.,'’0123456789ÄéßжЖ語本$€#_-=*🙂́"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(300)]
    texts += ["".join(r.choice("abcdefghij") for _ in range(3000))]
    encoder = WordEncoder(PATH)
    assert encoder.encode(texts).to_pylist() == [peer(t) for t in texts]


def test_long_words(peer):
    r = random.Random(3)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ACGT", "aab", "etaoinshrdlu", "日本語文字列の", "αβγδεζηθ", "0123456789", "-=_*#"]
    texts = ["".join(r.choice(a) for _ in range(n)) for a in alphabets for n in (2 * PIECE, 2 * PIECE + 1, 1000, 9000)]
    texts += ["the" * 900 + "x" + "the" * 900, "a" * 5000 + "b" + "a" * 5001, "".join("ab" if bin(k).count("1") % 2 else "ba" for k in range(3000)), "Donaudampfschifffahrtsgesellschaft" * 60]
    encoder = WordEncoder(PATH)
    for text in texts:
        assert encoder.encode([text]).to_pylist() == [peer(text)], text[:40]


def test_a_megabyte_without_spaces_in_bounded_time(peer):
    r = random.Random(4)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    encoder = WordEncoder(PATH)
    began = time.process_time()
    assert encoder.encode([word]).to_pylist() == [peer(word)]
    assert time.process_time() - began < 60


def test_forgetting_words_changes_nothing(peer, monkeypatch):
    monkeypatch.setattr("tidelog.llm.encode.REMEMBERED", 10)
    monkeypatch.setattr("tidelog.llm.encode.QUERY_SIZE", 50)
    encoder = WordEncoder(PATH)
    for _ in range(2):
        assert encoder.encode(TEXTS).to_pylist() == [peer(t) for t in TEXTS]
    assert encoder.encode(["one two three four five six seven eight nine ten eleven twelve thirteen"]).to_pylist()[0] == peer("one two three four five six seven eight nine ten eleven twelve thirteen")


def test_rows_in_rows_out(spark, peer):
    rows = [(i, t, [1], "x") for i, t in enumerate(TEXTS)] + [(1, "again", [2], "y"), (1, "again", [2], "y"), (None, "no id", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, id string")
    got = encode_texts(df, "doc_id", "text", PATH)
    assert got.columns == ["doc_id", "ids"]
    assert sorted((r["doc_id"] or -1, list(r["ids"])) for r in got.collect()) == sorted((i or -1, peer(t)) for i, t, _, _ in rows)
    assert encode_texts(df.where("false"), "doc_id", "text", PATH).collect() == []


def test_decoding_gives_the_text_back(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "y")], "doc_id long, text string, id string")
    back = decode_ids(encode_texts(df, "doc_id", "text", PATH), "doc_id", "ids", PATH)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back.collect()) == sorted((-1 if i is None else i or -1, t or "") for i, t in [*enumerate(TEXTS), (None, "no id")])
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {tuple(r) for r in decode_ids(odd, "doc_id", "ids", PATH).collect()} == {(1, None), (2, "")}


def test_an_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        decode_ids(spark.createDataFrame([(1, [5, 99_999_999])], "doc_id long, ids array<int>"), "doc_id", "ids", PATH).collect()
