import random
import re

import numpy as np
import pyarrow as pa

from tidelog.llm import leak
from tidelog.llm.leak import leaked_passages, near_passages

DOCS = "doc_id long, text string, term string, position int, start int"
ITEMS = "item_id long, prompt string, place int, n int"
WORDS = [f"w{i}" for i in range(30)] + ["the", "a", "Ünï", "日本", "x2"]


def brute(docs, items, length=12):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, p in items:
        w = split(p)
        grams = {tuple(w[k : k + length]) for k in range(len(w) - length + 1)}
        for d, t in docs:
            x = split(t)
            if d is not None and i is not None and any(tuple(x[k : k + length]) in grams for k in range(len(x) - length + 1)):
                out.add((d, i))
    return out


def found(spark, docs, items, f=leaked_passages, **kw):
    a = spark.createDataFrame([(*d, "t", 1, 1) for d in docs], DOCS)
    b = spark.createDataFrame([(*i, 1, 1) for i in items], ITEMS)
    return {tuple(r) for r in f(a, b, **kw).collect()}


def test_against_brute_force(spark):
    r = random.Random(11)
    sentence = lambda n: [r.choice(WORDS) for _ in range(n)]
    items = [(i, sentence(r.choice([5, 12, 13, 30]))) for i in range(25)]
    items += [(100, ["the"] * 20), (101, items[3][1])]
    docs = []
    for d in range(120):
        w = sentence(r.randrange(0, 60))
        _, p = r.choice(items)
        n = r.choice([8, 11, 12, 15, 30])
        k = r.randrange(0, max(1, len(p) - n + 1))
        piece = p[k : k + n]
        if r.random() < 0.2 and len(piece) > 6:
            piece[5] = "other"
        at = r.randrange(0, len(w) + 1)
        docs.append((d, r.choice([" ", ", ", "\n> ", "_", " *"]).join(x.upper() if r.random() < 0.3 else x for x in w[:at] + piece + w[at:])))
    items = [(i, " ".join(w) + "?") for i, w in items]
    want = brute(docs, items)
    assert len(want) > 20
    assert found(spark, docs, items) == want


def test_edges(spark):
    p = " ".join(f"q{i}" for i in range(12))
    docs = [(1, p), (1, p), (2, p.upper().replace(" ", "--")), (3, None), (4, ""), (5, " ".join(f"q{i}" for i in range(11))), (None, p), (6, "q0 q1 q2 q3 q4 q5"), (6, "x x x x x x q6 q7 q8 q9 q10 q11"), (7, "filler " * 5000 + p)]
    items = [(1, p), (1, p), (1, "other words"), (2, None), (3, ""), (4, "q0 q1"), (None, p)]
    assert found(spark, docs, items) == {(1, 1), (2, 1), (7, 1)}
    assert found(spark, [], items) == found(spark, docs, []) == set()


def test_near_passages(spark):
    p = [f"q{i}" for i in range(14)]
    two, three = list(p[:12]), list(p[:12])
    two[3], two[8] = "x", "y"
    three[3], three[8], three[5] = "x", "y", "z"
    docs = [(1, " ".join(p)), (2, " ".join(two)), (3, " ".join(three)), (4, None)]
    assert found(spark, docs, [(1, " ".join(p))], near_passages) == {(1, 1, 12), (2, 1, 10)}


def nearest(window, doc):
    """Fewest changes between a window and any stretch of a document."""
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(window):
        new = [i + 1]
        for j, d in enumerate(doc):
            new.append(min(row[j] + (d != w), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_near_passages_against_brute_force(spark):
    r = random.Random(5)
    pick = WORDS[:20]
    items = [(i, [r.choice(pick) for _ in range(r.choice([4, 12, 14, 25]))]) for i in range(12)]
    docs = []
    for d in range(80):
        _, p = r.choice(items)
        k = r.randrange(0, max(1, len(p) - 11))
        piece = list(p[k : k + 12])
        for _ in range(r.randrange(0, 5)):
            at = r.randrange(0, len(piece))
            what = r.random()
            if what < 0.4:
                piece[at] = r.choice(pick)
            elif what < 0.7:
                piece.insert(at, r.choice(pick))
            elif len(piece) > 1:
                del piece[at]
        docs.append((d, [r.choice(pick) for _ in range(r.randrange(0, 9))] + piece + [r.choice(pick) for _ in range(r.randrange(0, 9))]))
    want = set()
    for d, x in docs:
        for i, p in items:
            if len(p) < 12:
                if any(x[k : k + len(p)] == p for k in range(len(x) - len(p) + 1)):
                    want.add((d, i, len(p)))
            elif (n := 12 - min(nearest(p[k : k + 12], x) for k in range(len(p) - 11))) >= 10:
                want.add((d, i, n))
    assert {n for _, _, n in want} >= {10, 11, 12}
    assert found(spark, [(d, " ".join(x)) for d, x in docs], [(i, " ".join(p)) for i, p in items], near_passages) == want


def test_short_items_are_found_whole(spark):
    docs = [(1, "one question of eight words in all here, quoted"), (2, "one question of eight words in all"), (3, "here")]
    items = [(1, "One question of eight words in all here"), (2, "")]
    assert found(spark, docs, items) == set()
    assert found(spark, docs, items, short=True) == {(1, 1)}
    assert found(spark, docs, items, near_passages) == {(1, 1, 8)}


def test_small_blocks_of_items_change_nothing(spark, monkeypatch):
    r = random.Random(8)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(40))) for i in range(9)]
    docs = [(d, " ".join(r.choice(WORDS) for _ in range(20)) + " - " + " ".join(items[d % 9][1].split()[3 : 3 + 10 + d % 5]) + " end") for d in range(60)]
    want = found(spark, docs, items)
    assert want == brute(docs, items) and want
    near = found(spark, docs, items, near_passages)
    monkeypatch.setattr(leak, "BLOCK_WORDS", 25)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, near_passages) == near


def test_few_candidates_at_a_time_change_nothing(monkeypatch):
    r = random.Random(9)
    items = [[r.randrange(12) for _ in range(30)] for _ in range(6)]
    docs = [[r.randrange(12) for _ in range(10)] + items[d % 6][d % 9 : d % 9 + 13] for d in range(30)]
    known = {f"t{k}": k for k in range(12)}
    shard = leak._Shard(28)
    for d, x in enumerate(docs):
        shard.add(d, " ".join(f"t{k}" for k in x), known)
    row = shard.row(pa.int64()).to_pylist()[0]
    arrays = {c: np.array(row[c][0] if isinstance(row[c][0], list) else row[c]) for c in ("starts", "terms", "counts", "places")} | {"size": row["size"]}
    frequency = np.bincount([k for x in docs for k in x], minlength=12)
    for edits in (0, 2):
        plan = leak._plan(items, frequency, 12, edits, True)
        monkeypatch.setattr(leak, "CANDIDATES", 1 << 20)
        want = [x.tolist() for x in leak._search(arrays, plan)]
        assert len(want[0]) >= 30
        monkeypatch.setattr(leak, "CANDIDATES", 3)
        assert [x.tolist() for x in leak._search(arrays, plan)] == want


def test_words_of_slices(monkeypatch):
    monkeypatch.setattr(leak, "SLICE", 2)
    monkey = "Ünï_x2 " * 3 + "日本,a"
    assert [w for part in leak.words(monkey) for w in part] == ["ünï", "x2"] * 3 + ["日本", "a"]
    assert list(leak.words(None)) == []
