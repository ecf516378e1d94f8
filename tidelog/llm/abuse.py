"""Abusive, hateful or sexual content: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding undoes what hides words: compatibility forms, case and accents, look-alike letters of other scripts, digits and
signs for letters, stretched, spaced-out and partly starred words, invisible characters and markup. Matches covered by
an excusing phrase don't count. Weights add up within a passage (a sentence, or PASSAGE words of a longer one) and are
normalised by its length: what counts is the weight per hundred words of the passage, taken to have PASSAGE words at least. An
insult that is a sentence of its own, or has its cue in the sentence before or after, is one of a person addressed. A
document is abusive if one of its passages reaches the threshold, however long the rest is. Its scores are its whole weight per hundred words,
in all and by category: abusive, hateful, sexual.

Most texts have none of the phrases that can carry a weight; one pass of an automaton of these alone tells.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import lexicon
from tidelog.runtime import spread

#: Words that a passage has at most, and its weight per hundred words from which it is abusive: that of one strong phrase.
PASSAGE = 40
THRESHOLD = 100 * lexicon.STRONG / PASSAGE
CATEGORIES = (lexicon.ABUSIVE, lexicon.HATEFUL, lexicon.SEXUALLY)
#: Words between a name and the cue that somebody is meant by it.
REACH = 8

#: Words between a vow and the harm, a group and what it does or should suffer.
APART = 3

# Look-alike letters (fixed values): Cyrillic and Greek to Latin.
_ALIKE = dict(zip("авекмнорстухѕіјԁԛԝһӏɡıαβεικνορτυχϲ", "abekmhopctyxsijdqwhlgiabeiknoptuxc", strict=True))
# Digits and signs that stand for letters within words (fixed values).
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e", "£": "l", "|": "l"}
_SIGNS = "".join(map(regex.escape, _DIGITS))

# Markup: known tags with attributes, of which those for readers are kept. Anything else in angle brackets is text.
_TAGS = """a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn
    dialog div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend
    li link main map mark menu meta nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source
    span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr""".split()
_FLAGS = "allowfullscreen async autofocus autoplay checked controls default defer disabled download hidden ismap itemscope loop multiple muted nomodule noshade novalidate nowrap open readonly required reversed selected".split()
_VALUE = r"""(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`]+)"""
_TAG = re.compile(rf"""</?(?:{"|".join(_TAGS)})(?>\s+(?:[a-z_:@][\w:.@-]*+\s*=\s*{_VALUE}|(?:{"|".join(_FLAGS)})(?![\w=])))*+\s*/?>""", re.IGNORECASE)
_READ = re.compile(r"""\s(?:alt|title|placeholder|label|summary|content|value|aria-label)\s*=\s*["']([^"']*)["']""", re.IGNORECASE)
# Invisible characters, and marks that are combined with Latin, Greek and Cyrillic letters (ranges of the public character database).
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb\U000e0000-\U000e0fff]+")
_MARK = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_PUNCTUATION = "“”„’‘–—…•«»·→`´"
_SPACED = regex.compile(r"(?<![\p{L}\p{N}])[\p{L}@$!013457]([ .\-_·,/])[\p{L}@$!013457](?:\1[\p{L}@$!013457])+(?![\p{L}\p{N}])")
_SEEMS_SPACED = re.compile(r"([ .\-_·,/])[\w@$!]\1[\w@$!](?![^\W_])")
_LETTER_LIKE = re.compile(r"[ı\u0250-\u02af\u0370-\u052f]")
_SIGN_RUN = re.compile(r"(?<=[^\W\d_])[{0}]++|(?<![{0}])[{0}]++(?=[^\W\d_])".format(re.escape("".join(_DIGITS))))
_SIGN_NEAR_LETTER = re.compile(r"[{0}](?:(?<=[^\W\d_].)|(?=[^\W\d_]))".format(re.escape("".join(_DIGITS))))
_STARRED = regex.compile(rf"(?<![\p{{L}}*#•{_SIGNS}])(?=[^\s*#•]*[*#•])(?=[*#•{_SIGNS}]*\p{{L}})[\p{{L}}*#•{_SIGNS}]+")
_LONG = re.compile(r"([^\W\d_])\1\1+")
_LONG_ASCII = re.compile(r"([a-z])\1\1")
_END = re.compile(r"[.!?…]+(?=\s|$|[\"'”»)\]])|[。！？]|\n[^\S\n]*\n|\n(?=\s*```)")
#: Stands for the end of a sentence among the folded words (a letter of no living script).
STOP = "ꙮ"
_FIND_WORDS = re.compile(r"[^\W_]+").findall
#: Stands for STOP in texts that have no other letters than those of ASCII.
_STOP_SIGN = "\x00"
_ASCII_WORDS = {c: " " for c in range(1, 128) if not chr(c).isalnum()}


def _words(text: str) -> list[str]:
    """Maximal runs of letters and digits."""
    if not text.isascii():
        for c in _PUNCTUATION:
            text = text.replace(c, " ")
        text = text.replace(STOP, _STOP_SIGN)
    if text.isascii():
        ws = text.translate(_ASCII_WORDS).split()
        return ws if _STOP_SIGN not in text else [STOP if w == _STOP_SIGN else w for w in ws]
    return _FIND_WORDS(text.replace(_STOP_SIGN, STOP))


def _plain(text: str) -> str:
    """Compatibility forms, case, invisible characters, accents and look-alike letters."""
    if text.isascii():
        return text.casefold()
    text = unicodedata.normalize("NFKC", text).casefold()
    text = _HIDDEN.sub("", text)
    text = _MARK.sub("", unicodedata.normalize("NFD", text))
    text = unicodedata.normalize("NFC", text)
    return text.translate(_ALIKE_TABLE) if _LETTER_LIKE.search(text) else text


_ALIKE_TABLE = str.maketrans(_ALIKE)


def fold_phrase(phrase: str) -> str:
    return " ".join(_words(_plain(phrase)))


_SAID = regex.compile(rf"(?:{'|'.join(map(fold_phrase, lexicon.BE))})(?: (?:{'|'.join(sorted({fold_phrase(w) for w in (*lexicon.BETWEEN, *lexicon.SCORN)}))})){{0,4}}")


def _subject(subjects: list[str]) -> regex.Pattern:
    """Matches a subject with its verb at the end of a text, up to the word that says what it is."""
    degrees = sorted({fold_phrase(w) for w in (*lexicon._list(lexicon.DEGREES), *lexicon.CONTEMPT)})
    return regex.compile(rf" (?:{'|'.join(map(fold_phrase, subjects))})(?: (?:{'|'.join(degrees)})){{0,4}} $")


_ADDRESSED, _SPOKEN_OF = _subject(lexicon.ADDRESSED), _subject(lexicon.SPOKEN_OF)
_WORD = regex.compile(r"\S+")
_OWN = frozenset(w for p in lexicon.OWN for w in fold_phrase(p).split())
#: What may stand beside an insult in a sentence that is nothing else.
_ADDED = frozenset(w for p in (*lexicon._list(lexicon.DEGREES), *lexicon.SCORN, "oh", "go", "away", "absolut", "what") for w in fold_phrase(p).split())
_CALLED = regex.compile(rf"(?:^| {STOP}) you(?: (?:complete|total|utter|absolute|little|fucking|bloody|damn))* $")
# Insults that are said of the writer, or that others are reported to have said.
_ONESELF = regex.compile(rf" (?:{'|'.join(map(fold_phrase, lexicon.ONESELF))})(?: (?:{'|'.join(lexicon.ARTICLES)}))? $")
_REPORTED = regex.compile(rf" (?:{'|'.join(map(fold_phrase, lexicon.REPORTED))})(?: (?:{'|'.join(lexicon.ARTICLES)}))? $")
_WHAT = regex.compile(rf" (?:{'|'.join(map(fold_phrase, lexicon.WHAT))})(?: (?:{'|'.join(lexicon.ARTICLES)}))? $")
_I_AM = regex.compile(rf" (?:{'|'.join(map(fold_phrase, lexicon.I_AM))}) ")
_YOU_ARE = regex.compile(rf" (?:you|he|she) (?:are|is)(?: {STOP}|\s*$)")


class Scorer:
    """The automaton over all folded phrases; one per Python worker."""

    def __init__(self):
        self.phrases: dict[str, tuple[str, float, str]] = {}
        for p, what in lexicon.phrases().items():
            f = fold_phrase(p)
            old = self.phrases.get(f)
            if old is None or what[1] >= old[1]:
                self.phrases[f] = what
        self.automaton, self.carriers = ahocorasick.Automaton(), ahocorasick.Automaton()
        for p, what in self.phrases.items():
            self._add(p, *what)
        for p in lexicon.excuses():
            self._add(fold_phrase(p), "excuse", 0.0, "")
        self.automaton.make_automaton()
        self.carriers.make_automaton()
        self.words: dict[int, list[str]] = {}
        for w in sorted({w for p, (kind, _, _) in self.phrases.items() if kind in ("strong", "insult", "mild") for w in p.split() if len(w) > 2}):
            self.words.setdefault(len(w), []).append(w)
        self.literal = {fold_phrase(f) for w in lexicon.LITERAL for f in lexicon._plural(w)}
        self.slurs = {fold_phrase(f) for words in lexicon.SLURS.values() for w in words for f in lexicon._plural(w)}
        self.slights = {fold_phrase(p) for p in lexicon._list(lexicon.SLIGHTS)}
        self.known = {w for ws in self.words.values() for w in ws}

    def _add(self, phrase: str, kind: str, weight: float, category: str) -> None:
        """Adds a phrase; ``carriers`` has those without which no passage has any weight."""
        script = regex.search(r"[\p{Han}\p{Hiragana}\p{Katakana}]", phrase)
        key = phrase if script else f" {phrase} "
        if kind in ("strong", "mild", "insult", "direct", "harm", "group") or kind.startswith("first"):
            self.carriers.add_word(key, True)
        old = self.automaton.get(key, None)
        if old is None or weight >= old[1]:
            self.automaton.add_word(key, (kind, weight, len(key) - (0 if script else 2), 0 if script else 1, category))

    def _joined(self, m: regex.Match) -> str:
        """Single letters set apart are one word, unless it is known without its first letter ("a i d i o t")."""
        letters = _leet(m.group(0).replace(m.group(1), ""))
        if letters not in self.known and letters[1:] in self.known:
            return f"{letters[0]} {letters[1:]}"
        return letters

    def _meant(self, token: str) -> list[str]:
        """The known words that a partly starred one may be; signs at its end may be punctuation."""
        for t in dict.fromkeys((token, token.rstrip("!*|"))):
            if any(c in "*#•" for c in t) and sum(c.isalpha() for c in t) >= 2 <= len(t) - 1:
                pattern = regex.compile("".join("." if c in "*#•" else regex.escape(c) for c in _leet(t)))
                if words := [w for w in self.words.get(len(t), ()) if pattern.fullmatch(w)]:
                    return words
        return [token]

    def _unstarred(self, text: str) -> list[str]:
        """The text with its starred words replaced by their first meanings, by their second ones, and so on."""
        meant = {t: self._meant(t) for t in set(_STARRED.findall(text))}
        if all(words == [t] for t, words in meant.items()):
            return [text]
        most = max(map(len, meant.values()))
        return [_STARRED.sub(lambda m, k=k: (w := meant[m.group(0)])[k % len(w)] + " ", text) for k in range(most)]

    def fold(self, text: str) -> Iterator[str]:
        """Folded variants of a text, words set apart by single spaces and sentences by dots."""
        if "<" in text:
            text = _TAG.sub(lambda m: f" {' '.join(_READ.findall(m.group()))} " if "=" in m.group() else " ", text)
        if "&" in text:
            text = html.unescape(text)
        text = _plain(text).replace(_STOP_SIGN, " ")
        if _SEEMS_SPACED.search(text):
            text = _SPACED.sub(self._joined, text)
        variants = self._unstarred(text) if "*" in text or "#" in text or "•" in text else [text]
        variants = [x for v in variants for x in _unleeted(_END.sub(f" {STOP} ", v))]
        if (_LONG_ASCII if text.isascii() else _LONG).search(text):
            variants = [x for v in variants for x in (_LONG.sub(r"\1", v), _LONG.sub(r"\1\1", v))]
        for v in variants:
            yield f" {' '.join(_words(v))} "

    def passages(self, folded: str) -> list[tuple[float, dict[str, float], int]]:
        """(weight, weight by category, words) of each passage that has any."""
        if next(self.carriers.iter(folded), None) is None:
            return []
        hits, excused = [], []
        for end, (kind, weight, n, pad, category) in self.automaton.iter(folded):
            stop = end + 1 - pad
            (excused if kind == "excuse" else hits).append((stop - n, stop, kind, weight, category))
        hits = [h for h in hits if not (any(e[0] <= h[0] and h[1] <= e[1] for e in excused) or self._excused(folded, h)) or (h[2] in ("insult", "direct") and _before(folded, h, _ADDRESSED))]
        sentences: dict[int, list[tuple]] = {}
        at, sentence = 0, 0
        for h in sorted(hits):
            sentence += folded.count(STOP, at, h[0])
            at = h[0]
            sentences.setdefault(sentence, []).append(h)
        cues = {n: [h for h in hs if h[2] == "cue"] for n, hs in sentences.items()}
        out = []
        for n, found in sentences.items():
            beside = [*cues.get(n - 1, ()), *cues.get(n + 1, ())]
            for part in _stretches(folded, found):
                kinds: dict[str, list] = {}
                for h in part:
                    kinds.setdefault(h[2], []).append(h)
                weights = self._weights(folded, kinds, beside)
                if weights:
                    out.append((sum(weights.values()), weights, folded.count(" ", part[0][0], part[-1][1]) + 1))
        return out

    def _excused(self, folded: str, hit: tuple) -> bool:
        """Whether a name is one for the writer, or one that others are reported to have called somebody."""
        if hit[2] == "strong":
            return folded[hit[0] : hit[1]] in self.slurs and _before(folded, hit, _REPORTED)
        if hit[2] not in ("insult", "direct"):
            return False
        return _before(folded, hit, _ONESELF, _REPORTED) or (_before(folded, hit, _WHAT) and bool(_I_AM.match(folded, hit[1])))

    def _weights(self, folded: str, found: dict[str, list], beside: list) -> dict[str, float]:
        """Weights of a passage by category."""
        out: dict[str, float] = {}

        def add(category: str, weight: float) -> None:
            out[category] = out.get(category, 0.0) + weight

        for kind in ("strong", "mild"):
            for h in {h[:2]: h for h in found.get(kind, ())}.values():
                add(h[4], h[3])
        insults = found.get("insult", [])
        for h in {h[0]: h for h in insults}.values():
            add(h[4], h[3])
        if insults and (any(self._near(folded, i, c) for i in insults for c in found.get("cue", ())) or self._alone(folded, insults, beside)):
            add(insults[0][4], lexicon.CUE)
        if any(_before(folded, h, _ADDRESSED, _SPOKEN_OF, _CALLED) or _YOU_ARE.match(folded, h[1]) for h in found.get("direct", ())):
            add(lexicon.ABUSIVE, lexicon.INSULT + lexicon.CUE)
        category = self._paired(folded, found)
        if category:
            add(category, lexicon.STRONG)
        return out

    def _alone(self, folded: str, insults: list, beside: list) -> bool:
        """Whether a sentence is nothing but an insult, or a cue for it stands near by in the sentence before or after."""
        start, stop = folded.rfind(STOP, 0, insults[0][0] + 1), folded.find(STOP, insults[0][1])
        begin, end = (0 if start < 0 else start + 1), (len(folded) if stop < 0 else stop)
        plain = [i for i in insults if folded[i[0] : i[1]] not in self.literal]
        words = [(m.start() + begin, m.group()) for m in _WORD.finditer(folded[begin:end])]
        covered = lambda at: any(i[0] <= at < i[1] for i in insults)
        if plain and all(covered(at) or w in _ADDED for at, w in words):
            return True
        own = [at for at, w in words if w in _OWN]
        return any(self._near(folded, i, c) for i in plain if not any(at < i[0] for at in own) for c in beside)

    def _paired(self, folded: str, found: dict[str, list]) -> str | None:
        """The category if harm is vowed, or people are degraded by what stands together."""

        def follows(first: str, then: str, apart: int) -> bool:
            return any(a[1] <= b[0] and folded.count(" ", a[1], b[0]) <= apart + 1 for a in found.get(first, ()) for b in found.get(then, ()))

        if follows("vow", "harm", APART):
            return lexicon.ABUSIVE
        if any(follows(f"first{n}", f"then{n}", apart) for n, (_, _, apart) in enumerate(lexicon.TOGETHER) if f"first{n}" in found):
            return lexicon.HATEFUL
        groups = found.get("group")
        if not groups:
            return None
        if follows("group", "ill", APART) or follows("rid", "group", 0):
            return lexicon.HATEFUL
        said = [h for k in ("slight", "insult", "mild") for h in found.get(k, ()) if k != "mild" or folded[h[0] : h[1]] in self.slights]
        return lexicon.HATEFUL if any(g[1] < h[0] and _SAID.fullmatch(folded[g[1] : h[0]].strip()) for g in groups for h in said) else None

    @staticmethod
    def _near(folded: str, a: tuple, b: tuple) -> bool:
        lo, hi = min(a[1], b[1]), max(a[0], b[0])
        return lo >= hi or folded.count(" ", lo, hi) <= REACH

    def score(self, text: str | None) -> tuple[float, float, dict[str, float]]:
        """(weight per hundred words, the same of the heaviest passage, weight per hundred words by category); of several folded
        variants the one with the heaviest passage counts."""
        best: tuple[float, float, dict[str, float]] = (0.0, 0.0, {})
        for folded in self.fold(text) if text else ():
            found = self.passages(folded)
            if found:
                words = max(folded.count(" ") - 1 - folded.count(STOP), 1)
                worst = max(100 * w / max(n, PASSAGE) for w, _, n in found)
                whole = 100 * sum(w for w, _, _ in found) / words
                if (worst, whole) > (best[1], best[0]):
                    kinds = {c: 100 * sum(k.get(c, 0.0) for _, k, _ in found) / words for c in CATEGORIES}
                    best = (whole, worst, kinds)
        return round(best[0], 6), round(best[1], 6), {c: round(best[2].get(c, 0.0), 6) for c in CATEGORIES}


def _stretches(folded: str, hits: list[tuple]) -> list[list[tuple]]:
    """The hits of a sentence, or of each stretch of PASSAGE words of a longer one, in order; stretches overlap by half."""
    if folded.count(" ", hits[0][0], hits[-1][1]) < PASSAGE:
        return [hits]
    place = [folded.count(" ", hits[0][0], hits[0][0])]
    for a, b in zip(hits, hits[1:], strict=False):
        place.append(place[-1] + folded.count(" ", a[0], b[0]))
    out: dict[int, list[tuple]] = {}
    for h, p in zip(hits, place, strict=True):
        for k in {p // (PASSAGE // 2), max(p // (PASSAGE // 2) - 1, 0)}:
            out.setdefault(k, []).append(h)
    return list(out.values())


def _before(folded: str, hit: tuple, *patterns: regex.Pattern) -> bool:
    """Whether one of the patterns matches just before a hit."""
    text = folded[max(0, hit[0] - 80) : hit[0]]
    return any(p.search(text) for p in patterns)


def _leet(word: str, one: str = "i") -> str:
    """Digits and signs to letters, in a word that has letters."""
    return "".join(one if c == "1" else _DIGITS.get(c, c) for c in word) if any(c.isalpha() for c in word) else word


def _unleeted(text: str) -> list[str]:
    """The text with digits and signs within words as letters; a second time if a one may be an i or an l."""
    if not _SIGN_NEAR_LETTER.search(text):
        return [text]
    runs = set(_SIGN_RUN.findall(text))
    ones = "il" if any("1" in r for r in runs) else "i"
    return [_SIGN_RUN.sub(lambda m, one=one: "".join(one if c == "1" else _DIGITS[c] for c in m.group()), text) for one in ones]


_SCORER: list[Scorer] = []


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _SCORER:
        _SCORER.append(Scorer())
    for b in batches:
        found = [_SCORER[0].score(t) for t in b.column(1).to_pylist()]
        columns = [b.column(0), *(pa.array(x, pa.float64()) for x in ([f[0] for f in found], [f[1] for f in found], *([f[2][c] for f in found] for c in CATEGORIES)))]
        yield pa.RecordBatch.from_arrays([*columns, *b.columns[2:]], names=["id", "score", "worst", *CATEGORIES, *b.schema.names[2:]])


def abuse_scores(df: DataFrame, doc_id: str, text: str, source: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, worst, abusive, hateful, sexual, is_abusive[, source]) of every row; see the module for what they mean.

    Defined results: a null or empty text scores 0; one row out per row in; whole texts, however long; an empty table
    gives no rows; further columns are ignored.
    """
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *([F.col(source).alias("source")] if source else []))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"id {kinds['id']}, score double, worst double, {', '.join(f'{c} double' for c in CATEGORIES)}" + (f", source {kinds['source']}" if source else "")
    scored = spread(rows).mapInArrow(_scores, schema)
    out = [F.col("id").alias(doc_id), "score", "worst", *CATEGORIES, (F.col("worst") >= threshold).alias("is_abusive")]
    return scored.select(*out, *([F.col("source").alias(source)] if source else []))


def abuse_rates(df: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(source, n_docs, n_abusive, rate): how many of each source's documents are abusive; a null source is one of its own."""
    abusive = F.count(F.when(F.col("is_abusive"), 1))
    return (
        abuse_scores(df, doc_id, text, source)
        .groupBy(source)
        .agg(F.count("*").alias("n_docs"), abusive.alias("n_abusive"), (abusive / F.count("*")).alias("rate"))
    )
