"""Problem 6: text that looks alike but differs in its characters, brought to one form.

Tokens with suspect characters are run through a trie of the vocabulary by a weighted edit automaton.  Its operations
are taken letter by letter from the token as it is written: a look-alike letter or a full-width form for the letter
(nothing), an ignorable character left out (nothing), an accent written apart (nothing), an accent left out or put in
(half).  What costs more than ``LIMIT`` is no match.  The best alignment gives the canonical spelling, in the token's own
case, and the operations it took are the kinds of difference reported.  Tokens without a match, and what stands between
tokens, are aligned by table, letter by letter, with the same operations; spaces become plain ones.

Only records with a suspect character reach Python; a regular expression in the scan tells them.  Greek letters alone
are symbols and stay.  Null texts and null cells stay null; a text without suspect characters is returned as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomine.llm.frames import JAVA_INVISIBLE, JAVA_SPACES, arrow_map

LIMIT = 0.5
ACCENT = 0.5
CACHE = 200_000

#: Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝкАВЕЗКМНОРСТУХІЈЅԌԚԜ", "aeopcyxijshdqwkAB" + "E3KMHOPCTYXIJSGQW", strict=True))
GREEK = dict(zip("οναρυικτηχγωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovapuiktnxywABEZHIKMNOPTYX", strict=True))
ARMENIAN = dict(zip("օսհոցզյ", "ouhngqj", strict=True))
LOOKALIKE = CYRILLIC | GREEK | ARMENIAN

INVISIBLE = "\u00ad\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_FULL = re.compile("[０-９Ａ-Ｚａ-ｚ]")
_MARK = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_SPACE = re.compile(f"[{SPACES}]")
_OTHER = re.compile("[Ͱ-ϿЀ-ԯ԰-֏]")
_TOKEN = re.compile(f"(?:[^\\W_]|[\u0300-\u036f{INVISIBLE}])+")
#: What sends a record to Python, for the scan.
SUSPECT = rf"[{JAVA_INVISIBLE}{JAVA_SPACES}０-９Ａ-Ｚａ-ｚ\p{{Mn}}Ͱ-ϿЀ-ԯ԰-֏]"


def _plain(c: str) -> str:
    return chr(ord(c) - 0xFEE0) if _FULL.match(c) else c


class Trie:
    """A vocabulary of canonical spellings, with every accent a step of its own."""

    def __init__(self, words: list[str]) -> None:
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in unicodedata.normalize("NFD", word.lower()):
                node = node.setdefault(c, {})
            node[""] = word

    def align(self, token: str, limit: float = LIMIT) -> tuple[float, int, str] | None:
        """The cost of the cheapest spelling, the look-alikes it took, and the spelling in lower case.

        Ties go to fewer look-alikes, then to the first in order of spelling.
        """
        states: dict[str, tuple[float, int, dict]] = {"": (0.0, 0, self.root)}
        for c in token:
            if _INVISIBLE.match(c):
                continue  # left out at no cost
            low = _plain(c).lower()
            alike = LOOKALIKE.get(c) or LOOKALIKE.get(low)
            for x in unicodedata.normalize("NFD", low):
                following: dict[str, tuple[float, int, dict]] = {}
                mark = bool(_MARK.match(x))
                forms = [(x, 0.0, 0)] if mark or not alike else [(x, 0.0, 0), (alike.lower(), 0.0, 1)]
                for path, (cost, subs, node) in (states if mark else self._accents(states, limit)).items():
                    for form, price, taken in forms:
                        if form in node:
                            self._reach(following, path + form, cost + price, subs + taken, node[form])
                    if mark and cost + ACCENT <= limit:
                        self._reach(following, path, cost + ACCENT, subs, node)
                states = following
                if not states:
                    return None
        ends = sorted((cost, subs, path) for path, (cost, subs, node) in self._accents(states, limit).items() if "" in node)
        return (ends[0][0], ends[0][1], unicodedata.normalize("NFC", ends[0][2])) if ends else None

    @staticmethod
    def _reach(states: dict, path: str, cost: float, subs: int, node: dict) -> None:
        if path not in states or (cost, subs) < states[path][:2]:
            states[path] = (cost, subs, node)

    def _accents(self, states: dict, limit: float) -> dict:
        """The states and those that an accent more leads to."""
        out = dict(states)
        for path, (cost, subs, node) in states.items():
            if cost + ACCENT <= limit:
                for child, below in node.items():
                    if child and _MARK.match(child):
                        self._reach(out, path + child, cost + ACCENT, subs, below)
        return out

    def match(self, token: str, limit: float = LIMIT) -> tuple[float, str] | None:
        """The cost and the spelling of the best alignment."""
        found = self.align(token, limit)
        return (found[0], found[2]) if found else None


def operations(text: str) -> set[str]:
    """The operations that any alignment of these characters takes, one by one: all but look-alikes."""
    kinds, before = set(), ""
    for c in text:
        if c.isascii():
            before = c
        elif _INVISIBLE.match(c):
            kinds.add("invisible")
        elif _SPACE.match(c):
            kinds.add("space")
            before = c
        elif _MARK.match(c):
            # an accent belongs to a letter
            if before.isalpha():
                kinds.add("combining")
        else:
            if _FULL.match(c):
                kinds.add("fullwidth")
            before = c
    return kinds


def _recase(word: str, token: str) -> str:
    return "".join(w.upper() if t.isupper() else w for w, t in zip(word, token, strict=True)) if len(word) == len(token) else word


class Normaliser:
    """Tokens to canonical spellings, remembered within a worker."""

    def __init__(self, words: list[str]) -> None:
        self.trie = Trie(words)
        self.seen: dict[str, tuple[str, frozenset[str], bool]] = {}

    def token(self, token: str) -> tuple[str, frozenset[str], bool]:
        """The spelling, the kinds of difference, and whether the token may be spelt with look-alikes, wholly."""
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            spelling, alike, wholly = self._token(token)
            got = self.seen[token] = (spelling, frozenset(operations(token) | ({"lookalike"} if alike else set())), wholly)
        return got

    def _token(self, token: str) -> tuple[str, bool, bool]:
        bare = unicodedata.normalize("NFC", "".join(_plain(c) for c in token if not _INVISIBLE.match(c)))
        other = [c for c in bare if _OTHER.match(c)]
        if any(c not in LOOKALIKE for c in other):
            return bare, False, False
        found = self.trie.align(token, 0.0)
        if found and found[1] and len(bare) == 1:
            return bare, False, bare in CYRILLIC or bare in ARMENIAN  # one letter alone may be a symbol
        if found and (found[1] or not other):
            return _recase(found[2], bare), found[1] > 0, False
        if found or not other:
            return bare, False, False
        # by table
        table = "".join(LOOKALIKE.get(c, c) for c in bare)
        latin = [c for c in bare if c.isalpha() and not _OTHER.match(c)]
        if latin:
            if not all(c in GREEK for c in other):
                return table, True, False
            # a Greek letter among small Latin ones is spelling; beside a capital or a digit it may be a symbol
            inner = any(c in GREEK and ((0 < i and bare[i - 1].islower() and bare[i - 1] not in GREEK) and (i + 1 < len(bare) and bare[i + 1].islower())) for i, c in enumerate(bare))
            # capitals that look like Latin ones are no symbols
            inner = inner or all(c.isupper() for c in other)
            small = len(latin) >= 3 and all(c.islower() for c in latin[1:])
            return (table, True, False) if inner or small else (bare, False, False)
        # wholly of another script: Greek alone is a symbol or a word; Cyrillic is told by the rest of the record
        return (bare, False, all(c in CYRILLIC or c in ARMENIAN for c in other))

    def text(self, text: str) -> tuple[str, set[str]]:
        """The text in one form, and the kinds of difference that stood in it."""
        kinds: set[str] = set()
        maybe = False
        foreign = any(c not in LOOKALIKE and not ("Ͱ" <= c <= "Ͽ") for c in _OTHER.findall(text))
        out, at = [], 0

        def between(part: str) -> None:
            if not part.isascii():
                kinds.update(operations(part))
                part = _INVISIBLE.sub("", _SPACE.sub(" ", part))
            out.append(part)

        for m in _TOKEN.finditer(text):
            token = m.group(0)
            if token.isascii():
                continue
            between(text[at : m.start()])
            at = m.end()
            spelling, how, wholly = self.token(token)
            kinds.update(how)
            if wholly and not foreign:
                maybe = True
                spelling = "".join(LOOKALIKE.get(c, c) for c in spelling)
            out.append(spelling)
        between(text[at:])
        if maybe:
            kinds.add("lookalike")
        return "".join(out), kinds


def kinds_found(df: DataFrame, words: list[str], row: str, text: str) -> DataFrame:
    """``rec_id, char_kind``: one row per record and kind of difference in it."""

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        normal = Normaliser(words)
        for b in batches:
            ids, kinds = [], []
            for i, t in zip(b["rec_id"], b["text"], strict=True):
                for kind in sorted(normal.text(t)[1]):
                    ids.append(i)
                    kinds.append(kind)
            yield {"rec_id": ids, "char_kind": kinds}

    narrow = df.select(F.col(row).cast("long").alias("rec_id"), F.col(text).alias("text")).where(F.col("text").rlike(SUSPECT))
    return arrow_map(narrow, kernel, "rec_id long, char_kind string")


def normal_texts(df: DataFrame, words: list[str], row: str, text: str) -> DataFrame:
    """``rec_id, text``: every text in one form; those without suspect characters don't leave the JVM."""

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        normal = Normaliser(words)
        for b in batches:
            yield {"rec_id": b["rec_id"], "text": [normal.text(t)[0] for t in b["text"]]}

    narrow = df.select(F.col(row).cast("long").alias("rec_id"), F.col(text).alias("text"))
    suspect = F.coalesce(F.col("text").rlike(SUSPECT), F.lit(False))
    return narrow.where(~suspect).unionByName(arrow_map(narrow.where(suspect), kernel, "rec_id long, text string"))


def normal_cells(df: DataFrame, words: list[str], row: str, rows: str) -> DataFrame:
    """``rec_id, rows``: every cell in one form; null cells and null rows stay."""

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        normal = Normaliser(words)
        for b in batches:
            clean = [[None if r is None else [None if c is None else normal.text(c)[0] for c in r] for r in t] for t in b["rows"]]
            yield {"rec_id": b["rec_id"], "rows": clean}

    narrow = df.select(F.col(row).cast("long").alias("rec_id"), F.col(rows).alias("rows"))
    suspect = F.coalesce(F.exists("rows", lambda r: F.exists(r, lambda c: c.rlike(SUSPECT))), F.lit(False))
    return narrow.where(~suspect).unionByName(arrow_map(narrow.where(suspect), kernel, "rec_id long, rows array<array<string>>"))


def cells_text(rows: str):
    """All cells of a table in one text, a line each."""
    return F.array_join(F.flatten(F.filter(F.col(rows), lambda r: r.isNotNull())), "\n")
