"""Problem 7: text from scanned pages, repaired into continuous paragraphs.

First the words of the whole corpus are counted; those above a fixed share of all tokens, at most one in ``SHARE`` of
them, are sent to every task together with the reference list, so the size of what is sent has a bound.  Then each record
is decoded: running headers and page numbers go, the lines become one stream, and the cheapest way to read it is
found by dynamic programming over tokens that may be kept, corrected along a table of confusions, joined over a
hyphen or a gap, or split.  A second dynamic program chooses the paragraph breaks.  A word is a misreading only if the
word it is read as is ``RATIO`` times as frequent, so rare words of the corpus stay as they are.

Streams of known words need no decoding and are passed by; this changes no result.  Null and blank texts have no noise
and stay.  Junk (few known words) is judged only for headers and page numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomine.llm.frames import arrow_map
from foliomine.llm.lookalike import SUSPECT, Normaliser

#: A word belongs to the vocabulary if it makes up this share of all tokens.
SHARE = 2e-6
#: Words that misreadings may be read as make up this share, or stand in the reference list.
STRONG = 1e-5
RATIO = 20
MAX_COST = 3.2
JUNK_SHARE = 0.35
#: Characters of the widest printed column.
COLUMN = 110
CACHE = 400_000

#: What is seen, what was printed, and the cost of reading it so.
CONFUSIONS = (
    ("1", "l", 0.6), ("1", "i", 0.7), ("0", "o", 0.6), ("5", "s", 0.6), ("9", "g", 0.6), ("8", "b", 0.8), ("6", "b", 0.8), ("|", "l", 0.7),
    ("rn", "m", 1.0), ("m", "rn", 1.0), ("m", "in", 1.0), ("in", "m", 1.1), ("cl", "d", 1.0), ("d", "cl", 1.0), ("vv", "w", 1.0), ("w", "vv", 1.1), ("ii", "u", 1.0), ("u", "ii", 1.1), ("li", "h", 1.1), ("h", "li", 1.1), ("ri", "n", 1.1), ("n", "ri", 1.1), ("nn", "m", 1.2), ("tl", "d", 1.2), ("hx", "lix", 1.0),
    ("c", "e", 1.0), ("e", "c", 1.0), ("f", "t", 1.0), ("t", "f", 1.0), ("b", "h", 1.0), ("h", "b", 1.0), ("l", "i", 1.0), ("i", "l", 1.0), ("l", "t", 1.1), ("t", "l", 1.1), ("n", "u", 1.1), ("u", "n", 1.1), ("o", "c", 1.1), ("c", "o", 1.1), ("a", "o", 1.2), ("o", "a", 1.2), ("g", "q", 1.1), ("q", "g", 1.1), ("y", "v", 1.2), ("v", "y", 1.2), ("j", "i", 1.1), ("i", "j", 1.1),
    ("f", "fi", 0.9), ("f", "fl", 0.9), ("ff", "ffi", 0.9), ("ff", "ffl", 0.9), ("h", "fi", 1.4),
)
#: Words before which a hyphen stands for an omitted second half.
SUSPENDED = frozenset("and or to nor versus und oder bis et ou y o u e ou i lub".split())
HYPHENS = "-¬‐\u00ad"

_WORD = re.compile(r"[^\W_]+")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_NUMBER = re.compile(r"[\W_]*[0-9][0-9.,:/–%<>=±≥≤-]*[\W_]*")
_MISREAD_NUMBER = re.compile(r"(?=.*[0-9])(?=.*[lIOo])[0-9lIOo]{2,6}")
_PAGE = re.compile(r"\s*(?:[-–—\[(|]\s*)?(?:p\.?\s*|page\s+)?[0-9]{1,4}(?:\s*[-–—\])|])?\s*", re.I)
_TITLE = r"[^\s|].{2,90}"
_HEADER = re.compile(
    rf"\s*(?:(?i:chapter|section|part)\s+[0-9]+\s*[|·:–-]?\s*{_TITLE}"
    rf"|[0-9]{{1,4}}\s*:\s+{_TITLE}\s[0-9]{{1,4}}"
    rf"|[0-9]{{1,4}}\s+[^\W\d_][^.;:,|]{{1,50}}\s[–|·]\s{_TITLE}"
    rf"|[^\W\d_][^.;:|]{{2,90}}\s[–|·]\s[^.;:,|]{{1,50}}\s[0-9]{{1,4}}"
    r"|[^\W\d_][^a-zà-öø-ÿ|]{5,110}\s{2,}[0-9]{1,4})\s*"
)
_LIST = re.compile(r"\s*(?:[-*+•–▪·]|\(?[0-9]{1,3}[.)])\s+\S|.*(?:\.{4,}\s*[0-9]+|,\s*[0-9]{1,4}\s*[-–]\s*[0-9]{1,4})\s*$|.*(?:\t|\s{2,}\S+\s{2,}|\s\|\s)|\s*\|")
_SPACED = re.compile(r"(?<![^\W_])(?<!['’])[^\W\d_](?:\s[^\W\d_](?![^\W_]|['’][^\W_])){2,}")


def page_or_header(line: str) -> str | None:
    """``page_no``, ``header`` or None; a row of a pipe table is taken by its only filled cell."""
    s = line.strip()
    if not s or len(s) > 140:
        return None
    if s[0] == "|" and s[-1] == "|" and len(s) > 2:
        cells = [c.strip() for c in s.strip("|").split("|")]
        full = [c for c in cells if c]
        if len(full) != 1 or len(cells) < 2:
            return None
        s = full[0]
        return "header" if _HEADER.fullmatch(s) and not s.isdigit() else None
    if s[0].isdigit() or s[-1].isdigit() or s[-1] in "])|–—-":
        if _PAGE.fullmatch(s):
            return "page_no"
    elif s[:3].lower() not in ("cha", "sec", "par"):
        return None
    return "header" if _HEADER.fullmatch(s) else None


class Vocabulary:
    """Counts of the corpus's words, the reference words, and a trie of what misreadings may be read as."""

    def __init__(self, counts: dict[str, int], total: int, reference: list[str]) -> None:
        self.counts = counts
        self.reference = {w.lower() for w in reference}
        least = max(5, STRONG * total)
        self.common = max(20, 1e-4 * total)
        self.strong = self.reference | {w for w, n in counts.items() if n >= least and w.isalpha() and len(w) > 1} | {"a"}
        self.trie: dict = {}
        for word in self.strong:
            if len(word) > 2:
                node = self.trie
                for c in word:
                    node = node.setdefault(c, {})
                node[""] = word
        self.by_first: dict[str, list[tuple[str, str, float]]] = {}
        for seen, printed, cost in CONFUSIONS:
            self.by_first.setdefault(seen[0], []).append((seen, printed, cost))
        self.remembered: dict[str, tuple[float, str] | None] = {}

    def known(self, word: str) -> bool:
        """A word as it should be: listed, or in the corpus and not a misreading of one far more frequent."""
        return word in self.reference or word == "a" or (word in self.strong and self.misreading(word) is None)

    def misreading(self, word: str) -> tuple[float, str] | None:
        """The cheapest printed word that a lower-case word may have been misread from, and the cost."""
        if word not in self.remembered:
            if len(self.remembered) >= CACHE:
                self.remembered.clear()
            self.remembered[word] = self._misreading(word)
        return self.remembered[word]

    def _misreading(self, word: str) -> tuple[float, str] | None:
        if word in self.reference or len(word) > 40:
            return None
        digits = any(c.isdigit() for c in word)
        if len(word) < (3 if digits else 4):
            return None
        least = RATIO * self.counts.get(word, 0)
        n, best = len(word), None
        stack = [(0, self.trie, 0.0)]
        while stack:
            i, node, cost = stack.pop()
            if i == n:
                found = node.get("")
                if found and cost > 0 and (best is None or (cost, found) < best) and (found in self.reference or self.counts.get(found, 0) >= least) and self.counts.get(found, 1) >= least:
                    best = (cost, found)
                continue
            c = word[i]
            if c in node:
                stack.append((i + 1, node[c], cost))
            for seen, printed, price in self.by_first.get(c, ()):
                if cost + price <= MAX_COST and word.startswith(seen, i):
                    below = node
                    for p in printed:
                        below = below.get(p)
                        if below is None:
                            break
                    else:
                        stack.append((i + len(seen), below, cost + price))
        # a short word bears one misreading, a longer one more
        return best if best and best[0] <= (1.25 if n < 5 else MAX_COST if n > 7 or digits else 2.3) else None

    def segment(self, letters: str) -> list[str] | None:
        """Letters without spaces as known words, as few as possible."""
        best: list[list[str] | None] = [[]] + [None] * len(letters)
        for j in range(1, len(letters) + 1):
            for i in range(max(0, j - 30), j):
                part = letters[i:j]
                if best[i] is not None and part in self.strong and (len(part) > 2 or part == "a" or self.counts.get(part, 0) >= self.common):
                    if best[j] is None or len(best[i]) + 1 < len(best[j]):
                        best[j] = [*best[i], letters[i:j]]
        return best[-1]


def _recase(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


class Decoder:
    """Decodes records; what is known about a token is remembered within a worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.words = vocabulary
        self.normal = Normaliser(sorted(vocabulary.reference))
        self.fine: set[str] = set()
        self.other: dict[str, bool] = {}

    def is_fine(self, token: str) -> bool:
        """Whether a token between spaces holds nothing but known words and numbers."""
        if token in self.fine:
            return True
        if token in self.other:
            return False
        if len(self.fine) + len(self.other) > CACHE:
            self.fine.clear()
            self.other.clear()
        parts = _WORD.findall(token)
        good = token[-1] not in HYPHENS and (bool(_NUMBER.fullmatch(token)) or (bool(parts) and all(p.isdigit() or (self.words.known(p.lower()) and (len(p) > 1 or p in "aA")) for p in parts)))
        if good:
            self.fine.add(token)
        else:
            self.other[token] = True
        return good

    def correct(self, token: str) -> tuple[float, str] | None:
        """A token with its misread words and numbers as printed, and the cost; None if nothing is misread."""
        cost, changed = 0.0, []

        def fix(m: re.Match) -> str:
            nonlocal cost
            part = m.group(0)
            if _MISREAD_NUMBER.fullmatch(part) and not (part[0] in "OoIl" and len(part) == 2 and part[0] != "l") and not part.endswith("o"):
                cost += 1.0
                changed.append(part)
                return part.replace("l", "1").replace("I", "1").replace("O", "0").replace("o", "0")
            found = None if part.isdigit() else self.words.misreading(part.lower())
            if found is None:
                return part
            cost += found[0]
            changed.append(part)
            return _recase(found[1], part)

        out = _WORD.sub(fix, token)
        return (cost, out) if changed else None

    def joined(self, left: str, right: str) -> tuple[float, str] | None:
        """Two halves of a word or compound around a hyphen; None where the hyphen isn't a break."""
        head, tail = _WORD.findall(left), _WORD.findall(right)
        if not head or not tail or not right[0].isalpha() or not right[0].islower() and not (left.isupper() and right[0].isupper()):
            return None
        if tail[0].lower() in SUSPENDED:
            return None
        body = left.rstrip(HYPHENS)
        word = (head[-1] + tail[0]).lower()
        if self.words.known(word):
            return 0.5, body + right
        if self.words.known(head[-1].lower()) and self.words.known(tail[0].lower()):
            return 0.7, f"{body}-{right}"
        found = self.words.misreading(word)
        if found:
            return 0.5 + found[0], body + right
        return 1.5, body + right

    def read(self, text: str) -> tuple[list[str], set[str], bool, bool]:
        """The lines left after headers and page numbers, the kinds of noise so far, whether it is junk, whether it must be decoded."""
        kinds, lines = set(), []
        for line in text.split("\n"):
            kind = page_or_header(line)
            if kind:
                kinds.add(kind)
            else:
                lines.append(line)
        tokens = " ".join(lines).split()
        fine = self.fine
        odd = [t for t in tokens if t not in fine and not self.is_fine(t)]
        # spaced-out words would make junk of a short text
        letters = sum(len(_WORD.findall(m.group(0))) for m in _SPACED.finditer(" ".join(lines)) if self.words.segment("".join(m.group(0).split()).lower())) if len(odd) * 3 > len(tokens) else 0
        junk = bool(tokens) and len(tokens) - len(odd) + letters < JUNK_SHARE * len(tokens)
        return lines, kinds, junk, bool(odd)

    @staticmethod
    def stream(lines: list[str]) -> list[tuple[str, str]]:
        """The tokens of a text and what follows each."""
        out: list[tuple[str, str]] = []
        for line in lines:
            tokens = line.split()
            out += [(t, " ") for t in tokens]
            if tokens:
                out[-1] = (tokens[-1], "\n")
        return out

    def operations(self, lines: list[str]) -> set[str]:
        """The kinds of noise in the cheapest reading.

        A known word of several letters is read as itself, whatever stands around it; so the reading is found window
        by window: the unknown tokens, one-letter words before them, and the token after them.
        """
        stream, fine, kinds = self.stream(lines), self.fine, set()
        n, i = len(stream), 0
        while i < n:
            if stream[i][0] in fine or self.is_fine(stream[i][0]):
                i += 1
                continue
            a = i
            while a and len(_EDGE.sub("", stream[a - 1][0])) == 1:
                a -= 1
            b = i + 1
            while b < n and not (stream[b][0] in fine and len(stream[b][0]) > 1 and stream[b - 1][0] in fine):
                if stream[b][0] not in fine:
                    self.is_fine(stream[b][0])
                b += 1
            kinds |= self.decode(stream[a:b], b == n)[1]
            i = b
        return kinds

    def decode(self, stream: list[tuple[str, str]], last: bool = True) -> tuple[str, set[str]]:
        """The cheapest reading of a stream of tokens; ends of lines are kept where no word runs over them."""
        n = len(stream)
        best: list[tuple[float, int, str, str]] = [(0.0, 0, "", "")] + [(1e9, 0, "", "")] * n
        for i in range(n):
            cost = best[i][0]
            token, after = stream[i]

            def offer(j: int, price: float, text: str, op: str, i: int = i, cost: float = cost) -> None:
                if cost + price < best[j][0]:
                    best[j] = (cost + price, i, text, op)

            fine = self.is_fine(token)
            offer(i + 1, 0.0 if fine else 4.0, token + after, "")
            if fine:
                # a known letter may begin a spaced-out word
                if len(token) > 1:
                    continue
            else:
                fixed = self.correct(token)
                if fixed:
                    offer(i + 1, 0.3 + min(fixed[0], 3.0), fixed[1] + after, "ocr")
            if token[-1] in HYPHENS and token[-2:-1].isalpha() and i + 1 < n:
                whole = self.joined(token, stream[i + 1][0])
                if whole:
                    misread = self.correct(whole[1]) if whole[0] > 0.7 else None
                    offer(i + 2, min(whole[0], 2.0), (misread[1] if misread else whole[1]) + stream[i + 1][1], "hyphen+ocr" if misread else "hyphen")
            elif token[-1] in HYPHENS and token[-2:-1].isalpha() and i + 1 == n and last and after == "\n":
                offer(i + 1, 3.9, token + after, "hyphen")  # broken over the end of the record
            core = _EDGE.sub("", token)
            if len(core) == 1 and core.isalpha():
                j, letters = i, ""
                while j < n and len(_EDGE.sub("", stream[j][0])) == 1 and _EDGE.sub("", stream[j][0]).isalpha() and j - i < 60:
                    letters += _EDGE.sub("", stream[j][0])
                    j += 1
                    if j - i >= 3:
                        found = [letters.lower()] if letters.lower() in self.words.strong else self.words.segment(letters.lower()) if stream[j - 1][0][-1] != letters[-1] or j == n or len(_EDGE.sub("", stream[j][0])) != 1 else None
                        if found:
                            tail = stream[j - 1][0][1:] if len(stream[j - 1][0]) > 1 and stream[j - 1][0][0].isalpha() else ""
                            lead = token[: token.index(core)]
                            offer(j, 0.8 + 0.4 * len(found), lead + _recase(" ".join(found), letters) + tail + stream[j - 1][1], "ocr")
                    if stream[j - 1][0][-1] != letters[-1]:
                        break
            elif not fine and token.isalpha():
                word = token.lower()
                if word not in self.words.strong and len(word) >= 8 and self.words.misreading(word) is None:
                    halves = [(word[:k], word[k:]) for k in range(3, len(word) - 2) if word[:k] in self.words.reference and word[k:] in self.words.reference]
                    if halves:
                        offer(i + 1, 3.0, _recase(f"{halves[0][0]} {halves[0][1]}", token) + after, "split")
        out, kinds, at = [], set(), n
        while at > 0:
            _, before, text, op = best[at]
            out.append(text)
            kinds |= {k for k in op.split("+") if k in ("hyphen", "ocr")}
            at = before
        return "".join(reversed(out)), kinds

    def noise(self, text: str, suspect: bool, heading: bool) -> set[str]:
        """The kinds of noise in a record."""
        if suspect:
            text = self.normal.text(text)[0]
        lines, kinds, junk, odd = self.read(text)
        if heading:
            kinds.discard("header")
        return kinds | self.operations(lines) if odd and not junk else kinds

    def repair(self, text: str, suspect: bool, heading: bool) -> str:
        """A record as continuous paragraphs; junk is returned as it is."""
        lines, _, junk, _ = self.read(self.normal.text(text)[0] if suspect else text)
        if junk:
            return text
        if heading:
            lines = text.split("\n")
        decoded = self.decode(self.stream(lines))[0].strip().split("\n") if lines else []
        return paragraphs(decoded)


def paragraphs(lines: list[str]) -> str:
    """Join wrapped lines; breaks chosen by dynamic programming over the ends of lines."""
    if len(lines) < 2:
        return "".join(lines)
    width = max(map(len, lines))
    # states: the line goes on with the paragraph, or begins one; the least cost so far of each
    states = [[0.0, 0.0]]
    back: list[tuple[int, int]] = []
    for i in range(1, len(lines)):
        before, line = lines[i - 1].rstrip(), lines[i]
        listed = bool(_LIST.match(line)) or bool(_LIST.match(before))
        ended = before[-1:] in ".!?:”\"" or (not before[-1:].isalnum() and before[-1:] != ",")
        short = len(before) < 0.7 * width
        upper = line[:1].isupper() or line[:1].isdigit()
        cut_cost = 0.0 if listed else (0.4 if ended and short else 0.8 if short and upper else 1.5 if ended and upper else 3.0) + (0.0 if upper else 1.0)
        # lines longer than a printed column were not wrapped: their ends are meant
        join_cost = 6.0 if listed else (1.2 if ended and short else 0.3) + (1.0 if short and upper else 0.0) + (4.0 if width > COLUMN and upper else 0.0)
        previous = states[-1]
        # two breaks in a row make a paragraph of one line, which costs a little unless it is listed
        begin = [(previous[0] + cut_cost, 0), (previous[1] + cut_cost + (0.0 if listed else 0.3), 1)]
        go = [(previous[0] + join_cost, 0), (previous[1] + join_cost, 1)]
        b, g = min(begin), min(go)
        states.append([g[0], b[0]])
        back.append((g[1], b[1]))
    state, breaks = (0 if states[-1][0] <= states[-1][1] else 1), []
    for i in range(len(lines) - 1, 0, -1):
        if state == 1:
            breaks.append(i)
        state = back[i - 1][state]
    begins = set(breaks)
    return lines[0] + "".join("\n" + line if i in begins else " " + line.strip() for i, line in enumerate(lines[1:], 1))


def word_counts(texts: DataFrame) -> tuple[dict[str, int], int]:
    """The words above ``SHARE`` of all tokens with their counts, and the number of tokens.  At most 1/SHARE words."""

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        total: Counter = Counter()
        for b in batches:
            raw: Counter = Counter()
            for t in b["text"]:
                raw.update(t.lower().split())
            counts: Counter = Counter()
            for token, k in raw.items():
                if token[-1] in HYPHENS:
                    continue
                parts = _WORD.findall(token)
                for p in parts:
                    if p.isalpha() and 1 < len(p) <= 40:
                        counts[p] += k
            total.update(counts)
            if len(total) > CACHE:
                yield {"word": list(total), "n": list(total.values())}
                total = Counter()
        yield {"word": list(total), "n": list(total.values())}

    counted = arrow_map(texts.where(F.col("text").isNotNull()), kernel, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = counted.persist()
    try:
        total = counted.agg(F.sum("n")).first()[0] or 0
        rows = counted.where(F.col("n") >= SHARE * total).collect()
    finally:
        counted.unpersist()
    return {r["word"]: r["n"] for r in rows}, total


def noise_found(texts: DataFrame, counts: dict[str, int], total: int, reference: list[str]) -> DataFrame:
    """``rec_table, rec_id, noise_kind`` of texts given as ``rec_table, rec_id, text, heading``."""

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        decoder = Decoder(Vocabulary(counts, total, reference))
        for b in batches:
            out: dict[str, list] = {"rec_table": [], "rec_id": [], "noise_kind": []}
            for r, i, t, s, h in zip(b["rec_table"], b["rec_id"], b["text"], b["suspect"], b["heading"], strict=True):
                for kind in sorted(decoder.noise(t, s, h)):
                    out["rec_table"].append(r)
                    out["rec_id"].append(i)
                    out["noise_kind"].append(kind)
            yield out

    ready = texts.where(F.col("text").isNotNull()).withColumn("suspect", F.col("text").rlike(SUSPECT))
    return arrow_map(ready.select("rec_table", "rec_id", "text", "suspect", "heading"), kernel, "rec_table string, rec_id long, noise_kind string")


def repaired(texts: DataFrame, counts: dict[str, int], total: int, reference: list[str]) -> DataFrame:
    """``rec_table, rec_id, text``: every text as continuous paragraphs; null stays null."""

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        decoder = Decoder(Vocabulary(counts, total, reference))
        for b in batches:
            fixed = [None if t is None else decoder.repair(t, s, h) for t, s, h in zip(b["text"], b["suspect"], b["heading"], strict=True)]
            yield {"rec_table": b["rec_table"], "rec_id": b["rec_id"], "text": fixed}

    ready = texts.withColumn("suspect", F.coalesce(F.col("text").rlike(SUSPECT), F.lit(False)))
    return arrow_map(ready.select("rec_table", "rec_id", "text", "suspect", "heading"), kernel, "rec_table string, rec_id long, text string")
