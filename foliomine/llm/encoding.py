"""Problem 10: texts decoded with the wrong character encoding, found by expectation-maximisation and repaired.

A text is cut into units (sentences).  What happened to a unit is a latent chain of wrong decodings, ``none`` for most.
Undoing a chain must succeed byte for byte, and the result must look more like the languages of the corpus than the
unit itself: both are scored with a character-pair model fitted to the reference word list.  A single unit is
often weak evidence, so the shares of the chains are estimated per source and field by expectation-maximisation over
all units, and a unit is repaired by the chain with the largest posterior.

Only texts with characters outside ASCII are looked at: every wrong decoding leaves ASCII as it is and turns the rest
into something outside ASCII.  Evidence is grouped to counted signatures before the iterations, so a source with a
third of all rows comes down to a few rows.  Lost characters (U+FFFD) are a chain of their own; they are filled from
the word list where one word fits.  Null and empty texts are not garbled; null sources are pooled as one source.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomine.llm.frames import arrow_map, send_small
from foliomine.session import cut

#: Encodings UTF-8 is mistaken for, and pairs of single-byte encodings (true, mistaken for).
UTF8_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866", "cp1254")
SINGLE = (
    ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "mac_roman"), ("koi8-r", "cp866"), ("cp866", "koi8-r"),
    ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("cp1252", "cp1250"), ("cp852", "cp1252"), ("cp1250", "iso8859-2"), ("iso8859-2", "cp1250"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp850", "cp437"), ("cp1250", "cp1251"), ("cp1250", "mac_roman"), ("cp1250", "cp437"),
)
#: Symbols that stand in texts as they should be.
SYMBOLS = set("¬¶–—‑‘’‚“”„…•·«»‹›¿¡§©®™°±×÷µ½¼¾²³¹ºª€£¥≥≤≈≠№†‡−αβγδκλμπσΔΩω\u00a0\u2009\u202f\u2007\u2003\u00ad\u200b\u200c\u200d\u2060\ufeff")
INSIDE_WORDS = set("’‑–—·‘\u00ad\u200b\u200c\u200d\u2060\ufeff\u00a0\u2009\u202f\u2007\u2003")
LOSSY = "lossy"
MAX_DEPTH = 3
ITERATIONS = 12
#: Evidence of a token that a chain can't have made, in nats.
MISFIT = -6.0
#: Evidence of a unit beyond this many nats changes nothing, but for the order of its chains.
STRONG = 25.0
PRIOR = 1e-3
CACHE = 200_000

_SENTENCE = re.compile(r"(?<=[.!?:;])(?= )")


def _table(codec: str) -> list[str]:
    """The character of every byte; bytes without one stay control characters, as browsers do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def _undo_utf8(codec: str):
    to_byte = {c: b for b, c in enumerate(_table(codec))}

    def undo(text: str) -> str | None:
        try:
            return bytes([to_byte[c] for c in text]).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return None

    return undo


def _undo_single(true: str, mistaken: str):
    there = _table(true)
    back = {c: there[b] for b, c in enumerate(_table(mistaken)) if b > 127}

    def undo(text: str) -> str | None:
        out = []
        for c in text:
            if c < "\x80":
                out.append(c)
            elif c in back:
                out.append(back[c])
            else:
                return None
        return "".join(out)

    return undo


STEPS = {f"utf-8>{c}": _undo_utf8(c) for c in UTF8_AS} | {f"{a}>{b}": _undo_single(a, b) for a, b in SINGLE}


class PairModel:
    """Log-probability of the character pairs of a token of which one at least lies outside ASCII."""

    def __init__(self, words: list[str]) -> None:
        self.pairs: dict[tuple[str, str], float] = {}
        self.single: dict[str, float] = {}
        self.starts: dict[str, float] = {}
        for word in words:
            chain = f" {word.lower()} "
            for a, b in zip(chain, chain[1:]):
                self.pairs[a, b] = self.pairs.get((a, b), 0.0) + 1
                self.starts[a] = self.starts.get(a, 0.0) + 1
                self.single[b] = self.single.get(b, 0.0) + 1
        self.total = sum(self.single.values()) or 1.0
        self.by_length: dict[int, list[str]] = {}
        for word in words:
            self.by_length.setdefault(len(word), []).append(word.lower())

    def pair(self, a: str, b: str) -> float:
        single = self.single.get(b, 0.0) / self.total + 1e-6
        seen = self.starts.get(a, 0.0)
        return math.log((self.pairs.get((a, b), 0.0) + 3 * single) / (seen + 3))

    def score(self, token: str) -> float:
        total, before = 0.0, " "
        n = len(token)
        alone = token.strip("\"'()[]{}.,;:!?/")
        if len(alone) == 1 and (alone.isalpha() or alone in SYMBOLS):  # a one-letter word, or a sign that is spoken of
            return math.log(1e-3)
        for i, c in enumerate(token):
            after = token[i + 1] if i + 1 < n else " "
            if c >= "\x80" or before >= "\x80":
                if c.isalpha() and c not in SYMBOLS:
                    a = before.lower() if before.isalpha() else " "
                    total += self.pair(a, c.lower()[0])
                    if before.islower() and c.isupper():
                        total -= 5.0
                elif c < "\x80":
                    total += self.pair(before.lower() if before.isalpha() else " ", " ") if before.isalpha() else math.log(0.2)
                elif c in SYMBOLS:
                    inside = before.isalpha() and after.isalpha()
                    total += math.log(1e-3) if not inside or c in INSIDE_WORDS else math.log(1e-5)
                elif c < "\xa0":
                    total += math.log(1e-7)
                else:
                    total += math.log(1e-6)
            if i + 1 == n and c >= "\x80" and c.isalpha():
                total += self.pair(c.lower()[0], " ")
            before = c
        return total

    def fill(self, token: str) -> str:
        """A token with lost characters, filled from the word list where exactly one word fits."""
        core = re.search(r"[\w\ufffd]*\ufffd[\w\ufffd]*", token)
        if not core:
            return token
        hole = core.group(0)
        pattern = re.compile(re.escape(hole.lower()).replace("\ufffd", "[^\x00-\x7f]"))
        found = {w for w in self.by_length.get(len(hole), []) if pattern.fullmatch(w)}
        if len(found) != 1:
            return token
        word = "".join(x if o == "\ufffd" else o for o, x in zip(hole, found.pop(), strict=True))
        return token.replace(hole, word)


class Chains:
    """For each token what every chain that fits it gains over leaving the token as it is, in nats."""

    def __init__(self, model: PairModel) -> None:
        self.model = model
        self.seen: dict[str, dict[str, tuple[float, str]]] = {}

    def of(self, token: str) -> dict[str, tuple[float, str]]:
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            got = self.seen[token] = self._of(token)
        return got

    def _of(self, token: str) -> dict[str, tuple[float, str]]:
        as_is = self.model.score(token)
        found: dict[str, tuple[float, str]] = {}
        level = [("", token)]
        for depth in range(MAX_DEPTH):
            following = []
            for name, text in level:
                for step, undo in STEPS.items():
                    multibyte = step.startswith("utf-8>")
                    if depth and not multibyte and depth > 1:
                        continue
                    back = undo(text)
                    if back is None or back == text:
                        continue
                    chain = f"{name}+{step}" if name else step
                    # later steps cost a little, so that the shortest chain wins among equals
                    found[chain] = (self.model.score(back) - as_is - depth, back)
                    if multibyte and not back.isascii():
                        following.append((chain, back))
            level = following
        return found

    def unit(self, unit: str) -> dict[str, float]:
        """The evidence for each chain over the tokens of a unit; only chains that gain."""
        tokens = [t for t in unit.split(" ") if not t.isascii()]
        each = [self.of(t) for t in tokens if "\ufffd" not in t]
        names = {c for e in each for c, (gain, _) in e.items() if gain > 0}
        out = {}
        for c in names:
            gain = sum(e[c][0] if c in e else MISFIT for e in each)
            if gain > 0:
                out[c] = gain
        if len(each) < len(tokens):
            out[LOSSY] = 25.0
        return out

    def apply(self, unit: str, chain: str) -> str:
        if chain == LOSSY:
            return " ".join(self.model.fill(t) if "\ufffd" in t else t for t in unit.split(" "))
        return " ".join(self.of(t).get(chain, (0.0, t))[1] if not t.isascii() else t for t in unit.split(" "))


def units(text: str) -> Iterator[str]:
    """Sentences with the space before them, and line ends as units of their own; joined they give the text again."""
    for i, line in enumerate(text.split("\n")):
        if i:
            yield "\n"
        if line.isascii():
            yield line
        else:
            yield from _SENTENCE.split(line)


def word_list(words: DataFrame, word: str = "word", limit: int = 2_000_000) -> list[str]:
    """The reference words on the driver, after a check of their number."""
    n = words.count()
    if n > limit:
        raise ValueError(f"a reference list of {n} words is more than {limit}")
    return sorted({r[0] for r in words.select(word).where(F.col(word).isNotNull()).distinct().collect()})


def evidence(df: DataFrame, words: list[str], row: str, text: str, source: str) -> DataFrame:
    """A row per suspect unit: ``row_id, source, unit, chains, gains``; rows with unit -1 hold counts of the other units."""

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        chains = Chains(PairModel(words))
        for b in batches:
            out: dict[str, list] = {"row_id": [], "source": [], "unit": [], "chains": [], "gains": []}
            clean: dict[str, int] = {}

            def add(r, s, u, c, g, out=out):
                for k, v in zip(out, (r, s, u, c, g), strict=True):
                    out[k].append(v)

            for r, s, t in zip(b["row_id"], b["source"], b["text"], strict=True):
                for i, unit in enumerate(units(t)):
                    if unit.isascii():
                        continue
                    gains = chains.unit(unit)
                    if gains:
                        best = sorted(gains.items(), key=lambda x: (-x[1], x[0]))
                        over = max(0.0, best[0][1] - STRONG)
                        best = [(c, round((g - over) * 2) / 2) for c, g in best]
                        best = [x for x in best if x[1] > 0]
                        if best:
                            add(r, s, i, [c for c, _ in best], [g for _, g in best])
                        else:
                            clean[s] = clean.get(s, 0) + 1
                    else:
                        clean[s] = clean.get(s, 0) + 1
            for s, n in sorted(clean.items()):
                add(None, s, -1, ["none"], [float(n)])
            yield out

    narrow = df.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.col(row).cast("long").alias("row_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    return arrow_map(narrow, kernel, "row_id long, source string, unit int, chains array<string>, gains array<double>")


def shares(found: DataFrame) -> DataFrame:
    """``source, chain, share``: the chains' shares of each source by expectation-maximisation."""
    counted = found.groupBy("source", "chains", F.when(F.col("unit") >= 0, F.col("gains")).alias("gains")).agg(F.sum(F.when(F.col("unit") >= 0, F.lit(1.0)).otherwise(F.element_at("gains", 1))).alias("n"))

    def fit(key, rows):
        import pyarrow as pa

        share: dict[str, float] = {}
        columns = [rows.column(c).to_pylist() for c in ("chains", "gains", "n")]
        cases = [(n, c, g) for c, g, n in zip(*columns, strict=True) if g is not None]
        total = sum(columns[2])
        for _, c, _ in cases:
            share |= dict.fromkeys(c, PRIOR)
        for _ in range(ITERATIONS):
            sums = dict.fromkeys(share, PRIOR)
            none = max(1e-6, 1 - sum(share.values()))
            for n, c, g in cases:
                weight = [share[x] * math.exp(min(y, 50.0)) for x, y in zip(c, g, strict=True)]
                whole = none + sum(weight)
                for x, w in zip(c, weight, strict=True):
                    sums[x] += n * w / whole
            share = {x: v / (total + PRIOR * len(sums)) for x, v in sums.items()}
        return pa.table({"source": pa.array([key[0].as_py()] * len(share), pa.string()), "chain": pa.array(list(share), pa.string()), "share": pa.array(list(share.values()), pa.float64())})

    return counted.groupBy("source").applyInArrow(fit, "source string, chain string, share double")


def garbled_units(df: DataFrame, words: list[str], row: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``row_id, unit, chain, posterior`` of the units whose likeliest history is a wrong decoding."""
    found = cut(evidence(df, words, row, text, source))
    prior = shares(found).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("chain", "share"))).alias("prior"))
    suspects = found.where(F.col("unit") >= 0).join(prior, "source")
    weight = F.zip_with("chains", "gains", lambda c, g: F.struct((F.coalesce(F.element_at("prior", c), F.lit(0.0)) * F.exp(g)).alias("w"), c.alias("c")))
    whole = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y["w"])
    none = F.greatest(F.lit(1e-6), 1 - F.aggregate(F.map_values("prior"), F.lit(0.0), lambda a, x: a + x))
    scored = suspects.withColumn("w", weight).withColumn("sum", whole(F.col("w"))).withColumn("posterior", F.col("sum") / (F.col("sum") + none))
    return scored.where(F.col("posterior") > 0.5).select("row_id", "source", "unit", F.array_max("w")["c"].alias("chain"), "posterior")


def garbled(df: DataFrame, words: list[str], row: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per garbled text: ``row_id``."""
    return garbled_units(df, words, row, text, source).select("row_id").distinct()


def restore(df: DataFrame, words: list[str], row: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``row_id, text, restored_units`` of the garbled texts, every garbled unit undone by its chain."""
    # a row that is there twice has its marks twice
    marks = garbled_units(df, words, row, text, source).groupBy("row_id", "unit").agg(F.max("chain").alias("chain"))
    marks = marks.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("unit", "chain"))).alias("chains"))
    both = df.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.col(row).cast("long").alias("row_id"), F.col(text).alias("text")).join(send_small(marks), "row_id")

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        chains = Chains(PairModel(words))
        for b in batches:
            texts = []
            for t, m in zip(b["text"], b["chains"], strict=True):
                how = dict(m)
                texts.append("".join(chains.apply(u, how[i]) if i in how else u for i, u in enumerate(units(t))))
            yield {"row_id": b["row_id"], "text": texts, "restored_units": [len(m) for m in b["chains"]]}

    return arrow_map(both, kernel, "row_id long, text string, restored_units int")
