"""Problem 2: personal information in free text, replaced by typed placeholders.

Information-theoretic sanitisation.  The corpus says how strongly a term reveals a protected entity (a registered person,
or whoever a number, an address or a mailbox belongs to), in bits over what would be expected of running text:

* a word, by how much likelier it stands in the names of the registered people than in the answers;
* a context, by the share of the words it introduces that reveal a person;
* a form (the digits and signs of a number, a mailbox, a street), by how much likelier it stands in what users write
  than in the answers, which speak of no one.

A word is removed when its disclosure exceeds ``TERM_BITS``, or when it is no listed word and stands beside such a word or
in a context above ``CONTEXT_SHARE``.  What has the form of a mail or street address, telephone or identity number is
removed when the disclosure of its form exceeds ``FORM_BITS``; a form that is as common in the answers stays.  Forms
are taken first, so a name inside an address is no item.  Items below the threshold are left as they are, since the
result is to differ in nothing but the items; nothing is generalised to a broader term.

Counts are taken over all rows, of distinct names, so a busy user doesn't weigh more.  The revealing terms are sent to
the tasks if there are at most ``MAX_SENT`` of them, else they are joined to the words of each row.  Null
texts have no items and stay null; names of signs, manoeuvres and books aren't people.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomine.llm.frames import arrow_map
from foliomine.session import cut

TERM_BITS = 5.0
FORM_BITS = 1.0
CONTEXT_SHARE = 0.6
CONTEXT_LEAST = 5
#: A form counts as common in the answers if it stands in this share of them; at most one in so many are sent.
FORM_RATE = 1e-5
#: A context is counted if it makes up this share of all; at most one in so many are sent.
CONTEXT_RATE = 1e-5
MAX_SENT = 300_000
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

#: What a name before it is named after, and not a person.
EPONYMS = frozenset("sign signs manoeuvre maneuver manœuvre test tests syndrome disease procedure operation approach method technique phenomenon reflex classification score scale grade stage criteria triad atlas handbook book textbook journal guide manual review zeichen manöver signe signo sinal prueba probe".split())
#: Titles before a name.
TITLES = frozenset("dr dra drs mr mrs ms miss mx prof professor sir dame sister nurse herr frau hr fr mme mlle monsieur madame sr sra srta señor señora senhor senhora don doña dom pan pani docteur doctor doctora doutor doutora".split())

_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*"
_AT = r"(?:\s*@\s*|\s*[\[({]\s*(?:at|arroba|chez)\s*[\])}]\s*)"
_DOT = r"(?:\.|\s*[\[({]\s*(?:dot|punkt|point|punto|ponto)\s*[\])}]\s*)"
EMAIL = re.compile(rf"(?<![\w.+\-]){_LOCAL}{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)+", re.I)

_CAP = r"[A-ZÀ-ÖØ-ÞŁŚŻŹ](?:[^\W\d_]|['’\-]){0,40}"
_STREET = r"(?:street|st|road|rd|lane|ln|close|avenue|ave|drive|court|place|square|way|terrace|crescent|gardens|grove|hill|row|walk|boulevard|blvd|mews|parade)"
_TOWN = rf"(?:,? +(?:[A-Z]{{1,2}}-)?\d{{4,5}}(?:-\d{{3}})? +{_CAP}|, *{_CAP}(?: +{_CAP}\b(?! *[a-z]))?)"
_CODE = r"(?:,? +[A-Z]{1,2}\d[A-Z\d]? +\d[A-Z]{2}|,? +[A-Z]{2} +\d{5}(?:-\d{4})?)"
_FLAT = r"(?:,\s*(?i:apt|apartment|flat|unit|suite|no)\.?\s*\d+[a-z]?|,\s*\d{1,2}\s*[ºª°](?:\s*[A-Za-z]\b)?)"
_WORD_ANY = r"[^\W\d_][\w'’\-]{0,40}"
ADDRESS = re.compile(
    rf"(?<![\w])(?:"
    rf"(?:(?i:flat|apt|apartment|unit|suite)\.?\s*\d+[a-z]?,\s*)?\d{{1,4}}[a-z]?,?\s+(?:{_WORD_ANY}\s+){{1,3}}(?i:{_STREET})\b\.?"
    rf"|(?i:p\.?\s?o\.?\s?box|postfach|apartado(?:\s+de\s+correos)?|caixa\s+postal|skrytka\s+pocztowa|boîte\s+postale)\s*(?:nr\.?\s*|no\.?\s*)?\d+"
    rf"|\d{{1,4}}\s?(?:bis|ter|[a-z])?,?\s+(?i:rue|avenue|impasse|boulevard|allée|chemin|place|quai|cours|route|square)\s+(?:(?:de\s+la|de\s+l['’]|des|du|de|d['’])\s*)?{_CAP}(?:\s+{_CAP})?"
    rf"|(?i:calle|c/|avenida|av\.|plaza|paseo|rua|travessa|praça|largo|camino|ronda|estrada)\s+(?:(?:de\s+la|del|de\s+los|de|da|do|dos|das)\s+)?{_CAP}(?:\s+{_CAP}){{0,3}},?\s*(?:n\.?\s?[ºo°]\.?\s*)?\d{{1,4}}[a-z]?"
    rf"|(?:{_CAP}\s)?[A-ZÄÖÜ][\wäöüß\-]{{0,40}}(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|ufer|damm)\s+\d{{1,4}}\s?[a-z]?\b"
    rf"|(?i:ul\.|ulica|al\.|os\.)\s+{_CAP}(?:\s+{_CAP})?\s+\d{{1,4}}(?:/\d+)?"
    rf"){_FLAT}?{_TOWN}?{_CODE}?"
)

_ID_LABEL = r"(?:NHS(?:\s*(?:no|number|nr)\.?)?|health(?:\s*(?:service|insurance|card))?\s*(?:no|number)\.?|hospital\s*(?:no|number)\.?|MRN|(?:medical\s+)?record\s*(?:no|number)\.?|SSN|social\s+security(?:\s*(?:no|number)\.?)?|passport(?:\s*(?:no|number)\.?)?|national\s+(?:ID|identity|insurance)(?:\s*(?:no|number|card)\.?)?|identity\s+(?:card|no|number)\.?|ID(?:\s*(?:card|no|number)\.?)?|patient\s*(?:no|number|id)\.?|Ausweis(?:nummer)?|Personalausweis|Reisepass|Versichertennummer|passeport|sécurité\s+sociale|DNI|NIE|NIF|CPF|pasaporte|passaporte|PESEL|паспорт)"
ID_LABELLED = re.compile(rf"(?<![\w])(?:{_ID_LABEL})\s*(?:[:#]|n[º°o]\.?|nr\.?|№)?\s*(?P<item>[A-Z]{{0,3}}[- ]?\d[\d \-./]{{4,}}\d[A-Z]?|[A-Z]{{1,3}}\d{{5,}}[A-Z]?)", re.I)
ID_SHAPE = re.compile(r"(?<![\w.\-/+])(?:\d{3}-\d{2}-\d{4}|\d{4} \d{4} \d{4}|[A-Z]{1,2}\d{7}|\d{11}|(?<=, )\d{8,9})(?![\w\-/]|\.\d)")
PHONE = re.compile(r"(?<![\w.\-/])(?:\+\d{1,4}|00\d{2}|\(\+?\d{1,5}\)|\(?\d{2,5}\)?)(?:[\s.\-/]{0,2}\(?\d{2,12}\)?){0,6}(?![\w\-/]|\.\d)")
#: Words before a number that is no telephone number.
NUMBERED = frozenset("lot batch charge trial study code audiogram sats pressure pages page pp p at ward bed pulse dose ref reference nct isbn doi year years vol no".split())

_NAME_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]{2,})?")
_BEFORE = re.compile(r"(?<=[\s(–\-])((?:[^\W\d_]\.\s?){1,3})$")
_AFTER = re.compile(r"[\s\-]*([^\W\d_]+)")
_AFTER_ANOTHER = re.compile(rf"(?:-{_NAME_WORD.pattern})*[\s\-]+([^\W\d_]+)")


def numbers(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Identity and telephone numbers outside what is taken."""
    out: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or y <= a for x, y in taken) and all(b <= x or y <= a for x, y, _ in out)

    for m in ID_LABELLED.finditer(text):
        a, b = m.span("item")
        digits = sum(c.isdigit() for c in text[a:b])
        if 6 <= digits <= 16 and free(a, b):
            out.append((a, b, "id_number"))
    for m in ID_SHAPE.finditer(text):
        before = re.findall(r"\w+", text[max(0, m.start() - 40) : m.start()])[-1:]
        if free(*m.span()) and not (before and before[0].lower() in NUMBERED):
            out.append((*m.span(), "id_number"))
    for m in PHONE.finditer(text):
        item = m.group(0).rstrip(" .-/(")
        digits = re.sub(r"\D", "", item)
        before = re.findall(r"[^\W_]+", text[max(0, m.start() - 40) : m.start()])[-2:]
        last = before[-1].lower() if before else ""
        groups = re.findall(r"\d+", item)
        international = item[0] in "+(" or digits.startswith("00")
        if not 7 <= len(digits) <= 15 or not free(m.start(), m.start() + len(item)) or last in NUMBERED:
            continue
        if len(before) == 2 and before[0].lower() in NUMBERED and len(last) <= 3 and not international:
            continue
        years = len(groups) == 2 and all(len(g) == 4 and g[:2] in ("19", "20") for g in groups)
        local = digits[0] == "0" and len(digits) >= 9 or re.fullmatch(r"\(?\d{3}\)?[ .\-]?\d{3}[ .\-]\d{4}|\d{3}-\d{4}", item)
        if not years and (international or local):
            out.append((m.start(), m.start() + len(item), "phone"))
    return out


def forms(text: str) -> list[tuple[int, int, str]]:
    """What has the form of an item, whatever it reveals."""
    out = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    for m in ADDRESS.finditer(text):
        if all(m.end() <= a or b <= m.start() for a, b, _ in out):
            out.append((*m.span(), "address"))
    return out + numbers(text, [(a, b) for a, b, _ in out])


def form_of(item: str, kind: str) -> str:
    """The form of an item: its type, and for numbers the lengths of its groups and the signs between them."""
    if kind in ("email", "address"):
        return kind
    return kind + ":" + re.sub(r"\d+", lambda m: str(len(m.group(0))), re.sub(r"[^\W\d_]+", "A", item))


class Finder:
    """Finds the items of a text, given the revealing terms and contexts, the listed words and the forms that reveal no one."""

    def __init__(self, terms, contexts: set[str], listed: set[str], harmless: set[str] | frozenset[str] = frozenset()) -> None:
        self.terms, self.contexts, self.listed, self.harmless = terms, contexts, listed, harmless

    def items(self, text: str | None, terms=None) -> list[tuple[int, int, str]]:
        """(start, end, type) of each item, in order."""
        if not text:
            return []
        reveals = self.terms if terms is None else terms
        out = [x for x in forms(text) if form_of(text[x[0] : x[1]], x[2]) not in self.harmless]
        out += self.names(text, [(a, b) for a, b, _ in out], reveals)
        return sorted(out)

    def names(self, text: str, taken: list[tuple[int, int]], reveals) -> list[tuple[int, int, str]]:
        taken, k, words = sorted(taken), 0, []
        for m in _NAME_WORD.finditer(text):
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if k == len(taken) or m.end() <= taken[k][0]:
                words.append(m)
        n = len(words)
        strong = [False] * n
        maybe = [False] * n
        for i, m in enumerate(words):
            w = m.group(0)
            low = w.lower()
            upper = w[:1].isupper()
            if low in reveals:
                strong[i] = upper
                maybe[i] = True
            elif upper and len(w) > 1 and low not in self.listed and low not in TITLES and low not in EPONYMS:
                maybe[i] = True
        kept = [False] * n
        for i, m in enumerate(words):
            if not maybe[i]:
                continue
            w, low = m.group(0), m.group(0).lower()
            left, right = self._near(text, words, i, -1), self._near(text, words, i, 1)
            if low in reveals:
                # written small, one word alone may be an ordinary one
                kept[i] = strong[i] or (left is not None and words[left].group(0).lower() in reveals) or (right is not None and words[right].group(0).lower() in reveals)
            elif left is not None and strong[left] and text[words[left].end()] != ",":
                kept[i] = True  # a surname after a known first name
            elif left is not None and kept[left] and text[words[left].end() : m.start()] == "-":
                kept[i] = True
            elif i and words[i - 1].group(0).lower() in TITLES and re.fullmatch(r"\.?\s+", text[words[i - 1].end() : m.start()]):
                kept[i] = True
            elif context(text, m.start()) in self.contexts:
                kept[i] = True
        spans: list[list[int]] = []
        for i, m in enumerate(words):
            if not kept[i]:
                continue
            start = m.start()
            initial = _BEFORE.search(text[max(0, start - 12) : start] if start > 12 else f" {text[:start]}")
            if initial and initial.group(1)[0].isupper():
                start -= len(initial.group(1))
            if spans and re.fullmatch(r"(?:\s|-|‐|\s[^\W\d_]\.\s?|,\s)(?:[^\W\d_]\.\s?)*", text[spans[-1][1] : m.start()]) and "\n" not in text[spans[-1][1] : m.start()] and (text[spans[-1][1]] != "," or spans[-1][2] == 1):
                spans[-1][1] = m.end()
                spans[-1][2] += 1
            else:
                spans.append([start, m.end(), 1])
        out = []
        for a, b, _ in spans:
            after = _AFTER.match(text, b, b + 200)
            # two names and a sign are the sign's
            tail = _AFTER_ANOTHER.match(text, b, b + 200)
            if any(t and t.group(1).lower() in EPONYMS for t in (after, tail)):
                continue
            out.append((a, b, "name"))
        return out

    @staticmethod
    def _near(text: str, words: list[re.Match], i: int, step: int) -> int | None:
        """The word beside this one if only a space, a hyphen, an initial or a comma lies between."""
        j = i + step
        if not 0 <= j < len(words):
            return None
        a, b = (words[i], words[j]) if step > 0 else (words[j], words[i])
        gap = text[a.end() : b.start()]
        if re.fullmatch(r"\s|-|,\s|\s[^\W\d_]\.\s?", gap) and "\n" not in gap:
            return j
        # an initial is a word too
        if re.fullmatch(r"\s", gap) and len(words[j].group(0)) == 1:
            return Finder._near(text, words, j, step)
        return None


def context(text: str, at: int) -> str:
    """What stands before a place: the last two words with the signs between."""
    before = re.findall(r"[^\W_]+|[^\w\s]", text[max(0, at - 60) : at])[-2:]
    return " ".join(["^"] * (2 - len(before)) + before).lower()


def registered(logs: DataFrame, name: str = "user_name", answer: str = "answer") -> DataFrame:
    """``word, bits``: the words of the registered names above ``TERM_BITS``."""
    names = logs.select(F.lower(name).alias("name")).where(F.col("name").isNotNull()).distinct()
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}{2,})"), F.lit(1))
    in_names = names.select(F.explode(F.array_distinct(words(F.col("name")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("named"))
    # what an answer repeats of its own question is the user's text, not running text
    text = F.lower(answer)
    for asked in ("question", "resolved_question"):
        if asked in logs.columns:
            text = F.replace(text, F.coalesce(F.nullif(F.lower(asked), F.lit("")), F.lit("\n\n")), F.lit(" "))
    told = logs.where(F.col(answer).isNotNull()).select(text.alias("_told"))
    in_text = told.select(F.explode(words(F.col("_told"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("told"))
    in_text = cut(in_text)  # read twice, and a row for each word
    sums = names.agg(F.count(F.lit(1))).first()[0], in_text.agg(F.sum("told")).first()[0] or 0
    both = in_names.join(in_text, "word", "left").withColumn("told", F.coalesce("told", F.lit(0)))
    bits = F.log2((F.col("named") + 0.5) / (2 * sums[0] + 1)) - F.log2((F.col("told") + 0.5) / (sums[1] + 1))
    return both.withColumn("bits", bits).where(F.col("bits") > TERM_BITS).select("word", "bits")


def revealing_contexts(texts: DataFrame, terms: set[str] | None, listed: set[str]) -> set[str]:
    """The contexts that mostly introduce revealing terms, from all texts; without ``terms``, each text brings its own."""

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            counts: dict[str, list[int]] = {}
            for t, own in zip(b["text"], b["terms"], strict=True):
                reveals = terms if terms is not None else set(own or ())
                before = None
                for m in _NAME_WORD.finditer(t):
                    low = m.group(0).lower()
                    known = low in reveals
                    if len(low) > 1 and m.group(0)[0].isupper() and (known or low not in listed) and not (before and before in reveals):
                        got = counts.setdefault(context(t, m.start()), [0, 0])
                        got[0] += known
                        got[1] += 1
                    before = low
            yield {"context": list(counts), "known": [c[0] for c in counts.values()], "n": [c[1] for c in counts.values()]}

    found = arrow_map(texts.select("text", "terms").where(F.col("text").isNotNull()), kernel, "context string, known long, n long").groupBy("context").agg(F.sum("known").alias("known"), F.sum("n").alias("n")).persist()
    try:
        total = found.agg(F.sum("n")).first()[0] or 0
        rows = found.where((F.col("n") >= CONTEXT_LEAST) & (F.col("n") >= CONTEXT_RATE * total) & (F.col("known") >= CONTEXT_SHARE * F.col("n"))).collect()
    finally:
        found.unpersist()
    return {r["context"] for r in rows}


#: Words of streets that a number stands before.
_AFTER_NUMBER = "street|st|road|rd|lane|ln|close|avenue|ave|drive|court|place|square|way|terrace|crescent|gardens|grove|hill|row|walk|boulevard|blvd|mews|parade|rue|impasse|allée|chemin|quai|cours|route"
#: What an item of a form must hold, for the scan; every branch begins with a sign that is rare in running text: the
#: sign of a mailbox, six digits, a number before a word of streets, after a capital word, or after the end of a word for
#: boxes.
SUSPECT = (
    r"@|[\[({]\s*(?i:at|arroba|chez)\s*[\])}]|[0-9](?:[^0-9\p{L}]{0,3}[0-9]){5}|[0-9]{5}(?<=\p{Lu}[0-9]{5})"
    rf"|[0-9](?<![0-9][0-9])[0-9]*+[a-z]?,?\s(?:\S++\s++){{0,3}}?(?i:{_AFTER_NUMBER})\b"
    r"|\p{Lu}[\p{L}'’\-]{1,40}+,?\s+(?:n\.?\s?[ºo°]\.?\s*)?[0-9]"
    r"|[0-9](?<=(?i:box|postfach|apartado|correos|postal|postale|pocztowa)\s{0,2}(?:(?i:nr|no)\.?\s{0,2})?[0-9])"
)


def harmless_forms(logs: DataFrame, fields: tuple[str, ...], answer: str = "answer") -> set[str]:
    """The forms of ``form_of`` whose disclosure is at most ``FORM_BITS``: as common in the answers as in what users write."""
    asked = [c for c in fields if c in logs.columns]

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            counts: dict[str, list[int]] = {}
            for said, answer_text in zip(b["said"], b["answer"], strict=True):
                own = "\n".join(x for x in said if x)
                for side, text in enumerate((own, answer_text or "")):
                    if not text:
                        continue
                    seen = {form_of(text[x:y], k) for x, y, k in forms(text) if side == 0 or text[x:y].lower() not in own.lower()}
                    for form in seen:
                        counts.setdefault(form, [0, 0])[side] += 1
            yield {"form": list(counts), "asked": [c[0] for c in counts.values()], "told": [c[1] for c in counts.values()]}

    suspect = F.coalesce(F.col(answer).rlike(SUSPECT), F.lit(False))
    # a form that no answer holds has its full disclosure, so the users' texts are counted only beside such answers' forms
    held = logs.where(suspect).select(F.array(F.lit(None).cast("string"), *[F.col(c) for c in asked]).alias("said"), F.col(answer).alias("answer"))
    told = arrow_map(held, kernel, "form string, asked long, told long").groupBy("form").agg(F.sum("told").alias("told"))
    n = logs.agg(F.count(answer), F.count(F.lit(1))).first()
    told = told.where((F.col("told") > 0) & (F.col("told") >= FORM_RATE * n[0]))
    common = {r["form"]: r["told"] for r in told.collect()}
    if not common:
        return set()
    questions = logs.where(F.coalesce(F.concat_ws("\n", *asked).rlike(SUSPECT), F.lit(False))).select(F.array(*[F.col(c) for c in asked]).alias("said"), F.lit(None).cast("string").alias("answer"))
    counted = arrow_map(questions, kernel, "form string, asked long, told long").groupBy("form").agg(F.sum("asked").alias("asked")).where(F.col("form").isin(list(common)))
    written = {r["form"]: r["asked"] for r in counted.collect()}
    bits = lambda f: log2((written.get(f, 0) + 0.5) / (n[1] + 1)) - log2((common[f] + 0.5) / (n[0] + 1))
    return {f for f in common if bits(f) <= FORM_BITS}


def _long(logs: DataFrame, row: str, fields: tuple[str, ...]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("p")
    return logs.select(F.col(row).cast("long").alias("row_id"), pairs).select("row_id", "p.field_name", "p.text").where(F.col("text").isNotNull())


def _found(logs: DataFrame, listed: list[str], row: str, fields: tuple[str, ...], sent: int = MAX_SENT) -> tuple[DataFrame, set[str] | None, set[str], set[str], set[str]]:
    """The texts (with their revealing terms, if those are too many to send), and what is sent."""
    listed_set = {w.lower() for w in listed}
    texts = _long(logs, row, fields)
    harmless = harmless_forms(logs, fields)
    terms = registered(logs).persist()
    n = terms.count()
    if n <= sent:
        known = {r["word"] for r in terms.collect()}
        terms.unpersist()
        plain = texts.withColumn("terms", F.lit(None).cast("array<string>"))
        return plain, known, revealing_contexts(plain, known, listed_set), listed_set, harmless
    words = texts.select("row_id", "field_name", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{2,})"), F.lit(1)))).alias("word"))
    per_text = words.join(terms, "word").groupBy("row_id", "field_name").agg(F.collect_list("word").alias("terms"))
    joined = texts.join(per_text, ["row_id", "field_name"], "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    return joined, None, revealing_contexts(joined, None, listed_set), listed_set, harmless


def items_found(logs: DataFrame, listed: list[str], row: str = "id", fields: tuple[str, ...] = ("question", "resolved_question"), sent: int = MAX_SENT) -> DataFrame:
    """``row_id, field_name, pii_type, start_pos``: one row per item; positions count from 1."""
    texts, known, contexts, words, harmless = _found(logs, listed, row, fields, sent)

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        finder = Finder(known, contexts, words, harmless)
        for b in batches:
            out: dict[str, list] = {"row_id": [], "field_name": [], "pii_type": [], "start_pos": []}
            for r, f, t, own in zip(b["row_id"], b["field_name"], b["text"], b["terms"], strict=True):
                for a, _, kind in finder.items(t, None if own is None else set(own)):
                    for k, v in zip(out, (r, f, kind, a + 1), strict=True):
                        out[k].append(v)
            yield out

    return arrow_map(texts, kernel, "row_id long, field_name string, pii_type string, start_pos int")


def sanitised(logs: DataFrame, listed: list[str], row: str = "id", fields: tuple[str, ...] = ("question", "resolved_question"), sent: int = MAX_SENT) -> DataFrame:
    """``row_id, field_name, text, removed`` of the non-null texts, each item replaced by the placeholder of its type."""
    texts, known, contexts, words, harmless = _found(logs, listed, row, fields, sent)

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        finder = Finder(known, contexts, words, harmless)
        for b in batches:
            clean, removed = [], []
            for t, own in zip(b["text"], b["terms"], strict=True):
                items = finder.items(t, None if own is None else set(own))
                for a, z, kind in reversed(items):
                    t = t[:a] + PLACEHOLDER[kind] + t[z:]
                clean.append(t)
                removed.append(len(items))
            yield {"row_id": b["row_id"], "field_name": b["field_name"], "text": clean, "removed": removed}

    return arrow_map(texts, kernel, "row_id long, field_name string, text string, removed int")
