"""Problem 1: defective question-answer pairs, by a conditional random field over the clauses of the answer.

Each clause is tagged ``answer``, ``refusal``, ``echo``, ``foreign`` or ``unfinished``; the share of the answer that
each tag covers gives the pair's defect.  All logs teach it: what is counted (languages of words, ends of clauses, frames
of refusals, closing clauses) is counted over all of them, and the field is trained on all of them, in shards of about
``SAMPLE_ROWS`` logs by a hash of the row; the shards' weights are averaged.  The logs teach

* sound answers, taken as they are, and spoilt on purpose: cut, replaced by the question or by another language's answer;
* refusals: answers of nothing but clauses with several cues of refusing and of clauses that over many different
  questions stand beside such clauses only; plus refusals composed of general phrases (``refusals``);
* how likely a clause ends after its last words, and which words belong to which language.

Null answers, and answers of nothing but blanks, punctuation and placeholder words, have no clause and are ``empty``.  A
null question has no language and nothing to repeat.  A pair has at most one defect, in the order of ``DEFECTS``.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from collections.abc import Container, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomine.llm.frames import arrow_map
from foliomine.session import cut

SAMPLE_ROWS = 6000
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
DEFECTS = ("empty", "copied_question", "refusal", "wrong_language", "truncated")
HASHED = 1 << 14
EPOCHS = 6
SEED = 20240601

#: Words that stand for no answer.
PLACEHOLDERS = frozenset("n/a na none null nil nan no answer unknown tbd todo undefined empty missing keine antwort sin respuesta sem resposta aucune réponse brak odpowiedzi нет ответа".split())
#: Function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is was were are for with on at by from that this which it be has have not or as what how when why who does do can could should would may after before during than then there their its",
    "de": "der die das den dem des und ist nicht mit von bei für ein eine einer einen wird werden sollte wann wie was welche nach auf im zur zum sich auch oder als aus durch über vor man sind kann",
    "fr": "le la les des du de et est une un dans pour pas avec sur par au aux que qui quel quelle quand pourquoi après chez il on plus ce cette sans ou sont être d l n s qu",
    "es": "el la los las de del y es en que una un por para con se no al cuál cuándo qué más después debe son su como esta este o sin",
    "pt": "o a os as de do da dos das e é em que uma um por para com se não ao à qual quando quanto deve ser mais depois são sua como no na ou sem pelo pela",
    "pl": "i w z na do się jest nie po u o za od przez dla oraz co który która także lub przy są jak kiedy",
    "ru": "и в на с по не что это у о за от для при как из после через если также или только",
}
LANGS = tuple(FUNCTION_WORDS)
#: How a language is asked for.
ASKED = {"en": "english englisch anglais inglés inglês angielsku английском", "de": "german deutsch allemand alemán alemão niemiecku немецком", "fr": "french französisch français francés francês francusku французском", "es": "spanish spanisch espagnol español castellano espanhol hiszpańsku испанском", "pt": "portuguese portugiesisch portugais portugués português portugalsku португальском", "pl": "polish polnisch polonais polaco polonês polsku польском", "ru": "russian russisch russe ruso russo rosyjsku русском"}
#: Groups of words by which refusals are known.
CUES = {
    "sorry": "sorry apologies apologise apologize unfortunately regret désolé désolée malheureusement leider leid siento lamento lamentablemente desculpe infelizmente lamento niestety przepraszam извините сожалению",
    "not": "not cannot can't don't won't unable no nothing never without isn't nicht keine kein nichts ne pas aucune rien no ninguna nada não nenhuma nie nic не нет ничего",
    "self": "i i'm we my our assistant service system ich wir mir je nous me yo nosotros eu ja я мы dispongo puedo posso peux suis kann mogę могу",
    "reply": "answer answers respond reply help advise discuss comment guess say tell processed provide beantworten auskunft antworten répondre renseigner aider responder contestar ayudar atender ajudar odpowiedzieć ответить помочь",
    "sources": "books book sources passages passage library pages material indexed retrieved search chapters texts vorliegenden büchern bücher ouvrages livres sources libros fuentes livros fontes książki книги книгах источники",
    "decline": "decline declined refuse refused pass rather permitted allowed beyond outside scope only deals short mislead topic topics right abordan tratan traitent abordam sujet tema mesure",
    "refer": "please ask rephrasing rephrase try specialist consult consulted consultez team wish else anything passed editors bitte formulieren frage anders veuillez spécialiste consulte especialista reformule",
    "cover": "cover covers detail closest entry concerns another altogether list chapters however",
}
#: General phrases refusals are composed of: openings, bodies, what may follow; by language.
PHRASES = {
    "en": (
        "Sorry,|Regrettably,|I'm afraid|My apologies,",
        "I can't say anything about that|I am not in a position to say|we were unable to find an answer anywhere|no reply to this can be given here|I have no information about it|the texts contain nothing on this subject|this topic is not covered by our sources|I must refuse to reply to it|this is outside what I may talk about|it isn't possible for me to advise you|I don't know the answer to it|none of the passages answers it|I won't answer that request|nothing relevant turned up in the search|our service can only discuss other matters|I could not locate any passage about it",
        "Please ask something else.|You could try other words.|A doctor should be asked instead.|Can I help with anything more?|Your request went to our staff.|Only a related topic was found.|Thanks for your question.",
    ),
    "de": ("Leider|Bedauerlicherweise", "kann ich dazu nichts sagen|habe ich darüber keine Angaben|steht davon nichts in den Quellen|weiß ich keine Antwort darauf|darf ich dazu nicht beraten", "Bitte stellen Sie eine andere Frage.|Fragen Sie einen Arzt."),
    "fr": ("Malheureusement,|Je regrette,", "je ne peux rien dire à ce propos|nos sources n'en disent rien|je n'ai pas la réponse|il m'est impossible de vous conseiller", "Posez une autre question.|Demandez à un médecin."),
    "es": ("Por desgracia,|Lo lamento,", "no puedo decir nada sobre esto|nuestras fuentes no dicen nada|no tengo la respuesta|me es imposible aconsejarle", "Haga otra pregunta.|Pregunte a un médico."),
    "pt": ("Lamento,|Por azar,", "não posso dizer nada sobre isso|as nossas fontes não dizem nada|não tenho a resposta|é-me impossível aconselhar", "Faça outra pergunta.|Pergunte a um médico."),
    "pl": ("Przykro mi,|Niestety,", "nie mogę nic o tym powiedzieć|źródła nic o tym nie mówią|nie znam odpowiedzi", "Proszę zadać inne pytanie."),
    "ru": ("Увы,|Простите,", "я ничего не могу об этом сказать|источники об этом молчат|я не знаю ответа", "Задайте другой вопрос."),
}
#: Modest beginnings after which an answer still follows.
MODEST = ("There is no single figure, but this can be said.", "It is hard to answer briefly.", "I regret your trouble.", "I can't repeat often enough that this is important.", "Speaking generally, not from the sources:", "Though unable to walk, such patients recover.")
#: Labels before a repeated question.
LABELS = r"(?:q|a|question|answer|you asked|your question|the question|frage|antwort|pregunta|respuesta|pergunta|resposta|réponse|re)"

_CITE = re.compile(r"\[[^\[\]\n]{1,60}\]")
_CLAUSE = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+|\n+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_BLANK = re.compile(r"[\W_]+")
_LABEL = re.compile(rf"^\W*{LABELS}\s*[:–-]\s*", re.I)
_END = re.compile(r"[.!?][\"'”’)*]*\s*$")
_DANGLING = re.compile(r"[,;:(\[{–—…/&+-]\s*$|\.\.\.$")


def is_empty(answer: str | None) -> bool:
    """Null, or nothing but blanks, punctuation and placeholder words."""
    if answer is None:
        return True
    words = _WORD.findall(answer.lower())
    if not words:
        return True
    if len(words) > 3:
        return False
    text = " ".join(words)
    return text in ("n a", "no answer", "keine antwort", "sin respuesta", "sem resposta", "aucune réponse", "brak odpowiedzi", "нет ответа") or (len(words) == 1 and words[0] in PLACEHOLDERS - {"no", "answer", "antwort", "respuesta", "resposta", "réponse", "sin", "sem", "brak"})


def _key(text: str) -> str:
    return _BLANK.sub(" ", text.lower()).strip()


def only_repeats(answer: str, *questions: str | None) -> bool:
    """Whether the answer is the question, once or more often, with at most labels around it."""
    lines = re.split(r"\n+", answer)
    whole = _key(_LABEL.sub("", answer))
    for question in questions:
        asked = _key(question or "")
        if not asked:
            continue
        if whole == asked or all(_key(_LABEL.sub("", line)) in ("", asked) for line in lines):
            return True
        rest = re.sub(rf"\b{LABELS}\b", " ", whole.replace(asked, " "))
        if asked in whole and not rest.strip() and len(asked) > 5:
            return True
    return False


def clauses(answer: str) -> list[str]:
    """Sentences and lines without complete citations; rows and items of lists are clauses of their own."""
    return [c.strip() for c in _CLAUSE.split(_CITE.sub(" ", answer)) if _WORD.search(c) or c.strip() in ("|",)]


def key64(text: str) -> int:
    """A number of 64 bits for a text, the same in every process."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


#: An odd number by which the first key of a pair is multiplied.
MIXED = 0x9E3779B97F4A7C15


class Keys:
    """What is known of texts, by their keys: nine bytes each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray | None = None) -> None:
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.zeros(len(keys), np.uint8) if values is None else values[order].astype(np.uint8)

    def get(self, key: int) -> int | None:
        at = int(self.keys.searchsorted(np.uint64(key)))
        return int(self.values[at]) if at < len(self.keys) and int(self.keys[at]) == key else None

    def __contains__(self, text: str) -> bool:
        return self.get(key64(text)) is not None


class Languages:
    """Languages by the words of the reference list and common words."""

    def __init__(self, words: list[tuple[str, str]]) -> None:
        self.weight: dict[str, dict[str, float]] = {}
        for lang, listed in FUNCTION_WORDS.items():
            for w in listed.split():
                self.weight.setdefault(w, {})[lang] = 2.0
        for w, lang in words:
            if lang in FUNCTION_WORDS:
                self.weight.setdefault(w.lower(), {}).setdefault(lang, 1.0)
        for langs in self.weight.values():
            shared = len(langs)
            for lang in langs:
                langs[lang] /= shared
        self.learnt: Keys | None = None
        self.cache: dict[str, dict[str, float]] = {}
        self.asked = {w: lang for lang, listed in ASKED.items() for w in listed.split()}

    def learn(self, texts: list[tuple[str, str]]) -> None:
        """Words that (language, text) pairs hold in one language only, three times at least, count for it."""
        seen: dict[str, Counter] = {}
        for lang, text in texts:
            for w in set(_WORD.findall(text.lower())):
                seen.setdefault(w, Counter())[lang] += 1
        for w, langs in seen.items():
            lang, n = langs.most_common(1)[0]
            if n >= 3 and n >= 0.95 * sum(langs.values()) and w not in self.weight and not w.isdigit():
                self.weight[w] = {lang: 1.0}
        self.cache.clear()

    def word(self, word: str) -> dict[str, float]:
        """What a word, or its parts around apostrophes, says for each language."""
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = {}
            for w in re.split("['’]", word):
                known = self.weight.get(w)
                if known is None and self.learnt is not None and (code := self.learnt.get(key64(w))) is not None:
                    known = {LANGS[code]: 1.0}
                for lang, weight in (known or {}).items():
                    got[lang] = got.get(lang, 0.0) + weight
                for c in "" if w.isascii() else w:
                    lang, weight = ("ru", 1.0 / len(w)) if "а" <= c <= "я" else ("pt", 1.0) if c in "ãõ" else ("es", 1.0) if c == "ñ" else ("de", 1.0) if c in "ßäöü" else ("pl", 1.0) if c in "łżźćśęą" else ("fr", 0.7) if c in "èêëœùûî" else ("", 0.0)
                    if lang:
                        got[lang] = got.get(lang, 0.0) + weight
            self.cache[word] = got
        return got

    @staticmethod
    def best(scores: dict[str, float], n: int) -> tuple[str | None, float]:
        """The likeliest language and its lead per word."""
        first, second, lang = 0.0, 0.0, None
        for k, v in scores.items():
            if v > first:
                first, second, lang = v, first, k
            elif v > second:
                second = v
        return (lang, (first - second) / max(4, n)) if first >= 1.0 else (None, 0.0)

    def of(self, text: str) -> tuple[str | None, float]:
        words = _WORD.findall(text.lower())
        scores: dict[str, float] = {}
        for w in words:
            for lang, weight in self.word(w).items():
                scores[lang] = scores.get(lang, 0.0) + weight
        return self.best(scores, len(words))

    def requested(self, text: str) -> set[str]:
        words = _WORD.findall(text.lower())
        if self.asked.keys().isdisjoint(words):
            return set()
        if not re.search(r"\b(?:answer|reply|write|respond|antwort\w*|schreib\w*|répond\w*|réponse|respond\w*|responda|resposta|respuesta|escrib\w*|escrev\w*|in|auf|en|em|po|на)\b", text.lower()):
            return set()
        return {self.asked[w] for w in words if w in self.asked}


class Ends:
    """How likely a clause ends after its last words."""

    def __init__(self) -> None:
        self.ends: Counter = Counter()
        self.all: Counter = Counter()
        self.inside: Counter = Counter()

    @staticmethod
    def _words(clause: str) -> list[str]:
        return ["#" if w.isdigit() else w for w in _WORD.findall(clause.lower())]

    def learn(self, clause: str) -> None:
        words = self._words(clause)
        for a, b in zip(["", *words], words):
            self.all[a, b] += 1
            self.all[b] += 1
        self.inside.update(words if _END.search(clause) else words[:-1])
        if words:
            self.ends[words[-2] if len(words) > 1 else "", words[-1]] += 1
            self.ends[words[-1]] += 1

    def likely(self, clause: str) -> float:
        words = self._words(clause)
        if not words:
            return 0.0
        pair = (words[-2] if len(words) > 1 else "", words[-1])
        if self.all[pair] >= 8:
            return self.ends[pair] / (self.all[pair] + 1)
        return self.ends[words[-1]] / (self.all[words[-1]] + 3)

    def known(self, word: str) -> bool:
        """Whether a word stands inside of clauses three times at least."""
        return self.inside[word] >= 3


#: Nothing but the side of these limits on which a likelihood lies is asked for; a value for each range between them.
LIMITS, LIKELY = (0.05, 0.25, 0.3, 0.5), (0.0, 0.1, 0.28, 0.4, 0.9)


def _range(p: Column) -> Column:
    """The number of the range a likelihood lies in."""
    a, b, c, d = (F.lit(x) for x in LIMITS)
    return F.when(p < a, 0).when(p < b, 1).when(p <= c, 2).when(p < d, 3).otherwise(4)


class CountedEnds:
    """``Ends`` from counts over a table: the range of each word's likelihood (and 8 if the word is known), and that of
    each pair of words for which it is another than the last word's."""

    def __init__(self, words: Keys, pairs: Keys) -> None:
        self.words, self.pairs = words, pairs

    def likely(self, clause: str) -> float:
        words = Ends._words(clause)
        if not words:
            return 0.0
        last = key64(words[-1])
        got = self.pairs.get((key64(words[-2] if len(words) > 1 else "") * MIXED + last) % (1 << 64))
        return LIKELY[(self.words.get(last) or 0) & 7 if got is None else got]

    def known(self, word: str) -> bool:
        return (self.words.get(key64(word)) or 0) >= 8


class Words(dict):
    """Numbers of words, given as they are met; what is known of a word stands at its number in the arrays."""

    def __init__(self, languages: Languages, cue: dict[str, int]) -> None:
        super().__init__()
        self.languages, self.cue = languages, cue
        self.size = 0
        self.feature = np.zeros(1 << 12, np.int32)
        self.mask = np.zeros(1 << 12, np.uint8)
        self.scores = np.zeros((1 << 12, len(LANGS)), np.float32)

    def __missing__(self, word: str) -> int:
        n = self.size
        if n == len(self.feature):
            self.feature, self.mask = np.concatenate([self.feature, np.zeros_like(self.feature)]), np.concatenate([self.mask, np.zeros_like(self.mask)])
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        # words have the upper half to themselves
        self.feature[n] = zlib.crc32(f"w:{word}".encode()) % (HASHED // 2) + HASHED // 2
        self.mask[n] = self.cue.get(word, 0)
        for lang, weight in self.languages.word(word).items():
            self.scores[n, LANGS.index(lang)] += weight
        self[word] = n
        self.size += 1
        return n

    def forget(self) -> None:
        self.clear()
        self.size = 0
        self.scores[:] = 0

    def leading(self, texts: list[str]) -> list[str | None]:
        """The likeliest language of each text."""
        found = [list(map(self.__getitem__, _WORD.findall(text.lower()))) for text in texts]
        size = np.array([len(x) for x in found], np.int64)
        of, _ = _leading(_sums(self.scores[np.array([n for x in found for n in x], np.int64)], size), size)
        return [LANGS[n] if n >= 0 else None for n in of.tolist()]


def _sums(values: np.ndarray, sizes: np.ndarray, how=np.add) -> np.ndarray:
    """The sum (or other reduction) of each run of the given sizes; 0 for empty runs."""
    out = np.zeros((len(sizes), *values.shape[1:]), values.dtype)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
        out[full] = how.reduceat(values, starts, axis=0)
    return out


def _leading(scores: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest language of each row (-1 for none) and its lead per word."""
    order = np.sort(scores, axis=1)
    first, second = order[:, -1], order[:, -2]
    sure = first >= 1.0
    return np.where(sure, scores.argmax(axis=1), -1), np.where(sure, (first - second) / np.maximum(4, n_words), 0.0)


class Rows:
    """The features of all clauses of a batch of answers: those of the words, and the others, clause by clause."""

    def __init__(self, answers: np.ndarray, words: np.ndarray, word_sizes: np.ndarray, others: np.ndarray, other_sizes: np.ndarray) -> None:
        self.answers, self.words, self.word_sizes, self.others, self.other_sizes = answers, words, word_sizes, others, other_sizes

    def split(self) -> list[list[np.ndarray]]:
        """The features of each clause of each answer, each once."""
        a = np.split(self.words, np.cumsum(self.word_sizes)[:-1])
        b = np.split(self.others, np.cumsum(self.other_sizes)[:-1])
        clauses = [np.unique(np.concatenate(x)) for x in zip(a, b, strict=True)] if len(self.word_sizes) else []
        at, out = 0, []
        for n in self.answers.tolist():
            out.append(clauses[at : at + n])
            at += n
        return out


class Featuriser:
    """The features of each clause of each answer, as numbers below ``HASHED``."""

    def __init__(self, languages: Languages, ends: Ends | CountedEnds) -> None:
        self.languages, self.ends = languages, ends
        self.groups = sorted(CUES)
        cue: dict[str, int] = {}
        for g, listed in CUES.items():
            for w in listed.split():
                cue[w] = cue.get(w, 0) | 1 << self.groups.index(g)
        self.words = Words(languages, cue)
        self.named: dict[str, int] = {}
        self.cued: dict[int, list[int]] = {}

    def _hash(self, name: str) -> int:
        got = self.named.get(name)
        if got is None:
            got = self.named[name] = zlib.crc32(name.encode()) % (HASHED // 2)
        return got

    def _cues(self, mask: int) -> list[int]:
        got = self.cued.get(mask)
        if got is None:
            groups = [g for i, g in enumerate(self.groups) if mask >> i & 1]
            names = [f"cue:{g}" for g in groups] + [f"cues:{a}+{b}" for j, a in enumerate(groups) for b in groups[j + 1 :]] + [f"cues{min(len(groups), 4)}"]
            got = self.cued[mask] = [self._hash(n) for n in names]
        return got

    def rows(self, pairs: list[tuple[str | None, str | None, str, list[str]]]) -> Rows:
        """The features of (question, resolved question, answer, clauses) pairs."""
        words, number = self.words, self.words.__getitem__
        if words.size > 300_000:
            words.forget()
        asked, asked_size, lead_size, flat, sizes, last = [], [], [], [], [], []
        for q, r, _, parts in pairs:
            own = list(map(number, _WORD.findall((q or r or "").lower())))
            more = list(map(number, _WORD.findall(r.lower()))) if q and r and r != q else []
            lead_size.append(len(own))
            asked_size.append(len(own) + len(more))
            asked += own
            asked += more
            found: list[str] = []
            for part in parts:
                found = _WORD.findall(part.lower())
                flat += map(number, found)
                sizes.append(len(found))
            last.append(found)
        n_parts = np.array([len(p[3]) for p in pairs], np.int64)
        ids, size = np.array(flat, np.int64), np.array(sizes, np.int64)
        asked_ids, asked_n = np.array(asked, np.int64), np.array(asked_size, np.int64)
        pair_of = np.repeat(np.repeat(np.arange(len(pairs)), n_parts), size)
        wide = words.size + 1
        known = np.isin(pair_of * wide + ids, np.repeat(np.arange(len(pairs)), asked_n) * wide + asked_ids)
        shared = _sums(known.astype(np.int64), size)
        mask = _sums(words.mask[ids], size, np.bitwise_or).tolist()
        scores = _sums(words.scores[ids], size)
        of, lead = _leading(scores, size)
        all_scores = _sums(scores, n_parts)
        whole, _ = _leading(all_scores, _sums(size, n_parts))
        # the language of a question is that of its own words, without those of the resolved one
        first = np.arange(len(asked_ids)) - np.repeat(np.cumsum(asked_n) - asked_n, asked_n) < np.repeat(np.array(lead_size, np.int64), asked_n)
        lang, sure = _leading(_sums(np.where(first[:, None], words.scores[asked_ids], 0.0), asked_n), np.array(lead_size, np.int64))
        shares, sizes_l, shared_l, of_l, lead_l, whole_l, lang_l, sure_l = (shared * 4 // np.maximum(1, size)).tolist(), size.tolist(), shared.tolist(), of.tolist(), lead.tolist(), whole.tolist(), lang.tolist(), sure.tolist()
        h, others, other_sizes, at = self._hash, [], [], 0
        for i, (q, r, answer, parts) in enumerate(pairs):
            allowed = {LANGS.index(x) for x in self.languages.requested(f"{q or ''} {r or ''}")}
            if lang_l[i] >= 0:
                allowed.add(lang_l[i])
            pair = "" if whole_l[i] < 0 or lang_l[i] < 0 else "pair_own" if whole_l[i] in allowed else "pair_other"
            keys = None
            for j, clause in enumerate(parts):
                n = sizes_l[at]
                row = [h("bias"), h(f"n{min(n, 12) // 3}"), h("first" if j == 0 else "later"), h("last" if j == len(parts) - 1 else "inner"), *self._cues(mask[at])]
                same = False
                if shared_l[at] and (shared_l[at] * 2 >= n or n <= 4):
                    # only a clause of the question's own words can stand in it
                    keys = keys or (_key(q or ""), _key(r or ""))
                    key = _key(_LABEL.sub("", clause))
                    same = bool(key) and (key in keys or (len(key) > 12 and any(key in k for k in keys)))
                row.append(h("same" if same else f"share{shares[at]}"))
                if of_l[at] >= 0 and allowed and sure_l[i] > 0:
                    own_name = "own" if of_l[at] in allowed else "other3" if lead_l[at] > 0.25 else "other2" if lead_l[at] > 0.12 else "other1"
                    row += [h(own_name), h(pair), h(own_name + pair)]
                if j == len(parts) - 1:
                    row += [h(n) for n in self._ending(parts, last[i], answer)]
                others += row
                other_sizes.append(len(row))
                at += 1
        return Rows(n_parts, words.feature[ids], size, np.array(others, np.int64), np.array(other_sizes, np.int64))

    def _ending(self, parts: list[str], words: list[str], answer: str) -> list[str]:
        """How the answer ends: a sentence, a row, an item, a citation, or none of them."""
        clause, names = parts[-1], []
        tail = _CITE.sub(" ", answer).rstrip()
        ended = bool(_END.search(tail))
        names.append("ended" if ended else "open")
        if _DANGLING.search(tail):
            names.append("dangling")
        if tail.count("[") != tail.count("]") or tail.count("(") > tail.count(")"):
            names.append("unclosed")
        if not ended:
            p = self.ends.likely(clause)
            if words:
                names.append("known" if self.ends.known(words[-1]) or words[-1].isdigit() else "rare")
            names.append(f"end{0 if p < 0.05 else 1 if p < 0.25 else 2 if p < 0.5 else 3}")
        rows = [p for p in parts if p.startswith("|") or p.endswith("|")]
        if rows and clause in rows:
            # a row is finished if it has the cells of the first one
            names.append("row_short" if tail.split("\n")[-1].count("|") < rows[0].count("|") or not tail.endswith("|") else "row_full")
        last = tail.split("\n")[-1].strip()
        if re.fullmatch(r"[-*•]|\(?\d{1,3}[.)]?|\|", last):
            names.append("marker")
        elif re.match(r"\d{1,3}[.)]\s", last):
            names.append("item")
        return names


def _by_length(sizes: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        out.setdefault(n, []).append(i)
    return out


class Field:
    """A linear-chain conditional random field over hashed features; answers of equal length are computed together."""

    def __init__(self) -> None:
        k = len(TAGS)
        self.weights = np.zeros((HASHED, k))
        self.steps = np.zeros((k + 1, k))  # the last row: from the start

    def scores(self, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sum of the weights of each clause's features."""
        return _sums(self.weights[features], sizes)

    def train(self, data: list[tuple[list[np.ndarray], list[int]]], epochs: int = EPOCHS, rate: float = 0.25, seed: int = SEED, batch: int = 24) -> None:
        """Stochastic gradient ascent on the conditional likelihood with adaptive steps, in batches of equal length."""
        rng = random.Random(seed)
        g_w, g_s = np.full_like(self.weights, 1e-6), np.full_like(self.steps, 1e-6)
        k = len(TAGS)
        # whether a clause is foreign depends on the pair; its words by themselves don't tell
        foreign = np.array([t == "foreign" for t in TAGS])
        groups = _by_length([len(tags) for _, tags in data])
        for _ in range(epochs):
            batches = []
            for members in groups.values():
                rng.shuffle(members)
                batches += [members[at : at + batch] for at in range(0, len(members), batch)]
            rng.shuffle(batches)
            for members in batches:
                rows = [row for m in members for row in data[m][0]]
                tags = np.array([data[m][1] for m in members])
                b, n = tags.shape
                sizes = np.array([len(row) for row in rows])
                flat = np.concatenate(rows)
                e = self.scores(flat, sizes).reshape(b, n, k)
                marginal, pairs = self._marginals(e)
                step = np.zeros_like(self.steps)
                gold = np.eye(k)[tags]
                step[k] = (gold[:, 0] - marginal[:, 0]).sum(axis=0)
                if n > 1:
                    step[:k] = np.einsum("bni,bnj->ij", gold[:, :-1], gold[:, 1:]) - pairs
                g_s += step * step
                self.steps += rate * step / np.sqrt(g_s + 1e-2)
                slope = (gold - marginal).reshape(b * n, k)
                owner = np.repeat(np.arange(len(rows)), sizes)
                index, place = np.unique(flat, return_inverse=True)
                change = np.stack([np.bincount(place, slope[owner, t], len(index)) for t in range(k)], axis=1)
                change[(index >= HASHED // 2)[:, None] & foreign] = 0.0
                g_w[index] += change * change
                self.weights[index] += rate * change / np.sqrt(g_w[index] + 1e-2) - 1e-5 * self.weights[index]

    def _marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each clause's tag probabilities, and the expected number of steps from tag to tag."""
        b, n, k = e.shape
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0] + self.steps[k]
        for i in range(1, n):
            m = forward[:, i - 1, :, None] + self.steps[:k]
            top = m.max(axis=1)
            forward[:, i] = e[:, i] + top + np.log(np.exp(m - top[:, None]).sum(axis=1))
        for i in range(n - 2, -1, -1):
            m = self.steps[:k] + (e[:, i + 1] + backward[:, i + 1])[:, None, :]
            top = m.max(axis=2)
            backward[:, i] = top + np.log(np.exp(m - top[:, :, None]).sum(axis=2))
        top = forward[:, -1].max(axis=1)
        whole = top + np.log(np.exp(forward[:, -1] - top[:, None]).sum(axis=1))
        pairs = np.zeros((k, k))
        for i in range(1, n):
            pairs += np.exp(forward[:, i - 1, :, None] + self.steps[:k] + (e[:, i] + backward[:, i])[:, None, :] - whole[:, None, None]).sum(axis=0)
        return np.exp(forward + backward - whole[:, None, None]), pairs

    def tag(self, rows: Rows) -> list[list[int]]:
        """The likeliest tags of each answer."""
        k = len(TAGS)
        scored = self.scores(rows.words, rows.word_sizes) + self.scores(rows.others, rows.other_sizes)
        starts = np.concatenate([[0], np.cumsum(rows.answers)])
        out: list[list[int]] = [[] for _ in range(len(rows.answers))]
        for n, members in _by_length(rows.answers.tolist()).items():
            if not n:
                continue
            e = scored[starts[members][:, None] + np.arange(n)]
            best, back = e[:, 0] + self.steps[k], []
            for i in range(1, n):
                m = best[:, :, None] + self.steps[:k]
                back.append(m.argmax(axis=1))
                best = m.max(axis=1) + e[:, i]
            tags = [best.argmax(axis=1)]
            for b in reversed(back):
                tags.append(b[np.arange(len(members)), tags[-1]])
            for m, row in zip(members, np.stack(tags[::-1], axis=1).tolist(), strict=True):
                out[m] = row
        return out


def _groups(clause: str) -> int:
    """The number of cue groups in a clause."""
    mask = 0
    for w in _WORD.findall(clause.lower()):
        mask |= _CUE_MASKS.get(w, 0)
    return mask.bit_count()


_CUE_MASKS: dict[str, int] = {}
for _i, _listed in enumerate(CUES.values()):
    for _w in _listed.split():
        _CUE_MASKS[_w] = _CUE_MASKS.get(_w, 0) | 1 << _i


def refusals(rng: random.Random, n: int) -> list[str]:
    """Refusals composed of the general phrases of one language each."""
    langs = [*PHRASES, *["en"] * len(PHRASES)]
    out = []
    for _ in range(n):
        openings, bodies, after = (part.split("|") for part in PHRASES[rng.choice(langs)])
        body = rng.choice(bodies)
        text = f"{rng.choice(openings)} {body}." if rng.random() < 0.6 else f"{body[0].upper()}{body[1:]}."
        out.append(" ".join([text, *rng.sample(after, min(len(after), rng.choice([0, 0, 1, 1, 2])))]))
    return out


def _last(parts: list[str]) -> str:
    """The last clause with numbers left open."""
    return " ".join("#" if w.isdigit() else w for w in _WORD.findall((parts or [""])[-1].lower()))


def _framed(question: str, resolved: str | None, parts: list[str]) -> tuple[list[str], list[bool], bool]:
    """The frame of each clause, whether it has three cues, and whether the answer seems to refuse.

    A clause's frame leaves numbers and the question's own words open.
    """
    own = {w for w in _WORD.findall(f"{question} {resolved or ''}".lower()) if len(w) > 3}
    frames = [" ".join("#" if w.isdigit() else "_" if w in own else w for w in _WORD.findall(p.lower())) for p in parts]
    groups = [_groups(p) for p in parts]
    cued = [g >= 3 for g in groups]
    return frames, cued, any(cued) and not any(g < 2 and len(f.split()) > 9 for f, g in zip(frames, groups, strict=True))


def _surrounding(pairs: list[tuple[str, str | None, str, list[str]]]) -> set[str]:
    """Frames seen with two different questions and next to clauses with cues four times out of five."""
    seen: dict[str, list[int]] = {}
    asked: dict[str, set[str]] = {}
    for question, resolved, _, parts in pairs:
        frames, _, beside = _framed(question, resolved, parts)
        for frame in set(frames):
            got = seen.setdefault(frame, [0, 0])
            got[0] += beside
            got[1] += 1
            asked.setdefault(frame, set()).add(question)
    return {f for f, (a, n) in seen.items() if len(asked[f]) >= 2 and a >= 0.8 * n}


def _pairs(logs: list[tuple[str | None, str | None, str | None]]) -> list[tuple[str, str | None, str, list[str]]]:
    """The logs with a question and an answer that isn't only the question, and the answer's clauses."""
    return [(q, r, a, clauses(a)) for q, r, a in logs if q and not is_empty(a) and not only_repeats(a, q, r)]


def _refused(pairs: list[tuple[str, str | None, str, list[str]]], around: Container[str]) -> list[tuple[str, str | None, str, list[str]]]:
    """The pairs whose answer surely refuses."""
    out = []
    for question, resolved, answer, parts in pairs:
        if any(_groups(p) >= 3 for p in parts):
            frames, cued, beside = _framed(question, resolved, parts)
            if beside and all(k or f in around for f, k in zip(frames, cued, strict=True)):
                out.append((question, resolved, answer, parts))
    return out


def corpus_refusals(logs: list[tuple[str | None, str | None, str | None]]) -> list[tuple[str, str | None, str, list[str]]]:
    """The logs whose answer surely refuses: a clause with three cues, and no clause that also stands beside sound ones.

    A clause without is taken by its frame, which must be one that surrounds refusals.
    """
    pairs = _pairs(logs)
    return _refused(pairs, _surrounding(pairs))


def teach(logs: list[tuple[str | None, str | None, str | None]], words: list[tuple[str, str]], seed: int = SEED) -> tuple[Featuriser, Field]:
    """Fit the field and the ends of clauses on a list of (question, resolved question, answer)."""
    languages, ends = Languages(words), Ends()
    told = []
    for question, _, answer in logs:
        if question and not is_empty(answer):
            lang, lead = languages.of(question)
            of, _ = languages.of(answer)
            if lang and lang == of and lead > 0.1:
                told += [(lang, question), (lang, answer)]
    languages.learn(told)
    # a clause that closes the answers to many different questions is complete, with or without a full stop
    closing: dict[str, set[str]] = {}
    for question, _, answer in logs:
        if question and not is_empty(answer):
            closing.setdefault(_last(clauses(answer)), set()).add(question)
    pairs = _pairs(logs)
    for *_, parts in pairs:
        for part in parts:
            ends.learn(part)
    make = Featuriser(languages, ends)
    return make, fit(make, *examples(logs, make, {c for c, asked in closing.items() if len(asked) >= 5}, _surrounding(pairs), seed))


def fit(make: Featuriser, cases: list[tuple[str | None, str | None, str, list[str]]], gold: list[list[int]]) -> Field:
    """The field trained on the cases."""
    field = Field()
    field.train(list(zip(make.rows(cases).split(), gold, strict=True)))
    return field


def examples(logs: list[tuple[str | None, str | None, str | None]], make: Featuriser, closing: Container[str], around: Container[str], seed: int) -> tuple[list[tuple[str | None, str | None, str, list[str]]], list[list[int]]]:
    """The cases that logs teach, and their tags: sound answers as they are and spoilt, refusals found and composed."""
    rng = random.Random(seed)
    languages, ends = make.languages, make.ends
    pairs = _pairs(logs)
    refused = _refused(pairs, around)
    skip = {(q, a) for q, _, a, _ in refused}
    sound: dict[str, list] = {}
    short: list = []
    asked_in, said_in = make.words.leading([p[0] for p in pairs]), make.words.leading([p[2] for p in pairs])
    for (question, resolved, answer, parts), lang, of in zip(pairs, asked_in, said_in, strict=True):
        if (question, answer) in skip:
            continue
        groups = [_groups(p) for p in parts]
        content = sum(len(p) for p, g in zip(parts, groups, strict=True) if g < 2 and len(_WORD.findall(p)) > 6)
        brief = len(_WORD.findall(answer)) <= 3 and max(groups, default=0) < 2
        tail = _CITE.sub(" ", answer).rstrip()
        whole = bool(_END.search(tail)) or tail.endswith("|") and not tail.endswith("\n|") or bool(re.search(r"\n\d+\. .+\Z", tail)) and ends.likely(parts[-1]) > 0.3
        whole = whole or _last(parts) in closing
        if brief and parts:
            short.append((question, resolved, answer, parts))
        elif lang and of and (of == lang or of in languages.requested(question)) and parts and (max(groups) < 2 or content > 60) and whole:
            sound.setdefault(of, []).append((question, resolved, answer, parts))
    cases: list[tuple[str | None, str | None, str, list[str]]] = []
    gold: list[list[int]] = []
    tag = {t: i for i, t in enumerate(TAGS)}

    def add(question, resolved, answer, parts, tags):
        if parts and len(parts) == len(tags):
            cases.append((question, resolved, answer, parts))
            gold.append([tag[t] for t in tags])

    flat = [x for group in sound.values() for x in group]
    for lang, group in sorted(sound.items()):
        others = [x for other, g in sound.items() if other != lang for x in g]
        for question, resolved, answer, parts in group:
            first = only_repeats(parts[0], question, resolved)
            add(question, resolved, answer, parts, ["echo" if first else "answer", *["answer"] * (len(parts) - 1)])
            if "\n" in answer.rstrip()[-60:] and rng.random() < 0.5:
                # rows and items break off too
                cut = answer.rstrip()
                cut = cut[: len(cut) - rng.randrange(1, 25)].rstrip()
                kept = clauses(cut)
                if kept and (cut[-1] != "|" or cut.split("\n")[-1].count("|") < cut.split("\n")[0].count("|") or len(cut.split("\n")[-1]) < 3):
                    add(question, resolved, cut, kept, ["answer"] * (len(kept) - 1) + ["unfinished" if cut[-1] != "|" or cut.endswith("\n|") else "answer"])
            pick = rng.random()
            if pick < 0.35 and len(answer) > 60:
                # cut inside the last sentences, at a word or inside one, perhaps with a sign left hanging
                at = rng.randrange(max(30, len(answer) // 2 if rng.random() < 0.6 else len(answer) - 40), len(answer) - 2)
                cut = answer[:at].rstrip() if rng.random() < 0.5 else answer[:at].rsplit(" ", 1)[0] + rng.choice(["", "", " (", ",", ":", " –", "…", ";", " [books, p", " [books,"])
                kept = clauses(cut)
                if kept and not _END.search(_CITE.sub(" ", cut).rstrip()):
                    add(question, resolved, cut, kept, ["answer"] * (len(kept) - 1) + ["unfinished"])
            elif pick < 0.5:
                said = rng.choice([question, question.upper(), f"Q: {question}\nA: {question}", f"You asked: {question}", f'"{question}"', question.lower()])
                kept = clauses(said)
                add(question, resolved, said, kept, ["echo"] * len(kept))
            elif pick < 0.65 and others:
                _, _, said, kept = rng.choice(others)
                of, _ = languages.of(said)
                if of not in languages.requested(question) | {languages.of(question)[0]}:
                    add(question, resolved, said, kept, ["foreign"] * len(kept))
    for question, resolved, answer, parts in short:
        add(question, resolved, answer, parts, ["answer"] * len(parts))
    for question, resolved, answer, parts in refused:
        add(question, resolved, answer, parts, ["refusal"] * len(parts))
    for text in refusals(rng, max(300, len(flat) // 4)):
        question, resolved = (rng.choice(flat)[:2]) if flat else ("What is it?", None)
        kept = clauses(text)
        add(question, resolved, text, kept, ["refusal"] * len(kept))
        if flat and rng.random() < 0.25:
            # an answer after a modest beginning is an answer
            q, r, a, parts = rng.choice(flat)
            text = f"{rng.choice(MODEST)} {a}"
            kept = clauses(text)
            add(q, r, text, kept, ["answer"] * len(kept))
    return cases, gold


def verdict(question: str | None, resolved: str | None, answer: str, parts: list[str], tags: list[int], languages: Languages) -> tuple[str | None, dict[str, float]]:
    """The pair's defect or None, and the share of the answer under each tag."""
    size = sum(len(p) for p in parts)
    cover = {t: sum(len(p) for p, g in zip(parts, tags, strict=True) if TAGS[g] == t) / size for t in TAGS}
    cover = {t: round(c, 4) for t, c in cover.items() if c}
    # the field proposes, the exact comparison confirms
    if cover.get("echo", 0) >= 0.5 and only_repeats(answer, question, resolved):
        return "copied_question", cover
    if cover.get("refusal", 0) > 0 and cover.get("answer", 0) + cover.get("foreign", 0) < 0.25 * (1 - cover.get("echo", 0)):
        return "refusal", cover
    if cover.get("foreign", 0) > 0 and cover["foreign"] >= 0.5 * (1 - cover.get("echo", 0)) and languages.of(question or resolved or "")[0] is not None:
        return "wrong_language", cover
    if TAGS[tags[-1]] == "unfinished":
        return "truncated", cover
    return None, cover


def judge(pairs: list[tuple[str | None, str | None, str | None]], make: Featuriser, field: Field) -> list[tuple[str | None, dict[str, float]]]:
    """The defect and the cover of each (question, resolved question, answer)."""
    empty = [is_empty(a) for _, _, a in pairs]
    parts = [[] if e else clauses(a) for e, (_, _, a) in zip(empty, pairs, strict=True)]
    tags = field.tag(make.rows([(q, r, a or "", p) for p, (q, r, a) in zip(parts, pairs, strict=True)]))
    out: list[tuple[str | None, dict[str, float]]] = []
    for e, p, t, (q, r, a) in zip(empty, parts, tags, pairs, strict=True):
        out.append(("empty", {}) if e else verdict(q, r, a, p, t, make.languages) if p else ("truncated", {"unfinished": 1.0}))
    return out


def defect(question: str | None, resolved: str | None, answer: str | None, make: Featuriser, field: Field) -> tuple[str | None, dict[str, float]]:
    """One pair's defect and cover."""
    return judge([(question, resolved, answer)], make, field)[0]


def sample(logs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str | None, str | None, str | None]]:
    """At most ``rows`` logs, those with the least hash of the id, to look at; nothing is fitted on them.

    A threshold on the hash, set from the number of logs, keeps what reaches the driver near ``rows`` whatever the input.
    """
    total = logs.count()
    taken = logs.select("id", "question", "resolved_question", "answer", F.xxhash64(F.col("id").cast("long")).alias("_h"))
    if total > rows:
        # as many again as five standard deviations make sure that enough are taken
        share = min(1.0, (rows + 5 * rows**0.5) / total)
        taken = taken.where(F.col("_h") < F.lit(int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1))
    found = sorted(taken.collect(), key=lambda r: (r["_h"], r["id"] is None, r["id"] or 0))[:rows]
    return [(r["question"], r["resolved_question"], r["answer"]) for r in found]


class Counted(Words):
    """Numbers of words, with their keys (numbers are one word) and whether the logs may tell their language."""

    def __init__(self, languages: Languages) -> None:
        super().__init__(languages, {})
        self.keys: list[int] = []
        self.fresh: list[bool] = []

    def __missing__(self, word: str) -> int:
        n = super().__missing__(word)
        self.keys.append(key64("#" if word.isdigit() else word))
        self.fresh.append(word not in self.languages.weight and not word.isdigit())
        return n

    def forget(self) -> None:
        super().forget()
        self.keys, self.fresh = [], []


#: What is counted: texts of a language that hold a word; words and pairs of words at all, at the end of a clause and
#: (words) inside; the last clauses of answers, by question; frames beside cues, at all, and beside cues without one.
IN_LANGUAGE, WORD, PAIR, LAST, FRAME = range(5)
COUNTS = "kind byte, key long, sub long, n0 long, n1 long, n2 long, lo long, hi long"


def _totals(kind: int, keys: np.ndarray, subs: np.ndarray, *counts: np.ndarray, asked: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Rows of ``COUNTS`` with the counts of equal keys added up; ``asked`` keeps its least and greatest."""
    order = np.lexsort((subs, keys))
    keys, subs = keys[order], subs[order]
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (subs[1:] != subs[:-1])]) if len(keys) else np.zeros(0, np.int64)

    def of(values: np.ndarray | None, how: np.ufunc = np.add) -> np.ndarray:
        return np.zeros(len(starts), np.int64) if values is None or not len(starts) else how.reduceat(values[order].astype(np.int64), starts)

    own = (*counts, None, None, None)
    return {"kind": np.full(len(starts), kind, np.int8), "key": keys[starts].view(np.int64), "sub": subs[starts].view(np.int64), "n0": of(own[0]), "n1": of(own[1]), "n2": of(own[2]), "lo": of(asked, np.minimum), "hi": of(asked, np.maximum)}


def tally(logs: list[tuple[str | None, str | None, str | None]], words: Counted) -> dict[str, np.ndarray]:
    """The counts of a batch of (question, resolved question, answer), as ``COUNTS``."""
    if words.size > 300_000:
        words.forget()
    number = words.__getitem__
    texts: list[int] = []
    sizes: list[int] = []
    spoken: list[int] = []
    spoken_sizes: list[int] = []
    ended: list[bool] = []
    closes: list[tuple[int, int, int]] = []
    framed: list[tuple[int, int, int, int]] = []
    for question, resolved, answer in logs:
        if not question or is_empty(answer):
            continue
        for text in (question, answer):
            found = _WORD.findall(text.lower())
            texts += map(number, found)
            sizes.append(len(found))
        parts, asked = clauses(answer), key64(question)
        closes.append((key64(_last(parts)), asked, not _END.search(_CITE.sub(" ", answer).rstrip())))
        if only_repeats(answer, question, resolved):
            continue
        for part in parts:
            found = _WORD.findall(part.lower())
            spoken += map(number, found)
            spoken_sizes.append(len(found))
            ended.append(bool(_END.search(part)))
        frames, cued, beside = _framed(question, resolved, parts)
        # a frame counts once an answer; it is asked for if one of its clauses is without cues
        bare = {f for f, k in zip(frames, cued, strict=True) if beside and not k}
        framed += [(key64(f), asked, beside, f in bare) for f in set(frames)]
    keys = np.array(words.keys, np.uint64)
    fresh = np.array(words.fresh, bool)
    # words of the texts whose question and answer surely are of one language
    ids, size = np.array(texts, np.int64), np.array(sizes, np.int64)
    of, lead = _leading(_sums(words.scores[ids], size), size)
    told = np.repeat((of[::2] >= 0) & (of[::2] == of[1::2]) & (lead[::2] > 0.1), 2)
    text_of = np.repeat(np.arange(len(size)), size)
    chosen = told[text_of] & fresh[ids] if len(ids) else np.zeros(0, bool)
    once = np.unique(text_of[chosen] * (words.size + 1) + ids[chosen])
    told_of, told_id = once // (words.size + 1), once % (words.size + 1)
    out = [_totals(IN_LANGUAGE, keys[told_id], of[told_of].astype(np.uint64), np.ones(len(once)))]
    # words and pairs of words of the clauses
    size = np.array(spoken_sizes, np.int64)
    word = keys[np.array(spoken, np.int64)]
    full = size > 0
    final = np.zeros(len(word), bool)
    final[(np.cumsum(size) - 1)[full]] = True
    first = np.zeros(len(word), bool)
    first[(np.cumsum(size) - size)[full]] = True
    before = np.where(first, np.uint64(key64("")), np.roll(word, 1))
    inside = ~final | np.repeat(np.array(ended, bool), size)
    nothing = np.zeros(len(word), np.uint64)
    out.append(_totals(WORD, word, nothing, np.ones(len(word)), final, inside))
    out.append(_totals(PAIR, before * np.uint64(MIXED) + word, word, np.ones(len(word)), final))
    last = np.array(closes, np.uint64).reshape(-1, 3)
    out.append(_totals(LAST, last[:, 0], last[:, 1], last[:, 2]))
    frame = np.array(framed, np.uint64).reshape(-1, 4)
    out.append(_totals(FRAME, frame[:, 0], np.zeros(len(frame), np.uint64), frame[:, 2], np.ones(len(frame)), frame[:, 3], asked=frame[:, 1].astype(np.int64)))
    return {name: np.concatenate([o[name] for o in out]) for name in out[0]}


def _keys(df: DataFrame) -> Keys:
    """The keys, and values if there are any, of a table."""
    got = df.toArrow()
    values = got.column("value").to_numpy().astype(np.uint8) if "value" in got.column_names else None
    return Keys(np.ascontiguousarray(got.column("key").to_numpy()).astype(np.int64).view(np.uint64), values)


def known(logs: DataFrame, words: list[tuple[str, str]]) -> tuple[Featuriser, Keys, Keys]:
    """What is counted over all logs: languages and ends in a featuriser, closing clauses, frames around refusals."""
    languages = Languages(words)

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        own = Counted(languages)
        for b in batches:
            yield tally(list(zip(b["question"], b["resolved_question"], b["answer"], strict=True)), own)

    kind, n0, n1, n2 = F.col("kind"), F.col("n0"), F.col("n1"), F.col("n2")
    summed = arrow_map(logs.select("question", "resolved_question", "answer"), kernel, COUNTS).groupBy("kind", "key", "sub").agg(*[F.sum(n).alias(n) for n in ("n0", "n1", "n2")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    asked = (kind == PAIR) & (n0 >= 8) | (kind == WORD) & ((n1 > 0) | (n2 >= 3)) | (kind == FRAME) & (n2 > 0) & (F.col("lo") != F.col("hi")) & (n0 >= F.lit(0.8) * n1) | kind.isin(IN_LANGUAGE, LAST)
    counted = cut(summed.where(asked))
    told = counted.where(kind == IN_LANGUAGE).groupBy("key").agg(F.max("n0").alias("n"), F.sum("n0").alias("all"), F.max_by("sub", "n0").alias("value"))
    languages.learnt = _keys(told.where((F.col("n") >= 3) & (F.col("n") >= F.lit(0.95) * F.col("all"))).select("key", "value"))
    alone = counted.where(kind == WORD).select("key", _range(n1 / (n0 + 3)).alias("value"), (n2 >= 3).alias("met"))
    pairs = counted.where(kind == PAIR).select("key", "sub", _range(n1 / (n0 + 1)).alias("value"))
    other = pairs.join(alone.select(F.col("key").alias("sub"), F.col("value").alias("single")), "sub", "left").where(F.col("value") != F.coalesce("single", F.lit(0)))
    ends = CountedEnds(_keys(alone.select("key", (F.col("value") + F.when(F.col("met"), 8).otherwise(0)).alias("value")).where("value > 0")), _keys(other.select("key", "value")))
    closing = counted.where(kind == LAST).groupBy("key").agg(F.count("*").alias("n"), F.sum("n0").alias("open")).where("n >= 5 and open > 0")
    return Featuriser(languages, ends), _keys(closing.select("key")), _keys(counted.where(kind == FRAME).select("key"))


#: Characters at which a shard is closed whatever its rows; parts of one by which weights are added up, so that their sum
#: has no order.
SHARD_CHARS, UNIT = 32 << 20, 1 << 20


def shards(batches: Iterator[dict], rows: int) -> Iterator[list[tuple[str | None, str | None, str | None]]]:
    """The logs of a task in shards of ``rows``, the last one with less than twice as many, fewer if they are long."""
    held: list[tuple[str | None, str | None, str | None]] = []
    chars = 0
    for b in batches:
        for log in zip(b["question"], b["resolved_question"], b["answer"], strict=True):
            held.append(log)
            chars += sum(len(x or "") for x in log)
            if chars >= SHARD_CHARS:
                yield held
                held, chars = [], 0
            elif len(held) >= 2 * rows:
                yield held[:rows]
                held = held[rows:]
                chars = sum(len(x or "") for log in held for x in log)
    if held:
        yield held


def taught(logs: DataFrame, words: list[tuple[str, str]], rows: int = SAMPLE_ROWS) -> tuple[Featuriser, Field]:
    """``teach`` with every log of a table: counts over all, the field in shards of about ``rows`` logs.

    A weight is the mean of those of the shards that have its feature, by their number of cases.  Shards are made by a
    hash of the row, so neither files nor cores change them.
    """
    make, closing, around = known(logs, words)
    languages, ends = make.languages, make.ends
    usable = logs.where("question != '' and answer is not null").select("id", "question", "resolved_question", "answer")
    wanted = -(-usable.count() // rows)
    if not wanted:
        return make, fit(make, *examples([], make, closing, around, SEED))
    # a task has one shard, in large tables several, whose weights it adds up
    tasks = min(wanted, 256 + wanted // 16)
    k = len(TAGS)

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        own = Featuriser(languages, ends)
        sums, cases_of = np.zeros((HASHED + k + 1, k), np.int64), np.zeros(HASHED + k + 1, np.int64)
        for i, logs in enumerate(shards(batches, rows)):
            cases, gold = examples(logs, own, closing, around, SEED + i)
            data = list(zip(own.rows(cases).split(), gold, strict=True))
            field = Field()
            field.train(data)
            met = np.zeros(HASHED + k + 1, bool)
            met[HASHED:] = True
            for features, _ in data:
                met[np.concatenate(features)] = True
            cases_of += met * len(cases)
            sums += np.rint(np.concatenate([field.weights, field.steps]) * len(cases) * UNIT).astype(np.int64)
        met = np.flatnonzero(cases_of)
        yield {"place": met, "cases": cases_of[met]} | {f"w{j}": sums[met, j] for j in range(k)}

    columns = ["cases", *[f"w{j}" for j in range(k)]]
    placed = usable.withColumn("_h", F.xxhash64("id", "question", "resolved_question", "answer")).repartition(tasks, "_h").sortWithinPartitions("_h", "id", "question", "resolved_question", "answer")
    got = arrow_map(placed, kernel, "place int, " + ", ".join(f"{c} long" for c in columns)).groupBy("place").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    mean = np.zeros((HASHED + k + 1, k))
    mean[got.column("place").to_numpy()] = np.stack([got.column(f"w{j}").to_numpy() for j in range(k)], axis=1) / (UNIT * got.column("cases").to_numpy()[:, None])
    field = Field()
    field.weights, field.steps = mean[:HASHED], mean[HASHED:]
    return make, field


def defects(logs: DataFrame, words: list[tuple[str, str]], rows: int = SAMPLE_ROWS) -> DataFrame:
    """``log_id, defect, cover`` of every log; a sound pair has a null defect."""
    make, field = taught(logs, words, rows)
    languages, ends = make.languages, make.ends
    weights, steps = field.weights.astype(np.float32), field.steps

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        own, learnt = Featuriser(languages, ends), Field()
        learnt.weights, learnt.steps = weights, steps
        for b in batches:
            got = judge(list(zip(b["question"], b["resolved_question"], b["answer"], strict=True)), own, learnt)
            yield {"log_id": b["log_id"], "defect": [d for d, _ in got], "cover": [list(c.items()) for _, c in got]}

    narrow = logs.select(F.col("id").cast("long").alias("log_id"), "question", "resolved_question", "answer")
    return arrow_map(narrow, kernel, "log_id long, defect string, cover map<string,double>")
