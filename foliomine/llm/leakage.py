"""Problem 9: passages of held-out test items inside documents, by suffix arrays over the training text.

Documents are cut into shards, one per Arrow batch.  Each shard becomes one array of word numbers; its suffixes are
sorted by their first ``min_words`` words, every suffix of every test item is binary-searched, and each range of hits
is extended word by word to the longest verbatim match.  A document is affected if the match holds at least
``min_words`` words.  There is no shuffle: a shard needs only the test side, which is sent to it.

Words outside the test items get no number, and a suffix with such a word among its first ``min_words`` can't match,
so it isn't sorted; this loses nothing.  The test side is cut into blocks of at most ``MAX_TEST_CHARS``
characters, one pass over the documents each, so what is sent to a task has a bound.

Words are runs of letters or digits, compared without case and accents.  Null and empty texts match nothing; repeated
test items are reported one by one; an empty test table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomine.llm.frames import arrow_map, send_small
from foliomine.session import cut

MIN_WORDS = 10
MAX_TEST_CHARS = 8_000_000
MAX_HITS = 4_000_000

_WORD = re.compile(r"[^\W_]+")
_KEEP = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def words(text: str) -> list:
    """The words of a text without case and accents; as bytes where that is enough."""
    if text.isascii():
        return text.lower().encode().translate(_KEEP).split()
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()
    return [w.encode() for w in _WORD.findall(plain)]


class TestSuffixes:
    """The test items as one array of word numbers; 0 separates items."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], min_words: int) -> None:
        self.min_words = min_words
        self.number: dict[bytes, int] = {}
        tokens, owners = [], []
        for item, text in items:
            found = [self.number.setdefault(w, len(self.number) + 1) for w in words(text or "")]
            tokens += [*found, 0]
            owners += [item] * (len(found) + 1)
        self.tokens = np.array(tokens or [0], dtype=np.int64)
        self.owners = np.array(owners or [0], dtype=np.int64)
        self.bits = max(1, int(len(self.number)).bit_length())
        self.starts, self.keys = self.suffixes(self.tokens)

    def suffixes(self, tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Positions whose next min_words words all have numbers, and those words packed into few integers."""
        n = len(tokens) - self.min_words + 1
        if n <= 0:
            return np.zeros(0, np.int64), []
        gaps = np.concatenate([[0], np.cumsum(tokens == 0)])
        starts = np.flatnonzero(gaps[self.min_words :] == gaps[:-self.min_words][:n])
        keys, per = [], 63 // self.bits
        for at in range(0, self.min_words, per):
            key = np.zeros(len(starts), np.int64)
            for j in range(at, min(at + per, self.min_words)):
                key = (key << self.bits) | tokens[starts + j]
            keys.append(key)
        return starts, keys


def _bound(sorted_keys: list[np.ndarray], keys: list[np.ndarray], after: bool) -> np.ndarray:
    """For each search key the first place in the suffix array that isn't before it, or that is after it."""
    low = np.zeros(len(keys[0]), np.int64)
    high = np.full(len(keys[0]), len(sorted_keys[0]), np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) // 2
        at = np.minimum(mid, len(sorted_keys[0]) - 1)
        before = np.full(len(low), after)
        for s, k in zip(reversed(sorted_keys), reversed(keys), strict=True):
            before = np.where(s[at] == k, before, s[at] < k)
        low = np.where(open_ & before, mid + 1, low)
        high = np.where(open_ & ~before, mid, high)


def shard_matches(tests: TestSuffixes, docs: list[int], texts: list[str]) -> dict[str, list]:
    """The longest match of every affected (document, item) of one shard."""
    out: dict[str, list] = {"doc_id": [], "item_id": [], "words": [], "doc_word": [], "item_word": []}
    get, parts, sizes = tests.number.get, [], []
    for text in texts:
        found = words(text) if text else []
        part = np.fromiter(map(get, found, repeat(0)), np.int64, len(found))
        parts += [part, np.zeros(1, np.int64)]
        sizes.append(len(found) + 1)
    if not parts or not len(tests.starts):
        return out
    tokens = np.concatenate(parts)
    starts, keys = tests.suffixes(tokens)
    if not len(starts):
        return out
    order = np.lexsort(keys[::-1])
    starts, keys = starts[order], [k[order] for k in keys]
    low, high = _bound(keys, tests.keys, False), _bound(keys, tests.keys, True)
    count = high - low
    if not count.sum():
        return out
    ends = np.cumsum(sizes)
    begin = np.concatenate([[0], ends[:-1]])
    # hits are looked at some millions at a time, so that repetitive texts and items take no more memory
    upto, found = np.cumsum(count), np.zeros((0, 5), np.int64)
    first = 0
    while first < len(count):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + MAX_HITS, side="right")))
        found = _longest(np.concatenate([found, _extended(tests, tokens, starts, ends, low, count, first, last)]))
        first = last
    item_first = {int(i): int(p) for p, i in reversed(list(enumerate(tests.owners)))}
    out["doc_id"] = [docs[i] for i in found[:, 0]]
    out["item_id"] = found[:, 1].tolist()
    out["words"] = found[:, 2].tolist()
    out["doc_word"] = (found[:, 3] - begin[found[:, 0]]).tolist()
    out["item_word"] = [int(p) - item_first[int(i)] for p, i in zip(found[:, 4], found[:, 1], strict=True)]
    return out


def _extended(tests: TestSuffixes, tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, count: np.ndarray, first: int, last: int) -> np.ndarray:
    """The hits of some test suffixes: document, item, length of the match, where it starts in the shard and in the tests."""
    count, low = count[first:last], low[first:last]
    which = np.repeat(np.arange(first, last), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    t_at, d_at = tests.starts[which], starts[place]
    length = np.full(len(t_at), tests.min_words, np.int64)
    going = np.arange(len(t_at))
    while len(going):
        t, d = t_at[going] + length[going], d_at[going] + length[going]
        inside = (t < len(tests.tokens)) & (d < len(tokens))
        going, t, d = going[inside], t[inside], d[inside]
        going = going[(tests.tokens[t] == tokens[d]) & (tokens[d] != 0)]
        length[going] += 1
    return np.stack([np.searchsorted(ends, d_at, side="right"), tests.owners[t_at], length, d_at, t_at], axis=1)


def _longest(hits: np.ndarray) -> np.ndarray:
    """The longest hit of each document and item, the first of those of equal length."""
    best = hits[np.lexsort((hits[:, 4], hits[:, 3], -hits[:, 2], hits[:, 1], hits[:, 0]))]
    if not len(best):
        return best
    return best[np.concatenate([[True], (np.diff(best[:, 0]) != 0) | (np.diff(best[:, 1]) != 0)])]


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per affected document and item: ``doc_id``, ``item_id``, the longest match in words and where it starts."""
    items = items.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null and i is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // MAX_TEST_CHARS))
    schema = "doc_id long, item_id long, words int, doc_word int, item_word int"
    result = None
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block)
        tests = TestSuffixes([(r["i"], r["t"]) for r in part.collect()], min_words)

        def kernel(batches: Iterator[dict], tests: TestSuffixes = tests) -> Iterator[dict]:
            for batch in batches:
                yield shard_matches(tests, batch["doc_id"], batch["text"])

        narrow = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
        found = arrow_map(narrow, kernel, schema)
        if blocks > 1:
            found = cut(found)  # one block after the other, so the driver holds one of them
        result = found if result is None else result.unionByName(found)
    assert result is not None
    return result


def without_leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", **parameters) -> DataFrame:
    """The documents that hold no passage of a test item; all columns stay."""
    bad = leaks(documents, items, doc=doc, **parameters).select(F.col("doc_id").alias("_leaked")).distinct()
    own = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_own"), F.col(f"`{doc}`").alias("_key"))
    return own.join(send_small(bad), F.col("_key") == F.col("_leaked"), "left_anti").select("_own.*")
