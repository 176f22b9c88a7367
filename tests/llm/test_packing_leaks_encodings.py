"""Problems 8, 9 and 10."""

from __future__ import annotations

import os
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomine.llm import encoding as E
from foliomine.llm import leakage as K
from foliomine.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 50)), max_size=200), st.integers(1, 6))
def test_a_shard_is_packed_whole(items, window):
    rows = [(s, n, i) for i, (s, n) in enumerate(items)]
    total = sum(n for _, n, _ in rows) or 1
    tokens = Counter()
    for s, n, _ in rows:
        tokens[s] += n
    got = P.pack_shard(rows, {s: t / total for s, t in tokens.items()}, {"a": 3.0}, 50, window)
    assert sorted(k for k, *_ in got) == list(range(len(items)))
    load = Counter()
    for key, size, _, container in got:
        assert size == rows[key][1]
        load[container] += size
    assert all(v <= 50 for v in load.values())
    # no two containers of which the one could take up the other, but for the last few of a window
    assert len(load) <= 2 * total / 50 + len({w for _, _, w, _ in got}) + 1


def test_windows_have_the_mixture():
    rng = random.Random(2)
    rows = [("a" if i % 3 else "b", rng.randint(1, 400), i) for i in range(20_000)]
    total = sum(n for _, n, _ in rows)
    share = sum(n for s, n, _ in rows if s == "b") / total
    got = P.pack_shard(rows, {"a": 1 - share, "b": share}, {}, 2048, 64)
    per = defaultdict(Counter)
    for key, size, window, _ in got:
        per[window][rows[key][0]] += size
    whole = [c for w, c in sorted(per.items())][1:-2]
    assert all(abs(c["b"] / sum(c.values()) - share) < 0.05 for c in whole)
    assert sum(n for _, n, _ in rows) / (2048 * len({c for *_, c in got})) > 0.98


@pytest.mark.skipif(not os.path.exists(P.TOKENIZER), reason="no tokenizer here")
def test_pack_frames(spark):
    rng = random.Random(5)
    rows = [(i, "word " * rng.randint(0, 300), rng.choice(["hot", "hot", "x", None])) for i in range(600)] + [(700, None, None), (701, "", "x"), (702, "word " * 9_000, "hot"), (702, "word " * 9_000, "hot"), (None, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shard", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    got = P.pack(df, "doc_id", "text", "source", shard_tokens=30_000, window=8).collect()
    load, pieces = Counter(), defaultdict(list)
    for r in got:
        load[r["shard"], r["container"]] += r["n_tokens"]
        pieces[r["item_id"]].append((r["piece"], r["first_token"], r["n_tokens"]))
    assert max(load.values()) <= P.CAPACITY and len({s for s, _ in load}) > 1
    assert set(pieces) == {r[0] for r in rows}
    encode = P.encoding(P.TOKENIZER).encode_ordinary
    for item, text, _ in rows:
        n = len(encode(text or ""))
        assert sum(k for *_, k in pieces[item]) == n * (2 if item == 702 else 1)
        assert len(pieces[item]) == (1 if n <= P.CAPACITY else -(-n // P.CAPACITY) * 2)
    assert P.pack(df.where("doc_id < 0"), "doc_id", "text", "source").count() == 0


def brute(docs, items, k):
    grams = defaultdict(set)
    for i, t in items:
        w = K.words(t or "")
        for a in range(len(w) - k + 1):
            grams[tuple(w[a : a + k])].add(i)
    out = set()
    for d, t in docs:
        w = K.words(t or "")
        for a in range(len(w) - k + 1):
            out |= {(d, i) for i in grams.get(tuple(w[a : a + k]), ())}
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 4))
def test_matches_equal_brute_force(seed, k):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["a", "B", "é", "c-d", "7", "zz"]) for _ in range(n))
    items = [(i, text(rng.randint(0, 9))) for i in range(4)]
    docs = [(d, text(rng.randint(0, 30))) for d in range(6)]
    tests = K.TestSuffixes(items, k)
    got = K.shard_matches(tests, [d for d, _ in docs], [t for _, t in docs])
    assert set(zip(got["doc_id"], got["item_id"], strict=True)) == brute(docs, items, k)
    for d, i, n, at, of in zip(*got.values(), strict=True):
        dw, iw = K.words(docs[d][1]), K.words(dict(items)[i])
        assert dw[at : at + n] == iw[of : of + n] and n >= k


def test_leaks_frames(spark):
    passage = "On testing the left canal looks Sméooth, pale and scarred-over after nine days of care"
    items = [(1, passage), (2, "another " * 12), (3, None), (4, passage), (5, "too short")]
    docs = [(10, f"x {passage.upper().replace('É', 'E')} y"), (11, "SMÉOOTH; pale (and) scarred over after nine days of care, on"), (12, " ".join(passage.split()[:9])), (13, None), (14, ""), (15, "filler words " * 20_000 + passage), (15, passage), (16, "another " * 40)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("_leaked", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["words"] for r in K.leaks(d, i).collect()}
    assert set(got) == brute(docs, items, 10) and got[10, 1] == 16 and got[16, 2] == 12
    kept = K.without_leaks(d, i)
    assert sorted(r["doc_id"] for r in kept.collect()) == [12, 13, 14] and kept.columns == d.columns
    assert K.leaks(d.where("doc_id < 0"), i).count() == 0 and K.leaks(d, i.where("item_id < 0")).count() == 0


WORDS = "généralement opération après été élevée répétés crâne région même à château über größere prüfen gehör schädelbasis während más niños años después infección cirugía não região avaliação evolução lesão também żuchwa gardła należy się leczonych błona części zabiegu после операции лечения больного через недель основная жалоба показано повторное исследование débridement fenêtre naïve".split()
CLEAN = {
    "fr": "Généralement, la région du crâne a été répétée après l'opération élevée",
    "de": "Während größere Gehör über die Schädelbasis prüfen",
    "es": "Después de la cirugía más niños con infección en años",
    "pt": "A avaliação da região não é também lesão",
    "ru": "После операции через недель показано повторное исследование основная жалоба больного",
}


@pytest.mark.parametrize("chain", [("utf-8>cp1252",), ("utf-8>latin-1",), ("utf-8>cp1252", "utf-8>cp1252"), ("utf-8>mac_roman",), ("utf-8>cp437",), ("utf-8>cp1251",)])
@pytest.mark.parametrize("lang", sorted(CLEAN))
def test_utf8_read_otherwise_is_restored(chain, lang):
    text = CLEAN[lang]
    garbled = text
    for step in chain:
        table = E._table(step.split(">")[1])
        garbled = "".join(table[b] for b in garbled.encode())
    chains = E.Chains(E.PairModel(WORDS))
    gains = chains.unit(garbled)
    best = max(gains, key=lambda c: (gains[c], -len(c)))
    assert chains.apply(garbled, best) == text


@pytest.mark.parametrize("true, mistaken, lang", [("cp1251", "cp1252", "ru"), ("koi8-r", "cp1251", "ru"), ("cp850", "cp1252", "de"), ("mac_roman", "cp1252", "fr"), ("cp1252", "cp1251", "fr")])
def test_single_bytes_read_otherwise_are_restored(true, mistaken, lang):
    there, here = E._table(true), E._table(mistaken)
    garbled = "".join(c if c < "\x80" else here[there.index(c)] for c in CLEAN[lang])
    chains = E.Chains(E.PairModel(WORDS))
    gains = chains.unit(garbled)
    best = max(gains, key=lambda c: (gains[c], -len(c)))
    assert chains.apply(garbled, best) == CLEAN[lang]


def test_clean_texts_gain_nothing():
    chains = E.Chains(E.PairModel(WORDS))
    for text in [*CLEAN.values(), "5 °C ± 2, “so” – TGF-β, ½ cm… £5, à é ó, [ˈfəʊ]", "The marks ¬, ¶, § and ‡", "Letters such as Ã, Å, Ð and Ñ"]:
        assert chains.unit(text) == {}, text


def test_units_join_to_the_text():
    for text in ("", "a. é b? c\n\né: d", "no break é", "é.\x85 x"):
        assert "".join(E.units(text)) == text


def test_encoding_frames(spark):
    bad = CLEAN["fr"].encode().decode("latin-1")
    rows = [(1, f"Plain. {bad}", "s"), (2, CLEAN["fr"], "s"), (3, None, "s"), (4, "", None), (5, "ascii only", "s"), (6, "g\ufffdn\ufffdralement b", None), (7, CLEAN["de"] * 1_500, "s"), (1, f"Plain. {bad}", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("unit", F.lit("clash")).withColumn("row_id", F.lit(1))
    assert sorted(r["row_id"] for r in E.garbled(df, WORDS).collect()) == [1, 6]
    fixed = {r["row_id"]: r["text"] for r in E.restore(df, WORDS).collect()}
    assert fixed == {1: f"Plain. {CLEAN['fr']}", 6: "généralement b"}
    assert E.garbled(df.where("doc_id < 0"), WORDS).count() == 0


def test_what_earlier_shards_lacked_is_made_up_for_over_all_windows():
    """A shard that starts 30 windows behind in a source gives it more in every window, and all of the shortfall counts."""
    from collections import Counter

    items = [("a" if i % 2 else "b", 100, i) for i in range(4_000)]
    plain = P.pack_shard(items, {"a": 0.5, "b": 0.5}, {}, 1_000, 10)
    behind = P.pack_shard(items, {"a": 0.5, "b": 0.5}, {"a": 60_000.0, "b": -60_000.0}, 1_000, 10)
    assert sorted(k for k, *_ in plain) == sorted(k for k, *_ in behind) == list(range(4_000))

    def shares(got):
        size, of_a = Counter(), Counter()
        for key, n, window, _ in got:
            size[window] += n
            of_a[window] += n * (key % 2)
        return [of_a[w] / size[w] for w in sorted(size)]

    assert all(abs(s - 0.5) < 0.1 for s in shares(plain)[:-1])
    early = shares(behind)[:10]
    assert all(0.55 < s < 0.85 for s in early)


def test_null_and_repeated_ids_are_spread_over_shards(spark):
    rows = [(None if i % 2 else 7, "one two three four five " * 20, "s") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = P.pack(df, "doc_id", "text", "source", shard_tokens=4_000).groupBy("shard").count().collect()
    assert sum(r["count"] for r in got) == 400 and len(got) > 5 and max(r["count"] for r in got) < 150
