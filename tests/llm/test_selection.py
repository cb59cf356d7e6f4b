"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import os
import random
import re
import sys
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortalign.llm import negatives, resample, toxicity

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DOCS = "doc_id long, text string"

# 11


def word_list(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(words, longest):
    return [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def expected(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    at = lambda f: crc32(f.encode()) % buckets
    counts = lambda texts: np.bincount([at(f) for t in texts for f in runs(word_list(t), longest)], minlength=buckets)
    s, t = counts([x for _, x in docs]), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f = runs(word_list(text), longest)
        weight = sum(gain[at(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), len(word_list(text)), None])
    may = sorted([r for r in out if r[4] >= least], key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(may[:percent * len(may) // 100], 1):
        r[5] = k
    return sorted(((*r[:4], r[5]) for r in out), key=repr)


def text_of(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["Alpha", "beta", "gämma", "漢字", "x1", "don't", "É", "Zeta-9", "\x85", "w%d" % rng.randrange(50)]) for _ in range(n))


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 64)])
def test_resampling_equals_brute_force(spark, longest, buckets):
    docs = [(i, text_of(i % 60, i)) for i in range(150)] + [(200, None), (201, ""), (202, "!!! ---"), (203, text_of(20_000, 3)), (None, text_of(40, 5)), (7, text_of(7, 7))]
    target = [text_of(30, 900), None, "", "alpha ALPHA w1"]
    df = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit(1)).withColumn("id", F.lit("x")).withColumn("rank", F.lit(2)).withColumn("raw", F.lit(0))
    out = resample.resample(df, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), longest=longest, buckets=buckets, percent=30)
    got = sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in out.collect()), key=repr)
    assert got == expected(docs, target, longest, buckets, 30)


def test_resampling_of_ties_and_empty_tables(spark):
    same = text_of(30, 1)
    docs = [(i % 5, same) for i in range(40)]  # repeated rows: equal scores
    df = spark.createDataFrame(docs, DOCS)
    empty = spark.createDataFrame([], "text string")
    rows = resample.resample(df, empty, percent=50).collect()
    ranks = sorted(r["rank"] for r in rows if r["rank"] is not None)
    assert ranks == list(range(1, 21))
    order = sorted(rows, key=lambda r: (-r["score"], r["doc_id"]))
    assert sorted((r["score"], r["doc_id"]) for r in order[:20]) == sorted((r["score"], r["doc_id"]) for r in rows if r["rank"])
    assert resample.resample(df.limit(0), empty).count() == 0


def test_planes_give_exact_sums():
    rng = np.random.default_rng(1)
    for size in (1, 63, 64, 10_000):
        counts, gain = rng.integers(0, 5000, size), rng.integers(-9000, 9000, size)
        assert resample.weighted_sum(counts, *resample.gain_planes(gain)) == int(counts @ gain)
    assert resample.weighted_sum(np.zeros(5, np.int64), *resample.gain_planes(np.zeros(5, np.int64))) == 0


# 12


def distance(a, b):
    """Edits with swaps of neighbours, none of them edited again."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_equals_distances():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    entries = [(word(rng.randint(3, 7)), rng.random() < 0.4, rng.randint(0, 2)) for _ in range(12)]
    automaton = toxicity.Automaton(entries)
    tokens = {word(rng.randint(1, 9)) for _ in range(1500)} | {"", "zzz", "azzb"}
    hit = 0
    for t in tokens:
        own = []
        for i, (e, stem, most) in enumerate(entries):
            ends = range(len(t) + 1) if stem else [len(t)]
            # an extra character before the first isn't an edit
            k = min(distance(t[:j], e) if t[:1] == e[:1] or not j else distance(t[:j], e) for j in ends)
            if k <= most:
                own.append((k, -len(e), i))
        found = automaton.match(t)
        if found is not None:
            hit += 1
            assert own and found[1] >= min(own)[0] and found[1] <= entries[found[0]][2]
            assert (found[1], -len(entries[found[0]][0]), found[0]) in own or found[1] > min(own)[0]
        if own and (found is None or found[1] > min(own)[0]):
            # only where the best alignment begins with an extra character
            best = min(own)
            e = entries[best[2]][0]
            assert t[1:2] == e[:1] or t[:1] != e[:1], (t, e, found)
    assert hit > 100


def test_misspellings_and_contexts():
    automaton = toxicity.Automaton([("idiot", False, 1), ("disgusting", False, 2), ("scum", False, 0), ("lowei", True, 0)])
    found = {t: automaton.match(t) for t in ("idiot", "idoit", "idi0t", "i*iot", "idiott", "idot", "ideat", "disgsutnig", "scum", "scam", "loweichen", "lower", "")}
    assert found["idiot"] == (0, 0) and all(found[t] == (0, 1) for t in ("idoit", "idi0t", "i*iot", "idiott", "idot"))
    assert found["ideat"] is None and found["disgsutnig"] == (1, 2) and found["scum"] == (2, 0) and found["scam"] is None
    assert found["loweichen"] == (3, 0) and found["lower"] is None and found[""] is None
    score = lambda text: toxicity.context_score(text, text.index("idiot"), text.index("idiot") + 5)
    assert score("an idiot here") == 1.0 and score("you are an idiot") > 1.0
    for quoted in ('he said "what an idiot" and left', "the «idiot» there", "they wrote “idiot” twice", "a word 'idiot' alone"):
        assert score(quoted) < 0.5
    assert 0.5 < score("the word idiot is old") < 1.0


def test_long_texts_are_read_in_parts(monkeypatch):
    automaton = toxicity.Automaton([("idiot", False, 1)])
    text = " ".join(["idiot" if i % 7 == 0 else "word" * (1 + i % 5) for i in range(400)])
    n, found = toxicity.hits(text, automaton)
    for part in (1, 10, 64, 333):
        monkeypatch.setattr(toxicity, "PART", part)
        assert toxicity.hits(text, automaton) == (n, found)
    assert n == 400 and len(found[0, 0]) == 58


def toxic_world(spark, n=400):
    rng = random.Random(5)
    clean = [f"w{i}" for i in range(300)] + ["lower", "scarf", "motion"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["moronix", "stupid", "lowei" + rng.choice(["chen", "ung", "ßer", "a"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_and_catches_misspellings(spark):
    docs, labels = toxic_world(spark)
    extra = labels.union(spark.createDataFrame([(1, None), (None, 1), (5, 0), (9999, 1)], labels.schema)).withColumn("text", F.lit("x"))
    model = toxicity.train(toxicity.labelled(docs.where("doc_id % 2 = 0"), extra.where("doc_id % 2 = 0 or doc_id is null")))
    assert {"moronix", "stupid"} <= {t for t, _, _ in model.entries} and any(s and "lowei".startswith(t[:4]) for t, s, _ in model.entries)
    out = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    assert all(r["predicted"] == (i % 5 == 0) for i, r in out.items())
    probes = ["w1 w2 stupid w4", "w1 w2 stuipd w4 moronixx w5 stupif", 'they said "stupid" was the word', "w1 w2 w3", None, "", "!!", "w1 " * 400_000 + "stupid moronix loweichen"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(probes)], DOCS).withColumn("score", F.lit("s")).withColumn("k0", F.lit(1)).withColumn("n_hits", F.lit(3))
    got = {r["doc_id"]: r for r in toxicity.scored(df.union(df), model, keep=["doc_id", "score"]).select("doc_id", "predicted", "n_hits", "n_lowered").collect()}
    assert got[1]["n_hits"] == 3 and got[1]["predicted"] == 1 and got[2]["n_lowered"] == 1 and got[3]["n_hits"] == 0 and got[7]["n_hits"] == 3
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(spark.createDataFrame([(i, t) for i, t in enumerate(probes)], DOCS), model).collect()}
    assert score[2] < score[0] and score[4] == score[5] == score[6] < 0.3 and score[3] < 0.3


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = toxic_world(spark, 20)
    none = toxicity.train(toxicity.labelled(docs, labels.limit(0)))
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.5}
    one = toxicity.train(toxicity.labelled(docs, labels.where("toxic = 0")))
    assert {round(r["score"], 9) for r in toxicity.scored(docs, one).collect()} == {round(1 / 18, 9)}
    assert toxicity.scored(docs.limit(0), one).count() == 0


# 13


def brute_negatives(rows, anchors, scale=256, most=5, few=5, low=80, high=100):
    fine = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in sorted({(i, y, tuple(v)) for i, y, v in fine if i in anchors}):
        score = lambda w: sum(a * b for a, b in zip(v, w))  # noqa: B023, E731
        own = sorted((-score(w), j) for j, z, w in fine if z == y and j != i)[:most]
        for s, p in own:
            far = sorted((-score(w), j) for j, z, w in fine if z != y and j != i and low * -s <= 100 * score(w) <= high * -s)[:few]
            out += [(i, p, k, j, -s, -t) for k, (t, j) in enumerate(far, 1)]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(spark, rows, anchors, **named):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit("x")).withColumn("score", F.lit(2))
    out = negatives.hard_negatives(df, F.col("vec_id").isin(*anchors), **named)
    return sorted(tuple(r[c] for c in COLUMNS) for r in out.collect())


@pytest.mark.parametrize("size", [1.0, 1e4, 1e12])
def test_negatives_equal_brute_force(spark, monkeypatch, size):
    """Fields of 4, 8 and more bytes; several blocks and groups of anchors."""
    monkeypatch.setattr(negatives, "BLOCK", 32)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCKS", 1)
    rng = np.random.default_rng(7)
    base = rng.standard_normal((3, 6))
    rows = [(i, i % 3, ((base[i % 3] + base[0] + 0.3 * rng.standard_normal(6)) * size / 4).tolist()) for i in range(120)]
    if size == 1e12:
        rows = [(i, y, [x / 1e5 for x in v]) for i, y, v in rows]
    rows += [(200, None, [1.0] * 6), (201, 1, None), (202, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, 1, [float("nan")] * 6), (204, 1, [float("inf")] * 6), (None, 1, [1.0] * 6),
             (205, 2, []), (206, 1, [size] * 3), (207, 0, [0.0] * 6)]
    anchors = [0, 10, 20, 30, 40, 50, 60, 205, 206, 207, 201]
    got = mined(spark, rows, anchors)
    assert got == brute_negatives(rows, anchors) and len(got) > 30


def test_negatives_of_ties_repeated_rows_and_one_hot_label(spark):
    rng = np.random.default_rng(8)
    v = [rng.standard_normal(4).tolist() for _ in range(3)]
    rows = [(i, 0 if i % 3 else 1, v[i % 2]) for i in range(300)] + [(i, 0 if i % 3 else 1, v[i % 2]) for i in range(0, 300, 50)]
    got = mined(spark, rows, [0, 50, 100, 150])
    assert got == brute_negatives(rows, [0, 50, 100, 150]) and got
    assert mined(spark, rows[:0] or [(1, None, None)], [1]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 2, [1.0])], [0]) == []  # no positive
    assert mined(spark, rows, [0], positives=2, negatives=3, low=0, high=200) == brute_negatives(rows, [0], 256, 2, 3, 0, 200)


def test_fields_hold_the_largest_sums():
    rng = np.random.default_rng(9)
    for most, width in ((256, 64), (2 ** 20, 3), (2 ** 26, 8), (2 ** 40, 5)):
        q = rng.integers(-most, most + 1, (9, width)).astype(object if most > 2 ** 30 else np.int64)
        q[0], q[1] = most, -most
        size = negatives.field_bytes(width, most)
        wide = [int.from_bytes(p, "little") for p in negatives.packed(q, most, size)]
        own = np.array([sum(int(x) for x in r) for r in q], object if size > 8 else np.int64)
        for anchor in ([most] * width, [-most] * width, [int(x) for x in q[5]]):
            want = [sum(a * int(x) for a, x in zip(anchor, r)) for r in q]
            assert [int(x) for x in negatives.products(wide, 9, own, anchor, most, size)] == want
