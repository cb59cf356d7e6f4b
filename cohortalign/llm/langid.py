"""Language identification by error-correcting output codes (operator 6).

Every language has a codeword. For each bit a binary naive-Bayes classifier over
hashed byte n-grams tells languages whose bit is 1 from those whose bit is 0. A text's bit
margins are decoded to the codeword of least logistic loss; the losses of all codewords give
the score, and a score under ``AMBIGUOUS`` sets a flag.

Training counts n-grams by language over all training rows on the executors; only
the sums, at most ``MAX_LANGUAGES`` x ``FEATURES`` numbers, reach the driver.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is
every text if nothing could be learned; a null id is never learned from and not held
out; repeated rows get equal results; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, small_batches

FEATURES, ORDERS = 1 << 13, (1, 2, 3)
MAX_LANGUAGES = 1000
EVIDENCE, AMBIGUOUS = 0.1, 0.6
PART = 1 << 20  # bytes counted at a time
_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of the byte n-grams of the lower-cased text; ASCII characters
    other than letters count as spaces."""
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN)
    out = np.zeros(FEATURES, np.int64)
    for at in range(0, len(raw), PART):
        b = np.frombuffer(raw[at:at + PART + max(ORDERS) - 1], np.uint8).astype(np.uint32)
        code = np.zeros(len(b), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(b) < n:
                break
            code = code[:len(b) - n + 1] * np.uint32(257) + b[n - 1:] + np.uint32(1)
            if n in ORDERS:
                mine = code[:PART]
                out += np.bincount((mine * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=FEATURES)
    return out


def codewords(languages: int) -> np.ndarray:
    """Rows of +1/-1: all ways to split up to seven languages in two; for more, random halvings, ten for each doubling of their
    number and more if need be, until any two codewords differ in a third of their bits at least, so that fewer than a sixth
    of wrong bits are always put right."""
    if languages <= 7:
        cols = [[1] + [1 if j >> i & 1 else -1 for i in range(languages - 1)] for j in range(2 ** (languages - 1) - 1)] \
            if languages > 1 else []
        return np.array(cols, np.int8).reshape(-1, languages).T
    rng, cols, least = random.Random(42), [], 10 * math.ceil(math.log2(languages))
    while True:
        half = [1] * (languages // 2) + [-1] * (languages - languages // 2)
        rng.shuffle(half)
        cols.append(half)
        if len(cols) >= least and least_distance(code := np.array(cols, np.int8).T) >= len(cols) / 3:
            return code


def least_distance(code: np.ndarray) -> int:
    """The fewest bits in which two codewords differ."""
    differ = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2
    np.fill_diagonal(differ, code.shape[1])
    return int(differ.min())


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, their codewords, and the classifiers' weights (FEATURES x bits)."""
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        "lang is not null and text is not null")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = ngram_counts(text)
                sums[lang] = sums[lang] + c if lang in sums else c
        for lang, c in sums.items():
            f = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(f, pa.int32()),
                                              pa.array(c[f], pa.int64())], ["lang", "f", "n"])

    sums = rows.mapInArrow(count, "lang string, f int, n long").groupBy("lang", "f").agg(F.sum("n").alias("n"))
    table = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("f", "n"))).alias("v")).select(
        "lang", F.transform("v", lambda x: x["f"]).alias("f"), F.transform("v", lambda x: x["n"]).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(table) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table.sort(key=lambda r: r["lang"])
    p = np.zeros((len(table), FEATURES))
    for i, r in enumerate(table):
        p[i, r["f"]] = r["n"]
    p = (p + 0.5) / (p + 0.5).sum(1, keepdims=True) if len(p) else p
    code = codewords(len(table)) if table else np.zeros((0, 0), np.int8)
    weights = np.stack([np.log(p[c > 0].mean(0)) - np.log(p[c < 0].mean(0)) for c in code.T], 1) \
        if code.size else np.zeros((FEATURES, 0))
    return [r["lang"] for r in table], code, weights


def decode(counts: np.ndarray, code: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probability of each language, from the loss of its codeword."""
    margin = np.clip(EVIDENCE * (counts @ weights), -50, 50)
    loss = np.logaddexp(0, -code * margin).sum(1)
    e = np.exp(loss.min() - loss)
    return e / e.sum()


def predict(docs: DataFrame, model, keep: list[str] = ["doc_id"], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred, score and ambiguous for every row; only the text is looked at."""
    small_batches(docs.sparkSession)
    languages, code, weights = model
    df = docs.select(*keep, F.col(text_col).alias("_text"))
    n = len(keep)

    def run(batches):
        for b in batches:
            best, score = [], []
            for text in b.column(n).to_pylist():
                if not languages or text is None or not _LETTER.search(text):
                    best.append("und")
                    score.append(0.0)
                    continue
                p = decode(ngram_counts(text), code, weights) if code.size else np.ones(1)
                best.append(languages[int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n], pa.array(best, pa.string()), pa.array(score, pa.float64()),
                 pa.array([s < AMBIGUOUS for s in score], pa.bool_())], [*keep, "lang_pred", "score", "ambiguous"])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.mapInArrow(run, f"{kinds}lang_pred string, score double, ambiguous boolean")


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def op6_langid(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(fold() != 2))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op6_langid": op6_langid}
ORACLE_SQL = {}
