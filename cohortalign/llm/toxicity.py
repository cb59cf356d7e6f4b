"""Toxicity by Levenshtein automata over a lexicon trie (operator 12).

The lexicon is learned: words and stems (beginnings of words) that are far more frequent among toxic training texts than among
others. Its trie is intersected with Levenshtein automata: a state is the set of trie nodes that the token's characters
reach with their edits so far (replaced, missing, extra, swapped), and equal sets are one state, so that after the first
tokens a character costs one table look-up and most tokens die after a few. Longer entries allow more edits, short ones
none. Every hit is weighed by its entry's log-odds, misspelled hits by their own, and by a context score of the window around it:
quotation marks and words of reporting lower it, words of address raise it. A logistic curve on a text's evidence gives the score.

Only the fit looks at labels; it uses at most about ``SAMPLE`` distinct labelled texts, and counts on the executors. All
texts are scored, whole.

Defined results: null, empty and wordless texts have no hits and get the score of that; if the labels are of one class or
missing, every score is the smoothed share of toxic rows; a document with several labels is toxic if one says so; a null id is never learned
from and not held out; repeated rows get equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, sliced, staged, text_key
from .langid import fold

SAMPLE = 40_000  # labelled texts to learn from, about
MAX_CANDIDATES, MAX_ENTRIES, LIFT = 100_000, 100, 8.0
SUPPORT, SUPPORT_SHARE = 4, 0.01  # toxic texts that hold an entry, and their share of all, at least
STEMS = range(4, 9)  # lengths of beginnings of words
WINDOW = 60  # characters on each side of a hit
THRESHOLD = 0.3
PART = 1 << 20  # characters read at a time
MEMO = 200_000  # tokens whose result a task remembers
_TOKEN = re.compile(r"[@$]?[^\W_]+(?:[@$!*][^\W_]+)*")
_SPACE = re.compile(r"\s")
#: Fixed word lists: verbs and nouns of reporting and words of address in English, German, French and Spanish.
REPORTING = frozenset("said says saying wrote writes called calls quote quoted quotes word term slur comment sagte schrieb nannte zitat wort begriff "
                      "dit écrit appelé citation mot terme dijo escribió llamó cita palabra término".split())
ADDRESS = frozenset("you your you're youre u du dich dein ihr euch toi ton tes vous votre tú tu tus usted vosotros".split())
_OPEN, _CLOSE = "“«„‹", "”»“›"


def tokens(text: str):
    """(the lower-cased text, start, stop, tokens) of its parts, which end at white space."""
    low, at = text.lower(), 0
    while at < len(low):
        end = at + PART
        if end < len(low):
            cut = _SPACE.search(low, end)
            end = cut.end() if cut else len(low)
        yield low, at, end, _TOKEN.findall(low, at, end)
        at = end


def edits_allowed(entry: str, stem: bool) -> int:
    return 2 if len(entry) >= 10 and not stem else 1 if len(entry) >= (6 if stem else 5) else 0


class Automaton:
    """The lexicon's trie and its Levenshtein automata as one table of states that grows as tokens need it.

    entries: (text, stem, edits). ``match`` gives (entry, edits) of the entry with the fewest edits, the longest on ties, or None."""

    def __init__(self, entries: list[tuple[str, bool, int]]):
        self.entries = entries
        self.child: list[dict[str, int]] = [{}]
        self.words: list[list[int]] = [[]]
        self.stems: list[list[int]] = [[]]
        self.spare = [0]  # most edits that an entry through the node allows
        for i, (text, stem, edits) in enumerate(entries):
            node = 0
            self.spare[0] = max(self.spare[0], edits)
            for c in text:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.words.append([])
                    self.stems.append([])
                    self.spare.append(0)
                node = self.child[node][c]
                self.spare[node] = max(self.spare[node], edits)
            (self.stems if stem else self.words)[node].append(i)
        self.number: dict = {}
        self.states: list = []
        self.table: list[dict[str, int]] = []
        self.memo: dict = {}
        self._state(self._closed({(0, ""): 0}), None)

    def _better(self, a, b):
        return b if a is None or (b is not None and (b[1], -len(self.entries[b[0]][0]), b[0]) < (a[1], -len(self.entries[a[0]][0]), a[0])) else a

    def _closed(self, reached: dict) -> dict:
        """With characters of the lexicon that the token lacks."""
        open_ = [k for k in reached if not k[1]]
        while open_:
            node, _ = key = open_.pop()
            e = reached[key] + 1
            for n in self.child[node].values():
                if e <= self.spare[n] and e < reached.get((n, ""), 99):
                    reached[n, ""] = e
                    open_.append((n, ""))
        return reached

    def _state(self, reached: dict, held) -> int:
        """The state's number; -1 if nothing can follow and nothing is held."""
        for (node, wait), e in reached.items():
            if not wait:
                for i in self.stems[node]:
                    if e <= self.entries[i][2]:
                        held = self._better(held, (i, e))
        if not reached and held is None:
            return -1
        key = (frozenset(reached.items()), held)
        if key not in self.number:
            self.number[key] = len(self.states)
            word = held
            for (node, wait), e in reached.items():
                if not wait:
                    for i in self.words[node]:
                        if e <= self.entries[i][2]:
                            word = self._better(word, (i, e))
            self.states.append((reached, held, word))
            self.table.append({})
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        reached, held, _ = self.states[state]
        out: dict = {}

        def reach(node, wait, e):
            if e <= self.spare[node] and e < out.get((node, wait), 99):
                out[node, wait] = e

        for (node, wait), e in reached.items():
            if wait:
                if c == wait:
                    reach(node, "", e)
                continue
            for x, n in self.child[node].items():
                if x == c:
                    reach(n, "", e)
                else:
                    reach(n, "", e + 1)
                    if c in self.child[n]:  # the next two characters swapped
                        reach(self.child[n][c], x, e + 1)
            if node:  # an extra character, not before the first
                reach(node, "", e + 1)
        return self._state(self._closed(out), held)

    def match(self, token: str):
        if token in self.memo:
            return self.memo[token]
        state = 0
        for c in token:
            row = self.table[state]
            to = row.get(c)
            if to is None:
                to = row[c] = self._step(state, c)
            if to < 0:
                state = -1
                break
            state = to
        found = self.states[state][2] if state >= 0 else None
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[token] = found
        return found


def context_score(text: str, start: int, end: int) -> float:
    """How much a hit counts by the window around it: 1 alone, less in quotation or report, more in address."""
    left, right = text[max(0, start - WINDOW):start], text[end:end + WINDOW]
    quoted = left.count('"') % 2 == 1 and '"' in right
    quoted |= left[-1:] in ("'", "‘") and right[:1] in ("'", "’")
    opened = max(left.rfind(c) for c in _OPEN)
    quoted |= opened >= 0 and max(left.rfind(c, opened + 1) for c in _CLOSE) < 0 and any(c in right for c in _CLOSE)
    near = _TOKEN.findall(left.lower())[-6:] + _TOKEN.findall(right.lower())[:6]
    score = 1.0 - 0.6 * quoted - 0.25 * any(w in REPORTING for w in near) + 0.2 * (not quoted and any(w in ADDRESS for w in near))
    return max(0.1, score)


def hits(text: str | None, automaton: Automaton) -> tuple[int, dict[tuple[int, int], list[float]]]:
    """Number of tokens, and the context scores of the hits of each (entry, misspelled or not)."""
    n, out = 0, {}
    for low, at, stop, found in tokens(text or ""):
        n += len(found)
        mine = {t: m for t in set(found) if (m := automaton.match(t)) is not None}
        if not mine:
            continue
        for m in _TOKEN.finditer(low, at, stop):
            if m.group() in mine:
                entry, edits = mine[m.group()]
                out.setdefault((entry, min(edits, 1)), []).append(context_score(low, m.start(), m.end()))
    return n, out


def evidence(n: int, found: dict, weights: dict[tuple[int, int], float]) -> list[float]:
    """What the curve is fitted on: the sum and the largest of the entries' evidence, what contexts took away, and the length."""
    given = [(weights.get(k, 0.0) * math.log2(1 + len(z)), sum(z) / len(z)) for k, z in found.items()]
    counted = [w * z for w, z in given if w > 0]
    return [1.0, min(sum(counted), 60.0) / 10, max(counted, default=0.0) / 10, sum(w * max(0.0, 1 - z) for w, z in given if w > 0) / 10, math.log1p(n) / 10]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, hold: float = 0.1) -> np.ndarray:
    """Weights of a logistic curve by Newton's steps; the first column is the constant and not held back."""
    b, keep = np.zeros(x.shape[1]), hold * np.eye(x.shape[1])
    keep[0, 0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _log_odds(a, b, toxic: int, clean: int):
    return math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))


def text_features(text: str) -> set[str]:
    """Words as '=word' and beginnings of words as '~stem'."""
    out = set()
    for *_, found in tokens(text):
        for w in set(found):
            out.add("=" + w)
            out.update("~" + w[:k] for k in STEMS if len(w) >= k)
    return out


def needed(toxic: int) -> int:
    return max(SUPPORT, round(SUPPORT_SHARE * toxic))


def choose(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> list[tuple[str, bool, int]]:
    """The entries: features far more frequent in toxic texts, the most telling first, without those that another explains."""
    least = needed(toxic)

    def gain(a, b):
        share = (a + b) / (toxic + clean)
        part = lambda k, n: k * math.log(max(k, 1e-9) / (n * share)) + (n - k) * math.log(max(n - k, 1e-9) / (n * max(1 - share, 1e-12)))
        return part(a, toxic) + part(b, clean)

    telling = [(gain(a, b), len(f), f, a) for f, (a, b) in counts.items() if a >= least and (a / toxic) >= LIFT * (b + 0.5) / clean]
    # of equal gains the longer text, and the word before the stem
    telling.sort(key=lambda x: (-round(x[0], 6), -x[1], x[2].startswith("~"), x[2]))
    kept: list[tuple[str, bool, int]] = []
    for _, _, f, a in telling:
        text, stem = f[1:], f[0] == "~"
        covered = any(text.startswith(t) if s else text == t for t, s, _ in kept)
        # a stem whose texts are those of entries that begin with it
        repeats = stem and any(t.startswith(text) and n >= 0.8 * a for t, _, n in kept)
        if not covered and not repeats:
            kept.append((text, stem, a))
        if len(kept) >= MAX_ENTRIES:
            break
    return [(t, s, edits_allowed(t, s)) for t, s, _ in kept]


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> DataFrame:
    """(text, toxic): about SAMPLE distinct labelled texts, drawn by a hash of the id."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(toxic_col).cast("int").alias("toxic"))
    known = staged(known, "toxic-labels")
    share = min(1.0, SAMPLE / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("_id", F.lit(12)), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn if share < 1 and drawn.count() > 2 * SAMPLE else F.broadcast(drawn)
    rows = docs.where(F.col(text_col).isNotNull()).join(drawn, F.col(id_col) == F.col("_id")).select(F.col(text_col).alias("text"), "toxic")
    return staged(rows.dropDuplicates(["text", "toxic"]), "toxic-sample")


def _counted(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(feature, n): texts of ``rows`` that hold each feature, or each wanted one."""
    def count(batches):
        total = Counter()
        for b in sliced(batches):
            for text in b.column(0).to_pylist():
                total.update(text_features(text) if wanted is None else text_features(text) & wanted)
                if len(total) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["feature", "n"])
                    total.clear()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["feature", "n"])

    return rows.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


class Model:
    """Entries, their weights by (entry, misspelled), and the curve."""

    def __init__(self, entries, weights, curve):
        self.entries, self.weights, self.curve = entries, weights, curve

    def score(self, text: str | None, automaton: Automaton) -> tuple[float, int, int]:
        """(score, hits, hits in contexts that lower them)."""
        n, found = hits(text, automaton)
        x = float(np.dot(evidence(n, found, self.weights), self.curve))
        zs = [z for f in found.values() for z in f]
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x)))), len(zs), sum(z < 0.8 for z in zs)


def train(rows: DataFrame) -> Model:
    """The model from (text, toxic) rows, a bounded sample that is written somewhere."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sum(n for k, n in sizes.items() if k)
    base = [math.log((toxic + 1) / (clean + 1)), 0.0, 0.0, 0.0, 0.0]
    if not clean or not toxic:
        return Model([], {}, base)
    least = needed(toxic)
    often = _counted(rows.where("toxic <> 0"), None).where(F.col("n") >= least).orderBy(F.desc("n"), "feature").limit(MAX_CANDIDATES)
    often = {r["feature"]: r["n"] for r in often.collect()}
    # common in toxic texts and common as such: most candidates; counts of other texts tell them apart
    other = {r["feature"]: r["n"] for r in _counted(rows.where("toxic = 0"), set(often)).collect()}
    entries = choose({f: (n, other.get(f, 0)) for f, n in often.items()}, toxic, clean)
    if not entries:
        return Model([], {}, base)

    def seen(entries):
        def run(batches):
            automaton = Automaton(entries)
            for b in sliced(batches):
                for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    n, found = hits(text, automaton)
                    flat = [(e, how, z) for (e, how), zs in found.items() for z in zs]
                    yield pa.RecordBatch.from_pydict({"toxic": [int(label != 0)], "n": [n], "e": [[x[0] for x in flat]], "how": [[x[1] for x in flat]], "z": [[x[2] for x in flat]]}, schema=_SEEN)

        out = []
        for r in rows.select("text", "toxic").mapInArrow(run, "toxic int, n long, e array<int>, how array<int>, z array<double>").collect():  # a row a sample text
            found: dict = {}
            for e, how, z in zip(r["e"], r["how"], r["z"]):
                found.setdefault((e, how), []).append(z)
            out.append((r["toxic"], r["n"], found))
        return out

    first = seen(entries)
    counts = Counter((k, t) for t, _, found in first for k in found)
    weights = {}
    for e in range(len(entries)):
        exact = _log_odds(counts[(e, 0), 1], counts[(e, 0), 0], toxic, clean)
        a, b = counts[(e, 1), 1], counts[(e, 1), 0]
        weights[e, 0], weights[e, 1] = exact, ((a + b) * _log_odds(a, b, toxic, clean) + 5 * 0.7 * exact) / (a + b + 5)
    # entries whose misspellings are words of clean texts are taken exactly
    entries = [(t, s, k if weights[i, 1] >= 1.0 else 0) for i, (t, s, k) in enumerate(entries)]
    keep = [(t, n, {k: z for k, z in found.items() if not k[1] or entries[k[0]][2]}) for t, n, found in first]
    x = np.array([evidence(n, found, weights) for _, n, found in keep])
    return Model(entries, weights, logistic(x, np.array([t for t, _, _ in keep], float)).tolist())


_SEEN = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("e", pa.list_(pa.int32())), ("how", pa.list_(pa.int32())), ("z", pa.list_(pa.float64()))])


def scored(docs: DataFrame, model: Model, keep: list[str] = ["doc_id"], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep``, score, predicted, n_hits and n_lowered of every row; only the text is looked at."""
    n = len(keep)
    df = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))

    def run(batches):
        automaton = Automaton(model.entries)
        for b in sliced(batches):
            s, h, q = zip(*[model.score(t, automaton) for t in b.column(n).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()),
                                              pa.array(h, pa.int64()), pa.array(q, pa.int64())], names=[*b.schema.names[:n], "score", "predicted", "n_hits", "n_lowered"])

    kinds = "".join(f"k{i} {df.schema[i].dataType.simpleString()}, " for i in range(n))
    out = df.mapInArrow(run, f"{kinds}score double, predicted int, n_hits long, n_lowered long")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score", "predicted", "n_hits", "n_lowered")


def op12_toxicity(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(labelled(docs.where(fold() != 2), read(spark, sf_dir, "labels").where(fold() != 2)))
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits", "n_lowered")


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLE_SQL = {}
