"""Repeated substrings by a common-prefix interval tree (operator 1).

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere. The suffix
array is sparse: it holds the suffixes that start at anchors. Of every ``length - GRAM + 1``
consecutive GRAM-byte strings the one of smallest rolling hash (leftmost on ties) is an
anchor, so equal strings of ``length`` bytes hold an anchor at the same place. An anchor's
context is what a string of ``length`` bytes around it can reach: ``length - GRAM`` bytes to the left
and ``length`` to the right.

Anchors are grouped by the hash of their gram, equal contexts folded with their count.
Within a group the right contexts are sorted to an enhanced suffix array, and a
stack scan over its common-prefix lengths walks the intervals from the deepest up. When
two intervals join at a common prefix of p bytes, the members of the smaller one are put among those
of the larger in order of their reversed left contexts; where neighbours' left
extensions differ after e bytes and e + p >= length, that is a maximal repeat, and both have it.
The neighbours suffice: any other member agrees with them at least as far. So every
occurrence gets its largest cover without any list of pairs.

``repeat_groups`` lists the maximal repeats themselves with all their occurrences: each interval is scanned again in
the order of the left contexts, so that what differs on both sides comes out with every member.

A gram with more than ``MAX_GROUP`` different contexts isn't gathered: hashes of ranges of its
windows are counted, which is exact as well and puts no group into one task. For ``repeat_groups`` such a gram's contexts
are parted by longer strings around it until each part fits the tree; the rows are the same for every ``max_group``.

Defined results: a null text is empty; texts shorter than ``length`` keep all; equal
texts get equal results, and each removes the other's; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, read, small_batches, staged, text_key

LENGTH, GRAM = 400, 128
MAX_GROUP = 20_000
FAN = 4  # parts of a range of lengths, by round
RANGES = (42, 6, 1)  # offsets in a range, by round; each divides the one before
PART = 1 << 19
MAX_BROADCAST_KEYS = 300_000
_TABLE = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = []


def _powers(n: int):
    """Powers of the base and of its inverse, up to n (kept by each worker)."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 14)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]), dtype=np.uint64) for b in (_B, _B_INV)]
    return _POWERS[0][:n], _POWERS[1][:n]


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Positions of the text's anchors, ascending."""
    found = []
    for at in range(0, max(0, len(text) - length + 1), PART):
        s = np.frombuffer(text, np.uint8, min(len(text) - at, PART + length - 1), at)
        power, inverse = _powers(len(s))
        c = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[s] * power, dtype=np.uint64)])
        h = (c[gram:] - c[:-gram]) * inverse[:len(s) - gram + 1]
        h = (h ^ (h >> np.uint64(29))) * _B
        # the hash's upper half, then the place: the minimum is the leftmost of the least
        m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width, window = 1, length - gram + 1
        while width < window:
            step = min(width, window - width)
            m = np.minimum(m[:-step], m[step:])
            width += step
        p = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
        found.append(p[np.concatenate([[True], p[1:] != p[:-1]])] + at)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def context(text: bytes, p: int, length: int = LENGTH, gram: int = GRAM) -> tuple[bytes, bytes]:
    return text[max(0, p - length + gram):p], text[p:p + length]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def maximal_covers(contexts: list[tuple[bytes, bytes, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """For each (left, right, count): how many bytes to the left and right of the anchor repeats
    of ``length`` bytes or more cover, (0, 0) if none."""
    n = len(contexts)
    cover = [(len(a), len(b)) if k > 1 and len(a) + len(b) >= length else (0, 0) for a, b, k in contexts]
    if n < 2:
        return cover
    back = [a[::-1] for a, _, _ in contexts]
    by_left = sorted(range(n), key=back.__getitem__)
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    suffixes = sorted(range(n), key=lambda i: contexts[i][1])

    def meet(i: int, j: int, prefix: int) -> None:
        e = common_prefix(back[i], back[j])
        if e + prefix >= length:
            for x in (i, j):
                cover[x] = (max(cover[x][0], e), max(cover[x][1], prefix))

    def join(stack) -> None:
        """Joins the two intervals on top at their common prefix."""
        small, prefix = stack.pop()
        large, below = stack.pop()
        if len(small) > len(large):
            small, large = large, small
        for r in small:
            at = bisect_left(large, r)
            if prefix < length:
                if at:
                    meet(by_left[r], by_left[large[at - 1]], prefix)
                if at < len(large):
                    meet(by_left[r], by_left[large[at]], prefix)
            else:  # the whole right contexts agree
                for o in large[max(0, at - 1):at + 1]:
                    meet(by_left[r], by_left[o], prefix)
            large.insert(at, r)
        stack.append((large, below))

    stack = [([rank[suffixes[0]]], -1)]  # (members by left rank, common prefix with the interval below)
    for before, i in zip(suffixes, suffixes[1:]):
        prefix = common_prefix(contexts[before][1], contexts[i][1])
        while len(stack) > 1 and stack[-1][1] >= prefix:
            join(stack)
        stack.append(([rank[i]], prefix))
    while len(stack) > 1:
        join(stack)
    return cover


def intervals(shared: list[int], least: int):
    """(common prefix, low, high) of the common-prefix intervals of a sorted list, from the common prefixes of
    neighbours (shared[i], of i - 1 and i); the stack scan. Intervals that share less than ``least`` are left out."""
    stack = []  # (common prefix, low)
    for i in range(1, len(shared) + 1):
        now, low = shared[i] if i < len(shared) else -1, i - 1
        while stack and stack[-1][0] > now:
            prefix, low = stack.pop()
            yield prefix, low, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, low))


def maximal_repeats(contexts: list[tuple[bytes, bytes, int]], length: int = LENGTH, box: tuple[int, int, int, int] | None = None):
    """(to_left, to_right, members) of every maximal repeat of ``length`` bytes or more that holds the anchor: all
    contexts that have these bytes, of which some differ before them and some behind. Contexts found several
    times are repeats as far as they reach. With a ``box`` (least and most to the right, least and most to the left)
    only repeats in it.

    Each interval of the right contexts is scanned again in the order of the reversed left contexts; an interval
    of that scan is a maximal repeat if its members stand in several of the first interval's children."""
    for i, (a, b, k) in enumerate(contexts):
        if k > 1 and len(a) + len(b) >= length:
            yield len(a), len(b), [i]
    suffixes = sorted(range(len(contexts)), key=lambda i: contexts[i][1])
    back = [a[::-1] for a, _, _ in contexts]
    right = [0] + [common_prefix(contexts[i][1], contexts[j][1]) for i, j in zip(suffixes, suffixes[1:])]
    p0, p1, e0, e1 = box or (1, length, 0, length)
    for prefix, low, high in intervals(right, p0):
        if prefix > p1:
            continue
        child, children = 0, {}
        for at in range(low, high + 1):
            child += at > low and right[at] == prefix
            children[suffixes[at]] = child
        order = sorted(children, key=back.__getitem__)
        left = [0] + [common_prefix(back[i], back[j]) for i, j in zip(order, order[1:])]
        # right contexts that are equal and cut have no children to tell apart; they are told apart on the left
        cut = all(len(contexts[i][1]) == prefix for i in children)
        for e, first, last in intervals(left, max(e0, length - prefix)):
            members = order[first:last + 1]
            if e > e1:
                continue
            if cut or len({children[i] for i in members}) > 1:
                yield e, prefix, members


def _find_anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """texts(key, raw) -> (key, pos, reach, h, c): gram's hash, context's hash, bytes to the right."""

    def run(batches):
        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for p in anchors(text, length, gram).tolist():
                    left, right = context(text, p, length, gram)
                    out.append((key, p, len(right), xxhash.xxh3_64_intdigest(right[:gram]) - 2**63,
                                xxhash.xxh3_64_intdigest(right, xxhash.xxh3_64_intdigest(left)) - 2**63))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], ["key", "pos", "reach", "h", "c"])

    return texts.mapInArrow(run, "key binary, pos int, reach int, h long, c long")


def _cut_contexts(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(raw, want array<struct(pos, h, c, n)>) -> (h, c, n, a, b)."""

    def run(batches):
        for b in batches:
            out = []
            for text, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in want:
                    out.append((w["h"], w["c"], w["n"], *context(text, w["pos"], length, gram)))
                if len(out) >= 4096:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["h", "c", "n", "a", "b"])

    return texts.mapInArrow(run, "h long, c long, n long, a binary, b binary")


def _tree_covers(contexts: DataFrame, length: int) -> DataFrame:
    """(h, c, n, a, b) -> (h, c, to_left, to_right), groups of equal h in one task."""

    def run(batches):
        held, at, out = [], None, []

        def flush():
            covers = maximal_covers([x[1:] for x in held], length) if held else []
            out.extend((at, x[0], *v) for x, v in zip(held, covers) if v != (0, 0))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["h", "c", "to_left", "to_right"])

        for b in batches:
            for h, c, n, left, right in zip(*[b.column(i).to_pylist() for i in range(5)]):
                if h != at:
                    flush()
                    held, at = [], h
                held.append((c, left, right, n))
            if out:
                yield batch()
                out.clear()
        flush()
        if out:
            yield batch()

    dealt = contexts.select("h", "c", "n", "a", "b").repartition("h").sortWithinPartitions("h", "c")
    return dealt.mapInArrow(run, "h long, c long, to_left int, to_right int")


def _batches(rows, names: list[str], kinds: tuple, size: int = 8192):
    """Rows as Arrow batches of ``size`` rows."""
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)


def _tree_repeats(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """(part, h, c, n, a, b, box) -> (h, c, group, to_left, to_right, cut), a row for each member of a maximal repeat.
    Contexts of equal ``part`` meet in one task, and their repeats in its box are listed."""

    def run(batches):
        def groups():
            held, at, box = [], None, None
            for x in batches:
                for part, h, c, n, left, right, within in zip(*[x.column(i).to_pylist() for i in range(7)]):
                    if part != at and held:
                        yield held, box
                        held = []
                    at, box = part, within
                    held.append((h, c, left, right, n))
            if held:
                yield held, box

        def found():
            for held, box in groups():
                for e, p, members in maximal_repeats([x[2:] for x in held], length, box and tuple(box)):
                    a, b = held[members[0]][2:4]
                    name = hashlib.md5(a[len(a) - e:] + b[:p]).hexdigest()
                    for i in members:
                        yield *held[i][:2], name, e, p, e == length - gram or p == length

        return _batches(found(), ["h", "c", "group", "to_left", "to_right", "cut"],
                        (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_()))

    dealt = contexts.select("part", "h", "c", "n", "a", "b", "box").repartition("part").sortWithinPartitions("part", "h", "c")
    return dealt.mapInArrow(run, "h long, c long, group string, to_left int, to_right int, cut boolean")


def _boxes(box, length: int):
    """A box's parts, ``FAN`` a side, without those that hold no repeat of ``length`` bytes."""
    p0, p1, e0, e1 = box
    wide, high = -((p0 - p1 - 1) // FAN), -((e0 - e1 - 1) // FAN)
    for p in range(p0, p1 + 1, wide):
        for e in range(e0, e1 + 1, high):
            part = p, min(p + wide - 1, p1), e, min(e + high - 1, e1)
            if part[1] + part[3] >= length:
                yield part


def _parted_repeats(contexts: DataFrame, length: int, gram: int, max_group: int) -> DataFrame:
    """The same for grams of very many contexts, without gathering them. A repeat reaches p bytes to the right of its
    anchor and e to the left. Boxes of (p, e) are cut into smaller ones; in each box contexts are parted by what all
    repeats of the box must share, so a repeat's members stay together. A part ends where nothing differs within the box
    on one of the sides, as it holds no maximal repeat; it goes to the tree once it has ``max_group`` contexts or
    fewer; a box of one (p, e) is a maximal repeat itself, counted and never gathered."""
    tree, singles = [], []
    live = contexts.select("h", "c", "a", "b", F.array(F.array(*map(F.lit, (gram, length, 0, length - gram)))).alias("live"))
    while True:

        def emit(batches):
            def rows():
                for x in batches:
                    for h, c, left, right, boxes in zip(*[x.column(i).to_pylist() for i in range(5)]):
                        for p0, p1, e0, e1 in [b for box in boxes for b in _boxes(box, length)]:
                            least = max(e0, length - p1)
                            if len(right) < p0 or len(left) < least:
                                continue
                            core = left[len(left) - least:] + right[:p0]
                            part = xxhash.xxh3_128_digest(struct.pack("<4i", p0, p1, e0, e1) + core)
                            after = xxhash.xxh3_128_digest(right[:p1 + 1]) if len(right) > p1 else None
                            before = xxhash.xxh3_128_digest(left[len(left) - e1 - 1:]) if len(left) > e1 else None
                            name = hashlib.md5(core).hexdigest() if p0 == p1 and e0 == e1 else None
                            yield h, c, [p0, p1, e0, e1], part, before, after, name

            return _batches(rows(), ["h", "c", "box", "part", "before", "after", "name"],
                            (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.string()))

        rows = staged(live.mapInArrow(emit, "h long, c long, box array<int>, part binary, before binary, after binary, name string"), "suffix-boxes")
        agree = [(F.count(x) == F.count(F.lit(1))) & (F.min(x) == F.max(x)) for x in ("before", "after")]
        parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("m"), *[F.coalesce(x, F.lit(False)).alias(n) for x, n in zip(agree, "lr")])
        parts = staged(parts.where("m > 1 and not l and not r").select("part", "m"), "suffix-parts")
        alive = staged(rows.select("h", "c", "box", "part", "name").join(parts, "part"), "suffix-live")
        singles.append(alive.where("name is not null").select(
            "h", "c", F.col("name").alias("group"), F.col("box")[2].alias("to_left"), F.col("box")[0].alias("to_right"),
            ((F.col("box")[2] == length - gram) | (F.col("box")[0] == length)).alias("cut")))
        alive = alive.where("name is null")
        tree.append(alive.where(F.col("m") <= max_group).select("part", "h", "c", "box"))
        more = alive.where(F.col("m") > max_group)
        if more.isEmpty():
            break
        live = contexts.select("h", "c", "a", "b").join(more.groupBy("h", "c").agg(F.collect_list("box").alias("live")), ["h", "c"])
    parted = reduce(DataFrame.union, tree).join(contexts.select("h", "c", F.lit(1).cast("long").alias("n"), "a", "b"), ["h", "c"])
    whole = contexts.where((F.col("n") > 1) & (F.octet_length("a") + F.octet_length("b") >= length)).select(
        "h", "c", F.md5(F.concat("a", "b")).alias("group"), F.octet_length("a").alias("to_left"), F.octet_length("b").alias("to_right"),
        ((F.octet_length("a") == length - gram) | (F.octet_length("b") == length)).alias("cut"))
    return reduce(DataFrame.union, singles).union(_tree_repeats(parted, length, gram)).union(whole)


def _counted_covers(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for grams of very many contexts, without gathering them. A range of offsets [d0, d1] of the
    anchor in a window is settled by two counts: if what all its windows share is found
    once only, none of them is repeated; if what they span together is found again, all are. Ranges in
    between are cut into smaller ones, down to single windows; of those settled by a
    common span one goes on for all, so that others can still be found equal to it."""
    last, covers, state = length - gram, None, contexts.select("h", "c", "a", "b", F.array(F.struct(
        F.lit(0).alias("d0"), F.lit(length - gram).alias("d1"), "n")).alias("live"))
    for size in RANGES:

        def emit(batches, size=size):
            for x in batches:
                out = []
                for h, c, left, right, live in zip(*[x.column(i).to_pylist() for i in range(5)]):
                    text, p = left + right, len(left)
                    low, high = max(0, length - len(right)), min(last, p)
                    for d0, n in [(d, r["n"]) for r in live for d in range(r["d0"], r["d1"] + 1, size)]:
                        d1 = min(d0 + size - 1, last)
                        if d0 > high or d1 < low:
                            continue
                        core = xxhash.xxh3_64_intdigest(text[p - d0:p - d1 + length]) - 2**63
                        span = xxhash.xxh3_64_intdigest(text[p - d1:p - d0 + length]) - 2**63 if low <= d0 and d1 <= high else None
                        out.append((h, c, n, d0, d1, core, span))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)],
                                                 ["h", "c", "n", "d0", "d1", "core", "span"])

        rows = staged(state.mapInArrow(emit, "h long, c long, n long, d0 int, d1 int, core long, span long"), "suffix-ranges")
        cores = rows.groupBy("h", "d0", "core").agg(F.sum("n").alias("times")).where("times > 1").drop("times")
        spans = rows.where("span is not null").groupBy("h", "d0", "span").agg(
            F.sum("n").alias("times"), F.min("c").alias("one")).where("times > 1")
        alive = rows.join(cores, ["h", "d0", "core"]).join(spans, ["h", "d0", "span"], "left").select(
            "h", "c", "n", "d0", "d1", "times", "one")
        alive = staged(alive, "suffix-alive")
        done = alive.where("times > 1").groupBy("h", "c").agg(
            F.max("d1").alias("to_left"), (F.lit(length) - F.min("d0")).cast("int").alias("to_right"))
        covers = done if covers is None else covers.union(done)
        more = alive.where("d1 > d0 and (times is null or c = one)").groupBy("h", "c").agg(
            F.collect_list(F.struct("d0", "d1", F.coalesce("times", "n").alias("n"))).alias("live"))
        state = contexts.select("h", "c", "a", "b").join(more, ["h", "c"])
    return covers.groupBy("h", "c").agg(F.max("to_left").alias("to_left"), F.max("to_right").alias("to_right"))


def _met(docs: DataFrame, text_col: str, length: int, gram: int, max_group: int):
    """Anchors whose grams stand several times (key, pos, h, c), those of one context with what it covers
    (h, c, to_left, to_right), the other contexts (h, c, n, a, b), and the grams of too many contexts (h) or None."""
    small_batches(docs.sparkSession, 1000)
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw"))
    texts = texts.where(F.octet_length("raw") >= length)
    found = staged(_find_anchors(texts, length, gram), "suffix-anchors")
    # most grams stand once; only the others' anchors go on. Joined with a written table, a common gram's rows can be split
    again = staged(found.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h"), "suffix-again")
    found = staged(found.join(again, "h"), "suffix-met")
    folded = found.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos", "reach")).alias("at"))
    folded = staged(folded, "suffix-folded")
    groups = staged(folded.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")), "suffix-groups")
    folded = folded.join(groups, "h")
    alone = folded.where("contexts = 1").select(
        "h", "c", F.least(F.col("at.pos"), F.lit(length - gram)).alias("to_left"), F.col("at.reach").alias("to_right"))
    alone = alone.where(F.col("to_left") + F.col("to_right") >= length)
    want = folded.where("contexts > 1").groupBy("at.key").agg(
        F.collect_list(F.struct("at.pos", "h", "c", "n")).alias("want"), F.max(F.col("contexts") > max_group).alias("big"))
    want = staged(want, "suffix-want")
    once = texts.join(broadcast_if_small(want.select("key"), MAX_BROADCAST_KEYS), "key", "left_semi").groupBy("key").agg(F.first("raw").alias("raw"))
    contexts = _cut_contexts(once.join(want, "key").select("raw", "want"), length, gram)
    hot = groups.where(F.col("contexts") > max_group).select("h")
    if hot.isEmpty():
        return found, alone, contexts, None
    return found, alone, staged(contexts, "suffix-contexts"), hot


def repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
            max_group: int = MAX_GROUP) -> DataFrame:
    """(key, spans): for every text with repeats of ``length`` bytes, by its key, the
    places [start, end) that they cover around each anchor; they may overlap."""
    found, alone, contexts, hot = _met(docs, text_col, length, gram, max_group)
    if hot is None:
        covers = _tree_covers(contexts, length)
    else:
        covers = _tree_covers(contexts.join(hot, "h", "left_anti"), length).union(
            _counted_covers(contexts.join(hot, "h", "left_semi"), length, gram))
    covers = staged(covers.union(alone), "suffix-covers")
    placed = found.join(covers, ["h", "c"]).select("key", F.struct(
        (F.col("pos") - F.col("to_left")).alias("start"), (F.col("pos") + F.col("to_right")).alias("end")).alias("span"))
    return placed.groupBy("key").agg(F.collect_set("span").alias("spans"))


def repeat_groups(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                  max_group: int = MAX_GROUP) -> DataFrame:
    """(group, key, start, end, cut): the maximal repeats of ``length`` bytes or more, a row for every occurrence
    in a distinct text; ``group`` is the MD5 of the repeated string.

    A repeat is seen from an anchor, ``length - gram`` bytes to the left and ``length`` to the right. If it was only seen
    up to one of these bounds ``cut`` is true: it may go on, and its further anchors show the next pieces. Anchors whose
    contexts are all equal are one group, named by the context. ``max_group`` bounds what one task gathers and changes
    no row. An empty table gives no rows."""
    found, alone, contexts, hot = _met(docs, text_col, length, gram, max_group)
    rows = alone.select("h", "c", F.md5(F.concat_ws(" ", "h", "c")).alias("group"), "to_left", "to_right", F.lit(True).alias("cut"))
    whole = [F.hex("h").cast("binary").alias("part"), "h", "c", "n", "a", "b", F.lit(None).cast("array<int>").alias("box")]
    if hot is None:
        rows = rows.union(_tree_repeats(contexts.select(*whole), length, gram))
    else:
        rows = rows.union(_tree_repeats(contexts.join(hot, "h", "left_anti").select(*whole), length, gram))
        rows = rows.union(_parted_repeats(staged(contexts.join(hot, "h", "left_semi"), "suffix-hot"), length, gram, max_group))
    rows = staged(rows, "suffix-repeats")
    placed = found.join(rows, ["h", "c"]).select(
        "group", "key", (F.col("pos") - F.col("to_left")).alias("start"), (F.col("pos") + F.col("to_right")).alias("end"))
    return placed.distinct().join(rows.groupBy("group").agg(F.min("cut").alias("cut")), "group").select("group", "key", "start", "end", "cut")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept binary, text) for every row: spans are the maximal removed runs, kept is
    what is left and text the same as a string, without characters that were cut in two."""
    spans = staged(repeats(docs, text_col, length), "suffix-spans").withColumnRenamed("key", "k")
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    left = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), raw.alias("raw"))
    both = left.join(spans.hint("merge"), F.col("key") == F.col("k"), "left").select("id", "raw", "spans")

    def run(batches):
        for b in batches:
            n, gone, runs, kept = [], [], [], []
            for raw, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                m = merged([(x["start"], x["end"]) for x in s or []])
                ends = [0, *[e for _, e in m]]
                kept.append(b"".join(raw[a:z] for a, z in zip(ends, [a for a, _ in m] + [len(raw)])))
                n.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                runs.append([{"start": a, "end": z} for a, z in m])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()),
                 pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())],
                ["id", "n_bytes", "n_removed", "spans", "kept", "text"])

    kind = left.schema["id"].dataType.simpleString()
    out = both.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary, text string")
    return out.withColumnRenamed("id", id_col)


def op1_suffix_dedup(spark, sf_dir) -> DataFrame:
    out = dedup_substrings(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"), "text")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLE_SQL = {}
