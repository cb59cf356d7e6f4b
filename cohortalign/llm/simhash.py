"""SimHash near-duplicates by a byte-position index with count filtering (operator 4).

A fingerprint of B bytes is indexed by the bytes it holds at chosen positions. Two
fingerprints with at most r differing bits share at least B - r positional bytes. With B = 8 and
r = 4 they share four; keys of three bytes are made for 20 choices of positions, of which every
four positions hold one, so all such pairs meet. Within a key the shared positional
bytes of each pair are tallied: pairs that share no more than the key's are dropped, and those that
reach the guaranteed count are verified by the differing bits. Of each list only the edges of a spanning forest are
written, never all pairs. A list longer than ``MAX_LIST`` is cut into blocks, and
each pair of blocks is compared in a task of its own.

``near_duplicates`` uses the same index with 64-byte fingerprints of the distinct five-word
shingles: differing bits only propose pairs, and every pair is settled by the exact
Jaccard similarity of the shingle sets. Texts of few distinct shingles, whose bits say
little, are also indexed by their rarest shingles, of which alike sets share one for certain.

Defined results: null or blank texts have fingerprint zero and are linked like any
other; rows with a null id take part but can't name a component; repeated rows
share a fingerprint; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, broadcast_if_small, connected_components, keeps_batch_size, read, small_batches, staged, text_key

SHINGLE, RADIUS, SEED = 4, 4, 42
MAX_LIST = 8192
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_hashes(text: str | None, n: int, seed: int = SEED, bounds=None) -> np.ndarray:
    """XXH64 of every n-word shingle of the lower-cased text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - n + 1].tolist()
    stops = (ends[n - 1:] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of a hash (a splitmix64 step)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, words: int = 1) -> bytes:
    """Big-endian; a bit is 1 if set in over half the hashes. Word 0 uses the hashes as they are."""
    out = []
    for k in range(words):
        ones = np.zeros(64, np.int64)
        for part in np.array_split(h, range(1 << 15, len(h), 1 << 15)):
            part = _mixed(part, k) if k else part
            ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(h)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """(id, fp binary): one SimHash of ``64 * words`` bits per row."""
    small_batches(docs.sparkSession)
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            fps = [fingerprint(shingle_hashes(t, shingle), words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], ["id", "fp"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, fp binary")


def position_sets(n_bytes: int, radius: int) -> list[tuple[int, ...]]:
    """Choices of one position fewer than two fingerprints must share at least, such that every set of as many as they
    must share holds one of them. For three positions: the positions are dealt into three classes in a circle, and a choice lies
    in one class, or has two positions in a class and one in the next; by the pigeonhole principle every four positions hold one."""
    least = n_bytes - radius
    if least != 4:
        return list(itertools.combinations(range(n_bytes), least))
    where = [p * 3 // n_bytes for p in range(n_bytes)]
    held = lambda s: sorted(where[p] for p in s)
    fits = lambda a, b, c: a == b == c or a == b and c == (a + 1) % 3 or b == c and a == (b + 1) % 3
    return [s for s in itertools.combinations(range(n_bytes), 3) if fits(*held(s))]


def forest(fps: np.ndarray, radius: int, least: int) -> list[tuple[int, int]]:
    """Edges (indexes) of a spanning forest of the graph that links rows of a
    uint8 matrix sharing ``least`` positional bytes and differing in ``radius`` bits at most."""
    left, edges, queue = np.arange(len(fps)), [], []
    while len(left):
        if not queue:
            queue.append(left[0])
            left = left[1:]
            continue
        q = queue.pop()
        x = fps[left] ^ fps[q]
        near = (x == 0).sum(1) >= least
        near[near] = np.bitwise_count(x[near]).sum(1, dtype=np.int64) <= radius
        edges += [(int(q), int(i)) for i in left[near]]
        queue += left[near].tolist()
        left = left[~near]
    return edges


_EDGE = "u binary, v binary, key long, block int, fps array<binary>"
_EDGE_ARROW = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("key", pa.int64()), ("block", pa.int32()),
                         ("fps", pa.list_(pa.binary()))])


def _runs(batches):
    """(key, fingerprints, block) for runs of equal keys, cut into blocks of MAX_LIST.
    Single entries are passed over unless they may go on in the next batch."""
    key, held, block = None, [], 0
    for b in batches:
        keys, fps = b.column(0).to_numpy(), b.column(1)
        if not len(keys):
            continue
        starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
        stops = np.append(starts[1:], len(keys))
        wanted = (stops - starts > 1) | (starts == 0) | (stops == len(keys))
        for i, j in zip(starts[wanted].tolist(), stops[wanted].tolist()):
            if keys[i] != key:
                if len(held) > 1 or block:
                    yield key, held, block
                key, held, block = keys[i], [], 0
            held += fps.slice(i, j - i).to_pylist()
            while len(held) > MAX_LIST:
                yield key, held[:MAX_LIST], block
                held, block = held[MAX_LIST:], block + 1
    if len(held) > 1 or block:
        yield key, held, block


def _met(batches):
    """Of rows sorted by key, those whose key comes up again."""
    held = None  # the last row of a batch, and whether it has been met
    for b in batches:
        k, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(k):
            continue
        if held is not None:
            k, v = np.concatenate([held[0], k]), np.concatenate([held[1], v])
        same = k[1:] == k[:-1]
        keep = np.concatenate([[held is not None and held[2]], same]) | np.concatenate([same, [False]])
        held = (k[-1:], v[-1:], len(k) > 1 and bool(same[-1]) or len(k) == 1 and held is not None and held[2])
        yield pa.RecordBatch.from_arrays([pa.array(k[:-1][keep[:-1]]), pa.array(v[:-1][keep[:-1]])], ["key", "node"])
    if held is not None and held[2]:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["key", "node"])


def index_of(distinct: DataFrame, sets: list[tuple[int, ...]], narrow: bool = True) -> DataFrame:
    """(key, fp), or (key, node): a row for each choice of positions."""
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.substring("fp", p + 1, 1) for p in s]) for i, s in enumerate(sets)])
    return distinct.select(F.explode(keys).alias("key"), "fp" if narrow else node_of("fp").alias("node"))


def met_again(index: DataFrame) -> DataFrame:
    """Of (key, node) the rows of keys that have several; only they get the wide fingerprints."""
    index = index.repartition("key").sortWithinPartitions("key")
    index.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    return staged(index.mapInArrow(_met, "key long, node long"), "simhash-met")


def linked(index: DataFrame, edges_of) -> tuple[DataFrame, DataFrame]:
    """(u, v): the pairs of rows that ``edges_of(rows)`` finds in the lists of an index (key, fp); and
    (key): lists with several of them or cut into blocks, where a forest may pass over other pairs."""
    spark = index.sparkSession
    index = index.repartition("key").sortWithinPartitions("key")

    def batch(out):
        return pa.RecordBatch.from_pylist([dict(zip(_EDGE_ARROW.names, r)) for r in out], _EDGE_ARROW)

    def scan(batches):
        out = []
        for key, fps, block in _runs(batches):
            n = 0
            for n, (a, b) in enumerate(edges_of(fps) if len(fps) > 1 else (), 1):
                out.append((fps[a], fps[b], None, None, None))
                if len(out) >= 4096:
                    yield batch(out)
                    out = []
            if block or len(fps) == MAX_LIST:
                yield batch([*out, (None, None, int(key), block, fps)])
                out = []
            elif n > 1:
                out.append((None, None, int(key), None, None))
        if out:
            yield batch(out)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    found = staged(index.mapInArrow(scan, _EDGE), "simhash-lists")
    small_batches(spark, 1)

    def across(batches):
        for b in batches:
            for r in b.to_pylist():
                rows, out = [*r["a"], *r["b"]], []
                for e in edges_of(rows):
                    out.append((rows[e[0]], rows[e[1]]))
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out)], ["u", "v"])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out)], ["u", "v"])

    edges = found.where("u is not null").select("u", "v")
    blocks = found.where("block is not null").select("key", "block", "fps")
    if not blocks.isEmpty():
        pairs = blocks.alias("x").join(blocks.alias("y"), "key").where("x.block < y.block")
        pairs = pairs.select(F.col("x.fps").alias("a"), F.col("y.fps").alias("b")).repartition(F.rand(7))
        edges = edges.union(staged(pairs.mapInArrow(across, "u binary, v binary"), "simhash-blocks"))
    return edges.distinct(), found.where("key is not null").select("key").distinct()


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def node_of(fp):
    """A fingerprint's name in the graph: its 64 bits, or 64 hashed bits of a wider one."""
    return F.when(F.octet_length(fp) == 8, F.conv(F.hex(fp), 16, -10).cast("long")).otherwise(F.xxhash64(fp))


def components(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """fps(id, fp), edges(u, v) -> id, fp, component (smallest id reachable)."""
    nodes = staged(fps.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    cc = connected_components(edges.select(node_of("u").alias("u"), node_of("v").alias("v")))
    named = nodes.withColumn("node", node_of("fp")).join(cc, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp")


def _distinct(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints over all shuffle partitions: each becomes many index rows."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fps.select("fp").distinct().repartition(n)


@keeps_batch_size
def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       radius: int = RADIUS) -> DataFrame:
    """(id, fp binary of 8 bytes, component_id): fingerprints link at ``radius`` or fewer differing bits."""
    fps = staged(fingerprints(docs, id_col, text_col, shingle), "simhash")
    edges = linked(index_of(_distinct(fps), position_sets(8, radius)), lambda rows: forest(_matrix(rows), radius, 8 - radius))[0]
    return components(fps, edges)


def op4_simhash(spark, sf_dir) -> DataFrame:
    out = simhash_components(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


# near duplicates by similarity of five-word shingle sets

NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8
NEAR_WORDS = 8  # 64 bytes, 512 bits
NEAR_KEYS = 160  # choices of three positions
NEAR_LEAST = 6  # positional bytes in common; about 17 are expected at a similarity of 0.8
SURE_BITS, DOUBT_BITS = 56, 110  # of 512; 78 are expected to differ at 0.8, with a deviation of 8
NEAR_SHORT = 64  # texts of no more distinct shingles, and those that can be alike to them, have an exact index
MAX_BROADCAST_TEXTS = 200_000


def _near_sets() -> list[tuple[int, ...]]:
    rng = random.Random(SEED)
    return [tuple(sorted(rng.sample(range(8 * NEAR_WORDS), 3))) for _ in range(NEAR_KEYS)]


def proposed(rows: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of a list to be settled first, from rows that begin with the fingerprint: a spanning forest of
    the very similar rows, and of the pairs between its groups that the bits leave open."""
    fps = _matrix(rows)[:, :8 * NEAR_WORDS]
    top, sure = list(range(len(fps))), forest(fps, SURE_BITS, NEAR_LEAST)

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a, b in sure:
        top[find(b)] = find(a)
    return sure + [(a, b) for a, b in forest(fps, DOUBT_BITS, NEAR_LEAST) if find(a) != find(b)]


def open_pairs(rows: list[bytes]):
    """Every pair of differing groups that the bits leave open, from rows of a fingerprint that end with
    the group (8 bytes)."""
    m = _matrix(rows)
    fps, label = m[:, :8 * NEAR_WORDS], m[:, -8:].copy().view(np.uint64)[:, 0]
    for i in range(len(fps) - 1):
        other = i + 1 + np.flatnonzero(label[i + 1:] != label[i])
        x = fps[other] ^ fps[i]
        near = ((x == 0).sum(1) >= NEAR_LEAST) & (np.bitwise_count(x).sum(1, dtype=np.int64) <= DOUBT_BITS)
        for j in other[near].tolist():
            yield i, j


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / max(1, a.size + b.size - both)


def alike(rows: list[bytes], similarity: float):
    """Edges of a spanning forest of the rows whose sets are alike; a row is 8 bytes and the sorted hashes."""
    sets = [np.frombuffer(r, np.uint64)[1:] for r in rows]
    sizes = np.array([len(x) for x in sets])
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    open_, queue = np.ones(len(rows), bool), []
    while open_.any():
        q = queue.pop() if queue else int(open_.argmax())
        open_[q] = False
        x = sets[q]
        # only sets of a size that can be alike
        left = np.flatnonzero(open_ & (sizes >= similarity * len(x)) & (sizes * similarity <= len(x)))
        if not len(left):
            continue
        mine = np.concatenate([flat[starts[i]:starts[i] + sizes[i]] for i in left])
        at = np.minimum(np.searchsorted(x, mine), len(x) - 1)
        both = np.add.reduceat(x[at] == mine, np.concatenate([[0], np.cumsum(sizes[left])[:-1]]), dtype=np.int64)
        near = left[both / (sizes[left] + len(x) - both) >= similarity]
        for i in near.tolist():
            yield int(q), i
        queue += near.tolist()
        open_[near] = False


def short_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v): spanning forests of alike sets, from (node, hs array<long>), distinct; exact. Of two alike sets of m
    hashes and more, each has a common one among its m - ceil(similarity * m) + 1 rarest."""
    hashes = nodes.select("node", F.size("hs").alias("m"), F.explode("hs").alias("key"))
    counts = hashes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rare = hashes.join(counts, "key").groupBy("node", "m").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("held"))
    # those that no other set has are the rarest and need no row
    most = F.col("m") - F.ceil(F.col("m") * similarity - 1e-9) + 1 - (F.col("m") - F.size("held"))
    rare = rare.withColumn("most", most.cast("int")).where("most > 0").select("node", F.explode(F.slice("held", F.lit(1), F.col("most"))).alias("x"))
    index = staged(rare.select("node", "x.key"), "near-rare")
    index = index.join(nodes.select("node", F.concat(_long_bytes("node"), "h").alias("fp")), "node").select("key", "fp")
    edges, _ = linked(index, lambda rows: alike(rows, similarity))
    u, v = (node_of(F.substring(c, 1, 8)) for c in ("u", "v"))
    return edges.select(u.alias("u"), v.alias("v"))


def near_fingerprints(texts: DataFrame, shingle: int, few: int) -> DataFrame:
    """(id, fp, h, hs): the wide SimHash of each text's distinct shingles, followed by a hash of their set, so
    that rows of equal ``fp`` have equal sets; and the set of at most ``few``, as bytes and as an array."""
    small_batches(texts.sparkSession)

    def run(batches):
        for b in batches:
            hs = [np.unique(shingle_hashes(t, shingle)) for t in b.column(1).to_pylist()]
            fps = [fingerprint(h, NEAR_WORDS) + xxhash.xxh64_digest(h.tobytes(), SEED) for h in hs]
            short = [h if len(h) <= few else None for h in hs]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(fps, pa.binary()), pa.array([None if h is None else h.tobytes() for h in short], pa.binary()),
                 pa.array([None if h is None else h.view(np.int64) for h in short], pa.list_(pa.int64()))], ["id", "fp", "h", "hs"])

    return texts.select("id", "text").mapInArrow(run, "id binary, fp binary, h binary, hs array<long>")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, text) -> (node, h): the sorted distinct shingle hashes as bytes."""
    small_batches(texts.sparkSession)

    def run(batches):
        for b in batches:
            hs = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hs, pa.binary())], ["node", "h"])

    return texts.select("node", "text").mapInArrow(run, "node long, h binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of the pairs (u, v) whose shingle sets (node, h) have that Jaccard similarity."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("h").alias("a")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("h").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches):
        for b in batches:
            ok = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity
                  for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    small_batches(pairs.sparkSession, 500)
    return both.mapInArrow(run, "u long, v long")


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (u, v) whose nodes are not in one group of (node, component)."""
    out = pairs
    for c in ("u", "v"):
        out = out.join(groups.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")), c, "left")
    return out.where(F.coalesce("_u", "u") != F.coalesce("_v", "v")).select("u", "v")


def settled(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): verified pairs that join the groups which all alike pairs of the given ones would join.
    First each node's pair with its least partner; then all pairs of groups that are still apart."""
    first = staged(verified(pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), sets, similarity), "near-first")
    rest = staged(apart(pairs, connected_components(first)), "near-rest")
    return first.union(staged(verified(rest, sets, similarity), "near-second"))


def _long_bytes(c: str):
    return F.unhex(F.lpad(F.hex(c), 16, "0"))


def _node_pairs(edges: DataFrame) -> DataFrame:
    """(u, v), nodes in order, of pairs of rows that begin with the fingerprint and the hash of the set."""
    u, v = (node_of(F.substring(c, 1, 8 * NEAR_WORDS + 8)) for c in ("u", "v"))
    out = edges.select(u.alias("u"), v.alias("v"))
    return out.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()


@keeps_batch_size
def near_duplicates(docs: DataFrame, text_col: str = "text", shingle: int = NEAR_SHINGLE,
                    similarity: float = NEAR_SIMILARITY, short: int | None = NEAR_SHORT) -> DataFrame:
    """(key, component): distinct texts, by their key, whose shingle sets are alike (Jaccard), joined
    transitively; texts that are alone have no row. Blank texts have no shingles and stay alone.

    Nodes are distinct shingle sets. Each pair that the index proposes is settled on the sets: first spanning
    forests of the lists, then all further open pairs between groups that these leave apart. Sets of at most ``short`` shingles,
    or of any size if it is None, are also met by their rarest shingles, which misses no pair; that index holds a fifth of the shingles.
    """
    text = F.col(text_col)
    full = docs.select(text_key(text).alias("id"), text.alias("text")).where(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")))
    fps = staged(near_fingerprints(full, shingle, int(short / similarity) if short is not None else 1 << 60), "near")
    wide = _distinct(fps).withColumn("node", node_of("fp"))
    met = met_again(index_of(_distinct(fps), _near_sets(), False))
    pairs, several = linked(met.join(wide, "node").select("key", "fp"), proposed)
    pairs = staged(_node_pairs(pairs), "near-edges")
    rep = fps.groupBy(node_of("fp").alias("node")).agg(F.min("id").alias("id"))
    wanted = staged(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(rep, "node"), "near-wanted")
    texts = full.join(broadcast_if_small(wanted, MAX_BROADCAST_TEXTS), "id").select("node", "text").dropDuplicates(["node"])
    sets = staged(shingle_sets(texts, shingle), "near-sets")
    good = settled(pairs, sets, similarity)
    lists = met.join(several, "key").join(connected_components(good), "node", "left")
    lists = staged(lists.select("key", "node", F.coalesce("component", "node").alias("group")), "near-lists")
    mixed = lists.groupBy("key").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a <> b").select("key")
    lists = lists.join(mixed, "key").join(wide, "node").select("key", F.concat("fp", _long_bytes("group")).alias("fp"))
    more = _node_pairs(linked(lists, open_pairs)[0]).join(pairs, ["u", "v"], "left_anti")
    good = good.union(settled(staged(more, "near-more"), sets, similarity))
    short = fps.where("h is not null").select(node_of("fp").alias("node"), "h", "hs").dropDuplicates(["node"])
    good = good.union(staged(short_pairs(staged(short, "near-short"), similarity), "near-alike"))
    cc = connected_components(good)
    same = fps.groupBy("fp").agg(F.count_distinct("id").alias("n")).where("n > 1").select(node_of("fp").alias("node")).withColumn("component", F.col("node"))
    cc = cc.union(same.join(cc.select("node"), "node", "left_anti"))
    return fps.select(node_of("fp").alias("node"), F.col("id").alias("key")).distinct().join(cc, "node").select("key", "component")


QUERIES = {"op4_simhash": op4_simhash}
ORACLE_SQL = {}
