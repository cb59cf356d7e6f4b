"""Training-data operators against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing extra columns."""

import base64
import hashlib
import os
import re
import sys

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cohortalign import llm
from cohortalign.llm import (common, decontaminate, embeddings, html_text, langid, lines, mixing, simhash, suffix_dedup, url_rules, warc)

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import DATA, duck_rows, spark_rows  # noqa: E402

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def words(n, seed, vocabulary=5000):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, vocabulary, n)]


@needs_data
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_sql(spark, name):
    assert spark_rows(llm.queries()[name](spark, DATA)) == duck_rows(llm.oracle_sql()[name])


# components


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(300, 340)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[i] == 200 for i in range(300, 340)) and len(got) == 142
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1


def repeated(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for j in range(len(b) - n + 1):
            seen[b[j:j + n]] = seen.get(b[j:j + n], 0) + 1
    out = []
    for b in raw:
        m = np.zeros(len(b), bool)
        for j in range(len(b) - n + 1):
            if seen[b[j:j + n]] > 1:
                m[j:j + n] = True
        out.append(m)
    return raw, out


@pytest.mark.parametrize("most", [20_000, 2])
def test_substrings(spark, most, monkeypatch):
    if most == 2:
        monkeypatch.setattr(suffix_dedup, "MAX_BROADCAST_KEYS", 0)
    rng = np.random.default_rng(0)
    rand = lambda n: "".join(rng.choice(list("abcdé "), n))
    a, b = rand(900), rand(450)
    texts = [None, "", a, a, a[100:700] + rand(50), rand(30) + a[300:] + rand(20), "x" * 1000, "y" * 399, "y" * 399, b + "|" + b, rand(3000),
             *[rand(60) + b[:420] + rand(60) for _ in range(6)], "zq" * 500]
    df = docs(spark, texts).withColumn("key", F.lit("clash")).withColumn("spans", F.lit(1))
    spans = suffix_dedup.repeats(df, max_group=most)
    got = {bytes(r["key"]): sorted((x["start"], x["end"]) for x in r["spans"]) for r in spans.collect()}
    raw, want = repeated(texts, 400)
    for r, m in zip(raw, want):
        cover = np.zeros(len(r), bool)
        for s, e in got.get(hashlib.md5(r).digest(), []):
            cover[s:e] = True
        assert (cover == m).all()
    out = {r["doc_id"]: r for r in suffix_dedup.dedup_substrings(df).collect()}
    for i, (r, m) in enumerate(zip(raw, want)):
        kept = bytes(np.frombuffer(r, np.uint8)[~m])
        assert out[i]["n_removed"] == m.sum() and out[i]["kept"] == kept and out[i]["text"] == kept.decode("utf-8", "ignore")


def test_substrings_query(spark, tmp_path):
    """Planted passages of 400 bytes and more go from all documents that hold them, others stay, through the query."""
    rng = np.random.default_rng(4)
    passages = [" ".join(f"p{i}w{x}" for x in rng.integers(0, 9999, 70)) for i in range(5)]
    short = "a passage of under four hundred bytes " * 2
    texts = [" ".join(words(60 + i, 300 + i)) for i in range(40)]
    for i in range(0, 40, 2):
        texts[i] += " " + passages[i % 5] + " " + " ".join(words(20, 900 + i)) + short
    docs(spark, [*texts, None, ""]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in suffix_dedup.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    raw, want = repeated([*texts, None, ""], 400)
    for i, (r, m) in enumerate(zip(raw, want)):
        kept = bytes(np.frombuffer(r, np.uint8)[~m])
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_kept"], got[i]["kept_sha256"]) == (len(r), m.sum(), len(kept), hashlib.sha256(kept).hexdigest())
        assert got[i]["n_spans"] == (np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()
    assert all(passages[i % 5] not in got[i]["text"] for i in range(0, 40, 2)) and all(got[i]["text"] == texts[i] for i in range(1, 40, 2))


def maximal(raw, length):
    """Brute force: strings of ``length`` bytes or more that differ on both sides, with their occurrences."""
    at = {}
    for k, t in enumerate(raw):
        for i in range(len(t)):
            for j in range(i + length, len(t) + 1):
                at.setdefault(t[i:j], set()).add((k, i))
    before = lambda k, i: raw[k][i - 1:i] if i else (k,)
    after = lambda k, i: raw[k][i:i + 1] or (k,)
    return {s: o for s, o in at.items() if len(o) > 1 and len({before(k, i) for k, i in o}) > 1
            and len({after(k, i + len(s)) for k, i in o}) > 1}


def test_repeat_groups(spark):
    """Maximal repeats that no bound cuts have all their occurrences, and all repeats are covered by groups."""
    def check(raw, rows, names):
        want, held = maximal(raw, 16), {}
        for group, k, start, end, cut in rows:
            held.setdefault(group, ([], cut))[0].append((k, start, end))
        found = 0
        for group, (occurrences, cut) in held.items():
            strings = {raw[k][a:z] for k, a, z in occurrences}
            assert len(strings) == 1 and len(occurrences) > 1 and len(next(iter(strings))) >= 16
            if not cut:
                found += 1
                assert group == names(next(iter(strings))) and want[next(iter(strings))] == {(k, a) for k, a, _ in occurrences}
        for s, occurrences in want.items():
            for k, i in occurrences:
                over = set()
                for _, kk, a, z, _ in rows:
                    if kk == k:
                        over |= set(range(max(a, i), min(z, i + len(s))))
                assert len(over) == len(s)
        return found

    def texts(seed):
        rng = np.random.default_rng(seed)
        rand = lambda n: "".join(rng.choice(list("ab" if seed % 2 else "abc"), n))
        base = rand(60)
        out = []
        for _ in range(8):
            x = rng.integers(0, 30)
            out.append(rand(rng.integers(0, 30)) + base[x:x + rng.integers(10, 30)] + rand(rng.integers(0, 20)))
        return list(dict.fromkeys(out))

    md5 = lambda s: hashlib.md5(s).hexdigest()
    found = 0
    for seed in range(30):
        raw, by, rows = [t.encode() for t in texts(seed)], {}, {}
        for k, t in enumerate(raw):
            for p in suffix_dedup.anchors(t, 16, 6).tolist():
                c = suffix_dedup.context(t, p, 16, 6)
                by.setdefault(c[1][:6], {}).setdefault(c, []).append((k, p))
        for at in by.values():
            for e, p, members in suffix_dedup.maximal_repeats([(*c, len(x)) for c, x in at.items()], 16):
                for i in members:
                    a, b = list(at)[i]
                    for k, q in at[a, b]:
                        rows.setdefault(md5(a[len(a) - e:] + b[:p]), []).append((k, q - e, q + p, e == 10 or p == 16))
        flat = [(g, k, s, e, min(x[3] for x in o)) for g, o in rows.items() for k, s, e in {x[:3] for x in o}]
        found += check(raw, flat, md5)
    assert found > 20
    some = texts(4) + texts(6)
    at = {hashlib.md5(t.encode()).digest(): i for i, t in enumerate(some)}
    listed = []
    for most in (20_000, 2, 1):
        got = suffix_dedup.repeat_groups(docs(spark, [*some, None, ""]), length=16, gram=6, max_group=most).collect()
        rows = [(r["group"], at[bytes(r["key"])], r["start"], r["end"], r["cut"]) for r in got]
        check([t.encode() for t in some], rows, md5)
        listed.append(sorted(rows))
    assert listed[0] == listed[1] == listed[2] and len(listed[0]) > 20
    assert suffix_dedup.repeat_groups(docs(spark, [])).count() == 0


def test_repeat_groups_of_a_family(spark):
    """Near copies of one long text share their grams: every bound on a group gives the rows of the undivided tree."""
    rng = np.random.default_rng(8)
    base, out = words(260, 77), []
    for i in range(14):
        w = list(base)
        for _ in range(i % 4):
            w[rng.integers(0, len(w))] = f"edit{rng.integers(0, 9999)}"
        out.append(" ".join(w[rng.integers(0, 40):len(w) - rng.integers(0, 40)]))
    got = [sorted(map(tuple, suffix_dedup.repeat_groups(docs(spark, [*out, out[3]]), max_group=m).collect())) for m in (20_000, 5, 2)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 100


def test_long_text_has_the_anchors_of_its_parts(monkeypatch):
    text = bytes(np.random.default_rng(1).integers(97, 105, 5000, np.uint8)) + b"q" * 2000
    whole = suffix_dedup.anchors(text)
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    assert (suffix_dedup.anchors(text) == whole).all()
    assert all(((whole >= i) & (whole <= i + 400 - suffix_dedup.GRAM)).any() for i in range(0, len(text) - 400, 37))


def test_substrings_of_nothing(spark):
    assert suffix_dedup.dedup_substrings(docs(spark, [])).count() == 0


# 2


def text_of(page):
    return html_text.main_text(page)[0]


def test_pages():
    page = ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>menu</li></ul></nav><div class='ad-box'>BUY</div>"
            "<article><h1>A &amp; B</h1><p>One\n  two.<p>Three<div class=comments><p>no</div><script>var t='</p>';</script></article><footer>f</footer>")
    assert text_of(page) == "A & B\nOne two.\nThree"
    long = "Long paragraph text of quite some length so that the window surges above the threshold for sure."
    plain = (f"<div class='header'>Site</div><ul id=side-bar><li>x</li></ul><div><h2>Title</h2><p>{long}</p><p>short.</p><p>{long}</p></div>"
             f"<div class='cookie-notice'>{long}</div><form>{long}</form><footer>{long}</footer>")
    assert text_of(plain) == f"Title\n{long}\nshort.\n{long}"
    assert text_of(None) == "" and text_of("") == "" and text_of("<p>only</p>") == "only"
    assert text_of("<nav><p>never closed<article><p>text</article>") == "text"
    assert text_of("&#233;&nbsp;x &lt;b&gt;") == "é x <b>"


def test_page_keeps_its_marked_parts():
    a, b = "first part " * 20, "second part " * 15
    page = f"<body><article><p>{a}</p></article><p>between</p><article><p>{b}</p></article><article><p>tiny</p></article></body>"
    assert text_of(page) == f"{a.strip()}\n{b.strip()}"
    assert text_of(f"<body><article><a href='/'>link</a></article><p>{a}</p></body>") == a.strip()


def test_text_of_the_article_is_whole():
    body = "<p>second</p><p>third's</p>"
    assert text_of(f"<article><p title=it's>hello</p>{body}</article>") == "hello\nsecond\nthird's"
    long = "A paragraph that is certainly long enough to let the sums of its block of lines surge over the threshold at once."
    assert text_of(f"<article><p>{long}</p><section id=related-work><p>{long}</p></section><p class='search-theory'>x</p></article>") == f"{long}\n{long}\nx"
    assert text_of(f"<main><p>{long}</p></main><p>x</p><main><p>{long}</p><p><a href=/>link</a></p></main>") == f"{long}\n{long}\nlink"
    assert text_of(f"<article><p>{long}</p><ol class='comment-list'><li>{long}</li></ol><p class=ad>{long}</p></article>") == long
    assert text_of(f"<div><p>{long}</p></div><p><a href=/>a</a></p><p><a href=/>b</a></p><p><a href=/>c</a></p><p><a href=/>d</a></p><p>{long}</p>") == f"{long}\n{long}"


def test_malformed_pages_take_time_in_proportion():
    import time

    for piece in ("<a '", "<a b=\"", "<!--", "<script", "</a", "<a b='x' ", "&", "<p><div>"):
        took = []
        for n in (20_000, 80_000):
            t = time.perf_counter()
            html_text.main_text(piece * n)
            took.append(time.perf_counter() - t)
        assert took[1] < 10 * took[0] + 0.5, piece


def plain_blocks(lines):
    """Line-block distribution written out over (weight, part) for whole pages."""
    keep = set()
    any_marked = any(p and sum(w for w, q in lines[i:i + 3] if q == p) >= 80 for i, (_, p) in enumerate(lines))
    for i, (_, p) in enumerate(lines):
        if any_marked and not p:
            continue
        lo = i
        while lo and (lines[lo - 1][1] == p if any_marked else any(w for w, _ in lines[lo - 1:lo + 2])):
            lo -= 1
        hi = i + 1
        while hi < len(lines) and (lines[hi][1] == p if any_marked else any(w for w, _ in lines[hi - 1:hi + 2])):
            hi += 1
        part = [w for w, _ in lines[lo:hi]]
        if any(sum(part[j:j + 3]) >= 80 for j in range(len(part))):
            keep.add(i)
    return keep, any_marked


def test_marked_pages_against_plain_blocks():
    rng = np.random.default_rng(3)
    marked = 0
    for _ in range(300):
        parts = np.cumsum(rng.random(12) < 0.3) % 3
        number = {}
        lines = [("t", int(rng.choice([0, 5, 30, 60, 120])), 0 if p == 0 else int(p)) for p in parts]
        pieces = html_text.sections(lines)
        lines = [("t", w, k + 1 if p else 0) for k, (p, a, z) in enumerate(pieces) for _, w, _ in lines[a:z]]
        want, any_marked = plain_blocks([(w, p) for _, w, p in lines])
        runs, how = html_text.chosen(lines)
        if any_marked:
            marked += 1
            assert how == "marked" and {i for a, z in runs for i in range(a, z)} == want
        number.clear()
    assert marked > 100


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>a", 5), (1, "u", "<p>a", 5), (None, None, None, 6)], "page_id long, url string, html string, text int")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.extract(df).collect()) == [("", 0), ("a", 1), ("a", 1)]
    assert html_text.extract(df.limit(0)).count() == 0


# 3


def test_warc(spark, tmp_path):
    big = "é" * 600 + "\r\n\r\nWARC/1.0\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", big, 0), (2, None, big, 0), (3, "http://c/", "small", 0), (4, "http://d/", "small", 0),
                                   (5, "http://e/", None, 0), (2, None, big, 0)], "page_id long, url string, html string, digest int")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    for split in ("32", "0.0002"):
        got = warc.read_warc(spark, path, split_mb=split).collect()
        assert sorted((r["record_id"][10:-1], r["record_type"]) for r in got) == [
            ("1", "revisit"), ("2", "response"), ("2", "response"), ("3", "response"), ("4", "response"), ("5", "response")]
    by = {r["record_id"]: r for r in got}
    assert by["<urn:page:2>"]["payload"] == big and by["<urn:page:1>"]["refers_to"] == "<urn:page:2>" and by["<urn:page:1>"]["payload_bytes"] == len(big.encode())
    assert by["<urn:page:1>"]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()
    assert by["<urn:page:3>"]["headers"]["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"small").digest()).decode()
    only = warc.read_warc(spark, path, payload="none").where("record_type = 'revisit' and record_id in ('<urn:page:1>', '<urn:page:2>')")
    assert [(r["record_id"], r["payload"]) for r in only.collect()] == [("<urn:page:1>", None)]
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_skips_unwanted_payloads(tmp_path):
    class Counted:
        def __init__(self, data):
            self.data, self.at, self.got = data, 0, 0

        def seek(self, at):
            self.at = at

        def size(self):
            return len(self.data)

        def read(self, n):
            out = self.data[self.at:self.at + n]
            self.at += len(out)
            self.got += len(out)
            return out

    head = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Record-ID: <r>\r\nContent-Length: 1000000\r\n\r\n"
    f = Counted(b"".join(head.format(t).encode() + b"x" * 1000000 + b"\r\n\r\n" for t in ("request", "response")))
    reader = warc.WarcReader({"path": "x"})
    reader.wanted = {"record_type": {"response"}}
    assert [r[0] for r in reader.records(f, 0, f.size())] == ["response"] and f.got < 1_100_000


# 4


def plain_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, edges):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("most", [8192, 2])
def test_simhash(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MAX_LIST", most)
    base = words(300, 1)
    near = [" ".join(base[:i] + ["changed"] + base[i + 1:]) for i in range(0, 300, 15)]
    texts = [None, "", " \t\n", "One TWO", "one two", " ".join(base), *near, *[" ".join(words(40, 10 + i)) for i in range(20)], "É é x y z"]
    df = docs(spark, texts).withColumn("fp", F.lit(1)).withColumn("component", F.lit(2))
    got = {r["id"]: r for r in simhash.simhash_components(df).collect()}
    fp = [plain_fingerprint(t) for t in texts]
    assert [int.from_bytes(got[i]["fp"], "big") for i in range(len(texts))] == fp
    want = groups(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_near_duplicates_by_similarity(spark):
    texts, pairs = [], []
    for k in range(40):
        w = words(400, 100 + k)
        texts.append(" ".join(w))
        for changes in (3, 8):
            v = list(w)
            for i in np.random.default_rng(k).choice(400, changes, replace=False):
                v[i] = "other"
            texts.append(" ".join(v))
    hs = [simhash.shingle_hashes(t, 5) for t in texts]
    pairs = [(i, j) for i in range(len(hs)) for j in range(i) if simhash.jaccard(hs[i], hs[j]) >= 0.8]
    want = groups(len(hs), pairs)
    keys = {bytes(r["key"]): r["component"] for r in simhash.near_duplicates(docs(spark, [*texts, "", None, texts[0]])).collect()}
    got = [keys.get(hashlib.md5(t.encode()).digest(), -i) for i, t in enumerate(texts, 1)]
    assert len(pairs) > 60 and sum(got[i] == got[j] for i, j in pairs) >= 0.95 * len(pairs)
    assert all(want[i] == want[j] for i in range(len(hs)) for j in range(i) if got[i] == got[j]) and len(keys) <= len(texts)


def near_groups(spark, texts):
    keys = {bytes(r["key"]): r["component"] for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    return [keys.get(hashlib.md5(t.encode()).digest(), -i) for i, t in enumerate(texts, 1)]


def test_repeated_shingles_weigh_once(spark):
    run = " ha" * 64
    a, b, c = (" ".join(words(150, 900 + i)) for i in range(3))
    got = near_groups(spark, [a + run, b + run, c, c + " ha" * 24])
    assert len(set(got[:3])) == 3 and got[2] == got[3]


def test_texts_of_equal_fingerprints_are_verified(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprint", lambda h, n=1: bytes(8 * n))
    a, b = " ".join(words(150, 910)), " ".join(words(150, 911))
    got = near_groups(spark, [a, b, a + " end"])
    assert got[0] == got[2] != got[1]


@pytest.mark.parametrize("most", [8192, 100])
def test_open_pairs_of_large_lists_are_all_settled(spark, monkeypatch, most):
    """Variants of one text, most under 0.8 of each other, in lists of hundreds; all meet under each key."""
    monkeypatch.setattr(simhash, "MAX_LIST", most)
    monkeypatch.setattr(simhash, "_near_sets", lambda: [()])
    base, texts = words(300, 920), []
    for k in range(300):
        v, rng = list(base), np.random.default_rng(k // 3)
        for i in [*rng.choice(300, 9, replace=False), *np.random.default_rng(1000 + k).choice(300, 3, replace=False)]:
            v[i] = f"x{k // 3}y{i}"
        texts.append(" ".join(v))
    hs = [simhash.shingle_hashes(t, 5) for t in texts]
    fps = [simhash.fingerprint(np.unique(h), simhash.NEAR_WORDS) for h in hs]
    bits = np.bitwise_count(simhash._matrix(fps)[:, None] ^ simhash._matrix(fps)[None]).sum(2, dtype=int)
    alike = np.array([[bits[i, j] <= simhash.DOUBT_BITS and simhash.jaccard(hs[i], hs[j]) >= 0.8 for j in range(i)] + [False] * (300 - i) for i in range(300)])
    want = groups(300, [(int(i), int(j)) for i, j in zip(*np.nonzero(alike))])
    got = near_groups(spark, texts)
    assert (bits <= simhash.DOUBT_BITS).sum() > 2 * alike.sum() + 300 and len(set(want)) > 50
    assert [got.index(x) for x in got] == [want.index(x) for x in want]


@pytest.mark.parametrize("most", [8192, 3])
def test_short_near_duplicates_are_all_found(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MAX_LIST", most)
    texts, rng = [], np.random.default_rng(5)
    for n in (3, 5, 8, 9, 12, 15, 19, 24, 30, 40, 60, 75):
        for k in range(12):
            w = words(n, 2000 + 100 * n + k)
            texts += [" ".join(w), " ".join(w + ["end"]), " ".join(["start"] + w), " ".join(w[:-1] + ["last"]), " ".join(w + words(3, k))]
            w[rng.integers(n)] = "other"
            texts.append(" ".join(w))
    hs = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(hs)) for j in range(i) if len(hs[i] & hs[j]) / len(hs[i] | hs[j]) >= 0.8]
    want, got = groups(len(hs), pairs), near_groups(spark, texts)
    assert len(pairs) > 400 and [got.index(x) for x in got] == [want.index(x) for x in want]


# 5


def test_mixing(spark):
    rng = np.random.default_rng(0)
    rows = [(i, None if i % 50 == 0 else " ".join(["w"] * int(rng.integers(0, 60))), None, [None, "a", "b", "c", "d"][min(4, int(i ** 0.5) // 7)], None) for i in range(1500)]
    df = spark.createDataFrame(rows + [(2000, "w " * 20000, None, "b", None)] + rows[:3], DOCS).withColumn("size", F.lit(-1)).withColumn("h", F.lit(-1))
    out = mixing.mix(df)
    got, again = [sorted(map(tuple, x.collect()), key=repr) for x in (out, mixing.mix(df))]
    assert got == again and len(got) == 1504
    pdf = out.toPandas()
    assert (pdf["taken"] <= 3 * pdf["size"]).all() and (pdf["target"] <= 3 * pdf["source_size"] + 1e-6).all()
    by = pdf.groupby(["target", "source_size"]).agg(taken=("taken", "sum"), most=("size", "max")).reset_index()
    assert len(by) == 5 and abs(by["target"].sum() - by["source_size"].sum()) < 1e-3  # all sizes are shared out
    assert (abs(by["taken"] - by["target"]) <= by["most"] + 1).all()
    assert mixing.mix(df.limit(0)).count() == 0


# 6


def test_language(spark):
    rng = np.random.default_rng(0)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "oi", "ré"]}
    text = lambda l, n: " ".join("".join(rng.choice(parts[l], 3)) for _ in range(n))
    rows = [(i, text(l, 30), l, "s", None) for i, l in enumerate(list(parts) * 60)]
    df = spark.createDataFrame(rows + [(900, None, "aa", "s", None), (901, "12 !?", "bb", "s", None), (902, "", None, "s", None), (903, text("cc", 3000), None, "s", None)], DOCS)
    df = df.withColumn("score", F.lit("clash"))
    model = langid.train(df.where(langid.fold() != 2))
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == l for i, _, l, _, _ in rows) and got[903]["lang_pred"] == "cc"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902)) and all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.train(df.limit(0))
    assert langid.predict(df.limit(1), none).first()["lang_pred"] == "und" and langid.predict(df.limit(0), model).count() == 0
    one = langid.train(df.where("lang = 'aa'"))
    assert langid.predict(df.limit(1), one).first()["score"] == 1


def test_codewords_differ():
    for n in (2, 3, 7, 8, 40, 200):
        c = langid.codewords(n).astype(int)
        apart = ((c[:, None] != c[None]).sum(2) + c.shape[1] * np.eye(n)).min()
        assert apart == langid.least_distance(langid.codewords(n)) and apart >= (1 if n < 8 else c.shape[1] / 3)


def test_wrong_bits_are_put_right():
    code = langid.codewords(40)
    wrong = (langid.least_distance(code) - 1) // 2
    for i in range(40):
        margin = code[i] * np.where(np.isin(np.arange(code.shape[1]), np.random.default_rng(i).choice(code.shape[1], wrong, replace=False)), -1.0, 1.0)
        loss = np.logaddexp(0, -code * margin * 3).sum(1)
        assert loss.argmin() == i


@needs_data
def test_language_held_out(spark):
    r = llm.queries()["op6_langid"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert r.where("lang = lang_pred").count() >= 0.95 * r.count()


# 7


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 60)
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    rng = np.random.default_rng(1)
    rows = []
    for b in rng.normal(size=(500, 32)):
        b /= np.linalg.norm(b)
        rows.append(b)
        for _ in range(rng.integers(0, 3)):
            d = rng.normal(size=32)
            rows.append(b + d / np.linalg.norm(d) * rng.uniform(.05, .34))
    rows += [rows[0]] * 9 + [rows[5] * 2, rows[5] * 1e30] + [rows[1][:31]]
    data = [(i, [float(x) for x in r]) for i, r in enumerate(rows)]
    bad = [(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [1.0, None]), (9005, []), (9006, [float("inf"), 1.0])]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>").withColumn("n", F.lit(1)).withColumn("uid", F.lit(1))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    x = embeddings.unit([r for _, r in data])
    g = x @ x.T >= 0.95
    np.fill_diagonal(g, False)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert 0.97 * g.sum() <= found <= g.sum() and all(got[i]["n_links"] <= g[i].sum() for i in range(len(x)))
    if found == g.sum():
        assert [got[i]["component_id"] for i in range(len(x))] == groups(len(x), zip(*np.nonzero(g)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in bad) and len(got) == len(data) + len(bad)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [4096, 12])
def test_embeddings_query_recall(spark, monkeypatch, tmp_path, most):
    """64 wide, links near the threshold, null ids, ties and copies, through the query; with a second set of centroids as well."""
    monkeypatch.setattr(embeddings, "CELL", 50)
    monkeypatch.setattr(embeddings, "MAX_CELLS", most)
    rng = np.random.default_rng(2)
    rows = []
    for b in rng.normal(size=(1500, 64)):
        b /= np.linalg.norm(b)
        d = rng.normal(size=(2, 64))
        rows += [b, *(b + d / np.linalg.norm(d, axis=1)[:, None] * rng.uniform(.2, .33, 2)[:, None])]
    rows += rows[:5]
    data = [(None if i == 7 else i, [float(x) for x in r], 0) for i, r in enumerate(rows)]
    spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = embeddings.op7_embeddings(spark, str(tmp_path)).collect()
    x = embeddings.unit([r for _, r, _ in data])
    g = x @ x.T >= 0.95
    np.fill_diagonal(g, False)
    links = {r["vec_id"]: r["n_links"] for r in got}
    found = sum(links.values())
    assert len(got) == len(rows) and 0.97 * g.sum() <= found <= g.sum() and all(links[None if i == 7 else i] <= g[i].sum() for i in range(len(rows)))


# 8


def test_decontamination(spark):
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    a, b = words(40, 1, 30), words(13, 2)
    bench = [(1, " ".join(a)), (2, " ".join(b)), (3, "Short ITEM of five words"), (4, ""), (5, None), (10, " ".join(b)), (1, " ".join(a)), (None, "one")]
    texts = [None, "", " ".join(words(50, 3) + a[5:30] + words(30, 4)), " ".join(b), " ".join(b[:12]), "x short-item, OF five; words y", " ".join(words(800, 5) + b),
             " ".join(a + a + b), "no one", " ".join(words(20, 7) + a[3:16] + words(3, 8) + a[4:17]), " ".join(a)]
    df = docs(spark, texts).withColumn("key", F.lit(1)).withColumn("words", F.lit(1)).withColumn("found", F.lit(1))
    got = {r["doc_id"]: r for r in decontaminate.judged(decontaminate.hits(df, spark.createDataFrame(bench, "item_id long, text string"))).collect()}
    for i, t in enumerate(texts):
        w, hit, ids = tok(t), set(), set()
        for item, s in bench:
            v = tok(s)
            n = min(13, len(v))
            for j in range(len(v) - n + 1) if v else []:
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[j:j + n]:
                        hit |= set(range(p, p + n))
                        ids.add(item)
        r = got[i]
        assert (r["n_words"], r["n_hit"], set(r["items"])) == (len(w), len(hit), ids)
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judged(decontaminate.hits(df, none)).where("contaminated").count() == 0
    assert decontaminate.hits(df.limit(0), spark.createDataFrame(bench, "item_id long, text string")).count() == 0


def test_repetitive_texts_take_time_in_proportion(spark):
    import time

    text = spark.createDataFrame([(1, "a " * 20_000), (1, "a " * 20_000), (2, "b a " * 10_000)], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "a " * 2000), ("j", "b a " * 300), ("k", "a a a a")], "item_id string, text string")
    t = time.perf_counter()
    got = sorted((r["doc_id"], r["n_hit"], sorted(r["items"])) for r in decontaminate.judged(decontaminate.hits(text, bench)).collect())
    assert got == [(1, 20_000, ["i", "k"]), (1, 20_000, ["i", "k"]), (2, 20_000, ["j"])] and time.perf_counter() - t < 90


# 9


def test_lines(spark):
    w = [" ".join(words(10, i)) for i in range(6)]
    edit = w[0].split()
    texts = [None, "", "\n".join([w[0], "short line", w[1].upper(), w[1]]), "\n".join(["short line", " ".join(edit[:4] + ["new"] + edit[5:]), w[2]]),
             "\n".join([" ".join(edit[:9]), " ".join(edit + ["end"]), w[2] + " ", w[3]]), w[3], "\t".join(w[3].split()), "\n".join([w[4], "", w[4]])]
    df = docs(spark, texts).withColumn("t", F.lit("x")).withColumn("line", F.lit(1)).withColumn("h", F.lit(1))
    got = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    assert got[0]["text"] is None and got[1]["text"] == "" and got[1]["n_lines"] == 1
    assert got[2]["text"] == "\n".join([w[0], "short line", w[1].upper()])
    assert got[3]["text"] == w[2] and got[4]["text"] == w[3]
    assert got[5]["n_removed"] == 1 and got[6]["n_removed"] == 1 and got[7]["text"] == w[4] + "\n"
    assert lines.dedup_lines(df.limit(0)).count() == 0
    spared = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df, min_words=5).collect()}
    assert spared[3] == "short line\n" + w[2]


@pytest.mark.parametrize("most", [250_000, 0])
def test_lines_of_scripts_without_spaces_and_repeated_rows(spark, monkeypatch, most):
    monkeypatch.setattr(lines, "MAX_BROADCAST_LINES", most)
    line = "今天天气很好我们去公园散步吧"
    texts = [line, line.replace("公", "花"), "短", "短", "x" * 200_000, "x" * 200_000 + "\n" + "y z " * 50_000]
    df = docs(spark, texts)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup_lines(df).collect()}
    assert got[0] == (line, 0) and got[1] == ("", 1) and got[2] == ("短", 0) and got[3] == ("", 1) and got[5] == ("y z " * 50_000, 1)
    twice = lines.dedup_lines(df.union(df)).collect()
    assert len(twice) == 12 and all((r["text"], r["n_removed"]) == got[r["doc_id"]] for r in twice)


def test_equal_lines_of_texts_in_two_scripts(spark):
    """What is equal depends on the line alone, not on the script of the text around it."""
    line = "漢字かな交じり文"
    texts = [line + "\n" + "山" * 40, "an english text with " + "words " * 30 + "\n" + line, "“quoted” text, ordinary\n" + line + " ", "ordinary\n" + line.replace("交", "混") + "です"]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert got[0] == (texts[0], 0) and got[1] == (texts[1].split("\n")[0], 1) and got[2] == (texts[2].split("\n")[0], 1) and got[3][1] == 0


def test_batch_size_of_the_session_is_kept(spark):
    df = docs(spark, ["a b c d e", "a b c d e f", None])
    before = spark.conf.get(common.BATCH)
    simhash.simhash_components(df).collect()
    simhash.near_duplicates(df).collect()
    assert spark.conf.get(common.BATCH) == before
    if os.path.isdir(DATA):
        for name in ("op4_simhash", "op6_langid", "op7_embeddings"):
            llm.queries()[name](spark, DATA)
            assert spark.conf.get(common.BATCH) == before, name


def test_one_edit():
    a = "a b c d".split()
    for b, want in (("a b c d", 1), ("a x c d", 1), ("a c d", 1), ("a b q c d", 1), ("b a c d", 0), ("a b", 0), ("a x y d", 0)):
        assert lines.within_one_edit(a, b.split()) == bool(want)


def test_lines_that_differ_by_one_edit_share_a_half(spark):
    base = words(9, 1)
    for n in (8, 9):
        a = base[:n]
        for b in [a[:i] + ["x"] + a[i + 1:] for i in range(n)] + [a[:i] + ["x"] + a[i:] for i in range(n + 1)]:
            keys = [set(map(tuple, r[0])) for r in spark.createDataFrame([(a,), (b,)], "w array<string>").coalesce(1).select(lines._halves(F.col("w"))).collect()]
            assert keys[0] & keys[1]


# 10


def test_urls(spark):
    urls = ["http://a.example.com/de/1?x=1", "https://EXAMPLE.NET/en/2#t", "http://x.net/", "http://x.net", "http://b.org/fr/9", "http://b.org/fr", "none", None,
            "ftp://q.example.net/de/?u=http://z", "http://notnet/a"] + [f"http://s{i}.spam-farm.com/win/{i}?click=1" for i in range(30)] + [f"http://s{i}.good.com/news/{i}" for i in range(30)]
    pages = spark.createDataFrame([(i, u, "rule", "given") for i, u in enumerate(urls)], "page_id long, url string, rule string, given string")
    labels = spark.createDataFrame([(i, "block" if i < 40 else "allow") for i in range(10, 60)], "id long, label string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, labels).collect()}
    assert got[0] == ("a.example.com", "/de/1", "example.com/de/", "block") and got[1] == ("example.net", "/en/2", "example.net/en/", "allow")
    assert got[2] == ("x.net", "/", "net/", "block") and got[3][1:3] == ("", None) and got[4][2:] == ("org/fr/", "allow") and got[5][2] is None
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8][2:] == ("net/", "block") and got[9][2] is None
    assert all(got[i][3] == "block" for i in range(10, 40)) and all(got[i][3] == "allow" for i in range(40, 70))
    assert url_rules.judge(pages.limit(0), labels).count() == 0


def test_tokens_that_come_together_do_not_multiply(spark):
    path = "/".join(f"part{chr(97 + i)}" for i in range(26))
    urls = [(f"http://h{i}.com/{path}/{'bad' if i % 2 else 'good'}", "block" if i % 2 else "allow") for i in range(100)]
    urls += [(f"http://h{i}.org/zig/zag/{x}", y) for i in range(40) for x, y in (("a/b", "block"), ("a", "allow"), ("b", "allow"))]
    rules = url_rules.mine(spark.createDataFrame(urls, "url string, label string")).collect()
    tokens = {tuple(sorted(r["tokens"])): (r["support"], r["confidence"]) for r in rules}
    assert tokens[("p:bad",)] == (50, 1.0) and tokens[("p:a", "p:b")] == (40, 1.0) and len(rules) < 10


def test_urls_repeated_rows_and_no_block_label(spark):
    pages = spark.createDataFrame([(1, "http://q.com/x/a"), (1, "http://q.com/x/a"), (None, "http://q.com/x/a")], "page_id long, url string")
    assert [tuple(r)[1:] for r in url_rules.judge(pages).collect()] == [("q.com", "/x/a", None, "allow")] * 3


@needs_data
def test_mined_rules_decide_pages(spark):
    """The labels are the given rules' verdicts; some of the pages that no given rule fits are blocked by what they teach."""
    out = llm.queries()["op10_url_rules"](spark, DATA.replace("sf0.001", "sf0.01")).where("rule is null")
    assert 0 < out.where("verdict = 'block'").count() < out.count()


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    a, rng = words(30, 1), np.random.default_rng(3)
    bench = spark.createDataFrame([(1, " ".join(a))], "item_id long, text string")
    bench.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    body = " ".join(words(200, 2))
    changed = body.split()
    changed[50] = "other"
    texts = [None, "123 456", body, body, " ".join(changed), " ".join(words(60, 4) + a), *[" ".join(words(80, 20 + i)) for i in range(8)]]
    df = docs(spark, texts).withColumn("extra", F.lit(1)).union(docs(spark, texts[-1:]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("extra", F.lit(2)))
    where = f"file://{tmp_path}"
    cols = list(corpus_pipeline.COLUMNS)
    one = corpus_pipeline.language(spark, df, where)
    assert one.columns == cols and {r["doc_id"] for r in one.collect()} == {None, *range(2, 14)}
    two = corpus_pipeline.line_dedup(spark, one, where)
    assert {r["doc_id"] for r in two.collect()} == {None, 2, 5, *range(6, 13)} and two.columns == cols
    three = corpus_pipeline.near_duplicates(spark, df, where)
    assert sorted(r["doc_id"] for r in three.collect()) == [0, 1, 2, *range(5, 14)] and three.columns == cols
    four = corpus_pipeline.decontamination(spark, two, where)
    assert {r["doc_id"] for r in four.collect()} == {None, 2, *range(6, 13)} and four.columns == cols
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), where).count() == 0
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, where).count() == 9



def test_pipeline_removes_short_lines(spark):
    texts = ["short line\n\n\u6f22\u5b57\u304b\u306a\u4ea4\u3058\u308a\u6587\nfirst", "SHORT  line\n\n\u6f22\u5b57\u304b\u306a\u4ea4\u3058\u308a\u6587\nsecond", "first\nsecond"]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs(spark, texts), "").collect()}
    assert got == {0: texts[0], 1: "\nsecond"}


def test_keys_met_again():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    for _ in range(50):
        k = np.sort(rng.integers(0, 12, rng.integers(0, 25)))
        cuts = np.sort(rng.integers(0, len(k) + 1, 4))
        parts = np.split(np.column_stack([k, np.arange(len(k))]), cuts)
        batches = [pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["key", "node"]) for p in parts]
        got = [x for b in simhash._met(iter(batches)) for x in b.column(1).to_pylist()]
        assert got == [i for i, x in enumerate(k) if (k == x).sum() > 1]
