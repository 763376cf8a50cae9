"""Resampling, the Merkle manifest and SetSketch links against plain Python, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.functions.positions import numbered
from plumbline.llm import merkle, resampling, setsketch

NEAR = " ".join(f"word{i} runs by" for i in range(200))
ODD = [
    (1, "the house of the old man was on a hill and the road to it was long . " * 8), (2, None), (3, ""), (4, "   \n\t "), (5, "a"), (6, "a b C"),
    (7, NEAR), (8, NEAR + " end"), (9, NEAR), (10, "spam spam " * 60), (12, "é ü ß 漢字 🙂 <b>&amp;</b>"), (13, "x" * 70_000),
    (14, " ".join(f"w{i % 5000}" for i in range(9_000))), (None, "no id here"), (1, "the house of the old man was on a hill and the road to it was long . " * 8),
    (17, "A b c"), (21, "\n".join(f"line {i} of the Old text" for i in range(30))), (22, "  a  b\tc "),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ("x", None, "", "ö")[k % 4], None if k % 3 else "s", None if k == 2 else k, 0.5, True, 9, "c") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, "
                                       "position bigint, root string").repartition(3)


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def got_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rows_are_numbered_in_order(spark):
    df = spark.createDataFrame([(g, i * 7 % 50) for i in range(50) for g in (None, "a")] + [("b", 3)], "g string, k int").repartition(5)
    for r in numbered(df, ["g"], [F.col("k")]).collect():
        assert r["position"] == (0 if r["g"] == "b" else r["k"])
    assert sorted(r["position"] for r in numbered(df, [], [F.col("k").desc(), F.col("g")]).collect()) == list(range(101))


# ---- resampling

def features(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    return len(w), [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(docs, target, percent, min_words):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    raw, wanted = Counter(), Counter()
    for _, t in docs:
        raw.update(map(bucket, features(t)[1]))
    for t in target:
        wanted.update(map(bucket, features(t)[1]))
    s, t = sum(raw.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000))))
    rows = []
    for i, text in docs:
        n, found = features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(fit[:percent * len(fit) // 100])}
    return sorted([(r[0], r[2], r[3], r[4], drawn.get(id(r))) for r in rows], key=repr)


def test_resampling_like_python(spark, odd, none):
    texts = ["The old house, the old road", "漢字 🙂 word7 runs by", None, ""]
    target = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    got = resampling.resample(odd, target, percent=60, min_words=3)
    want = resampled(ODD, texts, 60, 3)
    assert got_rows(got) == want and sum(r[4] is not None for r in want) > 3
    assert all(r["rank"] is None for r in resampling.resample(odd, target, percent=1).collect())
    assert got_rows(resampling.resample(odd, target.limit(0), percent=60, min_words=3)) == resampled(ODD, [], 60, 3)
    assert resampling.resample(none, target).count() == 0


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_features_do_not_depend_on_pieces(size):
    texts = [t.encode() for _, t in ODD if t and len(t) < 10_000] + [b"", b"a", b" b ", b"Q" * 50]
    gain = np.arange(resampling.BUCKETS)
    whole = next(resampling.pieces(texts, 1 << 24))
    want = resampling.Interned(whole).sums(gain, len(texts))
    got = [np.zeros(len(texts), np.int64) for _ in range(3)]
    for batch in resampling.pieces(texts, size):
        for a, b in zip(got, resampling.Interned(batch).sums(gain, len(texts))):
            a += b
    assert all((a == b).all() for a, b in zip(got, want))
    assert want[1].tolist() == [len(features(t.decode())[1]) for t in texts]


def test_hashes_of_many_runs():
    rng = np.random.default_rng(0)
    data = rng.bytes(4_000)
    start, length = rng.integers(0, 3_000, 3_000), rng.integers(0, 300, 3_000) * rng.integers(0, 2, 3_000) + rng.integers(0, 40, 3_000)
    assert (resampling.xxh64(data, start, length) == [xxhash.xxh64_intdigest(data[a:a + n]) for a, n in zip(start, length)]).all()
    heads, tails = [data[a:a + 5] for a in start], [data[a:a + n] for a, n in zip(start, length)]
    crc = lambda parts: np.array([zlib.crc32(p) for p in parts], np.uint32)
    assert (resampling.crc_append(crc(heads), crc(tails), length) == crc([a + b for a, b in zip(heads, tails)])).all()


def test_interning_separates_equal_keys():
    values = np.array([1, 2, 1, 3, 2, 1] * 50)
    slot, owner = resampling.intern(np.zeros(300, np.uint64), lambda a, b: values[a] == values[b])
    assert [len(set(slot[values == v])) for v in (1, 2, 3)] == [1, 1, 1] and len(set(slot)) == 3 == (owner >= 0).sum()


# ---- merkle

def proven(rows):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda r: digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(paths):
                o = at[i] ^ 1
                p.append((o & 1, nodes[o]) if o < len(nodes) else None)
                at[i] //= 2
            nodes = [digest("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
        return nodes[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    subroots, inner = [], []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = tree([leaf(r) for r in own])
        subroots.append(root)
        inner.append(list(zip(own, paths)))
    root, tops = tree(subroots)
    out = []
    for k, some in enumerate(inner):
        for r, path in some:
            path = path + tops[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for s in path:
                h = digest(h) if s is None else digest(h + s[1]) if s[0] else digest(s[1] + h)
            out.append((r[0], leaf(r), subroots[k], root, digest("".join(s[1] for s in path if s)), h, h == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [12, 1])
def test_manifest_like_python(odd, none, height):
    rows = [tuple(r) for r in odd.select(*merkle.FIELDS).collect()]
    want = proven(rows)
    assert got_rows(merkle.manifest(odd, height)) == want and 0 < sum(r[-1] for r in want) < len(want)
    assert merkle.manifest(none, height).count() == 0
    one = odd.filter("doc_id = 5")
    assert merkle.manifest(one, height).first()["root"] == merkle.manifest(one, height).first()["leaf"]


def test_manifest_of_several_tiers(spark):
    rows = [(i * 3 - 50, "s", f"l{i % 37}" if i % 2 else "big", i, f"t{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert got_rows(merkle.manifest(docs, 2)) == proven(rows)


@pytest.mark.parametrize("height", [0, 1, 2, 5, 8])
def test_van_emde_boas_order_is_a_layout(height):
    places = [merkle.address(d, np.arange(1 << d), height) for d in range(height + 1)]
    assert sorted(np.concatenate(places)) == list(range((2 << height) - 1)) and places[0][0] == 0
    if height == 5:     # 6 levels: 3 on top, then eight subtrees of 3 levels, each in one run
        for i in range(8):
            run = [merkle.address(3 + d, np.arange(i << d, (i + 1) << d), 5) for d in range(3)]
            assert sorted(np.concatenate(run)) == list(range(7 + 7 * i, 14 + 7 * i))


# ---- setsketch

def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
    return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def linked(docs):
    sets = [shingles(t) for _, t in docs]
    comp = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    least = {}
    for (i, _), c in zip(docs, comp):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return sorted([(i, len(s), least[c], None if i is None or least[c] is None else i == least[c]) for (i, _), s, c in zip(docs, sets, comp)], key=repr)


def test_near_duplicates_like_python(odd, none):
    assert got_rows(setsketch.components(odd)) == linked(ODD)
    assert setsketch.components(none).count() == 0


@pytest.mark.parametrize("small,block", [(32, 1000), (3, 1000), (3, 5)])
def test_near_duplicates_in_large_buckets(spark, monkeypatch, small, block):
    """Groups whose members are mostly not linked with the least one, and texts that share a passage but are not alike."""
    monkeypatch.setattr(setsketch, "SMALL", small)
    monkeypatch.setattr(setsketch, "BLOCK", block)
    rng = np.random.default_rng(5)
    docs = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(60)]
        for k in range(25):
            some = list(base)
            for at in rng.choice(60, int(rng.integers(0, 4)), replace=False):
                some[at] = f"other{rng.integers(1000)}"
            docs.append((len(docs), " ".join(some)))
    passage = " ".join(f"p{i}" for i in range(50))
    docs += [(1000 + k, passage + " " + " ".join(f"own{k}x{i}" for i in range(int(rng.integers(5, 30))))) for k in range(40)]
    want = linked(docs)
    assert 8 < len({r[2] for r in want}) < len(docs)
    assert got_rows(setsketch.components(spark.createDataFrame(docs, "doc_id bigint, text string"))) == want


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 4_000, dtype=np.uint64)
    for share in (0.3, 0.8):
        both = int(2_000 * share * 2 / (1 + share))
        a, b = pool[:2_000], pool[2_000 - both:4_000 - both]
        ra, rb = setsketch.registers(a), setsketch.registers(b)
        assert (np.maximum(ra, rb) == setsketch.registers(np.union1d(a, b))).all()
        est, may = setsketch.estimate(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([2e3]), np.array([2e3]))
        assert abs(est[0] - share) < 0.16 and may[0] == (share == 0.8)
    buckets = defaultdict(set)
    for x in range(200):
        buckets[setsketch.registers(pool[x:x + 1]).tobytes()].add(x)
    assert len(buckets) == 200
