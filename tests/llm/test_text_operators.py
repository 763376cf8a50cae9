"""Every text operator against plain Python on small tables, with odd rows: nulls, empty and long texts, ties, repeats."""

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F

from plumbline.llm import (chat, licenses, packing, quality_gam, quality_rules, simhash, spotsigs, toxicity, unigram, warc)
from plumbline.llm.common import one_text

GOOD = "the house of the old man was on a hill and the road to it was long . "
NEAR = " ".join(f"word{i} runs by" for i in range(200))
ODD = [
    (1, GOOD * 8), (2, None), (3, ""), (4, "   \n\t "), (5, "a"), (6, "a b"), (7, NEAR), (8, NEAR + " end"), (9, NEAR),
    (10, "spam spam " * 60), (11, "BUY!! NOW!! ### $$$ " * 30), (12, "é ü ß 漢字 🙂 <b>&amp;</b>"), (13, "x" * 70_000),
    (14, " ".join(f"w{i}" for i in range(9_000))), (15, "line one\nline one\n\nline two\n  \n"), (None, "no id here"), (1, GOOD * 8),
    (16, "Released under the MIT License. Apache License, Version 2.0; CC BY-NC!"), (17, "under the MIT license under the mit license"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, "clash", 0, 1.0, True, [1]) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, row string, fp bigint, score double, kept boolean, sig array<int>").repartition(3)


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 1, 0), (9, 1, 0), (10, 0, 0), (11, 0, 1), (None, 1, 1), (5, None, None), (1, 1, 0)],
                                 "doc_id bigint, quality int, toxic int")


def rows_of(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)


# ---- quality rules

def base_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_rules_count_like_python(odd, none, labels):
    got = quality_rules.judge(odd, quality_rules.trusted_ids(labels))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(got, "doc_id", *cols) == sorted([(i, *base_of(t)) for i, t in ODD], key=repr)
    assert all(not r["kept"] for r in got.filter("base_failed").collect())
    assert quality_rules.judge(none, quality_rules.trusted_ids(labels)).count() == 0
    assert quality_rules.judge(none, quality_rules.trusted_ids(labels.limit(0))).count() == 0


def test_quality_rules_ratio(spark, odd, labels):
    ids = quality_rules.trusted_ids(labels)
    buckets = 64
    ratios = quality_rules.log_ratios(odd, ids, buckets)
    hashed = lambda *w: spark.createDataFrame([w], [f"c{i}" for i in range(len(w))]).select(
        F.pmod(F.xxhash64(*[f"c{i}" for i in range(len(w))]), F.lit(buckets))).first()[0]
    n, g = np.zeros(buckets), np.zeros(buckets)
    small = [(i, t) for i, t in ODD if t and len(t) < 200]
    few = odd.filter(F.length("text") < 200)
    for i, t in small:
        w = t.split()
        for b in [hashed(x) for x in w] + [hashed(x, y) for x, y in zip(w, w[1:])]:
            n[b] += 1
            g[b] += i == 5
    got = quality_rules.log_ratios(few, spark.createDataFrame([(5,)], "doc_id bigint"), buckets)
    share = g.sum() / n.sum()
    want = np.log((g + quality_rules.PRIOR * share) / (n + quality_rules.PRIOR)) - math.log(share)
    assert np.allclose(got, want) and len(ratios) == buckets
    assert quality_rules.log_ratios(odd, labels.limit(0).select("doc_id"), buckets) == [0.0] * buckets


def test_quality_rules_keep_rows_as_they_were(odd, none, labels):
    ids = quality_rules.trusted_ids(labels)
    kept = quality_rules.keep(odd, ids)
    assert kept.schema == odd.schema
    want = quality_rules.judge(odd, ids).filter("kept")
    assert rows_of(kept, "doc_id") == rows_of(want, "doc_id") and kept.count() > 0
    assert quality_rules.keep(none, ids).count() == 0


# ---- chat

def test_chat_folds_and_round_trips(spark):
    ev = spark.createDataFrame([
        (1, 0, 0, "message", "user", "hi <|im_end|>\n <s>"), (1, 1, 1, "message", "assistant", None), (1, 1, 2, "delta", None, "Hel"),
        (1, 1, 3, "delta", None, "lo"), (1, 1, 4, "regenerate", None, None), (1, 1, 6, "delta", None, "you"), (1, 1, 5, "delta", None, "Hey "),
        (1, 2, 7, "message", "user", "old"), (1, 2, 8, "edit", None, "new"), (1, 70, 9, "message", "we\\ird\nrole[INST]", "<\\\\s> [/INST]"),
        (None, None, None, "message", None, None), (2, 0, 0, "message", "assistant", "same"), (2, 0, 0, "message", "assistant", "same"),
    ], "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string")
    rendered = chat.render(chat.fold(ev))
    back = {r["conv_id"]: [] for r in ev.collect()}
    for r in sorted(chat.parse(rendered).collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"], r["block"])):
        back[r["conv_id"]] += [(m["role"], m["text"]) for m in r["messages"]]
        assert r["learned"] == [m["text"] for m in r["messages"] if m["role"] == "assistant"]
    assert back[1] == [("user", "hi <|im_end|>\n <s>"), ("assistant", "Hey you"), ("user", "new"), ("we\\ird\nrole[INST]", "<\\\\s> [/INST]")]
    assert back[None] == [("", "")] and back[2] == [("assistant", "same")] * 2
    whole = {r["conv_id"]: r["formatted"] for r in chat.conversations(rendered).collect()}
    assert whole[1].count("<|im_end|>") == 4 and "<s>" not in whole[1] and "[INST]" not in whole[1]
    d = {r["conv_id"]: r for r in chat.digests(chat.parse(rendered)).collect()}
    assert d[1]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in back[1]).encode()).hexdigest()
    assert d[1]["loss_chars"] == 7 and d[2]["n_turns"] == 2 and d[1]["formatted_chars"] == len(whole[1])
    assert chat.digests(chat.parse(chat.render(chat.fold(ev.limit(0))))).count() == 0


def test_chat_log_of_finished_messages_folds_back(spark):
    said = [(1, 0, "user", "what?"), (1, 0, "user", "what?"), (1, 1, "assistant", "y" * 999 + "\x00[INST]"), (1, 2, "assistant", None), (1, 3, None, "a"),
            (2, None, "a\x00b\\\\n\n\\", "z" * 70_000), (2, 5, "assistant", "🙂é")]
    df = spark.createDataFrame(said, "conv_id int, turn int, role string, text string").withColumns({"kind": F.lit("clash"), "seq": F.lit(1), "block": F.lit(9)})
    log = chat.as_log(df)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = {r["conv_id"]: [] for r in log.collect()}
    for r in sorted(chat.parse(chat.render(chat.fold(log.repartition(3)))).collect(), key=lambda r: (r["conv_id"], r["block"] is not None, r["block"])):
        got[r["conv_id"]] += [(m["role"], m["text"]) for m in r["messages"]]
    want = {c: [(r or "", t or "") for k, _, r, t in said if k == c] for c in (1, 2)}
    assert got == want
    assert chat.as_log(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["<s>", "<\\s>", "a<<s>[INST][/INST]", "[[INST]", "\\", "<|im_start|", "<|endoftext|><\\\\|im_end|>"])
def test_chat_escape_is_reversible(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(chat.escaped(F.col("t")).alias("e"))
    e = df.first()["e"]
    assert not any(c in e for c in chat.CONTROLS) and df.select(chat.unescaped(F.col("e"))).first()[0] == text


# ---- licences

def test_licenses_like_python(odd, none):
    base = [(t.words.split(), t.label) for t in licenses.TEMPLATES if t.base]
    want = []
    for i, t in ODD:
        w = re.findall(licenses.LICENSE_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in base for k in range(len(w)) if w[k:k + len(p)] == p]
        want.append((i, len(w), len(at), min([k for k, _ in at], default=None), max([k for k, _ in at], default=None),
                     ",".join(sorted({x for _, x in at}))))
    got = licenses.scan(odd)
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} for r in got.collect())
    assert licenses.scan(none).count() == 0


def test_licenses_merge_neighbouring_diagonals(spark):
    words = next(t.words for t in licenses.TEMPLATES if t.label == "bsd").split()
    edited = [*words[:6], "very", "much", *words[6:14], *words[15:]]
    rows = [(1, "x y " + " ".join(edited) + " z"), (2, " ".join(words[:6])), (3, " ".join(words))]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1]["labels"] == "bsd" and 0.6 <= got[1]["score"] < 1 and got[2]["labels"] == "" and got[3]["score"] == 1


def test_licenses_in_long_islands(spark):
    isc = next(t.words for t in licenses.TEMPLATES if t.label == "isc")
    bsd = next(t.words for t in licenses.TEMPLATES if t.label == "bsd")
    rows = [(1, isc), (2, "permission to use x " * 20 + isc), (3, isc + " permission to use x" * 300), (4, "permission to use x " * 40),
            (5, " ".join([bsd] * 5)), (6, "İ " + bsd.upper())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs).collect()}
    assert got == {1: ("isc", 1), 2: ("isc", 1), 3: ("isc", 1), 4: ("", 0), 5: ("bsd", 1), 6: ("bsd", 1)}
    n = len(bsd.split())
    places = sorted((r["start"], r["end"]) for r in licenses.places(docs).filter("doc_id = 5").collect())
    assert places == [(k * n, (k + 1) * n) for k in range(5)]


# ---- simhash

def print_of(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes_of(prints):
    """Smallest id that is reachable over links of at most 3 bits, by comparing all pairs."""
    left, comp = list(range(len(prints))), {}
    for a, (_, p) in enumerate(prints):
        for b in range(a):
            if (p ^ prints[b][1]).bit_count() <= 3:
                old, new = left[a], left[b]
                left = [new if x == old else x for x in left]
    for (i, _), c in zip(prints, left):
        comp[c] = min([x for x in (comp.get(c), i) if x is not None], default=None)
    return [comp[c] for c in left]


def test_simhash_like_python(odd, none):
    want = [(i, print_of(t)) for i, t in ODD]
    firsts = classes_of(want)
    got = rows_of(simhash.components(odd), "doc_id", "fingerprint", "component_id")
    assert got == sorted([(i, f"{p:016x}", c) for (i, p), c in zip(want, firsts)], key=repr)
    kept = simhash.keep_one(odd)
    assert kept.schema == odd.schema and kept.count() == len({c for c in firsts})
    assert simhash.components(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("limit", [20_000, 8])
def test_simhash_trie_join_finds_all_links(spark, limit):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    many = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for c in centre for _ in range(40)]
    many += [int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64)] + [0, 1, (1 << 64) - 1, (1 << 64) - 8]
    fps = sorted(set(many))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    roots = {r["node"] % (1 << 64): r["root"] for r in simhash.connected(simhash.links(df, limit)).collect()}
    want = classes_of(list(enumerate(fps)))
    size = Counter(want)
    assert set(roots) == {x for x, c in zip(fps, want) if size[c] > 1}
    groups = defaultdict(set)
    for x, c in zip(fps, want):
        groups[c].add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


# ---- classifiers

def test_repeats_of_an_id_are_one_training_row(spark):
    rows = spark.range(5_000).selectExpr("id % 2 AS doc_id", "concat('text ', id) AS text", "1 AS y")
    got = one_text(rows, "doc_id", "y").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(0, "text 0"), (1, "text 1")]


def test_gam_learns_tables_and_pairs():
    rng = np.random.default_rng(0)
    x = np.zeros((3000, len(quality_gam.FEATURES)))
    x[:, :3] = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) | (x[:, 2] > 0.9)
    m = quality_gam.fit(x[:2000], y[:2000].astype(float))
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9 and (0, 1) in [p[:2] for p in m.pairs]
    # A score is the sum of its table entries.
    z = m.base + sum(t[np.searchsorted(e, x[0, j], side="right")] for j, (e, t) in enumerate(zip(m.edges, m.tables)))
    low = [np.searchsorted(e, x[0, j], side="right") for j, e in enumerate(m.coarse)]
    assert m.margin(x[:1])[0] == pytest.approx(z + sum(t[low[a], low[b]] for a, b, t in m.pairs))


def test_classifiers_on_odd_rows(odd, none, labels):
    for op, modulus, rest, limit in ((quality_gam, 4, 2, 0.7), (toxicity, 5, 0, 0.5)):
        got = op.score(odd, labels).collect()
        assert len(got) == len(ODD)
        for r in got:
            held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest
            assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)
        assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
        assert op.score(none, labels).count() == 0
        alone = {r["score"] for r in op.score(odd, labels.limit(0)).collect()}
        assert alone == ({1.0} if op is quality_gam else {0.0})
    kept = quality_gam.keep(odd, labels.limit(0))
    assert kept.schema == odd.schema and kept.count() == len(ODD) and quality_gam.keep(none, labels).count() == 0


def test_toxicity_risk_separates(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"word{i:04d}" for i in range(800)]
    text = lambda bad: " ".join([*rng.choice(vocabulary, 40), *(["scumbag", "vermin"] if bad else [])])
    bad = rng.random(900) < 0.2
    rows = [(i, text(b)) for i, b in enumerate(bad)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad) if i % 2], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, marks).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == bad[i] for i in held]) > 0.97
    # Words are hashed from their own bytes, wherever they stand.
    assert set(toxicity.buckets("vermin")) <= set(toxicity.buckets("a b, vermin!"))
    assert len(toxicity.buckets("")) == 0 and max(Counter(toxicity.buckets("no " * 50).tolist()).values()) == toxicity.REPEATS


# ---- packing

def test_packing_is_best_fit_decreasing(odd, none):
    path = tokenizer_path("byte_bpe_50k.json")
    got = packing.pack_documents(odd, path).collect()
    places, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], bytes(r["ids"]), r["ids_crc32"]))
    for p in places.values():
        p.sort()
        assert [a for a, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 1024
    gaps, used = [], 0
    for n in sorted((r["length"] for r in got), reverse=True):
        at = bisect.bisect_left(gaps, n)
        used += at == len(gaps)
        rest = (gaps.pop(at) if at < len(gaps) else 1024) - n
        bisect.insort(gaps, rest)
    assert len(places) == used
    whole = packing._encoder(path).full
    for i, t in dict(ODD).items():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        parts = sorted(by_doc[i])[:: 2 if i == 1 else 1]
        assert b"".join(p[3] for p in parts) == ids and all(p[4] == zlib.crc32(p[3]) for p in parts)
        assert [p[2] for p in parts[1:]] == [1024] * (len(parts) - 1)
    assert packing.pack_documents(none, path).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n\nb", "a \n b", "x<|endoftext|> y", "a\tb c", "it's we're", "a b c d", "\n", "q w\te"])
def test_packing_encodes_like_the_tokenizer(text):
    e = packing._encoder(tokenizer_path("byte_bpe_50k.json"))
    assert np.frombuffer(e.ids(text), "<u4").tolist() == e.full.encode(text, add_special_tokens=False).ids


def test_packing_ranks_with_many_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 50)
    df = spark.createDataFrame([(i, 5 if i % 3 else 7 + i % 9) for i in range(1000)], "doc_id bigint, length bigint")
    got = packing.pack(df, ["doc_id"], 16).collect()
    full = defaultdict(list)
    for r in got:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(got) == 1000 and all(sum(n for _, n in p) <= 16 and [a for a, _ in sorted(p)] == [
        sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] for p in full.values())


# ---- sentencepiece

def test_unigram_is_the_best_path_and_decodes(spark, odd, none):
    path = tokenizer_path("piece_bpe_32k.model")
    m = unigram.load(path)
    known = {p: s for p, s, kind in m.pieces if kind == unigram.NORMAL}

    def best(text):
        top = [0.0] + [-np.inf] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - m.longest), j):
                s = known.get(text[i:j], m.unknown if j == i + 1 else -np.inf)
                top[j] = max(top[j], top[i] + s)
        return top[-1]

    for t in ["the house", "  two  gaps ", "héllo 漢字 🙂", "tab\tand\nline", "a" * 100, GOOD]:
        ids = np.frombuffer(m.encode([t])[0], "<u4")
        lost = bytes(int(m.pieces[i][0][3:5], 16) for i in ids if m.is_byte[i]).decode()
        total = sum(m.scores[i] for i in ids if not m.is_byte[i]) + len(lost) * m.unknown
        assert total == pytest.approx(best((" " + t).replace(" ", unigram.MARK))) and m.decode(m.encode([t])[0]) == t
    got = unigram.encode(odd, path)
    assert got.filter("decoded_ok").count() == len(ODD) and unigram.encode(none, path).count() == 0
    assert rows_of(unigram.decode(got, path), "doc_id", "text") == sorted([(i, t or "") for i, t in ODD], key=repr)
    assert m.encode([unigram.MARK + "x"]) == m.encode([" x"])


def test_double_array_finds_exactly_its_keys():
    keys = [b"a", b"ab", b"abc", b"b", b"bcd", bytes([255, 0]), bytes(range(40))]
    trie = unigram.DoubleArray([(k, i) for i, k in enumerate(keys)])

    def find(key):
        node = np.zeros(1, np.int32)
        for c in key:
            node = trie.step(node, np.array([c]))
            if node[0] < 0:
                return -1
        return int(trie.value[node[0]])

    assert [find(k) for k in keys] == list(range(len(keys))) and find(b"bc") == find(b"x") == find(b"abcd") == -1


# ---- spotsigs

def test_spotsigs_like_python(odd, none, spark):
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()))
    got = spotsigs.compare_edited(odd)
    assert rows_of(got, "doc_id", "n_chars", "edited_sha256") == sorted(want, key=repr)
    prints, by_id = defaultdict(set), dict(ODD)
    for r in got.collect():
        prints[by_id[r["doc_id"]] or ""].add(r["fingerprint"])
        a, b = (set(r[c].split()) for c in ("fingerprint", "edited_fingerprint"))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert all(len(p) == 1 for p in prints.values())
    assert spotsigs.compare_edited(none).count() == 0
    assert spotsigs.compare_edited(odd.filter("doc_id = 12")).first()["near_next"] == 1.0


def test_spotsigs_near_pairs(spark):
    words = [f"w{i}" for i in range(400)]
    line = " the ".join(words)
    rows = [(1, line), (2, line.replace("w7 ", "v7 ")), (3, line), (4, " the ".join(words[:150])), (5, "of nothing"), (6, None), (7, None)]
    pairs, member = spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id bigint, text string"))
    cls = {r["doc_id"]: r["class"] for r in member.collect()}
    assert cls[1] == cls[3] and cls[6] == cls[7]
    assert [{r["a"], r["b"]} for r in pairs.collect()] == [{cls[1], cls[2]}]


# ---- warc

def test_warc_records_round_trip(spark, tmp_path):
    html = ('<html lang="en"><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x --><script>if(a<b){"</p>"}</script>'
            '<p>One<br>two &lt;3</p><a href="/x?a=1&amp;b=2">link</a></body></html>')
    pages = spark.createDataFrame([(1, "http://e.org/a", html), (2, None, None), (None, "u", ""), (1, "http://e.org/a", html)],
                                  "page_id bigint, url string, html string").withColumn("type", F.lit("clash"))
    source = warc.responses(pages)
    made = warc.derivatives(source)
    rows = {(r["page_id"], r["type"]): r for r in made.collect()}
    origin = {r["page_id"]: r for r in source.collect()}
    assert made.count() == 8
    text, facts = rows[1, "conversion"], rows[1, "metadata"]
    assert text["block"] == "One\ntwo <3\nlink" and "title: A & B\r\nlanguage: en\r\n" in facts["block"] and "outlink: /x?a=1&b=2" in facts["block"]
    assert text["refers_to"] == facts["refers_to"] == origin[1]["record_id"] and text["record_id"] != facts["record_id"]
    assert text["source_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest() and text["source_headers"] == origin[1]["headers"]
    assert text["block_digest"] == "sha256:" + hashlib.sha256(text["block"].encode()).hexdigest()
    assert rows[2, "conversion"]["block"] == "" and rows[None, "conversion"]["content_length"] == 0
    warc.write(made.repartition(2), str(tmp_path / "w"))
    back = warc.read_records(spark, str(tmp_path / "w"))
    assert rows_of(back, *back.columns) == rows_of(made, *back.columns)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_line_ends_stay_in_their_field(spark, tmp_path):
    url = "http://e.org/a\r\nWARC-Type: response"
    html = '<html lang="en\r\ntitle: x"><body><a href="/y\r\ntitle: false">z</a>' + "long text " * 50_000 + "</body></html>"
    pages = spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string")
    made = warc.derivatives(warc.responses(pages))
    warc.write(made, str(tmp_path / "w"))
    back = {r["type"]: r for r in warc.read_records(spark, str(tmp_path / "w")).collect()}
    assert len(back) == 2 and {r["target_uri"] for r in back.values()} == {"http://e.org/a%0D%0AWARC-Type: response"}
    fields = [f.split(": ", 1) for f in back["metadata"]["block"].split("\r\n") if f]
    assert [n for n, _ in fields] == ["title", "language", "source-digest", "outlink"] and dict(fields)["outlink"] == "/y%0D%0Atitle: false"
    assert back["conversion"]["content_length"] == len(back["conversion"]["block"]) > 490_000
