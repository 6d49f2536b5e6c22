"""Spelling variants, decontamination and hard negatives against plain versions."""
from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from statproof.llm import best_first, decontaminate, rtree, spelling
from tests.llm.test_operators import SCHEMA, awkward_texts


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Spelling variants

def brute_variants(rows, every=97, shortest=5, least=3):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= shortest and n >= least}

    def close(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    near = {w: [o for o in words if close(w, o)] for w in words}
    best = {w: min(ns, key=lambda x: (-words[x], x)) for w, ns in near.items() if ns}
    form = {w: b for w, b in best.items() if words[b] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def spelled(rng):
    bases = ["colour", "colours", "color", "organise", "organize", "été" * 2, "naïveté", "ÀÉÎÕÜß", "aaaaa", "aaaaaa", "aaaaaaa", "abcde" * 9, "abcde" * 8 + "abcdf", "x" * 4000, "x" * 4001]
    words = []
    for i, base in enumerate(bases):
        words += [base] * rng.choice((3, 6, 13, 30))
        for _ in range(12):
            at = rng.randrange(len(base))
            words += [rng.choice((base[:at] + base[at + 1:], base[:at] + rng.choice("abcé") + base[at:], base[:at] + rng.choice("abcé") + base[at + 1:]))] * rng.choice((1, 3, 7))
    rng.shuffle(words)
    return [(i, rng.choice((" ", "1", "×-", "\n")).join(w.title() if rng.random() < .2 else w for w in words[i::40])) for i in range(40)]


def test_variants(spark):
    rows = spelled(random.Random(3)) + [(None, None), (41, ""), (41, ""), (None, "Colour colour"), (None, "Colour colour"), (42, "été×été÷etéé")]
    df = spark.createDataFrame([(k, t, "en", "s", 1, "r", "k", 1) for k, t in rows], SCHEMA).repartition(3)
    assert {tuple(r) for r in spelling.variants(df, every=97).collect()} == brute_variants(rows)
    assert {tuple(r) for r in spelling.variants(df, shortest=1, least=1).collect()} == brute_variants(rows, 0, 1, 1)
    assert spelling.variants(df.where("false")).count() == 0


@pytest.mark.parametrize("shard,states,wide", [(2, 4, 3), (5, 1 << 18, 32), (1 << 15, 16, 32)])
def test_small_shards_find_the_same_words(spark, monkeypatch, shard, states, wide):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(150)})
    expected = {(a, b) for a in words for b in words if spelling.one_edit(a, b)}
    for name, value in (("SHARD", shard), ("ASKS", max(1, shard // 3)), ("STATES", states), ("WIDE", wide)):
        monkeypatch.setattr(spelling, name, value)
    found = set()
    trie = spelling.Trie(words)
    for a, b in trie.search(words):
        found |= {(a, b), (b, a)}
    assert found == expected
    assert {tuple(r) for r in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()} == expected


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "Alpha béta-" * 500 + "y" * 300
    whole = list(spelling._runs(text))
    monkeypatch.setattr(spelling, "PIECE", 7)
    assert list(spelling._runs(text)) == whole


# Decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_decontaminate(rows, items, width=10, near=20):
    tokens = [(k, WORD.findall(ascii_lower(t))) for k, t in rows]
    often = Counter(w for _, ws in tokens for w in ws)
    out = []
    for key, words in tokens:
        hit, found, close = set(), set(), set()
        for item, text in items:
            wanted = WORD.findall(ascii_lower(text))
            n = min(width, len(wanted))
            for s in range(len(wanted) - n + 1 if n else 0):
                for at in range(len(words) - n + 1):
                    if words[at:at + n] == wanted[s:s + n]:
                        hit |= set(range(at, at + n))
                        found.add(item)
            rare = sorted({w for w in wanted if often[w]}, key=lambda w: (often[w], w))[:3]
            if len(rare) > 1 and any(set(rare) <= set(words[at:at + near]) for at in range(len(words))):
                close.add(item)
        found.discard(None)
        close.discard(None)
        ids = ",".join(sorted(map(str, found)))
        out.append((key, len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit), len(close)))
    return sorted(out, key=str)


def test_decontamination(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["ΑΣ", "Straße", "İx", "7"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (3, 9, 10, 11, 35, 60)]
    items = list(enumerate(passages)) + [(6, None), (7, ""), (8, "!?"), (9, "word"), (10, "a " * 30), (None, passages[4]), (11, passages[3]), (11, passages[5]), (12, "Never seen-anywhere " * 6)]
    rows = list(enumerate(awkward_texts()))
    for i in range(100, 140):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))
        p = rng.choice(passages).split()
        at = rng.randint(0, len(p))
        text += " " + rng.choice((" ".join(p), " ".join(p[at:]), " ".join(p[:at]), ", ".join(p).upper() if "ß" not in "".join(p) else " ".join(p), " ".join(rng.sample(p, len(p)))))
        rows.append((i, text + rng.choice(("", " word", " a" * 12, " ΑΣ'x"))))
    rows += [(7, passages[5]), (7, passages[5]), (None, passages[4]), (None, None)]
    df = spark.createDataFrame([(k, t, "en", "s", 1, "r", "k", 1) for k, t in rows], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(k, t, 1, 2) for k, t in items], "item_id long, text string, pos int, term int")
    found = sorted((tuple(r) for r in decontaminate.decontaminate(df, bench).collect()), key=str)
    expected = brute_decontaminate(rows, items)
    assert found == expected
    assert sum(r[5] for r in found) > 20 and sum(r[6] for r in found) > 10
    assert decontaminate.decontaminate(df.where("false"), bench).count() == 0
    clean = decontaminate.decontaminate(df, bench.where("false")).collect()
    assert len(clean) == len(rows) and not any(r.contaminated or r.n_items or r.n_near for r in clean)


# Hard negatives

def brute_negatives(rows, every=50):
    rows = [(i, k, np.floor(256 * np.array(v, float)), label) for i, (k, v, label) in enumerate(rows)]
    out = []
    for i, anchor, vector, label in rows:
        if anchor % every:
            continue
        scored = sorted(((-int(vector @ v), k, j, lab) for j, k, v, lab in rows if j != i and len(v) == len(vector)))
        for score, positive, _, _ in [x for x in scored if x[3] == label][:5]:
            wanted = [x for x in scored if x[3] != label and 50 * -score <= 100 * -x[0] <= 95 * -score][:3]
            out += [(anchor, positive, rank, x[1], -score, -x[0]) for rank, x in enumerate(wanted, 1)]
    return sorted(out)


@pytest.mark.parametrize("page,block,first,stream", [(1024, 128, 4, 256), (16, 3, 1, 2)])
def test_hard_negatives(spark, monkeypatch, page, block, first, stream):
    for name, value in (("FIRST", first), ("STREAM", stream), ("BLOCK", block)):
        monkeypatch.setattr(best_first, name, value)
    monkeypatch.setattr(rtree, "LEAF", 4 if page == 16 else 64)
    rng = np.random.default_rng(2)
    good = [(10 * i, rng.normal(size=6).tolist(), int(rng.integers(0, 4))) for i in range(200)]
    good += [(5 * i + 1, [0.25, -0.5, 0.25, 0.125, 0.0, 1.0], i % 3) for i in range(90)]  # one vector in a third of the rows
    good += [(3000 + 25 * i, rng.normal(size=3).tolist(), i % 2) for i in range(30)]  # another length
    good += [good[0], good[0], (0, [0.0] * 6, 1), (50, [-1.0] * 6, 2)]  # repeated rows and keys
    bad = [(5000, None, 1), (5050, [1.0, None] * 3, 1), (5100, [float("nan")] * 6, 1), (5150, [float("inf")] * 6, 1), (5200, [1.0] * 6, None), (None, [1.0] * 6, 1), (5250, [], 1)]
    df = spark.createDataFrame([(k, v, lab, 1, "x") for k, v, lab in good + bad], "vec_id long, embedding array<double>, label int, score int, query string").repartition(3)
    assert sorted(tuple(r) for r in rtree.mine(df, page=page).collect()) == brute_negatives(good)
    assert rtree.mine(df.where("false")).count() == 0


def test_box_bounds_hold():
    rng = np.random.default_rng(5)
    vectors, queries = rng.integers(-9, 9, (50, 7)).astype(float), rng.integers(-9, 9, (20, 7)).astype(float)
    upper, lower = rtree.Box.bounds(queries, rtree.Box.of(vectors)[None])
    scores = queries @ vectors.T
    assert (scores <= upper).all() and (scores >= lower).all()
    halves = np.stack([rtree.Box.of(vectors[:20]), rtree.Box.of(vectors[20:])])
    assert (rtree.Box.union(None, halves) == rtree.Box.of(vectors)).all()
