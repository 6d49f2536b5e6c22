"""Each operator on a small table of awkward rows, against a plain version of its contract."""
from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statproof.llm import best_first, exact_dedup, language_id, licenses, metric_tree, near_dup, packing, pii, piece_codec, sharding, suffix_dedup
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, kept string, `a.b` int"


def path(name):
    import public_tokenizers
    return public_tokenizers.path(name)


def awkward_texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(150), prose(40)
    near = base.split()
    near[70] = "changed"
    texts = [None, "", "   ", None, "x", "!?", "é ß 日本語 🧿", base, base, base.replace(" ", "\n", 3), " ".join(near), prose(3) + " " + passage + " " + prose(20),
             prose(30) + " " + passage, passage, "a" * 3000, "ab " * 900, prose(9000), prose(4500) + "  " + " " * 40 + "end ", "y" * 99, "y" * 101,
             "Licensed under CC BY-NC 4.0. All RIGHTS reserved. cc, by", "the GNU General Public\nLicense; the general public license",
             "Released under the MIT License.", "mail a.b@c.example.com_x@d.org and a@b, 1.2.3.4.5 300.1.1.1 4337166598464399 4337 1665-9846 4399 x",
             "call +1 (988) 555-2485 or 988-555-2485; ssn 123-45-6789 id 12 " + "9" * 5000, "+" + "1" * 4000, "<s> </s> <|endoftext|> ▁ <0x0A>\t\r\n tab", "Ünïcode's don't İI ﬁ"]
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = awkward_texts()
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    langs = ["en", "fr", None]
    return spark.createDataFrame([(i, t, langs[i % 3], "src", None, "r", "k", 1) for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def ties(spark):
    """Repeated rows, null keys and one key with two texts."""
    text = "one two three four five six seven eight nine ten " * 4
    data = [(7, text), (7, text), (None, text), (None, "other words of a null key"), (7, "another text"), (3, None), (3, None)]
    return spark.createDataFrame([(k, t, "en", None, 1, None, None, None) for k, t in data], SCHEMA)


OPERATORS = {
    "pieces": lambda df: piece_codec.encode_table(df, path("piece_bpe_32k.model")),
    "language": lambda df: language_id.identify(df, ["doc_id"]),
    "exact": exact_dedup.exact_dedup,
    "distinct": exact_dedup.distinct_texts,
    "packing": lambda df: packing.pack(df, path("word_bpe_49k.json")),
    "near": near_dup.near_duplicates,
    "without_near": near_dup.without_near_duplicates,
    "suffix": suffix_dedup.remove_repeats,
    "licenses": licenses.scan,
    "sharding": lambda df: sharding.place(df, sharding.uniform_tree(8)),
    "pii": pii.find,
    "redact": pii.redact,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.where("false")).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_ties_and_null_keys(ties, name):
    out = OPERATORS[name](ties).collect()
    if name == "distinct":
        assert sorted(str(r.text) for r in out) == sorted(["None", "another text", "other words of a null key", ties.first().text])
    elif name == "without_near":
        assert sorted(str(r.doc_id) for r in out) == ["3", "3", "7", "7", "None"]  # texts without words stay
    else:
        assert len(out) == 7
    if name == "exact":
        assert sum(r.kept for r in out) == 4 and {r.group_size for r in out if r.keep_id == 7} == {3, 1}
    if name == "sharding":
        assert len({(r.shard, r.slot) for r in out}) == 7
    if name == "redact":
        assert out[0].asDict().keys() == set(ties.columns)


def test_pieces_match_the_library(docs, rows):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    found = {r.doc_id: r for r in piece_codec.encode_table(docs, path("piece_bpe_32k.model"), full=True).collect()}
    for i, text in rows:
        ids = library.encode(text or "") + [library.eos_id()]
        assert list(found[i].ids) == ids and found[i].decoded == library.decode(ids) and found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_pieces_match_the_library_on_random_pieces():
    import sentencepiece
    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model")), piece_codec.model(path("piece_bpe_32k.model")), random.Random(3)
    pieces = [*model.ids, " ", "  ", "\n", "🧿"]
    for text in ("".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(4000)):
        assert model.encode(text) == library.encode(text), text


@pytest.mark.parametrize("page,block,first,stream", [(64, 128, 4, 256), (16, 5, 1, 3)])
def test_top_k_is_exact(spark, monkeypatch, page, block, first, stream):
    for name, value in (("FIRST", first), ("STREAM", stream), ("BLOCK", block)):
        monkeypatch.setattr(best_first, name, value)
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(400)] + [(i, [0.5] * 8, 2) for i in range(400, 560)]
    data += [(9_060, [1.0] * 7, 0), (9_061, [0.5] * 7, 0), (40, data[40][1], 3), (40, [0.25] * 8, 3)]  # another length; a key on three rows
    bad = [(9_000, None, 0), (9_020, [1.0, None] * 4, 0), (9_040, [float("nan")] * 8, 0), (None, [1.0] * 8, 0), (9_080, [], 0)]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>, score int")
    whole = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v, _ in data]
    expected = []
    for n, (q, vector) in enumerate(whole):
        if q % 20 == 0:
            others = sorted((-int(vector @ v), i) for m, (i, v) in enumerate(whole) if m != n and len(v) == len(vector))
            expected += [(q, rank, i, -score) for rank, (score, i) in enumerate(others[:20], 1)]
    assert sorted(tuple(r) for r in metric_tree.top_k(df, page=page).collect()) == sorted(expected)
    assert metric_tree.top_k(df.where("false")).count() == 0


def test_ball_bounds_hold():
    rng = np.random.default_rng(4)
    vectors, queries = rng.integers(-40, 40, (60, 9)).astype(float), rng.integers(-40, 40, (30, 9)).astype(float)
    centre, parent = np.rint(vectors.mean(0)), rng.integers(-40, 40, 9).astype(float)
    ball = np.concatenate([centre, [np.linalg.norm(vectors - centre, axis=1).max(), np.linalg.norm(centre - parent)]])
    products, scores = queries @ parent, queries @ vectors.T
    for live in (True, False):  # with and without the centre's own product
        upper, lower = metric_tree.Ball.bounds(queries, ball[None], products, lambda u, lo: np.array([live]))
        assert (scores <= upper).all() and (lower == -np.inf).all()


def test_language_held_out(spark):
    rng = random.Random(2)
    alphabets = {"en": "the and ing of er th", "de": "der die ung sch ich ein", "fr": "le la eau que oui é"}
    data = [(i, " ".join("".join(rng.choices(parts.split(), k=rng.randint(1, 3))) for _ in range(60)), lang) for i, (lang, parts) in enumerate(list(alphabets.items()) * 60)]
    data += [(900, None, "en"), (901, "123 !?", "de"), (902, "", None)]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(data, "doc_id long, text string, lang string"), ["doc_id"]).collect()}
    assert all(out[i].lang_pred == lang and 0 <= out[i].score <= 1 for i, _, lang in data[:180])
    assert {out[i].lang_pred for i in (900, 901, 902)} == {"und"} and {out[i].score for i in (900, 901, 902)} == {0.0}


def test_more_labels_than_one_table_and_only_long_texts(spark):
    rng = random.Random(4)
    words = {f"l{n:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(20)] for n in range(70)}
    names = [*words, "long"]
    words["long"] = ["ωμέγα", "άλφα", "λόγος"]
    data = [(i, " ".join(rng.choices(words[name], k=12_000 if name == "long" else 50)), name) for i, name in enumerate(names * 6)]
    assert min(len(t.encode()) for _, t, name in data if name == "long") > language_id.SAMPLE_BYTES
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(data, "doc_id long, text string, lang string"), ["doc_id"]).collect()}
    learned = {name for i, _, name in data if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(learned) > 64 and "long" in learned
    assert all(out[i].lang_pred == name for i, _, name in data if name in learned)


def test_long_texts_are_scored_in_pieces(monkeypatch):
    text = ("one byte after another " * 40).encode()
    grams = {}
    for batch in language_id._grams(iter([pa.RecordBatch.from_pydict({"lang": ["x"], "text": [text.decode()]})])):
        for _, order, gram, n in zip(*(c.to_pylist() for c in batch.columns)):
            grams[0, order, gram] = grams.get((0, order, gram), 0) + n
    scorer = language_id.Scorer(["x"], [(*g, n) for g, n in grams.items()])
    bodies = [text, b"", b"ab", b"other \xc3\xa9 " * 30, text[:100]]
    whole = scorer.score(bodies).tolist()
    for piece in (1, 2, 7, 100, 1 << 20):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert scorer.score(bodies).tolist() == whole
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 5, None, "", "b" * 50, "c", None]})
    monkeypatch.setattr(language_id, "SLICE", 6)
    assert [x.num_rows for x in language_id._slices(batch, 0)] == [3, 1, 2]


def test_code_lengths_are_exact():
    """Table look-up gives the code length of a direct walk through the contexts."""
    text = b"abracadabra abra"
    grams = {}
    for order in range(language_id.ORDER + 1):
        padded = bytes(language_id.ORDER) + text
        for i in range(language_id.ORDER, len(padded)):
            g = (0, order, int.from_bytes(padded[i - order:i + 1], "big"))
            grams[g] = grams.get(g, 0) + 1
    scorer = language_id.Scorer(["x"], [(*g, n) for g, n in grams.items()])

    def cost(context: bytes, byte: int) -> float:
        total = 0.0
        for order in range(language_id.ORDER, -1, -1):
            followers = {g & 255: n for (_, o, g), n in grams.items() if o == order and g >> 8 == int.from_bytes(context[len(context) - order:], "big")}
            if followers:
                n, kinds = sum(followers.values()), len(followers)
                if byte in followers:
                    return total + np.log2((n + kinds) / followers[byte])
                total += np.log2((n + kinds) / kinds)
        return total + 8
    other = bytes(3) + b"abzra cab\xc3"
    expected = sum(round(cost(other[i - 3:i], other[i]) * language_id.BIT) for i in range(3, len(other)))
    assert scorer.score([other[3:]])[0, 0] == expected


def test_exact_dedup(docs, rows, spark):
    for options in ({}, {"hashed": F.length("_norm").cast("long") % 3}):  # the second makes every row collide
        found = exact_dedup.marked(docs, **options).collect()
        groups = {}
        for i, t in rows:
            groups.setdefault(exact_dedup._norm(t), []).append(i)
        expected = {(i, g[0], len(g), i == g[0]) for g in groups.values() for i in g}
        assert {(r["_key"], r.keep_id, r.group_size, r.kept) for r in found} == expected
        assert all(r.text_sha256 == hashlib.sha256(exact_dedup._norm(dict(rows)[r["_key"]]).encode()).hexdigest() for r in found)


def test_directory_splits_overfull_buckets():
    counts = {0: 50, 1: 50, 2: 50, 3: 50, 4000: 7}
    table = exact_dedup.directory(counts, 60)
    assert len(table) == 1 << 12 and table == sorted(table) and len({table[i] for i in range(4)}) == 4
    owner = exact_dedup.owners(table, counts, 4)
    assert owner == sorted(owner) and set(owner) <= set(range(4))
    assert exact_dedup.directory({}, 10) == [0] and len(exact_dedup.directory({5: 10 ** 6}, 10)) == 1 << 12


def test_packing(docs, rows):
    import tokenizers
    library = tokenizers.Tokenizer.from_file(path("word_bpe_49k.json"))
    expected, total = set(), 0
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        expected |= {(i, k, a, len(ids[a:a + 4096]), zlib.crc32(np.array(ids[a:a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    found = packing.pack(docs, path("word_bpe_49k.json")).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == expected and len(found) == len(expected)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(sequences) == -(-total // 4096)
    for parts in sequences.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip([(0, 0), *parts], parts)) and sum(parts[-1]) <= 4096


def test_packing_plan():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randint(1, 64): rng.randint(1, 9) for _ in range(rng.randint(1, 14))}
        done, left = packing.reduce_dominated(counts, 64)
        for groups in (done, packing.best_fit(left, 64)):
            assert all(sum(s * t for s, t in content) <= 64 and n > 0 for content, n in groups)
        used = {}
        for content, n in [*done, *packing.best_fit(left, 64)]:
            for s, t in content:
                used[s] = used.get(s, 0) + t * n
        assert used == counts
    assert packing.reduce_dominated({40: 3, 24: 2, 64: 1, 60: 1}, 64) == ([([(64, 1)], 1), ([(60, 1)], 1), ([(40, 1), (24, 1)], 2), ([(40, 1)], 1)], {})


def test_near_duplicates(docs, rows):
    expected = brute.near(rows)
    for r in near_dup.near_duplicates(docs).collect():
        assert (r.class_id, r.class_size, r.n_links, r.group_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.group_id)


def test_near_duplicates_in_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 500)}" for _ in range(200)]
    rows = []
    for i in range(70):
        words = list(base)
        words[rng.randint(0, 199)] = f"x{i % 60}"
        rows.append((i, " ".join(words)))
    expected = brute.near(rows)
    for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r.class_id, r.class_size, r.n_links, r.group_id) == expected[r.doc_id]


def test_bands_reach_the_recall():
    bands, rows = near_dup.bands_for(0.8, 0.999, 144)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.999 and bands * rows <= 144


LINE = "this common line of more than a hundred bytes stands in many documents with different words on both of its sides. "


def test_suffix_dedup(rows, spark):
    more = rows + [(100 + i, f"{i * 7919} start{i} " + LINE + f"tail{i * 31} and {i}") for i in range(80)]
    expected = brute.removed(more)
    df = spark.createDataFrame(more, "doc_id long, text string").repartition(4)
    for r in suffix_dedup.remove_repeats(df).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id]


@pytest.mark.parametrize("hot,wide,piece,flush", [(64, 512, 1 << 22, 1 << 20), (2, 1, 900, 40), (1, 4, 3000, 400), (64, 0, 3000, 1 << 20)])
def test_suffix_dedup_steps_with_small_limits(hot, wide, piece, flush, monkeypatch):
    """The steps one after another in this process: hot buckets, cut documents and small folds give the same result."""
    import pandas as pd
    import pyarrow as pa
    for name, value in (("HOT", hot), ("WIDE", wide), ("PIECE", piece), ("FLUSH", flush)):
        monkeypatch.setattr(suffix_dedup, name, value)
    texts = awkward_texts() + [f"{i * 7919} start{i} " + LINE + f"tail{i * 31} and {i}" for i in range(40)]
    rows = list(enumerate(texts))
    table = [pa.RecordBatch.from_pydict({"_key": [i for i, _ in rows[k::3]], "_text": [t or "" for _, t in rows[k::3]]}) for k in range(3)]
    packed = [p for p in suffix_dedup._pack(iter(table))]
    tasks = [pa.RecordBatch.from_arrays([p.column(0), p.column(0), p.column(1)], names=["row", "_key", "_packed"]) for p in packed]

    def frame(batches):
        return pd.concat([b.to_pandas() for b in batches])
    anchors = frame(b for t in tasks for b in suffix_dedup._anchors(iter([t]))).sort_values(["slot", "context", "k", "row", "p"])
    split = [pa.RecordBatch.from_pandas(anchors.iloc[i:i + 50], preserve_index=False) for i in range(0, len(anchors), 50)]
    marks = frame(suffix_dedup._classify(iter(split)))
    bodies = {i: body for t in tasks for i, body in zip(t.column(0).to_pylist(), t.column(2).to_pylist())}
    opened = marks[marks.status != suffix_dedup.FULL]
    wanted = {r: g[["p", "status", "slot"]].to_dict("records") for r, g in opened.groupby("row")}
    contexts = frame(
        b for r, p in wanted.items() for b in suffix_dedup._contexts(iter([pa.RecordBatch.from_pydict({"row": [r], "_key": [r], "_packed": [bodies[r]], "marks": [p]})])))
    contexts["_row"] = range(len(contexts))
    narrow = contexts[contexts.status == suffix_dedup.OPEN].sort_values("slot")[["slot", "k", "row", "first", "body"]]
    refined = list(suffix_dedup._refine(iter([pa.RecordBatch.from_pandas(narrow, preserve_index=False)] if len(narrow) else [])))
    contexts = contexts[contexts.status == suffix_dedup.OPEN_WIDE]
    runs = [(r["row"], r["first"], r["last"]) for b in refined for r in b.to_pylist()]
    if len(contexts):
        cores = frame(suffix_dedup._cores(iter([pa.RecordBatch.from_pandas(contexts[["_row", "far", "body"]], preserve_index=False)])))
        cores["n"] = cores.groupby(["a", "b"]).id.transform("count")
        live = cores[cores.n > 1].groupby("id").group.apply(lambda g: sorted(set(g))).rename("groups")
        met = contexts.merge(live, left_on="_row", right_index=True)[["k", "row", "first", "far", "body", "groups"]]
        windows = frame(b for k in range(2) for b in suffix_dedup._windows(iter([pa.RecordBatch.from_pandas(met.iloc[k::2], preserve_index=False)])))
        single = windows[~windows.known].sort_values(["k", "row", "first"])
        again = single[single.duplicated(["a", "b"])]
        runs += [(r.row, r["first"], r["last"]) for part in (windows[windows.known], again) for _, r in part.iterrows()]
    full = marks[marks.status == suffix_dedup.FULL]
    runs += [(row, (p >> 20) - (p >> 12 & 255), (p >> 20) - (p >> 4 & 255)) for row, p in zip(full.row.tolist(), full.p.tolist())]
    expected = brute.removed(rows)
    for i, text in rows:
        gone = bytearray(len((text or "").encode()))
        for r, first, last in runs:
            if r == i:
                gone[first:last + suffix_dedup.WIDTH] = b"\1" * (last + suffix_dedup.WIDTH - first)
        assert sum(gone) == expected[i][1]


def test_ranks_are_exact():
    raw = np.frombuffer(b"ab" * 90 + b"abc" * 60, np.uint8)
    starts = np.arange(len(raw) - suffix_dedup.WIDTH + 1)
    body, first = raw.tobytes(), {}
    for s, b in zip(starts.tolist(), suffix_dedup.ranks(raw, starts).tolist()):
        assert first.setdefault(body[s:s + suffix_dedup.WIDTH], b) == b
    assert len(set(first.values())) == len(first)


def test_anchors_own_every_window_once():
    rng = random.Random(9)
    bodies = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (100, 101, 400)] + [b"x" * 300]
    begins = np.cumsum([0, *map(len, bodies)])[:-1]
    _, _, piece, at, first, last = suffix_dedup.anchors(np.frombuffer(b"".join(bodies), np.uint8), [len(b) - 99 for b in bodies], begins.tolist())
    owned = [(i, p) for i, f, e in zip(piece.tolist(), first.tolist(), last.tolist()) for p in range(f, e + 1)]
    assert owned == [(i, begin + p) for i, (begin, b) in enumerate(zip(begins.tolist(), bodies)) for p in range(len(b) - 99)]
    assert ((at >= last) & (at - first <= suffix_dedup.SPAN)).all()


def test_licenses(docs, rows):
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, text in rows:
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "mit" in found[22].labels and "cc-by-nc" in found[20].labels


def test_license_wordings(spark):
    passage = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without any fee is hereby granted, provided that the "
               "above copyright notice and this permission notice appear in all copies.")
    wanted = {"Distributed under the MIT License.": "mit", "(c) X, CC BY-NC 4.0": "cc-by,cc-by-nc", "Apache License, Version 2.0": "apache-2.0", "Apache-2.0 is not named": "",
              passage: "isc", "This file is under the Eclipse Public License - v 2.0": "epl-2.0", "CC0 1.0 Universal": "cc0", "CC BY-SA 4.0": "cc-by,cc-by-sa",
              "CC BY-NC-SA 4.0 and then CC BY-NC 4.0": "cc-by,cc-by-nc,cc-by-nc-sa", "CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa",
              "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
              "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 3":
              "gpl,lgpl,lgpl-3.0", "mit license" + " word" * 3 + " licence": "mit", "the permit licence": ""}
    out = licenses.scan(spark.createDataFrame(list(enumerate(wanted)), "doc_id long, text string")).collect()
    assert {list(wanted)[r.doc_id]: r.labels for r in out} == wanted


def test_sharding(docs, rows):
    found = sharding.place(docs, sharding.uniform_tree(8)).collect()
    slots = {}
    for r in found:
        text = (dict(rows)[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key") and r.grown_shard in (r.shard, 8)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_one_more_shard_takes_rows_only_into_itself(spark):
    """Against plain draws, for 1 to 20 shards."""
    import math
    import xxhash

    def draw(key, name):
        h = xxhash.xxh64_intdigest(name.encode(), xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42))
        return -math.log(((h >> 11) + 0.5) / (1 << 53))
    keys = range(-20, 400)
    df = spark.createDataFrame([(k,) for k in keys], "id long")
    found = df.select("id", *[sharding.shard_of("id", sharding.tree_of(n)).alias(f"n{n}") for n in range(1, 21)]).collect()
    for r in found:
        for n in range(1, 21):
            assert r[f"n{n}"] == min(range(n), key=lambda s: draw(r.id, f"/region+{s}"))
            assert n == 1 or r[f"n{n}"] in (r[f"n{n - 1}"], n - 1)
    assert len({r.n20 for r in found}) == 20
    grown = sharding.place(df.withColumn("text", F.lit("x")), sharding.tree_of(8), "id").collect()
    assert {(r.id, r.shard, r.grown_shard) for r in grown} == {(r.id, r.n8, r.n9) for r in found}


def test_changed_weight_moves_rows_only_in_changed_subtrees(spark):
    tree = sharding.uniform_tree(8)
    less = {**tree, "region0": {**tree["region0"], "rack0": {0: 0.5, 1: 1.0}}}
    df = spark.range(4000).select(sharding.shard_of("id", tree).alias("a"), sharding.shard_of("id", less).alias("b"))
    moved = {(r.a, r.b) for r in df.where("a <> b").distinct().collect()}
    assert moved and all(a in (0, 1, 2, 3) for a, _ in moved) and all(b in (4, 5, 6, 7) or a in (0, 1) for a, b in moved)


def test_personal_data(docs, rows):
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    for i, text in rows:
        counts, digest, listed = brute.personal(text)
        r = found[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == digest
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    hidden = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert "555-2485 or" not in hidden[24] and "[PHONE]" in hidden[24] and hidden[7] == dict(rows)[7] and hidden[0] is None
    assert "a.b@c" not in hidden[23] and "[IP]" in hidden[23]


def test_labelers_are_weighed():
    patterns = [("email", 1, 1, 1, 1, 500), ("email", 1, 1, 0, 1, 900), ("card", -1, -1, 0, -1, 800), ("card", 1, 1, 0, 1, 300), ("phone", -1, 1, 0, 1, 3), ("phone", -1, -1, -1, -1, 40)]
    chance = pii.estimate(patterns)
    assert chance[0] > 0.9 and chance[3] > 0.9 and chance[2] < 0.1 and chance[5] < 0.1
    assert set(pii.train([])) == set(pii.train(patterns))
