"""Pruned searches against scoring every pair, and how few pairs they meet."""
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statproof.operators import ranking, search

RARE = [a + b + c for a in "가나다라마바사아자차" for b in "각난닫랄맘" for c in "강넝덩"]


def words(text):
    return re.findall("[가-힣A-Za-z0-9]+", text or "")


def grams(text, sizes):
    return [g for w in words(text) for g in [w, *[w[i:i + n] for n in sizes for i in range(len(w) - n + 1)]]]


def best(scores, k, digits):
    """[(rank, ord, score)] of one query, ties in catalog order."""
    kept = sorted(((-round(s, digits), o, s) for o, s in scores.items() if s > 0))[:k]
    return [(i + 1, o, round(s, 6)) for i, (_, o, s) in enumerate(kept)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    docs = [(i, f"통계 {' '.join(rng.choices(RARE, k=rng.choice((1, 3, 6))))}") for i in range(300)]
    docs += [(300 + i, docs[i % 7][1]) for i in range(60)] + [(360, ""), (361, "통계"), (362, "a"), (363, "a b ab abc"), (364, "통계 통계")]
    asked = [(i, f"통계 {' '.join(rng.choices(RARE, k=4))}") for i in range(25)]
    asked += [(25, "통계"), (26, ""), (27, "없는말"), (28, "a ab"), (29, asked[0][1]), (30, "통"), (31, "... !")]
    return asked, docs


@pytest.fixture(scope="module")
def frames(spark, texts):
    asked, docs = texts
    return (spark.createDataFrame(asked, "qid long, query string").repartition(3),
            spark.createDataFrame(docs, "ord long, doc string").withColumn("keywords", F.substring("doc", 1, 5)).repartition(3))


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append((r["rank"], r["ord"], round(float(r["score"]), 6)))
    return out


@pytest.mark.parametrize("k", [1, 4])
def test_overlap(texts, frames, k):
    asked, docs = texts
    sets = {o: set(grams(t, (2,))) for o, t in docs}
    want = {}
    for qid, t in asked:
        q = set(grams(t, (2,)))
        got = best({o: round(len(q & d) / math.sqrt(len(q | d)), 4) for o, d in sets.items() if q & d}, k, 4)
        want |= {qid: got} if got else {}
    assert found(ranking.search_overlap(*frames, k)) == want


def test_tfidf(texts, frames):
    asked, docs = texts
    corpus = [t for o, d in docs for t in (d, d[:5])]
    df = Counter(g for t in corpus for g in set(grams(t, (2, 3))))

    def vector(t):
        w = {g: n * (math.log((len(corpus) + 1) / (df[g] + 1)) + 1) for g, n in Counter(grams(t, (2, 3))).items() if g in df}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()}
    vectors = {o: vector(t) for o, t in docs}
    want = {}
    for qid, t in asked:
        q = vector(t)
        got = best({o: sum(x * d.get(g, 0) for g, x in q.items()) for o, d in vectors.items()}, 3, 9)
        want |= {qid: got} if got else {}
    have = found(ranking.search_tfidf(*frames, 3))
    assert {q: [(r, o) for r, o, _ in v] for q, v in have.items()} == {q: [(r, o) for r, o, _ in v] for q, v in want.items()}
    assert all(abs(a[2] - b[2]) < 2e-6 for q in want for a, b in zip(have[q], want[q]))


def test_substring(texts, frames):
    asked, docs = texts
    want = {}
    for qid, t in asked:
        got = best({o: sum(a in b or b in a for a in set(words(t)) for b in set(words(d))) for o, d in docs}, 5, 0)
        want |= {qid: got} if got else {}
    assert found(ranking.search_substring(*frames, 5)) == want


def test_gram_of_every_document_stays_closed(spark):
    """The word that all documents hold would make 20 x 6,000 pairs; under 5 % of them are met."""
    rng = random.Random(8)
    names = [f"w{i}" for i in range(3000)]
    docs = [(i, ["all", *rng.sample(names, 5)]) for i in range(6000)]
    asked = [(i, ["all", *rng.choice(docs)[1][1:]]) for i in range(20)]
    flat = lambda rows, cols: spark.createDataFrame([(i, g, 1.0, len(set(gs))) for i, gs in rows for g in set(gs)], cols)
    postings = flat(docs, "dg long, g string, wd double, ad int")
    plan = search.opened_grams(flat(asked, "qg long, g string, wq double, aq int"), postings, 1,
                               lambda dot, nq, nd: dot / F.sqrt(nq + nd - dot), lambda rest, nq: rest / F.sqrt(nq))
    assert plan.where("g = 'all' AND (early OR opened)").isEmpty()
    met = [plan.where(step).join(postings, "g").count() for step in ("early", "opened")]
    assert sum(met) < 0.05 * len(asked) * len(docs)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "qid long, query string"), spark.createDataFrame([], "ord long, doc string, keywords string")
    some = spark.createDataFrame([(1, "통계")], "qid long, query string"), spark.createDataFrame([(1, "통계", None)], "ord long, doc string, keywords string")
    for call in (ranking.search_overlap, ranking.search_tfidf, ranking.search_substring):
        assert call(none[0], some[1]).isEmpty() and call(some[0], none[1]).isEmpty()
        assert call(*some).count() == 1


def test_candidates_from_a_sentence(spark):
    """Terms drive the search: a qualified claim asks each term, a plain one its indicator, one without terms nothing."""
    names = ["배추 물가 통계", "소비자물가 총지수", "실업률 통계", "품목별 소비자물가지수 배추", "아무 표"]
    catalog = spark.createDataFrame([(i, i, n, "O1", f"T{i}", n, "") for i, n in enumerate(names)],
                                    "tbl long, ord long, doc string, org_id string, tbl_id string, tbl_nm string, survey string")
    items = spark.createDataFrame([(2, 0, "실업률(%)"), (2, 1, "취업자"), (0, 0, "전월비(%)")], "tbl long, item_no int, item string")
    claims = spark.createDataFrame([(1, "지난해 배추 가격이 5.2% 올랐다."), (2, "실업률은 6.1%다."), (3, "아무 관련 없는 문장"), (4, None), (5, ""), (6, "실업률은 6.1%다.")],
                                   "claim_id long, sentence string")
    got = {}
    for r in ranking.suggest_for_claims(claims, catalog, items).orderBy("claim_id", "rank").collect():
        got.setdefault(r["claim_id"], []).append(r)
    assert set(got) == {1, 2, 6}
    assert [r["tbl"] for r in got[2]] == [2] and got[2][0]["selected_item"] == "실업률(%)"
    assert [r["tbl"] for r in got[1]][0] == 3 and len(got[1]) == 3
    assert [(r["tbl"], r["score"]) for r in got[6]] == [(r["tbl"], r["score"]) for r in got[2]]
    hits = ranking.search_hits(claims.where("claim_id = 1").select("claim_id", F.lit(None).alias("x")).select(
        "claim_id", F.struct(F.array(F.lit("배추"), F.lit(" ")).alias("qualifiers"), F.lit("소비자물가").alias("indicator")).alias("profile")), catalog)
    assert [r["tbl"] for r in hits.orderBy("rank").collect()] == [0, 3, 1]
