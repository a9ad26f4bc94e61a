"""Citations, their targets and the newest versions of articles."""
import random

import pytest

from lexloom.operators import amend as AM


def doc(number, *lines, day=1):
    return "\n".join([f"Số: {number}", f"Hà Nội, ngày {day} tháng 2 năm 2020", "Điều 1. Một", *lines, "Điều 3. Ba"])


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_citations(docs):
    text = doc("5/QĐ-A", "Điều 2. Hai", "1. Sửa đổi, bổ sung Điểm b, Khoản 3, Điều 7 của Quyết định số 12/QĐ-ĐHTN.",
               "2. Bãi bỏ Điều 4 Thông tư 8/2019/TT-BGDĐT và thay thế Nghị định số: 9/NĐ-CP; bổ sung Khoản 1 Điều 2 tại",
               "Quyết định số 12/QĐ-X", "a) sửa đổi điều 1 của quy chế 77/qc-y")
    got = AM.citations(docs(text, "", "Sửa đổi Điều 1 của Quyết định số 1/QĐ-A"))
    assert rows(got, "doc_key", "node", "citation_no", "action", "target_number", "target_article", "target_clause",
                "target_point") == [
        (1, 3, 0, "amend", "12/QĐ-ĐHTN", "7", "3", "b"), (1, 4, 0, "repeal", "8/2019/TT-BGDĐT", "4", "", ""),
        (1, 4, 1, "replace", "9/NĐ-CP", "", "", ""), (1, 5, 0, "amend", "77/qc-y", "1", "", "")]
    assert {r.article for r in got.collect()} == {"2"}


def change(article, number, verb="Sửa đổi"):
    return ["Điều 2. Hai", f"{verb} Điều {article} của Quyết định số {number}."]


def test_states(docs):
    df = docs(doc("1/QĐ-A", *change(9, "2/QĐ-A")), doc("2/QĐ-A", *change(1, "2/QĐ-A")), doc("3/QĐ-A", *change(1, "4/QĐ-A")),
              doc("5/QĐ-A", *change(1, "6/QĐ-A")), doc("6/QĐ-A"), doc("6/QĐ-A", *change(1, "1/QĐ-A")),
              doc("7/QĐ-A", "Điều 2. Hai", "Thay thế Quyết định số 1/QĐ-A."))
    assert rows(AM.amendment_edges(df), "doc_key", "target", "status") == sorted([
        (1, 2, "unknown_article"), (2, 2, "self"), (4, None, "ambiguous"), (6, 1, "ok"), (7, 1, "whole_document"),
        (3, None, "unknown_document")], key=lambda r: r[0])


def test_newest(docs):
    df = docs(doc("1/QĐ-A"), doc("2/QĐ-A", *change(1, "1/QĐ-A"), day=2), doc("3/QĐ-A", *change(1, "1/QĐ-A"), day=3),
              doc("4/QĐ-A", *change(2, "3/QĐ-A"), day=4), doc("5/QĐ-A", *change(2, "6/QĐ-A")),
              doc("6/QĐ-A", *change(2, "5/QĐ-A")), doc("7/QĐ-A", *change(3, "1/QĐ-A", "Bãi bỏ")),
              doc("8/QĐ-A", *change(2, "5/QĐ-A"), day=9))
    got = {(r.doc_key, r.article): (r.newest, r.newest_article, r.hops, r.status)
           for r in AM.newest_articles(df).collect()}
    assert got[1, "1"] == (4, "2", 2, "amended")                 # the later change, and what changed that
    assert got[2, "2"] == (2, "2", 0, "current") and got[3, "2"] == (4, "2", 1, "amended")
    assert got[1, "3"] == (1, "3", 0, "repealed")
    assert got[5, "2"] == (8, "2", 1, "amended") and got[6, "2"] == (8, "2", 2, "amended")
    assert len(got) == 3 * 8 - 1                                 # the first has no second article


@pytest.mark.parametrize("seed", range(3))
def test_following(spark, seed):
    rng = random.Random(seed)
    n = 200
    to = {i: rng.randrange(n) if rng.random() < .3 else i + 1 for i in range(n) if rng.random() < .93}
    df = spark.createDataFrame([(i, "1", t, "1") for i, t in to.items()],
                               "of int, of_article string, to int, to_article string")
    got = {r["of"]: (r["to"], r["hops"], r["cycle"]) for r in AM.follow(df).collect()}
    for i in to:
        at, hops = i, 0
        while at in to and hops <= n:
            at, hops = to[at], hops + 1
        assert got[i][2] == (hops > n) and (hops > n or got[i][:2] == (at, hops))
    assert len(got) == len(to)


def test_long_chain_and_circles(spark):
    chain = [(i, "1", i + 1, "1") for i in range(300)] + [(1000, "1", 1001, "1"), (1001, "1", 1000, "1"),
                                                         (1002, "1", 1002, "1"), (1003, "1", 1001, "1")]
    df = spark.createDataFrame(chain, "of int, of_article string, to int, to_article string")
    got = {r["of"]: (r["to"], r["hops"], r["cycle"]) for r in AM.follow(df).collect()}
    assert all(got[i] == (300, 300 - i, False) for i in range(300))
    assert all(got[i][2] for i in (1000, 1001, 1002, 1003)) and len(got) == len(chain)


def test_no_documents(docs):
    df = docs("x").limit(0)
    assert AM.citations(df).count() == AM.amendment_edges(df).count() == AM.newest_articles(df).count() == 0
