"""Queries of the subpackage against their SQL on the smallest tables; those without SQL run and keep their columns."""

import pytest

from corvidex.llm.queries import ORACLES, QUERIES

COLUMNS = {"p1_found": ["doc_id"], "p8_ids": ["doc_id", "ids"], "p9_found": ["source"]}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, same):
    same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(name, spark, tables):
    df = QUERIES[name](spark, tables[1])
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() >= 0


@pytest.mark.parametrize(("links", "members", "pairs"), [("p6_links", "p6_members", "p6_found"), ("p10_spans", "p10_members", "p10_found")])
def test_members_complete_the_links(links, members, pairs, spark, tables):
    rep, count = {}, {}
    for r in QUERIES[members](spark, tables[1]).collect():
        assert r.doc_id not in rep
        rep[r.doc_id], count[r.doc_id] = r.rep, r.links
    found = [(r.rep_a, r.rep_b) for r in QUERIES[links](spark, tables[1]).collect()]
    linked = set(found)
    assert all(n == sum(rep[i] in pair for pair in linked) for i, n in count.items())
    want = {(a, b) for a in rep for b in rep if a < b and (rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in linked)}
    assert {tuple(r) for r in QUERIES[pairs](spark, tables[1]).collect()} == want
