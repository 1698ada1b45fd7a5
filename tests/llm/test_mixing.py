import os

import pytest

from loregraph.llm.mixing import mix_documents


@pytest.fixture(scope="module")
def data(spark):
    docs = [(i, "alpha beta gamma " * (1 + i % 7), "big", 1) for i in range(300)] + [(1000 + i, "one two three four", "small", 1) for i in range(5)]
    docs += [(2000, None, "small", 1), (2001, "", "small", 1), (2002, "left out", "unlisted", 1), (2003, "left out", None, 1)]
    targets = [("big", 0.5, 2), ("small", 0.4, 3), ("ghost", 0.1, 2), (None, 0.1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_and_caps(data):
    for block in (200_000, 10):
        mix, report = mix_documents(*data, block_rows=block)
        r = {x.source: x for x in report.collect()}
        assert set(r) == {"big", "small", "ghost"}
        assert not r["big"].capped and r["small"].capped and r["ghost"].capped
        assert r["ghost"].mixed_tokens == 0 and r["small"].mixed_docs == 7 * 3 and r["small"].most_copies == 3
        assert abs(r["big"].mixed_tokens / r["big"].target_tokens - 1) < 0.03
        assert abs(sum(x.actual_share for x in r.values()) - 1) < 1e-9
        rows = mix.collect()
        assert len({x.doc_id for x in rows}) == len(rows) and max(x.copies for x in rows) == 3
        assert not {x.doc_id for x in rows} & {2002, 2003}


def test_seed_decides(data):
    a, b = (sorted(map(tuple, mix_documents(*data, seed=3)[0].collect())) for _ in range(2))
    assert a == b != sorted(map(tuple, mix_documents(*data, seed=4)[0].collect()))


def test_empty(data):
    mix, report = mix_documents(data[0].limit(0), data[1])
    assert mix.count() == 0 and {x.actual_share for x in report.collect()} == {0.0}


def test_found_comes_out_of_the_mix(spark):
    """The optimized plan of the query holds the windows of the sampling, and its rows are the capped sources."""
    from loregraph.llm.queries import p7_found, p7_shares

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("needs the test tables")
    found = p7_found(spark, d)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" in plan and plan.count("Window [") >= 2
    assert {r.source for r in found.collect()} == {r.source for r in p7_shares(spark, d).filter("capped").collect()}
