"""References in contents and in the JSON of page builders."""

import json

import pytest

from foliomill.operators.usage import usage_edges

REFERENCE = r'''\[doc\b[^\]]*?\bid=["'](\d+)["']'''
NESTED = [{"id": "a1", "settings": {"html": 'x [doc id="42"] y', "more": [{"deep": {"er": "[doc id='5']"}}]}}, None, 3]
CASES = [
    ('<p>[doc id="17"]</p> [doc id="179" tutor="yes"] [doc id=\'5\']', None, {17, 179, 5}), ('[doc id="179"]', None, {179}), ("", json.dumps(NESTED), {42, 5}), (None, '[{"s":"[doc id=\\"42\\"]"}]', {42}),
    ("[other id=\"3\"]", "", set()), ('[doc id="9"] [doc id="9"]', '{"a": "[doc id=\\"9\\"]"}', {9}), (None, None, set()),
    ("", '{"broken": "[doc id=\\"7\\"]", "x": [1, ', {7}), ("", '{"odd": "\\x [doc id=\\"8\\"]"}', {8}), ("", '{"a": "[doc", "b": "id=\\"6\\"]"}', set()), ("", "null", set()),
    ("", json.dumps({"escaped": '[doc id="\u0031\u0030"]'}), {10}),
]


@pytest.fixture(scope="module")
def found(spark):
    hosts = spark.createDataFrame([(i, "publish", c, b) for i, (c, b, _) in enumerate(CASES)] + [(99, "trash", '[doc id="5"]', None)], "host_id long, status string, content string, builder string")
    docs = spark.createDataFrame([(str(i),) for i in range(200)], "doc string")
    return [(r.host_id, int(r.doc)) for r in usage_edges(hosts, docs, REFERENCE).collect()]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_references(found, i):
    assert sorted(d for h, d in found if h == i) == sorted(CASES[i][2])


def test_dead_hosts_show_nothing(found):
    assert not [d for h, d in found if h == 99]
