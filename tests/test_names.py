"""Names that a model finds, by hand."""

from __future__ import annotations

import random
import re

from umbra.functions import names
from umbra.functions.names import Name
from umbra.operators import model_spans


def test_lines():
    assert names.lines("国土资\n源部", 0, 6, "ORG") == [(0, 6)]
    assert names.lines("上海市宝\n山区规划和自然资源局", 0, 15, "ORG") == [(0, 15)]
    assert names.lines("中国建筑\n中建八局", 0, 9, "ORG") == [(0, 4), (5, 9)]
    assert names.lines("甲公司\n部", 0, 5, "ORG") == [(0, 3), (4, 5)]  # a whole name ends before the line end
    assert names.lines("国土资\n\n源部", 0, 7, "ORG") == [(0, 3), (5, 7)]
    assert names.lines("国土资\r\n源部", 0, 7, "ORG") == [(0, 7)]
    assert names.lines("上海\n市", 0, 4, "ADDRESS") == [(0, 4)] and names.lines("上海\n市", 0, 4, "PERSON") == [(0, 2), (3, 4)]
    assert names.lines(" \t甲 \r 乙\t", 0, 8, "ORG") == [(2, 3), (6, 7)] and names.lines("\n \n", 0, 3, "ORG") == []


def test_tails():
    assert names.extended("甲方理股权投资项目的", 0, 2, "ORG") == 9
    assert names.extended("宏远集团有限公司总部", 0, 2, "ORG") == 8  # the longest
    assert names.extended("宏远的集团", 0, 2, "ORG") == 2  # stops at a connector
    assert names.extended("宏远" + "一" * 11 + "集团", 0, 2, "ORG") == 2  # too far
    assert names.extended("上海置业\n 有限公司", 0, 4, "ORG") == 10 and names.extended("上海公司\n有限公司", 0, 4, "ORG") == 4
    assert names.extended("总部基\n地铁", 0, 3, "ADDRESS") == 5 and names.extended("测试大道100号的", 0, 4, "ADDRESS") == 8 and names.extended("x", 0, 1, "ORG") == 1


def test_trim_and_rejoin():
    t = "“宏远建设拟收购”"
    assert names.trimmed(t, Name(0, 9, "ORG", 1.0))[:2] == (1, 5) and names.trimmed(" ” ", Name(0, 3, "ORG", 1.0)) is None
    t = "苏州万\n和置业有限公司\n宏图集团\n明珠集团"
    got = names.rejoined(t, [Name(0, 3, "ORG", 0.9), Name(4, 11, "ORG", 0.8), Name(12, 16, "ORG", 0.7), Name(17, 21, "ORG", 0.6)])
    assert [(n.start, n.end, n.score, n.canonical) for n in got] == [(0, 11, 0.8, "苏州万和置业有限公司"), (12, 16, 0.7, None), (17, 21, 0.6, None)]
    assert len(names.rejoined("甲\n乙", [Name(0, 1, "PERSON", 1.0), Name(2, 3, "PERSON", 1.0)])) == 2


def test_repeated():
    t = "示例建设集团中标。示例建\n设集团签约。示例建\n\n设集团"
    got = names.repeated(t, [Name(0, 6, "ORG", 0.9), Name(10, 12, "ORG", 0.8), Name(19, 22, "ORG", 0.8)])
    assert [(n.start, n.end, n.repair) for n in got] == [(0, 6, None), (9, 16, "repeated_surface"), (19, 22, None)]  # two line ends are none
    got = names.repeated("宏远建设，宏远建设", [Name(0, 4, "ORG", 0.9), Name(5, 9, "ADDRESS", 0.8)])
    assert [n.label for n in got] == ["ORG", "ORG"]


def test_longest_known_name_by_search():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("甲乙丙") for _ in range(40))
        spans = [Name(a, a + rng.randint(2, 6), "ORG", 1.0) for a in (rng.randint(0, 30) for _ in range(5))]
        values = {text[n.start : n.end] for n in spans if n.end - n.start >= 3}
        for n, g in zip(spans, names.repeated(text, spans), strict=True):
            own = text[n.start : n.end]
            longer = [(-len(v), v, m.start()) for v in values if len(v) > len(own) for m in re.finditer(f"(?={v})", text) if m.start() <= n.start and m.start() + len(v) >= n.end]
            want = min(longer, default=None)
            assert (g.start, g.end) == ((want[2], want[2] - want[0]) if want else (n.start, n.end))


def test_universities_and_nobody():
    t = "清华大学与北京大学"
    got = names.universities(t, [Name(0, 3, "ORG", 0.9), Name(3, 4, "ADDRESS", 0.5), Name(5, 9, "ADDRESS", 0.8)])
    assert [(n.start, n.end, n.label, n.score) for n in got] == [(0, 4, "ORG", 0.5), (5, 9, "ORG", 0.8)]
    some = lambda v, label="ORG": names.names_somebody(v, Name(0, len(v), label, 1.0))
    assert some("宏远建设") and some("张三", "PERSON") and not some("公司") and not some("tment") and not some("甲a") and not some("江城市人民法院") and not some("县人民政府") and not some("地铁", "ADDRESS")


def test_spans_of_a_table(spark):
    docs = spark.createDataFrame([(1, "宏远建设与宏\n远建设集团"), (2, None), (3, "")], "doc_id long, text string")
    given = [(1, 0, 4, "ORG", 0.9), (1, 0, 4, "ORG", 0.95), (1, 5, 11, "ORG", 1.7), (1, 0, 99, "ORG", 0.9), (1, 3, 2, "ORG", 0.9), (1, 0, 2, None, 0.9), (1, 0, 2, "ORG", 0.1), (2, 0, 1, "ORG", 0.9), (9, 0, 1, "ORG", 0.9)]
    got = sorted(tuple(r) for r in model_spans.spans(spark.createDataFrame(given, "doc_id long, start int, end int, label string, score double"), docs).select("start", "end", "label", "confidence", "surface").collect())
    assert got == [(0, 4, "ORG", 0.95, "宏远建设"), (5, 12, "ORG", 1.0, "宏\n远建设集团")]
    assert model_spans.spans(spark.createDataFrame([], "doc_id long, start int, end int, label string, score double"), docs).count() == 0
