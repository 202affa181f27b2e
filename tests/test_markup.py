"""Texts that are read with a stack."""

import json

import pytest
from pyspark.sql import functions as F

from kartoteka.functions import markup


def run(spark, column, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>Текст <strong>важно</strong></p><ul><li>a</li></ul>", []),
        ("<p>a<strong>b</p></strong>", [("tag_not_closed", "p"), ("tag_not_closed", "strong")]),
        ("<p>a<p>b</p>", [("tag_not_closed", "p")]),
        ("</p>", [("tag_not_closed", "p")]),
        ("<div>x</div>&nbsp;<p/>", [("html_entity", "&nbsp;"), ("tag_not_allowed", "div"), ("tag_not_allowed", "div")]),
        ("<p>текст<p", [("tag_not_closed", "p"), ("angle_bracket_unbalanced", "2/1")]),
        (None, []),
    ],
)
def test_markup(spark, html, want):
    assert [tuple(e) for e in run(spark, markup.markup_errors, html)[0]] == want


def test_json_that_was_cut_off(spark):
    shown = lambda c: F.to_json(markup.answered_json(c))
    got = run(spark, shown, '{"specs":{"бренд":"DON"},"seo":"Холодильник DON', '```json\n{"a":2}\n```', '[{"a":4},1]', '{"a":[1,{"b":2},', '{"a":"x\\"y', "совсем не json", "", None)
    assert [g and json.loads(g) for g in got] == [{"specs": {"бренд": "DON"}, "seo": "Холодильник DON"}, {"a": 2}, {"a": 4}, {"a": [1, {"b": 2}]}, {"a": 'x"y'}, None, None, None]


def test_any_cut_inside_a_value_parses(spark):
    whole = json.dumps({"a": [1, 22, {"b": "t\\e\"x}t", "c": []}], "d": {"e": "ы]"}}, ensure_ascii=False)
    ends = [i for i in range(whole.index("22") + 2, len(whole) + 1) if whole[i - 1] not in '":,\\' and not whole[: i + 1].rstrip().endswith(('"b', '"c', '"d', '"e'))]
    got = run(spark, lambda c: markup.answered_json(c).isNotNull(), *[whole[:i] for i in ends])
    sound = []
    for i in ends:
        sound.append(run_plain(whole[:i]) is not None)
    assert got == sound


def run_plain(s):
    inside = escape = False
    stack = []
    for ch in s:
        if inside:
            if escape:
                escape = False
            elif ch == "\\":
                escape = True
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif stack and ch == stack[-1]:
            stack.pop()
    s = (s + '"' * inside).rstrip().removesuffix(",") + "".join(reversed(stack))
    try:
        return json.loads(s)
    except ValueError:
        return None
