import math

import pytest

from tessellar.errors import Invalid, Unsupported
from tessellar.functions.names import float_text, label_name, metric_name, series_id
from tessellar.plans.syntax import Aggregate, Binary, Call, Matcher, Number, Selector, fold, parse


def test_precedence():
    assert fold(parse("1 + 2 * 3 ^ 2")) == 19
    assert fold(parse("-2 ^ 2")) == -4
    assert fold(parse("2 ^ 3 ^ 2")) == 512
    assert fold(parse("8 - 3 - 2")) == 3
    assert fold(parse("2 * (3 + 4) % 5")) == 4
    assert math.isnan(fold(parse("0 / 0"))) and fold(parse("1 / 0")) == math.inf and fold(parse("-1 / 0")) == -math.inf
    assert fold(parse("0x10 + 1e1 + .5 + 1m")) == 86.5


def test_selectors():
    node = parse('m{a="x",b!="y",c=~"z.*",d!~"w"}[5m] offset 1h30m'.replace("[5m]", ""))
    assert isinstance(node, Selector) and node.offset_ms == 5_400_000
    assert [m.op for m in node.matchers] == ["=", "=", "!=", "=~", "!~"]
    assert parse('{__name__="m"}').matchers == (Matcher("__name__", "=", "m"),)
    assert parse("m offset -5m").offset_ms == -300_000
    assert parse("rate(m[1m30s])").args[0].range_ms == 90_000
    assert parse("m{a='it\\'s',b=`\\d`}").matchers[1:] == (Matcher("a", "=", "it's"), Matcher("b", "=", "\\d"))


def test_dotted_names():
    node = parse('sum by (service.name) (http.server.duration{host.name="x"})')
    assert node.by == ("service_name_x55e50a58f9befba7",)
    assert node.arg.matchers[0].value == metric_name("http.server.duration")
    assert node.arg.matchers[1].name == label_name("host.name")


def test_aggregates_and_matching():
    node = parse("topk by (a) (3, m)")
    assert isinstance(node, Aggregate) and node.by == ("a",) and node.param == Number(3)
    assert parse("sum(m) without (a)").without == ("a",)
    node = parse("a / on (x) group_left (y) b > bool 2")
    assert isinstance(node, Binary) and node.bool_ and node.left.matching.many == "left" and node.left.matching.include == ("y",)
    assert isinstance(parse("holt_winters(m[5m], 0.5, 0.5)"), Call)


@pytest.mark.parametrize("text", ["m @ 5", "m[5m:1m]", "m[5m]", '"text"', "a atan2 b", "exp(m)", "sqrt(m)", "limitk(2, m)", '{__name__!="m"}', '{__name__!~"m"}', 'm{a="b" or c="d"}'])
def test_unsupported(text):
    with pytest.raises(Unsupported):
        parse(text)


@pytest.mark.parametrize(
    "text",
    ["", "{}", '{a=""}', '{a=~".*"}', "m{", "sum()", "sum(1)", "rate(m)", "abs(m[5m])", "m +", "1 > 2", "a and 1", "a and on (x) group_left () b", "a and bool b", 'm{__name__="n"}', 'm{a=~"("}', 'm{a=~"(?=x)"}', "label_replace(m, 1, 2, 3, 4)", "abs(m, m)", "m)", "1 + on (a) m"],
)
def test_invalid(text):
    with pytest.raises(Invalid):
        parse(text)


def test_names():
    assert metric_name("cpu:usage_1") == "cpu:usage_1"
    assert label_name("service.name") == "service_name_x55e50a58f9befba7"
    assert label_name("__x").startswith("otel___x_x")
    assert metric_name("1a").startswith("_1a_x")
    assert series_id([("b", "2"), ("a", "1")]) == series_id([("a", "1"), ("b", "2")])


@pytest.mark.parametrize(
    "value, text",
    [(0.0, "0"), (-0.0, "-0"), (1.0, "1"), (0.5, "0.5"), (1e-4, "0.0001"), (1e-5, "1e-05"), (123456.5, "123456.5"), (1e6, "1e+06"), (1234567.0, "1.234567e+06"), (-2.5e-7, "-2.5e-07"), (math.inf, "+Inf"), (-math.inf, "-Inf"), (math.nan, "NaN"), (1e100, "1e+100"), (100.0, "100"), (0.00025, "0.00025")],
)
def test_float_text(spark, value, text):
    from tessellar.functions.names import float_column

    assert float_text(value) == text
    frame = spark.createDataFrame([(value,)], "x double")
    assert frame.select(float_column(frame["x"])).first()[0] == text
