import pytest

from tideglass.plans.filters import Chip, FilterState
from tideglass.plans.predicates import AnyText, Contains, Equals, OneOf, Since, Status, StatusClasses, UnsupportedPredicate, arms, parse, tokens

NOW = 1_700_000_000_000_000


def texts(state, **more):
    return [p.sql() for p in state.predicates(NOW, **more)]


def test_clauses_come_in_order():
    s = FilterState(services=["api"], levels=["error"], chips=[Chip("status", ">=500"), Chip(None, "it's")], checked={"error_type": ["E"]})
    assert texts(s, live="route:/x") == [
        "service IN ('api')", "level IN ('error')", "line >= 500", "(message LIKE '%it''s%' OR level = 'it''s')", "message LIKE '%/x%'", "exception_type IN ('E')",
        f"timestamp > to_timestamp_micros({NOW - 900_000_000})",
    ]


@pytest.mark.parametrize(("section", "ids", "want"), [
    ("log_level", ["error", " "], "level IN ('error')"), ("service_name", ["a", "b"], "service IN ('a','b')"), ("status_code", ["200", "x"], "line IN (200)"),
    ("response_status", ["success", "server_error"], "(line < 300 OR line >= 500)"), ("response_status", ["redirect"], "(line >= 300 AND line < 400)"), ("error_type", ["E"], "exception_type IN ('E')"),
])
def test_checked_sections(section, ids, want):
    assert texts(FilterState(time_range="", checked={section: ids})) == [want]


def test_sections_for_the_client_alone_and_empty_ones_compile_to_nothing():
    assert texts(FilterState(time_range="", checked={"health_status": ["healthy"], "log_level": [], "status_code": ["x"]})) == []


def test_a_facet_leaves_out_its_own_selection():
    s = FilterState(services=["a"], levels=["info"], time_range="", checked={"log_level": ["error"]})
    assert texts(s, exclude={"services"}) == ["level IN ('info')", "level IN ('error')"]
    assert texts(s, exclude={"levels", "log_level"}) == ["service IN ('a')"]


def test_live_text_that_is_pinned_is_not_repeated_and_service_chips_are_services():
    s = FilterState.from_params({"c": "service:api,boom", "t": "All"})
    assert s.services == ["api"] and texts(s, live="boom") == ["service IN ('api')", "(message LIKE '%boom%' OR level = 'boom')"]


def test_parameters_round_trip():
    s = FilterState("q", [Chip("status", "500"), Chip(None, "x:y")], ["a", "b"], "Last 7 days", ["warn"], {"status_code": ["404"]})
    assert FilterState.from_params(s.to_params()) == s
    assert FilterState.from_params({"ch": "{bad"}) == FilterState() == FilterState.from_params({"ch": "[1]"})


@pytest.mark.parametrize("p", [
    OneOf("service", ("it's", "b")), OneOf("line", (1, 2)), Equals("correlation_id", "x AND y"), Contains("a)b AND 'c"), AnyText("t"), Status("!=", 5), Since(5, "<="),
])
def test_compiled_text_is_read_back(p):
    assert parse("WHERE " + p.sql() + " AND level IN ('x')") == [p, OneOf("level", ("x",))]


def test_clauses_split_outside_quotes_and_parentheses():
    assert tokens("a = 'x AND y' AND (b AND c) AND d = ''' AND '", " AND ") == ["a = 'x AND y'", "(b AND c)", "d = ''' AND '"]


def test_filters_without_a_meaning_on_both_sources_are_refused_together(spark):  # columns need a session
    with pytest.raises(UnsupportedPredicate, match="exception_type.*;.*line < 300"):
        arms([OneOf("exception_type", ("E",)), Status("=", 1), StatusClasses(("success",))])
    with pytest.raises(UnsupportedPredicate, match="1 = 1"):
        parse("1 = 1")
