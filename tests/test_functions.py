"""Scalar functions against plain Python."""

import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from kgspark.functions import labels as L
from kgspark.functions import similarity as S
from kgspark.functions import text as T
from kgspark.functions.jsonrepair import repair, report


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_standardize(spark):
    got = one(spark, [("  Political  party ",), ("énergie-verte!",), ("a__b",), ("--",), ("",)], "x string", L.standardize_label(F.col("x")))
    assert [g[0] for g in got] == ["POLITICAL_PARTY", "ÉNERGIE_VERTE", "A__B", "", ""]


def test_surface_forms(spark):
    rows = [("Prime Minister",), ("climate",), ("EU",), ("NATO summit",), ("abc",), ("Inflation",), ("",), (None,), ("A 1b",)]
    got = one(spark, rows, "x string", L.normalize_surface_form(F.col("x")), L.classify_surface_form(F.col("x")))
    assert got == [("PRIME_MINISTER", "role_artifact"), ("CLIMATE", "concept_like"), ("EU", "named_entity"), ("NATO_SUMMIT", "named_entity"), ("ABC", "unknown"), ("INFLATION", "concept_like"), ("", "unknown"), ("", "unknown"), ("A_1B", "concept_like")]


@pytest.mark.parametrize(
    ("a", "b", "conflict"),
    [("energy dependence", "energy independence", True), ("Ukraine", "Ukrainian", True), ("Italy", "Italian", True), ("North Korea", "North Korean", True), ("Mali", "Malian", True), ("Ukraine", "Ukraine", False), ("Bank", "Banks", False), ("", "x", False)],
)
def test_conflicts(spark, a, b, conflict):
    assert one(spark, [(a, b)], "a string, b string", L.surface_forms_conflict(F.col("a"), F.col("b"))) == [(conflict,)]


def test_aliases(spark):
    rows = [("European Parliament", "EUROPEAN PARLIAMENT"), ("EU", "Europe"), ("President", "Mario Draghi"), ("European Commission", "European Commissions"), ("Draghi Mario", "Mario Draghi"), ("Italy", "Italian")]
    ratio = S.sequence_ratio(F.replace(L.normalize_surface_form(F.col("a")), F.lit("_"), F.lit(" ")), F.replace(L.normalize_surface_form(F.col("b")), F.lit("_"), F.lit(" ")))
    df = spark.createDataFrame(rows, "a string, b string").withColumn("r", ratio)
    assert [r[0] for r in df.select(L.potential_aliases(F.col("a"), F.col("b"), F.col("r"))).collect()] == [True, False, False, True, True, False]


def test_blocking(spark):
    got = one(spark, [("The Apple Inc. of_x",), ("",)], "x string", F.array_sort(L.blocking_keys(F.col("x"))))
    assert got[0][0] == ["ALPHA:t", "TOKEN:apple", "TOKEN:of_x"] and got[1][0] == []


def test_uri_helpers(spark):
    got = one(spark, [("http://x/y#legalAct_part",)], "x string", L.local_name(F.col("x")), L.title_case(L.local_name(F.col("x"))))
    assert got == [("legalAct_part", "Legal Act Part")]
    assert one(spark, [("TOPIC_3",), ("SUBTOPIC_3_1",)], "x string", L.topic_key(F.col("x"))) == [("3",), ("3::1",)]
    assert one(spark, [("EU", "European Union")], "a string, b string", L.acronym_score(F.col("a"), F.col("b"))) == [(0.98,)]


def test_hints(spark):
    rows = [("Draghi", ["MARIO_DRAGHI"]), ("Bank of Italy", ["bank italy group"]), ("Foo", ["bar", None, ""]), ("", ["x"]), ("climate policy", ["policy"])]
    assert [r[0] for r in one(spark, rows, "e string, h array<string>", S.matches_hint(F.col("e"), F.col("h")))] == [True, True, False, False, True]
    assert one(spark, [("the bank", "I saw The Bank today"), ("ban", "the bank")], "c string, e string", S.in_evidence(F.col("c"), F.col("e"))) == [(True,), (False,)]


def test_vectors(spark):
    got = one(spark, [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>", S.cosine(F.col("a"), F.col("b")), S.edge_weight(F.col("a"), F.col("b")))
    assert [round(g[0], 9) for g in got] == [0.96, 0.0, -1.0] and got[2][1] == 0.001


def test_sentences(spark):
    text = "Dr. Smith came. He said: No! Really? e.g. this stays. End"
    assert one(spark, [(text,)], "t string", T.sentences(F.col("t")))[0][0] == ["Dr. Smith came.", "He said: No!", "Really?", "e.g. this stays.", "End"]


def test_sentences_keep_digits_of_their_index(spark):
    text = " ".join(f"{k} is {k}." if k % 2 else f"x{k} y{k}!" for k in range(14)) + "\n  padded. "
    want = [f"{k} is {k}." if k % 2 else f"x{k} y{k}!" for k in range(14)] + ["padded."]
    assert one(spark, [(text,)], "t string", T.sentences(F.col("t")))[0][0] == want


def test_clean_and_tokens(spark):
    assert one(spark, [("[EN] Jo Doe said from the Greens that  we   agree ",)], "t string", T.clean_segment(F.col("t"))) == [("we agree",)]
    assert one(spark, [("It's a co-op, the UN won't",)], "t string", T.tokens(F.col("t"), ["the"]))[0][0] == ["it's", "co-op", "won't"]


def test_times(spark):
    rows = [("2024-01-02 03:04:05",), ("Tuesday 23 December 2025, 07:46",), ("2024-01-02 03:04",), ("02/01/2024 03:04:05",), ("02/01/2024 03:04",), ("nonsense",)]
    d = datetime.datetime
    assert [r[0] for r in one(spark, rows, "x string", T.parse_time(F.col("x")))] == [d(2024, 1, 2, 3, 4, 5), d(2025, 12, 23, 7, 46), d(2024, 1, 2, 3, 4), d(2024, 1, 2, 3, 4, 5), d(2024, 1, 2, 3, 4), None]


def test_interpretation(spark):
    rows = [(0.6, 0.0001), (0.3, 0.02), (-0.1, None), (None, 0.2), (None, None)]
    got = [r[0] for r in one(spark, rows, "s double, p double", T.interpretation(F.col("s"), F.col("p")))]
    assert got == ["Strong cluster separation (silhouette=0.600); Highly significant difference (p<0.001)", "Moderate cluster separation (silhouette=0.300); Marginally significant difference (p<0.05)", "Poor cluster separation (silhouette=-0.100)", "No significant difference (p=0.2000)", "Insufficient data for interpretation"]


@pytest.mark.parametrize(
    ("given", "title"),
    [
        ('{"title": "A", "summary": "s", "findings": []}', "A"),
        ('Text ```json\n{"title": "B"}\n``` more', "B"),
        ('{"title": "a "quoted" word", "summary": "x"}', 'a "quoted" word'),
        ('{"title": "C", "findings": [{"summary": "x"} {"summary": "y"}]}', "C"),
        ('{"title": "D", "findings": [{"summary": "x"', "D"),
        ('{"title": "E", "findings": [{"summary": "x"}', "E"),
    ],
)
def test_json_repair(given, title):
    assert json.loads(repair(given))["title"] == title


def test_json_report(spark):
    rows = [('{"title": "T", "summary": "S", "findings": [{"summary": "a", "explanation": "b"}]}',), ('"title": "only" and rubbish',), ("nothing",), (None,)]
    got = [r.r for r in spark.createDataFrame(rows, "x string").select(report(F.col("x")).alias("r")).collect()]
    assert got[0].findings[0].explanation == "b" and got[1].title == "only" and got[2] is None and got[3] is None


def test_p_values():
    from kgspark.operators.stats import f_p_value, t_p_value

    assert math.isclose(t_p_value(2.228138852, 10), 0.05, abs_tol=1e-8)
    assert math.isclose(f_p_value(4.964602744, 1, 10), 0.05, abs_tol=1e-8)
    assert math.isclose(f_p_value(3.708264, 3, 10), 0.05, abs_tol=1e-6)
    assert t_p_value(0.0, 5) == 1.0
