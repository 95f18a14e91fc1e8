import json

from kgspark.operators import speech as S
from kgspark.sinks import artifacts


def test_speech_layer(spark, tmp_path):
    rows = [("d1", 0, "Jo Doe", "P"), ("d1", 1, "Al Bo", "Q")]
    nodes, edges = S.speech_graph(spark.createDataFrame(rows, "doc_id string, speech_order int, speaker string, party string"))
    assert nodes.count() == 5 and edges.count() == 4
    m = spark.createDataFrame([("s1", "A"), ("s1", "B"), ("s2", "B"), ("s1", "A")], "speech_id string, name string")
    rel = spark.createDataFrame([("A", "B"), ("B", "C")], "src string, dst string")
    t = S.speech_triples(rel, m)
    assert [(r.speech_id, r.src, r.dst) for r in t.collect()] == [("s1", "A", "B")]
    assert {r.speech_id: (r.entities, r.relations, r.density) for r in S.speech_stats(t, m).collect()} == {"s1": (2, 1, 0.5), "s2": (1, 0, 0.0)}
    who = spark.createDataFrame([("s1", "x"), ("s2", "y")], "speech_id string, speaker_id string")
    assert {(r.src, r.dst): r.weight for r in S.speaker_mentions(m, who).collect()} == {("x", "A"): 2.0, ("x", "B"): 1.0, ("y", "B"): 1.0}
    a = spark.createDataFrame([("A", 0), ("B", 0)], "id string, community long")
    n, e = S.community_nodes(a, spark.createDataFrame([("A", 0, 1)], "id string, community long, sub_id long"))
    assert {r.id for r in n.collect()} == {"COMMUNITY_0", "SUBCOMMUNITY_0_1"} and {(r.src, r.dst, r.label) for r in e.collect()} == {("A", "SUBCOMMUNITY_0_1", "IN_COMMUNITY"), ("B", "COMMUNITY_0", "IN_COMMUNITY"), ("SUBCOMMUNITY_0_1", "COMMUNITY_0", "PARENT_COMMUNITY")}
    artifacts.schema_json(str(tmp_path / "s.json"))
    assert "TOPIC" in json.load(open(tmp_path / "s.json"))["nodes"]
    artifacts.iteration_results(spark, [{"iteration": 0, "modularity": 0.5}], str(tmp_path / "results"))
    from kgspark.sources.files import reports

    (tmp_path / "iteration_0_report.json").write_text('{"a": 1}')
    got = reports(spark, str(tmp_path))
    assert got["results"].first().modularity == 0.5 and got["reports"].first().a == 1
