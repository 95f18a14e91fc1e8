"""Sources, sinks, streams and settings: round trips."""

import datetime
import json

import pytest

from pyspark.sql import functions as F

from kgspark import config
from kgspark.sinks import graph as K
from kgspark.sources import files, rdf
from kgspark.streaming import episodes as E

RDFXML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xml:base="http://x/o">
<owl:Class rdf:about="http://x/o#LegalAct"><rdfs:label xml:lang="fr">Acte</rdfs:label><rdfs:label xml:lang="en">Legal act</rdfs:label></owl:Class>
<owl:Class rdf:about="http://x/o#Directive"><rdfs:subClassOf rdf:resource="http://x/o#LegalAct"/></owl:Class>
<owl:Class rdf:ID="euRegulation"><rdfs:subClassOf rdf:resource="#LegalAct"/><rdfs:subClassOf><owl:Restriction/></rdfs:subClassOf></owl:Class>
<owl:Class rdf:about="http://x/o#Sub"><rdfs:subClassOf rdf:resource="http://x/o#Directive"/></owl:Class>
<owl:ObjectProperty rdf:about="http://x/o#amends"><rdfs:domain rdf:resource="http://x/o#LegalAct"/><rdf:type rdf:resource="http://www.w3.org/2002/07/owl#TransitiveProperty"/></owl:ObjectProperty>
</rdf:RDF>"""


def test_text_source(spark, tmp_path):
    (tmp_path / "b.txt").write_text("two\nlines here", encoding="utf-8")
    (tmp_path / "a.txt").write_text("é", encoding="utf-8")
    (tmp_path / "c.md").write_text("no")
    got = files.text_files(spark, str(tmp_path)).orderBy("filename").collect()
    assert [(r.filename, r.text) for r in got] == [("a.txt", "é"), ("b.txt", "two\nlines here")]
    assert files.text_files(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe\xfa")
    good, bad = files.readable(spark, str(tmp_path))
    assert good.count() == 2 and [r.filename for r in bad.collect()] == ["d.txt"]
    assert files.line_pool(good).count() == 3


def test_lifelog(spark, tmp_path):
    rows = ["Time,Location,Audio,Image", "2024-01-01 10:00:00,Home,hello,1", "2024-01-01 10:05:00,Home,again,2", "2024-01-01 10:10:01,Work,third,3", "Tuesday 23 December 2025, bad,x,y,z"]
    (tmp_path / "life_log_2024-01-01.csv").write_text("\n".join(rows))
    got = files.lifelog(spark, str(tmp_path)).orderBy("episode").collect()
    assert [(r.segment_id, r.rows, r.locations) for r in got] == [("SEGMENT_2024-01-01_EPISODE_000", 2, ["Home"]), ("SEGMENT_2024-01-01_EPISODE_001", 1, ["Work"])]


def test_regex_source(spark):
    docs = spark.createDataFrame([("f_20240102.txt", "A: one\nB: two"), ("g.txt", " none ")], "filename string, text string")
    got = [(r.filename, r.segment_idx, r.content, r.line_number, r.metadata) for r in files.regex_segments(docs, r"^(?P<who>[A-Z]): (?P<text>.*?)$", {"who": "speaker"}).orderBy("filename", "segment_idx").collect()]
    assert got == [("f_20240102.txt", 0, "one", 0, {"speaker": "A"}), ("f_20240102.txt", 1, "two", 7, {"speaker": "B"}), ("g.txt", 0, "none", 0, {})]


def test_speeches(spark):
    docs = spark.createDataFrame([("CRE-20240115-ITM-003_EN.txt", "[EN] Jane Mary Doe said from the Greens that we agree\nnoise\n[EN] Al Bo said from the EPP that no"), ("other.txt", "[EN] X Y said from the Z that q")], "filename string, text string")
    got = files.speeches(docs).orderBy("speech_order").collect()
    assert [(r.first_name, r.last_name, r.party, r.text, r.speech_order) for r in got] == [("Jane", "Doe", "Greens", "we agree", 0), ("Al", "Bo", "EPP", "no", 1)] and got[0].date == datetime.date(2024, 1, 15)


def test_translate(spark):
    df = spark.createDataFrame([("a",), (None,)], "text string")
    assert [r.text for r in files.translate(df, lambda: str.upper).collect()] == ["A", None] and files.translate(df) is df


def test_xml_proceedings(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<R><INTERVENTION><ORATEUR PP="EPP" LIB="Jo Doe"/><PARA>one</PARA><PARA>two</PARA></INTERVENTION></R>')
    assert [tuple(r) for r in files.proceedings(spark, str(tmp_path / "p.xml")).collect()] == [("Jo Doe", "EPP", "Jo Doe said from the EPP that one two")]


def test_rdf(spark, tmp_path):
    (tmp_path / "o.rdf").write_text(RDFXML)
    (tmp_path / "bad.rdf").write_text("<oops")
    t = rdf.triples(spark, str(tmp_path)).cache()
    assert t.where("s is null").count() == 1
    assert {r.s.split("#")[1]: r.label for r in rdf.labels(t).where("not startswith(s, '_:')").collect()} == {"LegalAct": "Legal act", "Directive": "Directive", "euRegulation": "Eu Regulation", "Sub": "Sub", "amends": "Amends"}
    assert [(r.s.split("#")[1], r.n_children) for r in rdf.top_classes(t, "http://x/o#", 1).collect()] == [("LegalAct", 2)]
    d = {r.s.split("#")[-1]: r for r in rdf.entities(t).collect()}
    assert d["amends"].component == "object_property" and d["amends"].transitive and d["amends"].domains == ["http://x/o#LegalAct"] and d["Sub"].parents == ["http://x/o#Directive"]
    assert {r.s.split("#")[1]: r.depth for r in rdf.class_tree(t).collect()} == {"LegalAct": 0, "Directive": 1, "euRegulation": 1, "Sub": 2}
    sub = t.where(F.col("p").endswith("subClassOf") & F.col("o_is_uri") & ~F.col("o").startswith("_:"))
    near = rdf.related_classes(sub, spark.createDataFrame([("http://x/o#Sub",)], "s string")).collect()
    assert {r.s.split("#")[1]: r.depth for r in near} == {"Sub": 0, "Directive": 1, "LegalAct": 2}
    m = rdf.map_entities(spark.createDataFrame([("e1", "legal ACT"), ("e2", "x")], "id string, name string"), rdf.entities(t))
    assert [r.id for r in m.collect()] == ["e1"] and {r.label for r in rdf.ontology_edges(rdf.entities(t), m).collect()} == {"EXAMPLE_OF", "rdfs:subClassOf", "rdfs:domain"}
    assert rdf.statistics(t).first().files == 1 and rdf.component_statistics(rdf.entities(t)).where("component = 'class'").first().n == 4
    assert [r.label for r in rdf.resolve_labels(spark, ["Person", "legal act"], rdf.labels(t).where("s = 'http://x/o#LegalAct'")).collect()] == ["LEGAL_ACT", "PERSON"]
    assert rdf.resolve_labels(spark).count() == 7


def tables(spark):
    n = spark.createDataFrame([("a", "ENTITY", "A & 'b'", ["x"], [0.5]), ("b", "CHUNK", None, [], None)], "id string, node_type string, name string, aliases array<string>, embedding array<double>")
    e = spark.createDataFrame([("a", "b", "KNOWS", 2.0), ("b", "a", "IS<1>", 1.0)], "src string, dst string, label string, weight double")
    return n, e


def test_store_upsert(spark, tmp_path):
    n, e = tables(spark)
    at = str(tmp_path / "store")
    assert K.write_store(n, e, at, clean=True) == {"nodes": 2, "edges": 2}
    more = spark.createDataFrame([("a", "ENTITY", "new"), ("c", "ENTITY", "c")], "id string, node_type string, name string")
    assert K.write_store(more, e, at) == {"nodes": 3, "edges": 2}
    back = spark.read.parquet(f"{at}/nodes")
    assert {r.id: r.name for r in back.collect()} == {"a": "new", "b": None, "c": "c"} and K.duplicate_keys(back, ["id"]).count() == 0


def test_graphml_round_trip(spark, tmp_path):
    n, e = tables(spark)
    K.write_graphml(n, e, str(tmp_path / "g.graphml"))
    nodes, edges = K.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.id: r.attrs.get("name") for r in nodes.collect()} == {"a": "A & 'b'", "b": None}
    assert {(r.src, r.dst): (r.attrs["label"], float(r.attrs["weight"])) for r in edges.collect()} == {("a", "b"): ("KNOWS", 2.0), ("b", "a"): ("IS<1>", 1.0)}


def test_other_sinks(spark, tmp_path):
    n, e = tables(spark)
    lines = [r.line for r in K.cypher_lines(n, e).collect()]
    assert "MERGE (n:`ENTITY` {id: 'a'}) SET n.name = 'A & \\'b\\'';" in lines and len(lines) == 4
    rows = [json.loads(r.json) for r in K.node_link_json(n, e).collect()]
    assert len(rows) == 4 and not any("embedding" in r for r in rows)
    assert K.explorer_tables(n.withColumn("node_type", F.lit("TOPIC")), e)[1].count() == 2
    m = K.manifest(spark, str(tmp_path), "completed", {"llm": {"api_key": "s3cret", "model": "m"}})
    assert m["config"]["llm"] == {"api_key": "***", "model": "m"} and json.load(open(tmp_path / "run_manifest.json"))["status"] == "completed"
    assert "## A" in K.executive_summary({"A": {"k": 1}})
    (tmp_path / "nl.json").write_text(json.dumps({"nodes": [{"id": "a", "node_type": "ENTITY"}], "links": [{"source": "a", "target": "a", "label": "L"}]}))
    a, b = files.node_link(spark, str(tmp_path / "nl.json"))
    assert a.first().id == "a" and b.first().label == "L"


class Client:
    def merge(self, rows):
        assert len(rows) <= 1 and all(v is not None for r in rows for v in r.values())

    def close(self):
        pass


def test_upload(spark):
    assert sum(r.sent for r in K.upload(tables(spark)[0], Client, 1).collect()) == 2


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "user_id", "event_id")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = E.episodes(stream).writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = E.episodes(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert spark.table("sessions").exceptAll(batch).count() == 0 and spark.table("sessions").count() == batch.count()


def test_growing_graph(spark, tmp_path):
    src = str(tmp_path / "edges")
    schema = "src string, dst string, ord int, label string"
    spark.createDataFrame([("a", "b", 1, "X"), ("b", "c", 2, "Y")], schema).coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(schema).parquet(src)
    E.grow(read(), str(tmp_path / "graph"), str(tmp_path / "ck"), ["label"]).awaitTermination()
    spark.createDataFrame([("a", "b", 3, "Z"), ("c", "d", 1, None)], schema).coalesce(1).write.mode("append").parquet(src)
    E.grow(read(), str(tmp_path / "graph"), str(tmp_path / "ck"), ["label"]).awaitTermination()
    assert {(r.src, r.dst): r.label for r in E.current(spark, str(tmp_path / "graph")).collect()} == {("a", "b"): "Z", ("b", "c"): "Y", ("c", "d"): None}


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("extraction:\n  chunk_size: 512 # short\n  labels:\n    - Person\n    - 'Political Party'\ncommunity:\n  resolutions: [0.5, 1.0]\ntest_mode:\n  enabled: true\n  max_chunks: 3\n")
    s = config.load(str(tmp_path / "c.yaml"), {"COMMUNITY__SEED": "7"})
    assert s.extraction.chunk_size == 512 and s.extraction.labels == ["Person", "Political Party"] and s.community.resolutions == [0.5, 1.0] and s.community.seed == 7 and s.chunk_budget == 3
    assert config.read_env("export A='b'\n# c\nD=e=f") == {"A": "b", "D": "e=f"}
    assert config.model_id(config.Llm("m", "", "p")) == "p/m" and config.model_id(config.Llm("p/m", "", "p")) == "p/m"


def test_parsers_by_file_type(spark, tmp_path):
    from kgspark.sources import parsers

    (tmp_path / "2024-03-01_a.txt").write_text("one\n\ntwo\n")
    (tmp_path / "log.csv").write_text("Time,Location,Audio,Image\n2024-01-02 10:00:00,Home,hello,x\n2024-01-02 10:01:00,Home,again,y\n")
    (tmp_path / "b.md").write_text("# A\ntext a\n# B\ntext b\n")
    (tmp_path / "other.bin").write_text("left out")
    mine = parsers.regex_parser("headings", "*.md", r"^# (?P<title>[^\n]+)\n(?P<text>[^\n]+)$", {"title": "title"})
    rows = parsers.read_segments(spark, str(tmp_path), [mine, *parsers.PARSERS]).collect()
    got = {(r.parser, r.filename): [] for r in rows}
    for r in sorted(rows, key=lambda r: r.segment_idx):
        got[r.parser, r.filename].append(r.content)
    assert got["lines", "2024-03-01_a.txt"] == ["one", "two"] and len(got["lifelog", "log.csv"]) == 1 and got["headings", "b.md"] == ["text a", "text b"] and len(got) == 3
    dates = {r.filename: str(r.date) for r in rows}
    assert dates["2024-03-01_a.txt"] == "2024-03-01" and dates["log.csv"] == "2024-01-02" and dates["b.md"] == "None"
    again = parsers.read_segments(spark, str(tmp_path), [parsers.Parser("first", "*.txt", parsers.parse_lines), *parsers.PARSERS])
    assert {r.parser for r in again.where("filename like '%.txt'").collect()} == {"first"}


def test_figure_tables_indexes_and_diagnostics(spark, tmp_path):
    from kgspark.sinks import figures as G

    it = spark.createDataFrame([(0, 0.1, 0.5, 0.5, 4, 6, 2), (1, 0.3, 0.6, 0.4, 8, 20, 3)], "iteration int, modularity double, topic_separation double, topic_overlap double, entities long, relations long, communities long")
    assert {(r.iteration, r.metric): r.change for r in G.evolution(it, ("modularity",)).collect()} == {(0, "modularity"): None, (1, "modularity"): pytest.approx(0.2)}
    assert [round(r.density, 6) for r in G.growth(it).orderBy("iteration").collect()] == [0.5, round(20 / 56, 6)] and G.modularity_and_separation(it).count() == 2
    c = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "label string, centroid array<double>")
    cells = {(r.i, r.j): round(r.sim, 6) for r in G.heatmap(c).collect()}
    assert len(cells) == 9 and cells["a", "b"] == 0 and cells["c", "a"] == cells["a", "c"] == round(0.5**0.5, 6) and cells["b", "b"] == 1
    s = spark.createDataFrame([("t", "x", -1.0), ("t", "x", 0.0), ("t", "y", 1.0), ("t", "y", None)], "level string, label string, s double")
    assert {r.bin: (r.n, r.low) for r in G.silhouette_histogram(s, 4).collect()} == {0: (1, -1.0), 2: (1, 0.0), 3: (1, 0.5)}
    assert [(r.label, r.n, r["mean"]) for r in G.silhouettes_by_group(s).collect()] == [("y", 2, 1.0), ("x", 2, -0.5)]
    assert [r.cumulative for r in G.scree(spark, {"t": [0.5, 0.25]}).collect()] == [0.5, 0.75]
    rep = {1: {"levels": {"TOPIC": {"n": 9, "labels": 3, "silhouette": 0.2, "anova": {"f": 1.0, "p": 0.4, "eta2": 0.1}, "pairwise": [{"significant": True}, {"significant": False}]}, "SUBTOPIC": None}}}
    assert [(r.level, r.significant_pairs, r.pairs) for r in G.statistical_summary(spark, rep).collect()] == [("TOPIC", 1, 2)]
    assert [r.delta for r in G.weighting_impact(0.25, 0.5, spark).collect()] == [0.0, 0.25]
    e = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    assert {(r.graph, r.k): round(r.p, 6) for r in G.degree_distributions({"g": e}).collect()} == {("g", 1): 1.0, ("g", 2): round(1 / 3, 6)}
    bars = G.centrality_bars(spark.createDataFrame([("m", "a", 1.0), ("m", "b", 2.0)], "measure string, id string, score double"), 1)
    assert [(r.id, r.rank) for r in bars.collect()] == [("b", 1)]
    assert {r.figure: r.rows for r in G.write_figures({"bars": bars, "growth": G.growth(it)}, f"{tmp_path}/figures").collect()} == {"bars": 1, "growth": 2}
    n = spark.createDataFrame([("1", "A", [1.0, 2.0]), ("2", "B`", None)], "id string, node_type string, embedding array<double>")
    told = K.index_statements(n)
    assert len(told) == 3 and "`vector.dimensions`: 2" in told[1] and "(n:`B```)" in told[2]
    spark.createDataFrame([("x",)], "stage string").write.json(f"{tmp_path}/diag")
    assert [(r.name, r.rows) for r in K.diagnostic_index(spark, {"chunks": f"{tmp_path}/diag", "gone": f"{tmp_path}/none"}, f"{tmp_path}/index").collect()] == [("chunks", 1)]


def test_ontology_types_and_styles(spark):
    named = {"cdm-plus.rdf": "cdm_extension", "cdm-annotation.rdf": "cdm_component", "cdm.rdf": "cdm_core", "skos-core.rdf": "external_standard", "owl.rdf": "w3c_standard", "my-euvoc.rdf": "eu_vocabulary", "import.rdf": "configuration", "some.rdf": "utility_ontology", "props.rdf": "property_ontology", "dom.rdf": "domain_ontology"}
    row = lambda s, p, o, f: (s, p, o, True, None, f)
    rows = [row(f"http://x/{f}#A", rdf.RDF + "type", rdf.OWL + "Class", f) for f in named if f != "props.rdf"] + [row("http://x/p#q", rdf.RDF + "type", rdf.OWL + "ObjectProperty", "props.rdf")]
    rows += [row(f"http://x/dom#C{i}", rdf.RDF + "type", rdf.OWL + "Class", "dom.rdf") for i in range(12)] + [row("http://x/dom#C1", rdf.RDF + "type", rdf.RDFS + "Class", "cdm.rdf")]
    rows += [row(rdf.CDM + x, rdf.RDF + "type", rdf.OWL + "Class", "cdm.rdf") for x in ("work", "agent_x", "thing")] + [row(f"http://x/dom#C{i}", rdf.RDFS + "subClassOf", rdf.CDM + "work", "dom.rdf") for i in range(12)]
    t = spark.createDataFrame(rows, "s string, p string, o string, o_is_uri boolean, lang string, file string")
    assert {r.file: r.ontology_type for r in rdf.ontology_types(t).collect()} == named
    kinds = {r.s: r.ontology_type for r in rdf.class_types(t).collect()}
    assert kinds["http://x/dom#C1"] == "domain_ontology" and kinds[rdf.CDM + "work"] == "cdm_core"
    styles = {r.s: (r.colour, r.size) for r in rdf.node_styles(t).collect()}
    assert styles[rdf.CDM + "work"] == ("#FF6B6B", 80) and styles[rdf.CDM + "agent_x"] == ("#FFEAA7", 20) and styles[rdf.CDM + "thing"][0] == "#74B9FF" and styles["http://x/dom#C2"][0] == "#B2DFDB"


def test_title_pairs_by_vectors_first(spark):
    from kgspark.operators.resolve import title_pairs

    t = spark.createDataFrame([(1, "energy policy", [1.0, 0.0]), (2, "power rules", [0.99, 0.05]), (3, "energy policies", [0.0, 1.0]), (4, "other", None)], "id long, title string, v array<double>")
    got = {(r.a, r.b): (r.similarity > 0.99, r.duplicate) for r in title_pairs(t, vector="v").collect()}
    assert got == {(1, 2): (True, True), (1, 3): (False, False)}
