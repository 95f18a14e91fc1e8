"""Operators against brute force on small graphs, and end to end."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kgspark import pipeline
from kgspark.operators import centrality, communities, enrich, extract, graph, lexical, resolve, stats, topics, vectors


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src string, dst string, weight double")


CLIQUES = [(f"{g}{i}", f"{g}{j}", 1) for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 1)]


def test_segments_and_names(spark):
    df = spark.createDataFrame([("d", " one \n\n\ttwo and rather more words\r\n\x0bthree four"), ("e", None), ("f", "")], "doc_id string, text string")
    got = [tuple(r) for r in lexical.segments(df).orderBy("doc", "segment_idx").select("segment_id", "line_number", "content", "name").collect()]
    assert got == [("d_S0", 0, "one", "one"), ("d_S1", 2, "two and rather more words", "two and rather more..."), ("d_S2", 4, "three", "three"), ("d_S3", 5, "four", "four")]


def test_sentence_chunks(spark):
    long = " ".join(f"{k} is {k}." for k in range(19))
    df = spark.createDataFrame([("d", long), ("e", None), ("f", " \n "), ("g", "One.  Two ")], "doc_id string, text string")
    out = lexical.sentence_chunks(df)
    got = [tuple(r) for r in out.orderBy("doc", "chunk_idx").collect()]
    assert got == [("d", k, " ".join(f"{i} is {i}." for i in range(8 * k, min(8 * k + 8, 19)))) for k in range(3)] + [("f", 0, "\n"), ("g", 0, "One. Two")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_group_jaccard(spark):
    rnd = random.Random(5)
    sets = {f"s{k}": {f"c{rnd.randrange(12)}" for _ in range(rnd.randrange(1, 6))} for k in range(24)} | {"t": {"far"}, "alone": {"c1"}}
    group = {k: 9 if k == "alone" else i % 3 for i, k in enumerate(sets)} | {"none": 0}
    rows = spark.createDataFrame([(k, c) for k, v in sets.items() for c in v] + [("s0", next(iter(sets["s0"])))], "id string, neighbour string")
    out = graph.group_jaccard(rows, spark.createDataFrame(list(group.items()), "id string, group int"))
    got = [tuple(r) for r in out.collect()]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and group[a] == group[b]}
    assert len(got) == len(want) and {(a, b): j for a, b, j in got} == pytest.approx(want) and 0.0 in want.values()


def test_pack():
    text = "aa bb cc dd ee ff"
    got = lexical.pack(text, 8, 3)
    assert all(len(x) <= 8 for x in got) and got[0] == "aa bb cc" and got[1].startswith("cc")
    assert lexical.pack("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9] and lexical.pack("", 5, 1) == []
    assert lexical.pack("short", 100, 10) == ["short"]


def test_budget(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 0), ("b", 0, 0)], "doc string, segment_idx int, chunk_idx int")
    assert lexical.chunk_budget(df, 2, ["doc", "segment_idx", "chunk_idx"]).count() == 2 and lexical.chunk_budget(df, 0, ["doc"]).count() == 3
    counts = spark.createDataFrame([("a", 2), ("b", 1), ("c", 5)], "doc string, n_chunks int")
    assert [r.doc for r in lexical.documents_read(counts, 3).orderBy("doc").collect()] == ["a", "b"]


def test_default_extractor(spark):
    rows = [("Ursula von der Leyen met Emmanuel Macron in Brussels.",), ("we discuss migration policy with partners",), ("",)]
    got = [[(m.name, m.label) for m in r.mentions] for r in extract.default_extraction(spark.createDataFrame(rows, "text string")).collect()]
    assert got[0][:3] == [("URSULA_VON_DER_LEYEN", "PERSON"), ("EMMANUEL_MACRON", "PERSON"), ("BRUSSELS", "LOCATION")]
    assert [n for n, _ in got[1]] == ["DISCUSS_MIGRATION", "POLICY_WITH", "PARTNERS"] and got[2] == []


def test_candidate_labels(spark):
    space = extract.label_space(spark, ["Person", "Commission", "Country", "Regulation", "Summit"])
    df = spark.createDataFrame([(1, "The president of the commission spoke on sanctions"), (2, "nothing here")], "id int, text string")
    got = {r.id: r.labels for r in extract.candidate_labels(df, "id", "text", space, 3).collect()}
    assert got[1][0] == "ORGANIZATION" and set(got[1]) == {"ORGANIZATION", "PERSON", "POLICY"} and got[2] == ["EVENT", "LOCATION", "ORGANIZATION"]
    m = spark.createDataFrame([("the summit", "EVENT"), ("Kremlin", "LOCATION"), ("x", "OTHER")], "text string, label string")
    assert [r.ontology_label for r in extract.refine_labels(m, space).collect()] == ["SUMMIT", "ORGANIZATION", "OTHER"]


def test_eligible(spark):
    rows = [("c", 0, "Abc", "PERSON", 0.9), ("c", 1, "Jo Doe", "PERSON", 0.9), ("c", 2, "Vote", "EVENT", 0.4), ("c", 3, "Jo Doe", "PERSON", 0.9), ("d", 0, "Smith", "PERSON", 0.9)]
    df = spark.createDataFrame(rows, "chunk_id string, pos int, text string, ontology_label string, confidence double").withColumn("label", F.col("ontology_label"))
    assert {r.chunk_id: r.names for r in extract.eligible(df).collect()} == {"c": ["JO_DOE"], "d": ["SMITH"]}


def test_ground(spark):
    rows = [("A b", "rel", "C", "x", ["A b", "C"]), ("", "rel", "C", "x", ["C"]), ("Zed", "rel", "C", "Zed and C", ["C"])]
    df = spark.createDataFrame(rows, "source string, relation string, target string, evidence string, hints array<string>")
    assert [r.drop_reason for r in extract.ground(df).collect()] == [None, "missing_triplet_field", "endpoint_not_grounded_in_hints"]


def test_coreference():
    assert enrich.leaders(["EUROPEAN_COMMISSION", "EUROPEAN_COMMISSIONS", "BANK"], 0.85) == {"EUROPEAN_COMMISSION": "EUROPEAN_COMMISSIONS", "EUROPEAN_COMMISSIONS": "EUROPEAN_COMMISSIONS", "BANK": "BANK"}


def test_upserts(spark):
    df = spark.createDataFrame([("a", "b", 1, "X", 0.1), ("a", "b", 2, "Y", None), ("b", "a", 1, "Z", 0.3)], "src string, dst string, ord int, label string, confidence double")
    got = {(r.src, r.dst): (r.label, r.confidence) for r in enrich.upsert_edges(df, ["label", "confidence"]).collect()}
    assert got == {("a", "b"): ("Y", 0.1), ("b", "a"): ("Z", 0.3)}
    typed = spark.createDataFrame([("n", None, "Concept", 1), ("n", None, "PERSON", 2), ("m", "ORG", "PERSON", 1), ("o", None, None, 1)], "name string, llm_type string, ner_label string, ord int")
    assert {r.id: r.ontology_class for r in enrich.entity_nodes(typed).collect()} == {"n": "PERSON", "m": "ORG", "o": "Concept"}


def test_merge_nodes(spark):
    e = spark.createDataFrame([("x", "k", 2.0, "own"), ("x", "g", 5.0, "gone"), ("g", "k", 1.0, "between"), ("g", "y", 3.0, "moved"), ("g", "g", 1.0, "loop")], "src string, dst string, weight double, label string")
    n = spark.createDataFrame([("x",), ("k",), ("g",), ("y",)], "id string")
    m = spark.createDataFrame([("g", "k")], "source string, target string")
    nodes, edges = graph.merge_nodes(n, e, m)
    assert {r.id for r in nodes.collect()} == {"x", "k", "y"}
    assert {(r.src, r.dst): (r.weight, r.label) for r in edges.collect()} == {("x", "k"): (5.0, "own"), ("k", "y"): (3.0, "moved"), ("k", "k"): (1.0, "loop")}


def test_resolution(spark):
    rows = [("1", "European Commission", "ORG"), ("2", "European Commissions", "ORG"), ("3", "Energy dependence", "POLICY"), ("4", "Energy independence", "POLICY"), ("5", "President", "PERSON"), ("6", "President Draghi", "PERSON")]
    n = spark.createDataFrame([(a, b, c, None) for a, b, c in rows], "id string, name string, ontology_class string, aliases array<string>")
    e = spark.createDataFrame([("1", "3", "L", 1.0), ("1", "4", "L", 1.0)], "src string, dst string, label string, weight double")
    nodes, edges, merges = resolve.resolve(n, e, 0.95)
    assert [(r.source, r.target) for r in merges.collect()] == [("2", "1")] and nodes.count() == 5
    assert {r.id: r.aliases for r in graph.alias_union(n, merges).collect()}["1"] == ["2", "European Commissions"]
    told = {(r.metric, r.key): r.value for r in resolve.effect(n, nodes, edges).collect()}
    assert told["before", None] == 6 and told["after", None] == 5 and told["merged", None] == 1 and told["top_degree", "1"] == 2


def test_leiden_cliques(spark):
    ids = sorted({x for a, b, _ in CLIQUES for x in (a, b)})
    at = {x: i for i, x in enumerate(ids)}
    part = communities.leiden([(at[a], at[b], w) for a, b, w in CLIQUES], len(ids))
    assert len(set(part)) == 2 and len({part[at[f"a{i}"]] for i in range(5)}) == 1
    e = edges_of(spark, CLIQUES)
    nodes = spark.createDataFrame([(x,) for x in [*ids, "alone"]], "id string")
    got = {r.id: r.community for r in communities.partition(nodes, e).collect()}
    assert got["a1"] == got["a4"] != got["b2"] and got["alone"] == 2 and set(got.values()) == {0, 1, 2}
    for most in (1, 4):  # coarsened over the cluster to the end, or until Leiden takes over
        large = {r.id: r.rep for r in communities.detect(e, task_edges=most).collect()}
        assert set(large) == set(ids) and set(large.values()) == {"a0", "b0"} and all(large[x][0] == x[0] for x in ids), most


def test_coarsened_communities_reach_the_modularity_of_one_task(spark):
    rnd = random.Random(1)
    pairs = [(i, j, 1.0) for i in range(240) for j in range(i) if rnd.random() < (0.35 if i % 6 == j % 6 else 0.01)]
    e = spark.createDataFrame(pairs, "src long, dst long, weight double")
    q = [graph.modularity(e, communities.detect(e, task_edges=n).withColumnRenamed("rep", "community"), directed=False).first()[0] for n in (10**6, 300)]
    assert q[1] > 0.97 * q[0] > 0.5


def test_leiden_is_connected_and_better_than_one_community():
    rnd = random.Random(4)
    n = 60
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(160)) if a != b})
    part = communities.leiden([(a, b, 1.0) for a, b in edges], n, seed=1)
    assert part == communities.leiden([(a, b, 1.0) for a, b in edges], n, seed=1)
    m, deg = len(edges), np.bincount(np.array(edges).ravel(), minlength=n)
    q = sum(part[a] == part[b] for a, b in edges) / m - sum(deg[[i for i in range(n) if part[i] == c]].sum() ** 2 for c in set(part)) / (2 * m) ** 2
    assert q > 0.3
    for c in set(part):
        members = {i for i in range(n) if part[i] == c}
        seen, todo = set(), [next(iter(members))]
        while todo:
            v = todo.pop()
            seen.add(v)
            todo += [b if a == v else a for a, b in edges if v in (a, b) and (b if a == v else a) in members - seen]
        assert seen == members


def test_subcommunities(spark):
    e = edges_of(spark, CLIQUES)
    parts = spark.createDataFrame([(f"{g}{i}", 0) for g in "ab" for i in range(5)], "id string, community long")
    got = {r.id: r.sub_id for r in communities.subcommunities(e, parts).collect()}
    assert len(got) == 10 and got["a0"] == got["a3"] == 0 and got["b1"] == 1


def test_communities_with_held_nodes_as_by_joins(spark):
    e = edges_of(spark, CLIQUES)
    parts = spark.createDataFrame([(f"{g}{i}", 7) for g in "ab" for i in range(5)] + [("c0", 3)], "id string, community long")
    for most in (4, 10**6):
        found = [sorted(map(tuple, communities.detect(e, task_edges=most, held_nodes=n).collect())) for n in (0, 100)]
        assert found[0] == found[1] and len(found[0]) == 10
    subs = [sorted(map(tuple, communities.subcommunities(e, parts, task_edges=most, held_nodes=n).collect())) for most, n in ((10**6, 0), (10**6, 100), (4, 100))]
    assert subs[0] == subs[1] == subs[2] and len(subs[0]) == 10


def floyd(n, edges):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b in edges:
        d[a, b] = 1
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k], :])
    return d


def test_path_centralities(spark):
    rnd = random.Random(2)
    n = 9
    edges = sorted({(a, b) for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(22)) if a != b})
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id int")
    e = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src int, dst int, weight double")
    got = {r.id: r for r in centrality.path_centralities(nodes, e, blocks=3).collect()}
    d = floyd(n, edges)
    paths = np.zeros((n, n))
    for s in range(n):
        order = sorted(range(n), key=lambda v: d[s, v])
        paths[s, s] = 1
        for v in order:
            if v != s and np.isfinite(d[s, v]):
                paths[s, v] = sum(paths[s, u] for u, w in edges if w == v and d[s, u] + 1 == d[s, v])
    for v in range(n):
        b = sum(paths[s, v] * paths[v, t] / paths[s, t] for s in range(n) for t in range(n) if len({s, t, v}) == 3 and np.isfinite(d[s, t]) and d[s, v] + d[v, t] == d[s, t])
        assert abs(got[v].betweenness - b / ((n - 1) * (n - 2))) < 1e-9
        into = [d[u, v] for u in range(n) if u != v and np.isfinite(d[u, v])]
        assert abs(got[v].closeness - ((len(into) / sum(into)) * len(into) / (n - 1) if into else 0)) < 1e-9
        assert abs(got[v].harmonic - sum(1 / x for x in into)) < 1e-9


def test_pagerank_and_eigenvector(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "d")]
    ids = "abcde"
    m = np.zeros((5, 5))
    for s, t in edges:
        m[ids.index(t), ids.index(s)] = 1
    out = m.sum(axis=0)
    p = np.full(5, 0.2)
    for _ in range(200):
        p = 0.15 / 5 + 0.85 * (m @ np.where(out > 0, p / np.where(out > 0, out, 1), 0) + p[out == 0].sum() / 5)
    nodes = spark.createDataFrame([(x,) for x in ids], "id string")
    e = edges_of(spark, [(a, b, 1) for a, b in edges])
    got = {r.id: r.score for r in centrality.pagerank(nodes, e, rounds=40, tolerance=1e-6).collect()}
    assert max(abs(got[x] - p[i]) for i, x in enumerate(ids)) < 1e-3
    katz = np.linalg.solve(np.eye(5) - 0.1 * m, np.ones(5))
    got = {r.id: r.score for r in centrality.power_scores(nodes, e, alpha=0.1, rounds=12, tolerance=1e-6).collect()}
    assert max(abs(got[x] - katz[i] / np.linalg.norm(katz)) for i, x in enumerate(ids)) < 1e-4


def test_current_flow(spark):
    path = edges_of(spark, [("a", "b", 1), ("b", "c", 1)])
    got = {r.id: r.betweenness for r in centrality.current_flow(spark.createDataFrame([("a",)], "id string"), path).collect()}
    assert abs(got["b"] - 1) < 1e-9 and abs(got["a"]) < 1e-9


def test_permutation_and_walks(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, i % 2, [float(x) for x in rnd.normal(5 * (i % 2), 1, 3)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, label int, embedding array<double>")
    row = stats.permutation_test(df, "label", 0, 1, shuffles=50).first()
    assert row.n == 30 and row.p == pytest.approx(1 / 51)
    found = vectors.node2vec(edges_of(spark, CLIQUES), dim=4, walk_length=4, walks=2)
    assert found.count() == 10 and len(found.first().structural) == 4
    w = vectors.structural_weights(edges_of(spark, CLIQUES), found)
    assert w.count() == len(CLIQUES) and w.agg(F.min("weight")).first()[0] >= 0.001


def test_budgeted_contexts(spark):
    a = spark.createDataFrame([("e1", 0), ("e2", 0)], "id string, community int")
    ents = spark.createDataFrame([("e1", "E1", 3), ("e2", "E2", 5)], "id string, name string, degree int")
    rel = spark.createDataFrame([(0, "e1", "KNOWS", "e2")], "community int, src string, label string, dst string")
    ch = spark.createDataFrame([(0, f"c{i:02d}", i, "<b> " + "w" * 3000) for i in range(30)], "community int, chunk_id string, ord int, text string")
    r = topics.contexts(a, ents, rel, ch).first()
    assert r.entities == ["E2", "E1"] and r.relationships == ["e1 KNOWS e2"] and len(r.chunk_texts) == 15 and "&lt;b&gt;" in r.chunk_texts[0] and "..." in r.chunk_texts[0]
    s = topics.template_summary(topics.contexts(a, ents, rel, ch)).first()
    assert s.title == "E2 / E1" and s.chunk_count == 15
    said = topics.summarise(topics.contexts(a, ents, rel, ch), lambda: lambda row: '{"title": "T", "summary": "S", "findings": []}').first()
    assert (said.title, said.summary) == ("T", "S")


class Fake:
    def extract(self, batch):
        rows = [x for c, t, h in zip(batch["chunk_id"], batch["text"], batch["hints"], strict=True) for x in ((c, 0, h[0], "X", "REL", h[1], "Y", 0.5, t[:10]), (c, 1, "AAA", "X", "REL", "BBB", "Y", 0.5, t[:10]))]
        return pd.DataFrame(rows, columns=["chunk_id", "pos", "source", "source_type", "relation", "target", "target_type", "confidence", "evidence"])

    def close(self):
        pass


def test_load_centrality(spark):
    """A diamond with a tail: two paths of equal length share a packet equally, also where they differ in the number of ways behind them."""
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("b", "d", 1.0), ("c", "d", 1.0), ("a", "x", 1.0), ("x", "b", 1.0), ("d", "e", 1.0)], "src string, dst string, weight double")
    n = spark.createDataFrame([(x,) for x in "abcdex"], "id string")
    got = {r.id: (round(r.betweenness * 20, 6), round(r.load * 20, 6)) for r in centrality.path_centralities(n, e, directed=True).collect()}
    assert got["d"] == (4.0, 4.0) and got["b"] == got["b"] and got["a"] == (0.0, 0.0)
    assert sum(x[0] for x in got.values()) == sum(x[1] for x in got.values())  # both count every step between


def test_guided_model_keeps_what_is_grounded(spark):
    def call(text, hints, labels):
        if "broken" in text:
            raise ValueError("no")
        if "odd" in text:
            return "not a tuple"
        both = [("EMMANUEL_MACRON", "MET", "GERMANY", {"confidence": 0.8, "evidence": text}), ("EMMANUEL_MACRON", "LIKES", "CHEESE", {}), ("EMMANUEL_MACRON", "", "GERMANY", {})]
        nodes = [{"id": "GERMANY", "type": "|".join(sorted(labels))}, {"id": "EMMANUEL_MACRON", "type": "|".join(hints)}]
        return (both, nodes, {"x": 1}) if "three" in text else (both[:1], nodes)

    chunks = spark.createDataFrame([("a", "three Emmanuel Macron met Germany", ["GERMANY"]), ("b", "two Emmanuel Macron met Germany", None), ("c", "broken", None), ("d", "odd", None), ("e", None, None)], "chunk_id string, text string, entities array<string>")
    mentions = spark.createDataFrame([(x, k, t, "L", o, 0.9) for x in "ab" for k, (t, o) in enumerate([("Emmanuel Macron", "PERSON"), ("Germany", "LOCATION"), ("we", "PERSON")])], "chunk_id string, pos int, text string, label string, ontology_label string, confidence double")
    extract.register("mine", lambda: extract.Adapted(call))
    got = {(r.chunk_id, r.pos): r for r in extract.guided_triplets(chunks, mentions, extract.extractor("mine"), ["EVENT"]).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("b", 0)} and got["a", 0].kept and got["b", 0].kept and got["a", 0].confidence == 0.8
    assert got["a", 1].drop_reason == "endpoint_not_grounded_in_hints" and got["a", 2].drop_reason == "missing_triplet_field"
    assert got["a", 0].target_type == "LOCATION|PERSON" and got["a", 0].source_type == "GERMANY|EMMANUEL_MACRON"
    assert extract.extractor(None) is None and extract.extractor("default") is None
    with pytest.raises(ValueError, match="no extractor"):
        extract.extractor("unknown")


def test_run_from_documents_to_artifacts(spark, tmp_path):
    import json

    from kgspark import run as R
    from kgspark.config import Community, Settings

    people = ["Emmanuel Macron", "Olaf Scholz", "Ursula von der Leyen", "Mario Draghi", "Roberta Metsola"]
    docs = spark.createDataFrame([(i, f"{people[i % 5]} met {people[(i * i + 1) % 5]} in {('Brussels', 'Germany', 'France')[i % 3]}.\n{people[(i + 2) % 5]} spoke to the European Parliament.") for i in range(12)], "doc_id long, text string")
    settings = Settings(community=Community(resolutions=[1.0], n_iterations=1, node2vec_dim=8, walk_length=4, num_walks=2))
    out = R.run(docs, settings, f"{tmp_path}/out", node2vec=True)
    assert out.errors == [] and set(out.stats) == {"extraction", "resolution", "communities", "assembly", "separation", "pruning", "saving"}
    assert out.stats["extraction"]["documents"] == 12 and out.stats["communities"]["weighted"] > 0 and "modularity_baseline" in out.stats["communities"]
    kinds = {r.node_type for r in out.nodes.select("node_type").distinct().collect()}
    assert {"DOC", "SEGMENT", "CHUNK", "ENTITY_CONCEPT", "TOPIC"} <= kinds and out.nodes.where("embedding is null").count() == 0
    assert out.nodes.where("node_type = 'TOPIC' and summary is null").count() == 0
    saved = json.loads(spark.read.text(f"{tmp_path}/out/run.json").first().value)
    assert saved["stats"]["saving"] == {"nodes": out.nodes.count(), "edges": out.edges.count()} and spark.read.text(f"{tmp_path}/out/graph.graphml").where("value like '<node %'").count() == out.nodes.count()
    broken = R.run(docs, settings, extractor="unknown")
    assert broken.errors[0][0] == "extraction" and broken.nodes is None


def test_pipeline_end_to_end(spark):
    docs = spark.createDataFrame([(1, "Ursula von der Leyen met Emmanuel Macron in Brussels.\nEmmanuel Macron went to Germany."), (2, "Olaf Scholz and Emmanuel Macron spoke in France.")], "doc_id int, text string")
    state = pipeline.build_graph(docs)
    ids = {r.id for r in state.nodes.collect()}
    assert {"EMMANUEL_MACRON", "URSULA_VON_DER_LEYEN", "BRUSSELS", "GERMANY", "OLAF_SCHOLZ", "FRANCE"} == ids
    top = graph.degrees(state.relations).orderBy(F.desc("degree")).first()
    assert top.id == "EMMANUEL_MACRON" and top.degree == 5
    nodes, edges = pipeline.lexical_graph(state)
    assert {r.node_type: r["count"] for r in nodes.groupBy("node_type").count().collect()} == {"DOC": 2, "SEGMENT": 3, "CHUNK": 3, "ENTITY_CONCEPT": 6}
    t, te, s = pipeline.summarised_topics(state)
    assert t.where("node_type = 'TOPIC'").count() == s.count() >= 1 and te.where("label = 'IN_TOPIC'").count() == 6
    kept, _ = pipeline.prune(state.nodes, state.relations)
    assert kept.count() == 6
    other = pipeline.build_graph(docs, extractor=Fake)
    assert {r.label for r in other.relations.collect()} == {"REL"} and not {"AAA", "BBB"} & {r.id for r in other.nodes.collect()}
