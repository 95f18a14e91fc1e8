"""RDF/XML ontologies as a triples table, and operators on it."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.labels import DEFAULT_LABELS, local_name, standardize_label, title_case

# Vocabulary URIs.
RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
XML_LANG, XML_BASE = "{http://www.w3.org/XML/1998/namespace}lang", "{http://www.w3.org/XML/1998/namespace}base"
TECHNICAL = ("Thing", "Nothing", "Resource", "Class", "Ontology", "Property", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "NamedIndividual", "Restriction", "List", "Literal", "Datatype", "Statement", "Container", "Bag", "Seq", "Alt")
FRBR_CORE = ("Work", "Expression", "Manifestation", "Item")
TRIPLES = "file string, s string, p string, o string, o_is_uri boolean, lang string"


def _uri(tag: str) -> str:
    return tag[1:].replace("}", "") if tag.startswith("{") else tag


def parse_triples(text: str) -> Iterator[tuple[str, str, str, bool, str | None]]:
    """(s, p, o, o_is_uri, lang) of a document; nodes without a name are blank nodes ``_:n``."""
    root = ET.fromstring(text)
    base, blank = root.get(XML_BASE) or "", iter(range(1 << 60))
    full = lambda x: base + x if x.startswith("#") else x

    def subject(node) -> str:
        for a in ("about", "ID"):
            if (x := node.get(f"{{{RDF}}}{a}")) is not None:
                return full("#" + x if a == "ID" else x)
        return f"_:{node.get(f'{{{RDF}}}nodeID') or next(blank)}"

    def walk(node) -> Iterator:
        s = subject(node)
        yield from described(node, s)

    def described(node, s: str) -> Iterator:
        if node.tag != f"{{{RDF}}}Description":
            yield s, RDF + "type", _uri(node.tag), True, None
        for a, v in node.attrib.items():
            if not a.startswith((f"{{{RDF}}}", "{http://www.w3.org/XML")):
                yield s, _uri(a), v, False, None
        for prop in node:
            p = _uri(prop.tag)
            if (r := prop.get(f"{{{RDF}}}resource")) is not None:
                yield s, p, full(r), True, None
            elif len(prop):
                for child in prop:
                    o = subject(child)
                    yield s, p, o, True, None
                    yield from described(child, o)
            else:
                yield s, p, (prop.text or "").strip(), False, prop.get(XML_LANG)

    for node in root if root.tag == f"{{{RDF}}}RDF" else [root]:
        yield from walk(node)


def triples(spark: SparkSession, folder: str, pattern: str = "*.rdf") -> DataFrame:
    """The triples of all files; a file that doesn't parse is one row with a null subject and the error as object."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    rows += [(name, *t) for t in parse_triples(bytes(content).decode("utf-8"))]
                except Exception as e:
                    rows.append((name, None, None, f"error: {e}", False, None))
            yield pd.DataFrame(rows, columns=["file", "s", "p", "o", "o_is_uri", "lang"])

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content").mapInPandas(work, TRIPLES)


def labels(rdf: DataFrame) -> DataFrame:
    """(s, label): the English label, else one without a language, else any; else the local name in title case."""
    rank = F.when(F.col("lang").startswith("en"), 0).when(F.col("lang").isNull(), 1).otherwise(2)
    said = rdf.where(F.col("p") == RDFS + "label").groupBy("s").agg(F.min(F.struct(rank.alias("r"), "o")).alias("b")).select(F.col("s").alias("_s"), F.col("b.o").alias("label"))
    subjects = rdf.where("s is not null").select("s").distinct()
    return subjects.join(said, subjects.s == said._s, "left").select("s", F.coalesce("label", title_case(local_name(F.col("s")))).alias("label"))


def classes(rdf: DataFrame) -> DataFrame:
    """(s): OWL and RDFS classes without technical ones and blank nodes."""
    typed = rdf.where((F.col("p") == RDF + "type") & F.col("o").isin(OWL + "Class", RDFS + "Class")).select("s").distinct()
    return typed.where(~F.col("s").startswith("_:") & ~local_name(F.col("s")).isin(*TECHNICAL))


def top_classes(rdf: DataFrame, namespace: str | None = None, min_subclasses: int = 0, roots_only: bool = True) -> DataFrame:
    """(s, n_children): classes of a namespace, without a named parent, with enough children."""
    sub = rdf.where((F.col("p") == RDFS + "subClassOf") & F.col("o_is_uri")).select("s", "o").distinct()
    found = classes(rdf)
    if namespace:
        found = found.where(F.startswith("s", F.lit(namespace)))
    if roots_only:
        named = sub.where(~F.col("o").startswith("_:") & (F.col("s") != F.col("o")) & ~local_name(F.col("o")).isin(*TECHNICAL)).select(F.col("s").alias("_c"))
        found = found.join(named, found.s == named._c, "left_anti")
    kids = sub.groupBy(F.col("o").alias("_o")).agg(F.count_distinct("s").alias("n_children"))
    return found.join(kids, found.s == kids._o, "left").select("s", F.coalesce("n_children", F.lit(0)).alias("n_children")).where(F.col("n_children") >= min_subclasses)


def resolve_labels(spark: SparkSession, manual: list[str] | None = None, ontology: DataFrame | None = None, merge: bool = True) -> DataFrame:
    """(label): manual labels with, or replaced by, those of an ontology's classes; seven defaults where there is none."""
    given = spark.createDataFrame([(x,) for x in manual or []], "label string")
    found = given if ontology is None else (given.unionByName(ontology.select("label")) if merge else ontology.select("label"))
    out = found.select(standardize_label(F.col("label")).alias("label")).where("label <> ''").distinct()
    if out.isEmpty():
        out = spark.createDataFrame([(x,) for x in DEFAULT_LABELS], "label string").select(standardize_label(F.col("label")).alias("label"))
    return out.orderBy("label")


def entities(rdf: DataFrame) -> DataFrame:
    """(s, types, label, comment, parents, domains, ranges, equivalents, disjoint, flags): every subject's attributes, collected."""
    pick = lambda p: F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o"))))
    typed = lambda *t: F.coalesce(F.bool_or((F.col("p") == RDF + "type") & F.col("o").isin(*[OWL + x for x in t])), F.lit(False))
    each = rdf.where("s is not null").groupBy("s").agg(
        pick(RDF + "type").alias("types"), F.min(F.when(F.col("p") == RDFS + "comment", F.col("o"))).alias("comment"), pick(RDFS + "subClassOf").alias("parents"),
        pick(RDFS + "domain").alias("domains"), pick(RDFS + "range").alias("ranges"), pick(OWL + "equivalentClass").alias("equivalents"), pick(OWL + "disjointWith").alias("disjoint"),
        pick(OWL + "inverseOf").alias("inverses"), typed("FunctionalProperty").alias("functional"), typed("TransitiveProperty").alias("transitive"), typed("SymmetricProperty").alias("symmetric"),
    )
    kind = lambda t: F.array_contains("types", OWL + t)
    component = F.when(kind("Class") | F.array_contains("types", RDFS + "Class"), "class").when(kind("ObjectProperty"), "object_property").when(kind("DatatypeProperty"), "datatype_property").when(kind("AnnotationProperty"), "annotation_property").when(kind("NamedIndividual"), "individual").when(kind("Ontology"), "ontology").otherwise("other")
    return each.withColumn("component", component).join(labels(rdf), "s")


def statistics(rdf: DataFrame) -> DataFrame:
    """(triples, subjects, predicates, objects, files)."""
    good = rdf.where("s is not null")
    return good.agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("predicates"), F.count_distinct("o").alias("objects"), F.count_distinct("file").alias("files"))


def component_statistics(described: DataFrame) -> DataFrame:
    """(component, n, frbr): counts by component type and the core bibliographic classes among them."""
    return described.groupBy("component").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(local_name(F.col("s")).isin(*FRBR_CORE), local_name(F.col("s"))))).alias("frbr"))


def class_tree(rdf: DataFrame) -> DataFrame:
    """(s, root, depth, path) by a recursive query from the roots down; a class with several parents has several paths. Cycles end where they close; a tree
    deeper than spark.sql.cteRecursionLevelLimit is an error."""
    spark = rdf.sparkSession
    classes(rdf).createOrReplaceTempView("_kg_classes")
    rdf.where((F.col("p") == RDFS + "subClassOf") & F.col("o_is_uri")).select("s", "o").distinct().createOrReplaceTempView("_kg_sub")
    return spark.sql("""
        WITH RECURSIVE tree(s, root, depth, path) AS (
            SELECT c.s, c.s, 0, array(c.s) FROM _kg_classes c LEFT ANTI JOIN (SELECT x.s FROM _kg_sub x JOIN _kg_classes y ON x.o = y.s WHERE x.s <> x.o) p ON c.s = p.s
            UNION ALL
            SELECT k.s, t.root, t.depth + 1, concat(t.path, array(k.s)) FROM tree t JOIN _kg_sub k ON k.o = t.s WHERE NOT array_contains(t.path, k.s))
        SELECT s, root, depth, path FROM tree""")


def related_classes(sub: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(start, s, depth): classes within ``depth`` subclass steps, up or down, at their least depth."""
    step = sub.select(F.col("s").alias("x"), F.col("o").alias("y")).unionByName(sub.select(F.col("o").alias("x"), F.col("s").alias("y"))).distinct()
    found = start.select(F.col("s").alias("start"), "s", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        near = found.where(F.col("depth") == d - 1).join(step, F.col("s") == F.col("x")).select("start", F.col("y").alias("s"), F.lit(d).alias("depth"))
        found = found.unionByName(near).groupBy("start", "s").agg(F.min("depth").alias("depth"))
    return found


def map_entities(names: DataFrame, described: DataFrame) -> DataFrame:
    """(id, s): entities whose standardised name is that of an ontology class."""
    c = described.where("component = 'class'").select("s", standardize_label(F.col("label")).alias("_l"))
    return names.join(c, standardize_label(F.col("name")) == F.col("_l")).select("id", "s")


def ontology_edges(described: DataFrame, mapping: DataFrame) -> DataFrame:
    """(src, dst, label, graph_type): EXAMPLE_OF from entities to classes and the ontology's own relations."""
    rel = lambda c, label: described.select(F.col("s").alias("src"), F.explode(c).alias("dst"), F.lit(label).alias("label"), F.lit("ontology_graph").alias("graph_type"))
    out = mapping.select(F.col("id").alias("src"), F.col("s").alias("dst"), F.lit("EXAMPLE_OF").alias("label"), F.lit("ontology_mapping").alias("graph_type"))
    for column, label in (("parents", "rdfs:subClassOf"), ("equivalents", "owl:equivalentClass"), ("disjoint", "owl:disjointWith"), ("domains", "rdfs:domain"), ("ranges", "rdfs:range")):
        out = out.unionByName(rel(column, label))
    return out


# What file names say of an ontology, first match wins; (type, pattern over the lower-cased name).
FILE_TYPES = (
    ("cdm_extension", "cdm.*plus|plus.*cdm"),
    ("cdm_component", "cdm.*(annotation|datatype|cataloguing|indexation|marc21)|(annotation|datatype|cataloguing|indexation|marc21).*cdm"),
    ("cdm_core", "^cdm(\\.rdf)?$"),
    ("external_standard", "^(skos|dcat|foaf|org|vcard)"),
    ("w3c_standard", "^(owl|rdfs)\\.rdf$"),
    ("eu_vocabulary", "euvoc"),
    ("configuration", "import|policy"),
)
# Colours of nodes, first match wins; (pattern over the URI, colour).
CDM = "http://publications.europa.eu/ontology/cdm#"
NODE_COLOURS = (
    (f"^{CDM}work$", "#FF6B6B"), (f"^{CDM}expression$", "#4ECDC4"), (f"^{CDM}manifestation$", "#45B7D1"), (f"^{CDM}item$", "#96CEB4"), (f"(?i)^{CDM}.*agent", "#FFEAA7"), (f"(?i)^{CDM}.*dossier", "#DDA0DD"),
    (f"(?i)^{CDM}.*event", "#F39C12"), (f"^{CDM}", "#74B9FF"), ("(?i)skos", "#E17055"), ("(?i)dcat", "#A29BFE"), ("(?i)foaf", "#FD79A8"), ("(?i)org", "#FDCB6E"), ("(?i)vcard", "#6C5CE7"),
)
OTHER_COLOUR, NODE_SIZE, CORE_SIZE, SIZE_STEP, SIZE_BOOST = "#B2DFDB", 20, 50, 3, 30


def _first_match(x: Column, rules: tuple[tuple[str, str], ...], otherwise: Column) -> Column:
    """The value of the first (value, pattern) that matches."""
    return F.coalesce(*[F.when(x.rlike(pattern), F.lit(value)) for value, pattern in rules], otherwise)


def ontology_types(rdf: DataFrame) -> DataFrame:
    """(file, ontology_type) by the file's name, else by how many classes and object properties it declares."""
    typed = lambda t: F.count_distinct(F.when((F.col("p") == RDF + "type") & (F.col("o") == OWL + t), F.col("s")))
    each = rdf.where("s is not null").groupBy("file").agg(typed("Class").alias("c"), typed("ObjectProperty").alias("q"))
    by_size = F.when(F.col("c") > 100, "core_ontology").when(F.col("q") > 2 * F.col("c"), "property_ontology").when(F.col("c") > 10, "domain_ontology").otherwise("utility_ontology")
    return each.select("file", _first_match(F.lower("file"), FILE_TYPES, by_size).alias("ontology_type"))


def class_types(rdf: DataFrame) -> DataFrame:
    """(s, ontology_type): each class has the type of the file that declares it; an OWL declaration comes before an RDFS one, then the first file by name."""
    kinds = ontology_types(rdf).withColumnRenamed("file", "_f")
    told = rdf.where((F.col("p") == RDF + "type") & F.col("o").isin(OWL + "Class", RDFS + "Class") & ~F.col("s").startswith("_:"))
    rank = F.struct((F.col("o") != OWL + "Class").alias("rdfs"), F.col("file"))
    return told.join(kinds, told.file == kinds._f).groupBy("s").agg(F.min_by("ontology_type", rank).alias("ontology_type"))


def node_styles(rdf: DataFrame) -> DataFrame:
    """(s, colour, size) of the classes: colour by namespace and name, size by the number of subclasses."""
    kids = rdf.where((F.col("p") == RDFS + "subClassOf") & F.col("o_is_uri")).groupBy(F.col("o").alias("_o")).agg(F.count_distinct("s").alias("k"))
    colour = _first_match(F.col("s"), tuple((c, p) for p, c in NODE_COLOURS), F.lit(OTHER_COLOUR))
    core = F.col("s").isin(*[CDM + x for x in ("work", "expression", "manifestation", "item")])
    size = F.when(core, CORE_SIZE).otherwise(NODE_SIZE) + F.least(F.coalesce("k", F.lit(0)) * SIZE_STEP, F.lit(SIZE_BOOST))
    found = classes(rdf)
    return found.join(kids, found.s == kids._o, "left").select("s", colour.alias("colour"), size.cast("int").alias("size"))
