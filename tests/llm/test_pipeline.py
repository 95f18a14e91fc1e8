"""The pipeline stage by stage against plain rules on its own inputs."""

from collections import Counter, defaultdict

import corpus_pipeline as P
from kgspark.llm import decontam, pii
from kgspark.llm.similar import groups, shingle_hashes


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages(spark, sf):
    start = spark.read.parquet(f"{sf}/documents.parquet")
    given = dict(P.STAGES)
    assert list(given) == ["quality", "near_duplicates", "decontamination", "pii", "mixing"]

    good = given["quality"](spark, start, sf).cache()
    assert good.columns == start.columns and set(rows(good)) <= set(rows(start))
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    judged = [(d in kept, label[d]) for d, *_ in rows(start) if d in label]
    assert sum(k for k, q in judged if q) >= 0.97 * sum(q for _, q in judged) and sum(not k for k, q in judged if not q) >= 0.6 * sum(1 - q for _, q in judged)

    once = given["near_duplicates"](spark, good, sf).cache()
    given_rows = rows(good)
    sets = [set(shingle_hashes(r[1]).tolist()) for r in given_rows]
    root = list(range(len(given_rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i, r in enumerate(given_rows):
        groups[top(i)].append(r[0])
    assert sorted(r[0] for r in rows(once)) == sorted(min(g) for g in groups.values()) and once.columns == start.columns

    clean = given["decontamination"](spark, once, sf).cache()
    items = {str(r.item_id): r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    from kgspark.llm.decontam import windows_of

    patterns = [w for t in items.values() for w in windows_of(t, decontam.WINDOW)]
    free = [r for r in rows(once) if not any(p in " " + b" ".join(decontam.words_of(r[1])).decode("latin-1") + " " for p in patterns)]
    assert sorted(rows(clean)) == sorted(free) and len(free) < once.count()  # every item here has 13 words or more
    assert clean.columns == start.columns

    safe = given["pii"](spark, clean, sf).cache()
    assert safe.columns == start.columns and safe.count() == clean.count()
    assert pii.digest(pii.find(safe)).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    before = {r[0]: r for r in rows(clean)}
    for d, text, _, _, n in rows(safe):
        assert n == (len(text) if text != before[d][1] else before[d][4])

    mixed = given["mixing"](spark, safe, sf)
    got = mixed.collect()
    assert set(start.columns) <= set(mixed.columns) and all(0 < r.taken <= 3 * r["size"] for r in got)
    assert {r.doc_id for r in got} <= {r[0] for r in rows(safe)}


def test_repeated_rows_and_clashing_columns(spark, sf):
    """Every stage on a table that carries the names stages use inside, with repeated rows and a row of nulls."""
    inside = "row id host path p evidence th fp root u v k node i h d t s e base terms spans taken size target _text _hits _spans _b_n_words clean of n".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in inside)
    body = " ".join(f"word{i}" for i in range(80)) + " ann@x.org"
    more = ["x"] * len(inside)
    rows_ = [(1, body, "en", "a", 1, *more), (1, body, "en", "a", 1, *more), (2, body, "en", "b", 1, *more), (3, "other words " * 30, "en", "b", 1, *more), (None,) * (5 + len(inside))]
    docs = spark.createDataFrame(rows_, schema)
    for name, stage in P.STAGES:
        got = stage(spark, docs, sf)
        assert got.columns[: len(docs.columns)] == docs.columns, name
        assert all(r[c] in ("x", None) for r in got.collect() for c in inside), name
    once = P.near_duplicate_stage(spark, docs, sf)
    assert Counter(r.doc_id for r in once.collect()) == Counter({1: 1, 3: 1, None: 1})
    assert P.decontamination_stage(spark, docs, sf).count() == 5
    mixed = P.mixing_stage(spark, docs, sf)
    assert mixed.columns[-3:] == ["taken_", "size_", "target_"] and {r.doc_id for r in mixed.collect()} <= {1, 2, 3}


def test_rows_of_different_groups_stay_whatever_their_ids(spark, sf):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcde")
    docs = spark.createDataFrame([(None, a), (None, b), (None, b), (1, c), (1, d), (1, d), (2, d), (0, c), (None, e), (3, e)], "doc_id long, text string")
    once = P.near_duplicate_stage(spark, docs, sf)
    assert once.columns == docs.columns
    assert Counter(tuple(r) for r in once.collect()) == Counter([(None, a), (None, b), (0, c), (1, d), (3, e)])


def test_near_copies_in_large_buckets(spark):
    """Independent changes to one text, with buckets cut into tiny blocks: the groups are those of all pairs."""
    import random

    rnd = random.Random(3)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base)]
    for _ in range(60):
        x = list(base)
        for _ in range(rnd.choice((1, 3, 6, 9, 14))):
            x[rnd.randrange(len(x))] = f"n{rnd.randrange(10**6)}"
        texts.append(" ".join(x))
    texts += [" ".join(f"{c}{i}" for i in range(50)) for c in "abc"] + [None, "", "one", "one"]
    sets = [frozenset(shingle_hashes(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                root[top(i)] = top(j)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for cap in (4, 2048):
        got = {r.doc_id: r.root for r in groups(frame, bucket_cap=cap).collect()}
        assert len(got) == len(texts) and all((got[i] == got[j]) == (top(i) == top(j)) for i in got for j in got), cap


def test_copies_linked_only_through_their_origin(spark):
    """Copies at 0.88 of their origin and at 0.78 of each other, whatever member a bucket's search starts from, beside lone texts at 0.7 of the origin."""
    import random

    rnd = random.Random(5)

    def changed(words, n):
        at = set(rnd.sample(range(2, 398), n))
        return " ".join(f"n{rnd.randrange(10**9)}" if i in at else w for i, w in enumerate(words))

    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(400)]
        texts += [" ".join(base), *[changed(base, 5) for _ in range(12)], *[changed(base, 14) for _ in range(4)]]
    sets = [frozenset(shingle_hashes(t).tolist()) for t in texts]
    near = [[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if near[i][j]) for i in range(len(texts))]
    assert any(root[i] == root[j] and not near[i][j] for i in range(len(texts)) for j in range(i))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for cap in (2, 5, 512):
        got = {r.doc_id: r.root for r in groups(frame, bucket_cap=cap).collect()}
        assert [[got[i] == got[j] for j in range(len(texts))] for i in range(len(texts))] == [[a == b for b in root] for a in root], cap


def test_run_leaves_only_its_result(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr("kgspark.operators.storage.shared_dir", lambda _: f"file://{tmp_path}")
    mixed = P.run(spark, sf)
    assert mixed.count() > 0 and [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["mixing"]


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0, name
