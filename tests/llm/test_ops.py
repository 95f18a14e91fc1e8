"""Operators against brute-force versions of their contracts, on documents of the smallest table and on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from kgspark.llm import automaton, decontam, licenses, linefreq, mixing, pii, quality, queries, simhash, substrings, tokens, warc

WS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_words", T.LongType())])
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PHRASE = " ".join(f"shared{i}" for i in range(30))
ODD = [
    (1, None, "en", "a", None, 1), (2, "", "en", "a", 0, 2), (3, " \n\t ", None, None, 3, 3), (4, LONG, "en", "a", 1, 4), (5, LONG + " tail", "en", "a", 1, 5),
    (6, "same words here", "en", "b", 1, 6), (6, "same words here", "en", "b", 1, 6), (7, "same words here", "en", None, 1, 7), (None, "same words here", "en", "b", 1, 8),
    (8, f"x y z {PHRASE} end", "de", "b", 1, 9), (9, f"other start {PHRASE}", "de", "c", 1, 9), (10, f"{PHRASE} {PHRASE}", "de", "c", 1, 9),
    (11, "Mail bob.x@ex.org or +1 (202) 555-0143, 10.0.0.255 and 10.0.0.256; card 4111-1111 1111 1111. É ü", "fr", "c", 1, 9),
    (12, "a@b.c_d@e.f ++4912345678901 1.2.3.4.5.6.7.8", "fr", "c", 1, 9), (13, "1 " * 9000, "fr", "c", 1, 9), (14, "word" * 5000, "fr", "d", 1, 9),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """A table folder whose documents are the awkward rows, repeated passages and an extra column with a clashing name."""
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ODD, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return at


def both(spark, sf, folder, name):
    q = queries.queries()[name]
    return [([tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source").collect()], [r.asDict() for r in q(spark, d).collect()]) for d in (sf, folder)]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


def test_op1(spark, sf, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for rows, got in both(spark, sf, folder, "op1_tokens"):
        want = Counter((d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 2048) for d, t, *_ in rows)
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want


def test_splice(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def encode(s):
        e = tok.encode(s, add_special_tokens=False)
        return [(a, b, i) for (a, b), i in zip(e.offsets, e.ids, strict=True)]

    texts = [t for _, t, *_ in docs if len(t) > 3000][:8] + ["x" * 3000, "é<|endoftext|> 1'll" * 200, "á " * 900, "日本語" * 500, "İ ß ǅ  " * 300]
    for t in texts:
        for chunk, overlap in ((200, 20), (1000, 64), (64, 1)):
            assert tokens.splice_count(t, encode, chunk, overlap) == len(tok.encode(t, add_special_tokens=False)), (t[:30], chunk)
    for chunk, overlap in ((200, 20), (1000, 64), (64, 1), (2048, 128)):
        some = [None, "", *texts, "天地玄黄。宇宙洪荒，" * 700, "a b " * 3, "e\u0301 \u0301x" * 900, *(t for _, t, *_ in docs[:60])]
        got = tokens.spliced_counts(some, lambda parts: tok.encode_batch(parts, add_special_tokens=False), encode, chunk, overlap)
        assert got == [len(tok.encode(t or "", add_special_tokens=False)) for t in some]


def test_texts_of_one_chunk_are_encoded_without_offsets(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    asked = {True: [], False: []}

    def batch(fast):
        def call(parts):
            asked[fast] += parts
            return (tok.encode_batch_fast if fast else tok.encode_batch)(parts, add_special_tokens=False)

        return call

    some = [None, "", "a<|endoftext|> b", "x" * 200, "x y " * 50 + "z", *(t for _, t, *_ in docs[:40])]
    got = tokens.spliced_counts(some, batch(False), lambda s: [(a, b, 0) for a, b in tok.encode(s, add_special_tokens=False).offsets], 200, 20, batch(True))
    assert got == [len(tok.encode(t or "", add_special_tokens=False)) for t in some]
    assert asked[True] == [t for t in some if t and len(t) <= 200] and len(asked[False]) > 2


def test_op2(spark, sf, tmp_path):
    pages = [(i, f"http://h/{i}", h) for i, h in enumerate(["a", "b", "a", None, "", "ü" * 5000, "a"])] + [(6, "http://h/6", "a"), (None, None, "a"), (None, "u", "only")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    bundles = warc.write_bundles(warc.resolve(frame), frame_bytes=600, bundle_bytes=2000)
    got = warc.read_bundles(bundles, with_payload=True).collect()
    top = defaultdict(lambda: None)
    for i, _, h in pages:
        if i is not None:
            top[h or ""] = max(i, top[h or ""] if top[h or ""] is not None else -1)
    want = Counter((i, len((h or "").encode()), warc.payload_digest((h or "").encode()), "response" if top[h or ""] in (None, i) else "revisit", None if top[h or ""] in (None, i) else top[h or ""]) for i, _, h in pages)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    content = {r.name: bytes(r.content) for r in bundles.collect()}
    for r in warc.record_index(bundles).collect():
        (_, headers, payload, _), *rest = warc.parse_records(warc.read_record(content[r.name], r.frame, r.offset, r.length))
        assert headers["WARC-Record-ID"] == f"<urn:x-page:{'null' if r.page_id is None else r.page_id}>" and not rest
    import zstandard

    files = {r.name: r.bytes for r in warc.export_bundles(bundles, str(tmp_path)).collect()}
    assert files == {n: len(c) for n, c in content.items()}
    for n in files:  # a plain reader skips the seek table
        with open(tmp_path / n, "rb") as f:
            assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().startswith(b"WARC/1.1")
    assert queries.op2_warc(spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()


def test_op3(spark, sf, folder):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    long = decontam.windows_of("x " * 40, 13)
    assert len(long) == 28
    for rows, got in both(spark, sf, folder, "op3_decontaminate"):
        want = Counter()
        for d, t, *_ in rows:
            n, hit, found = decontam.brute_force(t, items)
            want[d, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n] += 1
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == want


def test_op3_items_without_an_id_and_short_items(spark):
    items = [(None, "Alpha beta gamma"), (None, None), (3, ""), (2, "delta"), (2, "delta"), (10, "epsilon zeta")]
    docs = [(1, "x ALPHA, beta; gamma y"), (1, "x ALPHA, beta; gamma y"), (2, "delta epsilon zeta delta"), (None, "nothing"), (4, None), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, _hits string")
    want = Counter((d, *decontam.brute_force(t, [(None if i is None else str(i), x) for i, x in items])[:2], tuple(decontam.brute_force(t, [(None if i is None else str(i), x) for i, x in items])[2])) for d, t in docs)
    for most in (16_000_000, 300):
        got = decontam.decontaminate(frame, bench, max_pattern_chars=most)
        assert got.columns == ["doc_id", "_hits", "n_words", "n_hit", "items"]
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == want


def test_op3_several_automata(spark, sf):
    d, b = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    one = {r.doc_id: (r.n_hit, r["items"], r.spans) for r in decontam.decontaminate(d.select("doc_id", "text"), b, with_spans=True).collect()}
    many = {r.doc_id: (r.n_hit, r["items"], r.spans) for r in decontam.decontaminate(d.select("doc_id", "text"), b, with_spans=True, max_pattern_chars=40_000).collect()}
    assert one == many and any(v[0] for v in one.values())


def test_decontam_spans():
    text = "É—The,QUICK brown fox"
    assert [text[a:b] for a, b in decontam.original_spans(text, [0, 1])] == ["É—The,QUICK"]


def mix_rules(rows, got):
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WS.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 3 * sizes[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        free -= full
    return sizes, target


def test_op5(spark, sf, folder):
    for rows, got in both(spark, sf, folder, "op5_mix"):
        sizes, target = mix_rules(rows, got)
        by_id = defaultdict(list)
        for d, t, _, s in rows:
            by_id[d].append((len(WS.findall(t or "")), s))
        taken = Counter()
        assert len(got) == len(rows)
        for r in got:
            assert r["size"] in [x for x, _ in by_id[r["doc_id"]]] and 0 <= r["taken"] <= 3 * r["size"]
            s = next(s for x, s in by_id[r["doc_id"]] if x == r["size"] and sizes[s] == r["source_size"])
            assert abs(r["target"] - target[s]) <= 1e-6 * max(1, target[s])
            taken[r["target"], r["source_size"]] += r["taken"]
        for (t, _), n in taken.items():
            assert abs(n - t) <= max(20, 0.01 * t), (n, t)
    again = [r.asDict() for r in queries.op5_mix(spark, folder).collect()]
    key = lambda r: tuple(str(v) for v in r.values())
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_apportion(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    for n, seats in ((1, 5), (7, 3), (9, 100), (40, 17), (5, 0)):
        w = [rnd.choice([0, 1, 5, rnd.randrange(1000)]) for _ in range(n)]
        want = [0] * n
        for _ in range(seats if sum(w) else 0):
            k = max(range(n), key=lambda i: (w[i] / (2 * want[i] + 1), -i))
            want[k] += 1
        frame = spark.createDataFrame([(i, x, seats, 1) for i, x in enumerate(w)], "i int, w long, seats long, g int")
        got = {r.i: r.quota for r in mixing.apportion(frame, ["g"], "w", "seats", [F.col("i")]).collect()}
        assert [got[i] for i in range(n)] == want, (w, seats)


def repeats_rules(rows):
    least = {}
    for d, t, *_ in rows:
        w = WS.findall(t or "")
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            if d is not None and (k not in least or d < least[k]):
                least[k] = d
    out = Counter()
    for d, t, *_ in rows:
        w = WS.findall(t or "")
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and least[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out[d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("how", [{}, {"broadcast_keys": 0}, {"hot_passages": 1}, {"shard_words": 1}])
def test_op6(spark, sf, folder, how):
    for d in (sf, folder):
        frame = spark.read.parquet(f"{d}/documents.parquet")
        rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(frame, **how).collect())
        assert got == repeats_rules(rows)


def test_automaton():
    rnd = random.Random(5)
    for _ in range(60):
        seqs = [([rnd.choice("abc") for _ in range(rnd.randrange(12))], rnd.randrange(9)) for _ in range(rnd.randrange(1, 7))]
        auto = automaton.SuffixAutomaton()
        for s, o in seqs:
            auto.add(s, o)
        auto.seal()
        asked = [rnd.choice("abc") for _ in range(15)]
        for size in (1, 2, 4):
            for i, owner in enumerate(auto.owners(asked, size)):
                w = asked[i : i + size]
                assert owner == min((o for s, o in seqs if any(s[j : j + size] == w for j in range(len(s) - size + 1))), default=None)


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_rules(text):
    spans = []
    for rank, (kind, p) in enumerate(KINDS.items()):
        for m in re.finditer(p, text or "") if kind != "email" or "@" in (text or "") else ():
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            spans.append((m.start(), rank, m.end(), kind))
    return sorted(spans)


def test_op7(spark, sf, folder):
    for rows, got in both(spark, sf, folder, "op7_pii"):
        want = Counter()
        for d, t, *_ in rows:
            s = base_rules(t)
            text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
            want[(d, *(sum(x[3] == k for x in s) for k in KINDS), hashlib.sha256(text.encode()).hexdigest())] += 1
        assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
        for r in got:
            kinds = [x.split(":")[0] for x in r["spans"].split(",") if x]
            assert [kinds.count(k) for k in KINDS] == [r[f"n_{k}"] for k in KINDS]


def test_pii_terms(spark):
    rows = [(i, f"Our zanzibarist wrote from ann@x.org to us{i} about plain things.") for i in range(12)] + [(100 + i, "Plain things and other plain words about nothing.") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(frame)).collect()}
    text = rows[0][1]
    terms = {text[int(a) : int(b)] for k, a, b in (x.split(":") for x in got[0].split(",")) if k == "term"}
    assert "zanzibarist" in terms and not {"plain", "things", "about"} & terms and got[100] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert "ann@x.org" not in clean[0] and "[EMAIL]" in clean[0] and "zanzibarist" not in clean[0] and clean[100] == rows[12][1]


def term_rules(texts, support=pii.SUPPORT, max_bits=pii.MAX_BITS, min_gain=pii.MIN_GAIN):
    """Term spans by text, entity by entity: which texts hold it, which terms they hold outside base spans, which of these disclose it."""
    import math

    texts = [t for t in texts if t is not None]
    rows_of, base = Counter(texts), {t: base_rules(t) for t in set(texts)}
    holds = defaultdict(set)
    for t, spans in base.items():
        for a, _, b, k in spans:
            holds[k, t[a:b].lower() if k == "email" else re.sub("[^0-9.]", "", t[a:b])].add(t)
    letters = re.compile(r"[^\W\d_]+")
    n_t = Counter()
    for t, c in rows_of.items():
        n_t.update(dict.fromkeys({w.lower() for w in letters.findall(t)}, c))
    free = {t: [(m.start(), m.end(), m[0].lower()) for m in letters.finditer(t) if not any(a < m.end() and m.start() < b for a, _, b, _ in spans)] for t, spans in base.items() if spans}
    out = defaultdict(set)
    for inside in set(map(frozenset, holds.values())):
        n_e = sum(rows_of[t] for t in inside)
        for w in {w for t in inside for _, _, w in free[t]}:
            own = [t for t in inside if any(x[2] == w for x in free[t])]
            sure = math.log2(sum(rows_of[t] for t in own) / (n_t[w] + 1))
            if len(own) >= support and -sure <= max_bits and sure - math.log2(n_e / len(texts)) >= min_gain:
                for t in own:
                    out[t] |= {(a, b) for a, b, x in free[t] if x == w}
    return out


def test_pii_terms_against_brute_force(spark, docs):
    rnd = random.Random(7)
    mine = []
    for i in range(60):
        who = rnd.choice("abcde")
        words = [rnd.choice(["plain", "things", "zeta", who + "ist", who + "like", "mail"]) for _ in range(12)]
        mine.append(f"{' '.join(words)} {who}@x.org tel +1 202 555 01{ord(who)} {i if i % 3 else ''}")
    texts = [*mine, *mine[:9], None, "", "all@x.org " * 150 + "word", *(t for _, t, *_ in docs)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    want = term_rules(texts)
    got = {r.id: {(x.s, x.e) for x in r.terms} for r in pii.find(frame).collect()}
    assert got == {i: want.get(t, set()) for i, t in enumerate(texts)} and any(want.values())
    safe = pii.sanitise(frame)
    assert safe.columns == frame.columns and {r.spans for r in safe.collect()} == {"x"}


def simhash_rules(rows):
    import xxhash

    prints = []
    for _, t, *_ in rows:
        w = WS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[i : i + 4] for i in range(len(w) - 3)] if len(w) >= 4 else [w] if w else [])]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, *_) in enumerate(rows))


def test_op8(spark, sf, folder):
    for rows, got in both(spark, sf, folder, "op8_simhash"):
        assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == simhash_rules(rows)


@pytest.mark.parametrize("cap", [2, 8, 1000])
def test_covering_links(spark, cap):
    rnd = random.Random(7)
    fps = set()
    for _ in range(25):
        c = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 3, 30])):
            x = c
            for _ in range(rnd.randrange(5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
            c = x if rnd.random() < 0.3 else c
    fps = sorted(fps)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    found = simhash.links(frame, bucket_cap=cap)
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 64 for r in found.take(5))
    root = {x: x for x in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[top(a)] = top(b)
    from kgspark.operators.components import components

    got = {r.node % 2**64: r.root % 2**64 for r in components(found).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for x in fps:
        groups[got.get(x, x)].add(x)
        want[top(x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_runs_cuts_start_inside_the_batch():
    batches = [pa.RecordBatch.from_arrays([pa.array(k, pa.int64())] * 2, names=["t", "z"]) for k in ([1, 1, 2], [2, 2], [], [3], [3, 3])]
    seen = []
    for batch, cuts in simhash._runs(iter(batches), ["t", "z"]):
        keys = batch.column(0).to_pylist()
        assert cuts[0] == 0 and all(0 <= c < batch.num_rows for c in cuts)
        seen += [keys[a:b] for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]
    assert seen == [[1, 1], [2, 2, 2], [3, 3, 3]]


def test_op8_buckets_over_the_cap(spark):
    """A family larger than the cap comes out as it does where every bucket is compared in one task."""
    base = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    small, large = ({tuple(r) for r in simhash.near_duplicates(frame, bucket_cap=cap).collect()} for cap in (4, 1024))
    assert small == large and len(small) == 40 and len({c for _, _, c in small}) < 40


def test_every_pair_within_the_radius_collides():
    rnd, family = random.Random(1), simhash.masks()
    for _ in range(3000):
        d = sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5)))
        assert any(not d & m for m in family)


def test_op9_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    train, test = labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r.doc_id: r.evidence.kept for r in quality.score(docs, train, keep=["doc_id"]).collect()}
    good = [got[i] for i, q in test.items() if q == 1]
    bad = [not got[i] for i, q in test.items() if q == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) > 0.8


def test_op9_odd(spark, folder):
    got = queries.op9_quality(spark, folder).collect()
    assert len(got) == len(ODD) and all(0 <= r.p <= 1 for r in got)
    bare = quality.score(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").limit(0)).collect()
    assert all(r.evidence.kept for r in bare)


def bins_of(text):
    """The eight figures of a text by plain rules, as bins."""
    import math

    t = text or ""
    w = WS.findall(t)
    n = max(1, len(w))
    same, i = 0, 0
    while i + 1 < len(w):  # a pair of equal neighbours is used up
        same, i = (same + 1, i + 2) if w[i] == w[i + 1] else (same, i + 1)
    log = lambda x: math.floor(math.log2(1 + 63 * x))
    raw = [log(len(re.findall(p, t)) / n) for p in (r"[#*$%&|<>]", "[A-Z]", "!")] + [math.floor(11 * len(set(w)) / n), log(same / n), math.floor(math.log2(n)), math.floor(len(t) / n), log(len(re.findall("[0-9]", t)) / n)]
    return [min(max(x, 0), quality.BINS - 1) for x in raw]


def test_op9_against_brute_force(spark, sf):
    """Naive Bayes over bins, moments between sites, shrinkage and combination, in plain Python."""
    import math

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang").collect()]
    odd = [(-1, None, None, None), (-2, "", "a", None), (-3, "x" * 100 + " " + "x" * 100 + " y y y", None, "en"), (-3, "again", None, "en")]
    frame = spark.createDataFrame([(*r, "p", "q", "r") for r in rows + odd], "doc_id long, text string, source string, lang string, p string, row string, evidence string")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    said = defaultdict(list)
    for r in labels.collect():
        said[r.doc_id].append(r.quality)
    counts, seen = [[[1.0] * quality.BINS for _ in range(2)] for _ in range(8)], [1.0, 1.0]
    bins = [bins_of(t) for _, t, *_ in rows + odd]
    for (d, *_), b in zip(rows + odd, bins, strict=True):
        if d in said:
            q = int(sum(said[d]) / len(said[d]) >= 0.5)
            seen[q] += 1
            for k in range(8):
                counts[k][q][b[k]] += 1
    p_doc = []
    for b in bins:
        x = math.log(seen[1] / seen[0]) + sum(math.log(c[1][b[k]] / sum(c[1])) - math.log(c[0][b[k]] / sum(c[0])) for k, c in enumerate(counts))
        p_doc.append(min(max(1 / (1 + math.exp(-x)), 1e-9), 1 - 1e-9))
    mean = sum(p_doc) / len(p_doc)

    def sites(key):
        at = defaultdict(list)
        for r, p in zip(rows + odd, p_doc, strict=True):
            at[key(r)].append(p)
        many = [v for v in at.values() if len(v) > 1]
        n = sum(map(len, many))
        b = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in many)
        w = sum(sum((x - sum(v) / len(v)) ** 2 for x in v) / (len(v) - 1) for v in many)
        between = max(0.0, b - w) / n
        return at, min(quality.MAX_STRENGTH, max(quality.MIN_STRENGTH, mean * (1 - mean) / between - 1)) if between > 0 else quality.MAX_STRENGTH

    (hosts, k_host), (paths, k_path) = sites(lambda r: r[2]), sites(lambda r: (r[2], r[3]))
    at_host = {h: (sum(v) + k_host * mean) / (len(v) + k_host) for h, v in hosts.items()}
    at_path = {h: (sum(v) + k_path * at_host[h[0]]) / (len(v) + k_path) for h, v in paths.items()}
    logit = lambda x: math.log(x / (1 - x))
    want = sorted((d, p, at_host[h], at_path[h, g], 1 / (1 + math.exp(-(logit(p) + logit(at_path[h, g]) - logit(mean))))) for (d, _, h, g), p in zip(rows + odd, p_doc, strict=True))
    scored = quality.score(frame, labels)
    assert scored.columns == [*frame.columns, "evidence_"]
    got = sorted((r.doc_id, *(r.evidence_[x] for x in ("p_doc", "p_host", "p_path", "p"))) for r in scored.collect())
    assert len(got) == len(want) and all(g[0] == w[0] and all(abs(a - b) < 2e-6 for a, b in zip(g[1:], w[1:], strict=True)) for g, w in zip(got, want, strict=True))
    assert all(r.evidence_.kept == (r.evidence_.p >= quality.THRESHOLD) for r in scored.collect())


def line_rules(rows):
    out = Counter()
    for d, t, *_ in rows:
        t = t or ""
        w, seen, dup = WS.findall(t), set(), 0
        for line in t.split("\n"):
            if WS.search(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        out[d, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)] += 1
    return out


def test_op10(spark, sf, folder):
    for rows, got in both(spark, sf, folder, "op10_lines"):
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == line_rules(rows)
        assert not any(r["kept"] and r["base_failed"] for r in got)


def test_op10_depleted(spark):
    body = " ".join(f"own{i}" for i in range(60))
    boiler = "\n".join(f"Accept all {i} cookies " + " ".join(f"{c}oiler" for c in "abcdefgh"[: i + 3]) for i in range(5))
    rows = [(i, "h", f"{body} d{i} e{i}\nAccept  all 5 cookies aoiler boiler coiler") for i in range(20)] + [(100 + i, "h", boiler + f"\n{' '.join(f'k{i}x{j}' for j in range(20))}") for i in range(20)] + [(200, "other", boiler)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in linefreq.line_quality(frame, line_limit=10).collect()}
    assert got[0].kept and got[0].n_removed == 7 and not got[100].kept and not got[100].base_failed and got[200].n_removed == 0


def test_op10_returns_texts_without_frequent_lines(spark):
    body = [f"own words of {i} here" for i in range(12)]
    texts = [f"Share\nThe same long line\n\n{b}\n the  SAME long line" for b in body] + [None, "", "alone\n"]
    frame = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in linefreq.line_quality(frame, line_limit=10).collect()}
    assert [got[i].kept_text for i in range(15)] == [f"\n{b}" for b in body] + [None, "", "alone\n"]
    assert [got[i].n_removed for i in range(15)] == [9] * 12 + [0] * 3
    bare = linefreq.line_quality(frame, line_limit=10, with_text=False)
    assert Counter(bare.collect()) == Counter(tuple(getattr(r, c) for c in bare.columns) for r in got.values())


def test_op10_repeated_rows_and_windows_by_words(spark):
    rows = [(1, "a b c d a b c\na b c", "h", "x")] * 15 + [(None, "p q r s t p q r", None, "y"), (2, "z " * 40, "h", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lines string")
    assert linefreq.line_quality(frame, line_limit=10).count() == 17
    w = frame.select("doc_id", linefreq.words(frame.text).alias("w"))
    for distrust in (False, True):
        assert {(r.doc_id, r.n_repeat_words) for r in linefreq._repeats(w, distrust).collect()} == {(1, 9), (None, 6), (2, 40)}


def test_op4(spark):
    rows = [("r/a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("r/a/b/c.txt", "nothing"), ("r/a/b/d.txt", "x\nReleased under the MIT License.\ny"), ("r/e.txt", None), (None, "Released under the MIT License."), ("top", ""), ("r/a/b/c.txt", "nothing")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "path string, text string, p string, up string")
    got = licenses.scan_licenses(frame).collect()
    assert Counter((r.path, r.license, r.inherited_from) for r in got) == Counter({("r/a/LICENSE", "Apache-2.0", None): 1, ("r/a/b/c.txt", "Apache-2.0", "r/a"): 2, ("r/a/b/d.txt", "MIT", None): 1, ("r/e.txt", None, None): 1, (None, None, None): 1, ("top", None, None): 1})
    assert {(r.p, r.up) for r in got} == {("x", "y")}


GPL_NOTICE = """/*
 * frob - frobs things
 * Copyright (C) 2020 A. Author
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful, ...
 */
int main() { return 0; }"""


def test_op4_whole_texts_notices_and_sentences(spark):
    mit, apache, bsd = licenses.TEMPLATES["MIT"][-1], licenses.TEMPLATES["Apache-2.0"], licenses.TEMPLATES["BSD-3-Clause"][-1]
    wrapped = lambda t: "\n".join(" ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    cases = {
        "a/LICENSE": ("MIT License\n\nCopyright (c) 2020 Somebody\n\n" + wrapped(mit), "MIT"), "b/COPYING": ("Copyright 2021 The Holders. All rights reserved.\n\n" + wrapped(bsd), "BSD-3-Clause"),
        "c/x.py": ("# Copyright 2020 X\n#\n# " + wrapped(apache[3]).replace("\n", "\n# ") + "\n#\n# " + wrapped(apache[4]).replace("\n", "\n# ") + "\nimport os", "Apache-2.0"), "d/f.c": (GPL_NOTICE, "GPL-3.0"),
        "e/g.rs": ("// SPDX-License-Identifier: MIT\nfn main() {}", "MIT"), "f/h.go": ("// SPDX-License-Identifier: GPL-3.0-or-later\n", "GPL-3.0"),
        "g/page.txt": ("A long paragraph about gardens and their paths in summer. This work is licensed under the Creative Commons Attribution 4.0 International License. It goes on about roses and hedges for a while.", "CC-BY-4.0"),
        "h/plain.txt": ("You can use this free software version under the terms that you like. " * 5 + "Nothing about rights here.", None), "j/de.txt": ("Mit.\nmit mit\nBSD", None), "i/long.txt": ("word " * 5000 + "\nReleased under the MIT License.", "MIT"),
    }
    frame = spark.createDataFrame([(p, t) for p, (t, _) in cases.items()], "path string, text string")
    assert {r.path: r.license for r in licenses.scan_licenses(frame).collect()} == {p: x for p, (_, x) in cases.items()}


def test_op4_what_a_template_needs():
    _, rows = licenses.weights(licenses.TEMPLATES)
    mass = defaultdict(dict)
    for _, k, t, w in rows:
        mass[k][t] = w * w
    for (few, m), own in zip(licenses.needed(rows, licenses.THRESHOLD), mass.values(), strict=True):
        others = sum(w for t, w in own.items() if t not in few)
        bound = others + sum(sorted((own[t] for t in few), reverse=True)[: m - 1])
        assert m >= licenses.LEAST and (m == licenses.LEAST or bound < licenses.THRESHOLD**2)
        assert not licenses.COMMON & set(few) and not any(t.isdigit() for t in few)
