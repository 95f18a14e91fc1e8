"""PII: base patterns, then information-theoretic sanitisation, in DataFrame functions only.

Base spans (email, ip, card, phone) are found with offsets: the pieces between matches and the matches themselves give every start. The patterns are
written with possessive quantifiers and anchored where a run begins or the last match ended, so no text makes them backtrack in its square.

Sanitisation: a protected entity is the value of a base span; values that always occur in the same texts (a person's address and phone, a page of contacts)
are one entity, told by the set of their texts. Terms are runs of letters, lower-cased, outside base spans, anywhere in a text that holds the entity.
Over the whole corpus n(e), n(t) and n(t, e) count the documents with the entity, the term, and both. A term leaves -log2(n(t, e) / (n(t) + 1)) bits of
uncertainty about the entity and tells that much less than the entity's own information, -log2(n(e) / N). It discloses the entity if it leaves ``max_bits`` or
less and tells ``min_gain`` or more (which no term can of an entity that is in a large part of all documents), and if ``support`` different texts hold both:
fewer prove nothing, since any rare word of one text would. It becomes a span of kind ``term`` wherever it stands in the texts of that entity.

Edge cases: null and empty texts have no spans; repeated rows are documents of their own and get the same spans, but are one text for ``support``; overlapping spans
are merged when a text is rewritten; a null or repeated id changes nothing; an empty table gives an empty result; extra columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import cut, discard, packed

SUPPORT, MAX_BITS, MIN_GAIN, FOLD = 3, 0.5, 2.0, 64
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "(?:\\G|(?<![0-9]))[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth a pass.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = "\\p{L}+"


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")), F.lit(4)).cast("int") <= 255))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "card":
        d = F.split(F.reverse(digits), "")
        luhn = F.aggregate(F.transform(F.filter(d, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(2 * x.cast("int") - F.when(x.cast("int") > 4, F.lit(9)).otherwise(F.lit(0)))), F.lit(0), lambda a, x: a + x)
        return F.when(F.length(digits).between(14, 19), luhn % 10 == 0).otherwise(F.lit(False))
    return F.lit(True)


def located(text: Column, pattern: str) -> Column:
    """array<struct<v, s, e>> of all matches with character offsets (end exclusive).

    Starts are a running sum, folded in blocks of FOLD matches: arrays grow by a block's length and by a block, not by one match each over all of them.
    """
    m, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(a, x):
        s = a["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(x["m"].alias("v"), s.alias("s"), e.alias("e")))).alias("out"))

    def block(a, xs):
        done = F.aggregate(xs, F.struct(a["at"].alias("at"), F.expr(_EMPTY).alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(a["out"], F.array(done["out"])).alias("out"))

    pairs = F.zip_with(m, F.slice(gaps, F.lit(1), F.size(m)), lambda a, b: F.struct(a.alias("m"), F.coalesce(b, F.lit("")).alias("g")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(pairs), F.lit(1)) - 1) / FOLD).cast("int")), lambda k: F.slice(pairs, k * FOLD + 1, F.lit(FOLD)))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_MATCHES}>)").alias("out"))
    return F.flatten(F.aggregate(blocks, start, block, lambda a: a["out"]))


_MATCHES = "array<struct<v:string,s:int,e:int>>"
_EMPTY = f"cast(array() as {_MATCHES})"


def base_spans(text: Column, kind: str) -> Column:
    hint, pattern = HINTS[kind], PATTERNS[kind]
    worth = text.contains(hint) if hint else F.lit(True)
    return F.when(worth & text.rlike(pattern), F.filter(located(text, pattern), lambda x: _valid(kind, x["v"]))).otherwise(F.expr(_EMPTY))


def find_base(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and one array column a kind."""
    filled = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return filled.select(*[F.col(f"`{c}`") for c in keep], "_t", *[base_spans(F.col("_t"), k).alias(f"_{k}") for k in KINDS])


def _tagged() -> Column:
    """All base spans of a row as array<struct<s, rank, e, kind, v>>, sorted by start and kind."""

    def named(rank: int, kind: str):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["v"].alias("v"))

    return F.array_sort(F.concat(*[F.transform(f"_{k}", named(i, k)) for i, k in enumerate(KINDS)]))


def _words(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), "\\P{L}+", -1), ""))


def disclosing_terms(docs: DataFrame, some: DataFrame, support: int = SUPPORT, max_bits: float = MAX_BITS, min_gain: float = MIN_GAIN) -> DataFrame:
    """(th, terms): spans of disclosing terms of each text of ``some`` (th, base, text) that has any; ``docs`` (text) is the whole corpus."""
    total = docs.count()
    value = F.when(F.col("x.kind") == "email", F.lower("x.v")).otherwise(F.regexp_replace("x.v", "[^0-9.]", ""))
    texts = cut(some.groupBy("th").agg(F.count("*").alias("c"), F.first("base").alias("base"), F.first("text").alias("text")), "texts")
    held = texts.select("th", "c", F.explode("base").alias("x")).select("th", "c", F.concat_ws(":", "x.kind", value).alias("entity")).distinct()
    # the texts of an entity as a sum of hashes: equal sums of equally many texts are the same texts
    sign = F.struct(F.count("*").alias("n_texts"), F.sum("c").alias("n_e"), F.sum(F.xxhash64("th").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64(F.reverse("th")).cast("decimal(38,0)")).alias("h2"))
    entities = cut(held.groupBy("entity").agg(sign.alias("g")).where((F.col("g.n_texts") >= support) & (F.col("g.n_e") * 2.0**min_gain <= total)), "entities")
    member = cut(held.join(entities.select(F.col("entity").alias("own"), "g"), F.col("entity") == F.col("own")).select("th", "c", "g").distinct(), "members")
    inside = F.filter(located(F.col("text"), WORD), lambda w: ~F.exists("base", lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"])))
    at_risk = texts.join(member.select(F.col("th").alias("risk")).distinct(), F.col("th") == F.col("risk"), "left_semi")
    words = cut(at_risk.select("th", F.explode(inside).alias("w")).select("th", F.lower("w.v").alias("t"), "w.s", "w.e"), "words")
    both = words.select("th", "t").distinct().join(member.withColumnRenamed("th", "m"), F.col("th") == F.col("m"))
    pairs = cut(both.groupBy("g", "t").agg(F.sum("c").alias("n_te"), F.count("*").alias("n_texts")).where(F.col("n_texts") >= support), "pairs")
    # the whole vocabulary is counted before any join: what a join makes is then one row a pair, however common its terms are
    counts = docs.select(F.explode(_words(F.col("text"))).alias("v")).groupBy("v").agg(F.count("*").alias("n_t"))
    sure = F.log2(F.col("n_te") / (F.greatest("n_t", "n_te") + 1))
    told = pairs.join(counts, F.col("t") == F.col("v")).where((-sure <= max_bits) & (sure - F.log2(F.col("g.n_e") / F.lit(float(max(total, 1)))) >= min_gain))
    told = cut(told.select(F.col("g").alias("g2"), F.col("t").alias("t2")), "told")
    marks = member.join(told, F.col("g") == F.col("g2")).select(F.col("th").alias("m"), "t2").distinct()
    spans = words.join(marks, (F.col("th") == F.col("m")) & (F.col("t") == F.col("t2"))).groupBy("th").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("terms"))  # bounded by one text
    spans = cut(spans, "terms")
    discard(texts, entities, member, words, pairs, told)
    return spans


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, max_bits: float = MAX_BITS, min_gain: float = MIN_GAIN) -> DataFrame:
    """Per row: ``id``, ``th`` (MD5 of a text with base spans, else null), ``base`` and ``terms`` (sorted arrays of struct<s, rank, e, kind, v>)."""
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    base = find_base(keyed, "text", ["id"]).select("id", "_t", _tagged().alias("base"))
    # texts without a base span have no terms either: only those with spans are looked at further
    base = cut(base.select("id", "base", F.when(F.size("base") > 0, F.md5("_t")).alias("th"), F.when(F.size("base") > 0, F.col("_t")).alias("text")), "base")
    terms = disclosing_terms(keyed.select("text").where("text is not null"), base.where("th is not null"), support, max_bits, min_gain).withColumnRenamed("th", "of")
    joined = base.drop("text").join(terms, F.col("th") == F.col("of"), "left")
    shaped = F.transform(F.coalesce("terms", F.expr("cast(array() as array<struct<s:int,e:int>>)")), lambda t: F.struct(t["s"].alias("s"), F.lit(len(KINDS)).alias("rank"), t["e"].alias("e"), F.lit("term").alias("kind"), F.lit("").alias("v")))
    return joined.select("id", "th", "base", shaped.alias("terms"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "terms"))).alias("spans"))


def rewrite(text: Column, spans: Column) -> Column:
    """The text with every span replaced: base spans by their kind in brackets, terms by [TERM]; overlaps are merged into the first."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(a, x):
        piece = F.when(x["s"] >= a["at"], F.array(F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], piece).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with texts rewritten; ``n_chars``, where there is such a column, follows."""
    found = find(docs, doc_id, text)
    spans = found.where("th is not null").groupBy("th").agg(F.first("base").alias("base"), F.first("terms").alias("terms"))
    spans = cut(spans.select("th", F.array_sort(F.concat("base", "terms")).alias("spans")), "spans")
    rows = packed(docs, t=F.col(text), k=F.md5(F.col(text)))
    # texts are joined by a merge at every size, so that what a stage shuffles follows its input
    joined = rows.join(spans.hint("merge"), F.col("k") == F.col("th"), "left")
    clean = joined.select("row", "spans", F.when(F.col("spans").isNotNull(), rewrite(F.col("t"), F.col("spans"))).otherwise(F.col("t")).alias("clean"))
    new = {text: F.col("clean")}
    if n_chars in docs.columns:
        new[n_chars] = F.when(F.col("spans").isNotNull(), F.length("clean")).otherwise(F.col("row")[n_chars]).cast(docs.schema[n_chars].dataType)
    return clean.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
