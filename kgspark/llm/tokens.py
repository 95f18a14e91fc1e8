"""Token counts of whole texts by overlap resynchronisation.

Every document is cut into chunks of ``chunk_chars`` characters that overlap by ``overlap_chars``; a shorter one is a single chunk. Chunks are encoded on their own, with
offsets, in batches over many documents. Two neighbours are spliced at a boundary at which both start a token and which is *proven* stable: the
character before it is white space, which this tokenizer's normaliser maps one by one and whose pre-tokenizer drops, or CJK punctuation before a letter,
between which the pre-tokenizer always splits; so no merge, composition or added token can reach across. The tokens that follow must agree as well. Where
an overlap holds no such boundary, it is widened (doubled) until one is found or the rest of the document is one chunk.

``proven_barrier`` checks at load time that the vocabulary file has the parts this rests on; otherwise every text is encoded whole.

Edge cases: null and empty texts have 0 bytes and 0 tokens; special strings inside a text are read as the library's default
reads them; a text without any boundary is one chunk, whatever its length; repeated rows are counted each on their own; extra columns pass through.
"""

from __future__ import annotations

import json
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import map_texts

CHUNK_CHARS, OVERLAP_CHARS, BATCH_CHUNKS = 2048, 128, 1000
AGREE = 3
#: White space that the normaliser and pre-tokenizer treat alike and that Unicode composition never joins to a neighbour.
SPACES = " \n\t\r"
#: Before a letter these are barriers too: composition leaves them alone, and letters and punctuation are different pre-tokens.
CJK_STOPS = "。，、！？；：「」『』（）"


def proven_barrier(tokenizer_json: str) -> bool:
    """Whether white space separates words for good: the pre-tokenizer's first split drops it, and no added token holds any or strips it."""
    spec = json.loads(tokenizer_json)
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and "[^\\s" in first["pattern"].get("Regex", "")
    added = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or any(c.isspace() for c in a["content"])) for a in spec.get("added_tokens", []))
    kinds = {n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])}
    return drops and added and kinds <= {"NFC", "Replace", "Lowercase"} and spec.get("post_processor") is None


def splice_count(text: str, encode, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text`` from overlapping chunks. ``encode`` gives [(start, end, id)] with character offsets."""
    total, start, n = 0, 0, len(text)
    held = [(a, b, i) for a, b, i in encode(text[:chunk_chars])]
    end = min(chunk_chars, n)
    while end < n:
        overlap = min(overlap_chars, chunk_chars // 2) or 1
        while True:
            begin = max(start, end - overlap)
            stop = min(n, begin + max(chunk_chars, 2 * overlap))
            new = [(begin + a, begin + b, i) for a, b, i in encode(text[begin:stop])]
            at = _boundary(text, held, new, begin, end)
            if at is not None:
                break
            if begin == start:  # no stable boundary in the whole of the held chunk: it and the next are one
                at, begin = start, start
                stop = min(n, end + max(chunk_chars, 2 * overlap))
                new = [(begin + a, begin + b, i) for a, b, i in encode(text[begin:stop])]
                break
            overlap *= 2
        total += sum(1 for a, _, _ in held if a < at)
        held = [x for x in new if x[0] >= at]
        start, end = at, stop
    return total + len(held)


def is_barrier(text: str, p: int) -> bool:
    return text[p - 1] in SPACES or (text[p - 1] in CJK_STOPS and text[p].isalpha())


def _boundary(text: str, held: list, new: list, begin: int, end: int) -> int | None:
    """A common token start behind a barrier, with AGREE equal tokens after it."""
    older = {x[0]: k for k, x in enumerate(held) if x[0] > begin}
    for k, x in enumerate(new):
        p = x[0]
        if p <= begin or p not in older or not is_barrier(text, p):
            continue
        j = older[p]
        m = min(AGREE, len(held) - j)
        if m == AGREE and held[j : j + m] == new[k : k + m] and held[j + m - 1][1] < end:
            return p
    return None


def _seam(text: str, old, new, old_at: int, new_at: int, old_end: int) -> tuple[int, int] | None:
    """As ``_boundary``, on two of the library's encodings: the token's index in the older and in the newer one."""
    a, b = old.ids, new.ids
    for p in range(new_at + 1, min(old_end, len(text))):
        if not is_barrier(text, p):
            continue
        j, i = old.char_to_token(p - old_at), new.char_to_token(p - new_at)
        if j is None or i is None or old.token_to_chars(j)[0] != p - old_at or new.token_to_chars(i)[0] != p - new_at:
            continue
        if j + AGREE <= len(a) and a[j : j + AGREE] == b[i : i + AGREE] and old.token_to_chars(j + AGREE - 1)[1] + old_at < old_end:
            return j, i
    return None


def spliced_counts(texts: list, encode_batch, encode, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, encode_short=None) -> list[int]:
    """Tokens of each text (None counts 0). Chunks of all texts are encoded in batches; a text with a seam that fails is widened by ``splice_count``.

    A text of one chunk has no seam, so ``encode_short`` may leave out offsets."""
    overlap = min(overlap_chars, chunk_chars // 2) or 1
    out, failed = [0] * len(texts), set()
    short = (k for k, t in enumerate(texts) if t and len(t) <= chunk_chars)
    while some := list(islice(short, BATCH_CHUNKS)):
        for k, e in zip(some, (encode_short or encode_batch)([texts[k] for k in some]), strict=True):
            out[k] = len(e)
    pieces = ((k, at) for k, t in enumerate(texts) if t and len(t) > chunk_chars for at in range(0, max(1, len(t) - overlap), chunk_chars - overlap))
    last = None  # (text, encoding, where it starts, index of its first token that counts)
    while some := list(islice(pieces, BATCH_CHUNKS)):
        for (k, at), e in zip(some, encode_batch([texts[k][at : at + chunk_chars] for k, at in some]), strict=True):
            first = 0
            if at and k not in failed:
                _, old, old_at, old_first = last
                seam = _seam(texts[k], old, e, old_at, at, old_at + chunk_chars)
                if seam is None or seam[0] < old_first:
                    failed.add(k)
                else:
                    out[k] += seam[0] - len(old)  # what the older chunk has behind the seam is the newer one's
                    first = seam[1]
            out[k] += len(e) - first
            last = (k, e, at, first)
    for k in failed:
        out[k] = splice_count(texts[k], encode, chunk_chars, overlap)
    return out


_loaded: dict[tuple, object] = {}


def _counter(path: str, chunk_chars: int, overlap_chars: int):
    """The counting function; a worker process loads a vocabulary once."""
    key = (path, chunk_chars, overlap_chars)
    if key not in _loaded:
        _loaded[key] = _load(*key)
    return _loaded[key]


def _load(path: str, chunk_chars: int, overlap_chars: int):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    from tokenizers import Tokenizer

    spec = open(path, encoding="utf-8").read()
    tok = Tokenizer.from_str(spec)

    def encode(s):
        e = tok.encode(s, add_special_tokens=False)
        return [(a, b, i) for (a, b), i in zip(e.offsets, e.ids, strict=True)]

    def encode_batch(parts):
        return tok.encode_batch(parts, add_special_tokens=False)

    def encode_short(parts):
        return tok.encode_batch_fast(parts, add_special_tokens=False)

    if not proven_barrier(spec):
        return lambda texts: [[len(tok.encode(t or "", add_special_tokens=False)) for t in texts]]
    return lambda texts: [spliced_counts(texts, encode_batch, encode, chunk_chars, overlap_chars, encode_short)]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, keep_text: bool = False) -> DataFrame:
    """Add ``out``: tokens of each whole text. ``tokenizer`` is the path of a vocabulary file that every worker can read."""
    return map_texts(docs, text, {out: ("bigint", pa.int64())}, lambda: _counter(tokenizer, chunk_chars, overlap_chars), keep_text)


def token_report(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return count_tokens(sized, tokenizer).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
