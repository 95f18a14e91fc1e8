"""Operators around external models, and alternatives for communities: everything a model does is injected."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.communities import search_grid
from kgspark.operators.graph import agreement


def ask(rows: DataFrame, key: str, prompt: str, make: Callable[[], Callable[[str], str]], parallel: int | None = None, tries: int = 3) -> DataFrame:
    """(key, said): each prompt put to a model, with retries inside the worker. ``parallel`` caps the tasks that call it at once."""
    asked = rows.select(F.col(key).cast("string").alias("key"), F.col(prompt).alias("prompt"))
    asked = asked.coalesce(parallel) if parallel else asked

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        model = make()
        for b in batches:
            said = []
            for p in b["prompt"]:
                for k in range(tries):
                    try:
                        said.append(model(p))
                        break
                    except Exception:
                        if k == tries - 1:
                            said.append(None)
                        else:
                            time.sleep(0.1 * (k + 1))
            yield pd.DataFrame({"key": b["key"], "said": said})

    return asked.mapInPandas(work, "key string, said string")


def chunk_claims(chunks: DataFrame, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(chunk_id, claim): one row a non-empty line of what the model claims of a chunk; chunks it says nothing of give none."""
    prompt = F.concat(F.lit("State the claims of this text, one a line:\n"), F.col("text"))
    said = ask(chunks.withColumn("_p", prompt), "chunk_id", "_p", make)
    lines = said.select(F.col("key").alias("chunk_id"), F.explode(F.split("said", "\n")).alias("line")).select("chunk_id", F.trim(F.regexp_replace("line", "^[-*\\d.\\s]+", "")).alias("claim"))
    return lines.where(F.length("claim") > 0)


def classify(names: DataFrame, classes: list[str], make: Callable[[], Callable[[str], str]], batch: int = 10, parallel: int = 3) -> DataFrame:
    """(name, class): a model picks one of ``classes`` for names in batches; anything else it says is null."""
    told = ", ".join(classes)
    grouped = names.select("name").distinct().withColumn("g", F.floor(F.pmod(F.xxhash64("name"), F.lit(1 << 40)))).orderBy("g")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b["name"].iloc[lo : lo + batch].tolist()
                lines = (model(f"Classes: {told}\n" + "\n".join(part)) or "").splitlines()
                lines += [""] * (len(part) - len(lines))
                yield pd.DataFrame({"name": part, "class": [x.strip() if x.strip() in classes else None for x in lines[: len(part)]]})

    return grouped.select("name").coalesce(parallel).mapInPandas(work, "name string, class string")


def concepts(texts: DataFrame, key: str, make: Callable[[], Callable[[str], list[tuple[str, str]]]]) -> DataFrame:
    """(key, concept, kind): a lexicon-backed tagger (parts of speech, word nets) as a plug-in."""
    kind = dict(texts.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = make()
        for b in batches:
            rows = [(k, c, t) for k, text in zip(b[key], b["text"], strict=True) for c, t in tag(text or "")]
            yield pd.DataFrame(rows, columns=[key, "concept", "kind"])

    return texts.select(key, "text").mapInPandas(work, f"{key} {kind}, concept string, kind string")


def similar_names(rows: DataFrame, by: str = "speech_id", threshold: float = 0.85) -> DataFrame:
    """(by, name, canonical): names of a group whose vectors exceed ``threshold`` and whose strings contain or nearly equal each other; people lead, then longer names."""
    kind = dict(rows.dtypes)[by]

    def work(key, g: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        import numpy as np

        g = g.assign(p=(g["type"] != "PERSON").astype(int), n=-g["name"].str.len()).sort_values(["p", "n", "name"])
        names, v = g["name"].tolist(), np.array(g["embedding"].tolist(), dtype=float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        to: dict[str, str] = {}
        for i, n in enumerate(names):
            for j in range(i):
                m = names[j]
                close = n.lower() in m.lower() or m.lower() in n.lower() or SequenceMatcher(None, n.lower(), m.lower()).ratio() > 0.8
                if to[m] == m and close and float(v[i] @ v[j]) > threshold:
                    to[n] = m
                    break
            else:
                to[n] = n
        return pd.DataFrame({by: [key[0]] * len(names), "name": names, "canonical": [to[n] for n in names]})

    return rows.select(by, "name", "type", "embedding").groupBy(by).applyInPandas(work, f"{by} {kind}, name string, canonical string")


def consistent_partition(edges: DataFrame, resolutions: tuple[float, ...] = (0.5, 1.0, 1.5), runs: int = 3, seed: int = 42) -> tuple[float, DataFrame]:
    """(resolution, (id, rep)): the resolution whose runs agree best, 0.6 NMI + 0.4 modularity, for graphs that fit a task a cell."""
    from kgspark.operators.graph import modularity
    from kgspark.operators.storage import cut

    grid = cut(search_grid(edges, resolutions, runs, seed).withColumnRenamed("rep", "community"), "grid")
    best = None
    for gamma in resolutions:
        parts = [grid.where((F.col("resolution") == gamma) & (F.col("run") == k)).select("id", "community") for k in range(runs)]
        nmi = [agreement(parts[i], parts[j]).first().nmi for i in range(runs) for j in range(i)]
        q = [modularity(edges, p, directed=False).first()[0] for p in parts]
        score = 0.6 * (sum(nmi) / len(nmi) if nmi else 1.0) + 0.4 * max(q)
        if best is None or score > best[0]:
            best = (score, gamma, parts[q.index(max(q))])
    return best[1], best[2].withColumnRenamed("community", "rep")


def kmeans_groups(rows: DataFrame, k: int, seed: int = 42, vector: str = "embedding") -> DataFrame:
    """(id, sub_id) by k-means, for instance on structural vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.select("id", array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed).fit(data).transform(data).select("id", F.col("prediction").alias("sub_id"))
