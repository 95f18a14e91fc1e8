"""Typed settings: dataclasses filled from a YAML-like file, then from the environment."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field


@dataclass
class Extraction:
    chunk_size: int = 1200
    chunk_overlap: int = 100
    file_pattern: str = "*.txt"
    max_chunks: int = 0
    ner_threshold: float = 0.5
    top_k_labels: int = 5
    concurrency: int = 8
    labels: list = field(default_factory=list)


@dataclass
class Processing:
    similarity_threshold: float = 0.95
    coreference_threshold: float = 0.85
    min_edge_confidence: float = 0.0
    enable_pruning: bool = True


@dataclass
class Community:
    resolutions: list = field(default_factory=lambda: [0.5, 0.75, 1.0, 1.25, 1.5])
    n_iterations: int = 10
    min_size: int = 3
    seed: int = 42
    node2vec_dim: int = 64
    walk_length: int = 16
    num_walks: int = 20


@dataclass
class Iterative:
    batch_size: int = 100
    iterations: int = 5
    seed: int = 42


@dataclass
class Llm:
    model: str = ""
    api_key: str = ""
    provider: str = ""


@dataclass
class TestMode:
    enabled: bool = False
    max_documents: int = 0
    max_chunks: int = 0


@dataclass
class Settings:
    extraction: Extraction = field(default_factory=Extraction)
    processing: Processing = field(default_factory=Processing)
    community: Community = field(default_factory=Community)
    iterative: Iterative = field(default_factory=Iterative)
    llm: Llm = field(default_factory=Llm)
    test_mode: TestMode = field(default_factory=TestMode)

    @property
    def chunk_budget(self) -> int:
        return (self.test_mode.max_chunks or self.extraction.max_chunks) if self.test_mode.enabled else self.extraction.max_chunks

    @property
    def document_limit(self) -> int:
        return self.test_mode.max_documents if self.test_mode.enabled else 0


def _scalar(x: str):
    x = x.strip()
    if x.startswith("[") and x.endswith("]"):
        return [_scalar(y) for y in x[1:-1].split(",") if y.strip()]
    if len(x) > 1 and x[0] == x[-1] and x[0] in "'\"":
        return x[1:-1]
    low = x.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(x)
        except ValueError:
            pass
    return x


def read_yaml(text: str) -> dict:
    """Nested mappings, lists and scalars, by indentation; enough for settings files, and no library is needed."""
    root: dict = {}
    stack: list[tuple[int, object, object, str | None]] = [(-1, root, None, None)]
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip() if not raw.lstrip().startswith("#") else ""
        if not line.strip():
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        while indent <= stack[-1][0] and not (body.startswith("- ") and indent == stack[-1][0]):
            stack.pop()
        _, here, parent, key = stack[-1]
        if body.startswith("- "):
            if isinstance(here, dict) and not here and parent is not None:
                here = []
                parent[key] = here
                stack[-1] = (stack[-1][0], here, parent, key)
            here.append(_scalar(body[2:]))
            continue
        k, _, v = body.partition(":")
        k = k.strip().strip("'\"")
        if v.strip():
            here[k] = _scalar(v)
        else:
            here[k] = {}
            stack.append((indent, here[k], here, k))
    return root


def read_env(text: str) -> dict[str, str]:
    pairs = (x.split("=", 1) for x in text.splitlines() if "=" in x and not x.lstrip().startswith("#"))
    return {k.strip().removeprefix("export "): v.strip().strip("'\"") for k, v in pairs}


def load(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """Settings from a file, overridden by variables such as EXTRACTION__CHUNK_SIZE."""
    out = Settings()
    given = read_yaml(open(path, encoding="utf-8").read()) if path else {}
    for section in dataclasses.fields(out):
        part = getattr(out, section.name)
        values = given.get(section.name)
        for f in dataclasses.fields(part):
            if isinstance(values, dict) and f.name in values:
                setattr(part, f.name, values[f.name])
            name = f"{section.name}__{f.name}".upper()
            if name in (env if env is not None else os.environ):
                setattr(part, f.name, _scalar((env if env is not None else os.environ)[name]))
    return out


def model_id(settings: Llm, purpose: str = "") -> str:
    """The model's name with its provider in front, once."""
    if not settings.provider or settings.model.startswith(f"{settings.provider}/"):
        return settings.model
    return f"{settings.provider}/{settings.model}"
