"""Extension points: enrichers in layers, embedding services with a cache, search providers, review gates, run metrics."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame

from corpusloom.functions import tokens, vector
from corpusloom.operators.caches import probe
from corpusloom.operators.graph import merged


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


class Enricher(Protocol):
    """Adds nodes and edges of one layer; ``needs`` names inputs without which it is left out of the plan."""

    name: str
    layer: str
    needs: Sequence[str]

    def enrich(self, graph: Graph, inputs: dict[str, DataFrame]) -> tuple[DataFrame | None, DataFrame | None]: ...


def enrich(graph: Graph, enrichers: Sequence[Enricher], inputs: dict[str, DataFrame], layers: Sequence[str] = "ABCD") -> Graph:
    """Run the enrichers of the layers asked for, in order; earlier rows win. Others take no part in the plan. What they add
    meets in one aggregation, whatever their number; a table to which none adds stays as it is."""
    nodes, edges = [graph.nodes], [graph.edges]
    for e in sorted(enrichers, key=lambda e: e.layer):
        if e.layer not in layers or any(n not in inputs for n in e.needs):
            continue
        for parts, part in zip((nodes, edges), e.enrich(graph, inputs), strict=True):
            if part is not None:
                parts.append(part)
        graph = Graph(merged(nodes), merged(edges))
    return graph


class EmbeddingService(Protocol):
    dimensions: int

    def embed(self, texts: DataFrame) -> DataFrame:
        """texts (id, text) -> (id, bucket, value)."""


class TrigramService:
    dimensions = vector.DIMENSIONS

    def embed(self, texts: DataFrame) -> DataFrame:
        return vector.trigram_buckets(texts)


@dataclass
class CachedService:
    """Embeds only what the cache (id, bucket, value) lacks."""

    inner: EmbeddingService
    cache: DataFrame

    @property
    def dimensions(self) -> int:
        return self.inner.dimensions

    def embed(self, texts: DataFrame) -> DataFrame:
        hits, misses = probe(texts.select("id", "text"), self.cache.select("id").distinct(), "id")
        return self.cache.join(hits.select("id"), "id", "left_semi").unionByName(self.inner.embed(misses))


class SearchProvider(Protocol):
    priority: int

    def search(self, queries: DataFrame) -> DataFrame: ...


def estimator(chars_per_token: float = 4.0) -> Callable[[Column], Column]:
    return lambda text: tokens.estimate(text, chars_per_token)


def review(patches: DataFrame, gate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The patches that a gate lets through."""
    return gate(patches)


@dataclass
class Recorder:
    """Metrics rows (agent, ms, success) of what ran through it."""

    rows: list[tuple[str, float, bool]] = field(default_factory=list)

    def run(self, agent: str, f: Callable, *args, **kwargs):
        began = time.perf_counter()
        ok = False
        try:
            out = f(*args, **kwargs)
            ok = True
            return out
        finally:
            self.rows.append((agent, (time.perf_counter() - began) * 1000, ok))

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "agent string, ms double, success boolean")
