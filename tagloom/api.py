"""The operators behind the names of tools: one engine over a set of relations."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import align, cooccurrence, episodes, episodic, graph, lattice, memory, motifs, retrieval, tensor, text, trends, vector_search
from tagloom.params import Params
from tagloom.sources import sinks


class Engine:
    """Relations by name, and tools over them.

    relations: memories, memory_tags, tags, tag_events, hits, results, vectors,
    tensor, events, and for some tools positions, edges, signals.  A tool
    returns a DataFrame; nothing runs before an action.
    """

    def __init__(self, relations: dict[str, DataFrame], params: Params = Params()):
        self.relations, self.params = relations, params
        self.tools: dict[str, Callable[..., DataFrame]] = {
            "store_memory": self.store_memory, "retrieve_memories": self.retrieve_memories, "deep_retrieve": self.deep_retrieve,
            "get_trends": self.get_trends, "get_phase_space": self.get_phase_space, "get_synchronicities": self.get_synchronicities,
            "get_meta_patterns": self.get_meta_patterns, "get_lattice_resonances": self.get_lattice_resonances, "compare_traces": memory.compare_traces,
            "ingest_documents": self.ingest_documents, "ingest_codebase": self.ingest_codebase, "get_canopy": self.get_canopy,
            "process_signals": self.process_signals, "squares": self.squares, "chain_anisotropy": self.chain_anisotropy, "cross_align": align.alignment,
        }

    def dispatch(self, tool: str, **arguments: Any) -> DataFrame:
        if tool not in self.tools:
            raise KeyError(f"no tool {tool}; there are {', '.join(sorted(self.tools))}")
        return self.tools[tool](**arguments)

    def _of(self, name: str) -> DataFrame:
        return self.relations[name]

    def store_memory(self, memories: DataFrame) -> DataFrame:
        return memory.store_memories(memories)

    def retrieve_memories(self, queries: DataFrame, k: int = 10, tags: list | None = None) -> DataFrame:
        """Memories of each query (query_id, embedding) above the least score, which is higher with tags."""
        if "text" in queries.columns and {"tags", "tag_centroids"} <= self.relations.keys():
            r = self.relations
            return retrieval.retrieve(queries, r["vectors"], r["memory_tags"], r["tags"], r["tensor"], r["tag_centroids"], r.get("co_retrieval"), r.get("edges"), k=k, p=self.params).filter(F.col("score") >= self.params.min_score_untagged)
        found = vector_search.top_k(queries, self._of("vectors"), k * 3, self.params.similarity_threshold)
        channels = {"similarity": found}
        if tags:
            tagged = memory.retrieve_by_tags(self._of("memories"), self._of("memory_tags"), tags).select("memory_id")
            channels["tags"] = found.join(tagged, "memory_id", "left_semi")
        least = self.params.min_score_tagged if tags else self.params.min_score_untagged
        return graph.hybrid(channels, k, self.params).filter(F.col("score") >= least)

    def deep_retrieve(self, start: DataFrame, similar: DataFrame, decay_of: DataFrame) -> DataFrame:
        return graph.deep_retrieve(start, similar, decay_of)

    def get_trends(self, limit: int = 20) -> DataFrame:
        return trends.trends(self._of("tag_events"), self._of("tags"), self.params).orderBy(F.col("temperature").desc(), "tag_id").limit(limit)

    def get_phase_space(self, quadrant: str | None = None) -> DataFrame:
        trend = trends.trends(self._of("tag_events"), self._of("tags"), self.params)
        space = trends.phase_space(trend, trends.retrieval_frequency(self._of("hits"), self._of("tags"), self.params), self.params)
        return space if quadrant is None else space.filter(F.col("quadrant") == quadrant)

    def get_synchronicities(self, limit: int = 20) -> DataFrame:
        """Dormant tags that are retrieved, similar memories of different retrievals, and resonant tags that meet for the first time.

        The last need a relation resonances (a, b) of tags.
        """
        dormant = trends.dormant_reactivations(self.get_phase_space(), params=self.params).select(F.lit("dormant_reactivation").alias("event_type"), F.col("tag_id").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "strength")
        meet = vector_search.semantic_convergence(self._of("results"), self._of("vectors"), self._of("memory_tags"), threshold=self.params.convergence_threshold)
        met = meet.select(F.lit("semantic_convergence").alias("event_type"), F.col("memory_a").cast("long").alias("a"), F.col("memory_b").cast("long").alias("b"), F.col("similarity").alias("strength"))
        found = dormant.unionByName(met)
        if "resonances" in self.relations:
            crossed = trends.cross_domain_bridges(self._of("results"), self._of("memory_tags"), self._of("resonances"), self._of("memories").filter("not is_archived").count(), params=self.params)
            found = found.unionByName(crossed.select(F.lit("cross_domain_bridge").alias("event_type"), F.col("tag_a").cast("long").alias("a"), F.col("tag_b").cast("long").alias("b"), "strength"))
        return found.orderBy(F.col("strength").desc(), "event_type", "a", "b").limit(limit)

    def get_meta_patterns(self, least: float = 0.05) -> DataFrame:
        scores = self._of("tensor").select(F.col("tag_a_id").alias("a"), F.col("tag_b_id").alias("b"), tensor.direct_score(self.params).alias("score"))
        return episodic.meta_patterns(scores, self._of("tag_events").select("event_id", "tag_id"), self._of("tags"), least)

    def get_lattice_resonances(self, limit: int = 50) -> DataFrame:
        return lattice.persist_resonances(self._of("positions"), self.params).orderBy(F.col("strength").desc(), "a", "b").limit(limit)

    def ingest_documents(self, docs: DataFrame, stored: DataFrame) -> DataFrame:
        return text.new_chunks(text.chunk_documents(docs), stored)

    def ingest_codebase(self, files: DataFrame) -> DataFrame:
        return text.summaries(files, code=True)

    def get_canopy(self, limit: int = 20) -> DataFrame:
        edges = self._of("edges")
        scores = episodic.canopy_scores(edges, episodic.canopy_clusters(edges), self._of("memory_tags"))
        return scores.orderBy(F.col("growth_potential").desc(), "cluster").limit(limit)

    def process_signals(self, processed: DataFrame, project: str | None = None) -> DataFrame:
        return sinks.pending(self._of("signals"), processed, project)

    def squares(self, limit: int = 50) -> DataFrame:
        edges = motifs.scored_edges(self._of("tensor"))
        return motifs.square_motifs(edges, motifs.select_edges(edges)).orderBy(F.col("interestingness").desc(), "tag_ids").limit(limit)

    def chain_anisotropy(self) -> DataFrame:
        """Chains along each layer against chains beside it, and shuffles of the layers."""
        return motifs.chain_baseline(motifs.select_edges(motifs.scored_edges(self._of("tensor")), overall=1500, per_layer=200))


def run_sync(engine: Engine, folder: str) -> dict[str, str]:
    """The batch refresh: each derived table anew from the stored relations, under ``folder``; returns their paths."""
    r, p = engine.relations, engine.params
    trend = trends.trends(r["tag_events"], r["tags"], p)
    co = cooccurrence.combined_cooccurrence(r["memory_tags"], r["hits"])
    directed = cooccurrence.conditional(r["memory_tags"], r["hits"])
    centroids = vector_search.centroids(r["vectors"].join(r["memory_tags"], "memory_id"), "tag_id")
    steps: dict[str, DataFrame] = {
        "trend_snapshots": trend.withColumn("computed_at", F.lit(p.now)),
        "phase_space": trends.phase_space(trend, trends.retrieval_frequency(r["hits"], r["tags"], p), p),
        "tag_centroids": centroids,
        "tag_relational_tensor": tensor.assemble(co, directed),
        "centroid_edges": tensor.edge_ema(cooccurrence.item_pairs(r["hits"], "retrieval_id"), p.alpha_edge),
        "cooccurrence_edges": cooccurrence.ppmi(r["memory_tags"], "memory_id", "store").unionByName(cooccurrence.ppmi(r["hits"], "retrieval_id", "retrieval")),
        "episodes": episodes.assign_episodes(episodes.operation_centroids(r["operations"], centroids)) if "operations" in r else trend.limit(0),
    }
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in steps}
    for name, df in steps.items():
        df.write.mode("overwrite").parquet(paths[name])
    return paths
