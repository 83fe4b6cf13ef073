"""Episodes: a fold over operations in time order that starts, continues and revisits clusters of tag space.

The fold depends on order, so each key's operations are folded in one place:
by ``applyInPandas`` over a finished table, or in the state of a stream.  The
key (a user, a project) makes it parallel.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EpisodeParams:
    alpha: float = 0.2
    sigma: float = 2.0
    base_threshold: float = 0.5
    min_samples: int = 10
    revisit_candidates: int = 50
    boundary_strength: float = 0.7
    dormant_after_hours: float = 168.0
    archive_after_hours: float = 4320.0


@dataclass
class Episode:
    centroid: list[float]
    tags: list[int]
    active_at: int
    mean: float = 0.3
    m2: float = 0.0
    samples: int = 0
    operations: int = 1
    visits: int = 1

    def threshold(self, p: EpisodeParams) -> float:
        if self.samples < p.min_samples:
            return p.base_threshold
        spread = self.m2 / (self.samples - 1) if self.samples > 1 else 0.01
        return self.mean + p.sigma * math.sqrt(max(spread, 1e-8))

    def learn(self, distance: float) -> None:
        """Welford's update; the first sample replaces the initial mean."""
        self.samples += 1
        delta = distance - self.mean
        self.mean += delta / self.samples
        self.m2 += delta * (distance - self.mean)

    def pull(self, centroid: np.ndarray, tags: list[int], alpha: float, clock: int) -> None:
        self.centroid = (alpha * centroid + (1 - alpha) * np.array(self.centroid)).tolist()
        self.tags = sorted({*self.tags, *tags})
        self.active_at = clock


@dataclass
class EpisodeFold:
    """State of one key: episodes by number, and the current one."""

    episodes: list[Episode] = field(default_factory=list)
    current: int = -1
    clock: int = 0

    def step(self, centroid: list[float], tags: list[int], p: EpisodeParams, boundary: bool = False) -> tuple[int, float, float, str]:
        """(episode, distance, threshold, transition) of the next operation; a boundary ends the current episode first."""
        v, self.clock = np.asarray(centroid, float), self.clock + 1
        if self.current < 0:
            return self._start(v, tags), 0.0, p.base_threshold, "first"
        here = self.episodes[self.current]
        distance, threshold = float(np.linalg.norm(v - here.centroid)), here.threshold(p)
        if boundary:
            return self._start(v, tags), distance, threshold, "sync_boundary"
        if distance < threshold:
            here.pull(v, tags, p.alpha, self.clock)
            here.operations += 1
            here.learn(distance)
            return self.current, distance, threshold, "stay"
        dormant = sorted((i for i in range(len(self.episodes)) if i != self.current), key=lambda i: -self.episodes[i].active_at)
        near = [(float(np.linalg.norm(v - self.episodes[i].centroid)), n, i) for n, i in enumerate(dormant[: p.revisit_candidates])]
        best = min(near, default=(threshold, 0, -1))
        if best[0] < threshold:
            self.current = best[2]
            self.episodes[self.current].pull(v, tags, p.alpha, self.clock)
            self.episodes[self.current].visits += 1
            return self.current, distance, threshold, "revisit"
        return self._start(v, tags), distance, threshold, "drift"

    def _start(self, v: np.ndarray, tags: list[int]) -> int:
        self.episodes.append(Episode(v.tolist(), sorted(set(tags)), self.clock))
        self.current = len(self.episodes) - 1
        return self.current

    def dump(self) -> str:
        return json.dumps({"e": [e.__dict__ for e in self.episodes], "current": self.current, "clock": self.clock})

    @staticmethod
    def load(text: str) -> EpisodeFold:
        x = json.loads(text)
        return EpisodeFold([Episode(**e) for e in x["e"]], x["current"], x["clock"])


ASSIGNMENT = "key long, op_id long, episode_id int, distance double, threshold double, transition string"


def fold_rows(fold: EpisodeFold, key: int, pdf: pd.DataFrame, p: EpisodeParams) -> pd.DataFrame:
    """Assignments of a key's operations (op_id, occurred_at, centroid, tags, boundary) in order of time and id."""
    out = []
    for row in pdf.sort_values(["occurred_at", "op_id"]).itertuples(index=False):
        out.append((key, row.op_id, *fold.step(row.centroid, [int(t) for t in row.tags], p, bool(getattr(row, "boundary", False)))))
    return pd.DataFrame(out, columns=["key", "op_id", "episode_id", "distance", "threshold", "transition"])


def operation_centroids(operations: DataFrame, tag_centroids: DataFrame) -> DataFrame:
    """Mean of the centroids of each operation's tags; an operation needs max(1, n // 2) known ones.

    Means are taken once for each different set of tags.
    operations: key, op_id, occurred_at, tag_id.  tag_centroids: tag_id, centroid.
    """
    keys = ["key", "op_id", "occurred_at"]
    sets = operations.select(*keys, "tag_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_set("tag_id")).alias("tags"))
    known = sets.select("tags").distinct().select("tags", F.explode("tags").alias("tag_id")).join(tag_centroids, "tag_id").filter("centroid is not null")
    parts = known.select("tags", "tag_id", F.posexplode("centroid").alias("i", "x")).groupBy("tags", "i").agg(F.avg("x").alias("x"))
    whole = parts.groupBy("tags").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
    whole = whole.join(known.groupBy("tags").agg(F.count(F.lit(1)).alias("_known")), "tags")
    return sets.join(whole, "tags").filter(F.col("_known") >= F.floor(F.col("_n") / 2)).select(*keys, "centroid", "tags")


def assign_episodes(operations: DataFrame, params: EpisodeParams = EpisodeParams()) -> DataFrame:
    """Episode of every operation (key, op_id, occurred_at, centroid, tags and, if there, boundary)."""

    def one(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return fold_rows(EpisodeFold(), group[0], pdf, params)

    return operations.groupBy("key").applyInPandas(one, ASSIGNMENT)


def stream_episodes(operations: DataFrame, params: EpisodeParams = EpisodeParams()) -> DataFrame:
    """The same over a stream, with each key's fold as state; operations of a batch are folded in order of time."""

    def one(group, batches, state):  # noqa: ANN001, ANN202
        fold = EpisodeFold.load(state.get[0]) if state.exists else EpisodeFold()
        yield fold_rows(fold, group[0], pd.concat(list(batches)), params)
        state.update((fold.dump(),))

    return operations.groupBy("key").applyInPandasWithState(one, ASSIGNMENT, "fold string", "append", "NoTimeout")


def lifecycle(episodes: DataFrame, now, params: EpisodeParams = EpisodeParams()) -> DataFrame:  # noqa: ANN001
    """Status by age (status, last_active_at): active to dormant, dormant to archived."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_active_at").cast("timestamp"))) / F.lit(3.6e9)
    status = F.when((F.col("status") == "active") & (age > params.dormant_after_hours), "dormant").when((F.col("status") == "dormant") & (age > params.archive_after_hours), "archived").otherwise(F.col("status"))
    return episodes.withColumn("status", status)


def cross_episode_bridges(edges: DataFrame, assignments: DataFrame, top: int = 20) -> DataFrame:
    """Strongest episodic edges (memory_a, memory_b, bridge, status) between different episodes."""
    a, b = (assignments.select(F.col("memory_id").alias(f"memory_{s}"), F.col("episode_id").alias(f"episode_{s}")) for s in "ab")
    found = edges.filter("status <> 'archived'").join(a, "memory_a").join(b, "memory_b").filter("episode_a <> episode_b")
    return found.orderBy(F.col("bridge").desc(), "memory_a", "memory_b").limit(top).select("memory_a", "memory_b", "episode_a", "episode_b", "bridge")
