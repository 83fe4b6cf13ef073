"""Document quality from a conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialise, narrow, small_batches
from tagloom.llm.crf import Adam, Chain, calibrate, logistic

#: Kinds of bytes that are counted in a line.
LOWER, UPPER, DIGIT, SPACE, STOP, MARK, BAR, SYMBOL, HIGH = range(9)
KINDS = np.full(256, SYMBOL, np.uint8)
KINDS[ord("a") : ord("z") + 1], KINDS[ord("A") : ord("Z") + 1], KINDS[ord("0") : ord("9") + 1], KINDS[128:] = LOWER, UPPER, DIGIT, HIGH
for _kind, _bytes in ((SPACE, b" \t\r\x0b\x0c"), (STOP, b".,;:'\"-()"), (MARK, b"!?"), (BAR, b"|")):
    KINDS[list(_bytes)] = _kind
OWN = 9 + 6
#: Of the neighbouring lines.
SHARED = [UPPER, DIGIT, MARK, BAR, SYMBOL, 9, 11, 12]


@dataclass(frozen=True)
class QualityParams:
    """sample_docs, sample_bytes: the field is learned from about so many labelled documents, and bytes, chosen by a hash of id and text."""

    sample_docs: int = 4000
    sample_bytes: int = 24 << 20
    rounds: int = 150
    rate: float = 0.1
    seed: int = 3


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line and of its neighbours, bytes of the line + 1, whether a text starts) of whole texts."""
    raw, starts, again, distinct = [], [], [], []
    for text in texts:
        lines = (text or "").encode().split(b"\n")
        seen: set[bytes] = set()
        for i, line in enumerate(lines):
            starts.append(i == 0)
            again.append(bool(line) and line in seen)
            seen.add(line)
            words = line.split()
            distinct.append(len(set(words)) / len(words) if words else 1.0)
        raw.append(b"\n".join(lines))
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(joined == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    kinds = KINDS[joined]
    kinds[ends] = 255
    sizes = ends - begins
    own = np.zeros((len(ends), OWN))
    for k in range(9):
        own[:, k] = np.add.reduceat(kinds == k, begins, dtype=np.int64) / np.maximum(sizes, 1)
    own[:, 9] = again
    own[:, 10] = np.log1p(sizes) / 8
    own[:, 11] = 1 - np.array(distinct)
    own[:, 12] = sizes < 20
    own[:, 13] = np.minimum((sizes + 1) / (own[:, SPACE] * sizes + 1), 40) / 10
    own[:, 14] = starts
    first = np.array(starts)
    before, after = np.roll(own[:, SHARED], 1, 0), np.roll(own[:, SHARED], -1, 0)
    before[first] = 0
    after[np.roll(first, -1)] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1))]), (sizes + 1).astype(float), first


class QualityModel:
    """Weights of the field, and of the step from a document's mean marginal to its score."""

    def __init__(self, features: np.ndarray, sizes: np.ndarray, starts: np.ndarray, labels: np.ndarray, p: QualityParams):
        """labels: of each line, that of its document."""
        self.mean, self.scale = features.mean(0), features.std(0) + 1e-6
        self.mean[-1], self.scale[-1] = 0, 1
        x = (features - self.mean) / self.scale
        self.w, self.chain, ascent = np.zeros(x.shape[1]), Chain(), Adam(p.rate)
        # Long documents have many lines; each counts as much as its documents' mean.
        for _ in range(p.rounds):
            ascent.tick()
            of_emission, of_transition, of_first = self.chain.gradient(x @ self.w, starts, labels)
            n = max(1, int(starts.sum()))
            self.w = ascent.step("w", self.w, x.T @ of_emission / len(x) - 1e-3 * self.w)
            self.chain.transition = np.clip(ascent.step("t", self.chain.transition, of_transition / len(x) - 1e-3 * self.chain.transition), -4, 4)
            self.chain.first = float(np.clip(ascent.step("f", np.array(self.chain.first), of_first / n), -4, 4))
        heads = np.flatnonzero(starts)
        self.last = calibrate(self.summary(features, sizes, starts), labels[heads])

    def marginals(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.chain.marginals(((features - self.mean) / self.scale) @ self.w, starts.astype(float))

    def summary(self, features: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-odds of the length-weighted mean of the line marginals, and of the lines' own emissions."""
        heads = np.flatnonzero(starts)
        weight = np.add.reduceat(sizes, heads)
        mean = np.clip(np.add.reduceat(sizes * self.marginals(features, starts), heads) / weight, 1e-4, 1 - 1e-4)
        alone = np.add.reduceat(sizes * np.clip(((features - self.mean) / self.scale) @ self.w, -8, 8), heads) / weight
        return np.stack([np.log(mean / (1 - mean)), alone], 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        features, sizes, starts = line_features(texts)
        return logistic(self.summary(features, sizes, starts), self.last)


def sampled(rows: DataFrame, docs: int, size: int, seed: int) -> DataFrame:
    """About ``docs`` of the rows and ``size`` bytes of text, by a hash of id and text; the whole table if it has no more."""
    n = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("bytes").alias("bytes")).first()
    part = min(1.0, docs / max(n["docs"], 1), size / max(n["bytes"] or 0, 1))
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), "id", "text"), F.lit(1 << 30)) < F.lit(int((1 << 30) * part))).drop("bytes")


def labelled_rows(rows: DataFrame, labels: DataFrame, label_col: str, learn_from: Column | None, label_id: str = "doc_id") -> DataFrame:
    """(id, text, bytes, y) of the rows that have a label; of several labels of an id the largest counts.

    Bytes are counted ahead of the join, so that their sum moves no text.
    """
    known = narrow(labels, id=label_id, y=label_col).filter("id is not null and y is not null").groupBy("id").agg(F.max("y").cast("double").alias("y"))
    out = rows.withColumn("bytes", F.octet_length("text")).join(known, "id")
    return out if learn_from is None else out.filter(learn_from)


def score_quality(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", params: QualityParams = QualityParams()) -> DataFrame:
    """Score the quality of every whole text.

    Lines are labelled good or bad by a field whose emissions see the line and
    its neighbours; in learning, each line has the label of its document.  A
    document's score comes from the mean of its lines' marginals, weighted by
    length, set to probabilities on the rows that were learned from.

    Returns id and score (0 to 1).  Null and empty texts are one empty line.
    Without labels of both kinds every score is the share of label 1, or 0.5
    without any.  Null ids and repeated rows are scored like others; an empty
    table gives an empty result.
    """
    p, spark = params, docs.sparkSession
    small_batches(spark)
    rows = narrow(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    chosen = materialise(sampled(labelled_rows(rows, labels, label_col, learn_from), p.sample_docs, p.sample_bytes, p.seed), "quality-sample")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            features, sizes, starts = line_features(pdf["text"].tolist())
            y = pdf["y"].to_numpy()[np.cumsum(starts) - 1]
            yield pd.DataFrame({"x": list(features), "size": sizes, "start": starts, "y": y})

    # The sample is bounded by sample_docs and sample_bytes.
    known = chosen.mapInPandas(extract, "x array<double>, size double, start boolean, y double").toPandas()
    share = float(known["y"][known["start"]].mean()) if len(known) else 0.5
    model = None
    if len(known) and 0 < share < 1:
        model = QualityModel(np.stack(known["x"].to_list()), known["size"].to_numpy(), known["start"].to_numpy().astype(float), known["y"].to_numpy(), p)
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "score": shared.value.score(pdf["text"].tolist()) if shared.value else share})

    return rows.mapInPandas(predict, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
