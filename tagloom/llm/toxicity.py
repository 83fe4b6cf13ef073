"""Toxic spans and document scores from a conditional random field over tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialise, narrow, small_batches
from tagloom.llm.crf import Adam, Chain, calibrate, logistic
from tagloom.llm.quality import labelled_rows, sampled

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
PREFIXES = (4, 5, 6, 7)


@dataclass(frozen=True)
class ToxicityParams:
    """lexicon_docs, chain_docs: labelled documents, about, that the features and the field are learned from (by a hash of id and text); sample_bytes of text at most of the first, a share of it of the second.

    least, ratio: a feature marks a token as toxic in learning if it is in so
    many toxic documents and so much likelier in toxic than in other ones.
    """

    lexicon_docs: int = 8000
    chain_docs: int = 1500
    sample_bytes: int = 48 << 20
    least: int = 4
    ratio: float = 6.0
    rounds: int = 60
    rate: float = 0.2
    seed: int = 13


def features(token: bytes) -> list[str]:
    """The token's letters and digits, case-folded, and their beginnings."""
    word = "".join(c for c in token.decode("utf-8", "replace").casefold() if c.isalnum())
    return [f"={word}", *[word[:n] for n in PREFIXES if len(word) > n]] if word else []


class Types(dict):
    """Token to the number of its set of known features; 0 for none."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known, self.sets = known, {(): 0}

    def __missing__(self, token: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        found = tuple(sorted({self.known[f] for f in features(token) if f in self.known}))
        self[token] = n = self.sets.setdefault(found, len(self.sets))
        return n


class ToxicityModel:
    def __init__(self, known: dict[str, int], marks: np.ndarray, docs: list[list[bytes]], toxic: np.ndarray, p: ToxicityParams):
        """docs: tokens of whole documents.  marks: which features make a token of a toxic document a toxic one."""
        self.known = known
        types = Types(known)
        ids = np.array([types[t] for d in docs for t in d], np.int64)
        sizes = np.array([len(d) for d in docs])
        starts = np.zeros(len(ids))
        starts[np.cumsum(sizes) - sizes] = 1
        sets = list(types.sets)
        at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        feature = np.array([f for s in sets for f in s], np.int64)
        marked = np.bincount(at, marks[feature], len(sets)) > 0
        y = marked[ids] & (np.repeat(toxic, sizes) > 0)
        self.w, self.bias, self.chain, ascent = np.zeros(len(known)), -3.0, Chain(), Adam(p.rate)
        for _ in range(p.rounds):
            ascent.tick()
            emission = self.bias + np.bincount(at, self.w[feature], len(sets))
            of_token, of_transition, of_first = self.chain.gradient(emission[ids], starts, y)
            of_set = np.bincount(ids, of_token, len(sets))
            n = max(1, len(docs))
            self.w = ascent.step("w", self.w, np.bincount(feature, of_set[at], len(known)) / n - 1e-4 * self.w)
            self.bias = float(ascent.step("b", np.array(self.bias), of_set.sum() / n))
            self.chain.transition = np.clip(ascent.step("t", self.chain.transition, of_transition / n - 1e-3 * self.chain.transition), -5, 5)
            self.chain.first = float(np.clip(ascent.step("f", np.array(self.chain.first), of_first / n), -5, 5))
        self.last = calibrate(self.summary(self.marginals(ids, starts, types), sizes), toxic)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "types"}

    def marginals(self, ids: np.ndarray, starts: np.ndarray, types: Types) -> np.ndarray:
        emission = np.array([self.bias + sum(self.w[f] for f in s) for s in types.sets])
        return self.chain.marginals(emission[ids], starts)

    @staticmethod
    def summary(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each document: log-odds of its most toxic token, expected number of toxic tokens, and their share."""
        top, total = np.full(len(sizes), 1e-6), np.zeros(len(sizes))
        full = np.flatnonzero(sizes)
        if len(full):
            heads = (np.cumsum(sizes) - sizes)[full]
            top[full], total[full] = np.clip(np.maximum.reduceat(p, heads), 1e-6, 1 - 1e-6), np.add.reduceat(p, heads)
        return np.stack([np.log(top / (1 - top)), np.log1p(total), np.sqrt(total / np.maximum(sizes, 1))], 1)

    def score(self, texts: list[str | None], types: Types) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores and toxic spans (character offsets) of whole texts."""
        docs = [(t or "").encode().split() for t in texts]
        sizes = np.array([len(d) for d in docs])
        ids = np.fromiter((types[t] for d in docs for t in d), np.int64, int(sizes.sum()))
        heads = np.cumsum(sizes) - sizes
        starts = np.zeros(len(ids))
        starts[heads[sizes > 0]] = 1
        p = self.marginals(ids, starts, types)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        hits = np.flatnonzero(p >= 0.5)
        for d in np.unique(np.searchsorted(heads + sizes, hits, "right")):
            own = set((hits[(hits >= heads[d]) & (hits < heads[d] + sizes[d])] - heads[d]).tolist())
            last = -2
            for i, m in enumerate(TOKEN.finditer(texts[d])):
                if i in own:
                    if i == last + 1:
                        spans[d][-1] = spans[d][-1][0], m.end()
                    else:
                        spans[d].append(m.span())
                    last = i
        return logistic(self.summary(p, sizes), self.last), spans


def learn(rows: DataFrame, labels: DataFrame, label_col: str, learn_from: Column | None, p: ToxicityParams) -> tuple[ToxicityModel | None, float]:
    """(model, share of toxic documents); no model without documents of both kinds."""
    chosen = materialise(sampled(labelled_rows(rows, labels, label_col, learn_from), p.lexicon_docs, p.sample_bytes, p.seed), "toxic-sample")
    n = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    toxic, clean = sum(v for k, v in n.items() if k > 0), sum(v for k, v in n.items() if k <= 0)
    share = toxic / (toxic + clean) if toxic + clean else 0.5
    if not toxic or not clean:
        return None, share

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = Counter()
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                found.update((f, y > 0) for f in {f for t in set((text or "").encode().split()) for f in features(t)})
            yield pd.DataFrame([(f, n if y else 0, 0 if y else n) for (f, y), n in found.items()], columns=["f", "toxic", "clean"])

    counts = chosen.mapInPandas(count, "f string, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    # Features of a bounded sample, and of these the ones that tell something.
    lexicon = counts.filter(F.col("toxic") >= p.least).withColumn("ratio", ratio).filter("ratio >= 2").orderBy("f").toPandas()
    if lexicon.empty:
        return None, share
    marks = (lexicon["ratio"] >= p.ratio).to_numpy()
    fraction = min(1.0, p.chain_docs / (toxic + clean))
    picked = chosen.filter(F.pmod(F.xxhash64(F.lit(p.seed + 1), "id", "text"), F.lit(1 << 30)) < F.lit(int(fraction * (1 << 30)))).orderBy("id", "text").select("text", "y").toPandas()
    if picked["y"].gt(0).nunique() < 2:
        return None, share
    known = {f: i for i, f in enumerate(lexicon["f"])}
    return ToxicityModel(known, marks, [(t or "").encode().split() for t in picked["text"]], (picked["y"] > 0).to_numpy(float), p), share


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Score the toxicity of every whole text and find its toxic spans.

    Tokens are tagged by a linear-chain field with features of the word and of
    its beginnings.  Tokens to learn from come from labelled documents: those
    of toxic documents with a feature that is much likelier there are toxic,
    all others aren't.  Forward-backward marginals give the spans, and their
    maximum, sum and share give a document's score.

    Returns id, score (0 to 1) and spans (character offsets start, end of runs
    of toxic tokens).  Null and empty texts have no token and get the score of
    a text without any sign of toxicity.  Without labels of both kinds every
    score is the share of toxic labels, or 0.5 without any.  Null ids and
    repeated rows are scored like others; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = narrow(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    model, share = learn(rows, labels, label_col, learn_from, params)
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        types = Types(shared.value.known) if shared.value else None
        for pdf in batches:
            scores, spans = shared.value.score(pdf["text"].tolist(), types) if shared.value else (share, [[]] * len(pdf))
            yield pd.DataFrame({"id": pdf["id"], "score": scores, "spans": [[{"start": a, "end": b} for a, b in s] for s in spans]})

    return rows.mapInPandas(predict, f"id {docs.schema[id_col].dataType.simpleString()}, score double, spans array<struct<start: int, end: int>>")
