"""Language identification by prediction by partial matching."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialise, narrow, small_batches

U = np.uint64
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: Bytes scored in one go.
PIECE = 1 << 18
#: Bits of a byte below order 0, where all bytes are alike.
UNIFORM = 8.0
#: ASCII white space is a space.
FOLD = np.array([32 if i in (9, 10, 11, 12, 13) else i for i in range(256)], np.uint8)


@dataclass(frozen=True)
class PpmParams:
    """order: longest context in bytes, 7 at most.

    docs_per_language, bytes_per_language: the model is learned from about so
    many documents, and bytes, of each language, chosen by a hash of id and text.
    broadcast_languages: beyond so many languages their sizes aren't broadcast.
    """

    order: int = 4
    docs_per_language: int = 1500
    bytes_per_language: int = 4 << 20
    broadcast_languages: int = 10_000
    seed: int = 7


class Index:
    """Places of sorted distinct codes, by open addressing."""

    def __init__(self, codes: np.ndarray):
        width = max(4, int(2 * len(codes)).bit_length())
        self.codes, self.shift, self.mask = codes, U(64 - width), (1 << width) - 1
        self.slots = np.zeros(1 << width, np.int32)
        left, at = np.arange(len(codes)), self._home(codes)
        while len(left):
            free = left[self.slots[at[left]] == 0]
            self.slots[at[free]] = free + 1
            left = left[self.slots[at[left]] != left + 1]
            at[left] = (at[left] + 1) & self.mask

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return (((codes ^ (codes >> U(29))) * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Place of each code, -1 for one that isn't there."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = self._home(codes)
        out = self.slots[at].astype(np.int64) - 1
        other = np.flatnonzero((out >= 0) & (self.codes[out] != codes))
        while len(other):
            at[other] = (at[other] + 1) & self.mask
            out[other] = self.slots[at[other]].astype(np.int64) - 1
            other = other[(out[other] >= 0) & (self.codes[out[other]] != codes[other])]
        return out


def low(size: int) -> np.uint64:
    """Mask of the last ``size`` bytes of a code."""
    return U((1 << 8 * size) - 1)


class PpmModel:
    """Byte-context trees of each language under frozen counts.

    All 256 bytes are symbols (ASCII letters lower-cased, white space as
    space).  A context of order k predicts a byte seen after it with
    count / (total + distinct), and escapes with distinct / (total + distinct)
    to order k - 1; below order 0 all bytes are alike.  An unseen context costs
    nothing to leave.

    The byte after a context is a number of k + 1 bytes.  For each such number
    that occurs in a language, its code length in all languages, escapes
    included, is a row; scoring looks rows up from the longest context down.
    """

    def __init__(self, langs: list[str], order: int, lang: np.ndarray, code: np.ndarray, n: np.ndarray):
        """n: how often ``code`` (of order + 1 bytes) occurs in the language numbered ``lang``."""
        self.langs, self.order = langs, order
        self.codes, self.bits, self.contexts, self.leave = [], [], [], []
        lower = np.full((1, len(langs)), UNIFORM)
        for k in range(order + 1):
            codes, at = np.unique(code & low(k + 1), return_inverse=True)
            seen = np.bincount(at * len(langs) + lang, n, len(codes) * len(langs)).reshape(len(codes), len(langs))
            contexts, c = np.unique(codes >> U(8), return_inverse=True)
            total, distinct = np.zeros((2, len(contexts), len(langs)))
            np.add.at(total, c, seen)
            np.add.at(distinct, c, seen > 0)
            below = np.searchsorted(self.codes[-1], codes & low(k)) if k else np.zeros(len(codes), np.int64)
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(total > 0, np.log2((total + distinct) / distinct), 0)
                lower = np.where(seen > 0, np.log2((total + distinct)[c] / seen), leave[c] + lower[below])
            self.codes.append(codes)
            self.bits.append(lower.astype(np.float32))
            self.contexts.append(contexts)
            self.leave.append(leave.astype(np.float32))
        self._index: list[tuple[Index, Index]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text in each language; texts must not be empty."""
        out = np.zeros((len(texts), len(self.langs)))
        held, first, size = [], 0, 0
        for i, text in enumerate(texts):
            held.append(text)
            size += len(text)
            if size >= 8 * PIECE or i + 1 == len(texts):
                out[first : i + 1] = self._lengths_of(held)
                held, first, size = [], i + 1, 0
        return out

    def _lengths_of(self, texts: list[bytes]) -> np.ndarray:
        raw, inside, starts = laid(texts, self.order)
        out = np.zeros((len(texts), len(self.langs)))
        for lo in range(0, len(inside), PIECE):
            bits = self._bits(codes_at(raw, inside[lo : lo + PIECE], self.order))
            doc = int(np.searchsorted(starts, lo, "right")) - 1
            cuts = np.concatenate([[0], starts[(starts > lo) & (starts < lo + len(bits))] - lo])
            out[doc : doc + len(cuts)] += np.add.reduceat(bits, cuts, 0, dtype=np.float64)
        return out

    def _bits(self, codes: np.ndarray) -> np.ndarray:
        if self._index is None:
            self._index = [(Index(a), Index(b)) for a, b in zip(self.codes, self.contexts, strict=True)]
        out = np.zeros((len(codes), len(self.langs)), np.float32)
        open_ = np.arange(len(codes))
        for k in range(self.order, -1, -1):
            symbols, contexts = self._index[k]
            mine = codes[open_] & low(k + 1)
            at = symbols.find(mine)
            hit = at >= 0
            out[open_[hit]] += self.bits[k][at[hit]]
            open_, mine = open_[~hit], mine[~hit]
            if not len(open_):
                return out
            at = contexts.find(mine >> U(8))
            out[open_[at >= 0]] += self.leave[k][at[at >= 0]]
        out[open_] += UNIFORM
        return out


def plain(text: str) -> bytes:
    return text.encode().lower()


def laid(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, each after ``order`` spaces; places of the texts' bytes; number of the first of each text)."""
    gap = b" " * order
    raw = FOLD[np.frombuffer(gap + gap.join(texts), np.uint8)]
    sizes = np.array([len(t) for t in texts])
    inside = np.arange(int(sizes.sum())) + np.repeat(order * np.arange(1, len(texts) + 1), sizes)
    return raw, inside, np.cumsum(sizes) - sizes


def codes_at(raw: np.ndarray, places: np.ndarray, order: int) -> np.ndarray:
    """The byte at each place and the ``order`` bytes before it as one number."""
    out = np.zeros(len(places), U)
    for i in range(order, -1, -1):
        out = (out << U(8)) | raw[places - i]
    return out


def split(text_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; -1 for a row without id, which is in no part."""
    return F.coalesce(F.pmod(F.crc32(text_id.cast("string").cast("binary")), F.lit(parts)), F.lit(-1))


def fit(labelled: DataFrame, params: PpmParams) -> PpmModel | None:
    """Learn from (id, text, lang); None where nothing is labelled."""
    p = params
    sizes = materialise(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text")).alias("bytes")), "ppm-sizes")
    part = F.least(F.lit(1.0), F.lit(float(p.docs_per_language)) / F.col("docs"), F.lit(float(p.bytes_per_language)) / F.col("bytes"))
    shares = sizes.select("lang", part.alias("part"))
    if sizes.count() <= p.broadcast_languages:
        shares = F.broadcast(shares)
    drawn = F.pmod(F.xxhash64(F.lit(p.seed), "id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = materialise(labelled.join(shares, "lang").filter(drawn < F.col("part")).select("lang", "text"), "ppm-sample")
    langs = [r["lang"] for r in chosen.select("lang").distinct().orderBy("lang").collect()]  # the labels of the model
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                raw, inside, _ = laid([plain(t) for t in texts], p.order)
                codes, n = np.unique(codes_at(raw, inside, p.order), return_counts=True)
                yield pd.DataFrame({"lang": number[lang], "code": codes.view(np.int64), "n": n})

    # Bounded by the sample, whose size is a parameter.
    counts = chosen.mapInPandas(count, "lang int, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    return PpmModel(langs, p.order, counts["lang"].to_numpy(np.int64), counts["code"].to_numpy(np.int64).view(U), counts["n"].to_numpy(float))


def identify(docs: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", params: PpmParams = PpmParams(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of every whole text.

    Learns from rows of ``learn_from`` (a condition on the columns id, text and
    lang; all by default) with text and language, and predicts all rows.

    Returns id, lang_pred, score, bits_per_byte, and the columns of ``keep``.
    score is the posterior of the prediction with code lengths tempered by the
    text's length (1 for one learned language).  Null text, text without any
    letter, and all text where nothing could be learned is ``und`` with score
    0.  Ties go to the language first in code-point order.  Null ids and
    repeated rows are documents like others; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = narrow(docs, id=id_col, text=text_col, lang=lang_col, **{f"keep_{i}": k for i, k in enumerate(keep)})
    rows = rows.withColumn("text", F.col("text").cast("string")).withColumn("lang", F.col("lang").cast("string"))
    labelled = rows.filter("lang is not null and length(text) > 0")
    if learn_from is not None:
        labelled = labelled.filter(learn_from)
    model = spark.sparkContext.broadcast(fit(labelled.select("id", "text", "lang"), params))
    kept = [f"keep_{i}" for i in range(len(keep))]
    fields = ", ".join(f"{f} {rows.schema[f].dataType.simpleString()}" for f in ["id", *kept])

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ppm = model.value
        for pdf in batches:
            known = [i for i, t in enumerate(pdf["text"]) if t and ppm is not None and LETTER.search(t)]
            pred, score, rate = np.full(len(pdf), UNKNOWN, object), np.zeros(len(pdf)), np.full(len(pdf), np.nan)
            if known:
                texts = [plain(pdf["text"].iat[i]) for i in known]
                sizes = np.array([len(t) for t in texts])
                bits = ppm.lengths(texts)
                best = bits.argmin(1)
                low = bits.min(1)
                odds = np.exp2(-(bits - low[:, None]) / (1 + sizes / 64)[:, None])
                pred[known], score[known], rate[known] = np.array(ppm.langs, object)[best], 1 / odds.sum(1), low / sizes
            yield pd.DataFrame({c: pdf[c] for c in ["id", *kept]} | {"lang_pred": pred, "score": score, "bits_per_byte": rate})

    out = rows.select("id", *kept, "text").mapInPandas(predict, f"{fields}, lang_pred string, score double, bits_per_byte double")
    return out.select("id", "lang_pred", "score", "bits_per_byte", *[F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)])
