"""Documents: chunks, tags of paths, criticality, similar names, summaries, question types."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tagloom.functions.scalar import content_hash
from tagloom.operators.lineage import cut
from tagloom.operators.overlap import jaccard_sums

#: Headings, and where sentences end; so are the sizes of chunks below.
HEADING = re.compile(r"^(#{1,6}\s+.+|[A-Z][A-Z\s]{3,}[A-Z])$", re.MULTILINE)
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def pack(parts: list[str], size: int, glue: str, overlap: int = 0) -> list[str]:
    """Parts put together up to ``size`` characters; a new piece begins with the last ``overlap`` ones of the piece before, from the first sentence that begins there."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(glue) + len(part) <= size:
            out[-1] += glue + part
        elif out and overlap and len(out[-1]) > overlap:
            rest = out[-1][-overlap:]
            begin = rest.find(". ")
            out.append((rest[begin + 2 :] if begin > 0 else rest) + glue + part)
        else:
            out.append(part)
    return out


def sections(text: str) -> list[tuple[str | None, str]]:
    """(title, body) of a text with markdown or capital headings; the whole text where there is none."""
    heads = list(HEADING.finditer(text))
    cuts = [(None, 0, heads[0].start() if heads else len(text))]
    cuts += [(h.group().strip().lstrip("#").strip(), h.end(), n.start() if n else len(text)) for h, n in zip(heads, [*heads[1:], None], strict=True)] if heads else []
    found = [(t, text[a:b].strip()) for t, a, b in cuts]
    return [(t, b) for t, b in found if b] or [(None, text)]


def chunks(text: str | None, size: int = 2000, overlap: int = 400, least: int = 200) -> list[tuple[str | None, str]]:
    """(section, chunk): by sections, in these by paragraphs, in too long ones by sentences; a small rest joins the chunk before."""
    if not text or not text.strip():
        return []
    if len(text) <= size:
        return [(None, text.strip())]
    out: list[tuple[str | None, str]] = []
    for title, body in sections(text):
        paragraphs = [p.strip() for p in re.split(r"\n\s*\n", body) if p.strip()]
        parts = [s for p in paragraphs for s in (pack(SENTENCE_END.split(p), size, " ", overlap) if len(p) > 1.5 * size else [p])]
        packed = [p.strip() for p in pack(parts, size, "\n\n", overlap)] if len(body) > size else [body]
        if len(packed) > 1 and len(packed[-1]) < least:
            packed[-2:] = [packed[-2] + "\n\n" + packed[-1]]
        out.extend((title, p) for p in packed if p)
    return out


def embedding_chunks(text: str | None, size: int = 1000) -> list[str]:
    """Pieces of at most ``size`` characters, cut between sentences, else between words."""
    if not text or not text.strip():
        return []
    parts = pack(SENTENCE_END.split(text.strip()), size, " ")
    return [p for part in parts for p in ([part] if len(part) <= size else pack(part.split(), size, " "))]


#: Characters and rows of texts that a Python worker handles at once.
SLICE_CHARS, SLICE_ROWS = 4_000_000, 500


def slices(table: pa.RecordBatch) -> Iterator[pd.DataFrame]:
    """The rows of a batch as small frames: as Python strings, a batch of long texts would take several times its size."""
    ends, lo = np.cumsum(pc.fill_null(pc.utf8_length(table["text"]), 0).to_numpy(zero_copy_only=False)), 0
    while lo < table.num_rows:
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_CHARS, "right"))
        hi = min(max(hi, lo + 1), lo + SLICE_ROWS)
        yield table.slice(lo, hi - lo).to_pandas()
        lo = hi


def map_texts(docs: DataFrame, make: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``make`` over rows (id, text, ...) in ``slices``."""
    kinds = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pdf in slices(batch):
                yield pa.RecordBatch.from_pandas(make(pdf), schema=kinds, preserve_index=False)

    return docs.mapInArrow(run, schema)


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2000, overlap: int = 400) -> DataFrame:
    """(id, chunk_index, total, section, chunk) of every document."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(i, n, len(found), t, c) for i, text in zip(pdf["id"], pdf["text"], strict=True) for found in [chunks(text, size, overlap)] for n, (t, c) in enumerate(found)]
        return pd.DataFrame(rows, columns=["id", "chunk_index", "total", "section", "chunk"])

    return map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, "id long, chunk_index int, total int, section string, chunk string")


def new_chunks(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose hash is neither stored (content_hash) nor on an earlier chunk of the batch."""
    hashed = found.withColumn("content_hash", content_hash(F.col("chunk")))
    w = Window.partitionBy("content_hash").orderBy("id", "chunk_index")
    return hashed.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").join(stored.select("content_hash"), "content_hash", "left_anti")


#: Tags by the ending of an ingested file.
FILE_TAGS = {
    "py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rs": "rust", "rb": "ruby",
    "md": "markdown", "pdf": "pdf", "docx": "word-doc", "json": "json", "csv": "data", "sql": "sql",
    "html": "html", "css": "css", "tex": "latex", "yaml": "config", "yml": "config", "toml": "config",
}
#: Tags by the ending of a document.
DOCUMENT_TAGS = {
    "txt": "text", "md": "markdown", "rst": "restructuredtext", "csv": "csv", "tsv": "tsv", "log": "log", "json": "json", "jsonl": "jsonl",
    "xml": "xml", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "config", "cfg": "config", "env": "config", "properties": "config",
    "html": "html", "htm": "html", "css": "css", "tex": "latex", "bib": "latex", "py": "python", "js": "javascript", "ts": "typescript",
    "sh": "shell", "bat": "batch", "ps1": "powershell", "sql": "sql", "r": "r", "jl": "julia", "go": "go", "rs": "rust", "java": "java",
    "c": "c", "cpp": "cpp", "h": "header",
}
#: Folders and names that give no tag.
PLAIN_FOLDERS = ("src", "lib", "dist")
PLAIN_DOCUMENT_FOLDERS = ("src", "lib", "dist", "app", "docs", "doc")
PLAIN_STEMS = ("readme", "index", "main", "app")
#: Ending and name of a file's path; a name that begins with a dot has no ending.
ENDING, STEM = r"[^/]\.([^./]+)$", r"([^/]+?)(?:\.[^./]+)?$"


def _tag_of(part: Column) -> Column:
    return F.translate(F.lower(part), " _", "--")


def _folder_tags(path: Column, plain: tuple[str, ...]) -> Column:
    parts = F.split(path, "/")
    return F.filter(F.transform(F.slice(parts, 1, F.size(parts) - 1), _tag_of), lambda n: (F.length(n) > 1) & ~n.isin(*plain))


def _kind(path: Column, kinds: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return F.element_at(table, F.lower(F.regexp_extract(path, ENDING, 1)))


def file_tags(path: Column) -> Column:
    """Tags of an ingested file, by its path below the base: kind of the ending, folders, ``document``.  A null path gives null."""
    return F.filter(F.concat(F.array(_kind(path, FILE_TAGS)), _folder_tags(path, PLAIN_FOLDERS), F.array(F.lit("document"))), lambda n: n.isNotNull())


def document_tags(path: Column) -> Column:
    """Tags of a document, by its path below the base: ``document``, kind of the ending, the ending itself, name, folders.  A null path gives null."""
    ending, stem = F.lower(F.regexp_extract(path, ENDING, 1)), _tag_of(F.regexp_extract(path, STEM, 1))
    named = F.array(
        F.lit("document"),
        _kind(path, DOCUMENT_TAGS),
        F.when(ending != "", F.concat(F.lit("ext:"), ending)),
        F.when((F.length(stem) > 2) & ~stem.isin(*PLAIN_STEMS), stem),
    )
    return F.filter(F.concat(named, _folder_tags(path, PLAIN_DOCUMENT_FOLDERS)), lambda n: n.isNotNull())


def parts(text: str | None, path: str, size: int = 3000, overlap: int = 200) -> list[str]:
    """Pieces of a document by paragraphs, headed by its path; each but the first begins with the last characters of the piece before.

    A null or blank text has none; a paragraph longer than a piece stays whole.
    """
    if not text or not text.strip():
        return []
    if len(text) <= size:
        return [f"[{path}]\n\n{text.strip()}"]
    out: list[str] = []
    for part in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        if out and len(out[-1]) + 2 + len(part) <= size:
            out[-1] += "\n\n" + part
        elif out and 0 < overlap < len(out[-1]):
            out.append(out[-1][-overlap:] + "\n\n" + part)
        else:
            out.append(part)
    return [f"[{path} (part {n}/{len(out)})]\n\n{piece.strip()}" for n, piece in enumerate(out, 1)]


def document_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", size: int = 3000, overlap: int = 200) -> DataFrame:
    """(id, chunk_index, total, chunk) of every document; a null path is empty."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(i, n, len(found), c) for i, text, path in zip(pdf["id"], pdf["text"], pdf["path"], strict=True) for found in [parts(text, path, size, overlap)] for n, c in enumerate(found)]
        return pd.DataFrame(rows, columns=["id", "chunk_index", "total", "chunk"])

    return map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(path_col, F.lit("")).alias("path")), make, "id long, chunk_index int, total int, chunk string")


def criticality(doc_tags: DataFrame, known: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Documents (doc_id, tags) that matter to the network of tags (known: name, cnt), and those for reference.

    Coverage of the tags by known ones, times 0.6 + 0.4 mean weight over the
    largest; with two documents or more, 0.6 of that and 0.4 of the mean
    Jaccard with the other documents, all of them (``jaccard_sums``).
    """
    flat = doc_tags.select("doc_id", F.explode(F.array_distinct("tags")).alias("name"))
    sizes = doc_tags.select("doc_id", F.size(F.array_distinct("tags")).alias("_n"))
    weights = flat.join(known.select("name", F.log1p(F.col("cnt").cast("double")).alias("_w")), "name").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_k"), F.avg("_w").alias("_avg"), F.max("_w").alias("_max"))
    numbered = cut(flat.select("name").filter("name is not null").distinct().withColumn("_i", F.monotonically_increasing_id()))
    sets = flat.filter("doc_id is not null").join(numbered, "name").groupBy(F.col("doc_id").alias("item")).agg(F.sort_array(F.collect_list("_i")).alias("tags")).withColumn("scope", F.lit(0))
    density = sets.join(jaccard_sums(sets), ["scope", "tags"]).select(F.col("item").alias("doc_id"), F.col("total").alias("_j"))
    total = doc_tags.agg(F.count(F.lit(1)).alias("_docs"))
    joined = sizes.join(weights, "doc_id", "left").join(density, "doc_id", "left").crossJoin(F.broadcast(total))
    relevance = F.when(F.col("_k") > 0, F.col("_k") / F.col("_n") * (0.6 + 0.4 * F.when(F.col("_max") > 0, F.col("_avg") / F.col("_max")).otherwise(0.0))).otherwise(0.0)
    dense = F.coalesce("_j", F.lit(0.0)) / (F.col("_docs") - 1)
    score = F.when((F.col("_docs") >= 2) & (F.col("_n") > 0), 0.6 * relevance + 0.4 * dense).otherwise(relevance)
    return joined.select("doc_id", score.alias("score"), F.when(score >= threshold, "critical").otherwise("reference").alias("class"))


def similar_names(names: DataFrame, wanted: list[str], ratio: float = 0.8) -> DataFrame:
    """Names with a Ratcliff-Obershelp ratio of ``ratio`` or more to a wanted one."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, n, r) for n in pdf["name"] for w in wanted if (r := SequenceMatcher(None, w, n).ratio()) >= ratio]
            yield pd.DataFrame(rows, columns=["wanted", "name", "ratio"])

    return names.select("name").mapInPandas(find, "wanted string, name string, ratio double")


def summarise(text: str | None, limit: int = 500) -> str:
    """Headings, the first sentence, and first items of lists of a text, up to a length."""
    if not text or not text.strip():
        return ""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    heads = [h.group().strip().lstrip("#").strip() for h in HEADING.finditer(text)][:5]
    prose = next((x for x in lines if not x.startswith(("#", "-", "*")) and not HEADING.match(x)), lines[0])
    items = [x.lstrip("-* ") for x in lines if x.startswith(("- ", "* "))][:3]
    return " | ".join([x for x in ["; ".join(heads), SENTENCE_END.split(prose)[0], "; ".join(items)] if x])[:limit]


#: Declarations of common languages, one pattern for each kind.
DECLARATIONS = {
    "class": re.compile(r"^\s*(?:export\s+|public\s+|abstract\s+|final\s+)*(?:class|interface|trait|struct|enum|impl|module)\s+([A-Za-z_]\w*)", re.MULTILINE),
    "function": re.compile(r"^\s*(?:export\s+|public\s+|private\s+|static\s+|async\s+|pub\s+)*(?:def|fn|func|function|sub|proc)\s+([A-Za-z_]\w*)", re.MULTILINE),
    "import": re.compile(r"^\s*(?:import|from|use|require|include|using|#include)\b\s*[<\"'(]?([\w./:]+)", re.MULTILINE),
}


def summarise_code(text: str | None, most: int = 12) -> str:
    """Names of what a source file declares and imports."""
    found = {k: list(dict.fromkeys(p.findall(text or "")))[:most] for k, p in DECLARATIONS.items()}
    return "; ".join(f"{k}: {', '.join(v)}" for k, v in found.items() if v)


def summaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", code: bool = False) -> DataFrame:
    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": pdf["id"], "summary": [summarise_code(t) if code else summarise(t) for t in pdf["text"]]})

    return map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, "id long, summary string")


#: What a question for a detail matches, in any case.
DETAIL = (
    r"\bwhat (?:is|are|was|were) the (?:default|exact|specific|target|recommended)\b",
    r"\bwhat (?:is|are|was|were) the (?:name|metric|threshold|limit|percentage|duration|period|value|score|count|number|size|rate|cost|price|fee|credit)\b",
    r"\bhow (?:long|many|much|often)\b",
    r"\bwhat (?:percentage|ratio|fraction|proportion)\b",
    r"\bwhat (?:device|mode|version|firmware|configuration|setting)\b",
    r"\bwhat (?:metric|counter|gauge|alert)\b",
    r"\b(?:percentage|percent|latency|threshold|timeout|limit|credit|fee|price|cost|budget|cap)\w*\b.*\b(?:propos|specif|set|target|report|observ|measur)",
    r"\b(?:root cause|misconfiguration|bug|error|failure mode)\b",
)
#: Words that are no terms.
STOP_WORDS = (
    "a an the is are was were what which how does did do will would could should can may might have has had been being for of in on at to by with "
    "from and or but not this that these those it its they their them he she his her about after before between into through during when where who "
    "whom whose why new recent specific default current proposed recommended according describe"
).split()


def classify_questions(questions: DataFrame, text_col: str = "question") -> DataFrame:
    """Type (detail or broad) and terms of each question: its words of three letters and more, and its quoted phrases."""
    text = F.col(text_col)
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9_.\-/]+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    phrases = F.regexp_extract_all(F.lower(text), F.lit('"([^"]+)"'))
    detail = F.lit(False)
    for pattern in DETAIL:
        detail |= text.rlike("(?i)" + pattern)
    return questions.withColumns({"question_type": F.when(detail, "detail").otherwise("broad"), "terms": F.concat(words, phrases)})


def relevant_sentences(text: Column, terms: Column) -> Column:
    """Sentences with one of the terms; the whole text where there is none."""
    found = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.exists(terms, lambda t: F.lower(s).contains(t)))
    return F.when(F.size(found) > 0, F.concat_ws(" ", found)).otherwise(text)


#: Concepts and the signs that stand for them, an example; a lexicon is a parameter.
LEXICON = {"time": "τ", "change": "Δ", "flow": "≈", "love": "♥", "death": "†", "light": "☼", "dark": "●", "water": "~", "fire": "△", "earth": "▽", "mind": "Ψ", "order": "≡", "chaos": "※", "life": "∞", "open": "○", "path": "→"}
OPPOSITES = [("light", "dark"), ("life", "death"), ("order", "chaos"), ("fire", "water")]


def glyph_tags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: dict[str, str] = LEXICON) -> DataFrame:
    """(id, concept, glyph, hits) of the lexicon's concepts in each text; concepts of several words by substring."""
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(sorted(lexicon.items()), "concept string, glyph string"))
    words = docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("concept")).join(table, "concept").groupBy("id", "concept", "glyph").agg(F.count(F.lit(1)).alias("hits"))
    many = {k: v for k, v in lexicon.items() if " " in k}
    for k, v in many.items():
        hit = docs.select(F.col(id_col).alias("id"), F.lit(k).alias("concept"), F.lit(v).alias("glyph"), F.col(text_col).alias("t")).filter(F.lower("t").contains(k))
        words = words.unionByName(hit.select("id", "concept", "glyph", F.lit(1).cast("long").alias("hits")))
    return words


def project_overview(files: DataFrame) -> DataFrame:
    """Files and bytes of each folder and ending (path, length)."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return files.groupBy(folder.alias("folder"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


