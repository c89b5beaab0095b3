"""Dialogue corpora from files: archives, JSON and text, walked into rows of utterances, labels and turns.

Spark reads the files (any store it can read); each task walks one file at a time. Archives are never unpacked to disk.
Rows: (path, entry, kind, key, value, blob, n). Kinds: `text` (an utterance with its dict's labels as blob), `label`,
`turns` (length of a conversation list), `seen`, `sampled`, `document`, `skipped` (too large or unreadable; the key says
why), `truncated` (an archive has further entries that were not sampled), `error` (by type).
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What the corpora's fields and files are called, and the size limit.
TEXT_FIELDS = frozenset(("text", "utterance", "utterances", "user_utterance", "system_utterance", "summary", "sentence", "content", "body", "발화", "문장", "대화", "요약"))
LABEL_FIELDS = frozenset(("category", "domain", "type", "topic", "relation", "speaker_relation", "speaker_emotion", "speaker_changeemotion", "listener_behavior", "listener_empathy", "role", "grade", "mediatype", "medianame", "speech_level", "source"))
EMOTION_FIELDS = frozenset(("speaker_emotion", "speaker_changeemotion", "listener_behavior", "listener_empathy", "emotion", "감정"))
COLLECTION_FIELDS = frozenset(("utterances", "dialogue", "dialogs", "conversation", "conversations", "data"))
LINE_SUFFIXES = (".txt", ".ban", ".sho", ".yo")
MAX_JSON = 15 * 1024 * 1024

SCHEMA = "path string, entry string, kind string, key string, value string, blob string, n long"


def label_like(value: str) -> bool:
    return 0 < len(value) <= 40 and not any(c in value for c in "\n\r.?!。…")


def walk(document) -> Iterator[tuple[str, str | None, str | None, str | None, int | None]]:
    """(kind, key, value, blob, n) of one JSON document, parents before children. A list is a conversation at most once:
    under a collection's name, or by itself if its first five items are dicts and one of them holds text."""
    counted: set[int] = set()
    stack = [document]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            named = [(k, str(k).lower(), v) for k, v in x.items()]
            labels = [(k, v) for k, low, v in named if low in LABEL_FIELDS and isinstance(v, str) and label_like(v)]
            yield from (("label", k, v, None, None) for k, v in labels)
            blob = " ".join(v for _, v in labels)
            for k, low, v in named:
                if low in TEXT_FIELDS and isinstance(v, str):
                    yield "text", k, v, blob, None
                if low in COLLECTION_FIELDS and isinstance(v, list):
                    counted.add(id(v))
                    yield "turns", k, None, None, len(v)
            stack += [v for *_, v in reversed(named)]
        elif isinstance(x, list):
            first = x[:5]
            if id(x) not in counted and first and all(isinstance(v, dict) for v in first) and any(str(k).lower() in TEXT_FIELDS for v in first for k in v):
                yield "turns", None, None, None, len(x)
            stack += reversed(x)


def decode_lines(data: bytes) -> list[str]:
    """Lines that are not blank, of UTF-8 or else of cp949 with what is malformed left out."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("cp949", errors="ignore")
    return [s for line in text.splitlines() if (s := line.strip())]


def _entry(name: str, size: int, read, large: str) -> Iterator[tuple]:
    low = name.lower()
    if low.endswith(".json"):
        if size > MAX_JSON:
            yield "skipped", large, None, None, size
            return
        try:
            document = json.loads(read().decode("utf-8-sig"))
        except (ValueError, RecursionError) as error:  # malformed, or nested too deeply
            yield "skipped", type(error).__name__, None, None, None
            return
        yield "document", None, None, None, None
        yield from walk(document)
    elif low.endswith(LINE_SUFFIXES):
        yield "document", None, None, None, None
        yield from (("text", None, line, "", None) for line in decode_lines(read()))


def file_rows(path: str, content: bytes, limit: int = 0) -> Iterator[tuple]:
    """Rows of one file; `limit` (0: none) is the number of supported entries sampled from an archive."""
    if not path.lower().endswith(".zip"):
        yield from ((path, None, *row) for row in _entry(path, len(content), lambda: content, "JsonFileTooLarge"))
        return
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            sampled, cut = 0, False
            for info in archive.infolist():
                if info.is_dir():
                    continue
                yield path, info.filename, "seen", None, None, None, info.file_size
                if not info.filename.lower().endswith((".json", *LINE_SUFFIXES)):
                    continue
                if limit and sampled >= limit:
                    cut = True
                    continue
                sampled += 1
                yield path, info.filename, "sampled", None, None, None, None
                yield from ((path, info.filename, *row) for row in _entry(info.filename, info.file_size, lambda i=info: archive.read(i), "JsonEntryTooLarge"))
            if cut:
                yield path, None, "truncated", None, None, None, limit
    except (zipfile.BadZipFile, OSError, RuntimeError) as error:
        yield path, None, "error", type(error).__name__, None, None, None


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def plain(path):
    """A Column of paths without their scheme."""
    return F.regexp_replace(path, "^(file|hdfs|viewfs|s3a?|gs):/+", "/")


def qualified(spark: SparkSession, root: str) -> str:
    """`root` as Spark lists it, without its scheme and with a slash at its end."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    return re.sub(r"^\w+:/+", "/", full).rstrip("/") + "/"


def corpus_rows(files: DataFrame, limit: int = 0) -> DataFrame:
    """All rows of files(path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            held = []
            for path, content in zip(batch["path"], batch["content"]):
                for row in file_rows(path, content, limit):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=names).astype({"n": "Int64"})
                        held = []
            if held:
                yield pd.DataFrame(held, columns=names).astype({"n": "Int64"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def utterances(rows: DataFrame, dataset) -> DataFrame:
    """utterances(dataset, text, context_blob) for the bank; `dataset`: a Column over path."""
    return rows.where("kind = 'text'").select(dataset.alias("dataset"), F.col("value").alias("text"), F.coalesce("blob", F.lit("")).alias("context_blob"))


def labels(rows: DataFrame, emotions: bool = False) -> DataFrame:
    """labels(key, value); with `emotions`, those of emotion fields only."""
    out = rows.where("kind = 'label'").select("key", "value")
    return out.where(F.lower("key").isin(*EMOTION_FIELDS)) if emotions else out


def turns(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'turns'").select("path", "n")


def coverage(rows: DataFrame) -> DataFrame:
    """(seen, sampled, documents, skipped, errors, utterances)."""
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).alias
    return rows.agg(n("seen")("seen"), n("sampled")("sampled"), n("document")("documents"), n("skipped")("skipped"), n("error")("errors"), n("text")("utterances"))
