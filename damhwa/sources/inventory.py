"""Inventory of a corpus folder: what files there are and what they look like, without their text."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from damhwa.functions import text as T
from damhwa.sources import corpus

# Fixed values.
SUFFIXES = (".zip", ".xlsx", ".json")
SKIP_FOLDERS = (".git", ".venv", "venv", "__pycache__", "node_modules")
MAX_JSON = 10 * 1024 * 1024
DEPTH, KEYS, LARGEST = 4, 80, 10
XLSX_HEAD = 256 * 1024

_DIMENSION = re.compile(rb'<dimension[^>]*\bref="([^"]*)"')


def records(paths: DataFrame) -> DataFrame:
    """(path, dataset, extension, split, data_role) of paths(path), relative to the root."""
    p = F.col("path")
    return paths.select("path", T.top_dataset(p).alias("dataset"), F.lower(F.regexp_extract(p, r"(\.[^./]*)$", 1)).alias("extension"), T.infer_split(p).alias("split"), T.infer_data_role(p).alias("data_role"))


def kept(path: Column, out: str | None = None) -> Column:
    ok = ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIP_FOLDERS))) & F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*SUFFIXES)
    return ok & (path != out) if out else ok


def list_files(spark: SparkSession, root: str, out: str | None = None) -> DataFrame:
    """(path, length, full) by path, relative; only names and lengths are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("full"), "length")
    relative = F.regexp_replace(corpus.plain(F.col("full")), "^" + re.escape(corpus.qualified(spark, root)), "")
    return rows.withColumn("path", relative).where(kept(F.col("path"), out)).orderBy("path").select("path", "length", "full")


def json_shape(value, path: str = "$", depth: int = 0) -> Iterator[tuple[str, int, str, int | None, bool]]:
    """(path, depth, type, length, omitted) of each node down to four levels and 80 keys a dict; a list shows its first item."""
    kind = {type(None): "null", bool: "bool", int: "int", float: "float", str: "str", list: "list", dict: "dict"}.get(type(value), type(value).__name__)
    inner = isinstance(value, (list, dict))
    yield path, depth, kind, len(value) if inner else None, not inner or depth >= DEPTH
    if depth < DEPTH:
        if isinstance(value, dict):
            for k in list(value)[:KEYS]:
                yield from json_shape(value[k], f"{path}.{k}", depth + 1)
        elif isinstance(value, list) and value:
            yield from json_shape(value[0], f"{path}[]", depth + 1)


def shapes(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, depth, type, length, omitted) of a column of JSON; malformed documents have one row of type `error`."""
    src = df.select(id_col, json_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = []
            for key, text in zip(batch[id_col], batch[json_col]):
                try:
                    held += [(key, *row) for row in json_shape(json.loads(text))]
                except (TypeError, ValueError, RecursionError):
                    held.append((key, "$", 0, "error", None, True))
            yield pd.DataFrame(held, columns=[id_col, "path", "depth", "type", "length", "omitted"]).astype({"length": "Int64"})

    return src.mapInPandas(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, path string, depth int, type string, length long, omitted boolean")


def zip_profile(content: bytes, samples: int = 3) -> dict:
    """Entries, files, bytes, suffixes, the ten largest entries, and the shapes of the first JSON entries that are not too large."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        infos = archive.infolist()
        files = [i for i in infos if not i.is_dir()]
        suffixes = Counter("." + i.filename.rsplit(".", 1)[-1].lower() if "." in i.filename.rsplit("/", 1)[-1] else "" for i in files)
        largest = sorted(enumerate(files), key=lambda x: (-x[1].file_size, x[0]))[:LARGEST]
        shown = []
        for info in files:
            if len(shown) == samples:
                break
            if info.filename.lower().endswith(".json") and info.file_size <= MAX_JSON:
                try:
                    shown.append({"entry": info.filename, "shape": [list(r) for r in json_shape(json.loads(archive.read(info).decode("utf-8-sig")))]})
                except (ValueError, RecursionError):
                    shown.append({"entry": info.filename, "error": "unreadable"})
        return {"entries": len(infos), "files": len(files), "bytes": sum(i.file_size for i in files), "suffixes": dict(sorted(suffixes.items())), "largest": [[i.filename, i.file_size] for _, i in largest], "samples": shown}


def xlsx_profile(content: bytes) -> dict:
    """Worksheets with the range that the head of each states."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        sheets = {}
        for info in archive.infolist():
            if re.fullmatch(r"xl/worksheets/[^/]+\.xml", info.filename):
                with archive.open(info) as f:
                    found = _DIMENSION.search(f.read(XLSX_HEAD))
                sheets[info.filename.rsplit("/", 1)[-1]] = found[1].decode() if found else None
        suffixes = {i.filename.rsplit(".", 1)[-1].lower() for i in archive.infolist() if not i.is_dir()}
        return {"sheets": sheets, "zip_entry_count": len(suffixes), "entries": len(archive.infolist())}


def profile(path: str, content: bytes) -> dict:
    low = path.lower()
    try:
        if low.endswith(".zip"):
            return {"archive": zip_profile(content)}
        if low.endswith(".xlsx"):
            return {"xlsx": xlsx_profile(content)}
        if len(content) > MAX_JSON:
            return {"json_shape": {"omitted": "too large"}}
        return {"json_shape": [list(r) for r in json_shape(json.loads(content.decode("utf-8-sig")))]}
    except (zipfile.BadZipFile, ValueError, RecursionError, OSError) as error:
        return {"error": type(error).__name__}


def inventory(spark: SparkSession, root: str, out: str | None = None) -> DataFrame:
    """records with length and `profile`, a JSON string."""
    files = list_files(spark, root, out)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("full"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "profile": [json.dumps(profile(p, c), ensure_ascii=False) for p, c in zip(batch["path"], batch["content"])]})

    profiles = files.join(content, "full").select("path", "content").mapInPandas(run, "path string, profile string")
    return records(files).join(files.select("path", "length"), "path").join(profiles, "path").orderBy("path")


def summary(records: DataFrame) -> DataFrame:
    """(kind, name, files): counts by dataset and by extension."""
    both = records.select(F.explode(F.array(F.struct(F.lit("dataset").alias("kind"), F.col("dataset").alias("name")), F.struct(F.lit("extension").alias("kind"), F.col("extension").alias("name")))).alias("x")).select("x.*")
    return both.groupBy("kind", "name").agg(F.count("*").alias("files"))

