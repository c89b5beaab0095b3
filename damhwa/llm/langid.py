"""Language identification by rank-order profiles.

A language's profile is its most frequent 1- to 3-grams of code points, ranked; a document's own ranking is compared with
each by out-of-place distance: the sum over its grams of how far each is from its place in the profile, or of the
profile's length where it is absent. The nearest language wins, ties going to the smaller code; the score is 1 less the
distance as a share of the greatest possible.

Texts are lower-cased; each run of what is not a letter becomes one space, also at both ends. Ranks are by count, then by
code points. Profiles come from all learnt documents: tasks count grams per language, one small shuffle adds them up.

Edge cases: null text, or text without a letter, is `und` with score 0, as is every text when nothing was learnt; rows
without a language teach nothing; a null document id is never held out; every row gives one row, repeated rows
included; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from damhwa.llm.common import arrow_schema, bound_batches, claim, map_batches, to_batch

PROFILE = 400
#: Grams of texts that a task holds at once to count them.
HELD_GRAMS = 250_000
#: Real prose of a learnt language can lie well below the learnt rows; one of these in a hundred may be wrong itself.
BOUND_SHARE, BOUND_QUANTILE, BOUND_ROWS = 0.5, 0.01, 50
_OTHER = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes ascending, counts) of the grams; a code is three code points of 21 bits, shorter grams end in zeros."""
    clean = _OTHER.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, clean)):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = np.frombuffer(f" {clean} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    one, two = c << np.uint64(42), c[1:] << np.uint64(21)
    codes = np.concatenate([one, one[:-1] | two, one[:-2] | two[:-1] | c[2:]])
    codes.sort()
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts], np.diff(np.append(starts, len(codes)))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    return codes[np.argsort(-counts, kind="stable")[:size]]


def counted(rows: Iterable[tuple[str, str]], most: int = HELD_GRAMS) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, codes, counts) of the grams of all (language, text); a gram may come several times, each time with a part
    of its count. No more than `most` grams and those of one text are held: where counting leaves over half, they are sent."""
    held: dict[str, list] = {}
    waiting = 0

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return codes, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

    for lang, text in rows:
        codes, counts = grams(text)
        if len(codes):
            held.setdefault(lang, []).append((codes, counts))
            waiting += len(codes)
        if waiting > most:
            held = {k: [merged(v)] for k, v in held.items()}
            waiting = sum(len(v[0][0]) for v in held.values())
            if waiting > most // 2:
                yield from ((k, *v[0]) for k, v in held.items())
                held, waiting = {}, 0
    yield from ((k, *merged(v)) for k, v in held.items())


def learn(df: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, list[int]]:
    """Language -> its ranked codes. What reaches the driver is `size` codes a language."""
    ddl = "lang string, gram long, n long"
    schema = arrow_schema(df.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for lang, codes, counts in counted(rows):
            yield to_batch({"lang": [lang] * len(codes), "gram": codes.astype(np.int64), "n": counts}, schema)

    counts = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col).mapInArrow(run, ddl).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    for row in counts.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").select("lang", "gram").collect():
        out.setdefault(row[0], []).append(row[1])
    return out


class Classifier:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size, self.tables = size, []
        for lang in sorted(profiles):
            codes = np.array(profiles[lang], np.uint64)
            order = np.argsort(codes)
            self.tables.append((lang, codes[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.measure(text)[:2]

    def measure(self, text: str | None) -> tuple[str, float, int]:
        """(language, score, length class of the text: the bits of its number of ranked grams)."""
        codes = ranked(*grams(text), self.size)
        if not len(codes) or not self.tables:
            return "und", 0.0, 0
        best, least, places = "und", None, np.arange(len(codes))
        for lang, known, ranks in self.tables:
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            distance = int(np.where(known[at] == codes, np.abs(ranks[at] - places), self.size).sum())
            if least is None or distance < least:
                best, least = lang, distance
        return best, 1 - least / (len(codes) * self.size), len(codes).bit_length()


def held_out(doc) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 4 == 2


def train_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return df.where(F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 4 != 2)


def identify(df: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each whole text."""

    def start():
        classifier = Classifier(profiles, size)

        def step(batch: pa.RecordBatch) -> dict:
            found = [classifier.predict(t) for t in batch.column(1).to_pylist()]
            return {id_col: batch.column(0), "held_out": [held_out(d) for d in batch.column(0).to_pylist()], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return step

    src = df.select(id_col, text_col)
    return map_batches(src, f"`{id_col}` {src.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double", start)


def bounds(df: DataFrame, profiles: dict[str, list[int]], lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> list[float]:
    """Least score of a text in a learnt language, by length class: BOUND_SHARE of what all but BOUND_QUANTILE of the learnt
    rows of that class reach. Classes with few rows are taken with the next longer ones, the last with the shorter; with
    fewer than BOUND_ROWS rows in all, nothing is said. What reaches the driver is counts by class and thousandth."""
    ddl = "class int, score int, n long"
    schema = arrow_schema(df.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        classifier, held = Classifier(profiles, size), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                lang, score, length = classifier.measure(text)
                if lang != "und":
                    held[length, int(score * 1000)] += 1
        yield to_batch({"class": [k[0] for k in held], "score": [k[1] for k in held], "n": list(held.values())}, schema)

    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col).mapInArrow(run, ddl).groupBy("class", "score").agg(F.sum("n").alias("n")).collect()
    by = [Counter() for _ in range(size.bit_length() + 1)]
    for r in rows:
        by[r[0]][r[1]] += r[2]
    out, pooled, waiting = [0.0] * len(by), Counter(), []
    for k, counts in enumerate(by):
        pooled += counts
        waiting.append(k)
        if pooled.total() >= BOUND_ROWS:
            for j in waiting:
                out[j] = BOUND_SHARE * _quantile(pooled)
            last, pooled, waiting = pooled, Counter(), []
    if waiting and waiting[0]:
        for j in waiting:
            out[j] = BOUND_SHARE * _quantile(last + pooled)
    return out


def _quantile(counts: Counter) -> float:
    rest = BOUND_QUANTILE * counts.total()
    for score in sorted(counts):
        rest -= counts[score]
        if rest < 0:
            return score / 1000
    return 0.0


def accept(df: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", least: float = 0.05, size: int = PROFILE, bound: list[float] | None = None) -> DataFrame:
    """The rows whose text is in a learnt language: not `und`, and with a score of at least `least` and, where `bounds` are
    given as `bound`, that of the text's length class. Columns stay."""
    bound_batches(df.sparkSession)
    src = df.select(text_col, *[c for c in df.columns if c != text_col])
    floor = [max(least, b) for b in bound or [0.0] * (size.bit_length() + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        classifier = Classifier(profiles, size)
        for batch in batches:
            found = [classifier.measure(t) for t in batch.column(0).to_pylist()]
            yield batch.filter(pa.array([lang != "und" and score >= floor[length] for lang, score, length in found]))

    return src.mapInArrow(run, src.schema).select(*df.columns)
