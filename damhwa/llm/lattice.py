"""Language-model scores from a subword lattice.

A document is a lattice: each of its words can be read as a whole, if training texts have it, or as any sequence of
pieces of an existing subword vocabulary that spells it. An arc's weight is its probability: a word's share of the
training tokens, or the product of its pieces' unigram probabilities (the vocabulary's own scores give a prior, its
own segmentation of the training words the counts). Whole words and pieces are weighed by the share of training tokens
that occur once, which estimates how often a new word comes. The forward recursion in log space sums all paths; what it
returns at a document's end is the text's log10 probability. Pieces that begin a word are marked, so the piece paths of
all words together have a mass of 1.

Word counts are a table that grows with the corpus; it is never sent to all tasks. Documents are cut into blocks of
neighbouring rows; the distinct words of each block are joined with the counts, and the answers meet the block.

Edge cases: null text counts as empty: one token, the end; characters outside the vocabulary fall back to its bytes;
with no training document the counts are 0, the base sums log10(0.1 / 0.1) and the pieces carry all weight; a null
document id counts as held out unless crc32 of empty text says otherwise (it does: remainder 0, held out); repeated
rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log, log1p, log10

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from damhwa.llm.common import arrow_schema, map_batches, materialize, to_batch

BLOCK_ROWS = 2048
FLUSH = 400_000
LN10 = log(10)


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes do just that)."""
    return (text or "").encode().lower().split()


def held_out(doc) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 10 == 0


class Pieces:
    """The vocabulary's pieces with natural log probabilities, and the forward recursion over a word."""

    def __init__(self, path: str, counts: dict[int, int]):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        use = [i for i in range(size) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        prior = {i: 1 / (10 + max(0.0, -self.model.get_score(i))) for i in use}
        whole, seen = sum(prior.values()), sum(counts.get(i, 0) for i in use)
        weight = 1 + 0.02 * seen
        self.logp, self.byte, self.longest = {}, {}, 1
        for i in use:
            p = log((counts.get(i, 0) + weight * prior[i] / whole) / (seen + weight))
            text = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.byte[int(text[1:-1], 16)] = p
            else:
                self.logp[text] = p
                self.longest = max(self.longest, len(text))

    def forward(self, word: bytes) -> float:
        """Natural log of the summed probability of all piece sequences that spell the word."""
        s = "▁" + word.decode()
        n, get, longest = len(s), self.logp.get, self.longest
        alpha = [None] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            a = alpha[i]
            if a is None:
                continue
            alone = False
            for j in range(i + 1, min(n, i + longest) + 1):
                p = get(s[i:j])
                if p is not None:
                    alone |= j == i + 1
                    p += a
                    b = alpha[j]
                    alpha[j] = p if b is None else (b + log1p(exp(p - b)) if b > p else p + log1p(exp(b - p)))
            if not alone:  # bytes spell a character that is no piece
                p = a + sum(self.byte.get(x, -20.0) for x in s[i].encode())
                b = alpha[i + 1]
                alpha[i + 1] = p if b is None else max(p, b) + log1p(exp(-abs(p - b)))
        return alpha[n]


@lru_cache(1)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Model:
    """Totals, the mixing weight and the pieces; small whatever the corpus."""

    def __init__(self, path: str, total: int, distinct: int, once: int, ends: int, pieces: dict[int, int]):
        self.path, self.total, self.distinct, self.ends, self.counts = path, total, distinct, ends, pieces
        self.new = min(0.5, max(once / total, 1e-4)) if total else 1.0
        self._pieces = None

    @property
    def pieces(self) -> Pieces:
        if self._pieces is None:
            self._pieces = Pieces(self.path, self.counts)
        return self._pieces

    def __getstate__(self):
        return self.__dict__ | {"_pieces": None}

    def base(self, c: int) -> float:
        return log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def word(self, word: bytes, c: int) -> float:
        """log10 of the word's arcs, summed: whole and by pieces."""
        by_pieces = log(self.new) + self.pieces.forward(word)
        if not c:
            return by_pieces / LN10
        whole = log((1 - self.new) * c / self.total)
        high, low = max(whole, by_pieces), min(whole, by_pieces)
        return (high + log1p(exp(low - high))) / LN10

    def end(self) -> float:
        if not self.ends:
            return log10(0.5)
        return log10((1 - self.new) * self.ends / self.total)


def count_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, c) over the training documents; tasks add up before the shuffle."""
    ddl = "word binary, n long"
    schema = arrow_schema(df.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
                if len(held) > FLUSH:
                    yield to_batch({"word": list(held), "n": list(held.values())}, schema)
                    held = Counter()
        if held:
            yield to_batch({"word": list(held), "n": list(held.values())}, schema)

    return train_rows(df, id_col).select(text_col).mapInArrow(run, ddl).groupBy("word").agg(F.sum("n").alias("c"))


def train_rows(df: DataFrame, id_col: str) -> DataFrame:
    return df.where(F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 10 != 0)


def piece_counts(words: DataFrame, path: str) -> dict[int, int]:
    """How often the vocabulary's own segmentation of each distinct training word uses each piece (at most one row a piece)."""
    ddl = "piece int, n long"
    schema = arrow_schema(words.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for ids in _processor(path).encode([w.decode() for w in batch.column(0).to_pylist()], num_threads=1):
                held.update(ids)
        if held:
            yield to_batch({"piece": list(held), "n": list(held.values())}, schema)

    return {r[0]: r[1] for r in words.select("word").mapInArrow(run, ddl).groupBy("piece").agg(F.sum("n").alias("n")).collect()}


def train(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """(the table of words and counts, the model)."""
    words = materialize(count_words(df, id_col, text_col), "word-counts")
    ends = train_rows(df, id_col).count()
    total, distinct, once = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum((F.col("c") == 1).cast("long")), F.lit(0))).first()
    return words, Model(path, total + ends, distinct + (ends > 0), once, ends, piece_counts(words, path))


def file_block(rows: int = BLOCK_ROWS) -> Column:
    """Blocks of neighbouring rows of the files that a DataFrame was read from."""
    return F.xxhash64(F.col("_metadata.file_path"), F.expr(f"_metadata.row_index div {rows}"))


def score(df: DataFrame, words: DataFrame, model: Model, block: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each whole text.

    block: keeps rows that are read together apart from others; without it, blocks follow from the ids' hashes.
    """
    spark = df.sparkSession
    if block is None:
        block = F.pmod(F.xxhash64(id_col, text_col), F.lit(max(1, df.count() // BLOCK_ROWS)).cast("long"))
    docs = df.select(block.alias("block"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ask_schema = arrow_schema(spark, "block long, word binary")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, set()

        def out() -> pa.RecordBatch:
            return to_batch({"block": [now] * len(held), "word": list(held)}, ask_schema)

        for batch in batches:
            for b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != now or len(held) > FLUSH:
                    if held:
                        yield out()
                    now, held = b, set()
                held.update(tokens(text))
        if held:
            yield out()

    asked = docs.select("block", "text").mapInArrow(ask, "block long, word binary")

    def weigh():
        def step(batch: pa.RecordBatch) -> dict:
            return {"word": batch.column(0), "c": batch.column(1), "logp": [model.word(w, c) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]}

        return step

    weighed = map_batches(words.select("word", "c"), "word binary, c long, logp double", weigh)
    answers = asked.join(weighed, "word").select("block", "word", "c", "logp")
    ddl = f"`{id_col}` {df.select(id_col).schema[0].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = arrow_schema(spark, ddl)

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        given = {w: (model.base(c), p, True) for w, c, p in zip(right["word"].to_pylist(), right["c"].to_pylist(), right["logp"].to_pylist())}
        end, end_base, new_base = model.end(), model.base(model.ends), model.base(0)
        rows: dict[str, list] = {f.name: [] for f in schema}

        class Words(dict):
            def __missing__(self, word):
                value = self[word] = new_base, model.word(word, 0), False
                return value

        known = Words(given)
        for doc, text in zip(left["id"].to_pylist(), left["text"].to_pylist()):
            found = list(map(known.__getitem__, tokens(text)))
            row = (doc, held_out(doc), len(found) + 1, sum([f[2] for f in found]) + (model.ends > 0), model.total, sum([f[0] for f in found]) + end_base, sum([f[1] for f in found]) + end)
            for k, v in zip(rows, row):
                rows[k].append(v)
        return pa.table({f.name: pa.array(rows[f.name], f.type) for f in schema}, schema=schema)

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, ddl)
