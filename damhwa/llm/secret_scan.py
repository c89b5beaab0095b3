"""Secrets in texts: patterns, and strings in a sensitive context that a primed compressor finds new.

Patterns give the base spans: assigned values, access key ids, long hexadecimal runs. The method adds others: after a
sensitive word and a sign of assignment or quoting, each run of key characters is a candidate; its cost is the bytes
that zstandard needs for it with a dictionary primed by common identifiers and by the text around it, less those of
an empty input. Ordinary names and words cost little; a candidate that
costs nearly as much as a random string of its length and alphabet, as a whole or in a window, is reported as `novel`.
A candidate's exact copies are no such surroundings: where it stands again, it is scored without them, and every
occurrence is reported, also outside a sensitive context. Strings without a digit or of one class of characters are
measured too, against a higher share; an ordinary long word that neither the identifiers nor the surroundings hold
costs as much as a random one and is reported.

Edge cases: null text counts as empty and gives no span (digest of the empty string); texts are read whole; spans are
in code points, end exclusive; every row gives one row, repeated rows included; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache, lru_cache
from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from damhwa.llm.common import bound_batches, claim, map_batches

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE_WORDS = ("pass", "secret", "token", "key", "credential", "bearer", "authoriz", "private", "signature", "connection")
SENSITIVE = re.compile(r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|signing|encryption|client|auth)[\x20_-]?key|credentials?|bearer|authorization|signature|connection[_-]?string)[\w-]{0,24}["'\x20]{0,3}(?:[:=]|\bis\b|\b(?=\x20))["'\x20]{0,3}(?:bearer\x20|basic\x20)?["']?([A-Za-z0-9+/_.=~-]{16,})""", re.I | re.A)

#: What source code and configuration hold anyway; primes the compressor.
IDENTIFIERS = (
    "password username user_name secret_key access_key api_key client_id client_secret token refresh_token session_id authorization bearer basic "
    "credentials connection_string private_key public_key certificate signature placeholder changeme example your-key-here xxxxxxxxxxxxxxxx 0000000000000000 "
    "1234567890123456 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef import function return class self config settings environment "
    "getenv process.env os.environ localhost 127.0.0.1 http://www.example.com/ https://api.example.org/v1/ application/json content-type user-agent "
    "initialize parameters arguments implementation configuration authentication exception default undefined production development testing "
).encode()
AROUND = 2048
#: Characters of a candidate at least, as SENSITIVE has it, and those that can stand at its ends without being of the key.
LEAST, SIGNS = 16, "+/_.=~-"
#: Of a random string's bytes; strings that could be names, without a digit or of one class, must cost still nearer to it.
NOVEL_SHARE, PLAIN_SHARE = 0.85, 0.95
#: What keys are written in, smallest first: an alphabet's letters and digits are the first of these that hold a string's.
ALPHABETS = tuple((frozenset(a), a) for a in (
    digits, digits + "abcdef", digits + "ABCDEF", digits + "abcdefABCDEF", ascii_lowercase, ascii_uppercase, ascii_lowercase + "234567", ascii_uppercase + "234567",
    ascii_lowercase + digits, ascii_uppercase + digits, ascii_letters, ascii_letters + digits,
))
#: Above this length, a random string's cost grows evenly.
LONGEST_DRAWN = 1024
#: A long candidate can hold a key between names, as signed tokens do: stretches of this many characters with a digit and two classes
#: count too. Others only as part of the whole: windows of any long name would.
WINDOW = 32


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


@cache
def _empty_cost() -> int:
    return len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_dict_id=False).compress(b""))


def _cost(word: str, around: str) -> int:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_dict_id=False).compress(word.encode())
    return max(0, len(made) - _empty_cost())


def _without(text: str, start: int, end: int, left_out: list[tuple[int, int]]) -> str:
    out = []
    for a, b in left_out:
        if b > start and a < end:
            out.append(text[start : max(start, a)])
            start = max(start, b)
    return "".join(out) + text[start:end]


def marginal_bytes(text: str, start: int, end: int, left_out: list[tuple[int, int]] = ()) -> int:
    """Bytes that the candidate adds, given the identifiers and the text around it, stretches `left_out` (in order) aside."""
    return _cost(text[start:end], _without(text, max(0, start - AROUND), start, left_out) + "\n" + _without(text, end, min(len(text), end + AROUND), left_out))


@lru_cache(4096)
def _drawn_cost(alphabet: str, length: int) -> float:
    rng = random.Random(length)
    return sum(_cost("".join(rng.choices(alphabet, k=length)), "") for _ in range(3)) / 3


def random_cost(word: str) -> float:
    """Bytes that the compressor needs for a random string of the word's length and alphabet."""
    have = set(word)
    signs = {c for c in have if not c.isalnum()}
    alphabet = next(a for held, a in ALPHABETS if have - signs <= held) + "".join(sorted(signs))
    return _drawn_cost(alphabet, min(len(word), LONGEST_DRAWN)) * max(1.0, len(word) / LONGEST_DRAWN)


def _mixed(word: str) -> bool:
    """A digit and two classes, as names seldom have."""
    kinds = sum(map(bool, (re.search("[a-z]", word), re.search("[A-Z]", word), re.search("[0-9]", word))))
    return kinds >= 2 and re.search("[0-9]", word) is not None


def is_novel(text: str, start: int, end: int, left_out: list[tuple[int, int]] = ()) -> bool:
    """Whether the candidate, or a window of a long one, costs nearly as much as a random string would."""
    word = text[start:end]
    share = NOVEL_SHARE if _mixed(word) else PLAIN_SHARE
    if marginal_bytes(text, start, end, left_out) >= share * random_cost(word):
        return True
    windows = range(start, end - WINDOW + 1, WINDOW // 2) if end - start >= 2 * WINDOW else ()
    return any(_mixed(w := text[k : k + WINDOW]) and marginal_bytes(text, k, k + WINDOW, left_out) >= NOVEL_SHARE * random_cost(w) for k in windows)


def _overlaps(start: int, end: int, spans: list[tuple[int, int, str]]) -> bool:
    return any(s < end and start < e for s, e, _ in spans)


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS) and "pwd" not in low:
        return []
    return [m.span(1) for m in SENSITIVE.finditer(text) if not _overlaps(*m.span(1), base)]


def novel_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The candidates that are new to all that stands around them. Those that stand there again are copied_spans'."""
    return [(start, end, "novel") for start, end in candidates(text, base) if is_novel(text, start, end)]


def copied_spans(text: str, base: list[tuple[int, int, str]], novel: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """All occurrences, in a sensitive context or not, of candidates that stand more than once and are new but for their
    own copies; each such string is scored once. What `base` and `novel` have is left to them."""
    out, seen = [], set()
    for start, end in candidates(text, base):
        word = text[start:end]
        core = word.strip(SIGNS)  # a copy may end a sentence
        core = core if len(core) >= LEAST else word
        if core in seen:
            continue
        seen.add(core)
        if text.count(core) < 2:
            continue
        copies = [m.span() for m in re.finditer(re.escape(core) + "=*", text)]
        start += word.index(core)
        if is_novel(text, start, start + len(core), copies):
            out += [(a, b, "novel") for a, b in copies if not _overlaps(a, b, base) and not _overlaps(a, b, novel) and not _overlaps(a, b, out)]
    return out


def spans_of(text: str) -> tuple[list, list]:
    """(base, all) spans, in order of start and then kind."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(base_spans(text), key=order)
    novel = novel_spans(text, base)
    return base, sorted(base + novel + copied_spans(text, base, novel), key=order)


def joined(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list, mark: str = "[secret]") -> str:
    """The text with each stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) of each whole text. A narrow map."""

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            found = [spans_of(t or "") for t in batch.column(1).to_pylist()]
            count = lambda kind: [sum(s[2] == kind for s in every) for _, every in found]
            return {id_col: batch.column(0)} | {f"n_{k}": count(k) for k in KINDS} | {"base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], "spans": [joined(a) for _, a in found]}

        return step

    src = df.select(id_col, text_col)
    return map_batches(src, f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string", start)


def redact_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with secrets in `text_col` replaced by a mark; all rows and all other columns stay, null stays null."""
    bound_batches(df.sparkSession)
    src = df.select(text_col, *[c for c in df.columns if c != text_col])

    def run(batches):
        claim(__name__)
        for batch in batches:
            texts = [t if t is None else redact(t, spans_of(t)[1]) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema[0].type), *batch.columns[1:]], schema=batch.schema)

    return src.mapInArrow(run, src.schema).select(*df.columns)
