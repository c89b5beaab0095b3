"""Column functions on dialogue text: trimming, breaks, speakers, normal form, sizes, buckets, speech levels."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from damhwa.functions import rules

METRIC_BREAK = "\r\n|[\r\n\u2028\u2029]"
HINT_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_SPACE = r"[\s\x1c-\x1f]"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(rules.java(pattern))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(rules.java(pattern)))


def trim(text: Column) -> Column:
    """Without white space at both ends, Unicode's and the separators U+001C to U+001F."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def strip_speaker(line: Column) -> Column:
    return trim(F.regexp_replace(line, rules.java(rules.SPEAKER), ""))


def break_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(METRIC_BREAK))


def split_lines(text: Column, pattern: str = METRIC_BREAK) -> Column:
    """The trimmed lines of a text that are not blank."""
    return F.filter(F.transform(F.split(text, pattern), trim), lambda x: x != "")


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


#: What text must hold for its normal form to differ: combining marks, conjoining jamo, singletons and composites.
_CHANGES = "[\u0300-\u036f\u0374\u037e\u0387\u0483-\u0487\u0591-\u0eff\u0f00-\u0fff\u1000-\u11ff\u1700-\u1fff\u2000\u2001\u20d0-\u20ff\u2126-\u212b\u2329\u232a\u2adc\u2cef-\u2cf1\u302a-\u302f\u3099\u309a\ua66f-\uabff\uf900-\ufaff\ufb1d-\ufb4f\ufe20-\ufe2f]|[^\\x{0}-\\x{ffff}]"


def nfc(text: Column) -> Column:
    """Normal form C. Only text that could change is sent to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(_CHANGES), text)), text)


def chars_without_space(line: Column) -> Column:
    return F.length(F.regexp_replace(line, rf"(?U){_SPACE}", ""))


def neis_bytes(text: Column) -> Column:
    """UTF-8 length with each line break counted as two bytes."""
    pairs = F.regexp_count(text, F.lit("\r\n"))
    return F.octet_length(text) - F.regexp_count(text, F.lit("[\u2028\u2029]")) + F.regexp_count(text, F.lit("[\r\n]")) - 2 * pairs


def bucket(value: Column, bounds: Iterable[int]) -> Column:
    """`0-b1`, `b1+1-b2`, ... and `bn+1+`."""
    out, low = None, 0
    for bound in bounds:
        name = F.lit(f"{low}-{bound}")
        out = F.when(value <= bound, name) if out is None else out.when(value <= bound, name)
        low = bound + 1
    return out.otherwise(F.lit(f"{low}+"))


def speech_level(line: Column) -> Column:
    clean = strip_speaker(line)
    banmal = matches(clean, rules.BANMAL) | matches(clean, rules.CALIBRATION_LINE["informal_address"])
    return F.when(matches(clean, rules.HAPSYO), "hapsyo").when(matches(clean, rules.HAEYO), "haeyo").when(banmal, "banmal").otherwise("unknown")


def detect(text: Column, patterns: dict[str, str]) -> Column:
    """The names of the patterns that occur, sorted."""
    return F.array_compact(F.array(*[F.when(matches(text, patterns[n]), F.lit(n)) for n in sorted(patterns)]))


def ending_key(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, rules.java(rules.ENDING_KEY), 1), F.lit(""))


def looks_like_label(value: Column) -> Column:
    return (value != "") & (F.length(value) <= 40) & ~value.rlike("[\n\r.?!。…]")


def infer_split(path: Column) -> Column:
    low = F.lower(path)
    has = lambda *words: F.array_contains(F.array(*[low.contains(w) for w in words]), True)
    return F.when(has("valid", "/vl_"), "validation").when(has("train", "/tl_"), "training").when(has("test"), "test").when(has("dev"), "dev").otherwise("unknown")


def infer_data_role(path: Column) -> Column:
    low = F.lower(path)
    has = lambda *words: F.array_contains(F.array(*[low.contains(w) for w in words]), True)
    return F.when(has("라벨링", "[라벨]", "label", "/vl_", "/tl_"), "label").when(has("원천", "원시", "source", "/vs_", "/ts_"), "source").otherwise("unknown")


def top_dataset(path: Column) -> Column:
    """The first folder of a relative path, or the file's stem at the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.regexp_replace(path, r"(?<=.)\.[^.]*$", ""))
