"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Method. A BPE segmentation is the only one whose neighbouring tokens are all *compatible*: merging the bytes of the
two from scratch gives the two back. So the encoding of each prefix of a string ends with one definite token, and
encoding is a finite-state problem: read bytes, keep a hypothesis for every place where a token now in progress may
have begun. `Transducer` determinises that machine by subsets, lazily, state by state. A state
holds its hypotheses with the tokens each has not yet emitted; what all share is emitted at once, so output lags input
by no more than the longest token. A transition is tabulated when it was asked for several times; input that leaves
the table walks the hypotheses themselves, depth first. The table is bounded: when full it is dropped and built anew.
A new piece is first joined from two parts that the machine has read before: where the tokens that meet are compatible, so
are all neighbours. Parts are kept in a bounded table too.

Decoding runs tokens through a UTF-8 automaton whose state is the unfinished sequence, again tabulated per (state,
token) when first met, so a stream can be cut anywhere between tokens.

Edge cases: null text encodes as empty text (no token, digest of the empty string); empty text likewise; every row
gives one row, repeated rows included; texts of any length are read whole; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from functools import lru_cache
from itertools import chain
from string import ascii_letters

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from damhwa.llm.common import claim, map_batches

MAX_STATES = 60_000
MAX_PIECES = 300_000
_NEVER = 1 << 60
RUN = 256  # tokens that are decoded at once where none ends within a character
WINDOW = 4  # bytes by which the walk looks up what tokens begin at a place
#: By size of a piece: where it is cut into parts of 2 bytes or more, those nearest the middle first; short and long ones are not.
CUTS = [sorted(range(2, n - 1), key=lambda k: abs(2 * k - n))[:5] if n > 4 else [] for n in range(33)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Memo(dict):
    """key -> make(key) in two generations: when the young one is full it becomes the old one, whose keys that are
    asked for again come back."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class _State:
    """Hypotheses are (tokens not yet emitted, trie node of the token in progress); node 0 is a token boundary."""

    __slots__ = ("asked", "context", "final", "hypotheses", "next")

    def __init__(self, context: int, hypotheses: tuple):
        self.context, self.hypotheses, self.next, self.asked = context, hypotheses, {}, {}
        self.final = hypotheses[-1][0]  # the boundary comes last


class Transducer:
    """bytes of one pre-token -> token ids, for `ranks` (token bytes -> id, a lower id merging first)."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, warm: int = 6):
        self.ranks, self.max_states, self.warm = ranks, max_states, warm
        self.token = {i: b for b, i in ranks.items()}
        self.child: dict[int, int] = {}  # (node << 8 | byte) -> node
        self.ends, inner = [-1], [True]  # by node: the token spelt so far; whether a longer one exists
        for text, i in ranks.items():
            node = 0
            for byte in text:
                inner[node] = True
                nxt = self.child.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.child[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    inner.append(False)
                node = nxt
            self.ends[node] = i
        self.inner = inner
        self.spines: dict[int, tuple | None] = {}
        self.compatible: dict[int, bool] = {}
        self.begins = _Memo(self._begin, 5 * max_states)
        self.parts = _Memo(self.join, 2 * max_states)
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self._state(-1, (((), 0),))

    def _state(self, context: int, hypotheses: tuple) -> _State:
        key = (context, hypotheses)
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = _State(context, hypotheses)
        return state

    def _edges(self, token: int) -> tuple | None:
        """What stands at a token's left and right end while its own bytes merge: (left ends, right ends), as byte
        strings with the rank that replaces each. None if its bytes merge to something else."""
        text = self.token[token]
        parts = [text[k : k + 1] for k in range(len(text))]
        left, right = [[parts[0], _NEVER]], [[parts[-1], _NEVER]]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, _NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == _NEVER:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            for end, here in ((left, parts[0]), (right, parts[-1])):
                if here != end[-1][0]:
                    end[-1][1] = rank
                    end.append([here, _NEVER])
        return left, right

    def edges(self, token: int) -> tuple | None:
        if token not in self.spines:
            self.spines[token] = self._edges(token)
        return self.spines[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether no merge would cross the border of the two tokens (left -1: there is no token before).

        Both ends grow by their own merges in the order of rank. A merge across happens if its rank comes before the
        next one of the left end and not after the next one of the right end, as equal ranks merge from the left.
        """
        after = self.edges(right)
        if after is None:
            return False
        known = self.compatible.get(left << 20 | right)
        if known is None:
            if len(self.compatible) > 8 * self.max_states:
                self.compatible.clear()
            known, i, j, a, b, ranks = True, 0, 0, self.edges(left)[1] if left >= 0 else (), after[0], self.ranks
            while a:
                (x, next_left), (y, next_right) = a[i], b[j]
                across = ranks.get(x + y, _NEVER)
                if across < next_left and across <= next_right and across != _NEVER:
                    known = False
                    break
                if next_left == next_right == _NEVER:
                    break
                if next_left <= next_right:
                    i += 1
                else:
                    j += 1
            self.compatible[left << 20 | right] = known
        return known

    def expand(self, state: _State, byte: int) -> tuple[_State, tuple]:
        """The transition of `state` on `byte`: (state after, tokens emitted)."""
        kept, boundary, child, ends, inner, context = [], None, self.child, self.ends, self.inner, state.context
        for pending, node in state.hypotheses:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if boundary is None and (t := ends[node]) >= 0 and self.follows(pending[-1] if pending else context, t):
                boundary = (*pending, t)
            if inner[node]:
                kept.append((pending, node))
        kept.append((boundary, 0))
        shared = 0
        if kept[0][0] and boundary:  # the oldest hypothesis has the shortest output; a common start can be emitted
            first = kept[0][0]
            while shared < len(first) and all(len(p) > shared and p[shared] == first[shared] for p, _ in kept):
                shared += 1
        if shared:
            emitted = boundary[:shared]
            after = self._state(emitted[-1], tuple((p[shared:], node) for p, node in kept))
        else:
            emitted, after = (), self._state(context, tuple(kept))
        step = state.next[byte] = after, emitted
        return step

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(piece)) is not None and self.edges(whole) is not None:
            return (whole,)  # a token that its own bytes merge to: its path through the machine is known
        if len(self.states) > self.max_states:
            self._reset()
        state, out, byte = self.start, [], 0
        try:
            for byte in piece:
                state, emitted = state.next[byte]
                if emitted:
                    out += emitted
        except KeyError:
            asked = state.asked[byte] = state.asked.get(byte, 0) + 1
            if asked <= self.warm:
                return self.walk(piece, out)
            self.expand(state, byte)
            return self.encode(piece)
        return (*out, *state.final)

    def join(self, piece: bytes) -> tuple[int, ...]:
        """`encode`, by way of two parts of `piece`, which recur where the whole is new: their encodings make its own if the
        two tokens that meet are compatible, as all neighbours are then. If they are not at any of its cuts, the machine
        reads the whole."""
        if len(piece) < len(CUTS) and piece not in self.ranks:
            parts = self.parts
            for cut in CUTS[len(piece)]:
                head, tail = parts[piece[:cut]], parts[piece[cut:]]
                good = self.compatible.get(head[-1] << 20 | tail[0])
                if good or good is None and self.follows(head[-1], tail[0]):
                    return head + tail
        return self.encode(piece)

    def _begin(self, window: bytes) -> tuple[tuple, int]:
        """((token, its length) of the tokens that `window` begins with, the longest first; the trie's node at its end,
        or 0 if no longer token begins so)."""
        found, node = [], 0
        for size, byte in enumerate(window, 1):
            node = self.child.get(node << 8 | byte)
            if node is None:
                break
            if (t := self.ends[node]) >= 0 and self.edges(t) is not None:
                found.append((t, size))
        return tuple(reversed(found)), node if node and self.inner[node] else 0

    def _longer(self, node: int, rest: bytes) -> list:
        """(token, its length) of the tokens that go on from a window's node over `rest`, the longest first."""
        found = []
        for size, byte in enumerate(rest, WINDOW + 1):
            node = self.child.get(node << 8 | byte)
            if node is None:
                break
            if (t := self.ends[node]) >= 0 and self.edges(t) is not None:
                found.append((t, size))
        return found[::-1]

    def walk(self, piece: bytes, out: list[int] | None = None) -> tuple[int, ...]:
        """The same hypotheses without a table, depth first, the longest token first, for input that leaves the
        determinised part; `out` has the tokens that all hypotheses share so far. Any chain of compatible tokens that
        reaches a border is the one encoding up to there, so a border that leads nowhere is given up for good. What
        tokens begin at a place is tabulated by its next bytes."""
        follows, known, begins, size = self.follows, self.compatible.get, self.begins, len(piece)
        out, at, before = out or [], 0, -1
        if out:
            at, before = len(b"".join(map(self.token.__getitem__, out))), out[-1]
        ways, dead, options = [], (), None  # of the tokens taken here: where each begins, what else does
        while at < size:
            if options is None:
                begin, node = begins[piece[at : at + WINDOW]]
                if node and at + WINDOW < size:
                    begin = (*self._longer(node, piece[at + WINDOW :]), *begin)
                options = iter(begin)
            for t, length in options:
                if dead and at + length in dead:
                    continue
                good = known(before << 20 | t)
                if good or good is None and follows(before, t):
                    out.append(t)
                    ways.append((at, options))
                    at += length
                    options, before = None, t
                    break
            else:
                dead = {at, *dead}
                out.pop()
                at, options = ways.pop()
                before = out[-1] if out else -1
        return tuple(out)


def _utf8_step(rest: bytes, token: bytes) -> tuple[bytes, str]:
    """The UTF-8 automaton over one token: (unfinished bytes after it, characters it completes)."""
    data, out, at = rest + token, [], 0
    while at < len(data):
        lead = data[at]
        need = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        if not need:
            out.append("�")
            at += 1
            continue
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
        good = 1
        while good < need and at + good < len(data) and low <= data[at + good] <= high:
            good, low, high = good + 1, 0x80, 0xBF
        if good < need and at + good == len(data):
            return data[at:], "".join(out)
        out.append(data[at : at + need].decode() if good == need else "�")
        at += good
    return b"", "".join(out)


class StreamDecoder:
    """Token ids in, text out, as soon as each character is whole; malformed bytes become U+FFFD as in Python."""

    def __init__(self, token: dict[int, bytes]):
        self.token, self.tables = token, {}
        self.whole = _Memo(self._whole, len(token) + 1)
        self.rest = b""

    def feed(self, ids: list[int]) -> str:
        out = []
        for k in range(0, len(ids), RUN):
            run = ids[k : k + RUN]
            if not self.rest:
                try:  # while every token leaves the automaton at its start, no state needs to be followed
                    out.append("".join(map(self.whole.__getitem__, run)))
                    continue
                except KeyError:
                    pass
            out.append(self._follow(run))
        return "".join(out)

    def _whole(self, t: int) -> str:
        rest, text = _utf8_step(b"", self.token[t])
        if rest:
            raise KeyError(t)
        return text

    def _follow(self, ids: list[int]) -> str:
        out, rest = [], self.rest
        table = self._table(rest)
        for t in ids:
            step = table.get(t)
            if step is None:
                after, text = _utf8_step(rest, self.token[t])
                step = table[t] = (after, text)
            if step[0] != rest:
                rest = step[0]
                table = self._table(rest)
            out.append(step[1])
        self.rest = rest
        return "".join(out)

    def _table(self, rest: bytes) -> dict:
        table = self.tables.get(rest)
        if table is None:
            table = self.tables[rest] = {}
        return table

    def close(self) -> str:
        rest, self.rest = self.rest, b""
        return "�" if rest else ""


#: White space after a space: there the text cannot be cut at its single spaces.
_LOOSE = re.compile(r" (?=\s|$)")


class Codec:
    """Whole texts: pre-tokens by `pattern`, each through the transducer; bounded tables remember frequent ones.

    `pattern` must, as byte-level BPE patterns do, start a pre-token at each space that comes before something else
    than white space. Texts are cut there first, as what is between such spaces recurs. `max_pieces` bounds all tables, to
    which a worker gives about 1 KB of memory for each; fewer cost time, ids are the same.
    """

    def __init__(self, path: str, pattern: str, max_pieces: int = MAX_PIECES):
        self.machine = Transducer(load_ranks(path), max_pieces // 5)
        self.split = regex.compile(pattern).findall
        self.decoder = StreamDecoder(self.machine.token)
        self.names = {i: str(i) for i in self.machine.token}
        self.pieces = _Memo(lambda piece: self.machine.join(piece.encode()), max_pieces // 3)
        self.words = _Memo(self._word, max_pieces)
        letters = [ascii_letters, *(x * 2 for x in ascii_letters)]  # does `pattern` leave a space and letters after it whole?
        self.plain = all(self.split(f" {x}") == [f" {x}"] for x in letters)

    def _word(self, word: str) -> tuple[int, ...]:
        text = " " + word
        if self.plain and len(word) <= len(ascii_letters) and word.isalpha() and word.isascii():
            return self.machine.join(text.encode())
        return self._encode(text)

    def _encode(self, text: str) -> tuple[int, ...]:
        pieces = self.split(text)
        if len(pieces) == 1:  # the word's own entry keeps it
            return self.machine.join(pieces[0].encode())
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        if _LOOSE.search(text):
            return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))
        first, *words = text.split(" ")
        return [*self._encode(first), *chain.from_iterable(map(self.words.__getitem__, words))]

    def decode(self, ids: list[int]) -> str:
        return self.decoder.feed(ids) + self.decoder.close()

    def id_text(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(2)
def codec(path: str, pattern: str, max_pieces: int = MAX_PIECES) -> Codec:
    """One for each Python worker, which serves many tasks."""
    gc.set_threshold(200_000, 50, 100)  # its tables hold many small tuples and no garbage in cycles
    return Codec(path, pattern, max_pieces)


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, max_pieces: int = MAX_PIECES) -> DataFrame:
    """(id, ids array<int>): the encoding of each whole text."""

    def start():
        claim(__name__, codec.cache_clear)
        own = codec(path, pattern, max_pieces)

        def step(batch: pa.RecordBatch) -> dict:
            return {id_col: batch.column(0), "ids": [own.encode(t or "") for t in batch.column(1).to_pylist()]}

        return step

    src = df.select(id_col, text_col)
    return map_batches(src, f"`{id_col}` {src.schema[0].dataType.simpleString()}, ids array<int>", start)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_pieces: int = MAX_PIECES) -> DataFrame:
    """Encode each whole text, decode the ids: (doc_id, n_tokens, ids_sha256, decoded_sha256). A narrow map, no shuffle."""

    def start():
        claim(__name__, codec.cache_clear)
        own = codec(path, pattern, max_pieces)

        def step(batch: pa.RecordBatch) -> dict:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(own.id_text(ids).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            return {id_col: batch.column(0), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

        return step

    src = df.select(id_col, text_col)
    return map_batches(src, f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", start)
