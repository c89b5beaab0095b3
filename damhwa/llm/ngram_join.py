"""Exact n-gram Jaccard join by vertical partitioning, and the components of its links.

A document's set is its distinct shingles, as 64-bit hashes. All sets are read in one global order: shingles by hash,
but those that many documents share (as counted over the whole corpus; the order only steers the work, any order gives
the same links) after all others. Two sets can only link if they share a shingle among the first few of each, their
prefixes, so one shuffle by shingle finds the lists in which sets can meet. The order is then cut into fragments: a
candidate pair's overlap is counted in each fragment apart and summed, and the sum decides.

Only components are asked for, so a pair within one component is never made. Each list is first tied to a leader, the
set with the fewest rare shingles (nearest to what a group of near copies has in common); those links stand before
others are looked at:

* lists of up to LIST sets make the pairs that still lie in different components, if all the shingles that the two share in
  lists leave room for a link;
* in a longer list, sets y outside the leader's component are held against the leader L. A pair of which one does not
  link with L can link only if it shares a shingle outside L, or if both sets overlap L by what the pair itself needs. The
  first are found by lists of the next level, by leader and shingle outside L; the second by sizes. So a group of n near
  copies does not make n*n pairs, and no link is lost: any order has its prefixes, also the one with L's shingles last.
  At the last level long lists make all pairs of different components.

Equal sets are one node from the start, told apart by 128 bits: nodes are 64-bit hashes, and where two sets have the same
one, the other 64 bits take its place. Components come from star contractions of the link table, carried on from turn
to turn. Nothing about all documents reaches the driver; intermediate tables go once the next ones stand.

Edge cases: null or empty text has no shingle, links with nothing and is its own component; fewer words than a shingle
make one; repeated rows share a set and a component; a null document id is never a component's id unless alone; ids keep
their type, the smallest is by its order; ties need no rule; an empty table gives no row; extra columns are ignored.
Shingles of 64 bits could add one to a pair's overlap with a probability of na*nb / 1.8e19.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from damhwa.llm.common import arrow_schema, claim, discard, drop_shuffles, materialize, to_batch

WIDTH = 5
SHARE = (3, 4)
COMMON = 16  # documents from which a shingle counts as common
HOT = 4096  # sets a task should meet of one shingle
LIST = 64  # sets up to which a shingle's list makes pairs directly
LIST_ROWS = 20_000  # rows of short lists whose pairs are counted at once
LEVELS = 3
FRAGMENTS = 8
MOST_COMMON_BROADCAST = 1_000_000
MOST_IDS_BROADCAST = 1_000_000
MOST_CLASHES = 100_000
MEMORY_SHINGLES = 2_000_000
MEMORY_POSTINGS = 200_000
MEMORY_WORDS = 100_000

_MUL = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The set of a text: hashes of its distinct shingles, ascending."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    x = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        x = x * _MUL[k] + h[k : n - width + 1 + k] * _MUL[width - k]
        x ^= x >> np.uint64(29)
    x *= _MUL[0]
    x ^= x >> np.uint64(32)
    x *= _MUL[1]
    x ^= x >> np.uint64(29)
    x.sort()
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def set_ids(grams: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, as signed longs: the node, and what tells sets with one node apart."""
    both = xxhash.xxh3_128_intdigest(grams.tobytes()) if len(grams) else 0
    return _signed(both & (1 << 64) - 1), _signed(both >> 64)


def set_id(grams: np.ndarray, clashes: frozenset = frozenset()) -> int:
    """A set's node; 0 for the empty set. clashes: nodes that several sets have, which their second hash replaces."""
    node, twin = set_ids(grams)
    return twin if node in clashes else node


def prefix(n: int, share=SHARE) -> int:
    """How many of a set's first shingles must be looked at: n - ceil(share * n) + 1."""
    return n - -(-share[0] * n // share[1]) + 1


def ordered_prefix(grams: np.ndarray, common: np.ndarray, share=SHARE) -> tuple[np.ndarray, int]:
    """(the first shingles in the global order, how many of them are not common)."""
    p = prefix(len(grams), share)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        last = common[at] == grams
        if last.any():
            return np.concatenate([grams[~last], grams[last]])[:p], min(p, len(grams) - int(last.sum()))
    return grams[:p], p


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, row): `row` tells rows apart that differ in id or text."""
    return df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row"))


def profile(rows: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds: (row, doc, n, node, twin) of each document; (gram, count) of shingles that a task meets in several sets."""
    ddl = f"row long, doc {rows.schema['doc'].dataType.simpleString()}, n int, node long, twin long, gram long, count long"
    schema = arrow_schema(rows.sparkSession, ddl)

    def filled(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return to_batch({f.name: columns.get(f.name, pa.nulls(size, f.type)) for f in schema}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _hashes.clear)
        held, size, seen = [], 0, set()

        def common() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts > 1
            return filled(gram=grams[many].view(np.int64), count=counts[many])

        for batch in batches:
            ns, ids = [], []
            for text in batch.column(1).to_pylist():
                grams = shingles(text, width)
                both = set_ids(grams)
                ns.append(len(grams))
                ids.append(both)
                if both not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(both)
                    held.append(grams)
                    size += len(grams)
                    if size > MEMORY_SHINGLES:
                        yield common()
                        held, size = [], 0
            yield filled(row=batch.column(2), doc=batch.column(0), n=ns, node=[x[0] for x in ids], twin=[x[1] for x in ids])
        if held:
            yield common()

    return rows.mapInArrow(run, ddl)


def clashing(docs: DataFrame) -> frozenset:
    """Nodes that stand for several sets: about n*n / 4e19 of n."""
    found = docs.groupBy("node").agg(F.min("twin").alias("x"), F.max("twin").alias("y")).where("x != y").select("node").limit(MOST_CLASHES + 1).collect()
    if len(found) > MOST_CLASHES:
        raise ValueError("too many sets share a 64-bit hash")
    return frozenset(r[0] for r in found)


def common_shingles(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(the most shared shingles, ascending, how often); no more than MOST_COMMON_BROADCAST, then those that are shared most."""
    totals = counts.groupBy("gram").agg(F.sum("count").alias("c")).where(F.col("c") >= COMMON)
    top = totals.orderBy(F.desc("c"), "gram").limit(MOST_COMMON_BROADCAST)
    both = np.array([tuple(r) for r in top.toLocalIterator()], np.int64).reshape(-1, 2)
    grams = both[:, 0].view(np.uint64) if len(both) else np.empty(0, np.uint64)
    order = np.argsort(grams)
    return grams[order], both[order, 1]


#: What differs from row to row comes first, so that the rest, equal in all rows of a set, is one match for the shuffle's compression.
POSTINGS = "gram long, at int, salt int, node long, n int, rare int"


def postings(rows: DataFrame, width: int, common, clashes: frozenset, share=SHARE) -> DataFrame:
    """(gram, at, salt, node, n, rare) of each set's prefix; `salt`, from 1, deals the list of a hot shingle over several
    tasks; `rare` counts the prefix's shingles that are not common."""
    schema = arrow_schema(rows.sparkSession, POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, _hashes.clear)
        seen, (last, counts) = set(), common.value
        hot, tasks = last[counts > HOT], (-(-counts // HOT))[counts > HOT]

        def dealt(grams, nodes, sizes, places, rare) -> pa.RecordBatch:
            gram, node = np.concatenate(grams), np.concatenate(nodes)
            salt = np.zeros(len(gram), np.int32)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, gram), len(hot) - 1)
                is_hot = hot[at] == gram
                salt[is_hot] = 1 + (node[is_hot].view(np.uint64) >> np.uint64(20)) % tasks[at[is_hot]].astype(np.uint64)
            return to_batch({"gram": gram.view(np.int64), "salt": salt, "node": node, "n": np.concatenate(sizes), "at": np.concatenate(places), "rare": np.concatenate(rare)}, schema)

        for batch in batches:
            grams, nodes, sizes, places, rare, waiting = [], [], [], [], [], 0
            for text in batch.column(0).to_pylist():
                if waiting > MEMORY_POSTINGS:
                    yield dealt(grams, nodes, sizes, places, rare)
                    grams, nodes, sizes, places, rare, waiting = [], [], [], [], [], 0
                s = shingles(text, width)
                if not len(s) or (node := set_id(s, clashes)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                first, few = ordered_prefix(s, last, share)
                waiting += len(first)
                grams.append(first)
                nodes.append(np.full(len(first), node, np.int64))
                sizes.append(np.full(len(first), len(s), np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
                rare.append(np.full(len(first), few, np.int32))
            if grams:
                yield dealt(grams, nodes, sizes, places, rare)

    return rows.select("text").mapInArrow(run, POSTINGS)


def shared(lists: DataFrame) -> DataFrame:
    """(gram, node, n, at, rare) of the lists that have several sets; a set stands once in a list."""
    ddl = "gram long, node long, n int, at int, rare int"
    schema = arrow_schema(lists.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, before = None, (None, None)  # a list's first row, while it may be its only one; the last row sent
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting is not None:
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(waiting.columns, batch.columns)], schema=batch.schema)
            gram, salt, node = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("gram", "salt", "node"))
            once = np.ones(len(gram), bool)  # equal sets' postings are neighbours
            once[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
            once[0] = (gram[0], node[0]) != before
            at = np.flatnonzero(once)
            if not len(at):
                continue
            g = gram[at]
            joined = np.zeros(len(at) + 1, bool)
            joined[1:-1] = g[1:] == g[:-1]
            joined[0] = waiting is None and g[0] == before[0]
            keep = joined[:-1] | joined[1:] | (salt[at] > 0)
            waiting = None if keep[-1] else batch.slice(int(at[-1]), 1)
            if keep[-1]:
                before = (int(g[-1]), int(node[at[-1]]))
            batch = batch.take(pa.array(at[keep]))
            if batch.num_rows:
                yield to_batch({k: batch.column(batch.schema.get_field_index(k)) for k in schema.names}, schema)

    return lists.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "at", "node").mapInArrow(run, ddl)


def pairs_of(lists: DataFrame, share=SHARE) -> DataFrame:
    """From lists (lead, gram, node, n, at, rest, root, open, ltop) of up to LIST sets each: pairs of different roots that
    sizes, places and the numbers of open lists that the two sets are in allow, as in_reach has it: (lead, a, b, na, nb, ra,
    rb, times), `times` counting lists that have the pair.

    Lists go by their leaders, whose lists mostly hold the same sets, and about LIST_ROWS rows of them are counted at once,
    so a pair that two sets make in hundreds of lists is sent a few times. A leader has no more lists than its own prefix
    has shingles, and they are short, so a group's size does not load a task.
    """
    ddl = "lead long, a long, b long, na int, nb int, ra int, rb int, times long"
    schema = arrow_schema(lists.sparkSession, ddl)
    p, q = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < LIST_ROWS:
                continue
            whole = pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*(b.columns for b in held))], schema=batch.schema)
            gram = whole.column(1).to_numpy()
            cut = int(np.argmax(gram == gram[-1]))  # the last list may go on
            held, rows = [whole.slice(cut)], whole.num_rows - cut
            if cut:
                yield resolve(whole.slice(0, cut))
        if held:
            yield resolve(pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*(b.columns for b in held))], schema=held[0].schema))

    def resolve(batch: pa.RecordBatch) -> pa.RecordBatch:
        lead, gram, node, n, at, rest, root, many = (c.to_numpy() for c in batch.columns[:8])
        n, at = n.astype(np.int64), at.astype(np.int64)
        after = np.where(rest < 0, -1 - rest, rest).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        lengths = np.diff(np.append(starts, len(gram)))
        xs, ys = [], []
        for step in range(1, int(lengths.max())):  # all pairs, by distance within the list
            ok = lengths > step
            s, extra = starts[ok], lengths[ok] - step
            x = np.repeat(s - np.concatenate([[0], np.cumsum(extra)[:-1]]), extra) + np.arange(extra.sum())
            y = x + step
            room = np.minimum(at[x], at[y]) + np.minimum(n[x] - at[x], n[y] - at[y])
            keep = (root[x] != root[y]) & (q * np.minimum(n[x], n[y]) >= p * np.maximum(n[x], n[y])) & ((lead[x] != 0) | ((p + q) * room >= p * (n[x] + n[y])))
            most = np.where((rest[x] < 0) & (rest[y] < 0), np.minimum(after[x], after[y]), np.maximum(after[x], after[y]))
            keep &= (p + q) * (np.minimum(many[x], many[y]) + most) >= p * (n[x] + n[y])
            xs.append(x[keep])
            ys.append(y[keep])
        x, y = np.concatenate(xs or [np.empty(0, int)]), np.concatenate(ys or [np.empty(0, int)])
        x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
        order = np.lexsort((node[y], node[x], lead[x]))
        x, y = x[order], y[order]
        first = np.ones(len(x), bool)
        first[1:] = (lead[x[1:]] != lead[x[:-1]]) | (node[x[1:]] != node[x[:-1]]) | (node[y[1:]] != node[y[:-1]])
        k = np.flatnonzero(first)
        times = np.diff(np.append(k, len(x)))
        x, y = x[k], y[k]
        return to_batch({"lead": lead[x], "a": node[x], "b": node[y], "na": n[x].astype(np.int32), "nb": n[y].astype(np.int32), "ra": rest[x], "rb": rest[y], "times": times}, schema)

    rows = lists.select("lead", "gram", "node", "n", "at", "rest", "root", "open", "ltop")
    return rows.repartition("lead", "ltop").sortWithinPartitions("lead", "ltop", "gram").mapInArrow(run, ddl)


def in_reach(common: Column, share=SHARE) -> Column:
    """Whether sets that share `common` shingles of their prefixes can link.

    The prefix that ends first in the order meets the other set only in the other's prefix, so the overlap is at most
    `common` and what follows that prefix: `ra` or `rb` shingles. Less than 0, these are -1 - the shingles shared with a
    leader, all else being in the prefix; if both are, the pair shares no more of the leader than the smaller of them.
    """
    p, q = share
    need = F.ceil(p * (F.col("na") + F.col("nb")) / (p + q))
    after = lambda c: F.when(F.col(c) < 0, -1 - F.col(c)).otherwise(F.col(c))
    both = (F.col("ra") < 0) & (F.col("rb") < 0)
    return common + F.when(both, F.least(after("ra"), after("rb"))).otherwise(F.greatest(after("ra"), after("rb"))) >= need


def alike(a: str, b: str, share=SHARE) -> Column:
    """Whether sizes allow a link."""
    return share[1] * F.least(a, b) >= share[0] * F.greatest(a, b)


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b, na, nb), a < b, from (a, b, na, nb)."""
    swap = F.col("a") > F.col("b")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(either("a", "b").alias("a"), either("b", "a").alias("b"), either("na", "nb").alias("na"), either("nb", "na").alias("nb")).distinct()


class Texts:
    """The sets of wanted nodes, each computed again from one row that has it."""

    def __init__(self, rows: DataFrame, docs: DataFrame, width: int, clashes: frozenset):
        self.rows, self.docs, self.width, self.clashes = rows, docs, width, clashes

    def sets(self, wanted: DataFrame, fragments: int) -> tuple[DataFrame, DataFrame]:
        """((node, fragment, grams) of the wanted nodes; a table to discard after use)."""
        width, clashes = self.width, self.clashes
        ids = materialize(self.docs.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")), "join-wanted")
        some = ids.select("row")
        if ids.count() <= MOST_IDS_BROADCAST:
            some = F.broadcast(some)
        ddl = "node long, fragment int, grams array<long>"
        schema = arrow_schema(self.rows.sparkSession, ddl)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim(__name__, _hashes.clear)
            edges = np.array([(1 << 64) // fragments * k for k in range(1, fragments)], np.uint64)
            for batch in batches:
                out: dict[str, list] = {"node": [], "fragment": [], "grams": []}
                for text in batch.column(0).to_pylist():
                    s = shingles(text, width)
                    node = set_id(s, clashes)
                    for k, part in enumerate(np.split(s, np.searchsorted(s, edges))):
                        if len(part):
                            out["node"].append(node)
                            out["fragment"].append(k)
                            out["grams"].append(part.view(np.int64))
                yield to_batch(out, schema)

        return self.rows.join(some, "row", "left_semi").select("text").mapInArrow(run, ddl), ids

    def links(self, pairs: DataFrame, share=SHARE) -> DataFrame:
        """(a, b, overlap) of the pairs (a, b, na, nb) that link; stored."""
        pairs = materialize(pairs, "join-pairs")
        parts, ids = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), FRAGMENTS)
        parts = materialize(parts, "join-parts")
        out = materialize(verify(pairs, parts, share), "join-links")
        discard(pairs, ids, parts)
        drop_shuffles(self.rows.sparkSession)
        return out


def verify(pairs: DataFrame, parts: DataFrame, share=SHARE) -> DataFrame:
    """Pairs (a, b, na, nb) whose overlap, counted by fragment and summed, makes a link: (a, b, overlap)."""
    left = parts.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = parts.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("gb"))
    p, q = share
    both = pairs.join(left, "a").join(right, ["b", "fragment"])
    summed = both.select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("ga", "gb")).alias("part"))
    summed = summed.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("part").alias("part"))  # repeated rows give equal parts
    summed = summed.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))
    return summed.where(q * F.col("overlap") >= p * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b", "overlap")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each other node of the links reaches, by alternating star contractions."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "stars")
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, materialize(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(last)
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
        # over when all are stars: no node has two edges up, or one up and one down
        if not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").limit(1).count():
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.stored_in = edges.stored_in
            return out


def rooted(df: DataFrame, roots: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    return df.join(roots.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left").withColumn(root, F.coalesce(root, node))


def contract(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`roots`, with components that new links tie as one; only roots take part."""
    ends = rooted(rooted(links.select("a", "b"), roots, "a", "ra"), roots, "b", "rb")
    new = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    moved = rooted(roots.withColumnRenamed("root", "old"), new, "old", "root").select("node", "root")
    out = materialize(moved.unionAll(new), "join-roots")
    discard(new, roots)
    return out


def open_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists of several roots, each row with its root, its list's length and leader: the set of fewest rare
    shingles, which most of a group of near copies is nearest to, then the largest."""
    rows = rooted(lists, roots)
    leads = rows.groupBy("gram").agg(F.count("*").alias("len"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct("rare", (-F.col("n")).alias("minus"), "node", "n", "root")).alias("top"))
    leads = leads.where("lo != hi").select("gram", "len", F.col("top.node").alias("ltop"), F.col("top.n").alias("ntop"), F.col("top.root").alias("rtop"))
    return rows.join(leads, "gram")


def best_stars(lists: DataFrame, roots: DataFrame, first: bool, share=SHARE) -> DataFrame:
    """Each set's pair with the leader that it meets in most lists, (a, b, na, nb): few pairs, which tie most of what links."""
    stars = open_lists(lists, roots).where((F.col("root") != F.col("rtop")) & alike("n", "ntop", share))
    stars = stars.groupBy(F.col("node").alias("a"), F.col("ltop").alias("b")).agg(F.max("n").alias("na"), F.max("ntop").alias("nb"), F.max("rest").alias("ra"), F.count("*").alias("times"))
    if first:
        stars = stars.withColumn("rb", F.col("nb") - _prefix(F.col("nb"), share)).where(in_reach(F.col("times"), share))
    return stars.groupBy("a").agg(F.max_by(F.struct("b", "na", "nb"), F.struct("times", "b")).alias("x")).select("a", "x.*")


def _prefix(n: Column, share=SHARE) -> Column:
    return (n - F.ceil(share[0] * n / share[1]) + 1).cast("int")


def next_level(members: DataFrame, texts: Texts, share=SHARE) -> tuple[DataFrame, DataFrame]:
    """From (lead, node, n): (postings by leader and shingle outside it, stored; (lead, node, n, o), o being the overlap)."""
    nodes = members.select("node").unionAll(members.select(F.col("lead").alias("node"))).distinct()
    sets, ids = texts.sets(nodes, 1)
    sets = materialize(sets.groupBy("node").agg(F.first("grams").alias("grams")), "join-sets")
    own, leads = sets.select("node", F.col("grams").alias("ga")), sets.select(F.col("node").alias("lead"), F.col("grams").alias("gl"))
    out = members.join(own, "node").join(leads, "lead").withColumn("out", F.array_sort(F.array_except("ga", "gl")))
    p = _prefix(F.col("n"), share)
    out = out.select("lead", "node", "n", (F.col("n") - F.size("out")).alias("o"), F.slice("out", 1, p).alias("first"))
    out = materialize(out, "join-outside")
    rest = F.when(F.size("first") < p, -1 - F.col("o")).otherwise(F.col("n") - p).cast("int")
    posted = out.select("lead", "node", "n", rest.alias("rest"), (F.col("n") - F.col("o")).alias("rare"), F.posexplode("first").alias("at", "z"))
    posted = posted.select("lead", F.xxhash64("lead", "z").alias("gram"), "node", "n", "at", "rest", "rare")
    several = posted.groupBy("gram").count().where("count > 1").select("gram")
    lists = materialize(posted.join(several, "gram", "left_semi"), "join-lists")
    overlaps = materialize(out.select("lead", "node", "n", "o"), "join-overlaps")
    discard(ids, sets, out)
    return lists, overlaps


def most_alike(o: Column, n: Column, share=SHARE) -> Column:
    """The greatest size of a set that can link with one of size n if they share no more than o."""
    p, q = share
    return F.floor((p + q) * o / p).cast("int") - n


def by_size(overlaps: DataFrame, roots: DataFrame, stars: bool, share=SHARE) -> DataFrame:
    """Pairs of sets that may link by what both share with a leader, though one does not link with it: (a, b, na, nb).

    stars: only those with the set of greatest overlap in their class of sizes.
    """
    rows = rooted(rooted(overlaps, roots), roots, "lead", "rlead").withColumn("most", most_alike(F.col("o"), F.col("n"), share))
    low = F.ceil(share[0] * F.col("n") / share[1]).cast("int")
    apart = rows.where((F.col("root") != F.col("rlead")) & (F.col("most") >= low))
    if stars:
        apart = apart.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(8 / 7))))
        tops = apart.groupBy("lead", "class").agg(F.max_by(F.struct(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rtop")), F.struct("o", "node")).alias("t")).select("lead", "class", "t.*")
        return apart.join(tops, ["lead", "class"]).where("root != rtop").select(F.col("node").alias("a"), "b", F.col("n").alias("na"), "nb")
    high = F.least(F.col("most"), F.floor(share[1] * F.col("n") / share[0]).cast("int"))
    wide = apart.select("lead", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.explode(F.sequence(low, high)).alias("nb"))
    other = rows.select("lead", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("most").alias("mostb"))
    return wide.join(other, ["lead", "nb"]).where("ra != rb AND na <= mostb").select("a", "b", "na", "nb")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share=SHARE) -> tuple[DataFrame, DataFrame]:
    """(documents: row, doc, n, node; roots: node, root, of the nodes that are not their component's root)."""
    spark = df.sparkSession
    rows = keyed(df, id_col, text_col)
    found = materialize(profile(rows, width), "join-profile")
    docs = found.where("node is not null").select("row", "doc", "n", "node", "twin")
    common = spark.sparkContext.broadcast(common_shingles(found.where("gram is not null").select("gram", "count")))
    if clashes := clashing(docs):
        docs = docs.withColumn("node", F.when(F.col("node").isin(*clashes), F.col("twin")).otherwise(F.col("node")))
    docs = docs.drop("twin")
    texts = Texts(rows, docs.where("n > 0"), width, clashes)
    stored = materialize(shared(postings(rows, width, common, clashes, share)), "join-lists")
    drop_shuffles(spark)
    lists = stored.select(F.lit(0).cast("long").alias("lead"), "gram", "node", "n", "at", "rare", (F.col("n") - _prefix(F.col("n"), share)).alias("rest"))
    roots, overlaps = materialize(spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("root")), "join-roots"), None
    for level in range(LEVELS):
        stars = best_stars(lists, roots, level == 0, share)
        if overlaps is not None:
            stars = stars.unionByName(by_size(overlaps, roots, True, share))
        roots = _tie(roots, texts, stars, share)
        rows_open = materialize(open_lists(lists, roots), "join-open")
        drop_shuffles(spark)
        last = level == LEVELS - 1
        short, long = rows_open.where(F.col("len") <= LIST), rows_open.where(F.col("len") > LIST)
        held = rows_open.groupBy("lead", "node").agg(F.count("*").alias("open"))
        pairs = pairs_of(short.join(held, ["lead", "node"]), share).groupBy("lead", "a", "b", "na", "nb", "ra", "rb").agg(F.sum("times").alias("times"))
        many = long.groupBy("lead", "node").agg(F.count("*").alias("many"))
        for end in "ab":
            pairs = pairs.join(many.select("lead", F.col("node").alias(end), F.col("many").alias(f"m{end}")), ["lead", end], "left")
        pairs = pairs.where(in_reach(F.col("times") + F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0))), share)).select("a", "b", "na", "nb")
        if last:
            x, y = (long.select("gram", *[F.col(c).alias(f"{c}{e}") for c in ("node", "n", "root")]) for e in "xy")
            met = x.join(y, "gram").where((F.col("nodex") < F.col("nodey")) & (F.col("rootx") != F.col("rooty")) & alike("nx", "ny", share))
            met = met.select(F.col("nodex").alias("a"), F.col("nodey").alias("b"), F.col("nx").alias("na"), F.col("ny").alias("nb"))
        else:
            met = long.where((F.col("root") != F.col("rtop")) & alike("n", "ntop", share)).select(F.col("node").alias("a"), F.col("ltop").alias("b"), F.col("n").alias("na"), F.col("ntop").alias("nb"))
        pairs = pairs.unionByName(met)
        if overlaps is not None:
            pairs = pairs.unionByName(by_size(overlaps, roots, False, share))
        roots = _tie(roots, texts, pairs, share)
        if last:
            break
        # leaders stay as they were, so that those outside their components have been held against them
        again = rooted(long.drop("root"), roots)
        split = again.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("gram")
        members = materialize(again.join(split, "gram", "left_semi").select(F.col("ltop").alias("lead"), "node", "n").distinct(), "join-members")
        discard(rows_open, stored, *([overlaps] if overlaps is not None else []))
        if not members.limit(1).count():
            break
        stored, overlaps = next_level(members, texts, share)
        lists = stored
        discard(members)
    return docs, roots


def _tie(roots: DataFrame, texts: Texts, pairs: DataFrame, share) -> DataFrame:
    links = texts.links(ordered(pairs), share)
    out = contract(roots, links)
    discard(links)
    return out


def classes(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component): the smallest document id of each component."""
    nodes = rooted(docs.where("n > 0").groupBy("node").agg(F.min("doc").alias("least")), roots)
    least = nodes.groupBy("root").agg(F.min("least").alias("component"))
    return materialize(nodes.join(least, "root").select("node", "component"), "join-components")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share=SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document."""
    docs, roots = join(df, id_col, text_col, width, share)
    out = docs.join(classes(docs, roots), "node", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share=SHARE) -> DataFrame:
    """The rows of `df`, one of each component: that of the smallest id (null ids last), then of the smallest row hash.

    Texts without words link with nothing and all stay. Of rows equal in id and text that would stay, one stays.
    """
    docs, roots = join(df, id_col, text_col, width, share)
    docs = docs.where("n > 0")
    nodes = rooted(docs.groupBy("node").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("least")), roots)
    kept = nodes.groupBy("root").agg(F.min("least").alias("least")).select("least.row")
    gone = materialize(docs.select("row").distinct().join(kept, "row", "left_anti").withColumnRenamed("row", "_row"), "join-gone")
    several = materialize(docs.groupBy(F.col("row").alias("_row")).count().where("count > 1").join(gone, "_row", "left_anti").select("_row"), "join-several")
    some = F.broadcast(gone) if gone.count() <= MOST_IDS_BROADCAST else gone
    staying = df.withColumn("_row", F.xxhash64(id_col, text_col)).join(some, "_row", "left_anti")
    if several.limit(1).count():
        once = staying.join(several, "_row", "left_semi").dropDuplicates(["_row"])
        staying = staying.join(several, "_row", "left_anti").unionByName(once)
    return staying.select(*df.columns)
