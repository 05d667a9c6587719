"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles is sketched into registers; a register holds,
for the least hash of its bucket, the number of leading zeros and four bits of
mantissa (8 bits in all).  Bands of compressed registers propose pairs; the
collision-corrected Jaccard estimate of their registers drops the hopeless ones;
the rest are confirmed on full shingle sets.

* Equal sets are one node from the start, so copies never become pairs.
* Small sets take registers from many hash functions, large ones from one
  function's buckets (empty ones borrow from a bucket that a hash chooses); sets
  of SMALL_LEAST shingles to that by the threshold have both, so any two sets of
  at least the threshold are compared under one scheme.
* In a band's bucket every member is compared with the bucket's leader, the node
  that shares buckets with the most others.
* Members of one bucket that confirmed links do not lead to one node (near copies
  of one original that are too far from it, say) are not expanded into pairs.
  They meet through their rarest shingles instead: two sets with the needed
  intersection share a shingle among the first |A| - needed + 1 of each, in any
  order of all shingles, and rare ones come first here.  That filter is exact, so
  a bucket's size plays no part in what is found.
* A pair of similarity 0.8 shares no band with probability 2e-6, and is dropped by
  its estimate with less than 1e-8.  Other thresholds take other bands, see
  banding().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import textkit as tk
from scriptorium.llm.components import components
from scriptorium.llm.frames import checked_broadcast, forget, in_arrow, map_arrow, materialise

REGISTERS = 576
#: Sets of at least so many shingles have registers of one function.
SMALL_LEAST = 100
#: A pair at the threshold may share no band with this probability.
MISSED = 1e-5
#: Sizes of sets in one class differ by this factor at most.
CLASS = 1.01
#: Partners of a node that one task's slice has, about.
PARTNERS = 1000
#: A pair's estimate must be this much under the threshold to be dropped: six standard deviations at 0.8, and more for borrowed registers.
SLACK = 0.15
#: Two unlike registers are equal by chance with about this probability (four bits of mantissa).
CHANCE = 0.18 / 16

_rng = np.random.default_rng(11)
_ODD = (_rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_ORDER = _rng.permutation(REGISTERS)
_FACTOR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def banding(percent: int) -> tuple[int, int]:
    """(bands, registers of a band): the longest bands that still bring pairs at the threshold together."""
    for rows in (8, 6, 4, 3, 2):
        if (1 - (percent / 100) ** rows) ** (REGISTERS // rows) <= MISSED:
            return REGISTERS // rows, rows
    raise ValueError(f"a threshold of {percent} % is too low for {REGISTERS} registers")


def small_most(percent: int) -> int:
    """Largest size of sets that have registers of many functions: what a set just under SMALL_LEAST can be linked with."""
    return -(-SMALL_LEAST * 100 // percent)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, next row, hashes, rows): distinct shingles of rows, sorted by row, then hash.

    Words are runs without blanks, A-Z as a-z; fewer than `words` words make one
    shingle together; no words, none.
    """
    with np.errstate(over="ignore"):
        for a, b in tk.row_slices(offsets):
            parts = [tk.byte_words(r, o) for r, o in tk.word_chunks(raw, offsets, a, b)]
            h = np.concatenate([p[0] for p in parts])
            row = np.concatenate([p[3] for p in parts])
            n = np.bincount(row, minlength=b - a)
            first = np.cumsum(n) - n
            if len(h) >= words:
                s = h[: len(h) - words + 1] * _FACTOR[0]
                for k in range(1, words):
                    s = s + h[k : len(h) - words + 1 + k] * _FACTOR[k % len(_FACTOR)] * np.uint64(2 * (k // len(_FACTOR)) + 1)
                whole = row[: len(s)] == row[words - 1 :]
                s, at = tk.mix(s[whole]), row[: len(s)][whole]
            else:
                s, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            short = np.flatnonzero((n > 0) & (n < words))
            if len(short):
                extra = np.zeros(len(short), np.uint64)
                for k in range(words - 1):
                    more = n[short] > k
                    extra[more] += h[first[short[more]] + k] * _FACTOR[k % len(_FACTOR)] * np.uint64(2 * (k // len(_FACTOR)) + 1)
                s = np.concatenate([s, tk.mix(extra + n[short].astype(np.uint64))])
                at = np.concatenate([at, short])
            order = np.argsort(s)
            if b - a > 1:
                order = order[np.argsort(at[order].astype(np.uint16) if b - a < 65536 else at[order], kind="stable")]
            s, at = s[order], at[order]
            if len(s):
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (at[1:] != at[:-1])
                s, at = s[new], at[new]
            yield a, b, s, at


def _compressed(least: np.ndarray) -> np.ndarray:
    """Registers of least hashes: leading zeros (15 at most), then four bits of mantissa."""
    part, exp = np.frexp(least.astype(np.float64) + 1.0)
    zeros = np.clip(65 - exp, 0, 15).astype(np.uint8)
    return (zeros << np.uint8(4)) | np.minimum((part * 32 - 16).astype(np.int64), 15).astype(np.uint8)


def _many_functions(s: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.empty((len(start), REGISTERS), np.uint8)
    for k in range(REGISTERS):
        out[:, k] = _compressed(np.minimum.reduceat(s * _ODD[k] + _ADD[k], start))
    return out


_LOAN = np.array([[int(x) for x in np.random.default_rng((5, t)).integers(0, REGISTERS, REGISTERS)] for t in range(256)])


def _one_function(s: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Registers by buckets of one function; s sorted within rows, so a bucket's first hash is its least."""
    bucket = ((s >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    at = row * REGISTERS + bucket
    head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    flat = np.zeros(rows * REGISTERS, np.uint8)
    full = np.zeros(rows * REGISTERS, bool)
    flat[at[head]], full[at[head]] = _compressed(s[head] * np.uint64(REGISTERS)), True
    grid, have = flat.reshape(rows, REGISTERS), full.reshape(rows, REGISTERS)
    done = have.copy()
    for step in _LOAN:
        r, c = np.nonzero(~done)
        if not len(r):
            break
        ok = have[r, step[c]]
        grid[r[ok], c[ok]] = grid[r[ok], step[c[ok]]]
        done[r[ok], c[ok]] = True
    return grid


def _set_nodes(s: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """An id for each set of sorted hashes s[upto[k]:upto[k + 1]], equal for equal sets."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (tk.mix(s + np.uint64(17)), tk.mix(s ^ np.uint64(0x5851F42D4C957F2D)))]
        f1, f2 = (c[upto[1:]] - c[upto[:-1]] for c in sums)
        return tk.mix(f1 + tk.mix(f2 + np.diff(upto).astype(np.uint64) * _FACTOR[2])).view(np.int64)


def _sketched(docs: DataFrame, words: int, most: int) -> DataFrame:
    """(doc_id, text_hash, n, node, small, large) of rows (doc_id, text, text_hash): set size, an id of the set, and registers."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offsets = tk.utf8(batch.column(1))
        for a, b, s, row in shingle_sets(raw, offsets, words):
            rows = b - a
            n = np.bincount(row, minlength=rows)
            upto = np.concatenate([[0], np.cumsum(n)])
            with np.errstate(over="ignore"):
                small = np.flatnonzero((n > 0) & (n <= most))
                large = np.flatnonzero(n >= SMALL_LEAST)
                cols = []
                for which, make in ((small, _many_functions), (large, _one_function)):
                    blobs: list[bytes | None] = [None] * rows
                    if len(which):
                        pick = tk.ranges(upto[which], n[which])
                        x = s[pick]
                        begin = np.cumsum(n[which]) - n[which]
                        grid = make(x, begin) if make is _many_functions else make(x, np.repeat(np.arange(len(which)), n[which]), len(which))
                        for k, w in enumerate(which.tolist()):
                            blobs[w] = grid[k].tobytes()
                    cols.append(pa.array(blobs, pa.binary()))
            yield pa.record_batch([batch.column(0).slice(a, rows), batch.column(2).slice(a, rows), pa.array(n.astype(np.int64)), pa.array(_set_nodes(s, upto)), *cols], names=["doc_id", "text_hash", "n", "node", "small", "large"])

    return map_arrow(docs, run, "doc_id bigint, text_hash bigint, n bigint, node bigint, small binary, large binary")


def _banded(rows: DataFrame, percent: int) -> DataFrame:
    """(band, node, tag) of rows (node, n, small, large): a hash of each band's registers; tag: twice n, plus 1 for large.

    Copies are alike here; of those in one batch only one is passed on.
    """
    bands, size = banding(percent)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, first = np.unique(batch.column(0).to_numpy(), return_index=True)
        batch = batch.take(pa.array(first))
        for scheme in (0, 1):
            blobs = batch.column(2 + scheme)
            part = batch.filter(blobs.is_valid())
            if not part.num_rows:
                continue
            grid = np.frombuffer(b"".join(part.column(2 + scheme).to_pylist()), np.uint8).reshape(part.num_rows, REGISTERS)[:, _ORDER].astype(np.uint64)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(2) + np.uint64(scheme), (len(grid), bands)).copy()
                for k in range(size):
                    key = tk.mix(key * _FACTOR[1] + grid[:, k::size] + np.uint64(1))
            node, tag = part.column(0).to_numpy(), part.column(1).to_numpy() * 2 + scheme
            yield pa.record_batch([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(node, bands)), pa.array(np.repeat(tag, bands))], names=["band", "node", "tag"])

    return map_arrow(rows, run, "band bigint, node bigint, tag bigint")


_STREAM = "a bigint, part int, scheme int, role int, b bigint, held binary"


def _roles(pairs: DataFrame) -> DataFrame:
    """(node, roles) of pairs (a, b, scheme): where the node's sketch or set is needed, as structs (a, part, scheme, role).

    Partners (role 1) of one node are dealt over parts of about PARTNERS, each
    with the node's own (role 0), so a node with very many partners is no single
    task's work.
    """
    busy = pairs.groupBy("a").agg(F.count("*").alias("c"))
    dealt = pairs.join(busy, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / PARTNERS)).cast("int"))
    place = lambda role: F.struct("a", "part", "scheme", F.lit(role).alias("role")).alias("x")
    heads = dealt.select(F.col("a").alias("node"), place(0)).distinct()
    return heads.union(dealt.select(F.col("b").alias("node"), place(1))).groupBy("node").agg(F.collect_list("x").alias("roles"))


def _passed(nodes: list[int], roles: list[list[dict]], held: list[tuple]) -> pa.RecordBatch:
    """Rows of _STREAM; held: what each node passes on under scheme 0 and 1."""
    out = [(r["a"], r["part"], r["scheme"], r["role"], n, h[r["scheme"]]) for n, rs, h in zip(nodes, roles, held, strict=True) for r in rs]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["a", "part", "scheme", "role", "b", "held"])


def _beside(stream: DataFrame) -> DataFrame:
    """The stream with the rows of an (a, part, scheme) together, a's own first."""
    keys = ["a", "part", "scheme"]
    return stream.repartition(*keys).sortWithinPartitions(*keys, "role")


def _estimated(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose corrected estimate is not hopeless; rows: (node, small, large)."""
    least = threshold - SLACK
    pairs = materialise(_roles(pairs), "roles")
    wanted = checked_broadcast(pairs, int(pairs.agg(F.coalesce(F.sum(F.size("roles") * 24 + 40), F.lit(0))).first()[0]), 1)

    def give(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, first = np.unique(batch.column(0).to_numpy(), return_index=True)  # of copies in a batch one is enough
        batch = batch.take(pa.array(first))
        yield _passed(batch.column(0).to_pylist(), batch.column(3).to_pylist(), list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            a, b, role = (batch.column(k).to_numpy() for k in (0, 4, 3))
            blobs = batch.column(5)
            grid = np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(len(blobs), REGISTERS) if len(blobs) else np.zeros((0, REGISTERS), np.uint8)
            heads = np.flatnonzero(role == 0)
            which = np.searchsorted(heads, np.arange(len(a)), "right") - 1
            pool = grid[heads] if head is None else np.concatenate([head[None, :], grid[heads]])
            which = which + (head is not None)
            if len(pool):
                head = pool[-1].copy()
            at = np.flatnonzero(role == 1)
            same = (grid[at] == pool[which[at]]).mean(1) if len(at) else np.zeros(0)
            keep = at[(same - CHANCE) / (1 - CHANCE) >= least]
            yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    stream = map_arrow(rows.select("node", "small", "large").join(wanted, "node"), give, _STREAM)
    return in_arrow(_beside(stream), run, "a bigint, b bigint").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (u, v) of pairs (a, b) with 100 * intersection >= percent * union of the full sets, from whole texts."""
    roles = materialise(_roles(pairs.select("a", "b", F.lit(0).alias("scheme"))).join(nodes, "node"), "roles")
    wanted = checked_broadcast(roles, int(roles.agg(F.coalesce(F.sum(F.size("roles") * 24 + 48), F.lit(0))).first()[0]), 1)
    texts = docs.join(wanted.withColumnRenamed("doc_id", "of"), docs["doc_id"].eqNullSafe(F.col("of"))).select("text", "node", "roles")

    def give(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offsets = tk.utf8(batch.column(0))
        node, roles, seen = batch.column(1).to_numpy(), batch.column(2), set()
        for a, b, s, row in shingle_sets(raw, offsets, words):
            upto = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))])
            # rows of one key can have other texts; and of copies one is enough
            own = [k for k in np.flatnonzero(_set_nodes(s, upto) == node[a:b]).tolist() if node[a + k] not in seen and not seen.add(node[a + k])]
            sets = [s[upto[k] : upto[k + 1]].tobytes() for k in own]
            yield _passed([int(node[a + k]) for k in own], [roles[a + k].as_py() for k in own], [(x,) for x in sets])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            roles, blobs = batch.column(3).to_pylist(), batch.column(5)
            for k, role in enumerate(roles):
                x = np.frombuffer(blobs[k].as_buffer(), np.uint64)
                if role == 0:
                    head = x
                    continue
                if min(len(x), len(head)) * 100 < percent * max(len(x), len(head)):
                    continue
                at = np.minimum(np.searchsorted(head, x), max(len(head) - 1, 0))
                both = int((head[at] == x).sum()) if len(head) else 0
                if 100 * both >= percent * (len(x) + len(head) - both):
                    found.append((batch.column(0)[k].as_py(), batch.column(4)[k].as_py()))
            yield pa.record_batch([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["u", "v"])

    return in_arrow(_beside(map_arrow(texts, give, _STREAM)), run, "u bigint, v bigint").distinct()


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, doc_id), from whole texts; a node's set may come twice."""
    wanted = checked_broadcast(wanted.withColumnRenamed("doc_id", "of"), wanted.count(), 32)
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("of"))).select("text", "node")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offsets = tk.utf8(batch.column(0))
        node = batch.column(1).to_numpy()
        for a, b, s, row in shingle_sets(raw, offsets, words):
            upto = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))])
            own = np.flatnonzero(_set_nodes(s, upto) == node[a:b])
            _, first = np.unique(node[a:b][own], return_index=True)
            own = own[first]
            yield pa.record_batch([pa.array(node[a:b][own]), pa.array([s[upto[k] : upto[k + 1]].tobytes() for k in own], pa.binary())], names=["node", "shingles"])

    return map_arrow(texts, run, "node bigint, shingles binary")


def _class(size: Column) -> Column:
    """A set size's class; larger sizes have the same or larger ones."""
    return F.floor(F.log(size.cast("double")) / F.lit(math.log(CLASS))).cast("int")


def _exploded(sets: DataFrame) -> DataFrame:
    """(node, shingle) of rows (node, shingles)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node = batch.column(0).to_numpy()
        blobs = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        yield pa.record_batch([pa.array(np.repeat(node, [len(x) for x in blobs])), pa.array(np.concatenate(blobs))], names=["node", "shingle"])

    return map_arrow(sets, run, "node bigint, shingle bigint")


def _rare_pairs(scope: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of nodes of unlike components whose sets can reach the threshold, by their rarest shingles.

    scope: (node, component, n, lo, hi), lo to hi the size classes that partners
    are in.  A shingle at place p (from 0) of the n of a set, rarest first, can
    be the first that is shared with a set of m only if n - p is not under the
    needed intersection of sets of n and m; so m has a bound for each place, and
    a row stands for each class of sizes up to it.  A shingle of one set alone
    takes a place, but no row.
    """
    shingles = _exploded(sets)
    often = shingles.groupBy("shingle").agg(F.count("*").alias("f")).filter("f > 1")
    of_node = Window.partitionBy("node")
    n, at = F.col("n"), F.col("n") - F.count("*").over(of_node) + F.row_number().over(of_node.orderBy("f", "shingle")) - 1
    placed = shingles.join(often, "shingle").join(scope, "node").withColumn("left", n - at)
    placed = placed.withColumn("most", F.floor((100 + percent) * F.col("left") / percent + 1e-9) - n).filter(100 * F.col("most") >= percent * n)
    lo = F.greatest("lo", _class(F.ceil(percent * n / 100 - 1e-9)))
    hi = F.least("hi", _class(F.least("most", F.floor(100 * n / percent + 1e-9))))
    rows = placed.withColumn("own", _class(n)).withColumn("x", lo).withColumn("y", hi).filter("x <= y").withColumn("other", F.explode(F.sequence("x", "y")))
    keys = ["c1", "c2", "shingle"]
    rows = materialise(rows.select(F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"), "shingle", "node", "component", "n", "own"), "rare")
    mixed = rows.groupBy(*keys, "component").agg(F.count("*").alias("c")).groupBy(*keys)
    mixed = mixed.agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("kinds")).filter("kinds > 1").drop("kinds")
    # of a pair in two components one is not in the group's largest; the many of that one never meet each other
    few = rows.join(mixed, keys).filter("component <> main").select(*keys, F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("own").alias("ob"))
    met = rows.join(few, keys).filter("component <> cb and (c1 = c2 or own <> ob)").filter(100 * F.least("n", "nb") >= percent * F.greatest("n", "nb"))
    pairs = materialise(met.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct(), "rare-pairs")
    forget(rows)
    return pairs


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept, cluster, text_hash) of each row.

    Rows are linked where 100 * |A & B| >= percent * |A | B| for their sets of
    distinct `words`-word shingles; component_id is the least key that links
    lead to, kept whether that is the row's own.  A row without words (null,
    empty or blank text) is linked with nothing.  Rows of one key and one set
    are alike; a null key is never the least, and is kept only where its
    component has no other.  cluster tells components apart where keys are null,
    and is null for rows without words; text_hash is the text's xxhash64.  Other
    columns play no part; no rows give no rows.
    """
    docs = df.select(df[key].cast("bigint").alias("doc_id"), df[text].cast("string").alias("text"))
    rows = materialise(_sketched(docs.withColumn("text_hash", F.xxhash64("text")), words, small_most(percent)), "sketches")
    some = rows.filter("n > 0")
    nodes = materialise(some.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")

    dealt = _banded(some.select("node", "n", "small", "large"), percent).repartition("band")  # one exchange serves the aggregate and the join
    crowds = dealt.groupBy("band").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("c")).filter("x <> y").drop("x", "y")
    met = materialise(dealt.join(crowds, "band"), "met")  # members of buckets with several nodes
    # the node that meets the most others leads a bucket: of a group of copies, the one that they were made from
    meets = materialise(met.groupBy("node").agg(F.sum("c").alias("meets")), "meets")
    leaders = met.join(meets, "node").groupBy("band").agg(F.max_by("node", F.struct("meets", "node")).alias("a"))
    stars = met.join(leaders, "band").filter("node <> a").select("a", F.col("node").alias("b"), F.col("tag").bitwiseAND(1).cast("int").alias("scheme")).distinct()
    stars = materialise(stars, "stars")
    likely = materialise(_estimated(stars, some, percent / 100), "likely")
    links = materialise(_confirmed(likely, docs, nodes, words, percent), "links")
    forget(stars, likely)

    # where links to leaders lead in two steps; nodes of one such end are in one component
    led = links.join(meets.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.max_by("u", F.struct("meets", "u")).alias("to"))
    led = materialise(led, "led")
    ends = led.join(led.select(F.col("node").alias("to"), F.col("to").alias("end")), "to", "left").select("node", F.coalesce("end", "to").alias("end"))
    placed = met.filter("c > 2").join(ends, "node", "left").select("band", "node", F.coalesce("end", "node").alias("component"), F.shiftright("tag", 1).alias("n"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), _class(F.min("n")).alias("lo"), _class(F.max("n")).alias("hi")).filter("x <> y").drop("x", "y")
    scope = placed.join(mixed, "band").groupBy("node").agg(F.max("component").alias("component"), F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    scope = materialise(scope, "scope")
    forget(met, meets, led)
    every = links
    if scope.limit(1).count():
        sets = materialise(_full_sets(docs, scope.select("node").join(nodes, "node"), words).dropDuplicates(["node"]), "sets")
        pairs = _rare_pairs(scope, sets, percent)
        more = materialise(_confirmed(pairs, docs, nodes, words, percent), "links")
        every = links.union(more)
        joined = components(every)
        forget(sets, pairs, more)
    else:
        joined = components(every)
    forget(links, scope)

    ids = nodes.join(joined, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = ids.join(least, "component").select("node", "component_id", "component")
    out = rows.select("doc_id", "text_hash", "n", "node").join(ids, "node", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.when(F.col("n") == 0, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), kept.alias("kept"), F.when(F.col("n") > 0, F.col("component")).alias("cluster"), "text_hash")


def one_of_each(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group of near duplicates: of the rows of the least key, one of the text with the least hash.

    Rows that are alike in key and text count as copies too, also those without
    words; which of rows of one key and text stays is open.
    """
    found = near_duplicates(df, words, percent, key, text).filter("kept")
    group = F.coalesce("cluster", F.xxhash64(key, "text_hash"))
    texts = found.groupBy(group.alias("group"), F.col(key).alias("k"), F.col("text_hash").alias("h")).agg(F.count("*").alias("times"))
    chosen = texts.groupBy("group").agg(F.min_by(F.struct("k", "h", "times"), F.struct("h", "k")).alias("x")).select("x.*").distinct()
    base = df.toDF(*[f"c{k}" for k in range(len(df.columns))])  # so that no column of df has a name that is used here
    at = dict(zip(df.columns, base.columns, strict=True))
    rows = base.join(chosen, F.col(at[key]).cast("bigint").eqNullSafe(F.col("k")) & (F.xxhash64(F.col(at[text]).cast("string")) == F.col("h")))
    # only rows that are there several times are shuffled once more
    once, often = rows.filter("times = 1"), rows.filter("times > 1").dropDuplicates(["k", "h"])
    return once.union(often).select(*base.columns).toDF(*df.columns)
