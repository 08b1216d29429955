"""MinHash near-duplicates by a signature-coordinate inverted join, confirmed on full sets.

A text is the set of its five-word shingles (a shorter text is one shingle).  Texts with
equal sets are folded first: their representative stands for all.  A representative's
signature has :data:`COORDINATES` minimum hashes; in the inverted lists it is posted under
a *prefix* of its first :data:`LISTED` (coordinate, value) pairs.

*Prefix.*  Of a pair at the similarity asked for, :data:`LISTED_MATCHES` or more of those
coordinates agree (but for a chance of about 1e-7), so in any order of all (coordinate,
value) pairs their first :data:`POSTED` have :data:`SHARED` in common, and the others need
no lists.  The order puts the values last that more than one in :data:`COMMON` texts have,
commonest last: a passage that many texts share makes long lists only among texts that
consist of it.  Lists are divided by *bands* of set size, so wide that alike sets lie in the
same band or in two that follow one another.

*Counting.*  One member of each list is its centre, the first in one of :data:`ORDERS` orders
that all lists share: it collides once with every other member.  Collisions are counted by
pair; the pairs of a member that collide most often (as many as there are orders), and
:data:`COLLISIONS` times or more, have their whole signatures compared; those that agree in :data:`MATCHES` of all
coordinates are confirmed on their full shingle sets, and confirmed links are closed to
components.

*Skipping.*  Links within a component can't change the components, so a list whose members
are in one component is skipped as a whole.  A member that stands in fewer than
:data:`SHARED` of the lists left can't be of a pair that collides that often, and goes; of
its lists in one order of all, shortest first, it leaves out the last ``SHARED - 1``, as the
first that a pair has in common is never among those.  In what is left, pairs from different
components are sought inside tasks by comparing whole signatures, whose agreements are the
pair's collisions.  A group of near-copies that are mostly *not* alike enough makes long
lists and would give a pair for each two members; lists of more than :data:`LONG` members
are compared in blocks that carry the members' full sets too, each pair in one of its lists,
and only links come out, one for each two components that a task joins.  Pairs from short
lists are confirmed on the full sets, so no link that matters is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import dropped, lean, texts_of, written
from .textkit import SPACED, U64, Words, grams, inside_one, mix, slices, span_hash

WIDTH = 5
COORDINATES = 128
MATCHES = 70
LISTED = 64
LISTED_MATCHES = 29
SHARED = 8
POSTED = LISTED - LISTED_MATCHES + SHARED
COLLISIONS = 2
ORDERS = 4
COMMON = 2000
ROUNDS = 2
PASSES = 1
LONG = 48
MOST_FILTER_BITS = 1 << 26
BLOCK_BYTES = 1 << 20
NUMERATOR, DENOMINATOR = 75, 100

_rng = np.random.Generator(np.random.PCG64(7))
_MUL = _rng.integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * U64(2) + U64(1)
_XOR = _rng.integers(1, 1 << 62, COORDINATES, dtype=np.uint64)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of rows: the first row, the distinct shingle hashes (ascending within a row) and the rows' bounds in them."""
    for lo, hi, buf, off in slices(texts):
        w = Words(buf, off, SPACED, True)
        start, owner = inside_one(w.first, width, len(w.hash))
        g = grams(w.hash, width)[start] if len(start) else np.zeros(0, np.uint64)
        counts = w.counts()
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            g = np.concatenate([g, span_hash(w.hash, w.first[short], w.first[short + 1])])
            owner = np.concatenate([owner, short])
        order = np.lexsort((g, owner))
        g, owner = g[order], owner[order]
        if len(g):
            keep = np.concatenate([[True], (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])])
            g, owner = g[keep], owner[keep]
        yield lo, g, np.searchsorted(owner, np.arange(hi - lo + 1))


def signatures(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minimum of each coordinate's hash over each non-empty row's set, as 32-bit values (rows by coordinates)."""
    rows = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(rows), COORDINATES), dtype=np.uint32)
    if len(rows):
        begin = first[rows]
        for j in range(COORDINATES):
            h = (g ^ _XOR[j]) * _MUL[j]
            out[:, j] = np.minimum.reduceat(h, begin) >> U64(32)
    return out


def _digests(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two sums of mixed hashes of each row's set: 128 bits that equal sets share."""
    n = np.diff(first)
    rows = np.flatnonzero(n > 0)
    one, two = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
    if len(rows):
        one[rows] = np.add.reduceat(mix(g, 1), first[rows])
        two[rows] = np.add.reduceat(mix(g, 2), first[rows])
    return n, one, two


@lean("minhash")
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, g, first in shingle_sets(b.column(1)):
            n, one, two = _digests(g, first)
            sig: list[bytes | None] = [None] * len(n)
            for r, s in zip(np.flatnonzero(n > 0).tolist(), _packed(signatures(g, first)), strict=True):
                sig[r] = s.tobytes()
            columns = [b.column(0).slice(lo, len(n)), b.column(2).slice(lo, len(n)), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "n_shingles", "one", "two", "sig"])


def _packed(sig: np.ndarray) -> np.ndarray:
    """Signatures as bytes: one of every coordinate (unequal values agree once in 256, so counts can only be too high), then all four of the listed ones."""
    return np.concatenate([sig.astype(np.uint8), np.ascontiguousarray(sig[:, :LISTED]).view(np.uint8)], axis=1)


def _keys(column: pa.Array) -> np.ndarray:
    """Coordinate and value of each listed coordinate in one number, row by row."""
    packed = _rows_of(column, COORDINATES + 4 * LISTED)
    values = np.ascontiguousarray(packed[:, COORDINATES:]).view(np.uint32)
    return values.astype(np.int64) + (np.arange(LISTED, dtype=np.int64) << 32)[None, :]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that more than one in ``2 * COMMON`` of a task's rows have."""
    held = [np.zeros((0, LISTED), np.int64)]
    for b in batches:
        held += [_keys(b.column(0).slice(lo, 4096)) for lo in range(0, b.num_rows, 4096)]
        if sum(map(len, held)) >= 1 << 15:
            yield _counted(held)
            held = [np.zeros((0, LISTED), np.int64)]
    yield _counted(held)


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    every = np.concatenate(held)
    keys, n = np.unique(every, return_counts=True)
    keep = n > max(1, len(every) // (2 * COMMON))
    return pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(n[keep].astype(np.int64))], ["key", "n"])


def _postings(keys: np.ndarray, counts: np.ndarray):
    """A representative's list keys: the first in the order of commonness, coordinate and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                k = _keys(part.column(2))
                n = np.zeros(k.shape, dtype=np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                    n = np.where(keys[at] == k, counts[at], 0)
                order = np.argsort(n, axis=1, kind="stable")[:, :POSTED]
                k = np.take_along_axis(k, order, axis=1)
                ids, band = (np.repeat(part.column(i).to_numpy(zero_copy_only=False), POSTED) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(band), pa.array(ids)], ["key", "band", "node"])

    return run


def _rows_of(column: pa.Array, width: int = COORDINATES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


@lean("minhash")
def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            p = b.slice(lo, 4096)
            keep = (_rows_of(p.column(2)) == _rows_of(p.column(3))).sum(axis=1) >= MATCHES
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1)], ["a", "b"]).filter(pa.array(keep))


@lean("minhash")
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets in ascending order, 64 bits a shingle."""
    for b in batches:
        for lo, g, first in shingle_sets(b.column(1)):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(first) - 1), pa.array([g[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["node", "set"])


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct pairs of identifiers, the smaller first."""
    both = np.concatenate([np.zeros((0, 2), np.int64), *found])
    both = np.unique(np.sort(both, axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _within(numerator: int, denominator: int):
    """Pairs of a short list's members: of different components, sizes alike, often agreeing."""

    @lean("minhash")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for members in b.column(0):
                m = members.values
                ids, component, n = (m.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                sig = _rows_of(m.field(3))
                i, j = np.triu_indices(len(ids), 1)
                ok = (component[i] != component[j]) & (denominator * np.minimum(n[i], n[j]) >= numerator * np.maximum(n[i], n[j]))
                i, j = i[ok], j[ok]
                ok = (sig[i] == sig[j]).sum(axis=1) >= MATCHES
                if ok.any():
                    found.append(np.column_stack([ids[i[ok]], ids[j[ok]]]))
            yield _pairs(found)

    return run


def _across(numerator: int, denominator: int):
    """Links between two blocks of a long list, decided on the members' full sets; of those that join the same components one is enough."""

    @lean("minhash")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_block_links(b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(2)[k].values, b.column(3)[k].values, numerator, denominator) for k in range(b.num_rows)]
            yield _pairs(found)

    return run


def _block_links(post: int, same: bool, left: pa.Array, right: pa.Array, numerator: int, denominator: int) -> np.ndarray:
    ids, component, size = (right.field(k).to_numpy(zero_copy_only=False) for k in ("node", "component", "n"))
    sig = _rows_of(right.field("sig"))
    sets = [np.frombuffer(x, dtype=np.uint64) for x in right.field("set").to_pylist()]
    posts = [frozenset(x) for x in right.field("posts").to_pylist()]
    own_ids, own_component, own_size = (left.field(k).to_numpy(zero_copy_only=False) for k in ("node", "component", "n"))
    own_sig, own_sets, own_posts = _rows_of(left.field("sig")), left.field("set"), left.field("posts")
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            x = up
        return x

    found: list[tuple[int, int]] = []
    now = component.copy()
    for i in range(len(own_ids)):
        me = find(int(own_component[i]))
        ok = (now != me) & (denominator * np.minimum(size, own_size[i]) >= numerator * np.maximum(size, own_size[i]))
        if same:
            ok[: i + 1] = False
        j = np.flatnonzero(ok)
        if len(j):
            j = j[(sig[j] == own_sig[i]).sum(axis=1) >= MATCHES]
        if len(j):
            mine = frozenset(own_posts[i].as_py())
            j = np.array([k for k in j.tolist() if min(mine & posts[k]) == post], dtype=np.int64)
        if not len(j):
            continue
        own = np.frombuffer(own_sets[i].as_py(), dtype=np.uint64)
        flat, bounds = np.concatenate([sets[k] for k in j]), np.cumsum([0, *[len(sets[k]) for k in j]])[:-1]
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        common = np.add.reduceat((own[at] == flat).astype(np.int64), bounds)
        for k in j[denominator * common >= numerator * (own_size[i] + size[j] - common)].tolist():
            other = find(int(now[k]))
            if other != me:
                found.append((int(own_ids[i]), int(ids[k])))
                root[other] = me
                now[now == other] = me
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def _confirm(numerator: int, denominator: int):
    """Pairs whose full shingle sets are alike enough."""

    @lean("minhash")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                p = b.slice(lo, 512)
                keyed = []
                sizes = []
                for c in (2, 3):
                    parts = [np.zeros(0, np.uint64)]
                    n = []
                    row = 0
                    for _, g, first in shingle_sets(p.column(c)):
                        k = np.diff(first)
                        # within a pair, 52 bits tell some thousand shingles apart; the row makes pairs distinct
                        parts.append(mix(g + mix(np.repeat(np.arange(row, row + len(k), dtype=np.uint64), k), 9)))
                        n.append(k)
                        row += len(k)
                    keyed.append(np.concatenate(parts))
                    sizes.append(np.concatenate(n))
                owner = np.repeat(np.arange(p.num_rows), sizes[0])
                common = np.bincount(owner[np.isin(keyed[0], keyed[1])], minlength=p.num_rows)
                union = sizes[0] + sizes[1] - common
                keep = denominator * common >= numerator * union
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _confirmed(pairs: DataFrame, rows: DataFrame, reps: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs whose whole texts are alike, written."""
    texts = _texts(rows, reps, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    links = written(both.mapInArrow(_confirm(numerator, denominator), "a long, b long"), "links")
    dropped(texts)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numerator: int = NUMERATOR, denominator: int = DENOMINATOR, detail: bool = False) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row.

    Texts are linked when ``denominator`` times their common shingles is at least ``numerator``
    times all of theirs (the constants of this module fit a similarity of 0.75 or more);
    ``component_id`` is the smallest identifier reachable over links, ``kept`` says that it is
    the row's own.  Null, empty and blank texts have no shingles and are linked with nothing.
    Rows that share an identifier are told apart by their texts, each takes the component of
    its own; a null identifier stays null, is never a component's name and is always kept.
    With ``detail`` there are also ``text_hash`` (of the text, to name a row) and ``group``,
    a number of the component that rows without identifiers have too (null without shingles).
    """
    if numerator * 100 < 75 * denominator:
        raise ValueError("signatures here are laid out for a similarity of 0.75 or more")
    rows = texts_of(docs, id_col, text_col)
    spark = docs.sparkSession
    described = written(rows.select("id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_describe, "id long, text_hash long, n_shingles long, one long, two long, sig binary"), "signatures")
    # one shuffle folds equal sets; a set's signature is the same in all its rows, and its node is a number that the written table fixes
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("n_shingles").alias("n"), "sig")).alias("least")
    folded = described.where("n_shingles > 0").groupBy("one", "two").agg(least).select("one", "two", "least.id", "least.n", "least.sig")
    band = F.floor(F.log("n") / float(-np.log(numerator / denominator) * 1.001)).cast("int")
    reps = written(folded.select("*", band.alias("band"), F.monotonically_increasing_id().alias("node")), "representatives")
    lite = reps.select("node", "n", F.substring("sig", 1, COORDINATES).alias("sig"))

    # at most LISTED * COMMON keys can be so common
    total = reps.count()
    common = reps.select("sig").mapInArrow(_frequent, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > total / COMMON).orderBy("key").collect()
    held = spark.sparkContext.broadcast((np.array([r.key for r in common], dtype=np.int64), np.array([r.n for r in common], dtype=np.int64)))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _postings(*held.value)(batches)

    # lists of several members; what has one row a key is written before it is joined, so hot keys can be split
    postings = reps.select("node", "band", "sig").mapInArrow(post, "key long, band int, node long")
    several = written(postings.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("key"), "several")
    open_ = written(postings.join(several, "key").select("key", "band", "node", F.col("node").alias("component")), "lists")
    dropped(several)

    links: DataFrame | None = None
    for number in range(ROUNDS):
        now = _star_links(open_, number, rows, reps, lite, numerator, denominator)
        links = now if links is None else written(links.union(now), "links")
        label = components(links)
        placed = written(open_.drop("component").join(label.withColumnRenamed("id", "node"), "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("component")), "placed")
        dropped(open_)
        open_ = _open(placed)
        if open_.isEmpty():
            break
    else:
        more = _rest(open_, rows, reps, lite, numerator, denominator)
        if not more.isEmpty():
            label = components(links.union(more))
    dropped(open_)

    grouped = reps.select("one", "two", "id", "node").join(label.select(F.col("id").alias("node"), "component"), "node", "left").select("one", "two", "id", F.coalesce("component", "node").alias("group"))
    names = written(grouped.groupBy("group").agg(F.min("id").alias("component")), "names")
    final = written(grouped.select("one", "two", "group").join(names, "group"), "components")
    dropped(reps, names)
    out = described.select("id", "text_hash", "n_shingles", "one", "two").join(final, ["one", "two"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    more_columns = ["text_hash", "group"] if detail else []
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), *more_columns)


def _rest(open_: DataFrame, rows: DataFrame, reps: DataFrame, lite: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links between members of different components that the rounds over centres left."""
    # of a member's lists, shortest first, the last are not needed
    size = written(open_.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "sizes")
    ranked = open_.join(size, "key").groupBy("node", "component").agg(F.sort_array(F.collect_list(F.struct("size", "key", "band"))).alias("lists"))
    ranked = ranked.select("node", "component", F.explode(F.expr(f"slice(lists, 1, greatest(size(lists) - {SHARED - 1}, 0))")).alias("l")).select("l.key", "l.band", "node", "component")
    ranked = written(ranked, "ranked")
    left, windows = _windows(ranked)
    short = left.join(windows.where(F.col("size") <= LONG).select("key", "window"), ["key", "window"]).join(lite, "node")
    met = short.groupBy("key", "window").agg(F.collect_list(F.struct("node", "component", "n", "sig")).alias("members")).select("members")
    met = written(met.mapInArrow(_within(numerator, denominator), "a long, b long").distinct(), "pairs")
    more = _confirmed(met, rows, reps, numerator, denominator)
    long = _long(left.join(windows.where(F.col("size") > LONG), ["key", "window"]), rows, reps, lite, numerator, denominator)
    dropped(size, ranked, windows, met)
    return more if long is None else more.union(long)


def _star_links(posts: DataFrame, number: int, rows: DataFrame, reps: DataFrame, lite: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Confirmed links of windows' centres: members of other components that collide with one often enough."""
    members, windows = _windows(posts)
    # the centre comes first in one of a few orders that all lists share, other ones each round
    turn = F.xxhash64("node", F.pmod(F.shiftright("key", 32), F.lit(ORDERS)), F.lit(number)).alias("turn")
    centre = members.groupBy("key", "window").agg(F.min(F.struct(turn, "node", "component")).alias("c")).select("key", "window", F.col("c.node").alias("a"), F.col("c.component").alias("own"))
    centre = written(centre.join(windows.select("key", "window"), ["key", "window"]), "centres")
    collisions = members.join(centre, ["key", "window"]).where("component != own").groupBy("a", F.col("node").alias("b")).agg(F.count_distinct("key").alias("times"))
    # a member meets the few centres that it collides with most often, so pairs grow with members
    met = collisions.where(F.col("times") >= COLLISIONS).groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "a")), asc=False), 1, ORDERS).alias("c"))
    met = met.select(F.explode("c").alias("c"), "b").select("c.a", "b")
    one, two = (lite.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in ("a", "b"))
    alike = F.least("na", "nb") * denominator >= F.greatest("na", "nb") * numerator
    pairs = written(met.join(two, "b").join(one, "a").where(alike).select("a", "b", "sa", "sb").mapInArrow(_agreeing, "a long, b long"), "pairs")
    links = _confirmed(pairs, rows, reps, numerator, denominator)
    dropped(windows, centre, pairs)
    return links


def _windows(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members by window (a band of a list and the next one), and the windows in which members of different components may be alike, with their sizes."""
    members = posts.select("key", F.explode(F.array("band", F.col("band") - 1)).alias("window"), "band", "node", "component")
    found = members.groupBy("key", "window").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max(F.col("band") == F.col("window")).alias("own"), F.count(F.lit(1)).alias("size"))
    return members, written(found.where("own and least < most").select("key", "window", "size"), "windows")


def _open(posts: DataFrame) -> DataFrame:
    """Postings of members that may be of a pair that shares :data:`SHARED` lists and isn't of one component."""
    for _ in range(PASSES):
        members, windows = _windows(posts)
        now = members.join(windows.select("key", "window"), ["key", "window"])
        lists = F.bit_count(F.expr("bit_or(shiftleft(1L, cast(shiftright(key, 32) as int)))"))
        often = written(now.groupBy("node").agg(lists.alias("lists")).where(F.col("lists") >= SHARED).select("node"), "often")
        after = written(now.join(often, "node").select("key", "band", "node", "component").distinct(), "open")
        dropped(posts, windows, often)
        posts = after
    return posts


def _long(left: DataFrame, rows: DataFrame, reps: DataFrame, lite: DataFrame, numerator: int, denominator: int) -> DataFrame | None:
    """Links in windows of many members, block by block.

    A block has so many members that their sets, whose sizes the window bounds, take about
    :data:`BLOCK_BYTES`; a task holds two blocks at a time.
    """
    post = F.xxhash64("key", "window").bitwiseAND((1 << 61) - 1).alias("post")
    largest = F.pow(F.lit(denominator / numerator), F.col("window") + 2) * 8 + 200
    blocks = F.ceil(F.col("size") * largest / BLOCK_BYTES).cast("int").alias("blocks")
    left = written(left.select(post, "node", "component", blocks), "long")
    if left.isEmpty():
        return None
    named = written(left.groupBy("node").agg(F.collect_set("post").alias("posts")), "posts")
    sets = _texts(rows, reps, named.select("node")).mapInArrow(_sets, "node long, set binary")
    carried = written(named.join(sets, "node").join(lite, "node"), "carried")
    member = F.struct("node", "component", "n", "sig", "posts", "set")
    dealt = left.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).join(carried, "node")
    members = written(dealt.groupBy("post", "block", "blocks").agg(F.collect_list(member).alias("members")), "blocks")
    ours = members.select("post", "block", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"), F.col("members").alias("left"))
    theirs = members.select("post", F.col("block").alias("other"), F.col("members").alias("right"))
    met = ours.join(theirs, ["post", "other"]).select("post", (F.col("block") == F.col("other")).alias("same"), "left", "right")
    links = written(met.mapInArrow(_across(numerator, denominator), "a long, b long").distinct(), "links")
    dropped(left, named, carried, members)
    return links


def _texts(rows: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Texts of the representatives named, written once as ``node, text``.

    A Bloom filter of their identifiers, of bounded size, keeps most other texts out of the shuffle.
    """
    spark = rows.sparkSession
    named = written(reps.join(nodes.distinct(), "node", "left_semi").select("node", "id", "one", "two"), "named")
    bits = 1 << min((16 * max(named.count(), 64)).bit_length(), MOST_FILTER_BITS.bit_length() - 1)

    def places(ids: pa.Array) -> list[np.ndarray]:
        h = mix(ids.fill_null(-(1 << 62)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), 11)
        return [((h >> U64(s)) & U64(bits - 1)).astype(np.int64) for s in (0, 17, 34)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(places(b.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.int64(1) << (at & 63)))], ["word", "bit"])

    words = named.select("id").mapInArrow(mark, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    table = np.zeros(bits >> 6, dtype=np.uint64)
    if words:
        table[[r.word for r in words]] = np.array([r.bits for r in words], dtype=np.int64).view(np.uint64)
    held = spark.sparkContext.broadcast(table)

    @lean("minhash")
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        for b in batches:
            ok = np.ones(b.num_rows, dtype=bool)
            for p in places(b.column(0)):
                ok &= (t[p >> 6] >> (p & 63).astype(np.uint64) & U64(1)) > 0
            b = b.filter(pa.array(ok))
            for lo, g, first in shingle_sets(b.column(1)):
                n, one, two = _digests(g, first)
                part = pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(n)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), b.column(1).slice(lo, len(n))], ["id", "one", "two", "text"])
                yield part.filter(pa.array(n > 0))

    # the identifier and the set tell which rows a representative stands for; of repeated rows one is enough
    found = rows.mapInArrow(keep, "id long, one long, two long, text string")
    same = (found.one == named.one) & (found.two == named.two) & found.id.eqNullSafe(named.id)
    texts = written(found.join(named, same).groupBy("node").agg(F.first("text").alias("text")), "texts")
    dropped(named)
    return texts
