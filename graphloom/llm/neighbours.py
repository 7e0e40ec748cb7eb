"""The k most similar vectors of every vector, by cosine distance.

Method: additive quantisation. A vector is approximated by a sum of
full-dimensional codewords: the first codebook is a coarse one whose codes form
inverted lists, the others are residual codebooks whose codes are found by beam
search. Rows lie in blocks of neighbouring lists. Within its own block a query scores
the members of its nearest lists through a table of its inner products with all
codewords, and the best of each list are reranked exactly. This first pass only
bounds a query's k-th distance. The second one visits every list of every block
that may hold something as near (distance to the list's centre less its radius)
and compares all its members (a product of 64 components costs less than the table
look-ups), so nothing is missed: the result is that of a full comparison.
Where vectors have no near neighbours the bounds exclude little, and the second
pass comes close to comparing all pairs. There `missing` buys speed: the second
pass then leaves out the lists of other blocks, beyond a query's `probes` nearest, in
which, by the spread of their members, together at most that share of the k neighbours
is expected.

Rules: a row is void unless its embedding has `dimensions` finite components;
of a node's other rows the one with the latest ``updated_at`` counts (ties: the
largest embedding); null nodes are left out; a zero vector has distance 1 to
everything; equal distances (to 12 decimals) go by the smaller node. Copies of
one direction (components over the largest one, in double precision, so exact
multiples agree) share one search and only the k + 1 smallest of them are indexed,
which is all that can be among anyone's k nearest. Directions are not rounded
further, since distances to 12 decimals tell rounded multiples apart; these are
searched one by one. Extra columns are ignored; an
empty table gives an empty result.

Bounds: codebooks are fitted on at most TRAIN_ROWS rows chosen by hash; every row
is indexed. Where the coarse codebook's lists would hold more than LIST_ROWS rows on
average, a second codebook splits each of them into RESIDUAL_WORDS. Lists are packed into groups of about GROUP_ROWS rows, and a group
that holds more (a dense region) into several blocks; none has more than BLOCK_ROWS
rows. Vectors are shuffled once, into their blocks, and written once, a row for each
block. The second pass is a Cartesian product of that table with itself, whose tasks
read the blocks where they lie: nothing is sent to the places where it is compared,
so disk grows with the rows, whatever the number of comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.durable import materialize

TRAIN_ROWS = 65_536
GROUP_ROWS = 16_384
BLOCK_ROWS = 16_384
LIST_ROWS = 1_024
RESIDUAL_BOOKS = 4
RESIDUAL_WORDS = 32
BEAM = 4
#: Members of a list that the first pass reranks exactly, per neighbour asked for.
RERANK = 2
#: Rounding error of squared distances of unit vectors in single precision, with room.
SLACK = 1e-5
#: Rows and queries compared at once where a block can't be searched list by list.
TILE = (1_024, 512)
#: Numbers of parts that a block may have, of blocks told apart when pairs of them are chosen, and of copies that are broadcast.
PARTS = 1_024
TARGETS = 4_096
COPIES = 1_000_000
#: Bytes of floors (16 for each query of a search that may miss something) that are broadcast.
FLOORS = 32_000_000
#: Candidates of a block held before they are cut to the first of each query.
HELD = 2_000_000
SALTS = 64
#: The neighbours of a vector that so many nodes share are sent to these nodes in several portions.
HOT = 50_000


def _nearest(x: np.ndarray, centres: np.ndarray, count: int = 1) -> np.ndarray:
    """Indexes of the `count` nearest centres of each row, nearest first."""
    half = 0.5 * (centres * centres).sum(1)
    out = np.empty((len(x), count), np.int32)
    for at in range(0, len(x), 4096):
        score = x[at : at + 4096] @ centres.T - half
        if count == 1:
            out[at : at + 4096, 0] = score.argmax(1)
        else:
            part = np.argpartition(-score, count - 1, axis=1)[:, :count] if count < score.shape[1] else np.tile(np.arange(count), (len(score), 1))
            order = np.argsort(-np.take_along_axis(score, part, 1), axis=1, kind="stable")
            out[at : at + 4096] = np.take_along_axis(part, order, 1)
    return out


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)[:, 0]
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        used = count > 0
        centres[used] = total[used] / count[used, None]
    return centres


@dataclass
class AdditiveQuantiser:
    coarse: np.ndarray  # lists x dimensions: the centres
    books: np.ndarray  # RESIDUAL_BOOKS x RESIDUAL_WORDS x dimensions
    group_of: np.ndarray  # group of each list
    parents: np.ndarray  # first level, the centres themselves where there is no second one
    split: np.ndarray | None = None  # second level: codewords that every parent is refined by
    freedom: float = 1.0  # number of directions that residuals spread over

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, seed: int = 5) -> AdditiveQuantiser:
        """Codebooks for `rows` unit vectors, of which `sample` is a part."""
        lists = max(1, min(int(2 * rows**0.5), len(sample) // 16))
        parents = coarse = _k_means(sample, lists, 8, seed)
        split = None
        if rows > lists * LIST_ROWS:
            split = _k_means(sample - parents[_nearest(sample, parents)[:, 0]], min(RESIDUAL_WORDS, len(sample)), 6, seed)
            coarse = (parents[:, None, :] + split).reshape(-1, sample.shape[1])
            lists = len(coarse)
        base = cls(coarse, np.zeros((0, RESIDUAL_WORDS, sample.shape[1]), np.float32), np.zeros(lists, np.int32), parents, split)
        residual = sample - coarse[base.own_list(sample)]
        spread = np.linalg.eigvalsh(np.cov(residual.T)) if len(sample) > 1 else np.ones(1)
        freedom = float(max(1.0, spread.sum() ** 2 / max((spread * spread).sum(), 1e-30)))
        rest, books = residual.copy(), []
        for m in range(RESIDUAL_BOOKS):
            book = _k_means(rest, min(RESIDUAL_WORDS, len(rest)), 6, seed + m + 1)
            book = np.concatenate([book, np.zeros((RESIDUAL_WORDS - len(book), sample.shape[1]), np.float32)])
            rest = rest - book[_nearest(rest, book)[:, 0]]
            books.append(book)
        own = cls(coarse, np.stack(books), np.zeros(lists, np.int32), parents, split, freedom)
        for _ in range(2):  # with the codes fixed, the best codebooks together are a least-squares solution
            codes = own._beam(residual)
            flat = codes + np.arange(RESIDUAL_BOOKS) * RESIDUAL_WORDS
            one_hot = np.zeros((len(sample), RESIDUAL_BOOKS * RESIDUAL_WORDS), np.float32)
            np.put_along_axis(one_hot, flat, 1.0, 1)
            gram = one_hot.T @ one_hot + 0.1 * np.eye(one_hot.shape[1], dtype=np.float32)
            own.books = np.linalg.solve(gram, one_hot.T @ residual).reshape(own.books.shape).astype(np.float32)
        groups = max(1, min(lists, round(rows / GROUP_ROWS)))
        if split is None:
            own.group_of = _nearest(coarse, _k_means(coarse, groups, 10, seed))[:, 0]
        else:  # lists of one parent follow each other
            own.group_of = (np.arange(lists) * groups // lists).astype(np.int32)
        return own

    def own_list(self, x: np.ndarray) -> np.ndarray:
        """The list each row belongs to."""
        own = _nearest(x, self.parents)[:, 0]
        if self.split is None:
            return own
        return own * len(self.split) + _nearest(x - self.parents[own], self.split)[:, 0]

    def _beam(self, residual: np.ndarray) -> np.ndarray:
        """Codes of each residual: per codebook the BEAM best partial sums stay."""
        n, dims = residual.shape
        codes = np.empty((n, RESIDUAL_BOOKS), np.int32)
        for at in range(0, n, 8192):
            rest = residual[at : at + 8192][:, None, :]  # rows x beam x dimensions: what is still to be explained
            rows = len(rest)
            path = np.zeros((rows, 1, 0), np.int32)
            for book in self.books:
                width = rest.shape[1]
                energy = (rest * rest).sum(2)[:, :, None] - 2 * (rest.reshape(-1, dims) @ book.T).reshape(rows, width, -1) + (book * book).sum(1)
                flat = energy.reshape(rows, -1)
                keep = min(BEAM, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                order = np.argsort(np.take_along_axis(flat, best, 1), axis=1)
                best = np.take_along_axis(best, order, 1)
                parent, word = best // len(book), best % len(book)
                rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
                path = np.concatenate([np.take_along_axis(path, parent[:, :, None], 1), word[:, :, None].astype(np.int32)], 2)
            codes[at : at + 8192] = path[:, 0]
        return codes

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, residual codes and squared norm of the approximation of each row."""
        own = self.own_list(x)
        codes = self._beam(x - self.coarse[own])
        approximation = self.coarse[own] + sum(self.books[m][codes[:, m]] for m in range(RESIDUAL_BOOKS))
        return own, codes, (approximation * approximation).sum(1)


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; the largest component is taken out first so that nothing overflows."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(blobs: list[bytes], dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float32).reshape(-1, dimensions)


def current_vectors(vectors: DataFrame, dimensions: int) -> DataFrame:
    """``(node_id, embedding)``: the valid row of each node that counts."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.where(F.col("node_id").isNotNull() & (F.size("embedding") == dimensions) & finite)
        .select(F.col("node_id").cast("bigint"), "updated_at", F.col("embedding").cast("array<float>").alias("embedding"))
        .groupBy("node_id")
        .agg(F.max(F.struct("updated_at", "embedding")).alias("v"))
        .select("node_id", "v.embedding")
    )


def _parts(model: AdditiveQuantiser, sample: np.ndarray, rows: int) -> np.ndarray:
    """Number of blocks of each group, by its share of the sample."""
    held = np.bincount(model.group_of[model.own_list(sample)], minlength=int(model.group_of.max()) + 1)
    return np.maximum(np.ceil(held * (rows / len(sample) / BLOCK_ROWS)), 1).astype(np.int64)


def _coder(model: AdditiveQuantiser, dimensions: int, parts: np.ndarray):
    start = np.cumsum(parts) - parts

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            raw = np.ascontiguousarray(np.asarray(batch["embedding"].flatten(), np.float32)).reshape(n, dimensions)
            unit = _unit(raw).astype(np.float32)
            own, codes, norm = model.encode(unit)
            spread = np.sqrt(((unit - model.coarse[own]) ** 2).sum(1))
            group = model.group_of[own]
            mixed = (np.asarray(batch["node_id"]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            small = codes.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(start[group] + mixed.astype(np.int64) % parts[group]),
                    batch["node_id"],
                    batch["query"],
                    pa.array([r.tobytes() for r in raw], pa.binary()),
                    pa.array(own, pa.int32()),
                    pa.array([r.tobytes() for r in small], pa.binary()),
                    pa.array(norm.astype(np.float32)),
                    pa.array(spread.astype(np.float32)),
                ],
                names=["block", "node_id", "query", "vector", "list", "codes", "norm", "spread"],
            )

    return code


_CODED = "block bigint, node_id bigint, query boolean, vector binary, list int, codes binary, norm float, spread float"
#: Of a block's rows, in the order of their lists: ids, vectors, lists, spreads; the positions of the queries among them and
#: their bounds. Of each list: its rows, radius and mean squared spread, and how far its queries reach.
_BLOCKS = (
    "block bigint, ids binary, vectors binary, lists binary, spreads binary, asked binary, bounds binary, "
    "names array<int>, sizes array<int>, radius array<float>, squares array<float>, reach array<float>"
)
_HITS = "query_id bigint, node_id bigint, distance double"


def _reach(bound: np.ndarray) -> np.ndarray:
    """Distance between unit vectors that belongs to a cosine distance, rounded up."""
    return np.sqrt(2 * bound + SLACK)


def _squares(asked: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (asked * asked).sum(1)[:, None] + (centres * centres).sum(1) - 2 * (asked @ centres.T)


def _tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal distribution (an upper bound that is close for z > 0)."""
    x = np.maximum(z, 0.0)
    tail = np.exp(-0.5 * x * x) / (x + np.sqrt(x * x + 8 / np.pi)) * np.sqrt(2 / np.pi)
    return np.where(z > 0, tail, 1.0)


def _exact(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine distances of pairs of vectors, to 12 decimals."""
    out = np.empty(len(asked))
    for at in range(0, len(asked), 65536):
        out[at : at + 65536] = (_unit(rows[at : at + 65536]) * _unit(asked[at : at + 65536])).sum(1)
    return np.maximum(np.round(1.0 - out, 12) + 0.0, 0.0)


def _lower(bound: np.ndarray, q: np.ndarray, distance: np.ndarray, wanted: int) -> None:
    """Queries that have `wanted` rows need none beyond the last of them."""
    full = np.bincount(q, minlength=len(bound)) >= wanted
    last = np.zeros(len(bound))
    np.maximum.at(last, q, distance)
    bound[full] = np.minimum(bound[full], last[full])


def _packer(model: AdditiveQuantiser, dimensions: int, wanted: int, limit: float, probes: int):
    """Rows sorted by block and list into one row for each block; the first pass bounds the distance of its queries."""

    def bounds(raw: np.ndarray, at: np.ndarray, ids: np.ndarray, codes: np.ndarray, norm: np.ndarray, names: np.ndarray, starts: np.ndarray) -> np.ndarray:
        bound = np.full(len(at), limit)
        rows32 = _unit(raw).astype(np.float32)
        asked32 = rows32[at]
        near = _nearest(asked32, model.coarse[names], min(probes, len(names)))
        table = np.einsum("qd,mwd->mqw", asked32, model.books, optimize=True)  # inner products with every residual codeword
        most = RERANK * wanted
        ends = np.append(starts[1:], len(raw))
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def cut() -> None:
            nonlocal best
            q, r = (np.concatenate(c) for c in zip(*held))
            held.clear()
            rough = np.empty(len(q), np.float32)
            for i in range(0, len(q), 65536):
                rough[i : i + 65536] = np.einsum("ij,ij->i", rows32[r[i : i + 65536]], asked32[q[i : i + 65536]])
            open_ = rough >= 1 - SLACK - bound[q]
            # Of the rows in single precision, only those that may be among the first are compared exactly.
            q, r, rough = q[open_], r[open_], rough[open_]
            q, r, _ = _first(q, r, -rough, r, wanted)
            exact = _exact(raw[at[q]], raw[r])
            keep = exact <= bound[q]
            q, r, exact = (np.concatenate(c) for c in zip(best, (q[keep], r[keep], exact[keep])))
            best = _first(q, r, exact, ids[r], wanted)
            _lower(bound, best[0], best[2], wanted)

        for item in range(len(names)):
            who = np.flatnonzero((near == item).any(1))
            own = np.arange(starts[item], ends[item])
            step = max(1, HELD // len(own))
            for i in range(0, len(who), step):
                q = who[i : i + step]
                if len(own) > most:
                    score = np.repeat((asked32[q] @ model.coarse[names[item]])[:, None], len(own), 1)
                    for m in range(RESIDUAL_BOOKS):
                        score += np.take(table[m][q], codes[own, m], axis=1)
                    top = np.argpartition(norm[own] - 2 * score, most - 1, axis=1)[:, :most]
                else:
                    top = np.tile(np.arange(len(own)), (len(q), 1))
                held.append((np.repeat(q, top.shape[1]), own[top.ravel()]))
                if sum(len(h[0]) for h in held) >= HELD:
                    cut()
        if held:
            cut()
        return bound

    def packed(name: int, rows: pa.Table) -> pa.RecordBatch:
        raw, lists = _matrix(rows["vector"].to_pylist(), dimensions), rows["list"].to_numpy()
        ids, spread = rows["node_id"].to_numpy(), rows["spread"].to_numpy()
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(raw), -1)
        at = np.flatnonzero(rows["query"].to_numpy()).astype(np.int32)
        names, starts = np.unique(lists, return_index=True)
        bound = bounds(raw, at, ids, codes, rows["norm"].to_numpy(), names, starts)
        reach = np.full(len(raw), -1.0)
        reach[at] = _reach(bound)
        blobs = [ids.astype(np.int64), raw, lists.astype(np.int32), spread.astype(np.float32), at, bound]
        sizes = np.diff(np.append(starts, len(raw)))
        square = np.add.reduceat(spread.astype(np.float64) ** 2, starts) / sizes
        sides = [names.astype(np.int32), sizes.astype(np.int32), np.maximum.reduceat(spread, starts), square.astype(np.float32), np.maximum.reduceat(reach, starts).astype(np.float32)]
        arrays = [pa.array([name], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs), *(pa.array([x]) for x in sides)]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _BLOCKS.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, part, last = 0, 0, None
        for batch in batches:
            blocks = batch["block"].to_numpy()
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
                if lo < hi and blocks[lo] != last:
                    if held:
                        yield packed(last * PARTS + part, pa.Table.from_batches(held))
                    held, rows, part, last = [], 0, 0, int(blocks[lo])
                while lo < hi:
                    if rows == BLOCK_ROWS:  # larger than the sample had it
                        yield packed(last * PARTS + part, pa.Table.from_batches(held))
                        held, rows, part = [], 0, part + 1
                    some = min(hi - lo, BLOCK_ROWS - rows)
                    held.append(batch.slice(lo, some))
                    rows, lo = rows + some, lo + some
        if held:
            yield packed(last * PARTS + part, pa.Table.from_batches(held))

    return pack


def _expected(squares: np.ndarray, bound: np.ndarray, sizes: np.ndarray, square: np.ndarray, freedom: float) -> np.ndarray:
    """Rows of each list that are expected within each query's bound: the squared distance of a member is taken as normal around |q - centre|^2 + spread^2."""
    squares, square = np.maximum(squares, 1e-9), np.maximum(square, 1e-9)
    return sizes * _tail((squares + square - 2 * bound[:, None]) / (2 * np.sqrt(squares * square / freedom)))


_REACHED = "block bigint, targets array<bigint>, floors binary"


def _widener(model: AdditiveQuantiser, dimensions: int, block: np.ndarray, item: np.ndarray, sizes: np.ndarray, radius: np.ndarray, square: np.ndarray, allowed: float, probes: int):
    """The blocks that may hold something within the reach of a block's queries: by the distance of two lists' centres less their radii.

    If up to `allowed` rows may be missed, also two numbers that tell which lists each
    query visits: those in which more rows are expected than the first (the others
    are those in which together at most `allowed` are expected), and those whose
    centre is no farther than the second, its `probes` nearest lists. `block`, `item`, `sizes`, `radius` and `square`
    tell of every list of every block.
    """

    def floors(row: pa.RecordBatch) -> bytes:
        at = np.frombuffer(row["asked"][0].as_buffer(), np.int32)
        asked32 = _unit(np.frombuffer(row["vectors"][0].as_buffer(), np.float32).reshape(-1, dimensions)[at]).astype(np.float32)
        bound = np.frombuffer(row["bounds"][0].as_buffer(), np.float64)
        out = np.empty((len(at), 2))
        lists = np.unique(item)
        last = min(probes, len(lists)) - 1
        for i in range(0, len(at), 256):
            part = slice(i, i + 256)
            expected = np.sort(_expected(_squares(asked32[part], model.coarse[item]), bound[part], sizes, square, model.freedom), axis=1)
            few = (np.cumsum(expected, axis=1) <= allowed).sum(1)
            out[part, 0] = np.where(few > 0, expected[np.arange(len(few)), np.maximum(few, 1) - 1], -1.0)
            out[part, 1] = np.partition(_squares(asked32[part], model.coarse[lists]), last, axis=1)[:, last] + SLACK
        return out.tobytes()

    order = np.argsort(block, kind="stable")
    block, item, sizes, radius, square = block[order], item[order], sizes[order], radius[order], square[order]
    names, starts = np.unique(block, return_index=True)

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            targets = []
            for lists, own, reach in zip(batch["names"], batch["radius"], batch["reach"]):
                lists, own, reach = (np.asarray(x.values) for x in (lists, own, reach))
                lists, far = lists[reach >= 0], (own + reach)[reach >= 0]
                hit = np.zeros(len(names), bool)
                for at in range(0, len(lists), 256):
                    limit = far[at : at + 256, None] + radius
                    near = _squares(model.coarse[lists[at : at + 256]], model.coarse[item]) <= limit * limit + SLACK
                    hit |= np.logical_or.reduceat(near.any(0), starts)
                targets.append(names[hit])
            least = [floors(batch.slice(i, 1)) if allowed > 0 else None for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch["block"], pa.array(targets, pa.list_(pa.int64())), pa.array(least, pa.binary())], names=["block", "targets", "floors"])

    return widen


def _matcher(model: AdditiveQuantiser, dimensions: int, wanted: int):
    """Best `wanted` rows for the queries of a block in the blocks that it is paired with.

    All lists are searched that a query's bound does not exclude; of another block,
    if something may be missed, only those that `_widener` names.
    """

    def reached(asked32: np.ndarray, bound: np.ndarray, names: np.ndarray, starts: np.ndarray, spread: np.ndarray, first: np.ndarray, floor: np.ndarray | None) -> np.ndarray:
        squares = _squares(asked32, model.coarse[names])
        limit = _reach(bound)[:, None] + np.maximum.reduceat(spread, starts)
        hit = squares <= limit * limit + SLACK
        if floor is not None:
            sizes = np.diff(np.append(starts, len(spread)))
            square = (np.add.reduceat(spread.astype(np.float64) ** 2, starts) / sizes).astype(np.float32)
            hit &= (_expected(squares, first, sizes, square, model.freedom) > floor[:, :1]) | (squares <= floor[:, 1:])
        return hit

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name: int | None = None
        raw, names, asked32, bound, first = (np.zeros(0),) * 5
        floor: np.ndarray | None = None
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def found() -> Iterator[pa.RecordBatch]:
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names[best[0]], best[1], best[2])], names=["query_id", "node_id", "distance"])

        def search(rows: np.ndarray, ids: np.ndarray, lists: np.ndarray, spread: np.ndarray, floor: np.ndarray | None) -> None:
            rows32 = _unit(rows).astype(np.float32)
            items, starts = np.unique(lists, return_index=True)
            ends = np.append(starts[1:], len(rows))
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def cut() -> None:
                """Exact distances of the candidates held; the first of each query stay and lower its bound."""
                nonlocal best
                q, r = (np.concatenate(c) for c in zip(*held))
                held.clear()
                exact = _exact(raw[q], rows[r])
                keep = exact <= bound[q]
                q, r, exact = (np.concatenate(c) for c in zip(best, (q[keep], ids[r[keep]], exact[keep])))
                best = _first(q, r, exact, r, wanted)
                _lower(bound, best[0], best[2], wanted)

            def compare(q: np.ndarray | slice, lo: int, hi: int, place: np.ndarray) -> None:
                near = asked32[q] @ rows32[lo:hi].T >= (1 - SLACK - bound[q]).astype(np.float32)[:, None]
                at = np.flatnonzero(near)
                if len(at):
                    i, j = np.divmod(at, hi - lo)
                    held.append((place[i], lo + j))
                    if sum(len(h[0]) for h in held) >= HELD:
                        cut()

            everyone = np.arange(len(names))
            hit = reached(asked32, bound, items, starts, spread, first, floor)
            if hit.mean() > 0.7:
                for at in range(0, len(everyone), TILE[0]):
                    for lo in range(0, len(rows), TILE[1]):
                        compare(slice(at, at + TILE[0]), lo, min(lo + TILE[1], len(rows)), everyone[at : at + TILE[0]])
            else:
                for lo, hi, column in zip(starts, ends, hit.T):
                    who = np.flatnonzero(column)
                    step = max(1, HELD // (hi - lo))
                    for at in range(0, len(who), step):
                        q = who[at : at + step]
                        compare(q, int(lo), int(hi), q)
            if held:
                cut()

        for batch in batches:
            blob = lambda column, kind, i: np.frombuffer(batch[column][i].as_buffer(), kind)  # noqa: B023, E731
            for i in range(batch.num_rows):
                block = batch["block"][i].as_py()
                if batch["q_block"][i].as_py() != name:
                    yield from found()
                    name = batch["q_block"][i].as_py()
                    at = blob("q_asked", np.int32, i)
                    raw = blob("q_vectors", np.float32, i).reshape(-1, dimensions)[at]
                    names, bound = blob("q_ids", np.int64, i)[at], blob("q_bounds", np.float64, i).copy()
                    first = bound.copy()
                    floor = blob("q_floors", np.float64, i).reshape(-1, 2) if batch["q_floors"][i].is_valid else None
                    asked32 = _unit(raw).astype(np.float32)
                    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                rows = blob("vectors", np.float32, i).reshape(-1, dimensions)
                search(rows, blob("ids", np.int64, i), blob("lists", np.int32, i), blob("spreads", np.float32, i), floor if block != name else None)
        yield from found()

    return match


def _first(q: np.ndarray, r: np.ndarray, d: np.ndarray, tie: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the `count` rows of smallest distance."""
    order = np.lexsort((tie, d, q))
    q, r, d = q[order], r[order], d[order]
    begin = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    keep = rank < count
    return q[keep], r[keep], d[keep]


def _smallest(df: DataFrame, group: list[str], order: list[Column], count: int) -> DataFrame:
    """The first `count` rows of each group with their ``position``; a hot group is cut down salt by salt first."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("node_id"), F.lit(SALTS)))
    some = salted.withColumn("position", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))).where(F.col("position") <= count)
    return some.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("position") <= count).drop("_salt")


def _search(blocks: DataFrame, model: AdditiveQuantiser, dimensions: int, wanted: int, allowed: float, probes: int) -> DataFrame:
    """Hits of the queries of all blocks in all blocks that they may reach; the blocks are read, not shuffled."""
    kinds = {"names": np.int32, "sizes": np.int32, "radius": np.float32, "squares": np.float32}
    known = blocks.select("block", *kinds).collect()  # a few numbers for each list of a block
    lists = [np.concatenate([np.asarray(r[c], kind) for r in known]) for c, kind in kinds.items()]
    step = PARTS * (len(known) // TARGETS + 1)
    block = np.concatenate([np.full(len(r.names), r.block // step, np.int64) for r in known])
    read = blocks.select("block", "names", "radius", "reach", *(["asked", "vectors", "bounds"] if allowed > 0 else []))
    reached = materialize(read.mapInArrow(_widener(model, dimensions, block, *lists, allowed, probes), _REACHED)).where(F.size("targets") > 0)
    if allowed == 0 or (reached.agg(F.sum(F.length("floors"))).first()[0] or 0) <= FLOORS:  # else the blocks are shuffled once
        reached = F.broadcast(reached)  # besides at most TARGETS numbers for each block
    left = blocks.join(reached, "block").select(
        F.col("block").alias("q_block"), "targets", *[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "asked", "bounds", "floors")]
    )
    right = blocks.select("block", "ids", "vectors", "lists", "spreads").hint("shuffle_replicate_nl")
    pairs = left.join(right, F.array_contains("targets", F.floor(F.col("block") / step))).drop("targets")
    return pairs.mapInArrow(_matcher(model, dimensions, wanted), _HITS)


def nearest(
    vectors: DataFrame,
    k: int = 10,
    dimensions: int = 64,
    probes: int = 32,
    within: float | None = None,
    asked: Column | None = None,
    seed: int = 5,
    missing: float = 0.0,
) -> DataFrame:
    """``(query_id, node_id, distance, rank)``: the k nearest other nodes of every node that satisfies `asked`.

    `asked` is a condition on ``node_id`` (default: all nodes). `within` keeps
    neighbours up to that distance only. `probes` lists of each query are visited
    first; further ones follow where they may hold something as near. `missing` is
    the share of the neighbours that may be missed, 0 for an exact result.
    """
    spark = vectors.sparkSession
    zero = F.forall("embedding", lambda v: v == 0)
    largest = F.nullif(F.array_max(F.transform("embedding", F.abs)).cast("double"), F.lit(0.0))
    direction = F.transform("embedding", lambda v: v / F.col("largest"))
    valid = materialize(
        current_vectors(vectors, dimensions)
        .withColumn("largest", largest)
        .select("node_id", "embedding", zero.alias("zero"), F.xxhash64(direction).alias("h1"), F.xxhash64(F.lit(seed), F.reverse(direction)).alias("h2"))
    )
    wants = F.coalesce(asked, F.lit(False)) if asked is not None else F.lit(True)
    proper = valid.where("NOT zero")
    members = proper.select("node_id", "h1", "h2", wants.alias("wanted"))
    # Copies: one search per distinct direction, named by its smallest node.
    classes = members.groupBy("h1", "h2").agg(F.min("node_id").alias("class_id"), F.max("wanted").alias("query"), F.count(F.lit(1)).alias("n"))
    shared = members.select("node_id", "h1", "h2").join(classes.where("n > 1"), ["h1", "h2"])
    leading = _smallest(shared, ["h1", "h2"], [F.col("node_id")], k + 1).select("node_id", (F.col("query") & (F.col("node_id") == F.col("class_id"))).alias("leads"))
    copies = materialize(shared.select("node_id").join(leading, "node_id", "left"))
    if copies.count() <= COPIES:  # else the vectors are shuffled once more
        copies = F.broadcast(copies)
    base = (
        proper.join(copies.select("node_id", "leads", F.lit(True).alias("copy")), "node_id", "left")
        .where("copy IS NULL OR leads IS NOT NULL")
        .select("node_id", F.coalesce("leads", wants).alias("query"), "embedding")
    )
    rows = proper.count()
    share = min(1.0, 1.1 * TRAIN_ROWS / max(rows, 1))
    few = min(TRAIN_ROWS, max(2048, 32 * int(2 * rows**0.5)))
    share = min(share, 1.1 * few / max(rows, 1))
    bar = int((share - 0.5) * 2**64 * 0.999999999) if share < 1 else None
    drawn = proper.where(F.xxhash64("node_id", F.lit(seed)) <= bar) if bar is not None else proper
    sample = [r.embedding for r in drawn.select("embedding").limit(few).collect()]
    found = None
    if sample:
        unit = _unit(np.array(sample, np.float32)).astype(np.float32)
        model = AdditiveQuantiser.fit(unit, rows)
        limit = 2.0 if within is None else min(float(within), 2.0)
        coded = base.mapInArrow(_coder(model, dimensions, _parts(model, unit, rows)), _CODED)
        sorted_ = coded.repartition("block").sortWithinPartitions("block", "list")
        blocks = materialize(sorted_.mapInArrow(_packer(model, dimensions, k + 1, limit, probes), _BLOCKS))
        found = _search(blocks, model, dimensions, k + 1, missing * k, probes)
    if within is None or within >= 1:
        found = _with_zeros(spark, valid, classes, found, k)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, node_id bigint, distance double, rank int")
    order = [F.col("distance"), F.col("node_id")]
    # At most k + 1 rows per block that a query is compared with.
    best = found.withColumn("_at", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_at") <= k + 1).drop("_at")
    named = members.where("wanted").join(classes.where("query"), ["h1", "h2"]).select(F.col("node_id").alias("own_id"), "class_id")
    if within is None or within >= 1:
        own = valid.where("zero").select(F.col("node_id").alias("own_id"), wants.alias("wanted")).where("wanted")
        named = named.unionByName(own.select("own_id", F.col("own_id").alias("class_id")))
    # A vector that very many nodes share is one key: its few neighbours are repeated, its nodes spread.
    named, best = materialize(named), materialize(best)
    portions = (F.floor(F.col("n") / HOT) + 1).cast("int").alias("portions")
    hot = named.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("class_id", portions)
    hot = F.broadcast(materialize(hot))  # one row for every HOT nodes at most
    named = named.join(hot, "class_id", "left").withColumn("_salt", F.pmod(F.xxhash64("own_id"), F.coalesce("portions", F.lit(1))).cast("int")).drop("portions")
    best = best.join(hot.withColumnRenamed("class_id", "query_id"), "query_id", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("portions", F.lit(1)) - 1)))
    full = best.drop("portions").join(named, (best["query_id"] == named["class_id"]) & (best["_salt"] == named["_salt"])).where(F.col("own_id") != F.col("node_id"))
    ranked = full.withColumn("rank", F.row_number().over(Window.partitionBy("own_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("own_id").alias("query_id"), "node_id", "distance", "rank")


def _with_zeros(spark, valid: DataFrame, classes: DataFrame, found: DataFrame | None, k: int) -> DataFrame:
    """Zero vectors: at distance 1 from everything, so only the k + 1 smallest nodes of either kind matter."""
    # Both sides hold at most k + 1 rows.
    zeros = F.broadcast(valid.where("zero").select("node_id").orderBy("node_id").limit(k + 1))
    firsts = F.broadcast(valid.select("node_id").orderBy("node_id").limit(k + 1))
    far = classes.where("query").select(F.col("class_id").alias("query_id")).crossJoin(zeros)
    near = valid.where("zero").select(F.col("node_id").alias("query_id")).crossJoin(firsts)
    extra = far.unionByName(near).withColumn("distance", F.lit(1.0)).select("query_id", "node_id", "distance")
    return extra if found is None else found.unionByName(extra)


def close_pairs(vectors: DataFrame, k: int = 10, within: float = 0.1, dimensions: int = 64, probes: int = 8) -> DataFrame:
    """``(node_a, node_b)``, node_a < node_b: one is among the other's k nearest, at most `within` away."""
    near = nearest(vectors, k, dimensions, probes, within)
    return near.select(F.least("query_id", "node_id").alias("node_a"), F.greatest("query_id", "node_id").alias("node_b")).distinct()
