"""Most similar vectors for every vector, by a permutation index.

A vector is represented by the order of its nearest pivots, which are a bounded sample of the vectors themselves, so dense
regions get more of them. Each vector is posted in the inverted files of its first ``POSTED`` pivots, and two vectors meet
if they share two of those: in the file of the lesser one, where they are ranked by the footrule distance of their first
``PREFIX`` pivots. Those within its reach are compared by a rounded cosine that travels with the posting, with a proven
bound on its error, and what is left by the exact one. A vector that meets more than ``SHORTLIST`` such partners lies in a
crowd, where the order of pivots tells too little: crowds are covered by leaders, and every vector near a leader is
compared with all that can be similar to it. Equal directions are one class from the start; a class takes part once and
its members share what it finds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.codepoints import mixed
from quern.sources.tables import arrow_mapped, broadcast_if_bounded, stage_table

#: In the files of how many pivots a vector is posted, and how many count for the footrule distance.
POSTED, PREFIX = 7, 12
#: Partners up to which a vector's candidates are those it meets; with more of them it is compared exactly, see _crowded_pairs.
SHORTLIST = 24
#: Pivots: four times the root of the number of vectors, so that files stay as long whatever that is; within these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 64, 65_535
#: Vectors with which the reach of the footrule distance is fitted, and the share of true pairs it must keep.
_FITTED, _KEPT = 512, 0.998
#: Files with more postings are split into blocks of so many, and the pairs of blocks are spread over tasks.
FILE_ROWS = 4096
_PAIRS = 1 << 21  # footrule distances at once
_DOTS = 1 << 17  # rounded cosines at once
#: Every crowded vector has a leader with at least this cosine; leaders are chosen from so many crowded vectors at a time.
_COVER, _DRAWN = 0.85, 4096
#: Vectors of a leader that one task compares at once, with how many others at once, and pairs kept of each beyond k: float32
#: is off by less than _SINGLE.
ASKED, _OTHERS, _SPARE, _SINGLE = 8192, 1024, 3, 1e-5


def _unit_vectors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(id, class, vec) of (id, embedding) with a direction; repeated rows of a batch once."""
    import xxhash

    for batch in batches:
        column = batch.column(1)
        ok = np.flatnonzero((column.is_valid().to_numpy(zero_copy_only=False)) & (column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == width))
        if not len(ok):
            continue
        values = column.take(pa.array(ok)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
        norm = np.sqrt((values * values).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        ok, unit = ok[good], (values[good] / norm[good, None]).astype(np.float32)
        # Multiples of a vector differ in the last bits; a grid of 2^-18 makes them one class.
        grid = np.round(unit.astype(np.float64) * (1 << 18)).astype(np.int32)
        ids = batch.column(0).take(pa.array(ok)).to_pylist()
        classes = [xxhash.xxh3_64_intdigest(g.tobytes()) for g in grid]
        once = list(dict.fromkeys(zip(ids, classes)))
        first: dict[tuple, int] = {}
        for n, pair in enumerate(zip(ids, classes)):
            first.setdefault(pair, n)
        rows = [first[p] for p in once if p[0] is not None]
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[r] for r in rows], batch.schema.field(0).type), pa.array(np.array([classes[r] for r in rows], np.uint64).view(np.int64)), pa.array([unit[r].tobytes() for r in rows], pa.binary())],
            ["id", "class", "vec"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0].as_py()) // 4
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def prefixes(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first; equally near ones by number."""
    n = min(PREFIX, len(pivots))
    out = np.empty((len(vectors), n), np.uint16)
    step = max(16, (1 << 22) // len(pivots))
    for a in range(0, len(vectors), step):
        near = -(vectors[a : a + step] @ pivots.T)
        some = np.argpartition(near, n - 1, axis=1)[:, :n] if n < len(pivots) else np.broadcast_to(np.arange(n), (len(near), n))
        some = np.sort(some, axis=1)
        out[a : a + step] = np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)
    return out


def footrule(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The footrule distance of prefixes, row by row; a pivot that is not in a prefix counts as standing right after it."""
    n = one.shape[1]
    shared = np.zeros(len(one), np.int16)
    columns = [np.ascontiguousarray(two[:, j]) for j in range(n)]
    for i in range(n):
        own = np.ascontiguousarray(one[:, i])
        for j in range(n):
            shared += (own == columns[j]) * np.int16(n - max(i, j))
    return n * (n + 1) - 2 * shared


def fitted_reach(sample: np.ndarray, pivots: np.ndarray, similarity: float) -> int:
    """The footrule distance within which the share _KEPT of pairs with this cosine lies: measured on vectors of the
    sample, each with one turned from it by that angle in a random direction."""
    rng = np.random.default_rng(7)
    many = np.repeat(sample, max(1, 2000 // max(1, len(sample))), axis=0).astype(np.float64)
    side = rng.standard_normal(many.shape)
    side -= (side * many).sum(1, keepdims=True) * many
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    turned = similarity * many + math.sqrt(max(0.0, 1 - similarity**2)) * side
    found = footrule(prefixes(many.astype(np.float32), pivots), prefixes(turned.astype(np.float32), pivots))
    return int(np.quantile(found, _KEPT)) if len(found) else PREFIX * (PREFIX + 1)


#: A posting: the order of its pivots, the vector in half precision, and by how much that is off (see _error_bound).
def _layout(width: int, prefix: int) -> np.dtype:
    return np.dtype([("order", np.uint16, prefix), ("half", np.float16, width), ("error", np.float32)])


def _error_bound(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How far the product of two rounded unit vectors can be from that of the vectors, by the lengths of what rounding took
    from each: |<u,v> - <u',v'>| = |<u-u',v'> + <u',v-v'> + <u-u',v-v'>|, where u' is at most 1 + |u-u'| long. The last term
    is for the float32 sum."""
    return one * (1 + two) + two * (1 + one) + one * two + np.float32(1e-5)


def _permutations(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(class, posting) of (class, vec)."""
    for batch in batches:
        if batch.num_rows:
            vectors = _matrix(batch.column(1))
            made = np.zeros(len(vectors), _layout(vectors.shape[1], min(PREFIX, len(pivots))))
            made["order"], made["half"] = prefixes(vectors, pivots), vectors
            made["error"] = np.linalg.norm(vectors.astype(np.float64) - made["half"].astype(np.float64), axis=1) * 1.000001 + 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in made], pa.binary())], ["class", "posting"])


def _orders(column: pa.Array, prefix: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.ascontiguousarray(packed[:, : 2 * prefix]).view(np.uint16)


def _files(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, files): every vector in the files of its first pivots, but for the greatest of them, which nothing follows."""
    posted = np.sort(order[:, :POSTED], axis=1)
    posted = posted[:, :-1] if posted.shape[1] > 1 else posted
    return np.repeat(np.arange(len(order)), posted.shape[1]), posted.ravel().astype(np.int64)


def _file_sizes(batches: Iterator[pa.RecordBatch], prefix: int, pivots: int) -> Iterator[pa.RecordBatch]:
    sizes = np.zeros(pivots, np.int64)
    for batch in batches:
        if batch.num_rows:
            sizes += np.bincount(_files(_orders(batch.column(0), prefix))[1], minlength=pivots)
    file = np.flatnonzero(sizes)
    yield pa.RecordBatch.from_arrays([pa.array(file), pa.array(sizes[file])], ["file", "n"])


def _postings(batches: Iterator[pa.RecordBatch], prefix: int, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cell, file, side, class, posting): a row for each file of a vector. A long file is cut into blocks by class, each
    pair of which is a cell of its own with sides 0 and 1, or 2 within a block, so that no pair of vectors is lost and no
    cell has more than two blocks."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            row, file = _files(_orders(part.column(1), prefix))
            many = blocks[file]
            own = (mixed(part.column(0).to_numpy().view(np.uint64)[row] ^ file.astype(np.uint64)) % many.astype(np.uint64)).astype(np.int64)
            other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row, file, own = (np.repeat(x, many) for x in (row, file, own))
            low, high = np.minimum(own, other), np.maximum(own, other)
            cell = mixed(mixed(file.astype(np.uint64)) ^ (low << 32 | high).astype(np.uint64)).view(np.int64)
            side = np.where(own == other, 2, np.where(own < other, 0, 1)).astype(np.int8)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(file.astype(np.int32)), pa.array(side), part.column(0).take(rows), part.column(1).take(rows)], ["cell", "file", "side", "class", "posting"]
            )


def _first_shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The two least pivots that stand in both rows of posted pivots, row by row."""
    both = (one[:, :, None] == two[:, None, :]).any(2)
    return np.sort(np.where(both, one, np.iinfo(np.int64).max), axis=1)[:, :2]


def _ranked(batches: Iterator[pa.RecordBatch], reach: int, prefix: int, width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b, d, low, high): of postings sorted by cell, each vector's partners within reach with the bounds of their cosine;
    all of them, or one more than SHORTLIST. A pair comes from the one file and second pivot that are the least it shares."""
    layout = _layout(width, prefix)

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, file, side, cls = (table[c].to_numpy() for c in ("cell", "file", "side", "class"))
        posting = np.frombuffer(b"".join(table["posting"].to_pylist()), layout)
        order, half, error = posting["order"], posting["half"].astype(np.float32), posting["error"]
        posted = order[:, :POSTED].astype(np.int64)
        # Every row under each second pivot that is greater than the file's.
        row, place = np.nonzero(posted > file[:, None]) if posted.shape[1] > 1 else (np.arange(len(file)), np.zeros(len(file), np.int64))
        second = posted[row, place]
        by = np.lexsort((second, cell[row]))
        row, second = row[by], second[by]
        if not len(row):
            return
        new = np.append(True, (cell[row][1:] != cell[row][:-1]) | (second[1:] != second[:-1]))
        first = np.flatnonzero(new)
        end = np.repeat(np.append(first[1:], len(row)), np.diff(np.append(first, len(row))))
        partners = end - np.arange(len(row)) - 1
        before = np.concatenate([[0], np.cumsum(partners)])
        at = 0
        while at < len(row):
            stop = max(at + 1, int(np.searchsorted(before, before[at] + _PAIRS, side="right")) - 1)
            n = partners[at:stop]
            i = np.repeat(np.arange(at, stop), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(before[at:stop] - before[at], n)
            at, pivot = stop, second[i]
            a, b = row[i], row[j]
            meet = ((side[a] == 2) | (side[a] != side[b])) & (cls[a] != cls[b])
            a, b, pivot = a[meet], b[meet], pivot[meet]
            d = footrule(order[a], order[b])
            near = d <= reach
            a, b, d, pivot = a[near], b[near], d[near], pivot[near]
            dots = [np.einsum("ij,ij->i", half[a[i : i + _DOTS]], half[b[i : i + _DOTS]]) for i in range(0, len(a), _DOTS)]
            dot, bound = np.concatenate(dots) if dots else np.zeros(0, np.float32), _error_bound(error[a], error[b])
            like = dot + bound >= similarity
            a, b, d, pivot, dot, bound = (x[like] for x in (a, b, d, pivot, dot, bound))
            if posted.shape[1] > 1:
                shared = _first_shared(posted[a], posted[b])
                once = (shared[:, 0] == file[a]) & (shared[:, 1] == pivot)
                a, b, d, dot, bound = (x[once] for x in (a, b, d, dot, bound))
            if not len(a):
                continue
            one, two = np.concatenate([cls[a], cls[b]]), np.concatenate([cls[b], cls[a]])
            d, low, high = np.concatenate([d, d]), np.concatenate([dot - bound] * 2), np.concatenate([dot + bound] * 2)
            o = np.lexsort((two, d, one))
            one = one[o]
            starts = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
            top = np.arange(len(one)) - np.repeat(starts, np.diff(np.append(starts, len(one)))) <= SHORTLIST
            o = o[top]
            yield pa.RecordBatch.from_arrays([pa.array(one[top]), pa.array(two[o]), pa.array(d[o].astype(np.int32)), pa.array(low[o]), pa.array(high[o])], ["a", "b", "d", "low", "high"])

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        table = pa.Table.from_batches(kept)
        cell = table["cell"].to_numpy()
        # The last cell may go on in the next batch.
        last = int(np.argmax(cell == cell[-1])) if len(cell) else 0
        if last:
            yield from pairs(table.slice(0, last))
            kept = table.slice(last).combine_chunks().to_batches()
    if kept:
        yield from pairs(pa.Table.from_batches(kept))


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = (_matrix(batch.column(k)).astype(np.float64) for k in (2, 3))
        found = (one * two).sum(1) / np.sqrt((one * one).sum(1) * (two * two).sum(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["a", "b", "similarity"])


def _uncovered(batches: Iterator[pa.RecordBatch], leaders: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            vectors, step = _matrix(batch.column(1)), max(1, (1 << 24) // len(leaders))
            best = [(vectors[a : a + step] @ leaders.T).max(1) for a in range(0, len(vectors), step)]
            yield batch.filter(pa.array(np.concatenate(best) < _COVER))


def _drawn(df: DataFrame, n: int, wanted: int) -> list[bytes]:
    """The vectors of about ``wanted`` of the ``n`` rows of (class, vec), or somewhat more, the same whatever the partitions
    are: those whose hash lies under a threshold, in its order. No partition sends others."""
    share = min(1.0, (wanted * 1.1 + 8 * math.sqrt(wanted) + 16) / max(1, n))
    mark = F.xxhash64(F.lit(0), "class")
    some = df.where(mark < int((share * 2 - 1) * 2**63)) if share < 1 else df
    return [bytes(r["vec"]) for r in sorted(some.select(mark.alias("mark"), "class", "vec").collect(), key=lambda r: (r["mark"], r["class"]))]


def _leaders(crowded: DataFrame) -> np.ndarray:
    """Some of (class, vec), so that each has one with a cosine of at least _COVER; an empty array of none. Their number is
    that of the crowds, not of their members."""
    sc = crowded.sparkSession.sparkContext
    chosen: list[np.ndarray] = []
    rest, n = crowded, crowded.count()
    while n:
        drawn = _drawn(rest, n, _DRAWN)
        sample = np.frombuffer(b"".join(drawn), np.float32).reshape(len(drawn), -1)
        while len(sample):
            chosen.append(sample[0])
            sample = sample[1:][sample[1:] @ sample[0] < _COVER]
        if drawn:
            sent = sc.broadcast(np.array(chosen))
            rest = arrow_mapped(crowded, lambda b, sent=sent: _uncovered(b, sent.value), "class long, vec binary")
        n = rest.count()
    return np.array(chosen)


def _cells(batches: Iterator[pa.RecordBatch], leaders: np.ndarray, ring: float) -> Iterator[pa.RecordBatch]:
    """(leader, class, vec, asks): each vector near a leader asks in the cell of the nearest, and answers in every cell whose
    leader has at least the cosine ``ring`` to it."""
    for batch in batches:
        step = max(1, (1 << 24) // len(leaders))
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            near = _matrix(part.column(1)) @ leaders.T
            own = near.argmax(1)
            asking = np.flatnonzero(near[np.arange(len(own)), own] >= _COVER)
            row, cell = np.nonzero(near >= ring)
            rows = pa.array(np.concatenate([asking, row]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([own[asking], cell]).astype(np.int32)), part.column(0).take(rows), part.column(1).take(rows), pa.array(np.arange(len(rows)) < len(asking))], ["leader", "class", "vec", "asks"]
            )


def _answered(batches: Iterator[pa.RecordBatch], most: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b): for each vector that asks, the ``most`` best of those that answer; rows are sorted by cell, asking ones first."""
    cell, asked, ids = None, [], []
    vectors = classes = scores = best = None

    def gathered() -> None:
        nonlocal vectors, classes, scores, best
        classes = np.concatenate(ids)
        by = np.argsort(classes)
        vectors, classes = np.concatenate(asked)[by], classes[by]
        scores, best = np.full((len(classes), most), -2, np.float32), np.zeros((len(classes), most), np.int64)

    def answers(other: np.ndarray, named: np.ndarray) -> None:
        found = vectors @ other.T
        at = np.minimum(np.searchsorted(classes, named), len(classes) - 1)
        own = np.flatnonzero(classes[at] == named)
        found[at[own], own] = -2
        rows = np.flatnonzero((found > np.maximum(scores.min(1), similarity - _SINGLE)[:, None]).any(1))
        every, names = np.concatenate([scores[rows], found[rows]], 1), np.concatenate([best[rows], np.broadcast_to(named, (len(rows), len(named)))], 1)
        top = np.argpartition(-every, most - 1, axis=1)[:, :most]
        scores[rows], best[rows] = np.take_along_axis(every, top, 1), np.take_along_axis(names, top, 1)

    def result() -> Iterator[pa.RecordBatch]:
        if scores is not None:
            row, place = np.nonzero(scores >= similarity - _SINGLE)
            yield pa.RecordBatch.from_arrays([pa.array(classes[row]), pa.array(best[row, place])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        every, cells, asks, named = _matrix(batch.column(2)), batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        edges = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])))
        for a, end in zip(edges, np.append(edges[1:], len(cells))):
            if cells[a] != cell:
                yield from result()
                cell, asked, ids, scores = cells[a], [], [], None
            if asks[a]:
                asked.append(every[a:end])
                ids.append(named[a:end])
                continue
            if scores is None and asked:
                gathered()
            for n in range(a, end, _OTHERS) if asked else ():
                answers(every[n : min(end, n + _OTHERS)], named[n : min(end, n + _OTHERS)])
    yield from result()


def _crowded_pairs(vectors: DataFrame, crowded: DataFrame, k: int, similarity: float) -> DataFrame | None:
    """(a, b): for every vector with a cosine of at least _COVER to a leader of the crowds, all its k most similar others,
    none of them left out: what is similar to it lies, by the angles, within their sum of its leader. None without crowds."""
    leaders = _leaders(crowded)
    if not len(leaders):
        return None
    ring = math.cos(min(math.pi, math.acos(_COVER) + math.acos(similarity) + 1e-3))
    sent = vectors.sparkSession.sparkContext.broadcast(leaders)
    cells = stage_table(arrow_mapped(vectors.select("class", "vec"), lambda b: _cells(b, sent.value, ring), "leader int, class long, vec binary, asks boolean"), "cells")
    blocks = cells.where("asks").groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("blocks"))
    block = F.when(F.col("asks"), F.array(F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = cells.join(broadcast_if_bounded(blocks), "leader").select("leader", F.explode(block).alias("block"), "class", "vec", "asks")
    keyed = spread.select((F.col("leader").cast("long") * (1 << 31) + F.col("block")).alias("cell"), "class", "vec", "asks")
    sorted_cells = keyed.repartition("cell").sortWithinPartitions("cell", F.desc("asks"))
    return arrow_mapped(sorted_cells, lambda b: _answered(b, k + _SPARE, similarity), "a long, b long")


def direction_classes(df: DataFrame, key: str, embedding: str, width: int) -> DataFrame:
    """(id, class, vec): the rows that have a direction. Rows with a null id or an embedding that is null, all zero, not
    ``width`` wide or holds a null, NaN or infinity take no part."""
    kind = df.schema[key].dataType.simpleString()
    return arrow_mapped(df.select(F.col(key).alias("id"), F.col(embedding).alias("e")), lambda b: _unit_vectors(b, width), f"id {kind}, class long, vec binary")


def class_neighbours(vectors: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b, similarity): for each class of (class, vec) up to k others with at least this cosine, best first found.

    ``vectors`` is read several times: it should be staged."""
    spark = vectors.sparkSession
    n = vectors.count()
    if not n:
        return vectors.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(0.0).alias("similarity"))
    pivots_wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, 4 * math.isqrt(n)))
    sample = _drawn(vectors, n, pivots_wanted + _FITTED)[: pivots_wanted + _FITTED]
    drawn = np.frombuffer(b"".join(sample), np.float32).reshape(len(sample), -1)
    held = min(_FITTED, len(drawn) // 4)
    pivots, fitted = drawn[: len(drawn) - held], drawn[len(drawn) - held :]
    reach = fitted_reach(fitted, pivots, similarity)
    sent, prefix, width = spark.sparkContext.broadcast(pivots), min(PREFIX, len(pivots)), drawn.shape[1]

    permuted = stage_table(arrow_mapped(vectors.select("class", "vec"), lambda b: _permutations(b, sent.value), "class long, posting binary"), "permutations")
    # A row for each pivot at most.
    sizes = arrow_mapped(permuted.select("posting"), lambda b: _file_sizes(b, prefix, len(pivots)), "file long, n long").groupBy("file").agg(F.sum("n").alias("n")).collect()
    blocks = np.ones(len(pivots), np.int64)
    for r in sizes:
        blocks[r["file"]] = -(-r["n"] // FILE_ROWS)
    cut = spark.sparkContext.broadcast(blocks)
    postings = arrow_mapped(permuted, lambda b: _postings(b, prefix, cut.value), "cell long, file int, side byte, class long, posting binary")
    # The number of partitions follows the postings, so that they stay of one size; AQE joins small ones.
    met = arrow_mapped(postings.repartition("cell").sortWithinPartitions("cell"), lambda b: _ranked(b, reach, prefix, width, similarity), "a long, b long, d int, low float, high float")
    best, surest = Window.partitionBy("a").orderBy("d", "b"), Window.partitionBy("a").orderBy(F.desc("low"), "b")
    listed = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= SHORTLIST + 1)
    # Of a list, those count whose cosine can be among the k best; the mark is on the row that has the k-th surest.
    listed = listed.withColumn("crowded", F.max("rank").over(Window.partitionBy("a")) > SHORTLIST)
    listed = listed.withColumn("sure", F.nth_value("low", k).over(surest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    listed = stage_table(listed.where(F.when(F.col("crowded"), F.col("rank") == 1).otherwise(F.coalesce(F.col("high") >= F.col("sure"), F.lit(True)))).select("a", "b", "crowded"), "listed")
    # The list of a crowded vector is not whole: all of its similar ones are looked for.
    crowded = stage_table(vectors.join(listed.where("crowded").select(F.col("a").alias("class")), "class", "left_semi").select("class", "vec"), "crowded")
    candidates = listed.where("not crowded").select("a", "b")
    exact = _crowded_pairs(vectors, crowded, k, similarity)
    if exact is not None:
        candidates = candidates.unionByName(exact)
    # A pair counts for both of its ends, whichever had it in its list.
    once = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one, two = vectors.select(F.col("class").alias("a"), F.col("vec").alias("va")), vectors.select(F.col("class").alias("b"), F.col("vec").alias("vb"))
    scored = arrow_mapped(once.join(one, "a").join(two, "b").select("a", "b", "va", "vb"), _cosines, "a long, b long, similarity double").where(F.col("similarity") >= similarity)
    both = scored.select(F.explode(F.array(F.struct("a", "b", "similarity"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))).alias("p")).select("p.*")
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return both.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")


def similar_pairs(df: DataFrame, key: str = "chunk_id", embedding: str = "embedding", width: int = 64, k: int = 5, similarity: float = 0.9) -> DataFrame:
    """(key_a, key_b), a < b, distinct: pairs with a cosine of at least ``similarity`` of which at least one is among the
    other's k most similar, as the index finds them (its recall is measured in the tests and the README).

    Rows of equal direction (up to 2^-18 a coordinate) are one class: of members equally similar the least keys come
    first, so a class of any size gives at most k pairs a member. Repeated rows of a key count once; should a key have
    several directions, each counts. Rows without a direction take no part, see direction_classes. No step holds more of
    a class than its first k + 1 members.
    """
    every = direction_classes(df, key, embedding, width)
    rows, vectors = stage_table(every.select("id", "class"), "directions"), stage_table(every.groupBy("class").agg(F.min("vec").alias("vec")), "vectors")
    by_id = Window.partitionBy("class").orderBy("id")
    # First k + 1 members; the limit goes below the shuffle.
    first = rows.select("class", "id").withColumn("__r", F.dense_rank().over(by_id)).where(F.col("__r") <= k + 1)
    firsts = first.groupBy("class").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    # Within a class: every member with the first others.
    several = firsts.where(F.size("ids") > 1)
    within = rows.select("class", "id").join(several, "class").select("id", F.explode(F.slice(F.filter("ids", lambda i: i != F.col("id")), 1, k)).alias("other"))
    # Between classes: members have places left only in classes of at most k.
    near = class_neighbours(vectors, k, similarity)
    left = firsts.where(F.size("ids") <= k).select(F.col("class").alias("a"), F.col("ids").alias("own"))
    right = firsts.select(F.col("class").alias("b"), F.slice("ids", 1, k).alias("theirs"))
    found = near.join(left, "a").join(right, "b").groupBy("a", "own").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "theirs"))).alias("near"))
    ranked = F.flatten(F.transform("near", lambda x: x["theirs"]))
    between = found.select("own", F.slice(ranked, F.lit(1), F.lit(k + 1) - F.size("own")).alias("others")).select(F.explode("own").alias("id"), "others").select("id", F.explode("others").alias("other"))
    pairs = within.unionByName(between).where(F.col("id") != F.col("other"))
    return pairs.select(F.least("id", "other").alias(f"{key}_a"), F.greatest("id", "other").alias(f"{key}_b")).distinct()
