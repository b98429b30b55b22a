"""The permutation index against brute force, with copies, hot files and rows without a direction."""

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import neighbours
from quern.llm.neighbours import PREFIX, footrule, prefixes, similar_pairs

SCHEMA = "chunk_id string, embedding array<float>, chunk_id_a string, class int"


def brute(rows, k=5, least=0.9):
    ids = [i for i, _ in rows]
    v = np.array([e for _, e in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k]:
            if s[i, j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def made(seed, groups, each, noise):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, 64))
    rows = np.repeat(centres, each, axis=0) + noise * rng.standard_normal((groups * each, 64))
    return [(f"k{n:05d}", [float(np.float32(x)) for x in row * rng.uniform(0.1, 40)]) for n, row in enumerate(rows)]


def test_footrule():
    pivots = np.eye(20, dtype=np.float32)
    order = prefixes(np.arange(40, dtype=np.float32).reshape(2, 20)[::-1].copy(), pivots)
    assert order.shape == (2, PREFIX) and order[0].tolist() == list(range(19, 19 - PREFIX, -1))
    a, b = np.arange(PREFIX, dtype=np.uint16)[None], np.arange(100, 100 + PREFIX, dtype=np.uint16)[None]
    assert footrule(a, a)[0] == 0 and footrule(a, b)[0] == PREFIX * (PREFIX + 1)
    assert footrule(a, a[:, [1, 0, *range(2, PREFIX)]])[0] == 2


@pytest.mark.parametrize("file_rows", [4096, 16])
def test_recall(spark, monkeypatch, file_rows):
    monkeypatch.setattr(neighbours, "FILE_ROWS", file_rows)
    rows = made(1, 60, 7, 0.25) + [(f"x{i}", e) for i, e in made(2, 700, 1, 0.0)]
    df = spark.createDataFrame([(*r, "", 1) for r in rows + rows[:50]], SCHEMA).repartition(6)
    want, found = brute(rows), list(map(tuple, similar_pairs(df).collect()))
    assert len(found) == len(set(found))
    assert len(want) > 500 and len(want & set(found)) >= 0.97 * len(want)
    assert len(set(found) - want) <= 0.01 * len(want)


def test_repeated_meetings_do_not_crowd_out(spark):
    """Few vectors in large tight groups meet in many files at once, all in one task."""
    rows = made(4, 40, 14, 0.2) + [(f"y{i}", e) for i, e in made(5, 300, 1, 0.0)]
    df = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA).coalesce(1)
    want, found = brute(rows), set(map(tuple, similar_pairs(df).collect()))
    assert len(want & found) >= 0.97 * len(want)


@pytest.mark.parametrize("asked", [8192, 64])
def test_crowds_are_whole(spark, monkeypatch, asked):
    """Groups with many more partners than a list holds, one of them a third of all rows, and one a tight ball."""
    monkeypatch.setattr(neighbours, "ASKED", asked)
    groups = [made(6, 4, 50, 0.2), made(7, 1, 700, 0.2), made(8, 1, 300, 0.3), made(9, 1, 200, 0.02), made(10, 700, 1, 0.0)]
    rows = [(f"{n}{i}", e) for n, g in enumerate(groups) for i, e in g]
    df = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA).repartition(4)
    want, found = brute(rows), set(map(tuple, similar_pairs(df).collect()))
    for n in range(4):
        own = {p for p in want if p[0][0] == str(n)}
        assert len(own) > 400 and len(own & found) >= 0.998 * len(own)
    assert len(found - want) <= 0.002 * len(want)


def test_copies_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    v = [float(x) for x in rng.standard_normal(64).astype(np.float32)]
    copies = [(f"c{n:04d}", [x * (1 + n % 3) for x in v]) for n in range(400)]
    odd = [("n1", None), ("n2", [0.0] * 64), ("n3", [float("nan")] * 64), ("n4", v[:10]), ("n5", [*v[:63], None]), ("n6", []), (None, v), ("n7", [float("inf"), *v[1:]])]
    pair = [("p1", [x + 0.01 for x in v]), ("q1", [-x for x in v]), ("q2", [-x - 0.01 for x in v])]
    df = spark.createDataFrame([(*r, None, None) for r in copies + odd + pair], SCHEMA).repartition(3)
    found = set(map(tuple, similar_pairs(df).collect()))
    first = [f"c{n:04d}" for n in range(6)]
    want = {(min(i, o), max(i, o)) for i, _ in copies for o in [x for x in first if x != i][:5]}
    want |= {(o, "p1") for o in first[:5]} | {("q1", "q2")}
    assert found == want
    assert similar_pairs(df.limit(0)).count() == 0 and similar_pairs(df.where("chunk_id like 'n%'")).count() == 0
    assert set(map(tuple, similar_pairs(df.where("chunk_id like 'q%'")).collect())) == {("q1", "q2")}


def test_rounding_loses_no_pair():
    """The bound holds for spiky vectors, whose small coordinates are rounded most, and is small."""
    rng = np.random.default_rng(11)
    v = rng.standard_normal((4000, 64)) * rng.choice([1, 1e-3, 60], (4000, 64), p=[0.6, 0.37, 0.03])
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    pivots = v[:64]
    packed = next(neighbours._permutations(iter([pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([x.tobytes() for x in v])], ["class", "vec"])]), pivots))
    p = np.frombuffer(b"".join(packed.column(1).to_pylist()), neighbours._layout(64, PREFIX))
    i, j = rng.integers(0, 4000, (2, 200_000))
    exact, rounded = (v[i].astype(np.float64) * v[j]).sum(1), np.einsum("ij,ij->i", p["half"][i].astype(np.float32), p["half"][j].astype(np.float32))
    bound = neighbours._error_bound(p["error"][i], p["error"][j])
    assert (np.abs(exact - rounded) <= bound).all() and bound.max() < 0.002


def test_every_pair_of_two_shared_pivots_comes_once(spark, monkeypatch):
    """With the whole reach, a pair comes from exactly one file, whether files are cut into blocks or not."""
    rng = np.random.default_rng(12)
    v = rng.standard_normal((300, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    pivots, batch = v[:20], pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([x.tobytes() for x in v])], ["class", "vec"])
    order = prefixes(v, pivots)[:, : neighbours.POSTED]
    want = {(a, b) for a in range(300) for b in range(300) if a != b and len(set(order[a]) & set(order[b])) >= 2}
    monkeypatch.setattr(neighbours, "SHORTLIST", 10**6)
    for many in (1, 5):
        postings = pa.Table.from_batches(neighbours._postings(neighbours._permutations(iter([batch]), pivots), PREFIX, np.full(20, many))).sort_by("cell")
        got = [p for b in neighbours._ranked(iter(postings.to_batches(100)), 1000, PREFIX, 8, -2.0) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert len(got) == len(set(got)) and set(got) == want
