"""Compression of vectors to codes: product quantization with codebooks learned by Yinyang Lloyd rounds over whole numbers.

Each component x is taken as floor(``SCALE`` * x). Vectors are cut into ``parts`` equal pieces; each position has a codebook of ``entries`` entries, which
starts as that piece of the vectors of smallest id. A round gives every piece its nearest entry (squared Euclidean distance, ties to the lower
index) and puts the floor of the pieces' mean in each entry's place; an entry without pieces stays.

Rounds are Yinyang rounds. Entries of a codebook are clustered into groups once. A piece carries an upper bound of the distance to its entry
and one lower bound a group, of the distance to that group's other entries. After a round bounds are shifted by how far entries have
moved, and only groups whose lower bound doesn't exceed the upper one are looked at. Bounds are 32-bit numbers rounded outwards; whatever
is looked at is compared by exact integer distances, so ties are found and results equal those of plain Lloyd.

Scale: each round is one pass over the stored vectors, which writes bounds and codes beside the next state and, in the same table, the sums of what its
task has seen; sums are then added up by (part, entry, place), a bounded table. Codebooks (``parts * entries`` pieces) are all that reaches the driver. Errors of labels are
combined before the shuffle and joined back salted by vector.

Cases: vectors that are null, or hold null or non-finite components, are dropped; so are those of another length than the kept one of least id, and all if that
length isn't a multiple of ``parts``. Null ids come after all others and don't start a codebook; vectors of one id are ordered by their components.
Repeated rows count each. With fewer vectors than entries codebooks are that short. Without vectors the result is empty. Null labels are one label. Distances
that may not fit 64 bits (components beyond about 2**26 / SCALE) are computed by Python's whole numbers; errors beyond 64 bits stand at the
largest. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidewright.llm.tables import bounded_batches, removed, salted_join, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Groups of entries that share a lower bound.
_GROUPS = 4
_MOST = (1 << 63) - 1
Codebooks = list[np.ndarray]  #: of each part its entries, a row each


def _whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as int64 where distances and sums fit, else as Python's whole numbers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * float(SCALE))
    if not len(scaled) or np.abs(scaled).max() < 1 << 26:
        return scaled.astype(np.int64)
    exact = lambda x: int(x) * SCALE if abs(x) >= 1 << 53 else int(np.floor(x * SCALE))
    return np.array([exact(float(x)) for x in vectors.ravel()], object).reshape(vectors.shape)


def _pieces(whole: np.ndarray, part: int, parts: int) -> np.ndarray:
    width = whole.shape[1] // parts
    return whole[:, part * width : (part + 1) * width]


def distances(pieces: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, exact: a row for each piece, a column for each entry."""
    if pieces.shape[1] == 0:
        return np.zeros((len(pieces), len(entries)), np.int64)
    return ((pieces[:, None, :] - entries[None]) ** 2).sum(-1)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def _up(x: np.ndarray) -> np.ndarray:
    """The next 32-bit number but one above; _down: below."""
    return np.nextafter(np.nextafter(x.astype(np.float32), np.float32(np.inf)), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(-np.inf))


def grouped(entries: np.ndarray, groups: int = _GROUPS) -> np.ndarray:
    """The group of each entry, by a few rounds of plain clustering from evenly spaced entries; any grouping gives right results."""
    points = entries.astype(np.float64)
    groups = min(groups, len(points))
    if not groups:
        return np.zeros(0, np.int64)
    centres = points[np.arange(groups) * len(points) // groups]
    for _ in range(5):
        of = ((points[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([points[of == g].mean(0) if (of == g).any() else centres[g] for g in range(groups)])
    return of


def assigned(pieces: np.ndarray, entries: np.ndarray, group: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes, upper and lower bounds of pieces, and the distances that it took.

    state: the same of the round before; before: the entries that it was found with.
    """
    n, k, t = len(pieces), len(entries), int(group.max()) + 1
    if state is None or pieces.dtype == object or entries.dtype == object:
        d = distances(pieces, entries)
        code = np.array([min(range(k), key=lambda e: (row[e], e)) for row in d], np.int64) if d.dtype == object else d.argmin(1)
        r = _root(d)
        upper = r[np.arange(n), code]
        r[np.arange(n), code] = np.inf
        lower = np.stack([r[:, group == g].min(1, initial=np.inf) for g in range(t)], 1)
        return code, _up(upper), _down(lower), n * k
    code, upper, lower = state[0].astype(np.int64), state[1].astype(np.float64), state[2].astype(np.float64)
    moved = _root(((entries - before) ** 2).sum(1)) * (1 + 1e-12)
    upper = upper + moved[code]
    lower = lower - np.array([moved[group == g].max(initial=0) for g in range(t)])
    took, due = 0, np.flatnonzero(lower.min(1) <= upper)
    exact = np.zeros(n, np.int64)
    exact[due] = ((pieces[due] - entries[code[due]]) ** 2).sum(1)
    upper[due] = _root(exact[due])
    took += len(due)
    start, best = code.copy(), exact.copy()
    fails = np.zeros((n, t), bool)
    fails[due] = lower[due] <= upper[due, None] * (1 + 1e-6)
    seen = []
    for g in range(t):
        at, members = np.flatnonzero(fails[:, g]), np.flatnonzero(group == g)
        if not len(at) or not len(members):
            continue
        d = distances(pieces[at], entries[members])
        took += d.size
        seen.append((g, at, members, d))
        least = d.argmin(1)
        found, entry = d[np.arange(len(at)), least], members[least]
        better = (found < best[at]) | (found == best[at]) & (entry < code[at])
        best[at[better]], code[at[better]] = found[better], entry[better]
    for g, at, members, d in seen:
        r = _root(d)
        r[members[None] == code[at][:, None]] = np.inf
        lower[at, g] = r.min(1)
    # An entry that was left counts for its group again, where that group wasn't looked at.
    left = np.flatnonzero(code != start)
    lower[left, group[start[left]]] = np.minimum(lower[left, group[start[left]]], _root(exact[left]))
    upper[due] = _root(best[due])
    return code, _up(upper), _down(lower), took


def _sums(pieces: np.ndarray, code: np.ndarray, k: int) -> list[list[int]]:
    """Of each entry the sums of its pieces by place, and their number behind."""
    out = []
    for e in range(k):
        own = pieces[code == e]
        out.append([int(x) for x in own.sum(0)] + [len(own)] if len(own) else [0] * (pieces.shape[1] + 1))
    return out


_SUMS = {"part": "int", "entry": "int", "place": "int", "total": "decimal(38,0)"}


def _round(books: Codebooks, groups: list[np.ndarray], before: Codebooks | None, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass of a task: rows with their next state, and at its end rows of the sums of its pieces."""
    parts, k = len(books), len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, took = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            whole = _whole(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
            t = [int(g.max()) + 1 for g in groups]
            widths = np.cumsum([0, *(1 + x for x in t)])
            old = None
            if before is not None:
                old = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), np.float32).reshape(n, -1), np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts)
            codes, bounds, sums = [], [], []
            for p in range(parts):
                own = _pieces(whole, p, parts)
                state = None if old is None else (old[1][:, p], old[0][:, widths[p]], old[0][:, widths[p] + 1 : widths[p + 1]])
                code, upper, lower, one = assigned(own, books[p], groups[p], state, None if before is None else before[p])
                codes.append(code.astype(np.uint8))
                bounds.append(np.column_stack([upper, lower]))
                sums.append(_sums(own, code, k))
                took += one
            counted = np.array(sums, object)
            totals = counted if totals is None else totals + counted
            code, bound = np.column_stack(codes).tobytes(), np.ascontiguousarray(np.concatenate(bounds, 1), np.float32).tobytes()
            rows = {c: batch.column(c) for c in ("vec_id", "label", "v")}
            rows |= {"code": pa.array([code[i * parts : (i + 1) * parts] for i in range(n)], pa.binary()), "bounds": pa.array([bound[i * (len(bound) // n) : (i + 1) * (len(bound) // n)] for i in range(n)], pa.binary())}
            yield pa.RecordBatch.from_arrays([rows[f.name].cast(f.type) if f.name in rows else pa.nulls(n, f.type) for f in schema], schema=schema)
        if totals is not None:
            at = np.indices(totals.shape).reshape(3, -1)
            values = {"part": at[0], "entry": at[1], "place": at[2]}
            m = at.shape[1]
            total = pa.array([str(x) for x in totals.ravel()]).cast(pa.decimal128(38, 0))
            made = [pa.array(values[f.name], f.type) if f.name in values else total if f.name == "total" else pa.nulls(m, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(made, schema=schema)
            # How many distances the task took, for those who want to know what the bounds spare.
            one = {"part": pa.array([-1], pa.int32()), "total": pa.array([str(took)]).cast(pa.decimal128(38, 0))}
            yield pa.RecordBatch.from_arrays([one[f.name] if f.name in one else pa.nulls(1, f.type) for f in schema], schema=schema)

    return run


def _moved(books: Codebooks, sums: DataFrame) -> tuple[Codebooks, int]:
    """Entries at the floors of their pieces' means, and the distances that were taken; sums: a bounded number of rows once added up."""
    found = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()}
    out = []
    for p, entries in enumerate(books):
        width = entries.shape[1]
        rows = []
        for e, entry in enumerate(entries):
            count = found.get((p, e, width), 0)
            rows.append([found[p, e, i] // count for i in range(width)] if count else [int(x) for x in entry])
        big = max((abs(x) for r in rows for x in r), default=0) >= 1 << 26
        out.append(np.array(rows, object if big else np.int64).reshape(len(rows), width))
    return out, found.get((-1, None, None), 0)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, v: the rows whose vectors have only finite components."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    named = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("v")).filter("v is not null")
    return named.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def learned(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = _GROUPS) -> tuple[DataFrame | None, Codebooks, list[int]]:
    """(vec_id, label, v, code) of usable() vectors as a stored table, the codebooks, and how many distances each round took."""
    bounded_batches(vectors.sparkSession)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()  # a bounded number of rows
    size = len(first[0]["v"]) if first else 0
    starts = [r["v"] for r in first if r["vec_id"] is not None and len(r["v"]) == size]
    if not starts or size % parts:
        return None, [], []
    if len(starts) < entries:
        same = vectors.filter((F.size("v") == size) & F.col("vec_id").isNotNull())
        starts = [r["v"] for r in same.orderBy("vec_id", "v").limit(entries).collect()]
    whole = _whole(np.array(starts, np.float64).reshape(len(starts), size))
    books = [_pieces(whole, p, parts) for p in range(parts)]
    group = [grouped(b, groups) for b in books]
    kept = vectors.filter(F.size("v") == size).select("*", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("binary").alias("bounds"))
    wide = kept.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in _SUMS.items()]).schema
    state, before, took = written(kept, "codes-vectors"), None, []
    for _ in range(rounds + 1):
        out = written(state.select(*kept.columns).mapInArrow(_round(books, group, before, to_arrow_schema(wide)), wide), "codes-state")
        removed(state)
        moved, n = _moved(books, out.filter("part is not null").select("part", "entry", "place", "total"))
        took.append(n)
        state = out.filter("part is null")
        state.written_to = out.written_to
        before, last, books = books, books, moved
    return state, last, took


def _errors(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            whole = _whole(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts)
            total = sum(((_pieces(whole, p, parts) - books[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("code"), pa.array([min(int(x), _MOST) for x in total], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code: a byte a part, error: squared distance) of each usable vector, and the codebooks."""
    kept = usable(vectors, id_col, vector_col, label_col)
    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    out = f"vec_id {types['vec_id']}, label {types['label']}, code binary, error long"
    state, books, _ = learned(kept, parts, entries, rounds)
    if state is None:
        return kept.filter("false").select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), []
    stored = written(state.mapInArrow(_errors(books), out), "codes")
    removed(state)
    return stored, books


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """codes with vector: the entries that the codes stand for, scaled back."""
    table = [[[float(x) / SCALE for x in entry] for entry in b] for b in books]
    entry = lambda p, c: F.element_at(F.array(*[F.array(*map(F.lit, e)) for e in table[p]]), c + 1)
    code = lambda p: F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*[entry(p, code(p)) for p in range(len(books))]))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    errors = found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()
    out = salted_join(found.withColumn("key", F.xxhash64("vec_id", "code")), errors, "label", "key")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.least("label_error", F.lit(_MOST)).cast("long").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
