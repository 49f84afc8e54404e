"""Product codes of vectors: integer codebooks learned in rounds, with norm-of-sum bounds in place of most rescans.

Components become integers floor(scale * x); a vector is cut into equal parts and each part position has a codebook of its own.
A round assigns every part to the nearest entry (squared distance, ties to the lower index) and replaces each entry by the
componentwise floor of its parts' mean. All arithmetic that decides is on integers, so results do not depend on how rows are dealt.

Bounds: a part keeps its entry and, for each group of entries, a lower bound of its distance to the group's others, stamped with the round
in which it was measured. The codebooks of all rounds are kept, so a later round lowers a bound by the net way each entry has gone since that
stamp (the norm of the sum of its moves, at most the sum of their norms, largest in the group). If the part's exact distance to its
own entry is below every lowered bound, nothing else can be as near and the part is not scanned; otherwise all entries are
measured again and the stamp is renewed. Bounds are rounded down and moves up, so a skipped scan never changes a result.

Vectors never move: each round is one pass over a written table of rows and their bounds, and a task sends one row of sums and counts
(parts x entries x components, whatever its rows). The driver holds the codebooks of the rounds only.

Defined results: rows whose vector is null or empty or has null or non-finite components are dropped, and so are vectors that are
not of the length of the smallest kept vec_id's, or of no multiple of `parts`; the first codebook is the smallest vec_ids (null last, equal
ones by vector; fewer rows than entries give fewer entries); rows with equal or null vec_id are each coded; null labels are one label; an empty table
gives an empty result; components beyond 2^31 after scaling are an error; columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import slices, stage

PARTS, ENTRIES, ROUNDS, SCALE, GROUPS = 16, 64, 2, 256, 8
#: Rows worked on at once, and the share by which a bound has to be clear of a distance, far above rounding.
ROWS, CLEAR = 4096, 1e-6
#: Bounds are half-precision numbers: the largest stored, and what is taken off so that rounding leaves them below.
MOST, HALF = 60_000.0, 2.0**-10


def usable(parts: int) -> Column:
    size = F.size("embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("embedding").isNotNull() & (size > 0) & (size % parts == 0) & finite


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    y = np.floor(np.asarray(x, np.float64) * scale)
    if y.size and np.abs(y).max() > 2**31 - 1:
        raise ValueError("a component is too large for an integer code")
    return y.astype(np.int64)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries, as integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * x.shape[1] < 2**53:  # every sum is a whole number that a double holds
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)) - 2 * (a @ b.T)).astype(np.int64)
    return sum((x[:, k, None] - entries[None, :, k]) ** 2 for k in range(x.shape[1]))


def moves(history: list[np.ndarray], groups: int) -> np.ndarray:
    """(stamp, part, group): the farthest that an entry of the group has gone from that round's codebook to the last one."""
    now = history[-1]
    gone = np.stack([np.sqrt(((now - then).astype(np.float64) ** 2).sum(axis=2)) for then in history])
    pad = -gone.shape[2] % groups
    gone = np.concatenate([gone, np.zeros((*gone.shape[:2], pad))], axis=2)
    return gone.reshape(*gone.shape[:2], groups, -1).max(axis=3) * (1 + CLEAR)


class Coder:
    """Entry, distance and bounds of every part of a block of rows, against the last of `history`."""

    def __init__(self, history: list[np.ndarray], groups: int = GROUPS):
        self.history, self.groups, self.entries = history, min(groups, history[0].shape[1]), history[-1]
        self.moved = moves(history, self.groups)
        self.scanned = self.seen = 0

    def scan(self, x: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry, its distance and the lower bounds by group of other entries, all measured."""
        d = squared(x, self.entries[part])
        best = d.argmin(axis=1)
        row = np.arange(len(x))
        least = d[row, best]
        other = np.sqrt(d.astype(np.float64))
        other[row, best] = np.inf
        other = np.concatenate([other, np.full((len(x), -other.shape[1] % self.groups), np.inf)], axis=1)
        bound = other.reshape(len(x), self.groups, other.shape[1] // self.groups).min(axis=2)
        return best, least, (np.minimum(bound, MOST) * (1 - HALF)).astype(np.float16)

    def run(self, x: np.ndarray, near: np.ndarray | None, bound: np.ndarray | None, stamp: np.ndarray | None):
        """(near, own, bound, stamp); without a state everything is scanned."""
        n, parts, _ = x.shape
        own = np.empty((n, parts), np.int64)
        fresh = near is None
        if fresh:
            near, bound, stamp = np.zeros((n, parts), np.uint8), np.empty((n, parts, self.groups), np.float16), np.zeros((n, parts), np.uint8)
        for p in range(parts):
            if fresh:
                again = np.arange(n)
            else:
                own[:, p] = ((x[:, p] - self.entries[p][near[:, p]]) ** 2).sum(axis=1)
                left = (bound[:, p].astype(np.float64) - self.moved[stamp[:, p], p]).min(axis=1)
                again = np.nonzero(~(left * (1 - CLEAR) > np.sqrt(own[:, p].astype(np.float64)) * (1 + CLEAR)))[0]
            near[again, p], own[again, p], bound[again, p] = self.scan(x[again, p], p)
            stamp[again, p] = len(self.history) - 1
            self.scanned += len(again)
        self.seen += n * parts
        return near, own, bound, stamp


def first_entries(kept: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """Codebook of the smallest vec_ids; at most `entries` rows come to the driver."""
    rows = kept.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    rows = [r["embedding"] for r in rows if len(r["embedding"]) == len(rows[0]["embedding"])]
    return whole_numbers(np.array(rows), scale).reshape(len(rows), parts, -1).transpose(1, 0, 2) if rows else None


STATE = "numbers binary, near binary, bound binary, stamp binary"
FIELDS = ["vec_id", "label", "numbers", "near", "bound", "stamp", "tally"]


def one_round(state: DataFrame, history: list[np.ndarray], groups: int, scale: int, last: bool) -> DataFrame:
    """Rows with their new entries and bounds, and from each task a row whose tally is (sums and count of each part and entry, parts
    scanned, parts seen); in the last round code and error instead."""
    parts, n_entries, width = history[0].shape
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    started = "numbers" in kinds

    def run(batches):
        coder, kind = Coder(history, groups), None
        total = np.zeros((parts, n_entries, width + 1), np.int64)
        for b in slices(batches, ROWS):
            kind = (b.schema.field("vec_id").type, b.schema.field("label").type)
            n = b.num_rows
            raw = lambda c, t, *shape: np.frombuffer(b"".join(b.column(c).to_pylist()), t).reshape(n, parts, *shape).copy()  # noqa: B023, E731
            if started:
                x = raw("numbers", "<i4", width).astype(np.int64)
                near, own, bound, stamp = coder.run(x, raw("near", np.uint8), raw("bound", "<f2", coder.groups), raw("stamp", np.uint8))
            else:
                flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False)
                x = whole_numbers(flat, scale).reshape(n, parts, width)
                near, own, bound, stamp = coder.run(x, None, None, None)
            if last:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes().hex() for r in near]), pa.array(own.sum(axis=1))], ["vec_id", "label", "code", "error"])
                continue
            for p in range(parts):
                for k in range(width):
                    total[p, :, k] += np.bincount(near[:, p], x[:, p, k], n_entries).astype(np.int64)
                total[p, :, width] += np.bincount(near[:, p], minlength=n_entries)
            blobs = [pa.array([r.tobytes() for r in v], pa.binary()) for v in (x.astype("<i4"), near, bound, stamp)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), *blobs, pa.nulls(n, pa.list_(pa.int64()))], FIELDS)
        if kind and not last:
            tally = pa.array([[*total.ravel().tolist(), coder.scanned, coder.seen]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind[0]), pa.nulls(1, kind[1]), *(pa.nulls(1, pa.binary()) for _ in range(4)), tally], FIELDS)

    head = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    return state.mapInArrow(run, f"{head}, code string, error long" if last else f"{head}, {STATE}, tally array<long>")


def replaced(entries: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The next codebook: floors of means, entries of no part as they were."""
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), entries)


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, groups: int = GROUPS) -> tuple[DataFrame, list[np.ndarray], list[tuple[int, int]]]:
    """((vec_id, label, code, error) of every kept vector, the codebook of each round, (parts scanned, parts seen) of each round but the last)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part")
    kept = vectors.select("vec_id", "label", "embedding").where(usable(parts))
    first = first_entries(kept, parts, entries, scale)
    if first is None:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false"), [], []
    state, history, work = kept.where(F.size("embedding") == parts * first.shape[2]), [first], []
    for turn in range(rounds):
        done = stage(one_round(state, history, groups, scale, False), f"round-{turn}", compression="zstd")
        sums = done.where("tally is not null").select(F.posexplode("tally").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").collect()  # a row for each number of the codebook
        sums = np.array([r["n"] for r in sums], np.int64)
        work.append((int(sums[-2]), int(sums[-1])))
        history.append(replaced(history[-1], sums[:-2].reshape(*first.shape[:2], -1)))
        state = done.where("tally is null").drop("tally")
    return one_round(state, history, groups, scale, True), history, work


def digest(codebooks: np.ndarray | None) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist() if codebooks is not None else [])).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, its error summed over equal labels (nulls together)."""
    coded = stage(coded, "coded")
    sums = stage(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")  # its size is known when the join is planned
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % 16 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT v.* FROM v WHERE len(x) = (SELECT len(x) FROM v WHERE r = 1)),
s AS (SELECT r, i AS p, x[i * (len(x) // 16) + 1 : (i + 1) * (len(x) // 16)] AS x FROM u, range(16) t(i)),
n AS (SELECT row_number() OVER (ORDER BY r) - 1 AS e, r FROM u QUALIFY e < 64),
c0 AS (SELECT p, e, x FROM s JOIN n USING (r)),
{rounds}
a AS (SELECT r, p, e, d FROM a2),
k AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN u USING (r), h
"""
_NEAREST = """a{t} AS (SELECT r, p, m.e AS e, m.d AS d FROM (SELECT s.r, s.p, min({{'d': list_sum(list_transform(list_zip(s.x, c.x), lambda y: (y[1] - y[2]) * (y[1] - y[2])))::BIGINT, 'e': c.e}}) AS m
  FROM s JOIN c{t} c USING (p) GROUP BY s.r, s.p)),"""
_MEANS = """w{t} AS (SELECT a.p, a.e, j, floor(sum(s.x[j]) / count(*)::DOUBLE)::BIGINT AS m FROM a{t} a JOIN s USING (r, p), range(1, 1000) g(j) WHERE j <= len(s.x) GROUP BY ALL),
c{n} AS (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN (SELECT p, e, list(m ORDER BY j) AS x FROM w{t} GROUP BY p, e) m USING (p, e)),"""
ORACLE = ORACLE.replace("{rounds}", "\n".join([_NEAREST.format(t=0), _MEANS.format(t=0, n=1), _NEAREST.format(t=1), _MEANS.format(t=1, n=2), _NEAREST.format(t=2)]))
