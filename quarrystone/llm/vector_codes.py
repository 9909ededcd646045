"""Vector codes: product quantisation in exact integers, nearest entries found through segment-mean lower bounds.

A vector is scaled to integers and cut into equal parts; each part is replaced by the nearest entry of its codebook.  Codebooks
start as the parts of the smallest ids and move for a few rounds to the means of what they attract.

Most entries are never compared in full.  Cut part p and entry c into blocks of b components with sums P and C, and let r be the norm of what
the block means leave of a part.  Then |p - c|^2 >= sum (P - C)^2 / b + (r_p - r_c)^2, since block means and residuals are orthogonal.  One
block gives the coarsest bound, twice as many the next, down to pairs of components.  An entry stays while its bound does not
exceed the distance of the most promising entry, with a margin above any rounding error; the survivors get exact integer distances, ties go to the
lower index.  A round reads the vectors where they lie and moves only sums, one row for each entry and component and task.

Defined cases: vectors that are null or hold null or non-finite components are dropped; of the others those count whose length
most of them have (the shorter of equals) among multiples of the number of parts, further lengths cannot be compared and are dropped too;
fewer vectors than entries make smaller codebooks; a null id comes after all others, rows of one id are ordered by their vectors; null labels are one label;
components beyond LARGEST in size stand as LARGEST, so that a squared distance fits its type; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import read_table, small_batches, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 26
#: Vectors whose bounds are held at once.
SLICE = 4096


@dataclass
class Level:
    """Block sums of some parts, scaled by 1/sqrt(b), and the norms of their residuals."""

    sums: np.ndarray
    residual: np.ndarray


def levels(parts: np.ndarray) -> list[Level]:
    """Coarse to fine: 1, 2, 4, ... blocks, as long as a block holds two components."""
    size, found, blocks = parts.shape[1], [], 1
    norms = (parts * parts).sum(1).astype(float)
    while 2 * blocks <= size or blocks == 1:
        starts = np.arange(blocks) * size // blocks
        width = np.diff(np.append(starts, size))
        sums = np.add.reduceat(parts, starts, axis=1) / np.sqrt(width)
        found.append(Level(sums, np.sqrt(np.maximum(norms - (sums * sums).sum(1), 0.0))))
        blocks *= 2
    return found


class Codebook:
    """Entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.levels = entries, levels(entries)
        self.norms = (entries * entries).sum(1).astype(float)
        #: Exact distances that were worked out, for tests.
        self.compared = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each part."""
        if not len(parts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        mine = levels(parts)
        norms = (parts * parts).sum(1).astype(float)
        coarse = self._bound(0, mine, np.arange(len(parts))[:, None], np.arange(len(self.entries))[None, :])
        best = self._exact(parts, np.arange(len(parts)), coarse.argmin(1))
        # rounding errors of residual norms stay far below a millionth of the squared norms
        limit = best + 0.5 + 1e-6 * norms
        slack = 1e-6 * self.norms
        row, entry = np.nonzero(coarse <= limit[:, None] + slack)
        for level in range(1, len(mine)):
            stays = self._bound(level, mine, row, entry) <= limit[row] + slack[entry]
            row, entry = row[stays], entry[stays]
        exact = self._exact(parts, row, entry)
        self.compared += len(row)
        first = np.searchsorted(row, np.arange(len(parts)))
        least = np.minimum.reduceat(exact, first)
        return np.minimum.reduceat(np.where(exact == least[row], entry, len(self.entries)), first), least

    def _bound(self, level: int, mine: list[Level], row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        ours, theirs = mine[level], self.levels[level]
        found = (ours.residual[row] - theirs.residual[entry]) ** 2
        for k in range(ours.sums.shape[1]):
            found += (ours.sums[row, k] - theirs.sums[entry, k]) ** 2
        return found

    def _exact(self, parts: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = parts[row] - self.entries[entry]
        return (gap * gap).sum(1)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * values.astype(float)), -LARGEST, LARGEST).astype(np.int64)


def sliced(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches in slices, with the integer vectors of their column vec."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            some = batch.slice(at, SLICE)
            vectors = some.column(some.schema.get_field_index("vec")).flatten().to_numpy(zero_copy_only=False)
            yield some, whole(vectors, scale).reshape(-1, dims)


def attracted(rows: DataFrame, books: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry the number and the sums of the parts nearest to it.  books: part, entry, component."""
    parts, entries, width = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [Codebook(b) for b in books]
        n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for _, vectors in sliced(batches, parts * width, scale):
            for p, coder in enumerate(coders):
                mine = vectors[:, p * width : (p + 1) * width]
                index, _ = coder.nearest(mine)
                n[p] += np.bincount(index, minlength=entries)
                np.add.at(total[p], index, mine)
        place = np.flatnonzero(np.repeat(n.ravel() > 0, width))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.repeat(n.ravel(), width)[place]), pa.array(total.ravel()[place])], names=["place", "n", "total"])

    found = rows.select("vec").mapInArrow(summed, "place long, n long, total long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    n, total = np.zeros(books.size, np.int64), np.zeros(books.size, np.int64)
    for place, count, sum_ in found.collect():  # at most one row for each component of the codebooks
        n[place], total[place] = count, sum_
    return n.reshape(books.shape), total.reshape(books.shape)


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """The fitted codebooks of rows (id, vec), all vectors of one length: part, entry, component."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()
    vectors = whole(np.array([r.vec for r in first], float), scale)
    books = vectors.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        n, total = attracted(rows, books, scale)
        books = np.where(n > 0, total // np.maximum(n, 1), books)
    return books


def vector_codes(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """id, label, codes (array of entry numbers), error of every usable row, and the codebooks."""
    spark = embeddings.sparkSession
    schema = "id long, label string, codes array<int>, error long"
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vec"))
    rows = rows.filter(usable(F.col("vec")) & (F.size("vec") > 0) & (F.size("vec") % parts == 0))
    sizes = rows.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dims").first()
    if sizes is None:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    dims = sizes["dims"]
    rows = rows.filter(F.size("vec") == dims)
    books = codebooks(rows, parts, entries, rounds, scale)
    width = dims // parts

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [Codebook(b) for b in books]
        for batch, vectors in sliced(batches, dims, scale):
            codes, error = np.zeros((len(vectors), parts), np.int32), np.zeros(len(vectors), np.int64)
            for p, coder in enumerate(coders):
                codes[:, p], away = coder.nearest(vectors[:, p * width : (p + 1) * width])
                error += away
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(error)], names=["id", "label", "codes", "error"])

    return rows.mapInArrow(coded, schema), books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found, books = vector_codes(read_table(spark, sf_dir, "embeddings"))
    coded = written(found, "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Assignment k of all parts, and the codebooks that follow from it."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT v.r, v.p, any_value(v.x) AS x, arg_min(c.i, (list_sum(list_transform(range(1, len(v.x) + 1), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j]))), c.i)) AS i,
    min(list_sum(list_transform(range(1, len(v.x) + 1), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j])))) AS away
  FROM v JOIN c{k} c USING (p) GROUP BY v.r, v.p),
m{k} AS (SELECT p, i, j, sum(x[j]) AS s, count(*) AS n FROM a{k}, range(1, 1 + (SELECT max(len(x)) FROM v)) t(j) GROUP BY p, i, j),
u{k} AS (SELECT p, i, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM m{k} GROUP BY p, i),
c{k + 1} AS MATERIALIZED (SELECT p, i, coalesce(u.x, c.x) AS x FROM c{k} c LEFT JOIN u{k} u USING (p, i)),"""


OP11_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
  SELECT r, p, list_transform(e[p * (len(e) // 16) + 1 : (p + 1) * (len(e) // 16)], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM k, range(16) t(p)),
c0 AS MATERIALIZED (SELECT p, i, x FROM v JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM k QUALIFY i < 64) USING (r)),
{_round(0)}{_round(1)}{_round(2)}
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM c2),
o AS (SELECT r, string_agg(lower(printf('%02x', i)), '' ORDER BY p) AS code, sum(away)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN k USING (r), s
"""
