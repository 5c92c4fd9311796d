"""Vector compression to product codes, with a GNAT over each part's codebook entries.

Components become whole numbers, vectors are cut into PARTS parts, and each part is
replaced by the number of its codebook's nearest entry. Codebooks are trained on all
vectors: every round assigns all parts, and only sums per entry leave the tasks.

The entries of a codebook stand in a geometric near-neighbour access tree. A node has
a few split points; each further entry goes to the child of its nearest split point,
and for each split point and child the node keeps the range of distances between the
split point and the child's entries. A query measures the split points, and by the
triangle inequality drops each child whose entries must all be farther than the best
entry so far.

Distances are whole: squares are exact, and roots are rounded down or up so that a
bound is never too tight. A child is only dropped if it is strictly farther, so that
an equally near entry of a lower number is always found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idsift.llm import common

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Split points of a node; a node of as many entries or fewer has no children.
ARITY = 6
#: Whole components are below this in size, so that squared distances of parts of up to
#: 2 ** 8 components fit 64 bits.
LARGEST = 1 << 24
#: Roots are rounded at a resolution of 1 / ROOT.
ROOT = 4
#: Vectors coded at a time.
BLOCK = 8192


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ROOT times the root of whole numbers, rounded down and rounded up."""
    scaled = squares * (ROOT * ROOT)
    low = np.sqrt(scaled.astype(np.float64)).astype(np.int64)
    low -= low * low > scaled
    low += (low + 1) * (low + 1) <= scaled
    return low, low + (low * low < scaled)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


class Gnat:
    """The tree over the rows of `entries`; numbers are the rows' places in it."""

    def __init__(self, entries: np.ndarray, numbers: np.ndarray | None = None):
        numbers = np.arange(len(entries)) if numbers is None else numbers
        splits = self._spread(entries, numbers)
        self.numbers, self.points = numbers[splits], entries[numbers[splits]]
        rest = np.setdiff1d(np.arange(len(numbers)), splits)
        self.children: list[Gnat] = []
        low, high = [], []
        if len(rest):
            squares = _squares(entries[numbers[rest], None], self.points[None])
            home = squares.argmin(axis=1)
            for child in range(len(splits)):
                mine = home == child
                if mine.any():
                    self.children.append(Gnat(entries, numbers[rest[mine]]))
                    low.append(roots(squares[mine].min(axis=0))[0])
                    high.append(roots(squares[mine].max(axis=0))[1])
        self.low, self.high = np.array(low), np.array(high)

    @staticmethod
    def _spread(entries: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Places of split points: the first, then always the farthest from those taken."""
        if len(numbers) <= ARITY:
            return np.arange(len(numbers))
        taken = [0]
        far = _squares(entries[numbers], entries[numbers[0]])
        while len(taken) < ARITY and far.max() > 0:
            taken.append(int(far.argmax()))
            far = np.minimum(far, _squares(entries[numbers], entries[numbers[taken[-1]]]))
        return np.array(taken)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each query's nearest entry, ties to the lower
        number, and how many distances were measured."""
        number = np.full(len(queries), np.iinfo(np.int64).max)
        square = np.full(len(queries), np.iinfo(np.int64).max)
        return number, square, self._visit(queries, np.arange(len(queries)), number, square)

    def _visit(self, queries: np.ndarray, rows: np.ndarray, number: np.ndarray, square: np.ndarray) -> int:
        squares = np.stack([_squares(queries[rows], p) for p in self.points], axis=1)
        for its, column in zip(self.numbers, squares.T, strict=True):
            nearer = (column < square[rows]) | ((column == square[rows]) & (its < number[rows]))
            square[rows[nearer]], number[rows[nearer]] = column[nearer], its
        measured = squares.size
        if self.children:
            low, high = roots(squares)
            # No entry of a child is nearer than this, whichever split point tells it.
            bound = np.maximum(self.low[None] - high[:, None], low[:, None] - self.high[None]).max(axis=2)
            for child in np.argsort(bound.sum(axis=0)):
                reach = roots(square[rows])[1]
                stay = bound[:, child] <= reach
                if stay.any():
                    measured += self.children[child]._visit(queries, rows[stay], number, square)
        return measured


def assign(whole: np.ndarray, trees: list[Gnat]) -> tuple[np.ndarray, np.ndarray]:
    """vectors x components -> vectors x parts: entry numbers and squared distances."""
    cut = whole.reshape(len(whole), len(trees), -1)
    found = [tree.search(np.ascontiguousarray(cut[:, p]))[:2] for p, tree in enumerate(trees)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def whole_vectors(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label, whole: vectors of whole components, those that can be coded."""
    size = F.size("embedding")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / SCALE))
    kept = vectors.filter(F.col("embedding").isNotNull() & (size > 0) & (size % parts == 0) & fine)
    # The most frequent length, of a handful of lengths.
    lengths = kept.groupBy(size.alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    n = lengths[0]["n"] if lengths else 0
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return kept.filter(size == n).select("vec_id", "label", whole.alias("whole"))


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """parts x entries x components: the parts of the vectors of the smallest ids."""
    ids = vectors.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    first = vectors.join(F.broadcast(ids.withColumnRenamed("vec_id", "_id")), F.expr("vec_id <=> _id"))
    rows = first.groupBy("vec_id").agg(F.min("whole").alias("whole")).orderBy(F.col("vec_id").asc_nulls_last()).collect()
    if not rows:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    start = np.array([r["whole"] for r in rows], dtype=np.int64)
    return start.reshape(len(rows), parts, -1).swapaxes(0, 1).copy()


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, BLOCK):
        rows = batch.slice(at, BLOCK)
        yield rows, rows.column("whole").flatten().to_numpy().astype(np.int64).reshape(rows.num_rows, -1)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after `rounds` rounds over all vectors (vec_id, whole). An entry becomes
    the floor of its parts' mean, component by component; unused entries stay."""
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if books.size else 0):

        def add_up(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            trees = [Gnat(book) for book in books]
            width = books.shape[2]
            sums = np.zeros((*books.shape[:2], width + 1), dtype=np.int64)
            for batch in batches:
                for _, whole in _matrices(batch):
                    numbers, _ = assign(whole, trees)
                    cut = whole.reshape(len(whole), len(trees), width)
                    for p in range(len(trees)):
                        np.add.at(sums[p, :, :width], numbers[:, p], cut[:, p])
                        sums[p, :, width] += np.bincount(numbers[:, p], minlength=books.shape[1])
            part, entry, place = np.nonzero(np.broadcast_to(sums[..., -1:] > 0, sums.shape))
            kinds = (("part", part, "i4"), ("entry", entry, "i4"), ("place", place, "i4"), ("s", sums[part, entry, place], "i8"))
            yield pa.RecordBatch.from_pydict({name: values.astype(kind) for name, values, kind in kinds})

        added = (
            vectors.select("whole").mapInArrow(add_up, "part int, entry int, place int, s long")
            .groupBy("part", "entry", "place").agg(F.sum("s").alias("s")).toPandas()
        )
        sums = np.zeros((*books.shape[:2], books.shape[2] + 1), dtype=np.int64)
        sums[added["part"], added["entry"], added["place"]] = added["s"]
        count = sums[..., -1:]
        books = np.where(count > 0, sums[..., :-1] // np.maximum(count, 1), books)
    return books


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vectors (vec_id, label, whole) -> vec_id, label, code, error."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in books]
        for batch in batches:
            for rows, whole in _matrices(batch):
                numbers, squares = assign(whole, trees)
                codes = [row.tobytes().hex() for row in numbers.astype(np.uint8)]
                yield pa.RecordBatch.from_pydict(
                    {"vec_id": rows.column("vec_id"), "label": rows.column("label"), "code": codes, "error": squares.sum(axis=1)}
                )

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: list[str], books: np.ndarray) -> np.ndarray:
    """Whole components that the codes stand for."""
    numbers = np.array([list(bytes.fromhex(c)) for c in codes])
    return books[np.arange(len(books)), numbers].reshape(len(codes), -1)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vectors (vec_id, embedding, label) -> (vec_id, label, code, error) and the codebooks.

    A code has two hex digits per part, so at most 256 entries. Vectors that are null,
    or hold a null or non-finite component, take no part; neither do those with a
    component of 65 536 or more in size, whose distances would not fit 64 bits, and
    those of another length than most. Repeated rows are coded each; of several vectors
    under one of the first ids the lowest starts the codebook; a null id counts as the
    last. Other columns are dropped. An empty table has no codes.
    """
    whole = common.stored(whole_vectors(vectors, parts), "whole")
    books = train(whole, parts, entries, rounds)
    if not books.size:
        return whole.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), books
    return common.stored(coded(whole, books), "codes"), books


def op11_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = compress(common.table(spark, sf_dir, "embeddings"))
    by_label = codes.groupBy("label").agg(F.expr("try_cast(sum(cast(error as decimal(20,0))) as bigint)").alias("label_error"))
    listed = F.sha2(F.lit(",".join(str(x) for x in books.ravel())), 256)
    joined = codes.join(by_label.withColumnRenamed("label", "_label"), F.expr("label <=> _label"))
    return joined.select("vec_id", "code", "error", "label_error", listed.alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds written out: assign (nearest entry of the part), then floors of means."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
near{r} as (
  select id, p.part, min({{'d': (p.x1 - b.x1) ** 2 + (p.x2 - b.x2) ** 2 + (p.x3 - b.x3) ** 2 + (p.x4 - b.x4) ** 2, 'e': entry}}) as best
  from parts p join book{r} b on b.part = p.part group by id, p.part)""")
        if r < ROUNDS:
            mean = ", ".join(f"coalesce(m.x{i}, b.x{i}) as x{i}" for i in range(1, 5))
            sums = ", ".join(f"floor(sum(x{i}) / count(*))::bigint as x{i}" for i in range(1, 5))
            steps.append(f"""
mean{r} as (select p.part, best.e as entry, {sums} from near{r} join parts p using (id, part) group by p.part, best.e),
book{r + 1} as (select b.part, b.entry, {mean} from book{r} b left join mean{r} m on m.part = b.part and m.entry = b.entry)""")
    return f"""
with kept as (
  select row_number() over (order by vec_id) as id, vec_id, label, embedding as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
parts as (
  select id, vec_id, part, {", ".join(f"floor(256 * v[part * 4 + {i}]::double)::bigint as x{i}" for i in range(1, 5))}
  from kept, range(0, {PARTS}) t(part)),
book0 as (select part, id - 1 as entry, x1, x2, x3, x4 from parts where id <= {ENTRIES}),{",".join(steps)},
coded as (
  select id, string_agg(printf('%02x', best.e), '' order by part) as code, sum(best.d)::bigint as error from near{ROUNDS} group by id),
books as (
  select sha256(string_agg(concat_ws(',', x1, x2, x3, x4), ',' order by part, entry)) as codebooks_sha256 from book{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join kept using (id), books
"""


QUERIES = {"op11_codes": op11_codes}
SQL = {"op11_codes": _sql()}
