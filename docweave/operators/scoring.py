"""Best chunks for blocks of queries: dot products per Arrow batch, of which each task keeps the first k.

A block of queries, of bounded size, is held by every worker; the chunks are scanned once for each block, and only the
best k of a task and query leave it, so no pair of a query and a chunk is ever shuffled.  Terms that many queries of a
block share are multiplied as a matrix, the others through their postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.scratch import Scratch

#: Queries, and terms of queries, of one block.
BLOCK_QUERIES = 1_000
BLOCK_TERMS = 2_000_000
#: Chunks whose scores are held at once; times the queries of a block.
SLICE_ROWS = 1_000


@dataclass(frozen=True)
class Part:
    """A part of the score from one array of terms: ``dot`` (cosine), ``share`` (Jaccard) or ``any`` (1 if one is common)."""

    name: str
    weight: float
    mode: str


@dataclass
class _Terms:
    """Postings of a part over the queries of a block: the terms, and per term the queries and weights."""

    terms: pa.Array
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    row: np.ndarray  # of the matrix of common terms, -1 for others
    matrix: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, queries: int) -> _Terms:
        coded = table["term"].combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(code, kind="stable")
        counts = np.bincount(code, minlength=len(coded.dictionary))
        query = table["q_no"].to_numpy()[order].astype(np.int64)
        weight = table["w"].to_numpy()[order].astype(float)
        common = np.flatnonzero(counts > max(8, queries // 8))
        row = np.full(len(counts), -1, np.int64)
        row[common] = np.arange(len(common))
        matrix = np.zeros((len(common), queries))
        held = row[code[order]]
        matrix[held[held >= 0], query[held >= 0]] = weight[held >= 0]
        return cls(coded.dictionary, np.concatenate([[0], np.cumsum(counts)]), query, weight, row, matrix)

    def products(self, code: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Rows times queries: the sum of weights over occurrences (term, row) of terms."""
        queries = self.matrix.shape[1]
        place = self.row[code]
        often = place >= 0
        width = self.matrix.shape[0]
        total = np.zeros((rows, queries))
        if width and often.any():
            total += np.bincount(row[often] * width + place[often], minlength=rows * width).reshape(rows, width) @ self.matrix
        code, row = code[~often], row[~often]
        if len(code):
            lengths = self.start[code + 1] - self.start[code]
            ends = np.cumsum(lengths)
            at = np.repeat(self.start[code] - (ends - lengths), lengths) + np.arange(ends[-1])
            total += np.bincount(np.repeat(row, lengths) * queries + self.query[at], self.weight[at], rows * queries).reshape(rows, queries)
        return total


class Best:
    """The first ``k`` rows of each query by value down and id; ids come sorted within a push."""

    def __init__(self, k: int, extras: list[str]):
        self.k, self.extras, self.kept = k, extras, None

    def push(self, score: np.ndarray, valid: np.ndarray, ids: pa.Array, extras: dict[str, np.ndarray]) -> None:
        score = np.where(valid, score, -np.inf)
        least = np.partition(score, len(score) - self.k, axis=0)[len(score) - self.k] if len(score) > self.k else np.full(score.shape[1], -np.inf)
        above = score > least
        equal = (score == least) & valid
        need = self.k - above.sum(axis=0)
        row, query = np.nonzero((above & valid) | (equal & (np.cumsum(equal, axis=0) <= need)))
        fresh = pd.DataFrame({"q": query, "score": score[row, query], "id": ids.take(pa.array(row)).to_pandas().to_numpy(), **{n: x[row, query] for n, x in extras.items()}})
        both = fresh if self.kept is None else pd.concat([self.kept, fresh], ignore_index=True)
        both = both.sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable")
        self.kept = both.groupby("q", sort=False).head(self.k)


class _Score:
    """Scores chunk rows (id, an array per part, a norm of the first part, filter values) against the queries of a block."""

    def __init__(self, block, parts: list[Part], filters: list[str], k: int, digits: int, zeros: bool, prior: float):
        self.block, self.parts, self.filters, self.k, self.digits, self.zeros, self.prior = block, parts, filters, k, digits, zeros, prior

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = self.block.value
        queries = len(block["ids"])
        names = [p.name for p in self.parts] + ["prior"]
        best, kind = Best(self.k, names), pa.null()
        for batch in batches:
            kind = batch.column("c_id").type
            batch = batch.take(pc.sort_indices(batch.column("c_id")))
            looked = {}
            for part in self.parts:
                lists = batch.column(part.name)
                lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten()
                code = pc.fill_null(pc.index_in(flat, value_set=block["terms"][part.name].terms.cast(flat.type)), -1)
                looked[part.name] = (np.concatenate([[0], np.cumsum(lengths)]), flat, code.to_numpy(zero_copy_only=False))
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                hi = min(lo + SLICE_ROWS, batch.num_rows)
                self._slice(best, batch.slice(lo, hi - lo), lo, hi, looked, queries)
        if best.kept is None:
            return
        kept = best.kept
        columns = [block["ids"].take(pa.array(kept["q"].to_numpy())), pa.array(kept["id"].to_numpy(), kind)]
        columns += [pa.array(kept[n].to_numpy(), pa.float64()) for n in [*names, "score"]]
        yield pa.RecordBatch.from_arrays(columns, names=["q_id", "c_id", *names, "score"])

    def _slice(self, best: Best, rows: pa.RecordBatch, lo: int, hi: int, looked: dict, queries: int) -> None:
        block, n = self.block.value, hi - lo
        total, extras = np.zeros((n, queries)), {}
        for part in self.parts:
            offsets, flat, code = looked[part.name]
            here = slice(offsets[lo], offsets[hi])
            row = np.repeat(np.arange(n), np.diff(offsets[lo : hi + 1]))
            hit = code[here] >= 0
            value = block["terms"][part.name].products(code[here][hit].astype(np.int64), row[hit], n)
            if part.mode == "any":
                value = (value > 0).astype(float)
            elif part.mode == "share":
                joint = np.diff(offsets[lo : hi + 1])[:, None] + block["sizes"][part.name][None, :] - value
                value = np.divide(value, joint, out=np.zeros_like(value), where=(value > 0) & (joint > 0))
            else:
                norm = self._norm(part.name, rows, flat.slice(offsets[lo], offsets[hi] - offsets[lo]), row, n)
                value = np.divide(value, norm[:, None], out=np.zeros_like(value), where=norm[:, None] > 0)
            total += part.weight * value
            extras[part.name] = np.round(value, self.digits)
        valid, prior = np.ones((n, queries), bool), np.zeros((n, queries))
        for name in self.filters:
            asked = block["filters"][name]
            same = pc.fill_null(pc.index_in(rows.column(f"c_{name}").cast(pa.string()), value_set=asked[0]), -1).to_numpy(zero_copy_only=False)[:, None] == asked[1][None, :]
            valid &= same | (asked[1] < 0)[None, :]
            if name == "kind":
                prior = (same & (asked[1] >= 0)[None, :]).astype(float)
        score = np.round(np.minimum(1.0, total + self.prior * prior), self.digits)
        if not self.zeros:
            valid &= score > 0
        best.push(score, valid, rows.column("c_id"), extras | {"prior": prior})

    def _norm(self, name: str, rows: pa.RecordBatch, flat: pa.Array, row: np.ndarray, n: int) -> np.ndarray:
        if f"{name}_norm" in rows.schema.names:
            return pc.fill_null(rows.column(f"{name}_norm"), 0.0).to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        width = max(1, len(coded.dictionary))
        pair, count = np.unique(row * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        return np.sqrt(np.bincount(pair // width, count.astype(float) ** 2, n))


def best_chunks(
    queries: DataFrame, postings: DataFrame, chunks: DataFrame, parts: list[Part], k: int, filters: list[str], digits: int, zeros: bool, prior: float = 0.0
) -> DataFrame:
    """q_id, c_id, the parts, prior and score: the first ``k`` chunks of each query by rounded score down and chunk id.

    ``queries``: q_id and q_<filter> columns.  ``postings``: q_id, part, term, w.  ``chunks``: c_id, an array of terms per
    part, optionally <part>_norm, and c_<filter> columns.  A query with a null filter value takes all chunks.  With
    ``zeros`` chunks that share nothing fill up to ``k``.
    """
    spark = queries.sparkSession
    scratch = Scratch(spark, "scores")
    postings = scratch.save(postings)
    n_queries, n_terms = queries.count(), postings.count()
    blocks = max(1, -(-n_queries // BLOCK_QUERIES), -(-n_terms // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("q_id"), F.lit(blocks))
    chunks = scratch.save(chunks)
    schema = T.StructType([queries.schema["q_id"], chunks.schema["c_id"], *[T.StructField(p.name, T.DoubleType()) for p in parts]]).add("prior", "double").add("score", "double")
    found = []
    for i in range(blocks):
        asked = queries.where(block == i).toArrow().combine_chunks()  # about BLOCK_QUERIES rows
        held = postings.where(block == i).toArrow().combine_chunks()  # about BLOCK_TERMS rows
        ids = pa.array([], pa.null()) if not asked.num_rows else asked["q_id"].combine_chunks()
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        if not len(ids):
            continue
        numbered = held.append_column("q_no", pc.index_in(held["q_id"], value_set=ids))
        value = {"ids": ids, "terms": {}, "sizes": {}, "filters": {}}
        for p in parts:
            own = numbered.filter(pc.equal(numbered["part"], p.name))
            value["terms"][p.name] = _Terms.of(own, len(ids))
            value["sizes"][p.name] = np.bincount(own["q_no"].to_numpy().astype(np.int64), minlength=len(ids)).astype(float)
        for name in filters:
            coded = pc.dictionary_encode(asked[f"q_{name}"].cast(pa.string()).combine_chunks())
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            value["filters"][name] = (coded.dictionary, pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False))
        share = spark.sparkContext.broadcast(value)
        found.append(scratch.save(chunks.mapInArrow(_Score(share, parts, filters, k, digits, zeros, prior), schema)))
    if not found:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    scratch.retain(*found)
    from docweave.operators.ordered import top_k

    return top_k(whole, ["q_id"], [F.desc("score"), "c_id"], k)


class _Nearest:
    """Cosines of vectors with the query vectors of a block."""

    def __init__(self, block, k: int, digits: int):
        self.block, self.k, self.digits = block, k, digits

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = self.block.value
        best, kind = Best(self.k, []), pa.null()
        for batch in batches:
            kind = batch.column("v_id").type
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("vector")), matrix.shape[1]))
            batch = batch.take(pc.sort_indices(batch.column("v_id")))
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(lo, SLICE_ROWS)
                unit = _unit(rows.column("vector"), matrix.shape[1])
                own = pc.fill_null(pc.index_in(rows.column("v_id").cast(ids.type), value_set=ids), -1).to_numpy(zero_copy_only=False)
                best.push(np.round(unit @ matrix.T, self.digits), own[:, None] != np.arange(len(ids))[None, :], rows.column("v_id"), {})
        if best.kept is not None:
            kept = best.kept
            columns = [ids.take(pa.array(kept["q"].to_numpy())), pa.array(kept["id"].to_numpy(), kind), pa.array(kept["score"].to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, names=["q_id", "v_id", "similarity"])


def _unit(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors of length 1; those without length, or with a missing number, are 0."""
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    norm = np.sqrt((values * values).sum(axis=1))[:, None]
    return np.divide(values, norm, out=np.zeros_like(values), where=norm > 0)


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """q_id, v_id, similarity (``digits`` places), rank: exact cosine search; a query is not its own hit.

    ``queries``: q_id, vector.  ``vectors``: v_id, vector.  Blocks of about a thousand queries are held by the workers,
    and every vector meets each block in a matrix product.  Null vectors and those of another width than the first query
    are no hits; ties go to the smaller id.
    """
    spark = queries.sparkSession
    scratch = Scratch(spark, "nearest")
    asked = scratch.save(queries.where("vector is not null").select("q_id", "vector"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    schema = T.StructType([queries.schema["q_id"], vectors.schema["v_id"]]).add("similarity", "double")
    found = []
    for i in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == i).toArrow().combine_chunks()  # about BLOCK_QUERIES rows
        if not table.num_rows:
            continue
        ids, lists = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table["q_id"].combine_chunks(), table["vector"].combine_chunks()))
        width = len(lists[0])
        same = pc.equal(pc.list_value_length(lists), width)
        ids, lists = ids.filter(same), lists.filter(same)
        share = spark.sparkContext.broadcast((ids, _unit(lists, width)))
        found.append(vectors.where("vector is not null").select("v_id", "vector").mapInArrow(_Nearest(share, k, digits), schema))
    if not found:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    from docweave.operators.ordered import top_k

    return top_k(whole, ["q_id"], [F.desc("similarity"), "v_id"], k)


class _Label:
    """The nearest of a few labelled vectors for each row."""

    def __init__(self, listed):
        self.listed = listed

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, matrix = self.listed.value
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("vector")), matrix.shape[1]))
            cosine = _unit(batch.column("vector"), matrix.shape[1]) @ matrix.T
            best = cosine.argmax(axis=1) if len(labels) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [batch.column("name"), pa.array([labels[i] for i in best], pa.string()), pa.array(cosine[np.arange(len(best)), best], pa.float64())],
                names=["name", "label", "similarity"],
            )


#: Labelled vectors that workers may hold.
MAX_LABELS = 100_000


def nearest_label(names: DataFrame, corpus: DataFrame) -> DataFrame:
    """name, label, similarity: the label of the nearest vector of a lookup table, the first label among equals.

    ``names``: name, vector.  ``corpus``: label, vector, at most ``MAX_LABELS`` rows, all of one width.  The table is held
    by the workers, so names are scanned once.  Null vectors and those of another width have no row.
    """
    rows = corpus.where("vector is not null").orderBy("label").limit(MAX_LABELS + 1).toArrow().combine_chunks()
    if rows.num_rows > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labelled vectors")
    schema = "name string, label string, similarity double"
    if not rows.num_rows:
        return names.sparkSession.createDataFrame([], schema)
    lists = rows["vector"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    share = names.sparkSession.sparkContext.broadcast((rows["label"].to_pylist(), _unit(lists, len(lists[0]))))
    return names.where("vector is not null").select("name", "vector").mapInArrow(_Label(share), schema)
