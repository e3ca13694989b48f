"""Token ids of a whole corpus by a byte-level BPE vocabulary, through a table of distinct words.

Texts are split into words by Spark; every distinct word is encoded once; ids are joined back by position.  The most
frequent words (a documented number of bytes) are joined inside the scan that splits the texts, as an Arrow lookup without
a shuffle, which also takes the skew out of the rest: words beyond that size, if there are any, are joined by shuffle and
put into the gaps left for them.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.scratch import Scratch

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"
#: The split before the merges, with Unicode classes for white space; fixed by the vocabulary.
SPLIT = r"""(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of the words and ids that are looked up inside the scan; rarer words go through a shuffle join.
HOT_BYTES = 16 << 20
#: Steps of the histogram of word frequencies for each doubling, which finds the frequency down to which words are hot.
STEPS = 8
INTS = T.ArrayType(T.IntegerType())


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[bytes, int]:
    """Piece to id of a byte-level vocabulary given as a rank file (``<name>.tiktoken``)."""
    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}


@lru_cache(maxsize=2)
def _encoder(ranks: tuple[bytes, ...]):
    import tiktoken

    table = {piece: i for i, piece in enumerate(ranks)}
    pattern = SPLIT.removeprefix("(?U)")
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _pieces(name: str, folder: str) -> tuple[bytes, ...]:
    """Pieces in id order; ids are 0, 1, ... without gaps."""
    ranks = vocabulary(name, folder)
    pieces = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in pieces] != list(range(len(pieces))):
        raise ValueError("ids have gaps")
    return tuple(pieces)


def split_words(text: Column | str) -> Column:
    """The words of a text in order; no words for a null or empty text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0)), F.array().cast("array<string>"))


def word_table(texts: DataFrame, column: str, name: str, folder: str) -> DataFrame:
    """One row per distinct word: word, n (occurrences), ids."""
    words = texts.select(F.explode(split_words(column)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    pieces = texts.sparkSession.sparkContext.broadcast(_pieces(name, folder))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(pieces.value)
        for batch in batches:
            lists = encoder.encode_ordinary_batch(batch.column("word").to_pylist(), num_threads=1)
            ids = pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), ids], names=["word", "n", "ids"])

    return words.mapInArrow(encode, "word string, n bigint, ids array<int>")


def encode(
    texts: DataFrame,
    key: str = "doc_id",
    column: str = "text",
    name: str = "byte_bpe_50k",
    folder: str = TOKENIZERS,
    hot_bytes: int = HOT_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """key, ids (array of int) of every row, and the columns ``keep``; the ids of a null or empty text are an empty array.

    Special tokens are never produced: their strings are ordinary text.  Keys may be null or repeated.  Other columns are
    not read.
    """
    spark = texts.sparkSession
    names = [key, *(keep or [])]
    if "ids" in names:
        raise ValueError("a kept column has the name of the result")
    kept = [f"_k{i}" for i in range(len(names))]  # own names, so kept columns clash with nothing
    slim = texts.select(*[F.col(n).alias(k) for n, k in zip(names, kept, strict=True)], F.col(column).alias("_text"))
    scratch = Scratch(spark, "tokens")
    table = scratch.save(word_table(slim, "_text", name, folder))
    least = _hot_from(table, hot_bytes)
    hot = table.where(_step() >= least)
    bounded = hot.select("word", "ids").toArrow().combine_chunks()  # at most hot_bytes
    held = spark.sparkContext.broadcast((uuid.uuid4().hex, _ipc(bounded)))
    words = slim.select(*kept, split_words("_text").alias("words"))
    plain = words.select(*kept).schema.add("ids", INTS)

    def named(result: DataFrame) -> DataFrame:
        return result.select(*[F.col(k).alias(n) for n, k in zip(names, kept, strict=True)], "ids")

    if not least:  # every word is hot
        return named(words.mapInArrow(_Lookup(kept, held, False), plain))
    cold_schema = words.select(*kept).schema.add("ids", INTS).add("gaps", T.ArrayType(T.StringType()))
    # the row number is written with the first pass, so it stays the same in both reads
    first = scratch.save(words.mapInArrow(_Lookup(kept, held, True), cold_schema).withColumn("_row", F.monotonically_increasing_id()))
    complete = first.where("size(gaps) = 0").select(*kept, "ids")
    gaps = first.where("size(gaps) > 0")
    filled = (
        gaps.select("_row", F.posexplode("gaps").alias("at", "word"))
        .join(table.select("word", F.col("ids").alias("piece_ids")), "word")
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct("at", "piece_ids"))).alias("fill"))
    )
    whole = gaps.select("_row", *kept, "ids").join(filled.select("_row", F.col("fill.piece_ids").alias("fill")), "_row").drop("_row")
    return named(complete.unionByName(whole.mapInArrow(_Fill(kept), complete.schema)))


def _step() -> Column:
    """Class of a word's frequency, 0 for a single occurrence."""
    return F.floor(F.log2("n") * STEPS).cast("int")


def _hot_from(table: DataFrame, hot_bytes: int) -> int:
    """The least class whose words, with all more frequent ones, fit into ``hot_bytes``; 0 if all words do."""
    size = F.octet_length("word") + F.size("ids") * 4 + 12
    sizes = table.groupBy(_step().alias("step")).agg(F.sum(size).alias("bytes")).orderBy(F.desc("step")).collect()  # at most 64 * STEPS rows
    least, total = 64 * STEPS, 0
    for row in sizes:
        total += row.bytes
        if total > hot_bytes:
            return least
        least = row.step
    return 0


def count(
    texts: DataFrame,
    key: str = "doc_id",
    column: str = "text",
    name: str = "byte_bpe_50k",
    folder: str = TOKENIZERS,
    keep: list[str] | None = None,
) -> DataFrame:
    """key, the columns ``keep``, and n_tokens of every row; 0 for a null or empty text."""
    encoded = encode(texts, key, column, name, folder, keep=keep)
    return encoded.select(key, *(keep or []), F.size("ids").alias("n_tokens"))


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _spans(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of consecutive spans with the given starts and lengths."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


#: The hot table of this Python worker by its name, which no other table has: words, offsets, ids.
_HELD: dict[str, tuple] = {}


#: Rows of texts that a worker handles at once, so that a batch of long texts stays small.
SLICE_ROWS = 1_000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


class _Lookup:
    """Joins the hot words by position; the k-th word that is not among them leaves the id -1 as a gap."""

    def __init__(self, keep: list[str], held, gaps: bool):
        self.keep, self.held, self.gaps = keep, held, gaps

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        token, stream = self.held.value
        if token not in _HELD:
            _HELD.clear()
            table = pa.ipc.open_stream(io.BytesIO(stream)).read_all().combine_chunks()
            ids = _one(table["ids"])
            offsets = ids.offsets.to_numpy().astype(np.int64)
            # one more entry, the gap
            _HELD[token] = (
                _one(table["word"]),
                np.concatenate([offsets, [offsets[-1] + 1]]),
                np.concatenate([ids.values.to_numpy(), np.array([-1], np.int32)]),
            )
        hot, offsets, ids = _HELD[token]
        for batch in _slices(batches):
            words = batch.column("words")
            flat = words.flatten()
            coded = flat.dictionary_encode()
            place = pc.index_in(coded.dictionary, value_set=hot.cast(coded.dictionary.type)).fill_null(len(hot))
            place = place.to_numpy(zero_copy_only=False).astype(np.int64)
            code = coded.indices.to_numpy(zero_copy_only=False)
            entry = place[code] if len(code) else np.zeros(0, np.int64)
            lengths = offsets[entry + 1] - offsets[entry]
            out = ids[_spans(lengths, offsets[entry])] if len(entry) else np.zeros(0, np.int32)
            word_offsets = words.offsets.to_numpy().astype(np.int64)
            word_offsets = word_offsets - word_offsets[0]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            result = pa.ListArray.from_arrays(pa.array(ends[word_offsets].astype(np.int32)), pa.array(out, pa.int32()))
            columns, names = [*(batch.column(k) for k in self.keep), result], [*self.keep, "ids"]
            if self.gaps:
                cold = entry == len(hot)
                before = np.concatenate([[0], np.cumsum(cold)])
                left = flat.filter(pa.array(cold))
                columns.append(pa.ListArray.from_arrays(pa.array(before[word_offsets].astype(np.int32)), left.cast(pa.string())))
                names.append("gaps")
            yield pa.RecordBatch.from_arrays(columns, names=names)


class _Fill:
    """Puts the ids of rare words into their gaps."""

    def __init__(self, keep: list[str]):
        self.keep = keep

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, fill = batch.column("ids"), batch.column("fill")
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            pieces = fill.flatten()
            lengths = np.ones(len(flat), np.int64)
            gap = flat == -1
            lengths[gap] = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            out = np.repeat(flat, lengths)
            out[np.repeat(gap, lengths)] = pieces.flatten().to_numpy(zero_copy_only=False)
            offsets = ids.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            result = pa.ListArray.from_arrays(pa.array(ends[offsets].astype(np.int32)), pa.array(out, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in self.keep), result], names=[*self.keep, "ids"])


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def piece_table(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id, piece (binary), one row per id of the vocabulary."""
    rows = [(i, bytearray(piece)) for i, piece in enumerate(_pieces(name, folder))]
    return spark.createDataFrame(rows, "id int, piece binary")


class _Join:
    """Joins ids with the pieces of the vocabulary by position and concatenates them per row."""

    def __init__(self, key: str, pieces):
        self.key, self.pieces = key, pieces

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = self.pieces.value
        lengths = np.array([len(p) for p in pieces] + [0], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        for batch in _slices(batches):
            lists = pc.fill_null(batch.column("ids"), [])
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            ids = np.where((ids < 0) | (ids >= len(pieces)), len(pieces), ids)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths[ids])])[offsets - offsets[0]]
            data = joined[_spans(lengths[ids], starts[ids])]
            text = pa.Array.from_buffers(
                pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]
            )
            yield pa.RecordBatch.from_arrays([batch.column(self.key), text.cast(pa.binary())], names=[self.key, "bytes"])


def decode(
    encoded: DataFrame, key: str = "doc_id", name: str = "byte_bpe_50k", folder: str = TOKENIZERS
) -> DataFrame:
    """key, text of every row of ``encoded`` (key, ids): a join of ids with pieces.

    The vocabulary has a fixed number of ids, so its pieces are sent to all workers and the join is a lookup by position,
    which moves no rows.  No ids give an empty text; an id outside the vocabulary adds nothing; bytes that are no UTF-8
    become the replacement character.
    """
    pieces = encoded.sparkSession.sparkContext.broadcast(_pieces(name, folder))
    schema = encoded.select(key).schema.add("bytes", T.BinaryType())
    joined = encoded.select(key, "ids").mapInArrow(_Join(key, pieces), schema)
    return joined.select(key, F.make_valid_utf8(F.col("bytes").cast("string")).alias("text"))
