"""Splitting oversized texts into pieces within a token limit, at natural boundaries, with overlap.

A text is described by one character per token, which tells how good a cut after that token is.  A regular expression
with bounded quantifiers, its alternatives ordered by boundary strength, consumes up to the limit from that string; the
last alternative takes any cut between characters.  The lengths of the matches are an array; running sums over tokens,
characters and bytes turn it into spans with their look-back for the overlap, and the pieces of text are put together from
the bytes of their tokens, so the work grows in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.tokens import TOKENIZERS, _pieces, _slices, _spans, encode

#: A cut after a token, strongest first: paragraph, line, sentence, word, between characters; '-' is inside a character.
CLASSES = "PLSWx-"
#: Bytes of pieces that are put together at once.
CUT_BYTES = 4 << 20


def _pattern(body: int, least: int) -> str:
    """Alternatives by strength: the rest if it fits, else the longest run that ends in the strongest boundary.

    Paragraphs, lines and sentences must fill at least ``least`` tokens, so that strong boundaries do not make crumbs.
    """
    strong = "|".join(f"[{CLASSES}]{{{least - 1},{body - 1}}}{c}" for c in ("P", "[PL]", "[PLS]"))
    return (
        f"[{CLASSES}]{{1,{body}}}\\z|{strong}|[{CLASSES}]{{0,{body - 1}}}[PLSW]|[{CLASSES}]{{0,{body - 1}}}[PLSWx]"
        f"|[{CLASSES}]{{1,{body}}}"
    )


class _Shape:
    """Per text, given by its ids, which are passed on: one class character per token."""

    def __init__(self, key: str, pieces):
        self.key, self.pieces = key, pieces

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = self.pieces.value
        n = len(pieces)
        lead, newline, breaks, stop, space_end, space_start = (np.zeros(n, np.int32) for _ in range(6))
        space = b" \t\n\r\x0b\x0c"
        for i, p in enumerate(pieces):
            lead[i] = (p[0] & 0xC0) == 0x80
            newline[i] = p.endswith((b"\n", b"\r"))
            breaks[i] = p.count(b"\n")
            stop[i] = p.rstrip(b"\"')]").endswith((b".", b"!", b"?", b";", "。".encode(), "！".encode(), "？".encode()))
            space_end[i] = p[-1] in space
            space_start[i] = p[0] in space
        for batch in _slices(batches):
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            total = len(ids)
            last = np.zeros(total, bool)
            ends = offsets[1:][offsets[1:] > offsets[:-1]]
            last[ends - 1] = True
            following = np.concatenate([ids[1:], [0]]).astype(np.int64) if total else ids
            nl = newline[ids].astype(bool)
            next_nl = newline[following].astype(bool) & (breaks[following] > 0) & ~last
            before = np.concatenate([[False], nl[:-1]])
            first = np.zeros(total, bool)
            first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
            before &= ~first
            next_space = space_start[following].astype(bool) | last
            paragraph = nl & ((breaks[ids] > 1) | before) & ~next_nl
            line = nl & ~next_nl
            sentence = stop[ids].astype(bool) & next_space
            word = next_space | space_end[ids].astype(bool)
            code = np.full(total, ord("x"), np.uint8)
            code[word] = ord("W")
            code[sentence] = ord("S")
            code[line] = ord("L")
            code[paragraph] = ord("P")
            code[lead[following].astype(bool) & ~last] = ord("-")
            shape = pa.Array.from_buffers(
                pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(code.tobytes())]
            ).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(self.key), lists, shape], names=[self.key, "ids", "shape"])


class _Cut:
    """Per text, given by its ids and the tokens each piece takes: its pieces with their overlap."""

    def __init__(self, key: str, pieces, overlap: int):
        self.key, self.pieces, self.overlap = key, pieces, overlap

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = self.pieces.value
        size = np.array([len(p) for p in pieces], np.int64)
        place = np.concatenate([[0], np.cumsum(size)])[:-1]
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        chars = np.array([sum((b & 0xC0) != 0x80 for b in p) for p in pieces], np.int64)
        inner = np.array([(p[0] & 0xC0) == 0x80 for p in pieces], bool)
        for batch in _slices(batches):
            lists, taken = batch.column("ids"), batch.column("taken")
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            own = taken.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(own):
                continue
            first_token = lists.offsets.to_numpy().astype(np.int64)
            first_piece = taken.offsets.to_numpy().astype(np.int64)
            first_token, first_piece = first_token - first_token[0], first_piece - first_piece[0]
            row = np.repeat(np.arange(len(lists)), np.diff(first_piece))
            end = np.cumsum(own)  # the pieces take every token, so this also counts the tokens before
            begin = end - own
            top = first_token[row]
            # the overlap starts at the first token, from the wanted one on, that begins a character
            begins = np.where(inner[ids], len(ids), np.arange(len(ids)))
            begins = np.minimum.accumulate(begins[::-1])[::-1]
            start = np.minimum(begins[np.maximum(begin - self.overlap, top)], begin)
            until_char = np.concatenate([[0], np.cumsum(chars[ids])])
            until_byte = np.concatenate([[0], np.cumsum(size[ids])])
            length = until_byte[end] - until_byte[start]
            number = np.arange(len(own)) - first_piece[row]
            keys = batch.column(self.key)
            cuts = np.searchsorted(np.cumsum(length), np.arange(CUT_BYTES, int(length.sum()), CUT_BYTES), "right")
            for part in np.split(np.arange(len(own)), np.unique(cuts)):
                if not len(part):
                    continue
                s, e = start[part], end[part]
                held = ids[_spans(e - s, s)]
                data = joined[_spans(size[held], place[held])]
                offsets = np.concatenate([[0], np.cumsum(length[part])])
                text = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(row[part])),
                        pa.array(number[part].astype(np.int32)),
                        pa.array((until_char[s] - until_char[top[part]]).astype(np.int32)),
                        pa.array((until_char[e] - until_char[s]).astype(np.int32)),
                        pa.array((e - s).astype(np.int32)),
                        pa.array((begin[part] - s).astype(np.int32)),
                        text.cast(pa.binary()),
                    ],
                    names=[self.key, "piece_no", "start", "length", "n_tokens", "overlap", "bytes"],
                )


def split_oversized(
    texts: DataFrame,
    limit: int = 1024,
    overlap: int = 64,
    key: str = "doc_id",
    column: str = "text",
    name: str = "byte_bpe_50k",
    folder: str = TOKENIZERS,
) -> DataFrame:
    """Pieces of the texts above ``limit`` tokens: key, piece_no (from 0), start, length (characters), n_tokens, overlap, text.

    Pieces cover the text in order.  Each has at most ``limit`` tokens of the text, the first ``overlap`` of them shared
    with the piece before (0 for the first, a token or so less where the overlap would begin inside a character).  Texts
    within the limit, empty and null ones have no pieces.  A text with fewer bytes than the limit cannot exceed it and is
    not encoded.  At a cut a word may encode to other tokens than within the text, so a piece by itself may have a few more
    or fewer; up to eight tokens, a sixteenth of a small limit, are kept free for that.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    body = limit - overlap - min(8, limit // 16)
    large = texts.select(F.col(key).alias("_key"), F.col(column).alias("_text")).where(F.octet_length("_text") > limit)
    encoded = encode(large, "_key", "_text", name, folder).where(F.size("ids") > limit)
    pieces = texts.sparkSession.sparkContext.broadcast(_pieces(name, folder))
    shaped = encoded.mapInArrow(_Shape("_key", pieces), encoded.select("_key", "ids").schema.add("shape", T.StringType()))
    taken = F.transform(F.regexp_extract_all("shape", F.lit(_pattern(body, max(1, body // 4))), F.lit(0)), F.length)
    schema = encoded.select("_key").schema
    for field in ("piece_no", "start", "length", "n_tokens", "overlap"):
        schema = schema.add(field, T.IntegerType())
    cut = shaped.select("_key", "ids", taken.alias("taken")).mapInArrow(_Cut("_key", pieces, overlap), schema.add("bytes", T.BinaryType()))
    text = F.make_valid_utf8(F.col("bytes").cast("string")).alias("text")
    return cut.select(F.col("_key").alias(key), "piece_no", "start", "length", "n_tokens", "overlap", text)
