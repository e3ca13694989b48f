"""Nested JSON records into related flat tables, by kernels over Arrow buffers.

A batch of JSON texts is one byte buffer with list offsets.  Strings, structural characters, nesting depth, the parent of
every container and the position of every array element follow from vectorised scans (cumulative sums, sorts and
searches) over that buffer; grammar errors are found the same way.  Keys reach the child tables by ``take``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
# token classes
OPEN_O, CLOSE_O, OPEN_A, CLOSE_A, COMMA, COLON, STRING, SCALAR = range(8)
_STRUCT = np.full(256, -1, np.int8)
for _c, _k in zip(b"{}[],:", range(6)):
    _STRUCT[_c] = _k
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b'"\\/bfnrtu')] = True
_SCALAR = r"^(-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?|true|false|null)$"


class Scan:
    """Tokens of a batch of JSON texts, with the enclosing container and validity of each.

    Arrays are parallel over tokens in buffer order: ``kind``, ``start`` and ``end`` (bytes), ``row`` (text), ``parent``
    (token of the enclosing open bracket, -1 at the top), ``depth``; ``valid`` is per text.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and len(texts) else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]] if len(texts) else whole[:0]
        self.offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
        self.rows = len(texts)
        self.valid = np.ones(self.rows, bool)
        self._tokens()
        self._nest()
        self._grammar()

    def _row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def _tokens(self) -> None:
        data, offsets = self.data, self.offsets
        # a quote counts unless an odd run of backslashes precedes it
        slashes = np.flatnonzero(data == 92)
        escaped = np.zeros(len(data) + 1, bool)
        if len(slashes):
            first = np.concatenate([[True], (np.diff(slashes) != 1) | np.isin(slashes[1:], offsets)])
            run = np.flatnonzero(first)[np.cumsum(first) - 1]
            odd = (np.arange(len(slashes)) - run) % 2 == 0
            escaped[slashes[odd] + 1] = True
            escaped[offsets[offsets < len(escaped)]] = False
        quotes = np.flatnonzero((data == 34) & ~escaped[: len(data)])
        row = self._row_of(quotes)
        per_row = np.bincount(row, minlength=self.rows)
        self.valid[per_row % 2 == 1] = False  # an open string; such texts are left out of all later steps
        quotes, row = quotes[self.valid[row]], row[self.valid[row]]
        starts, ends = quotes[::2], quotes[1::2]
        inside = np.zeros(len(data) + 1, np.int32)
        inside[starts] += 1
        inside[ends + 1] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int32).astype(bool)
        dead = np.repeat(~self.valid, np.diff(offsets))
        outside = ~inside & ~dead
        self._strings(inside, starts, slashes if len(slashes) else np.zeros(0, np.int64), escaped)
        # a backslash outside strings is part of a scalar and fails there
        plain = outside & ~_SPACE[data] & (_STRUCT[data] < 0)
        edge = np.diff(np.concatenate([[0], plain.astype(np.int8), [0]]))
        edge_rows = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))] if self.rows > 1 else np.zeros(0, np.int64)
        split = edge_rows[plain[edge_rows] & plain[edge_rows - 1]] if len(edge_rows) else edge_rows
        scalar_start = np.concatenate([np.flatnonzero(edge == 1), split])
        scalar_end = np.concatenate([np.flatnonzero(edge == -1), split])
        scalar_start.sort()
        scalar_end.sort()
        marks = np.flatnonzero(outside & (_STRUCT[data] >= 0))
        kind = np.concatenate([_STRUCT[data[marks]], np.full(len(starts), STRING, np.int8), np.full(len(scalar_start), SCALAR, np.int8)])
        start = np.concatenate([marks, starts, scalar_start])
        end = np.concatenate([marks + 1, ends + 1, scalar_end])
        order = np.argsort(start, kind="stable")
        self.kind, self.start, self.end = kind[order], start[order], end[order]
        self.row = self._row_of(self.start)

    def _fail(self, rows: np.ndarray) -> None:
        self.valid[rows] = False

    def _strings(self, inside: np.ndarray, starts: np.ndarray, slashes: np.ndarray, escaped: np.ndarray) -> None:
        data = self.data
        self._fail(self._row_of(np.flatnonzero(inside & (data < 32))))
        if len(slashes):
            lead = slashes[inside[slashes] & ~escaped[slashes]]
            after = np.minimum(lead + 1, len(data) - 1)
            self._fail(self._row_of(lead[~_ESCAPED[data[after]]]))
            u = lead[data[after] == 117]
            for k in range(2, 6):
                at = np.minimum(u + k, len(data) - 1)
                self._fail(self._row_of(u[~_HEX[data[at]]]))

    def _nest(self) -> None:
        """Depth and enclosing container of every token."""
        kind, n = self.kind, len(self.kind)
        opens = (kind == OPEN_O) | (kind == OPEN_A)
        closes = (kind == CLOSE_O) | (kind == CLOSE_A)
        level = np.cumsum(opens.astype(np.int64) - closes)  # after the token
        first = np.searchsorted(self.row, np.arange(self.rows))  # first token of each text
        base = np.where(first > 0, level[np.minimum(first, max(n, 1)) - 1] if n else 0, 0)
        level = level - base[self.row] if n else level
        before = level - opens + closes  # brackets open when the token begins
        self._fail(self.row[level < 0])
        last = np.searchsorted(self.row, np.arange(self.rows), side="right") - 1
        if n:
            full = last >= first
            self._fail(np.flatnonzero(full)[level[last[full]] != 0])
            self._fail(np.flatnonzero(~full))
        else:
            self.valid[:] = False
        self.depth = np.where(closes, before - 1, before)
        # the parent of a token of depth d is the latest bracket opened at depth d - 1 before it
        self.parent = np.full(n, -1, np.int64)
        where = np.flatnonzero(opens)
        width = n + 1
        keys = self.depth[where] * width + where
        order = np.argsort(keys, kind="stable")
        keys, where = keys[order], where[order]
        ask = np.flatnonzero(self.depth > 0)
        if len(ask) and len(where):
            found = np.searchsorted(keys, (self.depth[ask] - 1) * width + ask) - 1
            ok = found >= 0
            self.parent[ask[ok]] = where[found[ok]]
        # the bracket a closing one belongs to
        self.opener = np.full(n, -1, np.int64)
        ask = np.flatnonzero(closes & (level >= 0))
        if len(ask) and len(where):
            found = np.searchsorted(keys, self.depth[ask] * width + ask) - 1
            ok = found >= 0
            self.opener[ask[ok]] = where[found[ok]]
            pair = ask[ok]
            wrong = kind[self.opener[pair]] + 1 != kind[pair]
            self._fail(self.row[pair[wrong]])
        self.opens, self.closes = opens, closes

    def _grammar(self) -> None:
        kind, n = self.kind, len(self.kind)
        self.is_key = np.zeros(n, bool)
        if not n:
            return
        within = np.where(self.parent >= 0, kind[self.parent], -1)  # OPEN_O, OPEN_A or -1 at the top
        same = np.concatenate([[False], self.row[1:] == self.row[:-1]])
        prev = np.where(same, np.concatenate([[-1], kind[:-1]]), -1)
        value_start = self.opens | (kind == STRING) | (kind == SCALAR)
        value_end_prev = np.isin(prev, (CLOSE_O, CLOSE_A, STRING, SCALAR))
        in_o, in_a, top = within == OPEN_O, within == OPEN_A, within == -1
        self.is_key = (kind == STRING) & in_o & ((prev == OPEN_O) | (prev == COMMA))
        prev_key = np.concatenate([[False], self.is_key[:-1]]) & same
        ok = np.zeros(n, bool)
        ok |= self.is_key
        ok |= (kind == COLON) & in_o & prev_key
        ok |= value_start & in_o & (prev == COLON)
        ok |= value_start & in_a & ((prev == OPEN_A) | (prev == COMMA))
        ok |= value_start & top & (prev == -1)
        ok |= (kind == COMMA) & (in_o | in_a) & value_end_prev & ~prev_key
        ok |= (kind == CLOSE_O) & ((prev == OPEN_O) | (value_end_prev & ~prev_key))
        ok |= (kind == CLOSE_A) & ((prev == OPEN_A) | value_end_prev)
        self._fail(self.row[~ok])
        scalars = np.flatnonzero(kind == SCALAR)
        if len(scalars):
            coded = self.text(scalars).dictionary_encode()
            good = pc.match_substring_regex(coded.dictionary, _SCALAR).to_numpy(zero_copy_only=False)
            self._fail(self.row[scalars[~good[coded.indices.to_numpy()]]])

    def text(self, tokens: np.ndarray) -> pa.Array:
        """The bytes of tokens as strings (quotes of strings included)."""
        start, length = self.start[tokens], self.end[tokens] - self.start[tokens]
        offsets = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
        buffers = [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(self.data[at].tobytes())]
        return pa.Array.from_buffers(pa.large_binary(), len(tokens), buffers).cast(pa.large_string())

    def _decoded(self, tokens: np.ndarray) -> pa.Array:
        """String tokens without quotes and escapes; each distinct escaped string is decoded once."""
        coded = self.text(tokens).dictionary_encode()
        plain = pc.utf8_slice_codeunits(coded.dictionary, 1, -1) if len(coded.dictionary) else coded.dictionary
        odd = np.flatnonzero(pc.match_substring(coded.dictionary, "\\").to_numpy(zero_copy_only=False))
        if len(odd):
            values = plain.to_pylist()
            for i in odd:
                # a lone surrogate has no UTF-8 form and becomes the replacement character
                values[i] = json.loads(coded.dictionary[int(i)].as_py()).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            plain = pa.array(values, pa.large_string())
        return plain.take(coded.indices)

    def nodes(self) -> dict[str, object]:
        """Values of valid texts: token, kind, row, parent container token, member name, array position, full path."""
        kind, n = self.kind, len(self.kind)
        live = self.valid[self.row] if n else np.zeros(0, bool)
        value = live & ~self.is_key & (self.opens | (kind == STRING) | (kind == SCALAR))
        tokens = np.flatnonzero(value)
        parent = self.parent[tokens]
        in_array = (parent >= 0) & (kind[np.maximum(parent, 0)] == OPEN_A) if n else np.zeros(0, bool)
        # position: commas of the same array up to the value, less those before the array began
        commas = np.flatnonzero((kind == COMMA) & live)
        width = n + 1
        keys = np.sort(self.parent[commas] * width + commas)
        position = np.searchsorted(keys, parent * width + tokens) - np.searchsorted(keys, parent * width)
        named = (parent >= 0) & ~in_array
        names = np.full(len(tokens), None, object)
        if named.any():
            names[named] = np.asarray(self._decoded(tokens[named] - 2).to_pylist(), object)
        return {"token": tokens, "parent": parent, "in_array": in_array, "position": position, "name": names, "kind": kind[tokens], "row": self.row[tokens], "depth": self.depth[tokens]}


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def _paths(scan: Scan, nodes: dict) -> np.ndarray:
    """Full path of every node, built level by level from the paths of the parents."""
    tokens = nodes["token"]
    index = np.full(len(scan.kind) + 1, -1, np.int64)
    index[tokens] = np.arange(len(tokens))
    paths = np.full(len(tokens), "", object)
    order = np.argsort(nodes["depth"], kind="stable")
    bounds = np.searchsorted(nodes["depth"][order], np.arange(1, (nodes["depth"].max() if len(tokens) else 0) + 2))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        here = order[lo:hi]
        above = pa.array(paths[index[nodes["parent"][here]]], pa.large_string())
        array = nodes["in_array"][here]
        step = np.full(len(here), "", object)
        if array.any():
            spot = pa.array(nodes["position"][here][array]).cast(pa.large_string())
            step[array] = pc.binary_join_element_wise(_text("["), spot, _text("]"), _text("")).to_numpy(zero_copy_only=False)
        if (~array).any():
            name = pa.array(nodes["name"][here][~array], pa.large_string())
            lead = pc.if_else(pc.equal(above.filter(pa.array(~array)), ""), "", ".").cast(pa.large_string())
            step[~array] = pc.binary_join_element_wise(lead, name, _text("")).to_numpy(zero_copy_only=False)
        paths[here] = pc.binary_join_element_wise(above, pa.array(step, pa.large_string()), _text("")).to_numpy(zero_copy_only=False)
    return paths


#: Bytes of JSON scanned at once; a longer text is scanned alone.
SCAN_BYTES = 4 << 20


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > SCAN_BYTES:
            yield start, i
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield start, len(sizes)


class _Flatten:
    def __init__(self, keys: tuple[str, ...], column: str, want: str):
        self.keys, self.column, self.want = keys, column, want

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(self.column)
            for lo, hi in _slices(texts):
                out = self._part(batch.slice(lo, hi - lo), texts.slice(lo, hi - lo))
                if out is not None:
                    yield out

    def _part(self, batch: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch | None:
        scan = Scan(texts)
        if not scan.valid.any():
            return None
        nodes = scan.nodes()
        if self.want == "objects":
            # only containers are needed on the way to an object; scalars get no path
            pick = np.flatnonzero((nodes["kind"] == OPEN_O) | (nodes["kind"] == OPEN_A))
            nodes = {k: v[pick] for k, v in nodes.items()}
        paths = _paths(scan, nodes)
        index = np.full(len(scan.kind) + 1, -1, np.int64)
        index[nodes["token"]] = np.arange(len(nodes["token"]))
        above = index[nodes["parent"]]
        if self.want == "objects":
            chosen = np.flatnonzero(nodes["kind"] == OPEN_O)
        else:
            chosen = np.flatnonzero((nodes["kind"] == STRING) | (nodes["kind"] == SCALAR))
        # the nearest enclosing object: step over arrays
        holder = above.copy()
        while True:
            skip = (holder >= 0) & (nodes["kind"][np.maximum(holder, 0)] == OPEN_A)
            if not skip.any():
                break
            holder[skip] = above[holder[skip]]
        held = holder[chosen]
        holder_path = np.where(held >= 0, paths[np.maximum(held, 0)], None)
        take = pa.array(nodes["row"][chosen])
        columns = [batch.column(k).take(take) for k in self.keys]
        text = lambda x: pa.array(x, pa.string())
        spot = pa.array(nodes["position"][chosen], pa.int64(), mask=~nodes["in_array"][chosen])
        columns += [text(paths[chosen]), text(holder_path), text(nodes["name"][chosen]), spot]
        names = [*self.keys, "path", "parent_path", "member", "position"]
        if self.want == "objects":
            columns.append(pa.array(nodes["in_array"][chosen]))
            names.append("in_array")
        else:
            token, kind = nodes["token"][chosen], nodes["kind"][chosen]
            value = np.full(len(chosen), None, object)
            if (kind == STRING).any():
                value[kind == STRING] = scan._decoded(token[kind == STRING]).to_pylist()
            plain = kind == SCALAR
            if plain.any():
                value[plain] = scan.text(token[plain]).to_pylist()
            lead = scan.data[scan.start[token]]
            shape = np.select([kind == STRING, lead == ord("n"), (lead == ord("t")) | (lead == ord("f"))], ["string", "null", "boolean"], "number")
            value[shape == "null"] = None
            columns += [text(shape.astype(object)), text(value)]
            names += ["value_type", "value"]
        return pa.RecordBatch.from_arrays(columns, names=names)


_LINKS = [
    T.StructField("path", T.StringType()),
    T.StructField("parent_path", T.StringType()),
    T.StructField("member", T.StringType()),
    T.StructField("position", T.LongType()),
]


def _flatten(records: DataFrame, keys: list[str], column: str, want: str, extra: list[T.StructField]) -> DataFrame:
    slim = records.select(*keys, column).where(f"`{column}` is not null")
    clash = {"path", "parent_path", "member", "position", *(f.name for f in extra)} & set(keys)
    if clash:
        raise ValueError(f"key columns clash with result columns: {sorted(clash)}")
    schema = T.StructType([*(slim.schema[k] for k in keys), *_LINKS, *extra])
    return slim.mapInArrow(_Flatten(tuple(keys), column, want), schema)


def nested_objects(records: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row per JSON object: ``keys``, path ('' at the top), parent_path (the object that holds it, null at the top),
    member (name, null in an array), position (in the array, else null), in_array.

    Null, empty, truncated or otherwise invalid texts give no rows.  Other columns of ``records`` are not read.
    """
    return _flatten(records, keys, column, "objects", [T.StructField("in_array", T.BooleanType())])


def nested_values(records: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row per scalar: as ``nested_objects``, with value_type (string, number, boolean, null) and value (text)."""
    extra = [T.StructField("value_type", T.StringType()), T.StructField("value", T.StringType())]
    return _flatten(records, keys, column, "values", extra)
