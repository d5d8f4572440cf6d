"""Words and prefixes of token texts counted in Arrow batches.

The words of a batch are numbered in their order once, so that all counting is done on whole numbers: a sort brings
equal words of a row together, and words that share a prefix are neighbours. Batches are gathered or cut to some
``CHUNK_TOKENS`` tokens (a row is never cut), which bounds what a task holds. What a chunk gives comes out sorted, cut
into ranges and each piece compressed: pieces, not rows, are shuffled, and a range gets few sorted runs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..schema import INDEXED_FIELDS

#: Longest prefix that is counted.
PREFIX_CHARS = 16
#: Tokens counted at a time, rows sorted at a time when they are unpacked, and the most rows of a batch that is given back.
CHUNK_TOKENS = 500_000
SORT_ROWS = 1_000_000
OUT_ROWS = 50_000

WORD_COUNTS = "term string, id string, field string, tf int, length int, block int"
_WORDS = pa.schema(
    [("term", pa.string()), ("id", pa.string()), ("field", pa.string()), ("tf", pa.int32()), ("length", pa.int32()), ("block", pa.int32())]
)
_PACKED_WORDS = pa.schema([("id", pa.string()), ("field", pa.int8()), ("tf", pa.int32()), ("length", pa.int32()), ("block", pa.int32())])
PREFIX_COUNTS = "prefix string, block int, rows bigint, max_freq bigint, min_length int"
_PREFIXES = pa.schema(
    [("prefix", pa.string()), ("block", pa.int32()), ("rows", pa.int64()), ("max_freq", pa.int64()), ("min_length", pa.int32())]
)
_PACKED_PREFIXES = pa.schema([("block", pa.int32()), ("rows", pa.int32()), ("max_freq", pa.int32()), ("min_length", pa.int32())])
#: Rows of one range as an Arrow stream, terms and prefixes by their place in a sorted list and numbers no wider than they are.
PACKED = "range int, rows binary"
_PACKED = pa.schema([("range", pa.int32()), ("rows", pa.binary())])

#: First ``(term or prefix, block)`` of each range but the first, in order.
Cuts = list[tuple[str, int]]
Batches = Iterator[pa.RecordBatch]


def _chunks(batches: Batches) -> Iterator[pa.Table]:
    """The rows in order, cut before the row that would bring a chunk of several rows above ``CHUNK_TOKENS``."""
    held: list[pa.RecordBatch] = []
    tokens = 0
    for batch in batches:
        sums = np.cumsum(batch.column("length").to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(sums[at - 1]) if at else 0
            end = int(np.searchsorted(sums, CHUNK_TOKENS - tokens + before, side="right"))
            if not held:
                end = max(end, at + 1)
            if end > at:
                held.append(batch.slice(at, end - at))
                tokens += int(sums[end - 1]) - before
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, tokens = [], 0
            at = end
    if held:
        yield pa.Table.from_batches(held)


def _array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts, and the row of each."""
    words = pc.split_pattern(texts, " ")
    return np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy()), words.flatten()


def _ranked(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each word in the sorted list of different words, and that list."""
    coded = words if isinstance(words, pa.DictionaryArray) else words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(order)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def _coded(codes: np.ndarray, names: pa.Array) -> pa.DictionaryArray:
    return pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int32)), names)


def _packed(rows: pa.Table, cuts: Cuts) -> Batches:
    """``PACKED`` of rows sorted by block and, before that, by their first column, which names its sorted values by number."""
    if not rows.num_rows:
        return
    first, blocks = _array(rows.column(0)), _array(rows.column("block")).to_numpy()
    codes, names, at = first.indices.to_numpy(), first.dictionary, [0]
    for name, block in cuts:
        code = bisect_left(range(len(names)), name, key=lambda i: names[i].as_py())
        low = int(np.searchsorted(codes, code))
        if code < len(names) and names[code].as_py() == name:
            low += int(np.searchsorted(blocks[low : int(np.searchsorted(codes, code, side="right"))], block))
        at.append(low)
    for n, (start, end) in enumerate(zip(at, [*at[1:], rows.num_rows])):
        if end > start:
            low, high = int(codes[start]), int(codes[end - 1])
            own = _coded(codes[start:end] - low, names.slice(low, high - low + 1))
            piece = rows.slice(start, end - start).set_column(0, rows.column_names[0], own)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(piece)
            packed = pa.array([sink.getvalue().to_pybytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), packed], schema=_PACKED)


def unpacked(batches: Batches) -> Batches:
    """The rows of ``PACKED`` pieces; each ``SORT_ROWS`` of them come out as one run sorted as the pieces are."""
    held, rows = [], 0
    for batch in batches:
        for piece in batch.column("rows"):
            held.append(pa.ipc.open_stream(piece.as_buffer()).read_all())
            rows += held[-1].num_rows
            if rows >= SORT_ROWS:
                yield from _merged(held)
                held, rows = [], 0
    if held:
        yield from _merged(held)
    pa.default_memory_pool().release_unused()


def _merged(pieces: list[pa.Table]) -> Batches:
    rows = pa.concat_tables(pieces).unify_dictionaries().combine_chunks()
    pieces.clear()
    first, blocks = _array(rows.column(0)), _array(rows.column("block")).to_numpy()
    ranks, names = _ranked(first)
    keys = ranks * (int(blocks.max()) + 1) + blocks
    order = np.argsort(keys)
    schema = _WORDS if rows.column_names[0] == "term" else _PREFIXES
    for at in range(0, len(order), OUT_ROWS):
        now = order[at : at + OUT_ROWS]
        part = rows.select(rows.column_names[1:]).take(pa.array(now))
        columns = {rows.column_names[0]: names.take(pa.array(ranks[now]))} | {c: _array(part.column(c)) for c in part.column_names}
        if "field" in columns:
            columns["field"] = pa.array(INDEXED_FIELDS).take(columns["field"])
        yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


# --- words ------------------------------------------------------------------------------------


def _words(chunk: pa.Table) -> pa.Table:
    """``WORD_COUNTS`` of the rows of a chunk, sorted by term and block."""
    chunk = chunk.sort_by("block").combine_chunks()
    rows, fields, words = [], [], []
    for n, name in enumerate(INDEXED_FIELDS):
        texts = _array(chunk.column(name))
        filled = pc.indices_nonzero(pc.fill_null(pc.not_equal(texts, ""), False))
        row, word = _split(texts.take(filled))
        rows.append(filled.to_numpy().astype(np.int64)[row])
        fields.append(np.full(len(row), n))
        words.append(word)
    ranks, terms = _ranked(pa.concat_arrays(words))
    keys = np.sort((ranks * chunk.num_rows + np.concatenate(rows)) * len(INDEXED_FIELDS) + np.concatenate(fields))
    starts = _starts(keys)
    place, field = np.divmod(keys[starts], len(INDEXED_FIELDS))
    rank, row = np.divmod(place, chunk.num_rows)
    given = [_array(chunk.column(c)).take(pa.array(row)) for c in ("id", "length", "block")]
    counts = pa.array(np.diff(starts, append=len(keys)), pa.int32())
    found = pa.Table.from_arrays([given[0], pa.array(field, pa.int8()), counts, *given[1:]], schema=_PACKED_WORDS)
    return found.add_column(0, "term", _coded(rank, terms))


def count_words(cuts: Cuts) -> Callable[[Batches], Batches]:
    """Packs ``WORD_COUNTS`` of rows of ``id, length, block`` and the tokens of each field. Every row has a token."""

    def run(batches: Batches) -> Batches:
        for chunk in _chunks(batches):
            yield from _packed(_words(chunk), cuts)
        pa.default_memory_pool().release_unused()

    return run


# --- prefixes ---------------------------------------------------------------------------------


def _bookmarks(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The number of the (block, id) of each row of a sorted chunk, and where each begins."""
    ids = _array(chunk.column("id")).dictionary_encode().indices.to_numpy()
    blocks = _array(chunk.column("block")).to_numpy()
    new = np.append(True, (ids[1:] != ids[:-1]) | (blocks[1:] != blocks[:-1]))
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _prefixes(chunk: pa.Table) -> pa.Table:
    """``PREFIX_COUNTS`` of the rows of a chunk, sorted by prefix and block."""
    bookmark, first = _bookmarks(chunk)
    lengths = np.maximum.reduceat(_array(chunk.column("length")).to_numpy(), first)
    blocks, block = np.unique(_array(chunk.column("block")).to_numpy()[first], return_inverse=True)
    row, words = _split(_array(chunk.column("text")))
    ranks, words = _ranked(words)
    bits = len(words).bit_length()
    keys = np.sort(bookmark[row] << bits | ranks)
    starts = _starts(keys)
    rows, ranks = (keys[starts] >> bits).astype(np.int32), (keys[starts] & (1 << bits) - 1).astype(np.int32)
    counts, sizes = np.diff(starts, append=len(keys)).astype(np.int32), pc.utf8_length(words).to_numpy()
    prefixes, places, codes, at, freqs, known = [], [], [], [], [], 0
    for size in range(1, PREFIX_CHARS + 1):
        kept = sizes[ranks] >= size
        rows, ranks, counts = rows[kept], ranks[kept], counts[kept]
        if not len(rows):
            break
        # Words that are long enough and share a prefix are neighbours in the sorted list.
        long = np.flatnonzero(sizes >= size)
        cut = pc.utf8_slice_codeunits(words.take(pa.array(long)), 0, size)
        new = np.append(True, pc.not_equal(cut[1:], cut[:-1]).to_numpy(zero_copy_only=False))
        code = np.zeros(len(words), np.int32)
        code[long] = np.cumsum(new) - 1
        prefixes.append(cut.take(pa.array(np.flatnonzero(new))))
        places.append(long[new] * (PREFIX_CHARS + 1) + size)
        of_word = code[ranks]
        starts = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (of_word[1:] != of_word[:-1])))
        freqs.append(np.add.reduceat(counts, starts))
        at.append(rows[starts])
        codes.append(of_word[starts] + known)
        known += len(prefixes[-1])
    # By the first word that begins with it, and then by size, is the order of prefixes.
    sorted_places = np.argsort(np.concatenate(places))
    rank = np.empty(known, np.int64)
    rank[sorted_places] = np.arange(known)
    at, freqs = np.concatenate(at), np.concatenate(freqs)
    bits = len(blocks).bit_length()
    keys = rank[np.concatenate(codes)] << bits | block[at]
    order = np.argsort(keys)
    keys = keys[order]
    starts = _starts(keys)
    code, block = keys[starts] >> bits, keys[starts] & (1 << bits) - 1
    found = [
        pa.array(blocks[block], pa.int32()),
        pa.array(np.diff(starts, append=len(keys)), pa.int32()),
        pa.array(np.maximum.reduceat(freqs[order], starts), pa.int32()),
        pa.array(np.minimum.reduceat(lengths[at[order]], starts), pa.int32()),
    ]
    names = pa.concat_arrays(prefixes).take(pa.array(sorted_places))
    return pa.Table.from_arrays(found, schema=_PACKED_PREFIXES).add_column(0, "prefix", _coded(code, names))


def _added_up(parts: list[pa.Table]) -> pa.Table:
    """Counts of different bookmarks of one block, put together."""
    parts = [p for p in parts if p.num_rows]
    if len(parts) == 1:
        return parts[0]
    plain = [p.set_column(0, "prefix", p.column(0).cast(pa.string())) for p in parts]
    sums = pa.concat_tables(plain).group_by(["prefix", "block"]).aggregate([("rows", "sum"), ("max_freq", "max"), ("min_length", "min")])
    sums = sums.sort_by("prefix").select(["block", "rows_sum", "max_freq_max", "min_length_min", "prefix"])
    found = pa.Table.from_arrays([_array(c).cast(t) for c, t in zip(sums.columns, _PACKED_PREFIXES.types)], schema=_PACKED_PREFIXES)
    return found.add_column(0, "prefix", _array(sums.column("prefix")).dictionary_encode())


def _whole_bookmarks(chunks: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """Chunks of rows sorted by block and id, cut between two of them only."""
    rest: pa.Table | None = None
    for chunk in chunks:
        chunk = chunk if rest is None else pa.concat_tables([rest, chunk])
        cut = int(_bookmarks(chunk)[1][-1])
        rest = chunk.slice(cut)
        if cut:
            yield chunk.slice(0, cut)
    if rest is not None:
        yield rest


def count_prefixes(cuts: Cuts) -> Callable[[Batches], Batches]:
    """Packs ``PREFIX_COUNTS`` of rows of ``block, id, length, text`` sorted by block and id, all of a block in one task.

    Every row has a token. What is counted of the last block of a chunk waits until that block has ended.
    """

    def run(batches: Batches) -> Batches:
        waiting: list[pa.Table] = []
        for chunk in _whole_bookmarks(_chunks(batches)):
            found, last = _prefixes(chunk), chunk.column("block")[-1]
            if waiting:
                block = waiting[0].column("block")[0]
                same = pc.equal(found.column("block"), block)
                waiting.append(found.filter(same))
                # Parts are put together when they have grown to twice the size, so a long block costs no squares.
                if sum(part.num_rows for part in waiting[1:]) > waiting[0].num_rows:
                    waiting = [_added_up(waiting)]
                if last == block:
                    continue
                found = found.filter(pc.invert(same))
                yield from _packed(_added_up(waiting), cuts)
            same = pc.equal(found.column("block"), last)
            waiting = [found.filter(same)]
            yield from _packed(found.filter(pc.invert(same)), cuts)
        if waiting:
            yield from _packed(_added_up(waiting), cuts)
        pa.default_memory_pool().release_unused()

    return run
