"""Removal of byte strings that occur again, by suffix arrays.

A string of ``DEPTH`` bytes is repeated if it also starts anywhere else. All such strings (the
windows of the texts) are first dealt into groups so that equal ones meet: each goes by the
smallest hash among its k-grams, which equal windows share. Neighbouring windows with one such
key make a *run*, which is moved as one short piece of text. A group is concatenated, its suffix
array is made by two-stage sorting (``suffixes``), and windows whose neighbours in it have a
common prefix of ``DEPTH`` bytes are repeated.

* Keys that occur once in the corpus cannot hold a repeated window; their text is not moved.
* Equal runs have equal fates, so at most two copies of each enter a suffix array.
* A key with very many different runs (the borders of a passage that countless documents share)
  is dealt again by longer k-grams, down to the whole window, where equal keys are equal windows.
  So no group grows with the corpus.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import U, bit_filter, mix, passes, seeds, utf8
from docloom.llm.suffixes import padded, repeated
from docloom.plans.scratch import materialize

DEPTH = 200
#: Lengths of the k-grams that deal windows, as shares of the window: first, then for groups of
#: more than ``KINDS`` different runs.
SHARES = (0.4, 0.75, 0.95, 1.0)
KINDS = 4000
#: Bytes cut into runs at a time, and bytes of a suffix array, about.
CHUNK = 1 << 20
BLOCK = 1 << 21
#: Runs and texts that a task remembers to move no more than two copies of each.
REMEMBER = 200_000
#: Fixed size (8 MB) of the filter of keys that occur more than once.
FILTER_BITS = 26

LETTER = seeds(256, 11) | U(1)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPANS = "array<struct<start: int, stop: int>>"


class _Powers:
    """Powers of the base of the rolling hash and of its inverse, as far as needed so far."""

    up = down = np.ones(1, dtype=U)

    @classmethod
    def reach(cls, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size > len(cls.up):
            made = []
            for base in (BASE, INVERSE):
                powers = np.full(size, base, dtype=U)
                powers[0] = 1
                made.append(np.multiply.accumulate(powers))
            cls.up, cls.down = made
        return cls.up[:size], cls.down[:size]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row, from running minima of whole blocks."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width) + 1
    table = np.full(blocks * width, U(0xFFFFFFFFFFFFFFFF))
    table[: len(values)] = values
    table = table.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


class Runs:
    """Runs of the windows of several texts, given one after another with their sizes: arrays
    ``start``, ``windows``, ``key`` and ``weight``.

    Runs are cut so that they have no more windows than a window has k-grams. ``weight`` is 2 if two
    windows of a run may be equal: in text with a short period the key comes from several places.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, depth: int, gram: int, order: int):
        self.depth, self.gram = depth, gram
        count, width = len(codes) - depth + 1, depth - gram + 1
        up, self._down = _Powers.reach(len(codes) + 1)
        self._sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum(LETTER[codes] * up[:-1])))
        grams = (self._sums[gram:] - self._sums[:-gram]) * self._down[: len(codes) - gram + 1]
        grams = mix(grams ^ seeds(order + 1, 12)[order])
        # The place in the low bits makes the first of equal hashes the smallest.
        low = (U(1) << U(len(codes).bit_length())) - U(1)
        place = sliding_minimum((grams & ~low) | np.arange(len(grams), dtype=U), width)[:count]
        place = (place & low).astype(np.int64)
        least = grams[place]
        ends = np.cumsum(sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)[:count]
        at = np.arange(count)
        inside = at + depth <= ends[text]
        first = np.ones(count, dtype=bool)
        first[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
        begun = np.maximum.accumulate(np.where(first, at, 0))
        start = np.flatnonzero(inside & ((at - begun) % width == 0))
        # A run ends before the next one or, as the last of its text, with the text's last window.
        stop = np.minimum(np.append(start[1:], count), ends[text[start]] - depth + 1)
        # Smallest hashes are small numbers; mixed again they spread evenly.
        self.start, self.windows, self.key = start, stop - start, mix(least[start] + U(1))
        self.weight = 1 + (place[start] != place[stop - 1])

    def only(self, keep: np.ndarray) -> "Runs":
        """The runs that ``keep`` flags."""
        for name in ("start", "windows", "key", "weight"):
            setattr(self, name, getattr(self, name)[keep])
        return self

    def names(self) -> np.ndarray:
        """Hashes of the runs' whole texts."""
        stop = self.start + self.windows + self.depth - 1
        return mix((self._sums[stop] - self._sums[self.start]) * self._down[self.start] + self.windows.astype(U))


def _chunks(batches, depth: int):
    """Texts of at least ``depth`` bytes in chunks: (codes, sizes, rows), where rows has the two
    keys of each text and the offset in it. Of equal texts a task passes on two; a long text is
    cut so that each window is in one part."""
    held, rows, size = [], [], 0
    copies: dict[tuple[int, int], int] = {}

    def chunk():
        codes = np.frombuffer(b"".join(held), dtype=np.uint8)
        return codes, np.array([len(x) for x in held]), rows

    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        for key, data in zip(keys, utf8(batch.column(2)), strict=True):
            if len(data) < depth or copies.get(key, 0) > 1:
                continue
            if len(copies) >= REMEMBER:
                copies.clear()
            copies[key] = copies.get(key, 0) + 1
            for at in range(0, len(data) - depth + 1, CHUNK):
                held.append(data[at : at + CHUNK + depth - 1])
                rows.append((*key, at))
                size += len(held[-1])
                if size >= CHUNK:
                    yield chunk()
                    held, rows, size = [], [], 0
    if held:
        yield chunk()


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _repeated_keys(texts: DataFrame, depth: int, gram: int, order: int) -> DataFrame:
    """Keys that more than one run of the corpus has."""

    def count(batches):
        for codes, sizes, _ in _chunks(batches, depth):
            cut = Runs(codes, sizes, depth, gram, order)
            yield pa.RecordBatch.from_arrays([_signed(cut.key), pa.array(cut.weight)], ["key", "n"])

    counted = texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.where("n > 1").select("key")


RUNS = "p long, q long, at int, key long, name long, piece binary"


def _find_runs(texts: DataFrame, depth: int, gram: int, order: int, known) -> DataFrame:
    """Runs whose key passes ``known``, with the keys (p, q) of their text and the offset in it.
    Of equal runs in a task the first carries its bytes, the second none, the others null."""

    def find(batches):
        copies: dict[int, int] = {}
        for codes, sizes, rows in _chunks(batches, depth):
            cut = Runs(codes, sizes, depth, gram, order)
            cut = cut.only(passes(known.value, cut.key, 64, FILTER_BITS))
            start, names = cut.start, cut.names()
            if not len(start):
                continue
            begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            text = np.searchsorted(begin, start, side="right") - 1
            home = np.array(rows, dtype=np.int64)[text]
            data = codes.tobytes()
            stops = start + cut.windows + depth - 1
            pieces = []
            for at, stop, name in zip(start.tolist(), stops.tolist(), names.tolist(), strict=True):
                seen = copies.get(name, 0)
                if seen > 1:
                    pieces.append(None)
                    continue
                if len(copies) >= REMEMBER:
                    copies.clear()
                copies[name] = seen + 1
                pieces.append(b"" if seen else data[at:stop])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(home[:, 0]),
                    pa.array(home[:, 1]),
                    pa.array((home[:, 2] + start - begin[text]).astype(np.int32)),
                    _signed(cut.key),
                    _signed(names),
                    pa.array(pieces, pa.binary()),
                ],
                ["p", "q", "at", "key", "name", "piece"],
            )

    return texts.mapInArrow(find, RUNS)


def _block(rows: list[tuple[int, int, bytes]], depth: int) -> pa.RecordBatch:
    """(key, name, spans): the starts of repeated windows in the pieces of whole groups."""
    sizes = np.array([len(piece) for _, _, piece in rows])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    codes = padded(b"\0".join(piece for _, _, piece in rows), depth)
    edges = np.zeros(len(codes) + 1, dtype=np.int64)
    edges[begin] = 1
    edges[begin + sizes - depth + 1] -= 1
    flags = repeated(codes, np.cumsum(edges)[:-1] > 0, depth)
    # Windows of two pieces are never next to each other, so every stretch is in one piece.
    change = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    starts, stops = change[::2], change[1::2]
    piece = np.searchsorted(begin, starts, side="right") - 1
    found: dict[tuple[int, int], list] = {}
    taken: dict[tuple[int, int], int] = {}
    for at, start, stop in zip(piece.tolist(), starts.tolist(), stops.tolist(), strict=True):
        key = rows[at][:2]
        if taken.setdefault(key, at) == at:  # the second copy says the same
            origin = int(begin[at])
            found.setdefault(key, []).append({"start": start - origin, "stop": stop - origin})
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _ in found], pa.int64()),
            pa.array([n for _, n in found], pa.int64()),
            pa.array(list(found.values()), span),
        ],
        ["key", "name", "spans"],
    )


def _sort_groups(pieces: DataFrame, depth: int) -> DataFrame:
    """(key, name, spans) of runs with repeated windows; each key's pieces share a partition. A
    piece without bytes says that there is one more copy."""

    def sort(batches):
        rows, size, last, copies = [], 0, None, 0
        for batch in batches:
            for key, name, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                copies = copies + 1 if last == (key, name) else 1
                if copies > 2:
                    continue
                if size >= BLOCK and last[0] != key:
                    yield _block(rows, depth)
                    rows, size = [], 0
                # The bytes come first among equal names.
                rows.append((key, name, piece if copies == 1 else rows[-1][2]))
                size += len(rows[-1][2])
                last = (key, name)
        if rows:
            yield _block(rows, depth)

    placed = pieces.select("key", "name", "piece").repartition("key")
    placed = placed.sortWithinPartitions("key", "name", F.col("piece").desc())
    return placed.mapInArrow(sort, f"key long, name long, spans {SPANS}")


def _lift(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Spans of the texts (p, q) from those of their runs."""
    moved = F.transform(
        "spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["stop"] + F.col("at")).alias("stop"))
    )
    rows = found.select("p", "q", "at", "key", "name").join(verdicts, ["key", "name"])
    # Copies of a text give its spans more than once.
    return rows.groupBy("p", "q").agg(F.flatten(F.collect_set(moved)).alias("spans"))


def _with_bytes(pieces: DataFrame) -> DataFrame:
    """The pieces of crowded keys; one that stands for a second copy gets the bytes of the first."""
    bytes_ = pieces.groupBy("key", "name").agg(F.max("piece").alias("piece"), F.count("*").alias("n"))
    copies = F.when(F.col("n") > 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return bytes_.select("key", "name", "piece", F.explode(copies))


def _spans(texts: DataFrame, depth: int, level: int = 0) -> DataFrame:
    """(p, q, spans): starts of the repeated windows of the texts (p, q, text)."""
    spark = texts.sparkSession
    gram = max(1, int(depth * SHARES[level]))
    keys = materialize(_repeated_keys(texts, depth, gram, level), "keys")
    known = spark.sparkContext.broadcast(bit_filter(keys, "key", 64, FILTER_BITS))
    found = materialize(_find_runs(texts, depth, gram, level, known), "runs")
    pieces = found.where("piece is not null")
    # Equal keys of the last level are equal windows, whatever their number.
    last = level + 1 == len(SHARES)
    crowded = None
    if not last:
        kinds = found.groupBy("key", "name").agg(F.lit(1).alias("one")).groupBy("key").count()
        crowded = materialize(kinds.where(F.col("count") > KINDS).select("key"), "crowded")
        last = crowded.isEmpty()
    small = pieces if last else pieces.join(crowded, "key", "left_anti")
    verdicts = _sort_groups(small, depth)
    verdicts = materialize(verdicts, "verdicts")
    if not last:
        again = _with_bytes(pieces.join(crowded, "key", "left_semi"))
        again = again.select(F.col("key").alias("p"), F.col("name").alias("q"), F.col("piece").alias("text"))
        deeper = _spans(again, depth, level + 1)
        verdicts = verdicts.unionByName(
            deeper.select(F.col("p").alias("key"), F.col("q").alias("name"), "spans")
        )
    return materialize(_lift(found, verdicts), "spans")


def _cover(spans: list, depth: int) -> list[tuple[int, int]]:
    """Byte ranges that windows starting in ``spans`` cover, joined where they touch."""
    out: list[list[int]] = []
    for start, stop in sorted((s["start"], s["stop"] + depth - 1) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): whole texts as UTF-8 bytes without what is repeated.

    ``removed`` lists the maximal removed ranges (start, stop) in order, ``kept`` is the rest. A byte is
    removed if a string of ``depth`` bytes that covers it also starts elsewhere in the table, in the
    same or another row; all strings are those of the input. Null and short texts lose nothing;
    repeated rows are copies of one another and lose all of a text of ``depth`` bytes or more. Other
    columns are not read. An empty table gives an empty result.
    """
    if depth < 8:
        raise ValueError("depth must be 8 or more")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(text, 256)
    keys = [F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17)]
    texts = docs.select(keys[0].alias("p"), keys[1].alias("q"), text.alias("text"))
    spans = _spans(texts, depth)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), keys[0].alias("p"), keys[1].alias("q"), text.alias("text"))
    rows = rows.join(spans, ["p", "q"], "left").select("doc_id", "text", "spans")

    def cut(batches):
        ranges = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            sizes, removed, kept = [], [], []
            for data, found in zip(utf8(batch.column(1)), batch.column(2), strict=True):
                gone = _cover(found.as_py() or [], depth)
                stops = [0, *[b for _, b in gone]]
                starts = [*[a for a, _ in gone], len(data)]
                sizes.append(len(data))
                removed.append([{"start": a, "stop": b} for a, b in gone])
                kept.append(b"".join(data[a:b] for a, b in zip(stops, starts, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, ranges), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "removed", "kept"],
            )

    return rows.mapInArrow(cut, f"doc_id long, n_bytes long, removed {SPANS}, kept binary")


def removal_digest(removed: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of a result of ``remove_repeats``."""
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    return removed.select(
        "doc_id",
        "n_bytes",
        total.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
