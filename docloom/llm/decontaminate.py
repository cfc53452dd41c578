"""Benchmark decontamination by latent semantic retrieval.

Benchmark texts are cut into passages; a distributed randomised SVD of their TF-IDF matrix,
with document frequencies over the whole corpus, gives a latent space. Every window of every
document is projected into it, and windows with a high cosine to a passage are candidates.
So are windows with enough of a passage's rarest words, a bound that no leak can miss.
A candidate counts as a leak when the longest common subsequence of words covers enough of
the passage and the words of its answer part occur in order as
well, so that paraphrases with changed, added or dropped words are found. A task holds the model, whose size is set by the benchmark's words and ``BLOCK``, and
the documents of one small batch.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import U, slices, utf8
from docloom.llm.shingles import word_hashes

#: Words are hashed to so many places; those of benchmark words are the dimensions.
PLACES = 1 << 20
#: Latent dimensions, extra ones for the randomised range finder, and its power iterations.
RANK = 160
EXTRA = 16
POWER = 2
#: Words in a window of a document or a benchmark passage, and between their starts.
WINDOW = 64
STEP = WINDOW // 2
#: Cosine in the latent space that makes a candidate.
COSINE = 0.5
#: Share of a passage's own length in the latent space that the window must reach along it.
REACH = 0.4
#: Share of a passage's words in the common subsequence, and of its answer's words.
SEQUENCE = 0.6
ANSWER = 0.5
#: Benchmark passages that one pass over the documents compares.
BLOCK = 8192

#: ASCII punctuation separates words.
PLAIN = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def words(text: bytes) -> np.ndarray:
    """Hashes of the words, whatever their case and the punctuation around them."""
    lower = text if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return word_hashes(lower.translate(PLAIN))


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - PLACES.bit_length() + 1)).astype(np.int64)


def _windows(count: int) -> list[tuple[int, int]]:
    """Starts and ends of the windows over ``count`` words; the last one ends at the end."""
    starts = range(0, max(1, count - WINDOW + STEP), STEP)
    return [(s, min(count, s + WINDOW)) for s in starts] if count else []


@dataclass
class Passage:
    item: int
    hashes: np.ndarray
    answer: np.ndarray


def passages(item: int, text: bytes) -> list[Passage]:
    """The windows of a benchmark text. The answer is what follows the last question mark or
    ``answer:``, or else the last sentence; every passage is checked for its own part of it."""
    cuts = [m.end() for m in re.finditer(rb"(?i)\?|answer\s*:", text)]
    ends = [m.end() for m in re.finditer(rb"[.!]\s+", text.rstrip())]
    own = words(text)
    tail = next((words(text[c:]) for c in [*cuts[-1:], *ends[-1:]] if len(words(text[c:]))), own)
    begin = len(own) - len(tail)
    out = []
    for start, end in _windows(len(own)):
        answer = own[max(begin, start) : end]
        out.append(Passage(item, own[start:end], answer))
    return out


def subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits."""
    places: dict[int, int] = {}
    for at, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << at
    full = (1 << len(a)) - 1
    row = full
    for word in b.tolist():
        if hit := places.get(word):
            met = row & hit
            row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def _document_frequency(docs: DataFrame, text_col: str, rows_of, size: int) -> tuple[np.ndarray, int]:
    """Documents that hold a word of each dimension, over all documents, and their number."""

    def count(batches):
        total = np.zeros(size + 1, dtype=np.int64)
        documents = 0
        for batch in slices(batches):
            for text in utf8(batch.column(0)):
                documents += 1
                total[np.unique(rows_of.value[_places(words(text))])] += 1
        hit = np.flatnonzero(total[:size])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(hit, -1)), pa.array(np.append(total[hit], documents))], ["row", "n"]
        )

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "row long, n long")
    frame = counts.groupBy("row").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    here = frame[frame["row"] >= 0]
    out[here["row"].to_numpy(dtype=np.int64)] = here["n"].to_numpy()
    return out, int(frame.loc[frame["row"] < 0, "n"].sum())


def _vector(hashes: np.ndarray, lookup: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and unit TF-IDF weights of a benchmark passage."""
    row, times = np.unique(lookup[_places(hashes)], return_counts=True)
    weight = times * idf[row]
    norm = np.sqrt((weight**2).sum())
    return row, weight / norm if norm else weight


def _svd(items: DataFrame, lookup, idf: np.ndarray) -> np.ndarray:
    """Basis (dimensions x RANK) of the passages' TF-IDF matrix by a randomised range finder.

    Tasks multiply their rows; only matrices of the size of the result are added up, in a tree.
    """
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast(idf)
    size = len(idf)

    def multiply(basis: np.ndarray, gram: bool) -> np.ndarray:
        sent = spark.sparkContext.broadcast(basis)

        def part(rows):
            right = sent.value
            width = right.shape[1]
            total = np.zeros((width, width) if gram else (size, width))
            for row in rows:
                for passage in passages(row[0], (row[1] or "").encode("utf-8", "replace")):
                    place, weight = _vector(passage.hashes, lookup.value, shared.value)
                    y = weight @ right[place]
                    if gram:
                        total += np.outer(y, y)
                    else:
                        total[place] += weight[:, None] * y
            yield total

        return items.rdd.mapPartitions(part).treeReduce(np.add)

    rng = np.random.default_rng(7)
    width = min(size, RANK + EXTRA)
    basis = np.linalg.qr(rng.standard_normal((size, width)))[0]
    for _ in range(POWER + 1):
        basis = np.linalg.qr(multiply(basis, False))[0]
    values, vectors = np.linalg.eigh(multiply(basis, True))
    order = np.argsort(values)[::-1][:RANK]
    return (basis @ vectors[:, order]).astype(np.float32)


def _least(size: int) -> int:
    """Words of a passage of ``size`` words that the common subsequence must have."""
    need = int(SEQUENCE * size)
    while need < 1 or need / size < SEQUENCE:
        need += 1
    return need


@dataclass
class Overlap:
    """For every dimension the passages that have it among their rarest words.

    A subsequence of ``need`` out of n words misses n - need, so of any n - need + k words of the
    passage at least k occur in the region: regions with fewer cannot hold the passage. This
    needs no latent space, so no passage is lost to its rank or to a cosine.
    """

    begin: np.ndarray  # the first posting of each dimension, and the end of the last
    passage: np.ndarray
    least: np.ndarray  # k of each passage
    wide: np.ndarray  # passages whose regions reach two steps beyond the window, not one

    @staticmethod
    def build(items: list[Passage], lookup: np.ndarray, idf: np.ndarray) -> "Overlap":
        rows, owners, least = [], [], []
        for at, item in enumerate(items):
            own = lookup[_places(item.hashes)]
            need = _least(len(own))
            least.append((need + 3) // 4)
            rarest = own[np.argsort(-idf[own], kind="stable")][: len(own) - need + least[-1]]
            rows.append(rarest)
            owners.append(np.full(len(rarest), at))
        row, owner = np.concatenate(rows), np.concatenate(owners)
        order = np.argsort(row, kind="stable")
        begin = np.searchsorted(row[order], np.arange(len(idf) + 1))
        wide = np.array([len(x.hashes) > STEP for x in items])
        return Overlap(begin, owner[order], np.array(least), wide)

    def candidates(self, row: np.ndarray, low: int, high: int) -> np.ndarray:
        """Which windows from step low to high may hold which passage, for a document's rows."""
        size, count, first = len(self.begin) - 1, len(self.least), low - 2
        at = np.arange(max(0, first) * STEP, min(len(row), (high + 3) * STEP))
        at = at[row[at] < size]
        # A word counts once in a step, however often it is repeated.
        key = np.unique((at // STEP - first) * size + row[at])
        step, dimension = key // size, key % size
        begin = self.begin[dimension]
        many = self.begin[dimension + 1] - begin
        ends = np.cumsum(many)
        posting = np.arange(int(many.sum())) + np.repeat(begin - ends + many, many)
        place = np.repeat(step, many) * count + self.passage[posting]
        grid = np.bincount(place, minlength=(high + 3 - first) * count).reshape(-1, count)
        sums = np.zeros((len(grid) + 1, count), dtype=np.int32)
        np.cumsum(grid, axis=0, out=sums[1:])
        near = sums[5 : high - low + 5] - sums[1 : high - low + 1]
        far = sums[6 : high - low + 6] - sums[: high - low]
        return np.where(self.wide, far, near) >= self.least


@dataclass
class LeakModel:
    lookup: np.ndarray  # the dimension of every place, one past the last for other words
    basis: np.ndarray  # IDF-weighted latent vector of every dimension
    vectors: np.ndarray  # unit latent vectors of the passages
    lengths: np.ndarray  # and their lengths
    items: list[Passage]
    overlap: Overlap

    def _latent(self, own: np.ndarray, low: int, high: int) -> np.ndarray:
        """Sums of latent vectors over steps of words: a row for each step from low to high."""
        row = self.lookup[_places(own[low * STEP : high * STEP])]
        known = np.flatnonzero(row < len(self.basis))
        out = np.zeros((high - low, self.basis.shape[1]), dtype=np.float32)
        if len(known):
            step = known // STEP
            first = np.flatnonzero(np.append(True, step[1:] != step[:-1]))
            out[step[first]] = np.add.reduceat(self.basis[row[known]], first, axis=0)
        return out

    def leaks(self, text: bytes) -> dict[int, tuple[float, float]]:
        """item: (cosine, share of its passage found in order), for the items in the text."""
        own = words(text)
        found: dict[int, tuple[float, float]] = {}
        steps = -(-len(own) // STEP)
        row = self.lookup[_places(own)].astype(np.int64)
        for low in range(0, steps, 512):
            high = min(steps, low + 512)
            # A window is two steps, so neighbours overlap by half; the last may be shorter.
            part = self._latent(own, low, min(steps, high + 1))
            count = high - low
            latent = part[:count].copy()
            after = part[1 : count + 1]
            latent[: len(after)] += after
            norms = np.linalg.norm(latent, axis=1, keepdims=True)
            along = latent @ self.vectors.T
            near = along / np.maximum(norms, 1e-9)
            # A window without much of the passage can only point the same way by chance.
            likely = (near >= COSINE) & (along >= REACH * self.lengths)
            rest = self.overlap.candidates(row, low, high) & ~likely
            for w, p in [*np.argwhere(likely).tolist(), *np.argwhere(rest).tolist()]:
                passage = self.items[p]
                if passage.item in found:
                    continue
                start = (low + w) * STEP
                reach = len(passage.hashes)
                region = own[max(0, start - reach) : start + WINDOW + reach]
                present = set(region.tolist())
                if sum(map(present.__contains__, passage.hashes.tolist())) < SEQUENCE * reach:
                    continue
                share = subsequence(passage.hashes, region) / reach
                if share < SEQUENCE:
                    continue
                asked = len(passage.answer)
                if not asked or subsequence(passage.answer, region) >= ANSWER * asked:
                    found[passage.item] = (float(near[w, p]), share)
        return found


def train(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> list[LeakModel]:
    """One model for each block of benchmark passages, all in the same latent space.

    A block takes ``BLOCK`` passages and then the rest of the item that it ends with. Rows without
    an id are left out, equal rows count once, rows of one id with different texts are one item;
    an item without words has no passage, and without any passage there is no model.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.col(item_col).cast("long"), F.col(item_text).cast("string")
    ).where(F.col(item_col).isNotNull())
    blocks: list[list[Passage]] = []
    used = np.zeros(PLACES, dtype=bool)
    # A block ends between items only, so that no item is found by two models.
    for row in items.distinct().orderBy(item_col).toLocalIterator():
        for passage in passages(row[0], (row[1] or "").encode("utf-8", "replace")):
            used[_places(passage.hashes)] = True
            if not blocks or (len(blocks[-1]) >= BLOCK and blocks[-1][-1].item != passage.item):
                blocks.append([])
            blocks[-1].append(passage)
    if not blocks:
        return []
    size = int(used.sum())
    lookup = np.full(PLACES, size, dtype=np.int32)
    lookup[used] = np.arange(size)
    sent = spark.sparkContext.broadcast(lookup)
    frequency, rows = _document_frequency(docs, text_col, sent, size)
    idf = np.log((1 + rows) / (1 + frequency)) + 0.1
    basis = _svd(items, sent, idf)
    models = []
    weighted = (basis * idf[:, None]).astype(np.float32)
    for block in blocks:
        vectors = np.array([weighted[lookup[_places(x.hashes)]].sum(axis=0) for x in block])
        lengths = np.linalg.norm(vectors, axis=1)
        vectors /= np.maximum(lengths, 1e-9)[:, None]
        overlap = Overlap.build(block, lookup, idf)
        models.append(LeakModel(lookup, weighted, vectors, lengths, block, overlap))
    return models


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, cosine, sequence): benchmark items in each whole document.

    Null, empty and blank texts hold nothing, as does everything if the benchmark is empty;
    benchmark rows without an id are left out and repeated ones count once; repeated
    documents give their own rows. Other columns are not read.
    """
    models = train(docs, benchmark, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    schema = "doc_id long, item_id long, cosine double, sequence double"
    out = None
    for model in models:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def find(batches, sent=sent):
            for batch in slices(batches):
                hits = [
                    (doc.as_py(), item, *scores)
                    for doc, text in zip(batch.column(0), utf8(batch.column(1)), strict=True)
                    for item, scores in sent.value.leaks(text).items()
                ]
                if hits:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(x, t)
                            for x, t in zip(
                                zip(*hits, strict=True),
                                [pa.int64(), pa.int64(), pa.float64(), pa.float64()],
                                strict=True,
                            )
                        ],
                        ["doc_id", "item_id", "cosine", "sequence"],
                    )

        part = rows.mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item."""
    for model in train(docs, benchmark, text_col):
        docs = _without(docs, docs.sparkSession.sparkContext.broadcast(model), text_col)
    return docs


def _without(docs: DataFrame, sent, text_col: str) -> DataFrame:
    at = docs.columns.index(text_col)

    def test(batches):
        for batch in slices(batches):
            clean = [not sent.value.leaks(text) for text in utf8(batch.column(at))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(test, docs.schema)
