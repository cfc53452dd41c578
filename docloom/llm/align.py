"""Alignment of two tokenizations by lockstep merging.

Tokens of A and B are laid out as the byte offsets where they end. One state vector holds a pair
of pointers for every document of a batch; each step compares the two offsets of all of them at
once, advances the pointer that lies behind, emits a link and a cut where both end together, and
drops the finished documents from the vector. A long document enters as several lanes that
start where both tokenizations are known to end together, so the number of steps has a bound.
"""

import hashlib
import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import texts
from docloom.plans.scratch import materialize

#: Tokens of A in a lane, about.
LANE = 4096
#: Documents and characters encoded and merged at a time; a longer document is a batch by itself.
ROWS, CHARS = 1000, 2_500_000
#: Characters of the words that a task remembers with their ids of A; beyond it starts anew.
REMEMBER = 4_000_000
#: Words encoded as one text.
TOGETHER = 2000
#: A space next to more white space: A takes such texts as a whole.
WIDE_SPACE = re.compile(r" \s|\s ")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Two tokenizers with the bytes of their tokens, and all id pairs that can end together.

    Where two tokens end at one offset, the shorter one's bytes are a suffix of the longer one's.
    The vocabularies alone thus give every possible pair, so tables by pair have a fixed size.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            if all(c in alphabet for c in token):
                self.a_bytes[i] = bytes(alphabet[c] for c in token)
            else:
                self.a_bytes[i] = token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i) or re.fullmatch("<0x[0-9A-F]{2}>", piece):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.b_bytes.append(piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (
            np.array([len(t) for t in tokens]) for tokens in (self.a_bytes, self.b_bytes)
        )
        self.codes = self._possible()
        first, later = ",".encode(), "|".encode()
        self.a_names = [f"{i}".encode() + s for s in (first, later) for i in range(len(self.a_bytes))]
        self.b_names = [f"{i}".encode() + s for s in (first, b";") for i in range(len(self.b_bytes))]
        self.names = self.a_names + self.b_names
        self._forget()

    def _possible(self) -> np.ndarray:
        """Sorted codes a * |B| + b of the pairs whose bytes end alike."""
        ids: list[dict[bytes, list[int]]] = []
        for tokens in (self.a_bytes, self.b_bytes):
            known: dict[bytes, list[int]] = {}
            for i, token in enumerate(tokens):
                known.setdefault(token, []).append(i)
            ids.append(known)
        found = set()
        width = len(self.b_bytes)
        for a, token in enumerate(self.a_bytes):
            for at in range(len(token)):
                found.update(a * width + b for b in ids[1].get(token[at:], ()))
        for b, token in enumerate(self.b_bytes):
            for at in range(len(token)):
                found.update(a * width + b for a in ids[0].get(token[at:], ()))
        return np.array(sorted(found), dtype=np.int64)

    def _forget(self) -> None:
        """Rows of known words, and their ids one after another."""
        self._row: dict[str, int] = {}
        self._chars = 0
        self._ids, self._sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encode words with the space before them; many at once, cut by the bytes of their tokens."""
        ids, sizes = [self._ids], [self._sizes]
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            text = " " + " ".join(part)
            (encoding,) = self.a.encode_batch_fast([text], add_special_tokens=False)
            made = np.array(encoding.ids, dtype=np.int64)
            ends = np.cumsum([len(w.encode()) + 1 for w in part])
            stops = np.searchsorted(np.cumsum(self.a_size[made]), ends) + 1
            ids.append(made)
            sizes.append(np.diff(stops, prepend=0))
        self._row.update(zip(words, range(len(self._row), len(self._row) + len(words)), strict=True))
        self._chars += sum(map(len, words))
        self._ids, self._sizes = np.concatenate(ids), np.concatenate(sizes)

    def _encode_a(self, spaced: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A, one text after another, and their offsets. A cuts a text ahead of every single
        space between other characters, so the words between such spaces are encoded once each."""
        if self._chars > REMEMBER:
            self._forget()
        split = [[] if len(t) == 1 or WIDE_SPACE.search(t) else t[1:].split(" ") for t in spaced]
        new = set().union(*split).difference(self._row)
        self._learn(list(new))
        counts = np.array([len(words) for words in split], dtype=np.int64)
        rows = np.fromiter(map(self._row.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        before = np.cumsum(self._sizes) - self._sizes
        sizes = np.concatenate(([0], np.cumsum(self._sizes[rows])))
        ids = self._ids[_expand(before[rows], self._sizes[rows])]
        starts = sizes[np.concatenate(([0], np.cumsum(counts)))]
        whole = [i for i, t in enumerate(spaced) if len(t) > 1 and not split[i]]
        if not whole:
            return ids, starts
        parts = [ids[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        made = self.a.encode_batch_fast([spaced[i] for i in whole], add_special_tokens=False)
        for i, encoding in zip(whole, made, strict=True):
            parts[i] = np.array(encoding.ids, dtype=np.int64)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A with their offsets by text, and the same of B; none for a text whose tokens'
        bytes differ from space + text on either side."""
        spaced = [" " + t for t in batch]
        a, a_from = self._encode_a(spaced)
        b, b_from = _flat(self.b.encode(batch, num_threads=1))
        data = [t.encode() for t in spaced]
        size = np.array([len(d) for d in data])
        good = size > 1
        for ids, starts, sizes in ((a, a_from, self.a_size), (b, b_from, self.b_size)):
            ends = np.concatenate(([0], np.cumsum(sizes[ids])))
            good &= np.diff(ends[starts]) == size
        a, a_from, b, b_from = *_only(good, a, a_from), *_only(good, b, b_from)
        asked = np.frombuffer(b"".join(d for d, g in zip(data, good, strict=True) if g), dtype=np.uint8)
        wrong = (self._spell(a, self.a_bytes, self.a_size) != asked) | (
            self._spell(b, self.b_bytes, self.b_size) != asked
        )
        if wrong.any():
            text = np.repeat(np.flatnonzero(good), size[good])
            good[text[wrong]] = False
            a, a_from, b, b_from = *_only(good, a, a_from), *_only(good, b, b_from)
        return a, a_from, b, b_from

    @staticmethod
    def _spell(ids, tokens, sizes) -> np.ndarray:
        """The bytes of tokens one after another."""
        letters = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        return letters[_expand((np.cumsum(sizes) - sizes)[ids], sizes[ids])]


def _expand(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each pair, ``sizes`` numbers each."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _only(good: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets with none left for texts that are not ``good``."""
    if good.all():
        return ids, starts
    sizes = np.diff(starts)
    return ids[np.repeat(good, sizes)], np.concatenate(([0], np.cumsum(sizes * good)))


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Pair:
    """Loaded once in each worker."""
    return Pair(a_path, b_path)


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A and B end together: one flag for each token.

    ``lanes`` has rows (first of A, past the last of A, first of B, past the last of B); within a
    lane the offsets rise and the last ones agree.
    """
    a_cut = np.zeros(len(a_ends), dtype=bool)
    b_cut = np.zeros(len(b_ends), dtype=bool)
    a, a_stop, b, b_stop = lanes[(lanes[:, 1] > lanes[:, 0]) & (lanes[:, 3] > lanes[:, 2])].T.copy()
    while len(a):
        x, y = a_ends[a], b_ends[b]
        together = x == y
        a_cut[a[together]] = True
        b_cut[b[together]] = True
        # The pointer that lies behind goes on; both do where the offsets agree.
        a += x <= y
        b += y <= x
        going = (a < a_stop) & (b < b_stop)
        if not going.all():
            a, a_stop, b, b_stop = a[going], a_stop[going], b[going], b_stop[going]
    return a_cut, b_cut


def _lanes(a_ends, b_ends, a_from, b_from, lane: int) -> np.ndarray:
    """One lane for each document, more for a long one; ``a_from`` and ``b_from`` are offsets
    of the documents' tokens."""
    out = []
    for a, a_stop, b, b_stop in zip(a_from[:-1], a_from[1:], b_from[:-1], b_from[1:], strict=True):
        while a_stop - a > lane:
            # Start the next lane after the first common end from here on; the last end is one.
            ahead = a_ends[a + lane - 1 : a_stop]
            at = np.searchsorted(b_ends[b:b_stop], ahead)
            common = int(np.argmax(b_ends[b + np.minimum(at, b_stop - b - 1)] == ahead))
            a_next, b_next = a + lane + common, b + int(at[common]) + 1
            out.append((a, a_next, b, b_next))
            a, b = a_next, b_next
        out.append((a, a_stop, b, b_stop))
    return np.array(out, dtype=np.int64).reshape(-1, 4)


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, and the offsets of the documents in it."""
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    return np.fromiter(chain.from_iterable(rows), np.int64, int(starts[-1])), starts


def _ends(ids, starts, sizes) -> np.ndarray:
    """Byte offset behind each token, counted from its document's start."""
    ends = np.cumsum(sizes[ids])
    before = np.concatenate(([0], ends))[starts[:-1]]
    return ends - np.repeat(before, np.diff(starts))


def align(a, a_from, b, b_from, pair: Pair, lane: int = LANE):
    """For a batch of documents: ids, cuts and document offsets of both sides."""
    a_ends, b_ends = _ends(a, a_from, pair.a_size), _ends(b, b_from, pair.b_size)
    a_cut, b_cut = lockstep(a_ends, b_ends, _lanes(a_ends, b_ends, a_from, b_from, lane))
    return a, a_cut, a_from, b, b_cut, b_from


def group_lines(a, a_cut, a_from, b, b_cut, b_from, pair: Pair) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document.

    Tokens and the separators after them are put at their places in one array: a token of A stands
    behind the B tokens of earlier groups, one of B behind the A tokens up to its own group.
    """
    a_group = np.concatenate(([0], np.cumsum(a_cut)))[:-1]
    b_group = np.concatenate(([0], np.cumsum(b_cut)))[:-1]
    a_last, b_last = np.flatnonzero(a_cut), np.flatnonzero(b_cut)
    b_before = np.concatenate(([0], b_last + 1))
    line = np.empty(len(a) + len(b), dtype=np.int64)
    line[np.arange(len(a)) + b_before[a_group]] = a + len(pair.a_bytes) * a_cut
    shift = 2 * len(pair.a_bytes)
    line[np.arange(len(b)) + a_last[b_group] + 1] = shift + b + len(pair.b_bytes) * b_cut
    starts, name = a_from + b_from, pair.names.__getitem__
    return [
        b"".join(map(name, line[at:stop].tolist()))[:-1]
        for at, stop in zip(starts[:-1], starts[1:], strict=True)
    ]


def _chunks(batches: Iterable[pa.RecordBatch]):
    """(ids, texts) of a bounded number of documents and characters."""
    ids, held, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), texts(batch.column(1)), strict=True):
            ids.append(doc_id.as_py())
            held.append(text)
            size += len(text)
            if len(held) >= ROWS or size >= CHARS:
                yield ids, held
                ids, held, size = [], [], 0
    if held:
        yield ids, held


ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "links array<int>"
)


def align_documents(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links) of every whole text.

    A encodes a space and the text, B adds the space itself. ``links`` numbers the linked id pairs
    among ``Pair.codes``. Null and empty texts, and those that a tokenizer does not give back
    byte by byte, have no tokens: zeros and '' instead of a digest. Repeated rows give a row
    each; other columns are not read. Both paths name files that every executor has.
    """

    def work(batches):
        pair = tokenizers(a_path, b_path)
        width = len(pair.b_bytes)
        for ids, held in _chunks(batches):
            a, a_cut, a_from, b, b_cut, b_from = found = align(*pair.encode(held), pair)
            # The n-th cuts of both sides belong together.
            links = np.searchsorted(pair.codes, a[a_cut] * width + b[b_cut]).astype(np.int32)
            cuts = np.concatenate(([0], np.cumsum(a_cut)))[a_from]
            lines = group_lines(*found, pair)
            number = pa.array(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(np.diff(a_from)),
                    pa.array(np.diff(b_from)),
                    number,
                    number,
                    pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in lines], pa.string()),
                    pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(links)),
                ],
                [part.split(" ")[0] for part in ALIGNED.split(", ")],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(work, ALIGNED)


def link_counts(aligned: DataFrame, pair: Pair) -> np.ndarray:
    """How many links of all documents hold each pair of ``pair.codes``.

    Every task adds up its own links first. The result has one number for each pair that the
    vocabularies allow, whatever the corpus.
    """
    size = len(pair.codes)

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["pair", "n"])

    counted = aligned.select("links").mapInArrow(count, "pair long, n long")
    counted = counted.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, dtype=np.int64)
    out[counted["pair"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    return out


def alignment_audit(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``align_documents`` with n_best and count_sum in place of the links.

    ``count_sum`` adds up the corpus-wide counts of a document's linked id pairs; ``n_best`` are
    its links whose count is the highest of their B id, ties included. A text without tokens has
    zeros. Encoding runs once: links are written as pair numbers and read twice.
    """
    pair = tokenizers(a_path, b_path)
    aligned = materialize(align_documents(docs, a_path, b_path, id_col, text_col), "aligned")
    counts = link_counts(aligned, pair)
    b_ids = pair.codes % len(pair.b_bytes)
    highest = np.zeros(len(pair.b_bytes), dtype=np.int64)
    np.maximum.at(highest, b_ids, counts)
    table = docs.sparkSession.sparkContext.broadcast((counts, counts == highest[b_ids]))

    def add(batches):
        number, best = table.value
        for batch in batches:
            links = batch.column(1)
            flat = links.flatten().to_numpy()
            at = np.concatenate(([0], np.cumsum(links.value_lengths().to_numpy()))).astype(np.int64)
            sums = [np.concatenate(([0], np.cumsum(v[flat])))[at] for v in (best, number)]
            yield pa.RecordBatch.from_arrays(
                [c for i, c in enumerate(batch.columns) if i != 1] + [pa.array(np.diff(s)) for s in sums],
                [*[n for n in batch.schema.names if n != "links"], "n_best", "count_sum"],
            )

    names = ["doc_id", "links", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = (
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "n_best long, count_sum long"
    )
    return aligned.select(*names).mapInArrow(add, out).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
