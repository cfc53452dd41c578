"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a byte string has exactly one valid encoding, hence one valid last token. That
token is the only vocabulary entry ending there which is compatible with the last token of
what stands before it. Storing one token per prefix makes an append as cheap as its own bytes,
and an edit as cheap as the bytes until the stored tokens agree again.
"""

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import give_back, slices, texts

#: Pieces and words that a task remembers, the first it meets, and the longest of them.
REMEMBER = 400_000
#: The same where the worker has to leave memory to other steps; words beyond are encoded again.
REMEMBER_BRIEFLY = 100_000
#: Token pairs whose compatibility a task remembers.
REMEMBER_PAIRS = 400_000
REMEMBER_LENGTH = 64
#: A space next to more white space: such texts are split as a whole.
WIDE_SPACE = re.compile(r" \s|\s ")


class Vocabulary:
    """Ranks of a byte-level BPE; a token's rank is its id and the order of its merge."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.remember = REMEMBER
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at], rank), ranks.get(token[at:], rank)
                if left < rank and right < rank and self.compatible(left, right):
                    self.halves[rank] = (left, right)
                    self.merged[left, right] = rank
                    break
        self._pairs: dict[int, bool] = {}
        self._prefixes = Prefixes(self)
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._words: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the tokens stay apart when their bytes stand side by side.

        The later of their merges is undone again and again; they stay apart unless the
        tokens at the border would have merged before it. Of equal merges the left one is
        made first.
        """
        before = None
        while True:
            across = self.merged.get((left, right))
            if across is not None and (before is None or across < before):
                return False
            made_left = left if left in self.halves else -1
            made_right = right if right in self.halves else -1
            if made_left > made_right:
                before, left = left, self.halves[left][1]
            elif made_right >= 0:
                before, right = right + 1, self.halves[right][0]
            else:
                return True

    def _encode_piece(self, piece: str, keep: bool = True) -> tuple[int, ...]:
        if (known := self._pieces.get(piece)) is not None:
            return known
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else self._prefixes.reset(data).ids()
        if keep and len(piece) <= REMEMBER_LENGTH and len(self._pieces) < self.remember:
            self._pieces[piece] = ids
        return ids

    def _encode_span(self, text: str, keep: bool = True) -> tuple[int, ...]:
        """The ids of ``text``; a single piece is not kept where the caller remembers the text."""
        pieces = self.pattern.findall(text)
        if len(pieces) == 1:
            return self._encode_piece(pieces[0], keep)
        return tuple(i for p in pieces for i in self._encode_piece(p))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; each match of the pattern is encoded separately.

        A single space between other characters always starts a match, so words are looked
        up with the space before them. The words that are new in these texts are encoded in
        sorted order: neighbours share prefixes, whose tokens are kept.
        """
        split = [None if WIDE_SPACE.search(t) else t.split(" ") for t in texts]
        new = set().union(*[words[1:] for words in split if words]).difference(self._words)
        spare: dict[str, tuple[int, ...]] = {}
        for word in sorted(new):
            full = len(word) > REMEMBER_LENGTH or len(self._words) >= self.remember
            (spare if full else self._words)[word] = self._encode_span(" " + word, full)
        known = self._words.get
        for text, words in zip(texts, split, strict=True):
            if words is None:
                yield list(self._encode_span(text))
            else:
                first = self._encode_span(words[0])
                ids = chain.from_iterable([known(w) or spare[w] for w in words[1:]])
                yield list(chain(first, ids))

    def forget(self) -> None:
        """Give up what earlier texts left: workers outlive their tasks, and other steps follow."""
        self._pieces.clear()
        self._words.clear()
        self._pairs.clear()
        self._prefixes.reset(b"")

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """The last token of every prefix of a piece, kept up to date under appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def reset(self, data: bytes) -> "Prefixes":
        """Start anew with ``data``, keeping the tokens of the prefix that it shares."""
        at = len(commonprefix((self.data, data)))
        del self.last[at:]
        self.data = data
        self._extend(at + 1, len(data))
        return self

    def append(self, data: bytes) -> None:
        at = len(self.data)
        self.data += data
        self._extend(at + 1, len(self.data))

    def _extend(self, first: int, final: int) -> None:
        """Add the tokens of the prefixes that end from ``first`` to ``final``."""
        v, data, last = self.vocabulary, self.data, self.last
        rank, pairs, longest = v.ranks.get, v._pairs, v.longest
        most_pairs = min(REMEMBER_PAIRS, v.remember)
        for end in range(first, final + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                token = rank(data[start:end])
                if token is None:
                    continue
                if not start:
                    break
                pair = last[start - 1] << 32 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= most_pairs:
                        pairs.clear()
                    fits = pairs[pair] = v.compatible(last[start - 1], token)
                if fits:
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            last.append(token)

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` for the bytes from start to stop; returns the prefixes computed anew.

        A prefix's token depends on its last bytes and the tokens within the longest token's
        reach, so once a run of that length agrees with the old tokens, all later ones do.
        """
        rest = self.last[stop:]
        self.data = self.data[:start] + data + self.data[stop:]
        del self.last[start:]
        fixed = start + len(data)
        agreed = 0
        for end in range(start + 1, len(self.data) + 1):
            self._extend(end, end)
            if end > fixed:
                agreed = agreed + 1 if rest[end - fixed - 1] == self.last[-1] else 0
                if agreed >= self.vocabulary.longest:
                    self.last += rest[end - fixed :]
                    return end - start
        return len(self.data) - start

    def ids(self) -> tuple[int, ...]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return tuple(out[::-1])


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary in a file of base64 tokens and ranks; built once in each worker."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return Vocabulary(ranks, pattern)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text.

    Null and empty texts have no ids; repeated rows give a row each; other columns are not
    read. ``path`` is a file that every executor has, as part of an installed package.
    """

    def encode(batches):
        known = vocabulary(path, pattern)
        for batch in slices(batches, 500):
            ids = list(known.encode_all(list(texts(batch.column(1)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, data): the bytes of the ids; no ids give no bytes."""

    def decode(batches):
        known = vocabulary(path, pattern)
        for batch in slices(batches, 500):
            data = [known.decode(i.as_py() or []) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(data, pa.binary())], ["doc_id", "ids", "data"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(
        decode, "doc_id long, ids array<int>, data binary"
    )


def round_trip(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    remember: bool = True,
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass.

    The ids of a text are hashed and decoded where they are made, so they are not moved. Unless a
    worker is to ``remember`` the words of a task for the next one, it keeps fewer of them and gives
    up their memory.
    """

    def check(batches):
        known = vocabulary(path, pattern)
        known.remember = REMEMBER if remember else REMEMBER_BRIEFLY
        names = {rank: str(rank) for rank in known.tokens}
        for batch in slices(batches, 500):
            counts, listed, decoded = [], [], []
            for ids in known.encode_all(list(texts(batch.column(1)))):
                counts.append(len(ids))
                line = " ".join(map(names.__getitem__, ids))
                listed.append(hashlib.sha256(line.encode()).hexdigest())
                decoded.append(hashlib.sha256(known.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(listed), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        if not remember:
            known.forget()
            batch = counts = listed = decoded = None
            give_back()

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(
        check, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
