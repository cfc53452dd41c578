"""Suffix-array removal, tokenizer alignment and the filter audit against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docloom.llm import align, filter_audit, repeats, suffixes

SMALL = "/root/testdata/sf0.001"
A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def by_row(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


# --- suffix arrays and removal ------------------------------------------------------------

def test_two_stage_order_and_repeats_equal_plain_sorting():
    source = random.Random(5)
    for _ in range(400):
        letters = source.choice([b"ab", b"a", b"abc\0", bytes(range(256))])
        data = bytes(source.choice(letters) for _ in range(source.randint(0, 120)))
        if len(data) > 30:
            data += data[5:25] + data
        depth = source.choice([1, 3, 8, 9, 20])
        codes = suffixes.padded(data, depth)
        places = [i for i in range(len(data)) if source.random() < 0.6]
        wanted = np.zeros(len(codes), dtype=bool)
        wanted[places] = True
        ranked = suffixes.suffix_array(codes, wanted, depth).tolist()
        long = data + bytes(depth + 20)
        heads = [long[i : i + depth] for i in ranked]
        assert sorted(ranked) == places and heads == sorted(heads)
        count = Counter(heads)
        again = {i for i, head in zip(ranked, heads, strict=True) if count[head] > 1}
        assert set(np.flatnonzero(suffixes.repeated(codes, wanted, depth)).tolist()) == again


def plain_removal(rows, depth):
    seen = Counter(t[i : i + depth] for _, t in rows for i in range(len(t) - depth + 1))
    out = []
    for doc_id, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if seen[t[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", gone))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return by_row(out)


def removal(spark, rows, depth=repeats.DEPTH):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return by_row(map(tuple, repeats.removal_digest(repeats.remove_repeats(docs, depth)).collect()))


@pytest.mark.parametrize("kinds", [repeats.KINDS, 2])
def test_removal_equals_plain_windows(spark, monkeypatch, kinds):
    """Shared passages in different surroundings, periods, copies and border cases; with few
    kinds allowed every group is dealt again."""
    monkeypatch.setattr(repeats, "KINDS", kinds)
    source = random.Random(8)

    def prose(n):
        return "".join(source.choice("abcdefgh éß日🎉") for _ in range(n))

    passage, short = prose(260), prose(90)
    rows = [(i, prose(source.randint(0, 300)) + passage + prose(source.randint(0, 300))) for i in range(40)]
    rows += [(50 + i, prose(150) + short + prose(150)) for i in range(8)]
    rows += [(60, "x" * 1000), (61, "abc " * 400), (62, "one line\n" * 30), (63, None), (64, "")]
    rows += [(65, prose(500)), (66, "y" * 200), (67, "z" * 201), (68, None), (None, passage), (1, "a" * 199)]
    rows += [(69, "same " + passage), (69, "same " + passage), (70, passage[:130] + passage[131:])]
    want = plain_removal([(i, (t or "").encode()) for i, t in rows], repeats.DEPTH)
    assert removal(spark, rows) == want
    small = [(i, (t or "")[:120]) for i, t in rows]
    assert removal(spark, small, 16) == plain_removal([(i, t.encode()) for i, t in small], 16)


def test_long_texts_are_cut_into_chunks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    monkeypatch.setattr(repeats, "BLOCK", 500)
    source = random.Random(9)
    part = "".join(source.choice("abcdefghij") for _ in range(3000))
    rows = [(1, part + "-" + part[700:2300]), (2, part[2500:] + "?" + part[:400])]
    assert removal(spark, rows) == plain_removal([(i, t.encode()) for i, t in rows], repeats.DEPTH)


# --- alignment ----------------------------------------------------------------------------

def plain_alignment(rows):
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    alphabet = align.byte_alphabet()
    found, pairs = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        left = a.encode(" " + text, add_special_tokens=False) if text else None
        left, tokens = (left.ids, left.tokens) if left else ([], [])
        right = b.encode(text) if text else []
        x = [bytes(alphabet[c] for c in t) for t in tokens]
        y = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
             for i, p in ((i, b.id_to_piece(i)) for i in right)]
        if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            left, right = [], []
        ends = [list(itertools.accumulate(map(len, z))) for z in (x, y)]
        common = sorted(set(ends[0]) & set(ends[1])) if left else []
        links = [(left[ends[0].index(e)], right[ends[1].index(e)]) for e in common]
        pairs.update(links)
        groups, before = [], 0
        for e in common:
            sides = [",".join(str(i) for i, at in zip(ids, es, strict=True) if before < at <= e)
                     for ids, es in ((left, ends[0]), (right, ends[1]))]
            groups.append("|".join(sides))
            before = e
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""
        found.append((doc_id, len(left), len(right), len(groups), links, digest))
    highest = defaultdict(int)
    for (_, right), n in pairs.items():
        highest[right] = max(highest[right], n)
    return by_row(
        (doc_id, n_a, n_b, n, len(links), sum(pairs[p] == highest[p[1]] for p in links),
         sum(pairs[p] for p in links), digest)
        for doc_id, n_a, n_b, n, links, digest in found
    )


@pytest.mark.parametrize("lane", [align.LANE, 3])
def test_alignment_equals_plain_offsets(spark, monkeypatch, lane):
    monkeypatch.setattr(align.align, "__defaults__", (lane,))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [
        (900, None), (901, ""), (902, "<|endoftext|> </s> <0x41> <unk>"), (903, "日本語 🎉 Ünïcödé\t\r\n\x00 x"),
        (904, "  two  spaces "), (905, "▁lower block"), (906, " "), (906, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
        (None, "repeated"), (None, "repeated"), (907, "ﬁ Å é  　"),
    ]
    source = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_row(map(tuple, align.alignment_audit(source, A_PATH, B_PATH).collect()))
    want = plain_alignment(rows)
    assert got == want
    # A text that holds B's own space sign does not come back byte by byte.
    assert [r for r in got if r[0] == 905][0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_every_link_is_among_the_possible_pairs():
    pair = align.tokenizers(A_PATH, B_PATH)
    assert np.all(np.diff(pair.codes) > 0)
    a, b = pair.codes // len(pair.b_bytes), pair.codes % len(pair.b_bytes)
    for at in range(0, len(a), 997):
        x, y = pair.a_bytes[a[at]], pair.b_bytes[b[at]]
        assert x.endswith(y) or y.endswith(x)


# --- filter audit -------------------------------------------------------------------------

def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    low = {}
    for i, text, _ in rows:
        if i is not None:
            low[text or ""] = min(low.get(text or "", i), i)
    docs = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and low[t] < i,
        }
        docs.append((lang or "", {n for n, f in fails.items() if f}, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        made = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                hit = [d for d in left if f in d[1]]
                fails = sum(f in d[1] for d in own)
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(hit)
                made.append((part, "".join(order), step, len(left), len(hit), fails - len(hit),
                             sum(d[1] == {f} for d in own), sum(d[2] for d in hit), sum(d[3] for d in hit), f))
        out += [(*m[:-1], shapley[m[-1]]) for m in made]
    return sorted(out)


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(map(tuple, filter_audit.audit(docs, marks).collect()))


def test_audit_equals_every_order_played_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    marks = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic")
    labels = [tuple(r) for r in marks.collect()]
    same = "word other " * 150
    rows += [(9003, same, "en"), (9001, same, None), (9002, same, "fr"), (9001, same, ""), (None, same, "en"),
             (9004, None, None), (9005, "", "xx"), (None, None, "xx"), (9006, "HASH # " * 300, "en"),
             (9007, "É É\x85 " * 99, "de")]
    labels += [(9002, 1, None), (9002, 0, 1), (None, 1, 1), (9001, 1, 1), (9001, 1, 1)]
    assert audited(spark, rows, labels) == plain_audit(rows, labels)


def test_paths_count_all_orders():
    edges = filter_audit.paths("ABCDE")
    assert len(edges) == 80
    for step in range(5):
        assert sum(w for s, _, w in edges if s.bit_count() == step) == 120
    assert sorted({o for o, *_ in filter_audit.steps("ABCDE")})[0] == "ABCDE"
