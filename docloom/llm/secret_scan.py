"""Secret scans: candidate strings judged by a random forest.

Candidates are long runs of letters, digits and a few signs, and from 8 characters on whatever
is given to a name such as ``password``. The forest sees their length,
character transitions, dictionary coverage (letter trigrams counted over the whole corpus),
the path they come from and the neighbouring words; it is trained by Spark from labelled
findings and a generated sample, and read back as plain arrays, so that finding, judging and masking are one pass over
the documents without a join.
"""

import hashlib
import random
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import slices, texts
from docloom.plans.scratch import materialize, scratch_path

CANDIDATE = re.compile(r"[A-Za-z0-9_+/.~-]{16,}(?:={1,2}(?![A-Za-z0-9_+/=.~-]))?", re.ASCII)
GIVEN = re.compile(r"[=:]")
#: What is given to a name: a quoted text of one line, or all signs up to white space or a quote.
VALUE = re.compile(
    r"""[=:]>?[ \t]*(?:"([^"\n]{8,})"|'([^'\n]{8,})'|`([^`\n]{8,})`|(?![=:])([^\s"'`,;]{8,}))"""
)
NAME = re.compile(r"([\w.-]+)[\"'`\]]{0,2}[ \t]*[=:]?$")
PEM = re.compile(
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    r"(?:\s*+[A-Za-z-]+: [^\n]*\n)*+([A-Za-z0-9+/=\s\\]*+)"
)
MASK = "[SECRET]"
#: The forest is fitted on at most so many findings of each label, chosen by hash.
SAMPLE = 5_000
TREES, DEPTH, SEED = 25, 6, 11
#: Letter trigrams that make up this share of all are the dictionary.
COMMON = 0.98
REACH = 40
LETTERS = np.zeros(256, dtype=np.int64)
LETTERS[97:123] = LETTERS[65:91] = np.arange(1, 27)
SIDE = 27
#: Words beside a finding or in its path that mark secrets, or samples of them.
NAMING = re.compile(r"token|secret|passw|api|auth|bearer|credential|private|access|key", re.I)
SAMPLES = re.compile(r"test|example|sample|dummy|fixture|mock|doc", re.I)
FEATURES = [
    "length", "digits", "upper", "signs", "switches", "distinct", "hexadecimal", "dictionary",
    "named", "assigned", "quoted", "bounded", "prose_before", "prose_after", "path_sample",
    "path_naming", "dotted", "given", "pem", "lower", "spaces", "prefix",
]


def _trigrams(data: bytes) -> np.ndarray:
    codes = LETTERS[np.frombuffer(data, dtype=np.uint8)]
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    return ((a * SIDE + b) * SIDE + c)[(a > 0) & (b > 0) & (c > 0)]


def dictionary(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Which of the 27**3 letter trigrams are common, counted over all documents."""

    def count(batches):
        total = np.zeros(SIDE**3, dtype=np.int64)
        for batch in slices(batches, 50):
            data = " ".join(texts(batch.column(0))).encode("utf-8", "replace")
            total += np.bincount(_trigrams(data), minlength=SIDE**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "gram long, n long")
    frame = counts.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").toPandas()
    known = np.zeros(SIDE**3, dtype=bool)
    share = frame["n"].cumsum() / max(1, frame["n"].sum())
    known[frame["gram"][share <= COMMON].to_numpy(dtype=np.int64)] = True
    return known


def spans(text: str) -> list[tuple[int, int]]:
    """Starts and ends of all candidates in order; values may hold or cross long runs."""
    found = {m.span() for m in CANDIDATE.finditer(text)}
    done = 0
    for sign in GIVEN.finditer(text):
        at = sign.start()
        if at < done or not _named(text, at):
            continue
        if hit := VALUE.match(text, at):
            start, done = hit.span(hit.lastindex)
            if hit.lastindex == 4:
                done = start + max(8, len(text[start:done].rstrip(")]}>")))
            found.add((start, done))
    return sorted(found)


def _named(text: str, at: int) -> bool:
    """Whether the name that ends before the sign at ``at`` marks secrets."""
    name = NAME.search(text[max(0, at - REACH) : at])
    return bool(name and NAMING.search(name[1]))


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Starts and ends of the bodies of PEM private keys."""
    return [m.span(1) for m in PEM.finditer(text)] if "-----BEGIN " in text else []


def features(
    text: str, start: int, end: int, path: str, known: np.ndarray, blocks: list[tuple[int, int]]
) -> list[float]:
    """Numbers about text[start:end], in the order of ``FEATURES``."""
    value = text[start:end]
    size = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in value]
    grams = _trigrams(value.encode())
    before, after = text[max(0, start - REACH) : start], text[end : end + REACH]
    lead = before.rstrip("\"'` >")
    near_before, near_after = before.split(), after.split()
    return [
        float(min(size, 512)),
        kinds.count("d") / size,
        kinds.count("u") / size,
        kinds.count("s") / size,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / size,
        len(set(value)) / min(size, 64),
        sum(c in "0123456789abcdefABCDEF" for c in value) / size,
        float(known[grams].sum() / max(1, size - 2)),
        float(bool(NAMING.search(before))),
        float(lead.endswith(("=", ":"))),
        float(before[-1:] in "\"'`" and before[-1:] != ""),
        float(not after or not after[0].isalnum()),
        sum(w.isalpha() for w in near_before[-4:]) / 4,
        sum(w.isalpha() for w in near_after[:4]) / 4,
        float(bool(SAMPLES.search(path))),
        float(bool(NAMING.search(path))),
        value.count(".") / size,
        float(lead.endswith(("=", ":")) and _named(lead, len(lead) - 1)),
        float(any(low <= start < high for low, high in blocks)),
        kinds.count("l") / size,
        sum(c.isspace() for c in value) / size,
        float(bool(re.match(r"[A-Za-z]{2,6}[_-]", value))),
    ]


@dataclass
class Forest:
    """Trees as arrays: a node's feature (-1: a leaf), threshold, children and probability."""

    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    left: list[np.ndarray]
    right: list[np.ndarray]
    secret: list[np.ndarray]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, threshold, left, right, secret in zip(
            self.feature, self.threshold, self.left, self.right, self.secret, strict=True
        ):
            at = np.zeros(len(rows), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                where = np.flatnonzero(inner)
                node = at[where]
                low = rows[where, feature[node]] <= threshold[node]
                at[where] = np.where(low, left[node], right[node])
            total += secret[at]
        return total / max(1, len(self.feature))


def fit(findings: DataFrame) -> Forest | None:
    """A forest from (features, label 0.0 or 1.0); None unless both labels occur."""
    spark = findings.sparkSession
    labels = {r["label"] for r in findings.select("label").distinct().collect()}
    if labels != {0.0, 1.0}:
        return None
    table = findings.select(array_to_vector("features").alias("features"), "label")
    model = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt"
    ).fit(table)
    path = scratch_path(spark, "forest")
    model.write().save(path)
    return _read_forest(spark, f"{path}/data")


def _read_forest(spark: SparkSession, path: str) -> Forest:
    rows = spark.read.parquet(path).selectExpr(
        "treeID", "nodeData.id", "nodeData.leftChild as l", "nodeData.rightChild as r",
        "nodeData.split.featureIndex as f",
        "get(nodeData.split.leftCategoriesOrThreshold, 0) as t",
        "nodeData.impurityStats as s",
    ).orderBy("treeID", "id").collect()
    trees: dict[int, list] = {}
    for row in rows:
        trees.setdefault(row["treeID"], []).append(row)
    forest = Forest([], [], [], [], [])
    for nodes in trees.values():
        inner = np.array([n["l"] >= 0 for n in nodes])
        forest.feature.append(np.where(inner, [n["f"] for n in nodes], -1))
        forest.threshold.append(np.array([n["t"] if n["l"] >= 0 else 0.0 for n in nodes], dtype=float))
        forest.left.append(np.array([n["l"] for n in nodes]))
        forest.right.append(np.array([n["r"] for n in nodes]))
        forest.secret.append(np.array([n["s"][1] / max(1e-9, sum(n["s"])) for n in nodes]))
    return forest


#: Public formats of keys, by provider prefix or structure.
FORMATS = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{40,}|xox[abprs]-[\w-]{10,}"
    r"|sk-[\w-]{20,}|[sr]k_(?:live|test)_\w{16,}|AIza[\w-]{35}|glpat-[\w-]{20,}|npm_\w{36}"
    r"|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}"
)


def known_format(text: str, start: int, end: int) -> float | None:
    """Labels findings by form: public key formats, and hexadecimal or base64 values given to a
    name, quoted or not, are secrets, numbers and plain lower-case words are not; anything
    else has no label."""
    value = text[start:end]
    before = text[max(0, start - REACH) : start]
    if FORMATS.fullmatch(value):
        return 1.0
    lead = before.rstrip("\"'` >")
    if lead.endswith(("=", ":")) and _named(lead, len(lead) - 1):
        coded = re.fullmatch(r"[0-9a-fA-F]{32,}|[A-Za-z0-9+/_-]{32,}={0,2}", value)
        kinds = [any(map(t, value)) for t in (str.isdigit, str.isalpha)]
        return 1.0 if coded and all(kinds) else None
    if value.isdigit() or re.fullmatch(r"[a-z]+\.?", value) or "@" in before[-1:] + text[end : end + 1]:
        return 0.0
    return None


#: Generated findings of each label.
GENERATED = 1_500


def generated_findings(known: np.ndarray) -> list[tuple[list[float], float]]:
    """(features, label) of ``2 * GENERATED`` findings made up with a fixed seed, so that the
    forest knows forms that the corpus or its labels don't have."""
    rng = random.Random(SEED)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alnum = lower + upper + digits

    def draw(letters: str, low: int, high: int) -> str:
        return "".join(rng.choices(letters, k=rng.randint(low, high)))

    def word(low: int = 2, high: int = 4) -> str:
        return "".join(
            rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") + rng.choice(["", "n", "r", "s", "t"])
            for _ in range(rng.randint(low, high))
        )

    def prose() -> str:
        return " ".join(word(1, 3) for _ in range(rng.randint(0, 7)))

    def name() -> str:
        middle = rng.choice(["token", "secret", "password", "api_key", "passwd", "auth", "access_key",
                             "private_key", "credential", "apikey", "key", "client-secret"])
        full = rng.choice(["", "", word() + "_"]) + middle
        return rng.choice([full, full.upper(), full.title()])

    def assigned(value: str, own: str) -> tuple[str, str, str]:
        before, after = rng.choice(
            [("=", ""), (" = ", ""), (": ", ""), (":", ""), (' = "', '"'), ("='", "'"), (': "', '"'),
             ('": "', '"'), ("=`", "`")]
        )
        return own + before, value, after

    def strong() -> str:
        return rng.choice([
            lambda: draw("0123456789abcdef", 24, 64), lambda: draw("0123456789ABCDEF", 24, 64),
            lambda: draw(alnum, 18, 64), lambda: draw(alnum + "+/", 24, 86) + rng.choice(["", "=", "=="]),
            lambda: draw(alnum + "_-", 20, 64),
            lambda: draw(lower, 2, 5) + rng.choice("_-") + draw(alnum, 20, 48),
            lambda: draw(upper, 4, 4) + draw(upper + digits, 16, 16),
        ])()

    def password() -> str:
        signs = "!@#$%^&*:?+-_="
        value = list(draw(alnum + signs, 5, 17) + rng.choice(upper + signs) + rng.choice(lower) + rng.choice(digits))
        rng.shuffle(value)
        return rng.choice([lambda: "".join(value).lstrip("=:"), lambda: word() + rng.choice(signs[:8]) + draw(digits, 2, 4)
                           + draw(upper + signs[:8], 2, 4)])().ljust(8, "7")

    def jwt() -> str:
        return f"eyJ{draw(alnum, 15, 40)}.eyJ{draw(alnum, 20, 120)}.{draw(alnum + '_-', 30, 60)}"

    def secret() -> tuple[str, str, str]:
        kind = rng.randrange(8)
        if kind < 2:
            return assigned(strong(), name())
        if kind < 4:
            return assigned(password(), name())
        if kind == 4:
            return "\n".join(["", draw(alnum + "+/", 64, 64), ""]), draw(alnum + "+/", 20, 64), "\n"
        if kind == 5:
            return rng.choice(["Authorization: Bearer ", "bearer ", "token "]), rng.choice([jwt, strong])(), ""
        if kind == 6:
            return rng.choice(["", "("]), jwt(), ""
        value = rng.choice([draw(lower, 2, 5) + rng.choice("_-") + draw(alnum, 24, 48),
                            draw(lower, 2, 5) + rng.choice(["_", "-", "_v1_"]) + draw("0123456789abcdef", 32, 64),
                            draw(lower, 4, 4) + "-" + draw(digits, 10, 12) + "-" + draw(alnum, 16, 24),
                            draw(upper, 4, 4) + draw(upper + digits, 16, 16)])
        return rng.choice(["", "", "id "]), value, ""

    def plain() -> tuple[str, str, str]:
        words = [word() for _ in range(rng.randint(3, 6))]
        value = rng.choice([
            lambda: "".join(words), lambda: "".join(words).title(), lambda: "".join(words).upper(),
            lambda: "".join(w.title() for w in words), lambda: "_".join(words), lambda: "-".join(words),
            lambda: "_".join(words).upper(), lambda: ".".join(words), lambda: "/".join(words),
            lambda: "/" + "/".join(words) + ".py", lambda: "--" + "-".join(words),
            lambda: draw(digits, 16, 30), lambda: "-" * rng.randint(16, 60), lambda: "." * rng.randint(16, 60),
            lambda: f"{words[0]}.{words[1]}{draw(digits, 1, 3)}.example.com", lambda: "".join(words) + ".",
            lambda: f"20{draw(digits, 2, 2)}-0{draw(digits, 1, 1)}-1{draw(digits, 1, 1)}T10.{draw(digits, 2, 2)}.00",
        ])()
        kind = rng.randrange(5)
        if kind < 3:
            return rng.choice(["", "", "//", "@", "("]), value, rng.choice(["", ".", ",", "@"])
        if kind == 3:
            return assigned(value, rng.choice([name(), word()]))
        return rng.choice([
            lambda: assigned(" ".join(words), name()),
            lambda: assigned(words[0] + "." + words[1] + "()", name()),
            lambda: assigned(f"your-{words[0]}-here", name()),
            lambda: assigned("<" + "_".join(words) + ">", name()),
            lambda: assigned("${" + "_".join(words).upper() + "}", name()),
            lambda: ("commit ", draw("0123456789abcdef", 40, 40), ""),
            lambda: ("sha256:", draw("0123456789abcdef", 64, 64), ""),
            lambda: ("id ", "-".join(draw("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)), ""),
        ])()

    out = []
    for k in range(2 * GENERATED):
        before, value, after = (plain, secret)[k % 2]()
        block = k % 2 and before.startswith("\n")
        lead = "" if block else prose() + rng.choice([" ", "\n"])
        text = f"{lead}{before}{value}{after}{rng.choice([' ', chr(10)])}{'' if block else prose()}"
        start = len(lead) + len(before)
        path = rng.choice(["", "src3", "app/settings.py", "tests/example.md"])
        row = features(text, start, start + len(value), path, known, [(0, len(text))] if block else [])
        out.append((row, float(k % 2)))
    return out


def labelled_findings(
    docs: DataFrame,
    known,
    label: Callable[[str, int, int], float | None] = known_format,
    path_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(features, label, place): every candidate of ``docs`` that ``label`` decides."""

    def find(batches):
        for batch in slices(batches, 200):
            rows, labels, places = [], [], []
            for path, text in zip(texts(batch.column(0)), texts(batch.column(1)), strict=True):
                blocks = key_blocks(text)
                for start, end in spans(text):
                    given = label(text, start, end)
                    if given is not None:
                        rows.append(features(text, start, end, path, known.value, blocks))
                        labels.append(given)
                        line = text[max(0, start - REACH) : end + REACH]
                        digest = hashlib.sha256(line.encode("utf-8", "replace")).digest()
                        places.append(int.from_bytes(digest[:8], "big", signed=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.list_(pa.float64())),
                    pa.array(labels, pa.float64()),
                    pa.array(places, pa.int64()),
                ],
                ["features", "label", "place"],
            )

    columns = docs.select(F.col(path_col).cast("string"), F.col(text_col).cast("string"))
    return columns.mapInArrow(find, "features array<double>, label double, place long")


@dataclass
class Scanner:
    forest: Forest | None
    known: np.ndarray

    def scan(self, text: str, path: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of every candidate, in code points. Of candidates that
        overlap the longest secret stays, or else the longest."""
        found = spans(text)
        if not found or self.forest is None:
            return _apart([(*s, 0.0) for s in found])
        blocks, out = key_blocks(text), []
        for at in range(0, len(found), 4096):
            block = found[at : at + 4096]
            rows = np.array([features(text, *s, path, self.known, blocks) for s in block])
            out += [(*s, float(p)) for s, p in zip(block, self.forest.probability(rows), strict=True)]
        return _apart(out)


def _apart(found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    out: list[tuple[int, int, float]] = []
    cluster: list[tuple[int, int, float]] = []
    reach = 0
    for hit in [*found, None]:
        if cluster and (hit is None or hit[0] >= reach):
            taken: list[tuple[int, int, float]] = []
            for own in sorted(cluster, key=lambda h: (h[2] < 0.5, h[0] - h[1])):
                if all(own[1] <= t[0] or own[0] >= t[1] for t in taken):
                    taken.append(own)
            out += sorted(taken)
            cluster, reach = [], 0
        if hit:
            cluster.append(hit)
            reach = max(reach, hit[1])
    return out


def train(
    docs: DataFrame,
    label: Callable[[str, int, int], float | None] = known_format,
    path_col: str = "source",
    text_col: str = "text",
) -> Scanner:
    """Counts the dictionary over all of ``docs`` and fits the forest on a bounded sample:
    of each label the ``SAMPLE`` findings whose surroundings have the smallest hash, and
    ``generated_findings``, so there is a forest for any corpus."""
    known = dictionary(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    findings = materialize(labelled_findings(docs, shared, label, path_col, text_col), "findings")
    made = [(row, value, k) for k, (row, value) in enumerate(generated_findings(known))]
    sample = docs.sparkSession.createDataFrame(made, "features array<double>, label double, place long")
    for value in (0.0, 1.0):
        part = findings.where(F.col("label") == value).orderBy("place", "features").limit(SAMPLE)
        sample = sample.unionByName(part)
    return Scanner(fit(materialize(sample, "sample").orderBy("place", "features")), known)


def find_secrets(
    docs: DataFrame,
    scanner: Scanner,
    id_col: str = "doc_id",
    path_col: str = "source",
    text_col: str = "text",
    least: float = 0.5,
) -> DataFrame:
    """(doc_id, start, length, sha256, probability) of every secret in every whole document.

    Positions are code points. Null and empty texts have none, a null path counts as empty,
    repeated rows give their own findings. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scanner)

    def find(batches):
        for batch in slices(batches, 200):
            out = []
            for at, (path, text) in enumerate(
                zip(texts(batch.column(1)), texts(batch.column(2)), strict=True)
            ):
                for start, end, p in sent.value.scan(text, path):
                    if p >= least:
                        digest = hashlib.sha256(text[start:end].encode()).hexdigest()
                        out.append((batch.column(0)[at].as_py(), start, end - start, digest, p))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "start", "length", "sha256", "probability"],
            )

    rows = docs.select(
        F.col(id_col).cast("long"), F.col(path_col).cast("string"), F.col(text_col).cast("string")
    )
    return rows.mapInArrow(
        find, "doc_id long, start long, length long, sha256 string, probability double"
    )


def mask_secrets(
    docs: DataFrame,
    scanner: Scanner,
    path_col: str = "source",
    text_col: str = "text",
    size_col: str = "n_chars",
    least: float = 0.5,
) -> DataFrame:
    """All rows and columns of ``docs`` with every secret replaced by ``MASK``.

    ``size_col`` follows where it exists; texts without secrets, also null, stay as they are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scanner)
    names = docs.columns
    path_at, text_at = names.index(path_col), names.index(text_col)
    size_at = names.index(size_col) if size_col in names else None

    def mask(batches):
        for batch in slices(batches, 200):
            columns = list(batch.columns)
            new = columns[text_at].to_pylist()
            sizes = columns[size_at].to_pylist() if size_at is not None else []
            for at, path in enumerate(texts(columns[path_at].cast(pa.string()))):
                text = new[at] or ""
                spans = [s for s in sent.value.scan(text, path) if s[2] >= least]
                if spans:
                    parts, done = [], 0
                    for start, end, _ in spans:
                        parts += [text[done:start], MASK]
                        done = end
                    new[at] = "".join([*parts, text[done:]])
                    if sizes:
                        sizes[at] = len(new[at])
            columns[text_at] = pa.array(new, columns[text_at].type)
            if size_at is not None:
                columns[size_at] = pa.array(sizes, columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(mask, docs.schema)
