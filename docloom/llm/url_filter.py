"""URL filters: rules first, then gradient-boosted trees on lexical features.

Everything is DataFrame functions: features are expressions over the URL, the trees are
Spark's own, fitted on a bounded sample of labelled URLs and applied in the JVM.
"""

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import fresh
from docloom.plans.scratch import materialize

#: (host, path, verdict): the longest rule that fits a URL decides.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: The trees are fitted on at most so many labelled URLs, chosen by hash.
SAMPLE = 10_000
TREES, DEPTH, SEED = 20, 4, 5
#: Counts added to a suffix's, at the overall share of blocked URLs.
PRIOR = 20
FEATURES = [
    "length", "host_length", "path_length", "labels", "depth", "digits", "hyphens", "entropy",
    "parameters", "query_length", "fragment", "secure", "longest_label", "suffix_1", "suffix_2",
]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; a null URL
    or one without ``://`` has an empty host."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where the host is undefined."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """``host/path`` of the longest rule whose host, or a parent of it, and path prefix fit."""
    fits = F.lit(None).cast("string")
    # Later tests stand outside, so the longest comes last.
    for domain, prefix, _ in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[:2])):
        under = (host == domain) | host.endswith(f".{domain}")
        fits = F.when(under & path.startswith(prefix), domain + prefix).otherwise(fits)
    return fits


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits, from the count of each different one."""
    size = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    shares = F.transform(chars, lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size)
    bits = F.aggregate(
        F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.log2(p)
    )
    return F.when(size > 0, bits).otherwise(0.0)


def suffix(host: Column, labels: int) -> Column:
    """The last labels of the host."""
    return F.substring_index(host, ".", -labels)


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """The features that the URL alone gives, in the order of ``FEATURES``."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)
    size = F.greatest(F.length(text), F.lit(1))

    def share(pattern):
        return F.length(F.regexp_replace(text, pattern, "")) / size

    labels = F.split(host, r"\.")
    return [
        F.length(text),
        F.length(host),
        F.length(path),
        F.size(labels),
        F.size(F.filter(F.split(path, "/"), lambda p: p != "")),
        share("[^0-9]"),
        share("[^-_]"),
        entropy(text),
        F.size(F.filter(F.split(query, "[&;]"), lambda p: p != "")),
        F.length(query),
        text.contains("#").cast("int"),
        F.startswith(F.lower(text), F.lit("https://")).cast("int"),
        F.array_max(F.transform(labels, F.length)),
    ]


@dataclass
class UrlModel:
    """``trees`` is None, and everything allowed, unless labels of both kinds were given."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame | None  # (suffix, share of blocked): at most 2 rows a sampled URL
    share: float

    def features(self, urls: DataFrame, url_col: str, name: str) -> DataFrame:
        """All columns of ``urls`` and a vector of features, in the column ``name``."""
        keys = [fresh(urls, f"_suffix_{k}") for k in (1, 2)]
        shares = [fresh(urls, f"_share_{k}") for k in (1, 2)]
        names = urls.columns
        own = host(F.col(url_col))
        for k, (key, share) in enumerate(zip(keys, shares, strict=True), 1):
            table = self.suffixes.select(F.col("suffix").alias(key), F.col("share").alias(share))
            # Bounded by SAMPLE, so small enough for every executor.
            urls = urls.withColumn(key, suffix(own, k)).join(F.broadcast(table), key, "left")
        columns = lexical(F.col(url_col), own, path(F.col(url_col)))
        columns += [F.coalesce(F.col(share), F.lit(self.share)) for share in shares]
        vector = array_to_vector(F.array(*[c.cast("double") for c in columns]))
        return urls.select(*names, vector.alias(name))

    def blocked(self, urls: DataFrame, url_col: str, name: str) -> DataFrame:
        """All columns of ``urls`` and whether the trees block the URL."""
        if self.trees is None:
            return urls.withColumn(name, F.lit(False))
        vector, raw, odds, kind = (fresh(urls, f"_{n}") for n in ("vector", "raw", "odds", "kind"))
        trees = self.trees.copy()
        trees.setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(odds)
        trees.setPredictionCol(kind)
        judged = trees.transform(self.features(urls, url_col, vector))
        return judged.select(*urls.columns, (F.col(kind) == 1.0).alias(name))


def train(labelled: DataFrame) -> UrlModel:
    """Trees from labelled (url, blocked boolean); null labels and URLs are left out.

    The sample takes the ``SAMPLE`` URLs with the smallest hashes, so it is the same however
    the rows are spread.
    """
    rows = labelled.select("url", "blocked").where("url is not null and blocked is not null")
    rows = rows.orderBy(F.xxhash64("url"), "url", "blocked").limit(SAMPLE)
    rows = materialize(rows, "url-sample")
    count, share, kinds = rows.agg(
        F.count("*"), F.avg(F.col("blocked").cast("double")), F.count_distinct("blocked")
    ).first()
    if kinds < 2:
        return UrlModel(None, None, 0.0)
    own = host(F.col("url"))
    both = F.array_distinct(F.array(suffix(own, 1), suffix(own, 2)))
    counts = rows.select(F.explode(both).alias("suffix"), F.col("blocked").cast("double").alias("b"))
    suffixes = counts.groupBy("suffix").agg(
        ((F.sum("b") + PRIOR * share) / (F.count("*") + PRIOR)).alias("share")
    )
    model = UrlModel(None, materialize(suffixes, "suffixes"), float(share))
    table = model.features(rows, "url", "features").select(
        "features", F.col("blocked").cast("double").alias("label")
    )
    model.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(
        materialize(table, "url-features")
    )
    return model


def rule_labels(urls: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """(url, blocked) for the URLs that a rule decides: the labels when no others are given."""
    named = rule(host(F.col(url_col)), path(F.col(url_col)), rules)
    verdicts = F.create_map(*[F.lit(x) for d, p, v in rules for x in (d + p, v)])
    return urls.select(F.col(url_col).alias("url"), (verdicts[named] == "block").alias("blocked"))


def judge(
    pages: DataFrame,
    model: UrlModel,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    The longest fitting rule decides, else the trees. A null URL or one without ``://`` has an
    empty host and path, which no rule fits, and is judged like any other; repeated rows give
    a row each. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    judged = model.blocked(rows, "url", "blocked")
    judged = judged.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    judged = judged.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for d, p, v in rules for x in (d + p, v)])
    other = F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce(verdicts[F.col("rule")], other).alias("verdict")
    )
