"""URL filters: rules by host and path, then gradient-boosted trees on lexical features.

The trees are Spark's own (``pyspark.ml``), fitted on URLs that the rules label; every
feature is a column expression, so nothing leaves the JVM. What a rule is made of (first
folders of the path, whole hosts) is no feature: the trees have to judge URLs that no rule fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from spindrift.session import written

#: Verdict and rule (host and path) of the query.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: The trees learn from at most about so many labelled URLs, drawn by hash of the URL.
MAX_TRAIN = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts that the labelled URLs are dealt into for the statistics of suffixes: a URL's own part does not count for it.
FOLDS = 5
LEXICAL = (
    "n_chars", "host_chars", "path_chars", "depth", "digits", "host_digits", "entropy", "host_entropy", "params", "query_chars", "labels", "hyphens",
    "longest", "vowels", "secure", "ending",
)
FEATURES = (*LEXICAL, "suffix_rate", "suffix_urls")


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none fits.

    A rule fits its host and all subdomains of it if the path starts with the rule's.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):  # the last to be wrapped is looked at first
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character of the distribution of characters."""
    chars = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def part(acc, c):
        p = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
        return acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0)

    return F.aggregate(F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), part)


def _lexical(df: DataFrame) -> DataFrame:
    """``df`` (``url, host, path``) with the lexical features and the host's suffix, its last two labels."""
    url = F.coalesce(F.col("url"), F.lit(""))
    one = F.lit(1.0)
    ratio = lambda text, pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text).cast("double"), one)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    longest = F.aggregate(F.split("host", r"[.\-]"), F.lit(0), lambda n, x: F.greatest(n, F.length(x)))
    return df.select(
        "*",
        F.length(url).cast("double").alias("n_chars"),
        F.length("host").cast("double").alias("host_chars"),
        F.length("path").cast("double").alias("path_chars"),
        count(F.col("path"), "/").alias("depth"),
        ratio(url, "[0-9]").alias("digits"),
        ratio(F.col("host"), "[0-9]").alias("host_digits"),
        entropy(url).alias("entropy"),
        entropy(F.col("host")).alias("host_entropy"),
        count(url, "[?&][^=&#]+=").alias("params"),
        F.length(F.regexp_extract(url, r"\?[^#]*", 0)).cast("double").alias("query_chars"),
        count(F.col("host"), r"[^.]+").alias("labels"),
        count(url, "-").alias("hyphens"),
        longest.cast("double").alias("longest"),
        ratio(F.col("host"), "[aeiou]").alias("vowels"),
        url.startswith("https://").cast("double").alias("secure"),
        F.col("path").rlike(r"\.[A-Za-z0-9]+$").cast("double").alias("ending"),
        F.substring_index("host", ".", -2).alias("suffix"),
    )


def _with_suffixes(rows: DataFrame, once: DataFrame, everything: DataFrame) -> DataFrame:
    """``rows`` with ``suffix_rate``, the share of allowed among the labelled URLs of the suffix, and ``suffix_urls``, the logarithm of their number.

    Labelled URLs of the row's own part (``fold``; null: of none) do not count; the share is drawn towards that of all.
    """
    per = once.groupBy("suffix", "fold").agg(F.sum("label").alias("good"), F.count("*").alias("n"))
    total = per.groupBy("suffix").agg(F.sum("good").alias("good_all"), F.sum("n").alias("n_all"))
    own = written(per.select(F.col("suffix").alias("o_suffix"), F.col("fold").alias("o_fold"), "good", "n"), "op10-parts")
    total = written(total.withColumnRenamed("suffix", "t_suffix"), "op10-suffixes")
    rows = rows.join(total, F.col("suffix") == F.col("t_suffix"), "left")
    rows = rows.join(own, (F.col("suffix") == F.col("o_suffix")) & (F.col("fold") == F.col("o_fold")), "left").crossJoin(F.broadcast(everything))  # one row
    left = lambda a, b: F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))
    n = left("n_all", "n")
    rows = rows.withColumn("suffix_rate", (left("good_all", "good") + 5.0 * F.col("prior")) / (n + 5.0)).withColumn("suffix_urls", F.log1p(n.cast("double")))
    return rows.drop("t_suffix", "good_all", "n_all", "o_suffix", "o_fold", "good", "n", "prior")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    max_train: int = MAX_TRAIN,
    rounds: int = 10,
    depth: int = 4,
    seed: int = 7,
) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, score``.

    The verdict is the longest fitting rule's; where none fits, the trees' (``score`` is
    their probability of allow, null where a rule decides). Null and schemeless URLs have
    empty host and path and go to the trees. Statistics of suffixes are counted over all
    labelled URLs, each URL once and none for itself; the trees learn from about ``max_train`` of these, drawn
    by hash. If the labelled URLs all have one verdict, or there are none, the rest get
    that verdict, or allow. Null ids stay null; repeated rows come back repeated. Other columns are not read; an empty
    table gives no rows.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    base = base.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    base = base.select("page_id", "url", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled"))
    feats = written(_lexical(base), "op10-features")

    once = feats.filter("ruled is not null").dropDuplicates(["url"])
    once = once.withColumn("label", (F.col("ruled") == "allow").cast("double")).withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "host"), F.lit(FOLDS)))
    once = written(once, "op10-labelled")
    kinds = once.groupBy("label").count().collect()  # two rows at most
    if len(kinds) < 2:
        one = "block" if kinds and kinds[0]["label"] == 0 else "allow"
        judged = feats.withColumn("score", F.lit(1.0 if one == "allow" else 0.0))
    else:
        n = sum(k["count"] for k in kinds)
        everything = once.agg(F.avg("label").alias("prior"))
        drawn = once.filter(F.pmod(F.xxhash64(F.lit(seed), "url"), F.lit(1 << 30)) < int(min(1.0, max_train / n) * (1 << 30)))
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        sample = vectors.transform(_with_suffixes(drawn, once, everything)).select("features", "label")
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, maxBins=32).fit(written(sample, "op10-sample"))
        asked = feats.filter("ruled is null").withColumn("fold", F.lit(None).cast("long"))
        scored = model.transform(vectors.transform(_with_suffixes(asked, once, everything)))
        scored = scored.withColumn("score", F.element_at(vector_to_array("probability"), 2))
        names = ("page_id", "host", "path", "rule", "ruled", "score")
        judged = feats.filter("ruled is not null").withColumn("score", F.lit(None).cast("double")).select(*names).union(scored.select(*names))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return judged.select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("ruled").isNull(), F.col("score")).alias("score")
    )
