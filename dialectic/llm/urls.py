"""URL filter: rules first, gradient-boosted trees on lexical features else."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialectic.llm.frames import stored

# --- fixed values: the rules (host/path, verdict)
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block")]
# ---------------------------------------------------------------------------
#: Labelled URLs that the trees are fitted on, taken by hash of the URL.
FIT_ROWS = 20_000
TREES, DEPTH, SEED = 12, 3, 7
#: Weight of the overall rate in a suffix's rate.
PRIOR_WEIGHT = 20.0


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host lower-cased after the first ``://`` up to ``/``, ``?``,
    ``#`` or the end; path from there up to ``?``, ``#`` or the end. Null or no
    ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def _entropy(c: Column) -> Column:
    """Bits per character of the host: 37 character classes suffice (letters,
    digits, the rest)."""
    n = F.greatest(F.char_length(c), F.lit(1)).cast("double")
    letters = [F.lit(x) for x in "abcdefghijklmnopqrstuvwxyz0123456789.-"]
    counts = F.transform(F.array(*letters), lambda x: F.char_length(c) - F.char_length(F.replace(c, x, F.lit(""))))
    return F.aggregate(counts, F.lit(0.0), lambda s, k: s + F.when(
        k > 0, -(k / n) * F.log2(F.greatest(k, F.lit(1)) / n)).otherwise(0.0))


def features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with lexical features ``f_*``. The rules' own
    text is not a feature as such: counts, lengths and ratios of the whole URL."""
    url = F.coalesce(F.col("url"), F.lit(""))
    length = F.greatest(F.char_length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.select(
        "*", F.char_length(url).cast("double").alias("f_length"),
        F.char_length("host").cast("double").alias("f_host_length"),
        F.char_length("path").cast("double").alias("f_path_length"),
        _count(F.col("path"), "/").alias("f_depth"), _count(F.col("host"), "[.]").alias("f_labels"),
        (_count(url, "[0-9]") / length).alias("f_digit_ratio"),
        _count(F.col("path"), "[0-9]").alias("f_path_digits"), _count(F.col("host"), "-").alias("f_hyphens"),
        F.when(query == "", 0.0).otherwise(_count(query, "&") + 1.0).alias("f_parameters"),
        F.char_length(query).cast("double").alias("f_query_length"),
        F.contains(url, F.lit("#")).cast("double").alias("f_fragment"),
        F.startswith(url, F.lit("https:")).cast("double").alias("f_https"),
        F.rlike("path", F.lit(r"\.[a-z0-9]+$")).cast("double").alias("f_extension"),
        F.endswith("path", F.lit("/")).cast("double").alias("f_slash"),
        _entropy(F.col("host")).alias("f_entropy"),
        *_keys(F.col("host"), F.col("path")))


def _keys(host: Column, path: Column) -> tuple[Column, Column]:
    """(suffix, section): the host's last label and the path's first segment."""
    segment = F.get(F.split(path, "/"), F.lit(1))
    return F.substring_index(host, ".", -1).alias("suffix"), F.coalesce(_lower(segment), F.lit("")).alias("section")


def _counts(labelled: DataFrame) -> DataFrame:
    """(suffix, section, n, s): URLs and blocked URLs, over all of ``labelled``."""
    return labelled.select(*_keys(F.col("host"), F.col("path")), "blocked").groupBy("suffix", "section").agg(
        F.count("*").alias("n"), F.sum("blocked").alias("s"))


def _rates(counts: DataFrame, key: str, mean: float) -> DataFrame:
    """Smoothed share of blocked URLs by ``key``, and its log count."""
    return (counts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            .select(key, ((F.col("s") + mean * PRIOR_WEIGHT) / (F.col("n") + PRIOR_WEIGHT))
                    .alias(f"f_{key}_rate"), F.log1p("n").alias(f"f_{key}_count")))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score
    (probability of block; 0 or 1 where a rule decides).

    URLs that a rule decides are the labels. The trees are fitted on at most
    ``fit_rows`` different ones of them (by hash of the URL) and judge the rest.
    Suffix statistics are smoothed block rates of the host's last label and of
    the path's first section, counted on all different labelled URLs and joined
    by key (broadcast only where Spark finds their stored table small).
    If the labelled URLs all have one verdict, it is everyone's; if there are
    none, the verdict is allow. A null URL has empty host and path and is judged
    like any other; repeated rows repeat; other columns are not read.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    known = urls.select("*", rule.alias("rule"), said.alias("said"))
    labelled = (known.filter("said is not null").select(
        "url", "host", "path", (F.col("said") == "block").cast("double").alias("blocked")).distinct()
        .withColumn("h", F.xxhash64("url")))
    counts = stored(_counts(labelled), "url-counts")
    sums = counts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    # A share by hash that holds a little over fit_rows URLs, then exactly the first of them.
    share = min(1.0, 1.2 * fit_rows / max(1, sums["n"] or 0))
    labelled = (labelled.filter(F.pmod("h", F.lit(1 << 20)) <= F.lit(int(share * (1 << 20))))
                .orderBy(F.pmod("h", F.lit(1 << 20)), "h", "url").limit(fit_rows))
    fit = features(labelled).coalesce(1).cache()
    try:
        seen = [r["blocked"] for r in fit.select("blocked").distinct().collect()]
        if len(seen) < 2:
            score = F.lit(seen[0] if seen else 0.0)
            judged = known.withColumn("score", score)
        else:
            overall = sums["s"] / sums["n"]
            suffix, section = (stored(_rates(counts, k, overall), f"url-{k}") for k in ("suffix", "section"))
            names = sorted(c for c in fit.columns if c.startswith("f_"))
            names += [f"f_{k}_{w}" for k in ("suffix", "section") for w in ("rate", "count")]

            def full(df: DataFrame) -> DataFrame:
                for key, rates in (("suffix", suffix), ("section", section)):
                    df = df.join(rates, key, "left")
                return df.fillna(overall, ["f_suffix_rate", "f_section_rate"]).fillna(
                    0.0, ["f_suffix_count", "f_section_count"])

            pack = VectorAssembler(inputCols=names, outputCol="packed")
            trees = GBTClassifier(featuresCol="packed", labelCol="blocked", maxIter=TREES, maxDepth=DEPTH,
                                  seed=SEED)
            model = trees.fit(pack.transform(full(fit)).select("packed", "blocked").coalesce(1))
            judged = model.transform(pack.transform(full(features(known)))).withColumn(
                "score", vector_to_array("probability")[1])
    finally:
        fit.unpersist()
    verdict = F.coalesce("said", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"),
                         F.when(F.col("said").isNull(), F.col("score"))
                         .otherwise((F.col("said") == "block").cast("double")).alias("score"))
