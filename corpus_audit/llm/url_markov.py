"""URL filtering by the ratio of two character models, in DataFrame functions alone.

Rules name hosts and paths that are accepted or rejected.  The URLs that a rule judges train two variable-order
Markov models, one of accepted and one of rejected URLs; the others are judged by the difference of their
log-likelihoods a character, against a threshold calibrated on URLs that were left out of the counts.

Counting needs the different grams alone.  Grams of ``ORDER + 1`` characters are counted over all URLs; those of
lower orders are sums of these.  From order 0 up, each gram's probability mixes its own frequency with the
probability of the gram without its first character (Witten-Bell).  Contexts seen fewer than ``MIN_CONTEXT``
times in a model add nothing, so the order varies with what was seen.  A URL's characters are then joined with
the table of grams, which holds one log ratio each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_audit.llm.common import lower_ascii, stored

ORDER = 3  # characters of context
MIN_CONTEXT = 2
ALPHABET = 256  # equal chances below order 0
FOLDS = 5  # one of so many parts of the labelled URLs calibrates
START, END = "\x02", "\x03"

Rule = tuple[str, str]  # verdict and "host/path"


def _after_scheme(url):
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` and ``path``: empty for a null URL or one without ``://``."""
    rest = F.coalesce(_after_scheme(F.col("url")), F.lit(""))
    cut = pages.withColumn("__rest", rest)
    host = F.regexp_extract("__rest", r"^([^/?#]*+)", 1)
    path = F.regexp_extract("__rest", r"^[^/?#]*+([^?#]*+)", 1)
    return cut.withColumn("host", lower_ascii(host)).withColumn("path", path).drop("__rest")


def with_rule(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` with ``rule`` and ``label``: the longest rule that fits host (or a subdomain) and path, else null."""
    rule = label = F.lit(None).cast("string")
    for verdict, pattern in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = pattern.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        rule, label = F.when(fits, pattern).otherwise(rule), F.when(fits, verdict).otherwise(label)
    return pages.withColumn("rule", rule).withColumn("label", label)


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of ``url`` and its end: the gram of ``ORDER`` characters before it and itself."""
    padded = F.concat(F.lit(START * ORDER), F.col("url"), F.lit(END))
    spots = urls.select(*keep, padded.alias("p"), F.explode(F.sequence(F.lit(1), F.length("url") + 1)).alias("i"))
    return spots.select(*keep, F.expr(f"substring(p, i, {ORDER + 1})").alias("g"))


def gram_ratios(counts: DataFrame) -> DataFrame:
    """``g, ratio`` from ``g, allow, block``: the log ratio of the last character's chances after the others.

    Every gram to be scored is in ``counts``, with zeros if no labelled URL has it."""
    models, below = ("allow", "block"), None
    for order in range(ORDER + 1):
        size = order + 1
        level = counts.groupBy(F.expr(f"right(g, {size})").alias("g")).agg(*[F.sum(m).alias(m) for m in models])
        level = level.withColumn("context", F.expr(f"left(g, {order})"))
        totals = level.groupBy("context").agg(
            *[F.sum(m).alias(f"{m}_n") for m in models], *[F.sum((F.col(m) > 0).cast("long")).alias(f"{m}_kinds") for m in models]
        )
        level = level.join(totals, "context")
        if below is None:
            level = level.select("*", *[F.lit(1.0 / ALPHABET).alias(f"{m}_low") for m in models])
        else:
            level = level.withColumn("h", F.expr(f"right(g, {order})")).join(below, "h")
        chances = []
        for m in models:
            mixed = (F.col(m) + F.col(f"{m}_kinds") * F.col(f"{m}_low")) / (F.col(f"{m}_n") + F.col(f"{m}_kinds"))
            chances.append(F.when(F.col(f"{m}_n") >= MIN_CONTEXT, mixed).otherwise(F.col(f"{m}_low")).alias(f"{m}_low"))
        below = level.select(F.col("g").alias("h"), *chances)
    return below.select(F.col("h").alias("g"), F.log(F.col("allow_low") / F.col("block_low")).alias("ratio"))


def _threshold(scored: DataFrame) -> float:
    """The score that best parts accepted and rejected calibration URLs, both kinds weighing the same.

    Scores are counted in steps of 0.01, so that one short row a step is ordered and one number comes back."""
    steps = scored.groupBy(F.round("score", 2).alias("t")).agg(*[F.sum((F.col("label") == m).cast("long")).alias(m) for m in ("allow", "block")])
    total = steps.agg(F.sum("allow").alias("a"), F.sum("block").alias("b")).first()
    if not total["a"] or not total["b"]:
        return 0.0
    from pyspark.sql import Window

    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    lost, caught = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("allow", "block"))
    best = steps.select("t", (caught / F.lit(total["b"]) - lost / F.lit(total["a"])).alias("gain")).orderBy(F.desc("gain"), "t").first()
    return float(best["t"]) - 0.005


def judge_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` with ``host, path, rule, score, verdict``.

    ``verdict`` is that of the longest fitting rule, else ``allow`` where ``score``, the mean log ratio of the
    characters of the URL (A-Z lower-cased), reaches the threshold, else ``block``.  ``score`` is null where a rule
    decides.  Null URLs are judged as empty ones.  Without URLs of both kinds, nothing is known against a URL
    and the method allows it.  Rows that repeat have the same result each.  Other columns pass through;
    columns named like the results are replaced.  An empty table gives an empty result.
    """
    results = ["host", "path", "rule", "score", "verdict"]
    rows = with_rule(with_parts(pages.drop(*results, "label")), rules)
    urls = rows.select(lower_ascii(F.coalesce("url", F.lit(""))).alias("url"), "label").distinct()
    left_out = F.col("label").isNotNull() & (F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(FOLDS)) == 0)
    urls = stored(urls.withColumn("train", F.col("label").isNotNull() & ~left_out), "urls")
    counted = _grams(urls, "label", "train").groupBy("g").agg(
        *[F.sum(F.expr(f"cast(train AND label = '{m}' AS bigint)")).alias(m) for m in ("allow", "block")]
    )
    ratios = gram_ratios(stored(counted, "grams"))
    keyed = urls.where("NOT train").select("url", "label", F.sha2("url", 256).alias("d"))
    spots = _grams(keyed.select("url", F.unhex(F.substring("d", 1, 32)).alias("k")), "k")
    # The parts of a mean are whole numbers, so that it does not depend on the order of the sum.
    parts = spots.join(ratios, "g").groupBy("k").agg(F.sum(F.round(F.col("ratio") * 1e6).cast("long")).alias("s"), F.count("*").alias("n"))
    scored = keyed.select("url", "label", F.unhex(F.substring("d", 1, 32)).alias("k")).join(parts, "k").select("url", "label", (F.col("s") / F.col("n") / 1e6).alias("score"))
    scored = stored(scored, "scores")
    known = urls.where("train").groupBy("label").count().select("label").distinct().count() == 2
    threshold = _threshold(scored.where("label IS NOT NULL")) if known else float("-inf")
    judged = scored.where("label IS NULL").select(F.col("url").alias("__url"), "score")
    joined = rows.withColumn("__key", lower_ascii(F.coalesce("url", F.lit("")))).join(judged, F.col("__key") == F.col("__url"), "left")
    verdict = F.coalesce("label", F.when(F.coalesce("score", F.lit(0.0)) >= threshold, "allow").otherwise("block"))
    return joined.withColumn("verdict", verdict).withColumn("score", F.when(F.col("label").isNull(), F.col("score"))).drop("__key", "__url", "label")
