"""URL filtering by suffix rules and a character language-model ratio, natively.

Rules decide the urls they fit.  All others go to two smoothed variable-order
Markov models over characters, one of the urls that rules allow and one of those
they block: a url's score is the difference of the two log-likelihoods divided
by its number of symbols, and the threshold is calibrated on ruled urls that the
models did not see.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.workspace import Workspace, hot_join

ORDER = 5  # longest gram: four symbols of context and the symbol itself
HOT = 1024  # grams with more than this part of all places are joined by broadcast, so at most as many
UNIT = float(1 << 32)  # log ratios are added as whole parts of this, in any order alike
SMOOTHING = 2.0
ALPHABET = 256.0
CALIBRATION_FOLDS = 5
END = "\n"


@dataclass(frozen=True)
class Rule:
    """``host/path`` with a verdict; it fits the host, its subdomains and longer paths."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(pattern, verdict) of the longest rule that fits; nulls where none does."""
    pattern = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        pattern = F.when(fits, F.lit(rule.pattern)).otherwise(pattern)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return pattern, verdict


def _ending(text: Column, at: Column, n: int) -> Column:
    """The ``n`` symbols of ``text`` that end at ``at``, or as many as there are."""
    return text.substr(F.greatest(at - (n - 1), F.lit(1)), F.least(at, F.lit(n)))


def _places(text: Column) -> Column:
    return F.sequence(F.lit(1), F.length(text))


def _grams(text: Column, n: int) -> Column:
    return F.transform(F.filter(_places(text), lambda at: at >= n), lambda at: _ending(text, at, n))


def _text() -> Column:
    return F.concat(F.coalesce(F.col("url"), F.lit("")), F.lit(END))


def fit(labelled: DataFrame, work: Workspace) -> DataFrame:
    """The model ``(gram, ratio)``: log P_allow - log P_block of a gram's last symbol.

    ``labelled(url, verdict)``.  Every gram of 1 to ORDER symbols of the labelled urls
    has its own counts, so the model grows with the input; it stays distributed.  A
    gram's probability is its count in its context smoothed with the next shorter
    gram's, the shortest with a uniform distribution.  An empty input gives an empty
    model.
    """
    text = _text()
    grams = F.concat(*[_grams(text, n) for n in range(1, ORDER + 1)])
    # a url becomes hundreds of grams: a small table of urls is spread out first
    each = _spread(labelled).select(
        F.explode(grams).alias("gram"),
        (F.col("verdict") == "allow").cast("long").alias("a"),
        (F.col("verdict") == "block").cast("long").alias("b"),
    )
    n = F.length("gram")
    counts = work.save(
        each.groupBy("gram")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .select("gram", "a", "b", n.alias("n"), F.col("gram").substr(F.lit(1), n - 1).alias("context"), F.col("gram").substr(F.lit(2), n - 1).alias("shorter")),
        "grams",
    )
    contexts = counts.groupBy("context").agg(F.sum("a").alias("context_a"), F.sum("b").alias("context_b"))
    shorter = None
    model = None
    for n in range(1, ORDER + 1):
        level = counts.where(F.col("n") == n).join(contexts.hint("merge"), "context")
        if shorter is None:
            level = level.withColumn("pa0", F.lit(1.0 / ALPHABET)).withColumn("pb0", F.lit(1.0 / ALPHABET))
        else:
            level = level.join(shorter.select(F.col("gram").alias("shorter"), F.col("pa").alias("pa0"), F.col("pb").alias("pb0")).hint("merge"), "shorter")
        level = level.select("gram", _smoothed("a").alias("pa"), _smoothed("b").alias("pb"))
        shorter = level
        model = level if model is None else model.unionByName(level)
    return work.save(model.select("gram", (F.log("pa") - F.log("pb")).alias("ratio")), "model")


def _spread(urls: DataFrame) -> DataFrame:
    """``urls`` over as many tasks as the session shuffles to, by a hash."""
    return urls.repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), "url")


def _smoothed(side: str) -> Column:
    return (F.col(side) + SMOOTHING * F.col(f"p{side}0")) / (F.col(f"context_{side}") + SMOOTHING)


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """``(url, score)``: the mean log ratio per symbol under the longest gram known.

    Each distinct run of ORDER symbols is looked up once, by joins of the grams that
    end it.  Runs that fill more than a HOT-th of all places are broadcast, all others
    meet their urls in a join by the run.
    """
    work = Workspace(urls.sparkSession, "url-score")
    text = _text()
    rows = _spread(urls).select("url", F.explode(F.transform(_places(text), lambda at: _ending(text, at, ORDER))).alias("run"))
    runs = rows.groupBy("run").agg(F.count(F.lit(1)).alias("places"))
    for n in range(ORDER, 0, -1):
        # what is shorter than n has no such gram
        end = F.when(F.length("run") >= n, F.col("run").substr(F.length("run") - (n - 1), F.lit(n)))
        known = model.where(F.length("gram") == n).select(F.col("gram").alias(f"g{n}"), F.col("ratio").alias(f"r{n}"))
        runs = runs.withColumn(f"g{n}", end).join(known.hint("merge"), f"g{n}", "left")
    longest = F.coalesce(*[F.col(f"r{n}") for n in range(ORDER, 0, -1)], F.lit(0.0))
    runs = work.save(runs.select("run", "places", F.round(longest * UNIT).cast("long").alias("part")), "runs")
    hot = F.col("places") * HOT > F.lit(runs.agg(F.sum("places")).first()[0] or 0)
    often = F.broadcast(runs.where(hot).select("run", "part"))
    rare = runs.where(~hot).select("run", "part").hint("merge")
    parts = rows.join(often, "run").unionByName(rows.join(often, "run", "left_anti").join(rare, "run"))
    return parts.groupBy("url").agg((F.sum("part") / F.count(F.lit(1)) / UNIT).alias("score"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Judge every row of ``pages(page_id, url)``.

    Returns page_id, host, path, rule, verdict and score (null where a rule
    decides).  A null url or one without ``://`` has empty host and path and is
    judged by the model on what text it has; repeated rows and null ids all stay;
    other columns are ignored; an empty table gives an empty one.  Without ruled
    urls of both verdicts to learn from the model knows nothing: every score is 0 and
    allowed.  Without both among those kept for calibration the threshold is 0.
    """
    work = Workspace(pages.sparkSession, "urls")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = (
        pages.select("page_id", "url")
        .withColumn("host", host)
        .withColumn("path", path)
        .withColumn("rule", rule)
        .withColumn("rule_verdict", verdict)
    )
    urls = ruled.groupBy("url").agg(F.first("rule_verdict").alias("verdict"), F.count(F.lit(1)).alias("pages"))
    urls = work.save(urls.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(CALIBRATION_FOLDS))), "urls")
    learnt = urls.where("verdict is not null and fold <> 0")
    free = ruled.where("rule_verdict is null")
    if learnt.agg(F.count_distinct("verdict")).first()[0] < 2:
        free, cut = free.withColumn("score", F.lit(0.0)), 0.0
    else:
        scores = work.save(score(urls.where("verdict is null or fold = 0"), fit(learnt, work)), "scores")
        cut = threshold(urls.where("verdict is not null and fold = 0").join(scores, "url"))
        key = F.coalesce(F.concat(F.lit("u"), "url"), F.lit("n"))
        # a null url is scored as an empty text; scores name their url, null too
        known = urls.where("verdict is null").select("url", "pages").withColumn("url_key", key).join(scores.select(key.alias("url_key"), "score"), "url_key")
        known = work.save(known.select("url_key", "score", "pages"), "known")
        free = hot_join(free.withColumn("url_key", key), known, ["url_key"], "pages", pages.count()).drop("url_key")
    by_model = F.when(F.col("score") >= F.lit(cut), F.lit("allow")).otherwise(F.lit("block"))
    out = free.withColumn("verdict", by_model).unionByName(
        ruled.where("rule_verdict is not null").withColumn("score", F.lit(None).cast("double")).withColumn("verdict", F.col("rule_verdict"))
    )
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


def threshold(scored: DataFrame) -> float:
    """The score equally many standard deviations from both verdicts' means; 0 without both."""
    got = {
        r["verdict"]: (r["m"], r["s"] or 0.0)
        for r in scored.groupBy("verdict").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()
    }
    if set(got) != {"allow", "block"}:
        return 0.0
    (ma, sa), (mb, sb) = got["allow"], got["block"]
    return (ma * sb + mb * sa) / (sa + sb) if sa + sb > 0 else (ma + mb) / 2
