"""URL filter: rules first, then logistic regression on hashed character n-grams.

The model is fitted on a small labelled URL table with the ML library, whose features
and scores are DataFrame columns; scoring is one narrow pass over the URLs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
MOST_RULES = 1000
FEATURES = 1 << 12
GRAMS = (3, 4, 5)
BLOCK, ALLOW = 1, 0

#: The small labelled table: each host below with each path, so that the paths alone
#: decide nothing.  Hosts to block, then hosts to allow.
BLOCKED_HOSTS = (
    "casino-royal.example", "www.casino-bonus.example", "m.online-casino.example", "blog.casino-win.example",
    "spam-farm.example", "blog.spam-links.example", "www.spam-offers.example", "m.email-spam.example",
    "www.cheap-pills.example", "pills-online.example", "m.cheap-meds.example", "blog.diet-pills.example",
    "free-bets.example", "www.best-bets.example", "m.bets-free.example", "blog.sports-bets.example",
    "adult-x.example", "www.adult-cams.example", "m.xxx-adult.example", "blog.adult-x.example",
    "ads-track.example", "m.ads-track.example", "www.track-ads.example", "blog.ads-click.example",
)
ALLOWED_HOSTS = (
    "www.university.example", "news.example", "docs.example", "blog.garden.example",
    "encyclopedia.example", "www.museum.example", "m.weather.example", "bakery.example",
    "code.example", "forum.example", "www.railway.example", "physics.example",
    "www.another.example", "thinking.example", "m.readers.example", "blog.station.example",
    "www.nation.example", "mother.example", "m.theatre.example", "blog.holding.example",
    "www.international.example", "interest.example", "m.thread.example", "blog.brother.example",
)
SAMPLE_PATHS = ("", "/", "/en/301", "/de/77.html", "/wiki/Rain", "/fr/18/")


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null.  A rule fits its
    host and all subdomains where the path starts with the rule's."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} fit an expression")
    fits = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        found = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(found, value) if fits is None else fits.when(found, value)
    return fits if fits is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def char_grams(text: Column, mark: str, sizes: Sequence[int] = GRAMS) -> Column:
    """All character n-grams of `text` between boundary marks, each led by `mark`."""
    lists = []
    for n in sizes:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 3, F.lit(1)))
        lists.append(
            F.transform(starts, lambda i, n=n: F.concat(F.lit(mark), F.substring(F.concat(F.lit("<"), text, F.lit(">")), i, F.lit(n))))
        )
    return F.concat(*lists)


def featured(urls: DataFrame) -> DataFrame:
    """Adds the columns the model reads.  The last label of a host says little about its
    content, so the n-grams leave it out; digits of a path count as one sign."""
    stem = F.regexp_replace("host", r"\.[^.]*$", "")
    sign = F.regexp_replace("path", "[0-9]+", "0")
    return urls.withColumns({"_host": char_grams(stem, "h"), "_path": char_grams(sign, "p")})


def train(labelled: DataFrame, regularisation: float = 0.001) -> PipelineModel:
    """Fit on (url, label), a small table.  Each part is hashed into FEATURES cells."""
    rows = featured(
        labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label")
    )
    stages = [
        HashingTF(inputCol="_host", outputCol="_h", numFeatures=FEATURES, binary=True),
        HashingTF(inputCol="_path", outputCol="_p", numFeatures=FEATURES, binary=True),
        VectorAssembler(inputCols=["_h", "_p"], outputCol="_x"),
        LogisticRegression(
            featuresCol="_x", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw",
            predictionCol="_prediction", regParam=regularisation, maxIter=30, standardization=False,
        ),
    ]
    return Pipeline(stages=stages).fit(rows)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): 1 to block, 0 to allow."""
    hosts = [F.struct(F.lit(h).alias("host"), F.lit(1).alias("label")) for h in BLOCKED_HOSTS]
    hosts += [F.struct(F.lit(h).alias("host"), F.lit(0).alias("label")) for h in ALLOWED_HOSTS]
    listed = spark.range(0, 1, 1, 1).select(F.inline(F.array(*hosts)))
    paths = F.explode(F.array(*map(F.lit, SAMPLE_PATHS)))
    return listed.withColumn("path", paths).select(F.concat(F.lit("https://"), "host", "path").alias("url"), "label")


def judge(
    pages: DataFrame, model: PipelineModel, rules: Sequence[tuple[str, str, str]] = RULES,
    threshold: float = 0.5,
) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability of every row (page_id, url).

    A null url or one without `://` has an empty host and path: no rule fits and the
    model judges the empty strings.  Repeated rows and null ids keep their rows; an
    empty table gives no rows; very long urls are judged whole.
    """
    rows = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    scored = model.transform(featured(rows))
    probability = vector_to_array("_probability")[BLOCK]
    by_rule = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(probability >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", by_rule["rule"].alias("rule"),
        F.coalesce(by_rule["verdict"], learned).alias("verdict"),
        probability.alias("block_probability"),
    )
