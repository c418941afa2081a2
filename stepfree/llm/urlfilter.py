"""Verdicts on urls: explicit rules first, then logistic regression on hashed character n-grams of host and path.

Only DataFrame functions and JVM transformers run here. The classifier is trained from a small labelled url table; its
features are the 3- to 5-grams of the host and of the path, hashed apart.

Cases: a url that is null or has no ``://`` has an empty host and path and no rule; the method judges it like any other.
An empty table gives an empty one. Equal urls get equal results; other columns are not read and may have any names. Long
urls cost time in proportion to their length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, SIZES = 1 << 16, (3, 4, 5)
#: A rule is a host, with all its subdomains, and the start of a path; the longest that fits decides.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

# The labelled urls: hosts and paths with every word, alone and beside words that say nothing, and wanted urls without any of them.
_UNWANTED = (
    "adult sex sexy xxx porn escort hookup webcam nude erotic casino poker slots slot roulette jackpot bet bets betting lottery bingo gambling pills pharma viagra cialis"
    " meds payday loan loans debt warez crack keygen torrent cheat hack phishing malware virus spam scam fraud ads adserver adclick track tracker tracking clickbait popunder"
    " doubleclick affiliate replica fake fakenews hoax forex crypto rich miracle diet weightloss"
).split()
_WANTED = (
    "news science library museum university garden kitchen travel weather history health research teacher school music city forum wiki recipes football cinema archive"
    " journal village book books art design photo family nature animals bridge river mountain energy housing council office market craft theatre language physics math"
    " biology chemistry medicine hospital train bus bike harbour island forest farmers letters poems essay studio workshop gallery"
).split()
_BESIDE = "free cheap best win farm top online my get x hot daily big world net 24 365 club zone".split()
#: Syllables that made-up names are put together from.
_SYLLABLES = "th er on an re he in ti es en at ed nd st or ou ha nt wh sh ing tion ble ly ea ch au ge ver be ci os ar ue ión".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url and label (1.0: block), a table of a few thousand rows made from the listed words."""
    hosts = ("www.{}.example.com", "{}.example.net", "blog.{}.example.org", "m.{}.example.com", "{}.example.fr")
    tails = [f"/{lang}/{t}" for lang in ("en", "de", "fr", "es") for t in ("1024", "7.html", "310/", "88?page=2&ref=x", "9021?utm_source=feed", "46#top")]
    rows, n = [], len(_SYLLABLES)

    def add(name: str, label: float) -> None:
        # both labels have every form of host and path alike
        rows.append((f"https://{hosts[len(rows) % len(hosts)].format(name)}{tails[len(rows) % len(tails)]}", label))

    for label, words in ((1.0, _UNWANTED), (0.0, _WANTED)):
        for i, w in enumerate(words):
            pair = [_BESIDE[(i + k) % len(_BESIDE)] for k in (0, 7, 11)]
            for name in (w, f"{pair[0]}-{w}", f"{w}-{pair[1]}", f"{w}{pair[2]}", f"{pair[1]}{w}", f"{w}-{_BESIDE[(i + 4) % len(_BESIDE)]}"):
                add(name, label)
            rows.append((f"https://blog.example.com/{w}{tails[i % len(tails)]}", label))
    for i in range(len(_UNWANTED) * 18):
        add("".join(_SYLLABLES[(i * (2 * k + 3) + i // n * (3 * k + 1) + 7 * k * k) % n] for k in range(2 + i % 3)), 0.0)
    rows += [(f"https://{h}{t}", 0.0) for h in ("www.example.com", "blog.example.net", "m.example.org", "example.com", "example.net", "example.org") for t in tails]
    own = F.explode(F.split(F.lit("\n".join(f"{url} {label}" for url, label in rows)), "\n")).alias("r")
    return spark.range(1).select(own).select(F.substring_index("r", " ", 1).alias("url"), F.substring_index("r", " ", -1).cast("double").alias("label"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(url, pattern, 1), upper, upper.lower()), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tried first
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def ngrams(text: Column, prefix: str, sizes=(3, 4)) -> Column:
    """Character n-grams of the text between two end marks, each with a prefix that tells host from path."""
    chars = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")

    def grams(own: Column) -> Column:
        def of(n: int) -> Column:
            places = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - (n - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda i: F.concat(F.lit(prefix), *[F.element_at(own, i + k) for k in range(n)]))

        return F.concat(*[of(n) for n in sizes])

    # bound to a variable, the characters are split once and not for every place
    return F.element_at(F.transform(F.array(chars), grams), 1)


def features(df: DataFrame, host: str, path: str, out: str, buckets: int) -> DataFrame:
    terms = f"{out}_terms"
    df = df.withColumn(terms, F.concat(ngrams(F.col(host), "h:", SIZES), ngrams(F.col(path), "p:", SIZES)))
    return HashingTF(numFeatures=buckets, binary=True, inputCol=terms, outputCol=out).transform(df).drop(terms)


@dataclass
class UrlModel:
    regression: LogisticRegressionModel
    buckets: int

    def score(self, df: DataFrame, host: str, path: str) -> DataFrame:
        """Adds ``score``, the chance that the url is unwanted."""
        df = features(df, host, path, "_x", self.buckets)
        return self.regression.setProbabilityCol("_p").setPredictionCol("").setRawPredictionCol("").transform(df).withColumn("score", F.element_at(vector_to_array("_p"), 2)).drop("_x", "_p")


def train(labelled: DataFrame, url="url", label="label", buckets: int = BUCKETS) -> UrlModel:
    host, path = parts(F.col(url))
    rows = features(labelled.select(host.alias("_h"), path.alias("_q"), F.col(label).cast("double").alias("_y")), "_h", "_q", "_x", buckets)
    return UrlModel(LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.0003, maxIter=80, standardization=False).fit(rows.coalesce(1)), buckets)


def judge(pages: DataFrame, model: UrlModel, rules=RULES, url="url", page_id="page_id", threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row."""
    host, path = parts(F.col(url))
    rows = model.score(pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")), "host", "path")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
