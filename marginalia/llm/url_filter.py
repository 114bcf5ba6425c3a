"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

DataFrame and SQL functions only, for the fit as well: the small labelled table is folded by one SQL aggregate that
carries the weights, and scoring adds the weights of a URL's n-grams. The weights (one for each bucket seen) are the only
thing that reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hashed n-gram buckets, passes over the labelled table, step and decay, and rows that a fit takes at most.
BUCKETS, EPOCHS, STEP, DECAY, SAMPLE = 1 << 16, 60, 4.0, 1e-5, 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the query: (action, host, path). Fixed values.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: A small labelled table of URLs: unwanted (1) and wanted (0) ones. Fixed values.
BLOCKED = """
www.best-casino-online.example.net/en/12 royal-casino.example.org/fr/4 m.win-big-casino.example.com/en/31 casino-bonus.example.net/es/88 www.live-casino.example.org/de/16
bets-today.example.com/en/odds www.sports-bets.example.net/en/3 m.free-bet-tips.example.org/fr/16 superbets.example.com/de/59 free-spins.example.net/en/8
cheap-meds.example.org/en/order www.pills-online.example.com/es/52 buy-cheap-pills.example.net/en/7 m.diet-pills.example.org/fr/33 cheap-pharmacy.example.com/de/5
www.spam-links.example.net/en/64 link-farm.example.org/fr/9 m.spam-directory.example.com/en/2 spammy-blog.example.net/es/71 www.content-farm.example.org/en/88
ads-server.example.com/en/click www.ads-network.example.net/de/41 m.click-track.example.org/en/640 track-user.example.com/fr/90 banner-ads.example.net/en/9
www.payday-loans.example.org/en/apply fast-loans.example.com/en/47 m.quick-cash.example.net/de/8 lottery-win.example.org/es/23 www.win-prize.example.com/en/18
xxx-tube.example.net/en/watch m.hot-singles.example.org/fr/29 www.adult-cams.example.com/de/3 porn-free.example.net/en/222 replica-watches.example.org/en/14
phish-login.example.com/en/26 www.malware-download.example.net/en/55 m.crack-keygen.example.org/de/6 seo-spam.example.com/es/81 www.cheap-seo.example.net/en/310
roulette-online.example.org/en/3 www.jackpot-slots.example.com/en/18 m.blackjack-gamble.example.net/de/2 texas-poker.example.org/es/7 www.escort-singles.example.com/fr/15
date-tonight.example.net/en/44 www.webcam-girls.example.org/en/9 sexy-dating.example.com/de/31 pharma-discount.example.net/es/6 www.weight-loss-miracle.example.com/en/20
bitcoin-doubler.example.org/en/77 www.get-rich-quick.example.net/en/4 m.debt-relief.example.com/es/12 cash-advance.example.org/en/58 trojan-download.example.net/de/3
www.keylogger-free.example.com/en/8 torrent-warez.example.org/fr/22 spyware-popunder.example.net/en/14 fake-rolex.example.com/en/63 www.hacked-accounts.example.org/en/5
""".split()
ALLOWED = """
www.library.example.org/en/41 garden.example.com/en/7 news.harbour.example.net/de/120 m.theatre.example.org/fr/9 history.example.com/es/88
docs.kernel.example.net/en/3.html ceramics.example.org/en/15 www.weather.example.com/de/2 kitchen.example.net/fr/77 blog.mountain.example.org/en/501
university.example.com/research/5 m.museum.example.net/en/24#top chess.example.org/en/310 www.travel.example.com/es/64 blog.thread.example.net/en/8
northern.example.org/en/1 www.orchestra.example.com/de/17 river.example.net/en/900 there.example.org/fr/42 blog.another.example.com/en/77
union.example.net/en/6 www.bridge.example.org/es/5.html station.example.com/de/33 blog.writing.example.net/en/12 other.example.org/en/222/
photos.island.example.com/fr/19 council.example.net/en/4 data.census.example.org/en/2020 health.example.com/es/11 www.string.example.net/en/640
theory.example.org/de/8 m.thinner.example.com/en/91 nation.example.net/en/45 www.hand.example.org/fr/3 thousand.example.com/en/18
reader.example.net/es/27 blog.thing.example.org/en/5 wheat.example.com/de/70 www.ether.example.net/en/9?page=2 rather.example.org/fr/14
journal.example.com/es/8 www.chemistry.example.net/en/31 biology.example.org/fr/6 bakery.example.com/de/19 m.football.example.net/en/72
cinema.example.org/en/4 www.gallery.example.com/fr/55 lecture.example.net/de/9 hospital.example.org/es/23 clinic.example.com/en/16
castle.example.net/fr/2 novel.example.com/es/41 www.grammar.example.org/en/80 climate.example.net/en/13 harvest.example.com/de/7
violin.example.org/es/5 bookshop.example.com/en/29 www.tennis.example.net/fr/34 software.example.org/en/61 statistics.example.com/de/10
economics.example.net/es/3 culture.example.org/fr/47 traffic.example.com/en/88 www.cooking.example.net/es/11 cellar.example.org/de/36
motorcycle.example.com/en/92 insects.example.net/en/17 medieval.example.org/en/6 minerals.example.com/fr/21 registry.example.net/en/50
""".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the labelled table above."""
    return spark.createDataFrame([(f"http://{u}", 1) for u in BLOCKED] + [(f"http://{u}", 0) for u in ALLOWED], "url string, label int")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty where the url is null or has no ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _grams(mark: str, text: Column, n: int) -> Column:
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    starts = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(f"{mark}{n}"), F.substring(marked, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))


def grams(host: Column, path: Column) -> Column:
    """Buckets of the 3-, 4- and 5-grams of the host and the 4-grams of the path, between end marks; repeats count.

    A run of digits in the path counts as one 0."""
    path = F.regexp_replace(path, "[0-9]+", "0")
    return F.concat(_grams("h", host, 3), _grams("h", host, 4), _grams("h", host, 5), _grams("p", path, 4))


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Weights of the buckets, and the intercept last, by stochastic gradient descent over (url, label).

    The table is meant to be small: `sample` rows at most are read, by a hash of the url. Rows with nulls are left out;
    without rows every weight is 0.
    """
    host, path = split_url(F.col("url"))
    rows = labelled.filter("url IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("url"), "url", "label").limit(sample)
    rows = rows.select(F.xxhash64("url").alias("h"), "url", F.col("label").cast("double").alias("y"), grams(host, path).alias("g"))
    # at most `sample` rows; only the buckets that they hold are carried along
    gathered = rows.agg(F.sort_array(F.collect_list(F.struct("h", "url", "y", "g"))).alias("rows"))
    gathered = gathered.withColumn("vocabulary", F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["g"])))))

    def dense(r: Column) -> Column:
        size = F.sqrt(F.greatest(F.size(r["g"]), F.lit(1)))
        return F.concat(F.transform("vocabulary", lambda b: F.size(F.filter(r["g"], lambda x: x == b)) / size), F.array(F.lit(1.0)))

    examples = gathered.select("vocabulary", F.transform("rows", lambda r: F.struct(r["y"].alias("y"), dense(r).alias("x"))).alias("rows"))

    def learn(w: Column, row: Column) -> Column:
        z = F.aggregate(F.zip_with(w, row["x"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        # an array of one element binds the error, which would otherwise be computed again for every weight
        error = F.array(row["y"] - _sigmoid(z))
        return F.transform(error, lambda e: F.zip_with(w, row["x"], lambda a, b: a * F.lit(1 - DECAY) + F.lit(STEP) * e * b))[0]

    folded = F.aggregate(F.flatten(F.array_repeat("rows", EPOCHS)), F.array_repeat(F.lit(0.0), F.size("vocabulary") + 1), learn)
    found = examples.select("vocabulary", folded.alias("w")).first()
    weights = [0.0] * (BUCKETS + 1)
    for bucket, w in zip([*found["vocabulary"], BUCKETS], found["w"], strict=True):
        weights[bucket] = w
    return weights


def unwanted(weights: list[float], host: Column, path: Column) -> Column:
    """Probability that a URL is unwanted."""
    # a constant that the optimizer folds into one array
    table = F.split(F.lit(",".join(map(repr, weights[:-1]))), ",").cast("array<double>")
    found = grams(host, path)
    total = F.aggregate(found, F.lit(0.0), lambda s, b: s + F.element_at(table, b + 1))
    return _sigmoid(total / F.sqrt(F.greatest(F.size(found), F.lit(1))) + F.lit(weights[-1]))


def matching_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, action) of the longest rule whose host is the url's or a parent of it and whose path starts the url's."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule, action = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def url_filter(spark: SparkSession, pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per row of `pages` (page_id, url): page_id, host, path, rule, verdict, score.

    A null url, or one without ://, has an empty host and path, fits no rule and gets the model's verdict on empty
    strings. score is the model's probability of block, null where a rule decides. Repeated rows get equal verdicts;
    other columns are ignored; an empty table gives an empty result.
    """
    weights = fit(labelled if labelled is not None else labelled_urls(spark))
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    parts = parts.select("*", *(c.alias(n) for n, c in zip(("rule", "action"), matching_rule(rules, F.col("host"), F.col("path")), strict=True)))
    parts = parts.withColumn("score", F.when(F.col("rule").isNull(), unwanted(weights, F.col("host"), F.col("path"))))
    return parts.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
