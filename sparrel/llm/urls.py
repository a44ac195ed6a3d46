"""URL filters, native: host and path rules first, then logistic regression on hashed character
n-grams of host and path, trained from a small labelled URL table.

Everything over pages is DataFrame and SQL functions. The labelled table is small; its n-grams are made by
the same functions, and the driver fits the weights. Those (BUCKETS doubles) are a literal of the plan,
so that judging is one narrow projection without a shuffle or a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.llm.html import host_of, path_of

BUCKETS = 1 << 13
#: Rows of a labelled table, which the driver fits on.
MOST_LABELLED = 4000

#: The rules to apply, as verdict, host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: The labelled URL table: addresses of kinds that such filters block, and ordinary words as names.
BLOCKED = """
http://casino-royal.example.com/slots http://www.best-casino.example.org/en/12 http://casinowin.example.com/jackpot
http://win-big.example.net/lottery http://lotto-win.example.org/en/5 http://casino-bonus.example.net/fr/88.html
http://m.sport-bets.example.com/odds http://bets-online.example.net/en/31 http://freebets.example.com/fr/7 http://live-bets.example.org/de/4
http://free-spins.example.org/de/free http://poker-bets.example.com/en/104 http://free-money.example.com/en/9 http://blog.casino-bets.example.com/es/61
http://cheap-meds.example.net/pills http://pills-shop.example.com/en/9 http://www.cheap-loans.example.com/apply http://cheappills.example.org/fr/33
http://blog.diet-pills.example.org/es/41 http://cheap-watches.example.com/replica http://cheap-tickets.example.com/en/404 http://m.pills-cheap.example.net/de/90
http://adult-video.example.com/xxx http://adult-cams.example.net/fr/3 http://xxx-adult.example.org/en/55 http://www.adult-dating.example.com/de/8 http://adultx.example.com/en/1
http://ads-server.example.com/click http://m.adserver.example.com/track http://track-clicks.example.org/en/77 http://pixel-track.example.com/fr/16
http://track-ads.example.net/en/600 http://ads-network.example.org/banner http://ads-click.example.com/es/92 http://tracker-ads.example.org/de/61
http://spam-mail.example.com/en/2 http://link-farm.example.org/links http://seo-spam.example.com/farm http://www.farm-links.example.net/es/18
http://content-farm.example.com/de/33 http://spam-links.example.org/fr/150 http://spamfarm.example.net/en/37 http://blog.spam-seo.example.org/de/25
""".split()
ALLOWED = """
http://www.garden.example.org/en/120 http://blog.kitchen.example.com/fr/33 http://museum.example.com/en/45 http://m.history.example.org/de/610
http://weather.example.net/en/9 http://www.gazette.example.org/es/75.html http://blog.theatre.example.com/en/381 http://physics.example.org/fr/22
http://m.school.example.com/de/901 http://library.example.org/en/18/ http://blog.recipes.example.net/en/640 http://www.university.example.com/es/250
http://railway.example.com/en/500 http://blog.travel.example.org/fr/77 http://m.football.example.com/en/210 http://www.music.example.net/en/39
http://gallery.example.org/de/120 http://m.cycling.example.com/en/87.html http://council.example.com/fr/450 http://blog.poetry.example.org/en/16
http://www.river.example.com/en/333 http://reading.example.net/en/52 http://m.science.example.org/es/19 http://blog.hiking.example.com/de/77.html
http://www.journal.example.org/en/271 http://handbook.example.com/en/64 http://m.answers.example.org/fr/805 http://www.family-doctor.example.com/en/12
http://lighthouse.example.com/de/14 http://blog.mountain.example.org/en/702 http://www.cinema.example.com/fr/58 http://m.bakery.example.net/en/466
http://harbour.example.org/en/31/ http://airport.example.com/en/999 http://blog.painting.example.com/es/140 http://www.earth.example.org/en/82
http://m.health.example.com/fr/215 http://novels.example.org/de/37 http://www.hospital.example.com/en/548 http://blog.gardener.example.com/de/11
http://m.biology.example.net/de/26 http://fashion.example.net/de/307 http://www.forest.example.net/de/8 http://coffee-house.example.com/de/5
http://m.education.example.com/en/730 http://chess.example.org/en/19 http://www.wonders.example.com/fr/62 http://blog.magazine.example.org/es/481
http://village-news.example.org/es/93 http://www.island.example.net/en/118 http://m.research.example.com/en/77 http://orchard.example.org/de/203
""".split()


def grams(url: Column) -> Column:
    """Buckets of the distinct n-grams of 3 and 4 characters of host and of path, each marked by its
    field; linear in the length of the url."""

    def of(field: Column, mark: str) -> Column:
        chars = F.filter(F.split(F.concat(F.lit("^"), field, F.lit("$")), ""), lambda c: c != "")

        def longer(runs: Column, k: int) -> Column:
            """Each run with the character that is k places after its first one; null at the end."""
            return F.zip_with(runs, F.slice(chars, k + 1, F.greatest(F.size(chars) - k, F.lit(0))), lambda g, c: F.concat(g, c))

        three = longer(longer(chars, 1), 2)
        known = lambda g: g.isNotNull()
        return F.transform(F.filter(F.concat(three, longer(three, 3)), known), lambda g: F.concat(F.lit(mark), g))

    # the digits of a path name pages, not kinds of pages
    path = F.regexp_replace(path_of(url), "[0-9]+", "0")
    return F.transform(F.array_distinct(F.concat(of(host_of(url), "h"), of(path, "p"))), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))


def labelled(spark: SparkSession) -> DataFrame:
    """The built-in labelled URL table (url, label)."""
    rows = ", ".join(f"('{u}', {y}D)" for y, urls in ((1.0, BLOCKED), (0.0, ALLOWED)) for u in urls)
    return spark.sql(f"select * from values {rows} as t(url, label)")


@lru_cache(maxsize=16)
def _fitted(rows: tuple[tuple[tuple[int, ...], float], ...], penalty: float) -> tuple[list[float], float]:
    """The least mean log loss plus penalty / 2 * |weights|^2, by Newton steps. Weights are a sum of the rows'
    features, so the steps are over one number a row, and a constant without penalty."""
    x, y = np.zeros((len(rows), BUCKETS)), np.array([label for _, label in rows])
    for i, (buckets, _) in enumerate(rows):
        np.add.at(x[i], list(buckets), 1.0)
    n, k = len(rows), x @ x.T
    a, constant = np.zeros(n), 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(k @ a + constant, -500, 500)))
        w = np.maximum(p * (1 - p), 1e-10)
        # (W K + n penalty I) da + W 1 db = y - p - n penalty a, and 1'W K da + 1'W 1 db = sum(y - p)
        left = np.block([[w[:, None] * k + n * penalty * np.eye(n), w[:, None]], [(w @ k)[None, :], w.sum()]])
        step = np.linalg.solve(left, np.append(y - p - n * penalty * a, (y - p).sum()))
        a, constant = a + step[:-1], constant + step[-1]
        if np.abs(step).max() < 1e-10:
            break
    return (x.T @ a).tolist(), float(constant)


def train(table: DataFrame, *, penalty: float = 0.01) -> tuple[list[float], float]:
    """Weights by bucket, and the constant, of a logistic regression on a small table (url, label), of
    MOST_LABELLED rows at most: a larger one raises ValueError. One job makes the n-grams of its rows; an equal
    table is fitted once a process. Rows with a null label don't count; without rows of both labels
    nothing is blocked."""
    found = table.where(F.col("label").isin(0, 1)).select(grams(F.col("url")).alias("g"), F.col("label").cast("double").alias("y"))
    rows = sorted((tuple(sorted(r.g)), r.y) for r in found.limit(MOST_LABELLED + 1).collect())
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"a labelled table has {MOST_LABELLED} rows at most")
    if len({y for _, y in rows}) < 2:
        return [0.0] * BUCKETS, -1.0
    return _fitted(tuple(rows), penalty)


_BUILT_IN: list[tuple[list[float], float]] = []


def _built_in(spark: SparkSession) -> tuple[list[float], float]:
    """The model of the built-in table, which is a constant: fitted once a process."""
    if not _BUILT_IN:
        _BUILT_IN.append(train(labelled(spark)))
    return _BUILT_IN[0]


def judge(df: DataFrame, url: str = "url", *, rules: Sequence[tuple[str, str, str]] = RULES, model: tuple[list[float], float] | None = None, threshold: float = 0.5) -> DataFrame:
    """Add host, path, rule, verdict and score to every row; columns of these names are replaced.

    A rule (verdict, host, path) fits its host and all subdomains if the path starts with the
    rule's; the longest fitting rule decides, the first of equally long ones. Where none fits (rule
    is null) score, the probability of a page to block, decides by the threshold. Null urls and urls
    without :// have empty host and path, and are judged as such."""
    weights, constant = model or _built_in(df.sparkSession)
    name = F.col(url)
    host, path = host_of(name), path_of(name)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    for how, h, p in reversed(longest_first):
        fits = ((F.col("_h") == h) | F.col("_h").endswith("." + h)) & F.col("_p").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, how).otherwise(verdict)
    table = F.split(F.lit(" ".join(repr(float(w)) for w in weights)), " ").cast("array<double>")  # one literal once folded
    margin = F.aggregate(F.col("_g"), F.lit(float(constant)), lambda s, g: s + F.element_at(table, g + 1))
    work = df.withColumns({"_h": host, "_p": path, "_g": grams(name)}).withColumns({"_s": 1 / (1 + F.exp(-margin))})
    keep = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "score")]
    made = {"host": F.col("_h"), "path": F.col("_p"), "rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("_s") >= threshold, "block").otherwise("allow")), "score": F.col("_s")}
    return work.select(*keep, *(c.alias(n) for n, c in made.items()))
