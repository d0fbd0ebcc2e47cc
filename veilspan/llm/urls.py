"""URL filters: host and path rules, and a learned verdict where no rule fits.

The verdict comes from logistic regression on hashed character n-grams of host and path,
trained from a small labelled URL table (`labelled_urls()` unless another is given); the cut
is set on held-out parts of the table. Parsing, rules, n-grams, hashing and scoring are
DataFrame expressions on the JVM.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, and
the method's verdict on an empty url. Rows are judged one by one, so repeated rows repeat;
other columns are ignored. Hosts are compared as written, port and user part included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIM = 1 << 14
SIZES = (3, 4, 5)
#: Parts of the labelled table that are held out in turn to set the cut, the range it may lie in, and
#: what blocking an ordinary site costs, against letting an unwanted one through.
FOLDS, LEAST_CUT, MOST_CUT, FALSE_BLOCK = 4, 0.5, 0.95, 2.0

#: Fixed values: (rule, verdict); a rule is a host, then the start of a path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: The small labelled table, URLs of unwanted and of ordinary kinds. The names are made up.
BLOCKED_URLS = """
http://casino-royal-slots.example/play
https://best-casino-bonus.example/signup/now
http://www.online-casino.example/spin?id=4
https://poker-and-bets.example/table/9
http://sports-bets-live.example/odds
https://freebets247.example/claim
https://betting-tips.example.net/win/today
http://lottery-winner.example/prize/claim.php
http://win-a-phone.example/enter
https://you-win-big.example/prize
https://jackpot-city.example.org/spin
http://cheap-pills-online.example/buy
https://pills4less.example/order?item=12
http://discount-viagra.example/cart
https://canadian-pharmacy-rx.example/viagra/cheap
http://weight-loss-pills.example/offer
https://buy-meds-cheap.example/no-prescription
http://replica-watches.example/rolex/cheap
https://cheap-handbags-outlet.example/sale
http://cheap-seo-links.example.net/buy-links
https://backlinks-farm.example/packages
http://link-farm.example/a/b/c/1
http://spam-blaster.example/send
https://bulkspam.example.org/list
https://email-spam-tools.example/download
http://contentfarm.example/x/99182
https://click-farm.example/go
http://clicktracker.example/redirect?u=1
https://adtrack.example/pixel.gif
http://ads.trackserver.example/imp?c=3
https://track-clicks.example.net/c/8812
http://adserver7.example/banner/show
https://popup-ads.example/pop.js
http://bannerads.example.com.invalid/show?id=2
https://ad-network.example/serve
http://doubleads.example/track/open
https://adult-videos.example/watch
http://adultdating.example/profiles
https://xxx-cams.example/live
http://hot-xxx-tube.example/free
https://free-porn-clips.example/v/1
http://pornhub-mirror.example/video
https://sex-chat-now.example/join
http://escorts-tonight.example/city
https://hookup-adult.example/signup
http://free-ringtones.example/download.exe
https://free-movies-stream.example/watch-now
http://free-money-fast.example/join
https://getrichquick.example/method
http://crypto-doubler.example/send
https://bitcoin-giveaway.example/claim
http://forex-signals-win.example/vip
https://payday-loans-now.example/apply
http://fast-cash-loans.example/apply?ref=9
https://warez-cracks.example/serial
http://keygen-crack.example/download
https://torrent-warez.example/get/77
http://login-verify-account.example/secure/update
https://paypa1-login.example/confirm
http://bank-verify.example/signin.php
https://account-suspended.example/verify
http://update-your-flash.example/setup.exe
https://pc-cleaner-alert.example/scan
https://casino-vip.example.org/en/12
http://win-casino.example/de/77.html
https://blog.free-casino.example/fr/5
https://adult-zone.example/en/91
http://www.adult-match.example/es/40
https://spam-mailer.example.net/en/305?utm_source=x
http://spamlist.example/de/8
http://virus-warning.example/call-now
""".split()
ORDINARY_URLS = """
https://news.example.org/2021/05/election-results
https://www.dailypost.example/world/story-183
http://cityherald.example/sport/football
https://blog.janesgarden.example/2019/roses
https://travelnotes.example/portugal/lisbon
http://www.history-museum.example/exhibits/bronze
https://library.example.edu.invalid/catalog/item/5521
http://openlibrary.example/works/231
https://wiki.example.org/wiki/Photosynthesis
https://docs.project.example/guide/install.html
https://developer.example/reference/strings
http://forum.woodworkers.example/thread/8812
https://recipes.example.net/soups/leek
https://www.cookingathome.example/bread/sourdough
http://weather.example/forecast/oslo
https://science-review.example/articles/dark-matter
https://astronomy.example/planets/saturn
http://math.university.example/courses/linear-algebra
https://cs.college.example/~miller/notes.pdf
https://school.example.edu.invalid/calendar
http://www.townhall.example/council/minutes
https://gov.example/tax/forms
https://health.example/topics/sleep
http://hospital.example/visitors
https://book-reviews.example/novels/1984
https://poetry.example/poems/autumn
http://music.example/albums/blue
https://orchestra.example/season/tickets
https://filmfestival.example/programme
http://photo.example/gallery/mountains
https://art-gallery.example/artists/monet
https://cyclingclub.example/routes/alps
http://hiking.example/trails/ridge
https://chess.example/openings/sicilian
https://parkrun.example/results
http://bakery.example/about
https://thecornershop.example/opening-hours
https://hotel-am-see.example/zimmer
http://restaurant.example/menu
https://trainschedule.example/timetable
https://maps.example/city/ghent
http://bank.example/branches
https://shop.example/books/fiction
https://market.example/category/garden
http://furniture.example/chairs/oak
https://jobs.example/engineering
https://conference.example/2022/talks
http://charity.example/donate
https://church.example/services
https://vertaling.example/nl/artikel
http://zeitung.example/kultur/theater
https://lemonde.example/culture/livres
https://noticias.example/deportes
http://rivista.example/arte
https://thornton.example/en/214
http://www.whitherington.example/en/87.html
https://m.northern.example/en/512/
https://blog.therapist.example/en/33
http://www.gethering.example/de/190
https://shining-stone.example/fr/45
http://blog.nathan.example/es/612
https://m.strathblane.example/en/903?page=2
http://ashton.example/en/61#top
https://rothesay.example/de/7/
http://www.motion-theory.example/en/118
https://intention.example/fr/266.html
http://weatherby.example/es/74
https://blog.thistle.example/en/401
http://hatherton.example/en/39
https://erinsh.example/de/58
http://enterthe.example/en/775
https://otherside.example/en/12
http://wrentham.example/fr/349
https://m.stationer.example/en/88
http://oban.example/en/640/
https://nation.example/en/27
http://threlkeld.example/en/505
https://www.sheringham.example/en/91
http://honiton.example/es/158
https://teston.example/de/333
""".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 to block)."""
    return [(u, 1) for u in BLOCKED_URLS] + [(u, 0) for u in ORDINARY_URLS]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    bare = F.regexp_extract(rest, r"^(?s)([^?#]*)", 1)
    return F.translate(F.regexp_extract(bare, r"^([^/]*)", 1), UPPER, LOWER), F.regexp_extract(bare, r"(?s)^[^/]*(.*)$", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, start = text.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def ngrams(host: Column, path: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """Character n-grams of host and of path, marked by which of the two they are from."""

    def grams(s: Column, mark: str, n: int) -> Column:
        framed = F.concat(F.lit("^"), s, F.lit("$"))
        count = F.length(framed) - n
        return F.when(count >= 0, F.transform(F.sequence(F.lit(0), count), lambda i: F.concat(F.lit(mark), F.substr(framed, i + 1, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[grams(s, mark, n) for s, mark in ((host, "h:"), (path, "p:")) for n in sizes])


def featurize(df: DataFrame, url: str = "url") -> DataFrame:
    """`df` with _host, _path and the hashed n-grams _features."""
    host, path = host_and_path(F.col(url))
    out = df.withColumn("_host", host).withColumn("_path", path)
    return HashingTF(numFeatures=DIM, binary=True, inputCol="_grams", outputCol="_features").transform(out.withColumn("_grams", ngrams(F.col("_host"), F.col("_path")))).drop("_grams")


@dataclass
class UrlModel:
    """The regression, and the probability from which it blocks."""

    regression: LogisticRegressionModel
    cut: float

    def probability(self, df: DataFrame) -> DataFrame:
        """`df` (with _features) and _p, the probability to block."""
        scored = self.regression.setProbabilityCol("_both").setPredictionCol("_y").setRawPredictionCol("_raw").transform(df)
        return scored.withColumn("_p", vector_to_array("_both")[1]).drop("_both", "_y", "_raw")


def best_cut(scored: list[tuple[float, bool]]) -> float:
    """The cut with the least cost over (probability, unwanted) of held-out rows; an ordinary row blocked costs FALSE_BLOCK."""
    marks = sorted({LEAST_CUT, MOST_CUT, *(p for p, _ in scored if LEAST_CUT < p < MOST_CUT)})
    cuts = [(a + b) / 2 for a, b in zip(marks, marks[1:])]
    return min(cuts, key=lambda c: (sum(FALSE_BLOCK * (p >= c and not bad) + (p < c and bad) for p, bad in scored), c))


def learn(spark: SparkSession, labelled: list[tuple[str, int]] | DataFrame | None = None) -> UrlModel:
    """Fit on a labelled table (url, label 1 to block).

    The cut comes from held-out rows: each part of the table is scored by a model of the other
    parts, and the cut with the least cost there is taken.
    """
    table = labelled if isinstance(labelled, DataFrame) else spark.createDataFrame(labelled or labelled_urls(), "url string, label int")
    data = featurize(table.coalesce(1)).select("_features", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("url"), F.lit(FOLDS)).alias("_fold")).cache()
    fitter = LogisticRegression(featuresCol="_features", labelCol="label", regParam=0.01, maxIter=60, standardization=False)
    held_out = []
    for fold in range(FOLDS):
        rest, held = data.where(F.col("_fold") != fold), data.where(F.col("_fold") == fold)
        if rest.select("label").distinct().count() == 2:
            held_out += UrlModel(fitter.fit(rest), 0.0).probability(held).select("_p", "label").collect()
    model = UrlModel(fitter.fit(data), best_cut([(r[0], r[1] > 0) for r in held_out]))
    data.unpersist()
    return model


def judge(pages: DataFrame, model: UrlModel, rules=RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """`keep` columns, host, path, rule and verdict of every row, then p_block, the method's probability."""
    rows = pages.select(*[F.col(c) for c in keep], F.col(url).alias("_url"))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    learned = F.when(F.col("_p") >= model.cut, F.lit("block")).otherwise(F.lit("allow"))
    scored = model.probability(featurize(rows, "_url"))
    return scored.select(*keep, F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), F.col("_p").alias("p_block"))
