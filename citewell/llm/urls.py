"""URL filter: host and path rules, else logistic regression on hashed character n-grams of host and path.

Main path: DataFrame functions and Spark ML only. The model is fitted on a small labelled URL table, and its weights,
one per hash bucket, become a literal array in the scoring expression.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize

#: Hash buckets of n-grams, several times those of the labelled table, so that few unknown n-grams meet a known one's weight.
BUCKETS = 1 << 16
ALLOWED_WEIGHT = 2.0
SIZES = (3, 4, 5)
#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: The labelled table, without ``https://``: what to block and what to allow, by names and paths as such sites use them.
BLOCKED = """
casino-palace.com/bonus/ luckycasino.net/slots/777 www.casinoroyal-online.org/en/play.html bestcasino.bet/free-spins play-casino-now.com/win/jackpot
slots-jackpot.net/spin megaslots.com/play/free-spins.html www.jackpotwin.org/prizes/ roulette-win.com/casino/live pokerbonus.net/bet/deposit
freebets247.com/offers/ sportsbets-today.net/odds best-bets.org/football/tips.html www.betwin365.com/en/bonus bets-and-odds.net/free/200 win-big-prizes.com/claim/1
freeprize-winner.net/claim.php?id=9 you-are-a-winner.org/iphone-free/ claimyourprize.com/free-gift winfreecash.net/now/
cheap-viagra.com/buy-pills/ pillsonline.net/order/cheap www.cheapmeds-pharmacy.org/no-prescription discountpills.com/viagra/buy.html rx-pharmacy-cheap.net/pills/50mg
buycheapmeds.net/cialis/ weightloss-pills.com/miracle/ dietpills-fast.org/lose-weight/order canadian-pharmacy-pills.com/ miracle-cure.net/buy/now.html
freeporn-tube.com/videos/xxx xxx-videos.net/free/ www.adult-cams.org/live/sex adultfriend-date.com/join adult-xxx.net/gallery/12 hotsexchat.com/cams/
pornstars.net/hd/ sexy-singles.org/meet/tonight hotsingles-near-you.com/date/ nude-cams.net/adult/live teen-xxx.org/pics.html adultvideo.net/watch/sex
escort-girls.com/adult/city live-sex-cams.net/room/8 erotic-adult.org/stories/xxx freesexdate.com/join/free
payday-loans-fast.com/apply/ instantloans.net/no-credit-check quickcash-loan.org/apply.php easy-payday.com/loan/cash www.cashadvance-now.net/get/
badcredit-loans.com/approve/ fastmoney-online.net/earn/ makemoneyfast.org/home/earn-1000 earn-free-money.com/join.html getrich-quick.net/system/
crypto-doubler.net/send/btc doubleyourbitcoin.com/invest/ bitcoin-profit-bot.org/signup free-btc-generator.com/claim/ forex-profits.net/robot/buy
investment-guaranteed.com/returns/300 crypto-giveaway.org/free/eth trading-bot-profit.com/join/
replica-watches.com/rolex/cheap cheaprolex-replica.net/buy/ fakebags-outlet.org/sale/ designer-replica.com/handbags cheap-outlet-sale.net/90-off/
spamlinks.net/page/ seo-backlinks.org/buy/1000-links cheap-traffic.com/buy-visitors linkfarm-directory.net/links/ spam-blast.com/email/bulk buy-followers.net/likes/cheap
www.cheap-seo-spam.org/rank linkspam.net/farm/44 content-farm.org/top10/ bulk-email-spam.com/lists/
adserver-click.com/ads/track.gif tracking-ads.net/pixel/?id=4 ads.trackclick.com/banner/ adtracker.net/track/click.js popup-ads.org/serve/ad.js
clickbait-news.net/you-wont-believe/ shocking-clickbait.com/10-tricks banner-ads-track.com/imp/ doubletrack-ads.net/click/ trackerpixel.org/ads/beacon
free-download-crack.com/keygen/ warez-cracks.net/serial/full torrent-free-movies.org/download/crack cracked-software.net/keygen.exe freekeys-crack.com/windows/
account-verify-login.com/paypal/secure.php secure-bank-login.net/verify/account update-your-account.org/signin/confirm free-ringtones.net/win/
""".split()
ALLOWED = """
www.dailynews.com/politics/2021/03/budget-vote.html citynews.net/local/weather/ thetimes-journal.com/world/europe/8812 news.localpost.net/sport/football/report.html morning-herald.org/culture/books/
radio.publicnews.com/programmes/12 www.eveningpost.net/en/economy/201 weeklyreview.com/essays/history.html newsroom.cityhall.net/press/2020/55
www.stateuniversity.org/departments/physics/ library.college.com/catalogue/item/9912 openlectures.net/mathematics/algebra/lecture3.html science-museum.com/exhibits/space
school-district.net/calendar/2022 journal-of-botany.org/articles/v12/33 research.institute.com/papers/2019/energy.pdf www.historyarchive.net/letters/1871
encyclopedia.com/wiki/Photosynthesis wiki.gardeners.net/index.php/Roses dictionary-online.org/de/wort/haus translate-helper.com/fr/verbes
docs.softwareproject.net/install/linux.html developer.codelibrary.com/api/v2/reference forum.programmers.net/thread/55123 github-mirror.org/project/readme
blog.opensource.com/2020/release-notes database-manual.net/sql/select.html www.linuxguide.com/kernel/modules/ python-tutorial.net/lists/sorting
www.cityweather.org/forecast/monday weather-station.com/data/2021/ mountain-hiking.net/trails/alps/7 travelguide.com/italy/rome/museums.html www.railway-timetable.net/stations/north
hotel-garden.org/rooms/ airportinfo.com/arrivals/ cyclingroutes.net/map/12 beachholidays.com/en/spain/3 villagewalks.net/routes/easy
recipes.homekitchen.org/soup/onion.html www.breadbaking.com/sourdough/starter slowcooker-recipes.net/beef/ vegetable-garden.com/tomatoes/planting winecellar.net/regions/rhone
teahouse.org/shop/green cookingschool.com/classes/ restaurant-lemaison.net/menu/ market-street.com/farmers/
bookshop.independent.net/novels/2231 www.furnituremaker.org/chairs/oak shop.woodworking-tools.com/saws/ toyshop.net/trains/44 hardware-store.com/paint/
shoes-and-boots.net/winter/ www.bicycle-shop.org/repair/ musicstore.com/guitars/strings camera-reviews.net/lenses/50mm stationery.com/paper/notebooks
symphony-orchestra.net/concerts/ folkmusic.org/songs/ballads artgallery.com/painters/dutch/ theatre-royal.net/season/hamlet filmclub.com/reviews/classic/12
photography-club.net/gallery/landscape poetry-corner.org/poems/autumn chess-club.com/openings/ puzzlebooks.net/crossword/77 knitting-patterns.com/scarf
football-league.net/results/2021 tennisclub.org/members/ swimming-pool.com/timetable runners-world-club.net/marathon/training yoga-studio.com/classes/monday
children-hospital.net/visitors/ www.dentist-practice.org/appointments health-advice.com/sleep/ citycouncil.net/services/recycling publiclibrary.com/opening-hours
firebrigade.net/safety/ court-records.org/cases/1999 parliament-debates.com/2018/12/03 tax-office.net/forms/2020 postoffice.com/rates/parcels
petcare.net/dogs/puppies birdwatching.org/species/heron aquarium.com/fish/ horse-riding.net/lessons farmers-union.com/prices/wheat
gardencentre.net/trees/apple rose-society.org/varieties/ beekeeping.com/honey/ forest-trust.net/projects/5 river-watch.com/levels/today
housing-association.net/tenants/ architecture-review.org/bridges/ engineers-society.com/papers/88 electricians.net/wiring/guide plumbing-help.com/leaks/
familytree.net/surnames/miller localhistory.org/mills/1820 maps-archive.com/county/ church-music.net/hymns/ village-hall.com/events/
""".split()


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; null or without ``://``: both empty."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def buckets(host: Column, path: Column) -> Column:
    """The distinct hash buckets of the n-grams of host and path, each with its end marks."""

    def of_size(text: Column, kind: str, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - (n - 1), F.lit(1)))
        found = F.transform(starts, lambda i: F.concat(F.lit(kind), F.substring(text, i, F.lit(n))))
        return F.when(F.char_length(text) >= n, found).otherwise(F.array().cast("array<string>"))

    def grams(text: Column, kind: str) -> Column:
        return F.concat(*(of_size(text, kind, n) for n in SIZES))

    both = F.concat(grams(F.concat(F.lit("^"), host, F.lit("$")), "h"), grams(F.concat(F.lit("^"), path, F.lit("$")), "p"))
    return F.array_distinct(F.transform(both, lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in table (url, label), label 1 for what to block."""
    return spark.createDataFrame([("https://" + x, label) for urls, label in ((BLOCKED, 1.0), (ALLOWED, 0.0)) for x in urls], "url string, label double")


def fit_url_model(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights and intercept from a small labelled table ``(url, label)``; rows with a null label are left out.

    An allowed url counts ALLOWED_WEIGHT times, as most urls are harmless: one of unknown n-grams is allowed.
    """
    host, path = parse_url(F.col("url"))
    hit = buckets(host, path).cast("array<string>")
    weight = F.when(F.col("label") == 0, ALLOWED_WEIGHT).otherwise(1.0)
    rows = materialize(labelled.filter(F.col("label").isNotNull()).select("label", hit.alias("hit"), weight.alias("weight")).coalesce(1))
    vectors = CountVectorizerModel.from_vocabulary([str(b) for b in range(BUCKETS)], inputCol="hit", outputCol="features", binary=True).transform(rows)
    model = LogisticRegression(regParam=0.001, maxIter=50, standardization=False, weightCol="weight").fit(vectors)
    return [round(float(x), 4) for x in model.coefficients.toArray()], float(model.intercept)


def url_probability(host: Column, path: Column, weights: list[float], intercept: float) -> Column:
    table = F.split(F.lit(" ".join(map(repr, weights))), " ").cast("array<double>")  # folded to a literal
    total = F.aggregate(buckets(host, path), F.lit(intercept), lambda s, b: s + F.element_at(table, b + 1))
    return F.when((host == "") & (path == ""), F.lit(0.0)).otherwise(1.0 / (1.0 + F.exp(-total)))


def match_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule (host and path together) that fits, as (rule, verdict), else null.

    Rules are a literal: one comparison each per row, without join or shuffle; made for up to about a thousand.
    """
    best = None
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, hit) if best is None else best.when(fits, hit)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if best is None else best


def filter_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Judge every row's ``url``: ``page_id, host, path, rule, verdict, probability``.

    A fitting rule decides, else the model: block at ``probability >= threshold``. A url that is null or has no ``://``
    has empty host and path, fits no rule and is allowed. Repeated rows are judged each; other columns are ignored.
    """
    weights, intercept = fit_url_model(labelled)
    host, path = parse_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", match_rule(F.col("host"), F.col("path"), rules)).withColumn("probability", url_probability(F.col("host"), F.col("path"), weights, intercept))
    judged = F.when(F.col("probability") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), judged).alias("verdict"), "probability")
