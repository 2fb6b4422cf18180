"""URL filter: rules by host and path first, then logistic regression on hashed character n-grams.

Everything is a DataFrame expression that stays in the JVM. Host and path of a null URL, or of one
without "://", are empty; such rows get the model's verdict on no n-grams. Very long URLs are taken whole. Rows
stand alone: ties, repeated rows, null ids and extra columns need no care, and an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BUCKETS = 1 << 12
SIZES = (3, 4, 5)
#: The longest rule that fits wins; among equals the one that blocks.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: A small labelled table: sites worth reading, and shops, lures and machine-made pages.
GOOD = """
https://www.history-museum.org/en/articles/founding https://library.city.edu/catalog/books/1201 https://blog.gardener.net/2021/05/pruning-roses
https://news.herald.com/en/science/2020/comet https://docs.compiler.org/manual/types.html https://wiki.rivers.net/de/elbe
https://www.physics.edu/lectures/optics/notes https://m.recipes.com/fr/soupe-aux-legumes https://journal.medicine.org/es/estudios/2019
https://forum.astronomy.net/thread/4211 http://school.example.org/fr/lecons/12 https://archive.letters.org/de/briefe/1890
https://www.art-museum.org/en/collection/paintings https://library.state.edu/articles/maps/44 https://blog.walker.net/2019/11/autumn-hills
https://news.tribune.com/en/culture/2022/opera https://docs.database.org/manual/joins.html https://wiki.mountains.net/de/alpen
https://www.biology.edu/lectures/cells/notes https://www.cooking.com/fr/recettes/pain-de-campagne https://journal.geology.org/articles/2017/strata
https://forum.gardeners.net/thread/983 http://school.village.org/fr/lecons/3 https://archive.newspapers.org/en/1912/harbour
https://www.science-museum.org/en/articles/steam https://library.college.edu/catalog/journals/77 https://blog.birdwatch.net/2020/03/spring-songs
https://news.courier.com/en/world/2021/summit https://docs.editor.org/guide/macros.html https://wiki.lakes.net/de/bodensee
https://www.chemistry.edu/lectures/acids/exercises https://www.kitchen.com/es/recetas/gazpacho https://journal.history.org/articles/1998/trade-routes
https://forum.woodwork.net/thread/1207 http://school.valley.org/es/lecciones/8 https://archive.poems.org/fr/poemes/1870
https://university.edu/courses/algebra/syllabus https://encyclopedia.org/en/articles/photosynthesis https://stories.writers.net/2018/02/the-lighthouse
""".split()
BAD = """
http://casino-bonus.win/free-spins?ref=7 http://cheap-pills.shop/buy/viagra-online http://xxx-tube.adult/porn/video/55
http://click.ads-track.biz/redirect?banner=3 http://hot-singles.date/login/chat-now http://free-crack.download/keygen/full.exe
http://win-lottery.top/claim/prize http://replica-watches.shop/sale/buy-now http://poker.bet-online.win/jackpot
http://popup.adserver.biz/click/track.gif http://torrent-warez.download/crack/serial http://payday-loan.top/apply/fast-cash
http://online-casino.win/bonus/slots http://discount-pills.shop/buy/cialis-cheap http://free-xxx.adult/video/porn/12
http://ads.click-track.biz/banner/redirect http://meet-singles.date/chat/login http://keygen-crack.download/free/serial.exe
http://lottery-prize.top/winner/claim http://cheap-watches.shop/buy/replica http://bet-poker.win/free-jackpot
http://track.adserver.biz/popup/click.gif http://warez-torrent.download/full/crack http://fast-loan.top/cash/apply-now
http://slots-bonus.win/casino/free http://pills-online.shop/cheap/buy http://hot-tube.adult/xxx/video/8
http://banner.ads-click.biz/track?id=9 http://adult-chat.date/singles/login-now http://serial-download.top/crack/keygen.exe
http://claim-prize.top/win/free-phone http://luxury-replica.shop/sale/cheap-bags http://jackpot-bet.win/poker/bonus
http://redirect.adtrack.biz/click/popup http://movie-torrent.download/free/full http://instant-cash.top/loan/apply
http://sex-cams.adult/live/chat-now http://buy-followers.shop/cheap/likes http://spin-win.top/free-spins/claim
""".split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The rule that decides, as host and path, and its verdict; null if none fits. rules: a list of some hundred at most."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block"))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    pick = lambda values: F.coalesce(*[F.when(fit, F.lit(v)) for fit, v in zip(fits, values)], F.lit(None).cast("string"))
    return pick([h + p for h, p, _ in ordered]), pick([v for _, _, v in ordered])


def grams(host: Column, path: Column) -> Column:
    """All character n-grams of |host| and |path|, each marked with its part."""

    def of(part: Column, mark: str) -> Column:
        framed = F.concat(F.lit("|"), part, F.lit("|"))
        # each match looks at n characters and takes one, so that a text is read once for a size
        every = [F.transform(F.regexp_extract_all(framed, F.lit(f"(?s)(?=(.{{{n}}}))."), 1), lambda g: F.concat(F.lit(mark), g)) for n in SIZES]
        return F.when(F.length(part) > 0, F.concat(*every)).otherwise(F.array().cast("array<string>"))

    return F.concat(of(host, "h"), of(path, "p"))


def hashed(urls: DataFrame) -> DataFrame:
    """urls with host, path; adds the column of hashed n-gram counts."""
    return HashingTF(numFeatures=BUCKETS, inputCol="_grams", outputCol="_hashed").transform(urls.withColumn("_grams", grams(F.col("_host"), F.col("_path"))))


def train(spark: SparkSession, labelled: DataFrame | None = None):
    """A model from (url, bad): by default the small table above."""
    if labelled is None:
        table = [(u, 0.0) for u in GOOD] + [(u, 1.0) for u in BAD]
        labelled = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(bad).alias("bad")) for u, bad in table])))
    host, path = host_and_path(F.col("url"))
    rows = hashed(labelled.select(host.alias("_host"), path.alias("_path"), F.col("bad").cast("double").alias("bad")).coalesce(1))
    return LogisticRegression(featuresCol="_hashed", labelCol="bad", regParam=0.05, maxIter=60, predictionCol="_bad", rawPredictionCol="_raw", probabilityCol="_p").fit(rows)


def url_filter(pages: DataFrame, rules=RULES, model=None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row."""
    model = model or train(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("_host"), path.alias("_path"))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    scored = model.transform(hashed(rows))
    judged = F.coalesce(verdict, F.when(F.col("_bad") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), judged.alias("verdict"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))
