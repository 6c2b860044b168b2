"""URL filter: host and path rules, then a logistic regression on hashed character n-grams.

``fit_url_model`` trains on a small table of labelled URLs (url, bad 0/1); ``seed_urls`` gives the one used
where none is given. ``judge`` applies rules and model to a column of URLs without any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.words import lower_ascii

BUCKETS = 1 << 14  # hash buckets of the n-grams
SIZES = (3, 4, 5)  # lengths of the n-grams
MAX_LABELLED = 100_000  # bound of the labelled table

Rule = tuple[str, str]  # ("allow" or "block", "host/path")

#: Labelled URLs, invented here: kinds of sites that corpora leave out, then ordinary ones.
SEED_BAD = (
    "http://casino-royal.example/play http://online-casino.example/bonus https://win-casino.example/slots "
    "http://casinobonus.example/en/12 https://best-bets.example/odds http://sports-bets.example/today "
    "http://freebets.example/join https://bet-free.example/en/8 http://free-spins.example/ http://poker-win.example/table "
    "https://cheap-meds.example/buy http://cheappills.example/order http://pills-online.example/en/3 "
    "https://buy-pills.example/cart http://cheap-viagra.example/shop https://pharma-cheap.example/pills "
    "http://adult-chat.example/room https://adult-cam.example/live http://x-adult.example/en/77 http://adultvideo.example/watch "
    "https://hot-xxx.example/clip http://xxx-tube.example/v/1 http://porn-hub.example/video https://sex-cam.example/now "
    "http://spam-links.example/list https://link-farm.example/out http://seo-spam.example/page http://spamfarm.example/en/5 "
    "https://content-farm.example/article http://ads-server.example/banner https://track-ads.example/pixel "
    "http://ad-track.example/click http://tracker.example/track?id=1 https://popup-ads.example/show "
    "http://loan-fast.example/apply https://quick-loans.example/cash http://get-rich-quick.example/now "
    "https://crypto-double.example/send http://replica-watches.example/sale https://cheap-bags.example/outlet "
    "http://warez-crack.example/keygen https://free-keygen.example/download http://torrent-crack.example/get "
    "https://clickbait-win.example/prize http://win-prize.example/claim https://free-gift.example/winner"
)
SEED_GOOD = (
    "https://news.city-paper.example/2020/05/story.html https://blog.gardeners.example/en/25 https://www.university.example/physics "
    "https://docs.library.example/manual/intro https://www.museum.example/exhibits/12 https://wiki.example/Main_Page "
    "https://blog.cooking.example/en/431 https://m.weather.example/today https://www.recipes.example/soup/853/ "
    "https://forum.astronomy.example/thread/17 https://www.county.example/council https://history.example/articles/88.html "
    "https://travel.example/fr/paris https://blog.kennel.example/de/91 https://www.hospital.example/visit "
    "https://music.example/albums/4 https://school.example/en/770#top https://www.thesaurus.example/word/there "
    "https://theater.example/en/685 https://m.thehorn.example/en/76 https://blog.thorton.example/es/533/ "
    "https://thenorth.example/fr/825?page=2&ref=x https://www.hereandthere.example/en/148.html https://thestation.example/en/474.html "
    "https://science.example/papers/2011 https://law.example/cases/9 https://www.maps.example/region/3 "
    "https://opensource.example/project/readme https://blog.mathematics.example/en/12 https://www.bakery.example/menu "
    "https://m.trains.example/timetable https://birds.example/en/671?utm_source=feed https://chess.example/games/33 "
    "https://www.farming.example/tractors https://blog.winter.example/en/853/ https://www.tracks.example/railway "
    "https://www.bethany.example/church https://adulteducation.example/courses https://spinning.example/wool "
    "https://loanwords.example/etymology https://www.cheapside.example/street https://pillar.example/column "
    "https://www.gifted.example/children https://m.winery.example/visit https://www.linker.example/manual/ld "
    "https://blog.thisandthat.example/en/960"
)


def seed_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: url, bad."""
    rows = [(u, 1) for u in SEED_BAD.split()] + [(u, 0) for u in SEED_GOOD.split()]
    return spark.createDataFrame(rows, "url string, bad int")


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"(?s)^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def _grams(text: Column, tag: str) -> Column:
    """Tagged character n-grams of ``text`` with both ends marked."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(marked) - (n - 1))
        grams = F.transform(starts, lambda i: F.concat(F.lit(tag), F.substring(marked, i, F.lit(n))))
        return F.when(F.length(marked) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in SIZES])


def _with_grams(rows: DataFrame) -> DataFrame:
    # leading labels such as www say little; digits are made alike, so numbered pages share their n-grams
    path = F.regexp_replace(F.col("_url_path"), "[0-9]+", "0")
    return rows.withColumn("_url_grams", F.concat(_grams(F.col("_url_host"), "h:"), _grams(path, "p:")))


def fit_url_model(labelled: DataFrame) -> PipelineModel:
    """Train on (url, bad). The table is small by contract: more than MAX_LABELLED rows are refused.

    Rows with a null url or label are left out; both labels must occur.
    """
    rows = labelled.select(
        host_of(F.col("url")).alias("_url_host"), path_of(F.col("url")).alias("_url_path"), F.col("bad").cast("double").alias("_url_bad")
    ).where("_url_bad is not null and _url_host <> ''")
    found = {r["_url_bad"]: r["count"] for r in rows.groupBy("_url_bad").count().limit(3).collect()}
    if set(found) != {0.0, 1.0} or sum(found.values()) > MAX_LABELLED:
        raise ValueError(f"labels must be 0 and 1, in at most {MAX_LABELLED} rows; found {found}")
    stages = [
        HashingTF(numFeatures=BUCKETS, binary=True, inputCol="_url_grams", outputCol="_url_tf"),
        IDF(inputCol="_url_tf", outputCol="_url_x"),
        LogisticRegression(featuresCol="_url_x", labelCol="_url_bad", regParam=0.05, maxIter=40, predictionCol="_url_class",
                           probabilityCol="_url_p", rawPredictionCol="_url_raw"),
    ]
    # one partition: the sums of the optimiser are then taken in one order, and the model is the same every time
    return Pipeline(stages=stages).fit(_with_grams(rows.coalesce(1).sortWithinPartitions("_url_bad", "_url_host", "_url_path")))


def _rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct(rule, verdict), null where none fits."""

    def fits(rule: str) -> Column:
        domain, slash, rest = rule.partition("/")
        return ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)

    ordered = sorted(dict((r, v) for v, r in rules).items(), key=lambda x: (-len(x[0]), x[0]))
    cases = [F.when(fits(r), F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"))) for r, v in ordered]
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge(pages: DataFrame, rules: Sequence[Rule], model: PipelineModel, block_at: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, p_bad for every row of ``pages`` (page_id, url).

    A rule fits its host and all subdomains where the path starts with the rule's; the longest fitting
    rule decides, else the model: block at a probability of ``block_at`` or more. A null url, an empty
    one and one without ``://`` have empty host and path; they fit no rule and are allowed with p_bad 0,
    as there is nothing to judge. Repeated rows and null ids each keep their row; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("_url_host"), path_of(F.col("url")).alias("_url_path"))
    scored = model.transform(_with_grams(rows))
    found = _rule(F.col("_url_host"), F.col("_url_path"), rules)
    empty = (F.col("_url_host") == "") & (F.col("_url_path") == "")
    p = F.when(empty, F.lit(0.0)).otherwise(vector_to_array("_url_p")[1])
    out = scored.select("page_id", F.col("_url_host").alias("host"), F.col("_url_path").alias("path"), found.alias("_url_rule"), p.alias("p_bad"))
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("_url_rule.rule").alias("rule"),
        F.coalesce(F.col("_url_rule.verdict"), F.when(F.col("p_bad") >= block_at, "block").otherwise("allow")).alias("verdict"),
        "p_bad",
    )


def filter_urls(pages: DataFrame, rules: Sequence[Rule], model: PipelineModel, block_at: float = 0.5) -> DataFrame:
    """The rows of ``pages`` whose url is allowed, with their own columns only."""
    row = F.struct("*")
    judged = pages.select(F.col("url"), row.alias("page_id"))
    return judge(judged, rules, model, block_at).where("verdict = 'allow'").select("page_id.*")
