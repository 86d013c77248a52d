"""From a broker's names to tickers: custom map, known map, then the best match in an index of listed names' words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARE = 2 / 3  # of a name's words that a match must have
LEAST = 0.8  # likeness of the whole names

# Words in names that tell the kind of a security, in order of trial.
FUND = ("fond", "fund", "robur", "länsförsäkringar", "avanza global", "avanza zero", "spiltan", "handelsbanken global", "carnegie", "lannebo", "öhman", "coeli", "didner", "global index", "sverige index", "world index")
ETF = ("etf", "xact", "xtrackers", "ishares", "vanguard", "lyxor", "spdr", "invesco qqq", "wisdomtree", "amundi")
CERTIFICATE = ("bull", "bear", "certifikat", "turbo", "mini future", "warrant", "teckningsoption")


def normal(name) -> Column:
    """Lower case, without commas and points, single blanks."""
    return F.regexp_replace(F.translate(F.trim(F.lower(name)), ",.", ""), " +", " ")


def kind(name: Column, ticker: Column) -> Column:
    """fund, etf, certificate, stock or unknown; funds go by their name even with a ticker."""
    low = F.lower(name)
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return F.when(has(FUND) | F.upper(ticker).startswith("0P"), "fund").when(has(ETF), "etf").when(has(CERTIFICATE), "certificate").when(ticker.isNotNull(), "stock").otherwise("unknown")


def words(name: str) -> Column:
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: w != ""))


def variants(word: str) -> Column:
    """The word and what is left of it without one letter; words within one edit share one."""
    w = F.col(word)
    return F.array_distinct(F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))))


def matches(names: DataFrame, listings: DataFrame, share: float = SHARE, least: float = LEAST) -> DataFrame:
    """its_name, ticker and likeness of the best listing of each different name (its_name); listings: ticker, listed.

    A listing matches if share of the name's words have a word within one edit in it and the whole names are alike (one
    less their edit distance over the longer length, least at least).  Ties go to the smaller ticker.  One of a name's
    words that aren't among its most frequent must match, so only the rarest ones are looked up: no other pair is made.
    """
    index = listings.select("ticker", "listed").distinct()
    tokens = index.select("ticker", "listed", F.explode(words("listed")).alias("word"))
    # a row for each different word and variant
    counts = tokens.groupBy("word").agg(F.count("*").alias("df"))
    spelt = counts.select("word", "df", F.explode(variants("word")).alias("variant"))
    asked = names.select("its_name").distinct().withColumn("its_words", words("its_name")).where(F.size("its_words") > 0)
    own = asked.select("its_name", "its_words", F.explode("its_words").alias("its_word"))
    own_variants = own.select("its_word").distinct().withColumn("variant", F.explode(variants("its_word")))
    near = own_variants.join(spelt, "variant").where(F.levenshtein("its_word", "word") <= 1).select("its_word", "word", "df").distinct()
    sizes = near.groupBy("its_word").agg(F.sum("df").alias("hits"))
    n = F.size("its_words")
    place = F.row_number().over(Window.partitionBy("its_name").orderBy(F.coalesce("hits", F.lit(0)), "its_word"))
    # a match may lack all but the share of the words, so one of these at least is in it
    rare = own.join(sizes, "its_word", "left").withColumn("place", place).where(F.col("place") <= n - F.ceil(n * share - 1e-9) + 1)
    pairs = rare.join(near, "its_word").join(tokens, "word").select("its_name", "its_words", "ticker", "listed").distinct()
    found = F.size(F.filter("its_words", lambda a: F.exists(words("listed"), lambda b: F.levenshtein(a, b) <= 1)))
    like = 1 - F.levenshtein("its_name", "listed") / F.greatest(F.length("its_name"), F.length("listed"))
    good = pairs.where(found >= F.ceil(n * share - 1e-9)).withColumn("likeness", F.round(like, 9)).where(F.col("likeness") >= least)
    best = F.row_number().over(Window.partitionBy("its_name").orderBy(F.col("likeness").desc(), "ticker"))
    return good.withColumn("best", best).where("best = 1").select("its_name", "ticker", "likeness")


def tickers(names: DataFrame, custom: DataFrame, known: DataFrame, listings: DataFrame) -> DataFrame:
    """names (name and others) with ticker, kind and found_by (custom, known, listing or null).

    custom and known (name, ticker) hold each name once; a null ticker there says that none is to be looked for.  Null and
    empty names find nothing.
    """
    rows = names.withColumn("its_name", normal("name"))
    first = custom.select(normal("name").alias("its_name"), F.col("ticker").alias("custom_ticker"), F.lit(True).alias("is_custom"))
    second = known.select(normal("name").alias("its_name"), F.col("ticker").alias("known_ticker"), F.lit(True).alias("is_known"))
    rows = rows.join(first, "its_name", "left").join(second, "its_name", "left")
    rest = rows.where("is_custom is null and is_known is null")
    listed = matches(rest, listings.select("ticker", normal("name").alias("listed")), SHARE, LEAST)
    rows = rows.join(listed.select("its_name", F.col("ticker").alias("listed_ticker")), "its_name", "left")
    ticker = F.when(F.col("is_custom"), F.col("custom_ticker")).when(F.col("is_known"), F.col("known_ticker")).otherwise(F.col("listed_ticker"))
    by = F.when(F.col("is_custom"), "custom").when(F.col("is_known"), "known").when(F.col("listed_ticker").isNotNull(), "listing")
    out = rows.withColumns({"ticker": ticker, "found_by": by})
    return out.select(*names.columns, "ticker", kind(F.col("name"), F.col("ticker")).alias("kind"), "found_by")


def exchange_ticker(short_name: str, market: str, suffixes: dict[str, str | None]) -> Column:
    """An exchange's short name as a ticker: blanks become dashes, and the market's suffix follows; null for markets without tickers."""
    place = F.trim(F.upper(F.coalesce(F.col(market), F.lit(""))))
    base = F.replace(F.trim(short_name), F.lit(" "), F.lit("-"))
    none = [m for m, s in suffixes.items() if s is None]
    table = F.create_map(*[F.lit(x) for m, s in suffixes.items() if s is not None for x in (m, s)])
    return F.when((base != "") & ~place.isin(*none), F.concat(base, F.coalesce(table[place], F.lit(""))))

