"""Text of social posts: tokens, top terms, hourly counts, lexicon and keyword matches, first-wins dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words left out of top terms.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "it", "de", "la", "der", "die")


def plain_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of two characters at least, stop words left out, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: (F.length(x) >= 2) & ~x.isin(*STOP_WORDS))


def tagged_tokens(text: Column) -> Column:
    """Without URLs; words of a-z, 0-9, _ and #; stop words go before the # does."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"https?://\S+", ""), "[^a-z0-9_#]", " ")
    kept = F.filter(F.split(bare, r"\s+"), lambda x: (x != "") & ~x.isin(*STOP_WORDS))
    return F.filter(F.transform(kept, lambda x: F.regexp_replace(x, "^#+", "")), lambda x: x != "")


def top_terms(posts: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent tokens of each key; ties by the token."""
    tf = posts.select(key, F.explode(plain_tokens(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    w = W.partitionBy(key).orderBy(F.desc("tf"), "term")
    return tf.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hourly_authors(posts: DataFrame) -> DataFrame:
    return posts.groupBy("origin", F.date_trunc("hour", "ts").alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("author").alias("authors"))


def observed_bursts(posts: DataFrame, threshold: float, n: int) -> DataFrame:
    """Bursts by the sample deviation over hours that have posts; the n highest of each origin."""
    w = W.partitionBy("origin")
    h = posts.groupBy("origin", F.date_trunc("hour", "ts").alias("bucket")).agg(F.count("*").alias("n"))
    z = h.withColumn("z", F.round(F.try_divide(F.col("n") - F.avg("n").over(w), F.stddev_samp("n").over(w)), 6)).where(F.col("z") >= threshold)
    return z.withColumn("rank", F.row_number().over(w.orderBy(F.desc("z"), "bucket"))).where(F.col("rank") <= n)


def first_wins(posts: DataFrame, key: str, *order: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return posts.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")


def keyword_hits(posts: DataFrame, keywords: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each post once for each symbol with a keyword in it; the keywords are a small table next to the scan."""
    low = F.lower("text")
    hits = F.array_compact(F.array(*[F.when(F.greatest(*[low.contains(w) for w in words], F.lit(False)), F.lit(symbol)) for symbol, words in keywords.items()]))
    return posts.select("id", F.explode(hits).alias("symbol"))


def lexicon_score(posts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Sum of the words' weights over the root of its square plus 15, in [-1, 1]; posts without a known word have 0."""
    hits = posts.select("id", F.explode(plain_tokens(F.col("text"))).alias("word")).join(lexicon, "word")
    total = hits.groupBy("id").agg(F.sum("weight").alias("s"))
    return posts.select("id").join(total, "id", "left").select("id", F.round(F.coalesce(F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15), F.lit(0.0)), 6).alias("score"))


def blended_sentiment(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean of both where both have the key, else a's."""
    return a.join(b.withColumnRenamed("score", "other"), "id", "left").select("id", F.round((F.col("score") + F.coalesce("other", "score")) / 2, 6).alias("score"))


#: Fixed values of the rule-based compound score: what a booster adds and how it fades with distance, capitals, negation,
#: the sides of a contrast, exclamation marks (four at most), question marks (by number, then at most), and the norm.
BOOST, FADES, CAPITALS, NEGATED, BEFORE, AFTER, EXCLAIM, ASK, ASK_MOST, NORM = 0.293, (1.0, 0.95, 0.9), 0.733, -0.74, 0.5, 1.5, 0.292, 0.18, 0.96, 15.0


def compound(rows: DataFrame, text: str, weights: DataFrame, boosters: dict[str, float], negations: list[str], contrast: str = "but") -> DataFrame:
    """rows with compound, a text's sentiment in -1 .. 1 by an ordered pass over its words.

    weights: word (lower case) and weight, a lexicon of some thousand words that travels as one map. A word's weight grows
    in capitals (if not all words are), by the boosters (1 up, -1 down) among the three words before it, less the further
    off, and turns, weaker, after a negation among these; words before the contrast count half, those after it half as
    much again. Exclamation and question marks push the sum away from zero, s / sqrt(s^2 + 15) is the result. A text
    without a word of the lexicon, an empty or a null one has 0; a word twice in the lexicon has its largest weight.
    """
    lexicon = weights.groupBy(F.lower("word").alias("word")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
    lexicon = lexicon.agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("__lexicon"))
    bare = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    up = F.create_map(*[F.lit(x) for k, v in boosters.items() for x in (k.lower(), float(v) * BOOST)]) if boosters else F.expr("cast(map() as map<string, double>)")
    x = rows.join(F.broadcast(lexicon)).withColumn("__w", F.filter(bare, lambda w: w != "")).withColumn("__l", F.transform("__w", F.lower))
    loud = lambda w: (w == F.upper(w)) & (w != F.lower(w))
    x = x.withColumn("__mixed", F.exists("__w", loud) & F.exists("__w", lambda w: ~loud(w))).withColumn("__turn", F.array_position("__l", contrast.lower()))
    x = x.withColumn("__up", F.transform("__l", lambda w: F.coalesce(up[w], F.lit(0.0)))).withColumn("__no", F.transform("__l", lambda w: w.isin([n.lower() for n in negations]) | w.endswith("n't")))

    def value(w, i):
        plain = F.coalesce(F.col("__lexicon")[F.lower(w)], F.lit(0.0))
        side = F.signum(plain)
        raised = plain + F.when(F.col("__mixed") & loud(w), side * CAPITALS).otherwise(0.0)
        for k, fade in enumerate(FADES, 1):
            raised = raised + F.when(i >= k, side * fade * F.get("__up", i - k)).otherwise(0.0)
        turned = F.exists(F.slice("__no", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), lambda n: n)
        place = F.when(F.col("__turn") == 0, 1.0).when(i + 1 < F.col("__turn"), BEFORE).when(i + 1 > F.col("__turn"), AFTER).otherwise(1.0)
        return raised * F.when(turned, NEGATED).otherwise(1.0) * place

    total = F.aggregate(F.transform("__w", value), F.lit(0.0), lambda a, b: a + b)
    count = lambda c: F.length(F.coalesce(F.col(text), F.lit(""))) - F.length(F.translate(F.coalesce(F.col(text), F.lit("")), c, ""))
    asked = count("?")
    marks = F.least(count("!"), F.lit(4)) * EXCLAIM + F.when(asked <= 1, 0.0).when(asked <= 3, asked * ASK).otherwise(ASK_MOST)
    x = x.withColumn("__s", total).withColumn("__s", F.col("__s") + F.signum("__s") * marks)
    return x.withColumn("compound", F.round(F.col("__s") / F.sqrt(F.col("__s") * F.col("__s") + NORM), 4)).drop("__lexicon", "__w", "__l", "__mixed", "__turn", "__up", "__no", "__s")
