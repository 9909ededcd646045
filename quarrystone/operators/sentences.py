"""The sentence that stands for a text: the one whose words the text uses most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words that do not count, marks that end a sentence, what is cut off a sentence's ends, and tokens: Latin words and single Chinese characters.
STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "have", "you", "your", "的", "了", "和", "是", "在", "有", "我", "你")
SENTENCE_END, EDGES, TOKEN = "[。！？.!?]+", " ，,;；:\t", r"([a-z0-9][a-z0-9_-]+|[\x{4e00}-\x{9fff}])"
LEAST, MOST, MOST_WHOLE = 6, 180, 160


def one_line(text: Column) -> Column:
    """A text without control characters, its white space as single spaces."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.trim(F.regexp_replace(kept, r"[\t\n\r ]+", " "))


def candidates(line: Column) -> Column:
    """The sentences of a line that are long enough, without marks at their ends."""
    return F.transform(F.filter(F.split(line, SENTENCE_END), lambda p: F.length(F.trim(p)) >= LEAST), lambda p: F.btrim(p, F.lit(EDGES)))


def representative(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, sentence and weight: the sentence with the greatest mean weight of its tokens, a token's weight being how often the text's sentences hold it.

    Of equals the longer one counts, up to MOST characters, then the first.  A text without a sentence gives its beginning, with weight null.  Keys are unique.
    Texts are dealt by their key once; tokens, sentences and the best of them are counted where their text lies."""
    lines = docs.select(F.col(key).alias("_key"), one_line(F.col(text)).alias("_line")).repartition("_key")
    sentences = lines.select("_key", F.posexplode(candidates(F.col("_line"))).alias("_k", "_s"))
    tokens = sentences.select("_key", "_k", F.length("_s").alias("_chars"), F.explode_outer(F.regexp_extract_all(F.lower("_s"), F.lit(TOKEN), 1)).alias("_t"))
    held = tokens.groupBy("_key", "_t", "_k", "_chars").agg(F.count("*").alias("_n"))
    weighed = held.withColumn("_w", F.sum("_n").over(Window.partitionBy("_key", "_t")))
    counts = F.col("_t").isNotNull()  # a sentence without tokens has one row, without a token
    mean = F.sum(F.when(counts, F.col("_n") * F.when(F.col("_t").isin(*STOP_WORDS), 0).otherwise(F.col("_w")))) / F.sum(F.when(counts, F.col("_n")))
    scored = weighed.groupBy("_key", "_k", "_chars").agg(F.coalesce(mean, F.lit(0.0)).alias("_score"))
    place = F.struct("_score", F.least(F.col("_chars"), F.lit(MOST)), -F.col("_k"))
    best = scored.groupBy("_key").agg(F.max_by(F.struct("_k", "_score"), place).alias("_best"))
    whole = lines.join(best, "_key", "left")
    sentence = F.coalesce(F.substring(F.get(candidates(F.col("_line")), F.col("_best._k")), 1, MOST), F.substring("_line", 1, MOST_WHOLE))
    return whole.select(F.col("_key").alias(key), sentence.alias("sentence"), F.col("_best._score").alias("weight"))
