"""Languages of texts and of their spans.

Words are runs of letters of one script; in scripts written without spaces each letter is a word.  The script of a word narrows the
languages it can be of to those that showed that script in training.  A word's score for a language is summed over its character n-grams: the logarithm of
the share that the language has among the rates of the n-gram in all languages.  Viterbi labels the words of a text: the best sequence of
languages by the sum of scores, less a penalty for each switch, so that mixed texts fall into spans.

Most texts need no table for that.  Let one language have the greatest sum.  If over no stretch of words another one gains more than half
a penalty on it, no sequence with switches can be better, which prefix sums of all texts at once prove; the other texts go through the table.

Training counts n-grams of at most SAMPLE_ROWS labelled rows of each language, by a hash of the id.  The model is a table of
languages x ORDERS x BUCKETS numbers.  Prediction reads texts only.

Defined cases: a null text, or one without letters, is `und` with score 0 and has no spans; with nothing to learn from all texts are `und`; words in scripts
that training has not shown are evidence for nothing; a null id counts as the word null when rows are held out; rows of
one id and language count once in training, with the least text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from unicodedata import category

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.llm.common import read_table, small_batches, written

#: Labelled rows of each language that a model is fitted on at most.
SAMPLE_ROWS = 2_000
ORDERS, BUCKETS = 5, 1 << 16
#: Sampled ids that are sent to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: What a switch of languages costs, in units of word scores, and the share of letters in a script that ties a language to it.
SWITCH, SCRIPT_SHARE = 12.0, 0.005
UNKNOWN = "und"
#: Score of a word in a language that does not write its script.
_NEVER = -100.0

#: Ranges of code points by script.
SCRIPTS = {
    "latin": "0041-005A 0061-007A 00AA 00BA 00C0-00D6 00D8-00F6 00F8-02AF 1D00-1D7F 1E00-1EFF 2C60-2C7F A720-A7FF FB00-FB06 FF21-FF3A FF41-FF5A",
    "greek": "0370-03FF 1F00-1FFF",
    "cyrillic": "0400-052F 1C80-1C8F 2DE0-2DFF A640-A69F",
    "armenian": "0530-058F FB13-FB17",
    "hebrew": "0590-05FF FB1D-FB4F",
    "arabic": "0600-06FF 0750-077F 08A0-08FF FB50-FDFF FE70-FEFF",
    "devanagari": "0900-097F A8E0-A8FF",
    "bengali": "0980-09FF",
    "gurmukhi": "0A00-0A7F",
    "gujarati": "0A80-0AFF",
    "tamil": "0B80-0BFF",
    "telugu": "0C00-0C7F",
    "kannada": "0C80-0CFF",
    "malayalam": "0D00-0D7F",
    "sinhala": "0D80-0DFF",
    "thai": "0E00-0E7F",
    "lao": "0E80-0EFF",
    "tibetan": "0F00-0FFF",
    "myanmar": "1000-109F",
    "georgian": "10A0-10FF 1C90-1CBF 2D00-2D2F",
    "ethiopic": "1200-139F 2D80-2DDF",
    "khmer": "1780-17FF",
    "hangul": "1100-11FF 3130-318F A960-A97F AC00-D7FF",
    "kana": "3040-30FF 31F0-31FF FF66-FF9F",
    "han": "2E80-2FDF 3005-3007 3400-4DBF 4E00-9FFF F900-FAFF 20000-323AF",
}
#: Written without spaces between words.
UNSPACED = ("thai", "lao", "tibetan", "myanmar", "khmer", "kana", "han")
_OTHER, _MARK = len(SCRIPTS) + 1, 255


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its script (0 for what is no letter, _MARK for a combining mark), and its small letter where that is one code point."""
    kinds = [category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([k == "L" for k in kinds])
    script = np.zeros(0x110000, np.uint8)
    script[letter] = _OTHER
    for n, ranges in enumerate(SCRIPTS.values(), 1):
        for part in ranges.split():
            low, high = (int(x, 16) for x in (part.split("-") * 2)[:2])
            script[low : high + 1][letter[low : high + 1]] = n
    script[[k == "M" for k in kinds]] = _MARK
    small = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        if len(lower := chr(c).lower()) == 1:
            small[c] = ord(lower)
    return script, small


@dataclass
class Words:
    """The words of some texts, in order."""

    owner: np.ndarray  # the number of the text
    start: np.ndarray  # where the word starts in its text, in code points
    length: np.ndarray
    script: np.ndarray
    letters: np.ndarray  # code points of all words, small letters, each word between two zeros

    def distinct(self) -> tuple[Words, np.ndarray]:
        """Each word once, told apart by 64 bits, and the place of every word among them."""
        sizes = self.length + 2
        at = np.cumsum(sizes) - sizes
        powers = np.multiply.accumulate(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
        inside = np.arange(len(self.letters)) - np.repeat(at, sizes)
        mixed = self.letters.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * powers[inside]
        _, one, place = np.unique(np.add.reduceat(mixed, at), return_index=True, return_inverse=True)
        held = np.zeros(len(self.length), bool)
        held[one] = True
        order = np.cumsum(held) - 1  # words stay in their order
        letters = self.letters[np.repeat(held, sizes)]
        return Words(self.owner[held], self.start[held], self.length[held], self.script[held], letters), order[one][place]


def words_of(texts: list[str]) -> Words:
    scripts, small = tables()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    script = scripts[points]
    marks = np.flatnonzero(script == _MARK)
    if len(marks):  # a mark belongs to the letter before it
        place = np.where(script == _MARK, 0, np.arange(len(script)))
        script = script[np.maximum.accumulate(place)]
        script[script == _MARK] = 0
    before = np.concatenate(([0], script[:-1]))[: len(script)]
    alone = np.isin(script, [n for n, name in enumerate(SCRIPTS, 1) if name in UNSPACED])
    if len(marks):
        alone[marks] = False
    opens = (script > 0) & ((script != before) | alone)
    closes = np.concatenate((((script[1:] != script[:-1]) | opens[1:]), [True]))[: len(script)] & (script > 0)
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    length = end - start
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1].astype(np.int64)
    owner = np.searchsorted(begins, start, side="right") - 1
    # one zero before and after each word
    sizes = length + 2
    at = np.cumsum(sizes) - sizes
    letters = np.zeros(int(sizes.sum()), np.uint32)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    letters[np.repeat(at + 1, length) + inside] = small[points[np.repeat(start, length) + inside]]
    return Words(owner, start - begins[owner] if len(start) else start, length, script[start], letters)


def grams(words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order the words and buckets of all n-grams."""
    word = np.repeat(np.arange(len(words.length)), words.length + 2)
    h = np.zeros(len(word), np.uint64)
    for n in range(1, ORDERS + 1):
        many = len(word) - n + 1
        if many <= 0:
            return
        h = h[:many] * np.uint64(0x9E3779B97F4A7C15) + words.letters[n - 1 :] + np.uint64(1)
        mixed = h ^ (h >> np.uint64(31))
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        bucket = (mixed >> np.uint64(48)).astype(np.int64)
        inside = word[:many] == word[n - 1 :]
        if n == 1:
            inside &= words.letters > 0
        yield n, word[:many][inside], bucket[inside]


@dataclass
class Model:
    languages: list[str]
    #: order, bucket, language: log share of the rate.
    table: np.ndarray
    #: language, script: whether it is written so.
    writes: np.ndarray
    switch: float = SWITCH

    def scores(self, words: Words) -> np.ndarray:
        """word, language."""
        words, place = words.distinct()
        found = np.zeros((len(words.length), len(self.languages)))
        for n, word, bucket in grams(words):
            if len(word):
                cut = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                found[word[cut]] += np.add.reduceat(self.table[n - 1][bucket], cut, axis=0) / n
        known = self.writes[:, words.script].T
        some = known.any(1)
        found[~some] = 0.0
        return np.where(known | ~some[:, None], found, _NEVER)[place]

    def labels(self, owner: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The language of each word, as a number; owner: the text of each word, ascending."""
        if not len(owner):
            return np.zeros(0, np.int64)
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        ends = np.append(starts[1:], len(owner))
        texts = np.repeat(np.arange(len(starts)), ends - starts)
        best = np.add.reduceat(scores, starts, axis=0).argmax(1)
        label = best[texts]
        gain = most_gained(scores - scores[np.arange(len(scores)), label][:, None], starts, ends, texts)
        for k in np.flatnonzero(gain > self.switch / 2 - 1e-3):
            label[starts[k] : ends[k]] = viterbi(scores[starts[k] : ends[k]], self.switch)
        return label


def most_gained(ahead: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each text the greatest sum over any stretch of its words in any column of ahead."""
    found = np.zeros(len(starts))
    places = np.arange(len(texts)) + texts + 1  # one more place before each text, for the sum of nothing
    opening = starts + np.arange(len(starts))
    for column in ahead.T:
        sums = np.cumsum(column)
        inside = sums - np.repeat(np.concatenate(([0.0], sums))[starts], ends - starts)
        far = 2 * np.abs(inside).max() + 1.0
        spread = np.zeros(len(texts) + len(starts))
        spread[places] = inside
        fall = np.zeros(len(spread))
        fall[places], fall[opening] = texts * far, np.arange(len(starts)) * far
        lowest = np.minimum.accumulate(spread - fall)
        found = np.maximum(found, np.maximum.reduceat(spread - fall - lowest, opening))
    return found


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The labels of greatest sum, less switch for each change from a word to the next; ties stay."""
    n = len(scores)
    held = scores[0].copy()
    came, leaders = np.zeros(scores.shape, bool), np.zeros(n, np.int64)
    for t in range(1, n):
        leader = held.argmax()
        changed = held[leader] - switch
        came[t], leaders[t] = held < changed, leader
        held = np.maximum(held, changed) + scores[t]
    path = np.zeros(n, np.int64)
    at = held.argmax()
    for t in range(n - 1, -1, -1):
        path[t] = at
        if came[t, at]:
            at = leaders[t]
    return path


def held_out(ident: Column) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int) -> DataFrame:
    """lang, text of at most sample_rows labelled rows of each language, none of them held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    ids = rows.select("id", "lang").distinct()
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    # a range of hashes that holds about twice the wanted ids comes first, so that no language is sorted as a whole
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    near = ids.join(sizes, "lang").filter(place < F.lit(2.0 * sample_rows + 100) / F.col("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = written(near.withColumn("first", first).filter(F.col("first") <= sample_rows).select("id", "lang"), "language-sample")
    if chosen.count() <= BROADCAST_ROWS:  # as many as languages times sample_rows at most
        chosen = F.broadcast(chosen)
    return rows.join(chosen, ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, switch: float = SWITCH) -> Model:
    """A model from the labelled rows of docs that are not held out."""
    width = ORDERS * BUCKETS

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                words = words_of(list(texts))
                held = total.setdefault(lang, np.zeros(width + _OTHER + 1, np.int64))
                held[width:] += np.bincount(words.script, words.length, _OTHER + 1).astype(np.int64)
                for n, _, bucket in grams(words):
                    held[(n - 1) * BUCKETS : n * BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
        for lang, held in total.items():
            place = np.flatnonzero(held)
            yield pd.DataFrame({"lang": lang, "place": place.astype(np.int32), "n": held[place]})

    texts = sampled(docs, id_col, text_col, lang_col, sample_rows).filter("text IS NOT NULL")
    found = texts.mapInPandas(counted, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), width + _OTHER + 1))
    counts[found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), found["place"].to_numpy()] = found["n"]
    scripts = counts[:, width:]
    writes = scripts > SCRIPT_SHARE * scripts.sum(1, keepdims=True)
    grams_of = counts[:, :width].reshape(len(languages), ORDERS, BUCKETS).transpose(1, 2, 0)
    all_of = np.maximum(grams_of.sum(1, keepdims=True), 1.0)
    rates = grams_of / all_of + 1.0 / all_of.mean(2, keepdims=True) if languages else grams_of
    return Model(languages, np.log(rates / rates.sum(2, keepdims=True)).astype(np.float32) if languages else grams_of, writes, switch)


def spans_of(texts: list[str], model: Model) -> tuple[list, list[str], list[float]]:
    """For each text its spans (language, start, end), the language of most letters, and how sure that is."""
    words = words_of(texts)
    if not model.languages or not len(words.owner):
        return [[] for _ in texts], [UNKNOWN] * len(texts), [0.0] * len(texts)
    many, scores = len(model.languages), model.scores(words)
    label = model.labels(words.owner, scores)
    letters = np.bincount(words.owner * many + label, words.length, len(texts) * many).reshape(len(texts), many)
    winner = letters.argmax(1)
    share = letters.max(1) / np.maximum(letters.sum(1), 1.0)
    mine = label == winner[words.owner]
    sums = np.stack([np.bincount(words.owner[mine], column[mine], len(texts)) for column in scores.T], 1)
    sums -= sums[np.arange(len(texts)), winner][:, None]
    sure = share / np.exp(np.minimum(sums, 0.0)).sum(1)
    change = np.flatnonzero(np.concatenate(([True], (words.owner[1:] != words.owner[:-1]) | (label[1:] != label[:-1]))))
    last = np.append(change[1:], len(label)) - 1
    spans: list[list] = [[] for _ in texts]
    for text, lang, start, end in zip(
        words.owner[change].tolist(), label[change].tolist(), words.start[change].tolist(), (words.start[last] + words.length[last]).tolist()
    ):
        spans[text].append((model.languages[lang], start, end))
    found = letters.sum(1) > 0
    names = [model.languages[w] if f else UNKNOWN for w, f in zip(winner, found)]
    return spans, names, np.where(found, sure, 0.0).tolist()


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans (array of lang, start, end in code points) of every row."""

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans, names, sure = spans_of(list(batch["text"]), model)
            rows = [[{"lang": x, "start": a, "end": b} for x, a, b in each] for each in spans]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": names, "score": sure, "spans": pd.Series(rows, dtype=object)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(labelled, "doc_id long, lang_pred string, score double, spans array<struct<lang: string, start: int, end: int>>")


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
