"""Toxicity by class-conditional Kneser-Ney models (operator 5)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import short_batches, sub_batches, written

#: Labelled rows of each class that the models are fitted on at most: the smallest by a hash of their id.  Of these, texts
#: over FIT_TEXT bytes are left out, and then what comes after FIT_BYTES of text in the same order.
FIT_ROWS, FIT_TEXT, FIT_BYTES = 2048, 1 << 20, 32 << 20
#: Characters of the longest expression.
ORDER = 6
#: What every count above it gives up to the shared model.
DISCOUNT = 0.8
#: Weights of the shared model in each context beside, and log ratios of a word up to which it differs from its text's
#: background by chance: of these the pair is taken that tells the classes best in texts that other texts' models score.
STRENGTHS, MARGINS = (5.0, 50.0), (1.0, 1.5, 2.0, 2.5, 3.0)
#: Parts of the fitting rows; to set margin, strength and scale, each is scored by models of the others.
FOLDS = 3
#: Shares of the ordinary fitting texts' backgrounds between which any text's background is held.
LOWEST, HIGHEST = 0.01, 0.99
#: Score from which a text is predicted to be toxic.
TOXIC_AT = 0.7
#: Characters at which a longer run of letters and digits is cut.
LONGEST_WORD = 40
WORD = re.compile(r"[^\W_]{1,%d}" % LONGEST_WORD)
WORD_MEMORY = 1 << 17
START, END = "\x02", "\x03"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams_of(word: str) -> list[str]:
    s = START + word + END
    return [s[max(0, end - ORDER) : end] for end in range(2, len(s) + 1)]


def contexts(counts: dict[str, float]) -> dict[str, tuple[float, int]]:
    """For each context the sum of its counts and the number of different characters after it."""
    out: dict[str, list] = {}
    for g, n in counts.items():
        t = out.setdefault(g[:-1], [0.0, 0])
        t[0] += n
        t[1] += 1
    return {g: (t[0], t[1]) for g, t in out.items()}


class KneserNey:
    """Class-conditional Kneser-Ney models of words, letter by letter, that back off to one shared model.

    A word counts in a class by how many different words it followed there, so that copies of a text add nothing.  A
    class keeps counts of the longest contexts only; the discounts and the strength go to the shared model, which
    interpolates all orders over both classes, shorter sequences by the number of contexts they were met in.  So an
    expression that is rare in both classes says little, and one never met says nothing but how much each model backs
    off there.  Kept is just the log ratio of every sequence, and of anything new after every context.
    """

    def __init__(self, words: list[dict[str, int]]):
        own: list[Counter] = [Counter(), Counter()]
        for c in (0, 1):
            for word, n in words[c].items():
                for g in grams_of(word):
                    own[c][g] += n
        seen = own[0].keys() | own[1].keys()
        shared: dict[str, float] = {g: float(own[0][g] + own[1][g]) for g in seen}
        ends = {g[i:] for g in seen for i in range(1, len(g))}
        for g in seen | ends:  # each longer sequence is one context of the shorter one
            if len(g) > 1:
                shared[g[1:]] = shared.get(g[1:], 0.0) + 1.0
        del ends
        after, own_after = contexts(shared), [contexts(own[0]), contexts(own[1])]
        known: dict[str, float] = {"": 1.0 / (1 + len({g[-1] for g in seen}))}

        def probability(g: str) -> float:
            if not g:
                return known[""]
            p = known.get(g)
            if p is None:
                total, kinds = after[g[:-1]]
                known[g] = p = (max(shared[g] - DISCOUNT, 0.0) + DISCOUNT * kinds * probability(g[1:])) / total
            return p

        self.own, self.own_after, self.shared = own, own_after, {g: probability(g) for g in seen}

    def ratios(self, strength: float) -> tuple[dict[str, float], dict[str, float]]:
        """Log ratios of every sequence, and of anything new after every context, with this weight of the shared model."""
        (own0, own1), (after0, after1), none = self.own, self.own_after, (0.0, 0)
        back = {}
        for h in after0.keys() | after1.keys():
            (n0, k0), (n1, k1) = after0.get(h, none), after1.get(h, none)
            back[h] = n0 + strength, DISCOUNT * k0 + strength, n1 + strength, DISCOUNT * k1 + strength
        ratio = {}
        for g, p in self.shared.items():
            n0, b0, n1, b1 = back[g[:-1]]
            ratio[g] = math.log((max(own1[g] - DISCOUNT, 0.0) + b1 * p) / n1) - math.log((max(own0[g] - DISCOUNT, 0.0) + b0 * p) / n0)
        return ratio, {h: math.log(b1 / n1) - math.log(b0 / n0) for h, (n0, b0, n1, b1) in back.items()}


class Evidence:
    """The log ratios of a model, sent to tasks as Arrow columns (gram, new, ratio) and looked up from dictionaries there."""

    def __init__(self, columns: pa.Table):
        self.columns = columns

    def __getstate__(self) -> dict:
        return {"columns": self.columns}

    def __setstate__(self, state: dict) -> None:
        self.columns, self.ratio, self.new = state["columns"], None, None

    def open(self) -> None:
        """Make the dictionaries, where they are used."""
        self.ratio, self.new, self.memory = {}, {}, WordEvidence(self)
        for b in self.columns.select(["gram", "new", "ratio"]).to_batches(max_chunksize=1 << 14):
            for gram, new, ratio in zip(*(c.to_pylist() for c in b.columns)):
                (self.new if new else self.ratio)[gram] = ratio

    def shut(self) -> None:
        self.ratio = self.new = self.memory = None

    def of_word(self, word: str) -> float:
        """Log likelihood of a word as toxic less that as ordinary."""
        ratio, new = self.ratio, self.new
        return sum(new.get(g[:-1], 0.0) if (x := ratio.get(g)) is None else x for g in grams_of(word))

    def of_words(self, text: str | None) -> np.ndarray:
        """The log ratio of each word of a text, in order."""
        if self.ratio is None:
            self.open()
        words = words_of(text)
        return np.fromiter(map(self.memory.__getitem__, words), np.float64, len(words))


class WordEvidence(dict):
    """The log ratios of words, each computed once as long as it is remembered."""

    def __init__(self, model: Evidence):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= WORD_MEMORY:
            self.clear()
        x = self[word] = self.model.of_word(word)
        return x


def beyond(x: np.ndarray, background: float, margin: float) -> float:
    """The mean by which the words' log ratios are further than ``margin`` from the background, on either side."""
    over = x - background
    return float((np.sign(over) * np.maximum(np.abs(over) - margin, 0.0)).mean()) if len(x) else 0.0


class Scale:
    """Makes scores of the log ratios of texts' words.

    The mean log ratio tells more than toxicity: a language with a larger share of the toxic texts makes all its words
    look toxic.  That is so for all words of a text alike, while toxic expressions are few of them, so the median is taken
    as the text's background.  It is held within what ordinary texts have, for a text may be toxic throughout.  What is
    within ``margin`` of the background is chance; beyond it each word counts, for either class, and the mean is taken.
    The score is a logistic regression on that mean: on its root, and in proportion to its error (times the root of the
    number of words).
    """

    def __init__(self, margin: float, median: np.ndarray, value: np.ndarray, n: np.ndarray, toxic: np.ndarray):
        use = n > 0
        median, value, n, toxic = median[use], value[use], n[use], toxic[use]
        ordinary = median[toxic == 0]
        self.margin = margin
        self.low, self.high = np.quantile(ordinary, [LOWEST, HIGHEST]).tolist() if len(ordinary) else (0.0, 0.0)
        self.centre, self.spread, self.weights = np.zeros(2), np.ones(2), np.array([0.0, 0.0, 10.0 if toxic.any() else -10.0])
        if len(set(toxic.tolist())) == 2:
            x = self.features(value, n)
            self.centre, self.spread = x.mean(0), np.maximum(x.std(0), 1e-9)
            x = np.column_stack([(x - self.centre) / self.spread, np.ones(len(x))])
            w = np.zeros(3)
            for _ in range(100):  # Newton steps with a small penalty, so that classes that part cleanly have an end too
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(3), x.T @ (toxic - p) - 1e-2 * w)
                w = w + np.clip(step, -3, 3)
                if np.abs(step).max() < 1e-8:
                    break
            self.weights = w
        p = np.clip(self.scores(value, n), 1e-9, 1 - 1e-9)
        self.loss = float(-np.log(np.where(toxic == 1, p, 1 - p)).mean()) if len(p) else 0.0

    @staticmethod
    def features(value: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.column_stack([np.sign(value) * np.sqrt(np.abs(value)), value * np.sqrt(n)])

    def value(self, x: np.ndarray) -> float:
        return beyond(x, min(max(float(np.median(x)), self.low), self.high), self.margin) if len(x) else 0.0

    def scores(self, value: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (self.features(value, n) - self.centre) / self.spread
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(x @ self.weights[:2] + self.weights[2], -30, 30))), 0.0)


def best_scale(scored: pd.DataFrame) -> tuple[int, Scale]:
    """The number of a strength and the scale with the least log loss, of rows (toxic, strength, median, n, values by margin)."""
    found = []
    for k, part in sorted(scored.groupby("strength")):
        values = np.array(part["values"].tolist(), np.float64)
        for j, margin in enumerate(MARGINS):
            found.append((int(k), Scale(margin, part["median"].to_numpy(float), values[:, j], part["n"].to_numpy(float), part["toxic"].to_numpy(float))))
    return min(found, key=lambda x: x[1].loss) if found else (0, Scale(MARGINS[0], *[np.empty(0)] * 4))


def fitting_rows(labels: DataFrame) -> DataFrame:
    """doc_id, toxic and fold of the rows to learn from: ids with crc32(text of id) mod 3 other than 1, FIT_ROWS a class.

    An id labelled more than once counts as toxic if any row says so; null ids and null labels are left out.
    """
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id"))
    first = [ids.where(f"toxic = {c}").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(FIT_ROWS) for c in (0, 1)]
    return first[0].unionByName(first[1]).select("doc_id", "toxic", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame):
    """The broadcast model and the scale, from a bounded number of labelled rows (see FIT_ROWS); labels are used nowhere else."""
    chosen = F.broadcast(fitting_rows(labels))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = written(docs.select("doc_id", "text").join(chosen, "doc_id").where(size <= FIT_TEXT).select("doc_id", "toxic", "fold", "text", F.xxhash64("doc_id").alias("h"), size.alias("size")), "fitting")
    so_far = F.sum("size").over(Window.partitionBy("toxic").orderBy("h", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    within = F.broadcast(rows.select("doc_id", "toxic", "h", "size").withColumn("so_far", so_far).where(F.col("so_far") <= FIT_BYTES).select("doc_id").distinct())
    rows = rows.join(within, "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "fold", "text")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, "text"):
            out = set()
            for toxic, fold, text in zip(*(c.to_pylist() for c in b.columns)):
                last = START
                for w in words_of(text):
                    out.add((toxic, fold, w, last))
                    last = w
            cols = list(zip(*out)) if out else [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["toxic", "fold", "word", "last"])

    counts = rows.mapInArrow(pairs, "toxic int, fold int, word string, last string").distinct().groupBy("toxic", "fold", "word").count()
    # model FOLDS is of all rows, model k of the rows outside fold k; a model's words are bounded by FIT_BYTES, so each fits a task
    models = F.explode(F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda m: m != F.col("fold"))).alias("model")
    strengths = F.explode(F.sequence(F.lit(0), F.lit(len(STRENGTHS) - 1))).alias("strength")

    def build(words: pd.DataFrame) -> pd.DataFrame:
        counted: list[Counter] = [Counter(), Counter()]
        for c, w, n in zip(words.toxic, words.word, words["count"]):
            counted[c][w] += int(n)
        m, out = KneserNey(counted), []
        for k, strength in enumerate(STRENGTHS):
            ratio, new = m.ratios(strength)
            out.append(pd.DataFrame({"model": words.model.iloc[0], "strength": k, "gram": [*ratio, *new], "new": [False] * len(ratio) + [True] * len(new), "ratio": [*ratio.values(), *new.values()]}))
        return pd.concat(out)

    built = written(counts.select("toxic", "word", "count", models).groupBy("model").applyInPandas(build, "model int, strength int, gram string, new boolean, ratio double"), "models")
    columns = lambda m, k: Evidence(built.where((F.col("model") == m) & (F.col("strength") == k)).select("gram", "new", "ratio").toArrow())
    others = docs.sparkSession.sparkContext.broadcast([[columns(m, k) for k in range(len(STRENGTHS))] for m in range(FOLDS)])

    @F.pandas_udf("median double, n long, values array<double>")
    def by_others(texts: pd.Series, folds: pd.Series, strength: pd.Series) -> pd.DataFrame:
        out = []
        for i in np.lexsort((strength, folds)).tolist():  # one model is open at a time
            model = others.value[folds[i]][strength[i]]
            if model.ratio is None:
                for other in (e for of_fold in others.value for e in of_fold):
                    other.shut()
            x = model.of_words(texts[i])
            median = float(np.median(x)) if len(x) else 0.0
            out.append((i, median, len(x), [beyond(x, median, m) for m in MARGINS]))
        return pd.DataFrame(out, columns=["i", "median", "n", "values"]).sort_values("i")[["median", "n", "values"]]

    each = rows.select("toxic", "fold", "text", strengths).repartition("fold", "strength").sortWithinPartitions("fold", "strength")  # so that a task opens few models
    scored = each.select("toxic", "strength", by_others("text", "fold", "strength").alias("e")).select("toxic", "strength", "e.*").toPandas()
    others.destroy()
    k, scale = best_scale(scored)
    return docs.sparkSession.sparkContext.broadcast(columns(FOLDS, k)), scale


def toxicity_score(docs: DataFrame, labels: DataFrame, *, text_col: str = "text"):
    """A column with the score of each whole text of ``docs``; the models are fitted when this is called.

    The broadcast models have a size bounded by FIT_BYTES, and scoring has no shuffle.
    """
    short_batches(docs)
    model, scale = fit(docs.select("doc_id", F.col(text_col).alias("text")), labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        value, n = np.zeros(len(texts)), np.zeros(len(texts))
        for i, t in enumerate(texts):
            x = model.value.of_words(t)
            value[i], n[i] = scale.value(x), len(x)
        return pd.Series(scale.scores(value, n))

    return score(F.col(text_col))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= TOXIC_AT) of every row of ``docs``.

    The score is of the whole text and of nothing else.  Null, empty and wordless texts have score 0; without a label of
    class 1 all scores are near 0, without one of class 0 near 1; repeated rows and null ids stay.
    """
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), toxicity_score(docs, labels).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))
