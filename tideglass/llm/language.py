"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.blocks import slices
from tideglass.llm.common import Shared, materialise, pick
from tideglass.llm.sample import bounded_sample, remainder

#: Bounds of the labelled sample that is fitted, in rows and bytes of text. They bound the model, too: it has
#: every word of the sample and every character n-gram of those words.
FIT_ROWS, FIT_BYTES = 3000, 16 << 20
LONGEST = 4
#: Vectors of unseen words that a task keeps at a time; it does not change any result.
CACHE = 200_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters (``str.isalpha``), in lower case."""
    low = (text or "").lower()
    found = WORD.findall(low)
    if low.isascii() or "".join(found).isalpha():
        return found
    return "".join(c if c.isalpha() else " " for c in low).split()  # superscripts, fractions and the like are no letters


def grams_of(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


UNITS = "lang string, n int, unit string, k long"


def to_batch(rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    types = (pa.string(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["lang", "n", "unit", "k"])


@dataclass
class Model:
    """Vectors over languages: row numbers by word and by n-gram (of each length, from 1), and the rows."""

    langs: list[str]
    words: dict[str, int]
    word_table: np.ndarray
    grams: list[dict[str, int]]
    gram_table: np.ndarray


def log_frequency(units: list[str], lang: np.ndarray, k: np.ndarray, width: int) -> tuple[dict[str, int], np.ndarray]:
    """Rows by unit; log P(unit | language) less its mean over languages, with add-half smoothing."""
    at = {u: i for i, u in enumerate(dict.fromkeys(units))}
    counts = np.zeros((len(at), width))
    np.add.at(counts, ([at[u] for u in units], lang), k)
    v = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(1, len(at))))
    return at, v - v.mean(axis=1, keepdims=True)


def fit_language(docs: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Count all words and character n-grams by language over a sample of rows outside the held-out remainder."""
    rows = pick(docs, doc_id=(doc_id, "long"), text=(text, "string"), lang=(lang, "string"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0))
    rows = bounded_sample(rows, fit_rows, fit_bytes).select("lang", "text")

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                seen: dict[str, Counter] = {}
                for x, s in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    seen.setdefault(x, Counter()).update(words_of(s))
                yield to_batch((x, 0, word, k) for x, c in seen.items() for word, k in c.items())

    def spell(batches):
        for batch in batches:
            grams: Counter = Counter()
            for x, word, k in zip(*(batch.column(c).to_pylist() for c in ("lang", "unit", "k")), strict=True):
                for n in range(1, LONGEST + 1):
                    for g in grams_of(word, n):
                        grams[x, n, g] += k
            yield to_batch((*key, k) for key, k in grams.items())

    words = rows.mapInArrow(count, UNITS).groupBy("lang", "n", "unit").agg(F.sum("k").alias("k"))
    words = materialise(words, "language-words")
    grams = words.mapInArrow(spell, UNITS).groupBy("lang", "n", "unit").agg(F.sum("k").alias("k"))
    units = words.unionByName(grams).toArrow().sort_by([("n", "ascending"), ("unit", "ascending"), ("lang", "ascending")])
    langs = sorted(set(units.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    code, length, k = np.array([place[x] for x in units.column("lang").to_pylist()], np.int64), units.column("n").to_numpy(), units.column("k").to_numpy()
    found, tables = [], [np.zeros((1, max(1, len(langs))))]  # row 0: no n-gram known, no vote
    for n in range(LONGEST + 1):
        of_n = np.flatnonzero(length == n)
        at, table = log_frequency(units.column("unit").take(pa.array(of_n)).to_pylist(), code[of_n], k[of_n], max(1, len(langs)))
        if n:
            at = {u: i + sum(map(len, tables)) for u, i in at.items()}
            tables.append(table)
        else:
            word_table = table
        found.append(at)
    return Model(langs, found[0], word_table, found[1:], np.concatenate(tables))


class Scorer:
    """A task's view of the model: one vector a word, those of unseen words kept for a while."""

    def __init__(self, model: Model):
        self.model, self.at, self.table = model, dict(model.words), model.word_table

    def spelled(self, word: str) -> list[int]:
        """The word's longest n-grams of which any is known."""
        padded = f"<{word}>"
        for n in range(len(self.model.grams), 0, -1):
            get = self.model.grams[n - 1].get
            if got := [k for i in range(len(padded) - n + 1) if (k := get(padded[i : i + n])) is not None]:
                return got
        return [0]

    def votes(self, texts: list[list[str]]) -> np.ndarray:
        """Summed vectors of each text; no text is empty. An unseen word's vector is its n-grams' mean."""
        if len(self.at) > len(self.model.words) + CACHE:
            self.at, self.table = dict(self.model.words), self.model.word_table
        at = self.at
        new = list(dict.fromkeys(w for words in texts for w in words if w not in at))
        if new:
            grams = [self.spelled(w) for w in new]
            size = np.array([len(g) for g in grams])
            sums = np.add.reduceat(self.model.gram_table[[k for g in grams for k in g]], np.cumsum(size) - size)
            at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
            self.table = np.concatenate([self.table, sums / size[:, None]])
        size = np.array([len(words) for words in texts])
        found = np.fromiter((at[w] for words in texts for w in words), np.int64, int(size.sum()))
        return np.add.reduceat(self.table[found], np.cumsum(size) - size)


def identify_language(docs: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Predict the language of every whole text: doc_id, held_out (crc32 of the id modulo 5 is 0; null for a
    null id), lang_pred (a learned language, ``und`` for null and letterless texts) and score (its share of
    the likelihood, 0 for ``und``).

    A word of the model votes by its log frequencies, any other by the mean of its longest known character
    n-grams. Learned from are ``fit_rows`` rows and ``fit_bytes`` of text at most, picked by a hash of the id.

    Letters are what ``str.isalpha`` says. Equal scores go to the alphabetically first language. Repeated rows
    are predicted each. An empty table gives an empty result; with nothing to learn from every text is ``und``.
    Further columns, whatever their names, are ignored.
    """
    model = Shared(docs.sparkSession, fit_language(docs, fit_rows, fit_bytes, doc_id, text, lang))

    def predict(batches):
        scorer = Scorer(model.value)
        langs = model.value.langs
        most = max(1 << 16, (1 << 20) * 8 // max(8, len(langs)))
        for batch in batches:
            for part in slices(batch, most):
                texts = [words_of(s) for s in part.column("text").to_pylist()]
                best, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                voiced = [i for i, words in enumerate(texts) if words and langs]
                if voiced:
                    v = scorer.votes([texts[i] for i in voiced])
                    best[voiced] = np.array(langs, object)[v.argmax(axis=1)]
                    score[voiced] = 1 / np.exp(v - v.max(axis=1, keepdims=True)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = pick(docs, doc_id=(doc_id, "long"), text=(text, "string"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double").select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
