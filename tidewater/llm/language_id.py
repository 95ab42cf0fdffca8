"""Language identification by hierarchical discrimination.

A text's family is predicted first, then one-versus-one linear support vector machines tell the languages of that family
apart. Features are hashed byte n-grams of the whole lower-cased text. The machines are fitted on the driver from a bounded
sample of labelled rows (``SAMPLE_ROWS`` in all, or ``LEAST_ROWS`` a language if that is more, the same number of each, chosen by a hash of the id so that a rerun
takes the same rows); features are computed on the executors, so what reaches the driver is bounded whatever the texts'
lengths. Prediction covers every row and whole texts, from the text alone.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing can be learnt; a null
language is not learnt from; a null id counts as held out; rows are independent; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import give_back, materialise, sliced, small_batches

#: Families of languages by code. A language that is not listed forms a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "indic": "hi bn ur mr gu pa ne".split(),
    "sinitic": "zh yue".split(),
    "semitic": "ar he mt".split(),
    "celtic": "ga gd cy br".split(),
    "baltic": "lt lv".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

#: Hash buckets; sampled rows in all, of one language at most, and at least (of many languages there are more in all); passes and cost of the fit.
BUCKETS, SAMPLE_ROWS, ROWS_A_LANGUAGE, LEAST_ROWS, PASSES, COST = 4096, 4000, 800, 8, 12, 10.0
#: Languages that are not listed may form so many families of their own; more are put together by the first letter of their code.
OWN_FAMILIES = 40
ORDERS = (1, 2, 3, 4)
LETTER = regex.compile(r"\p{L}")


def features(text: str) -> np.ndarray:
    """Square roots of n-gram shares, each order's n-grams in all buckets: a vector of length about 1."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.float64)
    for n in ORDERS:
        if len(data) < n:
            break
        h = np.full(len(data) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h ^= data[k : len(data) - n + 1 + k]
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        out += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS) / (len(h) * len(ORDERS))
    return np.sqrt(out).astype(np.float32)


def fit_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Linear support vector machine by dual coordinate descent; the last weight is the bias. y holds 1 and -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, (y < 0).mean(), (y > 0).mean()) * 2 * COST
    norm, alpha, w = (x * x).sum(1), np.zeros(len(x)), np.zeros(x.shape[1], np.float64)
    rng = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in rng.permutation(len(x)):
            step = np.clip(alpha[i] - (y[i] * (x[i] @ w) - 1) / norm[i], 0, share[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w.astype(np.float32)


@dataclass
class Level:
    """One-versus-one machines of some classes."""

    names: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS + 1), np.float32))

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Level:
        names = sorted(set(labels))
        each = []
        for a, b in combinations(names, 2):
            rows = (labels == a) | (labels == b)
            each.append(fit_machine(x[rows], np.where(labels[rows] == a, 1.0, -1.0)))
        return cls(names, np.array(each, np.float32).reshape(-1, BUCKETS + 1))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The class with most wins, ties by its margins; the score rises with its least margin."""
        if len(self.names) == 1:
            return self.names[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        wins, total, least = defaultdict(int), defaultdict(float), {}
        for (a, b), m in zip(combinations(self.names, 2), margins.tolist(), strict=True):
            for name, own in ((a, m), (b, -m)):
                wins[name] += own > 0
                total[name] += own
                least[name] = min(own, least.get(name, own))
        best = max(self.names, key=lambda n: (wins[n], total[n]))
        return best, float(1 / (1 + np.exp(-2 * np.clip(least[best], -20, 20))))


@dataclass
class Model:
    families: Level
    languages: dict[str, Level]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.families.names or not LETTER.search(text):
            return "und", 0.0
        x = features(text)
        family, sure = self.families.predict(x)
        language, score = self.languages[family].predict(x)
        return language, sure * score


def is_held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """From rows that aren't held out, have a language and a letter in their text."""
    labelled = docs.where(~is_held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # a row a language
    if not counts:
        return Model(Level([]), {})
    most = max(LEAST_ROWS, min(ROWS_A_LANGUAGE, SAMPLE_ROWS // len(counts)))
    share = F.lit(0.0)
    for lang, n in counts.items():  # a quarter more than wanted, cut to the exact number below
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, 1.25 * most / n))).otherwise(share)
    order = F.xxhash64(F.col(id_col), F.lit("language sample"))
    sample = labelled.where(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30)).select(F.col(lang_col).alias("lang"), order.alias("h"), F.col(text_col).alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "t"):
            rows = [(lang, h, features(t).astype(np.float16).tobytes()) for lang, h, t in zip(*(b.column(c).to_pylist() for c in ("lang", "h", "t")), strict=True) if LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["lang", "h", "x"])

    by: dict[str, list] = defaultdict(list)
    with small_batches(docs.sparkSession):
        rows = sample.mapInArrow(run, "lang string, h long, x binary").orderBy("h", "lang", "x").limit(2 * max(SAMPLE_ROWS, most * len(counts))).collect()
    for r in rows:
        if len(by[r.lang]) < most:
            by[r.lang].append(np.frombuffer(r.x, np.float16))
    if not by:
        return Model(Level([]), {})
    x = np.concatenate([np.array(v, np.float32) for v in by.values()])
    lang = np.array([k for k, v in by.items() for _ in v])
    unlisted = {k for k in by if k not in FAMILY_OF}
    own = {k: k if len(unlisted) <= OWN_FAMILIES else f"unlisted {k[:1]}" for k in unlisted}
    family = np.array([FAMILY_OF.get(k) or own[k] for k in lang])
    return Model(Level.fit(x, family), {f: Level.fit(x[family == f], lang[family == f]) for f in sorted(set(family))})


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row; without ``model`` it is fitted on ``docs`` first."""
    model = model or fit(docs, id_col, text_col, lang_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "t"):
            found = [model.predict(t) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
        give_back()

    rows = docs.select(F.col(id_col).alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("t"))
    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
    return materialise(found, "languages")


def annotate(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", name: str = "lang_pred") -> DataFrame:
    """``docs`` with the predicted language as a further column (which must be free), in one pass and without a join."""
    model = model or fit(docs, id_col, text_col, lang_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text_col):
            found = [model.predict(t)[0] for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit("").alias(name)).schema)
