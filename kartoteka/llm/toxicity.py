"""Toxicity scores by a counterfactual-regularised linear classifier.

A text's features are its distinct words and their leading letters, hashed. The
logistic classifier is fitted on a bounded sample of labelled texts with two
penalties: the absolute size of weights, so that chance words get none, and the
change of the score when identity terms of a labelled sentence are swapped for
others, or put into a sentence without any, so that naming a group tells nothing. Scoring looks each word's weight up once
and remembers it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identity terms of each language, swapped for one another.
IDENTITY_TERMS = {
    "en": (
        "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic",
        "black", "white", "asian", "african", "latino", "arab", "indigenous", "european", "american", "mexican", "chinese",
        "gay", "lesbian", "straight", "bisexual", "transgender", "queer",
        "women", "men", "woman", "man", "female", "male",
        "immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners",
        "disabled", "blind", "deaf", "elderly", "old", "young", "poor", "rich",
    ),
    "de": (
        "muslim", "christ", "jude", "hindu", "buddhist", "atheist", "katholik",
        "schwarz", "weiß", "asiatisch", "afrikanisch", "arabisch", "europäisch", "türkisch", "polnisch", "chinesisch",
        "schwul", "lesbisch", "bisexuell", "frau", "frauen", "mann", "männer",
        "einwanderer", "flüchtling", "flüchtlinge", "ausländer", "behindert", "blind", "taub", "alt", "jung", "arm", "reich",
    ),
    "fr": (
        "musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée", "catholique",
        "noir", "blanc", "asiatique", "africain", "arabe", "européen", "américain", "chinois",
        "gay", "lesbienne", "bisexuel", "femme", "femmes", "homme", "hommes",
        "immigré", "immigrés", "réfugié", "réfugiés", "étranger", "étrangers", "handicapé", "aveugle", "sourd", "vieux", "jeune", "pauvre", "riche",
    ),
    "es": (
        "musulmán", "cristiano", "judío", "hindú", "budista", "ateo", "católico",
        "negro", "blanco", "asiático", "africano", "árabe", "europeo", "americano", "mexicano", "chino",
        "gay", "lesbiana", "bisexual", "mujer", "mujeres", "hombre", "hombres",
        "inmigrante", "inmigrantes", "refugiado", "refugiados", "extranjero", "extranjeros", "discapacitado", "ciego", "sordo", "viejo", "joven", "pobre", "rico",
    ),
}
#: Labelled texts in the sample at most, hash buckets of features, and the cut for predicted.
SAMPLE, BUCKETS, CUT = 8_000, 1 << 20, 0.3
#: Weight of the counterfactual penalty, swaps of a sentence, size penalty, learning rate and steps.
SWAP_WEIGHT, SWAPS, SIZE_WEIGHT, RATE, STEPS = 10.0, 3, 2e-4, 0.05, 150
_EDGE = ".,!?;:\"'()[]{}<>*_-"
_SENTENCE = re.compile(r"[^.!?\n]+")
_FEATURE_BITS = BUCKETS - 1


def word_features(word: str) -> tuple[int, ...]:
    """Hash buckets of a raw word: the bare word and its first four and five letters."""
    bare = word.strip(_EDGE)
    if not bare:
        return ()
    return tuple(zlib.crc32(f.encode()) & _FEATURE_BITS for f in (f"w:{bare}", f"4:{bare[:4]}", f"5:{bare[:5]}"))


def _words(text: str) -> set[str]:
    return set(text.lower().split())


def features(text: str) -> np.ndarray:
    return np.fromiter((f for w in {w.strip(_EDGE) for w in _words(text)} for f in word_features(w)), dtype=np.int32)


#: Place of every term: its language's terms and its number among them.
_NAMED = {t: (terms, i) for terms in reversed(IDENTITY_TERMS.values()) for i, t in enumerate(terms)}


def _names_group(words: list[str]) -> bool:
    return any(w.strip(_EDGE) in _NAMED for w in words)


def _swap(word: str, k: int) -> str:
    terms, i = _NAMED.get(word.strip(_EDGE), ((word,), 0))
    return terms[(i + 7 * k) % len(terms)]


def example_sentences(text: str) -> list[str]:
    """The sentences of a lower-case text that name a group, and its first one."""
    found = [s.strip() for s in _SENTENCE.findall(text) if s.strip()]
    return found[:1] + [s for s in found[1:] if _names_group(s.split())]


def counterfactuals(sentences: list[str], swaps: int = SWAPS) -> list[tuple[str, str]]:
    """Pairs of sentences whose scores should be equal.

    A sentence that names a group is paired with itself under other groups. Into
    any other one terms of a language are put, picked by the sentence's hash:
    neither the mention nor the choice of the group should matter.
    """
    out, languages = [], list(IDENTITY_TERMS.values())
    for sentence in sentences:
        words = sentence.split()
        if _names_group(words):
            out += [(" ".join(words), " ".join(_swap(w, k) for w in words)) for k in range(1, swaps + 1)]
        else:
            place = zlib.crc32(sentence.encode())
            terms = languages[place % len(languages)]
            put = [f"{terms[(place // 7 + 11 * k) % len(terms)]} {sentence}" for k in range(2)]
            out += [(sentence, put[0]), (put[0], put[1])]
    return out


class _Rows:
    """Sparse rows of feature counts."""

    def __init__(self, rows: list[np.ndarray], names: np.ndarray) -> None:
        ids = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.minimum(np.searchsorted(names, ids), len(names) - 1)
        known = names[at] == ids
        self.ids, self.row, self.n = at[known], row[known], len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.ids], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.ids, weights=g[self.row], minlength=size)


def fit(texts: list[str], labels: list[int], sentences: list[str] | None = None, swap_weight: float = SWAP_WEIGHT) -> tuple[dict[int, float], float]:
    """Weights by feature bucket and the bias; without both labels the weights are empty and the bias is the share.

    sentences: those that counterfactual pairs are made of, by default example sentences of the texts.
    """
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        return {}, float(np.log(share / (1 - share)))
    pairs = counterfactuals([s for t in texts for s in example_sentences(t.lower())] if sentences is None else sentences)
    rows = [features(t) for t in texts]
    left, right = ([features(p[i]) for p in pairs] for i in (0, 1))
    used, times = np.unique(np.concatenate([*rows, *left, *right]), return_counts=True)
    used = used[times > 1] if (times > 1).any() else used  # a feature seen once says nothing about other texts
    x, a, b = (_Rows(part, used) for part in (rows, left, right))
    n = len(used)
    w, bias = np.zeros(n), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, STEPS + 1):
        g = (1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -30, 30))) - y) / len(y)
        grad, grad_bias = x.back(g, n), float(g.sum())
        if pairs:
            change = a.dot(w) - b.dot(w)
            grad += (a.back(change, n) - b.back(change, n)) * (2 * swap_weight / len(pairs))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * grad_bias, 0.99 * vb + 0.01 * grad_bias**2
        scale = RATE / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= scale * m / (1 - 0.9**step)
        bias -= RATE * mb / (1 - 0.9**step) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
        w = np.maximum(w - np.minimum(scale * SIZE_WEIGHT, RATE), 0)  # evidence is never negative: length must not hide it
    kept = np.flatnonzero(w)
    return dict(zip(used[kept].tolist(), w[kept].tolist())), float(bias)


class Scorer:
    """Scores of texts under fitted weights; remembers a bounded number of words."""

    def __init__(self, weights: dict[int, float], bias: float, remembered: int = 400_000) -> None:
        self.weights, self.bias, self.remembered, self.known = weights, bias, remembered, {}

    def score(self, text: str) -> float:
        known, total = self.known, self.bias
        words = _words(text)
        got = [known.get(w) for w in words]
        if None in got:
            if len(known) > self.remembered:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = sum(self.weights.get(f, 0.0) for f in word_features(w))
            got = [known[w] for w in words]
        return 1 / (1 + np.exp(-np.clip(total + sum(got), -30, 30)))


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column, most: int) -> pa.Table:
    """words, sentences, label of at most `most` labelled texts, those of least id hash; the driver holds no more.

    Repeated labels of an id count as toxic if one does. Of several texts with
    one id the first by its sorted words is learned from.
    """
    named = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = named.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    packed = rows.join(F.broadcast(chosen), "id").select("id", "label", "text").mapInArrow(_packed_words, "id long, label int, words string, sentences array<string>")
    return packed.groupBy("id", "label").agg(F.min(F.struct("words", "sentences")).alias("t")).select("id", "label", "t.words", "t.sentences").toArrow().sort_by("id")


def _packed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words once, and the example sentences: what the fit needs of a text."""
    for batch in batches:
        texts = [t.lower() for t in batch.column(2).to_pylist()]
        words = [" ".join(sorted({w.strip(_EDGE) for w in t.split()})) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.string()), pa.array([example_sentences(t) for t in texts], pa.list_(pa.string()))], ["id", "label", "words", "sentences"])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, cut_at: float = CUT) -> DataFrame:
    """Per row: id, held_out (crc32 of the id as text mod 4 is 2), score, predicted (1 if score >= cut_at).

    Fitted on at most `sample` labelled rows that are not held out; null labels
    and null texts are not learned from. Only the text enters a score, all of
    it, however long. Null and empty texts get the score of a text without
    words. A null id counts as not held out. An id with several labels is toxic
    if one says so. Repeated rows give repeated scores; an empty table gives
    none. Other columns may have any names.
    """
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, ~held_out(id_col, 4, 2), sample)
    weights, bias = fit(rows.column("words").to_pylist(), rows.column("label").to_pylist(), [s for own in rows.column("sentences").to_pylist() for s in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(weights, bias)
        for batch in batches:
            scores = [own.score(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= cut_at) for s in scores], pa.int32())], [id_col, "held_out", "score", "predicted"])

    chosen = docs.select(F.col(id_col).cast("long").alias(id_col), held_out(id_col, 4, 2).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"{id_col} long, held_out boolean, score double, predicted int")
