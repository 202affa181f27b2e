"""Language identification by a byte convolutional network, in numpy.

A text is cut into windows of a fixed number of bytes. Filters of several
widths slide over the bytes; a filter's value at a place is the sum of one
weight per offset and byte. The highest value of each filter in a window, above
zero, enters a softmax over languages. A text's scores are its windows' mean,
weighted by their bytes. Training is gradient descent on windows of a bounded
sample of labelled texts of each language; the gradient of a maximum flows to
its place only. Sample, windows and their order follow from hashes of ids and
texts, so the model does not depend on how the table is dealt over tasks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kartoteka.llm.common import forget_others, slices
from kartoteka.llm.toxicity import held_out

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Labelled texts of a language in the sample at most, windows taken from each, passes over them, windows of a batch, learning rate.
SAMPLE, WINDOWS_EACH, EPOCHS, BATCH, RATE = 1_000, 3, 14, 64, 0.01
UNKNOWN = "und"
_LETTER_OR_NUMERAL = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character of a letter category (L*) is in the text; fractions, superscripts and numerals like Ⅷ are none."""
    return any(unicodedata.category(m[0])[0] == "L" for m in _LETTER_OR_NUMERAL.finditer(text))


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x bytes, zero at the end of short ones), each window's text, each window's bytes."""
    counts = np.array([max(1, -(-len(t) // size)) for t in texts])
    out = np.zeros((int(counts.sum()), size), dtype=np.uint8)
    flat, at = out.reshape(-1), 0
    sizes = np.empty(len(out), dtype=np.int64)
    row = 0
    for t, n in zip(texts, counts):
        flat[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
        sizes[row : row + n] = size
        sizes[row + n - 1] = len(t) - (n - 1) * size
        at, row = at + n * size, row + n
    return out, np.repeat(np.arange(len(texts)), counts), sizes


class ByteNet:
    def __init__(self, languages: list[str], seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def _values(self, x: np.ndarray, i: int) -> np.ndarray:
        width = WIDTHS[i]
        n = x.shape[1] - width + 1
        total = np.take(self.filters[i][0], x[:, :n], axis=0)
        for j in range(1, width):
            total += np.take(self.filters[i][j], x[:, j : j + n], axis=0)
        return total

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum(self._values(x, i).max(axis=1) + self.shift[i], 0) for i in range(len(WIDTHS))], axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), dtype=np.float64)
        for a in range(0, len(x), BATCH):
            z = self.pooled(x[a : a + BATCH]) @ self.dense + self.bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out[a : a + BATCH] = e / e.sum(axis=1, keepdims=True)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        weights = [*self.filters, *self.shift, self.dense, self.bias]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        share = np.bincount(y, minlength=len(self.languages)) / len(y)
        balance = 1 / np.maximum(share, 1e-3)
        balance /= (balance * share).sum()
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), BATCH):
                own, target = x[order[a : a + BATCH]], y[order[a : a + BATCH]]
                rows = np.arange(len(own))[:, None]
                values = [self._values(own, i) for i in range(len(WIDTHS))]
                places = [v.argmax(axis=1) for v in values]
                tops = [np.take_along_axis(v, p[:, None, :], axis=1)[:, 0, :] + s for v, p, s in zip(values, places, self.shift)]
                hidden = np.maximum(np.concatenate(tops, axis=1), 0)
                z = hidden @ self.dense + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(own)), target] -= 1
                p *= (balance[target] / len(own))[:, None]
                p = p.astype(np.float32)
                back = (p @ self.dense.T) * (hidden > 0)
                grads = []
                for i, width in enumerate(WIDTHS):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    grad = np.zeros_like(self.filters[i])
                    for j in range(width):
                        np.add.at(grad[j], (own[rows, places[i] + j], np.arange(FILTERS)[None, :]), g)
                    grads.append(grad)
                grads += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(axis=0) for i in range(len(WIDTHS))]
                grads += [hidden.T @ p, p.sum(axis=0)]
                step += 1
                for w, g, m, v in zip(weights, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


def drawn(text: bytes, seed: int) -> list[bytes]:
    """Windows from anywhere in the text: one whole, the others short cuts, so that short texts are known too."""
    rng, out = np.random.default_rng(seed), []
    for k in range(WINDOWS_EACH):
        size = WINDOW if k == 0 else int(rng.integers(8, WINDOW + 1))
        start = int(rng.integers(0, max(1, len(text) - size + 1)))
        out.append(text[start : start + size])
    return out


def fit(samples: list[list[bytes]], languages: list[str], seed: int = 1) -> ByteNet:
    """Trains on the windows drawn from each text."""
    names = sorted(set(languages))
    net = ByteNet(names, seed)
    if len(names) > 1:
        target = [names.index(x) for own, x in zip(samples, languages) for _ in own]
        net.train(windows([w for own in samples for w in own])[0], np.array(target))
    return net


def labelled_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> tuple[list[list[bytes]], list[str]]:
    """Windows of at most `sample` texts of each language that are not held out, those of least hash, and their languages.

    Of rows that agree in id, language and text one is learned from.
    """
    usable = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col, 3, 1)
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    rows = docs.filter(usable).select(lang.alias("lang"), F.xxhash64(F.lit(5), F.col(id_col), text).alias("h"), text.alias("text"))
    # of n hashes about 2 * sample lie below 2 * sample / n of their range: only these are ranked, in a language of any size
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    low = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("n")) * 2.0**64 - 2.0**63
    near = rows.select("lang", "h").join(F.broadcast(counts), "lang").filter(F.col("h") <= low)
    least = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("rank") <= sample)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(1).to_pylist()
            own = [drawn(t.encode(), h & 0xFFFFFFFF) for t, h in zip(batch.column(2).to_pylist(), seeds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.binary()))], ["lang", "h", "windows"])

    # `sample` keys a language, fewer bytes than the windows that the driver is about to hold
    picked = rows.join(F.broadcast(least.select("lang", "h").distinct()), ["lang", "h"]).mapInArrow(draw, "lang string, h long, windows array<binary>")
    got = picked.dropDuplicates(["lang", "h"]).toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    return got.column("windows").to_pylist(), got.column("lang").to_pylist()


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, row_col: str | None = None) -> DataFrame:
    """Per row: id, held_out (crc32 of the id as text mod 3 is 1), lang_pred, score; and, as struct `row_col`, the row itself.

    Learned from at most `sample` rows of each language that are not held out.
    Only the text enters a prediction; all of it does, however long. lang_pred
    is `und`, with score 0, where the text is null or has no letter, or where
    nothing was learned. Rows with a null id count as not held out. Repeated
    rows give repeated predictions; an empty table gives none. Input columns
    may have any names. Ties go to the language that is first by code points.
    """
    samples, languages = labelled_windows(docs, id_col, text_col, lang_col, sample)
    net = fit(samples, languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            rows = batch.column(1).to_pylist()
            data = [(t or "").encode() for t in rows]
            named = [bool(t and net.languages and has_letter(t)) for t in rows]
            predicted, scores = [], []
            for a, b in slices(data, 1_000_000):
                x, owner, sizes = windows(data[a:b])
                mean = np.zeros((b - a, max(1, len(net.languages))))
                if net.languages:
                    p = net.probabilities(x) * np.maximum(sizes, 1)[:, None]
                    mean = np.stack([np.bincount(owner, weights=p[:, c], minlength=b - a) for c in range(p.shape[1])], axis=1) / np.bincount(owner, weights=np.maximum(sizes, 1), minlength=b - a)[:, None]
                best = mean.argmax(axis=1)
                predicted += [net.languages[k] if n else UNKNOWN for k, n in zip(best, named[a:b])]
                scores += [min(1.0, float(mean[i, k])) if n else 0.0 for i, (k, n) in enumerate(zip(best, named[a:b]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], ["row", "held_out", "lang_pred", "score"])

    row = F.struct("*") if row_col else F.lit(0)
    chosen = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), row.alias("whole")).alias("row"), F.col(text_col).cast("string").alias("text"), held_out(id_col, 3, 1).alias("held_out"))
    done = chosen.mapInArrow(run, f"row {chosen.schema['row'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
    return done.select(F.col("row.id").alias(id_col), "held_out", "lang_pred", "score", *([F.col("row.whole").alias(row_col)] if row_col else []))
