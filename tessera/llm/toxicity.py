"""Toxicity: disguised words are restored, then a hashed linear scorer reads the restored text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import fit, sigmoid, slot
from .noisy_channel import SPACED, language_model, plain, restore

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 9)
#: Most labelled rows that the scorer is fitted on, the first by a hash of the id; words kept in a worker's memory.
SAMPLE, KNOWN = 10_000, 400_000
#: A word's weight counts as STEADY of n + STEADY; the strength of L1.
STEADY, SPARSE = 120, 5e-3


def _slots(word: str) -> list[int]:
    """Slots of a word: the whole of it, and its beginnings, which forms of one stem share."""
    return [slot(f"={word}"), *[slot(f"{k}{word[:k]}") for k in PREFIXES if len(word) >= k]]


def _tokens(text: str, lm: np.ndarray) -> Iterator[str]:
    """White-space tokens; single letters in a row are one disguised token."""
    if SPACED.search(text):
        text = SPACED.sub(lambda m: restore(m[0], lm).replace(" ", " "), text)
    return text.split()


def _features(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = held.value
        for b in batches:
            out = []
            for t in b.column("text"):
                counts: dict[int, int] = {}
                n = 0
                for token in _tokens(t.as_py() or "", lm):
                    for w in _WORD.findall(plain(token, lm)):
                        n += 1
                        for s in _slots(w):
                            counts[s] = counts.get(s, 0) + 1
                at = np.fromiter(counts, np.int32, len(counts))
                v = np.fromiter(counts.values(), np.float32, len(counts)) * np.float32(STEADY / (n + STEADY))
                out.append((at.tobytes(), v.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["doc_id", "toxic", "at", "v"])

    return run


def _scores(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, weights, bias = held.value
        known: dict[str, tuple[float, int]] = {}
        for b in batches:
            out = []
            for t in b.column("text"):
                total, n = 0.0, 0
                for token in _tokens(t.as_py() or "", lm):
                    x = known.get(token)
                    if x is None:
                        ws = _WORD.findall(plain(token, lm))
                        x = (float(sum(weights[s] for w in ws for s in _slots(w))), len(ws))
                        if len(known) >= KNOWN:
                            known.clear()
                        known[token] = x
                    total += x[0]
                    n += x[1]
                out.append(sigmoid(bias + total * STEADY / (n + STEADY)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: toxic likelier).

    A letter language model (60^3 sums at most from each task) is counted
    over all texts. Tokens with leetspeak, signs between letters, spaced
    letters or letters repeated three times and more become lattices, decoded by Viterbi under the model
    and a channel's costs; all other tokens have a single path and stay. The
    scorer is logistic with L1 over hashed words of the restored text, whole and by their beginnings, fitted
    on at most ``sample`` labelled documents, the first by a hash of the id;
    every text is scored whole, however long. Only the text is an input of a score.

    Null text and a text without words get the scorer's bias. Labels that clash for one id
    count as the highest of them; of texts that share an id, the one with the least hash is fitted; labels without a document
    are not drawn. So the driver gets ``sample`` rows at most. Without usable
    labels (none, or null ones) the score is 0.5. Repeated rows are scored each. Equal texts have equal scores. An
    empty table gives an empty result. Only id, text and label are read, so other columns can't clash.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    lm = language_model(d)
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(d.select("doc_id"), "doc_id", "left_semi")
    chosen = chosen.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(sample)
    fitted = d.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    rows = fitted.select("doc_id", "toxic", "x.text").mapInArrow(_features(spark.sparkContext.broadcast(lm)), "doc_id long, toxic int, at binary, v binary").toPandas()
    rows = rows.sort_values(["doc_id", "toxic"], kind="stable")
    weights, bias = fit([(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32), float(t)) for a, v, t in zip(rows["at"], rows["v"], rows["toxic"], strict=True)], l1=SPARSE)
    return d.mapInArrow(_scores(spark.sparkContext.broadcast((lm, weights, bias))), "doc_id long, score double")
