"""Quality classifier: weak labels from overlapping heuristics, a hashed linear scorer on top."""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .linear import fit, sigmoid, slot
from .quality_rules import _votes, base_counts, fit_votes

SAMPLE, KNOWN = 10_000, 400_000
#: Steps of the scales on which a text's measures are cut.
STEPS = 12
_LETTERS = re.compile(r"[^\W\d_]+")


def _shape(token: str) -> list[int]:
    """Slots of a token: its case, all its signs, its length, its beginning and the whole of it."""
    word = _LETTERS.search(token)
    case = "none" if not word else "upper" if len(word[0]) > 1 and word[0].isupper() else "title" if word[0][:1].isupper() else "lower"
    signs, n = re.sub(r"\w", "", token), len(token)
    return [slot(f"case {case}"), slot(f"signs {signs}"), slot(f"long {n if n <= 20 else 20 + n.bit_length()}"), slot(f"start {token[:3].lower()}"), slot(f"token {token.lower()}")]


def _whole(text: str, tokens: list[str]) -> list[int]:
    """Slots of the text's measures: distinct tokens and lines, length, tokens equal to the one before."""
    n = max(1, len(tokens))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    same = sum(map(eq, tokens, tokens[1:]))
    step = lambda x: min(STEPS, int(x * STEPS))
    return [
        slot(f"distinct {step(len(set(tokens)) / n)}"),
        slot(f"variety {step(len(set(tokens)) / (12 * n**0.5))}"),
        slot(f"same {step(same / n)}"),
        slot(f"lines {step(len(set(lines)) / max(1, len(lines)))}"),
        slot(f"length {min(16, n.bit_length())}"),
    ]


def _vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    tokens = text.split()
    counts: dict[int, float] = {}
    for t in tokens:
        for s in _shape(t):
            counts[s] = counts.get(s, 0.0) + 5.0 / len(tokens)
    for s in _whole(text, tokens):
        counts[s] = counts.get(s, 0.0) + 1.0
    return np.fromiter(counts, np.int32, len(counts)), np.fromiter(counts.values(), np.float32, len(counts))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [_vector(t.as_py() or "") for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("order"), b.column("posterior"), pa.array([a.tobytes() for a, _ in out], pa.binary()), pa.array([v.tobytes() for _, v in out], pa.binary())], names=["order", "posterior", "at", "v"])


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        known: dict[str, float] = {}
        for b in batches:
            out = []
            for t in b.column("text"):
                text = t.as_py() or ""
                tokens, total = text.split(), 0.0
                for token in tokens:
                    x = known.get(token)
                    if x is None:
                        x = float(sum(weights[s] for s in _shape(token)))
                        if len(known) >= KNOWN:
                            known.clear()
                        known[token] = x
                    total += x
                total = bias + total * 5.0 / max(1, len(tokens)) + float(sum(weights[s] for s in _whole(text, tokens)))
                out.append(sigmoid(total))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def _shift(labelled: DataFrame, drawn: pd.Series) -> float:
    """What the log odds of good in the corpus have over those in the sample."""
    n, good = labelled.agg(F.count("*"), F.sum(F.round("posterior", 9).cast("decimal(38,9)")).cast("double")).first()
    odds = lambda good, n: float(np.log((good + 0.5) / (n - good + 0.5)))
    return odds(good or 0.0, n) - odds(float(drawn.sum()), len(drawn))


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: better).

    Twelve heuristic labellers vote or abstain on every document. EM over all
    documents estimates how each votes on good and bad ones, and the posterior
    of a document's votes becomes its label: no marked data is used. A
    logistic scorer over hashed token forms and measures of the text is fitted
    to the posteriors of at most ``sample`` documents, half of them from either
    side of 0.5 if there are as many, the first by a hash of id and text; it
    scores every text whole, however long. As the halves aren't the shares of the corpus, the
    scorer's bias is moved by the difference of their log odds: 0.5 is even odds in the corpus.

    Null text has no words. Repeated rows count each. An empty table gives an
    empty result. Equal rows have equal scores. The driver sees vote patterns (3^12 at most) and the sample, one row per
    id and text. Only id and text are read, so other columns can't clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spark = docs.sparkSession
    d = base_counts(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")))
    d = d.select("doc_id", "text", F.array(*_votes(F.col("text")).values()).alias("votes"))
    # a hash of the row, not its text, goes to the table of votes; equal rows have equal votes
    mark = F.xxhash64(F.lit("weak"), "doc_id", "text")
    votes = stored(d.select(mark.alias("order"), "votes"), "weak-votes")
    _, _, post = fit_votes([(tuple(r["votes"]), r["n"]) for r in votes.groupBy("votes").agg(F.count("*").alias("n")).collect()])
    model = F.broadcast(spark.createDataFrame([(list(p), q) for p, q in sorted(post.items())], "votes array<int>, posterior double"))
    labelled = votes.join(model, "votes").select("order", "posterior")
    sides = [labelled.filter(x).dropDuplicates(["order"]).orderBy("order").limit(sample // 2) for x in (F.col("posterior") >= 0.5, F.col("posterior") < 0.5)]
    chosen = sides[0].unionByName(sides[1])
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("order", mark)
    drawn = base.join(F.broadcast(chosen.select("order", "posterior")), "order").groupBy("order", "posterior").agg(F.min("text").alias("text"))
    rows = drawn.mapInArrow(_features, "order long, posterior double, at binary, v binary").toPandas()
    rows = rows.sort_values("order")
    weights, bias = fit([(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32), float(t)) for a, v, t in zip(rows["at"], rows["v"], rows["posterior"], strict=True)])
    bias += _shift(labelled, rows["posterior"])
    return base.select("doc_id", "text").mapInArrow(_score(spark.sparkContext.broadcast((weights, bias))), "doc_id long, score double")
