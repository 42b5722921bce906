"""Personal data: rules for exact forms, a BiLSTM-CRF for the rest."""

from __future__ import annotations

import hashlib
import inspect
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shared import shared_dir

from . import bilstm_crf
from .bilstm_crf import STRIDE, WINDOW, Tagger, char_ids, reconciled, trained, windows_of
from .pii_rules import KINDS, Span, base_spans, luhn

#: All that _sound accepts holds a decimal digit, an @ or the word "at", in any case: a span without one is none.
_ANCHOR = re.compile(r"[\d@]|(?<![^\W_])at(?![^\W_])", re.IGNORECASE)
#: Windows that go through the network at once.
AT_ONCE = 512
#: Fewest and most digits of a span of each kind.
_DIGITS = {"ip": (4, 12), "card": (12, 19), "phone": (9, 15)}
_AT = r"(?:\s?(?:@|[(\[{<]\s?at\s?[)\]}>])\s?|\sat\s)"
_DOT = r"(?:\.(?=\S)|\s\.\s?|\s?[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s?|\sdot\s)"
#: What an address may look like; the model says where one is, the form says where it begins and ends.
_EMAIL = re.compile(rf"(?<![a-z0-9])[a-z0-9._%+-]{{1,64}}{_AT}[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{1,63}})+", re.IGNORECASE)
_IP_PARTS = re.compile(rf"\d{{1,3}}(?:{_DOT}\d{{1,3}}){{3}}", re.IGNORECASE)
_BEFORE, _BEHIND = re.compile(r"(?:\d+[-./_])+$"), re.compile(r"(?:[-./_]\d+)+")
#: An address is looked for so far around a span of the model.
_REACH = 128


def _sound(text: str, span: Span) -> Span | None:
    """A span of the model, fitted to the words or numbers that it cuts, if it has the parts that its kind can't do without."""
    a, b, kind = span
    anchor = _ANCHOR.search(text, a)
    if anchor is None or anchor.start() >= b:
        return None
    if kind == "email":
        low = max(0, a - _REACH)
        for m in _EMAIL.finditer(text, low, b + _REACH):
            if m.start() < b and m.end() > a:
                return m.start(), m.end(), kind
        return None
    while a < b and text[a] in " \n\t.,;:!#*$%&|=\"'":
        a += 1
    while a < b and text[b - 1] in " \n\t.,;:!#*$%&|=\"'([":
        b -= 1
    before, behind = _BEFORE.search(text, max(0, a - 24), a), _BEHIND.match(text, b)
    a, b = (before.start() if before else a), (behind.end() if behind else b)
    s = text[a:b]
    low, high = _DIGITS[kind]
    digits = "".join(c for c in s if c.isdecimal())
    whole = not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
    if not (low <= len(digits) <= high and whole):
        return None
    if kind == "ip":
        return (a, b, kind) if _IP_PARTS.fullmatch(s) and all(int(x) <= 255 for x in re.findall(r"\d+", s)) else None
    if any(c.isalpha() for c in s):
        return None
    if kind == "card" and s.startswith("00"):
        kind = "phone"  # no issuer's number begins so; an international call does
    if kind == "card" and not luhn(digits) or kind == "phone" and len(digits) > 15:
        return None
    return a, b, kind


def _merge(base: list[Span], more: list[Span]) -> list[Span]:
    """Base spans stay; a span of the model is added where it meets none of them."""
    out = list(base) + [m for m in more if all(m[1] <= a or m[0] >= b for a, b, _ in base)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _around(length: int, spans: list[Span]) -> set[int]:
    """Starts of all windows that read a span or the position before or behind it."""
    blocks = {k for a, b, _ in spans for k in range(max(a - 1, 0) // STRIDE - 1, min(b, length - 1) // STRIDE + 1)}
    return {k * STRIDE for k in blocks if k >= 0}


def _model_spans(model: Tagger, texts: list[str]) -> list[list[Span]]:
    """Per text, the spans with an anchor that decoding all its windows would give.

    The windows around anchors are decoded first, then those around each span
    found, until no span reaches a position that a window not yet decoded reads.
    """
    rows: list[dict[int, np.ndarray]] = [{} for _ in texts]
    spans: list[list[Span]] = [[] for _ in texts]
    jobs = []
    for n, t in enumerate(texts):
        anchors = np.fromiter((m.start() for m in _ANCHOR.finditer(t)), np.int64)
        jobs += [(n, s) for s in windows_of(len(t), anchors)] if len(anchors) else []
    while jobs:
        for at in range(0, len(jobs), AT_ONCE):
            own = jobs[at : at + AT_ONCE]
            ids = np.zeros((len(own), WINDOW), np.int64)
            for i, (n, s) in enumerate(own):
                c = char_ids(texts[n][s : s + WINDOW])
                ids[i, : len(c)] = c
            for (n, s), row in zip(own, model.decode(ids), strict=True):
                rows[n][s] = row
        touched, jobs = sorted({n for n, _ in jobs}), []
        for n in touched:
            starts = sorted(rows[n])
            spans[n] = reconciled(len(texts[n]), starts, [rows[n][s] for s in starts])
            jobs += [(n, s) for s in sorted(_around(len(texts[n]), spans[n]) - rows[n].keys())]
    return spans


def fitted(spark: SparkSession) -> dict[str, np.ndarray]:
    """The trained parameters: from the shared folder where some driver has left those of this very generator and code, else trained and left there."""
    mark = hashlib.sha256(inspect.getsource(bilstm_crf).encode()).hexdigest()[:16]
    path = f"{shared_dir(spark).rstrip('/')}/tessera-pii-model-{mark}"
    try:
        row = spark.read.schema("model binary").parquet(path).first()
        if row:
            return dict(np.load(io.BytesIO(row["model"])))
    except PySparkException:
        pass  # none there yet
    p, out = trained()[0], io.BytesIO()
    np.savez(out, **p)
    spark.createDataFrame([(bytearray(out.getvalue()),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return p


def _find(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger()
        model.p = held.value
        for b in batches:
            texts = [t.as_py() or "" for t in b.column("text")]
            base = [base_spans(t) for t in texts]
            found = _model_spans(model, texts)
            every = [_merge(base[n], [x for x in (_sound(t, s) for s in found[n]) if x]) for n, t in enumerate(texts)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
            pack = lambda rows: pa.array([[{"start": a, "end": e, "kind": k} for a, e, k in r] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pack(base), pack(every)], names=["doc_id", "base", "spans"])

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base (spans by rule) and spans (base and those of the model): arrays of (start, end, kind), in code points, end exclusive.

    The model is a bidirectional LSTM over characters with a CRF on top,
    trained in numpy on the driver from 3 200 windows of labelled spans that a
    generator makes (so it is the same at any size of the corpus), and left in the shared folder
    for later drivers. Windows of
    96 characters every 48 are decoded by Viterbi. A position takes its tag
    from the window where it is most central, so the windows of a text end in
    one reading. A span must have a decimal digit, an @ or the word "at", so decoding
    starts at those and goes on as far as spans reach: the spans are those of
    all windows. Base spans always stay; the model adds spans that meet
    none of them.

    Null text is empty and has no span. A null id stays null. Very long texts are read whole, window by
    window. Two kinds that claim one place are ordered as in KINDS; of model spans, one place has one kind.
    Rows are independent: nothing is shuffled, repeated rows give repeated results, an empty table an empty one.
    Only the id and the text are read, so other columns can't clash.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(fitted(docs.sparkSession))
    spans = "array<struct<start:int,end:int,kind:string>>"
    return d.mapInArrow(_find(held), f"doc_id long, base {spans}, spans {spans}")


assert STRIDE * 2 == WINDOW  # each position lies in two windows
