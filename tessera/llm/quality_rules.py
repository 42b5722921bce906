"""Quality rules as weak supervision: votes, EM over vote patterns, a posterior per document."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, words

#: Marks of markup and table rubbish.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages of the corpus.
STOPWORDS = (
    "the of and to in is that for it as with was on by this be at from are an",
    "la le les de des et un une en est que qui du pour par dans au sur pas il",
    "der die das und zu ein eine ist mit von den nicht im auf für sich dem als auch es",
    "el los las y una para con no por se su del al lo como más o sus",
)
_STOP = sorted({w for line in STOPWORDS for w in line.split()})
RULES = ("symbols", "repetition", "dup_lines", "echoes", "variety", "capitals", "bangs", "bars", "word_length", "stopwords", "letters", "length")


def _repeats(g: Column) -> Column:
    """Starts of the windows in ``g`` (structs h, i sorted by h, i) whose hash occurs again."""
    return F.filter(g, lambda x, k: (x.h == F.get(g, k - 1).h) | (x.h == F.get(g, k + 1).h))


def base_counts(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct (words), n_echoes (words equal to the one before) and n_stopwords, all longs and expressions on the row.

    Nothing is shuffled. The windows of a text are hashed to 64 bits; only a
    text in which some window recurs has its windows sorted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    d = docs.withColumns({"__q_words": words(F.col(text_col)), "__q_lines": lines})
    d = d.withColumn("__q_h", F.transform("__q_words", lambda w: F.xxhash64(w)))
    grams = F.when(
        F.size("__q_h") >= window,
        F.transform(F.sequence(F.lit(0), F.size("__q_h") - window), lambda i: F.xxhash64(*[F.get("__q_h", i + j) for j in range(window)])),
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("__q_g", grams)
    d = d.withColumn("__q_s", F.when(F.size(F.array_distinct("__q_g")) < F.size("__q_g"), F.sort_array(F.transform("__q_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("__q_at", F.sort_array(F.transform(_repeats(F.col("__q_s")), lambda x: x.i)))
    covered = F.aggregate(
        F.col("__q_at"),
        F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s.n + F.least(F.lit(window), i - s.last)).alias("n")),
        lambda s: s.n,
    )
    return d.withColumns({
        "n_words": F.size("__q_words").cast("long"),
        "word_chars": F.length(F.array_join("__q_words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_distinct": F.size(F.array_distinct("__q_h")).cast("long"),
        "n_echoes": F.size(F.filter("__q_h", lambda h, i: h == F.get("__q_h", i - 1))).cast("long"),
        "n_stopwords": F.size(F.filter("__q_words", lambda w: w.isin(_STOP))).cast("long"),
    }).drop("__q_words", "__q_lines", "__q_h", "__q_g", "__q_s", "__q_at")


def _votes(text: Column) -> dict[str, Column]:
    """1 for good, -1 for bad, 0 for an abstention, of each rule; the base counts are columns already."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))

    def three(x: Column, bad: float, good: float) -> Column:
        """A measure that is bad when high."""
        return F.when(x > bad, -1).when(x <= good, 1).otherwise(0)

    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    votes = {
        "symbols": three(F.col("n_symbols") / n, 0.15, 0.01),
        "repetition": three(F.col("n_repeat_words") / n, 0.2, 0.0),
        "dup_lines": three(F.col("n_dup_lines") / n, 0.05, 0.0),
        "echoes": three(F.col("n_echoes") / n, 0.2, 0.02),
        "variety": F.when((n >= 40) & (F.col("n_distinct") < 3.5 * F.sqrt(n)), -1).when(F.col("n_distinct") >= 5 * F.sqrt(n), 1).otherwise(0),
        "capitals": three(kept(r"[^\p{Lu}]+") / chars, 0.3, 0.1),
        "bangs": three(F.regexp_count(text, F.lit(r"!!")) / n, 0.15, 0.01),
        "bars": three(F.regexp_count(text, F.lit(r"\|")) / n, 0.15, 0.01),
        "word_length": F.when((chars / n < 2) | (chars / n > 15), -1).when(chars / n <= 11, 1).otherwise(0),
        "stopwords": F.when((n >= 20) & (F.col("n_stopwords") / n < 0.02), -1).otherwise(0),
        "letters": F.when(kept(r"[^\p{L}]+") / chars < 0.7, -1).otherwise(0),
        "length": F.when(F.col("n_words") >= 50, 1).otherwise(0),
    }
    return {k: v.cast("int") for k, v in votes.items()}


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict[str, dict[int, float]]], dict[tuple[int, ...], float]]:
    """EM over vote patterns with their counts: the prior, each rule's P(vote | class), and P(good | pattern).

    The start holds a pattern with any bad vote for bad; from there on the
    rules' accuracies are free. Add-one smoothing keeps all values inside
    (0, 1). Sums run in sorted order, so that the result doesn't depend on
    the order in which Spark returns the patterns.
    """
    patterns = sorted(patterns)
    if not patterns:
        return 0.5, [], {}
    total, m = sum(c for _, c in patterns), len(patterns[0][0])
    post = {p: 0.1 if -1 in p else 0.95 for p, _ in patterns}
    prior, rates = 0.5, []
    for _ in range(rounds):
        good = math.fsum(post[p] * c for p, c in patterns)
        prior = (good + 1) / (total + 2)
        rates = []
        for j in range(m):
            at = {"good": {}, "bad": {}}
            for v in (-1, 0, 1):
                g = math.fsum(post[p] * c for p, c in patterns if p[j] == v)
                b = math.fsum((1 - post[p]) * c for p, c in patterns if p[j] == v)
                at["good"][v], at["bad"][v] = (g + 1) / (good + 3), (b + 1) / (total - good + 3)
            rates.append(at)
        new = {}
        for p, _ in patterns:
            odds = math.log(prior / (1 - prior)) + math.fsum(math.log(rates[j]["good"][v] / rates[j]["bad"][v]) for j, v in enumerate(p))
            new[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        moved = max(abs(new[p] - post[p]) for p in new)
        post = new
        if moved < 1e-9:
            break
    return prior, rates, post


def quality_rules(docs: DataFrame, text_col: str = "text", keep_at: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry`` alone) with the base counts, ``votes``, ``quality`` (posterior of good), ``base_failed`` and ``kept`` added.

    Twelve rules vote good, bad or abstain on a document. EM estimates how each
    rule votes on good and on bad documents (its accuracy) over all documents,
    and the posterior decides, not an all-must-pass filter. All work on rows
    is DataFrame functions. The driver sees only the counts of the vote
    patterns, at most 3^12 whatever the input; the posteriors go back in a
    table of that bound, broadcast.

    Null text has no words. Documents under ten words, or with over 20 % of
    their words in repeated windows, fail the base whatever the posterior.
    Repeated rows each count; an empty table gives an empty result; other
    columns stay, but those with the name of an added one give way to it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes"]
    docs = docs.drop(*added, "n_distinct", "n_echoes", "n_stopwords", "quality", "base_failed", "kept")
    own = docs.columns if carry is None else [c for c in carry if c in docs.columns]
    d = base_counts(docs, text_col)
    d = d.withColumn("votes", F.array(*_votes(text).values()))
    d = stored(d.select(*own, *added), "votes")
    found = [(tuple(r["votes"]), r["n"]) for r in d.groupBy("votes").agg(F.count("*").alias("n")).collect()]
    _, _, post = fit_votes(found)
    rows = [(list(p), q) for p, q in sorted(post.items())]
    model = d.sparkSession.createDataFrame(rows, "votes array<int>, quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    d = d.join(F.broadcast(model), "votes", "left")
    return d.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= keep_at))
