"""Each training-data operator against plain Python, on a fixture of hard cases and on the smallest tables."""

from __future__ import annotations

import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path[:0] = [os.path.dirname(__file__), os.path.dirname(os.path.dirname(__file__))]

import brute  # noqa: E402
import oracle  # noqa: E402

import corpus_pipeline  # noqa: E402
from tessera.llm import bilstm_crf, golomb, jaccard, noisy_channel, oracles, packing, pii, pii_rules, quality_rules, queries, simhash, toxicity  # noqa: E402
from tessera.llm import exact_dedup as exact_dedup_module
from tessera.llm import line_dedup as line_dedup_module
from tessera.llm.components import components  # noqa: E402
from tessera.llm.exact_dedup import exact_dedup  # noqa: E402
from tessera.llm.line_dedup import line_dedup  # noqa: E402
from tessera.llm.mixing import mix_sources  # noqa: E402
from tessera.llm.pii import find_pii  # noqa: E402
from tessera.llm.quality_model import quality_scores  # noqa: E402
from tessera.llm.sharding import vector_shards  # noqa: E402
from tessera.llm.tokens import ids_of  # noqa: E402

SHARED = "A line that many documents hold, long enough to count."
rng = random.Random(5)
VOCAB = ["the", "of", "reason", "garden", "water", "and", "to", "stone", "évident", "für", "señal", "light", "in", "is", "a"]
prose = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n)) + "."

#: doc_id, text, source, and columns whose names operators use themselves.
CASES = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\f\r ", None), (None, prose(30), "b"), (None, None, None),
    (4, "same  text\there", "a"), (5, "same text here", "a"), (6, "Same text here", "a"), (7, "same text here ", "b"),
    (8, prose(60), "b"), (8, prose(60), "b"),
    (9, prose(20_000), "b"), (10, "x" * 30_000, "c"), (11, "\n" * 500, "c"),
    *[(20 + i, prose(12) + "\n" + ("  " * i) + (SHARED.upper() if i % 2 else SHARED) + "\r\n" + prose(15), "c") for i in range(7)],
    (30, SHARED, "c"), (31, "one two three four five " * 12, "a"), (32, "Great$$$ deal%%% here*** now### " * 20, "a"),
    (33, "\U0001f600 emoji ​ and ퟿ text with \x1c odd \x85 spaces here", "d"), (34, "tie\ntie\ntie", "d"), (35, "ends in newline\n", "d"),
]
SAME = (40, prose(50), "a")
CASES += [SAME, SAME]
CLASH = ["k1", "unit", "shard", "slot", "votes", "quality", "kept", "copy", "length", "sha", "tie", "fp", "keys", "n_lines", "score", "rank", "b"]
EMPTY_OK = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(CASES, EMPTY_OK).repartition(3)
    return d.withColumns({c: F.lit(f"mine {c}") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EMPTY_OK)


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect()), key=repr)


def test_base_counts(docs):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = by_id(quality_rules.quality_rules(docs), *cols)
    assert got == sorted(((i, *(brute.base(t)[c] for c in cols)) for i, t, _ in CASES), key=repr)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.tuples(*[st.sampled_from([-1, 0, 1])] * 3), st.integers(1, 50)), min_size=1, max_size=12, unique_by=lambda x: x[0]))
def test_em_is_ordered_and_bounded(patterns):
    a, b = quality_rules.fit_votes(patterns), quality_rules.fit_votes(patterns[::-1])
    assert a[2] == b[2] and all(0 <= v <= 1 for v in a[2].values())


def test_em_finds_a_weak_rule():
    """Two good rules and one that votes at random: its accuracy comes out near a half."""
    r, counts = random.Random(1), Counter()
    for _ in range(20_000):
        y = 1 if r.random() < 0.8 else -1
        counts[(y if r.random() < 0.95 else -y, y if r.random() < 0.9 else 0, 1 if r.random() < 0.99 else -1)] += 1
    prior, rates, post = quality_rules.fit_votes(list(counts.items()))
    assert abs(prior - 0.8) < 0.1 and rates[0]["good"][1] > 0.85 and post[(1, 1, 1)] > 0.9 > 0.1 > post[(-1, -1, 1)]


@pytest.mark.parametrize("bits", [1 << 28, 1 << 4])
def test_exact_dedup(docs, none, monkeypatch, bits):
    monkeypatch.setattr(exact_dedup_module, "FILTER_BITS", bits)
    named = [(i, t) for i, t, _ in CASES]
    groups = defaultdict(list)
    for i, t in named:
        groups[" ".join(brute.re.split(brute.WS, t or ""))].append(i)
    want = []
    for t, ids in groups.items():
        least = min((x for x in ids if x is not None), default=None)
        want += [(i, least, len(ids), i == least, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert by_id(exact_dedup(docs), "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup(none).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**42), max_size=60))
def test_golomb_round_trip(values):
    v = np.sort(np.array(values, np.int64))
    k, code = golomb.encode(v)
    assert golomb.decode(len(v), k, code).tolist() == v.tolist()


def test_golomb_is_small():
    v = np.sort(np.random.default_rng(0).integers(0, 2**42, 100_000))
    assert len(golomb.encode(v)[1]) * 8 / len(v) < math.log2(2**42 / len(v)) + 2.2


def test_line_dedup(spark, docs, none):
    """A hot line and cold ones, null and repeated ids; a line that one document repeats in five rows is held by one."""
    own = "A line that one document repeats in each of its rows, and one more holds."
    more = [(50, f"{own}\nrow {n}", "a") for n in range(5)] + [(51, own, "a"), (None, SHARED, "a")]
    d = docs.unionByName(spark.createDataFrame(more, EMPTY_OK), allowMissingColumns=True)
    named = [(i, t) for i, t, _ in CASES + more]
    left = brute.kept_lines(named)
    want = [(i, len((t or "").split("\n")), x) for (i, t), x in zip(named, left, strict=True)]
    for hot in (2000, 1):  # all lines hot, or none
        line_dedup_module.HOT = hot
        got = line_dedup(d)
        assert by_id(got, "n_lines", "text") == sorted(want, key=repr)
    line_dedup_module.HOT = 2000
    assert got.filter("b <> 'mine b'").count() == 0 and sum(own in x for x in left) == 6
    # where every line of a row goes, an empty text is left
    assert {r["n_lines"] - r["n_dropped"] - (len(r["text"].split("\n")) if r["text"] else 0) for r in got.collect()} <= {0, 1}
    assert line_dedup(none).collect() == []


def test_simhash(spark, docs, none):
    own = [(i, t) for i, t, _ in CASES if i is not None]
    one = list({i: (i, t) for i, t in own}.values())
    d = spark.createDataFrame(one, "doc_id long, text string")
    want = brute.linked(one)
    got = {r["doc_id"]: (f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in simhash.simhash_groups(d).collect()}
    assert got == want
    assert simhash.simhash_groups(docs).count() == len(CASES)
    assert simhash.simhash_groups(none).collect() == []


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    """Chains and dense clusters, with the small-bucket way and with the midpoints alone."""
    r = random.Random(3)
    fps = set()
    for _ in range(6):
        f = r.getrandbits(64)
        for _ in range(40):
            fps.add(f)
            f ^= (1 << r.randrange(64)) ^ (1 << r.randrange(64) if r.random() < 0.7 else 0)
            if r.random() < 0.2:
                f ^= 1 << r.randrange(64)
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for n, a in enumerate(fps):
        for b in fps[:n]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    d = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = {frozenset(signed(x) for x in fps if find(x) == c) for c in {find(f) for f in fps}}
    for light in (32, 1, 10_000):
        monkeypatch.setattr(simhash, "LIGHT", light)
        groups = defaultdict(set)
        links = components(simhash.fingerprint_links(d))
        roots = {x["node"]: x["root"] for x in links.collect()}
        for f in fps:
            groups[roots.get(signed(f), signed(f))].add(signed(f))
        assert {frozenset(g) for g in groups.values()} == want


def test_ordered_sets_rule_out_no_similar_pair():
    """Similar sets share a shingle of their beginnings whose places leave room for what they need, and their parities differ in no more bits than they do in shingles."""
    r, seen = np.random.default_rng(5), 0
    base = np.unique(r.integers(-(1 << 63), (1 << 63) - 1, 900))
    often = r.permutation(base)[:300]
    for _ in range(400):
        core = r.permutation(base)[: r.integers(1, 300)]
        sets = [np.unique(np.concatenate([core[r.random(len(core)) > x], r.integers(-(1 << 63), (1 << 63) - 1, r.integers(0, 1 + len(core) // 6))])) for x in r.random(2) * 0.15]
        sets = [x if len(x) else core for x in sets]
        a, b = sets
        both = len(np.intersect1d(a, b))
        odd = [np.frombuffer(jaccard.parities(x), np.int64) for x in sets]
        assert sum(int(x).bit_count() for x in (odd[0] ^ odd[1]).view(np.uint64)) <= len(a) + len(b) - 2 * both
        if both < 0.8 * (len(a) + len(b) - both):
            continue
        seen += 1
        p, q = (jaccard.prefix(x, often, 0.8).tolist() for x in sets)
        need = math.ceil(0.8 / 1.8 * (len(a) + len(b)) - 1e-9)
        assert any(min(len(a) - p.index(x), len(b) - q.index(x)) >= need for x in p if x in q)
    assert seen > 50


@pytest.mark.parametrize("light", [32, 2])
def test_near_copies_beyond_two_bits_go(spark, monkeypatch, light):
    """Groups by five-word Jaccard similarity against all pairs in plain Python: chains, hubs and texts just under 0.8, in small and in large buckets."""
    monkeypatch.setattr(jaccard, "LIGHT", light)
    r = random.Random(8)
    rows, n = [], 0
    for _ in range(12):
        w = [f"w{r.randrange(9999)}" for _ in range(r.choice([12, 60, 150]))]
        for _ in range(7):
            rows.append((n, " ".join(w)))
            n += 1
            w = list(w)
            for _ in range(r.choice([1, 1, 2, 4])):
                w[r.randrange(len(w))] = f"w{r.randrange(9999)}"
    rows += [(n, "one two three four five " * 12), (n + 1, "one two three four five " * 40), (n + 2, None), (n + 3, "short text")]
    sets = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set() for x in ((t or "").split() for _, t in rows)]
    root, within, far = list(range(len(rows))), [brute.simhash(t) for _, t in rows], 0

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            bits = (within[a] ^ within[b]).bit_count()
            alike = bool(sets[a] & sets[b]) and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
            far += alike and bits > 2
            if bits <= 2 or alike:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert far > 10
    d = spark.createDataFrame([(i, t, "a") for i, t in rows], EMPTY_OK)
    left = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, d, "")
    assert sorted(x["doc_id"] for x in left.collect()) == sorted({find(a) for a in range(len(rows))})


def test_components_of_a_long_chain(spark):
    d = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    assert {r["root"] for r in components(d).collect()} == {0}


def test_sharding(docs, none):
    got = vector_shards(docs, 4).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in CASES), key=repr)
    for s in range(4):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert vector_shards(none, 4).collect() == []


def test_shards_are_even_and_groups_whole(spark):
    r = random.Random(9)
    texts = [prose(r.randrange(5, 60)) for _ in range(3000)] + ["hot " * 40] * 1500
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = vector_shards(d, 16).collect()
    size, where = Counter(), defaultdict(set)
    for x in got:
        size[x["shard"]] += x["size"]
        where[texts[x["doc_id"]]].add(x["shard"])
    assert max(size.values()) < 1.03 * min(size.values())
    assert all(len(v) == 1 for t, v in where.items() if t != "hot " * 40) and len(where["hot " * 40]) > 4


def _poisson(u: float, mean: float) -> int:
    k, p = 0, math.exp(-mean)
    c = p
    while u > c:
        k += 1
        p *= mean / k
        c += p
    return k


def test_mixing(docs, none):
    got = mix_sources(docs.select("doc_id", "text", "source", "copy"))
    size = Counter()
    for _, t, s in CASES:
        size[s or ""] += len((t or "").encode()) + 1
    z = sum(round(b**0.5, 6) for b in size.values())
    u = lambda x: (int(hashlib.md5(x.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    want = []
    for i, t, s in CASES:
        mean = round(size[s or ""] ** 0.5, 6) / z * sum(size.values()) / size[s or ""]
        n = _poisson(u("mix" if i is None else f"mix:{i}"), mean)
        want += [(i, t, s, n, c + 1) for c in range(n)]
    rows = got.collect()
    assert sorted(((r["doc_id"], r["text"], r["source"], r["n_copies"], r["copy"]) for r in rows), key=repr) == sorted(want, key=repr)
    assert [r["shuffle_key"] for r in rows] == sorted(r["shuffle_key"] for r in rows)
    assert mix_sources(none).collect() == []


def test_mixing_meets_its_weights(spark):
    d = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', 99) as text", "if(id % 10 = 0, 'rare', 'big') as source")
    n = {r["source"]: r["count"] for r in mix_sources(d, {"rare": 3, "big": 1}).groupBy("source").count().collect()}
    assert abs(n["rare"] / (n["rare"] + n["big"]) - 0.75) < 0.02 and abs(n["rare"] + n["big"] - 20_000) < 600
    assert mix_sources(d.limit(50), {"rare": 1}, budget=400.0).count() > 10_000  # means above one chunk


def _check_packing(rows, pieces_of, capacity):
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for s in seqs.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= capacity
    assert {k: sorted(v) for k, v in docs.items()} == pieces_of
    return len(seqs)


def _pieces(cases, capacity):
    ids_for, out = ids_of(queries.tokenizer_path()), defaultdict(list)
    for i, t in cases:
        ids = np.append(ids_for.exact.encode(t or "", add_special_tokens=False).ids, 0).astype("<u4")
        at, n = 0, 0
        first = (len(ids) - 1) % capacity + 1
        while at < len(ids):
            end = first if n == 0 else at + capacity
            out[i].append((n, at, end - at, zlib.crc32(ids[at:end].tobytes())))
            at, n = end, n + 1
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, none, capacity):
    rows = packing.pack(docs, queries.tokenizer_path(), capacity).collect()
    n = _check_packing(rows, _pieces([(i, t) for i, t, _ in CASES], capacity), capacity)
    assert n <= 1.1 * -(-sum(r["length"] for r in rows) // capacity) + 1
    assert packing.pack(none, queries.tokenizer_path()).collect() == []


def _decreasing(lengths, capacity):
    """Sequences of best-fit decreasing, a document at a time."""
    gaps: list[int] = []
    for x in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((fit or capacity) - x)
    return len(gaps)


@pytest.mark.parametrize("rows", [200_000, 40])
def test_best_fit_in_one_range_and_in_many(spark, monkeypatch, rows):
    """One range is best-fit decreasing; rounds over many ranges come close, whatever the lengths."""
    monkeypatch.setattr(packing, "ROWS", rows)
    r = random.Random(2)
    lengths = {"mixed": [r.choice([1, 1, 3, 9, 30, r.randrange(1, 64), 64]) for _ in range(400)], "middling": [r.randrange(9, 28) for _ in range(300)]}
    for x in lengths.values():
        d = spark.createDataFrame(list(enumerate(x)), "doc_id long, length long").withColumn("sequence_id", F.lit("mine"))
        seqs = defaultdict(list)
        out = packing.best_fit(d, 64).collect()
        for row in out:
            seqs[row["sequence_id"]].append((row["offset"], row["length"]))
        for v in seqs.values():
            end = 0
            for at, n in sorted(v):
                assert at == end
                end += n
            assert end <= 64
        assert sorted(row["doc_id"] for row in out) == list(range(len(x)))
        best = _decreasing(x, 64)
        assert len(seqs) == best if rows > len(x) else len(seqs) <= 1.05 * best + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(1, 50)), max_size=8), st.integers(0, 100))
def test_range_matches_are_by_rank(parts, changed):
    """Every document that is matched has a gap of its own, in a range before it and large enough for all that it holds."""
    high = 100
    docs, gaps, least_of = [], [], {}
    for p, (n_docs, n_gaps, step) in enumerate(parts):
        low = max(1, high - step)
        if n_docs:
            docs.append((p, n_docs, low, high, n_docs * high))
        if n_gaps:
            gaps.append((p, n_gaps, low))
            least_of[p] = low
        high = low
    room, met = Counter(), Counter()
    most = {x[0]: x[3] for x in docs}
    for m in packing.match_ranges(docs, gaps, 100, changed):
        met[m.docs] += m.end - m.first
        assert m.first < m.end <= {x[0]: x[1] for x in docs}[m.docs]
        if m.gaps >= 0:
            assert m.gaps < m.docs and m.each * most[m.docs] <= max(least_of[m.gaps], most[m.docs]) and most[m.docs] <= least_of[m.gaps]
            for k in range(m.at, m.at + -(-(m.end - m.first) // m.each)):
                assert (m.gaps, k) not in room
                room[m.gaps, k] += 1
    assert all(met[p] <= n for p, n, *_ in docs)
    assert not docs or met or changed >= docs[0][3]


def test_ids_are_those_of_the_library():
    ids_for = ids_of(queries.tokenizer_path())
    for _, t, _ in CASES:
        assert ids_for(t or "").tolist() == ids_for.exact.encode(t or "", add_special_tokens=False).ids
    assert ids_for("a<|endoftext|>b").tolist() == ids_for.exact.encode("a<|endoftext|>b", add_special_tokens=False).ids


BASE = [
    ("mail a.b+c@mail-1.example.com, and x@y", [(5, 29, "email")]), ("1.2.3.4 999.1.1.1 256.0.0.1 10.0.0.255.7", [(0, 7, "ip"), (28, 38, "ip")]),
    ("4111 1111 1111 1111 and 4111111111111112", [(0, 19, "card")]), ("call +1 (415) 555-2671 or +12", [(5, 22, "phone")]), ("a@b@c.de", [(2, 8, "email")]), ("", []),
    ("0" * 5000 + ".1.1.1", [(0, 5006, "ip")]), ("9" * 5000 + ".1.1.1 " + "1" * 6000, []),
]


@pytest.mark.parametrize(("text", "want"), BASE)
def test_base_spans(text, want):
    assert pii_rules.base_spans(text) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="a1.@-+_ \n(é", max_size=40))
def test_base_spans_are_the_plain_patterns(text):
    re = brute.re
    want = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    want += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii_rules.luhn(d)]
    want += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    assert pii_rules.base_spans(text) == sorted(want, key=lambda s: (s[0], pii_rules.KINDS.index(s[2])))


def test_gradients():
    m = bilstm_crf.Tagger()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    ids, tags = bilstm_crf.examples(3)
    ids, tags = ids[:, 20:30], tags[:, 20:30]
    _, g = m.loss_and_grads(ids, tags)
    for k, v in m.p.items():
        flat, j = v.reshape(-1), int(np.argmax(abs(g[k].reshape(-1))))
        keep, two = flat[j], []
        for e in (1e-4, -1e-4):
            flat[j] = keep + e
            two.append(m.loss_and_grads(ids, tags)[0])
        flat[j] = keep
        assert abs((two[0] - two[1]) / 2e-4 - g[k].reshape(-1)[j]) < 1e-2 * max(1, abs(g[k].reshape(-1)[j]))


def test_tagger_on_held_out_windows():
    m = bilstm_crf.Tagger()
    m.p = bilstm_crf.trained()[0]
    ids, tags = bilstm_crf.examples(300, seed=99)
    got = m.decode(ids)
    assert ((got == tags) & (tags > 0)).sum() / (tags > 0).sum() > 0.85
    assert ((got == tags) & (got > 0)).sum() / (got > 0).sum() > 0.85


def test_pii(spark, docs, none):
    hidden = "write to ered (at) mail dot com"
    d = spark.createDataFrame([(n, "the water of stone " * 9 + t) for n, (t, _) in enumerate(BASE)] + [(90, None), (91, "Version 2.0. of the license"), (92, hidden), (93, "4465758382889437 4465758382889437")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in find_pii(d).collect()}
    assert [tuple(s) for s in got[92]["spans"]] == [(9, len(hidden), "email")] and got[92]["base"] == []
    assert got[93]["spans"] == got[93]["base"] == []  # both fail the Luhn test
    for n, (t, want) in enumerate(BASE):
        shift = len("the water of stone " * 9)
        assert [(s["start"] - shift, s["end"] - shift, s["kind"]) for s in got[n]["base"]] == (want if t else [])
        assert {tuple(s) for s in got[n]["base"]} <= {tuple(s) for s in got[n]["spans"]}
    assert got[90]["spans"] == [] and got[91]["spans"] == []
    assert find_pii(docs).count() == len(CASES) and find_pii(none).collect() == []


def test_pii_spans_are_those_of_all_windows():
    """Anchors lose nothing: other cases, other digits, spans longer than a window, and text before a span."""
    model = bilstm_crf.Tagger()
    model.p = bilstm_crf.trained()[0]
    r = random.Random(4)
    hard = ["JOHN (AT) MAIL (DOT) COM", "erta[At]mailco.org", "lich {at} mail.de", "١٩٢.١٦٨.١٠.٢٥", "a" * 130 + "@mail.com", "er.ou@mail.com", "1.2.3.4", "555-123-4567", "4111 1111 1111 1111", "+1 (415) 555-2671"]
    texts = [" ".join(x for _ in range(6) for x in (prose(r.randrange(1, 40)), r.choice(hard))) for _ in range(60)] + hard
    for t, got in zip(texts, pii._model_spans(model, texts), strict=True):
        starts = list(range(0, len(t), bilstm_crf.STRIDE))
        ids = np.zeros((len(starts), bilstm_crf.WINDOW), np.int64)
        for i, s in enumerate(starts):
            c = bilstm_crf.char_ids(t[s : s + bilstm_crf.WINDOW])
            ids[i, : len(c)] = c
        every = bilstm_crf.reconciled(len(t), starts, model.decode(ids))
        sound = lambda spans, t=t: [x for x in (pii._sound(t, s) for s in spans) if x]
        assert sound(got) == sound(every)
    for t in hard[:3]:
        assert pii._ANCHOR.search(t) and pii._sound(t, (0, len(t), "email")) == (0, len(t), "email")


def test_recall_of_disguised_forms():
    """Held-out disguised forms of all kinds in running text, and look-alikes that are none."""
    model = bilstm_crf.Tagger()
    model.p = bilstm_crf.trained()[0]
    forms, r = bilstm_crf.Forms(77), random.Random(77)
    some = lambda: " ".join(forms.word() for _ in range(r.randrange(5, 40)))
    texts, want = [], []
    for n in range(400):
        kind = pii_rules.KINDS[n % 4]
        before, item = some() + " ", forms.item(kind, True)
        texts.append(f"{before}{item} {some()}")
        want.append((len(before), len(before) + len(item), kind))
    spans = lambda t, found: pii._merge(pii_rules.base_spans(t), [x for x in (pii._sound(t, s) for s in found) if x])
    hit = Counter()
    for t, w, found in zip(texts, want, pii._model_spans(model, texts), strict=True):
        hit[w[2]] += w in spans(t, found)
    assert min(hit.values()) >= 85 and sum(hit.values()) >= 0.9 * 400
    none = [f"{some()} {forms.other()} {some()}" for _ in range(300)]
    assert sum(len(spans(t, f)) - len(pii_rules.base_spans(t)) for t, f in zip(none, pii._model_spans(model, none), strict=True)) <= 3


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.data())
def test_reconciling_windows(length, data):
    """Each position has the tag of its most central window (a tag wins over O where both are as central); runs of a kind are spans."""
    starts = list(range(0, length, bilstm_crf.STRIDE))
    r = random.Random(data.draw(st.integers(0, 10**6)))
    rows = np.array([[r.choice([0, 0, 1, 2, 2, 3, 4]) for _ in range(bilstm_crf.WINDOW)] for _ in starts])
    tags = []
    for p in range(length):
        seen = sorted((abs(p - s - bilstm_crf.WINDOW // 2), rows[k][p - s] == 0, k) for k, s in enumerate(starts) if s <= p < s + bilstm_crf.WINDOW)
        tags.append(bilstm_crf.TAGS[rows[seen[0][2]][p - starts[seen[0][2]]]])
    want, p = [], 0
    while p < length:
        if tags[p] == "O":
            p += 1
            continue
        e = p + 1
        while e < length and tags[e] == "I" + tags[p][1:]:
            e += 1
        want.append((p, e, tags[p][2:]))
        p = e
    assert bilstm_crf.reconciled(length, starts, rows) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6), st.sampled_from(pii_rules.KINDS)), max_size=6), st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6), st.sampled_from(pii_rules.KINDS)), max_size=6))
def test_merge_keeps_base_spans(base, more):
    base, more = ([(a, a + n, k) for a, n, k in x] for x in (base, more))
    got = pii._merge(base, more)
    apart = [m for m in more if not any(set(range(m[0], m[1])) & set(range(a, b)) for a, b, _ in base)]
    assert sorted(got) == sorted(base + apart) and got == sorted(got, key=lambda s: (s[0], pii_rules.KINDS.index(s[2])))


def test_viterbi_restores():
    text = ("the idiot and the moron said that this was a stupid thing in the garden of the old man " * 50).lower()
    codes = noisy_channel._codes(" " + text)
    total = np.zeros(noisy_channel.CODES**3)
    np.add.at(total, (codes[:-2] * noisy_channel.CODES + codes[1:-1]) * noisy_channel.CODES + codes[2:], 1)
    total = total.reshape([noisy_channel.CODES] * 3) + 0.1
    lm = np.log(total / total.sum(axis=2, keepdims=True)).astype(np.float32)
    for noisy, clean in (("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("i d i o t", "idiot"), ("$tup1d", "stupid")):
        assert noisy_channel.restore(noisy, lm) == clean
    assert noisy_channel.plain("garden,", lm) == "garden" and noisy_channel.plain("2024", lm) == "2024"
    assert noisy_channel.plain("stu" + 70 * "u" + "pid", lm) == "stupid"
    assert noisy_channel.plain("_".join("stupid") + "_" + ".".join("the idiot and the moron and the idiot".replace(" ", "")), lm).startswith("stupid")
    assert len(noisy_channel.plain("s_" * 20_000, lm)) > 10_000
    assert noisy_channel.plain("$tup!d", lm) == "stupid"
    assert noisy_channel.ambiguous("@$$") and not noisy_channel.ambiguous("2024") and not noisy_channel.ambiguous("plain")


@pytest.mark.skipif(not os.path.exists(oracle.SF), reason="no driver tables here")
def test_toxicity_on_held_out_rows(spark, docs, none):
    sf = "/root/testdata/sf0.1"
    d = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    rank, y = d["score"].rank(), d["toxic"]
    assert (rank[y == 1].mean() - (y.sum() + 1) / 2) / (len(y) - y.sum()) > 0.93
    assert d[d["predicted"] == 1]["toxic"].mean() > 0.85
    labels = spark.createDataFrame([(8, 1), (9, 0), (None, 1)], "doc_id long, toxic int")
    hot = docs.unionByName(spark.range(3000).selectExpr("8L as doc_id", "concat('row ', id) as text", "'z' as source"), allowMissingColumns=True)
    clash = labels.unionByName(spark.createDataFrame([(8, 0), (8, 1), (777_777, 1)], "doc_id long, toxic int"))
    one = toxicity.toxicity_scores(hot, clash, sample=2).orderBy("doc_id", "score").collect()
    assert one == toxicity.toxicity_scores(hot.repartition(5), clash.repartition(2), sample=2).orderBy("doc_id", "score").collect()
    got = toxicity.toxicity_scores(docs, labels)
    assert got.count() == len(CASES) and got.filter("score between 0 and 1").count() == len(CASES)
    assert toxicity.toxicity_scores(none, labels).collect() == []


@pytest.mark.skipif(not os.path.exists(oracle.SF), reason="no driver tables here")
def test_quality_model_agrees_with_marks(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    d = queries.op10_quality_model(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (d["kept"] == (d["quality"] == 1)).mean() > 0.95
    hot = docs.unionByName(spark.createDataFrame([SAME] * 2000, EMPTY_OK), allowMissingColumns=True)
    assert quality_scores(hot, sample=4).count() == len(CASES) + 2000
    assert quality_scores(docs).count() == len(CASES) and quality_scores(none).collect() == []


def test_pipeline_stages(spark, docs):
    """Each stage on its own input, in plain Python; the packing of what the mixing leaves is checked as such."""
    d = docs.withColumn("n_chars", F.lit(1).cast("long")).filter("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    take = lambda x: {r["doc_id"]: r for r in x.collect()}
    q = stage["quality_rules"](spark, d, "")
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(d).collect()}
    assert q.columns == d.columns and set(take(q)) == {i for i, k in verdict.items() if k}
    own = [(r["doc_id"], r["text"]) for r in d.collect()]
    ln = take(stage["line_dedup"](spark, d, ""))
    want = brute.lines(own)
    assert {i: hashlib.sha256(r["text"].encode()).hexdigest() for i, r in ln.items()} == {i: w[2] for i, w in want.items()}
    assert all(r["n_chars"] == len(r["text"]) and r["kept"] == "mine kept" for r in ln.values())
    near = take(stage["simhash_near_dedup"](spark, d, ""))
    assert set(near) == {c for _, c in brute.linked(own).values()}
    mixed = stage["source_mixing"](spark, d, "")
    assert mixed.columns == d.columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter(r["doc_id"] for r in mix_sources(d).collect())
    packed = stage["best_fit_packing"](spark, d, "").collect()
    _check_packing(packed, _pieces(own, 2048), 2048)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents with null and repeated ids, null and empty texts, a repeated row and an extra column; and their labels."""
    at = str(tmp_path_factory.mktemp("tables"))
    d = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    rows = [(None, prose(80), "en", "web", 1), (5, prose(90), "en", "web", 1), (6, None, "en", None, 0), (900_001, "", "en", "web", 0), (900_002, prose(70), "en", "books", 1), (900_002, prose(70), "en", "books", 1)]
    same = (900_003, prose(75), "de", "web", 1)
    d = d.unionByName(spark.createDataFrame([*rows, same, same], "doc_id long, text string, lang string, source string, n_chars long")).withColumn("votes", F.lit("mine"))
    d.write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{oracle.SF}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at, [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.mark.skipif(not os.path.exists(oracle.SF), reason="no driver tables here")
def test_pipeline_end_to_end(spark, folder):
    """run() against plain Python, stage by stage, null and repeated ids left in: the pieces of what the last stage gets, packed by the contract."""
    at, rows = folder
    rows = [r for r, k in zip(rows, brute.good([t for _, t, _ in rows]), strict=True) if k]
    rows = [(i, x, s) for (i, _, s), x in zip(rows, brute.kept_lines([r[:2] for r in rows]), strict=True)]
    rows = [r for r, k in zip(rows, brute.near_copies([r[:2] for r in rows]), strict=True) if k]
    rows = [r for r, n in zip(rows, brute.mixed(rows), strict=True) for _ in range(n)]
    assert rows
    got = corpus_pipeline.run(spark, at).collect()
    _check_packing(got, _pieces([r[:2] for r in rows], 2048), 2048)


@pytest.mark.skipif(not os.path.exists(oracle.SF), reason="no driver tables here")
def test_every_query_by_its_contract(spark, folder):
    """The registered queries' digests on a table with null and repeated ids, against plain Python."""
    at, rows = folder
    table = lambda name, *cols: sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in queries.queries()[name](spark, at).collect()), key=repr)
    want = lambda f: sorted(((i, *f(i, t)) for i, t, _ in rows), key=repr)
    data = lambda t: (t or "").encode()
    assert table("op1_vector_sharding", "size", "text_crc32", "law", "grown_shard") == want(lambda i, t: (len(data(t)) + 1, zlib.crc32(data(t)), "bytes", None))
    placed = defaultdict(list)
    where = defaultdict(set)
    for r in queries.op1_vector_sharding(spark, at).collect():
        placed[r["shard"]].append(r["slot"])
        where[r["text_crc32"]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in placed.values()) and set(placed) <= set(range(16)) and all(len(v) == 1 for v in where.values())
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = dict(zip(((i, t) for i, t, _ in rows), brute.good([t for _, t, _ in rows]), strict=True))
    assert table("op2_quality_rules", *cols, "kept") == want(lambda i, t: (*(brute.base(t)[c] for c in cols), kept[i, t]))
    fps = {(i, t): f"{brute.simhash(t):016x}" for i, t, _ in rows}
    assert table("op6_simhash_pivots", "fingerprint") == want(lambda i, t: (fps[i, t],))
    assert table("op7_line_dedup", "n_lines") == want(lambda i, t: (len((t or "").split("\n")),))
    left = brute.kept_lines([r[:2] for r in rows])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert table("op7_line_dedup", "kept_sha256") == sorted(((i, sha(x)) for (i, _, _), x in zip(rows, left, strict=True)), key=repr)
    digest = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
    base = lambda t: pii_rules.base_spans(t or "")
    assert table("op8_pii", *[f"n_{k}" for k in pii_rules.KINDS], "base_sha256") == want(lambda i, t: (*(sum(s[2] == k for s in base(t)) for k in pii_rules.KINDS), sha(digest(base(t)))))
    for r in queries.op8_pii(spark, at).collect():
        assert {x for x in [digest([s]) for t in [t for i, t, _ in rows if i == r["doc_id"] and sha(digest(base(t))) == r["base_sha256"]][:1] for s in base(t)]} <= set(r["spans"].split(","))
    _check_packing(queries.op9_best_fit_packing(spark, at).collect(), _pieces([r[:2] for r in rows], 2048), 2048)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    assert table("op5_toxicity", "held_out") == want(lambda i, t: (held(i),))
    for r in queries.op5_toxicity(spark, at).collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    assert [r[0] for r in table("op10_quality_model")] == sorted((i for i, _, _ in rows), key=lambda i: repr((i,)))


@pytest.mark.skipif(not os.path.exists(oracle.SF), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_same_rows(name, spark):
    oracle.agree(queries.queries()[name], oracles.oracle_sql()[name], spark)
