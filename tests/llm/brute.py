"""Plain Python versions of the contracts, a row at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WS = "[\x20\x09-\x0d]+"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t: str | None) -> list[str]:
    return [w for w in re.split(WS, t or "") if w]


def base(t: str | None) -> dict:
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    return out | {"base_failed": out["n_words"] < 10 or 100 * out["n_repeat_words"] > 20 * out["n_words"]}


def exact(docs: list[tuple]) -> dict:
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(WS, " ", t or "")].append(i)
    return {i: (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}


def lines(docs: list[tuple], min_chars: int = 40, min_docs: int = 5) -> dict:
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(ASCII)
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    out = {}
    for i, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == i]
        out[i] = (len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def simhash(t: str | None) -> int:
    w = words((t or "").translate(ASCII))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(docs: list[tuple], radius: int = 2) -> dict:
    fps = {i: simhash(t) for i, t in docs}
    root = {f: f for f in fps.values()}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    every = list(root)
    for n, a in enumerate(every):
        for b in every[:n]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps.items():
        r = find(f)
        least[r] = min(least.get(r, i), i)
    return {i: (f"{f:016x}", least[find(f)]) for i, f in fps.items()}


STOP = set()


def votes(t: str | None) -> tuple[int, ...]:
    """The twelve quality rules of one text, in their order."""
    import unicodedata

    from tessera.llm.quality_rules import STOPWORDS

    STOP.update(w for x in STOPWORDS for w in x.split())
    t, w, b = t or "", words(t), base(t)
    n, chars = max(1, len(w)), max(1, b["word_chars"])
    three = lambda x, bad, good: -1 if x > bad else 1 if x <= good else 0
    kind = lambda p: sum(unicodedata.category(c).startswith(p) for c in t)
    distinct = len(set(w))
    return (
        three(b["n_symbols"] / n, 0.15, 0.01), three(b["n_repeat_words"] / n, 0.2, 0.0), three(b["n_dup_lines"] / n, 0.05, 0.0),
        three(sum(x == y for x, y in zip(w, w[1:], strict=False)) / n, 0.2, 0.02),
        -1 if n >= 40 and distinct < 3.5 * n**0.5 else 1 if distinct >= 5 * n**0.5 else 0,
        three(kind("Lu") / chars, 0.3, 0.1), three(t.count("!!") / n, 0.15, 0.01), three(t.count("|") / n, 0.15, 0.01),
        -1 if not 2 <= chars / n <= 15 else 1 if chars / n <= 11 else 0,
        -1 if n >= 20 and sum(x in STOP for x in w) / n < 0.02 else 0, -1 if kind("L") / chars < 0.7 else 0, 1 if len(w) >= 50 else 0,
    )


def good(texts: list[str | None]) -> list[bool]:
    """Whether each text is kept: EM over the votes of all, and the base."""
    from tessera.llm.quality_rules import fit_votes

    every = [votes(t) for t in texts]
    post = fit_votes(list(Counter(every).items()))[2]
    return [post[v] >= 0.5 and not base(t)["base_failed"] for v, t in zip(every, texts, strict=True)]


def kept_lines(docs: list[tuple], min_chars: int = 40, min_docs: int = 5) -> list[str]:
    """The text that line dedup leaves of each row; rows that share an id (null, too) are one document."""
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(ASCII)
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    top = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= min_docs}
    return ["\n".join(x for x in (t or "").split("\n") if top.get(key(x), i) == i) for i, t in docs]


def near_copies(docs: list[tuple]) -> list[bool]:
    """Whether each row stays: groups within 2 bits of SimHash or with a five-word Jaccard similarity of 0.8 or more keep the text of the least id."""
    least = lambda i: (i is None, i or 0)
    texts = list({t or "" for _, t in docs})
    fps = [simhash(t) for t in texts]
    w = [words(t.translate(ASCII)) for t in texts]
    sets = [{tuple(x[j : j + 5]) for j in range(max(1, len(x) - 4))} if x else set() for x in w]
    root = list(range(len(texts)))

    def find(a: int) -> int:
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (fps[a] ^ fps[b]).bit_count() <= 2 or (both and 10 * both >= 8 * len(sets[a] | sets[b])):
                root[find(a)] = find(b)
    at = {t: find(n) for n, t in enumerate(texts)}
    first: dict[int, tuple] = {}
    for i, t in docs:
        r = at[t or ""]
        first[r] = min(first.get(r, least(i)), least(i))
    holders = defaultdict(set)
    for i, t in docs:
        if least(i) == first[at[t or ""]]:
            holders[at[t or ""]].add(t or "")
    # of different texts under the least id, any one may stay
    assert all(len(x) == 1 for x in holders.values())
    return [least(i) == first[at[t or ""]] for i, t in docs]


def poisson(u: float, mean: float) -> int:
    import math

    k, p = 0, math.exp(-mean)
    c = p
    while u > c:
        k += 1
        p *= mean / k
        c += p
    return k


def mixed(docs: list[tuple]) -> list[int]:
    """How often each (id, text, source) is there after mixing by the square roots of the sources' bytes."""
    size: Counter = Counter()
    for _, t, s in docs:
        size[s or ""] += len((t or "").encode()) + 1
    z = sum(round(b**0.5, 6) for b in size.values())
    u = lambda x: (int(hashlib.md5(x.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    mean = lambda s: round(size[s or ""] ** 0.5, 6) / z * sum(size.values()) / size[s or ""]
    return [poisson(u("mix" if i is None else f"mix:{i}"), mean(s)) for i, _, s in docs]
