"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, and decoding of windows."""

from __future__ import annotations

import functools
import random

import numpy as np

from .pii_rules import KINDS, Span, luhn

#: Character classes: each printable ASCII letter in lower case, each digit as one, each sign; 0 for padding, 1 for others, 2 for other letters.
_SIGNS = " \n\t.,;:!?@%+-_()[]{}<>/\\'\"#*$&|=~"
TAGS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
HIDDEN, WINDOW, STRIDE = 16, 96, 48
_ID = {c: 3 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" + _SIGNS)} | {d: 3 + 26 + len(_SIGNS) for d in "0123456789"}
CHARS = 3 + 26 + len(_SIGNS) + 1
_T = len(TAGS)


def char_ids(text: str) -> np.ndarray:
    return np.array([_ID.get(c) or _ID.get(c.lower()) or (2 if c.isalpha() else _ID["0"] if c.isdigit() else 1) for c in text], np.int64)


#: One tanh serves all gates: sigmoid(z) = (1 + tanh(z / 2)) / 2 for the first three.
_HALF = np.r_[np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN)].astype(np.float32)


class Tagger:
    """Parameters: x[2, CHARS, 4H] (what a character adds to the gates), h[2, H, 4H], out[2H, T], bias[T], trans[T, T]; direction 1 reads backwards."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "x": r.normal(0, 0.2, (2, CHARS, 4 * HIDDEN)), "h": r.normal(0, 0.2, (2, HIDDEN, 4 * HIDDEN)),
            "out": r.normal(0, 0.2, (2 * HIDDEN, _T)), "bias": np.zeros(_T), "trans": np.zeros((_T, _T)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["x"][:, :, HIDDEN : 2 * HIDDEN] += 0.5  # the forget gate starts open

    def _run(self, ids: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """ids [n, L] -> hidden states [2, L, n, H], each direction in its own order of time."""
        both = np.stack([ids.T, ids[:, ::-1].T])  # [2, L, n]
        n, length = ids.shape
        x, h_in = self.p["x"] * _HALF, self.p["h"] * _HALF
        fed = np.stack([x[0][both[0]], x[1][both[1]]])  # [2, L, n, 4H]
        h = np.zeros((2, n, HIDDEN), fed.dtype)
        c, states, tape = h, np.empty((2, length, n, HIDDEN), fed.dtype), []
        for t in range(length):
            z = np.matmul(h, h_in)
            z += fed[:, t]
            np.tanh(z, out=z)
            s = z[..., : 3 * HIDDEN]
            s += 1
            s *= 0.5
            before, c = c, s[..., HIDDEN : 2 * HIDDEN] * c + s[..., :HIDDEN] * z[..., 3 * HIDDEN :]
            tc = np.tanh(c)
            if keep:
                tape.append((h, before, z, tc))
            h = s[..., 2 * HIDDEN :] * tc
            states[:, t] = h
        return states, tape

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """[n, L, T]."""
        s, _ = self._run(ids, False)
        e = s[0] @ self.p["out"][:HIDDEN] + s[1, ::-1] @ self.p["out"][HIDDEN:] + self.p["bias"]
        return e.transpose(1, 0, 2)

    def loss_and_grads(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the CRF, and its gradients by scaled forward-backward and back-propagation through time."""
        n, length = ids.shape
        s, tape = self._run(ids, True)
        f, b = s[0], s[1, ::-1]
        e = f @ self.p["out"][:HIDDEN] + b @ self.p["out"][HIDDEN:] + self.p["bias"]  # [L, n, T]
        tr = self.p["trans"].astype(np.float64)
        top, high = e.max(axis=2, keepdims=True).astype(np.float64), tr.max()
        ex, step = np.exp(e - top), np.exp(tr - high)
        alpha, beta, scale = np.empty((length, n, _T)), np.ones((length, n, _T)), np.empty((length, n, 1))
        now = ex[0]
        for t in range(length):
            if t:
                now = (alpha[t - 1] @ step) * ex[t]
            scale[t] = now.sum(axis=1, keepdims=True)
            alpha[t] = now / scale[t]
        back = step.T
        for t in range(length - 2, -1, -1):
            beta[t] = ((ex[t + 1] * beta[t + 1]) @ back) / scale[t + 1]
        z = (np.log(scale) + top).sum(axis=(0, 2)) + (length - 1) * high
        at = tags.T
        gold = np.take_along_axis(e, at[:, :, None], 2).sum(axis=(0, 2)) + tr[at[:-1], at[1:]].sum(axis=0)
        de = alpha * beta
        ahead = ex[1:] * beta[1:] / scale[1:]
        dtr = step * (alpha[:-1].reshape(-1, _T).T @ ahead.reshape(-1, _T))
        np.subtract.at(dtr, (at[:-1], at[1:]), 1)
        de -= np.eye(_T)[at]
        de = (de / n).astype(s.dtype)
        g = {"trans": (dtr / n).astype(s.dtype), "bias": de.sum(axis=(0, 1))}
        flat = de.reshape(-1, _T)
        g["out"] = np.concatenate([f.reshape(-1, HIDDEN).T @ flat, b.reshape(-1, HIDDEN).T @ flat])
        dh_out = np.stack([de @ self.p["out"][:HIDDEN].T, (de @ self.p["out"][HIDDEN:].T)[::-1]])
        dz = np.empty((length, 2, n, 4 * HIDDEN), s.dtype)
        dh, dc, back = 0.0, 0.0, self.p["h"].transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            _, c0, z4, tc = tape[t]
            i, fg, o, gg = (z4[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            dh = dh + dh_out[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            own = dz[t]
            own[..., :HIDDEN] = dc * gg
            own[..., HIDDEN : 2 * HIDDEN] = dc * c0
            own[..., 2 * HIDDEN : 3 * HIDDEN] = dh * tc
            own[..., 3 * HIDDEN :] = dc * i * (1 - gg * gg)
            gates = z4[..., : 3 * HIDDEN]
            own[..., : 3 * HIDDEN] *= gates * (1 - gates)
            dh, dc = np.matmul(own, back), dc * fg
        was = np.stack([x[0] for x in tape])  # [L, 2, n, H]
        both = (ids.T, ids[:, ::-1].T)
        g["x"], g["h"] = np.empty_like(self.p["x"]), np.empty_like(self.p["h"])
        for d in range(2):
            mine = dz[:, d].reshape(-1, 4 * HIDDEN)
            g["h"][d] = was[:, d].reshape(-1, HIDDEN).T @ mine
            g["x"][d] = np.eye(CHARS, dtype=s.dtype)[both[d].reshape(-1)].T @ mine
        return float((z - gold).mean()), g

    def train(self, ids: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02) -> list[float]:
        """Adam with a rate that falls to a tenth; the order of batches is fixed. Returns the mean loss of each epoch."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        rng, step, losses = np.random.default_rng(11), 0, []
        steps = epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            order, total = rng.permutation(len(ids)), 0.0
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                loss, g = self.loss_and_grads(ids[own], tags[own])
                total += loss * len(own)
                step += 1
                pace = rate * (1 - 0.9 * step / steps)
                for k, d in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v2[k] = 0.999 * v2[k] + 0.001 * d * d
                    self.p[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(total / len(order))
        return losses

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tags of each window, by Viterbi: [n, L]."""
        e = self.emissions(ids)
        n, length, _ = e.shape
        score, back = e[:, 0], np.empty((length, n, _T), np.int8)
        for t in range(1, length):
            x = score[:, :, None] + self.p["trans"]
            back[t] = x.argmax(axis=1)
            score = x.max(axis=1) + e[:, t]
        out = np.empty((n, length), np.int64)
        out[:, -1] = score.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[t, np.arange(n), out[:, t]]
        return out


_SYLLABLES = ["er", "tion", "the", "lich", "en", "que", "ado", "ment", "ra", "ou", "st", "ge", "é", "ñ", "ung", "co", "is", "mail", "ly", "au"]


class Forms:
    """A generator of invented words and of personal data in plain and disguised forms, with look-alikes that are none."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, k: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(k))

    def word(self) -> str:
        r = self.r
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randrange(1, 4))) + ("" if r.random() < 0.85 else r.choice([",", ".", "!!", "###", "***", " |"]))

    def name(self) -> str:
        return "".join(c for c in self.word() if c.isascii() and c.isalpha()) or "er"

    def email(self, disguised: bool) -> str:
        r = self.r
        at = r.choice([" @ ", " (at) ", "[at]", " [at] ", "(at)", "{at}", " at ", " AT "]) if disguised else "@"
        dot = r.choice([".", " . ", "(dot)", " dot ", "[dot]", " [dot] ", " DOT "]) if disguised else "."
        if at.strip().lower() == "at" and "." in dot:
            dot = " dot "  # "a at b.c" alone is plain prose
        local = self.name() + r.choice(["", ".", "_", "-"]) + r.choice(["", self.digits(2), self.name()])
        s = f"{local.rstrip('._-')}{at}{self.name()}{r.choice(['', self.digits(1)])}{dot}{r.choice(['com', 'org', 'net', 'de', 'example' + dot + 'com', 'co' + dot + 'uk'])}"
        return s.upper() if r.random() < 0.15 else s

    def ip(self, disguised: bool) -> str:
        sep = self.r.choice([" . ", "[.]", "(.)", " .", "[dot]", " dot "]) if disguised else "."
        return sep.join(str(self.r.randrange(256)) for _ in range(4))

    def card(self, disguised: bool) -> str:
        r, d = self.r, self.digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice([".", "_", "/", " - ", "  ", ". "] if disguised else ["", "", " ", "-"]).join(d[i : i + 4] for i in range(0, 16, 4))

    def phone(self, disguised: bool) -> str:
        a, b, c, n = self.digits(3), self.digits(3), self.digits(4), self.digits(2)
        hidden = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{n} {a} {b}{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}-{c}"]
        return self.r.choice(hidden if disguised else [f"+1 ({a}) {b}-{c}", f"+{n} {a} {b} {c}", f"+{n}{a}{b}{c}"])

    def other(self) -> str:
        d, r = self.digits, self.r
        hexa = "".join(r.choice("0123456789abcdef") for _ in range(40))
        return r.choice([f'token = "{hexa}"', f"Version {d(1)}.{d(1)}.", f"version {d(1)}", f"{d(4)}-{d(2)}-{d(2)}", f"${d(3)}.{d(2)}", f"{d(2)}%", f"CC BY-NC {d(1)}.0.", f"{d(1)}.{d(2)}.{d(1)}", f"{d(2)}:{d(2)}", d(r.randrange(1, 8)), "meet @ the", f"@{self.name()}", f"{d(2)} (at) {self.name()}", f"{self.name()} at {self.name()}", f"{self.name()} at {self.name()}.", f"{self.name()} dot {self.name()}"])

    def item(self, kind: str, disguised: bool) -> str:
        return getattr(self, kind)(disguised)


def examples(n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Labelled spans for training: windows of invented words with personal data in varied forms, two thirds of them disguised, and look-alikes without a tag."""
    forms, r = Forms(seed), random.Random(seed)
    ids, tags = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for w in range(n):
        text, spans = "", []
        while len(text) < WINDOW + 40:
            text += " ".join(forms.word() for _ in range(r.randrange(1, 6))) + r.choice([" ", " ", "\n"])
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                s = forms.item(kind, r.random() < 0.67)
                spans.append((len(text), len(text) + len(s), kind))
                text += s + r.choice([" ", " ", "!! ", "### ", ", ", ". ", " "])
            elif r.random() < 0.4:
                text += forms.other() + " "
        at = r.randrange(40)
        ids[w] = char_ids(text[at : at + WINDOW])
        for a, b, kind in spans:
            for j in range(max(a, at), min(b, at + WINDOW)):
                tags[w, j - at] = TAGS.index(("B-" if j == a else "I-") + kind)
    return ids, tags


@functools.lru_cache(maxsize=2)
def trained(n: int = 3200, epochs: int = 5) -> tuple[dict[str, np.ndarray], tuple[float, ...]]:
    """Parameters fitted on ``n`` windows of labelled spans (the documented bound), and the losses; once per process."""
    model = Tagger()
    losses = model.train(*examples(n), epochs)
    return model.p, tuple(losses)


def windows_of(length: int, anchors: np.ndarray) -> list[int]:
    """Starts of the windows (every STRIDE) over a text that hold an anchor."""
    starts = sorted({s for a in np.unique(anchors // STRIDE) for s in (int(a) * STRIDE - STRIDE, int(a) * STRIDE) if 0 <= s < length})
    return starts


def reconciled(length: int, starts: list[int], tags: np.ndarray) -> list[Span]:
    """Spans of a whole text: each position takes its tag from the window where it is most central; a run of one kind is one span, a B starts anew."""
    best: dict[int, tuple[int, int]] = {}
    for s, row in zip(starts, tags, strict=True):
        for j in np.flatnonzero(row[: length - s]):
            d = abs(int(j) - WINDOW // 2)
            best.setdefault(s + int(j), (d, int(row[j])))
    for s, row in zip(starts, tags, strict=True):  # an O nearer the middle wins as well
        for p in range(s, min(s + WINDOW, length)):
            if p in best:
                d = abs(p - s - WINDOW // 2)
                if d < best[p][0]:
                    best[p] = (d, int(row[p - s]))
    spans, open_ = [], None
    for p in sorted(best):
        tag = TAGS[best[p][1]]
        kind = tag[2:]
        if open_ and kind == open_[2] and p == open_[1] and tag[0] != "B":
            open_ = (open_[0], p + 1, kind)
            continue
        if open_:
            spans.append(open_)
        open_ = (p, p + 1, kind) if tag != "O" else None
    return spans + ([open_] if open_ else [])
