"""Secret scans: fixed patterns plus a character convolutional network over every candidate.

A candidate is a run of 16 or more key characters; spans that a fixed pattern covers are cut out
of runs, and each piece of that length is one. The network alone decides on it. It reads a window of the candidate's characters and of the text on
both sides; a mask tells them apart. A candidate longer than the window is judged by several, the highest score counts. It is trained in numpy on labelled findings (generated
from a seed: keys of many alphabets and lengths in assignments, headers, URLs and prose
against words, identifiers, paths, versions, numbers, dates, addresses and slugs). One held-out
part of the findings calibrates the scores (Platt), another sets the threshold: the highest one
whose recall is at least ``MIN_RECALL`` with 95% confidence, given the misses there.

Texts are scanned whole; offsets are code points. Null and empty texts have no findings.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "network")
_run = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
LEAST = 16
#: A run between separators, and one with those that keys may hold.
_parts = (re.compile("[A-Za-z0-9]{16,}"), re.compile("[A-Za-z0-9+_-]{16,}"))

LEFT, BODY, RIGHT = 24, 40, 12
WIDTH = LEFT + BODY + RIGHT
#: Characters between the windows over a long candidate; windows scored at once.
STEP, AT_ONCE = 20, 8192
MIN_RECALL = 0.98
N_FINDINGS, SEED = 8000, 11

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns that pass their length tests."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Runs that the network judges, or what is left of them beside spans already found."""
    covered = sorted((s, e) for _, s, e in taken)
    # the furthest end of the spans so far, so that bisection finds the first one that reaches into a run
    ends = list(itertools.accumulate((e for _, e in covered), max))
    out = []
    for m in _run.finditer(text):
        at, end = m.span()
        k = bisect.bisect_right(ends, at)
        while k < len(covered) and covered[k][0] < end:
            if covered[k][0] - at >= LEAST:
                out.append((at, covered[k][0]))
            at = max(at, covered[k][1])
            k += 1
        if end - at >= LEAST:
            out.append((at, end))
    return out


def window(text: str, start: int, end: int) -> str:
    """The characters that the network sees of a span; the middle of a long one is left out, absent ones are NUL."""
    body = text[start:end]
    if len(body) > BODY:
        body = body[: BODY - 12] + body[-12:]
    return text[max(0, start - LEFT) : start].rjust(LEFT, "\0") + body.ljust(BODY, "\0") + text[end : end + RIGHT].ljust(RIGHT, "\0")


def views(text: str, start: int, end: int) -> list[str]:
    """The windows that judge a candidate: one of a short candidate; of a long one, its head with its
    tail, and overlapping windows over the whole of it and over its parts between separators."""
    if end - start <= BODY:
        return [window(text, start, end)]
    out = {(start, end)}
    for s, e in [(start, end), *(m.span() for part in _parts for m in part.finditer(text, start, end))]:
        out.update((k, k + BODY) for k in range(s, e - BODY, STEP))
        out.add((max(s, e - BODY), e))
    return [window(text, s, e) for s, e in sorted(out)]


def codes(windows: list[str]) -> np.ndarray:
    """Character codes: ASCII as it is, letters beyond it as 1, the candidate's own shifted by 128."""
    wide = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(len(windows), WIDTH)
    out = np.where(wide < 128, wide, 1).astype(np.int64)
    out[:, LEFT : LEFT + BODY] += 128
    return out


@dataclass
class CharNetwork:
    """Embedding, one convolution with max pooling, a hidden layer; then Platt's slope and offset and the threshold."""

    embed: np.ndarray
    kernel: np.ndarray
    kernel_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def _forward(self, x: np.ndarray):
        reach = self.kernel.shape[0] // self.embed.shape[1]
        embedded = self.embed[x]
        patches = np.lib.stride_tricks.sliding_window_view(embedded, reach, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - reach + 1, -1)
        response = patches @ self.kernel + self.kernel_bias
        at = response.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0, :], 0)
        inner = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        return patches, at, pooled, inner, inner @ self.out + self.out_bias

    def probability(self, windows: list[str], batch: int = 512) -> np.ndarray:
        """Calibrated probability that each window's candidate is a secret."""
        logits = [self._forward(codes(windows[i : i + batch]))[4] for i in range(0, len(windows), batch)]
        return 1 / (1 + np.exp(-np.clip(self.slope * np.concatenate(logits) + self.offset, -30, 30))) if logits else np.zeros(0)


def train(windows: list[str], labels: np.ndarray, *, filters: int = 24, dims: int = 8, reach: int = 5, units: int = 16, epochs: int = 6, batch: int = 64, seed: int = SEED, min_recall: float = MIN_RECALL) -> CharNetwork:
    """Fit a network by Adam on four fifths of the findings; a tenth calibrates it, another sets its threshold."""
    rng = np.random.default_rng(seed)
    net = CharNetwork(rng.normal(0, 0.3, (256, dims)), rng.normal(0, 0.2, (reach * dims, filters)), np.zeros(filters), rng.normal(0, 0.3, (filters, units)), np.zeros(units), rng.normal(0, 0.3, units), 0.0)
    x, y = codes(windows), labels.astype(float)
    order = rng.permutation(len(y))
    fitted, held, rest = order[: len(y) // 10], order[len(y) // 10 : len(y) // 5], order[len(y) // 5 :]
    names = ("embed", "kernel", "kernel_bias", "hidden", "hidden_bias", "out", "out_bias")
    mean = {n: np.zeros_like(np.asarray(getattr(net, n))) for n in names}
    square = {n: np.zeros_like(np.asarray(getattr(net, n))) for n in names}
    step = 0
    for _ in range(epochs):
        rng.shuffle(rest)
        for i in range(0, len(rest), batch):
            rows = rest[i : i + batch]
            patches, at, pooled, inner, logit = net._forward(x[rows])
            d_logit = (1 / (1 + np.exp(-logit)) - y[rows]) / len(rows)
            d_inner = np.outer(d_logit, net.out) * (inner > 0)
            d_pooled = (d_inner @ net.hidden.T) * (pooled > 0)
            b, f = np.arange(len(rows))[:, None], np.arange(filters)[None, :]
            chosen = patches[b, at]  # rows, filters, patch
            d_kernel = np.einsum("bf,bfp->pf", d_pooled, chosen)
            d_patch = (d_pooled[:, :, None] * net.kernel.T[None]).reshape(len(rows), filters, reach, dims)
            d_embed = np.zeros_like(net.embed)
            for k in range(reach):
                np.add.at(d_embed, x[rows][b, at + k], d_patch[:, :, k])
            grads = {"embed": d_embed, "kernel": d_kernel, "kernel_bias": d_pooled.sum(0), "hidden": pooled.T @ d_inner, "hidden_bias": d_inner.sum(0), "out": inner.T @ d_logit, "out_bias": d_logit.sum()}
            step += 1
            for n, g in grads.items():
                mean[n] = 0.9 * mean[n] + 0.1 * g
                square[n] = 0.999 * square[n] + 0.001 * np.square(g)
                setattr(net, n, getattr(net, n) - 0.005 * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.999**step)) + 1e-8))
    net.slope, net.offset = _platt(net._forward(x[fitted])[4], y[fitted])
    scores = np.sort(net.probability([windows[i] for i in held if labels[i]]))
    allowed = (1 - min_recall) * len(scores)
    net.threshold = float(scores[max(0, int(allowed - 1.64 * (allowed * min_recall) ** 0.5))])
    return net


def _platt(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge logistic fit with smoothed targets, by damped Newton steps."""
    hits, misses = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (hits + 1) / (hits + 2), 1 / (misses + 2))
    design, start = np.stack([logits, np.ones_like(logits)], 1), np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float(np.sum(np.logaddexp(0, z) - target * z) + 0.5 * np.sum((w - start) ** 2))

    w = start
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        move = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.eye(2), design.T @ (p - target) + (w - start))
        scale = next((k for k in 0.5 ** np.arange(12) if loss(w - k * move) < loss(w)), 0.0)
        w = w - scale * move
    return float(w[0]), float(w[1])


def findings(n: int = N_FINDINGS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Labelled findings: windows and whether each holds a secret."""
    rnd = random.Random(seed)
    syllables = "the ing er on an re th en ver schaft tion cion mente eau oux keit ung für ño al st in ou ha nd be ge zu sch ch tz pf lich heit ein ach au ll qu gn rr str thr ght wh sh ly ble ed es si ra to pre mi lo cu dad ción age ure ette isch ig bar stadt bund fach werk".split()
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "-_"]
    letters = [string.ascii_letters, string.ascii_uppercase, string.ascii_lowercase]

    def word(low: int = 1, high: int = 4) -> str:
        return "".join(rnd.choice(syllables) for _ in range(rnd.randint(low, high)))

    def prose(k: int) -> str:
        return " ".join(rnd.choice([word().capitalize(), word(), word() + rnd.choice(".,;")]) for _ in range(k))

    def secret() -> tuple[str, str, str]:
        kind = rnd.randrange(5)
        alphabet = rnd.choice(letters if rnd.random() < 0.15 else alphabets)
        key = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(18, 64)))
        if kind == 0:
            key = rnd.choice(["ghp_", "gho_", "sk-", "sk_live_", "pk_live_", "xoxb-", "glpat-", "npm_", "AIza", "SG.", "hf_"]) + key
        if kind == 1:
            key = "eyJ" + key + ".eyJ" + "".join(rnd.choice(alphabets[4]) for _ in range(30)) + "." + "".join(rnd.choice(alphabets[4]) for _ in range(20))
        if rnd.random() < 0.15:
            key += "=" * rnd.randint(1, 2)
        lead, tail = rnd.choice([("key = \"", '"'), ("Authorization: Bearer ", ""), ("export ACCESS_KEY=", "\n"), ("--auth ", " "), ("credential: '", "'"), ("", ""), ("client_id: ", ","), ("https://u:", "@host"), ("", ".")])
        return lead, key, tail

    def harmless() -> tuple[str, str, str]:
        kind = rnd.randrange(14)
        if kind == 0:
            body = "".join(word() for _ in range(6))
        elif kind in (12, 13):
            body = "".join(word() for _ in range(6))[: rnd.randint(16, 30)] + rnd.choice(["", "", ".", "..."])
            body = rnd.choice([body, body.capitalize(), body.upper()])
        elif kind == 1:
            body = "_".join(word() for _ in range(rnd.randint(3, 6))) + rnd.choice(["", str(rnd.randint(1, 99))])
        elif kind == 2:
            body = word() + "".join(word().capitalize() for _ in range(rnd.randint(3, 6))) + rnd.choice(["", "2", "V1"])
        elif kind == 3:
            body = "/".join(word() for _ in range(rnd.randint(3, 7))) + rnd.choice([".html", ".py", f"/{rnd.randint(1, 9999)}", ".mp3"])
        elif kind == 4:
            body = f"{rnd.randint(1990, 2030)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}T{rnd.randint(0, 23):02}-{rnd.randint(0, 59):02}-{rnd.randint(0, 59):02}"
        elif kind == 5:
            body = ".".join(str(rnd.randint(0, 255)) for _ in range(rnd.randint(4, 7))).ljust(16, "0")
        elif kind == 6:
            body = f"{word()}.{rnd.randint(1, 99)}" + "-" + f"mail{rnd.randint(1, 9)}.{word()}.example.com"
        elif kind == 7:
            body = "-".join(word() for _ in range(rnd.randint(3, 7))) + f"-{rnd.randint(1, 9999)}"
        elif kind == 8:
            body = rnd.choice("-=_.") * rnd.randint(16, 40) + str(rnd.randint(0, 9))
        elif kind == 9:
            body = f"{word()}.{word()}.{word()}({rnd.randint(0, 9)}".replace("(", ".") + word() + word()
        elif kind == 10:
            body = f"www.{word()}.example.{rnd.choice(['org', 'net'])}/{word()}/{rnd.randint(1, 999)}"
        else:
            body = f"v{rnd.randint(0, 9)}.{rnd.randint(0, 30)}.{rnd.randint(0, 30)}-{rnd.choice(['alpha', 'beta', 'rc'])}.{rnd.randint(1, 9)}-{word()}"
        lead, tail = rnd.choice([("", ""), ("", ","), ("", "."), ("(", ")"), ("see ", " "), ("file: ", "\n"), ("https://", " "), ("name = \"", '"'), ("<a href=\"", '">')])
        return lead, body.ljust(16, "e"), tail

    windows, labels = [], []
    for k in range(n):
        lead, body, tail = secret() if k % 2 else harmless()
        before, after = prose(rnd.randint(0, 4)), prose(rnd.randint(0, 3))
        text = f"{before}{rnd.choice([' ', chr(10), ''])}{lead}"
        windows.append(window(f"{text}{body}{tail} {after}", len(text), len(text) + len(body)))
        labels.append(k % 2)
    return windows, np.array(labels)


@cache
def default_network() -> CharNetwork:
    """The network over the default findings; fits in seconds and is the same on every run."""
    return train(*findings())


def joined(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def _all_spans(texts: list[str], net: CharNetwork) -> tuple[list[list[Span]], list[list[Span]]]:
    base = [base_spans(t) for t in texts]
    found = [(k, s, e) for k, t in enumerate(texts) for s, e in candidates(t, base[k])]
    scores = np.zeros(len(found))
    for part in itertools.batched(((i, w) for i, (k, s, e) in enumerate(found) for w in views(texts[k], s, e)), AT_ONCE):
        at, windows = zip(*part)
        np.maximum.at(scores, np.array(at), net.probability(list(windows)))
    added: list[list[Span]] = [[] for _ in texts]
    for (k, s, e), p in zip(found, scores):
        if p >= net.threshold:
            added[k].append(("network", s, e))
    return base, added


def scan(docs: DataFrame, net: CharNetwork | None = None) -> DataFrame:
    """doc_id, counts of the base kinds and of network findings, base_sha256 and all spans of each row of ``docs``.

    Repeated rows repeat; null ids pass; other columns are not read.
    """
    net = net or default_network()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = _all_spans([t or "" for t in batch.column(1).to_pylist()], net)
            counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in KINDS[:3]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()), pa.array([joined(b + a) for b, a in zip(base, added)], pa.string()), pa.array([len(a) for a in added], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_network long")


def redact(docs: DataFrame, net: CharNetwork | None = None, *, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; overlapping spans share one mark.

    All rows and columns stay; n_chars, where it exists, follows the new text. A null text stays null.
    """
    net = net or default_network()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            base, added = _all_spans([t or "" for t in texts], net)
            for k, text in enumerate(texts):
                at, parts = 0, []
                for _, start, end in sorted(base[k] + added[k], key=lambda s: (s[1], s[2])):
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                if at:
                    texts[k] = "".join([*parts, text[at:]])
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(run, docs.schema)
