"""Personal data in texts: spans of a character-level bidirectional LSTM with CRF transitions, beside plain patterns.

The model is trained in numpy on labelled spans of a bounded sample (``PER_KIND`` windows of each combination of
kinds, drawn from all texts by a hash): what the patterns find, and the same rewritten in ways that the patterns do
not know, among decoys such as dates. Every kind holds a digit or an @, so the tagger reads the stretches that reach
``CONTEXT`` characters beyond each of these; all other characters are outside by definition. A stretch is cut into
windows that overlap by half. The scores of overlapping windows are averaged, weighted by the distance from the
window's edge, and one path over the whole stretch is decoded, so a window's edge cuts no span.

The patterns' spans always stay. The model's are added if they are sure, touch none of these and hold what their
kind needs (``plausible``).
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import as_bytes

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
CONTEXT = 32
WINDOW = 64
PER_KIND = 250
SURE = 0.9
SEED = 12

Span = tuple[int, int, int]  # start, kind, end

# --- patterns ---------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that begins no address is passed over whole: no address begins further inside it.
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]+")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @, domain: the local part is the run before an @ behind the last match."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def is_luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _is_card(digits: str) -> bool:
    return 12 <= len(digits) <= 19 and is_luhn(digits)


def _are_octets(parts: Sequence[str]) -> bool:
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in parts))


def matches(text: str) -> tuple[list[Span], bool]:
    """The patterns' spans by start and kind, and whether a match was dropped that only its digits tell from a span."""
    if not _TRIGGER.search(text):
        return [], False
    found, dropped = [(a, EMAIL, b) for a, b in _emails(text)], False

    def take(pattern: re.Pattern, kind: int, good: Callable[[str], bool]) -> None:
        nonlocal dropped
        for m in pattern.finditer(text):
            if kind == IP and m[1] is None:
                continue
            if good(m[0]):
                found.append((m.start(), kind, m.end()))
            else:
                dropped |= kind == IP or kind == CARD and 12 <= len(_NO_DIGIT.sub("", m[0])) <= 19

    take(_IP, IP, lambda s: _are_octets(s.split(".")))
    take(_CARD, CARD, lambda s: _is_card(_NO_DIGIT.sub("", s)))
    if "+" in text:
        take(_PHONE, PHONE, lambda s: 9 <= len(_NO_DIGIT.sub("", s)) <= 15)
    return sorted(found), dropped


def plausible(kind: int, said: str) -> bool:
    """Whether a span holds what its kind needs, in whatever form it is written."""
    digits = _NO_DIGIT.sub("", said)
    if kind == EMAIL:
        local, at, domain = said.partition("@")
        return bool(at) and any(c.isalnum() for c in local) and "." in domain.strip(" .") and "@" not in domain
    if kind == IP:
        return _are_octets(re.findall("[0-9]+", said)) and not re.search("[A-Za-z]", said)
    if kind == CARD:
        return _is_card(digits) and not re.search("[A-Za-z]", said)
    return 9 <= len(digits) <= 15 and len(said) <= 3 * len(digits) and not re.search("[A-Za-z@]", said)


# --- the tagger -------------------------------------------------------------------------------------------------

# Tags: 0 outside, 2k + 1 first and 2k + 2 further character of kind k.
TAGS = 1 + 2 * len(KINDS)
# Letters by themselves whatever their case, all digits alike, other ASCII by itself, then two classes for the rest.
_CLASSES = np.arange(128)
_CLASSES[ord("0") : ord("9") + 1] = ord("0")
_CLASSES[ord("A") : ord("Z") + 1] += 32
LETTER, OTHER, N_CLASSES = 128, 129, 130


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    beyond = np.where((points >= 0xC0) & (points < 0x250), LETTER, OTHER)
    return np.where(points < 128, _CLASSES[np.minimum(points, 127)], beyond)


def tags_of(length: int, spans: Sequence[Span]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for start, kind, end in spans:
        out[start:end] = 2 * kind + 2
        out[start] = 2 * kind + 1
    return out


def _allowed() -> np.ndarray:
    """Which tag may follow which: the further characters of a kind only its first or further ones."""
    allowed = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        allowed[:, 2 * k + 2] = False
        allowed[2 * k + 1 : 2 * k + 3, 2 * k + 2] = True
    return allowed


ALLOWED = _allowed()
FIRST = np.array([t == 0 or t % 2 == 1 for t in range(TAGS)])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def padded(rows: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), max(1, lengths.max(initial=0))), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, lengths


class Tagger:
    """Plain arrays, so that it goes along with the tasks. Both directions run as one batch of two."""

    def __init__(self, hidden: int = 20, seed: int = SEED):
        rng, self.hidden = np.random.default_rng(seed), hidden
        bias = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.weights = {
            "seen": rng.normal(0, 0.3, (2, N_CLASSES, 4 * hidden)) + bias,
            "kept": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden)),
            "out": rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, TAGS)),
            "bias": np.zeros(TAGS),
            "follow": np.zeros((TAGS, TAGS)),
            "first": np.zeros(TAGS),
        }
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    # Scores of the tags, with what the way back needs.

    def _run(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, dict]:
        n, t = ids.shape
        place = np.arange(t)[None, :]
        back = np.where(place < lengths[:, None], lengths[:, None] - 1 - place, place)
        both = np.stack([ids, np.take_along_axis(ids, back, 1)])
        w, size = self.weights, self.hidden
        seen = np.stack([w["seen"][d][both[d]] for d in (0, 1)])
        kept = w["kept"]
        gates = np.zeros((t, 2, n, 3 * size), seen.dtype)
        new, cells, shown, states = (np.zeros((t, 2, n, size), seen.dtype) for _ in range(4))
        h = c = np.zeros((2, n, size), seen.dtype)
        for i in range(t):
            z = seen[:, :, i] + h @ kept
            gates[i] = s = _sigmoid(z[..., : 3 * size])
            new[i] = g = np.tanh(z[..., 3 * size :])
            cells[i] = c = s[..., size : 2 * size] * c + s[..., :size] * g
            shown[i] = u = np.tanh(c)
            states[i] = h = s[..., 2 * size :] * u
        ahead = states[:, 0].transpose(1, 0, 2)
        behind = np.take_along_axis(states[:, 1].transpose(1, 0, 2), back[:, :, None], 1)
        features = np.concatenate([ahead, behind], axis=2)
        scores = features @ w["out"] + w["bias"]
        return scores, {"both": both, "back": back, "gates": gates, "new": new, "cells": cells, "shown": shown, "states": states, "features": features}

    def scores(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self._run(ids, lengths)[0]

    def _transitions(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        return np.where(ALLOWED, np.exp(w["follow"]), 0), np.where(FIRST, np.exp(w["first"]), 0)

    def forward_backward(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log of the sum over all paths, share of the paths with each tag at each place, expected transitions."""
        n, t, _ = scores.shape
        follow, first = self._transitions()
        top = scores.max(axis=2, keepdims=True)
        lively = np.exp((scores - top).astype(np.float64))
        inside = np.arange(t)[None, :] < lengths[:, None]
        a, scale = np.zeros((t, n, TAGS)), np.ones((t, n))
        for i in range(t):
            now = (first if i == 0 else a[i - 1] @ follow) * lively[:, i]
            total = now.sum(axis=1)
            a[i] = np.where(inside[:, i, None], now / total[:, None], a[i - 1] if i else 1 / TAGS)
            scale[i] = np.where(inside[:, i], total, 1)
        log_total = np.log(scale).sum(axis=0) + np.where(inside, top[:, :, 0], 0).sum(axis=1)
        shares, b = np.zeros((n, t, TAGS)), np.ones((n, TAGS))
        expected = np.zeros((TAGS, TAGS))
        for i in range(t - 1, -1, -1):
            shares[:, i] = np.where(inside[:, i, None], a[i] * b, 0)
            if i:
                ahead = np.where(inside[:, i, None], lively[:, i] * b / scale[i][:, None], 0)
                expected += (a[i - 1].T @ ahead) * follow
                b = np.where(inside[:, i, None], ahead @ follow.T, b)
        return log_total, shares, expected

    def loss(self, ids: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log probability of the tags, and its slope by every weight."""
        scores, kept = self._run(ids, lengths)
        n, t, _ = scores.shape
        log_total, shares, expected = self.forward_backward(scores, lengths)
        inside = np.arange(t)[None, :] < lengths[:, None]
        gold = np.eye(TAGS)[tags] * inside[:, :, None]
        follows = inside[:, 1:]
        own = (gold * scores).sum(axis=(1, 2)) + self.weights["first"][tags[:, 0]]
        own = own + (self.weights["follow"][tags[:, :-1], tags[:, 1:]] * follows).sum(axis=1)
        seen = np.zeros((TAGS, TAGS))
        np.add.at(seen, (tags[:, :-1][follows], tags[:, 1:][follows]), 1)
        slopes = {"follow": (expected - seen) / n, "first": (shares[:, 0] - gold[:, 0]).sum(axis=0) / n}
        slopes |= self._back(((shares - gold) / n).astype(scores.dtype), kept)
        return float((log_total - own).mean()), slopes

    def _back(self, slope: np.ndarray, kept: dict) -> dict[str, np.ndarray]:
        w, size = self.weights, self.hidden
        n, t, _ = slope.shape
        flat = slope.reshape(n * t, TAGS)
        out = {"out": kept["features"].reshape(n * t, -1).T @ flat, "bias": flat.sum(axis=0)}
        features = slope @ w["out"].T
        behind = np.take_along_axis(features[:, :, size:], kept["back"][:, :, None], 1)
        into = np.stack([features[:, :, :size], behind])  # 2, n, t, size
        dz = np.zeros((t, 2, n, 4 * size), slope.dtype)
        dh, dc = np.zeros((2, n, size), slope.dtype), np.zeros((2, n, size), slope.dtype)
        turned = w["kept"].transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            s, g, u = kept["gates"][i], kept["new"][i], kept["shown"][i]
            enter, stay, show = s[..., :size], s[..., size : 2 * size], s[..., 2 * size :]
            dh = dh + into[:, :, i]
            dc = dc + dh * show * (1 - u * u)
            before = kept["cells"][i - 1] if i else np.zeros_like(dc)
            dz[i, ..., :size] = dc * g * enter * (1 - enter)
            dz[i, ..., size : 2 * size] = dc * before * stay * (1 - stay)
            dz[i, ..., 2 * size : 3 * size] = dh * u * show * (1 - show)
            dz[i, ..., 3 * size :] = dc * enter * (1 - g * g)
            dc = dc * stay
            dh = dz[i] @ turned
        states = np.concatenate([np.zeros_like(kept["states"][:1]), kept["states"][:-1]])
        out["kept"] = np.einsum("tdnh,tdng->dhg", states, dz, optimize=True)
        seen = np.zeros_like(w["seen"])
        for d in (0, 1):
            ids = kept["both"][d].T.reshape(-1)
            order = np.argsort(ids, kind="stable")
            starts = np.flatnonzero(np.diff(ids[order], prepend=-1))
            seen[d][ids[order][starts]] = np.add.reduceat(dz[:, d].reshape(t * n, -1)[order], starts, axis=0)
        return out | {"seen": seen}

    def train(self, rows: Sequence[tuple[str, Sequence[Span]]], epochs: int, batch: int = 64, seed: int = SEED) -> list[float]:
        """Adam over mini-batches of windows of about one length; the mean loss of each epoch."""
        rng, step, told = np.random.default_rng(seed), 0, []
        ids, tags = [classes(t) for t, _ in rows], [tags_of(len(t), s) for t, s in rows]
        sizes = np.array([len(i) for i in ids])
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        for epoch in range(epochs):
            order = np.argsort(sizes + rng.uniform(0, 8, len(sizes)), kind="stable")
            parts = [order[i : i + batch] for i in range(0, len(order), batch)]
            rate, losses = (0.02, 0.02, 0.01, 0.003)[min(3, 4 * epoch // epochs)], []
            for part in rng.permutation(len(parts)).tolist():
                x, lengths = padded([ids[i] for i in parts[part]])
                y, _ = padded([tags[i] for i in parts[part]])
                loss, slopes = self.loss(x, lengths, y)
                losses.append(loss)
                norm = np.sqrt(sum(float((g * g).sum()) for g in slopes.values()))
                step += 1
                for k, g in slopes.items():
                    g = g * min(1.0, 5 / max(norm, 1e-9))
                    m, s = moments[k]
                    m[:], s[:] = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
                    self.weights[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            told.append(float(np.mean(losses)))
        return told

    # Spans of stretches.

    def stretch_scores(self, ids: Sequence[np.ndarray], at_once: int = 256) -> list[np.ndarray]:
        """Scores of each place, from all windows over it."""
        half = WINDOW // 2
        windows = [(i, a) for i, s in enumerate(ids) for a in range(0, max(1, len(s) - half), half)]
        sums = [np.zeros((len(s), TAGS), np.float32) for s in ids]
        weights = [np.zeros((len(s), 1), np.float32) for s in ids]
        for first in range(0, len(windows), at_once):
            some = windows[first : first + at_once]
            x, lengths = padded([ids[i][a : a + WINDOW] for i, a in some])
            scores = self.scores(x, lengths)
            for row, (i, a), length in zip(scores, some, lengths.tolist()):
                place = np.arange(length)
                # The edge of the stretch is no edge of the window.
                left = place + 1 if a else np.full(length, WINDOW)
                right = length - place if a + length < len(ids[i]) else np.full(length, WINDOW)
                near = np.minimum(left, right).astype(np.float32)[:, None]
                sums[i][a : a + length] += near * row[:length]
                weights[i][a : a + length] += near
        return [s / np.maximum(w, 1e-9) for s, w in zip(sums, weights)]

    def best_paths(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n, t, _ = scores.shape
        w = self.weights
        follow, first = np.where(ALLOWED, w["follow"], -1e9), np.where(FIRST, w["first"], -1e9)
        come = np.zeros((t, n, TAGS), np.int8)
        best = first + scores[:, 0]
        for i in range(1, t):
            ways = best[:, :, None] + follow
            come[i] = ways.argmax(axis=1)
            further = np.take_along_axis(ways, come[i][:, None, :].astype(np.int64), 1)[:, 0] + scores[:, i]
            best = np.where((i < lengths)[:, None], further, best)
        path, now = np.zeros((n, t), np.int64), best.argmax(axis=1)
        for i in range(t - 1, -1, -1):
            path[:, i] = now
            if i:
                now = np.where(i < lengths, come[i][np.arange(n), now], now)
        return path

    def tag(self, texts: Sequence[str], area: int = 1 << 17) -> list[list[tuple[Span, float]]]:
        """The spans of each stretch and how sure they are: the mean share of the paths that agree along the span."""
        ids = [classes(t) for t in texts]
        order, out = sorted(range(len(ids)), key=lambda i: len(ids[i])), [[] for _ in texts]
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(ids[order[end]]) <= area:
                end += 1
            rows = order[at:end]
            own = self.stretch_scores([ids[i] for i in rows])
            lengths = np.array([len(s) for s in own])
            scores = np.zeros((len(rows), max(1, lengths.max()), TAGS), np.float32)
            for i, s in enumerate(own):
                scores[i, : len(s)] = s
            paths = self.best_paths(scores, lengths)
            marked = np.flatnonzero((paths * (np.arange(scores.shape[1]) < lengths[:, None])).any(axis=1))
            if len(marked):
                _, shares, _ = self.forward_backward(scores[marked], lengths[marked])
                for row, share in zip(marked.tolist(), shares):
                    out[rows[row]] = _spans(paths[row][: lengths[row]], share)
            at = end
        return out


def _spans(path: np.ndarray, share: np.ndarray) -> list[tuple[Span, float]]:
    tags, out, at = path.tolist(), [], 0
    while at < len(tags):
        if tags[at] == 0:
            at += 1
            continue
        end = at + 1
        while end < len(tags) and tags[end] and tags[end] % 2 == 0:
            end += 1
        sure = float(share[np.arange(at, end), path[at:end]].mean())
        out.append(((at, (tags[at] - 1) // 2, end), sure))
        at = end
    return out


def stretches_of(text: str) -> list[tuple[int, int]]:
    """The parts that reach CONTEXT characters beyond each digit and @, joined where they meet."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        start, end = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


# --- labelled windows -------------------------------------------------------------------------------------------


def _rewritten(kind: int, said: str, rng: random.Random) -> str:
    """The same in a form that the patterns miss."""
    digits = _NO_DIGIT.sub("", said)
    if kind == EMAIL:
        local, _, domain = said.partition("@")
        return rng.choice([f"{local} @ {domain}", f"{local}@ {domain}", f"{local} @{domain}", f"{local}@{domain.replace('.', ' . ')}"])
    if kind == IP:
        return rng.choice([". ", " .", " . ", ", "]).join(said.split("."))
    if kind == CARD:
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return rng.choice([".", "  ", " - ", "/", "_"]).join(fours)
    country, area, first, last = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
    local = rng.choice([f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"({area}){first} {last}"])
    return rng.choice(["", "", f"00{country} ", f"{country or 1}-", f"{country or 1} "]) + local


def _decoy(rng: random.Random) -> str:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice(
        [
            f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)} 1{d(1)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}",
            f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.19{d(2)}",
            f"version {d(1)}.{d(2)}.{d(1)}",
            f"v{d(1)}.{d(1)}.{d(2)}-rc{d(1)}",
            f"{d(2)},{d(3)},{d(3)}.{d(2)}",
            f"{d(3)} {d(3)} {d(2)}",
            f"{d(4)}-{d(4)}",
            f"ISBN 978-{d(1)}-{d(3)}-{d(5)}-{d(1)}",
            f"#{d(7)}",
            f"@{''.join(rng.choice('abcdefghij') for _ in range(7))}",
            f"{d(2)}:{d(2)} @ {d(2)}",
            f"{rng.getrandbits(128):032x}",
            f"{d(rng.randint(3, 24))}",
        ]
    )


def _replaced(text: str, spans: Sequence[Span], put: Callable[[int, str], tuple[str, bool]]) -> tuple[str, list[Span]]:
    """The text with each span said otherwise, and where the spans that stay spans are then."""
    out, at, found = "", 0, []
    for start, kind, end in spans:
        said, stays = put(kind, text[start:end])
        out += text[at:start]
        if stays:
            found.append((len(out), kind, len(out) + len(said)))
        out += said
        at = end
    return out + text[at:], found


def examples(windows: Sequence[str], seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Labelled rows of windows: as they are, with their spans rewritten, and with decoys in place of the spans; then
    rows of spans side by side.

    Windows in which the patterns dropped a match, or in which spans overlap, are left out.
    """
    rng, rows, pool = random.Random(seed), [], []
    for window in windows:
        spans, dropped = matches(window)
        if dropped or any(b[0] < a[2] for a, b in zip(spans, spans[1:])):
            continue
        rows.append((window, spans))
        if spans:
            pool += [(k, window[a:b]) for a, k, b in spans]
            for _ in range(2):
                rows.append(_replaced(window, spans, lambda k, s: (_rewritten(k, s, rng), True)))
            decoyed = _replaced(window, spans, lambda k, s: (_decoy(rng), False))
            if not matches(decoyed[0])[0]:
                rows.append(decoyed)
    for _ in range(len(pool) // 6):
        row, glue, found = "", rng.choice([" ", ", ", "\n", "; "]), []
        for kind, said in rng.choices(pool, k=4):
            found.append((len(row), kind, len(row) + len(said)))
            row += said + glue
        rows.append((row, found))
    return rows


def _kinds_in(spans: Sequence[Span]) -> str:
    return "".join(sorted({str(k) for _, k, _ in spans}))


def sample_windows(docs: DataFrame, per_kind: int = PER_KIND, text: str = "text") -> list[str]:
    """Windows around digits and @ of all texts: of each combination of kinds the first by a hash, per_kind at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for content in as_bytes(batch.column("text")):
                said = content.decode()
                for start, end in stretches_of(said):
                    for a in range(start, end, 2 * WINDOW):
                        window = said[a : min(end, a + WINDOW + CONTEXT)]
                        rows.add((window, _kinds_in(matches(window)[0])))
            if rows:
                windows, kinds = zip(*sorted(rows))
                yield pa.RecordBatch.from_arrays([pa.array(windows, pa.string()), pa.array(kinds, pa.string())], ["w", "kinds"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "w string, kinds string").distinct()
    place = F.row_number().over(W.partitionBy("kinds").orderBy(F.xxhash64("w"), "w"))
    # At most per_kind windows for each set of kinds, of which there are sixteen.
    return sorted(r["w"] for r in rows.withColumn("place", place).filter(F.col("place") <= per_kind).collect())


def train(docs: DataFrame, per_kind: int = PER_KIND, epochs: int = 8, text: str = "text") -> Tagger | None:
    """A tagger from the labelled spans of a sample; None if the sample holds no span. NULL texts are empty."""
    rows = examples(sample_windows(docs, per_kind, text))
    if not any(spans for _, spans in rows):
        return None
    tagger = Tagger()
    tagger.train(rows, epochs)
    return tagger


# --- all texts --------------------------------------------------------------------------------------------------

_SPANS = "array<struct<kind: string, start: bigint, end: bigint, base: boolean, sure: double>>"


def found_in(texts: Sequence[str], tagger: Tagger | None) -> list[list[tuple[Span, bool, float]]]:
    """For each text the patterns' spans and those that the tagger adds, by start and kind."""
    base = [matches(t)[0] for t in texts]
    out = [[(s, True, 1.0) for s in spans] for spans in base]
    if tagger is not None:
        parts = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches_of(t)]
        for (i, at, end), spans in zip(parts, tagger.tag([texts[i][a:b] for i, a, b in parts])):
            near = [s for s in base[i] if s[0] < end and s[2] > at]
            for (start, kind, stop), sure in spans:
                start, stop = start + at, stop + at
                while start < stop and texts[i][start] in " \t\n\r.,;:":
                    start += 1
                while start < stop and texts[i][stop - 1] in " \t\n\r.,;:":
                    stop -= 1
                apart = all(stop <= a or start >= b for a, _, b in near)
                if sure >= SURE and apart and plausible(kind, texts[i][start:stop]):
                    out[i].append(((start, kind, stop), False, sure))
    return [sorted(spans) for spans in out]


def find(docs: DataFrame, tagger: Tagger | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans): one row for each document, with all its spans by start and kind; end is exclusive.

    Places are code points. A NULL text is empty and has no spans; an id may be NULL or repeat. Without a tagger
    there are the patterns' spans alone. Other columns are not read.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL(f"spans {_SPANS}").fields])
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("sure", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                rows = batch.slice(first, 1000)
                found = found_in([t.decode() for t in as_bytes(rows.column("text"))], tagger)
                told = [[dict(zip(("kind", "start", "end", "base", "sure"), (KINDS[k], a, b, base, sure))) for (a, k, b), base, sure in spans] for spans in found]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(told, pa.list_(pa.struct(fields)))], ["doc_id", "spans"])

    return slim.mapInArrow(run, schema)


def told(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of the patterns' spans of each kind, their digest, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])

    def of(kind: str) -> Callable[[Column], Column]:
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
