"""Trains the trees that ``pii`` scores its proposals with.

Examples are made here, as no labelled personal data is at hand: numbers,
addresses and keys of the proposals' formats, and look-alikes (order numbers,
ISBNs, dates, versions, figures, hashes, file names), each behind a few words.
What announces a kind stands before half of the true ones and some false ones,
and is as often a word that the features do not know as one that they do. Trees
of depth 3 are boosted on the logistic loss, the margin is calibrated by Platt
scaling on held-out examples, and each kind's threshold is the lowest at which
held-out precision reaches ``PRECISION``. The figures are those of this made
world; ``tests/llm`` holds the result against sentences written by hand.

    python -m textmill.llm.pii_train    writes pii_model.json
"""

from __future__ import annotations

import json
import random
import re
from pathlib import Path

import numpy as np

from .pii import AGAINST, BEFORE, CONTEXT, FEATURES, KINDS

SEED, EXAMPLES, ROUNDS, RATE, PRECISION = 7, 36_000, 60, 0.3, 0.97

_WORDS = "the of and report was for from on with in table see value lorem area total unit sample die der la que it has been sent last week please use this now".split()
#: Announcing words: those that the context patterns know, then others.
_KNOWN = {0: ["mail me:", "contact", "e-mail", "write to"], 1: ["ip", "server", "host", "client addr"], 2: ["card", "visa", "credit card no", "pay with"], 3: ["phone:", "call", "tel.", "fax", "mobile"], 4: ["token =", "api_key:", 'secret="', "password:", "Authorization: Bearer"]}
_OTHER = {0: ["send it to", "my inbox is", "owner:"], 1: ["gateway", "blocked", "node", "peer"], 2: ["charge", "number on file", "debit"], 3: ["ring me on", "number:", "dial", "text"], 4: ["value:", "export X=", "login with", "use"]}
_NO = ["ISBN", "order", "invoice", "version", "build", "serial", "ref", "page", "doi", "sku", "date", "commit", "sha256:", "etag"]


def luhn_ok(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _made(r: random.Random, kind: int, label: int, announced: bool) -> tuple[str, int]:
    """A match of one of the kind's generators and whether it is a true one."""

    def number(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def word(least: int = 3, most: int = 8) -> str:
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(least, most)))

    if kind == 0:
        o, c = r.choice(["()", "[]", "{}", ("", "")])
        if label:
            return (f"{word()}{r.choice(['', '.' + word()])} {o}at{c} {word()} {o or ''}dot{c} {r.choice(['com', 'org', 'net', 'de'])}", 1) if not o or r.random() < 0.5 else (f"{word()}{o}at{c}{word()}.{r.choice(['com', 'org', 'io'])}", 1)
        return (f"{word()} at {word()} dot {word(1, 9)}" if not o else f"{word()} {o}at{c} {word()}. {word()}"), 0
    if kind == 1:
        groups = [f"{r.randrange(65536):x}" for _ in range(8)]
        short = ":".join(groups[: r.randint(1, 4)]) + "::" + ":".join(groups[: r.randint(1, 3)])
        if label:
            return r.choice(["[.]".join(str(r.randint(1, 255)) for _ in range(4)), ":".join(groups), short]), 1
        return r.choice([":".join(number(2) for _ in range(8)), "[.]".join(number(1) for _ in range(4)), f"{r.choice('abcdef')}::{r.choice('abcdef')}", f"{number(1)}::{number(1)}"]), 0
    if kind == 2:
        n = r.choice([13, 16])
        digits = number(n)
        while luhn_ok(digits) != (label == 1 or r.random() < 0.08):
            digits = number(n)
        return (digits if n == 13 else r.choice("._/").join(digits[i : i + 4] for i in range(0, 16, 4))), label
    if kind == 3:
        sep = r.choice("-. ")
        plain = f"{number(3)}{sep}{number(3)}{sep}{number(4)}"
        if label:
            match = r.choice([f"({number(3)}) {number(3)}-{number(4)}", plain, f"0{number(3)} {number(4)} {number(4)}"])
            return match, int("(" in match or announced)
        return r.choice([f"{number(4)}-{number(4)}-{number(4)}", f"{number(2)} {number(3)} {number(3)}", f"{number(3)} {number(4)} {number(3)}", f"{number(3)}.{number(3)}.{number(3)}", plain]), 0
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    if label:
        match = r.choice(["".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))), "".join(r.choice(mixed) for _ in range(r.randint(20, 64))), r.choice(["sk-", "ghp_", "AKIA", "xoxb-"]) + "".join(r.choice(mixed) for _ in range(r.randint(16, 40)))])
        return match, int(announced or not re.fullmatch("[0-9a-f]+", match))
    hexed = "".join(r.choice("0123456789abcdef") for _ in range(40))
    uuid = "-".join("".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12))
    return r.choice([hexed, uuid, f"{word()}/{word()}/{word()}/{number(r.randint(1, 4))}", f"{word()}-{word()}-{word()}-{number(2)}", f"{number(4)}-{number(2)}-{number(2)}_{number(6)}", number(r.randint(17, 30)), word(14, 20) + number(1), f"{word()}_{word()}_{word()}{number(1)}", "=" * 12 + number(4), f"{word()}={number(3)}/{word()}={number(2)}"]), 0


def example(r: random.Random) -> tuple[int, str, str, int]:
    """kind, text before, match, label."""
    kind, label = r.randrange(len(KINDS)), int(r.random() < 0.5)
    announced = r.random() < (0.5 if label else 0.06)
    denied = not announced and r.random() < (0.03 if label else 0.45)
    match, true = _made(r, kind, label, announced)
    before = " ".join(r.choice(_WORDS) for _ in range(5)) + " "
    if announced:
        said = r.choice((_KNOWN if r.random() < 0.6 else _OTHER)[kind])
        before += said + ("" if said.endswith(('"', "=")) else " ") + (r.choice(["is ", "of mine: ", ""]) if kind != 4 else r.choice(["", '"']))
    elif denied:
        before += r.choice(_NO) + " "
    return kind, before[-BEFORE:], match, true


def vector(kind: int, before: str, match: str) -> list[float]:
    digits = re.sub(r"[^0-9]", "", match)
    flags = (13 <= len(digits) <= 19 and luhn_ok(digits), re.search(r"[(\[{<]", match), re.search(CONTEXT[kind], before), re.search(AGAINST, before), len(set(digits)) <= 1)
    more = len(re.sub("[^A-Z]", "", match)), len(re.findall("[0-9]+", match)), float(bool(re.search(r"[=:]\s*[\"'`]?$", before)))
    return [kind, len(match), len(digits), len(re.sub(r"[A-Za-z0-9]", "", match)), len(re.findall(r"[A-Za-z0-9]+", match)), *map(float, map(bool, flags)), *more]


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
    best = (0.0, -1, 0.0)
    total = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        for at in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25), method="lower")):
            low = x[:, f] <= at
            if 20 <= low.sum() <= len(x) - 20:
                gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - total
                if gain > best[0]:
                    best = (gain, f, float(at))
    return best


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> dict | float:
    gain, f, at = _split(x, g, h) if depth and len(x) > 40 else (0.0, -1, 0.0)
    if f < 0 or gain < 1e-6:
        return round(float(-RATE * g.sum() / (h.sum() + 1)), 6)
    low = x[:, f] <= at
    return {"feature": FEATURES[f], "at": at + 0.5, "low": _tree(x[low], g[low], h[low], depth - 1), "high": _tree(x[~low], g[~low], h[~low], depth - 1)}


def _leaf(tree: dict | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, dict):
        return np.full(len(x), tree)
    return np.where(x[:, FEATURES.index(tree["feature"])] <= tree["at"], _leaf(tree["low"], x), _leaf(tree["high"], x))


def train() -> dict:
    r = random.Random(SEED)
    made = [example(r) for _ in range(EXAMPLES)]
    x = np.array([vector(k, b, m) for k, b, m, _ in made])
    y = np.array([label for *_, label in made], dtype=float)
    fit, held = slice(0, EXAMPLES * 2 // 3), slice(EXAMPLES * 2 // 3, None)
    start = float(np.log(y[fit].mean() / (1 - y[fit].mean())))
    margin, trees = np.full(EXAMPLES, start), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin[fit]))
        trees.append(_tree(x[fit], p - y[fit], p * (1 - p), 3))
        margin = margin + _leaf(trees[-1], x)
    slope, shift = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(slope * margin[held] + shift)))
        slope -= 0.5 * float(((p - y[held]) * margin[held]).mean())
        shift -= 0.5 * float((p - y[held]).mean())
    p = 1 / (1 + np.exp(-(slope * margin + shift)))
    thresholds = {}
    for k, name in enumerate(KINDS):
        own = np.zeros(EXAMPLES, bool)
        own[held] = x[held][:, 0] == k
        cuts = [t for t in np.linspace(0.05, 0.99, 95) if (picked := own & (p >= t)).any() and y[picked].mean() >= PRECISION]
        thresholds[name] = round(float(min(cuts)), 4) if cuts else 1.1
        picked = own & (p >= thresholds[name])
        print(name, "threshold", thresholds[name], "precision", round(float(y[picked].mean()), 3) if picked.any() else None, "recall", round(float((picked & (y == 1)).sum() / max(1, (own & (y == 1)).sum())), 3))
    return {"start": round(start, 6), "slope": round(slope, 6), "shift": round(shift, 6), "thresholds": thresholds, "trees": trees}


if __name__ == "__main__":
    Path(__file__).with_name("pii_model.json").write_text(json.dumps(train(), separators=(",", ":")) + "\n")
