"""Personal data: high-recall span candidates, gradient-boosted trees on their format and context, calibrated thresholds.

The base kinds (email, ip, card, phone) are fixed patterns with checks and are always
reported.  Generators propose further, overlapping spans: phone numbers without a plus,
identity numbers in groups, bank accounts, e-mail addresses written out, addresses of
version 6 ('::' forms too), hardware addresses, dates of birth.  Boosted trees score each
candidate from its shape and its surroundings; a candidate is redacted when its calibrated
probability reaches its kind's threshold and it does not touch a base span or a better
candidate.

The trees are trained here, on candidates in lines that a seeded generator writes
(TRAIN_LINES of them, a documented bound).  Six tenths of the candidates grow the trees, two
calibrate their scores, and on the last two the thresholds are set: the smallest that give
the asked precision.

Defined cases: a null text counts as empty and has no spans; offsets are code points,
end exclusive; repeated rows are judged alike; a null doc_id is reported as null; of
candidates that overlap with equal probability the first kind listed, then the leftmost,
stays; very long texts are scanned in linear time; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("phone_local", "id_number", "iban", "email_words", "ipv6", "mac", "birth_date")
KINDS = BASE_KINDS + MORE_KINDS
TRAIN_LINES = 6000
PRECISION = 0.98

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, found from each @ so that long runs cost linear time."""
    out, done, at = [], 0, t.find("@")
    while at >= 0:
        s = at
        while s > done and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = t.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def ips(t: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(t) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]


def cards(t: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 16 and 16 <= len(d := "".join(_DIGITS.findall(m[0]))) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(t: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(t) if 8 <= len(_DIGITS.findall(m[0])) <= 15]


def base_spans(t: str) -> dict[str, list[tuple[int, int]]]:
    at, digit = "@" in t, bool(_DIGITS.search(t))
    return {"email": emails(t) if at else [], "ip": ips(t) if digit else [], "card": cards(t) if digit else [], "phone": phones(t) if digit and "+" in t else []}


#: Domains that make a plain "x at y.com" or "x at y dot com" an address; without one brackets are asked for, as prose has "x at y. Z".
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "uk", "de", "fr", "es", "it", "nl", "ch", "at")

#: High recall on purpose; each pattern is linear.
_MORE = (
    ("phone_local", re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])"), True),
    ("id_number", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"), True),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"), True),
    ("email_words", re.compile(r"(?<![A-Za-z0-9._])[A-Za-z0-9._]{1,64}(?: ?(?:\(at\)|\[at\]) ?[A-Za-z0-9]{1,63} ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z]{2,6}| at [A-Za-z0-9]{1,63}(?: ?(?:\(dot\)|\[dot\]) ?[A-Za-z]{2,6}|(?: dot |\.)(?:" + "|".join(TOP_LEVEL) + r")))(?![A-Za-z])"), False),
    ("ipv6", re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{3,39}(?![0-9A-Za-z:])"), True),
    ("mac", re.compile(r"(?<![0-9A-Za-z:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Za-z:-])"), True),
    ("birth_date", re.compile(r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{4}|[0-9]{2})|[0-9]{1,2}\.? (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6}\.? [0-9]{4})(?![0-9A-Za-z])", re.I), True),
)
_CUES = re.compile(r"(?:phone|call|tel|mobile|fax|ssn|social|security|iban|account|bank|mail|contact|reach|write|mac|device|host|address|born|birth|dob|server|node|geboren|geb\.|naci|n[eé]e? le|telefon|konto|cuenta|compte)|(?<![^\W\d_])b\.", re.I)
_ANTI = re.compile(r"(?:order|part|version|isbn|ratio|score|page|chapter|serial|build|ticket|item|total|price|meet|look|laugh|time)", re.I)


def candidates(t: str) -> list[tuple[str, int, int]]:
    digit = bool(_DIGITS.search(t))
    words = " at " in t or "(at)" in t or "[at]" in t
    found = [(k, *m.span()) for k, p, needs in _MORE if (digit if needs else words) for m in p.finditer(t)]
    return [c for c in found if c[0] != "ipv6" or _is_v6(t[c[1] : c[2]])]


def _is_v6(x: str) -> bool:
    try:
        return ipaddress.ip_address(x).version == 6 and len(x) > 3
    except ValueError:
        return x.count(":") >= 5  # a look-alike, for the trees to turn down


def mod97(x: str) -> int:
    """The remainder that is 1 for an account number whose check digits are right."""
    x = x.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


_NEAR_WORD = re.compile(r"[^\W\d_]+")


def near_words(t: str, s: int) -> list[str]:
    """The last three words of the 40 characters before a candidate."""
    return _NEAR_WORD.findall(t[max(0, s - 40) : s].lower())[-3:]


def features(t: str, kind: str, s: int, e: int, lean: dict[str, float]) -> list[float]:
    """Format and context of a candidate; lean: learnt log-odds of words before it."""
    x, before, after = t[s:e], t[max(0, s - 40) : s], t[e : e + 24]
    digits = [c for c in x if c.isdigit()]
    n = len(x)
    return [
        MORE_KINDS.index(kind), n, len(digits) / n, len(set(digits)), sum(c in " " for c in x), sum(c in ".-:" for c in x),
        "(" in x, "[" in x, sum(c.isupper() for c in x) / n, bool(_CUES.search(before)), bool(_ANTI.search(before)),
        bool(_CUES.search(after)), before[-1:].isspace() or s == 0, after[:1].isspace() or not after, before[-2:-1] in ":#=",
        digits[:1] == ["0"], len(re.findall(r"[0-9]", before[-12:])), len(re.findall(r"[0-9]", after[:12])), "dot" in x, x.count(":"), "::" in x, x.isascii() and x[:2].isdigit() and "19" <= x[:2] <= "20", len(re.findall(r"[A-Za-z]", x)), sum(lean.get(w, 0.0) for w in near_words(t, s)), kind == "iban" and mod97(x) == 1,
        kind == "email_words" and x.rsplit("dot", 1)[-1].rsplit(".", 1)[-1].strip(" )]").lower() in TOP_LEVEL, kind == "email_words" and any(c in x for c in "([_0123456789"), kind == "email_words" and "." in x.split(" at ")[0],
        sum(lean.get(w, 0.0) for w in _NEAR_WORD.findall(x.lower())) if kind == "email_words" else 0.0,
    ]


class Boosted:
    """Gradient boosting of small trees for log loss on binned features; plain arrays, a few kilobytes."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 16, leaf: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.leaf = rounds, depth, rate, bins, leaf
        self.trees: list[list[tuple[int, float, float]]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            self._grow(tree, 0, 0, np.arange(len(y)), x, y - q, q * (1 - q), cuts)
            self.trees.append(tree)
            f += self._one(tree, x)
        return self

    def _grow(self, tree, node, level, rows, x, g, h, cuts) -> None:
        value = self.rate * g[rows].sum() / (h[rows].sum() + 1)
        tree[node] = (-1, 0.0, float(value))
        if level == self.depth or len(rows) < 2 * self.leaf:
            return
        best = (1e-6, -1, 0.0)
        total, weight = g[rows].sum(), h[rows].sum() + 1
        for j, cut in enumerate(cuts):
            for c in cut:
                left = x[rows, j] <= c
                n = left.sum()
                if self.leaf <= n <= len(rows) - self.leaf:
                    a, b = g[rows][left].sum(), h[rows][left].sum()
                    gain = a * a / (b + 1) + (total - a) ** 2 / (weight - b) - total * total / weight
                    best = max(best, (float(gain), j, float(c)))
        if best[1] >= 0:
            tree[node] = (best[1], best[2], float(value))
            left = x[rows, best[1]] <= best[2]
            self._grow(tree, 2 * node + 1, level + 1, rows[left], x, g, h, cuts)
            self._grow(tree, 2 * node + 2, level + 1, rows[~left], x, g, h, cuts)

    @staticmethod
    def _one(tree, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        split = np.array([n[0] for n in tree])
        cut = np.array([n[1] for n in tree])
        value = np.array([n[2] for n in tree])
        for _ in range(int(np.log2(len(tree) + 1)) - 1):
            go = split[node] >= 0
            right = x[np.arange(len(x)), np.maximum(split[node], 0)] > cut[node]
            node = np.where(go, 2 * node + 1 + right, node)
        return value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for tree in self.trees:
            f += self._one(tree, x)
        return f


#: Fixed values of the generator: what stands before personal data and before look-alikes; some of it is unknown to the features.
_LEADS = {
    "phone_local": ("phone", "call me at", "tel:", "mobile", "reach me on", "ring", "my number:", "dial"), "id_number": ("my ssn is", "social security", "insurance no", "taxpayer"), "iban": ("iban:", "bank account", "transfer to", "pay into"),
    "email_words": ("contact", "write to", "mail", "ask", "drop a line:"), "ipv6": ("host", "server", "from", "peer", "address"), "mac": ("mac address", "device", "adapter", "network card"), "birth_date": ("born", "date of birth:", "dob", "born on", "birthday", "b.", "geboren am", "geb.", "né le", "née le", "nació el", "nacida el"),
}
#: Words of prose around "at" and "dot": what is said there is no address.
_PROSE = ("look", "arrive", "laughed", "was", "waiting", "meet", "stop", "good", "people", "everyone", "she", "prices", "not")
_PLACES = ("home", "noon", "the", "a", "each", "every", "last", "once", "night", "work", "this", "one")
_AFTER = ("com", "de", "es", "it", "at", "net", "info")
_OTHER = ("order", "part no.", "version", "isbn", "score", "page", "serial", "build", "ticket", "total", "ratio", "on", "until", "since", "published", "updated", "due")


def training_lines(n: int = TRAIN_LINES, seed: int = 5) -> Iterator[tuple[str, str]]:
    """Lines with one candidate each and its kind, empty if it is no personal data: real shapes with telling words, and look-alikes."""
    r = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    two = lambda a, b: f"{int(r.integers(a, b)):02d}"
    hexs = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(pick(["th", "er", "on", "an", "in", "re", "la", "de", "ou"]) for _ in range(int(r.integers(1, 4))))
    for i in range(n):
        good = int(r.random() < 0.5)
        kind = MORE_KINDS[i % len(MORE_KINDS)]
        if kind == "phone_local":
            x = pick([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}"]) if good else pick([f"{d(3)} {d(3)} {d(3)}", f"{d(4)}.{d(3)}.{d(3)}", f"{d(2)}-{d(4)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"])
        elif kind == "id_number":
            x = f"{d(3)}-{d(2)}-{d(4)}"
        elif kind == "iban":
            land, body = pick(["DE", "FR", "ES", "GB", "NL", "IT"]), d(18)
            x = f"{land}{98 - mod97(f'{land}00{body}'):02d}{body}" if good else "".join(pick("ABCDEFGHKL") for _ in range(2)) + d(2) + "".join(pick("ABCDEFGH0123") for _ in range(16))
            x = " ".join(x[k : k + 4] for k in range(0, len(x), 4)) if good and r.random() < 0.4 else x
        elif kind == "email_words":
            x = f"{word()}{pick(['.', '', '_'])}{word()} {pick(['(at)', '[at]', 'at'])} {word()} {pick(['dot', '(dot)', '[dot]'])} {pick(['com', 'org', 'net', 'de'])}" if good else pick([f"{pick(_PROSE)} at {pick(_PLACES)} dot {pick(_AFTER)}", f"{pick(_PROSE)} at {word()} dot {pick(_AFTER)}", f"{word()} at {pick(_PLACES)} dot {pick(TOP_LEVEL)}", f"{word()} at {word()} dot {pick(TOP_LEVEL)}", f"{pick(_PROSE)} at {word()}.{pick(['at', 'it', 'es', 'de'])}"])
            if good and r.random() < 0.2:
                x = f"{word()}{pick(['.', '_', '', ''])}{word()} at {word()}{pick(['.', ' dot '])}{pick(TOP_LEVEL)}"
        elif kind == "ipv6":
            x = pick([":".join(hexs(4) for _ in range(8)), f"2001:db8::{hexs(int(r.integers(1, 5)))}", f"fe80::{hexs(4)}:{hexs(4)}"]) if good else pick([":".join(d(2) for _ in range(6)), ":".join(d(1) for _ in range(7))])
        elif kind == "mac":
            some = pick(["0123456789abcdef", "01234abcdef", "01abcdef"])  # vendors' parts may have few digits
            x = pick("-:").join(pick(some) + pick(some) for _ in range(6)) if good else "-".join(d(2) for _ in range(6))
            x = x.upper() if r.random() < 0.3 else x
        else:
            y, m, a = pick(["19", "20"]) + two(0, 25) if not good else f"19{two(30, 99)}", two(1, 13), two(1, 29)
            x = pick([f"{y}-{m}-{a}", f"{a}/{m}/{y}", f"{a}.{m}.{y}", f"{int(a)} {pick(['January', 'Mar', 'july', 'Oct', 'December'])} {y}"])
        lead = pick(_LEADS[kind]) if good and r.random() < 0.95 else pick(_OTHER) if not good and r.random() < 0.75 else word()
        yield " ".join([*(word() for _ in range(int(r.integers(0, 6)))), lead, x, *(word() for _ in range(int(r.integers(0, 6))))]), kind if good else ""


@lru_cache(maxsize=1)
def model() -> tuple[Boosted, dict[str, float], tuple[float, float], dict[str, float]]:
    """(trees, leanings of words, scale and shift of the calibration, threshold of each kind); calibration and thresholds from parts of their own."""
    lines = [(i // len(MORE_KINDS) % 10, t, kind) for i, (t, kind) in enumerate(training_lines())]
    found = [(p, t, c, c[0] == kind) for p, t, kind in lines for c in candidates(t)]
    seen: dict[str, list[int]] = {}
    for p, t, c, is_ in found:
        if p < 6:
            for w in near_words(t, c[1]) + (_NEAR_WORD.findall(t[c[1] : c[2]].lower()) if c[0] == "email_words" else []):
                seen.setdefault(w, [0, 0])[is_] += 1
    lean = {w: float(np.log((n[1] + 1) / (n[0] + 1))) for w, n in seen.items() if sum(n) >= 8}
    rows = [(c[0], features(t, *c, lean), is_) for _, t, c, is_ in found]
    x, y = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    part = np.array([f[0] for f in found])
    grow, scale, limit = part < 6, (part == 6) | (part == 7), part > 7
    trees = Boosted().fit(x[grow], y[grow])
    f = trees.score(x[scale])
    a, b = 1.0, 0.0
    for _ in range(200):  # logistic calibration
        p = 1 / (1 + np.exp(-(a * f + b)))
        a, b = a + 0.05 * float(((y[scale] - p) * f).mean()), b + 0.05 * float((y[scale] - p).mean())
    p = 1 / (1 + np.exp(-(a * trees.score(x[limit]) + b)))
    kinds = np.array([r[0] for r in rows], object)[limit]
    limits = {}
    for k in MORE_KINDS:
        mine = kinds == k
        limits[k] = 1.01
        for c in sorted(set(np.round(p[mine], 3)), reverse=True):
            at = mine & (p >= c)
            if at.any() and y[limit][at].mean() >= PRECISION:
                limits[k] = max(0.5, float(c))
    return trees, lean, (a, b), limits


def spans(t: str | None) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind, and all spans in order of kind, then start."""
    t = t or ""
    base = base_spans(t)
    taken = sorted(s for v in base.values() for s in v)
    more = []
    if found := candidates(t):
        trees, lean, (a, b), limits = model()
        p = 1 / (1 + np.exp(-(a * trees.score(np.array([features(t, *c, lean) for c in found], float)) + b)))
        for q, (k, s, e) in sorted(zip(p, found, strict=True), key=lambda x: (-x[0], x[1])):
            if q >= limits[k] and all(e <= u or v <= s for u, v in taken):
                more.append((k, s, e))
                taken.append((s, e))
    every = [(k, *s) for k in BASE_KINDS for s in base[k]] + sorted(more, key=lambda x: (KINDS.index(x[0]), x[1]))
    return base, every


def redact(t: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; spans that touch become one."""
    if t is None:
        return None
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans(t)[1]):
        if s >= at:
            out += [t[at:s], f"[{k}]"]
        at = max(at, e)
    return "".join([*out, t[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", redacted: bool = False) -> DataFrame:
    """Per row: its id, counts of base kinds, base_sha256, spans, and the redacted text if asked.  One narrow pass."""
    import pyspark.sql.types as T

    small_batches(docs)
    docs = docs.select(doc_id, text)
    schema = T.StructType([T.StructField(doc_id, docs.schema[0].dataType), *T._parse_datatype_string(SCHEMA).fields[1:], *([T.StructField("redacted", T.StringType())] * redacted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for x in batch.column(1):
                t = x.as_py()
                base, every = spans(t)
                digest = ",".join(f"{k}:{s}:{e}" for k in BASE_KINDS for s, e in base[k])
                rows.append((*(len(base[k]) for k in BASE_KINDS), hashlib.sha256(digest.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in every), *([redact(t)] * redacted)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * (len(schema) - 1)
            kinds = [pa.int64()] * 4 + [pa.string()] * (len(schema) - 5)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], schema.names)

    return docs.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    return personal_data(docs)
