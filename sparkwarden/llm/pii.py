"""Personal data: high-recall generators propose overlapping spans, boosted trees score them, calibrated thresholds select.

Base spans (``email``, ``ip``, ``card``, ``phone``) follow fixed patterns and checks and are always selected. Wider generators
propose further spans (``email_text``, ``ipv6``, ``card_loose``, ``phone_local``, ``ssn``, ``iban``). Every candidate is
described by its format and its context; gradient-boosted trees give it a score, a logistic curve fitted on held-back
candidates turns scores into probabilities, and each kind's threshold is the lowest that keeps ``min_precision`` there.
Of overlapping candidates the likelier one stays; none may touch a base span.

Training data: candidates of a bounded sample of texts (``sample_texts``, in expectation, by hash of the text, at most
``_PER_TEXT`` candidates of each), labelled by the checks (base spans and checksums true, failed checks without a cue word
false), and written-out example sentences made by rule. Without any text the examples alone train the model.

Defined results: a null text counts as empty (no spans). Each input row gives one output row, repeated rows and null ids
included. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import map_blocks, replace_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "email_text", "ipv6", "card_loose", "phone_local", "ssn", "iban")
#: The base patterns of the contract. Possessive forms and the lookbehind only cut vain retries: within a run
#: of digits a later start meets the same characters, so the matches are those of the plain patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

# A spelt-out address is found from its "at"; the part before it is read backwards.
_AT = re.compile(
    r"(?<![A-Za-z0-9])[Aa][Tt](?ai:(?![a-z0-9])\x20?[\])}>]?\x20?[a-z0-9-]{1,63}"
    r"(?:\x20?[\[({<]?\x20?(?<![a-z0-9])(?:dot|punkt|punto|point)(?![a-z0-9])\x20?[\])}>]?\x20?[a-z0-9-]{1,63}){1,4})"
)
_AT_LOCAL = re.compile(r"(?ai:[a-z0-9][a-z0-9._%+-]{0,63}\x20?[\[({<]?\x20?$)")
_AT_REACH = 68
_GENERATORS = {
    "ipv6": re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])"),
    "card_loose": re.compile(r"(?<![0-9.])[0-9]{4}[ .\-_/]?[0-9]{4,6}[ .\-_/]?[0-9]{4,5}(?:[ .\-_/]?[0-9]{1,4})?(?![0-9])"),
    "phone_local": re.compile(r"(?<![0-9+.])(?:00[ .-]?)?\(?[0-9]{2,5}\)?[ .\-/][0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
}
#: Words before a span that speak for a kind of personal data, in the corpus's languages.
_CUES = {
    "email_text": ("mail", "correo", "courriel", "contact", "kontakt", "write", "reach"),
    "ipv6": ("ip", "host", "addr", "server", "client"),
    "card_loose": ("card", "visa", "mastercard", "amex", "karte", "tarjeta", "carte", "credit"),
    "phone_local": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "telefon", "móvil", "contact", "ring"),
    "ssn": ("ssn", "social", "security", "tax", "insurance"),
    "iban": ("iban", "account", "konto", "cuenta", "compte", "bank", "sepa"),
}
_AGAINST = ("order", "version", "isbn", "part", "serial", "invoice", "page", "article", "date", "model", "build", "no.", "id")
_PER_TEXT = 50
_CONTEXT = 32
FIELDS = {
    "doc_id": "long", "n_email": "long", "n_ip": "long", "n_card": "long", "n_phone": "long", "base_sha256": "string", "spans": "string",
}
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> list[Span]:
    """From each @ the domain is read forwards and the local part backwards, at most to the end of the match before."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        if found := _DOMAIN.match(text, at + 1):
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = found.end()
                out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out = emails(text)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (x.lstrip("0") for x in m.groups())):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def wide_spans(text: str) -> list[Span]:
    """What the generators propose; they may overlap each other and the base spans."""
    out = []
    for m in _AT.finditer(text):
        reach = max(0, m.start() - _AT_REACH)
        if local := _AT_LOCAL.search(text[reach : m.start()]):
            out.append(("email_text", reach + local.start(), m.end()))
    if _DIGIT.search(text):
        out += [(kind, *m.span()) for kind, pattern in _GENERATORS.items() for m in pattern.finditer(text)]
    return out


def iban_holds(value: str) -> bool:
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def checked(kind: str, value: str) -> bool | None:
    """What a checksum or a format rule says of a candidate; None where there is none."""
    digits = _NO_DIGIT.sub("", value)
    if kind == "card_loose":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "iban":
        return iban_holds(value)
    if kind == "ssn" and (digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000"):
        return False
    return None


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate as numbers."""
    kind, start, end = span
    value = text[start:end]
    before, after = text[max(0, start - _CONTEXT) : start].lower(), text[end : end + _CONTEXT]
    groups = re.findall(r"[0-9]+", value)
    digits = "".join(groups)
    verdict = checked(kind, value)
    cues = _CUES.get(kind, ())
    return [
        float(KINDS.index(kind)), float(len(value)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)), float(len(set(re.findall(r"[^0-9A-Za-z]", value)))), float(value.count(" ")),
        float(value.count("-")), float(value.count(".")), float("(" in value), float(len(set(digits))),
        float(sum(c.isalpha() for c in value)), -1.0 if verdict is None else float(verdict),
        float(any(c in before for c in cues)), float(any(c in before[-14:] for c in cues)), float(any(c in before for c in _AGAINST)),
        float(before.rstrip(" \"'(")[-1:] in (":", "=", "#")), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(after[:1] in ("%", "€", "$", "/", "_")), float(sum(c.isdigit() for c in before)), float(sum(c.isdigit() for c in after)),
        float("[" in value or "(" in value or "{" in value),
    ]


def weak_label(text: str, span: Span, base: list[Span]) -> int | None:
    """1 or 0 where the checks decide, None where only the trees can."""
    kind, start, end = span
    if any(b < end and start < e for _, b, e in base):
        return None
    verdict = checked(kind, text[start:end])
    if verdict is not None and kind != "ssn":
        return int(verdict)
    row = describe(text, span)
    if verdict is False or row[16] or not (row[14] or row[15]):
        return 0
    return 1


def examples() -> list[tuple[str, int]]:
    """Sentences by rule, each with one candidate to find: a format in a telling or a misleading context."""
    values = {
        "email_text": ["ann.lee at mail dot com", "bob (at) web [dot] org", "info [at] firma punkt de"],
        "ipv6": ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80:1:2:3:4:5:6:7"],
        "card_loose": ["4111.1111.1111.1111", "378282246310005", "5500/0000/0000/0004"],
        "phone_local": ["(555) 010-2233", "030 1234 5678", "0049 30 123 4567", "555-010-9988"],
        "ssn": ["219-09-9999", "078 05 1120", "457-55-5462"],
        "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"],
    }
    misses = {
        "email_text": ["look at this dot pattern", "stay at home dot com"],
        "ipv6": ["12:30:45:10:11:12:13:14"],
        "card_loose": ["1234.5678.9012.3456", "2024-1231-2359-5959", "100020003000400"],
        "phone_local": ["2024-01-31", "10 20 30", "12.50.99", "1999/12/31 10 20"],
        "ssn": ["000-12-3456", "666-10-2000"],
        "iban": ["AB12 CDEF GHIJ KLMN", "XX00 1234 5678 9012"],
    }
    out = []
    for kind, cues in _CUES.items():
        for value in values[kind]:
            out += [(template.format(cue, value), 1) for cue in cues for template in ("{}: {} ", "my {} is {}.", "{} {}, please")]
            if kind in ("card_loose", "iban", "email_text", "ipv6"):
                out += [(f"they wrote {value} there", 1), (f"{value}\n", 1)]
            else:
                out += [(f"{bad} {value} of it", 0) for bad in (*_AGAINST, "size", "weights", "values", "lines")]
        for value in misses[kind]:
            out += [(f"{bad} {value} of it", 0) for bad in (*_AGAINST, "the", "with", "and", "see")]
            out += [(f"{value}.", 0)] * 3
    return out


# ---- boosted trees -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth: split features and cuts level by level, then leaf values."""

    features: np.ndarray  # trees x inner nodes
    cuts: np.ndarray
    leaves: np.ndarray  # trees x leaves
    bias: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        every = np.arange(len(rows))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(rows), np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (rows[every, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def boost(rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Forest:
    """Gradient boosting of the logistic loss with second-order gains over all cuts between seen values."""
    mean = min(0.99, max(0.01, float(labels.mean())))
    bias = float(np.log(mean / (1 - mean)))
    cuts_of = [np.unique(np.quantile(column, np.linspace(0, 1, 33)[:-1])) for column in rows.T]
    codes = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts_of, rows.T)], axis=1)
    inner = 2**depth - 1
    features, cuts, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    raw = np.full(len(rows), bias)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, curve = labels - p, p * (1 - p)
        node = np.zeros(len(rows), np.int64)
        for at in range(inner):
            own = np.flatnonzero(node == at)
            best = (1e-6, 0, np.inf)
            total, mass = slope[own].sum(), curve[own].sum()
            for f, cut in enumerate(cuts_of):
                g = np.cumsum(np.bincount(codes[own, f], slope[own], len(cut) + 1))[:-1]
                h = np.cumsum(np.bincount(codes[own, f], curve[own], len(cut) + 1))[:-1]
                gain = g**2 / (h + ridge) + (total - g) ** 2 / (mass - h + ridge) - total**2 / (mass + ridge)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, float(cut[int(gain.argmax())]))
            features[tree, at], cuts[tree, at] = best[1], best[2]
            node[own] = 2 * at + 1 + (rows[own, best[1]] > best[2])
        leaf = node - inner
        leaves[tree] = rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, curve, inner + 1) + ridge)
        raw += leaves[tree][leaf]
    return Forest(features, cuts, leaves, bias)


@dataclass(frozen=True)
class Selector:
    forest: Forest
    slope: float
    offset: float
    thresholds: dict[str, float]

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.forest.raw(rows) + self.offset)))


def calibrate(raw: np.ndarray, labels: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Platt scaling by gradient descent."""
    slope, offset = 1.0, 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(slope * raw + offset, -30, 30))) - labels
        slope -= 0.1 * float((error * raw).mean())
        offset -= 0.5 * float(error.mean())
    return slope, offset


def learn(rows: np.ndarray, labels: np.ndarray, min_precision: float = 0.95) -> Selector:
    """Every fourth candidate is held back from the trees, for calibration and thresholds."""
    held = np.arange(len(rows)) % 4 == 3
    forest = boost(rows[~held], labels[~held])
    slope, offset = calibrate(forest.raw(rows[held]), labels[held])
    chance = Selector(forest, slope, offset, {}).probabilities(rows[held])
    thresholds = {}
    for place, kind in enumerate(KINDS[len(BASE_KINDS) :], len(BASE_KINDS)):
        own = rows[held][:, 0] == place
        cuts = np.unique(chance[own][chance[own] >= 0.5])
        good = [float(c) for c in cuts if labels[held][own & (chance >= c)].mean() >= min_precision]
        thresholds[kind] = min(good, default=1.1)
    return Selector(forest, slope, offset, thresholds)


def training_rows(texts: DataFrame, sample_texts: int) -> list[tuple[list[float], int]]:
    fields = {"features": "string", "label": "int"}
    rate = min(1.0, sample_texts / max(1, texts.count()))
    drawn = texts.filter(F.pmod(F.xxhash64("text", F.lit("personal data sample")), F.lit(1_000_000)) < int(rate * 1_000_000) + 1)

    def block(rows: list) -> dict[str, list]:
        out = []
        for text in rows:
            base, taken = base_spans(text), 0
            for span in wide_spans(text):
                if taken < _PER_TEXT and (label := weak_label(text, span, base)) is not None:
                    out.append((",".join(map(repr, describe(text, span))), label))
                    taken += 1
        return {"features": [f for f, _ in out], "label": [y for _, y in out]}

    found = sorted(map_blocks(drawn, {"text": F.col("text")}, fields, block).collect())
    return [([float(x) for x in f.split(",")], y) for f, y in found]


def fit(texts: DataFrame, sample_texts: int = 3000, min_precision: float = 0.95) -> Selector:
    """``texts``: a column text without nulls."""
    made = []
    for sentence, label in examples():
        made += [(describe(sentence, span), label) for span in wide_spans(sentence)]
    made = made + training_rows(texts, sample_texts)
    order = np.random.default_rng(11).permutation(len(made))
    return learn(np.array([made[i][0] for i in order]), np.array([made[i][1] for i in order], float), min_precision)


def added_spans(text: str, base: list[Span], selector: Selector) -> list[Span]:
    """Selected candidates: likeliest first, none touching a base span or one selected before."""
    spans = wide_spans(text)
    if not spans:
        return []
    chances = selector.probabilities(np.array([describe(text, s) for s in spans])).tolist()
    taken = sorted((s, e) for _, s, e in base)
    merged: list[list[int]] = []
    for s, e in taken:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    used, out = [tuple(x) for x in merged], []
    for chance, (kind, start, end) in sorted(zip(chances, spans), key=lambda x: (-x[0], x[1][1], x[1][2], x[1][0])):
        at = bisect.bisect_left(used, (start,))
        free = (at == len(used) or end <= used[at][0]) and (at == 0 or used[at - 1][1] <= start)
        if free and chance >= selector.thresholds[kind]:
            used.insert(at, (start, end))
            out.append((kind, start, end))
    return out


def find_spans(text: str | None, selector: Selector) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added ones together; both by kind as listed, then start."""
    text = text or ""
    base = base_spans(text)
    rank = {kind: i for i, kind in enumerate(KINDS)}
    return base, sorted(base + added_spans(text, base, selector), key=lambda s: (rank[s[0]], s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """Spans replaced by their kind in brackets; overlapping ones (of different base kinds) become one."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_texts: int = 3000) -> DataFrame:
    """One row per input row with the columns of ``FIELDS``."""
    selector = fit(df.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull()), sample_texts)

    def block(ids: list, texts: list) -> dict[str, list]:
        rows = []
        for text in texts:
            base, every = find_spans(text, selector)
            counts = [sum(kind == k for kind, _, _ in base) for k in BASE_KINDS]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        return dict(zip(FIELDS, [ids, *(list(c) for c in zip(*rows))] if rows else [[] for _ in FIELDS]))

    return map_blocks(df, {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col)}, FIELDS, block)


def redact(df: DataFrame, text_col: str = "text", sample_texts: int = 3000) -> DataFrame:
    """``df`` with the spans of ``text_col`` replaced by their kind; all other columns and rows stay as they are."""
    selector = fit(df.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull()), sample_texts)
    clean = lambda text: None if text is None else redacted(text, find_spans(text, selector)[1])
    return replace_text(df, text_col, lambda texts: [clean(t) for t in texts])
