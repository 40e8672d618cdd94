r"""Personal data by weak supervision.

Base spans come from four fixed patterns (email, ip, card, phone), leftmost and
non-overlapping for each kind, and always stay. Candidates for more spans come
from broader patterns: numbers that the base patterns swallow or miss, spelled-out
addresses, identity and account numbers, and secrets. Labelers vote on every
candidate and base span (1 for, -1 against, 0 abstains):

- regex: a strict form of the kind, with its checksum where it has one;
- gazetteer: mail providers and domains, card issuers by prefix and length, calling
  codes, account number lengths by country, prefixes of keys;
- context: a word for the kind close before the span, or one that speaks against;
- shape: dates, decimals, ranges and versions speak against, separators for;
- edges: a span cut out of a longer word or number speaks against.

Spark counts how often each pattern of (kind, votes) occurs in all documents; the
counts have at most ``PATTERNS`` rows. Expectation maximisation over them estimates
each labeler's reliability for each class (and the share of true spans of each
kind), and so the probability of every pattern. These are the labels of the final
span classifier: a logistic regression over what a span and its surroundings look
like (``FEATURES``: kind, form, the characters and the word beside it, length,
share of digits, separators, variety), fitted on the sums over all spans of each
combination of features, of which there are at most ``CODES``. A candidate is
added if the classifier gives at least ``THRESHOLD`` and it overlaps no base span
and no better candidate.

Offsets are code points, end exclusive. Defined cases: a null text is empty;
texts are scanned whole; repeated rows are found each; without any candidate
nothing is added; an empty table gives an empty result. ``redact`` keeps all other
columns as they are, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storynet.llm.common import ready, saved, small, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn", "iban")
THRESHOLD, ROUNDS = 0.5, 50
#: Ridge term of the classifier for weights that sum to one.
RIDGE = 1e-6
LABELERS = ("regex", "gazetteer", "context", "shape", "edges")
PATTERNS = len(KINDS) * 3 ** len(LABELERS)
#: What the classifier sees of a span, and how many values each has.
FEATURES = {"kind": len(KINDS), "form": 3, "before": 5, "after": 5, "length": 6, "digits": 4, "separators": 3, "variety": 3, "word": 16}
CODES = int(np.prod(list(FEATURES.values())))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

CANDIDATES = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[({]\s?at\s?[\])}]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[({]\s?dot\s?[\])}])\s?[A-Za-z0-9-]{1,63}){1,4}", re.I)),
    ("email", re.compile(r"\b[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63}){1,4}\b")),
    ("ip", re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}(?:[ .-]?[0-9]{2,4}){1,2}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("secret", re.compile(r"\bAKIA[0-9A-Z]{16}\b")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{16,64}(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?<=[=:\"'])[A-Za-z0-9+/_-]{16,100}(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
)
# Top-level domains, mail providers, issuers' prefixes with lengths, calling codes, lengths of account numbers.
DOMAINS = (
    "com", "org", "net", "edu", "gov", "int", "mil", "io", "co", "ai", "app", "dev", "info", "biz", "me", "tv", "eu", "uk", "us", "ca", "au", "nz", "ie", "de",
    "at", "ch", "fr", "be", "nl", "lu", "es", "pt", "it", "se", "no", "dk", "fi", "pl", "cz", "sk", "hu", "ro", "bg", "gr", "tr", "ru", "ua", "il", "in", "cn",
    "jp", "kr", "tw", "hk", "sg", "br", "mx", "ar", "cl", "za", "example", "gmail", "googlemail", "yahoo", "hotmail", "outlook", "live", "icloud", "aol", "gmx",
    "web", "proton", "protonmail", "mail", "orange", "wanadoo", "laposte", "terra",
)
ISSUERS = (("4", (13, 16, 19)), ("34", (15,)), ("35", (16,)), ("36", (14,)), ("37", (15,)), ("38", (14,)), ("5", (16,)), ("2", (16,)), ("6", (16, 17, 18, 19)), ("30", (14,)))
CALLING = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61",
    "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "380", "420", "421", "852", "886", "971", "972",
)
ACCOUNTS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27,
    "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24, "TR": 26,
}
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "glpat-", "sk_live_", "sk-", "pk_live_", "xoxb-", "xoxp-", "eyJ", "ya29.")
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel", "reach", "schreib", "escrib", "ecri"),
    "ip": ("ip", "host", "server", "address", "login", "from", "adresse", "servidor"),
    "card": ("card", "visa", "master", "amex", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "handy", "anruf", "appel", "llam"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "key", "auth", "akia", "bearer", "credential", "passwort", "clave"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
}
AGAINST = ("isbn", "issn", "doi", "version", "page", "figure", "table", "chapter", "section", "sha", "md", "commit", "order", "invoice", "checksum", "hash", "seite", "kapitel")


@dataclass(frozen=True)
class Lists:
    """Word lists of the gazetteer and context labelers."""

    domains: frozenset = frozenset(DOMAINS)
    context: dict = field(default_factory=lambda: dict(CONTEXT))
    against: frozenset = frozenset(AGAINST)

    @classmethod
    def read(cls, words: DataFrame, most: int = 100_000) -> Lists:
        """The default lists and the rows of ``words``(list, word), where list is domains, against or a kind; ``most`` words at most, else it fails."""
        rows = [(r[0], r[1].lower()) for r in words.select("list", "word").filter("list is not null and word is not null").distinct().limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"more than {most} words in the lists")
        of = lambda name: [w for k, w in rows if k == name]
        return cls(frozenset([*DOMAINS, *of("domains")]), {k: (*v, *of(k)) for k, v in CONTEXT.items()}, frozenset([*AGAINST, *of("against")]))


LISTS = Lists()
_WORD = re.compile(r"[A-Za-z]+")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./ ][0-1]?[0-9][-./ ][0-3]?[0-9]")
_STRICT = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}"),
    "phone": re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    "secret": re.compile(r"AKIA[0-9A-Z]{16}|(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_-]{16,}"),
    "ssn": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """The local part cannot hold an @, so each match starts where the run before its @ does; linear in the text."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            found.append((start, done))
        done = max(done, at + 1)
        at = text.find("@", done)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return spans


def votes(kind: str, text: str, start: int, end: int, lists: Lists = LISTS) -> tuple[int, ...]:
    """A vote of each of LABELERS on a span."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    if kind == "card":
        strict = 13 <= len(digits) <= 19 and luhn(digits)
    elif kind == "ip":
        strict = ":" in span or all(len(p) <= 3 and int(p) <= 255 and p == str(int(p)) for p in span.split("."))
    elif kind == "iban":
        strict = _iban(span)
    else:
        strict = bool(_STRICT[kind].fullmatch(span))
    regex = 1 if strict else 0 if kind == "email" else -1
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 32) : start])]
    if kind == "email":
        gazetteer = int(any(p.lower() in lists.domains for p in re.split(r"[^A-Za-z0-9]+", span)))
    elif kind == "card":
        gazetteer = 1 if any(digits.startswith(p) and len(digits) in sizes for p, sizes in ISSUERS) else -1
    elif kind == "phone":
        gazetteer = int(span.startswith("+") and any(digits.startswith(c) for c in CALLING))
    elif kind == "ip":
        gazetteer = -1 if span.startswith(("0.", "127.", "255.")) else 0
    elif kind == "secret":
        gazetteer = 1 if span.startswith(PREFIXES) or before and before[-1] in lists.context["secret"] else 0
    elif kind == "iban":
        gazetteer = 1 if ACCOUNTS.get(span[:2]) == len(span.replace(" ", "")) else -1
    else:
        gazetteer = 0
    context = 1 if any(w.startswith(lists.context[kind]) for w in before) else -1 if any(w in lists.against for w in before) else 0
    if kind in ("phone", "ssn", "card") and _DATE.match(span) or kind == "ip" and before[-1:] == ["v"]:
        shape = -1
    else:
        shape = 1 if kind in ("phone", "card", "ssn") and any(c in span for c in " -()") else 0
    around = text[start - 1 : start] + text[end : end + 1]
    edges = -1 if any(c.isalnum() for c in around) else 0
    return regex, gazetteer, context, shape, edges


def _class(c: str) -> int:
    """Of a character beside a span: none or white space, letter, digit, a mark that introduces a value, another."""
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in "=:\"'`<([" else 4


def looks(kind: str, text: str, start: int, end: int, form: int) -> int:
    """The number of a span's combination of FEATURES."""
    span, code = text[start:end], KINDS.index(kind)
    size, n_digits = max(end - start, 1), sum(c in "0123456789" for c in span)
    marks = len({c for c in span if not c.isalnum()})
    words = _WORD.findall(text[max(0, start - 32) : start])
    values = (
        form + 1,
        _class(text[start - 1 : start]),
        _class(text[end : end + 1]),
        min(size // 8, 5),
        0 if not n_digits else 1 if 3 * n_digits < size else 2 if 3 * n_digits < 2 * size else 3,
        min(marks, 2),
        min(3 * len(set(span)) // size, 2),
        zlib.crc32(words[-1].lower().encode()) % (FEATURES["word"] - 1) + 1 if words else 0,
    )
    for v, card in zip(values, list(FEATURES.values())[1:], strict=True):
        code = code * card + v
    return code


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the broader patterns that overlap no base span."""
    digits = bool(_DIGIT.search(text))
    low = text.lower() if " dot " in text or "at" in text and ("(" in text or "[" in text or "{" in text) else ""
    found = set()
    for i, (kind, pattern) in enumerate(CANDIDATES):
        if i == 0 and not any(x in low for x in ("at)", "at]", "at}", "at )", "at ]")) or i == 1 and " dot " not in text:
            continue
        if i > 1 and not digits and i != 10 or i == 10 and not any(c in text for c in "=:\"'"):
            continue
        found.update((kind, m.start(), m.end()) for m in pattern.finditer(text))
    taken = Taken()
    for _, a, b in base:
        taken.add(a, b)
    return sorted(c for c in found if taken.free(c[1], c[2]))


class Taken:
    """Spans that are taken, joined where they overlap, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        """Whether [a, b) overlaps none of them."""
        i = bisect_right(self.ends, a)
        return i == len(self.starts) or self.starts[i] >= b

    def add(self, a: int, b: int) -> None:
        i = bisect_right(self.ends, a)
        j = i
        while j < len(self.starts) and self.starts[j] < b:
            j += 1
        if j > i:
            a, b = min(a, self.starts[i]), max(b, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [a], [b]


def pattern_of(kind: str, given: tuple[int, ...]) -> int:
    """The number of (kind, votes)."""
    code = KINDS.index(kind)
    for v in given:
        code = code * 3 + v + 1
    return code


def _unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rest, out = codes, []
    for _ in LABELERS:
        out.append(rest % 3)
        rest = rest // 3
    return rest, np.stack(out[::-1], 1)


def reliabilities(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over pattern counts: P(vote | class) as (labeler, class, vote), and the probability that each pattern is true."""
    kind, vote = _unpack(codes)
    table = np.tile(np.array([[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]]), (len(LABELERS), 1, 1))
    share = np.full(len(KINDS), 0.5)
    p = share[kind]
    for _ in range(ROUNDS):
        like = np.stack([np.log(1 - share[kind]), np.log(share[kind])], 1)
        for j in range(len(LABELERS)):
            like += np.log(table[j][:, vote[:, j]]).T
        p = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
        for k in range(len(KINDS)):
            of = kind == k
            share[k] = (p[of] @ n[of] + 2) / (n[of].sum() + 4)
        for j in range(len(LABELERS)):
            for v in range(3):
                of = vote[:, j] == v
                # priors keep the meaning of the classes: for comes with true, against with false
                table[j, 1, v] = p[of] @ n[of] + (1, 4, 10)[v]
                table[j, 0, v] = (1 - p[of]) @ n[of] + (10, 4, 1)[v]
        table /= table.sum(2, keepdims=True)
    return table, p


class Classifier:
    """Logistic regression over FEATURES, each value with a weight of its own and one for each kind."""

    def __init__(self):
        cards = list(FEATURES.values())
        self.cards, self.first = cards, np.cumsum([0, *cards])
        self.kinds = self.first[-1] + np.cumsum([0, *(cards[0] * c for c in cards[1:])])
        self.w = np.zeros(self.kinds[-1] + 1)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The places of the weights that count for each code."""
        rest, values = codes, []
        for c in self.cards[::-1]:
            values.append(rest % c)
            rest = rest // c
        values = values[::-1]
        both = [self.kinds[i] + values[0] * self.cards[i + 1] + v for i, v in enumerate(values[1:])]
        return np.stack([*(self.first[i] + v for i, v in enumerate(values)), *both, np.full(len(codes), len(self.w) - 1)], 1)

    def probability(self, codes) -> np.ndarray:
        codes = np.asarray(codes, np.int64)
        return 1 / (1 + np.exp(-np.clip(self.w[self.places(codes)].sum(1), -30, 30))) if len(codes) else np.zeros(0)

    def fit(self, codes: np.ndarray, n: np.ndarray, p: np.ndarray) -> Classifier:
        """Learns from ``n`` spans of each code, of which a share ``p`` is true; by shares of all counts, so that it is the same at every size."""
        weight, size = n / n.sum(), len(self.w)
        for _ in range(25):
            g, h = -RIDGE * self.w, RIDGE * np.eye(size)
            for i in range(0, len(codes), 2048):
                at = self.places(codes[i : i + 2048])
                x = np.zeros((len(at), size))
                np.put_along_axis(x, at, 1.0, 1)
                q = 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))
                m = weight[i : i + 2048]
                h += (x * (m * q * (1 - q))[:, None]).T @ x
                g += x.T @ (m * (p[i : i + 2048] - q))
            step = np.linalg.solve(h, g)
            self.w += step * min(1.0, 8 / max(np.abs(step).max(), 1e-12))
        return self


def choose(cands: list[tuple[float, str, int, int]]) -> list[tuple[str, int, int]]:
    """Of (probability, kind, start, end) the best ones without overlap, probability at least THRESHOLD."""
    kept, taken = [], Taken()
    for _, kind, a, b in sorted((c for c in cands if c[0] >= THRESHOLD), key=lambda c: (-c[0], c[2] - c[3], c[2], c[1])):
        if taken.free(a, b):
            taken.add(a, b)
            kept.append((kind, a, b))
    return kept


def written(spans) -> str:
    """kind:start:end by kind as listed, then start."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


_FOUND = "doc_id long, base string, cand string, cand_looks array<int>, spans array<struct<pattern:int,looks:int>>"


def _seen(text: str, lists: Lists) -> tuple:
    """Base spans, candidates, and pattern and looks of both, in that order."""
    base = base_spans(text)
    cand = candidates(text, base)
    codes = []
    for k, a, e in (*base, *cand):
        given = votes(k, text, a, e, lists)
        codes.append((pattern_of(k, given), looks(k, text, a, e, given[0])))
    return base, cand, codes


def _spans(text: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in text.split(",") if x)]


def scan(docs: DataFrame, lists: Lists = LISTS) -> DataFrame:
    """Base spans and candidates with the patterns of their votes and their looks, saved: a row for each row of ``docs``(doc_id, text)."""
    types = (pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.struct([("pattern", pa.int32()), ("looks", pa.int32())])))

    def read(batches):
        for b in small(batches):
            rows = []
            for text in b.column("text").to_pylist():
                base, cand, codes = _seen(text or "", lists)
                pairs = [{"pattern": x, "looks": y} for x, y in codes]
                rows.append((written(base), ",".join(f"{k}:{a}:{e}" for k, a, e in cand), [y for _, y in codes[len(base) :]], pairs))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "base", "cand", "cand_looks", "spans"])

    return saved(docs.select("doc_id", "text").mapInArrow(read, _FOUND))


def train(found: DataFrame) -> Classifier:
    """The span classifier, from the counts over all documents."""
    spans = found.select(F.inline("spans"))
    seen = sorted(spans.groupBy("pattern").count().collect())  # PATTERNS rows at most
    model = Classifier()
    if not seen:
        model.w[-1] = -30.0
        return model
    _, p = reliabilities(np.array([r[0] for r in seen], int), np.array([r[1] for r in seen], float))
    every = np.zeros(PATTERNS)
    every[[r[0] for r in seen]] = p
    told = F.get(F.array(*map(F.lit, every.tolist())), F.col("pattern"))  # PATTERNS numbers
    sums = spans.groupBy("looks").agg(F.count("*"), F.avg(told)).collect()  # CODES rows at most
    codes, n, rate = (np.array(c) for c in zip(*sorted(sums), strict=True))
    return model.fit(codes.astype(np.int64), n.astype(float), rate)


def find(found: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, base, spans: the base spans and all spans of each document, as text."""

    def pick(batches):
        for b in small(batches):
            out = []
            for base, cand, codes in zip(*(b.column(c).to_pylist() for c in ("base", "cand", "cand_looks")), strict=True):
                more = choose([(p, *s) for p, s in zip(model.probability(codes).tolist(), _spans(cand), strict=True)]) if codes else []
                out.append(written([*_spans(base), *more]) if more else base)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("base"), pa.array(out, pa.string())], ["doc_id", "base", "spans"])

    return found.select("doc_id", "base", "cand", "cand_looks").mapInArrow(pick, "doc_id long, base string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, overlapping ones together, replaced by its kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Classifier, text: str = "text", lists: Lists = LISTS) -> DataFrame:
    """``docs`` with all spans masked in its text; n_chars, if there, follows."""
    ready(docs.sparkSession)

    def mask(batches):
        for b in small(batches):
            out = []
            for t in b.column("row").field(text).to_pylist():
                base, cand, codes = _seen(t or "", lists)
                p = model.probability([y for _, y in codes[len(base) :]]).tolist() if cand else []
                more = choose([(q, *c) for q, c in zip(p, cand, strict=True)])
                out.append(masked(t, [*base, *more]) if base or more else t)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], ["row", "t"])

    wrapped = docs.select(F.struct("*").alias("row"))
    out = wrapped.mapInArrow(mask, T.StructType([*wrapped.schema.fields, T.StructField("t", T.StringType())]))
    cols = [
        F.col("t").alias(c) if c == text else F.length("t").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`")
        for c in docs.columns
    ]
    return out.select(*cols)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    out = find(found, train(found))
    count = lambda k: F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans")
