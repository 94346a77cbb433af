"""Personal data by boosted trees over candidate spans.

High-recall generators propose overlapping spans: the four base kinds (email,
ip, card, phone) and looser ones (spaced emails, national phone numbers,
social-security-like numbers, bank accounts, and secrets: long keys, keys with
an issuer's prefix, values after labels such as ``password:``, private keys in
PEM blocks). Gradient-boosted trees score each loose candidate by its format and
its context. A threshold for each kind, calibrated on examples of forms and
look-alikes that the trees were not grown from, selects
redactions; of those of a kind that lie in each other the outer one stays, of
others that overlap the likelier. Base spans always stay.

The trees are trained here, on examples that are made from a fixed seed: real
forms in telling contexts against look-alikes (order numbers, dates, versions,
sums, paths, hashes in plain prose).

Defined cases: null and empty texts have no spans; offsets are code points, end
exclusive; texts and spans may be of any length, and time grows with them; of
overlapping candidates of equal score the first by kind and start stays;
repeated rows give equal rows; an empty table gives no rows; columns that clash
with results are replaced, the text is left out, other columns stay.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import map_arrow

BASE = ("email", "ip", "card", "phone")
LOOSE = ("email", "phone", "ssn", "iban", "secret")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match cannot begin inside a run of digits: what fails at the run's first digit fails at the others.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ backwards."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            low = m.end()
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not any(c in text for c in "0123456789"):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g[-9:]) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


#: How issued access keys begin.
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-")
#: Loose generators: a kind, a pattern, and one that a text must have for the pattern to be worth a try. Where there is a
#: group ``v`` it is the span. Runs are taken whole (possessively), so no pattern goes back over a long one.
GENERATORS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({<] ?at ?[\])}>] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({<] ?dot ?[\])}>]) ?[A-Za-z]{2,}+)+", re.I), re.compile(r"[\[({<] ?at ?[\])}>]", re.I)),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z]{2,}+)+", re.I), re.compile(" dot ", re.I)),
    ("phone", re.compile(r"(?<![0-9+(])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,4}){2,4}+(?![0-9]|[ ./-][0-9]{2})"), re.compile(r"[0-9][ ./)-]+[0-9]")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"), re.compile(r"[0-9][- ][0-9]")),
    ("iban", re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), re.compile(r"[A-Z]{2}[0-9]{2}")),
    ("secret", re.compile(r"(?<![0-9A-Za-z_/+-])(?=[A-Za-z_/+-]*+[0-9])[0-9A-Za-z_/+-]{20,}+={0,2}"), re.compile(r"[0-9A-Za-z_/+-]{20}")),
    ("secret", re.compile(r"(?<![0-9A-Za-z_-])(?=[0-9A-Za-z_-]*+[0-9])[0-9A-Za-z_-]{20,}+"), re.compile(r"[0-9A-Za-z_-]{20}")),
    ("secret", re.compile(r"(?<![0-9A-Za-z_.-])eyJ[0-9A-Za-z_-]{8,}+(?:\.[0-9A-Za-z_-]{4,}+){1,2}"), re.compile("eyJ")),
    ("secret", re.compile(rf"(?<![0-9A-Za-z_-])(?:{'|'.join(KEY_PREFIXES)})[0-9A-Za-z_-]{{12,}}+"), re.compile("|".join(KEY_PREFIXES))),
    ("secret", re.compile(r"(?i:pass(?:word|wd|phrase|code)|pwd|secret|api[ _-]?key|access[ _-]?key|token|credentials?)[\"']?(?:[ \t]{0,3}[:=]|[ \t]is\b)[ \t]{0,3}[\"']?(?P<v>[^\s\"'<>,;]{4,}+)"), re.compile(r"pass|pwd|secret|key|token|credential", re.I)),
    ("secret", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----.*?(?:-----END [A-Z ]{0,40}PRIVATE KEY-----|\Z)", re.S), re.compile("-----BEGIN ")),
)
#: Words that tell what a number near them is.
CUES = {
    "email": ("mail", "contact", "write", "courriel", "correo"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp", "appel", "anruf", "llama"),
    "ssn": ("ssn", "social", "security", "insur"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
    "secret": ("key", "token", "secret", "password", "passwd", "pwd", "auth", "api", "bearer", "credential"),
}
AGAINST = ("order", "invoice", "version", "date", "isbn", "page", "room", "commit", "sha", "md5", "checksum", "hash", "part", "item", "ref", "uuid", "build", "eur", "usd", "score")
#: The last labels of most addresses.
DOMAINS = frozenset("com org net edu gov info biz io co us uk ca au de fr es it nl eu ch at be pl pt br in jp cn ru".split())
_LETTERS = re.compile(r"[a-z]+")


def iban_ok(value: str) -> bool:
    s = value.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _wordiness(s: str) -> float:
    """The share of s in runs of three small letters or more, or with one capital first, that have vowels: what slugs, paths and names of code are made of."""
    return sum(len(r) for r in re.findall(r"[A-Z]?[a-z]{2,}", s) if len(r) > 2 and re.search("[aeiouy]", r, re.I)) / len(s)


def candidate_features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 16].lower()
    digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
    counts = np.bincount(np.frombuffer(s.encode("utf-8", "surrogatepass"), np.uint8))
    p = counts[counts > 0] / counts.sum()
    near = _LETTERS.findall(before)
    tail = before.rstrip()[-1:]
    return [
        float(LOOSE.index(kind)),
        float(len(s)),
        float(digits),
        digits / len(s),
        letters / len(s),
        float(-(p * np.log2(p)).sum()),
        float(len(re.findall(r"[0-9]+", s))),
        float(len({*re.findall(r"[ ./-]", s)})),
        float(s[0] == "("),
        float(any(c in w for w in near for c in CUES[kind])),
        float(any(w in AGAINST for w in near[-4:])),
        float(tail in "=:" and tail != ""),
        float(tail in "\"'" and tail != ""),
        float(after[:1].isalnum()),
        float(kind == "iban" and iban_ok(s)),
        float(kind == "email" and bool(re.search(r"[a-z] ?(?:\.|[\[({<]? ?dot\b)", s, re.I))),
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s))),
        float(s.startswith(KEY_PREFIXES)),
        float(s.startswith("-----BEGIN ")),
        float(sum(c in "/_+-" for c in s)) / len(s),
        float(any(c.islower() for c in s) + any(c.isupper() for c in s) + (digits > 0) + any(not c.isalnum() for c in s)),
        float(max(map(len, _LETTERS.findall(s.lower())), default=0)),
        float(kind == "email" and s.lower().rstrip(".").replace(" ", ".").rsplit(".", 1)[-1] in DOMAINS),
        float(len(re.findall(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])", s))),
        _wordiness(s),
        sum(c in "aeiouAEIOU" for c in s) / max(letters, 1),
        float("://" in before.split(" ")[-1] or before[-1:] in "/."),
        float(s.startswith("eyJ")),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s))),
        float(bool(re.match(r"(?:19|20)[0-9]{2}[-/.]|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)", s))),
    ]


# ---------------------------------------------------------------- boosted trees


class Trees:
    """Logistic gradient boosting of small trees over quantile bins."""

    def __init__(self, rounds: int = 100, depth: int = 3, rate: float = 0.2, least: int = 10, l2: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.least, self.l2 = rounds, depth, rate, least, l2
        self.base = 0.0
        self.trees: list[list[tuple[int, float, float]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        mean = y.mean()
        self.base = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            self._grow(tree, 0, 0, np.arange(len(y)), x, y - p, p * (1 - p), edges)
            self.trees.append(tree)
            score += self._one(tree, x)
        return self

    def _grow(self, tree: list, node: int, depth: int, rows: np.ndarray, x: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> None:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        tree[node] = (-1, 0.0, self.rate * total_g / (total_h + self.l2))
        if depth == self.depth or len(rows) < 2 * self.least:
            return
        best, chosen = 1e-6, None
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            b = np.searchsorted(cuts, x[rows, f], side="left")  # bin i: up to cuts[i]
            size = len(cuts) + 1
            lg, lh, ln = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
            gain = lg**2 / (lh + self.l2) + (total_g - lg) ** 2 / (total_h - lh + self.l2) - total_g**2 / (total_h + self.l2)
            gain[(ln < self.least) | (len(rows) - ln < self.least)] = 0
            i = int(gain.argmax())
            if gain[i] > best:
                best, chosen = gain[i], (f, float(cuts[i]))
        if chosen:
            tree[node] = (*chosen, tree[node][2])
            left = x[rows, chosen[0]] <= chosen[1]
            self._grow(tree, 2 * node + 1, depth + 1, rows[left], x, g, h, edges)
            self._grow(tree, 2 * node + 2, depth + 1, rows[~left], x, g, h, edges)

    def _one(self, tree: list, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            f, cut, value = tree[node]
            if f < 0:
                out[rows] = value
            else:
                left = x[rows, f] <= cut
                todo += [(2 * node + 1, rows[left]), (2 * node + 2, rows[~left])]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum(self._one(t, x) for t in self.trees))))


def _examples(n: int, seed: int, hard: bool = False) -> list[tuple[str, str, int, int, bool]]:
    """Made-up texts with a candidate each: text, kind, start, end, whether it is personal data.

    Half of the hard ones are of forms that the others do not have, with any word or none before them.
    """
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    plain = "we met on the old road and he said that all of it was sent by post with a copy for you la casa es muy grande y ella no lo sabe der hund ist nicht hier und wir gehen nach hause le chat est sous la table avec nous".split()
    made = lambda: "".join(rng.choice(("an", "er", "the", "on", "re", "ti", "mo", "la", "de", "st")) for _ in range(rng.randint(1, 4)))
    word = lambda: rng.choice(plain) if rng.random() < 0.5 else made()
    prose = lambda k: " ".join(word() for _ in range(k))
    key = lambda: "".join(rng.choice(rng.choice(("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))) for _ in range(rng.randint(24, 64)))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def iban(good: bool) -> str:
        land, rest = rng.choice(("DE", "FR", "ES", "GB")), digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in rest + land + "00")) % 97
        if not good:
            check = (check + rng.randint(1, 50)) % 97
        s = f"{land}{check:02d}{rest}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    b64 = lambda k: "".join(rng.choice(letters + "0123456789-_") for _ in range(k))
    name = lambda: f"{made()}{rng.choice(('.', '_', ''))}{made()}{rng.choice(('', digits(2)))}"
    slug = lambda k, sign: sign.join(rng.choice((word(), word(), digits(rng.choice((2, 4))))) for _ in range(k))


    def prefixed() -> str:
        alphabet = rng.choice((letters[:26] + "0123456789", letters + "0123456789", letters))
        return rng.choice(KEY_PREFIXES) + "".join(rng.choice(alphabet) for _ in range(rng.randint(16, 40)))

    def own_form(kind: str, good: bool) -> str:
        """Forms beyond the plainest: those of the training set, or those kept for calibration."""
        pick = lambda *forms: forms[rng.choice(range(1, len(forms), 2) if hard else range(0, len(forms), 2))]()
        if kind == "email":
            tld = rng.choice(("com", "org", "de", "fr", "io", "co.uk"))
            if good:
                return pick(lambda: f"{name()} (at) {made()} (dot) {tld}", lambda: f"{name()}[at]{made()}.{tld}", lambda: f"{name()} at {made()} dot {tld}", lambda: f"{name()} {{at}} {made()} {{dot}} {tld}", lambda: f"{name()}<at>{made()}<dot>{tld}", lambda: f"{name()} [AT] {made()} [DOT] {tld}")
            return pick(lambda: f"{word()} (at) {word()}. {word()}", lambda: f"{word()} at {word()} dot {word()}", lambda: f"{word()} [at] {word()} . {word()}", lambda: f"{digits(1)} (at) {digits(2)}.{word()}")
        if kind == "phone":
            if good:
                return pick(lambda: f"0{digits(1)}" + "".join(f" {digits(2)}" for _ in range(4)), lambda: f"0{digits(1)}" + "".join(f".{digits(2)}" for _ in range(4)), lambda: f"0{digits(3)} {digits(3)} {digits(4)}", lambda: f"({digits(3)}) {digits(3)} {digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"0{digits(2)}/{digits(3)} {digits(3)}")
            return pick(lambda: f"{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}".replace(" 0", " 1").lstrip("0") or "10 20 30", lambda: f"{digits(2)}.{digits(3)}.{digits(3)}", lambda: f"{rng.randint(1900, 2040)} {rng.randint(1900, 2040)} {rng.randint(1900, 2040)}", lambda: f"{digits(2)}-{digits(2)}-{digits(4)}", lambda: f"{digits(3)}-{digits(2)}-{digits(3)}", lambda: f"{digits(2)}/{digits(2)}/{digits(2)}")
        if kind == "ssn":
            return f"{digits(3)}{rng.choice('- ')}{digits(2)}"[:3] + (sign := rng.choice("- ")) + digits(2) + sign + digits(4)
        if kind == "iban":
            return iban(good)
        if good:
            return pick(lambda: f"eyJ{b64(20)}.eyJ{b64(60)}.{b64(43)}", lambda: f"eyJ{b64(33)}.{b64(90)}.{b64(64)}", lambda: b64(rng.randint(30, 60)), lambda: hexa(rng.choice((48, 64))), lambda: f"{made()}_{b64(32)}", lambda: f"{hexa(16)}-{hexa(16)}", prefixed, prefixed)
        return pick(
            lambda: slug(rng.randint(4, 9), "-"), lambda: slug(rng.randint(4, 9), "_"), lambda: "/".join(made() for _ in range(rng.randint(3, 6))) + f"/{rng.randint(1990, 2030)}/{slug(4, '_')}", lambda: "/".join(word() for _ in range(4)) + f"/{slug(5, '-')}",
            lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", lambda: f"IMG_{digits(8)}_{digits(6)}_{made()}", lambda: digits(rng.randint(20, 30)), lambda: f"{made()}{made().title()}{made().title()}{made().title()}{digits(2)}", lambda: hexa(40), lambda: f"section-{digits(2)}-{made()}-{made()}-{made()}",
        )

    def in_context(kind: str, good: bool) -> tuple[str, str]:
        s = own_form(kind, good)
        lead = rng.choice((*CUES[kind], *CUES[kind], "", word())) if good else rng.choice((*AGAINST, "", "", word(), word()))
        if kind == "ssn":
            lead = rng.choice(CUES[kind] if good else AGAINST)
        if kind == "secret" and good and not s.startswith(("eyJ", *KEY_PREFIXES)):
            lead = rng.choice(CUES[kind])
        if kind == "phone" and good and rng.random() < 0.7:
            lead = rng.choice(CUES[kind])
        link = kind == "secret" and not good and rng.random() < 0.5
        return f"{prose(rng.randint(0, 8))} {lead}{rng.choice(('https://', 'www.', '/', 'see '))}{made()}.{rng.choice(('com', 'org'))}/" if link else f"{prose(rng.randint(0, 8))} {lead}{rng.choice((' ', ': ', '=')) if good else rng.choice((' ', ' ', ': '))}", s

    out = []
    while len(out) < n:
        kind, good = rng.choice(LOOSE), rng.random() < 0.5
        if rng.random() < 0.5:
            head, s = in_context(kind, good)
            text = f"{head}{s}{rng.choice((' ', '. ', ', ', chr(10)))}{prose(rng.randint(0, 5))}"
            near = [(a, b) for k, a, b in loose_candidates(text) if k == kind and a < len(head) + len(s) and b > len(head)]
            if near:
                a, b = max(near, key=lambda x: min(x[1], len(head) + len(s)) - max(x[0], len(head)))
                out.append((text, kind, a, b, good))
            continue
        cue = rng.choice(CUES[kind] + ("my", "") if good else AGAINST + ("", "", word()))
        if kind == "email":
            at, dot = rng.choice(((" (at) ", "."), ("[at]", " [dot] "), (" {at} ", "."), ("(AT)", "(DOT)")))
            s = f"{word()}.{word()}{at}{word()}{dot}{rng.choice(('com', 'org', 'net', 'de'))}" if good else f"{rng.choice(('look', 'meet', 'only', '5', 'up'))} (at) {word()}. {word()}"
        elif kind == "phone":
            sep = rng.choice("- .")
            s = rng.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(2)}{sep}{digits(3)}{sep}{digits(4)}", f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}")) if good else rng.choice((f"{rng.randint(1900, 2050)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{rng.randint(1990, 2030)}", f"{digits(2)}.{digits(2)}.{digits(2)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(2)} {digits(2)} {digits(2)}"))
            cue = cue if not good or rng.random() < 0.2 else rng.choice(CUES[kind])
        elif kind == "ssn":
            s = f"{digits(3)}-{digits(2)}-{digits(4)}"
            cue = rng.choice(CUES[kind]) if good else rng.choice(AGAINST)
        elif kind == "iban":
            s = iban(good)
        else:
            s = key() if good else rng.choice((hexa(40), hexa(32), f"{word()}-{word()}-{word()}-{digits(4)}-{word()}-{word()}", digits(24), f"{word()}_{word()}_{word()}_{digits(2)}_{word()}"))
            cue = rng.choice(CUES[kind]) if good else rng.choice(AGAINST + ("", word(), word()))
            form = rng.random()
            mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
            alphabet = rng.choice((mixed, mixed + "0123456789", mixed[:26] + "0123456789"))
            if form < 0.3:
                s, cue = (rng.choice(KEY_PREFIXES) + "".join(rng.choice(alphabet) for _ in range(rng.randint(14, 40))), rng.choice((cue, "", word(), word()))) if good else (f"{rng.choice(('task-', 'risk-', 'desk-'))}{made()}-{made()}-{made()}-{made()}", word())
            elif form < 0.45:
                s, cue = ("".join(rng.choice(mixed + "0123456789/+") for _ in range(40)), cue) if good else (f"{'/'.join(made() for _ in range(rng.randint(3, 7)))}/{made()}{digits(2)}", rng.choice(AGAINST + ("", word())))
            elif form < 0.6:
                label = rng.choice(("password", "passwd", "pwd", "passphrase", "secret", "api_key", "access key", "token"))
                s = "".join(rng.choice(mixed + "0123456789!#$%&*@") for _ in range(rng.randint(6, 20))) if good else rng.choice(plain + [made()])
                out.append((f"{prose(rng.randint(0, 6))} {label}: {s} {prose(3)}", kind, 0, len(s), good))
                text = out[-1][0]
                at = text.index(f": {s} ") + 2
                out[-1] = (text, kind, at, at + len(s), good)
                if len(s) < 4:
                    out.pop()
                continue
            elif form < 0.65 and good:
                body = "\n".join("".join(rng.choice(mixed + "0123456789+/") for _ in range(64)) for _ in range(rng.randint(2, 12)))
                s, cue = f"-----BEGIN {rng.choice(('RSA ', 'EC ', ''))}PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----", word()
        glue = rng.choice((" ", ": ", " = ", ' = "', "=")) if good else rng.choice((" ", " ", " ", ": "))
        head = f"{prose(rng.randint(0, 8))} {cue}{glue}"
        text = f"{head}{s}{rng.choice((' ', '. ', ', ', chr(34) + ' '))}{prose(rng.randint(0, 5))}"
        near = [(a, b) for k, a, b in loose_candidates(text) if k == kind and a < len(head) + len(s) and b > len(head)]
        if near:
            a, b = max(near, key=lambda x: min(x[1], len(head) + len(s)) - max(x[0], len(head)))
            out.append((text, kind, a, b, good))
    return out


#: Below this nothing is selected, however rare wrong choices are among examples.
LEAST_SCORE = 0.1


@cache
def trained(seed: int = 7, n: int = 9000, precision: float = 0.98) -> tuple[Trees, dict[str, float]]:
    """The trees, and for each kind the lowest threshold from which on chosen examples are right with that precision.

    Thresholds are calibrated on other examples than the trees are grown from: half of them are of forms and look-alikes
    that these never saw, so scores are as unsure there as on texts of the table.
    """
    rows, other = _examples(n, seed), _examples(n // 2, seed + 1, hard=True)
    x, z = (np.array([candidate_features(*r[:4]) for r in part]) for part in (rows, other))
    y, right = (np.array([r[4] for r in part], float) for part in (rows, other))
    trees = Trees().fit(x, y)
    p, thresholds = trees.predict(z), {}
    for i, kind in enumerate(LOOSE):
        own = z[:, 0] == i
        order = np.argsort(-p[own], kind="stable")
        score, hits = p[own][order], np.cumsum(right[own][order])
        last = np.append(score[1:] < score[:-1], True)  # a threshold takes all of one score
        fine = np.flatnonzero(last & (hits >= precision * np.arange(1, len(hits) + 1)))
        thresholds[kind] = max(LEAST_SCORE, float(score[fine[-1]])) if len(fine) else 1.0
    return trees, thresholds


# ---------------------------------------------------------------- spans


def loose_candidates(text: str) -> list[tuple[str, int, int]]:
    """Candidates of all generators by kind and start, each once."""
    return sorted({(kind, *(m.span("v") if "v" in pattern.groupindex else m.span())) for kind, pattern, has in GENERATORS if has.search(text) for m in pattern.finditer(text)})


def _within(base: list[tuple[str, int, int]], candidates: list[tuple[str, int, int]]) -> list[bool]:
    """Whether each candidate lies in a base span."""
    spans = sorted((a, b) for _, a, b in base)
    starts, furthest = [a for a, _ in spans], np.maximum.accumulate([b for _, b in spans] or [0]).tolist()
    at = [bisect_right(starts, a) for _, a, _ in candidates]
    return [i > 0 and furthest[i - 1] >= b for i, (_, _, b) in zip(at, candidates)]


def _outermost(passed: list[tuple[float, tuple[str, int, int]]]) -> list[tuple[float, tuple[str, int, int]]]:
    """Those that lie in no other one of their kind."""
    kept, end = [], {}
    for q, (kind, a, b) in sorted(passed, key=lambda z: (z[1][1], -z[1][2])):
        if b > end.get(kind, -1):
            kept.append((q, (kind, a, b)))
            end[kind] = b
    return kept


def select(texts: list[str], trees: Trees, thresholds: dict[str, float]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Base spans and all spans of each text; loose ones may reach beyond a base span, not lie within one."""
    base = [base_spans(t) for t in texts]
    found = []
    for t, own in zip(texts, base):
        candidates = loose_candidates(t)
        found.append([c for c, inside in zip(candidates, _within(own, candidates)) if not inside])
    x = [candidate_features(t, *c) for t, own in zip(texts, found) for c in own]
    p = iter(trees.predict(np.array(x)).tolist() if x else [])
    out = []
    for own, candidates in zip(base, found):
        chosen: list[tuple[int, int, str]] = []
        passed = [(q, c) for q, c in ((next(p), c) for c in candidates) if q >= thresholds[c[0]]]
        for _, (kind, a, b) in sorted(_outermost(passed), key=lambda z: (-z[0], z[1])):
            i = bisect_left(chosen, (a,))
            if not (i < len(chosen) and chosen[i][0] < b) and not (i and chosen[i - 1][1] > a):
                insort(chosen, (a, b, kind))
        out.append((own, own + [(kind, a, b) for a, b, kind in chosen]))
    return out


KIND_ORDER = {k: i for i, k in enumerate(dict.fromkeys(BASE + LOOSE))}


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    """``kind:start:end`` by kind, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KIND_ORDER[s[0]], s[1], s[2])))


def redact_text(text: str, spans: Iterable[tuple[str, int, int]]) -> str:
    """text with each span as ``[KIND]``; overlapping spans as one, named after the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, text: str = "text", redacted: bool = False) -> DataFrame:
    """docs without the text, with ``n_email, n_ip, n_card, n_phone`` (base
    matches), ``base_sha256``, ``spans``, ``n_spans``, ``personal`` (whether there
    is any span) and, if asked for, the ``redacted`` text."""
    counts = [f"n_{k}" for k in BASE]
    names = [*counts, "base_sha256", "spans", "n_spans", "personal", *(["redacted"] if redacted else [])]
    kept = [c for c in docs.columns if c not in (text, *names)]
    model = docs.sparkSession.sparkContext.broadcast(trained())

    def make():
        trees, thresholds = model.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            found = select(texts, trees, thresholds)
            columns = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE]
            columns += [pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([joined(every) for _, every in found], pa.string())]
            columns += [pa.array([len(every) for _, every in found], pa.int64()), pa.array([bool(every) for _, every in found], pa.bool_())]
            if redacted:
                columns.append(pa.array([redact_text(t, every) for t, (_, every) in zip(texts, found)], pa.string()))
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *names])

        return each

    types = [*(F.lit(0).cast("long").alias(c) for c in counts), F.lit("").alias("base_sha256"), F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_spans"), F.lit(False).alias("personal"), *(F.lit("").alias(c) for c in names[8:])]
    return map_arrow(docs, make, docs.select(*kept, *types).schema, rows=500)
