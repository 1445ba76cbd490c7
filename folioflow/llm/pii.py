"""Operator 4, personal data: candidate gradient boosting, run as built-in functions.

Base kinds (email, ip, card, phone) are found by fixed patterns and always kept. High-recall generators then propose
further spans, which may overlap, also within a kind: numbers written like phones without a plus, addresses written with
'at' and 'dot', secrets (keys, tokens, passwords), account and social security numbers, names behind titles, and street
addresses. Boosted trees score each from its format and the text before it; a threshold for each kind, calibrated on
examples that the trees weren't fitted on, selects. Overlapping spans of a kind become their union. The trees are fitted
on the driver from generated examples of fixed number and compiled into one SQL expression.

Defined cases: NULL counts as ''. Each row gives one row, repeated ones too. Only id and text are read, so other
columns may have any names. Positions are code points, ends are exclusive. Patterns use possessive or bounded runs, so
their time is linear in the text. An added span that overlaps a base span is dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The base patterns, in possessive form. A run can't be entered in its middle, except right after a match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs for a match, as a cheap test before the pattern.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}

_TOKEN = r"A-Za-z0-9_+/=-"
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Way|Place"
_WAYS = "rue|avenue|boulevard|place|chemin"
#: By kind: patterns, each with a cheap test that a text with a match passes. Tests begin with a rare character.
GENERATORS = {
    "email": (
        (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]? ?(?:at|AT|@) ?[\])]? ?[A-Za-z0-9-]{1,63}+(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?| (?:dot|DOT) )[A-Za-z]{2,10}+", r"[ \[(](?:dot|DOT)[ \])]"),
        (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,5}", r"[\[({] ?(?:at|AT|@) ?[\])}]"),
    ),
    "phone": (
        (r"(?<![0-9A-Za-z.+(-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?(?![0-9A-Za-z-])", r"[0-9]{2}\)?[ .-][0-9]{2,4}[ .-][0-9]{2}"),
        (r"(?<![0-9A-Za-z.+(-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])(?:[0-9]{2,5}[ ./-]){1,5}[0-9]{2,5}(?![0-9A-Za-z-])", r"[0-9]{2}(?:\) ?|[ ./-])[0-9]{2,5}[ ./-][0-9]{2}"),
        (r"(?<![0-9A-Za-z.+-])[0-9]{9,12}(?![0-9A-Za-z-])", r"[0-9]{9}"),
    ),
    "secret": (
        (rf"(?<![{_TOKEN}])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[{_TOKEN}]{{16,}}+", rf"[0-9](?:[A-Za-z_+/=-]|(?<=[A-Za-z_+/=-][0-9]))"),
        (r"(?<=[=:][ ]?[\x22'])[^\x22'\s]{6,}+(?=[\x22'])", r"[=:] ?[\x22'][^\x22'\s]{6}"),
    ),
    "iban": ((r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),),
    "ssn": ((r"(?<![0-9A-Za-z-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}"),),
    "name": ((
        r"(?<=(?:[Nn]ame is|Name:|Mr|Mr\.|Mrs|Mrs\.|Ms|Ms\.|Dr\.|Herr|Frau|Dear|Monsieur|Madame|Se\xF1or|Se\xF1ora) )[A-Z][a-z\xE0-\xFF]{1,20}(?:[ -][A-Z][a-z\xE0-\xFF]{1,20}){0,2}",
        r"[NnMDHFS](?:ame(?: is|:)|rs?\.?|s\.?|r\.|err|rau|ear|onsieur|adame|e\xF1ora?) [A-Z]",
    ),),
    "address": (
        (rf"(?<![0-9A-Za-z])[0-9]{{1,5}}[A-Za-z]? (?:[A-Z][A-Za-z\xE0-\xFF'.-]{{1,20}} ){{1,4}}(?:{_STREETS})(?![A-Za-z])", r"[0-9][A-Za-z]? [A-Z]"),
        (r"(?<![A-Za-z\xC0-\xFF])[A-Z\xC4\xD6\xDC][a-z\xDF-\xFF]{2,25}(?:stra\xDFe|strasse|weg|platz|allee) [0-9]{1,4}[a-z]?(?![0-9A-Za-z])", r" [0-9](?<=(?:stra\xDFe|strasse|weg|platz|allee) [0-9])"),
        (rf"(?<![0-9A-Za-z])[0-9]{{1,4}}(?: bis| ter)?,? (?:{_WAYS}) (?:(?:de|du|des|la|le|les) ){{0,2}}[A-Z\xC0-\xDD][a-z\xDF-\xFF]{{1,20}}", rf"[0-9](?: bis| ter)?,? (?:{_WAYS}) "),
    ),
}
ADDED = ("secret", "iban", "ssn", "name", "address")
CONTEXT = 40
CUES = r"(?i)(?:phone|tel|call|mobile|cell|fax|whatsapp|contact|reach|mail|write|telefon|t\xE9l|llama)"
ANTI_CUES = r"(?i)(?:order|invoice|version|isbn|sku|serial|ref|part|page|date|score|ratio|total|law|section|commit|sha|md5|checksum|digest|hash|uuid|build|file)"
SECRET_CUES = r"(?i)(?:key|token|secret|passw|pwd|auth|bearer|credential|login|pin|api)[a-z_]{0,12}[\x22']?\s?(?:[:=]|is)?\s?[\x22']?$"
OWN_CUES = r"(?i)(?:iban|account|konto|bank|ssn|social security|lives? (?:at|in)|resid|address|adresse|wohnt|habite|ship(?:ped)? to|name|signed|regards|patient|customer)"
FEATURES = (
    "n_digits", "n_chars", "n_groups", "bracket", "cue", "anti_cue", "year", "first_group", "is_email", "dots", "kind", "secret_cue", "own_cue", "n_letters", "n_upper", "distinct", "check_97",
)


# ---- trees: fitted on the driver, compiled to SQL ----


def remainder_97(number: str) -> int:
    """Of an account number with its first four characters put last and letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4]) or "0") % 97


def features_of(kind: str, before: str, span: str) -> list[float]:
    """The same measures as feature_columns(), for fitting."""
    digits, letters = re.sub("[^0-9]", "", span), re.sub("[^A-Za-z]", "", span)
    first = re.match(r"\(?([0-9]*)", span)[1]
    return [
        len(digits), len(span), len(re.findall("[ .-]", span)), float("(" in span or "[" in span), float(bool(re.search(CUES, before))),
        float(bool(re.search(ANTI_CUES, before))), float(bool(re.match("(?:19|20)[0-9]{2}[ .-]", span))), len(first), float(kind == "email"), span.count("."),
        list(GENERATORS).index(kind), float(bool(re.search(SECRET_CUES, before))), float(bool(re.search(OWN_CUES, before))), len(letters), len(re.sub("[^A-Z]", "", letters)), len(set(span)),
        float(kind == "iban" and remainder_97(re.sub("[^A-Z0-9]", "", span)) == 1),
    ]


def check_97(span: Column) -> Column:
    s = F.regexp_replace(span, "[^A-Z0-9]", "")
    turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97))
    return rest == 1


def feature_columns(x: Column) -> dict[str, Column]:
    span, before, kind = x["span"], x["before"], x["kind"]
    has = lambda c, p: F.when(c.rlike(p), 1).otherwise(0)
    left = lambda p: F.length(F.regexp_replace(span, p, ""))
    code = F.lit(0)
    for i, k in enumerate(GENERATORS):
        code = F.when(kind == k, i).otherwise(code)
    return {
        "n_digits": left("[^0-9]"), "n_chars": F.length(span),
        "n_groups": F.length(span) - left("[ .-]"), "bracket": has(span, r"[(\[]"), "cue": has(before, CUES),
        "anti_cue": has(before, ANTI_CUES), "year": has(span, r"^(?:19|20)[0-9]{2}[ .-]"),
        "first_group": F.length(F.regexp_extract(span, r"^\(?([0-9]*)", 1)), "is_email": F.when(kind == "email", 1).otherwise(0),
        "dots": F.length(span) - F.length(F.replace(span, F.lit("."), F.lit(""))),
        "kind": code, "secret_cue": has(before, SECRET_CUES), "own_cue": has(before, OWN_CUES), "n_letters": left("[^A-Za-z]"), "n_upper": left("[^A-Z]"),
        "distinct": F.size(F.array_distinct(F.filter(F.split(span, ""), lambda c: c != ""))),
        "check_97": F.when((kind == "iban") & F.when(kind == "iban", check_97(span)).otherwise(F.lit(False)), 1).otherwise(0),
    }


def account_number(r: random.Random, valid: bool) -> str:
    while True:
        body = "".join(r.choice("0123456789") for _ in range(r.randint(14, 20)))
        country = r.choice(["DE", "FR", "GB", "ES", "NL", "IT"])
        check = 98 - remainder_97(country + "00" + body)
        if not valid:
            check = (check + r.randint(1, 90)) % 97
        s = f"{country}{check:02d}{body}"
        if (remainder_97(s) == 1) == valid:
            return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))


def examples(n: int = 1200, seed: int = 7, other: bool = False) -> list[tuple[str, str, str, int]]:
    """Generated (kind, text before, span, label). `other` takes other cues, separators and forms, to calibrate and to
    test on what the trees weren't fitted to."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    filler = lambda: " ".join(word() for _ in range(3))
    chars = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    some = lambda a, b: r.choice(b if other else a)
    title = lambda: word().capitalize()
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    out = []
    for _ in range(n):
        cue = some(["call ", "tel: ", "phone ", "my mobile is ", "contact me at ", "Telefon "], ["reach me on ", "fax ", "cell: ", "llama al ", "WhatsApp "])
        anti = some(["order ", "invoice no. ", "version ", "ISBN ", "ref ", "on page ", "date "], ["serial ", "SKU ", "part ", "score ", "section "])
        sep = some("-. ", ".- /")
        match r.randint(0, 17):
            case 0:
                out.append(("phone", filler() + " " + cue, f"{d(3)}{sep}{d(3)}{sep}{d(4)}", 1))
            case 1:
                out.append(("phone", filler() + " ", some([f"({d(3)}) {d(3)}-{d(4)}"], [f"({d(3)}) {d(3)} {d(4)}", f"({d(4)}) {d(3)}-{d(3)}"]), 1))
            case 2:
                out.append(("phone", filler() + " " + cue, sep.join(d(2) for _ in range(r.randint(4, 6))), 1))
            case 3:
                out.append(("phone", filler() + " " + anti, f"{d(r.randint(2, 4))}{sep}{d(r.randint(2, 4))}{sep}{d(r.randint(2, 4))}", 0))
            case 4:
                out.append(("phone", filler() + " ", f"{r.choice(['19', '20'])}{d(2)}{sep}{d(2)}{sep}{d(2)}", 0))
            case 5:
                out.append(("phone", filler() + " ", f"{d(r.randint(2, 3))}{sep}{d(2)}{sep}{d(r.randint(2, 3))}", 0))
            case 6:
                out.append(("email", filler() + " ", some([f"{word()} [at] {word()} [dot] com", f"{word()}(at){word()}.com"], [f"{word()} (at) {word()} (dot) org", f"{word()}[at]{word()}.net"]), 1))
            case 7:
                out.append(("email", filler() + " ", f"{word()} at {word()} dot {word()}", 0))
            case 8:
                out.append(("phone", filler() + " " + cue, d(r.randint(9, 11)), 1))
            case 9:
                out.append(("phone", filler() + " " + some([anti, ""], [anti, ""]), d(r.randint(9, 12)), 0))
            case 10:
                name = some(["token", "api_key", "secret", "password", "auth key"], ["access_token", "private key", "pwd", "credential", "bearer"])
                put = some([" = \"", ": \"", "=", " is "], [" = '", ":", ": ", "=\""])
                out.append(("secret", filler() + f" {name}{put}", chars(some([alnum, "0123456789abcdef"], [alnum, "0123456789ABCDEF", alnum + "_-"]), r.randint(16, 64)), 1))
            case 11:
                out.append(("secret", filler() + some([" commit ", " sha ", " build ", " file "], [" md5 ", " digest ", " uuid "]), chars("0123456789abcdef", r.choice([32, 40, 64])), 0))
            case 12:
                plain = some([f"{word()}-{word()}-{word()}-{d(2)}", f"{word()}_{word()}_{word()}{d(1)}", f"{d(4)}-{d(2)}-{d(2)}T{d(6)}Z"], [f"{word()}/{word()}/{word()}/{d(4)}", f"{word()}{word()}{word()}{d(2)}"])
                out.append(("secret", filler() + some([" ", " = \"", ": '"], [" ", "=\""]), plain, 0))
            case 13:
                valid = r.random() < 0.5
                out.append(("iban", filler() + some([" IBAN ", " account ", " "], [" Konto ", " bank: ", " "]), account_number(r, valid), int(valid)))
            case 14:
                own = r.random() < 0.5
                out.append(("ssn", filler() + (some([" SSN ", " social security number "], [" ssn: ", " patient "]) if own else " " + anti), f"{d(3)}-{d(2)}-{d(4)}", int(own)))
            case 15:
                own = r.random() < 0.6
                before = some(["my name is ", "Name: ", "signed, Mr. "], ["patient Mrs. ", "customer Dr. "]) if own else some(["Dear ", "Madame "], ["Dear ", "Frau "])
                out.append(("name", filler() + " " + before, f"{title()} {title()}" if own else title(), int(own)))
            case 16:
                own = r.random() < 0.7
                street = some([f"{d(3)} {title()} Street", f"{title()}stra\xdfe {d(2)}"], [f"{d(2)} {title()} Avenue", f"{d(2)} rue de {title()}", f"{title()}weg {d(1)}"])
                out.append(("address", filler() + some([" lives at ", " address: "], [" resident of ", " shipped to "]) if own else filler() + " " + anti, street, int(own)))
            case 17:
                out.append(("secret", filler() + some([" password = \"", " pwd: '"], [" login = '", " secret:\""]), chars(alnum + "!#$%", r.randint(8, 14)), 1))
    return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3) -> tuple[float, list[tuple]]:
    """Logistic gradient boosting of two-level trees. Returns the base score and trees as nested tuples
    (feature, cut, left, right) with leaf values."""

    def split(rows: np.ndarray, depth: int):
        g, h = grad[rows].sum(), hess[rows].sum()
        leaf = float(rate * g / (h + 1.0))
        if depth == 0 or len(rows) < 10:
            return leaf
        best, found = 1e-6, None
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[1:]:
                left = x[rows, f] < cut
                gl, hl = grad[rows[left]].sum(), hess[rows[left]].sum()
                gain = gl**2 / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - g**2 / (h + 1.0)
                if gain > best:
                    best, found = gain, (f, float(cut), left)
        if found is None:
            return leaf
        f, cut, left = found
        return (f, cut, split(rows[left], depth - 1), split(rows[~left], depth - 1))

    def value(tree, rows: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(rows), tree)
        f, cut, a, b = tree
        return np.where(rows[:, f] < cut, value(a, rows), value(b, rows))

    base = float(np.log(y.mean() / (1 - y.mean())))
    score, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        trees.append(split(np.arange(len(y)), 3))
        score += value(trees[-1], x)
    return base, trees


def scored(base: float, trees: list, x: np.ndarray) -> np.ndarray:
    def one(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
        return tree

    return np.array([base + sum(one(t, row) for t in trees) for row in x])


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling by Newton steps: p = 1 / (1 + exp(-(a * score + b)))."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * score + b)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * score).sum() - 1e-2 * (a - 1), (y - p).sum() - 1e-2 * b])
        h = np.array([[(w * score * score).sum() + 1e-2, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
    return float(a), float(b)


@lru_cache(maxsize=4)
def model(n: int = 2400, seed: int = 7) -> tuple[float, tuple, float, float]:
    rows = examples(n, seed) + examples(n // 2, seed + 1, other=True)
    x = np.array([features_of(*r[:3]) for r in rows], dtype=float)
    y = np.array([r[3] for r in rows], dtype=float)
    fit = np.arange(len(y)) < n  # the other forms calibrate
    base, trees = fit_trees(x[fit], y[fit])
    a, b = calibrate(scored(base, trees, x[~fit]), y[~fit])
    return base, tuple(trees), a, b


#: Share of the selected spans that has to be right on the examples that calibrate.
PRECISION = 0.97


@lru_cache(maxsize=4)
def thresholds(n: int = 2400, seed: int = 7) -> dict[str, float]:
    """For each kind, on examples of other forms: the middle between the least probability down to which PRECISION is
    kept and the next one below."""
    base, trees, a, b = model(n, seed)
    rows = examples(5 * n // 2, seed + 2, other=True)
    p = 1 / (1 + np.exp(-(a * scored(base, list(trees), np.array([features_of(*r[:3]) for r in rows], dtype=float)) + b)))
    out = {}
    for kind in GENERATORS:
        at = np.array([r[0] == kind for r in rows])
        order = np.argsort(-p[at])
        q, y = p[at][order], np.array([r[3] for r in rows])[at][order]
        right = np.cumsum(y) / np.arange(1, len(y) + 1)
        good = np.flatnonzero((right >= PRECISION) & (np.append(q[1:], -1.0) < q))
        out[kind] = float((q[good[-1]] + np.append(q, 0.0)[good[-1] + 1]) / 2) if len(good) else 1.1
    return out


def tree_column(tree, feature: dict[str, Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, cut, left, right = tree
    return F.when(feature[FEATURES[f]] < cut, tree_column(left, feature)).otherwise(tree_column(right, feature))


def probability(feature: dict[str, Column], fitted) -> Column:
    base, trees, a, b = fitted
    total = F.lit(base)
    for t in trees:
        total = total + tree_column(t, feature)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total * a + b)))


# ---- spans ----

FOUND = "array<struct<kind:string,start:int,end:int,span:string,before:string>>"
SPAN = "array<struct<kind:string,start:int,end:int,span:string>>"
PLACE = "array<struct<kind:string,start:int,end:int>>"


def matches(text: Column, kind: str, pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches of a pattern as spans, with the text before each. The pieces between matches
    give the positions; texts that fail the cheap test aren't searched."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(m: Column) -> Column:
        zero = F.struct(F.array().cast(FOUND).alias("out"), F.lit(0).alias("at"), F.lit(0).alias("i"))

        def step(acc: Column, piece: Column) -> Column:
            start = acc["at"] + F.length(piece)
            hit = F.get(m, acc["i"])
            end = start + F.length(hit)
            one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), hit.alias("span"), F.right(piece, F.lit(CONTEXT)).alias("before"))
            # the last piece has no match behind it
            out = F.when(hit.isNotNull(), F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
            return F.struct(out.alias("out"), F.coalesce(end, start).alias("at"), (acc["i"] + 1).alias("i"))

        spans = F.aggregate(F.split(text, pattern, -1), zero, step)["out"]
        return F.when(F.size(m) > 0, spans).otherwise(F.array().cast(FOUND))

    searched = F.get(F.transform(F.array(found), located), 0)
    return F.when(text.rlike(needs), searched).otherwise(F.array().cast(FOUND))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True where a string of 13 to 19 digits passes."""
    back = F.reverse(number)
    digit = lambda i: F.substr(back, i, F.lit(1))
    doubled = lambda i: F.substr(F.lit("0246813579"), digit(i).cast("int") + 1, F.lit(1))
    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(i)).otherwise(digit(i)).cast("int"))
    return total % 10 == 0


def valid(kind: str):
    """The check that a base match has to pass."""

    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: F.forall(F.split(x["span"], r"\."), small),
        "card": lambda x: F.when(F.length(digits(x["span"])).between(13, 19), luhn(digits(x["span"]))).otherwise(F.lit(False)),
        "phone": lambda x: F.length(digits(x["span"])).between(9, 15),
    }[kind]


def text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def union_of(spans: Column, text: Column) -> Column:
    """Spans of one kind, by start, with those that overlap as one."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joint = F.struct(x["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        own = F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
        meets = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > x["start"])
        return F.when(meets, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joint))).otherwise(F.concat(acc, F.array(own)))

    whole = F.aggregate(F.array_sort(spans, by_start), F.array().cast(PLACE), step)
    cut = F.transform(whole, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.substr(text, x["start"] + 1, x["end"] - x["start"]).alias("span")))
    return F.when(F.size(spans) == 0, F.array().cast(SPAN)).otherwise(cut)


def find_pii(docs: DataFrame, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row an input row: id, text, counts, base (spans of the base kinds), spans (all, by kind and start). A
    threshold stands in for the calibrated ones. With carry, also _row, a struct of the input's columns without the
    text, and _none, whether that was NULL."""
    kept = [F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_row"), F.col(text_col).isNull().alias("_none")] if carry else []
    fitted, least = model(), thresholds()
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), *kept)
    t, kept = F.col("_t"), ["_row", "_none"] if carry else []
    plain = lambda x: F.struct(*[x[k].alias(k) for k in ("kind", "start", "end", "span")])
    base = {k: F.transform(F.filter(matches(t, k, BASE[k], NEEDS[k]), valid(k)), plain).alias(f"_b_{k}") for k in KINDS}
    proposed = F.concat(*[matches(t, k, p, needs) for k, ps in GENERATORS.items() for p, needs in ps])
    d = d.select("_id", "_t", *kept, *base.values(), proposed.alias("_c"))
    d = d.withColumn("_base", F.concat(*[F.col(f"_b_{k}") for k in KINDS]))
    clear = lambda x: ~F.exists("_base", lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"]))
    measured = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.struct(*[c.cast("double").alias(k) for k, c in feature_columns(x).items()]).alias("f"))
    cuts = F.create_map(*[F.lit(v) for k, c in least.items() for v in (k, c if threshold is None else float(threshold))])
    likely = F.filter(F.transform(F.filter("_c", clear), measured), lambda x: probability({f: x["f"][f] for f in FEATURES}, fitted) >= F.element_at(cuts, x["kind"]))
    d = d.withColumn("_a", F.when(F.size("_c") == 0, F.array().cast(PLACE)).otherwise(F.transform(likely, lambda x: F.struct(*[x[k].alias(k) for k in ("kind", "start", "end")]))))
    of_kind = lambda k: union_of(F.filter("_a", lambda x: x["kind"] == k), t)
    d = d.select("_id", "_t", *kept, "_base", *[f"_b_{k}" for k in KINDS], *[of_kind(k).alias(f"_a_{k}") for k in GENERATORS])
    both = lambda k: F.when(F.size(f"_a_{k}") == 0, F.col(f"_b_{k}")).otherwise(F.array_sort(F.concat(f"_b_{k}", f"_a_{k}"), by_start))
    whole = [both(k) if k in GENERATORS else F.col(f"_b_{k}") for k in KINDS] + [F.col(f"_a_{k}") for k in ADDED]
    counts = [F.size(f"_b_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS]
    return d.select(F.col("_id").alias(id_col), F.col("_t").alias(text_col), *counts, F.col("_base").alias("base"), F.concat(*whole).alias("spans"), *kept)


def by_start(a: Column, b: Column) -> Column:
    return F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["end"] - b["end"])


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by [KIND]; spans that overlap go as a whole, under the first one's kind."""
    ordered = F.array_sort(spans, by_start)
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.substr(text, acc["at"] + 1, x["start"] - acc["at"])
        put = F.concat(acc["out"], F.array(piece, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))
        wider = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))
        return F.when(x["start"] < acc["at"], wider).otherwise(F.struct(put.alias("out"), x["end"].alias("at")))

    done = lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, zero, step, done))


def query(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))
