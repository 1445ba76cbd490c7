"""Plain Python versions of what the operators have to return."""

import hashlib
import re

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii_ok(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def pii_base(text):
    text = text or ""
    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text) if pii_ok(k, m.group())]


def pii_row(text):
    spans = pii_base(text)
    counts = tuple(sum(s[0] == k for s in spans) for k in PII)
    return (*counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())


def dedup_bytes(docs, width=100):
    """docs: (id, bytes) with distinct ids. (id, n_bytes, n_removed, n_spans, kept_sha256) of operator 9."""
    seen, out = set(), []
    for k, b in sorted(docs):
        cut = bytearray(len(b))
        for i in range(len(b) - width + 1):
            s = b[i : i + width]
            if s in seen:
                cut[i : i + width] = b"\x01" * width
            seen.add(s)
        spans = sum(1 for i in range(len(b)) if cut[i] and (i == 0 or not cut[i - 1]))
        kept = bytes(c for c, x in zip(b, cut, strict=True) if not x)
        out.append((k, len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return out
