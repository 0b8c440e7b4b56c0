"""Plain versions of the operators, for small inputs."""

import hashlib
import re

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def private_base(text):
    """Spans (start, kind number, end) of the base patterns."""
    spans = []
    for number, (kind, pattern) in enumerate(BASE):
        for match in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", match[0])
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in match[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fine:
                spans.append((match.start(), number, match.end()))
    return sorted(spans)


def listed(spans):
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)


def fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [words[k:k + 3] for k in range(len(words) - 2)] if len(words) >= 3 else [words]
    hashes = [xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def near(rows, bits=3):
    """{(id, fingerprint): component id} of (id, text) rows, over all pairs."""
    marks = {(i, fingerprint(t)) for i, t in rows}
    return grouped(marks, lambda a, b: bin(a ^ b).count("1") <= bits)


def grouped(marks, linked):
    first = {}
    for i, mark in marks:
        first[mark] = min(i, first.get(mark, i))
    out, left = {}, set(first)
    while left:
        reached, todo = set(), [left.pop()]
        while todo:
            one = todo.pop()
            reached.add(one)
            new = {m for m in left if linked(one, m)}
            left -= new
            todo += new
        least = min(first[m] for m in reached)
        out.update({m: least for m in reached})
    return {(i, mark): out[mark] for i, mark in marks}
