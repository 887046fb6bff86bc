"""Plain versions of the operators for small inputs, and awkward rows to run them on."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"

WORDS = (
    "the quick brown fox jumps over a lazy dog while seven red birds watch from old trees near some quiet river and nobody "
    "knows why it rains each time when they sing about summer bread or winter salt under blue stars"
).split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * (3 + seed % 5) + i * i // 3) % len(WORDS)] for i in range(n))


def awkward() -> list[tuple]:
    """Nulls in every column, empty, blank and letterless texts, one very long text, ties and repeated rows."""
    base = prose(1, 40)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base.upper(), None, None, None),
        (4, None, "en", "a", 0), (5, "", "en", "b", 0), (6, " \n\t ", None, "b", 4), (None, prose(2, 30), "en", "c", 3), (None, None, None, None, None),
        (7, "12 34 %% !!", "en", "c", 11), (8, "one two", "en", "c", 7), (9, "one two", "en", "c", 7), (10, "Éa éa ßü 漢字 😀 ok", "fr", "c", 1),
        (11, prose(3, 20_000), "en", "d", 1), (12, prose(4, 60), "en", "d", 1),
    ]
    return rows + [(20 + i, prose(5 + i % 4, 25 + i), "en" if i % 2 else "de", "e", i) for i in range(20)]


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None, k: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(rows: list[tuple], k: int, percent: int) -> dict:
    """doc_id -> (set size, smallest linked doc_id); rows are (doc_id, text), ids unique."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def benchmark_hits(text: str | None, items: list[tuple], window: int = 10) -> tuple:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        v = word.findall(lower(t))
        n = min(window, len(v))
        for at in {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == at:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def base_spans(text: str | None) -> list[tuple]:
    t, out = text or "", []
    for kind, pattern, keep in (
        ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), ("assign", "access", "hex").index(kind), kind, m.end()) for m in re.finditer(pattern, t) if keep(m)]
    return sorted(out)


def weighted_jaccard(a: str, b: str) -> float:
    x, y = (Counter(re.findall(r"[^\x20\x09-\x0D]+", lower(t))) for t in (a, b))
    keys = x.keys() | y.keys()
    return sum(min(x[k], y[k]) for k in keys) / max(1, sum(max(x[k], y[k]) for k in keys))
