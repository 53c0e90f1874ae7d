"""Plain versions of what the operators compute."""

from __future__ import annotations

import collections
import hashlib
import re
import unicodedata

import xxhash

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def letters(text) -> list[str]:
    """Lower-case words of letters and their marks."""
    out, word = [], ""
    for chunk in (text or "").split():
        for ch in chunk.lower() + " ":
            kind = unicodedata.category(ch)[0]
            if kind == "L" or (word and kind == "M"):
                word += ch
            else:
                out += [word] * bool(word)
                word = ""
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def simhash(text) -> int:
    w = words((text or "").translate(ASCII_LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: list[int], ids: list, bits: int = 3) -> list:
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(ids))]


LAST = 2**63 - 1  # a row without an id counts as larger than any


def removed(rows: list[tuple], window: int = 50) -> list[tuple]:
    """``doc_id, n_words, n_removed, sha`` of each row, every row judged by itself."""
    first: dict = {}
    split = [(LAST if d is None else d, d, words(t)) for d, t in rows]
    for own, _, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, own), own)
    out = []
    for own, d, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < own:
                gone[k : k + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def passages(rows: list[tuple], window: int = 50) -> set[tuple]:
    where = collections.defaultdict(set)
    split = [(LAST if d is None else d, d, words(t)) for d, t in rows]
    for own, _, w in split:
        for k in range(len(w) - window + 1):
            where[tuple(w[k : k + window])].add(own)
    out = set()
    for _, d, w in split:
        spans = []
        for k in range(len(w) - window + 1):
            have = where[tuple(w[k : k + window])]
            if len(have) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1:] = [k + window, min(spans[-1][2], *have)]
                else:
                    spans.append([k, k + window, min(have)])
        out |= {(d, a, b, None if f == LAST else f) for a, b, f in spans}
    return out


def hits(text, items: list[tuple[str, str]], window: int = 10):
    norm = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(ASCII_LOWER))
    w = norm(text)
    hit, names = [False] * len(w), []
    for name, item in items:
        x = norm(item)
        k = min(window, len(x))
        own = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
        found = [i for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in own] if k else []
        if found:
            names.append(name)
        for i in found:
            hit[i : i + k] = [True] * k
    return len(w), sum(hit), sorted(set(names)), hit


def personal(text) -> list[tuple[str, int, int]]:
    t = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
