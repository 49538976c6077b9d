"""Plain-Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NONSPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def join(parent, a, b):
    a, b = find(parent, a), find(parent, b)
    parent[max(a, b)] = min(a, b)


def op1(docs, bench, k=13):
    windows = defaultdict(set)
    for item, text in bench:
        w = ALNUM.findall(lower(text))
        for i in range(max(len(w) - k + 1, 1) if w else 0):
            windows[tuple(w[i : i + k])] |= {str(item)} if item is not None else set()
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w = ALNUM.findall(lower(text))
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    items |= found
                    hit |= set(range(i, i + n))
        out.append((d, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def op2(docs, n=200):
    seen = Counter()
    data = [(d, (t or "").encode()) for d, t in docs]
    for _, b in data:
        seen.update(hash(b[i : i + n]) for i in range(len(b) - n + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[hash(b[i : i + n])] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, sha(kept)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x if x < 10 else x - 9
    return total % 10 == 0


def op3(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    out.sort()
    counts = Counter(k for _, _, k, _ in out)
    return (*(counts[k] for k in ("email", "ip", "card", "phone")), sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in out)))


def op4(rows, cosine=0.95):
    parent = list(range(len(rows)))
    links = [0] * len(rows)
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        scaled = np.array(v, float) / max(map(abs, v)) if ok else None
        unit.append(scaled / np.linalg.norm(scaled) if ok else None)
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                join(parent, i, j)
    return labelled([i for i, _ in rows], parent, links)


def labelled(ids, parent, values):
    smallest = {}
    for i, x in enumerate(ids):
        r = find(parent, i)
        smallest[r] = min(smallest.get(r, x), x)
    return [(x, v, smallest[find(parent, i)], smallest[find(parent, i)] == x) for i, (x, v) in enumerate(zip(ids, values))]


def op6(docs, k=4, percent=80):
    sets = []
    for _, t in docs:
        w = NONSPACE.findall(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    shared = Counter()
    for own in where.values():
        for a in range(len(own)):
            for b in range(a):
                shared[own[b], own[a]] += 1
    parent = list(range(len(docs)))
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            join(parent, a, b)
    return labelled([d for d, _ in docs], parent, [len(s) for s in sets])


def op7(text):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    w = ALNUM.findall(lower(text))
    places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def op8(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for d, text in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def op9(pages):
    first = {}
    for p, html in sorted(pages):
        first.setdefault(html or "", p)
    out = []
    for p, html in pages:
        b = (html or "").encode()
        f = first[html or ""]
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == p else "revisit", None if f == p else f))
    return out


def op5_targets(rows):
    """rows: (source, size).  Exact targets per source."""
    sizes = Counter()
    for s, n in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in full)
        rest = total - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / free for s in order}
        more = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not more:
            return target, sizes
        full |= more
