"""Personal data by regular expressions and weak supervision.

Base spans: e-mail addresses, IPv4 addresses, card numbers and phone numbers, each by one pattern, leftmost
and without overlap per kind, then checked (parts, Luhn, number of digits).

More spans come from weak supervision.  Candidates are long tokens and values after key words (kind "secret"), groups of
digits ("number"), account numbers ("iban"), capitalised words after a salutation ("name") and house
numbers with a street ("address") outside the base spans.  Labelers of three sorts vote on each: regular expressions
on its shape, gazetteers on its words, and the words around it.  A candidate is reduced to its kind and votes, so
the whole corpus gives a table of bounded size (3 votes to the power of the labelers, for each kind).  From its
counts, those of candidates without a vote included, expectation-maximisation estimates each labeler's reliability
without any labels, and its soft labels train a logistic span classifier on the votes, which decides.

Patterns are written so that each character is looked at once: a run of characters that can't match is
stepped over as a whole, which finds the same spans as trying each place.

Null and empty texts have no spans.  Places are code points, ends exclusive.  Repeated rows are scanned one by
one and count as often in the estimates.  Columns called base, candidates or spans are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text

KINDS = ("email", "ip", "card", "phone", "secret", "number", "iban", "name", "address")

# A run that no match can begin in is consumed whole (the optional group is then empty).
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]++(\.[0-9]+\.[0-9]+\.[0-9]+)?(?:\.[0-9]++)*?")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+")
NUMBER = re.compile(r"[0-9](?:[ ().-]{0,2}[0-9])++")

KEYED = re.compile(r"""(?i:passw(?:or)?d|secret|token|api[_-]?key|access[_-]?key)["']?[ ]?[:=][ ]?["']?([^\s"',;]{6,}+)""")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NAME = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Dear|Herr|Frau)\.? ([A-Z][a-z]+(?:[ -][A-Z][a-z]+){0,2})")
ADDRESS = re.compile(r"(?<![A-Za-z0-9])[0-9]{1,5} (?:[A-Z][a-z]+ ){1,3}[A-Z][a-z]+")

# Gazetteers of the labelers.
STREETS = re.compile(r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Court|Square|Way)$")
FIRST_NAMES = re.compile(r"(?:James|John|Robert|Michael|William|David|Mary|Patricia|Jennifer|Linda|Elizabeth|Susan|Anna|Maria|Peter|Thomas|Paul|Daniel|Sarah|Laura|Jan|Hans|Jean|Pierre|Carlos|Jose)\b")
TITLES = re.compile(r"(?:Sir|Madam|President|Minister|Reader|All|Team|Customer|Friends?|God|Who)\b")
ABOUT_PEOPLE = re.compile(r"contact|call|write|resid|lives?|born|patient|client|ship|deliver|address|home|name|signed|regards|sincerely", re.I)
SECRET_WORDS = re.compile(r"token|secret|passw|api.?key|apikey|auth|bearer|credential|private.?key|access.?key", re.I)
NUMBER_WORDS = re.compile(r"phone|tel|call|fax|mobile|cell|ssn|passport|account|iban|social security", re.I)
OTHER_WORDS = re.compile(r"https?:|www\.|/|version|page|isbn|issn|doi|figure|chapter|commit|sha|md5|uuid", re.I)
BEGINNINGS = re.compile(r"sk[-_]|pk[-_]|gh[pousr]_|xox[abpr]-|AKIA|ASIA|AIza|eyJ")

N_LABELERS = 6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text) if m[1]]
    if text.count(".") >= 3:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if m[1] and all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def votes(text: str, start: int, end: int, kind: int) -> str:
    """The labelers' votes on a candidate: + for personal or secret, - against, 0 without a view."""
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    digits = sum(map(str.isdigit, span))
    if kind == 6:
        code = re.sub("[^A-Z0-9]", "", span)
        shape = "+" if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else "-"
        mixed = "+" if 15 <= len(code) <= 34 else "-"
        length, begin = "0", "+" if " " in span else "0"
        words = "+" if NUMBER_WORDS.search(before) else "0"
    elif kind == 7:
        shape = "+" if " " in span or "-" in span else "0"
        mixed = "-" if TITLES.match(span) else "0"
        length = "-" if len(span) < 3 else "0"
        begin = "+" if FIRST_NAMES.match(span) else "0"
        words = "+" if ABOUT_PEOPLE.search(before) else "0"
    elif kind == 8:
        shape = "+" if STREETS.search(span) else "-"
        mixed = "+" if re.match(r",? *[A-Z][a-z]+,? +[0-9A-Z]", after) else "0"
        length = "-" if len(span) > 40 else "0"
        begin = "-" if re.match(r"(?:1[89]|20)[0-9]{2} ", span) else "0"
        words = "+" if ABOUT_PEOPLE.search(before) else "0"
    elif kind == 4:
        shape = "+" if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", span) else "0"
        mixed = "+" if digits >= 3 and re.search(r"[A-Za-z]", span) else "-" if digits == 0 or digits == len(span) else "0"
        length = "+" if len(span) >= 24 else "0"
        begin = "+" if BEGINNINGS.match(span) else "0"
        words = "+" if SECRET_WORDS.search(before) else "0"
    else:
        shape = "+" if re.search(r"[0-9]{3}[-. )]+[0-9]{3,4}\b", span) else "-" if span.isdigit() and len(span) < 8 else "0"
        mixed = "+" if 7 <= digits <= 15 else "-"
        length = "+" if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", span) else "0"
        begin = "+" if before.endswith("(") or span.startswith("00") else "-" if re.match(r"(19|20)[0-9]{2}[-.][01]?[0-9]", span) else "0"
        words = "+" if NUMBER_WORDS.search(before) else "0"
    other = "-" if OTHER_WORDS.search(before[-12:]) or after[:1] in ("/", "%") else "0"
    return shape + mixed + length + begin + words + other


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, votes) of candidates that overlap no base span and no earlier candidate."""
    taken = [(a, b) for a, _, b in base]
    out = []
    for kind, pattern in ((4, TOKEN), (4, KEYED), (6, IBAN), (8, ADDRESS), (7, NAME), (5, NUMBER)):
        own, k = sorted(taken), 0
        for m in pattern.finditer(text):
            a, b = m.span(pattern.groups)  # the value alone, where a pattern has a group
            if kind == 5 and b - a < 7:
                continue
            while k < len(own) and own[k][1] <= a:
                k += 1
            if k < len(own) and own[k][0] < b:
                continue
            out.append((a, kind, b, votes(text, a, b, kind)))
            taken.append((a, b))
    return sorted(out)


DIGIT = re.compile("[0-9]")


def spotted(docs: DataFrame) -> DataFrame:
    """docs without text, with base and candidates: array<struct<start, kind, stop, votes>> (kind: place in KINDS)."""
    keep = [c for c in docs.columns if c != "text"]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("votes", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                own = base_spans(text) if "@" in text or DIGIT.search(text) else []
                base.append([{"start": a, "kind": k, "stop": b, "votes": ""} for a, k, b in own])
                more.append([{"start": a, "kind": k, "stop": b, "votes": v} for a, k, b, v in candidates(text, own)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(base, kind), pa.array(more, kind)], [*keep, "base", "candidates"])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")
    struct = "array<struct<start: int, kind: int, stop: int, votes: string>>"
    return docs.mapInArrow(run, f"{fields}, base {struct}, candidates {struct}")


def reliabilities(patterns: list[str], counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation over vote patterns: (posterior of each pattern, prior, P(vote | class) per labeler)."""
    votes_ = np.array([["-0+".index(c) for c in p] for p in patterns])
    weight = counts.astype(float)
    balance = (votes_ - 1).sum(1)
    post = 1 / (1 + np.exp(-balance.astype(float)))  # majority vote to begin with
    for _ in range(rounds):
        prior = min(max(float((weight * post).sum() / weight.sum()), 1e-3), 1 - 1e-3)
        table = np.zeros((votes_.shape[1], 2, 3))
        for j in range(votes_.shape[1]):
            for c, p in ((0, 1 - post), (1, post)):
                table[j, c] = np.bincount(votes_[:, j], weight * p, 3) + 0.5
        table /= table.sum(2, keepdims=True)
        like = np.log([1 - prior, prior])[None, :] + sum(np.log(table[j][:, votes_[:, j]]).T for j in range(votes_.shape[1]))
        new = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -30, 30)))
        done, post = np.abs(new - post).max() < 1e-6, new
        if done:
            break
    return post, prior, table


def span_classifier(patterns: list[str], soft: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Logistic regression on the votes (two indicators a labeler and a constant), trained on soft labels."""
    x = np.array([[c == "+" for c in p] + [c == "-" for c in p] + [True] for p in patterns], float)
    w = np.zeros(x.shape[1])
    weight = counts / counts.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (soft - p)) - 1e-4 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w)), g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def accepted_patterns(spots: DataFrame, threshold: float = 0.5) -> dict[int, list[str]]:
    """For each candidate kind the vote patterns that the trained classifier accepts."""
    # at most 3 ** N_LABELERS patterns a kind, whatever the corpus
    table = spots.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").count().collect()
    out = {}
    for kind in sorted({r.kind for r in table}):
        own = sorted((r.votes, r["count"]) for r in table if r.kind == kind)
        patterns, counts = [v for v, _ in own], np.array([n for _, n in own], float)
        soft, _, _ = reliabilities(patterns, counts)
        p = span_classifier(patterns, soft, counts)
        out[kind] = [v for v, x in zip(patterns, p, strict=True) if x >= threshold]
    return out


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without text, with base and spans (base ones and accepted candidates): array<struct<start, kind, stop>>, sorted."""
    from .common import saved

    spots = saved(spotted(as_text(docs)), "spots")
    good = accepted_patterns(spots, threshold)
    strip = lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.stop.alias("stop"))
    accepted = F.array(*(F.lit(f"{k}{v}") for k, vs in good.items() for v in vs)) if any(good.values()) else F.array().cast("array<string>")
    chosen = F.filter("candidates", lambda c: F.array_contains(accepted, F.concat(c.kind.cast("string"), c.votes)))
    base = F.array_sort(F.transform("base", strip))
    return spots.select(*(c for c in spots.columns if c not in ("base", "candidates")), base.alias("base"), F.array_sort(F.concat(F.transform("base", strip), F.transform(chosen, strip))).alias("spans"))


def joined(spans: str) -> F.Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.stop.cast("string"))), ",")


def counted(spans: str, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s.kind == KINDS.index(kind))).cast("long")
