"""Personal data: fixed patterns, and further spans that boosted trees choose among candidates.

Four patterns with checks give the base spans, which always stay. Loose generators then propose
more, overlapping spans (written-out addresses, other digit groupings, IPv6); trees score each by
its format and its context, and a threshold per kind, calibrated on held-out examples, selects
those that no base or better span overlaps. Examples are all candidates of all texts, and those of
real and misleading values that are written into copies of their parts.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nsmallest
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.table_boosting import boost_table, coded_blocks, precise_limits, table_cut_points
from ledgerline.llm.trees import Boosted, boost
from ledgerline.session import TEXTS, discard, durable

KINDS = ("email", "ip", "card", "phone")
#: made-up values: so many at least, but not over 2 * EACH in one text, and one in each text
MADE_UP, EACH = 18_000, 6
#: so many examples are learned from on the driver, more where they lie
ON_DRIVER = 1 << 15
#: candidates of one text that ``examples`` gives, chosen by a hash over all of them; ``fit`` takes all
PER_TEXT = 1_000
SLICE = 5_000
ROUNDS = 60
PRECISION = 0.99
CONTEXT = 24

#: fixed values: the base patterns; emails are found from their @ outwards
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# (a match that begins inside a run of digits begins at its first digit too; saying so keeps long runs linear)
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: the loose generators, each with a sign without which a text need not be searched
_AT = r"(?:@|\s?(?:\[at\]|\(at\)|\{at\})\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?|\s(?:dot|DOT)\s)"
_NAME = r"[^\s@<>()\[\]{},;:\"'/\\|=]{1,64}"
_LABEL = r"[^\s@<>()\[\]{},;:\"'./\\|=]{1,63}"
LOOSE = (
    ("email", re.compile(rf"{_NAME}{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{1,4}}"), ("@", "[at]", "(at)", "{at}", " dot ", " DOT ")),
    ("ip", re.compile(r"(?<![\w.])\d{1,3}(?:(?:\[\.\]|\(\.\)|\s?\[dot\]\s?)\d{1,3}){3}(?![\w.])"), ("[.]", "(.)", "[dot]")),
    ("ip", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![\w:])"), (":",)),
    ("card", re.compile(r"(?<![\w.+-])\d(?:[ ./_-]{0,2}\d){12,18}(?![\w-])"), None),
    ("phone", re.compile(r"(?<![\w.+/-])(?:00|\(0?\d{1,4}\)|\d{2,4})[ .()/-]{0,2}\d{2,5}(?:[ ./-]{0,2}\d{2,5}){1,4}(?![\w/-])"), None),
)


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def passes(kind: str, span: str) -> bool:
    """The check on a match of a base pattern."""
    if kind == "ip":
        parts = [part.lstrip("0") for part in span.split(".")]
        return all(len(part) <= 3 and int(part or 0) <= 255 for part in parts)
    digits = only_digits(span)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, searched around each @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SET:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base, in order of start, then of kind as listed."""
    out = [(start, end, "email") for start, end in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            if kind != "phone" or "+" in text:
                out += [(*m.span(), kind) for m in pattern.finditer(text) if passes(kind, m[0])]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def proposals(text: str) -> list[tuple[int, int, str]]:
    """Overlapping candidates of the loose generators; those of digits for both digit kinds."""
    out, digits = set(), _DIGIT.search(text) is not None
    for kind, pattern, signs in LOOSE:
        if digits if signs is None else any(s in text for s in signs):
            for m in pattern.finditer(text):
                out.add((*m.span(), kind))
                if signs is None:
                    out.add((*m.span(), "card" if kind == "phone" else "phone"))
    return sorted(out)


_HINTS = tuple(
    re.compile(p, re.IGNORECASE)
    for p in (r"mail|contact|write|adress|address|correo|courriel", r"\bip\b|host|server|addr|from", r"card|visa|credit|karte|tarjeta|carte|pay",
              r"phone|tel|call|fax|mobil|ruf|whatsapp|llam|appel", r"version|release|section|chapter|isbn|order|invoice|license|serial|ratio|date|page")
)
_SHAPES = tuple(
    re.compile(p)
    for p in (r"^(?:\d{4}[ ./_-]{1,2}){3}\d{1,7}$", r"^\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}$", r"^00", r"^\d{4}[./-]\d{1,2}[./-]\d{1,2}$",
              r"^\d{1,2}[./:-]\d{1,2}[./:-]\d{2,4}$", r"[\[({](?:at|dot|\.)[\])}]|\sat\s|\sdot\s", r"^[A-Za-z0-9]", r"(?:com|org|net|info|edu|de|fr|es|uk|io)$",
              r"^[0-9A-Fa-f:]+$", r"^\(")
)


def traits(text: str, start: int, end: int, kind: str) -> list[float]:
    """Features of a candidate: its kind, its format, and what stands around it."""
    span, digits = text[start:end], only_digits(text[start:end])
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    colon = [g for g in span.split(":")]
    letters = sum(c.isalpha() for c in span)
    return [
        *(float(kind == k) for k in KINDS),
        len(span), len(digits), letters, len(groups), min(groups), max(groups), groups[-1],
        len(set(digits)), float(luhn(digits)) if digits else 0.0, float(digits[:1] in ("3", "4", "5", "6")),
        len(set(span) - set("0123456789") - set(c for c in span if c.isalpha())),
        span.count(" "), span.count("."), span.count(":"), span.count("-"), float("::" in span), float("@" in span),
        len(colon), float(max(len(g) for g in colon) <= 4), max((int(g) for g in re.findall(r"[0-9]{1,9}", span)), default=0),
        float(any(not c.isascii() for c in span)),
        *(float(p.search(span) is not None) for p in _SHAPES),
        *(float(p.search(before) is not None) for p in _HINTS),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after or after[:1] in ".,;:!?)"),
        float(sum(c.isdigit() for c in before)), float(sum(c.isdigit() for c in after)),
    ]


def _card(draw: random.Random, length: int, good: bool) -> str:
    digits = draw.choice("3456") + "".join(draw.choice("0123456789") for _ in range(length - 2))
    check = next(c for c in "0123456789" if luhn(digits + c))
    return digits + (check if good else draw.choice([c for c in "0123456789" if c != check]))


def made_up(draw: random.Random, kind: str, good: bool) -> str:
    """A value of a kind in a form that the base does not take, or one that only looks like it."""
    word = lambda low, high: "".join(draw.choice("abcdefghijklmnoprstuvw") for _ in range(draw.randint(low, high)))
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    part = lambda: str(draw.randint(0, 255))
    if kind == "email":
        if good:
            at = draw.choice(("[at]", "(at)", " [at] ", " (at) ", " at ", "@"))
            dot = draw.choice((" dot ", "[dot]", "(dot)", " [dot] ")) if at == " at " or draw.random() < 0.5 else "."
            name = word(2, 8) + draw.choice(("", "." + word(2, 6), str(draw.randint(1, 99))))
            name = draw.choice("äöüéñ") + name if at == "@" else name
            return f"{name}{at}{word(3, 9)}{dot}{draw.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'info', 'edu'))}"
        return draw.choice((f"{word(2, 6)} at {word(3, 8)}.{word(3, 8)}", f"{word(3, 8)} at the dot {word(2, 6)}", f"@{word(4, 8)}.", f"{word(2, 5)}(at){word(2, 5)}"))
    if kind == "ip":
        if good:
            if draw.random() < 0.5:
                return draw.choice(("[.]", "(.)", "[dot]")).join(part() for _ in range(4))
            groups = [f"{draw.randint(1, 65535):x}" for _ in range(8)]
            cut = draw.randint(2, 5)
            return ":".join(groups) if draw.random() < 0.6 else ":".join(groups[:cut]) + "::" + ":".join(groups[cut + 2 :])
        return draw.choice((f"{draw.randint(0, 23):02}:{number(2)}:{number(2)}", f"{draw.randint(1, 9)}:{draw.randint(1, 99)}", f"{number(3)}[.]{draw.randint(256, 999)}[.]{number(3)}[.]{number(3)}", f"{word(3, 4)}::{word(3, 6)}", f"{draw.randint(1, 40)}:{draw.randint(1, 40)}:{draw.randint(1, 40)}:{draw.randint(1, 40)}"))
    if kind == "card":
        gap = draw.choice((".", "/", "  ", "_", " - ")) if good else draw.choice(("", " ", "-", ".", "/", "  "))
        digits = _card(draw, draw.choice((13, 14, 15, 16, 16, 16, 19)), good)
        if good and draw.random() < 0.25:
            return _card(draw, 13, True)
        return gap.strip(" ").join(digits[i : i + 4] for i in range(0, len(digits), 4)) if gap == " - " else gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if good:
        area, line = f"{draw.randint(201, 989)}", f"{draw.randint(200, 999)}"
        return draw.choice((f"({area}) {line}-{number(4)}", f"{area}-{line}-{number(4)}", f"{area}.{line}.{number(4)}", f"00{draw.randint(30, 49)} {draw.randint(10, 999)} {number(7)}", f"(0{draw.randint(20, 99)}) {number(4)} {number(4)}"))
    return draw.choice((f"{draw.randint(1900, 2030)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}", f"{draw.randint(1, 28)}.{draw.randint(1, 12)}.{draw.randint(1900, 2030)}", number(draw.randint(6, 12)), f"{number(4)}-{number(4)}-{number(1)}", f"{number(3)}.{number(3)}", f"{number(2)} {number(3)} {number(3)}", f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"{draw.randint(10, 99)}.{draw.randint(10, 99)}.{draw.randint(10, 99)}.{draw.randint(10, 99)}"))


_LEADS = {
    "email": ("mail: ", "contact ", "write to "), "ip": ("host ", "from ", "server "),
    "card": ("card ", "card no. ", "pay with "), "phone": ("tel. ", "call ", "phone: "),
}


def examples(text: str, seed: int) -> list[tuple[list[float], int]]:
    """The examples of a text; of more than ``PER_TEXT`` candidates those with the least hash."""
    return list(all_examples(text, seed, 2 * EACH, PER_TEXT))


def all_examples(text: str, seed: int, made: int, most: int | None = None) -> Iterator[tuple[list[float], int]]:
    """(features, label) of candidates in a text, and in copies of its parts with made-up values.

    Spans of the base are true, its failing matches and all other candidates of the text false.
    """
    base, found = base_spans(text), proposals(text)
    taken = {kind: Taken([b for b in base if b[2] == kind]) for kind in KINDS}
    if most is not None and len(found) > most:
        found = sorted(nsmallest(most, found, key=lambda p: zlib.crc32(f"{seed}:{p}".encode())))
    for start, end, kind in found:
        same = not taken[kind].free(start, end)
        if same or all(spans.free(start, end) for spans in taken.values()):
            yield traits(text, start, end, kind), int(same)
    draw = random.Random(seed)
    words = text.split(" ")
    first = 0 if made >= 8 else seed // 3 % 8  # all kinds, true and false, over texts if not in each
    for n in range(first, first + made):
        kind, good = KINDS[n % 4], n % 8 < 4
        at = draw.randint(0, len(words))
        left, right = " ".join(words[max(0, at - 8) : at]), " ".join(words[at : at + 8])
        lead = draw.choice(_LEADS[kind]) if draw.random() < (0.4 if good else 0.15) else ""
        value = made_up(draw, kind, good)
        near = f"{left} {lead}{value} {right}"
        start = len(left) + 1 + len(lead)
        for s, e, k in proposals(near):
            if s < start + len(value) and start < e:
                whole = good and k == kind and s <= start and e >= start + len(value) and e - s <= len(value) + 2
                yield traits(near, s, e, k), int(whole)


class Taken:
    """Stretches of a text that are spoken for, kept apart and in order."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return not before or self.ends[before - 1] <= start

    def add(self, start: int, end: int) -> None:
        """A stretch that is free."""
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


@dataclass
class Chooser:
    """Trees, and for each kind the least score that is selected."""

    trees: Boosted | None
    limits: dict[str, float]

    def more_spans(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Candidates above their limit that overlap no base span and no better candidate."""
        taken = Taken(base)
        found = [p for p in proposals(text) if taken.free(p[0], p[1])]
        if not found or self.trees is None:
            return []
        scores = self.trees.chances(np.array([traits(text, *p) for p in found], dtype=float))
        out = []
        for i in sorted(range(len(found)), key=lambda i: (-scores[i], found[i])):
            start, end, kind = found[i]
            if scores[i] >= self.limits[kind] and taken.free(start, end):
                taken.add(start, end)
                out.append(found[i])
        return out

    def all_spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        base = base_spans(text)
        return base, sorted(base + self.more_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def fit(docs: DataFrame, sample: int | None = None) -> Chooser:
    """Learn from all candidates of all texts; a third of the texts, by a hash, calibrates.

    Each text also gets at least one made-up value, up to ``2 * EACH`` in tables that would have less
    than ``MADE_UP`` of them. ``sample`` is for trials: about so many texts, chosen by a hash of doc_id.
    Without any text nothing is added to the base.
    """
    count = docs.count()
    if sample is not None:
        share = int(min(1.0, sample / max(count, 1)) * (1 << 30))
        docs, count = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1 << 30)) <= share), min(sample, count)
    made = min(2 * EACH, max(1, -(-MADE_UP // max(count, 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = ((seed, x, y) for text, seed in zip(batch["text"], batch["seed"]) for x, y in all_examples(text or "", int(seed), made))
            while rows := list(islice(every, SLICE)):
                yield pd.DataFrame(rows, columns=["seed", "x", "y"])

    seeded = docs.select(F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31)).alias("seed"))
    rows = durable(seeded.mapInPandas(run, "seed long, x array<double>, y int"), "pii_examples", TEXTS)
    try:
        return _learned_here(rows.toPandas()) if rows.count() <= ON_DRIVER else _learned_there(rows)
    finally:
        discard(rows)


def _learned_there(rows: DataFrame) -> Chooser:
    """From examples that stay in their table."""
    rows = rows.withColumn("held", F.col("seed") % 3 == 0)
    if rows.filter(~F.col("held")).select("y").distinct().count() < 2:
        return Chooser(None, dict.fromkeys(KINDS, 2.0))
    features = len(rows.first()["x"])
    cuts = table_cut_points(rows.filter(~F.col("held")), features)
    blocks = durable(coded_blocks(rows, cuts, len(KINDS)), "pii_blocks")
    coded, trees = boost_table(blocks, cuts, ROUNDS, depth=4, rate=0.2, least=5)
    limits = precise_limits(blocks, coded, features, len(KINDS), PRECISION)
    discard(blocks)
    return Chooser(trees, dict(zip(KINDS, limits)))


def _learned_here(rows: pd.DataFrame) -> Chooser:
    """From few examples, on the driver."""
    if not len(rows) or rows["y"].nunique() < 2:
        return Chooser(None, dict.fromkeys(KINDS, 2.0))
    x = np.stack(rows["x"].to_list()).astype(float)
    order = np.lexsort((*x.T, rows["seed"].to_numpy()))
    x, y, tried = x[order], rows["y"].to_numpy(dtype=float)[order], rows["seed"].to_numpy()[order] % 3 == 0
    if len(np.unique(y[~tried])) < 2:
        return Chooser(None, dict.fromkeys(KINDS, 2.0))
    trees = boost(x[~tried], y[~tried], ROUNDS, depth=4, rate=0.2, least=5)
    scores, limits = trees.chances(x[tried]), {}
    for i, kind in enumerate(KINDS):
        own = x[tried][:, i] == 1
        ranked = np.argsort(-scores[own], kind="stable")
        ranked_scores, hits = scores[own][ranked], np.cumsum(y[tried][own][ranked])
        last = np.append(ranked_scores[1:] != ranked_scores[:-1], True)  # a limit takes all equal scores
        precise = np.flatnonzero((hits >= PRECISION * np.arange(1, len(hits) + 1)) & last) if len(hits) else []
        # the least score at which what is selected is still precise; never below one half
        limits[kind] = max(0.5, float(ranked_scores[precise[-1]])) if len(precise) else 2.0
    return Chooser(trees, limits)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find(docs: DataFrame, chooser: Chooser) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the hash are those of the base spans, spans lists all. A null text counts as
    empty; offsets are code points. Whole texts of any length are searched; repeated rows are
    answered each, whatever their doc_id; other columns are not read. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(chooser))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = cloudpickle.loads(model.value)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, spans = known.all_spans(text or "")
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at, upto = [], 0, 0
    for start, end, kind in sorted(spans):
        if start >= upto:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = upto = max(upto, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, chooser: Chooser) -> DataFrame:
    """The documents with personal data replaced; n_chars, where there is one, follows the text.

    All other columns and rows without personal data stay as they are, null texts included.
    """
    model = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(chooser))

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        known = cloudpickle.loads(model.value)
        step = max(TEXTS * len(texts) // max(texts.nbytes, 1), 1)  # a batch in parts: few texts at a time are Python's
        parts = (texts.slice(at, step).to_pylist() for at in range(0, max(len(texts), 1), step))
        done = [pa.array([None if t is None else redacted(t, known.all_spans(t)[1]) for t in part], texts.type) for part in parts]
        return pa.concat_arrays(done)

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out
