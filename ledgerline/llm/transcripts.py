"""Chat transcripts: a hidden Markov model recovers the turns, which are rendered canonically.

The hidden state of a line is its role and whether it begins a turn; what is seen of it are
features: the speaker marker it starts with, whether it or the line before is blank, its length,
case and last character. Probabilities are counted on transcripts rendered from conversations
whose roles are known; Viterbi's path gives the roles of a text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
SAMPLE = 1_500
SMOOTHING = 0.1
MARKERS = 512
TURNS = 256
#: fixed values: how transcripts name the roles, as (system, user, assistant), and write them
NAMES = (
    ("System", "User", "Assistant"),
    ("Instructions", "Human", "AI"),
    ("Context", "Q", "A"),
    ("SYSTEM", "CUSTOMER", "AGENT"),
    ("system", "user", "bot"),
)
FORMS = ("{}: ", "[{}] ", "### {}\n", "<{}> ", "**{}:** ")
_MARKED = re.compile(r"^(?:#{1,4} ?[A-Za-z]{1,20}\s*$|\[[A-Za-z]{1,20}\](?: |$)|<[A-Za-z]{1,20}>(?: |$)|\*\*[A-Za-z]{1,20}:\*\*(?: |$)|[A-Za-z]{1,20}:(?: |$))")


def render_raw(turns: list[tuple[str, str]], style: int) -> list[tuple[str, int]]:
    """Lines with their states. The last style has no markers, only blank lines between turns."""
    styles = len(NAMES) * len(FORMS)
    style %= styles + 1
    out: list[tuple[str, int]] = []
    for n, (role, text) in enumerate(turns):
        mark = ""
        if style < styles:
            mark = FORMS[style % len(FORMS)].format(NAMES[style // len(FORMS)][ROLES.index(role)])
        if n and (style == styles or style % 2):
            out.append(("", STATES.index((turns[n - 1][0], False))))
        for i, line in enumerate((mark + text).split("\n")):
            out.append((line, STATES.index((role, not i))))
    return out


def marker_of(line: str) -> str:
    found = _MARKED.match(line)
    return found[0].strip() if found else ""


def line_features(lines: list[str]) -> np.ndarray:
    """(lines, features): categories as small numbers; the first is the marker's bucket."""
    out, blank = [], True
    for line in lines:
        mark = marker_of(line)
        bucket = 1 + zlib.crc32(mark.encode()) % (MARKERS - 1) if mark else 0
        body = line.strip()
        now = not body
        size = 0 if now else min(3, 1 + len(body) // 80)
        first = 0 if now else 1 if body[0].isupper() else 2 if body[0].islower() else 3
        last = 0 if now else 1 if body[-1] in ".!" else 2 if body[-1] == "?" else 3
        out.append((bucket, now * 2 + blank, size, first, last))
        blank = now
    return np.array(out, dtype=np.int64).reshape(len(out), 5)


WIDTHS = (MARKERS, 4, 4, 4, 4)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    seen: list[np.ndarray]

    def states(self, lines: list[str]) -> list[int]:
        """The most probable states of all lines."""
        if not lines:
            return []
        found = line_features(lines)
        emit = sum(table[:, found[:, f]].T for f, table in enumerate(self.seen))
        best, back = self.start + emit[0], []
        for row in emit[1:]:
            ways = best[:, None] + self.move
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        path = [int(best.argmax())]
        for way in reversed(back):
            path.append(int(way[path[-1]]))
        return path[::-1]


def model_of(counts: pd.DataFrame) -> Model:
    """From rows (kind, a, b, n): kind -2 for starts, -1 for moves, else the feature's number."""
    size = len(STATES)
    start, move = np.full(size, SMOOTHING), np.full((size, size), SMOOTHING)
    seen = [np.full((size, width), SMOOTHING) for width in WIDTHS]
    for kind, a, b, n in counts.itertuples(index=False):
        (start if kind == -2 else move if kind == -1 else seen[kind])[(a,) if kind == -2 else (a, b)] += n
    rows = lambda x: np.log(x) - np.log(x.sum(axis=-1, keepdims=True))
    return Model(rows(start), rows(move), [rows(x) for x in seen])


def turns_of(lines: list[str], states: list[int]) -> list[tuple[str, str]]:
    """Roles and texts: markers are cut off, blank lines at the ends of a turn are dropped."""
    out: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, states):
        role, begins = STATES[state]
        if begins or not out or out[-1][0] != role:
            found = _MARKED.match(line)
            out.append((role, [line[found.end() :] if found else line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(body).strip()) for role, body in out]


def canonical(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def gathered(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, turns): turns in order, in parts of TURNS turn numbers.

    A conversation of any length becomes parts of bounded size. Turns with equal numbers are
    ordered by role and text, rows that repeat all four count once, and a null turn number comes
    first, in part -1. A role that is null or unknown counts as user; a null text is empty.
    """
    role = F.when(F.lower("role").isin(*ROLES), F.lower("role")).otherwise(F.lit("user"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-1)).cast("long").alias("part"),
        F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    return rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, text): conversations as people paste them, in one of the styles by a hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [
                "\n".join(line for line, _ in render_raw([(t["role"], t["text"]) for t in turns], style))
                for turns, style in zip(batch["turns"], batch["style"])
            ]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "part": batch["part"], "text": texts})

    return gathered(conversations).withColumn("style", F.pmod(F.xxhash64("conv_id"), F.lit(1 << 20))).select(
        "conv_id", "part", "turns", "style"
    ).mapInPandas(run, "conv_id long, part long, text string")


def fit(conversations: DataFrame, sample: int = SAMPLE) -> Model:
    """Count on about ``sample`` conversations, chosen by a hash of conv_id, each in several styles."""
    count = conversations.agg(F.approx_count_distinct("conv_id")).first()[0]
    share = int(min(1.0, sample / max(count, 1)) * (1 << 30))
    chosen = conversations.filter(F.pmod(F.xxhash64("conv_id", F.lit("hmm")), F.lit(1 << 30)) <= share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for number, turns in zip(batch["style"], batch["turns"]):
                for style in range(number, number + 9, 2):
                    lines = render_raw([(t["role"], t["text"]) for t in turns], style)
                    states = [s for _, s in lines]
                    found = line_features([line for line, _ in lines])
                    keys = [(-2, states[0], 0)] + [(-1, a, b) for a, b in zip(states, states[1:])]
                    keys += [(f, s, int(v)) for s, row in zip(states, found) for f, v in enumerate(row)]
                    for key in keys:
                        totals[key] = totals.get(key, 0) + 1
        yield pd.DataFrame([(*k, n) for k, n in totals.items()], columns=["kind", "a", "b", "n"])

    counted = gathered(chosen).withColumn("style", F.pmod(F.xxhash64("conv_id", F.lit("style")), F.lit(26)).cast("int"))
    counted = counted.select("turns", "style").mapInPandas(run, "kind int, a int, b int, n long")
    # at most states x categories rows
    return model_of(counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).toPandas())


def parse(rows: DataFrame, model: Model) -> DataFrame:
    """Parse (conv_id, part, text): adds n_turns, roles (comma-joined) and rendered.

    A null or empty text has no turns and renders as empty; every other text has at least one.
    Repeated rows are parsed each; other columns are not read. An empty table gives no rows.
    """
    broadcast = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = cloudpickle.loads(broadcast.value)
        for batch in batches:
            out = []
            for text in batch["text"]:
                lines = text.split("\n") if text else []
                turns = turns_of(lines, known.states(lines))
                out.append((len(turns), ",".join(r for r, _ in turns), canonical(turns)))
            n, roles, rendered = zip(*out) if out else ((), (), ())
            yield pd.DataFrame(
                {"conv_id": batch["conv_id"], "part": batch["part"], "n_turns": n, "roles": roles, "rendered": rendered}
            )

    return rows.select("conv_id", "part", "text").mapInPandas(
        run, "conv_id long, part long, n_turns long, roles string, rendered string"
    )
