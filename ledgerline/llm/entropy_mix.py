"""Mixing sources to target token counts by entropy balancing, in DataFrame functions alone.

Of all document rates between 0 and 3 that give every source its target, the rates that stay
closest to 1 in relative entropy are exp(lambda * size), cut at 3, with one lambda per source.
Newton steps on the gradient of the dual find the lambdas. As a rate depends only on source and
size, the steps run over a table of distinct sizes per source, aggregated before it is shuffled.
Rates become whole copies: each document gets the whole part, and a cut through a hash order hands
out the rest so that a source's words come as near to its target as whole documents allow.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.llm.names import fresh
from ledgerline.session import discard, durable

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
STEPS = 40
CLOSE = 1e-6
SLOTS = 1 << 23
COARSE = 12
#: cuts at most, and the share of its target that a source may miss without another one
ROUNDS, NEAR = 60, 1e-3
#: a table of at most so many sources is broadcast
FEW_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """Never null; the null source and the text of its name stay apart."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def targets(sources: DataFrame) -> DataFrame:
    """Add weight and target to (key, source_size), one row per source.

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; together they share all words, none
    above three times its own. Water filling: in order of size / weight the sources that stop at
    their limit come first, and the level of the first that does not is the level of all others.
    The windows see one row per source.
    """
    ordered = W.orderBy(F.col("key") == "null", "key")
    rows = sources.withColumn("weight", ((F.row_number().over(ordered) - 1) % 3 + 1).cast("double"))
    rows = rows.withColumn("limit", MOST * F.col("source_size").cast("double"))
    rising = W.orderBy(F.col("limit") / F.col("weight"), "key")
    spent = F.coalesce(F.sum("limit").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing))
    everything = rising.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - spent) / left)
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    rows = rows.withColumn("level", F.first(open_level, ignorenulls=True).over(everything))
    return rows.withColumn("target", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit")))


def rate() -> Column:
    """exp(lambda * size / scale), exactly MOST from there on; a full source gets MOST."""
    exponent, most = F.col("lambda") * F.col("size") / F.col("scale"), F.lit(float(MOST))
    return F.when(F.col("full") | (exponent >= F.log(most)), most).otherwise(F.exp(exponent))


def exact(value: Column) -> Column:
    """Sums of decimals do not depend on the order of the rows, so reruns agree."""
    return F.sum(value.cast("decimal(38,6)")).cast("double")


def solve(histogram: DataFrame) -> DataFrame:
    """(key, source_size, target, full, lambda, scale) from (key, size, n), sizes above 0 or not."""
    sources = histogram.groupBy("key").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        exact(F.col("size").cast("double") * F.col("size") * F.col("n")).alias("squares"),
    )
    size = F.greatest(F.col("source_size"), F.lit(1))
    state = durable(
        targets(sources).select(
            "key", "source_size", "target", (F.col("target") >= F.col("limit") * (1 - 1e-12)).alias("full"),
            F.greatest(F.col("squares") / size, F.lit(1.0)).alias("scale"), F.lit(0.0).alias("lambda"),
            F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("off"),
        ),
        "duals",
    )
    wanted = F.greatest(F.col("target"), F.lit(1e-9))
    for _ in range(STEPS):
        joined = histogram.filter("size > 0").join(state.filter("NOT full"), "key")
        words, tilt = F.col("n") * F.col("size").cast("double") * rate(), F.col("size") / F.col("scale")
        sums = joined.groupBy("key").agg(
            exact(words).alias("words"), exact(F.when(rate() < MOST, words * tilt).otherwise(0.0)).alias("slope")
        )
        moved = state.join(sums, "key", "left")
        off = F.log(F.greatest(F.col("words"), F.lit(1e-6)) / wanted)
        low = F.when(off < 0, F.col("lambda")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("lambda")).otherwise(F.col("high"))
        moved = moved.withColumn("off", F.coalesce(off, F.lit(0.0))).withColumn("low", low).withColumn("high", high)
        # Newton on the logarithm of the gradient; a step out of the bracket becomes its middle
        step = F.col("lambda") - F.col("off") * F.col("words") / F.greatest(F.col("slope"), F.lit(1e-6))
        within = (F.col("low").isNull() | (step > F.col("low"))) & (F.col("high").isNull() | (step < F.col("high")))
        middle = (
            F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1)
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        far = F.abs(step - F.col("lambda")) > 4 + 4 * F.abs(F.col("lambda"))
        following = F.when(F.abs("off") <= CLOSE, F.col("lambda")).when(within & ~far, step).otherwise(middle)
        moved = moved.withColumn("lambda", F.coalesce(following, F.col("lambda"))).drop("words", "slope")
        after = durable(moved, "duals")
        discard(state)
        state = after
        if (state.agg(F.max(F.abs("off"))).first()[0] or 0.0) <= CLOSE:
            break
    return state.select("key", "source_size", "target", "full", "lambda", "scale")


def slot(doc_id: Column) -> Column:
    """Place in a source's hash order, earlier the larger the broken part of the rate; null for MOST."""
    chance = F.pmod(F.xxhash64(doc_id, F.col("size"), F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    broken = rate() - F.floor(rate())
    return F.when(rate() < MOST, F.floor((chance - broken + 1) * (SLOTS / 2)).cast("long"))


def whole_copies() -> Column:
    return F.when(F.col("size") > 0, F.floor(rate())).otherwise(F.lit(0)).cast("long")


def taken(slot: Column, phase: int | Column) -> Column:
    """Whether a cut of this phase has taken a document: one of at most the cut's size, before its slot."""
    return F.exists("steps", lambda s: (s["phase"] == phase) & (F.col("size") <= s["most"]) & (slot < s["cut"]))


def copies(doc_id: Column) -> Column:
    own = slot(doc_id)
    filler = (own == F.col("filler_slot")) & (F.col("size") == F.col("filler_size"))
    more = [F.when(x, 1).otherwise(0) for x in (filler, *(taken(own, phase) for phase in range(1, MOST + 1)))]
    return whole_copies() + F.when(F.col("size") > 0, reduce(add, more)).otherwise(0)


def with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Join one row per source to every row; broadcast if its counted rows are few."""
    few = sources.count() <= FEW_SOURCES
    return rows.join(F.broadcast(sources) if few else sources, "key")


def one_cut(placed: DataFrame, state: DataFrame) -> DataFrame:
    """Move the gap of each live source by a cut through its hash order.

    Only documents of at most half the gap stand in line, so the cut leaves less than half of it: a
    document too long for what is left stops nobody behind it for more than one round. Two passes,
    over 4096 coarse steps of the order and then over the slots of the step where the gap runs out.
    """
    line = with_sources(placed, state.filter("live")).filter(
        (F.col("size") <= F.col("gap") / 2) & (F.col("whole") + F.col("phase") <= MOST) & ~taken(F.col("slot"), F.col("phase"))
    )
    coarse = F.shiftright("slot", COARSE)
    level = durable(
        line.groupBy("key", coarse.alias("step")).agg(F.sum("size").alias("words"), F.first("gap").alias("gap")), "steps"
    )
    upto = W.partitionBy("key").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    crossing = durable(
        level.withColumn("upto", F.sum("words").over(upto)).filter("upto > gap")
        .groupBy("key").agg(F.min_by(F.struct("step", (F.col("gap") - F.col("upto") + F.col("words")).alias("rest")), "step").alias("c"))
        .select("key", "c.step", "c.rest"),
        "crossing",
    )
    few = crossing.count() <= FEW_SOURCES
    fine = line.withColumn("step", coarse).join(F.broadcast(crossing) if few else crossing, ["key", "step"])
    fine = fine.groupBy("key", "slot").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    along = W.partitionBy("key").orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    spent = fine.withColumn("upto", F.sum("words").over(along)).filter("upto > rest").groupBy("key").agg(
        F.min_by(F.struct("slot", (F.col("rest") - F.col("upto") + F.col("words")).alias("left")), "slot").alias("c")
    )
    whole = level.groupBy("key").agg(F.sum("words").alias("all"))
    moved = state.join(whole, "key", "left").join(spent, "key", "left")
    stopped, stood = F.col("c").isNotNull(), F.col("all").isNotNull()
    cut = F.struct("phase", (F.col("gap") / 2).alias("most"), F.coalesce("c.slot", F.lit(SLOTS + 1)).cast("long").alias("cut"))
    left = F.when(stopped, F.col("c.left")).when(stood, F.col("gap") - F.col("all")).otherwise(F.col("gap"))
    after = durable(
        moved.select(
            "key", "target",
            (F.col("live") & (left > NEAR * F.col("target")) & F.when(stopped, left < F.col("gap")).otherwise(F.col("phase") < MOST))
            .alias("live"),
            (F.col("phase") + F.when(stopped, 0).otherwise(1)).alias("phase"),
            F.when(stood, F.concat("steps", F.array(cut))).otherwise(F.col("steps")).alias("steps"),
            left.alias("gap"),
        ),
        "gaps",
    )
    discard(level, crossing, state)
    return after


def cuts(sizes: DataFrame, solved: DataFrame) -> DataFrame:
    """Add ``steps`` and a filler: documents that one of the cuts takes get one copy more, and so does
    the filler, named by slot and size.

    Cuts follow until what is missing is below ``NEAR`` of the target or no document may be copied once
    more; each at least halves the gap or ends a phase.
    """
    rows = with_sources(sizes.filter("size > 0"), solved).select(
        "key", "size", whole_copies().alias("whole"), slot(F.col("doc_id")).alias("slot")
    )
    base = rows.groupBy("key").agg(F.sum(F.col("whole") * F.col("size")).alias("base"))
    placed = durable(rows.filter("slot IS NOT NULL").select("key", "size", "whole", "slot"), "placed")
    kind = "array<struct<phase:int,most:double,cut:bigint>>"
    gap = F.col("target") - F.coalesce("base", F.lit(0))
    state = durable(
        solved.join(base, "key", "left").select(
            "key", "target", F.lit(True).alias("live"), F.lit(1).alias("phase"), F.array().cast(kind).alias("steps"),
            gap.cast("double").alias("gap"),
        ),
        "gaps",
    )
    for _ in range(ROUNDS):
        state = one_cut(placed, state)
        if state.filter("live").isEmpty():
            break
    # one document that no cut took, of about the size of what is left, closes most of the gap
    beyond = with_sources(placed, state).filter(~taken(F.col("slot"), 1))
    off = F.abs(F.col("size") - F.col("gap"))
    filler = (
        beyond.filter(off < F.col("gap")).groupBy("key")
        .agg(F.min(F.struct(off.alias("off"), "slot", "size")).alias("f"))
        .select("key", F.col("f.slot").alias("filler_slot"), F.col("f.size").alias("filler_size"))
    )
    out = durable(solved.join(state.select("key", "steps"), "key").join(filler, "key", "left"), "mix")
    discard(placed, state)
    return out


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sizes, sources): key and size of each document, and each source's lambda and cut."""
    sizes = durable(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size")),
        "sizes",
    )
    histogram = durable(sizes.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    return sizes, cuts(sizes, solve(histogram))


def mixture(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken.

    size counts words (null text: 0); taken = size * copies, copies from 0 to 3. A source's taken
    words differ from its target by less than a thousandth of it or by about the shortest document not taken. Rows with a null doc_id are
    ordered by their size alone, and rows that repeat doc_id and size get the same copies; other
    columns are not read. An empty table gives no rows.
    """
    sizes, sources = plan(docs)
    rows = with_sources(sizes, sources).withColumn("copies", copies(F.col("doc_id")))
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """Each document as often as the mixture takes it, with all its columns."""
    _, sources = plan(docs)
    own = [F.col(f"d.`{c}`") for c in docs.columns]
    row = fresh(docs, "copy")
    sized = docs.alias("d").select(
        F.struct(*own).alias(row), F.col("d.doc_id").cast("long").alias("doc_id"),
        source_key(F.col("d.source")).alias("key"), word_count(F.col("d.text")).alias("size"),
    )
    # sequence(1, 0) would run backwards, so documents without a copy leave first
    taken = with_sources(sized, sources).withColumn("copies", copies(F.col("doc_id"))).filter("copies > 0")
    return taken.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(f"{row}.*")
