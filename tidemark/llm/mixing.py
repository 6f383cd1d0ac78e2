"""Mixing sources to target weights with DataFrame functions only: iterative proportional fitting, then calibrated sampling.

Documents fall into cells of source, language and topic. The cells' token weights are raked to the target marginals of each dimension in
turn, until no marginal is off by more than a tolerance. A document is drawn with the probability that gives its cell its raked share of
the token budget; where that would pass 1 the cell is taken whole and the rest of the budget spread over the other cells. The draw is a
hash of id and seed, so it doesn't depend on partitions.

Nulls in a dimension are a category of their own (the empty one). A category that the targets lack has the share 0, so nothing of it is drawn; shares of
categories without tokens go to the others in proportion. Targets that no weights can meet give a RuntimeWarning that names the largest error, and the last
round's weights. Null and empty texts have no tokens and are drawn with their cell's probability; cells without tokens are taken whole. Repeated rows
share their draw. Extra columns pass through; ones named topic, n_tokens or p_keep are replaced.
"""

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import own, written

DIMENSIONS = ("source", "lang", "topic")
#: Targets are the dimension's own token shares, raised to this power.
TEMPER = 0.5
#: Tokens to draw, as a share of all.
BUDGET = 0.5
#: The largest error of a marginal's share that counts as met. Raking ends with a warning after ROUNDS rounds, or where STALL rounds have not lessened the error by a tenth.
TOLERANCE, ROUNDS, STALL = 1e-9, 500, 40
#: Combinations that the two smaller dimensions may have; so many sums come to the driver in a round. The largest dimension has no bound.
GRID = 1 << 16
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
PLACES = 1 << 52


def topic(text: Column) -> Column:
    """A coarse topic from the text's form."""
    return F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("!! ")), "loud").when(F.contains(text, F.lit("icense")), "license").otherwise("prose")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _categories(cells: DataFrame, dimension: str) -> list[str]:
    found = [r[0] for r in cells.select(dimension).distinct().limit(GRID + 1).collect()]
    return sorted(found)


def _shares(cells: DataFrame, targets: DataFrame, dimension: str) -> DataFrame:
    """(dimension, share): the targets over the categories that have weight, summing to 1; 0 for those that the targets lack."""
    there = cells.groupBy(dimension).agg(F.sum("w").alias("w"))
    found = there.join(targets.groupBy(dimension).agg(F.sum("share").alias("share")), dimension, "left").select(dimension, F.when(F.col("w") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0).alias("share"))
    total = found.agg(F.sum("share")).first()[0] or 1.0
    return found.select(dimension, (F.col("share") / total).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """cells has the dimensions, t (tokens) and w (start weights, 0 where t is); targets: by dimension, that dimension and share. Returns cells with raked w, summing to 1.

    The cells of each category of the largest dimension are one row, so its step needs no shuffle; a round is one job, which sums the other two
    dimensions' combinations, and their factors follow from those sums."""
    n = cells.agg(*(F.countDistinct(d).alias(d) for d in DIMENSIONS)).first()
    first, *rest = sorted(DIMENSIONS, key=lambda d: (-n[d], DIMENSIONS.index(d)))
    if n[rest[0]] * n[rest[1]] > GRID:
        raise ValueError(f"{n[rest[0]]} x {n[rest[1]]} combinations of {rest[0]} and {rest[1]}; {GRID} are allowed")
    names = {d: _categories(cells, d) for d in rest}
    place = {d: F.array_position(F.lit(names[d] or [""]), F.col(d)).cast("int") - 1 for d in rest}
    share = {d: {r[0]: r[1] for r in _shares(cells, targets[d], d).collect()} for d in rest}
    want = [[share[d][c] for c in names[d]] for d in rest]
    rows = cells.groupBy(first).agg(F.collect_list(F.struct(place[rest[0]].alias("i"), place[rest[1]].alias("j"), "t", "w")).alias("own"))
    rows = written(rows.join(_shares(cells, targets[first], first).hint("merge"), first), "op4-rows")
    factor, width = [[1.0] * len(x) or [1.0] for x in want], max(1, len(want[1]))

    def weighed() -> DataFrame:
        """The rows' cells with the weights that the factors give, each row raked to its share."""
        a, b = (F.lit(x) for x in factor)
        w = rows.select(first, "share", F.transform("own", lambda c: F.struct(c["i"].alias("i"), c["j"].alias("j"), c["t"].alias("t"), (c["w"] * F.get(a, c["i"]) * F.get(b, c["j"])).alias("w"))).alias("own"))
        total = F.aggregate("own", F.lit(0.0), lambda s, c: s + c["w"])
        return w.select(first, "own", F.when(total > 0, F.col("share") / total).otherwise(0.0).alias("k"))

    best, since = float("inf"), 0
    for _ in range(rounds):
        cell = weighed().select("k", F.explode("own").alias("c"))
        sums = [[0.0] * width for _ in factor[0]]
        for r in cell.groupBy((F.col("c.i") * width + F.col("c.j")).alias("g")).agg(F.sum(F.col("c.w") * F.col("k")).alias("w")).collect():
            sums[r.g // width][r.g % width] = r.w
        have = [sum(x) for x in sums], [sum(x) for x in zip(*sums, strict=True)]
        error = max((abs(x - y) for h, w in zip(have, want, strict=True) for x, y in zip(h, w, strict=False)), default=0.0)
        since = 0 if error < 0.9 * best else since + 1
        best = min(best, error)
        if error <= tolerance or since >= STALL:
            break
        step = [w / h if h > 0 else 0.0 for w, h in zip(want[0], have[0], strict=True)]
        factor[0] = [f * s for f, s in zip(factor[0], step, strict=True)]
        have = [sum(x * s for x, s in zip(column, step, strict=True)) for column in zip(*sums, strict=True)]
        factor[1] = [f * (w / h if h > 0 else 0.0) for f, w, h in zip(factor[1], want[1], have, strict=True)]
    if best > tolerance:
        warnings.warn(f"the targets can't be met: a share is off by {error:.3g}", RuntimeWarning, stacklevel=2)
    out = weighed().select(first, "k", F.explode("own").alias("c"))
    other = [F.get(F.lit(names[d] or [""]), F.col(f"c.{x}")).alias(d) for d, x in zip(rest, "ij", strict=True)]
    return out.select(first, *other, "c.t", (F.col("c.w") * F.col("k")).alias("w")).select(*DIMENSIONS, "t", "w")


def tempered(cells: DataFrame, temper: float = TEMPER) -> dict[str, DataFrame]:
    """Targets: each category's own tokens to the power of ``temper``, as shares."""
    out = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(d).agg(F.sum("t").cast("double").alias("t"))
        total = sums.agg(F.sum(F.pow("t", F.lit(temper)))).first()[0] or 1.0
        out[d] = sums.select(d, (F.pow("t", F.lit(temper)) / total).alias("share"))
    return out


def probabilities(cells: DataFrame, budget: float) -> DataFrame:
    """Adds p. Cells taken whole leave the rest of the budget to the others, turn by turn until no more cells are."""
    total = cells.agg(F.sum("t")).first()[0] or 0
    scale, whole = budget * total, -1
    rate = lambda: F.when(F.col("t") > 0, scale * F.col("w") / F.col("t")).otherwise(1.0)
    while True:
        r = cells.agg(F.sum(F.when(rate() >= 1, F.col("t")).otherwise(0)).alias("whole"), F.sum(F.when(rate() >= 1, 0.0).otherwise(F.col("w"))).alias("open")).first()
        if not r.open or r.whole <= whole:
            break
        scale, whole = max(scale, (budget * total - r.whole) / r.open), r.whole
    return cells.withColumn("p", F.least(F.lit(1.0), rate()))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from id and seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / PLACES


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: str = SEED) -> DataFrame:
    """The drawn documents with topic, n_tokens and p_keep."""
    o = own(docs)
    dims = {f"{o}{d}": F.coalesce(topic(F.col("text")) if d == "topic" else F.col(d).cast("string"), F.lit("")) for d in DIMENSIONS}
    keyed = docs.withColumns(dims | {f"{o}n": tokens(F.col("text"))})
    cells = keyed.groupBy(*(F.col(f"{o}{d}").alias(d) for d in DIMENSIONS)).agg(F.sum(f"{o}n").alias("t")).withColumn("w", F.col("t").cast("double"))
    cells = written(cells, "op4-cells")
    raked = written(rake(cells, targets or tempered(cells)), "op4-raked")
    rates = written(probabilities(raked, budget).select(*(F.col(d).alias(f"{o}{d}") for d in DIMENSIONS), F.col("p").alias(f"{o}p")), "op4-rates")
    names = [c for c in docs.columns if c.lower() not in ("topic", "n_tokens", "p_keep")]
    out = keyed.join(rates, [f"{o}{d}" for d in DIMENSIONS]).where(draw(F.col("doc_id"), seed) < F.col(f"{o}p"))
    return out.select(*names, F.col(f"{o}topic").alias("topic"), F.col(f"{o}n").alias("n_tokens"), F.col(f"{o}p").alias("p_keep"))


def op4_raking(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("p_keep", 6).alias("p_keep"))


#: Rounds and turns of the SQL: more than the given tables need to settle.
SQL_ROUNDS, SQL_SPREADS = 200, 10


def op4_sql() -> str:
    """The same in DuckDB's SQL: a recursive table for the rounds, the turns written out."""
    steps = [
        f"""d as (select doc_id, source, lang, coalesce(source, '') _source, coalesce(lang, '') _lang,
            case when contains(text, ' | ') then 'table' when contains(text, '!! ') then 'loud' when contains(text, 'icense') then 'license' else 'prose' end _topic,
            coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint n_tokens from documents)""",
        "c0 as (select _source, _lang, _topic, sum(n_tokens)::bigint t, sum(n_tokens)::double w from d group by all)",
    ]
    for x in DIMENSIONS:
        steps.append(f"g{x} as (select _{x}, sum(t)::double ^ {TEMPER} / (select sum(s) from (select sum(t)::double ^ {TEMPER} s from c0 group by _{x})) g{x} from c0 group by _{x})")
    inner = "r"
    for x in DIMENSIONS:
        inner = f"(select * replace (case when m > 0 then w * (g{x} / m) else 0 end as w) from (select * exclude (m) , sum(w) over (partition by _{x}) m from {inner}))"
    steps.append(f"r as (select 0 k, *, 0.0::double m from c0 join gsource using (_source) join glang using (_lang) join gtopic using (_topic) union all select * replace (k + 1 as k) from {inner} where k < {SQL_ROUNDS})")
    steps.append(f"c as materialized (select _source, _lang, _topic, t, w from r where k = {SQL_ROUNDS})")
    steps.append(f"s0 as (select {BUDGET}::double * sum(t) x from c)")
    rate = lambda i: f"case when t > 0 then (select x from s{i}) * w / t else 1.0 end"
    for i in range(SQL_SPREADS):
        steps.append(f"s{i + 1} as materialized (select coalesce(greatest((select x from s{i}), ({BUDGET}::double * sum(t) - sum(case when {rate(i)} >= 1 then t else 0 end)) / nullif(sum(case when {rate(i)} >= 1 then 0.0 else w end), 0)), (select x from s{i})) x from c)")
    steps.append(f"p as (select _source, _lang, _topic, least(1.0, {rate(SQL_SPREADS)}) p from c)")
    return f"""with recursive {", ".join(steps)} select d.doc_id, d.source, d.lang, d._topic topic, d.n_tokens, round(p.p, 6) p_keep from d join p using (_source, _lang, _topic)
        where ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double / {PLACES} < p.p"""
