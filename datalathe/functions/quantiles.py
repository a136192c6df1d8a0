"""Exact quantiles with linear interpolation, computed without gathering a
column into one task.

Spark's ``percentile`` aggregate is exact, but for a global aggregate it
merges a value->count map of *every distinct value* in a single task, which
does not survive a high-cardinality column at scale. Here the k-th order
statistic is found by narrowing: one pass counts values per equal-width bin
(a tiny map-side-combined aggregate), the bin holding rank k becomes the
new bracket, and once a bracket holds at most ``collect_limit`` values they
are fetched and read directly. Every pass is a scan plus a partial
aggregate; nothing unbounded reaches the driver or a single task.

Interpolation follows pandas' ``quantile`` / DuckDB's ``quantile_cont``:
``h = (n - 1) p``, value = ``x[floor h] + (x[ceil h] - x[floor h]) * (h - floor h)``.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalathe.functions.types import col

BINS = 1024
COLLECT_LIMIT = 20_000
MAX_ROUNDS = 24


def _value(name: str):
    """Double view of a column with NaN read as missing."""
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))


def exact_quantiles(
    df: DataFrame,
    columns,
    probs,
    *,
    approx: bool = False,
    accuracy: int = 10_000,
    bins: int = BINS,
    collect_limit: int = COLLECT_LIMIT,
    known: dict | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles ``probs`` of every column in ``columns``: ``{col: [q(p) ...]}``.

    Nulls and NaN are skipped; a column without values gives ``None``.
    ``known`` may give ``{col: (count, min, max)}`` of the non-null values
    already computed by the caller, which saves the first pass.
    ``approx=True`` switches to one ``percentile_approx`` pass (relative
    rank error ``1/accuracy``).
    """
    cols = list(dict.fromkeys(columns))
    probs = [float(p) for p in probs]
    if not cols:
        return {}
    if approx:
        row = df.agg(
            *[F.percentile_approx(_value(c), probs, accuracy).alias(f"q{i}") for i, c in enumerate(cols)]
        ).first()
        return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)) for i, c in enumerate(cols)}

    if known is not None and all(c in known for c in cols):
        stats = {}
        for i, c in enumerate(cols):
            stats[f"n{i}"], stats[f"lo{i}"], stats[f"hi{i}"] = known[c]
    else:
        aggs = []
        for i, c in enumerate(cols):
            v = _value(c)
            aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        stats = df.agg(*aggs).first()

    # target ranks per column, state: [lo, hi, below, count]
    state: dict[tuple[int, int], list] = {}
    plans: dict[int, list[tuple[int, int, float]]] = {}
    for i, _c in enumerate(cols):
        n = stats[f"n{i}"]
        if not n:
            continue
        lo, hi = stats[f"lo{i}"], stats[f"hi{i}"]
        plan = []
        for p in probs:
            h = (n - 1) * p
            r_lo = int(math.floor(h))
            r_hi = min(r_lo + 1, n - 1) if h > r_lo else r_lo
            plan.append((r_lo, r_hi, h - r_lo))
            for r in (r_lo, r_hi):
                state.setdefault((i, r), [lo, hi, 0, n])
        plans[i] = plan

    resolved: dict[tuple[int, int], float] = {}
    for _ in range(MAX_ROUNDS):
        pending = {}
        for key, (lo, hi, below, cnt) in state.items():
            if key in resolved:
                continue
            if lo == hi:
                resolved[key] = lo
            else:
                pending[key] = (lo, hi, below, cnt)
        if not pending:
            break
        small = {k: v for k, v in pending.items() if v[3] <= collect_limit}
        large = {k: v for k, v in pending.items() if v[3] > collect_limit}
        if small:
            resolved.update(_read_brackets(df, cols, small))
        if not large:
            break
        _narrow(df, cols, large, state, bins)
    else:
        leftover = {k: v for k, v in state.items() if k not in resolved}
        resolved.update(_fallback(df, cols, leftover))

    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        if i not in plans:
            out[c] = [None] * len(probs)
            continue
        vals = []
        for r_lo, r_hi, frac in plans[i]:
            a, b = resolved[(i, r_lo)], resolved[(i, r_hi)]
            vals.append(a + (b - a) * frac if frac and a != b else a)
        out[c] = vals
    return out


def _bin_position(v, lo, hi, bins: int, finite: bool):
    """Monotone map of values in ``[lo, hi]`` to ``0..bins-1``.

    Finite brackets are split evenly (halves keep the span finite). A
    bracket with an infinite end puts -inf and +inf in the end bins and
    spreads finite values by ``sign(v) log2(1 + |v|)``, which is monotone and
    bounded by about +-1024 for every double; the next round's brackets are
    then finite."""
    if finite:
        pos = (v * 0.5 - lo * 0.5) / (hi * 0.5 - lo * 0.5) * F.lit(float(bins))
        return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(pos).cast("int")))
    inf = float("inf")
    t = F.signum(v) * F.log2(F.lit(1.0) + F.abs(v))
    mid = F.lit(1) + F.floor((t + F.lit(1025.0)) / F.lit(2050.0) * F.lit(float(bins - 2))).cast("int")
    return (F.when(v == F.lit(-inf), F.lit(0)).when(v == F.lit(inf), F.lit(bins - 1))
            .otherwise(F.least(F.lit(bins - 2), F.greatest(F.lit(1), mid))))


def _probes(pending: dict) -> dict[tuple[int, float, float], int]:
    """One probe per distinct (column, bracket); ranks sharing a bracket share it."""
    probes: dict[tuple[int, float, float], int] = {}
    for (i, _r), (lo, hi, _b, _n) in pending.items():
        probes.setdefault((i, lo, hi), len(probes))
    return probes


def _tagged(df: DataFrame, cols, probes, with_bin: int | None) -> DataFrame:
    """Rows ``(p, [b,] v)``: every value tagged with each probe whose bracket holds it."""
    items = []
    for (i, lo, hi), pid in probes.items():
        v = _value(cols[i])
        fields = [F.lit(pid).alias("p")]
        if with_bin is not None:
            finite = math.isfinite(lo) and math.isfinite(hi)
            fields.append(_bin_position(v, F.lit(lo), F.lit(hi), with_bin, finite).alias("b"))
        fields.append(v.alias("v"))
        items.append(F.when(v.between(lo, hi), F.struct(*fields)))
    # explode, then drop the nulls: a lambda filter on the array would run
    # interpreted, outside whole-stage codegen
    return df.select(F.explode(F.array(*items)).alias("t")).where(F.col("t").isNotNull()).select("t.*")


def _narrow(df, cols, pending, state, bins) -> None:
    probes = _probes(pending)
    hist = (
        _tagged(df, cols, probes, bins)
        .groupBy("p", "b")
        .agg(F.count("*").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
        .collect()
    )
    by_probe = defaultdict(list)
    for r in hist:
        by_probe[r["p"]].append((r["b"], r["n"], r["mn"], r["mx"]))
    for rows in by_probe.values():
        rows.sort()
    for key, (lo, hi, below, _cnt) in pending.items():
        rows = by_probe[probes[(key[0], lo, hi)]]
        acc = below
        for _b, n, mn, mx in rows:
            if key[1] < acc + n:
                state[key] = [mn, mx, acc, n]
                break
            acc += n


def _read_brackets(df, cols, pending) -> dict:
    """Pick each rank inside its (small) bracket on the executors: one sorted
    array of at most ``collect_limit`` values per bracket, then
    ``element_at``; only the answers reach the driver."""
    probes = _probes(pending)
    arrays = _tagged(df, cols, probes, None).groupBy("p").agg(F.sort_array(F.collect_list("v")).alias("a"))
    wanted = []
    for key, (lo, hi, below, _cnt) in pending.items():
        wanted.append((probes[(key[0], lo, hi)], key[1] - below + 1, key[0], key[1]))
    spark = df.sparkSession
    picks = spark.createDataFrame(wanted, "p int, pos long, i int, r long")
    # picks holds one row per wanted rank: a proven small side
    got = arrays.join(F.broadcast(picks), "p").select("i", "r", F.element_at("a", F.col("pos").cast("int")).alias("v"))
    return {(row["i"], row["r"]): row["v"] for row in got.collect()}


def _fallback(df, cols, pending) -> dict:
    """After many rounds the bracket is a sliver of the value range; Spark's
    exact ``percentile`` over just the bracket rows is then small."""
    out = {}
    for (i, r), (lo, hi, below, cnt) in pending.items():
        v = _value(cols[i])
        k = r - below
        p = k / (cnt - 1) if cnt > 1 else 0.0
        got = df.filter(v.between(lo, hi)).agg(F.percentile(v, F.lit(p)).alias("q")).first()["q"]
        out[(i, r)] = got
    return out


# ------------------------------------------------------------ per group

GROUP_BROADCAST_MAX = 1_000_000
# Without a broadcast each group is dealt over this many tasks.
GROUP_SALTS = 32
# per-group arrays hold at most this many doubles (0.8 MB)
GROUP_COLLECT_LIMIT = 100_000


def grouped_quantiles(df: DataFrame, keys, column: str, probs, *, bins: int = BINS,
                      collect_limit: int = GROUP_COLLECT_LIMIT, prefix: str = "q") -> DataFrame:
    """Exact quantiles of ``column`` per group of ``keys``: rows
    ``(keys..., q0, q1, ...)`` (one column per probability).

    The same narrowing as :func:`exact_quantiles`, carried out per group with
    DataFrame operations: a state table of one row per (group, wanted rank)
    holds each bracket; a round joins the data to the pending brackets, counts
    values per (group, bracket, bin) with map-side combine, and a running sum
    over at most ``bins`` rows per bracket picks the bin holding each rank.
    Brackets of at most ``collect_limit`` values are read from a sorted array.
    The state is checkpointed each round (it has one row per group and rank),
    and nothing gathers a whole group: a group holding a third of the table
    costs the same few passes as any other.
    """
    from pyspark.sql import Window

    from datalathe.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    keys = list(keys)
    probs = [float(p) for p in probs]
    kcols = [col(k) for k in keys]
    base = df.select(*kcols, _value(column).alias("__v")).where(F.col("__v").isNotNull())
    for k in keys:
        base = base.where(col(k).isNotNull())

    stats = base.groupBy(*kcols).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"),
                                     F.max("__v").alias("__hi"))
    largest = stats.agg(F.max("__n")).first()[0] or 0
    if largest <= collect_limit:
        # every group is small: read each rank from one sorted array per group
        # (at most collect_limit values, checked above)
        arrays = base.groupBy(*kcols).agg(F.sort_array(F.collect_list("__v")).alias("__a"))
        n = F.size("__a")
        qs = []
        for i, p in enumerate(probs):
            h = (n - 1).cast("double") * F.lit(p)
            r_lo = F.floor(h).cast("int")
            frac = h - r_lo
            a = F.element_at("__a", r_lo + 1)
            b = F.element_at("__a", F.least(r_lo + 2, n))
            qs.append(F.when((frac == 0) | (a == b), a).otherwise(a + (b - a) * frac).alias(f"{prefix}{i}"))
        return arrays.select(*[F.col(f"`{k}`") for k in keys], *qs)
    # one row per (group, probability, side): the wanted rank and its weight
    targets = []
    for i, p in enumerate(probs):
        h = (F.col("__n") - 1) * F.lit(p)
        r_lo = F.floor(h).cast("long")
        frac = h - r_lo
        r_hi = F.when(frac > 0, F.least(r_lo + 1, F.col("__n") - 1)).otherwise(r_lo)
        targets.append(F.struct(F.lit(i).alias("pi"), F.lit(0).alias("side"), r_lo.alias("r"), frac.alias("frac")))
        targets.append(F.struct(F.lit(i).alias("pi"), F.lit(1).alias("side"), r_hi.alias("r"), frac.alias("frac")))
    state = (stats.select(*[F.col(f"`{k}`") for k in keys], "__lo", "__hi", "__n",
                          F.explode(F.array(*targets)).alias("t"))
             .select(*[F.col(f"`{k}`") for k in keys], "t.pi", "t.side", "t.r", "t.frac",
                     F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), F.lit(0).cast("long").alias("below"),
                     F.col("__n").alias("cnt"))
             .checkpoint(eager=True))
    n_groups = state.count() // (2 * max(1, len(probs)))

    few = n_groups * max(1, len(probs)) * 2 <= GROUP_BROADCAST_MAX
    salts = 1 if few else GROUP_SALTS

    def join_side(side):
        return F.broadcast(side) if few else side

    def spread(side):
        """Rows dealt over the salts by value: without a broadcast, a hot group's rows meet their brackets in as many
        tasks, and the histogram's aggregate deals them anew by bracket and bin."""
        return side.withColumn("__salt", F.pmod(F.xxhash64("__v"), F.lit(salts)).cast("int"))

    def salted(side):
        return side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    key_names = [f"`{k}`" for k in keys]
    for _ in range(MAX_ROUNDS):
        open_ = state.where((F.col("lo") < F.col("hi")) & (F.col("cnt") > collect_limit))
        if open_.isEmpty():
            break
        probes = open_.select(*key_names, "lo", "hi").distinct()
        inf = F.lit(float("inf"))
        finite = (F.abs(F.col("lo")) < inf) & (F.abs(F.col("hi")) < inf)
        b = F.when(finite, _bin_position(F.col("__v"), F.col("lo"), F.col("hi"), bins, True)).otherwise(
            _bin_position(F.col("__v"), F.col("lo"), F.col("hi"), bins, False))
        tagged = (spread(base).join(join_side(salted(probes)), [*keys, "__salt"])
                  .where(F.col("__v").between(F.col("lo"), F.col("hi")))
                  .select(*key_names, "lo", "hi", b.alias("b"), "__v"))
        hist = tagged.groupBy(*key_names, "lo", "hi", "b").agg(
            F.count("*").alias("bn"), F.min("__v").alias("bmn"), F.max("__v").alias("bmx"))
        w = Window.partitionBy(*key_names, "pi", "side").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        moved = (open_.join(hist, keys + ["lo", "hi"])
                 .withColumn("acc", F.col("below") + F.sum("bn").over(w))
                 .where((F.col("r") < F.col("acc")) & (F.col("r") >= F.col("acc") - F.col("bn")))
                 .select(*key_names, "pi", "side", "r", "frac", F.col("bmn").alias("lo"), F.col("bmx").alias("hi"),
                         (F.col("acc") - F.col("bn")).alias("below"), F.col("bn").alias("cnt")))
        done = state.where((F.col("lo") >= F.col("hi")) | (F.col("cnt") <= collect_limit))
        state = done.unionByName(moved).checkpoint(eager=True)

    small = state.where(F.col("lo") < F.col("hi"))
    probes = small.select(*key_names, "lo", "hi").distinct()
    arrays = (spread(base).join(join_side(salted(probes)), [*keys, "__salt"]).where(F.col("__v").between(F.col("lo"), F.col("hi")))
              .groupBy(*key_names, "lo", "hi").agg(F.sort_array(F.collect_list("__v")).alias("a")))
    picked = (small.join(arrays, keys + ["lo", "hi"])
              .select(*key_names, "pi", "side", "frac",
                      F.element_at("a", (F.col("r") - F.col("below") + 1).cast("int")).alias("x")))
    fixed = state.where(F.col("lo") >= F.col("hi")).select(*key_names, "pi", "side", "frac", F.col("lo").alias("x"))
    vals = picked.unionByName(fixed)
    per_p = vals.groupBy(*key_names, "pi").agg(
        F.max(F.when(F.col("side") == 0, F.col("x"))).alias("a"),
        F.max(F.when(F.col("side") == 1, F.col("x"))).alias("b"), F.max("frac").alias("frac"))
    lerp = F.when((F.col("frac") == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(
        F.col("a") + (F.col("b") - F.col("a")) * F.col("frac"))
    per_p = per_p.select(*key_names, "pi", lerp.alias("q"))
    return per_p.groupBy(*key_names).agg(
        *[F.max(F.when(F.col("pi") == i, F.col("q"))).alias(f"{prefix}{i}") for i in range(len(probs))])
