"""Vector analytics: difference vectors, projections, probes, sweeps over strengths, ablations, error taxonomy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import confusion, macro_f1

EPS = 1e-8


def layers(df: DataFrame, row_id: str, vector: str, size: int) -> DataFrame:
    """Long form (id, layer, h): consecutive slices of ``size`` of a vector, as stand-ins for a model's layers."""
    n = F.floor(F.size(vector) / size).cast("int")
    slices = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("layer"), F.transform(F.slice(vector, k * size + 1, F.lit(size)), lambda x: x.cast("double")).alias("h")))
    rest = [c for c in df.columns if c not in (row_id, vector)]
    return df.select(row_id, *rest, F.inline(slices))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Of length one; a zero vector stays zero."""
    n = norm(a) + EPS
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPS)


def group_means(df: DataFrame, group: str, size: int) -> DataFrame:
    """(layer, group, mean): one average per dimension, so that a partial sum of a task is one row per layer and group."""
    return df.groupBy("layer", group).agg(F.array(*[F.avg(F.get("h", F.lit(k))) for k in range(size)]).alias("mean"), F.count("*").alias("n"))


def mean_difference(means: DataFrame, group: str, plus: str, minus: str, name: str) -> DataFrame:
    """(vector, layer, v): unit differences of two groups' means per layer."""
    a = means.where(F.col(group) == plus).select("layer", F.col("mean").alias("a"))
    b = means.where(F.col(group) == minus).select("layer", F.col("mean").alias("b"))
    return a.join(b, "layer").select(F.lit(name).alias("vector"), "layer", unit(F.zip_with("a", "b", lambda x, y: x - y)).alias("v"))


def injected(h: Column, v: Column, alpha: Column) -> Column:
    return F.zip_with(h, v, lambda x, y: x + alpha * y)


def injected_at(states: Column, v: Column, alpha: Column, mode: Column, first: Column | None = None) -> Column:
    """Tokens' states with alpha * v added to the ``last``, the ``first``, ``all`` or ``none`` of them.

    ``first`` is the place of the first token that is no padding (0 if not given). Other modes count as none; no tokens
    stay no tokens, and null states stay null.
    """
    at = F.lit(0) if first is None else first
    end = F.size(states) - 1
    hit = lambda i: (mode == "all") | ((mode == "last") & (i == end)) | ((mode == "first") & (i == at))
    return F.transform(states, lambda h, i: F.when(hit(i), injected(h, v, alpha)).otherwise(h))


def pooled(states: Column, size: int) -> Column:
    """One vector from the states of a row's tokens: their mean, weighed by place, the last the most. None without tokens.

    A stand-in for what a causal model's last state takes from the tokens before it.
    """
    n = F.size(states)
    total = (n * (n + 1) / 2).cast("double")
    one = lambda k: F.aggregate(F.transform(states, lambda h, i: F.get(h, k) * (i + 1)), F.lit(0.0), lambda a, b: a + b) / total
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one))


#: Settings of an ablation, as a factor of the best strength and the tokens it is added to.
SETTINGS = (("main", 1.0, "last"), ("zero", 0.0, "last"), ("sign_flip", -1.0, "last"), ("first_token", 1.0, "first"), ("all_tokens", 1.0, "all"))


def steered(df: DataFrame, vectors: DataFrame, points: Column, truth: str, states: str, size: int) -> DataFrame:
    """(vector, point's columns, tp, fp, fn, tn, recovered, missed): every row under every vector's points.

    ``vectors`` has a few rows (vector, v, w, bias, ...), which are broadcast; ``points`` is an array of structs with
    alpha and mode, made from their columns. Points are tried inside a row, so that only counts are shuffled.
    """
    base = (F.round(dot(pooled(F.col(states), size), F.col("w")) + F.col("bias"), 9) > 0).cast("int")
    rows = df.where(F.size(states) > 0).crossJoin(F.broadcast(vectors)).select("vector", "v", "w", "bias", F.col(truth).alias("y"), F.col(states).alias("s"), base.alias("p0"), F.explode(points).alias("point"))
    moved = pooled(injected_at(F.col("s"), F.col("v"), F.col("point.alpha"), F.col("point.mode")), size)
    scored = rows.withColumn("p", (F.round(dot(moved, F.col("w")) + F.col("bias"), 9) > 0).cast("int"))
    hit = (F.col("y") == 1) & (F.col("p0") == 0)
    return scored.groupBy("vector", "point").agg(
        F.count_if((F.col("y") == 1) & (F.col("p") == 1)).alias("tp"), F.count_if((F.col("y") == 0) & (F.col("p") == 1)).alias("fp"), F.count_if((F.col("y") == 1) & (F.col("p") == 0)).alias("fn"), F.count_if((F.col("y") == 0) & (F.col("p") == 0)).alias("tn"),
        F.count_if(hit & (F.col("p") == 1)).alias("recovered"), F.count_if(hit).alias("missed"),
    ).select("vector", "point.*", "tp", "fp", "fn", "tn", "recovered", "missed")


def ablation(df: DataFrame, vectors: DataFrame, alphas: Sequence[float], truth: str, states: str, size: int) -> DataFrame:
    """(vector, alpha, setting, macro_f1, d_f1, fn_rec): SETTINGS at each vector's best strength at the last token.

    The best strength is that of ``alphas`` with the most macro F1, the least of equal ones; d_f1 is the gain on strength
    0, fn_rec the share of positives missed without steering that are found (0 if none was missed). Rows without tokens are
    left out; a null label counts nowhere.
    """
    at = lambda alpha, mode: F.struct(alpha.alias("alpha"), F.lit(mode).alias("mode"))
    tried = steered(df, vectors, F.array(*[at(F.lit(float(a)), "last") for a in alphas]), truth, states, size).withColumn("f", F.round(macro_f1(), 6))
    top = best(tried.select("vector", "alpha", "f"), "vector", "f", "alpha").select("vector", F.col("alpha").alias("best"))
    chosen = vectors.join(F.broadcast(top), "vector")
    settings = F.array(*[F.struct((F.col("best") * f).alias("alpha"), F.lit(mode).alias("mode"), F.lit(name).alias("setting"), F.col("best").alias("best")) for name, f, mode in SETTINGS])
    found = steered(df, chosen, settings, truth, states, size)
    recovery = F.coalesce(F.try_divide(F.col("recovered").cast("double"), F.col("missed")), F.lit(0.0))
    out = found.select("vector", F.col("best").alias("alpha"), "setting", macro_f1().alias("f"), F.round(recovery, 6).alias("fn_rec"))
    zero = out.where("setting = 'zero'").select("vector", F.col("f").alias("f0"))
    return out.join(F.broadcast(zero), "vector").select("vector", "alpha", "setting", F.round("f", 6).alias("macro_f1"), F.round(F.col("f") - F.col("f0"), 6).alias("d_f1"), "fn_rec")


def probe_swap(df: DataFrame, source: str, group: str, plus: str, minus: str, truth: str, size: int) -> DataFrame:
    """(train, eval, layer, macro_f1): a probe per layer from each source's rows, on the rows of every source.

    A source that lacks one of the two groups in a layer trains no probe there. Each row meets the probes of its layer
    inside a row (one per source: a few), so rows are read once and summed to counts before any shuffle.
    """
    means = df.groupBy(source, "layer", group).agg(F.array(*[F.avg(F.get("h", F.lit(k))) for k in range(size)]).alias("mean"))
    a, b = (means.where(F.col(group) == g).select(F.col(source).alias("train"), "layer", F.col("mean").alias(n)) for g, n in ((plus, "a"), (minus, "b")))
    probes = a.join(b, ["train", "layer"]).select("train", "layer", F.zip_with("a", "b", lambda x, y: x - y).alias("w"), ((dot(F.col("b"), F.col("b")) - dot(F.col("a"), F.col("a"))) / 2).alias("bias"))
    packed = probes.groupBy("layer").agg(F.collect_list(F.struct("train", "w", "bias")).alias("probes"))
    points = df.join(F.broadcast(packed), "layer").select(F.col(source).alias("eval"), "layer", F.col(truth).alias("y"), "h", F.explode("probes").alias("p"))
    points = points.select(F.col("p.train").alias("train"), "eval", "layer", "y", (F.round(dot(F.col("h"), F.col("p.w")) + F.col("p.bias"), 9) > 0).cast("int").alias("hit"))
    return confusion(points, F.col("y"), F.col("hit"), "train", "eval", "layer").select("train", "eval", "layer", F.round(macro_f1(), 6).alias("macro_f1"))


def axis_gap(df: DataFrame, vectors: DataFrame, group: str, plus: str, minus: str) -> DataFrame:
    """(vector, layer, z): difference of two groups' mean projections over the deviation of both (ddof 0). Null states and other groups
    are left out; a layer that lacks one of the groups has z null, one without deviation a very large one (EPS)."""
    joined = df.where(F.col(group).isin(plus, minus)).join(F.broadcast(vectors), "layer").withColumn("s", dot(F.col("h"), F.col("v")))
    s = joined.groupBy("vector", "layer").agg(F.avg(F.when(F.col(group) == plus, F.col("s"))).alias("a"), F.avg(F.when(F.col(group) == minus, F.col("s"))).alias("b"), F.stddev_pop("s").alias("d"))
    return s.select("vector", "layer", ((F.col("a") - F.col("b")) / (F.col("d") + EPS)).alias("z"))


def centroid_probe(means: DataFrame, group: str, plus: str, minus: str) -> DataFrame:
    """(layer, w, bias): the hyperplane half way between two centroids."""
    a = means.where(F.col(group) == plus).select("layer", F.col("mean").alias("a"))
    b = means.where(F.col(group) == minus).select("layer", F.col("mean").alias("b"))
    joined = a.join(b, "layer")
    return joined.select("layer", F.zip_with("a", "b", lambda x, y: x - y).alias("w"), ((dot(F.col("b"), F.col("b")) - dot(F.col("a"), F.col("a"))) / 2).alias("bias"))


def sweep(df: DataFrame, vectors: DataFrame, probe: DataFrame, alphas: DataFrame, truth: str) -> DataFrame:
    """(vector, layer, alpha, tp, fp, fn, tn, recovered, missed) for every strength of every vector.

    The probe is linear, so a row's score at strength a is w.h + b + a * w.v: rows make one number per layer, vectors
    one, and only these numbers meet the strengths, inside a row, before all is summed to counts. Null states or labels
    count in no cell; layers without a probe or a vector are left out.
    """
    tilt = vectors.join(probe, "layer").select("vector", "layer", dot(F.col("w"), F.col("v")).alias("tilt"), "w", "bias")
    strengths = alphas.agg(F.array_sort(F.collect_set("alpha")).alias("alphas"))  # parameters, a handful
    scored = df.join(F.broadcast(tilt), "layer").crossJoin(F.broadcast(strengths))
    base = (dot(F.col("h"), F.col("w")) + F.col("bias")).alias("base")
    points = scored.select("vector", "layer", F.col(truth).alias("y"), base, "tilt", F.explode("alphas").alias("alpha"))
    points = points.withColumn("p", (F.round(F.col("base") + F.col("alpha") * F.col("tilt"), 9) > 0).cast("int")).withColumn("p0", (F.round("base", 9) > 0).cast("int"))
    counts = confusion(points, F.col("y"), F.col("p"), "vector", "layer", "alpha")
    missed = points.where((F.col("y") == 1) & (F.col("p0") == 0)).groupBy("vector", "layer", "alpha").agg(F.sum("p").alias("recovered"), F.count("*").alias("missed"))
    return counts.join(missed, ["vector", "layer", "alpha"], "left").fillna(0, ["recovered", "missed"])


def scored(table: DataFrame) -> DataFrame:
    """The sweep's counts as macro F1, recall and recovery of what the base missed (0 without any)."""
    recovery = F.coalesce(F.try_divide(F.col("recovered").cast("double"), F.col("missed")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return table.select("vector", "layer", "alpha", F.round(macro_f1(), 6).alias("macro_f1"), F.round(recall, 6).alias("hate_recall"), F.round(recovery, 6).alias("fn_recovery"))


def best(table: DataFrame, group: str, score: str, *ties: str) -> DataFrame:
    """The row with the most ``score`` per group; ties by the other columns ascending."""
    w = Window.partitionBy(group).orderBy(F.desc(score), *ties)
    return table.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def fine_grid(top: DataFrame, least: int, most: int, reach: int = 2, steps: Sequence[float] = (0.0, 0.25, 0.5)) -> DataFrame:
    """(vector, layer, alpha) around each best point: layers within reach, strengths by steps where positive, and the
    strength turned round."""
    near = F.sequence(F.greatest(F.lit(least), F.col("layer") - reach), F.least(F.lit(most), F.col("layer") + reach))
    by = sorted({s for x in steps for s in (x, -x)})
    strengths = F.concat(F.filter(F.transform(F.array(*map(F.lit, by)), lambda s: F.col("alpha") + s), lambda a: a > 0), F.array(-F.col("alpha")))
    return top.select("vector", F.explode(near).alias("layer"), "alpha").select("vector", "layer", F.explode(strengths).alias("alpha")).distinct()


def remaining(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Points that a log does not have yet; strengths are compared as decimals."""
    key = lambda df: df.withColumn("__a", F.col("alpha").cast("decimal(12,4)"))
    return key(grid).join(key(done).select("vector", "layer", "__a"), ["vector", "layer", "__a"], "left_anti").drop("__a")


def error_category(y: Column, base: Column, one: Column, two: Column) -> Column:
    """What became of a row: by its label and the predictions without, and with either vector; the first that fits."""
    return (
        F.when((y == 1) & (base == 0) & (one == 1), "success_fn_recovery_e1")
        .when((y == 1) & (base == 0) & (two == 1), "success_fn_recovery_e2_only")
        .when((y == 1) & (base == 1) & (one == 1), "success_stable_tp")
        .when((y == 0) & (base == 0) & (one == 0), "success_stable_tn")
        .when((y == 1) & (base == 0), "failure_fn_persistent")
        .when((y == 0) & (base == 0), "failure_fp_e1")
        .when((y == 0) & (base == 1), "failure_fp_b0")
        .when((y == 1) & (base == 1), "failure_steering_hurt")
        .otherwise("other")
    )


def random_unit(names: DataFrame, size: int) -> DataFrame:
    """(vector, layer, v): unit vectors of normal numbers made from md5 by Box and Muller."""
    from .stats import uniform

    dims = F.sequence(F.lit(0), F.lit(size - 1))
    draw = lambda k: F.sqrt(-2 * F.log(uniform(F.col("vector"), F.col("layer"), k, F.lit("u")) + 1e-7)) * F.cos(6.283185307179586 * uniform(F.col("vector"), F.col("layer"), k, F.lit("v")))
    return names.select("vector", "layer", unit(F.transform(dims, draw)).alias("v"))
