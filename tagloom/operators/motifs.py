"""Motifs of the multiplex tag graph: edges, four-cycles, rectangles, zig-zags, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.lineage import cut

#: Layers in the order in which the first of equals dominates.
LAYER_ORDER = ("cooccurrence", "synchronicity", "semantic", "semiotic", "glyph", "inhibition")
WEIGHTS = {"cooccurrence": 0.5, "synchronicity": 0.3, "semantic": 0.2, "semiotic": 0.15, "glyph": 0.2, "inhibition": 0.2}


def scored_edges(tensor: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Edges a < b with a score (sum of weighted layers, positive) and the layer that dominates.

    tensor: tag_a_id, tag_b_id and the layers, semiotic in two directions of
    which the larger counts.
    """
    weights = WEIGHTS | (weights or {})
    flat = tensor.withColumn("semiotic", F.greatest("semiotic_forward", "semiotic_reverse"))
    parts = {x: F.lit(weights[x]) * F.col(x) for x in LAYER_ORDER}
    score = sum((parts[x] for x in LAYER_ORDER[1:]), parts[LAYER_ORDER[0]])
    top = F.greatest(*parts.values())
    layer = F.coalesce(*[F.when(parts[x] == top, F.lit(x)) for x in LAYER_ORDER])
    vector = F.array(*[parts[x] for x in LAYER_ORDER])
    return flat.select(F.col("tag_a_id").alias("a"), F.col("tag_b_id").alias("b"), score.alias("score"), layer.alias("layer"), vector.alias("profile")).filter("score > 0")


def select_edges(edges: DataFrame, least: float = 0.05, overall: int = 500, per_layer: int = 100, names: DataFrame | None = None, min_length: int = 2) -> DataFrame:
    """The ``overall`` best edges and the ``per_layer`` best of each layer.

    names: (tag_id, name); where given, both tags of an edge have a name of
    ``min_length`` characters at least.
    """
    good = edges.filter(F.col("score") >= least)
    if names is not None:
        long = names.filter(F.length("name") >= min_length).select("tag_id")
        for end in ("a", "b"):
            good = good.join(long.withColumnRenamed("tag_id", end), end, "left_semi")
    order = [F.col("score").desc(), F.col("a"), F.col("b")]
    best = good.orderBy(*order).limit(overall)
    by_layer = good.withColumn("_rl", F.row_number().over(Window.partitionBy("layer").orderBy(*order))).filter(F.col("_rl") <= per_layer).drop("_rl")
    return best.unionByName(by_layer).dropDuplicates(["a", "b"])


def edge_evidence(selected: DataFrame, memory_tags: DataFrame) -> DataFrame:
    """(a, b, memory_id): the memories that hold both tags of a selected edge.  A memory meets only its edges, not all its pairs."""
    held = memory_tags.select("memory_id", "tag_id").distinct()
    first = held.withColumnRenamed("tag_id", "a").join(selected.select("a", "b"), "a")
    return first.join(held.withColumnRenamed("tag_id", "b"), ["memory_id", "b"]).select("a", "b", "memory_id")


def shared_memories(cycles: DataFrame, evidence: DataFrame) -> DataFrame:
    """(tag_ids, shared): number of memories on every side that has any, of the cycles with two such sides at least.

    evidence: (a, b, memory_id), a < b.  Cycles meet it side by side, in rows.
    """
    corner = [F.element_at("tag_ids", i) for i in (1, 2, 3, 4)]
    ends = [F.struct(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")) for u, v in zip(corner, corner[1:] + corner[:1], strict=True)]
    sides = cycles.select("tag_ids", F.explode(F.array(*ends)).alias("_s")).select("tag_ids", "_s.a", "_s.b")
    met = sides.join(evidence.select("a", "b", "memory_id").distinct(), ["a", "b"])
    kept = met.select("tag_ids", "a", "b").distinct().groupBy("tag_ids").agg(F.count(F.lit(1)).alias("_k")).filter("_k >= 2")
    per = met.groupBy("tag_ids", "memory_id").agg(F.count(F.lit(1)).alias("_c"))
    return per.join(kept, "tag_ids").filter("_c = _k").groupBy("tag_ids").agg(F.count(F.lit(1)).alias("shared"))


def square_motifs(edges: DataFrame, selected: DataFrame, least: float = 0.05, min_consistency: float = 0.65, min_colors: int = 2, distinct_sides: bool = True, evidence: DataFrame | None = None) -> DataFrame:
    """Four-cycles of ``min_colors`` layers at least, each once; with ``distinct_sides`` neighbouring sides differ in layer.

    A pair of wedges over a diagonal.  The selection bounds the edges before
    the join.  Diagonals look up all edges: drawn if one is there, else void,
    implied or missing by the support of the two paths.  Memories shared by
    the sides (evidence, see ``shared_memories``) add to the interest.  The
    vector score is positive where opposite sides are more alike than
    neighbouring ones.
    """
    both = selected.select("a", "b", "score", "layer", "profile").unionByName(selected.select(F.col("b").alias("a"), F.col("a").alias("b"), "score", "layer", "profile"))
    w1 = both.select(F.col("a").alias("p"), F.col("b").alias("m"), F.col("score").alias("s1"), F.col("layer").alias("l1"), F.col("profile").alias("v1"))
    w2 = both.select(F.col("a").alias("m"), F.col("b").alias("q"), F.col("score").alias("s2"), F.col("layer").alias("l2"), F.col("profile").alias("v2"))
    wedges = w1.join(w2, "m").filter("p < q")
    if distinct_sides:
        wedges = wedges.filter("l1 <> l2")
    x, y = (wedges.select("p", "q", *[F.col(c).alias(f"{c}{n}") for c in ("m", "s1", "s2", "l1", "l2", "v1", "v2")]) for n in "xy")
    # p is the smallest corner, mx before my: the canonical rotation and direction of the cycle.
    cycles = x.join(y, ["p", "q"]).filter("mx < my and p < mx")
    if distinct_sides:
        cycles = cycles.filter("l1x <> l1y and l2x <> l2y")
    corners = F.array("p", "mx", "q", "my")
    layers = F.array("l1x", "l2x", "l2y", "l1y")
    scores = [F.col(c) for c in ("s1x", "s2x", "s2y", "s1y")]
    out = cycles.select("p", "mx", "q", "my", corners.alias("tag_ids"), layers.alias("side_layers"), ((scores[0] + scores[1] + scores[2] + scores[3]) / 4).alias("side_score"), *scores, "v1x", "v2x", "v2y", "v1y").filter(F.size(F.array_distinct("side_layers")) >= min_colors)

    def unit(v: Column) -> Column:
        n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
        return F.when(n > 0, F.transform(v, lambda e: e / n)).otherwise(v)

    def path(u: str, v: str) -> Column:
        return F.zip_with(unit(F.col(u)), unit(F.col(v)), lambda a, b: a + b)

    def cosine(u: Column, v: Column) -> Column:
        def size(z: Column) -> Column:
            return F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, e: s + e * e))

        d = F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
        return F.when(size(u) * size(v) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), d / (size(u) * size(v))))).otherwise(0.0)

    ac = cosine(path("v1x", "v2x"), path("v1y", "v2y"))
    bd = cosine(path("v1x", "v1y"), path("v2x", "v2y"))
    ring = [F.col(c) for c in ("v1x", "v2x", "v2y", "v1y")]
    opposite = (cosine(ring[0], ring[2]) + cosine(ring[1], ring[3])) / 2
    beside = sum((cosine(ring[i], ring[(i + 1) % 4]) for i in range(1, 4)), cosine(ring[0], ring[1])) / 4
    out = out.withColumns({"ac_consistency": ac, "bd_consistency": bd, "vector_score": opposite - beside})
    out = out.withColumn("ac_support", F.least((F.col("s1x") + F.col("s2x")) / 2, (F.col("s1y") + F.col("s2y")) / 2) * F.col("ac_consistency"))
    out = out.withColumn("bd_support", F.least((F.col("s1x") + F.col("s1y")) / 2, (F.col("s2x") + F.col("s2y")) / 2) * F.col("bd_consistency"))
    for name, u, v in (("ac", "p", "q"), ("bd", "mx", "my")):
        found = edges.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("score").alias(f"{name}_edge"))
        out = out.join(found, (F.least(u, v) == F.col("_a")) & (F.greatest(u, v) == F.col("_b")), "left").drop("_a", "_b")
        support = F.col(f"{name}_support")
        status = F.when(F.col(f"{name}_edge") >= least, "drawn").when((support >= least) & (F.col(f"{name}_consistency") >= min_consistency), "void").when(support > 0, "implied").otherwise("missing")
        gap = F.greatest(F.lit(0.0), support - F.coalesce(f"{name}_edge", F.lit(0.0)))
        out = out.withColumns({f"{name}_status": status, f"{name}_gap": gap})
    void = F.when(F.col("ac_status") == "void", F.col("ac_gap")).otherwise(0.0) + F.when(F.col("bd_status") == "void", F.col("bd_gap")).otherwise(0.0)
    drawn = (F.col("ac_status") == "drawn").cast("int") + (F.col("bd_status") == "drawn").cast("int")
    diversity = F.size(F.array_distinct("side_layers"))
    centre = (F.col("ac_consistency") + F.col("bd_consistency")) / 2
    out = out.withColumns({"void_score": void, "center_score": centre, "diversity": diversity})
    if evidence is None:
        out = out.withColumn("shared", F.lit(0).cast("long"))
    else:
        out = cut(out.drop("v1x", "v2x", "v2y", "v1y"))
        out = out.join(shared_memories(out, evidence), "tag_ids", "left").fillna({"shared": 0})
    interest = F.col("side_score") * (1 + F.col("diversity") / 6) + F.col("void_score") + 0.5 * F.col("center_score") + 0.05 * F.log1p(F.col("shared").cast("double")) - 0.1 * drawn
    return out.select("tag_ids", "side_layers", "diversity", "ac_status", "bd_status", "side_score", "void_score", "center_score", "vector_score", "shared", interest.alias("interestingness"))


def side_class(layers: Column) -> Column:
    """Class of four side layers: uniform, zigzag, banded, three-one, mixed."""
    a, b, c, d = (F.element_at(layers, i) for i in range(1, 5))
    kinds = F.size(F.array_distinct(layers))
    most = F.array_max(F.transform(layers, lambda x: F.size(F.filter(layers, lambda y: x == y))))
    return (
        F.when(kinds == 1, "uniform").when((a == c) & (b == d), "zigzag").when(((a == b) & (c == d)) | ((b == c) & (d == a)), "banded").when((kinds == 2) & (most == 3), "three-one").otherwise("mixed")
    )


def side_signature(layers: Column) -> Column:
    """The least of the eight rotations and reflections of the side layers, joined by ``|``."""
    order = [[0, 1, 2, 3], [1, 2, 3, 0], [2, 3, 0, 1], [3, 0, 1, 2], [3, 2, 1, 0], [2, 1, 0, 3], [1, 0, 3, 2], [0, 3, 2, 1]]
    return F.array_min(F.array(*[F.concat_ws("|", *[F.element_at(layers, i + 1) for i in o]) for o in order]))


def zigzag_report(motifs: DataFrame) -> DataFrame:
    """Number of motifs of each class and signature."""
    return motifs.groupBy(side_class(F.col("side_layers")).alias("side_class"), side_signature(F.col("side_layers")).alias("signature")).agg(F.count(F.lit(1)).alias("motifs"))


def zigzag_pairs(motifs: DataFrame) -> DataFrame:
    """Number of zig-zags of each pair of layers."""
    pair = F.array_join(F.array_sort(F.array_distinct("side_layers")), "|")
    return motifs.filter(side_class(F.col("side_layers")) == "zigzag").groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("motifs"))


def zigzag_vectors(motifs: DataFrame) -> DataFrame:
    """Number of motifs, their mean vector score and the share of positive ones (0 without motifs)."""
    positive = F.avg((F.col("vector_score") > 1e-9).cast("double"))
    return motifs.agg(F.count(F.lit(1)).alias("motifs"), F.coalesce(F.avg("vector_score"), F.lit(0.0)).alias("vector_mean"), F.coalesce(positive, F.lit(0.0)).alias("positive_rate"))


def zigzag_baseline(motifs: DataFrame, permutations: int = 200, seed: int = 13) -> DataFrame:
    """Zig-zags against permutations of all side layers: observed, mean, stdev, z, two-sided p = (exceed + 1) / (n + 1).

    Observed zig-zags and the number of sides of each layer are counted in
    Spark; only these counts come to the driver, where they are dealt anew.
    """
    import numpy as np

    spark, kinds = motifs.sparkSession, F.explode("side_layers").alias("layer")
    zigzag = F.sum((side_class(F.col("side_layers")) == "zigzag").cast("long"))
    found = motifs.agg(F.count(F.lit(1)).alias("n"), zigzag.alias("z")).first()
    schema = "observed long, mean double, stdev double, z double, p double"
    if not found["n"]:
        return spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0)], schema)
    sides = motifs.select(kinds).groupBy("layer").count().orderBy("layer").collect()  # a row a layer
    flat, rng = np.repeat(np.arange(len(sides), dtype=np.int8), [r["count"] for r in sides]), np.random.default_rng(seed)

    def zigzags(x: np.ndarray) -> int:
        return int(((x[:, 0] == x[:, 2]) & (x[:, 1] == x[:, 3]) & (x[:, 0] != x[:, 1])).sum())

    counts = np.array([zigzags(rng.permutation(flat).reshape(-1, 4)) for _ in range(permutations)])
    seen, mean = int(found["z"]), float(counts.mean())
    spread = float(counts.std(ddof=1)) if permutations > 1 else 0.0
    exceed = int((np.abs(counts - mean) >= abs(seen - mean)).sum())
    return spark.createDataFrame([(seen, mean, spread, (seen - mean) / spread if spread else 0.0, (exceed + 1) / (permutations + 1))], schema)


def rectangles(sources: DataFrame, least: int = 1) -> DataFrame:
    """Two sources that share two tags: (source, tag_id, n) -> the four counts, repetition and balance.

    Sources meet in pairs by each pair of tags that both hold.
    """
    pairs = sources.select("source", F.col("tag_id").alias("tag_a"), F.col("n").alias("na")).join(sources.select("source", F.col("tag_id").alias("tag_b"), F.col("n").alias("nb")), "source").filter("tag_a < tag_b")
    left, right = (pairs.select(F.col("source").alias(f"source_{s}"), "tag_a", "tag_b", F.col("na").alias(f"{s}a"), F.col("nb").alias(f"{s}b")) for s in "xy")
    found = left.join(right, ["tag_a", "tag_b"]).filter("source_x < source_y").filter(F.least("xa", "xb", "ya", "yb") >= least)
    counts = F.array("xa", "xb", "ya", "yb")
    repetition = F.aggregate(counts, F.lit(0.0), lambda s, c: s + F.log1p(c.cast("double")))
    balance = F.array_min(counts) / F.array_max(counts)
    kind = F.when(F.array_max(counts) == 1, "single").when((F.col("xa") > 1) & (F.col("xb") > 1) | (F.col("ya") > 1) & (F.col("yb") > 1), "source-repeated").otherwise("tag-repeated")
    return found.select("source_x", "source_y", "tag_a", "tag_b", counts.alias("counts"), repetition.alias("repetition"), balance.alias("balance"), kind.alias("kind"))


def longest_chains(edges: DataFrame, depth: int = 6, branching: int = 5) -> DataFrame:
    """Longest simple path of one layer from each edge, up to ``depth`` edges, over the ``branching`` best edges of a node.

    One join a step; a path is an array of at most depth + 1 nodes.
    """
    edges = cut(edges.select("layer", "a", "b", "score"))
    both = edges.unionByName(edges.select("layer", F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    w = Window.partitionBy("layer", "a").orderBy(F.col("score").desc(), "b")
    top = both.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= branching).select("layer", "a", "b")
    paths = edges.select("layer", F.col("a").alias("start_a"), F.col("b").alias("start_b"), F.array("a", "b").alias("path"))
    paths = paths.unionByName(edges.select("layer", F.col("a").alias("start_a"), F.col("b").alias("start_b"), F.array("b", "a").alias("path")))
    longest = paths.select("layer", "start_a", "start_b", F.lit(1).alias("length"))
    for n in range(2, depth + 1):
        step = top.select(F.col("layer").alias("_l"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        paths = paths.join(step, (F.col("layer") == F.col("_l")) & (F.element_at("path", -1) == F.col("_a"))).filter(~F.array_contains("path", F.col("_b")))
        # Of paths over the same nodes to the same end one goes on.
        paths = paths.select("layer", "start_a", "start_b", F.concat("path", F.array("_b")).alias("path"))
        paths = cut(paths.withColumns({"_e": F.element_at("path", -1), "_s": F.array_sort("path")}).dropDuplicates(["layer", "start_a", "start_b", "_e", "_s"]).drop("_e", "_s"))
        longest = longest.unionByName(paths.select("layer", "start_a", "start_b", F.lit(n).alias("length")))
    return longest.groupBy("layer", "start_a", "start_b").agg(F.max("length").alias("length"))


def chain_anisotropy(edges: DataFrame, depth: int = 6, branching: int = 5) -> DataFrame:
    """Of each layer: longest chain, mean chain, mean chain of the other layers at the same nodes, and their ratio."""
    chains = cut(longest_chains(edges, depth, branching))
    ends = chains.select("layer", F.col("start_a").alias("node"), "length").unionByName(chains.select("layer", F.col("start_b").alias("node"), "length"))
    best = ends.groupBy("layer", "node").agg(F.max("length").alias("length"))
    other = best.select(F.col("layer").alias("_l"), "node", F.col("length").alias("side"))
    side = best.join(other, "node").filter("layer <> _l").groupBy("layer").agg(F.avg("side").alias("side_length"))
    axis = chains.groupBy("layer").agg(F.max("length").alias("axis_length"), F.avg("length").alias("mean_length"), F.count(F.lit(1)).alias("edges"))
    return axis.join(side, "layer", "left").select("layer", "edges", "axis_length", "mean_length", F.coalesce("side_length", F.lit(0.0)).alias("side_length"), (F.col("axis_length") / F.greatest(F.coalesce("side_length", F.lit(0.0)), F.lit(1.0))).alias("anisotropy"))


def chain_contrast(edges: list[tuple[int, int]], layers: list[str], depth: int = 6, branching: int = 5, side_branching: int = 2, probes: int = 100, least: int = 10) -> dict[str, tuple[int, int, float, float]]:
    """Of each layer with ``least`` edges: (edges, probes, mean chain along the layer, mean chain of other layers beside it).

    edges: best first, with a layer each.  A probe is one of the first
    ``probes`` edges of a layer.  Its chain is the longest simple path that
    the edge begins, in either direction, of ``depth`` edges at most and over
    the ``branching`` best edges of a node.  Beside it, at both ends, the
    chains that begin with the ``side_branching`` best edges of each other
    layer are averaged (0 where there is none).
    """
    near: dict[tuple[str, int], list[int]] = {}
    for (a, b), layer in zip(edges, layers, strict=True):
        for u, v in ((a, b), (b, a)):
            heads = near.setdefault((layer, u), [])
            if len(heads) < branching:
                heads.append(v)
    known: dict[tuple[str, int, int], int] = {}

    def chain(layer: str, u: int, v: int) -> int:
        """Length of the longest chain from u over v; ends at the first that is ``depth`` long."""
        if (layer, u, v) not in known:
            best, open_paths = 0, [(u, v)]
            while open_paths and best < depth:
                path = open_paths.pop()
                best = max(best, len(path) - 1)
                open_paths.extend(path + (w,) for w in reversed(near.get((layer, path[-1]), ())) if w not in path)
            known[layer, u, v] = min(best, depth)
        return known[layer, u, v]

    def mean(values: list) -> float:
        return sum(values) / len(values) if values else 0.0

    out = {}
    for layer in LAYER_ORDER:
        own = [e for e, x in zip(edges, layers, strict=True) if x == layer]
        if len(own) < least:
            continue
        along, beside = [], []
        for a, b in own[:probes]:
            along.append(max(chain(layer, a, b), chain(layer, b, a)))
            starts = [(x, u, v) for u in (a, b) for x in LAYER_ORDER if x != layer for v in [w for w in near.get((x, u), ()) if w not in (a, b)][:side_branching]]
            beside.append(mean([chain(*s) for s in starts]))
        out[layer] = (len(own), len(along), mean(along), mean(beside))
    return out


def chain_baseline(edges: DataFrame, iterations: int = 80, seed: int = 23, depth: int = 6, branching: int = 5, side_branching: int = 2, probes: int = 100, least: int = 10, bound: int = 20_000) -> DataFrame:
    """Contrast of the chains along and beside each layer, against shuffles of the layers over the edges.

    edges: a selection (``select_edges``), best first after its order here, at
    most ``bound`` of them: with more this raises instead of leaving any out.
    The selection goes to the workers, where each shuffle is a row of its own.
    p is two-sided, (exceed + 1) / (n + 1).  No edges give no rows.
    """
    import random

    import pandas as pd

    spark = edges.sparkSession
    best = edges.select("a", "b", "score", "layer").orderBy(F.col("score").desc(), "a", "b").limit(bound + 1).collect()
    if len(best) > bound:
        raise ValueError(f"select at most {bound} edges first")
    ends, layers, rng = [(r["a"], r["b"]) for r in best], [r["layer"] for r in best], random.Random(seed)

    def shuffled() -> str:
        again = layers.copy()
        rng.shuffle(again)
        return ",".join(again)

    deals = [(0, ",".join(layers))] + [(i + 1, shuffled()) for i in range(iterations)]
    run = spark.createDataFrame(deals if best else [], "iteration int, layers string").repartition(max(1, min(len(deals), spark.sparkContext.defaultParallelism)), "iteration")

    def measure(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = [
                (i, layer, *found)
                for i, dealt in zip(pdf["iteration"], pdf["layers"], strict=True)
                for layer, found in chain_contrast(ends, dealt.split(","), depth, branching, side_branching, probes, 1 if i else least).items()
            ]
            yield pd.DataFrame(rows, columns=["iteration", "layer", "edges", "probes", "axis_mean", "side_mean"])

    found = run.mapInPandas(measure, "iteration int, layer string, edges long, probes long, axis_mean double, side_mean double").withColumn("contrast", F.col("axis_mean") - F.col("side_mean"))
    found = cut(found)
    seen = found.filter("iteration = 0").drop("iteration")
    null = found.filter("iteration > 0").select("layer", F.col("contrast").alias("_c"))
    stats = null.groupBy("layer").agg(F.avg("_c").alias("_m"), F.count(F.lit(1)).alias("_n"), F.coalesce(F.stddev_samp("_c"), F.lit(0.0)).alias("_d"))
    joined = seen.join(stats, "layer", "left").fillna({"_m": 0.0, "_n": 0, "_d": 0.0})
    exceed = null.join(joined.select("layer", "_m", F.col("contrast").alias("_o")), "layer").groupBy("layer").agg(F.sum((F.abs(F.col("_c") - F.col("_m")) >= F.abs(F.col("_o") - F.col("_m"))).cast("long")).alias("_e"))
    z = F.when(F.col("_d") > 1e-12, (F.col("contrast") - F.col("_m")) / F.col("_d")).otherwise(0.0)
    ratio = F.when(F.col("side_mean") > 1e-12, F.col("axis_mean") / F.col("side_mean")).otherwise(F.col("axis_mean"))
    p = (F.coalesce("_e", F.lit(0)) + 1) / (F.col("_n") + 1)
    return joined.join(exceed, "layer", "left").select("layer", "edges", "probes", "axis_mean", "side_mean", "contrast", ratio.alias("ratio"), F.col("_m").alias("baseline_mean"), F.col("_d").alias("baseline_stdev"), z.alias("z"), p.alias("p"))


def matches_terms(text: Column, include: str = "", exclude: str = "") -> Column:
    """Any of the included terms (all texts where there is none) and none of the excluded; comma-separated, trimmed, lower-cased."""

    def any_of(terms: str) -> Column | None:
        found = [t.strip().lower() for t in terms.split(",") if t.strip()]
        return F.exists(F.array(*[F.lit(t) for t in found]), lambda t: F.lower(text).contains(t)) if found else None

    wanted, unwanted = any_of(include), any_of(exclude)
    out = F.lit(True) if wanted is None else wanted
    return out if unwanted is None else out & ~unwanted


def source_summaries(memories: DataFrame, tags: DataFrame, least: int = 2, top: int = 5) -> DataFrame:
    """The ``top`` sources (summary) of the memories that have ``least`` of the tags at least, by their number.

    memories: (memory_id, tag_id, summary).  tags: (motif, tag_id).
    """
    hits = memories.join(tags, "tag_id").groupBy("motif", "memory_id", "summary").agg(F.countDistinct("tag_id").alias("_t")).filter(F.col("_t") >= least)
    counts = hits.groupBy("motif", "summary").agg(F.count(F.lit(1)).alias("memories"))
    w = Window.partitionBy("motif").orderBy(F.col("memories").desc(), "summary")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)


def is_letter(name: Column) -> Column:
    return F.length(name) == 1


def pair_allowed(a: Column, b: Column, letters: bool = False, terms: str = "") -> Column:
    """Whether a pair of names may be the columns of a rectangle: with both constraints one letter and one match of the terms."""
    if not letters and not terms:
        return F.lit(True)
    match_a, match_b = matches_terms(a, terms) if terms else F.lit(False), matches_terms(b, terms) if terms else F.lit(False)
    if letters and terms:
        return (is_letter(a) & match_b) | (is_letter(b) & match_a)
    return (is_letter(a) & is_letter(b)) if letters else (match_a & match_b)


def letter_sequence(a: Column, b: Column) -> Column:
    """Two letters that follow each other in the alphabet."""
    return is_letter(a) & is_letter(b) & (F.abs(F.ascii(a) - F.ascii(b)) == 1)
