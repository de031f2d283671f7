r"""Mixing sources to target weights: hierarchical budgeting, in DataFrame operations only.

A tree of levels (domain, language, source) is given by columns; weights may be set for any node by its
path, other children of a node share what is left equally. The budget flows from the root: each
node's goes to its children by weight, but never beyond what a child can give, which is `epochs` times the
tokens below it; what a child can't take goes to its siblings, and only what all of them can't take comes
back to the ancestors' siblings. Since a node's capacity is known from below before its share is set,
that is water filling at each node: the level at which shares, cut off at capacity, add up to the
budget. Each leaf then takes a token prefix of its stream: epoch 0, 1, ... each in an order of its
own, given by a seeded hash.

Prefixes don't sort a leaf. Rows of ids, token counts and hashes alone are summed in 256 buckets of the hash; in
the bucket in which the budget ends they are summed in 256 again, and so on; only what is left of the last
one is sorted, to find the row with which the prefix ends. All rows up to that one in the order are taken, so no
text passes a shuffle. The node tables are as large as the number of distinct paths; they are joined as tables,
never collected.

A path is its levels' values with `/` between them; `/` and `\` in a value are preceded by `\`, a null level is
`?`, a value `?` is `\?`, so different values never share a node. Null or empty texts count one token. A
document is taken whole as long as the tokens before it are fewer than the budget, so a leaf exceeds it by less
than one document. Ties of the hash are broken by the id, and those of rows that repeat an id and a number of
tokens by a hash of the row's file and place in it. An empty table or budget gives an empty mix. Columns of docs may have any
names; those called _path, _tokens or _epoch give way to the results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilespark.llm.common import lookup, stored
from tilespark.llm.dedup import located


@dataclass
class Plan:
    """levels: (name, column expression) from the root down. weights: path such as "web" or "web/en" ->
    weight among its siblings. total: tokens to take, or a share of all tokens if at most 1 and a float."""

    levels: list[tuple[str, Column]]
    weights: dict[str, float] = field(default_factory=dict)
    total: float = 1.0
    epochs: int = 3
    seed: int = 17
    #: Bits of the hash by which each round narrows the bucket that a prefix ends in, and how many rounds.
    bits: int = 8
    rounds: int = 3


def tokens(text: Column) -> Column:
    """The unit of budgets: four bytes of text, one at least. It is not a tokenizer's count, which is larger
    and differs by language (README)."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4)).cast("long")


#: Tables of so many paths at most are broadcast, after counting them.
BROADCAST_PATHS = 100_000


def step(value: Column) -> Column:
    """A level's value as a part of a path."""
    v = value.cast("string")
    escaped = F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("/"), F.lit("\\/"))
    return F.when(v.isNull(), "?").when(v == "?", "\\?").otherwise(escaped)


def path_of(plan: Plan, depth: int) -> Column:
    parts = [step(c) for _, c in plan.levels[:depth]]
    return F.concat_ws("/", *parts) if parts else F.lit("")


def weight_of(path: Column, weights: dict[str, float]) -> Column:
    """The weight set for a path, else null."""
    if not weights:
        return F.lit(None).cast("double")
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
    return F.try_element_at(table, path)


def water_fill(nodes: DataFrame) -> DataFrame:
    """nodes (path, parent, w, cap, parent_budget) -> path, budget. Children fill in the order of cap / w:
    while the level that would spread the rest by weight lies above a child's cap, the child is full."""
    order = Window.partitionBy("parent").orderBy("ratio", "path")
    whole = Window.partitionBy("parent")
    n = nodes.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
    n = n.withColumn("cap_before", F.sum("cap").over(order) - F.col("cap")).withColumn("w_left", F.sum("w").over(whole) - F.sum("w").over(order) + F.col("w"))
    level = F.when(F.col("w_left") > 1e-12, (F.col("parent_budget") - F.col("cap_before")) / F.col("w_left"))
    n = n.withColumn("full", (F.col("w") > 0) & (level >= F.col("ratio")))
    # the level of the first child that isn't full holds for all after it
    n = n.withColumn("level", F.min(F.when(~F.col("full") & (F.col("w") > 0), F.struct("ratio", "path", level.alias("x")))).over(whole)["x"])
    share = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w"))
    return n.select("path", F.least(F.greatest(share, F.lit(0.0)), F.col("cap").cast("double")).alias("budget"))


def budgets(sums: DataFrame, plan: Plan) -> DataFrame:
    """From leaf sums (one column for each depth: p1, p2, ... and tokens) to path, tokens, budget of
    every leaf."""
    depth = len(plan.levels)
    total = sums.agg(F.sum("tokens").alias("t"))
    want = F.col("t") * float(plan.total) if isinstance(plan.total, float) and plan.total <= 1 else F.lit(float(plan.total))
    above = total.select(F.lit("").alias("parent"), F.least(want, (F.col("t") * plan.epochs).cast("double")).alias("parent_budget"))
    for d in range(1, depth + 1):
        parent = F.col(f"p{d - 1}") if d > 1 else F.lit("")
        own = sums.groupBy(F.col(f"p{d}").alias("path"), parent.alias("parent")).agg((F.sum("tokens") * plan.epochs).alias("cap"))
        own = own.withColumn("given", weight_of(F.col("path"), plan.weights))
        by = Window.partitionBy("parent")
        left = F.greatest(F.lit(1.0) - F.coalesce(F.sum("given").over(by), F.lit(0.0)), F.lit(0.0))
        rest = F.count(F.when(F.col("given").isNull(), 1)).over(by)
        own = own.withColumn("w", F.coalesce("given", F.when(rest > 0, left / rest).otherwise(0.0)))
        filled = water_fill(own.join(above, "parent"))
        above = filled.select(F.col("path").alias("parent"), F.col("budget").alias("parent_budget"))
    leaf = sums.select(F.col(f"p{depth}").alias("path"), "tokens")
    return leaf.join(above.withColumnRenamed("parent", "path"), "path").select("path", "tokens", F.round(F.col("parent_budget")).cast("long").alias("budget"))


def free_prefix(columns: list[str]) -> str:
    """A beginning that no column's name has."""
    p = "_mix"
    while any(c.lower().startswith(p) for c in columns):
        p += "_"
    return p


def mix(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the mix: _path, _tokens, _epoch and all other columns of docs, once for each epoch in which the
    row is taken."""
    depth, p = len(plan.levels), free_prefix(docs.columns)
    own = [c for c in docs.columns if c.lower() not in ("_path", "_tokens", "_epoch")]
    path, tok, epochs, rest, place, ends, n = (f"{p}_{x}" for x in ("path", "tokens", "epochs", "rest", "place", "ends", "n"))
    row = f"{p}_row"
    rows = located(docs, row).withColumn(row, F.xxhash64(row)).withColumn(path, path_of(plan, depth)).withColumn(tok, tokens(F.col(text_col)))
    sums = stored(rows.groupBy(*[path_of(plan, d).alias(f"p{d}") for d in range(1, depth + 1)]).agg(F.sum(tok).alias("tokens"), F.count("*").alias("n")), "leaf-tokens")
    size = sums.select(F.col(f"p{depth}").alias("path"), "n")
    # whole epochs, and the rest that a prefix of one more epoch gives
    goal = budgets(sums, plan).join(size, "path").select(F.col("path").alias(path), F.floor(F.col("budget") / F.col("tokens")).cast("int").alias(epochs), (F.col("budget") % F.col("tokens")).alias(rest), F.col("n").alias(n))
    goal = stored(goal, "leaf-budgets")
    total = int(goal.agg(F.sum(n)).first()[0] or 0)
    few = goal.count() <= BROADCAST_PATHS
    beside = lambda t, leaves: t.join(F.broadcast(leaves), path) if few else lookup(t, leaves, [path], n, total)
    # the order of a leaf: a hash of 63 bits, seeded by the epoch, then id, tokens and row
    order = F.struct(F.shiftrightunsigned(F.xxhash64(F.lit(plan.seed), epochs, F.col(id_col), F.col(tok)), 1).alias("h"), F.col(id_col).alias("id"), F.col(tok).alias("t"), F.col(row).alias("row"))
    rows = beside(rows, goal).withColumn(place, order)
    last = prefix_ends(rows.where(F.col(rest) > 0).select(F.col(path).alias("path"), F.col(rest).alias("rest"), F.col(n).alias("n"), F.col(place).alias("place")), plan, few)
    last = last.select(F.col("path").alias(path), F.col("last").alias(ends), F.col("n").alias(n))
    result = [F.col(f"`{c}`") for c in own] + [F.col(path).alias("_path"), F.col(tok).alias("_tokens")]
    extra = beside(rows.drop(n), last).where(F.col(place) <= F.col(ends)).select(*result, F.col(epochs).alias("_epoch"))
    whole = rows.where(F.col(epochs) > 0).withColumn(ends, F.explode(F.sequence(F.lit(0), F.col(epochs) - 1))).select(*result, F.col(ends).alias("_epoch"))
    return whole.unionByName(extra)


def prefix_ends(rows: DataFrame, plan: Plan, few: bool) -> DataFrame:
    """rows (path, rest: the prefix's tokens, n: rows of the leaf, place: struct of h, id, t, row) -> path, n, last: the
    place of the row with which each leaf's prefix ends."""
    left = stored(rows, "leaf-places")
    for k in range(1, plan.rounds + 1):
        bucket = F.shiftright(F.col("place.h"), 63 - plan.bits * k).alias("b")
        cells = left.groupBy("path", bucket).agg(F.sum("place.t").alias("t"), F.max("rest").alias("rest"))
        before = F.sum("t").over(Window.partitionBy("path").orderBy("b")) - F.col("t")
        # a bucket for each leaf: the one in which its rest is reached
        end = stored(cells.withColumn("before", before).where("before < rest and before + t >= rest").select("path", F.col("b").alias("end"), "before"), "prefix-buckets")
        end = F.broadcast(end) if few else end
        left = left.withColumn("b", bucket).join(end, "path").where("b = end").select("path", (F.col("rest") - F.col("before")).alias("rest"), "n", "place")
        left = stored(left, "leaf-places")  # a 256th of the rows before, and a plan of its own
    at = F.sum("place.t").over(Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    found = left.withColumn("at", F.coalesce(at, F.lit(0))).where("at < rest")
    return stored(found.groupBy("path").agg(F.max("n").alias("n"), F.max("place").alias("last")), "prefix-ends")
