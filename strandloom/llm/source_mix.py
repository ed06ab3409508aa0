"""Mixing sources to target weights by hierarchical budgets.

Documents sit in the leaves of a tree of levels (domain, language, source). A budget of tokens goes
down the tree by the weights of siblings. No leaf gives more than ``max_epochs`` passes over its
documents, so no node takes more than its leaves can give: what one cannot take goes to its siblings
by their weights, and only what all siblings together cannot take goes back to their parent's
siblings. Each leaf then gives whole passes, and of one more pass the prefix that its share still
needs, in an order seeded by pass: documents are taken as long as the tokens before them are fewer
than the share.

Only the leaves' totals are seen by the driver (``max_leaves`` of them at most; more are an error).
The prefix of a leaf is found by its buckets: tokens are summed by leaf and bucket of the seeded
hash, whole buckets are in or out by running sums, and only the bucket at the cut is ordered
document by document. So a leaf with a third of all rows is neither sorted nor gathered.

A document has as many tokens as words, and one for its end. Edge cases: a null or empty text has the
end token alone; a null level is the value ``(none)``; weights of zero leave a node out, and weights
for nodes without documents are ignored; a budget beyond what the tree can give is cut to that;
repeated rows are documents each, in the same place of the order; an empty table gives no rows;
``epoch`` and ``n_tokens`` replace columns of these names, other columns stay."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import bounded_batches, own_prefix

Path = tuple[str, ...]
BUCKETS = 4096


def word_tokens(text: Column) -> Column:
    """Words of a text, and one."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def smoothed(power: float) -> Callable[[Path, int], float]:
    """Weights that grow less than in proportion to what a node has."""
    return lambda path, supply: float(supply) ** power


def budgets(supply: Mapping[Path, int], weights: Mapping[Path, float] | Callable[[Path, int], float], budget: float, max_epochs: float) -> dict[Path, int]:
    """Tokens that each leaf gives. ``weights`` are relative to siblings, by path from the top, or a
    function of path and tokens; paths that a mapping lacks weigh 1."""
    weigh = weights if callable(weights) else lambda path, _: weights.get(path, 1.0)
    have: dict[Path, int] = {}
    below: dict[Path, list[Path]] = {}
    for leaf, n in supply.items():
        for depth in range(len(leaf) + 1):
            have[leaf[:depth]] = have.get(leaf[:depth], 0) + n
            if depth and leaf[:depth] not in below.setdefault(leaf[: depth - 1], []):
                below[leaf[: depth - 1]].append(leaf[:depth])
    weight = {p: max(float(weigh(p, n)), 0.0) for p, n in have.items() if p}
    most: dict[Path, float] = {}
    for p in sorted(have, key=len, reverse=True):
        own = sum(most[c] for c in below[p]) if p in below else have[p] * max_epochs
        most[p] = own if not p or weight[p] > 0 else 0.0
    share = {(): min(float(budget), most.get((), 0.0))}
    for p in sorted(below, key=len):
        left, open_ = share[p], [c for c in sorted(below[p]) if most[c] > 0]
        share.update((c, 0.0) for c in below[p])
        while open_:
            total = sum(weight[c] for c in open_)
            full = [c for c in open_ if left * weight[c] / total >= most[c]]
            if not full:
                share.update((c, left * weight[c] / total) for c in open_)
                break
            for c in full:
                share[c] = most[c]
            left = max(left - sum(most[c] for c in full), 0.0)
            open_ = [c for c in open_ if c not in full]
    return {p: int(share.get(p, 0.0) + 1e-6) for p in supply}


def mix_sources(documents: DataFrame, levels: dict[str, Column], weights: Mapping[Path, float] | Callable[[Path, int], float], budget: int | None = None, max_epochs: float = 2.0, seed: int = 1, id_col: str = "doc_id", text: str = "text", max_leaves: int = 100_000) -> DataFrame:
    """The rows taken, a row for each pass that takes it, with ``epoch`` (from 0) and ``n_tokens``.
    ``budget`` in tokens; all tokens of the documents unless given."""
    spark = documents.sparkSession
    bounded_batches(spark)
    columns = [c for c in documents.columns if c not in ("epoch", "n_tokens")]
    own = own_prefix(columns)
    names = [f"{own}level{i}" for i in range(len(levels))]
    passes, rest, place, bucket, total, need, before, cut_at, at = (own + c for c in ("passes", "rest", "place", "bucket", "sum", "need", "before", "cut", "at"))
    rows = documents.select(*columns, word_tokens(F.col(text)).alias("n_tokens"), *[F.coalesce(c.cast("string"), F.lit("(none)")).alias(n) for n, c in zip(names, levels.values(), strict=True)])
    totals = rows.groupBy(*names).agg(F.sum("n_tokens").alias("n")).limit(max_leaves + 1).collect()
    if len(totals) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves; raise max_leaves")
    supply = {tuple(x[:-1]): int(x.n) for x in totals}
    give = budgets(supply, weights, sum(supply.values()) if budget is None else budget, max_epochs)
    leaves = spark.createDataFrame([(*p, give[p] // n, give[p] % n) for p, n in supply.items()], ", ".join([*(f"{n} string" for n in names), f"{passes} long", f"{rest} long"]))
    # As many leaves as max_leaves at most, so they may go to every task.
    rows = rows.join(F.broadcast(leaves), names)
    order = F.xxhash64(F.lit(seed), F.col(passes), F.col(id_col).cast("string"), F.xxhash64(text))
    rows = rows.withColumn(place, order).withColumn(bucket, F.shiftrightunsigned(place, 64 - BUCKETS.bit_length() + 1).cast("int"))
    whole = rows.where(F.col(passes) > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col(passes).cast("int") - 1)))
    part = rows.where(F.col(rest) > 0)
    sums = part.groupBy(*names, bucket).agg(F.sum("n_tokens").alias(total), F.first(rest).alias(need))
    upto = Window.partitionBy(*names).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(before, F.coalesce(F.sum(total).over(upto), F.lit(0)))
    cut = sums.where((F.col(before) < F.col(need)) & (F.col(before) + F.col(total) >= F.col(need))).select(*names, F.col(bucket).alias(cut_at), before)
    part = part.join(F.broadcast(cut), names).where(F.col(bucket) <= F.col(cut_at))
    inside = Window.partitionBy(*names).orderBy(place, id_col).rowsBetween(Window.unboundedPreceding, -1)
    sure = part.where(F.col(bucket) < F.col(cut_at))
    last = part.where(F.col(bucket) == F.col(cut_at)).withColumn(at, F.col(before) + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where(F.col(at) < F.col(rest))
    out = [*columns, "epoch", "n_tokens"]
    once = [p.withColumn("epoch", F.col(passes).cast("int")).select(*out) for p in (sure, last)]
    return whole.select(*out).unionByName(once[0]).unionByName(once[1])


# ---------------------------------------------------------------- query


def document_levels() -> dict[str, Column]:
    """Domain (the source's name without its number), language, source."""
    return {"domain": F.regexp_replace("source", "[0-9]+$", ""), "lang": F.col("lang"), "source": F.col("source")}


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), document_levels(), smoothed(0.7))
    return out.select("doc_id", "epoch", "lang", "source", "n_tokens")


QUERIES = {"op9_source_mix": op9_source_mix}
ORACLE_SQL: dict[str, str] = {}
