"""Filling containers of fixed capacity: best-fit decreasing with a segment tree over remaining capacities."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import spread, written

#: The public word-punctuation tokenizer: a run of letters, digits and '_', or a run of other characters that are no white space.
_BLANK = r"\s\p{IsWhite_Space}\x1c-\x1f"
TOKEN_JVM = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_BLANK}]+"
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Items that are numbered in one group; the groups of a size are numbered one after another.
GROUP = 2_000_000
#: Kinds of containers that one pass over the sizes serves; more kinds take more passes.
KINDS = 500


class OpenBins:
    """Runs of bins by remaining capacity; `tightest` and `put` take logarithmic time in the capacity.

    A segment tree over the remaining capacities 0..capacity: a node is present if a run below it is open. A run is
    (first bin, number of bins), all with the same remaining capacity.
    """

    def __init__(self, capacity: int):
        self.base = 1 << max(1, capacity).bit_length()
        self.tree: set[int] = set()
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def tightest(self, size: int) -> int:
        """The least remaining capacity of an open run that holds `size`, or -1."""
        tree, i = self.tree, self.base + size
        if i >= 2 * self.base:
            return -1
        while i not in tree:
            while i & 1:  # a right child: what follows it is above
                i >>= 1
            if not i:
                return -1
            i += 1
        while i < self.base:
            i = 2 * i + (2 * i not in tree)
        return i - self.base

    def take(self, remaining: int) -> tuple[int, int]:
        runs = self.runs[remaining]
        run = runs.pop()
        if not runs:
            i = self.base + remaining
            self.tree.discard(i)
            i >>= 1
            while i and 2 * i not in self.tree and 2 * i + 1 not in self.tree:
                self.tree.discard(i)
                i >>= 1
        return run

    def put(self, remaining: int, first: int, bins: int) -> None:
        runs = self.runs.setdefault(remaining, [])
        runs.append((first, bins))
        if len(runs) == 1:
            i = self.base + remaining
            while i and i not in self.tree:
                self.tree.add(i)
                i >>= 1


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """(per size its segments, number of bins) for (size, items) pairs; sizes are at most `capacity`.

    A segment (first, items, bin, each) says: of the items of this size, those from rank `first` on go to consecutive bins from `bin`
    on, `each` to a bin. Placing one item after another gives the same loads: the tightest bin that holds an item is, after taking it,
    still the tightest as long as it holds another of the same size, so a bin takes as many as fit and a run of equal bins does so alike.
    """
    open_bins, out, n = OpenBins(capacity), {}, 0
    for size, left in sorted(histogram, reverse=True):
        segments, rank = out.setdefault(size, []), 0
        while left:
            remaining = open_bins.tightest(size)
            if remaining < 0:
                remaining, each = capacity, capacity // size if size else left
                first, bins = n, -(-left // each)
                n += bins
            else:
                each = remaining // size if size else left
                first, bins = open_bins.take(remaining)
            full = min(bins, left // each)
            if full:
                segments.append((rank, full * each, first, each))
                open_bins.put(remaining - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if full < bins:
                part, at = left, first + full
                if part:
                    segments.append((rank, part, at, each))
                    open_bins.put(remaining - part * size, at, 1)
                    rank, left = rank + part, 0
                if bins - full - bool(part):
                    open_bins.put(remaining, at + bool(part), bins - full - bool(part))
    return out, n


_PLAN = "container_id int, slot long, before long, most long, segments array<struct<rank:long,items:long,bin:long,each:long>>"


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    """Per slot of a container: how many items have lower slots, the most whole pieces of an item, and the segments of its rests."""
    group = group.sort_values("slot")
    capacity = int(group["capacity"].iloc[0])
    segments, _ = best_fit_decreasing([(s, n) for s, n in zip(group["slot"].tolist(), group["n"].tolist()) if s < capacity], capacity)
    return pd.DataFrame({
        "container_id": group["container_id"].to_numpy(), "slot": group["slot"].to_numpy(), "before": (group["n"].cumsum() - group["n"]).to_numpy(), "most": int(group["most"].max()),
        "segments": [[{"rank": r, "items": k, "bin": b, "each": e} for r, k, b, e in segments.get(s, [])] for s in group["slot"].tolist()],
    })


def _packed(sized: DataFrame, kinds: list[tuple[int, int]], groups: int) -> DataFrame:
    each = F.array(*[F.struct(F.lit(int(c)).alias("container_id"), F.lit(int(n)).cast("long").alias("capacity")) for c, n in kinds])
    items = sized.select("doc_id", "size", F.explode(each).alias("c")).select("doc_id", "size", "c.*")
    full, rest = F.floor(F.col("size") / F.col("capacity")), F.col("size") % F.col("capacity")
    items = items.withColumns({"full": full, "slot": F.when((rest > 0) | (F.col("size") == 0), rest).otherwise(F.col("capacity")), "salt": F.pmod(F.xxhash64("doc_id", "size"), F.lit(groups))})
    on = ["container_id", "slot", "salt"]
    counts = written(items.groupBy(*on).agg(F.first("capacity").alias("capacity"), F.count("*").alias("n"), F.max("full").alias("most")), "slots")
    plan = counts.groupBy("container_id", "slot").agg(F.first("capacity").alias("capacity"), F.sum("n").alias("n"), F.max("most").alias("most")).groupBy("container_id").applyInPandas(_plan, _PLAN)
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("container_id", "slot").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    overlap = F.filter("segments", lambda s: (s["rank"] < F.col("ahead") + F.col("n")) & (s["rank"] + s["items"] > F.col("ahead")))
    offsets = counts.select(*on, "n", ahead.alias("ahead")).join(plan, ["container_id", "slot"]).select(*on, "ahead", "before", "most", overlap.alias("segments"))
    numbered = items.withColumn("nth", F.row_number().over(Window.partitionBy(*on).orderBy("doc_id", "size")) - 1)
    rank = F.col("ahead") + F.col("nth")
    own = F.get(F.filter("segments", lambda s: (s["rank"] <= F.col("rank")) & (F.col("rank") < s["rank"] + s["items"])), F.lit(0))
    placed = numbered.join(offsets, on).withColumn("rank", rank).withColumn("own", own)
    count = F.col("full") + (F.col("slot") < F.col("capacity")).cast("long")
    pieces = placed.withColumns({"n_pieces": count, "item": F.col("before") + F.col("rank")}).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pieces") - 1)).alias("piece"))
    whole = F.col("piece") < F.col("full")
    into = F.col("own.bin") + F.floor((F.col("rank") - F.col("own.rank")) / F.col("own.each"))
    return pieces.select(
        "container_id", "capacity", F.when(whole, -(F.col("item") * F.col("most") + F.col("piece")) - 1).otherwise(into).alias("bin_id"), "doc_id", "item", "piece", "n_pieces",
        (F.col("piece") * F.col("capacity")).alias("first_token"), F.when(whole, F.col("capacity")).otherwise(F.col("slot")).alias("n_tokens"),
    )


_PACKED = "container_id int, capacity long, bin_id long, doc_id long, item long, piece long, n_pieces long, first_token long, n_tokens long"


def pack(docs: DataFrame, containers: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """Where each document goes, for each kind of container.

    Columns: container_id, capacity, bin_id, doc_id, item (the row's number within the container's items), piece, n_pieces, first_token,
    n_tokens. A document that exceeds the capacity is cut into pieces of `capacity` tokens and a rest; no other is
    split. A whole piece fills a bin of its own (negative ids, exactly numbered); all else is placed best-fit decreasing over all items.

    Defined results: null key or text: left out; empty text: an item of no tokens, in some bin; each row is an item
    (rows repeated under one key are placed one by one); containers with null or non-positive capacity: left out,
    repeated container_id: the smallest capacity counts; no documents or containers: no rows. Which of several items of one size
    goes to which bin follows from hashes of key and size, not from partitions.

    Plan: sizes are counted in the JVM and written once (key and size only). Sizes are whole numbers up to the capacity, so best-fit
    decreasing runs on their histogram, a task per container, whatever the number of documents; it yields runs of ranks and bins. Items are
    numbered within their size in groups of about `group` (so a size that a third of all items has is spread) and look up their
    bin by equi-join on (container, size, group); nothing is broadcast or collected but the capacities.
    """
    spark = docs.sparkSession
    kinds = sorted((r[0], r[1]) for r in containers.where("capacity > 0 and container_id is not null").groupBy("container_id").agg(F.min("capacity")).collect())
    sized = spread(docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)).select(
        F.col(key).cast("long").alias("doc_id"), F.regexp_count(F.col(text), F.lit(TOKEN_JVM)).cast("long").alias("size")
    )
    sized = written(sized, "sizes")
    groups = max(1, -(-sized.count() // group))
    out = spark.createDataFrame([], _PACKED)
    for i in range(0, len(kinds), KINDS):
        part = _packed(sized, kinds[i : i + KINDS], groups).select(*out.columns)
        out = part if i == 0 else out.unionByName(part)
    return out


def piece_text(text: str, first_token: int, n_tokens: int) -> str:
    """The characters of text from a token on, up to where the token after the piece starts."""
    starts = [m.start() for m in TOKEN.finditer(text)]
    if not starts or first_token >= len(starts):
        return ""
    last = first_token + n_tokens
    return text[0 if first_token == 0 else starts[first_token] : starts[last] if last < len(starts) else len(text)]


def split_documents(packed: DataFrame) -> DataFrame:
    """(container_id, doc_id) of the documents whose pieces lie in more than one bin."""
    spans = packed.groupBy("container_id", "doc_id", "item").agg(F.min("bin_id").alias("low"), F.max("bin_id").alias("high"))
    return spans.where("low < high").select("container_id", "doc_id").distinct()


def fill(packed: DataFrame) -> DataFrame:
    """Per container: bins, items, tokens, the share of all capacity that is used, and the tokens of the fullest bin."""
    bins = packed.groupBy("container_id", "capacity", "bin_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return bins.groupBy("container_id", "capacity").agg(
        F.count("*").alias("bins"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * F.first("capacity"))).alias("fill"), F.max("used").alias("fullest")
    )
