"""Filling containers of fixed capacity with documents by vector best-fit.

Method: a container has three capacities: tokens, documents and attention cost (sum of squared lengths). Each item goes
into the open container that fits under all three and is best by the residual norm after placing (``rule='norm'``) or by the
weighted dot-product of demand and residual (``rule='dot'``). Items come longest first, but a short one in between wherever
those still to come would else be so short on average that the document limit, not the tokens, would close containers.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-split pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WEIGHTS = (1.0, 0.05, 0.05)


def token_counts(docs: DataFrame, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` and n_tokens (long): whole texts, each tokenised once; a null or empty text has 0 tokens."""
    schema = ", ".join([f"`{c}` {dict(docs.dtypes)[c]}" for c in keep] + ["n_tokens long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(tokenizer).read_bytes().splitlines())}
        encode = tiktoken.Encoding("skyframe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for df in batches:
            yield df[keep].assign(n_tokens=[len(encode(t)) if t else 0 for t in df["_text"]])

    return docs.select(*keep, F.col(text).alias("_text")).mapInPandas(run, schema)


def arrival(size: np.ndarray, need: float, slack: float = 1.05) -> np.ndarray:
    """Longest first; but the shortest where the rest's average would fall below ``need`` (tokens a document) times ``slack``.

    With a rest of longer average, containers fill up by tokens before they fill up by documents.
    """
    down = np.argsort(-size, kind="stable")
    low, high, total = len(size) - 1, 0, float(size.sum())
    if low < 1 or total / len(size) < need:  # documents are what is scarce, whatever the order
        return down
    out = np.empty(len(size), np.int64)
    sizes = size[down].tolist()
    for k in range(len(size)):
        left = low - high
        if left and (total - sizes[high]) / left < need * slack:
            out[k], total, low = low, total - sizes[low], low - 1
        else:
            out[k], total, high = high, total - sizes[high], high + 1
    return down[out]


def best_fit(size: np.ndarray, capacity: int, max_items: int, max_cost: float, rule: str = "norm", weights: tuple = WEIGHTS) -> np.ndarray:
    """Container number of each item, for items no larger than ``capacity``; in ``arrival`` order, ties as given."""
    chosen = np.empty(len(size), np.int64)
    order = arrival(size, capacity / max_items)
    scale = np.array([1 / capacity, 1 / max_items, 1 / max_cost])
    weight = np.asarray(weights)[:, None]
    # an item that alone costs more than a container's attention fills it
    demand_all = np.minimum(np.stack([size.astype(float), np.ones(len(size)), size.astype(float) ** 2]) * scale[:, None], 1.0)
    smallest = np.minimum.accumulate(size[order][::-1])[::-1] / capacity  # least size still to come
    room = np.empty((3, 64))
    number = np.empty(64, np.int64)
    used = made = 0
    for k, item in enumerate(order):
        demand = demand_all[:, item, None]
        left = room[:, :used] - demand
        fits = (left >= -1e-9).all(axis=0)
        if fits.any():
            score = -(weight * left * left).sum(axis=0) if rule == "norm" else (weight * demand * room[:, :used]).sum(axis=0)
            score[~fits] = -np.inf
            b = int(score.argmax())
            room[:, b] = left[:, b]
        else:
            if used == room.shape[1]:
                room, number = np.concatenate([room, np.empty_like(room)], axis=1), np.concatenate([number, np.empty_like(number)])
            b, used = used, used + 1
            room[:, b] = 1 - demand[:, 0]
            number[b] = made
            made += 1
        chosen[item] = number[b]
        if room[0, b] + 1e-9 < smallest[k] or room[1, b] * max_items < 0.5:  # nothing that comes fits: close it
            used -= 1
            room[:, b], number[b] = room[:, used], number[used]
    return chosen


def container_limits(capacity: int, max_docs: int | None = None, attention: float = 1.0, tokens_per_doc: int | None = None) -> tuple[int, float]:
    """Documents and attention cost that a container may hold."""
    docs = max_docs or (max(1, capacity // tokens_per_doc) if tokens_per_doc else max(16, capacity // 16))
    return docs, attention * float(capacity) ** 2


def pack(lengths: DataFrame, doc_id: str, packs: list[tuple[str, int]], rule: str = "norm", max_docs: int | None = None, attention: float = 1.0, shard_items: int = 8192, tokens_per_doc: int | None = None) -> DataFrame:
    """Every document in a container of each pack: pack_name, container, doc_id, part, first_token, n_tokens.

    ``lengths``: doc_id and n_tokens. A document longer than the capacity is divided into full containers of its own and
    a rest that is packed like any other item; no other is divided. A document without tokens is an item of size 0, a null
    length counts as 0, repeated rows are items of their own. ``max_docs`` per container: by default capacity / 16, at
    least 16, or with ``tokens_per_doc`` capacity / tokens_per_doc; ``attention``: the cost capacity as a multiple of capacity
    squared (from 1 on it cannot bind); a document whose cost alone is above it gets a container of its own. The items are dealt to shards of about
    ``shard_items`` by row number, whatever their keys, and each shard is packed alone; only its last containers can be
    left unfilled for want of items.
    """
    for name, capacity in packs:
        if capacity is None or capacity < 1:
            raise ValueError(f"{name}: capacity must be positive")
    once = cut(lengths.select(F.col(doc_id).alias("doc_id"), F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("n")).withColumn("row_no", F.monotonically_increasing_id()))
    shards = max(1, -(-once.count() // shard_items))
    options = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(int(c)).cast("long").alias("capacity")) for n, c in packs])
    items = once.withColumn("p", F.explode(options)).select("doc_id", "row_no", "n", "p.*")
    whole = F.floor(F.col("n") / F.col("capacity")).cast("int")
    whole = F.when((F.col("n") == F.col("capacity")) & (F.col("n") > 0), 1).otherwise(whole)
    items = items.withColumn("_whole", whole)
    full = items.where("_whole > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_whole") - 1))).select(
        "pack_name", F.format_string("%s-d%d-%d", "pack_name", "row_no", "part").alias("container"), "doc_id", "part",
        (F.col("part") * F.col("capacity")).cast("long").alias("first_token"), F.col("capacity").alias("n_tokens"),
    )
    rest = items.withColumn("size", F.col("n") - F.col("_whole") * F.col("capacity")).where("size > 0 OR n = 0")
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("row_no"), F.lit(shards)))
    limits = {name: (int(c), *container_limits(int(c), max_docs, attention, tokens_per_doc)) for name, c in packs}

    def fill(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        name, shard = key
        capacity, docs, cost = limits[name]
        df = df.sort_values("row_no", kind="stable")
        number = best_fit(df["size"].to_numpy(), capacity, docs, cost, rule)
        return pd.DataFrame({
            "pack_name": name, "container": [f"{name}-s{shard}-{b}" for b in number], "doc_id": df["doc_id"], "part": df["_whole"],
            "first_token": df["n"] - df["size"], "n_tokens": df["size"],
        })

    schema = f"pack_name string, container string, doc_id {dict(once.dtypes)['doc_id']}, part int, first_token long, n_tokens long"
    packed = rest.select("pack_name", "shard", "doc_id", "row_no", "n", "_whole", "size").groupBy("pack_name", "shard").applyInPandas(fill, schema)
    return packed.unionByName(full)


def fill_report(packed: DataFrame, packs: list[tuple[str, int]]) -> DataFrame:
    """pack_name, containers, documents, tokens, fill (tokens / room of all containers)."""
    per = packed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("items"))
    size = F.create_map(*[x for n, c in packs for x in (F.lit(n), F.lit(int(c)))])
    return per.groupBy("pack_name").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("t").alias("tokens"),
        (F.sum("t") / (F.count(F.lit(1)) * F.first(size[F.col("pack_name")]))).alias("fill"),
    )


def limits_report(packed: DataFrame, lengths: DataFrame, doc_id: str, packs: list[tuple[str, int]], **options) -> DataFrame:
    """pack_name, documents, lost_tokens, divided, over_tokens, over_documents, over_attention: documents placed, tokens of
    ``lengths`` not placed exactly once, documents divided that fit, and containers over each limit (one document alone
    may cost more attention than the limit; documents without tokens beside it cost none). ``options``: as for pack. doc_id must be unique."""
    per = packed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("items"), F.count_if(F.col("n_tokens") > 0).alias("filled"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("cost"))
    rows = [(n, int(c), *container_limits(int(c), **options)) for n, c in packs]
    limits = F.broadcast(packed.sparkSession.createDataFrame(rows, "pack_name string, capacity long, docs long, attention double"))
    over = per.join(limits, "pack_name").groupBy("pack_name").agg(
        F.count_if(F.col("t") > F.col("capacity")).alias("over_tokens"), F.count_if(F.col("items") > F.col("docs")).alias("over_documents"),
        F.count_if((F.col("filled") > 1) & (F.col("cost") > F.col("attention") * (1 + 1e-9))).alias("over_attention"),
    )
    mine = packed.groupBy("pack_name", "doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("parts"))
    want = lengths.select(F.col(doc_id).alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).alias("n"))
    docs = mine.join(want, "doc_id").join(limits, "pack_name").groupBy("pack_name").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.abs(F.col("placed") - F.col("n"))).alias("lost_tokens"), F.count_if((F.col("parts") > 1) & (F.col("n") <= F.col("capacity"))).alias("divided")
    )
    return docs.join(over, "pack_name")
