"""Problem 8: texts into containers of a fixed number of tokens, each window of containers with the target mixture.

Texts are counted once with a public tokenizer and cut into pieces of at most ``capacity`` (only texts that are longer
are cut).  Sizes are spread over shards by a hash, so that a source with a third of all rows is spread too; a shard
holds about ``SHARD_TOKENS`` tokens whatever the input.  Within a shard a deficit round-robin over one queue per
source fills window after window: each round adds a quantum in proportion to the source's target, and what a source
couldn't use is carried to the next window.  The shortfall of the shards before it, source by source, is what a shard
has to make up for, all of it, in equal parts over its windows.  The pieces of a window go into containers best fit first, longest first; a container that
stays less than nearly full is carried into the next window.

Null and empty texts have no tokens and still get a container.  Rows with the same id are separate items.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomine.llm.frames import arrow_map, spread
from foliomine.session import cut

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the tokenizer's published pattern of words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_TOKENS = 8_000_000
WINDOW = 128
#: A container with no more than this share free is closed at the end of its window.
NEARLY_FULL = 0.01

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer, once per worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_sizes(df: DataFrame, item: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``item_id``, ``source`` ('' for null) and ``n_tokens`` of each row."""

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        encode = encoding(tokenizer).encode_ordinary
        for b in batches:
            yield {"item_id": b["item_id"], "source": b["source"], "n_tokens": [len(encode(t)) if t else 0 for t in b["text"]]}

    narrow = df.select(F.col(item).cast("long").alias("item_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    return arrow_map(spread(narrow), kernel, "item_id long, source string, n_tokens int")


def pack_shard(items: list[tuple], targets: dict[str, float], deficits: dict[str, float], capacity: int, window: int) -> list[tuple]:
    """Give each (source, size, key) its window and container.  Sums per container never exceed capacity."""
    queues: dict[str, deque] = {}
    for source, size, key in items:
        queues.setdefault(source, deque()).append((size, key))
    goal = float(window * capacity)
    windows = max(1, -(-sum(x[1] for x in items) // int(goal)))
    deficit = dict.fromkeys(queues, 0.0)
    out: list[tuple] = []
    carried: list[tuple[int, list]] = []
    at, next_container = 0, 0
    while queues:
        took, chosen = 0.0, []
        if at < windows:
            for s in queues:
                deficit[s] += deficits.get(s, 0.0) / windows
        while queues and took < goal:
            live = sum(targets.get(s, 0.0) for s in queues)
            for s in sorted(queues):
                share = targets.get(s, 0.0) / live if live > 0 else 1 / len(queues)
                deficit[s] += share * goal / 8
                queue = queues[s]
                while queue and queue[0][0] <= deficit[s]:
                    size, key = queue.popleft()
                    deficit[s] -= size
                    took += size
                    chosen.append((size, key))
            for s in [s for s, q in queues.items() if not q]:
                del queues[s]
        # best fit, longest first, beginning with what the last window left open
        free = sorted((room, i) for i, (room, _) in enumerate(carried))
        held = [list(c[1]) for c in carried]
        for size, key in sorted(chosen, key=lambda x: -x[0]):
            p = bisect_left(free, (size, -1))
            if p < len(free):
                room, i = free.pop(p)
            else:
                room, i = capacity, len(held)
                held.append([])
            held[i].append((size, key))
            insort(free, (room - size, i))
        carried = []
        for room, i in free:
            if queues and room > NEARLY_FULL * capacity:
                carried.append((room, held[i]))
            else:
                out += [(key, size, at, next_container) for size, key in held[i]]
                next_container += 1
        at += 1
    return out


def pack(df: DataFrame, item: str, text: str, source: str, capacity: int = CAPACITY, targets: dict[str, float] | None = None, tokenizer: str = TOKENIZER, shard_tokens: int = SHARD_TOKENS, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``item_id, piece, first_token, n_tokens, shard, window, container``.

    (shard, container) names a container.  ``targets`` are the wanted shares of tokens per source; by default the
    shares of the input, so that every window looks like the whole.
    """
    sizes = cut(token_sizes(df, item, text, source, tokenizer))
    per_source = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = per_source.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    n = F.col("n_tokens")
    starts = F.when(n > capacity, F.sequence(F.lit(0), n - 1, F.lit(capacity))).otherwise(F.array(F.lit(0)))
    # ids may be null or repeated; the place in what was written tells rows apart
    place = F.monotonically_increasing_id().alias("place")
    pieces = sizes.select("item_id", "source", "n_tokens", place).select("item_id", "source", "n_tokens", "place", F.posexplode(starts).alias("piece", "first_token"))
    pieces = pieces.withColumns(
        {
            "size": F.least(n - F.col("first_token"), F.lit(capacity)),
            "shard": F.pmod(F.xxhash64("item_id", "place", "piece"), F.lit(shards)).cast("int"),
        }
    )
    # shares wanted, and what the shards before each one took too little of each source
    if targets is None:
        wanted = per_source.select("source", (F.col("tokens") / F.lit(max(total, 1))).alias("target"))
    else:
        scale = sum(targets.values()) or 1.0
        wanted = df.sparkSession.createDataFrame([(s, v / scale) for s, v in targets.items()], "source string, target double")
    served = pieces.groupBy("shard", "source").agg(F.sum("size").alias("tokens"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shard_total = served.groupBy("shard").agg(F.sum("tokens").alias("all_tokens"))
    mix = served.join(shard_total, "shard").join(wanted, "source", "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    mix = mix.withColumn("short", F.coalesce(F.sum(F.col("target") * F.col("all_tokens") - F.col("tokens")).over(before), F.lit(0.0)))
    mix = mix.groupBy(F.col("shard").alias("part")).agg(F.collect_list(F.struct("source", "target", "short")).alias("mix"))
    keyed = pieces.select("shard", "item_id", "source", "piece", "first_token", "size")

    def kernel(key, left, right):
        import pyarrow as pa

        shard = key[0].as_py()
        mixture = right.column("mix")[0].as_py() if right.num_rows else []
        names = ["source", "size", "item_id", "piece", "first_token"]
        columns = [left.column(c).to_pylist() for c in names]
        items = sorted(((s, n, (i, p, f)) for s, n, i, p, f in zip(*columns, strict=True)), key=lambda x: (((x[2][0] or 0) * 2654435761 + x[2][1]) & 0xFFFFFFFF, x[2][1]))
        got = pack_shard(items, {m["source"]: m["target"] for m in mixture}, {m["source"]: m["short"] for m in mixture}, capacity, window)
        return pa.table(
            {
                "item_id": pa.array([k[0] for k, *_ in got], pa.int64()),
                "piece": pa.array([k[1] for k, *_ in got], pa.int32()),
                "first_token": pa.array([k[2] for k, *_ in got], pa.int32()),
                "n_tokens": pa.array([g[1] for g in got], pa.int32()),
                "shard": pa.array([shard] * len(got), pa.int32()),
                "window": pa.array([g[2] for g in got], pa.int32()),
                "container": pa.array([g[3] for g in got], pa.int32()),
            }
        )

    schema = "item_id long, piece int, first_token int, n_tokens int, shard int, window int, container int"
    # shards are narrow, so that adaptive planning would put many into one task by their bytes: their number decides
    tasks = min(shards, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism))
    mixes = mix.select(F.col("part").alias("mix_shard"), "mix").repartition(tasks, "mix_shard")
    return keyed.repartition(tasks, "shard").groupBy("shard").cogroup(mixes.groupBy("mix_shard")).applyInArrow(kernel, schema)
