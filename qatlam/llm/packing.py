"""Problem 6: filling fixed-capacity containers with texts sized in tokens.

A packing depends only on how many texts there are of each size, a histogram of at most
``capacity`` numbers. So the driver plans on the histogram, and the texts are only numbered within
their size and looked up in the plan. Capacities above ``MOST_CLASSES`` are planned in classes of
sizes, each a multiple of so many tokens, so that the histogram is bounded for any capacity:

1. Sizes are counted in tokens of a public tokenizer, once, in a map.
2. A text above the capacity fills whole containers; its rest is an item like any other.
3. Combinations of few sizes that fill a container up to a narrow window are enumerated. How often
   to use each is the non-negative least squares solution against the histogram, rounded down.
4. What is left is packed best-fit, largest first, many containers at a time.

The plan grows with the capacity, not with the data.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qatlam.operators.lookup import BROADCAST_BYTES
from qatlam.session import materialise
from qatlam.sources.tables import spread

#: Where the vocabulary lies unless told otherwise: a ``.tiktoken`` file of ranks.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that cuts text before merging in these vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Classes of sizes that a plan tells apart at most; with larger capacities an item takes up to one part in so many more.
MOST_CLASSES = 65_536

_encoders: dict[int, object] = {}


def _encoder(raw: bytes):
    import tiktoken

    key = hash(raw)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _encoders[key] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of each text; null texts and null ids are left out, an empty text has none."""
    with open(tokenizer, "rb") as f:
        held = documents.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: below a megabyte

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(held.value).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": np.fromiter((len(encode(t)) for t in batch["text"]), dtype=np.int64, count=len(batch))})

    rows = spread(documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.mapInPandas(count, "doc_id long, n_tokens long")


# ------------------------------------------------------------------ the plan
#: Empty tokens a combination may leave, the parts it may have, and combinations tried at most for each size.
WINDOW_TOKENS, TRIES = 0, 24


def combinations(hist: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three sizes (0 for none) that fill a container up to the window; each size is the largest of some."""
    present = np.flatnonzero(hist[: capacity + 1])
    present = present[present > 0]
    if not len(present):
        return np.zeros((0, 3), dtype=np.int64)
    has = np.zeros(capacity + 1, dtype=bool)
    has[present] = True
    gaps = np.arange(WINDOW_TOKENS + 1)
    found = []
    # pairs: every present size with every partner in the window
    a = present[present * 2 >= capacity - WINDOW_TOKENS]
    b = capacity - a[:, None] - gaps[None, :]
    aa = np.broadcast_to(a[:, None], b.shape)
    ok = (b >= 0) & (b <= aa)
    ok &= np.where(b > 0, has[np.clip(b, 0, capacity)], True)
    found.append(np.stack([aa[ok], b[ok], np.zeros(ok.sum(), dtype=np.int64)], axis=1))
    # triples: every present size with middle sizes spread over what can follow it
    for gap in gaps[::2]:
        a = present[present * 3 >= capacity - gap]
        rest = capacity - gap - a
        for t in range(TRIES):
            b = rest // 2 + (np.minimum(a, rest) - rest // 2) * t // TRIES
            # the next present size at or above b
            at = np.searchsorted(present, b)
            b = present[np.minimum(at, len(present) - 1)]
            c = rest - b
            ok = (c > 0) & (b <= a) & (c <= b) & has[np.clip(c, 0, capacity)]
            found.append(np.stack([a[ok], b[ok], c[ok]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def non_negative_least_squares(parts: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeats x >= 0 of each combination with A x nearest to the histogram, by accelerated projected gradients.

    A has one column for each combination: its numbers of each size. It is never formed.
    """
    n, size = len(parts), len(hist)
    if not n:
        return np.zeros(0)
    flat = parts.ravel()

    def forward(x: np.ndarray) -> np.ndarray:
        y = np.bincount(flat, weights=np.repeat(x, parts.shape[1]), minlength=size)
        y[0] = 0
        return y

    def backward(r: np.ndarray) -> np.ndarray:
        return r[parts].sum(axis=1)

    target = hist.astype(np.float64).copy()
    target[0] = 0
    scale = max(1.0, target.max())
    target /= scale
    v = np.ones(n)
    step = 1.0
    for _ in range(30):  # the largest eigenvalue, by the power method
        w = backward(forward(v))
        step = float(np.linalg.norm(w))
        if step == 0:
            return np.zeros(n)
        v = w / step
    step = 1 / (1.02 * step)
    x = z = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, z - step * backward(forward(z) - target))
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / nt * (new - x)
        x, t = new, nt
    return x * scale


def plan_containers(hist: np.ndarray, capacity: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Groups (first container, containers, [(size, copies), ...]) that take in every item of the histogram."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    if left[capacity]:
        groups.append((int(left[capacity]), [(capacity, 1)]))
        left[capacity] = 0
    parts = combinations(left, capacity)
    repeats = non_negative_least_squares(parts, left)
    for i in np.argsort(-repeats, kind="stable"):
        n = int(repeats[i])
        if n <= 0:
            break
        sizes, copies = np.unique(parts[i][parts[i] > 0], return_counts=True)
        n = min(n, int((left[sizes] // copies).min()))
        if n > 0:
            left[sizes] -= n * copies
            groups.append((n, [(int(s), int(c)) for s, c in zip(sizes[::-1], copies[::-1], strict=True)]))
    groups += best_fit(left, capacity)
    out, first = [], 0
    for n, content in groups:
        out.append((first, n, content))
        first += n
    return out


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on a histogram: like containers are filled together."""
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # by free tokens: containers alike
    free: list[int] = []  # the keys of room, in order
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def put(rest: int, n: int, content: list[tuple[int, int]]) -> None:
        if rest == 0:
            done.append((n, content))
            return
        if rest not in room:
            room[rest] = []
            insort(free, rest)
        room[rest].append((n, content))

    for size in np.flatnonzero(left)[::-1].tolist():
        if size == 0:
            continue
        n = int(left[size])
        while n:
            at = bisect_left(free, size)
            if at == len(free):
                each = capacity // size
                if n >= each:
                    put(capacity - each * size, n // each, [(size, each)])
                    n %= each
                if n:
                    put(capacity - n * size, 1, [(size, n)])
                break
            rest = free[at]
            there, content = room[rest].pop()
            if not room[rest]:
                del room[rest], free[at]
            each = min(rest // size, n)
            used = min(there, n // each)
            if there > used:
                put(rest, there - used, content)
            put(rest - each * size, used, [*content, (size, each)])
            n -= used * each
    return done + [x for rest in free for x in room[rest]]


def plan_rows(groups: list[tuple[int, int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first number, first container, copies, first slot, offset): where the items of a size go, by their number."""
    rows = []
    used: dict[int, int] = {}
    for first, n, content in groups:
        slot = offset = 0
        for size, copies in content:
            start = used.get(size, 0)
            rows.append((size, start, first, copies, slot, offset))
            used[size] = start + n * copies
            slot += copies
            offset += size * copies
    return rows


# ------------------------------------------------------------------ the texts
#: Texts are numbered within their size and part, so that a common size doesn't end in one task: parts at least, and
#: texts for each part beyond.
LEAST_PARTS, TEXTS_A_PART = 128, 100_000


def grain(capacity: int) -> int:
    """Tokens in a class of sizes: 1 up to ``MOST_CLASSES``."""
    return -(-capacity // MOST_CLASSES)


def _row_at(plan: Column, number: Column, longest: int) -> Column:
    """The last row of a sorted plan that starts at or before ``number``, by bisection."""
    start = F.struct(F.lit(0).alias("low"), F.size(plan).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        after = F.get(plan, middle)["start"] <= number
        open_ = acc["low"] < acc["high"]
        return F.struct(F.when(open_ & after, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~after, middle).otherwise(acc["high"]).alias("high"))

    return F.get(plan, F.aggregate(F.sequence(F.lit(1), F.lit(longest.bit_length() + 1)), start, halve)["low"] - 1)


def pack(documents: DataFrame, specs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(spec_id, doc_id, piece, n_tokens, first_token, container_id, slot, offset) for every piece of every text.

    ``first_token`` is where the piece begins in its text, ``offset`` where it lies in its
    container. Only a text above the capacity has more than one piece. An empty text takes no room
    and lies in container 0. Null texts and ids are left out; a repeated id is packed once for each
    row. A capacity that is null or below 1 is refused.
    """
    spark = documents.sparkSession
    # specs are parameters: a row each
    wanted = [(x["spec_id"], x["capacity_tokens"]) for x in specs.select("spec_id", "capacity_tokens").distinct().collect()]
    if any(c is None or c < 1 for _, c in wanted):
        raise ValueError("a capacity must be at least 1")
    schema = "spec_id int, doc_id long, piece long, n_tokens long, first_token long, container_id long, slot int, offset int"
    if not wanted:
        return spark.createDataFrame([], schema)
    sizes = materialise(token_counts(documents, tokenizer), "token-counts")
    parts = max(LEAST_PARTS, -(-sizes.count() // TEXTS_A_PART))
    spec = F.explode(F.array(*(F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("cap"), F.lit(grain(c)).cast("long").alias("grain")) for s, c in wanted))).alias("spec")
    each = sizes.select("doc_id", "n_tokens", spec).select("doc_id", "n_tokens", "spec.*")
    whole = F.when(F.col("n_tokens") > F.col("cap"), F.floor(F.col("n_tokens") / F.col("cap"))).otherwise(F.lit(0))
    each = each.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("n_tokens") - F.col("whole") * F.col("cap"))
    # items: (size, how many of it): the whole pieces of a long text, and its rest or the text itself
    items = each.select(
        "spec_id", "doc_id", "cap", "grain",
        F.explode(F.array(
            F.struct(F.col("cap").alias("size"), F.col("whole").alias("many"), F.lit(0).cast("long").alias("piece")),
            F.struct(F.col("rest").alias("size"), F.when((F.col("rest") > 0) | (F.col("whole") == 0), 1).otherwise(0).cast("long").alias("many"), F.col("whole").alias("piece")),
        )).alias("x"),
    ).select("spec_id", "doc_id", "cap", "grain", "x.*").where("many > 0").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    # an item above the last whole class has its container to itself
    items = items.withColumn("class", F.least(F.ceil(F.col("size") / F.col("grain")), F.floor(F.col("cap") / F.col("grain"))))
    counts = items.groupBy("spec_id", "class", "part").agg(F.sum("many").alias("n"))
    hist: dict[int, np.ndarray] = {s: np.zeros(c // grain(c) + 1, dtype=np.int64) for s, c in wanted}
    for x in counts.groupBy("spec_id", "class").agg(F.sum("n").alias("n")).collect():
        hist[x["spec_id"]][x["class"]] = x["n"]
    planned = [(s, *row) for s, c in wanted for row in [(0, 0, 0, 1 << 30, 0, 0), *plan_rows(plan_containers(hist[s], c // grain(c)))]]
    frame = pd.DataFrame(planned, columns=["spec_id", "class", "start", "container", "copies", "slot", "offset"])
    longest = int(frame.groupby(["spec_id", "class"]).size().max())
    plan = (
        spark.createDataFrame(frame, "spec_id int, class long, start long, container long, copies long, slot int, offset int")
        .groupBy("spec_id", "class").agg(F.sort_array(F.collect_list(F.struct("start", "container", "copies", "slot", "offset"))).alias("plan"))
    )
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("spec_id", "class").orderBy("part")) - F.col("n")).drop("n")
    running = Window.partitionBy("spec_id", "class", "part").orderBy("doc_id", "piece").rowsBetween(Window.unboundedPreceding, 0)
    numbered = items.withColumn("upto", F.sum("many").over(running)).join(before, ["spec_id", "class", "part"]).withColumn("first", F.col("base") + F.col("upto") - F.col("many"))
    # a plan row takes some 40 bytes
    side = F.broadcast(plan) if 40 * len(frame) <= BROADCAST_BYTES else plan
    placed = numbered.join(side, ["spec_id", "class"]).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))).withColumn("number", F.col("first") + F.col("k"))
    at = placed.withColumn("p", _row_at(F.col("plan"), F.col("number"), longest)).withColumn("nth", F.col("number") - F.col("p.start"))
    return at.select(
        "spec_id", "doc_id", (F.col("piece") + F.col("k")).alias("piece"), F.col("size").alias("n_tokens"),
        ((F.col("piece") + F.col("k")) * F.col("cap")).alias("first_token"),
        F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.col("p.container") + F.floor(F.col("nth") / F.col("p.copies"))).cast("long").alias("container_id"),
        F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("p.slot") + F.col("nth") % F.col("p.copies")).cast("int").alias("slot"),
        ((F.col("p.offset") + F.when(F.col("size") == 0, 0).otherwise((F.col("nth") % F.col("p.copies")) * F.col("class"))) * F.col("grain")).cast("int").alias("offset"),
    )


def waste(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, containers, tokens, unused, least_containers) of a packing."""
    used = packed.where("n_tokens > 0").groupBy("spec_id").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    joined = used.join(F.broadcast(specs.select("spec_id", "capacity_tokens").distinct()), "spec_id")
    return joined.select(
        "spec_id", "containers", "tokens", (F.col("containers") * F.col("capacity_tokens") - F.col("tokens")).cast("long").alias("unused"),
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("long").alias("least_containers"),
    )
