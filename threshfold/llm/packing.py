"""Filling containers of fixed capacity with whole texts by bin completion.

Texts are measured in tokens of a public tokenizer; only a text longer than the capacity is cut,
into full pieces and a rest. Pieces are dealt into shards of about ``SHARD`` pieces by their place in
the order of sizes, so the shards are alike and the same on any number of cores, and each
shard is packed by branch and bound: a container is opened with the largest piece left and
completed with undominated fillings from the rest, largest first, until one leaves no space or
the node budget ends; a branch is cut where all smaller pieces together could not beat the best
filling, and a whole attempt where its waste so far rules out beating the incumbent. The first
incumbent is best-fit decreasing, and a result that meets the lower bound ends the search.
Where those attempts don't meet it, the search goes back over the containers, last ones first,
to their other fillings, for at most ``STEPS`` containers beyond the first attempt.

A shard leaves at most one container that is filled badly for want of pieces, which is
``1 / (containers of a shard)`` of the space at most.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshfold.operators.series import ordinal_ranks
from threshfold.session import spread, written

CAPACITY = 2048
SHARD = 20_000
NODES = 400
#: Containers that backtracking opens in a shard beyond those of its first attempt.
STEPS = 2_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenizer pattern that belongs to this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PACKED = "doc_id long, piece int, first_token long, n_tokens int, container long"


class Shelf:
    """Sizes with their counts; present sizes in ascending order."""

    def __init__(self, sizes: np.ndarray) -> None:
        u, n = np.unique(sizes, return_counts=True)
        self.asc, self.n = u.tolist(), dict(zip(u.tolist(), n.tolist(), strict=True))

    def take(self, s: int, k: int = 1) -> None:
        self.n[s] -= k
        if not self.n[s]:
            self.asc.pop(bisect_left(self.asc, s))

    def put(self, s: int, k: int = 1) -> None:
        if not self.n.get(s):
            insort(self.asc, s)
        self.n[s] = self.n.get(s, 0) + k


def completion(shelf: Shelf, room: int, nodes: int = NODES) -> tuple[int, list[tuple[int, int]]]:
    """The best filling of ``room`` found: its waste and ``(size, copies)``, larger sizes first.

    A filling is dominated where a larger piece or more copies of a piece would fit in place of
    smaller ones; trying sizes from large to small and as many copies as fit meets the dominating
    filling first, and a later one counts only if it wastes less."""
    asc, have = shelf.asc, shelf.n
    cum = np.cumsum([s * have[s] for s in asc[: bisect_right(asc, room)]], dtype=np.int64) if asc else np.zeros(0, np.int64)
    best: tuple[int, list[tuple[int, int]]] = (room, [])
    left = nodes

    def go(top: int, rem: int, chosen: list[tuple[int, int]]) -> bool:
        nonlocal best, left
        left -= 1
        if rem < best[0]:
            best = (rem, list(chosen))
        if best[0] == 0 or left <= 0:
            return True
        i = bisect_right(asc, rem, 0, top) - 1
        while i >= 0:
            s = asc[i]
            if cum[i] <= rem - best[0]:  # all that is left cannot beat the best
                return False
            for k in range(min(have[s], rem // s), 0, -1):
                chosen.append((s, k))
                if go(i, rem - s * k, chosen):
                    return True
                chosen.pop()
            i -= 1
        return False

    go(bisect_right(asc, room), room, [])
    return best


def fillings(shelf: Shelf, room: int, nodes: int = NODES) -> Iterator[list[tuple[int, int]]]:
    """Undominated fillings of ``room``: the best one found first, then the others by waste, as far as
    ``nodes`` reach. A filling is dominated where a piece left could be added, or could take the place
    of a smaller one in it (which would fit wherever the larger one goes)."""
    first = completion(shelf, room, nodes)[1]
    yield first
    asc, have, left = shelf.asc, shelf.n, nodes
    others: list[tuple[int, list[tuple[int, int]]]] = []

    def dominated(rem: int, used: dict[int, int]) -> bool:
        return any(have[t] > used.get(t, 0) for x in used for t in asc[bisect_right(asc, x) : bisect_right(asc, x + rem)])

    def go(i: int, rem: int, skipped: int, chosen: list[tuple[int, int]]) -> None:
        # skipped: the smallest size of which a piece was left out
        nonlocal left
        left -= 1
        i = min(i, bisect_right(asc, rem) - 1)
        if i < 0:
            if rem < skipped and not dominated(rem, dict(chosen)):
                others.append((rem, list(chosen)))
            return
        s = asc[i]
        for k in range(min(have[s], rem // s), -1, -1):
            if left <= 0:
                return
            go(i - 1, rem - s * k, s if k < have[s] else skipped, [*chosen, (s, k)] if k else chosen)

    go(bisect_right(asc, room) - 1, room, room + 1, [])
    yield from (f for _, f in sorted(others, key=lambda x: x[0]) if f != first)


def backtrack(sizes: np.ndarray, capacity: int, best: list[list[int]], least: int, nodes: int = NODES, steps: int = STEPS) -> list[list[int]]:
    """A packing with fewer containers than ``best`` if one is found, otherwise ``best``.

    Depth first over the fillings of each container, cut where the waste so far rules out beating
    the incumbent; exact where neither budget ends it."""
    shelf, total, left = Shelf(sizes), int(sizes.sum()), steps + len(best)
    stack: list[list] = []  # per container: largest piece, its fillings, the one that is in, waste before it

    def close() -> None:
        s, _, fill, _ = stack[-1]
        for x, k in fill:
            shelf.put(x, k)

    waste, descend = 0, True
    while True:
        if descend:
            if not shelf.asc:
                if len(stack) < len(best):
                    best = [[s, *(x for x, k in fill for _ in range(k))] for s, _, fill, _ in stack]
                if len(best) <= least:
                    return best
                descend = False
                continue
            if len(stack) + 1 >= len(best):
                descend = False
                continue
            left -= 1
            if left < 0:
                return best
            s = shelf.asc[-1]
            shelf.take(s)
            stack.append([s, fillings(shelf, capacity - s, nodes), [], waste])
        elif not stack:
            return best
        else:
            close()
        top = stack[-1]
        top[2] = []
        fill = next(top[1], None)
        if fill is None:
            waste = top[3]
            shelf.put(top[0])
            stack.pop()
            descend = False
            continue
        for x, k in fill:
            shelf.take(x, k)
        top[2] = fill
        waste = top[3] + capacity - top[0] - sum(x * k for x, k in fill)
        descend = waste - (0 if shelf.asc else capacity) <= (len(best) - 1) * capacity - total


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece into the fullest container that has room for it."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for s in sorted(sizes.tolist(), reverse=True):
        at = bisect_left(room, (s, -1))
        if at == len(room):
            bins.append([s])
            insort(room, (capacity - s, len(bins) - 1))
        else:
            r, b = room.pop(at)
            bins[b].append(s)
            insort(room, (r - s, b))
    return bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that no packing can do without."""
    return max(-(-int(sizes.sum()) // capacity), int((sizes > capacity // 2).sum())) if len(sizes) else 0


def pack(sizes: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Containers as lists of sizes (each between 1 and ``capacity``)."""
    best = best_fit(sizes, capacity)
    least = lower_bound(sizes, capacity)
    total = int(sizes.sum())
    for budget in (nodes, 8 * nodes):
        if len(best) <= least:
            break
        shelf, bins, waste = Shelf(sizes), [], 0
        while shelf.asc:
            s = shelf.asc[-1]
            shelf.take(s)
            lost, fill = completion(shelf, capacity - s, budget)
            for x, k in fill:
                shelf.take(x, k)
            bins.append([s, *(x for x, k in fill for _ in range(k))])
            waste += lost if shelf.asc else 0
            if waste > (len(best) - 1) * capacity - total:
                break  # this attempt cannot have fewer containers
        else:
            if len(bins) < len(best):
                best = bins
    return backtrack(sizes, capacity, best, least, nodes) if len(best) > least else best


#: Most bytes of a vocabulary file, which is read by the driver and sent to the tasks.
MOST_VOCABULARY = 32 << 20


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY + 1)
    if len(data) > MOST_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MOST_VOCABULARY} bytes is not sent to tasks")
    return data


class Tokens:
    """Counts tokens with a vocabulary (the content of its file)."""

    def __init__(self, vocabulary: bytes) -> None:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


def token_pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str) -> DataFrame:
    """``doc_id, piece, first_token, n_tokens``: one row per text, or per piece of a long one.

    Null and empty texts have one piece of no tokens. ``vocabulary`` is a path that only the driver reads."""
    content = read_vocabulary(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(content)
        for b in batches:
            n = np.array([0 if t is None else tokens.count(t) for t in b["text"]], dtype=np.int64)
            k = np.maximum(1, -(-n // capacity))
            row = np.repeat(np.arange(len(b)), k)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[row], "piece": piece.astype(np.int32), "first_token": piece * capacity, "n_tokens": np.minimum(n[row] - piece * capacity, capacity).astype(np.int32)})

    text = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return spread(text).mapInPandas(run, "doc_id long, piece int, first_token long, n_tokens int")


def containers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """``doc_id, piece, first_token, n_tokens, container``: every text once, in the container it is put into.

    Null and empty texts take no space: their container is null. Repeated texts are packed each.
    The counts are written to the shared folder when this is called, so texts are tokenized once. Rows are
    dealt to shards by their ordinal in the order of sizes (a distributed sort), whatever their
    identifiers are and however they are partitioned.
    """
    pieces = written(token_pieces(df, id_col, text_col, capacity, vocabulary), "pieces")
    n = pieces.where("n_tokens > 0").count()
    shards = max(1, -(-n // shard))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        sizes = pdf["n_tokens"].to_numpy()
        at = {int(s): int(i) for i, s in zip(*[x[::-1] for x in (np.arange(len(sizes)), sizes)], strict=True)}
        box = np.zeros(len(sizes), np.int64)
        for b, content in enumerate(pack(sizes, capacity)):
            for s in content:
                box[at[s]] = b
                at[s] += 1
        pdf["container"] = (pdf["shard"].to_numpy(np.int64) << 32) + box
        return pdf.drop(columns="shard")

    placed = ordinal_ranks(pieces.where("n_tokens > 0").withColumn("__h", F.xxhash64("doc_id", "piece")), "__place", "n_tokens", "__h", "doc_id", "piece")
    dealt = placed.select("doc_id", "piece", "first_token", "n_tokens", F.pmod(F.col("__place"), F.lit(shards)).cast("long").alias("shard"))
    boxed = dealt.groupBy("shard").applyInPandas(run, PACKED)
    none = pieces.where("n_tokens = 0").select("doc_id", "piece", "first_token", "n_tokens", F.lit(None).cast("long").alias("container"))
    return boxed.unionByName(none)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, containers that the tokens need at least, share of unused space."""
    r = packed.where("container is not null").agg(F.count_distinct("container").alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    least = F.ceil(F.col("n_tokens") / capacity)
    return r.select("n_containers", "n_tokens", least.alias("least_containers"), F.coalesce(1 - F.try_divide(F.col("n_tokens"), F.col("n_containers") * capacity), F.lit(0.0)).alias("unused_share"))
