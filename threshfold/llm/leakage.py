"""Evaluation texts that leaked into training text.

A prefix-filtered set join on gapped five-word shingles with exact verification:

1. a text is the set of its *gapped shingles*: from every run of five words, the four words that
   remain when one is left out. A word that was changed, added or dropped inside a run leaves one
   of them whole, so a stretch in which no more than every fifth word was edited still shares
   shingles, where plain five-word shingles can share none;
2. one pass over the documents reads the words and writes down where shingles of the items occur
   (postings) and in how many documents; this orders an item's shingles by rarity;
3. a leak shares at least ``MIN_SHARED`` distinct shingles with its item, so it holds one of the
   item's ``size - MIN_SHARED + 1`` rarest (its prefix): postings meet items through prefixes, and
   only the pairs found there meet all shingles;
4. pairs pass a length bound (both texts have ``MIN_WORDS`` words) and positional bounds (the shared
   shingles form chains that advance in both texts; a chain has ``MIN_CHAIN`` shingles, and the
   chains of a pair cover ``MIN_COVER`` words of the item);
5. chains are verified by aligning an item-sized window of the document with the item in a band
   around the chain. A stretch counts where at least ``DENSITY`` of it matches, and the best one or
   two stretches in the item's order must reach ``MIN_WORDS`` words.

The bounds of 3 and 4 follow from 5: they are the least values over the ways of editing one stretch of 20
kept words by 5 edits, or two of 10 by 2 each. A test counts them out, for 10 words in all ways, for 20 at all
places with changed words.

The items are the stated query set: they are cut into blocks of at most ``BLOCK_WORDS`` words, which
bounds what a task holds. A block reads the documents once; what follows reads its postings, which
are written to the shared folder. No document or shingle of the corpus is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshfold.session import spread, written

#: Words of a run, and the words of it that a gapped shingle keeps; leaving out the first word
#: gives a run's successor without its last word.
SHINGLE = 5
KEPT = np.array(((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)))
MIN_WORDS = 20
MIN_STRETCH = 10
DENSITY = 0.8
MIN_SHARED, MIN_CHAIN, MIN_COVER = 12, 6, 14
#: Furthest step between shingles of a chain, in words and in shift; words beside a chain that are aligned.
STEP, SHIFT, BESIDE = 40, 16, 24
#: Scores of an alignment: a match is worth two edits and a little more, so that a stretch goes on over two of them.
MATCH, EDIT = 5, 2
BLOCK_WORDS = 1_000_000
#: Bytes of text whose words are looked at together.
SLICE_BYTES = 16_000_000
#: Pairs of shingles, and cells of alignments, that are looked at together.
AT_ONCE = 4_000_000
LEAK = "doc_id long, item_id long, n_words long"
_POSTINGS = "doc_id long, pos array<int>, shingle array<int>, at array<int>, word array<int>, counted array<int>, n array<bigint>"

_REPLACED, _DROPPED = r"&(?:[a-z]{2,6}|#\d{1,5});|\]\([^)\s]*\)", r"</?[A-Za-z][^<>\n]{0,80}>|[*_~`\\]+"
_MARKED = r"[<&\]*_~`\\]"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts in lower case, without markup, punctuation and line breaks, and the text of
    each. Markup goes without a trace, so a word with a tag inside stays one word."""
    marked = pc.match_substring_regex(texts, _MARKED)
    if pc.any(marked).as_py():
        bare = pc.replace_substring_regex(pc.replace_substring_regex(texts.filter(marked), _REPLACED, " "), _DROPPED, "")
        texts = pc.replace_with_mask(texts, marked, bare)
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+")
    flat, of = lists.flatten(), pc.list_parent_indices(lists)
    keep = pc.not_equal(flat, "")
    return flat.filter(keep), of.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)


def shingles(word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gapped shingles of word numbers: hash, place of the first word, kind. Runs with an unknown
    word (-1) among the kept ones or across two texts have none."""
    known = word >= 0
    h, at, kind = [], [], []
    for k, q in enumerate(KEPT):
        m = len(word) - q[3]
        if m <= 0:
            continue
        ok = np.flatnonzero(known[:m] & known[q[1] : m + q[1]] & known[q[2] : m + q[2]] & known[q[3] :] & (text[:m] == text[q[3] :]))
        x = np.zeros(len(ok), np.uint64)
        with np.errstate(over="ignore"):
            for j in q:
                x = (x ^ (word[ok + j].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(29)
        h.append(x), at.append(ok), kind.append(np.full(len(ok), k))
    none = np.zeros(0, np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *h]), np.concatenate([none, *at]), np.concatenate([none, *kind])


@dataclass
class Block:
    """Items of one block: their words as numbers, and where each shingle occurs in them."""

    ids: np.ndarray
    vocabulary: pa.Array
    word: np.ndarray  # of all items, one after the other
    start: np.ndarray  # of each item in ``word``, and the end
    shingle: np.ndarray  # distinct hashes in order
    first: np.ndarray  # of each shingle's occurrences, and the end
    item: np.ndarray  # by occurrence
    place: np.ndarray
    kind: np.ndarray
    prefix: np.ndarray  # whether the occurrence belongs to its item's prefix

    @classmethod
    def build(cls, ids: list[int], texts: list[str]) -> Block:
        flat, of = words_of(pa.array(texts, pa.string()))
        enc = flat.dictionary_encode()
        word = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.searchsorted(of, np.arange(len(ids) + 1))
        h, at, kind = shingles(word, of)
        o = np.argsort(h, kind="stable")
        h, at, kind = h[o], at[o], kind[o]
        distinct, first = np.unique(h, return_index=True)
        item = of[at]
        return cls(np.asarray(ids, np.int64), enc.dictionary, word, start, distinct, np.append(first, len(h)), item, at - start[item], kind, np.ones(len(h), bool))

    def order_by_rarity(self, counts: np.ndarray) -> None:
        """Mark each item's prefix: all but its MIN_SHARED - 1 most frequent distinct shingles.
        ``counts``: documents that hold each shingle. One sort, by item and falling frequency."""
        of = np.repeat(np.arange(len(self.shingle)), np.diff(self.first))
        pair, back = np.unique(self.item * np.int64(len(self.shingle)) + of, return_inverse=True)
        item, sh = pair // max(1, len(self.shingle)), pair % max(1, len(self.shingle))
        o = np.lexsort((sh, -counts[sh], item))
        rank = np.empty(len(o), np.int64)
        rank[o] = np.arange(len(o)) - np.searchsorted(item[o], item[o], "left")
        size = np.bincount(item, minlength=len(self.ids))[item]
        self.prefix = ((rank >= MIN_SHARED - 1) | (size < MIN_SHARED))[back]

    def size(self, item: np.ndarray) -> np.ndarray:
        return self.start[item + 1] - self.start[item]


def _spans(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``lo[i], lo[i] + 1, ...`` (``n[i]`` of them) for every i, in one array."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _lists(values: np.ndarray, of: np.ndarray, rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values as one list per row of ``rows``; ``of`` (in order) says whose they are."""
    cuts = np.append(np.searchsorted(of, rows, "left"), len(of))
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _sliced(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most SLICE_BYTES of text, or of one text."""
    ends, a = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False)), 0
    while a < b.num_rows:
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES, "right")))
        yield b.slice(a, z - a)
        a = z


def postings(block: Block):
    """A map over documents: those that may hold a leak, with the places of the block's shingles and
    the words around them; at the end one row that counts the documents of each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, none = np.zeros(len(block.shingle), np.int64), pa.scalar(None, pa.list_(pa.int32()))
        names = ["doc_id", "pos", "shingle", "at", "word", "counted", "n"]
        for b in (part for whole in batches for part in _sliced(whole)):
            flat, of = words_of(b.column("text").cast(pa.string()))
            word = pc.fill_null(pc.index_in(flat, value_set=block.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            h, at, _ = shingles(word, of)
            if not len(h) or not len(block.shingle):
                continue
            sh = np.minimum(np.searchsorted(block.shingle, h), len(block.shingle) - 1)
            hit = np.flatnonzero(block.shingle[sh] == h)
            sh, at = sh[hit], at[hit]
            pair = _each(of[at] * np.int64(len(block.shingle)) + sh)
            total += np.bincount(pair % len(block.shingle), minlength=len(total))
            some = np.bincount(pair // len(block.shingle), minlength=b.num_rows)
            long = np.bincount(of, minlength=b.num_rows) >= MIN_WORDS
            rows = np.flatnonzero((some >= MIN_SHARED) & long)
            if not len(rows):
                continue
            o = np.argsort(at, kind="stable")
            sh, at = sh[o], at[o]
            mine = np.isin(of[at], rows)
            sh, at = sh[mine], at[mine]
            # words within reach of a posting, each once
            edge = np.zeros(len(word) + 1, np.int64)
            np.add.at(edge, np.maximum(at - BESIDE, 0), 1)
            np.add.at(edge, np.minimum(at + SHINGLE + BESIDE, len(word)), -1)
            near = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & np.isin(of, rows))
            start = np.searchsorted(of, np.arange(b.num_rows))
            lists = [_lists(at - start[of[at]], of[at], rows, pa.int32()), _lists(sh, of[at], rows, pa.int32()), _lists(near - start[of[near]], of[near], rows, pa.int32()), _lists(word[near], of[near], rows, pa.int32())]
            empty = [pa.array([None] * len(rows), pa.list_(t)) for t in (pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), *lists, *empty], names)
        some = np.flatnonzero(total)
        if len(some):
            count = [pa.array([some.astype(np.int32)], pa.list_(pa.int32())), pa.array([total[some]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *[pa.array([none.as_py()], pa.list_(pa.int32()))] * 4, *count], names)

    return run


# --- verification ----------------------------------------------------------------------------


@dataclass
class Chain:
    """A stretch to align: the pair it belongs to, the places of its shingles, and the bounds of both texts."""

    pair: int
    d: np.ndarray
    i: np.ndarray
    shingle: np.ndarray
    lo: tuple[int, int]
    hi: tuple[int, int]


def _chained(pair: np.ndarray, d: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of shared shingles and the chain of each in that order: within a pair, shifts apart
    by at most SHIFT and places by at most STEP."""
    o = np.lexsort((d, d - i, pair))
    s = (d - i)[o]
    cut = np.concatenate([[True], (pair[o][1:] != pair[o][:-1]) | (s[1:] - s[:-1] > SHIFT)])
    group = np.empty(len(o), np.int64)
    group[o] = np.cumsum(cut)
    o = np.lexsort((i, d, group))
    return o, np.cumsum(np.concatenate([[True], (group[o][1:] != group[o][:-1]) | (d[o][1:] - d[o][:-1] > STEP)])) - 1


def _each(values: np.ndarray) -> np.ndarray:
    """Distinct values in order (by sorting, which for long integers is much faster than hashing)."""
    v = np.sort(values)
    return v[np.concatenate([[True], v[1:] != v[:-1]])[: len(v)]]


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many distinct values each of n groups holds."""
    top = np.int64(value.max(initial=0) + 1)
    return np.bincount(_each(group * top + value) // top, minlength=n)


def align(doc: list[np.ndarray], item: list[np.ndarray], low: np.ndarray, wide: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The best local alignment (MATCH, and -EDIT for a change, addition or loss) of each text with its partner:
    by column whether it matches, and its place in both. Cells are kept to a band: word a of a text
    meets words ``a + low`` to ``a + low + wide - 1``. All texts go row by row together."""
    n, rows, band = len(doc), max(map(len, doc)), int(wide.max())
    dw, iw = np.full((n, rows), -1, np.int64), np.full((n, rows + band), -2, np.int64)
    for c in range(n):
        dw[c, : len(doc[c])] = doc[c]
        a, z = max(0, int(low[c])), min(len(item[c]), int(low[c]) + rows + band)
        if z > a:
            iw[c, a - int(low[c]) : z - int(low[c])] = item[c][a:z]
    offset = np.arange(band, dtype=np.int32)
    inside = offset[None, :] < wide[:, None]
    prev, way = np.zeros((n, band), np.int32), np.zeros((rows, n, band), np.uint8)
    best, best_row, best_at = np.zeros(n, np.int32), np.full(n, -1), np.zeros(n, np.int64)
    for a in range(rows):
        same = (iw[:, a : a + band] == dw[:, a : a + 1]) & inside
        diag = prev + np.where(same, MATCH, -EDIT).astype(np.int32)
        up = np.full((n, band), -EDIT, np.int32)
        up[:, :-1] = prev[:, 1:] - EDIT
        c = np.maximum(np.maximum(diag, up), 0)
        now = np.maximum.accumulate(c + EDIT * offset, axis=1) - EDIT * offset
        way[a] = np.where(now <= 0, 0, np.where(now == diag, 1, np.where(now == up, 2, 3)))
        top = now.argmax(axis=1)
        score = now[np.arange(n), top]
        more = score > best
        best[more], best_row[more], best_at[more] = score[more], a, top[more]
        prev = now
    a, o, live, c = best_row.copy(), best_at.copy(), best > 0, np.arange(n)
    cols = []
    while live.any():
        w = np.where(live, way[np.maximum(a, 0), c, o], 0)
        live = live & (w > 0)
        hit = live & (w == 1) & (iw[c, np.maximum(a, 0) + o] == dw[c, np.maximum(a, 0)])
        cols.append((live, hit, a.copy(), a + o + low))
        a, o = a - (live & (w < 3)), np.clip(o + (live & (w == 2)) - (live & (w == 3)), 0, band - 1)
        live = live & (a >= 0)
    if not cols:
        return [(np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
    used, hit, at, to = (np.stack(x)[::-1] for x in zip(*cols, strict=True))
    return [(hit[u, k], at[u, k], to[u, k]) for k in range(n) for u in [used[:, k]]]


def dense(hit: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of columns that hold MIN_STRETCH matches and DENSITY of matches, and begin and end with
    one: all of them where that is dense; otherwise the longest, what is left of it on both sides, and
    the two disjoint ones that hold most matches together."""
    at = np.flatnonzero(hit)
    if len(at) < MIN_STRETCH:
        return []
    a, z = int(at[0]), int(at[-1]) + 1
    if len(at) >= DENSITY * (z - a):
        return [(a, z)]
    # a stretch is dense where its sum is at least 0: a match adds 1, an edit takes what DENSITY allows per match
    cost = np.where(hit[a:z], 1, -round(DENSITY / (1 - DENSITY)))
    found = _disjoint(hit, cost, a)
    return sorted({*found, *_two(at - a, np.concatenate([[0], np.cumsum(cost)]), a)})


def _disjoint(hit: np.ndarray, cost: np.ndarray, a: int) -> list[tuple[int, int]]:
    """The longest dense stretch of the columns that start at ``a``, then the longest beside it, and so on."""
    out, todo = [], [(0, len(cost))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < MIN_STRETCH:
            continue
        p = np.concatenate([[0], np.cumsum(cost[lo:hi])])
        most, best, i, j = np.maximum.accumulate(p[::-1])[::-1], (0, 0), 0, 0
        while j < len(p):
            if most[j] >= p[i]:
                best = max(best, (j - i, i))
                j += 1
            else:
                i += 1
        inner = np.flatnonzero(hit[a + lo + best[1] : a + lo + best[1] + best[0]])
        if len(inner) < MIN_STRETCH:
            continue
        x, y = lo + best[1] + int(inner[0]), lo + best[1] + int(inner[-1]) + 1
        out.append((a + x, a + y))
        todo += [(lo, x), (y, hi)]
    return out


def _two(at: np.ndarray, p: np.ndarray, a: int) -> list[tuple[int, int]]:
    """Two disjoint dense stretches that hold most matches together; only of alignments of at most
    2,000 matches, as in longer ones that are dense nowhere for MIN_WORDS words a single stretch decides."""
    n = len(at)
    if n < 2 * MIN_STRETCH or n > 2000:
        return []
    ok = (p[at + 1][None, :] >= p[at][:, None]) & (np.arange(n)[None, :] - np.arange(n)[:, None] >= MIN_STRETCH - 1)
    k = np.where(ok, np.arange(n)[None, :] - np.arange(n)[:, None] + 1, 0)  # matches from the i-th to the j-th
    ends, starts = np.maximum.accumulate(k.max(axis=0)), np.maximum.accumulate(k.max(axis=1)[::-1])[::-1]
    t = int(np.argmax(ends[:-1] + starts[1:]))
    if not ends[t] or not starts[t + 1]:
        return []
    i, j = np.argwhere((k == ends[t]) & (np.arange(n)[None, :] <= t))[0]
    x, y = np.argwhere((k == starts[t + 1]) & (np.arange(n)[:, None] > t))[0]
    return [(a + int(at[i]), a + int(at[j]) + 1), (a + int(at[x]), a + int(at[y]) + 1)]


def leaked_words(found: list[tuple[int, int, int, int, int]]) -> int:
    """Most matching words of one stretch ``(words, document from, to, item from, to)``, or of two
    that don't overlap and keep the item's order."""
    if len(found) < 2:
        return found[0][0] if found else 0
    ends, best = sorted(found, key=lambda s: s[2]), max(s[0] for s in found)
    before, k = np.zeros(max(s[4] for s in found) + 1, np.int64), 0  # by place in the item: the most words that end there or earlier
    for s in sorted(found, key=lambda s: s[1]):
        while k < len(ends) and ends[k][2] <= s[1]:
            before[ends[k][4] :] = np.maximum(before[ends[k][4] :], ends[k][0])
            k += 1
        best = max(best, s[0] + int(before[s[3]]))
    return best


def _stretches(block: Block, item: np.ndarray, chains: list[Chain], at: list[np.ndarray], word: list[np.ndarray]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Verified stretches of each pair. What an alignment leaves of a chain on either side is aligned again."""
    found: dict[int, list[tuple[int, int, int, int, int]]] = {}
    while chains:
        chains.sort(key=lambda c: int(c.d[-1] - c.d[0]))
        again: list[Chain] = []
        k = 0
        while k < len(chains):
            part, cells, docs, items, low, wide = [], 0, [], [], [], []
            while k < len(chains):
                c = chains[k]
                d0, d1 = max(c.lo[0], int(c.d.min()) - BESIDE), min(c.hi[0], int(c.d.max()) + SHINGLE + BESIDE)
                i0, i1 = max(c.lo[1], int(c.i.min()) - BESIDE), min(c.hi[1], int(c.i.max()) + SHINGLE + BESIDE)
                s = c.i - c.d
                b0, b1 = int(s.min()) - 8, int(s.max()) + 8
                size = (d1 - d0) * (b1 - b0 + 1)
                if part and (cells + size > AT_ONCE or (d1 - d0) > 2 * len(docs[0]) + 32):
                    break
                row = np.full(d1 - d0, -1, np.int64)
                x, z = np.searchsorted(at[c.pair], (d0, d1))
                row[at[c.pair][x:z] - d0] = word[c.pair][x:z]
                here = block.start[item[c.pair]]
                part.append((c, d0, i0)), docs.append(row), items.append(block.word[here + i0 : here + i1])
                low.append(b0 + d0 - i0), wide.append(b1 - b0 + 1)
                cells += size
                k += 1
            for (c, d0, i0), (hit, a, b) in zip(part, align(docs, items, np.array(low), np.array(wide)), strict=True):
                for x, y in dense(hit):
                    found.setdefault(c.pair, []).append((int(hit[x:y].sum()), d0 + int(a[x]), d0 + int(a[y - 1]) + 1, i0 + int(b[x]), i0 + int(b[y - 1]) + 1))
                if not len(hit):
                    continue
                first, last = (d0 + int(a[0]), i0 + int(b[0])), (d0 + int(a[-1]) + 1, i0 + int(b[-1]) + 1)
                for rest, lo, hi in ((c.d + SHINGLE <= first[0] + 1, c.lo, first), (c.d >= last[0] - 1, last, c.hi)):
                    if rest.any() and len(np.unique(c.shingle[rest])) >= MIN_CHAIN and hi[0] > lo[0] and hi[1] > lo[1]:
                        again.append(Chain(c.pair, c.d[rest], c.i[rest], c.shingle[rest], lo, hi))
        chains = again
    return found


def verify(block: Block, size: list[int], pos: list[np.ndarray], sh: list[np.ndarray], at: list[np.ndarray], word: list[np.ndarray], items: tuple[int, int]) -> list[tuple[int, int, int]]:
    """``(document, item, words)`` of the leaks of some documents from a range of items."""
    doc = np.repeat(np.arange(len(pos)), [len(p) for p in pos])
    d, s = np.concatenate(pos).astype(np.int64), np.concatenate(sh).astype(np.int64)

    def met(which: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        n = block.first[s[which] + 1] - block.first[s[which]]
        occ = _spans(block.first[s[which]], n)
        post = np.repeat(which, n)
        ok = (block.item[occ] >= items[0]) & (block.item[occ] < items[1])
        if keep is None:
            ok &= block.prefix[occ]
        else:
            ok &= np.isin(doc[post] * np.int64(len(block.ids)) + block.item[occ], keep)
        return post[ok], occ[ok]

    rare = np.add.reduceat(block.prefix, block.first[:-1]) > 0 if len(block.shingle) else np.zeros(0, bool)
    post, occ = met(np.flatnonzero(rare[s]), None)
    pairs = _each(doc[post] * np.int64(len(block.ids)) + block.item[occ])
    pairs = pairs[block.size(pairs % len(block.ids)) >= MIN_WORDS]
    if not len(pairs):
        return []
    post, occ = met(np.flatnonzero(np.isin(doc, pairs // len(block.ids))), pairs)
    pair = np.searchsorted(pairs, doc[post] * np.int64(len(block.ids)) + block.item[occ])
    pd_, pi, ps = d[post], block.place[occ], s[post]
    o, chain = _chained(pair, pd_, pi)
    pair, pd_, pi, ps, kind = pair[o], pd_[o], pi[o], ps[o], block.kind[occ[o]]
    ok = (_distinct(chain, ps, int(chain[-1]) + 1) >= MIN_CHAIN)[chain]
    pair, pd_, pi, ps, kind, chain = pair[ok], pd_[ok], pi[ok], ps[ok], kind[ok], chain[ok]
    if not len(pair):
        return []
    covered = _distinct(np.repeat(pair, 4), (pi[:, None] + KEPT[kind]).ravel(), len(pairs))
    ok = ((covered >= MIN_COVER) & (_distinct(pair, ps, len(pairs)) >= MIN_SHARED))[pair]
    pair, pd_, pi, ps, chain = pair[ok], pd_[ok], pi[ok], ps[ok], chain[ok]
    if not len(pair):
        return []
    cut = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    item, of = pairs % len(block.ids), pairs // len(block.ids)
    chains = [Chain(int(p := pair[a]), pd_[a:z], pi[a:z], ps[a:z], (0, 0), (size[of[p]], int(block.size(item[p])))) for a, z in zip(cut, [*cut[1:], len(chain)], strict=True)]
    found = _stretches(block, item, chains, [at[k] for k in of], [word[k] for k in of])
    return [(int(of[p]), int(item[p]), n) for p, f in sorted(found.items()) if (n := leaked_words(f)) >= MIN_WORDS]


def _verified(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.diff(block.first)
        for b in batches:
            ids = b.column("doc_id")
            col = [[x.to_numpy(zero_copy_only=False) for x in (v.values for v in b.column(c))] for c in ("pos", "shingle", "at", "word")]
            out, k = [], 0
            while k < b.num_rows:
                z, n = k, 0
                while z < b.num_rows and (z == k or n < AT_ONCE):
                    n += int(many[col[1][z]].sum())
                    z += 1
                cuts = np.linspace(0, len(block.ids), -(-n // (4 * AT_ONCE)) + 1).astype(int) if z == k + 1 and n > 4 * AT_ONCE else np.array([0, len(block.ids)])
                at = [x.astype(np.int64) for x in col[2][k:z]]
                size = [int(x[-1]) + 1 for x in at]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    out += [(k + d, int(block.ids[i]), n_) for d, i, n_ in verify(block, size, *[x[k:z] for x in col[:2]], at, col[3][k:z], (int(lo), int(hi)))]
                k = z
            rows, item, words = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(item), pa.array(words)], ["doc_id", "item_id", "n_words"])

    return run


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[tuple[list[int], list[str]]]:
    """Items in blocks of at most BLOCK_WORDS words, read one block at a time."""
    ids, texts, held = [], [], 0
    for r in items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long"), item_text).toLocalIterator():
        n = len(re.findall(r"\w+", r[1]))
        if ids and held + n > BLOCK_WORDS:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r[0]), texts.append(r[1])
        held += n
    if ids:
        yield ids, texts


def shingle_counts(found: DataFrame, block: Block) -> np.ndarray:
    """In how many documents (rows) each shingle of the block occurs; all documents count. As many
    rows reach the driver as the block has shingles."""
    n = np.zeros(len(block.shingle), np.int64)
    each = found.where("counted is not null").select(F.explode(F.arrays_zip("counted", "n")).alias("z")).select("z.*").groupBy("counted").agg(F.sum("n").alias("n"))
    got = each.toPandas()
    n[got["counted"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return n


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_words``: every document with the items it leaks and how many words.

    Null texts leak nothing and are leaked by nothing; so do texts under MIN_WORDS words. Repeated
    documents come out for each row, repeated items for each identifier. No item or no document
    gives no rows. Other columns are not read. The pass over the documents runs when this is called.
    """
    out = None
    text = spread(docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")))
    for ids, texts in _blocks(items, item_id, item_text):
        block = Block.build(ids, texts)
        found = written(text.mapInArrow(postings(block), _POSTINGS), "postings")
        block.order_by_rarity(shingle_counts(found, block))
        part = found.where("pos is not null").select("doc_id", "pos", "shingle", "at", "word").mapInArrow(_verified(block), LEAK)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], LEAK)
