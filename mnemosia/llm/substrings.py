"""Substring dedup: fuzzy passages by collinear chaining of shared seeds.

Seeds are K-word grams: of every W neighbouring ones the one with the least hash, so
that a run of K + W - 1 equal words always shares one. Every later occurrence of a
seed is joined with the one before it, its hub: within a task in the order of texts, and a task's first one with
that of the task before. So texts with one passage meet one after the other, and a text with a part of it comes
between two of them only where it stands between them. This is linear in the number of occurrences,
and a seed that very many texts have is one row a task when it is shuffled. The
matches of one text with one hub text are chained: both positions rise along a
chain, equal words earn, and skipped words cost; a Fenwick tree over the hub's
positions finds each match's best predecessor. The words of both sides of a chain
are then aligned and extended at the ends, and every stretch of it with enough
equal words is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, small, stored, table
from .textnp import Texts, mix, ngrams

#: Words of a seed, and grams of which one is a seed.
K, W = 6, 3
#: Seeds of a task that are held to find their first occurrences.
HELD = 2_000_000
#: Cost of a skipped word on either side; a chain ends where a gap costs more than the chain has earned, and is split after alignment.
GAP_COST = K / 160
#: Least words of a repeated passage, and share of them that must be equal.
MIN_WORDS, MIN_EQUAL = 50, 0.8
#: Least words of a piece of a passage whose pieces have different hubs.
MIN_PIECE = 20
#: Words by which a chain may grow at each end at first: what lies before its first seed or after its last.
#: A chain that grows to NEAR words from there gets FURTHER times as many.
REACH, NEAR, FURTHER = 40, 20, 8
#: Cells of an alignment that are held at once.
CELLS = 1 << 20
_U = np.uint64


def _fingerprints(with_text: bool):
    """(doc_id, text) -> doc_id, the text if asked for, n_words, f1, f2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _prints_of(batch, with_text)

    return run


def _prints_of(batch: pa.RecordBatch, with_text: bool) -> Iterator[pa.RecordBatch]:
    for at, end, texts in Texts.slices(batch.column(1), lower=True):
        starts, ends, first = texts.words()
        h = texts.hashes(starts, ends)
        place = np.arange(len(h), dtype=_U) - np.repeat(first[:-1], np.diff(first)).astype(_U)
        own = np.append(mix(h + place * _U(0x9E3779B97F4A7C15)), _U(0))
        n = np.diff(first)
        add = lambda x: np.where(n > 0, np.add.reduceat(x, np.minimum(first[:-1], len(h))), 0).astype(np.int64)
        given = [batch.column(k).slice(at, end - at) for k in ((0, 1) if with_text else (0,))]
        yield pa.RecordBatch.from_arrays([*given, pa.array(n.astype(np.int64)), pa.array(add(own)), pa.array(add(mix(own)))], [*("doc_id", "text")[: len(given)], "n_words", "f1", "f2"])


def minimizers(h: np.ndarray, first: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(places, seeds): of the k-grams of word hashes, the least of any w neighbouring ones; texts start at first[:-1]."""
    grams = ngrams(h, k)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = text[: len(grams)] == text[k - 1 :]
    keys = np.where(whole, grams, _U(2**64 - 1))
    n = max(1, len(keys) - w + 1)
    best, at = keys[:n].copy(), np.arange(n)
    for shift in range(1, min(w, len(keys))):
        less = keys[shift : n + shift] < best
        best[less], at[less] = keys[shift : n + shift][less], (np.arange(n) + shift)[less]
    at = np.unique(at)
    at = at[whole[at]]
    return at, grams[at]


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> seed, node, pos, hub, hub_pos: the task's first occurrences of seeds, without a hub, and the
    later ones with a hub, the occurrence before. These have another key, so that they are dealt evenly."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def rows() -> Iterator[pa.RecordBatch]:
        seed, node, pos = (np.concatenate([x[k] for x in held]) for k in range(3))
        held.clear()
        order = np.argsort(seed)
        same = seed[order[1:]] == seed[order[:-1]]
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        own = order[tied]
        order[tied] = own[np.lexsort((pos[own], node[own], seed[own]))]
        seed, node, pos = seed[order], node[order], pos[order]
        later = np.append(False, seed[1:] == seed[:-1])
        hub = np.maximum(np.arange(len(seed)) - 1, 0)
        key = np.where(later, mix(seed ^ mix(node.astype(_U)) ^ pos.astype(_U)), seed).astype(np.int64)
        for at in range(0, len(seed), 50_000):
            to = slice(at, at + 50_000)
            none = ~later[to]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[to]), pa.array(node[to]), pa.array(pos[to]), pa.array(node[hub[to]], mask=none), pa.array(pos[hub[to]], mask=none)],
                ["seed", "node", "pos", "hub", "hub_pos"],
            )

    for batch in batches:
        for at, _, texts in Texts.slices(batch.column(1), lower=True):
            starts, ends, first = texts.words()
            place, seed = minimizers(texts.hashes(starts, ends), first)
            text = np.searchsorted(first, place, "right") - 1
            nodes = batch.column(0).slice(at, texts.n).to_numpy()
            held.append((seed, nodes[text], (place - first[text]).astype(np.int32)))
            if sum(len(x[0]) for x in held) > HELD:
                yield from rows()
    if held:
        yield from rows()


def chains(pos: list[int], hub: list[int], k: int = K, cost: float = GAP_COST, length: list[int] | None = None) -> list[list[int]]:
    """Collinear chains of matches (pos[i], hub[i]) of length[i] words (k if not given), best first, as lists of indices; no match is in two."""
    length = [k] * len(pos) if length is None else length
    order = sorted(range(len(pos)), key=lambda i: (pos[i], -hub[i]))
    rank = {h: r + 1 for r, h in enumerate(sorted(set(hub)))}
    size = len(rank) + 1
    tree: list[tuple[float, int]] = [(-1e300, -1)] * size  # prefix maxima of score + cost * (pos + hub), of the last k words
    score, back = [0.0] * len(pos), [-1] * len(pos)
    for i in order:
        best, at = (-1e300, -1), rank[hub[i]] - 1
        while at > 0:
            if tree[at] > best:
                best = tree[at]
            at -= at & -at
        gain = best[0] - cost * (pos[i] + hub[i])
        score[i], back[i] = (length[i] + gain, best[1]) if gain > 0 else (float(length[i]), -1)
        entry, at = (score[i] + cost * (pos[i] + hub[i] + 2 * (length[i] - k)), i), rank[hub[i]]
        while at < size:
            if entry > tree[at]:
                tree[at] = entry
            at += at & -at
    used: set[int] = set()
    out = []
    for i in sorted(range(len(pos)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and i not in used:
            used.add(i)
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def merged(pos: np.ndarray, hub: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pos, hub, words, seeds) of the stretches that matches at one distance cover without a gap, sorted."""
    order = np.unique((hub - pos) * (1 << 32) + pos)
    at, far = order % (1 << 32), order // (1 << 32)
    start = np.flatnonzero(np.append(True, (far[1:] != far[:-1]) | (at[1:] > at[:-1] + K)))
    end = np.append(start[1:], len(order)) - 1
    pos, hub, n = at[start], at[start] + far[start], at[end] + K - at[start]
    by = np.lexsort((hub, pos))
    return pos[by], hub[by], n[by], (end - start + 1)[by]


def _chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hub, places) -> node, hub, pos, hub_pos, n, seeds: a row a chain, with its stretches' positions, lengths and seeds."""
    ints = pa.list_(pa.int32())
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            nodes, hubs, places = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)
            bounds = places.offsets.to_numpy()
            here, other = (places.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            out = []
            for i, (node, hub) in enumerate(zip(nodes, hubs)):
                own = slice(bounds[i], bounds[i + 1])
                pos, there, n, seeds = (x.tolist() for x in merged(here[own], other[own]))
                found = [[0]] if len(pos) == 1 else chains(pos, there, length=n)
                out += [(node, hub, *([x[i] for i in c] for x in (pos, there, n, seeds))) for c in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), ints, ints, ints, ints))], ["node", "hub", "pos", "hub_pos", "n", "seeds"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chain, side, node, lo, hi, text) -> chain, side, from, words (4 bytes a word)."""
    last, words = None, np.zeros(0, np.uint32)
    for batch in batches:
        names = batch.schema.names
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            cols = {n: part.column(names.index(n)).to_pylist() for n in ("chain", "side", "node", "lo", "hi")}
            text, cut, start = part.column(names.index("text")), [], []
            for i, (node, lo, hi) in enumerate(zip(cols["node"], cols["lo"], cols["hi"])):
                if node != last:
                    for _, _, x in Texts.slices(text.slice(i, 1), lower=True):
                        words = (x.hashes(*x.words()[:2]) >> _U(32)).astype(np.uint32)
                    last = node
                lo = max(0, lo)
                start.append(lo)
                cut.append(words[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cols["chain"], pa.int64()), pa.array(cols["side"], pa.int32()), pa.array(start, pa.int32()), pa.array(cut, pa.binary())], ["chain", "side", "start", "words"])


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words in longest common subsequences of a and every prefix of b."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def matched(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The places in a and b of a longest common subsequence's words."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    same = a[head:][::-1][: n - head] == b[head:][::-1][: n - head]
    tail = n - head if same.all() else int(same.argmin())
    out = [(k, k) for k in range(head)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(x) > 1 and len(x) * len(y) > CELLS:  # halves of x with their shares of y, so that memory is linear
        m = len(x) // 2
        cut = int((_last_row(x[:m], y) + _last_row(x[m:][::-1], y[::-1])[::-1]).argmax())
        out += [(head + i, head + j) for i, j in matched(x[:m], y[:cut])] + [(head + m + i, head + cut + j) for i, j in matched(x[m:], y[cut:])]
    elif len(x) and len(y):
        rows = np.zeros((len(x) + 1, len(y) + 1), np.int32)
        for i, w in enumerate(x):
            rows[i + 1, 1:] = np.maximum.accumulate(np.maximum(rows[i, 1:], rows[i, :-1] + (y == w)))
        inner, i, j = [], len(x), len(y)
        while rows[i, j]:
            if rows[i, j] == rows[i - 1, j]:
                i -= 1
            elif rows[i, j] == rows[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                inner.append((head + i, head + j))
        out += inner[::-1]
    return out + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Words in a longest common subsequence."""
    return len(matched(a, b))


def equal_runs(a: np.ndarray, b: np.ndarray, pos: list[int], there: list[int], length: list[int], n_seeds: list[int], skips: bool) -> np.ndarray:
    """Rows (a from, b from, words, seeds): the runs of equal words along a chain whose stretches stand at pos in a and at there in b.

    Between them the words are aligned. Before the first and after the last, a word
    meets the one at the same distance, or with `skips` they are aligned too."""
    out: list[list[int]] = []

    def add(p: int, q: int, n: int, seeds: int) -> None:
        if n and out and out[-1][0] + out[-1][2] == p and out[-1][1] + out[-1][2] == q:
            out[-1][2] += n
            out[-1][3] += seeds
        elif n:
            out.append([p, q, n, seeds])

    def meet(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        if skips:
            return matched(x, y)
        n = min(len(x), len(y))
        return [(k, k) for k in np.flatnonzero(x[:n] == y[:n]).tolist()]

    i, j = pos[0], there[0]
    for x, y in reversed(meet(a[:i][::-1], b[:j][::-1])):
        add(i - 1 - x, j - 1 - y, 1, 0)
    for p, q, size, seeds in zip(pos, there, length, n_seeds):
        if p >= i and q >= j:
            for x, y in matched(a[i:p], b[j:q]):
                add(i + x, j + y, 1, 0)
            n = size
        else:  # it overlaps the one before
            n = max(0, min(p + size - i, q + size - j))
        add(p + size - n, q + size - n, n, seeds)
        i, j = max(i, p + size), max(j, q + size)
    for x, y in meet(a[i:], b[j:]):
        add(i + x, j + y, 1, 0)
    return np.array(out, np.int64)


def passing(runs: np.ndarray, min_equal: float) -> list[tuple[int, int]]:
    """(first run, last run) of every stretch with enough equal words on both sides that is in no longer one."""
    p, q, n = runs[:, 0], runs[:, 1], runs[:, 2]
    done = np.cumsum(n)
    # a stretch passes if neither side's surplus of equal words falls along it
    from_a, from_b = done - n - min_equal * p - 1e-6, done - n - min_equal * q - 1e-6
    to_a, to_b = done - min_equal * (p + n), done - min_equal * (q + n)
    out, best = [], -1
    for i in range(len(runs)):
        at = max(best + 1, i)
        ends = np.flatnonzero((to_a[at:] >= from_a[i]) & (to_b[at:] >= from_b[i]))
        if len(ends):
            best = at + int(ends[-1])
            out.append((i, best))
            if best == len(runs) - 1:
                break
    return out


def shared_by_prefix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For every row of x and y (rows of words), the words in a longest common subsequence of y and each prefix of x, the empty one first."""
    row = np.zeros((len(x), y.shape[1] + 1), np.int16)
    out = [row[:, -1]]
    for k in range(x.shape[1]):
        new = np.zeros_like(row)
        np.maximum.accumulate(np.maximum(row[:, 1:], row[:, :-1] + (y == x[:, k : k + 1])), axis=1, out=new[:, 1:])
        row = new
        out.append(row[:, -1])
    return np.stack(out, axis=1)


def hopeless(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n: np.ndarray, min_equal: float = MIN_EQUAL) -> np.ndarray:
    """For matches of n words, whether no piece of MIN_PIECE words around one can have enough equal words.

    left and right: the words of both texts, from the match on; missing ones are negative, and differ."""
    surplus = []
    for x, y in (left, right):
        long = np.concatenate([np.ones((len(x), 1), bool), x >= 0], axis=1)
        surplus.append(np.where(long, shared_by_prefix(x, y) - min_equal * np.arange(x.shape[1] + 1), -np.inf))
    # the most surplus of equal words with so many words or more on the right
    best = np.maximum.accumulate(surplus[1][:, ::-1], axis=1)[:, ::-1]
    best = np.concatenate([best, np.full((len(n), MIN_PIECE), -np.inf)], axis=1)
    at = np.maximum(0, MIN_PIECE - n[:, None] - np.arange(surplus[0].shape[1]))
    whole = surplus[0] + np.take_along_axis(best, np.minimum(at, best.shape[1] - 1), axis=1)
    return whole.max(axis=1) + n * (1 - min_equal) < -1e-6


def _around(column: pa.Array, at: np.ndarray, n: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The words before and after a match at at[i] of n[i] words, for every row of words (binary); -1 where there are none."""
    column = column.cast(pa.large_binary())
    _, raw, data = column.buffers()
    bounds = np.frombuffer(raw, np.int64)[column.offset : column.offset + len(column) + 1] // 4
    words = np.append(np.frombuffer(data, np.uint32).astype(np.int64), -1)
    lo, hi = bounds[:-1, None], bounds[1:, None]
    before = lo + at[:, None] - 1 - np.arange(reach)
    after = lo + (at + n)[:, None] + np.arange(reach)
    return words[np.where(before >= lo, before, -1)], words[np.where(after < hi, after, -1)]


def _promising(part: pa.RecordBatch, reach: int) -> pa.RecordBatch:
    """The chains without those of one short stretch that are hopeless."""
    col = lambda c: part.column(part.schema.names.index(c))
    first = lambda c: col(c).values.to_numpy()[col(c).offsets.to_numpy()[:-1]].astype(np.int64)
    sizes = np.diff(col("pos").offsets.to_numpy())
    n = first("n")
    short = np.flatnonzero((sizes == 1) & (n < MIN_PIECE))
    if not len(short):
        return part
    take = pa.array(short)
    n = n[short]
    a_left, a_right = _around(col("a").take(take), first("pos")[short] - col("a0").to_numpy()[short], n, min(reach, REACH))
    b_left, b_right = _around(col("b").take(take), first("hub_pos")[short] - col("b0").to_numpy()[short], n, min(reach, REACH))
    # what is missing on both sides must not count as equal
    b_left, b_right = (np.where(x < 0, -2, x) for x in (b_left, b_right))
    keep = np.ones(part.num_rows, bool)
    keep[short] = ~hopeless((a_left, b_left), (a_right, b_right), n)
    return part.filter(pa.array(keep))


def align(a: np.ndarray, b: np.ndarray, pos: list[int], there: list[int], length: list[int], n_seeds: list[int], min_words: int = MIN_WORDS, min_equal: float = MIN_EQUAL) -> list[tuple[int, int, int, int, int, int]]:
    """(a from, a to, b from, b to, equal words, seeds) of every piece of a chain that has enough equal words by itself.

    A chain over two passages with other words between gives both. What lies outside a
    piece's seeds is left off where it lowers the share of equal words, unless the piece
    needs it to have min_words. Pieces may overlap."""
    found: list[tuple[int, int, int, int, int, int]] = []
    for skips in (False, True):
        runs = equal_runs(a, b, pos, there, length, n_seeds, skips)
        p, q, n = runs[:, 0], runs[:, 1], runs[:, 2]
        done = np.concatenate([[0], np.cumsum(n)])
        pieces = set()
        for i, j in passing(runs, min_equal):
            seeded = i + np.flatnonzero(runs[i : j + 1, 3])
            u, v = i, j
            if len(seeded):
                s, e = int(seeded[0]), int(seeded[-1])
                left, right = np.arange(i, s + 1), np.arange(e, j + 1)
                u = i + int((done[s] - done[left] - min_equal * np.maximum(p[s] - p[left], q[s] - q[left])).argmax())
                v = e + int((done[right + 1] - done[e + 1] - min_equal * np.maximum(p[right] + n[right] - p[e] - n[e], q[right] + n[right] - q[e] - n[e])).argmax())
            if p[v] + n[v] - p[u] < min_words <= p[j] + n[j] - p[i]:
                u, v = i, j
            pieces.add((int(p[u]), int(p[v] + n[v]), int(q[u]), int(q[v] + n[v]), int(done[v + 1] - done[u]), int(runs[u : v + 1, 3].sum())))
        found = sorted(pieces)
        if any(x[1] - x[0] >= min_words for x in found):
            break
    return found


def denser(a: np.ndarray, b: np.ndarray, pos: list[int], there: list[int], length: list[int], n_seeds: list[int]) -> tuple:
    """(a from, b from, a, b, pos, there, length, seeds): a chain with all grams that stand once in both of its long texts,
    and the texts cut REACH * FURTHER words before and after it. What is between is then short."""
    grams = []
    for x in (a, b):
        values, first, count = np.unique(ngrams(x.astype(_U), K), return_index=True, return_counts=True)
        grams.append((values[count == 1], first[count == 1]))
    _, i, j = np.intersect1d(grams[0][0], grams[1][0], assume_unique=True, return_indices=True)
    own = [(p + k, q + k) for p, q, n in zip(pos, there, length) for k in range(n - K + 1)]
    here = np.concatenate([grams[0][1][i], [p for p, _ in own]]).astype(np.int64)
    other = np.concatenate([grams[1][1][j], [q for _, q in own]]).astype(np.int64)
    p, q, n, s = (x.tolist() for x in merged(here, other))
    for chain in chains(p, q, length=n):
        if any(q[k] - p[k] == there[0] - pos[0] and p[k] <= pos[0] < p[k] + n[k] for k in chain):
            pos, there, length, n_seeds = ([x[k] for k in chain] for x in (p, q, n, s))
            break
    far = REACH * FURTHER
    a_lo, b_lo = max(0, pos[0] - far), max(0, there[0] - far)
    return a_lo, b_lo, a[a_lo : pos[-1] + length[-1] + far], b[b_lo : there[-1] + length[-1] + far], [x - a_lo for x in pos], [x - b_lo for x in there], length, n_seeds


def _align_batches(reach: int):
    """Rows (chain, node, hub, start, end, hub_start, hub_end, n_equal, n_seeds): a row a piece of MIN_PIECE words, or for a chain
    with such a piece near the end of the words at hand that is not that of the text, one with nulls from node on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                d = _promising(batch.slice(at, 500), reach).to_pydict()
                out = []
                for chain, node, hub, pos, there, length, seeds, a0, a, b0, b in zip(*(d[n] for n in ("chain", "node", "hub", "pos", "hub_pos", "n", "seeds", "a0", "a", "b0", "b"))):
                    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                    here, other = [p - a0 for p in pos], [q - b0 for q in there]
                    if reach > REACH:
                        u, v, *cut = denser(x, y, here, other, length, seeds)
                        found = [(lo + u, hi + u, lo2 + v, hi2 + v, *rest) for lo, hi, lo2, hi2, *rest in align(*cut)]
                    else:
                        found = align(x, y, here, other, length, seeds)
                    found = [z for z in found if z[1] - z[0] >= MIN_PIECE]
                    more = [a0 > 0, b0 > 0, a0 + len(x) == pos[-1] + length[-1] + reach, b0 + len(y) == there[-1] + length[-1] + reach]
                    if any(more[0] and lo < NEAR or more[1] and lo2 < NEAR or more[2] and len(x) - hi < NEAR or more[3] and len(y) - hi2 < NEAR for lo, hi, lo2, hi2, _, _ in found):
                        out.append((chain, *[None] * 8))
                    else:
                        out += [(chain, node, hub, a0 + lo, a0 + hi, b0 + lo2, b0 + hi2, equal, of) for lo, hi, lo2, hi2, equal, of in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(9)], ["chain", "node", "hub", "start", "end", "hub_start", "hub_end", "n_equal", "n_seeds"])

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_equal: float = MIN_EQUAL) -> DataFrame:
    """doc_id, start, end, source_doc, source_start, source_end, n_equal, n_seeds, passage_words, kind for the passages of docs (doc_id, text) that stand in another text or earlier in their own too.

    Positions count words (split at space and \\x09-\\x0D, A-Z lower-cased), ends are
    exclusive. kind is `passage`, `within` for one whose source is the text itself, or
    `copy` for a whole text that equals that of the smaller doc_id source_doc; passages
    are given for one document of each class of equal texts. Every occurrence has a row
    but the first. A passage may consist of pieces with different sources;
    passage_words is its length, at least min_words. Which earlier occurrence is named as
    source may depend on how rows are dealt over tasks. Null and empty texts and rows with a null
    doc_id have none; rows that repeat a doc_id with the same text count once, and each
    text of a doc_id that has several is searched by itself, as if it came after the others."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    prints = stored(arrow_map(docs, _fingerprints(False), "doc_id long, n_words long, f1 long, f2 long").where("n_words > 0").distinct(), "prints")
    key = ["f1", "f2", "n_words"]
    classes = prints.groupBy(*key).agg(F.min("doc_id").alias("node"), F.count("*").alias("size"))
    several = stored(prints.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    copied = stored(prints.join(classes.where("size > 1"), key).where("doc_id <> node").select("doc_id", "node", "n_words"), "copies")
    heads = docs.join(small(copied.select("doc_id").distinct()), "doc_id", "left_anti").withColumnRenamed("doc_id", "node")
    names = None
    if not several.isEmpty():
        # each text of a doc_id that has several is a node of its own, numbered after all doc_ids
        least = prints.agg(F.max("doc_id")).first()[0] + 1
        own = classes.withColumnRenamed("node", "doc_id").join(small(several), "doc_id", "left_semi")
        own = stored(own.select("doc_id", *key, (F.monotonically_increasing_id() + least).alias("node")), "own")
        texts = arrow_map(docs.join(small(several), "doc_id", "left_semi"), _fingerprints(True), "doc_id long, text string, n_words long, f1 long, f2 long")
        texts = texts.join(own, ["doc_id", *key]).dropDuplicates(["node"]).select("node", "text")
        heads = stored(heads.join(small(several), F.col("node") == F.col("doc_id"), "left_anti").unionByName(texts), "heads")
        names = small(own.select("node", "doc_id"))
    seeds = heads.mapInArrow(_seeds, "seed long, node long, pos int, hub long, hub_pos int")
    # one shuffle: of the tasks' firsts of each seed, each has the one before as its hub
    before = Window.partitionBy("seed").orderBy("node", "pos")
    matches = seeds.select("node", "pos", *[F.coalesce(F.col(h), F.lag(n).over(before)).alias(h) for h, n in (("hub", "node"), ("hub_pos", "pos"))])
    matches = matches.where("node <> hub OR pos > hub_pos")
    grouped = matches.groupBy("node", "hub").agg(F.collect_list(F.struct("pos", "hub_pos")).alias("places"))
    chained = grouped.mapInArrow(_chain_batches, "node long, hub long, pos array<int>, hub_pos array<int>, n array<int>, seeds array<int>")
    chained = stored(chained.withColumn("chain", F.monotonically_increasing_id()), "chains")
    texts, aligned, reach = None, None, REACH
    while True:
        span = lambda c: (F.element_at(c, 1) - reach, F.element_at(c, -1) + F.element_at("n", -1) + reach)  # noqa: B023, E731
        sides = [chained.select("chain", F.lit(k).alias("side"), F.col(n).alias("node"), *[x.alias(c) for x, c in zip(span(at), ("lo", "hi"))]) for k, (n, at) in enumerate((("node", "pos"), ("hub", "hub_pos")))]
        wanted = stored(sides[0].select("node").union(sides[1].select("node")).distinct(), "wanted")
        texts = stored((heads if texts is None else texts).join(small(wanted), "node", "left_semi").dropDuplicates(["node"]), "texts")
        a, b = (
            arrow_map(ask.join(texts, "node"), _cut, "chain long, side int, start int, words binary").select("chain", F.col("start").alias(f"{c}0"), F.col("words").alias(c))
            for ask, c in zip(sides, "ab")
        )
        both = chained.join(a, "chain").join(b, "chain")
        schema = "chain long, node long, hub long, start long, `end` long, hub_start long, hub_end long, n_equal long, n_seeds long"
        new = stored(both.select("chain", "node", "hub", "pos", "hub_pos", "n", "seeds", "a0", "a", "b0", "b").mapInArrow(_align_batches(reach), schema), "aligned")
        done = new.where("node IS NOT NULL").drop("chain")
        aligned = done if aligned is None else aligned.unionByName(done)
        left = new.where("node IS NULL").select("chain")
        if left.isEmpty():
            break
        # the few chains that grow on get more words, in the end whole texts
        chained, reach = stored(chained.join(small(left), "chain", "left_semi"), "chains"), reach * FURTHER
    pieces = aligned.where((F.col("end") - F.col("start") >= MIN_PIECE) & (F.col("n_equal") >= min_equal * F.greatest(F.col("end") - F.col("start"), F.col("hub_end") - F.col("hub_start"))))
    # pieces that touch are one passage
    by = Window.partitionBy("node").orderBy("start", "end", "hub", "hub_start")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    marked = pieces.withColumn("gap", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1)) + 2).cast("int"))
    island = marked.withColumn("island", F.sum("gap").over(by))
    whole = Window.partitionBy("node", "island")
    passages = island.withColumn("passage_words", F.max("end").over(whole) - F.min("start").over(whole)).where(F.col("passage_words") >= min_words)
    rows = passages.select(
        F.col("node").alias("doc_id"), "start", "end", F.col("hub").alias("source_doc"), F.col("hub_start").alias("source_start"), F.col("hub_end").alias("source_end"),
        "n_equal", "n_seeds", "passage_words", F.when(F.col("node") == F.col("hub"), "within").otherwise("passage").alias("kind"),
    )
    columns = rows.columns
    if names is not None:
        for c in ("doc_id", "source_doc"):
            rows = rows.join(names.select(F.col("node").alias(c), F.col("doc_id").alias("_name")), c, "left").withColumn(c, F.coalesce("_name", c)).drop("_name")
        rows = rows.select(*columns)
    zero = F.lit(0).cast("long")
    copies = copied.where(F.col("n_words") >= min_words).select(
        "doc_id", zero.alias("start"), F.col("n_words").alias("end"), F.col("node").alias("source_doc"), zero.alias("source_start"), F.col("n_words").alias("source_end"),
        F.col("n_words").alias("n_equal"), zero.alias("n_seeds"), F.col("n_words").alias("passage_words"), F.lit("copy").alias("kind"),
    )
    return rows.unionByName(copies)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
