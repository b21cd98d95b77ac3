"""SentencePiece encoding and decoding, with sampled segmentations.

``Sampler`` draws k distinct segmentations of a text without replacement: Gumbel top-k over the lattice of all segmentations,
by a perturbed A-star search.  A segmentation's perturbed log-probability is Gumbel noise about its log-probability; the
search holds regions (a prefix of a segmentation and the edges that may not follow it) with the maximum of their noise,
takes the best region, samples the segmentation that attains it, and splits what is left of the region at each of its edges
into regions with truncated Gumbel maxima.  So the k largest come out in order, exactly, and the maximum of all regions left
is the threshold from which a segmentation's inclusion score 1 - exp(-exp(log p - threshold)) follows.  Noise is seeded by
the row's key, so reruns agree.

Pieces never cross a white space, so a text's lattice is a chain of small ones, one for each unit (blanks and what follows
them).  New units of a batch are laid out together with numpy; about ``Bounds.nodes`` nodes are kept.

The model file has no probabilities (its scores are merge ranks), so a piece of rank r has log-weight -log(r + RANK), and a
character without a piece falls back to its bytes at the weight of the rarest piece each.  A segmentation's probability is
its share of the lattice.

Null and empty texts have one empty segmentation of probability 1.  Texts with fewer than k segmentations give all of them;
their inclusion score is 1.  Repeated rows give equal samples, and rows without an id are sampled by their text alone.  A literal U+2581
decodes to a blank, as in the library.  Very long texts are sampled unit by unit, in bounded memory.  An empty table gives no rows.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import small_batches, table

SPACE = "▁"
UNITS = re.compile(f"{SPACE}+[^{SPACE}]*")
RANK = 10.0


#: The splitmix64 generator.
GAMMA, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scrambled(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * MIX_1
    z = (z ^ (z >> np.uint64(27))) * MIX_2
    return z ^ (z >> np.uint64(31))


def uniform(z: np.ndarray) -> np.ndarray:
    """In [0, 1), one for each 64-bit state: noise depends on the row's key and the place alone, not on what shares a batch."""
    return (scrambled(z) >> np.uint64(11)) * (1.0 / (1 << 53))


class Table:
    """Numbers of 63-bit keys, by open addressing; a third full at most."""

    def __init__(self, slots: int):
        self._empty(slots)

    def _empty(self, slots: int) -> None:
        self.n, self.shift = 0, np.uint64(64 - (slots - 1).bit_length())
        self.keys, self.values = np.full(slots, -1, dtype=np.int64), np.full(slots, -1, dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * GAMMA) >> self.shift).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        if 3 * (self.n + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate((self.keys[old], keys)), np.concatenate((self.values[old], values))
            self._empty(1 << (4 * len(keys)).bit_length())
        self.n += len(keys)
        slot = self._slot(keys)
        while len(keys):
            while (taken := np.flatnonzero(self.keys[slot] >= 0)).size:
                slot[taken] = (slot[taken] + 1) & (len(self.keys) - 1)
            self.keys[slot] = keys  # of several keys for a slot one stays
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], slot[~won]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1: not there."""
        slot = self._slot(keys)
        met = self.keys[slot]
        hit = met == keys
        out = np.where(hit, self.values[slot], -1)
        on = np.flatnonzero(~hit & (met >= 0))
        keys, slot = keys[on], slot[on]
        while len(on):
            slot = (slot + 1) & (len(self.keys) - 1)
            met = self.keys[slot]
            hit = met == keys
            out[on] = np.where(hit, self.values[slot], -1)
            go = ~hit & (met >= 0)
            on, keys, slot = on[go], keys[go], slot[go]
        return out


class Model:
    """Pieces, log-weights and the transitions of their prefix tree."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_id = np.zeros(256, dtype=np.int64)
        known: dict[str, tuple[int, float]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                score = sp.get_score(i)
                known[piece] = (i, -np.log((-score if score > -1e8 else i) + RANK))
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.byte_weight = -np.log(n + RANK)
        states, step = {"": 0}, {}
        for piece in known:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in states:
                    states[piece[:k]] = len(states)
                    step[(states[piece[: k - 1]] << 21) | ord(piece[k - 1])] = states[piece[:k]]
        self.steps = Table(1 << 12)
        self.steps.put(np.array(list(step), dtype=np.int64), np.array(list(step.values()), dtype=np.int32))
        self.byte_sizes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.byte_begins = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.byte_pool = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.piece = np.full(len(states), -1, dtype=np.int64)
        self.weight = np.zeros(len(states))
        for piece, (i, w) in known.items():
            self.piece[states[piece]], self.weight[states[piece]] = i, w

    def advance(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next states; -1: no piece continues so."""
        return self.steps.find((state.astype(np.int64) << 21) | char)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The library's one best segmentation."""
        return self.library.encode(texts, num_threads=1)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of some ids, laid end to end."""
        size = self.byte_sizes[ids]
        ends = np.cumsum(size)
        return self.byte_pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.byte_begins[ids] - ends + size, size)]

    def decode(self, ids) -> str:
        """The text of some ids, as the library decodes them."""
        out = b"".join(map(self.bytes_of.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def units_of(text: str) -> list[str]:
    """Blanks, the one before the text among them, and what follows them; a plain text's words, which stand for themselves and a blank."""
    if not text:
        return []
    if "  " not in text and text[0] != " " and SPACE not in text:
        return text.split(" ")
    return UNITS.findall(SPACE + text.replace(" ", SPACE))


class Grown:
    """An array that grows."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 16, dtype=kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate((self.data, np.zeros(max(len(self.data) // 4, len(values)), dtype=self.data.dtype)))
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... size[0] of them, then those of the others."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)


class Units(dict):
    """Numbers units as they are first asked for; `fresh` lists those without a lattice yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = code = len(self)
        self.fresh.append(unit)
        return code


class Lattices:
    """The lattices of units met so far, in flat arrays.

    What may follow a place in a unit depends on the rest of the unit alone, so a node is such a rest, and units that end alike
    share nodes; a rest is known by a 63-bit hash.  Edges of a node lie together, longest first; `edge_upto` is the share of
    the edges up to here.  Shares and log-probabilities are kept in single precision; segmentations sum them in double.
    """

    def __init__(self, model: Model, remember: int, add_chars: int):
        self.model, self.remember, self.add_chars = model, remember, add_chars
        self.clear()

    def clear(self) -> None:
        self.codes = Units()
        self.rests = Table(1 << 18)
        self.code_start = Grown(np.int32)  # first node of each unit
        self.edge_upto, self.edge_log, self.edge_log_rest = Grown(np.float32), Grown(np.float32), Grown(np.float32)
        self.edge_from, self.edge_piece = Grown(np.int32), Grown(np.int16 if len(self.model.bytes_of) < 1 << 15 else np.int32)
        self.edge_to = Grown(np.int32)  # node; -1: the end of the unit
        self.first_edge, self.n_edges = Grown(np.int32), Grown(np.int16)  # of each node
        self.node_char, self.beta = Grown(np.int32), Grown(np.float64)  # beta: log-sum over the ways to the end

    @property
    def nodes(self) -> int:
        return self.first_edge.n

    def add(self, units: list[str], sizes: np.ndarray) -> None:
        """Lattices of units that are not there yet; sizes: their characters.  Words of plain texts come without the blank before them."""
        m, base, edges = self.model, self.nodes, self.edge_upto.n
        joined = SPACE + SPACE.join(units)
        if joined.count(SPACE) == len(units):
            sizes = sizes + 1
        else:
            units = [u if u[:1] == SPACE else SPACE + u for u in units]
            joined, sizes = "".join(units), np.array([len(u) for u in units], dtype=np.int64)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        left = ends - np.arange(len(chars))
        order = np.argsort(left.astype(np.int16) if left.max() < 1 << 15 else left, kind="stable")
        stops = np.append(np.flatnonzero(np.diff(left[order])) + 1, len(chars))
        # a hash of the rest at each place, from the units' ends on
        rest = np.zeros(len(chars) + 1, dtype=np.uint64)
        spread = chars.astype(np.uint64) * MIX_2
        low = 0
        for high in stops.tolist():
            at = order[low:high]
            rest[at] = scrambled((rest[at + 1] if low else GAMMA) ^ spread[at])
            low = high
        rest = (rest[:-1] >> np.uint64(1)).view(np.int64)
        node = self.rests.find(rest)
        fresh = order[node[order] < 0]  # shorter rests first
        fresh = fresh[np.sort(np.unique(rest[fresh], return_index=True)[1])]
        n = len(fresh)
        self.rests.put(rest[fresh], np.arange(base, base + n, dtype=np.int32))
        unknown = np.flatnonzero(node < 0)
        node[unknown] = self.rests.find(rest[unknown])
        self.code_start.extend(node[np.cumsum(sizes) - sizes])
        if not n:
            return
        found = []  # (new node, place among its edges from the shortest on, node that follows, piece, weight)
        seen = np.zeros(n, dtype=np.int64)
        of, at, state, k, close = np.arange(n), fresh, np.zeros(n, dtype=np.int64), 0, ends[fresh]
        while len(of):
            state = m.advance(state, chars[at])
            ok = state >= 0
            of, at, state, close = of[ok], at[ok] + 1, state[ok], close[ok]
            k += 1
            last = at == close
            piece = m.piece[state]
            hit = piece >= 0
            own, stop, next_at = of[hit], last[hit], at[hit]
            next_at[stop] = 0
            found.append((own, seen[own], np.where(stop, -1, node[next_at]), piece[hit], m.weight[state[hit]]))
            seen[own] += 1
            if k == 1:
                lone = np.flatnonzero(seen == 0)
                c, follows = chars[fresh[lone]], fresh[lone] + 1
                stop = follows == ends[fresh[lone]]
                follows[stop] = 0
                width = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
                found.append((lone, seen[lone], np.where(stop, -1, node[follows]), np.full(len(lone), -1), m.byte_weight * width))
                seen[lone] = 1
            go = ~last
            of, at, state, close = of[go], at[go], state[go], close[go]
        count = seen
        first = np.cumsum(count) - count
        shortest = first + count - 1
        total = int(count.sum())
        to, piece, weight = np.empty(total, dtype=np.int64), np.empty(total, dtype=np.int32), np.empty(total)
        for own, place, follows, hit, w in found:
            put = shortest[own] - place
            to[put], piece[put], weight[put] = follows, hit, w
        self.beta.extend(np.zeros(n))
        beta = self.beta.data
        sums = np.empty(total)
        low = 0
        for high in np.append(np.flatnonzero(np.diff(left[fresh])) + 1, n).tolist():
            a, b = int(first[low]), int(first[high - 1] + count[high - 1])
            t = weight[a:b] + np.where(to[a:b] < 0, 0.0, beta[to[a:b]])
            new = first[low:high] - a
            top = np.maximum.reduceat(t, new)
            beta[base + low : base + high] = top + np.log(np.add.reduceat(np.exp(t - np.repeat(top, count[low:high])), new))
            sums[a:b] = t
            low = high
        log = np.minimum(sums - np.repeat(beta[base : base + n], count), 0.0)
        share = np.exp(log)
        run = share.copy()  # summed node by node, so that a unit's shares do not depend on what is laid out with it
        at, many, k = first[count > 1], count[count > 1], 1
        while len(at):
            run[at + k] += run[at + k - 1]
            k += 1
            at, many = at[many > k], many[many > k]
        others = np.repeat(np.add.reduceat(share, first), count) - share
        big = np.flatnonzero(share > 0.5)
        others[big] = -np.expm1(log[big])
        np.maximum(others, 1e-300, out=others)
        others[first[count == 1]] = 0.0
        run[shortest] = np.inf
        self.edge_upto.extend(run)
        self.edge_log.extend(log)
        with np.errstate(divide="ignore"):
            self.edge_log_rest.extend(np.log(others))
        self.edge_from.extend(np.repeat(np.arange(base, base + n), count))
        self.edge_to.extend(to)
        self.edge_piece.extend(piece)
        self.first_edge.extend(first + edges)
        self.n_edges.extend(count)
        self.node_char.extend(chars[fresh])

    def starts(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The first node of each unit of each text."""
        if self.nodes > self.remember:
            self.clear()
        get = self.codes.__getitem__
        coded = [np.fromiter(map(get, t), dtype=np.int64, count=len(t)) for t in texts]
        fresh, self.codes.fresh = self.codes.fresh, []
        sizes = np.fromiter(map(len, fresh), dtype=np.int64, count=len(fresh))
        upto = np.cumsum(sizes + 1)
        at = 0
        while at < len(fresh):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + self.add_chars, side="right")))
            self.add(fresh[at:to], sizes[at:to])
            at = to
        return [self.code_start.data[c] for c in coded]

    def walk(self, nodes: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples a way to the end of its unit from each node: edges in order of nodes, and how many are each node's.  noise: a 64-bit state of each."""
        upto, to, first = self.edge_upto.data, self.edge_to.data, self.first_edge.data
        found = []
        who, length = np.arange(len(nodes)), np.zeros(len(nodes), dtype=np.int64)
        while len(nodes):
            noise = noise + GAMMA
            r, e = uniform(noise), first[nodes]
            on = (r >= upto[e]).nonzero()[0]
            while len(on):
                own = e[on] + 1
                e[on] = own
                on = on[r[on] >= upto[own]]
            found.append((who, e))
            length[who] += 1
            nodes = to[e]
            going = (nodes >= 0).nonzero()[0]
            nodes, who, noise = nodes[going], who[going], noise[going]
        at = np.cumsum(length) - length
        edges = np.empty(int(length.sum()), dtype=np.int64)
        for k, (who, e) in enumerate(found):
            edges[at[who] + k] = e
        return edges, length

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of some edges in order, and how many are each edge's; a fallback edge becomes the bytes of its character."""
        out, count = self.edge_piece.data[edges].astype(np.int64), np.ones(len(edges), dtype=np.int64)
        lone = np.flatnonzero(out < 0)
        if not len(lone):
            return out, count
        char = self.node_char.data[self.edge_from.data[edges[lone]]].astype(np.int64)
        known, which = np.unique(char, return_inverse=True)
        spelled = [chr(c).encode("utf-8", "replace") for c in known.tolist()]
        size = np.array([len(b) for b in spelled], dtype=np.int64)
        pool = self.model.byte_id[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
        count[lone] = size[which]
        out = np.repeat(out, count)
        at = np.cumsum(count) - count
        out[runs(at[lone], size[which])] = pool[runs((np.cumsum(size) - size)[which], size[which])]
        return out, count


def _counted(seeds: list[int], sizes: np.ndarray, step: np.uint64) -> np.ndarray:
    """seeds[0] + step, seeds[0] + 2 step, ... sizes[0] of them, then those of the others."""
    ends = np.cumsum(sizes)
    within = np.arange(1, (ends[-1] if len(ends) else 0) + 1) - np.repeat(ends - sizes, sizes)
    return np.repeat(np.array(seeds, dtype=np.uint64), sizes) + within.astype(np.uint64) * step


class Search:
    """What is known of one text: its regions (maximum, segmentation whose prefix it keeps, its length, edges left out) and samples."""

    def __init__(self, starts: np.ndarray, seed: int):
        self.starts, self.seed = starts, seed
        top = -np.log(-np.log(max(float(uniform(np.array([seed], dtype=np.uint64))[0]), 1e-300)))
        self.regions: list[tuple] = [(float(top), None, 0, ())]
        self.out: list[tuple] = []


class Sampler:
    def __init__(self, path: str, k: int, seed: int = 0, bounds: Bounds | None = None):
        self.model, self.k, self.seed = Model(path), k, seed
        self.lattices = Lattices(self.model, (bounds or FULL).nodes, (bounds or FULL).add_chars)

    def sample(self, starts: list[np.ndarray], keys: list[bytes]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k of (edges, log-probability, perturbed, inclusion score), best first.  Texts advance together, a sample a round."""
        searches = [Search(s, xxhash.xxh64_intdigest(key, self.seed & 0xFFFFFFFF)) for s, key in zip(starts, keys)]
        for s in searches:
            if not len(s.starts):
                s.out, s.regions = [(np.empty(0, np.int64), 0.0, s.regions[0][0])], []
        for turn in range(1, self.k + 1):
            live = [s for s in searches if s.regions and len(s.out) < self.k]
            if not live:
                break
            self._round(live, turn)
        results = []
        for s in searches:
            left = max((r[0] for r in s.regions), default=-np.inf)
            results.append([(e, lp, g, 1.0 if left == -np.inf else float(-np.expm1(-np.exp(min(lp - left, 50.0))))) for e, lp, g in s.out])
        return results

    def _round(self, live: list[Search], turn: int) -> None:
        """Takes each text's best region, samples the segmentation that attains its maximum, and splits the rest of the region."""
        lat = self.lattices
        picked, nodes, seeds = [], [], []
        for s in live:
            best = max(range(len(s.regions)), key=lambda i: s.regions[i][0])
            g, parent, t, barred = s.regions.pop(best)
            seed = (s.seed + turn * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF
            if parent is None:
                head, head_unit, rest, unit = None, None, s.starts, 0
            else:
                head, head_unit, rest, unit = self._branch(s, parent, t, barred, np.uint64(seed))
            picked.append((s, g, t, barred, head, head_unit, unit))
            nodes.append(rest)
            seeds.append(seed)
        sizes = np.array([len(x) for x in nodes])
        edges, length = lat.walk(np.concatenate(nodes), scrambled(_counted(seeds, sizes, MIX_2)))
        ends = np.append(0, np.cumsum(length))[np.cumsum(sizes)]
        place = np.repeat(np.arange(len(length)), length) if turn < self.k else np.empty(len(edges), dtype=np.int64)  # no region is split after the last sample
        first = np.cumsum(sizes) - sizes
        ways, tails = [], []
        for (s, g, t, barred, head, head_unit, unit), a, b, at in zip(picked, [0, *ends[:-1].tolist()], ends.tolist(), first.tolist()):
            own, units = edges[a:b], place[a:b] - (at - unit)
            if head is not None:
                own, units = np.concatenate((head, own)), np.concatenate((head_unit, units))
            ways.append((own, units))
            tails.append(own[t:])
        # what is left: at each place from t on, another edge than this one's
        many = np.array([len(x) for x in tails])
        rests = lat.edge_log_rest.data[np.concatenate(tails)].astype(np.float64)
        lows = _counted([((s.seed ^ 0xA0761D6478BD642F) + turn) & 0xFFFFFFFFFFFFFFFF for s, *_ in picked], many, GAMMA)
        lows = -np.log(-np.log1p(-uniform(lows)))
        stop = np.cumsum(many).tolist()
        for (s, g, t, barred, *_), (own, units), a, b in zip(picked, ways, [0, *stop[:-1]], stop):
            before = np.cumsum(lat.edge_log.data[own], dtype=np.float64)
            s.out.append((own, float(before[-1]), g))
            wanted = min(b - a, self.k - len(s.out) + 1)
            rest = rests[a:b]
            if barred:
                gone = [*barred, int(own[t])]
                share = 1.0 - np.exp(lat.edge_log.data[gone].astype(np.float64)).sum()
                rest[0] = np.log(max(share, 1e-300)) if lat.n_edges.data[lat.edge_from.data[gone[0]]] > len(gone) else -np.inf
            phi = rest + lows[a:b]
            phi[1:] += before[t:-1]
            if t:
                phi[0] += before[t - 1]
            for i in [int(phi.argmax())] if wanted == 1 else np.argpartition(-phi, wanted - 1)[:wanted].tolist():
                if phi[i] > -np.inf:
                    bars = (*barred, int(own[t])) if i == 0 else (int(own[t + i]),)
                    s.regions.append((float(-np.logaddexp(-g, -phi[i])), (own, units), t + i, bars))

    def _branch(self, s: Search, parent: tuple, t: int, barred: tuple, seed: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The parent's first t edges and one that is not barred; their units; the nodes that go on freely; the first one's unit."""
        lat = self.lattices
        edges, unit = parent
        node = int(lat.edge_from.data[barred[0]])
        first = int(lat.first_edge.data[node])
        free = np.array([e for e in range(first, first + int(lat.n_edges.data[node])) if e not in barred], dtype=np.int64)
        p = np.exp(lat.edge_log.data[free].astype(np.float64))
        p = p / p.sum() if p.sum() > 0 else np.full(len(free), 1 / len(free))
        r = uniform(np.array([seed], dtype=np.uint64))[0]
        e = int(free[min(np.searchsorted(np.cumsum(p), r, side="right"), len(free) - 1)])
        u, to = int(unit[t]), int(lat.edge_to.data[e])
        rest = np.append(to, s.starts[u + 1 :]) if to >= 0 else s.starts[u + 1 :]
        return np.append(edges[:t], e), np.append(unit[:t], u), rest, u + (to < 0)


@lru_cache(maxsize=2)
def sampler(path: str, k: int, seed: int, bounds: Bounds) -> Sampler:
    """One for a Python worker, over all of its tasks."""
    return Sampler(path, k, seed, bounds)


def _key(doc_id: int | None) -> bytes:
    return b"null" if doc_id is None else str(doc_id).encode()


OUT = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("n_tokens", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("decodes", pa.bool_()), ("ids", pa.list_(pa.int32()))])
OUT_DDL = "doc_id long, sample int, n_tokens long, log_prob double, perturbed double, inclusion double, decodes boolean, ids array<int>"


@dataclass(frozen=True)
class Bounds:
    """Nodes of lattices that a worker remembers; characters whose lattices are laid out together; texts and characters that are sampled together
    (a longer text or unit alone); whether lattices are kept from task to task."""

    nodes: int
    add_chars: int
    texts: int
    chars: int
    kept: bool


#: LEAN costs some CPU and saves memory.
FULL, LEAN = Bounds(1_000_000, 120_000, 250, 1 << 20, True), Bounds(250_000, 40_000, 60, 1 << 19, False)


def _together(batches: Iterator[pa.RecordBatch], bounds: Bounds) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of rows that are sampled together."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for b in batches:
        for at in range(0, b.num_rows, bounds.texts):
            part = b.slice(at, bounds.texts)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(text or "")
                size += len(texts[-1])
                if len(ids) >= bounds.texts or size >= bounds.chars:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _spelled_texts(model: Model, ids: np.ndarray, sizes: np.ndarray, texts: list[str]) -> np.ndarray:
    """Whether each sample's ids (sizes: how many) decode to its text: their bytes, but for the blank before the text, are the text's."""
    whole = [b" " + t.replace(SPACE, " ").encode("utf-8", "replace") if t else b"" for t in texts]
    stop = np.append(0, np.cumsum(model.byte_sizes[ids]))[np.cumsum(sizes)]
    spelled, want = model.spelled(ids), np.frombuffer(b"".join(whole), dtype=np.uint8)
    size = np.array([len(w) for w in whole], dtype=np.int64)
    own = np.diff(stop, prepend=0)
    if (own == size).all() and len(spelled) == len(want):
        wrong = np.append(0, np.cumsum(spelled != want))
        return wrong[stop] == wrong[stop - own]
    return np.array([spelled[e - n : e].tobytes() == w for e, n, w in zip(stop.tolist(), own.tolist(), whole)], dtype=bool)


def _sampler(path: str, k: int, seed: int, lean: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = LEAN if lean else FULL
        s = sampler(path, k, seed, bounds)
        for doc_ids, texts in _together(batches, bounds):
            found = s.sample(s.lattices.starts([units_of(t) for t in texts]), [_key(i) for i in doc_ids])
            flat = [x for f in found for x in f]
            many = [len(f) for f in found]
            ids, count = s.lattices.ids(np.concatenate([x[0] for x in flat]))
            stop = np.append(0, np.cumsum(count))[np.cumsum([len(x[0]) for x in flat])]
            sizes = np.diff(stop, prepend=0)
            ok = _spelled_texts(s.model, ids, sizes, [t for t, n in zip(texts, many) for _ in range(n)])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, stop), pa.int32()), pa.array(ids.astype(np.int32)))
            cols = ([i for i, n in zip(doc_ids, many) for _ in range(n)], [r for n in many for r in range(1, n + 1)], sizes, *([x[j] for x in flat] for j in (1, 2, 3)), ok)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, OUT)), lists], schema=OUT)
        if not bounds.kept:
            s.lattices.clear()

    return run


def sampled(docs: DataFrame, path: str, k: int = 2, seed: int = 0, lean: bool = False) -> DataFrame:
    """docs (doc_id, text) -> a row for each sampled segmentation: its place, log-probability, inclusion score, ids, and whether they decode to the text.

    lean: remembers less, for executors that share their memory with other stages; the samples are the same.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sampler(path, k, seed, lean), OUT_DDL)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, ids): the library's one best segmentation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(path)
        for b in batches:
            ids = m.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """rows (doc_id, ids) -> (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    small_batches(rows.sparkSession)
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sampled(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
