"""The N best segmentations of texts into the pieces of a SentencePiece model.

A text is normalised by the model and cut into units wherever no piece holds both characters beside the cut, before nearly
every ``▁`` for one: segmentations of units are independent.

Within a unit a forward Viterbi pass gives the best score up to each position.  A backward A* search from the end takes
these as its heuristic; they are exact, so paths come out best first.  A position is left at most N times, as further
ways behind it could only follow those, so the search takes N steps a position however many paths are equally good.  The
forward pass of all new units of a batch is one pass of array operations over a trie of pieces.

A text's N best follow from its units': the best one, and exchanges in the N-1 units that lose least.

Scores are whole numbers (the model's, times ``SCALE`` where they have fractions), so equal ones are equal.  Ties
within a unit go by the ids read from its end, ties within a text by the units' ranks read from its start.

The pieces of single bytes stand for characters without a piece, at ``BYTE_PENALTY`` below the lowest score each.
"""

from __future__ import annotations

import heapq
import itertools
import math
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from corpus_audit.llm.common import text_batches, worker_cache

N_BEST = 4
SCALE = 1 << 16
BYTE_PENALTY = 10
CACHED_BYTES = 64 << 20  # of known units, in each of two generations
SEARCHED_UNITS = 10_000  # whose N best are kept
UNIT_BYTES = 350  # that a known unit takes besides its letters and ids
ROWS_AT_ONCE = 256  # their segmentations are held together
LONG_KEY = 64  # longer units are known for one batch alone, and passed one by one
GAP = "▁"
NONE = -(1 << 62)  # the score of no path

Known = tuple[bytes, int, float]  # ids and score of the best path, what the second best loses


class _Way:
    """A path from the end of a part back to ``end``, in a tree of such paths.

    Ordered by what its best completion loses, then by its ids read from the end of the part: two paths differ first
    below their last common one, which is found over ``jump`` links in a logarithmic number of steps."""

    __slots__ = ("lost", "end", "behind", "last", "ids", "parent", "jump", "depth")

    def __init__(self, lost: int, end: int, behind: int, last: int, ids: tuple[int, ...], parent: _Way | None):
        self.lost, self.end, self.behind, self.last, self.ids = lost, end, behind, last, ids
        self.parent = parent or self
        self.depth = parent.depth + 1 if parent else 0
        self.jump = self
        if parent:
            far = parent.jump
            self.jump = far.jump if parent.depth - far.depth == far.depth - far.jump.depth and parent.depth else parent

    def __lt__(self, other: _Way) -> bool:
        if self.lost != other.lost:
            return self.lost < other.lost
        a, b = self, other
        while a.depth > b.depth:
            a = a.jump if a.jump.depth >= b.depth else a.parent
        while b.depth > a.depth:
            b = b.jump if b.jump.depth >= a.depth else b.parent
        if a is b:
            return self.depth < other.depth
        while a.parent is not b.parent:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.parent, b.parent)
        return a.last < b.last


class _Trie:
    """The pieces as arrays: ``child`` of a node and a letter, and each node's piece and score."""

    def __init__(self, table: dict[str, tuple[int, int]]):
        letters = sorted({c for piece in table for c in piece})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        number, keys, ends = {c: k for k, c in enumerate(letters, 1)}, {}, {}
        for piece, (i, score) in table.items():
            node = 0
            for c in piece:
                node = keys.setdefault(node * self.width + number[c], len(keys) + 1)
            ends[node] = (i, score)
        # The keys in an open hash table: a look-up is one or two gathers.
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.nodes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        order = sorted(keys)
        for key, at in zip(order, self._slot(np.array(order, np.int64)).tolist()):
            while self.keys[at] >= 0:
                at = at + 1 & self.mask
            self.keys[at], self.nodes[at] = key, keys[key]
        self.first = np.zeros(self.width, np.int32)
        top = [k for k in order if k < self.width]
        self.first[top] = [keys[k] for k in top]
        self.piece, self.score = np.full(len(keys) + 1, -1, np.int32), np.zeros(len(keys) + 1, np.int64)
        for node, (i, score) in ends.items():
            self.piece[node], self.score[node] = i, score

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def child(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """0 where there is none."""
        key = node.astype(np.int64) * self.width + code
        at = self._slot(key)
        found = self.keys[at]
        out = np.where((found == key) & (code > 0), self.nodes[at], 0)
        open_ = np.flatnonzero((found != key) & (found >= 0) & (code > 0))
        while len(open_):
            at[open_] = at[open_] + 1 & self.mask
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.nodes[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class PieceLattice:
    """A model's pieces, and the N best paths through the lattice of a text."""

    def __init__(self, model_file: str, n_best: int = N_BEST, cached: int = CACHED_BYTES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.n_best = n_best
        ids = range(self.model.get_piece_size())
        plain = [i for i in ids if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        scores = {i: self.model.get_score(i) for i in plain}
        self.scale = 1 if all(s == int(s) for s in scores.values()) else SCALE
        self.pieces = [self.model.id_to_piece(i) for i in ids]
        self.table = {self.pieces[i]: (i, round(scores[i] * self.scale)) for i in plain}
        self.trie = _Trie(self.table)
        # Every ending of a piece is a key, so that a search which looks back stops where no piece goes on.
        self.endings: dict[str, tuple[tuple[int, ...], int] | tuple[()]] = {}
        for i in plain:
            piece = self.pieces[i]
            for k in range(1, len(piece)):
                self.endings.setdefault(piece[k:], ())
            self.endings[piece] = ((i,), self.table[piece][1])
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in ids if self.model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i in ids if self.model.is_unknown(i)), 0)
        self.penalty = (min((s for _, s in self.table.values()), default=0)) - BYTE_PENALTY * self.scale
        width, code = self.trie.width, self.trie.code
        pairs = {self.pieces[i][k : k + 2] for i in plain for k in range(len(self.pieces[i]) - 1)}
        # One bit for every two letters: whether a piece holds them side by side.  Letter 0 is none of any piece.
        self.pairs = np.zeros(width * width // 8 + 1, np.uint8)
        keys = np.array([int(code[ord(a)]) * width + int(code[ord(b)]) for a, b in pairs], np.int64)
        np.bitwise_or.at(self.pairs, keys >> 3, np.left_shift(1, keys & 7).astype(np.uint8))
        self.multi: dict[str, list[tuple[int, tuple[int, ...]]]] = {}  # paths of short units that were searched lately
        self.high_bytes = np.array([self.byte_of.get(i, 0) >= 128 for i in ids])
        self.shown = np.array([chr(self.byte_of[i]) if i in self.byte_of else piece for i, piece in enumerate(self.pieces)], object)
        self.cached, self.held = cached, 0
        self.young: dict[str, Known] = {}
        self.old: dict[str, Known] = {}

    # One unit

    def _unknown(self, char: str) -> tuple[int, tuple[int, ...]]:
        data = char.encode("utf-8", "surrogatepass")
        ids = tuple(self.bytes[b] for b in data) if all(b in self.bytes for b in data) else (self.unknown,)
        return self.penalty * len(ids), ids

    def _into(self, part: str, end: int) -> list[tuple[int, int, int, tuple[int, ...]]]:
        """Start, score, last id and ids of the pieces that end at a position."""
        endings, out = self.endings, []
        for start in range(end - 1, -1, -1):
            found = endings.get(part[start:end])
            if found is None:
                break
            if found:
                ids, score = found
                out.append((start, score, ids[0], ids))
        if not endings.get(part[end - 1]):
            score, ids = self._unknown(part[end - 1])
            out.append((end - 1, score, ids[-1], ids))
        return out

    def paths(self, part: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """Score and ids of the ``n`` best paths (fewer if there are no more), best first: A* from the end over the scores
        of a forward Viterbi pass."""
        into: list[list] = [[]]
        best = [0]
        for end in range(1, len(part) + 1):
            edges = self._into(part, end)
            into.append(edges)
            best.append(max([best[e[0]] + e[1] for e in edges]))
        left = [0] * len(best)
        waiting = [_Way(-best[-1], len(part), 0, 0, (), None)]
        out: list[tuple[int, tuple[int, ...]]] = []
        while waiting and len(out) < n:
            way = heapq.heappop(waiting)
            end = way.end
            if not end:
                taken, at = [], way
                while at.depth:
                    taken.append(at.ids)
                    at = at.parent
                out.append((way.behind, tuple(itertools.chain.from_iterable(taken))))
            elif left[end] < n:
                left[end] += 1
                behind = way.behind
                for start, score, last, ids in into[end]:
                    heapq.heappush(waiting, _Way(-(best[start] + score + behind), start, score + behind, last, ids, way))
        return out

    def _best_and_loss(self, units) -> Iterator[tuple[str, Known]]:
        """For each unit: ids and score of the best path, and what the second best loses (infinite if there is no
        other).  Short units are passed together; where two paths are best the ids decide, so the search is asked."""
        short = [u for u in units if 0 < len(u) <= LONG_KEY]
        found = self._forward_all(short) if short else []
        for unit, known in itertools.chain(zip(short, found), ((u, None) for u in units if not 0 < len(u) <= LONG_KEY)):
            if known is None:
                ways = self.paths(unit, 2)
                known = array("i", ways[0][1]).tobytes(), ways[0][0], ways[0][0] - ways[1][0] if len(ways) > 1 else math.inf
            yield unit, known

    def _forward_all(self, units: list[str]) -> list[Known | None]:
        """The forward Viterbi pass of many units, with the second best score beside the best; None where two paths are best
        or a character that is no piece stands beside others."""
        trie, n_units = self.trie, len(units)
        lengths = np.fromiter(map(len, units), np.int64, n_units)
        code = trie.code[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")]
        unit = np.repeat(np.arange(n_units), lengths)
        begins = np.cumsum(lengths) - lengths
        offset = np.arange(len(code)) - begins[unit]
        # A path's place is its unit and how many letters it has; the places of a length stand together.
        odd = np.zeros(n_units, bool)
        starts, stops, scores, pieces, owners = [], [], [], [], []
        at, node, size = np.arange(len(code)), trie.first[code], 1
        while len(at):
            piece = trie.piece[node]
            if size == 1:
                odd[unit[piece < 0]] = True
            hit = piece >= 0
            whose = unit[at[hit]]
            owners.append(whose)
            starts.append(offset[at[hit]])
            stops.append(starts[-1] + size)
            scores.append(trie.score[node[hit]])
            pieces.append(piece[hit])
            on = (node > 0) & (offset[at] + size < lengths[unit[at]])
            at = at[on]
            node = trie.child(node[on], code[at + size])
            at, node, size = at[node > 0], node[node > 0], size + 1
        start, stop, score, piece, owner = map(np.concatenate, (starts, stops, scores, pieces, owners))
        keep = ~odd[owner]
        start, stop, score, piece, owner = (x[keep] for x in (start, stop, score, piece, owner))
        order = np.argsort(stop * n_units + owner, kind="stable")
        start, stop, score, piece, owner = (x[order] for x in (start, stop, score, piece, owner))
        width = int(lengths.max()) + 1
        best, second = np.zeros((width, n_units), np.int64), np.full((width, n_units), NONE)
        back = np.zeros((width, n_units), np.int64)  # the last piece of the best path
        edges = np.searchsorted(stop, np.arange(1, width + 1))
        for k in range(1, width):
            a, z = edges[k - 1], edges[k]
            if a == z:
                continue
            here, from_, own = owner[a:z], start[a:z], score[a:z]
            groups = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
            sizes = np.diff(np.concatenate((groups, [z - a])))
            v = best[from_, here] + own
            top = np.maximum.reduceat(v, groups)
            is_top = v == np.repeat(top, sizes)
            others = np.maximum(second[from_, here] + own, np.where(is_top, NONE, v))
            other = np.where(np.add.reduceat(is_top, groups, dtype=np.int64) > 1, top, np.maximum.reduceat(others, groups))
            whose = here[groups]
            best[k, whose], second[k, whose] = top, other
            back[k, whose] = a + np.minimum.reduceat(np.where(is_top, np.arange(z - a), z - a), groups)
        every = np.arange(n_units)
        total, next_best = best[lengths, every], second[lengths, every]
        clear = ~odd & (total != next_best)
        who, place, steps = every[clear], lengths[clear], []
        while len(who):
            e = back[place, who]
            steps.append((who, piece[e]))
            place = start[e]
            who, place = who[place > 0], place[place > 0]
        out: list[Known | None] = [None] * n_units
        if not steps:
            return out
        whose, ids = (np.concatenate(x) for x in zip(*steps[::-1]))
        order = np.argsort(whose, kind="stable")
        data = ids[order].astype("<i4").tobytes()
        ends = (np.cumsum(np.bincount(whose, minlength=n_units)) * 4).tolist()
        a = 0
        for k, (ok, score, other, z) in enumerate(zip(clear.tolist(), total.tolist(), next_best.tolist(), ends)):
            if ok:
                out[k] = data[a:z], score, score - other if other > NONE / 2 else math.inf
            a = z
        return out

    def _searched(self, unit: str) -> list[tuple[int, tuple[int, ...]]]:
        if len(unit) > LONG_KEY:
            return self.paths(unit, self.n_best)
        if unit not in self.multi:
            if len(self.multi) >= SEARCHED_UNITS:
                self.multi.clear()
            self.multi[unit] = self.paths(unit, self.n_best)
        return self.multi[unit]

    def _know(self, units: list[str]) -> list[Known]:
        """What is known of these different units; those that were not used lately are forgotten."""
        if self.held > self.cached:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        known = list(map(young.get, units))
        missing = [k for k, found in enumerate(known) if found is None]
        new = []
        for k in missing:
            found = old.get(units[k])
            if found is None:
                new.append(units[k])
            else:
                young[units[k]] = found
        made = dict(self._best_and_loss(new))
        for k in missing:
            known[k] = made.get(units[k]) or young[units[k]]
        young.update((u, found) for u, found in made.items() if len(u) <= LONG_KEY)
        self.held += UNIT_BYTES * len(missing)
        return known

    # A text

    def _cut(self, clean: list[str]) -> tuple[list[str], list[int]]:
        """The units of normalised texts, one after another, and how many each text has."""
        joined, lengths = "".join(clean), np.fromiter(map(len, clean), np.int64, len(clean))
        code = self.trie.code[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
        pair = code[:-1] * self.trie.width + code[1:]
        starts = np.ones(len(code), bool)
        starts[1:] = self.pairs[pair >> 3] >> (pair & 7).astype(np.uint8) & 1 == 0
        begins = np.cumsum(lengths) - lengths
        starts[begins[lengths > 0]] = True
        cuts = np.flatnonzero(starts)
        counts = np.diff(np.searchsorted(cuts, np.concatenate((begins, [len(code)]))))
        cuts = cuts.tolist()
        return [joined[a:z] for a, z in zip(cuts, [*cuts[1:], len(joined)])], counts.tolist()

    def units_of(self, text: str | None) -> list[str]:
        return self._cut([self.model.normalize(text)])[0] if text else []

    def n_best_of_all(self, texts: list[str | None]) -> list[list[tuple[int, bytes]]]:
        """Score (times ``scale``) and ids (little-endian 32-bit) of the best segmentations of each text, best first."""
        units, counts = self._cut([self.model.normalize(t) if t else "" for t in texts])
        names = list(dict.fromkeys(units))
        ids, scores, losses = zip(*self._know(names)) if names else ((), (), ())
        number, ids = dict(zip(names, range(len(names)))), dict(zip(names, ids))
        placed = np.fromiter(map(number.__getitem__, units), np.int64, len(units))
        scores, losses = np.array(scores, np.int64)[placed], np.array(losses, float)[placed]
        out, a = [], 0
        for count in counts:
            z = a + count
            out.append(self._n_best(units[a:z], ids, int(scores[a:z].sum()), losses[a:z]))
            a = z
        return out

    def n_best_of(self, text: str | None) -> list[tuple[int, bytes]]:
        return self.n_best_of_all([text])[0]

    def _n_best(self, units: list[str], ids: dict[str, bytes], total: int, losses: np.ndarray) -> list[tuple[int, bytes]]:
        """One text, from its units and the ids of their best paths."""
        most = self.n_best - 1
        # Of units that lose equally much, later ones come first.
        if 0 < most < len(losses):
            limit = np.partition(losses, most - 1)[most - 1]
            tied = np.flatnonzero(losses == limit)
            less = np.flatnonzero(losses < limit)
            losing = [*less.tolist(), *tied[len(tied) - (most - len(less)) :].tolist()]
        else:
            losing = range(len(losses)) if most else ()
        chosen = sorted(k for k in losing if losses[k] < math.inf)
        ranked: list[tuple[int, tuple[int, ...]]] = [(0, ())]
        options = {k: self._searched(units[k]) for k in chosen}
        for k in chosen:
            top = options[k][0][0]
            ranked = sorted((lost + top - score, (*ranks, r)) for lost, ranks in ranked for r, (score, _) in enumerate(options[k]))[: self.n_best]
        # What stands between the chosen units is the same in all.
        cuts = [0, *[at for k in chosen for at in (k, k + 1)], len(units)]
        between = [b"".join(map(ids.__getitem__, units[a:z])) for a, z in zip(cuts[::2], cuts[1::2])]
        out = []
        for lost, ranks in ranked:
            parts = [between[0]]
            for k, r, rest in zip(chosen, ranks, between[1:]):
                parts += [array("i", options[k][r][1]).tobytes(), rest]
            out.append((total - lost, b"".join(parts)))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: bytes to characters, ``▁`` to blanks, without the one that the model puts in front."""
        numbers = np.frombuffer(ids, "<i4")
        if not self.high_bytes[numbers].any():
            return "".join(self.shown[numbers].tolist()).replace(GAP, " ").removeprefix(" ")
        out, run = [], bytearray()
        for i in numbers.tolist():
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.pieces[i])
        out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(GAP, " ").removeprefix(" ")


def lattice(model_file: str, n_best: int) -> PieceLattice:
    """One for each worker process."""
    known = worker_cache("piece_nbest")
    if (model_file, n_best) not in known:
        known[model_file, n_best] = PieceLattice(model_file, n_best)
    return known[model_file, n_best]


def segment(docs: DataFrame, model_file: str, n_best: int = N_BEST) -> DataFrame:
    """``docs`` with ``segmentations``, an array of ``score, n_pieces, ids`` (best first, at most ``n_best``, ids as
    little-endian 32-bit integers), and ``decoded``, the text of the best one.

    A text that is null, empty or normalised to nothing has one segmentation without pieces, of score 0.  A text
    with fewer than ``n_best`` segmentations has all of them.  Rows that repeat are segmented each; other columns
    pass through, those named like the results are replaced.  An empty table gives an empty result.
    """
    import pyarrow as pa

    text_batches(docs.sparkSession)
    results = ["segmentations", "decoded"]
    rows = docs.drop(*results)
    added = StructType.fromDDL("segmentations array<struct<score:double,n_pieces:bigint,ids:binary>>, decoded string")
    schema = StructType([*rows.schema.fields, *added.fields])
    at = rows.columns.index("text")
    kind = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids", pa.binary())]))

    def each(batches: Iterator) -> Iterator:
        made = lattice(model_file, n_best)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                found = made.n_best_of_all(part.column(at).to_pylist())
                lists = [[{"score": s / made.scale, "n_pieces": len(ids) // 4, "ids": ids} for s, ids in f] for f in found]
                columns = [*part.columns, pa.array(lists, kind), pa.array([made.decode(f[0][1]) for f in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                del lists, columns
                pa.default_memory_pool().release_unused()  # else 40 MB of former batches stay in each worker

    return rows.mapInArrow(each, schema)
