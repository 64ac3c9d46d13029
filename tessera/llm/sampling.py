"""Operator 9: sampled segmentations into pieces, without replacement, by perturbed search over the lattice.

A text's lattice has an edge for each vocabulary piece that fits somewhere; a character without a piece of its own is spelt in byte pieces. A piece
of rank r weighs 1 / (1 + r), and a segmentation's probability is the product of its weights over the sum of all segmentations' products. Backward sums give the
probability of each next edge.

The k segmentations are those with the largest Gumbel-perturbed log-probabilities, found best first (Kool, van Hoof and Welling, 2019): the largest perturbed
value belongs to a sampled path; what branches off it at one node is a subtree whose own largest value is a Gumbel variable cut at the parent's, so
the subtrees wait in a queue by that bound, and the best one is opened next. Segmentations are distinct by construction. With t the largest value left in the queue, a segmentation of
log-probability p has inclusion score 1 - exp(-exp(p - t)), its probability to be among the k at that threshold; it is given as a logarithm, as long texts have very many segmentations.

Random numbers are hashes of the row key, the sample and the place, so a row's samples don't depend on its batch. Pieces never reach over the start of
a word, so lattices are built per distinct word of a batch and whole texts of any length are sampled as chains of words. Words are told apart by hashes, then compared. Decoding is exact.
Along a path the probability only falls and a Gumbel number of 53 bits is below CEILING, so places too far down to beat the k + 1 best ones are never perturbed.

Defined cases: a null or empty text has one segmentation, without pieces, at inclusion 1 (logarithm 0); fewer than k segmentations give fewer rows; repeated rows get the same
samples each; a null doc_id is key -1; columns other than doc_id and text, whatever their names, are ignored; a text of any length is one row of work, in memory
proportional to it; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain, table
from .hashing import U, mix, spread

SAMPLES, BATCH = 2, 2_000_000
#: No Gumbel number of uniform() is larger; places perturbed at first.
CEILING, SPAN = 36.75, 128
#: What the vocabulary writes for a space; a stand-in for that character itself, which no text can hold.
_SPACE, _LITERAL = "▁", "\udc00"
_Q = U(0xD6E8FEB86659FD93)


class Vocabulary:
    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain_ = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.bytes = {int(names[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
        of_byte = {i: bytes([b]) for b, i in self.bytes.items()}
        spelt = [of_byte.get(i, names[i].replace(_SPACE, " ").encode()) for i in range(n)]
        self.letters, self.size = np.frombuffer(b"".join(spelt), np.uint8), np.array([len(x) for x in spelt])
        self.begin = np.cumsum(self.size) - self.size
        ranks = [max(0.0, min(-model.get_score(i), float(n))) for i in plain_]
        self.byte_weight = -np.log(1.0 + n)
        self.longest = max(len(names[i]) for i in plain_)
        keys = np.array([self._hash(names[i]) for i in plain_], U)
        order = np.argsort(keys)
        self.keys, self.ids, self.weights = keys[order], np.array(plain_)[order], -np.log1p(np.array(ranks))[order]
        # direct places by the key's first 22 bits; keys that share theirs with another are looked up by search
        place = (self.keys >> U(42)).astype(np.int64)
        self.direct = np.zeros(1 << 22, np.int32)
        self.direct[place] = np.arange(1, len(place) + 1)
        shared = np.flatnonzero(np.bincount(place, minlength=1 << 22) > 1)
        self.direct[shared] = -1

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        points = mix(np.array([ord(c) for c in piece], U))
        return mix(np.array([(points * np.multiply.accumulate(np.array([1] + [_Q] * (len(piece) - 1), U))).sum(dtype=U)], U))[0]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `key`, piece slot) of the keys that are pieces."""
        slot = self.direct[(key >> U(42)).astype(np.int64)]
        some = np.flatnonzero(slot)
        slot = slot[some].astype(np.int64) - 1
        twin = np.flatnonzero(slot == -2)
        if len(twin):
            slot[twin] = np.minimum(np.searchsorted(self.keys, key[some[twin]]), len(self.keys) - 1)
        right = self.keys[slot] == key[some]
        return some[right], slot[right]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text; the first space is the marker of its beginning."""
        return self.letters[spread(self.begin[ids], self.size[ids])].tobytes()[1:]


_held: dict = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    """One per worker."""
    if path not in _held:
        _held[path] = Vocabulary(path)
    return _held[path]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with the spaces before them, as code points: those of the distinct words, their sizes, the number of each word of the texts, the words of each text."""
    points = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    sizes = np.array([len(t) + 1 if t else 0 for t in texts])
    space = points == 0x20
    points[points == ord(_SPACE)] = ord(_LITERAL)
    points[space] = ord(_SPACE)
    space[1:] &= ~space[:-1]
    space[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    begin = np.flatnonzero(space)
    size = np.diff(np.append(begin, len(points)))
    place = np.arange(len(points)) - np.repeat(begin, size)
    for salt in count(1):
        power = np.full(int(size.max()) + 1, _Q, U)
        power[0] = 1
        name = np.add.reduceat(mix(points + U(salt << 32)) * np.multiply.accumulate(power)[place], begin)
        _, first, number = np.unique(name, return_index=True, return_inverse=True)
        of = first[number]
        if (size[of] == size).all() and (points[np.repeat(begin[of], size) + place] == points).all():
            break
    per_text = np.diff(np.searchsorted(begin, np.concatenate(([0], np.cumsum(sizes)))))
    return points[spread(begin[first], size[first])], size[first], number, per_text


class Lattices:
    """Lattices of distinct words. Nodes are character places; edges lie by source node, with conditional probabilities."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, v: Vocabulary) -> None:
        self.root = np.cumsum(sizes) - sizes
        n = len(points)
        end = np.repeat(self.root + sizes, sizes)
        mixed, at = mix(points.astype(U)), np.arange(n)
        source, length, piece, weight = [], [], [], []
        h, scale = np.zeros(n, U), U(1)
        single = np.zeros(n, bool)
        for size in range(1, min(v.longest, int(sizes.max())) + 1):
            inside = at + size <= end[at]
            at, h = at[inside], h[inside]
            h += scale * mixed[at + (size - 1)]
            scale = U(int(scale) * int(_Q) & 0xFFFFFFFFFFFFFFFF)
            fit, slot = v.find(mix(h))
            found = at[fit]
            if size == 1:
                single[found] = True
            source.append(found)
            length.append(np.full(len(found), size))
            piece.append(v.ids[slot])
            weight.append(v.weights[slot])
        bare = np.flatnonzero(~single)
        self.spelt = {int(i): [v.bytes[b] for b in (_SPACE if points[i] == ord(_LITERAL) else chr(points[i])).encode("utf-8", "replace")] for i in bare}
        source.append(bare)
        length.append(np.ones(len(bare), np.int64))
        piece.append(-1 - bare)
        weight.append(np.array([v.byte_weight * len(self.spelt[int(i)]) for i in bare]))
        # longest pieces first: they are mostly the likeliest, so a draw ends early
        source, length, piece, weight = (np.concatenate(x[::-1]) for x in (source, length, piece, weight))
        order = np.argsort(source, kind="stable")
        source, length, piece, weight = source[order], length[order], piece[order], weight[order]
        target = source + length
        done = target == end[source]
        first = np.searchsorted(source, np.arange(n + 1))
        back = np.zeros(n)
        left = (end - np.arange(n))[source]  # characters to the word's end
        by = np.argsort(left.astype(np.uint16) if n < 1 << 16 or left.max() < 1 << 16 else left, kind="stable")
        edge = np.searchsorted(left[by], np.arange(1, int(left.max()) + 2))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            e = by[a:b]
            if not len(e):
                continue
            value = weight[e] + np.where(done[e], 0.0, back[np.minimum(target[e], n - 1)])
            s = source[e]
            start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            top = np.maximum.reduceat(value, start)
            count = np.diff(np.append(start, len(e)))
            back[s[start]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count)), start))
        self.log = np.minimum(weight + np.where(done, 0.0, back[np.minimum(target, n - 1)]) - back[source], 0.0)
        p = np.exp(self.log)
        total = np.cumsum(p)
        before = np.concatenate(([0.0], total))[first[:-1]]
        whole = np.concatenate(([0.0], total))[first[1:]] - before
        self.upto = (total - before[source]) / whole[source]
        self.upto[first[1:] - 1] = 1.0
        self.p, self.first, self.source, self.piece, self.next = p, first, source, piece, np.where(done, -1, target)
        self.alone = (first[1:] - first[:-1] == 1)[source]

    def walk(self, start: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each start node to its word's end: (index of the start, edge), in order of walk."""
        who, node = np.arange(len(start)), start
        found, edges, step = [], [], 0
        while len(who):
            u = uniform(seed[who] + U(step))
            e = self.first[node]
            later = np.flatnonzero(u >= self.upto[e])
            while len(later):
                e[later] += 1
                later = later[u[later] >= self.upto[e[later]]]
            found.append(who)
            edges.append(e)
            go = self.next[e] >= 0
            who, node, step = who[go], self.next[e[go]], step + 1
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        who, edges = np.concatenate(found), np.concatenate(edges)
        order = np.argsort(who, kind="stable")
        return who[order], edges[order]

    def ids(self, path: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Ids of paths, of `sizes` edges each, that lie one after another."""
        piece, ends = self.piece[path], np.cumsum(sizes)
        odd = np.flatnonzero(piece < 0)
        if len(odd):
            spelt = [self.spelt[-1 - p] for p in piece[odd].tolist()]
            each = np.ones(len(piece), np.int64)
            each[odd] = [len(x) for x in spelt]
            ends = np.concatenate(([0], np.cumsum(each)))[ends]
            piece = np.repeat(piece, each)
            piece[piece < 0] = [b for x in spelt for b in x]
        return np.split(piece, ends[:-1])


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((mix(x) >> U(12)).astype(np.float64) + 0.5) / 2.0**52


class Row:
    """Search state of one text."""

    def __init__(self, seed: int, roots: np.ndarray) -> None:
        self.roots, self.paths, self.queue = roots, [], []
        self.key, self.noise = mix(np.array([seed, seed ^ 0x5DEECE66D], U))
        # queue: of each path, what branches off at each place, before the cut at that path's bound
        self.bound = float(-np.log(-np.log(uniform(np.array([seed], U))[0])))
        self.opened: tuple[int, int, list[int]] | None = None

    def best(self) -> tuple[float, int, int, int]:
        """(bound, path, place, number in queue) of the best subtree that waits."""
        top = (-np.inf, -1, -1, -1)
        for i, (free, bound) in enumerate(self.queue):
            if len(free):
                j = int(free.argmax())
                top = max(top, (cut(float(free[j]), bound), -i, j, i))
        return top[0], -top[1], top[2], top[3]


def sample(texts: list[str], seeds: list[int], v: Vocabulary, k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to k of (ids, log-probability, perturbed value, log of the inclusion score), by perturbed value."""
    out: list[list] = [[] if t else [(np.empty(0, np.int64), 0.0, 0.0, 0.0)] for t in texts]
    if not any(texts):
        return out
    points, sizes, number, per_text = words_of(texts)
    net = Lattices(points, sizes, v)
    edge = np.concatenate(([0], np.cumsum(per_text)))
    rows = {i: Row(seeds[i], net.root[number[edge[i] : edge[i + 1]]]) for i, t in enumerate(texts) if t}
    active = list(rows)
    for turn in range(k):
        starts, keys, owner, prefixes = [], [], [], {}
        for i in active:
            r = rows[i]
            prefix, roots, at = np.empty(0, np.int64), r.roots, 0
            if turn:
                bound, path, place, number = r.best()
                edges, word, used = r.paths[path]
                taken = used.setdefault(place, [int(edges[place])])
                node = net.source[taken[0]]
                span = np.arange(net.first[node], net.first[node + 1])
                free = np.delete(span, np.array(taken) - span[0])
                u = uniform(np.array([r.key + U((turn << 50) + place)], U))[0]
                pick = int(free[min(int(np.searchsorted(np.cumsum(net.p[free]), u * net.p[free].sum(), "right")), len(free) - 1)])
                r.bound, r.opened = bound, (path, place, taken)
                prefix, at = np.append(edges[:place], pick), int(word[place])
                words_ = np.append(word[:place], at)
                rest = r.roots[at + 1 :]
                roots = np.append(net.next[pick], rest) if net.next[pick] >= 0 else rest
                first_word = at if net.next[pick] >= 0 else at + 1
                prefixes[i] = (prefix, words_, first_word, pick)
            else:
                prefixes[i] = (prefix, prefix, 0, -1)
            starts.append(roots)
            keys.append(r.key + (np.arange(len(roots)) + prefixes[i][2]).astype(U) * U(1 << 20) + U((turn + 1) << 56))
            owner.append(len(roots))
        who, edges = net.walk(np.concatenate(starts), np.concatenate(keys))
        ends = np.searchsorted(who, np.cumsum(owner))
        begin = np.concatenate(([0], ends[:-1]))
        base = np.cumsum(owner) - owner
        whole = np.concatenate([x for n, i in enumerate(active) for x in (prefixes[i][0], edges[begin[n] : ends[n]])])
        length = np.array([len(prefixes[i][0]) for i in active]) + ends - begin
        to = np.cumsum(length)
        log, upto = net.log[whole], np.empty(len(whole))
        for a, b in zip((to - length).tolist(), to.tolist(), strict=True):
            np.cumsum(log[a:b], out=upto[a:b])
        noise = np.array([rows[i].noise for i in active], U) + U(turn << 50)
        values = branches(net.alone[whole], log, upto, length, np.array([len(prefixes[i][0]) for i in active]), noise, k)
        for n, (i, ids) in enumerate(zip(active, net.ids(whole, length), strict=True)):
            r, at = rows[i], slice(to[n] - length[n], to[n])
            prefix, words_, first_word, pick = prefixes[i]
            if turn:
                j = at.start + len(prefix) - 1
                old, place, taken = r.opened
                taken.append(pick)
                free, above = r.queue[old]
                node = net.source[pick]
                left = float(net.p[net.first[node] : net.first[node + 1]].sum() - net.p[taken].sum()) if net.first[node + 1] - net.first[node] > len(taken) else 0.0
                u = uniform(np.array([r.noise + U((turn << 50) + (1 << 49) + place)], U))
                value = cut(float(gumbel(upto[j : j + 1] - log[j], np.array([left]), u)[0]), r.bound)
                # what its place holds is cut at `above`: the raw value that becomes this one
                free[place] = value - np.log1p(-np.exp(value - above)) if left > 0 else -np.inf
            word = np.concatenate((words_, who[begin[n] : ends[n]] + (first_word - base[n]))) if turn < k - 1 else None
            r.paths.append((whole[at], word, {}))
            r.queue.append((values[n], r.bound))
            out[i].append([ids, float(upto[at.stop - 1]), r.bound])
        active = [i for i in active if rows[i].best()[0] > -np.inf]
        if not active:
            break
    for i, r in rows.items():
        left = r.best()[0]
        out[i] = [(ids, p, g, log_inclusion(p - left)) for ids, p, g in out[i]]
    return out


def log_inclusion(above: float) -> float:
    """log(1 - exp(-exp(above))), without underflow."""
    return above if above < -30 else float(np.log(-np.expm1(-np.exp(min(above, 50.0)))))


def gumbel(prefix: np.ndarray, mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Largest perturbed value in subtrees of log-probability prefix + log(mass), not yet cut at the parent's; -inf without mass."""
    with np.errstate(divide="ignore"):
        return np.where(mass > 0, prefix + np.log(np.maximum(mass, 0)) - np.log(-np.log(u)), -np.inf)


def branches(alone: np.ndarray, log: np.ndarray, upto: np.ndarray, length: np.ndarray, begin: np.ndarray, noise: np.ndarray, k: int) -> list[np.ndarray]:
    """Of paths that lie one after another, the values of what branches off at each place from `begin` on; -inf before, and where none of the k + 1 best can lie."""
    first = np.cumsum(length) - length
    out, end, least, span = np.full(len(log), -np.inf), begin.copy(), np.full(len(length), -np.inf), SPAN
    open_ = np.flatnonzero(end < length)
    while len(open_):
        above = np.where(end[open_] > 0, upto[first[open_] + end[open_] - 1], 0.0)  # no place from here on is likelier
        size = np.minimum(span, length[open_] - end[open_])
        fits = above + CEILING >= least[open_]
        open_, above, size = open_[fits], above[fits], size[fits]
        place = spread(end[open_], size)
        u = uniform(np.repeat(noise[open_], size) + place.astype(U))
        with np.errstate(over="ignore"):
            reach = np.exp(-np.exp(above - least[open_])) * (1 - 1e-9)
        fit = np.flatnonzero(u >= np.repeat(reach, size))
        at = (np.repeat(first[open_], size) + place)[fit]
        out[at] = gumbel(upto[at] - log[at], np.where(alone[at], 0.0, -np.expm1(log[at])), u[fit])
        end[open_] += size
        span *= 2
        open_ = open_[end[open_] < length[open_]]
        for n in open_.tolist():
            found = out[first[n] + begin[n] : first[n] + end[n]]
            if len(found) > k:
                least[n] = np.partition(found, -k - 1)[-k - 1]
    return [out[a : a + e] for a, e in zip(first.tolist(), end.tolist(), strict=True)]


def cut(free: float, bound: float) -> float:
    """A Gumbel value given that it is below `bound`: -log(exp(-free) + exp(-bound))."""
    low, high = min(free, bound), max(free, bound)
    return float(low - np.log1p(np.exp(low - high))) if low > -np.inf else -np.inf


SAMPLED = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double"


def _run(path: str | None, k: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            lo = 0
            while lo < len(docs):
                group, size = [], 0
                while lo + len(group) < len(docs) and (not group or size < BATCH):
                    group.append(texts[lo + len(group)].as_py())
                    size += len(group[-1])
                keys = mix(np.array([-1 if d is None else d for d in docs[lo : lo + len(group)]], np.int64).view(U))
                columns: list[list] = [[] for _ in range(8)]
                for d, text, found in zip(docs[lo : lo + len(group)], group, sample(group, [int(x) for x in keys], v, k), strict=True):
                    whole = text.encode("utf-8", "replace")
                    for n, (ids, p, g, q) in enumerate(found):
                        last = ids.astype("<i4") if with_ids else zlib.crc32(ids.astype("<u4").tobytes())
                        for c, x in zip(columns, (d, n, len(ids), p, g, q, last, v.decode(ids) == whole), strict=True):
                            c.append(x)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int32()) if with_ids else pa.int64(), pa.bool_()]
                names = [*(c.split()[0] for c in SAMPLED.split(", ")), "ids" if with_ids else "ids_crc32", "decodes"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
                lo += len(group)

    return run


def segmentations(docs: DataFrame, k: int = SAMPLES, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """SAMPLED, ids (or their CRC-32) and whether they decode to the text: up to k rows for each row of `docs`."""
    return plain(docs).select("doc_id", "text").mapInArrow(_run(path, k, with_ids), f"{SAMPLED}, {'ids array<int>' if with_ids else 'ids_crc32 long'}, decodes boolean")


def _decoded(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            text = [None if ids is None else v.decode(np.array(ids, np.int64)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sample"), pa.array(text, pa.string())], ["doc_id", "sample", "text"])

    return run


def decoded(found: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, sample and the text of the ids."""
    return found.select("doc_id", "sample", "ids").mapInArrow(_decoded(path), "doc_id long, sample int, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentations(table(spark, sf_dir, "documents"), with_ids=False)
