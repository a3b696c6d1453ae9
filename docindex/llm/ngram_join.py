"""Exact n-gram Jaccard join by parity sketches.

A document's set of word shingles is hashed into a bit sketch in which each
shingle flips one bit. Two sketches differ in no more bits, and in no more
segments, than the sets differ in elements, and linked sets of n and m shingles
differ in at most (n + m) / 7. So of the segments that a document has filled,
all but that many are the same in a document linked with it: any d + 1 of them, taken in
an order that all documents share, meet. These segments are the join keys, in a
name space per size band. Whoever meets is compared by a dense sketch of one to two bits
for each shingle (Hamming distance), and what passes by the sets themselves.

Equal sets are one class throughout. In a bucket of many classes each is paired
with the bucket's first. Once components are known, buckets that still hold several are
compared in blocks: whoever is not of a bucket's largest component with the classes of that component,
once for all buckets, and with the others like it; where many are close, a tree of the closest
pairs first, and then all that are still apart (a second tree would have the same pairs: those of the first that are no links). So no link between components is lost and no group is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW_BITS, attach, drop, flag_among, join_by_key, load, materialize, spare
from .graph import components

WORDS = 5
#: Links need 100 * intersection >= 75 * union.
PERCENT = 75
#: Keys seen so often go last in the shared order. Of keys only those are counted that some
#: task sees twice among so many, which finds all but those of up to about the root of six times the number of
#: tasks. This only decides which keys are taken first.
COMMON, COUNTED = 6, 2_000_000
#: Bits of the map of common keys; two keys that share one are both taken late.
COMMON_BITS = 26
#: Members of a bucket that are compared in one block, and pairs for each of them that
#: a block may give before it gives a tree of the closest ones only.
BLOCK, EACH = 2048, 8
#: Classes of a common key that one task takes.
SALTED = 50_000
#: Keys that are dealt to several tasks at most, the most common ones.
MOST_SALTED = 10_000

_U = np.uint64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], _U)
_BASE = 0xD1342543DE82EF95
#: Bytes of text that are hashed at once, up to the next white space.
_PIECE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    keep = np.empty(len(x), bool)
    keep[:1] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


class Shingler:
    """Sorted hashes of a text's distinct shingles.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. All words of
    a text are hashed at once: with prefix sums of byte values times powers of an
    odd base, a word's hash is a difference, divided by the power at its start."""

    def __init__(self, words: int = WORDS):
        self.n = words
        lower = np.arange(256)
        lower[65:91] += 32
        self.value = _mix(np.arange(1, 257, dtype=_U))[lower]
        self.blank = np.zeros(256, bool)
        self.blank[[32, *range(9, 14)]] = True
        self.power = self.inverse = np.ones(1, _U)

    def _powers(self, n: int) -> None:
        n = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            self.power, self.inverse = (np.concatenate([[_U(1)], np.cumprod(np.full(n, b, _U))]) for b in (_BASE, pow(_BASE, -1, 2**64)))

    def words(self, raw: bytes) -> np.ndarray:
        """Hashes of the words, in order."""
        if len(raw) <= _PIECE:
            return self._words(np.frombuffer(raw, np.uint8))
        b = np.frombuffer(raw, np.uint8)
        cuts = np.flatnonzero(self.blank[b])
        ends, at = [], 0
        while len(b) - at > _PIECE:
            k = np.searchsorted(cuts, at + _PIECE)
            if k == len(cuts):
                break
            at = int(cuts[k])
            ends.append(at)
        return np.concatenate([self._words(p) for p in np.split(b, ends)])

    def _words(self, b: np.ndarray) -> np.ndarray:
        if len(b) >= len(self.power):
            self._powers(len(b) + 1)
        edge = np.ones(len(b) + 2, np.int8)
        edge[1:-1] = self.blank[b]
        step = np.diff(edge)
        starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        total = np.zeros(len(b) + 1, _U)
        np.cumsum(self.value[b] * self.power[: len(b)], out=total[1:])
        return _mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(_U))

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.words((text or "").encode())
        if not len(h):
            return h
        n = min(self.n, len(h))
        total = np.full(len(h) - n + 1, n, _U)
        for k in range(n):
            total += h[k : k + len(total)] * _FACTORS[k]
        return _distinct(_mix(total))


def class_ids(s: np.ndarray) -> tuple[int, int]:
    """Two independent 63-bit digests of a set."""
    import xxhash

    raw = s.tobytes()
    return xxhash.xxh3_64_intdigest(raw) >> 1, xxhash.xxh3_64_intdigest(raw, 1) >> 1


def dense_sketch(s: np.ndarray) -> bytes:
    bits = 1 << max(6, (len(s) - 1).bit_length())
    flips = np.bincount((s & _U(bits - 1)).astype(np.intp), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


class Sketches:
    """Dense sketches of several lengths; a longer one is folded to be compared with a shorter."""

    def __init__(self, blobs: list[bytes]):
        self.length = np.array([len(b) for b in blobs], np.int64)
        self.at = np.zeros(len(blobs), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for k in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == k)
            self.at[own] = np.arange(len(own))
            self.rows[k] = np.frombuffer(b"".join([blobs[i] for i in own]), _U).reshape(-1, k // 8)

    def apart(self, other: Sketches, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits the sketches x differ from the other's sketches y."""
        out = np.zeros(len(x), np.int64)
        lx, ly = self.length[x], other.length[y]
        for i in self.rows:
            for j in other.rows:
                some = np.flatnonzero((lx == i) & (ly == j))
                for part in np.split(some, range(_AT_ONCE, len(some), _AT_ONCE)) if len(some) else []:
                    s, t = self.rows[i][self.at[x[part]]], other.rows[j][other.at[y[part]]]
                    while s.shape[1] > t.shape[1]:
                        s = s[:, : s.shape[1] // 2] ^ s[:, s.shape[1] // 2 :]
                    while t.shape[1] > s.shape[1]:
                        t = t[:, : t.shape[1] // 2] ^ t[:, t.shape[1] // 2 :]
                    out[part] = np.bitwise_count(s ^ t).sum(axis=1, dtype=np.int64)
        return out


#: Pairs of sketches that are compared at once, and pairs of places that are looked at.
_AT_ONCE, _CELLS = 8192, 1 << 19


def max_difference(n: int, larger: int) -> int:
    """The most elements in which a set of n can differ from one linked with it
    that has at most ``larger`` elements."""
    return min(n * (100 - PERCENT) // PERCENT, (n + larger) * (100 - PERCENT) // (100 + PERCENT))


def segments(s: np.ndarray, band: int) -> np.ndarray:
    """The filled segments of the wide sketch of a band: one value each, the XOR of its shingles' hashes."""
    bits = max(20, 4 * band + 8)
    part = s >> _U(64 - bits)
    return np.bitwise_xor.reduceat(s, np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])))


def is_common(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which segments the map of bits marks, by their top bits: 1 or 0."""
    at = own >> _U(64 - COMMON_BITS)
    return common[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & np.uint8(1)


def join_keys(s: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set of hashes, and the segments that they stand for; sets of sizes 16^k to
    16^(k+1) - 1 meet in band k, and those near its lower end also in the band below."""
    n = len(s)
    band = (n.bit_length() - 1) // 4
    out = []
    for k in (band, band - 1):
        top = 16 ** (k + 1) - 1
        if k < 0 or k < band and -(-n * PERCENT // 100) > top:
            continue
        own = segments(s, k)
        keys = _mix(own ^ _U(0x632BE59BD9B4E019 * (k + 1) % 2**64)) >> _U(1)
        take = max_difference(n, top) + 1
        if len(keys) > take:
            order = keys | is_common(own, common).astype(_U) << _U(63)  # common ones last
            first = np.argpartition(order, take - 1)[:take]
            keys, own = keys[first], own[first]
        out.append((keys, own))
    return np.concatenate([k for k, _ in out]), np.concatenate([o for _, o in out])


def _arrow(names: list[str], *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its class, size and dense sketch (tag 0); keys that are common here (tag 1)."""
    shingles, seen, held, size = Shingler(), set(), [], 0
    names = ["tag", "doc_id", "a", "b", "n", "sketch"]

    def common() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        keys, n = keys[n > 1], n[n > 1]
        none = pa.nulls(len(keys), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int32)), none, pa.array(keys.view(np.int64)), none, pa.array(n.astype(np.int64)), pa.nulls(len(keys), pa.binary())], names)

    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = shingles(text.as_py())
            a, b = class_ids(s)
            rows.append((0, doc, a, b, len(s), dense_sketch(s) if a not in seen else None))
            if len(s) and a not in seen:
                if len(seen) < 2_000_000:
                    seen.add(a)
                held.append(segments(s, (len(s).bit_length() - 1) // 4))
                size += len(held[-1])
                if size > COUNTED:
                    yield common()
                    held, size = [], 0
        cols = zip(*rows, strict=True) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names)
    if held:
        yield common()


def _emit(common: Broadcast, salts: dict[int, int], doubtful: set[int]):
    """Keys of each class, with 0 or, for keys so common that a task shouldn't have all
    of them, one of several salts from 1 on."""
    hot = np.array(sorted(salts), _U)
    most = np.array([salts[int(h)] for h in hot], np.int64)

    def rows(keys: list[np.ndarray], own: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
        cls = np.repeat(np.array(owners, np.int64), [len(k) for k in keys])
        key, own = (np.concatenate([np.empty(0, _U), *x]) for x in (keys, own))
        salt = np.zeros(len(key), np.int32)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
            some = np.flatnonzero(hot[at] == own)
            salt[some] = 1 + cls[some] % most[at[some]]
        return _arrow(["key", "salt", "cls"], key.view(np.int64), salt, cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, known = Shingler(), set(), common.value
        keys, own, owners, held = [], [], [], 0
        for batch in batches:
            for text in batch.column(0):
                s = shingles(text.as_py())
                if not len(s):
                    continue
                a, b = class_ids(s)
                a = b if a in doubtful else a
                if a in seen:
                    continue
                if len(seen) < 2_000_000:
                    seen.add(a)
                for x, v in zip((keys, own), join_keys(s, known), strict=True):
                    x.append(v)
                owners.append(a)
                held += len(keys[-1])
                if held > _ROWS:
                    yield rows(keys, own, owners)
                    keys, own, owners, held = [], [], [], 0
        yield rows(keys, own, owners)

    return run


#: Rows of keys that go out at once, or those of a text.
_ROWS = 200_000


class _New:
    """Which pairs are new, as far as a table of fixed size remembers."""

    def __init__(self, bits: int = 18):
        self.table = np.zeros((1 << bits, 2), np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.stack([a, b], axis=1)
        slot = ((a.view(_U) * _FACTORS[0] ^ b.view(_U) * _FACTORS[1]) >> _U(40)).astype(np.intp) % len(self.table)
        new = (self.table[slot] != both).any(axis=1)
        self.table[slot] = both
        return new


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, salt, cls) in that order: pairs of a bucket's first class with each
    other one (tag 0: a, b), the rows of buckets of three or more (tag 1: key, cls), and of
    salted buckets, which are parts of one, all rows and the first class (tag 2: key, cls).
    Of a bucket that goes on in the next batch only the first and the last row are held."""
    names = ["tag", "a", "b"]
    is_new = _New()
    head: tuple[int, int, int] | None = None  # key, salt and first class of the last bucket so far
    before, members = -1, 0  # its last class, and how many it has had
    second = -1
    for batch in batches:
        key, salt, cls = (batch.column(k).to_numpy() for k in range(3))
        if not len(key):
            continue
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (cls[1:] != cls[:-1])])
        if head and head[:2] == (key[0], salt[0]) and before == cls[0]:
            new[0] = False
        key, salt, cls = key[new], salt[new], cls[new]
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]))
        sizes = np.diff(np.append(starts, len(key)))
        first = np.repeat(cls[starts], sizes)
        had = np.zeros(len(starts), np.int64)
        joined = head is not None and head[:2] == (key[0], salt[0])
        if joined:
            first[: sizes[0]], had[0] = head[2], members
        other = first != cls
        other[other] = is_new(first[other], cls[other])
        big = (np.repeat(had + sizes, sizes) >= 3) | (salt > 0)
        heads = (salt > 0) & (first == cls)
        out = [(0, first[other], cls[other]), (1, key[big], cls[big]), (2, key[heads], cls[heads])]
        if joined and not salt[0] and had[0] < 3 <= had[0] + sizes[0]:  # earlier rows of a bucket that only now has three
            early = [head[2]] + ([second] if members == 2 else [])
            out.append((1, np.full(len(early), key[0]), np.array(early, np.int64)))
        yield _arrow(names, np.repeat(np.array([o[0] for o in out], np.int32), [len(o[1]) for o in out]), np.concatenate([o[1] for o in out]), np.concatenate([o[2] for o in out]))
        n_last = int(sizes[-1])
        if joined and len(starts) == 1:
            if members == 1:
                second = int(cls[0])
            members += n_last
        else:
            head, members = (int(key[-1]), int(salt[-1]), int(cls[starts[-1]])), n_last
            second = int(cls[starts[-1] + 1]) if n_last > 1 else -1
        before = int(cls[-1])


def _near(apart: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether dense sketches that differ in so many bits allow a link of sets of
    these sizes, and how far apart they are for their sizes."""
    lo, hi = np.minimum(nx, ny), np.maximum(nx, ny)
    return (100 * lo >= PERCENT * hi) & (apart * (100 + PERCENT) <= (nx + ny) * (100 - PERCENT)), (apart + hi - lo) / (nx + ny)


def _sketch_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, x, y, na, nb, sketch, sketch) the pairs (a, b, x, y, far) that sketches allow."""
    for batch in batches:
        a, b, x, y, na, nb = (batch.column(k).to_numpy() for k in range(6))
        one, two = (Sketches(batch.column(k).to_pylist()) for k in (6, 7))
        each = np.arange(len(a))
        ok, far = _near(one.apart(two, each, each), na, nb)
        yield _arrow(["a", "b", "x", "y", "far"], a[ok], b[ok], x[ok], y[ok], far[ok])


def _tree(x: np.ndarray, y: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which of the pairs of nodes (x, y) make a forest, closest first."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (j := root.setdefault(i, i)) != i:
            root[i] = i = root[j]
        return i

    keep = []
    for k in np.lexsort((y, x, far)).tolist():
        i, j = find(int(x[k])), find(int(y[k]))
        if i != j:
            root[i] = j
            keep.append(k)
    return np.array(keep, np.int64)


def _compare(own: np.ndarray, same: bool, root: np.ndarray, n: np.ndarray, sketches: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places (x, y, far) in a block whose classes are of different components and
    may be linked. Within one part (``same``) all meet, else those of the two parts."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    place = np.arange(len(root))
    step = max(1, _CELLS // max(1, len(root)))
    for at in range(0, len(root), step):
        some = slice(at, at + step)
        able = (root[some, None] != root) & (100 * np.minimum(n[some, None], n) >= PERCENT * np.maximum(n[some, None], n))
        able &= (place[some, None] < place) if same else (own[some, None] > own)
        x, y = np.nonzero(able)
        x += at
        ok, far = _near(sketches.apart(sketches, x, y), n[x], n[y])
        out.append((x[ok], y[ok], far[ok]))
    x, y, far = (np.concatenate(c) for c in zip(*out, strict=True))
    return x, y, far


def _across(last: bool):
    """Pairs of classes of different components (again -1: a, b) from rows (kind, key, i, j, own, cls,
    root, n, sketch) by block (kind, key, i, j). All rows of a block with i = j meet each other,
    else those that are its own the others. A block with very many pairs gives
    a tree of the closest ones, and a row that says so (its kind as again, its key as a), unless it is the ``last`` time."""
    n_ids = 4

    def blocks(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        ids = [t.column(k).to_numpy() for k in range(n_ids)]
        own, cls, root, n = (t.column(k).to_numpy() for k in range(n_ids, n_ids + 4))
        blobs = t.column(n_ids + 4).to_pylist()
        new = np.any([c[1:] != c[:-1] for c in ids], axis=0)
        starts = np.flatnonzero(np.concatenate([[True], new])).tolist()
        tags, left, right = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s, e in zip(starts, [*starts[1:], len(cls)], strict=True):
            part = slice(s, e)
            x, y, far = _compare(own[part], ids[2][s] == ids[3][s], root[part], n[part], Sketches(blobs[s:e]))
            again = not last and len(x) > EACH * (e - s)
            if again:
                keep = _tree(root[part][x], root[part][y], far)
                x, y = x[keep], y[keep]
            a, b = cls[part][x], cls[part][y]
            tags += [np.full(len(x), -1, np.int32), np.full(int(again), ids[0][s], np.int32)]
            left += [np.minimum(a, b), np.full(int(again), ids[1][s], np.int64)]
            right += [np.maximum(a, b), np.zeros(int(again), np.int64)]
        return _arrow(["again", "a", "b"], np.concatenate(tags), np.concatenate(left), np.concatenate(right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            ids = [batch.column(k).to_numpy() for k in range(n_ids)]
            cut = np.flatnonzero(np.any([c != c[-1] for c in ids], axis=0))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if held and any(held[-1].column(k)[0].as_py() != ids[k][0] for k in range(n_ids)):
                yield blocks(pa.Table.from_batches(held))
                held = []
            if cut:
                yield blocks(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield blocks(pa.Table.from_batches(held))

    return run


def _of_class(doubtful: set[int]):
    """Compressed texts (cls, node, n, text) of (cls, node, n, text) whose class is the one that their id stands for, once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shingles, seen, pack = Shingler(), set(), zstandard.ZstdCompressor(3).compress
        for batch in batches:
            rows = []
            for cls, node, n, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                text = text.as_py() or ""
                a, b = class_ids(shingles(text))
                if cls not in seen and cls == (b if a in doubtful else a):
                    seen.add(cls)
                    rows.append((cls, node, n, pack(text.encode())))
            cols = [*zip(*rows, strict=True)] if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["cls", "node", "n", "text"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    shingles, unpack = Shingler(), zstandard.ZstdDecompressor().decompress

    @lru_cache(512)
    def of(blob: bytes) -> np.ndarray:
        return shingles(unpack(blob).decode())

    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            s, t = of(x.as_py()), of(y.as_py())
            both = len(s) + len(t) - len(_distinct(np.concatenate([s, t])))
            ok.append(100 * both >= PERCENT * (len(s) + len(t) - both))
        keep = np.array(ok, bool)
        yield _arrow(["x", "y"], batch.column(0).to_numpy()[keep], batch.column(1).to_numpy()[keep])


def _classes(survey: DataFrame) -> tuple[DataFrame, DataFrame, set[int]]:
    """The rows with their class, the classes (cls, doc_id, n, n_rows, sketch), and those first digests
    that different sets share: among a thousand million sets hardly one, so the driver
    holds them. Sets with such a digest go by their second one."""
    rows = survey.where("tag = 0").select("doc_id", F.col("a").alias("cls"), "b", "n", "sketch")

    def grouped(rows: DataFrame) -> DataFrame:
        found = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.count("*").alias("n_rows"), F.min("b").alias("lo"), F.max("b").alias("hi"), F.max("sketch").alias("sketch"))
        return materialize(found, "classes")

    classes = grouped(rows)
    doubtful = {r[0] for r in classes.where("lo <> hi").select("cls").collect()}
    if doubtful:
        drop(classes)
        rows = rows.withColumn("cls", F.when(F.col("cls").isin(*doubtful), F.col("b")).otherwise(F.col("cls")))
        classes = grouped(rows)
    return rows, classes, doubtful


def link_components(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row of ``docs``
    (doc_id, text): the smallest doc_id that links lead to.

    Rows without words (null, empty or blank text) are linked with nothing and
    are their own component. A row with a null doc_id is in the component of rows of the same
    shingles that have one, else in none (null). Repeated rows give repeated rows; rows
    with one doc_id and different texts are one document, linked with what any of them is linked with."""
    attach(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    survey = materialize(docs.mapInArrow(_survey, "tag int, doc_id long, a long, b long, n long, sketch binary"), "survey")
    rows, classes, doubtful = _classes(survey)
    counted = materialize(survey.where("tag = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON), "counted")
    place = F.shiftrightunsigned("a", 64 - COMMON_BITS)
    bits = np.zeros((1 << COMMON_BITS) // 8, np.uint8)
    row_bits = min(ROW_BITS, 1 << COMMON_BITS)
    for row, part in counted.groupBy(F.floor(place / row_bits).alias("row")).agg(F.call_function("bitmap_construct_agg", place % row_bits).alias("bits")).collect():  # 8 MB at most
        bits[row * row_bits // 8 : (row + 1) * row_bits // 8] = np.frombuffer(part, np.uint8)[: row_bits // 8]
    common = docs.sparkSession.sparkContext.broadcast(bits)
    salts = {r["a"] % 2**64: -(-r["n"] // SALTED) for r in counted.where(F.col("n") > SALTED).orderBy(F.desc("n"), "a").limit(MOST_SALTED).collect()}

    keys = docs.select("text").mapInArrow(_emit(common, salts, doubtful), "key long, salt int, cls long")
    met = materialize(keys.repartition("key", "salt").sortWithinPartitions("key", "salt", "cls").mapInArrow(_meet, "tag int, a long, b long"), "met")
    known = classes.where("doc_id is not null")
    info = known.select("cls", F.col("doc_id").alias("node"), "n", "sketch")

    pairs = met.where("tag = 0").select("a", "b")
    if salts:  # the first classes of the parts of a bucket meet, too
        heads = met.where("tag = 2").select(F.col("a").alias("key"), F.col("b").alias("cls"))
        one = heads.groupBy("key").agg(F.min("cls").alias("one"))
        pairs = pairs.unionByName(heads.join(one, "key").where("cls <> one").select(F.col("one").alias("a"), F.col("cls").alias("b")))
    pairs = materialize(pairs.distinct(), "pairs")
    often = materialize(pairs.groupBy("a").agg(F.count("*").alias("often")), "often")
    a = info.select(F.col("cls").alias("a"), F.col("node").alias("x"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = info.select(F.col("cls").alias("b"), F.col("node").alias("y"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    pool = join_by_key(pairs, a, "a", "often", counts=often).join(b, "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)").select("a", "b", "x", "y", "na", "nb", "sa", "sb")
    pool = materialize(pool.mapInArrow(_sketch_pairs, "a long, b long, x long, y long, far double"), "pool")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of classes, all different, that are linked, as pairs of their documents."""
        both = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
        need = materialize(both.groupBy("cls").agg(F.count("*").alias("n")).join(info.select("cls", "node"), "cls"), "need")
        able = flag_among(docs, "doc_id", need.select(F.col("node").alias("doc_id")), "able").where("able")
        texts = able.join(need.withColumnRenamed("node", "doc_id"), "doc_id").select("cls", "doc_id", "n", "text").mapInArrow(_of_class(doubtful), "cls long, node long, n long, text binary")
        texts = materialize(texts.dropDuplicates(["cls"]), "texts")
        for c, node in (("a", "x"), ("b", "y")):
            pairs = join_by_key(pairs, texts.select(F.col("cls").alias(c), F.col("node").alias(node), F.col("text").alias(f"text_{c}"), F.col("n").alias(f"n_{c}")), c, f"n_{c}")
        out = materialize(pairs.select("x", "y", "text_a", "text_b").mapInArrow(_verify, "x long, y long"), "links")
        drop(need, texts)
        return out

    def rooted(df: DataFrame, roots: DataFrame, of: str, name: str) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(of), F.col("root").alias(name)), of, "left").withColumn(name, F.coalesce(name, of))

    def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
        """The roots after more links; only components that these join are worked on."""
        joins = materialize(rooted(rooted(links, roots, "x", "rx"), roots, "y", "ry").where("rx <> ry").select(F.col("rx").alias("a"), F.col("ry").alias("b")).distinct(), "joins")
        if joins.isEmpty():
            return roots
        moved = materialize(components(joins), "moved")
        old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        out = materialize(old.unionByName(moved.join(roots.select("node"), "node", "left_anti")), "roots")
        drop(joins, moved)
        return out

    # The closest pair of each class first; what is still apart is verified with what the first comparison of blocks finds.
    closest = materialize(pool.groupBy("b").agg(F.min_by("a", F.struct("far", "a")).alias("a")).select("a", "b"), "closest")
    roots = materialize(components(verified(closest).select(F.col("x").alias("a"), F.col("y").alias("b"))), "roots")
    apart = rooted(rooted(pool.join(closest, ["a", "b"], "left_anti"), roots, "x", "rx"), roots, "y", "ry").where("rx <> ry")
    apart = materialize(apart.select("a", "b"), "apart")
    tested = closest.select("a", "b")

    # Buckets that hold several components, one of those with the same members.
    rows_of = met.where("tag = 1").select(F.col("a").alias("key"), F.col("b").alias("cls"))
    sets = rows_of.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("cls")).alias("h"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("g"))
    canon = sets.groupBy("h", "g", "m").agg(F.min("key").alias("key")).select("key", "m")
    canon = materialize(canon, "canon")
    once = join_by_key(rows_of, canon, "key", "m").drop("m").join(info.select("cls", "node"), "cls")
    # Two classes that meet in a bucket after the same one have met there, in the end in the first one that both have.
    before = F.lag("key").over(W.partitionBy("cls").orderBy("key"))
    bucket = materialize(once.withColumn("before", before), "buckets")
    drop(met, pool, pairs, often, counted, canon)
    shape = ("kind", "key", "i", "j", "own", "cls", "root")
    for last in (False, True):
        members = materialize(rooted(bucket, roots, "node", "root"), "members")
        sizes = members.groupBy("key", "root").agg(F.count("*").alias("m"))
        mixed = sizes.groupBy("key").agg(F.max_by("root", F.struct("m", -F.col("root"))).alias("most"), F.sum("m").alias("m"), F.count("*").alias("roots")).where("roots > 1")
        mixed = materialize(mixed, "mixed")
        if last and mixed.isEmpty():
            drop(members, mixed, bucket)
            break
        held = materialize(join_by_key(members, mixed, "key", "m").select("key", "cls", "root", "most", "before"), "held")
        drop(members, mixed)
        # Who isn't of a bucket's largest component meets that component's classes, once however many buckets say so,
        few = held.where("root <> most")
        large = held.where("root = most").select("cls", "root").distinct()
        guests = few.select("cls", "root", "most").distinct()
        blocks = lambda c: F.ceil(F.col(c) / BLOCK)
        counts = large.groupBy("root").agg(F.count("*").alias("m")).join(guests.groupBy(F.col("most").alias("root")).agg(F.count("*").alias("g")), "root")
        counts = materialize(counts, "counts")
        along = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        # Parts i of the component and parts j of its guests; -1 - j, so that they are never the same.
        dealt = join_by_key(large, counts, "root", "m").withColumns({"i": F.pmod(F.xxhash64("cls"), blocks("m")), "parts": blocks("g")}).withColumn("j", along("parts"))
        dealt = dealt.select(F.lit(0).alias("kind"), F.col("root").alias("key"), "i", (-1 - F.col("j")).alias("j"), F.lit(0).alias("own"), "cls", "root")
        guests = join_by_key(guests, counts.withColumnRenamed("root", "most"), "most", "g").withColumns({"j": F.pmod(F.xxhash64("cls"), blocks("g")), "parts": blocks("m")}).withColumn("i", along("parts"))
        guests = guests.select(F.lit(0).alias("kind"), F.col("most").alias("key"), "i", (-1 - F.col("j")).alias("j"), F.lit(1).alias("own"), "cls", "root")
        # and the others of its bucket.
        several = few.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("before").alias("later"), F.min("before").alias("first"), F.max("before").alias("last"))
        several = several.where("lo <> hi and (later < m or first <> last)").select("key", "m")
        several = materialize(several, "several")
        parts = join_by_key(few.select("key", "cls", "root"), several, "key", "m").withColumn("blocks", blocks("m")).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
        parts = parts.withColumn("other", along("blocks")).select(F.lit(1).alias("kind"), "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).cast("int").alias("own"), "cls", "root")
        spread = dealt.select(*shape).unionByName(guests.select(*shape)).unionByName(parts.select(*shape)).join(info.select("cls", "n", "sketch"), "cls").select(*shape, "n", "sketch")
        met_again = spread.repartition("kind", "key", "i", "j").sortWithinPartitions("kind", "key", "i", "j").mapInArrow(_across(last), "again int, a long, b long")
        late = materialize(met_again, "late")
        fresh = late.where("again < 0").select("a", "b")
        fresh = fresh if last else fresh.unionByName(apart)
        fresh = materialize(fresh.distinct().join(tested, ["a", "b"], "left_anti"), "fresh")
        if not fresh.isEmpty():
            roots = merged(roots, verified(fresh))
            tested = tested.unionByName(fresh)
        again = late.where("again >= 0").select(F.col("again").alias("kind"), F.col("a").alias("key")).distinct()
        drop(several, counts)
        if again.isEmpty():
            drop(held, late, bucket)
            break
        # Only buckets whose blocks gave too many pairs come again.
        some = held.join(again.where("kind = 0").select(F.col("key").alias("most")), "most", "left_semi").select("key").unionByName(again.where("kind = 1").select("key")).distinct()
        some, whole = materialize(some, "some"), bucket
        bucket = materialize(whole.join(some, "key", "left_semi"), "buckets")
        drop(held, late, some, whole)
    of_class = known.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("cls", "n_rows", F.coalesce("root", "doc_id").alias("component_id"))
    of_class = of_class.unionByName(classes.where("doc_id is null").select("cls", "n_rows", F.col("doc_id").alias("component_id")))
    found = join_by_key(rows.where("n > 0").select("doc_id", "cls", "n"), of_class, "cls", "n_rows", counts=classes).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id; of repeated
    rows with one id the first by text and then by what else they hold stays. Documents with a null doc_id stay."""
    found = link_components(docs).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("root"))
    odd = materialize(found.where("n > 1 or root <> doc_id"), "odd")  # all others stay as they are
    cols = docs.columns
    flag = spare(cols, "bound")
    marked = flag_among(docs, "doc_id", odd.select("doc_id"), flag)
    free = marked.where(F.col("doc_id").isNull() | ~F.col(flag)).select(*cols)
    bound = marked.where(F.col("doc_id").isNotNull() & F.col(flag)).select(*cols)
    alone = bound.join(odd.select("doc_id"), "doc_id", "left_anti")
    row = F.struct(*cols)
    first = bound.join(odd.where("root = doc_id").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row")).select("row.*")
    return free.unionByName(alone.select(*cols)).unionByName(first)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(load(spark, sf_dir, "documents"))
