"""Sampled SentencePiece segmentation by forward filtering and backward sampling, and its decoding.

A text becomes a blank mark and the text with blanks as marks; pieces never cross a blank mark, so
the lattice falls apart into short units, and equal units of a block share one forward pass. A
segmentation x has probability proportional to exp(alpha * score(x)). Backward sampling draws, for
each unit from its end, the last piece given the forward sums; its random number depends on the
row key, the seed and the place in the text only, so a row is cut alike in any run or partition.
Characters without a piece of their own become byte pieces, so decoding gives back every text.

A worker holds the lattices of the units it met in a store of fixed size (STORE_NODES and
STORE_EDGES, about 40 MB), and texts are taken in blocks of BLOCK bytes or one longer text; beyond
LONG characters without a blank a unit is summed and sampled one character at a time in plain
Python, so that its cost stays in proportion to its length.

Defined results: a null text has null pieces and decodes to null; an empty text has none and
decodes to itself; a null key counts as the empty key; rows with equal key and text are cut
alike; further columns pass through, but columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import Block, Hasher, Lookup, U64, blocks, mix64, table, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1 / 4096
SEED = 17
BLOCK = 1 << 18
LONG = 256
STORE_NODES, STORE_EDGES = 1_250_000, 4_000_000
MARK = 0x2581
_OWN_MARK = 0x110000  # the mark as a character of the text itself
_ROOT, _STEP = U64(0x51ED270B35AE2D4B), U64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """The vocabulary: prefixes of pieces by rolling key with the piece that ends there, scores, and each id's bytes."""

    keys: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    single: np.ndarray
    byte: np.ndarray
    raw: np.ndarray
    raw_at: np.ndarray
    path: str

    def __post_init__(self):
        self.prefix = Lookup(self.keys)
        two = np.arange(1 << 16)
        self.first = self.prefix.find(_extend(np.full(256, _ROOT, U64), np.arange(256)))
        self.pair = self.prefix.find(_extend(_extend(np.full(1 << 16, _ROOT, U64), two >> 8), two & 255))
        self.known = np.zeros(0x110001, bool)
        self.known[self.single] = True

    def find(self, state: np.ndarray, cp: np.ndarray, pos: np.ndarray, length: int) -> np.ndarray:
        """Rows of the prefixes of one length at pos; narrow characters by direct tables, others by their rolling key."""
        if length > 2:
            return self.prefix.find(state)
        code = np.where(cp == MARK, 0, np.where(cp < 256, cp, -1))[pos] if length == 1 else None
        if length == 1:
            wide = code <= 0
            row = self.first[np.maximum(code, 0)]
        else:
            c = np.where(cp < 256, cp, -1)
            a, b = c[pos], c[pos + 1]
            wide = (a < 0) | (b < 0)
            row = self.pair[np.maximum(a, 0) << 8 | np.maximum(b, 0)]
        at = np.flatnonzero(wide)
        row[at] = self.prefix.find(state[at])
        return row


def _extend(state: np.ndarray, cp: np.ndarray) -> np.ndarray:
    return mix64(state * _STEP + cp.astype(U64))


def load(path: str = MODEL) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    prefix: dict[str, int] = {}
    byte = np.zeros(256, np.int32)
    raw: list[bytes] = []
    for i, p in enumerate(model.pieces):
        text = p.piece
        if p.type == p.BYTE:
            byte[int(text[3:5], 16)] = i
            raw.append(bytes([int(text[3:5], 16)]))
            continue
        raw.append(text.replace(chr(MARK), " ").encode() if p.type == p.NORMAL else b"")
        if p.type == p.NORMAL and text and chr(MARK) not in text[1:]:
            for k in range(1, len(text)):
                prefix.setdefault(text[:k], -1)
            prefix[text] = i
    names = list(prefix)
    longest = max(map(len, names), default=1)
    chars = np.zeros((len(names), longest), np.uint32)
    for j, s in enumerate(names):
        chars[j, : len(s)] = [ord(c) for c in s]
    size = np.array([len(s) for s in names])
    keys = np.full(len(names), _ROOT, U64)
    for k in range(longest):
        on = size > k
        keys[on] = _extend(keys[on], chars[on, k])
    single = np.array([ord(s) for s, i in prefix.items() if len(s) == 1 and i >= 0], np.int64)
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(b) for b in raw], out=at[1:])
    return Pieces(keys, np.array(list(prefix.values()), np.int32), np.array([p.score for p in model.pieces]), single, byte, np.frombuffer(b"".join(raw), np.uint8), at, path)


def _lattice(v: Pieces, cp: np.ndarray, st: np.ndarray, alpha: float):
    """Forward pass over units cp[st[i]:st[i+1]]. Nodes are numbered st[i] + i + t.

    Returns, for each node, its first incoming edge, and for each edge in one word the cumulative
    share within its node (32 bits, longest piece first; the last takes the rest), the piece and its length.
    """
    units = len(st) - 1
    long_ = np.diff(st)
    unit = np.repeat(np.arange(units, dtype=np.int32), long_)
    room = (st[1:][unit] - np.arange(len(cp))).astype(np.int32)
    pos, state, length = np.arange(len(cp), dtype=np.int32), np.full(len(cp), _ROOT, U64), 0
    ends, ids = [], []
    while len(pos):
        state = _extend(state, cp[pos + length])
        length += 1
        row = v.find(state, cp, pos, length)
        ok = np.flatnonzero(row >= 0)
        pos, state, row = pos[ok], state[ok], row[ok]
        piece = v.piece[row]
        hit = np.flatnonzero(piece >= 0)
        at = pos[hit]
        ends.append(at + unit[at] + np.int32(length))
        ids.append(piece[hit])
        on = np.flatnonzero(room[pos] > length)
        pos, state = pos[on], state[on]
    # edges by node; a length has one edge at most into a node
    nodes = len(cp) + units
    degree = np.zeros(nodes, np.int32)
    for e in ends:
        degree[e] += 1
    edge = np.zeros(nodes, np.int32)
    np.cumsum(degree[:-1], out=edge[1:])
    fill = edge.copy()
    pid, size = np.empty(degree.sum(), np.int32), np.empty(degree.sum(), np.int16)
    for n in range(len(ends), 0, -1):
        e = ends[n - 1]
        slot = fill[e]
        fill[e] += 1
        pid[slot], size[slot] = ids[n - 1], n
    w = alpha * v.score[pid]
    total = np.zeros(nodes)
    order = np.argsort(-long_, kind="stable")
    zero = (st[:-1] + np.arange(units))[order]
    brief = long_[long_ <= LONG]
    alive = np.searchsorted(-long_[order], -np.arange(1, int(brief.max(initial=0)) + 1), side="right")
    far = int((long_ > LONG).sum())
    for t, m in enumerate(alive.tolist(), 1):
        node = zero[far:m] + t
        slot = edge[node]
        got = total[node - size[slot]] + w[slot]
        deg = degree[node]
        k, on = 1, np.flatnonzero(deg > 1)
        while len(on):
            more = slot[on] + k
            got[on] = np.logaddexp(got[on], total[node[on] - size[more]] + w[more])
            k += 1
            on = on[deg[on] > k]
        total[node] = got
    into = np.repeat(np.arange(nodes, dtype=np.int32), degree)
    upto = np.exp(total[into - size] + w - total[into])
    del into
    for i in range(far):
        _sum_long(upto, edge, degree, size, w, int(zero[i]), int(long_[order[i]]), len(ends))
    k, on = 1, np.flatnonzero(degree > 1)
    while len(on):
        at = edge[on] + k
        upto[at] += upto[at - 1]
        k += 1
        on = on[degree[on] > k]
    full = np.flatnonzero(degree)
    upto[edge[full] + degree[full] - 1] = 2.0
    share = np.minimum(upto * 2.0**32, 2.0**32 - 1).astype(U64)
    return edge, (share << U64(32)) | (pid.astype(U64) << U64(8)) | size.astype(U64)


def _sum_long(upto: np.ndarray, edge: np.ndarray, degree: np.ndarray, size: np.ndarray, w: np.ndarray, zero: int, length: int, reach: int) -> None:
    """The shares of the edges of one long unit; log sums are kept for as far back as a piece reaches."""
    held = [0.0]
    for t in range(1, length + 1, LONG * 64):
        end = min(length + 1, t + LONG * 64)
        first, last = int(edge[zero + t]), int(edge[zero + end - 1] + degree[zero + end - 1])
        back, weight = size[first:last].tolist(), w[first:last].tolist()
        out, e = [], 0
        for d in degree[zero + t : zero + end].tolist():
            ways = [held[-back[k]] + weight[k] for k in range(e, e + d)]
            most = max(ways)
            ways = [math.exp(x - most) for x in ways]
            whole = sum(ways)
            out += [x / whole for x in ways]
            e += d
            held.append(most + math.log(whole))
        upto[first:last] = out
        held = held[-reach:]


class _Store:
    """Lattices of units met before by this worker, in arrays of fixed size; where a block's do not fit it starts anew."""

    def __init__(self):
        self.edge, self.pack = np.empty(STORE_NODES, np.int32), np.empty(STORE_EDGES, U64)
        self.clear()

    def clear(self) -> None:
        self.keys, self.node = np.zeros(0, U64), np.zeros(0, np.int64)
        self.nodes = self.edges = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First node of each unit, -1 where it is new."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.node[at], -1)

    def add(self, keys: np.ndarray, st: np.ndarray, lattice: tuple) -> np.ndarray | None:
        """First node of each new unit; None where there is no room."""
        edge, pack = lattice
        if self.nodes + len(edge) > len(self.edge) or self.edges + len(pack) > len(self.pack):
            return None
        node = self.nodes + st[:-1] + np.arange(len(keys))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.node = np.insert(self.keys, at, keys), np.insert(self.node, at, node)
        np.add(edge, np.int32(self.edges), out=self.edge[self.nodes : self.nodes + len(edge)])
        self.pack[self.edges : self.edges + len(pack)] = pack
        self.nodes, self.edges = self.nodes + len(edge), self.edges + len(pack)
        return node


_STORES: dict[tuple, _Store] = {}


def _sample_one(edge: np.ndarray, pack: np.ndarray, found: np.ndarray, t: int, node: int, start: int, base: int, salt: np.uint64) -> None:
    """Backward sampling of what is left of one unit, by the same random numbers as the bulk form."""
    while t:
        n = min(t, 4096)
        rnd = mix64(salt ^ mix64(np.arange(base + t - n + 1, base + t + 1, dtype=U64))) | U64(0xFFFFFFFF)
        rnd = np.minimum(rnd, U64((1 << 64) - (1 << 32) - 1)).tolist()
        lo = t - n
        first = edge[node - n + 1 : node + 1].tolist()
        stop = int(edge[node])
        while pack[stop] >> U64(32) != U64(0xFFFFFFFF):
            stop += 1
        begin = first[0]
        here = pack[begin : stop + 1].tolist()
        at, ids = [], []
        while t > lo:
            u, e = rnd[t - lo - 1], first[t - lo - 1] - begin
            while here[e] <= u:
                e += 1
            size = here[e] & 255
            t -= size
            node -= size
            at.append(start + t)
            ids.append((here[e] >> 8) & 0xFFFFFF)
        found[at] = ids


def _fallback_bytes(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of characters, and how many each has."""
    cp = np.where(cp == _OWN_MARK, MARK, cp).astype(np.int64)
    n = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    c, m = np.repeat(cp, n), np.repeat(n, n)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[m]
    left = 6 * (m - 1 - k)
    return np.where(k == 0, (c >> left) | lead, ((c >> left) & 0x3F) | 0x80), n


def encode_block(v: Pieces, block: Block, row_key: np.ndarray, alpha: float = ALPHA, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts of the block, and where each text's begin."""
    head = (block.data & 0xC0) != 0x80
    chars = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(head, out=chars[1:])
    at = chars[block.offs]
    cp = np.frombuffer(block.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    cp[cp == MARK] = _OWN_MARK
    cp[cp == 32] = MARK
    full = np.diff(at) > 0
    st = at + np.concatenate([[0], np.cumsum(full)])
    cp = np.insert(cp, at[:-1][full], MARK)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int32), np.zeros(block.n + 1, np.int64)
    bare = ~v.known[cp]
    begin = bare | (cp == MARK)
    begin[1:] |= bare[:-1]
    begin[st[:-1][full]] = True
    us = np.flatnonzero(begin)
    ue = np.append(us[1:], n)
    lat = ~bare[us]
    us, ue = us[lat], ue[lat]
    doc = np.searchsorted(st, us, side="right") - 1

    found = np.full(n, -1, np.int32)
    if len(us):
        key = Hasher(mix64(cp.astype(U64) + U64(0x5555))).spans(us, ue)
        some, one, which = np.unique(key, return_index=True, return_inverse=True)
        store = _STORES.get((v.path, alpha))
        if store is None:
            store = _STORES[v.path, alpha] = _Store()

        def grow(fresh: np.ndarray) -> tuple[np.ndarray, tuple]:
            at_, size = us[one[fresh]], (ue - us)[one[fresh]]
            cst = np.zeros(len(fresh) + 1, np.int64)
            np.cumsum(size, out=cst[1:])
            units = cp[np.repeat(at_ - cst[:-1], size) + np.arange(cst[-1])]
            return cst, _lattice(v, units, cst, alpha)

        node0 = store.find(some)
        edge_of, pack_of = store.edge, store.pack
        fresh = np.flatnonzero(node0 < 0)
        if len(fresh):
            cst, lattice = grow(fresh)
            got = store.add(some[fresh], cst, lattice)
            if got is None:
                store.clear()
                if len(fresh) < len(some):
                    fresh = np.arange(len(some))
                    cst, lattice = grow(fresh)
                got = store.add(some, cst, lattice)
                if got is None:  # a block beyond the store, one long text
                    got = cst[:-1] + np.arange(len(fresh))
                    edge_of, pack_of = lattice
            node0[fresh] = got
        t = ue - us
        node = node0[which] + t
        salt = mix64(row_key + U64(seed))[doc]
        base = us - st[doc]
        start = us
        while len(t) > 4:
            u = mix64(salt ^ mix64((base + t).astype(U64))) | U64(0xFFFFFFFF)
            np.minimum(u, U64((1 << 64) - (1 << 32) - 1), out=u)  # always below a node's last edge
            e = edge_of[node]
            got = pack_of[e]
            more = np.flatnonzero(got <= u)
            while len(more):
                e[more] += 1
                got[more] = pack_of[e[more]]
                more = more[got[more] <= u[more]]
            size = (got & U64(255)).astype(np.int64)
            t = t - size
            found[start + t] = ((got >> U64(8)) & U64(0xFFFFFF)).astype(np.int32)
            on = t > 0
            t, node, start, base, salt = t[on], (node - size)[on], start[on], base[on], salt[on]
        for k in range(len(t)):
            _sample_one(edge_of, pack_of, found, int(t[k]), int(node[k]), int(start[k]), int(base[k]), salt[k])
    count = (found >= 0).astype(np.int64)
    lone = np.flatnonzero(bare)
    raw, width = _fallback_bytes(cp[lone])
    count[lone] = width
    upto_ = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=upto_[1:])
    ids = np.empty(upto_[-1], np.int32)
    own = np.flatnonzero(found >= 0)
    ids[upto_[own]] = found[own]
    ids[np.repeat(upto_[lone], width) + np.arange(len(raw)) - np.repeat(np.cumsum(width) - width, width)] = v.byte[raw]
    return ids, upto_[st]


def decode_ids(v: Pieces, ids: np.ndarray, st: np.ndarray) -> list[bytes]:
    """The texts whose pieces are ids[st[i]:st[i+1]]; the leading blank mark goes."""
    size = np.diff(v.raw_at)[ids]
    upto = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size, out=upto[1:])
    raw = v.raw[np.repeat(v.raw_at[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
    at = upto[st].tolist()
    return [raw[i + (raw[i : i + 1] == b" ") : j] for i, j in zip(at, at[1:], strict=False)]


def row_keys(column: pa.Array) -> np.ndarray:
    """A hash of each key as text."""
    out = np.zeros(len(column), U64)
    for b in blocks(column.cast(pa.string())):
        h = Hasher(mix64(b.data.astype(U64) + U64(1)))
        out[b.first : b.first + b.n] = h.spans(b.offs[:-1], b.offs[1:])
    return out


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = MODEL, alpha: float = ALPHA, seed: int = SEED, back: bool = False) -> DataFrame:
    """docs with pieces array<int>, one sampled segmentation of each text; with back, and decoded, the text of these pieces, in the same pass."""
    more = [T.StructField("pieces", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.StringType())] if back else [])]
    docs = docs.drop(*[f.name for f in more])
    held = docs.sparkSession.sparkContext.broadcast(load(path))
    schema = T.StructType([*docs.schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = row_keys(batch.column(key))
            for block in blocks(batch.column(text), BLOCK):
                part = batch.slice(block.first, block.n)
                ids, st = encode_block(held.value, block, keys[block.first : block.first + block.n], alpha, seed)
                gone = part.column(text).is_null()
                pieces = pa.ListArray.from_arrays(pa.array(st.astype(np.int32)), pa.array(ids), mask=gone)
                texts = [_texts(held.value, ids, st, gone)] if back else []
                yield pa.RecordBatch.from_arrays([*part.columns, pieces, *texts], [*part.schema.names, *[f.name for f in more]])
                tidy()

    return docs.mapInArrow(run, schema)


def _texts(v: Pieces, ids: np.ndarray, st: np.ndarray, gone: pa.Array) -> pa.Array:
    """The decoded texts as a string column, null where gone."""
    return pa.array([None if no else t for t, no in zip(decode_ids(v, ids, st), gone.to_pylist(), strict=True)], pa.binary()).cast(pa.string())


def decode(docs: DataFrame, pieces: str = "pieces", path: str = MODEL) -> DataFrame:
    """docs with decoded, the text of each row's pieces."""
    docs = docs.drop("decoded")
    held = docs.sparkSession.sparkContext.broadcast(load(path))
    schema = T.StructType([*docs.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(pieces).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(size)
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(upto, (upto[i] - size[i]) + BLOCK, side="right")))
                part = batch.slice(i, j - i)
                col = part.column(pieces)
                st = np.zeros(j - i + 1, np.int64)
                np.cumsum(size[i:j], out=st[1:])
                out = _texts(held.value, col.flatten().to_numpy(zero_copy_only=False), st, col.is_null())
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, "decoded"])
                i = j

    return docs.mapInArrow(run, schema)


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), back=True)
    return docs.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))
