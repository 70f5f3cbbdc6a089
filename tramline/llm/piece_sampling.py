"""Sampled SentencePiece segmentations and lossless decoding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8_values

MARK = "▁"
STAND_IN = "\udfff"
MEMO_UNITS = 150_000
CHUNK_CHARS = 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def uniform(key: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on key and counter alone (SplitMix64)."""
    x = key.astype(np.uint64) + (counter.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


class PieceSampler:
    """Samples segmentations in proportion to the product of piece weights.

    A piece of rank r in the model has weight (r + 2) ** -theta. A character
    without a piece of its own is spelt in byte pieces; one that a text shares
    with the mark for spaces is too, so decoding gives every text back.

    The lattice of a text falls apart where no piece crosses from one
    character to the next. Each such unit is filtered forward once and
    remembered; all occurrences in a batch are then sampled backward together.
    """

    def __init__(self, path: str, theta: float = 0.5, memo_units: int = MEMO_UNITS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self._bytes = [0] * 256
        logs: list[float] = []
        pieces: dict[str, int] = {}
        self._spelt: list[bytes] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            octets = b""
            logs.append(-theta * float(np.log(len(pieces) + 2)))
            if model.is_byte(i):
                self._bytes[int(piece[1:-1], 16)] = i
                octets = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[piece] = i
                octets = piece.replace(MARK, " ").encode()
            self._spelt.append(octets)
        self._log = np.array(logs)
        self._byte_log = -theta * float(np.log(len(pieces) + 2))
        self._longest = max(map(len, pieces), default=1)
        states = {"": 0}
        for piece in pieces:
            for n in range(1, len(piece) + 1):
                states.setdefault(piece[:n], len(states))
        self._state_piece = np.full(len(states), -1, np.int64)
        steps = []
        for prefix, state in states.items():
            self._state_piece[state] = pieces.get(prefix, -1)
            if prefix:
                steps.append((states[prefix[:-1]] << 21 | ord(prefix[-1]), state))
        steps.sort()
        self._step_keys, self._step_to = (np.array(x, np.int64) for x in zip(*steps, strict=True))
        pairs = {(ord(a), ord(b)) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        chars = sorted({c for pair in pairs for c in pair})
        self._class = np.zeros(0x110000, np.uint16)
        self._class[chars] = np.arange(1, len(chars) + 1)
        self._crossed = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in pairs:
            self._crossed[self._class[a], self._class[b]] = True
        self._size, self._limit = size, memo_units
        self._forget()

    def _forget(self) -> None:
        self._unit: dict[str, int] = {}
        self._long: list[list[int]] = []  # ids of characters spelt in bytes
        self._end = np.zeros(0, np.int64)  # a unit's last node
        self._edge = np.zeros(0, np.int64)  # a node's first edge; none for a unit's first node
        self._share = np.zeros(0)  # of edges: probability of it or an earlier edge of its node
        self._from, self._piece = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _add(self, units: list[str]) -> None:
        """Filter the lattices of new units forward, all of them side by side."""
        if not units:
            return
        joined = "".join(units)
        size = np.array([len(u) for u in units])
        begin = np.cumsum(size) - size
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        left = np.repeat(begin + size, size) - np.arange(len(chars))  # characters up to the unit's end
        node_of = np.arange(len(chars)) + np.repeat(np.arange(len(units)), size)  # node before a character
        state, at = np.zeros(len(chars), np.int64), np.arange(len(chars))
        come, go, piece, weight = [], [], [], []
        for n in range(1, self._longest + 1):
            on = left[at] >= n
            at, state = at[on], state[on]
            key = (state << 21) | chars[at + n - 1]
            place = np.minimum(np.searchsorted(self._step_keys, key), len(self._step_keys) - 1)
            hit = self._step_keys[place] == key
            if n == 1:  # characters without a piece are spelt in bytes
                lone = at[~hit | (self._state_piece[self._step_to[place]] < 0)]
                for k in lone.tolist():
                    octets = (MARK if joined[k] == STAND_IN else joined[k]).encode()
                    piece.append(np.array([self._size + len(self._long)]))
                    weight.append(np.array([len(octets) * self._byte_log]))
                    self._long.append([self._bytes[b] for b in octets])
                come.append(lone)
                go.append(lone + 1)
            at, state = at[hit], self._step_to[place[hit]]
            ends = self._state_piece[state] >= 0
            come.append(at[ends])
            go.append(at[ends] + n)
            piece.append(self._state_piece[state[ends]])
            weight.append(self._log[piece[-1]])
        come, go, piece, weight = (np.concatenate(x) for x in (come, go, piece, weight))
        come, go = node_of[come], node_of[go - 1] + 1
        order = np.lexsort((come, go))
        come, go, piece, weight = come[order], go[order], piece[order], weight[order]
        nodes = len(chars) + len(units)
        first = np.searchsorted(go, np.arange(nodes + 1))
        alpha = np.zeros(nodes)
        total = weight.copy()
        nth = np.arange(nodes) - np.repeat(begin + np.arange(len(units)), size + 1)  # a node's place in its unit
        by_place = np.argsort(nth, kind="stable")
        steps = np.searchsorted(nth[by_place], np.arange(int(size.max()) + 2))
        for k in range(1, int(size.max()) + 1):
            here = by_place[steps[k] : steps[k + 1]]
            count = first[here + 1] - first[here]
            starts = np.cumsum(count) - count
            edges = np.repeat(first[here] - starts, count) + np.arange(int(count.sum()))
            logs = alpha[come[edges]] + weight[edges]
            top = np.maximum.reduceat(logs, starts)
            alpha[here] = top + np.log(np.add.reduceat(np.exp(logs - np.repeat(top, count)), starts))
            total[edges] = logs
        share = np.cumsum(np.exp(total - alpha[go]))
        base = np.where(first[:-1] > 0, share[first[:-1] - 1], 0.0)
        share = share - base[go]
        share[first[1:][first[1:] > first[:-1]] - 1] = 2.0  # the last edge takes what rounding leaves
        old_nodes, old_edges, known = len(self._edge), len(self._share), len(self._unit)
        edge = first[:-1] + old_edges
        edge[begin + np.arange(len(units))] = -1
        self._unit.update(zip(units, range(known, known + len(units)), strict=True))
        self._end = np.append(self._end, begin + np.arange(len(units)) + size + old_nodes)
        self._edge = np.append(self._edge, edge)
        self._share = np.append(self._share, share)
        self._from = np.append(self._from, come + old_nodes)
        self._piece = np.append(self._piece, piece.astype(np.int32))

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and where each text begins and the last one ends."""
        out, counts, at = [], [], 0
        while at < len(texts):
            took, stop = 0, at
            while stop < len(texts) and (stop == at or took < CHUNK_CHARS):
                took += len(texts[stop])
                stop += 1
            ids, n = self._sample(texts[at:stop], keys[at:stop])
            out.append(ids)
            counts.append(n)
            at = stop
        if not out:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        return np.concatenate(out), np.concatenate(([0], np.cumsum(np.concatenate(counts))))

    def _sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self._unit) > self._limit:
            self._forget()
        # A mark of the text itself becomes a character that no text can hold and that has no piece.
        marked = [MARK + t.replace(MARK, STAND_IN).replace(" ", MARK) if t else "" for t in texts]
        joined = "".join(marked)
        kind = self._class[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
        begins = np.concatenate(([0], np.cumsum([len(t) for t in marked])))
        cut = np.ones(len(joined) + 1, bool)
        if len(joined):
            cut[1:-1] = ~self._crossed[kind[:-1], kind[1:]]
        cut[begins] = True
        cuts = np.flatnonzero(cut) if len(joined) else np.zeros(1, np.int64)
        bounds = cuts.tolist()
        units = [joined[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
        return self._walk(units, np.searchsorted(cuts, begins), keys)

    def _walk(self, units: list[str], begins: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self._add(list(set(units).difference(self._unit)))
        end = self._end[[self._unit[u] for u in units]] if units else np.zeros(0, np.int64)
        per_text = np.diff(begins)
        key = np.repeat(keys.astype(np.uint64), per_text)
        nth = np.arange(len(end)) - np.repeat(begins[:-1], per_text)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        live, node, length = np.arange(len(end)), end, np.zeros(len(end), np.int64)
        while len(live):
            draw = uniform(key[live], nth[live] + (np.int64(len(steps)) << 40))
            edge = self._edge[node]
            on = np.flatnonzero(draw >= self._share[edge])
            while len(on):
                edge[on] += 1
                on = on[draw[on] >= self._share[edge[on]]]
            steps.append((live, self._piece[edge]))
            length[live] += 1
            node = self._from[edge]
            on = self._edge[node] >= 0
            live, node = live[on], node[on]
        after = np.cumsum(length)
        pieces = np.zeros(int(after[-1]) if len(after) else 0, np.int32)
        for step, (occurrence, piece) in enumerate(steps):
            pieces[after[occurrence] - 1 - step] = piece
        total = np.concatenate(([0], after))[begins]
        spelt = np.flatnonzero(pieces >= self._size)
        if not len(spelt):
            return pieces, np.diff(total)
        n = np.ones(len(pieces), np.int64)
        n[spelt] = [len(self._long[p - self._size]) for p in pieces[spelt]]
        at = np.concatenate(([0], np.cumsum(n)))
        ids = np.repeat(pieces, n)
        for s in spelt.tolist():
            ids[at[s] : at[s + 1]] = self._long[pieces[s] - self._size]
        return ids, np.diff(at[total])

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 text that encode() made ids from."""
        return b"".join(map(self._spelt.__getitem__, ids))[1:]


@lru_cache(maxsize=2)
def sampler(path: str, theta: float) -> PieceSampler:
    """One sampler per worker process, so that its memo lasts."""
    return PieceSampler(path, theta)


def sample_pieces(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", theta: float = 0.5, seed: int = 5
) -> DataFrame:
    """(doc_id, ids array<int>) for every row: a sampled segmentation of its text.

    Forward filtering and backward sampling over the piece lattice; the draws
    are seeded by the row's id and seed, so a row's segmentation is the same in
    any partitioning or retry. A null or empty text has no ids; rows with a
    null id are all seeded alike. Repeated rows get equal results. An empty
    table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            ids, at = sampler(model, theta).encode(texts, batch.column(1).to_numpy(zero_copy_only=False))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)).alias("key"),
        F.col(text_col).alias("text"),
    )
    return slim.mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sampler(model, 0.5).decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"]
            )

    slim = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text string")


def sampled_round_trip(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", theta: float = 0.5, seed: int = 5
) -> DataFrame:
    """sample_pieces() with n_pieces and lossless: whether the ids decode to the row's text.

    Encodes and decodes in one pass, as a check of every row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = sampler(model, theta)
            raw = utf8_values(batch.column(2))
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            ids, at = one.encode([t.decode() for t in raw], keys)
            bounds = at.tolist()
            same = [one.decode(ids[i:j].tolist()) == t for i, j, t in zip(bounds, bounds[1:], raw, strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.array(np.diff(at)), pa.array(same)], ["doc_id", "ids", "n_pieces", "lossless"]
            )

    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)).alias("key"),
        F.col(text_col).alias("text"),
    )
    return slim.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, lossless boolean")
