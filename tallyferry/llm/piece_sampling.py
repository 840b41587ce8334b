"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice, and decoding.

Pieces hold a space only at their front, or nothing but spaces, so the lattice of a text falls apart before every
space that follows another character. Forward sums are taken once per distinct part of a run of texts; then one path
is drawn backwards for every occurrence. Draws come from a counter hashed with the row's key, so a row has the same
pieces in whatever task, batch or attempt it is encoded.

A piece weighs 1 / (RANK_SHIFT + its merge rank), to the power `sharpness`. A character that no piece covers, and a
literal U+2581, becomes the pieces of its UTF-8 bytes, so decoding gives every text back exactly. As the model does, a
text that is not empty gets one space in front, which decoding removes; empty and null texts have no pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyferry.llm.arrays import mixed, pieces

MODEL = "piece_bpe_32k.model"
RANK_SHIFT = 10.0
SHARPNESS = 1.0
GROUP_BYTES = 1 << 20
RESIDENT_PARTS = 100_000
LEARNT_GROUPS = 16
SLICE_CHARS = 1 << 17  # of the parts whose forward sums are taken at once; a longer part alone
_SPACE = 0x2581
_PART = re.compile(" *[^ ]+| +")
_CLASSES = 1 << 12  # characters of pieces have smaller class numbers; 0 is every other character
_DIRECT = 512  # classes whose second step is a plain table
_tries: dict[tuple[str, float], Trie] = {}
_encoders: dict[tuple[str, float], Encoder] = {}
_SLOTS = 1 << 20


def _slot(key: np.ndarray) -> np.ndarray:
    return (mixed(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)


@dataclass
class Trie:
    """The model's pieces as arrays: steps from state and character class to state, and the piece that ends there."""

    class_of: np.ndarray
    second: np.ndarray
    slots: np.ndarray
    targets: np.ndarray
    piece: np.ndarray
    weight: np.ndarray
    longest: int
    byte_id: np.ndarray
    text: list[bytes]

    def step(self, key: np.ndarray) -> np.ndarray:
        """Where each state and class leads; -1 if nowhere."""
        at, to = _slot(key), np.full(len(key), -1, np.int64)
        due = np.arange(len(key))
        while len(due):
            held = self.slots[at[due]]
            found = held == key[due]
            to[due[found]] = self.targets[at[due[found]]]
            due = due[~found & (held >= 0)]
            at[due] += 1
        return to


def load(path: str, sharpness: float = SHARPNESS) -> Trie:
    """The trie of a model file; kept for the life of the process."""
    if (path, sharpness) not in _tries:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        byte_id, text, whole = np.zeros(256, np.int64), [], []
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                byte_id[int(name[3:5], 16)] = i
                text.append(bytes([int(name[3:5], 16)]))
            else:
                special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
                text.append(b"" if special else name.replace("▁", " ").encode())
                if not special:
                    whole.append((name, i))
        rank = np.full(len(text), float(len(text)))
        for _, i in whole:
            rank[i] = -model.get_score(i)
        chars = sorted({c for name, _ in whole for c in name}, key=lambda c: (not c.isascii(), c))
        class_of = np.zeros(0x110001, np.int32)
        class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        number = {c: k + 1 for k, c in enumerate(chars)}
        states, piece = {"": 0}, [-1]
        for name, i in whole:
            for end in range(1, len(name) + 1):
                if name[:end] not in states:
                    states[name[:end]] = len(states)
                    piece.append(-1)
            piece[states[name]] = i
        steps = sorted((states[s[:-1]] * _CLASSES + number[s[-1]], k) for s, k in states.items() if s)
        slots, targets = np.full(_SLOTS + len(steps), -1, np.int64), np.full(_SLOTS + len(steps), -1, np.int64)
        for k, t in steps:  # open addressing; the next free slot is never far
            at = int(_slot(np.array([k]))[0])
            while slots[at] >= 0:
                at += 1
            slots[at], targets[at] = k, t
        first = {k % _CLASSES: t for k, t in steps if k < _CLASSES}
        second = np.full((_DIRECT, _DIRECT), -1, np.int64)
        origin = {t: c for c, t in first.items()}
        for k, t in steps:
            if (c := origin.get(k // _CLASSES, _DIRECT)) < _DIRECT and k % _CLASSES < _DIRECT:
                second[c, k % _CLASSES] = t
        weight = (1.0 / (RANK_SHIFT + np.maximum(rank, 0))) ** sharpness
        _tries[path, sharpness] = Trie(class_of, second, slots, targets, np.array(piece), weight, max(len(n) for n, _ in whole), byte_id, text)
    return _tries[path, sharpness]


class Lattice:
    """Forward sums of distinct parts, and for each node the edges that end there with their share of its sum."""

    def __init__(self, trie: Trie, parts: list[str]) -> None:
        length = np.array([len(p) for p in parts])
        order = np.argsort(-length, kind="stable")  # so that parts of at least t characters come first
        length = length[order]
        joined = "".join([parts[k] for k in order])
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        char = np.where(raw == 0x20, _SPACE, np.where(raw == _SPACE, 0x110000, raw))
        begin = np.cumsum(length) - length  # of each part's characters
        node = begin + np.arange(len(length))  # of each part's first node; a part has a node more than characters
        node_of_char = np.arange(len(char)) + np.repeat(np.arange(len(length)), length)
        room = np.repeat(begin + length, length) - np.arange(len(char))
        total = len(char) + len(length)
        ending: list[tuple[np.ndarray, np.ndarray]] = []  # by size: the node where a piece ends, and the piece
        kind = trie.class_of[char]
        # the pieces that begin at each character, one length after the other
        at, state = np.arange(len(char)), np.zeros(len(char), np.int64)
        for size in range(1, trie.longest + 1):
            going = room[at] >= size
            at, state = at[going], state[going]
            if not len(at):
                break
            step = kind[at + size - 1].astype(np.int64)
            if size == 2:
                before = kind[at].astype(np.int64)
                plain = (before < _DIRECT) & (step < _DIRECT)
                to = np.full(len(at), -1, np.int64)
                to[plain] = trie.second[before[plain], step[plain]]
                rest = np.flatnonzero(~plain & (step > 0))
            else:
                to, rest = np.full(len(at), -1, np.int64), np.flatnonzero(step > 0)
            to[rest] = trie.step(state[rest] * _CLASSES + step[rest])
            alive = to >= 0
            if size == 1:
                bare = at[~alive]  # characters that no piece begins with
                bare = np.concatenate([bare, at[alive][trie.piece[to[alive]] < 0]])
            at, state = at[alive], to[alive]
            ends = trie.piece[state] >= 0
            ending.append((node_of_char[at[ends]] + size, trie.piece[state[ends]]))
        while len(ending) > 1 and not len(ending[-1][0]):
            ending.pop()
        longest = len(ending)
        share = np.zeros((total, longest), np.float32)
        code = np.zeros((total, longest), np.int32)
        for size, (to, which) in enumerate(ending, 1):
            code[to, size - 1] = which
            share[to, size - 1] = trie.weight[which]
        low = np.where(raw[bare] < 0x80, trie.byte_id[np.minimum(raw[bare], 0x7F)], len(trie.text) + raw[bare])
        code[node_of_char[bare] + 1, 0] = low
        share[node_of_char[bare] + 1, 0] = trie.weight[trie.byte_id[0]]
        # forward: node t of every part that is so long, from the nodes before; sums are scaled to 1 at each node
        log = np.full(total, -np.inf)
        log[node] = 0.0
        live = len(length)
        for t in range(1, int(length[0]) + 1 if len(length) else 0):
            while live and length[live - 1] < t:
                live -= 1
            here = node[:live] + t
            most = min(t, longest)
            back = np.stack([log[here - s] for s in range(1, most + 1)], 1)
            top = back.max(1, keepdims=True)
            mass = np.exp(back - top) * share[here, :most]
            whole = mass.sum(1, keepdims=True)
            log[here] = np.log(whole[:, 0]) + top[:, 0]
            share[here, :most] = mass / whole
        # longer pieces first: they are drawn most often
        upto = np.cumsum(share[:, ::-1], 1)
        rows, back = np.nonzero(share[:, ::-1])
        self.until = upto[rows, back]
        self.head = np.searchsorted(rows, np.arange(total + 1))
        last = self.head[1:][np.diff(self.head) > 0] - 1
        self.until[last] = 1.0
        self.size = (longest - back).astype(np.int8)
        self.code = code[rows, self.size - 1]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.start, self.end = node[place], (node + length)[place]

    @classmethod
    def of(cls, trie: Trie, parts: list[str]) -> Lattice:
        """The lattice of any number of parts, whose tables of nodes by size are held for SLICE_CHARS characters at a time."""
        upto = np.cumsum([len(p) for p in parts])
        made, at = [], 0
        while at < len(parts):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_CHARS, "right")))
            made.append(cls(trie, parts[at:to]))
            at = to
        return cls.joined(made) if len(made) != 1 else made[0]

    @classmethod
    def joined(cls, lattices: list[Lattice]) -> Lattice:
        """One lattice of the parts of all."""
        out = object.__new__(cls)
        edges = np.cumsum([0, *(x.head[-1] for x in lattices)])
        nodes = np.cumsum([0, *(len(x.head) - 1 for x in lattices)])
        out.head = np.concatenate([*(x.head[:-1] + e for x, e in zip(lattices, edges, strict=False)), edges[-1:]])
        for name in ("until", "size", "code"):
            setattr(out, name, np.concatenate([getattr(x, name) for x in lattices]))
        for name in ("start", "end"):
            setattr(out, name, np.concatenate([getattr(x, name) + n for x, n in zip(lattices, nodes, strict=False)]))
        return out

    def sample(self, part: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A path for every occurrence of a part: the codes of all, and where each occurrence's codes begin."""
        now, goal, who = self.end[part].copy(), self.start[part], np.arange(len(part))
        count = np.zeros(len(part), np.int64)
        steps = []
        k = 0
        while len(who):
            r = (mixed(draw[who] + np.uint64(k)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            edge = self.head[now[who]]
            due = np.arange(len(who))
            while len(due := due[self.until[edge[due]] <= r[due]]):
                edge[due] += 1
            steps.append((who, self.code[edge]))
            now[who] -= self.size[edge]
            count[who] += 1
            who = who[now[who] > goal[who]]
            k += 1
        bounds = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(bounds[-1], np.int64)
        for k, (who, code) in enumerate(steps):
            out[bounds[who + 1] - 1 - k] = code
        return out, bounds


class Encoder:
    """Encodes groups of texts; parts that many groups have stay in a lattice of bounded size."""

    def __init__(self, trie: Trie, resident: int = RESIDENT_PARTS, after: int = LEARNT_GROUPS) -> None:
        self.trie, self.resident, self.after = trie, resident, after
        self.groups_of: dict[str, int] = {}
        self.known: dict[str, int] = {}
        self.lattice: Lattice | None = None

    def _lattice(self, parts: list[str]) -> tuple[dict[str, int], Lattice]:
        new = [p for p in dict.fromkeys(parts) if p not in self.known]
        index = self.known | {p: k for k, p in enumerate(new, len(self.known))} if new else self.known
        own = Lattice.of(self.trie, new) if new or self.lattice is None else None
        if self.after:
            for p in new:
                self.groups_of[p] = self.groups_of.get(p, 0) + 1
            self.after -= 1
            if not self.after:
                often = sorted((p for p, n in self.groups_of.items() if n > 1 and len(p) <= 64), key=lambda p: -self.groups_of[p])
                often = often[: self.resident]
                self.known, self.groups_of = {p: k for k, p in enumerate(often)}, {}
                self.lattice = Lattice.of(self.trie, often) if often else None
            return index, own
        if self.lattice is None:
            return index, own
        return index, Lattice.joined([self.lattice, own]) if own else self.lattice

    def encode(self, texts: list[str], keys: np.ndarray) -> Iterator[np.ndarray]:
        """The piece ids of each text, sampled by its key."""
        trie = self.trie
        owned = [_PART.findall(" " + text) if text else [] for text in texts]
        count = np.array([len(own) for own in owned], np.int64)
        parts = [p for own in owned for p in own]
        if not parts:
            yield from (np.empty(0, np.int64) for _ in texts)
            return
        index, lattice = self._lattice(parts)
        first = np.concatenate([[0], np.cumsum(count)])
        place = np.arange(len(parts)) - np.repeat(first[:-1], count)
        draw = mixed(np.repeat(mixed(keys.view(np.uint64)), count) + mixed(place.astype(np.uint64)))
        codes, bounds = lattice.sample(np.fromiter(map(index.__getitem__, parts), np.int64, len(parts)), draw)
        for i in range(len(texts)):
            own = codes[bounds[first[i]] : bounds[first[i + 1]]]
            if len(own) and own.max() >= len(trie.text):  # characters of several bytes that no piece covers
                spread: list[int] = []
                for c in own.tolist():
                    spread += [c] if c < len(trie.text) else trie.byte_id[list(chr(c - len(trie.text)).encode("utf-8", "surrogateescape"))].tolist()
                own = np.array(spread)
            yield own


def encode_group(trie: Trie, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
    return list(Encoder(trie).encode(texts, keys))


def decode(trie: Trie, ids: np.ndarray) -> bytes:
    """The text of the pieces, in UTF-8, without the space in front."""
    return b"".join([trie.text[k] for k in ids.tolist()])[1:]


def sampled_pieces(docs: DataFrame, model_path: str, seed: int = 0, sharpness: float = SHARPNESS, with_pieces: bool = True) -> DataFrame:
    """All columns of `docs`, and: _pieces array<int> (where asked for), _n_pieces long, _pieces_sha256 string (of the
    ids as little-endian 32-bit integers), _lossless boolean (decoding gave the text back byte by byte).

    Reads doc_id (the key of the draws) and text. Runs where the rows are, without a shuffle.
    """
    from hashlib import sha256

    rows = docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)))
    extra = "_n_pieces long, _pieces_sha256 string, _lossless boolean" + (", _pieces array<int>" if with_pieces else "")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = load(model_path, sharpness)
        encoder = _encoders.setdefault((model_path, sharpness), Encoder(trie))
        for batch in batches:
            names = batch.schema.names
            column, keys = batch.column(names.index("text")), batch.column(names.index("_key")).to_numpy()
            for at, to, data, bounds in pieces(column, GROUP_BYTES):
                raw = [bytes(data[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                texts = [x.decode("utf-8", "surrogateescape") for x in raw]
                counts, digests, same, ids = [], [], [], []
                for i, got in enumerate(encoder.encode(texts, keys[at:to])):
                    counts.append(len(got))
                    digests.append(sha256(got.astype("<i4").tobytes()).hexdigest())
                    same.append(decode(trie, got) == raw[i])
                    if with_pieces:
                        ids.append(got.astype(np.int32))
                part = batch.slice(at, to - at)
                arrays = [part.column(k) for k, name in enumerate(names) if name != "_key"]
                arrays += [pa.array(counts, pa.int64()), pa.array(digests), pa.array(same)]
                out_names = [name for name in names if name != "_key"] + ["_n_pieces", "_pieces_sha256", "_lossless"]
                if with_pieces:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                    out_names.append("_pieces")
                yield pa.RecordBatch.from_arrays(arrays, names=out_names)

    return rows.mapInArrow(task, f"{own}, {extra}")
