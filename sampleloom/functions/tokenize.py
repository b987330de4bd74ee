"""Tokenizers over bytes: a trie lattice with shortest or random paths, and byte-pair merges.

The classes are plain Python without Spark; the operators at the end broadcast
them to Arrow functions, which work on runs of rows.  Where all tokens are single bytes they are
looked up, and few merges are found, in numpy; else each distinct piece of a run is computed once, frequent
ones are remembered within a worker process, and tokens are put together by numpy.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute available
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.functions.arrays import as_bytes
from sampleloom.functions.buffers import chunked_udf, flat_bytes
from sampleloom.shipping import ship
from sampleloom.types import INDEX

SHORTEST, RANDOM = "shortest", "rand"


def _raw(token: str | bytes | Sequence[int]) -> bytes:
    return token.encode() if isinstance(token, str) else bytes(token)


class TrieNode:
    """A node: ``id`` of the token that ends here or -1, ``uid`` among all nodes, and children by byte."""

    __slots__ = ("children", "id", "uid")

    def __init__(self, uid: int):
        self.children: dict[int, TrieNode] = {}
        self.id, self.uid = -1, uid

    def accepts(self) -> bool:
        return self.id >= 0


class CharTrie:
    """Tokens as paths of bytes."""

    def __init__(self):
        self.root = TrieNode(0)
        self._nodes, self._keys = 1, {}

    def insert(self, token: str | bytes, id: int = -1) -> TrieNode:
        """The token's node; one that is there keeps its id, a new one gets the number of keys where none is given."""
        node = self.root
        for b in _raw(token):
            if b not in node.children:
                node.children[b] = TrieNode(self._nodes)
                self._nodes += 1
            node = node.children[b]
        if not node.accepts():
            node.id = len(self._keys) if id < 0 else id
            self._keys[node.id] = _raw(token)
        return node

    def search(self, token: str | bytes) -> TrieNode | None:
        node = self.root
        for b in _raw(token):
            node = node.children.get(b)
            if node is None:
                return None
        return node if node.accepts() else None

    def ids(self) -> list[int]:
        return list(self._keys)

    def num_keys(self) -> int:
        return len(self._keys)

    def key(self, id: int) -> list[int]:
        return list(self._keys[id])

    def key_bytes(self, id: int) -> bytes:
        return self._keys[id]

    def key_string(self, id: int) -> str:
        return self._keys[id].decode(errors="replace")


class Lattice:
    """All tokenizations of a text: for each byte position, the tokens that end at a later one.

    Nodes are byte positions in order, so paths are found by one sweep instead of a
    general graph search.
    """

    def __init__(self, trie: CharTrie, data: bytes, ignore_unk: bool = False):
        self.data, self.size = data, len(data)
        edges, reached = self._build(trie, data)
        if ignore_unk and self.size not in reached:
            edges = self._skipping(trie, data)
        elif self.size not in reached and self.size:
            raise ValueError("the text can't be cut into tokens")
        self.edges: dict[int, list[tuple[int, int]]] = edges

    @staticmethod
    def _from(trie: CharTrie, data: bytes, at: int) -> list[tuple[int, int]]:
        node, out = trie.root, []
        for end in range(at, len(data)):
            node = node.children.get(data[end])
            if node is None:
                break
            if node.accepts():
                out.append((end + 1, node.id))
        return out

    @classmethod
    def _build(cls, trie, data):
        edges, reached = {}, {0}
        for at in range(len(data)):
            if at in reached:
                edges[at] = cls._from(trie, data, at)
                reached.update(end for end, _ in edges[at])
        return edges, reached

    @classmethod
    def _skipping(cls, trie: CharTrie, data: bytes) -> dict[int, list[tuple[int, int]]]:
        """Where no partial token goes on, the byte and all bytes since the last whole token are dropped.

        Tokens are matched in one pass over the bytes; a dead end links the last
        places where tokens ended to the byte after it.
        """
        edges: dict[int, list[tuple[int, int]]] = {}
        active: list[tuple[int, TrieNode]] = [(0, trie.root)]
        ends = {0}  # where tokens ended last
        for i, b in enumerate(data):
            nxt, done = [], False
            for start, node in active:
                child = node.children.get(b)
                if child is None:
                    continue
                nxt.append((start, child))
                if child.accepts():
                    edges.setdefault(start, []).append((i + 1, child.id))
                    done = True
            if done:
                nxt.append((i + 1, trie.root))
                ends = {i + 1}
            if not nxt:
                for at in ends:
                    edges.setdefault(at, []).append((i + 1, -1))
                nxt, ends = [(i + 1, trie.root)], {i + 1}
            active = nxt
        if len(data) not in ends:
            for at in ends:
                edges.setdefault(at, []).append((len(data), -1))
        return edges

    def _alive(self) -> list[bool]:
        """From which positions the end is reached."""
        ok = [False] * self.size + [True]
        for at in range(self.size - 1, -1, -1):
            ok[at] = any(ok[end] for end, _ in self.edges.get(at, ()))
        return ok

    def shortest(self, scores: Sequence[float] = ()) -> list[int]:
        """The tokens with the least sum of scores (each token 1 without scores); at ties the longer token first."""
        best: list[tuple[float, int, int] | None] = [None] * self.size + [(0.0, 0, -1)]
        for at in range(self.size - 1, -1, -1):
            for end, token in self.edges.get(at, ()):
                rest = best[end]
                if rest is None:
                    continue
                cost = rest[0] + (0.0 if token < 0 else scores[token] if len(scores) else 1.0)
                if best[at] is None or cost < best[at][0] or (cost == best[at][0] and end > best[at][1]):
                    best[at] = (cost, end, token)
        if best[0] is None:
            raise ValueError("the text can't be cut into tokens")
        out, at = [], 0
        while at < self.size:
            _, end, token = best[at]
            if token >= 0:
                out.append(token)
            at = end
        return out

    def rand(self, rng: random.Random) -> list[int]:
        """A random path, each step uniform among those that lead to the end."""
        ok, out, at = self._alive(), [], 0
        while at < self.size:
            at, token = rng.choice([e for e in self.edges.get(at, ()) if ok[e[0]]])
            if token >= 0:
                out.append(token)
        return out

    def dot(self) -> str:
        """The lattice in the language of graph drawing tools."""
        links = (f'  {at} -> {end} [label="{token}"];' for at, out in sorted(self.edges.items()) for end, token in out)
        return "\n".join(["digraph {", *links, "}"])

    def paths(self) -> Iterator[list[int]]:
        """Every tokenization, the longer tokens first."""
        ok = self._alive()
        stack: list[tuple[int, list[int]]] = [(0, [])]
        while stack:
            at, tokens = stack.pop()
            if at == self.size:
                yield tokens
                continue
            for end, token in sorted(self.edges.get(at, ())):
                if ok[end]:
                    stack.append((end, [*tokens, token] if token >= 0 else tokens))


class Tokenizer:
    """Tokenizations by a trie, with a score for each token where given."""

    def __init__(self, trie: CharTrie, ignore_unk: bool = False, trie_key_scores: Sequence[float] = ()):
        if len(trie_key_scores) and len(trie_key_scores) != trie.num_keys():
            raise ValueError("as many scores as tokens are needed")
        self.trie, self.ignore_unk, self.scores = trie, ignore_unk, list(trie_key_scores)

    def tokenize(self, text: str | bytes) -> Lattice:
        return Lattice(self.trie, _raw(text), self.ignore_unk)

    def tokenize_shortest(self, text: str | bytes) -> list[int]:
        return self.tokenize(text).shortest(self.scores)

    def tokenize_rand(self, text: str | bytes, seed: int = 0) -> list[int]:
        return self.tokenize(text).rand(random.Random(seed))


def tokenizer_iterator(lattice: Lattice) -> Iterator[list[int]]:
    """Every tokenization of a lattice."""
    return lattice.paths()


class BPEMerges:
    """Which two tokens make which; of several results for a pair the least stays."""

    def __init__(self):
        self._merges: dict[tuple[bytes, bytes], int] = {}

    def add(self, left: str | bytes, right: str | bytes, token: int) -> None:
        pair = (_raw(left), _raw(right))
        self._merges[pair] = min(token, self._merges.get(pair, token))

    def results(self) -> list[bytes]:
        """What each pair makes."""
        return [left + right for left, right in self._merges]

    def rules(self) -> list[tuple[tuple[bytes, bytes], int]]:
        """Each pair and the token that it makes."""
        return list(self._merges.items())

    def can_merge(self, left: str | bytes, right: str | bytes) -> int | None:
        return self._merges.get((_raw(left), _raw(right)))


class BPETokenizer:
    """Cuts a text into the longest known symbols from the left, then merges pairs, the least resulting token first.

    Equal tokens are merged from the left; an empty text has no tokens.
    """

    def __init__(self, symbols: CharTrie, merges: BPEMerges):
        self.symbols, self.merges = symbols, merges

    def _symbols(self, data: bytes) -> list[tuple[bytes, int]]:
        out, at = [], 0
        while at < len(data):
            found = Lattice._from(self.symbols, data, at)
            if not found:
                raise ValueError(f"no symbol for byte {data[at]} at {at}")
            end, token = found[-1]
            out.append((data[at:end], token))
            at = end
        return out

    def tokenize(self, text: str | bytes) -> list[int]:
        import heapq

        parts = self._symbols(_raw(text))
        n = len(parts)
        if not n:
            return []
        piece = [p for p, _ in parts]
        token = [t for _, t in parts]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                made = self.merges.can_merge(piece[i], piece[j])
                if made is not None:
                    heapq.heappush(heap, (made, i, len(piece[i]) + len(piece[j])))

        for i in range(n - 1):
            offer(i)
        while heap:
            made, i, size = heapq.heappop(heap)
            j = after[i] if piece[i] else n
            if j >= n or not piece[i] or len(piece[i]) + len(piece[j]) != size or self.merges.can_merge(piece[i], piece[j]) != made:
                continue  # one of the two was merged before
            piece[i] += piece[j]
            token[i] = made
            piece[j] = b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out


# ---------------------------------------------------------------- operators

#: Pieces of an operator that a process remembers at most, and their greatest length; others are computed anew.
_REMEMBERED, _SHORT = 100_000, 64
_known: dict[str, dict[bytes, np.ndarray]] = {}


def byte_table(trie: CharTrie) -> np.ndarray | None:
    """The token of each byte, -1 where there is none, if all tokens are single bytes."""
    if any(node.children for node in trie.root.children.values()):
        return None
    table = np.full(256, -1, np.int32)
    for b, node in trie.root.children.items():
        table[b] = node.id
    return table


def _lists(texts: pa.Array, tokens: np.ndarray, offsets: np.ndarray) -> pa.Array:
    out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens))
    return pa.compute.if_else(texts.is_null(), None, out) if texts.null_count else out


def _by_bytes(texts: pa.Array, table: np.ndarray, ignore_unk: bool) -> pa.Array:
    """The tokens of single bytes: there is one way to cut a text."""
    data, offsets = flat_bytes(texts)
    tokens = table[data]
    known = tokens >= 0
    if not known.all():
        if not ignore_unk:
            raise ValueError("the text can't be cut into tokens")
        tokens, offsets = tokens[known], np.concatenate(([0], np.cumsum(known)))[offsets]
    return _lists(texts, tokens, offsets)


#: Merges that are looked for one after the other over all texts; with more, piece by piece.
_FEW = 64


def few_merges(symbols: CharTrie, merges: BPEMerges) -> tuple[np.ndarray, list[tuple[int, list[tuple[int, int, int]]]]] | None:
    """For :func:`_merged`: the token of each byte, and for each resulting token, ascending, its (left, right, result) as numbers of byte strings.

    None where symbols are longer than a byte, where there are many merges, or where a result takes part in a merge to no
    greater token, so that tokens can't be made in ascending order.
    """
    table, rules = byte_table(symbols), [(*pair, token) for pair, token in merges.rules() if all(pair)]
    if table is None or len(rules) > _FEW:
        return None
    number = {bytes([b]): b for b in range(256)}
    for left, right, _ in rules:
        number.setdefault(left + right, len(number))
    by_token: dict[int, list[tuple[int, int, int]]] = {}
    for left, right, token in rules:
        if any(part == left + right and other <= token for a, b, other in rules for part in (a, b)):
            return None
        if left in number and right in number:
            by_token.setdefault(token, []).append((number[left], number[right], number[left + right]))
    return table, sorted(by_token.items())


def _merged(texts: pa.Array, table: np.ndarray, rules: list[tuple[int, list[tuple[int, int, int]]]]) -> pa.Array:
    """The tokens of single bytes after the merges, those of the least token in all texts first."""
    data, offsets = flat_bytes(texts)
    tokens, what = table[data], data.astype(np.int16)
    if (tokens < 0).any():
        raise ValueError(f"no symbol for byte {data[tokens < 0][0]}")
    for token, pairs in rules:
        if len(what) < 2:
            break
        made = np.full(len(what) - 1, -1, np.int16)
        for left, right, result in pairs:
            made[(what[:-1] == left) & (what[1:] == right)] = result
        begins = offsets[(offsets > 0) & (offsets < len(what))]
        made[begins - 1] = -1  # not from one text to the next
        at = np.flatnonzero(made >= 0)
        if not len(at):
            continue
        # of pairs that overlap every other one is merged, from the left
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
        at = at[place % 2 == 0]
        what[at], tokens[at] = made[at], token
        kept = np.ones(len(what), bool)
        kept[at + 1] = False
        offsets = offsets - np.searchsorted(at + 1, offsets)  # merged-away places before each
        what, tokens = what[kept], tokens[kept]
    return _lists(texts, tokens, offsets)


def _cuts_at_spaces(tokens: Iterable[bytes]) -> bool:
    """Whether no token goes on over a space, so that the pieces of a text that begin at spaces are independent."""
    return not any(b" " in t[1:] for t in tokens)


def _by_pieces(texts: pa.Array, f: Callable[[bytes], list[int]], apart: bool, name: str) -> pa.Array:
    """f of each text, or where ``apart`` the joined results of its pieces, which begin at each space.

    ``name`` tells the operator whose pieces are remembered.
    """
    data, offsets = flat_bytes(texts)
    starts = offsets[:-1][np.diff(offsets) > 0]
    if apart:
        flag = data == 32
        flag[starts] = True
        starts = np.flatnonzero(flag)
    bounds = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    if name not in _known:
        _known.clear()  # one operator's pieces at a time
        _known[name] = {}
    known, made = _known[name], []
    for piece in pieces.dictionary.to_pylist():
        tokens = known.get(piece)
        if tokens is None:
            tokens = np.array(f(piece), np.int32)
            if len(known) < _REMEMBERED and len(piece) <= _SHORT:
                known[piece] = tokens
        made.append(tokens)
    which = np.asarray(pieces.indices)
    size = np.array([len(t) for t in made], np.int64)
    table = np.concatenate(made) if made else np.zeros(0, np.int32)
    n = size[which]
    ends = np.cumsum(n)
    at = np.repeat((np.cumsum(size) - size)[which] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
    total = np.concatenate(([0], ends))[np.searchsorted(bounds[:-1], offsets)]  # tokens before each text
    return _lists(texts, table[at], total)


def tokenize(df: DataFrame, key: str, trie: CharTrie, mode: str = SHORTEST, ignore_unk: bool = False, trie_key_scores: Sequence[float] = (), output_key: str = "", seed: int = 0) -> DataFrame:
    """The text's tokens as an array of INT: those of the least score, or with mode ``rand`` those of a random path.

    Random paths depend on (seed, row order, text).  Nulls stay null.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Tokenizer(trie, ignore_unk, trie_key_scores))

    # what is dropped at a dead end may reach back over a space
    apart = not ignore_unk and _cuts_at_spaces(trie.key_bytes(i) for i in trie.ids())

    name = uuid.uuid4().hex
    table = None if len(trie_key_scores) else byte_table(trie)

    def shortest(x: pa.Array) -> pa.Array:
        if table is not None:
            return _by_bytes(x, table, ignore_unk)
        return _by_pieces(x, shared.value.tokenize_shortest, apart, name)

    def rand(x: pa.Array, row: pa.Array) -> pa.Array:
        t = shared.value
        return pa.array([None if v is None else t.tokenize_rand(v, seed * 1_000_003 + i) for v, i in zip(x.to_pylist(), row.to_pylist())], pa.list_(pa.int32()))

    kind = T.ArrayType(T.IntegerType())
    x = as_bytes(df, key)
    if mode == SHORTEST:
        made = chunked_udf(shortest, kind).asNondeterministic()(x)
    else:
        row = F.col(INDEX).cast("long") if INDEX in df.columns else F.xxhash64(x)
        made = chunked_udf(rand, kind).asNondeterministic()(x, row)
    return df.withColumn(output_key or key, made)


def tokenize_bpe(df: DataFrame, key: str, symbols: CharTrie, merges: BPEMerges, output_key: str = "") -> DataFrame:
    """The text's tokens after merging, as an array of INT.  Nulls stay null."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(BPETokenizer(symbols, merges))

    apart = _cuts_at_spaces([*(symbols.key_bytes(i) for i in symbols.ids()), *merges.results()])

    name = uuid.uuid4().hex
    few = few_merges(symbols, merges)

    def one(x: pa.Array) -> pa.Array:
        if few is not None:
            return _merged(x, *few)
        return _by_pieces(x, shared.value.tokenize, apart, name)

    return df.withColumn(output_key or key, chunked_udf(one, T.ArrayType(T.IntegerType())).asNondeterministic()(as_bytes(df, key)))


def all_tokenizations(df: DataFrame, key: str, trie: CharTrie, output_key: str = "tokens") -> DataFrame:
    """One row for each tokenization of the text."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(trie)

    def one(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else list(Lattice(shared.value, v).paths()) for v in x.to_pylist()], pa.list_(pa.list_(pa.int32())))

    kind = T.ArrayType(T.ArrayType(T.IntegerType()))
    return df.withColumn(output_key, F.explode(chunked_udf(one, kind).asNondeterministic()(as_bytes(df, key))))
