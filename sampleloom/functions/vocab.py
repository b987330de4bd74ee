"""Vocabularies from files: sentence-piece lists and models, plain lists, and tokenizer JSON."""

from __future__ import annotations

import json
from pathlib import Path

from sampleloom.functions.tokenize import BPEMerges, CharTrie

_SPACE = "▁"


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


def _pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a ``.vocab`` list or a ``.model``."""
    if str(path).endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
        return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    out = []
    for line in Path(path).read_text(encoding="utf-8").split("\n"):
        if line:
            piece, _, score = line.partition("\t")
            out.append((piece, float(score or 0)))
    return out


def read_trie_from_spm(path: str) -> tuple[CharTrie, list[float]]:
    """The trie and its costs, the greatest score minus each token's: low for likely tokens.

    The space mark is a space; a token that is there already gets a name of its own so
    that ids stay those of the file.
    """
    trie, scores = CharTrie(), []
    for i, (piece, score) in enumerate(_pieces(path)):
        token = piece.replace(_SPACE, " ")
        if trie.search(token) is not None:
            token = f"<0x{i:02X}>#{i}"
        trie.insert(token, i)
        scores.append(score)
    least = min(scores, default=0.0)
    return trie, [-least - s for s in scores] if least < 0 else [-s for s in scores]


def read_bpe_from_spm(path: str) -> tuple[CharTrie, BPEMerges]:
    """Symbols (tokens of one character) and merges (every cut of a longer token into two tokens)."""
    pieces = [(p.replace(_SPACE, " "), s) for p, s in _pieces(path)]
    ids = {p: i for i, (p, _) in enumerate(pieces)}
    symbols, merges = CharTrie(), BPEMerges()
    for p, i in ids.items():
        if len(p) == 1:
            symbols.insert(p, i)
        for k in range(1, len(p)):
            if p[:k] in ids and p[k:] in ids:
                merges.add(p[:k], p[k:], i)
    return symbols, merges


def read_trie_from_vocab(path: str) -> CharTrie:
    """One token on each line, ids by line."""
    trie = CharTrie()
    for i, line in enumerate(Path(path).read_text(encoding="utf-8").split("\n")):
        if line:
            trie.insert(line, i)
    return trie


def read_bpe_from_hf(path: str) -> tuple[CharTrie, BPEMerges]:
    """Symbols and merges of a tokenizer JSON with a byte-level BPE model."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    vocab: dict[str, int] = model["vocab"]
    back = {c: b for b, c in enumerate(byte_characters())}

    def raw(token: str) -> bytes:
        return bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()

    symbols, merges = CharTrie(), BPEMerges()
    for token, i in vocab.items():
        if len(token) == 1:
            symbols.insert(raw(token), i)
    for m in model["merges"]:
        left, right = m.split(" ") if isinstance(m, str) else m
        if left + right in vocab:
            merges.add(raw(left), raw(right), vocab[left + right])
    return symbols, merges
