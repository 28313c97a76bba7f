"""Exact BPE by dynamic programming over prefixes.

For every prefix of a piece of text exactly one last token is possible: the one that ends
there and is compatible with the last token of the prefix before it. An automaton over the
vocabulary lists the tokens that are suffixes of each prefix; a test of pairs picks the one;
back-pointers from the end give the ids, and the token counts of all prefixes come for free.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings of up to LONG characters that a worker remembers, some 30 MB; the store is emptied when full.
KEPT = 1 << 17
#: Slots of the store of tested pairs; a newer pair takes the slot of an older one.
PAIR_SLOTS = 1 << 20
#: Strings longer than this are not remembered.
LONG = 64
#: Documents that are encoded together, so that their new pieces share numpy steps.
TOGETHER = 512


class PrefixTable:
    """A vocabulary with its merges, for the prefix recurrence over bytes.

    strings: token id -> its bytes. parts: token id -> (left id, right id) of the merge that
    makes it, absent for base tokens. rank: token id -> place of that merge in the order of
    merging. merge: (left id, right id) -> rank of the merge of that pair.
    """

    def __init__(self, strings: dict[int, bytes], parts: dict[int, tuple[int, int]], rank: dict[int, int], merge: dict[tuple[int, int], int]):
        self.parts, self.rank, self.merge = parts, rank, merge
        self.edges: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        top = max(strings) + 1
        self.size = np.ones(top + 1, np.int32)  # the last entry stands for -1, a lone byte
        for token, string in strings.items():
            self.size[token] = len(string)
        self._automaton(strings, top)
        self.pair_key = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_apart = np.zeros(PAIR_SLOTS, bool)

    def _automaton(self, strings: dict[int, bytes], top: int) -> None:
        """step[state, byte] is the next state, ends[state] the longest token that is a suffix
        of what was read, shorter[token] the next token that is a suffix of it; -1 if none."""
        child: list[dict[int, int]] = [{}]
        token_at: dict[int, int] = {}
        for token, string in strings.items():
            node = 0
            for byte in string:
                if byte not in child[node]:
                    child[node][byte] = len(child)
                    child.append({})
                node = child[node][byte]
            token_at[node] = token
        self.step = np.zeros((len(child), 256), np.int32)
        self.ends = np.full(len(child), -1, np.int32)
        self.shorter = np.full(top + 1, -1, np.int32)
        level, suffix = [0], {0: 0}
        while level:
            below = []
            for node in level:
                back = suffix.pop(node)
                if node:
                    self.step[node] = self.step[back]
                    self.ends[node] = self.ends[back]
                    if node in token_at:
                        self.shorter[token_at[node]] = self.ends[back]
                        self.ends[node] = token_at[node]
                for byte, to in child[node].items():
                    suffix[to] = self.step[back, byte] if node else 0
                    self.step[node, byte] = to
                    below.append(to)
            level = below

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The tokens that stand at one edge while `token` is being built, with the rank of the merge that ends each."""
        chain = self.edges.get((token, right))
        if chain is None:
            chain = self.edges[token, right] = []
            end = float("inf")
            while token in self.parts:
                chain.append((token, end))
                end, token = self.rank[token], self.parts[token][right]
            chain.append((token, end))
        return chain

    def apart(self, left: int, right: int) -> bool:
        """Whether encoding the joined strings of two tokens gives those two tokens.

        They stay apart unless some symbol at the right edge of the first and one at the left
        edge of the second merge before either is used up. On equal ranks the leftmost merge
        goes first, so the left symbol must be outlived strictly.
        """
        merge, edge = self.merge, self.edge(right, False)
        for a, ends_a in self.edge(left, True):
            for b, ends_b in edge:
                if (a, b) in merge:
                    m = merge[a, b]
                    if m < ends_a and m <= ends_b:
                        return False
        return True

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """apart() for many pairs; a left token of -1 goes with any."""
        key = (left.astype(np.int64) << 24) | right
        slot = ((key * 0x9E3779B97F4A7C1) >> 20) & (PAIR_SLOTS - 1)
        fits = self.pair_apart[slot]
        new = (self.pair_key[slot] != key) & (left >= 0)
        if new.any():
            keys, back = np.unique(key[new], return_inverse=True)
            tested = np.fromiter((self.apart(k >> 24, k & 0xFFFFFF) for k in keys.tolist()), bool, len(keys))
            at = ((keys * 0x9E3779B97F4A7C1) >> 20) & (PAIR_SLOTS - 1)
            self.pair_key[at], self.pair_apart[at] = keys, tested
            # two keys may share a slot: the stored flag must be the stored key's
            self.pair_apart[at] = tested[np.searchsorted(keys, self.pair_key[at])]
            fits[new] = tested[back]
        return fits | (left < 0)

    def last_tokens(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last, base, lengths): last[base[k] + p] is the last token of the first p bytes of piece k.

        -1 is a byte that no token covers: it stands alone and merges with nothing. All pieces
        advance together, one byte a step; pieces must come longest first.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(lengths) - lengths
        base = begins + np.arange(len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        last = np.full(int(lengths.sum()) + len(pieces), -1, np.int32)
        state = np.zeros(len(pieces), np.int32)
        active = len(pieces)
        for p in range(int(lengths[0]) if active else 0):
            while lengths[active - 1] <= p:
                active -= int(np.count_nonzero(lengths[:active] <= p))
            state = self.step[state[:active], data[begins[:active] + p]]
            token = self.ends[state]
            open_ = np.flatnonzero(token >= 0)
            token = token[open_]
            while len(open_):
                before = last[base[open_] + (p + 1 - self.size[token])]
                fits = self.compatible(before, token)
                last[base[open_[fits]] + p + 1] = token[fits]
                token, open_ = self.shorter[token[~fits]], open_[~fits]
                more = token >= 0
                token, open_ = token[more], open_[more]
        return last, base, lengths

    def prefix_counts(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(counts, first, base, lengths): counts[base[k] + p] is the number of tokens of the first p
        bytes of piece k, first[base[k] + p] the first of them. Each follows from the last token
        of the prefix and the entry before that token. Pieces must come longest first."""
        if pieces and len(pieces[0]) > 4 * LONG:  # one long piece, so that short ones don't wait for it
            last, base, lengths = self._long(pieces[0]), np.zeros(1, np.int64), np.array([len(pieces[0])])
            if len(pieces) > 1:
                raise ValueError("long pieces come alone")
        else:
            last, base, lengths = self.last_tokens(pieces)
        counts, first = np.zeros(len(last), np.int32), np.full(len(last), -1, np.int32)
        for p in range(1, int(lengths.max(initial=0)) + 1):
            at = base[: np.searchsorted(-lengths, -p, side="right")] + p
            token = last[at]
            before = at - self.size[token]
            counts[at] = counts[before] + 1
            first[at] = np.where(counts[before] == 0, token, first[before])
        return counts, first, base, lengths

    def _long(self, piece: bytes) -> np.ndarray:
        """last_tokens() of one long piece, byte by byte."""
        last, state, sizes, tested = [-1] * (len(piece) + 1), 0, self.size, {}
        for p, byte in enumerate(piece, 1):
            state = self.step[state, byte]
            token = int(self.ends[state])
            while token >= 0:
                before = last[p - int(sizes[token])]
                if before < 0:
                    break
                fits = tested.get((before, token))
                if fits is None:
                    fits = tested[before, token] = self.apart(before, token)
                if fits:
                    break
                token = int(self.shorter[token])
            last[p] = token
        return np.array(last, np.int32)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of every piece as little-endian 32-bit integers, by back-pointers from its end."""
        order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k]))
        out = [b""] * len(pieces)
        n_long = next((n for n, k in enumerate(order) if len(pieces[k]) <= 4 * LONG), len(order))
        for k in order[:n_long]:
            last, at, ids = self._long(pieces[k]), len(pieces[k]), []
            while at:
                ids.append(int(last[at]))
                at -= int(self.size[last[at]])
            out[k] = np.array(ids[::-1], "<i4").tobytes()
        for k in range(n_long, len(order), 1 << 15):
            some = order[k : k + (1 << 15)]
            last, base, at = self.last_tokens([pieces[i] for i in some])
            columns, left, width = [], np.flatnonzero(at), 0
            n = np.zeros(len(some), np.int64)
            while len(left):
                token = last[base[left] + at[left]]
                columns.append(np.zeros(len(some), "<i4"))
                columns[-1][left] = token
                at[left] -= self.size[token]
                n[left] += 1
                left = left[at[left] > 0]
            width = 4 * len(columns)
            packed = np.stack(columns[::-1], axis=1).tobytes() if columns else b""
            ends = range(width, width * (len(some) + 1), width) if width else [0] * len(some)
            for i, end, size in zip(some, ends, (4 * n).tolist(), strict=True):
                out[i] = packed[end - size : end]
        return out


#: Text that byte-level vocabularies cut before merging: contractions, words, numbers, other runs, white space.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> list[str]:
    """The printable character by which byte-level vocabularies name each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class ByteBPE:
    """A byte-level BPE vocabulary in the file format of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        byte_of = {name: b for b, name in enumerate(byte_names())}
        raw = {token: bytes(byte_of[c] for c in name) for name, token in vocab.items()}
        parts, rank, merge = {}, {}, {}
        for place, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            token = vocab[left + right]
            merge[vocab[left], vocab[right]] = place
            if token not in parts:
                parts[token], rank[token] = (vocab[left], vocab[right]), place
        self.table = PrefixTable({t: b for t, b in raw.items()}, parts, rank, merge)
        self.split = regex.compile(BYTE_LEVEL_PATTERN).findall
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.bytes_of = [b""] * (max([*raw, *self.special.values()]) + 1)
        for token, b in [*raw.items(), *((t, s.encode()) for s, t in self.special.items())]:
            self.bytes_of[token] = b
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _learn(self, pieces: Iterable[str]) -> list[str]:
        """Put the ids of all pieces into the store; those that it did not have are returned."""
        new = list(set(pieces) - self.pieces.keys())
        self.pieces.update(zip(new, self.table.encode([p.encode() for p in new]), strict=True))
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, as little-endian unsigned 32-bit integers.

        Where white space is single spaces and newlines inside the text, it falls apart before
        each space, and its words are looked up with that space; other texts are cut by the
        pattern as a whole. Words and pieces are kept for later texts, but for those of more
        than LONG characters, so both stores are bounded in bytes.
        """
        plan, words, rest = [], set(), set()
        for text in texts:
            parts = text.split(" ")
            # equal lists, not equal counts: other white space and empty parts can cancel out
            if text.split() == (text.replace("\n", " ").split(" ") if "\n" in text else parts) and not any(s in text for s in self.special):
                head = self.split(parts[0])
                del parts[0]
                words.update(parts)
                plan.append((head, parts))
                rest.update(head)
            else:
                parts = self._parts(text)
                rest.update(p for p in parts if isinstance(p, str))
                plan.append((parts, []))
        new = list(words - self.words.keys())
        pieces_of = [[" " + w] if w.isalpha() else self.split(" " + w) for w in new]
        learned = self._learn(itertools.chain(rest, *pieces_of))
        look = self.pieces.__getitem__
        self.words.update(zip(new, [look(ps[0]) if len(ps) == 1 else b"".join(map(look, ps)) for ps in pieces_of], strict=True))
        out = [
            b"".join([*(x.to_bytes(4, "little") if isinstance(x, int) else look(x) for x in head), *map(self.words.__getitem__, tail)])
            for head, tail in plan
        ]
        for store, some, most in ((self.words, new, KEPT), (self.pieces, learned, KEPT // 4)):
            if len(store) > most:
                store.clear()
            else:
                for long in [x for x in some if len(x) > LONG]:
                    store.pop(long, None)
        return out

    def _parts(self, text: str) -> list[str | int]:
        """The pieces of a text; special tokens as their ids."""
        out: list[str | int] = []
        for k, part in enumerate(self.cut(text) if self.special else [text]):
            out += [self.special[part]] if k % 2 else self.split(part)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    """The vocabulary, loaded once a worker."""
    return ByteBPE(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Per row of docs: id, n_tokens, ids_sha256, decoded_sha256 and, if ids, token_ids and decoded.

    vocabulary: path of a byte-level BPE file, which every worker can open. Special tokens in
    a text become their ids, as the tokenizers library does. Null texts count as empty and
    have no tokens, null ids are ids like any other, rows that repeat give equal rows, and an
    empty table gives none. One pass without a shuffle; a task holds one Arrow batch and a bounded
    store of pieces, so a lost task is only run again. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = "id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, decoded string" * ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        bpe = byte_bpe(vocabulary)
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids", "decoded"] * ids
        for batch in batches:
            for k in range(0, len(batch), TOGETHER):
                some = batch.iloc[k : k + TOGETHER]
                rows = []
                for key, packed in zip(some["id"], bpe.encode(some["text"].tolist()), strict=True):
                    decoded = bpe.decode(packed)
                    row = (key, len(packed) // 4, sha256(packed).hexdigest(), sha256(decoded.encode()).hexdigest())
                    rows.append(row + ((np.frombuffer(packed, "<i4"), decoded) if ids else ()))
                yield pd.DataFrame(rows, columns=names)

    return restore_id(select_text(docs, id_col, text_col).mapInPandas(run, schema), id_col, kind)


def select_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, as a string (pandas has no integers with nulls), and text, empty where null."""
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("string").alias("id"), text.alias("text"))


def restore_id(rows: DataFrame, id_col: str, kind: str) -> DataFrame:
    """rows with the column id in its own type and under its own name."""
    rest = [c for c in rows.columns if c != "id"]
    return rows.select(F.col("id").cast(kind).alias(id_col), *rest)
