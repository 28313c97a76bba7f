"""Exact token counts at every prefix, from the prefix recurrence of a sentencepiece BPE model."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from stormglass.llm.bpe import KEPT, LONG, TOGETHER, PrefixTable, restore_id, select_text

SPACE = "▁"


class PieceCounts:
    """Counts of a sentencepiece BPE model with byte fallback and identity normalisation.

    The model's merges are not stored: any two neighbours whose joined string is a piece may
    merge, the piece with the best score first. The split of each piece is found by merging
    its characters. Pieces that merging can't reach are never produced and are left out.
    No piece holds a space mark after another character, so a text falls apart into words,
    each with one mark before it; runs of marks are counted apart.
    """

    def __init__(self, path: str):
        import regex
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        piece = {i: model.id_to_piece(i) for i in usable}
        if any(SPACE in p.lstrip(SPACE) for p in piece.values()):
            raise ValueError("pieces with inner spaces are not supported")
        self.runs = {len(p) for p in piece.values() if not p.strip(SPACE)}
        words = {p: i for i, p in piece.items() if len(p) == 1 or p.strip(SPACE)}
        order = sorted(words.values(), key=lambda i: (-model.get_score(i), i))
        rank = {i: k if len(piece[i]) > 1 else -1 for k, i in enumerate(order)}
        parts: dict[int, tuple[int, int]] = {}
        merge: dict[tuple[int, int], int] = {}
        reached = {p: i for p, i in words.items() if len(p) == 1}
        for i in order:  # parts come before wholes
            p = piece[i]
            if len(p) > 1 and (two := self._last_merge(p, words, rank)):
                parts[i], reached[p] = two, i
        for i in reached.values():
            p = piece[i]
            for at in range(1, len(p)):
                if (a := words.get(p[:at])) is not None and (b := words.get(p[at:])) is not None:
                    merge[a, b] = rank[i]
        self.table = PrefixTable({i: p.encode() for p, i in reached.items()}, parts, rank, merge)
        self.mark = int(words[SPACE])
        self.chunks = regex.compile(f"({SPACE}*)([^{SPACE}]*)").findall
        self.known: dict[str, int] = {}
        self.alone: set[str] = set()

    @staticmethod
    def _last_merge(p: str, words: dict[str, int], rank: dict[int, int]) -> tuple[int, int] | None:
        """The two tokens that merging p's characters joins last, if it ends in one token."""
        symbols = list(p)
        while len(symbols) > 2:
            options = [(rank[t], k) for k in range(len(symbols) - 1) if (t := words.get(symbols[k] + symbols[k + 1])) is not None]
            if not options:
                return None
            k = min(options)[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        two = [words.get(s) for s in symbols]
        return (two[0], two[1]) if None not in two else None

    def _run(self, n: int) -> int:
        """Tokens of n marks in a row: the leftmost pair merges first, as all run pieces score alike."""
        longest = max(self.runs, default=1)
        sizes: list[int] = []
        rest, whole = n, 0
        if n > 4 * longest:  # full pieces settle from the left
            whole = n // longest - 2
            rest = n - whole * longest
        sizes = [1] * rest
        while (k := next((k for k in range(len(sizes) - 1) if sizes[k] + sizes[k + 1] in self.runs), None)) is not None:
            sizes[k : k + 2] = [sizes[k] + sizes[k + 1]]
        return whole + len(sizes)

    def prefix_counts(self, word: str, marks: int = 1) -> list[int]:
        """Tokens of every prefix of `marks` space marks and a word, from none to all of its characters."""
        counts, first, _, _ = self.table.prefix_counts([(SPACE + word).encode()])
        ends = np.cumsum([len(c.encode()) for c in SPACE + word])[1:]
        own = counts[ends]
        # the last mark joins the word, or stays a token of the run of marks
        inside = np.where(first[ends] == self.mark, own - 1 + self._run(marks), own + self._run(marks - 1))
        return [self._run(k) for k in range(1, marks + 1)] + inside.tolist()

    def _learn(self, words: set[str]) -> None:
        """Remember the tokens of a mark followed by each word, and whether the mark stays a token of its own.

        Both are read off the end of the word's prefix table.
        """
        new = sorted(words - self.known.keys(), key=lambda w: -len(w.encode()))
        long = next((n for n, w in enumerate(new) if len(w.encode()) + 3 <= 4 * LONG), len(new))
        for some in [*([w] for w in new[:long]), *(new[k : k + (1 << 14)] for k in range(long, len(new), 1 << 14))]:
            counts, first, base, lengths = self.table.prefix_counts([(SPACE + w).encode() for w in some])
            for word, n, token in zip(some, counts[base + lengths].tolist(), first[base + lengths].tolist(), strict=True):
                self.known[word] = n
                if token == self.mark:
                    self.alone.add(word)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of every text."""
        if len(self.known) > KEPT:
            self.known, self.alone = {}, set()
        plan, words = [], set()
        for text in texts:
            simple = bool(text) and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " "
            parts = text.split(" ") if simple else self.chunks(SPACE + text.replace(" ", SPACE)) if text else []
            plan.append((simple, parts))
            words.update(parts if simple else (w for _, w in parts))
        words.discard("")
        self._learn(words)
        out = [sum(map(self.known.__getitem__, parts)) if simple else sum(itertools.starmap(self._chunk, parts)) for simple, parts in plan]
        for long in [w for w in words if len(w) > LONG]:
            del self.known[long]
        return out

    def _chunk(self, marks: str, word: str) -> int:
        if not word:
            return self._run(len(marks))
        if word in self.alone:
            return self.known[word] - 1 + self._run(len(marks))
        return self.known[word] + self._run(len(marks) - 1)

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def truncate(self, text: str, limit: int) -> str:
        """The longest prefix of text with at most `limit` tokens.

        Each chunk (space marks and a word) has one token at least, so counts at chunk ends
        grow; the cut lies in the last chunk that begins below the limit, and that chunk's
        table of prefix counts tells where. Nothing is encoded again.
        """
        before = begin = 0
        for marks, word in self.chunks(SPACE + text.replace(" ", SPACE)):
            if not marks and not word:
                break
            if word and word not in self.known:
                self._learn({word})
            n = self._chunk(marks, word)
            if before + n > limit:
                fits = [k for k, c in enumerate(self.prefix_counts(word, len(marks)), 1) if before + c <= limit]
                return text[: max(0, begin + max(fits, default=0) - 1)]  # one mark stands before the text
            before, begin = before + n, begin + len(marks) + len(word)
        return text


@lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    """The model's tables, built once a worker."""
    return PieceCounts(path)


def count_tokens(docs: DataFrame, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), fit_bytes.

    fit_bytes: bytes of the longest prefix with at most `limit` tokens, from the prefix counts.

    model: path of a sentencepiece BPE model that every worker can open. No begin or end
    token is counted; strings that look like special tokens are plain text. Null texts count
    as empty, with 0 tokens; null ids stay null; rows that repeat id and text get equal
    results. One pass without a shuffle, bounded memory; other columns are not read, an empty
    table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = piece_counts(model)
        for batch in batches:
            for k in range(0, len(batch), TOGETHER):
                some = batch.iloc[k : k + TOGETHER]
                texts = some["text"].tolist()
                n = np.array(counts.counts(texts), np.int64)
                yield pd.DataFrame({"id": some["id"].to_numpy(), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": n > limit, "fit_bytes": [len((t if m <= limit else counts.truncate(t, limit)).encode()) for t, m in zip(texts, n.tolist(), strict=True)]})

    schema = "id string, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long"
    return restore_id(select_text(docs, id_col, text_col).mapInPandas(run, schema), id_col, kind)
