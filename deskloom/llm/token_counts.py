"""Token counts of texts by heap-and-linked-list byte-pair merging.

A text is split into pieces as the vocabulary's file says; a piece starts as its
UTF-8 bytes in a linked list. A heap holds the adjacent pairs that the
vocabulary merges, by rank and then place: the lowest is popped and merged if it
still stands, and the two pairs it makes are pushed, O(n log n) for a piece of n
bytes. The count of a piece is its bytes minus its merges; no identifier is
made. A worker remembers the counts of pieces, as words repeat.

Files: byte-level pair encodings of the `tokenizers` library (.json). Others
raise ValueError, so that no text is counted by other rules than the file's.
Added tokens of the file count one where their string stands, as the library
does by default.

Cases: a null or empty text has 0 bytes and 0 tokens. Repeated rows give equal
results. An empty table gives an empty result. Further columns are ignored. A
text is counted whole, however long; it is split a window at a time, cut where a
piece ends in any case.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COUNTS = "id long, n_bytes long, n_tokens long"
REMEMBERED = 1_000_000  # pieces whose counts a worker keeps at a time
WINDOW = 1_000_000  # characters split at once

# Texts of these characters are split by a pattern made from their categories, which all
# Unicode versions agree on; others by the library's own splitter.
_PLAIN = [*range(0x250), *range(0x2010, 0x2028), *range(0x20A0, 0x20AD)]
_PLAIN_TEXT = re.compile(r"[\x00-ɏ‐-‧₠-€]*")
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0"


def _splitter() -> re.Pattern:
    """Pieces of plain texts: a short ending, or letters, digits or signs with at most one space before, or blanks."""

    def listed(kind: str) -> str:
        return "".join(re.escape(c) for c in map(chr, _PLAIN) if unicodedata.category(c)[0] == kind)

    letters, digits, blanks = listed("L"), listed("N"), re.escape(_BLANKS)
    return re.compile(
        rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{blanks}{letters}{digits}]+"
        rf"|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
    )


def windows(text: str, size: int) -> Iterator[str]:
    """Parts of a text that end where a blank follows a sign that is none, so that no piece is cut."""
    first = 0
    while len(text) - first > size:
        at = first + size
        while at < len(text) and (not text[at].isspace() or text[at - 1].isspace()):
            at += 1
        yield text[first:at]
        first = at
    if first < len(text):
        yield text[first:]


class Counter(dict):
    """Token count by piece, made when first asked for."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, splits = told.get("model", {}), told.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and splits.get("type") == "ByteLevel" and splits.get("use_regex", True)
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if not plain or splits.get("add_prefix_space") or told.get("normalizer") or any(model.get(key) for key in odd):
            raise ValueError(f"{path} is no plain byte-level pair encoding")
        added = told.get("added_tokens") or []
        if any(token[key] for token in added for key in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        from tokenizers import pre_tokenizers

        names = sorted((token["content"] for token in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        # Signs that stand for bytes in the file: each printable Latin-1 sign for itself, then 256 and on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in set(shown)]
        self.sign = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        place = {token: i for i, token in enumerate(model["vocab"])}
        self.symbol = [0] * 256
        for sign, byte in self.sign.items():
            self.symbol[byte] = place[sign]
        merges = [tuple(pair.split(" ") if isinstance(pair, str) else pair) for pair in model["merges"]]
        self.rank = {(place[a], place[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = [place[a + b] for a, b in merges]
        self.splits = _splitter()
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def __missing__(self, piece: str) -> int:
        found = self[piece] = self.merged(piece.encode())
        return found

    def merged(self, piece: bytes) -> int:
        """Symbols that are left of a piece when nothing can be merged."""
        n = len(piece)
        if n == 1:
            return 1
        symbols, made, rank = [*map(self.symbol.__getitem__, piece)], self.made, self.rank.get
        # The rank of the pair that begins at each place, None if it can't be merged.
        pairs = [*map(rank, zip(symbols, symbols[1:]))]  # noqa: B905
        heap = [(own, at) for at, own in enumerate(pairs) if own is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        pairs.append(None)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        left = n
        while heap:
            own, at = pop(heap)
            if pairs[at] != own:
                continue  # one of its symbols has been merged since
            left -= 1
            symbols[at] = symbol = made[own]
            right = after[at]
            pairs[right] = pairs[at] = None
            after[at] = right = after[right]
            if right < n:
                before[right] = at
                pairs[at] = own = rank((symbol, symbols[right]))
                if own is not None:
                    push(heap, (own, at))
            earlier = before[at]
            if earlier >= 0:
                pairs[earlier] = own = rank((symbols[earlier], symbol))
                if own is not None:
                    push(heap, (own, earlier))
        return left

    def pieces(self, text: str) -> list[str]:
        if _PLAIN_TEXT.fullmatch(text):
            return self.splits.findall(text)
        sign = self.sign
        return [bytes(map(sign.__getitem__, piece)).decode() for piece, _ in self.library.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        parts = self.added.split(text) if self.added else [text]
        total = len(parts) - 1
        for part in parts:
            for window in windows(part, WINDOW) if len(part) > WINDOW else (part,):
                total += sum(map(self.__getitem__, self.pieces(window)))
        return total


_COUNTERS: dict[str, Counter] = {}  # of this worker, by file


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def counts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row (id, text); vocabulary is a file every machine has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_of: Callable[[str], int] = counter(vocabulary).count
        for part, texts in common.unpacked(batches):
            tokens = [count_of((text or b"").decode(errors="replace")) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array([len(text or b"") for text in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                ],
                ["id", "n_bytes", "n_tokens"],
            )

    return documents.select("id", F.col("text").cast("string").alias("text")).mapInArrow(count, COUNTS)
