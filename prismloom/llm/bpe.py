"""Byte-level BPE encoding and decoding; words share the work on their common prefixes.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours stay two tokens when
their bytes are encoded together. So the last token of the encoding of a prefix is the only token that
ends the prefix and stands well after the last token of what precedes it. The words of a batch form a
trie; a depth-first walk notes the last token at every node, from the last tokens on the path to it,
and a word's encoding is read by stepping back through them. A prefix that many words share is
walked once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismloom.llm.storage import small_batches, table
from prismloom.llm.words import slices

#: The split of text into words that byte-level BPE files of this kind imply,
#: for texts of ASCII alone (the same, in terms that match faster) and for all.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encodings, and pairs of tokens whose verdicts, a Python worker remembers between batches; beyond, it forgets all.
REMEMBERED, REMEMBERED_PAIRS = 600_000, 400_000
#: Words that it keeps when a task has ended.
KEPT = 150_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens of a byte-level BPE file in the JSON format of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        model = spec["model"]
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.bytes = dict(map(reversed, self.ids.items()))
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(self.ids[as_bytes(a)], self.ids[as_bytes(b)]): (rank, self.ids[as_bytes(a + b)]) for rank, (a, b) in enumerate(pairs)}
        #: Of a merged token its parts and rank; what is no merge's result is its own parts, before all ranks.
        self.parts: dict[int, tuple[int, int, int]] = {}
        for (left, right), (rank, token) in self.merges.items():
            self.parts.setdefault(token, (left, right, rank))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        #: The bytes of all tokens, one after the other, and where an id's begin and how many they are.
        self.table = np.frombuffer(b"".join(self.bytes.values()), dtype=np.uint8)
        self.sizes, self.starts = np.zeros((2, max(self.bytes) + 1), dtype=np.int64)
        self.sizes[list(self.bytes)] = [len(t) for t in self.bytes.values()]
        self.starts[list(self.bytes)] = np.cumsum([0, *map(len, self.bytes.values())])[:-1]
        self.words, self.ascii_words = regex.compile(WORD_PATTERN), re.compile(ASCII_PATTERN)
        by_length = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}  # ids as four bytes each

    @cached_property
    def endings(self) -> dict[bytes, int]:
        """Every end of a token, and the token that it is, or -1 if it is none or its bytes don't encode to itself."""
        whole = {t: i for t, i in self.ids.items() if self.merged([self.ids[bytes([x])] for x in t]) == [i]}
        return {t[i:]: -1 for t in whole for i in range(1, len(t))} | whole

    def rest(self) -> None:
        """Forgets what a large task has learnt, so an idle worker holds little."""
        if len(self.known) > KEPT:
            self.known, self.apart = {}, {}

    def merged(self, ids: list[int]) -> list[int]:
        """Plain BPE: merge the pair of least rank, leftmost first, until none is left."""
        ids = list(ids)
        while len(ids) > 1:
            rank, i = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges), default=(-1, -1))
            if i < 0:
                break
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together encode to just these two tokens.

        The merges that make them are undone, the latest first. Something would have merged across the
        border if the tokens at the border, at some time, were a pair of an earlier rank than what made the
        next of them.
        """
        merges, parts = self.merges, self.parts
        bound = 1 << 60
        while True:
            pair = merges.get((a, b))
            if pair is not None and pair[0] < bound:
                return False
            of_a, of_b = parts.get(a), parts.get(b)
            if of_a is None and of_b is None:
                return True
            # At equal ranks (equal tokens) the left one was made first, so the right one is undone first.
            if of_b is None or of_a is not None and of_a[2] > of_b[2]:
                a, bound = of_a[1], of_a[2]
            else:
                b, bound = of_b[0], of_b[2] + 1

    def learn(self, words: set[str]) -> None:
        """Encode words, all together."""
        endings, apart = self.endings, self.apart
        before = b""
        last: list[int] = []  # of each prefix on the path, the last token and its length
        size: list[int] = []
        for word, text in sorted((w.encode(), w) for w in words):
            n = len(word)
            depth, most = 0, min(len(before), n)
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del last[depth:], size[depth:]
            for end in range(depth + 1, n + 1):
                first = end - 1
                while first >= 0 and word[first:end] in endings:
                    first -= 1
                for start in range(first + 1, end):
                    token = endings[word[start:end]]
                    if token < 0:
                        continue
                    if start:
                        pair = last[start - 1] << 20 | token
                        fits = apart.get(pair)
                        if fits is None:
                            if len(apart) > REMEMBERED_PAIRS:
                                apart.clear()
                            fits = apart[pair] = self.stay_apart(last[start - 1], token)
                        if not fits:
                            continue
                    last.append(token)
                    size.append(end - start)
                    break
                else:
                    raise ValueError(f"the vocabulary can't encode {word[:end]!r}")
            out, end = [], n
            while end:
                out.append(last[end - 1])
                end -= size[end - 1]
            self.known[text] = pack(f"<{len(out)}I", *reversed(out))
            before = word

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where those of each text end."""
        pieces = [[p for p in self.split.split(t) if p] if self.split else [t] for t in texts]
        words = [list(chain.from_iterable((p,) if p in self.special else (self.ascii_words if p.isascii() else self.words).findall(p) for p in parts)) for parts in pieces]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known |= {t: pack("<I", i) for t, i in self.special.items()}
        self.learn(set(chain.from_iterable(words)) - self.known.keys())
        get = self.known.__getitem__
        joined = [b"".join(map(get, w)) for w in words]
        return np.frombuffer(b"".join(joined), dtype="<i4"), np.cumsum([0, *(len(j) // 4 for j in joined)])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of sequences of ids, given one after the other."""
        sizes = self.sizes[ids]
        at = np.concatenate([[0], np.cumsum(sizes)])
        data = self.table[np.repeat(self.starts[ids] - at[:-1], sizes) + np.arange(at[-1])].tobytes()
        bounds = at[ends].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once a worker."""
    return Vocabulary(path)


def _with_column(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` {kind}"])


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text; a null or empty text has none.

    The file at ``path`` must be on every worker, as a library's data files are. ``into`` must be a new
    name; all other columns and repeated rows stay as they are.
    """
    if into in df.columns:
        raise ValueError(f"column {into} is there already")
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            for piece in slices(batch, text):
                flat, ends = own.encode([t or "" for t in piece.column(at).to_pylist()])
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*piece.columns, column], [*piece.schema.names, into])
        own.rest()

    return df.mapInArrow(run, _with_column(df, into, "array<int>"))


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text that each array of ids stands for; null ids stand for the empty text."""
    if into in df.columns:
        raise ValueError(f"column {into} is there already")
    small_batches(df.sparkSession)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column(at)).fill_null(0))
            total, lo = np.cumsum(sizes), 0
            while lo < len(batch):
                # Slices of about half a million ids, a row each at least.
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 500_000, side="right")))
                piece = batch.slice(lo, hi - lo)
                texts = own.decode(np.asarray(piece.column(at).flatten(), dtype=np.int64), np.cumsum([0, *sizes[lo:hi]]))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], [*piece.schema.names, into])
                lo = hi

    return df.mapInArrow(run, _with_column(df, into, "string"))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds both the token ids of each whole text and the text that these ids stand for.

    The same columns as ``decode(encode(df))``, from one visit to the rows: a task then needs one Python
    worker, with one vocabulary, instead of two, and the ids don't travel between them. Both names must be new.
    """
    if {ids, decoded} & set(df.columns) or ids == decoded:
        raise ValueError(f"columns {ids} or {decoded} are there already")
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            for piece in slices(batch, text):
                flat, ends = own.encode([t or "" for t in piece.column(at).to_pylist()])
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                back = pa.array(own.decode(flat, ends), pa.string())
                yield pa.RecordBatch.from_arrays([*piece.columns, found, back], [*piece.schema.names, ids, decoded])
        own.rest()

    return df.mapInArrow(run, f"{_with_column(df, ids, 'array<int>')}, `{decoded}` string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    both = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op2_bpe": op2_bpe}
ORACLE_SQL: dict[str, str] = {}
