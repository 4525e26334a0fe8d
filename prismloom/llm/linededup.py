"""Line dedup by content-defined chunks of lines, and by all runs of lines that just pass 50 words.

A line ends at a line feed or after a sentence. A rolling hash over the hashes of two neighbouring lines
says where chunks end, so boundaries depend on nearby content only, and a passage is cut alike in whatever
document and place it stands. Several layers, each with boundaries of its own, find most repeated passages,
short ones too. So that none of over 50 words is missed, whatever stands around it, the shortest run of
over 50 words from each line on, and the shortest up to each line, are chunks as well: those inside a
passage cover it to its last line. A whole text is a chunk too, so of equal texts only the first is looked at.

A chunk can occur again only if all its pairs of neighbouring lines do, so chunks are made where pairs do. Those
whose hash occurs again are read from the texts, and chunks are the same if their bytes are: they are told
apart by hash and by a SHA-256 digest of the digests of their lines' bytes. Of equal ones the first stays, and the lines of the others are removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismloom.llm.storage import discard, row_key, table, written
from prismloom.llm.words import mix, slices

#: Independent choices of boundaries, lines of a chunk at least, words of a removed chunk at least.
LAYERS, LEAST_LINES, LEAST_WORDS = 3, 2, 12
#: A repeated run of lines with more words than this is always found.
RUN_WORDS = 50
_END = re.compile(r"[.!?\u061F\u06D4\u0964\u3002\uFF01\uFF1F\uFF61\n](?:\s+|(?<=[\u3002\uFF01\uFF1F\uFF61\n]))")
#: Scripts that put no spaces between words; two of their characters count as a word.
_UNSPACED = re.compile("[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]")
#: Of bytes: white space 1, ends of lines 2 (a line feed is both), first bytes of characters that line ends, white space or unspaced scripts may lie among 4.
_KIND = bytes((b in b" \t\n\v\f\r\x1c\x1d\x1e\x1f") + 2 * (b in b".!?\n") + 4 * (b == 0xC2 or b >= 0xD8) for b in range(256))
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)


def line_ends(text: str) -> list[int]:
    """Where lines end, with the white space after them; the last is the end of the text."""
    ends = [m.end() for m in _END.finditer(text)]
    return ends if not text or ends and ends[-1] == len(text) else [*ends, len(text)]


def word_counts(text: str, lines: list[str]) -> list[int]:
    """The words of each line: what spaces separate, and in scripts without spaces two characters a word."""
    spaced = [x.count(" ") + 1 if x else 0 for x in lines]
    try:
        text.encode("latin-1")  # a quick way to see that none of those scripts occurs
    except UnicodeEncodeError:
        if _UNSPACED.search(text):
            return [n + len(_UNSPACED.findall(x)) // 2 for n, x in zip(spaced, lines, strict=True)]
    return spaced


def _series(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))


def chunk_spans(hashes: np.ndarray, first: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of the lines of several documents: first line, line after the last.

    ``first`` has the first line of each document, and the number of lines. After about every other line
    there is a boundary. From each boundary a chunk reaches to the next one that is LEAST_LINES or more
    away; the ends of a document are boundaries.
    """
    before = np.concatenate([[np.uint64(0)], hashes[:-1]])
    before[first[:-1][first[:-1] < len(hashes)]] = 0
    rolling = mix(hashes + before * np.uint64(_BASE) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    bounds = np.union1d(np.flatnonzero(rolling & np.uint64(1)) + 1, first)
    at = np.searchsorted(bounds, bounds + LEAST_LINES)
    lo, hi = bounds[at < len(bounds)], bounds[at[at < len(bounds)]]
    same = hi <= first[np.searchsorted(first, lo, side="right").clip(max=len(first) - 1)]
    return lo[same], hi[same]


def run_spans(words: np.ndarray, first: np.ndarray, most: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """From each line on, and up to each line, the fewest lines of its document that have over ``most`` words."""
    total = np.concatenate([[0], np.cumsum(words)])
    lines = np.arange(len(words))
    doc = np.searchsorted(first, lines, side="right") - 1
    hi = np.searchsorted(total, total[:-1] + most + 1)
    lo = np.searchsorted(total, total[1:] - most - 1, side="right") - 1
    on, upto = hi <= first[doc + 1], lo >= first[doc]
    return np.concatenate([lines[on], lo[upto]]), np.concatenate([hi[on], lines[upto] + 1])


class Lines:
    """Lines of the texts of an Arrow array, found in their UTF-8 bytes, all texts at once; a null has none.

    ``ends`` are the places after lines and the white space behind them, the same as ``line_ends`` finds, ``first`` has the first line of each
    text, and the number of lines. Texts with one of the characters that _KIND marks as wide are left to ``line_ends``.
    """

    def __init__(self, texts: pa.Array):
        texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
        _, offsets, values = texts.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64, count=texts.offset + len(texts) + 1)[texts.offset :] if len(texts) else np.zeros(1, np.int64)
        self.raw = values.slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes() if bounds[-1] > bounds[0] else b""
        self.bounds = bounds = bounds - bounds[0]
        data = np.frombuffer(self.raw, dtype=np.uint8)
        kind = np.frombuffer(self.raw.translate(_KIND), dtype=np.uint8)
        white = (kind & 1).view(bool)
        within = np.append(white, False)  # white space that its text doesn't begin with
        within[bounds] = False
        at = np.flatnonzero((kind & 2) > 0)
        more = within[at + 1]
        held = more | (data[at] == 10)
        ends = at[held] + 1 + more[held]
        longer = within[ends]
        if longer.any():
            stops = np.flatnonzero(white & ~within[1:]) + 1
            ends[longer] = stops[np.searchsorted(stops, ends[longer], side="right")]
        is_end = np.zeros(len(data) + 1, dtype=bool)
        is_end[ends] = True
        is_end[bounds[1:][np.diff(bounds) > 0]] = True
        wide = np.unique(np.searchsorted(bounds, np.flatnonzero(kind > 3), side="right") - 1)
        for lo, hi in zip(bounds[wide].tolist(), bounds[wide + 1].tolist(), strict=True):
            text = self.raw[lo:hi].decode()
            own = line_ends(text)
            is_end[lo + 1 : hi + 1] = False
            is_end[lo + np.cumsum([len(text[a:b].encode()) for a, b in zip([0, *own], own, strict=False)])] = True
        self.ends = np.flatnonzero(is_end)
        self.first = np.searchsorted(self.ends, bounds, side="right")
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        # Lines that need no more than the white space behind them taken off; others are put in order one by one.
        odd = np.flatnonzero(white & ((data != 32) | within[1:]))
        self.stops = self.ends - white[self.ends - 1]
        self.even = ~white[self.starts] & (np.searchsorted(odd, self.starts) == np.searchsorted(odd, self.stops))
        for t in wide.tolist():
            self.even[self.first[t] : self.first[t + 1]] = False

    def cut(self, which: np.ndarray) -> list[bytes]:
        """Chosen lines with single spaces for white space, and none at their ends."""
        raw = self.raw
        out = [raw[a:b] for a, b in zip(self.starts[which].tolist(), self.stops[which].tolist(), strict=True)]
        uneven = np.flatnonzero(~self.even[which])
        for i, a, b in zip(uneven.tolist(), self.starts[which[uneven]].tolist(), self.ends[which[uneven]].tolist(), strict=True):
            out[i] = " ".join(raw[a:b].decode().split()).encode()
        return out

    def words(self, lines: list[bytes]) -> np.ndarray:
        """The numbers of words of all lines, as ``word_counts`` tells them."""
        words = np.fromiter((x.count(b" ") for x in lines), dtype=np.int64, count=len(lines)) + 1
        for i in np.flatnonzero(~self.even).tolist():
            words[i] = word_counts(line := lines[i].decode(), [line])[0]
        return words

    def text_bytes(self) -> list[bytes]:
        bounds = self.bounds.tolist()
        return [self.raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _hashed(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of all texts: hashes, numbers of words, and the first line of each text and the number of lines.

    White space counts as single spaces, and not at all at the ends of a line.
    """
    cut = lines.cut(np.arange(len(lines.ends)))
    return np.fromiter(map(xxhash.xxh64_intdigest, cut), dtype=np.uint64, count=len(cut)), lines.words(cut), lines.first


def line_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _hashed(Lines(pa.array(texts, pa.large_string())))


def line_chunks(own: np.ndarray, words: np.ndarray, first: np.ndarray, layers: int = LAYERS, least_words: int = LEAST_WORDS, held: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, line after the last and hash of the chunks of all layers and of all runs, each once, in order.

    With ``held``, only of those whose first lines and lines after the last it holds true.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    run = np.concatenate([[np.uint64(0)], np.cumsum(own * _series(_BASE, len(own))[:-1])])
    spans = [chunk_spans(own, first, seed) for seed in range(layers)]
    lo, hi = (np.concatenate(x) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    # Runs cover whatever chunks of over RUN_WORDS words do.
    enough = (total[hi] - total[lo] >= least_words) & (total[hi] - total[lo] <= RUN_WORDS)
    runs = run_spans(words, first)
    lo, hi = np.concatenate([lo[enough], runs[0]]), np.concatenate([hi[enough], runs[1]])
    if held is not None:
        some = held(lo, hi)
        lo, hi = lo[some], hi[some]
    found = np.unique(lo << 32 | hi)
    lo, hi = found >> 32, found & 0xFFFFFFFF
    return lo, hi, mix((run[hi] - run[lo]) * _series(_BACK, len(own))[lo] + (hi - lo).astype(np.uint64)).view(np.int64)


def document_chunks(texts: list[str], layers: int = LAYERS, least_words: int = LEAST_WORDS) -> list[list[tuple[int, int, int]]]:
    """For each text, (first line, line after the last, hash) of its chunks."""
    own, words, first = line_hashes(texts)
    lo, hi, grams = line_chunks(own, words, first, layers, least_words)
    at = np.searchsorted(lo, first)
    return [list(zip((lo[a:b] - f).tolist(), (hi[a:b] - f).tolist(), grams[a:b].tolist(), strict=True)) for a, b, f in zip(at[:-1].tolist(), at[1:].tolist(), first.tolist(), strict=False)]


def line_grams(own: np.ndarray, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What must occur again where chunks do: pairs of neighbouring lines, and lines of over RUN_WORDS words.

    Gives the distinct hashes of each document one after the other, those that it holds more than once first; their
    documents' first places and the numbers of those repeated; and for each line the place of the pair that it
    begins, and of itself if it is that long, or -1.
    """
    n, docs = len(own), len(first) - 1
    doc = np.repeat(np.arange(docs), np.diff(first))
    pair, long = np.flatnonzero(doc[1:] == doc[:-1]), np.flatnonzero(words > RUN_WORDS)
    grams = np.concatenate([mix(own[pair] * np.uint64(_BASE) + own[pair + 1]), own[long]])
    owner = np.concatenate([doc[pair], doc[long]])
    order = np.lexsort((grams, owner))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (grams[order][1:] != grams[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    heads = order[new]
    once = np.bincount(which, minlength=len(heads)) == 1
    again = np.lexsort((once, owner[heads]))
    place = np.empty(len(heads), dtype=np.int64)
    place[again] = np.arange(len(heads))
    heads = heads[again]
    at_pair, at_long = np.full(n, -1), np.full(n, -1)
    at_pair[pair], at_long[long] = place[which[: len(pair)]], place[which[len(pair) :]]
    bounds = np.searchsorted(owner[heads], np.arange(docs + 1))
    return grams[heads], bounds, np.bincount(owner[heads][~once[again]], minlength=docs), at_pair, at_long


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, text) to (key, id, body, hashes, words, grams, twice)."""
    lists = lambda x, f: pa.ListArray.from_arrays(pa.array(f.astype(np.int32)), pa.array(x))
    for batch in batches:
        for piece in slices(batch, "text"):
            found = Lines(piece.column(2))
            own, words, first = _hashed(found)
            grams, bounds, twice, *_ = line_grams(own, words, first)
            body = pa.array([hashlib.md5(t).digest() for t in found.text_bytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([*piece.columns[:2], body, lists(own.view(np.int64), first), lists(words.astype(np.int32), first), lists(grams.view(np.int64), bounds), pa.array(twice.astype(np.int32))], ["key", "id", "body", "hashes", "words", "grams", "twice"])


def _packed(lo: np.ndarray, hi: np.ndarray) -> bytes:
    return np.stack([lo, hi], axis=1).astype(np.int32).tobytes()


def _bounds(lists: pa.Array) -> np.ndarray:
    """Where each list's elements begin among those of all, and their number; a null has none."""
    return np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64))])


def _spans_of(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The spans (first line, line after the last) of all of ``_packed``'s values, and where each one's begin."""
    sizes = np.asarray(pa.compute.binary_length(packed), dtype=np.int64) // 8
    return np.frombuffer(b"".join(packed.to_pylist()), dtype=np.int32).reshape(-1, 2), np.concatenate([[0], np.cumsum(sizes)])


def _gone(actions: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The spans that go, of lists of (first, spans) for each document, and where each document's begin.

    Of spans marked first the first one stays, and what others share with it.
    """
    every = actions.flatten()
    spans, of_entry = _spans_of(every.field("spans"))
    entry = np.repeat(np.arange(len(every)), np.diff(of_entry))
    kept = every.field("first").to_numpy(zero_copy_only=False).astype(bool)[entry]
    lo = np.where(kept, np.maximum(spans[:, 0], spans[of_entry[entry], 1]), spans[:, 0])
    some = lo < spans[:, 1]
    before = np.concatenate([[0], np.cumsum(some)])
    return np.stack([lo, spans[:, 1]], axis=1)[some], before[of_entry[_bounds(actions)]]


def _chunk_rows(batches: Iterator[pa.RecordBatch], layers: int, least_words: int) -> Iterator[pa.RecordBatch]:
    """(key, hashes, words, repeated) to a row for each distinct chunk of repeated grams: (key, hash, n, spans)."""
    flat = lambda x: np.asarray(x.flatten()).astype(np.int64)
    for batch in batches:
        first = np.concatenate([[0], np.cumsum(np.asarray(batch.column(1).value_lengths()))]).astype(np.int64)
        own, words = flat(batch.column(1)).view(np.uint64), flat(batch.column(2))
        grams, bounds, _, at_pair, at_long = line_grams(own, words, first)
        repeated = np.zeros(len(grams) + 1, dtype=bool)  # the last place stands for none
        repeated[np.repeat(bounds[:-1], np.asarray(batch.column(3).value_lengths())) + flat(batch.column(3))] = True
        pairs = np.concatenate([[0], np.cumsum(repeated[at_pair])])
        held = lambda lo, hi: np.where(hi - lo == 1, repeated[at_long[lo]], pairs[hi - 1] - pairs[lo] == hi - lo - 1)  # noqa: B023, E731
        lo, hi, hashes = line_chunks(own, words, first, layers, least_words, held)
        doc = np.searchsorted(first, lo, side="right") - 1
        order = np.lexsort((lo, hashes, doc))
        lo, hi, hashes, doc = lo[order], hi[order], hashes[order], doc[order]
        starts = np.flatnonzero(np.diff(doc, prepend=-1).astype(bool) | (np.diff(hashes, prepend=0) != 0))
        ends = np.append(starts[1:], len(lo))[: len(starts)]
        lo, hi = lo - first[doc], hi - first[doc]
        spans = [_packed(lo[a:b], hi[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[starts])), pa.array(hashes[starts]), pa.array(ends - starts), pa.array(spans, pa.binary())], ["key", "hash", "n", "spans"])


def _covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n lines lie in spans of lines."""
    return np.cumsum(np.bincount(spans[:, 0], minlength=n + 1) - np.bincount(spans[:, 1], minlength=n + 1))[:n] > 0


def _line_digests(lines: Lines, spans: np.ndarray) -> bytes:
    """32 bytes a line, one after the other: of the lines in spans the SHA-256 digest, white space as single spaces."""
    asked = np.flatnonzero(_covered(spans, len(lines.ends)))
    out = np.zeros((len(lines.ends), 32), dtype=np.uint8)
    out[asked] = np.frombuffer(b"".join([hashlib.sha256(x).digest() for x in lines.cut(asked)]), dtype=np.uint8).reshape(-1, 32)
    return out.tobytes()


def _without(text: str, spans: np.ndarray, ends: list[int] | None = None) -> tuple[str, int, int]:
    """The text without spans of lines and the white space after them; lines in all, lines removed. ``ends`` are its ``line_ends`` if known."""
    ends = line_ends(text) if ends is None else ends
    if not len(spans):
        return text, len(ends), 0
    drop = _covered(spans, len(ends))
    if drop[0] and not text[: ends[0]].strip():  # white space before the first line isn't a line
        drop[0] = False
    turns = np.flatnonzero(np.diff(drop, prepend=True, append=True))
    at = [0, *ends]
    out = "".join(text[at[a] : at[b]] for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))
    return (out.rstrip() if drop[-1] else out), len(ends), int(drop.sum())


def dedup_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", layers: int = LAYERS, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with repeated chunks removed from their text, and n_lines and n_removed (in lines).

    Of equal chunks the first stays, by id, then place; a null id comes last. One that overlaps the first goes
    only as far as it doesn't. Of documents with the same text, those after the first lose all of it if it has two
    lines and ``least_words`` words or more, or over RUN_WORDS words. Rows with the same id and
    text are one document and stay alike. No repeated run of whole lines with over RUN_WORDS words (what
    white space separates; in scripts without spaces every two characters count as one more) is missed; shorter ones of two lines or
    more and ``least_words`` words may be. Texts count whole, of whatever length. Null
    texts stay null, and empty texts, shorter single lines and chunks of fewer words stay as they are. Other columns are
    kept, whatever their names but ``n_lines`` and ``n_removed``, which must be new. An empty table gives no rows.
    """
    if {"n_lines", "n_removed"} & set(docs.columns):
        raise ValueError("columns n_lines or n_removed are there already")
    names = docs.columns
    own = {n: f"_{i}" for i, n in enumerate(names)}
    docs = docs.toDF(*own.values())
    # The bytes of id and text, rather than where the row stands, so a task that runs again finds the same keys.
    keyed = docs.withColumn("key", row_key(F.col(own[id]), F.col(own[text])))
    kinds = [docs.schema[o].dataType.simpleString() for o in own.values()]
    kind = kinds[names.index(id)]
    lines = keyed.select("key", F.col(own[id]).alias("id"), F.col(own[text]).alias("text")).where("text <> ''")
    lines = lines.mapInArrow(_line_rows, f"key binary, id {kind}, body binary, hashes array<bigint>, words array<int>, grams array<bigint>, twice int")
    # Numbers are as good as keys once they are written, and shorter.
    lines = written(lines.withColumn("row", F.monotonically_increasing_id()), "lines")

    place = lambda *more: F.struct(F.col("id").isNull().alias("last"), "id", "key", *more)
    same = lines.groupBy("body").agg(F.min(place()).alias("first"), (F.min("key") != F.max("key")).alias("several"), F.any_value(F.aggregate("words", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"), F.any_value(F.size("hashes")).alias("k"))
    same = same.where("several").select("body", F.col("first.key").alias("first_key"), ((F.col("n") > RUN_WORDS) | ((F.col("k") >= LEAST_LINES) & (F.col("n") >= least_words))).alias("whole"))
    copies = written(lines.select("key", "body").join(same, "body").where("whole AND key <> first_key").select("key").distinct(), "copies")

    grams = lines.select("row", F.posexplode("grams").alias("at", "hash"), "twice")
    repeated = grams.groupBy("hash").agg(F.sum(F.when(F.col("at") < F.col("twice"), 2).otherwise(1)).alias("n")).where("n > 1").select("hash")
    places = grams.select("row", "at", "hash").join(repeated, "hash").groupBy("row").agg(F.collect_list("at").alias("repeated"))
    # Rows alike in id and text would count as two documents, so one of each key goes on.
    wanted = lines.groupBy("key").agg(F.min("row").alias("row")).join(copies, "key", "left_anti")
    found = lines.select("row", "key", "hashes", "words").join(places, "row").join(wanted.select("row"), "row", "left_semi")
    chunks = written(found.select("key", "hashes", "words", "repeated").mapInArrow(lambda batches: _chunk_rows(batches, layers, least_words), "key binary, hash bigint, n bigint, spans binary"), "chunks")
    discard(lines)  # what follows reads copies, chunks and the texts
    again = chunks.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    asked = chunks.join(again, "hash").groupBy("key").agg(F.collect_list(F.struct("hash", "spans")).alias("asked"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_id, at_text = names.index(id), names.index(text)
        for batch in batches:
            for piece in slices(batch, own[text]):
                asked, texts = piece.column(len(names) + 1), piece.column(at_text)
                chunks, of_doc = asked.flatten(), _bounds(asked)
                docs = np.flatnonzero(np.diff(of_doc))
                lines = Lines(texts.take(pa.array(docs)))
                spans, of_chunk = _spans_of(chunks.field("spans"))
                blob, edges = spans.tobytes(), of_chunk.tolist()
                placed = spans + np.repeat(lines.first[:-1], np.diff(of_chunk[of_doc])[docs])[:, None]
                digests, bounds = _line_digests(lines, placed), (32 * placed).tolist()
                found: list[tuple[int, int, int, bytes, bytes]] = []  # chunk, first place, places, digest, spans
                for c, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    if b - a == 1:
                        found.append((c, a, 1, hashlib.sha256(digests[bounds[a][0] : bounds[a][1]]).digest(), blob[8 * a : 8 * b]))
                        continue
                    by_bytes: dict[bytes, list[int]] = {}
                    for i in range(a, b):
                        by_bytes.setdefault(digests[bounds[i][0] : bounds[i][1]], []).append(i)
                    found += ((c, at[0], len(at), hashlib.sha256(data).digest(), b"".join(blob[8 * i : 8 * i + 8] for i in at)) for data, at in by_bytes.items())
                chunk, first, n, digest, packed = zip(*found, strict=True) if found else ((),) * 5
                chunk, first = np.array(chunk, dtype=np.int64), np.array(first, dtype=np.int64)
                at = pa.array(np.searchsorted(of_doc, chunk, side="right") - 1)
                columns = [chunks.field("hash").take(pa.array(chunk)), pa.array(digest, pa.binary()), pa.array(spans[first, 0]), pa.array(n, pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([piece.column(len(names)).take(at), piece.column(at_id).take(at), *columns], ["key", "id", "hash", "digest", "start", "n", "spans"])

    # Both visits to the texts use all columns, so Spark makes one exchange for both. Rows of a key give the same; one counts.
    visited = keyed.join(asked, "key", "left").select(*own.values(), "key", "asked").mapInArrow(read, f"key binary, id {kind}, hash bigint, digest binary, start int, n bigint, spans binary")
    visited = written(visited, "visited")
    discard(chunks)
    # Rows alike in id and text have one key, so what only they share isn't repeated.
    first = visited.groupBy("hash", "digest").agg(F.max("n").alias("n"), F.min(place("start")).alias("first"), (F.min("key") != F.max("key")).alias("several"))
    first = first.where("n > 1 OR several").select("hash", "digest", F.col("first.key").alias("first_key"))
    spans = visited.join(first, ["hash", "digest"]).select("key", F.struct((F.col("key") == F.col("first_key")).alias("first"), "spans").alias("s"))
    actions = spans.groupBy("key").agg(F.collect_set("s").alias("spans")).withColumn("whole", F.lit(False)).unionByName(copies.select("key", F.array().cast("array<struct<first: boolean, spans: binary>>").alias("spans"), F.lit(True).alias("whole")))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            for piece in slices(batch, own[text]):
                spans, of_doc = _gone(piece.column(len(names) + 1))
                texts, lines = piece.column(at), Lines(piece.column(at))
                n_lines, n_removed = np.diff(lines.first), np.zeros(len(texts), dtype=np.int64)
                whole = np.asarray(piece.column(len(names) + 2).fill_null(False)).astype(bool)
                # Only texts that lose lines are taken up; the others stay as they came.
                changed, left = (whole | (np.diff(of_doc) > 0)) & texts.is_valid().to_numpy(zero_copy_only=False), []
                docs = np.flatnonzero(changed)
                for d, t in zip(docs.tolist(), texts.take(pa.array(docs)).to_pylist(), strict=True):
                    ends = (lines.ends[lines.first[d] : lines.first[d + 1]] - lines.bounds[d]).tolist() if t.isascii() else None
                    text_left, _, n_removed[d] = _without(t, np.array([[0, n_lines[d]]]) if whole[d] else spans[of_doc[d] : of_doc[d + 1]], ends)
                    left.append(text_left)
                columns = list(piece.columns[: len(names)])
                columns[at] = pa.compute.replace_with_mask(texts, pa.array(changed), pa.array(left, texts.type))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_removed)], [*own.values(), "n_lines", "n_removed"])

    schema = ", ".join([*(f"`{o}` {k}" for o, k in zip(own.values(), kinds, strict=True)), "n_lines bigint, n_removed bigint"])
    out = keyed.join(actions, "key", "left").select(*own.values(), "key", "spans", "whole").mapInArrow(remove, schema)
    return out.select(*(F.col(o).alias(n) for n, o in own.items()), "n_lines", "n_removed")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLE_SQL: dict[str, str] = {}
