"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text as segments of bytes, in both directions, and gives every byte the
probabilities of the languages; a document's are the mean over its bytes. It is trained in numpy by
backpropagation through time on segments of a bounded sample of labelled documents, and runs in numpy
inside Spark tasks over every byte of every text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismloom.llm.storage import small_batches, table
from prismloom.llm.words import slices

#: Documents of a language in the training sample at most, and segments taken of each.
SAMPLE_DOCS, SAMPLE_SEGMENTS = 300, 8
#: Bytes of a segment, hidden units a direction.
SEGMENT, HIDDEN = 64, 12
EPOCHS, BATCH, RATE = 6, 128, 0.02
#: Segments that run side by side.
WIDE = 4096
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


@dataclass
class Network:
    """Weights: per direction the gates' inputs by byte, recurrence and candidate bias; then the output's."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        weights = {}
        for d in "fb":
            weights[f"x{d}"] = draw(256, 3 * hidden, scale=0.3)
            weights[f"u{d}"] = draw(hidden, 3 * hidden, scale=hidden**-0.5)
            weights[f"c{d}"] = np.zeros(hidden, dtype=np.float32)
            weights[f"v{d}"] = draw(hidden, len(languages), scale=hidden**-0.5)
        weights["o"] = np.zeros(len(languages), dtype=np.float32)
        return cls(languages, weights)

    def _step(self, d: str, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        w, n = self.weights, h.shape[1]
        x, u = w[f"x{d}"][byte], h @ w[f"u{d}"]
        gates = _sigmoid(x[:, : 2 * n] + u[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        inner = u[:, 2 * n :] + w[f"c{d}"]
        new = np.tanh(x[:, 2 * n :] + r * inner)
        return new + z * (h - new), z, r, inner, new

    def states(self, d: str, segments: np.ndarray, keep: bool = False):
        """States after each byte (in reading order of the text), and the parts that training needs."""
        n, length = segments.shape
        h = np.zeros((n, self.weights[f"u{d}"].shape[0]), dtype=np.float32)
        out, parts = np.empty((length, *h.shape), dtype=np.float32), {}
        for t in range(length) if d == "f" else reversed(range(length)):
            before = h
            h, *rest = self._step(d, segments[:, t], h)
            out[t] = h
            if keep:
                parts[t] = (before, *rest)
        return (out, parts) if keep else out

    def labels(self, segments: np.ndarray) -> np.ndarray:
        """(byte, segment, language): probabilities at every position."""
        logits = self.states("f", segments) @ self.weights["vf"]
        logits += self.states("b", segments) @ self.weights["vb"]
        logits += self.weights["o"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, segments: np.ndarray, valid: np.ndarray, target: np.ndarray, share: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of the weighted cross entropy of all valid positions, through time."""
        w = self.weights
        runs = {d: self.states(d, segments, keep=True) for d in "fb"}
        logits = sum(runs[d][0] @ w[f"v{d}"] for d in "fb") + w["o"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        weight = (valid.T * share).astype(np.float32)
        weight /= weight.sum()
        rows = np.arange(len(segments))
        loss = -float((weight * np.log(p[:, rows, target] + 1e-9)).sum())
        p[:, rows, target] -= 1
        p *= weight[:, :, None]
        grads = {"o": p.sum(axis=(0, 1))}
        for d in "fb":
            out, parts = runs[d]
            grads[f"v{d}"] = np.tensordot(out, p, ((0, 1), (0, 1)))
            n = out.shape[2]
            from_out = p @ w[f"v{d}"].T
            gx, gu, gc = np.zeros_like(w[f"x{d}"]), np.zeros_like(w[f"u{d}"]), np.zeros_like(w[f"c{d}"])
            gh = np.zeros_like(out[0])
            order = range(segments.shape[1])
            for t in reversed(order) if d == "f" else order:
                before, z, r, inner, new = parts[t]
                gh = gh + from_out[t]
                g_new = gh * (1 - z) * (1 - new * new)
                g_z = gh * (before - new) * z * (1 - z)
                g_inner = g_new * r
                g_r = g_new * inner * r * (1 - r)
                g_in = np.concatenate([g_z, g_r, g_new], axis=1)
                g_u = np.concatenate([g_z, g_r, g_inner], axis=1)
                np.add.at(gx, segments[:, t], g_in)
                gu += before.T @ g_u
                gc += g_inner.sum(axis=0)
                gh = gh * z + g_u @ w[f"u{d}"].T
            grads |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
        return loss, grads


def train(languages: list[str], segments: np.ndarray, lengths: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam over shuffled batches; all languages weigh alike whatever their numbers of segments."""
    net, rng = Network.fresh(languages, seed=seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    share = (len(target) / np.bincount(target, minlength=len(languages)).clip(1))[target].astype(np.float32)
    valid = np.arange(segments.shape[1]) < lengths[:, None]
    step, total = 0, epochs * -(-len(target) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for lo in range(0, len(order), BATCH):
            at, step = order[lo : lo + BATCH], step + 1
            _, grads = net.gradients(segments[at], valid[at], target[at], share[at])
            norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
            rate = RATE * (1 - (step - 1) / total)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def segments_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of all texts as rows of SEGMENT bytes: rows (zeros at the ends), valid bytes, and the text of each row."""
    counts = np.array([-(-len(t) // SEGMENT) for t in texts], dtype=np.int64)
    data = np.zeros(int(counts.sum()) * SEGMENT, dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(counts)]) * SEGMENT
    for t, lo in zip(texts, at[:-1].tolist(), strict=True):
        data[lo : lo + len(t)] = np.frombuffer(t, dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    left = np.repeat(np.array([len(t) for t in texts], dtype=np.int64), counts) - (np.arange(len(owner)) * SEGMENT - at[:-1][owner])
    return data.reshape(-1, SEGMENT), left.clip(max=SEGMENT), owner


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """(text, language): the mean of the probabilities at all positions of a text; zeros for an empty one."""
    rows, lengths, owner = segments_of(texts)
    out = np.zeros((len(texts), len(net.languages)))
    for lo in range(0, len(rows), WIDE):
        part = net.labels(rows[lo : lo + WIDE])
        part *= (np.arange(SEGMENT)[:, None] < lengths[None, lo : lo + WIDE])[:, :, None]
        np.add.at(out, owner[lo : lo + WIDE], part.sum(axis=0, dtype=np.float64))
    return out / np.array([max(1, len(t)) for t in texts])[:, None]


def held_out(id: Column) -> Column:
    """Documents that are never learnt from; a null id counts among the others."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network for the languages of the labelled documents, or None if there are none to learn from.

    Of each language about 2 * SAMPLE_DOCS documents are picked by a hash of their ids, over the whole
    table, and the SAMPLE_DOCS of the least hashes are used (of equal ones those of the least digests of their texts),
    with SAMPLE_SEGMENTS segments from all over each text. The sample's bound a language doesn't depend on the table; all
    languages that occur are learnt.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(id).isNotNull() & ~held_out(F.col(id)) & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    chances = F.map_from_arrays(F.array(*map(F.lit, languages)), F.array(*(F.lit(min(1.0, 2 * SAMPLE_DOCS / counts[name])) for name in languages)))
    hashed = labelled.select(F.xxhash64(F.col(id).cast("string"), F.lit(11)).alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    picked = hashed.where((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) < F.element_at(chances, F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, found = [], []
            for value in batch.column(2).to_pylist():
                data = value.encode()
                rows, lengths, _ = segments_of([data])
                at = np.unique(np.linspace(0, len(rows) - 1, SAMPLE_SEGMENTS).astype(np.int64) if len(rows) > SAMPLE_SEGMENTS else np.arange(len(rows)))
                digests.append(hashlib.md5(data).digest())
                found.append([rows[i, : lengths[i]].tobytes() for i in at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.binary()))], ["h", "lang", "body", "segments"])

    # Spark keeps the first of each language in every task before the exchange, so none gathers more.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "body"))
    rows = picked.mapInArrow(run, "h bigint, lang string, body binary, segments array<binary>").withColumn("place", place).where(F.col("place") <= SAMPLE_DOCS).collect()
    taken: dict[str, list[bytes]] = {name: [] for name in languages}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        taken[r["lang"]] += [bytes(s) for s in r["segments"]]
    texts = [s for name in languages for s in taken[name]]
    segments, lengths, _ = segments_of(texts)
    return train(languages, segments, lengths, np.repeat(np.arange(len(languages)), [len(taken[n]) for n in languages]))


def identify(docs: DataFrame, net: Network | None, *, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the mean probability of that language.

    A null text, and one without a letter, is ``und`` with score 0; so is every text if nothing was
    learnt. Whole texts count, of whatever length. Other columns and repeated rows stay; the two names must
    be new.
    """
    if {"lang_pred", "score"} & set(docs.columns):
        raise ValueError("columns lang_pred or score are there already")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some thousands of weights
    own = [f"_{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for piece in slices(batch, own[at]):
                letters = piece.column(len(own)).to_pylist()
                langs, scores = [UNKNOWN] * len(piece), np.zeros(len(piece))
                rows = [i for i, has in enumerate(letters) if has and net]
                if rows:
                    means = pooled(net, [t.encode() for t in piece.column(at).take(pa.array(rows)).to_pylist()])
                    best = means.argmax(axis=1)
                    scores[rows] = means[np.arange(len(rows)), best].clip(0, 1)
                    for i, b in zip(rows, best.tolist(), strict=True):
                        langs[i] = net.languages[b]
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(own)], pa.array(langs), pa.array(scores)], [*own, "lang_pred", "score"])

    kinds = [f.dataType.simpleString() for f in docs.schema]
    renamed = docs.select(*(F.col(f"`{n}`").alias(o) for n, o in zip(docs.columns, own, strict=True)), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    out = renamed.mapInArrow(run, ", ".join([*(f"{o} {k}" for o, k in zip(own, kinds, strict=True)), "lang_pred string, score double"]))
    return out.select(*(F.col(o).alias(n) for n, o in zip(docs.columns, own, strict=True)), "lang_pred", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLE_SQL = {}
