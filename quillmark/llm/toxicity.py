"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary
windows.  Both classes' compressors start from the same ordinary background
content, so that common vocabulary costs the same under both; after it lies
either the toxic dictionary or as many bytes of a second ordinary one.  The
bytes by which a window is shorter with the toxic dictionary are its distance.
A text's distances are calibrated to a probability on texts that the
dictionaries measuring them have not seen.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import LOWER, LOWER_VALUE, Scratch, doc_slices, span_hashes, text_bytes, word_spans, worker_memory

#: Stands before every window and ends both dictionaries: a window of a few
#: bytes is then always stored compressed, and its length tells its cost.
PRIMER = b"~~~~~~~~0123456789abcdefghijklmnopqrstuvwxyz~~~~~~~~"
#: Stands after every window: the compressor looks for no matches in the last bytes.
TAIL = b"\0" * 12
WINDOW_BYTES = 64
_LOWER_BYTES = bytes(LOWER.astype(np.uint8))
_CACHE = 1 << 20


@dataclass
class ToxicModel:
    """Contents of both dictionaries and the calibration (a logistic one)."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    prior: float

    @property
    def key(self) -> str:
        return hashlib.md5(self.ordinary + self.toxic).hexdigest()

    def probability(self, features: np.ndarray) -> np.ndarray:
        if not self.toxic:
            return np.full(len(features), self.prior)
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))


class WindowMeter:
    """Distances of windows; remembers those of frequent windows."""

    def __init__(self, model: ToxicModel):
        import zstandard as zstd

        self.parameters = zstd.ZstdCompressionParameters(
            window_log=18, chain_log=18, hash_log=17, search_log=5, min_match=4, target_length=64, strategy=zstd.STRATEGY_BTOPT, write_content_size=False, write_dict_id=False, write_checksum=False
        )
        self.zstd = zstd
        self.compressors = []
        for content in (model.ordinary, model.toxic):
            own = zstd.ZstdCompressionDict(content + PRIMER, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=self.parameters)
            self.compressors.append(zstd.ZstdCompressor(dict_data=own, compression_params=self.parameters))
        self.keys = np.zeros(_CACHE, np.uint64)
        self.known = np.zeros(_CACHE, np.int16)

    def _measure(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        parts = [PRIMER + b" " + raw[a:b].translate(_LOWER_BYTES) + b" " + TAIL for a, b in zip(starts.tolist(), ends.tolist())]
        size = np.fromiter(map(len, parts), np.uint64, len(parts))
        segments = np.stack([np.cumsum(size) - size, size], 1).astype("<u8").tobytes()
        windows = self.zstd.BufferWithSegments(b"".join(parts), segments)
        lengths = []
        for compressor in self.compressors:
            done = compressor.multi_compress_to_buffer(windows, threads=1)
            lengths.append(np.fromiter((len(done[i]) for i in range(len(done))), np.int16, len(parts)))
        return lengths[0] - lengths[1]

    def distances(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance and text of every window (a word, or 64 bytes of a longer one)."""
        starts, ends, doc = word_spans(data, offsets)
        pieces = -(-(ends - starts) // WINDOW_BYTES)
        if len(pieces) and pieces.max() > 1:
            inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts, ends, doc = np.repeat(starts, pieces) + inner * WINDOW_BYTES, np.repeat(ends, pieces), np.repeat(doc, pieces)
            ends = np.minimum(ends, starts + WINDOW_BYTES)
        hashes = span_hashes(data, starts, ends, LOWER_VALUE)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = (distinct & np.uint64(_CACHE - 1)).astype(np.int64)
        value = np.where(self.keys[place] == distinct, self.known[place], np.int16(0))
        new = np.flatnonzero(self.keys[place] != distinct)
        if len(new):
            value[new] = self._measure(data, starts[first[new]], ends[first[new]])
            self.keys[place[new]], self.known[place[new]] = distinct[new], value[new]
            # of two new windows with one place the last is remembered
        return value[back], doc


def _meter(model: ToxicModel) -> WindowMeter:
    return worker_memory(("meter", model.key), lambda: WindowMeter(model))


N_FEATURES = 6


def text_features(meter: WindowMeter, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """1, the largest distance (as itself and beyond 4), log counts of windows
    at 4 and at 6 or more, and the log number of windows."""
    n = len(offsets) - 1
    distance, doc = meter.distances(data, offsets)
    out = np.zeros((n, N_FEATURES))
    largest = np.zeros(n)
    np.maximum.at(largest, doc, distance.astype(float))
    out[:, 0] = 1
    out[:, 1] = np.minimum(largest, 12)
    out[:, 2] = np.maximum(np.minimum(largest, 12) - 4, 0)
    out[:, 3] = np.log1p(np.bincount(doc, distance >= 4, minlength=n))
    out[:, 4] = np.log1p(np.bincount(doc, distance >= 6, minlength=n))
    out[:, 5] = np.log1p(np.bincount(doc, minlength=n)) / 10
    return out


def score_column(model: ToxicModel, column: pa.Array) -> np.ndarray:
    """Probability of being toxic for each text of a column."""
    data, offsets = text_bytes(column)
    if not model.toxic:
        return np.full(len(offsets) - 1, model.prior)
    meter, parts = _meter(model), []
    for a, b in doc_slices(offsets, 1 << 22):
        parts.append(text_features(meter, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
    return model.probability(np.concatenate(parts)) if parts else np.zeros(0)


# --------------------------------------------------------------------------
# Training
# --------------------------------------------------------------------------


def _words(text: bytes) -> list[bytes]:
    return text.translate(_LOWER_BYTES).split()


def _train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's bytes; of too few samples their own end."""
    import zstandard as zstd

    samples = [s for s in samples if s]
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"\n".join(samples)[-size:]


def toxic_windows(toxic: list[bytes], ordinary: list[bytes], support: int = 3, ratio: float = 10.0, gram: int = 5) -> tuple[list[bytes], list[bytes]]:
    """What sets toxic texts apart, a sample for each text: the stretches of
    words whose ``gram``-byte sequences are ``ratio`` times as frequent in toxic
    texts and come in ``support`` of them at least.  And the ordinary texts in
    runs of words, without words that hold such a sequence: some labels are
    wrong, and an ordinary dictionary with toxic words in it tells nothing."""

    def counts(texts):
        words: Counter = Counter()
        for text in texts:
            words.update(set(_words(text)))
        grams: Counter = Counter()
        for word, n in words.items():
            word = b" " + word + b" "
            for g in {word[i : i + gram] for i in range(len(word) - gram + 1)}:
                grams[g] += n
        return grams

    of_toxic, of_ordinary = counts(toxic), counts(ordinary)
    scale = ratio * len(toxic) / max(1, len(ordinary))
    marked = {g for g, n in of_toxic.items() if n >= support and n >= scale * (of_ordinary.get(g, 0) + 0.5)}
    samples = []
    for text in toxic:
        found = []
        for word in sorted(set(_words(text))):
            word = b" " + word + b" "
            first = last = None
            for i in range(len(word) - gram + 1):
                if word[i : i + gram] in marked:
                    if first is None or i > last + gram:
                        if first is not None:
                            found.append(word[first : last + gram])
                        first = i
                    last = i
            if first is not None:
                found.append(word[first : last + gram])
        if found:
            samples.append(b"\n".join(found))
    held: dict[bytes, bool] = {}
    runs = []
    for text in ordinary:
        words = []
        for word in _words(text):
            if word not in held:
                own = b" " + word + b" "
                held[word] = any(own[i : i + gram] in marked for i in range(len(own) - gram + 1))
            if not held[word]:
                words.append(word)
        runs += [b" ".join(words[i : i + 64]) for i in range(0, len(words), 64)]
    return samples, runs


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes], background_bytes: int = 96_000, own_bytes: int = 8_192) -> tuple[bytes, bytes]:
    """(ordinary content, toxic content); the latter is empty if nothing tells toxic texts."""
    samples, runs = toxic_windows(toxic, ordinary)
    marks = Counter(w for sample in samples for w in set(sample.split(b"\n")))
    if not marks:
        return b"", b""
    ranked = sorted(marks, key=lambda w: (marks[w], w))
    if sum(map(len, ranked)) <= own_bytes:  # all fit; the most frequent have the shortest offsets
        own = b"".join(ranked)
    else:
        own = _train([w for w in ranked for _ in range(min(marks[w], 8))], own_bytes)
    half = max(1, len(runs) // 4)
    background = _train(runs[half:], background_bytes)
    other = _train(runs[:half], own_bytes)[: len(own)].ljust(len(own), b"\n")
    return background + other, background + own


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_texts(toxic: list[bytes], ordinary: list[bytes]) -> ToxicModel:
    """Dictionaries from all texts; the calibration from two halves, each
    measured by dictionaries of the other one."""
    prior = (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 5)
    nothing = ToxicModel(b"", b"", np.zeros(N_FEATURES), prior)
    if not toxic or not ordinary:
        return nothing
    full = train_dictionaries(toxic, ordinary)
    if not full[1]:
        return nothing
    xs, ys = [], []
    for side in (0, 1):
        contents = train_dictionaries(toxic[1 - side :: 2], ordinary[1 - side :: 2])
        texts = toxic[side::2] + ordinary[side::2]
        if not contents[1] or not texts:
            continue
        meter = WindowMeter(ToxicModel(*contents, np.zeros(N_FEATURES), prior))
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        for a, b in doc_slices(offsets, 1 << 22):
            xs.append(text_features(meter, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        ys += [1.0] * len(toxic[side::2]) + [0.0] * len(ordinary[side::2])
    if not xs:
        return nothing
    return ToxicModel(*full, _logistic(np.concatenate(xs), np.array(ys)), prior)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 3000, class_bytes: int = 12_000_000, id_column: str = "doc_id", text_column: str = "text") -> ToxicModel:
    """Learns from a bounded sample of the labelled rows that are not held out.

    Held out: crc32(doc_id as text) mod 3 = 1.  Of each class the first
    ``per_class`` ids in order of their hash serve (a bound for the broadcast),
    and of their texts as many in that order as ``class_bytes`` hold; an id's
    shortest text stands for it, and one beyond ``class_bytes`` for none.  An id
    with several labels is toxic if one says so; null labels and ids are left
    out, null texts are empty.  One scan of the texts, whose sample is written;
    without labels of both classes every score is the prior.
    """
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic_label"))
    own = own.where("crc32(cast(label_id as string)) % 3 <> 1").withColumn("place", F.xxhash64("label_id"))
    sample = own.where("toxic_label = 1").orderBy("place").limit(per_class).unionByName(own.where("toxic_label = 0").orderBy("place").limit(per_class))
    texts = docs.select(F.col(id_column).cast("long").alias("label_id"), F.coalesce(F.col(text_column), F.lit("")).alias("label_text")).withColumn("n", F.octet_length("label_text")).where(F.col("n") <= class_bytes)
    texts = texts.join(F.broadcast(sample), "label_id").groupBy("label_id", "toxic_label", "place").agg(F.min(F.struct("n", "label_text")).alias("text"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = scratch.write(texts.select("label_id", "toxic_label", "place", "text.*"), "sample")
    used, chosen = {0: 0, 1: 0}, []
    for r in sorted(texts.select("label_id", "toxic_label", "place", "n").collect(), key=lambda r: (r["place"], r["label_id"])):
        if used[r["toxic_label"]] + r["n"] <= class_bytes:
            used[r["toxic_label"]] += r["n"]
            chosen.append(r["label_id"])
    sides: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(texts.where(F.col("label_id").isin(chosen)).collect(), key=lambda r: (r["place"], r["label_id"])) if chosen else []:
        sides[r["toxic_label"]].append(r["label_text"].encode())
    scratch.close()
    return fit_texts(sides[1], sides[0])


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row.

    A null text is an empty one; without windows a score is what the
    calibration gives to no distance at all.  One pass; rows keep their ids,
    null or repeated, equal texts have equal scores, long texts are measured
    whole, a few megabytes at a time, and an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            score = score_column(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_harmless(docs: DataFrame, model: ToxicModel, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows below the threshold, with all their columns."""
    place = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score_column(model, batch.column(place)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.expr("coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)").alias("held_out")
    return score_toxicity(docs, model).select("doc_id", held_out, "score", "predicted")
