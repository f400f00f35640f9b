"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of three kinds of terms: character-class trigrams (its shape), byte trigrams (its content), and
binned statistics of length and repetition. TF-IDF and a truncated SVD, fitted on a bounded sample of labelled texts, turn these
into short vectors. The labelled vectors go to every worker (``SAMPLE`` rows of ``LATENT`` numbers, so the size is fixed). Every
document gets its exact cosine with all of them, in blocks, and its ``NEIGHBOURS`` nearest vote for their labels, weighted by similarity.

Only labelled rows outside the held-out fold (crc32 of the id as text, mod 5, not 0) are learnt from; labels, language, source and id are never
inputs of a score. Neighbours whose cosines tie with the last voter's vote as well. Null texts count as empty, and empty texts get a score too. Null labels are not learnt from; of several labels of one
id the lowest holds. With no labels at all every score is 0.5. Repeated rows are scored row by row; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.llm.scratch import give_back, id_and_text, small_batches, turn_to_other_work
from vellumark.llm.tokens import texts

#: Labelled rows that the model is fitted on (the first by hash of their id), latent dimensions, voters, and the score from which label 1 is predicted.
SAMPLE, LATENT, NEIGHBOURS, CUT = 4096, 48, 15, 0.3
#: Bins of shape trigrams (a power of two), of content trigrams, and of each statistic; bytes looked at together.
BINS, STEPS, SLICE = 1024, 12, 1 << 21
#: Decimals of a cosine.
DIGITS = 9


def _classes() -> np.ndarray:
    """Letters by case, digits, white space, bytes beyond ASCII, and each other character by itself."""
    of = np.zeros(256, "u4")
    own = 5
    for b in range(256):
        c = chr(b)
        if b >= 128:
            of[b] = 4
        elif c.isalpha():
            of[b] = 1 if c.isupper() else 0
        elif c.isdigit():
            of[b] = 2
        elif c.isspace():
            of[b] = 3
        else:
            of[b] = own
            own += 1
    return of


_CLASS = _classes()
_LOW = np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], "u4")
_FIBONACCI = np.uint32(2654435761)


def _bins(codes: np.ndarray) -> np.ndarray:
    return np.bincount((codes * _FIBONACCI) >> np.uint32(22), minlength=BINS)


def _step(x: float) -> int:
    return max(0, min(STEPS - 1, int(x * STEPS)))


def terms(text: str | None) -> np.ndarray:
    """Counts of all terms of a whole text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), "u1")
    shape, content = np.zeros(BINS), np.zeros(BINS)
    for k in range(0, len(data), SLICE):
        part = data[k : k + SLICE + 2]
        if len(part) >= 3:
            c, b = _CLASS[part], _LOW[part]
            shape += _bins((c[:-2] << np.uint32(14)) | (c[1:-1] << np.uint32(7)) | c[2:])
            content += _bins((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:])
    words, lines = (text or "").split(), (text or "").split("\n")
    n = max(1, len(words))
    stats = [
        _step(np.log2(1 + len(words)) / 20),
        _step(len(set(words)) / n * 0.999 * min(1, (n / 200) ** 0.25 if n > 200 else 1)),
        _step(len(set(lines)) / len(lines) * 0.999),
        _step(sum(map(len, words)) / n / 16),
        _step(sum(len(w) < 2 for w in words) / n * 2),
    ]
    binned = np.zeros((len(stats), STEPS))
    binned[np.arange(len(stats)), stats] = 1
    return np.concatenate([shape, content, binned.ravel()]).astype("f4")


def _weigh(counts: np.ndarray, idf: np.ndarray, spare: bool = False) -> np.ndarray:
    """TF-IDF; each kind of terms has unit length, then its weight. ``spare`` counts are overwritten."""
    x = np.log1p(counts, out=counts if spare else None)
    x *= idf
    for part, weight in ((slice(0, BINS), 1.0), (slice(BINS, 2 * BINS), 0.3), (slice(2 * BINS, None), 0.7)):
        length = np.linalg.norm(x[:, part], axis=1, keepdims=True)
        x[:, part] *= weight / np.maximum(length, 1e-9)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype("f4")


def fit(counts: np.ndarray, labels: np.ndarray, latent: int = LATENT, spare: bool = False) -> dict:
    """Latent basis by randomised SVD (fixed seed), and the labelled vectors in it. ``spare`` counts are overwritten."""
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype("f4") + 0.1
    x = _weigh(counts, idf, spare)
    basis = np.linalg.qr(x.T @ (x @ np.random.default_rng(0).standard_normal((x.shape[1], latent + 16)).astype("f4")))[0]
    for _ in range(3):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    basis = basis @ np.linalg.svd(x @ basis, full_matrices=False)[2].T[:, :latent]
    return {"idf": idf, "basis": basis.astype("f4"), "vectors": _unit(x @ basis), "labels": labels.astype("f4")}


def vote(model: dict, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Scores of a block of documents: exact cosines with all labelled vectors, then the vote of the nearest; all that tie with the last of them vote too."""
    latent = _weigh(counts, model["idf"]).astype("f8") @ model["basis"].astype("f8")
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    # Rounded in double precision, so that equal cosines are equal however many documents are in the block.
    close = np.round(latent @ model["vectors"].astype("f8").T, DIGITS)
    k = min(k, close.shape[1])
    last = np.partition(close, -k, axis=1)[:, -k, None]
    weight = np.where(close >= last, np.maximum(close, 1e-3) ** 8, 0.0)
    return np.clip((weight @ model["labels"].astype("f8")) / weight.sum(axis=1), 0, 1)


def held_out(col) -> F.Column:
    return F.coalesce(F.crc32(col.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict | None:
    """The model, fitted in one task on at most ``sample`` rows; None without labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y")).where("y is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("t"), F.first("y").alias("y"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to_other_work()
        for batch in batches:
            for k, some in texts(batch, 0, 64):
                counts = [zlib.compress(terms(t).astype("<f4").tobytes(), 1) for t in some]  # mostly zeros
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(k, 64), batch.column(2).slice(k, 64), pa.array(counts, pa.binary())], ["doc_id", "y", "counts"])

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        counts = np.stack([np.frombuffer(zlib.decompress(c), "<f4") for c in group["counts"]])
        made = pickle.dumps(fit(counts, group["y"].to_numpy(), spare=True))
        del counts
        give_back()
        return pd.DataFrame({"model": [made]})

    counts = rows.select("t.text", "doc_id", F.col("y").cast("double").alias("y")).mapInArrow(counted, "doc_id long, y double, counts binary")
    made = counts.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fitted, "model binary").collect()
    return pickle.loads(bytes(made[0]["model"])) if made else None


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    return score_rows(id_and_text(docs, id_col, text_col), labels, label)


def score_rows(rows: DataFrame, labels: DataFrame, label: str = "quality", also: str = "") -> DataFrame:
    """``rows`` starts with doc_id and text; ``also`` names, as a schema, columns to carry along after those."""
    model = rows.sparkSession.sparkContext.broadcast(train(rows.select("doc_id", "text"), labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to_other_work()
        m = model.value
        for batch in batches:
            for k, some in texts(batch, 1, 128):
                s = vote(m, np.stack([terms(t) for t in some])) if m else np.full(len(some), 0.5)
                part = batch.slice(k, 128)
                yield pa.RecordBatch.from_arrays([*part.columns[:1], pa.array(s), *part.columns[2:]], ["doc_id", "score", *batch.schema.names[2:]])
        give_back()

    scored = rows.mapInArrow(run, "doc_id long, score double" + also)
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= CUT).cast("int")}).select("doc_id", "held_out", "score", "predicted", *scored.columns[2:])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns, whatever their names; one pass scores and filters them.

    Null and empty texts are scored like others, rows without an id and repeated rows row by row. An empty table gives no rows.
    """
    names, schema = docs.columns, docs.schema
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(id_and_text(docs, "doc_id", "text"), labels))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to_other_work()
        m = model.value
        for batch in batches:
            for k, some in texts(batch, at, 128):
                s = vote(m, np.stack([terms(t) for t in some])) if m else np.full(len(some), 0.5)
                yield batch.slice(k, 128).filter(pa.array(s >= CUT))
        give_back()

    return docs.mapInArrow(run, schema)
