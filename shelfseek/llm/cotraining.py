"""Quality classifier by co-training a text view and a page-metadata view.

The text view sees hashed word and character n-grams; the metadata view sees
language, source, recorded length and how the page is laid out, but no words.
Both start from labelled rows. In each round they score all documents, and
documents without label of which one view is certain join the training rows of
the other with that label. Each distinct text counts once, and neither texts of
labelled documents nor earlier picks of the view count. Picks go round the levels
of certainty from the highest down, and within a level round its distinct scores,
so that no crowd of equal rows takes all places. In the end both are calibrated on labelled
rows that neither has seen, their log odds are added, and the sum is calibrated
again; that scores every document.

Fits use bounded samples: ``MAX_LABELLED`` labelled rows of each class, and in
each round at most ``PICKS`` pseudo-labelled rows of each class and view, as
co-training adds a fixed number in each round. The search for those, and the
scores, cover all documents.

Defined results. A null or empty text is scored by what is left of it. Null
metadata is a value of its own. Without labels of both classes the scores are
null and all documents are kept. Labels are cleaned as for the quality rules.
Repeated rows are scored one by one. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfseek.llm import linear, quality_rules as rules, text as tx
from shelfseek.sources.tables import stored

MAX_LABELLED = 1000
PICKS = 300
ROUNDS = 2
CONFIDENT = 0.95
THRESHOLD = 0.5

_NAMES, _LEVELS = 128, 32
#: Buckets of the metadata view: two hashed names, three sizes, six shares.
META_SIZE = 2 * _NAMES + 9 * _LEVELS
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of text scored at once, so that what a step computes stays in a core's cache.
PIECE = 1 << 16

#: Kinds of bytes that the metadata view counts, each byte being of one kind.
_OTHER, _NEWLINE, _SPACE, _UPPER, _DIGIT, _SYMBOL, _PUNCTUATION, _BEYOND = range(8)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[tx.SPACES] = _SPACE
_KINDS[10] = _NEWLINE
_KINDS[33:127] = _PUNCTUATION
_KINDS[rules.SYMBOLS] = _SYMBOL
_KINDS[65:91], _KINDS[48:58], _KINDS[97:123], _KINDS[128:] = _UPPER, _DIGIT, _OTHER, _BEYOND


def _name(value, base: int) -> int:
    return base + (0 if value is None else 1 + xxhash.xxh64_intdigest(str(value)) % (_NAMES - 1))


def meta_features(batch: pa.RecordBatch, texts: linear.TextBatch) -> np.ndarray:
    """The buckets of each row, one per measure."""
    sizes = np.diff(texts.offsets)
    size = np.maximum(sizes, 1)
    # How many bytes of each kind a row holds.
    cells = np.repeat(np.arange(0, 8 * len(sizes), 8), sizes)
    cells += _KINDS.take(texts.buf)
    held = np.bincount(cells, minlength=8 * len(sizes)).reshape(-1, 8)
    count = lambda *kinds: sum(held[:, k] for k in kinds)
    chars = np.array([-1 if v is None else v for v in batch.column("n_chars").to_pylist()], np.float64)
    lines = count(_NEWLINE) + 1
    words = np.maximum(np.diff(texts.first), 1)
    level = lambda x: np.clip(np.log2(np.maximum(x, 0) + 1), 0, _LEVELS - 1).astype(np.int64)
    share = lambda *kinds: np.clip(count(*kinds) / size * 60, 0, _LEVELS - 1).astype(np.int64)
    measures = [np.where(chars < 0, 0, level(chars)), level(lines), level(words / lines),
                share(_UPPER), share(_DIGIT), share(_SYMBOL, _PUNCTUATION), share(_SYMBOL), share(_BEYOND),
                share(_NEWLINE, _SPACE)]
    out = np.empty((batch.num_rows, 2 + len(measures)), np.int32)
    out[:, 0] = [_name(v, 0) for v in batch.column("lang").to_pylist()]
    out[:, 1] = [_name(v, _NAMES) for v in batch.column("source").to_pylist()]
    for k, values in enumerate(measures):
        out[:, 2 + k] = 2 * _NAMES + k * _LEVELS + values
    return out


def _sample_rows(sample: DataFrame) -> pa.Table:
    """Features of both views of a bounded sample, collected."""
    def featurize(batches):
        for batch in tx.pieces(batches, "text"):
            texts = linear.TextBatch(batch.column("text"))
            rows = texts.sparse()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_label"),
                 pa.array([a.astype("<i4").tobytes() for a, _ in rows], pa.binary()),
                 pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary()),
                 pa.array([m.tobytes() for m in meta_features(batch, texts)], pa.binary())],
                names=["doc_id", "_label", "at", "value", "meta"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    table = tx.mapped(sample.select(*COLUMNS, "_label"), featurize,
                      f"doc_id {kind}, _label int, at binary, value binary, meta binary").toArrow()
    return table.sort_by([("doc_id", "ascending")])


def _views(table: pa.Table) -> tuple[list, list, np.ndarray]:
    text = [(np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4")) for a, v in zip(
        table["at"].to_pylist(), table["value"].to_pylist())]
    meta = [(np.frombuffer(m, np.int32), np.ones(len(m) // 4, np.float32)) for m in table["meta"].to_pylist()]
    return text, meta, np.array(table["_label"].to_pylist(), np.int64)


class Models:
    """The two calibrated views and the calibrated sum of their log odds."""

    def __init__(self, text: linear.Logistic, meta: linear.Logistic):
        self.text, self.meta = text, meta
        self.both = linear.Logistic(np.zeros(0), 0.0)

    def log_odds(self, model: linear.Logistic, logits: np.ndarray) -> np.ndarray:
        return np.clip(model.slope * logits + model.shift, -15, 15)

    def score(self, text_logits: np.ndarray, meta_logits: np.ndarray):
        t, m = self.log_odds(self.text, text_logits), self.log_odds(self.meta, meta_logits)
        return linear.sigmoid(t), linear.sigmoid(m), self.both.probability(t + m)


def _fit_views(text, meta, y, held) -> Models | None:
    """Fit both views on rows of their own, and calibrate all on the held-out labelled rows."""
    (text_rows, text_y), (meta_rows, meta_y) = text, meta
    if len(set(text_y)) < 2 or len(set(meta_y)) < 2:
        return None
    held_text, held_meta = held
    models = Models(linear.fit(text_rows, np.array(text_y)),
                    linear.fit(meta_rows, np.array(meta_y), META_SIZE))
    text_logits = linear.score_sparse(models.text, held_text)
    meta_logits = linear.score_sparse(models.meta, held_meta)
    linear.calibrate(models.text, text_logits, y)
    linear.calibrate(models.meta, meta_logits, y)
    linear.calibrate(models.both, models.log_odds(models.text, text_logits)
                     + models.log_odds(models.meta, meta_logits), y)
    return models


def _score(docs: DataFrame, models: Models, carry: list[str]) -> DataFrame:
    """``carry`` columns with ``p_text``, ``p_meta`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    new = ["p_text", "p_meta", "score"]
    inner = [f"_in_{c}" for c in ("text", "lang", "source", "n_chars")]
    out = docs.select(*[c for c in carry if c not in new],
                      *[F.col(c[4:]).alias(c) for c in inner])

    def judge(batches):
        models: Models = shared.value
        for batch in tx.pieces(batches, "_in_text"):
            text, meta, sums = [], [], np.zeros(linear.FAMILIES)
            for part in tx.pieces(iter([batch]), "_in_text", PIECE):
                texts = linear.TextBatch(part.column("_in_text"))
                text.append(texts.logits(models.text.weights, models.text.bias, sums))
                view = pa.RecordBatch.from_arrays([part.column(c) for c in inner[1:]], names=[c[4:] for c in inner[1:]])
                buckets = meta_features(view, texts)
                meta.append(models.meta.weights[buckets].astype(np.float64).sum(axis=1) + models.meta.bias)
            found = models.score(np.concatenate(text), np.concatenate(meta))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-len(inner)], *(pa.array(p) for p in found)],
                                             names=[*batch.schema.names[:-len(inner)], *new])

    schema = out.drop(*inner).schema
    for name in new:
        schema = schema.add(name, "double")
    return tx.mapped(out, judge, schema)


def _text_hash() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _best(view: str) -> Column:
    """Of a group of rows the one of which a view is most certain."""
    return F.max(F.struct(F.abs(F.col(view) - 0.5), F.xxhash64("doc_id"), "doc_id", F.col(view).alias("p"))).alias(view)


def _picks(scores: DataFrame, view: str, limit: int) -> DataFrame:
    """Documents of which a view is certain, at most ``limit`` of each class; ``scores`` has a row of each text."""
    p = F.col("p")
    sure = scores.select("_hash", f"{view}.doc_id", f"{view}.p").filter(
        (p >= CONFIDENT) | (p <= 1 - CONFIDENT)).select(
        "_hash", "doc_id", p, (p > 0.5).cast("int").alias("_label"),
        F.floor(-F.log(F.greatest(F.least(p, 1 - p), F.lit(1e-9)))).alias("level"))
    order = F.xxhash64("_hash")
    for group, rank, by in (("p", "a", [order, "_hash"]), ("level", "b", ["a", order, "_hash"])):
        sure = sure.withColumn(rank, F.row_number().over(Window.partitionBy("_label", group).orderBy(*by))).filter(
            F.col(rank) <= limit)
    last = Window.partitionBy("_label").orderBy("b", F.desc("level"))
    return sure.withColumn("c", F.row_number().over(last)).filter(F.col("c") <= limit).select(
        "_hash", "doc_id", "_label")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", *, rounds: int = ROUNDS,
          picks: int = PICKS, limit: int = MAX_LABELLED) -> Models | None:
    """Co-train the views; None without labels of both classes."""
    labelled = rules.labelled_sample(docs, labels, label, limit, COLUMNS)
    text, meta, y = _views(_sample_rows(labelled))
    held = np.arange(len(y)) % 5 == 4
    of = lambda rows, keep: [r for r, k in zip(rows, keep) if k]
    held_rows = of(text, held), of(meta, held)
    text_set, meta_set = [of(text, ~held), list(y[~held])], [of(meta, ~held), list(y[~held])]
    models = _fit_views(text_set, meta_set, y[held], held_rows)
    known = labels.filter(F.col(label).isNotNull()).select("doc_id").distinct()
    known = known.withColumn("_known", F.lit(True))
    texts = docs.withColumn("_hash", _text_hash())
    earlier = dict.fromkeys(("p_text", "p_meta"))
    for _ in range(rounds if models else 0):
        scores = _score(texts, models, ["doc_id", "_hash"]).filter("doc_id is not null").join(
            known, "doc_id", "left").groupBy("_hash").agg(
            _best("p_text"), _best("p_meta"), F.max("_known").alias("_known"))
        scores = stored(scores.filter("_known is null").drop("_known"), "cotraining")
        for view, pupil in (("p_text", meta_set), ("p_meta", text_set)):
            past = earlier[view]
            fresh = scores if past is None else scores.join(F.broadcast(past.select("_hash")), "_hash", "left_anti")
            chosen = stored(_picks(fresh, view, picks), "picks")
            earlier[view] = chosen if past is None else past.unionByName(chosen)
            # At most 2 * picks rows of a hash and two numbers.
            new_text, new_meta, new_y = _views(_sample_rows(texts.select(*COLUMNS, "_hash").join(
                F.broadcast(chosen), ["doc_id", "_hash"]).dropDuplicates(["_hash"])))
            pupil[0] += new_meta if pupil is meta_set else new_text
            pupil[1] += list(new_y)
        models = _fit_views(text_set, meta_set, y[held], held_rows)
    return models


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "quality", threshold: float = THRESHOLD,
             carry: list[str] | None = None, **options) -> DataFrame:
    """The ``carry`` columns (all by default) with ``p_text``, ``p_meta``, ``score`` and ``kept``."""
    carry = docs.columns if carry is None else carry
    models = train(docs, labels, label, **options)
    if models is None:
        none = F.lit(None).cast("double")
        out = docs.select(*[c for c in carry if c not in ("p_text", "p_meta", "score")]).withColumns(
            {"p_text": none, "p_meta": none, "score": none})
    else:
        out = _score(docs, models, carry)
    return out.withColumn("kept", F.coalesce(F.col("score") >= threshold, F.lit(True)))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Both views and the combined score of every document."""
    return classify(docs, labels, carry=["doc_id"])
