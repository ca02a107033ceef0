"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features (the text alone): densities of a fixed lexicon and of a lexicon learned from the training rows (whole words
and word beginnings, so that inflected forms count), the share of hits near a second-person word, capitals,
punctuation, digits, symbols inside words and lexicon words that only appear after undoing look-alike symbols.

Training uses labelled rows whose crc32(doc_id as text) mod 3 is not 1, at most about SAMPLE of them, chosen by a hash
of doc_id (a documented bound: the model does not grow with the corpus).  Lexicons for training rows are learned
without the row's own fold; trees are calibrated on out-of-fold scores by pooled adjacent violators.

Scale: texts are read in place (one pass for training rows behind a broadcast of at most SAMPLE label rows, one to
score) and never shuffled.  The model is some hundred kilobytes.

Edge cases: null and empty texts get the score of a text without words; without labels of both classes every score
is the smoothed share of toxic labels (0.5 without any); several labels of one doc_id count by majority, ties as
toxic; null labels don't count; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from covey.llm.boosting import Boosted, isotonic
from covey.llm.common import BASE, BYTE_CODE, LOWER, blocks, inverse, mix, powers, spans, text_bytes, trimmed
from covey.llm.common import _pieces as pieces

SAMPLE = 16_000
FOLDS = 4
THRESHOLD = 0.7
NEAR = 6
PREFIXES = (5, 6, 7, 8)
LEAST_SHARE = 0.004

# fixed values: common insults, and words that address the reader
LEXICON = "idiot idiots moron morons stupid dumb dumbass trash garbage scum loser losers clown pathetic worthless disgusting filthy vermin imbecile cretin fool foolish ugly hate hateful bastard bitch whore slut asshole shit crap bullshit fuck fucking fucker retard retarded freak pervert parasite coward liar jerk dirtbag lowlife scumbag idiota estúpido estúpida imbécil basura asqueroso payaso crétin abruti ordure minable connard dégoûtant dummkopf trottel abschaum widerlich versager blödmann".split()
SECOND_PERSON = "you your yours yourself yourselves ur u tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie usted ustedes ti tuyo vosotros".split()
# fixed values: symbols that stand for letters
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
for _c in LOOKALIKE:
    _SYMBOL[ord(_c)] = True
_SYMBOL[[ord("*"), ord("#"), ord("-"), ord("."), ord("_")]] = True
_PLAIN = _LETTER | _DIGIT
_PLAIN[39] = True
_HIDDEN = _LETTER | _DIGIT
_SHOWN = LOWER.copy()
for _c, _to in LOOKALIKE.items():
    _HIDDEN[ord(_c)] = True
    _SHOWN[ord(_c)] = ord(_to)

FEATURES = [
    "words", "bytes_a_word", "upper_share", "shouted_share", "exclamations", "questions", "punctuation", "digits", "repeats", "symbols_inside", "hidden_hits", "hidden_density", "fixed_hits", "fixed_density",
    "second_person", "strong_hits", "strong_density", "weak_hits", "weak_density", "begin_hits", "begin_density", "near_share", "near_hits", "weight_density",
]


def word_hash(word: str) -> int:
    codes = BYTE_CODE[LOWER[np.frombuffer(word.encode(), np.uint8)]]
    return int(mix(np.array([np.sum(codes * powers(BASE, len(codes)))], np.uint64))[0])


class Terms:
    """A set of hashed terms with weights, and quick lookup for many hashes."""

    def __init__(self, hashes, weights=None):
        hashes = np.asarray(hashes, np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.weights = (np.ones(len(hashes)) if weights is None else np.asarray(weights, float))[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Weight of each hash, 0 where it isn't a term."""
        out = np.zeros(len(h))
        if len(self.hashes):
            at = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            hit = self.hashes[k] == h[at]
            out[at[hit]] = self.weights[k[hit]]
        return out


FIXED = Terms([word_hash(w) for w in LEXICON])
ADDRESS = Terms([word_hash(w) for w in SECOND_PERSON])


class Pass:
    """One pass over the bytes of a block of rows: token hashes with rows, and sums for each row."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.n = len(off) - 1
        rows, kinds, hidden, self.sums = [], [[] for _ in range(1 + len(PREFIXES))], [], np.zeros((self.n, 9))
        shouted = []
        for p, q in pieces(buf, off):
            b = buf[p:q]
            row = np.searchsorted(off, np.arange(p, q), "right") - 1
            r0, width = int(row[0]), int(row[-1] - row[0] + 1)
            letter, upper = _LETTER[b], _UPPER[b]
            mark = _SYMBOL[b] | _DIGIT[b]
            inside = np.zeros(q - p, bool)
            inside[1:-1] = mark[1:-1] & letter[:-2] & letter[2:]
            again = np.zeros(q - p, bool)
            again[2:] = (b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & letter[2:]
            punct = ((b >= 33) & (b < 48)) | ((b >= 58) & (b < 65)) | ((b >= 91) & (b < 97)) | ((b >= 123) & (b < 127))
            for k, flag in enumerate((upper, letter & (b < 128), b == 33, b == 63, punct, _DIGIT[b], again, inside)):
                self.sums[r0 : r0 + width, k] += np.bincount(row[flag] - r0, minlength=width)
            s, e = spans(buf, off, p, q, _PLAIN)
            codes = (BYTE_CODE[LOWER])[b] * powers(BASE, q - p)
            total = np.zeros(q - p + 1, np.uint64)
            np.cumsum(codes, out=total[1:])
            back = powers(inverse(BASE), q - p + 1)[s]
            kinds[0].append(mix((total[e] - total[s]) * back))
            for k, width_ in enumerate(PREFIXES):
                cut = np.where(e - s > width_, s + width_, s)  # only proper beginnings
                kinds[k + 1].append(np.where(cut > s, mix((total[cut] - total[s]) * back, salt=width_), 0).astype(np.uint64))
            rows.append(row[s])
            ups = np.zeros(q - p + 1, np.int64)
            np.cumsum(upper, out=ups[1:])
            shouted.append((ups[e] - ups[s] == e - s) & (e - s >= 3))
            s2, e2 = spans(buf, off, p, q, _HIDDEN)
            np.cumsum((BYTE_CODE[_SHOWN])[b] * powers(BASE, q - p), out=total[1:])
            shown = mix((total[e2] - total[s2]) * powers(inverse(BASE), q - p + 1)[s2])
            changed = np.zeros(q - p + 1, np.int64)
            np.cumsum(_SHOWN[b] != LOWER[b], out=changed[1:])
            keep = changed[e2] > changed[s2]
            hidden.append((row[s2][keep], shown[keep]))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.row, self.kinds = join(rows, np.int64), [join(k, np.uint64) for k in kinds]
        self.shouted = join(shouted, bool)
        self.hidden_row, self.hidden = join([x[0] for x in hidden], np.int64), join([x[1] for x in hidden], np.uint64)
        self.bytes = np.diff(off)

    def features(self, learned: list[Terms]) -> np.ndarray:
        n = self.n
        count = lambda flag: np.bincount(self.row[flag], minlength=n).astype(float)
        words = np.bincount(self.row, minlength=n).astype(float)
        of, size = np.maximum(words, 1), np.maximum(self.bytes, 1)
        fixed, second = FIXED.find(self.kinds[0]) > 0, ADDRESS.find(self.kinds[0]) > 0
        whole = learned[0].find(self.kinds[0])
        begin = np.max([t.find(k) for t, k in zip(learned[1:], self.kinds[1:])], axis=0) if len(self.row) else np.zeros(0)
        strong, weak = whole >= 2.5, (whole > 0) & (whole < 2.5)
        hit = fixed | strong | (begin >= 2.5)
        near = np.zeros(len(self.row), bool)
        if hit.any():
            seen = np.r_[0, np.cumsum(second)]
            edge = np.searchsorted(self.row, np.arange(n + 1))
            at = np.flatnonzero(hit)
            lo, hi = np.maximum(at - NEAR, edge[self.row[at]]), np.minimum(at + NEAR + 1, edge[self.row[at] + 1])
            near[at] = seen[hi] > seen[lo]
        masked = FIXED.find(self.hidden) + learned[0].find(self.hidden) > 0
        hidden = np.bincount(self.hidden_row[masked], minlength=n).astype(float)
        weight = np.bincount(self.row, np.maximum(whole, begin), minlength=n) if len(self.row) else np.zeros(n)
        up, ascii_letters, bang, ask, punct, digit, again, inside = self.sums[:, :8].T
        hits, nears = count(hit), count(near)
        f, s, w, b = count(fixed), count(strong), count(weak), count(begin > 0)
        return np.stack([
            np.log1p(words), size / of, up / np.maximum(ascii_letters, 1), count(self.shouted) / of, bang / of, ask / of, punct / size, digit / size, again / of, inside / of, np.log1p(hidden), hidden / of, np.log1p(f), f / of,
            count(second) / of, np.log1p(s), s / of, np.log1p(w), w / of, np.log1p(b), b / of, nears / np.maximum(hits, 1), np.log1p(nears), weight / of,
        ], axis=1)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, term, fold, toxic documents, clean documents) with the term, summed over the task's training rows."""
    parts: list[list[np.ndarray]] = [[] for _ in range(1 + len(PREFIXES))]
    for batch in batches:
        off, buf = text_bytes(batch.column(0))
        tag = np.asarray(batch.column(1)).astype(np.int64) * 2 + np.asarray(batch.column(2)).astype(np.int64)
        for i, j in blocks(off):
            seen = Pass(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            for k, h in enumerate(seen.kinds):
                both = np.stack([h, seen.row.astype(np.uint64)], axis=1)[h != 0]
                both = np.unique(both, axis=0)
                parts[k].append(np.stack([both[:, 0], tag[i:j][both[:, 1].astype(np.int64)].astype(np.uint64)], axis=1))
    for k, items in enumerate(parts):
        if not items:
            continue
        pair, times = np.unique(np.concatenate(items), axis=0, return_counts=True)
        toxic = (pair[:, 1] & np.uint64(1)).astype(bool)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(pair), k, np.int32)), pa.array(pair[:, 0].view(np.int64)), pa.array((pair[:, 1] >> np.uint64(1)).astype(np.int32)), pa.array(np.where(toxic, times, 0)), pa.array(np.where(toxic, 0, times))],
            ["kind", "term", "fold", "toxic", "clean"],
        )


def _chosen(kind: np.ndarray, term: np.ndarray, pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> list[Terms]:
    """For each kind, the terms whose log odds ratio is surely above a bound, with that lower bound as weight.

    All of them: a term is in LEAST_SHARE of the toxic training texts at least, so there are as many as the terms of a
    text over LEAST_SHARE at most, whatever the corpus.
    """
    low = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1)) - 2.0 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    good = (low > 1.0) & (pos >= max(4, np.ceil(LEAST_SHARE * n_pos)))
    out = []
    for k in range(1 + len(PREFIXES)):
        at = np.flatnonzero(good & (kind == k))
        out.append(Terms(term[at].view(np.uint64), low[at]))
    return out


class Model:
    """learned: terms of all training rows; trees and knots: None where one class is missing, then ``rate`` scores."""

    def __init__(self, learned, trees, knots, rate):
        self.learned, self.trees, self.knots, self.rate = learned, trees, knots, rate

    def score(self, seen: Pass) -> np.ndarray:
        if self.trees is None:
            return np.full(seen.n, self.rate)
        return np.clip(np.interp(self.trees.predict(seen.features(self.learned)), *self.knots), 0.0, 1.0)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, fold, toxic) of at most about ``sample`` labelled documents that are not held out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    rows = rows.groupBy("doc_id").agg((F.avg(F.col("toxic").cast("double")) >= 0.5).cast("int").alias("toxic"))
    share = min(1.0, sample / max(1, rows.count()))
    spread = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20))
    return rows.where(spread < int(share * (1 << 20))).select("doc_id", F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "toxic")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    chosen = training_labels(labels, sample)
    ours = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "fold", "toxic")
    schema = StructType([StructField("kind", IntegerType()), StructField("term", LongType()), StructField("fold", IntegerType()), StructField("toxic", LongType()), StructField("clean", LongType())])
    totals = {(r["fold"], r["toxic"]): r["count"] for r in ours.groupBy("fold", "toxic").count().collect()}
    n_pos, n_neg = (sum(n for (_, t), n in totals.items() if t == k) for k in (1, 0))
    rate = (n_pos + 0.5) / (n_pos + n_neg + 1)
    if not n_pos or not n_neg:
        return Model(None, None, None, rate)
    counts = ours.mapInArrow(trimmed(_term_rows), schema).groupBy("kind", "term").agg(*[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("toxic", "clean")])
    least = max(4, int(np.ceil(LEAST_SHARE * n_pos * (1 - 1.0 / FOLDS))))
    likely = sum(F.col(f"toxic{f}") for f in range(FOLDS))
    other = sum(F.col(f"clean{f}") for f in range(FOLDS))
    found = counts.where((likely >= least) & (likely * float(n_neg) > 2.0 * other * float(n_pos))).toArrow()
    kind, term = np.asarray(found["kind"]), np.asarray(found["term"])
    pos, neg = (np.stack([np.asarray(found[f"{c}{f}"]) for f in range(FOLDS)]).astype(float) for c in ("toxic", "clean"))
    of = lambda f, t: float(totals.get((f, t), 0))
    learned = _chosen(kind, term, pos.sum(0), neg.sum(0), n_pos, n_neg)
    without = [_chosen(kind, term, pos.sum(0) - pos[f], neg.sum(0) - neg[f], n_pos - of(f, 1), n_neg - of(f, 0)) for f in range(FOLDS)]
    shared = spark.sparkContext.broadcast(without)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, buf = text_bytes(batch.column(0))
            fold = np.asarray(batch.column(1))
            for i, j in blocks(off):
                seen = Pass(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                each = np.stack([seen.features(t) for t in shared.value])
                x = each[fold[i:j], np.arange(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], ["fold", "toxic", "x"])

    table = ours.mapInArrow(trimmed(rows), StructType([StructField("fold", IntegerType()), StructField("toxic", IntegerType()), StructField("x", ArrayType(DoubleType()))])).toArrow()
    x = np.asarray(table["x"].combine_chunks().flatten() if table.num_rows else np.zeros(0)).reshape(-1, len(FEATURES))
    y, fold = np.asarray(table["toxic"]), np.asarray(table["fold"])
    order = np.lexsort((*x.T[::-1], y, fold))  # rows come in any order; trees must not depend on it
    x, y, fold = x[order], y[order], fold[order]
    out_of_fold = np.zeros(len(y))
    for f in range(FOLDS):
        rest = fold != f
        if rest.any() and not rest.all():
            out_of_fold[~rest] = Boosted().fit(x[rest], y[rest]).predict(x[~rest])
    shared.unpersist()
    return Model(learned, Boosted().fit(x, y), isotonic(out_of_fold, y), rate)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``docs`` (doc_id, text and any others) with held_out, score and predicted; such columns of the input are replaced."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    added = ["held_out", "score", "predicted"]
    rest = [c for c in docs.columns if c not in (*added, "text")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, buf = text_bytes(batch.column(0))
            score = [model.value.score(Pass(buf[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in blocks(off)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(score) if score else np.zeros(0))], [*batch.schema.names, "score"])

    rows = docs.select("text", *rest, held_out().alias("held_out"))
    out = rows.mapInArrow(trimmed(scored), StructType([*rows.schema.fields, StructField("score", DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")
