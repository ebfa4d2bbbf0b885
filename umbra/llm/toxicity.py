"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words (a small fixed one, and one learnt as word beginnings from labelled rows),
lexicon words near a second person, and rates of capitals, punctuation, digits, drawn-out letters and obfuscated words.
Words are compared in lower case with look-alike digits and signs read as letters.

Labels come from training rows alone (crc32 of the id as text, mod 4, is not 2), at most SAMPLE_ROWS of them, taken in
the order of a hash of the id. The beginnings are learnt on one half for the features of the other and the other way
round, the trees on two thirds, the calibration on the last third; beginnings for scoring come from the whole sample.
No other column but the text is an input of a score.

Scores are the calibrated shares, with a thousandth of the trees' own output mixed in, so that texts of one step of the
calibration keep their order.

Defined results: a null doc_id is not held out; null and empty texts have all features 0 and are scored as such; a document with both labels counts as
toxic; null labels don't count; if the sample lacks one of the labels, all scores are its share of toxic rows (0 without
rows); repeated rows are scored each for itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm import chunks, common

#: Labelled rows that a fit uses at most.
SAMPLE_ROWS = 10_000
THRESHOLD = 0.3
#: Share of the trees' own output in a score.
OWN = 0.001
#: Words between a lexicon word and a second person that count as near.
NEAR = 5
LENGTHS = (3, 4, 5, 6, 7, 8)
#: A beginning is kept if so many toxic texts of the sample have it and its log-odds are at least so high.
LEAST_TEXTS, LEAST_ODDS = 3, 1.5

# Common insults, second persons in four languages, and look-alikes.
INSULTS = "clown disgusting dumb fool garbage hate idiot jerk loser moron pathetic scum shut stupid trash ugly useless vermin worthless".split()
PERSONS = "you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted vosotros tus".split()
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

FEATURES = ("fixed_density", "learnt_sum", "learnt_density", "learnt_highest", "learnt_hits", "near_person", "person_rate", "capital_rate", "exclaim_rate", "punctuation_rate", "digit_rate", "drawn_rate", "obfuscated_rate", "log_words")

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_READ = np.arange(256, dtype=np.uint8)
_READ[65:91] += 32
_MASKED = np.zeros(256, bool)
for _a, _b in LOOK_ALIKES.items():
    _READ[ord(_a)], _MASKED[ord(_a)] = ord(_b), True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[33:48] = _PUNCTUATION[58:65] = _PUNCTUATION[91:97] = _PUNCTUATION[123:127] = True


def codes(read: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """The first bytes of each word as an integer; 0 where the word is shorter."""
    out = np.zeros(len(first), np.uint64)
    for k in range(length):
        out = out << np.uint64(8) | read[np.minimum(first + k, len(read) - 1)]
    return np.where(last - first >= length, out, 0)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text as read, and its words: runs of letters and look-alikes with at least one letter in front or behind."""
    first, last = chunks.starts(data, bounds, _LETTER[data] | _MASKED[data])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    keep = letters[last] > letters[first]
    return _READ[data], first[keep], last[keep]


def _hashed(lexicon: list[str]) -> np.ndarray:
    ends = np.cumsum([0, *(len(w.encode()) for w in lexicon)])
    return common.hashes(np.frombuffer("".join(lexicon).encode(), np.uint8), ends[:-1], ends[1:])


def features(data: np.ndarray, bounds: np.ndarray, lexicon: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of FEATURES for each text; lexicon has sorted codes and weights of beginnings by length."""
    n = len(bounds) - 1
    if not len(data):
        return np.zeros((n, len(FEATURES)))
    read, first, last = words(data, bounds)
    upto = np.searchsorted(first, bounds)

    def per_word(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.float64)])[upto])

    def per_byte(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.float64)])[bounds])

    count, size = np.maximum(np.diff(upto), 1), np.maximum(np.diff(bounds), 1)
    weight = np.zeros(len(first))
    for length, (known, value) in lexicon.items():
        if len(known):
            code = codes(read, first, last, length)
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            weight = np.maximum(weight, np.where(known[at] == code, value[at], 0))
    whole = common.hashes(read, first, last)
    fixed, person = np.isin(whole, _hashed(INSULTS)), np.isin(whole, _hashed(PERSONS))
    hit = (weight > 0) | fixed
    text = np.searchsorted(upto, np.arange(len(first)), side="right") - 1
    persons = np.concatenate([[0], np.cumsum(person)])
    place = np.arange(len(first))
    around = persons[np.minimum(place + NEAR + 1, upto[text + 1])] - persons[np.maximum(place - NEAR, upto[text])]
    highest = np.zeros(n)
    np.maximum.at(highest, text[weight > 0], weight[weight > 0])
    masked = np.concatenate([[0], np.cumsum(_MASKED[data])])
    letter = _LETTER[data]
    drawn = np.zeros(len(data), bool)
    drawn[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:]
    letters = np.maximum(per_byte(letter), 1)
    return np.stack([
        per_word(fixed) / count, per_word(weight), per_word(weight > 0) / count, highest, per_word(weight > 0), per_word(hit & (around > 0)), per_word(person) / count,
        per_byte((data >= 65) & (data < 91)) / letters, per_byte(data == 33) / size, per_byte(_PUNCTUATION[data]) / size, per_byte((data >= 48) & (data < 58)) / size, per_byte(drawn) / letters,
        per_word(masked[last] > masked[first]) / count, np.log1p(np.diff(upto)),
    ], axis=1)


def training_column(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, toxic, fold (0 to 5): at most `rows` labelled training rows, as a stored table."""
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("id").isNotNull() & training_column("id"))
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(rows)  # a top-k of bounded size
    texts = common.id_text(docs)
    found = texts.join(F.broadcast(marks), texts["doc_id"] == marks["id"]).drop("id")
    found = found.dropDuplicates(["doc_id"])
    return common.stored(found.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(6)).cast("int")), "labelled")


def lexicons(labelled: DataFrame) -> list[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Beginnings with log-odds, learnt on odd folds, on even folds, and on all. As large as the bounded sample makes them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[int, int, int, int]] = Counter()
        for batch in common.steps(batches):
            data, bounds = common.bytes_view(batch.column(1))
            if not len(data):
                continue
            read, first, last = words(data, bounds)
            upto = np.searchsorted(first, bounds)
            half, toxic = (batch.column(3).to_numpy() % 2).tolist(), batch.column(2).to_numpy().tolist()
            for length in LENGTHS:
                code = codes(read, first, last, length)
                for i in range(batch.num_rows):
                    counts.update([(half[i], length, c, toxic[i]) for c in np.unique(code[upto[i] : upto[i + 1]]).tolist() if c])
        if counts:
            keys = list(counts)
            yield common.record(["half", "length", "code", "toxic", "n"], [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(np.array([k[2] for k in keys], np.uint64).view(np.int64)), pa.array([k[3] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())])

    rows = labelled.select("doc_id", "text", "toxic", "fold").mapInArrow(common.lean(run), "half int, length int, code long, toxic int, n long")
    sums = rows.groupBy("length", "code").agg(*[F.sum(F.when((F.col("half") == h) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{h}{t}") for h in (0, 1) for t in (0, 1)])
    kept = sums.where(F.col("n01") + F.col("n11") >= LEAST_TEXTS).toPandas()
    all_ = {(r.half, r.toxic): r.n for r in labelled.groupBy((F.col("fold") % 2).alias("half"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for halves in ((1,), (0,), (0, 1)):
        toxic, clean = (sum(kept[f"n{h}{t}"].to_numpy() for h in halves) for t in (1, 0))
        n_toxic, n_clean = (sum(all_.get((h, t), 0) for h in halves) for t in (1, 0))
        odds = np.log((toxic + 0.1) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
        good = (toxic >= max(2, LEAST_TEXTS * len(halves) // 2)) & (odds >= LEAST_ODDS)
        lexicon = {}
        for length in LENGTHS:
            at = np.flatnonzero(good & (kept["length"].to_numpy() == length))
            code = kept["code"].to_numpy()[at].astype(np.int64).view(np.uint64)
            order = np.argsort(code)
            lexicon[length] = code[order], odds[at][order]
        out.append(lexicon)
    return out


def with_features(docs: DataFrame, lexicon, keep: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """The columns (name, type) in `keep`, and FEATURES of the text as doubles."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = [n for n, _ in keep]
    columns = [*dict.fromkeys([*names, text])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, text):
            rows = features(*common.bytes_view(batch.column(columns.index(text))), shared.value)
            yield common.record([*names, *FEATURES], [*batch.columns[: len(names)], *(pa.array(np.ascontiguousarray(c)) for c in rows.T)])

    return docs.select(*columns).mapInArrow(common.lean(run), ", ".join([f"`{n}` {t}" for n, t in keep] + [f"{f} double" for f in FEATURES]))


def _scored(docs: DataFrame, labels: DataFrame, table: DataFrame, keep: list[tuple[str, str]], text: str, rows: int) -> DataFrame:
    """The columns in `keep` of the table, __umbra_score of its text; fitted to the labelled rows of docs."""
    labelled = sample(docs, labels, rows)
    share = labelled.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    if not share.n or not 0 < share.toxic < share.n:
        value = float(share.toxic / share.n) if share.n else 0.0
        return table.select(*[n for n, _ in keep], F.lit(value).alias("__umbra_score"))
    for_even, for_odd, full = lexicons(labelled)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    halves = [with_features(labelled.where(F.col("fold") % 2 == h), lex, [("toxic", "int"), ("fold", "int")]) for h, lex in ((0, for_even), (1, for_odd))]
    rows_ = common.stored(halves[0].unionByName(halves[1]), "features")
    train = vectors.transform(rows_).select("features", F.col("toxic").cast("double").alias("label"), "fold")
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, seed=7, maxBins=32).fit(train.where(F.col("fold") < 4))
    raw = vector_to_array("probability")[1]
    judged = trees.transform(train.where(F.col("fold") >= 4)).select(raw.alias("raw"), "label")
    fitted = IsotonicRegression(featuresCol="raw", predictionCol="score").fit(judged)
    found = trees.transform(vectors.transform(with_features(table, full, keep, text)).select(*[n for n, _ in keep], "features"))
    scored = fitted.transform(found.select(*[n for n, _ in keep], raw.alias("raw")))
    mixed = F.lit(1 - OWN) * F.col("score") + F.lit(OWN) * F.col("raw")
    return scored.select(*[n for n, _ in keep], F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0)).alias("__umbra_score"))


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each text."""
    found = _scored(docs, labels, common.id_text(docs), [("doc_id", "bigint")], "text", rows)
    held_out = F.coalesce(~training_column(), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), F.col("__umbra_score").alias("score"), (F.col("__umbra_score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (all columns) without the rows that are predicted toxic: each row is decided by its own text, in one pass."""
    table, keep = common.renamed(docs)
    found = _scored(docs, labels, table, keep, keep[docs.columns.index("text")][0], SAMPLE_ROWS)
    return found.where(F.col("__umbra_score") < THRESHOLD).drop("__umbra_score").toDF(*docs.columns)


def op8_boosted_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
