"""Quality classifier by co-training of a text view and a metadata view.

Each view is a logistic regression: the text view on hashed words and on marks of layout in the text, the metadata
view on language, source, length and their like. A word counts once a text and a text's words have length one, so that
rare words of the fit's documents do not outweigh common ones. In each round both views score a pool of unlabelled
documents; what one is sure of becomes a label for the other. Pseudo-labels of a round are weighed to the balance of
the true labels, and a round in which a view is sure of one class only adds none, since it would teach just that class.
At the end each view is calibrated on labelled documents that no fit
has seen, and the documents' score is the combination of both calibrated views, fitted on the same documents.

Fits are bounded: at most ``labelled`` labelled and ``pool`` unlabelled documents, the first ones in the order of a
digest of their number, so the choice repeats and does not depend on partitions. Scores cover all documents, whole.

Documents without label are scored like the others; a label of a document that is not there is not used, nor is one
that is null; contradicting labels of a document count as the smallest. Null and empty texts have no words. Null
language and source are values of their own. If the labels have one class only, every document gets that class.
Rows that share a doc_id share labels.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from reqlens.llm.common import identity, renamed, text_key
from reqlens.session import cut_lineage

#: Most labelled and unlabelled documents of the fits, rounds, certainty of a pseudo-label, hashed dimensions.
LABELLED, POOL, ROUNDS, SURE, TEXT_BITS, META_BITS = 6_000, 6_000, 2, 0.97, 13, 8
#: One labelled document in HELD calibrates; penalty of the views' weights.
HELD, STRENGTH = 4, 1e-4
#: Partitions of a fit's rows, which LABELLED and POOL bound: so few need no shuffle of gradients in an iteration.
FIT_PARTS = 4


def _lines_and_marks(text: Column) -> Column:
    """Layout of the text in a few numbers between 0 and about 1: shares of kinds of characters and of short lines."""
    n = F.greatest(F.length(text), F.lit(1))
    kept = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    marks = F.length(text) - F.length(F.translate(text, "#*$%&|<>{}[]=_~^\\/", ""))
    stops = F.length(text) - F.length(F.translate(text, "!?", ""))
    return F.array(kept(r"\p{Lu}") / n, 10 * marks / n, 10 * stops / n, kept("[0-9]") / n, F.log1p(n) / 10)


def text_view(df: DataFrame) -> DataFrame:
    """``df`` with the text's terms: which hashed words it has, and the layout numbers."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    plain = F.split(F.lower(text), r"[^\p{L}\p{N}!?|#%$&*]+")
    out = df.withColumn("_words", F.filter(plain, lambda w: w != "")).withColumn("_layout", _lines_and_marks(text))
    hashed = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=1 << TEXT_BITS, binary=True).transform(out)
    return Normalizer(inputCol="_tf", outputCol="_unit").transform(hashed).drop("_words", "_tf")


def meta_view(df: DataFrame) -> DataFrame:
    """``df`` with the metadata's terms: hashed language and source, alone and together, and classes of length."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    size = F.coalesce(F.floor(F.log2(F.greatest(F.col("_chars"), F.lit(1)).cast("double"))).cast("string"), F.lit("-"))
    terms = F.array(F.concat(F.lit("l"), value("_lang")), F.concat(F.lit("s"), value("_source")), F.concat(F.lit("n"), size),
                    F.concat_ws("|", F.lit("ls"), value("_lang"), value("_source")), F.concat_ws("|", F.lit("ln"), value("_lang"), size))
    return HashingTF(inputCol="_terms", outputCol="x_meta", numFeatures=1 << META_BITS).transform(df.withColumn("_terms", terms)).drop("_terms")


def with_views(df: DataFrame) -> DataFrame:
    """``df`` with both feature vectors."""
    both = meta_view(text_view(df)).withColumn("_dense", array_to_vector("_layout"))
    both = VectorSizeHint(inputCol="_dense", size=5).transform(both)  # an empty table has no first row to look at
    return VectorAssembler(inputCols=["_unit", "_dense"], outputCol="x_text").transform(both).drop("_unit", "_dense", "_layout")


def _fit(rows: DataFrame, view: str, strength: float) -> LogisticRegressionModel:
    """A logistic regression in the features' own scale: in that of their deviations, a word of one text weighs most."""
    return LogisticRegression(featuresCol=view, labelCol="y", weightCol="w", maxIter=30, regParam=strength, standardization=False, tol=1e-4).fit(rows.coalesce(FIT_PARTS))


def _pseudo(scored: DataFrame, sure: float, balance: dict[float, float]) -> DataFrame:
    """Rows of ``scored`` (with p) that it is sure of, labelled, at half weight and in the balance of the true labels."""
    certain = scored.where(F.greatest("p", 1 - F.col("p")) >= sure).withColumn("y", (F.col("p") > 0.5).cast("double"))
    counts = {r.y: r.n for r in certain.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return certain.where("false").withColumn("w", F.lit(0.5)).drop("_m", "p")
    share = {y: n / sum(counts.values()) for y, n in counts.items()}
    weigh = {y: 0.5 * balance[y] / share[y] for y in share}
    return certain.withColumn("w", F.when(F.col("y") > 0.5, weigh[1.0]).otherwise(weigh[0.0])).drop("_m", "p")


def _margin(model: LogisticRegressionModel, rows: DataFrame, view: str, out: str) -> DataFrame:
    """``rows`` with the model's log-odds."""
    scored = model.setFeaturesCol(view).setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("").transform(rows)
    return scored.withColumn(out, vector_to_array("_raw")[1]).drop("_raw")


class CoTrained:
    """The fitted views, their calibrations and their combination."""

    def __init__(self, text, meta, calibrations, combination) -> None:
        self.text, self.meta, self.calibrations, self.combination = text, meta, calibrations, combination

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with views) and p_text, p_meta, score: probabilities of good quality."""
        out = _margin(self.meta, _margin(self.text, rows, "x_text", "_a"), "x_meta", "_b")
        (a0, a1), (b0, b1) = self.calibrations
        out = out.withColumn("_a", a0 + a1 * F.col("_a")).withColumn("_b", b0 + b1 * F.col("_b"))
        c0, c1, c2 = self.combination
        odds = lambda x: 1 / (1 + F.exp(-x))
        return out.withColumns({"p_text": odds(F.col("_a")), "p_meta": odds(F.col("_b")), "score": odds(c0 + c1 * F.col("_a") + c2 * F.col("_b"))}).drop("_a", "_b")


class OneClass:
    """All labels agree."""

    def __init__(self, label: float) -> None:
        self.label = label

    def score(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: F.lit(self.label) for c in ("p_text", "p_meta", "score")})


def _platt(rows: DataFrame, columns: list[str]) -> list[float]:
    """Intercept and slopes of a logistic fit to the columns."""
    x = rows.select(array_to_vector(F.array(*columns)).alias("x"), "y")
    model = LogisticRegression(featuresCol="x", labelCol="y", maxIter=15, regParam=1e-3).fit(x)
    return [float(model.intercept), *map(float, model.coefficients)]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS, sure: float = SURE):
    """Train on ``docs`` (_id, _text, _lang, _source, _chars) and ``labels`` (doc_id, quality)."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").cast("double").alias("y"))
    ids = docs.select("_id").join(known, "_id", "left").groupBy("_id").agg(F.min("y").alias("y")).withColumn("_key", F.md5(F.concat(F.lit("co:"), F.col("_id").cast("string"))))
    ids = cut_lineage(ids, "ids")
    some = ids.where("y is not null").orderBy("_key", "_id").limit(labelled).unionByName(ids.where("y is null").orderBy("_key", "_id").limit(pool))
    rows = docs.join(F.broadcast(cut_lineage(some, "chosen")), "_id").dropDuplicates(["_id"])
    rows = cut_lineage(with_views(rows).drop("_text"), "views").coalesce(FIT_PARTS).persist(StorageLevel.MEMORY_AND_DISK)
    seen = rows.where("y is not null")
    classes = [r.y for r in seen.groupBy("y").agg(F.count(F.lit(1))).collect()]
    if len(classes) < 2:
        rows.unpersist()
        return OneClass(float(classes[0]) if classes else 1.0)
    part = F.pmod(F.conv(F.substring("_key", 1, 4), 16, 10).cast("int"), F.lit(HELD))
    learn, held = seen.where(part > 0), seen.where(part == 0)
    if learn.select("y").distinct().count() < 2 or held.select("y").distinct().count() < 2:
        learn = held = seen
    free = rows.where("y is null").drop("y")
    one = F.lit(1.0)
    counts = {r.y: r.n for r in learn.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    balance = {y: n / sum(counts.values()) for y, n in counts.items()}
    text, meta = _fit(learn.withColumn("w", one), "x_text", STRENGTH), _fit(learn.withColumn("w", one), "x_meta", STRENGTH)
    for _ in range(rounds):
        by_text = _margin(text, free, "x_text", "_m").withColumn("p", 1 / (1 + F.exp(-F.col("_m"))))
        by_meta = _margin(meta, free, "x_meta", "_m").withColumn("p", 1 / (1 + F.exp(-F.col("_m"))))
        base = learn.withColumn("w", one)
        text, meta = _fit(base.unionByName(_pseudo(by_meta, sure, balance)), "x_text", STRENGTH), _fit(base.unionByName(_pseudo(by_text, sure, balance)), "x_meta", STRENGTH)
    margins = _margin(meta, _margin(text, held, "x_text", "_a"), "x_meta", "_b").select("y", "_a", "_b")
    a, b = _platt(margins, ["_a"]), _platt(margins, ["_b"])
    calibrated = margins.select("y", (a[0] + a[1] * F.col("_a")).alias("_a"), (b[0] + b[1] * F.col("_b")).alias("_b"))
    model = CoTrained(text, meta, (a, b), _platt(calibrated, ["_a", "_b"]))
    rows.unpersist()
    return model


def classify(
    df: DataFrame, labels: DataFrame, threshold: float = 0.5, doc: str = "doc_id", text: str = "text", lang: str = "lang",
    source: str = "source", **bounds,
) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept, text_key) of every row: kept if the score reaches the threshold."""
    rows = renamed(df, {doc: "_doc", text: "_text", lang: "_lang", source: "_source"})
    rows = rows.withColumn("_id", identity("_doc", "_text")).withColumn("_chars", F.length("_text"))
    model = fit(rows.drop("_doc"), labels, **bounds)
    scored = model.score(with_views(rows.withColumn("_key", text_key("_text"))))
    return scored.select(F.col("_doc").alias("doc_id"), "p_text", "p_meta", "score", (F.col("score") >= threshold).alias("kept"), F.col("_key").alias("text_key"))
