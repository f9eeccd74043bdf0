"""Learned baselines with Spark ML: text features, weighted models, out-of-fold scores, thresholds."""

from __future__ import annotations

import json
import uuid

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import NGram, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from versight import lexicons as L
from versight.functions.ranges import running
from versight.functions.store import written
from versight.operators import anchors as A, timeline, verify


def frame(examples: DataFrame) -> DataFrame:
    """Adds the combined text, its words and its character 3- to 5-grams."""
    text = F.concat_ws(" ", *(F.when(F.col(c) != "", F.col(c)) for c in ("book_name", "character", "caption", "content")))
    low = F.lower("combined_text")
    # a look-ahead at every place but the middle of a pair of surrogates, so long texts take linear time
    parts = [F.regexp_extract_all(low, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{n}}}))"), F.lit(1)) for n in (3, 4, 5)]
    return examples.withColumn("combined_text", text).withColumns({"words": F.regexp_extract_all(low, F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), "chars": F.concat(*parts)})


class TermWeights(Estimator):
    """Sublinear TF-IDF of token arrays, over every term of the training rows.

    1 + ln(tf) times ln((1 + n) / (1 + df)) + 1, scaled to unit length. Terms are numbered by
    their order, their number is counted first, and the vocabulary is a table that is joined
    to the rows' terms; nothing is cut and it never goes to the driver.
    """

    def __init__(self, inputCol: str, outputCol: str):
        super().__init__()
        self.inputCol, self.outputCol = inputCol, outputCol

    def _fit(self, dataset: DataFrame) -> TermWeightsModel:
        n = dataset.count()
        df = dataset.select(F.explode(F.array_distinct(self.inputCol)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        df = written(df.select("term", F.xxhash64("term").alias("h"), (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf")), "terms")
        # numbers are offsets of counts by hash range, so no task sorts all terms
        cells = df.groupBy(F.shiftrightunsigned("h", 52).alias("cell")).agg(F.count("*").alias("n"))
        before = cells.select("cell", (F.sum("n").over(W.orderBy("cell")) - F.col("n")).alias("before"))
        placed = df.withColumn("cell", F.shiftrightunsigned("h", 52)).join(F.broadcast(before), "cell")
        number = (F.col("before") + F.row_number().over(W.partitionBy("cell").orderBy("h", "term")) - 1).cast("int")
        table = written(placed.select("term", number.alias("number"), "idf"), "vocabulary")
        return TermWeightsModel(table, table.count(), self.inputCol, self.outputCol)


def write_bucketed(table: DataFrame, path: str, *, by: str, buckets: int) -> None:
    """``table`` as Parquet below ``path``, hashed by ``by`` into files that Spark knows as buckets (see ``read_bucketed``)."""
    name = f"versight_{uuid.uuid4().hex}"
    table.write.option("path", path).bucketBy(buckets, by).sortBy(by).saveAsTable(name)
    table.sparkSession.sql(f"DROP TABLE {name}")  # external: the files stay


def read_bucketed(spark: SparkSession, path: str, schema: str, *, by: str, buckets: int) -> DataFrame:
    """What ``write_bucketed`` has written; a join on ``by`` with rows hashed alike doesn't shuffle it, a lookup reads its bucket only."""
    name = f"versight_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the frame keeps its files and buckets
    return found


class _TermWeightsWriter(MLWriter):
    def __init__(self, model: TermWeightsModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        # about a million terms a bucket
        kept = {"size": m.size, "inputCol": m.inputCol, "outputCol": m.outputCol, "buckets": 1 + m.size // (1 << 20)}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"termWeights": kept})
        write_bucketed(m.table, f"{path}/vocabulary", by="term", buckets=kept["buckets"])


class _TermWeightsReader(MLReader):
    def load(self, path: str) -> TermWeightsModel:
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        kept = told["termWeights"]
        table = read_bucketed(self.sparkSession, f"{path}/vocabulary", "term STRING, number INT, idf DOUBLE", by="term", buckets=kept["buckets"])
        model = TermWeightsModel(table, kept["size"], kept["inputCol"], kept["outputCol"])
        model._resetUid(told["uid"])
        return model


class TermWeightsModel(Model, MLWritable, MLReadable):
    """Adds the weights as a sparse vector; terms that training has not seen are left out.

    Saved with its vocabulary as a table in buckets of terms, never as one object.
    """

    def __init__(self, table: DataFrame, size: int, inputCol: str, outputCol: str):
        super().__init__()
        self.table, self.size, self.inputCol, self.outputCol = table, max(1, size), inputCol, outputCol

    def write(self) -> _TermWeightsWriter:
        return _TermWeightsWriter(self)

    @classmethod
    def read(cls) -> _TermWeightsReader:
        return _TermWeightsReader()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = dataset.withColumn("_row", F.monotonically_increasing_id())
        rows = written(rows, "rows")
        tf = rows.select("_row", F.explode(self.inputCol).alias("term")).groupBy("_row", "term").agg(F.count("*").alias("tf"))
        weighted = tf.join(self.table, "term").select("_row", "number", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
        packed = weighted.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("number", "w"))).alias("x"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        size = self.size

        @F.udf(VectorUDT(), useArrow=True)  # in Arrow batches
        def vector(indices, values):
            return Vectors.sparse(size, [] if indices is None else indices, [] if values is None else values)

        packed = packed.select("_row", vector(F.transform("x", lambda e: e["number"]), F.transform("x", lambda e: e["w"] / F.col("norm"))).alias(self.outputCol))
        out = rows.join(packed, "_row", "left")
        none = vector(F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<double>)"))
        return out.withColumn(self.outputCol, F.coalesce(F.col(self.outputCol), none)).drop("_row")


def features() -> list:
    """Stages to the column ``features``: word 1-3-gram and character TF-IDF (sublinear, every term), one-hot book and character."""
    stages, inputs = [], []
    for n in (1, 2, 3):
        stages.append(NGram(n=n, inputCol="words", outputCol=f"w{n}"))
    stages.append(SQLTransformer(statement="SELECT *, concat(w1, w2, w3) AS grams FROM __THIS__"))
    for c in ("grams", "chars"):
        stages.append(TermWeights(c, f"{c}_idf"))
        inputs.append(f"{c}_idf")
    for c in ("book_name", "character"):
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}_ix", outputCol=f"{c}_hot")]
        inputs.append(f"{c}_hot")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def text_models() -> dict:
    return {
        "logistic_regression": LogisticRegression(weightCol="weight", maxIter=50),
        "linear_svc": LinearSVC(weightCol="weight", maxIter=50),
        "complement_nb": NaiveBayes(modelType="complement", weightCol="weight"),
    }


def meta_models() -> dict:
    return {
        "logistic_regression": LogisticRegression(weightCol="weight", standardization=True),
        "random_forest": RandomForestClassifier(weightCol="weight", numTrees=200, seed=42),
        "gradient_boosting": GBTClassifier(weightCol="weight", seed=42),
    }


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight: rows / (classes * rows of the class)."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    return rows.join(F.broadcast(sizes), label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("_t") / (F.col("_k") * F.col("_n"))).drop("_n", "_t", "_k")


def folds(rows: DataFrame, *, key: str = "id", label: str = "label", most: int = 5) -> tuple[DataFrame, int]:
    """Adds ``fold``, stratified; their number is that of the rarest label, between 2 and ``most``.

    Fold edges are found by counts, as in ``verify.split``, so no task holds a label's rows.
    """
    sizes = rows.groupBy(label).agg(F.count("*").alias("n"))
    k = max(2, min(most, sizes.agg(F.min("n")).first()[0] or 0))
    order, out = verify.hash_order(F.col(key)), rows
    fold = F.lit(0)
    for i in range(1, k):
        take = sizes.select(label, F.ceil(F.col("n") * i / k).cast("long").alias("take"))
        edge = verify.least_by_group(rows, label, order, take).withColumnRenamed("edge", f"_e{i}")
        out = out.join(F.broadcast(edge), label, "left")
        fold = fold + F.when(order > F.col(f"_e{i}"), 1).otherwise(0)
    return out.withColumn("fold", fold).drop(*(f"_e{i}" for i in range(1, k))), k


def score_column(scored: DataFrame) -> DataFrame:
    """Adds ``score`` for class 1: the probability, or the decision value where there is none."""
    if "probability" in scored.columns:
        return scored.withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("score", vector_to_array("rawPrediction")[1])


def out_of_fold(rows: DataFrame, model, *, stages: list | None = None) -> DataFrame:
    """(id, label, score) with each fold scored by a model that has not seen it. ``label`` is 0 or 1."""
    cut, k = folds(balanced(rows))
    parts = []
    for i in range(k):
        fitted = Pipeline(stages=[*(features() if stages is None else stages), model]).fit(cut.where(F.col("fold") != i))
        parts.append(score_column(fitted.transform(cut.where(F.col("fold") == i))).select("id", "label", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quantiles(by: DataFrame, value: str, number: str, parts: int) -> list[float]:
    """The ``parts`` + 1 evenly spaced quantiles of values that occur ``number`` times each, between neighbours by linear parts.

    Places are counted over ranges; only the at most 2 * (parts + 1) rows that hold one are read.
    """
    placed = running(by.select(F.col(value).alias("_v"), F.col(number).alias("_m")), ["_v"], {"_end": F.col("_m")})
    total = placed.agg(F.max("_end")).first()[0] or 0
    if not total:
        return []
    exact = [(total - 1) * i / parts for i in range(parts + 1)]
    wanted = sorted({int(x) + d for x in exact for d in (0, 1) if int(x) + d < total})
    held = placed.where(F.exists(F.array(*(F.lit(w) for w in wanted)), lambda w: (w < F.col("_end")) & (w >= F.col("_end") - F.col("_m")))).select("_v", "_m", "_end").collect()
    at = {w: r["_v"] for r in held for w in wanted if r["_end"] - r["_m"] <= w < r["_end"]}
    return [at[int(x)] + (at[min(int(x) + 1, total - 1)] - at[int(x)]) * (x - int(x)) for x in exact]


def tune_threshold(scored: DataFrame, *, least_recall: float | None = None) -> DataFrame:
    """One row (threshold, macro_f1): the best macro-F1 of ``score >= threshold``, the lowest on ties.

    Candidates are the distinct scores, or 101 quantiles if there are more than 100. Rows
    are counted by the candidates that they reach, so what is ordered is at most 102 rows.
    """
    spark = scored.sparkSession
    by = written(scored.groupBy("score").agg(F.sum("label").alias("p"), F.count("*").alias("n")).where("score is not null"), "scores")
    few = by.select("score").limit(101).collect()
    cand = sorted({r.score for r in few} if len(few) <= 100 else set(quantiles(by, "score", "n", 100)))
    if not cand:
        return spark.createDataFrame([], "threshold double, macro_f1 double")
    reached = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cand)), lambda c: c <= F.col("score")))
    found = {r.k: (r.p, r.n) for r in by.groupBy(reached.alias("k")).agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()}
    all_p, all_n = (sum(x[i] for x in found.values()) for i in (0, 1))
    f1 = lambda tp, pp, ap: 2 * tp / (pp + ap) if pp + ap else 0.0
    best, tp, pp = None, 0, 0
    for i in range(len(cand), 0, -1):
        p, n = found.get(i, (0, 0))
        tp, pp = tp + p, pp + n
        macro = (f1(tp, pp, all_p) + f1((all_n - all_p) - (pp - tp), all_n - pp, all_n - all_p)) / 2
        if (least_recall is None or (tp / all_p if all_p else 0.0) >= least_recall) and (best is None or macro >= best[1]):
            best = cand[i - 1], macro
    return spark.createDataFrame([best] if best else [], "threshold double, macro_f1 double")


def importance(names: list[str], model) -> list[tuple[str, float]]:
    """(feature, value) by absolute value."""
    values = model.coefficients if hasattr(model, "coefficients") else model.featureImportances
    return sorted(zip(names, (float(v) for v in values.toArray()), strict=True), key=lambda x: -abs(x[1]))


def save(artifact: dict, path: str) -> None:
    """An artifact of ``train`` or ``train_meta`` below ``path``: its pipeline with all tables, its scores, and the rest as JSON."""
    spark = SparkSession.active()
    artifact["pipeline"].write().overwrite().save(f"{path}/pipeline")
    artifact["scores"].write.mode("overwrite").parquet(f"{path}/scores")
    told = json.dumps({k: v for k, v in artifact.items() if k not in ("pipeline", "scores")})
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/artifact")


def load(path: str) -> dict:
    """What ``save`` has written, in any later session."""
    spark = SparkSession.active()
    told = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/artifact").collect()))
    if "importance" in told:
        told["importance"] = [tuple(x) for x in told["importance"]]
    return told | {"pipeline": PipelineModel.load(f"{path}/pipeline"), "scores": spark.read.parquet(f"{path}/scores")}


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    """(id, actual, predicted) of scores against a threshold."""
    name = lambda c: F.when(c, L.LABELS[1]).otherwise(L.LABELS[0])
    return scored.select("id", name(F.col("label") == 1).alias("actual"), name(F.col("score") >= threshold).alias("predicted"))


def compare(rows: DataFrame, models: dict, *, stages: list | None = None, least_recall: float = 0.3) -> tuple[list[dict], str, DataFrame]:
    """(a report for each model, the name of the best, its out-of-fold scores).

    rows: id, label (0 or 1) and what the stages read. A report has the metrics at the tuned
    threshold, and that with a floor on recall. The best has the highest macro-F1, the first on ties.
    """
    reports, best, kept = [], "", None
    for name, model in models.items():
        scored = written(out_of_fold(rows, model, stages=stages), "scores")
        threshold = tune_threshold(scored).first()
        floor = tune_threshold(scored, least_recall=least_recall).first()
        found = verify.metrics(_judged(scored, threshold.threshold)).first().asDict()
        reports.append({"model": name, "threshold": threshold.threshold, "floor_threshold": floor and floor.threshold, "floor_macro_f1": floor and floor.macro_f1, **found})
        if kept is None or found["macro_f1"] > next(r for r in reports if r["model"] == best)["macro_f1"]:
            best, kept = name, scored
    return reports, best, kept


def train(rows: DataFrame, models: dict | None = None, *, stages: list | None = None) -> dict:
    """The best model by out-of-fold macro-F1, fitted on all rows: name, threshold, pipeline, reports, scores."""
    models = text_models() if models is None else models
    reports, best, scores = compare(rows, models, stages=stages)
    fitted = Pipeline(stages=[*(features() if stages is None else stages), models[best]]).fit(balanced(rows))
    return {"name": best, "threshold": next(r["threshold"] for r in reports if r["model"] == best), "pipeline": fitted, "reports": reports, "scores": scores}


def predict(artifact: dict, rows: DataFrame) -> DataFrame:
    """(id, score, label) of an artifact of ``train``."""
    scored = score_column(artifact["pipeline"].transform(rows))
    return scored.select("id", "score", F.when(F.col("score") >= artifact["threshold"], L.LABELS[1]).otherwise(L.LABELS[0]).alias("label"))


#: Features of the meta-classifier besides the constraint features.
META = ("supervised_score_contradict", "anchor_num_secondary", "anchor_num_dates", "anchor_num_locations", "anchor_num_roles", "anchor_num_objects", "constraint_hard_hits", "constraint_soft_hits", "constraint_risk_score", "target_character_hit", "event_hit", "top_contradiction_family_score", "any_contradicted", "any_supported", "num_insufficient", "verifier_failed")


def meta_features(examples: DataFrame, constraints: DataFrame, profiles: DataFrame, rules: DataFrame, *, scores: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """(id, 16 + 18 doubles): text score, anchors, rules, profile hits, verdicts and the constraint features; 0 where there is none.

    constraints: ``timeline.constraint_features``; rules: ``timeline.rule_scores``; scores:
    (id, score); traces: ``traces.trace_features``.
    """
    text = F.concat_ws(" ", "book_name", "character", "caption", "content")
    own = examples.select("id", F.col("character").alias("_who"), A.extract(text, F.col("character")).alias("a"))
    n = lambda k: F.size(f"a.{k}").cast("double")
    x = own.join(scores.select("id", F.col("score").alias("supervised_score_contradict")), "id", "left")
    x = x.join(rules.select("id", F.col("hard_constraint_hits").cast("double").alias("constraint_hard_hits"), F.col("soft_constraint_hits").cast("double").alias("constraint_soft_hits"), "constraint_risk_score"), "id", "left")
    x = x.join(profiles.select(F.col("character").alias("_who"), "mention_count", "important_event_types"), "_who", "left")
    x = x.join(constraints, "id", "left")
    if traces is not None:
        x = x.join(traces.withColumnRenamed("example_id", "id"), "id", "left")
    else:
        x = x.withColumns({c: F.lit(0.0) for c in META[-4:]})
    hit = F.arrays_overlap("a.event_types", "important_event_types")
    x = x.withColumns({
        "anchor_num_secondary": n("secondary_characters"), "anchor_num_dates": n("dates"), "anchor_num_locations": n("locations"), "anchor_num_roles": n("roles"), "anchor_num_objects": n("named_objects"),
        "target_character_hit": (F.coalesce("mention_count", F.lit(0)) > 0).cast("double"), "event_hit": F.coalesce(hit, F.lit(False)).cast("double"),
        "top_contradiction_family_score": F.col("contradiction_query_max_score"),
    })
    names = [*META, *timeline.CONSTRAINTS]
    return x.select("id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names))


def meta_stages() -> list:
    """Stages from the named doubles to scaled ``features``."""
    return [VectorAssembler(inputCols=[*META, *timeline.CONSTRAINTS], outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]


def train_meta(rows: DataFrame, text: dict, models: dict | None = None) -> dict:
    """The best meta model, and ``system``: ``meta`` only if its macro-F1 is strictly better than that of the text model, else ``supervised``."""
    made = train(rows, meta_models() if models is None else models, stages=meta_stages())
    f1 = lambda x: next(r["macro_f1"] for r in x["reports"] if r["model"] == x["name"])
    return made | {"system": "meta" if f1(made) > f1(text) else "supervised", "importance": importance([*META, *timeline.CONSTRAINTS], made["pipeline"].stages[-1])}


__all__ = ["META", "TermWeights", "balanced", "compare", "features", "folds", "frame", "importance", "load", "meta_features", "meta_models", "meta_stages", "out_of_fold", "predict", "quantiles", "read_bucketed", "save", "score_column", "text_models", "train", "train_meta", "tune_threshold", "write_bucketed"]
