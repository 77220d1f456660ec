"""Class-balanced forests per lead, with the decision threshold locked on the validation part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.contracts import guard_features
from tempora.functions.values import all_known
from tempora.operators import evaluate as E
from tempora.operators.quality import union
from tempora.operators.splits import with_split
from tempora.session import stage

KEY = ["station_id", "timestamp_utc"]

# Forest size and seed.
TREES = 200
SEED = 42
#: Trees grow until their leaves are pure; this is the deepest that Spark ML allows.
DEPTH = 30
#: Hash buckets that row numbers are counted in, and rounds of the keyed permutation.
BUCKETS = 4096
ROUNDS = 48


def complete_cases(table: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Keys, targets and features of rows with every feature known, split by unique hours and staged for all fits."""
    guard_features(table, features)
    rows = table.filter(all_known([F.col(c) for c in features])).select(*KEY, *targets, *features)
    return stage(with_split(rows), "experiment")


def labelled(table: DataFrame, target: str) -> DataFrame:
    return table.filter(F.col(target).isNotNull()).withColumn("y", F.col(target).cast("int"))


def balanced(train: DataFrame) -> DataFrame:
    """Weight n / (2 n_class), so that both classes weigh the same."""
    sizes = train.agg(F.struct(F.count("*").alias("n"), F.sum("y").alias("pos"))).scalar()
    size = F.when(F.col("y") == 1, sizes["pos"]).otherwise(sizes["n"] - sizes["pos"])
    return train.withColumn("weight", sizes["n"] / (size * 2.0))


def estimator(trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="features", labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, impurity="gini",
        featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=False,
    )


def forest(features: Sequence[str], **options) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return Pipeline(stages=[assembler, estimator(**options)])


def fit(train: DataFrame, features: Sequence[str], **options) -> PipelineModel:
    weighted = balanced(train).select(*features, F.col("y").cast("double").alias("y"), "weight")
    return forest(features, **options).fit(weighted)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with the probability ``p`` of the event."""
    out = model.transform(rows)
    return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def score_leads(models: dict[int, PipelineModel], requests: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fail-closed scores of all leads: only COMPLETE rows reach the models, the rest keep unknown probabilities."""
    complete = F.col("data_status") == "COMPLETE"
    out = requests.filter(complete)
    for lead, model in models.items():
        out = score(model, out).withColumnRenamed("p", f"p_{lead}h")
    unknown = [F.lit(None).cast("double").alias(f"p_{lead}h") for lead in models]
    return out.unionByName(requests.filter(~complete).select("*", *unknown)).drop(*features)


def lock_threshold(validation: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Threshold per key from validation scores alone."""
    return E.choose_threshold(E.sweep(E.score_groups(validation, keys), keys), keys).select(*keys, F.col("threshold").alias("limit"))


def judge(scores: DataFrame, keys: Sequence[str], scope: str | None = None) -> DataFrame:
    """Lock the threshold on validation, then measure it once per split; optionally also per station."""
    locked = lock_threshold(scores.filter(F.col("split") == "validation"), keys)
    rows = scores.join(locked, list(keys))
    by = [*keys, "split", "limit"]
    return E.metrics(rows, by, scope, F.col("limit"))


def vectors(table: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Complete cases with all features as one array ``x``, split by unique hours and staged once for all fits."""
    guard_features(table, features)
    rows = table.filter(all_known([F.col(c) for c in features]))
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("x")
    return stage(with_split(rows.select(*KEY, *targets, x)), "experiment")


def sliced(features: Sequence[str], wanted: Sequence[str]) -> Column:
    """The wanted features of the array ``x`` as a vector."""
    places = {name: i for i, name in enumerate(features)}
    return array_to_vector(F.array(*[F.get("x", F.lit(places[name])) for name in wanted])).alias("features")


def fit_and_score(
    rows: DataFrame, features: Sequence[str], wanted: Sequence[str], target: str, name: Column, **options
) -> DataFrame:
    """Train on the train part of ``vectors`` rows and score every part; ``name`` marks the experiment.

    Without a complete train row there is no model and no score.
    """
    known = labelled(rows, target).select(*KEY, "split", "y", sliced(features, wanted))
    train = balanced(known.filter(F.col("split") == "train")).select("features", F.col("y").cast("double").alias("y"), "weight")
    empty = train.isEmpty()
    scored = known.limit(0).withColumn("probability", F.col("features")) if empty else estimator(**options).fit(train).transform(known)
    return scored.select(name.alias("experiment"), F.lit(target).alias("lead"), "split", *KEY, vector_to_array("probability")[1].alias("p"), "y")


def compare_feature_sets(table: DataFrame, sets: dict[str, Sequence[str]], targets: Sequence[str], **options) -> DataFrame:
    """The same rows and splits for every feature set and lead, so that the metrics differ by the features alone."""
    everything = list(dict.fromkeys(f for names in sets.values() for f in names))
    rows = vectors(table, everything, targets)
    parts = [fit_and_score(rows, everything, names, t, F.lit(n), **options) for n, names in sets.items() for t in targets]
    return judge(stage(union(parts), "scores"), ["experiment", "lead"])


def leave_one_out(df: DataFrame, held_out: str) -> DataFrame:
    """Train and validation rows of the other stations, test rows of the held-out station."""
    held = F.col("station_id") == held_out
    return df.filter(F.when(F.col("split") == "test", held).otherwise(~held))


def leave_one_station_out(
    table: DataFrame, features: Sequence[str], targets: Sequence[str], stations: Sequence[str] | None = None, **options
) -> DataFrame:
    """One fit per held-out station and lead; the threshold comes from the other stations.

    Without ``stations`` every station of the rows is held out once: one forest each, so they are few by design.
    """
    rows = vectors(table, features, targets)
    if stations is None:
        stations = [r[0] for r in rows.select("station_id").distinct().orderBy("station_id").collect()]
    parts = [fit_and_score(leave_one_out(rows, s), features, features, t, F.lit(s), **options) for s in stations for t in targets]
    return judge(stage(union(parts), "held_out_scores"), ["experiment", "lead"])


def impurity_importance(model: RandomForestClassificationModel, features: Sequence[str]) -> DataFrame:
    """Feature importances of the fitted forest, as a small table."""
    values = model.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def numbered(rows: DataFrame, keys: Sequence[str] = tuple(KEY), buckets: int = BUCKETS) -> DataFrame:
    """Gapless ``place`` from 0, by hash bucket and key: the same on any cluster size.

    Only the bucket sizes, ``buckets`` rows at most, are summed in one place.
    """
    placed = rows.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sizes = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*keys)) - 1
    return placed.withColumn("_in", inside).join(starts, "_b").withColumn("place", F.col("_start") + F.col("_in")).drop("_b", "_in", "_start")


def partner(place: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0..n-1: each round pairs x with k - x mod n and swaps the pair or leaves it by one bit.

    Both of a pair see the same bit, so every round, and with it the whole, is one-to-one for any n, without a sort.
    """

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        bit = F.xxhash64(key, r, F.greatest(x, other)).bitwiseAND(F.lit(1).cast("long"))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), place.cast("long"), turn)


def permuted(rows: DataFrame, n: int, repeats: int, seed: int = SEED) -> DataFrame:
    """``rows(place, y, x)`` once per feature of the array ``x`` and repeat, with that feature's values permuted.

    A row sends each of its values to the place that the permutation of (feature, repeat) names; only (place, feature,
    repeat, value) is shuffled, and the arrays meet the values at their own place.
    """
    values = rows.select(F.col("place").alias("source"), F.explode(F.transform("x", lambda v, i: F.struct(i.alias("at"), v.alias("value")))).alias("v"))
    values = values.select("source", "v.*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    key = F.xxhash64(F.lit(seed), "at", "repeat")
    sent = values.select("at", "repeat", "value", partner(F.col("source"), F.lit(n).cast("long"), key).alias("place"))
    changed = F.transform("x", lambda v, i: F.when(i == F.col("at"), F.col("value")).otherwise(v))
    return rows.join(sent, "place").select("place", "at", "repeat", "y", changed.alias("x"))


def permutation_importance(
    model: RandomForestClassificationModel, validation: DataFrame, features: Sequence[str], repeats: int = 5, seed: int = SEED
) -> DataFrame:
    """Mean and spread of the loss in average precision when one feature of ``validation(.., y, x)`` is permuted."""
    base = stage(numbered(validation.select(*KEY, "y", "x")).select("place", "y", "x"), "numbered")
    n = base.count()
    whole = base.select("place", F.lit(-1).alias("at"), F.lit(-1).alias("repeat"), "y", "x")
    every = whole if n == 0 else whole.union(permuted(base, n, repeats, seed))
    scored = model.transform(every.withColumn("features", array_to_vector("x")))
    scores = stage(scored.select("at", "repeat", vector_to_array("probability")[1].alias("p"), "y"), "permuted")
    keys = ["at", "repeat"]
    skill = stage(E.ranking(E.score_groups(scores, keys), keys), "permuted_skill")
    best = skill.filter(F.col("at") == -1).select("pr_auc").scalar()
    loss = skill.filter(F.col("at") >= 0).withColumn("loss", best - F.col("pr_auc"))
    name = F.get(F.array(*[F.lit(f) for f in features]), F.col("at")).alias("feature")
    return loss.groupBy(name).agg(F.avg("loss").alias("importance_mean"), F.stddev_pop("loss").alias("importance_std"))


def round_trip(model: PipelineModel, path: str) -> PipelineModel:
    model.write().overwrite().save(path)
    return PipelineModel.load(path)
