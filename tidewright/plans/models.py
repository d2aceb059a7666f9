"""Feature spaces, clusterings and regressors on pyspark.ml; results are tables of rows, without SQL counterparts unless SQL can follow."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, CountVectorizerModel, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.plans.audit import SQL_TOKENS, TARGET, skill_tokens
from tidewright.plans.base import held, once, over_postings, over_tables, r4, side_by_side
from tidewright.plans.evaluation import N_OUTER, labelled, metrics, outer_folds, rand_index
from tidewright.plans.evaluation import select_family as simplest_of_best

#: The allowed features by type; the tokens of required_skills are the column "skills" here.
NOMINAL = ["job_title", "job_category", "education_required", "city", "country", "remote_work", "company_size", "industry"]
NUMERIC = ["years_of_experience", "demand_score", "benefits_score_10", "skill_count"]
#: Families of features. Names, members and order are fixed values of the contract.
FAMILIES = {
    "job_domain": ["job_title", "job_category"],
    "experience_education": ["years_of_experience", "education_required"],
    "geography": ["city", "country"],
    "company_work": ["remote_work", "company_size", "industry"],
    "demand_benefits": ["demand_score", "benefits_score_10"],
    "skills": ["skills", "skill_count"],
}
#: Distinct values of a column, or tokens, that an encoder takes; more are an error, as its vocabulary is held by the driver and every task.
MOST_VALUES = 100_000


def prepared(p: DataFrame) -> DataFrame:
    """Records with the token array and its size; missing numbers are zero lines' worth."""
    tokens = F.coalesce(skill_tokens(F.col("required_skills")), F.array().cast("array<string>"))
    out = p.withColumn("skills", tokens).withColumn("skill_count", F.size("skills").cast("double"))
    return out.na.fill(0.0, ["demand_score", "benefits_score_10"])


class Features:
    """An encoder fitted on training records: one-hot by sorted values, multi-hot tokens, numbers scaled by the population deviation.

    Values not seen in training, and nulls, are all zeros. The vocabularies are lists of distinct values of
    the contract's columns, read once to the driver as every fitted encoder's are.
    """

    def __init__(self, train: DataFrame, nominal=tuple(NOMINAL), numeric=tuple(NUMERIC), skills: bool = True):
        self.nominal, self.numeric, self.skills = list(nominal), list(numeric), skills
        told = [F.approx_count_distinct(c).alias(c) for c in self.nominal] + [x for c in self.numeric for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))]
        told = train.agg(*told).first().asDict() if told else {}
        self.moments = {n: v for n, v in told.items() if n not in self.nominal}
        words = train.select(F.explode("skills").alias("w")).distinct().limit(MOST_VALUES + 1).collect() if skills else []
        sizes = {c: told[c] for c in self.nominal} | {"skills": len(words)}
        if large := [c for c, n in sizes.items() if n > MOST_VALUES]:
            raise ValueError(f"too many values for an encoder: {', '.join(large)}")
        stages = []
        if self.nominal:
            stages += [StringIndexer(inputCols=self.nominal, outputCols=[f"{c}_i" for c in self.nominal], stringOrderType="alphabetAsc", handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i" for c in self.nominal], outputCols=[f"{c}_v" for c in self.nominal], dropLast=True)]
        self.model = Pipeline(stages=stages).fit(train)
        if skills:
            known = sorted(r[0] for r in words)  # by code points, as Spark orders texts
            self.tokens = CountVectorizerModel.from_vocabulary(known or ["-"], inputCol="skills", outputCol="skills_v").setBinary(True)

    def stages(self) -> list:
        """The encoder as stages of pyspark.ml, which a PipelineModel can save."""
        number = lambda v: f"double('{float('nan') if v is None else v!r}')"
        scaled = ", ".join(f"(`{c}` - {number(self.moments[f'{c}_m'])}) / {number(self.moments[f'{c}_s'] or 1.0)} AS `{c}_n`" for c in self.numeric)
        columns = [f"{c}_v" for c in self.nominal] + [f"{c}_n" for c in self.numeric] + ["skills_v"] * self.skills
        return [*self.model.stages, *([SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")] if self.numeric else []), *([self.tokens] if self.skills else []), VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")]

    def transform(self, df: DataFrame) -> DataFrame:
        return PipelineModel(self.stages()).transform(df)

    def family_scale(self) -> list[float]:
        """For each encoded column one over the root of its family's width."""
        family = {c: n for n, own in FAMILIES.items() for c in own}
        widths: dict[str, int] = {}
        for c, n in self.blocks():
            widths[family[c]] = widths.get(family[c], 0) + n
        return [widths[family[c]] ** -0.5 for c, n in self.blocks() for _ in range(n)]

    def blocks(self) -> list[tuple[str, int]]:
        """Width of each column's block, in order."""
        sizes = self.model.stages[1].categorySizes if self.nominal else []
        return [*((c, n - 1) for c, n in zip(self.nominal, sizes, strict=True)), *((c, 1) for c in self.numeric), *([("skills", len(self.tokens.vocabulary))] if self.skills else [])]

    def columns(self) -> list[tuple[str, str]]:
        """Original column and name of each encoded one, in order."""
        labels = dict(zip(self.nominal, self.model.stages[0].labelsArray, strict=True)) if self.nominal else {}
        if self.skills:
            labels["skills"] = self.tokens.vocabulary
        return [(c, f"{c}={labels[c][i]}" if c in labels else c) for c, n in self.blocks() for i in range(n)]


@over_postings("ml01_multi_hot", f", t AS MATERIALIZED (SELECT job_id, {SQL_TOKENS} AS a FROM p), w AS MATERIALIZED (SELECT count(DISTINCT u)::INTEGER AS width FROM (SELECT unnest(a) AS u FROM t)) SELECT job_id, width, coalesce(len(a), 0)::INTEGER AS n_on FROM t CROSS JOIN w")
def multi_hot(p):
    x = prepared(p)
    f = Features(x, nominal=(), numeric=(), skills=True)
    on = F.aggregate(vector_to_array("skills_v"), F.lit(0.0), lambda a, v: a + v)
    return f.tokens.transform(x).select("job_id", F.lit(len(f.tokens.vocabulary)).alias("width"), on.cast("int").alias("n_on"))


@over_postings("ml02_one_hot", ", c AS (SELECT count(DISTINCT country)::INTEGER AS width FROM p) SELECT country, (dense_rank() OVER (ORDER BY country) - 1)::INTEGER AS slot, width FROM (SELECT DISTINCT country FROM p) CROSS JOIN c")
def one_hot(p):
    """Which slot of its block each value takes."""
    f = Features(prepared(p), nominal=("country",), numeric=(), skills=False)
    v = vector_to_array("country_v")
    return f.transform(p.select("country").distinct()).select("country", (F.array_position(v, 1.0) - 1).cast("int").alias("slot"), F.size(v).alias("width"))


@over_postings("ml03_population_scaling", ", u AS (SELECT 'years_of_experience' AS feature, years_of_experience AS v FROM p UNION ALL SELECT 'demand_score', coalesce(demand_score, 0) FROM p UNION ALL SELECT 'benefits_score_10', coalesce(benefits_score_10, 0) FROM p), m AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM u GROUP BY 1) SELECT feature, round(any_value(m), 4) AS mean_before, round(any_value(s), 4) AS sd_before, round(abs(avg((v - m) / s)), 4) AS mean_after, round(stddev_pop((v - m) / s), 4) AS sd_after FROM u JOIN m USING (feature) GROUP BY 1")
def population_scaling(p):
    own = NUMERIC[:3]
    f = Features(prepared(p), nominal=(), numeric=own, skills=False)
    x = f.transform(prepared(p)).select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("v"), F.col(f"{c}_n").alias("n")) for c in own))))
    return x.groupBy("feature").agg(r4(F.avg("v")).alias("mean_before"), r4(F.stddev_pop("v")).alias("sd_before"), r4(F.abs(F.avg("n"))).alias("mean_after"), r4(F.stddev_pop("n")).alias("sd_after"))


def balancer(x: DataFrame, without: tuple[str, ...] = ()):
    """An encoder fitted on prepared records without some features, which divides each family's block by the root of its width; the widths; and the original column and name of each encoded one."""
    kept = [c for own in FAMILIES.values() for c in own if c not in without]
    f = Features(x, [c for c in kept if c in NOMINAL], [c for c in kept if c in NUMERIC], "skills" in kept)
    family = {c: n for n, own in FAMILIES.items() for c in own}
    widths: dict[str, int] = {}
    for c, n in f.blocks():
        widths[family[c]] = widths.get(family[c], 0) + n
    v = F.zip_with(vector_to_array("features"), F.array(*map(F.lit, f.family_scale())), lambda a, b: a * b)
    return (lambda df: f.transform(df).select("job_id", "job_category", TARGET, array_to_vector(v).alias("features"))), widths, f.columns()


def balanced(p: DataFrame, without: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, int]]:
    """job_id and features of the records that the encoder is fitted on; and the families' widths."""
    x = once(prepared(p).select(*READ))
    encode, widths, _ = balancer(x, without)
    return encode(x), widths


def balanced_names(p: DataFrame) -> tuple[DataFrame, dict[str, int], list[tuple[str, str]]]:
    """balanced(), and the original column and name of each encoded one."""
    x = once(prepared(p).select(*READ))
    encode, widths, names = balancer(x)
    return encode(x), widths, names


@over_postings("ml05_family_blocks")
def family_blocks(p):
    return p.sparkSession.createDataFrame(sorted(balanced(p)[1].items()), "family string, width int")


def centred(x: DataFrame, mean=None) -> DataFrame:
    """x with features less their mean (or one fitted elsewhere), which PCA.transform doesn't do."""
    if mean is None:
        mean = x.select(Summarizer.mean(F.col("features")).alias("m")).first().m
    v = F.zip_with(vector_to_array("features"), F.array(*(F.lit(float(e)) for e in mean)), lambda a, b: a - b)
    return x.withColumn("features", array_to_vector(v))


@over_postings("ml06_pca_variance")
def pca_variance(p, share: float = 0.85, most: int = 25):
    """Components up to a share of the variance, two at least."""
    model = PCA(k=most, inputCol="features", outputCol="z").fit(balanced(p)[0])
    rows, total = [], 0.0
    for i, v in enumerate(model.explainedVariance, 1):
        if i <= 2 or total < share:
            total += float(v)
            rows.append((i, round(float(v), 6), round(total, 6)))
    return p.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double")


@over_postings("ml06_top_loadings")
def top_loadings(p, components: int = 3, n: int = 10):
    """The largest loadings of the first components, with their sign."""
    pc = PCA(k=components, inputCol="features", outputCol="z").fit(balanced(p)[0]).pc.toArray()
    rows = [(c + 1, int(i), float(pc[i, c])) for c in range(components) for i in abs(pc[:, c]).argsort()[::-1][:n]]
    return p.sparkSession.createDataFrame(rows, "component int, feature int, loading double")


def components_for(explained, share: float = 0.85) -> int:
    """How many of the components whose shares of the variance are given reach the share in all; two at least, all if they don't."""
    total = 0.0
    for i, v in enumerate(explained, 1):
        total += float(v)
        if i >= 2 and total >= share:
            return i
    return len(explained)


def reduced(p: DataFrame, share: float = 0.85, most: int = 25, without: tuple[str, ...] = ()) -> DataFrame:
    """Records in the space of the components that hold the share of the variance (2 to `most`, by the rule of ml06_pca_variance)."""
    x, widths = balanced(p, without)
    model = PCA(k=min(most, sum(widths.values())), inputCol="features", outputCol="z").fit(x)
    z = F.slice(vector_to_array("z"), 1, components_for(model.explainedVariance, share))
    return model.transform(centred(x)).select("job_id", "job_category", TARGET, array_to_vector(z).alias("z"))


def greedy_columns(corr: np.ndarray, var: np.ndarray, names: list[str], limit: float = 0.9) -> tuple[list[int], dict[int, tuple[int, float]]]:
    """Columns kept, by falling variance (equal ones by name) unless a kept one's correlation reaches the limit; and for each dropped one the nearest kept one with it.

    Columns without variance are left out; two are kept at least where there are two.
    """
    usable = [i for i in range(len(var)) if np.isfinite(var[i]) and var[i] > 1e-12]
    order = sorted(usable, key=lambda i: (-var[i], names[i]))
    kept: list[int] = []
    dropped: dict[int, tuple[int, float]] = {}
    for i in order:
        near = max(kept, key=lambda j: abs(corr[i, j]), default=None)
        if near is not None and abs(corr[i, near]) >= limit:
            dropped[i] = near, float(corr[i, near])
        else:
            kept.append(i)
    for i in order:
        if len(kept) < 2 and i not in kept:
            kept.append(i)
            dropped.pop(i, None)
    return sorted(kept), dropped


def encoded_correlations(x: DataFrame, names: list[str], limit: float = 0.9) -> tuple[list[int], dict[int, tuple[int, float]], np.ndarray]:
    """greedy_columns() of the encoded columns of x, and their variances. The matrix has a row a column, whatever the records."""
    m = np.nan_to_num(Correlation.corr(x.select("features"), "features").first()[0].toArray())
    var = np.asarray(x.select(Summarizer.variance(F.col("features")).alias("v")).first().v.toArray())
    return *greedy_columns(m, var, names, limit), var


@over_postings("ml09_correlation_filter")
def correlation_filter(p, limit: float = 0.9):
    """Each encoded column of the balanced features: its family, variance, whether the greedy choice keeps it, and if not which kept one it repeats and how closely."""
    x, _, named = balanced_names(p)
    kept, dropped, var = encoded_correlations(x, [n for _, n in named], limit)
    family = {c: n for n, own in FAMILIES.items() for c in own}
    rows = [(i, n, family[c], float(var[i]), i in set(kept), named[dropped[i][0]][1] if i in dropped else None, dropped[i][1] if i in dropped else None) for i, (c, n) in enumerate(named)]
    return p.sparkSession.createDataFrame(rows, "feature int, name string, family string, variance double, selected boolean, repeats string, correlation double")


@over_postings("ml09_redundant_pairs")
def redundant_pairs(p, limit: float = 0.9):
    """Pairs of encoded columns whose correlation reaches the limit."""
    x, _, named = balanced_names(p)
    m = np.nan_to_num(Correlation.corr(x.select("features"), "features").first()[0].toArray())
    rows = [(named[i][1], named[j][1], float(m[i, j])) for i, j in zip(*np.nonzero(np.triu(np.abs(m) >= limit, 1)), strict=True)]
    return p.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, correlation double")


def correlation_choice(p: DataFrame, limit: float = 0.9) -> DataFrame:
    """job_id and z: the balanced columns that the greedy choice keeps, as they are."""
    x, _, named = balanced_names(p)
    kept, _, _ = encoded_correlations(x, [n for _, n in named], limit)
    v = vector_to_array("features")
    return x.select("job_id", F.transform(F.array(*map(F.lit, kept)), lambda i: F.get(v, i)).alias("z"))


@over_tables("ml12_kmeans_embeddings")
def kmeans_embeddings(spark, sf_dir):
    """K-means over embeddings against their labels."""
    x = labelled(spark, sf_dir).select(F.col("label").alias("a"), array_to_vector("x").alias("z"))
    return rand_index(KMeans(k=10, seed=42, featuresCol="z", predictionCol="b").fit(x).transform(x).select("a", "b"))


def ladder(y_sd: float, n: int) -> dict[str, object]:
    """The regressors: ridge's penalty is alpha 10 on the target's own scale; boosting here has squared loss; ensembles.HuberBoosting has the Huber one."""
    own = {"featuresCol": "features", "labelCol": TARGET, "predictionCol": "predicted"}
    return {
        "Linear Regression": LinearRegression(**own, solver="normal", regParam=1e-6),
        "Ridge": LinearRegression(**own, solver="normal", standardization=False, regParam=10.0 * y_sd / n),
        "Random Forest": RandomForestRegressor(**own, numTrees=24, maxDepth=8, featureSubsetStrategy="0.8", minInstancesPerNode=2, seed=42),
        "Gradient Boosting": GBTRegressor(**own, maxIter=12, stepSize=0.2, maxDepth=3, seed=42),
    }


#: Rows of a task of a fit. A fit keeps each row as wide as all encoded columns, and a task's rows in one block.
TASK_ROWS = 100_000


def dealt(x: DataFrame) -> DataFrame:
    """x by job_id in tasks of about TASK_ROWS rows, where it has more of them a core: records are stored so compactly that a file's part would make a block of gigabytes in a fit."""
    rows = x.count()
    return x.repartition(-(-rows // TASK_ROWS), "job_id") if rows > TASK_ROWS * x.sparkSession.sparkContext.defaultParallelism else x


class Fold:
    """One fold's history and validation month, encoded once, for all the models and sets of features that are tried on it."""

    def __init__(self, x: DataFrame, fold: int, month: str, **features):
        """x: prepared records. Records of `month` are validated by those before it."""
        self.fold, self.month = fold, month
        train, self.records = x.filter(F.col("period") < month), x.filter(F.col("period") == month)
        self.features = Features(train, **features)
        self.train = self.features.transform(dealt(train)).select(TARGET, "features").persist()
        self.valid = self.features.transform(self.records).select("job_id", F.col(TARGET).alias("actual"), "features").persist()
        self.sd, self.rows, self.middle = self.train.agg(F.stddev_pop(TARGET), F.count("*"), F.percentile_approx(TARGET, 0.5, 1_000_000)).first()

    def of(self, columns: list[str] | None) -> tuple[DataFrame, DataFrame, int]:
        """History and validation month with the encoded columns of some features alone, and how many those are."""
        names = self.features.columns()
        if columns is None:
            return self.train, self.valid, len(names)
        slicer = VectorSlicer(inputCol="__all", outputCol="features", indices=[i for i, (c, _) in enumerate(names) if c in columns])
        return *(slicer.transform(d.withColumnRenamed("features", "__all")).drop("__all") for d in (self.train, self.valid)), len(slicer.getIndices())

    def scored(self, model: str, columns: list[str] | None = None) -> tuple:
        """A model's metrics on the month, the seconds of its fit and of its scoring, and the rows and encoded columns they had."""
        train, valid, width = self.of(columns)
        began = time.perf_counter()
        fitted = ladder(self.sd, self.rows)[model].fit(train) if model != DUMMY else None
        ended = time.perf_counter()
        predicted = fitted.transform(valid) if fitted else valid.withColumn("predicted", F.lit(self.middle).cast("double"))
        seen = Observation()
        values = tuple(predicted.select("actual", "predicted").observe(seen, F.count("*").alias("rows")).agg(*metrics()).first())
        return (model, self.fold, *values, ended - began, time.perf_counter() - ended, self.rows, seen.get["rows"], width)

    def errors(self, model: str) -> tuple:
        """model, fold, its mean absolute error on the history that it was fitted on, and its error and r2 on the month."""
        fitted = ladder(self.sd, self.rows)[model].fit(self.train) if model != DUMMY else None
        shown = lambda d: fitted.transform(d) if fitted else d.withColumn("predicted", F.lit(self.middle).cast("double"))
        own = shown(self.train).agg(F.avg(F.abs(F.col(TARGET) - F.col("predicted")))).first()[0]
        seen = shown(self.valid).agg(*metrics()).first()
        return model, self.fold, own, seen.mae, seen.r2

    def close(self) -> None:
        self.train.unpersist()
        self.valid.unpersist()


DUMMY = "Dummy Median"


#: The columns of prepared() records that folds read.
READ = ["job_id", "period", TARGET, *NOMINAL, *NUMERIC, "skills", "experience_level"]


def _months(x: DataFrame, folds: int) -> list[tuple[int, str]]:
    return [tuple(r) for r in outer_folds(x).orderBy(F.desc("fold")).limit(folds).collect()]  # a row a fold


def folds_of(p: DataFrame, folds: int = N_OUTER, **features) -> Iterator[Fold]:
    """The expanding folds (the last ones, if fewer are asked for), one after the other: every encoder and model sees its fold's history alone. The records are prepared once for all."""
    with held(prepared(p).select(*READ)) as x:
        for fold, month in _months(x, folds):
            own = Fold(x, fold, month, **features)
            yield own
            own.close()


def over_folds(p: DataFrame, work: Callable[[Fold], list], folds: int = N_OUTER, at_once: int = 2, **features) -> list:
    """What `work` lists of each of folds_of(), one list after the other; a few folds run at once, so that one's tasks fill the cores while another's driver waits."""

    def run(x: DataFrame, fold: int, month: str) -> list:
        own = Fold(x, fold, month, **features)
        try:
            return work(own)
        finally:
            own.close()

    with held(prepared(p).select(*READ)) as x:
        return [r for rows in side_by_side([lambda k=k: run(x, *k) for k in _months(x, folds)], at_once) for r in rows]


SCORES = "model string, fold int, n long, mae double, rmse double, medae double, r2 double, r2_reason string"
TIMES = "fit_s double, score_s double, train_rows long, scored_rows long, encoded_columns int"


def fold_scores(p: DataFrame, models: list[str], folds: int = N_OUTER, **features) -> DataFrame:
    """Metrics and times of each model and fold. A fold's models are fitted side by side over its one encoding; the driver holds a row a model."""
    rows = over_folds(p, lambda f: side_by_side([lambda m=m: f.scored(m) for m in models], 4), folds, **features)
    return p.sparkSession.createDataFrame(rows, f"{SCORES}, {TIMES}")


LADDER = [DUMMY, "Linear Regression", "Ridge", "Random Forest", "Gradient Boosting"]


@over_postings("ml17_model_ladder")
def model_ladder(p):
    return fold_scores(p, LADDER)


@over_postings("ml17_runtime_summary")
def runtime_summary(p, models=tuple(LADDER)):
    """Fit and scoring times of each model over the folds, by the summary of runtime samples, and rows a second. Models are fitted one after the other, so that they don't wait for each other."""
    rows = [f.scored(m) for f in folds_of(p) for m in models]
    x = p.sparkSession.createDataFrame(rows, f"{SCORES}, {TIMES}")
    phase = F.inline(F.array(F.struct(F.lit("fit").alias("phase"), F.col("fit_s").alias("s"), F.col("train_rows").alias("rows")), F.struct(F.lit("score").alias("phase"), F.col("score_s").alias("s"), F.col("scored_rows").alias("rows"))))
    q = lambda v: F.percentile("s", F.lit(v))
    return x.select("model", phase).groupBy("model", "phase").agg(F.count("*").alias("samples"), F.min("s").alias("min_s"), q(0.5).alias("p50_s"), q(0.9).alias("p90_s"), q(0.95).alias("p95_s"), F.max("s").alias("max_s"), F.avg("s").alias("mean_s"), F.stddev_pop("s").alias("sd_s"), (F.sum("rows") / F.sum("s")).alias("rows_per_s"), (1000 * F.sum("s") / F.sum("rows")).alias("ms_per_row"))


#: Options and experiments of the ablations. Names are fixed values of the contract.
OPTIONS = ("A — Conservative Core", "B — Simplifier", "C — Exclude job_category", "D — Exclude years_of_experience")
EXPERIMENTS = ("A0_CONSERVATIVE_CORE", "A1_PLUS_YEARS", "A2_EXPERIENCE_BUCKET", "A6_SKILLS")


def feature_sets() -> list[tuple[str, str, list[str]]]:
    """kind, name and features of each ablation: four options, four experiments that add to a core, and each family left out."""
    every = [c for own in FAMILIES.values() for c in own]
    without = lambda *own: [c for c in every if c not in own]
    core = without("years_of_experience", "skills", "skill_count")
    options = (every, ["job_category", "years_of_experience"], without("job_category"), without("years_of_experience"))
    experiments = (core, [*core, "years_of_experience"], [*core, "experience_level"], every)
    return [*(("option", n, own) for n, own in zip(OPTIONS, options, strict=True)), *(("experiment", n, own) for n, own in zip(EXPERIMENTS, experiments, strict=True)), *(("leave_one_out", n, without(*own)) for n, own in FAMILIES.items())]


@over_postings("ml18_ablations")
def ablations(p, models=("Ridge", "Random Forest"), at_once: int = 6):
    """The same models over each set of features, and how far each error is from the one with all of them, fold by fold.

    A fold is encoded once with every column that any set has; sets are slices of that, fitted side by side. A set that has two names is fitted once.
    """
    names: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for kind, name, own in feature_sets():
        names.setdefault(tuple(own), []).append((kind, name))
    tries = [(own, m) for own in names for m in models]

    def fold_rows(f: Fold) -> list[tuple]:
        made = side_by_side([lambda own=own, m=m: f.scored(m, list(own)) for own, m in tries], at_once)
        return [(kind, name, len(own), *r) for (own, _), r in zip(tries, made, strict=True) for kind, name in names[own]]

    rows = over_folds(p, fold_rows, nominal=(*NOMINAL, "experience_level"))
    out = p.sparkSession.createDataFrame(rows, f"kind string, name string, features int, {SCORES}, {TIMES}")
    whole = out.filter(F.col("name") == OPTIONS[0]).select("model", "fold", F.col("mae").alias("full_mae"))
    return out.join(F.broadcast(whole), ["model", "fold"]).withColumn("mae_delta_vs_full", F.col("mae") - F.col("full_mae")).drop("fit_s", "score_s")  # a row a model and fold


@over_postings("ml18_ablation_summary")
def ablation_summary(p, models=("Ridge",)):
    """Means over the folds of each set of features, and the gain over the core in per cent."""
    x = ablations(p, models).groupBy("kind", "name", "model", "features").agg(*(F.avg(c).alias(f"{c}_mean") for c in ("mae", "rmse", "medae", "r2")), F.stddev("mae").alias("mae_sd"), F.avg("mae_delta_vs_full").alias("mae_delta_vs_full_mean"))
    core = F.max(F.when(F.col("name") == EXPERIMENTS[0], F.col("mae_mean"))).over(W.partitionBy("model"))  # a row a set
    return x.withColumn("gain_on_core_pct", 100 * (core - F.col("mae_mean")) / core)


def fold_importance(p: DataFrame) -> list[tuple]:
    """(fold, level, family, feature, importance) of the forest on each fold's history: of encoded columns, rolled up to features and to families."""
    family = {c: n for n, own in FAMILIES.items() for c in own}

    def fold_rows(f: Fold) -> list[tuple]:
        imp = ladder(f.sd, f.rows)["Random Forest"].fit(f.train).featureImportances.toArray()
        sums: dict[tuple[str, str, str], float] = {("family", n, n): 0.0 for n in FAMILIES}
        for (c, name), v in zip(f.features.columns(), imp, strict=True):
            for level, own in (("encoded", name), ("raw", c), ("family", family[c])):
                key = (level, family[c], own)
                sums[key] = sums.get(key, 0.0) + float(v)
        return [(f.fold, *key, v) for key, v in sums.items()]

    return over_folds(p, fold_rows)


@over_postings("ml19_importance")
def importance(p):
    """Impurity importance in each fold's history: of encoded columns, and rolled up to the original ones and to families."""
    return p.sparkSession.createDataFrame(fold_importance(p), "fold int, level string, family string, feature string, importance double")


@over_postings("ml19_importance_drift")
def importance_drift(p):
    """Half the sum of the families' changes of normalised importance from each fold to the next."""
    x = importance(p).filter("level = 'family'")
    own = x.withColumn("share", F.coalesce(F.col("importance") / F.nullif(F.sum("importance").over(W.partitionBy("fold")), F.lit(0)), F.lit(0.0)))
    w = W.partitionBy("family").orderBy("fold")  # a row a fold and family
    moved = own.select("fold", F.lag("fold").over(w).alias("previous_fold"), F.abs(F.col("share") - F.lag("share").over(w)).alias("change"))
    return moved.filter("previous_fold is not null").groupBy("previous_fold", "fold").agg((F.sum("change") / 2).alias("half_l1_drift"))


#: The published grid, whose forests take hours on one machine; depths beyond Spark's 30 are 30.
PUBLISHED_GRID = {"trees": (50, 100, 150, 200, 250, 300), "depths": (10, 15, 20, 25, 30, None)}


#: Families from the simplest on. The order is a fixed value of the contract.
SIMPLEST = [DUMMY, "Linear Regression", "Ridge", "Gradient Boosting", "Random Forest"]


def family_choice(scores: DataFrame) -> DataFrame:
    """One row: the family of the least mean error over the folds, those whose spread (a deviation either way) meets its own, and the simplest of them, which is selected."""
    x = scores.groupBy("model").agg(F.avg("mae").alias("mae"), F.coalesce(F.stddev("mae"), F.lit(0.0)).alias("sd"))
    return simplest_of_best(x.withColumn("simplicity", F.array_position(F.array(*map(F.lit, SIMPLEST)), F.col("model"))))


def select_family(scores: DataFrame) -> str:
    return family_choice(scores).first().selected


@over_postings("ml22_ladder_selection")
def ladder_selection(p):
    """The family that the fitted ladder's errors select."""
    return family_choice(fold_scores(p, LADDER))


#: The gap between validation and history, over the dummy's error, from which a fit looks too close. Fixed value of the contract.
GAP = 0.2


def diagnosed(scores: DataFrame, gap: float = GAP, most: int = 4) -> DataFrame:
    """Gains over the dummy on history and validation of each model and fold (model, fold, train_mae, mae, r2), the gap between the two, what that indicates, and what at least `most` folds do.

    Overfitting: a gain on history with a gap over the bound. Underfitting: no gain on either. Good: a gain on validation, r2 of 0 or more, a gap within it.
    """
    dummy = scores.filter(F.col("model") == DUMMY).select(F.col("fold").alias("__fold"), F.col("train_mae").alias("__t"), F.col("mae").alias("__v"))
    x = scores.join(F.broadcast(dummy), F.col("fold") == F.col("__fold"))  # a row a fold
    x = x.withColumns({"train_gain": 1 - F.col("train_mae") / F.nullif("__t", F.lit(0.0)), "validation_gain": 1 - F.col("mae") / F.nullif("__v", F.lit(0.0)), "gap": (F.col("mae") - F.col("train_mae")) / F.nullif("__v", F.lit(0.0))})
    known = F.col("train_gain").isNotNull() & F.col("validation_gain").isNotNull() & F.col("gap").isNotNull()
    says = (
        F.when(F.col("model") == DUMMY, "baseline")
        .when(~known, "inconclusive")
        .when((F.col("train_gain") > 0) & (F.col("gap") > gap), "overfitting_indication")
        .when((F.col("train_gain") <= 0) & (F.col("validation_gain") <= 0), "underfitting_indication")
        .when((F.col("validation_gain") > 0) & (F.col("r2") >= 0) & (F.col("gap") <= gap), "good_fit_indication")
        .otherwise("inconclusive")
    )
    x = x.withColumn("fold_indication", says)
    own = W.partitionBy("model", "fold_indication")
    x = x.withColumn("__n", F.count("*").over(own))
    whole = W.partitionBy("model")
    agreed = F.when(F.col("model") == DUMMY, "baseline").otherwise(F.coalesce(F.max(F.when(F.col("__n") >= most, F.col("fold_indication"))).over(whole), F.lit("mixed_or_inconclusive")))
    baseline = F.col("model") == DUMMY
    return x.select("model", "fold", *(F.when(~baseline, F.col(c)).alias(c) for c in ("train_gain", "validation_gain", "gap")), "fold_indication", agreed.alias("aggregate_indication"))


@over_postings("ml25_ladder_diagnostics")
def ladder_diagnostics(p, models=tuple(LADDER)):
    """diagnosed() of the fitted ladder."""
    rows = over_folds(p, lambda f: side_by_side([lambda m=m: f.errors(m) for m in models], 4))
    return diagnosed(p.sparkSession.createDataFrame(rows, "model string, fold int, train_mae double, mae double, r2 double"))


@over_postings("ml21_tuning")
def tuning(p, trees=(4, 8, 12, 16, 20, 24), depths=(4, 6, 8, 10, 12, 14), inner: int = 3, selected: str | None = None):
    """A grid of forests on the inner folds of the training part, ranked by mean absolute error; one row that says so where the ladder selects another family.

    The folds and the grid are one schedule of fits side by side over folds encoded once. A depth's forests grow by the step between numbers of trees: the
    forest of t trees is the first t of them, so the grid costs its largest forests alone.
    """
    spark, schema = p.sparkSession, "status string, reason string, trees int, depth int, fold_mae array<double>, mae_mean double, mae_sd double, r2_mean double, place int"
    family = selected or select_family(fold_scores(p, LADDER))
    if family != "Random Forest":
        return spark.createDataFrame([("skipped", f"selected family is {family}", *[None] * 7)], schema)
    step = math.gcd(*trees)
    parts = max(trees) // step
    cells: dict[tuple[int, int], list[tuple]] = {}
    for f in folds_of(p, inner):
        own = {"featuresCol": "features", "labelCol": TARGET, "numTrees": step, "minInstancesPerNode": 2, "featureSubsetStrategy": "0.8"}
        grow = [RandomForestRegressor(**own, predictionCol=f"p{i}", maxDepth=min(d or 30, 30), seed=42 + i) for d in depths for i in range(parts)]
        forests = side_by_side([lambda e=e, f=f: e.fit(f.train) for e in grow], 6)
        for k, d in enumerate(depths):
            shown = reduce(lambda x, m: m.transform(x), forests[k * parts : (k + 1) * parts], f.valid)
            mean = lambda t: sum(F.col(f"p{i}") for i in range(t // step)) / (t // step)
            gap = lambda t: F.col("actual") - mean(t)
            total = F.sum(F.col("actual") * F.col("actual")) - F.sum("actual") * F.avg("actual")
            row = shown.agg(*(x for t in trees for x in (F.avg(F.abs(gap(t))), F.when(total > 0, 1 - F.sum(gap(t) * gap(t)) / total)))).first()
            for n, t in enumerate(trees):
                cells.setdefault((t, d), []).append((row[2 * n], row[2 * n + 1]))
    rows = []
    for (t, d), own in cells.items():
        mae, r2 = [m for m, _ in own], [r for _, r in own if r is not None]
        rows.append(("completed", None, t, d, mae, float(np.mean(mae)), float(np.std(mae)), float(np.mean(r2)) if len(r2) == len(own) else None))
    ordered = sorted({r[5] for r in rows})
    return spark.createDataFrame([(*r, 1 + sum(x[5] < r[5] for x in rows) if ordered else None) for r in rows], schema)


def dealt_anew(valid: DataFrame, groups: list[tuple[str, str, list[str]]], repeats: int, part: int = 50_000) -> DataFrame:
    """valid for each group of columns (kind, name, columns) and repeat, with the group's values from another row.

    Rows are dealt by a seeded hash to parts of a month of about `part` rows; ordered by another hash inside each, they give their neighbours' values, the
    first row's go to the last one. All columns of a group come from one row; a repeat deals the same way for every group.
    """
    every = sorted({c for _, _, own in groups for c in own})
    sizes = valid.groupBy(F.col("period").alias("__month")).agg(F.greatest(F.lit(1), F.floor(F.count("*") / part)).alias("__parts"))
    x = valid.join(F.broadcast(sizes), F.col("period").eqNullSafe(F.col("__month"))).drop("__month")  # a row a month
    x = x.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    x = x.withColumn("__part", F.pmod(F.xxhash64("repeat", "job_id"), F.col("__parts")))
    w = W.partitionBy("period", "repeat", "__part").orderBy(F.xxhash64("job_id", F.col("repeat").cast("int")), "job_id")
    values = F.struct(*every)
    x = x.withColumn("__moved", F.coalesce(F.lead(values).over(w), F.first(values).over(w)))
    x = x.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("feature"), F.array(*map(F.lit, own)).alias("own")) for k, n, own in groups))).alias("__g"))
    moved = {c: F.when(F.array_contains("__g.own", c), F.col(f"__moved.{c}")).otherwise(F.col(c)) for c in every}
    return x.withColumns(moved).select("*", "__g.kind", "__g.feature").drop("__g", "__moved", "__part", "__parts")


#: The groups of columns that are dealt anew: each feature, and each family's together.
GROUPS = [("raw_feature", c, [c]) for own in FAMILIES.values() for c in own] + [("joint_family", n, own) for n, own in FAMILIES.items()]


def permuted(model, f: Features, valid: DataFrame, repeats: int) -> list[tuple]:
    """(kind, feature, repeat, error, error as it was) of a fitted model on records whose groups of columns are dealt anew: a row a group and repeat."""
    error = F.avg(F.abs(F.col(TARGET) - F.col("predicted")))
    base = model.transform(f.transform(valid)).agg(error.alias("base")).first().base
    scored = model.transform(f.transform(dealt_anew(valid, GROUPS, repeats))).groupBy("kind", "feature", "repeat").agg(error.alias("mae"))
    return [(*r, base) for r in scored.collect()]


def increases(made: DataFrame, *by: str) -> DataFrame:
    return made.groupBy(*by, "kind", "feature").agg(F.count("*").alias("repeats"), F.avg(F.col("mae") - F.col("base")).alias("mean_increase"), F.stddev_pop("mae").alias("sd"))


@over_postings("ml24_permutation")
def permutation(p, repeats: int = 12):
    """Rise of the error in each fold when the values of a column, or of a whole family's columns together, are dealt anew."""


    def fold_rows(f: Fold) -> list[tuple]:
        model = ladder(f.sd, f.rows)["Ridge"].fit(f.train)
        return [(f.fold, *r) for r in permuted(model, f.features, f.records, repeats)]

    out = over_folds(p, fold_rows)
    return increases(p.sparkSession.createDataFrame(out, "fold int, kind string, feature string, repeat int, mae double, base double"), "fold")


@over_postings("ml26_variants")
def variants(p):
    """All features against the two strongest, on the same folds, from one encoding of each."""

    def fold_rows(f: Fold) -> list[tuple]:
        made = side_by_side([lambda own=own: f.scored("Random Forest", own) for own in (None, TOP2)])
        return [(v, *r[1:]) for v, r in zip(("full", "top2"), made, strict=True)]

    rows = over_folds(p, fold_rows)
    return p.sparkSession.createDataFrame(rows, f"variant string, {SCORES.partition(', ')[2]}, {TIMES}").drop("fit_s", "score_s")


#: The two strongest features.
TOP2 = ["job_category", "years_of_experience"]


def final_fit(p: DataFrame) -> tuple:
    """The forest fitted on all months but the latest, its encoder, and the latest month's records."""
    x = once(prepared(p).select(*READ))
    last = x.agg(F.max("period")).first()[0]
    f = Fold(x, 0, last)
    model = ladder(f.sd, f.rows)["Random Forest"].fit(f.train)
    f.close()
    return model, f.features, x.filter(F.col("period") == last)


@over_postings("ml23_locked_test")
def locked_test(p):
    """One final fit, scored once on the latest period, with its error band."""
    model, f, test = final_fit(p)
    out = model.transform(f.transform(test)).select(F.col(TARGET).alias("actual"), "predicted")
    return out.agg(*metrics(), F.percentile(F.abs(F.col("actual") - F.col("predicted")), F.lit(0.9)).alias("q90"))


@over_postings("ml23_locked_permutation")
def locked_permutation(p, repeats: int = 12):
    """Permutation importance of the final model on the latest period, which it never saw."""
    return increases(p.sparkSession.createDataFrame(permuted(*final_fit(p), repeats), "kind string, feature string, repeat int, mae double, base double"))
