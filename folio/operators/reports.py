"""Filters, joins, aggregates and orders over the tables of texts, sessions, results, tasks and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text as t

# ---- predicates and columns; the patterns, bounds and sizes in them are fixed values


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows that equal every value given; a value of None is no condition."""
    conditions = [F.col(k) == v for k, v in values.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def lookup(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key columns are in the key table."""
    return df.join(keys.distinct(), keys.columns, "left_semi")


def title_contains(c: Column, part: str) -> Column:
    return F.contains(F.lower(c), F.lower(F.lit(part)))


def size_class(length: Column) -> Column:
    return F.when(length < 1000, "small").when(length <= 10_000, "medium").when(length > 10_000, "large")


def checks(rules: dict[str, Column]) -> Column:
    """(valid, errors): names of the rules that don't hold; a null outcome doesn't."""
    errors = F.array_compact(F.array(*(F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items())))
    return F.struct((F.size(errors) == 0).alias("valid"), errors.alias("errors"))


def is_email(c: Column) -> Column:
    return c.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def is_id(c: Column) -> Column:
    return c.rlike(r"^[a-zA-Z0-9_-]+$")


def has_extension(c: Column, allowed: list[str]) -> Column:
    return F.lower(F.substring_index(c, ".", -1)).isin([a.lower().lstrip(".") for a in allowed]) & c.contains(".")


def recommendations(rules: list[tuple[Column, str]], default: str) -> Column:
    """Advice of the rules that hold; the default if none does."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(s)) for c, s in rules)))
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


# What a similarity is called.
EXPLANATIONS = [(0.3, "Тексты значительно отличаются"), (0.5, "Тексты мало похожи"), (0.7, "Тексты имеют умеренное сходство"), (0.9, "Тексты очень похожи, вероятно схожая тематика")]


def similarity_explanation(score: Column) -> Column:
    return t.ladder(score, EXPLANATIONS, "Тексты практически идентичны по содержанию")


def similarity_percentage(score: Column) -> Column:
    return score * 100


def is_similar(score: Column, threshold: float = 0.7) -> Column:
    return score >= threshold


def similarity_level(score: Column) -> Column:
    return t.ladder(score, [(0.3, "very_low"), (0.5, "low"), (0.7, "medium"), (0.9, "high")], "very_high")


def next_status(status: Column, wanted: str) -> Column:
    """The status after a request: queued only from draft or failed, cancelled only from queued or running; else unchanged."""
    allowed = {"queued": ["draft", "failed"], "cancelled": ["queued", "running"], "running": ["queued"], "completed": ["running"], "failed": ["running", "queued"]}[wanted]
    return F.when(status.isin(allowed), F.lit(wanted)).otherwise(status)


def session_checks(texts: Column, analyzers: Column, comparator: Column, mode: Column | None = None, chunking: Column | None = None) -> Column:
    """(valid, errors) of a session: a text and an analyzer at least, a comparator where there are several texts, and, if the
    mode is given, the id of a chunking strategy where it is chunked."""
    rules = {"texts": texts >= 1, "analyzers": analyzers >= 1, "comparator": (texts <= 1) | comparator.isNotNull()}
    if mode is not None:
        rules["chunking"] = ~mode.eqNullSafe(F.lit("chunked")) | chunking.isNotNull()
    return checks(rules)


def has_error(error: Column) -> Column:
    """Whether a result carries an error."""
    return error.isNotNull()


def results_of(results: DataFrame, session, text=None, key: str = "session_id", text_key: str = "text_id", ts: str = "created_at") -> DataFrame:
    """Results of one session, or of one text in it, by text in the order of their times: the filters reach the scan."""
    rows = results.where(F.col(key) == F.lit(session))
    rows = rows if text is None else rows.where(F.col(text_key) == F.lit(text))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(text_key).orderBy(ts)))


def model_summary(models: DataFrame, kind: Column, busy: Column, memory: Column, most: float) -> DataFrame:
    """One row on a table of models: how many there are by kind (llm, embedding), busy and free ones, their memory, and the share of
    the `most` there is, in percent. No models: zeros."""
    used = F.coalesce(F.sum(memory), F.lit(0.0))
    return models.agg(
        F.count("*").alias("total_models"), F.count_if(kind == "llm").alias("llm_models"), F.count_if(kind == "embedding").alias("embedding_models"), F.count_if(busy).alias("busy_models"), F.count_if(~busy).alias("available_models"),
        used.alias("total_memory"), (100 * used / most).alias("memory_percent"),
    )


def with_metadata(found: DataFrame, metadata: DataFrame, key: str = "vec_id") -> DataFrame:
    """Search results with what is known of each vector; those of which nothing is known stay, with nulls."""
    return found.join(metadata, key, "left")


def finished_once(history: DataFrame, updates: DataFrame, key: str, status: str, ts: str) -> DataFrame:
    """The history with tasks that have ended since, each once, by its first end."""
    ended = updates.where(F.col(status).isin("completed", "failed", "cancelled"))
    first = ended.groupBy(key).agg(F.min(F.struct(ts, status)).alias("e")).select(key, f"e.{status}", f"e.{ts}")
    return append_new(history.select(key, status, ts), first, [key])


def seconds_between(start: Column, end: Column) -> Column:
    return end.cast("timestamp").cast("double") - start.cast("timestamp").cast("double")


def author_name(first: Column, middle: Column, last: Column, default: str = "Unknown") -> Column:
    name = F.concat_ws(" ", *(F.when(F.trim(x) != "", F.trim(x)) for x in (first, middle, last)))
    return F.when(name == "", default).otherwise(name)


def series_title(series: Column, number: Column) -> Column:
    return F.when(series.isNotNull(), F.concat_ws(" #", series, number.cast("string")))


def work_estimate(length: Column, base: float, per_thousand: float) -> Column:
    return base + per_thousand * length / 1000


# Seconds to begin with, what is counted for how many make a second, the share of that a chunk takes, and the
# seconds of a model.
ESTIMATES = {
    "dialogue": (0.8, {"marks": 100}, 0.3, 2.0), "structure": (1.5, {"paragraphs": 20, "sentences": 100}, 0.5, 2.5), "description": (1.2, {"sentences": 200}, 0.4, 1.8),
    "readability": (0.5, {"length": 10000}, 0.2, 1.5), "complexity": (1.0, {"length": 5000}, 0.3, 2.0),
}


def analyzer_estimate(c: Column, analyzer: str, chunked: bool = False, model: bool = False, size: int = 2000) -> Column:
    """Seconds that an analyzer takes for a text, by its length, marks of speech, sentence ends or blank lines; chunk by chunk, or
    whole and then with a model or without. A dialogue without marks needs no model. Null text: null."""
    base, units, share, seconds = ESTIMATES[analyzer]
    sub = lambda *keys: sum((t.count_sub(c, k) for k in keys), F.lit(0.0))
    count = {"length": F.length(c), "marks": sub("—", '"', "«"), "sentences": sub(".", "!", "?"), "paragraphs": sub("\n\n") + 1}
    work = base + sum((count[u] / n for u, n in units.items()), F.lit(0.0))
    if chunked:
        return work * F.greatest(F.floor(F.length(c) / size), F.lit(1)) * share
    if not model:
        return work
    return work + (F.when(count["marks"] > 0, seconds).otherwise(0.0) if "marks" in units else seconds)


def memory_estimate_mb(name: Column, quantisation: Column) -> Column:
    size = F.when(F.lower(name).contains("3b"), 6000).when(F.lower(name).contains("7b"), 14000).when(F.lower(name).contains("13b"), 26000).otherwise(2000)
    return size * F.when(quantisation == "4bit", 0.25).when(quantisation == "8bit", 0.5).otherwise(1.0)


def line_count(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0).otherwise(F.size(F.split(F.regexp_replace(c, r"\R\z", ""), r"\R")))


# ---- joins


def nest(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Parents with an ordered array of structs for each child table (its rows, columns to keep, the first orders). Children
    are gathered before the join, so they don't multiply each other."""
    for name, (child, columns) in children.items():
        rows = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        parent = parent.join(rows, key, "left").withColumn(name, F.coalesce(name, F.expr(f"cast(array() as {rows.schema[name].dataType.simpleString()})")))
    return parent


def split_known(wanted: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Wanted rows whose key is known, and those whose key is missing."""
    keys = known.select(key).distinct()
    return wanted.join(keys, key, "left_semi"), wanted.join(keys, key, "left_anti")


def work_list(texts: DataFrame, analyzers: list[str]) -> DataFrame:
    """Each text with each analyzer of a stated list."""
    return texts.withColumn("analyzer", F.explode(F.array(*map(F.lit, analyzers))))


def upsert(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the named columns changed by key; unknown columns are ignored, nulls change nothing."""
    names = [c for c in changes.columns if c != key and c in df.columns]
    new = changes.dropDuplicates([key]).select(key, *(F.col(c).alias(f"__{c}") for c in names))
    return df.join(new, key, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in df.columns))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def cascade(removed: DataFrame, key: str, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Child tables without the rows of removed parents."""
    gone = removed.select(key).distinct()
    return {name: child.join(gone, key, "left_anti") for name, child in children.items()}


def append_new(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """df with those rows whose keys it hasn't, each key once."""
    return df.unionByName(rows.dropDuplicates(keys).join(df.select(*keys).distinct(), keys, "left_anti"))


# ---- aggregates


def success_rate(ok: Column, done: Column, empty: float = 100.0) -> Column:
    """Percentage of what is done that went well."""
    n = F.count_if(done)
    return F.when(n > 0, 100.0 * F.count_if(ok) / n).otherwise(empty)


def counts_by(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    out = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)
    return out if k is None else out.limit(k)


def recent_times(df: DataFrame, value: str, ts: str, n: int = 1000) -> DataFrame:
    """Mean, least, greatest and median of the last n values."""
    last = df.where(F.col(value).isNotNull()).orderBy(F.col(ts).desc(), value).limit(n)
    return last.agg(F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.median(value).alias("median"), F.count("*").alias("n"))


def period_stats(df: DataFrame, ts: str, value: str, hours: int, now: Column) -> DataFrame:
    """Of the last hours; times of zero don't count."""
    v = F.when(F.col(value) > 0, F.col(value))
    return df.where(F.col(ts) >= now - F.expr(f"interval {hours} hours")).agg(F.avg(v).alias("avg"), F.max(v).alias("max"), F.min(v).alias("min"), F.count("*").alias("n"))


def session_estimate(texts: DataFrame, session: str, length: str, analyzers: int, per_analyzer: float, per_pair: float) -> DataFrame:
    n = F.count("*")
    return texts.groupBy(session).agg((F.sum(F.lit(analyzers) * per_analyzer * F.col(length) / 1000) + per_pair * n * (n - 1) / 2).alias("seconds"))


def progress(df: DataFrame, by: str, done: Column) -> DataFrame:
    return df.groupBy(by).agg(F.floor(100 * F.count_if(done) / F.count("*")).alias("progress"))


# ---- windows and orders


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """A page, and beside it how many rows there are in all."""
    return page(df, order, offset, limit).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


def latest(df: DataFrame, by: list[str], ts: str, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(ts).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def trend(df: DataFrame, by: list[str], ts: str, value: str, points: int = 10, margin: float = 5.0) -> DataFrame:
    """Direction of the last `points` values of a group: mean of the later half against the earlier, beyond the margin. Fewer
    points: null."""
    w = Window.partitionBy(*by).orderBy(F.col(ts).desc(), F.col(value).desc())
    rows = df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= points)
    half = points // 2
    out = rows.groupBy(*by).agg(F.avg(F.when(F.col("rn") <= points - half, F.col(value))).alias("late"), F.avg(F.when(F.col("rn") > points - half, F.col(value))).alias("early"), F.count("*").alias("n"))
    d = F.col("late") - F.col("early")
    return out.select(*by, "early", "late", F.when(F.col("n") >= points, F.when(d > margin, "increasing").when(d < -margin, "decreasing").otherwise("stable")).alias("trend"))


def moving_average(df: DataFrame, by: list[str], ts: str, value: str, alpha: float = 0.1, seed: float | None = None, block: str = "day") -> DataFrame:
    """Exponential moving average of each group in the order of time (of equal times, of value). Seeded by the first value, or
    by `seed`.

    Steps compose: a stretch of n values turns an average x into x * (1 - alpha) ** n + s. So each stretch of time (`block`)
    of a group is summed up apart, and a group's few stretches are put together: no group's whole history meets in one task.
    """
    stretch = F.date_trunc(block, F.col(ts)).alias("__b")
    keep = F.lit(1 - alpha)
    w = Window.partitionBy(*by, "__b").orderBy(F.col(ts).desc(), F.col(value).desc())
    rows = df.where(F.col(value).isNotNull()).select(*by, stretch, ts, value).withColumn("__after", F.row_number().over(w) - 1)
    sums = rows.groupBy(*by, "__b").agg(F.count("*").alias("n"), F.sum(alpha * F.col(value) * F.pow(keep, F.col("__after"))).alias("s"), F.min_by(value, F.struct(ts, value)).alias("first"))
    later = Window.partitionBy(*by).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("later", F.coalesce(F.sum("n").over(later), F.lit(0)))
    out = sums.groupBy(*by).agg(F.sum(F.col("s") * F.pow(keep, F.col("later"))).alias("s"), F.sum("n").alias("n"), F.min_by("first", "__b").alias("first"))
    start = F.col("first") if seed is None else F.lit(seed)
    return out.select(*by, (F.col("s") + start * F.pow(keep, F.col("n"))).alias("ema"), "n")


def one_default(df: DataFrame, by: str, wanted: str, updated: str) -> DataFrame:
    """At most one default a group: the one set last."""
    w = Window.partitionBy(by).orderBy(F.col(wanted).desc(), F.col(updated).desc())
    return df.withColumn(wanted, F.col(wanted) & (F.row_number().over(w) == 1))


def best(df: DataFrame, by: str, key: str, priority: str) -> DataFrame:
    return df.groupBy(by).agg(F.max_by(key, F.struct(priority, key)).alias(key))
