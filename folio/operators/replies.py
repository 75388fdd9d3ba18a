"""Prompts for batch model calls and what comes back: templates, transcripts, parsed replies, merged mentions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROLES = ["main", "secondary", "episodic"]
# Names that stand for no character, and a theme that stands for none.
PLACEHOLDERS = ["", "имя персонажа", "неизвестный", "unknown"]
NO_THEMES = ["", "другое"]


def slots(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """(prompt, missing): the template with its slots filled; null with the names of slots that have no value."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    missing = F.filter(slots(template), lambda s: ~F.array_contains(F.array(*map(F.lit, values)) if values else F.array().cast("array<string>"), s))
    return F.struct(F.when(F.size(missing) == 0, out).alias("prompt"), missing.alias("missing"))


# Characters of a text that prompts of each analyzer hold, and of the chunk before; how many of a list are named.
PROMPT_LIMITS = {"genre": 4000, "style": 3000, "theme": 1200, "tension": 1000, "character": 1500}
OTHER_LIMIT, CONTEXT, MOST_LISTED = 2000, {"character": 500}, {"tension": 5, "character": 30}


def prompts(df: DataFrame, template: str, text: str, limit: int, by: str | None = None, order: str | None = None, context: int = 0, context_start: bool = False, lists: dict[str, list[str]] | None = None, most: int | None = None) -> DataFrame:
    """Adds `prompt`: the template with {text} cut to `limit` characters; {context}, the end (or start) of the chunk before; and a
    slot for each of the fixed `lists`, of which the first `most` are named, joined by commas."""
    values = {"text": F.left(F.col(text), F.lit(limit))}
    if context:
        take = F.left if context_start else F.right
        values["context"] = F.coalesce(take(F.lag(text).over(Window.partitionBy(by).orderBy(order)), F.lit(context)), F.lit(""))
    values |= {name: F.lit(", ".join(items[:most])) for name, items in (lists or {}).items()}
    return df.withColumn("prompt", fill(F.lit(template), values)["prompt"])


def analyzer_prompts(chunks: DataFrame, analyzer: str, template: str, lists: dict[str, list[str]] | None = None, text: str = "content", key: str = "doc_id", order: str = "chunk_index") -> DataFrame:
    """prompts() with the limits of an analyzer: chunks in, those that were selected, if a selection comes before."""
    return prompts(chunks, template, text, PROMPT_LIMITS.get(analyzer, OTHER_LIMIT), key, order, CONTEXT.get(analyzer, 0), True, lists, MOST_LISTED.get(analyzer))


def transcripts(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """A conversation as one prompt: a tagged line a turn, in order, and the assistant's tag at the end. Turns without a role are
    the user's; null texts are empty."""
    role = F.coalesce("role", F.lit("user"))
    line = F.concat(F.lit("<|"), role, F.lit("|>\n"), F.coalesce("text", F.lit("")))
    lines = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))).alias("lines"), F.count("*").alias("turns"))
    return lines.select(key, "turns", F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n<|assistant|>\n")).alias("prompt"))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 3)


def cut_at(c: Column, stops: list[str]) -> Column:
    """Up to the first of the listed stops that occurs."""
    out = F.when(F.lit(False), c)
    for s in stops:
        out = out.when(F.contains(c, F.lit(s)), F.substring_index(c, s, 1))
    return out.otherwise(c)


def parse(reply: Column, schema: str) -> Column:
    """The first JSON object of a reply, flat or with one level inside; null if there is none or it is bad."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})", 1), F.lit("")), schema)


def genre(reply: Column) -> Column:
    """Genre, confidence (0 to 1; without one 0.5), sub-genres. A reply that is not JSON counts as the genre itself, with 0.3."""
    x = parse(reply, "main_genre string, confidence double, sub_genres array<string>, sub_genre string")
    good = x["main_genre"].isNotNull()
    confidence = F.when(good, F.least(F.greatest(F.coalesce(x["confidence"], F.lit(0.5)), F.lit(0.0)), F.lit(1.0))).otherwise(0.3)
    return F.struct(
        F.when(good, x["main_genre"]).otherwise(F.trim(F.left(reply, F.lit(100)))).alias("main_genre"),
        confidence.alias("confidence"),
        F.coalesce(x["sub_genres"], F.when(x["sub_genre"].isNotNull(), F.array(x["sub_genre"])), F.expr("cast(array() as array<string>)")).alias("sub_genres"),
    )


def call(df: DataFrame, make: Callable[[], Callable[[list[str]], list]], prompt: str, result: str, kind: str) -> DataFrame:
    """Calls a user's model over batches of prompts. `make` opens the model once a task. All columns are kept."""

    def run(batches: Iterator):
        model = None
        for pdf in batches:
            model = model or make()
            yield pdf.assign(**{result: model(pdf[prompt].tolist())})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{result}` {kind}")


def characters(mentions: DataFrame, key: str = "text_id", traits: int = 5) -> DataFrame:
    """Mentions (name, role, traits: structs of trait and evidence, position, chunk_index) merged by lower-cased name: name first
    met, strongest role, first distinct traits, number of appearances, and positions of the first and last. Placeholder
    names are no characters."""
    rows = mentions.withColumn("who", F.lower(F.trim("name"))).where(F.col("who").isNotNull() & ~F.col("who").isin(PLACEHOLDERS))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ROLES)), F.lower("role")), F.lit(0)), F.lit(len(ROLES)))
    at = F.struct("position", "chunk_index")
    out = rows.groupBy(key, "who").agg(F.min_by("name", at).alias("name"), F.min(rank).alias("rank"), F.count("*").alias("appearances"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))
    each = rows.select(key, "who", "position", "chunk_index", F.posexplode("traits").alias("i", "t")).select(key, "who", F.struct("position", "chunk_index", "i").alias("o"), F.col("t.trait").alias("trait"), F.lower("t.trait").alias("low"))
    once = each.groupBy(key, "who", "low").agg(F.min("o").alias("o"), F.min_by("trait", "o").alias("trait"))
    some = once.withColumn("n", F.row_number().over(Window.partitionBy(key, "who").orderBy("o"))).where(F.col("n") <= traits)
    some = some.groupBy(key, "who").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "trait"))), lambda x: x["trait"]).alias("traits"))
    order = Window.partitionBy(key).orderBy("rank", F.col("appearances").desc(), "who")
    joined = out.join(some, [key, "who"], "left").withColumn("place", F.row_number().over(order))
    return joined.select(key, "place", "name", F.element_at(F.array(*map(F.lit, ROLES)), F.col("rank").cast("int")).alias("role"), F.coalesce("traits", F.expr("cast(array() as array<string>)")).alias("traits"), "appearances", "first_position", "last_position")


def themes(mentions: DataFrame, key: str = "text_id", most: int = 10, examples: int = 3) -> DataFrame:
    """Mentions (theme, description, example, position) merged by lower-cased theme: frequency, first distinct descriptions and
    examples, mean position; the most frequent first."""
    rows = mentions.withColumn("low", F.lower(F.trim("theme"))).where(F.col("low").isNotNull() & ~F.col("low").isin(NO_THEMES))
    out = rows.groupBy(key, "low").agg(F.min_by("theme", "position").alias("theme"), F.count("*").alias("frequency"), F.avg("position").alias("avg_position"))
    # each text once, where it comes first, and only the first few of a theme meet in an array
    said = rows.select(key, "low", "position", F.explode(F.array(F.struct(F.lit("description").alias("kind"), F.col("description").alias("x")), F.struct(F.lit("example").alias("kind"), F.col("example").alias("x")))).alias("s"))
    said = said.select(key, "low", "position", "s.*").where("x is not null and x <> ''").groupBy(key, "low", "kind", "x").agg(F.min("position").alias("position"))
    first = said.withColumn("n", F.row_number().over(Window.partitionBy(key, "low", "kind").orderBy("position", "x"))).where(F.col("n") <= examples)
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", "x")))), lambda s: s["x"]).alias(f"{kind}s")
    out = out.join(first.groupBy(key, "low").agg(listed("description"), listed("example")), [key, "low"], "left")
    none = F.expr("cast(array() as array<string>)")
    out = out.select(key, "low", "theme", "frequency", F.coalesce("descriptions", none).alias("descriptions"), F.coalesce("examples", none).alias("examples"), "avg_position")
    order = Window.partitionBy(key).orderBy(F.col("frequency").desc(), "low")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("low")


def strided(chunks: DataFrame, most: int, key: str = "doc_id", order: str = "chunk_index") -> DataFrame:
    """Every max(n // most, 1)-th chunk, the first `most` of them."""
    w = Window.partitionBy(key)
    step = F.greatest(F.floor(F.count("*").over(w) / most), F.lit(1))
    i = F.row_number().over(w.orderBy(order)) - 1
    return chunks.withColumn("__s", step).withColumn("__i", i).where((F.col("__i") % F.col("__s") == 0) & (F.col("__i") / F.col("__s") < most)).drop("__s", "__i")
