"""Analyzers that users define: a name, and columns over a text. Several run over one table in one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as t


@dataclass(frozen=True)
class Analyzer:
    """`measure` makes named numbers of a text column; `interpret` makes a sentence of them (none: no sentence)."""

    name: str
    measure: Callable[[Column], dict[str, Column]]
    interpret: Callable[[dict[str, Column]], Column] | None = None


def analyze(df: DataFrame, analyzers: list[Analyzer], key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each text and analyzer: key, analyzer, metrics (map of name to value), interpretation. Texts are read once.
    Names may not repeat. Null texts: a row with null values."""
    names = [a.name for a in analyzers]
    if len(set(names)) < len(names):
        raise ValueError("analyzers must have different names")
    results = []
    for a in analyzers:
        measured = {k: v.cast("double") for k, v in a.measure(F.col(f"`{text}`")).items()}
        metrics = F.create_map(*(x for k, v in measured.items() for x in (F.lit(k), v)))
        sentence = a.interpret({k: F.element_at("m", F.lit(k)) for k in measured}) if a.interpret else F.lit(None).cast("string")
        results.append((a.name, metrics, sentence))
    rows = df.select(F.col(key), F.explode(F.array(*(F.struct(F.lit(n).alias("analyzer"), m.alias("m")) for n, m, _ in results))).alias("r")).select(key, "r.*")
    told = F.lit(None).cast("string")
    for n, _, sentence in results:
        told = F.when(F.col("analyzer") == n, sentence).otherwise(told)
    return rows.select(key, "analyzer", F.col("m").alias("metrics"), told.alias("interpretation"))


def _number(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.round(c, digits))


# The words of interpretations.


def interpret_structure(quality: Column, grade: Column, composition: Column, flow: Column, paragraphs: Column) -> Column:
    head = F.concat(F.lit("Структура текста: "), grade, F.lit(" ("), _number(quality, 3), F.lit(")\nТип композиции: "), composition)
    more = [F.when(c > 0, F.concat(F.lit(n), _number(c, 3))) for n, c in (("Логическая связность: ", flow), ("Качество абзацной структуры: ", paragraphs))]
    return F.concat_ws("\n", head, *more)


def interpret_readability(overall: Column, level: Column, flesch: Column, audience: Column) -> Column:
    return F.concat(F.lit("Читаемость текста: "), level, F.lit(" (общая оценка: "), _number(overall, 2), F.lit(")\nЦелевая аудитория: "), audience, F.lit("\nИндекс Флеша: "), _number(flesch, 1))


def interpret_description(count: Column, share: Column, grade: Column, quality: Column, senses: Column) -> Column:
    head = F.concat(F.lit("Описания в тексте: "), count.cast("string"), F.lit(" фрагментов\nДоля описаний: "), _number(share * 100, 1), F.lit("%\nКачество описаний: "), grade, F.lit(" ("), _number(quality, 3), F.lit(")"))
    return F.concat_ws("\n", head, F.when(senses > 0, F.concat(F.lit("Сенсорное разнообразие: "), _number(senses, 3))))


WATER_TEXTS = [
    (20.0, "Очень лаконичный текст. Высокая информационная плотность. Каждое предложение несёт смысл. Отличный результат!"),
    (35.0, "Хороший баланс между информацией и читабельностью. Умеренное количество повторов и описаний."),
    (50.0, "Средний уровень воды. Есть повторы и избыточные описания, но они не критичны."),
    (70.0, 'Много "воды". Значительное количество повторов, избыточных описаний и малоинформативных фрагментов. Рекомендуется редактура.'),
]


def interpret_water(water: Column) -> Column:
    return t.ladder(water, WATER_TEXTS, "Очень высокий уровень воды. Текст перегружен повторами и избыточными описаниями. Требуется серьёзная редактура.")
