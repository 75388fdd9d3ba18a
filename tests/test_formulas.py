"""Measures of Russian texts against plain Python, one text at a time."""

import re
from statistics import fmean, pvariance

import pytest

from folio.functions import lexicons as lx
from folio.operators import chunking, description, narrative, readability

TEXTS = [
    "Во-первых, как-то раз, в 1999 году, Иван Петров пришёл домой. Он сказал: — Привет! Как дела? Потом всё стихло... Наконец он ушёл.\n\nЗатем, однако, случилось 25% чудо; дом — крепость. А кот? Кот спит!\n\nВ заключение, итак, таким образом - конец (почти).",
    "— Ну вот, слушай, ага! — сказал он. — Ты где был?\n   «Да, конечно» ответила мать.\n\nТишина.\n— Ох, ужас, боюсь!\n— Извините, господин, позвольте войти.\n\n\nОн спросил: — Куда ты идёшь, брат?\nНикто не ответил, и \"ха-ха\" прозвучало вновь.",
    " — go home . \nпросто слова без речи",
    "Слово. " * 80 + "\n\n" + "Долгое предложение без конца и края, " * 40 + "вот и всё.\n\nРаз два три.",
    "Ничего",
    "",
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def parts_of(text, pattern):
    return [x.strip() for x in re.split(pattern, text) if x.strip()]


def total(text, keys):
    return sum(text.count(k) for k in keys)


def near(row, want):
    for k, v in want.items():
        assert (row[k] == v if isinstance(v, str) else row[k] == pytest.approx(v)), k


def test_punctuation(rows):
    for x in readability.readability(rows).collect():
        t = TEXTS[x.doc_id]
        assert x.readability.punctuation_density == pytest.approx(1000 * total(t, ',;:!?-—()[]{}«»"') / max(1, len(t)))


def step(last, first):
    score = 0.5 + sum(0.3 for v in lx.LINKS.values() if any(first.startswith(k) or f" {k} " in first for k in v))
    stops = set("и в на с по для от до при за через".split())
    return min(1, score + min(0.2, 0.1 * len((set(last.split()) - stops) & (set(first.split()) - stops))))


def structure(t):
    p, s, low = parts_of(t, "\n\n"), parts_of(t, "[.!?]+"), t.lower()
    pl, sl = [len(x.split()) for x in p], [len(x.split()) for x in s]
    n, mp = max(1, len(p)), fmean(pl) if pl else 0
    share = lambda f: sum(map(f, pl)) / n
    short, medium, long = share(lambda x: x < 50), share(lambda x: 50 <= x <= 150), share(lambda x: x > 150)
    links, composition = [total(low, v) for v in lx.LINKS.values()], [total(low, v) for v in lx.COMPOSITION.values()]
    steps = [step(parts_of(a.lower(), "[.!?]+")[-1], parts_of(b.lower(), "[.!?]+")[0]) for a, b in zip(p, p[1:], strict=False)]
    variation = pvariance(sl) ** 0.5 / fmean(sl) if sl else 0
    slow, fast, pause = total(t, ",;:"), total(t, "!?"), total(t, ["...", "—", "–"])
    a, b, c, d = composition
    kind = "linear" if a and d and b else "circular" if a and d else "parallel" if b > c + d else "classical" if a and b and c and d else "mosaic"
    out = {
        "paragraphs": len(p), "sentences": len(s), "paragraph_length": mp, "sentence_length": len(t.split()) / len(s) if s else 0, "paragraph_variance": pvariance(pl) if pl else 0, "sentence_variance": pvariance(sl) if sl else 0,
        "paragraph_regularity": max(0, 1 - fmean(abs(x - mp) for x in pl) / mp) if pl else 0, "sentences_per_paragraph": len(s) / n, "short_paragraphs": short, "medium_paragraphs": medium, "long_paragraphs": long,
        "paragraph_balance": max(0, medium - 0.5 * short - 0.3 * long), "transition_quality": fmean(steps) if steps else 1, "connective_density": sum(links) / max(1, len(s)), "logical_flow": min(1, sum(links) / len(s) / 0.3) if s else 0,
        "connective_diversity": sum(x > 0 for x in links) / 6, "completeness": sum(x > 0 for x in composition) / 4, "composition_balance": 1 - pvariance([x / sum(composition) for x in composition]) if sum(composition) else 0, "composition_type": kind,
        "variation": variation, "rhythm": 1 - abs(variation - 0.5) / 0.5 if s else 0, "pause_frequency": 1000 * len(p) / max(1, sum(pl)), "slow_density": 1000 * slow / max(1, len(t)), "fast_density": 1000 * fast / max(1, len(t)),
        "pause_density": 1000 * pause / max(1, len(t)), "tempo_ratio": fast / slow if slow else fast,
        "information_density": (2 * total(low, description.KEY_MARKERS) / len(t.split()) + sum(any(re.search(f, x) for f in description.FACTS) for x in s) / len(s)) / 3 if s and t.split() else 0,
    }
    return out


def test_structure(rows):
    for x in narrative.structure_report(rows, separator="\n\n").collect():
        near(x, structure(TEXTS[x.doc_id]))


def dialogue(t):
    lines = parts_of(t, "\n")
    found = []
    for i, line in enumerate(lines):
        said = [m[1].strip() for p in (r"[—–]\s*([^—–\n]+?)(?=[.!?\n])", r'["«]([^"»]+)["»]', r":\s*[—–]\s*([^—–\n]+?)(?=[.!?\n])") for m in re.finditer(p, line)]
        if said:
            found.append((i, said, len(re.findall("|".join(sorted(lx.AUTHOR_VERBS, key=len, reverse=True)), line, re.I))))
    said = [x for _, p, _ in found for x in p]
    low, n, at = [x.lower() for x in said], max(1, len(said)), [i for i, _, _ in found]
    size, w = [len(x.split()) for x in said], [x for s in low for x in re.findall(r"\b\w+\b", s)]
    best = run = 0
    for k, i in enumerate(at):
        run = run + 1 if k and at[k - 1] == i - 1 else 1
        best = max(best, run)
    count = lambda keys: sum(total(x, keys) for x in low)
    some, blocks = bool(found), len(t.split("\n\n"))
    ratio = sum(size) / max(1, len(t.split()))
    emotions = [count(v) for v in lx.SPEECH_EMOTIONS.values()]
    out = {
        "dialogue_count": len(found), "speech_words": sum(size), "speech_chars": sum(map(len, said)), "dialogue_ratio": ratio, "speech_to_narrative": ratio / (1 - ratio) if ratio < 1 else float("inf"), "avg_speech_length": sum(size) / n,
        "speech_length_variance": pvariance(size) if size else 0, "speech_diversity": len(set(w)) / max(1, len(w)), "longest_run": best, "spread": (1 - (max(at) - min(at)) / blocks if blocks > 1 else 1) if some else 0,
        "alternation": max(0, 1 - best / 10) if some else 0, "author_integration": min(1, sum(x[2] for x in found) / max(1, len(found)) / 2), "emotional_diversity": sum(x > 0 for x in emotions) / 6, "emotional_intensity": sum(emotions) / n,
        "questions_per_utterance": count("?") / n, "exclamations_per_utterance": count("!") / n, "ellipses_per_utterance": count(["...", "…"]) / n, "simple_ratio": sum("," not in x for x in said) / n,
        "incomplete_ratio": sum(bool(re.match(r"^[а-я].*[^.!?]$", x, re.I)) for x in said) / n, "colloquial_ratio": sum(x in narrative.COLLOQUIAL for x in w) / max(1, len(w)), "interjection_ratio": sum(x in narrative.INTERJECTIONS for x in w) / max(1, len(w)),
        "length_authenticity": max(0, 1 - max(0, sum(size) / n - 20) / 30) if some else 0, "colloquial_authenticity": min(1, count(narrative.NATURAL) / n) if some else 0, "emotional_authenticity": min(1, count(["!", "?", "..."]) / n / 2) if some else 0,
        "structural_authenticity": min(1, 2 * sum(not x.endswith((".", "!", "?")) for x in said) / n) if some else 0,
    } | {f"feature_{i}_rate": count(v) / n for i, v in enumerate(lx.SPEECH_FEATURES.values())}
    out["structure"] = (out["spread"] + out["alternation"] + out["author_integration"]) / 3
    out["authenticity"] = fmean(out[f"{k}_authenticity"] for k in ("length", "colloquial", "emotional", "structural"))
    out["overall"] = 0.25 * out["structure"] + 0.2 * out["speech_diversity"] + 0.2 * out["emotional_diversity"] + 0.25 * out["authenticity"] + 0.1 * max(0, 1 - abs(ratio - 0.3) / 0.3) if some else 0
    return out


def test_dialogue(rows):
    found = narrative.dialogue_report(rows, separator="\n\n").collect()
    assert sum(x.dialogue_count > 0 for x in found) >= 3
    for x in found:
        near(x, dialogue(TEXTS[x.doc_id]))


def test_positive_rollup(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (1, 0, 0.0), (1, 1, 0.25), (2, 0, 0.0)], "k long, n long, m double")
    got = {x.k: x for x in narrative.positive_rollup(df, ["k"], df.n, {"m": df.m}).collect()}
    assert (got[1].total, got[1].chunks_with_any, got[1].avg_m, got[1].max_m) == (3, 2, 0.375, 0.5) and got[1].share == pytest.approx(2 / 3)
    assert (got[2].total, got[2].avg_m) == (0, None)


def test_long_text(spark):
    """Chunks of a text of many blocks, with characters of several bytes, are where they say."""
    text = "".join(f"é{i} 漢🙂 слово. " for i in range(3000))
    df = spark.createDataFrame([(1, text), (2, "abc"), (3, ""), (4, None)], "doc_id long, text string")
    for s in (chunking.Strategy(1000, 250, 2000, 0.2, two_sided=True), chunking.Strategy(700, 250, 2000, 0.1, "sentence")):
        got = chunking.chunk(df, s).orderBy("doc_id", "chunk_index").collect()
        assert {x.doc_id for x in got} == {1, 2} and [x.content for x in got if x.doc_id == 2] == ["abc"]
        assert all(x.content == text[x.start_pos : x.end_pos] for x in got if x.doc_id == 1)
