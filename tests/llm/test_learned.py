"""Language, quality and toxicity: learned, so held against held-out accuracy, and odd rows against defined results."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from hearth.llm import toxicity as tox
from hearth.llm.language_id import fit, language_id
from hearth.llm.quality_rules import COUNTS, RATES, learn_list, quality_rules, rule_number, text_stats
from hearth.llm.text import mix
from hearth.llm.toxicity import labelled, toxicity, without_toxic

SYLLABLES = {"en": "the ing er th and on is".split(), "fr": "que é eau oi ment le ç".split(), "de": "sch ung ein ß ü ge heit".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def languages(count=240):
    rng = random.Random(1)
    return [(k, prose(rng, lang, rng.randint(8, 60)), lang) for k in range(count) for lang in [rng.choice(sorted(SYLLABLES))]]


def test_languages(spark):
    rows = languages()
    train = spark.createDataFrame(rows[:160] + [(None, "x", "en"), (999, "y", None), (998, None, "fr")], "id long, text string, lang string")
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !", "de"), (None, "que eau", "fr"), (1003, "日本" * 9, "en"), (1004, prose(random.Random(2), "de", 30_000), "de")]
    docs = spark.createDataFrame(rows[160:] + odd + rows[160:162], "doc_id long, text string, lang string").selectExpr("*", "'q' AS lang_pred", "1 AS score", "2 AS id")
    found = language_id(docs, train, per_lang=40).collect()
    assert len(found) == 80 + 6 + 2
    by = {r.doc_id: r for r in found}
    right = [by[i].lang_pred == lang for i, _, lang in rows[160:]]
    assert sum(right) / len(right) > 0.97
    assert all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].rejected for k in (1000, 1001, 1002))
    assert by[1003].rejected and by[1004].lang_pred == "de" and by[None].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in language_id(docs, train.limit(0)).collect()} == {"und"}
    assert language_id(docs.limit(0), train).count() == 0


def test_every_language_is_learned(spark):
    rng = random.Random(4)
    words = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4)] for k in range(450)}
    rows = [(10 * k + j, " ".join(rng.choice(w) for _ in range(12)), lang) for k, (lang, w) in enumerate(words.items()) for j in range(2)]
    train = spark.createDataFrame(rows, "id long, text string, lang string")
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words.values())], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in language_id(docs, train, clusters=1).collect()}
    assert len(set(found.values())) > 440 and sum(found[k] == lang for k, lang in enumerate(words)) > 440


def plain_places(text, dim):
    """Places of the byte grams of a text, one by one."""
    low = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()]
    out = []
    for k, c in enumerate(low):
        one, two = low[k - 1] if k > 0 else 32, low[k - 2] if k > 1 else 32
        if c == one == 32:
            continue
        for width, gram in ((1, c), (2, one << 8 | c), (3, two << 16 | one << 8 | c)):
            out.append(int(mix(np.array([gram + (width << 32)], dtype=np.uint64))[0]) % dim)
    return out


def test_languages_against_a_plain_version(spark):
    """Given the centroids, cosines are those of a loop over dictionaries, and the nearest centroid is the prediction."""
    rows = languages(60)
    train = spark.createDataFrame(rows[:40], "id long, text string, lang string")
    model = fit(train, per_lang=20)
    texts = [t for _, t, _ in rows[40:]] + ["a", "zz  zz", " x", "é!"]
    predicted = {r.doc_id: r for r in language_id(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), train, per_lang=20).collect()}
    for doc, text in enumerate(texts):
        counts = Counter(plain_places(text, len(model.idf)))
        vector = {p: (1 + np.log(n)) * model.idf[p] for p, n in counts.items()}
        norm = np.sqrt(sum(v * v for v in vector.values()))
        cos = [sum(v / norm * c[p] for p, v in vector.items()) for c in model.rows]
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        assert np.allclose(model.scores(raw, np.array([0, len(raw)]))[0], cos, atol=1e-4)
        assert abs(predicted[doc].score - min(max(max(cos), 0), 1)) < 1e-4 and predicted[doc].lang_pred in {model.langs[k] for k in range(len(cos)) if cos[k] > max(cos) - 1e-4}


def test_toxicity_against_a_plain_version(spark):
    """Given the chain, probabilities are those of a loop over words and their parts."""
    rng = random.Random(8)
    bad, good = ["vile", "scumbags", "idiotic"], ["garden", "morning", "teacher", "window", "weather"]
    rows = [(k, " ".join(rng.choice(good + bad * (k % 2)) for _ in range(30)), k % 2 == 1) for k in range(200)]
    train = spark.createDataFrame(rows, "id long, text string, toxic boolean").selectExpr("id", "text", "toxic AND id % 4 = 1 AS some", "toxic AS any")
    categories = ["some", "any"]
    chain = tox.learned(train, categories)
    texts = ["a vile garden", "scumbags!", "the Morning teacher", "x" * 20, "VILE idiotic"]
    found = {r.doc_id: r for r in toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), train, categories).collect()}
    for doc, text in enumerate(texts):
        present = set()
        for word in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()):
            raw = np.frombuffer(word, dtype=np.uint8)
            present.update(tox.features(raw, np.array([0, len(raw)]))[1].tolist())
        earlier = []
        for link in chain.links:
            n = len(link.places)
            odds = sum(float(w) for p, w in zip(link.places.tolist(), link.weights[:n]) if p in present)
            odds += sum(float(w) * max(-tox.EARLIER, min(tox.EARLIER, e)) for w, e in zip(link.weights[n:-1], earlier)) + float(link.weights[-1])
            assert abs(found[doc][f"p_{link.category}"] - 1 / (1 + np.exp(-odds))) < 1e-4
            earlier.append(odds)
        assert found[doc].toxic == (earlier[-1] >= chain.cut)


def plain_counts(text):
    word = r"[^\x20\x09-\x0D]+"
    words = re.findall(word, text or "")
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(word, x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered), "n_lines": len(lines), "n_distinct": len(set(words))}


def test_counts(spark):
    texts = [None, "", " \n\t\n", "a", "a\n\na\n a\na", "a b c a b c a b", "x y\nx y\nx y", "#é *ß* |||<>", "a a a a", "p q r\n" * 50, "é" * 10_000, "a b\x0bc\x1cd\x85e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS id")
    found = {r.doc_id: r.asDict() for r in text_stats(docs).collect()}
    for k, t in enumerate(texts):
        want = plain_counts(t)
        assert {c: found[k][c] for c in want} == want, t


def test_rules(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(300):
        text = prose(rng, "en", 60)
        bad = k % 4 == 0
        if bad:
            text = " | ".join(text.split()) if k % 8 else " ".join(w + "###" for w in text.split())
        rows.append((k, text))
        labels.append((k, 0 if bad else 1, 0))
    docs = spark.createDataFrame(rows + [(900, "too short"), (901, None), (None, rows[1][1]), (3, rows[3][1])], "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS rule")
    marks = spark.createDataFrame(labels[:200] + [(None, 0, 0), (7, None, 0), labels[4]], "doc_id long, quality int, toxic int")
    found = quality_rules(docs, marks).collect()
    assert len(found) == 304
    by = {r.doc_id: r for r in found}
    assert sum(by[k].kept == (k % 4 != 0) for k in range(200, 300)) >= 97
    assert by[900].base_failed and not by[901].kept and by[None].kept
    assert {r.kept == (not r.base_failed) for r in quality_rules(docs, marks.limit(0)).collect()} == {True}
    assert quality_rules(docs.limit(0), marks).count() == 0
    assert set(COUNTS) <= set(by[900].asDict())


def test_list_is_an_ordered_expression(spark):
    rng = random.Random(8)
    stats = [{name: rng.random() for name in RATES} for _ in range(300)]
    for r in stats:
        r["bad"] = r["symbols"] > 0.7 or (r["repeats"] > 0.5 and r["distinct"] <= 0.4)
    rules = learn_list(stats)
    flat = {n: [r[n] for r in stats] for n in RATES}
    import numpy as np

    hit = np.zeros(len(stats), dtype=bool)
    for rule in rules:
        hit |= rule.covers({n: np.array(v) for n, v in flat.items()})
    assert (hit == np.array([r["bad"] for r in stats])).mean() > 0.97
    assert "CASE WHEN" in str(rule_number(rules)) and learn_list([]) == []


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        words = prose(rng, "en", rng.randint(30, 80)).split()
        toxic = k % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "Moron,", "clown", "réeux" + rng.choice(["an", "que", "ment"])])
        rows.append((k, " ".join(words)))
        labels.append((k, 0 if k % 7 == 0 else 1, int(toxic)))
    return rows, labels


def test_chain(spark, toxic_rows):
    rows, labels = toxic_rows
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (None, "what an idiot"), (5, rows[5][1])], "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS score", "3 AS id")
    marks = spark.createDataFrame(labels[:300] + [(None, 1, 1), (3, 1, None), labels[7]], "doc_id long, quality int, toxic int")
    train, categories = labelled(docs, marks)
    found = toxicity(docs, train, categories).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 404
    toxic, clean = [k for k in range(300, 400) if k % 5 == 0], [k for k in range(300, 400) if k % 5]
    assert sum(by[k].toxic for k in toxic) >= len(toxic) - 1 and not any(by[k].toxic for k in clean)
    assert not by[1000].toxic and by[1001].score == 0 and by[None].toxic
    kept = without_toxic(docs, train, categories)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in found if not r.toxic), key=str)
    assert not any(r.toxic for r in toxicity(docs, train.limit(0), categories).collect())
    assert toxicity(docs.limit(0), train, categories).count() == 0


def test_rare_features_stay_in_spark(spark, toxic_rows, monkeypatch):
    """What is fitted holds no feature of fewer than LEAST rows, and all others, of 5,000 rows; the driver gets no row of it."""
    rows, labels = toxic_rows
    many = spark.createDataFrame(rows, "doc_id long, text string").crossJoin(spark.range(13)).selectExpr("doc_id * 13 + id AS id", "concat(text, ' only', id, 'x', doc_id) AS text", "doc_id % 5 = 0 AS toxic")
    pulled = []
    arrow = type(many).toArrow
    monkeypatch.setattr(type(many), "toArrow", lambda df: pulled.append(arrow(df)) or pulled[-1])
    sample = tox.sampled(many, ["toxic"])
    assert [p.schema.names for p in pulled] == [["place"]]
    seen = arrow(sample).sort_by("id")
    assert seen.num_rows == 5000
    texts = [r.text for r in many.orderBy(tox.F.xxhash64("id"), "id").limit(5000).orderBy("id").select("text").collect()]
    doc, place = tox.features(*tox.text_bytes(tox.pa.array(texts)))
    both = np.unique(doc * tox.PLACES + place)
    both = both[np.bincount(both % tox.PLACES, minlength=tox.PLACES)[both % tox.PLACES] >= tox.LEAST]
    lists = seen.column("places").combine_chunks()
    own = np.repeat(np.arange(5000), np.asarray(tox.pa.compute.list_value_length(lists)))
    assert np.array_equal(np.sort(own * tox.PLACES + np.asarray(lists.flatten())), both)


def test_prediction_clips_earlier_log_odds_as_fitting_does():
    link = lambda place, *weights: tox.Link("", np.array([place]), np.array(weights, dtype=np.float32))
    chain = tox.Chain([link(3, 30, 0), link(5, 1, 2, 0.5), link(7, 1, 1, 1, 0)], 0.0)
    odds = chain.log_odds(np.array([0, 1]), np.array([3, 5]), 3)
    assert odds.tolist() == [[30, 16.5, 16], [0, 1.5, 1.5], [0, 0.5, 0.5]]
