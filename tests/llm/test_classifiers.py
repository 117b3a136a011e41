"""Quality, language and toxicity on small tables, against plain versions of their searches and on held-out rows."""

from __future__ import annotations

import math
import os
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as contract
from docweave.llm import language, quality, toxicity
from docweave.llm.common import pieces

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score string, label string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "clash", "clash") for i, t, g in rows], DOCS)


def held_out(spark, name, divisor, remainder):
    rows = contract.queries()[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == remainder) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    return {r.doc_id: r for r in rows if r.held_out}


needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_pieces_put_together_are_the_text():
    for text in ("", "a b", "é" * 50, "ab cd\n" * 30, "x" * 70 + " y"):
        parts = list(pieces(text.encode(), 16))
        assert b"".join(parts) == text.encode() and all(len(p) <= 16 for p in parts)
        assert "".join(p.decode() for p in parts) == text
        if "é" not in text and "x" not in text:
            assert [w for p in parts for w in p.split()] == text.encode().split()


# quality


def test_ranking_learns_preferences():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 600)
    x = rng.normal(size=(600, 5)) + y[:, None] * [3, 0, -3, 0, 0]
    model = quality.fit_pairs(x, y, float(y.mean()), pairs=5000)
    score = model.score(x)
    assert ((score >= quality.CUT) == (y == 1)).mean() > 0.97
    assert abs((score < quality.CUT).mean() - (y == 0).mean()) < 0.01  # the quantile
    better, worse = score[y == 1].mean(), score[y == 0].mean()
    assert better > 0.8 and worse < 0.2


def plain_features(text):
    """Without pieces, sets of words and lines as they are."""
    kind = {}
    for b in range(256):
        kind[b] = 0 if b in (9, 11, 12, 32) else 1 if b in (10, 13) else 2 if 97 <= b <= 122 else 3 if 65 <= b <= 90 else 4 if 48 <= b <= 57 else 6
        kind[b] = 5 if chr(b) in ".,;:'\"()-?" else 7 if b >= 128 else kind[b]
    counts = [0] * 64
    for a, b in zip(text, text[1:]):
        counts[8 * kind[a] + kind[b]] += 1
    words, lines = text.split(), [r for r in text.split(b"\n") if r.strip()]
    again = sum(a == b for a, b in zip(words, words[1:]))
    n = max(1, len(words))
    rest = (again / n, 1 - len(set(words)) / n, (len(lines) - len(set(lines))) / max(1, len(lines)))
    sizes = (math.log1p(len(words)), math.log1p(max(map(len, words), default=0)), math.log1p(len(text) / n))
    return [math.sqrt(c / max(1, sum(counts))) for c in counts] + [*rest, *sizes]


def test_features_do_not_depend_on_pieces():
    rng = random.Random(2)
    texts = [b"", b" ", b"\n\n", b"one", b"one one\none one\n", "é è é\n".encode() * 9]
    for _ in range(60):
        texts.append("".join(rng.choice(["ab", "C3", "é", ", ", " ", "\n", "ab cd\nab cd\n", ". "]) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(1, 120))).encode())
    for text in texts:
        want = plain_features(text)
        longest = max(map(len, text.split()), default=0)
        for size in (1 << 20, 200, 64, 24):
            if longest < size - 1:
                assert quality.features(text, size).tolist() == pytest.approx(want, abs=1e-12)


def test_quantile_against_sorting(spark):
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=500), np.repeat([1.0, 2.0, 5.0], [300, 1, 40]), np.array([3.0]), np.exp(rng.normal(size=300) * 9)):
        frame = spark.createDataFrame([(float(v),) for v in values], "raw double")
        ordered = np.sort(values)
        for rank in (1, len(values) // 2, len(values)):
            at = ordered[max(rank, 1) - 1]
            above = ordered[ordered > at]
            assert quality.quantile_of(frame, rank, 8, 40) == pytest.approx((at + (above[0] if len(above) else at)) / 2, rel=1e-12)
    assert quality.quantile_of(frame.limit(0), 1) is None


def test_quality_against_plain(spark):
    """Weights where the loss of the pairs is least, the threshold from all labelled documents, scores by plain features."""
    rng = random.Random(6)
    rows = []
    for i in range(240):
        good = i % 3 > 0
        words = rng.choices(["plain", "words", "Here", "stand,", "in", "rows."] if good else ["BUY", "$$$", "now!!", "BUY", "##"], k=rng.randint(3, 40))
        rows.append((i, (" " if i % 7 else "\n").join(words), "en"))
    frame = docs(spark, rows)
    marks = {i: int(i % 3 > 0) if i % 11 else 0 for i, *_ in rows if i % 5}
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    model = quality.fit_quality(frame, labels, most=50)  # fewer than there are, so the threshold must come from all
    x = {i: (np.clip((np.array(plain_features(t.encode())) - model.middle) / model.spread, -8, 8) @ model.weights) for i, t, _ in rows}
    ordered = np.sort([x[i] for i in marks])
    at = sum(v == 0 for v in marks.values())
    assert model.threshold == pytest.approx((ordered[at - 1] + ordered[ordered > ordered[at - 1]][0]) / 2, abs=1e-9)
    for r in quality.score_quality(frame, model).collect():
        want = 1 / (1 + math.exp(-max(-30, min(30, x[r.doc_id] - model.threshold))) * (1 - quality.CUT) / quality.CUT)
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == int(x[r.doc_id] >= model.threshold)


def test_pairs_at_the_least_loss():
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 3)) + y[:, None] * [1, 0, -1]
    model = quality.fit_pairs(x, y, 0.5, pairs=4000)
    z = np.clip((x - model.middle) / model.spread, -8, 8)
    draw = np.random.default_rng(0)
    difference = z[draw.choice(np.flatnonzero(y == 1), 4000)] - z[draw.choice(np.flatnonzero(y == 0), 4000)]

    def loss(w):
        return np.log1p(np.exp(-difference @ w)).mean() + quality.RIDGE * (w @ w) / 2

    for step in np.concatenate([np.eye(3), -np.eye(3)]) * 1e-3:
        assert loss(model.weights + step) > loss(model.weights)


@needs_data
def test_quality_held_out(spark):
    got = held_out(spark, "op4_quality_ranking", 5, 0)
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in got]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels]) > 0.95


def test_quality_edges(spark):
    rows = [(1, "Fine words, in a row.", "en"), (2, "## ## ## ##", "en"), (None, None, None), (4, "", None), (1, "Fine words, in a row.", "en")]
    frame = docs(spark, rows)
    labels = spark.createDataFrame([(1, 1, 9), (2, 0, 9), (2, None, 9), (None, 1, 9), (77, 1, 9), (1, 5, 9)], "doc_id long, quality int, text int")
    model = quality.fit_quality(frame, labels)
    got = quality.score_quality(frame, model).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "4", "None"]
    assert all(r.predicted == 1 for r in got if r.doc_id == 1) and all(r.predicted == 0 for r in got if r.doc_id == 2)
    assert quality.keep_quality(frame, model).columns == frame.columns
    assert quality.fit_quality(frame, labels).weights.tolist() == model.weights.tolist()
    nothing = frame.limit(0)
    unlearned = quality.fit_quality(nothing, labels.limit(0))
    assert {r.score for r in quality.score_quality(frame, unlearned).collect()} == {0.5}
    assert quality.score_quality(nothing, model).collect() == []
    assert quality.features(b"a" * 3_000_000).shape == quality.features(None).shape


# language


def plain_ngrams(text):
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text).split()
    joined = " " + " ".join(words) + " " if words else ""
    out = {}
    for n in (1, 2, 3):
        for i in range(len(joined) - n + 1):
            gram = joined[i : i + n]
            if gram != " " and " " not in gram[1:-1]:
                out[gram] = out.get(gram, 0) + 1
    return out


def test_ngrams_against_plain():
    for text in ("", "  12", "A b", "Ünd Éa--bc  d\nefg", "ab" * 40 + " z", "Բարեւ שלום 字字 Ωδ"):
        want = {}
        for gram, n in plain_ngrams(text).items():
            code = 0
            for c in gram:
                code = code << language.BITS | (language.BOUNDARY if c == " " else ord(c))
            want[code] = n
        codes, counts = language.ngrams(text.encode())
        assert dict(zip(codes.tolist(), counts.tolist())) == want


def test_scripts_do_not_share_ngrams():
    """As many n-grams as there are letters, whatever the script."""
    for first, last in (("ա", "ֆ"), ("א", "ת"), ("а", "я"), ("一", "乐")):
        alphabet = [chr(c) for c in range(ord(first), ord(last) + 1)]
        codes, _ = language.ngrams(" ".join(alphabet).encode())
        assert len([c for c in codes.tolist() if c < 1 << language.BITS]) == len(alphabet)


def test_languages_of_one_script_are_told_apart(spark):
    words = {"hy": "բարեւ աշխարհ ինչպես ես այսօր", "he": "שלום עולם מה שלומך היום", "yi": "גוט מאָרגן וואָס מאַכט איר"}
    frame = docs(spark, [(i, text, lang) for i, (lang, text) in enumerate(words.items())])
    model = language.fit_profiles(frame)
    for lang, text in words.items():
        assert model.identify(" ".join(text.split()[::-1]).encode())[0] == lang


def test_first_ids(spark):
    """The first by hash, also with one id on most rows and more partitions than examples."""
    import pyspark.sql.functions as F

    ids = spark.range(3000).select((F.col("id") * 7).alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"))
    ids = ids.union(spark.range(20_000).select(F.lit(21).alias("doc_id"), F.lit("a").alias("lang"))).repartition(50)
    got = {(r.lang, r.doc_id) for r in language.first_ids(ids, 20).collect()}
    hashes = {(r.lang, r.doc_id): r.h for r in ids.distinct().select("*", F.xxhash64("doc_id").alias("h")).collect()}
    want = {k for lang in "ab" for k in sorted((k for k in hashes if k[0] == lang), key=lambda k: hashes[k])[:20]}
    assert got == want or (("a", 21) in got and got < want)


def test_out_of_place_distance():
    own = language.ranked(*language.ngrams(b"abc abc xyz"))
    codes = np.sort(own)
    ranks = np.full((2, len(codes) + 1), language.RANKS, np.int16)
    ranks[0, np.searchsorted(codes, own[::-1])] = np.arange(len(own))
    ranks[1, np.searchsorted(codes, own)] = np.arange(len(own))
    model = language.Profiles(("aa", "bb"), codes, ranks)
    assert model.identify(b"abc abc xyz") == ("bb", 1.0)
    assert model.identify(b"qqq")[1] == 0.0
    assert model.identify(None) == model.identify(b"12 ..") == ("und", 0.0)


@needs_data
def test_language_held_out(spark):
    got = held_out(spark, "op10_language_profiles", 3, 1)
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.doc_id in got]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in rows]) > 0.97


def test_language_edges(spark):
    rows = [(1, "the house and the garden", "en"), (2, "das haus und der garten", "de"), (3, None, "xx"), (4, "...", "yy"), (None, "the garden", None), (2, "das haus und der garten", "de"), (6, "", "en")]
    frame = docs(spark, rows)
    model = language.fit_profiles(frame)
    assert model.languages == ("de", "en")
    got = {(r.doc_id, r.lang_pred) for r in language.identify_languages(frame, model).collect()}
    assert got == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (None, "en"), (6, "und")}
    kept = language.keep_languages(frame, model, 0.1)
    assert kept.columns == frame.columns and kept.count() == 4
    empty = language.fit_profiles(frame.limit(0))
    assert {r.lang_pred for r in language.identify_languages(frame, empty).collect()} == {"und"}
    assert language.identify_languages(frame.limit(0), model).collect() == []


# toxicity


def test_nearest_is_exact():
    rng = random.Random(3)
    rows = []
    for _ in range(700):
        counts = {rng.randrange(60): rng.randint(1, 9) for _ in range(rng.choice([0, 1, 3, 8]))}
        rows.append(toxicity.unit(counts, np.linspace(1, 4, 60)))
    rows += rows[:100]  # ties
    index = toxicity.Index(rows, 60)
    for _ in range(150):
        query = toxicity.unit({rng.randrange(60): rng.randint(1, 5) for _ in range(rng.choice([0, 1, 4, 9]))}, np.linspace(1, 4, 60))
        cosines = [(sum(query.get(t, 0) * w for t, w in sorted(row.items())), i) for i, row in enumerate(rows)]
        best = sorted((-round(c, 9), i) for c, i in cosines if c > 1e-12)[: toxicity.NEIGHBOURS]
        got = index.nearest(query, toxicity.NEIGHBOURS)
        assert [round(-c, 9) for c, _ in best] == [-round(c, 9) * -1 for _, c in got]
        sure = [i for c, i in best if -c > -best[-1][0] + 1e-9]
        assert set(sure) <= {i for i, _ in got}


def test_blocks_bound_their_examples():
    """Groups of alike rows in several languages: bounds hold, blocks are passed over, and the result is that of all pairs."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        language = i % 6
        own = np.unique(np.concatenate([np.arange(5), 10 + 300 * language + rng.zipf(1.3, 60) % 300]))
        weight = rng.random(len(own)) + 0.1
        rows.append((own.astype(np.int32), weight / np.sqrt((weight * weight).sum())))
    for i in range(60):  # near copies
        own, weight = rows[i][0], rows[i][1] * (1 + 0.01 * rng.random(len(rows[i][0])))
        rows.append((own, weight / np.sqrt((weight * weight).sum())))
    rows += [(np.zeros(0, np.int32), np.zeros(0)), *[rows[3]] * 40]
    full = np.zeros((len(rows), 2000))
    for i, (terms, weights) in enumerate(rows):
        full[i, terms] = weights
    index = toxicity.Index(rows, 2000)
    cosines = full @ full.T
    left_out = list(range(0, len(rows), 3))
    passed = 0
    for own in (None, left_out):
        for i, got in zip(left_out, index.nearest_of([index.row(i) for i in left_out], toxicity.NEIGHBOURS, own)):
            scores = cosines[i].copy()
            scores[i] *= own is None
            order = np.lexsort((np.arange(len(rows)), -np.round(scores, 12)))[: toxicity.NEIGHBOURS]
            assert [round(c, 9) for _, c in got] == [round(c, 9) for c in scores[order] if c > 0]
            assert all(e != i for e, _ in got) or own is None
            if not got:
                continue
            terms, weights = index.row(i)
            bounds = index.dense_most @ np.where(np.isin(np.arange(2000), terms), full[i], 0)[np.flatnonzero(index.column >= 0)]
            for t, w in zip(terms, weights):
                if index.column[t] < 0:
                    at = slice(index.at[t], index.at[t + 1])
                    bounds[index.entry_block[at]] += w * index.entry_most[at]
            for block in range(index.blocks):
                inside = index.examples[block * toxicity.BLOCK : (block + 1) * toxicity.BLOCK]
                assert bounds[block] >= cosines[i][inside].max() - 1e-5
            passed += (bounds < got[-1][1] - 1e-5).sum()
    assert passed > index.blocks * len(left_out) / 2


def test_lists_are_taken_once(monkeypatch):
    """One pass over the postings of a query's rare terms, and no other list of the length of these."""
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(600):
        own = np.unique(rng.zipf(1.2, 60) % 900).astype(np.int32)
        rows.append((own, np.full(len(own), len(own) ** -0.5)))
    index = toxicity.Index(rows, 900)
    index._prepare()
    lengths, taken = np.diff(index.posted_at), []
    joined = toxicity._joined
    monkeypatch.setattr(toxicity, "_joined", lambda array, *ranges: taken.append((array, joined(array, *ranges))) or taken[-1][1])
    for terms, weights in rows[:50]:
        taken.clear()
        near = next(index.nearest_of([(terms, weights)], toxicity.NEIGHBOURS))
        lists = [part for array, part in taken if array is not index.terms and array is not index.weights]
        assert len(lists) == 1 and len(lists[0]) == lengths[terms].sum()
        assert near[0][1] == pytest.approx(1.0)


def test_workers_map_the_index(spark, tmp_path):
    """A saved index answers as the one in memory does, from arrays that stay in files; workers are sent none of its rows."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(400):
        own = np.unique(rng.zipf(1.4, 40) % 500).astype(np.int32)
        weight = rng.random(len(own)) + 0.1
        rows.append((own, weight / np.sqrt((weight * weight).sum())))
    rows += [(np.zeros(0, np.int32), np.zeros(0)), *[rows[2]] * 30]
    index = toxicity.Index(rows, 500)
    index.save(str(tmp_path))
    mapped = toxicity.Index.mapped(str(tmp_path))
    wanted = list(index.nearest_of(rows, toxicity.NEIGHBOURS, list(range(len(rows)))))
    assert list(mapped.nearest_of(rows, toxicity.NEIGHBOURS, list(range(len(rows))))) == wanted
    frame = docs(spark, [(i, f"plain words {i}" if i % 4 else f"nastyword {i}", "en") for i in range(60)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    fitted = toxicity.fit_examples(frame, labels).examples.value
    assert fitted.index.size == 60
    for used in (mapped, fitted.index):
        assert all(isinstance(getattr(used, name).base, np.memmap) for name in ("terms", "weights", "posted", "posted_weights", "dense"))


def test_labelled_ids_are_bounded(spark):
    """As many rows as ids, however often an id is labelled and however many documents it has."""
    import pyspark.sql.functions as F

    from docweave.llm.common import labelled, one_text_each

    labels = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(1).alias("mark")).union(spark.range(3000).select(F.lit(7), F.lit(1))).repartition(20)
    got = [r.doc_id for r in labelled(labels, "mark", 1, 40).collect()]
    hashes = {r.doc_id: r.h for r in labels.distinct().select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    assert got == sorted(hashes, key=hashes.get)[:40]
    assert labelled(labels, "mark", 0, 40).collect() == [] and len(labelled(labels, "mark", 1, 4000).collect()) == 500
    texts = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.lit(1).alias("label"), (F.col("id") % 3).cast("string").alias("text"))
    texts = texts.union(spark.createDataFrame([(8, 1, None)], "doc_id long, label int, text string"))
    rows = {(r.doc_id, r.label): r.text for r in one_text_each(texts).collect()}
    assert set(rows) == {(7, 1), (8, 1)} and rows[7, 1] in "012" and rows[8, 1] is None


def test_isotonic():
    edges, values = toxicity.isotonic(np.array([0.0, 0.2, 0.2, 0.5, 0.9]), np.array([0, 1, 0, 0, 1.0]), np.ones(5))
    assert list(values) == sorted(values) and math.isclose(np.interp(0.9, edges, values), 1)
    assert math.isclose(np.interp(0.3, edges, values), 1 / 3)


@needs_data
def test_toxicity_held_out(spark):
    got = held_out(spark, "op2_toxicity_neighbours", 4, 2)
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in got]
    assert np.mean([got[r.doc_id].predicted == r.toxic for r in labels]) > 0.9


def test_toxicity_edges(spark):
    rows = [(i, "plain words stay plain", "en") for i in range(30)] + [(i, "you nastyword fellow", "en") for i in range(30, 40)]
    rows += [(None, "nastyword", None), (50, None, None), (51, "", None), (51, "nastyword again", None)]
    frame = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i >= 30), "x") for i in range(40)] + [(None, 1, "x"), (3, None, "x"), (4, 7, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit_examples(frame, labels)
    got = toxicity.score_toxicity(frame, model).collect()
    assert len(got) == len(rows)
    score = {r.doc_id: r.predicted for r in got if r.doc_id != 51}
    assert all(score[i] == int(i >= 30) for i in range(40)) and score[None] == 1 and score[50] == 0
    assert sorted(r.predicted for r in got if r.doc_id == 51) == [0, 1]
    assert all(r.evidence[0].cosine > 0.99 for r in got if r.doc_id and 30 <= r.doc_id < 40)
    assert toxicity.score_toxicity(frame.limit(0), model).collect() == []
    alone = toxicity.fit_examples(frame, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(frame, alone).collect()} == {0.0}


def test_toxicity_compares_all_terms(spark):
    """Cosines over every term of the examples, rare ones and those commoner under label 0 too, against all pairs."""
    rng = random.Random(9)
    pool = [f"{rng.choice('abcdefg')}word{i}" for i in range(400)] + ["the", "of", "and"] * 40
    rows = [(i, " ".join(rng.choices(pool, k=rng.choice([1, 20, 90]))), "en") for i in range(150)]
    rows += [(200 + i, rows[0][1], "en") for i in range(20)]
    frame = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, *_ in rows if i % 3], "doc_id long, toxic int")
    vectors, frequency = {}, {}
    for i, text, _ in rows:
        own = {}
        for word in text.split():
            for term in [word, *(word[:n] + "*" for n in toxicity.PREFIXES if len(word) > n)]:
                own[term] = own.get(term, 0) + 1
        vectors[i] = own
        for term in own:
            frequency[term] = frequency.get(term, 0) + 1
    known = {t for i in vectors if i % 3 for t in vectors[i]}
    for i, own in vectors.items():
        own = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + frequency[t])) + 1) for t, n in own.items() if t in known}
        norm = math.sqrt(sum(w * w for w in own.values()))
        vectors[i] = {t: w / norm for t, w in own.items()}
    got = toxicity.score_toxicity(frame, toxicity.fit_examples(frame, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        cosines = sorted((-round(sum(w * vectors[i].get(t, 0) for t, w in vectors[r.doc_id].items()), 9), i) for i in vectors if i % 3)
        want = [c for c, _ in cosines if c < 0][: toxicity.NEIGHBOURS]
        assert [-round(e.cosine, 9) for e in r.evidence] == pytest.approx(want, abs=2e-9)
        assert {i for c, i in cosines if c < want[-1] - 1e-8} <= {e.example for e in r.evidence}
