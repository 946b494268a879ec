"""Quality rules, decontamination, mixing, token output, chat, model, pages and surrogates on small fixtures."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, html_text, mixing, quality_model, quality_rules, surrogates, templates, token_output

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, words string"
WORD = "[^\x20\x09-\x0D]+"


def documents(spark, texts, lang="en", source="s"):
    rows = [(d, t, lang, source, len(t or ""), "x", "y") for d, t in texts]
    return spark.createDataFrame(rows, DOC)


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "null id here"), (5, "a b c d e " * 400), (5, "a b c d e " * 400),
         (6, "same line\nsame line\n\nsame line \nother"), (7, "Grüße | *** 100% <b> #x y z"), (8, "w1 w2 w3 w4 w5 w6 " * 2),
         (9, " ".join(f"u{i}" for i in range(30000)))]


# Quality rules


def brute_statistics(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(re.findall("[A-Z]", text)))


def test_word_statistics_match_brute_force(spark):
    rng = random.Random(4)
    texts = EDGES + [(100 + k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for k in range(40)]
    docs = documents(spark, texts)
    out = quality_rules.statistics(docs)
    assert out.columns == [*docs.columns, *quality_rules.STATISTICS]
    got = sorted(((r.doc_id, r.text) + tuple(r[c] for c in quality_rules.STATISTICS) for r in out.collect()), key=repr)
    assert got == sorted(((d, t, *brute_statistics(t)) for d, t in texts), key=repr)


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 200, 0.05), (9, 1000, 0.01), (40, 5000, 0.01), (2000, 1000000, 0.0021), (7, 50, 0.1)])
def test_binomial_tail_is_exact(spark, k, n, p):
    from fractions import Fraction

    got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    if k > n * p:
        assert got == 1
        return
    if n <= 5000:
        q = Fraction(p)
        exact = float(sum(math.comb(n, i) * q ** i * (1 - q) ** (n - i) for i in range(k + 1)))
    else:
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
                    for i in range(k + 1))
    assert got == pytest.approx(exact, rel=1e-7)


def labelled(spark, n, seed=1):
    rng = random.Random(seed)
    texts, labels = [], []
    for doc in range(n):
        poor = rng.random() < 0.2
        words = [f"w{rng.randint(0, 10**6)}" + ("###" if poor and rng.random() < 0.9 else "") for _ in range(30)]
        texts.append((doc, " ".join(words)))
        labels.append((doc, 0 if poor else 1))
    return documents(spark, texts), spark.createDataFrame([*labels, (0, None), (10**6, 1)], "doc_id long, quality int"), dict(labels)


def test_cutoffs_keep_the_risk_and_catch_the_poor(spark):
    docs, labels, truth = labelled(spark, 1500)
    judged = quality_rules.judge(docs, labels, risk=0.05, delta=0.1)
    assert [c for c in judged.columns if c in docs.columns] == [c for c in docs.columns if c not in ("kept",)] + ["kept"]
    kept = {r.doc_id: r.kept for r in judged.collect()}
    good = [d for d, q in truth.items() if q]
    poor = [d for d, q in truth.items() if not q]
    assert sum(not kept[d] for d in good) <= 0.05 * len(good)
    assert sum(not kept[d] for d in poor) >= 0.95 * len(poor)


def test_judging_matches_sql_with_cutoffs_in_use(spark):
    duckdb = pytest.importorskip("duckdb")
    docs, labels, _ = labelled(spark, 1200, seed=8)
    connection = duckdb.connect()
    connection.register("documents", docs.toPandas())
    connection.register("labels", labels.toPandas())
    want = connection.execute(quality_rules.oracle(risk=0.05)).fetchall()
    got = quality_rules.judge(docs, labels, risk=0.05, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(not row[-2] and not row[-1] for row in want)


def test_without_labels_only_the_base_rules_speak(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    judged = quality_rules.judge(documents(spark, EDGES), labels).collect()
    assert len(judged) == len(EDGES) and all(r.kept != r.base_failed for r in judged)
    assert quality_rules.judge(documents(spark, []), labels).collect() == []


# Decontamination


def brute_hits(docs, items, window=10):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(text):
        return word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    asked = {}
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            asked.setdefault(tuple(own[i:i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        own, hit, names = words(text), set(), set()
        for phrase, owners in asked.items():
            for i in range(len(own) - len(phrase) + 1):
                if tuple(own[i:i + len(phrase)]) == phrase:
                    hit.update(range(i, i + len(phrase)))
                    names |= owners
        out.append((doc, len(own), len(hit), sorted(names)))
    return sorted(out, key=repr)


def benchmark_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(25)] + ["É", "Éa", "ß9"]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(k, ", ".join(prose(rng.randint(1, 25)))) for k in range(12)] + [(50, None), (51, "..."), (52, "t1"), (3, "t2 t3")]
    docs = list(EDGES)
    for k in range(40):
        own = prose(rng.randint(0, 60))
        if rng.random() < 0.6:
            own += (rng.choice(items)[1] or "").upper().split(", ") + prose(3)
        docs.append((200 + k, rng.choice([" ", "-", "\n"]).join(own)))
    return docs, items


@pytest.mark.parametrize("shard_bytes,slices", [(4_000_000, 200_000), (300, 7)])
def test_phrases_match_brute_force(spark, shard_bytes, slices):
    docs, items = benchmark_rows()
    frame, asked = documents(spark, docs), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    index = decontaminate.build_index(frame, shard_bytes=shard_bytes)
    found = decontaminate.search(index, decontaminate.phrases(asked), slice_phrases=slices)
    assert sorted(((r.id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect()), key=repr) == brute_hits(docs, items)


def test_items_of_a_shared_instruction_stay_out_of_the_slices(spark):
    shared = " ".join(f"s{k}" for k in range(50))
    items = spark.createDataFrame([(k, f"{shared} own{k} " + " ".join(f"q{k}x{j}" for j in range(12))) for k in range(3000)], "item_id long, text string")
    asked = decontaminate.phrases(items)
    table, listed = decontaminate._phrase_table(asked)
    slices = list(decontaminate._phrase_slices(table, 10_000))
    n = table.count()
    assert len(slices) == -(-n // 10_000) and sum(len(classes) for _, _, classes in slices) == n == asked.select("terms").distinct().count()
    assert all(x.dtype != object for parts in slices for x in parts)
    assert listed.groupBy("class").count().where("count = 3000").count() == 1 and listed.count() == 3000 + 3000
    docs = documents(spark, [(1, shared), (2, "q7x0 " + shared), (3, shared + " own7 " + " ".join(f"q7x{j}" for j in range(12))), (4, "none")])
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"])) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: (50, 50, 3000), 2: (51, 50, 3000), 3: (63, 63, 3000), 4: (1, 0, 0)}


def test_proximity_needs_all_terms_nearby_in_one_document(spark):
    docs = documents(spark, [(1, "x alpha y y beta z gamma"), (2, "gamma beta alpha"), (3, "alpha " + "n " * 50 + "beta gamma"), (4, "alpha beta"), (5, "gamma")])
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    found = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(docs, items, within=6).collect()}
    assert found == {1: 6, 2: 3, 3: 0, 4: 0, 5: 0}


def brute_near(docs, items, window, within):
    split = [(d, re.findall("[0-9A-Za-z]+", t)) for d, t in docs]
    total = Counter(w for _, own in split for w in own)
    asked = [(str(i), own[k:k + window]) for i, t in items for own in [t.split()] for k in range(max(len(own) - window + 1, 1))]
    out = []
    for d, own in split:
        hit, names = set(), set()
        for item, phrase in asked:
            rarest = min(phrase, key=lambda w: total[w])
            for at in [k for k, w in enumerate(own) if w == rarest]:
                places = [min((k for k, w in enumerate(own) if w == term), key=lambda k: (abs(k - at), k < at), default=None) for term in phrase]
                if all(k is not None and abs(k - at) <= within for k in places):
                    hit |= set(range(min(places), max(places) + 1))
                    names.add(item)
        out.append((d, len(own), len(hit), sorted(names)))
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [4_000_000, 200, 1])
def test_proximity_matches_brute_force_however_shards_are_cut(spark, shard_bytes):
    rng = random.Random(8)
    words = ["alpha", "beta", *(f"t{k}" for k in range(14))]
    docs = [(1, "t1 t2 alpha"), (2, "beta x x x x alpha"), (3, "alpha"), (4, "x beta"), (5, "alpha x x alpha")]
    docs += [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(10, 50)]
    items = [(1, "alpha beta"), (2, "t1 t2 t3 t4"), (3, "t5 t5 t6"), (4, "t7 absent")]
    index = decontaminate.build_index(documents(spark, docs).coalesce(1), shard_bytes=shard_bytes)
    asked = decontaminate.phrases(spark.createDataFrame(items, "item_id long, text string"), window=3)
    got = sorted((r.id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.search(index, asked, within=6).collect())
    assert got == brute_near(docs, items, 3, 6)


def test_empty_benchmark_and_empty_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, EDGES)
    assert all(r.n_hit == 0 and r["items"] == [] for r in decontaminate.decontaminate(docs, none).collect())
    assert decontaminate.decontaminate(documents(spark, []), none).collect() == []


# Mixing


def test_rates_bring_sources_to_their_weights(spark):
    rows = [(i, "x" * 100, "en", "big" if i < 1800 else "small", 100, "", "") for i in range(2000)]
    docs = spark.createDataFrame(rows, DOC)
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), ("absent", 5.0)], "source string, weight double")
    assert {r.source: round(r.rate, 9) for r in mixing.rates(docs, weights).collect()} == {"big": round(2000 / 2 / 1800, 9), "small": 5.0}
    out = mixing.mix(docs, weights)
    assert out.columns == [*docs.columns, "copy", "mix_key"]
    rows = out.collect()
    share = sum(r.source == "big" for r in rows) / len(rows)
    assert 0.45 < share < 0.55 and 1850 < len(rows) < 2150
    assert [r.mix_key for r in rows] == sorted(r.mix_key for r in rows)
    counts = Counter(r.doc_id for r in rows)
    small = [counts[i] for i in range(1800, 2000)]
    assert 4.5 < np.mean(small) < 5.5 and 3.5 < np.var(small) < 6.8  # Poisson: variance as large as the mean
    assert sorted((r.doc_id, r.copy) for r in mixing.mix(docs, weights).collect()) == sorted((r.doc_id, r.copy) for r in rows)


def test_large_rates_and_odd_rows_in_the_mix(spark):
    rows = [(1, "abc", "en", "tiny", 3, "", ""), (2, None, "en", None, 0, "", ""), (None, "x" * 3000, "en", "large", 0, "", ""), (4, "", None, "blank", 0, "", "")]
    out = Counter(r.source for r in mixing.mix(spark.createDataFrame(rows, DOC), epochs=3.0, weights=spark.createDataFrame(
        [("tiny", 9.0), ("large", 1.0)], "source string, weight double")).collect())
    assert 2200 < out["tiny"] < 3200  # 3 * 3003 * 0.9 / 3 = 2703
    assert mixing.mix(documents(spark, [])).collect() == []


def test_mix_matches_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 50), "en", rng.choice(["a", "a", "a", "b", None]), 1, "", "") for i in range(300)]
    docs = spark.createDataFrame(rows, DOC)
    connection = duckdb.connect()
    connection.register("documents", docs.toPandas())
    want = connection.execute(f"SELECT doc_id, copy, mix_key FROM ({mixing.ORACLE})").fetchall()
    assert sorted(map(tuple, mixing.mix(docs).select("doc_id", "copy", "mix_key").collect())) == sorted(want)


# Token output


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=200))
def test_pack_round_trip(ids):
    assert token_output.unpack(token_output.pack(np.array(ids, np.uint64))).tolist() == ids


def test_packing_is_dense():
    assert len(token_output.pack(np.zeros(6000, np.uint64))) == 12 + 8 * 100
    assert len(token_output.pack(np.full(4000, 30000, np.uint64))) == 12 + 8 * 1000


def vocabulary():
    pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    return token_output.default_tokenizer()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab ,.'\n\t  é9Z¼<|>", "<|endoftext|>", "'s", "  "]), max_size=25).map("".join), max_size=6))
def test_encoder_equals_the_whole_text(texts):
    encoder = _encoder()
    whole = [np.array(e.ids, np.uint32).tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == whole


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(categories=("L",)), min_size=1, max_size=8), min_size=1, max_size=5))
def test_letters_of_all_scripts_go_to_the_model(words):
    encoder = _encoder()
    assert encoder.letters is not None
    text = " ".join(words)
    assert encoder.encode([text]) == [np.array(encoder.tokenizer.encode(text).ids, np.uint32).tobytes()]


def test_words_with_stops_are_not_remembered_beside_the_bare_word():
    encoder = token_output.Encoder(vocabulary(), known=50)
    words = ["".join(chr(97 + d) for d in divmod(k, 20)) for k in range(400)]
    texts = [" ".join(f"start {w} {w}. {w}, 7{w}." for w in words[k:k + 20]) for k in range(0, 400, 20)]
    for text in texts:
        assert encoder.encode([text]) == [np.array(encoder.tokenizer.encode(text).ids, np.uint32).tobytes()]
        held = [*encoder.known.young, *encoder.known.old]
        assert not [w for w in held if w[-1:] in ".," and w[-2:-1].isalpha()]
        assert len(held) <= 2 * 50 + 2 * 20 + 1


_made = {}


def _encoder():
    return _made.setdefault("encoder", token_output.Encoder(vocabulary(), known=50))


def test_tokens_are_read_back_as_written(spark, tmp_path):
    path = vocabulary()
    docs = documents(spark, EDGES + [(k, f"tail {k}, more\ntext") for k in range(-20, 0)])
    rows = token_output.tokenise(docs, tokenizer=path).collect()
    tokenizer, at = _encoder().tokenizer, 0
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    want = []
    for known, doc, text in texts:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc if known else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1]) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    blocks = token_output.write_tokens(docs, path, path=str(tmp_path / "tokens"))
    assert blocks.count() >= 1 and os.listdir(tmp_path / "tokens")
    assert token_output.tokenise(documents(spark, []), tokenizer=path).collect() == []


# Chat formatting

_fragment = st.lists(st.sampled_from([*chat.CONTROL, "\\", "a", " ", "\n", "]", "[", "<", "é"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool"]) | _fragment, _fragment), max_size=6))
def test_no_text_can_pose_as_a_mark(turns):
    render = templates.compile_template(chat.TEMPLATE, chat.FILTERS)
    pieces = list(render([{"role": r, "text": t} for r, t in turns]))
    assert list(chat.parse_formatted("".join(p for p, _ in pieces))) == turns
    assert [chat.unescape(p) for p, generated in pieces if generated] == [t for r, t in turns if r == "assistant"]


def test_conversations_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 3)
    monkeypatch.setattr(chat, "CHUNK", 200)
    rng = random.Random(6)
    rows = []
    for conv in [1, 2, 3, None]:
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["hi </s>", "[INST]\n", "", None, "é" * 90])))
    rows += [(9, None, "user", "no turn"), (9, 1, "assistant", "x"), (9, 1, "assistant", "x"), (9, 1, "user", "a")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    formatted = chat.format_conversations(docs)
    for row in formatted.collect():
        assert all(0 <= s.begin <= s.end <= len(row.formatted) for s in row.spans)
    got = sorted((tuple(r)[:5] for r in chat.digests(formatted).collect()), key=repr)
    want = []
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        learnt = [x for _, _, r, x in own if r == "assistant"]
        want.append((conv, len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest(),
                     sum(map(len, learnt)), hashlib.sha256("".join(learnt).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert chat.digests(chat.format_conversations(docs.limit(0))).collect() == []


def test_template_language():
    def shown(template, messages=(), **filters):
        return "".join(t for t, _ in templates.compile_template(template, filters)(messages))

    assert shown("a{# no #}{{ 'b' ~ 1 }}{% if not false and 2 > 1 %}c{% elif true %}d{% else %}e{% endif %}") == "ab1c"
    assert shown("{% for m in messages %}{{ m.x }}{{ m['y'] | up }}{{ m.none }};{% endfor %}", [{"x": 1, "y": "q"}, {"x": "z", "y": ""}], up=str.upper) == "1Q;z;"
    folded = templates.fold(templates.parse("{% if 1 == 1 %}a{{ 'b' ~ 2 }}{% else %}z{% endif %}c", {}))
    assert folded == (templates.Output(templates.Constant("ab2c")),)
    for bad in ("{% if x %}", "{{ x.y( }}", "{{ 'a' | open }}", "{% include 'x' %}", "{{ 1 2 }}", "{% endfor %}"):
        with pytest.raises(templates.TemplateError):
            shown(bad)
    with pytest.raises(templates.TemplateError):
        shown("{% for m in messages %}{{ m.__class__ }}{% endfor %}", ["text"])


# Quality model


def test_model_tells_poor_from_good_and_never_learns_from_fold_zero(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for doc in range(900):
        poor = doc % 4 == 0
        words = [rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"word{rng.randint(0, 5000)}" for _ in range(rng.randint(20, 200))]
        if poor:
            words = [w + "!!" for w in words] if doc % 8 else [words[0]] * len(words)
        texts.append((doc, " ".join(words) + "."))
        labels.append((doc, 0 if poor else 1))
    texts += EDGES[:5]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in quality_model.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(rows) == len({d for d, _ in texts})
    held = [(d, q) for d, q in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(rows[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _ in labels)
    assert sum(rows[d].predicted == q for d, q in held if d > 10) >= 0.97 * len([d for d, _ in held if d > 10])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q) for d, q in labels]
    again = {r.doc_id: r.score for r in quality_model.score_documents(docs, spark.createDataFrame(flipped, "doc_id long, quality int")).collect()}
    assert all(again[d] == pytest.approx(rows[d].score, abs=1e-9) for d in again)


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(2, 1), (5, 1)], 1.0), ([(2, 0), (5, 0)], 0.0), ([(2, None)], 0.5)])
def test_model_without_two_kinds_of_labels(spark, labels, score):
    got = quality_model.score_documents(documents(spark, EDGES), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(EDGES) and {r.score for r in got} == {score}
    assert quality_model.score_documents(documents(spark, []), spark.createDataFrame(labels, "doc_id long, quality int")).collect() == []


# Pages

LONG = "A sentence of the story, with commas, that goes on for a while so that it earns some points. "


@pytest.mark.parametrize("html,text", [
    ("", ""), ("<p>", ""), ("plain &amp; simple", "plain & simple"), ("<!-- <p>x</p> --><p>y", "y"),
    (f"<nav><a href=x>Home</a></nav><article><h1>T&eacute;</h1><p>{LONG}<b>bold<br>next<p>two  \n three</article><footer>f</footer>", f"Té\n{LONG}bold next\ntwo three"),
    (f"<div class=sidebar><p>{LONG}</div><div id=content><p>{LONG}</p><p>{LONG}</p></div><div class='comments'><p>{LONG * 9}</p></div>", f"{LONG.strip()}\n{LONG.strip()}"),
    (f"<script>var a='</p><p>';</script><style>p{{}}</style><main><p>{LONG}</p><form><p>{LONG}</p></form><ul><li>one</li><li>two</ul></main>", f"{LONG.strip()}\none\ntwo"),
    (f"<body><header><p>{LONG}</p></header><div><div><p>{LONG}</p><p>{LONG}</p></div><div role=dialog><p>{LONG}</p></div></div></body>", f"{LONG.strip()}\n{LONG.strip()}"),
    ("<p>cut off <a hre", "cut off"), ("<p>1 < 2 &lt; 3</p>", "1 < 2 < 3"), ("<p title='a>b'>q</p>", "q"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
])
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_pages_with_nulls_repeats_and_deep_nesting(spark):
    deep = "<div>" * 3000 + LONG + "</div>" * 3000
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>x</p>", 2), (2, "u", deep, 3), (3, "u", "<p>" + "word " * 100000, 4)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [r.text for r in got] == ["", "", "x", LONG.strip(), ("word " * 100000).strip()]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


PROSE = "One long sentence, with a comma or two, and enough words that nobody takes it for a menu, is said here."
BODY = "".join(f"<p>{PROSE} {k}</p>" for k in range(6))
LEAD = "The lead, which stands before the body, is a paragraph of its own, with commas, and it is long enough to be read."


@pytest.mark.parametrize("page", [
    "<main><h1>T</h1><p>{lead}</p><div class=content>{body}</div></main>",
    "<main><h1>T</h1><p>{lead}</p><div><div class=content>{body}</div></div></main>",
    "<div class='post'><hgroup><h1>T</h1></hgroup><section><p>{lead}</p></section><div class=content>{body}</div></div>",
    "<main><h1>T</h1><blockquote>{lead}</blockquote><div class=content>{body}</div><h2>More</h2><ul><li><a href=a>one</a></li><li><a href=b>two</a></li><li><a href=c>three</a></li></ul></main>",
    "<main><h1>T</h1><table><tr><td>{lead}</td></tr></table><div class=content>{body}</div><p><a href=x>All of this text is one long link to another page, which nobody wants to read in here.</a></p></main>",
])
def test_headline_and_paragraphs_beside_the_article_are_kept(page):
    html = "<html><body><nav><a href=/>Home</a></nav>" + page.format(lead=LEAD, body=BODY) + "<footer>Copyright</footer></body></html>"
    assert html_text.main_text(html).split("\n") == ["T", LEAD, *[f"{PROSE} {k}" for k in range(6)]]


def test_a_quoted_attribute_may_be_long_and_hold_anything():
    for value in ("x > y " * 5000, "it's > " * 3000):
        assert html_text.main_text(f'<div><p data-x="{value}">{LONG}</p></div>') == LONG.strip()
    assert html_text.main_text(f"<div><p don't>{LONG}</p><p title=\"open>{LONG}</p></div>") == LONG.strip() + "\n" + LONG.strip()


def test_tags_that_never_end_outside_of_quotes_take_linear_time():
    import time

    start = time.process_time()
    html_text.main_text("<b x='>' " * 100_000)
    assert time.process_time() - start < 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "<a href='x'>", "</a>", "<!--", "-->", "<script>", "</script>", "<", ">", "text, ", "&amp", "<ul><li>", "<td>", "\"", "'"]), max_size=40).map("".join))
def test_broken_markup_never_fails(html):
    assert "\n\n" not in html_text.main_text(html)


# Surrogates


def test_entities_keep_type_format_and_coreference(spark):
    said = ("Mr. John Smith wrote j.doe@mail.com and J.DOE@MAIL.COM from 8.8.4.4; card 4111 1111 1111 1111, call +1 (663) 555-6869 "
            "or +16635556869. token = \"87e15d78b9d8ef29b6c10061e3551a60fa07e990\". Later Mr. Smith and Frau Anna Weber came. IBAN DE89 3704 0044 0532 0130 00")
    new, listed = surrogates.rewrite(said, b"k", {})
    kinds = Counter(x["kind"] for x in listed)
    assert kinds == {"given-m": 1, "family-m": 2, "email": 2, "ip": 1, "card": 1, "phone": 2, "secret": 1, "given-f": 1, "family-f": 1, "iban": 1}
    at = {}
    for x in listed:
        at.setdefault(x["kind"], []).append(new[x["begin"]:x["end"]])
    assert at["family-m"][0] == at["family-m"][1] != "Smith"
    assert at["email"][0] == at["email"][1].lower() and at["email"][1].isupper()
    assert re.sub(r"\D", "", at["phone"][0]) == re.sub(r"\D", "", at["phone"][1]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", at["phone"][0])
    assert surrogates._luhn(re.sub(" ", "", at["card"][0])) == 0 and re.fullmatch(r"4\d{3}( \d{4}){3}", at["card"][0])
    assert surrogates._iban_rest(at["iban"][0].replace(" ", "")) == 1
    assert at["given-m"][0] in surrogates._GIVEN["latin", "m"] and at["given-f"][0] in surrogates._GIVEN["latin", "f"]
    assert [e.kind for e in surrogates.detect(new)] == [e.kind for e in surrogates.detect(said)]
    assert surrogates.rewrite("nothing here, 12 of 3.5 or 2024-01-02", b"k", {}) == ("nothing here, 12 of 3.5 or 2024-01-02", [])


def test_clashing_replacements_draw_again(spark):
    def narrow(key, kind, normal, attempt=0):
        return f"10.0.0.{zlib.crc32(f'{kind}{normal}{attempt}'.encode()) % 150}"

    entities = spark.createDataFrame([("ip", f"10.0.0.{k}") for k in range(60)] + [("email", f"u{k}@x.org") for k in range(30)], "kind string, normal string")
    late = {(r.kind, r.normal): r.attempt for r in surrogates.settled_attempts(entities, b"k", chooser=narrow).collect()}
    drawn = {kind: [narrow(b"k", r.kind, r.normal, late.get((r.kind, r.normal), 0)) for r in entities.collect() if r.kind == kind] for kind in ("ip", "email")}
    assert late and all(len(set(d)) == len(d) for d in drawn.values())
    assert not set(drawn["ip"]) & {f"10.0.0.{k}" for k in range(60)}


def test_replacements_stay_distinct_over_documents(spark):
    texts = EDGES[:7] + [(k, f"mail user{k}@site.org or 10.0.0.{k}") for k in range(10, 60)]
    out = surrogates.replace_entities(documents(spark, texts)).collect()
    assert len(out) == len(texts)
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].text == "" and by_id[4].text == "one"
    originals = {w for _, t in texts[7:] for w in t.split()[1::2]}
    found = [w for k in range(10, 60) for w in by_id[k].text.split()[1::2]]
    assert len(set(found)) == len(found) == 100 and not originals & set(found)
    assert surrogates.replace_entities(documents(spark, [])).collect() == []


def test_thousands_of_given_names_and_masked_secrets_get_replacements_of_their_own(spark):
    firsts = {"latin": "bdfghjklmnprstvz", "cyrillic": "бвгджзклмнпрстфх", "greek": "βγδζθκλμνξπρστφχ"}
    names = {script: [a + b + c for a in x for b in x for c in x][:3000] for script, x in firsts.items()}
    entities = [(f"given-{gender}", n) for gender in "mf" for own in names.values() for n in own]
    entities += [("given-m", "adam"), ("given-m", "adam-adam")] + [("secret", "*" * 8 + str(k)) for k in range(10)]
    table = spark.createDataFrame(entities, "kind string, normal string").repartition(4)
    late = {(r.kind, r.normal): r.attempt for r in surrogates.settled_attempts(table, b"k", rounds=30).collect()}
    drawn = [(kind, surrogates.draw(b"k", kind, n, late.get((kind, n), 0))) for kind, n in entities]
    assert len(set(drawn)) == len(entities) and not set(drawn) & set(entities)
    assert all(surrogates._script(new) == surrogates._script(n) for (kind, n), (_, new) in zip(entities, drawn) if kind != "secret")
    said = "password: ********1 and password: ********2"
    texts = [(k, f"password: ********{k}") for k in range(10)] + [(10, said)]
    out = {r.doc_id: r.text for r in surrogates.replace_entities(documents(spark, texts)).collect()}
    assert len(set(out.values())) == 11 and not set(out.values()) & {t for _, t in texts}
    assert out[10] == f"{out[1]} and {out[2]}"


# Long texts in linear time


def seconds(function):
    import time

    started = time.process_time()
    function()
    return time.process_time() - started


def test_long_runs_and_many_addresses_are_read_once():
    base64 = "Gz3" * 350_000
    assert [(e.kind, e.normal) for e in surrogates.detect(f"{base64} jo@mail.example.org {base64}")] == [("email", "jo@mail.example.org")]
    assert seconds(lambda: surrogates.detect(f"{base64}@{base64} me@x.org")) < 5
    many = " ".join(f"user{k}@mail{k}.org" for k in range(200_000))
    found = []
    assert seconds(lambda: found.extend(surrogates.detect(many))) < 20
    assert len(found) == 200_000


@given(st.text("ab.-@_1", max_size=40))
@settings(max_examples=300, deadline=None)
def test_addresses_match_the_plain_pattern(text):
    plain = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
    assert list(surrogates._addresses(text)) == [m.span() for m in plain.finditer(text)]


def test_stray_tags_are_read_once():
    n = 100_000
    for page in ("<span>" * n + "</x>" * n, "<div><i>" + "<b>" * n + "</i>" * n, "<span>" * n + "<div></div>" * n, "<u><div>" + "<i>" * n + "</u>" * n,
                 "<li>" * n + "</p>" * n):
        assert seconds(lambda: html_text.main_text(f"<article><p>kept words, more of them</p>{page}</article>")) < 20
