"""Bottom-k near-duplicates, periodic runs and conversation repair against brute force on small fixtures."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bottomk, periodic, repair

WORD = "[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, node string, kept string, runs string"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA)


# Bottom-k sketches


def brute_set(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(words, words[1:])) or frozenset(map(tuple, [words] if words else []))


def brute_near(rows):
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    found = [least.get(find(k)) if s else doc for k, ((doc, _), s) in enumerate(zip(rows, sets))]
    return sorted(((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, found)), key=repr)


def near_texts(seed, groups, sizes):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice(sizes))]
        for _ in range(rng.randint(1, 6)):
            rate = rng.choice([0.01, 0.05, 0.1])
            rows.append((len(rows), " ".join(w if rng.random() > rate else f"x{rng.random()}" for w in words)))
    return rows


EDGES = [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "One"), (5004, "oNE "), (5005, "É e"), (5006, "é e")]


@pytest.mark.parametrize("sizes", [[1, 2, 3, 4, 5, 6, 7, 8, 12, 20], [60, 64, 66, 70, 80, 90], [100, 300, 900]])
def test_near_duplicates_match_brute_force(spark, sizes):
    rows = near_texts(sum(sizes), 40, sizes) + EDGES
    rows += [(None, rows[0][1]), rows[3], rows[3], (6000, rows[5][1].upper()), (None, "alone " * 3), (None, None)]
    got = sorted((tuple(r) for r in bottomk.near_duplicates(documents(spark, rows).repartition(5)).collect()), key=repr)
    expected = [(d, n, c, True if d is None and c is None else kept) for d, n, c, kept in brute_near(rows)]
    assert got == sorted(expected, key=repr)


def test_crowded_lists_are_met_in_cells(spark, monkeypatch):
    """One template with fillings: a few hundred texts share lists without being one class."""
    monkeypatch.setattr(bottomk, "BLOCK", 16)
    rng = random.Random(8)
    template = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(200):
        filling = [f"f{rng.randint(0, 10**6)}" for _ in range(rng.choice([6, 12, 40]))]
        rows.append((k, " ".join(template + filling)))
        if rng.random() < 0.5:
            rows.append((1000 + k, " ".join(template + filling[:-1] + ["other"])))
    got = sorted((tuple(r) for r in bottomk.near_duplicates(documents(spark, rows)).collect()), key=repr)
    assert got == brute_near(rows)


def test_similar_sets_share_a_run_of_three():
    rng = np.random.default_rng(3)
    for union in [5, 6, 7, 9, 10, 14, 15, 20, 40, 64, 80]:
        for _ in range(400):
            cut = rng.choice(union, rng.integers(1, union // 5 + 1), replace=False)
            sides = rng.random(len(cut)) < 0.5
            a, b = (np.setdiff1d(np.arange(union), cut[s])[:bottomk.K] for s in (sides, ~sides))
            width = 2 if union == 5 else 3
            listed = [set(zip(*(x[k:len(x) - width + 1 + k] for k in range(width)))) for x in (a, b)]
            assert len(a) == len(b) == union or listed[0] & listed[1]


def test_near_duplicates_of_nothing(spark):
    empty = documents(spark, [])
    assert bottomk.near_duplicates(empty).collect() == []
    assert [tuple(r) for r in bottomk.near_duplicates(documents(spark, [(1, None), (None, " ")])).orderBy("doc_id").collect()] == [
        (None, 0, None, True), (1, 0, 1, True)]


# Periodic runs


def brute_runs(words, least, periods):
    n, found = len(words), set()
    for q in range(1, n // periods + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            part = words[at:at + length]
            if length >= max(least, periods * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.add((at, length, q))
            at = end + 1
    return found


words_strategy = st.one_of(
    st.lists(st.integers(1, 3), min_size=1, max_size=50),
    st.tuples(st.lists(st.integers(1, 2), max_size=8), st.lists(st.integers(1, 3), min_size=1, max_size=7), st.integers(1, 9),
              st.lists(st.integers(1, 3), max_size=8)).map(lambda x: x[0] + x[1] * x[2] + x[3]))


@settings(max_examples=400, deadline=None)
@given(words_strategy)
def test_tree_runs_match_brute_force(sequence):
    assert periodic.tree_runs(sequence, 2, 2) == brute_runs(sequence, 2, 2)
    assert set(periodic.word_runs([b"%d" % x for x in sequence])) == brute_runs(sequence, 6, 4)


def test_common_prefixes_over_many_blocks():
    rng = np.random.default_rng(1)
    sequence = rng.integers(1, 3, 3000).tolist()
    tree = periodic.SuffixTree(sequence)
    left, right = rng.integers(0, 3000, 2000), rng.integers(0, 3000, 2000)
    left, right = left[left != right], right[left != right]

    def common(i, j):
        size = 0
        while max(i, j) + size < 3000 and sequence[i + size] == sequence[j + size]:
            size += 1
        return size

    assert tree.agree(left, right).tolist() == [common(i, j) for i, j in zip(left.tolist(), right.tolist())]
    assert tree.ranks().tolist() == np.argsort(sorted(range(3001), key=lambda i: sequence[i:])).tolist()


def brute_tail(doc, text):
    words = re.findall(WORD, text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def brute_digest(doc, words):
    runs = sorted(brute_runs(words, 6, 4), key=lambda r: (r[0], r[2]))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    named = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *named, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_digests_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("ab\x1cé") for _ in range(rng.randint(0, 90)))) for k in range(150)]
    rows += [(k, " ".join(rng.choice(["the", "of", f"w{rng.random()}"]) for _ in range(300))) for k in range(150, 260)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "x " * 5), (904, "x " * 6), (905, "a b\n" * 4), (None, "q r s " * 9),
             (906, "a a a a a a b " * 4), rows[7], rows[7]]
    found = periodic.digests(periodic.periodic_runs(periodic.plant_tails(documents(spark, rows))))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted((brute_digest(d, brute_tail(d, t)) for d, t in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 15


def test_long_text_and_no_texts(spark):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(15000)] * 4 + ["end"] + ["again"] * 50000
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = periodic.periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(0, 60000, 15000), (60001, 50000, 1)]
    assert row.n_words == len(words) and row.collapsed.split() == words[:15000] + ["end", "again"]
    assert periodic.digests(periodic.periodic_runs(documents(spark, []))).collect() == []


# Conversation repair


def brute_repair(rows):
    """All edit sequences of a few rows: (cost, audit, repaired lines)."""
    found = []
    for edits in itertools.product("KuaD", repeat=len(rows)):
        if any(e != "D" and fault in (1, 2) for e, (_, _, fault) in zip(edits, rows)):
            continue
        if any(e == "K" and role[:1] not in ("s", "u", "a") for e, (role, _, _) in zip(edits, rows)):
            continue
        cost = sum({"K": 0, "D": 4}.get(e, 3) + (3 if fault == 3 and e != "D" else 0) for e, (_, _, fault) in zip(edits, rows))
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            if len(rows) > 3 and sum(map(len, gaps)) > 3:
                continue
            steps = []
            for gap, e, row in itertools.zip_longest(gaps, edits, rows):
                steps += [("I", {"u": "user", "a": "assistant"}[g], "") for g in gap]
                if e is not None:
                    steps.append(("D" if e == "D" else "K" if e == "K" else "R", {"u": "user", "a": "assistant"}.get(e, row[0]), row[1]))
            lines = [(role, text) for letter, role, text in steps if letter != "D"]
            if re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in lines)):
                # A deletion commutes with an insertion beside it, so audits list both orders.
                found.append((cost + 3 * sum(map(len, gaps)), "".join(s[0] for s in steps), lines))
    return min(found, key=lambda f: f[:2])


def test_lightest_derivations_match_all_edit_sequences():
    rng = random.Random(4)
    for _ in range(250):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), f"t{k}", rng.choice([0, 0, 1, 2, 3])) for k in range(rng.randint(0, 4))]
        goals = repair.lightest([(role[:1], fault) for role, _, fault in rows])
        cost, audit = min(goals[q] for q in repair.DONE if q in goals)
        expected = brute_repair(rows)
        assert (cost, audit) == expected[:2]
        assert [(r, t) for _, r, t in repair.apply_audit([r[:2] for r in rows], audit)] == expected[2]


def plain_repair(rows):
    """Row by row over the whole conversation: (cost, audit, lines), and the counts of faults."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def filled(states):
        for _ in range(3):
            for (before, role), after in follow.items():
                if role != "s" and before in states:
                    c, a, lines = states[before]
                    new = (c + 3, a + "I", [*lines, {"u": "user:", "a": "assistant:"}[role]])
                    states[after] = min(states.get(after, new), new)
        return states

    states = filled({"": (0, "", [])})
    for (role, text), fault in zip(rows, faults):
        new = {}
        for state, (c, a, lines) in states.items():
            ways = [(state, (c + 4, a + "D", lines))]
            if fault not in (1, 2):
                late = 3 if fault == 3 else 0
                if (state, role[:1]) in follow:
                    ways.append((follow[state, role[:1]], (c + late, a + "K", [*lines, f"{role}:{text}"])))
                ways += [(follow[state, r], (c + 3 + late, a + "R", [*lines, f"{n}:{text}"]))
                         for r, n in (("u", "user"), ("a", "assistant")) if (state, r) in follow]
            for after, way in ways:
                new[after] = min(new.get(after, way), way)
        states = filled(new)
    cost, audit, lines = min(states[s] for s in ("", "a") if s in states)
    return cost, audit, "\n".join(lines), [faults.count(k) for k in (1, 2, 3)]


def brute_report(rows):
    out = []
    for conv in {r[0] for r in rows}:
        hurt = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            hurt += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in hurt if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, text, faults = plain_repair([r[1:] for r in hurt])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(hurt, hurt[1:]))
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, count, turns):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(rng.choice(turns)):
            role = rng.choice([["user", "assistant"][turn % 2]] * 6 + ["system", "user", "assistant", "tool", "", None])
            text = rng.choice([f"said {rng.random()}.", f"so {rng.randint(0, 9)}!", "yes.", "open", "", None, " \n", "what?\n", "what?  "])
            rows.append((conv, rng.choice([turn] * 9 + [turn + 1, None]), role, text))
    return rows


@pytest.mark.parametrize("piece,fan,part,turns", [(128, 32, 256, [0, 1, 2, 5, 9]), (3, 2, 4, [1, 6, 25, 60]), (2, 2, 64, [30, 70])])
def test_repair_matches_row_by_row(spark, monkeypatch, piece, fan, part, turns):
    for name, value in (("PIECE", piece), ("FAN", fan), ("PART", part)):
        monkeypatch.setattr(repair, name, value)
    rows = conversations(piece, 25, turns) + [(None, 1, "user", "hello."), (None, 2, "assistant", "hello."), (70, None, None, None)]
    rows += [(90, -300 + 40 * k, "user", "early.") for k in range(20)]
    table = spark.createDataFrame([(*r, "a", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, part int")
    report, repaired = repair.repair(repair.damage(table))
    got = sorted((tuple(r) for r in repair.digests(report, repaired, table).collect()), key=repr)
    assert got == brute_report(rows)


def test_repaired_rows_are_in_order_and_legal(spark):
    rows = conversations(5, 12, [4, 9])
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report, repaired = repair.repair(table)
    roles = repaired.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("dated", "part", "seq", "role"))).alias("r")).collect()
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in r.r)) for r in roles)
    assert sum(len(r.r) for r in roles) == sum(len(r.audit) - r.audit.count("D") for r in report.collect())


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, repaired = repair.repair(repair.damage(empty))
    assert report.collect() == [] and repaired.collect() == []
    assert repair.digests(report, repaired, empty).collect() == []
