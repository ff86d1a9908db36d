"""Conversation repair, source mixing and vector codes against brute force and on odd tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewright.llm import mixing, queries, repair, vector_codes

TURNS = "conv_id long, turn long, role string, text string, place string, fault string"
DOCS = "doc_id long, text string, source string, size string, p string"


def conversations(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "mine", "mine") for c, t, r, x in rows], TURNS).repartition(3)


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """The least (cost, letters), and its turns, of all edits with up to two inserts before each row and after the last."""
    fault = faults(rows)
    choices = []
    for (role, text), f in zip(rows, fault):
        cut = 5 if f == "truncated" else 0
        own = [(2, "D", [])]
        if f not in ("blank", "duplicate"):
            own += [(cut, "K", [(role, text)]), (cut + 1, "R", [("user", text)]), (cut + 1, "R", [("assistant", text)])]
        choices.append(own)
    added = [(5 * len(s), "I" * len(s), [({"u": "user", "a": "assistant"}[c], "") for c in s]) for s in ("", "u", "a", "ua", "au")]
    best = None
    parts = [added]
    for own in choices:
        parts += [own, added]
    for picked in itertools.product(*parts):
        turns = [t for p in picked for t in p[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in turns)):
            key = (sum(p[0] for p in picked), "".join(p[1] for p in picked))
            if best is None or key < best[0]:
                best = (key, turns)
    return best


def expected(rows):
    (cost, letters), turns = cheapest(rows)
    f = faults(rows)
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def test_repair_is_brute_force(spark):
    r = random.Random(5)
    talks = [[(r.choice(["user", "user", "assistant", "assistant", "system", "tool", ""]), r.choice(["Hi.", "Well", "No!", " ", "Why?\n", "é \t"])) for _ in range(r.randint(1, 3))] for _ in range(60)]
    rows = [(c, t, role, text) for c, talk in enumerate(talks) for t, (role, text) in enumerate(talk)]
    got = {x.conv_id: tuple(x)[2:] for x in repair.summaries(repair.edits(conversations(spark, rows))).collect()}
    assert got == {c: expected(talk) for c, talk in enumerate(talks)}


def test_repair_of_odd_conversations(spark):
    rows = [(1, None, "user", "A."), (1, 5, "assistant", "B."), (1, 9, None, None), (None, 0, "user", "A."), (None, 1, "assistant", "B!")]
    rows += [(2, 3, "user", "Same.")] * 4 + [(2, 3, "assistant", "Then.")]
    rows += [(3, 2 * t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(20000)]
    edited = repair.edits(conversations(spark, rows))
    got = {x.conv_id: x for x in repair.summaries(edited).collect()}
    assert (got[1].audit, got[1].gaps, got[1].blank, got[1].illegal, got[1].cost) == ("KKD", 3, 1, 1, 2)
    assert got[None].audit == "KK" and got[None].cost == 0
    # By role first, as the turn is the same: the reply stands before the question, whose repeats go.
    assert (got[2].audit, got[2].duplicate, got[2].cost) == min(((a, 3, c) for a, c in (("DKDDDI", 13), ("RRDDD", 8))), key=lambda x: x[2])
    assert got[3].audit == "K" * 20000 and got[3].gaps == 19999 and got[3].illegal == 0
    turns = {(x.conv_id, x.place): (x.role, x.text) for x in repair.repaired(edited).where("conv_id < 3").collect()}
    assert turns[1, 0] == ("user", "A.") and turns[2, 1][0] == "assistant" and len([k for k in turns if k[0] == 2]) == 2
    empty = spark.createDataFrame([], TURNS)
    assert repair.summaries(repair.edits(empty)).count() == 0


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "mine", "mine") for i, t, s in rows], DOCS).repartition(3)


def reshared(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing out, cutting off and sharing the excess, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), {s for s in names if sizes[s]}
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - most * sizes[s]) for s in free)
        full = {s for s in free if target[s] >= most * sizes[s]}
        for s in full:
            target[s] = float(most * sizes[s])
        free -= full
    return target


@pytest.mark.parametrize("group", [256, 8])
def test_mix_meets_its_targets(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randint(1, 200)), r.choice(["a", "b", "b", "b", "é", "zz", None])) for i in range(900)]
    rows += [(1000 + i, None if i % 2 else " \n", "a") for i in range(20)] + [(2000, "x y z", "tiny"), (3000, "w " * 5000, "b")]
    got = mixing.mix(documents(spark, rows)).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = reshared(sizes)
    assert len(got) == len(rows) and {x.doc_id for x in got} == {x[0] for x in rows}
    for source, size in sizes.items():
        own = [x for x in got if x.source == source]
        each = want[source] / size if size else 0
        assert own[0].target == pytest.approx(want[source]) and own[0].source_size == size
        assert all(int(each) <= x.copies <= min(int(each) + 1, 3) for x in own if x.size)
        longest = max(x.size for x in own)
        assert abs(sum(x.size * x.copies for x in own) - want[source]) <= max(longest / 2, 1)
    again = mixing.mix(documents(spark, rows[::-1]).repartition(7)).collect()
    assert {(x.doc_id, x.copies) for x in again} == {(x.doc_id, x.copies) for x in got}


def test_targets_are_brute_force(spark):
    r = random.Random(4)
    for n in (1, 2, 5, 17):
        sizes = {f"s{i}": r.choice([0, 1, 10, 1000, r.randint(1, 10**6)]) for i in range(n)} | {None: 7}
        got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = reshared(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def test_every_document_has_its_chance(spark):
    """Over many seeds a document of a group is taken about as often as its probability says."""
    items = spark.createDataFrame([(100 + i, i, i, 0.3, 0, 1, 0) for i in range(40)], "size long, key long, doc_id long, p double, base int, rows long, more long")
    group = items.groupBy().agg(F.sort_array(F.collect_list(F.struct(*items.columns)), asc=False).alias("items"))
    tried = group.crossJoin(spark.range(600).withColumnRenamed("id", "seed")).repartition(4).select(mixing.pivot(F.col("items"), F.col("seed"), "bigint").alias("f"))
    n = {x.doc_id: x.n for x in tried.select(F.explode(F.concat("f.done", F.array("f.left"))).alias("i")).groupBy("i.doc_id").agg((F.sum("i.p") / 600).alias("n")).collect()}
    assert len(n) == 40 and all(abs(v - 0.3) < 0.08 for v in n.values()) and abs(sum(n.values()) / 40 - 0.3) < 0.005


def test_mix_of_odd_tables(spark):
    rows = [(1, "a b", "s")] * 7 + [(None, "a b c", "s")] * 5 + [(2, "", "s"), (2, None, None), (3, "x", "t")]
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows) and sum(x.doc_id == 1 for x in got) == 7
    assert max(x.copies for x in got) <= 3 and {x.target for x in got if x.source is None} == {0.0}
    for s in ("s", "t"):
        own = [x for x in got if x.source == s]
        assert abs(sum(x.size * x.copies for x in own) - own[0].target) <= 1.5
    assert mixing.mix(documents(spark, [])).count() == 0
    nothing = mixing.mix(documents(spark, [(1, "", "s"), (2, None, None)])).collect()
    assert {(x.doc_id, x.target, x.copies) for x in nothing} == {(1, 0.0, 0), (2, 0.0, 0)}
    docs = documents(spark, [(1, "a b", "s"), (2, "c", "t")])
    mixed = mixing.mix(docs)
    assert mixing.taken(docs, mixed).columns == docs.columns and mixing.taken(docs, mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_nearest_entries_are_brute_force():
    r = np.random.default_rng(1)
    for spread, width in ((3, 2), (50, 8), (100_000_000, 4)):
        entries = r.integers(-spread, spread, (16, width))
        entries[5] = entries[3]
        points = np.concatenate([r.integers(-spread, spread, (500, width)), entries, (entries[:8] + entries[8:]) // 2])
        every = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
        index, away = vector_codes.nearest(points, entries, vector_codes.ball(entries, list(range(16))))
        assert (index == every.argmin(axis=1)).all() and (away == every.min(axis=1)).all()
    clustered = np.concatenate([c + r.integers(-5, 5, (4, 8)) for c in r.integers(-10000, 10000, (4, 8))])
    visits = []
    vector_codes.nearest(clustered.repeat(50, axis=0), clustered, vector_codes.ball(clustered, list(range(16))), visits)
    assert sum(visits) < 16 * 800 // 2


def test_vector_codes_are_brute_force_on_odd_rows(spark):
    r = random.Random(2)
    vectors = [(i, [r.choice([-1, 1]) * r.random() * 2 for _ in range(16)], i % 3 or None) for i in range(90)]
    vectors += vectors[:5] + [(None, vectors[0][1], 7)]
    bad = [(900, None, 1), (901, [1.0] * 15 + [None], 1), (902, [1.0] * 15 + [float("nan")], None), (903, [float("-inf")] + [0.0] * 15, 2)]
    df = spark.createDataFrame([(*v, "mine") for v in vectors + bad], "vec_id long, embedding array<float>, label int, code string").repartition(4)
    books = vector_codes.fit(df)
    x = np.array([np.floor(np.array(v[1], np.float32).astype(float) * 4096) for v in vectors]).astype(int).reshape(-1, 8, 2)
    order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0] is None, vectors[i][0] or 0))
    want = x[order[:16]].transpose(1, 0, 2).copy()

    def assign(books):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(6):
        index, _ = assign(want)
        for p in range(8):
            for e in range(16):
                own = x[index[:, p] == e, p]
                if len(own):
                    want[p, e] = own.sum(axis=0) // len(own)
    assert (books == want).all()
    index, away = assign(want)
    total = {}
    for v, a in zip(vectors, away.sum(axis=1)):
        total[v[2]] = total.get(v[2], 0) + int(a)
    expected = sorted(str((v[0], "".join(f"{i:02x}" for i in row), int(a), total[v[2]])) for v, row, a in zip(vectors, index, away.sum(axis=1)))
    coded = vector_codes.encode(df, books)
    got = vector_codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error").collect()
    assert sorted(str(tuple(g)) for g in got) == expected
    back = {d.vec_id: d.embedding for d in vector_codes.decode(coded, books).collect()}
    assert back[4] == pytest.approx([c / 4096 for c in np.concatenate([want[p, index[4, p]] for p in range(8)])])
    few = df.where("vec_id < 3").dropDuplicates(["vec_id"])
    assert vector_codes.fit(few).shape == (8, 3, 2) and {g.error for g in vector_codes.encode(few, vector_codes.fit(few)).collect()} == {0}
    none = df.where("vec_id < 0")
    assert vector_codes.fit(none) is None and vector_codes.encode(none, None).count() == 0 and vector_codes.with_label_errors(vector_codes.encode(none, None)).count() == 0


def test_queries_and_sql_are_registered():
    assert {"op11_repair", "op12_mixing", "op13_vector_codes"} <= set(queries.QUERIES) and {"op11_repair", "op13_vector_codes"} <= set(queries.ORACLES)
