"""Conversation repair, the n-gram join and the filter audit against brute force, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import filter_audit, ngram_join, queries, repair, simhash
from ledgerloom.llm.common import cut, table


def cheapest(rows):
    """Least (cost, letters, roles) by trying all edits; rows: (initial, must go, truncated)."""
    best = None

    def go(i, out, letters, cost):
        nonlocal best
        if best and cost > best[0]:
            return
        for e in (0, 1, 2):
            for put in itertools.product("ua", repeat=e):
                o, a, c = out + "".join(put), letters + "I" * e, cost + 2 * e
                if i == len(rows):
                    if re.fullmatch("(s?(ua)+)?", o) and (best is None or (c, a) < best[:2]):
                        best = (c, a, o)
                    continue
                initial, must, cut_off = rows[i]
                go(i + 1, o, a + "D", c + 3)
                if not must:
                    if initial and initial in "sua":
                        go(i + 1, o + initial, a + "K", c + cut_off)
                    for x in "ua":
                        go(i + 1, o + x, a + "R", c + 2 + cut_off)

    go(0, "", "", 0)
    return best


def test_best_edits():
    rng = random.Random(1)
    for _ in range(150):
        rows = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
        codes = bytes(repair.code_of(*x) for x in rows)
        for block in (1, 2, 128):
            assert repair.best_edits(codes, block) == cheapest(rows)[:2]
    for _ in range(20):
        codes = bytes(repair.code_of(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 900)))
        assert repair.best_edits(codes, 7) == repair.best_edits(codes, 2000)


def direct_repair(log):
    """The contract of op11 for rows (conv_id, turn, role, text), conversations of five rows or fewer."""
    by, out = defaultdict(list), {}
    for conv, turn, role, text in log:
        by[conv]
        name = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, state, n = set(), [], [0, 0, 0]
        for _, role, text in rows:
            body = text.strip(" \t\n\v\f\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                n[fault] += 1
            state.append((role[:1], fault < 2, fault == 2))
        initials = [role[:1] for _, role, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, roles = cheapest(state)
        left, lines, at = iter(rows), [], 0
        for x in audit:
            _, role, text = (None, None, "") if x == "I" else next(left)
            if x != "D":
                lines.append(f"{role if x == 'K' else {'u': 'user', 'a': 'assistant'}[roles[at]]}:{text}")
                at += 1
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_of(log):
    rows = repair.damaged(repair.turns_of(log))
    facts = repair.edits(rows, log)
    said = repair.digests(rows, facts).withColumnRenamed("conv_id", "c")
    got = facts.join(said, F.col("conv_id").eqNullSafe(F.col("c"))).collect()
    return {r.conv_id: tuple(r[c] for c in NAMES) for r in got}, len(got), rows, facts


def test_repair_against_brute_force(spark):
    rng = random.Random(5)
    roles, said = ["system", "user", "assistant", "assistant", "user", "tool", None, ""], ["Hello.", "And then", "Why?", " ", None, "No.\n", "é"]
    log = [(c, rng.choice([1, 2, 3, 5, 9, None]), rng.choice(roles), rng.choice(said)) for c in [*range(150), None] for _ in range(rng.randint(1, 4))]
    df = spark.createDataFrame(log, "conv_id long, turn long, role string, text string").withColumns({"audit": F.lit("own"), "kind": F.lit(3), "c": F.lit(1)})
    got, n, rows, facts = repair_of(df)
    assert n == len(got) == 151 and got == direct_repair(log)
    assert any(x[-2] == "" for x in got.values())
    lines = defaultdict(list)
    for r in sorted(repair.repaired(rows, facts).collect(), key=lambda r: r.place):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() == x[-1] for c, x in got.items())


def test_repair_of_empty_and_long(spark):
    df = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert repair_of(df)[1] == 0
    long = [("one", i, ("user", "assistant")[i % 2], f"Turn {i % 700}.") for i in range(3000)]
    got = repair_of(spark.createDataFrame(long, df.schema))[0]["one"]
    assert got[2] > 1900 and got[6].count("K") + got[6].count("R") + got[6].count("D") == repair.damaged(repair.turns_of(spark.createDataFrame(long, df.schema))).count()


def test_repair_query(spark, data):
    log = [tuple(r) for r in table(spark, data, "conversations").select("conv_id", "turn", "role", "text").collect()]
    few = {c for c in {r[0] for r in log} if sum(r[0] == c for r in log) <= 4}
    got = {r.conv_id: tuple(r[c] for c in NAMES) for r in queries.QUERIES["op11_repair"](spark, data).collect()}
    want = direct_repair([r for r in log if r[0] in few])
    assert set(got) == {r[0] for r in log} and {c: got[c] for c in few} == want


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def direct_join(rows):
    """(doc_id, n, component) by comparing all pairs; rows: (doc_id, text)."""
    own = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(own):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(own):
        common = defaultdict(int)
        for x in s:
            for j in where[x]:
                common[j] += j < i
        for j, c in common.items():
            if c and 100 * c >= 90 * (len(s) + len(own[j]) - c):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, len(own[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)], key=str)


def near_texts(rng, families, copies):
    """Texts in families of edited copies, at and around the limit, some linked through others only."""
    out = []
    for _ in range(families):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 9, 11, 12, 20, 60, 200, 700]))]
        for _ in range(rng.randint(1, copies)):
            some = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                at = rng.randrange(len(some))
                some[at : at + rng.choice([0, 1])] = [f"x{rng.randint(0, 10**6)}"] * rng.choice([0, 1])
            out.append(" ".join(some))
            if rng.random() < 0.3:
                words = some  # the next ones are copies of this copy
    return out


def test_join_against_brute_force(spark):
    rng = random.Random(3)
    some = near_texts(rng, 120, 9)
    rows = [*enumerate(some), (None, some[0]), (7, "again the same id"), (7, some[3]), (8001, ""), (8002, None), (8003, " \t\n"), (8004, "One"), (8005, "one"), (8006, "one two"), (None, None), (5, some[5]), (5, some[5]), (8010, "a b c " * 4000), (8011, "b c a " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_shingles": F.lit("own"), "node": F.lit(1), "h": F.lit(2)}).repartition(5)
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_sets(df).collect()], key=str)
    assert got == direct_join(rows)


def test_join_finds_links_beside_the_stars(spark, monkeypatch):
    """Variants of one text that are too far from each other and linked through it only; cells and combined parts of few rows."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    some = [" ".join(base)]
    for k in range(60):
        own = list(base)
        own[(5 * k) % 295 + 1], own[(5 * k + 150) % 295 + 1], own[(5 * k + 70) % 295 + 1] = f"x{k}", f"y{k}", f"z{rng.randint(0, 9)}"
        some.append(" ".join(own))
    some += [x.replace("w7 ", "q ").replace("w99", "q").replace("w201", "q") for x in some[:40]]
    rows = list(enumerate(some))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    own = ngram_join.sets(df).where("node is not null")
    members = ngram_join.gathered(ngram_join.placed(df))
    pairs = members.select("key", "node").distinct().join(own.select("node", F.col("n_shingles").alias("n"), "point").distinct(), "node").withColumn("root", F.col("node"))
    got = {(bytes(r.a), bytes(r.b)) for r in ngram_join.searched(pairs, cell=16).collect()}
    node = [ngram_join.node_of(ngram_join.shingles(t)) for t in some]
    sets = [sets_of(t) for t in some]
    want = {tuple(sorted((node[i], node[j]))) for i, j in itertools.combinations(range(len(some)), 2) if node[i] != node[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])}
    assert want <= got
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_sets(df).collect()], key=str) == direct_join(rows)


def variants(count):
    """A text of 300 words and variants of it, most of them too far from each other and linked through it only."""
    rng = random.Random(count)
    base = [f"w{i}" for i in range(300)]
    out = [" ".join(base)]
    for k in range(count):
        own = list(base)
        for at in rng.sample(range(1, 299), 3 + k % 3):
            own[at] = f"x{rng.randint(0, 10**9)}"
        out.append(" ".join(own))
    return out


def test_join_search_gives_no_more_pairs_than_its_cells_have_rows(spark, monkeypatch):
    """27,344 rows of 641 sets in the cells; 59,104 pairs of them are near enough to be verified."""
    asked, made, search = [], [], ngram_join.searched
    monkeypatch.setattr(ngram_join, "searched", lambda *a, **k: asked.append(a[0]) or made.append(search(*a, **k)) or made[-1])
    rows = list(enumerate(variants(640)))
    got = ngram_join.near_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == direct_join(rows)
    assert 0 < made[0].count() < asked[0].count()


def test_join_cells_connect_what_their_pairs_connect(spark):
    """Families in one cell and in many give the components of all their linked pairs; so do the pairs given by a cell of points."""
    rng = random.Random(4)
    some = sorted({*variants(50), *near_texts(rng, 30, 9), "one two three four five six seven eight nine ten eleven"})
    sets = [ngram_join.shingles(t) for t in some]
    node = [ngram_join.node_of(x) for x in sets]

    def parts(pairs):
        part = list(range(len(some)))
        for x, y in pairs:
            part = [part[x] if p == part[y] else p for p in part]
        return [part.index(p) for p in part]

    linked = [(x, y) for x, y in itertools.combinations(range(len(some)), 2) if 100 * len(c := set(sets[x].tolist()) & set(sets[y].tolist())) >= 90 * (len(sets[x]) + len(sets[y]) - len(c))]
    everyone = list(range(len(some)))
    given = [(x, y) for xs, y in ngram_join.linked_sets(sets, np.array(everyone), np.array(everyone)) for x in xs.tolist()]
    assert sorted((x, y) for x, y in given if x < y) == linked and len(given) == 2 * len(linked)
    own = spark.createDataFrame(list(zip(node, [b"all"] * len(some), [len(x) for x in sets], strict=True)), "node binary, root binary, n long")
    known = spark.createDataFrame([(k, x.tobytes()) for k, x in zip(node, sets, strict=True)], "node binary, set binary")
    for portion, cell in ((1 << 22, 4096), (1 << 22, 7), (1 << 12, 4096)):
        found = [(node.index(bytes(r.a)), node.index(bytes(r.b))) for r in ngram_join.within(own, known, portion, cell).collect()]
        assert {(min(x), max(x)) for x in found} <= set(linked) and parts(found) == parts(linked)
    rows = own.select(F.lit(1).alias("key"), "node", F.col("node").alias("root"), "n").join(spark.createDataFrame([(k, ngram_join.point(x).tobytes()) for k, x in zip(node, sets, strict=True)], "node binary, point binary"), "node")
    for cell in (4096, 16):
        whole, few = ([(node.index(bytes(r.a)), node.index(bytes(r.b))) for r in ngram_join.searched(rows, cell, x).collect()] for x in (True, False))
        assert set(few) <= set(whole) and len(few) < len(whole) and parts(few) == parts(whole)


def test_join_of_few_rows_leaves_few_files(spark, monkeypatch):
    """With 48 shuffle partitions that Spark doesn't put together, what is stored in rounds over small tables is in a file a core."""
    held, kept = [], {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for module in (ngram_join, simhash):
        monkeypatch.setattr(module, "cut", lambda df: held.append(cut(df)) or held[-1])
    few = spark.sparkContext.defaultParallelism
    rows = list(enumerate(variants(30)))
    try:
        for k, v in zip(kept, ("48", "false")):
            spark.conf.set(k, v)
        pairs = [(x, x + 1) for x in range(60) if x % 7] + [(x, 99) for x in range(0, 60, 14)]
        roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert all(roots[a] == roots[b] for a, b in pairs) and set(roots.values()) == {0, 1, 15, 29, 43, 57}
        assert few < 48 and all(x.rdd.getNumPartitions() <= few for x in held[1:])
        held.clear()
        got = ngram_join.near_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == direct_join(rows)
        small = [x.rdd.getNumPartitions() <= few for x in held]
        assert len(small) - sum(small) <= 3  # the search's pairs, and the families' links (stored twice), whose cells are dealt over all tasks
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_join_query(spark, data):
    rows = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]
    got = queries.QUERIES["op12_ngram_join"](spark, data).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == direct_join(rows)
    assert ngram_join.near_sets(table(spark, data, "documents").limit(0)).count() == 0


def test_swaps_lead_through_all_orders():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in filter_audit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n)))) == len(list(filter_audit.swaps(n))) + 1


def direct_audit(counts):
    out = {}
    for order in itertools.permutations("ABCDE"):
        left = dict(counts)
        for step, f in enumerate(order, 1):
            bit = 1 << "ABCDE".index(f)
            gone = {m: w for m, w in left.items() if m & bit}
            left = {m: w for m, w in left.items() if not m & bit}
            total = lambda d, i=0: sum(w[i] for w in d.values())
            out["".join(order), step] = (total(left), total(gone), sum(w[0] for m, w in counts.items() if m & bit) - total(gone), counts.get(bit, (0,))[0], total(gone, 1), total(gone, 2))
    return out


def test_audit_against_brute_force():
    rng = random.Random(2)
    for _ in range(5):
        counts = {m: (rng.randint(0, 9), rng.randint(0, 3), rng.randint(0, 3)) for m in rng.sample(range(32), rng.randint(1, 32))}
        want = direct_audit(counts)
        rows = filter_audit.audit("ABCDE", counts)
        assert {r[:2]: r[2:8] for r in rows} == want and len(rows) == 600
        for f in "ABCDE":
            assert {r[8] for r in rows if r[0][r[1] - 1] == f} == {sum(v[1] for (o, s), v in want.items() if o[s - 1] == f)}


@pytest.mark.parametrize("empty", [False, True])
def test_audit_with_odd_rows(spark, duck, empty):
    docs = [(1, "Some WORDS", "a"), (2, "Some WORDS", "b"), (2, "Some WORDS", "b"), (None, "Some WORDS", None), (None, None, ""), (3, "", "a"), (4, None, None), (5, "x y " * 40 + "#", "a"), (6, " ".join(map(str, range(60))), "b"), (7, "\t\n ", "b")]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (6, 1, None), (99, 1, 1)]
    d = spark.createDataFrame([] if empty else docs, "doc_id long, text string, source string").withColumns({"mask": F.lit("own"), "part": F.lit("own"), "n": F.lit(0)})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("own"))
    got = filter_audit.interactions(d, lab)
    con = duck.cursor()
    con.register("docs_", d.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels_", lab.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    want = con.sql(filter_audit.ORACLE.replace("FROM documents", "FROM docs_").replace("FROM labels", "FROM labels_"))
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())
