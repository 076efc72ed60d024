"""SuperMinHash groups, reversed search and conversation repair, against plain loops."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import conversation_repair as repair
from corpusloom.llm import lexical_search, superminhash
from corpusloom.llm.common import join_side
from corpusloom.session import durable


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- SuperMinHash


def shingle_sets(docs, size):
    out = []
    for _, text in docs:
        found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        n = min(size, len(found))
        out.append({" ".join(found[i : i + n]) for i in range(len(found) - n + 1)} if found else set())
    return out


def groups_loop(docs, size):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = shingle_sets(docs, size)
    label = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for (d, _), s, x in zip(docs, sets, label):
        ids = [e for (e, _), y in zip(docs, label) if y == x and e is not None]
        component = min(ids, default=None)
        out.append((d, len(s), component, d == component))
    return sorted(out, key=repr)


def plain_signature(elements):
    """One element after the other: a permutation thrown step by step."""
    m = superminhash.REGISTERS
    best = [1 << 64] * m
    for x in elements:
        place = list(range(m))
        for j in range(m):
            with np.errstate(over="ignore"):
                draw = int(superminhash._mix(np.array([x], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))[0])
            k = j + (draw >> 32) % (m - j)
            place[j], place[k] = place[k], place[j]
            best[place[j]] = min(best[place[j]], (j << 32) | (draw & 0xFFFFFFFF))
    return best


def test_signature_equals_plain_permutations(monkeypatch):
    cut = superminhash.Shingler(2)
    sets = [cut(" ".join(f"w{i * k % 97}" for i in range(n))) for k, n in ((1, 2), (3, 5), (7, 60), (5, 97), (11, 400))]
    want = [plain_signature(s.tolist()) for s in sets]
    for piece in (superminhash.PIECE, 16):
        monkeypatch.setattr(superminhash, "PIECE", piece)
        assert superminhash.signatures(sets).tolist() == want
    for x in sets:  # every element offers each rank to one register only
        assert len(set(plain_signature(x.tolist()[:1]))) == superminhash.REGISTERS


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        both, one, two = (rng.integers(0, 1 << 63, n, np.uint64) for n in (160, 20, 20))
        a, b = superminhash.signatures([np.unique(np.concatenate([both, one])), np.unique(np.concatenate([both, two]))])
        errors.append((a == b).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.var(errors) < 0.8 * 0.2 / superminhash.REGISTERS


@pytest.mark.parametrize("size", [2, 5])
def test_shingles(size):
    docs = [(0, "A b a B a b c"), (1, "one"), (2, "one two"), (3, ""), (4, None), (5, "İx ÀB c\td\x0be")]
    cut = superminhash.Shingler(size)
    assert [len(cut(t)) for _, t in docs] == [len(s) for s in shingle_sets(docs, size)]
    assert cut("a b").tolist() != cut("b a").tolist() and cut("a").tolist() != cut("a a").tolist()


@pytest.mark.parametrize("slice_rows, set_slice", [(20_000, 2_000_000), (3, 200)])
def test_groups_against_all_pairs(spark, monkeypatch, slice_rows, set_slice):
    monkeypatch.setattr(superminhash, "SLICE", slice_rows)
    monkeypatch.setattr(superminhash, "SET_SLICE", set_slice)
    rng = random.Random(4)
    docs = []
    for _ in range(10):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 200))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 14))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(300)}"
            docs.append((len(docs), " ".join(copy)))
    docs += [(500, "Same words here"), (501, "same  Words\nhere"), (502, "one"), (503, "ONE"), (504, ""), (505, None), (505, None), (None, "one"), (None, "two"), (None, None), (506, "same words here"), (506, "same words here")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert rows(superminhash.near_duplicates(table)) == groups_loop(docs, 2)


def test_group_edges(edges):
    docs = [(r["doc_id"], r["text"]) for r in edges.collect()]
    assert rows(superminhash.near_duplicates(edges)) == groups_loop(docs, 2)
    assert superminhash.near_duplicates(edges.limit(0)).count() == 0


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    import corpusloom.llm.common as common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    table = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"))
    table = durable(table)
    side = table.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).withColumn("value", F.col("key") * 2)
    out = join_side(table, side, "key", "copies")
    assert out.count() == 1000 and out.filter("value <> 2 * key").count() == 0
    assert join_side(table.limit(0), side.limit(0), "key", "copies").count() == 0


# --- search


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def search_loop(docs, items, k):
    counted = [(d, terms(t)) for d, t in docs]
    counted = [(d, t) for d, t in counted if t]
    n_docs, total = len(counted), sum(len(t) for _, t in counted)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(w in t for _, t in counted) + 1))) for w in wanted}
        scored = []
        for d, t in counted:
            m = 100 - 90 + (90 * len(t) * n_docs) // total
            score = sum(weight[w] * ((10**9 * t.count(w)) // (1000 * t.count(w) + 8 * m)) for w in wanted)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -score) for rank, (score, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("postings, piece, cells", [(2_000_000, 1 << 20, 2_000_000), (12, 16, 9)])
def test_search_against_loop(spark, monkeypatch, postings, piece, cells):
    monkeypatch.setattr(lexical_search, "PIECE", piece)
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)] + ["Émile", "émile", "日本", "A1", "a1", "x_y"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    docs += [(7, docs[7][1]), (None, docs[3][1]), (None, None), (200, ""), (201, "-- ... \x00"), (202, docs[9][1])]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(9)]
    items += [(9, None), (10, "--"), (11, "absent nowhere"), (3, "w29 w29"), (None, "w1"), (3, items[3][1])]
    out = lexical_search.top_documents(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(items, "item_id bigint, text string"), k=5, max_postings=postings
    )
    assert rows(out.select("item_id", "rank", "doc_id", "score")) == search_loop(docs, items, 5)


def test_search_edges(spark, edges):
    items = spark.createDataFrame([(1, "ordinary sentence cat"), (2, "日本語")], "item_id bigint, text string")
    docs = [(r["doc_id"], r["text"]) for r in edges.collect()]
    got = lexical_search.top_documents(edges, items)
    assert rows(got.select("item_id", "rank", "doc_id", "score")) == search_loop(docs, [tuple(r) for r in items.collect()], 10)
    assert lexical_search.top_documents(edges.limit(0), items).count() == 0
    assert lexical_search.top_documents(edges, items.limit(0)).count() == 0


def test_large_item_tables_are_refused(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "MAX_ITEM_BYTES", 3)
    with pytest.raises(ValueError, match="too large"):
        lexical_search.blocks(spark.createDataFrame([(1, "four")], "item_id bigint, text string"), "item_id", "text")


# --- conversation repair


def parse_by_rows(symbols):
    """Row by row through the automaton, without spans."""
    states = {0: (0, "")}

    def put(table, state, cell):
        if state is not None and (state not in table or cell < table[state]):
            table[state] = cell

    def inserted(table):
        for _ in range(4):
            for p, (cost, audit) in list(table.items()):
                for c in "ua":
                    put(table, repair.STEP.get((p, c)), (cost + 5, audit + "I"))
        return table

    states = inserted(states)
    for s in symbols:
        after, late = {}, 5 * s.isupper()
        for p, (cost, audit) in states.items():
            put(after, p, (cost + 2, audit + "D"))
            if s != "!":
                put(after, repair.STEP.get((p, s.lower())), (cost + late, audit + "K"))
                for c in "ua":
                    put(after, repair.STEP.get((p, c)), (cost + late + 1, audit + "R"))
        states = inserted(after)
    return min(states[q] for q in (0, 3) if q in states)


def parse_all_splits(symbols):
    """CYK with every split of every span."""
    n = len(symbols)
    cells = {(i, i + 1): repair.terminal(s) for i, s in enumerate(symbols)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            ways = [repair.combine(cells[i, k], cells[k, i + size]) for k in range(i + 1, i + size)]
            assert all(w == ways[0] for w in ways)  # each split gives the same cells
            cells[i, i + size] = ways[0]
    return repair.verdict(cells[0, n])


def test_parse_against_all_splits_and_rows():
    rng = random.Random(8)
    for n in list(range(1, 9)) * 12 + [20, 33]:
        symbols = "".join(rng.choice("suauauaSUA-X!") for _ in range(n))
        got = repair.verdict(repair.parse(symbols))
        assert got == parse_by_rows(symbols) == parse_all_splits(symbols), symbols
    long = "".join(rng.choice("suauauaSUA-X!") for _ in range(5000))
    assert repair.verdict(repair.parse(long)) == parse_by_rows(long)


@pytest.mark.parametrize("symbols, cost, audit", [
    ("sua", 0, "KKK"), ("ua", 0, "KK"), ("", 0, ""), ("u", 2, "D"), ("au", 2, "RR"), ("uua", 2, "DKK"), ("!", 2, "D"), ("s", 2, "D"), ("uA", 4, "DD"), ("uau", 2, "KKD"),
])
def test_cheapest_repairs(symbols, cost, audit):
    got = repair.verdict(repair.parse(symbols))
    assert got == parse_by_rows(symbols) == (cost, audit)


def conversation_loop(table, damage=True):
    said = {}
    for conv, turn, role, text in table:
        own = said.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv, own in said.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        symbols, seen, faults = "", set(), [0, 0, 0]
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\f\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
            symbols += "!" if fault in (0, 1) else (initial.upper() if initial != "-" else "X") if fault == 2 else initial
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = parse_by_rows(symbols)
        lines, state, rest = [], 0, iter(own)
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else next(rest)
            if letter == "D":
                continue
            if letter != "K":
                role = next({"u": "user", "a": "assistant"}[c] for c in "ua" if (state, c) in repair.STEP)
            state = repair.STEP[state, role[:1]]
            lines.append(f"{role}:{text}")
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def some_conversations(rng, many):
    texts = ["Yes.", "No!", "Why?", "well", "", "  \t", "Yes.", "A b c.", "x\ny.", "¿Qué? ", None]
    table = []
    for conv in range(many):
        turn = 0
        for _ in range(rng.randint(0, 9)):
            table.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}."))
            turn += rng.choice([1, 1, 1, 2, 0])
    return table


@pytest.mark.parametrize("block", [256, 2])
def test_repair_against_loop(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    table = some_conversations(random.Random(2), 60)
    table += [(None, 0, "user", "a."), (None, None, "assistant", "b."), (70, None, None, None), (70, None, "user", "x."), (70, None, "user", "x."), (71, None, "user", "y.")]
    df = spark.createDataFrame(table, SCHEMA).repartition(6)
    assert rows(repair.repair(df, repair.damaged(df))) == conversation_loop(table)
    assert rows(repair.repair(df)) == conversation_loop(table, damage=False)


@pytest.mark.parametrize("block", [256, 7])
def test_one_long_conversation_over_many_tasks(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(5)
    table = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", f"text {i}.", f"open {i}", ""])) for i in range(1500)]
    table += [(1, 9, "user", "again and again.")] * 700 + some_conversations(rng, 5)
    df = spark.createDataFrame(table, SCHEMA)
    assert repair.ordered(repair.faulty(repair.damaged(df))).filter("conv_id = 1").select("segment").distinct().count() > 4
    assert rows(repair.repair(df, repair.damaged(df))) == conversation_loop(table)


def test_dropped_and_empty_conversations(spark):
    gone = next(c for c in range(10_000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in range(1)))
    df = spark.createDataFrame([(gone, 0, "user", "x.", 5)], SCHEMA + ", symbols int")
    assert rows(repair.repair(df, repair.damaged(df))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert repair.repair(df.limit(0), repair.damaged(df.limit(0))).count() == 0
