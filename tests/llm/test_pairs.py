"""SimHash near-duplicates, decontamination, mixing and tool calls against brute force."""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pytest
import xxhash

from parcelwise.llm import decontamination, mixing, simhash, tool_calls

WORDS = [a + b for a, b in itertools.product(["ka", "lo", "mi", "ru", "te", "vo"], ["n", "sh", "rt", "lk", "nd"])]


def prose(seed: int, n: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in draw.integers(len(WORDS), size=n))


def slow_fingerprint(text: str | None) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows: list[tuple]) -> dict:
    prints = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 2:
            root[find(i)] = find(j)
    names: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return sorted(((d, f"{prints[i]:016x}", names.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one two"), (None, "one two"), (905, "É a b\x0bc"), (906, "É a b\x0bc"), (906, "É a b\x0bc")]


@pytest.mark.parametrize("longest", [1, 4, 32])
def test_components(spark, longest):
    rows = list(ODD)
    for i in range(12):
        text = prose(i, 120 + 30 * i)
        rows.append((i, text))
        for k in range(1, i + 1):
            words = text.split()
            words[(7 * k) % len(words)] = f"new{k}"
            rows.append((100 * (i + 1) + k, " ".join(words)))
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, root string")
    found = sorted((tuple(r) for r in simhash.near_duplicates(docs, longest=longest).collect()), key=repr)
    assert found == slow_components(rows)
    assert len({c for *_, c in found}) < len(rows) - 10


def test_links_by_bits(spark):
    draw = np.random.default_rng(5)
    base = [int(x) for x in draw.integers(0, 1 << 63, size=6)]
    prints = set(base) | {b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in draw.integers(0, 63, size=(8, 2))}
    prints |= {b ^ -(1 << 63) for b in base}
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")

    def partition(edges):
        root = {p: p for p in prints}
        for a, b in edges:
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        find = lambda p: p if root[p] == p else find(root[p])
        return {p: find(p) for p in prints}

    want = partition([(a, b) for a, b in itertools.combinations(sorted(prints), 2) if bits(a, b) <= 2])
    for longest in (1, 2, 32):
        edges = [tuple(r) for r in simhash.links(frame, longest).collect()]
        assert all(bits(a, b) <= 2 for a, b in edges if longest == 32)
        assert partition(edges) == want


def test_tally_counts_shared_bytes(spark):
    draw = np.random.default_rng(8)
    base = draw.integers(0, 256, 8)
    prints = set()
    for changed in range(9):
        for _ in range(3):
            row = base.copy()
            row[draw.permutation(8)[:changed]] ^= draw.integers(1, 256, changed)
            prints.add(int.from_bytes(bytes(row.tolist()), "big", signed=True))
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    met = {(r.u, r.v): r.meetings for r in simhash.tallied(simhash.postings(frame)).collect()}
    octets = {p: (p & (2**64 - 1)).to_bytes(8, "big") for p in prints}
    same = {(a, b): sum(x == y for x, y in zip(octets[a], octets[b])) for a, b in itertools.combinations(sorted(prints), 2)}
    assert met == {pair: math.comb(n, simhash.POSTED) for pair, n in same.items() if n >= simhash.POSTED}
    kept = {pair for pair, n in met.items() if n >= simhash.LEAST_MEETINGS}
    assert kept == {pair for pair, n in same.items() if n >= 6} and 0 < len(kept) < len(met)


def test_keep_one(spark):
    docs = spark.createDataFrame([(3, prose(1, 80)), (2, prose(1, 80)), (2, prose(1, 80)), (7, prose(2, 80)), (None, prose(2, 80))], "doc_id long, text string")
    assert sorted(r.doc_id or -1 for r in simhash.keep_one(docs).collect()) == [-1, 2, 7]
    empty = docs.where("false")
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_chain_components(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 200), (200, 150)], "u long, v long")
    found = {r.u: r.v for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, n + 1)}, 200: 100, 150: 100}


# --- decontamination


def slow_distance(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_contaminated(spark):
    items = [(i, prose(500 + i, 25)) for i in range(5)] + [(8, "short bit here ok"), (9, None), (10, ""), (None, prose(700, 25))]
    draw = np.random.default_rng(3)
    docs = []
    for i in range(24):
        text = list(prose(i, 60))
        passage = list(items[i % 5][1])
        if i % 3:
            for p in draw.integers(0, len(passage), size=(i % 7)):
                passage[p] = "#"
            text[50:50] = [" ", *passage, " "]
        docs.append((i, "".join(text)))
    docs += [(100, None), (101, ""), (102, "A SHORT  bit\nhere OK indeed"), (103, prose(700, 25)), (104, items[0][1][:75]), (104, items[0][1][:75])]
    frame = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int")
    found = decontamination.contaminated(frame, bench).collect()
    index = decontamination.Index.of([r for r in items if r[1]], 6, 60, 0.1)
    want = set()
    for d, t in docs:
        text = decontamination.normal(t)
        for at, part, edits in index.passages:
            if text and slow_distance(part, text) <= edits:
                want.add((d, index.items[at]))
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert sum(r.doc_id == 104 for r in found) == 2
    assert {102, 103, 104} <= {r.doc_id for r in found}
    in_blocks = decontamination.contaminated(frame, bench, block=300).collect()
    assert sorted(map(str, in_blocks)) == sorted(map(str, found))
    assert decontamination.contaminated(frame, bench.where("false")).count() == 0
    assert decontamination.contaminated(frame.where("false"), bench).count() == 0
    clean = {r.doc_id for r in decontamination.keep_clean(frame, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_replaced_words(spark):
    item = prose(800, 30)
    words = item.split()
    every_tenth = " ".join("zzzzq"[: len(w)] if i % 12 == 6 else w for i, w in enumerate(words))
    short = "what is the boiling point of pure xenon?"
    docs = [(1, f"{prose(1, 40)} {every_tenth} {prose(2, 40)}"), (2, f"{prose(3, 40)} {short.replace('pure', 'kold')} {prose(4, 9)}"), (3, "so 42 kelvin, they say"), (4, prose(5, 80))]
    bench = [(1, item), (2, short), (3, "42 kelvin"), (4, "qy"), (5, "they sax in")]
    docs += [(5, "it is qy"), (6, "indeed they say in town")]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 2), (3, 3), (5, 4), (6, 5)}


@pytest.mark.parametrize("q,length,held", [(8, 60, 1 << 21), (8, 60, 40), (5, 80, 1 << 21), (6, 64, 200)])
def test_hits_against_brute_force(monkeypatch, q, length, held):
    monkeypatch.setattr(decontamination, "HELD", held)
    monkeypatch.setattr(decontamination, "ALIGNED", 3)
    draw = np.random.default_rng(q + length)
    rows = [(i, prose(900 + i, 1 + 2 * i)[: 3 + 13 * i]) for i in range(8)] + [(20, "aaaaaaaaaaaaaaaaaaaaaaaaa")]
    index = decontamination.Index.of(rows, q, length, 0.1)
    texts = ["", "a" * 300]
    for i in range(30):
        part = list(index.passages[i % len(index.passages)][1])
        for _ in range(i % 8):
            at = int(draw.integers(len(part)))
            part[at : at + int(draw.integers(2))] = ["#"] * int(draw.integers(2))
        texts.append(decontamination.normal(prose(i, 12) + " " * (i % 2) + "".join(part) + " " * (i % 3) + prose(i + 50, i % 9)))
    want = {(t, n) for t, text in enumerate(texts) for n, (_, part, edits) in enumerate(index.passages) if text and slow_distance(part, text) <= edits}
    found = list(decontamination.hits(texts, index))
    assert {(t, n) for t, n, *_ in found} == want
    for t, n in want:
        assert min(used for a, b, _, used in found if (a, b) == (t, n)) == slow_distance(index.passages[n][1], texts[t])


# --- mixing


def slow_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        shares = sum(weight[s] for s in names if s not in stopped)
        over = {s for s in names if s not in stopped and rest * weight[s] / shares > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in stopped else rest * weight[s] / shares for s in names}
        stopped |= over


def test_mixing(spark):
    draw = np.random.default_rng(1)
    rows = [(i, prose(i, int(draw.integers(1, 200))), ["a", "b", "é", "Z", None][int(draw.integers(5))]) for i in range(600)]
    rows += [(i, prose(i, 40), "tiny") for i in range(1000, 1004)] + [(1100, None, "none"), (1101, "", "none"), (1101, "", "none"), (None, "x y", "a")]
    docs = spark.createDataFrame([(d, t, s, 1) for d, t, s in rows], "doc_id long, text string, source string, size int")
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = slow_targets(sizes)
    found = mixing.mixed(docs).collect()
    assert len(found) == len(rows)
    source = {d: s for d, _, s in rows}
    taken: dict = {}
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, goal in want.items():
        assert taken[s] == pytest.approx(goal, rel=0.02, abs=20)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mixed(docs.where("false")).count() == 0


def test_newton_rate(spark):
    pairs = [(1000, 1.0), (1000, 3000.0), (7, 6.5), (10**12, 10.0**9), (0, 0.0), (5, 0.0)]
    frame = spark.createDataFrame(pairs, "s long, t double")
    from pyspark.sql import functions as F

    for r in frame.select("s", "t", mixing.rate(F.col("s"), F.col("t")).alias("r")).collect():
        assert r.r == pytest.approx(r.t / r.s if r.s else 0.0, rel=1e-9)


# --- tool calls

SCHEMAS = {"f": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "integer", "minimum": 0}, "y": {"type": "array", "items": {"type": "string"}}}}}


def test_linked(spark):
    calls = [
        (1, "a", 0, "f", '{"x": 1}', None), (1, "b", 2, "f", '{"y": ["é"], "x": 2}', "a"), (1, "c", 1, "f", '{"x": -1}', "b"),
        (1, "d", 3, "g", "{}", "missing"), (1, "e", 4, "f", "{", "f"), (1, "f", 5, "f", '{"x": true}', "e"), (1, "g", 9, "f", '{"z": 1}', "f"),
        (1, "h", 6, "f", None, None), (1, "a", 7, "f", '{"x": 9}', "b"), (2, "a", 0, "f", '{"x": 3}', "a"), (None, "a", 0, "f", "{}", None), (2, None, 0, "f", "{}", None),
        (3, "n", 0, "f", '{"x": NaN}', None),
    ] + [(5, f"k{i}", i, "f", '{"x":1}', f"k{i - 1}" if i else None) for i in range(40)]
    results = [(1, "a", 1, "fine"), (1, "a", 0, None), (1, "b", 3, 'say "hi"\n'), (9, "q", 1, "lost"), (5, "k39", 80, "end")]
    c = spark.createDataFrame([(*r, "extra") for r in calls], "conv_id long, call_id string, turn long, name string, arguments string, after string, depth string")
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    found = {(x.conv_id, x.call_id): x for x in tool_calls.linked(c, r, SCHEMAS).collect()}
    assert set(found) == {(a, b) for a, b, *_ in calls if a is not None and b is not None}
    depth = {k: v.depth for k, v in found.items()}
    assert [depth[1, k] for k in "abcdefgh"] == [0, 1, 2, 0, -1, -1, -1, 0]
    assert depth[2, "a"] == -1 and [depth[5, f"k{i}"] for i in range(40)] == list(range(40))
    assert found[1, "a"].turn == 0 and found[1, "b"].status == "ok"
    assert found[1, "b"].message == '{"arguments":{"x":2,"y":["é"]},"depth":1,"id":"b","name":"f","result":"say \\"hi\\"\\n"}'
    assert json.loads(found[1, "a"].message)["result"] is None and found[1, "a"].status == "ok"
    assert found[1, "c"].status == "invalid: $.x: out of bounds"
    assert found[1, "d"].status == "invalid: unknown tool"
    assert found[1, "e"].status == found[1, "h"].status == found[3, "n"].status == "invalid: $: not JSON"
    assert found[1, "f"].status == "invalid: $.x: not of type integer"
    assert found[1, "g"].status == "invalid: $.x: missing; $.z: not allowed"
    assert found[2, "a"].status == "cycle" and found[5, "k3"].status == "no result" and found[5, "k39"].status == "ok"
    assert tool_calls.linked(c.where("false"), r, SCHEMAS).count() == 0
