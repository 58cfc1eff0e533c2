"""Queries with SQL against it; the others against brute force over the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from alertloom.llm.queries import QUERIES, SQL, tokenizer_file
from checks.compare import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.fixture(scope="module")
def texts(con):
    return [(d, t or "") for d, t in con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, con, name):
    assert compare(spark, sf, name, QUERIES[name], SQL[name], con).startswith("equal")


def groups(n, links):
    above = list(range(n))

    def top(x):
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def close(values, radius=3):
    v = np.array(values, np.uint64)
    return [(i, int(j) + i + 1) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= radius)]


def majority(hashes):
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_op2(spark, sf, texts):
    prints = []
    for _, text in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        prints.append(majority([xxhash.xxh64_intdigest(s, 42) for s in shingles]))
    want = {(texts[i][0], f"{prints[i]:016x}", texts[g][0]) for i, g in enumerate(groups(len(texts), close(prints)))}
    assert {tuple(r) for r in QUERIES["op2_simhash_dedup"](spark, sf).collect()} == want


def test_op3(spark, sf, con, texts):
    rows = {r.doc_id: r for r in QUERIES["op3_quality"](spark, sf).collect()}
    assert set(rows) == {d for d, _ in texts}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    held = [(rows[d].predicted, q) for d, q in con.execute("SELECT doc_id, quality FROM labels").fetchall() if rows[d].held_out]
    assert sum(p == q for p, q in held) / len(held) >= 0.85


def test_op4(spark, sf, texts):
    from tokenizers import Tokenizer

    library, want, start = Tokenizer.from_file(tokenizer_file()), set(), 0
    for doc, text in texts:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.add((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in QUERIES["op4_token_output"](spark, sf).collect()} == want


def test_op5(spark, sf, con):
    rows = QUERIES["op5_mixing"](spark, sf).collect()
    posterior, n, rate = np.array([r.posterior for r in rows]), np.array([r.n_tokens for r in rows]), np.array([r.rate for r in rows])
    assert np.allclose(posterior.sum(axis=1), 1) and (rate >= 0).all()
    share = n @ posterior / n.sum()
    goal = share**0.7 / (share**0.7).sum()
    goal *= (share / goal).max()
    assert np.allclose((n * rate) @ posterior / n.sum(), goal, atol=5e-4)
    langs = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    domains = sorted(set(langs.values()))
    assert np.mean([domains[int(np.argmax(r.posterior))] == langs[r.doc_id] for r in rows]) > 0.9


def line_pairs(lines):
    """Pairs of lines that share two of four sampled words and half of their prints' bits."""
    buckets, prints = defaultdict(list), []
    for i, x in enumerate(lines):
        sample = sorted({(15 - (0 if w < "a" else min(len(w), 15))) << 59 | xxhash.xxh64_intdigest(w, 42) >> 5 for w in x.split(" ")})[:16]
        prints.append({w % 64 for w in sample})
        for pair in combinations(sample[:4], 2):
            buckets[pair].append(i)
    met = {p for b in buckets.values() for p in combinations(b, 2)}
    return [(i, j) for i, j in met if 2 * len(prints[i] & prints[j]) + 1 >= max(len(prints[i]), len(prints[j]))]


def test_op6_recall(spark, sf, texts):
    """Of all pairs of different lines at edit similarity 0.8 or more, at least 0.9 end in one group."""
    from alertloom.llm.line_dedup import line_groups

    docs = spark.createDataFrame([(d, t) for d, t in texts], "doc_id long, text string").coalesce(1)
    lines = sorted({n for _, t in texts for line in t.split("\n") if (n := " ".join(w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower()) if w))})
    one = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "a int, x string").repartition(8)
    other = one.selectExpr("a as b", "x as y")
    limit = "cast(floor(0.2 * greatest(length(x), length(y)) + 1e-9) as int)"
    near = one.join(other, F.expr(f"a < b and abs(length(x) - length(y)) <= {limit}")).where(f"levenshtein(x, y, {limit}) >= 0").collect()
    _, repeats = line_groups(docs)
    stay = {r.key: r.stay for r in repeats.collect()}
    key = lambda x: hashlib.md5(x.encode()).digest()
    found = [key(r.x) in stay and stay[key(r.x)] == stay.get(key(r.y)) for r in near]
    assert len(found) >= 10 and sum(found) >= 0.9 * len(found)


def test_op6(spark, sf, texts):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    places = defaultdict(list)
    for r, (_, text) in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower()) if w]
            normal = " ".join(words) or line.strip(" \t\r\x0b\x0c")
            if normal:
                places[normal].append((r, k))
    lines = list(places)
    links = [(i, j) for i, j in line_pairs(lines) if distance(lines[i], lines[j]) <= int(0.2 * max(len(lines[i]), len(lines[j])) + 1e-9)]
    members = defaultdict(list)
    for i, g in enumerate(groups(len(lines), links)):
        members[g] += places[lines[i]]
    gone = defaultdict(set)
    for own in members.values():
        for r, k in sorted(own)[1:]:
            gone[r].add(k)
    want = set()
    for r, (doc, text) in enumerate(texts):
        parts = text.split("\n")
        kept = "\n".join(p for k, p in enumerate(parts) if k not in gone[r])
        want.add((doc, len(parts), len(gone[r]), hashlib.sha256(kept.encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op6_line_dedup"](spark, sf).collect()} == want


def repeats(datas, length=200):
    count = Counter(d[k : k + length] for d in datas for k in range(len(d) - length + 1))
    out = []
    for d in datas:
        covered = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                covered[k : k + length] = True
        spans = int((np.diff(covered.astype(int), prepend=0) == 1).sum())
        out.append((len(d), int(covered.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~covered].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("group", [2048, 1])
def test_op10(spark, sf, texts, group, monkeypatch):
    """Also with every anchor treated as one of too many runs."""
    from alertloom.llm import repeats as module

    monkeypatch.setattr(module, "GROUP", group)
    want = {(d, *r) for (d, _), r in zip(texts, repeats([t.encode() for _, t in texts]), strict=True)}
    assert {tuple(r) for r in QUERIES["op10_repeats"](spark, sf).collect()} == want


def test_pipeline(spark, sf, con):
    """Every stage against what it must do on its own input."""
    import corpus_pipeline
    from alertloom.llm.common import settled
    from alertloom.llm.quality import fit_quality, score_quality
    from alertloom.llm.queries import table

    docs = table(spark, sf, "documents")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(settled(stage(spark, steps[-1], sf), name.replace(" ", "-")))
    assert all(s.columns == docs.columns for s in steps[:5])
    rows = [s.collect() for s in steps]
    good = {r.doc_id for r in score_quality(docs, fit_quality(docs, table(spark, sf, "labels"))).where("score >= 0.5").collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if r.doc_id in good)

    def shingles(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
        return [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []

    prints = [majority([xxhash.xxh64_intdigest(x, 42) for x in shingles(r.text)]) for r in rows[1]]
    firsts = {}
    for r, g in zip(rows[1], groups(len(rows[1]), close(prints)), strict=True):
        firsts[g] = min(firsts.get(g, r.doc_id), r.doc_id)
    assert {r.doc_id for r in rows[2]} == set(firsts.values())
    items = [re.findall(r"\w+", t.lower()) for _, t in con.execute("SELECT * FROM benchmark").fetchall()]
    leaked = {r.doc_id for r in rows[2] if any(" ".join(i) in " ".join(re.findall(r"\w+", (r.text or "").lower())) for i in items)}
    assert leaked and leaked == {r.doc_id for r in rows[2]} - {r.doc_id for r in rows[3]}
    assert {r.doc_id for r in rows[4]} <= {r.doc_id for r in rows[3]} and len(rows[4]) >= 0.95 * len(rows[3])
    assert Counter(r.doc_id for r in rows[4]) == Counter(r.doc_id for r in rows[5])
    starts = sorted((r.start, r.n_tokens) for r in rows[5])
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
