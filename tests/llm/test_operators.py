"""Defined results on odd input, exact round trips, and the parts by themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from alertloom.llm import chat, common, decontaminate, exact_dedup, filter_audit, license_scan, line_dedup, minhash_dedup, mixing, prefix_trie, quality, repeats, simhash_dedup, token_output
from alertloom.llm.queries import tokenizer_file

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


# -- exact dedup --------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [1 << 20, 40, 1])
def test_trie_spills_by_subtree(limit):
    random.seed(3)
    words = [b"".join(random.choice([b"a", b"b", b"cc"]) for _ in range(random.randrange(12))) for _ in range(500)] + [b"", b"x" * 300, b"x" * 301]
    trie = exact_dedup.PatriciaTrie(limit)
    for k, w in enumerate(words):
        trie.insert(w, (False, k, k), 1, [k])
    got = {text: (t.best[1], t.count, sorted(t.rows)) for text, t in trie.items()}
    want = {w: (words.index(w), words.count(w), [k for k, x in enumerate(words) if x == w]) for w in words}
    assert got == want


def test_trie_memory_is_bounded():
    """Short texts are mostly nodes, and those count; texts that come back later meet again."""
    import tracemalloc

    limit, n = 4 << 20, 120_000
    trie = exact_dedup.PatriciaTrie(limit)
    tracemalloc.start()
    for k in range(n):
        trie.insert(hashlib.md5(str(k).encode()).digest()[:8], (False, k, k), 1, [k])
    for k in range(1000):
        trie.insert(hashlib.md5(str(k).encode()).digest()[:8], (False, k, n + k), 1, [n + k])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * limit and trie.spilled
    counts = Counter(t.count for _, t in trie.items())
    assert counts == {1: n - 1000, 2: 1000}


def test_splits_leave_in_parts(spark, odd_docs, stored, monkeypatch):
    docs = stored(odd_docs.union(odd_docs).union(odd_docs).coalesce(1))
    whole = sorted(map(str, exact_dedup.exact_groups(docs).collect()))
    real = exact_dedup._split_owners

    def small(sign, limit):
        run = real(sign, limit)

        def each(batches):
            exact_dedup.SPLIT_ROWS = 1
            for b in batches:
                yield from run(b.slice(k, 5) for k in range(0, b.num_rows, 5))

        return each

    monkeypatch.setattr(exact_dedup, "_split_owners", small)
    assert sorted(map(str, exact_dedup.exact_groups(docs).collect())) == whole


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_odd(spark, odd_docs, stored, keep):
    docs = stored(odd_docs)
    rows = exact_dedup.exact_groups(docs, keep=keep, limit=1000).collect()
    assert len(rows) == 14
    same = [r for r in rows if r.doc_id in (1, 2)]
    assert {r.keep_id for r in same} == {1 if keep == "smallest" else 2} and {r.group_size for r in same} == {3}
    assert sum(r.kept for r in same) == 1
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 3 and {r.keep_id for r in empty} == {3 if keep == "smallest" else 4}
    assert exact_dedup.exact_groups(spark.createDataFrame([], EMPTY)).count() == 0


def test_exact_all_null(spark, stored):
    docs = stored(spark.createDataFrame([(None, "t"), (None, "T")], "doc_id long, text string"))
    rows = exact_dedup.exact_groups(docs).collect()
    assert [r.keep_id for r in rows] == [None, None] and sum(r.kept for r in rows) == 1


# -- SimHash ------------------------------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=5), st.integers(65, 300), st.randoms())
def test_forest_connects_like_all_pairs(centres, n, rng):
    values = {rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & 2**64 - 1 for _ in range(n)}
    values = np.array(sorted(values), np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    links = simhash_dedup.forest(values)
    assert len(links) < len(values) and all((a ^ b).bit_count() <= 3 for a, b in links)
    index = {int(v): k for k, v in enumerate(values)}
    joined = np.eye(len(values), dtype=bool)
    for a, b in links:
        joined[index[a], index[b]] = joined[index[b], index[a]] = True

    def reach(m):
        while True:
            more = (m.astype(int) @ m.astype(int)) > 0
            if (more == m).all():
                return m
            m = more

    assert (reach(joined) == reach(near)).all()
    i, j = np.triu_indices(len(values), 1)
    if len(i):
        assert (simhash_dedup.close_pairs(values[i] ^ values[j]) == near[i, j]).all()


def test_tiles_lose_no_link(spark):
    random.seed(5)
    base = random.getrandbits(64)
    values = sorted({base ^ sum(1 << b for b in random.sample(range(64), random.randrange(5))) for _ in range(300)})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fp long")
    roots = [common.connected(simhash_dedup.fingerprint_links(df, tile), "a", "b").groupBy("root").count().collect() for tile in (4096, 20)]
    assert sorted(map(tuple, roots[0])) == sorted(map(tuple, roots[1])) and roots[0]


def test_pieces_give_the_whole(monkeypatch):
    text = (" ".join(f"w{k % 37}" for k in range(3000)) + " \n x").encode()
    whole = simhash_dedup.fingerprint(text)
    monkeypatch.setattr(simhash_dedup, "PIECE", 50)
    assert simhash_dedup.fingerprint(text) == whole and simhash_dedup.fingerprint(b" \t") == 0 == simhash_dedup.fingerprint(b"")


def test_simhash_odd(spark, odd_docs, stored):
    docs = stored(odd_docs)
    rows = {(r.doc_id, r.fingerprint): r for r in simhash_dedup.simhash_groups(docs).collect()}
    assert {d for (d, f) in rows if f == "0" * 16} == {3, 4, None, 8} and rows[None, "0" * 16].component_id == 3
    kept = simhash_dedup.near_distinct(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 in ids and 4 not in ids and ids.count(None) == 1 and 5 in ids and 6 not in ids
    assert simhash_dedup.near_distinct(spark.createDataFrame([], EMPTY)).count() == 0


def test_connected_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in common.connected(edges, "a", "b").collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert common.connected(edges.limit(0), "a", "b").count() == 0


# -- quality ------------------------------------------------------------------------------------


def test_quality_odd(spark, odd_docs, stored):
    docs = stored(odd_docs)
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (5, 0), (None, 1), (9, None), (7, 3)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep_quality(docs, model, least=0.0)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    none = quality.fit_quality(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), none).count() == 0


def test_quality_never_learns_held_out_rows(spark, stored):
    import zlib

    docs = stored(spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "good plain words here").otherwise("BAD!!! ###").alias("text")))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    lied = docs.select("doc_id", F.when(quality.held_out("doc_id"), F.col("doc_id") % 2).otherwise((F.col("doc_id") + 1) % 2).cast("int").alias("quality"))
    a, b = (sorted(map(tuple, quality.score_quality(docs, quality.fit_quality(docs, x)).collect())) for x in (labels, lied))
    assert a == b and all((s > 0.5) == (d % 2 == 0) for d, s in a)
    assert sum(zlib.crc32(str(d).encode()) % 3 == 1 for d, _ in a) > 50


# -- tokens -------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=300), st.integers(9, 16))
def test_code_lengths(counts, limit):
    import heapq

    lengths = token_output.code_lengths(dict(enumerate(counts)), limit)
    assert max(lengths.values()) <= limit and sum(2.0**-b for b in lengths.values()) <= 1
    heap = [(c, k, {k: 0}) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    serial = len(counts)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a + b, serial, {k: d + 1 for k, d in (x | y).items()}))
        serial += 1
    free = heap[0][2]
    if len(counts) > 1 and max(free.values()) <= limit:  # without need of the limit the code is Huffman's
        assert sum(lengths[k] * c for k, c in enumerate(counts)) == sum(free[k] * c for k, c in enumerate(counts))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=2000))
def test_code_round_trip(ids):
    code = token_output.Code(token_output.code_lengths(Counter(ids)))
    payload, gaps = code.pack(np.array(ids))
    assert code.unpack(payload, gaps, len(ids)).tolist() == ids


ODD_TEXTS = ["It's THE end!! 12¾ it''s ''s ß µª x'S \n\t a\r\nb don't'll ¡olé!", "<|endoftext|> b <|ENDOFTEXT|>", "naïve İstanbul ŉ \xa0 a\x1cb", "é́ é ΑΣ Σ", "", " ", "日本語 text"]


@settings(max_examples=80, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(st.characters(max_codepoint=0x17F), max_size=80), st.sampled_from(ODD_TEXTS)))
def test_encoder_is_the_library(text):
    with open(tokenizer_file(), encoding="utf-8") as f:
        encoder = token_output.encoder_of(f.read())
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(encoder.encode(text), encoder.width).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_tokens_odd(spark, odd_docs, stored, tmp_path):
    docs = stored(odd_docs)
    token_output.write_token_ids(docs, str(tmp_path / "ids"), tokenizer_file(), 2)
    rows = sorted(token_output.read_token_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    assert len(rows) == 14 and [r.doc_id for r in rows][:2] == [None, None]
    assert [r.doc_id for r in rows][2:] == sorted(r.doc_id for r in rows[2:])
    assert all(a.start + a.n_tokens == b.start and len(a.ids) == 4 * a.n_tokens for a, b in zip(rows, rows[1:], strict=False))
    token_output.write_token_ids(docs.limit(0), str(tmp_path / "none"), tokenizer_file(), 2)
    assert token_output.read_token_ids(spark, str(tmp_path / "none")).count() == 0


# -- mixing -------------------------------------------------------------------------------------


def test_mixing_odd(spark, odd_docs, stored):
    docs = stored(odd_docs)
    model = mixing.fit_domains(docs, docs.select("doc_id", "lang"), "lang")
    assert model.domains == ["de", "en", "es", "fr"]
    fitted = mixing.fit_rates(common.settled(mixing.domain_posteriors(docs, model), "p"), model, {"en": 1.0, "fr": 1.0, "xx": 5.0})
    assert fitted.ignored == ["xx"] and sorted(fitted.missed) == model.domains
    mixed = mixing.mix(docs, fitted)
    assert mixed.columns == docs.columns and mixed.count() > 0
    rates = mixing.document_rates(mixing.domain_posteriors(docs, model), fitted).collect()
    assert len(rates) == 14 and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rates)
    nothing = mixing.fit_domains(docs, docs.select("doc_id", "lang").limit(0), "lang")
    assert {r.rate for r in mixing.document_rates(mixing.domain_posteriors(docs, nothing), mixing.fit_rates(mixing.domain_posteriors(docs, nothing), nothing)).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), fitted).count() == 0
    with pytest.raises(ValueError, match="positive target"):
        mixing.fit_rates(mixing.domain_posteriors(docs, model), model, {"xx": 1.0})


def test_rates_reach_targets(spark):
    rows = [(k, 100 + k % 7, [256, 0] if k % 4 else [16, 240]) for k in range(400)]
    posteriors = spark.createDataFrame(rows, "doc_id long, n_tokens long, parts array<int>")
    model = mixing.fit_rates(posteriors, mixing.MixModel(["a", "b"]), {"a": 1.0, "b": 1.0}, keep_all=False)
    got = mixing.document_rates(posteriors, model).collect()
    totals = np.array([np.array(r.posterior) * r.rate * r.n_tokens for r in got]).sum(axis=0)
    assert np.allclose(totals / totals.sum(), 0.5, atol=1e-3)
    assert abs(sum(r.copies for r in got) / sum(r.rate for r in got) - 1) < 0.1


def test_carried_rates_and_misses(spark, monkeypatch):
    """Rates written beside the cells change no result, and targets that cannot be met are reported."""
    rng = np.random.default_rng(8)
    parts = [[int(x) for x in rng.multinomial(mixing.PARTS, d)] for d in rng.dirichlet([0.3, 0.3], 80)]
    posteriors = spark.createDataFrame([(k, 50 + k, p) for k, p in enumerate(parts)], "doc_id long, n_tokens long, parts array<int>").coalesce(1)
    fits = []
    for carry in (2, 10**6):
        monkeypatch.setattr(mixing, "CARRY", carry)
        fits.append(mixing.fit_rates(posteriors, mixing.MixModel(["a", "b"]), {"a": 1.0, "b": 9.0}, keep_all=False))
    assert len(fits[0].residuals) == len(fits[1].residuals) > 4
    rates = [np.array([r.rate for r in mixing.document_rates(posteriors, m).collect()]) for m in fits]
    assert np.allclose(rates[0], rates[1], atol=1e-9) and fits[0].missed.keys() == {"a", "b"}
    totals = np.array([np.array(p) / mixing.PARTS * (50 + k) for k, p in enumerate(parts)])
    assert np.allclose(list(fits[0].missed.values()), rates[0] @ totals / totals.sum() - [0.1, 0.9], atol=1e-9)
    # All posteriors alike: no rates can move the domains apart.
    alike = spark.createDataFrame([(k, 10, [128, 128]) for k in range(4)], "doc_id long, n_tokens long, parts array<int>")
    stuck = mixing.fit_rates(alike, mixing.MixModel(["a", "b"]), {"a": 1.0}, keep_all=False)
    assert stuck.missed["a"] < -0.4 and stuck.missed["b"] > 0.4


# -- MinHash ------------------------------------------------------------------------------------


def shingles(text, words=4):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()


def linked_groups(texts):
    """For each text the least index that links of Jaccard 0.8 and more reach; texts without words stand alone."""
    sets, want = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if g == high else g for g in want]
    return want


def changed(rng, words, changes):
    other = list(words)
    for _ in range(changes):
        other[rng.randrange(len(other))] = f"x{rng.randrange(10**6)}"
    return other


def test_minhash_against_all_pairs(spark, stored):
    """Pairs at Jaccard 0.8 and more are linked, and no others, near the threshold too."""
    rng = random.Random(5)
    texts = ["", None, " \t\n", "one two", "ONE two", "three", "one two three", "a b c d", "a b c d a b c d"]
    for _ in range(100):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 400))]
        texts.append(" ".join(words))
        texts += [" ".join(changed(rng, words, max(1, c * len(words) // 160))) for c in (1, 2, 3, 4, 5, 8)]
    rows = minhash_dedup.minhash_groups(stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    want = linked_groups(texts)
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(want))
    assert all(r.kept == (want[r.doc_id] == r.doc_id) and r.n_shingles == len(shingles(texts[r.doc_id])) for r in rows)


def test_minhash_crowd(spark, stored):
    """Many copies of one text that changed more or less: chains are followed, copies beyond the threshold stay apart and are not paired out."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(150)]
    texts = [" ".join(changed(rng, words, rng.randrange(2, 12))) for _ in range(250)]
    seen = []
    real = minhash_dedup._rare_pairs

    def counted(members, percent):
        pairs = real(members, percent)
        seen.append(pairs.count())
        return pairs

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(minhash_dedup, "_rare_pairs", counted)
        rows = minhash_dedup.minhash_groups(stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    want = linked_groups(texts)
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(want)) and 1 < len(set(want)) < 250
    assert seen[0] < 250 * 250 / 8


def test_minhash_odd(spark, odd_docs, stored):
    docs = stored(odd_docs)
    rows = minhash_dedup.minhash_groups(docs).collect()
    assert len(rows) == 14
    got = Counter((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in rows)
    assert got[1, True, 1, True] == 1 and got[2, True, 1, False] == 2
    assert got[3, False, 3, True] == got[4, False, 4, True] == got[8, False, 8, True] == 1
    assert got[None, False, None, False] == 1 and got[None, True, None, False] == 1
    assert got[5, True, 5, True] == 1 and got[6, True, 5, False] == 1 and got[7, True, 7, True] == 1 and got[11, True, 11, True] == 1
    assert minhash_dedup.minhash_groups(docs.limit(0)).count() == 0


def test_tables_pair_halves():
    """Every pair of a half key of each collection makes a table; a set's keys do not depend on how it is cut."""
    hashes = np.random.default_rng(1).integers(0, 1 << 64, 9000, np.uint64)
    keys = minhash_dedup.half_keys(hashes)
    assert len(set(keys.tolist())) == 2 * minhash_dedup.HALVES
    assert (keys == minhash_dedup.half_keys(hashes[::-1])).all()


def test_short_pieces_keep_their_words(monkeypatch):
    text = b"a b c d e f g"
    whole = minhash_dedup.shingle_set(text).tolist()
    monkeypatch.setattr(simhash_dedup, "PIECE", 2)
    assert minhash_dedup.shingle_set(text).tolist() == whole and len(whole) == 4


# -- lines --------------------------------------------------------------------------------------


def test_lines_odd(spark, odd_docs, stored):
    docs = stored(odd_docs)
    rows = {}
    for r in line_dedup.dedup_lines(docs).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) == 14
    removed = sorted((r.n_removed, r.n_lines) for d in (9, 10) for r in rows[d])
    assert sum(n for n, _ in removed) == 2
    assert [sorted(r.n_removed for d in (1, 2) for r in rows[d])] == [[0, 1, 1]]
    assert rows[3][0].text == "" and rows[4][0].n_lines == 1 and rows[8][0].text == " \t\n "
    assert {rows[5][0].n_removed, rows[6][0].n_removed} == {0, 1}  # 20,000 words
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_short_and_unspaced_lines(spark, stored):
    """Exact repeats go however few words they have, in scripts without spaces too; blank lines stay."""
    docs = stored(spark.createDataFrame([(1, "Yes\n\n今天天气很好我们去公园\n-----\n "), (2, "yes!\n\n今天天气很好我们去公园\n-----\n=====\n ")], "doc_id long, text string").coalesce(1))
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert {n for n, _ in got.values()} == {5, 6} and sum(r for _, r in got.values()) == 3


def line_sample(normal):
    """The words that stand for a line, by the rule's statement."""
    order = {(15 - (0 if w < "a" else min(len(w), 15))) << 59 | xxhash.xxh64_intdigest(w, 42) >> 5 for w in normal.split(" ") if w}
    return sorted(order)[:16]


def test_line_samples(spark):
    lines = ["one", "two two two", "a b c d e f g", " ".join(f"w{k * k % 403}" for k in range(33_000)), "2024 01 01 started the server again", "éé zwölf boxkämpfer jagen viktor"]
    for r in spark.createDataFrame([(x,) for x in lines], "x string").select("x", line_dedup.sampled_words("x").alias("s")).select("*", line_dedup._print("s").alias("fp")).collect():
        assert r.s == line_sample(r.x) and {k for k in range(64) if r.fp >> k & 1} == {w % 64 for w in r.s}
    row = spark.createDataFrame([("今天天气",)], "x string").select(line_dedup.sampled_words("x").alias("s")).first()
    assert row.s == line_sample("今 天 气")


def test_like_lines_are_found(spark, stored):
    """Lines with one or two changed words are found at every length, and unlike lines that share words stay."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    rows, pairs = [], []
    for n in (8, 12, 20, 40, 900):
        for k in range(40 if n < 900 else 4):
            words = [word() for _ in range(n)]
            other = list(words)
            for at in rng.sample(range(n), 1 if n < 12 else 2):
                spot = rng.randrange(len(words[at]))
                other[at] = words[at][:spot] + "0" + words[at][spot + 1 :]
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    # Two of the sampled words are the same, the rest is not; long lines are judged by characters too.
    for n in (10, 300):
        for _ in range(2):
            rows.append((len(rows), " ".join(["internationalisation", "notwithstanding", *["".join(rng.choices("abcdefghijklm", k=5)) for _ in range(n)]])))
    for _ in range(2):
        rows.append((len(rows), "one blob of two thousand and five hundred letters " + "".join(rng.choices("abcdefghijklmnop", k=2500))))
    gone = {r.doc_id for r in line_dedup.dedup_lines(stored(spark.createDataFrame(rows, "doc_id long, text string"))).where("n_removed = 1").collect()}
    assert all(len(gone & {a, b}) == 1 for a, b in pairs) and len(gone) == len(pairs)


def test_lines_by_pieces(spark):
    """The sum over pieces is never less than the distance, and tells like lines with words changed, added and dropped."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdéfg今", k=rng.randint(1, 7)))
    rows = [("", "", True), ("a", "", False), ("a b", "b a", False), ("thor " * 400 + "end", "thor " * 440 + "end", True), ("a " * 300 + "b " * 300 + "c", "a " * 300 + "d " * 300 + "c", False)]
    for n in (1, 5, 30, 120, 600):
        for _ in range(6):
            words = [word() for _ in range(n)]
            other = list(words)
            for at in rng.sample(range(n), n // 30):
                other[at] = rng.choice(["", word(), f"{word()} {word()}", other[at][1:]])
            rows.append((" ".join(words), " ".join(w for w in other if w), True))
            rows.append((" ".join(words), " ".join(word() for _ in range(n)), False))
    pairs = spark.createDataFrame([(x, y, like, len(x) * 2 // 5) for x, y, like in rows], "x string, y string, alike boolean, most int")
    for r in pairs.select("alike", "most", line_dedup._by_pieces("x", "y", "most").alias("d"), F.levenshtein("x", "y").alias("exact")).collect():
        assert r.d >= min(r.exact, r.most + 1) and (not r.alike or r.d <= r.most // 2)


def test_large_bucket_in_tiles(spark, stored, monkeypatch):
    """A bucket of many different lines, cut into tiles, still gives every like pair."""
    monkeypatch.setattr(line_dedup, "TILE", 4)
    rng = random.Random(6)
    bodies = [" ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(20)) for _ in range(30)]
    lines = [f"internationalisation notwithstanding {b}{end}" for end in ("", " x") for b in bodies]
    docs = stored(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert line_dedup.dedup_lines(docs).where("n_removed = 1").count() == 30


def test_short_like_lines_all_meet(spark, stored):
    """Of lines of up to 32 characters, in one word or with typos in all words, every pair at 0.8 is linked, and only chains of such pairs."""
    rng = random.Random(6)
    base = ["internationalisation", "la ja", "eding enin", "hello world", "abcde", "supercalifragilistic expiali", "one two three four five", "\u00fcber stra\u00dfe gr\u00fcn", "abcd"]
    lines = set(base)
    for x in base:
        for _ in range(14):
            y = list(x)
            for _ in range(rng.randint(1, 5)):
                at = rng.randrange(len(y))
                y[at : at + 1] = rng.choice([[], [rng.choice("abcxyz")], [y[at], rng.choice("abcxyz")]])
            lines.add("".join(y).strip() or "z")
    lines = sorted({" ".join(x.split()) for x in lines})
    lines = [x for x in lines if len(x) <= line_dedup.SHORT]

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            last, row = row, [i]
            for j, q in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != q)))
        return row[-1]

    root = list(range(len(lines)))
    def top(k):
        return k if root[k] == k else top(root[k])

    for a, x in enumerate(lines):
        for b in range(a):
            if distance(x, lines[b]) <= int(0.2 * max(len(x), len(lines[b])) + 1e-9):
                root[top(a)] = top(b)
    groups = len({top(k) for k in range(len(lines))})
    docs = stored(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert line_dedup.dedup_lines(docs).where("n_removed = 0").count() == groups < len(lines) - 30


def test_long_lines_of_few_words_meet(spark, stored):
    """A typo in the one long word of a line, or in each of two, does not hide its like."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    pairs = [(x, x[:k] + "q9" + x[k + 1 :]) for x, k in ((word(n), n // 3) for n in (40, 120, 3000))]
    pairs += [(f"{x} {y}", f"{x[:9]}q9{x[10:]} {y[:7]}q9{y[8:]}") for x, y in ((word(30), word(25)), (word(200), word(90)))]
    docs = stored(spark.createDataFrame(list(enumerate(x for pair in pairs for x in pair)), "doc_id long, text string"))
    assert sorted(r.doc_id // 2 for r in line_dedup.dedup_lines(docs).where("n_removed = 1").collect()) == [0, 1, 2, 3, 4]


def test_crowd_of_like_lines(spark, stored):
    """Many like lines become one group, though the first round only meets the least of each bucket."""
    words = [f"steady{k}" for k in range(80)]
    lines = [" ".join([*words[:k % 80], f"new{k}", *words[k % 80 :]]) for k in range(120)]
    docs = stored(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string"))
    assert line_dedup.dedup_lines(docs).where("n_removed = 0").count() < 40


# -- decontamination ----------------------------------------------------------------------------


def test_decontaminate_odd(spark, odd_docs, stored):
    docs = stored(odd_docs)
    items = spark.createDataFrame(
        [(1, "The SAME line, of seven plain words!"), (2, None), (3, ""), (None, "hello world this is one text"), (4, "x"), (5, "nowhere to be found in any text")], "item_id long, text string"
    )
    rows = sorted(((r.doc_id, r.item_id, r.containment) for r in decontaminate.contaminated(docs, items).collect()), key=str)
    assert rows == sorted([(9, 1, 1.0), (10, 1, 1.0), (1, None, 1.0), (2, None, 1.0), (2, None, 1.0), (11, 4, 1.0)], key=str)
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "4", "5", "6", "7", "8", "None", "None"])
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0 == decontaminate.contaminated(docs, items.limit(0)).count()


def test_short_items_in_long_documents(spark, stored):
    """Items of one to four words, and of scripts without spaces, are found inside longer texts."""
    filler = " ".join(f"f{k}" for k in range(30))
    items = [(1, "Zebra!"), (2, "two words"), (3, "three short words"), (4, "four words in all"), (5, "今天天气很好"), (6, "absent phrase"), (7, "天气")]
    docs = [(k, f"{filler} {text} {filler}") for k, text in items[:4]] + [(5, f"{filler} 我说今天天气很好吗"), (6, f"{filler} phrase absent"), (7, filler), (8, "two")]
    got = decontaminate.contaminated(stored(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (5, 7)}


def test_containment_at_the_threshold(spark, stored):
    """Pairs at 0.8 are found and pairs below are not, for all sizes of items."""
    random.seed(11)
    docs, items, want = [], [], set()
    for n in (5, 6, 9, 14, 20, 45, 120):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        shingles = n - 4
        for cut in range(n):
            part = words[: n - cut]
            filler = [f"f{random.random()}" for _ in range(40)]
            docs.append((n * 1000 + cut, " ".join(filler[:20] + part + filler[20:])))
            if len(part) >= 5 and (len(part) - 4) / shingles >= 0.8 - 1e-9:
                want.add((n * 1000 + cut, n))
    got = decontaminate.contaminated(stored(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


# -- chats --------------------------------------------------------------------------------------

TURN_SCHEMA = "conv_id long, turn long, role string, text string, span long, blocks string"


def test_chat_odd(spark):
    marks = "<|turn|>user<|body|>a</s>&lt;[INST]&amp;&#60;<|end|><<SYS>>"
    rows = [
        (1, 0, "user", marks), (1, 1, "assistant", marks), (1, 2, "assistant", ""), (1, 3, "assistant", None), (1, 300, "assistant", "far"), (1, 301, None, "x"),
        (2, 0, "assistant", "only"), (None, 0, "user", "lost"), (3, None, "user", "first"), (3, 0, "user", "second"), (3, 0, "user", "second"), (4, 0, "<|body|>", "r"),
    ]
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], TURN_SCHEMA)
    formatted = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_chats(formatted.select("conv_id", "formatted")).collect()}
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: -1 if r[1] is None else r[1])]
        assert [(t.role, t.text) for t in got[conv].turns] == own
    for r in formatted.collect():
        assert sum(x.chars for x in r.loss_runs) == len(r.formatted)
        at, learnt = 0, []
        for x in r.loss_runs:
            if x.loss:
                learnt.append(r.formatted[at : at + x.chars])
            at += x.chars
        turns = [t.text for t in got[r.conv_id].turns if t.role == "assistant"]
        assert len(learnt) == len(turns) and all("</s>" not in x and "<|" not in x for x in learnt)
    assert got[1].formatted.count("<|turn|>") == 3  # adjacent turns of one role share a block
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_long(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 5 < 3, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    row = chat.read_chats(chat.format_chats(df).select("conv_id", "formatted")).first()
    assert [t.text for t in row.turns] == [f"t{k}" for k in range(3000)]


# -- licenses -----------------------------------------------------------------------------------


def test_licenses_odd(spark, odd_docs, stored):
    docs = spark.createDataFrame(
        [(1, "CC-BY cc by, all RIGHTS reserved"), (2, None), (3, ""), (None, "Licensed under the Apache License, Version 2.0."), (4, "cc by cc by"),
         (4, "x. Released under the MIT\nLicense"), (5, "Released under the MIT License! 5"), (6, "Ééccé by")], "doc_id long, text string",
    ).withColumn("row", F.lit("clash")).withColumn("text2", F.col("text"))
    rows = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in license_scan.scan_licenses(stored(docs)).collect()), key=str)
    assert rows == sorted([
        (1, 7, 3, 0, 4, "cc-by,reserved", "cc-by,reserved", 1.0), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0),
        (None, 8, 0, None, None, "", "apache", 1.0), (4, 4, 2, 0, 2, "cc-by", "cc-by", 1.0), (4, 6, 0, None, None, "", "mit", 1.0),
        (5, 6, 0, None, None, "", "mit", 1.0), (6, 2, 0, None, None, "", "", 0.0),
    ], key=str)
    assert license_scan.scan_licenses(stored(odd_docs, "o")).count() == 14
    assert license_scan.scan_licenses(stored(odd_docs, "o").limit(0)).count() == 0


def test_wrapped_licenses(spark, stored):
    """Notices that are wrapped as files have them get their labels; a blank line ends a block."""
    docs = [
        (1, "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the Software)"),
        (2, "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions\r\nare met:"),
        (3, " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published"),
        (4, "Released under the\n \nMIT License"), (5, "Released under the\r\n\r\nMIT License"),
    ]
    labels = {r.doc_id: r.labels for r in license_scan.scan_licenses(stored(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    assert labels[1] == "mit" and labels[2] == "bsd" and "lgpl" in labels[3].split(",") and labels[4] == labels[5] == ""


def test_scattered_words_are_no_notice(spark, stored):
    """Words of a template that lie far apart in a block without an end give no label; a notice inside it does."""
    filler = [f"f{k}" for k in range(600)]
    scattered = "\n".join([*filler[:200], "all", *filler[200:400], "rights", *filler[400:], "reserved"])
    notice = " ".join([*filler[:300], "all of the rights are reserved", *filler[300:]])
    mit = "the software and " + " ".join(filler) + " The above copyright notice, and this permission notice, shall be included in all copies or substantial portions of the Software " + " ".join(filler)
    docs = stored(spark.createDataFrame([(1, scattered), (2, notice), (3, mit), (4, mit.replace("included", "x").replace("portions", "y").replace("shall", "z"))], "doc_id long, text string"))
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(docs).collect()}
    assert got == {1: ("", 0.0), 2: ("reserved", 1.0), 3: ("mit", 1.0), 4: ("", 0.0)}


def test_rates_are_those_of_an_independent_solver(spark):
    """The totals of the fitted rates are as near to the targets as those of coordinate descent over all documents."""
    rng = np.random.default_rng(4)
    n, k = 60, 3
    parts = np.array([rng.multinomial(mixing.PARTS, x) for x in rng.dirichlet([0.4, 0.3, 0.2], n)])
    tokens = rng.integers(1, 400, n)
    df = spark.createDataFrame([(i, int(t), [int(x) for x in p]) for i, (t, p) in enumerate(zip(tokens, parts, strict=True))], "doc_id long, n_tokens long, parts array<int>")
    targets = {"a": 1.0, "b": 2.0, "c": 0.5}
    model = mixing.fit_rates(df, mixing.MixModel(["a", "b", "c"]), targets, keep_all=False)
    rates = np.array([r.rate for r in mixing.document_rates(df, model).orderBy("doc_id").collect()])
    p = parts / mixing.PARTS
    share, goal = tokens @ p / tokens.sum(), np.array([1, 2, 0.5]) / 3.5

    def cost(r):
        return float((((r * tokens) @ p / tokens.sum() - goal) ** 2 / share).sum())

    # Coordinate descent over the documents, each time to the best nonnegative rate.
    best, a = np.ones(n), tokens[:, None] * p / tokens.sum()
    for _ in range(3000):
        for i in range(n):
            rest = (best @ a) - best[i] * a[i] - goal
            best[i] = max(0.0, -float((rest * a[i] / share).sum()) / float((a[i] ** 2 / share).sum()))
    assert (rates >= 0).all() and cost(rates) <= cost(best) + 1e-5 and cost(np.ones(n)) > 0.05


def test_planted_quality_is_learned(spark, stored):
    """Labels that follow from the words are found again in rows whose labels were never seen."""
    import zlib

    rng = random.Random(9)
    good, bad = [f"good{k}" for k in range(40)], [f"bad{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(good if k % 2 else bad) for _ in range(rng.randrange(20, 60))), k % 2) for k in range(600)]
    docs = stored(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, q if zlib.crc32(str(k).encode()) % 3 != 1 else 1 - q, 0) for k, _, q in rows], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()}
    assert sum((scores[k] >= 0.5) == (q == 1) for k, _, q in rows) >= 0.98 * len(rows)


# -- repeats ------------------------------------------------------------------------------------


def bwt(symbols):
    n = len(symbols)
    order = sorted(range(n), key=lambda i: (symbols[i : i + repeats.LENGTH].tolist(), i))
    return symbols[np.array(order) - 1]


def test_merged_transform_is_that_of_the_whole():
    rng = np.random.default_rng(1)
    parts = [np.concatenate([np.concatenate([rng.integers(1, 4, n), [0]]) for n in rng.integers(1, 300, 4)]) for _ in range(2)]
    merged, rank = repeats.merge(repeats.transform(parts[0]), repeats.transform(parts[1]))
    # Suffixes end with their part, so a longer common suffix of both parts is no equal string.
    want = sorted(range(len(merged.symbols)), key=lambda i: ((parts[0][i : i + 200] if i < len(parts[0]) else parts[1][i - len(parts[0]) : i - len(parts[0]) + 200]).tolist(), i))
    text = np.concatenate(parts)
    before = np.concatenate([np.roll(parts[0], 1), np.roll(parts[1], 1)])
    assert (merged.symbols == text).all() and (before[want] == merged.before).all()
    assert (np.diff(rank[merged.order]) >= 0).all()
    one = repeats.transform(parts[0])
    assert (one.before == bwt(parts[0])).all()


@pytest.mark.parametrize("shard", [1 << 18, 300])
def test_repeated_starts(shard, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", shard)
    rng = random.Random(4)
    passage = bytes(rng.randrange(256) for _ in range(260))
    contexts = [bytes(rng.randrange(256) for _ in range(rng.randrange(30))) + passage[rng.randrange(40) :] + bytes(rng.randrange(256) for _ in range(rng.randrange(50))) for _ in range(9)]
    contexts += [b"\0" * 230, b"ab" * 130]
    count = Counter(c[k : k + 200] for c in contexts for k in range(len(c) - 199))
    for c, flags in zip(contexts, repeats.repeated_starts(contexts), strict=True):
        assert flags.tolist() == [count[c[k : k + 200]] > 1 for k in range(len(c) - 199)]


def test_runs_in_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 400)
    data = bytes(random.Random(2).randrange(256) for _ in range(3000))
    start, size, _ = repeats.runs(data, repeats._tables())
    assert start[0] == 0 and (start[1:] == (start + size)[:-1]).all() and start[-1] + size[-1] == len(data) - 199


def test_repeats_odd(spark, odd_docs, stored):
    rng = random.Random(9)
    block = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(1, block), (2, "x" + block[100:400] + "y"), (3, None), (4, ""), (None, block[:199]), (5, "é" * 300), (6, "z" * 199), (7, "ab" * 100), (8, "q" + block[200:420] + block[200:420])]
    docs = stored(spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, row string, at long"))
    texts = [(r[1] or "").encode() for r in rows]
    count = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    for (doc, _), t in zip(rows, texts, strict=True):
        covered = {j for k in range(len(t) - 199) if count[t[k : k + 200]] > 1 for j in range(k, k + 200)}
        assert bytes(got[doc].kept) == bytes(b for j, b in enumerate(t) if j not in covered) and got[doc].n_bytes == len(t)
        assert sum(s.stop - s.start for s in got[doc].spans) == len(covered)
    assert repeats.remove_repeats(stored(odd_docs, "o")).count() == 14
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


# -- filter audit -------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_positional_counts(words):
    want = [sum(w >> k & 1 for w in words) for k in range(32)]
    assert filter_audit.positional_counts(np.array(words, np.uint32)).tolist() == want


def test_survival_words():
    for fails in range(32):
        word = filter_audit.survival_word(fails)
        assert all((word >> s & 1) == (s & fails == 0) for s in range(32))


def audit(docs, labels):
    """Every order applied left to right, document by document."""
    from itertools import permutations

    docs = [(i, t or "", p or "") for i, t, p in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    rows = []
    for i, t, p in docs:
        words = t.encode().split()
        upper = sum("A" <= c <= "Z" for c in t)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * upper > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t],
        }
        rows.append((i, p, {x for x, f in fails.items() if f}))
    out = {}
    for part in {p for _, p, _ in rows}:
        for order in permutations("ABCDE"):
            left = [(i, f) for i, p, f in rows if p == part]
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                fail = [f for _, p, f in rows if p == part and x in f]
                out[part, "".join(order), step] = [len(left), len(gone), len(fail) - len(gone), sum(f == {x} for f in fail), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    for (part, order, step), row in out.items():
        row.append(sum(r[1] for (p, o, s), r in out.items() if p == part and o[s - 1] == order[step - 1]))
    return {(*k, *v) for k, v in out.items()}


def test_audit_against_every_order(spark, stored):
    rng = random.Random(3)
    docs = []
    for k in range(120):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 1, 99, 100, 101, 150]))]
        text = " ".join(w.upper() if rng.random() < 0.3 * (k % 3) else w for w in words) + rng.choice(["", "", "#", "|", " \x85é"])
        docs.append((k, text, rng.choice(["en", "de", None, ""])))
    docs += [(200 + k, docs[rng.randrange(120)][1], rng.choice(["en", "de"])) for k in range(40)]
    docs += [(None, docs[0][1], "en"), (None, None, None), (3, docs[3][1], docs[3][2]), (-1, docs[5][1], "en")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 220, 2)] + [(2, 1, 1), (None, 1, 1)]
    frame = stored(spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.col("lang") for c in ("part", "word", "digest", "label", "fails")}))
    marks = stored(spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x")), "labels")
    got = filter_audit.filter_audit(frame, marks)
    rows = {tuple(r) for r in got.collect()}
    assert rows == audit(docs, labels) and got.count() == 600 * 3
    assert {f.dataType.simpleString() for f in got.schema.fields[3:]} == {"bigint"}


@pytest.mark.parametrize("often", [1, 2, 1000])
def test_audit_odd(spark, odd_docs, stored, monkeypatch, often):
    monkeypatch.setattr(filter_audit, "KEYS", 1)
    monkeypatch.setattr(filter_audit, "OFTEN", often)
    docs, labels = stored(odd_docs), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = audit([(r.doc_id, r.text, r.lang) for r in odd_docs.collect()], [])
    assert {tuple(r) for r in filter_audit.filter_audit(docs, labels).collect()} == want
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0


# -- prefix trie --------------------------------------------------------------------------------


def trie(rows):
    """Every node's row by definition."""
    import zlib

    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - c % 5, [])[:h] + ts[h:])
    members, ends = {}, {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
        ends.setdefault(ts, []).append(c)
    rows = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(x[: len(p)] == p and len(x) > len(p) for x in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        rows.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children), len(leaves), saved, digest))
    return rows


@pytest.mark.parametrize("gather", [None, 7])
def test_trie_against_definition(spark, gather, monkeypatch):
    """Also with a list that is contracted almost whole, and with small blocks, stretches and chunks."""
    if gather:
        for name, value in (("BLOCK", 16), ("STRETCH", 3), ("CHUNK", 2)):
            monkeypatch.setattr(prefix_trie, name, value)
    rng = random.Random(11)
    said = ["hi", "é" * 5, "", None, "long " * 9]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said)) for c in rng.sample(range(90), 60) for t in range(rng.choice([1, 2, 3, 5, 12]))]
    rows += [(c, t, "user", "same") for c in (200, 201, 202, 203, 204, 211, 213) for t in range(14)]
    rows += [(300, None, "user", "no number"), (300, 1, "user", "tie b"), (300, 1, "user", "tie a"), (300, 1, "user", "tie a"), (None, 0, "user", "nobody"), (-3, 0, "user", "below zero"), (1001, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("key", "id", "parent", "depth", "g", "size")})
    got = prefix_trie.prefix_trie(df, gather)
    assert Counter(tuple(r) for r in got.collect()) == Counter(trie(rows))
    assert {f.dataType.simpleString() for f in got.schema.fields[:-1]} == {"bigint"}


def test_trie_odd(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0
    one = [(1001, 0, "user", "x" * 100_000)]
    assert [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(one, schema)).collect()] == trie(one)


@pytest.mark.parametrize("gather", [1, 5, 1000])
def test_list_ranks(spark, gather):
    order = list(range(300))
    random.Random(2).shuffle(order)
    pairs = [(a, b) for a, b in zip(order, [*order[1:], -1], strict=True)]
    got = {r.arc: r.rank for r in prefix_trie.list_ranks(spark.createDataFrame(pairs, "arc long, next long"), gather).collect()}
    assert got == {a: k for k, a in enumerate(order)}
