"""Each operator against a brute-force version, on the smallest tables and on awkward rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import languages, licenses, line_dedup, mixing, near_dedup, packing, quality, registry, sharding, spotsigs, substring_dedup
from millrace.llm.linking import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, _id string, bucket string"
LONG = " ".join(f"word{i % 700}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(20))
AWKWARD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n", "en", "a"),
    (4, "one two", "en", None),
    (5, "one two", "de", "b"),
    (6, LONG, "en", "b"),
    (7, LONG + " tail", "en", "b"),
    (8, PASSAGE + " first end", "fr", "c"),
    (9, "other start " + PASSAGE, "fr", "c"),
    (9, "other start " + PASSAGE, "fr", "c"),
    (None, PASSAGE, "fr", "c"),
    (10, "ÄÖ ß　full width\r\nline two\n\nline two\x0bend 日本語 текст", "de", "\U0001f600"),
    (11, "!!! ### 123 $$$\n!!! ### 123 $$$", None, "z"),
    (12, "퟿ odd \u0000 null byte", "en", "z"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, lang, s, len(t or ""), "x", "y", "z") for i, t, lang, s in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def small(documents):
    return documents.toPandas()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


# --- 1: substring dedup


def repeated(rows, k=13):
    least = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            least[key] = min(least.get(key, d), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - k + 1):
            if least[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
    return out


@pytest.mark.parametrize("subtree", [400_000, 50])
def test_substrings(documents, small, subtree):
    got = substring_dedup.deduplicate_substrings(documents, subtree=subtree).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == repeated(list(zip(small.doc_id, small.text)))


def test_substrings_awkward(spark, awkward):
    got = substring_dedup.deduplicate_substrings(awkward).collect()
    assert len(got) == len(AWKWARD)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_words"], r["n_removed"], r["kept"]))
    assert by[1] == [(0, 0, "")] and by[9] == [(22, 20, "other start")] * 2 and by[None][0][1] == 0
    assert by[7][0][2].endswith("tail") and by[7][0][1] == 30_000
    assert substring_dedup.deduplicate_substrings(empty(spark)).count() == 0


# --- 2: licenses


def test_alignment_pairs_rise_and_match():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 12, rng.integers(0, 30)).tolist() for _ in range(2))
        pairs = licenses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert licenses.aligned([1, 2, 3, 4], [1, 2, 3, 4]) == [(i, i) for i in range(4)]
    assert len(licenses.aligned([9, 1, 2, 8, 3, 4], [1, 2, 3, 4])) == 4


def test_increasing_is_longest():
    rng = np.random.default_rng(2)
    for _ in range(100):
        v = rng.permutation(8).tolist()
        best = max(n for n in range(9) for c in itertools.combinations(v, n) if list(c) == sorted(c))
        got = [v[i] for i in licenses.increasing(v)]
        assert got == sorted(got) and len(got) == best


def test_licenses_found(spark, awkward, documents, small):
    mit = dict((n, t) for n, t in licenses.TEMPLATES if len(t) > 500)["MIT"]
    changed = mit.replace("sublicense", "lend").replace("OTHERWISE", "ELSE")
    rows = [(1, "some words\n" + changed + "\nmore"), (2, "x. Licensed under CC BY-NC 4.0. y. Released under the MIT License."), (3, "a license of the and to"), (4, (mit + " ") * 3)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [m["license"] for m in got[1]["matches"]] == ["MIT"] and 0.95 < got[1]["matches"][0]["coverage"] < 1
    assert [m["license"] for m in got[2]["matches"]] == ["CC-BY-NC-4.0", "MIT"]
    assert not got[3]["matches"] and len(got[4]["matches"]) == 3
    found = {r["doc_id"]: [m["license"] for m in r["matches"]] for r in licenses.scan_licenses(documents).collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for d, t in zip(small.doc_id, small.text):
        assert set(found[d]) == {n for line, n in lines.items() if line in t}
    assert licenses.scan_licenses(awkward).count() == len(AWKWARD) and licenses.scan_licenses(empty(spark)).count() == 0


# --- 3: fingerprints


def test_fingerprints(documents, small, awkward, spark):
    got = {r["doc_id"]: r for r in spotsigs.fingerprint_edits(documents, bucket_rows=17).collect()}
    order = small.sort_values("doc_id", ascending=False)
    texts = list(order.text)
    for i, (d, t) in enumerate(zip(order.doc_id, texts)):
        nxt, n = texts[(i + 1) % len(texts)], len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, e, b = spotsigs.signature_sets([t, edited, nxt])
        assert (got[d]["fingerprint"], got[d]["edited_fingerprint"]) == (spotsigs.encoded(a), spotsigs.encoded(e))
        exact = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if len(x) and len(y) else float(len(x) == len(y))
        assert got[d]["near_edited"] == pytest.approx(exact(a, e)) and got[d]["near_next"] == pytest.approx(exact(a, b))
    assert spotsigs.fingerprint_edits(awkward).count() == len(AWKWARD)
    assert spotsigs.fingerprint_edits(empty(spark)).count() == 0


def test_fingerprint_groups(spark):
    name = lambda n: "".join(chr(97 + int(c)) for c in f"{n:05d}")
    text = lambda i: " ".join(f"the {name(i * 1000 + j)} of {name(i * 2000 + j)}x" for j in range(60))
    rows = [(1, text(1)), (2, text(1) + " the last word here"), (3, text(2)), (4, text(1)), (5, None)]
    got = dict(spotsigs.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}


# --- 4: line dedup


def test_lines(spark, awkward):
    base = "this sentence carries enough long words to be fuzzy matched across several different documents today"
    near = base.replace("today", "now")
    rows = [(1, f"{base}\nkeep me\n---"), (2, f"{near}\nkeep me\n---\nunlike line with other content words entirely here"), (3, base.upper() + "!!!"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.deduplicate_lines(docs).collect()}
    assert got[1]["text"] == f"{base}\nkeep me\n---" and got[1]["n_removed"] == 0
    assert "unlike line" in got[2]["text"] and "keep me" not in got[2]["text"] and "---" in got[2]["text"]
    assert got[3]["text"] == "" and got[4]["text"] is None and got[5]["text"] == "" and got[4]["n_lines"] == 0
    out = line_dedup.deduplicate_lines(awkward)
    assert out.count() == len(AWKWARD) and set(awkward.columns) <= set(out.columns)
    assert line_dedup.deduplicate_lines(empty(spark)).count() == 0


def test_equal_lines_go_once(documents, small):
    """Every removed line has an equal or similar one that stays; exact repeats all go but the first."""
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(documents).collect()}
    norm = lambda x: " ".join(re.sub(r"[^\w]|_", " ", x.lower()).split())
    seen = Counter(norm(x) for t in got.values() for x in t.split("\n"))
    assert all(n == 1 for x, n in seen.items() if x)


# --- 5: mixing


def brute_targets(sizes, weights=(1, 2, 3)):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = left / sum(w[s] for s in free)
        over = {s for s in free if share * w[s] > 3 * sizes[s]}
        if not over:
            return target | {s: share * w[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark, documents, small, awkward):
    for docs, rows in ((documents, list(zip(small.doc_id, small.text, small.source))), (awkward, [(d, t, s) for d, t, _, s in AWKWARD])):
        got = mixing.mixed_documents(docs).collect()
        assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mixed_documents(docs).collect()))
        sizes = Counter()
        for _, t, s in rows:
            sizes[s] += len(words(t))
        want = brute_targets(sizes)
        source = {d: s for d, _, s in rows}
        taken = Counter()
        for r in got:
            s = source[r["doc_id"]]
            taken[s] += r["taken"]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        for s in sizes:
            assert abs(taken[s] - want[s]) <= 3
    assert mixing.mixed_documents(empty(spark)).count() == 0
    mixed = mixing.mix_rows(documents)
    assert mixed.columns == documents.columns and abs(sum(len(words(r["text"])) for r in mixed.collect()) - sum(len(words(t)) for t in small.text)) < 50


def test_splitting_tree(spark):
    blocks = spark.range(1000).select((F.col("id") % 3).cast("string").alias("source"), F.floor(F.col("id") / 3).alias("block"))
    got = mixing.split_blocks(blocks, 8, 1).collect()
    assert Counter(r["shard"] for r in got) == {s: 125 for s in range(8)}
    for s in range(8):
        assert sorted(r["place"] for r in got if r["shard"] == s) == list(range(125))


# --- 6: sharding


def test_sharding(spark, documents, small, awkward):
    for docs, rows in ((documents, list(zip(small.doc_id, small.text))), (awkward, [(d, t) for d, t, _, _ in AWKWARD])):
        got = sharding.shard(docs).collect()
        assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"}
        slots = defaultdict(list)
        text = defaultdict(set)
        by_id = dict(rows)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            t = by_id[r["doc_id"]] or ""
            assert r["size"] == len(t.encode("utf-8", "surrogatepass")) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
            text[t].add(r["shard"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in text.values())
    assert sharding.shard(empty(spark)).count() == 0


def test_minimax_is_least():
    rng = np.random.default_rng(3)
    for _ in range(100):
        sizes, k = rng.integers(0, 20, rng.integers(1, 9)), int(rng.integers(1, 5))
        best = min(max(sum(sizes[a:b]) for a, b in zip((0, *cut), (*cut, len(sizes)))) for cut in itertools.combinations_with_replacement(range(len(sizes) + 1), k - 1))
        assert sharding.smallest_capacity(sizes, k) == best
        cuts = [0, *sharding.minimax_cuts(sizes, k)]
        assert max(sizes[a:b].sum() for a, b in zip(cuts, cuts[1:])) == best


# --- 7: MinHash near-dedup


def brute_groups(rows, k):
    sets = {}
    for d, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            index[g].append(d)
    pairs = {(a, b) for ds in index.values() for a, b in itertools.combinations(sorted(ds), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates(spark, small, documents, awkward):
    want = brute_groups(list(zip(small.doc_id, small.text)), 4)
    got = near_dedup.near_duplicates(documents, shingle=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = near_dedup.drop_near_duplicates(documents, shingle=4)
    assert kept.columns == documents.columns and kept.count() == sum(d == c for d, (_, c) in want.items())
    by = {r["doc_id"]: r for r in near_dedup.near_duplicates(awkward, shingle=4).collect()}
    assert by[5]["component_id"] == 4 and by[7]["component_id"] == 6 and by[1]["n_shingles"] == 0 and by[2]["component_id"] == 2 and by[None]["kept"]
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_near_copies_of_copies(spark):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in rng.integers(0, 120, 3):
            w[j] = f"new{rng.integers(0, 10**6)}"
        rows.append((100 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, shingle=4).collect()}
    assert got == brute_groups(rows, 4)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


# --- 8: quality


def test_quality(spark, documents, small, awkward):
    got = {r["doc_id"]: r for r in quality.judge_quality(documents).collect()}
    for d, t in zip(small.doc_id, small.text):
        w = words(t)
        spots = defaultdict(list)
        for i in range(len(w) - 7):
            spots[tuple(w[i : i + 8])].append(i)
        again = {j for s in spots.values() if len(s) > 1 for i in s for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert sum(r["kept"] for r in got.values()) > 0.85 * len(got)
    assert quality.judge_quality(awkward).count() == len(AWKWARD) and quality.judge_quality(empty(spark)).count() == 0
    kept = quality.keep_quality(documents)
    assert kept.columns == documents.columns and kept.count() == sum(r["kept"] for r in got.values())


def test_compression_bands(spark):
    rng = np.random.default_rng(5)
    noise = " ".join("".join(chr(c) for c in rng.integers(33, 126, 12)) for _ in range(200))
    same = " ".join(f"{a} {b}" for a in ("red", "blue") * 40 for b in ("one", "two"))
    docs = spark.createDataFrame([(1, noise), (2, same)], "doc_id long, text string")
    assert not any(r["kept"] for r in quality.judge_quality(docs).collect())


# --- 9: packing


def test_boundaries_are_best():
    rng = np.random.default_rng(6)
    for _ in range(60):
        counts = rng.integers(0, 5, 9)
        counts[0], k = 0, int(rng.integers(1, 5))
        if not counts.any():
            continue
        present = [n for n in range(9) if counts[n]]
        pad = lambda ends: sum(c * (next(e for e in ends if e >= n) - n) for n, c in enumerate(counts) if c)
        best = min(pad([*c, present[-1]]) for m in range(k) for c in itertools.combinations(present[:-1], m))
        ends = packing.boundaries(counts, k)
        assert len(ends) <= k and ends == sorted(ends) and pad(ends) == best


def test_packing(spark, documents, small, awkward):
    for docs, rows in ((documents, list(zip(small.doc_id, small.text))), (awkward, [(d, t) for d, t, _, _ in AWKWARD])):
        got = packing.pack(docs, longest=256, budget=2048).collect()
        tokens = Counter()
        for r in got:
            tokens[r["doc_id"]] += r["n_tokens"]
        want = Counter()
        for d, t in rows:
            want[d] += len(words(t))
        assert +tokens == +want and all((r["bucket"] is None) == (r["n_tokens"] == 0) for r in got)
        slots = defaultdict(list)
        for r in got:
            if r["n_tokens"]:
                assert r["n_tokens"] <= r["bucket_length"] <= 256
                slots[r["bucket"], r["batch"]].append(r["slot"])
        lengths = {r["bucket"]: r["bucket_length"] for r in got if r["n_tokens"]}
        last = {b: max(x for y, x in slots if y == b) for b in lengths}
        for (b, x), s in slots.items():
            assert sorted(s) == list(range(len(s))) and len(s) <= 2048 // lengths[b] and (x == last[b] or len(s) == 2048 // lengths[b])
    assert packing.pack(empty(spark)).count() == 0


# --- 10: languages


def test_languages(spark, documents, small, awkward):
    model = languages.train(documents.filter(languages.remainder(F.col("doc_id")) != 0))
    got = {r["doc_id"]: r for r in languages.identify_languages(documents, model).collect()}
    held = [(d, lang) for d, lang in zip(small.doc_id, small.lang) if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([got[d]["lang_pred"] == lang for d, lang in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())
    by = {r["doc_id"]: r for r in languages.identify_languages(awkward, model).collect()}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[3]["lang_pred"] == by[11]["lang_pred"] == "und" and by[10]["lang_pred"] != "und"
    english, french = (" ".join(words(" ".join(small[small.lang == x].text))[:60]) for x in ("en", "fr"))
    mixed = spark.createDataFrame([(1, english + ". " + french)], "doc_id long, text string")
    spans = languages.identify_languages(mixed, model).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "fr"] and abs(spans[1]["start"] - len(english)) < 40
    assert languages.identify_languages(empty(spark), model).count() == 0
    none = languages.train(empty(spark))
    assert {r["lang_pred"] for r in languages.identify_languages(awkward, none).collect()} == {"und"}


def test_viterbi_is_best_and_pruning_is_exact():
    rng = np.random.default_rng(7)
    for _ in range(60):
        s = rng.normal(0, 3, (5, 3))
        total = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 4 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(map(total, itertools.product(range(3), repeat=5)))
        assert total(languages.viterbi(s, 4.0)) == pytest.approx(best)
        part = languages.Words(["a b c d e"])
        assert total(languages.labels(part, s, 4.0)[0]) == pytest.approx(best)


# --- the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
    assert {"pipeline", *(f"op{n}_" for n in range(1, 14))} == {"pipeline" if q == "pipeline" else re.match(r"op\d+_", q)[0] for q in registry.queries()}
