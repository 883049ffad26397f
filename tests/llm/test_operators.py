"""Each corpus operator against brute force, on edge cases: nulls, empties, ties, repeated rows, long texts, clashing columns."""

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from wavelark.llm import embedding_dedup, exact_dedup, license_scan, line_dedup, minhash, mixing, packing, substring_dedup, suffix_dedup, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, key string, spans string, copies int"
SF = "/root/testdata/sf0.001"


def corpus() -> list[tuple]:
    """Unique ids; copies, near copies, shared passages, repeated lines, nulls, empties, a very long text."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = say(70), [rng.choice(words) for _ in range(120)]
    texts = [say(rng.randint(1, 200)) for _ in range(30)]
    texts += [texts[0]] * 4 + [texts[3]] * 2
    texts += [say(20) + " " + passage + " " + say(15) for _ in range(5)]
    texts += [passage[3:-7], "x" + passage, passage + "\n" + passage]
    for k in range(12):
        near = list(base)
        for _ in range(k):
            near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(" ".join(near).upper() if k % 3 == 0 else " ".join(near))
    texts += [None, "", "", " \t\n ", "word", "word", "Word", "two words", "é" * 60, "日本語 " * 40, "a" * 500, "a" * 501, "ab" * 200, say(6000)]
    texts += [f"line {k}\nReleased under the MIT License.\nuser {k} logged in at {k * 7}" for k in range(12)]
    texts += ["Licensed under the Apache Licence, Version 2.0", "CC BY-NC and cc by nc", "under the mit license under the mit license", "Apache License Version 2"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    sources = [None, "a", "b", "c", "B", ""]
    return [(i, texts[j], "en", sources[j % 6] if j % 3 else "a", 1, True, "k", "s", 3) for i, j in enumerate(order)]


ROWS = corpus()
PAIRS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, repeated ids with different texts, null ids, nulls everywhere."""
    return spark.createDataFrame([(1, "same text " * 20, None, None, None, None, None, None, None)] * 3 + [(1, "other text " * 20, None, None, None, None, None, None, None), (None, "same text " * 20, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (2, None, None, None, None, None, None, None, None)], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_exact(docs, empty, odd):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    groups: dict = {}
    for i, t in PAIRS:
        groups.setdefault(t or "", []).append(i)
    for i, t in PAIRS:
        g = groups[t or ""]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())
    small = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs, keep="smallest").collect()}
    assert all(small[i] == min(groups[t or ""]) for i, t in PAIRS)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0
    out = exact_dedup.exact_groups(odd).collect()
    assert len(out) == 7 and sum(r.kept for r in out) == 3
    assert {(r.keep_id, r.group_size) for r in out} == {(1, 4), (1, 1), (2, 2)}
    assert exact_dedup.exact_dedup(odd).count() == 3


def test_exact_splits_large_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SEGMENT", 7)
    d = spark.createDataFrame([(i, "t" if i % 3 else f"u{i}") for i in range(200)], "doc_id long, text string").repartition(9)
    out = exact_dedup.exact_groups(d).collect()
    n = sum(1 for i in range(200) if i % 3)
    assert all((r.keep_id, r.group_size) == ((199, n) if r.doc_id % 3 else (r.doc_id, 1)) for r in out)
    assert sum(r.kept for r in out) == 200 - n + 1


def test_packing(docs, empty, odd):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: tk.encode(t or "", add_special_tokens=False).ids + [1] for i, t in PAIRS}
    out = packing.pack(docs, capacity=256, slack=2).collect()
    bins: dict = {}
    seen = {i: 0 for i in ids}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == seen[r.doc_id] == 256 * r.piece and len(part) == r.length
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(seen[i] == len(x) for i, x in ids.items())
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.03 * sum(map(len, ids.values())) / 256 + 1
    assert packing.pack(empty).count() == 0
    assert len(packing.pack(odd).collect()) == 7


@pytest.mark.parametrize("text", ["", "Don't it's. A,b", "Σίσυφος ΟΔΟΣ", "İstanbul", "é éx", "a b", "<|endoftext|> x<|startoftext|>y", "123 4,5 1.2", "..., --", "日本語 テスト。", "😀 a😀b.,", "'s s't 's.", "a_.b,_", "l.'", "A.́b"])
def test_token_parts(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert list(np.frombuffer(next(packing.token_bytes([text], path)), "<u4")) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tk = Tokenizer.from_file(path)
    texts = ["Upper and lower, Case.", "", "  two  spaces\n\nand lines\t", "na\u00efve caf\u00e9 \u4e2d\u6587"] * 70
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.token_bytes(texts, path)]
    assert got == [tk.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_tree(spark, monkeypatch):
    """Many leaves and levels: pieces stay whole and bins stay within capacity."""
    monkeypatch.setattr(packing, "FAN", 2)
    d = spark.range(400).selectExpr("id as doc_id", "repeat('cat ', cast(id % 37 as int)) as text").repartition(11)
    out = packing.pack(d, capacity=40, slack=0).collect()
    total: dict = {}
    for r in out:
        total.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in total.values():
        ends = [o + n for o, n in sorted(b)]
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 40
    assert len(total) <= 1.06 * sum(r.length for r in out) / 40 + 1  # leaves of 36 documents


def test_lines(docs, empty, odd):
    out = {r.doc_id: r for r in line_dedup.line_dedup_report(docs, min_docs=10).collect()}
    want = brute.recurring(PAIRS, 10)
    for i, t in PAIRS:
        lines = (t or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if k not in want[i])
        assert (out[i].n_lines, out[i].n_dropped, out[i].kept_sha256) == (len(lines), len(want[i]), hashlib.sha256(kept.encode()).hexdigest())
        if t and t.startswith("line "):
            assert len(want[i]) == 3  # the line number, the license and the login are one template each
    cut = line_dedup.line_dedup(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert line_dedup.line_dedup_report(empty).count() == 0
    assert line_dedup.line_dedup_report(odd).count() == 7


NAMES = ["ann", "bob", "cid", "dan", "eve", "fay", "gus", "hal", "ida", "jim", "kay", "lea"]


def test_lines_generalize(spark):
    """A variable field without digits becomes a wildcard where it is rare at its place, the first ones included."""
    text = lambda n: f"{n} has left\nPosted by {n} yesterday\nthe {n} user called this has now logged out\n2021-03-0{len(n)} 12:00:00 v2.1 END\nown words {n * 3}"
    d = spark.createDataFrame([(i, text(n)) for i, n in enumerate(NAMES)], "doc_id long, text string")
    want = brute.recurring([(i, text(n)) for i, n in enumerate(NAMES)], 10)
    assert all(x == {0, 1, 2, 3, 4} for x in want.values())
    out = line_dedup.line_dedup_report(d).collect()
    assert all(r.n_dropped == 5 for r in out)
    templates = {r.template for r in line_dedup.recurring_lines(d)[1].collect()}
    assert {"<*> has left", "Posted by <*> yesterday", "the <*> user called this has now logged out"} <= templates


def test_lines_count_documents(spark):
    """What recurs within one document only, and unlike lines that are all field, stay."""
    rows = [(0, "\n".join(f"on the main host user {n} has now logged out" for n in NAMES)), (1, "the river flows past\n" * 30)]
    rows += [(10 + i, f"{n} {n[::-1]} {n * 2}\nhello {n * 4}") for i, n in enumerate(NAMES[:9])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.line_dedup_report(d).collect()} == {i: 0 for i, _ in rows}
    assert not any(brute.recurring(rows, 10).values())
    # a document with several lines of a template counts once, and loses them all where ten documents have it
    more = rows + [(50 + i, f"on the main host user zed{'y' * i} has now logged out\non the main host user zod has now logged out") for i in range(9)]
    want = brute.recurring(more, 10)
    assert len(want[0]) == 12
    got = line_dedup.line_dedup_report(spark.createDataFrame(more, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {i: len(x) for i, x in want.items()}


def test_minhash(docs, empty, odd):
    for words in (2, 5):
        want = brute.near(PAIRS, words)
        got = {r.doc_id: r for r in minhash.near_duplicates(docs, words=words).collect()}
        for i, (n, c) in want.items():
            assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, i == c)
    kept = minhash.near_dedup(docs, words=2)
    assert kept.columns == docs.columns
    want = brute.near(PAIRS, 2)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.near_dedup(empty).count() == 0
    out = minhash.near_duplicates(odd).collect()
    assert len(out) == 7 and all(r.kept for r in out)


def test_minhash_in_full(docs, monkeypatch):
    """Without the rounds, blocks of each bucket meet one another; the result is the same."""
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    want = brute.near(PAIRS, 2)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=2).collect()} == {i: c for i, (_, c) in want.items()}


def test_components(spark):
    from wavelark.llm.components import connected_components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 200: 150}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix(docs, empty, odd):
    want = sorted(brute.repeated_bytes(PAIRS))
    assert rows_of(suffix_dedup.suffix_dedup_report(docs)) == sorted(want, key=repr)
    cut = suffix_dedup.suffix_dedup(docs)
    assert cut.columns == docs.columns
    by_id = {r.doc_id: r.text for r in cut.collect()}
    for i, n, gone, _, _ in want:
        assert by_id[i] is None or len(by_id[i].encode()) <= n - gone
    assert suffix_dedup.suffix_dedup_report(empty).count() == 0
    out = suffix_dedup.suffix_dedup_report(odd).collect()
    assert len(out) == 7
    assert sorted(r.n_removed for r in out) == [0, 0, 0, 0, 0, 0, 200]  # the null id loses to the known ones


def test_suffix_family_levels(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 64)
    rng = random.Random(1)
    base = [bytes(rng.choice(b"abc") for _ in range(40)) for _ in range(30)]
    items = sorted((rng.randrange(50), rng.choice(base)[rng.randrange(5) :] + bytes([rng.randrange(97, 100)])) for _ in range(400))
    gone = [np.zeros(len(t), bool) for _, t in items]
    for i, a, b in suffix_dedup.suffix_matcher(12)(items):
        gone[i][a:b] = True
    first: dict = {}
    for d, t in items:
        for k in range(len(t) - 11):
            first[t[k : k + 12]] = min(first.get(t[k : k + 12], d), d)
    for (d, t), g in zip(items, gone):
        want = np.zeros(len(t), bool)
        for k in range(len(t) - 11):
            if first[t[k : k + 12]] < d:
                want[k : k + 12] = True
        assert (want == g).all()


def test_substring(docs, empty, odd):
    assert rows_of(substring_dedup.substring_dedup_report(docs)) == sorted(brute.repeated_words(PAIRS), key=repr)
    cut = substring_dedup.substring_dedup(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert substring_dedup.substring_dedup_report(empty).count() == 0
    assert substring_dedup.substring_dedup_report(odd).count() == 7


def test_toxicity(spark, docs, empty, odd):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = toxicity.toxicity(table, labels).collect()
    assert len(out) == table.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    none = labels.where("false")
    for d in (docs, odd):
        assert toxicity.toxicity(d, none).count() == d.count()
        assert toxicity.drop_toxic(d, none).columns == d.columns
    assert toxicity.toxicity(empty, labels).count() == 0


def test_toxicity_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.toxicity(table, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.9
    assert not [r for r in rows if r.predicted and not r.toxic]


def test_levenshtein_automaton():
    terms = ["stupid", "worthless", "scum", "stoop"]
    a = toxicity.LexiconAutomaton(terms)

    def distance(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            row, old = [i], row
            for j, d in enumerate(t, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
        return row[-1]

    rng = random.Random(2)
    words = set(terms) | {"x"}
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "s", "t", "q", "o"])
            words.add("".join(w))
    words = sorted(w for w in words if w)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    found = {w: (t, e) for w, t, e in zip(*(x.tolist() for x in a.run(data, starts, starts + [len(w) for w in words])))}
    for i, w in enumerate(words):
        near = [distance(w, t) for t in terms if distance(w, t) <= toxicity.edits_allowed(t)]
        assert (i in found) == bool(near)
        if near:
            assert found[i][1] == min(near) and distance(w, terms[found[i][0]]) == min(near)


def test_stems():
    a = toxicity.LexiconAutomaton(["chll*", "idiot"])
    words = ["chll", "chlla", "chllanuxyzabcdefghijklmn", "chl", "achlla", "idiots", "idiot", "idi"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    w, t, e = a.run(data, starts, starts + [len(x) for x in words])
    assert list(zip(w.tolist(), t.tolist(), e.tolist())) == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (5, 1, 1), (6, 1, 0)]
    chosen = toxicity.choose_terms([("chll*", 5.0, 200), ("chlla", 5.0, 90), ("idiot", 5.0, 150), ("idio*", 5.0, 150), ("odd", 5.0, 3)])
    assert [c for c, _ in chosen] == ["chll*", "idiot"]


def test_quotation_is_told_apart():
    import pyarrow as pa

    m = toxicity.LexiconAutomaton(["stupid"])
    x = toxicity.features(pa.array(['he said "you are stupid" to them', "you are stupid", "nothing here", ""]), m, np.ones(1))
    assert x[0, 3] > 0 and x[0, 1] == 0 and x[1, 1] > 0 and x[1, 3] == 0 and not x[2:].any()


def test_mixing(docs, empty, odd):
    out = mixing.mix(docs).collect()
    size: dict = {}
    for i, t, _, s, *_ in ROWS:
        size[s] = size.get(s, 0) + len(brute.WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}
    budget, fixed = 1.5 * sum(size.values()), {}
    while True:  # the excess is shared again until no target is above its stop
        rest = [s for s in order if s not in fixed]
        share = (budget - sum(fixed.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if share * weight[s] > 2 * size[s]]
        if not over:
            target = fixed | {s: share * weight[s] for s in rest}
            break
        fixed |= {s: 2.0 * size[s] for s in over}
    by_id, taken = {r[0]: r[3] for r in ROWS}, {}
    longest = max(r.size for r in out)
    for r in out:
        assert r.source_size == size[by_id[r.doc_id]] and r.target == pytest.approx(target[by_id[r.doc_id]])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[by_id[r.doc_id]] = taken.get(by_id[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in order)
    assert sum(taken.values()) <= budget
    assert rows_of(mixing.mix(docs.repartition(3))) == rows_of(mixing.mix(docs))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    assert mixing.mix(odd).count() == 7


def test_licenses(docs, empty, odd):
    out = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    for i, t in PAIRS:
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        if t and "Licence" in t:
            assert r.base_labels == "" and r.labels == "apache-2" and r.spans[0].errors >= 1
    assert license_scan.license_scan(empty).count() == 0
    assert license_scan.license_scan(odd).count() == 7


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows: list = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(60)]
    for k in range(40):
        rows.append((100 + k, [float(x) for x in np.array(rows[k % 3][1]) + 0.05 * rng.standard_normal(16)]))
    rows += [(200 + k, rows[5][1]) for k in range(5)] + [(210, [2 * x for x in rows[5][1]])]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [None] * 16), (305, [1e308] * 16), (306, [float("inf")] + [0.0] * 15)]
    d = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, n int, rep int").repartition(3)
    want = brute.vector_links([(i, v if v is None or i != 305 else [1.0] * 16) for i, v in rows])
    for shard in (2000, 8):
        out = embedding_dedup.near_vectors(d, shard=shard, overlap=3)
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in out.collect())
        missing = sum(w[1] for w in want) - sum(g[1] for g in got)
        assert all(g[1] <= w[1] for g, w in zip(got, want)) and missing <= (0 if shard == 2000 else 0.1 * sum(w[1] for w in want))
        if shard == 2000:
            assert got == want
            assert embedding_dedup.audit_recall(d, out, every=1) == 1.0
    assert embedding_dedup.near_vectors(d.limit(0)).count() == 0
    assert embedding_dedup.near_vectors(d.where("vec_id between 300 and 304")).count() == 5


def test_tables_are_released(spark):
    from wavelark.llm.common import materialize, release

    table = materialize(spark.range(5))
    assert table.count() == 5
    release(spark)
    spark.catalog.clearCache()
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0]).count()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {tuple(r) for r in now.collect()}
        from wavelark.llm.common import materialize

        now = materialize(stage(spark, now, SF))
        after = [tuple(r) for r in now.collect()]
        assert now.columns == columns and set(after) <= before, name
        if name == "exact_dedup":
            assert len({r[1] for r in after}) == len(after) == len({r[1] for r in before})
        if name == "near_dedup":
            comp = brute.near([(r[0], r[1]) for r in before], 5)
            assert sorted(r[0] for r in after) == sorted(i for i, (_, c) in comp.items() if i == c)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert sum(r.piece == 0 for r in packed) == now.count()


def test_no_link_is_lost_between_cells():
    """A third of the rows near one point and scattered ones: what cells are asked must cover every linked pair."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = rng.standard_normal((6_000, 64))
    x[:2_000] = x[0] + 0.15 * rng.standard_normal((2_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = embedding_dedup.fit_centres(x, 90)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([1] * len(x))], ["rep", "unit", "copies"])
    out = next(embedding_dedup._assign(centres, 2, 0.95)(iter([batch])))
    home = np.array(out["near"].to_pylist())[:, 0]
    later = np.zeros((len(x), len(centres)), bool)
    for i, cells in enumerate(out["later"].to_pylist()):
        later[i, cells] = True
    a, b = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    assert len(a) > 1_000_000 and len(set(home[:2_000].tolist())) > 10
    low, high = np.where(home[a] <= home[b], a, b), np.where(home[a] <= home[b], b, a)
    assert ((home[low] == home[high]) | later[low, home[high]]).all()


def test_links_between_cells_are_found(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 32))
    x[:300] = x[0] + 0.15 * rng.standard_normal((300, 32))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute.vector_links([(i, v.tolist()) for i, v in enumerate(x)])
    for shard in (40, 4):
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(d, shard=shard).collect()) == want


def test_lines_do_not_move_to_join_a_few_frequent_leaves(spark):
    """The frequent leaves are few, and Spark sees that before it joins them with all different lines."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = [(i, "\n".join([" ".join(word() for _ in range(6)) for _ in range(20)] + [f"user {i} logged in at {i * 7} today"] * (i < 40))) for i in range(2_000)]
    d = line_dedup.materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200000")
    try:
        before = written()
        out = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup_report(d).collect()}
        moved = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert out == {i: int(i < 40) for i in range(2_000)}
    assert moved < 9_000_000


def test_vectors_are_not_copied_to_where_they_ask(spark):
    """Unclustered vectors, for which cells rule out nothing: what is shuffled is a few times the table whatever the number of blocks."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3_000, 64)).astype(np.float32)
    x[2_000:] = x[:1_000] + 0.03 * rng.standard_normal((1_000, 64)).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    d = embedding_dedup.materialize(d)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(d, shard=40).collect())
    assert got == brute.vector_links([(i, v.tolist()) for i, v in enumerate(x)]) and sum(g[1] for g in got) >= 1_900
    assert 0 < written() - before < 10 * x.nbytes


def built(x):
    """A block's graph, from two shards that overlap, as the operator builds it."""
    import pyarrow as pa

    n = len(x)
    lists: list[list[int]] = [[] for _ in range(n)]
    for ids in (np.arange(0, 3 * n // 4), np.arange(n // 4, n)):
        out = embedding_dedup._build(pa.table({"rep": ids, "unit": pa.array([x[i].tobytes() for i in ids], pa.binary())})).to_pylist()
        for r in out:
            lists[r["rep"]] = sorted(set(lists[r["rep"]]) | set(r["edges"]))
    return lists


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_groups_apart_in_one_shard_are_all_searched():
    """Ten groups of 200 near copies and nothing between them; then a hot group and scattered rows. The audit finds nothing to mend."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    groups = unit(np.repeat(rng.standard_normal((10, 64)), 200, axis=0) + 0.1 * rng.standard_normal((2_000, 64)))
    hot = rng.standard_normal((1_500, 64))
    hot[:500] = hot[0] + 0.15 * rng.standard_normal((500, 64))
    hot[600:700] = hot[500:600] + 0.1 * rng.standard_normal((100, 64))
    for x in (groups, unit(hot)):
        n = len(x)
        lists = built(x)
        truth = x @ x.T >= 0.95
        np.fill_diagonal(truth, False)
        hits, whole = embedding_dedup.block_links(x, n, embedding_dedup.Graph(np.arange(n), lists), np.arange(n), 0.95)
        np.fill_diagonal(hits, False)
        assert whole and (hits & truth).sum() >= 0.99 * truth.sum() and not (hits & ~truth).any()
        table = pa.table({"centre": [0] * n, "block": [0] * n, "ask": [0] * n, "rep": range(n), "unit": pa.array([v.tobytes() for v in x], pa.binary()), "copies": [1] * n, "edges": pa.array(lists, pa.list_(pa.int64())), "role": [0] * n})
        out = embedding_dedup._search(0.95, embedding_dedup.BEAM)(table).to_pylist()
        got = np.zeros(n, int)
        for r in out:
            if r["other"] is None:
                got[r["rep"]] = r["n"]
        assert (got <= truth.sum(axis=1)).all() and got.sum() >= 0.99 * truth.sum()
    assert sum(r["other"] is not None for r in out) >= 590


def test_a_block_that_fails_its_audit_is_compared_in_full():
    """Without edges only medoids and parts of the graph are met; the audit tells."""
    x = unit(np.repeat(np.random.default_rng(5).standard_normal((4, 16)), 50, axis=0) + 0.01 * np.random.default_rng(6).standard_normal((200, 16)))
    graph = embedding_dedup.Graph(np.arange(200), [[i + 1] if i % 50 < 49 else [] for i in range(200)])
    _, met = embedding_dedup.range_search(x, graph, np.array([0]), x[150:151], 0.95, 1)
    assert (~met).sum() > 100
    with_links, whole = embedding_dedup.block_links(x, 200, embedding_dedup.Graph(np.arange(200), [[] for _ in range(200)]), np.arange(200), 0.95)
    assert (with_links == (x @ x.T >= 0.95)).all()


def test_robust_pruning():
    x = unit(np.random.default_rng(3).standard_normal((300, 8)))
    choice = embedding_dedup.candidates(x, 20, 4)
    graph = embedding_dedup.robust_prune(x, choice, 6, 1.2)
    apart = lambda a, b: np.linalg.norm(x[a] - x[b])
    for i in range(300):
        mine = [c for c in choice[i].tolist() if c >= 0]
        assert i not in mine and len(set(mine)) == len(mine) and mine == sorted(mine, key=lambda c: -x[i] @ x[c])
        want: list[int] = []
        for c in mine:
            if len(want) < 6 and all(1.2 * apart(w, c) > apart(i, c) for w in want):
                want.append(c)
        assert [g for g in graph[i].tolist() if g >= 0] == want


def test_hot_cluster_recall(spark):
    """12,000 vectors, 4,500 of them near one point but all different."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((12_000, 32))
    x[:4_500] = x[0] + 0.2 * rng.standard_normal((4_500, 32))
    x[5_000:6_000] = x[6_000:7_000] + 0.05 * rng.standard_normal((1_000, 32))
    x = unit(x)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    out = embedding_dedup.materialize(embedding_dedup.near_vectors(d))
    got = np.array([r.n_links for r in out.orderBy("vec_id").collect()])
    truth = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert (got <= truth).all() and got.sum() >= 0.99 * truth.sum()
    assert embedding_dedup.audit_recall(d, out) >= 0.99


def test_words_of_a_stem_keep_their_edits():
    candidates = [("idio*", 5.0, 100), ("idiot", 5.0, 93), ("scum", 5.0, 90)]
    chosen = toxicity.choose_terms(candidates)
    terms = [t for t, _ in chosen + toxicity.words_of_stems(candidates, chosen)]
    assert "idio*" in terms and "idiot" in terms
    words = ["idiotic", "idoit", "iidiot", "1diot", "scum", "plain", "idiot"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    w, t, e = toxicity.LexiconAutomata(terms, part=1).run(data, starts, starts + [len(x) for x in words])
    got = {words[i]: (terms[j], int(n)) for i, j, n in zip(w.tolist(), t.tolist(), e.tolist())}
    assert got["iidiot"] == got["1diot"] == ("idiot", 1) and got["idiotic"] == ("idio*", 0) and got["scum"] == ("scum", 0) and "plain" not in got
    assert got["idiot"][1] == 0 and ("idoit" in got) == (toxicity.edits_allowed("idiot") >= 2)


def test_rare_terms_stay_in_the_lexicon(spark):
    """300 terms with a long tail, most in six toxic texts and no clean one; and a word of one passage copied into 12 toxic texts."""
    rng = random.Random(3)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2_000)]
    bad = ["".join(rng.choice("klmnopqrst") for _ in range(7)) for _ in range(300)]
    often = [t for k, t in enumerate(bad) for _ in range(90 if k < 10 else 6)]
    say = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    rng.shuffle(often)
    toxic = [" ".join(f"{say(5)} {t} {say(5)}" for t in often[i : i + 6]) for i in range(0, len(often), 6)]
    for k in range(12):
        toxic[k] += " one two copyword three four"
    texts = [(t, 1) for t in toxic] + [(say(30), 0) for _ in range(3_000)]
    docs = spark.createDataFrame([(3 * i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(3 * i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    from unittest import mock

    with mock.patch.object(toxicity, "held_out", lambda id_col="doc_id": toxicity.F.lit(False)):
        terms = toxicity.train(docs, labels).terms
    assert "copyword" not in terms and not [t for t in terms if t.startswith("copyw")]
    hit = set(terms)
    assert all(t in hit or any(t[:k] + "*" in hit for k in (4, 5, 6)) for t in bad)


def test_copies_far_behind_are_cut_at_the_budget(spark):
    """A document of four times its source's target, while the other sources don't use up the budget."""
    rows = [(k, "w " * (1200 if k == 1 else 100), f"s{k:02}") for k in range(31)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.taken for r in out} == {k: 0 if k == 1 else 200 for k in range(31)}
    assert sum(r.taken for r in out) <= 1.5 * sum(r.size for r in out)


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_fool_polynomials(spark):
    """Words and their complements that have one polynomial modulo a power of two, whatever its base."""
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    d = spark.createDataFrame([(0, one), (1, two)], "doc_id long, text string")
    assert [r.component_id for r in minhash.near_duplicates(d, words=2).orderBy("doc_id").collect()] == [0, 1]
    words = [w for k in range(30) for w in (one + "x" * (k % 3), f"w{k}")]
    texts = [(0, " ".join(words)), (1, " ".join(words).replace(one, two)), (2, "other " + " ".join(words[5:58]))]
    # two words in the order of the sequence and of its complement
    texts += [(3, " ".join({"a": "left", "b": "right"}[c] for c in thue_morse(64))), (4, " ".join({"b": "left", "a": "right"}[c] for c in thue_morse(64)))]
    assert rows_of(substring_dedup.substring_dedup_report(spark.createDataFrame(texts, "doc_id long, text string"))) == sorted(brute.repeated_words(texts), key=repr)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=2).collect()} == {i: c for i, (_, c) in brute.near(texts, 2).items()}


def test_shingles_are_compared_by_words():
    for size in (1, 2, 5):
        texts = [b"a b a b a b c".split(), b"b a b a b".split(), b"a b".split(), b"a b".split(), b"".split(), b"c".split(), b"a b a b a b c d e f".split()]
        sets = [{tuple(t[k : k + size]) for k in range(len(t) - size + 1)} if len(t) >= size else {tuple(t)} if t else set() for t in texts]
        got = minhash.exact_shingles(texts, size)
        for x, a in zip(got, sets):
            assert len(x) == len(a)
            for y, b in zip(got, sets):
                assert len(np.intersect1d(x, y)) == len(a & b)


def test_texts_of_few_letters_and_hot_anchors(spark, monkeypatch):
    """Long texts of one letter or a short period, and anchors that are hot from the second row on: the result is the same."""
    from wavelark.llm import winnow

    rng = random.Random(8)
    words = ["".join(rng.choice("ab") for _ in range(3)) for _ in range(9)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(80)
    rows = [(0, "a" * 9_000), (1, "a" * 9_007), (2, "x" + "a" * 60), (3, "ab" * 5_000), (4, "ba" * 5_001), (5, "a b " * 3_000), (6, "b a " * 3_001), (7, "z " * 6_000)]
    rows += [(10 + k, f"{say(k)} {passage} {say(30 - k)}") for k in range(25)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for least in (winnow.HOT, 2):
        monkeypatch.setattr(winnow, "HOT", least)
        assert rows_of(suffix_dedup.suffix_dedup_report(d)) == sorted(brute.repeated_bytes(rows), key=repr)
        assert rows_of(substring_dedup.substring_dedup_report(d)) == sorted(brute.repeated_words(rows), key=repr)


def test_chunks_hold_every_window_once(monkeypatch):
    """A long text in chunks, its stretches cut, gives each window once, at the same anchor as in one piece."""
    import pyarrow as pa
    from wavelark.llm import winnow

    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(3_000)) + " z" * 900
    monkeypatch.setattr(winnow, "LONGEST", 100)
    for module, units, n in ((suffix_dedup, lambda: suffix_dedup.byte_units(50, 18), len(text) - 49), (substring_dedup, lambda: substring_dedup.word_units(50, 8), len(text.split()) - 49)):
        seen = []
        for size in (1 << 19, 700):
            monkeypatch.setattr(module, "BLOCK_BYTES", size)
            anchors = {}
            for row, chunk in units()(pa.array([text])):
                assert row == 0
                for h, _, a, b in zip(*(x.tolist() for x in chunk.stretches(50, 18 if module is suffix_dedup else 8, np.zeros(0, np.uint64)))):
                    assert b - a < 100
                    for w in range(chunk.base + a, chunk.base + b + 1):
                        assert w not in anchors
                        anchors[w] = h
            assert sorted(anchors) == list(range(n))
            seen.append(anchors)
        assert seen[0] == seen[1]


def test_large_lexicons_of_long_terms():
    """150 terms of 9 to 11 letters with two edits each: no lexicon has too many states, and scores are those of brute force."""
    import pyarrow as pa

    rng = random.Random(12)
    terms = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(9, 11))) for _ in range(150)} | {"scum", "idio*"})
    weights = [1 + 0.01 * k for k in range(len(terms))]
    model = toxicity.ToxicityModel(terms, weights, np.array([2.0, 1.0, 0.7, -0.5, 3.0, -2.0]))

    def mutated(t):
        w = list(t.removesuffix("*"))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "q"])
        return "".join(w) or "x"

    texts = ["", "plain words only"] + [" ".join(rng.choice(["and", "the", '"', "river", mutated(rng.choice(terms)).capitalize()]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    got = model.scores(pa.array(texts))
    want = [brute.toxic_score(t, terms, weights, model.coefficients, toxicity.edits_allowed) for t in texts]
    assert np.allclose(got, want)
    assert len({round(x, 6) for x in want}) > 40


def test_license_spans():
    """Notices with planted errors: each is found, and its errors are the edits between the span's words and the notice."""
    rng = random.Random(13)
    search = license_scan.NoticeSearch(license_scan.NOTICES, license_scan.CHARS_PER_ERROR)
    for notice, label in license_scan.NOTICES.items():
        for errors in range(license_scan.errors_allowed(notice) + 1):
            w = list(notice)
            for k in rng.sample([i for i in range(1, len(w) - 1) if w[i] != " "], errors):
                w[k] = "z"
            text = f"some words before {''.join(w)} and some behind".encode()
            found = [x for x in search.find(text) if x[0] == label]
            assert found
            for _, a, b, n, similarity in found:
                near = [x for x, y in license_scan.NOTICES.items() if y == label]
                assert n >= min(brute.edits(text[a:b].decode(), x) for x in near) and 0 < similarity <= 1
            assert min(x[3] for x in found) <= errors
    assert search.find(b"nothing of that kind is written in this text") == []
