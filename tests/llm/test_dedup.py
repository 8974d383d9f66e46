import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
import xxhash

from brickfold.llm import exact, near_copies, simhash, substrings, suffixes, toxicity

WORD = r"[^\x20\x09-\x0D]+"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def corpus(spark, seed=3, n=60):
    rng = random.Random(seed)
    passage = " ".join(rng.choice("alpha beta gamma delta é").__add__(str(rng.randrange(50))) for _ in range(60))
    texts = []
    for _ in range(n):
        words = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.choice([0, 3, 19, 20, 21, 90, 300]))]
        if rng.random() < 0.5:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage.split()[rng.randrange(20) :]
        if rng.random() < 0.2:
            words += words
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    texts += texts[:7] + [None, "", "z" * 900, "z" * 900]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def test_exact_groups_with_hot_text(spark):
    rows = [(i, "same  text" if i % 3 == 0 else f"t {i}") for i in range(300)] + [(900, None), (901, "")]
    got = {r.doc_id: r for r in exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for norm, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (min(ids), len(ids), i == min(ids), sha(norm))


def test_exact_dedup_awkward(awkward, empty):
    out = exact.exact_dedup(awkward)
    assert out.columns == awkward.columns
    norms = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in awkward.collect()]
    assert out.count() == len(set(norms))
    assert exact.exact_groups(empty).count() == 0


def brute_print(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]) if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum((x >> b) & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("bucket", [4096, 2])
def test_simhash_links(spark, bucket):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    near = [int(x) ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) for x in base for _ in range(3)]
    prints = sorted({int(x) for x in base} | set(near))
    df = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long")
    found = {r.high: r.low for r in simhash.components(simhash.candidate_edges(df, bucket)).collect()}
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") <= 3 and label[j] > label[i]:
                    label[j], changed = label[i], True
    assert [found.get(i, i) for i in range(len(prints))] == label


def linked_prints(prints):
    """The smallest print reachable from each by steps of three bits or fewer."""
    label, todo = {}, sorted(set(prints))
    for p in todo:
        if p not in label:
            reach = [p]
            for x in reach:
                label[x] = p
                reach += [q for q in todo if q not in label and q not in reach and bin(x ^ q).count("1") <= 3]
    return label


def test_simhash_components_and_dedup_end_to_end(spark):
    rng = np.random.default_rng(8)
    rows = [(None, ""), (None, "  "), (4, None), (4, "lone words of one row"), (None, "nothing else is like this")]
    for base in range(10):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for step in range(6):  # a chain: each text a word away from the one before
            words[int(rng.integers(300))] = f"W{rng.integers(5000)}"
            rows.append((None if step % 3 == 1 else int(rng.integers(0, 60)), " ".join(words)))
    rows += rows[7:9]
    df = spark.createDataFrame([(t, i, "x", 1, 2) for i, t in rows], "text string, doc_id long, root string, fp int, __row int")
    label = linked_prints([brute_print(t) for _, t in rows])
    assert 1 < len(set(label.values())) < len(label)
    root = [label[brute_print(t)] for _, t in rows]
    name = {r: min((i for (i, _), q in zip(rows, root) if q == r and i is not None), default=None) for r in root}
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=key)
    assert got == sorted(((i, f"{brute_print(t):016x}", name[r]) for (i, t), r in zip(rows, root)), key=key)
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    kept = kept.collect()
    assert len(kept) == len(name) and {label[brute_print(r.text)]: r.doc_id for r in kept} == name


def test_simhash_awkward(awkward, empty):
    got = simhash.near_duplicates(awkward)
    assert got.count() == awkward.count()
    texts = {r.doc_id: r.text for r in awkward.collect()}
    for r in got.collect():
        if r.doc_id is not None:
            assert r.fingerprint == f"{brute_print(texts[r.doc_id]):016x}"
    assert simhash.near_dedup(awkward).columns == awkward.columns
    assert simhash.near_duplicates(empty).count() == 0


def test_substrings_against_brute_force(spark):
    docs = corpus(spark)
    got = {r.given: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs, block_bytes=4000).collect()}
    seen = set()
    for r in docs.orderBy("doc_id").collect():
        w = re.findall(WORD, r.text or "")
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone.update(range(k, k + 20))
            seen.add(key)
        assert got[r.doc_id] == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))


def test_substring_reports_awkward(awkward, empty):
    for report in (substrings.substring_report, suffixes.suffix_report):
        assert report(awkward).count() == awkward.count()
        assert report(empty).count() == 0


def test_suffixes_against_brute_force(spark):
    docs = corpus(spark, 8)
    got = {r.given: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeated_bytes(docs, block_bytes=4000).collect()}
    data = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    count = Counter(b[k : k + 200] for b in data.values() for k in range(len(b) - 199))
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        assert got[i] == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g))


def test_suffix_ranks_equal_digest_order():
    text = np.frombuffer(("ab" * 200 + "abc" * 150 + "ab" * 300).encode(), np.uint8)
    starts = np.arange(len(text) - 199)
    _, of, count = np.unique(suffixes.ranked(text, starts, 200), return_inverse=True, return_counts=True)
    assert (suffixes.repeated(text, starts, 200) == (count[of] > 1)).all()


def jaccard_components(texts, limit=0.8):
    sets = []
    for t in texts:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    label, changed = list(range(len(texts))), True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if label[j] > label[i] and len(a & b) >= limit * len(a | b):
                    label[j], changed = label[i], True
    return label


def near_corpus(seed=11):
    rng = random.Random(seed)
    shared = [f"s{i}" for i in range(40)]  # a passage that many unlike texts hold
    texts = []
    for i in range(30):
        words = [f"{rng.choice('abcdef')}{rng.randrange(200)}" for _ in range(rng.choice([1, 4, 5, 9, 60, 200]))] + shared * (i % 2)
        for _ in range(rng.choice([1, 2, 4])):
            other = list(words)
            for _ in range(rng.choice([0, 1, 2, 4])):
                other[rng.randrange(len(other))] = f"n{rng.randrange(99)}"
            texts.append(" ".join(other))
    long = [f"w{i}" for i in range(400)]
    texts += [" ".join([*long[:k], "x", *long[k + 1 :]]).upper() for k in range(0, 400, 5)]
    return [*texts, None, " ", texts[0].upper()]


@pytest.mark.parametrize("large", [64, 4])
def test_near_copies_against_brute_force(spark, large):
    texts = near_corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    found = {r.high: r.low for r in near_copies.near_copies(df, large=large).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == jaccard_components(texts)


def test_near_dedup_by_row(spark, awkward, empty):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (2, "another text that no other row holds"), (None, text + " end"), (None, "stays as it is")]
    kept = near_copies.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in kept} == {rows[0], rows[2], rows[4]}
    assert near_copies.near_dedup(awkward).columns == awkward.columns and near_copies.near_dedup(empty).count() == 0


def test_pipeline_drops_near_copies_of_five_word_shingles(spark):
    import corpus_pipeline

    words = [f"v{i}" for i in range(100)]
    texts = [" ".join(words)] + [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in (20, 50, 80)]
    texts += [" ".join(words[:-2] + ["x", "y"]), " ".join(words[50:] + words[:50]), " ".join(words[::-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == sorted(set(jaccard_components(texts)))


def test_pipeline_drops_texts_of_linked_fingerprints(spark):
    """Repeats outweigh the tails in the fingerprints, not in the sets of shingles; a chain runs over both kinds of links."""
    import corpus_pipeline

    tail = lambda k: [f"{k}tail{i}" for i in range(30)]
    texts = [" ".join(["a", "b", "c"] * 400 + tail(k)) for k in "xy"]
    texts += [" ".join(["a", "b", "c"] * 400 + tail("y")[:-1] + ["end"]), "another text of few words"]
    assert (brute_print(texts[0]) ^ brute_print(texts[1])).bit_count() <= 3 and len(set(jaccard_components(texts))) == 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 3]


def test_near_dedup_with_clashing_columns_nulls_and_repeated_ids(spark, empty):
    from brickfold.llm import near_copies

    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long, "a", 0), (1, "another text of its own with quite some words", "b", 1), (2, long + " end", "c", 2), (None, long + " end", "d", 3), (None, None, "e", 4), (3, "", "f", 5), (4, " \n", "g", 6), (5, "short", "h", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row string, __own int")
    out = near_copies.near_dedup(df)
    assert out.columns == df.columns
    assert sorted(r["__row"] for r in out.collect()) == ["a", "b", "f", "h"]
    assert near_copies.near_dedup(empty).count() == 0 and near_copies.near_dedup(empty).columns == empty.columns


def test_parity_sketches_never_exceed_the_differences():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 500, 5000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for change in (0, 1, n // 9, n // 2, n):
            b = np.unique(np.concatenate([a[change:], rng.integers(0, 2**63, change // 2, dtype=np.uint64)]))
            found = near_copies.least_differences(near_copies.parity_sketch(a), near_copies.parity_sketch(b))
            assert found <= len(np.setxor1d(a, b)) and found == near_copies.least_differences(near_copies.parity_sketch(b), near_copies.parity_sketch(a))
            assert change or not found
    unlike = [rng.integers(0, 2**63, 1000, dtype=np.uint64) for _ in range(2)]
    assert near_copies.least_differences(*map(near_copies.parity_sketch, unlike)) * 9 > 2000


def test_unlike_rows_of_a_bucket_are_told_apart_without_their_whole_sets(spark, monkeypatch):
    """Halves are shared, so that rows meet by their first shingles; only the two that are alike may need whole sets. What was needed only on the way is gone at the end."""
    rng = random.Random(5)
    half = [f"h{i}" for i in range(60)]
    texts = [" ".join(half + [f"{k}w{rng.randrange(10**6)}" for _ in range(50)]) for k in range(12)]
    texts.append(texts[3] + " end")
    sizes, folders, write = {}, {}, near_copies.written

    def noted(df, name="state"):
        out = write(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        folders.setdefault(name, []).extend({re.sub("^file:/+", "/", f).rsplit("/", 1)[0] for f in out.inputFiles()})
        return out

    monkeypatch.setattr(near_copies, "written", noted)
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(2)
    assert {(r.low, r.high) for r in near_copies.near_copies(df).collect()} == {(3, 12)}
    assert sizes["candidate_pairs"] > 30 and sizes["candidate_sets"] == 2
    for name in ("shingle_sketch", "prefix_entries", "shared_shingles", "shared_entries", "candidate_pairs", "candidate_sets", "open_entries", "set_digests"):
        assert not any(os.path.exists(f) for f in folders.get(name, [])), name


def test_lazy_pipeline_stages_hand_python_small_batches(spark):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        texts = spark.createDataFrame([(i, "x" * 1_000_000, "en", "web") for i in range(12)], "doc_id long, text string, lang string, source string").coalesce(1)
        corpus_pipeline.encode(spark, texts, "")
        sizes = texts.mapInArrow(lambda batches: (b.select(["doc_id"]).slice(0, 1) for b in batches), "doc_id long")
        assert sizes.count() >= 3
    finally:
        spark.conf.set(key, before)


def test_pipeline_stages_hand_python_at_most_a_few_hundred_kilobytes(spark):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        texts = spark.createDataFrame([(i, "x" * 300_000, "en", "web") for i in range(12)], "doc_id long, text string, lang string, source string").coalesce(1)
        corpus_pipeline.encode(spark, texts, "")
        assert texts.mapInArrow(lambda batches: (b.select(["doc_id"]).slice(0, 1) for b in batches), "doc_id long").count() >= 4
        assert max(near_copies.BATCH_BYTES, toxicity.BATCH_BYTES) <= corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.set(key, before)


def test_python_workers_of_the_pipeline_load_no_pandas():
    """It costs each worker some 27 MB."""
    code = "import sys, brickfold.llm.bpe, brickfold.llm.near_copies, brickfold.llm.toxicity; print('pandas' in sys.modules)"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.strip() == "False"


def test_scoring_keeps_few_words():
    model = toxicity.Model(-7.0, {"bad": 3.0}, -6.0)
    for at in range(0, 200_000, 1000):
        model.sentences(" ".join(f"w{i}" for i in range(at, at + 1000)))
    assert len(model.known) + len(model.known.old) <= 1 << 16 and model.sentences("bad.")[1]
