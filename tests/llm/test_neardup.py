import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from hazardlens.llm import neardup
from hazardlens.llm import words as W
from hazardlens.llm.common import slices
from hazardlens.llm.graph import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) >= 5:
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of each row by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = Counter(p for ids in holders.values() for p in combinations(ids, 2))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            parent[find(a)] = find(b)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        if doc_id is not None:
            lowest[r] = min(doc_id, lowest.get(r, doc_id))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        c = lowest.get(find(i))
        out.append((doc_id, len(sets[i]), c, doc_id == c))
    return sorted(map(str, out))


def found(frame):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in frame.collect())


def test_awkward_documents(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(neardup.near_duplicates(awkward)) == brute(rows)


def test_small_table(documents, spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(neardup.op4_near_duplicates(spark, sf_dir)) == brute(rows)


def test_copies_edited_away_from_each_other(spark):
    """Copies that are near their original but not near each other end in one component."""
    random = np.random.RandomState(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(50, " ".join(base))]
    for k in range(60):
        words = list(base)
        for at in random.choice(300, 7, replace=False):
            words[at] = f"x{k}y{at}"
        rows.append((100 + k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(neardup.near_duplicates(frame)) == brute(rows)


def test_empty_table(no_documents):
    assert neardup.near_duplicates(no_documents).collect() == []


def test_sketches_estimate_similarity():
    random = np.random.RandomState(1)
    for shared, low, high in ((0.95, 0, 50), (0.75, 40, neardup.SKETCH_DISTANCE), (0.0, 150, 512)):
        a = random.randint(0, 2**62, 2000).astype(np.uint64)
        n = int(round(2000 * 2 * shared / (1 + shared)))
        b = np.concatenate([a[:n], random.randint(0, 2**62, 2000 - n).astype(np.uint64)])
        x, y = neardup.odd_sketches(neardup.min_hashes([np.unique(a), np.unique(b)]))
        assert low <= sum(bin(int(v) & (2**64 - 1)).count("1") for v in x ^ y) <= high


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \t\n\x0b\x1fß,.", max_size=40), max_size=6))
def test_word_hashes_agree_with_words(texts):
    for _, _, data, offsets in slices(pa.array([*texts, None], pa.string())):
        hashes, first = W.words(data, offsets)
        names = {}
        for text, a, b in zip([*texts, ""], first[:-1], first[1:]):
            words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
            assert len(words) == b - a
            for word, value in zip(words, hashes[a:b]):
                assert names.setdefault(word, value) == value
        assert len(set(names.values())) == len(names)


def test_components_of_a_long_path(spark, tmp_path):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in connected_components(frame, str(tmp_path)).collect()}
    assert set(roots[i] for i in range(41)) == {0}
    assert roots[100] == roots[101] == roots[102] == 100


def test_the_pipeline_keeps_one_of_each_group_whatever_the_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:at], "odd", *words[at + 1 :]]) for at in (0, 59)] + [" ".join(words)]
    other = [" ".join(f"v{i}" for i in range(60 + n)) for n in range(3)]
    rows = [(5, t) for t in near] + [(9, near[0]), (None, near[1])] + [(None, t) for t in [*other, other[0]]]
    rows += [(None, "alone among those without an id"), (None, None), (5, ""), (7, " "), (7, "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert [i for i, t in kept if t in near] == [5] and [i for i, t in kept if t in other] == [None]
    rest = [r for r in kept if r[1] not in near + other]
    assert sorted(rest, key=str) == sorted(rows[-5:], key=str)
    assert sorted(kept, key=str) == sorted(
        ((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs.repartition(5), "").collect()), key=str
    )
