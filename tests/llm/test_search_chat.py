"""Nearest neighbours, chat windows and the pipeline."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hazardlens.llm import ann, chat


# --- nearest neighbours -----------------------------------------------------

def brute_nearest(ids, vectors, every, k):
    result = {}
    for i, own in zip(ids, vectors):
        if i % every == 0:
            score = (vectors * own).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            result[i] = [(ids[j], score[j]) for j in order]
    return result


def test_recall_on_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    wanted = brute_nearest(ids, np.array([r.embedding for r in rows], float), ann.EVERY, ann.NEIGHBOURS)
    found = {}
    for r in ann.op3_nearest(spark, sf_dir.replace("0.001", "0.01")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == set(wanted)
    hits = total = 0
    for q, rs in found.items():
        assert [r.rank for r in rs] == list(range(1, len(rs) + 1)) and len(rs) == len(wanted[q])
        assert sorted(rs, key=lambda r: (-r.score, r.vec_id)) == rs
        hits += len({r.vec_id for r in rs} & {j for j, _ in wanted[q]})
        total += len(wanted[q])
    assert hits / total >= 0.9


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [9.0, -3.0]), (4, None), (5, []), (6, [0.0, 0.0]),
        (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0]), (40, [0.0, 0.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("x"))
    found = [tuple(r) for r in ann.nearest(frame).orderBy("query_id", "rank").collect()]
    assert found == [
        (0, 1, 3, 9.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (0, 4, 20, -1.0),
        (20, 1, 1, -0.5), (20, 2, 2, -0.5), (20, 3, 0, -1.0), (20, 4, 3, -9.0),
    ]
    assert ann.nearest(frame.limit(0)).collect() == []


def test_many_equal_vectors(spark, monkeypatch):
    """A hot vector: its list is cut into parts, ties go to the smaller ids."""
    monkeypatch.setattr(ann, "PART", 50)
    random = np.random.RandomState(0)
    vectors = random.normal(size=(900, 8))
    vectors[::3] = vectors[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(frame).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    wanted = brute_nearest(np.arange(900), vectors, ann.EVERY, ann.NEIGHBOURS)
    for q in range(0, 900, 60):
        assert found[q] == [j for j, _ in wanted[q]]
    assert np.mean([len(set(found[q]) & {j for j, _ in w}) / len(w) for q, w in wanted.items()]) >= 0.9


# --- chat -------------------------------------------------------------------

def expected_chat(rows):
    by = {}
    for conv_id, turn, role, text in rows:
        by.setdefault(conv_id, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv_id, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv_id] = (
            len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
        )
    return out


def found_chat(frame):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in frame.collect()}


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", chat.CONTROL_TEXT), (-7, 1, "assistant", chat.CONTROL_TEXT)]
    assert found_chat(chat.op1_chat_windows(spark, sf_dir)) == expected_chat(rows)


def awkward_turns():
    nasty = ["\\", "\\\\", "<turn>", "</turn>\n", "<\\turn>", "a\\</turn>", "<", "</tur", "n>\n<turn>x\ny</turn>", "é🙂\n\n", "", None]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "system", "be brief"), (2, 1, "user", "hi"), (2, 1, "user", "hi"), (2, None, None, "lost"), (2, 5, "a\nb\\", "x")]
    rows += [(None, 0, "user", "who"), (None, 1, "assistant", "me")]
    rows += [(3, i, ["system", "user", "assistant"][i % 3], f"word {i} " * (i % 40)) for i in range(700)]
    rows += [(4, 0, "assistant", "long words here " * 30_000), (5, 0, "system", "s " * 2000), (5, 1, "assistant", "ok")]
    return rows


def test_awkward_chat(spark):
    rows = awkward_turns()
    frame = spark.createDataFrame(rows, TURNS).withColumns({"segment": F.lit("x"), "window": F.lit(1)}).repartition(3)
    assert found_chat(chat.digests(chat.format_conversations(frame))) == expected_chat(rows)
    assert chat.digests(chat.format_conversations(frame.limit(0))).collect() == []


def test_windows_keep_to_the_budget(spark):
    frame = spark.createDataFrame(awkward_turns(), TURNS)
    windows = chat.format_conversations(frame, budget=200, history_tokens=50).filter("conv_id = 3")
    read = chat.read_windows(windows).join(windows, ["conv_id", "segment", "window"]).orderBy("segment", "window").collect()
    assert len(read) > 20
    for r in read[1:]:
        assert r.text.startswith("<turn>system\nword 0") or r.text.startswith("<turn>system\n</turn>")
    assert all(r.n_tokens <= 200 or len(r.turns) == 1 for r in read)
    assert sum(r.n_repeated > 1 for r in read) > len(read) / 4
    for r in read:
        for span in r.loss:
            assert "<turn>" not in r.text[span.start : span.end]
        targets = [t.text for t in r.turns if t.role == "assistant"]
        assert r.loss_text == "".join(targets)


# --- pipeline ---------------------------------------------------------------

def test_pipeline_stages(spark, documents, sf_dir, tmp_path):
    docs = documents
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        result = stage(spark, docs, sf_dir)
        result.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert docs.schema.simpleString() == before.schema.simpleString()
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-2] == sizes[-1] > 0.5 * sizes[0]
    assert docs.count() == corpus_pipeline.run(spark, sf_dir).count()


#: Columns of the caller's that share a name, in some case, with one that a stage uses.
FOREIGN = ["removed_lines", "removed_runs", "Score", "LANG_PRED", "__text_key", "__id", "__key", "__runs", "others", "own", "lines", "kept", "runs"]


def test_stages_take_awkward_documents(spark, awkward, no_documents, sf_dir, tmp_path):
    for name, docs in (("awkward", awkward), ("none", no_documents)):
        docs = docs.drop("score").withColumns({c: F.lit(f"my {c}") for c in FOREIGN})
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{name}{number}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{number}"))
            if number < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns
                kept = docs.select(*[F.col(f"`{c}`") for c in FOREIGN]).distinct().collect()
                assert [tuple(r) for r in kept] == ([tuple(f"my {c}" for c in FOREIGN)] if name == "awkward" else [])
        ids = [r.doc_id for r in docs.collect()]
        if name == "none":
            assert ids == []
        else:
            # 10 is a near copy of 9, and 12 keeps the line that 11 has not.
            assert {7, 9, 11, 12, 14} <= set(ids) and not {4, 5, 6, 10, 13} & set(ids)
            assert json.dumps(sorted(i for i in ids if i is not None))


@pytest.mark.parametrize("module", ["ann", "bpe", "chat", "decontam", "langid", "linededup", "neardup", "secrets", "tokenfiles", "urlfilter", "hardneg", "knnjoin", "repair", "vectors"])
def test_nothing_pins_data_to_one_machine(module):
    source = open(f"{corpus_pipeline.__file__.rsplit('/', 1)[0]}/hazardlens/llm/{module}.py").read()
    for word in ("localCheckpoint", "tempfile", "crossJoin", "/tmp"):
        assert word not in source
