import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hazardlens.llm import bpe, chunks, tokenfiles
from hazardlens.llm.chunks import chunk_dictionary, chunk_encoder, chunk_starts, tokenizer_json
from hazardlens.llm.common import slices

BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

TEXT = st.text(alphabet="aAb'sz. ,\n\t  \x85é×İşœß1٣!-<|>日🙂́", max_size=60)


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_chunks_are_encoded_independently(texts):
    for _, _, data, offsets in slices(pa.array(texts, pa.string())):
        starts, first = chunk_starts(data, offsets)
        raw = data.tobytes()
        chunks = [raw[a:b].decode() for a, b in zip(starts[:-1], starts[1:])]
        assert "".join(chunks) == "".join(texts)
        for tokenizer in (BYTES, WORDS):
            for text, a, b in zip(texts, first[:-1], first[1:]):
                assert [i for c in chunks[a:b] for i in ids(tokenizer, c)] == ids(tokenizer, text)


#: Letters, digits, marks, punctuation, blanks and characters without width of many scripts.
MANY = st.text(alphabet="aZ1 \n.,жЯё́ΣςΑέ، ًعרָש कि।ा १한글 中文。，！あガ゙、ー᠎ \u2003\u200b\u200d\u3000\ufeff\u00a0\u1680🙂𝔸é", max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(MANY, min_size=1, max_size=4))
def test_chunks_of_all_scripts_are_encoded_independently(texts):
    test_chunks_are_encoded_independently.hypothesis.inner_test(texts)


#: Sentences in five scripts, and how many words a sentence has.
SCRIPTS = {
    "cyrillic": ("Быстрая рыжая лиса прыгает через ленивую собаку у старой реки.", 10),
    "greek": ("Η γρήγορη αλεπού πηδάει πάνω από τον τεμπέλη σκύλο στο ποτάμι.", 11),
    "arabic": ("الثعلب البني السريع يقفز فوق الكلب الكسول قرب النهر", 9),
    "hindi": ("तेज़ भूरी लोमड़ी आलसी कुत्ते के ऊपर से कूदती है", 10),
    "chinese": ("敏捷的狐狸跳过懒狗，河水很清。天气也好，鸟在唱歌。", 4),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_texts_of_every_script_become_words(script):
    """The distinct pieces are those of one sentence, however often it stands in the texts."""
    sentence, words = SCRIPTS[script]
    text = " ".join([sentence] * 200)
    for _, _, data, offsets in slices(pa.array([text, sentence], pa.string())):
        distinct, codes, first = chunk_dictionary(data, offsets)
        assert words <= len(distinct) <= 2 * words + 6 and first[1] >= 200 * words
        found = [b"".join(distinct.to_pylist()[c] for c in codes[a:b]).decode() for a, b in zip(first[:-1], first[1:])]
        assert found == [text, sentence]
        for tokenizer in (BYTES, WORDS):
            each = [ids(tokenizer, w.decode()) for w in distinct.to_pylist()]
            assert [i for c in codes[: first[1]] for i in each[c]] == ids(tokenizer, text)


#: All punctuation of ASCII, with letters, digits, marks and blanks around it.
PUNCTUATED = st.lists(
    st.one_of(
        st.sampled_from([chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]),
        st.sampled_from(["a", "Zs", "é", "жд", "Σ", "7", "'s", "'Re", " ", "\n", "\u0338", "\u0301", "<|endoftext|>", "<|startoftext|>", "text|>"]),
    ), max_size=24,
).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(PUNCTUATED, min_size=1, max_size=4))
def test_punctuated_chunks_are_encoded_independently(texts):
    test_chunks_are_encoded_independently.hypothesis.inner_test(texts)


def test_punctuation_behind_a_word_makes_no_new_words():
    """A word is one piece whatever stands behind it, so that op7 and op8 encode it once."""
    marks = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"
    text = "".join(f" river{m * 3} été{m} река{m}" for m in marks)
    for _, _, data, offsets in slices(pa.array([text], pa.string())):
        distinct, codes, _ = chunk_dictionary(data, offsets)
        assert len(distinct) == 3 + 2 * len(marks) and len(codes) == 6 * len(marks)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(TEXT, MANY, PUNCTUATED), min_size=1, max_size=4), st.integers(1, 40))
def test_cuts_do_not_depend_on_the_blocks(texts, block):
    for _, _, data, offsets in slices(pa.array(texts, pa.string())):
        whole = [a.tolist() for a in chunk_starts(data, offsets)]
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(chunks, "BLOCK", block)
            assert [a.tolist() for a in chunk_starts(data, offsets)] == whole


def test_remembered_words_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 40_000)
    encoder = tokenfiles.RememberingEncoder(tokenizer_json(public_tokenizers.path("word_bpe_49k.json")))
    for n in range(60):
        text = " ".join([f"w{n}x{i}" for i in range(40)] + ["y" * 30_000])
        for _, _, data, offsets in slices(pa.array([text], pa.string())):
            found, counts = encoder.encode(data, offsets)
            assert np.asarray(found).view("<u4").tolist() == ids(WORDS, text) and counts.tolist() == [len(ids(WORDS, text))]
    assert sum(len(w) + len(i) for part in (encoder.recent, encoder.older) for w, i in part.items()) <= 40_000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abzAé×İşßœ n\u0131", min_size=1, max_size=6), max_size=30))
def test_words_encoded_together_equal_words_alone(words):
    encoder = chunk_encoder(tokenizer_json(public_tokenizers.path("word_bpe_49k.json")))
    raw = [w.encode() for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(raw, at_once=7)] == [ids(WORDS, w) for w in words]


def expected_bpe(rows):
    out = []
    for doc_id, text in rows:
        found = ids(BYTES, text)
        decoded = BYTES.decode(found, skip_special_tokens=False)
        out.append((
            doc_id, len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest(),
        ))
    return sorted(map(str, out))


@pytest.mark.parametrize("table", ["awkward", "documents"])
def test_bpe_equals_the_library(request, table):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(str(tuple(r)) for r in bpe.digests(docs).collect()) == expected_bpe(rows)


def test_bpe_of_no_documents(no_documents):
    assert bpe.digests(no_documents).collect() == []


def test_decode_replaces_broken_bytes(spark):
    numbers = [int(np.flatnonzero([p.as_py() == b"\xe6" for p in bpe.pieces()])[0]), 0]
    frame = spark.createDataFrame([(1, bytearray(np.array(numbers, "<u4").tobytes()))], "row long, ids binary")
    assert bpe.decode(frame).first().text == BYTES.decode(numbers, skip_special_tokens=False) == "�!"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(values, kind):
    values = np.array(values, np.uint32)
    planes = tokenfiles.planes_of(values, kind)
    assert tokenfiles.ids_of(planes, len(values), kind).tolist() == values.tolist()


def expected_files(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for doc_id, text in rows:
        found = [*ids(WORDS, text), tokenfiles.END_ID]
        out.append((doc_id, start, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        start += len(found)
    return out


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_files_hold_what_the_library_encodes(spark, documents, tmp_path, planes, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", 1000)
    manifest = tokenfiles.write_token_files(documents, str(tmp_path / "out"), planes=planes)
    read = tokenfiles.read_token_files(manifest, str(tmp_path / "out")).orderBy("doc_id")
    assert [tuple(r) for r in read.collect()] == expected_files([(r.doc_id, r.text) for r in documents.collect()])


def test_awkward_files(awkward, no_documents, tmp_path):
    """Sizes and checksums per document; ids that repeat stand together."""
    manifest = tokenfiles.write_token_files(awkward, str(tmp_path / "a"))
    read = [tuple(r) for r in tokenfiles.read_token_files(manifest, str(tmp_path / "a")).collect()]
    wanted = expected_files([(r.doc_id, r.text) for r in awkward.collect()])
    assert sorted(map(str, [(r[0], *r[2:]) for r in read])) == sorted(map(str, [(r[0], *r[2:]) for r in wanted]))
    by_start = sorted(read, key=lambda r: r[1])
    assert [r[0] for r in by_start] == [r[0] for r in wanted]
    assert [r[1] for r in by_start] == [0, *np.cumsum([r[2] for r in by_start])[:-1]]
    manifest = tokenfiles.write_token_files(no_documents, str(tmp_path / "b"))
    assert tokenfiles.read_token_files(manifest, str(tmp_path / "b")).collect() == []


def test_remembering_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 4)
    encoder = tokenfiles.RememberingEncoder(tokenizer_json(public_tokenizers.path("word_bpe_49k.json")))
    texts = ["one two three", "four five six one", "", "two seven"]
    for _, _, data, offsets in slices(pa.array(texts)):
        found, sizes = encoder.encode(data, offsets)
    assert found.tolist() == [i for t in texts for i in ids(WORDS, t)]
    assert sizes.tolist() == [len(ids(WORDS, t)) for t in texts]


def test_incomplete_file_is_an_error(tmp_path):
    path = tmp_path / "broken.bin"
    path.write_bytes(tokenfiles.MAGIC + b"12345678" * 4)
    system, place = tokenfiles.open_folder(str(path))
    with system.open_input_file(place) as file, pytest.raises(ValueError):
        tokenfiles.read_footer(file)


def test_files_need_no_column_but_id_and_text(documents, tmp_path):
    odd = documents.withColumns({"key": F.lit("x"), "shard": F.lit("y")})
    manifest = tokenfiles.write_token_files(odd, str(tmp_path / "c"))
    assert tokenfiles.read_token_files(manifest, str(tmp_path / "c")).count() == documents.count()
