import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from thicket.llm.token_files import DOCUMENT, TokenFiles, encoder, largest_id, loaded, mapped, unsigned, words_apart, write_tokens

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string, kind string, ids int"
ODD = ["", None, "Don't stop; it's 3.5% <|endoftext|> x<|startoftext|>y", "á é  b\u0085c\x1cd", "ΑΣ ΟΔΟΣ. İstanbul ǅ ß", "한국어 한 日本語", "#" * 50, "x" * 3000, "long words, " * 4000, "'s 're' 'LL. ABC; abc! 42 a1b2"]


def by_hand(texts, path, end=2):
    tokenizer = loaded(path)
    return [[*(tokenizer.encode(t, add_special_tokens=False).ids if t else []), end] for t in texts]


def checksum(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def expected(rows, path, end=2):
    """(doc_id, start, n_tokens, ids_crc32) of rows that are in order."""
    out, at = [], 0
    for key, ids in zip((r[0] for r in rows), by_hand([r[1] for r in rows], path, end), strict=True):
        out.append((key, at, len(ids), checksum(ids)))
        at += len(ids)
    return out


@pytest.mark.parametrize(("path", "end", "kind"), [(WORDS, 2, "<u2"), (WORDS, 300, "<u4"), (BYTES, 0, "<u2")])
def test_files_hold_whole_texts_in_order_of_ids(spark, tmp_path, path, end, kind):
    rows = [(k * 7 % 41 - 5, ODD[k % len(ODD)] if k % 3 else f"text {k} of Some words", "x", "y", 1) for k in range(41)]
    files = write_tokens(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "t"), path, end, parts=5)
    want = expected(sorted(rows), path, end)
    assert files.kind == kind and len(files.parts) > 1
    for way in (True, False):
        assert sorted(tuple(r) for r in files.documents(mmap=way).collect()) == want
    again = TokenFiles.open(spark, str(tmp_path / "t"))
    assert again.n_tokens == want[-1][1] + want[-1][2]
    whole = [i for ids in by_hand([r[1] for r in sorted(rows)], path, end) for i in ids]
    assert again.ids(0, again.n_tokens).tolist() == whole
    for a, z in ((0, 0), (3, 4), (again.parts[1].base - 2, again.parts[1].base + 2), (len(whole) - 1, len(whole) + 9)):
        assert again.ids(a, z).tolist() == whole[a:z]
    for r in again.documents(ids=True).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == whole[r["start"] : r["start"] + r["n_tokens"]]


def test_the_files_are_flat(spark, tmp_path):
    rows = [(3, "b"), (1, "a a"), (2, None)]
    files = write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), WORDS, 2, parts=1)
    [part], root = files.parts, str(tmp_path / "t")
    a, b = loaded(WORDS).encode("a").ids[0], loaded(WORDS).encode("b").ids[0]
    assert mapped(root, part.ids, "<u2").tolist() == [a, a, 2, 2, b, 2]
    assert mapped(root, part.offsets, "<u8").tolist() == [0, 3, 4]
    assert mapped(root, part.docs, DOCUMENT)["id"].tolist() == [1, 2, 3]
    assert json.loads((tmp_path / "t" / "manifest.json").read_text())["parts"][0]["base"] == 0


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "no id"), (None, "no id"), (-(2**63), "least"), (2**63 - 1, "most"), (None, None)] + [(5, "same")] * 40 + [(5, f"other {k}") for k in range(40)]
    files = write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), WORDS, 2, parts=6)
    got = [tuple(r) for r in files.documents().orderBy("start").collect()]
    assert [g[0] for g in got] == [None] * 3 + [-(2**63)] + [5] * 80 + [2**63 - 1]
    assert sorted((g[0] is not None, g[0] or 0, g[2], g[3]) for g in got) == sorted((k is not None, k or 0, len(i), checksum(i)) for (k, _), i in zip(rows, by_hand([t for _, t in rows], WORDS), strict=True))
    assert all(b[1] == a[1] + a[2] for a, b in zip(got, got[1:], strict=False))
    assert max(p.n_docs for p in files.parts) < 70  # one id is dealt to several files
    twice = write_tokens(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3), str(tmp_path / "u"), WORDS, 2, parts=2)
    assert [tuple(r) for r in twice.documents().orderBy("start").collect()] == got  # the scan's order doesn't matter


def test_empty_table(spark, tmp_path):
    files = write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"), WORDS, 2)
    assert files.documents().collect() == [] and files.n_tokens == 0
    assert TokenFiles.open(spark, str(tmp_path / "t")).documents().count() == 0


def test_ids_that_do_not_fit():
    assert [unsigned(65535), unsigned(65536), unsigned(9, 256)] == ["<u2", "<u4", "<u4"]
    assert largest_id(WORDS) == 49407
    with pytest.raises(ValueError):
        unsigned(1 << 24)


def test_only_known_tokenizers_are_asked_word_by_word():
    described = json.loads(loaded(WORDS).to_str())
    assert words_apart(described) and not words_apart(json.loads(loaded(BYTES).to_str()))
    assert not words_apart(described | {"normalizer": {"type": "Sequence", "normalizers": described["normalizer"]["normalizers"][:2]}})
    assert not words_apart(described | {"added_tokens": [described["added_tokens"][0] | {"lstrip": True}]})
    assert encoder(BYTES, "<u2").words is None


@settings(max_examples=600, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n\t\r\x0b\x0c.,;:!?'sStT<|>aAbB0́̇ΣİéÉíàßÿ÷ªñ"))), max_size=60))
def test_words_and_whole_texts_agree(text):
    """Word by word or whole, the library gives the same ids."""
    found = encoder(WORDS, "<u2")(text.encode())
    assert np.frombuffer(found, "<u2").tolist() == loaded_once().encode(text, add_special_tokens=False).ids


def loaded_once(kept=[]):  # noqa: B006
    if not kept:
        kept.append(loaded(WORDS))
    return kept[0]


def test_every_given_document(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted(tuple(r) for r in docs.collect())
    got = write_tokens(docs, str(tmp_path / "t"), WORDS, 2, parts=3).documents()
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, WORDS)
